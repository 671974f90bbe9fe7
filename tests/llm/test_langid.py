import numpy as np
from pyspark.sql import functions as F

from tessera.llm import langid, queries
from tessera.llm.common import table


def test_held_out_accuracy_and_score_range(spark):
    sf = "/root/testdata/sf0.01"
    said = queries.op8_language_id(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    row = said.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert row["a"] > 0.95 and 0 <= row["lo"] <= row["hi"] <= 1


def test_lookup_equals_one_set_per_language():
    rng = np.random.default_rng(0)
    sets = [set(rng.integers(0, 2**63, 300).tolist()) for _ in range(3)]
    masks = np.zeros(1 << 16, np.uint8)
    for i, s in enumerate(sets):
        h = np.array(list(s), np.uint64)
        for _ in range(3):
            masks[h >> np.uint64(48)] |= np.uint8(1 << i)
            h = langid.mix64(h)
    f = langid.Filters(("a", "b", "c"), masks, 16, 3, (2,), np.zeros(3))
    for i, s in enumerate(sets):
        assert (f.lookup(np.array(list(s), np.uint64)) >> i & 1).all()
    strange = f.lookup(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    assert (strange > 0).mean() < 0.01


def test_edge_cases(spark):
    learn = spark.createDataFrame([("en", "the cat and the dog " * 9), ("de", "der Hund und die Katze " * 9), (None, "x"), ("en", None)], "lang string, text string")
    filters = langid.train(learn)
    assert filters.languages == ("de", "en")
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the dog"), (5, "die Katze " * 40_000), (6, "漢字"), (None, "the cat"), (4, "the dog")]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id bigint, text string, score string")
    got = sorted((str(r["doc_id"]), r["lang_pred"]) for r in langid.identify(docs, filters).collect())
    assert got == sorted([("1", "und"), ("2", "und"), ("3", "und"), ("4", "en"), ("5", "de"), ("6", filters.common), ("None", "en"), ("4", "en")])
    assert filters.common in filters.languages
    assert langid.identify(docs.limit(0), filters).count() == 0
    untaught = langid.train(learn.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs, untaught).collect()} == {"und"}


def test_gaps_and_cuts_change_no_ngram():
    grams = lambda t: sorted(langid.ngram_hashes(t, (2, 3, 4, 5)).tolist())
    assert grams("a “b”") == grams("a b") == grams(" a — b… ") and grams("ab") != grams("a b") and len(grams("a b")) == 4 + 3 + 2 + 1
    assert grams("naïve été") != grams("na ve t") and grams("A B") == grams("a b")
    points = langid.points_of("the quick brown fox " * 50)
    parts = [langid.window_hashes(points, (2, 5), at, at + 7) for at in range(0, points.size, 7)]
    assert sorted(np.concatenate(parts).tolist()) == sorted(langid.window_hashes(points, (2, 5), 0, points.size).tolist())


def test_predictions_like_counting_in_sets():
    """Exact sets of n-grams, counted one by one and corrected by the same rate, decide alike."""
    said = {"de": "der hund und die katze sind im haus", "en": "the dog and the cat are in the house", "fr": "le chien et le chat sont dans la maison"}
    sizes, bits = (2, 3), 20

    def grams(text):
        text = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        text = "".join(c for i, c in enumerate(text) if c != " " or i == 0 or text[i - 1] != " ")
        return [text[i : i + n] for n in sizes for i in range(len(text) - n + 1)]

    masks = np.zeros(1 << bits, np.uint8)
    for i, text in enumerate(said.values()):
        h = langid.ngram_hashes(text, sizes)
        for _ in range(2):
            masks[h >> np.uint64(64 - bits)] |= np.uint8(1 << i)
            h = langid.mix64(h)
    rates = np.array([0.001, 0.002, 0.003])
    model = langid.Filters(tuple(said), masks, bits, 2, sizes, rates, "en")
    sets = [set(grams(t)) for t in said.values()]
    for text in ["the cat", "die Katze!", "Le chat…", "house Haus maison", "“in” le", "zzz", "und the la " * 9000, "xq dog, der"]:
        own = grams(text)
        true = np.maximum(0, (np.array([sum(g in s for g in own) for s in sets]) - len(own) * rates) / (1 - rates))
        want = (tuple(said)[int(np.argmax(true))], min(1.0, true.max() / len(own))) if true.sum() > 0 else ("en", 0.0)
        got = model.predict(text)
        assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-12, text
