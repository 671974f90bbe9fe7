"""Claim verification on token arrays: base sets, matching, the two validity tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words, clause connectives.
FUNCTION_WORDS = """
a an the and that which is are was were be been being has have had do does did can could will would shall should may might must to
of for with by as at on in from about so but or if because when then there it this these those their not no never nor
""".split()
CLAUSE_CONNECTIVES = """
yet albeit although lest though unless whereas whether while whilst accordingly additionally also anyway consequently conversely
furthermore hence however indeed instead likewise meanwhile moreover namely nevertheless nonetheless otherwise rather regardless
subsequently therefore thereby thus how whatever whenever where whereby wherein whereupon wherever whichever who whoever whom whose
why
""".split()
#: The marks stripped from a token's ends; unmatched function words a claim may add; claims a sentence may split into.
EDGE_MARKS = r".,;:!?\"'()\[\]{}<>"
MAX_ADDED, MAX_CLAIMS = 2, 8
MIN_BASE = 3


def sentence_tokens(text: Column) -> Column:
    """Tokens of an already folded text, split at blanks, without edge marks."""
    parts = F.transform(F.split(F.trim(text), r"\s+"), lambda t: F.regexp_replace(t, f"^[{EDGE_MARKS}]+|[{EDGE_MARKS}]+$", ""))
    return F.filter(parts, lambda t: t != "")


def base_set(token: Column) -> Column:
    """The token and every base it may be inflected from (s, es, ed, ing; final e, doubled letter, y)."""

    def cut(suffix: str) -> Column:
        return F.when(token.endswith(suffix), F.substring(token, F.lit(1), F.length(token) - len(suffix)))

    s, es, ed, ing = cut("s"), cut("es"), cut("ed"), cut("ing")
    doubled = lambda b: F.when((F.length(b) >= 2) & (F.right(b, F.lit(1)) == F.substring(b, F.length(b) - 1, F.lit(1))), F.substring(b, F.lit(1), F.length(b) - 1))
    to_y = lambda b: F.when(b.endswith("i"), F.concat(F.substring(b, F.lit(1), F.length(b) - 1), F.lit("y")))
    bases = F.array(s, es, ed, ing, F.concat(ed, F.lit("e")), F.concat(ing, F.lit("e")), doubled(ed), doubled(ing), to_y(es), to_y(ed))
    kept = F.filter(bases, lambda b: b.isNotNull() & (F.length(b) >= MIN_BASE))
    return F.array_distinct(F.concat(F.array(token), kept))


def prepared(tokens: Column) -> Column:
    """Tokens with what matching needs: struct(token, function, bases); function words have no bases.

    Keep the result in a column of its own: array functions evaluate an
    expression again for every element.
    """

    def one(t: Column) -> Column:
        function = t.isin(FUNCTION_WORDS)
        return F.struct(t.alias("token"), function.alias("function"), F.when(function, F.array().cast("array<string>")).otherwise(base_set(t)).alias("bases"))

    return F.transform(tokens, one)


def tokens_match(a: Column, b: Column) -> Column:
    """Equal, or both content words with a base in common; for prepared tokens."""
    return (a["token"] == b["token"]) | F.arrays_overlap(a["bases"], b["bases"])


def additive_failure(claim: Column, parent: Column) -> Column:
    """Why a claim adds to its parent: struct(category, token), or null. Both are prepared.

    Each claim token takes the first unused parent token that matches. The fold
    keeps the used positions, the number of added function words and the first failure.
    """
    start = F.struct(F.array().cast("array<int>").alias("used"), F.lit(0).alias("added"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("token"))
    positions = F.when(F.size(parent) > 0, F.sequence(F.lit(1), F.size(parent))).otherwise(F.array().cast("array<int>"))

    def state(used: Column, added: Column, category: Column, token: Column) -> Column:
        return F.struct(used.alias("used"), added.alias("added"), category.alias("category"), token.alias("token"))

    def seat(acc: Column, t: Column) -> Column:
        return F.try_element_at(F.filter(positions, lambda i: ~F.array_contains(acc["used"], i) & tokens_match(t, F.element_at(parent, i))), F.lit(1))

    def step(acc: Column, t: Column) -> Column:
        # the seat is looked up once, in a one-element array
        done = F.transform(
            F.array(seat(acc, t)),
            lambda hit: F.when(hit.isNotNull(), state(F.array_append(acc["used"], hit), acc["added"], acc["category"], acc["token"]))
            .when(~t["function"], state(acc["used"], acc["added"], F.lit("content_token"), t["token"]))
            .when(acc["added"] + 1 > MAX_ADDED, state(acc["used"], acc["added"], F.lit("function_word_overrun"), t["token"]))
            .otherwise(state(acc["used"], acc["added"] + 1, acc["category"], acc["token"])),
        )
        return F.when(acc["category"].isNotNull(), acc).otherwise(F.element_at(done, 1))

    return F.aggregate(claim, start, step, lambda end: F.when(end["category"].isNotNull(), F.struct(end["category"].alias("category"), end["token"].alias("token"))))


def first_uncovered(parent: Column, response: Column) -> Column:
    """The first parent token, not exempt, that no response token matches; null if complete. Both are prepared."""
    exempt = FUNCTION_WORDS + CLAUSE_CONNECTIVES
    missed = F.filter(parent, lambda p: ~p["token"].isin(exempt) & ~F.exists(response, lambda r: tokens_match(p, r)))
    return F.try_element_at(missed, F.lit(1))["token"]


def stem_match(a: Column, b: Column) -> Column:
    """The directional relation: equal, or one token is derived from the other by one rule."""
    return (a == b) | F.array_contains(base_set(a), b) | F.array_contains(base_set(b), a)
