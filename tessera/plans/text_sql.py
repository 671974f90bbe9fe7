"""SQL equivalents of packing, overlap, batches and claim verification, by recursion."""

from __future__ import annotations

from tessera.functions import claims as fc
from tessera.functions.text import SENTENCE_END
from tessera.plans.base import quoted

END = SENTENCE_END.replace("'", "''")
MARK = "\x1e"
#: Case folding of the alphabets in the tables: lower case, ß as ss.
FOLD_SQL = r"trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '\s+', ' ', 'g'))"


def tokens_sql(text: str) -> str:
    """Sentence tokens of a text."""
    edges = r"""[.,;:!?"''()\[\]{}<>]+"""
    return f"list_filter(list_transform(string_split({FOLD_SQL.format(text)}, ' '), lambda t: regexp_replace(t, '^{edges}|{edges}$', '', 'g')), lambda t: t <> '')"


def sentences_sql(text: str, compat: bool = False) -> str:
    put = MARK + "\\1" if compat else "\\1" + MARK
    return f"list_filter(list_transform(string_split(regexp_replace({text}, '({END})', '{put}', 'g'), chr(30)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"


def base_sql(t: str) -> str:
    cut = lambda s: f"CASE WHEN ends_with({t}, '{s}') THEN left({t}, length({t}) - {len(s)}) END"
    doubled = lambda s: f"CASE WHEN ends_with({t}, '{s}') AND length({t}) >= {len(s) + 2} AND substr({t}, length({t}) - {len(s)}, 1) = substr({t}, length({t}) - {len(s)} - 1, 1) THEN left({t}, length({t}) - {len(s)} - 1) END"
    to_y = lambda s: f"CASE WHEN ends_with({t}, 'i{s}') THEN left({t}, length({t}) - {len(s)} - 1) || 'y' END"
    parts = [cut("s"), cut("es"), cut("ed"), cut("ing"), f"{cut('ed')} || 'e'", f"{cut('ing')} || 'e'", doubled("ed"), doubled("ing"), to_y("es"), to_y("ed")]
    return f"list_distinct(list_concat([{t}], list_filter([{', '.join(parts)}], lambda b: b IS NOT NULL AND length(b) >= 3)))"


def count_sql(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]'))"


# Documents whose lines are paragraphs, packed greedily.
PACKED_SQL = f"""paras AS MATERIALIZED (SELECT doc_id, i, xs[i] AS p FROM (SELECT doc_id, xs, unnest(range(1, len(xs) + 1)) AS i FROM
    (SELECT doc_id, list_filter(string_split(regexp_replace(text, '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g'), chr(10)), lambda p: length(trim(p, ' ' || chr(9) || chr(10))) > 0) AS xs FROM documents))),
sized AS MATERIALIZED (SELECT *, {count_sql("p")} AS n, sum(CASE WHEN {count_sql("p")} > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS long FROM paras),
sents AS (SELECT doc_id, i, long, j, xs[j] AS piece FROM (SELECT doc_id, i, long, xs, unnest(range(1, len(xs) + 1)) AS j FROM (SELECT doc_id, i, long, {sentences_sql("p")} AS xs FROM sized WHERE n > 400))),
pieces AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS k FROM (
    SELECT doc_id, i, 0 AS j, -long AS grp, p AS piece, n FROM sized WHERE n <= 400 UNION ALL SELECT doc_id, i, j, long, piece, {count_sql("piece")} FROM sents)),
packs AS (SELECT doc_id, k, grp, 0 AS pack, n AS total FROM pieces WHERE k = 1
    UNION ALL SELECT p.doc_id, p.k, p.grp, CASE WHEN p.grp <> r.grp OR r.total + p.n > 400 THEN r.pack + 1 ELSE r.pack END, CASE WHEN p.grp <> r.grp OR r.total + p.n > 400 THEN p.n ELSE r.total + p.n END
    FROM packs r JOIN pieces p ON p.doc_id = r.doc_id AND p.k = r.k + 1),
chunks AS MATERIALIZED (SELECT doc_id, CAST(pack AS BIGINT) AS ordinal, CASE WHEN min(p.grp) > 0 THEN string_agg(piece, ' ' ORDER BY k) ELSE string_agg(piece, chr(10) || chr(10) ORDER BY k) END AS text
    FROM packs JOIN pieces p USING (doc_id, k) GROUP BY doc_id, pack)"""

PACK_CHUNKS = f"WITH RECURSIVE {PACKED_SQL} SELECT doc_id, ordinal, text FROM chunks"

OVERLAP_CHUNKS = f"""WITH RECURSIVE {PACKED_SQL},
before AS (SELECT doc_id, ordinal, lag(text) OVER (PARTITION BY doc_id ORDER BY ordinal) AS prev FROM chunks),
tails AS (SELECT doc_id, ordinal, j, xs[j] AS s, greatest(1, floor({count_sql("prev")} * 0.15::DOUBLE)) AS most FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS j FROM (SELECT *, {sentences_sql("prev")} AS xs FROM before WHERE prev IS NOT NULL))),
fits AS (SELECT *, sum({count_sql("s")}) OVER (PARTITION BY doc_id, ordinal ORDER BY j DESC) AS upto FROM tails),
heads AS (SELECT doc_id, ordinal, string_agg(s, ' ' ORDER BY j) AS head FROM fits WHERE upto <= most GROUP BY doc_id, ordinal)
SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, coalesce(head || chr(10) || chr(10), '') || text AS text FROM chunks LEFT JOIN heads USING (doc_id, ordinal)"""


def batches_sql(chunks: int, tokens: int) -> str:
    return f"""WITH RECURSIVE {PACKED_SQL}, given AS MATERIALIZED (SELECT doc_id, ordinal, {count_sql("text")} AS n FROM chunks),
dealt AS (SELECT doc_id, ordinal, 0 AS batch, 1 AS held, n AS total FROM given WHERE ordinal = 0
    UNION ALL SELECT g.doc_id, g.ordinal, CASE WHEN r.held >= {chunks} OR r.total + g.n > {tokens} THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.held >= {chunks} OR r.total + g.n > {tokens} THEN 1 ELSE r.held + 1 END,
    CASE WHEN r.held >= {chunks} OR r.total + g.n > {tokens} THEN g.n ELSE r.total + g.n END FROM dealt r JOIN given g ON g.doc_id = r.doc_id AND g.ordinal = r.ordinal + 1)
SELECT doc_id, ordinal, CAST(batch AS INTEGER) AS batch FROM dealt"""


def prepared_sql(text: str) -> str:
    words = quoted(fc.FUNCTION_WORDS)
    return f"list_transform({tokens_sql(text)}, lambda t: {{'token': t, 'fn': list_contains([{words}], t), 'bases': CASE WHEN list_contains([{words}], t) THEN []::VARCHAR[] ELSE {base_sql('t')} END}})"


# Passages and the claims they are split into, as the queries make them; parents are told in upper case there, which folding undoes.
SPLITS_SQL = f"""own AS MATERIALIZED (SELECT item_id, text AS parent, {sentences_sql("text")} AS own FROM benchmark),
splits AS MATERIALIZED (
    SELECT 'own-' || item_id AS sentence_id, parent, own AS claims FROM own
    UNION ALL SELECT 'part-' || item_id, parent, own[1:1] FROM own
    UNION ALL SELECT 'twice-' || item_id, parent, list_concat(own[1:2], own[1:1]) FROM own
    UNION ALL SELECT 'other-' || a.item_id, a.parent, b.own FROM own a JOIN own b ON b.item_id = a.item_id + 1)"""

# Each claim token takes the first free parent token that it matches.
ADDITIVE_SQL = f"""parents AS MATERIALIZED (SELECT sentence_id, {prepared_sql("parent")} AS pt FROM splits),
claims AS MATERIALIZED (SELECT sentence_id, i AS pos, claims[i] AS claim, {prepared_sql("claims[i]")} AS ct FROM (SELECT sentence_id, claims, unnest(range(1, len(claims) + 1)) AS i FROM splits)),
seated AS (SELECT sentence_id, pos, 0 AS i, []::BIGINT[] AS used, 0 AS added, NULL::VARCHAR AS category, NULL::VARCHAR AS token FROM claims
    UNION ALL SELECT sentence_id, pos, i + 1, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit) END, CASE WHEN hit IS NULL THEN added + 1 ELSE added END,
        CASE WHEN hit IS NULL AND NOT t.fn THEN 'content_token' WHEN hit IS NULL AND added + 1 > {fc.MAX_ADDED} THEN 'function_word_overrun' END,
        CASE WHEN hit IS NULL AND (NOT t.fn OR added + 1 > {fc.MAX_ADDED}) THEN t.token END
    FROM (SELECT s.*, c.ct[s.i + 1] AS t, list_filter(range(1, len(p.pt) + 1), lambda x: NOT list_contains(s.used, x) AND (p.pt[x].token = c.ct[s.i + 1].token OR list_has_any(p.pt[x].bases, c.ct[s.i + 1].bases)))[1] AS hit
          FROM seated s JOIN claims c USING (sentence_id, pos) JOIN parents p USING (sentence_id) WHERE s.i < len(c.ct) AND s.category IS NULL)),
verdicts AS MATERIALIZED (SELECT sentence_id, pos, max(category) AS category, max(token) AS token FROM seated GROUP BY sentence_id, pos)"""

ADDITIVE_VERDICT = f"WITH RECURSIVE {SPLITS_SQL}, {ADDITIVE_SQL} SELECT sentence_id, CAST(pos - 1 AS BIGINT) AS pos, category, token FROM verdicts"

SAID_SQL = f"""missing AS (SELECT s.sentence_id, list_filter(p.pt, lambda x: NOT list_contains([{quoted(fc.FUNCTION_WORDS + fc.CLAUSE_CONNECTIVES)}], x.token)
        AND len(list_filter(s.rt, lambda r: r.token = x.token OR list_has_any(r.bases, x.bases))) = 0)[1].token AS missed
    FROM (SELECT sentence_id, flatten(list(ct)) AS rt FROM claims GROUP BY sentence_id) s JOIN parents p USING (sentence_id)),
shape AS (SELECT sentence_id, count(*) AS n, count(DISTINCT {FOLD_SQL.format("claim")}) AS d FROM claims GROUP BY sentence_id),
firsts AS (SELECT sentence_id, min_by(category, pos) AS category, min_by(token, pos) AS token FROM verdicts WHERE category IS NOT NULL GROUP BY sentence_id),
said AS MATERIALIZED (SELECT sentence_id, n, category, token, missed,
    CASE WHEN n > {fc.MAX_CLAIMS} THEN 'over_cap' WHEN d < n THEN 'duplicate' WHEN category IS NOT NULL THEN 'not_additive' WHEN missed IS NOT NULL THEN 'incomplete' ELSE 'valid' END AS disposition
    FROM shape LEFT JOIN firsts USING (sentence_id) LEFT JOIN missing USING (sentence_id))"""

DECOMPOSITION_VERDICT = f"""WITH RECURSIVE {SPLITS_SQL}, {ADDITIVE_SQL}, {SAID_SQL}
SELECT sentence_id, disposition, CASE disposition WHEN 'not_additive' THEN category ELSE '' END AS additive_failure,
    CASE disposition WHEN 'not_additive' THEN token WHEN 'incomplete' THEN missed ELSE '' END AS failure_token,
    CASE disposition WHEN 'not_additive' THEN 'sub_claim' WHEN 'incomplete' THEN 'parent' ELSE '' END AS failure_side FROM said"""

SENTENCE_FATE = f"""WITH RECURSIVE splits AS MATERIALIZED (SELECT item_id AS sentence_id, text AS parent, {sentences_sql("text")} AS claims FROM benchmark), {ADDITIVE_SQL}, {SAID_SQL},
cited AS MATERIALIZED (SELECT item_id AS sentence_id, CAST(doc_id AS VARCHAR) AS chunk_id, {FOLD_SQL.format("d.text")} AS chunk, {FOLD_SQL.format("b.text")} AS whole FROM benchmark b JOIN documents d ON d.doc_id IN (b.item_id, b.item_id + 1)),
held AS (SELECT sentence_id, bool_or(contains(chunk, whole)) AS contained, string_agg(chunk_id, ',' ORDER BY chunk_id) AS citations FROM cited GROUP BY sentence_id),
parts AS (SELECT sentence_id, pos, bool_or(contains(chunk, {FOLD_SQL.format("claim")})) AS inside FROM claims JOIN cited USING (sentence_id) GROUP BY sentence_id, pos),
backed AS (SELECT sentence_id, bool_and(coalesce(inside, false) OR sentence_id % 2 = 0) AS backed FROM claims LEFT JOIN parts USING (sentence_id, pos) GROUP BY sentence_id),
why AS (SELECT item_id AS sentence_id, citations, CASE WHEN coalesce(contained, false) THEN NULL WHEN citations IS NULL THEN 'no_available_citations' WHEN coalesce(n, 0) = 0 OR disposition <> 'valid' THEN 'decomposition_invalid'
    WHEN NOT coalesce(backed, false) THEN 'unsupported_sub_claim' END AS reason
    FROM benchmark LEFT JOIN held ON held.sentence_id = item_id LEFT JOIN said ON said.sentence_id = item_id LEFT JOIN backed ON backed.sentence_id = item_id)
SELECT sentence_id, CASE WHEN reason IS NULL THEN 'emitted' ELSE 'dropped' END AS fate, reason, citations FROM why"""
