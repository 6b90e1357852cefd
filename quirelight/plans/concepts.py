"""Queries of concept mining, over the lines of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import concepts as C
from ..sources import fixtures as X
from ..sources.fixtures import sql
from ..sources.shared import written
from .text import _SENT, sql_clean_term, sql_term_key, sql_term_words


def _blocks(spark, d):
    return C.glossary_flag(X.marks(spark, d).withColumn("level", F.lit(2)))


def _candidates(spark, d):
    return C.marked_candidates(_blocks(spark, d))


def c2(spark, d):
    short = X.marks(spark, d).filter("type = 'heading'").withColumn("text", F.trim(F.substring_index("text", ".", 1))).withColumn("level", F.lit(2))
    return C.heading_candidates(short)


def c3(spark, d):
    rows = X.blocks(spark, d).withColumn("ord", F.col("block_id")).withColumn("text", F.when((F.col("type") == "heading") & (F.col("unit_id") % 4 == 0), F.concat(F.lit("Glossary "), "text")).otherwise(F.col("text")))
    return C.glossary_flag(rows).select("block_id", "in_glossary")


def _definitions(spark, d):
    return C.best_definitions(_candidates(spark, d))


def _terms(spark, d):
    return written(X.terms(spark, d))


def _keys(terms):
    return terms.select(T.term_key(F.col("key")).alias("key"))


def _mentions(spark, d, terms=None):
    """Of all terms in all blocks, written once: most queries read them several times."""
    return written(C.find_mentions(None, _keys(_terms(spark, d) if terms is None else terms), written(C.block_words(X.blocks(spark, d)))))


def c6(spark, d):
    m = _mentions(spark, d)
    return C.term_stats(m.select("book_id", "key", F.when(F.col("count") > 1, F.concat(F.lit("the "), "key")).otherwise(F.col("key")).alias("surface")), m)


def _stats(spark, d):
    m = _mentions(spark, d)
    stats = C.term_stats(m.select("book_id", "key", F.col("key").alias("surface")), m)
    n = F.length("key")
    return stats.withColumns({"defined": n % 2 == 0, "glossary": n % 5 == 0, "heading": n % 3 == 0, "marked": n % 2 == 1})


def c7(spark, d):
    return C.score_concepts(_stats(spark, d), cap=500).select("book_id", "key", "rank", "importance")


def c8(spark, d):
    m = _mentions(spark, d)
    surface = F.when((F.col("block_id") % 3 == 0) & F.col("key").rlike("^[a-z ]+$"), F.initcap("key")).otherwise(F.col("key"))
    cand = m.select("book_id", "key", surface.alias("surface"), (F.col("block_id") % 2 == 0).alias("heading"))
    return C.display_names(cand, m.filter(F.length("key") % 2 == 0).select("book_id", "key").distinct().withColumn("surface", F.col("key")))


def c9(spark, d):
    """What a term's definition uses is what stands in the sentence that defines it. Every block counts, however many terms it has."""
    terms = _terms(spark, d)
    keys = _keys(terms).distinct()
    used = C.terms_used(written(_definitions(spark, d).join(keys, "key", "left_semi")), keys)
    return C.cooccurrence(_mentions(spark, d, terms).select("block_id", "key"), used.select("key", "used"), per_block=None)


def _edges(spark, d, m=None, per_block=25, among=None):
    m = m or _mentions(spark, d)
    own = m if among is None else m.join(among, "key", "left_semi")
    return C.relatedness(C.cooccurrence(m.select("block_id", "key"), per_block=per_block, among=among), own)


def c10(spark, d):
    return _edges(spark, d).withColumn("w", F.round("w", 9))


def c11(spark, d):
    return C.prune_edges(_edges(spark, d).withColumn("w", F.round("w", 9)))


def c12(spark, d):
    m = _mentions(spark, d)
    part = lambda k: m.filter(F.col("block_id") % 2 == k)

    def tables(k):
        rows = part(k)
        edges = C.cooccurrence(rows.select("block_id", "key")).select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("w"))
        return {
            "concepts": rows.groupBy("key").agg(F.min("block_id").alias("ord")).select("key", F.concat(F.lit("the "), "key").alias("name"), "ord"),
            "concept_books": rows.groupBy("key", "book_id").agg(F.sum("count").alias("importance")),
            "mentions": rows.select("key", "block_id", "count"),
            "edges": edges,
        }

    out = C.merge_concepts(tables(0), tables(1))
    books = out["concept_books"].groupBy("key").agg(F.sum("importance").alias("importance"))
    ends = out["edges"].select(F.col("a").alias("key"), "w").groupBy("key").agg(F.sum("w").alias("w"))
    return out["concepts"].join(books, "key").join(ends, "key", "left").select("key", "name", "ord", "importance", "w")


def _cards(defs):
    concepts = defs.select("book_id", "key", F.col("surface").alias("name"), F.col("rank").cast("double").alias("score"))
    return C.first_cards(defs, concepts)


def c13(spark, d):
    return _cards(_definitions(spark, d)).select("book_id", "unit_id", "key", "rank", "kind", "front", "back")


def c13_concepts(spark, d):
    """The terms are all that are defined anywhere."""
    defs = written(_definitions(spark, d))
    return C.card_concepts(_cards(defs), C.terms_used(defs, defs.select("key")), defs)


QUERIES = {
    "c1_marked_candidates": lambda spark, d: _candidates(spark, d).select("block_id", "mark", "surface", "key", "bold", "defines", "sentence"),
    "c2_heading_candidates": c2,
    "c3_glossary_flag": c3,
    "c4_best_definitions": lambda spark, d: _definitions(spark, d).select("book_id", "key", "block_id", "sentence", "surface", "rank"),
    "c5_find_mentions": _mentions,
    "c6_term_stats": c6,
    "c7_score_concepts": c7,
    "c8_display_names": c8,
    "c9_cooccurrence": c9,
    "c10_relatedness": c10,
    "c11_prune_edges": c11,
    "c12_merge_concepts": c12,
    "c13_first_cards": c13,
    "c13_card_concepts": c13_concepts,
}

_SENT_AT = {
    "s_": f"SELECT block_id, unnest(s) AS x, unnest(range(len(s))) AS i FROM (SELECT block_id, {_SENT} AS s FROM prose)",
    "at_": "SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY block_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM s_",
}
_CAND = {
    "prose": "SELECT *, substr(text, s + 1, e - s) AS raw FROM marked WHERE type = 'paragraph' AND kind = 'body' AND e - s < 0.8 * length(text)",
    "named": sql_clean_term("prose", "raw", "block_id"),
    **_SENT_AT,
    "sent": "SELECT p.block_id, trim(string_agg(x, '' ORDER BY i) FILTER (WHERE pos + length(x) > p.s AND pos < p.e)) AS sentence FROM prose p JOIN at_ USING (block_id) GROUP BY p.block_id",
    "cand": f"SELECT *, f = 1 AS bold, {sql_term_key('term')} AS key, regexp_matches(sentence, '{T.DEFINES}') AS defines FROM prose JOIN named USING (block_id) JOIN sent USING (block_id) WHERE term IS NOT NULL",
    "best": "SELECT book_id, key, unnest(max_by({'block_id': block_id, 'unit_id': unit_id, 'sentence': sentence, 'surface': term, 'rank': r}, (r, -block_id))) FROM (SELECT *, 2 * CAST(defines AS INTEGER) + CAST(bold AS INTEGER) + CAST(length(sentence) BETWEEN 30 AND 320 AS INTEGER) AS r FROM cand WHERE bold OR defines) GROUP BY book_id, key",
}


def _match(words: str, p: str = "", keys: str = f"SELECT DISTINCT {sql_term_key('key')} AS key FROM terms") -> dict[str, str]:
    """Leftmost longest matching of one to five words in words (block_id, w): hits in order, each taken if it starts after the last one's end."""
    run = "SELECT block_id, i, {n} AS n, array_to_string(w[i:i + {n} - 1], ' ') AS key FROM (SELECT block_id, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM {p}tw)"
    return {
        f"{p}keys": keys,
        f"{p}tw": words,
        f"{p}runs": " UNION ALL ".join(run.format(n=n, p=p) for n in range(1, 6)),
        f"{p}hits": f"SELECT block_id, i, max(n) AS n, max_by(key, n) AS key FROM {p}runs JOIN {p}keys USING (key) GROUP BY block_id, i",
        f"{p}hl": f"SELECT block_id, list({{'i': i, 'n': n, 'key': key}} ORDER BY i) AS h FROM {p}hits GROUP BY block_id",
        f"{p}took": f"SELECT block_id, unnest(list_reduce(h, lambda a, x: CASE WHEN x.i >= a.stop THEN {{'stop': x.i + x.n, 'keys': list_append(a.keys, x.key)}} ELSE a END, {{'stop': CAST(0 AS BIGINT), 'keys': CAST([] AS VARCHAR[])}}).keys) AS key FROM {p}hl",
    }


_MENT = {
    **_match(f"SELECT block_id, unit_id, book_id, {sql_term_words('text')} AS w FROM blocks WHERE type <> 'code'"),
    "ment": "SELECT key, block_id, unit_id, book_id, count(*) AS count FROM took JOIN tw USING (block_id) GROUP BY ALL",
}
#: What the defining sentences use, of the terms or of all that is defined.
_SAID = f"SELECT book_id || chr(1) || key AS block_id, book_id, key AS own, {sql_term_words('sentence')} AS w FROM best"
_USED = "SELECT DISTINCT book_id, own AS key, d_took.key AS used FROM d_took JOIN d_tw USING (block_id) WHERE own <> d_took.key"
_REL = {
    **_MENT,
    "mb": "SELECT block_id FROM ment GROUP BY block_id HAVING count(*) <= 25",
    "cp": "SELECT x.key AS a, y.key AS b, count(*) AS n FROM ment x JOIN ment y ON x.block_id = y.block_id AND x.key < y.key WHERE x.block_id IN (SELECT block_id FROM mb) GROUP BY ALL",
    "ff": "SELECT key, count(DISTINCT block_id) AS f FROM ment GROUP BY key",
    "ed": "SELECT a, b, round(n / sqrt(x.f * y.f) * least(1.0, log2(1 + n) / 3), 9) AS w FROM cp JOIN ff x ON a = x.key JOIN ff y ON b = y.key WHERE n >= 2",
}
#: The same over every block, however many terms it has.
_WHOLE = {k: v.replace(" WHERE x.block_id IN (SELECT block_id FROM mb)", "") for k, v in _REL.items() if k != "mb"}
_STAT = {**_MENT, "st": "SELECT book_id, key, count(*) AS announced, CAST(sum(count) AS BIGINT) AS total, count(DISTINCT unit_id) AS units FROM ment GROUP BY ALL"}

ORACLE = {
    "c1_marked_candidates": sql("SELECT block_id, 0 AS mark, term AS surface, key, bold, defines, sentence FROM cand WHERE bold OR defines", "marked", more={k: v for k, v in _CAND.items() if k != "best"}),
    "c2_heading_candidates": sql(
        f"SELECT book_id, unit_id, block_id, term AS surface, {sql_term_key('term')} AS key FROM h JOIN n USING (block_id) WHERE term IS NOT NULL",
        "blocks",
        "units",
        more={
            "h": f"SELECT b.book_id, unit_id, block_id, trim(split_part(text, '.', 1)) AS raw FROM blocks b JOIN units u USING (unit_id) WHERE type = 'heading' AND kind IN ('body', 'exercises') AND NOT regexp_matches(trim(split_part(text, '.', 1)), '{T.GENERIC_HEADINGS.replace(chr(39), chr(39) * 2)}')",
            "n": sql_clean_term("h", "raw", "block_id"),
        },
    ),
    "c3_glossary_flag": sql("SELECT block_id, type <> 'heading' AND (unit_id % 4 = 0 OR regexp_matches(first, '(?i)^(glossary|key terms|vocabulary|definitions)\\b')) AS in_glossary FROM blocks JOIN (SELECT unit_id, title AS first FROM units) USING (unit_id)", "blocks", "units"),
    "c4_best_definitions": sql("SELECT book_id, key, block_id, sentence, surface, rank FROM best", "marked", more=_CAND),
    "c5_find_mentions": sql("SELECT * FROM ment", "blocks", "terms", more=_MENT),
    "c6_term_stats": sql(
        "SELECT book_id, key, CAST(sum(n) AS BIGINT) AS announced, max_by(surface, (n, surface)) AS form, any_value(total) AS total, any_value(units) AS units FROM (SELECT book_id, key, CASE WHEN count > 1 THEN 'the ' || key ELSE key END AS surface, count(*) AS n FROM ment GROUP BY ALL) JOIN (SELECT book_id, key, total, units FROM st) USING (book_id, key) GROUP BY book_id, key",
        "blocks",
        "terms",
        more=_STAT,
    ),
    "c7_score_concepts": sql(
        """SELECT book_id, key, CAST(rank AS INTEGER) AS rank, round(score / top, 3) AS importance FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY score DESC, key) AS rank, max(score) OVER (PARTITION BY book_id) AS top
 FROM (SELECT *, round(2 * CAST(len % 2 = 0 AS INTEGER) + CAST(len % 5 = 0 AS INTEGER) + 1.5 * CAST(len % 3 = 0 AS INTEGER) + log2(1 + total) + log2(1 + units) + CAST(0.3 AS DOUBLE) * least(announced, 3), 9) AS score FROM (SELECT *, length(key) AS len FROM st))
 WHERE total >= 1 AND ((len % 2 = 0 AND (total >= 2 OR len % 5 = 0)) OR (len % 3 = 0 AND total >= 2 AND (contains(key, ' ') OR len % 2 = 1)))) WHERE rank <= 500""",
        "blocks",
        "terms",
        more=_STAT,
    ),
    "c8_display_names": sql(
        """SELECT book_id, key, CASE WHEN regexp_matches(name, '^\\p{Lu}\\p{Ll}') AND substr(name, 2) = lower(substr(name, 2)) AND (list_contains(forms, lower(name)) OR NOT heading OR len(forms) > 1) THEN lower(substr(name, 1, 1)) || substr(name, 2) ELSE name END AS name
 FROM (SELECT *, CASE WHEN only_ AND contains(form, ' ') THEN array_to_string(list_transform(string_split(form, ' '), lambda w: CASE WHEN regexp_matches(w, '^\\p{Lu}\\p{Ll}+$') THEN lower(w) ELSE w END), ' ') ELSE form END AS name
  FROM (SELECT book_id, key, CASE WHEN defining THEN key ELSE form END AS form, forms, heading, only_ FROM
   (SELECT book_id, key, max_by(surface, (n, surface)) AS form, list(surface) AS forms FROM (SELECT book_id, key, surface, count(*) AS n FROM sf GROUP BY ALL) GROUP BY ALL)
   JOIN (SELECT book_id, key, bool_or(h) AS heading, bool_and(h) AS only_, max(length(key)) % 2 = 0 AS defining FROM sf GROUP BY ALL) USING (book_id, key)))""",
        "blocks",
        "terms",
        more={**_MENT, "sf": "SELECT book_id, key, block_id % 2 = 0 AS h, CASE WHEN block_id % 3 = 0 AND regexp_matches(key, '^[a-z ]+$') THEN array_to_string(list_transform(string_split(key, ' '), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), ' ') ELSE key END AS surface FROM ment"},
    ),
    "c9_cooccurrence": sql(
        "SELECT a, b, CAST(sum(n) AS BIGINT) AS n FROM (SELECT a, b, n FROM cp UNION ALL SELECT least(key, used), greatest(key, used), 2 FROM us) GROUP BY ALL",
        "terms",
        "marked",
        more={**{k: v for k, v in _WHOLE.items() if k not in ("ff", "ed")}, **_CAND, **_match(_SAID + " WHERE key IN (SELECT key FROM keys)", "d_", "SELECT key FROM keys"), "us": _USED},
    ),
    "c10_relatedness": sql("SELECT a, b, w FROM ed", "blocks", "terms", more=_REL),
    "c11_prune_edges": sql(
        "SELECT DISTINCT a, b, round(w / (SELECT max(w) FROM ed), 3) AS w FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY w DESC, a, b) AS r FROM (SELECT a AS e, * FROM ed UNION ALL SELECT b, * FROM ed)) WHERE r <= 8 AND w >= 0.05 * (SELECT max(w) FROM ed)",
        "blocks",
        "terms",
        more=_REL,
    ),
    "c12_merge_concepts": sql(
        "SELECT key, 'the ' || key AS name, ord, importance, w FROM (SELECT key, min(block_id) AS ord FROM ment GROUP BY key) JOIN (SELECT key, CAST(sum(m) AS BIGINT) AS importance FROM (SELECT key, book_id, max(s) AS m FROM (SELECT key, book_id, block_id % 2, sum(count) AS s FROM ment GROUP BY ALL) GROUP BY ALL) GROUP BY ALL) USING (key) LEFT JOIN (SELECT a AS key, CAST(sum(m) AS BIGINT) AS w FROM (SELECT a, b, max(n) AS m FROM (SELECT x.key AS a, y.key AS b, x.block_id % 2, count(*) AS n FROM ment x JOIN ment y ON x.block_id = y.block_id AND x.key < y.key WHERE x.block_id IN (SELECT block_id FROM mb) GROUP BY ALL) GROUP BY ALL) GROUP BY ALL) USING (key)",
        "blocks",
        "terms",
        more={**_MENT, "mb": _REL["mb"]},
    ),
    "c13_first_cards": sql(
        """SELECT book_id, unit_id, key, CAST(r AS INTEGER) AS rank, 'cloze' AS kind, front, '' AS back FROM (SELECT *, substr(short, 1, instr(short, surface) - 1) || '{{c1::' || surface || '}}' || substr(short, instr(short, surface) + length(surface)) AS front, row_number() OVER (PARTITION BY book_id, unit_id ORDER BY rank DESC, key) AS r
 FROM (SELECT *, CASE WHEN length(sentence) > 360 THEN trim(substr(sentence, CAST(greatest(1, instr(sentence, surface) - 165) AS BIGINT), 330)) ELSE sentence END AS short FROM best) WHERE length(sentence) >= 30 AND instr(short, surface) > 0) WHERE r <= 15""",
        "marked",
        more=_CAND,
    ),
    "c13_card_concepts": sql(
        """SELECT DISTINCT * FROM (SELECT book_id, unit_id, key AS card, key FROM fc UNION ALL SELECT book_id, unit_id, fc.key, used FROM fc JOIN us USING (book_id, key) WHERE (book_id, used) IN (SELECT (book_id, key) FROM best))""",
        "marked",
        more={
            **_CAND,
            **_match(_SAID, "d_", "SELECT DISTINCT key FROM best"),
            "us": _USED,
            "fc": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id, unit_id ORDER BY rank DESC, key) AS r FROM (SELECT *, CASE WHEN length(sentence) > 360 THEN trim(substr(sentence, CAST(greatest(1, instr(sentence, surface) - 165) AS BIGINT), 330)) ELSE sentence END AS short FROM best) WHERE length(sentence) >= 30 AND instr(short, surface) > 0) WHERE r <= 15",
        },
    ),
}
