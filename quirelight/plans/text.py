"""Queries of the text expressions, over the lines of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import fixtures
from ..sources.fixtures import sql


def _blocks(expression):
    """A query of expression(text column) over all blocks; columns need a session, so they are made when it runs."""
    return lambda spark, d: fixtures.blocks(spark, d).select("block_id", expression(F.col("text")).alias("value"))


def _sql(expression: str, more: dict | None = None, source: str = "blocks") -> str:
    return sql(f"SELECT block_id, {expression} AS value FROM {source}", "blocks", more=more)


_WORDS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}]+')"
_SINGULAR = (
    "CASE WHEN length({0}) <= 3 OR regexp_matches({0}, '(ss|us|is|os|as|ics)$') THEN {0} WHEN {0} LIKE '%ies' THEN regexp_replace({0}, 'ies$', 'y') "
    "WHEN regexp_matches({0}, '(sh|ch|x|z)es$') THEN regexp_replace({0}, 'es$', '') ELSE regexp_replace({0}, 's$', '') END"
)


def sql_term_words(column: str) -> str:
    words = _WORDS.format(r"regexp_replace(lower(strip_accents(" + column + r")), '[''’]s\b', '', 'g')")
    return f"list_transform({words}, lambda x: {_SINGULAR.format('x')})"


def sql_term_key(column: str) -> str:
    return f"array_to_string({sql_term_words(column)}, ' ')"


def _quoted(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_clean_term(source: str, raw: str, keys: str) -> str:
    """Rows of source with term: raw as a term's name or null."""
    strip = "regexp_replace(regexp_replace(" + raw + r""", '^[\s"“‘''(\[.,;:!?—–-]+|[\s"”’''):;,.\]!?—–-]+$', '', 'g'), '\s+', ' ', 'g')"""
    return (
        f"SELECT {keys}, CASE WHEN length(t) BETWEEN 2 AND 60 AND length(t) - length(replace(t, ' ', '')) < 5 AND regexp_matches(t, '\\p{{L}}{{2}}') AND len(w) > 0 "
        f"AND NOT list_contains({_quoted(X.LABELS)}, w[1]) AND NOT list_contains({_quoted(X.STOP)}, w[1]) AND NOT list_contains({_quoted(X.STOP)}, w[-1]) "
        f"AND len(list_filter(w, lambda x: list_contains({_quoted(X.STOP)}, x))) <= 1 AND NOT regexp_matches(t, '^\\d|[=<>{{}}\\[\\]|\\\\]') THEN t END AS term "
        f"FROM (SELECT *, {sql_term_words('t')} AS w FROM (SELECT *, trim({strip}) AS t FROM {source}))"
    )


_SENT = r"""string_split(translate(regexp_replace(regexp_replace(text, '\b(e\.g|i\.e|etc|vs|cf|Fig|Eq|resp|al|[A-Z])\. ', '\1' || chr(2) || ' ', 'g'), '([.!?]["”’)\]]*\s+)(["“(]?[A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(2), '.'), chr(1))"""
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{k}'" for k, p in X.SECTION_KINDS) + " ELSE 'body' END"
_NUM = X.NUMBERING


def sql_title_tokens(column: str) -> str:
    """The words of a title without up to three words of numbering."""
    words = _WORDS.format(r"lower(strip_accents(translate(" + column + r", '^_{}$\', '')))")
    plain = "".join(f"WHEN NOT coalesce(regexp_matches(w[{k}], '{_NUM}'), false) THEN {k} " for k in (1, 2, 3))
    return f"list_transform([{words}], lambda w: w[CASE {plain}ELSE 4 END:])[1]"


def t5(spark, d):
    """Every run of three words (all words, if there are fewer) as if it were marked."""
    w = F.split(F.col("text"), " ")
    runs = F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - 2)), lambda i: F.array_join(F.slice(w, i, 3), " "))).alias("place", "raw")
    return fixtures.blocks(spark, d).select("block_id", runs).select("block_id", "place", X.clean_term(F.col("raw")).alias("term"))


def t9(spark, d):
    first = F.substring_index(F.col("text"), ".", 1)
    return fixtures.blocks(spark, d).select("block_id", F.round(X.dice(X.tokens(F.col("text")), X.tokens(first)), 9).alias("value"))


def t12(spark, d):
    folded = X.fold_text(F.col("text"))
    return fixtures.blocks(spark, d).select("block_id", folded.alias("x")).select("block_id", F.col("x.folded").alias("folded"), F.aggregate("x.map", F.lit(0), lambda a, x: a + x).cast("long").alias("map_sum"))


def t15(spark, d):
    """The middle third of each line as its quote."""
    n = F.floor(F.length("text") / 3).cast("int")
    quote = F.substring(F.col("text"), n + 1, n)
    return fixtures.blocks(spark, d).filter(F.length("text") >= 3).select("block_id", X.cloze_from_quote(F.col("text"), quote).alias("c")).select("block_id", "c.kind", "c.front", "c.back")


def t19(spark, d):
    reply = F.concat(F.lit("Here it is:\n```json\n"), F.to_json(F.struct(F.col("title"), F.col("ord").alias("n"))), F.lit("\n```\nDone."))
    return fixtures.units(spark, d).select("unit_id", X.parse_reply(reply, "title string, n long").alias("r")).select("unit_id", "r.title", "r.n")


QUERIES = {
    "t1_term_words": _blocks(lambda t: F.array_join(X.term_words(t), "|")),
    "t2_singular": _blocks(lambda t: F.array_join(F.transform(X.tokens(t), X.singular), "|")),
    "t3_term_key": _blocks(lambda t: X.term_key(t)),
    "t4_sentence_at": _blocks(lambda t: X.sentence_at(t, F.lit(40), F.lit(60))),
    "t5_clean_term": t5,
    "t6_patterns": lambda spark, d: fixtures.blocks(spark, d).select("block_id", X.is_defining(F.col("text")).alias("defining"), X.is_generic_heading(F.col("text")).alias("generic")),
    "t7_section_kind": _blocks(lambda t: X.section_kind(t)),
    "t8_title_tokens": _blocks(lambda t: F.array_join(X.title_tokens(t), "|")),
    "t9_dice": t9,
    "t10_norm_key": _blocks(lambda t: X.norm_key(t)),
    "t11_clean_text": lambda spark, d: fixtures.table(spark, d, "documents").select("doc_id", X.clean_text(F.col("text")).alias("value")),
    "t12_fold_text": t12,
    "t13_squash": _blocks(lambda t: X.squash(t)),
    "t15_cloze_from_quote": t15,
    "t17_clean_glyphs": _blocks(lambda t: X.clean_glyphs(t)),
    "t18_search_terms": _blocks(lambda t: F.array_join(X.search_terms(t), "|")),
    "t19_parse_reply": t19,
}

ORACLE = {
    "t1_term_words": _sql(f"array_to_string({sql_term_words('text')}, '|')"),
    "t2_singular": _sql(f"array_to_string(list_transform({_WORDS.format('lower(strip_accents(text))')}, lambda x: {_SINGULAR.format('x')}), '|')"),
    "t3_term_key": _sql(sql_term_key("text")),
    "t4_sentence_at": sql(
        "SELECT b.block_id, trim(coalesce(string_agg(s, '' ORDER BY i) FILTER (WHERE pos + length(s) > 40 AND pos < 60), '')) AS value FROM blocks b LEFT JOIN at_ USING (block_id) GROUP BY b.block_id",
        "blocks",
        more={
            "s_": f"SELECT block_id, unnest(s) AS s, unnest(range(len(s))) AS i FROM (SELECT block_id, {_SENT} AS s FROM blocks)",
            "at_": "SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY block_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM s_",
        },
    ),
    "t5_clean_term": sql("SELECT * FROM term_", "blocks", more={"raw_": "SELECT block_id, CAST(i - 1 AS INTEGER) AS place, array_to_string(w[i:i + 2], ' ') AS raw FROM (SELECT block_id, w, unnest(range(1, greatest(2, CAST(len(w) AS BIGINT)))) AS i FROM (SELECT block_id, string_split(text, ' ') AS w FROM blocks)) WHERE i <= greatest(1, len(w) - 2)", "term_": sql_clean_term("raw_", "raw", "block_id, place")}),
    "t6_patterns": sql(f"SELECT block_id, regexp_matches(text, '{X.DEFINES}') AS defining, regexp_matches(text, '{X.GENERIC_HEADINGS.replace(chr(39), chr(39) * 2)}') AS generic FROM blocks", "blocks"),
    "t7_section_kind": sql(f"SELECT block_id, {_KIND} AS value FROM (SELECT block_id, trim(regexp_replace(lower(text), '^[\\d.\\s]+', '')) AS t FROM blocks)", "blocks"),
    "t8_title_tokens": sql("SELECT block_id, array_to_string(" + sql_title_tokens("text") + ", '|') AS value FROM blocks", "blocks"),
    "t9_dice": sql(
        "SELECT b.block_id, round(CASE WHEN na = 0 OR nb = 0 THEN 0.0 ELSE 2.0 * coalesce(c, 0) / (na + nb) END, 9) AS value FROM ab b LEFT JOIN common USING (block_id)",
        "blocks",
        more={
            "w_": f"SELECT block_id, {_WORDS.format('lower(strip_accents(text))')} AS a, {_WORDS.format('lower(strip_accents(split_part(text, chr(46), 1)))')} AS b FROM blocks",
            "ab": "SELECT block_id, len(a) AS na, len(b) AS nb FROM w_",
            "common": "SELECT block_id, sum(least(x.n, y.n)) AS c FROM (SELECT block_id, w, count(*) AS n FROM (SELECT block_id, unnest(a) AS w FROM w_) GROUP BY ALL) x JOIN (SELECT block_id, w, count(*) AS n FROM (SELECT block_id, unnest(b) AS w FROM w_) GROUP BY ALL) y USING (block_id, w) GROUP BY block_id",
        },
    ),
    "t10_norm_key": _sql(r"trim(regexp_replace(regexp_replace(lower(text), '\d+', '#', 'g'), '\s+', ' ', 'g'))"),
    "t11_clean_text": r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '(\p{L})[-‐]\n(\p{Ll})', '\1\2', 'g'), '\n', ' ', 'g'), '[ \t]+', ' ', 'g')) AS value FROM documents",
    "t12_fold_text": sql(
        "SELECT b.block_id, coalesce(string_agg(c, '' ORDER BY i) FILTER (WHERE keep), '') AS folded, CAST(coalesce(sum(i) FILTER (WHERE keep), 0) AS BIGINT) AS map_sum FROM blocks b LEFT JOIN kept USING (block_id) GROUP BY b.block_id",
        "blocks",
        more={
            "chars": "SELECT block_id, unnest(range(length(t))) AS i, t FROM (SELECT block_id, text AS t FROM blocks)",
            "kept": r"SELECT block_id, i, lower(substr(t, i + 1, 1)) AS c, NOT regexp_matches(substr(t, i + 1, 1), '^\s$') AND NOT (substr(t, i + 1, 1) IN ('-', '‐', chr(173)) AND substr(t, i + 2, 1) = chr(10)) AS keep FROM chars",
        },
    ),
    "t13_squash": _sql(r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"),
    "t15_cloze_from_quote": sql(
        r"""SELECT block_id, CASE WHEN good THEN 'cloze' ELSE 'basic' END AS kind, CASE WHEN good THEN trim(regexp_replace(before, '(?s)^.*[.?!] ', '') || '{{c1::' || q || '}}' ||
 CASE WHEN regexp_matches(after, '[.?!] ') THEN regexp_extract(after, '(?s)^(.*?[.?!]) ', 1) ELSE after END) ELSE '' END AS front, CASE WHEN good THEN '' ELSE q END AS back
 FROM (SELECT *, length(q) < 160 AND pos > 0 AS good, substr(text, 1, pos - 1) AS before, substr(text, pos + length(q)) AS after FROM (SELECT *, instr(text, q) AS pos FROM (SELECT *, substr(text, length(text) // 3 + 1, length(text) // 3) AS q FROM blocks WHERE length(text) >= 3)))""",
        "blocks",
    ),
    "t17_clean_glyphs": _sql("replace(replace(text, chr(160), ' '), chr(173), '')"),
    "t18_search_terms": _sql(f"array_to_string(({_WORDS.format('text')})[1:8], '|')"),
    "t19_parse_reply": sql("SELECT unit_id, title, ord AS n FROM units", "units"),
}
