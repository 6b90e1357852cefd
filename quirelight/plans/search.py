"""Queries of full-text search and of annotations: each document is a book of pages of forty lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import annotations as N
from ..operators import search as Q
from ..operators.layout import page_text as page_layer
from ..sources import fixtures as X
from ..sources.fixtures import sql
from ..sources.shared import written


def _queries(spark, d):
    """The first three words of each benchmark item, the last cut to three letters."""
    w = tokens(F.col("text"))
    b = X.table(spark, d, "benchmark").select("item_id", F.slice(w, 1, 3).alias("w")).filter("size(w) = 3")
    return b.select(F.col("item_id").alias("query_id"), F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1)), F.substring(F.get("w", F.lit(2)), 1, 3)).alias("query"))


def _postings(spark, d):
    return written(Q.term_counts(X.blocks(spark, d)))


def q1(spark, d):
    return Q.build_postings(X.blocks(spark, d)).select("term", "block_id", "tf", F.array_join("positions", ",").alias("positions"))


def q2(spark, d):
    """Every third query asks one book; each document is a unit of as many sections as it has pages of forty lines, every seventh of them an
    index."""
    book = F.when(F.col("query_id") % 3 == 0, F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")))
    section = F.col("unit_id") * 1000 + F.floor(F.col("n") / 40)
    blocks = X.blocks(spark, d).withColumn("section_id", section)
    sections = blocks.select("section_id").distinct().withColumn("kind", F.when(F.col("section_id") % 7 == 3, "index").otherwise("body"))
    return Q.search(_queries(spark, d).withColumn("book_id", book), _postings(spark, d), blocks, X.units(spark, d), sections)


def q4(spark, d):
    hits = q2(spark, d).filter("rank <= 5").join(X.blocks(spark, d).select("block_id", "text"), "block_id").join(_queries(spark, d), "query_id")
    return hits.select("query_id", "block_id", Q.snippet(F.col("text"), F.split("query", " ")).alias("snippet"))


def page_lines(spark, d):
    n = F.col("n")
    rows = X.blocks(spark, d).select(F.col("unit_id").alias("book_id"), F.floor(n / 40).cast("int").alias("page"), (n % 40).cast("int").alias("line"), "text")
    w = Window.partitionBy("book_id", "page").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("int")
    return rows.select("*", start.alias("start"), F.lit(50.0).alias("x0"), (100.0 + 12 * F.col("line")).alias("y0"), (50.0 + 5 * F.length("text")).alias("x1"), (110.0 + 12 * F.col("line")).alias("y1"), F.lit(5.0).alias("step"))


def page_text(spark, d):
    return page_layer(page_lines(spark, d).withColumnRenamed("line", "ord")).select("book_id", "page", "text")


def l28(spark, d):
    layer = page_layer(page_lines(spark, d).withColumnRenamed("line", "ord"))
    starts = F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["ord"], x["start"])), " ")
    return layer.select("book_id", "page", F.sha2("text", 256).alias("sha"), F.length("text").alias("n"), starts.alias("starts"))


def _ranges(spark, d):
    x = F.col("book_id") * 37 % 200
    return page_text(spark, d).filter(F.length("text") > 300).select((F.col("book_id") * 1000 + F.col("page")).alias("range_id"), "book_id", "page", x.cast("int").alias("start"), (x + 90).cast("int").alias("end"))


def _boxes(spark, d):
    rows = page_lines(spark, d).withColumn("g", F.floor(F.col("line") / 3))
    return rows.groupBy("book_id", "page", "g").agg(F.min("x0").alias("bx0"), F.min("y0").alias("by0"), F.max("x1").alias("bx1"), F.max("y1").alias("by1")).withColumn("block_id", F.col("book_id") * 1000 + F.col("page") * 100 + F.col("g"))


def n2(spark, d):
    h = _highlights(spark, d)
    return N.list_highlights(h, X.units(spark, d), color="yellow", with_notes=True).select("id", "unit", "place")


def _highlights(spark, d):
    note = F.when(F.col("block_id") % 3 == 0, "look up").otherwise(" ")
    color = F.when(F.col("block_id") % 2 == 0, "yellow").otherwise("blue")
    return X.blocks(spark, d).filter("type = 'paragraph'").select("book_id", "unit_id", F.col("page"), F.col("n").alias("start"), F.col("block_id").alias("id"), F.col("text").alias("quote"), note.alias("note"), color.alias("color"))


def _changes(spark, d):
    text = F.when(F.col("review_id") % 5 == 0, " ").otherwise(F.concat(F.lit("v"), "review_id", F.lit("\r\nend")))
    return X.reviews(spark, d).select((F.col("learner_id") % 10).alias("book_id"), F.col("card_id").alias("page"), F.col("rating").alias("start"), (F.col("rating") + 1).alias("end"), text.alias("text"), F.col("review").alias("changed"), F.col("review_id").alias("change_id"))


def n4(spark, d):
    v = N.latest_versions(_changes(spark, d)).select("book_id", F.col("page").cast("int").alias("page"), "start", "end", "text")
    h = _highlights(spark, d).withColumn("book_id", F.col("unit_id"))
    chats = X.table(spark, d, "conversations").select((F.col("conv_id") % 50).alias("book_id"), F.lit(0).alias("page"), F.col("conv_id").alias("chat_id"), F.length("text").alias("start"), F.col("turn").alias("id"))
    read = X.page_reads(spark, d).select(F.col("unit_id").alias("book_id"), "page").distinct()
    return N.annotations(h, v, chats, read).groupBy("book_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("start"))


def n5(spark, d):
    item = X.table(spark, d, "benchmark").select("item_id", F.substring("text", 1, 60).alias("quote"))
    home = page_text(spark, d).select("book_id", "page", F.substring("text", 20, 45).alias("own"))
    q = home.filter("length(own) = 45").select((F.col("book_id") * 1000 + F.col("page")).alias("quote_id"), "book_id", F.greatest(F.lit(0), F.col("page") - 1).alias("page"), F.lit(10).alias("hint"), F.translate(F.translate("own", "\n", " "), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("quote"))
    also = item.select((-F.col("item_id") - 1).alias("quote_id"), F.col("item_id").alias("book_id"), F.lit(0).alias("page"), F.lit(0).alias("hint"), "quote")
    return N.place_quotes(q.union(also), page_text(spark, d))


def n6(spark, d):
    """The first three letters and the third and fourth word together of each title, on the pages of its document."""
    pair = F.concat_ws(" ", F.slice(F.split("title", " "), 3, 2))
    q = X.units(spark, d).select(F.col("unit_id").alias("query_id"), F.col("unit_id").alias("book_id"), F.array(F.substring("title", 1, 3), pair).alias("words"))
    return N.find_all(q, page_text(spark, d))


def n8(spark, d):
    r = page_text(spark, d).select((F.col("book_id") * 1000 + F.col("page")).alias("rect_id"), "book_id", "page", F.lit(83.0).alias("rx0"), F.lit(110.0).alias("ry0"), F.lit(191.0).alias("rx1"), F.lit(160.0).alias("ry1"))
    return N.range_in_rect(r, page_lines(spark, d))


def n13(spark, d):
    s = X.units(spark, d).select(F.col("unit_id").alias("selection_id"), F.col("unit_id").alias("book_id"), F.lit(0).alias("page0"), F.lit(40).alias("start"), F.lit(1).alias("page1"), F.lit(120).alias("end"), F.lit("why").alias("note"))
    return N.split_selection(s, page_text(spark, d))


QUERIES = {
    "q1_build_postings": q1,
    "q2_search": q2,
    "q3_bm25": lambda spark, d: Q.rank(_queries(spark, d), _postings(spark, d)).withColumn("score", F.round("score", 6)),
    "q4_snippet": q4,
    "n1_anchor": lambda spark, d: N.anchor(_ranges(spark, d), page_lines(spark, d), _boxes(spark, d)),
    "n2_list_highlights": n2,
    "n3_latest_versions": lambda spark, d: N.latest_versions(_changes(spark, d)),
    "n4_annotations": n4,
    "n5_place_quotes": n5,
    "n6_find_all": n6,
    "n7_range_rects": lambda spark, d: N.range_rects(_ranges(spark, d), page_lines(spark, d)),
    "n7_range_box": lambda spark, d: N.range_box(_ranges(spark, d), page_lines(spark, d)),
    "n8_range_in_rect": n8,
    "n13_split_selection": n13,
    "l28_page_text": l28,
}

_TOK = r"regexp_extract_all(lower(strip_accents({})), '[\p{{L}}\p{{N}}]+')"
_SEARCH = {
    "tk": f"SELECT block_id, w[i] AS term, i - 1 AS pos FROM (SELECT block_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT block_id, {_TOK.format('text')} AS w FROM blocks))",
    "po": "SELECT term, block_id, count(*) AS tf, string_agg(pos, ',' ORDER BY pos) AS positions FROM tk GROUP BY ALL",
    "qs": f"SELECT item_id AS query_id, w FROM (SELECT item_id, w[1:3] AS w FROM (SELECT item_id, {_TOK.format('text')} AS w FROM benchmark)) WHERE len(w) = 3",
    "qw": "SELECT query_id, 0 AS no, w[1] AS word FROM qs UNION ALL SELECT query_id, 1, w[2] FROM qs",
    "hi": "SELECT query_id, no, block_id, tf FROM qw JOIN po ON word = term UNION ALL SELECT query_id, 2, block_id, sum(tf) FROM qs JOIN po ON starts_with(term, substr(w[3], 1, 3)) GROUP BY ALL",
    "le": "SELECT block_id, sum(tf) AS len FROM po GROUP BY 1",
    "al": "SELECT count(*) AS n, avg(len) AS mean FROM le",
    "df": "SELECT query_id, no, count(*) AS df FROM hi GROUP BY ALL",
    "rk": "SELECT query_id, block_id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + CAST(1.2 AS DOUBLE) * (0.25 + 0.75 * len / mean))), 6) AS score FROM hi JOIN df USING (query_id, no) JOIN le USING (block_id), al GROUP BY ALL HAVING count(*) = 3",
    "se": "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, block_id) AS INTEGER) AS rank, block_id, unit_id, score FROM rk JOIN blocks USING (block_id) JOIN units USING (unit_id) WHERE kind NOT IN ('contents', 'index') AND (unit_id * 1000 + n // 40) % 7 <> 3 AND (query_id % 3 <> 0 OR blocks.book_id = 'src' || query_id % 20) QUALIFY rank <= 60",
}
_PAGES = {
    "pl": "SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY book_id, page ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start, 50.0 AS x0, 100.0 + 12 * line AS y0, 50.0 + 5 * length(text) AS x1, 110.0 + 12 * line AS y1 FROM (SELECT unit_id AS book_id, CAST(n // 40 AS INTEGER) AS page, CAST(n % 40 AS INTEGER) AS line, text FROM blocks)",
    "pt": "SELECT book_id, page, string_agg(text, chr(10) ORDER BY line) AS text FROM pl GROUP BY ALL",
    "rg": "SELECT book_id * 1000 + page AS range_id, book_id, page, CAST(book_id * 37 % 200 AS INTEGER) AS a, CAST(book_id * 37 % 200 + 90 AS INTEGER) AS b FROM pt WHERE length(text) > 300",
    "rr": "SELECT range_id, line, CAST(x0 + greatest(0, a - start) * 5.0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x0 + least(length(text), b - start) * 5.0 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM rg JOIN pl USING (book_id, page) WHERE start < b AND start + length(text) > a",
}
_FOLD = r"SELECT {k}, string_agg(lower(c), '' ORDER BY i) AS folded, list(i ORDER BY i) AS map FROM (SELECT {k}, i, substr(t, i + 1, 1) AS c, substr(t, i + 2, 1) AS nx FROM (SELECT {k}, t, unnest(range(length(t))) AS i FROM {f})) WHERE NOT regexp_matches(c, '^\s$') AND NOT (c IN ('-', '‐', chr(173)) AND nx = chr(10)) GROUP BY {k}"

ORACLE = {
    "q1_build_postings": sql("SELECT * FROM po", "blocks", more={k: _SEARCH[k] for k in ("tk", "po")}),
    "q2_search": sql("SELECT * FROM se", "blocks", "units", more=_SEARCH),
    "q3_bm25": sql("SELECT * FROM rk", "blocks", "units", more=_SEARCH),
    "q4_snippet": sql(
        """SELECT query_id, block_id, CASE WHEN st > 0 THEN '…' ELSE sep[1] END || array_to_string(list_transform(range(st, least(n, st + 14)), lambda i: CASE WHEN i > st THEN sep[i + 1] ELSE '' END || CASE WHEN list_contains(hits, i) THEN chr(1) || tok[i + 1] || chr(2) ELSE tok[i + 1] END), '')
  || CASE WHEN st + 14 >= n THEN sep[n + 1] ELSE '…' END AS snippet FROM best JOIN tq USING (query_id, block_id) JOIN (SELECT query_id, block_id, list(DISTINCT i) AS hits FROM ins GROUP BY ALL) USING (query_id, block_id)""",
        "blocks",
        "units",
        more={
            **_SEARCH,
            "tq": r"""SELECT *, len(tok) AS n, list_transform(tok, lambda t: lower(strip_accents(t))) AS w FROM (SELECT query_id, block_id, regexp_extract_all(text, '[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\p{M}]*') AS tok, regexp_split_to_array(text, '[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\p{M}]*') AS sep,
 [qs.w[1], qs.w[2], substr(qs.w[3], 1, 3)] AS q FROM se JOIN (SELECT block_id, text FROM blocks) USING (block_id) JOIN qs USING (query_id) WHERE rank <= 5)""",
            "ins": "SELECT query_id, block_id, i, p FROM (SELECT query_id, block_id, q, w, n, unnest(range(n)) AS i FROM tq), (SELECT unnest([0, 1, 2]) AS p) WHERE CASE p WHEN 2 THEN starts_with(w[i + 1], q[3]) ELSE w[i + 1] = q[p + 1] END",
            "sen": r"SELECT query_id, block_id, i FROM (SELECT query_id, block_id, sep, n, unnest(range(n)) AS i FROM tq) WHERE i = 0 OR regexp_matches(sep[i + 1], '[.:][ \t\n\r]+$')",
            "win": "SELECT query_id, block_id, i AS h, i AS st, 0 AS sentence FROM (SELECT DISTINCT query_id, block_id, i FROM ins) UNION ALL SELECT x.query_id, x.block_id, x.i, max(s.i), 1 FROM (SELECT DISTINCT query_id, block_id, i FROM ins) x JOIN sen s ON s.query_id = x.query_id AND s.block_id = x.block_id AND s.i <= x.i GROUP BY ALL HAVING max(s.i) < x.i",
            "sco": "SELECT v.query_id, v.block_id, h, st, sentence, count(DISTINCT p) * 999 + count(p) + CASE WHEN sentence = 0 THEN 0 WHEN st = 0 THEN 120 ELSE 100 END AS score, max(x.i) AS z FROM win v LEFT JOIN ins x ON x.query_id = v.query_id AND x.block_id = v.block_id AND x.i >= st AND x.i < st + 14 GROUP BY v.query_id, v.block_id, h, st, sentence",
            "best": "SELECT query_id, block_id, max_by(CASE WHEN sentence = 1 THEN st ELSE greatest(0, least(h - (14 - (z + 1 - h)) // 2, n - 14)) END, (score, -h, -sentence)) AS st FROM sco JOIN tq USING (query_id, block_id) WHERE sentence = 0 OR n > 14 GROUP BY ALL",
        },
    ),
    "n1_anchor": sql(
        "SELECT range_id, min_by(block_id, (d, block_id)) AS block_id FROM (SELECT range_id, block_id, greatest(0, bx0 - x, x - bx1) + greatest(0, by0 - y, y - by1) AS d FROM (SELECT range_id, min_by(x0, line) AS x, min_by(y0, line) AS y FROM rr GROUP BY 1) JOIN rg USING (range_id) JOIN bb USING (book_id, page)) GROUP BY 1",
        "blocks",
        more={**_PAGES, "bb": "SELECT book_id, page, book_id * 1000 + page * 100 + line // 3 AS block_id, min(x0) AS bx0, min(y0) AS by0, max(x1) AS bx1, max(y1) AS by1 FROM pl GROUP BY ALL"},
    ),
    "n2_list_highlights": sql("SELECT block_id AS id, u.title AS unit, CAST(row_number() OVER (PARTITION BY b.book_id ORDER BY page, n, block_id) AS INTEGER) AS place FROM blocks b JOIN units u USING (unit_id) WHERE type = 'paragraph' AND block_id % 2 = 0 AND block_id % 3 = 0", "blocks", "units"),
    "n3_latest_versions": sql(
        "SELECT learner_id % 10 AS book_id, card_id AS page, rating AS start, rating + 1 AS \"end\", 'v' || max_by(review_id, (review, review_id)) || chr(10) || 'end' AS text, min(review) AS created, max(review) AS updated FROM reviews WHERE review_id % 5 <> 0 GROUP BY 1, 2, 3, 4",
        "reviews",
    ),
    "n4_annotations": sql(
        """SELECT book_id, kind, count(*) AS n, CAST(sum(start) AS BIGINT) AS start FROM (SELECT unit_id AS book_id, 'highlight' AS kind, n AS start FROM blocks WHERE type = 'paragraph'
 UNION ALL SELECT DISTINCT ON (b, p, r) b, 'version', r FROM (SELECT learner_id % 10 AS b, card_id AS p, rating AS r FROM reviews WHERE review_id % 5 <> 0)
 UNION ALL SELECT conv_id % 50, 'chat', min(length(text)) FROM conversations GROUP BY conv_id UNION ALL SELECT unit_id, 'read', NULL FROM (SELECT DISTINCT unit_id, page FROM page_reads)) GROUP BY ALL""",
        "blocks",
        "reviews",
        "page_reads",
    ),
    "n5_place_quotes": sql(
        """SELECT quote_id, (x).page AS page, CAST((x).s AS INTEGER) AS start, CAST((x).e AS INTEGER) AS "end" FROM (SELECT quote_id, min_by({'page': page, 's': s, 'e': e}, (CAST(page <> own AS INTEGER), abs(s - hint), s)) AS x FROM (
 SELECT quote_id, page, own, hint, map[i] AS s, map[i + length(f) - 1] + 1 AS e FROM (SELECT *, unnest(range(1, length(folded) - length(f) + 2)) AS i FROM (SELECT q.quote_id, p.page, q.page AS own, hint, f.folded AS f, p.folded, p.map FROM q JOIN qf f USING (quote_id) JOIN pf p ON p.book_id = q.book_id AND p.page IN (q.page, q.page + 1) WHERE contains(p.folded, f.folded))) WHERE substr(folded, i, length(f)) = f) GROUP BY 1)""",
        "blocks",
        more={
            **_PAGES,
            "q": "SELECT book_id * 1000 + page AS quote_id, book_id, CAST(greatest(0, page - 1) AS INTEGER) AS page, 10 AS hint, translate(replace(substr(text, 20, 45), chr(10), ' '), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS t FROM pt WHERE length(substr(text, 20, 45)) = 45 UNION ALL SELECT -item_id - 1, item_id, 0, 0, substr(text, 1, 60) FROM benchmark",
            "qf": _FOLD.format(k="quote_id", f="q"),
            "pf": _FOLD.format(k="book_id, page", f="(SELECT book_id, page, text AS t FROM pt)"),
        },
    ),
    "n6_find_all": sql(
        """SELECT query_id, page, start, "end", CAST(row_number() OVER (PARTITION BY query_id, page ORDER BY start, no) AS INTEGER) AS place FROM (SELECT query_id, page, no, map[i + 1] AS start, map[i + n] + 1 AS "end" FROM (
 SELECT *, CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * n AS BIGINT) AS i FROM (SELECT *, unnest(range(1, len(parts))) AS k FROM (SELECT w.query_id, no, p.page, p.map, length(w.folded) AS n, string_split(p.folded, w.folded) AS parts FROM wf w JOIN pf p ON p.book_id = w.query_id WHERE length(w.folded) >= 2)))
 QUALIFY row_number() OVER (PARTITION BY query_id, page ORDER BY no, start) <= 200)""",
        "blocks",
        "units",
        more={
            **_PAGES,
            "ws": "SELECT unit_id AS query_id, 0 AS no, substr(title, 1, 3) AS t FROM units UNION ALL SELECT unit_id, 1, array_to_string(string_split(title, ' ')[3:4], ' ') FROM units",
            "wf": _FOLD.format(k="query_id, no", f="ws"),
            "pf": _FOLD.format(k="book_id, page", f="(SELECT book_id, page, text AS t FROM pt)"),
        },
    ),
    "n7_range_rects": sql("SELECT * FROM rr", "blocks", more=_PAGES),
    "n7_range_box": sql("SELECT range_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM rr GROUP BY 1", "blocks", more=_PAGES),
    "n8_range_in_rect": sql(
        "SELECT rect_id, min(a) AS start, max(b) AS \"end\" FROM (SELECT book_id * 1000 + page AS rect_id, start + CAST(greatest(0, ceil((83 - x0) / 5.0 - 0.5)) AS BIGINT) AS a, start + CAST(least(length(text), floor((191 - x0) / 5.0 - 0.5) + 1) AS BIGINT) AS b FROM pl WHERE (y0 + y1) / 2 BETWEEN 110 AND 160) WHERE a < b GROUP BY 1",
        "blocks",
        more=_PAGES,
    ),
    "n13_split_selection": sql(
        r"""SELECT book_id AS selection_id, page, a AS start, b AS "end", trim(regexp_replace(regexp_replace(regexp_replace(substr(text, a + 1, b - a), '(\p{L})[-‐]\n(\p{Ll})', '\1\2', 'g'), '\n', ' ', 'g'), '[ \t]+', ' ', 'g')) AS quote, CASE WHEN page = 0 THEN 'why' ELSE '' END AS note
 FROM (SELECT *, CASE WHEN page = 0 THEN 40 ELSE 0 END AS a, CAST(CASE WHEN page = 1 THEN least(120, length(text)) ELSE length(text) END AS INTEGER) AS b FROM pt WHERE page <= 1) WHERE a < b""",
        "blocks",
        more=_PAGES,
    ),
    "l28_page_text": sql("SELECT book_id, page, sha256(text) AS sha, CAST(length(text) AS INTEGER) AS n, starts FROM pt JOIN (SELECT book_id, page, string_agg(line || ':' || start, ' ' ORDER BY line) AS starts FROM pl GROUP BY ALL) USING (book_id, page)", "blocks", more=_PAGES),
}
