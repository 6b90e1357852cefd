"""Queries of sources, sinks and table maintenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.layout import NO_OUTLINE, NO_TEXT, import_warnings
from ..sources import fixtures
from ..sources import tables as S
from ..sources.fixtures import sql
from ..sources.shared import new_folder, written
from . import layout

TYPES = ["heading", "paragraph", "code", "footnote"]


def s1(spark, d):
    """The declared schema, over the test table of the same role."""
    names = {"review_id": "id", "learner_id": "learner_id", "card_id": "card_id", "rating": "rating", "review": "review", "duration_ms": "duration_ms"}
    return fixtures.reviews(spark, d).select(*[F.col(a).cast(S.schema("review_log")[b].dataType).alias(b) for a, b in names.items()])


def s2(spark, d):
    files = fixtures.table(spark, d, "documents").select(F.concat(F.lit("in/my_"), "doc_id", F.lit(".pdf")).alias("path"), F.col("text").cast("binary").alias("content"), F.col("doc_id").alias("added_at"))
    return S.dedup_imports(files).select("file_hash", "path", "title", "status")


def _all_tables(spark, d):
    """Every study table, derived from the test tables, with the columns that tell its rows apart and those that point elsewhere. The first
    and the last word of a line are its concepts."""
    units, blocks, cards, pages = fixtures.units(spark, d), fixtures.blocks(spark, d), fixtures.cards(spark, d), fixtures.page_reads(spark, d)
    first, last = F.lower(F.substring_index("text", " ", 1)), F.lower(F.substring_index("text", " ", -1))
    words = blocks.select("book_id", "block_id", first.alias("a"), last.alias("b"))
    found = words.select("book_id", "block_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("key"))
    at_book = pages.join(units.select("unit_id", "book_id"), "unit_id")
    chats = fixtures.table(spark, d, "conversations")
    book_of_chat = F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string"))
    return {
        "books": units.select(F.col("book_id").alias("id")).distinct(),
        "sections": units.select(F.col("unit_id").alias("id"), "book_id"),
        "blocks": blocks.select(F.col("block_id").alias("id"), "book_id"),
        "reads": fixtures.reads(spark, d).select("learner_id", "block_id"),
        "page_reads": at_book.select("learner_id", "book_id", "page").distinct(),
        "reading_time": at_book.groupBy("learner_id", "book_id").agg(F.sum("dwell_ms").alias("ms")),
        "highlights": blocks.filter("type = 'paragraph'").select(F.col("block_id").alias("id"), "book_id"),
        "versions": blocks.filter("type = 'heading'").select(F.col("block_id").alias("id"), "book_id"),
        "cards": cards.select(F.col("card_id").alias("id"), "book_id"),
        "review_log": pages.select((F.col("learner_id") * 1_000_000_000 + F.col("unit_id")).alias("card_id"), "page"),
        "concepts": found.select("key").distinct(),
        "concept_books": found.select("key", "book_id").distinct(),
        "mentions": found.select("key", "block_id"),
        "edges": words.filter("a <> b").select("book_id", "a", "b").distinct(),
        "card_concepts": cards.join(units.select("unit_id", F.lower(F.substring_index("title", " ", 1)).alias("key")), "unit_id").select("card_id", "key"),
        "chats": chats.select(F.col("conv_id").alias("id"), book_of_chat.alias("book_id")).distinct(),
        "chat_messages": chats.select(F.col("conv_id").alias("chat_id"), "turn"),
        "unit_jobs": units.select("unit_id", F.lit("cards").alias("job")),
    }


#: What a table's rows add up to, besides their number.
_TOTALS = {
    "sections": "sum(id)", "blocks": "sum(id)", "reads": "sum(block_id)", "page_reads": "sum(learner_id)", "reading_time": "sum(ms)", "highlights": "sum(id)", "versions": "sum(id)", "cards": "sum(id)",
    "review_log": "sum(card_id)", "mentions": "sum(block_id)", "card_concepts": "sum(card_id)", "chats": "sum(id)", "chat_messages": "sum(chat_id)", "unit_jobs": "sum(unit_id)",
    "concepts": "sum(length(key))", "concept_books": "sum(length(key))", "edges": "sum(length(a))", "books": "sum(length(id))",
}


def _as_bigint(rows, column):
    """rows with column, whole numbers as DECIMAL, as BIGINT where all of them fit one; else as they are."""
    fits = rows.filter(F.col(column) != F.coalesce(F.col(column).try_cast("long"), F.lit(0))).isEmpty()
    return rows.withColumn(column, F.col(column).cast("long")) if fits else rows


def s4(spark, d):
    """Of every table what is left without the books under src2. total is a BIGINT, as the SQL says, unless one of them is beyond that (some
    card ids of many learners are); then it is a DECIMAL(38,0)."""
    tables = _all_tables(spark, d)
    tables |= {n: written(tables[n]) for n in ("blocks", "cards", "concepts", "concept_books")}  # parents, met several times
    out = S.remove_books(tables, tables["books"].filter("id < 'src2'").select(F.col("id").alias("book_id")))
    total = lambda n: F.sum(F.expr(_TOTALS[n].removeprefix("sum")).cast("decimal(19,0)")).cast("decimal(38,0)")
    rows = [out[n].agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"), F.coalesce(total(n), F.lit(0).cast("decimal(38,0)")).alias("total")) for n in S.SCHEMAS]
    return _as_bigint(written(reduce(DataFrame.unionByName, rows)), "total")


def _highlights(spark, d):
    rows = fixtures.blocks(spark, d).filter("type = 'paragraph'").join(fixtures.units(spark, d).select("unit_id", F.col("title").alias("unit"), "ord"), "unit_id")
    note = F.when(F.col("block_id") % 2 == 0, "see again").otherwise("")
    return rows.select("book_id", F.col("book_id").alias("title"), "unit", F.col("unit_id").cast("long").alias("page"), F.col("n").alias("start"), F.col("block_id").alias("id"), F.col("text").alias("quote"), note.alias("note"))


def s3(spark, d):
    """The books of one source in four are imported again, with each of their lines longer by a word and a page later."""
    blocks = fixtures.blocks(spark, d).select(F.col("block_id").alias("id"), "book_id", "unit_id", "text", "page")
    reads = fixtures.reads(spark, d).select("learner_id", "block_id", "unit_id")
    books = fixtures.books(spark, d).select(F.col("book_id").alias("id"), "page_count")
    cards = fixtures.cards(spark, d).select(F.col("card_id").alias("id"), "book_id", "unit_id")
    again = books.filter(F.pmod(F.length("id") + F.ascii(F.substring("id", -1, 1)), F.lit(4)) == 0)
    new = blocks.join(again.select(F.col("id").alias("book_id")), "book_id", "left_semi").select("id", "book_id", "unit_id", F.concat("text", F.lit(" again")).alias("text"), (F.col("page") + 1).alias("page"))
    tables = {"books": books, "blocks": blocks, "reads": reads, "cards": cards}
    out = S.replace_books(tables, {"blocks": new, "books": again.withColumn("page_count", F.col("page_count") + 1)}, again.select(F.col("id").alias("book_id")))
    root = new_folder(spark)
    S.publish(out, root)
    out = S.current(spark, root, list(out))
    n = F.count(F.lit(1)).alias("n")
    rows = [
        out["blocks"].groupBy("book_id").agg(n, F.sum(F.length("text") + F.col("page")).alias("total"), F.min("text").alias("least")).withColumn("name", F.lit("blocks")),
        out["reads"].join(out["blocks"].select(F.col("id").alias("block_id"), "book_id"), "block_id").groupBy("book_id").agg(n, F.sum("learner_id").alias("total"), F.lit("").alias("least")).withColumn("name", F.lit("reads")),
        out["cards"].groupBy("book_id").agg(n, F.sum("unit_id").alias("total"), F.lit("").alias("least")).withColumn("name", F.lit("cards")),
        out["books"].groupBy(F.col("id").alias("book_id")).agg(n, F.sum("page_count").alias("total"), F.lit("").alias("least")).withColumn("name", F.lit("books")),
    ]
    first, *rest = rows
    for r in rest:
        first = first.unionByName(r)
    return first


def s6(spark, d):
    rows = fixtures.blocks(spark, d).select("book_id", F.col("block_id").alias("ord"), "type", F.lit(2).alias("level"), F.lit("").alias("label"), "text", F.col("unit_id").cast("int").alias("page"))
    return S.dump_markdown(rows, 100).select("book_id", "part", F.sha2("markdown", 256).alias("sha"), F.length("markdown").cast("long").alias("n"))


def s8(spark, d):
    """Page reads before AS_OF, and those from then on as they come."""
    pages = fixtures.page_reads(spark, d).select("learner_id", "unit_id", "page", "seen", "dwell_ms")
    at = F.lit("2024-01-15 00:00:00").cast("timestamp")
    old = pages.filter(F.col("seen") < at).groupBy("learner_id", "unit_id", "page").agg(F.min("seen").alias("seen"), F.sum("dwell_ms").alias("dwell_ms"))
    return S.merge_rows(old, pages.filter(F.col("seen") >= at), ["learner_id", "unit_id", "page"], {"seen": "min", "dwell_ms": "sum"})


def s7(spark, d):
    """Concepts are first words of headings, edges the two ends of a line; documents warn for their source: those whose outlines found no
    lines, and those of which only every third has text."""
    units, blocks = fixtures.units(spark, d), fixtures.blocks(spark, d)
    first, last = F.lower(F.substring_index("text", " ", 1)), F.lower(F.substring_index("text", " ", -1))
    edges = blocks.select("book_id", first.alias("a"), last.alias("b")).filter("a <> b").distinct()
    parts = {"sections": fixtures.sections(spark, d), "concepts": fixtures.concept_books(spark, d), "edges": edges, "cards": fixtures.cards(spark, d)}
    lines = layout.lines(spark, d)
    outline = lines.filter("ord = 1").select("book_id", "page")
    found = import_warnings(lines.filter("book_id % 3 = 0"), layout.pages(spark, d), outline, outline.filter("book_id % 10 > 0"))
    told = found.join(units.select(F.col("unit_id").alias("book_id"), F.col("book_id").alias("source")), "book_id").select(F.col("source").alias("book_id"), "warning")
    return S.profile_books(blocks, TYPES, parts, told)


QUERIES = {
    "s1_load_reviews": s1,
    "s2_dedup_imports": s2,
    "s3_replace_books": s3,
    "s4_remove_books": s4,
    "s5_export_notes": lambda spark, d: S.export_notes(_highlights(spark, d), 100),
    "s6_dump_markdown": s6,
    "s7_profile_books": s7,
    "s8_merge_rows": s8,
}

#: What is left of each table, said table by table: books from src2 on, and what belongs to them.
_LEFT = {
    "lw": "SELECT book_id, block_id, lower(split_part(text, ' ', 1)) AS a, lower(split_part(text, ' ', -1)) AS b FROM blocks WHERE book_id >= 'src2'",
    "lf": "SELECT book_id, block_id, a AS key FROM lw UNION SELECT book_id, block_id, b FROM lw",
    "lp": "SELECT p.*, book_id FROM page_reads p JOIN units USING (unit_id) WHERE book_id >= 'src2'",
    "t_books": "SELECT DISTINCT book_id AS id FROM units WHERE book_id >= 'src2'",
    "t_sections": "SELECT unit_id AS id FROM units WHERE book_id >= 'src2'",
    "t_blocks": "SELECT block_id AS id FROM blocks WHERE book_id >= 'src2'",
    "t_reads": "SELECT block_id FROM reads JOIN blocks USING (block_id) WHERE book_id >= 'src2'",
    "t_page_reads": "SELECT DISTINCT learner_id, book_id, page FROM lp",
    "t_reading_time": "SELECT sum(dwell_ms) AS ms FROM lp GROUP BY learner_id, book_id",
    "t_highlights": "SELECT block_id AS id FROM blocks WHERE type = 'paragraph' AND book_id >= 'src2'",
    "t_versions": "SELECT block_id AS id FROM blocks WHERE type = 'heading' AND book_id >= 'src2'",
    "t_cards": "SELECT card_id AS id FROM cards WHERE book_id >= 'src2'",
    "t_review_log": "SELECT learner_id * 1000000000 + unit_id AS card_id FROM page_reads WHERE NOT EXISTS (SELECT 1 FROM units WHERE units.unit_id = page_reads.unit_id AND book_id < 'src2')",
    "t_concepts": "SELECT DISTINCT key FROM lf",
    "t_concept_books": "SELECT DISTINCT key, book_id FROM lf",
    "t_mentions": "SELECT DISTINCT key, block_id FROM lf",
    "t_edges": "SELECT DISTINCT book_id, a, b FROM lw WHERE a <> b",
    "t_card_concepts": "SELECT card_id, lower(split_part(title, ' ', 1)) AS key FROM cards JOIN units USING (unit_id) WHERE cards.book_id >= 'src2'",
    "t_chats": "SELECT DISTINCT conv_id AS id FROM conversations WHERE NOT EXISTS (SELECT 1 FROM units WHERE book_id = 'src' || conv_id % 20 AND book_id < 'src2')",
    "t_chat_messages": "SELECT conv_id AS chat_id FROM conversations WHERE NOT EXISTS (SELECT 1 FROM units WHERE book_id = 'src' || conv_id % 20 AND book_id < 'src2')",
    "t_unit_jobs": "SELECT unit_id FROM units WHERE book_id >= 'src2'",
}

ORACLE = {
    "s1_load_reviews": sql("SELECT review_id AS id, learner_id, card_id, rating, review, duration_ms FROM reviews", "reviews"),
    "s2_dedup_imports": "SELECT sha256(text) AS file_hash, 'in/my_' || min(doc_id) || '.pdf' AS path, 'my ' || min(doc_id) AS title, 'importing' AS status FROM documents GROUP BY text",
    "s4_remove_books": sql(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n, CAST(coalesce({t}, 0) AS BIGINT) AS total FROM t_{n}" for n, t in _TOTALS.items()), "reads", "cards", more=_LEFT),
    "s3_replace_books": sql(
        """SELECT book_id, count(*) AS n, CAST(sum(length(text) + page + 7 * CAST(again AS INTEGER)) AS BIGINT) AS total, min(CASE WHEN again THEN text || ' again' ELSE text END) AS least, 'blocks' AS name FROM ab GROUP BY book_id
 UNION ALL SELECT book_id, count(*), CAST(sum(learner_id) AS BIGINT), '', 'reads' FROM reads JOIN (SELECT block_id, book_id, again FROM ab) USING (block_id) WHERE NOT again GROUP BY book_id
 UNION ALL SELECT book_id, count(*), CAST(sum(unit_id) AS BIGINT), '', 'cards' FROM cards JOIN bk USING (book_id) WHERE NOT again GROUP BY book_id
 UNION ALL SELECT book_id, 1, page_count + CAST(again AS INTEGER), '', 'books' FROM bk""",
        "reads",
        "cards",
        "books",
        more={"bk": "SELECT *, (length(book_id) + ascii(right(book_id, 1))) % 4 = 0 AS again FROM books", "ab": "SELECT * FROM blocks JOIN bk USING (book_id)"},
    ),
    "s5_export_notes": sql(
        "SELECT book_id, part, string_agg(md, chr(10) ORDER BY place) AS markdown FROM m GROUP BY book_id, part",
        "blocks",
        "units",
        more={
            "h": "SELECT b.*, CASE WHEN u.title <> '' THEN u.title ELSE 'Notes' END AS unit FROM blocks b JOIN units u USING (unit_id) WHERE type = 'paragraph'",
            "g": "SELECT *, coalesce(lag(unit) OVER w <> unit, true) AS fresh, row_number() OVER w - 1 AS place FROM h WINDOW w AS (PARTITION BY book_id ORDER BY unit_id, n, block_id)",
            "m": "SELECT *, place // 100 AS part, CASE WHEN place = 0 THEN '# ' || book_id || chr(10) || chr(10) ELSE '' END || CASE WHEN fresh THEN '## ' || unit || chr(10) || chr(10) ELSE '' END || '> ' || text || chr(10) || CASE WHEN block_id % 2 = 0 THEN chr(10) || 'see again' || chr(10) ELSE '' END AS md FROM g",
        },
    ),
    "s6_dump_markdown": sql(
        "SELECT book_id, part, sha256(md) AS sha, length(md) AS n FROM (SELECT book_id, part, string_agg(md, chr(10) || chr(10) ORDER BY block_id) AS md FROM m GROUP BY book_id, part)",
        "blocks",
        more={
            "m": "SELECT book_id, block_id, part, CASE type WHEN 'heading' THEN '## ' || text || ' ' || w WHEN 'code' THEN '``` ' || w || chr(10) || text || chr(10) || '```' WHEN 'footnote' THEN '> [^] ' || text || ' ' || w ELSE text || ' ' || w END AS md FROM (SELECT *, '<!-- p' || (unit_id + 1) || ' -->' AS w, (row_number() OVER (PARTITION BY book_id ORDER BY block_id) - 1) // 100 AS part FROM blocks)"
        },
    ),
    "s7_profile_books": sql(
        "SELECT book_id, " + ", ".join(f"n_{t}" for t in TYPES) + """, n_units, weight, coalesce(n_sections, 0) AS n_sections, coalesce(n_concepts, 0) AS n_concepts, coalesce(n_edges, 0) AS n_edges, coalesce(n_cards, 0) AS n_cards, coalesce(warnings, '') AS warnings
 FROM bl LEFT JOIN (SELECT book_id, count(*) AS n_sections FROM sections GROUP BY 1) USING (book_id) LEFT JOIN (SELECT book_id, count(*) AS n_concepts FROM concept_books GROUP BY 1) USING (book_id)
 LEFT JOIN (SELECT book_id, count(*) AS n_edges FROM (SELECT DISTINCT book_id, a, b FROM (SELECT book_id, lower(split_part(text, ' ', 1)) AS a, lower(split_part(text, ' ', -1)) AS b FROM blocks) WHERE a <> b) GROUP BY 1) USING (book_id)
 LEFT JOIN (SELECT book_id, count(*) AS n_cards FROM cards GROUP BY 1) USING (book_id) LEFT JOIN (SELECT u.book_id, string_agg(DISTINCT warning, chr(10) ORDER BY warning) AS warnings FROM wn JOIN units u ON u.unit_id = wn.book_id GROUP BY 1) USING (book_id)""",
        "blocks",
        "sections",
        "concept_books",
        "cards",
        more={
            "bl": "SELECT book_id, " + ", ".join(f"count(*) FILTER (WHERE type = '{t}') AS n_{t}" for t in TYPES) + ", count(DISTINCT unit_id) AS n_units, CAST(sum(weight) AS BIGINT) AS weight FROM blocks GROUP BY book_id",
            "ln": layout.LINES,
            "wn": f"SELECT book_id, '{NO_TEXT}' AS warning FROM ln GROUP BY 1 HAVING coalesce(sum(n) FILTER (WHERE book_id % 3 = 0), 0) < 40 * count(DISTINCT page) UNION ALL SELECT book_id, '{NO_OUTLINE}' FROM ln WHERE ord = 1 GROUP BY 1 HAVING count(*) >= 3 AND book_id % 10 = 0",
        },
    ),
    "s8_merge_rows": sql("SELECT learner_id, unit_id, page, min(seen) AS seen, CAST(sum(dwell_ms) AS BIGINT) AS dwell_ms FROM page_reads GROUP BY 1, 2, 3", "page_reads"),
}
