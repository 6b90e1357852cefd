"""Queries of sections, units and reading progress."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import units as U
from ..sources import fixtures as X
from ..sources.fixtures import sql

AS_OF = "TIMESTAMP '2024-01-15 00:00:00'"


def _as_of():
    return F.lit("2024-01-15 00:00:00").cast("timestamp")



def _tree(spark, d):
    return U.section_parents(X.sections(spark, d))


def u5(spark, d):
    ends = U.section_end_page(_tree(spark, d), X.books(spark, d))
    return U.plan_units(ends, split_pages=6).select("section_id", "is_unit", "unit_id")


def _some_sections(spark, d, which="level = 1"):
    """The sections that start blocks: those of the first level, or of another kind."""
    return X.sections(spark, d).filter(which).select("book_id", "section_id", "ord", (F.col("section_id") * X.LINES).alias("block_ord"))


def u6(spark, d):
    blocks = X.blocks(spark, d).withColumn("ord", F.col("block_id"))
    return U.block_sections(blocks, _some_sections(spark, d)).select("block_id", "section_id")


def u7(spark, d):
    blocks = X.blocks(spark, d).select("book_id", F.col("block_id").alias("ord"), F.floor(F.col("unit_id") / 7).cast("int").alias("page"))
    return U.default_sections(blocks, _some_sections(spark, d, "level = 4 and kind = 'front'"))


def _flat(spark, d):
    """Blocks with pages of the book, three units a page."""
    return X.blocks(spark, d).withColumn("page", F.floor(F.col("unit_id") / 60).cast("int"))


def u9(spark, d):
    starts = X.units(spark, d).select("book_id", F.floor(F.col("unit_id") / 60).cast("int").alias("page"), "unit_id")
    pages = X.books(spark, d).select("book_id", F.explode(F.sequence(F.lit(0), F.col("page_count") - 1)).alias("page"))
    return U.unit_at_page(pages, _flat(spark, d), starts)


def u10(spark, d):
    starts = X.sections(spark, d).select("book_id", F.col("section_id").alias("unit_id"), (F.col("page") / 9).cast("int").alias("page"))
    return U.unit_pages(starts, X.books(spark, d))


def _halves(spark, d):
    """Page reads before and from AS_OF on."""
    new = X.page_reads(spark, d)
    return new.filter(F.col("seen") < _as_of()), new.filter(F.col("seen") >= _as_of())


def u11(spark, d):
    old, new = _halves(spark, d)
    blocks = X.blocks(spark, d)
    pages, _ = U.apply_page_reads(old.groupBy("learner_id", "unit_id", "page").agg(F.min("seen").alias("seen"), F.sum("dwell_ms").alias("dwell_ms")), X.reads(spark, d).limit(0), new, blocks)
    return pages


def u12(spark, d):
    marks = X.page_reads(spark, d).groupBy("learner_id", "unit_id").agg(F.min("seen").alias("seen")).withColumn("read", F.col("unit_id") % 2 == 0)
    return U.mark_units(X.reads(spark, d), X.blocks(spark, d), marks).groupBy("learner_id", "unit_id").agg(F.count(F.lit(1)).alias("n"), F.min("seen").alias("seen"))


def u16(spark, d):
    done = U.units_finished(X.reads(spark, d), X.blocks(spark, d))
    return U.unlock_cards(X.cards(spark, d), done).select("card_id", "status", "due")


def _time(spark, d):
    return X.page_reads(spark, d).join(X.units(spark, d).select("unit_id", "book_id"), "unit_id").select("learner_id", "book_id", "seen", F.col("dwell_ms").alias("ms"))


def _library(spark, d):
    time = U.reading_time(_time(spark, d), X.zones(spark, d))
    return U.library(X.shelf(spark, d), X.units(spark, d), X.blocks(spark, d), X.reads(spark, d), time, X.cards(spark, d), X.concept_books(spark, d), _as_of())


def u17(spark, d):
    return _library(spark, d).withColumn("fraction", F.round("fraction", 9))


def u18(spark, d):
    shelf = _library(spark, d)
    return U.library_totals(shelf).join(U.continue_reading(shelf), "learner_id", "left")


def _shows(spark, d):
    """Views open two pages side by side, until the learner's next view, the last for two hours; all events are activity."""
    e = X.table(spark, d, "events")
    pair = F.floor(X._k() / 2).cast("int")
    opened = e.filter("event_type = 'view'").withColumn("hidden", F.coalesce(F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.col("ts") + F.expr("INTERVAL 2 HOURS")))
    return opened.select(F.col("user_id").alias("learner_id"), (pair % 4).alias("book_id"), F.explode(F.array(2 * pair, 2 * pair + 1)).alias("page"), F.col("ts").alias("shown"), "hidden", F.col("event_id").alias("view_id"))


def _activity(spark, d):
    return X.table(spark, d, "events").select(F.col("user_id").alias("learner_id"), F.col("ts").alias("at"), F.col("event_id").alias("event_id"))


def _need(spark, d):
    """Every other page of a pair has text."""
    page = F.col("unit_id").cast("int")
    return X.blocks(spark, d).filter("unit_id % 3 <> 0").groupBy((F.floor(page / 2).cast("int") % 4).alias("book_id"), page.alias("page")).agg(F.sum(F.length("text")).alias("chars"))


def u21(spark, d):
    return U.page_dwell(_shows(spark, d), _activity(spark, d), _need(spark, d), 3600.0).withColumn("dwell_s", F.round("dwell_s", 6))


def u24(spark, d):
    positions = _time(spark, d).join(X.units(spark, d).select("book_id", "unit_id", "kind"), "book_id", "left_semi").withColumn("page", (F.col("ms") % 700).cast("int"))
    starts = X.sections(spark, d).select("book_id", "kind", "page")
    return U.resume_page(positions, starts, X.books(spark, d))


QUERIES = {
    "u1_block_weight": lambda spark, d: X.blocks(spark, d).select("block_id", "type", "weight"),
    "u2_section_parents": lambda spark, d: _tree(spark, d).select("section_id", "level", "parent_id"),
    "u3_inherit_kind": lambda spark, d: U.inherit_kind(_tree(spark, d)).select("section_id", "kind"),
    "u4_section_end_page": lambda spark, d: U.section_end_page(X.sections(spark, d), X.books(spark, d)).select("section_id", "page", "end_page"),
    "u5_plan_units": u5,
    "u6_block_sections": u6,
    "u7_default_sections": u7,
    "u8_unit_weights": lambda spark, d: U.unit_weights(X.blocks(spark, d), X.units(spark, d)),
    "u8_book_weights": lambda spark, d: U.book_weights(X.blocks(spark, d), X.units(spark, d)),
    "u9_unit_at_page": u9,
    "u10_unit_pages": u10,
    "u11_apply_page_reads": u11,
    "u12_mark_units": u12,
    "u13_unit_progress": lambda spark, d: U.unit_progress(X.reads(spark, d), X.blocks(spark, d), X.units(spark, d)).withColumn("fraction", F.round("fraction", 9)),
    "u14_section_progress": lambda spark, d: U.section_progress(X.units(spark, d), X.reads(spark, d), X.blocks(spark, d)).withColumn("fraction", F.when(F.col("fraction") > 0, F.round("fraction", 9)).otherwise(F.lit(0.0))),
    "u15_units_finished": lambda spark, d: U.units_finished(X.reads(spark, d), X.blocks(spark, d)),
    "u15_progress_steps": lambda spark, d: U.progress_steps(X.reads(spark, d), X.blocks(spark, d)),
    "u16_unlock_cards": u16,
    "u17_library": u17,
    "u18_library_totals": u18,
    "u19_pages_read": lambda spark, d: U.pages_read(X.page_reads(spark, d), X.reads(spark, d), X.blocks(spark, d)),
    "u20_reading_time": lambda spark, d: U.reading_time(_time(spark, d), X.zones(spark, d)),
    "u21_page_dwell": u21,
    "u24_resume_page": u24,
}

_TREE = {"tree": "SELECT s.*, (SELECT max_by(p.section_id, p.ord) FROM sections p WHERE p.book_id = s.book_id AND p.ord < s.ord AND p.level < s.level) AS parent_id FROM sections s"}
_ENDS = "SELECT s.*, coalesce((SELECT min_by(p.page, p.ord) FROM sections p WHERE p.book_id = s.book_id AND p.ord > s.ord AND p.level <= s.level), page_count) AS end_page FROM {} s JOIN books USING (book_id)"
_UNITS = {
    **_TREE,
    "ends": _ENDS.format("tree"),
    "kids": "SELECT parent_id AS section_id, count(*) AS kids FROM tree WHERE parent_id IS NOT NULL GROUP BY parent_id",
    "e": "SELECT ends.*, coalesce(kids, 0) AS kids FROM ends LEFT JOIN kids USING (section_id)",
}
_SOME = {
    "few": f"SELECT book_id, section_id, ord, section_id * {X.LINES} AS block_ord FROM sections WHERE level = 1",
    "fronts": f"SELECT book_id, section_id * {X.LINES} AS block_ord FROM sections WHERE level = 4 AND kind = 'front'",
}
_W = "unit_w AS (SELECT unit_id, CAST(sum(weight) AS BIGINT) AS weight FROM blocks GROUP BY unit_id)"
_READ_W = {
    "unit_w": "SELECT unit_id, CAST(sum(weight) AS BIGINT) AS weight FROM blocks GROUP BY unit_id",
    "read_w": "SELECT learner_id, b.unit_id, sum(weight) AS read_weight FROM (SELECT DISTINCT learner_id, block_id FROM reads) JOIN blocks b USING (block_id) GROUP BY ALL",
}
_DONE = {
    **_READ_W,
    "steps": "SELECT learner_id, unit_id, seen, sum(w) OVER (PARTITION BY learner_id, unit_id ORDER BY seen) AS so_far FROM (SELECT learner_id, unit_id, seen, sum(weight) AS w FROM reads JOIN blocks USING (block_id, unit_id) GROUP BY ALL)",
    "done": "SELECT learner_id, unit_id, min(seen) AS finished_at FROM steps JOIN unit_w USING (unit_id) WHERE weight > 0 AND so_far / weight >= 0.85 GROUP BY ALL",
}
_NEED = "SELECT CAST(unit_id // 2 % 4 AS INTEGER) AS book_id, CAST(unit_id AS INTEGER) AS page, sum(length(text)) AS chars FROM blocks WHERE unit_id % 3 <> 0 GROUP BY ALL"
#: Shows, the times in which a learner is active (no two overlap), and what each pair of them shares; {end}: what lies behind it does not count.
_DWELL = {
    "need": _NEED,
    "shows": f"SELECT user_id AS learner_id, CAST(j % 4 AS INTEGER) AS book_id, CAST(2 * j + side AS INTEGER) AS page, a, b FROM (SELECT user_id, {X._K} // 2 AS j, epoch_us(ts) AS a, coalesce(epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), epoch_us(ts) + 7200000000) AS b FROM events WHERE event_type = 'view'), (SELECT unnest([0, 1]) AS side)",
    "acts": "SELECT learner_id, a, least(a + 3600000000, coalesce(lead(a) OVER (PARTITION BY learner_id ORDER BY a), a + 3600000000)) AS b FROM (SELECT DISTINCT user_id AS learner_id, epoch_us(ts) AS a FROM events WHERE epoch_us(ts) < {end})",
    "dwelt": "SELECT s.learner_id, s.book_id, s.page, sum(greatest(0, least(s.b, coalesce(t.b, s.a), {end}) - greatest(s.a, coalesce(t.a, s.a)))) AS us FROM shows s LEFT JOIN acts t ON t.learner_id = s.learner_id AND t.a < s.b AND t.b > s.a GROUP BY ALL",
    "told": "SELECT learner_id, book_id, page, CAST(us AS BIGINT) AS us, us / 1e6 >= greatest(2.5, least(30.0, coalesce(chars, 0) * {scale} * 0.008)) AS read FROM dwelt LEFT JOIN need USING (book_id, page)",
}


def dwell(end: str = "9000000000000000000", scale: int = 1) -> dict[str, str]:
    return {k: v.replace("{end}", end).replace("{scale}", str(scale)) for k, v in _DWELL.items()}

_TIME = {"times": "SELECT learner_id, book_id, seen, dwell_ms AS ms FROM page_reads JOIN units USING (unit_id)", "rt": "SELECT learner_id, book_id, CAST((seen AT TIME ZONE 'UTC') AT TIME ZONE tz AS DATE) AS day, CAST(sum(ms) AS BIGINT) AS ms FROM times JOIN zones USING (learner_id) WHERE ms > 0 AND ms <= 3600000 GROUP BY ALL"}
_SHELF = {
    **_TIME,
    "bw": "SELECT book_id, CAST(sum(weight) AS BIGINT) AS weight FROM blocks WHERE unit_id IN (SELECT unit_id FROM units WHERE kind IN ('body', 'exercises')) GROUP BY book_id",
    "lib": f"""SELECT o.learner_id, o.book_id, CAST(row_number() OVER (PARTITION BY o.learner_id ORDER BY coalesce(opened, added) DESC, o.book_id) - 1 AS INTEGER) AS place, added, opened, status,
  round(CASE WHEN weight > 0 THEN least(1.0, coalesce(rw, 0) / weight) ELSE 0.0 END, 9) AS fraction, coalesce(n, 0) AS cards, coalesce(due, 0) AS due, coalesce(concepts, 0) AS concepts, coalesce(n_units, 0) AS units, CAST(coalesce(ms, 0) AS BIGINT) AS ms
 FROM shelf o LEFT JOIN (SELECT learner_id, b.book_id, sum(b.weight) FILTER (WHERE u.kind IN ('body', 'exercises')) AS rw FROM reads JOIN blocks b USING (block_id, unit_id) JOIN units u USING (unit_id) GROUP BY ALL) USING (learner_id, book_id)
 LEFT JOIN bw USING (book_id) LEFT JOIN (SELECT book_id, count(*) AS n_units FROM units GROUP BY 1) USING (book_id) LEFT JOIN (SELECT book_id, count(*) AS concepts FROM concept_books GROUP BY 1) USING (book_id)
 LEFT JOIN (SELECT learner_id, book_id, count(*) AS n, count(*) FILTER (WHERE status = 'active' AND due <= {AS_OF}) AS due FROM cards GROUP BY ALL) USING (learner_id, book_id)
 LEFT JOIN (SELECT learner_id, book_id, sum(ms) AS ms FROM rt GROUP BY ALL) USING (learner_id, book_id)""",
}

ORACLE = {
    "u1_block_weight": sql("SELECT block_id, type, weight FROM blocks", "blocks"),
    "u2_section_parents": sql("SELECT section_id, level, parent_id FROM tree", "sections", more=_TREE),
    "u3_inherit_kind": sql(
        "SELECT section_id, kind FROM k",
        "sections",
        more={**_TREE, "k": "SELECT section_id, kind FROM tree WHERE parent_id IS NULL UNION ALL SELECT c.section_id, CASE WHEN k.kind NOT IN ('body', 'exercises') THEN k.kind ELSE c.kind END FROM tree c JOIN k ON c.parent_id = k.section_id"},
    ),
    "u4_section_end_page": sql(f"SELECT section_id, page, end_page FROM ({_ENDS.format('sections')})", "sections", "books"),
    "u5_plan_units": sql(
        "SELECT section_id, is_unit, unit_id FROM k",
        "sections",
        "books",
        more={
            **_UNITS,
            "k": "SELECT section_id, true AS is_unit, section_id AS unit_id, end_page - page > 6 AND kids >= 2 AS splits FROM e WHERE parent_id IS NULL UNION ALL SELECT c.section_id, k.is_unit AND k.splits, CASE WHEN k.is_unit AND k.splits THEN c.section_id ELSE k.unit_id END, c.end_page - c.page > 6 AND c.kids >= 2 FROM e c JOIN k ON c.parent_id = k.section_id",
        },
    ),
    "u6_block_sections": sql("SELECT block_id, s.section_id FROM blocks b ASOF LEFT JOIN few s ON b.book_id = s.book_id AND b.block_id >= s.block_ord", "blocks", "sections", more=_SOME),
    "u7_default_sections": sql(
        """SELECT book_id, 'Front matter' AS title, 'front' AS kind, min(page) AS page, min(block_id) AS block_ord FROM b WHERE first IS NOT NULL AND block_id < first GROUP BY book_id
 UNION ALL SELECT book_id, 'Pages ' || (min(page) + 1) || '–' || (max(page) + 1), 'body', min(page), min(block_id) FROM b WHERE first IS NULL GROUP BY book_id, (page - low) // 15""",
        "blocks",
        "sections",
        more={
            **_SOME,
            "b": "SELECT book_id, block_id, CAST(unit_id // 7 AS INTEGER) AS page, (SELECT min(block_ord) FROM fronts WHERE fronts.book_id = blocks.book_id) AS first, min(CAST(unit_id // 7 AS INTEGER)) OVER (PARTITION BY book_id) AS low FROM blocks",
        },
    ),
    "u8_unit_weights": sql("SELECT unit_id, CAST(sum(weight) AS BIGINT) AS weight FROM blocks GROUP BY unit_id", "blocks"),
    "u8_book_weights": sql("SELECT * FROM bw", "blocks", "units", more={"bw": _SHELF["bw"]}),
    "u9_unit_at_page": sql(
        "SELECT p.book_id, p.page, coalesce(m.unit_id, s.unit_id) AS unit_id FROM p ASOF LEFT JOIN s ON p.book_id = s.book_id AND p.page >= s.page LEFT JOIN m ON p.book_id = m.book_id AND p.page = m.page",
        "blocks",
        "books",
        more={
            "p": "SELECT book_id, CAST(unnest(range(page_count)) AS INTEGER) AS page FROM books",
            "s": "SELECT book_id, CAST(unit_id // 60 AS INTEGER) AS page, max(unit_id) AS unit_id FROM units GROUP BY ALL",
            "m": "SELECT book_id, page, max_by(unit_id, (w, -unit_id)) AS unit_id FROM (SELECT book_id, CAST(unit_id // 60 AS INTEGER) AS page, unit_id, sum(weight) AS w FROM blocks GROUP BY ALL) GROUP BY ALL",
        },
    ),
    "u10_unit_pages": sql(
        "SELECT s.book_id, s.unit_id, s.page AS first_page, CAST(coalesce(nxt - 1, page_count - 1) AS INTEGER) AS last_page FROM s JOIN n USING (book_id, page) JOIN books USING (book_id)",
        "sections",
        "books",
        more={"s": "SELECT book_id, section_id AS unit_id, CAST(page // 9 AS INTEGER) AS page FROM sections", "n": "SELECT book_id, page, lead(page) OVER (PARTITION BY book_id ORDER BY page) AS nxt FROM (SELECT DISTINCT book_id, page FROM s)"},
    ),
    "u11_apply_page_reads": sql("SELECT learner_id, unit_id, page, min(seen) AS seen, CAST(sum(dwell_ms) AS BIGINT) AS dwell_ms FROM page_reads GROUP BY 1, 2, 3", "page_reads"),
    "u12_mark_units": sql(
        "SELECT learner_id, unit_id, count(*) AS n, min(seen) AS seen FROM (SELECT learner_id, block_id, unit_id, min(seen) AS seen FROM (SELECT * FROM reads WHERE unit_id % 2 = 0 UNION ALL SELECT m.learner_id, b.block_id, b.unit_id, m.seen FROM m JOIN blocks b USING (unit_id) WHERE unit_id % 2 = 0) GROUP BY ALL) GROUP BY ALL",
        "reads",
        more={"m": "SELECT learner_id, unit_id, min(seen) AS seen FROM page_reads GROUP BY ALL"},
    ),
    "u13_unit_progress": sql("SELECT learner_id, unit_id, round(CASE WHEN weight > 0 THEN least(1.0, read_weight / weight) ELSE 1.0 END, 9) AS fraction FROM read_w JOIN unit_w USING (unit_id)", "reads", more=_READ_W),
    "u14_section_progress": sql(
        "SELECT g.learner_id, u.book_id, u.unit_id, u.kind, round(CASE WHEN weight > 0 THEN least(1.0, coalesce(read_weight, 0) / weight) ELSE 0.0 END, 9) AS fraction FROM units u JOIN unit_w USING (unit_id) JOIN (SELECT DISTINCT learner_id, book_id FROM reads JOIN blocks USING (block_id)) g USING (book_id) LEFT JOIN read_w USING (learner_id, unit_id)",
        "reads",
        "units",
        more=_READ_W,
    ),
    "u15_units_finished": sql("SELECT * FROM done", "reads", more=_DONE),
    "u15_progress_steps": sql(
        "SELECT learner_id, unit_id, seen, CAST(floor(share * 20) AS INTEGER) AS step, was < 0.85 AND share >= 0.85 AS finished FROM p WHERE floor(was * 20) <> floor(share * 20) OR (was < 0.85 AND share >= 0.85)",
        "reads",
        more={**_DONE, "p": "SELECT learner_id, unit_id, seen, so_far / weight AS share, coalesce(lag(so_far) OVER (PARTITION BY learner_id, unit_id ORDER BY seen), 0) / weight AS was FROM steps JOIN unit_w USING (unit_id) WHERE weight > 0"},
    ),
    "u16_unlock_cards": sql("SELECT card_id, CASE WHEN status = 'pending' AND finished_at IS NOT NULL THEN 'active' ELSE status END AS status, CASE WHEN status = 'pending' AND finished_at IS NOT NULL THEN finished_at ELSE due END AS due FROM cards LEFT JOIN done USING (learner_id, unit_id)", "reads", "cards", more=_DONE),
    "u17_library": sql("SELECT * FROM lib", "reads", "cards", "shelf", "zones", "concept_books", more=_SHELF),
    "u18_library_totals": sql("SELECT learner_id, CAST(sum(due) AS BIGINT) AS due, CAST(sum(ms) AS BIGINT) AS ms, min_by(book_id, place) FILTER (WHERE status = 'ready' AND opened IS NOT NULL) AS book_id FROM lib GROUP BY learner_id", "reads", "cards", "shelf", "zones", "concept_books", more=_SHELF),
    "u19_pages_read": sql(
        "SELECT DISTINCT learner_id, unit_id, page FROM page_reads UNION SELECT learner_id, unit_id, page FROM (SELECT learner_id, b.unit_id, page, count(*) AS got FROM (SELECT DISTINCT learner_id, block_id FROM reads) JOIN blocks b USING (block_id) GROUP BY ALL) JOIN (SELECT unit_id, page, count(*) AS n FROM blocks GROUP BY ALL) USING (unit_id, page) WHERE got = n",
        "reads",
    ),
    "u20_reading_time": sql("SELECT * FROM rt", "page_reads", "units", "zones", more=_TIME),
    "u21_page_dwell": sql("SELECT learner_id, book_id, page, round(us / 1e6, 6) AS dwell_s, read FROM told", "blocks", more=dwell()),
    "u24_resume_page": sql(
        """SELECT learner_id, book_id, CAST(greatest(0, least(coalesce(saved, body, anyp, 0), page_count - 1)) AS INTEGER) AS page
 FROM (SELECT learner_id, book_id, max_by(ms % 700, (seen, ms % 700)) AS saved FROM times GROUP BY ALL) JOIN books USING (book_id)
 LEFT JOIN (SELECT book_id, min(page) FILTER (WHERE kind = 'body') AS body, min(page) AS anyp FROM sections GROUP BY book_id) USING (book_id)""",
        "page_reads",
        "sections",
        "books",
        more={"times": _TIME["times"]},
    ),
}
