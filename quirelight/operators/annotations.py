"""Annotations and the geometry of passages. A page's text is its lines joined by line breaks; ranges are [start, end) in it, in code
points from 0. page_lines: book_id, page, line, start (offset of the line), text, x0, y0, x1, y1, and step: a character's width."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import apart_places, bound, clean_text, folded_places, folded_text, places_of


def _touched(ranges: DataFrame, page_lines: DataFrame) -> DataFrame:
    lines = page_lines.withColumn("stop", F.col("start") + F.length("text")).withColumnRenamed("start", "at")
    return ranges.join(lines, ["book_id", "page"]).filter((F.col("at") < F.col("end")) & (F.col("stop") > F.col("start")))


def range_rects(ranges: DataFrame, page_lines: DataFrame) -> DataFrame:
    """One rectangle for each line a range touches. ranges: range_id, book_id, page, start, end."""
    first = F.greatest(F.lit(0), F.col("start") - F.col("at"))
    last = F.least(F.length("text"), F.col("end") - F.col("at"))
    return _touched(ranges, page_lines).select("range_id", "line", (F.col("x0") + first * F.col("step")).alias("x0"), "y0", (F.col("x0") + last * F.col("step")).alias("x1"), "y1")


def range_box(ranges: DataFrame, page_lines: DataFrame) -> DataFrame:
    """The box around a range."""
    return range_rects(ranges, page_lines).groupBy("range_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def range_in_rect(rects: DataFrame, page_lines: DataFrame) -> DataFrame:
    """rect_id, start, end: the characters whose middles are in a rectangle, of lines whose middles are. rects: rect_id, book_id,
    page, rx0, ry0, rx1, ry1."""
    middle = (F.col("y0") + F.col("y1")) / 2
    rows = rects.join(page_lines, ["book_id", "page"]).filter((middle >= F.col("ry0")) & (middle <= F.col("ry1")))
    first = F.greatest(F.lit(0), F.ceil((F.col("rx0") - F.col("x0")) / F.col("step") - 0.5))
    last = F.least(F.length("text"), F.floor((F.col("rx1") - F.col("x0")) / F.col("step") - 0.5) + 1)
    rows = rows.select("rect_id", (F.col("start") + first).alias("a"), (F.col("start") + last).alias("b")).filter("a < b")
    return rows.groupBy("rect_id").agg(F.min("a").cast("long").alias("start"), F.max("b").cast("long").alias("end"))


def anchor(ranges: DataFrame, page_lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """range_id, block_id: the block nearest (by the sum of both distances) to the range's first point, else the first on the page.
    blocks: book_id, page, block_id, bx0, by0, bx1, by1 (null: no box)."""
    point = range_rects(ranges, page_lines).groupBy("range_id").agg(F.min_by(F.struct("x0", "y0"), "line").alias("p"))
    apart = lambda v, lo, hi: F.greatest(F.lit(0.0), F.col(lo) - v, v - F.col(hi))
    rows = ranges.join(point, "range_id", "left").join(blocks, ["book_id", "page"])
    distance = F.coalesce(apart(F.col("p.x0"), "bx0", "bx1") + apart(F.col("p.y0"), "by0", "by1"), F.lit(1e18))
    return rows.groupBy("range_id").agg(F.min_by("block_id", F.struct(distance, "block_id")).alias("block_id"))


def list_highlights(highlights: DataFrame, units: DataFrame, color: str | None = None, text: str | None = None, with_notes: bool = False) -> DataFrame:
    """Highlights with their unit's title, in reading order (place from 1 in the book)."""
    rows = highlights.join(units.select("unit_id", F.col("title").alias("unit")), "unit_id", "left")
    if color is not None:
        rows = rows.filter(F.col("color") == color)
    if text:
        rows = rows.filter(F.lower("quote").contains(text.lower()) | F.lower("note").contains(text.lower()))
    if with_notes:
        rows = rows.filter(F.trim("note") != "")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("book_id").orderBy("page", "start", "id")))


def latest_versions(changes: DataFrame) -> DataFrame:
    """The last text of each passage; empty ones are refused, line ends are line feeds. changes: book_id, page, start, end, text,
    changed, change_id."""
    text = F.regexp_replace("text", r"\r\n?", "\n")
    return changes.filter(F.trim("text") != "").groupBy("book_id", "page", "start", "end").agg(F.max_by(text, F.struct("changed", "change_id")).alias("text"), F.min("changed").alias("created"), F.max("changed").alias("updated"))


def annotations(highlights: DataFrame, versions: DataFrame, chats: DataFrame, pages_read: DataFrame) -> DataFrame:
    """What a book's pages carry, as one table: book_id, page, kind, id, start, text."""
    h = highlights.filter("start is not null").select("book_id", "page", F.lit("highlight").alias("kind"), "id", "start", F.col("quote").alias("text"))
    v = versions.select("book_id", "page", F.lit("version"), F.xxhash64("book_id", "page", "start", "end"), "start", "text")
    first = chats.groupBy("book_id", "page", "chat_id").agg(F.min(F.struct("start", "id")).alias("x"))
    c = first.select("book_id", "page", F.lit("chat"), F.col("chat_id"), "x.start", F.lit(None).cast("string"))
    r = pages_read.select("book_id", "page", F.lit("read"), F.lit(None).cast("long"), F.lit(None).cast("int"), F.lit(None).cast("string"))
    return h.union(v).union(c).union(r)


def place_quotes(quotes: DataFrame, page_text: DataFrame) -> DataFrame:
    """quote_id, page, start, end: where a quote stands on its page or the next, nearest to its hint, whatever its white space,
    case and line-end hyphens; unplaced quotes are not returned. quotes: quote_id, book_id, page, hint, quote."""
    q = quotes.withColumn("f", folded_text(F.col("quote"))).filter("f <> ''").select("quote_id", "book_id", F.explode(F.array("page", F.col("page") + 1)).alias("page"), F.col("page").alias("own"), "hint", "f")
    pages = page_text.join(q.select("book_id", "page").distinct(), ["book_id", "page"], "left_semi").select("book_id", "page", "text", folded_text(F.col("text")).alias("folded"))
    rows = q.join(pages, ["book_id", "page"]).filter(F.col("folded").contains(F.col("f")))
    starts = F.transform(places_of(F.col("folded"), F.col("f")), lambda i: i - 1)
    each = rows.select("quote_id", "page", "own", "hint", F.explode(_as_written(F.col("text"), starts, F.length("f"))).alias("x"))
    found = each.select("quote_id", "page", "x.*", F.struct((F.col("page") != F.col("own")).alias("a"), F.abs(F.col("x.start") - F.col("hint")).alias("b"), F.col("x.start").alias("c")).alias("order"))
    return found.groupBy("quote_id").agg(F.min_by(F.struct("page", "start", "end"), "order").alias("x")).select("quote_id", "x.*")


def _as_written(text: Column, places: Column, n: Column) -> Column:
    """Start and end in text of n folded characters at each of places (from 0): a row carries its ranges, not the map of its page."""
    of = F.struct(folded_places(text).alias("map"), places.alias("at"), n.alias("n"))
    return bound(of, lambda x: F.transform(x["at"], lambda i: F.struct(F.get(x["map"], i).alias("start"), (F.get(x["map"], i + x["n"] - 1) + 1).alias("end"))))


def find_all(queries: DataFrame, page_text: DataFrame, limit: int = 200) -> DataFrame:
    """query_id, page, start, end, place: every place of words on the pages of a book, whatever their white space, case and line-end
    hyphens; places of one word do not overlap. A page has at most `limit` places, the first words' first, in order (place from 1). Words
    of one letter are not looked for. queries: query_id, book_id, words (array)."""
    asked = queries.select("query_id", "book_id", F.posexplode("words").alias("no", "word")).withColumn("f", folded_text(F.col("word"))).filter("length(f) >= 2")
    pages = page_text.join(queries.select("book_id").distinct(), "book_id", "left_semi").select("book_id", "page", "text", folded_text(F.col("text")).alias("folded"))
    rows = asked.join(pages, "book_id").filter(F.col("folded").contains(F.col("f")))
    places = _as_written(F.col("text"), apart_places(F.col("folded"), F.col("f")), F.length("f"))
    found = rows.select("query_id", "page", "no", F.explode(places).alias("x")).select("query_id", "page", "no", "x.*")
    page = Window.partitionBy("query_id", "page")
    kept = found.withColumn("_r", F.row_number().over(page.orderBy("no", "start"))).filter(F.col("_r") <= limit)
    return kept.withColumn("place", F.row_number().over(page.orderBy("start", "no"))).drop("_r", "no")


def split_selection(selections: DataFrame, page_text: DataFrame) -> DataFrame:
    """One cleaned quote and range for each page a selection covers; the note stays on the first. selections: selection_id, book_id,
    page0, start, page1, end, note."""
    rows = selections.select("*", F.explode(F.sequence("page0", "page1")).alias("page")).join(page_text, ["book_id", "page"])
    a = F.when(F.col("page") == F.col("page0"), F.col("start")).otherwise(0)
    b = F.when(F.col("page") == F.col("page1"), F.least(F.col("end"), F.length("text"))).otherwise(F.length("text"))
    rows = rows.withColumns({"a": a, "b": b}).filter("a < b")
    note: Column = F.when(F.col("page") == F.col("page0"), F.col("note")).otherwise("")
    return rows.select("selection_id", "page", F.col("a").alias("start"), F.col("b").alias("end"), clean_text(F.substring("text", F.col("a") + 1, F.col("b") - F.col("a"))).alias("quote"), note.alias("note"))
