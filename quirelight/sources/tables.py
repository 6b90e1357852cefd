"""Reading and keeping the study tables: declared schemas, import dedup, book replacement and removal, merges, exports."""

from __future__ import annotations

import time
import uuid
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A test table; timestamps without a zone become timestamps."""
    out = spark.read.parquet(f"{d}/{name}.parquet")
    return out.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in out.dtypes])


MARK = "array<struct<s:int,e:int,f:int,ref:bigint>>"
SCHEMAS = {
    "books": "id long, title string, author string, file_hash string, page_count int, status string, weight long, body_size double, position struct<page:int>, warnings array<string>, added_at timestamp",
    "sections": "id long, book_id long, parent_id long, ord int, level int, title string, page int, block_id long, kind string, is_unit boolean, unit_id long, weight long",
    "blocks": f"id long, book_id long, unit_id long, section_id long, ord int, type string, level int, text string, marks {MARK}, page int, bbox array<double>, boxed int, label string, refs array<struct<key:string,block:bigint>>, weight int",
    "reads": "learner_id long, block_id long, unit_id long, at timestamp, dwell_ms long",
    "page_reads": "learner_id long, book_id long, page int, at timestamp, dwell_ms long",
    "reading_time": "learner_id long, book_id long, day date, ms long",
    "highlights": "id long, learner_id long, book_id long, block_id long, unit_id long, page int, start int, end int, quote string, color string, note string, created timestamp, updated timestamp",
    "versions": "id long, book_id long, page int, start int, end int, text string, source string, created timestamp, updated timestamp",
    "cards": "id long, learner_id long, book_id long, unit_id long, kind string, front string, back string, source string, status string, due timestamp, stability double, difficulty double, state int, reps int, lapses int, last_review timestamp, page int",
    "review_log": "id long, learner_id long, card_id long, rating int, state int, stability double, difficulty double, review timestamp, duration_ms long",
    "concepts": "key string, name string",
    "concept_books": "key string, book_id long, importance double, def_block_id long, definition string, source string",
    "mentions": "key string, block_id long, unit_id long, count int, is_def boolean",
    "edges": "a string, b string, book_id long, kind string, weight double, label string",
    "card_concepts": "card_id long, key string",
    "chats": "id long, learner_id long, book_id long, page int, title string, created timestamp",
    "chat_messages": "id long, chat_id long, role string, content string, quote string, page int, start int, end int, created timestamp",
    "unit_jobs": "unit_id long, job string, at timestamp",
}


def schema(name: str) -> T.StructType:
    return T._parse_datatype_string(SCHEMAS[name])


def load_tables(spark: SparkSession, d: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The study tables under d, by declared schema."""
    return {n: spark.read.schema(SCHEMAS[n]).parquet(f"{d}/{n}") for n in names or SCHEMAS}


def dedup_imports(files: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """Files (path, content, added_at) by content: the first copy wins, content that a book in order already has gets its id, a
    book in error is tried again. Names that are not PDF are skipped. Rows: file_hash, path, title, book_id, status."""
    pdf = files.filter(F.lower("path").endswith(".pdf")).withColumn("file_hash", F.sha2("content", 256))
    first = pdf.groupBy("file_hash").agg(F.min_by("path", F.struct("added_at", "path")).alias("path"))
    name = F.regexp_replace(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.pdf$", ""), "_", " ")
    out = first.withColumn("title", name)
    if books is None:
        return out.withColumns({"book_id": F.lit(None).cast("long"), "status": F.lit("importing")})
    known = books.select("file_hash", F.col("id").alias("book_id"), F.col("status").alias("was"))
    return out.join(known, "file_hash", "left").withColumn("status", F.when(F.col("was").isNull() | (F.col("was") == "error"), "importing").otherwise(F.col("was"))).drop("was")


#: Child table, its column, parent table: a row goes with the row of the parent (whose key is in KEYS) that it points to.
FOREIGN_KEYS = [
    ("sections", "book_id", "books"), ("blocks", "book_id", "books"), ("page_reads", "book_id", "books"), ("reading_time", "book_id", "books"),
    ("highlights", "book_id", "books"), ("versions", "book_id", "books"), ("cards", "book_id", "books"), ("concept_books", "book_id", "books"),
    ("edges", "book_id", "books"), ("chats", "book_id", "books"), ("reads", "block_id", "blocks"), ("mentions", "block_id", "blocks"),
    ("unit_jobs", "unit_id", "sections"), ("review_log", "card_id", "cards"), ("card_concepts", "card_id", "cards"), ("chat_messages", "chat_id", "chats"),
    ("concept_books", "key", "concepts"), ("mentions", "key", "concepts"), ("edges", "a", "concepts"), ("edges", "b", "concepts"), ("card_concepts", "key", "concepts"),
]
KEYS = {"books": "id", "sections": "id", "blocks": "id", "cards": "id", "chats": "id", "concepts": "key"}
#: What belongs to a book's content and goes with it, besides what hangs on it; what readers did on its pages (highlights, versions,
#: page_reads) stays.
CONTENT = ("blocks", "sections", "mentions", "edges", "concept_books", "cards", "reads")


def delete_rows(tables: dict[str, DataFrame], gone: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables without the rows whose keys are in gone (table to a frame of its key) and without what points to them, directly or
    through other rows. Parents come before children, so one anti join an edge does it: a child is met with the keys of the parent rows
    that go, which are few where few books go. Rows that point nowhere, or to a parent that was never there, stay."""
    order = TopologicalSorter({t: set() for t in tables})
    for child, _, parent in FOREIGN_KEYS:
        if child in tables and parent in tables:
            order.add(child, parent)
    gone, out = dict(gone), dict(tables)
    for name in order.static_order():
        df = out[name]
        edges = [(column, gone[parent].select(F.col(KEYS[parent]).alias(column)).distinct()) for child, column, parent in FOREIGN_KEYS if child == name and parent in gone and column in df.columns]
        key = KEYS.get(name)
        if name in gone:
            edges.append((key, gone[name].select(key).distinct()))
        if not edges:
            continue
        pointed_to = any(parent == name and child in tables for child, _, parent in FOREIGN_KEYS)
        lost = [df.join(keys, column, "left_semi").select(key) for column, keys in edges] if pointed_to else []
        for column, keys in edges:
            df = df.join(keys, column, "left_anti")
        out[name] = df.select(tables[name].columns)
        if lost:
            gone[name] = reduce(DataFrame.unionByName, lost)
    return out


def _without_lonely_concepts(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Concepts that no book has go, and what points to them."""
    if "concepts" not in tables or "concept_books" not in tables:
        return tables
    return delete_rows(tables, {"concepts": tables["concepts"].join(tables["concept_books"].select("key"), "key", "left_anti")})


def replace_books(tables: dict[str, DataFrame], new: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """S3: all tables with the content of the books in ids (book_id) taken out, and what hangs on it (reviews of their cards, reads of their
    blocks), and the rows of new put in; new concepts are added if their key is new."""
    whole = [t for t in CONTENT if t in tables and t in KEYS]
    out = delete_rows(tables, {t: tables[t].join(ids, "book_id", "left_semi") for t in whole})
    for name in CONTENT:
        if name in out and name not in KEYS and "book_id" in out[name].columns:
            out[name] = out[name].join(ids, "book_id", "left_anti").select(tables[name].columns)
    for name in CONTENT:
        if name in new:
            out[name] = out[name].unionByName(new[name])
    if "books" in new:
        key = ids.select(F.col("book_id").alias("id"))
        out["books"] = tables["books"].join(key, "id", "left_anti").select(tables["books"].columns).unionByName(new["books"])
    if "concepts" in new:
        out["concepts"] = out["concepts"].unionByName(new["concepts"].join(tables["concepts"].select("key"), "key", "left_anti").select(tables["concepts"].columns))
    return out


def publish(tables: dict[str, DataFrame], root: str) -> str:
    """S3: write all tables as one new version under root and then, in one step, make it the current one. A reader sees the old version or
    the new one whole; a job that fails leaves only a folder that nobody names."""
    spark = next(iter(tables.values())).sparkSession
    version = f"v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/current/{time.time_ns():020d}-{version}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, False).close()
    return version


def current(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """S3: the tables of the version published last under root."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/current")
    found = [x.getPath().getName() for x in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    version = max(found).partition("-")[2]
    return {n: spark.read.parquet(f"{root}/{version}/{n}") for n in names}


def remove_books(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the books in ids (book_id) and everything that hangs on them, and then without concepts that no book has."""
    return _without_lonely_concepts(delete_rows(tables, {"books": ids.select(F.col("book_id").alias("id"))}))


def orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """child, column, n: rows that point to a parent that is not there, for every foreign key."""
    found = []
    for child, column, parent in FOREIGN_KEYS:
        if child in tables and parent in tables and column in tables[child].columns:
            keys = tables[parent].select(F.col(KEYS[parent]).alias(column)).distinct()
            lost = tables[child].filter(F.col(column).isNotNull()).join(keys, column, "left_anti")
            found.append(lost.agg(F.count(F.lit(1)).alias("n")).select(F.lit(child).alias("child"), F.lit(column).alias("column"), "n"))
    return reduce(DataFrame.union, found)


def merge_rows(base: DataFrame, delta: DataFrame, keys: list[str], rules: dict[str, str], order: str | None = None) -> DataFrame:
    """Upsert. rules per column: sum, max, min, keep (base's value), replace (delta's), fill (base's unless null). Several delta
    rows of one key count in `order`."""
    rows = base.withColumn("_new", F.lit(0)).unionByName(delta.withColumn("_new", F.lit(1)))
    at = F.struct("_new", order) if order else F.col("_new")

    def merged(c: str, rule: str) -> Column:
        if rule in ("sum", "max", "min"):
            return getattr(F, rule)(c)
        if rule == "replace":
            return F.max_by(c, at)
        if rule == "fill":
            return F.min_by(c, F.when(F.col(c).isNotNull(), at))
        return F.min_by(c, at)

    return rows.groupBy(*keys).agg(*[merged(c, rules.get(c, "keep")).alias(c) for c in base.columns if c not in keys]).select(*base.columns)


#: Rows of a book that make one part of an export.
PART_ROWS = 1000


def _parts(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """rows with part: runs of `size` rows of a book in this order, as a reader may put them together one by one; no row of the result
    holds a whole book, however long it is. Runs are numbered over (book_id, page), so a long book is not sorted in one task."""
    w = Window.partitionBy("book_id", "page").orderBy(*order)
    pages = rows.groupBy("book_id", "page").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("book_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("_at", F.row_number().over(w) - 1).join(pages.select("book_id", "page", before.alias("_before")), ["book_id", "page"])
    at = F.col("_at") + F.col("_before")
    return placed.withColumns({"place": at, "part": F.floor(at / size).cast("long")}).drop("_at", "_before")


def export_notes(highlights: DataFrame, size: int = PART_ROWS) -> DataFrame:
    """book_id, part, markdown: rows in (page, start) order, a heading where the unit changes; parts in order are the book's notes.
    highlights: book_id, title, unit, page, start, id, quote, note."""
    order = ["start", "id"]
    unit = F.coalesce(F.when(F.col("unit") != "", F.col("unit")), F.lit("Notes"))
    rows = _parts(highlights.withColumn("unit", unit), order, size)
    # what stands before a page's first row is the last row of the page before that has any
    inside = Window.partitionBy("book_id", "page").orderBy(*order)
    ends = rows.groupBy("book_id", "page").agg(F.max_by("unit", "place").alias("_end"))
    ends = ends.select("book_id", "page", F.lag("_end").over(Window.partitionBy("book_id").orderBy("page")).alias("_end"))
    rows = rows.withColumns({"_last": F.lag("unit").over(inside), "_first": F.row_number().over(inside) == 1}).join(ends, ["book_id", "page"])
    new = F.coalesce(F.when(F.col("_first"), F.col("_end")).otherwise(F.col("_last")) != F.col("unit"), F.lit(True))
    note = F.trim(F.coalesce("note", F.lit("")))
    piece = F.concat(
        F.when(F.col("place") == 0, F.concat(F.lit("# "), "title", F.lit("\n\n"))).otherwise(""), F.when(new, F.concat(F.lit("## "), "unit", F.lit("\n\n"))).otherwise(""),
        F.lit("> "), F.translate("quote", "\n", " "), F.lit("\n"), F.when(note != "", F.concat(F.lit("\n"), note, F.lit("\n"))).otherwise(""),
    )
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", piece.alias("md")))), lambda x: x["md"]), "\n")
    return rows.groupBy("book_id", "part").agg(text.alias("markdown"))


def dump_markdown(blocks: DataFrame, size: int = PART_ROWS) -> DataFrame:
    """book_id, part, markdown: blocks of a book as Markdown, one rendering for each type; parts in order are the book. blocks:
    book_id, ord, type, level, label, text, page (pages do not fall along ord)."""
    where = F.concat(F.lit("<!-- p"), F.col("page") + 1, F.lit(" -->"))
    label = F.coalesce("label", F.lit(""))
    kind = F.col("type")
    md = (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), "level")), F.lit(" "), F.when(label != "", F.concat(label, F.lit(" · "))).otherwise(""), "text", F.lit(" "), where))
        .when(kind == "code", F.concat(F.lit("``` "), where, F.lit("\n"), "text", F.lit("\n```")))
        .when(kind.isin("figure", "equation", "table"), F.concat(F.lit("["), F.upper(kind), F.lit(" p"), F.col("page") + 1, F.lit("] "), F.substring("text", 1, 160)))
        .when(kind == "footnote", F.concat(F.lit("> [^"), label, F.lit("] "), "text", F.lit(" "), where))
        .when(kind == "caption", F.concat(F.lit("*caption:* "), "text", F.lit(" "), where))
        .when(kind == "list", F.concat(F.repeat(F.lit("  "), F.col("level")), label, F.lit(" "), "text", F.lit(" "), where))
        .otherwise(F.concat("text", F.lit(" "), where))
    )
    rows = _parts(blocks.withColumn("_md", md), ["ord"], size).groupBy("book_id", "part").agg(F.sort_array(F.collect_list(F.struct("place", F.col("_md").alias("md")))).alias("x"))
    return rows.select("book_id", "part", F.array_join(F.transform("x", lambda x: x["md"]), "\n\n").alias("markdown"))


def profile_books(blocks: DataFrame, types: list[str], parts: dict[str, DataFrame] | None = None, warnings: DataFrame | None = None) -> DataFrame:
    """Blocks of each type, units and weight per book; n_<name> for each of parts (sections, concepts, edges, cards: tables with
    book_id, counted as they are); and the book's warnings (book_id, warning), joined by line breaks. A book that stands in one of the
    tables has a row."""
    out = blocks.groupBy("book_id").agg(
        *[F.count(F.when(F.col("type") == t, 1)).alias(f"n_{t}") for t in types], F.count_distinct("unit_id").alias("n_units"), F.sum("weight").alias("weight")
    )
    for name, part in (parts or {}).items():
        out = out.join(part.groupBy("book_id").agg(F.count(F.lit(1)).alias(f"n_{name}")), "book_id", "full")
    out = out.fillna(0)
    if warnings is None:
        return out
    told = warnings.groupBy("book_id").agg(F.array_join(F.sort_array(F.collect_set("warning")), "\n").alias("warnings"))
    return out.join(told, "book_id", "full").fillna(0).fillna("", ["warnings"])
