"""Line dedup by a log-template tree.

A line is a list of tokens (words). Tokens with a digit are variable fields and become `<*>`. The tree has a fixed depth: the first
level is the token count, the next ones are the LEADING first tokens; a leaf holds the distinct masked lines that agree in these.
In a leaf that enough documents share, a position with more than BRANCHES different tokens is a variable field too; a line's
template is its tokens with those positions as `<*>`, unless less than half of them would stay, then it is the masked line itself.
A template found in more than LIMIT distinct texts recurs across documents: its lines are dropped from all documents but the first
(smallest doc_id) that has it. Exact copies of a text count once, so a line is not dropped for its document having been copied.

Lines are told apart by 64-bit hashes. Leaves that cannot reach the limit are never generalised. The tables of such leaves and of
dropped lines are sent to all tasks if they have no more than SMALL rows (counted first), and are joined by a shuffle beyond that.

Defined results: null text is empty; lines without words are kept and never counted; repeated rows are documents like others (all
rows with the first doc_id keep the line); a row without a doc_id is never the first, and loses its recurring lines; texts and lines of any length are read whole; empty tables give empty results; other
columns pass through `drop_templates`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import materialize

LEADING = 3
BRANCHES = 4
LIMIT = 100
SMALL = 1 << 18
FIELD = b"<*>"
_DIGIT = re.compile(rb"[0-9]")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masked(line: bytes) -> bytes:
    """The tokens of a line with variable fields as <*>, joined by single spaces; empty if there are none."""
    tokens = line.split()
    if _DIGIT.search(line):
        tokens = [FIELD if _DIGIT.search(t) else t for t in tokens]
    return b" ".join(tokens)


def leaf(line: bytes) -> int:
    """The leaf of a masked line: token count and leading tokens."""
    head = line.split(b" ", LEADING)[:LEADING]
    return _signed(xxh3_64_intdigest(b" ".join(head), line.count(b" ")))


def _key(line: bytes) -> int:
    return _signed(xxh3_64_intdigest(line))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_key, text) to one row for each distinct masked line."""
    for batch in batches:
        leaves, lines, rows = [], [], []
        for row, text in enumerate(batch.column(2)):
            own = {line for line in map(masked, (text.as_py() or "").encode().split(b"\n")) if line}
            leaves += map(leaf, own)
            lines += map(_key, own)
            rows += [row] * len(own)
        rows = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), pa.array(lines, pa.int64()), batch.column(1).take(rows), batch.column(0).take(rows)], names=["leaf", "line", "text_key", "doc_id"])


_LINE = "leaf long, line long, text_key long, doc_id long"


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _some_lines(wanted):
    """The masked lines of the wanted leaves (a broadcast set; None: of all)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves = wanted and wanted.value
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                for line in map(masked, (text or "").encode().split(b"\n")):
                    if line and ((at := leaf(line)) in leaves if leaves is not None else (at := leaf(line)) is not None):
                        key = _key(line)
                        if key not in seen:
                            if len(seen) > 1_000_000:
                                seen.clear()
                            seen.add(key)
                            rows.append((at, key, line.decode()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["leaf", "line", "masked"])

    return find


def templates(docs: DataFrame, limit: int = LIMIT, branches: int = BRANCHES) -> DataFrame:
    """line, first_doc: the masked lines (by hash) whose template recurs in more than limit texts."""
    text = F.col("text").cast("string")
    once = _keyed(docs).mapInArrow(_lines, _LINE).groupBy("leaf", "line", "text_key").agg(F.min("doc_id").alias("doc_id"))
    once = materialize(once, "lines")
    busy = materialize(once.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("leaf"), "leaves")
    if busy.count() <= SMALL:
        leaves = docs.sparkSession.sparkContext.broadcast({r["leaf"] for r in busy.collect()})
        found = docs.select(text).mapInArrow(_some_lines(leaves), "leaf long, line long, masked string")
    else:
        found = docs.select(text).mapInArrow(_some_lines(None), "leaf long, line long, masked string").join(busy, "leaf")
    found = materialize(found.groupBy("leaf", "line").agg(F.first("masked").alias("masked")).withColumn("tokens", F.split("masked", " ")).drop("masked"), "busy")
    places = found.select("leaf", F.posexplode("tokens").alias("at", "token")).groupBy("leaf", "at").agg(F.count_distinct("token").alias("kinds"))
    fields = places.groupBy("leaf").agg(F.count(F.lit(1)).alias("size"), F.collect_list(F.when(F.col("kinds") > branches, F.col("at"))).alias("fields")).filter("size(fields) > 0 and 2 * size(fields) <= size").select("leaf", "fields")
    general = F.transform("tokens", lambda t, i: F.when(F.array_contains(F.col("fields"), i), FIELD.decode()).otherwise(t))
    template = F.xxhash64("leaf", F.when(F.col("fields").isNull(), F.col("tokens")).otherwise(general))
    named = found.join(fields, "leaf", "left").select("line", template.alias("template"))
    shared = once.join(named, "line").groupBy("template", "text_key").agg(F.min("doc_id").alias("doc_id"))
    often = shared.groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).filter(F.col("n") > limit)
    return materialize(named.join(often, "template").select("line", "first_doc"), "dropped")


def _drop(text: str, goes) -> tuple[str, int, int]:
    """The text without the lines whose key goes, its lines and how many went."""
    lines = text.split("\n")
    kept = [x for x in lines if not (m := masked(x.encode())) or not goes(_key(m))]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def drop_templates(docs: DataFrame, limit: int = LIMIT, branches: int = BRANCHES) -> DataFrame:
    """_rest (the columns of docs but text), text without the dropped lines, n_lines, n_dropped."""
    gone = templates(docs, limit, branches)
    rest = F.struct(F.lit(None).cast("boolean").alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    text = F.col("text").cast("string")
    rows = docs.select(rest.alias("_rest"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_text_key"), F.coalesce(text, F.lit("")).alias("_text"))
    table = None
    if gone.count() <= SMALL:
        table = docs.sparkSession.sparkContext.broadcast({r["line"]: r["first_doc"] for r in gone.collect()})
    else:
        hits = _keyed(docs).mapInArrow(_lines, _LINE).join(gone, "line").filter(~F.col("doc_id").eqNullSafe(F.col("first_doc")) | F.col("doc_id").isNull())
        hits = hits.groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("_gone"))
        same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_text_key") == F.col("text_key"))
        rows = rows.join(hits, same, "left").select("_rest", "_id", "_text_key", "_text", "_gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = table and table.value
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                own = batch.column(1)[k].as_py()
                if first is not None:
                    goes = lambda key, own=own: key in first and (own is None or first[key] != own)
                else:
                    goes = set(batch.column(4)[k].as_py() or ()).__contains__
                found.append(_drop(batch.column(3)[k].as_py(), goes))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64())))], names=["_rest", "text", "n_lines", "n_dropped"])

    return rows.mapInArrow(run, f"_rest {rows.schema['_rest'].dataType.simpleString()}, text string, n_lines long, n_dropped long")


def without_templates(docs: DataFrame, **options) -> DataFrame:
    """docs without the dropped lines, all columns; n_chars, if there is such a column, follows the text."""
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return drop_templates(docs, **options).select(*[own.get(c, F.col(f"_rest.`{c}`")).alias(c) for c in docs.columns])


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_templates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("_rest.doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
