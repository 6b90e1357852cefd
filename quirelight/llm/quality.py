"""Quality rules (native): Gopher-like text measures, and cross-document line frequency.

Lines are normalised (A-Z lower-cased, ASCII white space squeezed and trimmed) and hashed. For each host (`source`) the distinct
document texts that hold a line are counted. A line above the limit is boilerplate: it is removed from every document but the
first (smallest doc_id) that has it, so that one place keeps it. A document that thereby loses most of its words is depleted and
is rejected. Exact copies count once, so a text is never called boilerplate for having been copied.

Defined results: null text is the empty text (no words, so base_failed); null source is a host of its own; empty tables give empty
results; repeated rows are judged one by one, each like a single one (all rows with the smallest doc_id keep a line); a null doc_id is
never a first document and loses no lines; other columns of the input are never read, except that `clean` passes them through, whatever their names.

Everything is DataFrame expressions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_LETTERS, SPACE, UPPER_LETTERS, let, text_of, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
#: A line is boilerplate in a host if more distinct texts hold it than this share of the host's texts, and than this many (a floor
#: against chance in small hosts).
LINE_DOCS, LINE_SHARE = 5, 0.005
#: A document that loses at least this share of its words is depleted.
LOST_SHARE = 0.7


def _n_repeat_words(words: Column) -> Column:
    """Words that lie in five-word windows found twice or more in the same text."""

    def covered(grams: Column) -> Column:
        ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = F.filter(
                F.transform(s, lambda e, k: F.when((F.get(s, k - 1)["g"] == e["g"]) | (F.get(s, k + 1)["g"] == e["g"]), e["i"])),
                lambda p: p.isNotNull(),
            )
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            step = lambda acc, p: F.struct((acc["n"] + p + WINDOW - F.greatest(acc["end"], p)).alias("n"), (p + WINDOW).alias("end"))
            return F.aggregate(F.sort_array(twice), start, step, lambda acc: acc["n"])

        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(ordered, places))

    grams = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(grams, covered))


def measures(docs: DataFrame, *carry: Column) -> DataFrame:
    """doc_id and the text measures n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed; carry: more columns to keep."""
    names = [c for c in docs.select(*carry).columns] if carry else []
    text = text_of()
    letters = F.translate(text, SPACE, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE, "") != "")
    by_word = lambda w: F.struct(F.size(w).alias("n_words"), _n_repeat_words(w).alias("n_repeat_words"))
    return (
        docs.select(
            "doc_id",
            *carry,
            let(words_of(text), by_word).alias("w"),
            F.length(letters).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        )
        .select("doc_id", *names, F.col("w.n_words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.n_repeat_words").cast("long").alias("n_repeat_words"))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    )


def _normal(line: Column) -> Column:
    return F.translate(F.btrim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")), UPPER_LETTERS, LOWER_LETTERS)


def _host() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def document_lines(docs: DataFrame) -> DataFrame:
    """One row for each line with a word of each row of docs: host, doc_id, text_key, at (its place), line_key, line_words."""
    lines = F.transform(F.split(text_of(), "\n"), lambda x, i: F.struct(_normal(x).alias("line"), i.alias("at")))
    keyed = F.transform(
        F.filter(lines, lambda x: x["line"] != ""),
        lambda x: F.struct(F.xxhash64(x["line"]).alias("line_key"), (F.length(x["line"]) - F.length(F.translate(x["line"], " ", "")) + 1).alias("line_words"), x["at"].alias("at")),
    )
    return docs.select(_host().alias("host"), "doc_id", F.xxhash64(text_of()).alias("text_key"), F.explode(keyed).alias("x")).select("host", "doc_id", "text_key", "x.at", "x.line_key", "x.line_words")


def frequent_lines(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """host, line_key, first_doc of the lines above the limit."""
    texts = docs.select(_host().alias("host"), F.xxhash64(text_of()).alias("text_key")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_texts"))
    once = document_lines(docs).groupBy("host", "line_key", "text_key").agg(F.min("doc_id").alias("first_doc"))
    return (
        once.groupBy("host", "line_key")
        .agg(F.count(F.lit(1)).alias("n_texts"), F.min("first_doc").alias("first_doc"))
        .filter(F.col("n_texts") > line_docs)
        .join(texts, "host")
        .filter(F.col("n_texts") > line_share * F.col("host_texts"))
        .select("host", "line_key", "first_doc")
    )


def assess(docs: DataFrame, *carry: Column, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, lost_share: float = LOST_SHARE) -> DataFrame:
    """The measures of every document with lost_words (in removed lines), lost_lines (their keys) and kept; carry: more columns to keep."""
    # a row is known by host, doc_id and text; rows that are equal in all three lose the same lines, counted once
    row = ["host", "doc_id", "text_key"]
    lost = (
        document_lines(docs)
        .join(frequent_lines(docs, line_docs, line_share), ["host", "line_key"])
        .filter(F.col("doc_id") != F.col("first_doc"))
        .dropDuplicates([*row, "at"])
        .groupBy(*[F.col(c).alias(f"_lost_{c}") for c in row])
        .agg(F.sum("line_words").alias("lost_words"), F.collect_set("line_key").alias("lost_lines"))
    )
    found = measures(docs, *carry, _host().alias("_host"), F.xxhash64(text_of()).alias("_text_key"))
    same = (found["_host"] == lost["_lost_host"]) & (found["doc_id"] == lost["_lost_doc_id"]) & (found["_text_key"] == lost["_lost_text_key"])
    return (
        found.join(lost, same, "left")
        .drop("_host", "_text_key", *[f"_lost_{c}" for c in row])
        .withColumn("lost_words", F.coalesce("lost_words", F.lit(0)).cast("long"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") < lost_share * F.col("n_words")))
    )


def clean(docs: DataFrame, **limits) -> DataFrame:
    """The documents that are kept, all columns, without the removed lines. n_chars, where there is such a column, follows the text."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    text = F.coalesce(F.col("_row.text").cast("string"), F.lit(""))
    rest = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col("lost_lines"), F.xxhash64(_normal(x)))), "\n")
    out = assess(docs, row, **limits).filter("kept").select("_row", F.when(F.col("lost_lines").isNull(), text).otherwise(rest).alias("_text"))
    own = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*[own.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words", "base_failed", "kept")


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host, {_WORDS} AS w FROM documents),
g AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS gram
      FROM (SELECT rid, w, unnest(range(1, CAST(len(w) - 3 AS BIGINT))) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n >= 2),
rep AS (SELECT rid, count(*) AS n_repeat_words
        FROM (SELECT DISTINCT rid, i + k AS p FROM twice, (SELECT unnest(range(0, 5)) AS k)) GROUP BY rid),
l0 AS (SELECT rid, doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT *, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM l0),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE norm <> '' GROUP BY rid),
texts AS (SELECT host, count(DISTINCT text) AS host_texts FROM d GROUP BY host),
freq AS (SELECT host, norm, count(DISTINCT text) AS n_texts, min(doc_id) AS first_doc FROM l WHERE norm <> '' GROUP BY host, norm),
over AS (SELECT freq.* FROM freq JOIN texts USING (host) WHERE n_texts > {LINE_DOCS} AND n_texts > {LINE_SHARE} * host_texts),
lost AS (SELECT l.rid, sum(length(l.norm) - length(replace(l.norm, ' ', '')) + 1) AS lost_words
         FROM l JOIN over USING (host, norm) WHERE l.doc_id <> over.first_doc GROUP BY l.rid),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             CAST(coalesce(lost_words, 0) AS BIGINT) AS lost_words
      FROM d LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN lost USING (rid))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_words < {LOST_SHARE} * n_words AS kept
FROM m
"""
