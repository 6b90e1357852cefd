"""Document fingerprints: a Merkle tree over sections, paragraphs and their pieces.

Leaves are pieces of a paragraph (a line): it is cut after a word whose hash is 0 mod 4, so the cuts are set by the content and an
edit moves only those beside it. A paragraph's node hashes its pieces, a section's its paragraphs, the root its sections. A section
ends at a blank line, or after a paragraph whose hash is 0 mod 8. The fingerprint string is the tree itself:

    root;section.weight(paragraph.weight[piece.weight,piece.weight]paragraph.weight[...])section.weight(...)

with hexadecimal hashes and each node's weight in code points (of its pieces; line breaks weigh nothing). Equal texts have equal
strings; equal roots mean equal texts; where roots differ, trees are walked from the sections down: equal branches are matched
whole, only the others are opened, and the differing pieces locate the edit (`differences`).

Likeness is the share of code points in matched branches (as multisets): 2 * common / (all of both), 1 if the roots are equal. It
is what the pieces alone would give, since taking equal branches from both sides takes equal pieces from both.

Defined results: null text is the empty text; texts of any length, without any line break too, are cut the same way; repeated rows
have equal fingerprints; with one document, its next document is itself; rows without a doc_id come after all others in descending
order; ties in doc_id follow the text's hash, descending; rows with equal texts and ids are equal. The number of ranges changes nothing.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_hexdigest, xxh3_64_intdigest

from .common import let, shuffle_partitions, text_of

CUT, SECTION = 4, 8
#: Where rows without a doc_id stand.
NO_ID = -(1 << 63)
WORD = re.compile(r"\S+\s*|\s+")


def pieces(paragraph: str) -> list[str]:
    """The leaves of a paragraph: content-defined runs of words, about CUT words each."""
    out, start, at = [], 0, 0
    for word in WORD.findall(paragraph):
        at += len(word)
        if xxh3_64_intdigest(word) % CUT == 0:
            out.append(paragraph[start:at])
            start = at
    if start < len(paragraph):
        out.append(paragraph[start:])
    return out


def _paragraph(text: str, memory: dict) -> str:
    """A paragraph's node: its hash, weight and leaves."""
    node = memory.get(text)
    if node is None:
        leaves = ",".join([f"{xxh3_64_hexdigest(p)[:8]}.{len(p)}" for p in pieces(text)])
        if len(memory) > 20_000:
            memory.clear()
        node = memory[text] = f"{xxh3_64_hexdigest(text + chr(10))}.{len(text)}[{leaves}]"
    return node


def fingerprint(text: str, memory: dict | None = None) -> str:
    """The tree of a text as a string. memory: nodes of paragraphs that were seen before."""
    memory = {} if memory is None else memory
    sections, own, weight = [], [], 0

    def close() -> None:
        nonlocal own, weight
        body = "".join(own)
        sections.append(f"{xxh3_64_hexdigest(body)}.{weight}({body})")
        own, weight = [], 0

    for line in text.split("\n"):
        node = _paragraph(line, memory if len(line) < 4096 else {})
        own.append(node)
        weight += len(line)
        if not line.strip() or int(node[:16], 16) % SECTION == 0:
            close()
    if own:
        close()
    return f"{hashlib.blake2b(''.join(n[:16] for n in sections).encode(), digest_size=16).hexdigest()};{''.join(sections)}"


SECTION_NODE = re.compile(r"([0-9a-f]{16}\.\d+)\(([^)]*)\)")
PARAGRAPH_NODE = re.compile(r"([0-9a-f]{16}\.\d+)\[([^]]*)\]")


def _weight(node: str) -> int:
    return int(node.rpartition(".")[2])


def _open(nodes: list[tuple[str, str]], others: list[tuple[str, str]]) -> tuple[int, list[str], list[str]]:
    """Weight of the nodes (name, what is inside) that both sides have, and what is inside the others of either side."""
    if not nodes or not others:
        return 0, [x for _, x in nodes], [x for _, x in others]
    both = Counter(n for n, _ in nodes) & Counter(n for n, _ in others)
    weight = sum(_weight(n) * times for n, times in both.items())
    rest = []
    for side in (nodes, others):
        left = Counter(both)
        inside = []
        for name, body in side:
            if left[name]:
                left[name] -= 1
            else:
                inside.append(body)
        rest.append(inside)
    return weight, *rest


def _total(tree: str) -> int:
    return sum(_weight(n) for n, _ in SECTION_NODE.findall(tree))


def common(a: str, b: str) -> tuple[int, Counter]:
    """The weight that two trees have in common, walking down where they differ; and the leaves of a that b has not."""
    weight, a_rest, b_rest = _open(SECTION_NODE.findall(a), SECTION_NODE.findall(b))
    more, a_rest, b_rest = _open(PARAGRAPH_NODE.findall("".join(a_rest)), PARAGRAPH_NODE.findall("".join(b_rest)))
    x, y = (Counter(",".join(filter(None, rest)).split(",")) for rest in (a_rest, b_rest))
    x.pop("", None)
    both = x & y
    return weight + more + sum(_weight(n) * times for n, times in both.items()), x - y


def likeness(a: str, b: str) -> float:
    """0 to 1; equal roots need no look at the branches."""
    if a[:32] == b[:32]:
        return 1.0
    total = _total(a) + _total(b)
    return 2 * common(a, b)[0] / total if total else 0.0


def differences(a: str, b: str) -> list[tuple[int, int]]:
    """Ranges of code points (in the text of a, line breaks counted) whose leaves b has not; equal branches are skipped whole."""
    if a[:32] == b[:32]:
        return []
    sections, paragraphs = ({n for n, _ in found.findall(b)} for found in (SECTION_NODE, PARAGRAPH_NODE))
    gone = common(a, b)[1]
    out, at = [], 0
    for section, body in SECTION_NODE.findall(a):
        for paragraph, leaves in PARAGRAPH_NODE.findall(body):
            if section in sections or paragraph in paragraphs or not leaves:
                at += _weight(paragraph) + 1
                continue
            for leaf in leaves.split(","):
                end = at + _weight(leaf)
                if leaf in gone:
                    if out and out[-1][1] == at:
                        out[-1] = (out[-1][0], end)
                    else:
                        out.append((at, end))
                at = end
            at += 1
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t or "", memory) for t in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


PAIRED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edit_start long"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range, descending doc_id; each is paired with the row after it. Rows of the next range's head (own false) end it."""
    memory: dict = {}
    last = None
    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            _, doc_id, text, own = row
            tree = fingerprint(text, memory)
            if last is not None and last[3]:
                n = len(last[1]) // 3
                edited = last[1][: len(last[1]) - n] + text[:n]
                edited_tree = fingerprint(edited, memory)
                where = differences(last[2], edited_tree)
                out.append((last[0], len(last[1]), hashlib.sha256(edited.encode()).hexdigest(), last[2], edited_tree, likeness(last[2], edited_tree), likeness(last[2], tree), where[0][0] if where else None))
            last = (doc_id, text, tree, own)
        columns = zip(*out, strict=True) if out else [[]] * 8
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edit_start"])


def _rank(borders: list[tuple[int, int]], at: Column, tie: Column) -> Column:
    """How many of the ascending borders are below (at, tie), looked up in two steps of about the root of their number."""
    if not borders:
        return F.lit(0)
    below = lambda b: (b["at"] < at) | (b["at"] == at) & (b["tie"] < tie)
    array = lambda some: F.array(*[F.struct(F.lit(x).cast("long").alias("at"), F.lit(y).cast("long").alias("tie")) for x, y in some])
    step = math.isqrt(len(borders) - 1) + 1
    ends = borders[step - 1 :: step]
    blocks = F.size(F.filter(array(ends), below)) if ends else F.lit(0)
    return let(blocks, lambda n: n * step + F.size(F.filter(F.slice(array(borders), n * step + 1, step), below)))


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document, by descending doc_id; edit_start is the
    first code point of the text in a leaf that the edited text has not.

    Rows go to ranges of (doc_id, hash of the text), whose borders come from a sketch of the ids; an id with many rows is cut by the
    hash. The head of each range is sent to the range before it too, and the head of all to the last. So a range is one task that
    reads its rows in order, and texts are shuffled once."""
    at, tie = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64(text_of())
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), at.alias("at"), tie.alias("tie"))
    ranges = ranges or shuffle_partitions(docs.sparkSession)
    ids = docs.select(F.col("at").cast("double").alias("x"))
    at_shares = np.linspace(0, 1, ranges + 1)[1:-1].tolist()
    found = Counter(int(b) for b in ids.stat.approxQuantile("x", at_shares, 1 / (4 * ranges))) if at_shares else Counter()
    top = (1 << 63) - 1
    # an id that several borders fall on is cut into as many parts, and ends with a border
    borders = sorted({(max(b, NO_ID), top if k == times - 1 else -top + 2 * top * (k + 1) // times) for b, times in found.items() for k in range(times)})
    ranged = docs.withColumn("range", (F.lit(len(borders)) - _rank(borders, F.col("at"), F.col("tie"))).cast("int"))
    heads = {r["range"]: r["head"] for r in ranged.groupBy("range").agg(F.max(F.struct("at", "tie")).alias("head")).collect()}
    if not heads:
        return docs.sparkSession.createDataFrame([], PAIRED)
    order = sorted(heads)
    before = {n: order[k - 1] for k, n in enumerate(order)}
    of = lambda value: F.get(F.array(*[F.lit(value(n) if n in heads else None).cast("long") for n in range(len(borders) + 1)]), F.col("range"))
    head = (F.col("at") == of(lambda n: heads[n]["at"])) & (F.col("tie") == of(lambda n: heads[n]["tie"]))
    own = F.struct(F.col("range").alias("range"), F.lit(True).alias("own"))
    to = F.struct(F.when(head, of(before.get)).cast("int").alias("range"), F.lit(False).alias("own"))
    rows = ranged.select("doc_id", "text", "at", "tie", F.explode(F.filter(F.array(own, to), lambda x: x["range"].isNotNull())).alias("_to"))
    rows = rows.select(F.col("_to.range").alias("range"), "doc_id", "text", F.col("_to.own").alias("own"), "at", "tie")
    sent = rows.repartitionById(len(borders) + 1, F.col("range")).sortWithinPartitions(F.desc("own"), F.desc("at"), F.desc("tie"))
    return sent.select("range", "doc_id", "text", "own").mapInArrow(_pairs, PAIRED)


def op9_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
