r"""Conversation structure repair: the cheapest edits that give a conversation's roles the form `(s?(ua)+)?`, the least of them by audit.

The rows of all conversations are put in order by one range partitioning; a conversation's rows in one partition are a block, so a
conversation that holds most rows is many blocks, and a block is bounded by a partition's size. A row is reduced to one letter (class of
its role's initial; sound, truncated or to be deleted). Equal rows are counted, not sorted: all but the first are to be deleted.

1. Blocks of conversations with several blocks give the least costs between the four states (nothing yet, after s, after u, after a):
   4 x 4 numbers, combined from the last block back to what each block costs from its end on.
2. In each block, the cost DP runs backwards over (place, state) nodes. Of each node's optimal arcs, ranks of audits of length one pick
   the least; then nodes are ranked by their audits of length 2, 4, 8, ..., each time by the pair (own rank, rank of the node that the
   pointer leads to), and pointers are doubled. Labels at a node lead to different nodes, so the least audit is one path, and the node at
   place p of it is read through the pointers of the bits of p. No optimal audit is a proper beginning of another (it would cost more).
3. Ends of blocks are chained from state to state, and each block's rows are edited by its part of the audit.

Faults of a row, the first that holds: blank (no `[^\x20\x09-\x0D]`), duplicate (its role and text seen earlier in the conversation),
truncated (its last such character is not one of `.!?`).

Defined results: null roles and texts are one space; a null conv_id is a conversation of its own; rows are ordered by turn, nulls first,
then role, then the SHA-256 of the text, so ties and repeated rows have one order; empty tables give empty results; conversations without
rows are not in `repair`'s tables. Other columns are not read. Texts of any length pass row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after s, after u, after a. Classes of initials: s, u, a, other.
EMPTY, AFTER_S, AFTER_U, AFTER_A = range(4)
#: Where a kept row of each class leads, by state; -1: it can't be kept.
KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: Where a rerole or an insertion leads: to u, after u to a.
NEXT = np.array([2, 2, 3, 2])
#: Costs after the last row: insertions that close the conversation.
CLOSE = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
LABELS = np.frombuffer(b"\0DIKR", np.uint8)  # in ASCII order; 0 ends
FAR = np.int64(2**60)
#: Letters (rows) that one step of the DP holds, or one block.
TOGETHER = 200_000


@dataclass
class Repaired:
    """faults: conv, gaps, blank, duplicate, truncated. audits: conv, illegal, cost, audit. rows: conv, block, at, role, text in order."""

    faults: DataFrame
    audits: DataFrame
    rows: DataFrame


def conv_key() -> Column:
    """A key of the conversation that is never null."""
    return F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n"))


def damage(table: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with a twentieth of the rows each dropped, emptied, stripped of .!?, repeated, and said by the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = table.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fault.alias("fault")).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("_copy")).drop("_copy")


ORDER = ["known", "turn", "role", "digest"]


def _placed(table: DataFrame) -> DataFrame:
    """Distinct rows with their faults, letters and blocks."""
    rows = table.select(
        conv_key().alias("conv"), F.col("turn").isNotNull().cast("int").alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    ).withColumn("digest", F.sha2("text", 256))
    key = ["conv", "known", "turn", "role", "digest"]
    distinct = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    first = rows.groupBy("conv", "role", "digest").agg(F.min(F.struct("known", "turn")).alias("f")).select("conv", "f.known", "f.turn", "role", "digest", F.lit(True).alias("opens"))
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    marked = distinct.join(first, key, "left").select(*key, "copies", "text", last.alias("last"), F.col("opens").isNull().alias("seen"))
    blank, seen = F.col("last") == "", F.col("seen")
    cut = ~blank & ~seen & ~F.col("last").isin(".", "!", "?")
    initial = F.left("role", F.lit(1))
    kind = F.when(blank | seen, 2).when(cut, 1).otherwise(0)
    letter = F.lit(65) + 3 * F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    faulty = marked.select(
        *key, "text", F.concat(F.char(letter + kind), F.repeat(F.char(letter + 2), (F.col("copies") - 1).cast("int"))).alias("letters"),
        F.when(blank, F.col("copies")).otherwise(0).alias("blank"),
        F.when(blank, 0).when(seen, F.col("copies")).otherwise(F.col("copies") - 1).alias("duplicate"), cut.cast("long").alias("truncated"),
    )
    return faulty.repartitionByRange("conv", *ORDER).withColumn("block", F.spark_partition_id())


def _walk(letters: list[bytes], close: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Costs to go: for blocks of letters and the costs after each (n, 4), the costs of all nodes, (n letters + 1) x 4 for each block."""
    lengths = np.array([len(x) for x in letters], np.int64)
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    flat = np.zeros(int((lengths + 1).sum()), np.int64)
    for at, x in zip(starts, letters, strict=True):
        flat[at : at + len(x)] = np.frombuffer(x, np.uint8).astype(np.int64) - 65
    cost = np.zeros((len(flat), 4), np.int64)
    cost[starts + lengths] = close
    order = np.argsort(-lengths, kind="stable")
    ends, sorted_lengths = (starts + lengths)[order], -lengths[order]
    for step in range(1, int(lengths.max(initial=0)) + 1):
        node = ends[: np.searchsorted(sorted_lengths, -step, "right")] - step
        cost[node] = _inserted(_row_costs(flat[node], cost[node + 1]).min(0))
    return cost, [flat, starts, lengths]


def _row_costs(letter: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs to go by delete, keep, rerole: 3 x n x 4."""
    kind, target = (letter % 3)[:, None], KEPT[:, letter // 3].T
    extra = np.where(kind == 2, FAR, TRUNCATED * (kind == 1))
    keep = np.where(target < 0, FAR, np.take_along_axis(after, np.maximum(target, 0), 1) + KEEP + extra)
    return np.stack([after + DELETE, keep, after[:, NEXT] + REROLE + extra])


def _inserted(base: np.ndarray) -> np.ndarray:
    """Costs to go with insertions before a row. Twice in a row is once too often where u and a take turns, so one from each suffices."""
    out = base.copy()
    out[:, AFTER_U] = np.minimum(base[:, AFTER_U], base[:, AFTER_A] + INSERT)
    out[:, AFTER_A] = np.minimum(base[:, AFTER_A], base[:, AFTER_U] + INSERT)
    for state in (EMPTY, AFTER_S):
        out[:, state] = np.minimum(base[:, state], out[:, AFTER_U] + INSERT)
    return out


def _paths(letters: list[bytes], close: np.ndarray, ends: np.ndarray, entries: list[tuple[int, ...]]) -> list[list[tuple[int, int, str]]]:
    """For each block and each of its entry states (cost, exit state, audit). close: costs after the block; ends: does the conversation end."""
    cost, (letter, starts, lengths) = _walk(letters, close)
    n = len(cost)
    inner = np.ones(n, bool)
    inner[starts + lengths] = False
    #: Nodes are place * 4 + state; arcs by label in ASCII order: delete, insert, keep, rerole.
    place, state = np.repeat(np.arange(n), 4), np.tile(np.arange(4), n)
    final = np.zeros(n, bool)
    final[(starts + lengths)[ends]] = True
    pointer, rank = np.arange(4 * n), np.zeros(4 * n, np.int64)
    here = cost.ravel()
    rows = np.flatnonzero(inner)
    by_row = np.full((3, n, 4), FAR)
    by_row[:, rows] = _row_costs(letter[rows], cost[rows + 1])
    inserts = np.full((n, 4), FAR)
    inserts[inner | final] = cost[inner | final][:, NEXT] + INSERT
    open_ = ~(final[place] & np.isin(state, (EMPTY, AFTER_A)))
    kept = KEPT[:, np.minimum(letter // 3, 3)].T.ravel()
    arcs = [
        (by_row[0].ravel() == here, 4 * (place + 1) + state),
        ((inserts.ravel() == here) & open_, 4 * place + NEXT[state]),
        (by_row[1].ravel() == here, 4 * (place + 1) + np.maximum(kept, 0)),
        (by_row[2].ravel() == here, 4 * (place + 1) + NEXT[state]),
    ]
    for label in (4, 3, 2, 1):  # the least label is written last
        tight, target = arcs[label - 1]
        pointer[tight], rank[tight] = target[tight], label
    label_of = rank.copy()
    doubled, depth = [pointer], (rank > 0).astype(np.int64)
    while (doubled[-1] != doubled[-1][doubled[-1]]).any():
        step = doubled[-1]
        rank = np.unique(rank * (rank.max() + 1) + rank[step], return_inverse=True)[1].reshape(-1)
        depth = depth + depth[step]
        doubled.append(step[step])
    heads = np.array([4 * at + q for at, states in zip(starts, entries, strict=True) for q in states], np.int64)
    steps = depth[heads]
    node = np.repeat(heads, steps)
    away = np.arange(len(node)) - np.repeat(np.cumsum(steps) - steps, steps)
    for bit, leads in enumerate(doubled):
        far = (away >> bit) & 1 == 1
        node[far] = leads[node[far]]
    text = LABELS[label_of[node]].tobytes().decode()
    out, at, k = [], 0, 0
    for states in entries:
        found = []
        for _ in states:
            found.append((int(here[heads[k]]), int(doubled[-1][heads[k]] % 4), text[at : at + steps[k]]))
            at, k = at + int(steps[k]), k + 1
        out.append(found)
    return out


def _groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of blocks with at most TOGETHER letters, or one block."""
    begin = size = 0
    for at, n in enumerate(len(x) for x in batch.column("letters").to_pylist()):
        if at > begin and size + n > TOGETHER:
            yield batch.slice(begin, at - begin)
            begin, size = at, 0
        size += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least costs from each state before a block's first row to each state after its last."""
    for batch in (part for whole in batches for part in _groups(whole)):
        letters = [x.encode() for x in batch.column("letters").to_pylist()]
        columns = []
        for state in range(4):
            close = np.full((len(letters), 4), FAR)
            close[:, state] = 0
            cost, (_, starts, _) = _walk(letters, close)
            columns.append(np.minimum(cost[starts], FAR))
        matrix = np.stack(columns, 2).reshape(len(letters), 16)
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("block"), pa.array(matrix.tolist(), pa.list_(pa.int64()))], names=["conv", "block", "matrix"])


def _costs_after(blocks: pd.DataFrame) -> pd.DataFrame:
    """For the blocks of one conversation (as many as partitions at most) the costs after each."""
    blocks = blocks.sort_values("block")
    after, out = CLOSE, []
    for matrix in reversed(blocks["matrix"].tolist()):
        out.append(after.tolist())
        after = np.minimum((np.array(matrix).reshape(4, 4) + after).min(1), FAR)
    return pd.DataFrame({"conv": blocks["conv"], "block": blocks["block"], "after": out[::-1]})


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in _groups(whole)):
        letters = [x.encode() for x in batch.column("letters").to_pylist()]
        close = np.array([CLOSE if x is None else x for x in batch.column("after").to_pylist()], np.int64).reshape(-1, 4)
        opens, ends = (np.array(batch.column(c).to_pylist(), bool) for c in ("opens", "ends"))
        found = _paths(letters, close, ends, [(EMPTY,) if x else (EMPTY, AFTER_S, AFTER_U, AFTER_A) for x in opens])
        illegal, first, last = [], [], []
        for x in letters:
            kinds = (np.frombuffer(x, np.uint8).astype(int) - 65) // 3
            illegal.append(int((~legal(kinds[:-1], kinds[1:])).sum()))
            first.append(int(kinds[0]))
            last.append(int(kinds[-1]))
        columns = [[[p[i] for p in paths] for paths in found] for i in range(3)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("block"), pa.array(columns[0], pa.list_(pa.int64())), pa.array(columns[1], pa.list_(pa.int32())), pa.array(columns[2], pa.list_(pa.string())), pa.array(illegal, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())],
            names=["conv", "block", "costs", "exits", "audits", "illegal", "first", "last"],
        )


def legal(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which neighbours are su, ua or au."""
    return ((left == 0) & (right == 1)) | ((left == 1) & (right == 2)) | ((left == 2) & (right == 1))


def _entries(blocks: pd.DataFrame) -> pd.DataFrame:
    blocks = blocks.sort_values("block")
    state, out = EMPTY, []
    for exits in blocks["exits"]:
        out.append(state)
        state = exits[state]
    return pd.DataFrame({"conv": blocks["conv"], "block": blocks["block"], "entry": out})


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks in order, each block after its audit, edited."""
    role_of = {AFTER_U: "user", AFTER_A: "assistant"}
    audit, state, read, at = "", EMPTY, 0, 0
    for batch in batches:
        out = []
        for conv, block, is_row, entry, letters, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "block", "is_row", "entry", "letters", "role", "text")), strict=True):
            if not is_row:
                audit, state, read, at = text, entry, 0, 0
                blocks = (conv, block)
            # an audit's insertions before its first row come with the audit, those after a row with the row
            for _ in range(len(letters) if is_row else 1):
                if is_row:
                    edit, read = audit[read], read + 1
                    if edit != "D":
                        state = int(NEXT[state] if edit == "R" else KEPT[state, {"s": 0, "u": 1, "a": 2}[role[:1]]])
                        out.append((*blocks, at, role_of[state] if edit == "R" else role, text))
                        at += 1
                while read < len(audit) and audit[read] == "I":
                    state, read = int(NEXT[state]), read + 1
                    out.append((*blocks, at, role_of[state], ""))
                    at += 1
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv", "block", "at", "role", "text"])


def repair(table: DataFrame) -> Repaired:
    """Repair every conversation of table (conv_id, turn, role, text)."""
    placed = materialize(_placed(table), "placed")
    in_order = F.array_sort(F.collect_list(F.struct(*ORDER, "letters")))
    blocks = placed.groupBy("conv", "block").agg(F.array_join(F.transform(in_order, lambda x: x["letters"]), "").alias("letters"))
    blocks = materialize(blocks, "blocks")
    spread = blocks.groupBy("conv").agg(F.min("block").alias("low"), F.max("block").alias("high"))
    bounds = blocks.join(spread, "conv")
    several = bounds.filter("low < high")
    after = several.select("conv", "block", "letters").mapInArrow(_matrices, "conv string, block int, matrix array<long>").groupBy("conv").applyInPandas(_costs_after, "conv string, block int, after array<long>")
    asked = bounds.join(after, ["conv", "block"], "left").select("conv", "block", "letters", "after", (F.col("block") == F.col("low")).alias("opens"), (F.col("block") == F.col("high")).alias("ends"))
    paths = materialize(asked.mapInArrow(_audits, "conv string, block int, costs array<long>, exits array<int>, audits array<string>, illegal long, first int, last int"), "paths")
    later = paths.filter(F.size("exits") > 1).select("conv").distinct()
    entries = paths.join(later, "conv", "left_semi").select("conv", "block", "exits").groupBy("conv").applyInPandas(_entries, "conv string, block int, entry int")
    chosen = paths.join(entries, ["conv", "block"], "left").withColumn("entry", F.coalesce("entry", F.lit(EMPTY)))
    chosen = materialize(chosen.select("conv", "block", "entry", F.get("costs", F.lit(0)).alias("cost"), F.get("audits", F.when(F.size("audits") > 1, F.col("entry")).otherwise(0)).alias("audit"), "illegal", "first", "last"), "audits")

    parts = F.array_sort(F.collect_list(F.struct("block", "audit", "cost", "illegal", "first", "last")))
    fits = "(a.last = 0 and b.first = 1 or a.last = 1 and b.first = 2 or a.last = 2 and b.first = 1)"
    borders = f"size(filter(zip_with(slice(parts, 1, size(parts) - 1), slice(parts, 2, size(parts)), (a, b) -> not {fits}), x -> x))"
    audits = chosen.groupBy("conv").agg(parts.alias("parts"), F.sum("illegal").alias("inside")).select(
        "conv", (F.col("inside") + F.when(F.size("parts") > 1, F.expr(borders)).otherwise(0)).alias("illegal"),
        F.expr("parts[0].cost").alias("cost"), F.array_join(F.transform("parts", lambda x: x["audit"]), "").alias("audit"),
    )
    faults = placed.groupBy("conv").agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")), F.countDistinct(F.when(F.col("known") == 1, F.col("turn"))).alias("turns"),
        F.min(F.when(F.col("known") == 1, F.col("turn"))).alias("low"), F.max(F.when(F.col("known") == 1, F.col("turn"))).alias("high"),
    )
    faults = faults.select("conv", F.coalesce(F.expr("high - low + 1 - turns"), F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated")
    rows = placed.select("conv", "block", F.lit(True).alias("is_row"), *ORDER, F.lit(0).alias("entry"), "letters", "text")
    heads = chosen.select("conv", "block", F.lit(False).alias("is_row"), F.lit(0).alias("known"), F.lit(0).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), "entry", F.lit("").alias("letters"), F.col("audit").alias("text"))
    # a block is bounded, so a long conversation's rows are edited in many tasks
    sorted_rows = heads.unionByName(rows).repartition("conv", "block").sortWithinPartitions("conv", "block", "is_row", *ORDER)
    return Repaired(faults, audits, sorted_rows.mapInArrow(_edited, "conv string, block int, at long, role string, text string"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over role:text lines of conversations in order; a hash is fed as rows pass, so a task holds one batch."""
    now, state = None, None
    for batch in batches:
        done = []
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
            if conv != now:
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state = conv, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], names=["conv", "repaired_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], names=["conv", "repaired_sha256"])


def digests(repaired: Repaired) -> DataFrame:
    """conv, repaired_sha256. A hash of a whole conversation has to see its rows one after the other, in one task, which streams them."""
    rows = repaired.rows.repartition("conv").sortWithinPartitions("conv", "block", "at")
    return rows.select("conv", "role", "text").mapInArrow(_hashed, "conv string, repaired_sha256 string")


def repair_report(table: DataFrame, damaged: DataFrame) -> DataFrame:
    """One row for each conversation of table, with what repair does to its damaged rows."""
    all_ids = table.select(conv_key().alias("conv"), "conv_id").distinct()
    repaired = repair(damaged)
    out = all_ids.join(repaired.faults, "conv", "left").join(repaired.audits, "conv", "left").join(digests(repaired), "conv", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_report(table, damage(table))
