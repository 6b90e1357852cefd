"""Scoring by a Brown class-based bigram model.

    P(word | word before) = P(class | context of the word before) * P(word | class)

Training texts are those whose crc32(doc_id) mod 10 is not 0; their words, and an end after each text, are all counted.

* Words: one grouped count over all training words. The CLUSTERED most frequent words get their classes by exchange clustering among
  each other, in rounds; the end is a class of its own. Every other word that was seen PLACED times or more, however many there are,
  is placed by exchange too: into the class where the likelihood gains most, in PASSES passes over the distributed table of how often
  each word follows each context. Only words seen more rarely, and unknown ones, fall by their last two bytes into one of RARE
  classes. No word is left out of any count.
* Contexts: a clustered word's context is its class, the end's the end; another word's context is its rare class, so the context
  of a word is known without a join. (Contexts and classes are two partitions of the words, of which only the second is learnt in full.)
* Exchange clustering of the first words: the counts of neighbouring symbols (a symbol is a clustered word, the end or a rare class, so
  there are at most CLUSTERED + 1 + RARE squared of them) stay distributed by symbol. In each round every symbol's task computes, from the table of
  class bigrams, what the likelihood gains if the symbol moved to each class; the symbols of one half (by turns) make their best move.
  A round that does not gain is not taken.
* Smoothing: P(class | context) = (n + BETA * P(class)) / (n(context) + BETA); P(word | class) = (n(word) + 0.1) / (n(class) + 0.1 *
  (words in class + 1)), where the one more is any unknown word, as in the base score. So both scores share a sample space.
* Scoring: the most frequent words (LOOKUP at most, with their classes) and all class tables (bounded by parameters) are sent to the
  tasks; the other words of a document meet their counts and classes in a join by the word, and sums come back by row.

Defined results: null text is empty (one token, the end); repeated rows are counted and scored as often as they occur; null doc_id
is in training; with no training text all counts are 0 and the formulas still hold; texts of any length are scored whole; other
columns are not read. Rows are told apart by their place in the input, so docs should be a table or something else that gives the
same rows each time.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import LOWER, materialize

CLUSTERED = 2048
CLASSES = 64
RARE = 64
SIZE = CLASSES + 1 + RARE
LOOKUP = 131_072
ROUNDS = 8
#: Occurrences from which a word is placed, and passes over all such words.
PLACED, PASSES = 5, 2
#: The counts of neighbouring symbols are bounded, and so are the tasks that hold them and the class tables that these send.
PARTS = 8
BETA = 5.0
#: Words that a task holds before it hands on their counts, kinds of words that it counts, and contexts of words that it places
#: at once: a worker's memory.
HELD, KINDS, AT_ONCE = 750_000, 250_000, 8_192
#: Bytes of text whose words are numbered at once.
CHUNK = 1 << 19
#: Stands for the end; no word holds white space.
END = b"\n"
HELD_OUT = 10


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % HELD_OUT == 0, F.lit(False))


def tokens(text: str | None) -> list[bytes]:
    """The lower-cased words of a text and the end."""
    return _split((text or "").encode())


def _split(data: bytes) -> list[bytes]:
    out = data.translate(LOWER).split()
    out.append(END)
    return out


def _texts(column: pa.Array) -> Iterator[bytes]:
    """A column's texts as bytes, null as the empty text."""
    return (x.as_py() or b"" for x in column.cast(pa.binary()))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[bytes]]:
    """The tokens of a task's texts, those of about CHUNK bytes of text at a time, one after the other."""
    held, size = [], 0
    for batch in batches:
        for text in _texts(batch.column(0)):
            held.append(text)
            size += len(text)
            if size > CHUNK:
                yield chain.from_iterable(map(_split, held))
                held, size = [], 0
    yield chain.from_iterable(map(_split, held))


class _Endings(dict):
    """Rare classes of words by their last two bytes, of which there are few."""

    def __missing__(self, end: bytes) -> int:
        self[end] = found = xxh64_intdigest(end, 7) % RARE
        return found


_endings = _Endings()


def rare_class(word: bytes) -> int:
    return _endings[word[-2:]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        words = list(counts)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(map(rare_class, words), pa.int32()), pa.array(counts.values(), pa.int64())], names=["word", "rare", "n"])

    for batch in batches:
        for text in _texts(batch.column(0)):
            counts.update(_split(text))
            if len(counts) > KINDS:
                yield out()
                counts.clear()
    yield out()


def _pairs(clustered: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = len(clustered)
        number = {w: k for k, w in enumerate(clustered)} | {END: end}
        size = end + 1 + RARE
        grid = np.zeros(size * size, np.int64)
        for words in _chunks(batches):
            words = list(words)
            found = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
            rest = np.flatnonzero(found < 0)
            found[rest] = [end + 1 + rare_class(words[k]) for k in rest.tolist()]
            # a text starts after an end, and the one before it ends with one
            np.add.at(grid, np.append(end, found[:-1])[: len(found)] * size + found, 1)
        grid = grid.reshape(size, size)
        for side, table in ((0, grid), (1, grid.T)):
            for at in range(0, size, 128):  # handed on by parts, since all rows together are as large as the grid
                rows = []
                for symbol in range(at, min(size, at + 128)):
                    others = np.flatnonzero(table[symbol])
                    if len(others):
                        rows.append((symbol, side, others.astype(np.int16).tobytes(), table[symbol, others].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["symbol", "side", "others", "n"])

    return run


def _gather(size: int):
    def gather(key, table):
        """All counts of one symbol: at most two rows from each task, of at most `size` entries."""
        sides = np.zeros((2, size), np.int64)
        for side, others, n in zip(table.column("side").to_pylist(), table.column("others").to_pylist(), table.column("n").to_pylist(), strict=True):
            sides[side, np.frombuffer(others, np.int16)] += np.frombuffer(n, np.int64)
        return pa.table({"symbol": pa.array([key[0].as_py()], pa.int32()), "after": pa.array([sides[0].tobytes()], pa.binary()), "before": pa.array([sides[1].tobytes()], pa.binary())})

    return gather


def _class_table(classes: np.ndarray, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((size, size), np.int64)
        for batch in batches:
            for symbol, after in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table[classes[symbol]] += np.bincount(classes, np.frombuffer(after, np.int64), size).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], names=["part"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(table: np.ndarray) -> float:
    """What class bigrams give to the log likelihood of the training words."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


def gains(table: np.ndarray, own: int, right: np.ndarray, left: np.ndarray, itself: int, choices: int) -> np.ndarray:
    """How much the likelihood changes if a symbol of class own moved to each of the first `choices` classes. right and left: its
    counts with the classes after and before it, without those with itself."""
    t = table.astype(np.float64)
    t[own] -= right
    t[:, own] -= left
    t[own, own] -= itself
    rows, columns = t.sum(1) + left, t.sum(0) + right  # the neighbours keep their totals wherever the symbol goes
    k = np.arange(choices)
    up = (_xlogx(t[:choices] + right) - _xlogx(t[:choices])).sum(1) + (_xlogx(t[:, :choices] + left[:, None]) - _xlogx(t[:, :choices])).sum(0)
    corner = t[k, k]
    up += _xlogx(corner + right[k] + left[k] + itself) + _xlogx(corner) - _xlogx(corner + right[k]) - _xlogx(corner + left[k])
    up -= _xlogx(rows[:choices] + right.sum() + itself) - _xlogx(rows[:choices]) + _xlogx(columns[:choices] + left.sum() + itself) - _xlogx(columns[:choices])
    return up - up[own]


def _moves(classes: np.ndarray, table: np.ndarray, half: int, clustered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        size = len(table)
        for batch in batches:
            for symbol, after, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if symbol >= clustered or xxh64_intdigest(symbol.to_bytes(4), half) % 2:
                    continue
                after, before = np.frombuffer(after, np.int64).copy(), np.frombuffer(before, np.int64).copy()
                itself = int(after[symbol])
                after[symbol] = before[symbol] = 0
                up = gains(table, int(classes[symbol]), np.bincount(classes, after, size), np.bincount(classes, before, size), itself, CLASSES)
                best = int(up.argmax())
                if up[best] > 1e-6:
                    out.append((symbol, best))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int32()) for k in range(2)], names=["symbol", "to"])

    return run


def exchange(pairs: DataFrame, clustered: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The class of every symbol, and the table of class bigrams. pairs: symbol, after, before (see _gather)."""
    size = SIZE
    classes = np.concatenate([np.arange(clustered) % CLASSES, np.arange(CLASSES, size)])

    def class_table(of: np.ndarray) -> np.ndarray:
        parts = pairs.select("symbol", "after").mapInArrow(_class_table(of, size), "part binary").collect()
        return sum((np.frombuffer(r["part"], np.int64).reshape(size, size) for r in parts), np.zeros((size, size), np.int64))

    table = class_table(classes)
    score = likelihood(table)
    idle = 0
    for turn in range(rounds):
        moved = pairs.mapInArrow(_moves(classes, table, turn, clustered), "symbol int, to int").collect()  # at most a row a clustered word
        new = classes.copy()
        for r in moved:
            new[r["symbol"]] = r["to"]
        new_table = class_table(new)
        new_score = likelihood(new_table)
        if new_score > score:
            idle = 0
            classes, table, score = new, new_table, new_score
        else:
            idle += 1
        if idle == 2:
            break
    return classes, table


class _Numbers(dict):
    """Word to number, in the order in which the words are met; those of `symbols` have ~symbol. rare: the rare class of each number."""

    def __init__(self, symbols: dict[bytes, int]):
        super().__init__(symbols)
        self.rare = array("i")

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self.rare)
        self.rare.append(rare_class(word))
        return found


def _contexts(clustered: list[bytes], classes: np.ndarray):
    """word, rare, contexts, ns: how often each word that is not clustered follows each context, in one row a word and part of a task's texts."""

    end = len(clustered)
    symbols = {w: ~k for k, w in enumerate(clustered)} | {END: ~end}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Numbers(symbols)
        codes: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(codes) if codes else np.empty(0, np.int64), return_counts=True)
            words = list(number)[len(symbols) :]
            # each word has been numbered where it was met, so all of them have contexts
            starts = pa.array(np.append(np.searchsorted(found // SIZE, np.arange(len(words))), len(found)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(starts, pa.array(x)) for x in ((found % SIZE).astype(np.int32), n.astype(np.int64))]
            codes.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(number.rare, pa.int32()), *lists], names=["word", "rare", "contexts", "ns"])

        for words in _chunks(batches):
            found = np.fromiter(map(number.__getitem__, words), np.int64)
            rest = found >= 0
            symbol = ~found
            symbol[rest] = end + 1 + np.array(number.rare)[found[rest]]
            codes.append(found[rest] * SIZE + classes[np.append(end, symbol[:-1])[: len(symbol)][rest]])
            held += len(codes[-1])
            if held > HELD or len(number) > HELD // 5:
                yield flush()
                number, held = _Numbers(symbols), 0
        yield flush()

    return run


def placements(table: np.ndarray, starts: np.ndarray, contexts: np.ndarray, n: np.ndarray, own: np.ndarray) -> np.ndarray:
    """What the likelihood gains with each word in each exchange class. table: contexts by classes, with each word counted in its class
    own (-1: in none of these). Word k has the counts n of contexts from starts[k] on."""
    t = table[:, :CLASSES].astype(np.float64)
    column, total = t.sum(0), np.add.reduceat(n, starts)
    part = t[contexts]
    up = np.add.reduceat(_xlogx(part + n[:, None]) - _xlogx(part), starts) - (_xlogx(column + total[:, None]) - _xlogx(column))
    rows = np.flatnonzero(own >= 0)
    if len(rows):  # of its own class a word is taken out first
        of = own[np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(n))))]
        with_it = t[contexts, np.maximum(of, 0)]
        stay = np.add.reduceat(_xlogx(with_it) - _xlogx(with_it - np.where(of >= 0, n, 0)), starts)
        mine = column[own[rows]]
        up[rows, own[rows]] = stay[rows] - (_xlogx(mine) - _xlogx(mine - total[rows]))
    return up


_PLACED = "word binary, rare int, contexts array<int>, ns array<long>, to int"


def _merge(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of a word that stand together as one, each context once."""
    words, lists, counts = batch.column(0), batch.column(2), batch.column(3)
    first = np.append(True, pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False))
    rows = np.flatnonzero(first)
    of = np.repeat(np.cumsum(first) - 1, np.diff(lists.offsets.to_numpy()))
    found, at = np.unique(of * SIZE + lists.flatten().to_numpy(), return_inverse=True)
    n = np.bincount(at, counts.flatten().to_numpy(), len(found)).astype(np.int64)
    starts = pa.array(np.append(np.searchsorted(found // SIZE, np.arange(len(rows))), len(found)).astype(np.int32))
    merged = [pa.ListArray.from_arrays(starts, pa.array(x)) for x in ((found % SIZE).astype(np.int32), n)]
    word, rare, to = (batch.column(k).take(pa.array(rows)) for k in (0, 1, 4))
    return pa.RecordBatch.from_arrays([word, rare, *merged, to], names=["word", "rare", "contexts", "ns", "to"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their words, those of a word as one."""
    held = None
    for batch in batches:
        if held is not None:  # its last word may go on
            yield held.slice(0, held.num_rows - 1)
            rows = pa.Table.from_arrays([pa.chunked_array([a, b.cast(a.type)]) for a, b in zip(held.slice(held.num_rows - 1).columns, batch.columns, strict=True)], names=held.schema.names)
            batch = pa.RecordBatch.from_arrays([c.combine_chunks() for c in rows.columns], names=rows.schema.names)
        held = _merge(batch) if batch.num_rows else held
    if held is not None:
        yield held


def _often(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Words seen `least` times or more."""
    for batch in batches:
        if batch.num_rows:
            lists = batch.column(3)
            starts = lists.offsets.to_numpy()[:-1].astype(np.int64)
            yield batch.filter(pa.array(np.add.reduceat(lists.flatten().to_numpy(), starts - starts[0]) >= least))


def _place(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(2).offsets.to_numpy()
            at = 0
            while at < batch.num_rows:
                until = max(at + 1, int(np.searchsorted(ends, ends[at] + AT_ONCE, "right")) - 1)
                some = batch.slice(at, until - at)
                at = until
                lists = some.column(2)
                starts = lists.offsets.to_numpy()[:-1].astype(np.int64)
                up = placements(table, starts - starts[0], lists.flatten().to_numpy(), some.column(3).flatten().to_numpy().astype(np.float64), some.column(4).to_numpy())
                yield pa.RecordBatch.from_arrays([*some.columns[:4], pa.array(up.argmax(axis=1).astype(np.int32))], names=["word", "rare", "contexts", "ns", "to"])

    return run


def _merged_and_placed(table: np.ndarray, least: int):
    """_merged, _often and _place in one worker: chained in Spark, each would have a worker of its own in the same task, which doubles their memory."""
    place = _place(table)
    return lambda batches: place(_often(_merged(batches), least))


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """code (context, rare class, class), n: what placed words take from rare classes to exchange classes."""
    sums: Counter[int] = Counter()
    for batch in batches:
        lists = batch.column(2)
        sizes = np.diff(lists.offsets.to_numpy())
        codes = lists.flatten().to_numpy().astype(np.int64) * (RARE * CLASSES) + np.repeat(batch.column(1).to_numpy().astype(np.int64) * CLASSES + batch.column(4).to_numpy(), sizes)
        found, of = np.unique(codes, return_inverse=True)
        for code, n in zip(found.tolist(), np.bincount(of, batch.column(3).flatten().to_numpy(), len(found)).astype(np.int64).tolist(), strict=True):
            sums[code] += n
    yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int64()), pa.array(sums.values(), pa.int64())], names=["code", "n"])


def place_words(text: DataFrame, clustered: list[bytes], classes: np.ndarray, table: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """word, rare, contexts, ns, to (its class) of all words seen PLACED times or more that are not clustered; and the table of contexts
    by classes with these words in their classes."""
    rows = text.mapInArrow(_contexts(clustered, classes), "word binary, rare int, contexts array<int>, ns array<long>").withColumn("to", F.lit(-1))
    # a word comes about once from a part, so that lists are put together where they meet and not before
    last, step = rows.repartition("word").sortWithinPartitions("word"), _merged_and_placed(table, PLACED)
    best, now = None, table
    for _ in range(PASSES):
        placed = materialize(last.mapInArrow(step, _PLACED), "placed")
        new = table.copy()
        moved = placed.mapInArrow(_moved, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # at most SIZE * RARE * CLASSES rows
        code, n = moved.column(0).to_numpy(), moved.column(1).to_numpy()
        context, rare, to = code // (RARE * CLASSES), code // CLASSES % RARE, code % CLASSES
        np.add.at(new, (context, to), n)
        np.subtract.at(new, (context, CLASSES + 1 + rare), n)
        if best is not None and likelihood(new) <= likelihood(now):
            break
        best, now, last, step = placed, new, placed, _place(new)
    return best.select("word", "rare", "to"), now


class Model:
    """What tasks need to score: bounded by LOOKUP, CLASSES and RARE. words: word, count, class, context of the words looked up."""

    def __init__(self, words: list[tuple[bytes, int, int, int]], table: np.ndarray, class_words: np.ndarray, total: int, kinds: int):
        self.total, self.kinds = total, kinds
        self.known = {w: k for k, (w, *_) in enumerate(words)}
        self.logs = np.array([math.log10(n + 0.1) for _, n, _, _ in words], np.float64)
        self.of = np.array([(n > 0, c, x) for _, n, c, x in words], np.int32).reshape(len(words), 3)
        n = table.sum(0).astype(np.float64)
        share = (n + 0.5) / (n.sum() + 0.5 * len(n))
        self.move = np.log10((table + BETA * share) / (table.sum(1, keepdims=True) + BETA))
        self.out_of = np.log10(n + 0.1 * (class_words + 1))
        self.base = math.log10(total + 0.1 * (kinds + 1))

    def parts(self, text: str | bytes | None) -> tuple[int, int, float, float, Counter]:
        """Tokens, known tokens, base and score without the words that are not looked up here, and those words with their contexts."""
        found = _split(text) if isinstance(text, bytes) else tokens(text)
        at = np.fromiter(map(self.known.get, found, repeat(-1)), np.int64, len(found))
        here = at >= 0
        missed = np.flatnonzero(~here).tolist()
        contexts = np.empty(len(found) + 1, np.int64)
        contexts[0] = CLASSES
        if len(self.of):
            contexts[1:] = self.of[at, 2]
        words = [found[k] for k in missed]
        contexts[1:][missed] = [CLASSES + 1 + _endings[w[-2:]] for w in words]
        rest = Counter(zip(words, contexts[missed].tolist(), strict=True))
        at = at[here]
        known, classes, _ = self.of[at].T
        emitted = math.fsum(self.logs[at].tolist())
        score = emitted + float(self.move[contexts[:-1][here], classes].sum() - self.out_of[classes].sum())
        return len(found), int(known.sum()), emitted - len(found) * self.base, score, rest


def _score(model):
    kind = pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_here = model.value
        for batch in batches:
            given = [*batch.columns[:3], batch.column(3).cast(pa.binary())]
            keys, sizes, docs, words, contexts, times = [], [], [], [], [], []
            for k in range(batch.num_rows):
                key, doc_id, out, text = (c[k].as_py() for c in given)
                n, known, base, score, rest = model_here.parts(text)
                # a row's own part has a word that no text holds, so it meets nothing, and no two of them meet
                keys.append(key)
                sizes.append(1 + len(rest))
                docs.append((doc_id, out, n, known, base, score))
                words += [END + key.to_bytes(8), *[w for w, _ in rest]]
                contexts += [0, *[x for _, x in rest]]
                times += [0, *rest.values()]
                if len(words) > 20_000 or k == batch.num_rows - 1:
                    own = np.cumsum(sizes) - sizes
                    of = np.full(len(words), -1)
                    of[own] = np.arange(len(own))
                    fall = np.array([CLASSES + 1 + _endings[w[-2:]] for w in words], np.int32)
                    fall[own] = 0
                    doc = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*docs, strict=True), kind, strict=True)], fields=list(kind)).take(pa.array(of, mask=of < 0))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, sizes), pa.int64()), pa.array(words, pa.binary()), pa.array(contexts, pa.int32()), pa.array(fall), pa.array(times, pa.int64()), doc], names=["key", "word", "context", "fall", "times", "doc"])
                    for c in (keys, sizes, docs, words, contexts, times):
                        c.clear()

    return run


def _lookup(counts: DataFrame) -> Column:
    """A filter for the LOOKUP words of most occurrences: whole classes of like counts (a class is a 16th of a power of two), and of the class
    that does not fit in whole the share that fits, chosen by hash; so no task sorts or sends more than it has of them."""
    size = F.floor(16 * F.log2("n")).cast("int")
    room = LOOKUP
    chosen = F.lit(False)
    for r in sorted(counts.groupBy(size.alias("size")).count().collect(), reverse=True):  # about a thousand rows at most
        if r["count"] > room:
            return chosen | (size == r["size"]) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < F.lit(int(0.95 * room / r["count"] * (1 << 20))))
        room -= r["count"]
        chosen = size >= r["size"]
    return F.lit(True)


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and all words (word, n, class)."""
    text = docs.filter(~held_out()).select(F.col("text").cast("string"))
    counts = text.mapInArrow(_count, "word binary, rare int, n long").groupBy("word", "rare").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "words")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.filter(_lookup(counts))
    first = [(-r["n"], bytes(r["word"])) for r in top.select("word", "n").collect() if bytes(r["word"]) != END]
    clustered = [w for _, w in sorted(first)[:CLUSTERED]]
    pairs = text.mapInArrow(_pairs(clustered), "symbol int, side int, others binary, n binary").groupBy("symbol").applyInArrow(_gather(len(clustered) + 1 + RARE), "symbol int, after binary, before binary")
    classes, table = exchange(materialize(pairs.repartition(PARTS, "symbol"), "pairs").coalesce(PARTS), len(clustered))
    placed, table = place_words(text, clustered, classes, table)
    fixed = {w: int(classes[k]) for k, w in enumerate(clustered)} | {END: CLASSES}
    words = counts.join(placed.select("word", "to"), "word", "left").select("word", "n", "rare", F.coalesce("to", F.lit(CLASSES + 1) + F.col("rare")).alias("class"))
    spark = docs.sparkSession
    own = spark.createDataFrame(list(fixed.items()), "word binary, own int")
    words = words.join(F.broadcast(own), "word", "left").select("word", "n", "rare", F.coalesce("own", "class").alias("class"))  # CLUSTERED + 1 rows
    words = materialize(words, "classes")
    class_words = np.zeros(SIZE)
    for r in words.groupBy("class").count().collect():
        class_words[r["class"]] = r["count"]
    found = [(bytes(r["word"]), r["n"], r["class"], r["rare"]) for r in words.filter(_lookup(counts)).select("word", "n", "class", "rare").collect()]
    known = [(w, n, c, fixed.get(w, CLASSES + 1 + rare)) for w, n, c, rare in found]
    return Model(known, table, class_words, total, kinds), words.select("word", "n", "class")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text."""
    model, words = train(docs)
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text.alias("text"))
    kind = "struct<doc_id:long,held_out:boolean,n_tokens:long,n_known:long,base:double,score:double>"
    parts = rows.mapInArrow(_score(spark.sparkContext.broadcast(model)), f"key long, word binary, context int, fall int, times long, doc {kind}")
    move = [(x, c, float(model.move[x, c] - model.out_of[c])) for x in range(SIZE) for c in range(SIZE)]
    moves = F.broadcast(spark.createDataFrame(move, "context int, class int, move double"))  # SIZE squared rows
    met = parts.join(words, "word", "left").withColumn("class", F.coalesce("class", "fall")).join(moves, ["context", "class"], "left")
    emitted = F.log10(F.coalesce("n", F.lit(0)) + 0.1)
    each = met.groupBy("key").agg(
        F.first("doc", ignorenulls=True).alias("doc"),
        F.sum(F.col("times") * emitted).alias("rest"),
        F.sum(F.when(F.col("times") > 0, F.col("times") * (emitted + F.col("move"))).otherwise(0.0)).alias("rest_score"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"),
    )
    return each.select(
        "doc.doc_id",
        "doc.held_out",
        "doc.n_tokens",
        (F.col("doc.n_known") + F.col("known")).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("doc.base") + F.col("rest")).alias("base_score"),
        (F.col("doc.score") + F.col("rest_score")).alias("score"),
    )


def op3_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
