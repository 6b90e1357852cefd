"""Conversation repair against a plain DP over whole audits, with conversations in one block and in many."""

import hashlib
import random
import re
import zlib

import pytest

from quirelight.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, conv string, block int, letters string"
FORM = re.compile(r"(s?(ua)+)?")


def slow_damage(rows):
    sp = lambda x: " " if x is None else str(x)
    for c, t, role, text in rows:
        role, text = sp(role), sp(text)
        fault = zlib.crc32(f"{sp(c)}:{sp(t)}".encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            yield from [(c, t, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)


def slow_repair(rows):
    """rows of one conversation in order -> (blank, duplicate, truncated, illegal, cost, audit, repaired)."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    nxt, names = [2, 2, 3, 2], {2: "user", 3: "assistant"}
    seen, kinds, n = set(), [], [0, 0, 0]
    for _, _, role, text in rows:
        core = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        kind = "b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else ""
        seen.add((role, text))
        kinds.append(kind)
        if kind:
            n["bdt".index(kind)] += 1
    best = [(0, "", ()), (4, "II", ("user:", "assistant:")), (2, "I", ("assistant:",)), (0, "", ())]
    for (_, _, role, text), kind in reversed(list(zip(rows, kinds, strict=True))):
        base = []
        for q in range(4):
            found = [(best[q][0] + 3, "D" + best[q][1], best[q][2])]
            if kind not in ("b", "d"):
                more = kind == "t"
                if (to := step.get((q, role[:1]))) is not None:
                    found.append((best[to][0] + more, "K" + best[to][1], (f"{role}:{text}", *best[to][2])))
                to = nxt[q]
                found.append((best[to][0] + 2 + more, "R" + best[to][1], (f"{names[to]}:{text}", *best[to][2])))
            base.append(min(found))
        for _ in range(4):
            base = [min(base[q], (base[nxt[q]][0] + 2, "I" + base[nxt[q]][1], (f"{names[nxt[q]]}:", *base[nxt[q]][2]))) for q in range(4)]
        best = base
    roles = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    cost, audit, repaired = best[0]
    assert FORM.fullmatch("".join(x[0] for x in repaired))
    return (*n, illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())


def slow(rows):
    damaged = list(slow_damage(rows))
    out = set()
    for c in {r[0] for r in rows}:
        mine = [r for r in damaged if r[0] == c]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.add((c, gaps, *slow_repair(mine)))
    return out


def weird(seed, n):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "umbrella"]
    texts = ["ok.", "Yes!", "no", "", "  \n", None, "why? ", "Fine.\t", "é.", "漢字", "long " * 3000 + "."]
    rows = []
    for c in range(n):
        size = rng.choice([1, 2, 3, 5, 8, 40])
        for t in range(size):
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            text = rng.choice(texts) if rng.random() < 0.4 else f"said {c} {t}."
            rows.append((c, rng.choice([t, t, t, t, t + 2, None]), role, text))
    rows += [(None, None, None, None), (None, 1, "user", "x."), (-1, None, "user", "a."), (-1, None, "user", "a.")] + [(n, 7, "user", "same.")] * 5
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "v1", 3, "A") for r in rows], SCHEMA)


def report(spark, rows):
    table = frame(spark, rows)
    return {tuple(r) for r in repair.repair_report(table, repair.damage(table)).collect()}


def test_repair(spark):
    rows = weird(3, 150)
    assert report(spark, rows) == slow(rows)


def test_conversations_over_many_blocks(spark):
    rng = random.Random(9)
    rows = weird(4, 20)
    rows += [(500, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["a.", "b", f"c{t}.", f"d{t}", ""])) for t in range(3000)]
    names = {"spark.sql.shuffle.partitions": "17", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        table = frame(spark, rows)
        assert repair._placed(repair.damage(table)).filter("conv = 'v500'").select("block").distinct().count() > 3
        assert report(spark, rows) == slow(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_repeated_rows_with_insertions_between(spark):
    rows = [(1, 0, "assistant", "one."), (1, 0, "assistant", "one."), (1, 1, "assistant", "two.")]
    table = frame(spark, rows)
    want = slow_repair([r for r in rows])
    got = repair.repair_report(table, table.select("conv_id", "turn", "role", "text")).collect()
    assert [tuple(r)[2:] for r in got] == [want]


def test_empty_and_all_dropped(spark):
    assert report(spark, []) == set()
    c = next(c for c in range(999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert report(spark, [(c, 0, "user", "x")]) == {(c, 0, 0, 0, 0, 0, 0, "", empty)}


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = repair.op12_repair(spark, sf)
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {tuple(r) for r in df.collect()} == slow(rows)


@pytest.mark.parametrize("seed", range(4))
def test_paths_of_one_block(seed):
    rng = random.Random(seed)
    for _ in range(200):
        kinds = [(rng.choice("suax"), rng.choice(["", "", "t", "b"])) for _ in range(rng.randint(1, 9))]
        letters = "".join(chr(65 + "suax".index(c) * 3 + {"": 0, "t": 1, "b": 2}[k]) for c, k in kinds)
        rows = [(0, i, c, "" if k == "b" else f"{i}" + ("" if k else ".")) for i, (c, k) in enumerate(kinds)]
        want = slow_repair(rows)
        import numpy as np

        ((cost, _, audit),) = repair._paths([letters.encode()], repair.CLOSE[None, :], np.array([True]), [(0,)])[0]
        assert (cost, audit) == want[4:6]
