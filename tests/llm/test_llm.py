"""The corpus operators against brute force, on fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirelight.llm import bpe, chat, components, lm, merkle, near, packing, quality, sharding, simhash, suffix, templates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, h long, lost_lines string, data string, line string"


def weird(seed=5):
    rng = random.Random(seed)
    words = ["the", "cat", "sat", "on", "a", "mat", "Été", "x1", "ünder", "漢字", "one,", "two.", "12%"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = say(150)
    texts = [None, "", "   \n\t ", "one", say(3), say(4), say(300), "a" * 5000, "ab " * 900, "\n\n\n", say(60) + "\n" + passage, passage + " tail " + say(20), passage]
    texts += [say(40) + "\nAll rights reserved here 2024.\n" + say(20) for _ in range(20)]
    copy = say(120)
    texts += [copy, copy, copy + " end", say(9000), "x\x0by\x0cz\r\nw", "#$% <|> ***"]
    rows = [(k, t, "en", None if k % 9 == 0 else f"s{k % 2}", None if t is None else len(t), "k", 1, "l", "d", "z") for k, t in enumerate(texts)]
    return rows + [rows[20], rows[6]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(weird(), SCHEMA).cache()


@pytest.fixture(scope="module")
def rows():
    return [(r[0], r[1] or "") for r in weird()]


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(none):
    assert quality.assess(none).count() == quality.clean(none).count() == 0
    assert templates.drop_templates(none).count() == simhash.near_duplicates(none).count() == 0
    assert suffix.cut_repeats(none).count() == packing.pack(none).count() == merkle.with_next(none).count() == 0
    assert sharding.shuffle_into_shards(none).count() == merkle.fingerprints(none).count() == 0
    assert lm.score(none).count() == simhash.keep_first(none).count() == 0


def slow_quality(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality(docs, rows):
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.assess(docs).collect())
    want = Counter((i, *(m := slow_quality(t)), m[0] < 10 or 100 * m[4] > 20 * m[0]) for i, t in rows)
    assert got == want


def test_quality_drops_boilerplate_lines_but_keeps_the_first(spark):
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(12))
    texts = [(k, f"{own(k)}\nAll  Rights reserved.") for k in range(8)] + [(50, "All rights RESERVED.\n" + "b c d e f g h i j k l")]
    df = spark.createDataFrame([(k, t, "s", len(t)) for k, t in texts], "doc_id long, text string, source string, n_chars long")
    kept = {r["doc_id"]: r for r in quality.clean(df, line_docs=5, line_share=0.1).collect()}
    assert set(kept) == {k for k, _ in texts}
    assert "Rights" in kept[0]["text"] and "Rights" not in kept[3]["text"] and kept[3]["n_chars"] == len(kept[3]["text"])
    gone = quality.assess(df, line_docs=5, line_share=0.1, lost_share=0.1).filter("not kept").count()
    assert gone == 8


def test_quality_judges_small_hosts_by_share(spark):
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(12))
    rows = [(k, own(k) + ("\nSubscribe to our letter" if k < 8 else "") + ("\nrare line" if k < 5 else ""), "small") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    lost = {r["doc_id"]: r["lost_words"] for r in quality.assess(df).collect()}
    assert lost == {k: 4 if 0 < k < 8 else 0 for k in range(40)}
    depleted = spark.createDataFrame([(k, own(k) if k > 9 else f"id{k}\n" + own(99), "small") for k in range(40)], "doc_id long, text string, source string")
    assert {r["doc_id"] for r in quality.assess(depleted).filter("not kept").collect()} == set(range(1, 10))


def slow_verdict(rows, floor=5, share=0.005, lost=0.7):
    """(lost words, kept) of each row (doc_id, text, source), row by row."""
    normal = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    lines = [[n for x in (t or "").split("\n") if (n := normal(x))] for _, t, _ in rows]
    texts, holders, first = {}, {}, {}
    for (i, t, host), own in zip(rows, lines, strict=True):
        texts.setdefault(host or "", set()).add(t or "")
        for x in set(own):
            holders.setdefault((host or "", x), set()).add(t or "")
            if i is not None:
                first[host or "", x] = min(i, first.get((host or "", x), i))
    out = []
    for (i, t, host), own in zip(rows, lines, strict=True):
        host = host or ""
        gone = [x for x in own if len(holders[host, x]) > max(floor, share * len(texts[host])) and i is not None and i != first[host, x]]
        n = sum(len(x.split(" ")) for x in gone)
        m = slow_quality(t or "")
        out.append((i, n, not (m[0] < 10 or 100 * m[4] > 20 * m[0]) and n < lost * m[0]))
    return out


def test_quality_verdict_of_each_row(spark):
    rng = random.Random(11)
    lines = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    rows = []
    for k in range(120):
        own = rng.sample(lines[:12], rng.randrange(4)) + rng.sample(lines, rng.randrange(1, 6)) + [f"own{k} " * 3] * rng.randrange(2)
        rng.shuffle(own)
        rows.append((None if k % 17 == 0 else k // 2 if k % 5 == 0 else k, "\n".join(own), None if k % 7 == 0 else f"h{k % 3}"))
    rows += rows[:9] * 3 + [(500, None, "h1"), (501, "", "h1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r["doc_id"], r["lost_words"], r["kept"]) for r in quality.assess(df).collect())
    want = slow_verdict(rows)
    assert got == Counter(want) and sum(n > 0 for _, n, _ in want) > 20 and {k for *_, k in want} == {True, False}


def test_passing_columns_through(docs):
    for out in (quality.clean(docs), templates.without_templates(docs, limit=5), simhash.keep_first(docs), suffix.remove_repeats(docs)):
        assert out.columns == docs.columns
        assert out.filter("key <> 'k' or data <> 'd' or lost_lines <> 'l'").count() == 0


def test_templates(docs, rows):
    out = Counter((r["doc_id"], r["text"]) for r in templates.drop_templates(docs, limit=5).select("_rest.doc_id", "text").collect())
    first = min(i for i, t in rows if "reserved" in t)
    want = Counter((i, "\n".join(x for x in t.split("\n") if "reserved" not in x) if i != first else t) for i, t in rows)
    assert out == want


def slow_templates(rows, limit, branches):
    """The texts of rows (doc_id, text) without the lines whose template recurs: the tree as a plain dictionary."""
    mask = lambda x: tuple("<*>" if re.search("[0-9]", t) else t for t in re.findall(r"[^\x20\x09-\x0D]+", x))
    at = lambda m: (len(m), m[:3])
    leaves, texts_of = {}, {}
    for _, t in rows:
        for m in {mask(x) for x in (t or "").split("\n")} - {()}:
            leaves.setdefault(at(m), set()).add(m)
            texts_of.setdefault(m, set()).add(t)
    name = {}
    for leaf, own in leaves.items():
        fields = [k for k in range(leaf[0]) if len({m[k] for m in own}) > branches]
        busy = sum(len(texts_of[m]) for m in own) > limit and 2 * len(fields) <= leaf[0]
        for m in own:
            name[m] = leaf, tuple("<*>" if busy and k in fields else t for k, t in enumerate(m))
    holders, first = {}, {}
    for i, t in rows:
        for m in {mask(x) for x in (t or "").split("\n")} - {()}:
            holders.setdefault(name[m], set()).add(t)
            if i is not None:
                first[name[m]] = min(i, first.get(name[m], i))
    goes = lambda i, m: m and len(holders[name[m]]) > limit and (i is None or first.get(name[m]) != i)
    return [(i, "\n".join(x for x in (t or "").split("\n") if not goes(i, mask(x)))) for i, t in rows]


@pytest.mark.parametrize("small", [1 << 18, 0])
def test_templates_against_a_plain_tree(spark, small, monkeypatch):
    monkeypatch.setattr(templates, "SMALL", small)
    rng = random.Random(12)
    heads = [" ".join(rng.choice("abc") for _ in range(3)) for _ in range(6)]
    line = lambda: rng.choice(heads) + "".join(" " + rng.choice(["x", "y", "z", "q7", "12", "v", "u", "t"]) for _ in range(rng.randrange(4)))
    rows = [(None if k % 13 == 0 else k // 2 if k % 6 == 0 else k, "\n".join([line() for _ in range(rng.randrange(6))] + [f"own{chr(97 + k % 26)}"])) for k in range(150)]
    rows += rows[:5] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in templates.drop_templates(df, limit=8, branches=3).select("_rest.doc_id", "text").collect())
    want = slow_templates(rows, 8, 3)
    assert got == Counter(want) and want != [(i, t or "") for i, t in rows]


def test_template_fields(spark):
    texts = [(k, f"user u{k} came from host {'abcdefghij'[k % 10] * 3} today at noon\nmy own line {'x' * k} {'y' * k}") for k in range(12)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r["n_dropped"] for r in templates.drop_templates(df, limit=5).select("_rest.doc_id", "n_dropped").collect()}
    assert got[0] == 0 and all(n >= 1 for k, n in got.items() if k)


def slow_fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(nodes, near):
    top = {k: k for k in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {k: find(k) for k in nodes}


def test_simhash(docs, rows):
    prints = {i: slow_fingerprint(t) for i, t in rows}
    want = slow_groups(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = simhash.near_duplicates(docs, tile=4).collect()
    assert len(got) == len(rows)
    assert all(r["fp"] % 2**64 == prints[r["doc_id"]] and r["component_id"] == want[r["doc_id"]] for r in got)


def test_forest_connects_dense_groups():
    import numpy as np

    rng = random.Random(1)
    base = rng.getrandbits(64)
    prints = sorted({base ^ (1 << rng.randrange(64)) for _ in range(50)} | {base} | {rng.getrandbits(64) for _ in range(100)})
    by_ones = {}
    for p in prints:
        by_ones.setdefault(p.bit_count(), []).append(p)
    links = []
    for n, a in by_ones.items():
        for m, b in by_ones.items():
            if n <= m <= n + 4:
                links += simhash.forest(np.array(a, np.uint64), None if n == m else np.array(b, np.uint64), 4)
    assert all((a ^ b).bit_count() <= 4 for a, b in links) and len(links) < 2 * len(prints)
    pairs = {frozenset(x) for x in links}
    assert slow_groups(prints, lambda a, b: frozenset((a, b)) in pairs) == slow_groups(prints, lambda a, b: (a ^ b).bit_count() <= 4)


def test_components_of_a_chain(spark):
    n = 40
    links = spark.createDataFrame([(k + 1, k) for k in range(n)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {k: 0 for k in range(n + 1)} | {100: 100, 101: 100}


def slow_shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_texts():
    """Copies with edits of many sizes, chains of them, and a dense group of mutual near copies."""
    rng = random.Random(8)
    say = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    texts = [" ".join(say(rng.randrange(5, 200))) for _ in range(20)]
    for n in (30, 120, 400):
        for edits in range(1, 9):
            a = say(n)
            b = list(a)
            for _ in range(max(1, n * edits // 200)):
                b[rng.randrange(n)] = "edit"
            texts += [" ".join(a), " ".join(b), " ".join(b[: -n // 8])]
    base = say(150)
    texts += [" ".join([*base, *say(k % 12)]) for k in range(40)]
    return texts + [None, "", "one two", "One  TWO", "one two three"]


@pytest.mark.parametrize("tile", [8192, 16])
def test_near_dedup_finds_all_pairs_from_four_fifths_on(spark, tile):
    texts = near_texts()
    sets = [slow_shingles(t) for t in texts]
    like = lambda a, b: not (sets[a] | sets[b]) or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    want = slow_groups(range(len(texts)), like)
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "one two", "x")], "doc_id long, text string, source string")
    got = [r["doc_id"] for r in simhash.keep_first(df, tile=tile).collect()]
    assert Counter(got) == Counter({k for k in want if want[k] == k} | {None})


def test_near_dedup_looks_at_all_pairs(spark, monkeypatch):
    """Every pair lies in this radius, so only verification can tell, and sets have far more than K candidates."""
    from quirelight.llm import near

    monkeypatch.setattr(near, "PART", 8)
    texts = near_texts()[:70]
    sets = [slow_shingles(t) for t in texts]
    want = slow_groups(range(len(texts)), lambda a, b: not (sets[a] | sets[b]) or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in near.keep_first(df, radius=192, tile=32).collect()} == {k for k in want if want[k] == k}


def test_rows_without_id_link_others(spark):
    rng = random.Random(9)
    a = [f"w{rng.randrange(900)}" for _ in range(60)]
    texts = [(1, " ".join(a)), (None, " ".join([*a, *"pqrs"])), (2, " ".join([*a, *"pqrs", *"tuvwxyz"]))]
    s1, s2, s3 = (slow_shingles(t) for _, t in texts)
    assert len(s1 & s3) < 0.85 * len(s1 | s3) and min(len(s1 & s2) / len(s1 | s2), len(s2 & s3) / len(s2 | s3)) >= 0.8
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = [r["doc_id"] for r in simhash.keep_first(df).collect()]
    assert Counter(got) == Counter([1, None])
    prints = spark.createDataFrame([(1, "a b c d"), (None, "a b c d"), (None, "q"), (3, "A B c d")], "doc_id long, text string")
    assert Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(prints).collect()) == Counter([(1, 1), (None, 1), (3, 1), (None, None)])


def slow_cut(docs, length=400):
    places = Counter()
    for d in docs:
        for i in range(len(d) - length + 1):
            places[d[i : i + length]] += 1
    out = []
    for d in docs:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if places[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for a, b in zip(b"\0" + bytes(gone), bytes(gone)) if b and not a)
        out.append((len(d), sum(gone), runs, bytes(x for x, y in zip(d, gone) if not y)))
    return out


@pytest.mark.parametrize("hot, length, seen", [(4096, 400, 200_000), (2, 400, 0), (4096, 200, 0), (2, 50, 200_000)])
def test_suffix(spark, docs, rows, hot, length, seen, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "SEEN", seen)
    want = Counter((i, *x) for (i, _), x in zip(rows, slow_cut([t.encode() for _, t in rows], length)))
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix.cut_repeats(docs, length).select("_rest.doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect())
    assert got == want


def test_suffix_sorts_equal_texts_once(spark):
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(999)}" for _ in range(200))
    other = "head|" + text[100:600] + "|tail"
    one = spark.createDataFrame([(1, text), (2, other)], "doc_id long, text string")
    many = spark.createDataFrame([(1, text)] * 30 + [(2, other), (None, text)], "doc_id long, text string")
    got = {(r["doc_id"], r["n_removed"], r["n_spans"]) for r in suffix.cut_repeats(many).select("_rest.doc_id", "n_removed", "n_spans").collect()}
    assert got == {(1, len(text), 1), (None, len(text), 1), (2, 500, 1)}
    assert {(r["doc_id"], r["n_removed"]) for r in suffix.cut_repeats(one).select("_rest.doc_id", "n_removed").collect()} == {(1, 500), (2, 500)}
    texts = many.coalesce(1).select(F.unhex(F.md5("text")).alias("key"), F.col("text").cast("binary").alias("data"))
    kind = "key binary, h long, at int, first int, last int"
    assert texts.mapInArrow(suffix._find_anchors(400), kind).count() == texts.distinct().coalesce(1).mapInArrow(suffix._find_anchors(400), kind).count()


def test_merge_knows_common_prefixes():
    rng = random.Random(2)
    items = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 9))) for _ in range(300))
    runs = [sorted(items[k::5]) for k in range(5)]
    got = list(suffix.merge([suffix.decode(suffix.front_code([(x, bytes(16), 0) for x in run])) for run in runs]))
    assert [x[1] for x in got] == items
    assert all(n == suffix.common_prefix(a, b) for (n, b, *_), a in zip(got[1:], items))


@pytest.mark.parametrize("lookup, placed", [(5, 5), (1 << 17, 2)])
def test_lm(spark, docs, rows, lookup, placed, monkeypatch):
    monkeypatch.setattr(lm, "LOOKUP", lookup)
    monkeypatch.setattr(lm, "PLACED", placed)
    monkeypatch.setattr(lm, "CLUSTERED", 6)
    count = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            count.update(lm.tokens(t))
    total, kinds = sum(count.values()), len(count)
    model, words = lm.train(docs)
    of = {bytes(r["word"]): r["class"] for r in words.collect()}
    first = sorted((-n, w) for w, n in count.items() if w != lm.END)[: lm.CLUSTERED] if lookup > 5 else None
    rare = lambda w: lm.CLASSES + 1 + lm.rare_class(w)
    if first:
        clustered = {w for _, w in first}
        assert set(of) == set(count) and all((c < lm.CLASSES) == (w in clustered or count[w] >= placed) for w, c in of.items() if w != lm.END)
        context = lambda w: lm.CLASSES if w == lm.END else of[w] if w in clustered else rare(w)
    got = lm.score(docs).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        said = lm.tokens(texts[r["doc_id"]])
        assert r["n_tokens"] == len(said) and r["n_known"] == sum(count[w] > 0 for w in said) and r["train_tokens"] == total
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in said), rel_tol=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) and r["score"] < 0
        if first:
            want = sum(model.move[context(a), c := of.get(b, rare(b))] + math.log10(count[b] + 0.1) - model.out_of[c] for a, b in zip([lm.END, *said], said))
            assert math.isclose(r["score"], want, rel_tol=1e-9)


def test_lm_is_a_distribution(spark, docs):
    model, words = lm.train(docs)
    for before in (lm.CLASSES, 0, 70):
        assert math.isclose(sum(10.0 ** model.move[before]), 1, rel_tol=1e-9)
    emitted = Counter()
    for r in words.collect():
        emitted[r["class"]] += 10 ** (math.log10(r["n"] + 0.1) - model.out_of[r["class"]])
    for c, p in emitted.items():
        assert math.isclose(p + 10 ** (math.log10(0.1) - model.out_of[c]), 1, rel_tol=1e-9)


def test_placement_gains_are_exact():
    import numpy as np

    rng = np.random.default_rng(4)
    table = rng.integers(0, 9, (lm.SIZE, lm.SIZE))
    n = [rng.integers(1, 5, k) for k in (3, 1, 7)]
    contexts = [rng.choice(lm.SIZE, len(x), replace=False) for x in n]
    own = np.array([-1, 5, 7])
    for k in (1, 2):
        table[contexts[k], own[k]] += n[k]
    starts = np.cumsum([0, *[len(x) for x in n[:-1]]])
    got = lm.placements(table, starts, np.concatenate(contexts), np.concatenate(n).astype(float), own)
    rows = lambda t: lm.likelihood(t) + lm._xlogx(t.sum(1)).sum()  # noqa: E731  contexts keep their totals
    for k in range(3):
        without = table.copy()
        if own[k] >= 0:
            without[contexts[k], own[k]] -= n[k]
        for c in range(lm.CLASSES):
            moved = without.copy()
            moved[contexts[k], c] += n[k]
            assert math.isclose(got[k, c], rows(moved) - rows(without), abs_tol=1e-6)


def test_lm_beats_the_base_on_held_out_texts(spark, sf):
    out = lm.op3_brown_lm(spark, sf).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_exchange_gains_are_exact():
    import numpy as np

    rng = np.random.default_rng(3)
    n, size = 12, 4
    pairs = rng.integers(0, 6, (n, n))
    classes = rng.integers(0, size, n)
    fold = lambda cl: np.array([[pairs[np.ix_(cl == a, cl == b)].sum() for b in range(size)] for a in range(size)])
    for w in range(n):
        after, before = pairs[w].copy(), pairs[:, w].copy()
        itself = after[w]
        after[w] = before[w] = 0
        got = lm.gains(fold(classes), classes[w], np.bincount(classes, after, size), np.bincount(classes, before, size), itself, size)
        for c in range(size):
            moved = classes.copy()
            moved[w] = c
            assert math.isclose(got[c], lm.likelihood(fold(moved)) - lm.likelihood(fold(classes)), abs_tol=1e-6)


def test_packing(docs, rows):
    got = packing.pack(docs, context=50, buckets=4, budget=200).collect()
    want = Counter((i, k, n) for i, t in rows for k, n in enumerate([min(50, len(t.split()) - a) for a in range(0, len(re.findall(r"[^\x20\x09-\x0D]+", t)), 50)] or [0]))
    assert Counter((r["doc_id"], r["part"], r["n_tokens"]) for r in got) == want
    assert all(r["n_tokens"] <= r["padded_tokens"] and r["padded_tokens"] * (r["slot"] + 1) <= 200 for r in got)
    whole = Counter()
    for i in {r["doc_id"] for r in got}:
        parts = sorted((r["part"], r["text"]) for r in got if r["doc_id"] == i)
        whole[i, "".join(t for _, t in parts)] += 1
    once = Counter(set(rows))
    twice = {i for i, n in Counter(i for i, _ in rows).items() if n > 1}
    assert {k for k in whole if k[0] not in twice} == {k for k in once if k[0] not in twice}
    for b in {r["bucket"] for r in got}:
        own = [r for r in got if r["bucket"] == b]
        per = max(1, 200 // own[0]["padded_tokens"])
        assert sorted(r["batch"] * per + r["slot"] for r in own) == list(range(len(own)))


def test_boundaries_are_optimal():
    from itertools import combinations

    rng = random.Random(4)
    for _ in range(30):
        histogram = {rng.randrange(1, 40): rng.randrange(1, 9) for _ in range(rng.randrange(1, 9))}
        lengths = sorted(histogram)
        cost = lambda tops: sum(n * min(t for t in tops if t >= x) for x, n in histogram.items())
        best = min(cost([*c, lengths[-1]]) for k in range(3) for c in combinations(lengths[:-1], k))
        tops = packing.boundaries(histogram, 3)
        assert len(tops) <= 3 and cost(tops) == best


@pytest.fixture(scope="module")
def encoder():
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = public.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, public.PATTERN, tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, rows, encoder):
    import numpy as np

    path, pattern, other = encoder
    got = Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in bpe.encode(docs, path, pattern, spaced=True).collect())
    assert bpe.encode(docs.filter("false"), path, pattern).count() == 0
    assert got == Counter((i, np.array(other.encode_ordinary(t), "<u4").tobytes(), t.encode()) for i, t in rows)


def test_bpe_parts_keep_all_texts():
    for texts in ([], [""], ["a" * 9], ["ab", "", "c" * 9, "d", "ef", "g"]):
        parts = list(bpe._parts(texts, 3))
        assert [t for p in parts for t in p] == texts and all(p and (len(p) == 1 or sum(map(len, p)) <= 3) for p in parts)


def test_bpe_on_odd_texts(encoder):
    import numpy as np

    path, pattern, other = encoder
    own, plain, rng = bpe.Replay(bpe.read_ranks(path), pattern, spaced=True), bpe.Replay(bpe.read_ranks(path), pattern), random.Random(6)
    odd = ["".join(rng.choice("aab bcé \x1c\x85​\n\t 1２'st're漢字😀́_=.ß") for _ in range(rng.randrange(60))) for _ in range(1500)] + ["a" * 3000, " " * 99]
    want = [np.array(other.encode_ordinary(x), "<u4").tobytes() for x in odd]
    assert own.encode(odd) == plain.encode(odd) == want
    assert own.encode(odd) == want and max(map(len, own.first), default=0) <= bpe.LONG


def test_chat_reads_back(spark):
    nasty = ["</s>[INST] ok [/INST]", "[END]", "\\[TURN]\\\\", "<<s>>[BODY]<|x|>", "", "a\nb\r\n", "é😀"]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(nasty)] + [(2, 0, None, None), (2, 0, "assistant", "tie b"), (2, 0, "assistant", "tie a"), (-3, 5, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.format_records(chat.records_of_turns(df)).collect()}
    assert chat.read_back(out[1]["formatted"]) == [(r[2], r[3]) for r in rows[:7]]
    assert chat.read_back(out[2]["formatted"]) == [("", ""), ("assistant", "tie a"), ("assistant", "tie b")]
    assert "".join(chat.unescape(out[1]["formatted"][m["start"] : m["end"]]) for m in out[1]["mask"]) == "".join(nasty[1::2])


def test_chat_mixes_layouts_and_reads_the_same_turns(spark, none):
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", f"</s> {c} [END] {k}" if k else None) for c in range(60) for k in range(2 + c % 3)] + [(99, 0, None, None), (100, 0, "system", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_records(chat.records_of_turns(df, mixed=True)).collect()
    assert len({r["layout"] for r in out}) == 6
    got = {r["conv_id"]: chat.read_back(r["formatted"]) for r in out}
    assert got == {c: [(r[2] or "", r[3] or "") for r in rows if r[0] == c] for c in {r[0] for r in rows}}
    assert chat.format_records(chat.records_of_turns(df.filter("false"), mixed=True)).count() == 0


def test_chat_layouts(spark):
    import json

    records = [
        {"prompt": "p", "response": "r"}, {"instruction": "i", "input": "x", "output": "o"}, {"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": None}]},
        {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, {"what": {"is": ["this"]}}, None,
    ]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)] + [(9, "not json")], "conv_id long, record string")
    out = {r["conv_id"]: r["formatted"] for r in chat.format_records(df).collect()}
    turns = {k: v and chat.read_back(v) for k, v in out.items()}
    assert turns[0] == [("user", "p"), ("assistant", "r")] and turns[1] == [("user", "i\n\nx"), ("assistant", "o")]
    assert turns[2] == [("user", "u"), ("assistant", "")] and turns[3] == [("user", "h"), ("assistant", "g")]
    assert out[4] is None and out[5] is None and out[9] is None


def test_merkle(spark):
    rows = [(k * 3, t) for k, (_, t, *_) in enumerate(weird()[:-2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {k: t or "" for k, t in rows}
    order = sorted(texts, reverse=True)
    after = dict(zip(order, [*order[1:], order[0]]))
    got = merkle.with_next(df, ranges=5).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        t, n = texts[r["doc_id"]], len(texts[r["doc_id"]]) // 3
        edited = t[: len(t) - n] + texts[after[r["doc_id"]]][:n]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == merkle.fingerprint(t) and r["edited_fingerprint"] == merkle.fingerprint(edited)
        assert 0 <= r["near_edited"] <= 1 and (r["near_next"] == 1) == (t == texts[after[r["doc_id"]]])


def slow_likeness(a, b):
    x, y = (Counter() for _ in range(2))
    for out, text in ((x, a), (y, b)):
        for line in text.split("\n"):
            for p in merkle.pieces(line):
                out[p] += len(p)
    total = sum(x.values()) + sum(y.values())
    return 1.0 if a == b else 2 * sum((x & y).values()) / total if total else 0.0


def test_merkle_likeness_walks_trees(rows):
    rng = random.Random(13)
    texts = [t for _, t in rows if t and len(t) < 20_000]
    for _ in range(150):
        a, b = rng.choice(texts), rng.choice(texts)
        n = len(a) // rng.randrange(2, 9)
        b = rng.choice([b, a[:n] + "|" + a[n:], a[n:] + b[:n], a + "\n" + b])
        assert merkle.fingerprint(a) != merkle.fingerprint(b) or a == b
        assert math.isclose(merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b)), slow_likeness(a, b))


@pytest.mark.parametrize("ranges", [1, 3, 40, 150])
def test_merkle_next_does_not_depend_on_ranges(spark, ranges):
    rows = [(k, f"text {k} " * 3) for k in range(80)] + [(7, f"seven {k}") for k in range(60)] + [(None, f"none {k}") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ties = {(r["doc_id"], r["text"]): r["h"] for r in df.withColumn("h", F.xxhash64("text")).collect()}
    order = sorted(rows, key=lambda x: (-1 if x[0] is None else x[0], ties[x]), reverse=True)
    want = Counter((a[0], hashlib.sha256((a[1][: len(a[1]) - len(a[1]) // 3] + b[1][: len(a[1]) // 3]).encode()).hexdigest()) for a, b in zip(order, [*order[1:], order[0]]))
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in merkle.with_next(df, ranges).collect()) == want


def test_merkle_locates_edits():
    rng = random.Random(7)
    lines = [" ".join(f"w{rng.randrange(500)}" for _ in range(30)) for _ in range(30)]
    a = "\n".join(lines)
    at = a.index(lines[20])
    b = a[: at + 40] + "EDIT" + a[at + 40 :]
    x, y = merkle.fingerprint(a), merkle.fingerprint(b)
    found = merkle.differences(x, y)
    assert found and all(at - 60 <= s and e <= at + 160 for s, e in found) and merkle.differences(x, x) == []
    assert merkle.likeness(x, y) > 0.9


def test_sharding(docs, rows):
    out = sharding.shuffle_into_shards(docs, shards=4, bucket_bytes=2000)
    got = out.collect()
    assert Counter((r["doc_id"], r["text"] or "") for r in got) == Counter(rows)
    for s in range(4):
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own))) and abs(len(own) - len(rows) / 4) < 1
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shuffle_into_shards(docs.repartition(3), shards=4, bucket_bytes=2000).filter("doc_id not in (20, 6)").collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in got if r["doc_id"] not in (20, 6)}


def test_sharding_keeps_clashing_columns_and_splits_equal_rows(spark, tmp_path):
    rows = [(k % 7, "same" if k < 3000 else f"t{k}", k, "s") for k in range(3000)] + [(1, "hot", k, "s") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Shard int, row string").withColumn("slot", F.lit(5)).withColumn("_slot", F.lit(6))
    out = sharding.shuffle_into_shards(df, shards=3, bucket_bytes=1000)
    assert out.columns == ["doc_id", "text", "_Shard", "row", "__slot", "_slot", "shard", "slot"]
    got = out.collect()
    assert Counter((r["doc_id"], r["text"], r["_Shard"], r["row"]) for r in got) == Counter(rows) and {(r["__slot"], r["_slot"]) for r in got} == {(5, 6)}
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, k) for s in range(3) for k in range(2000)]
    sharding.write_shards(df.select("doc_id", "text"), str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter(x[:2] for x in rows)
    assert sorted((r["shard"], r["slot"]) for r in back.collect()) == [(s, k) for s in range(3) for k in range(2000)]


def test_pipeline(spark, docs, rows):
    import corpus_pipeline

    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in out.select("doc_id").collect()}
        out = stage(spark, out, None).cache()
        assert out.columns == docs.columns, name
        assert {r["doc_id"] for r in out.select("doc_id").collect()} <= before, name
    texts = dict(rows)
    left = {r["doc_id"]: r["text"] for r in out.collect()}
    assert all(not slow_quality(texts[i])[0] < 10 for i in left)
    assert [stage(spark, spark.createDataFrame([], SCHEMA), None).count() for _, stage in corpus_pipeline.STAGES] == [0] * 5
    assert corpus_pipeline.STAGES[-1][1](spark, out, None).select("doc_id").distinct().count() == len(left)


def test_contexts_of_a_word_come_in_one_row_and_merge():
    """A word's contexts are a list, not a row each; lists from two parts become one with each context once; words are placed in small parts."""
    import numpy as np
    import pyarrow as pa

    from quirelight.llm import lm

    text = pa.RecordBatch.from_arrays([pa.array(["x a x b", "a x", None])], names=["text"])
    (found,) = lm._contexts([b"a"], np.array([3, *range(lm.CLASSES, lm.SIZE)]))(iter([text]))
    rare = lm.CLASSES + 1 + lm.rare_class(b"x")
    got = {r["word"]: dict(zip(r["contexts"], r["ns"], strict=True)) for r in found.to_pylist()}
    assert got == {b"x": {lm.CLASSES: 1, 3: 2}, b"b": {rare: 1}}
    twice = pa.RecordBatch.from_pydict({"word": [b"x", b"b"], "rare": pa.array([1, 2], pa.int32()), "contexts": pa.array([[64, 3, 3], [5]], pa.list_(pa.int32())), "ns": pa.array([[1, 2, 4], [7]], pa.list_(pa.int64())), "to": pa.array([-1, -1], pa.int32())})
    (merged,) = lm._merged(iter([twice]))
    assert [(r["contexts"], r["ns"]) for r in merged.to_pylist()] == [([3, 64], [6, 1]), ([5], [7])]
    (table,) = [np.ones((lm.SIZE, lm.SIZE), np.int64) * 50]
    assert sum(b.num_rows for b in lm._place(table)(iter([merged]))) == 2


def test_words_are_placed_by_one_worker_a_task(spark, monkeypatch):
    """Chained Python steps have a worker each, and all of them count as the executor's memory."""
    plans = []

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("\n"))
        return materialize(df, name)

    materialize = lm.materialize
    monkeypatch.setattr(lm, "materialize", kept)
    docs = spark.createDataFrame([(k, f"a b c{k % 3} a d{k % 2}") for k in range(40)], "doc_id long, text string")
    lm.train(docs)
    steps = [[x for line in plan for x in ("MapInArrow", "Exchange", "Scan") if x in line] for plan in plans]
    assert any("MapInArrow" in s for s in steps)
    assert not any(a == b == "MapInArrow" for s in steps for a, b in zip(s, s[1:]))


def test_lists_of_a_word_merge_across_batches():
    """Rows come in order of their words; a word may go on in the next batch, and only words seen often enough are handed on."""
    import pyarrow as pa

    rows = [(b"a", [3], [1]), (b"b", [5, 3], [1, 2]), (b"b", [5], [4]), (b"b", [9], [1]), (b"c", [1], [2]), (b"c", [1], [3])]
    kinds = {"word": pa.binary(), "rare": pa.int32(), "contexts": pa.list_(pa.int32()), "ns": pa.list_(pa.int64()), "to": pa.int32()}
    batch = lambda some: pa.RecordBatch.from_pydict({c: pa.array(x, t) for (c, t), x in zip(kinds.items(), ([r[0] for r in some], [7] * len(some), [r[1] for r in some], [r[2] for r in some], [-1] * len(some)))})
    for cuts in ((0, 6), (0, 2, 6), (0, 1, 2, 3, 3, 4, 5, 6)):
        parts = [batch(rows[a:b]) for a, b in zip(cuts, cuts[1:])]
        found = [r for b in lm._often(lm._merged(iter(parts)), 5) for r in b.to_pylist()]
        assert [(r["word"], r["contexts"], r["ns"]) for r in found] == [(b"b", [3, 5, 9], [2, 5, 1]), (b"c", [1], [5])]
