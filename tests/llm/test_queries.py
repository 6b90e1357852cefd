"""The registered queries over a whole small table: their columns and digests, from plain versions of what the contracts say."""

import hashlib
import json
import random
import zlib
from collections import Counter

import duckdb
import pytest

from quirelight import llm
from quirelight.llm import quality

from .test_llm import SCHEMA, encoder, slow_cut, slow_fingerprint, slow_groups, weird  # noqa: F401


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def boilerplate():
    """Thirty documents of one host that are mostly a shared notice, thirty that hold it once, and thirty of another host with their own lines."""
    rng = random.Random(3)
    say = lambda n: " ".join(str(rng.randrange(10**6)) for _ in range(n))
    notice = "\n".join(say(10) for _ in range(4))
    texts = [(f"{notice}\n{say(12)}", "h") for _ in range(30)] + [(f"{notice}\n{say(200)}", "h") for _ in range(30)] + [(say(40), "other") for _ in range(30)]
    return [(1000 + k, t, "en", host, len(t), "k", 1, "l", "d", "z") for k, (t, host) in enumerate(texts)]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(weird() + boilerplate(), SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    nasty = ["</s>[INST] ok [/INST]", "[END]", "\\[TURN]\\\\", "", "a\nb\r\n", "é😀", None]
    turns = [(c, k, ("user", "assistant", "system", "human", "gpt")[(c + k) % 5 if c % 3 else k % 2], nasty[(c + 3 * k) % 7]) for c in range(120) for k in range(2 if c % 2 else 1 + c % 5)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return at, turns


@pytest.fixture(scope="module")
def texts():
    return [(r[0], r[1] or "") for r in weird() + boilerplate()]


def run(spark, table, name):
    return llm.queries()[name](spark, table[0])


def test_op1(spark, table, texts):
    prints = {k: slow_fingerprint(t) for k, t in texts}
    group = slow_groups(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in run(spark, table, "op1_simhash").collect())
    assert got == Counter((k, f"{prints[k]:016x}", group[k]) for k, _ in texts)


def test_op2(spark, table, texts):
    want = Counter((k, n, gone, runs, sha(kept)) for (k, _), (n, gone, runs, kept) in zip(texts, slow_cut([t.encode() for _, t in texts]), strict=True))
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in run(spark, table, "op2_suffix").collect())
    assert got == want and any(x[2] for x in got)


def test_op2_returns_what_remains(spark, table, texts):
    want = Counter((k, kept.decode("utf-8", "ignore")) for (k, _), (_, _, _, kept) in zip(texts, slow_cut([t.encode() for _, t in texts]), strict=True))
    assert Counter((r["doc_id"], r["text"]) for r in run(spark, table, "op2_suffix").collect()) == want


def test_op4_texts_are_whole(spark, table, texts):
    rows = run(spark, table, "op4_packing").collect()
    assert {r["doc_id"] for r in rows} == {k for k, _ in texts} and len({(r["bucket"], r["batch"], r["slot"]) for r in rows}) == len(rows)
    words = Counter()
    for r in rows:
        assert r["n_tokens"] <= r["padded_tokens"] <= 2048 and len(r["text_sha256"]) == 64
        words[r["doc_id"]] += r["n_tokens"]
    want = Counter()
    for k, t in texts:
        want[k] += len([w for w in t.replace("\x0b", " ").replace("\x0c", " ").split() if w])
    assert +words == +want


def test_op5(spark, table, texts, encoder):  # noqa: F811
    import numpy as np

    want = Counter()
    for k, t in texts:
        ids = encoder[2].encode_ordinary(t)
        want[k, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run(spark, table, "op5_bpe").collect()) == want


@pytest.mark.parametrize("where", ["small", "given"])
def test_op6_equals_its_sql(spark, sf, table, where):
    """In the small table the notice decides: who is mostly made of it goes, the first holder and those with more text stay."""
    at = table[0] if where == "small" else sf
    df = llm.queries()["op6_quality_rules"](spark, at)
    con = duckdb.connect()
    source = f"{at}/documents.parquet"
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{source}{'/*.parquet' if where == 'small' else ''}'")
    names = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({quality.OP6_SQL.strip()})").fetchall()
    got = df.select(*names).collect()
    assert Counter(map(tuple, got)) == Counter(want)
    if where == "small":
        fate = {r["doc_id"]: (r["kept"], r["base_failed"]) for r in got if r["doc_id"] >= 1000}
        assert fate == {k: (not 1001 <= k < 1030, False) for k in range(1000, 1090)}


def test_op7_and_op3_have_a_row_a_document(spark, table, texts):
    ids = Counter(k for k, _ in texts)
    rows = run(spark, table, "op7_line_templates").collect()
    assert Counter(r["doc_id"] for r in rows) == ids
    kept = {(k, sha(t)) for k, t in texts}
    assert all((r["doc_id"], r["kept_sha256"]) in kept for r in rows if not r["n_dropped"])
    scored = run(spark, table, "op3_brown_lm").collect()
    assert Counter(r["doc_id"] for r in scored) == ids
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) and r["score"] < 0 and r["base_score"] < 0 for r in scored)


def test_op8(spark, table):
    said = {}
    for c, k, role, text in table[1]:
        said.setdefault(c, []).append((k, role, text or ""))
    said = {c: [(role, text) for _, role, text in sorted(x)] for c, x in said.items()}
    said[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    want = set()
    for c, x in said.items():
        loss = "".join(text for role, text in x if role == "assistant")
        want.add((c, len(x), sha("".join(f"{role}\n{text}\n" for role, text in x)), len(loss), sha(loss)))
    got = run(spark, table, "op8_chat_format").collect()
    assert len(got) == len(want) and {(r["conv_id"], r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == want
    assert len({r["layout"] for r in got}) == 6


def test_op9(spark, table, texts):
    rows = run(spark, table, "op9_merkle").collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in rows) == Counter((k, len(t)) for k, t in texts)
    order = sorted({k for k, _ in texts}, reverse=True)
    of = dict(texts)
    for k, after in zip(order, [*order[1:], order[0]], strict=True):
        n = len(of[k]) // 3
        edited = of[k][: len(of[k]) - n] + of[after][:n]
        mine = [r for r in rows if r["doc_id"] == k]
        if len(mine) == 1:  # rows that share an id follow each other first
            assert mine[0]["edited_sha256"] == sha(edited) and (mine[0]["fingerprint"] == mine[0]["edited_fingerprint"]) == (edited == of[k])
    prints = {}
    for r in rows:
        prints.setdefault(of[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in prints.values()) and len(set.union(*prints.values())) == len(prints)


def test_op10(spark, table, texts):
    rows = run(spark, table, "op10_shuffled_shards").collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((k, len(t.encode()) + 1, zlib.crc32(t.encode())) for k, t in texts)
    slots = {}
    for r in rows:
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < 16
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1


def test_every_query_is_registered():
    assert list(llm.queries()) == sorted(llm.queries(), key=lambda x: int(x[2:].split("_")[0])) and len(llm.queries()) == 13
    assert set(llm.oracle_sql()) <= set(llm.queries()) and json.dumps(llm.oracle_sql())
