r"""Chat formatting by schema fingerprints.

A record is JSON. Its nested field paths (`messages[].role`), without values, are sorted and hashed; the fingerprint selects a
declarative mapping, which says where turns, roles and texts are. So records of prompt, instruction and message layouts, mixed in
one table, become canonical turns (role, text). Unknown layouts give no turns and keep their fingerprint, so they can be counted
and mapped; nothing is guessed.

The template: `<s>` once, then for each turn `[TURN]role[BODY]text[END]`. In roles and texts a backslash is doubled and each
control string gets a backslash after its first character, so text can never look like a mark, and reading back is exact.
The loss mask is the list of code-point ranges of the formatted string that hold assistant texts.

Defined results: null texts and roles are empty; a conversation's rows are ordered by (turn, role, text), nulls first, so ties and
repeated rows have one order and are all kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURN, BODY, END, START = "[TURN]", "[BODY]", "[END]", "<s>"
#: Own marks, and those of common public templates, which are escaped too.
CONTROLS = (TURN, BODY, END, START, "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "|>")
#: Names for the three roles that layouts with a "from" or "speaker" field use; roles of a "role" field stay as given.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


def paths(value, at: str = "") -> set[str]:
    """The nested field paths of a JSON value. An empty list or object is a path of its own."""
    if isinstance(value, dict) and value:
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(paths(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(found: set[str]) -> str:
    return hashlib.blake2b("\n".join(sorted(found)).encode(), digest_size=8).hexdigest()


def _layouts() -> dict[str, dict]:
    """Fingerprint to mapping. `each`: a list of turns with role and text fields, and what its role names mean; `turns`: (role, fields),
    fields joined by a blank line."""
    out = {}
    for top in ("messages", "conversations", "conversation", "turns", "dialogue"):
        for role, text in (("role", "content"), ("from", "value"), ("speaker", "text"), ("role", "text")):
            out[fingerprint({f"{top}[].{role}", f"{top}[].{text}"})] = {"each": top, "role": role, "text": text, "roles": {} if role == "role" else ROLES}
        out[fingerprint({top})] = {"each": top, "role": "role", "text": "content", "roles": {}}
    for ask in ("prompt", "question", "instruction", "input"):
        for answer in ("response", "completion", "answer", "output"):
            if ask == "input" and answer == "output" or ask != "input":
                out[fingerprint({ask, answer})] = {"turns": [("user", (ask,)), ("assistant", (answer,))]}
                out[fingerprint({"system", ask, answer})] = {"turns": [("system", ("system",)), ("user", (ask,)), ("assistant", (answer,))]}
    for answer in ("output", "response"):
        for extra in ("input", "context"):
            out[fingerprint({"instruction", extra, answer})] = {"turns": [("user", ("instruction", extra)), ("assistant", (answer,))]}
    return out


LAYOUTS = _layouts()


def turns_of(record) -> tuple[str, list[tuple[str, str]] | None]:
    """The fingerprint and the canonical turns of a record; None if its layout has no mapping."""
    mark = fingerprint(paths(record))
    mapping = LAYOUTS.get(mark)
    text = lambda x: "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    if mapping is None:
        return mark, None
    if "each" in mapping:
        rows = record[mapping["each"]]
        if not isinstance(rows, list):
            return mark, [] if rows is None else None
        found = [(text(x.get(mapping["role"])), text(x.get(mapping["text"]))) for x in rows]
        return mark, [(mapping["roles"].get(role, role), said) for role, said in found]
    found = [(role, "\n\n".join(s for s in (text(record[f]) for f in fields) if s)) for role, fields in mapping["turns"]]
    return mark, [(role, said) for role, said in found if said or role != "system"]


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for mark in CONTROLS:
        text = text.replace(mark, f"{mark[0]}\\{mark[1:]}")
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss mask."""
    parts, at, mask = [START], len(START), []
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{BODY}", escape(text)
        at += len(head)
        if role == "assistant":
            mask.append((at, at + len(body)))
        at += len(body) + len(END)
        parts += (head, body, END)
    return "".join(parts), mask


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out = []
    for part in formatted[len(START) :].split(END)[:-1]:
        role, _, body = part[len(TURN) :].partition(BODY)
        out.append((unescape(role), unescape(body)))
    return out


SCHEMA = "conv_id long, layout string, formatted string, mask array<struct<start:long,end:long>>"


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("layout", pa.string()), ("formatted", pa.string()), ("mask", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    for batch in batches:
        rows = []
        for conv, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                mark, turns = turns_of(json.loads(record or "null"))
            except ValueError:
                mark, turns = None, None
            formatted, mask = render(turns) if turns is not None else (None, None)
            rows.append({"conv_id": conv, "layout": mark, "formatted": formatted, "mask": mask and [{"start": a, "end": b} for a, b in mask]})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def format_records(records: DataFrame, key: str = "conv_id", record: str = "record") -> DataFrame:
    """One row per JSON record: conv_id, layout (fingerprint; null if not JSON), formatted (null if unmapped) and mask."""
    return records.select(F.col(key).cast("long"), F.col(record).cast("string")).mapInArrow(_format, SCHEMA)


#: How records_of_turns can write a conversation: (top field, role field, text field) of a list of turns.
LISTS = (("messages", "role", "content"), ("conversations", "from", "value"), ("turns", "speaker", "text"), ("dialogue", "role", "text"))


def records_of_turns(rows: DataFrame, mixed: bool = False) -> DataFrame:
    """Rows (conv_id, turn, role, text) as one JSON record per conversation: of the messages layout, or (mixed) of a layout that follows
    from conv_id, as a corpus from several makers has them; a user and an assistant turn alone can be a prompt and a response. A role that a
    layout would rename keeps its conversation in the messages layout."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def as_list(top: str, role: str, text: str):
        return F.to_json(F.struct(F.transform("turns", lambda t: F.struct(t["role"].alias(role), t["text"].alias(text))).alias(top)))

    lists = [as_list(*names) for names in LISTS]
    if not mixed:
        return turns.select("conv_id", lists[0].alias("record"))
    says = F.transform("turns", lambda t: t["text"])
    pair = lambda ask, answer: F.to_json(F.struct(F.get(says, F.lit(0)).alias(ask), F.get(says, F.lit(1)).alias(answer)))
    two = F.transform("turns", lambda t: t["role"]) == F.array(F.lit("user"), F.lit("assistant"))
    kind = F.pmod(F.xxhash64("conv_id"), F.lit(len(LISTS)))
    renamed = F.exists("turns", lambda t: t["role"].isin(*ROLES))
    record = F.when(renamed, lists[0]).when(two & (kind == 0), pair("prompt", "response")).when(two & (kind == 1), pair("instruction", "output"))
    for k, one in enumerate(lists):
        record = record.when(kind == k, one)
    return turns.select("conv_id", record.alias("record"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for x in batch.to_pylist():
            turns = read_back(x["formatted"])
            loss = "".join(unescape(x["formatted"][m["start"] : m["end"]]) for m in x["mask"] or [])
            said = "".join(f"{role}\n{text}\n" for role, text in turns)
            rows.append((x["conv_id"], len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(x["formatted"]), x["layout"]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "layout"],
        )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    planted = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], "conv_id long, turn long, role string, text string")
    return format_records(records_of_turns(rows.unionByName(extra), mixed=True)).mapInArrow(
        _digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, layout string"
    )
