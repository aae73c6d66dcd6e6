r"""Chat formatting: a fingerprint of the nested field paths selects a declarative mapping to canonical turns.

A record is a JSON object. Its fingerprint is the SHA-256 of its sorted leaf paths (`messages[].role`), metadata fields left out;
`MAPPINGS` says for each known set of paths where roles and texts are. Canonical turns are then written with one template

    <s>[INST]role[/INST]text</s>[INST]role[/INST]text</s>...

and the spans of assistant texts are the loss mask. Control strings inside roles and texts are escaped reversibly: every `\`
becomes `\\`, then `\.` is put after the first character of each control string, so the formatted text holds control strings only
where the template put them. `read_back` splits the formatted text at them and undoes the escapes.

Defined cases: a null text or role is empty, a record that is null, no JSON object or of an unknown layout keeps its row with
`layout`, `formatted` and `loss` null, an empty message list gives `<s>` and no turns, repeated rows are formatted each.
One conversation is one record and is formatted by one task, as its digest is of one string.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_CONTROL = re.compile(r"([<\[])(?=/?s>|/?INST\])")
_TURN = re.compile(r"\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)
#: Record fields that say nothing about the layout.
METADATA = frozenset({"id", "conv_id", "source", "lang", "meta"})


class Mapping(NamedTuple):
    """turns: role and the fields whose texts, joined by an empty line where not empty, make the turn; or messages: the list,
    its role field and its text field. roles: names that differ from the canonical ones."""

    name: str
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    messages: tuple[str, str, str] | None = None
    roles: dict[str, str] = {}

    def layouts(self) -> list[list[str]]:
        if self.messages:
            at, role, text = self.messages
            return [[f"{at}[].{role}", f"{at}[].{text}"], [f"{at}[]"]]
        return [[field for _, fields in self.turns for field in fields]]


MAPPINGS = (
    Mapping("prompt", (("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("completion", (("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("system_prompt", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question", (("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("instruction", (("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("plain_instruction", (("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("messages", messages=("messages", "role", "content")),
    Mapping("conversations", messages=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}),
    Mapping("turns", messages=("turns", "speaker", "text"), roles={"bot": "assistant"}),
)


def _leaves(value: object, path: str) -> Iterator[str]:
    if isinstance(value, dict) and value:
        for name, inner in value.items():
            yield from _leaves(inner, f"{path}.{name}" if path else name)
    elif isinstance(value, list):
        if not value:
            yield f"{path}[]"
        for inner in value:
            yield from _leaves(inner, f"{path}[]")
    else:
        yield path


def _digest(paths: list[str] | set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def fingerprint(record: dict) -> str:
    return _digest(set(_leaves({k: v for k, v in record.items() if k not in METADATA}, "")))


REGISTRY = {_digest(paths): mapping for mapping in MAPPINGS for paths in mapping.layouts()}


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical(record: object) -> tuple[str, list[tuple[str, str]]] | None:
    """Name of the layout and the turns, or None if the layout is unknown."""
    mapping = REGISTRY.get(fingerprint(record)) if isinstance(record, dict) else None
    if mapping is None:
        return None
    if mapping.messages:
        at, role, text = mapping.messages
        names = [(_text(m[role]), _text(m[text])) for m in record[at]]
        return mapping.name, [(mapping.roles.get(name, name), said) for name, said in names]
    return mapping.name, [
        (role, "\n\n".join(t for t in (_text(record[f]) for f in fields) if t)) for role, fields in mapping.turns
    ]


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\.", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\|\.)", lambda m: "\\" if m[1] == "\\" else "", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text and the code point spans of its assistant texts."""
    parts, at, loss = ["<s>"], 3, []
    for role, text in turns:
        head, body = f"[INST]{escape(role)}[/INST]", escape(text)
        at += len(head)
        if role == "assistant":
            loss.append((at, at + len(body)))
        at += len(body) + 4
        parts += [head, body, "</s>"]
    return "".join(parts), loss


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def format_records(records: DataFrame, key: str = "conv_id", record: str = "record") -> DataFrame:
    """id, layout, fingerprint, formatted, loss: the formatted conversation of each JSON record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(1).to_pylist():
                try:
                    value = json.loads(text) if text is not None else None
                except ValueError:
                    value = None
                found = canonical(value)
                formatted, loss = render(found[1]) if found else (None, None)
                spans = None if loss is None else [{"start": a, "end": b} for a, b in loss]
                out.append((found and found[0], fingerprint(value) if isinstance(value, dict) else None, formatted, spans))
            layout, print_, formatted, loss = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(layout, pa.string()), pa.array(print_, pa.string()), pa.array(formatted, pa.string()),
                 pa.array(loss, _SPANS)],
                ["id", "layout", "fingerprint", "formatted", "loss"],
            )

    return records.select(F.col(key).cast("long").alias("id"), F.col(record).cast("string").alias("record")).mapInArrow(
        run, "id long, layout string, fingerprint string, formatted string, loss array<struct<start: long, end: long>>"
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """id, turns, loss_texts: what the formatted text and its mask hold, escapes undone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            texts, masks = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            turns = [None if t is None else [{"role": r, "text": x} for r, x in parse(t)] for t in texts]
            loss = [None if t is None else [unescape(t[s["start"]:s["end"]]) for s in m] for t, m in zip(texts, masks, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(turns, turn), pa.array(loss, pa.list_(pa.string())), batch.column(1)],
                ["id", "turns", "loss_texts", "formatted"],
            )

    return formatted.select("id", "formatted", "loss").mapInArrow(
        run, "id long, turns array<struct<role: string, text: string>>, loss_texts array<string>, formatted string"
    )


def records_of_turns(turns: DataFrame) -> DataFrame:
    """conv_id, record: the rows (conv_id, turn, role, text) of each conversation as one JSON record, in the order of turn, role
    and text. A user and an assistant turn make a prompt record, a conversation that opens with a system turn and has only the
    three usual roles a `conversations` record, any other a `messages` record."""
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(said)).alias("said"))
    roles = F.transform("said", lambda s: s["role"])
    usual = F.size(F.array_except(roles, F.array(*map(F.lit, ("system", "user", "assistant"))))) == 0
    names = {"user": "human", "assistant": "gpt", "system": "system"}
    renamed = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    prompt = F.struct(F.get("said", F.lit(0))["text"].alias("prompt"), F.get("said", F.lit(1))["text"].alias("response"))
    shared = F.struct(F.transform("said", lambda s: F.struct(renamed[s["role"]].alias("from"), s["text"].alias("value"))).alias("conversations"))
    plain = F.struct(F.transform("said", lambda s: F.struct(s["role"].alias("role"), s["text"].alias("content"))).alias("messages"))
    record = (
        F.when(roles == F.array(F.lit("user"), F.lit("assistant")), F.to_json(prompt))
        .when(usual & (F.get(roles, F.lit(0)) == "system"), F.to_json(shared))
        .otherwise(F.to_json(plain))
    )
    return grouped.select("conv_id", record.alias("record"))
