"""Chat formatting: records of any known layout to one template, with a loss mask.

A record is a JSON object.  The sorted paths of its fields (``messages[].role``)
are hashed, and the hash selects a declarative mapping that says where its turns
are.  Paths that no mapping mentions do not count, so further fields are no
obstacle; a record that fits no mapping, or is no JSON object, has null turns.

The template marks turns with control strings.  Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|``, so that a text can hold control
strings and is read back unchanged.  The loss mask lists the code points of the
formatted text that hold assistant texts.

Null roles and texts are empty.  Repeated rows and extra columns are kept.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import added, map_batches, without

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"
_TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """Turns from a list (``turns``, with ``role`` and ``text`` in each) or from ``fields``."""

    name: str
    turns: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()  # (role, path)
    optional: tuple[str, ...] = ()
    renamed: tuple[tuple[str, str], ...] = ()

    def path_sets(self) -> list[frozenset[str]]:
        """The sets of paths that select this mapping: with and without each optional one."""
        if self.turns:
            needed = {f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"}
            return [frozenset(needed)]
        needed = {path for _, path in self.fields} - set(self.optional)
        return [
            frozenset(needed | set(some))
            for n in range(len(self.optional) + 1)
            for some in combinations(self.optional, n)
        ]


MAPPINGS = (
    Mapping("messages", turns="messages", role="role", text="content"),
    Mapping(
        "shared",
        turns="conversations",
        role="from",
        text="value",
        renamed=(("human", "user"), ("gpt", "assistant")),
    ),
    Mapping(
        "instruction",
        fields=(
            ("system", "system"),
            ("user", "instruction"),
            ("user", "input"),
            ("assistant", "output"),
        ),
        optional=("system", "input"),
    ),
    Mapping(
        "prompt",
        fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")),
        optional=("system",),
    ),
    Mapping(
        "nested",
        fields=(("user", "request.text"), ("assistant", "reply.text")),
    ),
)


def fingerprint(paths) -> str:
    return hashlib.blake2b("\n".join(sorted(paths)).encode(), digest_size=8).hexdigest()


def paths_of(value, prefix: str = "") -> set[str]:
    """Paths of all leaves; the elements of a list share ``[]``."""
    found: set[str] = set()
    stack = [(prefix, value)]
    while stack:
        path, node = stack.pop()
        if isinstance(node, dict):
            stack += [(f"{path}.{k}" if path else k, v) for k, v in node.items()]
        elif isinstance(node, list):
            stack += [(f"{path}[]", v) for v in node]
        else:
            found.add(path)
    return found


def _at(record, path: str):
    for name in path.split("."):
        record = record.get(name) if isinstance(record, dict) else None
    return record


def _string(value) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


class Layouts:
    """Mappings by fingerprint."""

    def __init__(self, mappings):
        self.known, self.by_print = set(), {}
        for mapping in mappings:
            for paths in mapping.path_sets():
                self.known |= paths
                if self.by_print.setdefault(fingerprint(paths), mapping) is not mapping:
                    raise ValueError(f"{mapping.name} cannot be told from another mapping")
        self.lists = {m.turns for m in mappings if m.turns}

    def turns(self, text: str | None):
        """(mapping's name, [(role, text)]) or (None, None)."""
        try:
            record = json.loads(text) if text else None
        except (ValueError, RecursionError):
            record = None
        if not isinstance(record, dict):
            return None, None
        for name in self.lists & record.keys():
            if record[name] == []:  # no element, so no path: an empty conversation
                return next(m.name for m in self.by_print.values() if m.turns == name), []
        mapping = self.by_print.get(fingerprint(paths_of(record) & self.known))
        if mapping is None:
            return None, None
        if mapping.turns:
            renamed = dict(mapping.renamed)
            rows = [
                (_string(_at(x, mapping.role)), _string(_at(x, mapping.text)))
                for x in _at(record, mapping.turns)
            ]
            return mapping.name, [(renamed.get(role, role), text) for role, text in rows]
        rows = [(role, path) for role, path in mapping.fields if _at(record, path) is not None]
        return mapping.name, [(role, _string(_at(record, path))) for role, path in rows]


def canonical(
    df: DataFrame, record: str, mappings=MAPPINGS, turns: str = "turns", layout: str = "layout"
) -> DataFrame:
    """``df`` with the record's ``turns`` and the name of its ``layout`` (replaced if there)."""
    kept, layouts = without(df, turns, layout), Layouts(mappings)
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def mapped(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [layouts.turns(x) for x in batch.column(record).to_pylist()]
        lists = [t if t is None else [{"role": r, "text": x} for r, x in t] for _, t in found]
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(lists, kind), pa.array([n for n, _ in found], pa.string())],
            names=[*batch.schema.names, turns, layout],
        )

    return map_batches(kept, mapped, added(kept, **{turns: _TURNS, layout: "string"}))


def escape(text: str | None) -> str:
    return (text or "").replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def render(turns) -> tuple[str, list[tuple[int, int]]]:
    """(text in the template, code points of the assistant's texts in it)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = f"{START}{escape(role).replace('\n', '\\\n')}\n"
        body = escape(text)
        if role == TRAINED:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns, at = [], 0
    while at < len(formatted):
        # escaped texts hold no control string, so the next one ends the turn
        line = at + len(START)
        while formatted[line] != "\n":
            line += 2 if formatted[line] == "\\" else 1
        end = formatted.index(END, line)
        turns.append((unescape(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return turns


def formatted(
    df: DataFrame, turns: str = "turns", text: str = "formatted", loss: str = "loss"
) -> DataFrame:
    """``df`` with the ``formatted`` text and its ``loss`` spans; null turns give nulls."""
    kept = without(df, text, loss)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def rendered(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, spans = [], []
        for value in batch.column(turns).to_pylist():
            if value is None:
                texts.append(None)
                spans.append(None)
                continue
            out, where = render([(t["role"] or "", t["text"] or "") for t in value if t])
            texts.append(out)
            spans.append([{"start": a, "end": b} for a, b in where])
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(texts, pa.string()), pa.array(spans, kind)],
            names=[*batch.schema.names, text, loss],
        )

    fields = {text: "string", loss: "array<struct<start:long,end:long>>"}
    return map_batches(kept, rendered, added(kept, **fields))


def read_back(
    df: DataFrame,
    text: str = "formatted",
    loss: str = "loss",
    turns: str = "read_turns",
    trained: str = "loss_text",
) -> DataFrame:
    """``df`` with the turns of the formatted text and all text under its loss mask, unescaped."""
    kept = without(df, turns, trained)
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists, masked = [], []
        for value, spans in zip(batch.column(text).to_pylist(), batch.column(loss).to_pylist()):
            known = value is not None
            lists.append([{"role": r, "text": t} for r, t in parse(value)] if known else None)
            masked.append(
                "".join(unescape(value[s["start"] : s["end"]]) for s in spans or [])
                if known
                else None
            )
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(lists, kind), pa.array(masked, pa.string())],
            names=[*batch.schema.names, turns, trained],
        )

    return map_batches(kept, read, added(kept, **{turns: _TURNS, trained: "string"}))


def records(rows: DataFrame) -> DataFrame:
    """(conv_id, record): rows by turn as JSON records, in the layout that suits each conversation.

    Turns are ordered by ``turn``, then role and text; repeated rows stay.
    """
    empty = F.lit("")
    turns = F.sort_array(
        F.collect_list(
            F.struct(
                "turn",
                F.coalesce("role", empty).alias("role"),
                F.coalesce("text", empty).alias("content"),
            )
        )
    )
    grouped = rows.groupBy("conv_id").agg(turns.alias("t"))
    roles = F.transform("t", lambda x: x["role"])

    def layout(**fields):
        return F.to_json(F.struct("conv_id", *(v.alias(k) for k, v in fields.items())))

    pair = ["user", "assistant"]
    plain = F.forall(roles, lambda r: r.isin(*pair, "system"))
    shared = F.transform(
        "t",
        lambda x: F.struct(
            F.when(x["role"] == "user", "human")
            .when(x["role"] == "assistant", "gpt")
            .otherwise(x["role"])
            .alias("from"),
            x["content"].alias("value"),
        ),
    )
    listed = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))

    def are(*wanted):
        return roles == F.array(*map(F.lit, wanted))

    # get() keeps the branches that are not taken from failing on short arrays
    text = lambda i: F.get(F.transform("t", lambda x: x["content"]), F.lit(i))
    record = (
        F.when(are(*pair), layout(prompt=text(0), response=text(1)))
        .when(
            are("system", *pair),
            layout(system=text(0), instruction=text(1), output=text(2)),
        )
        .when(plain & (F.size("t") > 4), layout(conversations=shared))
        .otherwise(layout(messages=listed))
    )
    return grouped.select("conv_id", record.alias("record"))
