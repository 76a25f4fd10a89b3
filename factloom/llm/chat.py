"""Chat formatting: records of many layouts become canonical turns, turns become marked text, marked text is read back.

A layout is declared by the nested field paths that its records have and by what stands at each path. The paths
of a record, hashed, are its fingerprint; the fingerprint selects the layout. Layouts whose fields may be absent
have a fingerprint for each set of fields, so that one lookup tells what a record holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

TURNS = "array<struct<role string, text string>>"
#: Names that feeds use for the three usual roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Text:
    """One turn: the text at `path`, said by `role`. Where `joined` is there too, it follows after a blank line."""

    path: str
    role: str
    joined: str | None = None

    def paths(self) -> tuple[str, ...]:
        return (self.path,) if self.joined is None else (self.path, self.joined)


@dataclass(frozen=True)
class Messages:
    """A turn for each element of the list at `path`; `role` and `text` are paths within an element. A text path through a list joins its elements."""

    path: str
    role: str
    text: str

    def paths(self) -> tuple[str, ...]:
        return f"{self.path}[].{self.role}", f"{self.path}[].{self.text}"


@dataclass(frozen=True)
class Layout:
    """Parts in the order of their turns; `optional` paths may be absent, `ignored` ones may be there and say nothing; `roles` renames what feeds call roles."""

    name: str
    parts: tuple[Text | Messages, ...]
    optional: tuple[str, ...] = ()
    ignored: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=lambda: ROLES)


LAYOUTS = (
    Layout("messages", (Messages("messages", "role", "content"),), ignored=("id", "messages[].name"), roles={}),
    Layout("message parts", (Messages("messages", "role", "content[].text"),), ignored=("id", "messages[].content[].type"), roles={}),
    Layout("from and value", (Text("system", "system"), Messages("conversations", "from", "value")), optional=("system",), ignored=("id",)),
    Layout("prompt and completion", (Text("system", "system"), Text("prompt", "user"), Text("completion", "assistant")), optional=("system",), ignored=("id",)),
    Layout("question and answer", (Text("context", "system"), Text("question", "user"), Text("answer", "assistant")), optional=("context",), ignored=("id",)),
    Layout("instruction and output", (Text("system", "system"), Text("instruction", "user", joined="input"), Text("output", "assistant")), optional=("system", "input"), ignored=("id",)),
)


def _tree(paths: Iterable[str]) -> dict:
    """Nested names of paths like messages[].role; a list is the name '[]'."""
    out: dict = {}
    for p in paths:
        at = out
        for name in p.replace("[]", ".[]").split("."):
            at = at.setdefault(name, {})
    return out


def shape_of(tree: dict) -> str:
    """Nested field names as `shape` writes them; the name '[0]' is an empty list."""
    if not tree:
        return "_"
    if "[0]" in tree:
        return "ARRAY<>"
    if "[]" in tree:
        return f"ARRAY<{shape_of(tree['[]'])}>"
    return "OBJECT<" + ", ".join(f"{k}: {shape_of(tree[k])}" for k in sorted(tree)) + ">"


def shape(record: Column) -> Column:
    """The nested field names of a JSON record, without the types of its values; null where it isn't JSON or names a field twice."""
    schema = F.call_function("schema_of_variant", F.try_parse_json(record))
    schema = F.replace(schema, F.lit("ARRAY<VOID>"), F.lit("ARRAY<>"))  # no elements, or nulls alone
    return F.regexp_replace(schema, r"(?<=[ <])(?:STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|DECIMAL\(\d+,\d+\))(?=[,>])", "_")


def fingerprint(record: Column) -> Column:
    """Hash of a record's nested field paths."""
    return F.sha2(shape(record), 256)


def _ddl(tree: dict) -> str:
    if not tree:
        return "string"
    if "[]" in tree:
        return f"array<{_ddl(tree['[]'])}>"
    return "struct<" + ", ".join(f"`{k}`: {_ddl(v)}" for k, v in tree.items()) + ">"


def _at(value: Column, path: str) -> Column:
    for name in path.split("."):
        value = value[name]
    return value


def _with(function, part):
    """function of an element alone: Spark tells a lambda's arguments by its signature."""
    return lambda x: function(x, part)


def _variants(layout: Layout) -> Iterable[tuple[frozenset[str], str]]:
    """(paths with a say, shape) of each set of fields that a layout's records may have; lists may be empty."""
    say = [p for part in layout.parts for p in part.paths()]
    sure = [p for p in say if p not in layout.optional]
    may = [*layout.optional, *layout.ignored]
    lists = [part.path for part in layout.parts if isinstance(part, Messages)]
    for n in range(len(may) + 1):
        for some in combinations(may, n):
            has = frozenset([*sure, *some])
            yield has & frozenset(say), shape_of(_tree(has))
            bare = [p for p in has if not any(p.startswith(f"{x}[]") for x in lists)]
            if lists and not any(p.startswith(f"{x}[]") for p in some for x in lists):
                yield has & frozenset(say), shape_of(_tree([*bare, *(f"{x}.[0]" for x in lists)]))


def _turns(layout: Layout, has: frozenset[str], record: Column) -> Column:
    """The turns of a record of these paths."""
    parsed = F.from_json(record, _ddl(_tree(has)))
    text = lambda x: F.coalesce(x, F.lit(""))
    turn = lambda role, said: F.struct(role.alias("role"), text(said).alias("text"))
    names = F.create_map(*(F.lit(x) for pair in layout.roles.items() for x in pair)) if layout.roles else None

    def message(m: Column, part: Messages) -> Column:
        role, (outer, _, inner) = text(_at(m, part.role)), part.text.partition("[].")
        said = F.array_join(F.transform(_at(m, outer), lambda x: text(_at(x, inner))), "") if inner else _at(m, part.text)
        return turn(F.coalesce(F.try_element_at(names, role), role) if names is not None else role, said)

    out = []
    for part in layout.parts:
        if isinstance(part, Messages):
            out.append(F.coalesce(F.transform(F.array_compact(_at(parsed, part.path)), _with(message, part)), F.array().cast(TURNS)))
        elif part.path in has:
            said = text(_at(parsed, part.path))
            if part.joined in has:
                more = text(_at(parsed, part.joined))
                said = F.when(more == "", said).otherwise(F.concat(said, F.lit("\n\n"), more))
            out.append(F.array(turn(F.lit(part.role), said)))
    return F.concat(*out).cast(TURNS)


def canonical(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(row, fingerprint, layout, turns) of records: JSON objects in the string column `record`.

    row is the whole input row, so that no column's name clashes; turns is array<struct<role, text>>. A record whose
    fingerprint no layout has (null, malformed or unknown) keeps its row with layout and turns null: it isn't dropped.
    A null text is empty; a null message isn't a turn; an empty list has no turns. Repeated rows stay.
    """
    found = records.select(F.struct("*").alias("row"), F.col(record).alias("_record"), fingerprint(F.col(record)).alias("fingerprint"))
    known: dict[str, tuple[Layout, frozenset[str]]] = {}
    for x in layouts:
        for has, s in _variants(x):
            known.setdefault(hashlib.sha256(s.encode()).hexdigest(), (x, has))
    uses: dict[tuple[str, frozenset[str]], tuple[Layout, list[str]]] = {}
    for mark, (x, has) in known.items():
        uses.setdefault((x.name, has), (x, []))[1].append(mark)
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for (_, has), (x, marks) in uses.items():
        mine = F.col("fingerprint").isin(marks)
        name = F.when(mine, F.lit(x.name)).otherwise(name)
        turns = F.when(mine, _turns(x, has, F.col("_record"))).otherwise(turns)
    return found.select("row", "fingerprint", name.alias("layout"), turns.alias("turns"))


@dataclass(frozen=True)
class Template:
    """Marks around a turn: `begin` role `says` text `end`.

    A mark found inside a role or text gets a backslash after its first character, and every backslash there is doubled;
    so no mark stands anywhere but where a turn has it, whatever the texts say. Marks start with one character that
    no mark holds again, and hold no backslash.
    """

    begin: str = "<turn>"
    says: str = "<says>"
    end: str = "</turn>\n"
    #: Whose texts are trained on.
    trained: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        marks = self.marks()
        if any(len(m) < 2 or "\\" in m or m[0] in m[1:] or m[0] != marks[0][0] for m in marks) or any(a != b and a.startswith(b) for a in marks for b in marks) or len(set(marks)) < 3:
            raise ValueError(f"marks {marks} can't be told apart")

    def marks(self) -> tuple[str, str, str]:
        return self.begin, self.says, self.end.rstrip("\n")

    def escaped(self, x: pa.Array) -> pa.Array:
        x = pc.replace_substring(x, "\\", "\\\\")
        for m in self.marks():
            x = pc.replace_substring(x, m, f"{m[0]}\\{m[1:]}")
        return x

    @staticmethod
    def unescaped(x: pa.Array) -> pa.Array:
        parts = pc.split_pattern(x, "\\\\")  # doubled backslashes pair from the left; what is left of them is single
        plain = pc.replace_substring(parts.flatten(), "\\", "")
        return pc.binary_join(pa.ListArray.from_arrays(_offsets(parts), plain), "\\")


def _offsets(lists: pa.ListArray) -> pa.Array:
    """Offsets into the flattened values of a list array; a null list is an empty one."""
    n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    return pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def formatted(turns: Column, template: Template = Template()) -> Column:
    """struct(text, mask): turns as marked text, and the spans (start, length; code points from 0) of it that are trained on.

    The spans are the escaped texts of the trained roles, without marks. Null turns give null; no turns, or null texts,
    give empty text. Long texts and long conversations are linear work.
    """

    @arrow_udf("struct<text string, mask array<struct<start bigint, length bigint>>>")
    def run(turns: pa.Array) -> pa.Array:
        flat, offsets = turns.flatten(), _offsets(turns)
        role, text = (pc.fill_null(flat.field(k), "") for k in (0, 1))
        role_out, text_out = template.escaped(role), template.escaped(text)
        piece = pc.binary_join_element_wise(template.begin, role_out, template.says, text_out, template.end, "")
        whole = pc.binary_join(pa.ListArray.from_arrays(offsets, piece), "")
        at = np.asarray(offsets, np.int64)
        size, said = (np.asarray(pc.utf8_length(x), np.int64) for x in (piece, text_out))
        before = np.concatenate([[0], np.cumsum(size)])
        conversation = np.repeat(np.arange(len(at) - 1), np.diff(at))
        start = before[:-1] - before[at[conversation]] + size - len(template.end) - said
        own = np.asarray(pc.is_in(role, value_set=pa.array(template.trained)), bool)
        spans = pa.StructArray.from_arrays([pa.array(start[own]), pa.array(said[own])], names=["start", "length"])
        n = np.concatenate([[0], np.cumsum(own)])[at]
        mask = pa.ListArray.from_arrays(pa.array(n.astype(np.int32)), spans)
        null = pc.is_null(turns)
        return pa.StructArray.from_arrays([whole, mask.cast(_SPANS)], names=["text", "mask"], mask=null)

    return run(turns)


def read_back(text: Column, template: Template = Template()) -> Column:
    """The turns of marked text, unescaped: what was formatted. Null text gives null; text that isn't of this template is an error."""

    @arrow_udf(TURNS)
    def run(text: pa.Array) -> pa.Array:
        rows = pc.split_pattern(text, template.end)
        flat, offsets = rows.flatten(), np.asarray(_offsets(rows), np.int64)
        last = np.zeros(len(flat), bool)
        last[offsets[1:][np.diff(offsets) > 0] - 1] = True  # after the last mark nothing follows
        if pc.any(pc.not_equal(flat.filter(pa.array(last)), "")).as_py():
            raise ValueError("text after the last turn")
        pieces = flat.filter(pa.array(~last))
        if not pc.all(pc.starts_with(pieces, template.begin), min_count=0).as_py():
            raise ValueError("a turn doesn't begin with its mark")
        halves = pc.split_pattern(pc.replace_substring(pieces, template.begin, ""), template.says)
        if not pc.all(pc.equal(pc.list_value_length(halves), 2), min_count=0).as_py():
            raise ValueError("a turn doesn't have one mark between role and text")
        role, said = (template.unescaped(pc.list_element(halves, k)) for k in (0, 1))
        n = np.concatenate([[0], np.cumsum(~last)])[offsets]
        return pa.ListArray.from_arrays(pa.array(n.astype(np.int32)), pa.StructArray.from_arrays([role, said], names=["role", "text"]), mask=pc.is_null(text))

    return run(text)


def trained_text(text: Column, mask: Column, template: Template = Template()) -> Column:
    """All text under the mask, unescaped, in order and with nothing between. Null text gives null."""

    @arrow_udf("string")
    def run(text: pa.Array, mask: pa.Array) -> pa.Array:
        flat, offsets = mask.flatten(), _offsets(mask)
        start, length, at = flat.field(0).to_pylist(), flat.field(1).to_pylist(), np.asarray(offsets).tolist()
        cut = [t[start[k] : start[k] + length[k]] for i, t in enumerate(text.to_pylist()) for k in range(at[i], at[i + 1])]
        joined = pc.binary_join(pa.ListArray.from_arrays(offsets, template.unescaped(pa.array(cut, pa.string()))), "")
        return pc.if_else(pc.is_valid(text), joined, None)

    return run(text, mask)


def as_records(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): each conversation's rows by turn as a JSON record, in the layout that says it best.

    Ties of turn go by role, then text. Two turns of user and assistant are prompt and completion, with a system turn
    before them an instruction and its output; where all roles are of the three usual ones and the first isn't the
    system's, they are from and value; everything else is messages. A null role or text is empty. A conversation
    is one record, however long.
    """
    empty = lambda x: F.coalesce(F.col(x), F.lit(""))
    rows = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", empty("role").alias("role"), empty("text").alias("text")))).alias("t"))
    role, text = F.transform("t", lambda x: x["role"]), F.transform("t", lambda x: x["text"])
    usual = F.size(F.array_except(role, F.array(*map(F.lit, ("user", "assistant", "system"))))) == 0
    said = F.create_map(F.lit("user"), F.lit("human"), F.lit("assistant"), F.lit("gpt"), F.lit("system"), F.lit("system"))
    is_ = lambda *names: role == F.array(*map(F.lit, names))
    record = (
        F.when(is_("user", "assistant"), F.to_json(F.struct(text[0].alias("prompt"), text[1].alias("completion"))))
        .when(is_("system", "user", "assistant"), F.to_json(F.struct(text[0].alias("system"), text[1].alias("instruction"), text[2].alias("output"))))
        .when(usual & (role[0] != "system"), F.to_json(F.struct(F.transform("t", lambda x: F.struct(said[x["role"]].alias("from"), x["text"].alias("value"))).alias("conversations"))))
        .otherwise(F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))))
    )
    return rows.select("conv_id", record.alias("record"))


def digests(records: DataFrame, template: Template = Template()) -> DataFrame:
    """(row, layout, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, formatted) of records, told from what was formatted and read back."""
    x = canonical(records).select("row", "layout", formatted(F.col("turns"), template).alias("out"))
    x = x.select("row", "layout", "out.text", read_back(F.col("out.text"), template).alias("turns"), trained_text(F.col("out.text"), F.col("out.mask"), template).alias("loss"))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return x.select(
        "row", "layout", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("text").cast("long").alias("formatted_chars"), F.col("text").alias("formatted"),
    )
