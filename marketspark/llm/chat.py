"""Chat records of many layouts, brought to canonical turns and written in one template.

A record is a variant: JSON text read by parse_json, or a row by to_variant_object. Its
fingerprint is the hash of the nested field paths that any known layout names (``messages[].role``),
and selects a declarative layout: which fields are turns, of which role. Fields that no layout
names don't matter; records that fit none give no turns and are counted in ``layout_report``.

The template writes every turn between marks. A control string inside a text gets a backslash
after its first character, one more for each that is there, so the marks stay the only control
strings of the output, and reading takes exactly one away.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_names


@dataclass(frozen=True)
class Field:
    """One turn of the texts of these paths, joined by empty lines; none if they are all null or empty and ``needed`` is false."""

    role: str
    paths: tuple[str, ...]
    needed: bool = True


@dataclass(frozen=True)
class Each:
    """A turn for each element of an array of objects. parts: the text is an array of objects with this field. names: roles by what the records call them."""

    array: str
    role: str
    text: str
    parts: str | None = None
    names: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Row:
    """The record is one turn of its conversation, at the place that ``order`` (a whole number) tells."""

    order: str
    role: str
    text: str


@dataclass(frozen=True)
class Layout:
    """The paths that a record must have and may have, and what they mean."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    turns: tuple[Field | Each | Row, ...]


SHARE_ROLES = (("human", "user"), ("gpt", "assistant"), ("chatgpt", "assistant"), ("bot", "assistant"))
LAYOUTS = (
    Layout("turn rows", ("turn", "role"), ("text",), (Row("turn", "role", "text"),)),
    Layout("messages", ("messages[].role",), ("messages[].content", "system"), (Field("system", ("system",), False), Each("messages", "role", "content"))),
    Layout("messages in parts", ("messages[].role", "messages[].content[].text"), ("messages[].content[].type",), (Each("messages", "role", "content", "text"),)),
    Layout("conversations", ("conversations[].from", "conversations[].value"), ("system",), (Field("system", ("system",), False), Each("conversations", "from", "value", None, SHARE_ROLES))),
    Layout("prompt and completion", ("prompt", "completion"), ("system",), (Field("system", ("system",), False), Field("user", ("prompt",)), Field("assistant", ("completion",)))),
    Layout("prompt and response", ("prompt", "response"), ("system",), (Field("system", ("system",), False), Field("user", ("prompt",)), Field("assistant", ("response",)))),
    Layout("instruction", ("instruction", "output"), ("input", "system"), (Field("system", ("system",), False), Field("user", ("instruction", "input")), Field("assistant", ("output",)))),
    Layout("question and answer", ("question", "answer"), ("context",), (Field("user", ("context", "question")), Field("assistant", ("answer",)))),
    Layout("nested data", ("data.prompt", "data.answer"), (), (Field("user", ("data.prompt",)), Field("assistant", ("data.answer",)))),
)

NAME = re.compile(r"`((?:[^`]|``)*)`|([^`:<>, ]+)")


@functools.lru_cache(maxsize=4096)
def paths_of(schema: str) -> tuple[str, ...]:
    """The paths of the leaves of a schema as schema_of_variant writes it: OBJECT<a: ARRAY<OBJECT<b: STRING>>> has a[].b."""
    out: list[str] = []

    def read(at: int, path: str) -> int:
        if schema.startswith("ARRAY<", at):
            return read(at + 6, path + "[]") + 1
        if schema.startswith("OBJECT<", at):
            at += 7
            while schema[at] != ">":
                name = NAME.match(schema, at)
                own = name[2] if name[2] is not None else name[1].replace("``", "`")
                at = read(name.end() + 2, f"{path}.{own}" if path else own)
                at += 2 if schema.startswith(", ", at) else 0
            return at + 1
        end = re.compile(r"[A-Z_ ]+(\(\d+,\s*\d+\))?").match(schema, at).end()
        out.append(path)
        return end

    read(0, "")
    return tuple(sorted(out))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _paths(schemas: pd.Series) -> pd.Series:
    return schemas.map(lambda s: None if s is None else list(paths_of(s)))


def fingerprint(paths: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of those of a record's paths that any of the layouts names; null for no record."""
    known = sorted({p for layout in layouts for p in (*layout.required, *layout.optional)})
    own = F.array_sort(F.array_intersect(paths, F.array(*map(F.lit, known))))
    return F.when(paths.isNotNull(), F.xxhash64(own))


def _chosen(own: Column, layouts: tuple[Layout, ...]) -> Column:
    """The name of the layout of a fingerprint, of each set of paths that it may have; the first of several."""
    seen: dict[tuple[str, ...], str] = {}
    for layout in layouts:
        for n in range(len(layout.optional) + 1):
            for more in itertools.combinations(layout.optional, n):
                seen.setdefault(tuple(sorted({*layout.required, *more})), layout.name)
    hashed = [(F.xxhash64(F.array(*map(F.lit, paths))), name) for paths, name in seen.items()]
    return functools.reduce(lambda c, x: c.when(own == x[0], F.lit(x[1])), hashed[1:], F.when(own == hashed[0][0], F.lit(hashed[0][1])))


def with_layout(df: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> tuple[DataFrame, str, str, str]:
    """df with the paths, fingerprint and layout's name of each record, and what these columns are called."""
    paths, own, name = new_names(df, "paths", "fingerprint", "layout")
    df = df.withColumn(paths, _paths(F.schema_of_variant(record)))
    df = df.withColumn(own, fingerprint(F.col(paths), layouts))
    return df.withColumn(name, _chosen(F.col(own), layouts)), paths, own, name


def layout_report(df: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """fingerprint, layout, records, example (paths of one record): all records, also those that no layout fits. No records: no rows."""
    marked, paths, own, name = with_layout(df, record, layouts)
    return marked.groupBy(F.col(own).alias("fingerprint"), F.col(name).alias("layout")).agg(F.count(F.lit(1)).alias("records"), F.min(paths).alias("example"))


def _turn(order: Column, role: Column, text: Column) -> Column:
    return F.struct(order.cast("long").alias("turn"), role.alias("role"), text.alias("text"))


def _element(part: Each):
    """The turn of an element of the array."""
    names = F.create_map(*(F.lit(x) for pair in part.names for x in pair)) if part.names else None

    def turn(x: Column) -> Column:
        text = F.array_join(F.transform(x[part.text], lambda y: y[part.parts]), "") if part.parts else x[part.text]
        role = x[part.role] if names is None else F.coalesce(F.try_element_at(names, x[part.role]), x[part.role])
        return _turn(F.lit(None), role, text)

    return turn


def _turns(layout: Layout, record: Column) -> Column:
    """An array of (turn, role, text)."""

    def text_at(path: str) -> Column:
        return F.try_variant_get(record, f"$.{path}", "string")

    out = []
    for part in layout.turns:
        if isinstance(part, Row):
            out.append(F.array(_turn(F.try_variant_get(record, f"$.{part.order}", "bigint"), text_at(part.role), text_at(part.text))))
        elif isinstance(part, Field):
            texts = [F.nullif(text_at(p), F.lit("")) for p in part.paths]
            turn = F.array(_turn(F.lit(None), F.lit(part.role), F.concat_ws("\n\n", *texts)))
            out.append(turn if part.needed else F.when(F.coalesce(*texts).isNotNull(), turn).otherwise(F.slice(turn, 1, 0)))
        else:
            kind = f"array<struct<`{part.parts}` string>>" if part.parts else "string"
            items = F.try_variant_get(record, f"$.{part.array}", f"array<struct<`{part.role}` string, `{part.text}` {kind}>>")
            none = F.array().cast(f"array<struct<`{part.role}` string, `{part.text}` {kind}>>")
            out.append(F.transform(F.coalesce(items, none), _element(part)))
    return F.concat(*out)


def canonical_turns(df: DataFrame, conv_id: str = "conv_id", record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """conv_id, turn, at, role, text: a row for each turn of each record that a layout fits.

    Turns of a conversation go by (turn, at, role, text), nulls first: ``turn`` is what the record
    says, null where its layout has the turns in order, and ``at`` the place inside the record.
    Null roles and texts become empty. Records that are null or fit no layout give no turns; see
    layout_report. Repeated rows are turns each. An empty df gives no rows. Further columns of df
    are ignored, whatever their names. A variant, and so a record, has Spark's limit of 128 MB.
    """
    marked, _, _, name = with_layout(df.select(F.col(conv_id).alias("conv_id"), F.col(record).alias("record")), "record", layouts)
    turns = [F.when(F.col(name) == layout.name, _turns(layout, F.col("record"))) for layout in layouts]
    out = marked.select("conv_id", F.posexplode(F.coalesce(*turns)).alias("at", "t"))
    return out.select("conv_id", "t.turn", F.col("at").cast("long").alias("at"), F.coalesce("t.role", F.lit("")).alias("role"), F.coalesce("t.text", F.lit("")).alias("text"))


@dataclass(frozen=True)
class Template:
    """Marks around the turns of each role; other roles are named inside ``other``'s first two marks.

    No mark may begin another, and none may hold, after its first character, a character that a
    mark begins with: so marks can't overlap with each other or with what stands around them.
    """

    marks: tuple[tuple[str, str, str], ...] = (("user", "[INST]", "[/INST]"), ("system", "[SYS]", "[/SYS]"), ("assistant", "", "</s>"))
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        firsts = {c[0] for c in self.controls}
        if any(set(c[1:]) & (firsts | {"\\"}) for c in self.controls) or "\\" in firsts or any(len(c) < 2 for c in self.controls):
            raise ValueError("a mark holds what begins a mark, or a backslash")
        if any(a != b and b.startswith(a) for a in self.controls for b in self.controls) or len(set(self.controls)) < len(self.controls):
            raise ValueError("a mark begins another")
        if sum(not opening for _, opening, _ in self.marks) > 1:
            raise ValueError("two roles without an opening mark")

    @property
    def controls(self) -> tuple[str, ...]:
        return tuple(c for _, *pair in self.marks for c in pair if c) + self.other

    @property
    def pattern(self) -> str:
        """A control string with any number of backslashes after its first character, for Java, Python and RE2."""
        firsts = "".join(re.escape(c) for c in sorted({c[0] for c in self.controls}))
        rests = "|".join(re.escape(r) for r in sorted({c[1:] for c in self.controls}))
        return rf"([{firsts}])(\\*)({rests})"

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, self.pattern, r"$1\\$2$3")

    def plain(self, text: Column) -> Column:
        return F.regexp_replace(text, self.pattern.replace(r"(\\*)", r"\\(\\*)"), "$1$2$3")

    def read(self, text: str) -> list[tuple[str, str]]:
        """The (role, text) of a whole formatted conversation."""
        out, at = [], 0
        stop = re.compile("|".join(map(re.escape, self.controls)))
        back = re.compile(self.pattern.replace(r"(\\*)", r"\\(\\*)"))

        def until(mark: str) -> str:
            nonlocal at
            found = stop.search(text, at)
            if not found or found[0] != mark:
                raise ValueError(f"no {mark} for the turn at {at}")
            body, at = text[at : found.start()], found.end()
            return back.sub(r"\1\2\3", body)

        while at < len(text):
            role, opening, closing = next((m for m in sorted(self.marks, key=lambda m: -len(m[1])) if m[1] and text.startswith(m[1], at)), (None, "", ""))
            if role is None and text.startswith(self.other[0], at):
                at += len(self.other[0])
                role = until(self.other[1])
                out.append((role, until(self.other[2])))
                continue
            if role is None:
                role, opening, closing = next(m for m in self.marks if not m[1])
            at += len(opening)
            out.append((role, until(closing)))
        return out


def format_turns(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, turn, at, formatted, loss_start, loss_length of canonical turns.

    A conversation's text is its rows' ``formatted`` in order of (turn, at, role, text), so no
    task needs to hold a whole conversation. The loss mask is of loss_length code points from
    loss_start (from 0, inside ``formatted``); both are null for turns that aren't learned.
    """
    text = template.escaped(F.col("text"))
    opening, body, closing = F.concat(F.lit(template.other[0]), template.escaped(F.col("role")), F.lit(template.other[1])), text, F.lit(template.other[2])
    for role, first, last in template.marks:
        opening = F.when(F.col("role") == role, F.lit(first)).otherwise(opening)
        closing = F.when(F.col("role") == role, F.lit(last)).otherwise(closing)
    learned = F.col("role").isin(*template.learned)
    out = turns.select("conv_id", "turn", "at", "role", "text", opening.alias("opening"), body.alias("body"), closing.alias("closing"))
    return out.select(
        "conv_id", "turn", "at",
        F.concat("opening", "body", "closing").alias("formatted"),
        F.when(learned, F.length("opening")).cast("long").alias("loss_start"),
        F.when(learned, F.length("body")).cast("long").alias("loss_length"),
    )


def read_turns(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, turn, at, role, text, loss (the text under the mask, null without one), formatted_chars, from format_turns' rows."""
    whole = F.col("formatted")
    size = F.length(whole)

    def inside(first: str, last: str) -> Column:
        return F.substring(whole, F.lit(len(first) + 1), size - len(first) - len(last))

    after = F.locate(template.other[1], whole)
    role = F.substring(whole, F.lit(len(template.other[0]) + 1), after - 1 - len(template.other[0]))
    text = F.substring(whole, after + len(template.other[1]), size - len(template.other[2]) - (after - 1) - len(template.other[1]))
    named = whole.startswith(template.other[0])
    for known, first, last in sorted(template.marks, key=lambda m: m[1] != ""):  # the one without an opening mark is looked at last
        fits = whole.startswith(first) if first else ~named
        role = F.when(fits, F.lit(known)).otherwise(role)
        text = F.when(fits, inside(first, last)).otherwise(text)
    loss = F.substring(whole, F.col("loss_start") + 1, F.col("loss_length"))
    return formatted.select("conv_id", "turn", "at", template.plain(role).alias("role"), template.plain(text).alias("text"), template.plain(loss).alias("loss"), size.cast("long").alias("formatted_chars"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of rows in order: only hash states and counts are held."""
    open_id: list = []
    state: list = []

    def closed() -> list:
        n, whole, chars, loss, size = state
        return [open_id[0], n, whole.hexdigest(), chars, loss.hexdigest(), size]

    kind = None
    for batch in batches:
        kind, done = batch.column(0).type, []
        for first in range(0, batch.num_rows, 1000):
            part = batch.slice(first, 1000)
            for conv, role, text, learned, size in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if not open_id or open_id[0] != conv:
                    if open_id:
                        done.append(closed())
                    open_id[:], state[:] = [conv], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if learned is not None:
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += size
        yield _table(done, kind)
    if open_id:
        yield _table([closed()], kind)


def _table(rows: list, kind: pa.DataType) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def conversation_digests(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation of read_turns' rows.

    A SHA-256 has to take a conversation's turns in order, so they meet in one task, sorted, but
    stream through it. Null ids are one conversation. No rows: no conversations.
    """
    kind = read.schema["conv_id"].dataType.simpleString()
    ordered = read.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "at", "role", "text")
    return ordered.select("conv_id", "role", "text", "loss", "formatted_chars").mapInArrow(_digests, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
