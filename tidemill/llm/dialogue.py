"""Repair of conversations: an error-correcting Earley parser over the roles of their rows.

The grammar of roles is left-linear, so every chart item begins at the first row and a column of the chart holds one item
for each nonterminal at most: the cheapest (cost, audit) that leads there.  Between two columns a row is kept, gets another
role or is deleted; within a column, rows are inserted.  Two audits of one item and cost have taken in the same rows, so
that neither is the beginning of the other and the least one stays the least whatever follows.

A conversation may be of any length.  Its rows, without their texts, are sorted over all tasks and cut into blocks; a block
is parsed from each item that may stand before it, which gives the cheapest way from item to item.  The ways of a
conversation's blocks are then joined in order; what all items have in common is set aside, so that the memory is that of
the answer.  Only the repaired texts pass one task a conversation, as a stream: their digest has to be taken in order.

Defined results.  Null roles, texts and parts of the key count as one space; a null conversation is one of its own; an empty
role has no initial, so that it fits nowhere.  Rows
that share a turn come by role, then by the SHA-256 of their text; rows that repeat are duplicates.  Empty texts are
blank.  Long texts are carried once, as they are.  Empty tables give empty frames.  Columns other than the four named ones
are not carried, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import os.path
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.cut import cut, drop

#: What a word is not made of.
BLANKS = " \t\n\x0b\x0c\r"
#: Rows of a block.
BLOCK = 512
#: Costs of the edits.
REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3

Chart = dict[str, tuple[int, str]]


class Grammar:
    """Rules (made, head, role): an item ``head`` and a row of that role make ``made``. Roles in ``names`` may be given and inserted."""

    def __init__(self, rules: tuple[tuple[str, str, str], ...], start: str, goals: tuple[str, ...], names: dict[str, str]) -> None:
        self.start, self.goals, self.names = start, goals, names
        self.items = tuple(dict.fromkeys([start, *(made for made, _, _ in rules)]))
        self.dotted = {item: [(made, role) for made, head, role in rules if head == item] for item in self.items}

    def completed(self, chart: Chart) -> Chart:
        """The column with all items that insertions complete."""
        agenda = list(chart)
        while agenda:
            head = agenda.pop()
            cost, audit = chart[head]
            for made, role in self.dotted[head]:
                if role in self.names:
                    new = (cost + INSERT, audit + "I")
                    if made not in chart or new < chart[made]:
                        chart[made] = new
                        agenda.append(made)
        return chart

    def scanned(self, chart: Chart, symbol: str) -> Chart:
        """The next column: behind a row, or behind a run of rows that have to go."""
        if symbol[0] == "d":
            return self.completed({item: (cost + DELETE * len(symbol), audit + "D" * len(symbol)) for item, (cost, audit) in chart.items()})
        role = symbol.lower()
        extra = 0 if symbol == role else UNFINISHED
        out = {item: (cost + DELETE, audit + "D") for item, (cost, audit) in chart.items()}
        for head, (cost, audit) in chart.items():
            for made, wanted in self.dotted[head]:
                if wanted == role:
                    new = (cost + extra, audit + "K")
                elif wanted in self.names:
                    new = (cost + extra + REROLE, audit + "R")
                else:
                    continue
                if made not in out or new < out[made]:
                    out[made] = new
        return self.completed(out)

    def parsed(self, symbols: str, entry: str) -> Chart:
        """The last column behind rows that are parsed from one item on."""
        chart = self.completed({entry: (0, "")})
        for run in re.findall("d+|.", symbols):
            chart = self.scanned(chart, run)
        return chart

    def after(self, item: str, edit: str, initial: str) -> tuple[str, str | None]:
        """Where an edit leads that leaves a row, and the role that it gives (none if the row keeps its own)."""
        for made, role in self.dotted[item]:
            if edit == "K" and role == initial or edit != "K" and role in self.names:
                return made, None if edit == "K" else self.names[role]
        raise ValueError(f"no rule for {edit} behind {item}")


#: (s?(ua)+)? as a left-linear grammar.
TURNS = Grammar(
    (("opened", "empty", "s"), ("asked", "empty", "u"), ("asked", "opened", "u"), ("asked", "answered", "u"), ("answered", "asked", "a")),
    "empty", ("empty", "answered"), {"u": "user", "a": "assistant"},
)
LEGAL = {"su", "ua", "au"}


@lru_cache(maxsize=20_000)
def _short(symbols: str, entry: str) -> Chart:
    return TURNS.parsed(symbols, entry)


def _ways(symbols: str, entries: Iterable[str]) -> list[dict]:
    parse = _short if len(symbols) <= 24 else TURNS.parsed
    return [{"entry": e, "exit": x, "cost": c, "audit": a} for e in entries for x, (c, a) in parse(symbols, e).items()]


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def rows_of(talks: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows as ``conv, turn, role, text, copies``, nulls filled."""
    return talks.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), _text(role).alias("role"), _text(text).alias("text"), F.lit(1).alias("copies"))


def damaged(rows: DataFrame) -> DataFrame:
    """Faults planted by the key's checksum: one row in twenty each is dropped, emptied, unfinished, repeated or given to the user."""
    code = F.crc32(F.concat_ws(":", _text("conv"), _text("turn"))) % 20
    text = F.when(code == 1, "").when(code == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(code == 4, "user").otherwise(F.col("role"))
    return rows.where(code != 0).select("conv", "turn", role.alias("role"), text.alias("text"), F.when(code == 3, 2 * F.col("copies")).otherwise(F.col("copies")).alias("copies"))


def _marked(rows: DataFrame) -> DataFrame:
    """Each row once, without its text: its digest ``d``, how it ends (b: blank, t: unfinished, k: well), and its copies."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    ends = F.when(bare == "", "b").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), "k").otherwise("t")
    return rows.select("conv", "turn", "role", F.unhex(F.sha2("text", 256)).alias("d"), ends.alias("ends"), F.col("copies").cast("long").alias("copies"), "text")


def _structure(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, d, ends, copies, again``: distinct rows, and whether role and text stand at an earlier turn."""
    keys = ["conv", "turn", "role", "d"]
    distinct = cut(_marked(rows).groupBy(*keys, "ends").agg(F.sum("copies").alias("copies")))
    first = F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("first")
    firsts = distinct.groupBy("conv", "role", "d").agg(first).select("conv", F.col("first.turn").alias("turn"), "role", "d", F.lit(True).alias("new"))
    a, b = distinct.alias("a"), firsts.alias("b")
    same = F.lit(True)
    for key in keys:
        same = same & F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
    return a.join(b, same, "left").select("a.*", F.col("b.new").isNull().alias("again"))


_WAYS = T.ArrayType(T.StructType([T.StructField("entry", T.StringType()), T.StructField("exit", T.StringType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))
_WAYS_ARROW = pa.list_(pa.struct([("entry", pa.string()), ("exit", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))
_COUNTS = ("lo", "hi", "turns", "blank", "duplicate", "truncated", "illegal")


class _Block:
    """Rows of one conversation that follow each other."""

    def __init__(self, conv: object, turn: int | None, role: str, d: bytes, opens: bool) -> None:
        self.conv, self.key, self.opens = conv, (turn, role, d), opens
        self.symbols: list[str] = []
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.lo = self.hi = None
        self.first, self.last = role[:1], None

    def add(self, turn: int | None, role: str, ends: str, copies: int, again: bool) -> None:
        initial = role[:1]
        if turn is not None and turn != self.hi:
            self.lo, self.hi, self.turns = turn if self.lo is None else self.lo, turn, self.turns + 1
        if self.last is not None:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += (copies - 1) * (initial + initial not in LEGAL)
        self.last = initial
        self.rows += 1
        if ends == "b":
            self.blank += copies
        else:
            self.duplicate += copies - (not again)
            self.truncated += ends == "t" and not again
        if ends == "b" or again:
            self.symbols.append("d" * copies)
        else:
            known = initial if initial and initial in "sua" else "o"
            self.symbols.append((known.upper() if ends == "t" else known) + "d" * (copies - 1))

    def row(self) -> tuple:
        """As a row: key of its first row, ways, roles at its ends, counts."""
        ways = _ways("".join(self.symbols), (TURNS.start,) if self.opens else TURNS.items)
        return (self.conv, *self.key, ways, self.first, self.last, *(getattr(self, c) for c in _COUNTS))


def _frame_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _blocks(structure: DataFrame) -> DataFrame:
    """The blocks of all conversations with their ways; rows are sorted over all tasks, so a conversation may lie in several."""
    kind = structure.schema["conv"]
    columns = [T.StructField("first", T.StringType()), T.StructField("last", T.StringType()), *(T.StructField(c, T.LongType()) for c in _COUNTS)]
    schema = T.StructType([kind, T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("d", T.BinaryType()), T.StructField("ways", _WAYS), *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: _Block | None = None
        arrow: pa.Schema | None = None
        for batch in batches:
            fixed = [("turn", pa.int64()), ("role", pa.string()), ("d", pa.binary()), ("ways", _WAYS_ARROW), ("first", pa.string()), ("last", pa.string())]
            arrow = arrow or pa.schema([("conv", batch.schema.field(0).type), *fixed, *((c, pa.int64()) for c in _COUNTS)])
            done = []
            for conv, turn, role, d, ends, copies, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block is None or conv != block.conv or block.rows >= BLOCK:
                    if block is not None:
                        done.append(block.row())
                    block = _Block(conv, turn, role, d, block is not None and conv != block.conv)
                block.add(turn, role, ends, copies, again)
            yield _frame_of(done, arrow)
        if block is not None and arrow is not None:
            yield _frame_of([block.row()], arrow)

    order = ["conv", "turn", "role", "d"]
    return structure.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, "ends", "copies", "again").mapInArrow(run, schema)


class _Talk:
    """The blocks of one conversation, joined in order."""

    def __init__(self, conv: object) -> None:
        self.conv, self.settled, self.chart = conv, [], {TURNS.start: (0, "")}
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.lo = self.hi = self.last = None

    def add(self, block: dict) -> None:
        chart: Chart = {}
        for way in block["ways"]:
            if way["entry"] in self.chart:
                cost, audit = self.chart[way["entry"]]
                new = (cost + way["cost"], audit + way["audit"])
                if way["exit"] not in chart or new < chart[way["exit"]]:
                    chart[way["exit"]] = new
        common = len(os.path.commonprefix([audit for _, audit in chart.values()]))
        if common:
            self.settled.append(next(iter(chart.values()))[1][:common])
        self.chart = {item: (cost, audit[common:]) for item, (cost, audit) in chart.items()}
        if self.last is not None:
            self.illegal += self.last + block["first"] not in LEGAL
        self.last = block["last"]
        if block["lo"] is not None:
            self.turns += block["turns"] - (block["lo"] == self.hi)
            self.lo, self.hi = block["lo"] if self.lo is None else self.lo, block["hi"]
        for count in _COUNTS[3:]:
            setattr(self, count, getattr(self, count) + block[count])

    def row(self) -> tuple:
        cost, audit = min(self.chart[g] for g in TURNS.goals if g in self.chart)
        gaps = 0 if self.lo is None else self.hi - self.lo + 1 - self.turns
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.settled) + audit)


def repairs(rows: DataFrame) -> DataFrame:
    """``conv, gaps, blank, duplicate, truncated, illegal, cost, audit`` of every conversation that has rows."""
    structure = _structure(rows)
    blocks = _blocks(structure)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = T.StructType([blocks.schema["conv"], *(T.StructField(n, T.LongType()) for n in names), T.StructField("audit", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        talk: _Talk | None = None
        arrow: pa.Schema | None = None
        for batch in batches:
            arrow = arrow or pa.schema([("conv", batch.schema.field(0).type), *((n, pa.int64()) for n in names), ("audit", pa.string())])
            done = []
            for block in batch.to_pylist():
                if talk is None or block["conv"] != talk.conv:
                    if talk is not None:
                        done.append(talk.row())
                    talk = _Talk(block["conv"])
                talk.add(block)
            yield _frame_of(done, arrow)
        if talk is not None and arrow is not None:
            yield _frame_of([talk.row()], arrow)

    return blocks.repartition("conv").sortWithinPartitions("conv", "turn", "role", "d").mapInArrow(run, schema)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows that ``found`` (of ``repairs``) leaves, ``conv, place, role, text, edit``: conversations whole and in order within a task."""
    marked = _marked(rows).select("conv", F.lit(1).alias("kind"), "turn", "role", "d", "copies", F.when(F.col("ends") != "b", F.col("text")).alias("text"))
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    audits = found.select("conv", F.lit(0).alias("kind"), none("turn", "long"), none("role", "string"), none("d", "binary"), none("copies", "long"), F.col("audit").alias("text"))
    dealt = audits.union(marked).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "d").select("conv", "kind", "role", "copies", "text")
    schema = T.StructType([rows.schema["conv"], T.StructField("place", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("role", "text", "edit"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, item, place = None, "", 0, TURNS.start, 0
        out: list[tuple] = []

        def left(edit: str, role: str, text: str) -> None:
            nonlocal item, place
            item, given = TURNS.after(item, edit, role[:1])
            out.append((conv, place, role if given is None else given, text, edit))
            place += 1

        def inserted() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                left("I", "", "")
                at += 1

        arrow: pa.Schema | None = None
        for batch in batches:
            arrow = arrow or pa.schema([("conv", batch.schema.field(0).type), ("place", pa.int64()), *((n, pa.string()) for n in ("role", "text", "edit"))])
            for of, kind, role, copies, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    inserted()  # behind the last row of the conversation before
                    conv, audit, at, item, place = of, text, 0, TURNS.start, 0
                    continue
                for _ in range(copies):
                    inserted()
                    if audit[at] != "D":
                        left(audit[at], role, text)
                    at += 1
                if len(out) >= 1_000:
                    yield _frame_of(out, arrow)
                    out.clear()
        inserted()
        if arrow is not None:
            yield _frame_of(out, arrow)

    return dealt.mapInArrow(run, schema)


def digests(left: DataFrame) -> DataFrame:
    """``conv, sha256`` of the lines ``role:text`` of each conversation, from rows that ``repaired`` gave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, arrow = None, None, None
        for batch in batches:
            arrow = arrow or pa.schema([("conv", batch.schema.field(0).type), ("sha256", pa.string())])
            done = []
            for of, place, role, text, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place == 0:
                    if digest is not None:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = of, hashlib.sha256()
                digest.update(f"{'' if place == 0 else chr(10)}{role}:{text}".encode())
            yield _frame_of(done, arrow)
        if digest is not None and arrow is not None:
            yield _frame_of([(conv, digest.hexdigest())], arrow)

    return left.mapInArrow(run, T.StructType([left.schema["conv"], T.StructField("sha256", T.StringType())]))


def report(talks: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``talks`` (its column ``conv``): faults, cost and audit of ``rows``, and the digest of what is left."""
    found = cut(repairs(rows))
    sums = digests(repaired(rows, found))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    a, b, c = talks.select("conv").distinct().alias("a"), found.alias("b"), sums.alias("c")
    both = a.join(b, F.col("a.conv").eqNullSafe(F.col("b.conv")), "left").join(c, F.col("a.conv").eqNullSafe(F.col("c.conv")), "left")
    return both.select(
        "a.conv",
        *(F.coalesce(F.col(f"b.{n}"), F.lit(0).cast("long")).alias(n) for n in numbers),
        F.coalesce("b.audit", F.lit("")).alias("audit"),
        F.coalesce("c.sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


__all__ = ["Grammar", "TURNS", "damaged", "digests", "drop", "repaired", "repairs", "report", "rows_of"]
