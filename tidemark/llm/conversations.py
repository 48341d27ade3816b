"""Repair of conversation structure by a checkpointed dynamic program.

Rows of a conversation, in turn order, become a sequence of role initials of the form ``(s?(ua)+)?`` at
least cost: keep a row (0), give it the role that is due (2), delete it (3, required for blank and
duplicate rows) or insert an empty row (2); a truncated row that stays costs 1 more. States are
start, after s, after u, after a. The cost to go is a vector of four numbers per row, computed from
the last row back; only every sqrt(n)-th vector is kept. Walking forward, the vectors of one block are
computed again from the checkpoint behind it, and the least edit that is tight is written.

Rows are range-partitioned by conversation and turn and sorted, so that a conversation with a third of all
rows lies in many tasks. A conversation that lies within one task and one block is solved there. Of any
other, each task gives its rows in blocks and one min-plus matrix of its part; the parts' end vectors and,
after a first walk, their start states follow from one small row per part, and each part is then walked
on its own. Whether a row repeats an earlier one comes from a combined count per (conversation, role, text).

Rows: null role or text is one space; null turns come first; rows of one turn are taken by role, then
text; a null conv_id is a conversation; turns are whole numbers; an empty table gives no rows; columns
other than the four named are not read, except ``gone``: such a row only makes its conversation known.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lanes, stored

SPACE = " \t\n\v\f\r"
STOPS = ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States are numbered start, after s, after u, after a; the state that follows an s, u or a, if it may come.
KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: The state after the role that is due.
DUE = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
#: Cost of the inserts that end a conversation from each state.
LAST = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 50
#: Symbols of rows: twice the class of the initial (s, u, a, other), plus one if truncated; or GONE, which must be deleted.
CLASSES, GONE = {"s": 0, "u": 1, "a": 2}, 8
BLOCK_ROWS, BLOCK_CHARS = 4096, 1 << 20
#: Part numbers of the row with a long conversation's totals and of its closing inserts.
TOTALS, CLOSING = -1, (1 << 31) - 1

Vector = tuple[int, int, int, int]


def _keep(symbol: int, q: int) -> int | None:
    return KEEP["sua"[symbol // 2]].get(q) if symbol < 6 else None


@lru_cache(None)
def _costs(symbol: int, after: Vector) -> Vector:
    """Costs to go before a row from those after it."""
    extra = TRUNCATED * (symbol % 2)
    cost = []
    for q in range(4):
        options = [DELETE + after[q]]
        if symbol != GONE:
            options.append(REROLE + extra + after[DUE[q]])
            if (kept := _keep(symbol, q)) is not None:
                options.append(extra + after[kept])
        cost.append(min(options))
    for _ in range(3):
        cost = [min(c, INSERT + cost[DUE[q]]) for q, c in enumerate(cost)]
    return tuple(cost)


@lru_cache(None)
def _edit(symbol: int, q: int, after: Vector) -> tuple[str, int]:
    """The least tight edits at a row, inserts before it included, and the state behind it."""
    cost, extra, out = _costs(symbol, after), TRUNCATED * (symbol % 2), ""
    while True:
        if DELETE + after[q] == cost[q]:
            return out + "D", q
        if INSERT + cost[DUE[q]] == cost[q]:
            out, q = out + "I", DUE[q]
            continue
        kept = _keep(symbol, q)
        if kept is not None and extra + after[kept] == cost[q]:
            return out + "K", kept
        return out + "R", DUE[q]


def lower(vector: Vector) -> tuple[Vector, int]:
    """A vector less its least entry, and that entry: few different vectors occur."""
    least = min(vector)
    return tuple(min(v - least, FAR) for v in vector), least


def backward(symbols: bytes, end: Vector) -> tuple[dict[int, Vector], int, int]:
    """Vectors at checkpoints (row numbers), the distance of checkpoints, and what was taken off the first vector."""
    step = isqrt(len(symbols)) + 1
    vector, total = lower(end)
    kept = {len(symbols): vector}
    for i in range(len(symbols) - 1, -1, -1):
        vector, least = lower(_costs(symbols[i], vector))
        total += least
        if i % step == 0:
            kept[i] = vector
    return kept, step, total


def walk(symbols: bytes, end: Vector, state: int) -> tuple[list[str], int, int]:
    """Edits at each row, the state behind the last, and the cost from ``state``."""
    kept, step, total = backward(symbols, end)
    cost = total + kept[0][state]
    edits = []
    for at in range(0, len(symbols), step):
        to = min(at + step, len(symbols))
        vectors = [kept[to]]
        for i in range(to - 1, at, -1):
            vectors.append(lower(_costs(symbols[i], vectors[-1]))[0])
        for i in range(at, to):
            letters, state = _edit(symbols[i], state, vectors[to - 1 - i])
            edits.append(letters)
    return edits, state, cost


@lru_cache(None)
def matrix_of(symbol: int) -> tuple[Vector, ...]:
    """Least cost from each state before a row to each state behind it."""
    columns = []
    for goal in range(4):
        columns.append(_costs(symbol, tuple(0 if q == goal else FAR for q in range(4))))
    return tuple(zip(*columns, strict=True))


@lru_cache(1 << 16)
def _product(a: tuple[Vector, ...], b: tuple[Vector, ...]) -> tuple[tuple[Vector, ...], int]:
    out = [[min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)] for i in range(4)]
    least = min(map(min, out))
    return tuple(tuple(min(v - least, FAR) for v in row) for row in out), least


IDENTITY = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))


def times(a: tuple[Vector, ...], vector: Vector) -> Vector:
    return tuple(min(a[i][k] + vector[k] for k in range(4)) for i in range(4))


class Part:
    """What one task knows of one conversation: totals of its rows, and the matrix of their symbols."""

    def __init__(self, conv: object) -> None:
        self.conv, self.matrix, self.taken = conv, IDENTITY, 0
        self.lo = self.hi = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = self.blocks = 0
        self.left = self.right = self.last = None
        self.symbols, self.roles, self.texts, self.chars = bytearray(), [], [], 0

    def add(self, turn: int | None, role: str, text: str, blank: bool, cut: bool, key: bytes, again: bool) -> None:
        """One row. ``again``: an earlier turn has its role and text; equal rows of one turn follow each other."""
        if turn is not None:
            self.distinct += turn != self.hi
            self.lo, self.hi = turn if self.lo is None else self.lo, turn
        initial = role[:1]
        if self.right is None:
            self.left = initial
        elif self.right + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.right = initial
        again = again or key == self.last
        self.last = key
        if blank or again:
            symbol = GONE
            self.blank += blank
            self.duplicate += not blank
        else:
            symbol = 2 * CLASSES.get(initial, 3) + cut
            self.truncated += cut
        self.symbols.append(symbol)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.symbols) >= BLOCK_ROWS or self.chars >= BLOCK_CHARS

    def block(self, part: int) -> dict:
        """The rows held, as a block; they are let go."""
        for symbol in self.symbols:
            self.matrix, least = _product(self.matrix, matrix_of(symbol))
            self.taken += least
        out = {"conv_id": self.conv, "part": part, "block": self.blocks, "symbols": bytes(self.symbols), "roles": self.roles, "texts": self.texts}
        self.blocks += 1
        self.symbols, self.roles, self.texts, self.chars = bytearray(), [], [], 0
        return out

    def totals(self) -> dict:
        names = ("lo", "hi", "distinct", "blank", "duplicate", "truncated", "illegal", "left", "right")
        return {"conv_id": self.conv} | {n: getattr(self, n) for n in names}

    def summary(self, part: int) -> dict:
        return self.totals() | {"part": part, "block": -1, "matrix": [v + self.taken if v < FAR else FAR for row in self.matrix for v in row]}

    def solved(self) -> dict:
        """The repaired conversation, of which all rows are held."""
        edits, state, cost = walk(bytes(self.symbols), LAST, 0)
        roles, texts, state = apply(edits, self.roles, self.texts, 0)
        more = closing(state)
        return self.totals() | {"cost": cost, "audit": "".join(edits) + "I" * len(more), "roles": roles + more, "texts": texts + [""] * len(more)}


def closing(state: int) -> list[str]:
    """Roles of the inserts that end a conversation."""
    return {0: [], 1: ["user", "assistant"], 2: ["assistant"], 3: []}[state]


def apply(edits: list[str], roles: list[str], texts: list[str], state: int) -> tuple[list[str], list[str], int]:
    """Repaired rows from edits per row, and the state behind them."""
    new_roles, new_texts = [], []
    for letters, role, text in zip(edits, roles, texts, strict=True):
        for letter in letters:
            if letter == "D":
                continue
            following = _keep(2 * CLASSES.get(role[:1], 3), state) if letter == "K" else DUE[state]
            new_roles.append(role if letter == "K" else ROLES[following])
            new_texts.append("" if letter == "I" else text)
            state = following
    return new_roles, new_texts, state


COUNTS = ("lo", "hi", "distinct", "blank", "duplicate", "truncated", "illegal")


def _arrow(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _schema(conv: pa.DataType) -> tuple[pa.Schema, str]:
    longs, text = pa.int64(), pa.string()
    fields = [("part", pa.int32()), ("block", pa.int32())] + [(c, longs) for c in COUNTS] + [("left", text), ("right", text), ("cost", longs), ("audit", text)]
    fields += [("matrix", pa.list_(longs)), ("symbols", pa.binary()), ("roles", pa.list_(text)), ("texts", pa.list_(text))]
    ddl = ", ".join(["part int, block int", *(f"{c} long" for c in COUNTS), "left string, right string, cost long, audit string, matrix array<long>, symbols binary, roles array<string>, texts array<string>"])
    return pa.schema([("conv_id", conv), *fields]), ddl


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a task to solved conversations, blocks of others and a summary of each of those."""
    number = TaskContext.get().partitionId()
    now: Part | None = None
    first, out, held = True, [], 0
    schema = None

    def close(part: Part, whole: bool) -> None:
        if whole and not part.blocks:
            out.append(part.solved())
            return
        if part.symbols:
            out.append(part.block(number))
        out.append(part.summary(number))

    for batch in batches:
        schema = schema or _schema(batch.column("conv_id").type)[0]
        names = ("conv_id", "turn", "role", "text", "blank", "cut", "key", "again", "gone")
        for conv, turn, role, text, blank, cut, key, again, gone in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if now is None or conv != now.conv:
                if now is not None:
                    # the first and the last conversation of a task may go on in another one
                    close(now, not first)
                    first = False
                now = Part(conv)
            if gone:
                continue
            now.add(turn, role, text, blank, cut, key, again)
            held += len(text) + 100
            if now.full():
                out.append(now.block(number))
            if held > BLOCK_CHARS and out:
                yield _arrow(out, schema)
                out.clear()
                held = 0
    if now is not None:
        close(now, False)
        yield _arrow(out, schema)


def _key() -> F.Column:
    conv = F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n"))
    return F.unhex(F.sha2(F.concat_ws(":", F.length(conv), conv, F.length("role"), F.col("role"), F.col("text")), 256))


def faults(rows: DataFrame) -> DataFrame:
    """Rows with ``blank``, ``cut`` (truncated) and ``again``: an earlier turn has the same role and text."""
    core = F.rtrim("text", F.lit(SPACE))
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("gone"))
    rows = rows.withColumns({"blank": core == "", "cut": ~F.right(core, F.lit(1)).isin(list(STOPS)), "key": _key()})
    some = rows.filter(~F.col("gone")).groupBy("key").agg(F.count("*").alias("times"), F.max(F.col("turn").isNull()).alias("none"), F.min("turn").alias("earliest"))
    repeats = some.filter("times > 1").select("key", F.when(~F.col("none"), F.col("earliest")).alias("earliest"), F.lit(True).alias("more"))
    again = F.coalesce(F.col("more") & F.col("turn").isNotNull() & (F.col("earliest").isNull() | (F.col("turn") > F.col("earliest"))), F.lit(False))
    return rows.join(repeats, "key", "left").withColumn("again", again).drop("more", "earliest")


def _rows(table: pa.Table, *order: str) -> list[dict]:
    return sorted(table.to_pylist(), key=lambda r: tuple(r[c] for c in order))


def _ends(table: pa.Table) -> pa.Table:
    """End vector of every part of one conversation."""
    vector, out = LAST, []
    for row in reversed(_rows(table, "part")):
        out.append((row["part"], list(vector)))
        m = row["matrix"]
        vector = times(tuple(tuple(m[4 * i : 4 * i + 4]) for i in range(4)), vector)
    conv = table.column("conv_id").combine_chunks()
    return pa.table({"conv_id": pa.concat_arrays([conv[:1]] * len(out)), "part": pa.array([p for p, _ in out], pa.int32()), "end": pa.array([e for _, e in out], pa.list_(pa.int64()))})


def _maps(table: pa.Table) -> pa.Table:
    """The state behind one part for every state before it."""
    rows = _rows(table, "block")
    symbols, end = b"".join(r["symbols"] for r in rows), tuple(rows[0]["end"])
    return pa.table({"conv_id": table.column("conv_id").combine_chunks()[:1], "part": pa.array([rows[0]["part"]], pa.int32()), "to": pa.array([[walk(symbols, end, q)[1] for q in range(4)]], pa.list_(pa.int32()))})


def _starts(table: pa.Table) -> pa.Table:
    """State before every part of one conversation, its totals, and its closing inserts."""
    rows = _rows(table, "part")
    state, out = 0, []
    total = {c: 0 for c in ("distinct", "blank", "duplicate", "truncated", "illegal")} | {"lo": None, "hi": None}
    right, vector = None, LAST
    for row in reversed(rows):
        m = row["matrix"]
        vector = times(tuple(tuple(m[4 * i : 4 * i + 4]) for i in range(4)), vector)
    for row in rows:
        out.append({"part": row["part"], "start": state})
        state = row["to"][state] if row["to"] else state
        for c in ("distinct", "blank", "duplicate", "truncated", "illegal"):
            total[c] += row[c]
        if row["lo"] is not None:
            total["distinct"] -= row["lo"] == total["hi"]
            total["lo"], total["hi"] = row["lo"] if total["lo"] is None else total["lo"], row["hi"]
        if row["left"] is not None:
            total["illegal"] += right is not None and right + row["left"] not in ("su", "ua", "au")
            right = row["right"]
    more = closing(state)
    out.append(total | {"part": TOTALS, "cost": vector[0]})
    if more:
        out.append({"part": CLOSING, "audit": "I" * len(more), "roles": more, "texts": [""] * len(more)})
    conv = table.column("conv_id").combine_chunks()
    columns = {"conv_id": pa.concat_arrays([conv[:1]] * len(out)), "part": pa.array([r["part"] for r in out], pa.int32()), "start": pa.array([r.get("start") for r in out], pa.int32())}
    columns |= {c: pa.array([r.get(c) for r in out], pa.int64()) for c in (*COUNTS, "cost")}
    columns |= {"audit": pa.array([r.get("audit") for r in out], pa.string())} | {c: pa.array([r.get(c) for r in out], pa.list_(pa.string())) for c in ("roles", "texts")}
    return pa.table(columns)


def _edits(table: pa.Table) -> pa.Table:
    """Edits per row of every block of one part, and the state before the block."""
    rows = _rows(table, "block")
    symbols, state = b"".join(r["symbols"] for r in rows), rows[0]["start"]
    edits, _, _ = walk(symbols, tuple(rows[0]["end"]), state)
    at, out = 0, []
    for row in rows:
        mine = edits[at : at + len(row["symbols"])]
        at += len(mine)
        out.append((row["block"], mine, state))
        for letters, symbol in zip(mine, row["symbols"], strict=True):
            for letter in letters:
                state = state if letter == "D" else _keep(symbol, state) if letter == "K" else DUE[state]
    conv = table.column("conv_id").combine_chunks()
    n = len(out)
    return pa.table(
        {"conv_id": pa.concat_arrays([conv[:1]] * n), "part": pa.array([rows[0]["part"]] * n, pa.int32()), "block": pa.array([o[0] for o in out], pa.int32()), "edits": pa.array([o[1] for o in out], pa.list_(pa.string())), "start": pa.array([o[2] for o in out], pa.int32())}
    )


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            edits, roles, texts = (one.column(c)[0].as_py() for c in ("edits", "roles", "texts"))
            roles, texts, _ = apply(edits, roles, texts, one.column("start")[0].as_py())
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [one.column("conv_id"), one.column("part"), one.column("block"), pa.array(["".join(edits)], pa.string()), pa.array([roles], strings), pa.array([texts], strings)], ["conv_id", "part", "block", "audit", "roles", "texts"]
            )


def _same(a: DataFrame, b: DataFrame, *names: str) -> DataFrame:
    """Join on names that may be null."""
    marked = b.select(*(F.col(n).alias(f"__{n}") for n in names), *(c for c in b.columns if c not in names))
    on = [a[n].eqNullSafe(marked[f"__{n}"]) for n in names]
    return a.join(marked, on).drop(*(f"__{n}" for n in names))


def repair(rows: DataFrame) -> DataFrame:
    """Pieces of repaired conversations: ``conv_id, part, block, gaps, blank, duplicate, truncated, illegal, cost, audit, roles, texts``.

    A conversation that one task could solve is one piece (``part`` null). Another has one piece with its
    totals (``part`` -1) and its audit and rows in pieces ordered by ``part`` and ``block``.
    """
    spark = rows.sparkSession
    conv = rows.schema["conv_id"].dataType.simpleString()
    ddl = _schema(pa.int64())[1]
    ordered = faults(rows).repartitionByRange(lanes(spark), "conv_id", "turn", "role", F.left("text", F.lit(64))).sortWithinPartitions("conv_id", "turn", "role", "text")
    found = stored(ordered.mapInArrow(_parts, f"conv_id {conv}, {ddl}"), "conversations")
    parts, blocks = found.filter("block = -1"), found.filter("block >= 0")
    light = blocks.select("conv_id", "part", "block", "symbols")
    ends = stored(parts.select("conv_id", "part", "matrix").groupBy("conv_id").applyInArrow(_ends, f"conv_id {conv}, part int, end array<long>"), "ends")
    ended = _same(light, ends, "conv_id", "part")
    maps = ended.groupBy("conv_id", "part").applyInArrow(_maps, f"conv_id {conv}, part int, to array<int>")
    marked = maps.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "to")
    mapped = parts.drop("symbols", "roles", "texts", "cost", "audit").join(marked, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left").drop("c", "p")
    totals = stored(
        mapped.groupBy("conv_id").applyInArrow(_starts, f"conv_id {conv}, part int, start int, {', '.join(f'{c} long' for c in (*COUNTS, 'cost'))}, audit string, roles array<string>, texts array<string>"), "starts"
    )
    started = _same(ended, totals.filter("start IS NOT NULL").select("conv_id", "part", "start"), "conv_id", "part")
    edits = started.groupBy("conv_id", "part").applyInArrow(_edits, f"conv_id {conv}, part int, block int, edits array<string>, start int")
    pieces = _same(blocks.select("conv_id", "part", "block", "roles", "texts"), edits, "conv_id", "part", "block").mapInArrow(_apply, f"conv_id {conv}, part int, block int, audit string, roles array<string>, texts array<string>")
    out = found.filter("part IS NULL").drop("matrix", "symbols", "left", "right")
    out = out.unionByName(totals.filter("start IS NULL").drop("start"), allowMissingColumns=True).unionByName(pieces, allowMissingColumns=True)
    gaps = F.when(F.col("cost").isNotNull(), F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("distinct"), F.lit(0)))
    return out.select("conv_id", "part", "block", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "roles", "texts")


def damage(rows: DataFrame) -> DataFrame:
    """Rows damaged by crc32 of ``conv_id:turn`` modulo 20: 0 drops (``gone``), 1 empties, 2 removes stops, 3 repeats, 4 sets the role."""
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(named.cast("binary")) % 20
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), F.lit("")).when(F.col("kind") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to one row per conversation: whole audit, totals and the digest of its repaired rows."""
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    conv, total, audit, digest, any_ = None, None, [], None, False
    kind = None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([conv, *(pa.array([total[n]], pa.int64()) for n in names), pa.array(["".join(audit)], pa.string()), pa.array([digest.hexdigest()], pa.string())], ["conv_id", *names, "audit", "repaired_sha256"])

    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            if one.column("part")[0].as_py() == TOTALS:
                if digest is not None:
                    yield row()
                conv, total, audit, digest, any_ = one.column("conv_id"), {n: one.column(n)[0].as_py() for n in names}, [], hashlib.sha256(), False
                continue
            audit.append(one.column("audit")[0].as_py())
            lines = [f"{r}:{t}" for r, t in zip(one.column("roles")[0].as_py(), one.column("texts")[0].as_py(), strict=True)]
            if lines:
                digest.update((("\n" if any_ else "") + "\n".join(lines)).encode("utf-8", "surrogatepass"))
                any_ = True
    if digest is not None:
        yield row()


def op13_query(rows: DataFrame) -> DataFrame:
    pieces = repair(damage(rows))
    conv = rows.schema["conv_id"].dataType.simpleString()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    short = pieces.filter("part IS NULL").select("conv_id", *counts, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    long = pieces.filter("part IS NOT NULL").repartition(lanes(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "block")
    return short.unionByName(long.mapInArrow(_digests, f"conv_id {conv}, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string"))


#: The crc32 is worked out bit by bit; edits are searched forward over (state, cost, audit), the least of each state kept.
OP13_SQL = """
WITH RECURSIVE named AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS nm, coalesce(role, ' ') AS r0, coalesce(text, ' ') AS t0 FROM conversations),
summed AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(nm, ''), lambda c: ascii(c)::BIGINT)),
    lambda h, c: list_reduce(list_concat([xor(h, c)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT) % 20 AS k FROM named),
damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE r0 END AS role,
                   CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(t0, '[.!?]', '', 'g') ELSE t0 END AS text, unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM summed WHERE k <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM damaged),
judged AS (SELECT *, left(role, 1) AS ini, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut FROM placed),
rowsx AS (SELECT *, NOT blank AND again AS dup, NOT blank AND NOT again AND cut AS trunc, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM judged),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate,
                 count(*) FILTER (WHERE trunc) AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM rowsx GROUP BY conv_id),
inserts(q, z, c, a, t) AS (VALUES (0, 0, 0, '', []), (0, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []), (1, 2, 2, 'I', ['user:']), (1, 3, 4, 'II', ['user:', 'assistant:']),
                           (2, 2, 0, '', []), (2, 3, 2, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 2, 'I', ['user:'])),
edits(e, q, ini, z, c) AS (SELECT * FROM (VALUES ('K', 0, 's', 1, 0), ('K', 0, 'u', 2, 0), ('K', 1, 'u', 2, 0), ('K', 3, 'u', 2, 0), ('K', 2, 'a', 3, 0),
                           ('R', 0, NULL, 2, 2), ('R', 1, NULL, 2, 2), ('R', 3, NULL, 2, 2), ('R', 2, NULL, 3, 2), ('D', 0, NULL, 0, 3), ('D', 1, NULL, 1, 3), ('D', 2, NULL, 2, 3), ('D', 3, NULL, 3, 3))),
walk AS (SELECT conv_id, 0::BIGINT AS i, 0 AS q, {'c': 0::BIGINT, 'a': '', 't': ''} AS best FROM stats
         UNION ALL
         SELECT w.conv_id, w.i + 1, e.z, min({'c': w.best.c + s.c + e.c + CASE WHEN x.trunc AND e.e <> 'D' THEN 1 ELSE 0 END, 'a': w.best.a || s.a || e.e,
                't': w.best.t || coalesce(array_to_string(s.t, chr(10)) || CASE WHEN len(s.t) > 0 THEN chr(10) ELSE '' END, '')
                     || CASE e.e WHEN 'D' THEN '' WHEN 'K' THEN x.role || ':' || x.text || chr(10) ELSE CASE e.z WHEN 2 THEN 'user:' ELSE 'assistant:' END || x.text || chr(10) END})
         FROM walk w JOIN rowsx x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.i = w.i + 1 JOIN inserts s ON s.q = w.q
         JOIN edits e ON e.q = s.z AND (e.ini IS NULL OR e.ini = x.ini) AND (e.e = 'D' OR NOT (x.blank OR x.dup))
         GROUP BY w.conv_id, w.i + 1, e.z),
ended AS (SELECT w.conv_id, min({'c': w.best.c + s.c, 'a': w.best.a || s.a, 't': w.best.t || coalesce(array_to_string(s.t, chr(10)) || CASE WHEN len(s.t) > 0 THEN chr(10) ELSE '' END, '')}) AS best
          FROM walk w JOIN stats g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.n = w.i JOIN inserts s ON s.q = w.q AND s.z IN (0, 3) GROUP BY w.conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT d.conv_id, coalesce(g.gaps, 0)::BIGINT AS gaps, coalesce(g.blank, 0)::BIGINT AS blank, coalesce(g.duplicate, 0)::BIGINT AS duplicate, coalesce(g.truncated, 0)::BIGINT AS truncated,
       coalesce(g.illegal, 0)::BIGINT AS illegal, coalesce(e.best.c, 0)::BIGINT AS cost, coalesce(e.best.a, '') AS audit,
       sha256(coalesce(left(e.best.t, greatest(length(e.best.t) - 1, 0)), '')) AS repaired_sha256
FROM ids d LEFT JOIN stats g ON g.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM d.conv_id
"""
