"""Repair of conversations: cheapest edits by the auction shortest-path algorithm.

A conversation's rows, in order of turn, span a lattice: a node for each place
between rows and each state of the wanted form ``(s?(ua)+)?`` (nothing yet,
after s, after u, after a), an arc for each edit.  The auction algorithm keeps a
path from the entry and a price at every node.  The price of the path's last
node rises to the least of (arc cost + price at its head); the path is then
contracted by that node, or, if the price stood there already, extended along
the arc.  When the path reaches the exit, the entry's price is the least cost,
and every arc of every cheapest path is tight (its tail's price is its cost plus
its head's price).  The audit follows tight arcs that lead to the exit, the
least letter first.

No conversation is one task's.  Equal rows are counted before any shuffle, rows
are range-partitioned by (conversation, turn, role, text), and cut into blocks
of at most `BLOCK` rows.  A conversation that lies within one block is finished
there.  Of a cut one each block tells its 4 x 4 least costs from state to state;
(min, +) products from the end give the cost behind each block, a trace from
each entry state then gives the exit state, and these are followed from the
front.  Only that narrow table is read in order; texts stay in their blocks.

Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (blank rows and
duplicates must go), Insert an empty row of user or assistant 5; a truncated row
that stays costs 5 more.

Defined results: null roles and texts are one blank; rows of a null turn come
first, those of a null ``conv_id`` are one conversation; rows of equal turn go by
role, then text, both in code-point order; equal rows are all but the first
duplicates, also in one turn; a role of other initial than s, u, a fits nowhere
unless changed; rows that are not ``present`` only name their conversation, and
one of no other rows has zeros and empty results; gaps beyond a long are null;
an empty table has no conversations.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, written

#: Rows and bytes of text of one block, and rows of one auction.
BLOCK, BLOCK_BYTES, CHUNK = 1024, 1_000_000, 32

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_START, _S, _U, _A = range(4)
#: State after a row of this initial, and the state that an inserted or changed row leads to.
_FITS = {(_START, "s"): _S, (_START, "u"): _U, (_S, "u"): _U, (_U, "a"): _A, (_A, "u"): _U}
_MADE = (_U, _U, _A, _U)
#: What a conversation's end costs in each state: rows still to be inserted.
_END = (0, 2 * INSERT, INSERT, 0)
_LEGAL = {"su", "ua", "au"}
_FAR = 1 << 60

#: (initial, kind, copies): kind k stays as it is, t is truncated, g must go
Item = tuple[str, str, int]


def _arcs(items: tuple[Item, ...], exits, within: int):
    """Arcs (cost, head, letter) of every node ``4 * place + state``, letters in order.

    States beyond ``within`` are left out; ``exits`` are costs from the last
    place to the exit, the node after all others.
    """
    n, out = len(items), []
    for i in range(n + 1):
        for s in range(4):
            here = []
            if i == n:
                if exits[s] < _FAR:
                    here.append((exits[s], 4 * n + 4, ""))
            else:
                initial, kind, copies = items[i]
                here.append((DELETE * copies, 4 * i + 4 + s, "D"))
                if _MADE[s] <= within:
                    here.append((INSERT, 4 * i + _MADE[s], "I"))
                if kind != "g":
                    more = TRUNCATED if kind == "t" else 0
                    kept = _FITS.get((s, initial), 4)
                    if kept <= within:
                        here.append((KEEP + more, 4 * i + 4 + kept, "K"))
                    if _MADE[s] <= within:
                        here.append((REROLE + more, 4 * i + 4 + _MADE[s], "R"))
            out.append(here)
    out.append([])
    return out


def auction(items: tuple[Item, ...], exits, entries=(0, 1, 2, 3), within: int = 3):
    """(arcs, prices) after an auction from each entry state to the exit.

    An entry's price is its least cost to the exit, `_FAR` if there is none.
    Prices begin at what the rows behind a node cost at least, so no arc is
    worth less than its tail's price.  Every state that is within bounds must
    reach the exit, unless no arc leads back (``within`` below u).
    """
    arcs = _arcs(items, exits, within)
    n = len(items)
    price = [min(exits)] * (4 * n + 4) + [0]
    for i in range(n - 1, -1, -1):
        kind, copies = items[i][1:]
        least = DELETE * copies if kind == "g" else min(DELETE, TRUNCATED) if kind == "t" else 0
        price[4 * i:4 * i + 4] = [price[4 * i + 4] + least] * 4
    for entry in entries:
        path = [entry]
        while path[-1] != 4 * n + 4:
            node = path[-1]
            best, head = _FAR, None
            for cost, to, _ in arcs[node]:
                if cost + price[to] < best:
                    best, head = cost + price[to], to
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            elif head is None:
                if len(path) == 1:
                    break
                path.pop()
            else:
                path.append(head)
    return arcs, price


def _chunks(items: tuple[Item, ...]) -> list[tuple[Item, ...]]:
    return [items[i:i + CHUNK] for i in range(0, len(items), CHUNK)]


def _solved(items: tuple[Item, ...], exits, first=(0, 1, 2, 3), within: int = 3):
    """Auctions over chunks from the end: (arcs, prices, exits) of each, in order."""
    out = []
    parts = _chunks(items)
    for at in range(len(parts) - 1, -1, -1):
        arcs, price = auction(parts[at], exits, (0, 1, 2, 3) if at else first, within)
        out.append((arcs, price))
        exits = price[:4]
    return out[::-1]


def _traced(solved, entry: int) -> tuple[str, int]:
    """Letters of the least audit among the cheapest, and the state it ends in."""
    letters: list[str] = []
    for arcs, price in solved:
        exit_node = len(price) - 1
        leads = bytearray(len(price))
        leads[exit_node] = 1
        for place in range(exit_node - 4, -1, -4):
            for _ in range(3):  # inserted rows lead from state to state of one place
                for node in range(place, place + 4):
                    if not leads[node] and any(
                            leads[to] and price[node] == cost + price[to]
                            for cost, to, _ in arcs[node]):
                        leads[node] = 1
        node = entry
        while True:
            for cost, to, letter in arcs[node]:
                if leads[to] and price[node] == cost + price[to]:
                    break
            else:
                raise AssertionError("no tight arc leads on")
            if to == exit_node:
                entry = node % 4
                break
            letters.append(letter)
            node = to
    return "".join(letters), entry


@lru_cache(1 << 15)
def cheapest(items: tuple[Item, ...]) -> str:
    """The audit of a whole conversation."""
    if not items:
        return ""
    letters, state = _traced(_solved(items, _END, (0,)), _START)
    return _spelled(letters, items) + _tail(state)


def _tail(state: int) -> str:
    return "I" * (_END[state] // INSERT)


def _spelled(letters: str, items: tuple[Item, ...]) -> str:
    """A letter for each row: an item of several copies is deleted by as many."""
    if all(copies == 1 for _, _, copies in items):
        return letters
    out, at = [], 0
    for letter in letters:
        out.append(letter * items[at][2] if letter == "D" else letter)
        at += letter != "I"
    return "".join(out)


def costs(items: tuple[Item, ...]) -> list[int]:
    """Least costs from each state before ``items`` to each state after them (`_FAR`: none)."""
    out = [[_FAR] * 4 for _ in range(4)]
    for end in range(4):
        exits = [0 if s == end else _FAR for s in range(4)]
        within = 3 if end >= _U else end
        price = _solved(items, exits, tuple(range(within + 1)), within)[0][1]
        for start in range(within + 1):
            out[start][end] = price[start]
    return [c for row in out for c in row]


def replayed(audit: str, state: int, rows: list[tuple[str, str, str, int]]):
    """(cost, repaired rows, state after them) of an audit's letters over block rows.

    Rows are (role, text, kind, copies); kind b or d: all copies go, otherwise
    all but the first.
    """
    cost, out, at = 0, [], 0
    flat = [(role, text, kind if c == 0 else "d") for role, text, kind, n in rows for c in range(n)]
    for letter in audit:
        if letter == "D":
            cost += DELETE
            at += 1
            continue
        made = ("user", "assistant")[_MADE[state] == _A]
        if letter == "I":
            cost += INSERT
            out.append((made, ""))
            state = _MADE[state]
            continue
        role, text, kind = flat[at]
        at += 1
        cost += TRUNCATED * (kind == "t") + (REROLE if letter == "R" else KEEP)
        if letter == "R":
            out.append((made, text))
            state = _MADE[state]
        else:
            out.append((role, text))
            state = _FITS[state, role[:1]]
    return cost, out, state


def _items(roles, kinds, copies) -> tuple[Item, ...]:
    """Lattice items of block rows: deleted copies that follow each other are one."""
    out: list[Item] = []
    for role, kind, n in zip(roles, kinds, copies, strict=True):
        if kind in "kt":
            out.append((role[:1], kind, 1))
            n -= 1
        if n and out and out[-1][1] == "g":
            out[-1] = ("", "g", out[-1][2] + n)
        elif n:
            out.append(("", "g", n))
    return tuple(out)


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn")
_BLOCK = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int64()), ("whole", pa.bool_()),
    *[(c, pa.int64()) for c in _COUNTS], ("first", pa.string()), ("last", pa.string()),
    ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("kinds", pa.string()),
    ("copies", pa.list_(pa.int64())), ("costs", pa.list_(pa.int64())), ("cost", pa.int64()),
    ("audit", pa.string()), ("repaired", _TURNS)])
_BLOCK_DDL = ("conv_id long, part int, block long, whole boolean, rows long, blank long, duplicate long, "
              "truncated long, illegal long, turns long, first_turn long, last_turn long, first string, "
              "last string, roles array<string>, texts array<string>, kinds string, copies array<long>, "
              "costs array<long>, cost long, audit string, repaired array<struct<role:string,text:string>>")


def _counted(rows) -> dict:
    """What a block adds to its conversation's counts."""
    out = dict.fromkeys(_COUNTS, 0) | {"first_turn": None, "last_turn": None, "first": "", "last": ""}
    last = None
    for turn, role, _, kind, n in rows:
        initial = role[:1] or "?"
        out["rows"] += n
        out["blank"] += n if kind == "b" else 0
        out["truncated"] += kind == "t"
        out["duplicate"] += 0 if kind == "b" else n if kind == "d" else n - 1
        out["illegal"] += n - 1 + (last is not None and last + initial not in _LEGAL)
        if turn is not None:
            if out["first_turn"] is None:
                out["first_turn"] = turn
            out["turns"] += turn != out["last_turn"]
            out["last_turn"] = turn
        out["first"] = out["first"] or initial
        out["last"] = last = initial
    return out


def _block(conv, part: int, number: int, rows, whole: bool) -> dict:
    roles, kinds, copies = [r[1] for r in rows], "".join(r[3] for r in rows), [r[4] for r in rows]
    out = {"conv_id": conv, "part": part, "block": number, "whole": whole, **_counted(rows)}
    items = _items(roles, kinds, copies)
    if whole:
        audit = cheapest(items)
        cost, turns, _ = replayed(audit, _START, [(r[1], r[2], r[3], r[4]) for r in rows])
        return out | {"cost": cost, "audit": audit, "repaired": [
            {"role": r, "text": t} for r, t in turns]}
    return out | {"roles": roles, "texts": [r[2] for r in rows], "kinds": kinds, "copies": copies,
                  "costs": costs(items) if items else
                  [0 if a == b else _FAR for a in range(4) for b in range(4)]}


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int = 500,
             limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(t["text"]) for t in row.get("repaired") or ()) + sum(
            map(len, row.get("texts") or ()))
        if len(held) >= size or weight >= limit:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _cut(most: int):
    """Blocks of sorted rows; one conversation of a partition's middle is whole in it."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part = TaskContext.get().partitionId()
        conv, rows, size, number, clean, started = None, [], 0, 0, False, False
        for batch in batches:
            for own, turn, role, text, kind, copies in zip(
                    *(batch.column(c).to_pylist() for c in (
                        "conv_id", "turn", "role", "text", "kind", "copies")), strict=True):
                new = not started or own != conv
                if new or len(rows) >= most or size >= BLOCK_BYTES:
                    if started:
                        yield _block(conv, part, number, rows, clean and new)
                        number += 1
                        # the partition's first conversation may have begun before it
                        clean = new
                    conv, rows, size, started = own, [], 0, True
                if kind != "x":
                    rows.append((turn, role, text, kind, copies))
                    size += len(text)
        if started:  # and its last may go on after it
            yield _block(conv, part, number, rows, False)

    return lambda batches: _batched(blocks(batches), _BLOCK)


_EXITS = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("exits", pa.list_(pa.int64()))])


def _behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs behind each block, from a conversation's last block to its first."""
    conv, behind, started = None, _END, False
    for batch in batches:
        out = []
        for own, part, block, own_costs in zip(*(batch.column(c).to_pylist() for c in (
                "conv_id", "part", "block", "costs")), strict=True):
            if not started or own != conv:
                conv, behind, started = own, _END, True
            out.append({"part": part, "block": block, "exits": list(behind)})
            behind = [min(_FAR, *(own_costs[4 * s + e] + behind[e] for e in range(4)))
                      for s in range(4)]
        yield pa.RecordBatch.from_pylist(out, _EXITS)


_TRACES = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int64()),
                     ("audits", pa.list_(pa.string())), ("ends", pa.list_(pa.int32()))])


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit of each block from each state before it, and the state it leads to."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            items = _items(row["roles"], row["kinds"], row["copies"])
            audits, ends = [""] * 4, [0, 1, 2, 3]
            if items:
                solved = _solved(items, row["exits"])
                for s in range(4):
                    letters, ends[s] = _traced(solved, s)
                    audits[s] = _spelled(letters, items)
            out.append({"conv_id": row["conv_id"], "part": row["part"], "block": row["block"],
                        "audits": audits, "ends": ends})
        yield pa.RecordBatch.from_pylist(out, _TRACES)


_CHOSEN = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("state", pa.int32()),
                     ("letters", pa.string())])


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before each block, from a conversation's first block to its last."""
    held: dict | None = None

    def ended(row: dict, last: bool) -> dict:
        if last:
            row["letters"] += _tail(row.pop("end"))
        row.pop("end", None)
        row.pop("conv", None)
        return row

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            same = held is not None and held["conv"] == row["conv_id"]
            state = held["end"] if same else _START
            if held is not None:
                out.append(ended(held, not same))
            held = {"conv": row["conv_id"], "part": row["part"], "block": row["block"],
                    "state": state, "letters": row["audits"][state], "end": row["ends"][state]}
        if out:
            yield pa.RecordBatch.from_pylist(out, _CHOSEN)
    if held is not None:
        yield pa.RecordBatch.from_pylist([ended(held, True)], _CHOSEN)


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                cost, turns, _ = replayed(row["letters"], row["state"], list(zip(
                    row["roles"], row["texts"], row["kinds"], row["copies"], strict=True)))
                kept = {c: row[c] for c in _PIECE.names if c in row}
                yield kept | {"cost": cost, "audit": row["letters"],
                              "repaired": [{"role": r, "text": t} for r, t in turns]}

    yield from _batched(rows(), _PIECE)


_WORK = ("roles", "texts", "kinds", "copies", "costs")
_PIECE = pa.schema([f for f in _BLOCK if f.name not in _WORK])
_PIECE_DDL = ", ".join(c for c in _BLOCK_DDL.split(", ") if c.split()[0] not in _WORK)


def repair(turns: DataFrame, present: Column | None = None, *, block: int = BLOCK) -> DataFrame:
    """Pieces of repaired conversations (conv_id, turn, role, text).

    A piece is a run of at most ``block`` rows: ``part`` and ``block`` give its place, ``whole``
    says that it is all of its conversation.  It has its counts, ``cost``,
    ``audit`` letters and ``repaired`` rows.
    """
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))

    def own(c: str) -> Column:
        return F.when(here, F.coalesce(F.col(c), F.lit(" ")))

    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.when(here, F.col("turn").cast("long")).alias("turn"), own("role").alias("role"),
        own("text").alias("text"))
    digest = F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text"))
    # texts that stand in several turns, and the first of those
    again = written(rows.where(F.col("role").isNotNull()).select("conv_id", "turn", digest.alias("digest"))
                    .groupBy("conv_id", "digest").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("seen"),
        F.max(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("last"))
        .where(F.col("seen") != F.col("last")).select(
            F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"),
            F.col("seen.turn").alias("_seen"), F.lit(True).alias("_again")), "again")
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (digest == F.col("_digest")),
                     "left")
    end = F.right(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    kind = (F.when(F.col("role").isNull(), "x").when(end == "", "b")
            .when(F.col("_again") & ~F.col("turn").eqNullSafe(F.col("_seen")), "d")
            .when(~end.isin(".", "!", "?"), "t").otherwise("k"))
    order = ["conv_id", "turn", "role", "text"]
    ranged = bounded(rows).select(*order, "copies", kind.alias("kind")).repartitionByRange(
        *order).sortWithinPartitions(*order)
    blocks = written(ranged.mapInArrow(_cut(block), _BLOCK_DDL), "blocks")
    whole = blocks.where("whole").select(*_PIECE.names)
    cut = blocks.where(~F.col("whole"))
    place = ["part", "block"]
    exits = cut.select("conv_id", *place, "costs").repartition("conv_id").sortWithinPartitions(
        "conv_id", F.desc("part"), F.desc("block")).mapInArrow(
        _behind, "part int, block long, exits array<long>")
    traced = cut.select("conv_id", *place, "roles", "kinds", "copies").join(exits, place).mapInArrow(
        _traces, "conv_id long, part int, block long, audits array<string>, ends array<int>")
    chosen = traced.repartition("conv_id").sortWithinPartitions("conv_id", *place).mapInArrow(
        _chosen, "part int, block long, state int, letters string")
    rebuilt = cut.join(chosen, place).drop("cost", "audit", "repaired").mapInArrow(
        _rebuilt, _PIECE_DDL)
    return whole.unionAll(rebuilt)


_RESULT = pa.schema([
    ("conv_id", pa.int64()), *[(c, pa.int64()) for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
    ("audit", pa.string()), ("repaired_sha256", pa.string())])
_RESULT_DDL = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
               "audit string, repaired_sha256 string")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its pieces in order, which are read one by one."""

    def result(c: dict) -> dict:
        gaps = 0 if c["low"] is None else c["high"] - c["low"] + 1 - c["turns"]
        return {k: c[k] for k in ("conv_id", "blank", "duplicate", "truncated", "illegal", "cost")} | {
            "gaps": gaps if gaps < 1 << 63 else None, "audit": "".join(c["audit"]),
            "repaired_sha256": c["hash"].hexdigest()}

    def rows() -> Iterator[dict]:
        c: dict | None = None
        for batch in batches:
            for piece in batch.to_pylist():
                if c is None or piece["whole"] or c["conv_id"] != piece["conv_id"]:
                    if c is not None:
                        yield result(c)
                    c = {"conv_id": piece["conv_id"], "low": None, "high": None, "turns": 0, "last": "",
                         "audit": [], "hash": hashlib.sha256(), "any": False, "blank": 0,
                         "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0}
                for k in ("blank", "duplicate", "truncated", "illegal", "cost"):
                    c[k] += piece[k]
                if c["last"] and piece["first"] and c["last"] + piece["first"] not in _LEGAL:
                    c["illegal"] += 1
                c["last"] = piece["last"] or c["last"]
                if piece["first_turn"] is not None:
                    c["turns"] += piece["turns"] - (c["high"] == piece["first_turn"])
                    c["low"] = piece["first_turn"] if c["low"] is None else c["low"]
                    c["high"] = piece["last_turn"]
                c["audit"].append(piece["audit"])
                for turn in piece["repaired"]:
                    line = ("\n" if c["any"] else "") + turn["role"] + ":" + turn["text"]
                    c["hash"].update(line.encode("utf-8", "surrogatepass"))
                    c["any"] = True
        if c is not None:
            yield result(c)

    yield from _batched(rows(), _RESULT)


def digests(pieces: DataFrame) -> DataFrame:
    """Counts, cost, audit and the SHA-256 of the repaired rows of each conversation.

    A hash runs over a conversation from its begin, so pieces of cut ones are
    read in order, one at a time.
    """
    cut = pieces.where(~F.col("whole")).repartition("conv_id").sortWithinPartitions(
        "conv_id", "part", "block")
    return pieces.where("whole").mapInArrow(_joined, _RESULT_DDL).unionAll(
        cut.mapInArrow(_joined, _RESULT_DDL))


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """The rows with faults put in by a checksum of (conv_id, turn), and which rows are left."""
    blank = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank),
                      F.coalesce(F.col("turn").cast("string"), blank))
    fate = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", blank)
    rows = turns.select("conv_id", "turn", fate.alias("fate"), F.when(
        fate == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"), F.when(
        fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"))
    twice = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("*", F.explode(twice).alias("copy")), F.col("fate") != 0
