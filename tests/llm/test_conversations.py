"""Conversation repair against a plain dynamic programme over the whole conversation."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from apiscope.llm import conversations, queries

from .helpers import SF

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
           "repaired_sha256")
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def plan(rows):
    """(cost, audit, repaired rows) of the cheapest edits, least audit first; rows: (role, text, fault)."""
    best = {(len(rows), s): (0, "", ()) for s in ("", "a")}

    def insert(i):
        for _ in range(3):
            for s in ("", "s", "u", "a"):
                if (i, NEXT[s]) in best:
                    cost, audit, lines = best[i, NEXT[s]]
                    new = (cost + 5, "I" + audit, (NAMES[NEXT[s]] + ":", lines))
                    if (i, s) not in best or new[:2] < best[i, s][:2]:
                        best[i, s] = new

    insert(len(rows))
    for i in range(len(rows) - 1, -1, -1):
        role, text, fault = rows[i]
        for s in ("", "s", "u", "a"):
            cost, audit, lines = best[i + 1, s]
            ways = [(cost + 2, "D" + audit, lines)]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                to = STEP.get((s, role[:1]))
                if to:
                    cost, audit, lines = best[i + 1, to]
                    ways.append((cost + more, "K" + audit, (role + ":" + text, lines)))
                cost, audit, lines = best[i + 1, NEXT[s]]
                ways.append((cost + more + 1, "R" + audit, (NAMES[NEXT[s]] + ":" + text, lines)))
            best[i, s] = min(ways, key=lambda w: w[:2])
        insert(i)
    return best[0, ""]


def brute(rows, hurt=True):
    ids = {r[0] for r in rows}
    rows = damage(rows) if hurt else [(c, t, *(" " if x is None else x for x in more))
                                      for c, t, *more in rows]
    out = []
    for conv in ids:
        own = sorted((r[1:] for r in rows if r[0] == conv),
                     key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, judged = set(), []
        for _, role, text in own:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault = ("blank" if not last else "duplicate" if (role, text) in seen
                     else "truncated" if last[0] not in ".!?" else "")
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = [r[0] for r in own if r[0] is not None]
        cost, audit, linked = plan(judged) if judged else (0, "", ())
        lines = []
        while linked:
            line, linked = linked
            lines.append(line)
        faults = [j[2] for j in judged]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                    *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au")
                        for a, b in itertools.pairwise(judged)),
                    cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    assert found(queries.op11_auction_repair(spark, SF)) == brute(rows)


@pytest.mark.parametrize("block,partitions", [(1024, 3), (5, 4), (1, 2)])
def test_cut_conversations(spark, block, partitions):
    """Blocks of one row to many, partitions that cut conversations, all kinds of faults."""
    rng = random.Random(block)
    rows = []
    for conv in [*range(12), None]:
        for _ in range(rng.choice((1, 2, 6, 40))):
            rows.append((conv, rng.choice((None, *range(30))),
                         rng.choice(("user", "assistant", "system", "tool", "", None)),
                         rng.choice(("A b.", "C", " \t", "", None, "Why?", f"n{rng.random()}.", "É "))))
        rows += [rows[-1]] * rng.choice((0, 0, 7))
    rows += [(99, t, "user" if t % 2 else "assistant", f"t{t % 50}.") for t in range(200)]
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        extra = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS cost", "'x' AS part", "2 AS copies")
        hurt, left = conversations.damaged(extra)
        assert found(conversations.digests(conversations.repair(hurt, left, block=block))) == brute(rows)
        assert found(conversations.digests(conversations.repair(extra, block=block))) == brute(rows, hurt=False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_blocks_meet_at_any_cut():
    """Costs of blocks, put together, are those of the whole, wherever it is cut."""
    rng = random.Random(4)
    for _ in range(60):
        items = tuple((rng.choice("suax"), rng.choice("kktg"), 1) for _ in range(rng.randint(2, 60)))
        items = tuple(("", "g", n) if k == "g" else (i, k, n) for i, k, n in items)
        at = rng.randint(1, len(items) - 1)
        left, right = conversations.costs(items[:at]), conversations.costs(items[at:])
        both = [min(conversations._FAR, *(left[4 * a + m] + right[4 * m + b] for m in range(4)))
                for a in range(4) for b in range(4)]
        assert both == conversations.costs(items)


def test_prices_never_exceed_arcs():
    """Complementary slackness: no price above an arc's cost and the price at its head."""
    items = tuple((c, "k", 1) for c in "sauuxaausua" * 3)[:32]
    arcs, price = conversations.auction(items, conversations._END)
    assert all(price[i] <= cost + price[to] for i, own in enumerate(arcs) for cost, to, _ in own)


def test_long_conversation_is_linear(spark):
    rows = [(1, t, ("user", "assistant", "system")[t % 3], f"{t}.") for t in range(30_000)]
    got = found(conversations.digests(conversations.repair(spark.createDataFrame(rows, SCHEMA))))
    assert len(got) == 1 and len(got[0][7].replace("I", "")) == 30_000
    assert got[0][6] == plan([(r, t, "") for _, _, r, t in rows])[0]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert found(conversations.digests(conversations.repair(none))) == []
    gone = spark.createDataFrame([(5, 1, "user", "a."), (None, None, None, None)], SCHEMA)
    empty = hashlib.sha256(b"").hexdigest()
    assert found(conversations.digests(conversations.repair(gone, F.lit(False)))) == sorted(
        [(5, 0, 0, 0, 0, 0, 0, "", empty), (None, 0, 0, 0, 0, 0, 0, "", empty)], key=repr)
