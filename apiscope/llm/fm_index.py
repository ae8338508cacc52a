"""Benchmark decontamination: an FM-index for each shard of the training texts.

A shard is a bounded slice of whole documents.  Its words become symbols; those
of no test phrase, and the ends of documents, are the symbol 0, and runs of it
are one.  The shard's suffixes are sorted by prefix doubling, the symbol before
each suffix forms the transform, and a wavelet matrix over it counts symbols up
to any row.  Test phrases are searched backwards, all at once, each step
narrowing a phrase's rows by two ranks; rows of the phrases found are followed
back to the next sampled suffix position, which tells where they occur.  The
words of all occurrences in a document are merged to removal spans.

A phrase is a window of ten consecutive words of an item, or the whole of an
item with fewer.  Phrases go to the tasks in blocks of bounded size.

Defined results: a null or empty text has no words, no hits, and counts as
clean; an item that is null, or has no word or no id, has no phrase; items of
equal id are one; with no item all documents are clean; repeated rows are
judged alike, each for itself.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, parts, tidy
from .words import utf8, words

WINDOW = 10
#: Every so many places of a shard a suffix position is kept.
SAMPLED = 8
#: UTF-8 bytes of test items in one block of phrases.
BLOCK_BYTES = 4_000_000


class Phrases:
    """Distinct windows of test items, as symbols, and the items that hold them."""

    def __init__(self, ids: list, texts: list[str | None]):
        w = words(pa.array(texts, pa.string()))
        self.vocabulary = np.unique(w.hash)
        symbol = np.searchsorted(self.vocabulary, w.hash) + 1
        holders: dict[tuple, set[int]] = {}
        self.items = sorted({str(i) for i in ids if i is not None})
        number = {i: n for n, i in enumerate(self.items)}
        for i, a, b in zip(ids, w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if i is None or a == b:
                continue
            for at in range(a, max(b - WINDOW, a) + 1):
                holders.setdefault(tuple(symbol[at:min(at + WINDOW, b)].tolist()), set()).add(
                    number[str(i)])
        keys = sorted(holders)
        self.length = np.array([len(k) for k in keys], np.int64)
        self.symbols = np.zeros((len(keys), WINDOW), np.int64)  # last symbols at the right end
        for row, key in zip(self.symbols, keys, strict=True):
            row[WINDOW - len(key):] = key
        size = np.array([len(holders[k]) for k in keys], np.int64)
        self.held = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        self.holder = np.array([i for k in keys for i in sorted(holders[k])], np.int64)


def suffix_order(symbol: np.ndarray) -> np.ndarray:
    """Suffixes in order.  Each 0 is taken as a symbol of its own, by its place.

    Prefix doubling: suffixes are ranked by twice as many symbols in each round,
    and only those still tied are sorted again.
    """
    n = len(symbol)
    zero = symbol == 0
    zeros = int(zero.sum())
    order = np.empty(n, np.int64)
    order[:zeros] = np.flatnonzero(zero)
    rest = np.flatnonzero(~zero)
    order[zeros:] = rest[np.argsort(symbol[rest], kind="stable")]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    head = np.ones(n, bool)
    head[zeros + 1:] = symbol[order[zeros + 1:]] != symbol[order[zeros:-1]] if n > zeros else True
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    tied = np.flatnonzero(~(head & np.append(head[1:], True)))  # rows of groups of two or more
    depth = 1
    while len(tied):
        suffix = order[tied]
        first = rank[suffix]
        follow = rank[np.minimum(suffix + depth, n)]
        again = np.lexsort((follow, first))
        suffix, first, follow = suffix[again], first[again], follow[again]
        order[tied] = suffix
        new = np.ones(len(tied), bool)
        new[1:] = (first[1:] != first[:-1]) | (follow[1:] != follow[:-1])
        rank[suffix] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        tied = tied[~(new & np.append(new[1:], True))]
        depth *= 2
    return order


class Index:
    """FM-index of a sequence of symbols below ``size``; 0 separates and is never searched."""

    def __init__(self, symbol: np.ndarray, size: int):
        n = len(symbol)
        order = suffix_order(symbol)
        self.before = np.where(order > 0, symbol[order - 1], 0)  # the transform
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbol, minlength=size))])
        self.bits = max(1, int(size - 1).bit_length())
        level = self.before
        self.zeros: list[np.ndarray] = []   # of each level: zero bits before each row
        for b in range(self.bits - 1, -1, -1):
            one = (level >> b) & 1
            count = np.zeros(n + 1, np.int32)
            np.cumsum(one ^ 1, out=count[1:])
            self.zeros.append(count)
            level = np.concatenate([level[one == 0], level[one == 1]])
        # rows after a separator are all sampled: no walk crosses one
        kept = (self.before == 0) | (order % SAMPLED == 0)
        self.kept = kept
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.position = order[kept]

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each row."""
        start = np.zeros_like(row)
        for count, b in zip(self.zeros, range(self.bits - 1, -1, -1), strict=True):
            one = ((symbol >> b) & 1).astype(bool)
            low, high, total = count[start], count[row], int(count[-1])
            start = np.where(one, total + start - low, low)
            row = np.where(one, total + row - high, high)
        return row - start

    def search(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """Phrases that occur, with their first row and the row after the last."""
        phrase = np.arange(len(symbols))
        low = np.zeros(len(symbols), np.int64)
        high = np.full(len(symbols), len(self.before), np.int64)
        done: list[tuple[np.ndarray, ...]] = []
        for step in range(symbols.shape[1]):
            own = symbols[phrase, symbols.shape[1] - 1 - step]
            both = self.rank(np.concatenate([own, own]), np.concatenate([low, high]))
            low = self.smaller[own] + both[:len(own)]
            high = self.smaller[own] + both[len(own):]
            some = high > low
            whole = some & (length[phrase] == step + 1)
            done.append((phrase[whole], low[whole], high[whole]))
            on = some & ~whole
            phrase, low, high = phrase[on], low[on], high[on]
            if not len(phrase):
                break
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Places of the suffixes in these rows."""
        steps = np.zeros(len(row), np.int64)
        row = row.copy()
        walking = np.flatnonzero(~self.kept[row])
        while len(walking):
            at = row[walking]
            own = self.before[at]
            row[walking] = self.smaller[own] + self.rank(own, at)
            steps[walking] += 1
            walking = walking[~self.kept[row[walking]]]
        return self.position[self.kept_before[row]] + steps


def occurrences(hashes: np.ndarray, doc: np.ndarray, phrases: Phrases):
    """(phrase, number of the first word) of every phrase in a shard's words."""
    none = np.empty(0, np.int64)
    if not len(hashes) or not len(phrases.length):
        return none, none
    at = np.searchsorted(phrases.vocabulary, hashes)
    at[at == len(phrases.vocabulary)] = 0
    symbol = np.where(phrases.vocabulary[at] == hashes, at + 1, 0)
    # a separator after each document, and no two separators in a row
    last = np.flatnonzero(np.append(doc[1:] != doc[:-1], True))
    symbol = np.insert(symbol, last + 1, 0)
    word = np.insert(np.arange(len(hashes)), last + 1, -1)
    single = np.ones(len(symbol), bool)
    single[1:] = (symbol[1:] != 0) | (symbol[:-1] != 0)
    symbol, word = symbol[single], word[single]
    index = Index(symbol, len(phrases.vocabulary) + 1)
    phrase, low, high = index.search(phrases.symbols, phrases.length)
    size = high - low
    if not size.sum():
        return none, none
    row = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return np.repeat(phrase, size), word[index.locate(row)]


def _covered(part: pa.RecordBatch, w, phrases: Phrases, spans: list, items: list):
    """Spans and items of each text, those of earlier blocks of phrases included."""
    n = part.num_rows
    phrase, first = occurrences(w.hash, w.doc, phrases)
    cover = np.zeros(len(w.hash) + 1, np.int64)  # one more from a first word, one less after a last
    np.add.at(cover, first, 1)
    np.add.at(cover, first + phrases.length[phrase], -1)
    for d, own in enumerate(spans):
        for a, b in own:
            cover[w.first[d] + a] += 1
            cover[w.first[d] + b] -= 1
    hit = np.cumsum(cover[:-1]) > 0
    other = w.doc[1:] != w.doc[:-1]
    begin = hit.copy()
    begin[1:] &= ~hit[:-1] | other
    end = hit.copy()
    end[:-1] &= ~hit[1:] | other
    merged: list[list[list[int]]] = [[] for _ in range(n)]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    for d, a, b in zip(w.doc[begin].tolist(), begin.tolist(), end.tolist(), strict=True):
        merged[d].append([a - int(w.first[d]), b - int(w.first[d])])
    found: list[set[str]] = [set(x) for x in items]
    for d, p in np.unique(np.stack([w.doc[first], phrase], axis=1), axis=0).tolist():
        found[d].update(phrases.items[i] for i in phrases.holder[phrases.held[p]:phrases.held[p + 1]])
    return merged, [sorted(x) for x in found], np.bincount(w.doc[hit], minlength=n)


def _without(column: pa.Array, w, spans: list) -> pa.Array:
    """The texts without the words of the spans and what stands between those."""
    raw, at = utf8(column)
    texts = column.to_pylist()
    for d, own in enumerate(spans):
        if own:
            cuts = [int(at[d])]
            for a, b in own:
                cuts += [int(w.start[w.first[d] + a]), int(w.end[w.first[d] + b - 1])]
            cuts.append(int(at[d + 1]))
            texts[d] = b"".join(raw[a:b].tobytes() for a, b in zip(
                cuts[::2], cuts[1::2], strict=True)).decode()
    return pa.array(texts, pa.string())


def _matched(sent, names: list[str], schema: pa.Schema, cut: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = sent.value
        for part in parts(batches):
            w = words(part.column("text"))
            spans, items = (part.column(c).to_pylist() if c in part.schema.names
                            else [()] * part.num_rows for c in ("spans", "items"))
            spans, items, hits = _covered(part, w, phrases, spans, items)
            new = {"n_words": np.diff(w.first), "n_hit": hits, "items": items, "spans": spans}
            if cut:
                new["text"] = _without(part.column("text"), w, spans)
            yield pa.RecordBatch.from_arrays(
                [pa.array(new[c], schema.field(c).type) if c in new and c != "text"
                 else new.get(c, part.column(c) if c in part.schema.names else None)
                 for c in names], names)

    return run


def _blocks(benchmark: DataFrame) -> Iterator[tuple[Phrases, bool]]:
    """Phrases of the items, block by block, each of bounded size; is it the last?

    A block is built when it is asked for, so the driver holds one at a time: what
    is sent stands in files and in the block store, which goes to disk.
    """
    items = benchmark.select("item_id", "text").where(
        F.col("text").isNotNull() & F.col("item_id").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-size // (BLOCK_BYTES // 2)))
    for b in range(blocks):
        block = items if blocks == 1 else items.where(
            F.pmod(F.xxhash64("item_id", F.lit(8)), F.lit(blocks)) == b)
        rows = block.orderBy("item_id", "text").collect()
        yield Phrases([r.item_id for r in rows], [r.text for r in rows]), b == blocks - 1


_NEW = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType())))])


def match(docs: DataFrame, benchmark: DataFrame, *, cut: bool = False) -> DataFrame:
    """``docs`` with n_words, n_hit, items and spans (word numbers, end exclusive) for text.

    With ``cut`` the text stays, without the spans.  ``docs`` has ``text`` and
    none of the new columns, ``benchmark`` has ``item_id`` and ``text``.  Blocks
    of phrases follow one another in the same tasks; there is no shuffle.
    """
    spark = docs.sparkSession
    clash = {f.name for f in _NEW} & set(docs.columns)
    if clash:
        raise ValueError(f"columns of the result: {sorted(clash)}")
    found = bounded(docs)
    for phrases, last in _blocks(benchmark):
        fields = [f for f in docs.schema if f.name != "text" or cut or not last]
        schema = T.StructType(fields + list(_NEW))
        types = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()),
                           ("items", pa.list_(pa.string())),
                           ("spans", pa.list_(pa.list_(pa.int32())))])
        sent = spark.sparkContext.broadcast(phrases)
        found = found.mapInArrow(tidy(_matched(sent, schema.names, types, cut and last)), schema)
    return found


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The result of `match` with the number and the SHA-256 of the items found."""
    return match(docs.select("doc_id", "text"), benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))
