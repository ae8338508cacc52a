"""Near-duplicate documents by ProbMinHash, banding and verification.

A document is the multiset of its runs of five words (one run of all words if
there are fewer), weighted by count.  Each shingle's points arrive as a Poisson
process at the rate of its weight, each point falling to one of M components;
a component keeps its earliest point, and a shingle stops once its next point
is later than all of them.  Two signatures agree in a component with the
probability Jaccard similarity of the documents.  Equal bands of components make
candidates, and candidates are verified on the exact multisets.

Texts of equal words are one node, so copies cost nothing beyond their
fingerprint.  A node is named by the hash of its least row (id and text), so
neither ids that stand over several texts nor missing ones mix texts up.  No bucket is expanded into pairs, and
buckets of the same members are one.  At first each text is compared with one other,
the member that is the least of most of its buckets; a bucket whose members are then of one
class is done.  In any other, members that are not of the class of its least member
are compared with that.  Where classes are still left, the members outside the
largest are compared with all, in blocks of bounded size; each block verifies its pairs and returns
links between classes, not texts, and those to the largest class where it can, so
what the blocks of a large group return is the same few links.  Classes are the
connected components of verified links.

Defined results: a document without words (null, empty) is a class of its own;
the class id is the least document id in the class, null if it has none; rows
that share an id are documents of their own, each of the class of its text; two
rows of equal id and text are one; an empty table has no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, narrow, parts, tidy, written
from .components import components
from .words import Words, mixed, words

SHINGLE, THRESHOLD = 5, 0.8
#: A sum of fractions that falls short of the threshold by less has reached it.
ROUNDING = 1e-9
#: Bands and components of each: a pair at the threshold is missed in one case of 14,000.
BANDS, ROWS = 24, 5
M = BANDS * ROWS
#: Four standard errors of a similarity of 0.8 estimated from M components.
SLACK = 0.15
#: Bits of the filter that keeps texts of no pair from being shuffled: 16 MB at most.
FILTER_BITS = 1 << 27
#: Members of a block that is compared with another.
BLOCK = 256

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of every text's distinct shingles, by text and shingle."""
    per_doc = np.diff(w.first)
    runs = np.where(per_doc == 0, 0, np.maximum(per_doc - SHINGLE + 1, 1))
    doc = np.repeat(np.arange(len(per_doc)), runs)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs) + w.first[:-1][doc]
    padded = np.concatenate([w.hash, np.zeros(SHINGLE, _U)])
    value = np.zeros(len(at), _U)
    size = np.minimum(per_doc, SHINGLE)[doc]
    for j in range(SHINGLE):
        value = value * _U(0xD1342543DE82EF95) + np.where(j < size, padded[at + j], _U(j + 1))
    value = mixed(value)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(doc)))
    return doc[first], value[first], count


def signatures(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, docs: int) -> np.ndarray:
    """ProbMinHash signature of each text: M shingles (0 throughout without any)."""
    earliest = np.full(docs * M, np.inf)
    chosen = np.zeros(docs * M, _U)
    has = np.zeros(docs, bool)
    has[doc] = True
    active, time, step = np.arange(len(doc)), np.zeros(len(doc)), 0
    while len(active):
        # the next points of each active shingle, more at a time as fewer are active
        n = max(1, min(256, 100_000 // len(active)))
        key = mixed(value[active][:, None] + _GOLD * np.arange(step + 1, step + n + 1, dtype=_U))
        wait = -np.log((key >> _U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)
        point = time[:, None] + np.cumsum(wait / weight[active][:, None], axis=1)
        slot = (doc[active] * M)[:, None] + (mixed(key ^ _GOLD) % _U(M)).astype(np.int64)
        flat, where = point.ravel(), slot.ravel()
        np.minimum.at(earliest, where, flat)
        won = np.flatnonzero(flat == earliest[where])
        chosen[where[won]] = value[active][won // n]
        time, step = point[:, -1], step + n
        latest = earliest.reshape(docs, M).max(axis=1)
        on = time < latest[doc[active]]
        active, time = active[on], time[on]
    return np.where(has[:, None], chosen.reshape(docs, M), _U(0))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two multisets (sorted shingles, counts).

    The sum over shared d of 1 / sum over e of max(a_e/a_d, b_e/b_d).  With the
    shingles in order of a/b, e counts with a from d's place on and with b
    before it, so two running sums give all terms.
    """
    every = np.union1d(a[0], b[0])
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])] = a[1]
    y[np.searchsorted(every, b[0])] = b[1]
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y = x[order], y[order]
    from_here = np.cumsum(x[::-1])[::-1]
    before = np.cumsum(y) - y
    shared = (x > 0) & (y > 0)
    x, y = x[shared], y[shared]
    return float(np.sum(1 / (from_here[shared] / x + before[shared] / y)))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts(batches):
        n = part.num_rows
        w = words(part.column("text"))
        doc, value, count = shingles(w)
        sig = signatures(doc, value, count.astype(np.float64), n)
        place = (np.arange(len(w.hash)) - w.first[:-1][w.doc]).astype(_U)
        prints = []
        for salt in (1, 2):
            total = np.zeros(n, _U)
            np.add.at(total, w.doc, mixed(w.hash + mixed(place * _GOLD + _U(salt))))
            prints.append(total.view(np.int64))
        bands = np.zeros((n, BANDS), _U)
        grid = sig.reshape(n, BANDS, ROWS)
        for r in range(ROWS):
            bands = mixed(bands * _U(0xD1342543DE82EF95) + grid[:, :, r])
        bands = mixed(bands + _GOLD * np.arange(1, BANDS + 1, dtype=_U)).view(np.int64)
        short = (sig >> _U(48)).astype("<u2")
        yield pa.RecordBatch.from_arrays([
            part.column("doc_id"), part.column("own"), pa.array(np.diff(w.first), pa.int64()),
            pa.array(prints[0], pa.int64()), pa.array(prints[1], pa.int64()),
            pa.array(list(bands), pa.list_(pa.int64())),
            pa.array([r.tobytes() for r in short], pa.binary())],
            ["doc_id", "own", "n_words", "print1", "print2", "bands", "sig"])


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Similarity of two signatures a row, from the share of equal components."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, M)
                for c in ("sig_a", "sig_b"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"),
             pa.array((a == b).mean(axis=1) if len(a) else [], pa.float64())],
            ["a", "b", "estimate"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            sides = []
            for c in ("text_a", "text_b"):
                doc, value, count = shingles(words(part.column(c)))
                edge = np.searchsorted(doc, np.arange(part.num_rows + 1))
                sides.append([(value[x:y], count[x:y]) for x, y in zip(
                    edge[:-1], edge[1:], strict=True)])
            found = [similarity(x, y) if len(x[0]) and len(y[0]) else 0.0
                     for x, y in zip(*sides, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("a"), part.column("b"), pa.array(found, pa.float64())],
                ["a", "b", "similarity"])


def alike(i: int, doc: np.ndarray, number: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Probability Jaccard similarity of text ``i`` with each of ``n`` texts at once.

    The texts' shingles have numbers and weights.  Of the sum's terms, those of
    shingles with the same ratio r of both weights have the same denominator,
    own total + sum over the other text of max(weight / r - own weight, 0).
    """
    own = np.flatnonzero(doc == i)
    mine = np.zeros(int(number.max(initial=-1)) + 1)
    mine[number[own]] = weight[own]
    total = mine.sum()
    mine = mine[number]
    shared = np.flatnonzero(mine)
    ratio = weight[shared] / mine[shared]
    found = np.zeros(n)
    for r in np.unique(ratio):
        at = shared[ratio == r]
        rest = np.bincount(doc, np.maximum(weight / r - mine, 0), minlength=n)
        found += np.bincount(doc[at], mine[at], minlength=n) / np.maximum(total + rest, 1e-300)
    return found


def _links_of(label: np.ndarray, far: np.ndarray, asking: np.ndarray,
              texts: list[str]) -> list[tuple[int, int]]:
    """Verified links between the classes of one block's members.

    ``label`` is a member's class; those that are not far are of the bucket's
    largest.  An asking member is compared with all of other classes, unless it
    has come to the largest by then: whoever is not of that asks for itself.  Each
    class found is a star around the largest class, or else its least.
    """
    doc, value, count = shingles(words(pa.array(texts, pa.string())))
    number = np.unique(value, return_inverse=True)[1]
    weight = count.astype(np.float64)
    root = np.unique(label, return_inverse=True)[1]
    near = np.flatnonzero(~far)[:1]
    for i in np.flatnonzero(asking):
        if (root[near] == root[i]).any():
            continue
        other = root != root[i]
        if not other.any():
            break
        other[i] = True
        at = other[doc]
        similar = alike(i, doc[at], number[at], weight[at], len(label)) >= THRESHOLD - ROUNDING
        root[np.isin(root, root[similar & other])] = root[i]
    found = []
    for r in np.unique(root):
        united = np.unique(label[root == r])
        centre = label[near][0] if (root[near] == r).any() else united[0]
        found += [(min(int(centre), int(x)), max(int(centre), int(x))) for x in united if x != centre]
    return found


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each block; rows come sorted by block, and a block fits in memory."""
    held: list[tuple] = []
    current = None

    def links():
        if not any(h[3] for h in held):
            return []
        return _links_of(np.array([h[1] for h in held], np.int64), np.array([h[2] for h in held]),
                         np.array([h[3] for h in held]), [h[4] for h in held])

    def batch_of(found):
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        found = []
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            for row in zip(*(part.column(c).to_pylist()
                             for c in ("block", "label", "far", "asking", "text")),
                           strict=True):
                if row[0] != current:
                    found += links()
                    held.clear()
                    current = row[0]
                held.append(row)
        yield batch_of(found)
    yield batch_of(links())


def _filtered(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """Texts (node, text) whose node may be in ``needed`` (node); few others pass.

    A bitmap of hashed nodes, of bounded size, is broadcast, so that a text is
    looked at where it is read and only those of pairs are shuffled.
    """
    def place(node: str):
        return F.pmod(F.xxhash64(node, F.lit(11)), F.lit(FILTER_BITS)) + 1

    bits = needed.select(place("node").alias("p")).groupBy(
        F.bitmap_bucket_number("p").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    at = F.bitmap_bit_position("p")
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10)
    return texts.withColumn("p", place("node")).withColumn(
        "bucket", F.bitmap_bucket_number("p")).join(F.broadcast(bits), "bucket").where(
        F.getbit(byte.cast("int"), (at % 8).cast("int")) == 1).select("node", "text")


def _once(texts: DataFrame) -> DataFrame:
    """One of the rows of a node; those of equal id and text are reduced in every task first."""
    return texts.dropDuplicates(["node"])


def _texts_of(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, text) of the nodes (node)."""
    # a merge join at every size: what is shuffled follows the input
    return written(_once(_filtered(texts, nodes)).join(nodes.hint("merge"), "node"), "texts")


def _similarities(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs (a, b), from the texts (node, text)."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a") \
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return written(both.select("a", "b", "text_a", "text_b").mapInArrow(
        tidy(_verified), "a long, b long, similarity double"), "similarities")


def _estimates(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    both = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a") \
        .join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
    return narrow(both.select("a", "b", "sig_a", "sig_b").mapInArrow(
        tidy(_estimated), "a long, b long, estimate double"), "estimates")


def _links(pairs: DataFrame, sigs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar, once each."""
    likely = _estimates(pairs.distinct(), sigs).where(F.col("estimate") >= THRESHOLD - SLACK)
    return _similarities(likely.select("a", "b"), texts).where(
        F.col("similarity") >= THRESHOLD - ROUNDING).select("a", "b")


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` and the class (label) that the links put each node into."""
    return narrow(members.join(components(links), "node", "left").withColumn(
        "label", F.coalesce("label", "node")), "labelled")


def _blocks(members: DataFrame) -> DataFrame:
    """(block, node, label, far, asking): what is left to compare in buckets of several classes.

    ``members`` has key, node and label.
    """
    by_class = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = F.max(F.struct("n", "label"))
    mixed_keys = narrow(by_class.groupBy("key").agg(
        largest["label"].alias("main"), F.sum("n").alias("n"),
        (F.sum("n") - largest["n"]).alias("n_far")).where("n_far > 0"), "mixed")
    # members of other classes than the largest are spread over one set of blocks, all over another
    salt = F.xxhash64("node", F.lit(5))
    size_far, size_all = (F.ceil(F.col(n) / BLOCK).cast("int") for n in ("n_far", "n"))
    rest = members.join(mixed_keys, "key").select(
        "key", "node", "label", (F.col("label") != F.col("main")).alias("far"),
        F.pmod(salt, size_far).alias("own_far"), F.pmod(salt, size_all).alias("own_all"),
        F.sequence(F.lit(0), size_far - 1).alias("all_far"),
        F.sequence(F.lit(0), size_all - 1).alias("all"))
    asks = rest.where("far").select(
        "key", "node", "label", "far", F.lit(True).alias("asking"),
        F.col("own_far").cast("int").alias("i"), F.explode("all").alias("j"))
    # where it asks, a member stands already
    asked = rest.select(
        "key", "node", "label", "far", F.lit(False).alias("asking"),
        F.explode(F.filter("all_far", lambda i: ~F.col("far") | (i != F.col("own_far")))).alias("i"),
        F.col("own_all").cast("int").alias("j"))
    return narrow(asks.unionAll(asked).select(
        F.xxhash64("key", "i", "j").alias("block"), "node", "label", "far", "asking"), "blocks")


def own_key():
    """What tells the rows of a table apart: a hash of id and text."""
    return F.xxhash64("doc_id", "text")


def members(docs: DataFrame) -> DataFrame:
    """doc_id, own, label, class_id of every document (doc_id, text).

    ``own`` is the row's `own_key`, ``label`` that of one row of its class.
    """
    signed = written(bounded(docs.select("doc_id", "text", own_key().alias("own"))).mapInArrow(
        tidy(_signed), "doc_id long, own long, n_words long, print1 long, print2 long, bands array<long>, "
                 "sig binary"), "signatures")
    worded = signed.where(F.col("n_words") > 0)
    prints = ["print1", "print2"]
    # one node a text: its least row; the copies are reduced in every task before the shuffle
    groups = narrow(worded.groupBy(*prints).agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("unnamed"), "doc_id", "own")).alias("least")).select(
        *prints, F.col("least.own").alias("node"), F.col("least.doc_id").alias("least")), "groups")
    nodes = written(worded.join(groups.select("node"), F.col("own") == F.col("node")).select(
        "node", "bands", "sig").dropDuplicates(["node"]), "nodes")
    rows = nodes.select("node", F.explode("bands").alias("key"))
    hubs = rows.groupBy("key").agg(
        F.min("node").alias("hub"), F.count(F.lit(1)).alias("n"),
        *[F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"set{k}") for k in (1, 2)]).where("n > 1")
    hubs = hubs.groupBy("hub", "n", "set1", "set2").agg(
        F.min("key").alias("key"), F.count(F.lit(1)).alias("same"))
    # the hub of most of a node's buckets is the likeliest to be similar; of several, the least
    of_node = Window.partitionBy("node")
    times = F.sum("same").over(of_node.orderBy("hub").rangeBetween(0, 0))
    best = F.max(F.when(F.col("node") != F.col("hub"), F.struct(
        "times", F.bitwise_not("hub").alias("hub")))).over(of_node)
    members = narrow(rows.join(narrow(hubs.select("key", "hub", "same"), "hubs"), "key").withColumn(
        "times", times).select("key", "node", "hub", F.bitwise_not(best["hub"]).alias("first")), "members")
    texts = _texts_of(narrow(members.select("node").distinct(), "shared"), docs.select(
        own_key().alias("node"), "text").where(F.col("text").isNotNull()))
    sigs = nodes.select("node", "sig")
    links = _links(members.where(F.col("node") != F.col("hub")).select(
        F.col("first").alias("a"), F.col("node").alias("b")), sigs, texts)
    # only buckets of several classes have more to tell
    known = _labelled(members, links)
    apart = known.join(known.where(F.col("node") == F.col("hub")).select(
        "key", F.col("label").alias("of_hub")), "key").where(
        (F.col("label") != F.col("of_hub")) & (F.col("first") != F.col("hub")))
    links = links.unionAll(_links(apart.select(
        F.col("hub").alias("a"), F.col("node").alias("b")), sigs, texts))
    # what is not of the class of its bucket's least member is not similar to that
    known = _labelled(members, links).where(F.col("node") != F.col("hub"))
    more = _blocks(known).join(texts, "node").repartition("block").sortWithinPartitions(
        "block").mapInArrow(tidy(_united), "a long, b long")
    labels = components(links.unionAll(written(more, "more-links")))
    linked = written(groups.select("node", "least").join(labels, "node"), "linked")
    names = linked.groupBy("label").agg(F.min("least").alias("name"))
    linked = linked.join(names, "label").select("node", "label", "name")
    named = written(groups.join(linked, "node", "left").select(
        *prints, F.coalesce("label", "node").alias("label"),
        F.when(F.col("label").isNotNull(), F.col("name")).otherwise(F.col("least")).alias("class_id")),
        "classes")
    has_words = F.col("n_words") > 0
    return signed.select("doc_id", "own", *prints, "n_words").join(named, prints, "left").select(
        "doc_id", "own", F.when(has_words, F.col("label")).otherwise(F.col("own")).alias("label"),
        F.when(has_words, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id of every document (doc_id, text)."""
    return members(docs).select("doc_id", "class_id")
