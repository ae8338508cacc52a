"""Spelling variants: words one edit apart, found by pivotal grams.

Words are counted over whole texts (each task counts before the shuffle).  Of a
word's bigrams, the three rarest among all words (of one gram, the first) are
its gram prefix.  Two disjoint grams of it are the pivots, chosen by dynamic
programming for least frequency.  One edit leaves one of two disjoint grams
whole, so of two words one edit apart, a pivot of the one whose prefix ends in
the rarer gram stands in the prefix of the other, shifted by one place at most.
Where both prefixes end in the same gram, the two new grams of an edit may move
it behind the third place, so prefixes are looked up with two more of that gram.
The pivots of each word are looked up among the grams of the others' prefixes.

Position limits are part of the key.  The edit lies to one side of the gram, so
all up to the gram's end, or all from its begin, is equal in both words; the
edit's side, cut in the middle, is equal in one half more.  Both equal parts
stand in the key, so a key joins few words that are not near.  Candidates are
verified by edit distance.  Forms are followed to roots by pointer jumping.

Gram frequencies are the one broadcast: the alphabet has 90 letters, so there
are at most 8,100 grams, whatever the corpus.

Defined results: null and empty texts have no words; a null ``doc_id`` is
written as nothing where a word is hashed; a run of one letter that loses it is
no word; repeated rows count as often as they stand; equal counts go to the word
that is smaller in code-point order; an empty table has no words.  Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, written

#: A word's letters, and its least length and count.
LETTERS = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Letters of a gram, and edits between near words.
Q, EDITS = 2, 1

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def runs(docs: DataFrame) -> DataFrame:
    """doc_id and every maximal run of letters in its text, A-Z lower-cased."""
    lower = F.translate("text", _UPPER, _UPPER.lower())
    return docs.select("doc_id", F.explode(F.regexp_extract_all(
        lower, F.lit(LETTERS), F.lit(0))).alias("run"))


def misspelt(found: DataFrame, every: int = 97) -> DataFrame:
    """``word``: the run, or, for one in ``every`` by a checksum, the run without one letter."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    hashed = found.select("run", F.crc32(key.cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    return hashed.select(F.when(F.col("h") % every == 0, F.concat(
        F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run"))))
        .otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, *, least_length: int = LEAST_LENGTH,
            least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words that are long and frequent enough."""
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def prefix(word: str, rank: dict[str, int]) -> list[tuple[int, int]]:
    """(rank, place) of the word's rarest grams in order, Q * EDITS + 1 of them.

    Behind them come as many more of the last one's gram as an edit makes new
    grams.
    """
    grams = sorted((rank[word[i:i + Q]], i) for i in range(len(word) - Q + 1))
    own, more = grams[:Q * EDITS + 1], grams[Q * EDITS + 1:2 * Q * EDITS + 1]
    return own + [g for g in more if g[0] == own[-1][0]]


def pivots(grams: list[tuple[int, int]]) -> list[int]:
    """Places of EDITS + 1 disjoint grams of least total rank, by dynamic programming.

    ``best[t][j]``: the least total of t grams, disjoint, among the first j by
    place.  Rare grams have low ranks.  Of equal totals the earlier places win.
    """
    by_place = sorted((place, rank) for rank, place in grams)
    n = len(by_place)
    before = []  # how many grams end before this one begins
    for j, (place, _) in enumerate(by_place):
        k = j
        while k and by_place[k - 1][0] + Q > place:
            k -= 1
        before.append(k)
    none = (float("inf"), ())
    best = [(0, ())] * (n + 1)
    for _ in range(EDITS + 1):
        row = [none]
        for j, (place, rank) in enumerate(by_place):
            total, places = best[before[j]]
            row.append(min(row[-1], (total + rank, (*places, place))))
        best = row
    return list(best[n][1])


def _halves(word: str, place: int, sizes: range) -> Iterator[str]:
    """Keys of a gram of ``word``: one for each side the edit may be on, and each half of it.

    ``sizes`` are the lengths that the edited side may have in the word looked
    up; its middle, by which both words are cut, follows from that length.
    """
    n = len(word)
    head, tail = word[:place + Q], word[place:]
    for size in sizes:
        after = n - place - Q + size       # the edit is behind the gram
        if after >= 0:
            middle = after // 2
            yield f"{place}a{after}<{head}{word[place + Q:place + Q + middle]}"
            far = n - (after - middle)
            if far >= place + Q - EDITS:
                yield f"{place}a{after}>{head}|{word[max(far, place + Q):]}"
        before = place + size              # it is before the gram
        if before >= 0:
            middle, end = before // 2, n - place
            yield f"{end}b{before}<{tail}|{word[:min(middle, place)]}"
            yield f"{end}b{before}>{word[max(place - (before - middle), 0):place]}{tail}"


def _keys(sent):
    """Rows (key, word, n, last, pivot) of every word: of its pivots and of its prefix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = sent.value
        for batch in batches:
            out = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(),
                               strict=True):
                grams = prefix(word, rank)
                last = grams[-1][0]
                for place in pivots(grams[:Q * EDITS + 1]):
                    out += [(k, word, n, last, True) for k in _halves(word, place, range(1))]
                for _, place in grams:
                    out += [(k, word, n, last, False)
                            for k in _halves(word, place, range(-EDITS, EDITS + 1))]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (
                    pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_()), strict=True)],
                ["key", "word", "n", "last", "pivot"])

    return run


def ranks(words: DataFrame) -> dict[str, int]:
    """Rank of every gram among the distinct words, the rarest first.

    Read by the driver: at most 8,100 grams of 90 letters.
    """
    letters = F.filter(F.split("word", ""), lambda c: c != "")
    pairs = words.select(letters.alias("c")).select(F.explode(F.zip_with(
        F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1),
        lambda a, b: F.concat(a, b))).alias("gram"))
    rows = pairs.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r.gram: i for i, r in enumerate(sorted(rows, key=lambda r: (r.n, r.gram)))}


def near(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: both ways of every pair of words one edit apart."""
    sent = words.sparkSession.sparkContext.broadcast(ranks(words))
    keys = written(bounded(words).select("word", "n").mapInArrow(
        _keys(sent), "key string, word string, n long, last int, pivot boolean").withColumn(
        "key", F.xxhash64("key")), "grams")
    probes = keys.where("pivot").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"),
                                        F.col("last").alias("a_last"))
    index = keys.where(~F.col("pivot")).select("key", F.col("word").alias("b"), F.col("n").alias("b_n"),
                                               F.col("last").alias("b_last"))
    met = probes.join(index, "key").where(
        (F.col("a") != F.col("b")) & (F.col("a_last") <= F.col("b_last"))
        & (F.levenshtein("a", "b", EDITS) == EDITS))
    pairs = met.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
        F.when(F.col("a") < F.col("b"), F.col("a_n")).otherwise(F.col("b_n")).alias("a_n"),
        F.when(F.col("a") < F.col("b"), F.col("b_n")).otherwise(F.col("a_n")).alias("b_n")).distinct()
    return pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"),
                 F.col("b_n").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"),
                 F.col("a_n").alias("other_n")))).alias("p")).select("p.*")


def rooted(forms: DataFrame) -> DataFrame:
    """word, root of every row (word, form): forms followed to the last.

    Each round jumps from a word's target to the target's target, so rounds
    follow the logarithm of the longest chain.
    """
    links = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        target = links.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = written(links.join(target, "root", "left").select(
            "word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")),
            "roots")
        links = step.select("word", "root")
        if step.where("moved").isEmpty():
            return links


def variants(words: DataFrame, *, dominance: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row (word, n).

    A word's form is its near word of largest count if that is ``dominance``
    times its own at least; ``dominance`` is two or more, so chains end.
    """
    words = written(words.select("word", "n"), "vocabulary")
    best = near(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    judged = written(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.less") >= dominance * F.col("n"), F.struct(
            F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("best")),
        "judged").select("word", "n", "n_near", F.col("best.form").alias("form"),
                         F.col("best.form_n").alias("form_n"))
    roots = rooted(judged.where(F.col("form").isNotNull()))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
