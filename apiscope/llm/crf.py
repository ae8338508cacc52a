"""Language of whole texts, word by word: a linear-chain conditional random field.

Words are runs of letters, lower-cased.  A word's score for each language is a
sum of learned weights over its features: the word itself, its prefixes and
suffixes of 1 to 4 letters, its n-grams of 1 to 4 letters with marks at both
ends, and lexicon features (a language in whose training texts most occurrences
of the word stand).  Features are hashed into a table of fixed size.  Learned
transition weights tie neighbouring words, and forward-backward gives every
word's probability for each language within the whole text, so switches between
languages are followed.  A document's language is the one of the largest mean
probability, which is also the score.

Training takes a bounded sample of labelled rows, `PER_LANGUAGE` documents of
each language at most, chosen by a hash.  It starts with all words of a text
labelled by the text's language, without transitions; the words are then
labelled anew by that model, smoothed over neighbours, and the whole field is
trained on those sequences.

Defined results: ``und`` and score 0 if the text is null or has no letter, or if
no labelled document has a letter; ties go to the language first in order; a
null id is in no fold and not held out; equal texts get equal results.  Other
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, parts, tidy
from .words import mixed

#: Documents of each language that training reads at most, and hashed features.
PER_LANGUAGE = 160
FEATURES = 1 << 17
#: Distinct words whose scores a worker keeps.
KEPT_WORDS = 100_000

_WORD = re.compile(r"[^\W\d_]+")
_U = np.uint64


def words_of(text: str | None) -> list[str]:
    found = _WORD.findall((text or "").lower())
    # the pattern's class also holds numerals such as superscripts, which are no letters
    return found if all(map(str.isalpha, found)) else [w for w in found if any(
        map(str.isalpha, w))]


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of words, one after the other, and where each word's begin."""
    marked = [f"\x02{w}\x03" for w in words]
    letters = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"),
                            "<u4").astype(_U) + _U(1)
    size = np.array([len(w) for w in marked], np.int64)
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(letters)) - first[owner]
    left = size[owner] - place
    numbers, owners = [], []
    gram = np.zeros(len(letters), _U)
    step = np.zeros(len(letters) + 8, _U)
    step[:len(letters)] = letters
    for n in range(1, 5):
        gram = gram * _U(0x100000001B3) + step[n - 1:n - 1 + len(letters)]
        fits = left >= n
        numbers.append(mixed(gram[fits] + _U(n << 58)))
        owners.append(owner[fits])
        for side, at in ((5, first + 1), (6, first + size - 1 - n)):  # prefix, suffix
            whole = size - 2 >= n
            numbers.append(mixed(gram[at[whole]] + _U((n + 4 * side) << 56)))
            owners.append(np.flatnonzero(whole))
    total = np.zeros(len(words), _U)
    np.add.at(total, owner, mixed(letters + place.astype(_U) * _U(0x9E3779B97F4A7C15)))
    numbers.append(mixed(total))
    owners.append(np.arange(len(words)))
    known = [(i, lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    if known:
        at, language = np.array(known).T
        numbers.append(mixed(language.astype(_U) + _U(7 << 60)))
        owners.append(at)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    number = (np.concatenate(numbers)[order] % _U(FEATURES)).astype(np.int64)
    return number, np.searchsorted(owner[order], np.arange(len(words) + 1))


def laid_out(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences side by side: position by position, longest sequence first.

    Returns for each step its first row, the rows' places in the sequences put
    one after another, and the sequences by row of the first step.
    """
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max(initial=0))
    ends = np.searchsorted(-lengths[order], -np.arange(longest), side="left")  # still going on
    row = np.concatenate([[0], np.cumsum(ends)]).astype(np.int64)
    first = (np.cumsum(lengths) - lengths)[order]
    step = np.repeat(np.arange(longest), ends)
    lane = np.arange(row[-1]) - row[step]
    return row, first[lane] + step, order


def marginals(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray,
              pairs: bool = False):
    """Each word's probabilities within its sequence, by forward-backward.

    ``scores`` holds the words of all sequences, one sequence after the other.
    With ``pairs``, also the expected count of each transition.
    """
    n, k = scores.shape
    row, source, _ = laid_out(lengths)
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))[source]
    turn, begin = np.exp(move), np.exp(start)
    ahead, behind = np.empty_like(emit), np.empty_like(emit)
    steps = len(row) - 1
    for t in range(steps):
        a, b = row[t], row[t + 1]
        now = emit[a:b] * (begin if t == 0 else ahead[row[t - 1]:row[t - 1] + b - a] @ turn)
        now /= now.sum(axis=1, keepdims=True)
        ahead[a:b] = now
    both = np.zeros((k, k))
    for t in range(steps - 1, -1, -1):
        a, b = row[t], row[t + 1]
        now = behind[a:b]
        now[:] = 1.0
        if t + 1 < steps:
            c, d = row[t + 1], row[t + 2]
            later = emit[c:d] * behind[c:d]
            now[:d - c] = later @ turn.T
            if pairs:
                joint = ahead[a:a + d - c, :, None] * turn * later[:, None, :]
                both += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            now[:d - c] /= now[:d - c].sum(axis=1, keepdims=True)
    ahead *= behind
    ahead /= ahead.sum(axis=1, keepdims=True)
    out = np.empty((n, k))
    out[source] = ahead
    return (out, both) if pairs else out


def scores_of(words: list[str], lexicon: dict[str, int], weights: np.ndarray) -> np.ndarray:
    number, first = features(words, lexicon)
    # every word has at least one feature
    return np.add.reduceat(weights[number], first[:-1], axis=0) if words else np.empty(
        (0, weights.shape[1]))


def train(texts: list[str], langs: list[str], *, epochs: int = 4, rate: float = 0.3,
          batch: int = 16) -> dict | None:
    """Weights of the field, or None if no text has a letter."""
    names = sorted(set(langs))
    rows = [(words_of(t), names.index(g)) for t, g in zip(texts, langs, strict=True)]
    rows = [r for r in rows if r[0]]
    if not rows:
        return None
    k = len(names)
    counts: dict[str, Counter] = {}
    for words, label in rows:
        for w in words:
            counts.setdefault(w, Counter())[label] += 1
    lexicon = {}
    for w, c in counts.items():
        label, most = min(c.items(), key=lambda x: (-x[1], x[0]))
        if most >= 3 and most >= 0.7 * sum(c.values()):
            lexicon[w] = label
    distinct = list(counts)
    index = {w: i for i, w in enumerate(distinct)}
    number, first = features(distinct, lexicon)
    weights, squares = np.zeros((FEATURES, k)), np.full((FEATURES, k), 1e-6)
    move, move2 = np.zeros((k, k)), np.full((k, k), 1e-6)
    start, start2 = np.zeros(k), np.full(k, 1e-6)
    data = [(np.array([index[w] for w in words]), label) for words, label in rows]
    rng = np.random.default_rng(2)

    def word_scores(used: np.ndarray):
        """Scores of the words ``used`` and their features, one after the other."""
        size = first[used + 1] - first[used]
        at = np.repeat(first[used] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.add.reduceat(weights[number[at]], np.cumsum(size) - size, axis=0), at, size

    def learn(labels: list[np.ndarray], chained: bool) -> None:
        order = rng.permutation(len(data))
        for at in range(0, len(order), batch):
            chosen = order[at:at + batch]
            ids = np.concatenate([data[i][0] for i in chosen])
            label = np.concatenate([labels[i] for i in chosen])
            lengths = np.array([len(data[i][0]) for i in chosen])
            used, back = np.unique(ids, return_inverse=True)
            scores, where, size = word_scores(used)
            right = np.eye(k)[label]
            if chained:
                prob, both = marginals(scores[back], lengths, start, move, pairs=True)
                heads = np.cumsum(lengths) - lengths
                inner = np.ones(len(ids), bool)
                inner[heads] = False
                seen = np.zeros((k, k))
                np.add.at(seen, (label[np.flatnonzero(inner) - 1], label[inner]), 1)
                for value, square, gradient in (
                        (move, move2, (seen - both) / len(ids)),
                        (start, start2, (right[heads] - prob[heads]).mean(axis=0))):
                    square += gradient * gradient
                    value += rate * gradient / np.sqrt(square)
            else:
                exp = np.exp(scores - scores.max(axis=1, keepdims=True))
                prob = (exp / exp.sum(axis=1, keepdims=True))[back]
            gap = right - prob
            for j in range(k):
                own = np.bincount(back, gap[:, j], minlength=len(used))
                gradient = np.bincount(number[where], np.repeat(own, size),
                                       minlength=FEATURES) / len(ids)
                touched = np.flatnonzero(gradient)
                squares[touched, j] += gradient[touched] ** 2
                weights[touched, j] += rate * 0.2 * gradient[touched] / np.sqrt(
                    squares[touched, j])

    labels = [np.full(len(ids), label) for ids, label in data]
    for _ in range(2):
        learn(labels, False)
    relabelled = []
    for ids, label in data:
        scores, *_ = word_scores(ids)
        scores = scores - scores.max(axis=1, keepdims=True)
        scores[:, label] += 1.0
        reach = np.cumsum(np.vstack([np.zeros((1, k)), scores]), axis=0)
        low = np.maximum(np.arange(len(ids)) - 3, 0)
        high = np.minimum(np.arange(len(ids)) + 4, len(ids))
        relabelled.append((reach[high] - reach[low]).argmax(axis=1))
    for _ in range(epochs - 2):
        learn(relabelled, True)
    return {"names": names, "lexicon": lexicon, "weights": weights.astype(np.float32),
            "start": start, "move": move}


class Labeller:
    """A trained field with the scores of words met so far."""

    def __init__(self, model: dict):
        self.model = model
        self.known: dict[str, int] = {}
        self.scores = np.empty((0, len(model["names"])))

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        found = [words_of(t) for t in texts]
        new = set().union(*found).difference(self.known) if found else set()
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known, self.scores = {}, self.scores[:0]
            new = set().union(*found)
        fresh = sorted(new)
        base = len(self.known)
        self.known.update(zip(fresh, range(base, base + len(fresh)), strict=True))
        self.scores = np.concatenate([self.scores, scores_of(
            fresh, self.model["lexicon"], self.model["weights"])])
        lengths = np.array([len(f) for f in found])
        names = ["und"] * len(texts)
        score = [0.0] * len(texts)
        some = np.flatnonzero(lengths)
        if len(some):
            get = self.known.__getitem__
            ids = np.fromiter((i for f in found for i in map(get, f)), np.int64, lengths.sum())
            prob = marginals(self.scores[ids], lengths[some], self.model["start"],
                             self.model["move"])
            heads = np.cumsum(lengths[some]) - lengths[some]
            mean = np.add.reduceat(prob, heads, axis=0) / lengths[some, None]
            for i, m in zip(some.tolist(), mean, strict=True):
                best = int(m.argmax())
                names[i], score[i] = self.model["names"][best], float(min(max(m[best], 0.0), 1.0))
        return names, score


_labellers: dict[int, Labeller] = {}


def _labelled(sent, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = sent.value["key"]
        if key not in _labellers:
            _labellers.clear()
            _labellers[key] = Labeller(sent.value)
        labeller = _labellers[key]
        for part in parts(batches):
            found, score = labeller.label(part.column("text").to_pylist())
            new = {"lang_pred": pa.array(found, pa.string()), "score": pa.array(score, pa.float64())}
            yield pa.RecordBatch.from_arrays(
                [new[c] if c in new else part.column(c) for c in names], names)

    return run


def sample(docs: DataFrame, learnable: Column, *, per_language: int = PER_LANGUAGE) -> DataFrame:
    """text and lang of at most ``per_language`` documents of each language.

    Ids are hashed into that many cells of each language, and a cell keeps its
    smallest; only the chosen rows' texts are read.
    """
    ids = docs.where(learnable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    hashed = F.xxhash64("doc_id", F.lit(17))
    cells = ids.groupBy("lang", F.pmod(hashed, F.lit(per_language)).alias("cell")).agg(
        F.min("doc_id").alias("chosen"))
    # as many rows as cells: PER_LANGUAGE for each language
    chosen = cells.select("chosen", F.col("lang").alias("of"))
    return ids.join(F.broadcast(chosen), (F.col("doc_id") == F.col("chosen"))
                    & (F.col("lang") == F.col("of"))).dropDuplicates(
        ["doc_id", "lang"]).select("text", "lang")


def held_out() -> Column:
    """One document in five, by a checksum of its id; a null id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, *, per_language: int = PER_LANGUAGE) -> dict | None:
    """The field learned from documents that are not held out (doc_id, text, lang)."""
    rows = sample(docs.select("doc_id", "text", "lang"), ~held_out() & F.col("text").isNotNull(),
                  per_language=per_language).orderBy("lang", "text").collect()
    model = train([r.text for r in rows], [r.lang for r in rows])
    if model is not None:
        model["key"] = hash((tuple(model["names"]), float(model["weights"].sum()), len(rows)))
    return model


def label(docs: DataFrame, model: dict | None, *, keep_text: bool = False) -> DataFrame:
    """``docs`` (text and any but the new columns) with lang_pred and score."""
    fields = [f for f in docs.schema if keep_text or f.name != "text"]
    if model is None:
        return docs.select(*[f.name for f in fields], F.lit("und").alias("lang_pred"),
                           F.lit(0.0).alias("score"))
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return bounded(docs).mapInArrow(tidy(_labelled(sent, schema.names)), schema)


def identify(docs: DataFrame, *, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    ``docs`` has ``doc_id``, ``text`` and ``lang``; held-out documents are not
    learned from.
    """
    return label(docs.select("doc_id", held_out().alias("held_out"), "text"),
                 fit(docs, per_language=per_language))
