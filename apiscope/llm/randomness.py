"""Secrets: strings that look random, beside those of known forms.

Known forms are found by pattern: assignments to names of secrets, access keys,
long runs of hexadecimal digits.  Further candidates are the runs of at least
`LEAST` characters of encoded data that no known form overlaps.  A candidate's
encoding is the smallest alphabet that holds all its characters.  Three
statistics tell how random it is over that alphabet: Pearson's chi-squared
against uniform letters, the number of runs of one class (small letters,
capitals, digits, signs), and the serial correlation of neighbours.

The battery is read twice.  Against random strings: a candidate that one of the
tests rejects is not random.  Against the corpus's ordinary text, whose letters
and neighbours are counted over all documents: a candidate gets a p-value for
being ordinary text that only looks random.  Moments of all three statistics
follow from its length, so a short candidate is weak evidence; the three normal
scores are averaged, which holds however they depend on each other.  In each
class of encoding and length (half octaves), the false-discovery rate is held by
the procedure of Benjamini and Hochberg over all candidates of the corpus: their
p-values are counted in bins, each taken at its upper end.

Defined results: null and empty texts have no spans; runs of digits only, of
letters of one case only, and runs that mix both sign pairs of base 64 are no
candidates for a find; repeated rows give equal rows; spans of one start go by
kind as listed; an empty table has no rows.  Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, parts, written
from .words import utf8

#: The known forms, in order of their kinds.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("(?<![0-9a-f])[0-9a-f]{24,}")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Characters of a candidate, at least this many; and what a test must not fall below.
CANDIDATE, LEAST, REJECTED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"), 20, 1e-3
#: False-discovery rate, and bins of p-values to a power of ten.
LEVEL, BINS, LAST_BIN = 0.01, 20, 400

_LOWER, _CAPITALS, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets in order of size; a sign of the last may be written in either way.
ALPHABETS = {
    "hex": _DIGITS + "abcdef", "HEX": _DIGITS + "ABCDEF", "base32": _CAPITALS + "234567",
    "base36": _DIGITS + _LOWER, "BASE36": _DIGITS + _CAPITALS,
    "base64": _CAPITALS + _LOWER + _DIGITS + "+/"}
_SETS = {name: set(letters) for name, letters in ALPHABETS.items()}
_VALUE = {name: {c: i for i, c in enumerate(letters)} for name, letters in ALPHABETS.items()}


def _class(c: str) -> int:
    return 1 if c in _LOWER else 2 if c in _CAPITALS else 3 if c in _DIGITS else 4


class Statistics(NamedTuple):
    n: int
    chi: float     # Pearson's sum against uniform letters
    changes: int   # neighbours of different class
    serial: float  # mean product of neighbours, in deviations from the alphabet's mean


def encoding_of(token: str) -> str | None:
    """The smallest alphabet that holds the token (without padding), None for digits only."""
    used = set(token.rstrip("="))
    if used & set("-_"):
        if used & set("+/"):
            return None
        used = (used - set("-_")) | {"+"}
    if used <= set(_DIGITS):
        return None
    return next((name for name, letters in _SETS.items() if used <= letters), None)


def statistics(token: str, encoding: str) -> Statistics:
    value = _VALUE[encoding]
    letters = token.rstrip("=").replace("-", "+").replace("_", "/")
    n, k = len(letters), len(value)
    at = np.array([value[c] for c in letters])
    kind = np.array([_class(c) for c in letters])
    x = (at - (k - 1) / 2) / math.sqrt((k * k - 1) / 12)
    return Statistics(n, float(k / n * np.square(np.bincount(at)).sum() - n),
                      int((kind[1:] != kind[:-1]).sum()), float((x[1:] * x[:-1]).mean()))


class Ordinary(NamedTuple):
    """Neighbouring letters of one alphabet, in ordinary text or at random."""
    k: int
    squares: float   # sum of squared letter shares
    cubes: float
    change: float    # share of neighbours of different class
    joint: float     # share of two changes in a row, if letters are independent
    serial: float    # mean and deviation of neighbours' products
    spread: float


def described(encoding: str, pairs: np.ndarray) -> Ordinary:
    """From the counts of neighbours, a matrix over the alphabet's letters."""
    k = len(pairs)
    share = pairs.sum(axis=1) / pairs.sum()
    kind = np.array([_class(c) for c in ALPHABETS[encoding]])
    weight = pairs / pairs.sum()
    x = (np.arange(k) - (k - 1) / 2) / math.sqrt((k * k - 1) / 12)
    product = np.outer(x, x)
    serial = float((weight * product).sum())
    of_class = np.array([share[kind == c].sum() for c in (1, 2, 3, 4)])
    return Ordinary(k, float(np.square(share).sum()), float((share**3).sum()),
                    float(weight[kind[:, None] != kind[None, :]].sum()),
                    float((of_class * np.square(1 - of_class)).sum()), serial,
                    float(math.sqrt(max((weight * np.square(product)).sum() - serial**2, 1e-9))))


def models(pairs: np.ndarray) -> dict[str, tuple[Ordinary, Ordinary]]:
    """(ordinary text, random) of every alphabet, from a 128 x 128 matrix of neighbours.

    An alphabet of one case takes letters of either case for its own: prose
    has few capitals, and those of keys are no ordinary text.  One of each pair
    is added to the counts, so an alphabet that the corpus does not use is taken
    for random, and nothing is found in it.
    """
    small = [ord(chr(c).lower()) for c in range(128)]
    folded = np.zeros((128, 128))
    np.add.at(folded, (np.repeat(small, 128), np.tile(small, 128)), pairs.ravel())
    out = {}
    for name, letters in ALPHABETS.items():
        counts = pairs if name == "base64" else folded
        at = [ord(c if name == "base64" else c.lower()) for c in letters]
        own = counts[np.ix_(at, at)].astype(float) + 1
        out[name] = described(name, own), described(name, np.ones_like(own))
    return out


def _above(z: float) -> float:
    """Share of a normal distribution above ``z``."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def _scores(s: Statistics, m: Ordinary) -> tuple[float, float, float]:
    """Normal scores of the three statistics under a model's moments."""
    n, k = s.n, m.k
    mean = k * (1 - m.squares) + n * (k * m.squares - 1)
    variance = (k / n)**2 * 2 * n * (n - 1) * (
        m.squares + 2 * (n - 2) * m.cubes - (2 * n - 3) * m.squares**2)
    changes = (n - 1) * m.change * (1 - m.change) + 2 * (n - 2) * max(m.joint - m.change**2, 0)
    return ((s.chi - mean) / math.sqrt(max(variance, 1e-9)),
            (s.changes - (n - 1) * m.change) / math.sqrt(max(changes, 1e-9)),
            (s.serial - m.serial) / (m.spread / math.sqrt(n - 1)))


def judged(s: Statistics, ordinary: Ordinary, uniform: Ordinary) -> tuple[float, bool]:
    """(p-value of ordinary text, whether no test rejects a random string)."""
    chi, changes, serial = _scores(s, uniform)
    random = (_above(chi) >= REJECTED and 2 * _above(abs(changes)) >= REJECTED
              and 2 * _above(abs(serial)) >= REJECTED)
    chi, changes, serial = _scores(s, ordinary)
    # random strings lie below ordinary text in chi-squared, above it in changes,
    # and on that side in serial correlation where it is nil
    toward = -1 if ordinary.serial > 0 else 1
    scores = [max(-8.0, min(8.0, z)) for z in (-chi, changes, toward * serial)]
    return _above(sum(scores) / 3), random


def _bin(p: float) -> int:
    return min(LAST_BIN, int(-BINS * math.log10(max(p, 1e-300))))


def _length_class(n: int) -> int:
    return int(2 * math.log2(n))


def first_bins(counts: dict[tuple[str, int, int], int], level: float) -> dict[str, int]:
    """The first bin that is found of each class, by Benjamini and Hochberg.

    ``counts``: candidates by (encoding, length class, bin).
    """
    by_class: dict[tuple[str, int], dict[int, int]] = {}
    for (encoding, length, b), n in counts.items():
        by_class.setdefault((encoding, length), {})[b] = n
    out = {}
    for (encoding, length), bins in by_class.items():
        total, above = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            above += bins[b]
            if total * 10**(-b / BINS) <= level * above:
                out[f"{encoding}:{length}"] = b
    return out


def known(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the known forms in a text."""
    found = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found


def _long_runs(raw: np.ndarray, at: np.ndarray, inside: np.ndarray, least: int) -> np.ndarray:
    """Numbers of the texts that hold ``least`` bytes in a row of a set (a table of 256)."""
    mask = inside[raw]
    edge = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    long = (end - start) >= least  # runs over a text's end are tested again by pattern
    first = np.searchsorted(at, start[long], "right") - 1
    last = np.searchsorted(at, end[long] - 1, "right") - 1
    return np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)]
                                    or [np.empty(0, np.int64)]))


def _table(letters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in letters]] = True
    return out


_HEX_BYTES = _table(_DIGITS + "abcdef")
_TOKEN_BYTES = _table(_CAPITALS + _LOWER + _DIGITS + "+/_-")

_SPAN = "struct<start:int,kind:int,end:int>"
_TOKEN = "struct<start:int,end:int,encoding:string,length:int,chi:double,changes:int,serial:double>"
_FOUND_DDL = (f"doc_id long, known array<{_SPAN}>, tokens array<{_TOKEN}>, pair int, n long")
_SPAN_TYPE = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_TOKEN_TYPE = pa.struct([
    ("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()), ("length", pa.int32()),
    ("chi", pa.float64()), ("changes", pa.int32()), ("serial", pa.float64())])


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document; at the end one for each pair of neighbouring letters (``pair``)."""
    pairs = np.zeros(1 << 14, np.int64)

    def rows(doc, spans, tokens, pair, n):
        size = max(len(doc), len(pair))
        none = [None] * size
        return pa.RecordBatch.from_arrays([
            doc if len(doc) else pa.array(none, pa.int64()),
            pa.array(spans or none, pa.list_(_SPAN_TYPE)), pa.array(tokens or none, pa.list_(_TOKEN_TYPE)),
            pa.array(pair if len(pair) else none, pa.int32()), pa.array(n if len(n) else none, pa.int64()),
        ], ["doc_id", "known", "tokens", "pair", "n"])

    for part in parts(batches):
        column = part.column("text").fill_null("")
        raw, at = utf8(column)
        if len(raw) > 1:
            code = raw.astype(np.int32)
            code = (code[:-1] << 7) + code[1:]
            code[(raw[:-1] | raw[1:]) > 127] = 0
            edges = at[1:-1]
            code[edges[(edges > 0) & (edges < len(raw))] - 1] = 0
            pairs += np.bincount(code, minlength=1 << 14)
        with_hex = set(_long_runs(raw, at, _HEX_BYTES, 24).tolist())
        with_token = set(_long_runs(raw, at, _TOKEN_BYTES, LEAST).tolist())
        spans, tokens = [], []
        for i, text in enumerate(column.to_pylist()):
            found = known(text)
            if i in with_hex:
                found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
            found.sort()
            more = []
            if i in with_token:
                covered, at_span = sorted((b, a) for a, _, b in found), 0  # by end
                for m in CANDIDATE.finditer(text):
                    while at_span < len(covered) and covered[at_span][0] <= m.start():
                        at_span += 1
                    # known forms are of three kinds, so few that end later begin later still
                    taken = any(a < m.end() for _, a in covered[at_span:at_span + len(KINDS)])
                    encoding = None if taken else encoding_of(m.group())
                    if encoding:
                        s = statistics(m.group(), encoding)
                        more.append((m.start(), m.end(), encoding, *s))
            spans.append([dict(zip(("start", "kind", "end"), f, strict=True)) for f in found])
            tokens.append([dict(zip(_TOKEN_TYPE.names, t, strict=True)) for t in more])
        yield rows(part.column("doc_id").cast(pa.int64()), spans, tokens, (), ())
    seen = np.flatnonzero(pairs)
    if len(seen):
        yield rows((), [], [], seen, pairs[seen])


def _with_p(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            out = []
            for tokens in batch.column("tokens").to_pylist():
                found = []
                for t in tokens:
                    s = Statistics(t["length"], t["chi"], t["changes"], t["serial"])
                    p, random = judged(s, *model[t["encoding"]])
                    found.append({"start": t["start"], "end": t["end"], "p": p, "random": random, "bin": _bin(p),
                                  "encoding": t["encoding"], "length": _length_class(s.n)})
                out.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("known"), pa.array(out, pa.list_(pa.struct([
                    ("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64()), ("random", pa.bool_()),
                    ("bin", pa.int32()), ("encoding", pa.string()), ("length", pa.int32())])))],
                ["doc_id", "known", "tokens"])

    return run


def scan(docs: DataFrame, *, level: float = LEVEL) -> DataFrame:
    """doc_id, spans of every document (doc_id, text).

    A span is (start, kind, end, p): places in code points, the end exclusive;
    ``kind`` numbers `KINDS`; p only for random strings.  The driver reads the
    counts of neighbouring letters (at most 16,384) and of p-values in bins.
    """
    spark = docs.sparkSession
    found = written(bounded(docs).select("doc_id", "text").mapInArrow(_scanned, _FOUND_DDL), "candidates")
    pairs = np.zeros(1 << 14, np.int64)
    for r in found.where(F.col("pair").isNotNull()).groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[r.pair] = r.n
    pairs[0] = 0
    sent = spark.sparkContext.broadcast(models(pairs.reshape(128, 128)))
    found = written(found.where(F.col("pair").isNull()).select("doc_id", "known", "tokens").mapInArrow(
        _with_p(sent), f"doc_id long, known array<{_SPAN}>, tokens array<struct<start:int,end:int,p:double,"
        "random:boolean,bin:int,encoding:string,length:int>>"), "judged")
    bins = found.select(F.explode("tokens").alias("t")).groupBy("t.encoding", "t.length", "t.bin").agg(
        F.count(F.lit(1)).alias("n")).collect()
    first = first_bins({(r.encoding, r.length, r.bin): r.n for r in bins}, level)
    if not first:
        more = F.array().cast("array<struct<start:int,kind:int,end:int,p:double>>")
    else:
        reached = F.create_map(*[F.lit(x) for item in first.items() for x in item])
        more = F.transform(F.filter("tokens", lambda t: t["random"] & (t["bin"] >= F.element_at(
            reached, F.concat_ws(":", t["encoding"], t["length"].cast("string"))))), lambda t: F.struct(
                t["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"),
                t["end"].alias("end"), t["p"].alias("p")))
    base = F.transform("known", lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
        F.lit(None).cast("double").alias("p")))
    return found.select("doc_id", F.array_sort(F.concat(base, more)).alias("spans"))


def _written_out(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts of the known forms, their SHA-256 and all spans written out."""
    base = F.filter("spans", lambda s: s["kind"] < KINDS.index("random"))

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sha2(_written_out(base).cast("binary"), 256).alias("base_sha256"),
        _written_out(F.col("spans")).alias("spans"))
