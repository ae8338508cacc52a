"""Token counts of documents in flat, unindexed token files.

A token file is nothing but token ids of fixed width, a document's ids followed
by the end-of-document id; there is no index and no length.  Spark reads the
files in blocks: its text reader cuts them at one byte that the
end-of-document id holds, so no record is longer than a document, and records
are taken as bytes.  In each block the ends of all records are compared with
the separator at once (numpy).  A block knows neither its place in the file nor
where its first document began, so it reports both alignments, its length and
its last separators; a prefix scan over the blocks of a file adds up lengths,
which gives places and the alignment, and carries the last separator forward.

Every document may carry a trailer before its separator: its id in eleven
digits of base 64 (64 in all of them: null), which no separator byte can be
part of.

Defined results: null and empty texts have no tokens; ids repeated in several
rows are reported once for each; tokens after the last separator of a file are
one more document, unfinished and without id; an empty file or table has no
documents.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import work_path
from .bpe import _sent, vocabulary
from .common import bounded, parts

#: Big-endian unsigned 16-bit ids, the separator and its last byte as a character.
WIDTH, SEPARATOR = 2, 50256
_CUT = chr(SEPARATOR & 255)
_HIGH = SEPARATOR >> 8
_DIGITS, _BASE, _NULL = 11, 64, 64


def _trailer(ids: list[int | None]) -> np.ndarray:
    """The digits of each id, a row each."""
    value = np.array([0 if i is None else i for i in ids], np.int64).view(np.uint64)
    shift = np.arange(_DIGITS - 1, -1, -1, dtype=np.uint64) * np.uint64(6)
    digits = ((value[:, None] >> shift) & np.uint64(_BASE - 1)).astype(">u2")
    digits[[i is None for i in ids]] = _NULL
    return digits


def write_tokens(docs: DataFrame, tokenizer: str, path: str) -> None:
    """The documents' tokens as flat files below ``path``, one for each task.

    Spark's text writer ends each row with the separator's last byte, so the
    files hold the ids and separators only.
    """
    sent = _sent(docs, tokenizer)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(sent.value)
        for part in parts(batches):
            coded = coder.encode(part.column("text").fill_null("").to_pylist(), special=False)
            trailers = _trailer(part.column("doc_id").to_pylist())
            out = [np.frombuffer(c, "<u4").astype(">u2").tobytes() + t.tobytes() + bytes([_HIGH])
                   for c, t in zip(coded, trailers, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    bounded(docs).select("doc_id", "text").mapInArrow(rows, "value binary").select(
        F.col("value").cast("string")).write.option("lineSep", _CUT).text(path)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of separators and of blocks (``size`` set) of the records read.

    A block is what one batch holds of one input split; ``block`` numbers those
    of a split.  Places count bytes from the block's first.
    """
    numbers: dict[tuple[int, int], int] = {}
    for batch in batches:
        file = batch.column("file").to_numpy(zero_copy_only=False)
        split = batch.column("split").to_numpy(zero_copy_only=False)
        change = np.flatnonzero((np.diff(file) != 0) | (np.diff(split) != 0)) + 1
        edges = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            key = int(file[a]), int(split[a])
            number = numbers[key] = numbers.get(key, -1) + 1
            yield _separators(batch.column("value").slice(a, b - a), *key, number,
                              batch.column("file_size")[a].as_py())


_FIELDS = ("file long, split long, block long, file_size long, size long, parity int, place long, before long, "
           "last0 long, last1 long, doc_id long")


def _separators(values: pa.Array, file: int, split: int, block: int,
                file_size: int) -> pa.RecordBatch:
    values = values.cast(pa.large_binary())
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64, len(values) + 1, values.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    length = np.diff(at)
    ends = np.cumsum(length + 1)          # place after each record and its last byte
    full = np.flatnonzero(length > 0)
    hit = full[raw[at[full + 1] - 1] == _HIGH]
    place = ends[hit]
    parity = place % WIDTH
    before = np.full(len(hit), -1, np.int64)
    last = [-1, -1]
    for p in range(WIDTH):
        own = np.flatnonzero(parity == p)
        before[own[1:]] = place[own[:-1]]
        if len(own):
            last[p] = int(place[own[-1]])
    doc = np.zeros(len(hit), np.uint64)
    known = length[hit] >= _DIGITS * WIDTH + 1
    start = at[hit + 1] - 1 - _DIGITS * WIDTH
    for d in range(_DIGITS):
        where = np.where(known, start + WIDTH * d, 0)
        digit = raw[where].astype(np.uint64) << np.uint64(8) | raw[where + 1].astype(np.uint64)
        known &= digit <= _NULL
        doc = (doc << np.uint64(6)) + np.where(digit < _BASE, digit, 0).astype(np.uint64)
        if d == 0:
            null = digit == _NULL
    ids = pa.array(doc.view(np.int64), pa.int64(), mask=~known | null if len(hit) else None)
    n = len(hit)
    size = int(ends[-1])

    def column(values, tail):
        return pa.concat_arrays([pa.array(values, pa.int64()), pa.array([tail], pa.int64())])

    return pa.RecordBatch.from_arrays([
        pa.array(np.full(n + 1, file), pa.int64()), pa.array(np.full(n + 1, split), pa.int64()),
        pa.array(np.full(n + 1, block), pa.int64()), pa.array(np.full(n + 1, file_size), pa.int64()),
        column([None] * n, size),
        pa.concat_arrays([pa.array(parity, pa.int32()), pa.array([None], pa.int32())]),
        column(place, None), column(before, None), column([None] * n, last[0]),
        column([None] * n, last[1]), pa.concat_arrays([ids, pa.array([None], pa.int64())]),
    ], [f.split()[0] for f in _FIELDS.split(", ")])


def count_tokens(spark: SparkSession, path: str, work: str, *, trailer: int = _DIGITS) -> DataFrame:
    """file, start, doc_id, n_tokens of every document in the token files below ``path``.

    ``file`` is a hash of the file's path, ``start`` the first byte of the
    document.  What the blocks report is written below ``work``.
    """
    meta = F.col("_metadata")
    records = spark.read.option("lineSep", _CUT).text(path).select(
        F.col("value").cast("binary").alias("value"),
        F.xxhash64(meta["file_path"]).alias("file"), meta["file_block_start"].alias("split"),
        meta["file_size"].alias("file_size"))
    records.mapInArrow(_blocks, _FIELDS).write.parquet(work)
    found = spark.read.schema(_FIELDS).parquet(work)
    order = Window.partitionBy("file").orderBy("split", "block")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    blocks = found.where(F.col("size").isNotNull()).select(
        "file", "split", "block", "file_size", "last0", "last1",
        F.coalesce(F.sum("size").over(so_far), F.lit(0)).alias("base"))
    # a separator counts if it ends at a multiple of the width from the file's begin
    aligned = F.pmod(F.col("base"), F.lit(WIDTH)).cast("int")
    last = F.when(aligned == 0, F.col("last0")).otherwise(F.col("last1"))
    # the reader adds the cut to a last record that ends without one
    end = F.col("base") + last
    blocks = blocks.withColumn(
        "last", F.when((last >= 0) & (end <= F.col("file_size")), end)).withColumn(
        "aligned", aligned).withColumn(
        "carried", F.coalesce(F.max("last").over(so_far), F.lit(0)))
    docs = found.where(F.col("place").isNotNull()).select(
        "file", "split", "block", "parity", "place", "before", "doc_id")
    start = F.when(F.col("before") >= 0, F.col("base") + F.col("before")).otherwise(
        F.col("carried"))
    tokens = ((F.col("base") + F.col("place") - F.col("start")) / WIDTH).cast("long")
    whole = docs.join(blocks, ["file", "split", "block"]).where(
        (F.col("parity") == F.col("aligned"))
        & (F.col("base") + F.col("place") <= F.col("file_size"))).withColumn("start", start).select(
        "file", "start", "doc_id", (tokens - 1 - trailer).alias("n_tokens"))
    files = blocks.groupBy("file", "file_size").agg(
        F.coalesce(F.max("last"), F.lit(0)).alias("start"))
    rest = ((F.col("file_size") - F.col("start")) / WIDTH).cast("long")
    return whole.unionAll(files.where(rest > 0).select(
        "file", "start", F.lit(None).cast("long").alias("doc_id"), rest.alias("n_tokens")))


def counted(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Token counts of ``docs`` (doc_id, text) by way of flat token files."""
    spark = docs.sparkSession
    path = work_path(spark, "tokens")
    write_tokens(docs, tokenizer, path)
    return count_tokens(spark, path, work_path(spark, "separators"))
