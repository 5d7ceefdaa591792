"""Candidates for repeated passages: runs of windows that share an anchor.

Every window (of words or of bytes) has an anchor, the smallest hash of the grams in it.
Equal windows have equal anchors, whatever stands around them, so it is enough to compare
windows of one anchor value. Windows that follow each other mostly share their anchor: such a
run is one row, with a hash of all it spans. There are about 2 runs for each ``window - gram``
positions, so what is shuffled is a few per cent of the text's length in rows.

Runs of one value are brought together once. Values that hold more than a partition's share of
all runs are found beforehand from per-batch counts (at most one row for each partition and
value survives, so the list is bounded by the number of partitions) and go another way, by
aggregates that combine before their shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierflow.llm.batches import as_bytes, column, slices
from dossierflow.llm.hashing import Prefix, Words, bytes_prefix
from dossierflow.llm.store import keep

#: bytes of segments that a task judges at once
BLOCK_BYTES = 1 << 20
#: segments of one value that a task judges at once; values with more are judged by shuffled window hashes
HOT_SEGMENTS = 20_000


def numbered(docs: DataFrame) -> DataFrame:
    """rid, doc_id, text: rid is the doc_id where it is a key and a whole number; else (text ids too)
    rows are numbered in the order of doc_id (null last) and text, and written once."""
    rows = docs.select("doc_id", "text")
    whole = isinstance(docs.schema["doc_id"].dataType, T.IntegralType)
    if whole:
        ids = docs.agg(
            F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("some"), F.countDistinct("doc_id").alias("distinct")
        ).first()
    if whole and ids.n == ids.some == ids.distinct:
        return rows.select(F.col("doc_id").cast("long").alias("rid"), "doc_id", "text")
    ordered = rows.orderBy(F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first())
    return keep(ordered.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), "numbered")


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[Prefix, np.ndarray]:
    words = Words(data, offsets)
    return Prefix(words.hashes), words.first


def byte_units(data: np.ndarray, offsets: np.ndarray) -> tuple[Prefix, np.ndarray]:
    return bytes_prefix(data), offsets


def find_runs(prefix: Prefix, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """row, place in the row, number of windows, anchor value, hash of the span, and whether a
    window may stand in the run twice."""
    n, counts = len(prefix.sums) - 1, np.diff(first)
    per_row = np.maximum(0, counts - window + 1)
    row = np.repeat(np.arange(len(counts)), per_row)
    if not len(row):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64), empty.astype(bool)
    grams = prefix.ranges(np.arange(n - gram + 1), np.arange(gram, n + 1))
    width, least, span = window - gram + 1, grams, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    value = least[at]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(row)))
    begin, value, row = at[start], value[start], row[start]
    twice = length > width
    for lo in range(0, len(begin), 16384):
        part = slice(lo, lo + 16384)
        steps = np.arange(width)
        head = grams[begin[part, None] + steps] == value[part, None]
        last = begin[part] + length[part] - 1
        tail = grams[last[:, None] + steps] == value[part, None]
        from_left = begin[part] + head.argmax(axis=1)
        from_right = last + width - 1 - tail[:, ::-1].argmax(axis=1)
        twice[part] |= from_left != from_right
    span_hash = prefix.ranges(begin, begin + length + window - 1)
    return row, begin - first[row], length, value, span_hash, twice


_RUN = T.StructType([
    T.StructField("value", T.LongType()),
    T.StructField("span", T.LongType()),
    T.StructField("rid", T.LongType()),
    T.StructField("at", T.IntegerType()),
    T.StructField("n", T.IntegerType()),
    T.StructField("twice", T.BooleanType()),
])


def runs(docs: DataFrame, units: Callable, window: int, gram: int) -> DataFrame:
    def run(batches):
        for b in batches:
            rid = column(b, "rid").to_numpy(zero_copy_only=False)
            for lo, _, data, offsets in slices(column(b, "text")):
                row, at, n, value, span, twice = find_runs(*units(data, offsets), window, gram)
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(value.view(np.int64)), pa.array(span.view(np.int64)), pa.array(rid[lo + row]),
                            pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(twice),
                        ],
                        names=[f.name for f in _RUN],
                    )

    return docs.select("rid", "text").mapInArrow(run, _RUN)


def hot_values(docs: DataFrame, units: Callable, window: int, gram: int, parts: int) -> DataFrame:
    """Values of more than about one in ``parts`` of all runs.

    A slice reports the values that hold at least one in ``8 * parts`` of its runs, 8 * parts at
    most. What a value loses to slices that don't report it is under an eighth of the share asked.
    """

    def run(batches):
        for b in batches:
            for _, _, data, offsets in slices(column(b, "text")):
                value = find_runs(*units(data, offsets), window, gram)[3]
                if len(value):
                    found, n = np.unique(value, return_counts=True)
                    some = n * 8 * parts >= len(value)
                    some &= n > 1
                    k = int(some.sum())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.append(found[some].view(np.int64), 0)), pa.array(np.append(n[some], 0)),
                            pa.array(np.append(np.zeros(k, np.int64), len(value))),
                        ],
                        names=["value", "n", "of"],
                    )

    counts = keep(docs.select("text").mapInArrow(run, "value long, n long, of long"), "hot")
    total = counts.agg(F.sum("of")).first()[0] or 0
    return (
        counts.where("n > 0").groupBy("value").agg(F.sum("n").alias("n"))
        .where(F.col("n") * parts * 8 > F.lit(total) * 7).select("value")
    )


def _first():
    return F.min(F.struct("rid", "at"))


def together(found: DataFrame, hot: DataFrame) -> DataFrame:
    """Each run of a value that several runs have, or that may hold a window twice, with

    copies: runs with the same value and span, first: the first of them (rid, at),
    mixed: whether windows of the value must be compared one by one.
    """
    same = Window.partitionBy("value", "span")
    value = Window.partitionBy("value")
    cold = (
        found.join(F.broadcast(hot), "value", "left_anti")
        .withColumn("copies", F.count(F.lit(1)).over(same))
        .withColumn("first", _first().over(same))
        .withColumn("runs", F.count(F.lit(1)).over(value))
        .withColumn("several", F.min("span").over(value) != F.max("span").over(value))
    )
    often = found.join(F.broadcast(hot), "value", "left_semi")
    spans = often.groupBy("value", "span").agg(F.count(F.lit(1)).alias("copies"), _first().alias("first"))
    values = spans.groupBy("value").agg(
        F.sum("copies").alias("runs"), (F.min("span") != F.max("span")).alias("several")
    )
    common = often.join(spans, ["value", "span"]).join(F.broadcast(values), "value")
    columns = ["value", "span", "rid", "at", "n", "copies", "first", (F.col("several") | F.col("twice")).alias("mixed")]
    return (
        cold.where("runs > 1 or twice").select(*columns)
        .unionByName(common.where("runs > 1 or twice").select(*columns))
    )


def packed(docs: DataFrame) -> DataFrame:
    """rid, doc_id, z: texts compressed for a shuffle."""
    schema = T.StructType([
        T.StructField("rid", T.LongType()), docs.schema["doc_id"], T.StructField("z", T.BinaryType()),
    ])

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            z = [squeeze(t.as_py()) for t in as_bytes(column(b, "text"))]
            yield pa.RecordBatch.from_arrays(
                [column(b, "rid"), column(b, "doc_id"), pa.array(z, pa.binary())], names=["rid", "doc_id", "z"]
            )

    return docs.select("rid", "doc_id", "text").mapInArrow(run, schema)


def unpacker() -> Callable[[bytes], bytes]:
    return zstandard.ZstdDecompressor().decompress


def segments(docs: DataFrame, wanted: DataFrame, cut: Callable[[bytes, int, int], Iterator[bytes]]) -> DataFrame:
    """value, rid, at, n, copies, text: the text of each wanted run (value, rid, at, n, copies)."""
    schema = T.StructType([
        *[T.StructField(c, T.LongType()) for c in ("value", "rid")],
        *[T.StructField(c, T.IntegerType()) for c in ("at", "n")],
        T.StructField("copies", T.LongType()), T.StructField("text", T.BinaryType()),
    ])
    lists = wanted.groupBy("rid").agg(
        *[F.collect_list(c).alias(c) for c in ("value", "at", "n", "copies")]
    )

    def run(batches):
        unpack = unpacker()
        for b in batches:
            held: list[list] = [[] for _ in schema]
            size = 0
            for rid, z, *lists_ in zip(*(column(b, c).to_pylist() for c in ("rid", "z", "value", "at", "n", "copies"))):
                value, at, n, copies = lists_
                texts = list(cut(unpack(z), at, n))
                for part, more in zip(held, (value, [rid] * len(at), at, n, copies, texts)):
                    part.extend(more)
                size += sum(map(len, texts))
                if size > BLOCK_BYTES:
                    yield _batch(held, schema)
                    held, size = [[] for _ in schema], 0
            if held[0]:
                yield _batch(held, schema)

    return packed(docs).drop("doc_id").join(lists, "rid").mapInArrow(run, schema)


def _batch(columns: list[list], schema: T.StructType) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(columns, schema)], names=[f.name for f in schema]
    )


_SPAN = "rid long, at int, n int"


def judged(found: DataFrame, judge: Callable[[pa.Table], Iterator[tuple[int, int, int]]], parts: int) -> DataFrame:
    """rid, at, n of what ``judge`` finds in blocks of whole values, each in the order of (rid, at)."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def settle(table: pa.Table) -> pa.RecordBatch:
            spans = list(judge(table.combine_chunks()))
            return pa.RecordBatch.from_arrays(
                [pa.array([s[0] for s in spans], pa.int64()), *[pa.array([s[i] for s in spans], pa.int32()) for i in (1, 2)]],
                names=["rid", "at", "n"],
            )

        for b in batches:
            held.append(b)
            size += b.nbytes
            if size > BLOCK_BYTES:
                table = pa.Table.from_batches(held)
                value = table["value"].to_numpy()
                whole = int(np.searchsorted(value, value[-1]))  # the last value may go on
                if whole:
                    yield settle(table.slice(0, whole))
                    held, size = table.slice(whole).to_batches(), 0
        if held:
            yield settle(pa.Table.from_batches(held))

    return found.repartition(parts, "value").sortWithinPartitions("value", "rid", "at").mapInArrow(run, _SPAN)


def by_windows(hashes: DataFrame, drop_first: bool) -> DataFrame:
    """rid, at, n = 1 of windows (hi, lo, rid, at, copies) that stand elsewhere, or earlier if
    ``drop_first`` is false for the first: aggregates that combine before their shuffle."""
    several = hashes.groupBy("hi", "lo").agg(F.sum("copies").alias("all"), _first().alias("first")).where("all > 1")
    met = hashes.join(several, ["hi", "lo"])
    if not drop_first:
        met = met.where(~((F.col("rid") == F.col("first.rid")) & (F.col("at") == F.col("first.at"))))
    return met.select("rid", "at", F.lit(1).alias("n"))


def marked(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Mask of the units that lie in any of the spans (start, length)."""
    edge = np.zeros(n + 1, np.int64)
    if spans:
        at, length = np.array(spans, np.int64).T
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:-1]) > 0
