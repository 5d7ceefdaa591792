"""Removal of repeated byte strings by blockwise suffix sorting.

A byte is removed when some string of ``window`` bytes around it also starts earlier: in a
document with a smaller doc_id (null last), or earlier in the same one. Suffixes are bucketed
by their anchor (see ``recurrence``): equal strings are in one bucket. The anchors are minimisers
without ranks; they stand in for a difference cover, whose places modulo a number can't be
compared between documents. Whole stretches that tie are told by a 64-bit hash of their bytes,
and anchors with very many segments go by hashes of their windows.
Only buckets in which different stretches meet are sorted, and of these only segments that
hold a string whose hash another one shares: one block of whole buckets at a time, by their
leading bytes, ties resolved by looking up ranks of later places, until the
first ``window`` bytes of all are ranked. A task holds one block; in it bytes are compared, not hashes.

A null text is empty; texts shorter than a window stay; rows that repeat both doc_id and text
of another are later ones; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierflow.llm import recurrence as rec
from dossierflow.llm.batches import column
from dossierflow.llm.hashing import bytes_prefix, mix, Prefix
from dossierflow.llm.store import keep

WINDOW = 100
#: bytes of an anchor
GRAM = 16


def _cut(window: int):
    def cut(text: bytes, at: list[int], n: list[int]):
        for a, k in zip(at, n):
            yield text[a : a + k + window - 1]

    return cut


def ranks(data: np.ndarray, window: int) -> np.ndarray:
    """Rank of the string of ``window`` bytes at each place; equal strings have equal ranks."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    first = np.zeros(n, np.uint64)
    span = min(8, window)
    for i in range(span):
        first = (first << np.uint64(8)) | padded[i : i + n]
    _, rank = np.unique(first, return_inverse=True)
    while span < window:
        step = min(span, window - span)
        later = np.zeros(n, np.uint64)
        later[: max(0, n - step)] = rank[step:]
        _, rank = np.unique((rank.astype(np.uint64) << np.uint64(32)) | later, return_inverse=True)
        span += step
    return rank


def _tied(data: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Which of the strings at ``at`` may equal another one: all whose 64-bit hash is not the only one
    of its kind. Equal strings have equal hashes, so none that is left out has a partner."""
    h = bytes_prefix(data).ranges(at, at + window)
    order = np.sort(h)
    same = order[1:][order[1:] == order[:-1]]
    if not len(same):
        return np.zeros(len(at), bool)
    place = np.minimum(np.searchsorted(same, h), len(same) - 1)
    return same[place] == h


def _judge(window: int):
    def judge(table: pa.Table):
        all_texts = table["text"].to_pylist()
        # segments without any string that may stand elsewhere are not sorted
        size = np.array([len(t) for t in all_texts])
        per = size - window + 1
        first = np.cumsum(size) - size
        seg = np.repeat(np.arange(len(size)), per)
        at = first[seg] + np.arange(len(seg)) - np.repeat(np.cumsum(per) - per, per)
        tied = _tied(np.frombuffer(b"".join(all_texts), np.uint8), at, window)
        some = np.flatnonzero(np.bincount(seg[tied], minlength=len(size)))
        if not len(some):
            return
        table = table.take(pa.array(some))
        texts = [all_texts[i] for i in some.tolist()]
        size = np.array([len(t) for t in texts])
        first = np.cumsum(size) - size
        per = size - window + 1
        seg = np.repeat(np.arange(len(texts)), per)
        inside = np.arange(len(seg)) - np.repeat(np.cumsum(per) - per, per)
        rank = ranks(np.frombuffer(b"".join(texts), np.uint8), window)[first[seg] + inside]
        # segments stand in the order of (rid, at), so the first place of a rank is the earliest
        _, earliest, place = np.unique(rank, return_index=True, return_inverse=True)
        later = earliest[place] != np.arange(len(rank))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], later.astype(np.int8), [0]))) != 0)
        ends = np.cumsum(per)
        rid, start = table["rid"].to_numpy(), table["at"].to_numpy()
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist()):
            while lo < hi:
                s = int(seg[lo])
                stop = min(hi, int(ends[s]))
                yield int(rid[s]), int(start[s] + inside[lo]), stop - lo + window - 1
                lo = stop

    return judge


def _window_hashes(segments: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for b in batches:
            rid, start = column(b, "rid").to_numpy(), column(b, "at").to_numpy()
            for i, t in enumerate(column(b, "text").to_pylist()):
                data = np.frombuffer(t, np.uint8)
                at = np.arange(len(data) - window + 1)
                hi = bytes_prefix(data).ranges(at, at + window)
                lo = Prefix(mix(data.astype(np.uint64) + np.uint64(1))).ranges(at, at + window)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(np.full(len(at), rid[i])),
                        pa.array((start[i] + at).astype(np.int32)), pa.array(np.ones(len(at), np.int64)),
                    ],
                    names=["hi", "lo", "rid", "at", "copies"],
                )

    return segments.mapInArrow(run, "hi long, lo long, rid long, at int, copies long")


def repeated(docs: DataFrame, window: int, gram: int, hot_segments: int) -> DataFrame:
    """rid, at, n: spans of bytes of ``docs`` (rid, doc_id, text) that also stand earlier."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = keep(rec.hot_values(docs, rec.byte_units, window, gram, parts), "hot")
    found = rec.together(rec.runs(docs, rec.byte_units, window, gram), hot)
    is_first = (F.col("rid") == F.col("first.rid")) & (F.col("at") == F.col("first.at"))
    found = keep(
        found.select("value", "rid", "at", "n", "copies", "mixed", is_first.alias("is_first"))
        .where("mixed or not is_first"),
        "found",
    )
    whole = found.where("not is_first").select("rid", "at", (F.col("n") + F.lit(window - 1)).cast("int").alias("n"))
    wanted = found.where("mixed and is_first").select("value", "rid", "at", "n", "copies")
    large = keep(wanted.groupBy("value").count().where(F.col("count") > hot_segments).select("value"), "large")
    cold = rec.segments(docs, wanted.join(large, "value", "left_anti"), _cut(window))
    spans = whole.unionByName(rec.judged(cold, _judge(window), parts))
    if not large.isEmpty():
        often = rec.segments(docs, wanted.join(large, "value", "left_semi"), _cut(window))
        windows = rec.by_windows(_window_hashes(often, window), drop_first=False)
        spans = spans.unionByName(windows.select("rid", "at", F.lit(window).alias("n")))
    return spans


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_segments: int = rec.HOT_SEGMENTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every document."""
    return _finish(docs, window, gram, hot_segments, "kept", T.BinaryType(), pa.binary(), lambda raw: raw)


def digest(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_segments: int = rec.HOT_SEGMENTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return _finish(
        docs, window, gram, hot_segments, "kept_sha256", T.StringType(), pa.string(),
        lambda raw: hashlib.sha256(raw).hexdigest(),
    )


def _finish(docs, window, gram, hot_segments, name, kind, arrow, make) -> DataFrame:
    rows = rec.numbered(docs)
    spans = repeated(rows, window, gram, hot_segments)
    lists = spans.groupBy("rid").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    schema = T.StructType([
        rows.schema["doc_id"],
        *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")],
        T.StructField(name, kind),
    ])

    def run(batches):
        unpack = rec.unpacker()
        for b in batches:
            total, gone, count, out = [], [], [], []
            for z, s in zip(column(b, "z").to_pylist(), column(b, "spans").to_pylist()):
                raw = unpack(z)
                left, n = raw, 0
                if s:
                    mask = rec.marked(len(raw), [(x["at"], x["n"]) for x in s])
                    left = np.frombuffer(raw, np.uint8)[~mask].tobytes()
                    n = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                total.append(len(raw))
                gone.append(len(raw) - len(left))
                count.append(n)
                out.append(make(left))
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), *[pa.array(x, pa.int64()) for x in (total, gone, count)], pa.array(out, arrow)],
                names=[f.name for f in schema],
            )

    return rec.packed(rows).join(lists, "rid", "left").mapInArrow(run, schema)
