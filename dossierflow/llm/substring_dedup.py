"""Removal of repeated passages of words, located by sharded Aho-Corasick automata.

A word is covered when a window of ``window`` words around it stands anywhere else, in the same
document or another; all places are removed, the first included. Passages that hold an anchor
which occurs more than once (see ``recurrence``) are dealt out by anchor value. Each task
confirms which windows of its passages recur, compiles the recurring phrases into an
Aho-Corasick automaton of word numbers - a shard of the dictionary, bounded by the block it
came from - and streams the passages of all documents that hold these anchors through it, to
locate every occurrence. A passage without a repeated anchor can't hold a repeated window.

A null text has no words; a document of fewer words than a window keeps all; repeated rows
are copies of each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierflow.llm import recurrence as rec
from dossierflow.llm.batches import column
from dossierflow.llm.hashing import Prefix, Words, mix
from dossierflow.llm.store import keep

WINDOW = 35
#: words of an anchor
GRAM = 5


def words(text: bytes) -> list[bytes]:
    # the six ASCII white space characters are what separates words, as in bytes.split
    return text.split()


def _cut(window: int):
    def cut(text: bytes, at: list[int], n: list[int]):
        ws = words(text)
        for a, k in zip(at, n):
            yield b" ".join(ws[a : a + k + window - 1])

    return cut


def _judge(window: int):
    def judge(table: pa.Table):
        vocabulary: dict[bytes, int] = {}
        coded = [
            [vocabulary.setdefault(w, len(vocabulary)) for w in t.split(b" ")] for t in table["text"].to_pylist()
        ]
        size = np.array([len(c) for c in coded])
        first = np.concatenate(([0], np.cumsum(size)))
        flat = np.fromiter((w for c in coded for w in c), np.uint64, int(first[-1]))
        per = size - window + 1
        seg = np.repeat(np.arange(len(coded)), per)
        at = first[seg] + np.arange(len(seg)) - np.repeat(np.cumsum(per) - per, per)
        # word numbers are exact; two of their hashes make a window's key
        one = Prefix(mix(flat + np.uint64(1))).ranges(at, at + window)
        two = Prefix(mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5))).ranges(at, at + window)
        _, place, count = np.unique(one ^ mix(two), return_inverse=True, return_counts=True)
        recurs = count[place] > 1
        edge = np.flatnonzero(np.diff(np.concatenate(([0], recurs.astype(np.int8), [0]))) != 0)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        streamed = set()
        ends = np.cumsum(per)
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist()):
            while lo < hi:  # a stretch of recurring windows, within one passage
                s = int(seg[lo])
                stop = min(hi, int(ends[s]))
                a = int(at[lo] - first[s])
                automaton.add_word(tuple(coded[s][a : a + stop - lo + window - 1]))
                streamed.add(s)
                lo = stop
        if not streamed:
            return
        automaton.make_automaton()
        rid, start = table["rid"].to_numpy(), table["at"].to_numpy()
        for s in range(len(coded)):
            reach = -1
            spans: list[list[int]] = []
            for end, length in automaton.iter(tuple(coded[s])):
                a = end - length + 1
                while spans and spans[-1][0] >= a:
                    spans.pop()
                if spans and a <= spans[-1][1] + 1:
                    spans[-1][1] = max(spans[-1][1], end)
                else:
                    spans.append([a, end])
                reach = end
            for a, e in spans if reach >= 0 else []:
                yield int(rid[s]), int(start[s]) + a, e - a + 1

    return judge


def _window_hashes(segments: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for b in batches:
            rid, start = column(b, "rid").to_numpy(), column(b, "at").to_numpy()
            texts = column(b, "text")
            for i, t in enumerate(texts.to_pylist()):
                data = np.frombuffer(t, np.uint8)
                w = Words(data, np.array([0, len(data)]))
                at = np.arange(len(w.hashes) - window + 1)
                hi = Prefix(w.hashes).ranges(at, at + window)
                lo = Prefix(mix(w.hashes)).ranges(at, at + window)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(np.full(len(at), rid[i])),
                        pa.array((start[i] + at).astype(np.int32)), pa.array(np.ones(len(at), np.int64)),
                    ],
                    names=["hi", "lo", "rid", "at", "copies"],
                )

    return segments.mapInArrow(run, "hi long, lo long, rid long, at int, copies long")


def covered(docs: DataFrame, window: int, gram: int, hot_segments: int) -> DataFrame:
    """rid, at, n: spans of covered words of ``docs`` (rid, doc_id, text)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = keep(rec.hot_values(docs, rec.word_units, window, gram, parts), "hot")
    found = rec.together(rec.runs(docs, rec.word_units, window, gram), hot)
    found = keep(found.select("value", "rid", "at", "n", F.lit(1).cast("long").alias("copies")), "found")
    large = keep(found.groupBy("value").count().where(F.col("count") > hot_segments).select("value"), "large")
    cold = rec.segments(docs, found.join(large, "value", "left_anti"), _cut(window))
    spans = rec.judged(cold, _judge(window), parts)
    if not large.isEmpty():
        often = rec.segments(docs, found.join(large, "value", "left_semi"), _cut(window))
        windows = rec.by_windows(_window_hashes(often, window), drop_first=True)
        spans = spans.unionByName(windows.select("rid", "at", F.lit(window).alias("n")))
    return spans


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_segments: int = rec.HOT_SEGMENTS) -> DataFrame:
    """doc_id, n_words, n_removed, kept (kept words joined by a space) of every document."""
    return _finish(docs, window, gram, hot_segments, "kept", T.StringType(), lambda raw: raw.decode("utf-8", "replace"))


def digest(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_segments: int = rec.HOT_SEGMENTS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return _finish(
        docs, window, gram, hot_segments, "kept_sha256", T.StringType(), lambda raw: hashlib.sha256(raw).hexdigest()
    )


def _finish(docs, window, gram, hot_segments, name, kind, make) -> DataFrame:
    rows = rec.numbered(docs)
    spans = covered(rows, window, gram, hot_segments)
    lists = spans.groupBy("rid").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    schema = T.StructType([
        rows.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField(name, kind),
    ])

    def run(batches):
        unpack = rec.unpacker()
        for b in batches:
            total, gone, out = [], [], []
            for z, s in zip(column(b, "z").to_pylist(), column(b, "spans").to_pylist()):
                ws = words(unpack(z))
                if s:
                    mask = rec.marked(len(ws), [(x["at"], x["n"]) for x in s])
                    left = [w for w, m in zip(ws, mask.tolist()) if not m]
                else:
                    left = ws
                total.append(len(ws))
                gone.append(len(ws) - len(left))
                out.append(make(b" ".join(left)))
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())],
                names=[f.name for f in schema],
            )

    return rec.packed(rows).join(lists, "rid", "left").mapInArrow(run, schema)
