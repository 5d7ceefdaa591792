"""Benchmark decontamination with a generalised suffix automaton of the items' words.

Words are maximal runs of ASCII letters and digits, lower-cased, and of all non-ASCII
characters. A window is ``n`` consecutive words of one item, or all words of an item that
has fewer. Every document's words are streamed through the automaton, which knows at each
word the longest suffix that some item contains; from it come the windows that end there
and the items that own them. Words inside any occurrence are hit.

The automaton holds a shard of the items of at most ``SHARD_WORDS`` words (an item beyond
that is cut into pieces that overlap by ``n - 1`` words), so a worker's memory is bounded;
a larger benchmark takes one pass over the documents for each shard.

A null text has no words; an item with a null item_id hits like any other, but is not among
the items found. An item without words has no window, and repeated items and
documents count one by one. An empty table of either kind gives no hits. Extra columns are
ignored by ``find`` and kept by ``clean``, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierflow.llm.batches import as_bytes, column, freeing
from dossierflow.llm.store import keep

#: words of benchmark items in one automaton
SHARD_WORDS = 100_000
#: ``clean`` drops a document when more than this share of its words is hit
MAX_COVERAGE = 0.5

_SEPARATORS = [b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)]
_TABLE = bytes(32 if b in _SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class SuffixAutomaton:
    """All substrings of several word sequences; each state knows the sequences it occurs in."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], n: int):
        self.n = n
        self.vocabulary: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for i, ws in items if ws]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self.owners: list[set[str]] = [set() for _ in self.link]
        self.whole: list[list[tuple[int, str]]] = [[] for _ in self.link]
        for item, codes in coded:
            state = 0
            for c in codes:
                state = self.step[state][c]
                up = state
                while up > 0 and item not in self.owners[up]:
                    self.owners[up].add(item)
                    up = self.link[up]
            if len(codes) < n:
                self.whole[state].append((len(codes), item))
        # the suffix state that holds the last n words, and all short items that end here
        self.window = [-1] * len(self.link)
        self.short: list[tuple[tuple[int, str], ...]] = [()] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[s]
            if self.length[s] >= n:
                self.window[s] = self.window[up] if self.length[up] >= n else s
            self.short[s] = tuple(self.whole[s]) + self.short[up]
        self.least = min([n, *(len(c) for _, c in coded)])

    def _new(self, length: int, link: int, step: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = clone
        while p != -1 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.step[last]:
            q = self.step[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        cur = self._new(self.length[last] + 1, 0, {})
        p = last
        while p != -1 and c not in self.step[p]:
            self.step[p][c] = cur
            p = self.link[p]
        if p != -1:
            q = self.step[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return cur

    def match(self, doc: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """Hit words as a mask (None: none) and the items with occurring windows."""
        found: set[str] = set()
        if not self.vocabulary or len(doc) < self.least:
            return None, found
        get = self.vocabulary.get
        codes = np.fromiter((get(w, -1) for w in doc), np.int64, len(doc))
        known = np.concatenate(([0], (codes >= 0).astype(np.int8), [0]))
        edges = np.flatnonzero(np.diff(known))
        edge = np.zeros(len(doc) + 1, np.int32)
        hit = False
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if hi - lo < self.least:
                continue
            state = matched = 0
            for i, c in enumerate(codes[lo:hi].tolist(), lo):
                while state and c not in self.step[state]:
                    state = self.link[state]
                    matched = self.length[state]
                if c in self.step[state]:
                    state = self.step[state][c]
                    matched += 1
                else:
                    state = matched = 0
                    continue
                if matched >= self.n:
                    found |= self.owners[self.window[state]]
                    edge[i - self.n + 1] += 1
                    edge[i + 1] -= 1
                    hit = True
                for size, item in self.short[state]:
                    if size <= matched:
                        found.add(item)
                        edge[i - size + 1] += 1
                        edge[i + 1] -= 1
                        hit = True
        return (np.cumsum(edge[:-1]) > 0 if hit else None), found


def _pieces(item: str | None, ws: list[bytes], n: int) -> list[tuple[str | None, list[bytes]]]:
    if len(ws) <= SHARD_WORDS:
        return [(item, ws)]
    return [(item, ws[i : i + SHARD_WORDS]) for i in range(0, len(ws) - n + 1, SHARD_WORDS - n + 1)]


def _shards(items: DataFrame) -> list[DataFrame]:
    """The items with words, in shards whose bytes suggest at most about SHARD_WORDS words."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-int(total) // (SHARD_WORDS * 6)))
    if count == 1:
        return [rows]
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    return [rows.where(part == i) for i in range(count)]


_ADDED = [("hit_words", pa.list_(pa.int32())), ("hit_items", pa.list_(pa.string()))]


def _pass(tagged: DataFrame, shard: DataFrame, n: int) -> DataFrame:
    """``tagged`` with the shard's hit words and items added to those so far."""
    spark = tagged.sparkSession
    held = spark.sparkContext.broadcast([(r.item_id, r.text) for r in shard.collect()])

    def run(batches):
        auto = None
        for batch in batches:
            if auto is None:
                auto = SuffixAutomaton(
                    [p for i, t in held.value for p in _pieces(i, words(t.encode()), n)], n
                )
            hit_words, hit_items = [], []
            before = zip(column(batch, "hit_words").to_pylist(), column(batch, "hit_items").to_pylist())
            for text, (old_words, old_items) in zip(as_bytes(column(batch, "text")), before):
                mask, found = auto.match(words(text.as_py()))
                new = np.flatnonzero(mask).tolist() if mask is not None else []
                hit_words.append(sorted({*old_words, *new}) if old_words else new)
                hit_items.append(sorted(found.union(old_items) - {None}))
            kept = [c for i, c in enumerate(batch.columns) if batch.schema.names[i] not in ("hit_words", "hit_items")]
            names = [x for x in batch.schema.names if x not in ("hit_words", "hit_items")]
            yield pa.RecordBatch.from_arrays(
                [*kept, *(pa.array(v, t) for v, (_, t) in zip((hit_words, hit_items), _ADDED))],
                names=[*names, "hit_words", "hit_items"],
            )

    return tagged.mapInArrow(freeing(run), tagged.schema)


def hits(rows: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """``rows`` (with a column text) and the numbers of hit words and the items found."""
    out = rows.withColumn("hit_words", F.array().cast("array<int>")).withColumn(
        "hit_items", F.array().cast("array<string>")
    )
    for i, shard in enumerate(_shards(items)):
        out = _pass(keep(out, "hits") if i else out, shard, n)
    return out


def find(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
    ])

    def run(batches):
        for b in batches:
            found = column(b, "hit_items").to_pylist()
            n_hit = [len(x) for x in column(b, "hit_words").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    column(b, "doc_id"),
                    pa.array([len(words(t.as_py())) for t in as_bytes(column(b, "text"))], pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in found], pa.string()),
                    pa.array([x > 0 for x in n_hit], pa.bool_()),
                ],
                names=[f.name for f in schema],
            )

    return hits(docs.select("doc_id", "text"), items, n).mapInArrow(run, schema)


def cut(text: bytes, hit: list[int]) -> bytes:
    """``text`` without its hit words; between two hit words that touch all goes."""
    flat = np.frombuffer(text.translate(_TABLE), np.uint8)
    inside = np.concatenate(([0], (flat != 32).astype(np.int8), [0]))
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    runs = np.split(np.asarray(hit), np.flatnonzero(np.diff(hit) > 1) + 1)
    out, at = [], 0
    for r in runs:
        out.append(text[at : starts[r[0]]])
        at = int(ends[r[-1]])
    return b"".join([*out, text[at:]])


def clean(docs: DataFrame, items: DataFrame, n: int = 10, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """``docs`` without hit passages, and without the documents that are hit beyond ``max_coverage``."""
    columns = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in columns]).alias("doc"), docs["text"].alias("text"))
    schema = T.StructType([
        T.StructField("doc", rows.schema["doc"].dataType),
        T.StructField("text", T.StringType()),
    ])

    def run(batches):
        for b in batches:
            keep_row, texts = [], []
            for t, hit in zip(column(b, "text").to_pylist(), column(b, "hit_words").to_pylist()):
                if hit:
                    raw = t.encode()
                    keep_row.append(len(hit) <= max_coverage * len(words(raw)))
                    t = cut(raw, hit).decode("utf-8", "replace")
                else:
                    keep_row.append(True)
                texts.append(t)
            out = pa.RecordBatch.from_arrays([column(b, "doc"), pa.array(texts, pa.string())], names=["doc", "text"])
            yield out.filter(pa.array(keep_row, pa.bool_()))

    done = hits(rows, items, n).mapInArrow(freeing(run), schema)
    return done.select(*[
        (F.col("text") if c == "text" else F.col("doc").getField(c)).alias(c) for c in columns
    ])
