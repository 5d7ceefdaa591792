"""Packing of tokenised documents into fixed-length sequences by exact complements, then best fit.

Every document is tokenised in the executors and cut only if it is longer than a sequence.
What is packed is then no longer documents but counts of lengths: at most ``capacity`` of
them, whatever the input. On these counts the plan is made. For each length, longest first,
the gap that a piece leaves is looked up in sums of one, two and three other lengths, and
combinations that fill it exactly are taken as often as the counts allow; each time at least
one length is used up, so the plan stays small. What remains is placed by best fit,
longest first. Pieces get a rank among those of their length from counts per partition, and
the plan maps ranks to sequences and offsets.

A null or empty text is one piece of one token (the end token); repeated rows are separate
documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierflow.llm.batches import column, freeing, slices
from dossierflow.llm.store import keep

CAPACITY = 2048
#: id that ends a document
END_ID = 0
#: chunks of text whose ids a worker remembers
REMEMBERED = 600_000
#: bytes of text that are split and encoded at once
SLICE = 1 << 23

# kinds of ASCII characters: 1 letters, 2 digits, 3 others, 0 white space; 4 is the rest of UTF-8
_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[128:] = 4
#: whether the splitter always parts two neighbours, by five times the first one's kind and the second one's
_PARTED = np.zeros((5, 5), bool)
_PARTED[1:4, 1:4] = ~np.eye(3, dtype=bool)
_PARTED[1:, 0] = True
_PARTED = _PARTED.ravel()
# white space to Python or to the tokenizer that is not one of the six: such texts are encoded whole
_ODD = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: first bytes of these
_ODD_FIRST = np.zeros(256, bool)
_ODD_FIRST[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True


class Encoder:
    """Token ids of many texts at once; ids of frequent chunks are looked up.

    A byte-level BPE splits a text into runs of letters, digits and other characters, each with
    the space before it, before it merges; so ids of a text are those of its chunks, if chunks
    start where a run of white space starts, or where ASCII characters of two kinds meet (but
    for an apostrophe before a letter, as in "don't"). All chunks of a slice are told apart by an
    Arrow dictionary, each distinct one that is not remembered is given to the tokenizer once,
    and ids are gathered by offsets.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids, self.start = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4")

    def _learn(self, chunks: pa.Array) -> None:
        """Remember chunks; start[k] is where the ids of number k begin."""
        ids, ends, used = [self.ids], [self.start], len(self.ids)
        for i in range(0, len(chunks), 5000):
            some = chunks[i : i + 5000].to_pylist()
            one = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            words = np.array(one.word_ids, np.int64)
            ids.append(np.array(one.ids, "<u4"))
            ends.append(used + np.searchsorted(words, np.arange(1, len(some) + 1)))
            used += len(ids[-1])
        self.ids, self.start = np.concatenate(ids), np.concatenate(ends)
        self.known = pa.concat_arrays([self.known, chunks])

    def _numbers(self, chunks: pa.Array) -> np.ndarray:
        """Numbers of distinct chunks among those remembered."""
        if len(self.known) > REMEMBERED:
            self._forget()
        found = pc.index_in(chunks, value_set=self.known)
        if found.null_count:
            new = pc.is_null(found)
            first = len(self.known)
            self._learn(chunks.filter(new))
            fresh = pa.array(np.arange(first, len(self.known), dtype=np.int32))
            found = pc.replace_with_mask(found, new, fresh)
        return found.to_numpy()

    def _odd_rows(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        raw = data.tobytes()
        at = [i for i in np.flatnonzero(_ODD_FIRST[data]).tolist() if _ODD.match(raw, i)]
        for word in self.special:
            i = raw.find(word)
            while i >= 0:
                at.append(i)
                i = raw.find(word, i + 1)
        # a match may run over the border of two texts; their ids come out the same either way
        return sorted({int(r) for r in np.searchsorted(offsets, at, "right") - 1})

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        out = []
        for _, _, data, offsets in slices(pa.array(texts, pa.string()), SLICE):
            ids, bounds = self.encode_slice(data, offsets)
            out += [ids[s:e].tobytes() for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        return out

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a slice in one array, and where each row's ids begin, and the last end."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(n + 1, np.int64)
        kind = _KIND[data]
        first = np.ones(len(data), bool)
        first[1:] = _PARTED[5 * kind[:-1] + kind[1:]]
        first[1:] &= (data[:-1] != 39) | (kind[1:] != 1)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(first)
        cuts = np.append(start, len(data)).astype(np.int32)
        chunks = pa.StringArray.from_buffers(len(start), pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data)))
        coded = chunks.dictionary_encode()
        number = self._numbers(coded.dictionary)
        of, begin = coded.indices.to_numpy(), self.start[number]
        size = (self.start[number + 1] - begin)[of]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(begin[of] - (ends - size), size) + np.arange(int(ends[-1]))]
        bounds = np.concatenate(([0], ends))[np.searchsorted(start, offsets)]
        odd = self._odd_rows(data, offsets)
        if not odd:
            return ids, bounds
        rows = [ids[bounds[i] : bounds[i + 1]] for i in range(n)]
        for i in odd:
            rows[i] = self._whole(data[offsets[i] : offsets[i + 1]].tobytes())
        return np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _ranks(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """How many equal values stood earlier; ``before`` counts those of earlier calls and is brought up to date."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    begin = np.flatnonzero(np.diff(v, prepend=-1))
    size = np.diff(np.append(begin, len(v)))
    rank = np.empty(len(v), np.int64)
    rank[order] = np.arange(len(v)) - np.repeat(begin, size)
    rank += before[values]
    before[v[begin]] += size
    return rank


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, seen: pieces of all documents, and how
    many pieces of the same length the task had before."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("seen", T.LongType()),
    ])

    def run(batches):
        part, before = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            keys = column(b, "doc_id")
            for lo, hi, data, offsets in slices(column(b, "text"), SLICE):
                ids, bounds = encoder(tokenizer).encode_slice(data, offsets)
                n = hi - lo
                ids = np.insert(ids, bounds[1:], END_ID)  # one end for each document
                begin, total = bounds[:-1] + np.arange(n), np.diff(bounds) + 1
                first = (total - 1) % capacity + 1
                count = (total - first) // capacity + 1
                row = np.repeat(np.arange(n), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = np.where(piece > 0, first[row] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first[row])
                raw, at = memoryview(ids.astype("<u4", copy=False).tobytes()), 4 * (begin[row] + start)
                crc = [zlib.crc32(raw[s:e]) for s, e in zip(at.tolist(), (at + 4 * length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(lo, n).take(pa.array(row)),
                        pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                        pa.array(np.full(len(row), part, np.int32)), pa.array(_ranks(length, before)),
                    ],
                    names=[f.name for f in schema],
                )

    return docs.select("doc_id", "text").mapInArrow(freeing(run), schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths of one sequence): how often which combination of lengths is packed."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    done: list[tuple[int, tuple[int, ...]]] = []

    def take(combination: tuple[int, ...]) -> None:
        lengths, need = np.unique(combination, return_counts=True)
        times = int((left[lengths] // need).min())
        if times:
            left[lengths] -= times * need
            done.append((times, combination))

    def pairs(total: int, most: int) -> np.ndarray:
        """Longer lengths a, longest first, with a and total - a both at hand."""
        a = np.arange(min(total - 1, most), (total - 1) // 2, -1)
        return a[(left[a] > 0) & (left[total - a] > 0)] if len(a) else a

    for length in range(capacity, 0, -1):
        gap = capacity - length
        if left[length] and not gap:
            take((length,))
        if left[length] and 0 < gap <= length:
            take((length, gap))
        if left[length] and gap > 1:
            for a in pairs(gap, length).tolist():
                take((length, a, gap - a))
                if not left[length]:
                    break
        if left[length] and gap > 2:
            for a in range(min(gap - 2, length), (gap - 1) // 3, -1):
                if not left[length]:
                    break
                if left[a]:
                    for b in pairs(gap - a, a).tolist():
                        take((length, a, b, gap - a - b))
                        if not left[length] or not left[a]:
                            break
    # residuals: groups of equal sequences, ordered by the gap they still have
    open_groups: list[tuple[int, int, tuple[int, ...]]] = []  # gap, times, lengths
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            at = bisect_left(open_groups, (length,))
            if at < len(open_groups):
                gap, times, lengths = open_groups.pop(at)
                m = min(n, times)
                if times > m:
                    insort(open_groups, (gap, times - m, lengths))
                insort(open_groups, (gap - length, m, (*lengths, length)))
                n -= m
            else:
                each = capacity // length
                times, rest = divmod(n, each)
                if times:
                    insort(open_groups, (capacity - each * length, times, (length,) * each))
                if rest:
                    insort(open_groups, (capacity - rest * length, 1, (length,) * rest))
                n = 0
    return done + [(times, lengths) for _, times, lengths in open_groups]


def places(packed: list[tuple[int, tuple[int, ...]]]) -> tuple[np.ndarray, ...]:
    """(length, first rank, first sequence, offset) of every slot of the plan, by length and rank."""
    rank: dict[int, int] = {}
    slots, sequence = [], 0
    for times, lengths in packed:
        offset = 0
        for length in lengths:
            slots.append((length, rank.get(length, 0), sequence, offset))
            rank[length] = rank.get(length, 0) + times
            offset += length
        sequence += times
    slots.sort()
    return tuple(np.array([s[i] for s in slots], np.int64) for i in range(4))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = keep(pieces(docs, tokenizer, capacity), "pieces")
    by_part = keep(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    # one row for each length: at most ``capacity``
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    held = docs.sparkSession.sparkContext.broadcast(places(plan(counts, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    schema = T.StructType([*cut.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        lengths, first, sequence, offset = held.value
        # slots are in order of (length, first rank): one number keeps that order
        shift = np.int64(1 << 50)
        keys = lengths * shift + first
        for b in batches:
            length = column(b, "length").to_numpy(zero_copy_only=False)
            rank = column(b, "rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, length * shift + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns[:5],
                    pa.array(sequence[at] + rank - first[at], pa.int64()),
                    pa.array(offset[at], pa.int64()),
                ],
                names=[f.name for f in schema],
            )

    ranked = cut.join(offsets, ["part", "length"]).select(
        *[f.name for f in schema[:5]], (F.col("earlier") + F.col("seen")).cast("long").alias("rank")
    )
    return ranked.mapInArrow(run, schema)
