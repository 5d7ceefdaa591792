"""SimHash near-duplicates: fingerprints of 64 bits, linked by pigeonring filtering.

Fingerprints are cut into four segments that stand in a ring. If two of them differ in at most
three bits, then from some segment on the differences of the first one, two, three and four
segments of the ring are within proportional budgets: at most 0, 1, 2 and 3 bits (the strong
form of the pigeonring principle). Two fingerprints are therefore candidates only if such a
chain exists. Its first step, an equal segment, and half of its second one (of two halves that
differ in one bit together, one is equal) are looked up as 24 equal bits: eight rows for each
fingerprint. Within a bucket the chain is followed step by step and the full Hamming distance
is taken only of those that stay within its budgets.

Documents with one fingerprint are one class, found by an aggregate that combines before its
shuffle. A bucket of up to ``TOGETHER`` fingerprints is compared in one task. Larger ones are
found by counting and their fingerprints dealt out by 28 more bits: at most three of the ten
remaining groups of four bits can differ, the budgets say which three, and so each choice of
three leaves 52 equal bits. No two fingerprints within three bits miss each other there, and
as only 12 bits are free a group can't hold more than 4,096 fingerprints, whatever the input.
A task writes at most one link for each fingerprint of a bucket: to the first one of those it
is connected with in that bucket. No pair is left out, no list of pairs is written.

A null, empty or blank text has no words and the fingerprint zero, which is linked like any
other. A text of fewer than three words is one shingle. Repeated rows and null doc_ids are
documents like others; the smallest doc_id is the smallest that is not null. doc_id may have
any type that has an order. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierflow.llm.batches import column, freeing, slices
from dossierflow.llm.components import components
from dossierflow.llm.hashing import SPACE
from dossierflow.llm.store import keep

SHINGLE, SEED = 3, 42
#: differing bits up to which fingerprints are linked, and segments of the ring
DISTANCE, SEGMENTS = 3, 4
#: fingerprints of a bucket that one task compares
TOGETHER = 4096
#: a class with at least one in ``SHARE`` of all documents is broadcast, so at most SHARE are
SHARE = 1024

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case words with one space after each: bytes, start and end of every word, first word of every row."""
    data = _LOWER[data]
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    start = np.flatnonzero(inside & ~before)
    length = np.diff(np.append(np.flatnonzero(inside).searchsorted(start), np.count_nonzero(inside)))
    end = np.cumsum(length + 1) - 1
    out = np.full(int(end[-1]) + 1 if len(end) else 0, 32, np.uint8)
    letters = np.ones(len(out), bool)
    letters[end] = False
    out[letters] = data[inside]
    return out, end - length, end, np.searchsorted(start, offsets)


def fingerprints(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Fingerprint of every row."""
    out, start, end, first = spaced(data, offsets)
    counts = np.diff(first)
    runs = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    row = np.repeat(np.arange(len(counts)), runs)
    lo = first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
    hi = lo + np.minimum(n, counts[row]) - 1
    raw, digest = out.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter(
        (digest(raw[s:e], SEED) for s, e in zip(start[lo].tolist(), end[hi].tolist())), np.uint64, len(lo)
    )
    result = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(runs)
    if len(some):
        cuts = (np.cumsum(runs) - runs)[some]
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
        over = (2 * ones > runs[some, None]).astype(np.uint8)
        result[some] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return result


def printed(docs: DataFrame) -> DataFrame:
    """doc_id, fp (as a signed long) of every document."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())])

    def run(batches):
        for b in batches:
            found = [fingerprints(data, offsets) for _, _, data, offsets in slices(column(b, "text"))]
            fp = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(freeing(run), schema)


# --- the ring -----------------------------------------------------------------------------

_WIDTH = 64 // SEGMENTS
_ALL = (1 << 64) - 1


def _segment(i: int) -> int:
    return ((1 << _WIDTH) - 1) << (_WIDTH * (i % SEGMENTS))


def budgets(distance: int = DISTANCE, segments: int = SEGMENTS) -> list[int]:
    """Bits by which the first 1, 2, ... segments of a chain may differ together."""
    return [length * distance // segments for length in range(1, segments + 1)]


def chain(start: int) -> list[tuple[int, int]]:
    """(mask, budget) of every step of the chain that begins at a segment."""
    mask, steps = 0, []
    for length, budget in enumerate(budgets()):
        mask |= _segment(start + length)
        steps.append((mask, budget))
    return steps


def _half(kind: int) -> int:
    """Bits that are equal in a bucket of a kind: a segment and half of the next one."""
    start, upper = divmod(kind, 2)
    half = ((1 << _WIDTH // 2) - 1) << (_WIDTH * ((start + 1) % SEGMENTS) + _WIDTH // 2 * upper)
    return _segment(start) | half


KINDS = 2 * SEGMENTS
EQUAL = [_half(kind) for kind in range(KINDS)]


def _fours(mask: int) -> list[int]:
    return [15 << at for at in range(0, 64, 4) if mask >> at & 15]


def free_parts(kind: int) -> list[int]:
    """Masks of the 12 bits that may differ in the finer groups of a bucket of a kind: the choices
    of three groups of four bits that the budgets of the chain allow."""
    steps = chain(kind // 2)
    out = []
    for some in combinations(_fours(_ALL & ~EQUAL[kind]), DISTANCE):
        if all(sum(bool(part & mask) for part in some) <= budget for mask, budget in steps):
            out.append(sum(some))
    return out


FREE = [free_parts(kind) for kind in range(KINDS)]


def linked(fp: np.ndarray, kind: int) -> np.ndarray:
    """Which pairs of the fingerprints of one bucket are linked by the chain of its kind."""
    out = np.zeros((len(fp), len(fp)), bool)
    for lo in range(0, len(fp), 256):
        x = fp[lo : lo + 256, None] ^ fp[None, :]
        (_, _), (mask, budget), *rest = chain(kind // 2)
        i, j = np.nonzero(np.bitwise_count(x & np.uint64(mask)) <= budget)
        x = x[i, j]
        for mask, budget in rest:
            stay = np.bitwise_count(x & np.uint64(mask)) <= budget
            i, j, x = i[stay], j[stay], x[stay]
        out[lo + i, j] = True
    return out


def spanning(links: np.ndarray) -> np.ndarray:
    """For each member the first one it is connected with."""
    n = len(links)
    label = np.arange(n, dtype=np.int32)
    while True:
        near = np.empty_like(label)
        for lo in range(0, n, 256):
            near[lo : lo + 256] = np.where(links[lo : lo + 256], label[None, :], n).min(axis=1, initial=n)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(table: pa.Table):
    """Links (a, b) within each group of a table sorted by kind and the bits that are equal."""
    kind, equal = table["kind"].to_numpy(), table["equal"].to_numpy()
    fp = table["fp"].to_numpy().view(np.uint64)
    part = table["part"].to_numpy()
    new = np.ones(len(fp), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (part[1:] != part[:-1]) | (equal[1:] != equal[:-1])
    cuts = np.append(np.flatnonzero(new), len(fp))
    a, b = [], []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if hi - lo > 1:
            own = fp[lo:hi]
            label = spanning(linked(own, int(kind[lo])))
            moved = label != np.arange(hi - lo)
            a.append(own[moved])
            b.append(own[label[moved]])
    empty = np.zeros(0, np.uint64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([empty, *x]).view(np.int64)) for x in (a, b)], names=["a", "b"]
    )


def _compared(groups: DataFrame, parts: int) -> DataFrame:
    """(a, b): links in groups (kind, part, equal) of fingerprints fp, none of more than TOGETHER."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= 4 * TOGETHER:
                table = pa.Table.from_batches(held)
                last = table.slice(len(table) - 1).to_pylist()[0]
                tail = np.ones(len(table), bool)
                for c in ("kind", "part", "equal"):
                    tail &= table[c].to_numpy() == last[c]
                whole = int(np.argmax(tail))  # the last group may go on
                yield _links(table.slice(0, whole))
                held, rows = table.slice(whole).to_batches(), len(table) - whole
        if held:
            yield _links(pa.Table.from_batches(held))

    dealt = groups.repartition(parts, "kind", "part", "equal").sortWithinPartitions("kind", "part", "equal", "fp")
    return dealt.select("kind", "part", "equal", "fp").mapInArrow(freeing(run), "a long, b long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(classes: DataFrame, together: int = TOGETHER) -> DataFrame:
    """(a, b): links that connect exactly those distinct fingerprints fp that a path of links connects."""
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = [F.struct(F.lit(k).alias("kind"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("equal")) for k, m in enumerate(EQUAL)]
    placed = keep(classes.select("fp", F.inline(F.array(*kinds))), "buckets")
    sizes = keep(placed.groupBy("kind", "equal").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    small = sizes.where(F.col("n") <= together).select("kind", "equal")
    large = sizes.where(F.col("n") > together).select("kind", "equal")
    whole = placed.join(small, ["kind", "equal"], "left_semi").withColumn("part", F.lit(-1))
    finer = F.array(*[
        F.when(F.col("kind") == k, F.array(*[F.lit(_signed(_ALL & ~m)) for m in masks])) for k, masks in enumerate(FREE)
    ])
    split = (
        placed.join(large, ["kind", "equal"], "left_semi")
        .select("fp", "kind", F.posexplode(finer[F.col("kind")]).alias("part", "mask"))
        .select("fp", "kind", "part", F.col("fp").bitwiseAND(F.col("mask")).alias("equal"))
    )
    found = _compared(whole, parts)
    if not large.isEmpty():
        found = found.unionByName(_compared(split, parts))
    return found.distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    rows = keep(printed(docs), "fingerprints")
    classes = keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    label = components(links(classes)).select(F.col("node").alias("fp"), "label")
    named = classes.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    first = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = keep(named.join(first, "label").select("fp", "n", "component_id"), "named")
    total = named.agg(F.sum("n")).first()[0] or 0
    common = F.col("n") * SHARE >= total
    usual, often = named.where(~common).select("fp", "component_id"), named.where(common).select("fp", "component_id")
    # common classes are at most SHARE, so their many rows stay where they are
    mine = rows.join(F.broadcast(often.withColumnRenamed("component_id", "common_id").withColumn("is_common", F.lit(True))), "fp", "left")
    there = mine.where("is_common").select("doc_id", "fp", F.col("common_id").alias("component_id"))
    rest = mine.where("is_common is null").select("doc_id", "fp").join(usual, "fp")
    return there.unionByName(rest).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
