"""Similarity join of documents on sets of word n-grams: MinHash banding, exact verification.

Documents with equal n-gram sets are one class, which is joined once. Every class has a
MinHash signature; the number of rows in a band and of bands is chosen so that a pair at the
threshold shares a band with the target recall. Classes are shuffled by their band hashes and
every class of a bucket is linked to the smallest one of it, which costs one row for each
class, never one for each pair. Classes connected by such links are a candidate group. Full
n-gram sets are compared within candidate groups, each pair once, in blocks of bounded size:
a group of many classes is dealt to as many tasks as it has pairs of blocks, and what leaves a
task is one row for each class in it: its number of links, and an edge to the class it hangs
together with. No pair is left out, none is written.

A null text has no words. A text of fewer than n words has one n-gram, all its words. Texts
without words have no links and are classes of their own. Repeated rows are copies. An empty
table gives no rows; other columns are ignored by ``join`` and kept by ``dedup``.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierflow.llm.batches import column, freeing, slices
from dossierflow.llm.components import components
from dossierflow.llm.hashing import Words, mix, shingles
from dossierflow.llm.store import keep

N_GRAM = 5
#: similarity from which documents are linked, as a fraction, so that the comparison is exact
THRESHOLD = (4, 5)
#: share of the pairs at the threshold that must share a band, and rows of a band
RECALL, ROWS = 0.999, 7
#: classes and bytes of n-gram hashes in one block; a task compares two blocks
BLOCK, BLOCK_BYTES = 128, 16 << 20

_rng = np.random.default_rng(7)


def bands(recall: float = RECALL, rows: int = ROWS, threshold: tuple[int, int] = THRESHOLD) -> int:
    """Bands of ``rows`` values that pairs at the threshold share one of with the given probability."""
    p = (threshold[0] / threshold[1]) ** rows
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


BANDS = bands()
_XOR = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32, endpoint=False)
_MULTIPLY = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32, endpoint=False) | np.uint32(1)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def signatures(row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Band hashes (one line for each row that has n-grams, in order)."""
    cut = np.flatnonzero(np.diff(row, prepend=-1))
    small = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(cut), BANDS), np.uint64)
    for band in range(BANDS):
        h = np.full(len(cut), band + 1, np.uint64)
        for i in range(band * ROWS, (band + 1) * ROWS):
            least = np.minimum.reduceat((small ^ _XOR[i]) * _MULTIPLY[i], cut)
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + least)
        out[:, band] = h
    return out


def _sets(texts: pa.Array):
    """(row, sorted distinct n-gram hashes, row's band hashes as a line number) of each text with words."""
    for lo, _, data, offsets in slices(texts):
        row, h = shingles(Words(data, offsets), N_GRAM)
        if len(row):
            cut = np.flatnonzero(np.diff(row, prepend=-1))
            yield lo, row, h, cut, np.append(cut[1:], len(row))


def _digest(values: np.ndarray) -> tuple[int, int]:
    raw = hashlib.blake2b(values.astype("<u8").tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def signed(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, key, node, rest, size, bands of every document.

    key finds the document again (doc_id, or a hash of its text where that is null); node and
    rest are the two halves of the digest of its n-gram set, null without words.
    """
    schema = T.StructType([
        T.StructField("row_id", T.LongType()),
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        T.StructField("key", T.LongType()),
        T.StructField("node", T.LongType()),
        T.StructField("rest", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ])

    def run(batches):
        for b in batches:
            n = b.num_rows
            node, rest, size, lines = [None] * n, [None] * n, [0] * n, [None] * n
            for lo, row, h, start, end in _sets(column(b, "text")):
                sig = _signed(signatures(row, h))
                for j, (s, e) in enumerate(zip(start.tolist(), end.tolist())):
                    i = lo + int(row[s])
                    values = np.unique(h[s:e])
                    node[i], rest[i] = _digest(values)
                    size[i], lines[i] = len(values), sig[j]
            yield pa.RecordBatch.from_arrays(
                [
                    column(b, "row_id"), column(b, "doc_id"), column(b, "key"),
                    pa.array(node, pa.int64()), pa.array(rest, pa.int64()), pa.array(size, pa.int64()),
                    pa.array(lines, pa.list_(pa.int64())),
                ],
                names=[f.name for f in schema],
            )

    return keep(docs.select("row_id", "doc_id", _key(docs), "text").mapInArrow(freeing(run), schema), "signed")


def _key(docs: DataFrame):
    """A number that finds a document again: its doc_id if that is one, else a hash."""
    whole = isinstance(docs.schema["doc_id"].dataType, T.IntegralType)
    own = F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    return F.coalesce(own, F.xxhash64("text")).alias("key")


def candidates(classes: DataFrame) -> DataFrame:
    """(node, group) of classes that share a bucket with another, directly or through others.

    Each class hangs on the smallest of the leaders of its buckets, which is one row for each
    class; only distinct pairs of leaders are connected, however many classes meet in a bucket.
    """
    placed = classes.select("node", F.explode("bands").alias("bucket"))
    buckets = (
        placed.groupBy("bucket")
        .agg(F.min("node").alias("least"), F.max("node").alias("most"))
        .where("least < most")
        .select("bucket", "least")
    )
    # at most BANDS leaders for each class
    led = keep(
        placed.join(buckets, "bucket").groupBy("node").agg(F.min("least").alias("leader"), F.collect_set("least").alias("leaders")),
        "led",
    )
    pairs = led.select(F.col("leader").alias("a"), F.explode("leaders").alias("b")).where("a <> b").distinct()
    label = components(pairs).withColumnRenamed("node", "leader")
    return led.join(label, "leader", "left").select("node", F.coalesce("label", "leader").alias("group"))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of some sets of distinct values."""
    n = len(sets)
    shared = np.zeros((n, n))
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count >= 2
    place, owner = place[several[place]], owner[several[place]]
    place = (np.cumsum(several) - 1)[place]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    for lo in range(0, int(several.sum()), 4096):
        a, b = np.searchsorted(place, [lo, lo + 4096])
        m = np.zeros((n, 4096), np.float32)
        m[owner[a:b], place[a:b] - lo] = 1
        shared += m @ m.T
    return shared.astype(np.int64)


def similar(sets: list[np.ndarray], threshold: tuple[int, int] = THRESHOLD) -> np.ndarray:
    """Which pairs reach the threshold, the diagonal left out."""
    shared = overlaps(sets)
    size = np.array([len(s) for s in sets])
    either = size[:, None] + size[None, :] - shared
    out = shared * threshold[1] >= either * threshold[0]
    np.fill_diagonal(out, False)
    return out


def _spanning(linked: np.ndarray) -> np.ndarray:
    """For each member the smallest member it is connected with."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verify(docs: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """node, rest, links (documents), class_links and another node of the same component, if any,
    for each class and block pair in which it has links."""
    members = classes.join(groups, "node").select("node", "rest", "key", "size", "copies", "group")
    members = keep(members, "members")
    dealt = members.groupBy("group").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") * 8 / BLOCK_BYTES), F.lit(1)
        ).alias("blocks")
    )
    members = members.join(dealt, "group").withColumn("block", F.pmod(F.xxhash64("node", "rest"), "blocks"))
    schema = T.StructType([
        *[T.StructField(c, T.LongType()) for c in ("node", "rest", "copies", "group", "block", "blocks")],
        T.StructField("grams", T.BinaryType()),
    ])

    def read(batches):
        for b in batches:
            grams = {lo + int(row[s]): np.unique(h[s:e]) for lo, row, h, start, end in _sets(column(b, "text"))
                     for s, e in zip(start.tolist(), end.tolist())}
            node, rest = column(b, "node").to_pylist(), column(b, "rest").to_pylist()
            # another row of the same key may hold another text
            own = [i for i, v in grams.items() if _digest(v) == (node[i], rest[i])]
            rows = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *[column(b, c).take(rows) for c in ("node", "rest", "copies", "group", "block", "blocks")],
                    pa.array([grams[i].astype("<u8").tobytes() for i in own], pa.binary()),
                ],
                names=[f.name for f in schema],
            )

    named = members.select("key", "node", "rest", "copies", "group", "block", "blocks")
    # members can be a third of all documents: one plan at every size, and no sort of texts
    sets = docs.select(_key(docs), "text").join(named.hint("shuffle_hash"), "key").drop("key").mapInArrow(freeing(read), schema)
    pairs = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))).select(
        "node", "rest", "copies", "group", "block", "grams",
        F.least("block", F.col("other").cast("long")).alias("lo"),
        F.greatest("block", F.col("other").cast("long")).alias("hi"),
    )
    out = "node long, rest long, links long, class_links long, other long"

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        seen: dict[tuple[int, int], int] = {}
        for i, x in enumerate(zip(table["node"].to_pylist(), table["rest"].to_pylist())):
            seen.setdefault(x, i)
        at = list(seen.values())
        sets_ = [np.frombuffer(g.as_py(), "<u8") for g in table["grams"].take(pa.array(at, pa.int64()))]
        block = table["block"].to_numpy()[at]
        copies = table["copies"].to_numpy()[at]
        linked = similar(sets_)
        if table["lo"][0].as_py() != table["hi"][0].as_py():
            linked &= block[:, None] != block[None, :]
        node = np.array([x[0] for x in seen], np.int64)
        some = np.flatnonzero(linked.any(axis=1))
        return pa.table({
            "node": node[some],
            "rest": np.array([x[1] for x in seen], np.int64)[some],
            "links": (linked * copies[None, :]).sum(axis=1)[some],
            "class_links": linked.sum(axis=1)[some],
            "other": node[_spanning(linked)][some],
        })

    return keep(pairs.groupBy("group", "lo", "hi").applyInArrow(compare, out), "links")


def resolved(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, class_id, copy_id, n_copies, n_links, n_class_links and the preferred row
    of its component for every row of ``docs``, which has a column row_id."""
    rows = signed(docs)
    best = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")
    classes = keep(
        rows.where("node is not null")
        .groupBy("node", "rest")
        .agg(
            F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"),
            F.first("bands").alias("bands"), F.min(best).alias("best"),
        ),
        "classes",
    )
    links = verify(docs, classes, candidates(classes))
    found = links.groupBy("node", "rest").agg(F.sum("links").alias("links"), F.sum("class_links").alias("class_links"))
    label = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    joined = keep(
        classes.drop("bands", "key", "size")
        .join(found, ["node", "rest"], "left")
        .join(label, "node", "left")
        .withColumn("label", F.coalesce("label", "node")),
        "joined",
    )
    # components of a single class need no second look
    first = joined.where("links is not null").groupBy("label").agg(F.min("best").alias("group_best"))
    whole = joined.join(first, "label", "left").select(
        "node", "rest", "copies", "links", "class_links", "best", F.coalesce("group_best", "best").alias("group_best")
    )
    alone = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")
    with_words = rows.where("node is not null").select("row_id", "doc_id", "node", "rest")
    linked = with_words.join(whole, ["node", "rest"]).select(
        "row_id", "doc_id",
        F.col("group_best.doc_id").alias("class_id"),
        F.col("best.doc_id").alias("copy_id"),
        F.col("copies").alias("n_copies"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("class_links", F.lit(0)).alias("n_class_links"),
        "group_best",
    )
    zero = F.lit(0).cast("long")
    empty = rows.where("node is null").select(
        "row_id", "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"),
        F.lit(1).cast("long").alias("n_copies"), zero.alias("n_links"), zero.alias("n_class_links"),
        alone.alias("group_best"),
    )
    return linked.unionByName(empty)


def join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id it is connected with), copy_id (smallest doc_id with the
    same n-gram set), n_copies, n_links (documents linked with it) and n_class_links (other
    n-gram sets linked with its own) of every document."""
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row_id"))
    return resolved(numbered).drop("row_id", "group_best")


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each connected group does, all columns."""
    columns = docs.columns
    tagged = keep(docs.select(F.struct(*[docs[c] for c in columns]).alias("doc"),
                              F.monotonically_increasing_id().alias("row_id")), "rows")
    rows = tagged.select(F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"), "row_id")
    gone = resolved(rows).where(F.col("row_id") != F.col("group_best.row_id")).select("row_id")
    return tagged.join(gone.hint("shuffle_hash"), "row_id", "left_anti").select(*[F.col("doc").getField(c).alias(c) for c in columns])
