"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A document is a bag of sentences. A sentence's score is a logistic function of the words in
it; a document's is the noisy-or of its sentences and of a small leak (toxic for a reason no
sentence shows):  p = 1 - (1 - leak) * prod(1 - p_sentence).  The weights are trained on that
likelihood from document labels alone, and the same weights then locate the sentences.

Words of a model are those that in the training rows occur in ``MIN_DOCS`` documents at least
and are much more frequent under label 1, by odds ratio and chi-square, so that the choice
does not hang on how many labels are toxic; a sentence without any has score 0, so a long
document is not more suspect than a short one.

Labels are learnt only from rows whose crc32 of the doc_id as text leaves a remainder other
than 0 by ``FOLDS``, and from at most ``SAMPLE`` of them, the first in the order of a hash
of the doc_id. Several labels of one doc_id count as toxic if one is. Null labels and ids are
left out of training; a null doc_id is not held out. A null text scores as an empty one: the
leak. Without any positive label all scores are 0. Repeated rows are scored one by one.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierflow.llm.batches import as_bytes, column, freeing
from dossierflow.llm.store import keep

#: labelled rows that a model is fitted on at most
SAMPLE = 20_000
#: every fifth labelled row is never learnt from
FOLDS = 5
#: a word of the model occurs in so many training documents, has so many times the odds of label 1 that
#: documents without it have, and stands so many standard deviations above what chance gives, ...
MIN_DOCS, MIN_LIFT, MIN_STRENGTH = 5, 2.0, 4.0
#: ... and the model has so many words at most, those with the strongest association
MAX_WORDS = 2_000
#: steps and step size of the fit, and the precision of the weights' normal prior around 0
STEPS, RATE, PRECISION = 400, 0.1, 0.25

_END = b".!?\n\r"
_TABLE = bytes(
    10 if b in _END
    else b + 32 if 65 <= b <= 90
    else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122
    else 32
    for b in range(256)
)


def sentences(text: bytes) -> list[list[bytes]]:
    return [ws for s in text.translate(_TABLE).split(b"\n") if (ws := s.split())]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


class Model:
    """Weights by word, the bias of a sentence that has any of them, and the leak."""

    def __init__(self, weights: dict[bytes, float], bias: float, leak: float):
        self.weights, self.bias, self.leak = weights, bias, leak

    def sentence(self, ws: list[bytes]) -> float:
        z = [self.weights[w] for w in set(ws) if w in self.weights]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(z) + self.bias)))) if z else 0.0

    def score(self, text: bytes) -> float:
        clean = 1 - self.leak
        if not self.weights.keys().isdisjoint(text.translate(_TABLE).split()):
            for ws in sentences(text):
                clean *= 1 - self.sentence(ws)
        return 1 - clean

    def spans(self, text: str, threshold: float = 0.5) -> list[tuple[int, int, float]]:
        """Start and end (code points) and score of the sentences that reach ``threshold``."""
        out = []
        for m in re.finditer(r"[^.!?\n\r]+", text):
            p = self.sentence(m[0].encode("utf-8", "replace").translate(_TABLE).split())
            if p >= threshold:
                out.append((m.start(), m.end(), p))
        return out


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of the labelled documents that a model is fitted on."""
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(SAMPLE)
    )
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("text", "toxic")


def _word_counts(rows: DataFrame) -> DataFrame:
    """word, documents with it under label 1 and in all."""

    def run(batches):
        for b in batches:
            counts: dict[bytes, list[int]] = {}
            for text, toxic in zip(as_bytes(column(b, "text")), column(b, "toxic").to_pylist()):
                for w in {w for ws in sentences(text.as_py()) for w in ws}:
                    c = counts.setdefault(w, [0, 0])
                    c[0] += toxic
                    c[1] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(counts), pa.binary()),
                    pa.array([c[0] for c in counts.values()], pa.int64()),
                    pa.array([c[1] for c in counts.values()], pa.int64()),
                ],
                names=["word", "bad", "n"],
            )

    return (
        rows.mapInArrow(freeing(run), "word binary, bad long, n long")
        .groupBy("word")
        .agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    )


def _bags(rows: DataFrame, chosen: dict[bytes, int]) -> DataFrame:
    """For each training document its label and its sentences as lists of chosen words, emptied ones left out."""

    def run(batches):
        for b in batches:
            bags = []
            for text in as_bytes(column(b, "text")):
                found = [sorted({chosen[w] for w in ws if w in chosen}) for ws in sentences(text.as_py())]
                bags.append([s for s in found if s])
            yield pa.RecordBatch.from_arrays(
                [column(b, "toxic"), pa.array(bags, pa.list_(pa.list_(pa.int32())))], names=["toxic", "bag"]
            )

    return rows.mapInArrow(run, "toxic int, bag array<array<int>>")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_bags(labels: np.ndarray, bags: list[list[list[int]]], size: int) -> tuple[np.ndarray, float, float]:
    """Weights, bias and leak that maximise the noisy-or likelihood, by Adam."""
    sent_doc = np.array([d for d, bag in enumerate(bags) for _ in bag], np.int64)
    sent_len = np.array([len(s) for bag in bags for s in bag], np.int64)
    word = np.array([w for bag in bags for s in bag for w in s], np.int64)
    word_sent = np.repeat(np.arange(len(sent_len)), sent_len)
    n = len(labels)
    theta = np.concatenate([np.zeros(size), [-2.0, math.log((labels.mean() / 2 + 1e-4) / (1 - labels.mean() / 2))]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, STEPS + 1):
        p = _sigmoid(np.bincount(word_sent, theta[word], len(sent_len)) + theta[size])
        leak = _sigmoid(theta[size + 1])
        clean = np.exp(np.bincount(sent_doc, np.log1p(-np.minimum(p, 1 - 1e-9)), n)) * (1 - leak)
        # derivative of the mean log likelihood by a document's summed log(1 - p)
        outer = np.where(labels == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0) / n
        by_sent = -outer[sent_doc] * p
        grad = np.concatenate([
            np.bincount(word, by_sent[word_sent], size) - PRECISION / n * theta[:size],
            [by_sent.sum(), (-outer * leak).sum()],
        ])
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        theta += RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:size], float(theta[size]), float(_sigmoid(theta[size + 1]))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = keep(training_rows(docs, labels), "training")
    totals = rows.agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n")).first()
    if not totals.bad:
        return Model({}, 0.0, 0.0)
    rate = totals.bad / totals.n
    good, others = totals.n - totals.bad, F.lit(totals.n) - F.col("n")
    # odds ratio and signed root of chi-square of word and label: neither has a ceiling that falls as the rate rises
    clean = F.col("n") - F.col("bad")
    lift = (
        (F.col("bad") + 0.5) * (F.lit(good + 0.5) - clean)
        / ((clean + 0.5) * (F.lit(totals.bad + 0.5) - F.col("bad")))
    )
    spread = F.sqrt(F.col("n") * others * F.lit(rate * (1 - rate) / totals.n))
    # a word of all documents tells nothing, nor does any word where all labels are alike
    strength = F.when(spread > 0, (F.col("bad") - F.col("n") * F.lit(rate)) / spread).otherwise(0.0)
    top = (
        _word_counts(rows)
        .where((F.col("n") >= MIN_DOCS) & (lift >= MIN_LIFT) & (strength >= MIN_STRENGTH))
        .orderBy(strength.desc(), "word")
        .limit(MAX_WORDS)
        .collect()
    )
    chosen = {bytes(r.word): i for i, r in enumerate(top)}
    if not chosen:
        return Model({}, 0.0, rate)
    sample = _bags(rows, chosen).collect()
    weights, bias, leak = fit_bags(np.array([r.toxic for r in sample]), [r.bag for r in sample], len(chosen))
    return Model({w: float(weights[i]) for w, i in chosen.items()}, bias, leak)


_SPAN = T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()),
]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the offending sentences (start, end, score) of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        T.StructField("score", T.DoubleType()),
        T.StructField("sentences", _SPAN),
    ])

    def run(batches):
        m = held.value
        for b in batches:
            texts = as_bytes(column(b, "text"))
            scores = [m.score(t.as_py()) for t in texts]
            spans = [
                [{"start": s, "end": e, "score": p} for s, e, p in m.spans(texts[i].as_py().decode("utf-8", "replace"))]
                if p > m.leak else []
                for i, p in enumerate(scores)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    column(b, "doc_id"),
                    pa.array(scores, pa.float64()),
                    pa.array(spans, pa.list_(pa.struct([
                        ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())
                    ]))),
                ],
                names=["doc_id", "score", "sentences"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, sentences of every document."""
    return score(docs, fit(docs, labels)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "sentences",
    )


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        m = held.value
        for b in batches:
            yield b.filter(pa.array([m.score(t.as_py()) < threshold for t in as_bytes(column(b, "text"))], pa.bool_()))

    columns = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in columns]).alias("doc"), docs["text"].alias("text"))
    return rows.mapInArrow(freeing(run), rows.schema).select(*[F.col("doc").getField(c).alias(c) for c in columns])
