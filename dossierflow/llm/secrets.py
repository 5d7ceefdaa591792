"""Secret scan: fixed patterns, and formats learnt by grammar inference.

The matches of three patterns are labelled credentials. For each kind, a prefix tree of them
is folded into a probabilistic automaton: two states are merged when their counts of ending,
of going on by each kind of character and of each character agree within a Hoeffding bound, and so
do all states below. The tree branches by kind (capital, small letter, digit, each sign its own), the
characters of a kind are counted in its states, so that few credentials show lengths and places of signs.
Every maximal run of ``MIN_LENGTH`` credential characters and more in every text is then a
candidate, whatever its characters; it is scored by the mean log likelihood of its characters
under each automaton. It is a secret as well if some automaton finds it as likely as the
credentials it was made from, and ``RATIO`` times likelier than the ``Background`` does: an
automaton with a state for each last character, counted on all runs of the table, of any
length, outside the matches. So ordinary words and numbers are turned down for being ordinary.

Automata are fitted on at most ``SAMPLE`` distinct credentials of each kind (of long ones the
windows that scoring uses, too), the first in the order of a hash; everything else, the background too, covers all rows. Matches of the patterns always stay; learnt
spans that touch one are left out. A null text counts as empty, empty texts have no spans,
repeated rows are scanned one by one, an empty table gives no rows, other columns are ignored.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierflow.llm.batches import column
from dossierflow.llm.store import keep

#: distinct credentials of a kind that an automaton is fitted on at most, and slices they are taken from
SAMPLE, SLICES = 400, 40
#: significance of a merge: the smaller, the more states are merged
ALPHA = 0.05
#: the score of a candidate reaches that of this share of the credentials of a kind
SHARE = 0.99
#: shortest candidate
MIN_LENGTH = 12
#: a secret is so many times likelier a credential than an ordinary run
RATIO = 1_000.0
#: longest string that is learnt from or scored by its characters one by one; longer ones are scored in windows of this length
WINDOW = 256

# fixed patterns: name, pattern, group that has a least length, that length
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ["assign", "access", "hex"]
LEARNT = "format"
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % MIN_LENGTH)
_ASSIGN_HINT = re.compile(r"[:=]")


def base(text: str) -> list[tuple[int, int, str, str]]:
    """start, end, kind and credential of all fixed matches, by start and kind."""
    out = []
    if _ASSIGN_HINT.search(text):
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


_ORDINARY = "ordinary"
_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_CODE = np.zeros(256, np.int64)
_CODE[list(_CHARACTERS.encode())] = np.arange(1, len(_CHARACTERS) + 1)
_STATES = len(_CHARACTERS) + 1
# start of a run, capitals, small letters, digits, signs: which states belong to them
_CLASS = (np.searchsorted([0, 26, 52, 62], np.arange(_STATES)) == np.arange(5)[:, None]).astype(float)


def pairs(text: str) -> np.ndarray:
    """How often a credential character follows another, or starts a run, outside the fixed matches."""
    found = base(text)
    if found:
        out, at = [], 0
        for s, e, _, _ in found:
            if s > at:
                out.append(text[at:s])
            at = max(at, e)
        text = " ".join([*out, text[at:]])
    codes = _CODE[np.frombuffer(b" " + text.encode("utf-8", "replace"), np.uint8)]
    return np.bincount(codes[:-1] * _STATES + codes[1:], minlength=_STATES * _STATES)


class Background:
    """Automaton of ordinary runs: its state is the last character, 0 before the first."""

    def __init__(self, counts: np.ndarray):
        counts = counts.reshape(_STATES, _STATES)[:, 1:].astype(float)
        single = counts.sum(0)
        share = (single + 1) / (single.sum() + len(_CHARACTERS))
        # words and numbers are ordinary without having all their pairs in the table: a fifth, and all where a
        # state has few counts, by how kinds of characters follow each other
        after = _CLASS @ counts @ _CLASS[:, 1:].T + (np.arange(5) > 0) * 0.5
        after /= after.sum(1, keepdims=True)
        within = _CLASS[:, 1:] * share
        within /= np.maximum(within.sum(1, keepdims=True), 1e-300)
        prior = _CLASS.T @ after @ within
        logs = np.log(0.8 * (counts + 10 * prior) / (counts.sum(1, keepdims=True) + 10) + 0.2 * prior)
        self.first = dict(zip(_CHARACTERS, logs[0].tolist()))
        self.next = {a + b: p for a, row in zip(_CHARACTERS, logs[1:].tolist()) for b, p in zip(_CHARACTERS, row)}

    def score(self, word: str) -> float:
        """Mean log likelihood of a character."""
        pair = self.next
        return (self.first[word[0]] + sum([pair[word[i : i + 2]] for i in range(len(word) - 1)])) / len(word)


# kind of each character: one for capitals, small letters and digits, signs stand for themselves
_KIND = {c: "A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else c for c in _CHARACTERS}
_SIZE = {k: list(_KIND.values()).count(k) for k in _KIND.values()}


class Automaton:
    """Probabilistic automaton: for each state how often strings end there, go on by a kind of character, and by
    which. ``go`` is by kind."""

    KINDS = 9  # capitals, small letters, digits and signs

    def __init__(self, words: list[str], alpha: float = ALPHA):
        words = [part for w in words for part in windows(w)]
        self.ends: list[int] = [0]
        self.go: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.chars: list[dict[str, int]] = [{}]
        for w in words:
            s = 0
            for c in w:
                k = _KIND[c]
                self.count[s][k] = self.count[s].get(k, 0) + 1
                self.chars[s][c] = self.chars[s].get(c, 0) + 1
                if k not in self.go[s]:
                    self.go[s][k] = len(self.go)
                    self.go.append({})
                    self.count.append({})
                    self.chars.append({})
                    self.ends.append(0)
                s = self.go[s][k]
            self.ends[s] += 1
        self._infer(math.sqrt(0.5 * math.log(2 / alpha)))
        self._compact()
        scores = sorted(self.score(w) for w in set(words))
        self.threshold = scores[int((1 - SHARE) * len(scores))] if scores else math.inf
        self.states = len(self.go)

    def _compact(self) -> None:
        """Keep the states that are reached from the first, numbered in this order."""
        order, number = [0], {0: 0}
        for s in order:
            for k in sorted(self.go[s]):
                if self.go[s][k] not in number:
                    number[self.go[s][k]] = len(order)
                    order.append(self.go[s][k])
        self.go = [{k: number[t] for k, t in self.go[s].items()} for s in order]
        self.ends = [self.ends[s] for s in order]
        self.count = [self.count[s] for s in order]
        self.chars = [self.chars[s] for s in order]

    def _total(self, s: int) -> int:
        return self.ends[s] + sum(self.count[s].values())

    def _compatible(self, a: int, b: int, bound: float) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self._total(a), self._total(b)
            if not n or not m:
                continue
            limit = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[a] / n - self.ends[b] / m) > limit:
                return False
            for held in (self.count, self.chars):
                for c in held[a].keys() | held[b].keys():
                    if abs(held[a].get(c, 0) / n - held[b].get(c, 0) / m) > limit:
                        return False
            todo += [(self.go[a][k], self.go[b][k]) for k in self.go[a].keys() & self.go[b].keys()]
        return True

    def _fold(self, red: int, blue: int) -> None:
        """Add the tree below ``blue`` to the states from ``red`` on."""
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for c, n in self.chars[b].items():
                self.chars[a][c] = self.chars[a].get(c, 0) + n
            for k, n in self.count[b].items():
                self.count[a][k] = self.count[a].get(k, 0) + n
                if k in self.go[a]:
                    todo.append((self.go[a][k], self.go[b][k]))
                else:
                    self.go[a][k] = self.go[b][k]

    def _infer(self, bound: float) -> None:
        red = [0]
        while True:
            inside = set(red)
            blue = [(s, c) for s in red for c in sorted(self.go[s]) if self.go[s][c] not in inside]
            if not blue:
                return
            # the state most strings pass is judged first
            s, c = max(blue, key=lambda x: self._total(self.go[x[0]][x[1]]))
            b = self.go[s][c]
            for r in red:
                if self._compatible(r, b, bound):
                    self.go[s][c] = r
                    self._fold(r, b)
                    break
            else:
                red.append(b)

    def compile(self) -> "Automaton":
        self.logs = []
        for s in range(len(self.go)):
            n = self._total(s) + 0.05 * self.KINDS
            known = {}
            for k, t in self.go[s].items():
                m, size = self.count[s][k], _SIZE[k]
                for c in (c for c in _CHARACTERS if _KIND[c] == k):
                    share = (self.chars[s].get(c, 0) + 2 / size) / (m + 2)
                    known[c] = (math.log((m + 0.05) / n * share), t)
            self.logs.append((known, {c: math.log(0.05 / n / _SIZE[_KIND[c]]) for c in _CHARACTERS if c not in known}))
        return self

    def mean(self, part: str) -> float:
        if not hasattr(self, "logs"):
            self.compile()
        state, total = 0, 0.0
        for c in part:
            known, unknown = self.logs[state]
            p, state = known.get(c) or (unknown[c], 0)
            total += p
        return total / len(part)

    def score(self, word: str) -> float:
        """Mean log likelihood of a character; that of the likeliest window of a long word."""
        return max(self.mean(part) for part in windows(word))


def windows(word: str) -> list[str]:
    """``word``, or windows of full length that overlap by half at least, the last one at its end."""
    last = len(word) - WINDOW
    if last <= 0:
        return [word]
    return [word[i : i + WINDOW] for i in [*range(0, last, WINDOW // 2), last]]


def _found(docs: DataFrame) -> DataFrame:
    """kind, credential, n: the fixed matches, and the counts of ``pairs`` as kind ordinary."""

    def run(batches):
        counts = np.zeros(_STATES * _STATES, np.int64)
        for b in batches:
            texts = [t for t in column(b, "text").to_pylist() if t]
            found = {(k, part) for t in texts for _, _, k, c in base(t) for part in windows(c)}
            for t in texts:
                counts += pairs(t)
            yield _rows([k for k, _ in found], [c for _, c in found], [0] * len(found))
        some = np.flatnonzero(counts)
        yield _rows([_ORDINARY] * len(some), some.astype(str).tolist(), counts[some].tolist())

    return docs.select("text").mapInArrow(run, "kind string, credential string, n long")


def _rows(kinds: list[str], found: list[str], n: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.string()), pa.array(found, pa.string()), pa.array(n, pa.int64())],
        names=["kind", "credential", "n"],
    )


def _distinct(docs: DataFrame) -> DataFrame:
    return _found(docs).groupBy("kind", "credential").agg(F.sum("n").alias("n"))


def _sample(rows: DataFrame) -> DataFrame:
    # the first by hash of each of SLICES slices of a kind: no kind meets in one task
    rows = rows.where(F.col("kind") != _ORDINARY)
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("credential", F.lit(1)), F.lit(SLICES)))
    part = Window.partitionBy("kind", "slice").orderBy(F.xxhash64("credential"), "credential")
    return (
        rows.withColumn("place", F.row_number().over(part))
        .where(F.col("place") <= SAMPLE // SLICES)
        .select("kind", "credential")
    )


def credentials(docs: DataFrame) -> DataFrame:
    """kind, credential: distinct fixed matches, at most SAMPLE of each kind, by hash."""
    return _sample(_distinct(docs))


class Learnt(dict):
    """Automata by kind, and the background of the runs around the credentials."""

    background: Background

    def __reduce__(self):
        return _learnt, (dict(self), self.background)


def _learnt(automata: dict[str, Automaton], background: Background) -> Learnt:
    out = Learnt(automata)
    out.background = background
    return out


def learn(docs: DataFrame) -> Learnt:
    rows = keep(_distinct(docs), "candidates")
    by_kind: dict[str, list[str]] = defaultdict(list)
    for r in _sample(rows).collect():
        by_kind[r.kind].append(r.credential)
    counts = np.zeros(_STATES * _STATES, np.int64)
    for r in rows.where(F.col("kind") == _ORDINARY).collect():
        counts[int(r.credential)] = r.n
    return _learnt({k: Automaton(sorted(by_kind[k])).compile() for k in KINDS if by_kind[k]}, Background(counts))


def secret(word: str, automata: Learnt) -> bool:
    """Whether a window of ``word`` looks like the credentials of a kind, and not like ordinary runs."""
    for part in windows(word):
        least = automata.background.score(part) + math.log(RATIO) / len(part)
        if any((p := a.mean(part)) >= a.threshold and p >= least for a in automata.values()):
            return True
    return False


def scan(text: str, automata: Learnt) -> list[tuple[int, int, str]]:
    """start, end, kind of all secrets: fixed ones and candidates with a learnt format."""
    fixed = [(s, e, k) for s, e, k, _ in base(text)]
    out, at, covered = list(fixed), 0, 0
    for m in _CANDIDATE.finditer(text):  # both are in the order of their starts
        s, e = m.span()
        while at < len(fixed) and fixed[at][0] < e:
            covered = max(covered, fixed[at][1])
            at += 1
        if covered <= s and secret(m[0], automata):
            out.append((s, e, LEARNT))
    order = [*KINDS, LEARNT]
    return sorted(out, key=lambda x: (x[0], order.index(x[2])))


def find(docs: DataFrame, automata: Learnt | None = None) -> DataFrame:
    """doc_id, counts of fixed matches, their digest and all spans of every document."""
    automata = learn(docs) if automata is None else automata
    held = docs.sparkSession.sparkContext.broadcast(automata)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
    ])

    def run(batches):
        for b in batches:
            rows = [scan(t, held.value) if t else [] for t in column(b, "text").to_pylist()]
            text = [[f"{k}:{s}:{e}" for s, e, k in r if k != LEARNT] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    column(b, "doc_id"),
                    *[pa.array([sum(k == x[2] for x in r) for r in rows], pa.int64()) for k in KINDS],
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in text], pa.string()),
                    pa.array([",".join(f"{k}:{s}:{e}" for s, e, k in r) for r in rows], pa.string()),
                ],
                names=[f.name for f in schema],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)
