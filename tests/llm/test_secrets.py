import hashlib
import random
import re

import pytest

from dossierflow.llm import secrets as sc

ASSIGN = re.compile(
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)


def brute(text):
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [x[2] for x in sorted(out)]


def corpus(n=400):
    rng = random.Random(2)
    pick = lambda a, k: "".join(rng.choice(a) for _ in range(k))
    rows = []
    for i in range(n):
        t = "some words of prose, é ñ and internationalisation2024x here "
        kind = i % 6
        if kind == 0:
            t += f"password={pick('0123456789abcdef', 18)} end"
        elif kind == 1:
            t += f"AKIA{pick('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 16)}"
        elif kind == 2:
            t += f'API_KEY: "{pick("0123456789abcdef", 40)}" secret = short token:token:abcdefghijklmnop'
        elif kind == 3:
            t += f"mail a.b{i}@example.com, 4{pick('0123456789', 15)}"
        rows.append((i, t))
    return rows


@pytest.fixture(scope="module")
def learnt(docs_of):
    return sc.learn(docs_of(corpus()))


def test_base_spans(docs_of, awkward, learnt):
    rows = corpus() + awkward + [(900, "PASSWORD='ABCdef-123456' toKen=abcdefghijkl AKIAAKIA" + "A" * 20), (901, "token=token=abcdefghijkl")]
    got = {}
    for r in sc.find(docs_of(rows), learnt).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        want = brute(t or "")
        assert any(
            r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
            and r.n_assign + r.n_access + r.n_hex == len(want)
            and [s for s in r.spans.split(",") if s and not s.startswith(sc.LEARNT)] == want
            for r in got[i]
        ), (i, t)


def test_learnt_formats(learnt):
    assert set(learnt) == {"assign", "access", "hex"}
    shapes = lambda t: [k for _, _, k in sc.scan(t, learnt)]
    # too short for the fixed pattern, yet of the learnt format
    assert shapes("key 3f9c0d71b2e84a5") == [sc.LEARNT]
    assert shapes("plain internationalisation and www.example.com/path words") == []
    assert shapes("version-2024-release-notes") == []


def test_automaton_merges_states():
    rng = random.Random(1)
    words = ["AKIA" + "".join(rng.choice("AB12") for _ in range(8)) for _ in range(200)]
    a = sc.Automaton(words)
    assert a.states < 60
    assert a.score("AKIAAB12AB12") >= a.threshold > a.score("XXXXAB12AB12")


def test_hot_credential_and_empty(docs_of):
    rows = [(i, "password=0123456789abcdef0") for i in range(300)]
    assert sc.credentials(docs_of(rows)).count() == 2
    assert sc.find(docs_of([]).limit(0)).count() == 0
    assert [r.spans for r in sc.find(docs_of([(1, None), (2, "")])).collect()] == ["", ""]


def test_runs_of_one_class_are_scored(docs_of):
    """A credential has no digit, or nothing else, by chance; words and numbers stay ordinary."""
    rng = random.Random(4)
    pick = lambda a, k: "".join(rng.choice(a) for _ in range(k))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    prose = (
        "the internationalisation of misunderstandings and responsibilities, order 482910 or 20240131 of www.example.com/path. "
        "every country has a revenue of its own, which varies very much by year, 5537196048 units in a quarter; "
        "experts can only guess why. children play quietly, people buy bread, and a truck backs up over the kerb. "
    )
    every = upper + upper.lower() + "0123456789"
    rows = [(i, prose * 3 + f"AKIA{pick(upper + '0123456789', 16)} password={pick(every, 20)}") for i in range(300)]
    learnt = sc.learn(docs_of(rows))
    shapes = lambda t: [k for _, _, k in sc.scan(t, learnt)]
    assert shapes("key AKIAQWERTYUIOPAS here") == [sc.LEARNT]
    # the threshold is that of the credentials learnt from, so that some unseen ones stay below it
    for size, least in ((12, 75), (16, 75), (20, 80)):
        found = [shapes(f"key {pick(upper + upper.lower(), size)} here") == [sc.LEARNT] for _ in range(100)]
        assert sum(found) >= least, (size, sum(found))
    assert shapes("uncharacteristically incomprehensible counterrevolutionary order 192837465564 misunderstandings") == []


def test_long_runs_are_scored_in_full_windows(docs_of):
    learnt = sc.learn(docs_of(corpus()))
    word = "".join(random.Random(3).choice("ghijklmnop_-") for _ in range(sc.WINDOW))
    assert {len(x) for x in sc.windows(word + "a")} == {sc.WINDOW}
    a = learnt["hex"]
    assert not any(a.score(word + c) >= a.threshold for c in "0123456789abcdef")
    inside = "x" * 200 + "".join(random.Random(5).choice("0123456789") for _ in range(100)) + "y" * 300
    assert any(inside[200:300] in x for x in sc.windows(inside))


def test_held_out_credentials_without_patterns(docs_of):
    """A fifth is held out of the fit; the automaton's states alone must tell its format."""
    rng = random.Random(6)
    pick = lambda a, k: "".join(rng.choice(a) for _ in range(k))
    letters, digits = "ABCDEFGHJKMNPQRSTVWXYZ", "0123456789"
    keys = [f"sk_{pick(letters, 4)}-{pick(digits, 6)}-{pick(letters, 4)}" for _ in range(500)]
    prose = "plain words of the people who write about history, order 482910 in 2024, state-of-the-art and well-known things "
    learnt = sc.learn(docs_of([(i, prose + f"token={k}") for i, k in enumerate(keys[:400])]))
    assert 10 < learnt["assign"].states < 60
    held = keys[400:]
    assert sum(sc.scan(f"see {k} there", learnt) == [(4, 4 + len(k), sc.LEARNT)] for k in held) >= 80
    mixed = ["".join(rng.sample(k, len(k))) for k in held]
    assert sum(bool(sc.scan(f"see {k} there", learnt)) for k in mixed) <= 2
    assert sc.scan(prose * 5, learnt) == []


def test_long_credentials_are_learnt_whole(docs_of):
    word = "a1" * 200 + "Z9" * 200
    found = {r.credential for r in sc.credentials(docs_of([(1, f"token={word}")])).collect()}
    assert found == set(sc.windows(word)) and any("Z9Z9" in x for x in found)
    a = sc.Automaton([word])
    assert any("Z" in c for c in a.chars)


def test_candidates_that_touch_fixed_matches(docs_of, learnt):
    rng = random.Random(8)
    parts = ["password=", "0123456789abcdef0", "AKIA", "ABCDEFGH12345678", " ", "deadbeefdeadbeef", "-", "xyz", "token: ", "q7" * 8]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(25))
        fixed = [(s, e) for s, e, _, _ in sc.base(text)]
        want = {
            m.span()
            for m in re.finditer(r"[A-Za-z0-9+/_.=-]{12,}", text)
            if not any(m.start() < e and s < m.end() for s, e in fixed) and sc.secret(m[0], learnt)
        }
        assert {(s, e) for s, e, k in sc.scan(text, learnt) if k == sc.LEARNT} == want
