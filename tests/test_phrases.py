import random

import pytest

from dossierflow.operators import phrases
from dossierflow.operators.rules import Lexicon

LEXICON = Lexicon((
    ("A", "interest rate swap", 2.0), ("A", "swap", 1.0), ("B", "interest  Rate", 1.0), ("B", "rate swap desk", 1.5), ("C", "rate", 0.5),
    ("C", "a a", 1.0),
))


def plain(text):
    words = (text or "").lower().split()
    terms = {" ".join(t.lower().split()) for _, t, _ in LEXICON.terms}
    hits = [(i, n, " ".join(words[i : i + n])) for n in (1, 2, 3) for i in range(len(words) - n + 1)
            if " ".join(words[i : i + n]) in terms]
    return sorted(h for h in hits if not any(o[1] > h[1] and o[0] <= h[0] and o[0] + o[1] >= h[0] + h[1] for o in hits))


@pytest.fixture
def docs(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("interest rate swap desk a".split()) for _ in range(rng.randint(0, 30))) for _ in range(80)]
    texts += [None, "", "Interest rate SWAP desk", "a a a a", texts[0]]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)


def test_longest_terms_by_position(docs):
    for r in phrases.with_phrases(docs, LEXICON).collect():
        assert [tuple(h) for h in r.hits] == plain(r.text)


def test_both_forms_agree(spark, docs):
    lexicon = spark.createDataFrame(list(LEXICON.terms) + [("A", "SWAP", 0.1)], "category string, term string, weight double")
    joined = sorted(map(tuple, phrases.categorize_phrases(docs, lexicon).collect()))
    assert joined == sorted(map(tuple, phrases.categorize_phrases_in_plan(docs, LEXICON).collect()))
    assert len(joined) == docs.count()
    whole = {r[0]: r for r in joined}[82]
    assert whole[1:4] == ("A", round(2.0 / 3.5, 4), "interest rate swap")


def test_empty_lexicon(docs):
    with pytest.raises(ValueError):
        phrases.with_phrases(docs, Lexicon())
