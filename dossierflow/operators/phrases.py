"""Classification by a lexicon whose terms may have several words.

A term is a run of words; it stands in a text where its words follow each other, whatever is
between them. The longest term that begins at a word counts there, and a term inside the place
of a longer one does not count, so that "interest rate swap" is not also an "interest rate".

Both forms give the same rows as ``categorize`` does for single words: ``with_phrases`` looks
terms up row by row, longest first, in a map that lives in the plan; ``categorize_phrases``
joins the positions of a document's word runs with a lexicon table of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossierflow.operators.categorize import ranked_categories, words_of
from dossierflow.operators.rules import Lexicon

#: so many first words of a lexicon table's terms are looked up row by row before the join
FIRSTS = 1024
_HIT = "array<struct<at:int,n:int,term:string>>"


def normal_term(term: Column) -> Column:
    """A term as its words, joined by one blank."""
    return F.array_join(words_of(term), " ")


def _runs(text: Column, longest: int, firsts: dict[int, list[str]] | None = None) -> Column:
    """(at, n, term) of the runs of 1 to ``longest`` words of a text, which is split once; if
    ``firsts`` is given, only of those of n words that begin with one of its words for n."""
    words = F.array(words_of(F.coalesce(text, F.lit(""))))
    return F.flatten(F.transform(words, lambda w: _runs_of(w, longest, firsts)))


def _runs_of(words: Column, longest: int, firsts: dict[int, list[str]] | None) -> Column:
    places = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    if firsts is not None:
        known = sorted({w for group in firsts.values() for w in group})
        places = F.filter(places, lambda i: F.get(words, i).isin(known))

    def of_length(places: Column, n: int) -> Column:
        if firsts is not None:
            places = F.filter(places, lambda i: F.get(words, i).isin(firsts[n]))
        inside = F.filter(places, lambda i: i <= F.size(words) - n) if n > 1 else places
        return F.transform(inside, lambda i: F.struct(
            i.alias("at"), F.lit(n).alias("n"), F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]).alias("term")))

    lengths = [n for n in range(1, longest + 1) if firsts is None or n in firsts]
    if not lengths:
        return F.array().cast(_HIT)
    # the places are found once for all lengths
    return F.flatten(F.transform(F.array(places), lambda p: F.concat(*[of_length(p, n) for n in lengths])))


def _by_length(pairs) -> dict[int, list[str]]:
    firsts: dict[int, set[str]] = {}
    for first, n in pairs:
        firsts.setdefault(n, set()).add(first)
    return {n: sorted(words) for n, words in firsts.items()}


def outermost(hits: Column) -> Column:
    """Hits (at, n, term) that do not lie inside a longer one, in the order of their places: sorted
    by place, the longest first, a hit is inside another if it ends no later than one before it."""
    ordered = F.array_sort(F.transform(hits, lambda h: F.struct(h["at"].alias("at"), (-h["n"]).alias("less"), h["term"].alias("term"))))
    start = F.struct(F.lit(0).alias("end"), F.array().cast(_HIT).alias("kept"))

    def step(state: Column, h: Column) -> Column:
        end = h["at"] - h["less"]
        hit = F.struct(h["at"].alias("at"), (-h["less"]).alias("n"), h["term"].alias("term"))
        more = F.struct(end.alias("end"), F.array_append(state["kept"], hit).alias("kept"))
        return F.when(end <= state["end"], state).otherwise(more)

    return F.aggregate(ordered, start, step, lambda state: state["kept"])


def with_phrases(df: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "hits") -> DataFrame:
    """Adds the hits (at, n, term) of a lexicon that lives in the plan: no explode, no shuffle."""
    terms = sorted({" ".join(t.lower().split()) for _, t, _ in lexicon.terms})
    if not terms:
        raise ValueError("the lexicon is empty")
    longest = max(t.count(" ") + 1 for t in terms)
    known = F.create_map(*[x for t in terms for x in (F.lit(t), F.lit(True))])
    firsts = _by_length((t.split(" ")[0], t.count(" ") + 1) for t in terms)
    found = F.filter(_runs(F.col(text), longest, firsts), lambda r: F.coalesce(known[r["term"]], F.lit(False)))
    return df.withColumn(out, outermost(found))


def _normal(lexicon: DataFrame) -> DataFrame:
    """Each term once in a category, at its highest weight."""
    return lexicon.groupBy("category", normal_term(F.col("term")).alias("term")).agg(F.max("weight").alias("weight"))


def phrase_hits(docs: DataFrame, lexicon: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, n) of the terms of a lexicon table that count in each document.

    Positions are joined by term; texts do not move. The longest term's length bounds the runs
    that are looked up and is read from the lexicon first; so are the first words of its terms
    for each length, unless there are more than ``FIRSTS``: then the runs of all words are joined."""
    terms = lexicon.select("term").distinct()
    parts = F.split("term", " ")
    begun = terms.where("term IS NOT NULL").select(F.get(parts, F.lit(0)).alias("first"), F.size(parts).alias("n")).distinct()
    some = [(r["first"], r["n"]) for r in begun.limit(FIRSTS + 1).collect()]
    if len(some) > FIRSTS:
        firsts, longest = None, begun.agg(F.max("n")).first()[0]
    else:
        firsts, longest = _by_length(some), max((n for _, n in some), default=1)
    runs = docs.select(key, F.inline(_runs(F.col(text), longest, firsts)))
    places = runs.join(terms, "term").groupBy(key).agg(F.collect_list(F.struct("at", "n", "term")).alias("hits"))
    kept = places.select(key, F.explode(outermost(F.col("hits"))).alias("h"))
    return kept.groupBy(key, F.col("h.term").alias("term")).agg(F.count(F.lit(1)).alias("n"))


def categorize_phrases(docs: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the six classification fields from a lexicon table (category, term, weight)."""
    unique = _normal(lexicon)
    return ranked_categories(docs, phrase_hits(docs, unique, key, text).join(unique, "term"), key)


def categorize_phrases_in_plan(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same, with the terms found row by row."""
    rows = [(c, " ".join(t.lower().split()), float(w)) for c, t, w in lexicon.terms]
    unique = _normal(docs.sparkSession.createDataFrame(rows, "category string, term string, weight double"))
    # for an inner explode Spark would compute the hits twice, in a filter on their number too
    hits = with_phrases(docs.select(key, text), lexicon, text).select(key, F.explode_outer("hits").alias("h"))
    hits = hits.filter("h IS NOT NULL")
    counted = hits.groupBy(key, F.col("h.term").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    return ranked_categories(docs, counted.join(unique, "term"), key)
