"""Stage 3: primary and secondary category from a weighted lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossierflow.operators.rules import Lexicon, sql_text
from dossierflow.schemas import UNKNOWN_CATEGORY

# letters and digits of any script; a number may follow after a hyphen, as in names of forms
WORD = r"[\\p{L}\\p{N}]+(?:-\\p{N}+)*"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.expr(f"'{WORD}'"), F.lit(0))


def word_counts(text: Column) -> Column:
    """(term, n) of every distinct word of a text: its words sorted, and the lengths of equal runs."""
    words = F.sort_array(words_of(F.coalesce(text, F.lit(""))))

    def counted(w: Column) -> Column:
        new = lambda i: (i == 0) | (i == F.size(w)) | (F.get(w, i) != F.get(w, i - 1))
        starts = F.filter(F.sequence(F.lit(0), F.size(w)), new)
        return F.flatten(F.transform(F.array(starts), lambda s: F.transform(
            F.slice(s, F.lit(1), F.size(s) - 1),
            lambda a, k: F.struct(F.get(w, a).alias("term"), (F.get(s, k + 1) - a).cast("long").alias("n")))))

    return F.flatten(F.transform(F.array(words), counted))


def with_categorization_from(df: DataFrame, lexicon: DataFrame, key: str, text: str, out: str) -> DataFrame:
    """Adds the classification struct from a lexicon table; ``key`` names a row."""
    found = categorize_by_join(df.select(key, text), lexicon, key, text)
    fields = [c for c in found.columns if c != key]
    return df.join(found.select(key, F.struct(*fields).alias(out)), key, "left")


def _among(words: str, terms: list[str]) -> str:
    return f"filter({words}, w -> w IN ({', '.join(sql_text(t) for t in terms)}))"


def lexicon_hits(text: str, lexicon: Lexicon) -> Column:
    """Words of the text column that the lexicon knows, repeats included."""
    words = f"regexp_extract_all(lower(coalesce({text}, '')), '{WORD}', 0)"
    return F.expr(_among(words, lexicon.words()))


def _ranked(hits: str, lexicon: Lexicon) -> Column:
    """(order, category) of every category with a hit, best first."""
    scores = []
    for category in lexicon.categories():
        groups = sorted(lexicon.by_weight(category).items())
        score = " + ".join(f"size({_among(hits, terms)}) * CAST({weight} AS double)" for weight, terms in groups)
        scores.append(f"named_struct('order', -({score}), 'category', {sql_text(category)})")
    return F.expr(f"filter(array_sort(array({', '.join(scores)})), s -> s.order < 0)")


def _justification(hits: str, lexicon: Lexicon, category: str) -> str:
    """Matched terms of one category, in alphabetical order."""
    cases = " ".join(
        f"WHEN {sql_text(name)} THEN {_among(hits, [t for c, t, _ in lexicon.terms if c == name])}"
        for name in lexicon.categories()
    )
    return f"coalesce(array_join(array_sort(array_distinct(CASE {category} {cases} END)), ', '), '')"


def with_categorization(df: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "categorization") -> DataFrame:
    """Adds the classification struct row by row: no explode, no shuffle. Confidence is
    the category's share of the whole score; documents without a hit are Unknown."""
    if not len(lexicon):
        raise ValueError("the lexicon is empty")

    def fields(prefix: str, index: int) -> list[str]:
        entry = f"get(_ranked, {index})"
        return [
            f"'{prefix}_category', coalesce({entry}.category, '{UNKNOWN_CATEGORY}')",
            f"'{prefix}_confidence', coalesce(round(-{entry}.order / _total, 4), CAST(0.0 AS double))",
            f"'{prefix}_justification', {_justification('_hits', lexicon, entry + '.category')}",
        ]

    return (
        df.withColumn("_hits", lexicon_hits(text, lexicon))
        .withColumn("_ranked", _ranked("_hits", lexicon))
        .withColumn("_total", F.expr("aggregate(_ranked, CAST(0.0 AS double), (total, s) -> total - s.order)"))
        .withColumn(out, F.expr(f"named_struct({', '.join(fields('primary', 0) + fields('secondary', 1))})"))
        .drop("_hits", "_ranked", "_total")
    )


def categorize_by_join(docs: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same classification for a lexicon table of any size (category, term, weight).

    Words are counted in each document's row, without a shuffle, so that the join by term moves
    one row per document and term; adaptive execution broadcasts a lexicon that turns out small and
    splits a term that a third of all documents hold. A term listed several times in a
    category counts once, at its highest weight, as in a ``Lexicon``. The texts themselves
    never move. Returns ``key`` and the six classification fields.
    """
    words = docs.select(key, F.inline(word_counts(F.col(text))))
    unique = lexicon.groupBy("category", F.lower("term").alias("term")).agg(F.max("weight").alias("weight"))
    return ranked_categories(docs, words.join(unique, "term"), key)


def ranked_categories(docs: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """``key`` and the six classification fields of all ``docs`` from counted hits (key, term, n,
    category, weight)."""
    scored = (
        hits.groupBy(key, "category")
        .agg(
            F.sum(F.col("n") * F.col("weight")).alias("score"),
            # at most one entry per lexicon term of the category
            F.array_join(F.array_sort(F.collect_set("term")), ", ").alias("terms"),
        )
        .filter("score > 0")
    )
    ranked = scored.groupBy(key).agg(
        F.sort_array(
            F.collect_list(F.struct((-F.col("score")).alias("order"), "category", "terms"))
        ).alias("ranked"),
        F.sum("score").alias("total"),
    )
    first, second = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))

    def share(entry: Column) -> Column:
        return F.when(entry.isNull(), F.lit(0.0)).otherwise(F.round(-entry["order"] / F.col("total"), 4))

    return docs.select(key).join(ranked, key, "left").select(
        key,
        F.coalesce(first["category"], F.lit(UNKNOWN_CATEGORY)).alias("primary_category"),
        share(first).alias("primary_confidence"),
        F.coalesce(first["terms"], F.lit("")).alias("primary_justification"),
        F.coalesce(second["category"], F.lit(UNKNOWN_CATEGORY)).alias("secondary_category"),
        share(second).alias("secondary_confidence"),
        F.coalesce(second["terms"], F.lit("")).alias("secondary_justification"),
    )
