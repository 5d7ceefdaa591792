"""Batch scoring of prompts with a user's model, and usage totals."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from dossierflow.schemas import REPLY, ddl


@dataclass(frozen=True)
class Reply:
    """What a scorer returns for one prompt."""

    text: str
    model: str
    request_id: str = ""
    prompt_tokens: int = 0
    completion_tokens: int = 0
    finish_reason: str = "stop"


@dataclass(frozen=True)
class ModelOptions:
    """What a scorer is told about the call."""

    model: str = "rules"
    temperature: float = 0.0
    max_tokens: int = 5000


# A scorer turns a list of prompts into as many replies.
Scorer = Callable[[list[str], ModelOptions], list[Reply]]


def _row(reply: Reply | None, error: str | None) -> tuple:
    if reply is None:
        return (None, None, None, None, error, None, None, None)
    total = reply.prompt_tokens + reply.completion_tokens
    return (reply.text, reply.model, reply.request_id, reply.finish_reason, None,
            reply.prompt_tokens, reply.completion_tokens, total)


def _score(prompts: list[str], scorer: Scorer, options: ModelOptions) -> list[tuple]:
    """Replies of one batch. If the batch fails, each prompt is tried alone, so that one
    bad document fails alone."""
    try:
        replies = scorer(prompts, options)
        if len(replies) == len(prompts):
            return [_row(r, None) for r in replies]
    except Exception:
        pass
    rows = []
    for prompt in prompts:
        try:
            rows.append(_row(scorer([prompt], options)[0], None))
        except Exception as exc:
            rows.append(_row(None, str(exc) or type(exc).__name__))
    return rows


def reply_column(prompt: Column, scorer: Scorer, options: ModelOptions = ModelOptions(), batch: int = 64) -> Column:
    """Reply struct per prompt. Only the prompt crosses to Python (as Arrow batches);
    every other column of the row stays in the JVM. NULL prompts are not scored."""

    @F.pandas_udf(ddl(REPLY))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [f.name for f in REPLY.fields]
        for prompts in batches:
            rows: list[tuple] = [_row(None, None)] * len(prompts)
            wanted = [i for i, p in enumerate(prompts) if p is not None]
            values = prompts.tolist()
            for start in range(0, len(wanted), batch):
                chunk = wanted[start : start + batch]
                for i, row in zip(chunk, _score([values[i] for i in chunk], scorer, options)):
                    rows[i] = row
            frame = pd.DataFrame(rows, columns=names)
            for name in ("prompt_tokens", "completion_tokens", "total_tokens"):
                frame[name] = frame[name].astype("Int64")
            yield frame

    return score(prompt)


def reply_list_column(prompts: Column, scorer: Scorer, options: ModelOptions = ModelOptions(), batch: int = 64) -> Column:
    """Reply structs for arrays of prompts, in their order; NULL arrays are not scored."""

    @F.pandas_udf(f"array<{ddl(REPLY)}>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = [f.name for f in REPLY.fields]
        for lists in batches:
            flat = [p for some in lists if some is not None for p in some]
            rows: list[tuple] = []
            for start in range(0, len(flat), batch):
                rows.extend(_score(flat[start : start + batch], scorer, options))
            out, at = [], 0
            for some in lists:
                n = 0 if some is None else len(some)
                out.append(None if some is None else [dict(zip(names, r)) for r in rows[at : at + n]])
                at += n
            yield pd.Series(out, dtype=object)

    return score(prompts)


def one_reply(replies: Column) -> Column:
    """Replies to the windows of one document as one: texts and ids joined, tokens summed, the
    first error."""
    first = F.get(replies, F.lit(0))

    def total(name: str) -> Column:
        return F.aggregate(
            F.transform(replies, lambda r: r[name]), F.lit(None).cast("long"),
            lambda acc, n: F.coalesce(acc + n, acc, n),
        )

    def joined(name: str, by: str) -> Column:
        some = F.filter(F.transform(replies, lambda r: r[name]), lambda x: x.isNotNull())
        return F.when(F.size(some) > 0, F.array_join(some, by))

    cut = F.exists(replies, lambda r: F.coalesce(r["finish_reason"] == "length", F.lit(False)))
    error = F.get(F.filter(F.transform(replies, lambda r: r["error"]), lambda e: e.isNotNull()), F.lit(0))
    return F.struct(
        joined("reply", "\n").alias("reply"), first["model"].alias("model"), joined("request_id", ",").alias("request_id"),
        F.when(cut, F.lit("length")).otherwise(first["finish_reason"]).alias("finish_reason"), error.alias("error"),
        *[total(n).alias(n) for n in ("prompt_tokens", "completion_tokens", "total_tokens")],
    ).cast(ddl(REPLY))


def stub_scorer(prompts: list[str], options: ModelOptions) -> list[Reply]:
    """A deterministic stand-in: answers with an empty result; a token is a piece
    between white space."""
    replies = []
    for prompt in prompts:
        text = '{"primary_category": "Unknown", "entities": [], "pii_items": []}'
        request = sha256(prompt.encode("utf-8")).hexdigest()[:16]
        replies.append(Reply(text, "stub", request, len(prompt.split()), len(text.split())))
    return replies


def token_usage(replies: DataFrame) -> DataFrame:
    """Calls and token totals per stage and model."""
    return replies.groupBy("stage", "model").agg(
        F.count("*").alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        F.round(F.avg("total_tokens"), 4).alias("avg_total_tokens"),
        F.sum(F.when(F.col("finish_reason") == "length", 1).otherwise(0)).alias("cut_off"),
    )


#: prompts that at least one in so many rows shares are joined by broadcast, so there are no more than that
COMMON = 256


def distinct_scores(
    prompts: DataFrame, prompt: str, scorer: Scorer, folder: str, options: ModelOptions = ModelOptions(), batch: int = 64
) -> DataFrame:
    """``prompts`` with the reply ``r`` to each row's prompt, equal prompts being scored once, and
    ``asked``: whether this row is the one that the scorer was called for.

    Equal prompts are found by a digest, counted and reduced to one text by an aggregate that
    combines before its shuffle. Replies are written to ``folder`` once, so no lost task asks again
    for those that are there. Rows then find theirs by digest: those of common prompts by a
    broadcast of bounded size, all others by a join on the digest. NULL prompts have no reply.
    """
    keyed = prompts.withColumns({"_digest": F.sha2(prompt, 256), "_row": F.monotonically_increasing_id()})
    keyed.write.parquet(f"{folder}/prompts")
    keyed = prompts.sparkSession.read.schema(keyed.schema).parquet(f"{folder}/prompts")
    one = keyed.where(F.col(prompt).isNotNull()).groupBy("_digest").agg(
        F.any_value(prompt).alias("_prompt"), F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    scored = one.select("_digest", "_first", "_n", reply_column(F.col("_prompt"), scorer, options, batch).alias("r"))
    scored.write.parquet(f"{folder}/replies")
    scored = prompts.sparkSession.read.schema(scored.schema).parquet(f"{folder}/replies")
    total = scored.agg(F.sum("_n")).first()[0] or 0
    common = F.col("_n") * COMMON >= total
    often = keyed.join(F.broadcast(scored.where(common)), "_digest")
    names = F.broadcast(scored.where(common).select("_digest"))
    seldom = keyed.join(names, "_digest", "left_anti").join(scored.where(~common), "_digest", "left")
    both = often.unionByName(seldom)
    asked = F.coalesce(F.col("_row") == F.col("_first"), F.lit(False)).alias("asked")
    return both.select(*prompts.columns, "r", asked)
