"""What needs a model, as small protocols with offline defaults that are the same on every run."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text


class Embedder(Protocol):
    def __call__(self, body: Column) -> Column: ...


class Reranker(Protocol):
    def __call__(self, question: Column, body: Column) -> Column: ...


class Enricher(Protocol):
    def __call__(self, docs: DataFrame) -> DataFrame: ...


class Generator(Protocol):
    def __call__(self, prompt: Column) -> Column: ...


def hashed_embedding(body: Column, size: int = 64) -> Column:
    """Counts of words by a hash, divided by their length: array<double> of ``size``."""

    @F.pandas_udf("array<double>")
    def run(words: pd.Series) -> pd.Series:
        import zlib

        import numpy as np

        def one(ws):
            v = np.bincount([zlib.crc32(w.encode()) % size for w in ws], minlength=size).astype(float) if ws is not None and len(ws) else np.zeros(size)
            n = np.linalg.norm(v)
            return (v / n if n else v).tolist()

        return words.map(one)

    return run(text.tokens(body))


def overlap_score(question: Column, body: Column) -> Column:
    """The share of the question's words that a text has."""
    q = F.array_distinct(text.tokens(question))
    return F.coalesce(F.size(F.array_intersect(q, text.tokens(body))) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0))


def template_answer(prompt: Column) -> Column:
    """The offline generator: the prompt's first line, cut to 200 characters."""
    return F.substring(F.split(prompt, "\n")[0], 1, 200)


def variants(question: Column) -> Column:
    """Three phrasings of a question, the question first."""
    return F.array(question, F.concat(F.lit("A passage that answers: "), question), F.concat(F.lit("Background on "), question))


def sigmoid(score: Column) -> Column:
    return F.least(F.greatest(1 / (1 + F.exp(-score)), F.lit(0.0)), F.lit(1.0))


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Prices are for a million tokens; without a price it is 0."""
    return F.coalesce(tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out, F.lit(0.0))


def answered_by(providers: list[tuple[str, Generator, float]], prompt: Column, spent: Column, budget: float) -> Column:
    """struct<provider, answer>: the first provider's answer that isn't null and whose price the budget still covers; null if none does."""
    out = F.lit(None).cast("struct<provider:string,answer:string>")
    for name, generate, price in reversed(providers):
        answer = generate(prompt)
        out = F.when((spent + price <= budget) & answer.isNotNull(), F.struct(F.lit(name).alias("provider"), answer.alias("answer"))).otherwise(out)
    return out


def weekly_prompt(week: Column, lines: Column) -> Column:
    """What a model is asked for a week's summary, with a line for each document."""
    return F.concat(F.lit("Summary of week "), week.cast("string"), F.lit("\n"), F.array_join(lines, "\n"))
