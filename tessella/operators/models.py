"""Pluggable models: what embeds, answers and judges, with offline defaults."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class Generator(Protocol):
    def answer(self, question: str, context: str) -> str: ...


class Judge(Protocol):
    def judge(self, question: str, answer: str, expected: str) -> str: ...


class HashingEmbedder:
    """Unit vectors of hashed word counts; needs no fitting and is alike everywhere."""

    def __init__(self, dims: int = 64) -> None:
        self.dims = dims

    def embed(self, texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), self.dims), dtype=np.float32)
        for row, text in zip(out, texts):
            for w in text.lower().split():
                h = xxhash.xxh3_64_intdigest(w)
                row[h % self.dims] += 1.0 if h >> 63 else -1.0
            size = float(np.linalg.norm(row))
            if size:
                row /= size
        return out


class ExtractiveGenerator:
    """Answers with the context sentence that shares most words with the question."""

    def answer(self, question: str, context: str) -> str:
        asked = set(question.lower().split())
        return max(context.replace("\n", " ").split(". "), key=lambda s: len(asked & set(s.lower().split())), default="")


class OverlapJudge:
    """Three scores out of ten from word overlap, in the form a judge model would reply."""

    def judge(self, question: str, answer: str, expected: str) -> str:
        a, e, q = (set((x or "").lower().split()) for x in (answer, expected, question))
        share = lambda x, y: 10.0 * len(x & y) / max(1, len(y))
        return f"{share(a, e):.2f}, {share(a, q):.2f}, {10.0 if a else 0.0:.2f}"


def embed(text: Column, model: Embedder) -> Column:
    """array<float> of each text; null stays null. One call of the model per Arrow batch."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        v = model.embed([t or "" for t in texts])
        return pd.Series([None if t is None else row.tolist() for t, row in zip(texts, v)])

    return run(text)


def generate(question: Column, context: Column, model: Generator) -> Column:
    @F.pandas_udf("string")
    def run(q: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([model.answer(x or "", y or "") for x, y in zip(q, c)])

    return run(question, context)


def judge(question: Column, answer: Column, expected: Column, model: Judge) -> Column:
    @F.pandas_udf("string")
    def run(q: pd.Series, a: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([model.judge(x or "", y or "", z or "") for x, y, z in zip(q, a, e)])

    return run(question, answer, expected)
