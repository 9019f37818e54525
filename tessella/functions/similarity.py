"""Text overlap measures and the parser of judge scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import ngrams, rouge_text, sentences, squeeze


def rouge_n(df: DataFrame, key: str, reference: Column, candidate: Column, sizes: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(key, rouge<n>_p, rouge<n>_r, rouge<n>_f): overlap of distinct word n-grams.

    Each value is the larger of the raw and the normalised texts' one; null and
    blank texts score 0. Every n-gram array is made once, in a step of its own.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    forms = {"raw": squeeze, "flat": rouge_text}
    words = df.select(key, *[F.split(form(blank(c)), " ").alias(f"{name}_{side}") for name, form in forms.items() for side, c in (("a", reference), ("b", candidate))])
    tags = [(f"{name}{n}", name, n) for name in forms for n in sizes]
    grams = words.select(key, *[ngrams(F.col(f"{name}_{side}"), n).alias(f"{tag}_{side}") for tag, name, n in tags for side in "ab"])
    sizes_ = grams.select(key, *[x for tag, _, _ in tags for x in (F.size(F.array_intersect(f"{tag}_a", f"{tag}_b")).alias(f"{tag}_n"), F.size(f"{tag}_a").alias(f"{tag}_la"), F.size(f"{tag}_b").alias(f"{tag}_lb"))])
    share = lambda tag, of: F.coalesce(F.try_divide(f"{tag}_n", f"{tag}_l{of}"), F.lit(0.0))
    pr = sizes_.select(key, *[x for tag, _, _ in tags for x in (share(tag, "b").alias(f"{tag}_p"), share(tag, "a").alias(f"{tag}_r"))])
    f = lambda tag: 2.0 * F.col(f"{tag}_p") * F.col(f"{tag}_r") / (F.col(f"{tag}_p") + F.col(f"{tag}_r") + 1e-8)
    best = lambda n, of: F.greatest(*[of(f"{name}{n}") for name in forms])
    return pr.select(key, *[best(n, (lambda tag, c=c: F.col(f"{tag}_{c}")) if c != "f" else f).alias(f"rouge{n}_{c}") for n in sizes for c in "prf"])


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = row & where.get(w, 0)
        row = (row + m) | (row - m)
        row &= full | (1 << len(a)) - 1
    return len(a) - bin(row & full).count("1")


def rouge_l_scores(reference: str | None, candidate: str | None) -> tuple[float, float, float]:
    a, b = (reference or "").split(), (candidate or "").split()
    if not a or not b:
        return 0.0, 0.0, 0.0
    n = lcs(a, b)
    p, r = n / len(b), n / len(a)
    return p, r, 2 * p * r / (p + r + 1e-8)


def rouge_l(reference: Column, candidate: Column) -> Column:
    """Struct (p, r, f) of ROUGE-L over white-space separated words; blank texts score 0."""

    @F.pandas_udf("p double, r double, f double")
    def score(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rouge_l_scores(x, y) for x, y in zip(a, b)], columns=["p", "r", "f"])

    return score(reference, candidate)


def sentence_rouge_l(reference: Column, candidate: Column) -> Column:
    """Mean over the reference's sentences of the best ROUGE-L F with a sentence of the candidate.

    Sentences whose best is 0 don't count; null unless both texts have more than one sentence.
    """

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            if len(x) < 2 or len(y) < 2:
                return None
            best = [max(rouge_l_scores(s, t)[2] for t in y) for s in x]
            best = [v for v in best if v > 0]
            return sum(best) / len(best) if best else 0.0

        return pd.Series([one(list(x), list(y)) for x, y in zip(a, b)], dtype="float64")

    return score(sentences(F.coalesce(reference, F.lit(""))), sentences(F.coalesce(candidate, F.lit(""))))


def rouge_l_best(reference: Column, candidate: Column) -> Column:
    """Struct (p, r, f): of each the larger of the raw and the normalised texts' ROUGE-L; f also not below the sentence-aligned mean.

    Null and blank texts score 0.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    a, b = blank(reference), blank(candidate)
    raw, flat = rouge_l(a, b), rouge_l(rouge_text(a), rouge_text(b))
    aligned = F.coalesce(sentence_rouge_l(a, b), F.lit(0.0))
    return F.struct(F.greatest(raw["p"], flat["p"]).alias("p"), F.greatest(raw["r"], flat["r"]).alias("r"), F.greatest(raw["f"], flat["f"], aligned).alias("f"))


def greedy_similarity(candidate: list[list[float]], reference: list[list[float]]) -> tuple[float, float, float]:
    """Precision, recall and F of greedy matching of token vectors by cosine, each within [0, 1]."""
    import numpy as np

    if not candidate or not reference:
        return 0.0, 0.0, 0.0
    a, b = np.asarray(candidate, float), np.asarray(reference, float)
    near = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    p, r = float(near.max(axis=1).mean()), float(near.max(axis=0).mean())
    f = 2 * p * r / (p + r) if p + r > 0 else 0.0
    return tuple(min(1.0, max(0.0, v)) for v in (p, r, f))


def judge_scores(reply: Column, n: int = 3) -> Column:
    """n numbers from 0 to 10 separated by commas, over 10 and within [0, 1]; 0.5 each if the reply isn't that."""
    parts = F.split(F.coalesce(reply, F.lit("")), ",")
    values = F.transform(parts, lambda x: F.trim(x).try_cast("double"))
    good = (F.size(parts) == n) & F.forall(values, lambda v: v.isNotNull())
    return F.when(good, F.transform(values, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / 10.0)))).otherwise(F.array(*[F.lit(0.5)] * n))
