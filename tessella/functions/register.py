"""The engine's text functions under SQL names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tessella.functions.similarity import rouge_l_scores
from tessella.operators import chunking as C


def register_functions(spark: SparkSession) -> list[str]:
    """Register scalar functions and table functions; returns their names.

    Scalars: recursive_split, window_split, semantic_split, split_sentences
    (arrays of strings) and rouge_l_f (double). Table functions:
    section_table(markdown) and piece_table(text, limit).
    """
    def array_of(split):
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([None if t is None else split(t) for t in texts])

        run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
        return F.pandas_udf(run, "array<string>")

    scalars = {"recursive_split": C.recursive_split, "window_split": C.window_split, "semantic_split": C.semantic_split, "split_sentences": C.split_sentences}
    for name, split in scalars.items():
        spark.udf.register(name, array_of(split))

    def rouge_l_f(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([rouge_l_scores(x, y)[2] for x, y in zip(a, b)])

    rouge_l_f.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    spark.udf.register("rouge_l_f", F.pandas_udf(rouge_l_f, "double"))

    sections = StructType([StructField("title", StringType()), StructField("content", StringType()), StructField("level", IntegerType()), StructField("page", IntegerType())])

    class Sections:
        def eval(self, markdown: str):
            for s in C.tidy_sections(C.extract_sections(markdown or "")):
                yield s.title, s.content, s.level, s.page

    class Pieces:
        def eval(self, text: str, limit: int):
            for i, piece in enumerate(C.recursive_split(text or "", limit)):
                yield i, piece

    spark.udtf.register("section_table", F.udtf(Sections, returnType=sections))
    spark.udtf.register("piece_table", F.udtf(Pieces, returnType="piece_no int, piece string"))
    return [*scalars, "rouge_l_f", "section_table", "piece_table"]
