"""Functions that callers bring (J1, J19, 2.11): an embedder, an answerer, and what SQL can call by name.

They run on Arrow batches; models are the caller's, so none is loaded here.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators.chunk import split_text


def embedder(embed, batch: int = 64):
    """A column function that gives unit vectors (array<float>) of texts; null texts count as empty ones.

    ``embed`` takes a list of at most ``batch`` texts and gives as many vectors; a zero vector stays as it is.
    """

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(texts), batch):
            found = np.asarray(embed(texts.iloc[at : at + batch].fillna("").tolist()), np.float64)
            norm = np.linalg.norm(found, axis=1, keepdims=True)
            out += (found / np.where(norm > 0, norm, 1)).astype(np.float32).tolist()
        return pd.Series(out, index=texts.index, dtype=object)

    return vectors


def answerer(answer):
    """A column function of question and context; ``answer`` takes both as strings and gives a string or None."""

    @F.pandas_udf("string")
    def answers(questions: pd.Series, contexts: pd.Series) -> pd.Series:
        return pd.Series([answer(q, c) for q, c in zip(questions.fillna(""), contexts.fillna(""))], index=questions.index, dtype=object)

    return answers


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """String similarity of two columns; null beside a null."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], index=a.index, dtype=float)


class ChunkText:
    """I14 as a table function: chunk_index and text of each chunk of a text, with the end of the chunk before."""

    def eval(self, text: str, size: int = 800, overlap: int = 120):
        before = None
        for i, raw in enumerate(split_text(text or "", size)):
            yield i, raw if before is None or overlap <= 0 else f"{before[-overlap:]} {raw}".strip()
            before = raw


def register(spark: SparkSession, embed=None, answer=None) -> None:
    """Make ``ratio``, the table function ``chunk_text`` and, where given, ``embed`` and ``answer`` callable from SQL."""
    spark.udf.register("ratio", ratio)
    spark.udtf.register("chunk_text", F.udtf(ChunkText, returnType="chunk_index int, text string"))
    if embed:
        spark.udf.register("embed", embedder(embed))
    if answer:
        spark.udf.register("answer", answerer(answer))
