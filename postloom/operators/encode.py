"""Text to vectors: hashed term weights in the JVM, or any encoder the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import IDF, HashingTF, IDFModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.functions.words import words

# Given once per Python worker; returns a function from texts to an (n, width) matrix.
EncoderFactory = Callable[[], Callable[[list[str]], np.ndarray]]


def hashed_terms(df: DataFrame, text: str, width: int = 256) -> DataFrame:
    tokens = df.where(F.col(text).isNotNull()).withColumn("_tokens", words(F.col(text)))
    return HashingTF(numFeatures=width, inputCol="_tokens", outputCol="_tf").transform(tokens)


def fit_weights(df: DataFrame, text: str, width: int = 256) -> IDFModel:
    return IDF(inputCol="_tf", outputCol="_tfidf").fit(hashed_terms(df, text, width))


def encode_hashing(df: DataFrame, text: str, model: IDFModel | None = None, width: int = 256) -> DataFrame:
    """``df`` with ``embedding``; term counts, or TF-IDF with a fitted ``model``."""
    hashed = hashed_terms(df, text, width)
    if model is None:
        out, column = hashed, "_tf"
    else:
        out, column = model.transform(hashed), "_tfidf"
    return out.withColumn("embedding", vector_to_array(column, "float32")).drop(
        "_tokens", "_tf", "_tfidf"
    )


def encode_with(
    df: DataFrame, key: str, text: str, make_encoder: EncoderFactory, batch_size: int = 64
) -> DataFrame:
    """(key, embedding) by a caller's encoder, loaded once per Python worker.

    Arrow batches arrive whole; the encoder sees ``batch_size`` texts at a time.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                part = batch.iloc[start : start + batch_size]
                vectors = np.asarray(encode(part[text].tolist()), dtype=np.float32)
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": list(vectors)})

    rows = df.where(F.col(text).isNotNull()).select(key, text)
    return rows.mapInPandas(run, f"`{key}` {kind}, embedding array<float>")
