"""Toxicity classifier: a subword bag averaged into a linear softmax.

Vectors and softmax are learned jointly in numpy. A misspelt word that was never seen shares
most of its character n-grams with known ones, and so their vectors. Case is ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.classify import Settings, fit, remainder, with_score

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
SETTINGS = Settings(label="toxic", lower=True, pairs=False, cut=THRESHOLD)


def score_toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """``docs`` with ``toxic_score`` of each whole text: 0 to 1, higher where toxic label 1 is
    likelier, and 0.7 where calling a text toxic does best on texts that were not learned from.

    Learns from labelled rows outside the held-out fold: at most ``settings.per_class`` texts
    of each class. NULL and empty texts score alike. Without labels every text scores one half,
    with one class only its share of the labels. A NULL doc_id is scored and never learned
    from; of several labels of one doc_id the larger counts. Rows and columns stay as they are.
    """
    weights = fit(docs, labels, remainder(F.col("doc_id"), FOLDS) != HELD_OUT, settings)
    return with_score(docs, weights, settings, "toxic_score")
