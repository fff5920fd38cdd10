"""Quality classifier: supervised subword embeddings.

Word and character n-gram vectors, hashed and averaged per document, with a softmax output,
learned by stochastic gradient descent in numpy. Case is kept, since shouting is a mark of
poor text, and equal neighbouring words are a feature of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.classify import Settings, fit, remainder, with_score

SETTINGS = Settings(label="quality", lower=False, pairs=True)
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3


def score_quality(docs: DataFrame, labels: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """``docs`` with ``quality_score``: the probability of quality label 1 of each whole text.

    Learns from labelled rows outside the held-out fold: at most ``settings.per_class`` texts
    of each class. NULL and empty texts score alike. Without labels every text scores one half,
    with one class only its share of the labels. A NULL doc_id is scored and never learned
    from; of several labels of one doc_id the larger counts. Rows and columns stay as they are.
    """
    weights = fit(docs, labels, remainder(F.col("doc_id"), FOLDS) != HELD_OUT, settings)
    return with_score(docs, weights, settings, "quality_score")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``threshold``, with their columns as they are."""
    scored = score_quality(docs, labels)
    return scored.filter(F.col("quality_score") >= threshold).drop("quality_score")
