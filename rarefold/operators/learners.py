"""Plug-in learners of the ensembles (I3-I6), keyed by member.

An ensemble trains many models at once: its rows carry a ``member`` (bag, round,
fold), and a plug-in sees all of them in one call, so a member costs a key, not
a job. Anything with these methods fits:

* a metric learner: ``maps(rows, member_col)`` gives a linear map per member
  (members without one keep their features);
* a base learner: ``probas(train, test, member_col)`` gives ``member, id, proba``
  for every row of ``test``, by the model of the row's member.

``train`` has ``member, id, features, label`` (and ``uid``, a unique long, where
ids repeat), ``test`` has ``member, id, features``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lmnn, neighbors, stumps


class MetricLearner(Protocol):
    def maps(self, rows: DataFrame, member_col: str) -> dict[str, np.ndarray]: ...


class BaseLearner(Protocol):
    def probas(self, train: DataFrame, test: DataFrame, member_col: str) -> DataFrame: ...


@dataclass(frozen=True)
class Identity:
    """No metric: features as they are."""

    def maps(self, rows: DataFrame, member_col: str) -> dict[str, np.ndarray]:
        return {}


@dataclass(frozen=True)
class LMNN:
    """Large-margin nearest neighbours; ``options`` go to ``lmnn.fit``."""
    k: int = 3
    options: dict = field(default_factory=dict)

    def maps(self, rows: DataFrame, member_col: str) -> dict[str, np.ndarray]:
        uid = "uid" if "uid" in rows.columns else "id"
        own = rows.select(member_col, F.col(uid).alias("id"), "features", "label")
        return lmnn.fit(own, k=self.k, member_col=member_col, **self.options).maps


@dataclass(frozen=True)
class KNN:
    """Uniform vote of the ``k`` nearest training rows of the member."""
    k: int = 5

    def probas(self, train: DataFrame, test: DataFrame, member_col: str) -> DataFrame:
        nb = neighbors.knn(test, train, self.k, key_cols=[member_col], train_uid="uid" if "uid" in train.columns else None)
        return neighbors.knn_predict(nb, [member_col]).select(member_col, F.col("qid").alias("id"), "proba")


@dataclass(frozen=True)
class Boosted:
    """SAMME boosting of ``rounds`` stumps."""
    rounds: int = 50

    def probas(self, train: DataFrame, test: DataFrame, member_col: str) -> DataFrame:
        models = stumps.fit_boost(train, self.rounds, member_col=member_col)
        return stumps.predict_boost(test, models, member_col).select(member_col, "id", "proba")


def Stump() -> Boosted:  # noqa: N802 - a learner's name
    """One stump: P(1) is the logistic of its vote."""
    return Boosted(1)


def mapped(df: DataFrame, maps: dict[str, np.ndarray], member_col: str) -> DataFrame:
    """``df`` with every row's features under its member's map."""
    if not maps:
        return df
    return lmnn.apply_map(df, maps, member_col=member_col).drop("features").withColumnRenamed("z", "features")
