"""Exchangeable routing models and embedding backends.

A backend adds one column to a table of texts. Those made of column expressions stay inside
Spark's plan; ``ArrowEmbedding`` and ``ArrowRouter`` hand Arrow batches to a Python model, which is
set up once for each task. ``DecideConfig`` takes any of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from . import embedding as M
from . import scoring as S
from .text import tokenize

#: Distinct tokens that a task of the hash model remembers.
SLOTS = 1 << 18
#: A model: from a list of texts (or token lists) to one row of numbers for each.
Model = Callable[[list], np.ndarray]


class EmbeddingBackend(Protocol):
    dim: int

    def add(self, df: DataFrame, key: str, text: str, out: str) -> DataFrame:
        """``df`` with unit vectors ``out`` of ``dim`` doubles; ``key`` is unique."""


class RoutingModel(Protocol):
    labels: list[str]

    def add(self, requests: DataFrame) -> DataFrame:
        """``requests`` (request_id, issue_text) with ``route_probs``, calibrated, in the order of ``labels``; null where the model fails."""


@dataclass(frozen=True)
class HashEmbedding:
    """Hash embedding by column expressions: three regroupings of the tokens."""

    dim: int = 64

    def add(self, df: DataFrame, key: str, text: str, out: str) -> DataFrame:
        return df.join(M.embed(df, [key], text, self.dim, out), key)


@dataclass(frozen=True)
class ArrowEmbedding:
    """Vectors of any Python model, scaled to length one; a narrow step. ``load`` gives the model in each task."""

    load: Callable[[], Model]
    dim: int = 64

    def add(self, df: DataFrame, key: str, text: str, out: str) -> DataFrame:
        load = self.load

        @F.pandas_udf("array<double>")
        def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                raw = np.asarray(model(texts.fillna("").tolist()), np.float64).reshape(len(texts), -1)
                size = np.linalg.norm(raw, axis=1, keepdims=True)
                yield pd.Series(list(np.divide(raw, size, out=np.zeros_like(raw), where=size > 0)), dtype=object)

        return df.withColumn(out, vectors(F.col(text)))


def hash_model(dim: int = 64) -> Callable[[], Model]:
    """The hash embedding as a Python model; each distinct token of a task is hashed once."""

    def load() -> Model:
        slots: dict[str, tuple[int, float]] = {}

        def slot(token: str) -> tuple[int, float]:
            if token not in slots:
                h = hashlib.sha256(token.encode()).hexdigest()
                sign = -1.0 if int(h[8:10], 16) % 2 == 1 else 1.0
                slots[token] = int(h[:8], 16) % dim, sign * (1.0 + int(h[10:12], 16) / 255.0)
            return slots[token]

        def model(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for row, text in zip(out, texts):
                # emptied as a whole: taking the oldest one by one walks over all that went before it
                if len(slots) > SLOTS:
                    slots.clear()
                for token in re.findall("[a-z0-9]+", text.lower()):
                    at, weight = slot(token)
                    row[at] += weight
            return out

        return model

    return load


@dataclass(frozen=True)
class LinearRouter:
    """The linear token model as a join with its weights."""

    labels: list[str] = field(default_factory=lambda: list(V.ROUTES))

    def add(self, requests: DataFrame) -> DataFrame:
        weights = S.weights_frame(requests.sparkSession, V.ROUTING_MODEL)
        return S.linear_router(requests, weights, V.ROUTING_MODEL["bias"], self.labels, V.ROUTING_CALIBRATION)


@dataclass(frozen=True)
class ArrowRouter:
    """Scores of any Python model over the token lists of the texts; a narrow step.

    Scores are calibrated like the linear model's. A row of scores that holds no number gives
    null, so that the fallback model takes over.
    """

    load: Callable[[], Model]
    labels: list[str] = field(default_factory=lambda: list(V.ROUTES))
    calibration: dict[str, float] = field(default_factory=lambda: dict(V.ROUTING_CALIBRATION))

    def add(self, requests: DataFrame) -> DataFrame:
        load, width = self.load, len(self.labels)

        @F.pandas_udf("array<double>")
        def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for tokens in batches:
                raw = np.asarray(model([list(t) for t in tokens]), np.float64).reshape(len(tokens), width)
                good = np.isfinite(raw).all(axis=1)
                yield pd.Series([r if ok else None for r, ok in zip(raw, good)], dtype=object)

        scored = requests.withColumn("_scores", scores(tokenize(F.col("issue_text"))))
        return scored.withColumn("route_probs", F.when(F.col("_scores").isNotNull(), S.apply_temperature(F.col("_scores"), self.calibration))).drop("_scores")


def linear_model(model: dict, labels: list[str]) -> Callable[[], Model]:
    """The linear token model as a Python model."""

    def load() -> Model:
        weights, bias = model["token_weights"], np.array([float(model["bias"].get(n, 0.0)) for n in labels])
        none = np.zeros(len(labels))
        rows = {t: np.array([float(w.get(n, 0.0)) for n in labels]) for t, w in weights.items()}

        def score(lists: list[list[str]]) -> np.ndarray:
            return np.array([sum((rows[t] for t in tokens if t in rows), none) for tokens in lists]).reshape(len(lists), len(labels)) + bias

        return score

    return load
