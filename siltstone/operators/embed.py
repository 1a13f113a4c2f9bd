"""Embedding texts: any model behind one interface, in Arrow batches on the executors."""

from __future__ import annotations

import json
import random
import time
import urllib.request
from collections.abc import Callable
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import scalar

Embedder = Callable[[list[str]], list[list[float]]]


def backoff_ms(attempt: int, chance: float = 0.0) -> float:
    """Wait before the next attempt: doubling from a second, up to a third more by ``chance`` in [0, 1), at most 30 s."""
    return min(1000 * 2**attempt * (1 + 0.3 * chance), 30_000)


def mean_pool_tokens(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """(batch, tokens, dim) and (batch, tokens) to unit vectors (batch, dim): the mean over unmasked tokens."""
    m = mask[:, :, None].astype(np.float64)
    pooled = (hidden * m).sum(1) / np.maximum(m.sum(1), 1e-9)
    size = np.linalg.norm(pooled, axis=1, keepdims=True)
    return np.divide(pooled, size, out=pooled.copy(), where=size > 0)


class HttpEmbedder:
    """Calls ``POST {base}/embeddings`` with model and input; answers are put in order of ``index``, or as they come without it."""

    def __init__(self, base: str, model: str, key: str | None = None, retries: int = 3, timeout: float = 60, post: Callable[[str, dict], dict] | None = None, wait: Callable[[float], None] = time.sleep):
        self.base, self.model, self.key, self.retries, self.timeout, self.wait = base.rstrip("/"), model, key, retries, timeout, wait
        self._post = post or self._send

    def _send(self, url: str, body: dict) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=self.timeout) as r:
            return json.load(r)

    def ping(self) -> bool:
        """Whether the service answers ``GET {base}/models``."""
        headers = {"Authorization": f"Bearer {self.key}"} if self.key else {}
        try:
            with urllib.request.urlopen(urllib.request.Request(f"{self.base}/models", headers=headers), timeout=min(5, self.timeout)) as r:
                return r.status == 200
        except (OSError, ValueError):
            return False

    def __call__(self, texts: list[str]) -> list[list[float]]:
        for attempt in range(self.retries):
            try:
                data = self._post(f"{self.base}/embeddings", {"model": self.model, "input": texts})["data"]
                if len(data) != len(texts):
                    raise ValueError(f"{len(texts)} texts, {len(data)} vectors")
                return [d["embedding"] for d in sorted(data, key=lambda d: d.get("index", 0))]
            except (OSError, ValueError, KeyError):
                if attempt + 1 == self.retries:
                    raise
                self.wait(backoff_ms(attempt, random.random()) / 1000)
        raise AssertionError


def embed(rows: DataFrame, body: str, make: Callable[[], Embedder], batch: int = 32, prefix: str = "", context_limit: int = 512, dim: int | None = None) -> DataFrame:
    """``rows`` with a column ``vector``: ``make()`` builds the model once per task, texts go through in batches.

    A batch that fails is tried text by text; a text that fails alone gets null, as does a null
    text, and with ``dim`` so does a vector of another length.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()

        def vectors(texts: list[str]) -> list:
            try:
                return model(texts)
            except Exception:  # noqa: BLE001 - whatever a model raises
                if len(texts) == 1:
                    return [None]
                return [v for t in texts for v in vectors([t])]

        for s in batches:
            out = [None] * len(s)
            there = [i for i, t in enumerate(s) if t is not None]
            for k in range(0, len(there), batch):
                part = there[k : k + batch]
                for i, v in zip(part, vectors([prefix + s.iloc[i] for i in part])):
                    out[i] = None if v is None or dim and len(v) != dim else [float(x) for x in v]
            yield pd.Series(out)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn("vector", F.pandas_udf(run, "array<float>")(scalar.truncate_to_context(F.col(body), context_limit)))


def embed_placeholder(rows: DataFrame, body: str, dim: int) -> DataFrame:
    """``rows`` with a vector made from the text's hash, for indexes without a model."""
    return rows.withColumn("vector", scalar.placeholder_embedding(F.col(body), dim))


def placeholder_vector(text: str, dim: int) -> list[float]:
    """The same for one query, outside of a plan."""
    h = 5381
    for c in scalar.utf16_units(text):
        h = (h * 33 & scalar.U32) ^ c
    m = 2147483647
    x, raw = h % m or 1, []
    for _ in range(dim):
        x = x * 16807 % m
        raw.append(float(np.float32(x / m * 2 - 1)))
    size = sum(v * v for v in raw) ** 0.5
    return [float(np.float32(v / size)) for v in raw]
