"""One local session for all tests, and small helpers."""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from glosswork.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build("tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rng():
    return np.random.default_rng(7)


@pytest.fixture(scope="session")
def toy(spark):
    """States of two modes, an unembedding of eight tokens, and both as arrays."""
    r = np.random.default_rng(3)
    h = np.concatenate([r.normal(1.2, 0.4, (60, 4)), r.normal(-1.2, 0.4, (60, 4))])
    w = r.normal(size=(8, 4)) * 0.5
    states = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(h)], "row bigint, h array<double>").repartition(3)
    unembedding = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(w)], "token int, w array<double>")
    logits = h @ w.T
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return {"states": states, "unembedding": unembedding, "h": h, "w": w, "p": p}


def matrix_of(df, i: str, j: str, value: str) -> np.ndarray:
    rows = df.select(i, j, value).collect()
    out = np.full((max(r[0] for r in rows) + 1, max(r[1] for r in rows) + 1), np.nan)
    for r in rows:
        out[r[0], r[1]] = r[2]
    return out


@pytest.fixture
def as_matrix():
    return matrix_of
