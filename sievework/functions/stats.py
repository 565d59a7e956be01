"""Scalar statistics: logistic functions, calibration shifts, bit hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.log(q / (1 - q))


def with_temperature(p: Column, t) -> Column:
    return sigmoid(logit(p) / t)


def prior_shift(p: Column, sample: float, deployed: float) -> Column:
    """Bayes correction of a probability for another class share."""
    return sigmoid(logit(p, 1e-9) + float(np.log(deployed / (1 - deployed)) - np.log(sample / (1 - sample))))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def softmax_pair(z0: Column, z1: Column) -> Column:
    """Share of the second of two logits."""
    return sigmoid(z1 - z0)


def _pack(bits: np.ndarray) -> int:
    return int(np.packbits(bits.ravel()[:64].astype(np.uint8)).view(">i8")[0])


def _dct(n: int) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * i + 1) / (2 * n))


@F.pandas_udf(T.LongType())
def perceptual_hash(gray: pd.Series) -> pd.Series:
    """64 bits from a 32 x 32 grey image, row by row: low cosine coefficients above their median."""
    d = _dct(32)

    def one(x):
        low = (d @ np.asarray(x, float).reshape(32, 32) @ d.T)[:8, :8]
        return _pack(low > np.median(low.ravel()[1:]))

    return gray.map(lambda x: None if x is None or len(x) != 1024 else one(x))


@F.pandas_udf(T.LongType())
def difference_hash(gray: pd.Series) -> pd.Series:
    """64 bits from a 9 wide, 8 high grey image: where brightness rises to the right."""
    return gray.map(lambda x: None if x is None or len(x) != 72 else _pack(np.diff(np.asarray(x, float).reshape(8, 9), axis=1) > 0))
