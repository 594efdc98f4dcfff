"""Samples: scaling, levels, mixing, resampling and chunking of PCM audio."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

RATE = 16_000
_LEVELS = StructType([StructField("n", IntegerType()), StructField("rms", DoubleType()), StructField("peak", DoubleType())])


@F.pandas_udf(_LEVELS)
def levels(pcm: pd.Series) -> pd.DataFrame:
    """Sample count, root mean square and peak of 16-bit little-endian mono PCM, scaled to 1."""
    rows = []
    for b in pcm:
        x = np.frombuffer(b or b"", "<i2").astype(np.float64) / 32768.0
        rows.append((len(x), float(np.sqrt((x * x).mean())) if len(x) else 0.0, float(np.abs(x).max()) if len(x) else 0.0))
    return pd.DataFrame(rows, columns=["n", "rms", "peak"])


def to_int16(samples: Column) -> Column:
    """Doubles clipped to -1..1 and scaled to 16 bits."""
    return F.transform(samples, lambda x: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 32767).cast("smallint"))


def from_int16(samples: Column) -> Column:
    return F.transform(samples, lambda x: x / F.lit(32768.0))


@F.pandas_udf(ArrayType(DoubleType()))
def mono(samples: pd.Series, channels: pd.Series) -> pd.Series:
    """Mean over interleaved channels."""
    return pd.Series([np.asarray(s, float).reshape(-1, int(c)).mean(1) for s, c in zip(samples, channels)])


@F.pandas_udf(ArrayType(DoubleType()))
def resample(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """Linear interpolation to 16 kHz."""

    def one(x, r):
        x = np.asarray(x, float)
        if r == RATE or not len(x):
            return x
        n = int(round(len(x) * RATE / r))
        return np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), x)

    return pd.Series([one(s, r) for s, r in zip(samples, rate)])


def chunks(df: DataFrame, key: str, order: str, size: int, keep_tail: bool = True) -> DataFrame:
    """Number of the fixed-size chunk that each row of a key's stream falls in; an incomplete last one stays or goes."""
    w = Window.partitionBy(key).orderBy(order)
    out = df.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size).cast("long"))
    if keep_tail:
        return out
    return out.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key, "chunk"))).where(F.col("_n") == size).drop("_n")


def windows(length: Column | str, size: float = 29.5, overlap: float = 1.0) -> Column:
    """Start and end seconds of overlapping windows over a recording, the last one cut at its end."""
    length = F.col(length) if isinstance(length, str) else length
    hop = size - overlap
    n = F.greatest(F.lit(1), F.ceil((length - overlap) / hop)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * hop).alias("start"), F.least(length, i * hop + size).alias("end")))
