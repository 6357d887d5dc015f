"""Comparison of a signal with a reference."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pcm


def difference(df: DataFrame, reference: str, decoded: str, *keys: str) -> DataFrame:
    """max_abs, rms and snr_db of long-form samples for each key.

    snr_db is infinite without error and null for a silent reference.
    """
    d = F.col(reference) - F.col(decoded)
    sums = df.groupBy(*keys).agg(F.max(F.abs(d)).alias("max_abs"), F.sum(d * d).alias("_n"), F.sum(F.col(reference) * F.col(reference)).alias("_s"), F.count("*").alias("n"))
    return sums.select(*keys, "n", "max_abs", F.sqrt(F.col("_n") / F.col("n")).alias("rms"), snr(F.col("_s"), F.col("_n")).alias("snr_db"))


def snr(signal: Column, noise: Column) -> Column:
    return F.when(signal <= 0, F.lit(None)).when(noise <= 0, F.lit(float("inf"))).otherwise(10.0 * F.log10(signal / noise))


def array_difference(reference: Column, decoded: Column) -> Column:
    """The same for two arrays of a row, without a shuffle."""
    d = F.zip_with(reference, decoded, lambda a, b: a - b)
    noise, signal = pcm.total(d, lambda x: x * x), pcm.total(reference, lambda x: x * x)
    return F.struct(pcm.max_abs(d).alias("max_abs"), F.sqrt(noise / F.size(reference)).alias("rms"), snr(signal, noise).alias("snr_db"))


@dataclass(frozen=True)
class Tolerance:
    max_abs: float | None = None
    rms: float | None = None
    snr_db: float | None = None

    def __post_init__(self):
        for x in (self.max_abs, self.rms):
            if x is not None and not 0 <= x < float("inf"):
                raise ValueError("a tolerance must be finite and not negative")
        if self.snr_db is not None and not abs(self.snr_db) < float("inf"):
            raise ValueError("a bound on the ratio must be finite")


def verdict(diff: Column, tolerance: Tolerance) -> Column:
    """'pass', or the first bound that fails: max_abs, rms, snr_db (a silent reference fails that one)."""
    out = F.lit("pass")
    if tolerance.snr_db is not None:
        out = F.when(diff["snr_db"].isNull() | (diff["snr_db"] < tolerance.snr_db), "snr_db").otherwise(out)
    if tolerance.rms is not None:
        out = F.when(diff["rms"] > tolerance.rms, "rms").otherwise(out)
    if tolerance.max_abs is not None:
        out = F.when(diff["max_abs"] > tolerance.max_abs, "max_abs").otherwise(out)
    return out


def correlation(a: Column, b: Column, eps: float = 1e-20) -> Column:
    """Normalised, not centred; 0 where either power is at most eps."""
    aa, bb = pcm.total(a, lambda x: x * x), pcm.total(b, lambda x: x * x)
    return F.when((aa <= eps) | (bb <= eps), 0.0).otherwise(pcm.dot(a, b) / (F.sqrt(aa) * F.sqrt(bb)))


def lag_correlations(reference: Column, other: Column, n: int, lags: int) -> Column:
    """Correlation of the reference with the other signal delayed by 0 ... lags - 1, over what overlaps."""
    return F.transform(F.sequence(F.lit(0), F.lit(lags - 1)), lambda k: F.struct(k.cast("long").alias("lag"), correlation(F.slice(reference, F.lit(1), F.lit(n) - k), F.slice(other, k + 1, F.lit(n) - k)).alias("corr")))


def best_lag(reference: Column, other: Column, n: int, lags: int, digits: int = 9) -> Column:
    """The first lag of the highest correlation, compared to that many digits."""
    each = F.transform(lag_correlations(reference, other, n, lags), lambda s: F.struct(F.round(s["corr"], digits).alias("corr"), (-s["lag"]).alias("neg")))
    top = F.array_max(each)
    return F.struct((-top["neg"]).alias("lag"), top["corr"].alias("corr"))


def quality_gate(reference_rms: Column, decoded_rms: Column, corr: Column) -> Column:
    """Level between 1/20 and 32 times the reference's and correlation from 0.2 up."""
    ratio = decoded_rms / reference_rms
    return (reference_rms > 0) & (ratio >= 0.05) & (ratio <= 32.0) & (corr >= 0.2)
