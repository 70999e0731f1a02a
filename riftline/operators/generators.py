"""Synthetic series from digests of (seed, position): the same in every run and engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = {"A": 100.0, "B": 200.0}


def uniform(seed: str, *parts):
    """In (0, 1), from 48 bits of a digest."""
    text = F.md5(F.concat_ws("-", F.lit(seed), *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(text, 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48)


def laplace(u, scale):
    """Inverse distribution function; a standard deviation s has scale s / sqrt(2)."""
    v = u - 0.5
    return -scale * F.sign(v) * F.ln(1 - 2 * F.abs(v))


def normal(u, v):
    return F.sqrt(-2 * F.ln(u)) * F.cos(v * F.lit(6.283185307179586))


def blocks_and_ramps(spark: SparkSession, cycles: int, block: int, width: int) -> DataFrame:
    """t, state (0 A, 1 ramp, 2 B), mean: alternating blocks joined by linear ramps; none after the last block."""
    period, count = block + width, 2 * cycles
    t = spark.range(count * block + (count - 1) * width).withColumnRenamed("id", "t")
    k, at = F.floor(F.col("t") / period), F.col("t") % period
    even = k % 2 == 0
    here, there = F.when(even, STATES["A"]).otherwise(STATES["B"]), F.when(even, STATES["B"]).otherwise(STATES["A"])
    ramp = at >= block
    share = (at - block + 1) / float(width + 1)
    return t.select("t", F.when(ramp, 1).when(even, 0).otherwise(2).alias("state"), F.when(ramp, here + share * (there - here)).otherwise(here).alias("mean"))


def toy(spark: SparkSession, cycles: int = 10, block: int = 250, width: int = 10, sigma: float = 5.0, seed: str = "toy") -> DataFrame:
    """A noisy two-state series; ``sigma`` is the noise's standard deviation."""
    rows = blocks_and_ramps(spark, cycles, block, width)
    return rows.withColumn("x", F.col("mean") + laplace(uniform(seed, F.col("t")), sigma / 2**0.5))


def variance_arms(spark: SparkSession, distance: float = 20.0, blocks: int = 20, block: int = 250, seed: str = "arms") -> DataFrame:
    """kind, t, x: equal W2 between alternating states, by mean, by scale, or by both."""
    rows = spark.range(blocks * block).select(F.col("id").alias("t"), (F.floor(F.col("id") / block) % 2).alias("b"))
    arms = []
    for kind, shift, widen in (("mean", distance, 0.0), ("variance", 0.0, distance / 2**0.5), ("both", distance / 2**0.5, distance / 2)):
        noise = laplace(uniform(seed, F.lit(kind), F.col("t")), 5.0 + F.col("b") * widen)
        arms.append(rows.select(F.lit(kind).alias("kind"), "t", (F.col("b") * shift + noise).alias("x")))
    return arms[0].union(arms[1]).union(arms[2])


def imbalanced(spark: SparkSession, ratio: int = 3, cycles: int = 8, block: int = 200, delta: float = 12.0, scale: float = 15.0, seed: str = "imbalanced") -> DataFrame:
    """t, label (0 base, 1 small, 2 big), x: base, small, base, big ... base; a big excursion is ``ratio`` times a small one."""
    rows = spark.range((4 * cycles + 1) * block).select(F.col("id").alias("t"), (F.floor(F.col("id") / block) % 4).alias("k"))
    label = F.when(F.col("k") == 1, 1).when(F.col("k") == 3, 2).otherwise(0)
    mean = F.when(label == 1, delta).when(label == 2, delta * ratio).otherwise(0.0)
    return rows.select("t", label.alias("label"), (mean + laplace(uniform(seed, F.col("t")), scale)).alias("x"))


def correlation_flip(spark: SparkSession, length: int = 2000, change: int = 1000, rho: float = 0.85, seed: str = "flip") -> DataFrame:
    """t, x1, x2 of unit variance whose correlation changes sign; the marginals stay."""
    t = F.col("id")
    a = normal(uniform(seed, F.lit(1), t), uniform(seed, F.lit(2), t))
    b = normal(uniform(seed, F.lit(3), t), uniform(seed, F.lit(4), t))
    r = F.when(t < change, -rho).otherwise(rho)
    return spark.range(length).select(t.alias("t"), a.alias("x1"), (r * a + (1 - rho**2) ** 0.5 * b).alias("x2"))


def copula_flip(spark: SparkSession, length: int = 2000, change: int = 1000, seed: str = "copula") -> DataFrame:
    """t, x1, x2: independent, then x2 is x1 with a random sign; correlation stays zero."""
    t = F.col("id")
    a = normal(uniform(seed, F.lit(1), t), uniform(seed, F.lit(2), t))
    b = normal(uniform(seed, F.lit(3), t), uniform(seed, F.lit(4), t))
    sign = F.when(uniform(seed, F.lit(5), t) < 0.5, -1.0).otherwise(1.0)
    return spark.range(length).select(t.alias("t"), a.alias("x1"), F.when(t < change, b).otherwise(sign * a).alias("x2"))


def two_regimes(spark: SparkSession, length: int = 10_000, seed: str = "regimes") -> DataFrame:
    t = F.col("id")
    z = normal(uniform(seed, F.lit(1), t), uniform(seed, F.lit(2), t))
    return spark.range(length).select(t.alias("t"), F.when(t < length // 2, 0.85 * z).otherwise(0.75 * z + 1.0).alias("x"))


def four_well(spark: SparkSession, length: int = 10_000, substeps: int = 500, step: float = 1e-5, start: float = -0.5, seed: int = 42) -> DataFrame:
    """t, x of overdamped motion in a four-well potential; one trajectory is one serial task."""

    def kernel(batches):
        import numpy as np
        import pandas as pd

        rng = np.random.default_rng(seed)
        for pdf in batches:
            for _ in range(len(pdf)):
                x, out = start, np.empty(length)
                kick = (2 * step) ** 0.5
                for i in range(length):
                    out[i] = x
                    for z in rng.standard_normal(substeps):
                        # potential 4 (x^8 + 0.8 e^{-80 x^2} + 0.2 e^{-80 (x - 0.5)^2} + 0.5 e^{-40 (x + 0.5)^2})
                        force = -4 * (8 * x**7 - 128 * x * np.exp(-80 * x * x) - 32 * (x - 0.5) * np.exp(-80 * (x - 0.5) ** 2) - 40 * (x + 0.5) * np.exp(-40 * (x + 0.5) ** 2))
                        x += step * force + kick * z
                yield pd.DataFrame({"t": np.arange(length), "x": out})

    return spark.range(1).mapInPandas(kernel, "t long, x double")
