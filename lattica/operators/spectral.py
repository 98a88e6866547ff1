"""Discrete Fourier transforms of sampled series: forward, unnormalised, padded with zeros to a power of two."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.tables import join_on


def next_power(n: int) -> int:
    if n < 1:
        raise ValueError("a transform needs a sample at least")
    return 1 << (n - 1).bit_length()


def dft(signal: DataFrame, group: list[str], n: str, x: str, size: int) -> DataFrame:
    """(group, k, re, im) for k < size: every sample meets every frequency, and sums are combined before the shuffle.

    For many series of moderate, known length; samples that are left out count as zero.
    """
    size = next_power(size)
    terms = signal.select(*group, F.col(n).alias("_n"), F.col(x).cast("double").alias("_x"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("k"))
    angle = F.lit(2 * math.pi / size) * F.pmod(F.col("_n") * F.col("k"), F.lit(size))
    return terms.groupBy(*group, "k").agg(F.sum(F.col("_x") * F.cos(angle)).alias("re"), (-F.sum(F.col("_x") * F.sin(angle))).alias("im"))


#: Bits of a stage's factor.
RADIX_BITS = 6


def fft(signal: DataFrame, group: list[str], n: str, x: str) -> DataFrame:
    """(group, k, re, im) of each series, padded with zeros to a power of two N of its own, in stages of a factor R of up to 64.

    With M = R M' samples left, a sample's place is n1 M' + n2 and a frequency k1 + R k2: sums over n1, combined before their shuffle, and a turn
    by n2 k1 / M leave R series of M' samples, whose numbers k1 are the lowest digits of the frequency.  So a sample meets 64 rows a stage,
    64 log64(N) in all.  Samples that are left out count as zero; groups may be null.
    """
    place = F.col(n).cast("long")
    rows = signal.select(*group, place.alias("_n"), F.col(x).cast("double").alias("_re"))
    bits = F.when(F.max("_n") > 0, F.length(F.bin(F.max("_n")))).otherwise(0)
    sizes = rows.groupBy(*group).agg(bits.cast("int").alias("_bits"))
    stages = max(1, -(-(sizes.agg(F.max("_bits")).first()[0] or 0) // RADIX_BITS))
    one = lambda c: F.pow(F.lit(2.0), c).cast("long")
    state = join_on(rows, sizes, group).select(*group, "_n", F.lit(0).cast("long").alias("_k"), F.lit(1).cast("long").alias("_stride"), "_bits", "_re", F.lit(0.0).alias("_im"))
    for _ in range(stages):
        now = F.least("_bits", F.lit(RADIX_BITS))
        spread = state.select("*", one(now).alias("_r"), one(F.col("_bits") - now).alias("_m")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_r") - 1)).alias("_k1"))
        angle = -2 * math.pi * F.pmod(F.expr("_n div _m") * F.col("_k1"), F.col("_r")) / F.col("_r")
        re, im = F.col("_re") * F.cos(angle) - F.col("_im") * F.sin(angle), F.col("_re") * F.sin(angle) + F.col("_im") * F.cos(angle)
        keys = [*group, "_bits", "_stride", "_k", "_r", "_m", "_k1"]
        summed = spread.groupBy(*keys, (F.col("_n") % F.col("_m")).alias("_n2")).agg(F.sum(re).alias("_re"), F.sum(im).alias("_im"))
        size = F.col("_r") * F.col("_m")
        turn = -2 * math.pi * F.pmod(F.col("_n2") * F.col("_k1"), size) / size
        turned = F.col("_re") * F.cos(turn) - F.col("_im") * F.sin(turn), F.col("_re") * F.sin(turn) + F.col("_im") * F.cos(turn)
        state = summed.select(*group, F.col("_n2").alias("_n"), (F.col("_k") + F.col("_stride") * F.col("_k1")).alias("_k"), (F.col("_stride") * F.col("_r")).alias("_stride"), F.greatest(F.col("_bits") - RADIX_BITS, F.lit(0)).alias("_bits"), turned[0].alias("_re"), turned[1].alias("_im"))
    return state.select(*group, F.col("_k").alias("k"), F.col("_re").alias("re"), F.col("_im").alias("im"))
