"""Mergeable co-moments: count, means and centred cross products of a part of the reference group.

A part is a row. Parts add up: merged counts and means follow from counts and means, and the merged cross products are
those of the parts plus what the parts' means are away from the merged mean. A part may also be taken away, with its
sign. So when a load changes some users, the rows that they had are taken away and those that they have now are
added, and the fitted model follows without another look at anybody else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan.operators import hd

ADDED, TAKEN_AWAY = 1, -1


def _pairs(count: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(count) for j in range(i, count)]


def summed(reference: DataFrame, names: Sequence[str] = hd.NAMES, by: Sequence[Column | str] = (), sign: int = ADDED) -> DataFrame:
    """``Sign, n, Mean, Cross`` of the complete rows, one row per group of ``by``: one pass, centred as it runs.

    ``Cross`` holds the sums of products of every pair, a biomarker with itself included.
    """
    value = [F.col(f"`{name}`").cast("double") for name in names]
    n = F.count(F.lit(1))
    cross = [(F.covar_pop(value[i], value[j]) * n) for i, j in _pairs(len(names))]
    parts = reference.dropna(subset=list(names)).groupBy(*by).agg(
        n.alias("n"), F.array(*[F.avg(v) for v in value]).alias("Mean"), F.array(*cross).alias("Cross")
    )
    return parts.where("n > 0").select(F.lit(sign).alias("Sign"), "n", "Mean", "Cross")


def merged(parts: DataFrame, names: Sequence[str] = hd.NAMES) -> DataFrame:
    """All parts as one row ``n, Mean, Cross``; ``parts`` is read twice, and it is a few numbers per part.

    The merged count and means, one number per biomarker, pass through the driver.
    """
    p = len(names)
    count = F.col("Sign") * F.col("n")
    sums = [F.sum(count * F.col("Mean")[i]).alias(f"m{i}") for i in range(p)]
    whole = parts.agg(F.coalesce(F.sum(count), F.lit(0)).alias("N"), *sums).first()
    n = whole["N"]
    means = [whole[f"m{i}"] / n if n else None for i in range(p)]
    away = [F.col("Mean")[i] - F.lit(means[i]).cast("double") for i in range(p)]
    cross = [
        F.sum(F.col("Sign") * (F.col("Cross")[k] + F.col("n") * away[i] * away[j])) for k, (i, j) in enumerate(_pairs(p))
    ]
    return parts.agg(
        F.lit(n).cast("bigint").alias("n"),
        F.array(*[F.lit(m).cast("double") for m in means]).alias("Mean"),
        F.array(*cross).alias("Cross"),
    )


def _place(p: int) -> dict[tuple[int, int], int]:
    return {pair: k for k, pair in enumerate(_pairs(p))}


def deviations(row: DataFrame, names: Sequence[str] = hd.NAMES) -> DataFrame:
    """``hd.moments`` from a merged row."""
    place = _place(len(names))
    cells = [
        F.struct(
            F.lit(name).alias("Biomarker"),
            F.col("Mean")[i].alias("Mean"),
            F.sqrt(F.greatest(F.col("Cross")[place[i, i]], F.lit(0.0)) / F.when(F.col("n") > 1, F.col("n") - 1)).alias("Std"),
            F.col("n").alias("ReferenceRows"),
        )
        for i, name in enumerate(names)
    ]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def correlation(row: DataFrame, names: Sequence[str] = hd.NAMES) -> DataFrame:
    """``hd.correlation`` from a merged row."""
    place = _place(len(names))
    cross = lambda i, j: F.col("Cross")[place[i, j]]
    cells = [
        F.struct(
            F.lit(names[i]).alias("BiomarkerA"),
            F.lit(names[j]).alias("BiomarkerB"),
            (cross(i, j) / F.sqrt(cross(i, i) * cross(j, j))).alias("Correlation"),
        )
        for i, j in _pairs(len(names))
        if i != j
    ]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def fit(parts: DataFrame, names: Sequence[str] = hd.NAMES, min_rows: int = hd.MIN_REFERENCE_ROWS) -> hd.HDModel:
    """The distance model from stored parts; the reference group is not read. The regression on age is left out."""
    row = merged(parts, names).first()
    place = _place(len(names))
    n = row["n"]
    if n < max(min_rows, 2):
        raise hd.HDUnavailable(f"reference population too small: {n} < {min_rows}")
    found = {"n": n}
    for i in range(len(names)):
        found[f"mean_{i}"] = row["Mean"][i]
        found[f"std_{i}"] = (max(row["Cross"][place[i, i]], 0.0) / (n - 1)) ** 0.5
        for j in range(i + 1, len(names)):
            found[f"p_{i}_{j}"] = row["Cross"][place[i, j]] / (n - 1)
    return hd.from_moments(found, tuple(names), min_rows)


def after_load(parts: DataFrame, before: DataFrame, after: DataFrame, names: Sequence[str] = hd.NAMES) -> DataFrame:
    """``parts`` with what a load changed: ``before`` and ``after`` are the reference rows of the users in it."""
    gone, come = summed(before, names, sign=TAKEN_AWAY), summed(after, names, sign=ADDED)
    return parts.unionByName(gone).unionByName(come)
