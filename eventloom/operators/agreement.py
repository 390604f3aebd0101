"""Agreement of partitions and stability evidence, from contingency tables."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RELIABLE, QUALIFIED, CORE, RECOVERED = 0.75, 0.5, 0.8, 0.75


def _runs(df: DataFrame) -> list[str]:
    return ["run_id"] if "run_id" in df.columns else []


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """(ref, cand, n) of two labellings (event_id, label) on their shared events; run by run where ``b`` has a run_id."""
    by = _runs(b)
    both = a.select("event_id", F.col("label").alias("ref")).join(b.select(*by, "event_id", F.col("label").alias("cand")), "event_id")
    return both.groupBy(*by, "ref", "cand").agg(F.count("*").alias("n"))


def adjusted_rand(table: DataFrame) -> DataFrame:
    """The adjusted Rand index of a contingency table: one row, or one a run."""
    by = _runs(table)
    squares = lambda c, name: table.groupBy(*by, c).agg(F.sum("n").alias("s")).groupBy(*by).agg(F.sum(F.col("s") * F.col("s")).cast("double").alias(name))
    x = table.groupBy(*by).agg(F.sum(F.col("n") * F.col("n")).cast("double").alias("c"), F.sum("n").cast("double").alias("t"))
    for side in (squares("ref", "a"), squares("cand", "b")):
        x = x.join(side, by) if by else x.crossJoin(side)  # one row each without runs
    tp, fp, fn = F.col("c") - F.col("t"), F.col("b") - F.col("c"), F.col("a") - F.col("c")
    tn = F.col("t") * F.col("t") - fp - fn - F.col("c")
    return x.select(*by, F.when((fp == 0) & (fn == 0), 1.0).otherwise(2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn))).alias("ari"))


def best_jaccard(table: DataFrame) -> DataFrame:
    """(run_id, community, jaccard, cand): the best match of each reference community in each run, the lowest id at ties."""
    a = table.groupBy("run_id", "ref").agg(F.sum("n").alias("na"))
    b = table.where("cand >= 0").groupBy("run_id", "cand").agg(F.sum("n").alias("nb"))
    j = table.join(a, ["run_id", "ref"]).join(b, ["run_id", "cand"]).where("ref >= 0")
    j = j.select("run_id", F.col("ref").alias("community"), "cand", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("jaccard"))
    first = F.max_by(F.struct("jaccard", "cand"), F.struct("jaccard", -F.col("cand")))
    return j.groupBy("run_id", "community").agg(first.alias("m")).select("run_id", "community", "m.jaccard", "m.cand")


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 1, by Stirling's series eight places further on."""
    y = x + 8.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return series - sum(np.log(x + i) for i in range(8))


def _ami(t: pd.DataFrame) -> float:
    a, b, n = t.groupby("ref").n.sum(), t.groupby("cand").n.sum(), int(t.n.sum())
    if len(a) == len(b) == 1 or len(a) == len(b) == n:
        return 1.0
    c = t.n.to_numpy(float)
    mi = float((c / n * np.log(n * c / (a[t.ref].to_numpy(float) * b[t.cand].to_numpy(float)))).sum())
    entropy = lambda s: float(-(s / n * np.log(s / n)).sum())
    expected = 0.0
    # sizes that several communities have are taken once; shared counts lie within 40 deviations of their mean, or weigh nothing
    for (x, kx), (y, ky) in product(a.value_counts().items(), b.value_counts().items()):
        spread = 40 * math.sqrt(x * y / n * (1 - x / n) * (1 - y / n) * n / max(1, n - 1)) + 40
        low, high = max(1, x + y - n, int(x * y / n - spread)), min(x, y, int(x * y / n + spread) + 1)
        c = np.arange(low, high + 1, dtype=float)
        g = lambda v: math.lgamma(v + 1)
        log_p = g(x) + g(y) + g(n - x) + g(n - y) - g(n) - _log_gamma(c + 1) - _log_gamma(x - c + 1) - _log_gamma(y - c + 1) - _log_gamma(n - x - y + c + 1)
        expected += kx * ky * float((c / n * np.log(n * c / (x * y)) * np.exp(log_p)).sum())
    return (mi - expected) / ((entropy(a) + entropy(b)) / 2 - expected)


def adjusted_mutual_info(table: DataFrame) -> DataFrame:
    """The adjusted mutual information (arithmetic mean): one row, or one a run; the table has a row a pair of communities."""
    if _runs(table):
        return table.groupBy("run_id").applyInPandas(lambda t: pd.DataFrame({"run_id": [t.run_id.iloc[0]], "ami": [_ami(t)]}), "run_id long, ami double")
    return table.groupBy().applyInPandas(lambda t: pd.DataFrame({"ami": [_ami(t)]}), "ami double")


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two arrays' sets; 1 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def core_scores(hits: DataFrame) -> DataFrame:
    """(event_id, core) of (event_id, community, hit), one row for each draw: the share of hits; -1 where unassigned."""
    return hits.groupBy("event_id").agg(F.when(F.max("community") < 0, -1.0).otherwise(F.avg(F.col("hit").cast("double"))).alias("core"))


def verdict(mean_jaccard: Column, core_fraction: Column) -> Column:
    return F.when((mean_jaccard >= RELIABLE) & (core_fraction >= CORE), "reliable").when(mean_jaccard >= QUALIFIED, "qualified").otherwise("unreliable")


def summary(matches: DataFrame, cores: DataFrame) -> DataFrame:
    """(community, size, mean_jaccard, low_jaccard, recovery, core_fraction, verdict) of matches (run_id, community, jaccard) and cores (event_id, community, core)."""
    j = matches.groupBy("community").agg(F.avg("jaccard").alias("mean_jaccard"), F.percentile("jaccard", 0.05).alias("low_jaccard"), F.avg((F.col("jaccard") >= RECOVERED).cast("double")).alias("recovery"))
    c = cores.groupBy("community").agg(F.count("*").alias("size"), F.avg((F.col("core") >= CORE).cast("double")).alias("core_fraction"))
    return j.join(c, "community").withColumn("verdict", verdict(F.col("mean_jaccard"), F.col("core_fraction")))


def boundary_fraction(cores: DataFrame) -> DataFrame:
    return cores.where("core >= 0").agg(F.coalesce(F.avg((F.col("core") < CORE).cast("double")), F.lit(0.0)).alias("boundary_fraction"))


def k_grid(k: int) -> list[int]:
    return sorted({max(2, k // 2), max(2, int(0.75 * k)), max(2, k), max(3, int(1.5 * k)), max(3, 2 * k)})


def resolution_grid(resolution: float) -> list[float]:
    return [round(resolution * f, 3) for f in (0.5, 0.75, 1.0, 1.5, 2.0)]
