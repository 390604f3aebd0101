"""Comparison of two communities: effect sizes, intervals, tests and distances, all markers in one aggregation.

Rows are (marker, side, value) with side 'a' or 'b'.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.errors import ConfigurationError
from eventloom.operators.graph import METRICS, NUMBERS, _size, _whole, cells, nearest
from eventloom.operators.ranks import quantiles, running
from eventloom.plans.lineage import cut

RANGE, AT_ONCE, MOST_POOLED = 1 << 15, 50, 10**9  # distinct values of a range, replicates drawn at once, rows of a marker that are shuffled


def _by_value(rows: DataFrame) -> DataFrame:
    return rows.groupBy("marker", "value").agg(F.count_if(F.col("side") == "a").alias("a"), F.count_if(F.col("side") == "b").alias("b"))


def _delta(u: Column) -> Column:
    return 2 * u / (F.col("n_a") * F.col("n_b")) - 1


def cliffs_delta(rows: DataFrame) -> DataFrame:
    """(marker, n_a, n_b, delta), from counts by value: ties share their middle rank."""
    won = running(_by_value(rows), ["marker"], "value", ["b"]).withColumn("u", F.col("a") * (F.col("below_b") + F.col("b") / 2.0))
    sums = won.groupBy("marker").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum("u").alias("u")).where("n_a > 0 and n_b > 0")
    return sums.select("marker", "n_a", "n_b", _delta(F.col("u")).alias("delta"))


def magnitude(delta: Column) -> Column:
    a = F.abs(delta)
    return F.when(a < 0.147, "negligible").when(a < 0.33, "small").when(a < 0.474, "medium").otherwise("large")


def medians(rows: DataFrame) -> DataFrame:
    """(marker, side, median, mad)."""
    mid = quantiles(rows, ["marker", "side"], "value", [0.5]).withColumnRenamed("q_0", "median")
    far = rows.join(F.broadcast(mid), ["marker", "side"]).select("marker", "side", F.abs(F.col("value") - F.col("median")).alias("far"))  # two rows a marker
    return mid.join(F.broadcast(quantiles(far, ["marker", "side"], "far", [0.5])), ["marker", "side"]).withColumnRenamed("q_0", "mad")


def benjamini_hochberg(tests: DataFrame) -> DataFrame:
    """``tests`` (marker, p) with q; one row a marker."""
    by_p = Window.orderBy("p", "marker")
    ranked = tests.withColumn("r", F.row_number().over(by_p)).withColumn("m", F.count("*").over(Window.partitionBy()))
    up = Window.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("q", F.least(F.lit(1.0), F.min(F.col("p") * F.col("m") / F.col("r")).over(up))).drop("r", "m")


class _Ranges:
    """Distinct values of each marker, cut in their order into ranges of ``RANGE``, and the counts of all ranges by marker.

    The ranges depend on the data alone, so resamples are the same in any partitioning. The driver gets two sums a range.
    """

    def __init__(self, rows: DataFrame):
        by = running(_by_value(rows).withColumn("one", F.lit(1)), ["marker"], "value", ["one", "a", "b"])
        ranked = by.select("marker", "value", "a", "b", (F.col("below_a") + F.col("below_b") + (F.col("a") + F.col("b") + 1) / 2.0).alias("rank"), F.floor(F.col("below_one") / RANGE).alias("range"))
        self.rows = cut(ranked)
        self.sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        sums = self.rows.groupBy("marker", "range").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).orderBy("marker", "range").toPandas()
        for marker, d in sums.groupby("marker"):
            if d.a.sum() and d.b.sum():
                self.sums[marker] = (d.a.to_numpy(np.int64), d.b.to_numpy(np.int64))

    def draw(self, n: int, seed: int, fn) -> DataFrame:
        """(marker, replicate, u): the sum over a marker's ranges of what ``fn`` gives for blocks of replicates.

        ``fn(shared, own, a, b, rank, at, A, B, m)`` gets a stream that all ranges of a marker share, one of the range's own, the range's counts and
        ranks by value, its place, and the counts of all ranges; it returns m numbers.
        """
        spark, sums = self.rows.sparkSession, self.sums
        sent = spark.sparkContext.broadcast(sums)

        def run(key, table):
            marker, at = key[0].as_py(), key[1].as_py()
            order = np.argsort(table.column("value").to_numpy())
            a, b, rank = (table.column(c).to_numpy()[order] for c in ("a", "b", "rank"))
            word, out = int.from_bytes(str(marker).encode(), "little") % (1 << 63), []
            for block, first in enumerate(range(0, n, AT_ONCE)):
                m = min(AT_ONCE, n - first)
                stream = lambda i: np.random.default_rng([seed, word, block, i])
                out.append(fn(stream(0), stream(1 + at), a, b, rank, at, *sent.value[marker], m))
            return pa.table({"marker": pa.array([marker] * n), "replicate": pa.array(np.arange(n)), "u": pa.array(np.concatenate(out))})

        known = self.rows.where(F.col("marker").isin(list(sums))) if sums else self.rows.limit(0)
        got = known.groupBy("marker", "range").applyInArrow(run, f"marker {dict(self.rows.dtypes)['marker']}, replicate long, u double")
        return got.groupBy("marker", "replicate").agg(F.sum("u").alias("u"))

    def sizes(self) -> DataFrame:
        """(marker, n_a, n_b), a row a marker."""
        return self.rows.groupBy("marker").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b")).where("n_a > 0 and n_b > 0")


def _resampled(shared, own, a, b, rank, at, A, B, m) -> np.ndarray:
    """Wins of side a over side b in m resamples with replacement, as far as this range's a is concerned; ties count half."""
    share_a, share_b = (shared.multinomial(c.sum(), c / c.sum(), size=m) for c in (A, B))
    draw = lambda c, n: own.multinomial(n, c / c.sum(), size=m) if c.sum() else np.zeros((m, len(c)), np.int64)
    got_a, got_b = draw(a, share_a[:, at]), draw(b, share_b[:, at])
    below = np.cumsum(got_b, axis=1) - got_b / 2.0
    return (got_a * below).sum(1) + share_a[:, at] * share_b[:, :at].sum(1).astype(float)


def _shuffled(shared, own, a, b, rank, at, A, B, m) -> np.ndarray:
    """Sum of the pooled ranks that side a gets from this range in m shuffles."""
    pool = a + b
    share = shared.multivariate_hypergeometric(A + B, int(A.sum()), size=m, method="marginals")[:, at]
    return np.array([float((own.multivariate_hypergeometric(pool, int(k), method="marginals") * rank).sum()) for k in share])


def bootstrap_ci(rows: DataFrame, n_bootstrap: int = 500, seed: int = 0) -> DataFrame:
    """(marker, ci_low, ci_high): 2.5 and 97.5 percentiles of resampled deltas.

    Each replicate's draws are dealt to the ranges first, and each range draws its own share among its values.
    """
    ranges = _Ranges(rows)
    draws = ranges.draw(n_bootstrap, seed, _resampled).join(F.broadcast(ranges.sizes()), "marker").select("marker", _delta(F.col("u")).alias("delta"))
    q = F.percentile("delta", F.array(F.lit(0.025), F.lit(0.975)))  # over the replicates
    return draws.groupBy("marker").agg(q[0].alias("ci_low"), q[1].alias("ci_high"))


def permutation_p(rows: DataFrame, n_permutations: int = 999, seed: int = 0) -> DataFrame:
    """(marker, p): share of shuffled deltas at least as large, with the observed one counted.

    A shuffle leaves the ranks of the pooled values as they are, so a permutation only adds up the ranks that side a gets: how many
    of each range first, then of each value in it. A marker may have up to 10^9 rows, the bound of numpy's draws.
    """
    ranges = _Ranges(rows)
    if (most := max((int((a + b).sum()) for a, b in ranges.sums.values()), default=0)) >= MOST_POOLED:
        raise ConfigurationError(f"a marker has {most} rows; shuffles are drawn for fewer than {MOST_POOLED}")
    delta = lambda r: 2 * (r - F.col("n_a") * (F.col("n_a") + 1) / 2.0) / (F.col("n_a") * F.col("n_b")) - 1
    seen = ranges.rows.groupBy("marker").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * F.col("rank")).alias("r")).where("n_a > 0 and n_b > 0")
    draws = ranges.draw(n_permutations, seed, _shuffled).join(F.broadcast(seen.select("marker", "n_a", "n_b", delta(F.col("r")).alias("seen"))), "marker")
    return draws.groupBy("marker").agg(((F.count_if(F.abs(delta(F.col("u"))) >= F.abs("seen") - 1e-12) + 1) / (n_permutations + 1.0)).alias("p"))


def energy_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: energy distance of two samples (event_id, v): of all pairs, summed block by block. ``thin`` bounds the samples."""
    (n_a, width), (n_b, _) = _size(a), _size(b)
    measure = METRICS["euclidean"]

    def mean(x: DataFrame, y: DataFrame, n: int, m: int, within: bool) -> DataFrame:
        def total(own, rows, ids, matrix) -> pa.RecordBatch:
            step, s = max(1, NUMBERS // max(1, len(ids))), 0.0
            for at in range(0, len(own) if len(ids) else 0, step):
                d = _whole(measure, rows[at : at + step], matrix)
                s += float(d[own[at : at + step, None] < ids].sum() if within else d.sum())
            return pa.RecordBatch.from_arrays([pa.array([s])], names=["s"])

        pairs = n * (n - 1) / 2 if within else n * m
        return cells(x, y, n, m, width, total, "s double").agg((F.coalesce(F.sum("s"), F.lit(0.0)) / max(pairs, 1.0)).alias("d"))

    parts = mean(a, b, n_a, n_b, False).select(F.col("d").alias("ab"), F.lit(1).alias("one"))
    for x, n, name in ((a, n_a, "aa"), (b, n_b, "bb")):
        parts = parts.join(F.broadcast(mean(x, x, n, n, True).select(F.col("d").alias(name), F.lit(1).alias("one"))), "one")  # one row each
    return parts.select(F.greatest(F.lit(0.0), 2 * F.col("ab") - F.col("aa") - F.col("bb")).alias("energy"))


def thin(rows: DataFrame, most: int = 2000, seed: int = 0) -> DataFrame:
    """At most ``most`` rows, drawn without replacement by the md5 of seed and id."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("event_id").cast("string")))).limit(most)


def best_match(contingency: DataFrame, least: float = 0.0) -> DataFrame:
    """(ref, cand, jaccard) of (ref, cand, n): the best candidate of each; ties go to the smaller id."""
    a = contingency.groupBy("ref").agg(F.sum("n").alias("na"))
    b = contingency.groupBy("cand").agg(F.sum("n").alias("nb"))
    j = contingency.join(a, "ref").join(b, "cand").select("ref", "cand", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("jaccard"))
    best = j.withColumn("r", F.row_number().over(Window.partitionBy("ref").orderBy(F.desc("jaccard"), "cand")))
    return best.where((F.col("r") == 1) & (F.col("jaccard") >= least)).drop("r")


def vote(queries: DataFrame, base: DataFrame, labels: DataFrame, k: int, metric: str = "euclidean", p: float = 2.0) -> DataFrame:
    """(event_id, label): majority of the k nearest of ``base``; ties go to the smaller label."""
    near = nearest(queries, base, k, metric, p=p).join(labels.select(F.col("event_id").alias("j"), "label"), "j")
    votes = near.groupBy("i", "label").agg(F.count("*").alias("n"))
    best = votes.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("n"), "label")))
    return best.where("r = 1").select(F.col("i").alias("event_id"), "label")
