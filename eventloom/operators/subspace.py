"""Marker subspaces: resolution of names, transform, scaling and row subsets."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.errors import AmbiguousMarker, ConfigurationError, InsufficientData, UnknownMarker
from eventloom.operators.ranks import quantiles
from eventloom.plans.lineage import cut


def split_markers(text: str) -> list[str]:
    names = [p.strip() for p in text.split(",") if p.strip()]
    if not names:
        raise ConfigurationError("no markers given")
    return names


def resolve(wanted: str, channels: Sequence[tuple[str, str | None]]) -> str:
    """Channel name of a marker: by name, else by stain; case and outer white space don't count."""
    key = wanted.strip().casefold()
    for place in (0, 1):
        found = [c[0] for c in channels if c[place] and c[place].strip().casefold() == key]
        if len(found) > 1:
            raise AmbiguousMarker(f"{wanted!r} names {', '.join(found)}")
        if found:
            return found[0]
    raise UnknownMarker(f"no channel {wanted!r}; there are {', '.join(c[0] for c in channels)}")


def resolve_all(markers: Sequence[str], channels: Sequence[tuple[str, str | None]]) -> list[str]:
    if not markers:
        raise ConfigurationError("a subspace needs markers")
    names = [resolve(m, channels) for m in markers]
    if len(set(names)) < len(names):
        raise AmbiguousMarker(f"several of {list(markers)} name one channel")
    return names


def asinh(x: Column) -> Column:
    """Inverse hyperbolic sine without the built-in's loss of digits at negative and small values."""
    a = F.abs(x)
    return F.signum(x) * F.log1p(a + a * a / (1 + F.sqrt(a * a + 1)))


def select_subspace(events: DataFrame, names: Sequence[str], *, transform: str = "asinh", cofactor: float = 250.0, scaling: str = "zscore") -> DataFrame:
    """event_id and the markers ``m_0``... in the order of ``names``, transformed and scaled.

    The scales come from one aggregate over all rows, joined as one row; nothing is collected.
    """
    if transform not in ("asinh", "none") or scaling not in ("zscore", "robust", "none"):
        raise ConfigurationError(f"transform {transform!r}, scaling {scaling!r}")
    if not cofactor > 0:
        raise ConfigurationError("cofactor must be positive")
    cols = [F.col(f"`{n}`").cast("double") for n in names]
    if transform == "asinh":
        cols = [asinh(c / cofactor) for c in cols]
    rows = events.select("event_id", *(c.alias(f"m_{i}") for i, c in enumerate(cols)))
    if scaling == "none":
        return rows
    places = range(len(names))
    if scaling == "zscore":
        scale = rows.agg(*(x for i in places for x in (F.avg(f"m_{i}").alias(f"c_{i}"), F.stddev_pop(f"m_{i}").alias(f"s_{i}"))))
    else:
        long = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"m_{i}").alias("value")) for i in places])).alias("x")).select("x.i", "x.value")
        q = quantiles(long, ["i"], "value", [0.25, 0.5, 0.75])
        pick = lambda i, c: F.max(F.when(F.col("i") == i, c))
        scale = q.agg(*(x for i in places for x in (pick(i, F.col("q_1")).alias(f"c_{i}"), pick(i, (F.col("q_2") - F.col("q_0")) / 1.349).alias(f"s_{i}"))))
    scaled = (((F.col(f"m_{i}") - F.col(f"c_{i}")) / F.when(F.col(f"s_{i}") > 0, F.col(f"s_{i}")).otherwise(1.0)).alias(f"m_{i}") for i in places)
    return rows.crossJoin(F.broadcast(scale)).select("event_id", *scaled)  # the right side is one row


def require_events(events: DataFrame) -> None:
    if events.isEmpty():
        raise InsufficientData("no events")


def dense(rows: DataFrame) -> DataFrame:
    """``rows`` with event_id counted anew from 0 in its order: sorted ranges are counted, then numbered within themselves."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  
    ordered = cut(rows.repartitionByRange(n, "event_id").sortWithinPartitions("event_id").withColumn("__p", F.spark_partition_id()))
    counts = sorted((r["__p"], r["count"]) for r in ordered.groupBy("__p").count().collect())  # one row a partition
    first, total = {}, 0
    for p, n in counts:
        first[p] = total
        total += n
    names, at = ordered.columns, ordered.columns.index("event_id")

    def number(batches):
        given = None
        for b in batches:
            if not b.num_rows:
                continue
            if given is None:
                given = first[b.column(len(names) - 1)[0].as_py()]
            cols = list(b.columns)
            cols[at] = pa.array(range(given, given + b.num_rows), pa.int64())
            given += b.num_rows
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = ", ".join(f"`{n}` {'bigint' if n == 'event_id' else t}" for n, t in ordered.dtypes)
    return ordered.mapInArrow(number, schema).drop("__p")


def subset(space: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of a scaled subspace whose ids are in ``rows``; the scale stays as it was, ids are counted anew."""
    return dense(space.join(rows.select("event_id").distinct(), "event_id", "left_semi"))
