import duckdb
import numpy as np
import pytest

from eventloom import errors as err
from eventloom.operators import communities
from eventloom.operators.agreement import k_grid
from eventloom.operators.subspace import resolve, split_markers
from eventloom.plans import catalogue
from eventloom.provenance import config_hash
from eventloom.sources import fcs, synth

SF = "/root/testdata/sf0.001"


def _good(**more):
    return fcs.build_fcs_bytes(np.arange(24.0).reshape(8, 3), ["A", "B", "C"], **more)


@pytest.mark.parametrize("kind", "FDI")
def test_roundtrip(spark, kind):
    got = fcs.read_fcs_bytes(spark, _good(datatype=kind, extra_keywords={"$CYT": "a/b/c"}))
    assert got.layout.keyword("$cyt") == "a/b/c"
    assert (got.to_pandas().to_numpy() == np.arange(24.0).reshape(8, 3)).all()


def test_damage(spark):
    raw = _good()
    for bad, error in ((b"FCS2.0" + raw[6:], err.UnsupportedFCSVersion), (b"", err.MalformedHeader), (raw[:50], err.MalformedHeader), (raw[:10] + b"    abcd" + raw[18:], err.MalformedHeader), (raw[:-4], err.TruncatedData)):
        with pytest.raises(error):
            fcs.read_fcs_bytes(spark, bad)
    nan = np.arange(24.0).reshape(8, 3)
    nan[2, 1] = np.nan
    with pytest.raises(err.InconsistentMetadata, match="NaN"):
        fcs.read_fcs_bytes(spark, fcs.build_fcs_bytes(nan, ["A", "B", "C"], ranges=[1, 1, 1]))


def test_scan_in_ranges(spark, tmp_path):
    path = fcs.write_fcs(str(tmp_path / "x.fcs"), np.arange(24.0).reshape(8, 3), ["A", "B", "C"])
    assert fcs.read_fcs(spark, path).events.count() == 8
    rows = spark.read.format("fcs").option("events_per_task", "3").load(path)
    assert rows.rdd.getNumPartitions() == 3 and [r.B for r in rows.orderBy("event_id").collect()] == [1.0 + 3 * i for i in range(8)]
    with pytest.raises(FileNotFoundError):
        fcs.read_fcs(spark, str(tmp_path / "none.fcs"))


def test_names_and_hash():
    channels = [("FL1-A", "CD3"), ("FL2-A", "CD4"), ("FL3-A", None)]
    assert resolve(" cd4 ", channels) == "FL2-A" and split_markers("a, ,b") == ["a", "b"]
    with pytest.raises(err.UnknownMarker, match="FL1-A"):
        resolve("CD9", channels)
    assert config_hash({"a": 1, "b": 2}) == config_hash({"b": 2, "a": 1}) != config_hash({"a": 2})
    assert synth.apportion([p[1] for p in synth.POPULATIONS], 6000) == [1800, 1320, 1200, 780, 810, 90] and k_grid(30) == [15, 22, 30, 45, 60]


def test_leiden_finds_cliques():
    edges = [(a + 10 * g, b + 10 * g, 1.0) for g in range(3) for a in range(10) for b in range(a + 1, 10)] + [(9, 10, 0.1), (19, 20, 0.1)]
    got = communities.leiden(list(range(31)), edges)
    assert len({got[i] for i in range(30)}) == 3 and all(len({got[10 * g + i] for i in range(10)}) == 1 for g in range(3))
    assert got == communities.leiden(list(range(30, -1, -1)), edges[::-1])


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("embeddings", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = c.sql(catalogue.ORACLES[name]).df(), catalogue.QUERIES[name](spark, SF).toPandas()
    form = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).values.tolist()))
    assert form(got) == form(want)


def test_long_rings_stay_whole(spark, tmp_path):
    """The SQL's communities are found however many events a label has, and no cut of theirs is better."""
    spark.range(10_000).selectExpr("id AS vec_id", "CAST(id % 10 AS INT) AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = catalogue.QUERIES["leiden_rings"](spark, str(tmp_path)).collect()
    assert len(found) == 10_000 and {(r.event_id % 10, r.community) for r in found} == {(i, i) for i in range(10)}
