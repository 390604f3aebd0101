"""Command line: demo, info, communities, compare, stability, serve."""

from __future__ import annotations

import argparse
import json
import sys

from eventloom.errors import EventloomError
from eventloom.provenance import VERSION


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="eventloom", description=__doc__)
    p.add_argument("--version", action="version", version=f"%(prog)s {VERSION}")
    sub = p.add_subparsers(dest="command", required=True)
    demo = sub.add_parser("demo")
    demo.add_argument("path")
    demo.add_argument("--events", type=int, default=6000)
    demo.add_argument("--seed", type=int, default=20260817)
    info = sub.add_parser("info")
    info.add_argument("path")
    info.add_argument("--json", action="store_true")
    for name in ("communities", "compare", "stability"):
        s = sub.add_parser(name)
        s.add_argument("path")
        s.add_argument("--markers", default="CD3,CD4,CD8,CD19,CD56")
        for flag, kind, default in (("k", int, 30), ("resolution", float, 0.6), ("seed", int, 0), ("min-size", int, 10), ("cofactor", float, 250.0)):
            s.add_argument(f"--{flag}", type=kind, default=default)
        s.add_argument("--transform", choices=("asinh", "none"), default="asinh")
        s.add_argument("--json", action="store_true")
        if name == "communities":
            s.add_argument("--labels")
        if name == "compare":
            s.add_argument("--a", type=int, required=True)
            s.add_argument("--b", type=int, required=True)
            s.add_argument("--compare-markers")
            s.add_argument("--inference", choices=("descriptive", "split"), default="descriptive")
        if name == "stability":
            s.add_argument("--resamples", type=int, default=40)
            s.add_argument("--fraction", type=float, default=0.8)
            s.add_argument("--seeds", type=int, default=5)
    serve = sub.add_parser("serve")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8000)
    return p


def _run(o) -> None:
    from pyspark.sql import SparkSession

    from eventloom.operators.subspace import split_markers
    from eventloom.plans import pipeline, report
    from eventloom.sources import fcs, synth

    if o.command == "demo":
        for name, n in synth.write_demo_file(o.path, o.events, o.seed).sizes().items():
            print(f"{name}: {n}")
        return
    spark = SparkSession.builder.appName("eventloom").getOrCreate()
    if o.command == "serve":
        from eventloom.service import make_server

        make_server(spark, o.host, o.port).serve_forever()
        return
    if o.command == "info":
        file = fcs.read_fcs(spark, o.path)
        channels = [{"index": c.index, "name": c.name, "stain": c.stain, "bits": c.bits, "log": c.is_log, "range": c.range} for c in file.layout.channels]
        print(json.dumps({"n_events": file.layout.n_events, "channels": channels, "keywords": file.layout.keywords, "provenance": file.provenance.to_dict()}, indent=2) if o.json else file.summary())
        return
    result = pipeline.find_communities_in_file(spark, o.path, split_markers(o.markers), k=o.k, resolution=o.resolution, seed=o.seed, min_size=o.min_size, transform=o.transform, cofactor=o.cofactor)
    if o.command == "compare":
        found = pipeline.compare_communities(result, o.a, o.b, markers=split_markers(o.compare_markers) if o.compare_markers else None, inference=o.inference)
    elif o.command == "stability":
        found = pipeline.assess_stability(result, n_resamples=o.resamples, subsample_fraction=o.fraction, n_seeds=o.seeds, seed=o.seed)
    else:
        found = result.to_dict()
        if o.labels:
            import numpy as np

            np.save(o.labels, result.labels.orderBy("event_id").toPandas()["community"].to_numpy())
    if o.json:
        print(json.dumps(found, indent=2))
        return
    if o.command != "communities":
        print(report.comparison(found) if o.command == "compare" else report.stability(found))
        return
    print(f"{found['n_communities']} communities over {found['n_events']} events ({found['graph']['n_edges']} edges, quality {found['quality']:.1f})")
    for c, n in found["sizes"].items():
        print(f"  {'unassigned' if c == '-1' else c}: {n} ({n / found['n_events']:.1%})")


def main(args: list[str] | None = None) -> int:
    o = parser().parse_args(args)
    try:
        _run(o)
    except BrokenPipeError:
        return 0
    except (EventloomError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
