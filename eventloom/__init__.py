"""Event-matrix analytics on Spark. Names are loaded when first used: a task imports only the modules that it needs."""

from importlib import import_module

__version__ = "0.1.0"

_HOMES = {
    "CommunityConfig": "plans.pipeline",
    "CommunityResult": "plans.pipeline",
    "EventloomError": "errors",
    "FCSFile": "sources.fcs",
    "Partition": "plans.pipeline",
    "assess_stability": "plans.pipeline",
    "build_graph": "operators.graph",
    "compare_communities": "plans.pipeline",
    "detect_communities": "plans.pipeline",
    "find_communities": "plans.pipeline",
    "find_communities_in_file": "plans.pipeline",
    "build_subspace": "plans.pipeline",
    "make_dataset": "sources.synth",
    "make_events": "sources.synth",
    "read_fcs": "sources.fcs",
    "read_fcs_bytes": "sources.fcs",
    "select_subspace": "operators.subspace",
    "write_demo_file": "sources.synth",
    "write_fcs": "sources.fcs",
}
__all__ = ["__version__", *_HOMES]


def __getattr__(name: str):
    if name not in _HOMES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_HOMES[name]}"), name)
