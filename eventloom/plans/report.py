"""Markdown of comparisons and stability evidence, from their JSON-ready results."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


def _table(head: Sequence[str], rows: Iterable[Sequence[str]]) -> list[str]:
    return [f"| {' | '.join(cells)} |" for cells in (head, ["---"] * len(head), *rows)]


def comparison(found: dict) -> str:
    """Markers by size of effect; * marks those that were clustered on."""
    title = f"Community {found['community_a']} (n={found['n_a']}) against community {found['community_b']} (n={found['n_b']}), energy distance {found['energy_distance']:.3f}"
    rows = []
    for m in found["markers"]:
        name = m["marker"] + "*" * m["used_for_clustering"]
        q = "n/a" if m["q_value"] is None else f"{m['q_value']:.3g}"
        rows.append((name, f"{m['median_a']:.2f}", f"{m['median_b']:.2f}", f"{m['cliffs_delta']:+.3f}", f"[{m['ci_low']:+.2f}, {m['ci_high']:+.2f}]", m["magnitude"], q))
    lines = [title, "", *_table(("marker", "median A", "median B", "Cliff's delta", "95% CI", "magnitude", "q"), rows)]
    return "\n".join([*lines, *([""] if found["notes"] else []), *(f"- {n}" for n in found["notes"])])


def stability(found: dict) -> str:
    """Evidence by community, agreement between runs, and the parameter sweep."""
    communities = sum(int(c) >= 0 for c in found["reference_sizes"])
    per = [(str(c["community"]), str(c["size"]), f"{c['mean_jaccard']:.2f}", f"{c['p05_jaccard']:.2f}", f"{c['recovery_rate']:.0%}", f"{c['core_fraction']:.0%}", c["verdict"]) for c in found["per_community"]]
    sweep = [(str(s["k"]), f"{s['resolution']:g}", str(s["n_communities"]), f"{s['ari_vs_reference']:.3f}") for s in found["sweep"]]
    lines = [f"Stability of {communities} communities over {found['n_resamples']} resamples at {found['subsample_fraction']:.0%}", ""]
    lines += _table(("community", "size", "mean J", "5th pct J", "recovery", "core", "verdict"), per)
    lines += ["", f"Resamples: ARI mean {found['resample_ari']['mean']:.3f}, least {found['resample_ari']['min']:.3f}."]
    if found["seed_ari"]["values"]:
        lines.append(f"Seeds alone: least ARI {found['seed_ari']['min']:.3f} of {len(found['seed_ari']['values'])}.")
    lines += [f"Boundary events: {found['boundary_fraction']:.1%} of those assigned.", ""]
    return "\n".join(lines + _table(("k", "resolution", "communities", "ARI to the reference"), sweep))
