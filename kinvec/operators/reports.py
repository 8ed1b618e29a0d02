"""Reports as text (S24, P2, P6, V30): lines of figures from one-row tables and dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import metrics, scoring


def _lines(title: str, rows: list[tuple[str, str]]) -> str:
    width = max(len(k) for k, _ in rows)
    return "\n".join([title, *(f"  {k:<{width}} : {v}" for k, v in rows)]) + "\n"


def verification_text(scored: DataFrame, rates: tuple[float, ...] = (1e-3, 1e-4)) -> str:
    """The verification report; says so where there is nothing to measure, or a rate is finer than the impostors can tell."""
    r = metrics.verification(scored, rates)
    rows = [("genuine pairs", str(r["genuine"])), ("impostor pairs", str(r["impostors"])), ("skipped", str(r["skipped"]))]
    if "auc" not in r:
        return _lines("Verification", [*rows, ("warning", "no metrics without genuine and impostor pairs")])
    rows += [("AUC", f"{r['auc']:.4f}"), ("EER", f"{r['eer']:.4f} at {r['eer_threshold']:.4f}")]
    for rate in rates:
        best = r[f"tar_at_{rate:g}"]
        rows.append((f"TAR at FAR {rate:g}", "N/A: too few impostors" if best is None else f"{best[0]:.4f} at {best[1]:.4f}"))
    return _lines("Verification", rows)


def identification_text(results: DataFrame) -> str:
    """The ranking report of results with a target: rates, cumulative match, errors and leakage."""
    if not results.limit(1).count():
        raise ValueError("there are no results to report on")
    total, cmc = scoring.report_total(results).first(), scoring.cumulative_match(results).orderBy("k").collect()
    more, err, leak = scoring.cumulative_summary(results).first(), scoring.diagnostics(results).first(), scoring.leakage(results).first()
    show = lambda x: "N/A" if x is None else f"{x:.4f}"
    out = _lines("Identification", [("probes", str(total["n"])), ("match rate", show(total["match_rate"])), ("rank-1 rate", show(total["rank1_rate"])), ("mean own", show(total["mean_own"])), ("mean best other", show(total["mean_other"]))])
    out += _lines("Cumulative match", [("candidates", str(more["candidates"])), *[(f"top {r['k']}", f"{show(r['rate'])} ({r['hits']} of {r['n']})") for r in cmc], ("median rank", str(more["median_rank"])), ("mean rank", f"{more['mean_rank']:.2f}"), ("misses at rank 2", show(more["second"]))])
    out += _lines("Errors", [("misranked", str(err["misranked"])), ("won by the target", f"{err['won_by_target']} ({show(err['share'])})"), ("chance", show(err["chance"])), ("near misses", str(err["near_misses"])), ("median deficit", show(err["median_deficit"])), ("median margin", show(err["median_margin"]))])
    if not leak["known"]:
        return out + "Leakage\n  no probes with a known target\n"
    return out + _lines("Leakage", [("known targets", str(leak["known"])), ("target above donor", f"{leak['outranks']} ({show(leak['outrank_share'])})"), ("share of errors", f"{show(leak['error_share'])} (chance {show(leak['chance'])})"), ("median gap", show(leak["median_gap"])), ("within 0.05 of two", str(leak["tight"]))])
