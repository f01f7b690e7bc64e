"""The whole analysis of a corpus: occurrences once, and from them flags, reverse flags, filters and the summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.operators import consistency as C
from termweave.operators import report
from termweave.operators import review as R
from termweave.operators.aligners import Aligner
from termweave.staging import staged


@dataclass(frozen=True)
class Analysis:
    occurrences: DataFrame
    flags: DataFrame
    reverse: DataFrame
    placeholders: DataFrame
    summary: DataFrame


def analyze_all(
    segments: DataFrame, cfg: C.Config = C.Config(), aligner: Aligner | None = None, vault: DataFrame | None = None, vectors: DataFrame | None = None, decisions: DataFrame | None = None, faithful: float | None = None, identical: float | None = None
) -> Analysis:
    """vectors (text, vec) are used where a threshold is given: faithful drops spans far from their n-gram, identical
    clears flags whose spans are alike; the flags are then in the order of significance, else in reading order.
    summary: segments, files, inconsistent (active) flags, flags, reverse_flags, placeholder_issues, violations."""
    occ = staged(C.occurrences(segments, cfg, aligner if aligner is not None else "heuristic"))
    found = C.flags(occ, cfg, vault)
    if faithful is not None and vectors is not None:
        found = R.faithfulness(found, vectors, faithful, cfg.include_consistent)
    if identical is not None and vectors is not None:
        found = R.clear_duplicates(found, report.verify_all(R.payload(found), "vectors", vectors, identical), cfg.include_consistent)
    if decisions is not None:
        found = R.suppress(found, decisions, cfg.include_consistent)
    for name in ("cleared", "decided"):
        if name not in found.columns:
            found = found.withColumn(name, F.lit(False))
    found = staged(C.active(found))
    reverse, issues = staged(C.reverse_flags(occ, cfg.min_occurrences)), R.placeholder_issues(segments)
    by_flag = found.agg(F.count(F.when(F.col("active"), 1)).alias("inconsistent"), F.count("*").alias("flags"), F.count(F.when(F.col("violation"), 1)).alias("violations"))
    summary = segments.agg(F.count("*").alias("segments"), F.count_distinct("file").alias("files"))
    for one in (by_flag, reverse.agg(F.count("*").alias("reverse_flags")), issues.agg(F.count("*").alias("placeholder_issues"))):
        summary = summary.join(one)  # one row each
    filtered = vectors is not None and (faithful is not None or identical is not None)
    names = ("segments", "files", "inconsistent", "flags", "reverse_flags", "placeholder_issues", "violations")
    return Analysis(occ, report.significance(found) if filtered else C.ranked(found), reverse, issues, summary.select(*names))
