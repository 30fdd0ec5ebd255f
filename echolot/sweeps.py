"""Sweeps over a labelled source tree, and their reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import profiles
from .analyzer import JACCARD_THRESHOLD, Analyzer, AnalyzerConfig
from .embedding import Embedder
from .operators import hybrid, tuning
from .sources import code

COLLECT = tuning.THRESHOLDS[0] / 100


def _rows(swept: DataFrame) -> list[dict]:
    return [r.asDict() for r in swept.collect()]


def threshold_report(spark: SparkSession, corpus: str | Path, labels: str | Path, models: dict[str, Embedder | None], min_lines: int = 0, batch_size: int = 4) -> dict:
    """For each model the metrics at each threshold, best first, and the threshold chosen; a model with no embedder is loaded by name."""
    groups, found = code.label_groups(labels), []
    for model, embedder in models.items():
        config = AnalyzerConfig(run_traditional=False, run_unused=False, model_name=model, semantic_threshold=COLLECT, min_semantic_lines=min_lines, batch_size=batch_size)
        result = Analyzer(spark, config, embedder).analyze(corpus)
        rows = _rows(tuning.threshold_sweep(spark, result.semantic_duplicates, code.positive_pairs(spark, groups, result.units)))
        found.append({"model_key": model, "canonical_name": profiles.profile(model).canonical_name, "selected_threshold": rows[0]["threshold"], "rows": rows})
    return {"corpus_path": str(corpus), "labels_path": str(labels), "grid": [h / 100 for h in tuning.THRESHOLDS], "models": found}


def gate_report(spark: SparkSession, corpus: str | Path, labels: str | Path, embedder: Embedder | None = None, model: str = profiles.DEFAULT_MODEL, semantic_threshold: float = 0.82, jaccard_threshold: float = JACCARD_THRESHOLD, min_lines: int = 0, **grids) -> dict:
    """Metrics of the hybrid pairs at each combination of gates, best first; the evidence is gathered and merged once."""
    config = AnalyzerConfig(run_unused=False, model_name=model, semantic_threshold=COLLECT, jaccard_threshold=jaccard_threshold, min_semantic_lines=min_lines)
    result = Analyzer(spark, config, embedder).analyze(corpus)
    merged = hybrid.evidence(result.traditional_duplicates, result.semantic_duplicates, result.units.select("unit_id", "uid"))
    merged = hybrid.weak_evidence(merged, result.units, jaccard_threshold)
    positive = code.positive_pairs(spark, code.label_groups(labels), result.units)
    rows = _rows(tuning.gate_sweep(spark, merged, positive, semantic_threshold, jaccard_threshold, **grids))
    return {"corpus_path": str(corpus), "labels_path": str(labels), "model": model, "semantic_threshold": semantic_threshold, "traditional_threshold": jaccard_threshold, "best": rows[0] if rows else None, "rows": rows}


def write_report(report: dict, path: str | Path) -> None:
    """The report as JSON, in folders that are made as needed."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(report, indent=2), encoding="utf-8")
