"""Results as JSON and as plain tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .analyzer import AnalysisResult
from .functions import measures

ROWS = 20


def unit_struct(prefix: str = ""):
    """The public fields of a unit."""
    names = {"name": "name", "qualified_name": "qualified_name", "type": "kind", "file": "file_path", "line": "lineno", "end_line": "end_lineno", "is_public": "is_public", "is_exported": "is_exported"}
    return F.struct(*(F.col(f"{prefix}{source}").alias(name) for name, source in names.items()))


def with_units(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """Pairs with structs unit_a and unit_b in place of ids."""
    a, b = (units.select(F.col("unit_id").alias(u), unit_struct().alias(n)) for u, n in (("ua", "unit_a"), ("ub", "unit_b")))
    rest = [c for c in pairs.columns if c not in ("ua", "ub")]
    return pairs.join(a, "ua").join(b, "ub").select("unit_a", "unit_b", *rest, "ua", "ub")


def _pairs(pairs: DataFrame, units: DataFrame, hybrid: bool = False) -> list[dict]:
    order = [F.desc("confidence"), F.desc_nulls_last("semantic_similarity"), F.desc_nulls_last("jaccard_similarity")] if hybrid else [F.desc("similarity")]
    rows = with_units(pairs, units).orderBy(*order, "ua", "ub").drop("ua", "ub").collect()
    return [r.asDict(recursive=True) for r in rows]


def _units(units: DataFrame) -> list[dict]:
    return [r.u.asDict() for r in units.orderBy("unit_id").select(unit_struct().alias("u")).collect()]


def check_dict(result: AnalysisResult, show_all: bool = False) -> dict:
    """The report of an analysis; raw pairs are in it where one method ran, or with ``show_all``."""
    hybrid = _pairs(result.hybrid_duplicates, result.units, True)
    unused = _units(result.potentially_unused)
    fallback = {"semantic_fallback": result.semantic_fallback, "semantic_fallback_reason": result.semantic_fallback_reason}
    raw = {k: _pairs(getattr(result, k), result.units) for k in ("traditional_duplicates", "semantic_duplicates")} if show_all or result.analysis_mode != "combined" else {}
    if result.analysis_mode == "combined":
        count = lambda k: len(raw[k]) if raw else getattr(result, k).count()
        summary = {"hybrid_duplicates": len(hybrid), "raw_traditional_duplicates": count("traditional_duplicates"), "raw_semantic_duplicates": count("semantic_duplicates"), "filtered_raw_duplicates": result.filtered_raw_duplicates}
        own = {"hybrid_duplicates": hybrid}
    else:
        summary, own = {k: len(v) for k, v in raw.items()}, {}
    return {"analysis_mode": result.analysis_mode, "summary": {"total_units": result.units.count(), "potentially_unused": len(unused), **summary, **fallback}, **own, **raw, "potentially_unused": unused}


def search_dict(query: str, hits: DataFrame) -> dict:
    rows = hits.orderBy(F.desc("score"), "unit_id").select("score", unit_struct().alias("u")).collect()
    return {"query": query, "results": [{"score": r.score, **r.u.asDict()} for r in rows]}


def as_json(payload: dict) -> str:
    return json.dumps(payload, indent=2, sort_keys=True)


def count_by_kind(units: DataFrame) -> DataFrame:
    return units.groupBy("kind").count()


def kind_counts(units: DataFrame) -> dict[str, int]:
    return {r.kind: r["count"] for r in count_by_kind(units).collect()}


def table(title: str, header: list[str], rows: list[tuple], width: int, total: int | None = None) -> str:
    """Lines of at most ``width`` characters; of more rows than are given, how many there are."""
    if not rows:
        return ""
    sizes = [max(len(str(x)) for x in column) for column in zip(header, *rows)]
    line = lambda r: "  ".join(str(x).ljust(n) for x, n in zip(r, sizes)).rstrip()[:width]
    out = [title, line(header), line(["-" * n for n in sizes]), *map(line, rows)]
    if total is not None and total > len(rows):
        out.append(f"... and {total - len(rows)} more")
    return "\n".join(out) + "\n"


def pair_table(title: str, pairs: DataFrame, units: DataFrame, width: int, full: bool, show_source: bool) -> str:
    """Pairs, best first; 20 of them unless ``full``."""
    score, label = ("confidence", "tier") if "tier" in pairs.columns else ("similarity", "method")
    own = units.select("unit_id", "name", measures.location(F.col("file_path"), F.col("lineno")).alias("at"), *([measures.snippet(F.col("source")).alias("text")] if show_source else []))
    a, b = (own.select(*(F.col(c).alias(f"{c}_{x}") for c in own.columns)) for x in "ab")
    joined = pairs.join(a, F.col("ua") == F.col("unit_id_a")).join(b, F.col("ub") == F.col("unit_id_b")).orderBy(F.desc(score), "ua", "ub")
    rows = (joined if full else joined.limit(ROWS)).collect()
    out = table(title, ["score", label, "unit a", "at", "unit b", "at"], [(f"{r[score]:.3f}", r[label], r.name_a, r.at_a, r.name_b, r.at_b) for r in rows], width, pairs.count())
    if show_source:
        out += "".join(f"\n{r.name_a} {r.at_a}\n{r.text_a}\n--\n{r.name_b} {r.at_b}\n{r.text_b}\n" for r in rows)
    return out


def check_text(result: AnalysisResult, width: int = 160, show_all: bool = False, show_source: bool = False, full: bool = False) -> str:
    kinds, mode = kind_counts(result.units), result.analysis_mode
    lines = [f"Total code units            {sum(kinds.values())}", *(f"  {k + ('es' if k == 'class' else 's'):<26}{kinds.get(k, 0)}" for k in ("function", "method", "class"))]
    if mode == "combined":
        lines.append(f"Filtered raw duplicates     {result.filtered_raw_duplicates}")
    parts = ["\n".join(lines) + "\n"]
    show = lambda title, pairs: parts.append(pair_table(title, pairs, result.units, width, full, show_source))
    if mode == "combined":
        show("Hybrid duplicates", result.hybrid_duplicates)
    if mode != "combined" or show_all:
        show("Traditional duplicates", result.traditional_duplicates)
        show("Semantic duplicates", result.semantic_duplicates)
    dead = result.potentially_unused.orderBy("unit_id").select("name", "kind", measures.location(F.col("file_path"), F.col("lineno")).alias("at"))
    parts.append(table("Potentially unused", ["name", "type", "at"], [tuple(r) for r in (dead if full else dead.limit(ROWS)).collect()], width, dead.count()))
    if result.semantic_fallback:
        parts.append(f"{result.semantic_fallback_reason}\n")
    return "\n".join(filter(None, parts))
