"""Analysis of a source tree: what to run, and the frames that come of it."""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import profiles, schema
from .embedding import Embedder, SentenceModel, embedded
from .functions import measures
from .operators import exact, graph, hybrid, near, semantic
from .plans.durable import durable
from .sources import code

log = logging.getLogger(__name__)

JACCARD_THRESHOLD, BATCH_SIZE, MIN_STATEMENTS, TINY_CUTOFF, TINY_NEAR_MIN, TOP_K = 0.85, 8, 3, 3, 0.93, 10


@dataclass
class AnalyzerConfig:
    """What to look at and what to run; ValueError where that doesn't fit together."""

    exclude_patterns: list[str] | None = None
    include_private: bool = True
    jaccard_threshold: float = JACCARD_THRESHOLD
    semantic_threshold: float | None = None
    model_name: str = profiles.DEFAULT_MODEL
    semantic_task: str | None = None
    instruction_prefix: str | None = None
    model_revision: str | None = None
    trust_remote_code: bool | None = None
    batch_size: int = BATCH_SIZE
    min_semantic_lines: int = MIN_STATEMENTS
    semantic_unit_types: tuple[str, ...] = ("function", "method")
    include_stubs: bool = False
    allow_semantic_fallback: bool = False
    filter_tiny_traditional: bool = True
    tiny_unit_statement_cutoff: int = TINY_CUTOFF
    tiny_near_jaccard_min: float = TINY_NEAR_MIN
    run_traditional: bool = True
    run_semantic: bool = True
    run_unused: bool = True
    strict_unused: bool = False
    suppress_test_semantic_matches: bool = False
    #: Strips margins before identifiers are read, so that methods have some.
    dedent_identifiers: bool = False
    unused_markers: tuple[str, ...] = graph.MARKERS
    gates: hybrid.Gates = field(default_factory=hybrid.Gates)

    def __post_init__(self) -> None:
        def between(name: str) -> None:
            value = getattr(self, name)
            if value is not None and not 0 <= value <= 1:
                raise ValueError(f"{name} must be in [0.0, 1.0]")

        def least(name: str, low: int, said: str) -> None:
            if getattr(self, name) < low:
                raise ValueError(f"{name} must be {said}")

        between("jaccard_threshold")
        between("semantic_threshold")
        least("batch_size", 1, "> 0")
        least("min_semantic_lines", 0, ">= 0")
        if not self.semantic_unit_types:
            raise ValueError("semantic_unit_types must contain at least one unit type")
        kinds = tuple(dict.fromkeys(k.strip().lower() for k in self.semantic_unit_types))
        if bad := sorted(set(kinds) - set(schema.KINDS)):
            raise ValueError(f"Invalid semantic_unit_types: {', '.join(bad)}. Allowed values: {', '.join(sorted(schema.KINDS))}")
        self.semantic_unit_types = kinds
        least("tiny_unit_statement_cutoff", 0, ">= 0")
        between("tiny_near_jaccard_min")
        if self.semantic_task is not None:
            own = self.semantic_task.strip().lower()
            if own not in profiles.TASKS:
                raise ValueError(f"Invalid semantic_task: {self.semantic_task}. Allowed values: {', '.join(profiles.TASKS)}")
            self.semantic_task = own
        if self.strict_unused and not self.run_unused:
            raise ValueError("strict_unused requires run_unused=True")
        defaults = {f: d.default for f, d in self.__dataclass_fields__.items()}
        for running, names in {
            "run_semantic": ("semantic_threshold", "semantic_task", "instruction_prefix", "model_revision", "trust_remote_code", "batch_size", "suppress_test_semantic_matches"),
            "run_traditional": ("jaccard_threshold", "filter_tiny_traditional", "tiny_unit_statement_cutoff", "tiny_near_jaccard_min"),
        }.items():
            changed = sorted(n for n in names if getattr(self, n) != defaults[n])
            if changed and not getattr(self, running):
                raise ValueError(f"{', '.join(changed)} require {running}=True")
        if self.allow_semantic_fallback and not (self.run_semantic and self.run_traditional):
            raise ValueError("allow_semantic_fallback requires run_semantic=True and run_traditional=True")

    @property
    def mode(self) -> str:
        return {(True, True): "combined", (True, False): "traditional", (False, True): "semantic", (False, False): "none"}[self.run_traditional, self.run_semantic]

    @property
    def threshold(self) -> float:
        """The semantic threshold: as given, else the model's."""
        return profiles.profile(self.model_name).threshold if self.semantic_threshold is None else self.semantic_threshold


@dataclass(frozen=True)
class AnalysisResult:
    """Frames of units, PAIRS and HYBRID; they are evaluated when asked for."""

    units: DataFrame
    traditional_duplicates: DataFrame
    semantic_duplicates: DataFrame
    hybrid_duplicates: DataFrame
    potentially_unused: DataFrame
    analysis_mode: str
    evidence_pairs: DataFrame | None = None
    semantic_fallback: bool = False
    semantic_fallback_reason: str | None = None

    @property
    def exact_duplicates(self) -> DataFrame:
        return self.traditional_duplicates.where(F.col("method").isin(*schema.EXACT_METHODS))

    @property
    def all_duplicates(self) -> DataFrame:
        """The hybrid pairs in combined mode, else the raw ones."""
        return self.hybrid_duplicates if self.analysis_mode == "combined" else self.traditional_duplicates.unionByName(self.semantic_duplicates)

    @cached_property
    def filtered_raw_duplicates(self) -> int:
        """Pairs with evidence that no tier takes."""
        return 0 if self.evidence_pairs is None else max(0, self.evidence_pairs.count() - self.hybrid_duplicates.count())


def remote(path: str | Path) -> bool:
    return re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://", str(path)) is not None


def backend_failed(e: Exception) -> bool:
    """Whether a model or its packages failed, here or in a worker: Spark puts a worker's error in words of its own error."""
    kinds = ("ModuleNotFoundError", "ImportError", "RuntimeError", "SemanticBackendError")
    return isinstance(e, (ImportError, RuntimeError)) or any(re.match(rf"\s*(?:[\w.]+: )*(?:\w+\.)*(?:{'|'.join(kinds)})\b", line) for line in str(e).splitlines())


class Analyzer:
    """``embedder`` gives vectors; by default the model that the config names, if its packages are there."""

    def __init__(self, spark: SparkSession, config: AnalyzerConfig | None = None, embedder: Embedder | None = None) -> None:
        self.spark = spark
        self.config = config or AnalyzerConfig()
        self.embedder = embedder or SentenceModel(self.config.model_name, self.config.model_revision, self.config.trust_remote_code)
        self._units: DataFrame | None = None
        self._vectors: DataFrame | None = None

    def _empty(self, columns: str) -> DataFrame:
        return self.spark.createDataFrame([], columns)

    def extract(self, path: str | Path) -> DataFrame:
        """FACTS of a file, or of all files of a tree that aren't excluded; an address such as s3a://... is listed and read by executors."""
        c = self.config
        if remote(path):
            return durable(code.facts(code.read_remote(self.spark, str(path), c.exclude_patterns, c.include_stubs), c.include_private, c.dedent_identifiers))
        path = Path(path).resolve()
        if not path.exists():
            raise FileNotFoundError(f"Path does not exist: {path}")
        if path.is_file():
            root, paths = path.parent, [] if code.excluded(path.name, c.exclude_patterns) else [str(path)]
        else:
            root, paths = path, code.list_files(path, c.exclude_patterns, c.include_stubs)
        return durable(code.facts(code.read_files(self.spark, paths, str(root)), c.include_private, c.dedent_identifiers))

    def analyze(self, path: str | Path) -> AnalysisResult:
        if remote(path):
            return self.analyze_facts(self.extract(path), path=path)
        path = Path(path).resolve()
        return self.analyze_facts(self.extract(path), code.entry_points(path if path.is_dir() else path.parent), path)

    def analyze_facts(self, facts: DataFrame, entry_points: list[str] = (), path: str | Path = "PATH") -> AnalysisResult:
        c = self.config
        units = self._units = code.units(facts)
        self._vectors = None
        pairs, none = self._empty(schema.PAIRS), self._empty("ua long, ub long, tier string, confidence double, has_exact boolean, jaccard_similarity double, semantic_similarity double, weak_identifier_jaccard double, statement_count_ratio double")
        if units.isEmpty():
            return AnalysisResult(units, pairs, pairs, none, units, "none")
        candidates = units
        if c.run_semantic:
            candidates = units.where(F.col("kind").isin(*c.semantic_unit_types) & (F.col("stmt_count") >= c.min_semantic_lines))
        unused = units.limit(0)
        if c.run_unused:
            unused = durable(graph.unused(units, graph.references(units, facts, list(entry_points)), c.strict_unused, c.unused_markers))
        traditional = durable(self.traditional(candidates)) if c.run_traditional else pairs
        found, reason = pairs, None
        if c.run_semantic:
            excluded = None
            if c.run_traditional:
                strong = traditional.where(F.col("method").isin(*schema.EXACT_METHODS)).select("ua", "ub")
                excluded = strong.unionByName(exact.both_hash_pairs(candidates)).distinct()
            try:
                found = self.semantic(candidates, excluded)
            except Exception as e:
                if not c.run_traditional or not backend_failed(e):
                    raise
                if not c.allow_semantic_fallback:
                    raise RuntimeError("Semantic analysis failed in combined mode; --allow-semantic-fallback keeps the traditional results of its scope, and --traditional-only runs without it.") from e
                self._vectors = None
                said = next((line for line in reversed(str(e).strip().splitlines()) if line.strip()), type(e).__name__)
                reason = f"Semantic analysis unavailable ({said.strip()}). Going on with non-semantic results of the same scope. model={c.model_name} revision={c.model_revision} trust_remote_code={c.trust_remote_code}. Retry with `echolot check {path} --traditional-only`."
                log.warning("%s", reason)
            if c.suppress_test_semantic_matches:
                found = hybrid.suppress(found, units.where(measures.is_test(F.col("kind"), F.col("name"))), both=False)
            if c.run_unused:
                found = hybrid.suppress(found, unused, both=True)
        merged, result = None, none
        if c.mode == "combined":
            merged = durable(hybrid.evidence(traditional, found, units.select("unit_id", "uid")))
            result = hybrid.ranked(hybrid.hybrid_pairs(hybrid.weak_evidence(merged, units, c.jaccard_threshold), c.threshold, c.jaccard_threshold, c.gates))
        return AnalysisResult(units, traditional, found, result, unused, c.mode, merged, reason is not None, reason)

    def traditional(self, candidates: DataFrame) -> DataFrame:
        """Exact, then near pairs that aren't exact; pairs of tiny units are dropped as configured."""
        c, same = self.config, exact.exact_pairs(candidates)
        # Of units of one uid, such as a property and its setter, the identifiers of the last count for all.
        last = hybrid.last_of_uid(candidates, ["identifiers"]).withColumnRenamed("identifiers", "tokens")
        sets = candidates.select("unit_id", "uid", "file_path", "lineno", "end_lineno").join(last, "uid")
        alike = near.without(near.jaccard_pairs(sets, c.jaccard_threshold, same_place=True), same)
        alike = exact.first_wins(alike, candidates.select("unit_id", "uid"), {"jaccard": 0})
        if c.filter_tiny_traditional:
            same = near.without_tiny(same, candidates, c.tiny_unit_statement_cutoff)
            alike = near.without_tiny(alike, candidates, c.tiny_unit_statement_cutoff, c.tiny_near_jaccard_min)
        return same.unionByName(alike)

    def semantic(self, candidates: DataFrame, excluded: DataFrame | None) -> DataFrame:
        """Pairs by cosine, without the excluded ones, best first; computed at once, so that failures show here."""
        c = self.config
        if candidates.isEmpty():
            return self._empty(schema.PAIRS)
        own = profiles.task(c.semantic_task, profiles.CHECK_TASK)
        prefix = profiles.instruction(c.model_name, False, own, c.instruction_prefix)
        if check := getattr(self.embedder, "check", None):
            check()
        self._vectors = durable(embedded(candidates, self.embedder, prefix, c.batch_size, ("unit_id", "kind", "file_path", "lineno", "end_lineno")))
        found = semantic.cosine_pairs(self._vectors, c.threshold)
        if excluded is not None:
            found = near.without(found, excluded)
        return durable(found.select("ua", "ub", "similarity", "method").orderBy(F.desc("similarity"), "ua", "ub"))

    def search(self, query: str, top_k: int = TOP_K) -> DataFrame:
        """The units most like a query, with score; analyze() must have run with run_semantic."""
        c = self.config
        if self._units is None or (self._vectors is None and c.mode in ("none", "traditional")):
            raise RuntimeError("Must run analyze() with run_semantic=True before search().")
        if self._vectors is None:
            return self._units.limit(0).withColumn("score", F.lit(0.0))
        own = profiles.task(c.semantic_task, profiles.CHECK_TASK)
        vector = self.embedder([profiles.instruction(c.model_name, True, own, c.instruction_prefix) + query], c.batch_size)[0]
        best = semantic.top_k(self._vectors, [float(x) for x in vector], c.threshold, top_k)
        return self._units.join(F.broadcast(best), "unit_id").orderBy(F.desc("score"), "unit_id")


def analyze_directory(spark: SparkSession, path: str | Path, embedder: Embedder | None = None, **options) -> AnalysisResult:
    """Analysis with a config of the given options."""
    return Analyzer(spark, AnalyzerConfig(**options), embedder).analyze(path)
