"""Command line: check, search and info."""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from . import __version__, profiles, sinks
from .analyzer import BATCH_SIZE, JACCARD_THRESHOLD, MIN_STATEMENTS, TINY_CUTOFF, TINY_NEAR_MIN, TOP_K, Analyzer, AnalyzerConfig
from .embedding import TermFrequency
from .schema import KINDS
from .sources.code import EXCLUDED_FOLDERS, EXCLUDED_GLOBS

WIDTH, LEAST_WIDTH = 160, 80


class UsageError(Exception):
    """Ends the program with status 2."""


class _Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        raise UsageError(message)


def _checked(kind, good, said: str):
    def convert(text: str):
        try:
            value = kind(text)
        except ValueError:
            raise argparse.ArgumentTypeError(f"{text!r} is not a number") from None
        if not good(value):
            raise argparse.ArgumentTypeError(f"must be {said}")
        return value

    return convert


share = _checked(float, lambda x: 0 <= x <= 1, "in [0.0, 1.0]")
positive = _checked(int, lambda x: x > 0, "> 0")
natural = _checked(int, lambda x: x >= 0, ">= 0")
wide = _checked(int, lambda x: x >= LEAST_WIDTH, f">= {LEAST_WIDTH}")


def _existing(text: str) -> Path:
    if not Path(text).exists():
        raise argparse.ArgumentTypeError(f"{text} does not exist")
    return Path(text)


def parser() -> argparse.ArgumentParser:
    top = _Parser(prog="echolot", description="Find duplicate and unused Python code.")
    top.add_argument("--version", action="version", version=f"echolot {__version__}")
    commands = top.add_subparsers(dest="command", required=True, parser_class=_Parser)
    shared = argparse.ArgumentParser(add_help=False, argument_default=argparse.SUPPRESS)
    add = shared.add_argument
    add("path", type=_existing)
    add("--threshold", "-t", type=share, help="for all methods that run")
    add("--semantic-threshold", type=share)
    add("--semantic-task", choices=profiles.TASKS)
    add("--no-private", action="store_true", help="leave out private functions and classes")
    add("--min-lines", type=natural, help=f"statements that a unit must have to be compared by meaning ({MIN_STATEMENTS})")
    add("--semantic-unit-type", action="append", choices=KINDS)
    add("--model", help=f"({profiles.DEFAULT_MODEL})")
    add("--instruction-prefix")
    add("--model-revision")
    add("--trust-remote-code", action="store_true")
    add("--no-trust-remote-code", action="store_true")
    add("--batch-size", type=positive, help=f"({BATCH_SIZE})")
    add("--term-frequency", action="store_true", help="compare by hashed word counts, which need no model")
    add("--json", action="store_true")
    add("--verbose", "-v", action="store_true")
    add("--exclude", action="append", help="globs that replace the default ones")
    add("--include-stubs", action="store_true")
    add("--output-width", type=wide, help=f"({WIDTH})")
    check = commands.add_parser("check", parents=[shared], argument_default=argparse.SUPPRESS)
    add = check.add_argument
    add("--traditional-threshold", type=share, help=f"({JACCARD_THRESHOLD})")
    for flag in ("semantic-only", "traditional-only", "allow-semantic-fallback", "no-unused", "strict-unused", "suppress-test-semantic", "no-tiny-filter", "show-all", "show-source", "full-table"):
        add(f"--{flag}", action="store_true")
    add("--tiny-cutoff", type=natural, help=f"({TINY_CUTOFF})")
    add("--tiny-near-jaccard-min", type=share, help=f"({TINY_NEAR_MIN})")
    search = commands.add_parser("search", parents=[shared], argument_default=argparse.SUPPRESS)
    search.add_argument("query")
    search.add_argument("--top-k", type=positive, help=f"({TOP_K})")
    commands.add_parser("info")
    return top


def _conflicts(given: dict) -> None:
    """UsageError where options that were given don't go together."""

    def clash(*names: str) -> bool:
        return all(given.get(n) for n in names)

    def listed(names) -> str:
        return ", ".join(f"--{n.replace('_', '-')}" for n in names if n in given)

    single = given.get("semantic_only") or given.get("traditional_only")
    for pair, why in (
        (("no_unused", "strict_unused"), "unused units aren't reported"),
        (("semantic_only", "traditional_only"), "nothing would run"),
        (("trust_remote_code", "no_trust_remote_code"), "they contradict each other"),
    ):
        if clash(*pair):
            raise UsageError(f"{listed(pair)} can't be combined: {why}")
    for name in ("allow_semantic_fallback", "show_all"):
        if single and given.get(name):
            raise UsageError(f"{listed([name])} is for combined mode only")
    if given.get("json") and (bad := listed(("verbose", "output_width", "show_source", "full_table"))):
        raise UsageError(f"{bad} can't be used with --json")
    semantic = ("semantic_threshold", "semantic_task", "instruction_prefix", "model", "model_revision", "trust_remote_code", "no_trust_remote_code", "batch_size", "min_lines", "semantic_unit_type", "suppress_test_semantic")
    if given.get("traditional_only") and (bad := listed(semantic)):
        raise UsageError(f"{bad} can't be used with --traditional-only")
    if given.get("semantic_only") and (bad := listed(("traditional_threshold", "no_tiny_filter", "tiny_cutoff", "tiny_near_jaccard_min"))):
        raise UsageError(f"{bad} can't be used with --semantic-only")


def thresholds(given: dict) -> tuple[float | None, float]:
    """Semantic and traditional: the method's own, else the shared one, else the default (None: the model's)."""
    shared = given.get("threshold")
    return given.get("semantic_threshold", shared), given.get("traditional_threshold", JACCARD_THRESHOLD if shared is None else shared)


def config_of(given: dict) -> AnalyzerConfig:
    """The analysis that the options ask for; UsageError where the config refuses them."""
    searching = given["command"] == "search"
    by_meaning, by_form = not given.get("traditional_only"), not (searching or given.get("semantic_only"))
    semantic, traditional = thresholds(given)
    options: dict = {
        "exclude_patterns": given.get("exclude"), "include_private": not given.get("no_private"), "include_stubs": bool(given.get("include_stubs")),
        "run_semantic": by_meaning, "run_traditional": by_form, "run_unused": not (searching or given.get("no_unused")), "strict_unused": bool(given.get("strict_unused")),
        "allow_semantic_fallback": bool(given.get("allow_semantic_fallback")), "min_semantic_lines": given.get("min_lines", MIN_STATEMENTS),
        "semantic_unit_types": tuple(given.get("semantic_unit_type", ("function", "method"))), "model_name": given.get("model", profiles.DEFAULT_MODEL),
    }
    if by_meaning:
        trust = True if given.get("trust_remote_code") else False if given.get("no_trust_remote_code") else None
        options |= {
            "semantic_threshold": semantic, "semantic_task": given.get("semantic_task", profiles.SEARCH_TASK if searching else profiles.CHECK_TASK), "instruction_prefix": given.get("instruction_prefix"),
            "model_revision": given.get("model_revision"), "trust_remote_code": trust, "batch_size": given.get("batch_size", BATCH_SIZE), "suppress_test_semantic_matches": bool(given.get("suppress_test_semantic")),
        }
    if by_form:
        options |= {"jaccard_threshold": traditional, "filter_tiny_traditional": not given.get("no_tiny_filter"), "tiny_unit_statement_cutoff": given.get("tiny_cutoff", TINY_CUTOFF), "tiny_near_jaccard_min": given.get("tiny_near_jaccard_min", TINY_NEAR_MIN)}
    try:
        return AnalyzerConfig(**options)
    except ValueError as e:
        raise UsageError(str(e)) from e


def info() -> str:
    lines = [
        f"echolot {__version__}", f"Default model: {profiles.DEFAULT_MODEL}", "Default model revision: the profile's", f"Default semantic threshold: {profiles.profile(profiles.DEFAULT_MODEL).threshold}",
        f"Default traditional threshold: {JACCARD_THRESHOLD}", f"Default semantic task of check: {profiles.CHECK_TASK}", f"Default semantic task of search: {profiles.SEARCH_TASK}",
        f"Default least statements for semantic comparison: {MIN_STATEMENTS}", f"Default output width: {WIDTH}", "Semantic fallback in combined mode: off", "Excluded globs: " + ", ".join(EXCLUDED_GLOBS),
        f"Excluded folders ({len(EXCLUDED_FOLDERS)}): " + ", ".join(sorted(EXCLUDED_FOLDERS)), "Models:",
    ]
    lines += [f"  {p.key} -> {p.canonical_name}; family {p.family}, threshold {p.threshold}, revision {p.revision or 'latest'}, remote code {'trusted' if p.trust_remote_code else 'not trusted'}; also {', '.join(p.names())}" for p in profiles.PROFILES]
    return "\n".join(lines)


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("echolot").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(argv: list[str], spark=None, embedder=None) -> int:
    """Status: 0 nothing found, 1 something found or a failure, 2 wrong use."""
    try:
        given = vars(parser().parse_args(argv))
        if given["command"] == "info":
            print(info())
            return 0
        _conflicts(given)
        config = config_of(given)
    except UsageError as e:
        print(f"echolot: {e}", file=sys.stderr)
        return 2
    logging.basicConfig(level=logging.DEBUG if given.get("verbose") else logging.ERROR if given.get("json") else logging.WARNING, stream=sys.stderr, force=True)
    try:
        if embedder is None and given.get("term_frequency"):
            embedder = TermFrequency()
        analyzer = Analyzer(spark or _session(), config, embedder)
        result = analyzer.analyze(given["path"])
        width = given.get("output_width", WIDTH)
        if given["command"] == "search":
            found = sinks.search_dict(given["query"], analyzer.search(given["query"], given.get("top_k", TOP_K)))
            rows = [(f"{r['score']:.3f}", r["name"], r["type"], f"{Path(r['file']).name}:{r['line']}") for r in found["results"]]
            print(sinks.as_json(found) if given.get("json") else sinks.table(f"Query: {given['query']}", ["score", "name", "type", "at"], rows, width) or "No matches")
            return 0
        if given.get("json"):
            print(sinks.as_json(sinks.check_dict(result, bool(given.get("show_all")))))
        else:
            print(sinks.check_text(result, width, *(bool(given.get(k)) for k in ("show_all", "show_source", "full_table"))))
        return int(not (result.all_duplicates.isEmpty() and result.potentially_unused.isEmpty()))
    except KeyboardInterrupt:
        print("Aborted!", file=sys.stderr)
        return 1
    except Exception as e:
        logging.getLogger(__name__).debug("failed", exc_info=True)
        print(f"echolot: {given['command']} failed: {e}", file=sys.stderr)
        return 1


def main() -> int:
    return run(sys.argv[1:])
