import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolot import Analyzer, AnalyzerConfig, TermFrequency, analyze_directory, cli, profiles, sinks
from echolot.embedding import SemanticBackendError, encode_with_backoff
from echolot.operators import graph
from echolot.sources import code

PROJECT = {
    "pkg/__init__.py": "",
    "pkg/one.py": """
        from pkg.two import helper as h

        def total(values):
            acc = 0
            for v in values:
                acc += v
            return acc

        def _dead(a):
            b = a + 1
            c = b * 2
            return c

        def _used(a):
            b = a + 1
            return b

        def _kept(a):  # noqa: echolot
            return a

        def run(x):
            y = _used(x)
            z = h(y)
            return z

        if __name__ == "__main__":
            run(1)
        """,
    "pkg/two.py": """
        class Tool:
            def get_it(self): return 1
            def _lost(self):
                return 2

        def helper(x):
            return x

        def summed(items):
            result = 0
            for item in items:
                result += item
            return result

        def _script(): return 1
        """,
    "pkg/broken.py": "def (",
    "tests/test_x.py": "def test_a(): pass",
    "build/gen.py": "def generated(): pass",
    "pyproject.toml": '[project.scripts]\nx = "pkg.two:_script"\n[project.gui-scripts]\ny = 3\n',
}


def names(df):
    return sorted(r.name for r in df.select("name").collect())


def test_file_listing(project, tmp_path):
    root = project(PROJECT)
    (root / "link.py").symlink_to(root / "pkg/two.py")
    rel = [p.removeprefix(f"{root}/") for p in code.list_files(root)]
    assert rel == ["link.py", "pkg/__init__.py", "pkg/broken.py", "pkg/one.py"] or rel == ["pkg/__init__.py", "pkg/broken.py", "pkg/one.py", "pkg/two.py"]
    # Own globs replace the default ones; folders stay excluded.
    rel = [p.removeprefix(f"{root}/") for p in code.list_files(root, ["**/one.py"])]
    assert "tests/test_x.py" in rel and "pkg/one.py" not in rel and not any(p.startswith("build") for p in rel)
    assert code.excluded("test_dir/a.py") and code.excluded("a_test.py") and not code.excluded("a.py") and code.excluded("one.py", ["**/one.py"])


def test_entry_points(project, tmp_path):
    assert code.entry_points(project(PROJECT)) == ["_script"]
    (tmp_path / "pyproject.toml").write_text("[[[")
    assert code.entry_points(tmp_path) == [] and code.entry_points(tmp_path / "none") == []


def test_traditional(spark, project):
    r = analyze_directory(spark, project(PROJECT), run_semantic=False)
    assert r.analysis_mode == "traditional" and r.filtered_raw_duplicates == 0
    pairs = sinks.with_units(r.traditional_duplicates, r.units).collect()
    assert [(p.unit_a["name"], p.unit_b["name"], p.method) for p in pairs] == [("total", "summed", "ast_hash")]
    # Public functions, called ones, scripts, marked ones and get_* are left alone.
    assert names(r.potentially_unused) == ["_dead", "_lost"]
    strict = analyze_directory(spark, project(PROJECT), run_semantic=False, strict_unused=True)
    assert names(strict.potentially_unused) == ["_dead", "_lost", "summed", "total"]


def test_combined_and_search(spark, project):
    a = Analyzer(spark, AnalyzerConfig(semantic_threshold=0.5), TermFrequency())
    r = a.analyze(project(PROJECT))
    assert r.analysis_mode == "combined" and {x.tier for x in r.hybrid_duplicates.collect()} >= {"exact"}
    # Exact pairs aren't scored again.
    assert r.semantic_duplicates.join(r.exact_duplicates, ["ua", "ub"], "left_semi").count() == 0
    a.config.semantic_threshold = 0.1
    hits = a.search("result items item", 1).collect()
    assert [h.name for h in hits] == ["summed"]
    out = sinks.check_dict(r, show_all=True)
    assert out["summary"]["hybrid_duplicates"] == len(out["hybrid_duplicates"]) and json.loads(sinks.as_json(out)) == out
    assert "Hybrid duplicates" in sinks.check_text(r, show_source=True)


class Broken:
    def __call__(self, texts, batch_size):
        raise SemanticBackendError("no backend here")


def test_fallback(spark, project):
    root = project(PROJECT)
    with pytest.raises(RuntimeError, match="allow-semantic-fallback"):
        Analyzer(spark, AnalyzerConfig(), Broken()).analyze(root)
    r = Analyzer(spark, AnalyzerConfig(allow_semantic_fallback=True), Broken()).analyze(root)
    assert r.semantic_fallback and r.traditional_duplicates.count() == 1 and r.semantic_duplicates.count() == 0
    with pytest.raises(Exception):
        Analyzer(spark, AnalyzerConfig(run_traditional=False), Broken()).analyze(root)


def broken(texts, batch_size):
    raise KeyError("a mistake of ours")


def test_mistakes_are_no_missing_backend(spark, project):
    with pytest.raises(Exception, match="a mistake of ours"):
        Analyzer(spark, AnalyzerConfig(allow_semantic_fallback=True), broken).analyze(project(PROJECT))


def test_a_tree_by_its_address(spark, project):
    root = project(PROJECT)
    (root / "pkg/latin.py").write_bytes(b"# \xe9\ndef lost_in(): pass\n")
    (root / "pkg/two.py").write_bytes(b"def crlf():\r\n    return 1\r\n")
    here, there = (analyze_directory(spark, x, run_semantic=False) for x in (root, f"file://{root}"))
    assert names(here.units) == names(there.units) and "crlf" in names(there.units) and "lost_in" not in names(there.units)
    assert {r.source for r in here.units.collect()} == {r.source for r in there.units.collect()}


def test_last_identifiers_of_a_uid_count(spark, project):
    one, two = "    a = alpha + beta\n    return gamma(a, delta)\n", "    zz = other\n    return zz\n"
    root = project({"a.py": f"def f():\n{one}\ndef f():\n{two}", "b.py": f"def g():\n{one}", "c.py": f"def h():\n{two}".replace("return zz", "return (zz, 1)")})
    found = Analyzer(spark, AnalyzerConfig(run_semantic=False, run_unused=False, filter_tiny_traditional=False, jaccard_threshold=0.45)).analyze(root)
    name = {r.unit_id: r.name for r in found.units.collect()}
    assert {frozenset((name[r.ua], name[r.ub])) for r in found.traditional_duplicates.where("method = 'jaccard'").collect()} == {frozenset("fh"), frozenset("f")}


def test_both_unused_pairs_are_dropped(spark, project):
    same = "def _{0}(a):\n    b = a + {1}\n    c = b * 2\n    return c\n"
    root = project({"a.py": same.format("p", 1) + same.format("q", 2)})
    for unused, n in ((True, 0), (False, 1)):
        r = Analyzer(spark, AnalyzerConfig(run_traditional=False, run_unused=unused, semantic_threshold=0.5), TermFrequency()).analyze(root)
        assert r.semantic_duplicates.count() == n


def test_empty_and_missing(spark, tmp_path):
    r = analyze_directory(spark, tmp_path, TermFrequency())
    assert r.analysis_mode == "none" and r.units.count() == 0 and r.all_duplicates.count() == 0
    with pytest.raises(FileNotFoundError):
        analyze_directory(spark, tmp_path / "none")
    with pytest.raises(RuntimeError, match="before search"):
        Analyzer(spark, AnalyzerConfig(), TermFrequency()).search("x")


def test_labels(spark, project, tmp_path):
    facts = Analyzer(spark, AnalyzerConfig(), TermFrequency()).extract(project(PROJECT))
    units = code.units(facts)
    assert code.positive_pairs(spark, [["one.py::total", "two.py::summed"]], units).count() == 1
    for bad in ([["one.py::nobody", "two.py::summed"]], [["one.py", "x"]]):
        with pytest.raises(ValueError):
            code.positive_pairs(spark, bad, units)
    for text in ('{"positive_groups": []}', '{"positive_groups": [["a"]]}'):
        (tmp_path / "l.json").write_text(text)
        with pytest.raises(ValueError):
            code.label_groups(tmp_path / "l.json")


def test_remote_listing_agrees(spark, project):
    root = project(PROJECT)
    got = {r.module for r in code.read_remote(spark, f"file://{root}").select("module").collect()}
    assert got == {r.module for r in code.read_files(spark, code.list_files(root), str(root)).select("module").collect()}


@pytest.mark.parametrize("options, said", [
    ({"jaccard_threshold": 2}, "jaccard_threshold"), ({"semantic_threshold": -1}, "semantic_threshold"), ({"batch_size": 0}, "batch_size"), ({"min_semantic_lines": -1}, "min_semantic_lines"),
    ({"semantic_unit_types": ()}, "at least one"), ({"semantic_unit_types": ("x",)}, "Invalid semantic_unit_types: x"), ({"tiny_unit_statement_cutoff": -1}, "tiny_unit"), ({"tiny_near_jaccard_min": 3}, "tiny_near"),
    ({"semantic_task": "x"}, "Invalid semantic_task"), ({"run_unused": False, "strict_unused": True}, "strict_unused"), ({"run_semantic": False, "batch_size": 3}, "batch_size require run_semantic"),
    ({"run_traditional": False, "jaccard_threshold": 0.2}, "jaccard_threshold require"), ({"run_traditional": False, "allow_semantic_fallback": True}, "allow_semantic_fallback"),
])
def test_config_refuses(options, said):
    with pytest.raises(ValueError, match=said):
        AnalyzerConfig(**options)


def test_config_normalises():
    c = AnalyzerConfig(semantic_unit_types=(" Method", "class", "METHOD"), semantic_task=" Clustering ")
    assert c.semantic_unit_types == ("method", "class") and c.semantic_task == "clustering" and c.threshold == 0.96


def test_profiles():
    assert profiles.profile("GTE-ModernBERT").key == "gte-modernbert-base" and profiles.profile("my/C2LLM-7B").family == "c2llm" and profiles.profile("x").threshold == 0.82
    assert profiles.instruction("embeddinggemma", False, "code-retrieval").startswith("title") and profiles.instruction("c2llm-0.5b", True, "retrieval").startswith("Represent this query")
    assert profiles.instruction("x", True, "retrieval") == "" and profiles.instruction("c2llm-0.5b", True, "retrieval", "p") == "p"
    assert profiles.load_options("c2llm-0.5b", None, False) == {"name": "codefuse-ai/C2LLM-0.5B", "revision": profiles.PROFILES[1].revision, "trust_remote_code": False}
    with pytest.raises(ValueError, match="Unknown semantic task"):
        profiles.task("x", "retrieval")


def test_backoff():
    tried = []

    def encode(texts, batch_size, device="gpu", **_):
        tried.append((batch_size, device))
        if device != "cpu":
            raise RuntimeError("CUDA out of memory")
        return np.ones((len(texts), 1))

    assert encode_with_backoff(encode, ["a"], 4).shape == (1, 1) and tried == [(4, "gpu"), (2, "gpu"), (1, "gpu"), (1, "cpu")]
    with pytest.raises(SemanticBackendError):
        encode_with_backoff(lambda *a, **k: (_ for _ in ()).throw(RuntimeError("other")), ["a"], 4)


@pytest.mark.parametrize("args", [
    ["--semantic-only", "--traditional-only"], ["--show-all", "--semantic-only"], ["--allow-semantic-fallback", "--traditional-only"], ["--json", "--verbose"], ["--json", "--output-width", "200"], ["--no-unused", "--strict-unused"],
    ["--traditional-only", "--model", "x"], ["--traditional-only", "--min-lines", "3"], ["--semantic-only", "--tiny-cutoff", "3"], ["--threshold", "2"], ["--batch-size", "0"], ["--output-width", "10"], ["--trust-remote-code", "--no-trust-remote-code"],
])
def test_cli_conflicts(args, tmp_path, capsys):
    assert cli.run(["check", str(tmp_path), *args]) == 2


def test_cli_thresholds():
    assert cli.thresholds({"threshold": 0.5}) == (0.5, 0.5) and cli.thresholds({}) == (None, 0.85)
    assert cli.thresholds({"threshold": 0.5, "semantic_threshold": 0.6, "traditional_threshold": 0.7}) == (0.6, 0.7)
    c = cli.config_of({"command": "check", "threshold": 0.5, "traditional_only": True})
    assert c.jaccard_threshold == 0.5 and c.semantic_threshold is None


def test_cli_runs(spark, project, tmp_path_factory, capsys):
    root = str(project(PROJECT))
    assert cli.run(["check", root, "--traditional-only", "--json"], spark) == 1
    out = json.loads(capsys.readouterr().out)
    assert out["analysis_mode"] == "traditional" and len(out["traditional_duplicates"]) == 1
    assert cli.run(["check", root, "--allow-semantic-fallback", "--json"], spark, Broken()) == 1
    assert json.loads(capsys.readouterr().out)["summary"]["semantic_fallback"] is True
    assert cli.run(["search", root, "result items item", "--threshold", "0.1", "--top-k", "1", "--json"], spark, TermFrequency()) == 0
    assert [r["name"] for r in json.loads(capsys.readouterr().out)["results"]] == ["summed"]
    assert cli.run(["check", str(tmp_path_factory.mktemp("empty")), "--term-frequency"], spark) == 0
    assert cli.run(["info"]) == 0 and "gte-modernbert-base" in capsys.readouterr().out


def test_markers_are_a_setting(spark, project):
    c = AnalyzerConfig(run_semantic=False, unused_markers=("keep me",))
    assert "_kept" in names(Analyzer(spark, c).analyze(project(PROJECT)).potentially_unused)
    assert graph.MARKERS[0].startswith("noqa")
