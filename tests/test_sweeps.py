import json

import pytest

from echolot import TermFrequency, sweeps
from echolot.embedding import SemanticBackendError, preflight, truncated, versions

LOOP = "def {0}(items):\n    acc = 0\n    for x in items:\n        acc += x\n    return acc\n\n"
OTHER = "def {0}(path):\n    with open(path) as f:\n        text = f.read()\n    return text\n\n"


def test_reports(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text(LOOP.format("add") + OTHER.format("load"))
    (root / "b.py").write_text(LOOP.format("total") + OTHER.format("slurp"))
    labels = tmp_path / "labels.json"
    labels.write_text(json.dumps({"positive_groups": [["a.py::add", "b.py::total"], ["a.py::load", "b.py::slurp"]]}))
    report = sweeps.threshold_report(spark, root, labels, {"mine": TermFrequency()})
    best = report["models"][0]["rows"][0]
    assert len(report["models"][0]["rows"]) == 14 and best["f1"] == 1.0 and report["models"][0]["selected_threshold"] == best["threshold"] == 0.7
    gates = sweeps.gate_report(spark, root, labels, TermFrequency(), weak_grid=(0.1, 0.2))
    assert len(gates["rows"]) == 50 and gates["best"]["tp"] == 2
    sweeps.write_report(report, tmp_path / "new" / "r.json")
    assert json.loads((tmp_path / "new" / "r.json").read_text()) == report


class Tokens:
    def encode(self, text, add_special_tokens):
        if text == "bad":
            raise ValueError
        return text.split()

    def decode(self, ids, skip_special_tokens):
        if ids[0] == "x":
            raise ValueError
        return " ".join(ids)


def test_truncation():
    t = Tokens()
    assert [truncated(s, t, 2) for s in ("a b", "a b c", "x y zzzzzzzzz", "bad")] == ["a b", "a b", "x y zzzz", "bad"]
    assert truncated("a b c", None, 2) == truncated("a b c", t, None) == "a b c"


def test_preflight():
    fine = {"transformers": "4.52.1", "sentence-transformers": "5.1.0", "deepspeed": "0.1"}
    preflight("c2llm-0.5b", fine)
    preflight("x", {})
    for change in ({"transformers": "5.0"}, {"transformers": "4.50.9"}, {"sentence-transformers": "missing"}):
        with pytest.raises(SemanticBackendError):
            preflight("c2llm-0.5b", fine | change)
    with pytest.raises(ModuleNotFoundError):
        preflight("c2llm-0.5b", fine | {"deepspeed": "missing"})
    assert versions()["python"]
