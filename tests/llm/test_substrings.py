import random
import re
from collections import defaultdict

import pytest

from echolot.llm import substrings

SCHEMA = "doc_id long, text string, bucket string, NAME int"


def brute(rows, least):
    """Every (id, start) where a maximal repeat begins: its longest one's length and number of occurrences."""
    texts = {(i, tuple(re.findall(r"[^\W_]+", t.lower()))) for i, t, *_ in rows if i is not None and t}
    at = defaultdict(list)
    for i, w in texts:
        for p in range(len(w) - least + 1):
            for n in range(least, len(w) - p + 1):
                at[w[p : p + n]].append((i, p, w[p - 1] if p else (i, w), w[p + n] if p + n < len(w) else (i, w, p)))
    best = {}
    for s, places in at.items():
        if len({x[2] for x in places}) > 1 and len({x[3] for x in places}) > 1:
            for i, p, *_ in places:
                best[i, p] = max(best.get((i, p), (0, 0)), (len(s), len(places)))
    return {k: v for k, v in best.items()}


def found(spark, rows, least, **options):
    got = substrings.repeats(spark.createDataFrame(rows, SCHEMA), least=least, **options).collect()
    out = {(r.doc_id, r.start_word): (r.words, r.occurrences) for r in got}
    assert len(out) == len(got)
    for r in got:
        assert r.repeat_id is not None
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed, monkeypatch):
    r = random.Random(seed)
    passages = [[r.choice("abcd") for _ in range(r.randint(4, 12))] for _ in range(3)]
    rows = []
    for i in range(14):
        w = [r.choice("abcdefgh") for _ in range(r.randint(0, 10))]
        for _ in range(r.randint(0, 2)):
            k = r.randint(0, len(w))
            w[k:k] = r.choice(passages)
        rows.append((i, " ".join(w), "x", 1))
    rows += [rows[3], (3, "other text a b c d e", "x", 1), (20, rows[5][1].upper() + "!", None, None), (21, rows[5][1], "x", 2)]
    if seed:
        monkeypatch.setattr(substrings, "SORT_BYTES", 40)
    assert found(spark, rows, 4, **({} if seed == 0 else {"broadcast_bytes": -1, "fingerprint_chars": 50, "task_windows": 20, "task_words": 500})) == brute(rows, 4)


def test_edge_cases(spark):
    empty = [(1, None, None, None), (2, "", None, None), (None, "a b c d e", None, None), (None, "a b c d e", None, None), (3, "a b", None, None)]
    assert found(spark, empty, 4) == {}
    assert found(spark, [], 4) == {}
    long = " ".join(f"w{i}" for i in range(20_000))
    assert found(spark, [(1, long, "", 0), (2, "x " + long, "", 0)], 50) == {(1, 0): (20_000, 2), (2, 1): (20_000, 2)}


def every(rows, least):
    """Every maximal repeat, with its places as (id, start), and their number."""
    texts = {(i, tuple(re.findall(r"[^\W_]+", t.lower()))) for i, t, *_ in rows if i is not None and t}
    at = defaultdict(list)
    for i, w in texts:
        for p in range(len(w) - least + 1):
            for n in range(least, len(w) - p + 1):
                at[w[p : p + n]].append((i, p, w[p - 1] if p else (i, w), w[p + n] if p + n < len(w) else (i, w, p)))
    return {s: x for s, x in at.items() if len({y[2] for y in x}) > 1 and len({y[3] for y in x}) > 1}


def nested(spark, rows, least, **options):
    """(id, start, words, occurrences) of all repeats that begin at a place, by the links to parents; and the ids of repeats."""
    got = substrings.repeats(spark.createDataFrame(rows, SCHEMA), least=least, nested=True, **options).collect()
    nodes = {r.repeat_id: r for r in got}
    assert all((nodes[r.repeat_id].words, nodes[r.repeat_id].occurrences, nodes[r.repeat_id].parent_id) == (r.words, r.occurrences, r.parent_id) for r in got)
    out = set()
    for r in got:
        node = r
        while node is not None:
            out.add((r.doc_id, r.start_word, node.words, node.occurrences))
            node = nodes[node.parent_id] if node.parent_id is not None else None
    return out, set(nodes)


def test_a_passage_that_every_place_extends_has_its_own_row(spark):
    passage = "p q r s t"
    rows = [(i, f"a{i} b{i} {passage} {'x' if i < 2 else 'y'} c{i} d{i}", "", 0) for i in range(4)]
    got, ids = nested(spark, rows, 4)
    assert got == {(i, 2, n, k) for i in range(4) for n, k in ((5, 4), (6, 2))} and len(ids) == 3


@pytest.mark.parametrize("seed", range(3))
def test_all_maximal_repeats_against_brute_force(spark, seed):
    r = random.Random(seed + 50)
    passages = [[r.choice("abcd") for _ in range(r.randint(4, 12))] for _ in range(2)]
    rows = []
    for i in range(24):
        w = [r.choice("abcdefgh") for _ in range(r.randint(0, 10))]
        for _ in range(r.randint(0, 3)):
            k = r.randint(0, len(w))
            w[k:k] = r.choice(passages)
        rows.append((i, " ".join(w), "x", 1))
    rows += [rows[3], (40, rows[5][1].upper() + "!", None, None), (41, rows[5][1], "x", 2), (42, rows[5][1] + " " + rows[6][1], "x", 2), (43, "a " * 30, "x", 2)]
    want = every(rows, 4)
    got, ids = nested(spark, rows, 4, **({"broadcast_bytes": -1, "fingerprint_chars": 50, "task_windows": 20, "task_words": 500} if seed else {}))
    assert got == {(i, p, len(s), len(x)) for s, x in want.items() for i, p, *_ in x}
    assert len(ids) == len(want)
