"""Operators that bring rows together: near duplicates, packing, neighbours, boilerplate."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from echolot.llm import boilerplate, neighbours, ngram_join, packing
from echolot.llm.components import components

DOCS = "doc_id long, text string, bands string, SIZE int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)


# ---- n-gram Jaccard


def corpus(seed=1, n=60):
    r = random.Random(seed)
    out = [(i, " ".join(f"w{r.randint(0, 400)}" for _ in range(r.randint(3, 60)))) for i in range(n)]
    for i in range(n, 2 * n):
        w = out[r.randint(0, n - 1)][1].split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"v{r.randint(0, 99)}"
        out.append((i, " ".join(w)))
    return out + [(900 + i, out[0][1].upper() + "!") for i in range(5)] + [out[0], (None, out[0][1]), (1000, None), (1001, ""), (1002, "?!"), (1003, "one"), (1004, "One."), (1005, "two words")]


def brute_jaccard(rows, threshold, n=3):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if i is not None and w:
            sets[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1)))
    by = defaultdict(list)
    for i, s in sorted(sets.items()):
        by[s].append(i)
    out = {(own[0], o): 1.0 for own in by.values() for o in own[1:]}
    heads = sorted((own[0], s) for s, own in by.items())
    for (a, x), (b, y) in combinations(heads, 2):
        j = len(x & y) / len(x | y)
        if j >= threshold:
            out[a, b] = j
    return out


@pytest.mark.parametrize("options", [{}, {"cell_grams": 40}])
def test_pairs_against_brute_force(spark, options, monkeypatch):
    if options:
        monkeypatch.setattr(ngram_join, "BROADCAST_BYTES", 0)
    rows = corpus()
    got = [tuple(x) for x in ngram_join.pairs(docs(spark, rows), recall=0.9999, **options).collect()]
    expect = brute_jaccard(rows, 0.5)
    assert len(expect) > 30 and len(got) == len(set(got))
    found = {(a, b): j for a, b, j in got}
    # Nothing false, every value exact; with this recall nothing at all may be missing here.
    assert found.keys() == expect.keys() and all(abs(found[k] - expect[k]) < 1e-12 for k in found)


def brute_classes(rows, threshold):
    """doc_id -> (class, set, copies, links), by all pairs."""
    pairs = brute_jaccard(rows, threshold)
    ids = {i for i, _ in rows if i is not None}
    head = {i: i for i in ids} | {b: a for (a, b), j in brute_jaccard(rows, 1.0).items() if j == 1}
    links = Counter(x for (a, b), j in pairs.items() if head[a] != head[b] for x in (a, b))
    low = dict(head)
    for _ in ids:
        for a, b in pairs:
            a, b = head[a], head[b]
            low[a] = low[b] = min(low[a], low[b])
    members = Counter(head.values())
    return {i: (low[head[i]], head[i], members[head[i]] - 1, links[head[i]]) for i in ids}


@pytest.mark.parametrize("options", [{}, {"cell_grams": 900}, {"cell_grams": 90}])
def test_classes_against_brute_force(spark, options, monkeypatch):
    if options:
        monkeypatch.setattr(ngram_join, "BROADCAST_BYTES", 0)
    rows = corpus() + [(2000 + i, " ".join(f"near{k}" for k in range(40) if k != i)) for i in range(30)]
    got = {x.doc_id: tuple(x)[1:] for x in ngram_join.classes(docs(spark, rows), recall=0.9999, **options).collect()}
    assert got == brute_classes(rows, 0.5)
    assert sum(links for *_, links in got.values()) > 300
    assert ngram_join.classes(docs(spark, [])).count() == 0


def test_a_set_is_compared_in_few_cells(spark):
    """A chain of texts, each alike to the next, is one component; cut into buckets it gives the same links, each once."""
    w = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(w[6 * i : 6 * i + 30])) for i in range(60)]
    base = docs(spark, rows).select("doc_id", "text")
    bands = ngram_join.bands_for(0.5, 0.9999, 3)
    signed, _, owners = ngram_join._members(base, 3, bands, 3)
    cells = ngram_join._cells(base, signed, owners, 3, bands, 200).select("cell", "doc_id").collect()
    assert {x.cell.kind for x in cells} >= {ngram_join.BUCKET} and max(Counter(x.doc_id for x in cells).values()) <= bands
    got = {x.doc_id: tuple(x)[1:] for x in ngram_join.classes(docs(spark, rows), recall=0.9999, cell_grams=200).collect()}
    assert got == brute_classes(rows, 0.5) and {c for c, *_ in got.values()} == {0}


def test_long_texts_and_any_column(spark):
    long = " ".join(f"w{i % 7001}x{i % 13}" for i in range(150_000))
    d = spark.createDataFrame([(1, long, "a", None), (2, long + " end", None, "b"), (None, long, "c", "d"), (3, None, "e", "f"), (2, long + " end", "g", "h")], "doc_id long, text string, lost string, LOST string".replace("LOST", "_lost"))
    assert [tuple(x) for x in ngram_join.classes(d).orderBy("doc_id").collect()] == [(1, 1, 1, 0, 1), (2, 1, 2, 0, 1), (3, 3, 3, 0, 0)]
    assert sorted((x.doc_id or 0, x.lost) for x in ngram_join.clean(d).collect()) == [(0, "c"), (1, "a"), (3, "e")]


def test_bands_reach_the_recall():
    for t, recall, rows in ((0.5, 0.97, 3), (0.8, 0.99, 6)):
        b = ngram_join.bands_for(t, recall, rows)
        assert 1 - (1 - t**rows) ** b >= recall > 1 - (1 - t**rows) ** (b - 1)
    # Measured: minima of random sets of similarity one half meet in a band as often.
    r = random.Random(0)
    hits, n = 0, 150
    for _ in range(n):
        both = [f"b{r.random()}" for _ in range(60)]
        x, y = (" ".join(both + [f"o{r.random()}" for _ in range(30)]) for _ in range(2))
        *_, own = ngram_join.signatures([x.replace(".", ""), y.replace(".", "")], 1, ngram_join.bands_for(0.5, 0.97, 3), 3)
        hits += bool((own[0] == own[1]).any())
    assert hits / n > 0.9


def test_one_of_each_group_stays(spark):
    rows = corpus()
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in brute_jaccard(rows, 0.5):
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    kept = ngram_join.clean(docs(spark, rows), recall=0.9999)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in rows if i is None or root(i) == i) and kept.columns == docs(spark, []).columns
    assert ngram_join.clean(docs(spark, [])).count() == 0
    assert ngram_join.pairs(docs(spark, rows), threshold=1.0).count() == sum(j == 1 for j in brute_jaccard(rows, 1.0).values())


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7)]
    parent = {i: i for e in edges for i in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x.doc_id: x.component for x in got} == {i: root(i) for i in parent} and len(got) == len(parent)


# ---- packing


def test_best_fit_and_bounds():
    r = np.random.default_rng(3)
    for _ in range(200):
        c = int(r.integers(1, 40))
        sizes = r.integers(1, c + 1, int(r.integers(1, 9)))
        bins = packing.best_fit(sizes, c)
        assert np.bincount(bins, sizes).max() <= c
        least = exact_bins(sizes.tolist(), c)
        assert packing.bound(sizes, c) <= least <= bins.max() + 1
    # Bounds beyond the sum: three halves and a bit; items of just over a third.
    assert packing.bound(np.array([51, 51, 51]), 100) == 3 and packing.bound(np.array([34] * 5), 100) == 3 and packing.bound(np.array([]), 9) == 0


def exact_bins(sizes, c):
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] >= sizes[i]:
                place(i + 1, [*bins[:k], bins[k] - sizes[i], *bins[k + 1 :]])
        place(i + 1, [*bins, c - sizes[i]])

    place(0, [])
    return best


def test_pack_holds_every_word_once(spark):
    r = random.Random(4)
    rows = [(i, "w " * r.randint(0, 70)) for i in range(200)] + [(1, "x y"), (None, "z"), (500, None), (501, ""), (502, " \n"), (503, "a " * 1000)]
    got = packing.pack(docs(spark, rows), capacity=32, partition_pieces=40).collect()
    fill = Counter()
    for x in got:
        fill[x.bin] += x.words
    assert all(fill[x.bin] == x.fill <= 32 for x in got)
    assert sum(x.words for x in got) == sum(len((t or "").split()) for _, t in rows)
    lengths = defaultdict(list)
    for x in got:
        lengths[x.doc_id].append((x.start, x.words))
    for i, t in rows[200:]:
        assert sum(n for _, n in lengths[i]) == sum(len((u or "").split()) for j, u in rows if j == i)
    assert sorted(lengths[503]) == [(k, min(32, 1000 - k)) for k in range(0, 1000, 32)]
    assert packing.pack(docs(spark, [])).count() == 0
    long = packing.pack(docs(spark, [(1, "ab " * 300_000)])).collect()
    assert sum(x.words for x in long) == 300_000 and len(long) == -(-300_000 // packing.CAPACITY)


def test_gaps_are_exchanged(spark):
    # Sizes that best-fit decreasing packs badly in small partitions.
    r = random.Random(5)
    rows = [(i, "w " * r.choice([44, 31, 24, 22, 21, 17, 16, 8, 6])) for i in range(240)]
    one = packing.pack(docs(spark, rows), capacity=60, partition_pieces=10, rounds=0).collect()
    more = packing.pack(docs(spark, rows), capacity=60, partition_pieces=10, rounds=4).collect()
    assert len({x.bin for x in more}) < len({x.bin for x in one}) and sum(x.words for x in more) == sum(x.words for x in one)
    # Certified partitions use as few bins as any packing can.
    parts = defaultdict(list)
    for x in one:
        parts[x.bin["part"]].append(x)
    for own in parts.values():
        if all(x.certified for x in own):
            assert len({x.bin for x in own}) == packing.bound(np.array([x.words for x in own]), 60)


def test_a_full_bin_is_not_certified_alone(spark):
    rows = [(i, "w " * n) for i, n in enumerate([3, 6, 7, 2, 5, 7, 2, 4])]
    for rounds in (0, 4):
        got = packing.pack(docs(spark, rows), capacity=12, rounds=rounds).collect()
        assert any(x.full for x in got) and all(x.full == (x.fill == 12) for x in got)
        # Three bins suffice.
        assert {x.certified for x in got} == {len({x.bin for x in got}) == 3}


# ---- neighbours


VECTORS = "vec_id long, embedding array<float>, Neighbour_ID string, rank int"


def test_recall_and_exact_similarities(spark):
    r = np.random.default_rng(6)
    v = r.normal(size=(1500, 16)).astype(np.float32)
    v[1000:] = v[:500] + 0.05 * r.normal(size=(500, 16))
    d = spark.createDataFrame([(i, x.tolist(), "x", 0) for i, x in enumerate(v)], VECTORS)
    got = neighbours.nearest(d, k=5, leaf=60, recall=0.95).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = (u @ u.T).astype(float)
    np.fill_diagonal(s, -2)
    true = np.argsort(-s, axis=1, kind="stable")[:, :5]
    near = defaultdict(set)
    for x in got:
        near[x.vec_id].add(x.neighbour_id)
        assert abs(s[x.vec_id, x.neighbour_id] - x.similarity) < 1e-5
    assert np.mean([len(near[i] & set(t)) / 5 for i, t in enumerate(true.tolist())]) >= 0.9
    assert len(got) == 1500 * 5 and Counter(x.rank for x in got) == {k: 1500 for k in range(1, 6)}


@pytest.mark.parametrize("task", [20_000, 7])
def test_queries_against_all_vectors(spark, task):
    """With every leaf visited the search is exact: ties by the lower id, copies included, however leaves are dealt to tasks."""
    r = np.random.default_rng(7)
    v = r.integers(-2, 3, size=(400, 4)).astype(np.float32)
    v[100:220] = [1, 2, 0, -1]
    d = spark.createDataFrame([(i, x.tolist(), "x", 0) for i, x in enumerate(v)], VECTORS)
    got = {(x.vec_id, x.rank): (x.neighbour_id, x.similarity) for x in neighbours.nearest(d, k=6, every=20, leaf=60, recall=1.0, task_vectors=task).collect()}
    u = neighbours.unit(v).astype(float)
    expect = {}
    for i in range(0, 400, 20):
        s = np.round(u @ u[i], 9)
        near = sorted((j for j in range(400) if j != i), key=lambda j: (-s[j], j))[:6]
        expect |= {(i, k + 1): (j, s[j]) for k, j in enumerate(near)}
    assert got.keys() == expect.keys()
    # Recall is measured on probes, so a few of the others may miss one; similarities are exact.
    assert sum(got[x][0] == expect[x][0] for x in got) >= 0.9 * len(got) and sum(abs(got[x][1] - expect[x][1]) < 1e-6 for x in got) >= 0.9 * len(got)


def test_order_against_a_heap():
    """The order of visits is that of one priority queue over all trees' nodes, equal costs included."""
    import heapq

    r = np.random.default_rng(9)
    v = np.round(r.normal(size=(300, 4))).astype(np.float32)
    f = neighbours.grow(v, 4, 3)
    full = f.order(v[:40], 3 * f.leaves)
    for i in range(40):
        heap = [(0.0, t, 0, 0) for t in range(3)]
        cost = {}
        while heap:
            c, t, level, node = heapq.heappop(heap)
            if level == len(f.trees[t]):
                cost[t * f.leaves + node] = c
                continue
            normal, cut = f.trees[t][level]
            side = float((v[i].astype(np.float64) @ normal.T - cut)[node])
            near = 2 * node + (side > 0)
            heapq.heappush(heap, (c, t, level + 1, near))
            heapq.heappush(heap, (max(c, abs(side)), t, level + 1, near ^ 1))
        assert np.allclose([cost[x] for x in full[i].tolist()], sorted(cost.values()), atol=1e-6)


def test_order_is_that_of_one_queue():
    r = np.random.default_rng(8)
    v = r.normal(size=(600, 8)).astype(np.float32)
    f = neighbours.grow(v, 4, 3)
    own = f.leaf_of(v)
    full = f.order(v[:50], 3 * f.leaves)
    assert all(sorted(x) == list(range(3 * f.leaves)) for x in full.tolist())
    # Each query's own leaves cost nothing, so they are the first three; fewer visits are the beginning of more.
    assert all(set(full[i, :3]) == {t * f.leaves + own[i, t] for t in range(3)} for i in range(50))
    assert (f.order(v[:50], 7) == full[:, :7]).all()


def test_neighbour_edge_cases(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [1.0]), (7, [float("nan"), 1.0]), (None, [1.0, 0.0]), (8, [0.0, 1.0]), (8, [9.0, 9.0]), (9, [None, 1.0]), (10, [-1.0, 0.0])]
    d = spark.createDataFrame([(i, x, "x", 0) for i, x in rows], VECTORS)
    got = {(x.vec_id, x.rank): (x.neighbour_id, round(x.similarity, 5)) for x in neighbours.nearest(d, k=2).collect()}
    assert {i for i, _ in got} == {1, 2, 3, 8, 10}
    # Ties go by the lower id, and the lower of two vectors counts.
    assert got[1, 1] == (2, 1.0) and got[1, 2] == (3, 0.0) and got[3, 1] == (1, 0.0) and got[3, 2] == (2, 0.0)
    assert neighbours.nearest(d.limit(0)).count() == 0 and neighbours.nearest(d.limit(1)).count() == 0


# ---- boilerplate


PAGES = "page_id long, url string, html string, host string, Name int"


def page(r, host, i):
    nav = f"<nav><ul><li><a href='/a'>{host} home</a></li><li>about us</li></ul></nav>" if r.random() < 0.8 else ""
    body = " ".join(f"t{r.randint(0, 30)}" for _ in range(r.randint(0, 25)))
    return (i, f"https://u@{host}.org:80/p/{i}", f"<html><title>no</title><script>var a = '<p>';</script><!-- x --><body>{nav}<p>{body}</p><style>p{{}}</style><footer>&copy; all rights reserved by {host}</footer>", "q", 1)


def test_extraction_against_brute_force(spark):
    r = random.Random(9)
    rows = [page(r, f"h{r.randint(0, 3)}", i) for i in range(60)]
    rows += [(100, "no host", rows[0][2], "", 0), (101, None, rows[0][2], "", 0), (102, "https://h0.org/", None, "", 0), (103, "https://h0.org/", "", "", 0), (None, "https://H1.org/x", "only some words here", "", 0), rows[5], (104, "//h9.org", "a b c d e f a b c d e f", "", 0)]
    least = 5
    occurs = defaultdict(set)
    streams = []
    for k, (i, u, h, *_) in enumerate(rows):
        m = re.match(r"^(?:[a-z]+:)?//(?:[^/?#@]*@)?([^/?#:]*)", (u or "").lower())
        host, w = m[1] if m else "", re.findall(r"[^\W_]+", boilerplate.visible(h).lower())
        streams.append((host, w))
        for p in range(len(w) - least + 1):
            if host:
                occurs[host, tuple(w[p : p + least])].add((i, u, h))
    for options in ({}, {"task_chars": 300, "task_words": 40, "broadcast_bytes": -1}):
        got = boilerplate.extract(spark.createDataFrame(rows, PAGES), least=least, **options).collect()
        assert len(got) == len(rows)
        expect = []
        for (i, u, _, *_), (host, w) in zip(rows, streams):
            hit = [False] * len(w)
            for p in range(len(w) - least + 1):
                if len(occurs[host, tuple(w[p : p + least])]) > 1:
                    hit[p : p + least] = [True] * least
            expect.append((i, u, host, tuple(x for x, c in zip(w, hit) if not c), len(w), sum(hit)))
        assert Counter((x.page_id, x.url, x.host, tuple(re.findall(r"[^\W_]+", x.text.lower())), x.words, x.removed) for x in got) == Counter(expect)
        assert sum(x.removed for x in got) > 100
    assert boilerplate.extract(spark.createDataFrame([], PAGES)).count() == 0
    body = " ".join(f"w{i}" for i in range(60_000))
    long = boilerplate.extract(spark.createDataFrame([(i, "//h/", f"<p>{body}</p><p>{t}</p>", "", 0) for i, t in enumerate(("one two", "three"))], PAGES)).orderBy("page_id").collect()
    assert [(x.text, x.words - x.removed) for x in long] == [("one two", 2), ("three", 1)]


def test_lengths_that_another_page_shares():
    r = random.Random(1)
    for _ in range(200):
        rows = sorted(("".join(r.choice("ab") for _ in range(r.randint(1, 6))), r.choice([-1, 0, 1, 2])) for _ in range(r.randint(1, 9)))
        common = lambda x, y: next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
        lcp = np.array([0] + [common(a, b) for (a, _), (b, _) in zip(rows, rows[1:])])
        page = np.array([p if p >= 0 else -1 - i for i, (_, p) in enumerate(rows)])
        got = boilerplate.shared_lengths(lcp, page, np.array([len(x) for x, _ in rows]))
        for i, (x, p) in enumerate(rows):
            assert got[i] == (len(x) if p < 0 else max((common(x, y) for j, (y, q) in enumerate(rows) if j != i and (q != p or q < 0)), default=0))


def test_visible_text():
    v = boilerplate.visible
    assert v("a<b>b</b>c").split() == ["abc"] and v("<p>a</p><p>b").split() == ["a", "b"]
    assert v('<img alt="x > y">t &amp; u').split() == ["t", "&", "u"] and v("x <!-- y").split() == ["x"] and v("<script>z").split() == []
    assert v("1 < 2 <q") .split() == ["1", "<", "2"] and v(None) == "" and v('<a href="x').strip() == ""
