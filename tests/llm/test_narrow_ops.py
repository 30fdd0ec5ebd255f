"""Scans that read each text on its own: licenses, benchmark leaks, personal data, toxicity, shards."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from echolot.llm import decontamination, licenses, pii, sharding, toxicity
from echolot.llm.words import windows, words

DOCS = "doc_id long, text string, start string, TOXIC string, score int"
EDGE = [(1, None, None, None, None), (2, "", "", "", 1), (None, "x", "a", "b", 2), (3, "a" * 300_000 + " end", "a", "b", 3), (4, "Ünï\U0001f600 İx퟿", "a", "b", 4)]


def docs(spark, rows=EDGE):
    return spark.createDataFrame(rows, DOCS)


def test_words_match_a_plain_version():
    r = random.Random(1)
    texts = ["".join(r.choice("aB é_1-\n\U0001f600ßЖ") for _ in range(r.randint(0, 60))) for _ in range(80)]
    w = words(texts)
    at = [(i, m.start(), m.end(), m.group().lower()) for i, t in enumerate(texts) for m in re.finditer(r"[^\W_]+", t)]
    assert list(zip(w.row, w.start, w.end)) == [x[:3] for x in at]
    by = {}
    for h, (*_, s) in zip(w.hash.tolist(), at):
        assert by.setdefault(s, h) == h
    assert len(set(by.values())) == len(by)
    where, h = w.prefix(2)
    assert [at[i][3][:2] for i in where] == [s[:2] for *_, s in at if len(s) > 2] and len(set(h.tolist())) == len({s[:2] for *_, s in at if len(s) > 2})
    for n in (2, 12):
        g = windows(w.hash, n)
        plain = [tuple(x[3] for x in at[i : i + n]) for i in range(len(at) - n + 1)]
        assert len(g) == len(plain) and len(set(zip(g.tolist(), plain))) == len(set(plain))


# ---- licenses

TEMPLATES = {"one": 'the <<beginOptional>>big <<beginOptional>>red<<endOptional>> <<endOptional>> fox <<var;name="x";original="o";match=".{0,2}">> ran', "two": 'b <<var;name="x";original="o";match=".+">> c d', "three": "under the licence"}
PLAIN = {"one": r"\bthe (?:big (?:red )?)?fox (?:\w+ ){0,2}ran\b", "two": r"\bb (?:\w+ )+?c d\b", "three": r"\bunder the licen[cs]e\b"}


def test_license_matches_like_regular_expressions():
    r = random.Random(3)
    words_ = "the big red fox ran b c d under licence license x".split()
    texts = [" ".join(r.choice(words_) for _ in range(r.randint(0, 40))) for _ in range(300)] + ["The BIG, fox -- a b; ran!"]
    got = Counter((t, k, s) for t, k, s, *_ in licenses.Scanner(TEMPLATES).scan(texts))
    expect = Counter()
    for i, t in enumerate(texts[:-1]):
        for k, p in PLAIN.items():
            at = 0
            while m := re.compile(p).search(t, at):
                # Of the matches from there, the longest.
                ends = [e for e in range(m.start() + 1, len(t) + 1) if re.compile(p).fullmatch(t, m.start(), e)]
                expect[i, k, m.start()] += 1
                at = max(ends)
    assert {k: v for k, v in got.items() if k[0] < 300} == dict(expect)
    assert (300, "one", 0) in got


@pytest.mark.parametrize("bad", ["<<beginOptional>>a", "a<<endOptional>>", "<<what>>a", '<<var;match="[a]">>a', "<<beginOptional>>a<<endOptional>>"])
def test_license_templates_are_checked(bad):
    with pytest.raises(ValueError):
        licenses.compiled("x", bad)


def test_license_wording_must_be_exact(spark):
    mit = re.sub(r"<<var;name=\"holder\"[^>]*>>", "THE PEOPLE", licenses.TEMPLATES["MIT"])
    mit = re.sub(r"<<[^>]*?>>+", "", mit.replace('<<var;name="copyright";original="(c) <year> <holder>";match=".{0,40}">>', "2020 Me "))
    rows = EDGE + [(7, "x\n" + mit + "\ny", "", "", 0), (8, mit.replace("free of charge", "for a charge"), "", "", 0), (9, "Released under the MIT License.", "", "", 0), (9, "Released under the MIT License.", "", "", 0)]
    got = licenses.matches(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.license_id) for r in got) == {(7, "MIT"): 1, (9, "MIT-notice"): 2}
    assert licenses.matches(docs(spark, [])).count() == 0


# ---- decontamination


def test_leaks_against_brute_force(spark):
    r = random.Random(2)
    items = [(i, " ".join(r.choice("abcde") * 2 for _ in range(r.randint(3, 20)))) for i in range(8)]
    items += [(90, None), (91, ""), (92, "aa bb"), (93, "x y"), (None, "aa bb cc dd"), (3, items[3][1])]
    rows = list(EDGE)
    for i in range(40):
        w = [r.choice("abcde") * 2 for _ in range(r.randint(0, 30))]
        if i % 3 == 0:
            own = r.choice(items[:8])[1].split()
            w[5:5] = own if i % 2 else own[: len(own) // 2]
        rows.append((100 + i, r.choice(["", "¿", "A, "]) + r.choice([" ", " - ", "\n"]).join(w).title() + r.choice(["", "!", "\n"]), "", "", 0))
    n, least = 6, 4
    expect = set()
    for d, t, *_ in rows:
        found = list(re.finditer(r"[^\W_]+", t or ""))
        low = [m.group().lower() for m in found]
        for i, x in set(items):
            own = re.findall(r"[^\W_]+", (x or "").lower())
            if i is None or not own:
                continue
            k = min(n, len(own))
            grams = {tuple(own[j : j + k]) for j in range(len(own) - k + 1)}
            hit = [j for j in range(len(low) - k + 1) if tuple(low[j : j + k]) in grams]
            spans = []
            for j in hit:
                if spans and found[j].start() <= found[spans[-1][1]].end():
                    spans[-1][1] = j + k - 1
                else:
                    spans.append([j, j + k - 1])
            expect |= {(d, i, found[a].start(), found[b].end(), b - a + 1, len(own) >= least) for a, b in spans}
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(x) for x in decontamination.leaks(docs(spark, rows), frame, n=n, least=least).collect()]
    assert expect and set(got) == expect and len(got) == len(expect) and {x[-1] for x in got} == {True, False}
    bad = {d for d, *_, sure in expect if sure}
    kept = decontamination.clean(docs(spark, rows), frame, n=n, least=least)
    assert sorted(x.doc_id or -1 for x in kept.collect()) == sorted(d or -1 for d, *_ in rows if d not in bad) and kept.columns == docs(spark).columns
    # Several automata give the same rows; an item whose two texts are in two of them has one span where these overlap.
    few = {"n": n, "least": least, "pattern_words": 30}
    assert len(decontamination.test_sets(frame, **few)) > 3
    again = [tuple(x) for x in decontamination.leaks(docs(spark, rows + rows[-1:]), frame, **few).collect()]
    assert Counter(again) == Counter(got + [x for x in got if x[0] == rows[-1][0]])
    assert Counter(x.doc_id for x in decontamination.clean(docs(spark, rows), frame, **few).collect()) == Counter(x.doc_id for x in kept.collect())
    own = spark.createDataFrame([(7, "a b c d e f g h"), (7, "g h i j k l m n"), (8, "x y z")], "item_id long, text string")
    text = docs(spark, [(1, "A b c d e f g h i j k l m n, x Y z", "", "", 0)])
    for words_ in (1000, 40):
        assert [tuple(x) for x in decontamination.leaks(text, own, n=8, least=4, pattern_words=words_).orderBy("start").collect()] == [(1, 7, 0, 27, 14, True), (1, 8, 29, 34, 3, False)]
    assert decontamination.leaks(docs(spark, rows), frame.limit(0)).count() == 0 and decontamination.leaks(docs(spark, []), frame).count() == 0


# ---- personal data


def test_field_on_held_out_sentences():
    model = pii.fit()
    data = pii.sentences(400, 77)
    g = pii.graph([t for t, _ in data])
    y = pii.gold(g, [m for _, m in data])
    found = model.beliefs(g).argmax(1)
    # Values with a digit or an @, and words, which take what stands around them.
    word = np.array(["word" in f for f in g.features])
    assert (found == y)[~word].mean() > 0.99 and (found == y)[word].mean() > 0.93
    for kind in ("PERSON", "ADDRESS", "SECRET"):
        k = pii.LABELS.index(kind)
        assert (y[found == k] == k).mean() > 0.9 and (found[y == k] == k).mean() > 0.75, kind


@pytest.mark.parametrize(
    "text, expect",
    [
        ("password: correcthorsebattery", [("SECRET", "correcthorsebattery")]),
        ('token = "abcdefabcdefabcdef"', [("SECRET", "abcdefabcdefabcdef")]),
        ("the iban DE44 5001 0517 5407 3249 31, done", [("ID", "DE44 5001 0517 5407 3249 31")]),
        ("from 2001:db8::ff00:42:8329 at 12:30:45", [("IP", "2001:db8::ff00:42:8329")]),
        ("Sagte Herr Meier. Dann ging Meier.", [("PERSON", "Meier")] * 2),
        ("they live at 12 Baker Street now", [("ADDRESS", "12 Baker Street")]),
        ("Key: see below. The password for the house is under the General Public License. St. Other.", []),
    ],
)
def test_values_of_words(text, expect):
    assert [(k, text[s:e]) for _, s, e, k, _ in pii.find([text], pii.fit())] == expect


def plain_beliefs(model, g, rounds=50):
    """Messages one by one, over the connected part of each node alone."""
    u = model.unary(g)
    near = {i: {i} for i in range(len(g.text))}
    for a, b, _ in g.edges:
        if near[a] is not near[b]:
            near[a] |= near[b]
            for i in near[b]:
                near[i] = near[a]
    out = np.array(u)
    for part in {id(x): x for x in near.values()}.values():
        edges = [(a, b, model.pair[k]) for a, b, k in g.edges if a in part]
        m = {(i, way): np.zeros(pii.K) for i in range(len(edges)) for way in (0, 1)}
        for _ in range(rounds):
            total = {i: u[i] + sum((m[j, way] for way in (0, 1) for j, e in enumerate(edges) if e[1 - way] == i), np.zeros(pii.K)) for i in part}
            new = {}
            for j, (a, b, psi) in enumerate(edges):
                for way, (x, p) in enumerate(((a, psi), (b, psi.T))):
                    z = (total[x] - m[j, 1 - way])[:, None] + p
                    v = np.logaddexp.reduce(z, 0)
                    new[j, way] = v - v.max()
            moved = max((np.abs(new[x] - m[x]).max() for x in m), default=0)
            m = {x: 0.3 * m[x] + 0.7 * new[x] for x in m}
            if moved < 1e-3:
                break
        for i in part:
            out[i] = u[i] + sum((m[j, way] for way in (0, 1) for j, e in enumerate(edges) if e[1 - way] == i), np.zeros(pii.K))
    p = np.exp(out - out.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def test_query_against_plain_messages(spark):
    """Spans and scores don't depend on what a text is read with, and are those of messages sent one by one."""
    model = pii.fit()
    texts = [t for t, _ in pii.sentences(60, 5)]
    rows = [(i, t, "", "", 0) for i, t in enumerate(texts)]
    one, many = ({(r.doc_id, r.start, r.end, r.kind): r.score for r in pii.spans(docs(spark, rows).repartition(n)).collect()} for n in (1, 16))
    assert one.keys() == many.keys() and all(abs(v - many[k]) < 2e-6 for k, v in one.items())
    for i, t in enumerate(texts):
        g = pii.graph([t])
        p = plain_beliefs(model, g)
        assert np.allclose(p, model.beliefs(g), atol=1e-9)
        expect = {(s, e): (pii.LABELS[y.argmax()], y.max()) for s, e, y in zip(g.start, g.end, p) if y.argmax()}
        own = {k: v for k, v in one.items() if k[0] == i}
        # A span is made of neighbouring nodes of its kind, and scores as the least sure of them.
        covered = set()
        for (_, s, e, kind), score in own.items():
            nodes = {k: v for k, v in expect.items() if s <= k[0] and k[1] <= e}
            assert nodes and {k for k, _ in nodes.values()} == {kind} and abs(min(v for _, v in nodes.values()) - score) < 2e-6
            covered |= nodes.keys()
        assert covered == expect.keys()


def test_messages_match_enumeration_on_small_graphs():
    from itertools import product

    r = np.random.default_rng(4)
    model = pii.Field({}, r.normal(size=(3, pii.K, pii.K)))
    for k in (pii.SAME, pii.ALIKE):
        model.pair[k] = (model.pair[k] + model.pair[k].T) / 2
    # A tree, on which message passing is exact.
    g = pii.Graph(text=[0] * 4, start=[0] * 4, end=[0] * 4, features=[[]] * 4, outside=[1, 0, 0, 2], edges=[(0, 1, pii.CHAIN), (1, 3, pii.SAME), (1, 2, pii.ALIKE)])
    u = model.unary(g)
    total = np.zeros((4, pii.K))
    for y in product(range(pii.K), repeat=4):
        p = np.exp(sum(u[i, v] for i, v in enumerate(y)) + sum(model.pair[k, y[a], y[b]] for a, b, k in g.edges))
        for i, v in enumerate(y):
            total[i, v] += p
    assert np.allclose(model.beliefs(g), total / total.sum(1, keepdims=True), atol=1e-2)


def test_skip_edges_carry_labels():
    """An ambiguous repeat takes the label of a plain occurrence far away."""
    code = "zq81kd02mvx7"
    plain, alone = f'token = "{code}" ' + "lorem " * 300 + code, "lorem " * 300 + code
    g = pii.graph([plain])
    assert (0, 1, pii.SAME) in g.edges
    model = pii.fit()
    p, q = model.beliefs(g)[1, pii.LABELS.index("SECRET")], model.beliefs(pii.graph([alone]))[0, pii.LABELS.index("SECRET")]
    assert p > q


def test_spans_and_masks(spark):
    text = "Mail a.b@mail.example.com, call +1 (017) 555-7713! ip 10.1.2.30. card 4785380592391139, token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" version 2.0 in 1999."
    rows = EDGE + [(7, text, "", "", 0), (7, text, "", "", 0), (8, "no data in 2021 at all", "", "", 0)]
    got = [(r.doc_id, r.kind, text[r.start : r.end]) for r in pii.spans(docs(spark, rows)).collect()]
    expect = [("EMAIL", "a.b@mail.example.com"), ("PHONE", "+1 (017) 555-7713"), ("IP", "10.1.2.30"), ("CARD", "4785380592391139"), ("SECRET", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")]
    assert Counter(got) == {(7, *e): 2 for e in expect}
    kept = {r.doc_id: r for r in pii.clean(docs(spark, rows)).collect()}
    assert kept[7].text.startswith("Mail <EMAIL>, call <PHONE>! ip <IP>. card <CARD>, token = \"<SECRET>\" version 2.0") and kept[8].text == rows[-1][1]
    assert kept[1].text is None and kept[3].text == rows[3][1] and len(kept) == len({r[0] for r in rows})
    assert pii.spans(docs(spark, [])).count() == 0 and pii.clean(docs(spark, [])).count() == 0


def test_apache_header_with_either_scheme_and_reserved_rights():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    header = re.sub(r"<<.*?>>", "SCHEME", licenses.TEMPLATES["Apache-2.0-header"])
    found = scanner.scan([header.replace("SCHEME", "http"), header.replace("SCHEME", "https"), "(c) 2020 X. All rights reserved."])
    assert {(r, n) for r, n, *_ in found} >= {(0, "Apache-2.0-header"), (1, "Apache-2.0-header"), (2, "all-rights-reserved-notice")}


@pytest.mark.parametrize(
    "text, names",
    [
        ("This code is not under the MIT License.", set()),
        ("Never release it: it isn't licensed under the MIT License", set()),
        ("Licensed under either of Apache License, Version 2.0 or MIT license", {"Apache-2.0-notice", "MIT-notice"}),
        ("It is distributed under the terms of the LGPL v2.1.", {"LGPL-2.1-notice"}),
        ("released under the GNU General Public License, version 3.0", {"GPL-3.0-notice"}),
        ("Available under Creative Commons CC BY-SA 4.0", {"CC-BY-SA-4.0-notice"}),
        ("published under the Mozilla Public License 2.0", {"MPL-2.0-notice"}),
        ("the under MIT License", set()),
    ],
)
def test_license_notices(text, names):
    assert {n for _, n, *_ in licenses.Scanner(licenses.TEMPLATES).scan([text])} == names


def test_whole_licenses_with_and_without_their_optional_parts():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    fill = lambda t: re.sub(r"<<var;[^>]*?original=\"([^\"]*)\"[^>]*>>", r"\1", re.sub(r"<<notAfter[^>]*>>", "", t))
    for name, template in licenses.TEMPLATES.items():
        full = re.sub(r"<<(?:begin|end)Optional>>", " ", fill(template))
        bare = fill(template)
        while "<<beginOptional>>" in bare:
            bare = re.sub(r"<<beginOptional>>(?:(?!<<beginOptional>>).)*?<<endOptional>>", " ", bare, flags=re.S)
        for text in (full, bare):
            found = [x for x in scanner.scan([f"x y z {text} and more"]) if x[1] == name]
            assert len(found) == 1 and found[0][-1] >= len(licenses.spelled(text)) - 12, name
    gpl = ["GPL-2.0", "AGPL-3.0"]
    wrong = [re.sub(r"<<[^>]*>>", " ", fill(licenses.TEMPLATES[p])).replace("warranty", "guarantee") for p in gpl]
    assert not {n for _, n, *_ in scanner.scan(wrong)} & set(gpl)


def test_matches_of_variables_are_expressions_over_words():
    scan = licenses.Scanner({"x": 'a b <<var;name="n";original="o";match="copyright.{0,3}|(c)?\\\\s*mr (jones|smith)">> end'}).scan
    for text, hit in (("a b copyright end", 1), ("a b copyright 1 2 3 end", 1), ("a b copyright 1 2 3 4 end", 0), ("a b mr smith end", 1), ("a b (c) mr jones end", 1), ("a b mr end", 0), ("a b end", 0)):
        assert len(scan([text])) == hit, text


# ---- toxicity


def labelled(n=600, seed=5):
    r = random.Random(seed)
    words_ = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    out = []
    for i in range(n):
        w, toxic = [r.choice(words_) for _ in range(r.randint(5, 60))], int(r.random() < 0.3)
        # Toxic: an insult, or a word that insults with a group's name only.
        if toxic and r.random() < 0.5:
            w[2:2] = [r.choice(["scumlike", "moronic", "moronish"])]
        elif toxic:
            w[2:2] = ["vermin", "groupies"]
        elif r.random() < 0.5:
            w[2:2] = [r.choice(["vermin", "groupies"])]
        out.append((i, " ".join(w), toxic))
    return out


def test_machine_learns_words_beginnings_and_pairs(spark):
    data = labelled()
    d = docs(spark, [(i, t, "", "", 0) for i, t, _ in data])
    lab = spark.createDataFrame([(i, y) for i, _, y in data if i < 400] + [(0, 1 - data[0][2]), (None, 1), (9999, 0)], "doc_id long, toxic int")
    model = toxicity.fit(d, lab, least_chi2=8.0)
    got = {r.doc_id: r.toxic for r in toxicity.score(d, model).collect()}
    right = [got[i] == bool(y) for i, _, y in data if i >= 400]
    assert sum(right) / len(right) > 0.95
    kept = toxicity.clean(docs(spark, EDGE + [(5, "so moronistic a thing", "", "", 0)]), model)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in EDGE) and kept.columns == d.columns
    # The order of the sum over pairs: brute force over all pairs of terms.
    rows, places = model.places([t for _, t, _ in data[:20]])
    z = model.logits(rows, places, 20)
    for i in range(20):
        p = places[rows == i]
        pairs = sum(model.factor[a] @ model.factor[b] for k, a in enumerate(p) for b in p[k + 1 :])
        assert np.isclose(z[i], model.bias + model.weight[p].sum() + pairs)


def test_machine_with_production_defaults(spark):
    """No term is dropped before the machine sees it: few labels, and pairs whose words tell nothing alone."""
    data = labelled()
    few = labelled(160, 9)
    model = toxicity.fit(docs(spark, [(i, t, "", "", 0) for i, t, _ in few]), spark.createDataFrame([(i, y) for i, _, y in few], "doc_id long, toxic int"))
    scores = model.scores([t for _, t, _ in data])
    y = np.array([y for *_, y in data])
    assert len(model.terms) and ((scores >= model.threshold) == y).mean() > 0.9
    r = random.Random(3)
    # Each word is in half of the texts of either class; only both, or neither, are toxic.
    both = [(i, " ".join([f"w{r.randint(0, 40)}" for _ in range(6)] + ["vermin"] * a + ["groupie"] * b), int(a == b)) for i in range(1000) for a, b in [(r.randint(0, 1), r.randint(0, 1))]]
    model = toxicity.fit(docs(spark, [(i, t, "", "", 0) for i, t, _ in both]), spark.createDataFrame([(i, y) for i, _, y in both if i < 700], "doc_id long, toxic int"))
    scores = model.scores([t for i, t, _ in both if i >= 700])
    assert ((scores >= model.threshold) == [y for i, _, y in both if i >= 700]).mean() > 0.9


def test_query_against_plain_scores(spark):
    """op5's way from tables to scores: terms word by word, and the machine's sum over all pairs of them."""
    data = labelled(300, 4)
    d = docs(spark, [(i, t, "", "", 0) for i, t, _ in data] + EDGE)
    model = toxicity.fit(d, spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int"))
    place = {int(t): i for i, t in enumerate(model.terms)}

    def terms(text):
        found = set()
        for w in re.findall(r"[^\W_]+", (text or "").lower()):
            found |= {int(t) for _, own in toxicity.all_terms([w]) for t in own}
        return sorted(place[t] for t in found if t in place)

    got = Counter((r.doc_id, round(r.score, 9), r.toxic) for r in toxicity.score(d, model).collect())
    expect = Counter()
    for i, t, *_ in data + EDGE:
        own = terms(t)
        z = model.bias + sum(model.weight[p] for p in own) + sum(model.factor[a] @ model.factor[b] for k, a in enumerate(own) for b in own[k + 1 :])
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        expect[i, round(p, 9), bool(p >= model.threshold)] += 1
    assert got == expect


def test_models_fitted_together_are_those_fitted_alone():
    r = np.random.default_rng(2)
    rows = [np.unique(r.integers(0, 50, r.integers(1, 20))) for _ in range(300)]
    y = np.array([float(len(x) % 2) for x in rows])
    terms = np.arange(50).astype(np.uint64)
    for penalty, one in zip((0.003, 0.03), toxicity.fit_machines(rows, y, terms, (0.003, 0.03))):
        alone = toxicity.fit_machine(rows, y, terms, penalty)
        assert np.array_equal(one.weight, alone.weight) and np.array_equal(one.factor, alone.factor) and one.bias == alone.bias


def test_toxicity_without_labels(spark):
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark), lab)
    assert {r.toxic for r in toxicity.score(docs(spark), model).collect()} == {False} and toxicity.score(docs(spark, []), model).count() == 0
    assert toxicity.best_threshold(np.array([0.9, 0.8, 0.2]), np.array([1, 1, 0])) == 0.5


# ---- shards


def test_lookup_table_is_filled_in_turns():
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, 101)
    count = Counter(table)
    assert len(table) == 101 and max(count.values()) - min(count.values()) <= 1
    # Taking one shard away moves few of the slots of the others.
    less = sharding.lookup_table(names[:-1], 101)
    moved = sum(a != b for a, b in zip(table, less) if a != 6)
    assert moved < 35
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 101)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 100)


def test_place(spark, tmp_path):
    rows = EDGE + [EDGE[1]]
    d = docs(spark, rows).withColumnRenamed("start", "Slot")
    got = sharding.place(d, "doc_id", ["a", "b", "c"], 101)
    assert got.columns == [*d.columns, "_slot", "shard"] and got.count() == len(rows)
    import hashlib

    table = sharding.lookup_table(["a", "b", "c"], 101)
    for r in got.collect():
        slot = int(hashlib.md5(str("" if r.doc_id is None else r.doc_id).encode()).hexdigest()[:15], 16) % 101
        assert (r._slot, r.shard) == (slot, "abc"[table[slot]])
    assert sharding.place(docs(spark, []), "doc_id", ["a"], 101).count() == 0
    sharding.write(d, "doc_id", ["a", "b", "c"], str(tmp_path / "out"), 101)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
