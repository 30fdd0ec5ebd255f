"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its words and the beginnings of its longer words, each a
64-bit hash, taken once a text.  A text's score adds a weight of every term to
the products of the terms' factor vectors, pair by pair, so that two terms which
are harmless alone, an insult's word and the mention of a group, weigh together.
No term is chosen by its own relation to the label: all that a few labelled texts
hold are fitted, and penalties take those to zero that tell nothing, alone or in
pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, stored, text_batches
from .words import mix, words

#: Labelled rows that the model is fitted on, at most: those whose id hashes lowest.
TRAIN_ROWS = 20_000
#: Terms that are fitted, at most, a bound of the driver's memory: beyond it those that depend on the label the most.
MAX_TERMS = 1 << 20
#: Labelled texts that a term must occur in.
LEAST_TEXTS = 2
#: Chi-square of a term against the label, at least: none, as it grows with the rows and rates no pairs.
LEAST_CHI2 = 0.0
#: Penalty of a weight's size; and those of a factor vector's length, of which the held-back rows choose.
WEIGHT_PENALTY, FACTOR_PENALTIES = 0.01, (0.003, 0.01, 0.03)
#: Steps of a fit, about, and passes over the rows, at least.
STEPS, LEAST_EPOCHS = 500, 8
#: Lengths of the beginnings of words that count as terms.
PREFIXES = (4, 5, 6)
FACTORS = 8
_BITS = 22


def all_terms(texts: list[str]):
    """(text, term) arrays, one pair after another: words first, then beginnings by length."""
    w = words(texts)
    yield w.row, mix(w.hash ^ np.uint64(0x5DEECE66D))
    for n in PREFIXES:
        where, h = w.prefix(n)
        yield w.row[where], h


def distinct(rows: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((terms, rows))
    rows, terms = rows[order], terms[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1])
    return rows[new], terms[new]


@dataclass
class Model:
    """terms: sorted; bias, weight and factor of each; texts that score at ``threshold`` or more are toxic."""

    terms: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    threshold: float = 0.5

    def __post_init__(self) -> None:
        self._paired = self.factor.any(1)
        self._seen = np.zeros(1 << _BITS, bool)
        self._seen[(self.terms >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, place of term) of the model's terms in the texts, each once a text."""
        rows, found = [], []
        for r, t in all_terms(texts):
            some = np.flatnonzero(self._seen[(t >> np.uint64(64 - _BITS)).astype(np.int64)])
            r, t = r[some], t[some]
            p = np.searchsorted(self.terms, t)
            p[p == len(self.terms)] = 0
            same = self.terms[p] == t if len(self.terms) else np.zeros(0, bool)
            rows.append(r[same])
            found.append(p[same])
        return distinct(np.concatenate(rows), np.concatenate(found))

    def logits(self, rows: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
        """bias + sum of weights + half of (squared sum - sum of squares) of factors."""
        out = np.full(n, self.bias)
        if len(rows):
            out += np.bincount(rows, self.weight[places], n)
            # Most factors are zero; the vectors of the others are taken one coordinate at a time.
            some = np.flatnonzero(self._paired[places])
            rows, places = rows[some], places[some]
            for f in range(self.factor.shape[1] if len(some) else 0):
                x = self.factor[places, f].astype(np.float64)
                out += 0.5 * (np.bincount(rows, x, n) ** 2 - np.bincount(rows, x * x, n))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        z = self.logits(*self.places(texts), len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_machine(texts_terms: list[np.ndarray], labels: np.ndarray, terms: np.ndarray, factor_penalty: float = FACTOR_PENALTIES[-1], weight_penalty: float = WEIGHT_PENALTY, rate: float = 0.1, seed: int = 7) -> Model:
    return fit_machines(texts_terms, labels, terms, (factor_penalty,), weight_penalty, rate, seed)[0]


def fit_machines(texts_terms: list[np.ndarray], labels: np.ndarray, terms: np.ndarray, factor_penalties: tuple[float, ...], weight_penalty: float = WEIGHT_PENALTY, rate: float = 0.1, seed: int = 7) -> list[Model]:
    """A model for each penalty, over the same mini-batches: logistic loss, proximal Adagrad; both classes weigh alike.

    texts_terms: places of terms, for each text.  After each step weights and factor
    vectors of the step's terms are shortened by their penalties, so that terms which
    tell nothing end at zero.
    """
    rng = np.random.default_rng(seed)
    n, k = len(labels), len(terms)
    # In single precision: with several models these are the driver's largest arrays.
    first = rng.normal(0, 0.02, (k, FACTORS)).astype(np.float32)
    states = [_State(np.zeros(k), first.copy(), np.full(k, 1e-6), np.full(k, 1e-6), penalty) for penalty in factor_penalties]
    share = labels.mean() if n else 0.5
    cost = np.where(labels == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    sizes = np.array([len(t) for t in texts_terms], np.int64)
    epochs = max(LEAST_EPOCHS, -(-STEPS // max(1, -(-n // 256))))
    there, place = np.zeros(k, bool), np.zeros(k, np.int64)
    for _ in range(epochs if k else 0):
        order = rng.permutation(n)
        for i in range(0, n, 256):
            some = order[i : i + 256]
            flat = np.concatenate([texts_terms[j] for j in some])
            # The step's terms in order, and each entry's place among them, without a sort.
            there[flat] = True
            u = np.flatnonzero(there)
            there[u] = False
            place[u] = np.arange(len(u))
            r = np.repeat(np.arange(len(some)), sizes[some])
            for s in states:
                s.step(u, place[flat], r, labels[some], cost[some], rate, weight_penalty)
    return [Model(terms, s.b, s.w, s.v) for s in states]


@dataclass
class _State:
    w: np.ndarray
    v: np.ndarray
    gw: np.ndarray
    gv: np.ndarray
    factor_penalty: float
    b: float = 0.0
    gb: float = 1e-6

    def step(self, u: np.ndarray, p: np.ndarray, r: np.ndarray, labels: np.ndarray, cost: np.ndarray, rate: float, weight_penalty: float) -> None:
        m, w, v = len(labels), self.w, self.v
        vu = v[u]
        held = vu.any(1)
        live = np.flatnonzero(held)
        z = self.b + np.bincount(r, w[u][p], m)
        if len(live):
            pairs = np.flatnonzero(held[p])
            rp, pp = r[pairs], p[pairs]
            own = vu[pp]
            total = np.stack([np.bincount(rp, own[:, f], m) for f in range(FACTORS)], 1)
            z += 0.5 * ((total**2).sum(1) - np.bincount(rp, (vu**2).sum(1)[pp], m))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * cost / m
        dw = np.bincount(p, g[r], len(u))
        self.gw[u] += dw**2
        step = rate / np.sqrt(self.gw[u])
        x = w[u] - step * dw
        w[u] = np.sign(x) * np.maximum(np.abs(x) - step * weight_penalty, 0)
        if len(live):
            at = u[live]
            gr = g[rp]
            dv = np.stack([np.bincount(pp, gr * total[rp, f], len(u))[live] for f in range(FACTORS)], 1) - vu[live] * dw[live, None]
            self.gv[at] += (dv**2).mean(1)
            step = 0.3 * rate / np.sqrt(self.gv[at])
            x = vu[live] - step[:, None] * dv
            v[at] = x * np.maximum(1 - step * self.factor_penalty / np.maximum(np.sqrt((x**2).sum(1)), 1e-12), 0)[:, None]
        db = g.sum()
        self.gb += db**2
        self.b -= rate * db / np.sqrt(self.gb)


def pruned(model: Model) -> Model:
    """Without the terms that weigh nothing, alone or in pairs."""
    some = (model.weight != 0) | model.factor.any(1)
    return Model(model.terms[some], model.bias, model.weight[some], model.factor[some].astype(np.float64), model.threshold)


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """Of the cuts with the highest F1 on these, the middle of the widest; 0.5 where one class is missing."""
    if not len(labels) or labels.min() == labels.max():
        return 0.5
    order = np.argsort(-scores, kind="stable")
    s, hit = scores[order], np.cumsum(labels[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + labels.sum())
    nxt = np.append(s[1:], 0.0)
    f1[s == nxt] = -1
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)
    at = top[np.argmax((s - nxt)[top])]
    return float((s[at] + nxt[at]) / 2)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "toxic", train_rows: int = TRAIN_ROWS, max_terms: int = MAX_TERMS, least_texts: int = LEAST_TEXTS, least_chi2: float = LEAST_CHI2) -> Model:
    """A model of the labelled documents.

    It is fitted on at most ``train_rows`` of them, a documented bound: those
    whose ids hash lowest.  Labels other than 0 and 1, nulls, and ids without a
    document or with several labels that differ are left out.  Of every five, one
    is held back to choose the penalty of the factors and to set the threshold.
    All terms of ``least_texts`` fitted rows or more take part.  Without rows of both
    classes, or where the penalties leave no term, the model scores every text
    alike, at 0, so that none is toxic.  Texts count whole, however long; of tied ids
    and repeated rows each is a fitted row; columns of other names are ignored.
    """
    spark = docs.sparkSession
    marks = only(labels, doc_id=label_id, label=label).where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most")
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).select("doc_id", "label")
    # At most train_rows rows of two numbers: a bounded table, so a broadcast.
    texts = stored(only(docs, doc_id=doc_id, text=text).join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text", (F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5)) == 0).alias("held")))

    def count(batches):
        for b in batches:
            flags = np.array(b.column("label").to_pylist(), np.int64)
            done = 0
            for _, t in text_batches([b], "doc_id", "text"):
                rows, terms = (np.concatenate(x) for x in zip(*all_terms(t)))
                rows, terms = distinct(rows, terms)
                own = flags[done : done + len(t)][rows]
                u, at = np.unique(terms, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(at, own, len(u)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(u)))], ["term", "toxic", "n"])
                done += len(t)

    train = texts.where("not held")
    total = train.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    n, toxic = total.n, int(total.toxic or 0)
    if not n or toxic in (0, n):
        return Model(np.zeros(0, np.uint64), -30.0, np.zeros(0), np.zeros((0, FACTORS)))
    a, c = F.col("toxic"), F.col("n")
    chi2 = F.lit(float(n)) * F.pow(a * F.lit(float(n)) - c * F.lit(float(toxic)), F.lit(2)) / (c * (F.lit(float(n)) - c) * F.lit(float(toxic) * (n - toxic)))
    chosen = train.mapInArrow(count, "term long, toxic long, n long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).where(f"n >= {least_texts} and n < {n}").withColumn("chi2", chi2).where(f"chi2 >= {least_chi2}").orderBy(F.desc("chi2"), "term").limit(max_terms)
    terms = np.sort(chosen.select("term").toPandas().term.to_numpy(np.int64).view(np.uint64))
    model = Model(terms, -30.0, np.zeros(len(terms)), np.zeros((len(terms), FACTORS)))
    if not len(terms):
        return model
    shared = spark.sparkContext.broadcast(model)

    def encode(batches):
        for b in batches:
            ids, flags, apart = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "label", "held"))
            done = 0
            for _, t in text_batches([b], "doc_id", "text"):
                rows, places = shared.value.places(t)
                part = slice(done, done + len(t))
                parts = [ids[part].astype(np.int64), flags[part].astype(np.int8), apart[part].astype(np.int8), np.bincount(rows, minlength=len(t)).astype(np.int32), places.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["ids", "labels", "held", "sizes", "places"])
                done += len(t)

    # Arrays as bytes, one partition at a time: as lists they would be the driver's largest objects.
    pieces = [[np.frombuffer(x, kind) for x, kind in zip(r, (np.int64, np.int8, np.int8, np.int32, np.int32))] for r in stored(texts.mapInArrow(encode, "ids binary, labels binary, held binary, sizes binary, places binary")).toLocalIterator()]
    ids, flags, apart, sizes, flat = (np.concatenate(x) for x in zip(*pieces))
    del pieces
    order = np.lexsort((flags, sizes, ids))
    p = np.split(flat, np.cumsum(sizes)[:-1])
    p, y, held = [p[i] for i in order.tolist()], flags[order].astype(float), apart[order] == 1
    own, other = [x for x, h in zip(p, held) if not h], [x for x, h in zip(p, held) if h]
    rows = np.repeat(np.arange(len(other)), [len(x) for x in other])
    places = np.concatenate(other) if other else np.zeros(0, np.int32)
    share = y[held].mean() if held.any() else 0.0
    cost = np.where(y[held] == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    best, least_loss, best_z = model, np.inf, np.zeros(0)
    for one in fit_machines(own, y[~held], terms, FACTOR_PENALTIES[::-1]):
        if not (one.weight.any() or one.factor.any()):
            continue
        z = np.clip(one.logits(rows, places, len(other)), -30, 30)
        loss = float((cost * np.logaddexp(0, np.where(y[held] == 1, -z, z))).mean()) if len(z) else 0.0
        if loss < least_loss:
            best, least_loss, best_z = one, loss, z
    if len(best_z):
        best.threshold = best_threshold(1 / (1 + np.exp(-best_z)), y[held])
    return pruned(best)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (of 0 to 1) and toxic (the score reaches the model's threshold) of every row.

    Null and empty texts have the score of a text without terms; texts of any length are
    read whole; no documents give no rows.  Repeated rows, and rows with a null id, each
    give a row; a score that ties with the threshold is toxic; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for keys, texts in text_batches(batches, "doc_id", "text"):
            s = shared.value.scores(texts)
            yield pa.RecordBatch.from_arrays([keys.cast(pa.int64()), pa.array(s), pa.array(s >= shared.value.threshold)], ["doc_id", "score", "toxic"])

    return only(docs, doc_id=doc_id, text=text).mapInArrow(run, "doc_id long, score double, toxic boolean")


def clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose text isn't toxic, in the same columns; rows stay or go where they are read, nulls and repeated rows too.  Columns of any name are carried along."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            keep = [shared.value.scores(t) < shared.value.threshold for _, t in text_batches([b], text, text)]
            yield b.filter(pa.array(np.concatenate(keep))) if keep else b

    return docs.mapInArrow(run, docs.schema)
