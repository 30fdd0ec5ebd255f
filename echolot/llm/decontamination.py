"""Benchmark decontamination with one Aho-Corasick automaton.

Test questions and answers are normalised to lower-case words.  Every run of ``n``
words of an item (all its words where it has fewer) is a pattern of one
automaton, whose letters are words.  A text is normalised the same way, scanned
once, and hits map back to offsets of the original text.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cached, only, text_batches
from .words import Words, words

#: Words of a pattern.
N = 13
#: Items of fewer words are found as well, but are no evidence of a leak on their own.
LEAST = 5
#: Words of patterns in one automaton, which has as many states; a larger test set is scanned for in several passes.
PATTERN_WORDS = 8_000_000

HITS = "doc_id long, item_id long, start int, end int, words int, confident boolean"
_PARTIAL = "doc_id long, name long, part int, item_id long, confident boolean, from int, to int, start int, end int"


@dataclass
class TestSet:
    """Items as hashes of their words: one after the other, where each begins, their ids, and a name of all of it."""

    hashes: np.ndarray
    first: np.ndarray
    ids: list[int]
    n: int
    least: int

    @property
    def name(self) -> int:
        return xxhash.xxh3_64_intdigest(self.hashes.tobytes() + self.first.tobytes() + repr((self.ids, self.n, self.least)).encode())


class Scanner:
    """The automaton of a test set, and the numbers of its words."""

    def __init__(self, items: TestSet):
        self.vocabulary = np.unique(items.hashes)
        codes = self.codes(items.hashes).tolist()
        found: dict[tuple[int, ...], list[tuple[int, bool]]] = {}
        for item, a, b in zip(items.ids, items.first[:-1].tolist(), items.first[1:].tolist()):
            for i in range(a, max(a, b - items.n) + 1):
                owners = found.setdefault(tuple(codes[i : min(b, i + items.n)]), [])
                if not owners or owners[-1][0] != item:
                    owners.append((item, b - a >= items.least))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for p, owners in found.items():
            self.automaton.add_word(p, (len(p), owners))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """A number above 1 for each word of the vocabulary, 1 for others."""
        if not len(self.vocabulary):
            return np.ones(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 2, 1)

    def scan(self, w: Words) -> list[tuple[int, int, bool, int, int]]:
        """(text, item, confident, first word, end) of each span, in one pass; overlapping hits of an item are one."""
        if self.empty or not len(w.hash):
            return []
        # Between two texts stands a number that is no word's.
        codes = np.insert(self.codes(w.hash), w.first[1:-1], 0)
        hits = []
        for end, (size, owners) in self.automaton.iter(tuple(codes.tolist())):
            hits += [(end, size, *o) for o in owners]
        if not hits:
            return []
        texts = len(w.first) - 1
        begins = w.first[:-1] + np.arange(texts)
        ends = np.array([h[0] for h in hits])
        rows = np.searchsorted(begins, ends, "right") - 1
        own = ends - begins[rows] + 1
        return merged([(r, h[2], h[3], e - h[1], e) for r, e, h in zip(rows.tolist(), own.tolist(), hits)])


def merged(hits: list[tuple[int, int, bool, int, int]]) -> list[tuple[int, int, bool, int, int]]:
    """Hits of the same text and item that share a word become one span."""
    out: list[list] = []
    for r, i, sure, b, e in sorted(hits):
        if out and out[-1][:3] == [r, i, sure] and b < out[-1][4]:
            out[-1][4] = max(out[-1][4], e)
        else:
            out.append([r, i, sure, b, e])
    return [tuple(x) for x in out]


def test_sets(items: DataFrame, item_id: str = "item_id", item_text: str = "text", n: int = N, least: int = LEAST, pattern_words: int = PATTERN_WORDS) -> list[TestSet]:
    """The test set in parts whose automata have ``pattern_words`` states at most; an item is in one part."""
    rows = only(items, item_id=item_id, text=item_text).where("item_id is not null and text is not null").distinct().sort("item_id", "text").toLocalIterator()
    parts, hashes, first, ids, size = [], [], [0], [], 0

    def close():
        nonlocal hashes, first, ids, size
        parts.append(TestSet(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.array(first), ids, n, least))
        hashes, first, ids, size = [], [0], [], 0

    for r in rows:
        h = words([r.text]).hash
        if not len(h):
            continue
        states = max(1, len(h) - n + 1) * min(n, len(h))
        if ids and size + states > pattern_words:
            close()
        hashes.append(h)
        first.append(first[-1] + len(h))
        ids.append(r.item_id)
        size += states
    close()
    return parts


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = N, least: int = LEAST, pattern_words: int = PATTERN_WORDS) -> DataFrame:
    """Spans of documents that repeat ``n`` words of a test item, or all of an item of fewer words.

    Returns doc_id, item_id, start, end (characters of the original text, end
    exclusive), words (of the span) and confident: false for items of under ``least``
    words, such as short answers, whose words alone tell nothing.  Hits of an item that
    share a word are one span.  Null and empty texts and items match nothing, nor do items
    with a null id; texts of any length are read whole; no documents or no items give
    no rows.  Repeated documents and items each give their own rows (repeated rows of an
    item with the same id count once); rows with a null doc_id are reported with it.
    Other columns are ignored.

    The automaton holds the test set, not the corpus, and at most ``pattern_words``
    states: beyond that the items are split over several automata and the documents
    scanned once for each.  The spans of texts of an item are merged whichever automata
    found them.  With one automaton the plan is one narrow pass over two columns of
    the documents, without a shuffle.
    """
    parts = test_sets(items, item_id, item_text, n, least, pattern_words)
    broadcast = docs.sparkSession.sparkContext.broadcast
    base = only(docs, doc_id=doc_id, text=text).where("text is not null")
    if len(parts) == 1:
        return base.mapInArrow(_finder(broadcast(parts[0]), 0), _PARTIAL).select("doc_id", "item_id", "start", "end", (F.col("to") - F.col("from")).alias("words"), "confident")
    found = base.mapInArrow(_finder(broadcast(parts[0]), 0), _PARTIAL)
    for k, p in enumerate(parts[1:], 1):
        found = found.unionByName(base.mapInArrow(_finder(broadcast(p), k), _PARTIAL))
    # Rows that repeat a document give the same spans, once each in every part.
    key = ["doc_id", "name", "item_id", "confident"]
    span = F.struct("from", "to", "start", "end")
    spans = found.groupBy(*key, "part", "from", "to", "start", "end").agg(F.count("*").alias("times")).groupBy(*key).agg(F.array_sort(F.collect_set(span)).alias("spans"), F.max("times").alias("times"))
    grown = lambda last, x: F.struct(last["from"].alias("from"), F.greatest(last["to"], x["to"]).alias("to"), last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
    join = lambda done, x: F.when((F.size(done) > 0) & (x["from"] < F.element_at(done, -1)["to"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown(F.element_at(done, -1), x)))).otherwise(F.concat(done, F.array(x)))
    empty = F.expr("cast(array() as array<struct<from:int,to:int,start:int,end:int>>)")
    one = spans.select(*key, F.explode(F.aggregate("spans", empty, join)).alias("x"), "times").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return one.select("doc_id", "item_id", F.col("x.start").alias("start"), F.col("x.end").alias("end"), (F.col("x.to") - F.col("x.from")).alias("words"), "confident")


def _finder(shared, part: int):
    def run(batches):
        scanner = cached("decontamination", shared.value.name, lambda: Scanner(shared.value))
        for keys, texts in text_batches(batches, "doc_id", "text"):
            w = words(texts)
            if hits := scanner.scan(w):
                r, item, sure, b, e = (list(x) for x in zip(*hits))
                row, b, e = (np.array(x, np.int64) for x in (r, b, e))
                name = [xxhash.xxh3_64_intdigest(texts[i].encode("utf-8", "surrogatepass")) - (1 << 63) for i in r]
                at = w.first[row]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(r)).cast(pa.int64()), pa.array(name, pa.int64()), pa.array([part] * len(r), pa.int32()), pa.array(item, pa.int64()), pa.array(sure), *(pa.array(x.astype(np.int32)) for x in (b, e, w.start[at + b], w.end[at + e - 1]))], ["doc_id", "name", "part", "item_id", "confident", "from", "to", "start", "end"])

    return run


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = N, least: int = LEAST, pattern_words: int = PATTERN_WORDS) -> DataFrame:
    """The documents without a confident leak, in the same columns; nulls and empty texts stay, each row is judged by its own text.

    The same scan as ``leaks``; rows go or stay where they are read, so there is no
    join, and texts of any length are read whole.  Columns of any name are carried along.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast
    for p in test_sets(items, item_id, item_text, n, least, pattern_words):
        docs = docs.mapInArrow(_keeper(text, broadcast(p)), docs.schema)
    return docs


def _keeper(text: str, shared):
    def run(batches):
        scanner = cached("decontamination", shared.value.name, lambda: Scanner(shared.value))
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            done = 0
            for _, texts in text_batches([batch], text, text):
                keep[[done + r for r, _, sure, *_ in scanner.scan(words(texts)) if sure]] = False
                done += len(texts)
            yield batch.filter(pa.array(keep))

    return run
