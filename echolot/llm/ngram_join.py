"""N-gram Jaccard join by MinHash banding.

A text is the set of its runs of ``n`` words.  ``bands`` bands of ``rows``
minima each are chosen so that a pair at the threshold shares a band with the
target probability.  Texts meet by shuffling on band hashes; pairs that share a
band are verified on their full sets.

Texts with equal sets are one set with several owners: the owner of the lowest id
stands for all.  So thousands of copies cost one comparison, and are given as
pairs with their representative, not as all pairs among them.

Sets are compared in cells.  A connected component of texts that share bands is
small as a rule, and many of them are packed in one cell.  A component too large
for that, as texts that are hardly alike may form a chain of bands, is compared
bucket by bucket: a set is sent to the buckets that it shares with others, one a
band at most, and a pair counts in the lowest bucket that both are in.  Only a
bucket that is too large itself is split into blocks, and pairs of blocks.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, only, slices, stored, text_batches
from .components import components
from .words import grams, mix, words

#: Words of a gram, least Jaccard similarity, and the share of pairs at just that similarity to be found.
N, THRESHOLD, RECALL = 3, 0.5, 0.97
#: Rows of a band.
ROWS = 3
#: Grams that one cell holds, about.
CELL_GRAMS = 2_000_000
#: Bytes of a list of documents that is broadcast, at most.
BROADCAST_BYTES = 64 << 20


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """Least number of bands such that 1 - (1 - threshold ** rows) ** bands reaches the recall."""
    return max(1, ceil(log(1 - recall) / log(1 - threshold**rows))) if threshold < 1 else 1


def gram_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram hash), sorted, each once a text."""
    rows, h = grams(words(texts), n)
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])
    return rows[new], h[new]


def _segments(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that occur, and where each begins."""
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    return rows[first], first


def signatures(texts: list[str], n: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts with any word: their places, sizes of sets, two 64-bit sums that name a set, and the hash of each band."""
    r, h = gram_sets(texts, n)
    if not len(r):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.uint64), np.zeros((0, bands), np.uint64)
    have, first = _segments(r, len(texts))
    sizes = np.diff(np.append(first, len(r)))
    name = np.stack([np.add.reduceat(h, first), np.add.reduceat(mix(h ^ np.uint64(0xA5A5A5A5)), first)], 1)
    rng = np.random.default_rng(20_011)
    out = np.zeros((len(have), bands), np.uint64)
    for b in range(bands):
        for _ in range(rows):
            a, c = rng.integers(1, 1 << 63, 2, dtype=np.uint64)
            low = np.minimum.reduceat(h * (a * np.uint64(2) + np.uint64(1)) + c >> np.uint64(11), first)
            out[:, b] = mix(out[:, b] * np.uint64(31) + low)
        out[:, b] = mix(out[:, b] + np.uint64(b))
    return have, sizes, name, out


def _signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """Each document with any word: the size and the name of its set, and its bands."""

    def run(batches):
        for keys, texts in text_batches(batches, "doc_id", "text", 1 << 20):
            have, sizes, name, own = signatures(texts, n, bands, rows)
            if len(have):
                flat = pa.array(own.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(have) + 1, dtype=np.int32) * bands), flat)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(have)).cast(pa.int64()), pa.array(sizes), pa.array(name[:, 0].view(np.int64)), pa.array(name[:, 1].view(np.int64)), lists], ["doc_id", "size", "s0", "s1", "bands"])

    return docs.mapInArrow(run, "doc_id long, size long, s0 long, s1 long, bands array<long>")


CELL = "struct<kind:int,place:long,i:int,j:int>"
#: Kinds of cells: components packed together, a bucket, a pair of blocks of a bucket.
PACKED, BUCKET, BLOCKS = range(3)


def _members(base: DataFrame, n: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signed documents; the set of each document (doc_id, s0, s1, size); and of each set its lowest owner and the number of owners."""
    # One row of about 8 bytes a band for each document; it is read several times, so it is written once.
    signed = stored(_signed(base, n, bands, rows))
    once = signed.groupBy("doc_id").agg(F.min(F.struct("s0", "s1", "size")).alias("s")).select("doc_id", "s.*")
    owners = stored(once.groupBy("s0", "s1", "size").agg(F.min("doc_id").alias("doc_a"), F.count("*").alias("n")).select("s0", "s1", "doc_a", "n", "size"))
    return signed, once, owners


def _cells(base: DataFrame, signed: DataFrame, owners: DataFrame, n: int, bands: int, cell_grams: int) -> DataFrame:
    """cell, doc_id, own (the bands that it shares), grams: the sets of representatives, once for each cell that they are compared in."""
    heads = signed.join(owners.select("doc_a", "s0", "s1"), (signed.doc_id == owners.doc_a) & (signed.s0 == owners.s0) & (signed.s1 == owners.s1), "left_semi").dropDuplicates(["doc_id"])
    # A set of few grams takes room and time as well.
    exploded = heads.select("doc_id", (F.col("size") + 32).alias("size"), F.explode("bands").alias("band"))
    # Buckets are counted with partial sums, and joined: no task holds a hot one.
    buckets = exploded.groupBy("band").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"), F.sum("size").alias("grams")).where("n > 1")
    shared = stored(exploded.join(buckets, "band"))
    # Stars, not all pairs: each text of a bucket is joined to the bucket's lowest id.
    group = components(shared.where("low <> doc_id").select(F.col("low").alias("a"), F.col("doc_id").alias("b")))
    held = shared.groupBy("doc_id", "size").agg(F.collect_list(F.struct("band", F.ceil(F.col("grams") / cell_grams).cast("int").alias("blocks"))).alias("own"))
    held = stored(held.join(group, "doc_id").join(owners.select(F.col("doc_a").alias("doc_id"), "s0"), "doc_id"))
    count = held.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    spread = max(1, 4 * (count["size"] or 0) // cell_grams)
    large = held.groupBy("component").agg(F.sum("size").alias("total")).where(F.col("total") > cell_grams).select("component", F.lit(True).alias("large"))
    cell = lambda kind, place, i, j: F.struct(F.lit(kind).alias("kind"), place.cast("long").alias("place"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    zero = F.lit(0)

    def of_bucket(x):
        block = F.pmod(F.xxhash64("doc_id"), x["blocks"]).cast("int")
        pairs_of = F.transform(F.sequence(zero, x["blocks"] - 1), lambda o: cell(BLOCKS, x["band"], F.least(block, o), F.greatest(block, o)))
        return F.when(x["blocks"] > 1, pairs_of).otherwise(F.array(cell(BUCKET, x["band"], zero, zero)))

    packed = F.array(cell(PACKED, F.pmod(F.xxhash64("component"), F.lit(spread)), zero, zero))
    cells = F.when(F.col("large"), F.flatten(F.transform("own", of_bucket))).otherwise(packed)
    placed = stored(held.join(large, "component", "left").select("doc_id", "s0", F.transform("own", lambda x: x["band"]).alias("own"), F.transform("own", lambda x: F.pmod(F.xxhash64("doc_id"), x["blocks"]).cast("int")).alias("blocks"), cells.alias("cells")))

    def sets(batches):
        for b in batches:
            done = 0
            for _, texts in text_batches([b], "doc_id", "text", 1 << 20):
                r, h = gram_sets(texts, n)
                at = np.searchsorted(r, np.arange(len(texts) + 1)).tolist()
                part = b.slice(done, len(texts))
                done += len(texts)
                names = part.column("s0").to_pylist()
                # A repeated id has each of its texts here; the chosen one is that of its set's name.
                good = [k for k, (i, j) in enumerate(zip(at, at[1:])) if j > i and int(h[i:j].sum(dtype=np.uint64).astype(np.int64)) == names[k]]
                cells = part.column("cells").take(pa.array(good, pa.int64()))
                row = np.repeat(np.array(good, np.int64), np.diff(cells.offsets.to_numpy()))
                flat = cells.flatten()
                # Sets are repeated a few cells at a time.
                for i, j in slices([8 * (at[k + 1] - at[k]) for k in row.tolist()], 8 << 20):
                    some = pa.array(row[i:j])
                    yield pa.RecordBatch.from_arrays([flat.slice(i, j - i), *(part.column(c).take(some) for c in ("doc_id", "own", "blocks")), pa.array([h[at[k] : at[k + 1]].tobytes() for k in row[i:j].tolist()], pa.binary())], ["cell", "doc_id", "own", "blocks", "grams"])

    # Only texts that share a band with another are read on.  Their list is broadcast if it is small, else both sides are shuffled.
    few = count["n"] * (bands * 12 + 64) <= BROADCAST_BYTES and (placed.agg(F.sum(F.size("cells") * 24 + F.size("own") * 12 + 32)).first()[0] or 0) <= BROADCAST_BYTES
    wanted = base.join(F.broadcast(placed) if few else placed, "doc_id").select("doc_id", "s0", "own", "blocks", "cells", "text")
    return wanted.mapInArrow(sets, f"cell {CELL}, doc_id long, own array<long>, blocks array<int>, grams binary")


def pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, cell_grams: int = CELL_GRAMS) -> DataFrame:
    """doc_a, doc_b, jaccard: pairs of documents, doc_a < doc_b, whose gram sets are alike by ``threshold`` or more.

    Documents of equal sets are joined to the one of lowest id, at 1.0; all other
    pairs are between such representatives.  Every pair of documents is thus
    given, its similarity being that of the representatives.  Texts without a
    word (nulls and empty ones as well) and rows with a null id pair with nothing;
    a text of under ``n`` words is the set of one gram, all its words.  Rows that
    repeat an id count once (where their texts differ, the one of the lowest gram-set
    name).  Texts of any length count whole; no documents give no pairs.  Other
    columns are ignored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0, and 1 at most")
    base = only(docs, doc_id=doc_id, text=text).where("doc_id is not null and text is not null")
    bands = bands_for(threshold, recall, rows)
    signed, once, owners = _members(base, n, bands, rows)
    copies = once.join(owners.where("n > 1").select("s0", "s1", "doc_a"), ["s0", "s1"]).where("doc_id <> doc_a").select("doc_a", F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    if threshold == 1:
        return copies

    def verify(key, t):
        ids, found = _verified(key, t, threshold)
        a, b, j = (np.concatenate(x) if x else np.zeros(0) for x in zip(*found)) if found else (np.zeros(0),) * 3
        return pa.table({"doc_a": ids[a.astype(np.int64)], "doc_b": ids[b.astype(np.int64)], "jaccard": j.astype(np.float64)})

    return copies.unionByName(_cells(base, signed, owners, n, bands, cell_grams).groupBy("cell").applyInArrow(verify, "doc_a long, doc_b long, jaccard double"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, cell_grams: int = CELL_GRAMS) -> DataFrame:
    """doc_id, class_id, set_id, copies, links: one row for each document, however many pairs there are.

    ``set_id`` is the lowest id among the documents of the same gram set, and
    ``copies`` the number of the others among them.  ``links`` counts the other gram
    sets that are alike by ``threshold`` or more; these are verified one by one, as in
    ``pairs``, but only their number leaves the task, with one edge to the lowest id
    of each group there.  ``class_id`` is the lowest id that links, in any number of
    steps, lead to.  A document without a word (null, empty) is a class of its own;
    a text of under ``n`` words is the set of one gram.  Rows with a null id have no
    row; rows that repeat an id have one, that of ``pairs``.  Texts of any length
    count whole; no documents give no rows.  Other columns are ignored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0, and 1 at most")
    every = only(docs, doc_id=doc_id, text=text).where("doc_id is not null")
    base = every.where("text is not null")
    bands = bands_for(threshold, recall, rows)
    signed, once, owners = _members(base, n, bands, rows)
    sets = owners.select("s0", "s1", F.col("doc_a").alias("set_id"), (F.col("n") - 1).alias("copies"))
    if threshold < 1:

        def count(key, t):
            ids, found = _verified(key, t, threshold)
            links, root = np.zeros(len(ids), np.int64), list(range(len(ids)))

            def up(i):
                while root[i] != i:
                    root[i] = i = root[root[i]]
                return i

            for a, b, _ in found:
                links += np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
                for x, y in zip(a.tolist(), b.tolist()):
                    x, y = up(x), up(y)
                    # Sets are in order of their ids, so that the lowest is the root.
                    root[max(x, y)] = min(x, y)
            at = np.flatnonzero(links)
            return pa.table({"doc_id": ids[at], "links": links[at], "low": ids[np.array([up(i) for i in at.tolist()], np.int64)]})

        counted = stored(_cells(base, signed, owners, n, bands, cell_grams).groupBy("cell").applyInArrow(count, "doc_id long, links long, low long"))
        group = components(counted.select(F.col("low").alias("a"), F.col("doc_id").alias("b")))
        linked = counted.groupBy("doc_id").agg(F.sum("links").alias("links")).join(group, "doc_id").select(F.col("doc_id").alias("set_id"), "links", "component")
        sets = sets.join(linked, "set_id", "left")
    else:
        sets = sets.withColumns({"links": F.lit(0).cast("long"), "component": F.lit(None).cast("long")})
    known = once.join(sets, ["s0", "s1"])
    found = every.select("doc_id").distinct().join(known, "doc_id", "left")
    return found.select("doc_id", F.coalesce("component", "set_id", "doc_id").alias("class_id"), F.coalesce("set_id", "doc_id").alias("set_id"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("copies", "links")))


def _verified(key, t: pa.Table, threshold: float) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The ids of a cell's sets, in order, and the places there of those that are alike, with their similarity; the first is the lower id."""
    cell = key[0].as_py()
    ids = t.column("doc_id").to_numpy()
    order = np.unique(ids, return_index=True)[1]
    t = t.take(pa.array(order))
    ids = ids[order]
    sets = [np.frombuffer(x, np.uint64) for x in t.column("grams").to_pylist()]
    own = t.column("own").to_pylist()
    blocks = None
    if cell["kind"] == BLOCKS:
        blocks = np.array([dict(zip(o, b))[cell["place"]] for o, b in zip(own, t.column("blocks").to_pylist())], np.int64)
    sizes = np.array([len(s) for s in sets], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.zeros(0, np.int64)
    buckets: dict[int, list[int]] = {}
    for i, bs in enumerate(own):
        for b in bs:
            # Of a cell that is one bucket, all are in that; lower ones say which pairs are another cell's.
            if cell["kind"] == PACKED or b < cell["place"]:
                buckets.setdefault(b, []).append(i)
    members = {b: np.array(x, np.int64) for b, x in buckets.items() if len(x) > 1}
    mark = np.zeros(int(flat.max()) + 1 if len(flat) else 0, bool)
    met = np.zeros(len(sets), bool)
    found = []
    for i in range(len(sets)):
        if cell["kind"] == PACKED:
            for b in own[i]:
                if b in members:
                    met[members[b]] = True
        else:
            met[i + 1 :] = True
            for b in own[i]:
                if b in members:
                    met[members[b]] = False
        met[: i + 1] = False
        near = np.flatnonzero(met)
        met[near] = False
        # In a cell of two blocks only the pairs across them count; each pair within a block has the cell (i, i).
        near = near[blocks[near] != blocks[i]] if cell["i"] != cell["j"] else near
        near = near[np.minimum(sizes[near], sizes[i]) >= threshold * np.maximum(sizes[near], sizes[i]) - 1e-9]
        if not len(near):
            continue
        mark[flat[begins[i] : begins[i + 1]]] = True
        for part in np.array_split(near, max(1, int(sizes[near].sum()) >> 22)):
            at = np.repeat(begins[part] - np.concatenate([[0], np.cumsum(sizes[part])[:-1]]), sizes[part]) + np.arange(int(sizes[part].sum()))
            both = np.add.reduceat(mark[flat[at]].astype(np.int64), np.concatenate([[0], np.cumsum(sizes[part])[:-1]]))
            jaccard = both / (sizes[i] + sizes[part] - both)
            hit = jaccard >= threshold - 1e-12
            if hit.any():
                found.append((np.full(int(hit.sum()), i), part[hit], jaccard[hit]))
        mark[flat[begins[i] : begins[i + 1]]] = False
    return ids, found


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each class of near duplicates, and all others, in the same columns.

    The lowest id of a class stays.  Rows with a null id stay, as do all rows that
    repeat a kept id; documents without a word are all kept.  Columns of any name
    are carried along.
    """
    found = classes(docs, doc_id, text, **options)
    gone = fresh("lost", docs.columns)
    lost = stored(found.where("doc_id <> class_id").select(F.col("doc_id").alias(gone)))
    few = lost.count() * 32 <= BROADCAST_BYTES
    return docs.join(F.broadcast(lost) if few else lost, F.col(f"`{doc_id}`") == F.col(gone), "left_anti")
