"""Substring deduplication with prefix-partitioned suffix trees.

A suffix begins at any word of any text.  Suffixes are split into groups by a
prefix: by its first ``least`` words, and where a group is too large for memory,
by longer and longer prefixes.  Of each group the subtree is built by sorting its
suffixes and taking common prefixes of neighbours; its internal nodes, all at
least ``least`` words deep, that occur after different words are the maximal
repeats.

Three exact sieves keep most suffixes out of the trees.  A run of ``least`` words
has a fingerprint, the lowest hash of its shorter runs; where that occurs once in
all texts, the run does too.  Where a run occurs once, no tree has it.  And where
all occurrences of a run follow the same word, every repeat from there begins
further left.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, stored, text_batches
from .words import Words, mix, windows, words

#: Words of a repeat, at least.
LEAST = 50
#: Characters of text whose fingerprints meet in one task, about; then runs of words, and suffixes' words.
FINGERPRINT_CHARS, TASK_WINDOWS, TASK_WORDS = 32_000_000, 1_500_000, 3_000_000
#: Bytes of suffixes that are sorted at once; larger groups are split by longer prefixes.
SORT_BYTES = 64 << 20
#: Bytes of a list of positions that is broadcast, at most.
BROADCAST_BYTES = 64 << 20

REPEATS = "name long, start_word int, words int, occurrences long, repeat_id long, parent_id long"


def _inside(w: Words, n: int) -> np.ndarray:
    """For each run of n words: whether it is of one text."""
    if len(w.row) < n:
        return np.zeros(0, bool)
    return w.row[: len(w.row) - n + 1] == w.row[n - 1 :]


def _names(w: Words, texts: list[str]) -> np.ndarray:
    """A 64-bit name of each text's words, so that rows which share an id can be told apart."""
    rows = np.repeat(np.arange(len(texts)), np.diff(w.first))
    place = np.arange(len(rows)) - w.first[rows]
    sums = np.zeros(len(rows) + 1, np.uint64)
    np.cumsum(mix(w.hash + place.astype(np.uint64)), out=sums[1:])
    return sums[w.first[1:]] - sums[w.first[:-1]]


def fingerprints(w: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of ``least`` words of one text: the place of its fingerprint's run; and the hashes of such shorter runs."""
    k = (least + 1) // 2
    h = windows(w.hash, k)
    span = least - k + 1
    inside = _inside(w, least)
    if not len(inside):
        return np.zeros(0, np.int64), h
    view = np.lib.stride_tricks.sliding_window_view(h, span)
    at = np.empty(len(inside), np.int64)
    for a in range(0, len(inside), 1 << 15):
        at[a : a + (1 << 15)] = view[a : a + (1 << 15)].argmin(1)
    at += np.arange(len(at))
    at[~inside] = -1
    return at, h


def _by_bucket(bucket: np.ndarray, count: int):
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(count + 1))
    for b in np.flatnonzero(np.diff(ends)).tolist():
        yield b, order[ends[b] : ends[b + 1]]


def _batch(columns: dict[str, list]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.binary())) for k, v in columns.items()], list(columns))


def _send(buckets: int, bucket: np.ndarray, ids: np.ndarray, names: np.ndarray, weights: np.ndarray, row: np.ndarray, pos: np.ndarray, hashes: np.ndarray, left: np.ndarray | None) -> pa.RecordBatch:
    """One row for each bucket: arrays of its places, with each text's id and name once."""
    out: dict[str, list] = {"bucket": [], "ids": [], "names": [], "weights": [], "row": [], "pos": [], "hash": [], "left": []}
    for b, some in _by_bucket(bucket, buckets):
        rows, local = np.unique(row[some], return_inverse=True)
        out["bucket"].append(b)
        out["ids"].append(ids[rows].tobytes())
        out["names"].append(names[rows].tobytes())
        out["weights"].append(weights[rows].tobytes())
        out["row"].append(local.astype(np.uint32).tobytes())
        out["pos"].append(pos[some].astype(np.uint32).tobytes())
        out["hash"].append(hashes[some].tobytes())
        out["left"].append(b"" if left is None else left[some].tobytes())
    return _batch(out)


SENT = "bucket int, ids binary, names binary, weights binary, row binary, pos binary, hash binary, left binary"
PLACES = "doc_id long, name long, pos int"


def _received(t: pa.Table):
    parts: list[list[np.ndarray]] = [[] for _ in range(6)]
    for i, n, k, r, p, h, x in zip(*(t.column(c).to_pylist() for c in ("ids", "names", "weights", "row", "pos", "hash", "left"))):
        r = np.frombuffer(r, np.uint32)
        got = np.frombuffer(i, np.int64)[r], np.frombuffer(n, np.uint64)[r], np.frombuffer(k, np.int64)[r], np.frombuffer(p, np.uint32), np.frombuffer(h, np.uint64), np.frombuffer(x, np.uint64)
        for have, y in zip(parts, got):
            have.append(y)
    return tuple(np.concatenate(x) for x in parts)


def _several(key, t):
    """Of the places in a bucket: those whose hash another place has; with ``left``, only where words before them differ."""
    ids, names, weights, pos, hashes, left = _received(t)
    # Rows that repeat both id and words are one; a name belongs to one id here.
    place = mix(names + mix(pos.astype(np.uint64)))
    order = np.lexsort((place, hashes))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (place[order[1:]] != place[order[:-1]])
    order = order[new]
    ids, names, weights, pos, hashes = ids[order], names[order], weights[order], pos[order], hashes[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    if len(left):
        left = left[order]
        keep = np.minimum.reduceat(left, first) != np.maximum.reduceat(left, first)
        # Copies of a text all begin after nothing, each after a nothing of its own.
        keep |= np.maximum.reduceat(np.where(pos == 0, weights, 0), first) > 1
    else:
        keep = np.add.reduceat(weights, first) > 1
    keep = np.repeat(keep, np.diff(np.append(first, len(hashes))))
    return pa.table({"doc_id": ids[keep], "name": names[keep].view(np.int64), "pos": pos[keep].astype(np.int32)})


def _joined(base: DataFrame, lists: DataFrame, broadcast_bytes: int) -> DataFrame:
    """Texts with their lists.  The lists are broadcast if they are small, else both sides are shuffled."""
    arrays = [F.size(f.name) for f in lists.schema if f.dataType.typeName() == "array"]
    size = lists.agg(F.sum(sum(arrays, F.lit(16)) * 4)).first()[0] or 0
    return base.join(F.broadcast(lists) if size <= broadcast_bytes else lists, "doc_id")


def _lists(places: DataFrame, column: str) -> DataFrame:
    return places.groupBy("doc_id", "name").agg(F.collect_list("pos").alias(column))


def _marked(w: Words, good: np.ndarray, lists: list) -> np.ndarray:
    """The listed positions of each text, as places in ``w``; those of texts of another name are left out."""
    out = [np.asarray(x, np.int64) + w.first[i] for i, x in enumerate(lists) if good[i]]
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def candidates(w: Words, least: int, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run of ``least`` words: whether its fingerprint is repeated; and where the stretch of such runs ends that it is in."""
    at, _ = fingerprints(w, least)
    flag = np.zeros(len(w.hash) + 1, bool)
    flag[repeated] = True
    good = flag[at] & (at >= 0)
    ends = np.flatnonzero(good & ~np.append(good[1:], False)) + 1
    stop = np.zeros(len(good), np.int64)
    where = np.flatnonzero(good)
    stop[where] = ends[np.searchsorted(ends, where, "right")] if len(ends) else 0
    return good, stop


def _before(w: Words, ids: np.ndarray, names: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the word before each place; at a text's first word, a number of its own."""
    first = w.first[w.row[at]] == at
    own = mix(ids[w.row[at]].astype(np.uint64) ^ mix(names[w.row[at]]))
    return np.where(first, own, w.hash[np.maximum(at, 1) - 1])


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, fingerprint_chars: int = FINGERPRINT_CHARS, task_windows: int = TASK_WINDOWS, task_words: int = TASK_WORDS, broadcast_bytes: int = BROADCAST_BYTES, nested: bool = False) -> DataFrame:
    """doc_id, start_word, words, occurrences, repeat_id: every place where a maximal repeat begins.

    Of the maximal repeats that begin at a word, the longest is given, with its
    number of occurrences in all texts; those of one repeat share ``repeat_id``.
    Words are runs of letters and digits in lower case, counted from 0; a repeat
    has ``least`` of them or more.  Every word that another place repeats as a part
    of ``least`` equal words lies in one of the spans.  Repeats within a text count.
    Null and empty texts, and rows with a null id, have none; rows that repeat both
    id and words are one row; other columns are ignored.

    With ``nested`` no maximal repeat is missing: one that is the longest at none of
    its places has a row at one of them, and a column parent_id names the longest of
    the shorter ones that begin at the same places, null where there is none.  The
    places of a repeat are those of the rows from which parents lead to it.  Links
    keep this linear in the places, where nested repeats listed at each are not.

    Texts of the same words are one text with a weight, that of the lowest id; its
    rows are given for each of the others in the end.
    """
    if least < 2:
        raise ValueError("least must be 2 at least")
    base = only(docs, doc_id=doc_id, text=text).where("doc_id is not null and text is not null")
    chars = base.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, int(chars // fingerprint_chars) + 1)

    def named(batches):
        for keys, texts in text_batches(batches, "doc_id", "text"):
            w = words(texts)
            long = np.flatnonzero(np.diff(w.first) >= least)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(long)).cast(pa.int64()), pa.array(_names(w, texts)[long].view(np.int64))], ["doc_id", "name"])

    members = stored(base.mapInArrow(named, "doc_id long, name long").distinct())
    owners = stored(members.groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("weight")))

    def read(batches, columns):
        """For each piece of a batch: words, ids, names, weights and the lists of the texts that stand for their like."""
        for b in batches:
            for keys, texts, own in _with(b, ["name", "weight", *columns]):
                w = words(texts)
                names = _names(w, texts)
                lists = [own[c].to_pylist() for c in columns]
                good = names == own["name"].to_numpy(zero_copy_only=False).view(np.uint64)
                weights = own["weight"].to_numpy(zero_copy_only=False).astype(np.int64)
                yield texts, w, keys.to_numpy(zero_copy_only=False).astype(np.int64), names, weights, good, [_marked(w, good, x) for x in lists]

    def prints(batches):
        for _, w, ids, names, weights, good, _ in read(batches, []):
            at, h = fingerprints(w, least)
            at = np.unique(at[at >= 0])
            at = at[good[w.row[at]]]
            if len(at):
                yield _send(buckets, (mix(h[at]) % np.uint64(buckets)).astype(np.int32), ids, names, weights, w.row[at], at - w.first[w.row[at]], h[at], None)

    seen = stored(_lists(_joined(base, owners, broadcast_bytes).mapInArrow(prints, SENT).groupBy("bucket").applyInArrow(_several, PLACES), "prints").join(owners, ["doc_id", "name"]))
    total = seen.agg(F.sum(F.size("prints"))).first()[0] or 0
    # A fingerprint stands for about a quarter of ``least`` runs.
    runs = max(1, int(total * (least // 4 + 2) // task_windows) + 1)

    def starts(batches):
        for _, w, ids, names, weights, _, (marked,) in read(batches, ["prints"]):
            at = np.flatnonzero(candidates(w, least, marked)[0])
            if len(at):
                h = windows(w.hash, least)[at]
                yield _send(runs, (mix(h) % np.uint64(runs)).astype(np.int32), ids, names, weights, w.row[at], at - w.first[w.row[at]], h, _before(w, ids, names, at))

    begins = _lists(_joined(base, seen, broadcast_bytes).mapInArrow(starts, SENT).groupBy("bucket").applyInArrow(_several, PLACES), "begins")
    both = stored(seen.join(begins, ["doc_id", "name"]))
    total = both.agg(F.sum(F.size("begins"))).first()[0] or 0
    # Each suffix brings some words of its own, as those of a text share theirs.
    trees = max(1, int(total * 5 * least // task_words) + 1)

    def suffixes(batches):
        packer = zstandard.ZstdCompressor(3)
        for texts, w, ids, names, weights, _, (marked, at) in read(batches, ["prints", "begins"]):
            _, stop = candidates(w, least, marked)
            if len(at):
                yield from _pack(packer, trees, texts, w, ids, names, weights, at, least, stop[at] + least - 1)

    def build(key, t):
        return _repeats_of(t, least, nested)

    found = _joined(base, both, broadcast_bytes).mapInArrow(suffixes, "bucket int, packed binary").groupBy("bucket").applyInArrow(build, REPEATS)
    few = members.count() * 32 <= broadcast_bytes
    return found.join(F.broadcast(members) if few else members, "name").select("doc_id", "start_word", "words", "occurrences", "repeat_id", *["parent_id"] * nested)


def _with(batch: pa.RecordBatch, columns: list[str]):
    done = 0
    for keys, texts in text_batches([batch], "doc_id", "text"):
        yield keys, texts, {c: batch.column(c).slice(done, len(texts)) for c in columns}
        done += len(texts)


def _pack(packer, trees: int, texts: list[str], w: Words, ids: np.ndarray, names: np.ndarray, weights: np.ndarray, at: np.ndarray, least: int, stop: np.ndarray):
    """For each tree's task: the stretches of text that its suffixes need, each once, and the suffixes' places in them.

    A tree is put in the task of its prefix's fingerprint: neighbouring prefixes
    often share it, and so the text.
    """
    out: dict[str, list] = {"bucket": [], "packed": []}
    left, h = _before(w, ids, names, at), windows(w.hash, least)[at]
    prints, grams = fingerprints(w, least)
    for b, some in _by_bucket((mix(grams[prints[at]]) % np.uint64(trees)).astype(np.int32), trees):
        p, e = at[some], stop[some]
        new = np.concatenate([[True], e[1:] != e[:-1]])
        begin, end = p[new], e[new]
        offset = np.concatenate([[0], np.cumsum(end - begin)])
        run = np.cumsum(new) - 1
        row = w.row[p]
        text = "\n".join(texts[r][s:t] for r, s, t in zip(w.row[begin].tolist(), w.start[begin].tolist(), w.end[end - 1].tolist()))
        parts = [np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), (p - begin[run] + offset[run]).astype(np.uint32), (e - p).astype(np.uint32), names[row], (p - w.first[row]).astype(np.uint32), weights[row].astype(np.uint32), h[some], left[some]]
        sizes = np.array([len(x) for x in parts], np.int64)
        out["bucket"].append(b)
        out["packed"].append(packer.compress(sizes.tobytes() + b"".join(x.tobytes() for x in parts)))
        if len(out["bucket"]) >= 256:
            yield _batch(out)
            out = {"bucket": [], "packed": []}
    if out["bucket"]:
        yield _batch(out)


_KINDS = (np.uint8, np.uint32, np.uint32, np.uint64, np.uint32, np.uint32, np.uint64, np.uint64)


def _repeats_of(t: pa.Table, least: int, nested: bool) -> pa.Table:
    reader = zstandard.ZstdDecompressor()
    parts: list[list[np.ndarray]] = [[] for _ in _KINDS]
    texts: list[str] = []
    base = 0

    def flush() -> None:
        # Texts are turned to hashes in pieces, so that only hashes of all are held.
        if texts:
            parts[0].append(words(texts).hash)
            texts.clear()

    held = 0
    for packed in t.column("packed").to_pylist():
        raw = reader.decompress(packed)
        sizes = np.frombuffer(raw, np.int64, len(_KINDS))
        at, got = 8 * len(_KINDS), []
        for kind, n in zip(_KINDS, sizes.tolist()):
            got.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        texts.append(got[0].tobytes().decode("utf-8", "surrogatepass"))
        held += len(texts[-1])
        got[1] = got[1].astype(np.int64) + base
        # The last suffix of the last stretch ends where the text does.
        base = int((got[1] + got[2]).max())
        for have, x in zip(parts[1:], got[1:]):
            have.append(x)
        if held > 1 << 20:
            flush()
            held = 0
    flush()
    tokens, start, length, names, pos, weights, h, left = (np.concatenate(x) for x in parts)
    codes = np.unique(tokens, return_inverse=True)[1].astype(np.uint32)
    del tokens
    order = np.lexsort((pos, names, h))
    new = np.ones(len(order), bool)
    a, b = order[1:], order[:-1]
    new[1:] = (h[a] != h[b]) | (names[a] != names[b]) | (pos[a] != pos[b])
    order = order[new]
    start, length, names, pos, weights, h, left = start[order], length[order].astype(np.int64), names[order], pos[order], weights[order].astype(np.int64), h[order], left[order]
    same = _matcher(codes)
    raw = codes.astype(">u4").tobytes()
    del codes
    depth, count, name, up = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64)
    more: list[tuple[int, int, int, int, int]] | None = [] if nested else None
    several = (pos == 0) & (weights > 1)
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    for a, b in zip(first.tolist(), np.append(first[1:], len(h)).tolist()):
        _tree(np.arange(a, b), least, raw, start, length, left, weights, several, same, depth, count, name, up, more, h[a])
    at = np.flatnonzero(depth >= least)
    depth, count, name, up = depth[at], count[at], name[at], up[at]
    if more:
        # The numbers of a node are unsigned: each column alone, or NumPy makes them floats.
        a, d, c, n, u = zip(*more)
        at, depth, count = np.append(at, np.array(a, np.int64)), np.append(depth, np.array(d, np.int64)), np.append(count, np.array(c, np.int64))
        name, up = np.append(name, np.array(n, np.uint64)), np.append(up, np.array(u, np.uint64))
    return pa.table({
        "name": names[at].view(np.int64), "start_word": pos[at].astype(np.int32), "words": depth.astype(np.int32), "occurrences": count,
        "repeat_id": mix(name).view(np.int64), "parent_id": pa.array(mix(up).view(np.int64), mask=up == 0),
    })


def _matcher(ranks: np.ndarray) -> Callable:
    """(a, b, most) -> number of equal words from places a and b on, found by halving on hashes of prefixes."""
    from .words import _GRAM, powers

    up, down = powers(_GRAM, len(ranks) + 1)
    sums = np.zeros(len(ranks) + 1, np.uint64)
    np.cumsum(mix(ranks.astype(np.uint64) + np.uint64(1)) * up[: len(ranks)], out=sums[1:])

    def same(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            equal = (sums[a + mid] - sums[a]) * down[a] == (sums[b + mid] - sums[b]) * down[b]
            low = np.where(open_ & equal, mid, low)
            high = np.where(open_ & ~equal, mid - 1, high)
        return low

    return same


def _tree(some: np.ndarray, prefix: int, raw: bytes, start, length, left, weights, several, same, depth, count, name, up, more, group) -> None:
    """The subtree of suffixes that share ``prefix`` words: sorted suffixes, common prefixes of neighbours, internal nodes.

    ``more`` gets (suffix, depth, count, name, name of the parent) of each maximal
    repeat that is the longest at none of its places; None leaves these out.

    Suffixes that are too many bytes to sort at once are split by the next words,
    each part sorted alone; the parts, in order of those words, make one order.
    """
    order = _sorted(some, prefix, raw, start, length)
    n = len(order)
    # Copies of a text are one leaf; where that begins their text, it is a repeat itself, as long as the text.
    alone = order[several[order]]
    depth[alone], count[alone] = length[alone], weights[alone]
    name[alone] = (np.uint64(group) ^ (length[alone].astype(np.uint64) << np.uint64(32))) + np.uint64(1 << 31) + np.flatnonzero(several[order]).astype(np.uint64)
    if n < 2:
        return
    a, b = order[:-1], order[1:]
    common = same(start[a], start[b], np.minimum(length[a], length[b]))
    # Internal nodes are intervals of the sorted suffixes; each is closed when a shallower prefix follows.
    node_depth: list[int] = []
    node_size: list[int] = []
    node_low: list[int] = []
    node_high: list[int] = []
    node_begin: list[int] = []
    parent: list[int] = []
    stack: list[int] = []
    before, weight, many = left[order].tolist(), weights[order].tolist(), several[order].tolist()
    leaf = [0] * n

    def opened(d: int, begin: int) -> int:
        node_depth.append(d)
        node_size.append(0)
        node_low.append(1 << 65)
        node_high.append(-1)
        node_begin.append(begin)
        parent.append(-1)
        return len(node_depth) - 1

    def absorb(node: int, size: int, low: int, high: int) -> None:
        node_size[node] += size
        node_low[node] = min(node_low[node], low)
        node_high[node] = max(node_high[node], high)

    def close(to: int) -> None:
        top = stack.pop()
        parent[top] = to
        absorb(to, node_size[top], node_low[top], node_high[top])

    lcp = [0, *common.tolist(), 0]
    for i in range(n):
        l, r = lcp[i], lcp[i + 1]
        # The leaf hangs from the deeper of the two nodes that it shares with its neighbours.
        if r > l:
            stack.append(opened(r, i))
        if stack:
            leaf[i] = stack[-1]
            absorb(stack[-1], weight[i], before[i], before[i] + many[i])
        else:
            leaf[i] = -1
        while stack and node_depth[stack[-1]] > r:
            if len(stack) > 1 and node_depth[stack[-2]] >= r:
                close(stack[-2])
            elif r > 0:
                # A node of depth r opens between the two; it begins where the closed one did.
                middle = opened(r, node_begin[stack[-1]])
                close(middle)
                stack.append(middle)
            else:
                stack.pop()
    # From the root down: the deepest node on the way that follows different words.
    best = [-1] * len(node_depth)
    for v in sorted(range(len(node_depth)), key=node_depth.__getitem__):
        best[v] = v if node_low[v] != node_high[v] else best[parent[v]] if parent[v] >= 0 else -1
    def named(v: int) -> int:
        # Above a node that follows different words all do, so that parents of maximal repeats are maximal.
        return (int(group) ^ (node_depth[v] << 32)) + node_begin[v] & (1 << 64) - 1 if v >= 0 else 0

    longest = set()
    for i, v in enumerate(leaf):
        v = best[v] if v >= 0 else -1
        j = order[i]
        if v >= 0 and node_depth[v] >= depth[j]:
            depth[j], count[j] = node_depth[v], node_size[v]
            name[j], up[j] = named(v), named(parent[v])
            longest.add(v)
        elif v >= 0:
            up[j] = named(v)
    if more is not None:
        more += [(int(order[node_begin[v]]), node_depth[v], node_size[v], named(v), named(parent[v])) for v in range(len(node_depth)) if best[v] == v and v not in longest]


def _sorted(some: np.ndarray, prefix: int, raw: bytes, start, length) -> np.ndarray:
    if len(some) < 2:
        return some
    if int((length[some] - prefix).clip(0).sum()) * 4 <= SORT_BYTES:
        keys = [raw[4 * (s + prefix) : 4 * (s + n)] for s, n in zip(start[some].tolist(), length[some].tolist())]
        return some[np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)]
    longer = max(16, prefix * 2)
    ends = np.minimum(length[some], longer)
    keys = [raw[4 * (s + prefix) : 4 * (s + e)] for s, e in zip(start[some].tolist(), ends.tolist())]
    parts: dict[bytes, list[int]] = {}
    for i, k in enumerate(keys):
        parts.setdefault(k, []).append(i)
    out = []
    for k in sorted(parts):
        own = some[np.array(parts[k], np.int64)]
        out.append(_sorted(own, longer, raw, start, length) if len(own) > 1 and len(k) == 4 * (longer - prefix) else own)
    return np.concatenate(out)
