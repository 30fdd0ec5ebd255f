"""HTML extraction: what a host's pages repeat is boilerplate.

Pages are stripped of markup to streams of words.  The suffixes of a host's streams
are sorted, and common prefixes of neighbours give the strings of ``least`` words or
more that stand on two pages.  Words that these cover are taken out, and the
unique runs between them stay.

Only stretches that can be repeated enter the suffix array.  A sieve finds them: of
each run of ``least`` words the lowest hash of its shorter runs is its fingerprint,
and a run whose fingerprint is on one page of the host only isn't repeated.  Stretches
of the same words are one for each task that reads pages, with the lowest and the
highest of their pages, before anything is shuffled.  A host whose stretches are too
many for a task is dealt to several by its suffixes' first ``least`` words.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_sizes, discard, only, slices, stored, tidy
from .substrings import _matcher, _sorted, candidates, fingerprints
from .words import _GRAM, Words, mix, powers, windows, words

#: Words of a repeated string, at least.
LEAST = 8
#: Characters of html whose fingerprints meet in one task, about.
TASK_CHARS = 16_000_000
#: Words of a host's suffix array in one task, about.
TASK_WORDS = 1_000_000
#: Characters of stretches that a task holds before it sends them on.
HELD_CHARS = 4 << 20
#: Bytes of lists of places that are broadcast, at most.
BROADCAST_BYTES = 64 << 20

EXTRACTED = "page_id long, url string, host string, text string, words int, removed int"

_HIDDEN = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title)\b[^>]*>.*?(?:</\1\s*>|\Z)")
_INLINE = re.compile(r"(?i)</?(?:a|abbr|b|big|cite|code|em|font|i|mark|q|s|small|span|strike|strong|sub|sup|tt|u)(?:\s[^>]*)?>")
_TAG = re.compile(r"""<[a-zA-Z/!?](?:[^>"']++|"[^"]*"|'[^']*')*+>|<[a-zA-Z/!?][^>]*(?:>|\Z)""")


def visible(html: str | None) -> str:
    """The text of a page without comments, scripts, styles, title and tags; entities are resolved, and block tags end lines."""
    if not html:
        return ""
    return unescape(_TAG.sub("\n", _INLINE.sub("", _HIDDEN.sub("\n", html))))


def unique_text(text: str, start: np.ndarray, end: np.ndarray, covered: np.ndarray) -> str:
    """The runs of words that aren't covered, each with what follows its words up to the next, on a line of its own."""
    if not covered.any():
        return "\n".join(filter(None, (x.strip() for x in text.split("\n"))))
    edges = np.flatnonzero(np.diff(np.concatenate([[True], covered, [True]]).astype(np.int8)))
    out = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        stop = int(start[b]) if b < len(start) else len(text)
        out += [x.strip() for x in text[int(start[a]) : stop].split("\n")]
    return "\n".join(filter(None, out))


def host_of(url):
    """The host in lower case, without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


SENT = "bucket int, packed binary"
PLACES = "name long, places binary"


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, task_chars: int = TASK_CHARS, task_words: int = TASK_WORDS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, host, text (the unique runs, in lines), words (of the page) and removed (of them), for every row.

    Pages are told apart by id and content: rows that repeat id, url and html are
    one page, and each gives its row.  Pages with a null id are pages too.  A page with
    no host (a null url too) shares no site and keeps its text.  Null and empty html
    gives an empty text; pages of any length are read whole; no pages give no rows.
    Other columns are ignored.
    """
    site = host_of(F.col("url"))
    missing = [F.col(c).isNull() for c in ("page_id", "url", "html")]
    base = only(pages, page_id=page_id, url=url, html=html).select(F.col("page_id").cast("long").alias("page_id"), "url", site.alias("host"), F.xxhash64("page_id", "url", "html", *missing).alias("name"), "html")
    total = base.agg(F.sum(F.length("html"))).first()[0] or 0
    buckets = max(1, int(total // task_chars) + 1)

    def prints(batches):
        for b, texts in _texts(batches):
            w = words(texts)
            at, h = fingerprints(w, least)
            at = np.unique(at[at >= 0])
            if len(at):
                yield _send(buckets, mix(h[at] ^ _sites(b)[w.row[at]]), _column(b, "name"), w.row[at], at - w.first[w.row[at]])

    with_site = base.where("host <> ''")
    seen = stored(_lists(with_site.mapInArrow(prints, SENT).groupBy("bucket").applyInArrow(_on_several, PLACES)))

    def stretches(batches):
        held = _Held()
        for b, texts in _texts(batches):
            w = words(texts)
            good, stop = candidates(w, least, _places(w, b))
            at = np.flatnonzero(good & ~np.concatenate([[False], good[:-1]])) if len(good) else np.zeros(0, np.int64)
            if not len(at):
                continue
            end = stop[at] + least - 1
            row, site = w.row[at], _sites(b)
            c1, c2 = _contents(w.hash, at, end, site[row])
            names, start = _column(b, "name")[row], (at - w.first[row]).astype(np.int32)
            none = pa.nulls(len(at), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(start), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()), none], _STRETCHES)
            for key, host, name, r, i, j, n in zip(zip(c1.tolist(), c2.tolist()), site[row].tolist(), names.tolist(), row.tolist(), w.start[at].tolist(), w.end[end - 1].tolist(), (end - at).tolist()):
                held.add(host, key, name, texts[r], i, j, n)
            if held.chars > HELD_CHARS:
                yield held.batch()
        if held.chars:
            yield held.batch()

    found = stored(_joined(with_site, seen, broadcast_bytes, "inner").mapInArrow(stretches, "name long, start int, c1 long, c2 long, site long, words long, packed binary"))
    content = found.where("packed is not null").select("site", "words", "packed")
    hosts = content.groupBy("site").agg(F.sum("words").alias("held")).withColumn("parts", F.ceil(F.col("held") / task_words).cast("int")).drop("held")
    total = content.agg(F.sum("words")).first()[0] or 0
    tasks = max(1, int(4 * total // task_words) + 1)

    def deal(batches):
        for b in batches:
            for site, parts, packed in zip(*(b.column(c).to_pylist() for c in ("site", "parts", "packed"))):
                to, rows = [0], [packed]
                if parts > 1:
                    # A stretch goes to each part that one of its suffixes is of.
                    c, low, high, texts = _unpacked(packed)
                    w = words(texts)
                    at = _suffixes(w, least)
                    both = np.unique(np.stack([_part(w, at, least, parts), w.row[at]], 1), axis=0)
                    edges = np.flatnonzero(np.diff(both[:, 0], prepend=-1))
                    some = np.split(both[:, 1], edges[1:])
                    to, rows = both[edges, 0].tolist(), [_packed(c[:, x], low[x], high[x], [texts[i] for i in x.tolist()]) for x in some]
                bucket = mix(np.uint64(site & (1 << 64) - 1) + mix(np.array(to, np.uint64))) % np.uint64(tasks)
                n = len(to)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(to, pa.int64()), pa.array([site] * n, pa.int64()), pa.array([parts] * n, pa.int32()), pa.array(rows, pa.binary())], ["bucket", "part", "site", "parts", "packed"])

    dealt = content.join(hosts, "site").mapInArrow(deal, "bucket int, part long, site long, parts int, packed binary")
    repeated = stored(dealt.groupBy("bucket").applyInArrow(_suffix_arrays(least), "c1 long, c2 long, spans binary"))
    few = (repeated.agg(F.sum(F.octet_length("spans") + 40)).first()[0] or 0) <= broadcast_bytes
    places = found.where("packed is null").select("name", "start", "c1", "c2").distinct().join(F.broadcast(repeated) if few else repeated, ["c1", "c2"])

    def lay(batches):
        for b in batches:
            moved = [(np.frombuffer(x, np.int32) + s).tobytes() for s, x in zip(b.column("start").to_pylist(), b.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(moved, pa.binary())], ["name", "places"])

    covered = stored(_lists(places.select("name", "start", "spans").mapInArrow(lay, PLACES)))
    discard(seen, found, repeated)

    def cut(batches):
        for b, texts in _texts(batches):
            w = words(texts)
            edge = np.zeros(len(w.hash) + 1, np.int64)
            for first, x in zip(w.first.tolist(), b.column("places").to_pylist()):
                if x:
                    begin, end = np.frombuffer(x, np.int32).reshape(-1, 2).T + first
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, end, -1)
            inside = np.cumsum(edge)[: len(w.hash)] > 0
            out = [unique_text(t, w.start[i:j], w.end[i:j], inside[i:j]) for t, i, j in zip(texts, w.first[:-1].tolist(), w.first[1:].tolist())]
            sums = np.concatenate([[0], np.cumsum(inside)])
            removed = sums[w.first[1:]] - sums[w.first[:-1]]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "url", "host")), pa.array(out, pa.string()), pa.array(np.diff(w.first), pa.int32()), pa.array(removed, pa.int32())], ["page_id", "url", "host", "text", "words", "removed"])

    return _joined(base, covered, broadcast_bytes, "left").mapInArrow(cut, EXTRACTED)


_STRETCHES = ["name", "start", "c1", "c2", "site", "words", "packed"]


class _Held:
    """The stretches that a task has read, by host: each once, with the lowest and the highest of its pages."""

    def __init__(self) -> None:
        self.hosts: dict[int, dict[tuple[int, int], list]] = {}
        self.chars = 0

    def add(self, host: int, key: tuple[int, int], name: int, text: str, i: int, j: int, n: int) -> None:
        own = self.hosts.setdefault(host, {})
        if have := own.get(key):
            have[0], have[1] = min(have[0], name), max(have[1], name)
        else:
            own[key] = [name, name, text[i:j].replace("\n", " "), n]
            self.chars += j - i + 64

    def batch(self) -> pa.RecordBatch:
        rows = []
        for own in self.hosts.values():
            low, high, texts, _ = zip(*own.values())
            rows.append(_packed(np.array(list(own), np.uint64).T, np.array(low, np.int64), np.array(high, np.int64), list(texts)))
        n = len(rows)
        sizes = [sum(x[3] for x in own.values()) for own in self.hosts.values()]
        sites = np.array(list(self.hosts), np.uint64).view(np.int64)
        self.hosts, self.chars = {}, 0
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(sites), pa.array(sizes, pa.int64()), pa.array(rows, pa.binary())], _STRETCHES)


def _packed(c: np.ndarray, low: np.ndarray, high: np.ndarray, texts: list[str]) -> bytes:
    """Stretches as one compressed string; in order of their texts, as like ones then compress."""
    order = sorted(range(len(texts)), key=texts.__getitem__)
    flat = "\n".join(texts[i] for i in order).encode("utf-8", "surrogatepass")
    parts = [c[:, order].tobytes(), low[order].tobytes(), (high - low)[order].tobytes(), flat]
    return len(texts).to_bytes(8, "little") + zstandard.ZstdCompressor(6).compress(b"".join(parts))


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    n = int.from_bytes(packed[:8], "little")
    raw = zstandard.ZstdDecompressor().decompress(packed[8:])
    low, wide = np.frombuffer(raw, np.int64, 2 * n, 16 * n).reshape(2, n)
    return np.frombuffer(raw, np.uint64, 2 * n).reshape(2, n), low, low + wide, raw[32 * n :].decode("utf-8", "surrogatepass").split("\n")


def _contents(hashes: np.ndarray, at: np.ndarray, end: np.ndarray, site: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers of a host and the words from each place to its end."""
    out = []
    up, down = powers(_GRAM, len(hashes))
    for salt in (0, 0x5BD1E995):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes + np.uint64(salt)) * up[: len(hashes)], out=sums[1:])
        out.append(mix((sums[end] - sums[at]) * down[at] + mix(site + np.uint64(salt)) + (end - at).astype(np.uint64)))
    return out[0], out[1]


def _suffixes(w: Words, least: int) -> np.ndarray:
    """Places where a suffix of ``least`` words or more begins."""
    ends = w.first[1:][w.row]
    return np.flatnonzero(ends - np.arange(len(w.row)) >= least)


def _part(w: Words, at: np.ndarray, least: int, parts: int) -> np.ndarray:
    """The part of its host that each suffix is dealt to, by its first ``least`` words."""
    return (mix(windows(w.hash, least)[at]) % np.uint64(parts)).astype(np.int64)


def shared_lengths(lcp: np.ndarray, page: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each suffix of a sorted array: the longest prefix that a suffix of another page has too.

    ``lcp[i]`` is what suffixes i - 1 and i have in common; a negative page stands for
    several pages, so that all of the suffix is shared.
    """
    n = len(page)
    out = np.where(page < 0, length, 0)
    run = np.flatnonzero(np.concatenate([[True], (page[1:] != page[:-1]) | (page[1:] < 0)])) if n else np.zeros(0, np.int64)
    for a, b in zip(run.tolist(), np.append(run[1:], n).tolist()):
        # Within a run of one page, the nearest others are before it and after it.
        if page[a] >= 0:
            if a > 0:
                out[a:b] = np.maximum(out[a:b], np.minimum.accumulate(lcp[a:b]))
            if b < n:
                out[a:b] = np.maximum(out[a:b], np.minimum.accumulate(lcp[b:a:-1])[::-1])
    return out


def _suffix_arrays(least: int):
    """The suffix array of each host, or part of one, in a bucket; of each stretch the spans that another page repeats."""

    def run(key, t):
        held, numbers, lows, highs, groups = [], [], [], [], []
        done = stretches = 0
        group: dict[tuple[int, int], int] = {}
        for site, part, parts, packed in zip(*(t.column(c).to_pylist() for c in ("site", "part", "parts", "packed"))):
            c, low, high, texts = _unpacked(packed)
            w = words(texts)
            at = _suffixes(w, least)
            if parts > 1:
                at = at[_part(w, at, least, parts) == part]
            end = w.first[1:][w.row[at]]
            held.append((w.hash, at + done, w.row[at] + stretches, end - at, at - w.first[w.row[at]]))
            numbers.append(c)
            lows.append(low)
            highs.append(high)
            groups.append(np.full(len(low), group.setdefault((site, part), len(group))))
            done += len(w.hash)
            stretches += len(low)
        hashes, start, row, length, pos = (np.concatenate(x) for x in zip(*held))
        c, low, high, own_group = np.concatenate(numbers, 1), np.concatenate(lows), np.concatenate(highs), np.concatenate(groups)
        # A stretch that several tasks have sent is one: its first sender's suffixes stay, with the pages of all.
        order = np.lexsort((np.arange(len(low)), c[1], c[0], own_group))
        new = np.ones(len(order), bool)
        a, b = order[1:], order[:-1]
        new[1:] = (own_group[a] != own_group[b]) | (c[0][a] != c[0][b]) | (c[1][a] != c[1][b])
        first = np.flatnonzero(new)
        low[order[new]], high[order[new]] = np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)
        chosen = np.zeros(len(low), bool)
        chosen[order[new]] = True
        keep = chosen[row]
        start, row, length, pos = start[keep], row[keep], length[keep], pos[keep]
        codes = np.unique(hashes, return_inverse=True)[1].astype(np.uint32)
        del hashes, held
        raw, same = codes.astype(">u4").tobytes(), _matcher(codes)
        # Pages as small numbers; a stretch on several pages has a negative one of its own.
        page = np.unique(low, return_inverse=True)[1]
        page = np.where(low == high, page, -1 - np.arange(len(low)))
        group_of = own_group[row]
        shared = np.zeros(len(start), np.int64)
        order = np.argsort(group_of, kind="stable")
        edges = np.flatnonzero(np.diff(group_of[order], prepend=-1)) if len(order) else order
        for a, b in zip(edges.tolist(), np.append(edges[1:], len(order)).tolist()):
            own = _sorted(order[a:b], 0, raw, start, length)
            lcp = np.zeros(len(own), np.int64)
            lcp[1:] = same(start[own[:-1]], start[own[1:]], np.minimum(length[own[:-1]], length[own[1:]]))
            shared[own] = shared_lengths(lcp, page[row[own]], length[own])
        hit = np.flatnonzero(shared >= least)
        hit = hit[np.lexsort((pos[hit], row[hit]))]
        first = np.flatnonzero(np.diff(row[hit], prepend=-1)) if len(hit) else hit
        spans: list[bytes] = []
        at: list[int] = []
        for a, b in zip(first.tolist(), np.append(first[1:], len(hit)).tolist()):
            some = hit[a:b]
            begin, end = pos[some], np.maximum.accumulate(pos[some] + shared[some])
            new = np.concatenate([[True], begin[1:] > end[:-1]])
            last = np.append(np.flatnonzero(new)[1:] - 1, len(some) - 1)
            spans.append(np.stack([begin[new], end[last]], 1).astype(np.int32).tobytes())
            at.append(int(row[some[0]]))
        return pa.table({"c1": c[0][np.array(at, np.int64)].view(np.int64), "c2": c[1][np.array(at, np.int64)].view(np.int64), "spans": pa.array(spans, pa.binary())})

    return run


def _column(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).to_numpy(zero_copy_only=False)


def _texts(batches):
    """Pieces of batches, with their pages' visible texts."""
    for b in batches:
        for i, j in slices(byte_sizes(b.column("html")), 1 << 20):
            piece = b.slice(i, j - i)
            yield piece, [visible(x) for x in piece.column("html").to_pylist()]
        tidy()


def _sites(b: pa.RecordBatch) -> np.ndarray:
    """A number of each row's host, so that words of different hosts never meet."""
    return np.array([xxhash.xxh3_64_intdigest(h) for h in b.column("host").to_pylist()], np.uint64)


def _send(buckets: int, keys: np.ndarray, names: np.ndarray, row: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket of keys: its places, packed; each page's name once.  Of a key the low 32 bits are sent: this is a sieve."""
    packer = zstandard.ZstdCompressor(3)
    bucket = (keys >> np.uint64(40)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    out: dict[str, list] = {"bucket": [], "packed": []}
    for b in np.flatnonzero(np.diff(ends)).tolist():
        some = order[ends[b] : ends[b + 1]]
        rows, local = np.unique(row[some], return_inverse=True)
        # Places rise within a page, and pages rise: differences are small numbers, which pack well.
        steps = np.diff(np.stack([local, pos[some]]).astype(np.int32), prepend=np.int32(0), axis=1)
        parts = [names[rows].tobytes(), steps.tobytes(), keys[some].astype(np.uint32).tobytes()]
        out["bucket"].append(b)
        out["packed"].append(np.array([len(rows), len(some)], np.int64).tobytes() + packer.compress(b"".join(parts)))
    return pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), pa.array(out["packed"], pa.binary())], ["bucket", "packed"])


def _on_several(key, t):
    """Of the places in a bucket those whose key is on two pages or more, for each page."""
    reader = zstandard.ZstdDecompressor()
    names, pos, keys = [], [], []
    for packed in t.column("packed").to_pylist():
        pages, n = np.frombuffer(packed, np.int64, 2).tolist()
        raw = reader.decompress(packed[16:])
        local, at = np.cumsum(np.frombuffer(raw, np.int32, 2 * n, 8 * pages).reshape(2, n), axis=1, dtype=np.int32)
        names.append(np.frombuffer(raw, np.int64, pages)[local])
        pos.append(at)
        keys.append(np.frombuffer(raw, np.uint32, n, 8 * (pages + n)))
    names, pos, keys = (np.concatenate(x) for x in (names, pos, keys))
    # Equal windows of words next to each other, by their hashes.
    order = np.argsort(keys, kind="stable")
    own = names[order]
    first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    several = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
    hit = order[np.repeat(several, np.diff(np.append(first, len(order))))]
    hit = hit[np.lexsort((pos[hit], names[hit]))]
    names, pos = names[hit], pos[hit]
    begin = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(names)).astype(np.int64)
    return pa.table({"name": names[begin], "places": pa.array([pos[i:j].astype(np.int32).tobytes() for i, j in zip(begin, end)], pa.binary())})


def _lists(places: DataFrame) -> DataFrame:
    """One row for each page: all its places."""
    return places.groupBy("name").agg(F.collect_list("places").alias("parts")).select("name", F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x))").alias("places"))


def _joined(base: DataFrame, lists: DataFrame, broadcast_bytes: int, how: str) -> DataFrame:
    """Pages with their places.  The lists are broadcast if they are small, else both sides are shuffled."""
    size = lists.agg(F.sum(F.octet_length("places") + 32)).first()[0] or 0
    return base.join(F.broadcast(lists) if size <= broadcast_bytes else lists, "name", how)


def _places(w: Words, b: pa.RecordBatch) -> np.ndarray:
    """The listed places of a piece's pages, as places in ``w``; a page may have one several times."""
    out = [np.frombuffer(p, np.int32).astype(np.int64) + w.first[i] for i, p in enumerate(b.column("places").to_pylist()) if p]
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
