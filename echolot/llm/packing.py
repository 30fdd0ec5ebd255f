"""Best-fit packing with certified bounds.

Texts are cut into pieces of at most ``capacity`` words, and the pieces packed
into bins of that capacity by best-fit decreasing, each partition on its own.
Dual feasible functions bound a partition's number of bins from below; one that
meets its bound is certified.  The others keep their full bins, pool what lies in
the rest, deal it out anew, and pack and bound again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

CAPACITY = 2048
#: Pieces that a partition packs, about.
PARTITION_PIECES = 32_768
#: Rounds of exchange, at most.
ROUNDS = 4

PACKED = "doc_id long, piece long, start long, words long, round int, part long, bin long, fill long, bound long, bins long"


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece: longest first, each into the fullest bin that holds it, else into a new one."""
    bins = np.zeros(len(sizes), np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, count = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        room = mask >> n
        if room:
            left = n + (room & -room).bit_length() - 1
            b = open_[left].pop()
            if not open_[left]:
                mask &= ~(1 << left)
        else:
            left, b, count = capacity, count, count + 1
        bins[i] = b
        if left > n:
            open_[left - n].append(b)
            mask |= 1 << left - n
    return bins


def bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """The largest of the lower bounds on the number of bins that three families of dual feasible functions give, in whole numbers.  counts: pieces of each size, if sizes are distinct."""
    if not len(sizes):
        return 0
    x, count = np.unique(np.asarray(sizes, np.int64), return_counts=True) if counts is None else (np.asarray(sizes, np.int64), np.asarray(counts, np.int64))
    up = lambda a, b: -(-int(a) // int(b))
    best = up((x * count).sum(), capacity)
    # Rounding to multiples of 1/k: exact multiples of 1/(k+1) stay, all else is rounded down.
    for k in range(1, 65):
        over = (k + 1) * x
        value = np.where(over % capacity == 0, k * x, over // capacity * capacity)
        best = max(best, up((value * count).sum(), k * capacity))
    for e in x[x <= capacity // 2].tolist():
        # Over capacity - e counts as a whole bin, under e as nothing.
        value = np.where(x > capacity - e, capacity, np.where(x >= e, x, 0))
        best = max(best, up((value * count).sum(), capacity))
        # Over half counts as a bin less what multiples of e would fill; e to half as one such multiple.
        m = capacity // e
        value = np.where(2 * x > capacity, m - (capacity - x) // e, np.where(x >= e, 1, 0))
        best = max(best, up((value * count).sum(), m))
    return best


def _pack(t: pa.Table, capacity: int, part: int, number: int) -> pa.Table:
    t = t.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("words", "ascending")])
    sizes = t.column("words").to_numpy()
    bins = best_fit(sizes, capacity)
    fill = np.bincount(bins, sizes).astype(np.int64)[bins]
    n = len(sizes)
    return pa.table({
        **{c: t.column(c) for c in ("doc_id", "piece", "start", "words")},
        "round": pa.array(np.full(n, number, np.int32)), "part": pa.array(np.full(n, part)), "bin": pa.array(bins), "fill": pa.array(fill),
        "bound": pa.array(np.full(n, bound(sizes, capacity))), "bins": pa.array(np.full(n, int(bins.max()) + 1)),
    })


def _round(pieces: DataFrame, capacity: int, number: int, parts: int) -> DataFrame:
    def run(key, t):
        return _pack(t, capacity, key[0].as_py(), number)

    dealt = pieces.select("doc_id", "piece", "start", "words", F.pmod(F.xxhash64(F.lit(number), "doc_id", "piece"), F.lit(parts)).alias("part"))
    return dealt.groupBy("part").applyInArrow(run, PACKED)


def word_count(text: Column) -> Column:
    """Number of runs of characters other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES, rounds: int = ROUNDS, length: Column | None = None) -> DataFrame:
    """A row for each piece: doc_id, piece, start and words (of the text), bin, fill (words in the bin), certified, full.

    ``bin`` is a struct (round, part, bin).  A text of more than ``capacity`` words
    is cut into full pieces and a rest, however long it is.  Texts without words, and
    null ones, have no piece; no documents give no rows.  Rows with a null or repeated id
    are packed like all others, each once.  Of pieces of one size the lower id goes first,
    and of bins with the same room the one that got it last.
    Other columns are ignored; ``length`` puts another measure, an expression over
    the columns of ``docs``, in place of the number of words.

    ``certified`` says that the partition of the bin uses no more bins than any
    packing of its pieces must; of the partitions with a gap, that all of them do so
    together, full bins that were kept included.  ``full`` says that the bin is.
    Partitions with a gap keep the bins that are full,
    and pool their other pieces; these are dealt out
    to partitions anew and packed again.  A round is kept if it needs fewer bins,
    for at most ``rounds`` rounds, a bound of the work: pieces are in bins whenever it ends.
    """
    if capacity < 1:
        raise ValueError("capacity must be 1 at least")
    measure = word_count(F.col(f"`{text}`")) if length is None else F.coalesce(length.cast("long"), F.lit(0))
    sized = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), measure.alias("n"))
    pieces = sized.where("n > 0").select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity))).alias("piece"))
    pieces = stored(pieces.select("doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).alias("words")))
    parts = max(1, -(-pieces.count() // partition_pieces))
    packed = stored(_round(pieces, capacity, 0, parts))
    done: list[DataFrame] = []
    gap = F.col("bins") > F.col("bound")
    # One row for each size: capacity of them at most.
    pool = packed.where(gap).groupBy("words").count().orderBy("words").collect()
    for number in range(1, rounds + 1):
        loose = packed.where(gap & (F.col("fill") < capacity))
        had = loose.select(F.count("*").alias("n"), F.count_distinct("part", "bin").alias("bins")).first()
        if not had["n"]:
            break
        fewer = max(1, -(-had["n"] // partition_pieces))
        again = stored(_round(loose, capacity, number, fewer))
        if again.select(F.count_distinct("part", "bin")).first()[0] >= had["bins"]:
            break
        done.append(packed.where(~(gap & (F.col("fill") < capacity))))
        packed = again
    done.append(packed)
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    alone = (F.col("round") == 0) & ~gap
    used = whole.where(~alone).select(F.count_distinct("round", "part", "bin")).first()[0] if pool else 0
    met = bool(pool) and used <= bound(np.array([r[0] for r in pool]), capacity, np.array([r[1] for r in pool]))
    return whole.select("doc_id", "piece", "start", "words", F.struct("round", "part", "bin").alias("bin"), "fill", (alone | F.lit(met)).alias("certified"), (F.col("fill") == capacity).alias("full"))
