"""Best-fit packing by a grouping genetic algorithm on islands.

Texts become pieces of at most ``capacity`` tokens; full pieces are sequences of
their own. The others are dealt over shards of a fixed mean size, so the number
of shards grows with the pieces and no task holds more than a shard. In a shard
best-fit decreasing gives a first packing, and a lower bound (by the sum of lengths,
and by the pieces over half a sequence) says whether it can be improved. Where it can, several islands evolve packings: the
crossover injects whole well-filled bins of one parent into the other, bins that
lose a document to them are dissolved, and the displaced documents first change
places with shorter ones that leave a bin fuller, then are put back best fit. Islands
start from different packings and have seeds of their own. After each round the elite of an island migrates to the next one. The
state of an island is one row; Spark runs the islands side by side.

A shard that meets its bound costs at most one sequence over packing all pieces
together; what is above the bounds is in ``n_bins`` and ``bound`` of its state.

Defined cases. A null or empty text is one piece: the end id. A null id, repeated
rows and repeated ids are packed as any row (a row number tells them apart). A very
long text is cut into as many pieces as it needs. Pieces of one length keep the order
of their rows. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ENCODE_BYTES, ENCODE_ROWS, Encoder
from .workspace import over_texts, per_worker, tidy, type_of, written

CAPACITY = 4096
END_ID = 1
#: Mean number of pieces of a shard.
SHARD_PIECES = 8192
ISLANDS, ROUNDS, GENERATIONS, POPULATION = 3, 3, 12, 6
#: Islands that one Arrow batch holds at most.
ISLANDS_AT_ONCE = 16
#: Least filled bins that a mutation dissolves at most.
DISSOLVED = 40


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of each row."""
    end = np.array([END_ID], dtype="<u4").tobytes()

    def make():
        encoder = per_worker(("pieces", path), lambda: Encoder(path))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, piece, start, length, crc = [], [], [], [], []
            for row, words in enumerate(encoder.encode(batch.column(1).to_pylist())):
                raw = b"".join(words) + end
                for k, s in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[s : s + 4 * capacity]
                    at.append(row), piece.append(k), start.append(s // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

        return work

    return over_texts(docs, ["doc_id", "text"], make, f"doc_id {type_of(docs, 'doc_id')}, piece int, start long, length long, ids_crc32 long", ENCODE_ROWS, ENCODE_BYTES)


def best_fit(lengths, items, room: list[tuple[int, int]], bins: list[list[int]], capacity: int) -> None:
    """Puts items, longest first, each into the bin that it fills best. room: sorted (free, bin)."""
    for i in sorted(items, key=lambda i: -lengths[i]):
        k = bisect_left(room, (lengths[i],))
        if k < len(room):
            free, b = room.pop(k)
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if free > lengths[i]:
            insort(room, (free - lengths[i], b))


def first_packing(lengths, capacity: int) -> list[list[int]]:
    bins: list[list[int]] = []
    best_fit(lengths, range(len(lengths)), [], bins, capacity)
    return bins


def first_fit(lengths, order, capacity: int) -> list[list[int]]:
    """Items in the given order, each into the tightest bin that it fits among those open: another seed than the decreasing order."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i in order:
        k = bisect_left(room, (lengths[i],))
        free, b = room.pop(k) if k < len(room) else (capacity, len(bins))
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
        if free > lengths[i]:
            insort(room, (free - lengths[i], b))
    return bins


def fitness(bins, lengths, capacity: int) -> float:
    """Mean squared fill: higher for fewer bins and for fuller ones among as many."""
    return sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def dominate(bins, displaced, lengths, capacity: int, rng) -> list[int]:
    """Fills bins up: one or two items of a bin for one or two displaced ones that are longer together. Returns what is displaced then.

    Each exchange lowers what is displaced, so the bins that are left to be filled get fewer.
    """
    pool = sorted((lengths[i], i) for i in displaced)
    sizes, ids = [n for n, _ in pool], [i for _, i in pool]
    frees = [capacity - sum(lengths[i] for i in b) for b in bins]
    order = [k for k in range(len(bins)) if frees[k] > 0]
    rng.shuffle(order)
    for k in order:
        if not sizes:
            break
        bin_, free = bins[k], frees[k]
        # What fits as it is goes in first.
        while free and sizes and sizes[0] <= free:
            at = bisect_right(sizes, free) - 1
            free -= sizes.pop(at)
            bin_.append(ids.pop(at))
        if not free or not sizes:
            continue
        held = [lengths[i] for i in bin_]
        outs = [(held[x], (x,)) for x in range(len(held))]
        outs += [(held[x] + held[y], (x, y)) for x in range(len(held)) for y in range(x)][:45]
        gain, swap = 0, None
        for out, where in outs:
            at = bisect_right(sizes, out + free) - 1
            if at >= 0 and sizes[at] - out > gain:
                gain, swap = sizes[at] - out, (where, (at,))
                if gain == free:
                    break
        if gain < free and len(sizes) > 1:
            array = np.array(sizes)
            for out, where in outs:
                other = np.searchsorted(array, out + free - array, side="right") - 1
                sums = np.where((other >= 0) & (other < np.arange(len(array))), array + array[other], 0)
                at = int(sums.argmax())
                if sums[at] - out > gain:
                    gain, swap = int(sums[at]) - out, (where, (at, int(other[at])))
                    if gain == free:
                        break
        if swap:
            where, taken = swap
            coming = [ids[at] for at in taken]
            for at in sorted(taken, reverse=True):
                sizes.pop(at), ids.pop(at)
            for x in sorted(where, reverse=True):
                i = bin_.pop(x)
                at = bisect_left(sizes, lengths[i])
                sizes.insert(at, lengths[i]), ids.insert(at, i)
            bin_ += coming
    return ids


def crossover(into, giver, lengths, capacity: int, rng) -> list[list[int]]:
    """Injects whole well-filled bins of giver; bins of into that share a document with them are dissolved."""
    fills = np.array([sum(lengths[i] for i in b) for b in giver])
    best = np.argsort(-fills, kind="stable")[: max(1, len(giver) // 2)]
    chosen = [giver[k] for k in rng.choice(best, size=max(1, int(len(best) * rng.uniform(0.1, 0.9))), replace=False)]
    taken = {i for b in chosen for i in b}
    child = [list(b) for b in chosen]
    displaced = []
    for b in into:
        if taken.isdisjoint(b):
            child.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    return repack(child, displaced, lengths, capacity, rng)


def mutate(bins, lengths, capacity: int, rng) -> list[list[int]]:
    """Dissolves some of the least filled bins and some of all, and puts their documents back."""
    fills = np.array([sum(lengths[i] for i in b) for b in bins])
    most = max(2, min(len(bins) // 4, DISSOLVED))
    least = np.argsort(fills, kind="stable")[: int(rng.integers(1, most))]
    gone = {*map(int, least), *map(int, rng.integers(0, len(bins), size=int(rng.integers(1, most))))}
    return repack([list(b) for k, b in enumerate(bins) if k not in gone], [i for k in gone for i in bins[k]], lengths, capacity, rng)


def repack(bins, displaced, lengths, capacity: int, rng) -> list[list[int]]:
    """Puts displaced documents back: exchanges that fill bins up, then best fit."""
    displaced = dominate(bins, displaced, lengths, capacity, rng)
    room = sorted((free, k) for k, b in enumerate(bins) if (free := capacity - sum(lengths[i] for i in b)) > 0)
    best_fit(lengths, displaced, room, bins, capacity)
    return bins


def least_bins(lengths, capacity: int) -> int:
    """A number of bins that no packing goes below: by the sum, and with the items over a half, which share no bin, kept apart.

    For each k up to a half: items over capacity - k stand alone, the other items over a half take one bin each, and items
    from k on that do not fit beside these take the rest.
    """
    sizes = np.sort(np.asarray(lengths, dtype=np.int64))
    if not len(sizes):
        return 0
    before = np.concatenate([[0], np.cumsum(sizes)])
    cut = lambda x, side: np.searchsorted(sizes, x, side=side)
    ks = np.unique(np.concatenate([[1], sizes[sizes <= capacity // 2]]))
    over, alone, small = cut(capacity // 2, "right"), cut(capacity - ks, "right"), cut(ks, "left")
    beside = len(sizes) - np.minimum(alone, len(sizes)), np.maximum(alone - over, 0)
    more = before[over] - before[np.minimum(small, over)] - (beside[1] * capacity - (before[np.maximum(alone, over)] - before[over]))
    return int((beside[0] + beside[1] + np.maximum(0, -(-more // capacity))).max())


def evolve(lengths, elites, capacity: int, bound: int, seed: int, generations: int = GENERATIONS, population: int = POPULATION) -> list[list[int]]:
    """The best packing of an island after so many generations; stops at the bound.

    Beside the elites an island starts with packings of its own: items in random order, and mutants.
    """
    rng = np.random.default_rng(seed)
    score = lambda b: (-len(b), fitness(b, lengths, capacity))
    alive = [*elites]
    if len(alive) < population:
        alive.append(first_fit(lengths, rng.permutation(len(lengths)).tolist(), capacity))
    while len(alive) < population and min(map(len, alive)) > bound:
        alive.append(mutate(alive[int(rng.integers(0, len(alive)))], lengths, capacity, rng))
    for _ in range(generations):
        alive.sort(key=score, reverse=True)
        if len(alive[0]) <= bound:
            break
        half = alive[: max(2, population // 2)]
        alive = [*half, *(mutate(crossover(half[int(a)], half[int(b)], lengths, capacity, rng), lengths, capacity, rng) for a, b in (rng.choice(len(half), 2, replace=False) for _ in range(population - len(half))))]
    return max(alive, key=score)


def _pack(bins, n: int) -> bytes:
    of = np.empty(n, dtype=np.int32)
    for k, b in enumerate(bins):
        of[b] = k
    return of.tobytes()


def _unpack(blob: bytes) -> list[list[int]]:
    of = np.frombuffer(blob, dtype=np.int32)
    order = np.argsort(of, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(of[order])) + 1)]


STATE = "shard long, island int, lengths binary, bins binary, n_bins long, bound long"


@tidy
def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, islands: int = ISLANDS, rounds: int = ROUNDS) -> DataFrame:
    """Each piece with its sequence_id and its offset there."""
    cut = pieces(docs, path, capacity).withColumn("row", F.monotonically_increasing_id())
    cut = written(cut, "pieces", ENCODE_ROWS)
    full, rest = cut.filter(F.col("length") == capacity), cut.filter(F.col("length") < capacity)
    shards = max(1, ceil(rest.count() / shard_pieces))
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))

    def seed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "row"], kind="stable")
        lengths = frame["length"].astype(np.int32).to_numpy()
        bins = first_packing(lengths.tolist(), capacity)
        return pd.DataFrame([(frame["shard"].iloc[0], 0, lengths.tobytes(), _pack(bins, len(lengths)), len(bins), least_bins(lengths, capacity))], columns=_names(STATE))

    state = written(rest.select("shard", "length", "row").groupBy("shard").applyInPandas(seed, STATE), "islands")

    def island(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                lengths = np.frombuffer(r.lengths, dtype=np.int32).tolist()
                best = evolve(lengths, [_unpack(b) for b in r.elites], capacity, r.bound, 7919 * r.shard + 31 * r.island + r.round)
                out.append((r.shard, r.island, r.lengths, _pack(best, len(lengths)), len(best), r.bound))
            yield pd.DataFrame(out, columns=_names(STATE))

    settled = [state.filter("n_bins <= bound")]
    still = state.filter("n_bins > bound").withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    for k in range(rounds):
        open_islands = still.count()
        if not open_islands:
            break
        # Each island starts with its own elite and with that of the island before it.
        migrant = still.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.col("bins").alias("migrant"))
        start = still.join(migrant, ["shard", "island"]).withColumn("elites", F.array("bins", "migrant")).withColumn("round", F.lit(k))
        ready = start.repartition(max(1, open_islands // 2), "shard", "island")
        after = written(ready.select("shard", "island", "lengths", "elites", "bound", "round").mapInPandas(island, STATE), "islands", ISLANDS_AT_ONCE)
        least = after.groupBy("shard").agg(F.min("n_bins").alias("least"))
        after = after.join(least, "shard")
        last = F.lit(k == rounds - 1)
        best = after.filter((F.col("least") <= F.col("bound")) | last)
        settled.append(best.groupBy("shard").agg(F.min_by(F.struct("island", "lengths", "bins", "n_bins", "bound"), F.struct("n_bins", "island")).alias("s")).select("shard", "s.*"))
        still = after.filter((F.col("least") > F.col("bound")) & ~last).drop("least")
    chosen = settled[0]
    for x in settled[1:]:
        chosen = chosen.unionByName(x)

    kind = type_of(docs, "doc_id")
    out_schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(frame: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "row"], kind="stable")
        of = np.frombuffer(best["bins"].iloc[0], dtype=np.int32)
        order = np.argsort(of, kind="stable")
        lengths, of = frame["length"].to_numpy()[order], of[order]
        before = np.cumsum(lengths) - lengths
        first = np.r_[True, of[1:] != of[:-1]]
        offset = before - np.maximum.accumulate(np.where(first, before, 0))
        return frame.iloc[order].assign(sequence_id=(int(best["shard"].iloc[0]) << 24) + of.astype(np.int64), offset=offset)[_names(out_schema)]

    packed = rest.groupBy("shard").cogroup(chosen.select("shard", "bins").groupBy("shard")).applyInPandas(place, out_schema)
    alone = full.withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone.select(*_names(out_schema)))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]
