"""Nearest neighbours by inner product: inverted lists, scanned dimension by dimension with early abandonment.

Vectors get one more coordinate, sqrt(M^2 - |x|^2) for the largest norm M, and queries a
zero: then the largest inner product is the smallest Euclidean distance. Lists are those
of k-means centroids in that space, fitted on a bounded sample; every row is indexed, in
the list of its nearest centroid. A query probes ``share`` of the lists, nearest first,
and more of them if these hold too few candidates.

In a task, the vectors of a list are rotated by one random orthogonal matrix and laid out
in blocks of columns. A candidate's distance is added up block by block. After each block
the hypothesis that its whole distance is within the query's current k-th is tested: of m
of D rotated dimensions, the partial distance times D/m estimates the whole, with a
relative error of about 1/sqrt(m); a candidate beyond (1 + epsilon / sqrt(m)) times the
k-th distance is abandoned. Those that come through are scored exactly, on the original
vectors in double precision, and only exact scores move the k-th.

Lists are packed into regions of about ``block_rows`` rows, and larger ones are split, so
a list of copies of one vector is work for many tasks. A task holds one block of rows and
one block of queries. Each task gives at most k rows a query, which a window merges.

Defined cases. Null, empty and zero vectors, vectors that hold null or non-finite
components, and rows with a null id take no part. Shorter vectors count as filled up with
zeros. Each row is a candidate of its own, also if it repeats another; a query's own rows
are those with its id, and of several with one id the least vector asks. Equal scores go
by id. An empty table, or one row alone, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import finite, matrix
from .workspace import tidy, written

K = 20
QUERY_EVERY = 20
#: Share of the lists that a query probes.
SHARE = 0.75
#: Rows that the centroids are fitted on, at most, and lists.
SAMPLE_ROWS = 16_384
MOST_LISTS = 256
ROUNDS = 8
#: Rows and queries of a task, for up to 512 dimensions; more dimensions take fewer rows.
BLOCK_ROWS = 8192
QUERY_ROWS = 2048
#: Columns of a block, rows of a list and queries that are scanned at once.
COLUMNS = 16
SCANNED_ROWS = 1024
SCANNED_QUERIES = 128
#: Share of live candidates under which they are scanned one by one.
DENSE = 0.05
#: Of the test: larger abandons less.
EPSILON = 2.1
SEED = 11


def augmented(vectors: np.ndarray, largest: float) -> np.ndarray:
    """Double-precision vectors with the coordinate that makes all norms ``largest``."""
    vectors = vectors.astype(np.float64)
    rest = np.sqrt(np.maximum(largest**2 - (vectors**2).sum(axis=1), 0))
    return np.hstack([vectors, rest[:, None]])


def asking(vectors: np.ndarray) -> np.ndarray:
    return np.hstack([vectors.astype(np.float64), np.zeros((len(vectors), 1))])


def rotation(dims: int) -> np.ndarray:
    """A random orthogonal matrix, the same in each task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def nearness(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Larger is nearer: twice the inner product less the centroid's square."""
    return 2 * points @ centroids.T - (centroids**2).sum(axis=1)


def fit_centroids(points: np.ndarray, lists: int) -> np.ndarray:
    """k-means over distinct sample points, from random ones."""
    points = np.unique(points, axis=0)
    rng = np.random.default_rng(SEED)
    lists = min(lists, len(points))
    centroids = points[rng.choice(len(points), lists, replace=False)]
    for _ in range(ROUNDS):
        nearest = np.concatenate([nearness(points[a : a + 4096], centroids).argmax(axis=1) for a in range(0, len(points), 4096)])
        held = np.bincount(nearest, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        centroids = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centroids)
    return centroids


class Found:
    """The k best of each query so far: exact scores and ids, best first."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """rows: the query of each score."""
        touched, at = np.unique(rows, return_inverse=True)
        q = np.concatenate([np.repeat(np.arange(len(touched)), self.k), at])
        s = np.concatenate([self.scores[touched].ravel(), scores])
        i = np.concatenate([self.ids[touched].ravel(), ids])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        starts = np.searchsorted(q, np.arange(len(touched)))
        best = (starts[:, None] + np.arange(self.k)).ravel()
        self.scores[touched] = s[best].reshape(-1, self.k)
        self.ids[touched] = i[best].reshape(-1, self.k)


def scan(found: Found, asked: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, largest: float, turn: np.ndarray, epsilon: float = EPSILON) -> None:
    """Adds the rows of one list to what ``asked`` queries have found."""
    dims = turn.shape[0]
    edges = [*range(0, dims, COLUMNS), dims]
    for start in range(0, len(ids), SCANNED_ROWS):
        own, plain = ids[start : start + SCANNED_ROWS], vectors[start : start + SCANNED_ROWS].astype(np.float64)
        turned = augmented(plain, largest) @ turn
        columns = [np.ascontiguousarray(turned[:, a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        squares = [(c**2).sum(axis=1) for c in columns]
        for first in range(0, len(asked), SCANNED_QUERIES):
            some = asked[first : first + SCANNED_QUERIES]
            plain_queries = queries[some].astype(np.float64)
            turned_queries = asking(plain_queries) @ turn
            norms = (plain_queries**2).sum(axis=1)
            # Squared distance of the k-th: infinite until a query has k.
            within = norms + largest**2 - 2 * found.scores[some, -1]
            whole = live = row = at = partial = None
            for k, block in enumerate(columns):
                a, b = edges[k], edges[k + 1]
                of_query = turned_queries[:, a:b]
                # Of the whole distance b of dims is in; at the end only rounding is allowed for.
                limit = within * (1 + epsilon / b**0.5) ** 2 * (b / dims) if b < dims else within * (1 + 1e-9) + 1e-12 * largest**2
                if row is None:
                    part = squares[k][:, None] - 2 * block @ of_query.T + (of_query**2).sum(axis=1)
                    whole = part if whole is None else np.add(whole, part, out=whole)
                    near = whole <= limit
                    live = near & (own[:, None] != query_ids[some]) if live is None else live & near
                    if b == dims:
                        live &= whole <= kth_of(np.where(live, whole, np.inf), found.k) * (1 + 1e-9) + 1e-9 * largest**2
                    # While most candidates live, a product of matrices is cheaper than picking them out.
                    if b == dims or np.count_nonzero(live) < DENSE * live.size:
                        row, at = np.nonzero(live)
                        partial = whole[row, at]
                    continue
                partial = partial + ((block[row] - of_query[at]) ** 2).sum(axis=1)
                kept = partial <= limit[at]
                row, at, partial = row[kept], at[kept], partial[kept]
            if len(row):
                # Only those that can be among the k nearest of what this scan has: the exact score decides.
                near = nearest_only(at, partial, found.k, largest)
                row, at = row[near], at[near]
                found.add(some[at], (plain[row] * plain_queries[at]).sum(axis=1), own[row])


def kth_of(distances: np.ndarray, k: int) -> np.ndarray:
    """The k-th smallest of each column, or infinity if there are fewer."""
    return np.partition(distances, k - 1, axis=0)[k - 1] if len(distances) >= k else np.full(distances.shape[1], np.inf)


def nearest_only(at: np.ndarray, distances: np.ndarray, k: int, largest: float) -> np.ndarray:
    """Places of the k nearest of each query, and of all that rounding does not tell from the k-th."""
    order = np.lexsort((distances, at))
    groups, starts, held = np.unique(at[order], return_index=True, return_counts=True)
    kth = distances[order][starts + np.minimum(held, k) - 1]
    limit = np.zeros(at.max() + 1)
    limit[groups] = kth * (1 + 1e-9) + 1e-9 * largest**2
    return np.nonzero(distances <= limit[at])[0]


def regions_of(sizes: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The first block of each list's region, and the blocks of that region: neighbouring lists up to block_rows; more rows take more blocks."""
    first, blocks = np.zeros(len(sizes), dtype=int), np.ones(len(sizes), dtype=int)
    at = start = rows = 0
    for k, size in enumerate(sizes):
        if rows and rows + size > block_rows:
            blocks[start:k] = max(1, ceil(rows / block_rows))
            at += blocks[start]
            start, rows = k, 0
        rows += int(size)
        first[k] = at
    blocks[start:] = max(1, ceil(rows / block_rows))
    return first, blocks


@tidy
def nearest(embeddings: DataFrame, k: int = K, every: int = QUERY_EVERY, share: float = SHARE, lists: int | None = None, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, epsilon: float = EPSILON) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row whose vec_id is divisible by ``every``."""
    spark = embeddings.sparkSession
    kind = embeddings.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    clean = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    clean = finite(clean.filter("vec_id IS NOT NULL"), "embedding").filter(F.exists("embedding", lambda x: x != 0))
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows, dims, largest = clean.agg(F.count("*"), F.max(F.size("embedding")), F.sqrt(F.max(square))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if rows < 2:
        return spark.createDataFrame([], schema)
    lists = lists or min(MOST_LISTS, max(32, isqrt(rows)))
    sample = clean.filter(F.pmod(F.xxhash64("vec_id"), F.lit(ceil(rows / SAMPLE_ROWS))) == 0).select("embedding").limit(2 * SAMPLE_ROWS).toArrow()
    if not sample.num_rows:
        sample = clean.select("embedding").limit(SAMPLE_ROWS).toArrow()
    # Up to MOST_LISTS centroids, whatever the size of the table.
    centroids = fit_centroids(augmented(matrix(sample["embedding"], dims), largest), lists)
    model = spark.sparkContext.broadcast(centroids)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = nearness(augmented(matrix(batch.column(1), dims), largest), model.value).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=["vec_id", "embedding", "list"])

    indexed = written(clean.mapInArrow(index, f"vec_id long, embedding array<{kind}>, list int").withColumn("no", F.monotonically_increasing_id()), "index")
    sizes = np.zeros(len(centroids), dtype=np.int64)
    for list_, held in indexed.groupBy("list").count().collect():
        sizes[list_] = held
    queries = indexed.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.min("no").alias("no"))
    queries = written(queries, "asking")
    asked = queries.count()
    if not asked:
        return spark.createDataFrame([], schema)
    # Small tables in smaller blocks, so that each core has two.
    block_rows = min(block_rows, max(1024, ceil(rows / (2 * spark.sparkContext.defaultParallelism))))
    block_rows = max(1, min(block_rows, BLOCK_ROWS * 512 // (dims + 1)))
    first, blocks = regions_of(sizes, block_rows)
    parts = ceil(asked / query_rows)
    probes = ceil(share * len(centroids))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for each block that holds probed lists, with these."""
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(-nearness(asking(matrix(batch.column(1), dims)), model.value), axis=1, kind="stable")
            enough = np.cumsum(sizes[order], axis=1) > k
            needed = np.where(enough.any(axis=1), enough.argmax(axis=1) + 1, len(sizes))
            where, block, probed = [], [], []
            for j, (lists_, least) in enumerate(zip(order, needed, strict=True)):
                taken = np.sort(lists_[: max(probes, least)])
                for at in np.unique(first[taken]):
                    here = taken[first[taken] == at]
                    for b in range(at, at + blocks[here[0]]):
                        where.append(j)
                        block.append(b)
                        probed.append(here)
            sent = batch.take(pa.array(where))
            yield pa.RecordBatch.from_arrays([sent.column(0), sent.column(1), sent.column(2), pa.array(block, pa.int32()), pa.array(probed, pa.list_(pa.int32()))], names=["query_id", "vector", "part", "block", "probed"])

    sent = queries.select("vec_id", "embedding", F.pmod("no", F.lit(parts)).cast("int").alias("part"))
    sent = sent.mapInArrow(probe, f"query_id long, vector array<{kind}>, part int, block int, probed array<int>")
    of_list = lambda values: F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("list") + 1)
    rows_ = indexed.withColumn("block", (of_list(first) + F.pmod("no", of_list(blocks))).cast("int"))
    rows_ = rows_.select("vec_id", "embedding", "list", "block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def search(_, left: pa.Table, right: pa.Table) -> pa.Table:
        found = Found(left.num_rows, k)
        if left.num_rows and right.num_rows:
            order = np.argsort(right["list"].to_numpy(), kind="stable")
            held, starts = np.unique(right["list"].to_numpy()[order], return_index=True)
            ids, vectors = right["vec_id"].to_numpy()[order], matrix(right["embedding"], dims)[order]
            query_ids, asks = left["query_id"].to_numpy(), matrix(left["vector"], dims)
            probed = left["probed"].combine_chunks()
            whose = np.repeat(np.arange(left.num_rows), probed.value_lengths().to_numpy())
            lists_ = probed.flatten().to_numpy()
            turn = rotation(dims + 1)
            for list_, a, b in zip(held, starts, [*starts[1:], len(ids)], strict=True):
                scan(found, whose[lists_ == list_], query_ids, asks, ids[a:b], vectors[a:b], largest, turn, epsilon)
        q, r = np.nonzero(found.scores > -np.inf)
        return pa.table({"query_id": left["query_id"].to_numpy()[q] if left.num_rows else pa.array([], pa.int64()), "vec_id": found.ids[q, r], "score": found.scores[q, r]})

    tasks = min(int(blocks.sum()) * parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = ["block", "part"]
    sides = [side.repartition(tasks, *key).groupBy(*key) for side in (sent, rows_)]
    met = written(sides[0].cogroup(sides[1]).applyInArrow(search, "query_id long, vec_id long, score double"), "met")
    model.destroy()
    ranked = met.selectExpr("*", "CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank")
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
