"""Approximate nearest neighbours by an inverted multi-index.

Both halves of the vectors are quantised on their own; a vector's cell is its pair of
centroids. A query takes cells by the sum of its distances to both centroids, from a heap,
until they hold its share of all entries; the entries of these cells are ranked by exact
distance. The share is measured, not set: on held-out rows of the sample, so that clustered
vectors are asked few cells and vectors without clusters many.

Codebooks and share are fitted on a bounded sample (``SAMPLE`` rows or about so many, those
whose ids have small hashes); every row is indexed, and every query asks all of them. Queries
and entries meet by first centroid in a grid of parts of bounded size on both sides, so that
neither a hot centroid nor one asked by all queries is held by one task.

Defined results: vectors that are null, of zeros, or that hold a null or a component that is
not finite take no part, nor do rows without id or of another length than most vectors have
(of equally frequent lengths the smallest counts). A query is the rows of its id: of several
the smallest vector asks, and none of them is its candidate. Other rows are candidates each,
repeated ones too; equal distances rank by ascending id. Queries with fewer candidates than
asked get those that there are, a table without candidates gives no rows. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import ship, stored

#: Rows that the codebooks and the share are fitted on: half each.
SAMPLE = 32_768
#: Centroids of a half: four times the fourth root of the rows, so many at most.
MOST_CENTROIDS = 1024
ROUNDS = 12
#: Queries of the held-out half, and the part of their neighbours that the share must reach.
TRIALS, REACHED = 512, 0.96
#: Entries and queries of a part of the grid.
PART_ENTRIES, PART_QUERIES = 2048, 1024
#: Pairs whose exact distances are computed at once.
PAIRS = 1 << 14


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of both, up to rounding."""
    return (x**2).sum(1)[:, None] - 2 * (x @ y.T) + (y**2).sum(1)[None]


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances, row by row."""
    parts = [np.sqrt(((x[k : k + PAIRS] - y[k : k + PAIRS]) ** 2).sum(1)) for k in range(0, len(x), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0)


def centroids(x: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's rounds from distinct rows; a centroid that loses all its rows stays where it is."""
    if not x.shape[1]:
        return np.zeros((1, 0))
    distinct = np.unique(x, axis=0)
    c = distinct[np.random.default_rng(0).choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(ROUNDS):
        near = squared(x, c).argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


class Codebooks:
    """Centroids of the two halves."""

    def __init__(self, x: np.ndarray, k: int):
        self.half = x.shape[1] // 2
        self.first, self.second = centroids(x[:, : self.half], k), centroids(x[:, self.half :], k)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squared(x[:, : self.half], self.first), squared(x[:, self.half :], self.second)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, two = self.distances(x)
        return one.argmin(1), two.argmin(1)


def share_needed(books: Codebooks, x: np.ndarray, k: int, trials: int = TRIALS, reached: float = REACHED) -> float:
    """The share of entries that a query must be shown, in order of cells, for ``reached`` of its ``k``
    nearest to be among them: measured on rows that the codebooks were not fitted on."""
    if len(x) <= k + 1:
        return 1.0
    q = x[:trials]
    far = squared(q, x)
    far[np.arange(len(q)), np.arange(len(q))] = np.inf
    near = np.argpartition(far, k - 1, axis=1)[:, :k]
    (one, two), (a, b) = books.distances(q), books.cells(x)
    sums = one[:, a] + two[:, b]
    order = np.sort(sums, axis=1)
    before = [np.searchsorted(order[i], sums[i, near[i]], "right") for i in range(len(q))]
    return float(min(1.0, np.quantile(np.concatenate(before), reached, method="higher") / len(x)))


def reach(one: np.ndarray, two: np.ndarray, counts: np.ndarray, wanted: float) -> list[tuple[int, np.ndarray]]:
    """(first centroid, second centroids) of the cells with the smallest summed distances that hold
    ``wanted`` entries together. Each cell is put on the heap by one other, so none twice."""
    first, second = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    x, y = one[first].tolist(), two[second].tolist()
    held = counts[np.ix_(first, second)].tolist()
    depth = [0] * len(x)
    heap, got = [(x[0] + y[0], 0, 0)], 0
    while heap and got < wanted:
        _, i, j = heapq.heappop(heap)
        got += held[i][j]
        depth[i] = j + 1
        if j + 1 < len(y):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return [(int(first[i]), second[:d]) for i, d in enumerate(depth) if d and any(held[i][:d])]


def closest(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, shown: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's row, entry's row, distance) of each query's ``k`` nearest among the entries shown to it.
    Products of matrices find them but for rounding, exact distances rank them."""
    shown = shown & (query_ids[:, None] != ids[None])
    with np.errstate(over="ignore", invalid="ignore"):
        far = np.where(shown, squared(q, x), np.inf)
        if k < far.shape[1]:
            slack = 1e-9 * ((q**2).sum(1) + (x**2).sum(1).max())
            shown &= far <= (np.partition(far, k - 1, axis=1)[:, k - 1] + slack)[:, None]
            if np.isnan(far).any():  # beyond what squares can hold
                shown = np.isnan(far) | shown
        i, j = np.nonzero(shown)
        distance = exact_pairs(q, x, i, j)
    order = np.lexsort((ids[j], distance, i))
    i, j, distance = i[order], j[order], distance[order]
    place = np.arange(len(i)) - np.searchsorted(i, i, "left")
    return i[place < k], j[place < k], distance[place < k]


def exact_pairs(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    parts = [exact(q[i[a : a + PAIRS]], x[j[a : a + PAIRS]]) for a in range(0, len(i), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _matrix(column, width: int) -> np.ndarray:
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int, int]:
    """(vec_id, vector) of the rows that take part, their number and their vectors' length."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).filter(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0)
    )
    width = good.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    return (good, 0, 0) if width is None else (good.filter(F.size("vector") == width["width"]), width["count"], width["width"])


def fit(good: DataFrame, n: int, width: int, k: int) -> tuple[Codebooks, float]:
    """Codebooks and share, from about ``SAMPLE`` rows."""
    part = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1 << 32)) < int((1 << 32) * min(1.0, SAMPLE / n))
    table = good.filter(part).limit(2 * SAMPLE).toArrow()
    x = _matrix(table.column("vector"), width)[np.argsort(table.column("vec_id").to_numpy(), kind="stable")]
    x = x[np.random.default_rng(1).permutation(len(x))]
    if not len(x):  # a few rows, none of which has a small hash
        x = np.zeros((1, width))
    size = min(MOST_CENTROIDS, max(1, round(4 * n**0.25)))
    cut = (len(x) + 1) // 2
    books = Codebooks(x[:cut], size)
    return books, share_needed(books, x[cut:], k)


def _assign(shared, width: int):
    """Adds each row's cell and a number that spreads rows over the parts of their centroid."""

    def run(batches):
        import pyarrow as pa

        number = 0
        for batch in batches:
            a, b = shared.value.cells(_matrix(batch.column("vector"), width))
            salt = np.arange(number, number + batch.num_rows, dtype=np.int64)
            number += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(salt), batch.column("vec_id"), batch.column("vector")], names=["a", "b", "salt", "vec_id", "vector"])

    return run


def _visit(shared, width: int):
    """A row for each query and first centroid that it asks, with the second ones."""

    def run(batches):
        import pyarrow as pa

        books, counts, wanted = shared.value
        for batch in batches:
            one, two = books.distances(_matrix(batch.column("vector"), width))
            for k in range(batch.num_rows):
                asked = reach(one[k], two[k], counts, wanted)
                take = pa.array(np.full(len(asked), k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a for a, _ in asked], pa.int32()), batch.column("query_id").take(take), batch.column("vector").take(take), pa.array([b.astype(np.int32) for _, b in asked], pa.list_(pa.int32()))],
                    names=["a", "query_id", "vector", "bs"],
                )

    return run


def _rerank(width: int, centroids_: int, k: int):
    def run(entries, queries):
        import pyarrow as pa

        lists = queries.column("bs").combine_chunks()
        asks = np.zeros((len(lists), centroids_), dtype=bool)
        asks[np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = True
        ids, query_ids = entries.column("vec_id").to_numpy(), queries.column("query_id").to_numpy()
        if len(ids) and len(query_ids):
            i, j, distance = closest(ids, _matrix(entries.column("vector"), width), query_ids, _matrix(queries.column("vector"), width), asks[:, entries.column("b").to_numpy()], k)
        else:
            i, j, distance = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return pa.table({"query_id": query_ids[i], "vec_id": ids[j], "score": distance})

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each row for which ``is_query`` (of vec_id) holds, the ``k``
    nearest other rows found, by Euclidean distance."""
    spark = vectors.sparkSession
    ship(spark)
    good, n, width = usable(vectors, id_col, vector_col)
    if not n:
        return spark.createDataFrame([], "query_id BIGINT, rank INT, vec_id BIGINT, score DOUBLE")
    books, share = fit(good, n, width, k)
    index = stored(good.mapInArrow(_assign(spark.sparkContext.broadcast(books), width), "a INT, b INT, salt BIGINT, vec_id BIGINT, vector ARRAY<DOUBLE>"), "multi-index")
    # a row for each cell that holds a row, MOST_CENTROIDS ** 2 at most
    cells = index.groupBy("a", "b").count().toArrow()
    counts = np.zeros((len(books.first), len(books.second)), np.int64)
    counts[cells.column("a").to_numpy(), cells.column("b").to_numpy()] = cells.column("count").to_numpy()

    wanted = max(share * n, k + 1)
    queries = index.filter(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector"))
    visit = _visit(spark.sparkContext.broadcast((books, counts, wanted)), width)
    visits = stored(queries.mapInArrow(visit, "a INT, query_id BIGINT, vector ARRAY<DOUBLE>, bs ARRAY<INT>"), "multi-index-visits")

    # parts of each first centroid's entries and queries: a row for each centroid
    asked = {r["a"]: r["count"] for r in visits.groupBy("a").count().collect()}
    held = counts.sum(1)
    sizes = [(a, -(-int(held[a]) // PART_ENTRIES), -(-m // PART_QUERIES)) for a, m in asked.items()]
    grid = F.broadcast(spark.createDataFrame(sizes, "a INT, parts INT, query_parts INT"))
    entry_side = index.join(grid, "a").select("a", F.pmod("salt", "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)).alias("query_part"), "b", "vec_id", "vector")
    query_part = F.pmod(F.xxhash64("query_id"), F.col("query_parts")).cast("int").alias("query_part")
    query_side = visits.join(grid, "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), query_part, "query_id", "vector", "bs")
    keys = ("a", "part", "query_part")
    found = entry_side.groupBy(*keys).cogroup(query_side.groupBy(*keys)).applyInArrow(_rerank(width, len(books.second), k), "query_id BIGINT, vec_id BIGINT, score DOUBLE")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of all ``embeddings`` for each row whose ``vec_id`` is divisible by 100."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
