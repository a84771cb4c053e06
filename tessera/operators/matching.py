"""Similarity of embeddings, and matching candidates to a target distribution.

Neither side goes through the driver. Candidates are indexed by pivots (a bounded sample of
them) and by rings of their angle to the nearest one; angles obey the triangle inequality, so
that a ring's bounds tell how similar to a target its members can be. A target first asks the
nearest rings, until they hold as many candidates as it wants; the last of those found is a
bound, and only rings that can beat it are asked then. Results are exact.

Those first rings are few for each target, and targets meet them by a shuffle. All else meets in
a grid of packs, rows that hold the vectors of one part of bounded bytes: packs are dealt once, and a
Cartesian product reads them again where it needs them, so that what is shuffled and written grows
with the vectors and not with the pairs. Packs meet by matrix products; a task holds two packs, a slice
of their product and the best candidates so far of one pack's targets.

Vectors without direction (of zeros) have the similarity NaN with all others, which counts as
the greatest, as in any sort by Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.relation import capped
from tessera.plans.scratch import written

#: Bytes of the vectors of a part of the grid, on either side.
BLOCK_BYTES = 1 << 20
#: Numbers of a matrix that a task holds of a product, and pairs that it keeps before it hands them on.
SLICE, KEPT = 1 << 21, 1 << 20
#: Pairs of a run that is ordered by similarity (a power of two), and pairs that are handed on at once.
ORDERED, HANDED = 1 << 24, 1 << 18
#: Files of a side's packs, at most: Spark deals the product by pairs of them.
PACK_FILES = 32
#: Candidates that serve as pivots, at most and in bytes, and rings around each.
PIVOTS, PIVOT_BYTES, RINGS = 1024, 16 << 20, 64
#: What rounding can add to an angle or a similarity.
SLACK = 1e-7

_FOUND = "target_id BIGINT, candidate_id BIGINT, similarity DOUBLE"


def _matrix(column) -> np.ndarray:
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def best_of_block(ids: np.ndarray, x: np.ndarray, q: np.ndarray, k: np.ndarray, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(target's row, candidate's row, similarity) of each target's ``k`` most similar candidates, without
    those below its ``bound``. A product of matrices finds them but for rounding; what ranks them depends
    on the two vectors alone."""
    if bound is None:
        bound = np.full(len(q), -np.inf)
    found = []
    step = max(1, SLICE // max(1, len(ids)))
    for a in range(0, len(q), step):
        rough, some = q[a : a + step] @ x.T, k[a : a + step]
        rough[np.isnan(rough)] = np.inf
        hit = rough >= bound[a : a + step, None] - SLACK
        many = (some < len(ids)) & (hit.sum(axis=1) > 4 * some + 64)
        for size in np.unique(some[many]).tolist():
            rows = np.flatnonzero(many & (some == size))
            last = np.partition(rough[rows], len(ids) - size, axis=1)[:, len(ids) - size] if size else np.full(len(rows), np.inf)
            hit[rows] &= rough[rows] >= last[:, None] - SLACK
        i, j = np.nonzero(hit)
        found.append(_best(i + a, j, np.concatenate([np.zeros(0), *((q[i[c : c + 16384] + a] * x[j[c : c + 16384]]).sum(1) for c in range(0, len(i), 16384))]), ids, k))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _best(i: np.ndarray, j: np.ndarray, similarity: np.ndarray, ids: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (target's row, candidate's row, similarity) the first ``k`` of each target, in order."""
    order = np.lexsort((ids[j], -np.where(np.isnan(similarity), np.inf, similarity), i))
    i, j, similarity = i[order], j[order], similarity[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i, "left") < k[i]
    return i[kept], j[kept], similarity[kept]


@dataclass
class Index:
    """Candidates by block (pivot and ring): rows (block, salt, id, vector), and of each block its
    pivot, the smallest and greatest angle to it and its size."""

    rows: DataFrame
    size: int
    width: int
    pivots: np.ndarray
    blocks: np.ndarray
    low: np.ndarray
    high: np.ndarray
    counts: np.ndarray

    @property
    def part_rows(self) -> int:
        return part_rows(self.width)


def part_rows(width: int) -> int:
    return max(1, BLOCK_BYTES // (8 * max(1, width)))


def _assign(shared, rings: int, more: tuple[str, ...] = ()):
    def run(batches):
        import pyarrow as pa

        number = 0
        for batch in batches:
            unit = _unit(_matrix(batch.column("vector")))
            blank = np.isnan(unit).any(axis=1)
            angle = _angles(np.where(blank[:, None], 0.0, unit), shared.value)
            pivot = angle.argmin(1)
            angle = angle[np.arange(len(unit)), pivot]
            block = np.where(blank, -1, pivot * RINGS + np.minimum((angle / np.pi * rings).astype(np.int64), rings - 1))
            salt = np.arange(number, number + len(unit))
            number += len(unit)
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), pa.array(angle), pa.array(salt), batch.column("id"), _lists(unit), *map(batch.column, more)], names=["block", "angle", "salt", "id", "vector", *more])

    return run


def _lists(m: np.ndarray):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1] or 1, dtype=np.int32) if m.size else np.zeros(len(m) + 1, np.int32)), pa.array(m.ravel()))


def _vectors(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), *more)


def indexed(candidates: DataFrame) -> Index:
    """The index of (id, vector); its rows are written down once."""
    spark = candidates.sparkSession
    rows = _vectors(candidates)
    counted = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    n, width = counted["n"], counted["width"] or 0
    # a pivot for a quarter of a part, and rings that cut what it holds on; small tables are one block
    most = max(1, min(PIVOTS, PIVOT_BYTES // (8 * max(1, width)), 4 * n // part_rows(width)))
    rings = max(1, min(RINGS, 16 * n // (most * part_rows(width))))
    # so many rows at most, those of the smallest hashes: each task keeps its own first
    sample = rows.filter(F.exists("vector", lambda v: v != 0)).orderBy(F.xxhash64("id"), "id").limit(most).collect()
    pivots = _unit(np.array([r["vector"] for r in sample], dtype=np.float64)) if sample else np.zeros((1, width))
    placed = written(rows.mapInArrow(_assign(spark.sparkContext.broadcast(pivots), rings), "block INT, angle DOUBLE, salt BIGINT, id BIGINT, vector ARRAY<DOUBLE>"))
    # a row for each block, PIVOTS * RINGS at most
    found = sorted(placed.groupBy("block").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("n")).collect())
    column = lambda c, kind: np.array([r[c] for r in found], dtype=kind)
    return Index(placed, n, width, pivots, column("block", np.int64), column("low", float), column("high", float), column("n", np.int64))


def _least_angles(unit: np.ndarray, pivots: np.ndarray, blocks: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of targets and blocks: the angle to the block's pivot and the least one to its members; and which
    targets are blank."""
    blank = np.isnan(unit).any(axis=1)
    near, at = np.unique(np.maximum(blocks, 0) // RINGS, return_inverse=True)
    theta = _angles(np.where(blank[:, None], 0.0, unit), pivots[near])[:, at]
    least = np.maximum(0.0, np.maximum(theta - high, low - theta))
    least[:, blocks < 0] = 0.0  # of NaN, the greatest similarity
    least[blank] = 0.0
    return theta, least, blank


def _can_beat(least: np.ndarray, blank: np.ndarray, bound: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Which blocks can hold a candidate as similar to a target as its bound."""
    return blank[:, None] | (blocks < 0) | (np.cos(np.maximum(least - SLACK, 0.0)) >= bound[:, None] - SLACK)


def _slices(batches, blocks: int):
    """Batches of so few targets that a number for each and each block is little."""
    for batch in batches:
        step = max(1, SLICE // max(1, blocks))
        for a in range(0, batch.num_rows, step):
            yield batch.slice(a, step)


def _asks(shared):
    """The blocks that each target (id, vector, k) asks first: the nearest that hold k candidates."""

    def run(batches):
        import pyarrow as pa

        pivots, blocks, low, high, counts = shared.value
        for batch in _slices(batches, len(blocks)):
            unit, k = _unit(_matrix(batch.column("vector"))), batch.column("k").to_numpy()
            theta, least, _ = _least_angles(unit, pivots, blocks, low, high)
            for r in range(batch.num_rows):
                order = np.lexsort((blocks, theta[r], least[r]))
                asked = order[: int(np.searchsorted(np.cumsum(counts[order]), k[r], "left")) + 1]
                take = pa.array(np.full(len(asked), r))
                names = ["block", "target_id", "k", "vector"]
                yield pa.RecordBatch.from_arrays([pa.array(blocks[asked].astype(np.int32)), batch.column("id").take(take), batch.column("k").take(take), _lists(np.repeat(unit[r : r + 1], len(asked), axis=0))], names=names)

    return run


def _asked_pairs(shared):
    """How many candidates the blocks hold that targets (id, vector, k, bound) ask."""

    def run(batches):
        import pyarrow as pa

        pivots, blocks, low, high, counts = shared.value
        for batch in _slices(batches, len(blocks)):
            theta, least, blank = _least_angles(_unit(_matrix(batch.column("vector"))), pivots, blocks, low, high)
            asked = _can_beat(least, blank, batch.column("bound").to_numpy(), blocks)
            for r, k in enumerate(batch.column("k").to_pylist()):
                order = np.lexsort((blocks, theta[r], least[r]))
                asked[r, order[: int(np.searchsorted(np.cumsum(counts[order]), k, "left")) + 1]] = True
            yield pa.RecordBatch.from_arrays([pa.array([int((asked * counts).sum())]), pa.array([batch.num_rows])], names=["pairs", "targets"])

    return run


def _meet(entries, targets):
    import pyarrow as pa

    ids, names = entries.column("id").to_numpy(), targets.column("target_id").to_numpy()
    if not len(ids) or not len(names):
        i, j, similarity = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    else:
        i, j, similarity = best_of_block(ids, _matrix(entries.column("vector")), _matrix(targets.column("vector")), targets.column("k").to_numpy())
    return pa.table({"target_id": names[i], "candidate_id": ids[j], "similarity": similarity})


def _met(index: Index, asks: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """What the targets of each block find in it: the block's candidates and targets are dealt over a grid
    of parts, each of which one task holds. ``sizes``: the candidates of each block."""
    spark = asks.sparkSession
    asked = {r["block"]: r["count"] for r in asks.groupBy("block").count().collect()}
    rows = [(b, -(-sizes[b] // index.part_rows), -(-n // index.part_rows)) for b, n in asked.items()]
    if not rows:
        return spark.createDataFrame([], _FOUND)
    grid = F.broadcast(spark.createDataFrame(rows, "block INT, parts INT, target_parts INT"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    entry_side = index.rows.join(grid, "block").select("block", F.pmod("salt", "parts").cast("int").alias("part"), upto("target_parts").alias("target_part"), "id", "vector")
    target_side = asks.join(grid, "block").select("block", upto("parts").alias("part"), F.pmod(F.xxhash64("target_id"), F.col("target_parts")).cast("int").alias("target_part"), "target_id", "k", "vector")
    keys = ("block", "part", "target_part")
    return entry_side.groupBy(*keys).cogroup(target_side.groupBy(*keys)).applyInArrow(_meet, _FOUND)


def _pack(key, table):
    """A pack's rows in one: block, id, k and bound of each, and the vectors end to end."""
    import pyarrow as pa

    order = np.argsort(table.column("block").to_numpy(), kind="stable")
    raw = lambda c, kind: table.column(c).to_numpy()[order].astype(kind).tobytes()
    row = {"pack": [key[0].as_py()], "block": [raw("block", "<i8")], "id": [raw("id", "<i8")], "k": [raw("k", "<i8")], "bound": [raw("bound", "<f8")], "vector": [_matrix(table.column("vector"))[order].astype("<f8").tobytes()]}
    return pa.table({c: pa.array(v, pa.int32() if c == "pack" else pa.binary()) for c, v in row.items()})


def _packed(rows: DataFrame, counts: dict[int, int], most: int) -> DataFrame:
    """Rows (block, salt, id, vector, k, bound) in packs of about ``most`` rows of blocks that follow each
    other; written down once. ``counts``: the rows of each block."""
    dealt, last, room = [], -1, 0
    for block, n in sorted(counts.items()):
        parts = -(-n // most)
        if parts > 1:
            dealt.append((block, last + 1, parts))
            last, room = last + parts, 0
            continue
        if n > room:
            last, room = last + 1, most
        dealt.append((block, last, 1))
        room -= n
    packs = F.broadcast(rows.sparkSession.createDataFrame(dealt, "block INT, first INT, parts INT"))
    placed = rows.join(packs, "block").withColumn("pack", (F.col("first") + F.pmod("salt", "parts")).cast("int")).select("pack", "block", "id", "k", "bound", "vector")
    return written(placed.repartition(max(1, min(last + 1, PACK_FILES)), "pack").groupBy("pack").applyInArrow(_pack, "pack INT, block BINARY, id BINARY, k BINARY, bound BINARY, vector BINARY"))


def _pairs_of_packs(index: Index, targets: DataFrame) -> DataFrame | None:
    """Each pack of targets (id, vector, k, bound) beside each of the index; none without targets."""
    spark = targets.sparkSession
    shared = spark.sparkContext.broadcast(index.pivots)
    more = ("k", "bound")
    placed = written(targets.mapInArrow(_assign(shared, 1, more), "block INT, angle DOUBLE, salt BIGINT, id BIGINT, vector ARRAY<DOUBLE>, k BIGINT, bound DOUBLE"))
    counts = {r["block"]: r["count"] for r in placed.groupBy("block").count().collect()}
    if not counts:
        return None
    left = _packed(placed, counts, index.part_rows)
    plain = index.rows.withColumns({"k": F.lit(0).cast("long"), "bound": F.lit(0.0)})
    right = _packed(plain, dict(zip(index.blocks.tolist(), index.counts.tolist(), strict=True)), index.part_rows)
    left = left.select(*(F.col(c).alias(f"target_{c}") for c in ("pack", "id", "k", "bound", "vector")))
    return left.hint("shuffle_replicate_nl").crossJoin(right.select("block", "id", "vector"))


def _row(batch, r: int, column: str, kind: str) -> np.ndarray:
    return np.frombuffer(batch.column(column)[r].as_buffer(), kind)


def _found(names: np.ndarray, ids: np.ndarray, similarity: np.ndarray):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(ids), pa.array(similarity)], names=["target_id", "candidate_id", "similarity"])


def _best_of_packs(shared, width: int):
    """The best candidates of each pack of targets, of the rows with it that follow each other."""

    def run(batches):
        pivots, blocks, low, high, _ = shared.value
        pack, kept = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                number = batch.column("target_pack")[r].as_py()
                if number != pack or len(kept[0]) > KEPT:
                    if pack is not None and len(kept[0]):
                        yield _found(names[kept[0]], kept[1], kept[2])
                    kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                if number != pack:
                    pack = number
                    names, k, bound = _row(batch, r, "target_id", "<i8").copy(), _row(batch, r, "target_k", "<i8").copy(), _row(batch, r, "target_bound", "<f8").copy()
                    q = _row(batch, r, "target_vector", "<f8").reshape(len(names), width).copy()
                ids, x, block = _row(batch, r, "id", "<i8"), _row(batch, r, "vector", "<f8").reshape(-1, width), _row(batch, r, "block", "<i8")
                here, at = np.unique(block, return_inverse=True)
                place = np.searchsorted(blocks, here)
                _, least, blank = _least_angles(q, pivots, here, low[place], high[place])
                asked = _can_beat(least, blank, bound, here)
                some, rows = np.flatnonzero(asked.any(axis=1)), np.flatnonzero(asked.any(axis=0)[at])
                if not len(some) or not len(rows):
                    continue
                i, j, similarity = best_of_block(ids[rows], x[rows], q[some], k[some], bound[some])
                at_once = tuple(np.concatenate(c) for c in zip(kept, (some[i], ids[rows][j], similarity), strict=True))
                kept = _best(at_once[0], np.arange(len(at_once[0])), at_once[2], at_once[1], k)
                # the k-th of those kept is a bound for what follows
                kept = (kept[0], at_once[1][kept[1]], kept[2])
                ends = np.flatnonzero(np.append(kept[0][1:] != kept[0][:-1], True)) if len(kept[0]) else np.zeros(0, np.int64)
                held = np.bincount(kept[0], minlength=len(k))[kept[0][ends]] if len(ends) else ends
                ends = ends[held == k[kept[0][ends]]]
                bound[kept[0][ends]] = np.fmax(bound[kept[0][ends]], np.where(np.isnan(kept[2][ends]), np.inf, kept[2][ends]))
        if pack is not None and len(kept[0]):
            yield _found(names[kept[0]], kept[1], kept[2])

    return run


def _runs(batches, width: int):
    """A pack of targets beside so many packs of the index as make a run: (ids, vectors) of both."""
    pack, held, size = None, [], 0
    for batch in batches:
        for r in range(batch.num_rows):
            number, ids = batch.column("target_pack")[r].as_py(), _row(batch, r, "id", "<i8")
            if held and (number != pack or len(names) * (size + len(ids)) > ORDERED):
                yield names, q, *map(np.concatenate, zip(*held, strict=True))
                held, size = [], 0
            if number != pack:
                pack, names = number, _row(batch, r, "target_id", "<i8").copy()
                q = _row(batch, r, "target_vector", "<f8").reshape(-1, width).copy()
            held.append((ids.copy(), _row(batch, r, "vector", "<f8").reshape(-1, width).copy()))
            size += len(ids)
    if held:
        yield names, q, *map(np.concatenate, zip(*held, strict=True))


def _by_similarity(similarity: np.ndarray) -> np.ndarray:
    """The places of ``ORDERED`` numbers at most, the least similar first, to some 37 bits: sorted as whole
    numbers, which takes a sixth of an argsort's time."""
    key = np.arange(len(similarity))
    for a in range(0, len(key), HANDED):
        some = np.clip(np.nan_to_num(similarity[a : a + HANDED]), -1.0, 1.0)
        key[a : a + HANDED] += ((some + 1.0) * (1 << 37)).astype(np.int64) * ORDERED
    key.sort()
    key &= ORDERED - 1
    return key


def _all_of_packs(width: int):
    """All pairs, each run of them by similarity: those that a query rounds to one number follow each other,
    so that Parquet writes them as repeats; one by one they would take eight bytes each."""

    def run(batches):
        for names, q, ids, x in _runs(batches, width):
            step = max(1, ORDERED // len(ids))
            for a in range(0, len(names), step):
                similarity = (q[a : a + step] @ x.T).ravel()
                order = _by_similarity(similarity)
                for b in range(0, len(order), HANDED):
                    some = order[b : b + HANDED]
                    i, j = np.divmod(some, len(ids))
                    yield _found(names[a + i], ids[j], similarity[some])

    return run


def similarities(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, candidate_id, similarity) of all pairs of (id, vector) tables."""
    index = indexed(candidates)
    pairs = _pairs_of_packs(index, _vectors(targets, F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("bound"))) if index.size else None
    if pairs is None:
        return candidates.sparkSession.createDataFrame([], _FOUND)
    return pairs.mapInArrow(_all_of_packs(index.width), _FOUND)


@dataclass
class Similar:
    """(target_id, candidate_id, similarity, rank); ``bounded``: the targets (id, vector, k, bound)."""

    found: DataFrame
    bounded: DataFrame | None
    index: Index

    def pruned_share(self) -> float:
        """The part of all pairs that the blocks' bounds left out."""
        if self.bounded is None:
            return 0.0
        asked = self.bounded.mapInArrow(_asked_pairs(_shared(self.index)), "pairs BIGINT, targets BIGINT").agg(F.sum("pairs").alias("pairs"), F.sum("targets").alias("targets")).first()
        return 1.0 - asked["pairs"] / (self.index.size * asked["targets"]) if asked["targets"] else 0.0


def _shared(index: Index):
    return index.rows.sparkSession.sparkContext.broadcast((index.pivots, index.blocks, index.low, index.high, index.counts))


def _ranked(found: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("similarity"), "candidate_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= F.col("k")).drop("k")


def top_of_index(index: Index, targets: DataFrame) -> Similar:
    """For targets (id, vector, k): the ``k`` most similar candidates each; ties go to the smaller id."""
    spark: SparkSession = targets.sparkSession
    wanted = _vectors(targets, F.least(F.col("k"), F.lit(index.size)).cast("long").alias("k")).filter("k > 0")
    none = spark.createDataFrame([], f"{_FOUND}, rank INT")
    if not index.size:
        return Similar(none, None, index)
    shared = _shared(index)
    sizes = dict(zip(index.blocks.tolist(), index.counts.tolist(), strict=True))
    size = wanted.select(F.col("id").alias("target_id"), "k")
    asks = written(wanted.mapInArrow(_asks(shared), "block INT, target_id BIGINT, k BIGINT, vector ARRAY<DOUBLE>"))
    first = _ranked(_met(index, asks, sizes).join(size, "target_id"))
    if len(index.blocks) == 1:
        return Similar(first, None, index)
    bounds = written(first.join(size, "target_id").filter("rank = k").select(F.col("target_id").alias("id"), F.col("similarity").alias("bound")))
    bounded = wanted.join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    # NaN is the greatest
    bounded = bounded.withColumn("bound", F.when(F.isnan("bound"), F.lit(float("inf"))).otherwise(F.col("bound")))
    pairs = _pairs_of_packs(index, bounded)
    if pairs is None:
        return Similar(none, None, index)
    found = pairs.mapInArrow(_best_of_packs(shared, index.width), _FOUND)
    return Similar(_ranked(found.join(size, "target_id")), bounded, index)


def top_similar(candidates: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """Each target's k most similar candidates (target_id, candidate_id, similarity, rank)."""
    return top_of_index(indexed(candidates), targets.withColumn("k", F.lit(k))).found


def quota(step: float, capacity: float, most: int) -> int:
    """How often a candidate can be taken before its weight, added up, exceeds the capacity; ``most`` is
    how often it can be taken at all."""
    if step * most * (1 + 1e-9) < capacity:
        return most
    weight, times = 0.0, 0
    while weight <= capacity and times < most:
        weight += step
        times += 1
    return times


#: A target's first list has so many candidates more than it wants.
SPARE = 16


@dataclass
class Matching:
    """(candidate_id, weight); of each target (target_id, want, asked, listed) how many candidates it
    wants, has asked and has had listed; the rounds that it took."""

    weights: DataFrame
    lists: DataFrame
    rounds: int


def matching(candidates: DataFrame, targets: DataFrame, capacity: float = 3.0) -> Matching:
    """Targets (id, vector, weight) in ascending id take their int(weight) most similar candidates that
    are not exhausted; each take adds candidates / sum of weights.

    The serial loop equals the stable matching in which candidates prefer earlier targets, so targets
    propose in parallel rounds: a candidate keeps its first ``quota`` targets, the others ask as many
    further ones as refused them. They pass over candidates that are full of earlier targets, which
    would refuse them as well. A target's list holds a few candidates more than it wants, and is made
    again, twice as long as asked, only for targets that need more than it holds. Once all candidates
    are full, targets after the last one held are done.
    """
    spark = candidates.sparkSession
    index = indexed(candidates)
    sums = targets.agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n")).first()
    n, total = index.size, sums["weight"]
    if not n or not total:
        return Matching(spark.createDataFrame([], "candidate_id BIGINT, weight DOUBLE"), spark.createDataFrame([], "target_id BIGINT, want BIGINT, asked BIGINT, listed BIGINT"), 0)
    step = n / float(total)
    most = quota(step, capacity, sums["n"])
    wants = targets.select(F.col("id").cast("long").alias("target_id"), F.least(F.floor("weight"), F.lit(n)).cast("long").alias("want"), "vector").filter("want > 0")
    state = written(wants.select("target_id", "want", F.col("want").alias("asked"), F.lit(0).cast("long").alias("listed")))
    lists = spark.createDataFrame([], f"{_FOUND}, rank INT")
    rounds = 0
    while True:
        rounds += 1
        short = state.filter("asked > listed").select("target_id", F.least(F.when(F.col("listed") == 0, F.col("asked") + SPARE).otherwise(F.col("asked") * 2), F.lit(n)).alias("k"))
        if not short.isEmpty():
            longer = top_of_index(index, wants.join(short, "target_id").select(F.col("target_id").alias("id"), "vector", "k")).found
            lists = written(lists.join(short, "target_id", "left_anti").unionByName(longer))
            state = state.join(short, "target_id", "left").select("target_id", "want", "asked", F.coalesce("k", "listed").alias("listed"))
        proposals = lists.join(state, "target_id").filter("rank <= asked").select("target_id", "candidate_id")
        held = written(capped(proposals, ["candidate_id"], most, ["target_id"]))
        full = held.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n"), F.max("target_id").alias("last")).filter(F.col("n") == most).select("candidate_id", "last")
        ends = full.agg(F.count(F.lit(1)).alias("n"), F.max("last").alias("last")).first()
        got = held.groupBy("target_id").agg(F.count(F.lit(1)).alias("got"))
        lacking = state.join(got, "target_id", "left").withColumn("missing", F.col("want") - F.coalesce("got", F.lit(0))).drop("got")
        ahead = lists.join(lacking.filter("missing > 0").select("target_id", "asked", "missing"), "target_id").filter("rank > asked")
        ahead = ahead.join(full, "candidate_id", "left").filter("last IS NULL OR last > target_id")
        place = F.row_number().over(Window.partitionBy("target_id").orderBy("rank"))
        steps = ahead.withColumn("place", place).filter("place <= missing").groupBy("target_id").agg(F.max("rank").alias("upto"), F.count(F.lit(1)).alias("found"))
        found = F.coalesce("found", F.lit(0))
        further = F.when(F.col("missing") == 0, F.col("asked")).when(found == F.col("missing"), F.col("upto")).otherwise(F.least(F.greatest("asked", "listed") + F.col("missing") - found, F.lit(n)))
        listed = F.col("listed")
        if ends["n"] == n:
            done = (F.col("missing") > 0) & (F.col("target_id") > ends["last"])
            further, listed = F.when(done, n).otherwise(further), F.when(done, n).otherwise(listed)
        after = written(lacking.join(steps, "target_id", "left").select("target_id", "want", further.cast("long").alias("asked"), listed.cast("long").alias("listed"), F.col("asked").alias("before")))
        state = after.drop("before")
        if after.filter("asked > before").isEmpty():
            break
    weights = held.groupBy("candidate_id").agg((F.count(F.lit(1)) * step).alias("weight"))
    return Matching(weights, state, rounds)


def match_to_targets(candidates: DataFrame, targets: DataFrame, capacity: float = 3.0) -> DataFrame:
    """(candidate_id, weight) of ``matching``."""
    return matching(candidates, targets, capacity).weights
