"""Similarities on the grid, and matching where candidates run out, against serial loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import matching


def frame(spark, m, ids=None, weights=None):
    ids = range(len(m)) if ids is None else ids
    if weights is None:
        return spark.createDataFrame([(int(k), [float(x) for x in v]) for k, v in zip(ids, m, strict=True)], "id BIGINT, vector ARRAY<DOUBLE>")
    return spark.createDataFrame([(int(k), [float(x) for x in v], float(w)) for k, v, w in zip(ids, m, weights, strict=True)], "id BIGINT, vector ARRAY<DOUBLE>, weight DOUBLE")


def serial_top(a, b, k):
    with np.errstate(invalid="ignore"):
        unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
        s = unit(b) @ unit(a).T
    s[np.isnan(s)] = np.inf
    return {t: sorted(range(len(a)), key=lambda c: (-round(s[t, c], 12), c))[: k[t]] for t in range(len(b))}


def clustered(rng, n, centres):
    return centres[rng.integers(0, len(centres), n)] + 0.05 * rng.normal(size=(n, centres.shape[1]))


def test_top_of_many_blocks_is_exact_and_pruned(spark, monkeypatch):
    """Small parts, so that blocks, rings and parts of the grid are many; ties and blank vectors too."""
    monkeypatch.setattr(matching, "BLOCK_BYTES", 8 * 8 * 20)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(25, 8))
    a, b = clustered(rng, 900, centres), clustered(rng, 70, centres)
    a[100:140] = a[7]
    a[200:203] = 0.0
    b[5] = 0.0
    k = [int(x) for x in rng.integers(1, 60, 70)]
    k[6] = 900
    index = matching.indexed(frame(spark, a))
    assert len(index.blocks) > 50
    targets = frame(spark, b).join(spark.createDataFrame(list(enumerate(k)), "id BIGINT, k BIGINT"), "id")
    similar = matching.top_of_index(index, targets)
    got = {}
    for r in similar.found.orderBy("target_id", "rank").collect():
        got.setdefault(r["target_id"], []).append(r["candidate_id"])
    assert got == serial_top(a, b, k)
    assert similar.pruned_share() > 0.5


def test_without_clusters_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK_BYTES", 8 * 6 * 30)
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(400, 6)), rng.normal(size=(40, 6))
    got = {}
    for r in matching.top_similar(frame(spark, a), frame(spark, b), 7).orderBy("target_id", "rank").collect():
        got.setdefault(r["target_id"], []).append(r["candidate_id"])
    assert got == serial_top(a, b, [7] * 40)


def test_all_pairs_meet_once(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK_BYTES", 8 * 3 * 7)
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(50, 3)), rng.normal(size=(31, 3))
    rows = matching.similarities(frame(spark, a), frame(spark, b)).collect()
    want = (b / np.linalg.norm(b, axis=1, keepdims=True)) @ (a / np.linalg.norm(a, axis=1, keepdims=True)).T
    assert len(rows) == len({(r[0], r[1]) for r in rows}) == 50 * 31
    assert all(r["similarity"] == pytest.approx(want[r["target_id"], r["candidate_id"]]) for r in rows)


def test_all_pairs_take_few_bytes_where_they_are_written(spark, tmp_path):
    """Rounded numbers that are written one by one take eight bytes each."""
    rng = np.random.default_rng(6)
    a, b = 4.0 + rng.normal(size=(1200, 12)), 4.0 + rng.normal(size=(1000, 12))
    matching.similarities(frame(spark, a), frame(spark, b)).withColumn("similarity", F.round("similarity", 6)).write.parquet(str(tmp_path / "pairs"))
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 6 * 1200 * 1000
    pairs = spark.read.parquet(str(tmp_path / "pairs"))
    assert pairs.count() == pairs.select("target_id", "candidate_id").distinct().count() == 1200 * 1000
    want = (b / np.linalg.norm(b, axis=1, keepdims=True)) @ (a / np.linalg.norm(a, axis=1, keepdims=True)).T
    some = pairs.filter("candidate_id % 100 = 7").collect()
    assert len(some) == 12 * 1000 and all(abs(r["similarity"] - want[r["target_id"], r["candidate_id"]]) < 6e-7 for r in some)


@pytest.mark.parametrize("ordered", [4, 32, 1 << 10])
def test_runs_hold_all_pairs_by_similarity(monkeypatch, ordered):
    """Runs of several packs and parts of one; vectors without direction too."""
    pa = pytest.importorskip("pyarrow")
    monkeypatch.setattr(matching, "ORDERED", ordered)
    monkeypatch.setattr(matching, "HANDED", 8)
    rng = np.random.default_rng(7)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    a, b = unit(rng.normal(size=(11, 3))), unit(rng.normal(size=(9, 3)))
    a[4], b[2] = np.nan, np.nan
    cut = lambda m, ends: [(np.arange(len(m))[i:j], m[i:j]) for i, j in zip(ends, ends[1:], strict=False)]
    raw = lambda x, kind: np.ascontiguousarray(x, kind).tobytes()
    rows = [(n, raw(t, "<i8"), raw(q, "<f8"), raw(c, "<i8"), raw(x, "<f8")) for n, (t, q) in enumerate(cut(b, [0, 5, 9])) for c, x in cut(a, [0, 3, 4, 8, 11])]
    names = ["target_pack", "target_id", "target_vector", "id", "vector"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[k : k + 3]]) for k in range(0, len(rows), 3)]
    got = [tuple(r.values()) for out in matching._all_of_packs(3)(batches) for r in out.to_pylist()]
    want = b @ a.T
    assert len(got) == len({r[:2] for r in got}) == 99
    assert all(s == pytest.approx(want[t, c], nan_ok=True) for t, c, s in got)
    plain = [s for _, _, s in got if not np.isnan(s)]
    falls = sum(x > y + 1e-9 for x, y in zip(plain, plain[1:], strict=False))
    assert ordered < 1 << 10 or falls == 1  # a run for each pack of targets


def test_what_is_written_grows_with_the_vectors(spark, monkeypatch):
    """Without clusters most targets ask most blocks: they are not written down for each of them."""
    monkeypatch.setattr(matching, "BLOCK_BYTES", 8 * 6 * 30)
    rows, real = [], matching.written

    def counted(df):
        out = real(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(matching, "written", counted)
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(600, 6)), rng.normal(size=(200, 6))
    a[:3] = 0.0
    index = matching.indexed(frame(spark, a))
    got = {}
    targets = frame(spark, b).withColumn("k", F.lit(2) + F.col("id") % 4)
    for r in matching.top_of_index(index, targets).found.orderBy("target_id", "rank").collect():
        got.setdefault(r["target_id"], []).append(r["candidate_id"])
    assert got == serial_top(a, b, [2 + t % 4 for t in range(200)])
    assert len(index.blocks) > 20 and sum(rows) < 3 * (600 + 200)


def test_nothing_on_a_side(spark):
    some, none = frame(spark, np.ones((3, 2))), frame(spark, np.ones((0, 2)))
    for a, b in ((some, none), (none, some), (none, none)):
        assert matching.top_similar(a, b, 2).count() == 0 and matching.similarities(a, b).count() == 0
        assert matching.match_to_targets(a, b.withColumn("weight", F.lit(1.0))).count() == 0


def serial_lists(s, weights, capacity):
    """The loop's weights, and how far down its list each target went."""
    n, total = s.shape[1], sum(weights)
    load, far = [0.0] * n, {}
    for t, w in enumerate(weights):
        order = sorted(range(n), key=lambda c: (-s[t, c], c))
        chosen = [p for p, c in enumerate(order) if load[c] <= capacity][: int(w)]
        for p in chosen:
            load[order[p]] += n / total
        if int(w) > 0:
            far[t] = chosen[-1] + 1 if len(chosen) == min(int(w), n) else n
    return {c: x for c, x in enumerate(load) if x > 0}, far


@pytest.mark.parametrize("capacity", [0.1, 1.2])
def test_matching_where_candidates_run_out(spark, capacity):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(4, 5))
    a, b = clustered(rng, 60, centres), clustered(rng, 50, centres)
    weights = [float(x) for x in rng.choice([0.4, 1.0, 2.0, 4.0], 50)]
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want, far = serial_lists(unit(b) @ unit(a).T, weights, capacity)
    got = matching.matching(frame(spark, a), frame(spark, b, weights=weights), capacity)
    assert {r["candidate_id"]: r["weight"] for r in got.weights.collect()} == pytest.approx(want)
    lists = got.lists.collect()
    assert {r["target_id"]: r["asked"] for r in lists} == far
    assert got.rounds < 30 and all(r["listed"] >= r["asked"] for r in lists)


def test_quota_is_counted_only_as_far_as_needed():
    assert matching.quota(0.5, 3.0, 100) == 7 and matching.quota(0.5, 3.0, 4) == 4 and matching.quota(0.5, 1e18, 9) == 9
