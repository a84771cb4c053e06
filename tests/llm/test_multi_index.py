import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import multi_index
from tessera.llm.multi_index import Codebooks, closest, nearest, reach, share_needed

SCHEMA = "vec_id BIGINT, embedding ARRAY<DOUBLE>, rank STRING, vector INT, a INT, query_id STRING"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "r", 1, 2, "q") for i, v in rows], SCHEMA)


def found(spark, rows, k=10, every=100):
    out = {}
    for r in nearest(table(spark, rows), F.col("vec_id") % every == 0, k).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for hits in out.values():
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, len(hits) + 1))
    return {q: [(v, s) for _, v, s in hits] for q, hits in out.items()}


def serial(rows, k=10, every=100):
    """Every query against every row."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    sizes = [len(v) for _, v in good]
    width = min(sizes, key=lambda s: (-sizes.count(s), s)) if sizes else 0
    good = [(i, v) for i, v in good if len(v) == width]
    asks = {}
    for i, v in good:
        if i % every == 0 and (i not in asks or v.tolist() < asks[i].tolist()):
            asks[i] = v
    out = {}
    for q, x in asks.items():
        near = sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for i, v in good if i != q)[:k]
        if near:
            out[q] = [(i, s) for s, i in near]
    return out


def recall(got, want):
    assert got.keys() == want.keys()
    return sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) / sum(len(w) for w in want.values())


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_recall_and_scores(spark, monkeypatch, spread):
    """Clustered vectors and such without clusters, over a grid of many small parts."""
    monkeypatch.setattr(multi_index, "PART_ENTRIES", 50)
    monkeypatch.setattr(multi_index, "PART_QUERIES", 3)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 12))
    x = centres[rng.integers(0, 20, 4000)] + spread * 3 * rng.normal(size=(4000, 12))
    rows = list(enumerate(x.tolist()))
    got, want = found(spark, rows, every=50), serial(rows, every=50)
    assert recall(got, want) >= 0.9
    for q, hits in got.items():
        assert hits == sorted(hits, key=lambda h: (h[1], h[0])) and q not in {v for v, _ in hits}
        assert all(s == pytest.approx(np.sqrt(((x[q] - x[v]) ** 2).sum()), abs=1e-12) for v, s in hits)


def test_clusters_need_a_smaller_share():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16))
    near = centres[rng.integers(0, 40, 8000)] + 0.05 * rng.normal(size=(8000, 16))
    far = rng.normal(size=(8000, 16))
    shares = [share_needed(Codebooks(x[:4000], 32), x[4000:], 10) for x in (near, far)]
    assert shares[0] < 0.1 < shares[1] <= 1


def test_edges(spark):
    """Few rows are all shown, so that results are exact: ties, repeated rows, unusable vectors."""
    rows = [(0, [1, 0]), (1, [1, 0]), (2, [0, 1]), (3, None), (4, [0, 0]), (5, [None, 1]), (6, [float("nan"), 1]), (7, [float("inf"), 1]), (8, [1, 2, 3]), (9, []), (None, [1, 1])]
    rows += [(100, [5, 5]), (100, [2, 2]), (200, [0, 0]), (300, [1]), (10, [0, 1]), (10, [0, 1]), (11, [1e200, 1]), (400, [-1e200, 2])]
    got, want = found(spark, rows), serial(rows)
    assert got.keys() == want.keys() == {0, 100, 400}
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])


def test_hot_vector(spark):
    rows = [(k, [0.5, 0.5, 1.0, 2.0]) for k in range(600)] + [(600 + k, np.random.default_rng(k).normal(size=4).tolist()) for k in range(600)]
    got = found(spark, rows)
    assert got[0] == [(k, 0.0) for k in range(1, 11)] and got[500] == [(k, 0.0) for k in range(10)]
    assert recall({q: h for q, h in got.items() if q >= 600}, {q: h for q, h in serial(rows).items() if q >= 600}) >= 0.9


def test_without_candidates(spark):
    assert found(spark, []) == {} and found(spark, [(0, [1.0])]) == {} and found(spark, [(1, [1.0]), (2, [2.0])]) == {} and found(spark, [(0, [1.0]), (2, [2.0])]) == {0: [(2, 1.0)]}


def test_cells_come_by_summed_distance():
    rng = np.random.default_rng(2)
    one, two, counts = rng.random(9), rng.random(7), rng.integers(0, 4, (9, 7))
    for wanted in (1, 17, 10**9):
        got = {(a, int(b)) for a, bs in reach(one, two, counts, wanted) for b in bs}
        order = sorted((one[a] + two[b], a, b) for a in range(9) for b in range(7))
        held, want = 0, set()
        for _, a, b in order:
            if held >= wanted:
                break
            held += counts[a, b]
            want.add((a, b))
        assert {c for c in got if counts[c]} == {c for c in want if counts[c]}


def test_closest_ranks_by_exact_distance():
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(300, 5)), rng.normal(size=(4, 5))
    x[7] = x[250]
    i, j, s = closest(np.arange(300), x, np.array([7, 999, 998, 997]), q, np.ones((4, 300), bool), 6)
    for k in range(4):
        want = sorted((np.sqrt(((q[k] - x[m]) ** 2).sum()), m) for m in range(300) if (k, m) != (0, 7))[:6]
        assert [(a, b) for a, b in zip(s[i == k], j[i == k], strict=True)] == want
