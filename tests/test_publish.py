"""Versions with several writers, manifests on any file system, hashes of rows."""

import threading

import pytest
from pyspark.sql import functions as F

from tessera.sources import publish, records


def test_writers_lose_nothing(spark, tmp_path):
    root, errors = f"file://{tmp_path}/table", []

    def write(k):
        try:
            for j in range(4):
                publish.append(spark.createDataFrame([(k, j)], "k INT, j INT"), root)
        except Exception as e:  # seen below
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and publish.versions(spark, root) == list(range(16))
    assert sorted(tuple(r) for r in publish.read(spark, root).collect()) == [(k, j) for k in range(4) for j in range(4)]
    assert publish.read(spark, root, 0).count() == 1


def test_a_late_writer_tries_again(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/table"
    publish.append(spark.range(1), root)
    real, late = publish.create_text, []

    def first_another(s, path, text):
        if not late:
            late.append(path)
            assert real(s, path, publish.json.dumps({"folders": [*publish.newest(s, root)[1]["folders"], publish._written(spark.range(10, 12), root)]}))
        return real(s, path, text)

    monkeypatch.setattr(publish, "create_text", first_another)
    assert publish.append(spark.range(5, 6), root) == 2
    assert sorted(r[0] for r in publish.read(spark, root).collect()) == [0, 5, 10, 11]


def test_named_additions_and_overwrites(spark, tmp_path):
    root = f"file://{tmp_path}/table"
    with pytest.raises(ValueError):
        publish.read(spark, root)
    for _ in range(2):
        publish.append(spark.range(3), root, once="round 1")
    assert publish.read(spark, root).count() == 3 and publish.versions(spark, root) == [0]
    publish.overwrite(spark.range(7), root)
    publish.append(spark.range(3), root, once="round 1")
    assert publish.read(spark, root).count() == 7


def test_small_files(spark, tmp_path):
    path = f"file://{tmp_path}/deep/er/x.json"
    assert publish.create_text(spark, path, "é1") and not publish.create_text(spark, path, "2")
    assert publish.read_text(spark, path) == "é1"
    publish.write_text(spark, path, "3")
    assert publish.read_text(spark, path) == "3"
    assert sorted(p.name for p in (tmp_path / "deep" / "er").iterdir() if not p.name.endswith(".crc")) == ["x.json"]


def test_hashes_of_rows(spark):
    rows = [(1, "a", None, 0.5), (2, None, [1, None], float("nan")), (2, None, [1, None], float("nan"))]
    df = spark.createDataFrame(rows, "k INT, t STRING, v ARRAY<INT>, x DOUBLE")
    same = publish.content_hash(df)
    assert publish.content_hash(df.orderBy(F.desc("k")).repartition(3).select("x", "t", "k", "v")) == same
    for other in (df.limit(2), df.union(df.limit(1)), df.withColumn("k", F.col("k") + 1), df.withColumn("t", F.coalesce("t", F.lit("")))):
        assert publish.content_hash(other) != same
    assert publish.content_hash(df.limit(0)) == publish.content_hash(df.filter("k > 9"))


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_runs_keep_their_provenance(spark, tmp_path, scheme):
    config = tmp_path / "c.toml"
    config.write_text('[model]\nname = "m"\n[solver]\nkind = "llm"\n')
    root, table = f"{scheme}{tmp_path}/run", spark.range(20)
    start = lambda **more: records.start_run(root, str(config), **({"revisions": {"code": "1a"}, "toolchain": "t1", "tables": {"numbers": table}} | more))
    first = start()
    assert first["artifact_schema"] == 2 and first["base_model"] == "m" and first["solver"] == "llm" and first["revisions"] == {"code": "1a"}
    assert (tmp_path / "run" / "config.toml").read_text() == config.read_text()
    assert start(tables={"numbers": table.orderBy(F.desc("id")).repartition(5)}) == first
    for stale in ({"tables": {"numbers": table.union(spark.range(1))}}, {"toolchain": "t2"}, {"revisions": {"code": "2b"}}):
        with pytest.raises(ValueError, match="stale"):
            start(**stale)
