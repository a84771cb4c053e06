import hashlib
import re
import zlib

from pyspark.sql import functions as F

from tessera.llm import digest_store, exact_dedup, sharding


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_equal_texts_share_the_smallest_id(docs):
    rows = docs.collect()
    groups = {}
    for r in rows:
        groups.setdefault(normal(r.text), []).append(r.doc_id)
    got = exact_dedup.deduplicate(docs).collect()
    assert len(got) == len(rows)
    want = sorted((str(r.doc_id), min((i for i in groups[normal(r.text)] if i is not None), default=None), len(groups[normal(r.text)]), hashlib.sha256(normal(r.text).encode()).hexdigest()) for r in rows)
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_a_second_batch_meets_the_index(spark, nothing):
    index = exact_dedup.digest_index(spark)
    one = spark.createDataFrame([(5, "a b"), (6, "c")], "doc_id BIGINT, text STRING")
    two = spark.createDataFrame([(1, "a\tb"), (2, "d"), (3, "d")], "doc_id BIGINT, text STRING")
    exact_dedup.deduplicate(one, index).collect()
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.deduplicate(two, index).collect()}
    assert got == {1: (5, False), 2: (2, True), 3: (2, False)}
    assert index.read().count() == 3
    again = exact_dedup.digest_index(spark, index.path)
    assert {r.doc_id for r in exact_dedup.deduplicate(two, again).filter("kept").collect()} == set()
    assert exact_dedup.deduplicate(nothing).count() == 0


def test_the_index_is_neither_shuffled_nor_sorted(spark):
    index = exact_dedup.digest_index(spark)
    rows = spark.range(500).selectExpr("sha2(cast(id AS string), 256) AS digest", "id AS keep_id")
    index.append(rows.filter("keep_id < 300"))
    for df in (index.missing(rows), rows.join(index.read().hint("merge"), "digest")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    assert sorted(r.keep_id for r in index.missing(rows).collect()) == list(range(300, 500))


def test_generations_merge_and_failed_appends_leave_no_trace(spark, monkeypatch):
    monkeypatch.setattr(digest_store, "GENERATIONS", 2)
    index = exact_dedup.digest_index(spark, buckets=4)
    for k in range(5):
        rows = spark.range(20 * k, 20 * k + 40).selectExpr("sha2(cast(id AS string), 256) AS digest", "id AS keep_id")
        index.append(index.missing(rows))
        index.append(index.missing(rows))
        assert index.read().count() == 20 * k + 40 and len(index.generations()) <= 2
    index._write(spark.createDataFrame([("x", 1)], "digest STRING, keep_id BIGINT"), False)  # never published
    assert exact_dedup.digest_index(spark, index.path, buckets=9).read().count() == 120
    assert {r.keep_id for r in index.known(index.read()).collect()} == set(range(120))


def test_of_two_writers_none_is_lost(spark, monkeypatch):
    one = exact_dedup.digest_index(spark)
    two = exact_dedup.digest_index(spark, one.path)
    rows = lambda a, b: spark.range(a, b).selectExpr("sha2(cast(id AS string), 256) AS digest", "id AS keep_id")
    one.append(rows(0, 10))
    real = one._publish

    def late(names, version):
        monkeypatch.setattr(one, "_publish", real)
        two.append(rows(10, 20))  # the other writer is first
        return real(names, version)

    monkeypatch.setattr(one, "_publish", late)
    one.append(rows(20, 30))
    assert sorted(r.keep_id for r in one.read().collect()) == list(range(30)) and one.version() == 3
    # the other merges what is being merged
    monkeypatch.setattr(digest_store, "GENERATIONS", 1)

    def merged_before(names, version):
        monkeypatch.setattr(one, "_publish", real)
        two._merge()
        return real(names, version)

    monkeypatch.setattr(one, "_publish", merged_before)
    one._merge()
    assert sorted(r.keep_id for r in two.read().collect()) == list(range(30)) and len(two.generations()) == 1
    assert len(two.vacuum()) == 4 and two.vacuum() == [] and one.read().count() == 30


def test_buckets_follow_the_counted_digests(spark, monkeypatch):
    monkeypatch.setattr(digest_store, "BUCKET_ROWS", 100)
    monkeypatch.setattr(digest_store, "LEAST_BUCKETS", 2)
    index = exact_dedup.digest_index(spark)
    rows = lambda a, b: spark.range(a, b).selectExpr("sha2(cast(id AS string), 256) AS digest", "id AS keep_id")
    index.append(rows(0, 50))
    index.append(rows(50, 700))
    assert sorted(int(n.split("-")[1]) for n in index.generations()) == [2, 8]
    found = index.look_up(rows(600, 900).select("digest", F.col("keep_id").alias("own"))).collect()
    assert sorted(r.own for r in found if r.found) == list(range(600, 700)) and all(r.keep_id == (r.own if r.found else None) for r in found)
    assert sorted(r.keep_id for r in index.missing(rows(0, 900)).collect()) == list(range(700, 900))
    index._merge()
    assert [int(n.split("-")[1]) for n in index.generations()] == [8] and index.read().count() == 700
    plan = index.look_up(rows(0, 900).select("digest"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_two_batches_give_what_one_gives(spark, tmp_path):
    rows = [(k, f"text {k % 7}" if k % 3 else f"own  {k}") for k in range(60)]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    order = lambda df: sorted(tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert order(exact_dedup.op6_digest_index(spark, str(tmp_path))) == order(exact_dedup.deduplicate(docs))


def test_every_row_has_a_place(docs, nothing):
    got = sharding.assign(docs, n_shards=4, n_slots=64).collect()
    assert len(got) == docs.count()
    for shard in range(4):
        places = sorted(r.slot for r in got if r.shard == shard)
        assert places == list(range(len(places)))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)
    assert sharding.assign(nothing).count() == 0


def test_bytes_are_near_equal_and_rebalancing_moves_little(spark):
    rows = spark.range(20_000).selectExpr("id AS doc_id", "repeat('x', cast(id % 97 AS int)) AS text")
    got = sharding.assign(rows, n_shards=8, n_slots=1024)
    loads = [r["sum(size)"] for r in got.groupBy("shard").sum("size").collect()]
    assert max(loads) <= 1.01 * min(loads)
    owner = sharding.balanced({s: 10 + s % 7 for s in range(1024)}, 1024, 8)
    grown = sharding.rebalanced(owner, {s: 10 + s % 7 for s in range(1024)}, 9)
    moved = [s for s in owner if owner[s] != grown[s]]
    assert 0 < len(moved) < 1024 / 9 * 1.2 and all(grown[s] == 8 for s in moved)


def test_versions_of_the_map_are_kept(spark):
    store = sharding.SlotMap(spark)
    store.write(0, {0: 0, 1: 1})
    store.write(1, {0: 1, 1: 1})
    assert [r.shard for r in store.read(0).orderBy("virtual_slot").collect()] == [0, 1]
    assert [r.shard for r in store.read(1).orderBy("virtual_slot").collect()] == [1, 1]


def test_records_move_with_their_slots_alone(spark):
    store = sharding.SlotMap(spark)
    rows = spark.range(6000).selectExpr("id AS doc_id", "repeat('y', cast(id % 53 AS int)) AS text", "id AS slot", "'z' AS shard")
    rows = rows.unionByName(spark.range(2000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'same' AS text", "id AS slot", "'z' AS shard"))
    shown = lambda n: sharding.assign(rows, n_shards=n, n_slots=256, store=store).filter("doc_id IS NOT NULL").collect()
    first = sharding.assign(rows, n_shards=5, n_slots=256, store=store)
    loads = [r["sum(size)"] for r in first.groupBy("shard").sum("size").collect()]
    assert max(loads) <= 1.1 * min(loads) and first.filter("doc_id IS NULL").select("virtual_slot").distinct().count() > 200
    before, grown, shrunk = first.filter("doc_id IS NOT NULL").collect(), shown(6), shown(3)
    assert store.newest() == 2
    for version, got in ((0, before), (1, grown), (2, shrunk)):
        owner = store.owners(version)
        assert all(owner[r.virtual_slot] == r.shard for r in got)
    old = {r.doc_id: (r.virtual_slot, r.shard) for r in before}
    assert all(old[r.doc_id][0] == r.virtual_slot for r in grown)
    assert sum(r.shard != old[r.doc_id][1] for r in grown) < 0.25 * len(grown)
    assert {r.shard for r in grown} == set(range(6)) and {r.shard for r in shrunk} == set(range(3))
