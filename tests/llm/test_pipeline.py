import corpus_pipeline as P


def test_stages_take_odd_rows(spark, docs, tmp_path):
    spark.createDataFrame([(0, 1, 0)], "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "a b c d e f g h")], "item_id BIGINT, text STRING").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    copies = P.drop_copies(spark, docs, "").collect()
    assert len({r.doc_id for r in copies}) == len(copies) and 77 not in {r.doc_id for r in copies}
    leaks = {r.doc_id for r in P.drop_leaks(spark, docs, str(tmp_path)).collect()}
    assert not leaks & {6, 7, 77} and {0, 1, 2, 3, 10, None} <= leaks
    near = {r.doc_id for r in P.drop_near_copies(spark, docs, "").collect()}
    assert 6 in near and 7 not in near and {0, 1, 2} <= near
    last = P.STAGES[-1][1](spark, docs, "")
    assert last.columns == ["doc_id", "n_tokens", "ids"] and last.count() == docs.count()


def test_run_keeps_one_of_each(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (2, text.replace(" ", "  ")), (3, text + " more"), (4, "a b c d e f g h i"), (5, "something else entirely here now")]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "A b c, d e f g h i")], "item_id BIGINT, text STRING").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r.doc_id for r in P.run(spark, str(tmp_path)).collect()) == [1, 5]
