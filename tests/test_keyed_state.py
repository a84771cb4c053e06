"""Streams that stop and start again: nothing twice, nothing lost, no look at the sink."""

from pyspark.sql import functions as F

from tessera.streaming import keyed


def added(spark, source, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)


def test_first_rows_over_restarts(spark, tmp_path):
    source, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "k STRING, v INT"
    batches = [[("a", 3), ("a", 1), (None, 5), ("b", 2)], [("a", 0), ("c", 9), ("c", 7), (None, 1)], [("b", 1), ("c", 1)]]
    for k, rows in enumerate(batches):
        added(spark, source, rows, schema)
        stream = spark.readStream.schema(schema).parquet(source)
        if k == 2:  # the sink's rows are out of reach: the state alone knows the keys
            for p in (tmp_path / "out").glob("part-*"):
                p.rename(tmp_path / p.name)
        keyed.insert_if_absent(stream, out, ["k"], ["v"], str(tmp_path / "checkpoint")).awaitTermination()
    for p in tmp_path.glob("part-*"):
        p.rename(tmp_path / "out" / p.name)
    assert sorted(((r["k"], r["v"]) for r in spark.read.parquet(out).collect()), key=str) == [("a", 1), ("b", 2), ("c", 7), (None, 5)]


def test_best_rows_and_totals_over_restarts(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "s STRING, x DOUBLE, proof STRING, ord INT"
    batches = [[("a", 0.5, "p", 1), ("a", 0.5, "q", 0), ("b", None, "r", 2)], [("a", 0.25, "t", 3), ("b", 0.0, "u", 4)], [("a", 0.75, "v", 5), ("c", 1.0, "w", 6)]]
    seen = []
    for rows in batches:
        added(spark, source, rows, schema)
        seen += rows
        stream = spark.readStream.schema(schema).parquet(source)
        keyed.into_table(keyed.best_rows(stream, ["s"], "x", ["ord"]), str(tmp_path / "best"), ["s"], str(tmp_path / "c1")).awaitTermination()
        keyed.into_table(keyed.totals(stream, ["s"], ["x"]), str(tmp_path / "totals"), ["s"], str(tmp_path / "c2")).awaitTermination()
        want = {}
        for r in sorted(seen, key=lambda r: (r[1] is None, -(r[1] or 0), r[3])):
            want.setdefault(r[0], r)
        got = keyed.newest(spark, str(tmp_path / "best"), ["s"]).select("s", "x", "proof", "ord").collect()
        assert {tuple(r) for r in got} == set(want.values())
        sums = {r["s"]: (r["rows"], r["x"]) for r in keyed.newest(spark, str(tmp_path / "totals"), ["s"]).collect()}
        assert sums == {s: (sum(r[0] == s for r in seen), (lambda v: sum(v) if v else None)([r[1] for r in seen if r[0] == s and r[1] is not None])) for s in want}
    assert spark.read.parquet(str(tmp_path / "best")).agg(F.countDistinct("batch")).first()[0] == 3
