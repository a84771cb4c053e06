"""Rounds that follow each other: maintained history, replay, matching in the statements' order; ordered reading."""

import pytest
from pyspark.sql import functions as F

from tessera.operators.scoring import best_of_history
from tessera.plans import loop
from tessera.sources import records

SCORES = "statement_id STRING, method STRING, score DOUBLE, attempts BIGINT, successes BIGINT"


def scored(spark, root, r, rows):
    spark.createDataFrame([(s, "solve_rate", x, 4, int(4 * x)) for s, x in rows], SCORES).write.parquet(f"{root}/round={r:03d}/assessments")


def test_state_is_the_best_of_all_rounds(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    rounds = [[("a", 0.5), ("b", 0.0)], [("a", 0.25), ("b", 0.75), ("c", 0.0)], None, [("a", 0.5), ("c", 0.25)]]
    for r, rows in enumerate(rounds):
        if rows is not None:
            scored(spark, root, r, rows)
    every = spark.createDataFrame([(s, x, r, 0) for r, rows in enumerate(rounds) for s, x in rows or []], "statement_id STRING, score DOUBLE, round INT, ord BIGINT")
    for before in range(len(rounds) + 1):
        want = {r["statement_id"]: (r["score"], r["round"]) for r in best_of_history(every.filter(F.col("round") < before)).collect()}
        assert {r["statement_id"]: (r["score"], r["round"]) for r in loop.best_state(spark, root, before).collect()} == want
    # a further round reads the last state and its own scores alone
    scored(spark, root, 4, [("b", 1.0)])
    read = []
    real = loop.checkpointed
    monkeypatch.setattr(loop, "checkpointed", lambda s, t, name, r, build: (read.append((name, r)), real(s, t, name, r, build))[1])
    assert loop.best_state(spark, root, 5).filter("statement_id = 'b'").first()["score"] == 1.0
    assert read == [("best", 4), ("best", 3)]


def rounds(spark, root, settings, proofs, statements=4, embed=None, sft=None, train=None):
    rows = [(f"s{k}", f"theorem s{k} : p := by", None, ["l"], 1.0, "dataset", statements - k) for k in range(statements)]
    table = spark.createDataFrame(rows, "id STRING, statement STRING, header STRING, labels ARRAY<STRING>, matching_weight DOUBLE, source STRING, ord BIGINT")
    declarations = spark.createDataFrame([("foo", "lemma foo : q")], "full_name STRING, statement STRING")

    def prover(requests):
        # each round has proofs of its own
        text = F.concat(F.lit("simp"), F.col("seed").cast("string"))
        return requests.withColumn("proof", text).withColumn("raw_output", text).withColumn("duration_seconds", F.lit(1.0)).withColumn("generated_tokens", F.lit(3).cast("long"))

    def verifier(attempts):
        return attempts.withColumn("verified", proofs).withColumn("verify_seconds", F.lit(0.5)).withColumn("invoked_lemmas", F.array(F.lit("foo")))

    def conjecturer(prompts):
        return prompts.withColumn("text", F.concat(F.lit(" c"), F.col("ord").cast("string"), F.lit(" : q\n</hard theorem>")))

    return lambda r: loop.run_round(spark, root, r, table, declarations, settings, conjecturer, prover, verifier, sft, embed, (), train)


def test_earlier_rounds_are_replayed(spark, tmp_path):
    proofs = F.col("statement_id").isin("s1", "s2") & (F.col("attempt") == 0)
    counts = {}
    for replay in (1, 2):
        run = rounds(spark, str(tmp_path / str(replay)), loop.Settings(attempts=4, cap_fraction=1.0, threshold=0.5, trivial_chance=0.0, replay_rounds=replay), proofs)
        run(0)
        counts[replay] = {(r["kind"], r["round"], r["statement_id"]) for r in run(1)["examples"].collect()}
    # the proofs are the same in both rounds: of equal ones the earlier round's stays
    assert {k for k in counts[1] if k[0] == "proof"} == {("proof", 1, "s1"), ("proof", 1, "s2")}
    assert {k for k in counts[2] if k[0] == "proof"} == {("proof", 0, "s1"), ("proof", 0, "s2")}


def test_no_round_is_trained_without_examples(spark, tmp_path):
    metrics = lambda rows: rows.groupBy("kind").count()
    with pytest.raises(ValueError, match="no training examples"):
        rounds(spark, str(tmp_path / "a"), loop.Settings(attempts=1), F.lit(False), train=metrics)(0)
    sft = spark.createDataFrame([("p", "t", 1.0, "sft", "x", -1, 0)], "prompt STRING, target STRING, weight DOUBLE, kind STRING, statement_id STRING, round INT, ord BIGINT")
    assert rounds(spark, str(tmp_path / "b"), loop.Settings(attempts=1), F.lit(False), sft=sft, train=metrics)(0)["training_metrics"].first()["count"] == 1


def test_targets_are_served_in_the_statements_order(spark, tmp_path):
    seen = []

    def embed(rows):
        if "weight" in rows.columns:
            seen.append([r["text"] for r in rows.orderBy("id").collect()])
        return rows.withColumn("vector", F.array(F.lit(1.0), F.length("text").cast("double")))

    proofs = (F.col("statement_id") == "s1") & (F.col("attempt") == 0)
    rounds(spark, str(tmp_path), loop.Settings(attempts=2, threshold=0.5), proofs, embed=embed)(0)
    assert seen[0] == [f"theorem s{k} : p := by" for k in (3, 2, 0)]


def test_order_holds_beyond_many_tasks(spark, tmp_path, monkeypatch):
    """Places whose task's number is larger than a file's share of bits used to be."""
    rows = spark.range(0, 200).selectExpr("id AS a", "id AS ord").repartition(5)
    path = str(tmp_path / "out.jsonl")
    records.write_lines(rows, path)
    far = 1 << 22

    real = F.monotonically_increasing_id
    monkeypatch.setattr(records.F, "monotonically_increasing_id", lambda: real() + (F.lit(far).cast("long") * (1 << 33)))

    class Many:
        def getNumPartitions(self):  # noqa: N802
            return far + 100

    monkeypatch.setattr(type(rows), "rdd", property(lambda self: Many()))
    assert [r["a"] for r in records.read_lines(spark, path, "a INT").orderBy("ord").collect()] == list(range(200))
    # more pairs of files and tasks than can be named: those that there are get numbers
    monkeypatch.setattr(Many, "getNumPartitions", lambda self: 1 << 30)
    assert [r["a"] for r in records.read_lines(spark, path, "a INT").orderBy("ord").collect()] == list(range(200))
