"""Operators on small tables, and against plain loops with the same meaning."""

import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.functions import draw, numeric, text
from tessera.operators import evaluate, examples, matching, relation, scoring, tokens, tree
from tessera.plans import loop, providers
from tessera.sources import records
from tessera.streaming import append

ATTEMPT = "ord BIGINT, statement_id STRING, proof STRING, status STRING, raw_output STRING, multiplicity BIGINT, duration_seconds DOUBLE, generated_tokens BIGINT"


def test_equal_attempts_collapse(spark):
    rows = [(0, "s1", "simp", "proved", "r1", 1, 1.0, 5), (1, "s1", "simp", "proved", "r1", 1, 2.0, 5), (2, "s1", None, "failed", None, 1, 0.5, 0), (3, "s1", None, "failed", None, 1, 0.5, 0), (4, "s2", "ring", "failed", "r2", 1, 1.0, 1)]
    out = scoring.collapse_duplicates(spark.createDataFrame(rows, ATTEMPT))
    assert [(r.ord, r.multiplicity, r.duration_seconds) for r in out.orderBy("ord").collect()] == [(0, 2, 3.0), (2, 2, 1.0), (4, 1, 1.0)]
    assert {r.statement_id: r.score for r in scoring.solve_rates(out).collect()} == {"s1": 0.5, "s2": 0.0}


def test_frontier_scores_take_one_attempt(spark):
    rows = [("a", "proved", 0.5), ("b", "failed", 0.25)]
    df = spark.createDataFrame(rows, "statement_id STRING, status STRING, solve_rate DOUBLE")
    assert {(r.statement_id, r.score, r.successes) for r in scoring.frontier_scores(df).collect()} == {("a", 0.5, 1), ("b", 0.25, 0)}
    with pytest.raises(Exception, match="several searches"):
        scoring.frontier_scores(df.union(df)).collect()


def test_best_of_history_prefers_the_earliest(spark):
    df = spark.createDataFrame([("a", 0.5, 1, 0), ("a", 0.5, 0, 3), ("a", 0.2, 0, 1)], "statement_id STRING, score DOUBLE, round INT, ord INT")
    assert [(r.round, r.ord) for r in scoring.best_of_history(df).collect()] == [(0, 3)]


@pytest.mark.parametrize("seed", range(4))
def test_pair_then_cap_is_the_loop(spark, seed):
    rnd = random.Random(seed)
    rows = [(k, rnd.randrange(5), rnd.randrange(4)) for k in range(60)]
    kept, counts, used = [], {}, set()
    for k, s, lemma in rows:
        if (s, lemma) not in used and counts.get(lemma, 0) < 3:
            used.add((s, lemma))
            counts[lemma] = counts.get(lemma, 0) + 1
            kept.append(k)
    df = spark.createDataFrame(rows, "ord INT, s INT, lemma INT")
    assert sorted(r.ord for r in relation.distinct_then_capped(df, ["s", "lemma"], ["lemma"], 3, ["ord"]).collect()) == kept


@pytest.mark.parametrize("values", [[], [1.0], [3.0, 1.0, 2.0, 2.0], [5.0] * 9, [k / 7 for k in range(500)]])
def test_cutoff_is_the_sorted_place(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v DOUBLE")
    for fraction in (0.0, 0.2, 0.5, 1.0):
        want = sorted(values)[min(int(len(values) * fraction), len(values) - 1)] if values else float("inf")
        assert relation.cutoff(df, "v", fraction) == want


def test_first_last_and_unions(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, "y"), (3, "k", "z")], "ord INT, k STRING, v STRING")
    assert {r.v for r in relation.first_wins(df, ["k"], ["ord"]).collect()} == {"x", "z"}
    assert {r.v for r in relation.last_wins(df, ["k"], ["ord"]).collect()} == {"y", "z"}
    other = df.withColumn("v", F.lit("other"))
    assert {r.v for r in relation.union_first_wins([other, df], ["k"], ["ord"]).collect()} == {"other"}
    with pytest.raises(ValueError):
        relation.require_unique(df, ["k"])
    with pytest.raises(ValueError):
        relation.require_fk(df, ["k"], df.filter("k IS NULL"))
    with pytest.raises(Exception, match="domain"):
        relation.require_domain(df, "v", ["x", "y"]).collect()
    assert relation.top(df, ["ord"], 0).count() == 3 and relation.top(df, ["ord"], 2).count() == 2


@pytest.mark.parametrize(
    ("raw", "want"),
    [("theorem a : p := by", "theorem a : p := by"), ("theorem a : p :=  by \n", "theorem a : p := by"), ("theorem a : p :=", "theorem a : p := by"), ("theorem a : p := by sorry", "theorem a : p := by"), ("theorem sorry1 : p := by sorry", "theorem sorry1 : p := by")],
)
def test_canonical_statements(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t STRING")
    assert df.select(text.canonical_statement(F.col("t"))).first()[0] == want
    assert df.select(text.sorry_form(F.col("t"))).first()[0] == want + " sorry"


def test_statements_without_an_ending_raise(spark):
    with pytest.raises(Exception, match="without := by"):
        spark.createDataFrame([("theorem a : p",)], "t STRING").select(text.canonical_statement(F.col("t"))).collect()


def test_text_functions(spark):
    one = lambda c, **v: spark.createDataFrame([Row(**v)]).select(c).first()[0]
    assert one(text.parse_conjecture(F.col("t")), t=" x : p := rfl\n</hard theorem> y") == "theorem x : p := by"
    assert one(text.parse_conjecture(F.col("t")), t="x : p\n</hard theorem>") == "theorem x : p:= by"
    assert one(text.conjecture_target(F.col("t")), t="theorem a : p := by") == "\ntheorem a : p\n</hard theorem>"
    assert one(text.remove_comments(F.col("t")), t="a /- b\nc -/ d -- e\nf") == "a   d  \nf"
    assert one(text.mask_comments(F.col("t")), t="a /-é-/ b --🙂\nc") == "a " + 5 * " " + " b " + 3 * " " + "\nc"
    assert one(text.unfenced(F.col("t")), t="simp\n```\nrest") == "simp"
    assert one(text.prover_prompt(F.col("t"), F.lit("")), t=" x ") == text.CODE_PROMPT + "x"
    assert one(text.declaration_name(F.col("t")), t="lemma foo.bar (x) : p") == "foo.bar"
    assert one(numeric.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 0.0]) != one(numeric.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 0.0]) == 1.0


def test_proofs_are_found_behind_their_declaration(spark):
    statement = "/- c := by -/ theorem  t : p := by"
    replies = {
        "```lean4\ntheorem t : p := by\n  simp\n```": "simp",
        "```lean4\nx\n```\n```lean4\n-- é note\ntheorem t  : p := by -- why\n  simp -- so\n```": "-- why\n  simp -- so",
        "```lean4\ntheorem u : p := by\n  simp\n```": None,
        "```lean4\ntheorem t : p := by\n```": None,
        "no block": None,
    }
    df = spark.createDataFrame([(r, statement) for r in replies], "r STRING, s STRING")
    assert {x.r: x.p for x in df.select("r", text.extract_proof(F.col("r"), F.col("s")).alias("p")).collect()} == replies


def test_draws_are_uniform_and_repeatable(spark):
    df = spark.range(4000).select(draw.uniform(3, "a", "id").alias("u"), draw.uniform(3, "b", "id").alias("v"))
    low, high, mean = df.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= low < high < 1 and abs(mean - 0.5) < 0.03 and abs(df.stat.corr("u", "v")) < 0.06


def serial_matching(similar, weights, capacity):
    n = len(similar[0])
    total, got, active = sum(weights), [0.0] * n, [True] * n
    for row, w in zip(similar, weights, strict=True):
        free = [c for c in range(n) if active[c]]
        for c in sorted(free, key=lambda c: (-row[c], c))[: min(int(w), len(free))]:
            got[c] += n / total
            active[c] = got[c] <= capacity
    return {c: w for c, w in enumerate(got) if w > 0}


@pytest.mark.parametrize("seed", range(3))
def test_matching_is_the_serial_loop(spark, seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(12, 4)), rng.normal(size=(9, 4))
    weights = [float(x) for x in rng.choice([0.5, 1.0, 2.0, 3.0, 5.0], 9)]
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = serial_matching((unit(b) @ unit(a).T).tolist(), weights, 1.5)
    candidates = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(a)], "id BIGINT, vector ARRAY<DOUBLE>")
    targets = spark.createDataFrame([(k, v.tolist(), w) for k, (v, w) in enumerate(zip(b, weights, strict=True))], "id BIGINT, vector ARRAY<DOUBLE>, weight DOUBLE")
    got = {r.candidate_id: r.weight for r in matching.match_to_targets(candidates, targets, 1.5).collect()}
    assert got == pytest.approx(want)


def test_similarities_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(5)], "id BIGINT, vector ARRAY<DOUBLE>")
    want = sorted(matching.top_similar(rows, rows, 2).collect())
    monkeypatch.setattr(matching, "BLOCK_BYTES", 32)
    assert sorted(matching.top_similar(rows, rows, 2).collect()) == want and len(want) == 10


def node(i, kind, value, proven, *children):
    return {"id": i, "node_type": kind, "value": value, "proven": proven, "children": [{"action": f"a{c}", "node_id": c} for c in children]}


TREE = "tree_id INT, tree STRUCT<root_id BIGINT, nodes ARRAY<STRUCT<id BIGINT, node_type STRING, value DOUBLE, proven BOOLEAN, children ARRAY<STRUCT<action STRING, node_id BIGINT>>>>>"


def projected(spark, *nodes):
    df = spark.createDataFrame([(1, {"root_id": 0, "nodes": list(nodes)})], TREE)
    return tree.project(spark, *tree.node_tables(df), depth=300)


def test_trees(spark):
    small = projected(spark, node(0, "OR", 0.0, True, 1, 4), node(1, "AND", 0.0, False, 2, 3), node(2, "OR", -3.0, True), node(3, "OR", -7.0, False), node(4, "OR", 0.0, False))
    assert [r.id for r in small.orderBy("node").collect()] == [0, 3, 4]
    rate = tree.frontier_rate(small).first()
    assert (rate.solved_frontier_nodes, rate.total_frontier_nodes, rate.solve_rate) == (1, 1, 1.0)
    single = tree.frontier_rate(projected(spark, node(0, "OR", 0.0, False))).first()
    assert (single.total_frontier_nodes, single.solve_rate) == (1, 0.0)
    tie = projected(spark, node(0, "OR", 0.0, True, 1), node(1, "AND", 0.0, True, 3, 2), node(2, "OR", 1.0, True), node(3, "OR", 1.0, True))
    assert [r.id for r in tie.orderBy("node").collect()] == [0, 3]
    shared = projected(spark, node(0, "OR", 0.0, True, 1, 2), node(1, "OR", 0.0, True, 3), node(2, "OR", 0.0, True, 3), node(3, "OR", 0.0, True))
    assert [r.id for r in shared.orderBy("node").collect()] == [0, 1, 3, 2, 3]
    chain = projected(spark, *(node(k, "OR", 0.0, True, k + 1) for k in range(150)), node(150, "OR", 0.0, True))
    assert chain.count() == 151
    with pytest.raises(Exception, match="without children"):
        projected(spark, node(0, "OR", 0.0, True, 1), node(1, "AND", 0.0, True)).collect()


def test_token_rows(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [5, 6])], "p ARRAY<INT>, t ARRAY<INT>")
    for most, ids, labels in ((9, [1, 2, 3, 4, 5, 6, 0], [-100] * 4 + [5, 6, 0]), (5, [3, 4, 5, 6, 0], [-100] * 2 + [5, 6, 0]), (2, [5, 6], [5, 6])):
        assert tuple(df.select(*tokens.encode_example(F.col("p"), F.col("t"), 0, most)).first()) == (ids, labels)
    batch = spark.createDataFrame([(0, [1], [1]), (0, [1, 2, 3], [1, 2, 3])], "batch INT, input_ids ARRAY<INT>, labels ARRAY<INT>")
    padded = tokens.collate(batch, 9).orderBy(F.size(F.filter("input_ids", lambda t: t == 9)).desc()).first()
    assert (padded.input_ids, padded.labels, padded.attention_mask) == ([1, 9, 9], [1, -100, -100], [1, 0, 0])


def test_evaluation_helpers(spark):
    rows = spark.createDataFrame([("p", 1, "b"), ("p", 0, "a"), ("q", 0, "c")], "problem_id STRING, ord INT, status STRING")
    nested = evaluate.nested_results(rows)
    assert {r.problem_id: [a.status for a in r.attempts] for r in nested.collect()} == {"p": ["a", "b"], "q": ["c"]}
    assert sorted(map(tuple, evaluate.unnested_results(nested).collect())) == [("p", 0, "a"), ("p", 1, "b"), ("q", 0, "c")]
    problems = spark.createDataFrame([("p",), ("q",), ("r",)], "problem_id STRING")
    assert [r.problem_id for r in evaluate.remaining(problems, evaluate.completed(nested, problems)).collect()] == ["r"]
    with pytest.raises(Exception, match="no result"):
        evaluate.join_results(spark.createDataFrame([("x",)], "request_id STRING"), spark.createDataFrame([("y", 1)], "request_id STRING, ord INT")).collect()
    with pytest.raises(ValueError):
        evaluate.zip_strict(rows, rows.limit(1))


def test_json_sources(spark, tmp_path):
    lines = tmp_path / "a.jsonl"
    lines.write_text('{"formal_statement": "theorem a : p :="}\n\n{"formal_statement": "theorem b : p := by", "tags": ["x", ""], "split": "test"}\n')
    array = tmp_path / "b.json"
    array.write_text(json.dumps([{"formal_statement": "theorem c : p := by sorry", "header": "H"}]))
    config = tmp_path / "c.json"
    config.write_text(json.dumps([{"dataset_path": "a.jsonl", "label": ["l"], "weight": 2}, {"dataset_path": str(array)}]))
    got = records.load_statements(spark, str(config), str(tmp_path)).orderBy("ord").collect()
    assert [(r.statement, r.labels, r.matching_weight) for r in got] == [("theorem a : p := by", ["l"], 2.0), ("theorem b : p := by", ["test", "x", "l"], 2.0), ("theorem c : p := by", [], 1.0)]
    other = tmp_path / "d.json"
    other.write_text("{}")
    with pytest.raises(Exception, match="not a JSON array"):
        records.read_records(spark, str(other), records.STATEMENT_RECORD).collect()


def test_torn_tails(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    assert records.read_resumable(spark, str(path), "a INT").count() == 0
    path.write_text('{"a": 1}\n{"a": 2}\n\n{"a": 3')
    assert [r.a for r in records.read_resumable(spark, str(path), "a INT").orderBy("ord").collect()] == [1, 2]
    path.write_text('{"a": 1}\n{"a"\n{"a": 3}\n')
    with pytest.raises(ValueError, match="damaged"):
        records.read_resumable(spark, str(path), "a INT")


def test_typed_records_manifests_and_checkpoints(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.LongType(), False), T.StructField("b", T.StringType())])
    df = spark.createDataFrame([(1, 5)], "a INT, x INT")
    assert records.typed(df, schema, {"b": "z"}).collect() == [Row(a=1, b="z")]
    with pytest.raises(Exception, match="without a"):
        records.typed(df.drop("a"), schema).collect()
    manifest = str(tmp_path / "m.json")
    records.write_manifest(manifest, {"rev": "1"})
    assert records.check_manifest(manifest, {"rev": "1"})["artifact_schema"] == 2
    with pytest.raises(ValueError, match="stale"):
        records.check_manifest(manifest, {"rev": "2"})
    built = []
    build = lambda: built.append(1) or df
    for _ in range(2):
        assert records.checkpointed(spark, str(tmp_path / "run"), "phase", 3, build).count() == 1
    assert len(built) == 1


def test_stream_appends_each_key_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([(1, "a"), (1, "b"), (2, "c")], [(2, "d"), (3, "e")]):
        spark.createDataFrame(part, "k INT, v STRING").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k INT, v STRING").parquet(source)
        append.insert_if_absent(stream, out, ["k"], ["v"], str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted((r.k, r.v) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "c"), (3, "e")]


def test_conjecture_reasons(spark):
    rows = [(0.0, "x", 1, True), (0.9, "x", 1, True), (0.3, "", 1, False), (0.3, "", 0, False), (0.3, "x", 2, False), (0.3, "x", 2, True)]
    df = spark.createDataFrame(rows, "rate DOUBLE, lemma STRING, successes BIGINT, reused BOOLEAN")
    got = df.select(examples.rejection_reason(F.col("rate"), 0.5, F.col("lemma") == "", F.col("successes"), F.col("reused")).alias("r")).collect()
    assert [r.r for r in got] == ["pass_rate", "pass_rate", None, "lemma_not_reused", "lemma_not_reused", None]


def test_rounds_run_once(spark, tmp_path):
    statements = spark.createDataFrame([(f"s{k}", f"theorem s{k} : p := by", None, ["l"], 1.0, "dataset", k) for k in range(4)], "id STRING, statement STRING, header STRING, labels ARRAY<STRING>, matching_weight DOUBLE, source STRING, ord BIGINT")
    declarations = spark.createDataFrame([("foo", "lemma foo : q")], "full_name STRING, statement STRING")
    calls = []

    def prover(requests):
        calls.append("p")
        proof = F.when(F.col("attempt") % 2 == 0, F.lit("simp"))
        return requests.withColumn("proof", proof).withColumn("raw_output", F.col("proof")).withColumn("duration_seconds", F.lit(1.0)).withColumn("generated_tokens", F.lit(3).cast("long"))

    def verifier(attempts):
        odd = F.substring("statement_id", 2, 1).isin("1", "2")
        return attempts.withColumn("verified", odd).withColumn("verify_seconds", F.lit(0.5)).withColumn("invoked_lemmas", F.array(F.lit("foo")))

    def conjecturer(prompts):
        return prompts.withColumn("text", F.concat(F.lit(" c"), F.col("ord").cast("string"), F.lit(" : q\n</hard theorem>")))

    settings = loop.Settings(attempts=2, cap_fraction=1.0, threshold=0.5, trivial_chance=0.0)
    run = lambda r: loop.run_round(spark, str(tmp_path), r, statements, declarations, settings, conjecturer, prover, verifier)
    first = run(0)
    assert first["summary"].first().solver_attempts == 8 and first["summary"].first().solved_statements == 2
    assert first["examples"].count() == 2 and first["conjectures"].count() == 0
    second = run(1)
    assert second["conjecture_inputs"].count() == 2 and second["conjectures"].count() == 2
    before = len(calls)
    assert run(1)["examples"].count() == second["examples"].count() and len(calls) == before


def test_recorded_providers(spark):
    answers = spark.createDataFrame([("a", "old", 0), ("a", "new", 1)], "k STRING, v STRING, ord INT")
    ask = providers.recorded(answers, "k")
    assert sorted((r.k, r.v) for r in ask(spark.createDataFrame([("a",), ("b",)], "k STRING")).collect()) == [("a", "new"), ("b", None)]


def test_checker_source_takes_texts_of_any_length(spark):
    rows = [(1, "x" * 5000, "en"), (2, "y" * 199, None), (3, None, None)]
    got = spark.createDataFrame(rows, "k INT, text STRING, proof STRING").select(text.checker_source(F.lit("h\n"), F.col("text"), F.col("proof"))).collect()
    assert [r[0] for r in got] == ["h\n" + "x" * 5000 + "\nen", "h\n" + "y" * 199 + "\n", "h\n\n"]


def test_checker_source_query_covers_every_document(spark):
    from tessera.catalogue import QUERIES

    got = QUERIES["checker_source"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert len(got) == docs.count() and max(r.n_chars for r in got) >= 200
    assert all(r.code_sha256 is not None for r in got)


def test_span_query_reads_whole_texts(spark):
    from tessera.catalogue import QUERIES

    lengths = {r.doc_id: r.n for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.length("text").alias("n")).collect()}
    got = QUERIES["span_extract"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(lengths) and max(r.start for r in got) > 1000
    assert any(r.finish == lengths[r.doc_id] > 200 for r in got)


def test_lines_of_many_files_keep_their_order(spark, tmp_path):
    rows = spark.range(0, 300).selectExpr("id AS a", "repeat('x', cast(id % 200 AS int)) AS t", "id AS ord").repartition(7)
    records.write_lines(rows, str(tmp_path / "out.jsonl"))
    back = records.read_lines(spark, str(tmp_path / "out.jsonl"), "a INT, t STRING")
    assert [r.a for r in back.orderBy("ord").collect()] == list(range(300))
    assert records.count_lines(spark, str(tmp_path / "out.jsonl")) == 300


def test_repeated_ids_do_not_fan_out(spark):
    attempts = spark.createDataFrame([("r1", "s", "p", "proved", 1.0, 1, 0)], "request_id STRING, statement_id STRING, proof STRING, status STRING, verify_seconds DOUBLE, multiplicity BIGINT, ord BIGINT")
    pool = spark.createDataFrame([("s", "theorem old := by", None, 0), ("s", "theorem new := by", None, 1)], "id STRING, statement STRING, header STRING, ord BIGINT")
    rates = spark.createDataFrame([("s", 0.1)], "statement_id STRING, score DOUBLE")
    got = examples.prover_examples(attempts, pool, rates, 0.5).collect()
    assert len(got) == 1 and "theorem new" in got[0].prompt
    twice = attempts.unionByName(attempts.withColumn("status", F.lit("failed")).withColumn("ord", F.lit(5).cast("long")))
    assert [r.status for r in evaluate.overlay_verified(attempts, twice).collect()] == ["failed"]
    with pytest.raises(Exception, match="different positions"):
        evaluate.zip_strict(spark.createDataFrame([(0,), (1,)], "ord INT"), spark.createDataFrame([(0,), (2,)], "ord INT")).collect()


def test_many_small_trees_have_no_bound_together(spark):
    n = 130_000
    nodes = spark.range(n * 9).selectExpr("concat('t', id div 9) AS tree_id", "id % 9 AS id", "'OR' AS node_type", "0D AS value", "true AS proven", "id % 9 = 0 AS is_root")
    edges = spark.range(n * 8).selectExpr("concat('t', id div 8) AS tree_id", "0L AS parent", "cast(id % 8 AS int) AS ord", "id % 8 + 1 AS child")
    out = tree.project(spark, nodes, edges, depth=4)
    assert out.count() == n * 9 and out.agg(F.max("node")).first()[0] == 8


def test_searches_become_attempts(spark):
    tree_of = "STRUCT<root_id BIGINT, nodes ARRAY<STRUCT<id BIGINT, node_type STRING, value DOUBLE, proven BOOLEAN, children ARRAY<STRUCT<action STRING, node_id BIGINT>>>>>"
    requests = spark.createDataFrame([("q1", "s1", 0, 7, 0), ("q2", "s2", 0, 8, 1)], "id STRING, statement_id STRING, attempt BIGINT, seed BIGINT, ord BIGINT")
    leaf = (0, [(0, "OR", 0.0, True, [("a", 1)]), (1, "OR", 0.0, False, [])])
    results = spark.createDataFrame([("q1", "proved", "simp", 2.0, None, None, leaf, 0), ("q2", "failed", None, 3.0, 5, 0.5, leaf, 1)], f"request_id STRING, status STRING, proof STRING, duration_seconds DOUBLE, generated_tokens BIGINT, verify_seconds DOUBLE, tree {tree_of}, ord BIGINT")
    sent = []

    def verifier(rows):
        sent.append(rows.count())
        return rows.withColumn("verified", F.lit(True)).withColumn("verify_seconds", F.lit(9.0)).withColumn("invoked_lemmas", F.array(F.lit("foo")))

    got = {r.request_id: r for r in providers.searched(requests, results, verifier).collect()}
    assert sent == [1] and got["q1"].verify_seconds == 9.0 and got["q1"].status == "proved" and got["q1"].solve_rate == 1.0
    assert got["q2"].status == "failed" and got["q2"].generated_tokens == 5 and got["q2"].solver == "alphaproof"
    with pytest.raises(ValueError, match="unknown solver"):
        providers.dispatch("x", {})


def test_commands(spark, tmp_path, capsys):
    from tessera import cli

    (tmp_path / "t.json").write_text(json.dumps({"tree": {"root_id": 0, "nodes": [node(0, "OR", 0.0, True, 1), node(1, "OR", 0.0, False)]}}, default=lambda r: r.asDict(recursive=True) if hasattr(r, "asDict") else list(r)))
    args = cli.arguments(["tree", str(tmp_path / "t.json"), "--projected-tree-output", str(tmp_path / "p")])
    got = cli.run(spark, args)
    assert got["total_frontier_nodes"] == 1 and records.count_lines(spark, str(tmp_path / "p")) == 2
    (tmp_path / "d.jsonl").write_text('{"full_name": "b", "statement": "x"}\n{"full_name": "a", "statement": "y"}\n{"full_name": "b", "statement": "z"}\n')
    manifest = cli.run(spark, cli.arguments(["declarations", "--input", str(tmp_path / "d.jsonl"), "--output", str(tmp_path / "out.jsonl")]))
    assert manifest["declarations"] == 2 and json.loads((tmp_path / "out.jsonl.manifest.json").read_text())["artifact_schema"] == 2
    with pytest.raises(SystemExit):
        cli.arguments(["evaluate", "--attempts", "a", "--problems", "b", "--problem-index", "-1"])
    with pytest.raises(ValueError):
        records.single_name("a/b")
