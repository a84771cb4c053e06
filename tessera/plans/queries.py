"""Queries over the test tables: the operators applied to the bindings, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import draw, numeric, text
from tessera.operators import conjectures as C
from tessera.operators import evaluate as E
from tessera.operators import examples as X
from tessera.operators import matching, relation, scan, scoring, tokens, tree
from tessera.plans import bindings as B
from tessera.plans import providers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SEED = B.SEED


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def _uniform(salt: str, key: str, seed: str = str(SEED)) -> str:
    return f"(CAST('0x' || substr(sha256(concat_ws('|', {seed}, '{salt}', {key})), 1, 13) AS BIGINT) / pow(2.0, 52))"


def _digest(salt: str, key: str, seed: str = str(SEED)) -> str:
    return f"sha256(concat_ws('|', {seed}, '{salt}', {key}))"


def _rates(spark, d):
    return scoring.solve_rates(B.attempts(spark, d))


# --- scoring ---------------------------------------------------------------------------------


@query(f"WITH {B.ATTEMPTS}, {B.RATES} SELECT statement_id, attempts, successes, round(score, 6) AS score FROM rates")
def solve_rate(spark, d):
    return scoring.solve_rates(scoring.collapse_duplicates(B.attempts(spark, d))).select("statement_id", "attempts", "successes", r6("score").alias("score"))


@query(
    f"""WITH {B.ATTEMPTS}
    SELECT statement_id, proof, status, raw_output, sum(duration_seconds) AS duration_seconds, CAST(sum(generated_tokens) AS BIGINT) AS generated_tokens,
           count(*) AS multiplicity, min(ord) AS ord
    FROM attempts GROUP BY statement_id, proof, status, raw_output"""
)
def dedup_attempts(spark, d):
    return scoring.collapse_duplicates(B.attempts(spark, d)).select("statement_id", "proof", "status", "raw_output", "duration_seconds", "generated_tokens", "multiplicity", "ord")


@query(
    f"""WITH {B.ATTEMPTS}, per AS (
      SELECT statement_id, round, count(*) FILTER (status = 'proved') / count(*) AS score FROM attempts GROUP BY 1, 2)
    SELECT statement_id, round, round(score, 6) AS score FROM per QUALIFY row_number() OVER (PARTITION BY statement_id ORDER BY score DESC, round) = 1"""
)
def max_history(spark, d):
    per = B.attempts(spark, d).withColumn("statement_id", F.struct("statement_id", "round"))
    rates = scoring.solve_rates(per).select(F.col("statement_id.statement_id").alias("statement_id"), F.col("statement_id.round").alias("round"), "score").withColumn("ord", F.lit(0))
    return scoring.best_of_history(rates).select("statement_id", "round", r6("score").alias("score"))


@query(SQL["max_history"])
def maintained_history(spark, d):
    """The same from states that each round merges its own scores into."""
    from tessera.plans.loop import best_state
    from tessera.plans.scratch import scratch_path

    root, every = scratch_path(spark, "history"), B.attempts(spark, d)
    for r in range(3):
        scoring.solve_rates(every.filter(F.col("round") == r)).write.parquet(f"{root}/round={r:03d}/assessments")
    return best_state(spark, root, 3).select("statement_id", F.col("round").cast("long").alias("round"), r6("score").alias("score"))


@query(
    f"""WITH {B.ATTEMPTS}, {B.RATES}, {B.STATEMENTS}
    SELECT id FROM statements LEFT JOIN rates ON id = statement_id
    WHERE coalesce(score, 0) < 0.35e0 OR {_uniform("select", "id")} < 0.05e0"""
)
def select_curriculum(spark, d):
    return scoring.select_curriculum(B.statements(spark, d), _rates(spark, d), SEED).select("id")


@query(
    f"""WITH {B.ATTEMPTS}, {B.RATES}, {B.STATEMENTS}
    SELECT id FROM statements LEFT JOIN rates ON id = statement_id
    WHERE coalesce(score, 0) < 0.35e0 OR {_uniform("select", "id")} < 0.05e0 ORDER BY {_digest("shuffle", "id")} LIMIT 500"""
)
def select_curriculum_limit(spark, d):
    return scoring.select_curriculum(B.statements(spark, d), _rates(spark, d), SEED, 500).select("id")


@query(f"WITH {B.ATTEMPTS}, {B.RATES}, {B.STATEMENTS} SELECT id FROM statements WHERE id NOT IN (SELECT statement_id FROM rates WHERE successes > 0)")
def unproved(spark, d):
    return scoring.unproved(B.statements(spark, d), _rates(spark, d)).select("id")


@query(
    f"""WITH {B.ATTEMPTS}, {B.RATES}, {B.STATEMENTS}
    SELECT s.solved, t.total, round(s.solved / t.total, 6) AS pass_at_k
    FROM (SELECT count(*) AS solved FROM rates WHERE successes > 0) s, (SELECT count(*) AS total FROM statements) t"""
)
def pass_at_k(spark, d):
    return scoring.pass_at_k(B.statements(spark, d), _rates(spark, d)).select("solved", "total", r6("pass_at_k").alias("pass_at_k"))


@query(f"WITH {B.ATTEMPTS}, {B.RATES} SELECT round(100.0e0 * count(*) FILTER (successes > 0) / count(*), 6) AS pass_percent FROM rates")
def pass_percent(spark, d):
    return scoring.pass_percent(_rates(spark, d)).select(r6("pass_percent").alias("pass_percent"))


@query(
    f"""WITH {B.ATTEMPTS}
    SELECT statement_id AS problem_id, 'llm' AS solver, count(*) AS attempts, count(*) FILTER (status = 'proved') AS successes,
           round(count(*) FILTER (status = 'proved') / count(*), 6) AS score, sum(duration_seconds) AS solver_seconds,
           round(sum(verify_seconds), 6) AS verification_seconds, round(sum(duration_seconds) + sum(verify_seconds), 6) AS total_seconds
    FROM attempts GROUP BY 1"""
)
def score_record(spark, d):
    out = scoring.score_records(B.attempts(spark, d))
    return out.select("problem_id", "solver", "attempts", "successes", r6("score").alias("score"), "solver_seconds", r6("verification_seconds").alias("verification_seconds"), r6("total_seconds").alias("total_seconds"))


@query(
    f"""WITH {B.ATTEMPTS}, {B.RATES}, {B.CONJECTURES}
    SELECT (SELECT count(*) FROM attempts) AS solver_attempts, (SELECT CAST(sum(generated_tokens) AS BIGINT) FROM attempts) AS generated_tokens,
           (SELECT sum(duration_seconds) FROM attempts) AS solver_seconds, (SELECT round(sum(verify_seconds), 3) FROM attempts) AS verification_seconds,
           (SELECT count(*) FROM rates WHERE successes > 0) AS solved_statements, (SELECT count(*) FROM orders) AS selected_statements,
           (SELECT count(*) FROM conjectures) AS conjectures"""
)
def round_summary(spark, d):
    out = scoring.round_summary(B.attempts(spark, d), B.statements(spark, d), B.conjectures(spark, d))
    return out.withColumn("verification_seconds", F.round("verification_seconds", 3))


@query(
    f"""WITH {B.ATTEMPTS}, small AS (
      SELECT statement_id, count(*) AS n, count(*) FILTER (status = 'proved') AS s, sum(duration_seconds) AS seconds, sum(verify_seconds) AS verify
      FROM attempts WHERE ord <= 3 GROUP BY 1 HAVING count(*) = 3),
    large AS (SELECT statement_id, CAST(status = 'proved' AS BIGINT) AS s, duration_seconds AS seconds FROM attempts WHERE ord = 4)
    SELECT a.statement_id AS problem_id, a.n AS retry_attempts, a.s AS retry_successes, round(a.s / a.n, 6) AS retry_rate, a.seconds AS retry_solver_seconds,
           round(a.verify, 6) AS retry_verification_seconds, b.s AS large_successes, b.seconds AS large_solver_seconds
    FROM small a JOIN large b USING (statement_id)"""
)
def retry_comparison(spark, d):
    every = B.attempts(spark, d)
    small = every.filter("ord <= 3")
    full = small.groupBy("statement_id").count().filter("count = 3").select("statement_id")
    out = scoring.compare_retries(small.join(full, "statement_id", "left_semi"), every.filter("ord = 4"), 3)
    return out.select(
        "problem_id", "retry_attempts", "retry_successes", r6("retry_rate").alias("retry_rate"), "retry_solver_seconds", r6("retry_verification_seconds").alias("retry_verification_seconds"), "large_successes", "large_solver_seconds"
    )


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS statement_id, 'alphaproof_hardest_subproblem' AS method, quality * 0.5e0 AS score, CAST(1 AS BIGINT) AS attempts, CAST(toxic AS BIGINT) AS successes FROM labels"""
)
def frontier_score(spark, d):
    searches = B.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("statement_id"), F.when(F.col("toxic") == 1, "proved").otherwise("failed").alias("status"), (F.col("quality") * 0.5).alias("solve_rate"))
    return scoring.frontier_scores(searches)


# --- conjectures -----------------------------------------------------------------------------

_SOURCES = f"""{B.ATTEMPTS}, {B.RATES}, {B.STATEMENTS}, sources AS (
  SELECT a.* FROM attempts a JOIN rates r USING (statement_id)
  WHERE status = 'proved' AND proof IS NOT NULL AND r.score > 0.35e0 AND statement_id IN (SELECT id FROM statements)
  QUALIFY row_number() OVER (PARTITION BY statement_id, proof ORDER BY ord) = 1)"""


def _sources(spark, d, lemmas=False):
    every = B.attempts(spark, d, lemmas)
    return C.proved_sources(every, B.statements(spark, d), scoring.solve_rates(every))


@query(f"WITH {_SOURCES} SELECT statement_id, proof, ord FROM sources")
def proved_sources(spark, d):
    return _sources(spark, d).select("statement_id", "proof", "ord")


@query(f"WITH {_SOURCES}, {B.DECLARATIONS} SELECT request_id, p_brand AS lemma FROM sources JOIN part ON p_partkey = l_partkey WHERE p_brand IN (SELECT full_name FROM declarations)")
def known_lemmas(spark, d):
    return C.known_lemmas(_sources(spark, d, True), B.declarations(spark, d)).select("request_id", "lemma")


_LEMMAS = f"""{_SOURCES}, {B.DECLARATIONS}, unproved AS (
  SELECT count(*) AS n FROM statements WHERE id NOT IN (SELECT statement_id FROM rates WHERE successes > 0)),
every AS (
  SELECT s.*, p_brand AS lemma FROM sources s JOIN part ON p_partkey = l_partkey WHERE p_brand IN (SELECT full_name FROM declarations)
  UNION ALL SELECT s.*, '' FROM sources s WHERE {_uniform("trivial", "request_id")} < 0.2e0),
shuffled AS (SELECT *, {_digest("shuffle", "request_id, lemma")} AS shuffle FROM every),
pair AS (SELECT * FROM shuffled QUALIFY row_number() OVER (PARTITION BY statement_id, lemma ORDER BY shuffle) = 1),
capped AS (SELECT pair.* FROM pair, unproved QUALIFY row_number() OVER (PARTITION BY lemma ORDER BY shuffle) <= ceil(0.005e0 * n))"""


@query(f"WITH {_LEMMAS} SELECT statement_id, lemma, request_id FROM capped")
def lemma_cap(spark, d):
    sources = _sources(spark, d, True)
    n = scoring.unproved(B.statements(spark, d), _rates(spark, d)).count()
    lemmas = C.known_lemmas(sources, B.declarations(spark, d)).select(*sources.columns, "lemma")
    every = lemmas.unionByName(sources.filter(draw.uniform(SEED, "trivial", "request_id") < 0.2).withColumn("lemma", F.lit("")))
    every = every.withColumn("shuffle", draw.shuffle_key(SEED, "shuffle", "request_id", "lemma"))
    cap = -int(-0.005 * n // 1)
    return relation.distinct_then_capped(every, ["statement_id", "lemma"], ["lemma"], cap, ["shuffle"]).select("statement_id", "lemma", "request_id")


@query(
    f"""WITH {_LEMMAS}, drawn AS (
      SELECT capped.*, s.statement, s.matching_weight, pow({_uniform("priority", "request_id, lemma")}, 1 / s.matching_weight) AS priority
      FROM capped JOIN statements s ON s.id = statement_id ORDER BY priority DESC, request_id, lemma LIMIT (SELECT n FROM unproved)),
    numbered AS (SELECT *, row_number() OVER (ORDER BY priority DESC, request_id, lemma) - 1 AS i FROM drawn)
    SELECT substr(sha256(request_id || chr(10) || lemma), 1, 20) AS id, statement_id AS seed_statement_id, statement AS seed_statement, proof AS seed_proof,
           request_id AS source_attempt_id, lemma AS shared_lemma, CASE WHEN lemma = '' THEN 'theorem true : True' ELSE concat('lemma ', lemma) END AS shared_lemma_statement,
           lemma = '' AS trivial_lemma, matching_weight, i + {SEED} AS generation_seed
    FROM numbered"""
)
def conjecture_inputs(spark, d):
    every = B.attempts(spark, d, True)
    rates = scoring.solve_rates(every)
    known = B.statements(spark, d)
    n = scoring.unproved(known, rates).count()
    out = C.conjecture_inputs(every, known, rates, B.declarations(spark, d), n, 0.2, 0.005, SEED)
    return out.drop("header", "labels").withColumn("generation_seed", F.col("generation_seed").cast("long"))


@query(f"WITH {B.STATEMENTS} SELECT id FROM statements ORDER BY pow({_uniform('priority', 'id')}, 1 / matching_weight) DESC, id LIMIT 200")
def weighted_sample(spark, d):
    return relation.weighted_top(B.statements(spark, d), draw.priority(SEED, "priority", "matching_weight", "id"), 200).select("id")


@query(
    f"""WITH {B.STATEMENTS} SELECT concat_ws(':', s.id, a) AS id, s.id AS statement_id, a AS attempt, {SEED} + s.ord * 4 + a AS seed
    FROM statements s, (SELECT unnest(range(4)) AS a)"""
)
def proof_requests(spark, d):
    return C.proof_requests(B.statements(spark, d), 4, SEED).select("id", "statement_id", "attempt", "seed")


@query("SELECT o_orderkey AS input, s AS sample, s * (SELECT count(*) FROM orders) + o_orderkey AS ord FROM orders, (SELECT CAST(unnest(range(3)) AS INT) AS s)")
def sample_major_cross(spark, d):
    inputs = B.conjectures(spark, d).limit(0).select("shared_lemma_statement", F.col("easy_statement").alias("seed_statement"), F.col("easy_proof").alias("seed_proof"), "ord")
    orders = B.table(spark, d, "orders").select(F.lit("l").alias("shared_lemma_statement"), F.lit("s").alias("seed_statement"), F.lit("p").alias("seed_proof"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("input"))
    return C.generation_prompts(inputs.unionByName(orders, allowMissingColumns=True), 3).select("input", "sample", "ord")


@query(
    f"""WITH {B.CONJECTURES}
    SELECT id, concat('Complete the following Lean 4 code:', chr(10), chr(10), '```lean4', chr(10), '<lemma>', chr(10), 'lemma l : True', chr(10), '<easy theorem>', chr(10),
                      'theorem e', id, ' := by simp', chr(10), '<hard theorem>', chr(10), ' theorem') AS prompt FROM conjectures"""
)
def prompt_render(spark, d):
    out = B.conjectures(spark, d)
    return out.select("id", text.conjecturer_prompt(F.col("shared_lemma_statement"), F.col("easy_statement"), F.col("easy_proof"), True).alias("prompt"))


@query(
    f"""WITH {B.STATEMENTS}
    SELECT id, concat('Complete the following Lean 4 code:', chr(10), chr(10), '```lean4', chr(10), CASE WHEN ord % 2 = 0 THEN concat('import H', chr(10)) ELSE
      concat('import Mathlib', chr(10), 'import Aesop', chr(10), 'set_option maxHeartbeats 0', chr(10), 'open BigOperators Real Nat Topology Rat', chr(10), chr(10)) END, statement) AS prompt
    FROM statements"""
)
def prover_prompt(spark, d):
    out = B.statements(spark, d).withColumn("header", F.when(F.col("ord") % 2 == 0, F.lit("import H\n")))
    return out.select("id", text.prover_prompt(F.col("statement"), F.col("header")).alias("prompt"))


_DOC_STATEMENT = "concat('  theorem d', doc_id, ' : p', CASE doc_id % 4 WHEN 0 THEN ' := by' WHEN 1 THEN ' :=  by ' || chr(10) WHEN 2 THEN ' :=' ELSE ' := by sorry' END)"


def _doc_statement() -> Column:
    key = F.col("doc_id")
    end = F.when(key % 4 == 0, " := by").when(key % 4 == 1, " :=  by \n").when(key % 4 == 2, " :=").otherwise(" := by sorry")
    return F.concat(F.lit("  theorem d"), key.cast("string"), F.lit(" : p"), end)


_CANONICAL = "concat('theorem d', doc_id, ' : p := by')"


@query(f"SELECT doc_id, {_CANONICAL} AS statement FROM (SELECT doc_id, {_DOC_STATEMENT} AS raw FROM documents)")
def canonical_statement(spark, d):
    return B.table(spark, d, "documents").select("doc_id", text.canonical_statement(_doc_statement()).alias("statement"))


@query(f"SELECT doc_id, concat({_CANONICAL}, ' sorry') AS statement FROM documents")
def sorry_form(spark, d):
    return B.table(spark, d, "documents").select("doc_id", text.sorry_form(_doc_statement()).alias("statement"))


@query("SELECT doc_id, substr(sha256(text), 1, 20) AS id FROM documents")
def stable_id(spark, d):
    return B.table(spark, d, "documents").select("doc_id", text.stable_id(F.col("text")).alias("id"))


@query("SELECT doc_id, concat('theorem x', doc_id, ' : ', lang, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE '' END, ':= by') AS statement FROM documents")
def parse_conjecture(spark, d):
    raw = F.concat(F.lit(" x"), F.col("doc_id").cast("string"), F.lit(" : "), "lang", F.when(F.col("doc_id") % 3 == 0, " := rfl := x").otherwise(""), F.lit("\n</hard theorem> more"))
    return B.table(spark, d, "documents").select("doc_id", text.parse_conjecture(raw).alias("statement"))


@query(
    f"""WITH {B.CONJECTURES}, parsed AS (
      SELECT substr(sha256(concat('theorem q', ord % 700, ':= by')), 1, 20) AS id, concat('theorem q', ord % 700, ':= by') AS statement, ord FROM conjectures)
    SELECT id, statement, min(ord) AS ord FROM parsed WHERE ord % 700 >= 50 GROUP BY 1, 2"""
)
def conjecture_dedup(spark, d):
    texts = B.conjectures(spark, d).withColumn("statement", text.parse_conjecture(F.concat(F.lit(" q"), (F.col("ord") % 700).cast("string"))))
    named = texts.withColumn("id", text.stable_id(F.col("statement"))).select("id", "statement", "ord")
    existing = spark.range(50).select(text.stable_id(F.concat(F.lit("theorem q"), F.col("id").cast("string"), F.lit(":= by"))).alias("id"))
    return relation.first_wins(relation.insert_if_absent(named, existing, ["id"]), ["id"], ["ord"])


@query(
    f"""WITH {B.STATEMENTS}
    SELECT id, concat_ws(',', CASE WHEN label <> 'P' THEN label END, CASE WHEN ord % 2 = 0 THEN 'tag' END, 'conjecture 1') AS labels FROM statements"""
)
def label_rewrite(spark, d):
    out = B.statements(spark, d)
    split = F.when(F.col("labels")[0] != "P", F.col("labels")[0]).otherwise("")
    built = text.dataset_labels(split, F.when(F.col("ord") % 2 == 0, F.array(F.lit("tag"))), F.array(F.lit("conjecture 0")))
    return out.select("id", F.array_join(text.conjecture_labels(built), ",").alias("labels"))


# --- examples --------------------------------------------------------------------------------


@query(
    f"""WITH {B.ATTEMPTS}, {B.RATES}
    SELECT statement_id, ord, round(exp(-0.001e0 * length(proof) - 0.01e0 * verify_seconds) / successes, 6) AS weight
    FROM attempts JOIN rates USING (statement_id) WHERE status = 'proved' AND proof IS NOT NULL"""
)
def success_share_weight(spark, d):
    out = X.with_success_counts(B.attempts(spark, d)).filter("status = 'proved' AND proof IS NOT NULL")
    return out.select("statement_id", "ord", r6(numeric.prover_weight(F.col("proof"), F.col("verify_seconds"), F.col("success_count"))).alias("weight"))


_PROVER = f"""{B.ATTEMPTS}, {B.RATES}, {B.STATEMENTS}, examples AS (
  SELECT a.statement_id, a.ord, a.round, proof AS target, s.statement, round(exp(-0.001e0 * length(proof) - 0.01e0 * verify_seconds) / successes, 6) AS weight
  FROM attempts a JOIN rates r USING (statement_id) JOIN statements s ON s.id = a.statement_id
  WHERE status = 'proved' AND proof IS NOT NULL AND r.score <= 0.5e0
  QUALIFY row_number() OVER (PARTITION BY a.statement_id, proof ORDER BY a.ord) = 1)"""


@query(f"WITH {_PROVER} SELECT statement_id, target, weight, 'proof' AS kind, ord FROM examples")
def prover_examples(spark, d):
    every = B.attempts(spark, d)
    out = X.prover_examples(every, B.statements(spark, d), scoring.solve_rates(every), 0.5)
    return out.select("statement_id", "target", r6("weight").alias("weight"), "kind", "ord")


_STATS = f"""{B.ATTEMPTS}, {B.RATES}, {B.CONJECTURES}, stats AS (
  SELECT c.id, c.statement, c.ord, c.shared_lemma, coalesce(any_value(r.score), 0) AS pass_rate,
         count(a.statement_id) AS successes, coalesce(bool_or(p_brand = c.shared_lemma), false) AS reused, min(length(a.proof)) AS minimum_proof_length
  FROM conjectures c LEFT JOIN rates r ON r.statement_id = c.id
  LEFT JOIN (SELECT * FROM attempts JOIN part ON p_partkey = l_partkey WHERE status = 'proved' AND proof IS NOT NULL) a ON a.statement_id = c.id
  GROUP BY 1, 2, 3, 4),
judged AS (
  SELECT *, CASE WHEN NOT (pass_rate > 0 AND pass_rate <= 0.5e0) THEN 'pass_rate' WHEN shared_lemma = '' AND successes > 0 THEN NULL
                 WHEN shared_lemma <> '' AND reused THEN NULL ELSE 'lemma_not_reused' END AS reason FROM stats),
cap AS (SELECT greatest(CAST(trunc(0.5e0 * count(*)) AS BIGINT), 1) AS n FROM judged WHERE reason IS NULL AND shared_lemma <> ''),
limited AS (
  SELECT judged.* REPLACE (CASE WHEN reason IS NULL AND shared_lemma = '' AND row_number() OVER (PARTITION BY reason, shared_lemma = '' ORDER BY {_digest("unfocused", "id")}) > n
                     THEN 'unfocused_cap' ELSE reason END AS reason) FROM judged, cap),
scored AS (SELECT *, CASE WHEN reason IS NULL THEN minimum_proof_length / length(statement) END AS elegance FROM limited),
least AS (SELECT min(elegance) AS v FROM (
  SELECT elegance, row_number() OVER (ORDER BY elegance) - 1 AS i, count(*) OVER () AS n FROM scored WHERE elegance IS NOT NULL)
  WHERE i = least(CAST(trunc(n * 0.2e0) AS BIGINT), n - 1)),
filtered AS (SELECT scored.* REPLACE (CASE WHEN reason IS NULL AND elegance < v THEN 'elegance' ELSE reason END AS reason) FROM scored, least)"""


def _filtered(spark, d):
    every = B.attempts(spark, d, True)
    return X.filter_conjectures(B.conjectures(spark, d), every, scoring.solve_rates(every), 0.5, 0.5, 1, 0.2, SEED)


@query(f"WITH {_STATS} SELECT id, round(pass_rate, 6) AS pass_rate, successes, reused, minimum_proof_length, reason FROM judged")
def conjecture_reason(spark, d):
    every = B.attempts(spark, d, True)
    stats = X.conjecture_stats(B.conjectures(spark, d), every).join(scoring.solve_rates(every).select(F.col("statement_id").alias("id"), "score"), "id", "left")
    rate = F.coalesce("score", F.lit(0.0))
    reason = X.rejection_reason(rate, 0.5, F.col("shared_lemma") == "", F.col("successes"), F.col("reused"))
    return stats.select("id", r6(rate).alias("pass_rate"), "successes", "reused", F.col("minimum_proof_length").cast("long").alias("minimum_proof_length"), reason.alias("reason"))


@query(f"WITH {_STATS} SELECT id FROM limited WHERE reason = 'unfocused_cap'")
def unfocused_cap(spark, d):
    return _filtered(spark, d).filter("rejection_reason = 'unfocused_cap'").select("id")


@query(f"WITH {_STATS} SELECT id, round(elegance, 6) AS elegance_score, reason AS rejection_reason FROM filtered")
def elegance_cutoff(spark, d):
    return _filtered(spark, d).select("id", r6("elegance_score").alias("elegance_score"), "rejection_reason")


@query(
    f"""WITH {_STATS} SELECT id AS statement_id, concat(chr(10), substr(statement, 1, length(statement) - 6), chr(10), '</hard theorem>') AS target, 'conjecture' AS kind
    FROM filtered WHERE reason IS NULL"""
)
def conjecturer_examples(spark, d):
    return X.conjecturer_examples(_filtered(spark, d)).select("statement_id", "target", "kind")


@query("SELECT text AS prompt, source AS target, min(doc_id) AS ord FROM documents GROUP BY 1, 2")
def example_dedup(spark, d):
    docs = B.table(spark, d, "documents").select(F.col("text").alias("prompt"), F.col("source").alias("target"), F.col("doc_id").alias("ord"))
    return relation.first_wins(docs, ["prompt", "target"], ["ord"])


@query(
    """WITH every AS (SELECT 0 AS src, text AS prompt, item_id AS ord FROM benchmark UNION ALL SELECT 1, text, doc_id FROM documents UNION ALL SELECT 2, text, conv_id * 1000 + turn FROM conversations)
    SELECT substr(sha256(prompt), 1, 20) AS id, CAST(src AS INT) AS src, ord FROM every QUALIFY row_number() OVER (PARTITION BY prompt ORDER BY src, ord) = 1"""
)
def union_first_wins(spark, d):
    parts = [("benchmark", F.col("item_id")), ("documents", F.col("doc_id")), ("conversations", F.col("conv_id") * 1000 + F.col("turn"))]
    sources = [B.table(spark, d, t).select(F.lit(k).alias("src"), F.col("text").alias("prompt"), o.alias("ord")) for k, (t, o) in enumerate(parts)]
    return relation.union_first_wins(sources, ["prompt"], ["ord"]).select(text.stable_id(F.col("prompt")).alias("id"), "src", "ord")


@query(f"WITH {B.ATTEMPTS} SELECT request_id, round FROM attempts WHERE round BETWEEN 1 AND 2")
def replay_window(spark, d):
    return X.replay_window(B.attempts(spark, d), 2, 2).select("request_id", "round")


@query(
    f"""WITH {B.ATTEMPTS}, {B.STATEMENTS}, per AS (
      SELECT statement_id, round, count(*) FILTER (status = 'proved') AS successes, count(*) FILTER (status = 'proved') / count(*) AS score FROM attempts GROUP BY 1, 2),
    examples AS (
      SELECT a.statement_id, a.round, a.ord, proof AS target, row_number() OVER (PARTITION BY statement, proof ORDER BY a.round, a.ord) AS place
      FROM attempts a JOIN per p ON p.statement_id = a.statement_id AND p.round = a.round JOIN statements s ON s.id = a.statement_id
      WHERE status = 'proved' AND proof IS NOT NULL AND score <= 0.5e0 AND a.round BETWEEN 1 AND 2)
    SELECT statement_id, round, target FROM examples WHERE place = 1"""
)
def replay_examples(spark, d):
    every = B.attempts(spark, d)
    per = scoring.solve_rates(every.withColumn("statement_id", F.struct("statement_id", "round"))).select(F.col("statement_id.statement_id").alias("statement_id"), F.col("statement_id.round").alias("round"), "score")
    pools = B.statements(spark, d).select("id", "statement", "header", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("round"))
    return X.replay_examples(every, pools, per, 2, 2, 0.5).select("statement_id", "round", "target")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def last_wins(spark, d):
    return relation.last_wins(B.events(spark, d), ["user_id"], ["event_id"]).select("user_id", "event_id", "event_type")


@query(
    f"""WITH {B.TOKEN_ROWS}
    SELECT CASE WHEN turn % 4 < 2 THEN concat('p', prompt) ELSE concat('Complete the following Lean 4 code:', chr(10), chr(10), '```lean4', chr(10), 'h', id) END AS prompt,
           target, 1.0e0 AS weight, 'sft' AS kind, substr(sha256(CASE WHEN turn % 4 < 2 THEN concat('p', prompt) ELSE concat('h', id) END), 1, 20) AS statement_id
    FROM pairs"""
)
def sft_union(spark, d):
    rows = B.token_rows(spark, d)
    plain = F.col("turn") % 4 < 2
    records = rows.select(
        F.when(plain, F.concat(F.lit("p"), "prompt")).alias("prompt"),
        F.when(plain, F.col("target")).alias("target"),
        F.when(~plain, F.col("id")).alias("formal_statement"),
        F.when(~plain, F.col("target")).alias("proof"),
        F.when(~plain, F.lit("h")).alias("header"),
        F.lit(None).cast("double").alias("weight"),
        F.col("turn").alias("ord"),
    )
    return X.sft_examples(records).select("prompt", "target", "weight", "kind", "statement_id")


# --- text ------------------------------------------------------------------------------------


@query(r"""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(replace(replace(html, '<', '/-'), '>', '-/'), '(?s)/-.*?-/|--[^\r\n]*', ' ', 'g'), '[\s\x0b]+', ' ', 'g'))) AS digest FROM pages""")
def strip_comments(spark, d):
    code = F.replace(F.replace("html", F.lit("<"), F.lit("/-")), F.lit(">"), F.lit("-/"))
    return B.table(spark, d, "pages").select("page_id", F.sha2(text.one_line(text.remove_comments(code)), 256).alias("digest"))


_REPLY = "concat('talk ```lean4', chr(10), 'theorem old : q := by', chr(10), ' rfl', chr(10), '```', chr(10), '```lean4', chr(10), 'theorem t', doc_id, ' : p := by', chr(10), '  exact h', doc_id, chr(10), '```')"


def _reply(name: Column | None = None) -> Column:
    key = F.col("doc_id").cast("string")
    return F.concat(F.lit("talk ```lean4\ntheorem old : q := by\n rfl\n```\n```lean4\ntheorem t"), name if name is not None else key, F.lit(" : p := by\n  exact h"), key, F.lit("\n```"))


@query("SELECT doc_id, concat('theorem t', doc_id, ' : p := by', chr(10), '  exact h', doc_id) AS block FROM documents")
def extract_fenced(spark, d):
    return B.table(spark, d, "documents").select("doc_id", text.last_block(_reply()).alias("block"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN concat('exact h', doc_id) END AS proof FROM documents")
def extract_proof(spark, d):
    key = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 5 == 0, F.lit("other")).otherwise(key)
    statement = F.concat(F.lit("/- old: := by -/ theorem   t"), key, F.lit(" :  p := by"))
    return B.table(spark, d, "documents").select("doc_id", text.extract_proof(_reply(name), statement).alias("proof"))


@query("SELECT doc_id, concat('d', doc_id) AS name FROM documents")
def declaration_name(spark, d):
    return B.table(spark, d, "documents").select("doc_id", text.declaration_name(_doc_statement()).alias("name"))


@query("SELECT event_id, NOT (event_type = 'error' OR CAST(json_extract(props, '$.k') AS BIGINT) % 10 = 0) AS ok FROM events")
def verify_predicate(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    messages = F.array(
        F.struct(F.when(F.col("event_type") == "error", "error").otherwise("info").alias("severity"), F.lit("a").alias("data")),
        F.struct(F.lit("warning").alias("severity"), F.when(k % 10 == 0, "declaration uses 'sorry'").otherwise("done").alias("data")),
    )
    return B.events(spark, d).select("event_id", text.verified(messages).alias("ok"))


@query("SELECT event_id, CASE WHEN event_type < 'm' THEN concat(event_type, ',m') ELSE concat('m,', event_type) END AS lemmas FROM events")
def invoked_lemmas(spark, d):
    reply = F.concat(F.lit('["m", "'), "event_type", F.lit('"]'))
    messages = F.array(F.struct(F.lit("info").alias("severity"), F.lit("[]").alias("data")), F.struct(F.lit("info").alias("severity"), reply.alias("data")))
    return B.events(spark, d).select("event_id", F.array_join(text.invoked_lemmas(messages), ",").alias("lemmas"))


@query("SELECT doc_id, length(text) AS n_chars, sha256(concat('import A', chr(10), coalesce(text, ''), chr(10), CASE WHEN doc_id % 2 = 0 THEN coalesce(lang, '') ELSE '' END)) AS code_sha256 FROM documents")
def checker_source(spark, d):
    """Every document, whatever its length; a null text is an empty statement."""
    code = text.checker_source(F.lit("import A\n"), F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    return B.table(spark, d, "documents").select("doc_id", F.length("text").alias("n_chars"), F.sha2(code, 256).alias("code_sha256"))


@query(
    """SELECT doc_id, start, finish, sha256(substr(text, start + 1, finish - start)) AS part_sha256, concat('p', doc_id, '/x.lean') AS path
    FROM (SELECT *, least(n, start + 1 + n // 3) AS finish FROM (SELECT doc_id, text, length(text) AS n, CAST(doc_id * 7919 % greatest(length(text), 1) AS BIGINT) AS start FROM documents))"""
)
def span_extract(spark, d):
    """Spans that start and end anywhere in the whole text."""
    n = F.length("text")
    docs = B.table(spark, d, "documents").withColumn("start", F.when(F.col("text").isNotNull(), F.expr("cast(doc_id * 7919 % greatest(length(text), 1) as int)")))
    docs = docs.withColumn("finish", F.least(n, F.col("start") + 1 + F.floor(n / 3).cast("int")))
    return docs.select("doc_id", "start", "finish", F.sha2(text.span(F.col("text"), F.col("start"), F.col("finish")), 256).alias("part_sha256"), text.repository_path(F.concat(F.lit("mathlib/p"), F.col("doc_id").cast("string"), F.lit("/x.lean"))).alias("path"))


# --- batches and tokens ----------------------------------------------------------------------


@query("SELECT event_id, event_id % 8 AS worker FROM events")
def round_robin(spark, d):
    return relation.round_robin(B.events(spark, d).withColumn("ord", F.col("event_id")), 8).select("event_id", "worker")


@query("SELECT event_id // 32 AS batch, count(*) AS n FROM events GROUP BY 1")
def batch_groups(spark, d):
    return relation.batched(B.events(spark, d), 32, ord_col="event_id").groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id // 32 // 4 AS batch_group, count(DISTINCT event_id // 32) AS batches, count(*) AS n FROM events GROUP BY 1")
def accumulation_groups(spark, d):
    return relation.batched(B.events(spark, d), 32, 4, "event_id").groupBy("batch_group").agg(F.countDistinct("batch").alias("batches"), F.count(F.lit(1)).alias("n"))


@query(
    """SELECT user_id, event_id AS step, count(*) OVER w AS examples_seen, CAST(sum(length(props)) OVER w AS BIGINT) AS tokens_seen
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)"""
)
def cumulative_seen(spark, d):
    steps = B.events(spark, d).select("user_id", F.col("event_id").alias("step"), F.lit(1).alias("examples"), F.length("props").alias("target_tokens"))
    return tokens.cumulative_seen(steps, "user_id").select("user_id", "step", "examples_seen", "tokens_seen")


@query(
    """SELECT event_id, round(CASE WHEN event_id < 100 THEN (event_id + 1) / 100 ELSE greatest(0, (9000 - event_id) / 8900) END, 6) AS scale FROM events"""
)
def lr_schedule(spark, d):
    return B.events(spark, d).select("event_id", r6(numeric.learning_rate_scale(F.col("event_id"), 100, 9000)).alias("scale"))


@query(
    f"""SELECT item_id, CAST(e AS INT) AS epoch, CAST(row_number() OVER (PARTITION BY e ORDER BY {_digest("epoch", "item_id", f"e + {SEED}")}, item_id) - 1 AS INT) AS place
    FROM benchmark, (SELECT unnest(range(3)) AS e)"""
)
def epoch_permutation(spark, d):
    return tokens.epoch_permutation(B.table(spark, d, "benchmark"), 3, SEED, "item_id").select("item_id", "epoch", F.col("place").cast("int").alias("place"))


@query(f"SELECT doc_id FROM documents ORDER BY {_digest('validation', 'doc_id')}, doc_id LIMIT 100")
def validation_subset(spark, d):
    return tokens.fixed_sample(B.table(spark, d, "documents"), 100, SEED, "doc_id").select("doc_id")


_MOST = 60


@query(f"WITH {B.TOKEN_ROWS} SELECT id FROM pairs WHERE len(target_tokens) + 1 <= {_MOST}")
def length_filter(spark, d):
    return tokens.length_filter(B.token_rows(spark, d), _MOST).select("id")


@query(
    f"""WITH {B.TOKEN_ROWS} SELECT count(*) AS read, count(*) FILTER (len(target_tokens) + 1 <= {_MOST}) AS kept, count(*) FILTER (len(target_tokens) + 1 > {_MOST}) AS too_long,
      count(*) FILTER (len(target_tokens) + 1 <= {_MOST} AND len(prompt_tokens) + len(target_tokens) + 1 > {_MOST}) AS truncated,
      CAST(coalesce(sum(len(target_tokens) + 1) FILTER (len(target_tokens) + 1 <= {_MOST}), 0) AS BIGINT) AS target_tokens FROM pairs"""
)
def length_stats(spark, d):
    return tokens.length_stats(B.token_rows(spark, d), _MOST)


_ENCODED = f"""{B.TOKEN_ROWS}, cut AS (
  SELECT id, conv_id, list_append(target_tokens, 0) AS whole, prompt_tokens, least(greatest(len(prompt_tokens) + len(target_tokens) + 1 - {_MOST}, 0), len(prompt_tokens)) AS dropped FROM pairs),
encoded AS (
  SELECT id, conv_id, list_concat(prompt_tokens[dropped + 1:], whole[1:{_MOST} - (len(prompt_tokens) - dropped)]) AS input_ids,
         len(prompt_tokens) - dropped AS masked FROM cut)"""


def _encoded(spark, d):
    ids, labels = tokens.encode_example(F.col("prompt_tokens"), F.col("target_tokens"), 0, _MOST)
    return B.token_rows(spark, d).select("id", "conv_id", ids.alias("input_ids"), labels.alias("labels"))


@query(
    f"""WITH {_ENCODED} SELECT id, list_aggregate(input_ids, 'string_agg', ',') AS input_ids, CAST(len(input_ids) AS INT) AS n, CAST(masked AS INT) AS masked FROM encoded"""
)
def encode_example(spark, d):
    return _encoded(spark, d).select("id", F.array_join(F.transform("input_ids", lambda t: t.cast("string")), ",").alias("input_ids"), F.size("input_ids").alias("n"), F.size(F.filter("labels", lambda x: x == -100)).alias("masked"))


@query(
    f"""WITH {_ENCODED}, wide AS (SELECT *, max(len(input_ids)) OVER (PARTITION BY conv_id % 7) AS width FROM encoded)
    SELECT id, CAST(width AS INT) AS width, CAST(len(input_ids) AS INT) AS attended, CAST(width - len(input_ids) AS INT) AS padded FROM wide"""
)
def collate(spark, d):
    out = tokens.collate(_encoded(spark, d).withColumn("batch", F.col("conv_id") % 7), -1)
    ones = F.aggregate("attention_mask", F.lit(0), lambda a, m: a + m)
    return out.select("id", F.size("labels").alias("width"), ones.alias("attended"), F.size(F.filter("input_ids", lambda t: t == -1)).alias("padded"))


_LOSSES = f"""{B.TOKEN_ROWS}, rows AS (
  SELECT conv_id % 7 AS batch, len(target_tokens) AS n, list_sum(list_transform(target_tokens, lambda t: t * 0.1e0)) / len(target_tokens) AS loss,
         len(list_filter(target_tokens, lambda t: t > 2)) AS hits, 1.0e0 + conv_id % 3 AS weight FROM pairs),
batches AS (
  SELECT batch, sum(loss * weight) / sum(weight) AS loss, CAST(sum(n) AS BIGINT) AS target_tokens, CAST(sum(hits) AS BIGINT) AS correct_tokens,
         count(*) FILTER (hits = n) AS exact_proofs, count(*) AS examples FROM rows GROUP BY 1)"""


def _losses(spark, d):
    rows = B.token_rows(spark, d).select((F.col("conv_id") % 7).alias("batch"), F.transform("target_tokens", lambda t: t * F.lit(0.1).cast("double")).alias("token_losses"), F.transform("target_tokens", lambda t: t > 2).alias("token_hits"), (1.0 + F.col("conv_id") % 3).cast("double").alias("weight"))
    return rows, tokens.weighted_loss(rows, ["batch"])


@query(f"WITH {_LOSSES} SELECT batch, round(loss, 6) AS loss, target_tokens, correct_tokens, exact_proofs FROM batches")
def weighted_loss(spark, d):
    return _losses(spark, d)[1].withColumn("loss", r6("loss"))


@query(
    f"""WITH {_LOSSES} SELECT round(sum(loss * examples) / sum(examples), 6) AS loss, round(exp(sum(loss * examples) / sum(examples)), 5) AS perplexity,
      round(sum(correct_tokens) / sum(target_tokens), 6) AS token_accuracy, round(sum(exact_proofs) / sum(examples), 6) AS exact_proof_accuracy FROM batches"""
)
def validation_rollup(spark, d):
    rows, batches = _losses(spark, d)
    out = tokens.validation_rollup(batches.join(rows.groupBy("batch").agg(F.count(F.lit(1)).alias("examples")), "batch"))
    return out.select(r6("loss").alias("loss"), F.round("perplexity", 5).alias("perplexity"), r6("token_accuracy").alias("token_accuracy"), r6("exact_proof_accuracy").alias("exact_proof_accuracy"))


@query(f"WITH {_LOSSES} SELECT batch % 2 AS epoch, round(sum(loss * examples) / sum(examples), 6) AS loss, CAST(sum(examples) AS BIGINT) AS examples, CAST(sum(target_tokens) AS BIGINT) AS target_tokens FROM batches GROUP BY 1")
def epoch_rollup(spark, d):
    rows, batches = _losses(spark, d)
    steps = batches.join(rows.groupBy("batch").agg(F.count(F.lit(1)).alias("examples")), "batch").withColumn("epoch", F.col("batch") % 2)
    return tokens.epoch_rollup(steps).withColumn("loss", r6("loss"))


@query(f"WITH {B.TOKEN_ROWS} SELECT id, CAST(len(list_filter(prompt_tokens, lambda t: t <> 3)) AS INT) AS n, list_aggregate(prompt_tokens[-10:], 'string_agg', ',') AS kept FROM pairs")
def prompt_tail(spark, d):
    rows = B.token_rows(spark, d)
    return rows.select("id", numeric.token_count(F.col("prompt_tokens"), 3).alias("n"), F.array_join(F.transform(tokens.keep_right(F.col("prompt_tokens"), 10), lambda t: t.cast("string")), ",").alias("kept"))


@query(
    """WITH rows AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
    SELECT vec_id, CAST(d - 1 AS INT) AS dim, round((e[d] + e[d + 16]) / 2, 6) AS v FROM rows, (SELECT unnest(range(1, 17)) AS d)"""
)
def mean_pool(spark, d):
    e = F.col("embedding").cast("array<double>")
    hidden = F.array(F.slice(e, 1, 16), F.slice(e, 17, 16), F.slice(e, 33, 16))
    pooled = tokens.mean_pool(hidden, F.array(F.lit(1.0), F.lit(1.0), F.lit(0.0)))
    return B.table(spark, d, "embeddings").select("vec_id", F.posexplode(pooled).alias("dim", "v")).select("vec_id", "dim", r6("v").alias("v"))


@query("SELECT event_id, event_type, round(value / count(*) OVER (PARTITION BY event_type, user_id), 6) AS duration_seconds FROM events")
def amortised_duration(spark, d):
    rows = B.events(spark, d).withColumn("batch", F.concat_ws("|", "event_type", F.col("user_id").cast("string")))
    return tokens.amortised(rows, "value", "batch").select("event_id", "event_type", r6("duration_seconds").alias("duration_seconds"))


# --- matching --------------------------------------------------------------------------------


@query(f"WITH {B.VECTORS} SELECT t.id AS target_id, c.id AS candidate_id, round(list_cosine_similarity(t.vector, c.vector), 6) AS similarity FROM targets t, candidates c")
def cosine_pairs(spark, d):
    candidates, targets = B.vectors(spark, d)
    return matching.similarities(candidates, targets).withColumn("similarity", r6("similarity"))


@query(
    f"""WITH {B.VECTORS} SELECT t.id AS target_id, c.id AS candidate_id FROM targets t, candidates c
    QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY list_cosine_similarity(t.vector, c.vector) DESC, c.id) <= 5"""
)
def topk_similar(spark, d):
    candidates, targets = B.vectors(spark, d)
    return matching.top_similar(candidates, targets, 5).select("target_id", "candidate_id")


def _matched(capacity: float) -> str:
    """The serial loop: a step for each target, with the candidates' weights so far."""
    return f"""{B.VECTORS},
    c AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY id) AS k FROM candidates),
    t AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM targets),
    sizes AS MATERIALIZED (SELECT (SELECT count(*) FROM c) AS n, (SELECT count(*) FROM c) / (SELECT sum(weight) FROM t) AS step),
    lists AS MATERIALIZED (SELECT t.k, t.id AS target_id, t.weight, list(c.k ORDER BY list_cosine_similarity(t.vector, c.vector) DESC, c.id) AS best FROM t, c GROUP BY ALL),
    served AS (
      SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS target_id, list_transform(range(n), lambda x: CAST(0 AS DOUBLE)) AS load, CAST([] AS BIGINT[]) AS chosen, CAST([] AS BIGINT[]) AS best, CAST(0 AS BIGINT) AS weight FROM sizes
      UNION ALL
      SELECT k, target_id, list_transform(load, lambda x, i: CASE WHEN list_contains(chosen, i) THEN x + step ELSE x END), chosen, best, weight
      FROM (SELECT l.k, l.target_id, s.load, list_filter(l.best, lambda b: s.load[b] <= {capacity})[1:l.weight] AS chosen, l.best, CAST(l.weight AS BIGINT) AS weight FROM served s JOIN lists l ON l.k = s.k + 1), sizes)"""


@query(f"""WITH RECURSIVE {_matched(3)},
    taken AS (SELECT unnest(range(1, n + 1)) AS k, unnest(load) AS weight FROM served, sizes WHERE served.k = (SELECT max(k) FROM served))
    SELECT c.id AS candidate_id, round(weight, 6) AS weight FROM taken JOIN c USING (k) WHERE weight > 0""")
def wasserstein_match(spark, d):
    candidates, targets = B.vectors(spark, d)
    return matching.match_to_targets(candidates, targets).withColumn("weight", r6("weight"))


@query(f"""WITH RECURSIVE {_matched(1)}
    SELECT target_id, CASE WHEN len(chosen) < weight THEN n ELSE list_position(best, chosen[-1]) END AS asked FROM served, sizes WHERE target_id IS NOT NULL""")
def wasserstein_lists(spark, d):
    """How far down its list each target had to ask, where candidates are soon exhausted."""
    candidates, targets = B.vectors(spark, d)
    return matching.matching(candidates, targets, 1.0).lists.select("target_id", "asked")


@query(
    f"""WITH {B.VECTORS}, ranked AS (
      SELECT c.id AS candidate_id, t.weight, row_number() OVER (PARTITION BY t.id ORDER BY list_cosine_similarity(t.vector, c.vector) DESC, c.id) AS place FROM targets t, candidates c)
    SELECT candidate_id, round(count(*) * ((SELECT count(*) FROM candidates) / (SELECT sum(weight) FROM targets)), 6) AS weight FROM ranked WHERE place <= weight GROUP BY 1"""
)
def wasserstein_match_free(spark, d):
    candidates, targets = B.vectors(spark, d)
    return matching.match_to_targets(candidates, targets, 1e9).withColumn("weight", r6("weight"))


# --- trees -----------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {B.TREE} SELECT CAST(node AS INT) AS node, id, value, proven FROM projected")
def tree_project(spark, d):
    return tree.project(spark, *B.tree(spark, d), depth=64).select("node", "id", "value", "proven")


@query(
    f"""WITH RECURSIVE {B.TREE}, leaves AS (SELECT * FROM projected WHERE path NOT IN (SELECT parent_path FROM projected)),
    frontier AS (SELECT * FROM projected WHERE path IN (SELECT parent_path FROM leaves))
    SELECT count(*) FILTER (proven) AS solved_frontier_nodes, count(*) AS total_frontier_nodes, round(count(*) FILTER (proven) / count(*), 6) AS solve_rate FROM frontier"""
)
def frontier_rate(spark, d):
    return tree.frontier_rate(tree.project(spark, *B.tree(spark, d), depth=64)).select("solved_frontier_nodes", "total_frontier_nodes", r6("solve_rate").alias("solve_rate"))


@query(
    """WITH RECURSIVE chains AS (SELECT s_suppkey AS tree_id, 10 + s_suppkey % 31 AS depth FROM supplier),
    doubling AS (SELECT 0 AS k, CAST(1 AS BIGINT) AS paths UNION ALL SELECT k + 1, paths * 2 FROM doubling WHERE k < 40),
    frontier AS (
      SELECT tree_id, 3 * k AS id, paths FROM chains JOIN doubling ON k = depth
      UNION ALL SELECT tree_id, 3 * k + 1, paths FROM chains JOIN doubling ON k < depth AND k % 2 = 1)
    SELECT tree_id, CAST(coalesce(sum(paths) FILTER ((tree_id + id) % 4 = 0), 0) AS BIGINT) AS solved_frontier_nodes, CAST(sum(paths) AS BIGINT) AS total_frontier_nodes,
      round(coalesce(sum(paths) FILTER ((tree_id + id) % 4 = 0), 0) / sum(paths), 6) AS solve_rate FROM frontier GROUP BY 1"""
)
def shared_frontier(spark, d):
    """Chains of up to 40 diamonds: 2 ** 40 paths over some 120 nodes a tree."""
    chains = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("tree_id"), (10 + F.col("s_suppkey") % 31).alias("depth"))
    levels = chains.select("tree_id", "depth", F.explode(F.sequence(F.lit(0).cast("long"), "depth")).alias("k"))
    top, left, right, leaf = F.col("k") * 3, F.col("k") * 3 + 1, F.col("k") * 3 + 2, F.col("k") + 1000
    inner = F.col("k") < F.col("depth")
    down = lambda *children: F.array(*(F.struct(p.alias("parent"), F.lit(j).alias("ord"), c.alias("child")) for p, j, c in children))
    diamond = down((top, 0, left), (top, 1, right), (left, 0, top + 3), (right, 0, top + 3))
    edges = F.when(inner & (F.col("k") % 2 == 1), F.concat(diamond, down((left, 1, leaf)))).when(inner, diamond).otherwise(down((top, 0, leaf)))
    edges = levels.select("tree_id", F.explode(edges).alias("e")).select("tree_id", "e.*")
    ids = levels.select("tree_id", F.explode(F.when(inner, F.array(top, left, right, leaf)).otherwise(F.array(top, leaf))).alias("id"))
    nodes = ids.select("tree_id", "id", F.lit("OR").alias("node_type"), F.lit(0.0).alias("value"), ((F.col("tree_id") + F.col("id")) % 4 == 0).alias("proven"), (F.col("id") == 0).alias("is_root"))
    counts = [F.col(c).cast("long").alias(c) for c in ("solved_frontier_nodes", "total_frontier_nodes")]
    return tree.frontier_rate_by_counts(nodes, edges, depth=100).select("tree_id", *counts, r6("solve_rate").alias("solve_rate"))


@query(SQL["frontier_rate"])
def frontier_rate_by_counts(spark, d):
    counts = [F.col(c).cast("long").alias(c) for c in ("solved_frontier_nodes", "total_frontier_nodes")]
    return tree.frontier_rate_by_counts(*B.tree(spark, d), depth=64).select(*counts, r6("solve_rate").alias("solve_rate"))


# --- evaluation ------------------------------------------------------------------------------


@query(f"SELECT item_id, b AS simulations FROM benchmark, (SELECT CAST(unnest([{', '.join(map(str, E.BUDGETS))}]) AS INT) AS b)")
def budget_sweep(spark, d):
    return E.budget_sweep(B.table(spark, d, "benchmark")).select("item_id", "simulations")


@query("SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0)")
def insert_if_absent(spark, d):
    docs = B.table(spark, d, "documents")
    return relation.insert_if_absent(docs, docs.filter("doc_id % 3 = 0"), ["text"]).select("doc_id")


@query("SELECT user_id, event_type, count(*) AS n FROM events WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE event_id % 4 = 0) GROUP BY 1, 2")
def recover_missing(spark, d):
    every = B.events(spark, d)
    return relation.insert_if_absent(every, every.filter("event_id % 4 = 0"), ["user_id", "event_type"]).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def require_unique(spark, d):
    once = relation.first_wins(B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], ["l_orderkey"])
    relation.require_unique(once, ["l_orderkey", "l_linenumber"])
    return relation.repeated_keys(B.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def require_fk(spark, d):
    docs, labels = B.table(spark, d, "documents"), B.table(spark, d, "labels")
    relation.require_fk(labels, ["doc_id"], docs)
    return relation.unknown_keys(docs, ["doc_id"], labels)


@query(f"WITH {B.ATTEMPTS} SELECT statement_id AS problem_id, count(*) AS n, string_agg(status, ',' ORDER BY ord) AS statuses FROM attempts GROUP BY 1")
def nested_results(spark, d):
    rows = B.attempts(spark, d).select(F.col("statement_id").alias("problem_id"), "ord", "status", "proof")
    out = E.nested_results(rows)
    return out.select("problem_id", F.size("attempts").cast("long").alias("n"), F.array_join(F.transform("attempts", lambda a: a["status"]), ",").alias("statuses"))


@query(f"WITH {B.ATTEMPTS} SELECT statement_id AS problem_id, CAST(ord - 1 AS INT) AS ord, status FROM attempts")
def unnested_results(spark, d):
    rows = B.attempts(spark, d).select(F.col("statement_id").alias("problem_id"), "ord", "status")
    return E.unnested_results(E.nested_results(rows)).select("problem_id", "ord", "status")


@query("SELECT o_custkey, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS requests FROM orders GROUP BY 1")
def group_requests(spark, d):
    rows = B.table(spark, d, "orders").select(F.col("o_custkey").alias("problem_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("id"))
    out = E.nested_results(rows)
    return out.select(F.col("problem_id").alias("o_custkey"), F.size("attempts").cast("long").alias("n"), F.array_join(F.transform("attempts", lambda a: a["id"]), ",").alias("requests"))


@query(f"WITH {B.ATTEMPTS} SELECT request_id, CASE WHEN ord % 5 = 0 THEN 'proved' ELSE status END AS status, proof FROM attempts")
def overlay_verified(spark, d):
    rows = B.attempts(spark, d).select("request_id", "status", "proof", "ord")
    verified = rows.filter("ord % 5 = 0").withColumn("status", F.lit("proved"))
    return E.overlay_verified(rows, verified).select("request_id", "status", "proof")


@query("SELECT page_id, CASE WHEN page_id >= (SELECT count(*) - CAST(trunc(count(*) * 0.1e0) AS BIGINT) FROM pages) THEN 'validation' ELSE 'train' END AS split FROM pages")
def file_split(spark, d):
    from tessera.operators.extract import file_split as split

    pages = B.table(spark, d, "pages")
    return split(pages, pages.count(), "page_id").select("page_id", "split")


@query(
    """SELECT page_id, concat('theorem p', page_id, ' := by') AS formal_statement, concat(' exact h', page_id) AS proof, '-- h' || chr(10) AS header, concat('f', page_id) AS source
    FROM pages WHERE page_id % 3 <> 0"""
)
def outer_block(spark, d):
    from tessera.operators.extract import theorem_examples

    key = F.col("page_id").cast("string")
    head = F.lit("-- h\n")
    statement = F.concat(F.lit("theorem p"), key, F.lit(" := by"))
    proof = F.concat(F.lit(" exact h"), key, F.when(F.col("page_id") % 3 == 0, " sorry").otherwise(""))
    at = F.length(head)
    cut = at + F.length(statement)
    end = cut + F.length(proof)
    span = lambda a, b: F.struct(a.alias("start"), b.alias("finish"))
    leaf = F.struct(F.lit(None).cast("string").alias("error"), F.array(F.lit(1)).alias("nodes"))
    inner = F.struct(span(cut + 2, end).alias("span"), leaf.alias("tree"))
    block = F.struct(span(cut, end).alias("span"), leaf.alias("tree"))
    theorem = F.struct(F.lit(None).cast("string").alias("error"), span(at, end + 1).alias("span"), F.array(inner, block).alias("by_blocks"))
    files = B.table(spark, d, "pages").select("page_id", F.concat(F.lit("mathlib/f"), key).alias("path"), F.concat(head, statement, proof, F.lit("\n")).alias("source"), F.array(theorem).alias("theorems"))
    out = theorem_examples(files).withColumn("page_id", F.substring("source", 2, 20).cast("long"))
    return out.select("page_id", "formal_statement", "proof", "header", "source")


@query("SELECT DISTINCT p_brand AS full_name FROM part ORDER BY 1")
def declarations_sorted(spark, d):
    from tessera.sources.records import declaration_names

    return declaration_names(B.table(spark, d, "part").select(F.col("p_brand").alias("full_name"))).orderBy("full_name")


@query(f"WITH {B.STATEMENTS}, {B.CONJECTURES} SELECT id, statement, 'dataset' AS source FROM statements UNION ALL SELECT id, statement, 'conjecture' FROM conjectures")
def round_pool(spark, d):
    from tessera.sources.records import round_pool as pool

    return pool(B.statements(spark, d).drop("source"), B.conjectures(spark, d)).select("id", "statement", "source")


@query("SELECT event_id, event_type, user_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) <= 2")
def capped_per_key(spark, d):
    return relation.capped(B.events(spark, d), ["event_type", "user_id"], 2, ["event_id"]).select("event_id", "event_type", "user_id")


# --- handlers, verification and training sets --------------------------------------------------

_CHAT = f"concat({', chr(10), '.join(repr(x) for x in (text.CHAT_TASK,))}, chr(10), chr(10), $${text.CHAT_EXAMPLE}$$, chr(10))"


@query(
    f"""SELECT doc_id, sha256(concat({_CHAT}, CASE WHEN doc_id % 2 = 0 THEN concat(chr(10), 'Lean context:', chr(10), 'import ', lang, chr(10)) ELSE '' END,
      chr(10), 'Theorem:', chr(10), 'theorem d', doc_id, ' : ', lang, '   := by', chr(10))) AS prompt FROM documents"""
)
def proof_prompt(spark, d):
    statement = F.concat(F.lit("/- a\n-/theorem d"), F.col("doc_id").cast("string"), F.lit(" : "), "lang", F.lit(" -- b\n := by"))
    statement = F.replace(statement, F.lit(" -- b\n"), F.lit(" /- b\n-/"))
    header = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("  import "), "lang", F.lit("\n\n")))
    return B.table(spark, d, "documents").select("doc_id", F.sha2(text.proof_prompt(statement, header), 256).alias("prompt"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat('exact h', doc_id) END AS proof FROM documents")
def chat_completions(spark, d):
    key = F.col("doc_id").cast("string")
    statement = F.concat(F.lit("theorem d"), key, F.lit(" :  p := by"))
    other = F.concat(F.lit("```lean4\ntheorem other : q := by simp\n```\n"))
    block = F.concat(F.lit("```lean4\n-- theorem d"), key, F.lit(" : p := by wrong\ntheorem d"), key, F.lit(" : p /- x -/ := by\n  exact h"), key, F.lit("\n```\n"))
    rows = B.table(spark, d, "documents").select("doc_id", statement.alias("statement"), F.when(F.col("doc_id") % 5 == 0, other).otherwise(F.concat(other, block)).alias("raw_output"))
    return providers.parsed(rows, "chat").select("doc_id", "proof")


@query("SELECT p_partkey, concat('``', 'ns.t', p_partkey) AS asked FROM part")
def dependency_query(spark, d):
    statement = F.concat(F.lit("lemma ns.t"), F.col("p_partkey").cast("string"), F.lit(" {x} : p := by"))
    asked = F.regexp_extract(text.dependency_query(statement), r"getConstInfo (\S+)", 1)
    return B.table(spark, d, "part").select("p_partkey", asked.alias("asked"))


@query(
    f"""WITH {B.ATTEMPTS} SELECT request_id, CASE WHEN ord % 4 = 0 OR generated_tokens % 3 = 0 THEN 'failed' ELSE 'proved' END AS status, CAST(ord AS DOUBLE) AS verify_seconds,
      CASE WHEN ord % 4 = 0 THEN '' ELSE 'L1,L2' END AS lemmas FROM attempts"""
)
def verification(spark, d):
    rows = B.attempts(spark, d)
    requests = rows.select(F.col("request_id").alias("id"), F.lit("theorem a : p := by").alias("statement"), F.lit(None).cast("string").alias("header"), "ord")
    requests = requests.unionByName(requests.withColumn("ord", F.col("ord") - 100))
    sent = providers.checks(rows, requests)
    data = F.when(F.col("generated_tokens") % 3 == 0, "declaration uses 'sorry'").otherwise("fine")
    messages = lambda level, text_: F.array(F.struct(F.lit(level).alias("severity"), text_.alias("data")))
    replies = sent.select("request_id", messages("info", data).alias("messages"), messages("info", F.lit('["L2","X","L1"]')).alias("dependencies"), F.col("ord").cast("double").alias("seconds"), F.when(F.col("ord") % 4 == 0, "crashed").alias("error"))
    out = providers.checked(rows, replies, spark.createDataFrame([("L1",), ("L2",)], "full_name STRING"))
    return out.select("request_id", "status", "verify_seconds", F.array_join("invoked_lemmas", ",").alias("lemmas"))


@query("SELECT substr(sha256(prompt), 1, 20) AS id, target, kind FROM (SELECT text AS prompt, lang AS target, CASE WHEN doc_id % 3 = 0 THEN 'sft' WHEN doc_id % 3 = 1 THEN 'proof' ELSE 'conjecture' END AS kind, doc_id % 3 AS src, doc_id FROM documents) QUALIFY row_number() OVER (PARTITION BY prompt, target ORDER BY src, doc_id) = 1")
def training_examples(spark, d):
    docs = B.table(spark, d, "documents")
    of = lambda k, kind: docs.filter(F.col("doc_id") % 3 == k).select(F.col("text").alias("prompt"), F.col("lang").alias("target"), F.lit(1.0).alias("weight"), F.lit(kind).alias("kind"), F.col("doc_id").alias("ord"))
    return X.prepare_training_examples(of(0, "sft"), of(1, "proof"), of(2, "conjecture")).select(text.stable_id(F.col("prompt")).alias("id"), "target", "kind")


@query(
    f"""WITH {B.VECTORS}, ranked AS (
      SELECT c.id AS ord, t.weight, row_number() OVER (PARTITION BY t.id ORDER BY list_cosine_similarity(t.vector, c.vector) DESC, c.id) AS place FROM targets t, candidates c)
    SELECT ord, round(count(*) * ((SELECT count(*) FROM candidates) / (SELECT sum(weight) FROM targets)), 6) AS weight FROM ranked WHERE place <= weight GROUP BY 1"""
)
def matched_examples(spark, d):
    candidates, targets = B.vectors(spark, d)
    ideas = candidates.select(F.lit("p").alias("prompt"), F.lit(0.0).alias("weight"), F.col("id").alias("ord"))
    return X.match_conjecturer_examples(ideas, candidates.select(F.col("id").alias("ord"), "vector"), targets, 1e9).select("ord", r6("weight").alias("weight"))


# --- small relational pieces -------------------------------------------------------------------


@query("SELECT event_id, event_type, value FROM events WHERE event_type IS NOT NULL")
def lines_in_file_order(spark, d):
    """Written in parts, read back: a row's place is its event's place."""
    from tessera.plans.scratch import scratch_path
    from tessera.sources.records import read_lines, write_lines

    rows = B.events(spark, d).select("event_id", "event_type", "value", F.col("event_id").alias("ord"))
    path = scratch_path(spark, "lines")
    write_lines(rows, path)
    back = read_lines(spark, path, "event_id BIGINT, event_type STRING, value DOUBLE")
    places = scan.numbered(scan.numbered(back, ["ord"], name="read_as"), ["event_id"], name="written_as")
    wrong = places.filter("read_as <> written_as").count()
    if wrong:
        raise ValueError(f"{wrong} rows out of order")
    return back.drop("ord")


@query("SELECT page_id AS ord, url, length(html) AS n FROM pages")
def zip_strict(spark, d):
    pages = B.table(spark, d, "pages")
    return E.zip_strict(pages.select(F.col("page_id").alias("ord"), "url"), pages.select(F.col("page_id").alias("ord"), F.length("html").cast("long").alias("n")))


@query("SELECT event_id, value FROM events WHERE event_id >= 100")
def resumed_slice(spark, d):
    return E.resumed(B.events(spark, d).withColumn("ord", F.col("event_id")), 100).select("event_id", "value")


@query("SELECT CASE WHEN page_id % 10 = 0 THEN 'validation' ELSE 'train' END AS split, count(*) AS n FROM pages GROUP BY 1")
def split_counts(spark, d):
    return E.per_split(B.table(spark, d, "pages").withColumn("split", F.when(F.col("page_id") % 10 == 0, "validation").otherwise("train")))


@query("SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 2 = 0 THEN 'a' END, 'c') AS only_proof, concat_ws(',', 'l' || o_orderstatus, 'right') AS merged FROM orders")
def array_and_map_merges(spark, d):
    used = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    kind = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    merged = text.merged(F.create_map(F.lit("x"), F.concat(F.lit("l"), "o_orderstatus"), F.lit("y"), F.lit("left")), F.create_map(F.lit("y"), F.lit("right")))
    return B.table(spark, d, "orders").select("o_orderkey", F.array_join(text.proof_only(used, kind), ",").alias("only_proof"), F.concat_ws(",", merged["x"], merged["y"]).alias("merged"))


@query("SELECT concat_ws(':', doc_id, 1) AS request_id, concat('theorem d', doc_id, ' := by sorry') AS theorem, doc_id AS seed FROM documents")
def search_requests(spark, d):
    from tessera.sources.records import search_requests as requests

    key = F.col("doc_id").cast("string")
    asked = B.table(spark, d, "documents").select(F.concat(key, F.lit(":1")).alias("id"), F.concat(F.lit("theorem d"), key, F.lit(" :=  by ")).alias("statement"), F.lit(None).cast("string").alias("header"), F.col("doc_id").alias("seed"))
    return requests(asked).select("request_id", "theorem", "seed")


@query("SELECT simulations, avg(score) AS score, count(*) AS problems, log2(simulations) AS log2_budget FROM (SELECT CAST(2 ** (event_id % 5) AS INT) AS simulations, event_id % 2 AS score FROM events) GROUP BY 1")
def plot_rows(spark, d):
    rows = B.events(spark, d).select(F.pow(F.lit(2), F.col("event_id") % 5).cast("int").alias("simulations"), (F.col("event_id") % 2).cast("double").alias("score"))
    return E.plot_rows(rows)


@query(f"SELECT event_id, CAST((row_number() OVER (ORDER BY {_digest('epoch', 'event_id')}, event_id) - 1) // 32 AS BIGINT) AS batch, avg(value) OVER () AS mean FROM events")
def shuffled_batches(spark, d):
    rows = B.events(spark, d)
    out = tokens.shuffled_batches(rows.select("event_id", "value"), 1, SEED, 32, "event_id")
    mean = tokens.mean_loss(rows.select(F.col("value").alias("loss")))
    return out.join(F.broadcast(mean)).select("event_id", F.col("batch").cast("long").alias("batch"), F.col("loss").alias("mean"))


@query("SELECT region.r_regionkey AS k, to_json({'r_regionkey': r_regionkey, 'r_name': nullif(r_name, 'ASIA')}) AS json FROM region")
def rows_as_json(spark, d):
    from tessera.sources.records import as_json

    rows = B.table(spark, d, "region").withColumn("r_name", F.nullif("r_name", F.lit("ASIA")))
    return as_json(rows).select(F.get_json_object("json", "$.r_regionkey").cast("int").alias("k"), "json")
