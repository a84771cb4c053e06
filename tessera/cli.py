"""Commands that print their result as JSON: ``python -m tessera.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession

from tessera.operators import scoring, tree
from tessera.plans.scratch import session
from tessera.sources import records

TREE = "STRUCT<root_id BIGINT, nodes ARRAY<STRUCT<id BIGINT, node_type STRING, value DOUBLE, proven BOOLEAN, children ARRAY<STRUCT<action STRING, node_id BIGINT>>>>>"
ATTEMPT = "request_id STRING, statement_id STRING, solver STRING, status STRING, multiplicity BIGINT, solve_rate DOUBLE"


def arguments(given: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tessera")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("tree", help="the frontier's solve rate of a search result")
    one.add_argument("search_tree")
    one.add_argument("--projected-tree-output")
    one = commands.add_parser("evaluate", help="the share of problems that saved attempts prove")
    one.add_argument("--attempts", required=True)
    one.add_argument("--problems", required=True)
    one.add_argument("--problem-index", type=int)
    one = commands.add_parser("declarations", help="declarations by name with their manifest")
    one.add_argument("--input", required=True)
    one.add_argument("--output", required=True)
    args = parser.parse_args(given)
    if getattr(args, "problem_index", None) is not None and args.problem_index < 0:
        parser.error("--problem-index must not be negative")
    return args


def run(spark: SparkSession, args: argparse.Namespace) -> dict:
    if args.command == "tree":
        read = spark.read.schema(f"tree {TREE}").option("multiLine", "true").json(args.search_tree).selectExpr("'tree' AS tree_id", "tree")
        projected = tree.project(spark, *tree.node_tables(read))
        if args.projected_tree_output:
            records.write_lines(projected.drop("tree_id").withColumnRenamed("node", "ord"), args.projected_tree_output)
        return tree.frontier_rate(projected).drop("tree_id").first().asDict()
    if args.command == "evaluate":
        problems = records.load_problems(spark, args.problems)
        if args.problem_index is not None:
            problems = records.row_at(problems, args.problem_index)
        attempts = records.read_resumable(spark, args.attempts, ATTEMPT).join(problems.select("id").withColumnRenamed("id", "statement_id").distinct(), "statement_id", "left_semi")
        return scoring.pass_at_k(problems, scoring.assess(attempts)).first().asDict()
    return records.write_declarations(records.declaration_map(records.read_lines(spark, args.input, records.DECLARATION)), args.output, {})


def main(given: Sequence[str] | None = None) -> None:
    args = arguments(given)
    print(json.dumps(run(session("tessera-cli"), args), indent=2))


if __name__ == "__main__":
    main()
