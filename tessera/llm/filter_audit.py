"""How text filters interact: what each removes, in every order, from one histogram of failure masks.

Each document gets a mask of five bits, one for each filter that it fails, by column
functions; equal texts share four of them, and the smallest ``doc_id`` of a text decides the
fifth. Documents are then counted by part and mask (32 cells a part at most), and all 120
orders are read off the cells: nothing of a document is needed for them.

Defined results: a null text is empty, a null ``lang`` is the part ''; a null ``doc_id`` is
not smaller nor larger than another, so that such a row never fails E, and has no labels; rows
with the same ``doc_id`` are each a document, none a copy of the other; of several labels of an
id any ``quality`` or ``toxic`` of 1 counts; texts of any length are read whole; other columns
are not looked at, whatever their names; without documents there are no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import whole_text

FILTERS = "ABCDE"
#: The filters' bits.
BIT = {f: 1 << k for k, f in enumerate(FILTERS)}
#: The filters' limits.
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_UPPER_PERCENT = 3
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#$%&*|]"


def _bit(failed: Column, letter: str) -> Column:
    return F.when(failed, BIT[letter]).otherwise(0)


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask): the bits of A to D, and a SHA-256 digest of the text."""
    text = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), whole_text().alias("text"))
    split = text.select("*", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    counted = split.select("*", F.size("words").cast("long").alias("n"), F.size(F.array_distinct("words")).cast("long").alias("distinct"))
    upper = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    mask = (
        _bit(F.col("n") < LEAST_WORDS, "A")
        + _bit(100 * F.col("distinct") < LEAST_DISTINCT_PERCENT * F.col("n"), "B")
        + _bit(100 * upper.cast("long") > MOST_UPPER_PERCENT * F.length("text").cast("long"), "C")
        + _bit(F.col("text").rlike(SYMBOLS), "D")
    )
    return counted.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.cast("int").alias("mask"))


def histogram(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each part that fail exactly the mask's filters.

    Rows meet by all their keys first, so that no copy's group is gathered; the join with the
    labels is by ``doc_id`` between two plain exchanges, which adaptive execution splits."""
    rows = masked(docs).groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = rows.join(marks.hint("merge"), "doc_id", "left")
    of = F.struct("n", (F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), (F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    texts = marked.withColumn("of", of).groupBy("digest", "part", "mask").agg(
        F.min("doc_id").alias("low"),
        F.min_by("of", "doc_id").alias("first"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        *(F.sum(f"of.{c}").alias(c) for c in ("n", "good", "toxic")),
    )
    # a text's parts, each of one row by now, learn the smallest id of them all
    everywhere = F.min("low").over(Window.partitionBy("digest"))
    here = F.col("low") == F.col("everywhere")
    kept = {c: F.when(here, F.col(f"first.{c}")).otherwise(0) for c in ("n", "good", "toxic")}
    kept["n"] += F.col("nameless")
    cells = texts.withColumn("everywhere", everywhere).select(
        "part",
        F.explode(F.array(F.struct("mask", *(v.alias(c) for c, v in kept.items())), F.struct((F.col("mask") + BIT["E"]).alias("mask"), *((F.col(c) - v).alias(c) for c, v in kept.items())))).alias("cell"),
    )
    return cells.filter("cell.n > 0").groupBy("part", F.col("cell.mask").alias("mask")).agg(*(F.sum(f"cell.{c}").alias(c) for c in ("n", "good", "toxic")))


def _orders() -> list[tuple[str, int, int, int]]:
    """All orders' steps: name of the order, step, its filter's bit, the bits of the filters before."""
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for k, letter in enumerate(order):
            steps.append(("".join(order), k + 1, BIT[letter], before))
            before |= BIT[letter]
    return steps


def interactions(cells: DataFrame) -> DataFrame:
    """From a histogram: part, filter_order, step and the counts of that step.

    A document that fails k filters is removed by each of them in 120 / k orders, which gives
    ``shapley`` without adding up the orders."""
    orders = cells.sparkSession.createDataFrame(_orders(), "filter_order STRING, step INT, bit INT, before INT")
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    every = parts.join(F.broadcast(orders))  # 600 steps for each part

    def total(field: str, where) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(where(c["mask"]), c[field]).otherwise(0))

    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    removed = lambda m: fails(m) & ~gone(m)
    share = F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(fails(c["mask"]), (c["n"] * 120 / F.bit_count(c["mask"])).cast("long")).otherwise(0))
    return every.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("n", lambda m: m == F.col("bit")).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        share.alias("shapley"),
    )


def op12_mask_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all orders over whole ``documents``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return interactions(histogram(docs, labels))


OP12_SQL = r"""
WITH split AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
firsts AS (SELECT text, min(doc_id) AS low FROM split GROUP BY 1),
failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
    len(words) < 200,
    100 * len(list_distinct(words)) < 50 * len(words),
    100 * length(regexp_replace(s.text, '[^A-Z]', '', 'g')) > 3 * length(s.text),
    regexp_matches(s.text, '[#$%&*|]'),
    coalesce(s.doc_id > low, false)] AS fails
  FROM split s JOIN firsts f ON f.text = s.text LEFT JOIN marks m ON m.doc_id = s.doc_id),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY 1, 2),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS f),
orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT o, list_aggregate(list_transform(o, lambda x: substr('ABCDE', x, 1)), 'string_agg', '') AS filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
marked AS (
  SELECT part, filter_order, step, o[step] AS f, n, good, toxic, fails[o[step]] AS failing,
         len(list_filter(o[1:step - 1], lambda x: fails[x])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS failures
  FROM steps, cells),
counted AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (NOT failing AND NOT gone), 0) AS kept,
    coalesce(sum(n) FILTER (failing AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (failing AND gone), 0) AS redundant,
    coalesce(sum(n) FILTER (failing AND failures = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (failing AND NOT gone), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (failing AND NOT gone), 0) AS toxic_lost
  FROM marked GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""
