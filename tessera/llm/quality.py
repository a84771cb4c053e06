"""Quality by importance resampling of hashed n-gram models.

Two bag models over hashed words and word pairs, of all texts (raw) and of the labelled
good ones (target), give each text the log ratio of its probabilities. Texts are drawn
by the Gumbel top-k rule: with standard Gumbel noise on the log ratios, the k largest
are a sample without replacement in proportion to the ratios. k is the number of texts
whose log ratio passes a threshold that a bounded sample of labelled texts sets, so the
draw follows the corpus's own share of good texts. The labelled texts are dealt into two
halves: the good ones of one make the target model, the other one sets the threshold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ship, stored, whole_text

#: Hash buckets of the models: what goes to the driver and the workers, whatever the input.
BUCKETS = 1 << 18
#: Labelled rows used at most, those with the smallest hashes.
LABELLED = 1 << 17
#: What is added to each bucket's expected and seen counts, as a share of the target's occurrences,
#: so that corpora of every size are judged alike.
SHRINK = 5e-5
#: Scale of the Gumbel noise on the log ratios.
TEMPERATURE = 1.0
SEED = 17


def _features(column) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts' words, then of all their word pairs; and each one's text."""
    from tessera.llm.textnum import arrow_text, mix, ngrams, words

    data, starts = arrow_text(column)
    hashed, _, _, first = words(data, starts)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(first))
    pairs = ngrams(hashed, 2)
    same = text[1:] == text[:-1]
    buckets = np.concatenate([mix(hashed), mix(pairs[same] + np.uint64(1))]) & np.uint64(BUCKETS - 1)
    return buckets.astype(np.int64), np.concatenate([text, text[1:][same]])


def _batches(batches):
    from tessera.llm.chunks import small_batches

    return small_batches(batches, most=4 << 20)


#: Marks of labelled texts: bad or good of the half that fits, then of the half that sets the threshold.
FIT_GOOD, CUT_BAD, CUT_GOOD = 1, 2, 3


def _labels_of(batch, table) -> np.ndarray:
    ids, marks = table
    rows = batch.column("id").to_pylist()
    if not len(ids):
        return np.full(len(rows), -1)
    key = np.array([-(1 << 63) if r is None else r for r in rows], np.int64)
    at = np.minimum(np.searchsorted(ids, key), len(ids) - 1)
    return np.where(ids[at] == key, marks[at], -1)


def _count(labels):
    def count(batches):
        import pyarrow as pa

        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in _batches(batches):
            buckets, text = _features(batch.column("text"))
            raw += np.bincount(buckets, minlength=BUCKETS)
            good = _labels_of(batch, labels.value) == FIT_GOOD
            target += np.bincount(buckets[good[text]], minlength=BUCKETS)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(raw[seen]), pa.array(target[seen])], names=["bucket", "raw", "target"])

    return count


def _score(weights, labels):
    def score(batches):
        import pyarrow as pa

        weight = weights.value
        for batch in _batches(batches):
            n = batch.num_rows
            buckets, text = _features(batch.column("text"))
            sums = np.bincount(text, weights=weight[buckets], minlength=n).astype(np.float64)  # of nothing, the counts are whole numbers
            sizes = np.bincount(text, minlength=n)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sums), pa.array(sizes.astype(np.int64)), pa.array(_labels_of(batch, labels.value).astype(np.int32))], names=["id", "log_weight", "n_features", "mark"])

    return score


def log_ratios(raw: np.ndarray, target: np.ndarray, shrink: float = SHRINK) -> np.ndarray:
    """Per bucket the log of target over raw probability, drawn towards 0 where few were seen."""
    expected = raw * (target.sum() / max(raw.sum(), 1))
    added = shrink * max(target.sum(), 1)
    return np.log((target + added) / (expected + added))


def threshold(scores: np.ndarray, good: np.ndarray) -> float:
    """The cut that loses the least: a good text lost counts ten times a bad one kept."""
    order = np.argsort(scores, kind="stable")
    scores, good = scores[order], good[order]
    lost = np.concatenate([[0], np.cumsum(good)]) * 10
    kept = np.concatenate([[0], np.cumsum(~good)])
    k = int(np.argmin(lost + (~good).sum() - kept))
    if k == 0:
        return -np.inf
    return float(scores[k - 1] if k == len(scores) else (scores[k - 1] + scores[k]) / 2)


def select_top(keyed: DataFrame, k: int) -> DataFrame:
    """``keyed`` (id, key, ...) with ``kept``: the k largest keys and those equal to the k-th. Counts
    per bin narrow the k-th key down, so that no task and no driver sees more than the bins."""
    n_bins = 4096
    if k <= 0:
        return keyed.withColumn("kept", F.lit(False))
    low, high = keyed.agg(F.min("key"), F.max("key")).first()
    above = 0
    while low is not None and low < high:
        width = (high - low) / n_bins
        if width <= 0 or low + width == low:
            break
        inside = keyed.filter(F.col("key").between(low, high))
        bins = F.least(F.floor((F.col("key") - low) / width), F.lit(n_bins - 1)).cast("int")
        rows = inside.groupBy(bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy(F.desc("bin")).collect()
        for row in rows:
            if above + row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            above += row["n"]
        else:
            low = high
        if above + row["n"] == k:
            high = low
            break
    return keyed.withColumn("kept", F.col("key") >= low)


def resample(docs: DataFrame, labels: DataFrame, shrink: float = SHRINK, temperature: float = TEMPERATURE, seed: int = SEED, labelled: int = LABELLED, keep: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, log_weight, key, kept.

    ``labels`` names good texts by quality 1 and toxic not 1. ``keep`` fixes the number
    drawn; by default it is set by the threshold. Texts without words (null too) have the
    log weight 0. Rows whose keys are equal are kept or rejected together, so k may be
    exceeded by such ties. Rows with a null id are scored as unlabelled. An id's
    label is the worst of its labels. Without labels in the half that sets the threshold
    all rows are kept. Texts are read whole, however long; rows that repeat are scored
    alike and drawn alike. Columns of other names are not read, whatever they are. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1)).cast("int")
    chosen = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(good).alias("good"))
    half = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(2)).cast("int")
    rows = chosen.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(labelled).select("id", F.col("good") + 2 * half).collect()
    rows = sorted((r[0], r[1]) for r in rows)
    table = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)))
    named = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    counted = named.mapInArrow(_count(table), "bucket INT, raw BIGINT, target BIGINT").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in counted.toLocalIterator():
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    weights = spark.sparkContext.broadcast(log_ratios(raw, target, shrink))
    scored = stored(named.mapInArrow(_score(weights, table), "id BIGINT, log_weight DOUBLE, n_features BIGINT, mark INT"), "scored")
    # uniform in (0, 1) from the row itself, so that a rerun draws alike
    u = (F.shiftrightunsigned(F.xxhash64("id", "log_weight", "n_features", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = stored(scored.withColumn("key", F.col("log_weight") - F.lit(temperature) * F.log(-F.log(u))), "keyed")
    if keep is None:
        # as many as labelled ids: of rows that repeat one, the smallest score counts
        marked = keyed.filter(F.col("mark") >= CUT_BAD).groupBy("id").agg(F.min("log_weight"), F.min("mark")).collect()
        cut = threshold(np.array([r[1] for r in marked]), np.array([r[2] == CUT_GOOD for r in marked])) if marked else -np.inf
        keep = keyed.count() if cut == -np.inf else keyed.filter(F.col("log_weight") > cut).count()
    return select_top(keyed, keep).select(F.col("id").alias(id_col), "log_weight", "key", "kept")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.filter("kept")
