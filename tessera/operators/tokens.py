"""Token rows for training: lengths, truncation, padding, batches, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.draw import shuffle_key
from tessera.operators.scan import first_rows, numbered, running_sums

IGNORED = -100


def length_metrics(most: int) -> dict[str, Column]:
    """Aggregates of (prompt_tokens, target_tokens): examples read, kept, too long, truncated, target
    tokens kept. The end token counts with the target."""
    target = F.size("target_tokens") + 1
    kept = target <= most
    return {
        "read": F.count(F.lit(1)),
        "kept": F.count_if(kept),
        "too_long": F.count_if(~kept),
        "truncated": F.count_if(kept & (F.size("prompt_tokens") + target > most)),
        "target_tokens": F.coalesce(F.sum(F.when(kept, target)), F.lit(0)),
    }


def length_stats(examples: DataFrame, most: int) -> DataFrame:
    return examples.agg(*(c.alias(k) for k, c in length_metrics(most).items()))


def length_filter(examples: DataFrame, most: int) -> DataFrame:
    return examples.filter(F.size("target_tokens") + 1 <= most)


def encode_example(prompt: Column, target: Column, end: int, most: int) -> tuple[Column, Column]:
    """(input_ids, labels): target with end token; the prompt is cut on the left, then the target on the right."""
    whole = F.array_append(target, F.lit(end))
    over = F.greatest(F.size(prompt) + F.size(whole) - most, F.lit(0))
    dropped = F.least(over, F.size(prompt))
    left = F.slice(prompt, dropped + 1, F.size(prompt) - dropped)
    right = F.slice(whole, F.lit(1), F.least(F.size(whole), F.lit(most) - F.size(left)))
    return F.concat(left, right), F.concat(F.array_repeat(F.lit(IGNORED), F.size(left)), right)


def collate(encoded: DataFrame, pad: int, batch_col: str = "batch") -> DataFrame:
    """Right-pads input_ids and labels to the longest of each batch and adds attention_mask."""
    widest = encoded.groupBy(batch_col).agg(F.max(F.size("input_ids")).alias("_width"))
    n = F.size("input_ids")
    fill = F.col("_width") - n
    padded = lambda c, v: F.concat(F.col(c), F.array_repeat(F.lit(v), fill))
    return (
        encoded.join(widest, batch_col)
        .withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), fill)))
        .withColumn("labels", padded("labels", IGNORED))
        .withColumn("input_ids", padded("input_ids", pad))
        .drop("_width")
    )


def keep_right(tokens: Column, most: int) -> Column:
    """The last ``most`` tokens."""
    n = F.least(F.size(tokens), F.lit(most))
    return F.slice(tokens, F.size(tokens) - n + 1, n)


def weighted_loss(examples: DataFrame, by: list[str], guarded: bool = False) -> DataFrame:
    """Of (token_losses, token_hits, weight): loss (weighted mean of mean token losses), tokens,
    correct tokens, exact examples. ``guarded`` takes 1 for a smaller sum of weights."""
    mean = F.aggregate("token_losses", F.lit(0.0), lambda a, x: a + x) / F.size("token_losses")
    hits = F.size(F.filter("token_hits", lambda h: h))
    weights = F.sum("weight")
    return examples.groupBy(*by).agg(
        (F.sum(mean * F.col("weight")) / (F.greatest(weights, F.lit(1.0)) if guarded else weights)).alias("loss"),
        F.sum(F.size("token_losses")).alias("target_tokens"),
        F.sum(hits).alias("correct_tokens"),
        F.count_if(hits == F.size("token_hits")).alias("exact_proofs"),
    )


def validation_rollup(batches: DataFrame) -> DataFrame:
    """Of (loss, examples, target_tokens, correct_tokens, exact_proofs) per batch: the example-weighted
    loss, perplexity, token and proof accuracy."""
    loss = F.sum(F.col("loss") * F.col("examples")) / F.sum("examples")
    return batches.agg(
        loss.alias("loss"), F.exp(loss).alias("perplexity"), (F.sum("correct_tokens") / F.sum("target_tokens")).alias("token_accuracy"), (F.sum("exact_proofs") / F.sum("examples")).alias("exact_proof_accuracy")
    )


def epoch_rollup(steps: DataFrame) -> DataFrame:
    return steps.groupBy("epoch").agg((F.sum(F.col("loss") * F.col("examples")) / F.sum("examples")).alias("loss"), F.sum("examples").alias("examples"), F.sum("target_tokens").alias("target_tokens"))


def cumulative_seen(steps: DataFrame, run_col: str, order: str = "step") -> DataFrame:
    """Running sums within each run, however long it is."""
    return running_sums(steps, [order], {"examples_seen": "examples", "tokens_seen": "target_tokens"}, [run_col])


def epoch_permutation(examples: DataFrame, epochs: int, seed: int, id_col: str = "id") -> DataFrame:
    """A seeded order of the examples for each epoch (place from 0)."""
    wide = examples.select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    keyed = wide.withColumn("_key", shuffle_key(F.col("epoch") + seed, "epoch", id_col))
    return numbered(keyed, ["_key", id_col], ["epoch"], "place").drop("_key")


def fixed_sample(examples: DataFrame, size: int, seed: int, id_col: str = "id") -> DataFrame:
    """A uniform sample of fixed size, the same on every run."""
    return first_rows(examples, [shuffle_key(seed, "validation", id_col), id_col], size)


def mean_pool(hidden: Column, mask: Column) -> Column:
    """Mean of the token vectors where the mask is 1, by dimension."""
    n = F.aggregate(mask, F.lit(0.0), lambda a, m: a + m)
    kept = F.zip_with(hidden, mask, lambda h, m: F.transform(h, lambda x: x.cast("double") * m))
    first = F.transform(hidden[0], lambda x: F.lit(0.0))
    total = F.aggregate(kept, first, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / n)


def amortised(df: DataFrame, elapsed: str, batch_col: str) -> DataFrame:
    """A batch's seconds spread over its rows."""
    size = df.groupBy(batch_col).agg(F.count(F.lit(1)).alias("_rows"))
    return df.join(size, batch_col).withColumn("duration_seconds", F.col(elapsed) / F.col("_rows")).drop("_rows")


def shuffled_batches(examples: DataFrame, epochs: int, seed: int, size: int, id_col: str = "id") -> DataFrame:
    """Each epoch's permutation in mini-batches of ``size``."""
    return epoch_permutation(examples, epochs, seed, id_col).withColumn("batch", F.floor(F.col("place") / size))


def mean_loss(losses: DataFrame) -> DataFrame:
    return losses.agg(F.avg("loss").alias("loss"))
