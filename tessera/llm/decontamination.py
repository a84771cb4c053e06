"""Finds benchmark items inside documents.

Documents are cut into windows as long as an item; windows and items meet by 64-bit
SimHash of their five-word shingles, then exactly. Positions of the items' shingles in
the texts decide where windows are cut: any of them may start a window, whatever the
order of what it shares with an item. Not cut are windows that cannot be an item's best:
those with too few of an item's shingles for the similarity, and those whose left
neighbour shares as much. What a window was cut for is forgotten: which items it meets
is found by multi-index Hamming blocks alone. A block of an item's fingerprint is listed
under all values that few bits tell apart, a window's under those of one bit; the blocks'
bits add up so that no pair within the radius is missed. All DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored, whole_text

WORDS = 5
SIMILARITY = 0.75
#: Fingerprints at 0.75 differ in 11 of 64 bits on the mean with a deviation of 3, those of unrelated
#: texts in 32 with a deviation of 4; pairs beyond the similarity are sorted out exactly.
RADIUS = 20
BLOCKS, BLOCK_BITS = 4, 16
#: Shingles whose bits are counted in lanes of 16 bits at most.
LANE_COUNT = (1 << 16) - 1
#: Rows sent to all executors at most; beyond it, the join shuffles.
BROADCAST_ROWS = 1_000_000


def word_list(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(words: Column, n: int = WORDS) -> Column:
    """A 64-bit hash for each ``n`` words in a row; none with fewer words."""

    def of(ws: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(ws) - n + 1, F.lit(1)))
        return F.when(F.size(ws) >= n, F.transform(starts, lambda k: F.xxhash64(F.slice(ws, k, n)))).otherwise(F.array().cast("array<bigint>"))

    # as a lambda's argument the words are made once, not once for each shingle
    return F.transform(F.array(words), of)[0]


def simhash(hashes: Column) -> Column:
    """Bit k is 1 when more occurrences of shingles have it than not. Up to 65,535 shingles, each
    number of 16 sums counts four bits at once."""
    right = lambda h, k: F.call_function("shiftrightunsigned", h, k)
    ones = lambda mask, k: F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + right(h, k).bitwiseAND(F.lit(mask).cast("long")))
    four, single = sum(1 << 16 * j for j in range(4)), 1
    lanes = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: ones(four, k))
    apart = lambda sums: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: right(F.get(sums, k % 16), F.floor(k / 16).cast("int") * 16).bitwiseAND(F.lit(LANE_COUNT).cast("long")))
    plain = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: ones(single, k))
    # as a lambda's argument the sums are made once, not once for each bit
    counts = F.when(F.size(hashes) <= LANE_COUNT, F.transform(F.array(lanes), apart)[0]).otherwise(plain)
    bits = F.transform(counts, lambda c, k: F.when(c * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity weighted by occurrences: sum of smaller over sum of larger counts."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    shared = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    return shared / (F.size(a) + F.size(b) - shared)


def _block(fingerprint: Column, k: Column) -> Column:
    return F.call_function("shiftrightunsigned", fingerprint, k * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def block_radii(radius: int) -> list[int]:
    """Differing bits that each block allows (-1: none is looked up): of a pair within ``radius`` some
    block differs in no more, as bits beyond them in every block would be ``radius + 1`` together."""
    share = radius + 1 - BLOCKS
    return [max(-1, share // BLOCKS + (k < share % BLOCKS)) for k in range(BLOCKS)]


def _listed(prints: DataFrame, name: str, flips: list[int]) -> DataFrame:
    """The rows once for each block and each value that at most the block's ``flips`` bits tell apart."""
    masks = [[m for m in range(1 << BLOCK_BITS) if m.bit_count() <= f] for f in flips]
    literal = "array(" + ",".join("cast(array(" + ",".join(map(str, m)) + ") AS array<int>)" for m in masks) + ")"
    each = prints.select("*", F.posexplode(F.expr(literal)).alias("block", "masks"))
    one = each.select(*prints.columns, "block", F.explode("masks").alias("mask"))
    return one.select(*prints.columns, "block", _block(F.col(name), F.col("block")).bitwiseXOR(F.col("mask")).alias("value"))


def block_candidates(windows: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The pairs that meet in a block, each once: (print, item_print) and the columns that both tables have,
    which must be equal (the windows' length)."""
    same = [c for c in windows.columns if c != "print"]
    radii = block_radii(radius)
    window_flips = [min(r, 1) for r in radii]
    item_flips = [r - f if r > 0 else r for r, f in zip(radii, window_flips, strict=True)]
    met = _listed(windows, "print", window_flips).join(_listed(items, "item_print", item_flips).hint("merge"), [*same, "block", "value"])
    return met.select("print", "item_print", *same).distinct()


def hamming_pairs(windows: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs of two tables of distinct fingerprints (print; item_print) within ``radius``; columns
    that both tables have beside them are equal in a pair."""
    return block_candidates(windows, items, radius).filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)


def window_starts(hits: DataFrame, least: float) -> DataFrame:
    """Where windows are cut: (key, starts), an array of the distinct (pos, n) of a text.

    ``hits`` holds the distinct (key, size, item_key, n, pos): that the shingle at ``pos`` of a text of
    ``size`` shingles is one of an item of ``n``. A text's hits with one item stand in one array, which
    the text's length bounds.
    """
    places = hits.groupBy("key", "size", "item_key", "n").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    places = places.filter(F.size("at") >= least * F.col("n") - 1e-9)
    width = lambda p: F.least(F.col("n"), F.col("size") - p)
    needed = lambda p: F.ceil(least * (width(p) + F.col("n")) / (1 + least) - 1e-9).cast("int")
    # the last of the shingles needed lies within the window
    enough = lambda p, i: F.coalesce(F.get("at", i + needed(p) - 1) < p + width(p), F.lit(False))
    # the window one place to the left shares as much and is no longer
    after_as_good = lambda p, i: F.coalesce(F.get("at", i - 1) == p - 1, F.lit(False)) & (p + F.col("n") <= F.col("size")) & ~F.array_contains("at", p + F.col("n") - 1)
    tried = places.select("key", "n", F.explode(F.filter("at", lambda p, i: enough(p, i) & ~after_as_good(p, i))).alias("pos"))
    return tried.distinct().groupBy("key").agg(F.collect_list(F.struct("pos", "n")).alias("starts"))


def contamination(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per (document, item) found: id, item_id, similarity (of the best window).

    Null texts count as empty. Items and texts with fewer than five words have no
    shingles and are found nowhere. Equal items are all reported, and so are several items
    at one similarity; of several windows the best counts. Texts are cut whole, however
    long; equal texts are cut once. Rows that repeat an id are one document; rows with a
    null id are the document without id. Other columns are not read, whatever their names.
    An empty table on either side gives no rows.
    """
    words = word_list(whole_text(item_text_col))
    items = benchmark.select(F.col(item_col).alias("item_id"), shingle_hashes(words).alias("item_hashes")).filter(F.size("item_hashes") > 0)
    items = stored(items.withColumn("item_print", simhash(F.col("item_hashes"))).withColumn("n", F.size("item_hashes")), "items")
    shapes = items.select("item_hashes", "n").distinct().select(F.xxhash64("item_hashes").alias("item_key"), "n", F.explode("item_hashes").alias("hash"))
    shingles = stored(shapes.distinct(), "item-shingles")
    sent = _by_count(shingles)

    # which text a shingle is of is named by its digest: nothing longer goes through a shuffle
    keyed = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")).withColumn("key", F.unhex(F.sha2("text", 256)))
    hashed = keyed.select("key", shingle_hashes(word_list(F.col("text"))).alias("hashes"))
    placed = hashed.select("key", F.size("hashes").alias("size"), F.posexplode("hashes").alias("pos", "hash"))
    hits = placed.join(sent, "hash").select("key", "size", "item_key", "n", "pos").distinct()
    starts = stored(window_starts(hits, least), "window-starts")

    cut = keyed.select("key", "text").join(_by_count(starts.select("key")), "key", "left_semi").dropDuplicates(["key"])
    cut = cut.select("key", shingle_hashes(word_list(F.col("text"))).alias("hashes")).join(starts.hint("merge"), "key")
    cut = cut.select("key", "hashes", F.explode("starts").alias("start")).select("key", F.col("start.n").alias("n"), F.expr("slice(hashes, start.pos + 1, start.n)").alias("window"))
    windows = stored(cut.dropDuplicates(["key", "n", "window"]), "windows")
    prints = stored(windows.select("n", "window").distinct().withColumn("print", simhash(F.col("window"))), "window-prints")

    pairs = stored(hamming_pairs(prints.select("print", "n").distinct(), items.select("item_print", "n").distinct(), radius), "print-pairs")
    # distinct windows meet their items once; then all places of a window
    met = prints.join(pairs.hint("merge"), ["print", "n"]).join(items.hint("merge"), ["item_print", "n"])
    found = met.withColumn("similarity", similarity(F.col("window"), F.col("item_hashes"))).filter(F.col("similarity") >= least)
    found = windows.join(found.select("n", "window", "item_id", "similarity").hint("merge"), ["n", "window"])
    found = stored(found.groupBy("key", "item_id").agg(F.max("similarity").alias("similarity")), "found-texts")
    where = keyed.select("id", "key").join(_by_count(found), "key")
    return where.groupBy("id", "item_id").agg(F.max("similarity").alias("similarity")).withColumnRenamed("id", id_col)


def _by_count(rows: DataFrame) -> DataFrame:
    """To be sent to all executors where the rows counted are few, else to be shuffled."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows.hint("merge")


def op9_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
