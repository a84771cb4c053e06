"""Ranked lexical search: every document against a stated set of items, by MaxScore in each shard.

Items go in blocks of bounded bytes. A first pass over the documents keeps, of each, the
block's terms with their counts (a forward index in the shared folder) and, of each task, its
sums, which give the corpus statistics over all documents. A second pass turns each shard of
the index into posting lists with an upper bound each. Per item the lists are split: those of
the smallest bounds whose sum stays below the k-th best score so far are non-essential. Only
documents of essential lists are scored; non-essential postings are probed, greatest bound
first, only for documents that can still reach that score. Each task's k best of an item meet
in two steps, so that no item's hits are ranked by one task.

Defined results: null texts and texts without a term match nothing and are not counted; a
text of any length is read whole, in segments; each row is a document of its own, so that
repeated rows are ranked beside each other; equal scores rank by ascending ``doc_id``, null
ids last; of rows with one ``item_id`` (null is an id too) the smallest text counts; an item
without terms, or whose terms no document holds, has no rows; empty tables give none; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import ship, stored
from tessera.llm.textnum import _LOWER, LONG_WORD, _hash_words, arrow_text

#: Items are asked in blocks of at most so many, and so many bytes of text (one item at least).
BLOCK_ITEMS, BLOCK_BYTES = 4096, 4 << 20
#: Postings of a shard, which bound a task's memory; a task has as many shards as it needs.
SHARD_POSTINGS = 1 << 20
#: Documents of a shard's first range; each further range has eight times as many.
FIRST_RANGE = 512
#: Bytes of text looked at in one step.
SEGMENT = 1 << 20
#: An item's hits meet in so many groups before they are ranked.
SALTS = 32
TOP = 20

_IN_TERM = np.zeros(256, dtype=bool)
_IN_TERM[ord("0") : ord("9") + 1] = _IN_TERM[ord("A") : ord("Z") + 1] = _IN_TERM[ord("a") : ord("z") + 1] = True
_IN_TERM[0x80:] = True


def _segments(data: bytes, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Lower-cased bytes (eight more than the segment's) and the places of the terms in them, and the
    text that each term is of."""
    raw = np.frombuffer(data, dtype=np.uint8)[: starts[-1]]
    lo = int(starts[0])
    while lo < len(raw):
        hi = min(lo + SEGMENT, len(raw))
        while hi < len(raw) and _IN_TERM[raw[hi]] and _IN_TERM[raw[hi - 1]]:  # no term is cut
            gap = np.flatnonzero(~_IN_TERM[raw[hi : hi + 4096]])
            hi = min(hi + (int(gap[0]) if len(gap) else 4096), len(raw))
        n = hi - lo
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = _IN_TERM[raw[lo:hi]]
        first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        cuts = starts[(starts > lo) & (starts < hi)] - lo  # a text's end ends a term
        first[cuts] |= inside[1:-1][cuts]
        last[cuts - 1] |= inside[1:-1][cuts - 1]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        low = np.zeros(n + 8, np.uint8)
        low[:n] = _LOWER[raw[lo:hi]]
        yield low, begin, end, np.searchsorted(starts, begin + lo, "right") - 1
        lo = hi


def terms_of(text: str | None) -> Counter:
    """The terms of one text with their occurrences."""
    data = (text or "").encode()
    out: Counter = Counter()
    for low, begin, end, _ in _segments(data, np.array([0, len(data)])):
        out.update(low[b:e].tobytes() for b, e in zip(begin.tolist(), end.tolist(), strict=True))
    return out


class Lexicon:
    """The terms of a block of items, found among the words of texts by hash and then byte by byte."""

    def __init__(self, terms: list[bytes]):
        length = np.array([len(t) for t in terms], dtype=np.int64)
        self.begin = np.cumsum(length) - length
        self.end = self.begin + length
        self.low = np.frombuffer(b"".join(terms) + bytes(8), dtype=np.uint8)
        self.lane = next(k for k in range(2) if len(np.unique(_hash_words(self.low, self.begin, self.end, k))) == len(terms))
        hashed = _hash_words(self.low, self.begin, self.end, self.lane)
        self.order = np.argsort(hashed)
        self.hashed = hashed[self.order]
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[self.hashed >> np.uint64(44)] = True

    def __len__(self) -> int:
        return len(self.begin)

    def find(self, low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words are terms, and which terms they are."""
        hashed = _hash_words(low, begin, end, self.lane)
        at = np.flatnonzero(self.seen[hashed >> np.uint64(44)])
        place = np.minimum(np.searchsorted(self.hashed, hashed[at]), len(self) - 1)
        same = self.hashed[place] == hashed[at]
        at, term = at[same], self.order[place[same]]
        length = self.end[term] - self.begin[term]
        equal = length == end[at] - begin[at]
        for j in np.flatnonzero(equal & (length > LONG_WORD)).tolist():  # equal hashes are equal words but for a clash
            equal[j] = self.low[self.begin[term[j]] : self.end[term[j]]].tobytes() == low[begin[at[j]] : end[at[j]]].tobytes()
        for k in range(LONG_WORD):
            left = np.flatnonzero(equal & (length > k) & (length <= LONG_WORD))
            if not len(left):
                break
            equal[left] = self.low[self.begin[term[left]] + k] == low[begin[at[left]] + k]
        return at[equal], term[equal]


_FORWARD = "doc_id BIGINT, n BIGINT, docs BIGINT, terms ARRAY<INT>, counts ARRAY<INT>"


def _lists(keys: np.ndarray, counts: np.ndarray, width: int):
    """Of sorted keys (row * width + term): the rows and, for each, its terms and counts as Arrow lists."""
    import pyarrow as pa

    rows, at = np.unique(keys // width, return_index=True)
    offsets = pa.array(np.append(at, len(keys)).astype(np.int32))
    make = lambda v: pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32)))
    return rows, make(keys % width), make(counts)


def _forward(shared):
    """A row for each document that holds a term of the block, and one for each task (with docs): the
    documents with any term, all their terms, and in how many documents each of the block's is."""

    def run(batches):
        import pyarrow as pa

        lexicon = shared.value
        width = len(lexicon)
        held, length, n_docs = np.zeros(width, np.int64), 0, 0
        for batch in batches:
            data, starts = arrow_text(batch.column("text"))
            n, keys = np.zeros(batch.num_rows, np.int64), []
            for low, begin, end, text in _segments(data, starts):
                n += np.bincount(text, minlength=batch.num_rows)
                at, term = lexicon.find(low, begin, end)
                keys.append(text[at] * width + term)
            keys, counts = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
            held += np.bincount(keys % width, minlength=width)
            length, n_docs = length + int(n.sum()), n_docs + int((n > 0).sum())
            if len(keys):
                rows, terms, counts = _lists(keys, counts, width)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(n[rows]), pa.nulls(len(rows), pa.int64()), terms, counts], names=["doc_id", "n", "docs", "terms", "counts"])
        if n_docs:
            there = np.flatnonzero(held)
            one = lambda v: pa.array([v.tolist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([length]), pa.array([n_docs]), one(there), one(held[there])], names=["doc_id", "n", "docs", "terms", "counts"])

    return run


class Best:
    """The best documents of an item so far: scores, ids and whether these are null."""

    def __init__(self, k: int):
        self.k, self.least = k, 0
        self.score, self.doc, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = np.concatenate([self.score, score]), np.concatenate([self.doc, doc]), np.concatenate([self.null, null])
        if len(score) > self.k:
            likely = np.flatnonzero(score >= np.partition(score, len(score) - self.k)[len(score) - self.k])
            score, doc, null = score[likely], doc[likely], null[likely]
        order = np.lexsort((doc, null, -score))[: self.k]
        self.score, self.doc, self.null = score[order], doc[order], null[order]
        if len(order) == self.k:
            self.least = int(self.score[-1])


class Shard:
    """Posting lists of some documents: of each term the places of its documents and what it adds to
    their scores, and the greatest such addition."""

    def __init__(self, doc: np.ndarray, null: np.ndarray, m: np.ndarray, place: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray):
        self.doc, self.null = doc, null
        order = np.argsort(term, kind="stable")
        term, self.place, tf = term[order], place[order], tf[order]
        self.adds = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[self.place]))
        self.at = np.searchsorted(term, np.arange(len(weight) + 1))
        self.bound = np.zeros(len(weight), np.int64)
        full = np.flatnonzero(np.diff(self.at))
        if len(full):
            self.bound[full] = np.maximum.reduceat(self.adds, self.at[full])

    def search(self, terms: np.ndarray, times: np.ndarray, best: Best) -> int:
        """Adds the item's best documents here; returns how many documents were scored."""
        bound = self.bound[terms] * times
        some = np.flatnonzero(bound)
        order = some[np.argsort(bound[some], kind="stable")]
        terms, times, upto = terms[order].tolist(), times[order].tolist(), np.cumsum(bound[order])
        lo, size, scored = 0, FIRST_RANGE, 0
        while lo < len(self.doc) and len(order) and upto[-1] >= best.least:
            hi = min(lo + size, len(self.doc))
            # lists whose bounds add up to less than the least score cannot bring a document in alone
            essential = int(np.searchsorted(upto, best.least, "left")) if best.least else 0
            sums = np.zeros(hi - lo, np.int64)
            for t, times_t in zip(terms[essential:], times[essential:], strict=True):
                places = self.place[self.at[t] : self.at[t + 1]]
                a, b = np.searchsorted(places, (lo, hi)) + self.at[t]
                sums[self.place[a:b] - lo] += times_t * self.adds[a:b]
            found = np.flatnonzero(sums)
            sums = sums[found]
            for j in range(essential - 1, -1, -1):
                can = sums + upto[j] >= best.least
                found, sums = found[can], sums[can]
                if not len(found):
                    break
                places = self.place[self.at[terms[j]] : self.at[terms[j] + 1]]
                near = np.minimum(np.searchsorted(places, found + lo), len(places) - 1)
                sums = sums + np.where(places[near] == found + lo, times[j] * self.adds[self.at[terms[j]] + near], 0)
            can = sums >= max(best.least, 1)
            best.add(sums[can], self.doc[found[can] + lo], self.null[found[can] + lo])
            scored += len(found)
            lo, size = hi, size * 8
        return scored


def _search(shared, k: int):
    def run(batches):
        import pyarrow as pa

        items, weight, n_docs, length = shared.value
        best = [Best(k) for _ in items]
        parts, postings = [], 0

        def flush():
            doc, null, n, sizes, term, tf = (np.concatenate([p[j] for p in parts]) for j in range(6))
            shard = Shard(doc, null, 75 + (25 * n * n_docs) // length, np.repeat(np.arange(len(doc)), sizes), term, tf.astype(np.int64), weight)
            for (_, terms, times), b in zip(items, best, strict=True):
                shard.search(terms, times, b)

        for batch in batches:
            ids = batch.column("doc_id")
            lists = batch.column("terms")
            sizes = np.diff(lists.offsets.to_numpy())
            parts.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), batch.column("n").to_numpy(), sizes, lists.flatten().to_numpy(), batch.column("counts").flatten().to_numpy()))
            postings += len(parts[-1][4])
            if postings >= SHARD_POSTINGS:
                flush()
                parts, postings = [], 0
        if parts:
            flush()
        for (item, _, _), b in zip(items, best, strict=True):
            if len(b.score):
                n = len(b.score)
                yield pa.RecordBatch.from_arrays([pa.array([item] * n, pa.int64()), pa.array(b.doc, mask=b.null), pa.array(b.score)], names=["item_id", "doc_id", "score"])

    return run


def _blocks(items: DataFrame) -> Iterator[list]:
    """The items as rows (item_id, text), in blocks; the driver holds one at a time."""
    held, size = [], 0
    for row in items.groupBy("item_id").agg(F.min("text").alias("text")).toLocalIterator():
        if held and (len(held) >= BLOCK_ITEMS or size + 4 * len(row["text"] or "") > BLOCK_BYTES):
            yield held
            held, size = [], 0
        held.append(row)
        size += 4 * len(row["text"] or "")
    if held:
        yield held


def _block_hits(docs: DataFrame, block: list, k: int) -> DataFrame | None:
    spark = docs.sparkSession
    counted = [(row["item_id"], terms_of(row["text"])) for row in block]
    terms = sorted({t for _, c in counted for t in c})
    if not terms:
        return None
    number = {t: j for j, t in enumerate(terms)}
    forward = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_forward(spark.sparkContext.broadcast(Lexicon(terms))), _FORWARD), "forward-index")
    tasks = forward.filter("docs IS NOT NULL")
    sums = tasks.agg(F.sum("docs").alias("docs"), F.sum("n").alias("length")).first()
    if not sums["docs"]:
        return None
    weight = np.zeros(len(terms), np.int64)
    held = tasks.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("df"))
    for row in held.collect():  # a row for each of the block's terms at most
        weight[row["terms"]] = math.floor(1000 * math.log((2 * sums["docs"] + 2) / (2 * row["df"] + 1)))
    items = [(item, np.array([number[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for item, c in counted if c]
    shared = spark.sparkContext.broadcast((items, weight, sums["docs"], sums["length"]))
    postings = forward.filter("docs IS NULL").select("doc_id", "n", "terms", "counts")
    return stored(postings.mapInArrow(_search(shared, k), "item_id BIGINT, doc_id BIGINT, score BIGINT"), "search-hits")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    hits = [h for block in _blocks(items.select(F.col("item_id").cast("long").alias("item_id"), "text")) if (h := _block_hits(docs, block, k)) is not None]
    if not hits:
        return spark.createDataFrame([], "item_id BIGINT, rank INT, doc_id BIGINT, score BIGINT")
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    salted = reduce(DataFrame.unionByName, hits).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).filter(F.col("rank") <= k)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op13_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all ``documents`` for each item of ``benchmark``."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return ranked_search(docs.select("doc_id", "text"), items.select("item_id", "text"))


OP13_SQL = r"""
WITH found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM found GROUP BY 1, 2),
lengths AS (SELECT doc_id, count(*) AS n FROM found GROUP BY 1),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM lengths),
norms AS (SELECT doc_id, 75 + (25 * n * docs) // len AS m FROM lengths, corpus),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tfs, corpus WHERE term IN (SELECT term FROM asked) GROUP BY term, docs),
scores AS (
  SELECT item_id, t.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked a JOIN weights USING (term) JOIN tfs t USING (term) JOIN norms d ON d.doc_id = t.doc_id GROUP BY 1, 2),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
