"""Self-join of texts by the Jaccard similarity of their word 5-gram sets, to components.

Size-aware heavy-light join. All texts with one set are one class. A global order puts
tokens (shingle hashes) that are frequent in the corpus last, and before those the ones
of frequent words. Two sets that reach the
threshold share k tokens among their first s - o + k (s: size, o: the overlap that any
partner must have), for any k up to o. Light sets, up to a boundary size, enumerate all
2-subsets of that prefix for k = 2 and meet in equal subsets; heavy sets scan the
inverted lists of their prefix (k grows with o), where light sets large enough to be
partners are listed too, and are candidates when they meet in k lists. The boundary is
the size that minimises the estimated cost (subsets enumerated against list entries
scanned).

Inverted lists are streamed in sorted order, never gathered. Members are compared with
their list's pivot first; components of the links found collapse groups of copies. Lists
that then hold several components still may hide links between members that the pivots
do not link. What differs from the pivot finds these: with D(x) the tokens that x has and
the pivot lacks and those that it lacks and the pivot has, the sets x and y differ by
|D(x)| + |D(y)| - 2 |D(x) n D(y)| tokens, so if they are linked and the pivot is not
linked to both, D(x) and D(y) have an overlap that the sizes bound from below. Prefixes
of the differences are listed and met like prefixes of sets; what all of a group has in
common is in none of them, so that a group costs what its members differ by. What is too
far from the pivot to be linked to anything that is linked to it meets in full, but only
what is not linked to the pivot either; so do short lists. Candidate search loses no link; every candidate is compared exactly.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import most_frequent, ship, stored, whole_text
from tessera.llm.components import components
from tessera.llm.textnum import WORD_BUCKETS

WORDS = 5
#: Linked when NUM * union <= DEN * intersection.
NUM, DEN = 75, 100
#: The order ranks so many of the most frequent tokens last; it changes cost, never results.
HOT_TOKENS = 1 << 21
#: Members of a hot list for each of its sub-lists; comparisons of a pivot for each of its tasks.
LIST_PART, PIVOT_PART = 2000, 256
#: Sizes up to this may be light.
LIGHTEST = 64
#: Lists with more sets than this outside their largest component meet by differences from a pivot.
FEW_STRANGERS = 16
#: Bits of a set's name (64: all); sets whose names clash take the next 64 bits of their digest.
NAME_BITS = 64
#: Rows sent to all executors at most; beyond it, the join shuffles.
BROADCAST_ROWS = 1_000_000


def least_overlap(size, num: int = NUM, den: int = DEN):
    """The smallest overlap with any partner of a set of ``size``."""
    return -(-size * num // den)


def needed(overlap):
    """How many tokens of their prefixes two sets must share whose smaller one has this least overlap."""
    return 1 + overlap // 32


def prefix(size, num: int = NUM, den: int = DEN):
    overlap = least_overlap(size, num, den)
    return size - overlap + needed(overlap)


def _name(tokens: np.ndarray, second: np.ndarray, naming) -> tuple[int, int]:
    """A set's name and 64 bits to check it by, from the digest of both lanes of its hashes."""
    bits, clashing = naming
    digest = hashlib.blake2b(tokens.tobytes() + second.tobytes(), digest_size=16).digest()
    name, check = (int.from_bytes(digest[k : k + 8], "little", signed=True) for k in (0, 8))
    name >>= 64 - bits
    return (check if name in clashing else name), check


def _batches(batches):
    from tessera.llm.chunks import small_batches

    return small_batches(batches, most=4 << 20)


def _describe(n_words: int, naming):
    """Kind 0: (id, size, sid, check); kind 1: (token, count) of tokens that a task saw in 2 sets or
    more; kind 2: the same of word buckets."""

    def describe(batches):
        from tessera.llm.textnum import shingle_sets

        held, size, seen = [], 0, set()
        words = np.zeros(WORD_BUCKETS, np.int64)
        fields = ["kind", "id", "size", "sid", "check", "token", "count"]

        def hot():
            tokens, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            often = counts >= 2
            return counted(1, tokens[often].view(np.int64), counts[often])

        def counted(kind, tokens, counts):
            n = len(tokens)
            none = pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), none, none, none, none, pa.array(tokens), pa.array(counts.astype(np.int64))], names=fields)

        for batch in _batches(batches):
            sizes, sids, checks = [], [], []
            for tokens, _, second in shingle_sets(batch.column("text"), n_words, counts=words, lanes=2):
                sid, check = _name(tokens, second, naming)
                sizes.append(len(tokens))
                sids.append(sid)
                checks.append(check)
                if sid not in seen:
                    seen.add(sid)
                    held.append(tokens)
                    size += len(tokens)
            n = len(sizes)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column("id"), pa.array(sizes, pa.int64()), pa.array(sids, pa.int64()), pa.array(checks, pa.int64()), none, none], names=fields)
            if size > 4 << 20:
                yield hot()
                held, size, seen = [], 0, set()
        yield hot()
        used = np.flatnonzero(words)
        yield counted(2, used, words[used])

    return describe


def light_boundary(sizes: dict[int, int], list_cost: float, num: int = NUM, den: int = DEN) -> int:
    """The largest light size, by cost: an enumerated subset or a listed entry costs 1,
    scanning an entry's list costs ``list_cost`` more."""
    short = {s: prefix(s, num, den) for s in sizes}

    def cost(x: int) -> float:
        total = 0.0
        for s, n in sizes.items():
            if s <= x:
                pair = s - least_overlap(s, num, den) + 2
                total += n * pair * (pair - 1) / 2
                total += n * short[s] * (s >= least_overlap(x + 1, num, den))
            else:
                total += n * short[s] * (1 + list_cost)
        return total

    return min(range(1, LIGHTEST + 1), key=lambda x: (cost(x), x))


#: Roles of list entries: of heavy sets, of light sets in heavy sets' lists, of subsets of light sets.
SCANNED, LISTED_ONLY, SUBSET = 0, 1, 2
#: ``own``: how much of the set is seldom elsewhere, in thousandths; what most others resemble has little.
_LIST_FIELDS = {"key": "BIGINT", "part": "INT", "own": "INT", "sid": "BIGINT", "size": "INT", "rest": "INT", "role": "INT"}
_PIVOT_FIELDS = {"pivot": "BIGINT", "pivot_size": "INT", "pivot_rest": "INT", "pivot_role": "INT"}
_SHARED = 3  # the fields of a list and its order
LISTED = ", ".join(f"{k} {v}" for k, v in (_LIST_FIELDS | _PIVOT_FIELDS).items())


_ARROW = {"BIGINT": pa.int64, "INT": pa.int32}


def _ranked(tokens: np.ndarray, rare: np.ndarray, hot) -> tuple[np.ndarray, np.ndarray]:
    """The order of tokens, those that are frequent last, and their counts in it."""
    count = np.zeros(len(tokens), np.int64)
    if len(hot[0]):
        at = np.minimum(np.searchsorted(hot[0], tokens), len(hot[0]) - 1)
        found = hot[0][at] == tokens
        count[found] = hot[1][at[found]]
    order = np.lexsort((tokens, -rare, count))
    return order, count[order]


def _postings(n_words: int, hot, boundary: int, num: int, den: int, naming):
    def postings(batches):
        from tessera.llm.textnum import mix, shingle_sets

        *often, rarity = hot.value
        fields = list(_LIST_FIELDS)
        seen: set[int] = set()
        for batch in _batches(batches):
            out = [[], [], [], [], [], [], []]
            for tokens, rare, second in shingle_sets(batch.column("text"), n_words, rarity, lanes=2):
                s = len(tokens)
                sid, _ = _name(tokens, second, naming)
                if s == 0 or sid in seen:
                    continue
                if len(seen) < 1 << 20:
                    seen.add(sid)
                order, count = _ranked(tokens, rare, often)
                tokens = tokens[order]
                short = prefix(s, num, den)
                light = s <= boundary
                own = int((count == 0).sum()) * 1000 // s
                if light and s > 1:
                    first = tokens[: s - least_overlap(s, num, den) + 2]
                    i, j = np.triu_indices(len(first), 1)
                    keys = mix(mix(first[i]) + first[j])
                    part = np.zeros(len(keys), np.int64)
                    out[0].append(keys)
                    # copies of a subset are as many as those of its rarer token at most
                    parts = count[i] // LIST_PART
                    out[1].append(np.where(parts > 0, 1 + sid % (parts + 1), part))
                    out[2].append(np.full(len(keys), own))
                    out[3].append(np.full(len(keys), sid, np.int64))
                    out[4].append(np.full(len(keys), s, np.int64))
                    out[5].append(s - j + 1)
                    out[6].append(np.full(len(keys), SUBSET))
                if not light or s >= least_overlap(boundary + 1, num, den):
                    keys = mix(tokens[:short])
                    parts = count[:short] // LIST_PART
                    out[0].append(keys)
                    out[1].append(np.where(parts > 0, 1 + sid % (parts + 1), 0))
                    out[2].append(np.full(short, own))
                    out[3].append(np.full(short, sid, np.int64))
                    out[4].append(np.full(short, s, np.int64))
                    out[5].append(s - np.arange(short))
                    out[6].append(np.full(short, LISTED_ONLY if light else SCANNED))
            if out[0]:
                columns = [np.concatenate(x) for x in out]
                columns[0] = columns[0].view(np.int64)
                types = [_ARROW[t]() for t in _LIST_FIELDS.values()]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, types, strict=True)], names=fields)

    return postings


def _lists(batches):
    """Of rows sorted by key, part, own and sid: those of lists with two sets or more (and of
    all sub-lists), each with its list's first set as pivot. Holds one row from batch to batch."""
    last, first, shown = None, None, False
    for batch in batches:
        columns = [batch.column(f).to_numpy(zero_copy_only=False) for f in _LIST_FIELDS]
        n = batch.num_rows
        if not n:
            continue
        key, part, _, sid = columns[:4]
        new_list = np.ones(n, bool)
        new_list[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
        repeat = np.zeros(n, bool)
        repeat[1:] = ~new_list[1:] & (sid[1:] == sid[:-1])
        if last is not None and (key[0], part[0]) == last[:2]:
            new_list[0] = False
            repeat[0] = sid[0] == last[2]
        begins = np.flatnonzero(new_list)
        group = np.cumsum(new_list) - 1  # -1: goes on from the batch before
        many = np.zeros(len(begins) + 1, bool)
        many[group[~repeat & ~new_list] + 1] = True
        keep = ~repeat & (many[group + 1] | (part > 0))
        head = begins[np.maximum(group[keep], 0)] if len(begins) else np.zeros(int(keep.sum()), np.int64)
        goes_on = group[keep] < 0
        rows = [c[keep] for c in columns]
        rows += [np.where(goes_on, first[k] if first else c[0], c[head]) for k, c in enumerate(columns) if k >= _SHARED]
        if first and not shown and not new_list[0] and many[0]:
            rows = [np.concatenate([[v], r]) for v, r in zip((*first, *first[_SHARED:]), rows, strict=True)]
            shown = True
        last = (key[-1], part[-1], sid[-1])
        if len(begins):
            k = begins[-1]
            first = [c[k] for c in columns]
            shown = bool(keep[k])
        if len(rows[0]):
            types = [_ARROW[t]() for t in (_LIST_FIELDS | _PIVOT_FIELDS).values()]
            yield pa.RecordBatch.from_arrays([pa.array(r.astype(t.to_pandas_dtype()), t) for r, t in zip(rows, types, strict=True)], names=[*_LIST_FIELDS, *_PIVOT_FIELDS])


def _compare(n_words: int, num: int, den: int, naming):
    """Of rows sorted by group, pivot first: the pairs (a, b) that reach the threshold, by both lanes."""

    def compare(batches):
        from tessera.llm.textnum import shingle_sets

        at, pivot = None, None
        for batch in _batches(batches):
            a, part, lead, sid = (batch.column(c).to_pylist() for c in ("a", "salt", "lead", "sid"))
            left, right = [], []
            for k, (tokens, _, second) in enumerate(shingle_sets(batch.column("text"), n_words, lanes=2)):
                if _name(tokens, second, naming)[0] != sid[k]:
                    continue  # another text under the same id
                if lead[k]:
                    at, pivot = (a[k], part[k]), (tokens, second)
                elif at == (a[k], part[k]):
                    _, i, j = np.intersect1d(pivot[0], tokens, assume_unique=True, return_indices=True)
                    shared = int((pivot[1][i] == second[j]).sum())
                    if den * shared >= num * (len(pivot[0]) + len(tokens) - shared):
                        left.append(a[k])
                        right.append(sid[k])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return compare


#: Entries of the lists of differences: a token of D(sid), ``rest`` the tokens from there on,
#: ``differ`` and ``added`` how many tokens D has and how many of them the pivot lacks, ``far``
#: whether the pivot is not linked. Rows with a null key name the pivot in ``component``: one
#: for each set linked to it (not far), one for each that no set linked to it can be linked to (far).
_DIFFERENCE = {"key": "BIGINT", "sid": "BIGINT", "component": "BIGINT", "size": "INT", "rest": "INT", "differ": "INT", "added": "INT", "far": "BOOLEAN"}
_ARROW["BOOLEAN"] = pa.bool_


def least_common(size: int, pivot_size: int, differ: int, far: bool, num: int, den: int) -> int:
    """The smallest overlap of D of a set with that of any other it can be linked to, if
    one of the two is not linked to the pivot."""
    part = (den - num) / (den + num)  # linked sets differ by this share of their sizes' sum at most
    any_size = differ - part * size * (1 + den / num)
    near = (differ + part * (pivot_size - size)) / 2
    beyond = (differ - part * (size + pivot_size) + 1 - part) / 2
    return max(1, math.ceil(max(any_size, beyond if far else near) - 1e-6))


def out_of_reach(size: int, pivot_size: int, differ: int, num: int, den: int) -> bool:
    """Whether no set linked to the pivot can be linked to one that differs by so much from it:
    of the largest partner, with size * den / num, the two differences make differ at most."""
    return differ * (den + num) * num > (den - num) * (pivot_size * num + size * (num + 2 * den))


def _differences(n_words: int, hot, num: int, den: int, naming):
    """Of rows sorted by group, pivot first: the entries of the members' differences from it."""

    def differences(batches):
        from tessera.llm.textnum import mix, shingle_sets

        *often, rarity = hot.value
        at, pivot = None, None
        for batch in _batches(batches):
            a, part, lead, sid, component = (batch.column(c).to_pylist() for c in ("a", "salt", "lead", "sid", "component"))
            out = [[] for _ in _DIFFERENCE]
            named = []

            def entries(keys, *values):
                out[0].append(keys)
                for held, v in zip(out[1:], values, strict=True):
                    held.append(np.broadcast_to(v, len(keys)))

            for k, (tokens, rare, second) in enumerate(shingle_sets(batch.column("text"), n_words, rarity, lanes=2)):
                if _name(tokens, second, naming)[0] != sid[k]:
                    continue  # another text under the same id
                if lead[k]:
                    at, pivot = (a[k], part[k]), (tokens, rare, mix(np.array([a[k]], np.int64).view(np.uint64))[0])
                    continue
                if at != (a[k], part[k]):
                    continue
                others, others_rare, seed = pivot
                new = ~np.isin(tokens, others, assume_unique=True)
                gone = ~np.isin(others, tokens, assume_unique=True)
                added, lost = tokens[new], others[gone]
                differ = len(added) + len(lost)
                far = differ * (den + num) > (den - num) * (len(tokens) + len(others))
                remote = far and out_of_reach(len(tokens), len(others), differ, num, den)
                if not far or remote:
                    named.append((sid[k], a[k], far))
                if remote:
                    continue
                keep = differ - least_common(len(tokens), len(others), differ, far, num, den) + 1
                if keep <= 0:
                    continue
                first, _ = _ranked(added, rare[new], often)
                last, _ = _ranked(lost, others_rare[gone], often)
                keys = np.concatenate([mix(added[first] ^ seed), mix(mix(lost[last] ^ seed))])[:keep]
                entries(keys.view(np.int64), sid[k], component[k], len(tokens), differ - np.arange(len(keys)), differ, len(added), far)
            columns = [np.concatenate(x) if x else np.zeros(0) for x in out]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(_ARROW[t]().to_pandas_dtype())) for c, t in zip(columns, _DIFFERENCE.values(), strict=True)], names=list(_DIFFERENCE))
            if named:
                n = len(named)
                row = dict(zip(("sid", "component", "far"), zip(*named, strict=True), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(row[f], _ARROW[t]()) if f in row else pa.nulls(n, _ARROW[t]()) for f, t in _DIFFERENCE.items()], names=list(_DIFFERENCE))

    return differences


class _Join:
    def __init__(self, docs: DataFrame, n_words: int, num: int, den: int):
        self.spark, self.n_words, self.num, self.den = docs.sparkSession, n_words, num, den
        ship(self.spark)
        self.docs = docs
        described = stored(docs.mapInArrow(_describe(n_words, (NAME_BITS, frozenset())), "kind INT, id BIGINT, size BIGINT, sid BIGINT, check BIGINT, token BIGINT, count BIGINT"), "described")
        self.tokens = stored(described.filter("kind = 1").groupBy("token").agg(F.sum("count").alias("n")), "shared-tokens")
        self.words = described.filter("kind = 2").groupBy("token").agg(F.sum("count").alias("n"))
        info = described.filter("kind = 0").select("id", "size", "sid", "check")
        # of n sets some n * n / 2 ** 65 have a name that another has
        clashing = [r["sid"] for r in self._classes(info).filter("low <> high").select("sid").collect()]
        self.naming = (NAME_BITS, frozenset(clashing))
        if clashing:
            info = info.withColumn("sid", F.when(F.col("sid").isin(clashing), F.col("check")).otherwise(F.col("sid")))
        self.info = info
        # one row per distinct set
        self.classes = stored(self._classes(info), "classes")
        if clashing and not self.classes.filter("low <> high").isEmpty():
            raise ValueError("two different sets have one digest")

    def _classes(self, info: DataFrame) -> DataFrame:
        named = info.filter("size > 0 AND id IS NOT NULL").groupBy("sid")
        return named.agg(F.min("id").alias("id"), F.min("size").cast("int").alias("size"), F.min("check").alias("low"), F.max("check").alias("high"))

    def candidates(self, met: DataFrame, a: str, b: str, once: bool = False) -> DataFrame:
        """Of meetings in lists, one row each, of sets ``a`` and ``b`` (prefixes of their columns): the
        pairs (a, b, a smaller) that meet as often as they must. ``rest`` counts an entry's token
        and those after it (for subsets their tokens and those after them): what of it lies behind
        the pair's own prefix does not count. Linked sets share at least num / (num + den) of
        their sizes' sum. ``once`` asks for one meeting alone."""
        col = lambda side, name: F.col(f"{side}{name}").cast("long")
        sizes = col(a, "size") + col(b, "size")
        share = F.ceil(sizes * self.num / (self.num + self.den) - 1e-9).cast("long")
        small = F.ceil(F.least(col(a, "size"), col(b, "size")) * self.num / self.den - 1e-9).cast("long")
        times = F.lit(1).cast("long") if once else F.when(F.col(f"{a}role") == SUBSET, F.lit(1).cast("long")).otherwise(1 + F.floor(small / 32))
        inside = F.least(col(a, "rest"), col(b, "rest")) > share - times
        both = (F.col(f"{a}role") != LISTED_ONLY) | (F.col(f"{b}role") != LISTED_ONLY)
        x, y = F.col(f"{a}sid"), F.col(f"{b}sid")
        pairs = met.filter(both & inside).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), times.alias("times"))
        return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("times").alias("times")).filter("n >= times").select("a", "b")

    def listed(self) -> DataFrame:
        hot = most_frequent(self.tokens, HOT_TOKENS).select("token", "n").toArrow()
        token = hot.column("token").to_numpy().view(np.uint64)
        order = np.argsort(token)
        count = hot.column("n").to_numpy()
        seen = np.zeros(WORD_BUCKETS)
        for r in self.words.collect():  # at most one row per bucket
            seen[r["token"]] = r["n"]
        rarity = np.round(4 * np.log2((seen.sum() + 1) / (seen + 1))).astype(np.int32)
        self.hot = self.spark.sparkContext.broadcast((token[order], count[order], rarity))
        sizes = {r[0]: r[1] for r in self.classes.groupBy(F.least("size", F.lit(4 * LIGHTEST)).alias("s")).count().collect()}
        entries = sum(n * s for s, n in sizes.items())
        self.boundary = light_boundary(sizes, float((count.astype(np.float64) ** 2).sum() / max(entries, 1)), self.num, self.den)
        posted = self.docs.filter("id IS NOT NULL").mapInArrow(_postings(self.n_words, self.hot, self.boundary, self.num, self.den, self.naming), ", ".join(f"{k} {v}" for k, v in _LIST_FIELDS.items()))
        n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 1)
        dealt = posted.repartition(n, "key", "part").sortWithinPartitions("key", "part", "own", "sid")
        return stored(dealt.mapInArrow(_lists, LISTED), "listed")

    def sent(self, table: DataFrame) -> DataFrame:
        """A written table as a join's side: to all executors if it has few rows."""
        return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table.hint("merge")

    def dealt(self, pairs: DataFrame) -> DataFrame:
        """The texts of ``pairs`` (a, b, component of b): in groups of some PIVOT_PART of a's partners, a first."""
        per = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(PIVOT_PART)).cast("int").alias("parts"))
        hubs = stored(per.filter("parts > 1"), "hubs")
        parts = F.coalesce("parts", F.lit(1))
        salted = pairs.join(self.sent(hubs), "a", "left").select("a", "b", "component", F.pmod(F.xxhash64("b"), parts).cast("int").alias("salt"))
        leads = salted.select("a", "salt").distinct().select("a", "salt", F.lit(True).alias("lead"), F.col("a").alias("sid"), F.lit(None).cast("long").alias("component"))
        roles = stored(leads.union(salted.select("a", "salt", F.lit(False), "b", "component")), "roles")
        named = stored(roles.join(self.classes.select("sid", "id").hint("merge"), "sid"), "roles-named")
        texts = self.docs.join(self.sent(named), "id").select("a", "salt", "lead", "sid", "component", "text")
        n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 1)
        return texts.repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.desc("lead"))

    def compared(self, pairs: DataFrame) -> DataFrame:
        """The links among ``pairs`` (a, b) of class names; a should be the pivot."""
        pairs = stored(pairs.select("a", "b").distinct().withColumn("component", F.lit(None).cast("long")), "pairs")
        return stored(self.dealt(pairs).mapInArrow(_compare(self.n_words, self.num, self.den, self.naming), "a BIGINT, b BIGINT"), "links")

    def linked_apart(self, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of members of different components of the same of ``lists`` (key, main, own, sid, component and
        more): the links, found by the differences from a pivot of the list's largest component, but for
        those with a set too far from it; and what of the lists (``remote``: too far) may hold these."""
        pivot = lists.filter("component = main").groupBy("key").agg(F.min(F.struct("own", "sid")).alias("p")).select("key", F.col("p.sid").alias("a"))
        lists = stored(lists.join(self.sent(stored(pivot, "long-pivots")), "key").filter("sid <> a"), "with-pivots")
        pairs = stored(lists.select("a", F.col("sid").alias("b"), "component").distinct(), "families")
        schema = ", ".join(f"{k} {v}" for k, v in _DIFFERENCE.items())
        entries = stored(self.dealt(pairs).mapInArrow(_differences(self.n_words, self.hot, self.num, self.den, self.naming), schema), "differences")
        told = entries.filter("key IS NULL").select(F.col("component").alias("a"), "sid", F.col("far").alias("remote")).distinct()
        found = told.filter("NOT remote").select("a", F.col("sid").alias("b"))
        apart = lists.join(told.hint("merge"), ["a", "sid"], "left").filter("remote IS NULL OR remote").withColumn("remote", F.col("remote").isNotNull())
        col = lambda side, name: F.col(f"{side}{name}").cast("long")
        sizes, differ = col("x_", "size") + col("", "size"), col("x_", "differ") + col("", "differ")
        # twice the overlap that linked sets' differences have, times num + den
        least = differ * (self.den + self.num) - sizes * (self.den - self.num)
        reach = lambda n: n * (2 * (self.den + self.num)) >= least
        lost = lambda side: col(side, "differ") - col(side, "added")
        fits = F.least(col("x_", "size"), col("", "size")) * self.den >= F.greatest(col("x_", "size"), col("", "size")) * self.num
        within = reach(F.least(col("x_", "rest"), col("", "rest"))) & reach(F.least(col("x_", "added"), col("", "added")) + F.least(lost("x_"), lost("")))
        met = [x.join(y.hint("merge"), "key").filter(meets & (F.col("x_component") != F.col("component")) & fits & within).select(F.col("x_sid").alias("a"), F.col("sid").alias("b")) for x, y, meets in self.sides(entries)]
        return found.union(self.compared(met[0].union(met[1]))), apart

    def sides(self, entries: DataFrame) -> list[tuple[DataFrame, DataFrame, Column]]:
        """The entries of differences that have to meet by key, x (columns x_) with y, and which of them.

        With e = differ - part * size (part as in ``least_common``), linked sets share (e of x + e of y) / 2
        tokens of their differences or more. A set far from the pivot has an e above part times the
        pivot's size, a near one has not. At their first common token both have at least the shared
        tokens left (``rest``): so of two far sets the one of the smaller e has that e left, and the
        other the half of its own e and of the least e of a far set. What all of a list lack alike is
        ranked behind what each has of its own, and is cut off by this where their own parts are large
        enough to keep them apart."""
        num, den = self.num, self.den
        e = F.col("differ").cast("long") * (den + num) - F.col("size").cast("long") * (den - num)
        pivot = (F.col("size") + F.col("differ") - 2 * F.col("added")).cast("long") * (den - num)
        left = F.col("rest").cast("long") * (den + num)
        keyed = entries.filter("key IS NOT NULL").withColumn("e", e)
        named = lambda df: df.select("key", *(F.col(c).alias(f"x_{c}") for c in df.columns if c != "key"))
        low, high = keyed.filter(F.col("far") & (left >= F.col("e"))), keyed.filter(F.col("far") & (2 * left >= F.col("e") + pivot))
        ordered = F.struct("x_e", "x_sid") < F.struct("e", "sid")
        return [(named(low), high, ordered), (named(keyed.filter("NOT far")), keyed.filter("far"), F.lit(True))]

    def run(self) -> DataFrame:
        """(sid, component) for the classes that have links."""
        listed = self.listed()
        with_pivot = listed.withColumnRenamed("pivot", "pivot_sid")
        pairs = self.candidates(with_pivot.filter("sid <> pivot_sid"), "pivot_", "", once=True)
        # sub-lists of a hot list meet through their pivots
        parts = listed.filter("part > 0").select("key", "pivot").distinct()
        least = parts.groupBy("key").agg(F.min("pivot").alias("low"))
        across = parts.join(least.hint("merge"), "key").filter("pivot <> low").select(F.col("low").alias("a"), F.col("pivot").alias("b"))
        pairs = pairs.union(across.distinct())
        links = self.compared(pairs)
        entry = ("component", "sid", "size", "rest", "role")
        labels = components(links)
        named = listed.select("key", "own", "sid", "size", "rest", "role").join(labels.withColumnRenamed("node", "sid").hint("merge"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
        per = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
        per = per.groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
        mixed = stored(per.select("key", F.col("most.component").alias("main"), (F.col("all") - F.col("most.n")).alias("strangers")), "mixed")
        one = stored(named.join(mixed.hint("merge"), "key").select("key", "main", "strangers", "own", *entry), "mixed-lists")

        def met(left: DataFrame, right: DataFrame, apart: str) -> DataFrame:
            left = left.select("key", *(F.col(c).alias(f"l_{c}") for c in entry))
            joined = left.join(right.hint("merge"), "key").filter(f"l_component <> component AND ({apart})")
            return joined.select(*(f"{side}{c}" for side in ("l_", "") for c in entry))

        # pairs meet in full in all their lists, or are found or ruled out in one by differences
        found, apart = self.linked_apart(one.filter(F.col("strangers") > FEW_STRANGERS))
        short = one.filter(F.col("strangers") <= FEW_STRANGERS)
        in_full = met(short.filter("component <> main"), short, "component = main OR l_sid < sid")
        in_full = in_full.union(met(apart.filter("remote"), apart, "NOT remote OR l_sid < sid"))
        return components(stored(links.union(found).union(self.compared(self.candidates(in_full, "l_", ""))), "links"))


def jaccard_components(docs: DataFrame, n_words: int = WORDS, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id.

    Words are runs of characters other than space, tab, LF, VT, FF and CR, A-Z as a-z.
    A set holds the distinct ``n_words``-word shingles; with fewer words the whole
    sequence is one. Texts without words (null too) have an empty set, which is linked
    with nothing; their component is their own id. Two rows link when
    den * intersection >= num * union. ``component_id`` is the smallest id reachable.
    A row without id links with nothing and has a null component. Rows that repeat an
    id are rows of their own; with different texts, such an id names each of its
    texts' components. An empty table gives no rows.
    """
    named = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    join = _Join(named, n_words, num, den)
    labels = join.run()
    classes = stored(join.classes.select("sid", "id").join(labels.withColumnRenamed("node", "sid").hint("merge"), "sid", "left").select("sid", "id", F.coalesce("component", "sid").alias("component")), "classed")
    low = stored(classes.groupBy("component").agg(F.min("id").alias("component_id")), "component-ids")
    found = stored(classes.join(low.hint("merge"), "component").select("sid", "component_id"), "class-components")
    return join.info.join(found.hint("merge"), "sid", "left").select(
        F.col("id").alias(id_col),
        F.col("size").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id"))).alias("component_id"),
    )


def op3_size_aware_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
