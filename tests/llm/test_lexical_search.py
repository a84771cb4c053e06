import math
import random
import re
from collections import Counter

import numpy as np

from tessera.llm import lexical_search
from tessera.llm.lexical_search import Best, Lexicon, Shard, ranked_search, terms_of

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def serial_terms(text):
    return Counter(TERM.findall((text or "").translate(LOWER)))


def serial(docs, items, k=20):
    counted = [(d, c) for d, c in ((d, serial_terms(t)) for d, t in docs) if c]
    n_docs, length, df = len(counted), sum(sum(c.values()) for _, c in counted), Counter(t for _, c in counted for t in c)
    texts = {}
    for item, text in items:
        if text is not None and (texts.get(item) is None or text.encode() < texts[item].encode()):
            texts[item] = text
    out = []
    for item, text in texts.items():
        found, asked = [], serial_terms(text)
        for doc, c in counted:
            m = 75 + (25 * sum(c.values()) * n_docs) // length
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in asked.items() if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank + 1, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def words(rng, n, more=()):
    return "".join(rng.choice(["alpha", "Beta", "ÄÖü", "你好", "x1", "a", *more, f"w{rng.randrange(60)}"]) + rng.choice([" ", ", ", "-", "\n", "\x00", "\x7f", "|"]) for _ in range(n))


def answers(spark, docs, items, k=20):
    d = spark.createDataFrame([(*x, 1, "s") for x in docs], "doc_id BIGINT, text STRING, n BIGINT, terms STRING")
    i = spark.createDataFrame([(*x, 2) for x in items], "item_id BIGINT, text STRING, doc_id INT")
    return sorted((tuple(r) for r in ranked_search(d, i, k).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_equals_serial_search(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 7)
    rng = random.Random(3)
    docs = [(k, words(rng, rng.choice([0, 1, 5, 80, 300]), ["rare" + str(k % 40)])) for k in range(300)]
    docs += [(300, None), (301, ""), (302, "., \t"), (None, words(rng, 50)), (5, docs[5][1]), (5, docs[5][1]), (303, "x" * 3_000), (304, "alpha beta " * 400_000), (305, "é" * 2_000_000 + " alpha")]
    docs += [(400 + k, "same words in many documents alpha") for k in range(40)]
    items = [(k, words(rng, rng.choice([1, 8, 40]))) for k in range(20)]
    items += [(20, None), (21, ""), (22, "words nowhere-to be found"), (23, "same same documents"), (24, "x" * 3_000), (None, "alpha"), (25, "b"), (25, "alpha w1"), (26, "é" * 2_000_000)]
    assert answers(spark, docs, items) == serial(docs, items)
    assert answers(spark, docs, items, 3) == serial(docs, items, 3)


def test_without_rows(spark):
    assert answers(spark, [], [(1, "a")]) == [] and answers(spark, [(1, "a")], []) == [] and answers(spark, [(1, "."), (2, None)], [(1, "a")]) == []


def test_terms_across_segments(monkeypatch):
    monkeypatch.setattr(lexical_search, "SEGMENT", 7)
    text = "Ab abcdefghijk ab-cd,ÄbÄ 12345678901 z"
    assert {t.decode(): n for t, n in terms_of(text).items()} == serial_terms(text)


def test_clashing_hashes_are_told_apart():
    lexicon = Lexicon([b"alpha", b"beta"])
    low = np.frombuffer(b"alphq beta" + bytes(8), dtype=np.uint8)
    lexicon.hashed = lexicon.hashed.copy()
    real = lexical_search._hash_words(low, np.array([0]), np.array([5]), lexicon.lane)
    lexicon.hashed[list(lexicon.order).index(0)] = real[0]
    lexicon.seen[:] = True
    order = np.argsort(lexicon.hashed)
    lexicon.hashed, lexicon.order = lexicon.hashed[order], lexicon.order[order]
    at, term = lexicon.find(low, np.array([0, 6]), np.array([5, 10]))
    assert at.tolist() == [1] and term.tolist() == [1]


def test_bounds_spare_documents(monkeypatch):
    """The shard's answer is the full scan's, and most documents of frequent terms are never scored."""
    monkeypatch.setattr(lexical_search, "FIRST_RANGE", 64)
    rng = np.random.default_rng(1)
    n, chance = 20_000, np.array([0.9, 0.8, 0.5, 0.01, 0.005, 0.002])
    there = rng.random((n, len(chance))) < chance
    place, term = np.nonzero(there)
    tf = rng.integers(1, 6, len(place))
    weight, m = (1000 * np.log(2 / (2 * chance))).astype(np.int64) + 10, rng.integers(80, 400, n)
    shard = Shard(np.arange(n)[::-1].copy(), np.zeros(n, bool), m, place, term, tf, weight)
    full = np.zeros(n, np.int64)
    np.add.at(full, place, np.array([1, 1, 2, 1, 1, 1])[term] * weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[place])))
    best = Best(20)
    scored = shard.search(np.arange(6), np.array([1, 1, 2, 1, 1, 1]), best)
    want = sorted(zip((-full).tolist(), shard.doc.tolist(), strict=True))[:20]
    assert list(zip((-best.score).tolist(), best.doc.tolist(), strict=True)) == want
    assert scored < n / 5
