import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessera.llm import decontamination as D
from tessera.llm import ngram_join as N
from tessera.llm import textnum
from tessera.llm.components import components


def shingles(text, n=5):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    if not words:
        return set()
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} or {tuple(words)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(a):
        while group[a] != a:
            a = group[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and None not in (rows[a][0], rows[b][0]) and 100 * shared >= 75 * len(sets[a] | sets[b]):
                group[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((str(i), len(sets[k]), None if i is None else least[find(k)]) for k, (i, _) in enumerate(rows))


def corpus(seed, n=120):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") + rnd.choice("klmnopqrst") + rnd.choice("uvwxyz")
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(n):
        kind = rnd.random()
        if texts and kind < 0.6:
            words = rnd.choice(texts[-25:]).split(" ")
            for _ in range(rnd.choice([0, 1, 1, 2, 5])):
                words[rnd.randrange(len(words))] = word()
            texts.append(" ".join(words + [word()] * rnd.choice([0, 0, 1])))
        else:
            words = [word() for _ in range(rnd.choice([1, 4, 5, 6, 8, 12, 30, 90]))]
            texts.append(" ".join((passage if rnd.random() < 0.4 else []) + words))
    return texts


@pytest.mark.parametrize(("seed", "part", "lightest", "few", "bits"), [(1, 2000, 64, 4, 64), (2, 3, 64, 0, 64), (3, 3, 1, 0, 5), (4, 2000, 8, 0, 64), (5, 2000, 1, 1000, 64)])
def test_components_equal_brute_force(spark, monkeypatch, seed, part, lightest, few, bits):
    monkeypatch.setattr(N, "NAME_BITS", bits)
    monkeypatch.setattr(N, "FEW_STRANGERS", few)
    monkeypatch.setattr(N, "LIST_PART", part)
    monkeypatch.setattr(N, "PIVOT_PART", 3)
    monkeypatch.setattr(N, "LIGHTEST", lightest)
    rows = list(enumerate(corpus(seed), 10))
    got = N.jaccard_components(spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3))
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got.collect()) == brute(rows)


@pytest.mark.parametrize("seed", range(6))
def test_overlaps_of_differences_are_bounded(seed):
    rnd = random.Random(seed)
    base = set(range(rnd.choice([12, 40])))
    sets = [base]
    for _ in range(150):
        s = set(rnd.choice(sets))
        for _ in range(rnd.choice([1, 3, 8])):
            s -= {rnd.choice(sorted(s))} if len(s) > 4 else set()
            s |= {rnd.randrange(200)} if rnd.random() < 0.6 else set()
        sets.append(s)
    linked = lambda x, y: 100 * len(x & y) >= 75 * len(x | y)
    met = 0
    for x in sets:
        for y in sets:
            if linked(x, y) and x != base != y and not (linked(x, base) and linked(y, base)):
                shared = len((x ^ base) & (y ^ base))
                for z in (x, y):
                    assert shared >= N.least_common(len(z), len(base), len(z ^ base), not linked(z, base), 75, 100)
                met += 1
    assert met > 50


def test_links_that_no_pivot_shows(spark, monkeypatch):
    """Sets around one centre, many of them linked to particular others alone."""
    monkeypatch.setattr(N, "FEW_STRANGERS", 0)
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    centre = [word() for _ in range(80)]
    edits = [(k, word()) for k in range(0, 80, 5)]
    rows = []
    for k in range(140):
        words = list(centre)
        for at, w in rnd.sample(edits, rnd.choice([1, 2, 3, 4, 5, 6])):
            words[at] = w
        rows.append((k, " ".join(words)))
    got = N.jaccard_components(spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3))
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got.collect()) == brute(rows)


def test_words_of_thue_and_morse_are_told_apart(spark):
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a[:1024]), (2, b[:1024]), (3, a[:32] + " x y z w"), (4, b[:32] + " x y z w"), (5, a[:2048]), (6, b[:2048]), (7, a[:2048])]
    got = N.jaccard_components(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 5)]


def test_odd_rows(docs, nothing):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in N.jaccard_components(docs).collect()) == brute(rows)
    assert N.jaccard_components(nothing).count() == 0


def test_lists_go_on_over_batches():
    import pyarrow as pa

    rows = sorted((k % 7, 0, (k * 37) % 11 % 3, (k * 37) % 11, 9, 9, 0) for k in range(60))
    names = list(N._LIST_FIELDS)
    types = [N._ARROW[t]() for t in N._LIST_FIELDS.values()]
    whole = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)
    out = lambda batches: sorted({(r["key"], r["sid"], r["pivot"]) for b in N._lists(iter(batches)) for r in b.to_pylist()})
    want = sorted({(r[0], r[3], min(x[2:4] for x in rows if x[0] == r[0])[1]) for r in rows})
    for step in (1, 2, 5, 60):
        assert out([whole.slice(a, step) for a in range(0, 60, step)]) == want


def test_the_boundary_is_where_the_cost_is_least():
    sizes = {5: 100, 20: 100, 40: 100}
    assert N.light_boundary(sizes, 0.0) < 20 <= N.light_boundary(sizes, 50.0)


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a BIGINT, b BIGINT")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in range(100, 130)) and got[200] == 200


def test_word_hashes_do_not_depend_on_their_place():
    texts = ["Ab cd", "", "cd\x0bAB", "é" * 3 + " ab"]
    data = "".join(texts).encode()
    starts = np.cumsum([0, *(len(t.encode()) for t in texts)])
    hashed, begin, end, first = textnum.words(data, starts)
    assert first.tolist() == [0, 2, 2, 4, 6]
    assert hashed[0] == hashed[3] == hashed[5] and hashed[1] == hashed[2] and len(set(hashed.tolist())) == 3
    assert [data[a:b] for a, b in zip(begin, end, strict=True)][:2] == [b"Ab", b"cd"]


def test_word_hashes_in_segments(monkeypatch):
    texts = [" ".join(corpus(5)), "z" * 9000, " ".join(corpus(6))]
    data = "".join(texts).encode()
    starts = np.cumsum([0, *(len(t.encode()) for t in texts)])
    whole = textnum.words(data, starts)
    monkeypatch.setattr(textnum, "SEGMENT", 100)
    assert all((a == b).all() for a, b in zip(whole, textnum.words(data, starts), strict=True))


def tokens(text):
    return [w for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split(" ") if w]


def test_leaks_equal_brute_force(spark, nothing):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(rnd.randrange(4, 40)))) for k in range(12)] + [(90, None), (91, "few words")]
    docs = []
    for k in range(150):
        words = [word() for _ in range(rnd.randrange(0, 80))]
        if k % 3 == 0:
            item = rnd.choice(items)[1] or ""
            leak = item.upper().split(" ")
            for _ in range(rnd.choice([0, 0, 0, 1])):
                leak[rnd.randrange(len(leak))] = word()
            at = rnd.randrange(len(words) + 1)
            words[at:at] = leak
        docs.append((k, "; ".join(words)))
    docs += [(500, None), (None, items[5][1]), (501, items[6][1]), (501, items[6][1])]
    want = {}
    for k, item in items:
        ws = tokens(item)
        grams = [tuple(ws[j : j + 5]) for j in range(len(ws) - 4)]
        for i, text in docs:
            dw = tokens(text)
            have = [tuple(dw[j : j + 5]) for j in range(len(dw) - 4)]
            for s in range(len(have)) if grams else ():
                window = have[s : s + len(grams)]
                shared = sum((Counter(window) & Counter(grams)).values())
                score = shared / (len(window) + len(grams) - shared)
                if score >= 0.75:
                    want[i, k] = max(score, want.get((i, k), 0))
    table = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    bench = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    got = {(r.doc_id, r.item_id): r.similarity for r in D.contamination(table, bench).collect()}
    assert set(got) <= set(want) and {k for k, v in want.items() if v == 1} <= set(got)
    assert len(got) >= 0.9 * len(want) and len(want) > 20
    assert D.contamination(nothing, bench).count() == 0
    assert D.contamination(table, bench.limit(0)).count() == 0


def test_blocks_find_every_fingerprint_within_the_radius(spark):
    rnd = random.Random(9)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    items = [rnd.getrandbits(64) for _ in range(20)]
    prints = []
    for x in items:
        for bits in (0, 3, 10, 15, 16, 25):
            y = x
            for b in rnd.sample(range(64), bits):
                y ^= 1 << b
            prints.append(y)
    got = D.hamming_pairs(spark.createDataFrame([(signed(x),) for x in set(prints)], "print BIGINT"), spark.createDataFrame([(signed(x),) for x in items], "item_print BIGINT"))
    want = {(signed(a), signed(b)) for a in prints for b in items if (a ^ b).bit_count() <= D.RADIUS}
    assert {(r.print, r.item_print) for r in got.collect()} == want


def best_windows(docs, items, least=0.75):
    """By brute force over all starts: the best similarity of each (document, item) at ``least`` or more."""
    grams_of = lambda text: [tuple(ws[j : j + 5]) for ws in [tokens(text)] for j in range(len(ws) - 4)]
    want = {}
    for k, item in items:
        grams = grams_of(item)
        counts = Counter(grams)
        for i, text in docs:
            have = grams_of(text)
            for s in range(len(have)) if grams else ():
                window = have[s : s + len(grams)]
                shared = sum((Counter(window) & counts).values())
                score = shared / (len(window) + len(grams) - shared)
                if score >= least:
                    want[i, k] = max(score, want.get((i, k), 0))
    return want


def test_moved_blocks_equal_brute_force(spark):
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(rnd.randrange(35, 80)))) for k in range(20)]
    docs = []
    for k, item in items:
        ws = item.split(" ")
        for j, part in enumerate((0.2, 0.3, 0.5)):
            cut = int(len(ws) * part)
            before, after = ([word() for _ in range(rnd.randrange(60))] for _ in range(2))
            docs.append((10 * k + j, " ".join([*before, *ws[cut:], *ws[:cut], *after])))
        docs.append((10 * k + 5, " ".join([*ws, *ws, word(), *ws[:-2]])))
        docs.append((10 * k + 6, " ".join([word(), *ws[: int(len(ws) * 0.9)]])))
    items.append((90, "la " * 30 + "di da dum"))
    docs.append((999, "so " + "la " * 45 + "di da"))
    want = best_windows(docs, items)
    assert len(want) > 90 and sum(i % 10 < 3 for i, _ in want) > 50
    table = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    bench = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    got = {(r.doc_id, r.item_id): r.similarity for r in D.contamination(table, bench, radius=31).collect()}
    assert got == pytest.approx(want)


def test_edited_leaks_equal_brute_force(spark):
    rnd = random.Random(33)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(rnd.randrange(9, 70)))) for k in range(60)]
    docs = []
    for k, item in items:
        for j in range(20):
            ws = item.split(" ")
            for _ in range(rnd.choice([1, 1, 1, 2])):
                at = rnd.randrange(len(ws))
                ws[at : at + rnd.randrange(2)] = [word()] * rnd.randrange(2)
            before, after = ([word() for _ in range(rnd.randrange(12))] for _ in range(2))
            docs.append((100 * k + j, " ".join([*before, *ws, *after])))
    want = best_windows(docs, items)
    assert sum(v < 0.8 for v in want.values()) > 100
    table = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    bench = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    got = {(r.doc_id, r.item_id): r.similarity for r in D.contamination(table, bench).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("share", [0.8, 0.84])
def test_boilerplate_meets_in_proportion(spark, monkeypatch, share):
    """Texts that share a passage and are not linked: what meets by key grows as the texts do."""
    from tessera.llm import ngram_join

    met = []
    real = ngram_join._Join.sides

    def counted(self, entries):
        found = real(self, entries)
        met.append(sum(x.join(y, "key").count() for x, y, _ in found))
        return found

    monkeypatch.setattr(ngram_join._Join, "sides", counted)
    common, own = int(200 * share), 200 - int(200 * share)
    for n in (200, 400):
        rows = [(k, " ".join([f"p{j}" for j in range(common)] + [f"o{k}_{j}" for j in range(own)])) for k in range(n)]
        got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))
        assert got.select("component_id").distinct().count() == n
    assert met[0] > 0 and met[1] < 2.2 * met[0]


def test_blocks_rule_out_most_unrelated_pairs(spark):
    rnd = random.Random(41)
    text = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(rnd.choice([24, 45])))
    table = spark.createDataFrame([(k, text()) for k in range(330)], "k BIGINT, text STRING")
    prints = table.select("k", D.simhash(D.shingle_hashes(D.word_list(F.col("text")))).alias("print")).cache()
    windows, items = prints.filter("k < 300").select("print").distinct(), prints.filter("k >= 300").selectExpr("print AS item_print").distinct()
    pairs = windows.count() * items.count()
    assert D.block_candidates(windows, items).count() < 0.4 * pairs
    assert D.hamming_pairs(windows, items).count() < 0.03 * pairs


def test_long_texts_and_clashing_columns(spark):
    rnd = random.Random(43)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    item = [word() for _ in range(50)]
    long = [word() for _ in range(150_000)]
    long[140_000:140_000] = [*item[25:], *item[:25]]
    docs = [(1, " ".join(long), "x", 1), (2, " ".join(item) + " end", "y", 2), (2, None, None, None), (3, " ".join(long[:5000]), "z", 3)]
    table = spark.createDataFrame(docs, "doc_id BIGINT, text STRING, key STRING, id BIGINT")
    bench = spark.createDataFrame([(7, " ".join(item), 1), (8, " ".join(item), 2), (9, "", 3)], "item_id BIGINT, text STRING, n INT")
    got = {(r.doc_id, r.item_id): r.similarity for r in D.contamination(table, bench).collect()}
    assert set(got) == {(1, 7), (1, 8), (2, 7), (2, 8)} and got[2, 7] == 1.0 and got[1, 7] >= 0.75


def test_moved_blocks_are_found_at_the_default_radius(spark):
    rnd = random.Random(47)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(rnd.randrange(35, 80)))) for k in range(30)]
    docs = []
    for k, item in items:
        ws = item.split(" ")
        for j, part in enumerate((0.2, 0.3, 0.5)):
            cut = int(len(ws) * part)
            docs.append((10 * k + j, " ".join([word(), *ws[cut:], *ws[:cut], word(), word()])))
    want = best_windows(docs, items)
    assert len(want) > 60
    table = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    bench = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    got = {(r.doc_id, r.item_id) for r in D.contamination(table, bench).collect()}
    assert got <= set(want) and len(got) >= 0.9 * len(want)
