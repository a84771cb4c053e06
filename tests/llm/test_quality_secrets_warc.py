import base64
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality, secrets, textnum, warc
from tessera.llm.common import fresh_path

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KINDS = ("assign", "access", "hex", "random")


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def test_base_spans_equal_brute_force(spark, docs, nothing):
    rnd = random.Random(4)
    parts = ["token=", "Secret : ", "api_key='", "apikey\"=", "passwd:", "AKIA", "AKIAAKIA", "é🙂", " ", "\n", "0123456789abcdef", "ABCDEFGH12345678", "token=token:abcdefghijklmnop", "deadbeef", ".", "k"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(20))) for _ in range(300)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + list(enumerate(texts, 1000)) + [(9, "f" * 70_000 + " token")]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()
    assert len(got) == len(rows)
    want = {}
    for key, text in rows:
        spans = base_spans(text or "")
        sha = hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
        want.setdefault(key, []).append((*(sum(s[1] == k for s in spans) for k in range(3)), sha))
    for r in got:
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) in want[r.doc_id]
    assert secrets.scan(nothing).count() == 0


ALPHABETS = {"hex": "0123456789ABCDEF", "base32": secrets.ALPHABETS["base32"], "base64": secrets.ALPHABETS["base64"]}


def drawn(rnd, encoding, n):
    while True:
        s = "".join(rnd.choice(ALPHABETS[encoding]) for _ in range(n))
        if re.search("[0-9]", s) and re.search("[A-Za-z]", s):
            return s


def test_random_strings_are_found_and_structured_ones_are_not(spark):
    rnd = random.Random(8)
    kinds = [("base32", 26), ("base32", 32), ("hex", 32), ("hex", 40), ("base64", 20), ("base64", 24), ("base64", 44), ("base64", 88)]
    rows = [(100 * j + k, f"key {drawn(rnd, *kind)} end") for j, kind in enumerate(kinds) for k in range(100)]
    words = "the river walks under stone light green hill report data config user session version service account index page handler build".split()
    forms = [lambda w, d: "/".join(w) + f"/v{d}", lambda w, d: "-".join(w) + f"-{d}", lambda w, d: "".join(x.title() for x in w) + str(d), lambda w, d: "_".join(w).upper() + f"_{d}", lambda w, d: f"2024-01-{d % 28 + 1:02d}T10-{d % 60:02d}-05Z_" + w[0]]
    rows += [(10_000 + k, "see " + rnd.choice(forms)(rnd.choices(words, k=rnd.randrange(3, 7)), rnd.randrange(1, 3000)) + " here") for k in range(600)]
    rows += [(20_000, "x" + "abc1" * 20), (20_001, "A1" + "b" * 60), (20_002, "1" * 30 + "a")]
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()}
    for j, kind in enumerate(kinds):
        assert sum(got[100 * j + k].n_random for k in range(100)) >= (85 if kind[1] <= 32 else 92), kind
    assert sum(r.n_random for k, r in got.items() if k >= 10_000) <= 0.02 * len(kinds) * 100
    assert got[600].spans == "random:4:48"


def statistics(token):
    """The battery's verdict and score, one character after the other."""
    encoding = "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", token) else "base32" if re.fullmatch("[A-Z2-7]+=*", token) else "base64"
    body = re.sub("=+$", "", token)
    body = body.lower() if encoding == "hex" else body.translate(str.maketrans("-_", "+/", "="))
    alphabet = secrets.ALPHABETS[encoding]
    codes, n, k = [alphabet.index(c) for c in body], len(body), len(alphabet)
    chi = lambda xs, m: sum((xs.count(v) - n / m) ** 2 / (n / m) for v in range(m))
    normal = lambda x, f: ((x / f) ** (1 / 3) - (1 - 2 / (9 * f))) / math.sqrt(2 / (9 * f))
    m = min(k, 2 ** int(math.log2(n / 5)))
    high = [c >= k / 2 for c in codes]
    a, b = sum(high), n - sum(high)
    runs = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
    mu, var = 2 * a * b / n + 1, 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
    mean = sum(codes) / n
    spread = sum((c - mean) ** 2 for c in codes)
    r = sum((x - mean) * (y - mean) for x, y in zip(codes, codes[1:], strict=False)) / spread if spread else 1.0
    passed = normal(chi(codes, k), k - 1) <= 3.29 and normal(chi([c * m // k for c in codes], m), m - 1) <= 3.29 and var > 0 and abs(runs - mu) <= 3.29 * math.sqrt(var) and abs(r) * math.sqrt(n) <= 3.29
    kind = lambda c: (c.isdigit(), c.isupper() if encoding != "hex" else False, c in "+/")
    changes = sum(kind(x) != kind(y) for x, y in zip(body, body[1:], strict=False))
    rate = {"hex": 0.2, "base32": 0.2, "base64": 0.3}[encoding]
    if encoding == "hex":
        excess = n * (k * 0.12 - 1)
        even = (k - 1 + excess - chi(codes, k)) / math.sqrt(2 * (k - 1) + 4 * excess)
    else:
        logs = {c: math.log(len(g) / 26 / p) for g, p in secrets.LETTER_GROUPS for c in g}
        mu1 = sum(logs[g[0]] * p for g, p in secrets.LETTER_GROUPS)
        sd = math.sqrt(sum(logs[g[0]] ** 2 * p for g, p in secrets.LETTER_GROUPS) - mu1**2)
        letters = [logs[c.upper()] for c in body if c.isalpha()]
        even = (sum(letters) - mu1 * len(letters)) / sd / math.sqrt(max(len(letters), 1))
    z = (even + (changes - (n - 1) * rate) / math.sqrt((n - 1) * rate * (1 - rate)) + (0.25 - r) * math.sqrt(n)) / math.sqrt(3)
    return passed, int(math.log2(n)), min(max(math.floor(z * 20), 0), 400), z


def test_statistics_equal_a_plain_computation(spark):
    rnd = random.Random(5)
    tokens = [drawn(rnd, e, n) for e in ALPHABETS for n in (20, 21, 33, 64, 129)] + ["the-river-walks-under-2024", "VERSION2OFTHEREPORT", "A1" + "b" * 60, "00000001000A00000001000A", "a" * 40 + "1", drawn(rnd, "base64", 42) + "=="]
    table = spark.createDataFrame([(t, [(0, 3, len(t), t)]) for t in tokens], "t STRING, c ARRAY<STRUCT<start INT, kind INT, `end` INT, token STRING>>")
    for r in table.select("t", F.explode(secrets.battery(F.col("c"))).alias("b")).collect():
        passed, length_class, step, z = statistics(r.t)
        assert (r.b.passed, r.b.length_class) == (passed, length_class), r.t
        assert r.b.bin == step or abs(z * 20 - round(z * 20)) < 1e-6, r.t


def test_discoveries_follow_benjamini_hochberg():
    assert secrets.discovery_bins({(5, 0): 990, (5, 100): 10}) == {5: 100}
    assert secrets.discovery_bins({(5, 0): 10}) == {}
    assert secrets.discovery_bins({(5, 60): 1, (5, 0): 10_000}) == {}
    assert math.isclose(0.5 * math.erfc(0), 0.5)


def archive(spark, rows, least=0):
    path = fresh_path(spark, "warc")
    warc.write_archive(spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING"), path, least)
    return path


def test_archive_round_trip(spark):
    rows = [(3, "http://a/", "<p>é</p>"), (1, "http://b/", "<p>é</p>"), (7, None, None), (2, "u\r\nx: y", ""), (9, "http://c/", "big" * 10_000), (None, "n", "<p>é</p>"), (1, "again", "<p>é</p>")]
    path = archive(spark, rows)
    got = warc.read_archive(spark, path).collect()
    sha = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    want = [(3, "revisit", 1), (1, "response", None), (7, "revisit", 2), (2, "response", None), (9, "response", None), (None, "response", None), (1, "response", None)]
    text = [((h or "").encode(), sha(h)) for _, _, h in rows]
    assert sorted(map(str, ((i, len(t), s, k, r) for (i, k, r), (t, s) in zip(want, text, strict=True)))) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    assert warc._payloads(spark, path).read().count() == 3
    records = [bytes(r.record) for r in warc.records(spark, path).collect()]
    assert len(records) == 7 and len({re.search(rb"WARC-Record-ID: (\S+)", r)[1] for r in records}) == 7
    for record in records:
        head, _, block = record.partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)$", head, re.M)[1])
        assert head.startswith(b"WARC/1.1\r\n") and block[length:] == b"\r\n\r\n"
        body = block[:length].partition(b"\r\n\r\n")[2]
        assert (b"WARC-Type: response" in head) == (b"WARC-Refers-To" not in head)
        if b"response" in head.split(b"\r\n")[1]:
            assert base64.b32encode(hashlib.sha1(body).digest()) in head


def test_small_payloads_are_all_responses(spark):
    path = archive(spark, [(1, "a", "tiny"), (2, "b", "tiny"), (3, "c", "x" * 99), (4, "d", "x" * 99)], 50)
    assert {r.page_id: r.record_type for r in warc.read_archive(spark, path).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert warc.read_archive(spark, archive(spark, [])).count() == 0


def test_line_ends_in_urls_and_clashing_columns(spark):
    odd = "http://a/\u2028WARC-Refers-To: <urn:tessera:page:77:0>\x85WARC-Type: revisit\r\nWARC-Type: revisit"
    rows = [(5, odd, "one", "x", 1), (6, "http://b/", "a\r\n\r\nb" * 20_000, "y", 2), (7, odd, "one", "z", 3)]
    path = fresh_path(spark, "warc")
    warc.write_archive(spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING, digest STRING, n BIGINT"), path)
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archive(spark, path).collect()}
    assert got == {5: ("response", None, 3), 6: ("response", None, 120_000), 7: ("revisit", 5, 3)}


def test_payloads_are_not_shuffled_to_rebuild_records(spark):
    path = archive(spark, [(k, "u", f"page {k}") for k in range(40)])
    plan = warc.records(spark, path)._jdf.queryExecution().executedPlan().toString()
    scan = plan[: plan.index("live")] if "live" in plan else plan
    assert scan.count("Exchange hashpartitioning") == 1 and scan.count("Sort [") == 1


def test_a_damaged_payload_is_noticed(spark):
    path = archive(spark, [(1, "a", "good")])
    store = warc._payloads(spark, path)
    changed = store.read().withColumn("payload", F.lit(b"evil"))
    store._publish([store._write(changed, False)], store.version() + 1)
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, path).collect()


def sample(spark, n=600):
    rnd = random.Random(2)
    good = lambda: " ".join(rnd.choice(["the", "river", "walks", "under", "stone", "light", "and", "green", "hill", "of"]) for _ in range(80))
    bad = lambda: " ".join(rnd.choice(["BUY!!", "click", "win", "$$$", "free!!"]) for _ in range(80))
    rows = [(k, bad() if k % 5 == 0 else good()) for k in range(n)]
    labels = [(k, int(k % 5 != 0), 0) for k in range(0, n, 3)] + [(1, None, None), (None, 1, 0)]
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT")


def test_held_out_texts_are_told_apart(spark):
    docs, labels = sample(spark)
    got = quality.resample(docs, labels).collect()
    held = [r for r in got if r.doc_id % 3]
    assert sum(r.kept != (r.doc_id % 5 != 0) for r in held) <= 0.01 * len(held)
    assert {(r.doc_id, r.key) for r in got} == {(r.doc_id, r.key) for r in quality.resample(docs.repartition(7), labels).collect()}


def test_ratios_keys_and_draw_equal_brute_force(spark):
    docs, labels = sample(spark, 240)
    docs = docs.unionByName(spark.createDataFrame([(900, None), (901, "one"), (3, "the hill BUY!!")], "doc_id BIGINT, text STRING"))
    got = quality.resample(docs, labels)
    marks = {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality is not None:
            marks[r.doc_id] = min(marks.get(r.doc_id, 1), int(r.quality == 1 and r.toxic != 1))
    half = {r.id: r.h for r in spark.createDataFrame([(k,) for k in marks], "id BIGINT").select("id", F.pmod(F.xxhash64("id", F.lit(quality.SEED + 1)), F.lit(2)).alias("h")).collect()}
    raw, target, features = {}, {}, []
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    for key, text in rows:
        hashed = textnum.words(text.encode(), np.array([0, len(text.encode())]))[0]
        found = [int(h) % quality.BUCKETS for h in textnum.mix(hashed)]
        found += [int(textnum.mix(textnum.ngrams(hashed[k : k + 2], 2) + np.uint64(1))[0]) % quality.BUCKETS for k in range(len(hashed) - 1)]
        features.append(found)
        for b in found:
            raw[b] = raw.get(b, 0) + 1
            if marks.get(key) == 1 and half[key] == 0:
                target[b] = target.get(b, 0) + 1
    share = sum(target.values()) / sum(raw.values())
    added = quality.SHRINK * sum(target.values())
    score = [sum(math.log((target.get(b, 0) + added) / (raw[b] * share + added)) for b in found) for found in features]
    cuts = {}
    for (key, _), x in zip(rows, score, strict=True):
        if key in marks and half[key] == 1:
            cuts[key] = min(x, cuts.get(key, x))
    loss = lambda c: sum((10 if marks[k] else 0) if x <= c else (0 if marks[k] else 1) for k, x in cuts.items())
    edges = sorted(cuts.values())
    cut = min([-math.inf, *((a + b) / 2 for a, b in zip(edges, edges[1:], strict=False)), edges[-1]], key=loss)
    noise = spark.createDataFrame([(k, float(x), len(f)) for (k, _), x, f in zip(rows, score, features, strict=True)], "id BIGINT, log_weight DOUBLE, n_features BIGINT")
    assert sorted((r.doc_id, round(r.log_weight, 9)) for r in got.collect()) == sorted((k, round(x, 9)) for (k, _), x in zip(rows, score, strict=True))
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "log_weight", F.lit(len(features[0])).cast("long"), F.lit(quality.SEED)), 11).cast("double") + 0.5) / float(1 << 53)
    same = got.filter(F.col("doc_id") == rows[0][0]).select("key", (F.col("log_weight") - F.log(-F.log(u))).alias("want")).first()
    assert noise.count() == len(rows) and math.isclose(same.key, same.want, rel_tol=1e-12)
    k = sum(x > cut for x in score)
    ranked = sorted((r.key for r in got.collect()), reverse=True)
    assert sorted(r.key for r in got.filter("kept").collect()) == sorted(ranked[:k])


def test_exactly_k_are_drawn(spark):
    docs, labels = sample(spark)
    got = quality.resample(docs, labels, keep=100).collect()
    kept = [r.key for r in got if r.kept]
    assert len(kept) == 100 and min(kept) >= max(r.key for r in got if not r.kept)
    assert sum(r.kept for r in quality.resample(docs, labels, keep=0).collect()) == 0


def test_odd_rows(docs, nothing, spark):
    _, labels = sample(spark)
    got = quality.resample(docs, labels).collect()
    assert len(got) == docs.count()
    assert {r.log_weight for r in got if r.doc_id in (0, 1, 2)} == {0.0}
    assert all(r.kept for r in quality.resample(docs, labels.limit(0)).collect())
    assert quality.resample(nothing, labels).count() == 0


def test_places_of_many_matches(spark):
    """As many as chunks hold, one more and one less, and a log of several MB; scanned in seconds."""
    rnd = random.Random(9)
    line = lambda k: rnd.choice([f"token=abcdefghij{k:08d}", f"AKIAABCDEFGHIJ12{k:08d}", f"deadbeefdeadbeef{k:08x}", "é🙂 plain"])
    rows = [(n, " \n".join(f"secret: value{k:08d}" for k in range(n))) for n in (255, 256, 257, 512, 513, 1000)]
    rows += [(5_000, "\n".join(line(k) for k in range(150_000)))]
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()}
    assert len(rows[-1][1]) > 3_000_000
    for key, text in rows:
        spans = base_spans(text)
        sha = hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
        r = got[key]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (*(sum(s[1] == k for s in spans) for k in range(3)), sha)


def test_nine_in_ten_random_strings_are_found(spark):
    """Of 500 strings of each kind among as many structured ones."""
    rnd = random.Random(12)
    kinds = [("base32", 26), ("base32", 32), ("hex", 32), ("hex", 40), ("base64", 20), ("base64", 32)]
    rows = [(1000 * j + k, f"key {drawn(rnd, *kind)} end") for j, kind in enumerate(kinds) for k in range(500)]
    names = "river stone light green report data config user session version service account index page".split()
    rows += [(100_000 + k, "see " + "/".join(rnd.choices(names, k=4)) + f"/v{rnd.randrange(3000)}") for k in range(3000)]
    got = {r.doc_id: r.n_random for r in secrets.scan(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()}
    found = {kind: sum(got[1000 * j + k] > 0 for k in range(500)) / 500 for j, kind in enumerate(kinds)}
    assert min(found.values()) >= 0.9, found
    assert sum(n for k, n in got.items() if k >= 100_000) <= 30
