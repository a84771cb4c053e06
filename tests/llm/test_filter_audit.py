import random
import re
from collections import Counter, defaultdict
from itertools import permutations

from tessera.llm.filter_audit import histogram, interactions


def serial(rows, labels):
    """The audit, order by order and document by document."""
    first = {}
    for doc, text, _ in rows:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    parts = defaultdict(list)
    for doc, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": doc is not None and first[text] < doc,
        }
        parts[lang or ""].append(({f for f, bad in fails.items() if bad}, doc in good, doc in toxic))
    out, shapley = {}, Counter()
    for part, docs in parts.items():
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                here = [(f in bad, bool(bad & set(order[:k])), bad == {f}, g, t) for bad, g, t in docs]
                removed = [x for x in here if x[0] and not x[1]]
                shapley[part, f] += len(removed)
                out[part, "".join(order), k + 1] = [
                    sum(not x[0] and not x[1] for x in here), len(removed), sum(x[0] and x[1] for x in here), sum(x[2] for x in here), sum(x[3] for x in removed), sum(x[4] for x in removed)
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(d, t, x, "n", 1) for d, t, x in rows], "doc_id BIGINT, text STRING, lang STRING, mask STRING, n INT")
    marks = spark.createDataFrame([(*x, 3) for x in labels], "doc_id BIGINT, quality INT, toxic INT, part INT")
    got = interactions(histogram(docs, marks)).collect()
    assert len({(r[0], r[1], r[2]) for r in got}) == len(got)
    return {tuple(r[:3]): tuple(r[3:]) for r in got}


def test_equals_serial_audit(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "A" * 40, "low words only", "x $ y", "é" * 100 + " AB", "\x1cone\x85two three"]
    for _ in range(60):
        words = [rng.choice(["a", "b", "Cc", "D", "é", "#"] + [f"w{k}" for k in range(rng.choice([3, 400]))]) for _ in range(rng.choice([5, 199, 200, 201, 400]))]
        texts.append(rng.choice([" ", "\n", " \t "]).join(words))
    rows = [(k, rng.choice(texts), rng.choice(["en", "de", None, ""])) for k in range(400)]
    rows += [(None, texts[3], "en"), (None, texts[3], "en"), (7, texts[4], "en"), (7, texts[4], "en"), (8, texts[4], "de"), (-1, "long " * 400_000, "de"), (1000, "long " * 400_000, "en")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 300)] + [(5, 1, 1), (5, 0, 0), (None, 1, 1), (99_999, 1, 1)]
    assert audited(spark, rows, labels) == serial(rows, labels)


def test_copies_in_many_parts(spark):
    """One text in many parts, its smallest id in one of them."""
    rows = [(k, "same text", f"p{k % 50}") for k in range(2_000)] + [(5_000, "other", "p0")]
    got = audited(spark, rows, [(0, 1, 0), (1, 1, 1)])
    assert got == serial(rows, [(0, 1, 0), (1, 1, 1)])
    assert got["p0", "EABCD", 1][:2] == (2, 39) and got["p1", "EABCD", 1][:2] == (0, 40)


def test_without_documents(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}
