"""Secret scan: fixed patterns, and a battery of randomness tests for other strings.

Strings of 20 or more characters of the usual encodings' alphabets with letters and
digits are candidates. The encoding is inferred (hexadecimal, base32, base64), and three
tests look at how its characters spread over the alphabet (chi-squared), at runs and at
lag-1 serial correlation. Each test speaks twice. A candidate that one rejects as not
random, at one in a thousand, is no secret. The others may still be text too short to be
rejected, so each test's distance from what text of that length gives is a standard
normal score against text; the three, added up, give a candidate's p-value, and a
Benjamini-Hochberg step over all candidates of the corpus, by length class, keeps the
share of false discoveries. All DataFrame code, within rows but for that step's counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored, whole_text

#: Kinds in the order in which spans that begin together are listed.
KINDS = ("assign", "access", "hex", "random")
_NAME = r"(?i:password|passwd|secret|token|api_?key)"
_ASSIGN = _NAME + r"""["']?\x20*[:=]\x20*["']?"""
_VALUE = "[A-Za-z0-9+/_.=-]+"
# of the last two, a too short match cannot hide a longer one, so the length is in the pattern
PATTERNS = {"assign": _ASSIGN + _VALUE, "access": "AKIA[A-Z0-9]{14,}", "hex": "[0-9a-f]{16,}"}
LEAST_VALUE = 12

_BODY = "A-Za-z0-9+/_=-"
CANDIDATE = rf"(?<![{_BODY}])(?=[0-9+/_=-]*[A-Za-z])(?=[A-Za-z+/_=-]*[0-9])[{_BODY}]{{20,}}"
#: Alphabets by encoding.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
# What the text that such strings are taken for (identifiers, paths, slugs, numbers) is like:
#: two characters of a hexadecimal string are equal with this chance,
TEXT_EQUAL = 0.12
#: its letters fall into four groups with these chances (a random letter: by the groups' sizes),
LETTER_GROUPS = (("ETAOIN", 0.512), ("SRHLDCU", 0.322), ("MFPGWYB", 0.144), ("VKXJQZ", 0.022))
#: the next character is of another class (capital, small, digit, other) with this chance,
TEXT_CHANGES = {"hex": 0.2, "base32": 0.2, "base64": 0.3}
#: and neighbours' places in the alphabet correlate.
TEXT_CORRELATION = 0.25
#: Standard deviations at which a test rejects randomness (one in a thousand).
REJECT = 3.29
FALSE_DISCOVERIES = 0.01
_BINS = 400

_SPAN = "array<struct<start:int,kind:int,end:int,token:string>>"
#: Matches whose places are added up in one go; arrays grow by copies, so that a text's cost would else
#: grow with the square of its matches.
CHUNK = 256


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def spans(text: Column, pattern: str, kind: int) -> Column:
    """The matches from left to right, none overlapping: start, kind, end (code points), token."""
    each = rf"(?s)(.*?)(?:({pattern})|\z)"
    before, found = (F.regexp_extract_all(text, F.lit(each), F.lit(k)) for k in (1, 2))
    parts = F.zip_with(before, found, lambda b, f: F.struct(F.length(b).alias("gap"), f.alias("token")))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.length(x["token"])
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["token"].alias("token")))
        return F.struct(end.alias("at"), F.concat(state["out"], F.when(x["token"] != "", span).otherwise(F.array().cast(_SPAN))).alias("out"))

    none = F.array().cast(_SPAN)
    chunked = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / CHUNK).cast("int")), lambda c: F.slice(p, c * CHUNK + 1, F.lit(CHUNK)))

    def offsets(chunks: Column) -> Column:
        """Where each chunk starts, and the end."""
        sizes = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["gap"] + F.coalesce(F.length(x["token"]), F.lit(0))))
        at = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(sizes, at, lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out")))["out"]

    walk = lambda c, at: F.aggregate(c, F.struct(at.alias("at"), none.alias("out")), step)["out"]
    walked = _let(parts, lambda p: _let(chunked(p), lambda chunks: F.flatten(F.zip_with(chunks, offsets(chunks), walk))))
    return F.when(text.rlike(pattern), walked).otherwise(none)


def base_spans(text: Column) -> Column:
    assign = spans(text, PATTERNS["assign"], 0)
    assign = F.filter(assign, lambda s: F.length(F.regexp_extract(s["token"], f"^{_ASSIGN}({_VALUE})$", 1)) >= LEAST_VALUE)
    return F.array_sort(F.concat(assign, spans(text, PATTERNS["access"], 1), spans(text, PATTERNS["hex"], 2)))


def apart_from(found: Column, base: Column) -> Column:
    """The spans of ``found`` that touch none of ``base`` (sorted by start). These are looked up by runs of
    the square root of their number, of which a span meets few."""
    n = F.greatest(F.ceil(F.sqrt(F.size(base).cast("double"))).cast("int"), F.lit(16))
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(base) - 1) / n).cast("int"), F.lit(0))), lambda k: F.slice(base, k * n + 1, n))
    bounded = F.transform(runs, lambda r: F.struct(r[0]["start"].alias("start"), F.array_max(F.transform(r, lambda b: b["end"])).alias("end"), r.alias("spans")))
    alone = lambda held: F.filter(found, lambda c: ~F.exists(held, lambda r: F.coalesce(meets(r, c), F.lit(False)) & F.exists(r["spans"], lambda b: meets(b, c))))
    return F.when(F.size(base) == 0, found).otherwise(_let(bounded, alone))


def letter_scores() -> tuple[list[float], float, float]:
    """A to Z: the log of a random letter's chance over a text's, by group; mean and deviation of it in text."""
    ratio = [math.log(len(group) / 26 / chance) for group, chance in LETTER_GROUPS]
    score = [next(r for r, (group, _) in zip(ratio, LETTER_GROUPS, strict=True) if chr(65 + k) in group) for k in range(26)]
    mean = sum(r * chance for r, (_, chance) in zip(ratio, LETTER_GROUPS, strict=True))
    return score, mean, math.sqrt(sum(r * r * chance for r, (_, chance) in zip(ratio, LETTER_GROUPS, strict=True)) - mean * mean)


def _by_encoding(enc: Column, values: dict) -> Column:
    return F.when(enc == "hex", values["hex"]).when(enc == "base32", values["base32"]).otherwise(values["base64"])


def _chi_deviation(chi: Column, free: Column) -> Column:
    """The standard normal deviation of a chi-squared statistic, after Wilson and Hilferty."""
    return (F.pow(chi / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))


def battery(candidates: Column) -> Column:
    """Each candidate's verdict and score, step by step so that nothing is computed twice."""
    encoding = lambda t: F.when(t.rlike("^[0-9a-f]+$") | t.rlike("^[0-9A-F]+$"), "hex").when(t.rlike("^[A-Z2-7]+=*$"), "base32").otherwise("base64")
    x = F.transform(candidates, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), encoding(c["token"]).alias("enc"), F.regexp_replace(c["token"], "=+$", "").alias("body")))
    keep = lambda c, *names: [c[n].alias(n) for n in ("start", "end", "enc", *names)]

    def coded(c: Column) -> Column:
        body = F.when(c["enc"] == "hex", F.lower(c["body"])).otherwise(F.translate(c["body"], "-_=", "+/"))
        pair = F.array(F.struct(F.filter(F.split(body, ""), lambda ch: ch != "").alias("chars"), _by_encoding(c["enc"], ALPHABETS).alias("alphabet")))
        codes = F.transform(pair, lambda p: F.transform(p["chars"], lambda ch: F.call_function("instr", p["alphabet"], ch) - 1))[0]
        return F.struct(*keep(c), codes.alias("codes"), _by_encoding(c["enc"], {e: float(len(a)) for e, a in ALPHABETS.items()}).alias("k"))

    x = F.filter(F.transform(x, coded), lambda c: F.size(c["codes"]) >= 16)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, v: a + v)

    def classed(c: Column) -> Column:
        kind = lambda v: F.when(c["enc"] == "hex", (v < 10).cast("int")).when(c["enc"] == "base32", (v < 26).cast("int")).otherwise(F.when(v < 26, 0).when(v < 52, 1).when(v < 62, 2).otherwise(3))
        # as many equal parts of the alphabet as leave five characters for each, a power of two
        parts = F.least(c["k"], F.pow(F.lit(2.0), F.floor(F.log2(F.size(c["codes"]) / 5.0))))
        letters = F.when(c["enc"] == "hex", F.array().cast("array<int>")).otherwise(F.filter(c["codes"], lambda v: v < F.when(c["enc"] == "base32", 26).otherwise(52)))
        n = F.size(c["codes"])
        mean = total(F.transform(c["codes"], lambda v: v.cast("double"))) / n
        return F.struct(*keep(c, "codes", "k"), n.cast("double").alias("n"), mean.alias("mean"), F.transform(c["codes"], kind).alias("kinds"), letters.alias("letters"), parts.alias("parts"), F.transform(c["codes"], lambda v: F.floor(v * parts / c["k"])).alias("coarse"))

    squares = lambda xs: total(F.transform(F.array_distinct(xs), lambda v: F.pow(F.size(F.filter(xs, lambda w: w == v)), F.lit(2.0))))
    pairs = lambda xs, f: F.zip_with(F.slice(xs, 1, F.size(xs) - 1), F.slice(xs, 2, F.size(xs) - 1), f)
    changes = lambda xs: F.size(F.filter(pairs(xs, lambda a, b: a != b), lambda t: t)).cast("double")
    score, text_mean, text_deviation = letter_scores()

    def counted(c: Column) -> Column:
        upper = F.transform(c["codes"], lambda v: v >= c["k"] / 2)
        spread = total(F.transform(c["codes"], lambda v: (v - c["mean"]) * (v - c["mean"])))
        lagged = total(pairs(c["codes"], lambda a, b: (a - c["mean"]) * (b - c["mean"])))
        unlike = total(F.transform(c["letters"], lambda v: F.element_at(F.array(*map(F.lit, score)), (v % 26 + 1).cast("int")) - text_mean))
        return F.struct(
            *keep(c, "k", "n", "parts"),
            (c["k"] / c["n"] * squares(c["codes"]) - c["n"]).alias("chi"),
            (c["parts"] / c["n"] * squares(c["coarse"]) - c["n"]).alias("chi_coarse"),
            (changes(upper) + 1).alias("runs"),
            F.size(F.filter(upper, lambda t: t)).cast("double").alias("high"),
            changes(c["kinds"]).alias("changes"),
            F.when(spread > 0, lagged / spread).otherwise(1.0).alias("r"),
            unlike.alias("unlike"),
            F.size(c["letters"]).cast("double").alias("n_letters"),
        )

    def scored(c: Column) -> Column:
        n, free = c["n"], c["k"] - 1
        both = 2 * c["high"] * (n - c["high"])
        deviation = F.sqrt(F.greatest(both * (both - n), F.lit(0.0)) / (n * n * (n - 1)))
        runs = F.when(deviation > 0, (c["runs"] - both / n - 1) / deviation).otherwise(99.0)
        random = (_chi_deviation(c["chi"], free) <= REJECT) & (_chi_deviation(c["chi_coarse"], c["parts"] - 1) <= REJECT) & (F.abs(runs) <= REJECT) & (F.abs(c["r"]) * F.sqrt(n) <= REJECT)
        excess = n * (c["k"] * TEXT_EQUAL - 1)  # what text adds to the statistic
        even = F.when(c["enc"] == "hex", (free + excess - c["chi"]) / F.sqrt(2 * free + 4 * excess)).otherwise(c["unlike"] / (text_deviation * F.sqrt(F.greatest(c["n_letters"], F.lit(1.0)))))
        rate = _by_encoding(c["enc"], TEXT_CHANGES)
        turns = (c["changes"] - (n - 1) * rate) / F.sqrt((n - 1) * rate * (1 - rate))
        apart = (TEXT_CORRELATION - c["r"]) * F.sqrt(n)
        z = (even + turns + apart) / math.sqrt(3)
        step = F.least(F.greatest(F.floor(z * 20), F.lit(0)), F.lit(_BINS)).cast("int")
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), random.alias("passed"), F.floor(F.log2(n)).cast("int").alias("length_class"), step.alias("bin"))

    return F.transform(F.transform(F.transform(x, classed), counted), scored)


def discovery_bins(counts: dict[tuple[int, int], int], share: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """By length class the lowest bin that is a discovery, from candidates per (class, bin):
    Benjamini-Hochberg with each bin's largest p-value."""
    lowest = {}
    for length_class in {c for c, _ in counts}:
        bins = sorted(((b, n) for (c, b), n in counts.items() if c == length_class), reverse=True)
        m, k = sum(n for _, n in bins), 0
        for b, n in bins:
            k += n
            if 0.5 * math.erfc(b / 20 / math.sqrt(2)) <= share * k / m:
                lowest[length_class] = b
    return lowest


def _joined(found: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", name[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, share: float = FALSE_DISCOVERIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    Null texts count as empty. Spans are ``kind:start:end`` in code points, by start, then
    kind, joined by commas; ``base_sha256`` is of those of the fixed patterns alone. A
    random string that touches a base span is part of it and is not listed. Ids are only
    carried and may repeat. Texts are scanned whole, however long; spans that begin
    together are listed by kind. Columns of other names are not read, whatever they are.
    An empty table gives no rows.
    """
    text = whole_text(text_col)
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), base_spans(text).alias("base"))
    apart = apart_from(spans(F.col("text"), CANDIDATE, 3), F.col("base"))
    found = stored(base.select("id", "base", battery(apart).alias("tested")), "secrets")
    # what a test rejects is no discovery, whatever its score
    tested = found.select(F.explode("tested").alias("t")).select("t.length_class", F.when(F.col("t.passed"), F.col("t.bin")).otherwise(0).alias("bin"))
    # at most bins x length classes rows
    counts = {(r[0], r[1]): r[2] for r in tested.groupBy("length_class", "bin").count().collect()}
    lowest = discovery_bins(counts, share)
    accept = lambda t: F.lit(False)
    if lowest:
        table = F.create_map(*(F.lit(v) for pair in sorted(lowest.items()) for v in pair))
        accept = lambda t: t["passed"] & (t["bin"] >= F.coalesce(table[t["length_class"]], F.lit(_BINS + 1)))
    random = F.transform(F.filter("tested", accept), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end"), F.lit("").alias("token")))
    number = lambda k: F.size(F.filter("every", lambda s: s["kind"] == k)).cast("long")
    return found.select("id", "base", F.array_sort(F.concat("base", random)).alias("every")).select(
        F.col("id").alias(id_col),
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        number(3).alias("n_random"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("every")).alias("spans"),
    )


def op2_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
