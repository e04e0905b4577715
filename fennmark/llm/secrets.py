"""Secret scans: known formats, and a battery of randomness tests for strings of no known format.

Known formats (`assign`, `access`, `hex`) are found by pattern. Any other long run of letters, digits and encoding
marks is a candidate. Its encoding is inferred (hex, base32, base36, base64), and two questions are asked of it:

* is it random? Chi-squared uniformity over the encoding's alphabet, a runs test about the middle of the alphabet, and the serial correlation at
  lag one, each against its law under randomness. A candidate that any of the three rejects (at a third of LOST, so that a random string is
  lost in about one case of a hundred) is none: words repeat letters, an alphabet in its order is even but not random;
* could ordinary text look like it? Ordinary text is a chain of classes (lower case, upper case, digits, marks), with letters drawn by their frequency
  within a class; both are counted over all texts. The likelihood ratio of the uniform law to this one is at least x for ordinary
  text in one case of x at most, whatever the length (Markov's inequality), so its inverse is a p-value. To be on the safe side a class stays what it is with a probability of STAYS at least.

False discoveries are controlled apart for each encoding and class of length (powers of two), by the step-up rule over all candidates of the corpus; one that is not
random has the p-value 1. Values are counted in bins of fixed width, so the rule needs one small aggregation and at most `4 encodings x 32 lengths` thresholds. Those and the
counts of the ordinary text (some 60 numbers) are the only things that reach the driver. All is DataFrame functions; a row's spans depend on that row and these numbers only.

Defined cases: a null text is empty and has no spans; an empty table gives an empty result; texts are searched whole;
spans are in code points, end exclusive; a span is the whole match; repeated rows get the same spans each; a null id keeps its row; only the
named columns are read, and in `redact` all other columns are kept as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The known formats, in the order in which kinds at the same place are listed.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
#: (kind, pattern, group whose length counts, its least length). A run too short for ACCESS or HEX holds no later match
#: that is long enough, so those two state the length in the pattern; a short ASSIGN match can hide a longer one and is dropped afterwards.
KINDS = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))

#: Candidates are maximal runs of these, of 20 or more.
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
#: Encoding: (pattern, alphabet), the narrowest first. Letters of hex and base36 count without their case.
ENCODINGS = {
    "hex": ("^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    "base32": ("^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base36": ("^([0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    "base64": ("^[A-Za-z0-9+/_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}
FOLDED = ("hex", "base36")
#: Classes of characters, by the letter that stands for each, and what ordinary text is counted by.
CLASSES = {"l": "abcdefghijklmnopqrstuvwxyz", "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "d": "0123456789", "m": "+/_="}
STAYS = 0.5
#: Share of random strings that the tests of randomness lose; the normal deviates of a third of it, of one tail and of both.
LOST, ONE_TAIL, TWO_TAILS = 0.01, 2.713, 2.935
#: Width of a bin of -ln p.
BIN = 0.05

_SPANS = "array<struct<s:int,e:int,m:string>>"


def located(text: Column, pattern: str, group: int = 0, least: int = 1) -> Column:
    """Start, end and string of each leftmost non-overlapping match whose `group` has `least` characters.

    The pieces between the matches give the places: one pass to split, one to extract, both only where there is a match."""
    p = F.lit(pattern)
    match = F.zip_with(F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    steps = F.zip_with(match, F.split(text, pattern, -1), lambda m, gap: F.struct(m["m"].alias("m"), F.char_length(m["g"]).alias("n"), F.char_length(gap).alias("gap")))
    empty = F.array().cast(_SPANS)

    def step(a: Column, x: Column) -> Column:
        start = a["pos"] + x["gap"]
        end = start + F.coalesce(F.char_length(x["m"]), F.lit(0))
        one = F.array(F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m")))
        return F.struct(end.alias("pos"), F.when(x["n"] >= least, F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

    found = F.aggregate(steps, F.struct(F.lit(0).alias("pos"), empty.alias("out")), step, lambda a: a["out"])
    return F.when(text.rlike(pattern), found).otherwise(empty)


def inferred(token: Column) -> Column:
    """The encoding of a candidate; null for plain numbers and for words: at least two of upper case, lower case and digits must occur."""
    classes = sum(token.rlike(c).cast("int") for c in ("[a-z]", "[A-Z]", "[0-9]"))
    out = F.lit(None).cast("string")
    for name, (pattern, _) in reversed(ENCODINGS.items()):
        out = F.when(token.rlike(pattern), name).otherwise(out)
    return F.when(classes >= 2, out)


def occurrences(text: Column, what: str) -> Column:
    """How often a string of single bytes that cannot overlap itself occurs."""
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(what), F.lit("")))) / len(what)


def classed(text: Column) -> Column:
    """The text with a class's letter in place of each of its characters, and a blank for any other run."""
    plain = F.regexp_replace(text, "[^A-Za-z0-9+/_=-]+", " ")
    return F.translate(plain, "".join(CLASSES.values()) + "-", "".join(k * len(v) for k, v in CLASSES.items()) + "m")


def class_pairs(classes: Column) -> dict[str, Column]:
    """How often each two classes stand side by side, of a text by `classed`."""
    out = {a + b: occurrences(classes, a + b) for a in CLASSES for b in CLASSES if a != b}
    return out | {a + a: F.octet_length(F.replace(classes, F.lit(a), F.lit(a * 2))) - F.octet_length(classes) - F.regexp_count(classes, F.lit(a + "+")) for a in CLASSES}


def ordinary(df: DataFrame, text_col: str = "text") -> dict[str, float]:
    """-ln of the probability of each letter within its class (by its lower case), and of each class after another, over all texts; each count begins with one."""
    rows = df.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    rows = rows.select(F.translate(F.lower("__text"), "-", "_").alias("__text"), classed(F.col("__text")).alias("__classes"))
    letters = CLASSES["l"] + CLASSES["d"] + CLASSES["m"]
    counts = {c: occurrences(F.col("__text"), c) for c in letters} | class_pairs(F.col("__classes"))
    row = rows.agg(*[F.coalesce(F.sum(x), F.lit(0.0)).alias(f"n_{k}") for k, x in enumerate(counts.values())]).first()
    n = {name: float(x) + 1 for name, x in zip(counts, row, strict=True)}
    out = {}
    for group in (CLASSES["l"], CLASSES["d"], CLASSES["m"]):
        out |= {c: -math.log(n[c] / sum(n[x] for x in group)) for c in group}
    for a in CLASSES:
        after = {b: n[a + b] / sum(n[a + x] for x in CLASSES) for b in CLASSES}
        out |= {a + b: -math.log(max(x, STAYS) if a == b else x) for b, x in after.items()}
    return out


def is_random(token: Column, encoding: str) -> Column:
    """Whether none of the three tests rejects that the candidate is uniform over its alphabet."""
    _, alphabet = ENCODINGS[encoding]
    k = len(alphabet)
    t = F.lower(token) if encoding in FOLDED else F.translate(F.rtrim(token, F.lit("=")), "-_", "+/")
    n = F.char_length(t).cast("double")
    places = F.transform(F.split(t, ""), lambda c: (F.instr(F.lit(alphabet), c) - 1).cast("double"))
    squares = F.aggregate(F.array(*[F.lit(c) for c in alphabet]), F.lit(0.0), lambda a, c: a + F.pow(n - F.char_length(F.replace(t, c, F.lit(""))), F.lit(2.0)))
    chi = (squares * k / n - n) / (k - 1)
    uneven = (F.cbrt(chi) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))  # Wilson and Hilferty's normal deviate

    pairs = F.arrays_zip(F.slice(places, F.lit(1), F.size(places) - 1).alias("a"), F.slice(places, F.lit(2), F.size(places) - 1).alias("b"))
    high = F.aggregate(places, F.lit(0.0), lambda a, x: a + (x >= k / 2).cast("double"))
    changes = F.aggregate(pairs, F.lit(1.0), lambda a, x: a + ((x["a"] >= k / 2) != (x["b"] >= k / 2)).cast("double"))
    expected = 1 + 2 * high * (n - high) / n
    runs = (changes - expected) / F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(0.01)))
    mean = F.aggregate(places, F.lit(0.0), lambda a, x: a + x) / n
    total = F.aggregate(places, F.lit(0.0), lambda a, x: a + F.pow(x - mean, F.lit(2.0)))
    lagged = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + (x["a"] - mean) * (x["b"] - mean))
    serial = (lagged / F.greatest(total, F.lit(1e-9)) + 1 / n) * F.sqrt(n)
    passed = (uneven <= ONE_TAIL) & (F.abs(runs) <= TWO_TAILS) & (F.abs(serial) <= TWO_TAILS)
    return F.when(F.size(places) < 2, F.lit(False)).otherwise(passed)


def minus_log_p(token: Column, encoding: str, model: dict[str, float]) -> Column:
    """-ln of the p-value of one candidate in one encoding, 0 at least: the logarithm of the likelihood ratio of the uniform law to ordinary text."""
    k = len(ENCODINGS[encoding][1])
    t = F.rtrim(token, F.lit("="))
    low, classes = F.translate(F.lower(t), "-", "_"), classed(t)
    ordinary_text = sum((occurrences(low, c) * model[c] for c in CLASSES["l"] + CLASSES["d"] + CLASSES["m"]), F.lit(0.0))
    ordinary_text += sum((n * model[pair] for pair, n in class_pairs(classes).items()), F.lit(0.0))
    return F.greatest(ordinary_text - F.char_length(t) * math.log(k), F.lit(0.0))


def candidates(text: Column, model: dict[str, float]) -> Column:
    """The text's candidates with their place, stratum and bin of -ln p."""
    with_encoding = F.transform(located(text, CANDIDATE), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), inferred(x["m"]).alias("encoding")))

    def scored(x: Column) -> Column:
        score = F.lit(0.0)
        for name in ENCODINGS:
            score = F.when((x["encoding"] == name) & is_random(x["m"], name), minus_log_p(x["m"], name, model)).otherwise(score)
        stratum = F.concat_ws(":", x["encoding"], F.floor(F.log2((x["e"] - x["s"]).cast("double"))).cast("string"))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), stratum.alias("stratum"), F.floor(score / BIN).cast("int").alias("bin"))

    return F.transform(F.filter(with_encoding, lambda x: x["encoding"].isNotNull()), scored)


def thresholds(df: DataFrame, model: dict[str, float], text_col: str = "text", rate: float = 0.05) -> dict[str, int]:
    """For each stratum the least bin that the step-up rule accepts at a false discovery rate of `rate`."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bins = df.where(text.rlike(CANDIDATE)).select(F.explode(candidates(text, model)).alias("c")).groupBy("c.stratum", "c.bin").count()
    of_stratum = Window.partitionBy("stratum")
    ranked = bins.withColumn("rank", F.sum("count").over(of_stratum.orderBy(F.desc("bin")))).withColumn("tested", F.sum("count").over(of_stratum))
    accepted = ranked.where(F.exp(-F.col("bin") * BIN) <= rate * F.col("rank") / F.col("tested"))
    return {r["stratum"]: r["bin"] for r in accepted.groupBy("stratum").agg(F.min("bin").alias("bin")).collect()}


def spans(text: Column, limits: dict[str, int], model: dict[str, float]) -> tuple[Column, Column]:
    """Base spans and all spans: arrays of struct<s, rank, e, kind>, ordered. Random strings within a base span are not listed again."""
    def as_kind(rank: int, kind: str):
        return lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"), F.lit(kind).alias("kind"))

    base = F.concat(*[F.transform(located(text, pattern, group, least), as_kind(rank, kind)) for rank, (kind, pattern, group, least) in enumerate(KINDS)])
    return F.array_sort(base), _random(text, limits, model) if limits else F.array().cast("array<struct<s:int,rank:int,e:int,kind:string>>")


def _random(text: Column, limits: dict[str, int], model: dict[str, float]) -> Column:
    least = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    accepted = F.filter(candidates(text, model), lambda c: F.coalesce(c["bin"] >= F.try_element_at(least, c["stratum"]), F.lit(False)))
    return F.transform(accepted, lambda c: F.struct(c["s"].alias("s"), F.lit(len(KINDS)).alias("rank"), c["e"].alias("e"), F.lit("random").alias("kind")))


def with_spans(df: DataFrame, text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """`df` with `__base_spans` and `__all_spans`."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    model = ordinary(df, text_col)
    base, random = spans(text, thresholds(df, model, text_col, rate), model)
    out = df.withColumn("__base_spans", base).withColumn("__random_spans", random)
    apart = F.filter("__random_spans", lambda r: ~F.exists("__base_spans", lambda b: (b["s"] < r["e"]) & (r["s"] < b["e"])))
    return out.withColumn("__all_spans", F.array_sort(F.concat("__base_spans", apart))).drop("__random_spans")


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """A row for each document with counts by kind, the digest of the base spans, and all spans."""
    out = with_spans(df.select(id_col, text_col), text_col, rate)

    def count(kind: str) -> Column:
        return F.size(F.filter("__base_spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return out.select(id_col, *[count(kind) for kind, *_ in KINDS], F.sha2(listed(F.col("__base_spans")), 256).alias("base_sha256"), listed(F.col("__all_spans")).alias("spans"))


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]", rate: float = 0.05) -> DataFrame:
    """`df` with every span of its texts replaced by `mark`; spans that overlap become one mark."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def step(a: Column, x: Column) -> Column:
        ahead = x["s"] >= a["pos"]
        more = F.concat(a["out"], F.substring(text, a["pos"] + 1, x["s"] - a["pos"]), F.lit(mark))
        return F.struct(F.greatest(a["pos"], x["e"]).alias("pos"), F.when(ahead, more).otherwise(a["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    clean = F.aggregate("__all_spans", start, step, lambda a: F.concat(a["out"], F.substring(text, a["pos"] + 1, F.char_length(text))))
    out = with_spans(df, text_col, rate)
    return out.withColumn(text_col, F.when(F.size("__all_spans") > 0, clean).otherwise(F.col(text_col))).select(*df.columns)
