"""Quality rules: fixed limits on word statistics, then robust multivariate outliers.

Statistics of whole texts come from array functions, row by row. Documents that pass the fixed limits are described
by five transformed statistics; for each language and source a minimum-covariance-determinant estimate of their centre
and scatter is made by concentration steps from several robust starts, of which the smallest determinant is kept, all as grouped aggregations over the narrow table
of statistics, and documents beyond a quantile of the Mahalanobis distance are rejected. A source with too few documents is
judged by the estimate of its whole language; where that too has too few, by the estimate of all documents. So every document past the fixed limits gets a distance.

All is DataFrame and SQL functions. Aggregations combine on the map side, so a source with a third of all documents is no hot
task. What a step learns (a row for each group) is written and read again, so that no plan nests the steps before it.

Defined cases: a null text has no words; a null language or source is a group of its own; ties at the subset's edge
are all inside; rows of a source with equal texts count once in its estimate, and each is judged; an empty table gives an empty result; extra columns are
kept by `kept_documents` and ignored by the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: What separates words, as a class for patterns and as characters.
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"

#: The transformed statistics, each with the spread, in its own unit, that is always granted.
GRANTED = {"f_words": 0.3, "f_word_chars": 0.08, "f_symbols": 0.6, "f_dup_lines": 0.25, "f_repeats": 0.12}
NAMES = list(GRANTED)
#: Share of a group in the subset, and what makes its covariance that of the whole under a normal law of five
#: dimensions: 0.75 / P(chi2(7) <= q) with q the 0.75 quantile of chi2(5), 6.626.
SUBSET, CONSISTENCY = 0.75, 1.412
#: Squared distance beyond which a document is rejected: the 1 - 1e-4 quantile of chi2(5), so one clean document in 10,000 under a
#: normal law. Every statistic alone can reach it in a group of no spread: (its range / GRANTED) ** 2 is 39 at least.
CUT = 25.74
MIN_GROUP = 60
BIN_PER_E = 64
#: Relative precision of medians, as its inverse; concentration steps after which a start that still gains is left where it is.
PRECISION, MOST_STEPS = 10_000, 40


def word_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, `keep`, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    A repeated three-word window is found by sorting 64-bit values of a window's hash and, in the lowest bits, its
    place: equal hashes end up side by side with their places. The windows of equal hashes, few as a rule, are then sorted by their words."""
    rows = df.select(id_col, *keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    trimmed = F.btrim("__text", F.lit(SPACE_CHARS))
    rows = rows.withColumn("__words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS)))
    rows = rows.withColumn("__bits", F.length(F.bin(F.size("__words").cast("bigint"))))
    rows = rows.withColumn("__keys", F.expr("transform(slice(__words, 1, greatest(size(__words) - 2, 0)), (w, i) -> shiftleft(shiftright(xxhash64(w, get(__words, i + 1), get(__words, i + 2)), __bits), __bits) | i)"))
    rows = rows.withColumn("__sorted", F.sort_array("__keys"))
    rows = rows.withColumn("__twice", F.expr("filter(__sorted, (x, k) -> shiftright(x, __bits) = shiftright(get(__sorted, k + 1), __bits) OR shiftright(x, __bits) = shiftright(get(__sorted, k - 1), __bits))"))
    # equal hashes are only candidates: their words say which windows are equal
    rows = rows.withColumn("__named", F.expr("sort_array(transform(transform(__twice, x -> CAST(x & (shiftleft(1L, __bits) - 1) AS INT)), i -> struct(concat_ws(' ', get(__words, i), get(__words, i + 1), get(__words, i + 2)) AS w, i AS i)))"))
    rows = rows.withColumn("__equal", F.expr("filter(__named, (x, k) -> x.w = get(__named, k + 1).w OR x.w = get(__named, k - 1).w)"))
    covered = F.expr("size(array_distinct(flatten(transform(__equal, x -> array(x.i, x.i + 1, x.i + 2)))))")
    rows = rows.withColumn("__lines", F.filter(F.split("__text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""))
    counts = {
        "n_words": F.size("__words"),
        "word_chars": F.char_length(F.array_join("__words", "")),
        "n_symbols": F.regexp_count("__text", F.lit(SYMBOLS)),
        "n_lines": F.size("__lines"),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": F.when(F.size("__equal") == 0, 0).otherwise(covered),
    }
    return rows.select(id_col, *keep, *[c.cast("bigint").alias(k) for k, c in counts.items()])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "f_words": F.log(words),
        "f_word_chars": F.log(F.greatest(F.col("word_chars") / words, F.lit(0.1))),
        "f_symbols": F.asinh(100 * share("n_symbols", "word_chars")),
        "f_dup_lines": F.asin(F.sqrt(share("n_dup_lines", "n_lines"))),
        "f_repeats": F.asin(F.sqrt(F.least(share("n_repeat_words", "n_words"), F.lit(1.0)))),
    }


KEYS = ("lang", "grp", "start")


def _moments(rows: DataFrame, keys: tuple[str, ...], columns: list[str], floors: list[float], scale: float) -> DataFrame:
    """Centre and regularised covariance of each group's `columns`, as m_i and the lower Cholesky factor l_i_j, with the logarithm of its determinant."""
    d = len(columns)
    sums = [F.avg(x).alias(f"m_{i}") for i, x in enumerate(columns)]
    sums += [F.covar_pop(columns[i], columns[j]).alias(f"c_{i}_{j}") for i in range(d) for j in range(i + 1)]
    out = rows.groupBy(*keys).agg(*sums)
    for i in range(d):
        for j in range(i + 1):
            c = F.col(f"c_{i}_{j}") * scale
            rest = sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
            factor = F.sqrt(F.greatest(c + floors[i] ** 2 - rest, F.lit(1e-6))) if i == j else (c - rest) / F.col(f"l_{j}_{j}")
            out = out.withColumn(f"l_{i}_{j}", factor)
    out = out.withColumn("logdet", F.round(2 * sum((F.log(f"l_{i}_{i}") for i in range(d)), F.lit(0.0)), 9))
    return out.drop(*[f"c_{i}_{j}" for i in range(d) for j in range(i + 1)])


def _matched(rows: DataFrame, other: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """`rows` joined with `other`, whose keys bear a leading __."""
    return rows.join(other.withColumnsRenamed({k: f"__{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], how).drop(*[f"__{k}" for k in keys])


def _distance(columns: list) -> Column:
    """The squared Mahalanobis distance of `columns` less their centre, by forward substitution with the Cholesky factor; needs a row joined with its model."""
    y: list[Column] = []
    for i, x in enumerate(columns):
        y.append((x - sum((F.col(f"l_{i}_{k}") * y[k] for k in range(i)), F.lit(0.0))) / F.col(f"l_{i}_{i}"))
    return sum((v * v for v in y), F.lit(0.0))


def _with_distance(rows: DataFrame, model: DataFrame, keys: tuple[str, ...] = KEYS[:2]) -> DataFrame:
    """`rows` with the squared Mahalanobis distance d2 from the model of its group."""
    out = _matched(rows, model, keys, "left")
    for i, x in enumerate(NAMES):
        rest = sum((F.col(f"l_{i}_{k}") * F.col(f"y_{k}") for k in range(i)), F.lit(0.0))
        out = out.withColumn(f"y_{i}", (F.col(x) - F.col(f"m_{i}") - rest) / F.col(f"l_{i}_{i}"))
    return out.withColumn("d2", sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(len(NAMES))), F.lit(0.0))).select(*rows.columns, "d2")


def _closest(rows: DataFrame) -> DataFrame:
    """The SUBSET of the rows of each group and start with the smallest d2. Distances are counted in fine bins, which combine on the map side; a group's edge is a bin."""
    binned = rows.withColumn("bin", F.floor(F.log(F.col("d2") + 1e-6) * BIN_PER_E))
    of_start = Window.partitionBy(*KEYS)
    counts = binned.groupBy(*KEYS, "bin").count().withColumns({"upto": F.sum("count").over(of_start.orderBy("bin")), "total": F.sum("count").over(of_start)})
    edges = counts.where(F.col("upto") >= SUBSET * F.col("total")).groupBy(*KEYS).agg(F.min("bin").alias("edge"))
    return _matched(binned, stored(edges, "quality-edges"), KEYS).where("bin <= edge").select(*rows.columns)


def _started(rows: DataFrame) -> DataFrame:
    """A copy of `rows` for each of three starts, with d2 from a robust centre and scatter. All statistics are centred at their medians and
    divided by their scales (from the median absolute deviation and what is granted). Start 0 takes the plain distance of these; starts 1 and 2 the
    Mahalanobis distance under the correlations of their hyperbolic tangents and of their spatial signs, both of which a far-off row moves by a bounded amount."""
    keys = KEYS[:2]
    middle = stored(rows.groupBy(*keys).agg(*[F.percentile_approx(x, 0.5, F.lit(PRECISION)).alias(f"mid_{x}") for x in NAMES]), "quality-middle")
    near = _matched(rows, middle, keys)
    spread = near.groupBy(*keys).agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"mid_{x}")), 0.5, F.lit(PRECISION)).alias(f"mad_{x}") for x in NAMES])
    scaled = _matched(near, stored(spread, "quality-spread"), keys)
    z = [(F.col(x) - F.col(f"mid_{x}")) / F.sqrt((1.4826 * F.col(f"mad_{x}")) ** 2 + GRANTED[x] ** 2) for x in NAMES]
    names = [f"z_{i}" for i in range(len(NAMES))]
    scaled = scaled.select(*rows.columns, *[v.alias(k) for v, k in zip(z, names, strict=True)])
    length = F.greatest(F.sqrt(sum((F.col(k) * F.col(k) for k in names), F.lit(0.0))), F.lit(1e-9))
    shapes = [[F.tanh(k) for k in names], [F.col(k) / length for k in names]]
    bounded = [f"b_{i}" for i in range(len(NAMES))]
    turned = None
    for k, shape in enumerate(shapes, 1):
        part = scaled.select(*keys, F.lit(k).alias("start"), *[v.alias(b) for v, b in zip(shape, bounded, strict=True)])
        turned = part if turned is None else turned.unionByName(part)
    deviations = turned.groupBy(*KEYS).agg(*[F.sqrt(F.var_pop(b) + 1e-4).alias(f"s_{i}") for i, b in enumerate(bounded)])
    ones = _matched(turned, stored(deviations, "quality-deviations"), KEYS).select(*KEYS, *[(F.col(b) / F.col(f"s_{i}")).alias(b) for i, b in enumerate(bounded)])
    shape = stored(_moments(ones, KEYS, bounded, [0.1] * len(bounded), 1.0), "quality-shapes")
    copies = scaled.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    d2 = F.when(F.col("start") == 0, sum((F.col(k) * F.col(k) for k in names), F.lit(0.0))).otherwise(_distance([F.col(k) for k in names]))
    return _matched(copies, shape, KEYS, "left").select(*rows.columns, "start", d2.alias("d2"))


def estimate(rows: DataFrame) -> DataFrame:
    """The estimate of each (lang, grp) of rows that are told apart by text_hash: of the robust starts, each followed by concentration steps until no determinant falls
    any more, the one with the smallest determinant. Rows of a group with equal texts count once."""
    single = stored(rows.select("lang", "grp", "text_hash", *NAMES).groupBy("lang", "grp", "text_hash").agg(*[F.first(x).alias(x) for x in NAMES]).drop("text_hash"), "quality-single")
    floors = [GRANTED[x] for x in NAMES]
    begun = _started(single)
    copies = single.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    best = stored(_moments(_closest(begun), KEYS, NAMES, floors, CONSISTENCY), "quality-model")
    for _ in range(MOST_STEPS):
        after = stored(_moments(_closest(_with_distance(copies, best, KEYS)), KEYS, NAMES, floors, CONSISTENCY), "quality-model")
        fell = _matched(after, best.select(*KEYS, F.col("logdet").alias("before")), KEYS).where(F.col("logdet") < F.col("before") - 1e-6)
        better = stored(_lower(after, best), "quality-model")
        done, best = not fell.limit(1).count(), better
        if done:
            break
    order = Window.partitionBy("lang", "grp").orderBy("logdet", "start")
    return stored(best.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k", "start", "logdet"), "quality-best")


def _lower(after: DataFrame, before: DataFrame) -> DataFrame:
    """For each group and start, the one of two models with the smaller determinant (a step over binned distances may also rise by a trifle)."""
    order = Window.partitionBy(*KEYS).orderBy("logdet", "__age")
    both = after.withColumn("__age", F.lit(1)).unionByName(before.withColumn("__age", F.lit(0)))
    return both.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k", "__age")


def _levels(sizes: DataFrame) -> DataFrame:
    """For each (glang, gsource) with n documents: the (lang, grp) of the estimate that judges it, and those of all estimates that it is a member of.
    The estimate is the source's own, else the language's, else that of all documents, the first two from MIN_GROUP documents on."""
    of_lang = Window.partitionBy("lang")
    level = F.when(F.col("n") >= MIN_GROUP, 1).when(F.sum("n").over(of_lang) >= MIN_GROUP, 2).otherwise(3)
    at = lambda lang, grp: F.struct(lang.cast("string").alias("lang"), grp.alias("grp"))
    own = at(F.col("lang"), F.concat(F.lit("="), F.coalesce("source", F.lit("")), F.when(F.col("source").isNull(), "?").otherwise("")))
    language, every = at(F.col("lang"), F.lit("language")), at(F.lit(None), F.lit("all"))
    named = sizes.withColumn("level", level).withColumns({"in_lang": F.max((F.col("level") == 2).cast("int")).over(of_lang) == 1, "in_all": F.max("level").over(Window.partitionBy()) == 3})
    judged_by = F.when(F.col("level") == 1, own).when(F.col("level") == 2, language).otherwise(every)
    member_of = F.array_compact(F.array(F.when(F.col("level") == 1, own), F.when(F.col("in_lang"), language), F.when(F.col("in_all"), every)))
    return named.select(F.col("lang").alias("glang"), F.col("source").alias("gsource"), judged_by.alias("judged_by"), member_of.alias("member_of"))


def judged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, the statistics, base_failed, kept, and the squared distance (null where none was computed)."""
    named = df.select(F.col(id_col), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    named = named.withColumn("text_hash", F.concat(F.hex(F.xxhash64("text")), F.hex(F.xxhash64(F.lit(1), "text"))))
    rows = word_statistics(named, id_col, "text", ("lang", "source", "text_hash")).withColumn("base_failed", base_failed())
    rows = stored(rows.select(*rows.columns, *[c.alias(k) for k, c in features().items()]), "quality-statistics")
    passed = rows.where(~F.col("base_failed"))
    groups = stored(_levels(passed.groupBy("lang", "source").agg(F.count("*").alias("n"))), "quality-groups")
    same = F.col("lang").eqNullSafe(F.col("glang")) & F.col("source").eqNullSafe(F.col("gsource"))
    members = passed.join(groups, same).select(*passed.columns, F.explode("member_of").alias("__at"))
    model = estimate(members.withColumn("grp", F.col("__at.grp")).withColumn("lang", F.col("__at.lang")).drop("__at"))
    placed = rows.join(groups, same, "left").withColumn("lang", F.col("judged_by.lang")).withColumn("grp", F.col("judged_by.grp")).drop("glang", "gsource", "member_of", "judged_by")
    out = _with_distance(placed, model)
    distance = F.when(F.col("base_failed"), F.lit(None)).otherwise(F.col("d2"))
    kept = ~F.col("base_failed") & (F.coalesce(distance, F.lit(0.0)) <= CUT)
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), distance.alias("squared_distance"))


def kept_documents(df: DataFrame, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """The rows of `df` whose document is kept, with all their columns; rows that share an id go together."""
    kept = judged(df, id_col, **columns).groupBy(F.col(id_col).alias("__id")).agg(F.bool_and("kept").alias("__kept")).where("__kept")
    return df.join(kept.select("__id"), df[id_col].eqNullSafe(F.col("__id")), "left_semi")
