"""Quality rules: base limits, then robust multivariate outliers by minimum covariance determinant.

DataFrame functions only. Every text becomes counts; transformed, they form a vector. For
each language and source a concentration loop finds the subset whose covariance has the
least determinant. It has several starts: the medians and median deviations of the whole, and
lower and upper quantiles with deviations from them. From each it takes in turn the mean and
covariance of the closest three quarters and the Mahalanobis distances to them; a step counts
only if the determinant falls, and the start that ends with the least is used. Sums are
combined before each shuffle and the quantiles are taken over values on a fixed grid, so no
group, however large, gathers in one task. Rows beyond a quantile of chi-square are rejected.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import SPACE, fresh, shared_dir, staged

#: Symbols that count against a text.
SYMBOLS = r"[^#*$%&|<>]++"
#: Steps of the concentration loop, share of the subset, rows that a group needs.
STEPS, SHARE, LEAST_ROWS = 3, 0.75, 50
#: Quantiles of each statistic that are the centres of the starts.
STARTS = (0.5, 0.3, 0.7)
#: The share of rows of a normal vector that lie beyond the cutoff. Texts are no normal vectors, so it is small.
LEVEL = 1.5e-7
#: Fractions of one on the grid over which medians and quantiles are exact.
GRID = 512.0
#: Least standard deviation of each transformed statistic, in the order of `vector`.
FLOORS = (0.8, 0.05, 0.04, 0.16, 0.16)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column, n: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the array.

    A window's key is its hash with its position in the low bits; sorted, equal windows are
    neighbours. A text of n words leaves 64 - log2(n) hash bits. Should different windows share
    them, the text is done again with the windows themselves as keys.
    """
    long = F.lit(0).cast("long")

    def by_hash(w: Column) -> Column:
        shift = F.ceil(F.log2(F.size(w) + F.lit(1.0))).cast("int")

        def keyed(s: Column) -> Column:
            keys = F.transform(
                F.sequence(F.lit(1), F.size(w) - 2),
                lambda i: F.call_function("shiftleft", F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)), s).bitwiseOR((i - 1).cast("long")),
            )
            return let(F.sort_array(keys), lambda k: let(positions(k, s, w), lambda p: F.when(F.array_contains(p, -1), by_words(w)).otherwise(let(F.array_sort(F.array_distinct(p)), spread))))

        return let(shift, keyed)

    def positions(k: Column, s: Column, w: Column) -> Column:
        """Where the windows stand whose neighbours are equal; -1 for equal hashes of different windows."""

        def equal(a: Column, b: Column) -> Column:
            return F.call_function("shiftrightunsigned", a.bitwiseXOR(b), s) == 0

        def place(x: Column) -> Column:
            return x.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.expr("-1L"), s)))

        def both(a: Column, b: Column) -> Column:
            same = F.slice(w, place(a).cast("int") + 1, F.lit(3)) == F.slice(w, place(b).cast("int") + 1, F.lit(3))
            return F.when(equal(a, b), F.when(same, F.array(place(a), place(b))).otherwise(F.array(F.lit(-1).cast("long"))))

        return F.flatten(F.array_compact(F.zip_with(F.slice(k, F.lit(1), F.size(k) - 1), F.slice(k, F.lit(2), F.size(k) - 1), both)))

    def by_words(w: Column) -> Column:
        keys = F.sort_array(F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.struct(F.slice(w, i, F.lit(3)).alias("g"), (i - 1).cast("long").alias("at"))))
        pairs = let(keys, lambda k: F.flatten(F.array_compact(F.zip_with(F.slice(k, F.lit(1), F.size(k) - 1), F.slice(k, F.lit(2), F.size(k) - 1), lambda a, b: F.when(a["g"] == b["g"], F.array(a["at"], b["at"]))))))
        return let(pairs, lambda p: let(F.array_sort(F.array_distinct(p)), spread))

    def spread(p: Column) -> Column:
        """Words covered by windows of three that start at the sorted positions p."""
        state = F.struct(long.alias("n"), F.lit(-3).cast("long").alias("last"))
        return F.aggregate(p, state, lambda a, x: F.struct((a["n"] + F.least(F.lit(3).cast("long"), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])

    return F.when(n < 4, long).otherwise(by_hash(words))


def statistics(df: DataFrame, text_col: str, name: str = "stats") -> DataFrame:
    """df plus a struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long; null texts have none)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))

    def of_words(w: Column) -> Column:
        n = F.size(w).cast("long")
        return F.struct(
            n.alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
            dup.alias("n_dup_lines"),
            _repeat_words(w, n).alias("n_repeat_words"),
        )

    return df.withColumn(name, let(F.array_remove(F.split(text, SPACE), ""), of_words))


def base_failed(s: str) -> Column:
    return F.expr(f"{s}.n_words < 50 or 100 * {s}.n_repeat_words > 50 * {s}.n_words")


def vector(s: str) -> list[Column]:
    """The transformed statistics, on the grid: log words, log word length, roots of the shares of symbols, repeated lines, repeated words."""
    n = F.greatest(F.col(f"{s}.n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col(f"{s}.word_chars"), F.lit(1)).cast("double")
    raw = [
        F.log(n),
        F.log(chars / n),
        F.sqrt(F.col(f"{s}.n_symbols") / chars),
        F.sqrt(20.0 * F.col(f"{s}.n_dup_lines") / n),
        F.sqrt(F.col(f"{s}.n_repeat_words") / n),
    ]
    return [F.floor(x * GRID + 0.5) / GRID for x in raw]


def _add(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _cholesky(cov: dict[tuple[int, int], Column], p: int) -> tuple[list[str], list[tuple[str, Column]]]:
    """Names and definitions, in order, of the lower factor's entries l_i_j."""
    defs = []
    for i in range(p):
        for j in range(i + 1):
            rest = [F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)]
            left = cov[i, j] - _add(rest) if rest else cov[i, j]
            defs.append((f"l_{i}_{j}", F.sqrt(F.greatest(left, F.lit(1e-12))) if i == j else left / F.col(f"l_{j}_{j}")))
    return [n for n, _ in defs], defs


def _distance(rows: DataFrame, p: int) -> DataFrame:
    """rows (x0.., c0.., l_i_j) plus d2, the squared Mahalanobis distance, on a logarithmic grid."""
    for i in range(p):
        rest = [F.col(f"l_{i}_{k}") * F.col(f"z{k}") for k in range(i)]
        top = F.col(f"x{i}") - F.col(f"c{i}")
        rows = rows.withColumn(f"z{i}", (top - _add(rest) if rest else top) / F.col(f"l_{i}_{i}"))
    return rows.withColumn("d2", _add([F.col(f"z{i}") * F.col(f"z{i}") for i in range(p)])).withColumn("step", F.floor(F.log2(F.col("d2") + 1e-3) * 32))


def _salted(rows: DataFrame, groups: DataFrame, salts: int) -> DataFrame:
    """rows joined with the few columns of their group; each group's rows are spread over `salts` keys."""
    many = groups.withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(salts)))))
    return rows.join(many, ["g", "salt"])


def estimates(rows: DataFrame, p: int, *, steps: int = STEPS, share: float = SHARE, starts: tuple[float, ...] = STARTS, floors: tuple[float, ...] = FLOORS, salts: int = 16) -> DataFrame:
    """Per group g: centre c0.., factor l_i_j, the log determinant, the start, and the scale that makes the median squared distance that of a normal vector.

    rows: g, salt, x0... The groups' table is cut with checkpoint() after each step.
    """
    shared_dir(rows.sparkSession)
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    names = [f"l_{i}_{j}" for i, j in pairs]
    centres = [f"c{i}" for i in range(p)]
    mid = rows.groupBy("g").agg(*(F.percentile(f"x{i}", list(starts)).alias(f"q{i}") for i in range(p)))
    mid = mid.select("g", F.explode(F.arrays_zip(F.array(*(F.lit(i) for i in range(len(starts)))).alias("start"), *(f"q{i}" for i in range(p)))).alias("m")).select("g", "m.start", *(F.col(f"m.q{i}").alias(f"c{i}") for i in range(p))).checkpoint()
    spread = _salted(rows, mid, salts).groupBy("g", "start").agg(*(F.percentile(F.abs(F.col(f"x{i}") - F.col(f"c{i}")), 0.5).alias(f"s{i}") for i in range(p)))
    now = mid.join(spread, ["g", "start"]).select(
        "g", "start", *centres, *((F.greatest(1.4826 * F.col(f"s{i}"), F.lit(floors[i])) if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for i, j in pairs), F.lit(float("inf")).alias("logdet")
    ).checkpoint()
    for _ in range(steps):
        # one aggregation by distance bin serves for the quantile and for the sums of those inside it
        near = _distance(_salted(rows, now.drop("logdet"), salts), p)
        off = [F.col(f"x{i}") - F.col(f"c{i}") for i in range(p)]  # shifted by the old centre: sums of small numbers
        added = {"m": F.lit(1)} | {f"a{i}": off[i] for i in range(p)} | {f"b_{i}_{j}": off[i] * off[j] for i, j in pairs}
        bins = near.groupBy("g", "start", "step").agg(*(F.first(f"c{i}").alias(f"o{i}") for i in range(p)), *(F.sum(x).alias(n) for n, x in added.items()))
        group = Window.partitionBy("g", "start")
        bins = bins.withColumn("nearer", F.sum("m").over(group.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")).withColumn("all", F.sum("m").over(group))
        sums = bins.where(F.col("nearer") < share * F.col("all")).groupBy("g", "start").agg(*(F.first(f"o{i}").alias(f"o{i}") for i in range(p)), *(F.sum(n).alias(n) for n in added))
        cov = {(i, j): F.col(f"b_{i}_{j}") / F.col("m") - F.col(f"a{i}") * F.col(f"a{j}") / F.col("m") / F.col("m") + (F.lit(floors[i] ** 2) if i == j else F.lit(0.0)) for i, j in pairs}
        made = sums
        for name, column in _cholesky(cov, p)[1]:
            made = made.withColumn(name, column)
        stepped = made.select("g", "start", F.struct(_add([F.log(F.col(f"l_{i}_{i}")) * 2 for i in range(p)]).alias("logdet"), *((F.col(f"o{i}") + F.col(f"a{i}") / F.col("m")).alias(f"c{i}") for i in range(p)), *names).alias("new"))
        old = F.struct("logdet", *centres, *names)
        better = F.when(F.col("new.logdet") < F.col("logdet"), F.col("new")).otherwise(old)
        now = now.join(stepped, ["g", "start"]).select("g", "start", better.alias("m")).select("g", "start", "m.*").checkpoint()
    best = now.groupBy("g").agg(F.min(F.struct("logdet", "start", *centres, *names)).alias("m")).select("g", "m.*").checkpoint()
    last = _distance(_salted(rows, best.drop("logdet", "start"), salts), p).groupBy("g").agg((F.pow(F.lit(2.0), F.percentile("step", 0.5) / 32) / F.lit(_median_chi2(p))).alias("scale"))
    return best.join(last, "g").withColumn("scale", F.greatest("scale", F.lit(1.0)))


def _median_chi2(p: int) -> float:
    """Wilson and Hilferty's median of chi-square with p degrees of freedom."""
    return p * (1 - 2 / (9 * p)) ** 3


def chi2_beyond(x: float, p: int) -> float:
    """The share of chi-square with p degrees of freedom beyond x."""
    h, total = x / 2, 0.0
    if p % 2:
        term = math.sqrt(h / math.pi) * 2 * math.exp(-h)
        total = math.erfc(math.sqrt(h))
        for k in range(1, p, 2):
            total += term
            term *= h / (k / 2 + 1)
        return total
    term = math.exp(-h)
    for k in range(p // 2):
        total += term
        term *= h / (k + 1)
    return total


def chi2_cutoff(level: float, p: int) -> float:
    """The value beyond which chi-square with p degrees of freedom has the share `level`."""
    low, high = 0.0, 1.0
    while chi2_beyond(high, p) > level:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_beyond(mid, p) > level else (low, mid)
    return high


def judged(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: list[str], least_rows: int = LEAST_ROWS, level: float = LEVEL, salts: int = 16, **kw) -> tuple[DataFrame, str]:
    """The `keep` columns of each row, whatever their names, plus a struct (its name is returned too): the statistics, base_failed, d2, kept.

    Null texts count as empty. A null language or source is a group like any other. Groups of fewer
    than least_rows rows that pass the base limits have too few to estimate a covariance: they are
    judged together by language, then all together; while that is too few as well, the base limits
    decide alone. Repeated rows, ties and empty tables need no special case.
    """
    s, g, salt, of, of_group, of_salt = (fresh(docs.columns, n) for n in ("stats", "group_key", "salt_key", "model", "model_group", "model_salt"))
    source_rows = docs.select(*(f"`{c}`" for c in dict.fromkeys([*keep, *(c for c in (text_col, lang_col, source_col) if c in docs.columns)])))
    lang = F.coalesce(F.concat(F.lit("="), F.col(f"`{lang_col}`").cast("string")), F.lit("null")) if lang_col in docs.columns else F.lit("all")
    source = F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("null")) if source_col in docs.columns else F.lit("all")
    table = statistics(source_rows, text_col, s).withColumn(g, F.to_json(F.struct(lang.alias("l"), source.alias("s"))))
    table = table.withColumn(salt, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    table = staged(table.select(*(f"`{c}`" for c in keep), s, g, salt), "quality")
    good = table.where(~base_failed(s))
    sizes = good.groupBy(F.col(g).alias("g")).count()
    by_lang = F.concat(F.get_json_object("g", "$.l"), F.lit("*"))
    some = sizes.withColumn("pool", F.when(F.col("count") >= least_rows, F.col("g")).otherwise(by_lang))
    pooled = some.groupBy("pool").agg(F.sum("count").alias("n"))
    named = some.join(pooled, "pool").select("g", F.when(F.col("n") >= least_rows, F.col("pool")).otherwise(F.lit("*")).alias("pool"), "count")
    enough = named.groupBy("pool").agg(F.sum("count").alias("n")).where(F.col("n") >= least_rows).select("pool")
    shared_dir(docs.sparkSession)
    named = named.join(enough, "pool").select("g", "pool").checkpoint()
    x = vector(s)
    p = len(x)
    points = good.select(F.col(g).alias("g"), F.col(salt).alias("salt"), *(c.alias(f"x{i}") for i, c in enumerate(x)))
    points = staged(_salted(points, named, salts).select(F.col("pool").alias("g"), "salt", *(f"x{i}" for i in range(p))), "points")
    model = estimates(points, p, salts=salts, **kw)
    params = named.join(model.withColumnRenamed("g", "pool"), "pool").drop("pool").checkpoint()
    many = params.withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(salts)))))
    many = many.select(F.struct(*params.columns).alias(of), F.col("g").alias(of_group), F.col("salt").alias(of_salt))
    joined = table.join(many, (F.col(g) == F.col(of_group)) & (F.col(salt) == F.col(of_salt)), "left")
    z: list[str] = []
    for i in range(p):
        rest = [F.col(f"{of}.l_{i}_{k}") * F.col(f"`{z[k]}`") for k in range(i)]
        top = x[i] - F.col(f"{of}.c{i}")
        z.append(fresh([*docs.columns, s, of], f"z{i}"))
        joined = joined.withColumn(z[i], (top - _add(rest) if rest else top) / F.col(f"{of}.l_{i}_{i}"))
    d2 = _add([F.col(f"`{n}`") * F.col(f"`{n}`") for n in z]) / F.col(f"{of}.scale")
    failed = base_failed(s)
    verdict = F.struct(f"{s}.*", failed.alias("base_failed"), d2.alias("d2"), (~failed & F.coalesce(d2 <= chi2_cutoff(level, p), F.lit(True))).alias("kept"))
    return joined.select(*(f"`{c}`" for c in keep), verdict.alias(s)), s


def quality_report(docs: DataFrame, *, id_col: str = "doc_id", **kw) -> DataFrame:
    """Per document: doc_id, the statistics, base_failed, kept and the squared distance d2 (null where the base limits decide alone)."""
    rows, s = judged(docs, keep=[id_col], **kw)
    return rows.select(F.col(f"`{id_col}`").alias("doc_id"), *(f"{s}.{n}" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")), F.col(f"{s}.d2").alias("d2"))


def keep_good(docs: DataFrame, **kw) -> DataFrame:
    """The rows of docs that pass the base limits and are no outliers of their language and source."""
    rows, s = judged(docs, keep=docs.columns, **kw)
    return rows.where(F.col(f"{s}.kept")).drop(s)
