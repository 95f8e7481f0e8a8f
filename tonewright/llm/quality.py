"""Quality rules: base rules, then robust multivariate outliers by language and source.

Base counts are of whole texts (see `counts`). Documents that pass the base rules give a vector of
transformed statistics; for each (lang, source) the minimum covariance determinant (MCD) estimates
location and scatter from the 75 % of documents whose scatter has the least determinant, and a
document goes if its squared Mahalanobis distance exceeds CUTOFF.

The MCD is found by concentration steps from two deterministic starts (medians with median
deviations; means and variances of vectors squashed by tanh), for all groups at once: group sums
are partial aggregates, the step's quantile comes from a histogram of log2 distances with 32 bins an octave, so
no group is gathered in a task and reruns agree. Steps end for a group when its determinant does not
fall any more. The start with the lesser determinant wins, then one reweighted step follows. Scatter
gets a floor for each statistic (FLOORS), as many are constant for clean text; a text outlies by one
statistic alone only if it is more than sqrt(CUTOFF) = 7.1 floors away.

Groups of under 60 documents are estimated with all others of their language that are too small, then
with all of these together; if these are under 60 too, all are kept. Null texts are empty; a null
lang or source is a group like any other. Long texts are counted whole. Repeated rows count as
documents of their own and get the same verdict, as do ties. An empty table gives an empty one. Other
columns are ignored by `verdicts` and kept as they are by `keep_good`. No Python runs on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonewright.llm.storage import settled, small
from tonewright.llm.text import lines, row_key, trimmed, words

#: Of a chi-square variable with five degrees of freedom: tail 1e-9.
CUTOFF = 51.0
SHARE = 0.75
# Chi-square quantile and consistency factors for five statistics and 75 %, and for the 97.5 % reweighting.
CONSISTENCY = 1.41
REWEIGHT_AT = 12.83
REWEIGHT_BY = 1.055
#: A step that lessens the log of the determinant's root by no more is the last.
SETTLED = 1e-3
LEAST_ROWS = 60
BINS = 32

NAMES = ("x0", "x1", "x2", "x3", "x4")
#: What a clean text of 200 words may differ by: a tenth of its words, the sampling error of its mean word length (0.5 / sqrt(200)),
#: one symbol in a thousand characters (sqrt), not half a line said again (ln 2 = 0.69), one line of eight words said again (16 / 200).
FLOORS = (0.10, 0.04, 0.03, 0.30, 0.08)
P = len(NAMES)


def counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long), after all of their columns."""
    text = F.coalesce("row.text", F.lit(""))
    wordy = lambda x: trimmed(x) != ""
    step = docs.select(F.struct("*").alias("row"))
    step = step.withColumn("_w", words(F.col("row.text"))).withColumn("_l", F.filter(lines(F.col("row.text")), wordy))
    hashes = F.when(F.size("_w") < 3, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.greatest(F.size("_w") - 3, F.lit(0))),
            lambda i: F.struct(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i")),
        )
    )
    step = step.withColumn("_s", F.sort_array(hashes))
    near = lambda i: F.get("_s", i)["h"]
    at = F.sort_array(
        F.transform(
            F.filter("_s", lambda x, i: (x["h"] == F.when(i > 0, near(i - 1))) | F.coalesce(x["h"] == near(i + 1), F.lit(False))),
            lambda x: x["i"],
        )
    )
    step = step.withColumn("_at", at)
    covered = F.aggregate(
        F.transform("_at", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("_at", i + 1) - x, F.lit(3))).cast("long")),
        F.lit(0).cast("long"),
        lambda acc, x: acc + x,
    )
    step = step.select(
        "row",
        F.size("_w").cast("long").alias("n_words"),
        F.aggregate("_w", F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )
    return step.select("row.*", *step.columns[1:])


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.ln(1.0 + F.col("n_words")),
        F.ln(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.ln(1.0 + F.col("n_dup_lines")),
        F.col("n_repeat_words") / n,
    ]


def _groups(fit: DataFrame, least_rows: int) -> DataFrame:
    """g_lang, g_source -> g, the group that estimates them; null g: too few rows."""
    size = fit.groupBy("g_lang", "g_source").agg(F.count("*").alias("n"))
    few = F.when(F.col("n") < least_rows, F.col("n")).otherwise(0)
    size = size.withColumn("of_lang", F.sum(few).over(Window.partitionBy("g_lang")))
    rest = F.when(F.col("of_lang") < least_rows, few).otherwise(0)
    size = size.withColumn("of_all", F.sum(rest).over(Window.partitionBy()))  # one row a group
    return size.select(
        "g_lang",
        "g_source",
        F.when(F.col("n") >= least_rows, F.xxhash64(F.lit("own"), "g_lang", "g_source"))
        .when(F.col("of_lang") >= least_rows, F.xxhash64(F.lit("lang"), "g_lang"))
        .when(F.col("of_all") >= least_rows, F.xxhash64(F.lit("all")))
        .alias("g"),
    )


def _with_scatter(moments: DataFrame, keys: list[str], factor: float, floors: tuple[float, ...]) -> DataFrame:
    """keys, m (location), k (inverse Cholesky factor, by row) and logdet, from n, s_i and s_ij."""
    col = lambda name, i, j: F.col(f"{name}{i}_{j}")
    minus = lambda terms, start: reduce(lambda acc, t: acc - t, terms, start)
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    cur = moments.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(P)})
    c = {(i, j): (col("s", i, j) / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * factor + (floors[i] ** 2 if i == j else 0.0) for i, j in pairs}
    cur = cur.withColumns({f"c{i}_{j}": v for (i, j), v in c.items()})
    for j in range(P):  # Cholesky, column by column
        rest = {i: minus([col("l", i, k) * col("l", j, k) for k in range(j)], col("c", i, j)) for i in range(j, P)}
        cur = cur.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(rest[j], F.lit(floors[j] ** 2 / 100))))
        cur = cur.withColumns({f"l{i}_{j}": rest[i] / col("l", j, j) for i in range(j + 1, P)}) if j + 1 < P else cur
    for off in range(P):  # its inverse, diagonal by diagonal
        own = [(i, i - off) for i in range(off, P)]
        cur = cur.withColumns({f"k{i}_{j}": (minus([col("l", i, k) * col("k", k, j) for k in range(j, i)], F.lit(0.0)) if off else F.lit(1.0)) / col("l", i, i) for i, j in own})
    logdet = sum((F.ln(F.col(f"l{i}_{i}")) for i in range(P)), F.lit(0.0))
    return cur.select(
        *keys,
        F.array(*[F.col(f"m{i}") for i in range(P)]).alias("m"),
        F.array(*[col("k", i, j) for i, j in pairs]).alias("k"),
        logdet.alias("logdet"),
    )


def distance(x: list[Column]) -> Column:
    """Squared Mahalanobis distance of x by the columns m and k."""
    total, at = F.lit(0.0), 0
    for i in range(P):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.get("k", F.lit(at + j)) * (x[j] - F.get("m", F.lit(j)))
        at += i + 1
        total = total + y * y
    return total


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    x = [F.col(c) for c in NAMES]
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(P)]
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), *sums, *[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(P) for j in range(i + 1)]
    )


def _at_share(rows: DataFrame, keys: list[str], share: float, bins: Column) -> DataFrame:
    """keys, edge: the least bin up to which a share of the rows lies."""
    hist = rows.groupBy(*keys, bins.alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    upto = F.sum("n").over(w.orderBy("bin"))
    return (
        hist.withColumn("upto", upto).withColumn("of", F.sum("n").over(w)).filter(F.col("upto") >= share * F.col("of")).groupBy(*keys).agg(F.min("bin").alias("edge"))
    )


def _first(rows: DataFrame, floors: tuple[float, ...]) -> DataFrame:
    """g, start, m, k of both starts."""
    long = rows.select("g", F.posexplode(F.array(*NAMES)).alias("d", "v"))
    fine = F.floor(F.col("v") * 256)
    mid = _at_share(long, ["g", "d"], 0.5, fine).select("g", "d", (F.col("edge") / 256).alias("mid"))
    off = long.join(small(settled(mid, "medians")), ["g", "d"]).withColumn("off", F.abs(F.col("v") - F.col("mid")))
    dev = _at_share(off, ["g", "d"], 0.5, F.floor(F.col("off") * 256))
    robust = settled(
        mid.join(dev, ["g", "d"])
        .withColumn("sd", F.greatest((F.col("edge") + 0.5) / 256 * 1.4826, F.element_at(F.array(*[F.lit(f) for f in floors]), F.col("d") + 1)))
        .groupBy("g")
        .agg(F.sort_array(F.collect_list(F.struct("d", "mid", "sd"))).alias("r")),  # five of each group
        "robust",
    )
    part = lambda i, f: F.get("r", F.lit(i))[f]
    flat = robust.select(
        "g",
        F.lit(0).alias("start"),
        F.array(*[part(i, "mid") for i in range(P)]).alias("m"),
        F.array(*[1.0 / part(i, "sd") if i == j else F.lit(0.0) for i in range(P) for j in range(i + 1)]).alias("k"),
    )
    joined = rows.join(small(robust), "g")
    squashed = joined.select("g", *[(part(i, "mid") + part(i, "sd") * F.tanh((F.col(c) - part(i, "mid")) / part(i, "sd"))).alias(c) for i, c in enumerate(NAMES)])
    tanh = _with_scatter(_moments(squashed, ["g"]), ["g"], 1.0, floors).select("g", F.lit(1).alias("start"), "m", "k")
    return flat.unionByName(tanh)


def estimates(rows: DataFrame, floors: tuple[float, ...] = FLOORS) -> DataFrame:
    """g, m, k of each group of rows (g, x0 to x4).

    Concentration steps go on, from each start, for the groups whose determinant the last step lessened.
    """
    x = [F.col(c) for c in NAMES]
    at = ["g", "start"]
    first = _first(rows, floors).select(*at, "m", "k", F.lit(None).cast("double").alias("logdet"), F.lit(True).alias("moving"))
    best = settled(first, "starts")
    while not best.filter("moving").isEmpty():
        now = small(best.filter("moving").select(*at, "m", "k"), rows=best.settled_rows)
        near = rows.join(now, "g").withColumn("_bin", F.floor(F.log2(distance(x) + 1e-6) * BINS))
        edge = settled(_at_share(near, at, SHARE, F.col("_bin")), "edges")
        core = near.join(small(edge), at).filter("_bin <= edge")
        step = _with_scatter(_moments(core, at), at, CONSISTENCY, floors).select(*at, *[F.col(c).alias(f"new_{c}") for c in ("m", "k", "logdet")])
        less = F.col("new_logdet").isNotNull() & (F.col("logdet").isNull() | (F.col("new_logdet") < F.col("logdet") - SETTLED))
        lesser = [F.when(less, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("m", "k", "logdet")]
        best = settled(best.join(step, at, "left").select(*at, *lesser, less.alias("moving")), "least")
    mcd = best.groupBy("g").agg(F.min_by(F.struct("m", "k"), F.struct("logdet", "start")).alias("e")).select("g", "e.*")
    core = rows.join(small(settled(mcd, "mcd")), "g").filter(distance(x) <= REWEIGHT_AT)
    return settled(_with_scatter(_moments(core, ["g"]), ["g"], REWEIGHT_BY, floors).select("g", "m", "k"), "reweighted")


def verdicts(docs: DataFrame, *carry: str, cutoff: float = CUTOFF, floors: tuple[float, ...] = FLOORS, least_rows: int = LEAST_ROWS) -> DataFrame:
    """doc_id, the base counts, base_failed, distance (null where the base fails or there is no estimate) and kept.

    cutoff is of the squared distance, floors of the statistics' deviations, least_rows of a group with estimates of its own.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    each = settled(
        counts(docs.select("doc_id", "text", "lang", "source", *carry)).select(
            "doc_id",
            *carry,
            F.coalesce("lang", F.lit("\0")).alias("g_lang"),
            F.coalesce("source", F.lit("\0")).alias("g_source"),
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            failed.alias("base_failed"),
        ),
        "counts",
    )
    groups = settled(_groups(each.filter("NOT base_failed"), least_rows), "groups")
    placed = each.join(small(groups), ["g_lang", "g_source"], "left").select(
        *[c for c in each.columns if not c.startswith("g_")], "g", *[v.alias(c) for c, v in zip(NAMES, _vector(), strict=True)]
    )
    fit = placed.filter("NOT base_failed AND g IS NOT NULL").select("g", *NAMES)
    found = placed.join(small(estimates(fit, floors)), "g", "left")
    d = F.when(~F.col("base_failed"), distance([F.col(c) for c in NAMES]))
    return found.withColumn("distance", d).select(
        "doc_id",
        *carry,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "distance",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all columns."""
    key = row_key("doc_id", "text", "lang", "source")
    judged = verdicts(docs.select("doc_id", "text", "lang", "source", key.alias("key")), "key")
    gone = settled(judged.filter("NOT kept").select("key").distinct(), "rejected")
    return docs.select(F.struct("*").alias("row"), key.alias("key")).join(small(gone), "key", "left_anti").select("row.*")
