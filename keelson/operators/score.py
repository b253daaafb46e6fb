"""Pillar scores, weighting methods and ranks.

Methods take the long table (entity, pillar, score), where a missing pillar has a NULL score, and
give (entity, score). Weights are a map of pillars; where pillars are missing, the weights of the
others are scaled up.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.columns import shown, steady_sum
from keelson.functions.ranking import ranks_desc
from keelson.schema import DEFAULT, Params
from keelson.sources.tables import kept


def pillar_scores(norm: DataFrame, registry: DataFrame) -> DataFrame:
    """(entity, grp, pillar, score): the mean of a pillar's indicators that have a value."""
    of = registry.where("role = 'scoring'").select("variable_name", F.explode("pillars").alias("pillar"))
    return norm.join(F.broadcast(of), "variable_name").groupBy("entity", "grp", "pillar").agg(F.avg("norm_score").alias("score"))


def wide(pillars: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One row per entity, one column per pillar."""
    return pillars.groupBy("entity", "grp").pivot("pillar", list(p.pillars)).agg(F.first("score"))


def weighted(pillars: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean over the pillars that an entity has; NULL if it has none of weight."""
    w = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])[F.col("pillar")]
    w = F.when(F.col("score").isNotNull(), w)
    return pillars.groupBy("entity").agg(F.try_divide(F.sum(w * F.col("score")), F.sum(w)).alias("score"))


def equal(pillars: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return weighted(pillars, {k: 1 / len(p.pillars) for k in p.pillars})


def custom(pillars: DataFrame, weights: dict[str, float], p: Params = DEFAULT) -> DataFrame:
    """A user's weights over pillar scores of two decimals; a pillar left out weighs 1/7, all zero is equal."""
    full = {k: float(weights.get(k, 1 / len(p.pillars))) for k in p.pillars}
    if sum(full.values()) <= 0:
        full = {k: 1 / len(p.pillars) for k in p.pillars}
    return weighted(pillars.withColumn("score", shown("score")), full)


def geometric(pillars: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The geometric mean of the pillars there are; scores below the floor count as the floor. Logarithms are summed alike in whatever order they come."""
    log = F.when(F.col("score").isNotNull(), F.ln(F.greatest(F.col("score"), F.lit(p.floor))))
    return pillars.groupBy("entity").agg(F.exp(F.try_divide(steady_sum(log, 18), F.count(log))).alias("score"))


def poured(scores: Column, n: Column, low: float, high: float) -> Column:
    """The best weighted mean of an array of scores with weights in [low, high] that sum to 1.

    Every pillar gets ``low``; the rest is poured over the scores from the highest down, ``high - low`` at
    a time. No other entity's constraint can bind, as scores are at most 100.
    """
    down = F.reverse(F.array_sort(scores))
    step = high - low
    weight = lambda i: low + F.greatest(F.lit(0.0), F.least(F.lit(step), (1 - n * low) - i * step))
    return F.aggregate(F.transform(down, lambda s, i: s * weight(i)), F.lit(0.0), lambda a, x: a + x)


def bod(pillars: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Benefit of the doubt over the valid pillars; their plain mean if they are too few for the bounds."""
    g = pillars.groupBy("entity").agg(F.collect_list("score").alias("s"), F.count("score").alias("n"), F.avg("score").alias("mean"))
    few = F.col("n") * p.weight_max < 1 - 1e-9
    return g.select("entity", F.when(F.col("n") == 0, None).when(few, F.col("mean")).otherwise(poured(F.col("s"), F.col("n"), p.weight_min, p.weight_max)).alias("score"))


def bod_tight(pillars: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Benefit of the doubt with tighter bounds, where a missing pillar still takes its weight."""
    n = F.lit(float(len(p.pillars)))
    g = pillars.groupBy("entity").agg(F.collect_list(F.coalesce("score", F.lit(0.0))).alias("s"), F.count("score").alias("n"))
    pad = F.array_repeat(F.lit(0.0), F.lit(len(p.pillars)) - F.size("s"))
    return g.select("entity", F.when(F.col("n") > 0, poured(F.concat("s", pad), n, p.tight_min, p.tight_max)).alias("score"))


def bod_dual(pillars: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(entity, score): benefit of the doubt by its dual, a second way that shares nothing with ``bod``.

    Weights within [low, high] that sum to 1 reach at most level + the sum of high * (s - level) over scores above a level and of
    low * (s - level) over those below, whatever the level; the least such bound is what they reach. It is convex in the level with corners at
    the scores, so the least over the scores is exact, and any difference from ``bod`` is a gap of optimality.
    """
    g = pillars.groupBy("entity").agg(F.collect_list("score").alias("s"), F.count("score").alias("n"), F.avg("score").alias("mean"))
    pull = lambda level: lambda acc, x: acc + F.when(x > level, p.weight_max).otherwise(p.weight_min) * (x - level)
    bound = F.array_min(F.transform("s", lambda level: F.aggregate("s", level, pull(level))))
    return g.select("entity", F.when(F.col("n") * p.weight_max < 1 - 1e-9, F.col("mean")).otherwise(bound).alias("score"))


def entropy_weights(pillars: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(pillar, w): more weight where scores differ more; equal weights where none do. Missing scores count as the pillar's mean.

    An entropy lies close to 1 and is taken from it, which leaves the last places of a sum: so sums don't depend on the order of rows.
    """
    base = pillars.groupBy("pillar").agg(F.try_divide(steady_sum("score", 18), F.count("score")).alias("_m"), F.min("score").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    # One row per pillar on the other side.
    x = pillars.join(F.broadcast(base), "pillar").withColumn("x", F.coalesce("score", "_m"))
    x = x.withColumn("x", F.when(F.col("_lo") <= 0, F.col("x") - F.col("_lo") + p.floor).otherwise(F.col("x")))
    total = x.groupBy("pillar").agg(steady_sum("x", 18).alias("_t"))
    share = F.greatest(F.try_divide(F.col("x"), F.col("_t")), F.lit(p.floor))
    e = x.join(F.broadcast(total), "pillar").where("x IS NOT NULL").withColumn("q", share).groupBy("pillar").agg(
        (-steady_sum(F.col("q") * F.ln("q"), 25) / F.ln(F.max("_n").cast("double"))).alias("e")
    )
    d = e.select("pillar", (1 - F.col("e")).alias("d"))
    both = d.crossJoin(F.broadcast(d.agg(F.sum("d").alias("_all"), F.count(F.lit(1)).alias("_k"))))  # one row
    return both.select("pillar", F.when(F.col("_all") < p.floor, 1 / F.col("_k")).otherwise(F.col("d") / F.col("_all")).alias("w"))


def entropy(pillars: DataFrame, p: Params = DEFAULT) -> DataFrame:
    w = F.when(F.col("score").isNotNull(), F.col("w"))
    both = pillars.join(F.broadcast(entropy_weights(pillars, p)), "pillar")
    return both.groupBy("entity").agg(F.try_divide(F.sum(w * F.col("score")), F.sum(w)).alias("score"))


def correlation_matrix(pillars: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(n, m): complete rows and the correlations of pillars over them, row by row in one array; one row, from one aggregate.

    A pillar that doesn't vary correlates with none. ``m`` is NULL below two complete rows.
    """
    cols = list(p.pillars)
    full = wide(pillars, p).dropna(subset=cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    got = full.agg(F.count(F.lit(1)).alias("n"), *[F.stddev_pop(c).alias(c) for c in cols], *[F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs])
    of = lambda a, b: F.coalesce(F.try_divide(F.col(f"{a}_{b}"), F.col(a) * F.col(b)), F.lit(0.0))
    cells = [F.lit(1.0) if a == b else of(*((a, b) if (a, b) in pairs else (b, a))) for a in cols for b in cols]
    return got.select("n", F.when(F.col("n") >= 2, F.array(*cells)).alias("m"))


def rotated(m: Column, k: int, sweeps: int = 10) -> Column:
    """Struct (m, v) of a symmetric k x k matrix in one array: Jacobi rotations until it is diagonal, and their product."""
    at = lambda a, i, j: F.get(a, i * k + j)
    places = F.sequence(F.lit(0), F.lit(k * k - 1))
    once = lambda x, f: F.transform(F.array(x), f)[0]

    def turn(a: Column, x: Column, r: Column, rows: bool) -> Column:
        """Columns p and q (or rows) of ``a`` turned into each other."""
        def cell(c: Column) -> Column:
            i, j = (c / k).cast("int"), c % k
            here, p, q = (i if rows else j), x["p"], x["q"]
            get = lambda w: at(a, w, j) if rows else at(a, i, w)
            return F.when(here == p, r["c"] * get(p) - r["s"] * get(q)).when(here == q, r["s"] * get(p) + r["c"] * get(q)).otherwise(at(a, i, j))

        return F.transform(places, cell)

    def step(acc: Column, x: Column) -> Column:
        a, off = acc["m"], at(acc["m"], x["p"], x["q"])
        tau = (at(a, x["q"], x["q"]) - at(a, x["p"], x["p"])) / (2 * off)
        t = F.when(F.abs(off) < 1e-300, 0.0).otherwise(F.when(tau >= 0, 1.0).otherwise(-1.0) / (F.abs(tau) + F.sqrt(1 + tau * tau)))
        of = lambda t: F.struct((1 / F.sqrt(1 + t * t)).alias("c"), (t / F.sqrt(1 + t * t)).alias("s"))
        turned = lambda r: F.struct(once(turn(a, x, r, False), lambda b: turn(b, x, r, True)).alias("m"), turn(acc["v"], x, r, False).alias("v"))
        return once(once(t, of), turned)

    pairs = [F.struct(F.lit(i).alias("p"), F.lit(j).alias("q")) for i in range(k) for j in range(i + 1, k)]
    unit = F.array(*[F.lit(1.0 if i == j else 0.0) for i in range(k) for j in range(k)])
    todo = F.flatten(F.array_repeat(F.array(*pairs), sweeps))
    return F.aggregate(todo, F.struct(m.alias("m"), unit.alias("v")), step)


def eigen(pillars: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(component, eigenvalue, gap, share, loadings, n): principal components of the pillars' correlations, the largest first.

    ``gap`` is how far the next eigenvalue is below, ``loadings`` has a number for each pillar and is turned so that no
    more than half are negative. Nothing goes through the driver: one aggregate, then an expression over one row. NULLs where there are not two complete rows.
    """
    k = len(p.pillars)
    # Exploded, though it is one: an expression that others name is worked out anew for each of them, but not behind a generator.
    m = correlation_matrix(pillars, p).select("n", F.explode(F.array("m")).alias("m")).select("n", "m", F.explode(F.array(rotated(F.col("m"), k))).alias("_r"))
    places = F.sequence(F.lit(0), F.lit(k - 1))
    each = F.transform(places, lambda j: F.struct(F.get("_r.m", j * k + j).alias("eigenvalue"), F.transform(places, lambda i: F.get(F.col("_r.v"), i * k + j)).alias("v")))
    down = F.reverse(F.array_sort(F.when(F.col("m").isNotNull(), each)))
    rows = m.select("n", F.coalesce(down, F.array(F.struct(F.lit(None).cast("double").alias("eigenvalue"), F.lit(None).cast("array<double>").alias("v")))).alias("c"))
    out = rows.select("n", F.explode(F.array("c")).alias("c")).select("n", "c", F.posexplode("c").alias("i", "x"))
    negative = F.size(F.filter("x.v", lambda v: v < 0)) > k / 2
    loadings = F.when(negative, F.transform("x.v", lambda v: -v)).otherwise(F.col("x.v"))
    return out.select((F.col("i") + 1).alias("component"), "x.eigenvalue", (F.col("x.eigenvalue") - F.get("c", F.col("i") + 1)["eigenvalue"]).alias("gap"), (F.col("x.eigenvalue") / k).alias("share"), loadings.alias("loadings"), "n")


def pca_table(pillars: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(pillar, w, gap): weights from the first component's loadings, those below 0 as 0; equal ones where all are. A row a pillar."""
    first = eigen(pillars, p).where("component = 1 AND eigenvalue IS NOT NULL")
    load = first.select("gap", F.transform("loadings", lambda x: F.greatest(x, F.lit(0.0))).alias("l"))
    total = F.aggregate("l", F.lit(0.0), lambda a, x: a + x)
    w = F.when(total >= p.floor, F.transform("l", lambda x: x / total)).otherwise(F.array_repeat(F.lit(1 / len(p.pillars)), len(p.pillars)))
    names = F.array(*[F.lit(x) for x in p.pillars])
    return load.select("gap", F.posexplode(w).alias("i", "w")).select(F.get(names, F.col("i")).alias("pillar"), "w", "gap")


def pca_weights(pillars: DataFrame, p: Params = DEFAULT) -> tuple[dict[str, float], float]:
    """The rows of ``pca_table`` as a map, and the gap: for a caller on the driver, with a warning where the gap is small."""
    rows = pca_table(pillars, p).collect()
    if not rows:
        raise ValueError("no complete rows")
    if (gap := rows[0]["gap"]) < p.min_eigengap:
        warnings.warn(f"the first component is hardly larger than the second ({gap:.3f}): its weights are unstable", stacklevel=2)
    return {r["pillar"]: r["w"] for r in rows}, gap


def pca(pillars: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The first component's weights, then 0 to 100 over all entities; 50 if all score alike, NULL without two complete rows."""
    w = F.when(F.col("score").isNotNull(), F.col("w"))
    both = pillars.join(F.broadcast(kept(pca_table(pillars, p))), "pillar", "left")  # a row a pillar, written: it is followed twice
    raw = both.groupBy("entity").agg(F.try_divide(F.sum(w * F.col("score")), F.sum(w)).alias("score"))
    lim = raw.agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    s = F.when(F.col("score").isNull(), None).when(F.col("_hi") - F.col("_lo") < p.floor, 50.0).otherwise(
        (F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 100
    )
    return raw.crossJoin(F.broadcast(lim)).select("entity", s.alias("score"))


METHODS: dict[str, Callable[[DataFrame, Params], DataFrame]] = {"equal": equal, "pca": pca, "bod": bod, "entropy": entropy, "geometric": geometric}


def all_scores(pillars: DataFrame, p: Params = DEFAULT, methods=None) -> DataFrame:
    """(entity, a column per method, failed): scores side by side.

    Methods of this module are expressions that give NULL where they can't be computed; where one fails all the same, the fault is not in
    the data, and the run stops. A caller's own method (``methods``) that fails gives NULLs and doesn't stop the others: a warning says why, and
    ``failed`` names it in every row, so that its NULLs are not taken for a result. It may fail while the plan is made or when it runs, so it is run to the end
    first, written, and joined from there.
    """
    parts, failed = [], []
    for name, f in (methods or METHODS).items():
        scored = lambda: f(pillars, p).select("entity", F.col("score").cast("double").alias(name))  # noqa: B023, E731
        if f in METHODS.values():
            parts.append(scored())
            continue
        try:
            parts.append(kept(scored()))
        except Exception as e:  # noqa: BLE001
            warnings.warn(f"{name}: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", stacklevel=2)
            failed.append(name)
            parts.append(pillars.select("entity").distinct().withColumn(name, F.lit(None).cast("double")))
    return reduce(lambda a, b: a.join(b, "entity", "left"), parts).withColumn("failed", F.array(*[F.lit(x) for x in failed]).cast("array<string>"))


def ranked(scores: DataFrame, methods: list[str]) -> DataFrame:
    """Adds a competition rank per method, largest first, missing scores last."""
    return ranks_desc(scores, {f"{m}_rank": m for m in methods})


def method_weights(pillars: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(method, pillar, w) of the methods that have one set of weights; the bounds of the one that has not."""
    n = len(p.pillars)
    rows = [(m, k, 1 / n) for m in ("equal", "geometric") for k in p.pillars]
    rows += [(m, k, v) for m, v in (("bod_min", p.weight_min), ("bod_max", p.weight_max)) for k in p.pillars]
    fixed = pillars.sparkSession.createDataFrame(rows, "method string, pillar string, w double")
    return fixed.unionByName(pca_table(pillars, p).select(F.lit("pca").alias("method"), "pillar", "w")).unionByName(entropy_weights(pillars, p).select(F.lit("entropy").alias("method"), "pillar", "w"))
