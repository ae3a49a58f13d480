"""Exact ranks and quantiles over whole tables, without one big sort in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from pulseframe.functions.scalar import finite_or_null
from pulseframe.session import cut_lineage


def global_row_number(df: DataFrame, order: tuple[str, ...], name: str = "row_number") -> DataFrame:
    """Number all rows 1..n in the given (unique) order.

    Rows are range partitioned and sorted in parallel; a partition's first number
    is the sum of the sizes of the ones before it.  The sorted table is written
    once so that both passes see the same partitions.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_at", F.monotonically_increasing_id())
    ranged = cut_lineage(ranged)
    part = F.shiftright("_at", 33)
    sizes = ranged.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per shuffle partition: a bounded side.
    starts = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_start"))
    local = F.col("_at") - F.shiftleft(F.col("_p"), 33)
    return (ranged.withColumn("_p", part).join(F.broadcast(starts), "_p")
            .withColumn(name, F.col("_start") + local + 1).drop("_p", "_at", "_start"))


# Groups up to this number are broadcast, more are joined.
BROADCAST_GROUPS = 10_000


def smallest_per_group(df: DataFrame, keys: list[str], order: str, tie: str, n: int, buckets: int = 1024,
                       domain: int | None = None, edge_rows: int = 20_000) -> DataFrame:
    """The ``n`` rows with the smallest ``order`` (an integer in [0, domain)) per group.

    A histogram of the order column tells which rows fit whole and which interval crosses
    ``n``.  That interval is divided again until it holds at most ``edge_rows`` rows or one value of
    ``order``; only its rows are ranked, so no group is ever sorted in one task.  Exact
    for any distribution.  ``domain`` is by default that of ``selection.mix``.
    """
    if domain is None:
        from pulseframe.operators.selection import MIX_DOMAIN
        domain = MIX_DOMAIN
    named = {c: f"_p_{c}" for c in keys}

    def beside(rows: DataFrame, plan: DataFrame) -> DataFrame:
        on = [F.col(c).eqNullSafe(F.col(p)) for c, p in named.items()] or F.lit(True)
        # A few large groups would meet in as few tasks; without keys the plan is one row.
        return rows.join(F.broadcast(plan) if few else plan, on, "inner")

    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumnsRenamed(named)
    plan = cut_lineage(counts.select(*named.values(), F.lit(0).cast("long").alias("_lo"), F.lit(domain).cast("long").alias("_hi"),
                                     F.lit(0).cast("long").alias("_before"), "_n"))
    few = not keys or plan.count() <= BROADCAST_GROUPS
    crossing = (F.col("_before") + F.col("_n") > n) & (F.col("_n") > edge_rows) & (F.col("_hi") - F.col("_lo") > 1)
    while not plan.where(crossing).isEmpty():
        wide = F.expr(f"(_hi - _lo + {buckets - 1}) div {buckets}")
        todo = plan.where(crossing).withColumn("_w", wide)
        hist = (beside(df.select(*keys, order), todo).where((F.col(order) >= F.col("_lo")) & (F.col(order) < F.col("_hi")))
                .groupBy(*named.values(), "_lo", "_hi", "_before", "_w", F.expr(f"({order} - _lo) div _w").alias("_s"))
                .agg(F.count(F.lit(1)).alias("_c")))
        # At most ``buckets`` rows a group.
        run = F.sum("_c").over(Window.partitionBy(*named.values()).orderBy("_s")) if keys else F.sum("_c").over(Window.orderBy("_s"))
        low = F.col("_lo") + F.col("_s") * F.col("_w")
        found = (hist.withColumn("_b", F.col("_before") + run - F.col("_c")).where((F.col("_b") < n) & (F.col("_b") + F.col("_c") >= n))
                 .select(*named.values(), low.alias("_lo"), F.least(low + F.col("_w"), F.col("_hi")).alias("_hi"), F.col("_b").alias("_before"), F.col("_c").alias("_n")))
        plan = cut_lineage(plan.where(~crossing).unionByName(found))
    joined = beside(df, plan).drop(*named.values())
    whole = joined.where((F.col(order) < F.col("_lo")) | ((F.col(order) < F.col("_hi")) & (F.col("_before") + F.col("_n") <= n)))
    edge = joined.where((F.col(order) >= F.col("_lo")) & (F.col(order) < F.col("_hi")) & (F.col("_before") + F.col("_n") > n))
    rank = F.row_number().over(Window.partitionBy(*keys, "_lo").orderBy(order, tie))
    edge = edge.withColumn("_r", rank).where(F.col("_before") + F.col("_r") <= n).drop("_r")
    return whole.unionByName(edge).drop("_lo", "_hi", "_before", "_n")


def systematic_sample(df: DataFrame, size: int, order: tuple[str, ...] = ("point_id",)) -> DataFrame:
    """Rows at ordinals ``floor(i (n-1) / (size-1))``; the middle row for size one; all rows if few."""
    if size < 1:
        raise ValueError("sample size must be positive")
    ranked = global_row_number(df, order)
    n = ranked.count()
    if n <= size:
        return ranked.drop("row_number")
    if size == 1:
        return ranked.where(F.col("row_number") - 1 == (n - 1) // 2).drop("row_number")
    # Ordinal t is a target iff some i satisfies floor(i (n-1) / (size-1)) = t:
    # take the smallest i with i (n-1) >= t (size-1) and test it.
    i = f"(((row_number - 1) * {size - 1} + {n - 2}) div {n - 1})"
    return ranked.where(F.expr(f"({i} * {n - 1}) div {size - 1} = row_number - 1")).drop("row_number")


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float], *, method: str = "linear",
                    buckets: int = 256, small: int = 20_000) -> DataFrame:
    """Exact quantiles of whole columns: ``field, valid, q0, q1, ...`` (missing values skipped)."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("f"), finite_or_null(c).alias("v")) for i, c in enumerate(columns)])).alias("s")
    ).select("s.f", "s.v").where(F.col("v").isNotNull())
    found = quantiles_of(long, probabilities, method=method, buckets=buckets, small=small)
    none = (0, *[None] * len(probabilities))
    fields = [T.StructField("field", T.StringType()), T.StructField("valid", T.LongType())]
    fields += [T.StructField(f"q{i}", T.DoubleType()) for i in range(len(probabilities))]
    return df.sparkSession.createDataFrame([(name, *found.get(f, none)) for f, name in enumerate(columns)], T.StructType(fields))


def quantiles_of(long: DataFrame, probabilities: list[float], *, method: str = "linear", buckets: int = 256,
                 small: int = 20_000) -> dict[int, tuple]:
    """Exact quantiles of the values ``v`` of each series ``f`` of ``long(f int, v double)``: count and values.

    ``linear`` interpolates at ``p (n-1)``; ``nearest`` takes the value at
    ``round(p (n-1))``.  Each pass counts values in equal-width buckets of the
    intervals that still hold a wanted rank and narrows them; only counts reach
    the driver, until an interval holds few values or one.  The values are written once, so that
    passes don't compute them again.
    """
    spark = long.sparkSession
    long = cut_lineage(long)
    head = {r.f: r for r in long.groupBy("f").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    ranks: dict[int, set[int]] = {}
    for f, row in head.items():
        for p in probabilities:
            at = p * (row.n - 1)
            ranks.setdefault(f, set()).update(
                {math.floor(at), math.ceil(at)} if method == "linear" else {math.floor(at + 0.5)})
    # interval: (field, low, high) -> (rows below it, rows in it, wanted ranks)
    open_ = {(f, row.lo, row.hi): (0, row.n, sorted(ranks[f])) for f, row in head.items()}
    value: dict[tuple[int, int], float] = {}
    schema = T.StructType([T.StructField("f", T.IntegerType()), T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType())])
    while True:
        for key in [k for k in open_ if k[1] == k[2]]:
            _, _, wanted = open_.pop(key)
            value.update({(key[0], r): key[1] for r in wanted})
        if not open_:
            break
        spans = spark.createDataFrame([(f, a, b) for f, a, b in open_], schema)
        hits = long.join(F.broadcast(spans), (long.f == spans.f) & long.v.between(spans.a, spans.b)).select(long.f, "a", "b", "v")
        tiny = {k for k, (_, n, _) in open_.items() if n <= small}
        if tiny and sum(open_[k][1] for k in tiny) <= 50 * small:
            listed = spark.createDataFrame(list(tiny), schema)
            few = hits.join(F.broadcast(listed), ["f", "a", "b"]).groupBy("f", "a", "b").agg(F.array_sort(F.collect_list("v")).alias("vs"))
            for row in few.collect():
                below, _, wanted = open_.pop((row.f, row.a, row.b))
                value.update({(row.f, r): row.vs[r - below] for r in wanted})
            continue
        slot = F.least(F.lit(buckets - 1), F.floor((F.col("v") - F.col("a")) / (F.col("b") - F.col("a")) * buckets).cast("int"))
        rows = hits.groupBy("f", "a", "b", slot.alias("s")).agg(
            F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        nxt = {}
        for key, (below, _, wanted) in open_.items():
            for row in sorted((r for r in rows if (r.f, r.a, r.b) == key), key=lambda r: r.s):
                inside = [r for r in wanted if below <= r < below + row.n]
                if inside:
                    nxt[(row.f, row.lo, row.hi)] = (below, row.n, inside)
                below += row.n
        open_ = nxt
    out = {}
    for f in head:
        n, cells = head[f].n, []
        for p in probabilities:
            at = p * (n - 1)
            if method == "linear":
                a, b = value[f, math.floor(at)], value[f, math.ceil(at)]
                cells.append(a + (at - math.floor(at)) * (b - a))
            else:
                cells.append(value[f, math.floor(at + 0.5)])
        out[f] = (n, *cells)
    return out
