"""Running values, exact ranks and exact order statistics that stay parallel
when one group holds a large share of all rows.

A plain window puts a whole group into one task. Here a group is first cut
into chunks that follow the order; the window runs inside a chunk, and the
small table of chunk totals supplies what came before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialyst.session import stored

_RESERVED = "__chunk"


def ranged(df: DataFrame, order: list[str], chunk: str = _RESERVED) -> DataFrame:
    """The rows kept in the shared folder with a chunk number that follows a
    total order. Spark samples the order and cuts it into as many chunks as
    there are shuffle partitions, of about equal row counts, so one group may
    have many. The chunks are written once, as another run of the
    sampling could cut elsewhere."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(parts, *order).withColumn(chunk, F.spark_partition_id()), "chunks")


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    measures: dict[str, tuple[str, Column]],
    chunk: Column | None = None,
) -> DataFrame:
    """Add running values up to and including each row.

    ``measures`` maps an output name to (kind, expression); kind is ``sum``,
    ``max``, ``count``, ``last`` (latest non-null), ``before`` (latest non-null
    of earlier rows), ``earlier`` (array of all non-null values of earlier rows, in their order) or ``prev`` (the value of the row before). Order columns must be total. Without ``keys`` all rows are
    one group. By default the chunks are cut by ``ranged``, which writes the rows once; a ``chunk``
    expression that does not decrease along ``order`` inside a group saves that.
    """
    base = df
    for name, (kind, expr) in measures.items():
        base = base.withColumn(f"__m_{name}", F.lit(1) if kind == "count" else expr)
    base = ranged(base, [*keys, *order]) if chunk is None else base.withColumn(_RESERVED, chunk)
    inner = (
        Window.partitionBy(*keys, _RESERVED)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    position = F.struct(*[F.col(c) for c in order])
    totals, local = [], base
    for name, (kind, _) in measures.items():
        m = F.col(f"__m_{name}")
        if kind in ("sum", "count"):
            totals.append(F.sum(m).alias(f"__t_{name}"))
            local = local.withColumn(f"__l_{name}", F.sum(m).over(inner))
        elif kind == "max":
            totals.append(F.max(m).alias(f"__t_{name}"))
            local = local.withColumn(f"__l_{name}", F.max(m).over(inner))
        elif kind == "last":
            totals.append(F.max_by(m, F.when(m.isNotNull(), position)).alias(f"__t_{name}"))
            local = local.withColumn(f"__l_{name}", F.last(m, ignorenulls=True).over(inner))
        elif kind == "before":
            totals.append(F.max_by(m, F.when(m.isNotNull(), position)).alias(f"__t_{name}"))
            local = local.withColumn(f"__l_{name}", F.last(m, ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, -1)))
        elif kind == "earlier":
            known = F.array_sort(F.collect_list(F.when(m.isNotNull(), F.struct(position.alias("at"), m.alias("v")))))
            totals.append(F.transform(known, lambda x: x["v"]).alias(f"__t_{name}"))
            local = local.withColumn(f"__l_{name}", F.collect_list(m).over(inner.rowsBetween(Window.unboundedPreceding, -1)))
        elif kind == "prev":
            step = Window.partitionBy(*keys, _RESERVED).orderBy(*order)
            totals.append(F.max_by(F.struct(m.alias("v")), position).alias(f"__t_{name}"))
            local = local.withColumn(f"__l_{name}", F.lag(F.struct(m.alias("v"))).over(step))
        else:
            raise ValueError(f"unknown running measure {kind!r}")
    chunk_totals = base.groupBy(*keys, _RESERVED).agg(*totals)
    before = (
        Window.partitionBy(*keys).orderBy(_RESERVED).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = chunk_totals
    for name, (kind, _) in measures.items():
        t = F.col(f"__t_{name}")
        fold = {
            "sum": F.sum(t),
            "count": F.sum(t),
            "max": F.max(t),
            "last": F.last(t, ignorenulls=True),
            "before": F.last(t, ignorenulls=True),
            "earlier": F.collect_list(t),
            "prev": F.last(t),
        }[kind].over(before)
        offsets = offsets.withColumn(f"__o_{name}", F.flatten(fold) if kind == "earlier" else fold)
    offsets = offsets.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col(_RESERVED).alias("__k_chunk"),
        *[f"__o_{n}" for n in measures],
    )
    on = F.col(_RESERVED).eqNullSafe(F.col("__k_chunk"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = local.join(offsets, on, "left")
    out = [F.col(c) for c in df.columns]
    for name, (kind, _) in measures.items():
        here, prior = F.col(f"__l_{name}"), F.col(f"__o_{name}")
        if kind in ("sum", "count"):
            value = F.coalesce(here, F.lit(0)) + F.coalesce(prior, F.lit(0))
        elif kind == "max":
            value = F.greatest(here, prior)
        elif kind == "prev":
            value = F.coalesce(here, prior)["v"]
        elif kind == "earlier":
            value = F.concat(prior, here)
        else:
            value = F.coalesce(here, prior)
        out.append(value.alias(name))
    return joined.select(*out)


def histogram(df: DataFrame, keys: list[str], rank: Column, width_bits: int = 32) -> DataFrame:
    """Rows of each group by the upper 16 bits of their rank: (keys, __bucket, __n), at
    most 65,536 rows per group, kept in the shared folder."""
    bucket = F.shiftright(rank, max(width_bits - 16, 0)).alias("__bucket")
    return stored(df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("__n")), "histogram")


def last_by_rank(
    df: DataFrame,
    keys: list[str],
    rank: Column,
    tie: list[str],
    quota: DataFrame,
    quota_col: str = "n_take",
    width_bits: int = 32,
    hist: DataFrame | None = None,
) -> DataFrame:
    """(keys, __last): the last row, as struct(rank, tie), of the first ``quota_col`` rows of each group
    with a positive quota; null for groups that have no more rows than that.

    ``rank`` is a whole number below 2^width_bits. A histogram finds the bucket
    where the quota runs out, and the rows of that bucket are counted through in
    range partitions, so it may hold any share of the group."""
    hist = histogram(df, keys, rank, width_bits) if hist is None else hist
    w = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
    wanted = quota.select(*keys, quota_col).filter(F.col(quota_col) > 0)
    cut = (
        hist.withColumn("__cum", F.sum("__n").over(w))
        .join(wanted, keys)
        .filter(F.col("__cum") >= F.col(quota_col))
        .groupBy(*keys)
        .agg(F.min(F.struct("__bucket", (F.col(quota_col) - F.col("__cum") + F.col("__n")).alias("left"))).alias("c"))
        .select(*keys, F.col("c.__bucket").alias("__cut"), F.col("c.left").alias("__left"))
    )
    ranked = df.select(*dict.fromkeys([*keys, *tie]), rank.alias("__rank"))
    edge = ranked.join(cut, keys).filter(F.shiftright("__rank", max(width_bits - 16, 0)) == F.col("__cut"))
    counted = running(edge, keys, ["__rank", *tie], {"__seen": ("count", F.lit(1))})
    last = counted.filter(F.col("__seen") == F.col("__left")).select(*keys, F.struct("__rank", *tie).alias("__last"))
    return wanted.select(*keys).join(last, keys, "left")


def take_by_rank(
    df: DataFrame,
    keys: list[str],
    rank: Column,
    tie: list[str],
    quota: DataFrame,
    quota_col: str = "n_take",
    width_bits: int = 32,
    hist: DataFrame | None = None,
) -> DataFrame:
    """Exactly the first ``quota_col`` rows of each group by (rank, tie), which
    is a total order: the rows up to the last one, in one more pass. The table of last rows has one row per group; Spark
    broadcasts it where that is small."""
    last = stored(last_by_rank(df, keys, rank, tie, quota, quota_col, width_bits, hist), "last")
    placed = df.withColumn("__at", F.struct(rank.alias("__rank"), *tie)).join(last, keys)
    return placed.filter(F.col("__last").isNull() | (F.col("__at") <= F.col("__last"))).select(*df.columns)


def order_statistic(
    df: DataFrame,
    keys: list[str],
    value: str,
    index: Column,
    out: str,
    parts: int = 256,
) -> DataFrame:
    """The value at a 0-based index of each group's ascending order, exactly.

    ``index`` may use the group's row count ``__n``. One aggregate sketches the
    quantiles of each group; their rank error is far below 1 / ``parts``, so
    the value lies between the neighbours of the index's own part, whatever the
    values' spread. Only values in between are ordered, those below are counted.
    """
    known = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    sketch = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        F.percentile_approx("__v", [i / parts for i in range(parts + 1)], 100 * parts).alias("__edges"),
        F.min("__v").alias("__min"),
        F.max("__v").alias("__max"),
    ).withColumn("__ix", index)
    part = F.floor(F.col("__ix") * parts / F.col("__n")).cast("int")
    # edges are counted from 1: part i lies between edges i + 1 and i + 2
    bounds = sketch.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], "__ix",
        F.when(part < 1, F.col("__min")).otherwise(F.try_element_at("__edges", part)).alias("__lo"),
        F.when(part >= parts - 2, F.col("__max")).otherwise(F.try_element_at("__edges", part + 3)).alias("__hi"),
    ).filter((F.col("__ix") >= 0) & F.col("__lo").isNotNull())
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    near = known.join(bounds, on).filter(F.col("__v") <= F.col("__hi"))
    # all values below the bounds share one row
    counts = near.groupBy(*keys, F.when(F.col("__v") >= F.col("__lo"), F.col("__v")).alias("__at")).agg(
        F.count(F.lit(1)).alias("__c"), F.first("__ix").alias("__ix")
    )
    fine = Window.partitionBy(*keys).orderBy(F.col("__at").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.withColumn("__cum", F.sum("__c").over(fine))
        .filter((F.col("__cum") > F.col("__ix")) & F.col("__at").isNotNull())
        .groupBy(*keys)
        .agg(F.min("__at").alias(out))
    )


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by a total order. The rank limit is applied
    before the shuffle as well, so a hot key sends one row per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")
