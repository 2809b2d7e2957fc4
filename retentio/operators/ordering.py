"""Global ordering without a single-partition exchange.

``Window.orderBy(...)`` with no ``partitionBy`` makes Spark move every row to
one task (``Exchange SinglePartition``).  That is fine for a few hundred
aggregated rows and fatal for a subscription fact.  The operators here give
the exact ``ROW_NUMBER`` / ``NTILE`` / ``RANK`` / ``DENSE_RANK`` / running
totals of such windows while the work stays spread over the cluster:

1. ``repartitionByRange`` on (window partition, order) — ties on the order
   key are split across tasks as long as the order ends in a unique column;
2. sort inside each range and tag rows with ``monotonically_increasing_id``
   (partition id in the high bits, position in the low 33 bits);
3. freeze that numbering in a Parquet table in the checkpoint folder so a lost executor
   cannot re-sample different range bounds between the passes below;
4. count rows per (range, window partition) — at most ranges + groups rows —
   and turn the counts into offsets with a tiny window;
5. row number = offset + position − first position of the group in its range.

Weighted running totals (``running_totals``) are only ever applied to
aggregated tables (one row per distinct value), so their in-range prefix sum
uses a window partitioned by the range id, which shuffles only that table.
Tables counted at or below ``SMALL_ROWS`` take a plain window instead.

``ntile_column`` avoids moving rows at all for NTILE with few tiles: it finds
the tile boundaries from distinct-value counts and labels rows in place.
``range_count`` sizes every range shuffle from Catalyst's size estimate and
the advisory partition size, so the number of ranges grows with the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .joins import broadcast_or_merge

_LOCAL_BITS = 33
_LOCAL_MASK = (1 << _LOCAL_BITS) - 1
# Tables of at most this many rows (counted, not assumed) take a plain window:
# one task sorting a few hundred thousand rows beats three extra jobs.  Both ways
# give the same rows; the tests run them all with 0, too.
SMALL_ROWS = 200_000
# Upper bound on the ranges one ordering shuffle is cut into.
MAX_RANGES = 100_000
# ntile_column labels rows by comparing with each tile boundary up to this many tiles.
MAX_BOUNDARY_TILES = 64


def _as_sort(col: Column | str) -> Column:
    return F.col(col).asc() if isinstance(col, str) else col


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage by writing ``df`` as a Parquet table in the cluster's shared
    checkpoint folder and reading it back.

    One job computes the plan once (``Dataset.checkpoint`` runs the last
    stage twice), the files survive executor loss, and readers get column
    pruning and predicate pushdown on the frozen table.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "retentio-frozen")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30,
          "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40}


def _bytes(size: str) -> int:
    """A Spark size string ('64MB', '64m', '67108864') in bytes."""
    s = size.strip().lower()
    digits = s.rstrip("abcdefghijklmnopqrstuvwxyz")
    return int(digits) * _UNITS.get(s[len(digits):], 1)


def range_count(df: DataFrame) -> int:
    """How many ranges to cut ``df`` into: the session's shuffle partitions,
    raised so no range exceeds the advisory partition size given Catalyst's
    size estimate of ``df`` (so a 100 TB input does not land in 200 ranges)."""
    spark = df.sparkSession
    base = int(spark.conf.get("spark.sql.shuffle.partitions"))
    target_bytes = _bytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64MB"))
    unknown = _bytes(spark.conf.get("spark.sql.defaultSizeInBytes", str((1 << 63) - 1)))
    try:
        est = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 — no estimate: keep the configured count
        return base
    if est >= unknown:  # Catalyst's "size unknown" default, not a measurement
        return base
    return max(base, min(MAX_RANGES, -(-est // max(target_bytes, 1))))


def _ranged(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[Column | str],
            num_partitions: int | None) -> DataFrame:
    n = num_partitions or range_count(df)
    keys = [F.col(p).asc_nulls_first() for p in partition_by] + [_as_sort(o) for o in order_by]
    tagged = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    frozen = checkpointed(tagged)
    return frozen.select(
        "*",
        F.shiftright(F.col("_mid"), _LOCAL_BITS).alias("_pid"),
        F.col("_mid").bitwiseAND(F.lit(_LOCAL_MASK)).alias("_local"),
    ).drop("_mid")


def _join_offsets(ranged: DataFrame, offsets: DataFrame, partition_by: Sequence[str],
                  max_broadcast_rows: int) -> DataFrame:
    o = offsets
    for p in partition_by:
        o = o.withColumnRenamed(p, f"_o_{p}")
    o = o.withColumnRenamed("_pid", "_o_pid")
    cond = [ranged["_pid"] == o["_o_pid"]] + [ranged[p].eqNullSafe(o[f"_o_{p}"]) for p in partition_by]
    # Without window partitions the offsets table has one row per range: its
    # size is the range count we chose, so it is broadcast without counting.
    small = F.broadcast(o) if not partition_by else broadcast_or_merge(o, max_broadcast_rows)
    joined = ranged.join(small, cond, "inner")
    return joined.drop("_o_pid", *[f"_o_{p}" for p in partition_by])


def _is_small(df: DataFrame, small_rows: int) -> bool:
    return small_rows > 0 and df.limit(small_rows + 1).count() <= small_rows


def row_numbers(df: DataFrame, order_by: Sequence[Column | str], partition_by: Sequence[str] = (),
                rn: str = "row_number", size: str | None = None, num_partitions: int | None = None,
                max_broadcast_rows: int = 1_000_000, small_rows: int = 0) -> DataFrame:
    """``ROW_NUMBER() OVER (PARTITION BY partition_by ORDER BY order_by)``.

    ``order_by`` should end in a unique column so the numbering is
    deterministic.  With ``size`` set, also adds the row count of each window
    partition (what ``NTILE`` needs).  With ``small_rows``, a ``df`` counted at
    or below that size (pass a frozen or cheap one) is numbered by a plain
    window and frozen.
    """
    if _is_small(df, small_rows):
        w = Window.partitionBy(*partition_by).orderBy(*[_as_sort(o) for o in order_by])
        out = df.withColumn(rn, F.row_number().over(w).cast("long"))
        if size:
            out = out.withColumn(size, F.count(F.lit(1)).over(Window.partitionBy(*partition_by)))
        return checkpointed(out)
    ranged = _ranged(df, partition_by, order_by, num_partitions)
    counts = ranged.groupBy("_pid", *partition_by).agg(
        F.count(F.lit(1)).alias("_cnt"), F.min("_local").alias("_first")
    )
    before = Window.partitionBy(*partition_by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    cols = [
        "_pid", *partition_by, "_first",
        F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
    ]
    if size:
        cols.append(F.sum("_cnt").over(Window.partitionBy(*partition_by)).alias(size))
    offsets = counts.select(*cols)
    out = _join_offsets(ranged, offsets, partition_by, max_broadcast_rows)
    out = out.withColumn(rn, F.col("_off") + F.col("_local") - F.col("_first") + F.lit(1))
    return out.drop("_pid", "_local", "_first", "_off")


def running_totals(df: DataFrame, order_by: Sequence[Column | str], weights: dict[str, Column | str],
                   partition_by: Sequence[str] = (), totals: bool = True,
                   num_partitions: int | None = None, max_broadcast_rows: int = 1_000_000,
                   small_rows: int | None = None) -> DataFrame:
    """Inclusive running sums ``SUM(w) OVER (PARTITION BY p ORDER BY o ROWS UNBOUNDED PRECEDING)``.

    Meant for aggregated tables (one row per distinct value).  For each weight
    ``name`` adds ``name`` (running sum) and, with ``totals``, ``name + '_total'``
    (sum over the whole window partition).  The input is frozen first; when it
    counts at most ``small_rows`` rows a plain window finishes the job.
    """
    small_rows = SMALL_ROWS if small_rows is None else small_rows
    base = df
    for name, w in weights.items():
        base = base.withColumn(f"_w_{name}", F.col(w) if isinstance(w, str) else w)
    base = checkpointed(base)
    if _is_small(base, small_rows):
        run = (
            Window.partitionBy(*partition_by)
            .orderBy(*[_as_sort(o) for o in order_by])
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        out = base.select("*", *[F.sum(f"_w_{n}").over(run).alias(n) for n in weights])
        if totals:
            out = out.select("*", *[F.sum(f"_w_{n}").over(Window.partitionBy(*partition_by)).alias(f"{n}_total")
                                    for n in weights])
        return out.drop(*[f"_w_{n}" for n in weights])
    ranged = _ranged(base, partition_by, order_by, num_partitions)
    inner = (
        Window.partitionBy("_pid", *partition_by)
        .orderBy("_local")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = ranged.select("*", *[F.sum(f"_w_{n}").over(inner).alias(f"_c_{n}") for n in weights])
    sums = ranged.groupBy("_pid", *partition_by).agg(*[F.sum(f"_w_{n}").alias(f"_s_{n}") for n in weights])
    before = Window.partitionBy(*partition_by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*partition_by)
    cols = ["_pid", *partition_by]
    for n in weights:
        cols.append(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}"))
        if totals:
            cols.append(F.sum(f"_s_{n}").over(whole).alias(f"{n}_total"))
    offsets = sums.select(*cols)
    out = _join_offsets(local, offsets, partition_by, max_broadcast_rows)
    for n in weights:
        out = out.withColumn(n, F.col(f"_o_{n}") + F.col(f"_c_{n}"))
    drop = ["_pid", "_local"] + [f"_{k}_{n}" for n in weights for k in ("w", "c", "o")]
    return out.drop(*drop)


def ntile(rn: Column | str, size: Column | str, buckets: int) -> Column:
    """``NTILE(buckets)`` from a 1-based row number and the partition size.

    With b = size div buckets and r = size mod buckets the first r tiles hold
    b + 1 rows, the rest b rows.
    """
    from ..functions.rounding import idiv

    rn = F.col(rn) if isinstance(rn, str) else rn
    size = F.col(size) if isinstance(size, str) else size
    k = F.lit(buckets)
    b = idiv(size, k)
    r = size - b * k
    big = r * (b + 1)
    first = idiv(rn - 1, b + 1) + 1
    rest = r + idiv(rn - 1 - big, F.greatest(b, F.lit(1))) + 1
    return F.when(rn <= big, first).otherwise(rest).cast("int")


def ranks(df: DataFrame, order_col: str, descending: bool = True, partition_by: Sequence[str] = (),
          rank: str | None = "rank", dense_rank: str | None = "dense_rank",
          max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """``RANK`` / ``DENSE_RANK`` over one order column, via its distinct values.

    Rows are first reduced to (partition, value, count) with a map-side
    combine, so a value held by a third of all rows is one row here.  The
    ranks are computed on that table and joined back; the join broadcasts the
    rank table only when its counted size is under ``max_broadcast_rows``.
    """
    values = df.groupBy(*partition_by, order_col).agg(F.count(F.lit(1)).alias("_n"))
    key = F.col(order_col).desc_nulls_last() if descending else F.col(order_col).asc_nulls_first()
    ranked = running_totals(values, [key], {"_cum": "_n", "_one": F.lit(1)}, partition_by, totals=False)
    select = [*partition_by, order_col]
    if rank:
        select.append((F.col("_cum") - F.col("_n") + 1).cast("int").alias(rank))
    if dense_rank:
        select.append(F.col("_one").cast("int").alias(dense_rank))
    table = ranked.select(*select)
    on = [*partition_by, order_col]
    t = table
    for c in on:
        t = t.withColumnRenamed(c, f"_r_{c}")
    cond = [df[c].eqNullSafe(t[f"_r_{c}"]) for c in on]
    return df.join(broadcast_or_merge(t, max_broadcast_rows), cond, "inner").drop(*[f"_r_{c}" for c in on])


def ntile_column(df: DataFrame, value_col: str, tiebreak_col: str, buckets: int, name: str = "ntile",
                 descending: bool = True) -> DataFrame:
    """``NTILE(buckets) OVER (ORDER BY value_col [DESC], tiebreak_col)`` without
    moving the rows.

    Tile t ends at row L_t = t·b + min(t, r) (b = n div buckets, r = n mod
    buckets).  The value holding each L_t comes from the distinct-value counts
    and their running totals; where that value's tie group straddles L_t, only
    the rows of that group are numbered by ``tiebreak_col`` to find the last
    row of the tile.  The resulting ≤ buckets − 1 boundaries reach every task
    as one scalar subquery (their count is fixed by ``buckets``) and each
    row's tile is one plus the number of boundaries it comes after — a narrow
    projection.  ``value_col``
    must be non-null and ``tiebreak_col`` unique.  Beyond ``MAX_BOUNDARY_TILES``
    tiles the per-row comparisons stop paying off and the rows are numbered
    with ``row_numbers`` instead.
    """
    order = F.col(value_col).desc() if descending else F.col(value_col).asc()
    if buckets > MAX_BOUNDARY_TILES:
        numbered = row_numbers(df, [order, F.col(tiebreak_col).asc()], rn="_rn", size="_size")
        return numbered.withColumn(name, ntile("_rn", "_size", buckets)).drop("_rn", "_size")
    values = df.groupBy(value_col).agg(F.count(F.lit(1)).alias("_cnt"))
    cum = running_totals(values, [order], {"_cum": "_cnt"})
    n = F.col("_cum_total")
    k = F.lit(buckets)
    b = (n - F.pmod(n, k)) / k
    t = F.col("_t")
    last = (t * b + F.least(t, F.pmod(n, k))).cast("long")  # last row of tile t
    start = F.col("_cum") - F.col("_cnt")
    bounds = (
        cum.withColumn("_t", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(buckets - 1).cast("long"))))
        .where((start < last) & (last <= F.col("_cum")))
        .select("_t", F.col(value_col).alias("_bv"), (last - start).alias("_j"), "_cnt")
    )
    bounds = checkpointed(bounds)  # at most buckets - 1 rows
    straddle = bounds.where(F.col("_j") < F.col("_cnt"))
    groups = checkpointed(df.select(value_col, tiebreak_col).join(
        F.broadcast(straddle.select(F.col("_bv").alias(value_col)).distinct()), value_col
    ))
    numbered = row_numbers(groups, [F.col(tiebreak_col).asc()], partition_by=[value_col], rn="_rn",
                           small_rows=SMALL_ROWS)
    ids = numbered.join(
        F.broadcast(straddle.select(F.col("_bv").alias(value_col), F.col("_j").alias("_rn"), "_t")),
        [value_col, "_rn"],
    ).select("_t", F.col(tiebreak_col).alias("_bid"))
    # ≤ buckets − 1 boundaries as one array-valued scalar subquery
    table = bounds.join(ids, "_t", "left").agg(
        F.collect_list(F.struct(F.col("_bv").alias("v"), F.col("_bid").alias("id")))
    ).scalar()

    v, tb = F.col(value_col), F.col(tiebreak_col)

    def after(x: Column) -> Column:
        later = (v < x["v"]) if descending else (v > x["v"])
        # a boundary at the end of its tie group (id NULL) puts the whole group before it
        return later | ((v == x["v"]) & x["id"].isNotNull() & (tb > x["id"]))

    # one comparison per boundary (a fixed, small number); get() is NULL past the end
    tile = F.lit(1)
    for i in range(buckets - 1):
        x = F.get(table, i)
        tile = tile + F.when(x.isNotNull() & after(x), 1).otherwise(0)
    return df.withColumn(name, tile.cast("int"))
