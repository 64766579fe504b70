"""Order-dependent primitives that survive hot keys.

A plain ``Window.partitionBy(user)`` sends one user's whole history to one task. These
helpers scan (key, time block) groups instead and carry a one-row summary per block
across the blocks of a key, so a key that holds a third of all rows still spreads over
the cluster. Results equal the plain window exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_SECONDS = 6 * 3600


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """First k rows per key. The literal bound lets Spark cut each map task's rows to k
    per key before the shuffle (WindowGroupLimit), so hot keys do not travel whole."""
    name = rank or "_rank"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def _block(ts: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


def _carry(df: DataFrame, keys: list[str], summary: Column, forward: bool) -> DataFrame:
    """One summary value per (key, block), moved to the next (or previous) block."""
    order = F.col("_block").asc() if forward else F.col("_block").desc()
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.groupBy(*keys, "_block")
        .agg(summary.alias("_summary"))
        .withColumn("_carry", F.last("_summary", ignorenulls=True).over(w))
        .drop("_summary")
    )


def neighbour(df: DataFrame, keys: list[str], ts: str, tie: str, value: Column, name: str,
              forward: bool = False, block_seconds: int = BLOCK_SECONDS, block: str | None = None) -> DataFrame:
    """``lag`` (or ``lead`` when forward) of ``value`` in (ts, tie) order per key; ``block`` as for `running`."""
    order = [F.col(ts), F.col(tie)]
    marked = df.withColumn("_block", _block(ts, block_seconds) if block is None else F.col(block)).withColumn("_value", F.struct(value.alias("v")))
    picker = F.min_by if forward else F.max_by
    carry = _carry(marked, keys, picker("_value", F.struct(*order)), forward=not forward)
    w = Window.partitionBy(*keys, "_block").orderBy(*order)
    inside = (F.lead if forward else F.lag)("_value").over(w)
    return (
        marked.withColumn("_inside", inside)
        .join(carry, [*keys, "_block"], "left")
        .withColumn(name, F.coalesce("_inside", "_carry").getField("v"))
        .drop("_block", "_value", "_inside", "_carry")
    )


def last_before(df: DataFrame, keys: list[str], ts: str, tie: str, value: Column, name: str,
                inclusive: bool = True, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Latest non-null ``value`` at (or strictly before) each row per key."""
    order = [F.col(ts), F.col(tie)]
    marked = df.withColumn("_block", _block(ts, block_seconds)).withColumn("_value", value)
    seen = F.when(F.col("_value").isNotNull(), F.struct(*order))
    carry = _carry(marked, keys, F.max_by("_value", seen), forward=True)
    w = Window.partitionBy(*keys, "_block").orderBy(*order)
    frame = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return (
        marked.withColumn("_inside", F.last("_value", ignorenulls=True).over(frame))
        .join(carry, [*keys, "_block"], "left")
        .withColumn(name, F.coalesce("_inside", "_carry"))
        .drop("_block", "_value", "_inside", "_carry")
    )


def running_sum(df: DataFrame, keys: list[str], ts: str, tie: str, value: Column, name: str,
                inclusive: bool = False, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Prefix sum of ``value`` in (ts, tie) order per key (0.0 before the first row)."""
    order = [F.col(ts), F.col(tie)]
    marked = df.withColumn("_block", _block(ts, block_seconds)).withColumn("_value", value)
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        marked.groupBy(*keys, "_block")
        .agg(F.sum("_value").alias("_summary"))
        .withColumn("_carry", F.coalesce(F.sum("_summary").over(across), F.lit(0.0)))
        .drop("_summary")
    )
    w = Window.partitionBy(*keys, "_block").orderBy(*order)
    frame = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return (
        marked.withColumn("_inside", F.coalesce(F.sum("_value").over(frame), F.lit(0.0)))
        .join(carry, [*keys, "_block"], "left")
        .withColumn(name, F.col("_inside") + F.col("_carry"))
        .drop("_block", "_value", "_inside", "_carry")
    )


def global_position(df: DataFrame, order_key: Column, id_col: str, name: str = "position") -> DataFrame:
    """1-based position of every row in the order of a uniform hex hash, without one task
    sorting the table: rows are numbered inside the 4096 buckets of the hash's first
    three digits, and bucket offsets (4096 rows) are added."""
    keyed = df.withColumn("_key", order_key).withColumn("_bucket", F.substring("_key", 1, 3))
    offsets = keyed.groupBy("_bucket").agg(F.count("*").alias("_n")).withColumn(
        "_offset",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    )
    w = Window.partitionBy("_bucket").orderBy("_key", id_col)
    return (
        keyed.withColumn("_inside", F.row_number().over(w))
        .join(offsets.drop("_n"), "_bucket")
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_key", "_bucket", "_inside", "_offset")
    )


def kth_smallest(df: DataFrame, value: str, index: Column, name: str) -> DataFrame:
    """Exact order statistic of a non-negative long column as a one-row frame.

    ``index`` (0-based) may use the aggregate ``n``, the number of rows. Two histograms
    narrow the value down (high digits, then low digits), so no task ever holds or sorts
    the values themselves. Empty input gives no rows.
    """
    step = 1 << 20
    digits = df.select((F.col(value) / step).cast("long").alias("hi"), (F.col(value) % step).alias("lo"))
    total = digits.agg(F.count("*").alias("n")).select(index.cast("long").alias("k"))
    before = Window.orderBy("hi").rowsBetween(Window.unboundedPreceding, -1)
    high = (
        digits.groupBy("hi").agg(F.count("*").alias("c"))
        .withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
        .filter((F.col("before") <= total.scalar()) & (total.scalar() < F.col("before") + F.col("c")))
    )
    rest = Window.orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    low = (
        digits.join(F.broadcast(high.select("hi", "before")), "hi")
        .groupBy("hi", "before", "lo").agg(F.count("*").alias("c"))
        .withColumn("below", F.col("before") + F.coalesce(F.sum("c").over(rest), F.lit(0)))
        .filter((F.col("below") <= total.scalar()) & (total.scalar() < F.col("below") + F.col("c")))
    )
    return low.select((F.col("hi") * step + F.col("lo")).alias(name))


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], ts: str, start: str, end: str,
                  bucket_seconds: int = 86400, how: str = "inner") -> DataFrame:
    """Points inside closed intervals of the same key, as an equi join on time buckets.

    Each span is repeated once per bucket it touches; a point sits in one bucket, so no
    pair is met twice.
    """
    size = F.lit(bucket_seconds * 1_000_000)
    cells = F.sequence(F.floor(F.unix_micros(start) / size), F.floor(F.unix_micros(end) / size))
    left = points.withColumn("_cell", F.floor(F.unix_micros(ts) / size))
    right = spans.withColumn("_cell", F.explode(cells))
    on = [left[k] == right[k] for k in [*keys, "_cell"]] + [left[ts] >= right[start], left[ts] <= right[end]]
    joined = left.join(right, on, how)
    for k in [*keys, "_cell"]:
        joined = joined.drop(right[k]) if how not in ("left_semi", "left_anti") else joined
    return joined.drop("_cell")


def running(df: DataFrame, keys: list[str], ts: str, tie: str, aggs: dict[str, str], inclusive: bool = False,
            block_seconds: int = BLOCK_SECONDS, block: str | None = None) -> DataFrame:
    """Several running aggregates at once: ``aggs`` maps an output name to ``sum(expr)`` or
    ``max(expr)``, taken over the rows before (and with ``inclusive`` up to) each row per key.
    Null where no row counts. Block-wise like the functions above; ``block`` names a column of blocks that grow with
    (ts, tie), for keys whose rows lie so far apart that blocks of time would hold one row each."""
    columns = df.columns
    merge = {n: a[:3].lower() for n, a in aggs.items()}
    over_blocks = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY _block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    inside = f"OVER (PARTITION BY {', '.join([*keys, '_block'])} ORDER BY {ts}, {tie} ROWS BETWEEN UNBOUNDED PRECEDING AND {'CURRENT ROW' if inclusive else '1 PRECEDING'})"
    marked = df.withColumn("_block", _block(ts, block_seconds) if block is None else F.col(block))
    carry = marked.groupBy(*keys, "_block").agg(*[F.expr(f"{a} AS _s_{n}") for n, a in aggs.items()])
    carry = carry.selectExpr(*keys, "_block", *[f"{m}(_s_{n}) {over_blocks} AS _c_{n}" for n, m in merge.items()])
    local = marked.selectExpr(*columns, "_block", *[f"{a} {inside} AS _i_{n}" for n, a in aggs.items()])
    both = {
        n: (f"greatest(_i_{n}, _c_{n})" if m == "max" else f"coalesce(_i_{n} + _c_{n}, _i_{n}, _c_{n})") for n, m in merge.items()
    }
    return local.join(carry, [*keys, "_block"], "left").selectExpr(*columns, *[f"{e} AS {n}" for n, e in both.items()])
