"""Group logic that stays distributed when one group holds much of the data.

A plain window puts every row of a group into one task. The helpers here work
on partial aggregates instead, or cut a group into blocks first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockweave.sources.staging import stage

SALTS = 8
BLOCK_ROWS = 100_000
#: Blocks that one window over block summaries sees.
FAN = 1_000
#: From this offset on a page is cut out of a sorted table instead of sorting up to it in one task.
DEEP = 10_000


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which NULL keys match NULL keys; right keys are dropped."""
    named = right
    for key in keys:
        named = named.withColumnRenamed(key, f"_r_{key}")
    condition = None
    for key in keys:
        test = left[key].eqNullSafe(named[f"_r_{key}"])
        condition = test if condition is None else condition & test
    return left.join(named, condition, how).drop(*[f"_r_{key}" for key in keys])


def attach_group(
    rows: DataFrame,
    keys: Sequence[str],
    measures: dict[str, Column],
    row_id: Sequence[str],
    having: Column | None = None,
    salts: int = SALTS,
    source: DataFrame | None = None,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Rows with the aggregates of their group attached.

    The aggregates are combined map-side. ``having`` drops groups that need no
    attaching (their rows get NULL). Rows of one key are spread over ``salts``
    join partitions; rows with a NULL key match no group and are spread freely.
    A small group table is broadcast by the optimizer, then no row moves; that
    it is small is known in time only if ``keep`` (:func:`staging.stage`) stores
    it first. ``source`` gives the aggregates when ``rows`` is a longer plan over it.
    """
    stats = (rows if source is None else source).groupBy(*keys).agg(*[measure.alias(name) for name, measure in measures.items()])
    for key in keys:
        stats = stats.filter(F.col(key).isNotNull())
    if having is not None:
        stats = stats.filter(having)
    if keep:
        stats = keep(stats)
    stats = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn(
        "_salt", F.col("_salt").cast("bigint")
    )
    any_null = F.lit(False)
    for key in keys:
        any_null = any_null | F.col(key).isNull()
    spread = F.xxhash64(*row_id)
    salted = rows.withColumn("_salt", F.when(any_null, spread).otherwise(F.pmod(spread, F.lit(salts))))
    return salted.join(stats, [*keys, "_salt"], "left").drop("_salt")


def _blocks(rows: DataFrame, order: str, block_rows: int) -> DataFrame:
    return rows.withColumn("_block", F.floor(F.col(order) / F.lit(block_rows)).cast("bigint"))


def _scan_blocks(ends: DataFrame, keys: Sequence[str], columns: dict[str, str], ahead: bool) -> DataFrame:
    """Per (group, block) what earlier blocks end with, or what the next block begins with.

    ``columns``: value column -> result name. A prefix scan as a tree: inside a
    run of ``FAN`` blocks a window carries, and one row per run is carried over
    the runs. A group of 10^12 rows has 10^7 blocks and 10^4 runs, and no
    window sees more than that.
    """
    runs = ends.withColumn("_run", F.floor(F.col("_block") / F.lit(FAN)).cast("bigint"))
    inside, across = (Window.partitionBy(*keys, *more).orderBy(by) for more, by in ((["_run"], "_block"), ([], "_run")))
    if ahead:
        near = {f"_n_{c}": F.lead(c, 1).over(inside) for c in columns}
        tops = runs.groupBy(*keys, "_run").agg(*[F.min_by(c, "_block").alias(f"_t_{c}") for c in columns])
        far = {f"_t_{c}": F.lead(f"_t_{c}", 1).over(across) for c in columns}
    else:
        before = lambda window: window.rowsBetween(Window.unboundedPreceding, -1)
        near = {f"_n_{c}": F.last(c, ignorenulls=True).over(before(inside)) for c in columns}
        tops = runs.groupBy(*keys, "_run").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_block"))).alias(f"_t_{c}") for c in columns])
        far = {f"_t_{c}": F.last(f"_t_{c}", ignorenulls=True).over(before(across)) for c in columns}
    joined = join_null_safe(runs.withColumns(near), tops.withColumns(far), [*keys, "_run"])
    return joined.select(*keys, "_block", *[F.coalesce(f"_n_{c}", f"_t_{c}").alias(name) for c, name in columns.items()])


def fill_forward(
    rows: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Each NULL takes the last earlier value of its group, in ``order``.

    Inside a block a window fills; the last values of earlier blocks are carried
    over one row per (group, block). ``order`` is an integer row number.
    """
    blocked = _blocks(rows, order, block_rows)
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = blocked.withColumns({f"_f_{c}": F.last(c, ignorenulls=True).over(inside) for c in columns})
    ends = blocked.groupBy(*keys, "_block").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_c_{c}") for c in columns]
    )
    carried = _scan_blocks(ends, keys, {f"_c_{c}": f"_c_{c}" for c in columns}, ahead=False)
    joined = join_null_safe(filled, carried, [*keys, "_block"])
    return joined.withColumns({c: F.coalesce(f"_f_{c}", f"_c_{c}") for c in columns}).select(*rows.columns)


def next_in_group(
    rows: DataFrame, keys: Sequence[str], order: str, column: str, name: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Adds ``name``: the value of ``column`` in the following row of the group."""
    blocked = _blocks(rows, order, block_rows)
    value = F.struct(F.col(column).alias("v"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    led = blocked.withColumn("_in", F.lead(value, 1).over(inside))
    heads = blocked.groupBy(*keys, "_block").agg(F.min_by(value, F.col(order)).alias("_head"))
    following = _scan_blocks(heads, keys, {"_head": "_next"}, ahead=True)
    joined = join_null_safe(led, following, [*keys, "_block"])
    return joined.withColumn(name, F.coalesce("_in", "_next")["v"]).select(*rows.columns, name)


def scope_totals(grouped: DataFrame, scope: Sequence[str], measure: str) -> DataFrame:
    """Grouped rows with the total of ``measure`` and the group count of their scope."""
    totals = grouped.groupBy(*scope).agg(F.sum(measure).alias("total_qty"), F.count(F.lit(1)).alias("total_items"))
    return grouped.join(totals, list(scope), "left")


def page(rows: DataFrame, order: Sequence[Column], page_no: int, page_size: int) -> DataFrame:
    """One page of a totally ordered result; deep pages are cut out of a sorted table."""
    if page_no < 1 or not 1 <= page_size <= 500:
        raise ValueError("page starts at 1, page size is 1 to 500")
    offset = (page_no - 1) * page_size
    if offset >= DEEP:
        return PagedTable(rows, order).page(page_no, page_size)
    return rows.orderBy(*order).offset(offset).limit(page_size)


class PagedTable:
    """A result dealt by range of its order and written once, for pages at any depth.

    The row counts of the ranges tell which of them hold a page; only those are
    read and sorted, so page 10^6 costs what page 1 does. Counts of ranges, a
    number per partition, are all that comes to the driver.
    """

    def __init__(self, rows: DataFrame, order: Sequence[Column], ranges: int | None = None):
        spark = rows.sparkSession
        self.order, self.columns = list(order), rows.columns
        n = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 32)
        dealt = rows.repartitionByRange(n, *self.order).withColumn("_range", F.spark_partition_id())
        self.table = stage(dealt, partition_by="_range")
        self.sizes = [(r[0], r[1]) for r in self.table.groupBy("_range").count().orderBy("_range").collect()]

    def page(self, page_no: int, page_size: int) -> DataFrame:
        begin = (page_no - 1) * page_size
        end, seen, wanted, skipped = begin + page_size, 0, [], 0
        for number, size in self.sizes:
            if seen < end and seen + size > begin:
                wanted.append(number)
                skipped = seen if len(wanted) == 1 else skipped
            seen += size
        kept = self.table.filter(F.col("_range").isin(*wanted)) if wanted else self.table.limit(0)
        return kept.orderBy(*self.order).offset(begin - skipped if wanted else 0).limit(page_size).select(*self.columns)
