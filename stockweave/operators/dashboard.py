"""Dashboard reads over the current monthly snapshots.

``scope`` is the batch a result belongs to: (source_system, snapshot_month) by
default, so one job answers for one month or for all of them. Shares relate to
the filtered total of that scope.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.functions.numbers import share
from stockweave.operators.groups import page, scope_totals

SCOPE = ("source_system", "snapshot_month")
UNASSIGNED = "未归属"


@dataclass(frozen=True)
class Filters:
    """Allowed ids per dimension; ``None`` inside a tuple keeps unassigned rows."""

    product_ids: tuple[int, ...] = ()
    sku_ids: tuple[int, ...] = ()
    channel_ids: tuple[int | None, ...] = ()
    salesrep_ids: tuple[int | None, ...] = ()


def _allowed(column: str, values: Sequence[int | None]) -> Column | None:
    if not values:
        return None
    concrete = [v for v in values if v is not None]
    test = F.col(column).isin(concrete) if concrete else F.lit(False)
    return test | F.col(column).isNull() if None in values else test


def apply_filters(fact: DataFrame, filters: Filters) -> DataFrame:
    for column, values in (
        ("product_id", filters.product_ids),
        ("sku_id", filters.sku_ids),
        ("channel_id_snapshot", filters.channel_ids),
        ("salesrep_id_snapshot", filters.salesrep_ids),
    ):
        test = _allowed(column, values)
        if test is not None:
            fact = fact.filter(test)
    return fact


def summary(fact: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Quantity, distinct products and distinct SKUs.

    Facts are reduced to one row per SKU first, so both counts run on that.
    """
    by_sku = fact.groupBy(*scope, "product_id", "sku_id").agg(F.sum("actual_qty").alias("qty"))
    return by_sku.groupBy(*scope).agg(
        F.sum("qty").cast("decimal(28,4)").alias("mtd_qty"),
        F.countDistinct("product_id").alias("product_count"),
        F.countDistinct("sku_id").alias("sku_count"),
    )


def filter_options(fact: DataFrame, scope: Sequence[str] = SCOPE, products_and_skus: bool = True) -> DataFrame:
    """Distinct (id, code, name) per dimension still present after filtering.

    One reduction of the facts feeds all four lists.
    """
    reduced = fact.select(
        *scope,
        "product_id",
        "product_name_snapshot",
        "sku_id",
        "sku_code_snapshot",
        "sku_name_snapshot",
        "channel_id_snapshot",
        "channel_name_snapshot",
        "salesrep_id_snapshot",
        "salesrep_name_snapshot",
    ).distinct()

    def option(kind: str, id_column: str, code: Column, name: Column) -> Column:
        return F.struct(F.lit(kind).alias("option_kind"), F.col(id_column).alias("id"), code.alias("code"), name.alias("name"))

    none = F.lit(None).cast("string")
    options = [
        option("channel", "channel_id_snapshot", none, F.coalesce("channel_name_snapshot", F.lit(UNASSIGNED))),
        option("salesrep", "salesrep_id_snapshot", none, F.coalesce("salesrep_name_snapshot", F.lit(UNASSIGNED))),
    ]
    if products_and_skus:
        options += [
            option("product", "product_id", none, F.col("product_name_snapshot")),
            option("sku", "sku_id", F.col("sku_code_snapshot"), F.col("sku_name_snapshot")),
        ]
    return reduced.select(*scope, F.inline(F.array(*options))).distinct()


def grouped(fact: DataFrame, dims: Sequence[str | Column], names: Sequence[str], scope: Sequence[str] = SCOPE) -> DataFrame:
    """Quantity per group with its share of the scope and the group count."""
    columns = [(F.col(d) if isinstance(d, str) else d).alias(n) for d, n in zip(dims, names, strict=True)]
    groups = fact.groupBy(*scope, *columns).agg(F.sum("actual_qty").cast("decimal(28,4)").alias("qty"))
    return _with_share(groups, scope)


def _with_share(groups: DataFrame, scope: Sequence[str]) -> DataFrame:
    return scope_totals(groups, scope, "qty").withColumn("share", share("qty", "total_qty")).drop("total_qty")


def products(fact: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Quantity, share and SKU count per product.

    SKU rows are reduced first: the count needs no distinct aggregate then.
    """
    by_sku = fact.groupBy(*scope, "product_id", "product_name_snapshot", "sku_id").agg(F.sum("actual_qty").alias("qty"))
    groups = by_sku.groupBy(*scope, "product_id", F.col("product_name_snapshot").alias("product_name")).agg(
        F.sum("qty").cast("decimal(28,4)").alias("qty"), F.count("sku_id").alias("sku_count")
    )
    return _with_share(groups, scope)


def product_skus(fact: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """SKUs of each product with their share of that product."""
    return grouped(
        fact,
        ["sku_id", "sku_code_snapshot", "sku_name_snapshot"],
        ["sku_id", "sku_code", "sku_name"],
        [*scope, "product_id"],
    )


def _matrix(fact: DataFrame, dimension: str, scope: Sequence[str]) -> DataFrame:
    label = F.coalesce(f"{dimension}_name_snapshot", F.lit(UNASSIGNED))
    return grouped(
        fact,
        [f"{dimension}_id_snapshot", label, "product_id", "product_name_snapshot"],
        [f"{dimension}_id", f"{dimension}_name", "product_id", "product_name"],
        scope,
    )


def salesrep_products(fact: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    return _matrix(fact, "salesrep", scope)


def channel_products(fact: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    return _matrix(fact, "channel", scope)


def sorted_page(groups: DataFrame, sort: str, ties: Sequence[str], page_no: int = 1, page_size: int = 50) -> DataFrame:
    """Page by one sort key ('-qty' is descending), ties by the other columns."""
    key = "qty" if sort.lstrip("-") == "share" else sort.lstrip("-")
    first = F.col(key).desc_nulls_last() if sort.startswith("-") else F.col(key).asc_nulls_first()
    rest = [F.col(c).asc_nulls_first() for c in ties if c != key]
    return page(groups, [first, *rest], page_no, page_size)


def top_groups(fact: DataFrame, dimension: Sequence[str], n: int = 5) -> DataFrame:
    """The ``n`` groups with the largest quantity, ties by the dimension; grouped first, so only groups are ranked."""
    totals = fact.groupBy(*dimension).agg(F.sum("actual_qty").cast("decimal(28,4)").alias("qty"))
    return totals.orderBy(F.col("qty").desc(), *[F.col(c).asc_nulls_first() for c in dimension]).limit(n)


# --- current snapshots -----------------------------------------------------


def is_current() -> Column:
    return (F.col("status") == "PUBLISHED") & F.col("replaced_at").isNull()


def current_batches(batches: DataFrame) -> DataFrame:
    """Current batch per (source, month); several are AMBIGUOUS, never picked."""
    per_month = batches.filter(is_current()).groupBy(*SCOPE).agg(
        F.count(F.lit(1)).alias("current_batches"), F.min("batch_id").alias("_batch")
    )
    single = F.col("current_batches") == 1
    return (
        per_month.withColumn("batch_id", F.when(single, F.col("_batch")))
        .withColumn("state", F.when(single, "CURRENT").otherwise("AMBIGUOUS"))
        .drop("_batch")
    )


def check_requested(requested: DataFrame, batches: DataFrame) -> DataFrame:
    """Outcome per requested batch id: CURRENT, NOT_FOUND, AMBIGUOUS or CHANGED."""
    known = requested.select("batch_id").distinct().join(batches.select("batch_id", *SCOPE), "batch_id", "left")
    now = current_batches(batches).withColumnRenamed("batch_id", "current_batch_id")
    outcome = (
        F.when(F.col("source_system").isNull(), "NOT_FOUND")
        .when(F.col("state") == "AMBIGUOUS", "AMBIGUOUS")
        .when(F.col("current_batch_id").eqNullSafe(F.col("batch_id")), "CURRENT")
        .otherwise("CHANGED")
    )
    return known.join(now, list(SCOPE), "left").select("batch_id", *SCOPE, "current_batch_id", outcome.alias("outcome"))


def bind_fact(fact: DataFrame, rows: DataFrame, batches: DataFrame) -> DataFrame:
    """Facts of a month that come from rows of its current batch."""
    current = batches.filter(is_current()).select(*SCOPE, F.col("batch_id").alias("import_batch_id"))
    origin = rows.select("import_row_id", F.col("batch_id").alias("import_batch_id"))
    return fact.join(origin, "import_row_id").join(current, [*SCOPE, "import_batch_id"], "left_semi")


def snapshot_integrity(fact: DataFrame, rows: DataFrame, batches: DataFrame) -> DataFrame:
    """Month totals and lineage-bound totals must both equal the batch."""
    one = F.lit(1)
    month = fact.groupBy(*SCOPE).agg(F.count(one).alias("month_rows"), F.sum("actual_qty").alias("month_qty"))
    bound = bind_fact(fact, rows, batches).groupBy(*SCOPE).agg(F.count(one).alias("bound_rows"), F.sum("actual_qty").alias("bound_qty"))
    checked = batches.filter(is_current()).join(month, list(SCOPE), "left").join(bound, list(SCOPE), "left")
    zero = F.lit(0)
    counts = {c: F.coalesce(c, zero) for c in ("month_rows", "bound_rows")}
    sums = {c: F.coalesce(c, zero).cast("decimal(28,4)") for c in ("month_qty", "bound_qty")}
    checked = checked.withColumns({**counts, **sums})
    sound = (
        (F.col("month_rows") == F.col("ready_rows"))
        & (F.col("month_qty") == F.col("ready_qty"))
        & (F.col("bound_rows") == F.col("ready_rows"))
        & (F.col("bound_qty") == F.col("ready_qty"))
    )
    return checked.select(
        "batch_id", *SCOPE, "ready_rows", "ready_qty", "month_rows", "month_qty", "bound_rows", "bound_qty", sound.alias("sound")
    )


def available_months(batches: DataFrame) -> DataFrame:
    """Months with one current batch, newest first."""
    current = batches.filter(is_current())
    single = current_batches(batches).filter(F.col("state") == "CURRENT").select(*SCOPE)
    return current.join(single, list(SCOPE), "left_semi").orderBy(F.col("snapshot_month").desc(), "source_system")


def latest_month(batches: DataFrame) -> DataFrame:
    """Default month context: the newest available month per source."""
    months = available_months(batches)
    return months.groupBy("source_system").agg(F.max("snapshot_month").alias("snapshot_month"), F.max_by("batch_id", "snapshot_month").alias("batch_id"))
