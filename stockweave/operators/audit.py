"""Table audits: value rules, unique grains, references.

The rules a database would enforce by constraints, as queries: each returns the
rows that break it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _month_start(column: str) -> Column:
    return F.dayofmonth(column) == 1


# Allowed values of coded columns.
ALLOWED = {
    "sales_row_status": ("PENDING", "READY", "SKIPPED"),
    "sales_batch_status": ("UPLOADED", "VALIDATED", "PREVIEW_READY", "PUBLISHED", "FAILED"),
    "master_status": ("ACTIVE", "INACTIVE"),
    "cycle_status": ("OPEN", "LOCKED"),
    "dataset_type": ("ACTUAL", "INVENTORY"),
    "order_status": ("UNCONFIRMED", "CONFIRMED"),
    "lot_state": ("PRE_EXISTING", "ACTIVE", "SOLD_OUT"),
}


def rules_for(table: str) -> dict[str, Column]:
    """Row rules per table; a row breaks a rule when it is false (not NULL)."""
    c = F.col
    catalogue = {
        "sales_import_batch": {
            "file_hash": c("file_hash").rlike("^[0-9a-f]{64}$"),
            "row_counts": (c("total_rows") >= 0) & (c("ready_rows") >= 0) & (c("skipped_rows") >= 0),
            "date_range": c("data_date_start").isNull() | c("data_date_end").isNull() | (c("data_date_start") <= c("data_date_end")),
            "status": c("status").isin(*ALLOWED["sales_batch_status"]),
        },
        "sales_import_row": {"row_number": c("source_row_no") > 0, "status": c("status").isin(*ALLOWED["sales_row_status"])},
        "sales_mapping_issue": {"row_count": c("affected_row_count") > 0},
        "sales_fact": {"quantity_positive": c("actual_qty") > 0},
        "planning_cycle": {
            "month_start": _month_start("cycle_month"),
            "status": c("status").isin(*ALLOWED["cycle_status"]),
            "lock_columns": F.when(c("status") == "LOCKED", c("locked_at").isNotNull() & c("locked_by").isNotNull()).otherwise(
                c("locked_at").isNull() & c("locked_by").isNull()
            ),
        },
        "dataset_version": {
            "type": c("dataset_type").isin(*ALLOWED["dataset_type"]),
            "period_order": c("period_start") <= c("period_end"),
            "period_month_start": _month_start("period_start") & _month_start("period_end"),
        },
        "inventory_raw": {
            "balance": c("opening_qty") + c("receipt_qty") - c("issue_qty") == c("ending_qty"),
            "non_negative": (c("opening_qty") >= 0) & (c("ending_qty") >= 0),
            "month_start": _month_start("inventory_month"),
        },
        "production_lot_lifecycle": {
            "state": c("lifecycle_state").isin(*ALLOWED["lot_state"]),
            "sold_out": (c("lifecycle_state") == "SOLD_OUT") == c("final_sold_out_month").isNotNull(),
            "consumption": c("consumption_months").isNull()
            | ((c("consumption_months") > 0) & c("first_inbound_month").isNotNull() & c("final_sold_out_month").isNotNull()),
            "month_order": c("first_inbound_month").isNull() | c("final_sold_out_month").isNull() | (c("first_inbound_month") <= c("final_sold_out_month")),
        },
        "final_order": {
            "quantity": c("order_qty") >= 0,
            "status": c("status").isin(*ALLOWED["order_status"]),
            "confirmation": F.when(c("status") == "CONFIRMED", c("confirmed_by").isNotNull() & c("confirmed_at").isNotNull()).otherwise(
                c("confirmed_by").isNull() & c("confirmed_at").isNull()
            ),
        },
        "forecast_line": {"quantity": c("forecast_qty") >= 0, "month_start": _month_start("forecast_month")},
        "import_batch": {
            "counts": (c("total_rows") >= 0) & (c("error_rows") >= 0) & (c("warning_rows") >= 0) & (c("error_rows") <= c("total_rows")),
            "review_version": c("review_version") >= 1,
        },
        "import_row": {"row_number": c("row_number") > 0, "reviewed": (c("status") != "READY") | c("reviewed_values").isNotNull()},
    }
    return catalogue[table]


# Columns that identify one row of a table.
GRAINS = {
    "sales_import_row": ("import_batch_id", "source_row_no"),
    "sales_import_candidate": ("import_row_id",),
    "sales_fact": ("source_system", "source_document_no", "source_line_no", "snapshot_month"),
    "cycle_source_binding": ("cycle_id", "dataset_version_id", "period_start"),
    "inventory_sku_month": ("dataset_version_id", "inventory_month", "sku_id"),
    "inventory_product_month": ("dataset_version_id", "inventory_month", "product_id"),
    "actual_channel_product_month": ("dataset_version_id", "channel_id", "product_id", "actual_month"),
    "forecast_line": ("forecast_version_id", "channel_id", "product_id", "forecast_month"),
    "final_order": ("cycle_id", "product_id"),
    "production_lot_lifecycle": ("product_id", "production_date", "revision_no"),
}


def violations(frame: DataFrame, table: str, key: Sequence[str]) -> DataFrame:
    """(key, rule) of every row rule that is broken."""
    broken = [F.when(F.coalesce(~rule, F.lit(False)), F.lit(name)) for name, rule in rules_for(table).items()]
    return frame.select(*key, F.explode(F.filter(F.array(*broken), lambda r: r.isNotNull())).alias("rule"))


def violation_counts(frame: DataFrame, table: str) -> DataFrame:
    """Broken rows per rule, rules without any included."""
    rules = rules_for(table)
    counts = frame.agg(*[F.count_if(F.coalesce(~rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    entries = [F.struct(F.lit(table).alias("table_name"), F.lit(name).alias("rule"), F.col(name).alias("broken_rows")) for name in rules]
    return counts.select(F.inline(F.array(*entries)))


def repeated_grains(frame: DataFrame, grain: Sequence[str]) -> DataFrame:
    return frame.groupBy(*grain).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def orphans(links: Sequence[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Rows per missing foreign key value.

    ``links``: (label, child, child column, parent, parent column). Values are
    reduced before the parent is asked, so a hot value costs one row.
    """
    parts = []
    for label, child, column, parent, key in links:
        values = child.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("missing_id")).agg(F.count(F.lit(1)).alias("rows"))
        lost = values.join(parent.select(F.col(key).alias("missing_id")), "missing_id", "left_anti")
        parts.append(lost.select(F.lit(label).alias("link"), F.col("missing_id").cast("string").alias("missing_id"), "rows"))
    return reduce(DataFrame.unionByName, parts)
