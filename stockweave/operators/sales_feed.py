"""Sales export: typing, file rules, duplicate keys, mapping summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.functions.dates import month_start, sales_date
from stockweave.functions.numbers import sales_quantity
from stockweave.functions.text import blank_to_null, bounded_text, line_number, too_long
from stockweave.operators import resolution
from stockweave.operators.findings import finding, with_findings
from stockweave.operators.groups import attach_group

# Field length limits.
LIMITS = {"document_no": 128, "customer_name": 255, "product_type": 128, "sku_code": 128, "sku_name": 255}
TOTAL_LIMIT = 10**14

# Severity of a mapping issue.
ISSUE_SEVERITY = {"SKU_NOT_FOUND": "ERROR", "PRODUCT_NOT_ASSIGNED": "ERROR", "CUSTOMER_NOT_FOUND": "WARNING"}
REASONS = ("KIT_PARENT", "NONPOSITIVE_QTY", "SKU_NOT_FOUND", "SKU_AMBIGUOUS", "PRODUCT_NOT_ASSIGNED", "CUSTOMER_NOT_FOUND")


def type_sales_rows(raw: DataFrame) -> DataFrame:
    """Typed columns next to the raw row and a finding per failed field.

    Input: row_number and the eight text columns of the export.
    """
    typed = raw.withColumns(
        {
            "source_document_no": bounded_text("document_no", LIMITS["document_no"]),
            "source_line_no": line_number("line_no"),
            "sales_date": sales_date("business_date"),
            "actual_qty": sales_quantity("quantity"),
            "source_customer_name": bounded_text("customer_name", LIMITS["customer_name"]),
            "source_product_type": bounded_text("product_type", LIMITS["product_type"]),
            "source_sku_code": bounded_text("sku_code", LIMITS["sku_code"]),
            "source_sku_name": bounded_text("sku_name", LIMITS["sku_name"]),
        }
    )
    missing = {
        "source_document_no": ("document_no", "BUSINESS_KEY_INVALID"),
        "source_line_no": ("line_no", "BUSINESS_KEY_INVALID"),
        "sales_date": ("business_date", "BUSINESS_DATE_INVALID"),
        "actual_qty": ("quantity", "SHIPPED_QTY_INVALID"),
    }
    rules = [finding(F.col(c).isNull(), code, field=field) for c, (field, code) in missing.items()]
    rules += [
        finding(too_long(field, LIMITS[field]), "FILE_STRUCTURE_INVALID", field=field)
        for field in ("customer_name", "product_type", "sku_code", "sku_name")
    ]
    return with_findings(typed, rules)


def drop_blank_rows(raw: DataFrame, *columns: str) -> DataFrame:
    return raw.filter(F.coalesce(*[blank_to_null(c) for c in columns]).isNotNull())


def duplicate_business_keys(rows: DataFrame, *batch: str, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds ``first_row_no``: the first row with the same (document, line).

    NULL when the row is that first row or its key is incomplete. Rows of one
    key are never gathered: the first row comes from a partial aggregate.
    ``keep`` stores the keys that repeat: rows move only if these are many.
    """
    keys = [*batch, "source_document_no", "source_line_no"]
    marked = attach_group(
        rows,
        keys,
        {"_first": F.min("row_number"), "_rows": F.count(F.lit(1))},
        row_id=["row_number"],
        having=F.col("_rows") > 1,
        keep=keep,
    )
    return marked.withColumn("first_row_no", F.when(F.col("row_number") > F.col("_first"), F.col("_first"))).drop("_first", "_rows")


def duplicate_key_findings(rows: DataFrame, *batch: str, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    marked = duplicate_business_keys(rows, *batch, keep=keep)
    details = F.create_map(F.lit("first_row"), F.col("first_row_no").cast("string"))
    rule = finding(F.col("first_row_no").isNotNull(), "DUPLICATE_BUSINESS_KEY", details=details)
    return with_findings(marked, [rule]).drop("first_row_no")


def file_verdict(rows: DataFrame, *batch: str) -> DataFrame:
    """Per file: row and error counts, month, date range, and whether it is blocked.

    A file is blocked by any row finding, by holding no row, by dates of more
    than one month, or by a total that DECIMAL(18,4) cannot hold.
    """
    month = month_start("sales_date")
    clean = F.size("findings") == 0
    totals = rows.groupBy(*batch).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(~clean).alias("rows_with_errors"),
        F.sum(F.size("findings")).cast("bigint").alias("row_errors"),
        F.min(month).alias("_first_month"),
        F.max(month).alias("_last_month"),
        F.min("sales_date").alias("data_date_start"),
        F.max("sales_date").alias("data_date_end"),
        F.sum(F.when(clean, F.col("actual_qty").cast("decimal(38,4)"))).alias("total_qty"),
    )
    several = F.coalesce(F.col("_first_month") != F.col("_last_month"), F.lit(False))
    overflow = (F.col("row_errors") == 0) & ~several & F.coalesce(F.abs("total_qty") >= TOTAL_LIMIT, F.lit(False))
    return (
        totals.withColumn("snapshot_month", F.when(~several, F.col("_first_month")))
        .withColumn("several_months", several)
        .withColumn("total_overflow", overflow)
        .withColumn("blocked", (F.col("row_count") == 0) | (F.coalesce("row_errors", F.lit(0)) > 0) | several | overflow)
        .drop("_first_month", "_last_month")
    )


def mapping_summary(mapped: DataFrame, *batch: str) -> DataFrame:
    """Eight row counts and three quantities of a mapped batch."""
    reason, qty = F.col("mapping_reason"), F.col("actual_qty")
    ready = F.col("status") == "READY"

    def total(when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, qty)), F.lit(0)).cast("decimal(28,4)")

    return mapped.groupBy(*batch).agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(ready).alias("ready_rows"),
        F.count_if(~ready).alias("skipped_rows"),
        F.count_if(reason == resolution.KIT_PARENT).alias("kit_parent_skipped_rows"),
        F.count_if(reason == resolution.NONPOSITIVE_QTY).alias("nonpositive_qty_skipped_rows"),
        F.count_if(reason.isin(resolution.SKU_NOT_FOUND, resolution.SKU_AMBIGUOUS)).alias("sku_not_found_rows"),
        F.count_if(reason == resolution.PRODUCT_NOT_ASSIGNED).alias("product_not_assigned_rows"),
        F.count_if(reason == resolution.CUSTOMER_NOT_FOUND).alias("customer_not_found_rows"),
        total(ready).alias("ready_qty"),
        total(~ready).alias("skipped_qty"),
        total(ready & F.col("customer_id").isNull()).alias("unassigned_qty"),
    )


def mapping_issues(mapped: DataFrame, *batch: str) -> DataFrame:
    """Issue per (type, code): first name in row order, rows, quantity, severity.

    An ambiguous SKU counts as not found; a missing customer is coded by name.
    """
    reason = F.col("mapping_reason")
    kind = F.when(reason == resolution.SKU_AMBIGUOUS, resolution.SKU_NOT_FOUND).otherwise(reason)
    customer = kind == resolution.CUSTOMER_NOT_FOUND
    issues = mapped.filter(kind.isin(*ISSUE_SEVERITY)).select(
        *batch,
        "source_row_no",
        "actual_qty",
        kind.alias("issue_type"),
        F.when(customer, F.col("source_customer_name")).otherwise(F.col("source_sku_code")).alias("external_code"),
        F.when(customer, F.col("source_customer_name")).otherwise(F.col("source_sku_name")).alias("_name"),
    )
    severity = F.lit(None).cast("string")
    for name, level in ISSUE_SEVERITY.items():
        severity = F.when(F.col("issue_type") == name, level).otherwise(severity)
    return (
        issues.groupBy(*batch, "issue_type", "external_code")
        .agg(
            F.min_by("_name", "source_row_no").alias("external_name"),
            F.count(F.lit(1)).alias("affected_row_count"),
            F.sum("actual_qty").cast("decimal(28,4)").alias("affected_qty"),
        )
        .withColumn("severity", severity)
    )


def preview_reasons(mapped: DataFrame, *batch: str) -> DataFrame:
    """Rows and quantity of every mapping reason, absent reasons as zero."""
    measures = []
    for reason in REASONS:
        hit = F.col("mapping_reason") == reason
        measures += [F.count_if(hit).alias(f"{reason}#rows"), F.sum(F.when(hit, F.col("actual_qty"))).alias(f"{reason}#qty")]
    wide = mapped.groupBy(*batch).agg(*measures)
    entries = [
        F.struct(
            F.lit(reason).alias("mapping_reason"),
            F.col(f"{reason}#rows").alias("rows"),
            F.coalesce(f"{reason}#qty", F.lit(0)).cast("decimal(28,4)").alias("qty"),
        )
        for reason in REASONS
    ]
    return wide.select(*batch, F.inline(F.array(*entries)))


def unassigned_summary(candidates: DataFrame, *batch: str) -> DataFrame:
    """Candidates lacking a channel or a sales rep."""
    lacking = F.col("channel_id_snapshot").isNull() | F.col("salesrep_id_snapshot").isNull()
    return candidates.groupBy(*batch).agg(
        F.count_if(lacking).alias("rows"),
        F.coalesce(F.sum(F.when(lacking, F.col("actual_qty"))), F.lit(0)).cast("decimal(28,4)").alias("qty"),
    )


# Dimensions of a preview aggregate.
PREVIEW_DIMENSIONS = {
    "product": ("product_id", "product_code_snapshot", "product_name_snapshot"),
    "sku": ("sku_id", "sku_code_snapshot", "sku_name_snapshot", "product_code_snapshot", "product_name_snapshot"),
    "channel-product": ("channel_id_snapshot", "channel_code_snapshot", "channel_name_snapshot", "product_code_snapshot", "product_name_snapshot"),
    "salesrep-product": ("salesrep_id_snapshot", "salesrep_code_snapshot", "salesrep_name_snapshot", "product_code_snapshot", "product_name_snapshot"),
}


def preview_aggregate(candidates: DataFrame, dimension: str, *batch: str) -> DataFrame:
    """Rows and quantity per preview dimension."""
    dims = PREVIEW_DIMENSIONS[dimension]
    return candidates.groupBy(*batch, *dims).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("actual_qty").cast("decimal(28,4)").alias("qty")
    )


def preview_order(dimension: str) -> list[Column]:
    """Largest quantity first, then the dimension columns."""
    return [F.col("qty").desc(), *[F.col(c).asc() for c in PREVIEW_DIMENSIONS[dimension]]]
