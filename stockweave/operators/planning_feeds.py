"""Planning feeds: actual shipments, inventory months, incoming supply.

Each feed is typed first (text columns in, typed columns and findings out),
then resolved against the masters. Only rows without findings become facts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.functions.dates import is_complete_month, month_start, planning_day
from stockweave.functions.numbers import balanced, cell_not_storable, cell_or_zero, feed_cell, is_negative
from stockweave.functions.text import code_text, normalize_text
from stockweave.operators.findings import finding, no_findings, with_findings
from stockweave.operators.groups import fill_forward
from stockweave.operators.resolution import resolve_customer_names, sku_products

# The only document status that counts, and the planning scope.
APPROVED = "已审核"
PLANNING_AVAILABLE = "PLANNING_AVAILABLE"
QTY = "decimal(34,10)"
STORED_QTY = "decimal(18,3)"
BALANCE = ("opening_qty", "receipt_qty", "issue_qty", "ending_qty")


def is_clean():
    return F.size("findings") == 0


# --- actual shipments ------------------------------------------------------


def type_actuals(raw: DataFrame) -> DataFrame:
    """Text columns of the shipment export -> typed columns and findings."""
    typed = raw.select(
        *[c for c in raw.columns if c not in ("business_date", "quantity", "production_day", *_ACTUAL_TEXT)],
        "business_date",
        "quantity",
        "production_day",
        *[(code_text(c) if c == "sku_code" else normalize_text(c)).alias(c) for c in _ACTUAL_TEXT],
    )
    read = read_cells(typed, ["quantity"], ["business_date", "production_day"]).withColumns(
        {
            "sales_date": planning_day(F.col("_cell_business_date")),
            "shipped_qty": F.col("_cell_quantity.quantity"),
            "shipped_qty_text": F.col("_cell_quantity.text"),
            "production_date": planning_day(F.col("_cell_production_day")),
        }
    )
    return drop_cells(with_findings(read, actual_rules(text_cells=True)))


def read_cells(raw: DataFrame, numbers: Sequence[str], days: Sequence[str]) -> DataFrame:
    """Adds what number and date cells say as columns, so that each cell is parsed once, however many rules read it.

    Normalise other texts in a step before the one that reads the cells: next to
    them they make the optimizer put the parse into every use again.
    """
    return raw.withColumns({f"_cell_{c}": feed_cell(c) for c in numbers} | {f"_cell_{c}": normalize_text(c) for c in days})


def drop_cells(rows: DataFrame) -> DataFrame:
    return rows.drop(*[c for c in rows.columns if c.startswith("_cell_")])


_ACTUAL_TEXT = ("customer_name", "document_status", "sku_code", "sku_name", "warehouse_name", "batch_no")


def actual_rules(text_cells: bool = False) -> list:
    """Field rules of a shipment row; ``text_cells``: of one with the columns of `read_cells`."""
    number, day = F.col("_cell_quantity"), F.col("_cell_production_day")
    no_number = number["blank"] | number["invalid"] if text_cells else F.col("shipped_qty").isNull()
    rules = [
        finding(F.col("sales_date").isNull(), "ACTUAL_SALES_DATE_INVALID", field="sales_date"),
        finding(no_number, "ACTUAL_SALES_VALUE_INVALID", field="shipped_qty"),
    ]
    if text_cells:
        rules.append(finding(cell_not_storable(number), "ACTUAL_SALES_VALUE_NOT_STORABLE", field="shipped_qty"))
        rules.append(
            finding(F.col("production_date").isNull() & day.isNotNull(), "ACTUAL_SALES_PRODUCTION_DATE_INVALID", field="production_date")
        )
    rules += [
        finding(F.col(c).isNull(), "ACTUAL_SALES_REQUIRED_FIELD_MISSING", field=c)
        for c in ("customer_name", "sku_code", "warehouse_name", "batch_no")
    ]
    rules.append(finding(~F.col("document_status").eqNullSafe(F.lit(APPROVED)), "ACTUAL_SALES_STATUS_NOT_APPROVED", field="document_status"))
    return rules


def resolve_actuals(
    typed: DataFrame,
    customer: DataFrame,
    channel: DataFrame,
    sku: DataFrame,
    product: DataFrame,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Adds customer, channel, SKU and product ids, and findings where unresolved.

    With ``keep`` (:class:`staging.Steps`) only the rows without findings come.
    It stores the rows before each of the two lookups: what one shuffles is gone
    before the next, a row with a finding moves no further, and those that move
    carry no findings.
    """
    if keep:
        typed = keep(typed)
    names = typed.select(F.col("customer_name").alias("source_customer_name")).filter(F.col("source_customer_name").isNotNull()).distinct()
    known = customer.select("customer_id", "customer_code", "customer_name", "channel_id")
    customers = resolve_customer_names(names, known, channel).select(
        F.col("source_customer_name").alias("customer_name"), "customer_id", "channel_id"
    )
    if keep:
        # Not filtered before they are stored: that would make the left joins of the names inner ones.
        placed = keep(typed.filter(is_clean()).drop("findings").join(customers, "customer_name", "left"))
        placed = placed.filter(F.col("customer_id").isNotNull())
        skus = sku_products(placed, sku, product).select("sku_code", "sku_id", "product_id")
        return placed.join(skus, "sku_code", "left").filter(F.col("product_id").isNotNull()).withColumn("findings", no_findings())
    skus = sku_products(typed, sku, product).select("sku_code", "sku_id", "product_id")
    joined = typed.join(customers, "customer_name", "left").join(skus, "sku_code", "left")
    return with_findings(
        joined,
        [
            finding(F.col("customer_id").isNull(), "ACTUAL_SALES_CUSTOMER_UNRESOLVED", field="customer_name"),
            finding(F.col("product_id").isNull(), "ACTUAL_SALES_PRODUCT_UNRESOLVED", field="sku_code"),
        ],
    )


def actual_channel_months(valid: DataFrame, *version: str) -> DataFrame:
    """Shipped quantity per channel, product and month."""
    return valid.groupBy(*version, "channel_id", "product_id", month_start("sales_date").alias("actual_month")).agg(
        F.sum("shipped_qty").cast(STORED_QTY).alias("shipped_qty")
    )


def actual_production_months(valid: DataFrame, *version: str) -> DataFrame:
    """Shipped quantity per product, production date and month; undated rows are left out."""
    return (
        valid.filter(F.col("production_date").isNotNull())
        .groupBy(*version, "product_id", "production_date", month_start("sales_date").alias("actual_month"))
        .agg(F.sum("shipped_qty").cast(STORED_QTY).alias("shipped_qty"))
    )


def actuals_summary(checked: DataFrame, *version: str) -> DataFrame:
    clean = is_clean()
    month = month_start("sales_date")
    return (
        checked.groupBy(*version)
        .agg(
            F.count(F.lit(1)).alias("total_rows"),
            F.count_if(clean).alias("valid_rows"),
            F.sum(F.size("findings")).cast("bigint").alias("blocking_error_count"),
            F.count_if(clean & F.col("production_date").isNotNull()).alias("production_aggregation_rows"),
            F.count_if(clean & F.col("production_date").isNull()).alias("missing_production_date_rows"),
            F.min(F.when(clean, month)).alias("period_start"),
            F.max(F.when(clean, month)).alias("period_end"),
        )
        .withColumn("commit_allowed", (F.col("blocking_error_count") == 0) & (F.col("valid_rows") > 0))
    )


# --- inventory -------------------------------------------------------------


def type_inventory(raw: DataFrame) -> DataFrame:
    """Text columns of the stock report -> typed columns and value findings."""
    quantities = {"opening_qty": "opening", "receipt_qty": "receipt", "issue_qty": "issue", "ending_qty": "ending"}
    days = {"production_date": "production_day", "expiry_date": "expiry_day"}
    texts = ("sku_code", "sku_name", "warehouse_name", "batch_no", "inventory_unit")
    cell = {c: F.col(f"_cell_{source}") for c, source in (quantities | days).items()}
    read = read_cells(raw, list(quantities.values()), list(days.values())).withColumns({c: normalize_text(c) for c in texts})
    typed = read.withColumns(
        {
            **{c: planning_day(cell[c]) for c in days},
            **{c: cell_or_zero(cell[c]) for c in quantities},
            **{f"{c}_text": F.when(cell[c]["blank"], "0").otherwise(cell[c]["text"]) for c in quantities},
        }
    )
    rules = [finding(F.col(c).isNull(), "INVENTORY_VALUE_INVALID", field=c) for c in days]
    rules += [finding(cell[c]["invalid"], "INVENTORY_VALUE_INVALID", field=c) for c in quantities]
    rules += [finding(cell_not_storable(cell[c]), "INVENTORY_VALUE_NOT_STORABLE", field=c) for c in quantities]
    rules += [finding(F.col(c).isNull(), "INVENTORY_REQUIRED_FIELD_MISSING", field=c) for c in texts]
    return drop_cells(with_findings(typed, rules))


def inventory_batch_findings(batches: DataFrame) -> DataFrame:
    """Batch rules: period is one complete month, policy version given, rows present.

    ``batches``: batch_id, period_start, period_end, policy_version, row_count.
    """
    rules = {
        "INVENTORY_PERIOD_NOT_COMPLETE_MONTH": ~F.coalesce(is_complete_month("period_start", "period_end"), F.lit(False)),
        "INVENTORY_PLANNING_POLICY_VERSION_REQUIRED": normalize_text("policy_version").isNull(),
        "INVENTORY_NO_DATA_ROWS": F.coalesce("row_count", F.lit(0)) == 0,
    }
    found = F.filter(F.array(*[F.when(test, F.lit(code)) for code, test in rules.items()]), lambda c: c.isNotNull())
    return batches.select("batch_id", F.explode(found).alias("code"))


def below_zero(frame: DataFrame, name: str) -> Column:
    """Sign of a quantity: of all its digits where the rows keep them."""
    return is_negative(f"{name}_text") if f"{name}_text" in frame.columns else F.col(name) < 0


def inventory_balance_rules(frame: DataFrame) -> list:
    """Balances are non-negative and opening + receipt - issue = ending, to the last digit where the rows keep texts."""
    rules = [finding(below_zero(frame, c), "INVENTORY_BALANCE_QUANTITY_NEGATIVE", field=c) for c in ("opening_qty", "ending_qty")]
    if all(f"{c}_text" in frame.columns for c in BALANCE):
        opening, receipt, issue, ending = (F.col(f"{c}_text") for c in BALANCE)
        off = ~balanced([opening, receipt], [issue, ending])
    else:
        off = F.col("opening_qty") + F.col("receipt_qty") - F.col("issue_qty") != F.col("ending_qty")
    return [*rules, finding(off, "INVENTORY_BALANCE_MISMATCH")]


def resolve_inventory(typed: DataFrame, sku: DataFrame, product: DataFrame, policy: DataFrame) -> DataFrame:
    """Adds master ids, findings, and the warehouse's planning status.

    The warehouse is judged only on rows without another finding: unclassified
    is an error, a status outside the planning scope a warning. ``policy`` is
    matched by normalised warehouse name; the first entry of a name counts.
    """
    skus = sku_products(typed, sku, product, key="text").select("sku_code", "sku_id", "sku_status", "product_id", "product_status")
    joined = with_findings(typed.join(skus, "sku_code", "left"), inventory_balance_rules(typed))
    inactive = F.col("sku_code").isNotNull() & ~F.col("sku_status").eqNullSafe(F.lit("ACTIVE"))
    no_product = F.col("sku_status").eqNullSafe(F.lit("ACTIVE")) & ~(
        F.col("product_id").isNotNull() & F.col("product_status").eqNullSafe(F.lit("ACTIVE"))
    )
    checked = with_findings(
        joined,
        [
            finding(inactive, "INVENTORY_ACTIVE_SKU_NOT_FOUND", field="sku_code"),
            finding(no_product, "INVENTORY_VALID_PRODUCT_NOT_FOUND", field="sku_code"),
        ],
    )
    known = policy.groupBy(normalize_text("warehouse_name").alias("warehouse_name")).agg(
        F.min("planning_status").alias("planning_status"), F.min("policy_version").alias("policy_version")
    )
    placed = checked.join(known, "warehouse_name", "left")
    judged = is_clean()
    return with_findings(
        placed,
        [
            finding(judged & F.col("planning_status").isNull(), "INVENTORY_WAREHOUSE_SCOPE_UNCLASSIFIED", field="warehouse_name"),
            finding(
                judged & (F.col("planning_status") != PLANNING_AVAILABLE),
                "INVENTORY_NOT_PLANNING_AVAILABLE_EXCLUDED",
                severity="WARNING",
                field="warehouse_name",
            ),
        ],
    )


def no_errors():
    return ~F.exists("findings", lambda item: item["severity"] == "ERROR")


def inventory_raw(checked: DataFrame) -> DataFrame:
    """Stored rows: all without error, also those outside the planning scope."""
    return checked.filter(no_errors())


def planning_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(no_errors() & (F.col("planning_status") == PLANNING_AVAILABLE))


def inventory_months(planning: DataFrame, grain: Sequence[str], *version: str) -> DataFrame:
    """Sums of the four balances per SKU or product and month."""
    return planning.groupBy(*version, "inventory_month", *grain).agg(
        *[F.sum(c).cast(STORED_QTY).alias(c) for c in BALANCE], F.min("policy_version").alias("warehouse_policy_version")
    )


# Fixed value: two standing warnings (issue is not sales, receipt is not supply).
STANDING_WARNINGS = ("INVENTORY_GROSS_ISSUE_NOT_ACTUAL_SALES", "INVENTORY_GROSS_RECEIPT_NOT_EXTERNAL_SUPPLY")


def inventory_summary(checked: DataFrame, *version: str) -> DataFrame:
    """Eight counts; the two standing warnings are always part of the last."""
    errors = F.size(F.filter("findings", lambda item: item["severity"] == "ERROR"))
    warnings = F.size("findings") - errors
    valid = no_errors()
    planned = valid & (F.col("planning_status") == PLANNING_AVAILABLE)
    return checked.groupBy(*version).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(valid).alias("valid_rows"),
        F.sum(errors).cast("bigint").alias("blocking_error_count"),
        (F.sum(warnings) + len(STANDING_WARNINGS)).cast("bigint").alias("warning_count"),
        F.count_if(planned).alias("planning_available_rows"),
        F.count_if(valid & ~planned).alias("excluded_warehouse_rows"),
        F.count_if(planned).alias("derived_fact_candidate_rows"),
        F.count_if(planned).alias("lifecycle_candidate_rows"),
    )


# --- incoming --------------------------------------------------------------


def inherit_quantities(rows: DataFrame, block_rows: int = 100_000) -> DataFrame:
    """Order quantity, shipped total and difference filled down within
    (order group, order number, SKU) of a sheet of one delivery; a blank never
    becomes zero. Deliveries are told apart by ``batch_id`` and ``source_file``
    where the rows have them."""
    delivery = [c for c in ("batch_id", "source_file") if c in rows.columns]
    inherited = [c for c in ("order_qty", "shipped_total", "difference_qty") if c in rows.columns]
    return fill_forward(rows, [*delivery, "source_sheet_name", "order_group", "order_no", "sku_code"], "row_number", inherited, block_rows)


def type_incoming(raw: DataFrame) -> DataFrame:
    """Text columns of the supply file -> typed columns and findings."""
    quantities = ("shipment_qty", "order_qty", "shipped_total", "difference_qty")
    texts = ("sku_code", "sku_name", "order_group", "order_no", "batch_no")
    cell = {c: F.col(f"_cell_{c}") for c in (*quantities, "eta")}
    entered = {"warehouse_entry_recorded": normalize_text("warehouse_entry").isNotNull()}
    read = read_cells(raw, quantities, ["eta"]).withColumns({c: normalize_text(c) for c in texts} | entered)
    typed = read.withColumns(
        {
            **{f"{c}_text": cell[c]["text"] for c in quantities},
            **{c: cell[c]["quantity"] for c in quantities},
            "eta": planning_day(cell["eta"]),
        }
    )
    rules = [finding(cell[c]["invalid"], "INCOMING_QUANTITY_INVALID", field=c) for c in quantities]
    rules += [finding(cell_not_storable(cell[c]), "INCOMING_QUANTITY_NOT_STORABLE", field=c) for c in quantities]
    rules.append(finding(F.col("eta").isNull() & cell["eta"].isNotNull(), "INCOMING_ETA_INVALID", field="eta"))
    return drop_cells(with_findings(typed, rules))


def resolve_incoming(typed: DataFrame, sku: DataFrame, product: DataFrame) -> DataFrame:
    skus = sku_products(typed, sku, product).select("sku_code", "sku_id", "product_id", "product_stable_id", "product_name")
    return with_findings(
        typed.join(skus, "sku_code", "left"),
        [
            finding(F.col("sku_code").isNull(), "INCOMING_SKU_REQUIRED", field="sku_code"),
            finding(F.col("product_id").isNull(), "INCOMING_PRODUCT_UNRESOLVED", field="sku_code"),
            finding(below_zero(typed, "shipment_qty"), "INCOMING_QUANTITY_NEGATIVE", field="shipment_qty"),
        ],
    )


def is_future_supply():
    """Shipped and not yet in a warehouse."""
    return F.col("shipment_qty").isNotNull() & ~F.col("warehouse_entry_recorded")


def future_supply(valid: DataFrame, *version: str) -> DataFrame:
    return valid.filter(is_future_supply()).groupBy(*version, "product_id").agg(F.sum("shipment_qty").cast(STORED_QTY).alias("incoming_qty"))


def incoming_summary(checked: DataFrame, *version: str) -> DataFrame:
    clean, future = is_clean(), is_future_supply()
    shipped = F.col("shipment_qty").isNotNull()
    return checked.groupBy(*version).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(clean).alias("valid_rows"),
        F.sum(F.size("findings")).cast("bigint").alias("blocking_error_count"),
        F.count_if(clean & shipped).alias("shipment_rows"),
        F.count_if(clean & future).alias("current_future_supply_rows"),
        F.count_if(clean & shipped & F.col("warehouse_entry_recorded")).alias("entered_shipment_rows"),
        F.count_if(clean & ~shipped).alias("unshipped_rows"),
        F.coalesce(F.sum(F.when(clean & future, F.col("shipment_qty"))), F.lit(0)).cast(STORED_QTY).alias("current_future_supply_qty"),
    )
