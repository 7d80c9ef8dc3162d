"""Planning: feeds, monthly facts, lots, cycles, workbench."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.operators import cycle, lots
from stockweave.operators import planning_feeds as feeds
from stockweave.operators.findings import finding_counts, no_findings, with_findings
from stockweave.plans import standins as data
from stockweave.plans.registry import query
from stockweave.plans.standins import oracle
from stockweave.sources.staging import Steps, stage

_QTY = "DECIMAL(18,3)"


# --- actual shipments ------------------------------------------------------


#: What the monthly facts of shipments and the lookups before them read.
ACTUAL_COLUMNS = ("customer_name", "sku_code", "sales_date", "shipped_qty", "findings")


def checked_actuals(spark, sf_dir, keep=None):
    """``keep``: the valid rows alone, in steps, of the columns that monthly facts read."""
    typed = data.planning_actuals(spark, sf_dir).withColumn("findings", no_findings())
    typed = with_findings(typed, feeds.actual_rules())
    masters = [f(spark, sf_dir) for f in (data.customer, data.channel, data.sku, data.product)]
    return feeds.resolve_actuals(typed.select(*ACTUAL_COLUMNS) if keep else typed, *masters, keep=keep)


def valid_actuals(spark, sf_dir, keep=None):
    return checked_actuals(spark, sf_dir, keep).filter(feeds.is_clean())


_ACTUAL_FOUND = """actual_found AS (
  SELECT row_number, sales_date, production_date, 'ACTUAL_SALES_STATUS_NOT_APPROVED' AS code, 'document_status' AS field
    FROM actuals WHERE document_status <> '已审核'
  UNION ALL SELECT row_number, sales_date, production_date, 'ACTUAL_SALES_CUSTOMER_UNRESOLVED', 'customer_name' FROM actuals a
    WHERE NOT EXISTS (SELECT 1 FROM m_customer c WHERE c.customer_name = a.customer_name)
  UNION ALL SELECT row_number, sales_date, production_date, 'ACTUAL_SALES_PRODUCT_UNRESOLVED', 'sku_code' FROM actuals a
    WHERE NOT EXISTS (SELECT 1 FROM m_sku k WHERE k.sku_code = a.sku_code AND k.product_id IS NOT NULL))"""


@query(
    "actuals_finding_counts",
    oracle(
        "SELECT code, field, 'ERROR' AS severity, count(*) AS findings, count(DISTINCT row_number) AS affected_rows FROM actual_found GROUP BY ALL",
        _ACTUAL_FOUND,
    ),
)
def actuals_finding_counts(spark, sf_dir):
    return finding_counts(checked_actuals(spark, sf_dir))


@query(
    "actuals_text_typing",
    oracle(
        f"""SELECT code, field, 'ERROR' AS severity, count(*) AS findings, count(DISTINCT row_number) AS affected_rows FROM (
  SELECT row_number, 'ACTUAL_SALES_DATE_INVALID' AS code, 'sales_date' AS field FROM actuals WHERE row_number % 17 = 1
  UNION ALL SELECT row_number, 'ACTUAL_SALES_VALUE_INVALID', 'shipped_qty' FROM actuals WHERE row_number % 17 IN (2, 3)
  UNION ALL SELECT row_number, 'ACTUAL_SALES_PRODUCTION_DATE_INVALID', 'production_date' FROM actuals WHERE row_number % 17 = 4
  UNION ALL SELECT row_number, 'ACTUAL_SALES_REQUIRED_FIELD_MISSING', 'warehouse_name' FROM actuals WHERE row_number % 17 = 5
  UNION ALL SELECT row_number, 'ACTUAL_SALES_STATUS_NOT_APPROVED', 'document_status' FROM actuals WHERE document_status <> '已审核') GROUP BY ALL"""
    ),
)
def actuals_text_typing(spark, sf_dir):
    rows = data.planning_actuals(spark, sf_dir)
    turn = F.col("row_number") % 17
    raw = rows.select(
        "row_number",
        F.when(turn == 1, "2000-02-30").when(turn == 6, F.date_format("sales_date", "yyyy.M.d")).otherwise(F.date_format("sales_date", "yyyyMMdd")).alias("business_date"),
        "customer_name",
        F.concat(F.lit(" "), F.col("document_status")).alias("document_status"),
        "sku_code",
        "sku_name",
        F.when(turn == 2, "abc").when(turn == 3, "").when(turn == 7, "1,234.5").otherwise(F.col("shipped_qty").cast("string")).alias("quantity"),
        F.when(turn == 5, "  ").otherwise(F.col("warehouse_name")).alias("warehouse_name"),
        "batch_no",
        F.when(turn == 4, "soon").otherwise(F.date_format("production_date", "yyyy/MM/dd")).alias("production_day"),
    )
    return finding_counts(feeds.type_actuals(raw))


@query(
    "channel_product_month",
    oracle(
        f"SELECT channel_id, product_id, ship_month AS actual_month, CAST(sum(shipped_qty) AS {_QTY}) AS shipped_qty FROM actual_valid GROUP BY 1, 2, 3"
    ),
)
def channel_product_month(spark, sf_dir):
    return feeds.actual_channel_months(valid_actuals(spark, sf_dir))


@query(
    "product_production_month",
    oracle(
        f"SELECT product_id, production_date, ship_month AS actual_month, CAST(sum(shipped_qty) AS {_QTY}) AS shipped_qty "
        "FROM actual_valid WHERE production_date IS NOT NULL GROUP BY 1, 2, 3"
    ),
)
def product_production_month(spark, sf_dir):
    return feeds.actual_production_months(valid_actuals(spark, sf_dir))


@query(
    "actuals_summary",
    oracle(
        """SELECT (SELECT count(*) FROM actuals) AS total_rows, count(*) AS valid_rows, (SELECT count(*) FROM actual_found) AS blocking_error_count,
  count(production_date) AS production_aggregation_rows, count(*) - count(production_date) AS missing_production_date_rows,
  min(ship_month) AS period_start, max(ship_month) AS period_end, false AS commit_allowed FROM actual_valid""",
        _ACTUAL_FOUND,
    ),
)
def actuals_summary(spark, sf_dir):
    return feeds.actuals_summary(checked_actuals(spark, sf_dir))


# --- inventory -------------------------------------------------------------


def checked_inventory(spark, sf_dir, keep=None):
    """``keep`` stores the stock rows before their lookups."""
    rows = data.inventory_rows(spark, sf_dir, keep)
    typed = (keep(rows) if keep else rows).withColumn("findings", no_findings())
    masters = [f(spark, sf_dir) for f in (data.sku, data.product, data.warehouse_policy)]
    return feeds.resolve_inventory(typed, *masters)


def planning_inventory(spark, sf_dir, keep=None):
    version = F.year("inventory_month") * 100 + F.month("inventory_month")
    return feeds.planning_rows(checked_inventory(spark, sf_dir, keep)).withColumn("dataset_version_id", version.cast("bigint"))


_INV_FOUND = """inv_found AS (
  SELECT i.row_number, CASE WHEN k.sku_status IS DISTINCT FROM 'ACTIVE' THEN 'INVENTORY_ACTIVE_SKU_NOT_FOUND'
      WHEN p.product_status IS DISTINCT FROM 'ACTIVE' THEN 'INVENTORY_VALID_PRODUCT_NOT_FOUND'
      WHEN w.planning_status IS NULL THEN 'INVENTORY_WAREHOUSE_SCOPE_UNCLASSIFIED'
      WHEN w.planning_status <> 'PLANNING_AVAILABLE' THEN 'INVENTORY_NOT_PLANNING_AVAILABLE_EXCLUDED' END AS code
  FROM inventory i LEFT JOIN m_sku k ON k.sku_code = i.sku_code LEFT JOIN m_product p ON p.product_id = k.product_id
  LEFT JOIN policy w ON w.warehouse_name = i.warehouse_name)"""


@query(
    "inventory_finding_counts",
    oracle(
        """SELECT code, CASE WHEN code LIKE '%SKU%' OR code LIKE '%PRODUCT%' THEN 'sku_code' ELSE 'warehouse_name' END AS field,
  CASE WHEN code LIKE '%EXCLUDED' THEN 'WARNING' ELSE 'ERROR' END AS severity, count(*) AS findings, count(DISTINCT row_number) AS affected_rows
FROM inv_found WHERE code IS NOT NULL GROUP BY 1, 2, 3""",
        _INV_FOUND,
    ),
)
def inventory_finding_counts(spark, sf_dir):
    return finding_counts(checked_inventory(spark, sf_dir))


@query(
    "inventory_balance_findings",
    oracle(
        """SELECT code, field, 'ERROR' AS severity, count(*) AS findings, count(DISTINCT row_number) AS affected_rows FROM (
  SELECT row_number, 'INVENTORY_BALANCE_MISMATCH' AS code, NULL AS field FROM inventory WHERE (row_number % 13 = 1 AND opening_qty <> 0)
    OR (row_number % 13 = 2 AND ending_qty <> -1) OR row_number % 13 IN (6, 7, 9, 10)
  UNION ALL SELECT row_number, 'INVENTORY_BALANCE_QUANTITY_NEGATIVE', 'ending_qty' FROM inventory WHERE row_number % 13 = 2
  UNION ALL SELECT row_number, 'INVENTORY_BALANCE_QUANTITY_NEGATIVE', 'opening_qty' FROM inventory WHERE row_number % 13 = 6
  UNION ALL SELECT row_number, 'INVENTORY_VALUE_NOT_STORABLE', 'receipt_qty' FROM inventory WHERE row_number % 13 = 10
  UNION ALL SELECT row_number, 'INVENTORY_REQUIRED_FIELD_MISSING', 'batch_no' FROM inventory WHERE row_number % 13 = 3
  UNION ALL SELECT row_number, 'INVENTORY_VALUE_INVALID', 'production_date' FROM inventory WHERE row_number % 13 = 4
  UNION ALL SELECT row_number, 'INVENTORY_VALUE_INVALID', 'receipt_qty' FROM inventory WHERE row_number % 13 = 5) GROUP BY ALL"""
    ),
)
def inventory_balance_findings(spark, sf_dir):
    rows = data.inventory_rows(spark, sf_dir)
    turn = F.col("row_number") % 13
    day = F.date_format("production_date", "yyyy-MM-dd")

    def fine(name):
        """The same number and 10^-22."""
        return F.concat(F.col(name).cast("string"), F.lit("0000000000000000001"))

    raw = rows.select(
        "row_number",
        "sku_code",
        F.lit("Item").alias("sku_name"),
        "warehouse_name",
        F.when(turn == 4, "2000-13-01").otherwise(day).alias("production_day"),
        day.alias("expiry_day"),
        F.when(turn == 3, "").otherwise("LOT").alias("batch_no"),
        F.lit("Pcs").alias("inventory_unit"),
        F.when(turn == 1, " ").when(turn == 6, "-1e-19").when(turn == 8, fine("opening_qty")).otherwise(F.col("opening_qty").cast("string")).alias("opening"),
        F.when(turn == 5, "n/a").when(turn == 10, "1.50e2147483647").otherwise(F.col("receipt_qty").cast("string")).alias("receipt"),
        F.when(turn == 9, "1.5e-2147483648").otherwise(F.col("issue_qty").cast("string")).alias("issue"),
        F.when(turn == 2, "-1").when((turn == 7) | (turn == 8), fine("ending_qty")).otherwise(F.col("ending_qty").cast("string")).alias("ending"),
    )
    typed = feeds.type_inventory(raw)
    return finding_counts(with_findings(typed, feeds.inventory_balance_rules(typed)))


_SUMS = ", ".join(f"CAST(sum({c}) AS {_QTY}) AS {c}" for c in feeds.BALANCE)


@query(
    "inventory_sku_month",
    oracle(f"SELECT inventory_month, sku_id, product_id, {_SUMS}, 'policy-1' AS warehouse_policy_version FROM inv_plan GROUP BY 1, 2, 3"),
)
def inventory_sku_month(spark, sf_dir):
    return feeds.inventory_months(planning_inventory(spark, sf_dir), ["sku_id", "product_id"])


@query(
    "inventory_product_month",
    oracle(f"SELECT inventory_month, product_id, {_SUMS}, 'policy-1' AS warehouse_policy_version FROM inv_plan GROUP BY 1, 2"),
)
def inventory_product_month(spark, sf_dir):
    return feeds.inventory_months(planning_inventory(spark, sf_dir), ["product_id"])


@query(
    "inventory_summary",
    oracle(
        """SELECT inventory_month, count(*) AS total_rows, count(*) FILTER (ok) AS valid_rows, count(*) FILTER (NOT ok) AS blocking_error_count,
  count(*) FILTER (code LIKE '%EXCLUDED') + 2 AS warning_count, count(*) FILTER (code IS NULL) AS planning_available_rows,
  count(*) FILTER (code LIKE '%EXCLUDED') AS excluded_warehouse_rows, count(*) FILTER (code IS NULL) AS derived_fact_candidate_rows,
  count(*) FILTER (code IS NULL) AS lifecycle_candidate_rows
FROM (SELECT inventory_month, code, code IS NULL OR code LIKE '%EXCLUDED' AS ok FROM inventory JOIN inv_found USING (row_number)) GROUP BY 1""",
        _INV_FOUND,
    ),
)
def inventory_summary(spark, sf_dir):
    return feeds.inventory_summary(checked_inventory(spark, sf_dir), "inventory_month")


@query(
    "inventory_batch_findings",
    oracle(
        """SELECT batch_id, unnest(CASE WHEN batch_id % 3 = 0 THEN ['INVENTORY_PERIOD_NOT_COMPLETE_MONTH'] ELSE [] END ||
  CASE WHEN batch_id % 4 = 0 THEN ['INVENTORY_PLANNING_POLICY_VERSION_REQUIRED'] ELSE [] END) AS code
FROM (SELECT DISTINCT year(inventory_month) * 100 + month(inventory_month) AS batch_id FROM inventory)"""
    ),
)
def inventory_batch_findings(spark, sf_dir):
    batch = (F.year("inventory_month") * 100 + F.month("inventory_month")).cast("bigint")
    counted = data.inventory_rows(spark, sf_dir).groupBy("inventory_month").agg(F.count(F.lit(1)).alias("row_count"))
    batches = counted.select(
        batch.alias("batch_id"),
        F.col("inventory_month").alias("period_start"),
        F.when(batch % 3 == 0, F.col("inventory_month")).otherwise(F.last_day("inventory_month")).alias("period_end"),
        F.when(batch % 4 == 0, F.lit(" ")).otherwise("v1").alias("policy_version"),
        "row_count",
    )
    return feeds.inventory_batch_findings(batches)


# --- incoming --------------------------------------------------------------


def checked_incoming(spark, sf_dir):
    typed = data.incoming_rows(spark, sf_dir).withColumn("findings", no_findings())
    return feeds.resolve_incoming(typed, data.sku(spark, sf_dir), data.product(spark, sf_dir))


def valid_incoming(spark, sf_dir):
    return checked_incoming(spark, sf_dir).filter(feeds.is_clean())


@query(
    "incoming_text_typing",
    oracle(
        """SELECT code, field, 'ERROR' AS severity, count(*) AS findings, count(DISTINCT row_number) AS affected_rows FROM (
  SELECT row_number, 'INCOMING_QUANTITY_INVALID' AS code, 'shipment_qty' AS field FROM incoming WHERE row_number % 19 = 1
  UNION ALL SELECT row_number, 'INCOMING_QUANTITY_NEGATIVE', 'shipment_qty' FROM incoming WHERE row_number % 19 IN (2, 5)
  UNION ALL SELECT row_number, 'INCOMING_QUANTITY_NOT_STORABLE', 'shipment_qty' FROM incoming WHERE row_number % 19 = 6
  UNION ALL SELECT row_number, 'INCOMING_ETA_INVALID', 'eta' FROM incoming WHERE row_number % 19 = 3
  UNION ALL SELECT row_number, 'INCOMING_SKU_REQUIRED', 'sku_code' FROM incoming WHERE row_number % 19 = 4
  UNION ALL SELECT row_number, 'INCOMING_PRODUCT_UNRESOLVED', 'sku_code' FROM incoming i WHERE row_number % 19 = 4
    OR NOT EXISTS (SELECT 1 FROM m_sku k WHERE k.sku_code = i.sku_code AND k.product_id IS NOT NULL)) GROUP BY ALL"""
    ),
)
def incoming_text_typing(spark, sf_dir):
    turn = F.col("row_number") % 19
    rows = data.incoming_rows(spark, sf_dir)
    raw = rows.select(
        "source_sheet_name",
        "row_number",
        F.when(turn != 4, F.concat(F.lit("　"), F.col("sku_code"))).alias("sku_code"),
        F.lit("Item").alias("sku_name"),
        "order_group",
        "order_no",
        F.when(turn == 1, "??")
        .when(turn == 2, "-3")
        .when(turn == 5, "-1e-19")
        .when(turn == 6, "1.50e2147483647")
        .when(turn == 7, "1.5e-2147483648")
        .otherwise(F.col("shipment_qty").cast("string")).alias("shipment_qty"),
        F.lit(None).cast("string").alias("order_qty"),
        F.lit("").alias("shipped_total"),
        F.lit("1,000").alias("difference_qty"),
        F.lit(None).cast("string").alias("batch_no"),
        F.when(turn == 3, "next week").otherwise(F.date_format("eta", "yyyy-MM-dd")).alias("eta"),
        F.when(F.col("warehouse_entry_recorded"), "2000-01-01").alias("warehouse_entry"),
    )
    return finding_counts(feeds.resolve_incoming(feeds.type_incoming(raw), data.sku(spark, sf_dir), data.product(spark, sf_dir)))


@query(
    "inherited_quantities",
    oracle(
        """SELECT row_number, order_group, order_no, sku_code, last_value(order_qty IGNORE NULLS) OVER (PARTITION BY source_sheet_name, order_group,
  order_no, sku_code ORDER BY row_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS order_qty FROM incoming"""
    ),
)
def inherited_quantities(spark, sf_dir):
    rows = feeds.inherit_quantities(data.incoming_rows(spark, sf_dir), block_rows=1 << 57)
    return rows.select("row_number", "order_group", "order_no", "sku_code", "order_qty")


@query(
    "future_supply",
    oracle(
        f"SELECT product_id, CAST(sum(shipment_qty) AS {_QTY}) AS incoming_qty FROM incoming_valid "
        "WHERE shipment_qty IS NOT NULL AND NOT warehouse_entry_recorded GROUP BY 1"
    ),
)
def future_supply(spark, sf_dir):
    return feeds.future_supply(valid_incoming(spark, sf_dir))


@query(
    "incoming_summary",
    oracle(
        f"""SELECT (SELECT count(*) FROM incoming) AS total_rows, count(*) AS valid_rows,
  (SELECT count(*) FROM incoming) - count(*) AS blocking_error_count, count(shipment_qty) AS shipment_rows,
  count(*) FILTER (shipment_qty IS NOT NULL AND NOT warehouse_entry_recorded) AS current_future_supply_rows,
  count(*) FILTER (shipment_qty IS NOT NULL AND warehouse_entry_recorded) AS entered_shipment_rows,
  count(*) FILTER (shipment_qty IS NULL) AS unshipped_rows,
  CAST(sum(shipment_qty) FILTER (NOT warehouse_entry_recorded) AS {_QTY}) AS current_future_supply_qty FROM incoming_valid"""
    ),
)
def incoming_summary(spark, sf_dir):
    return feeds.incoming_summary(checked_incoming(spark, sf_dir))


# --- lots ------------------------------------------------------------------

_LOTS = [
    f"""lot_month AS (SELECT product_id, production_date, inventory_month, {_SUMS},
  CAST(year(inventory_month) * 100 + month(inventory_month) AS BIGINT) AS dataset_version_id, 'policy-1' AS policy_version, false AS mixed
  FROM inv_plan GROUP BY 1, 2, 3)""",
    """lot_agg AS (SELECT product_id, production_date, min_by(opening_qty, inventory_month) > 0 AS existing,
  min(inventory_month) FILTER (receipt_qty > 0) AS receipt, max(inventory_month) FILTER (ending_qty <> 0) AS stocked,
  max(inventory_month) AS last_month, count(*) AS observed_months FROM lot_month GROUP BY 1, 2)""",
    """lot_sold AS (SELECT a.*, (SELECT min(m.inventory_month) FROM lot_month m WHERE m.product_id = a.product_id
  AND m.production_date = a.production_date AND (a.stocked IS NULL OR m.inventory_month > a.stocked)) AS sold FROM lot_agg a)""",
    """lot AS (SELECT product_id, production_date, observed_months,
  CASE WHEN sold IS NOT NULL THEN 'SOLD_OUT' WHEN existing THEN 'PRE_EXISTING' ELSE 'ACTIVE' END AS lifecycle_state,
  CASE WHEN NOT existing THEN receipt END AS first_inbound_month, sold AS final_sold_out_month,
  CAST(CASE WHEN NOT existing THEN (year(sold) - year(receipt)) * 12 + month(sold) - month(receipt) + 1 END AS INTEGER) AS consumption_months
  FROM lot_sold WHERE existing OR receipt IS NOT NULL)""",
]


def lot_results(spark, sf_dir):
    return lots.lifecycles(lots.lot_months(planning_inventory(spark, sf_dir)))


@query("lot_months", oracle("SELECT * FROM lot_month", *_LOTS))
def lot_months(spark, sf_dir):
    return lots.lot_months(planning_inventory(spark, sf_dir))


@query("lot_lifecycle", oracle("SELECT * FROM lot", *_LOTS))
def lot_lifecycle(spark, sf_dir):
    return lot_results(spark, sf_dir).select(
        *lots.LOT,
        F.size("observations").cast("bigint").alias("observed_months"),
        "lifecycle_state",
        "first_inbound_month",
        "final_sold_out_month",
        "consumption_months",
    )


@query(
    "lot_return_policy",
    oracle(
        "SELECT product_id, production_date, CASE WHEN observed_months >= 6 THEN 'RETURN_REVIEW' END AS classification, "
        "CASE WHEN observed_months >= 6 THEN 'SLOW' END AS policy_code FROM lot",
        *_LOTS,
    ),
)
def lot_return_policy(spark, sf_dir):
    def slow(observations):
        parameters = F.create_map(F.lit("months"), F.lit("6"))
        decision = F.struct(
            F.lit("RETURN_REVIEW").alias("classification"),
            F.lit("SLOW").alias("policy_code"),
            F.lit("1").alias("policy_version"),
            parameters.alias("policy_parameters"),
        )
        return F.when(F.size(observations) >= 6, decision)

    decided = lots.with_return_policy(lot_results(spark, sf_dir), slow)
    return decided.select(*lots.LOT, "return_decision.classification", "return_decision.policy_code")


@query(
    "lot_source_findings",
    oracle(
        """SELECT 'SEVERAL_VERSIONS_FOR_MONTH' AS code, CAST(inventory_month AS VARCHAR) AS subject
FROM (SELECT DISTINCT inventory_month FROM inventory) WHERE month(inventory_month) = 7
UNION ALL SELECT 'VERSION_SELECTED_TWICE', CAST(year(inventory_month) * 100 + month(inventory_month) AS VARCHAR)
FROM (SELECT DISTINCT inventory_month FROM inventory) WHERE month(inventory_month) = 8"""
    ),
)
def lot_source_findings(spark, sf_dir):
    months = data.inventory_rows(spark, sf_dir).select("inventory_month").distinct()
    version = (F.year("inventory_month") * 100 + F.month("inventory_month")).cast("bigint")
    again = (
        F.when(F.month("inventory_month") == 7, F.array(version, version + 1_000_000))
        .when(F.month("inventory_month") == 8, F.array(version, version))
        .otherwise(F.array(version))
    )
    return lots.source_findings(months.select("inventory_month", F.explode(again).alias("dataset_version_id")))


def stored_revisions(spark, sf_dir):
    """Earlier revisions: lots of odd products as seen in all but their newest month, the others as they are."""
    months = stage(lots.lot_months(planning_inventory(spark, sf_dir)))
    newest = months.groupBy("product_id", "production_date").agg(F.max("inventory_month").alias("_newest"))
    seen = (F.col("product_id") % 2 == 0) | (F.col("inventory_month") < F.col("_newest"))
    earlier = months.join(newest, ["product_id", "production_date"]).filter(seen).drop("_newest")
    results = lots.with_return_policy(lots.lifecycles(earlier), None)
    return results.withColumn("provenance", lots.provenance()).withColumn("revision_no", F.lit(1))


@query(
    "lot_revisions",
    oracle(
        """SELECT l.product_id, l.production_date, CASE WHEN o.product_id IS NOT NULL AND changed THEN 2 ELSE 1 END AS revision_no, o.product_id IS NULL OR changed AS created
FROM lot l LEFT JOIN (SELECT m.product_id, m.production_date, m.product_id % 2 = 1 AS changed FROM lot_month m JOIN lot_agg a USING (product_id, production_date)
  WHERE m.product_id % 2 = 0 OR inventory_month < last_month GROUP BY 1, 2
  HAVING min_by(opening_qty, inventory_month) > 0 OR count(*) FILTER (receipt_qty > 0) > 0) o USING (product_id, production_date)""",
        *_LOTS,
    ),
)
def lot_revisions(spark, sf_dir):
    results = lots.with_return_policy(lot_results(spark, sf_dir), None)
    return lots.next_revisions(results, stored_revisions(spark, sf_dir)).select(*lots.LOT, "revision_no", "created")


def lot_evidence(spark, sf_dir):
    """Three revisions per lot: all months, the first ones, the last one."""
    results = lot_results(spark, sf_dir).withColumn("_v", F.col("source_versions"))
    first = F.slice("_v", F.lit(1), F.greatest(F.lit(1), F.size("_v") - 1))
    variants = F.array(
        F.struct(F.lit(1).alias("revision_no"), first.alias("evidence")),
        F.struct(F.lit(2).alias("revision_no"), F.when(F.col("product_id") % 3 == 0, first).otherwise(F.col("_v")).alias("evidence")),
    )
    spread = results.select("*", F.inline(variants))
    number = data.digest_id(F.col("product_id").cast("string"), F.col("production_date").cast("string"), F.col("revision_no").cast("string"))
    return spread.withColumn("revision_id", number).withColumn("created_at", F.lit("2000-06-15").cast("date"))


_EVIDENCE = """evidence AS (
  SELECT product_id, production_date, r AS revision_no, CAST('0x' || substr(md5(concat_ws('|', product_id, production_date, r)), 1, 12) AS BIGINT) AS revision_id,
    CASE WHEN r = 1 OR product_id % 3 = 0 THEN greatest(1, observed_months - 1) ELSE observed_months END AS size, observed_months,
    lifecycle_state, first_inbound_month, final_sold_out_month, consumption_months
  FROM lot, (VALUES (1), (2)) v(r))"""


@query(
    "unambiguous_lot_revision",
    oracle(
        """SELECT product_id, production_date, CASE WHEN count(*) FILTER (size = top) = 1 THEN min(revision_id) FILTER (size = top) END AS revision_id
FROM (SELECT *, max(size) OVER (PARTITION BY product_id, production_date) AS top FROM evidence) GROUP BY 1, 2""",
        *_LOTS,
        _EVIDENCE,
    ),
)
def unambiguous_lot_revision(spark, sf_dir):
    return lots.unambiguous_revisions(lot_evidence(spark, sf_dir))


# --- cycles ----------------------------------------------------------------


def stored_facts(spark, sf_dir, *names):
    """Monthly facts and future supply as their commits would have stored them, and the cycles.
    Each fact is made in steps of its own, of which only the last stays."""
    build = {
        "actuals": lambda keep: feeds.actual_channel_months(valid_actuals(spark, sf_dir, keep)),
        "inventory": lambda keep: feeds.inventory_months(planning_inventory(spark, sf_dir, keep), ["product_id"], "dataset_version_id"),
        "incoming": lambda keep: valid_incoming(spark, sf_dir).select("product_id", "shipment_qty", "eta", "warehouse_entry_recorded", snapshot_of("order_no").alias("incoming_snapshot_id")),
    }
    steps = {name: Steps() for name in names}
    return {name: keep(build[name](keep)) for name, keep in steps.items()} | {"cycles": stage(cycles(spark, sf_dir))}


def month_id(month) -> F.Column:
    return (F.year(month) * 100 + F.month(month)).cast("bigint")


def snapshot_of(number):
    """Supply arrives in three snapshots, dealt by order number; a cycle reads the one of its month."""
    return (F.col(number).cast("bigint") % 3 + 1).cast("bigint")


def cycles(spark, sf_dir, facts=None):
    if facts:
        return facts["cycles"]
    months = data.lines(spark, sf_dir).select(F.trunc("ship_date", "MM").alias("cycle_month")).distinct()
    number = month_id("cycle_month")
    locked = F.year("cycle_month") < 1999
    return months.select(
        number.alias("cycle_id"),
        "cycle_month",
        F.when(locked, "LOCKED").otherwise("OPEN").alias("status"),
        F.when(F.month("cycle_month") != 11, number % 3 + 1).cast("bigint").alias("incoming_snapshot_id"),
        (number * 10 + 1).alias("forecast_version_id"),
        F.when(locked, "planner").alias("locked_by"),
        F.when(locked, F.last_day("cycle_month")).alias("locked_at"),
    )


def bindings(spark, sf_dir, facts=None):
    frame = cycles(spark, sf_dir, facts)
    month = F.month("cycle_month")

    def entry(version, start, when=None):
        value = F.struct(version.alias("dataset_version_id"), start.alias("period_start"), start.alias("period_end"))
        return value if when is None else F.when(when, value)

    def back(n):
        return F.add_months("cycle_month", -n)

    entries = [
        entry(month_id(back(1)), back(1), month != 5),
        entry(month_id(back(2)), back(2)),
        entry(month_id(back(3)), back(3)),
        entry(month_id(back(1)) + 1_000_000, back(1), month == 7),
        entry(month_id(back(1)) + 2_000_000, back(1)),
    ]
    listed = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return frame.select("cycle_id", F.inline(listed))


def versions(spark, sf_dir, facts=None):
    months = cycles(spark, sf_dir, facts).select(F.col("cycle_month").alias("m"))
    kinds = F.array(
        *[
            F.struct((month_id("m") + add).alias("dataset_version_id"), F.lit(kind).alias("dataset_type"))
            for add, kind in ((0, "INVENTORY"), (1_000_000, "INVENTORY"), (2_000_000, "ACTUAL"))
        ]
    )
    return months.select(F.inline(kinds), "m").select("dataset_version_id", "dataset_type", F.col("m").alias("period_start"), F.col("m").alias("period_end"))


def forecast_lines(spark, sf_dir, facts):
    """Last year's shipments as forecast of every cycle whose horizon holds the month."""
    last_year = facts["actuals"].filter("shipped_qty > 0")
    spread = last_year.select(
        "channel_id", "product_id", F.add_months("actual_month", 12).alias("forecast_month"), F.col("shipped_qty").alias("forecast_qty"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("n")
    )
    number = month_id(F.add_months("forecast_month", -F.col("n")))
    keyed = spread.select((number).alias("cycle_id"), (number * 10 + 1).alias("forecast_version_id"), "channel_id", "product_id", "forecast_month", "forecast_qty")
    return keyed.join(cycles(spark, sf_dir, facts).select("cycle_id"), "cycle_id", "left_semi")


def final_orders(spark, sf_dir, facts):
    """A cycle's order per product: its forecast for the cycle's own month."""
    own = forecast_lines(spark, sf_dir, facts).filter(month_id("forecast_month") == F.col("cycle_id"))
    return own.groupBy("cycle_id", "product_id").agg(F.sum("forecast_qty").cast("decimal(18,3)").alias("order_qty")).withColumn(
        "status", F.when(F.col("product_id") % 2 == 0, "CONFIRMED").otherwise("UNCONFIRMED")
    )


def product_month_fact(spark, sf_dir, facts):
    return facts["inventory"]


def actual_month_fact(spark, sf_dir, facts):
    return facts["actuals"].withColumn("dataset_version_id", month_id("actual_month") + 2_000_000)


def supply_lines(spark, sf_dir, facts):
    return facts["incoming"]


def buckets(spark, sf_dir, facts):
    return cycle.incoming_buckets(cycles(spark, sf_dir, facts), supply_lines(spark, sf_dir, facts))


def cycle_products(spark, sf_dir, facts):
    supply = cycles(spark, sf_dir, facts).select("cycle_id", "incoming_snapshot_id").join(
        supply_lines(spark, sf_dir, facts).select("incoming_snapshot_id", "product_id").distinct(), "incoming_snapshot_id"
    )
    return cycle.workbench_products(
        bindings(spark, sf_dir, facts),
        versions(spark, sf_dir, facts),
        product_month_fact(spark, sf_dir, facts),
        actual_month_fact(spark, sf_dir, facts),
        supply,
        forecast_lines(spark, sf_dir, facts),
        final_orders(spark, sf_dir, facts),
    )


def cycle_channels(spark, sf_dir, facts):
    """A cycle lists the channels that forecast anything in it."""
    return forecast_lines(spark, sf_dir, facts).select("cycle_id", "channel_id").distinct()


def cells(spark, sf_dir, facts):
    return cycle.forecast_cells(cycles(spark, sf_dir, facts), forecast_lines(spark, sf_dir, facts))


def grid(spark, sf_dir, facts):
    return cycle.forecast_grid(cells(spark, sf_dir, facts), cycle_products(spark, sf_dir, facts), cycle_channels(spark, sf_dir, facts))


_CYCLES = [
    """cyc AS (SELECT DISTINCT CAST(year(ship_month) * 100 + month(ship_month) AS BIGINT) AS cycle_id, ship_month AS cycle_month,
  CASE WHEN year(ship_month) < 1999 THEN 'LOCKED' ELSE 'OPEN' END AS status, CASE WHEN month(ship_month) <> 11 THEN (year(ship_month) * 100 + month(ship_month)) % 3 + 1 END AS snapshot FROM order_line)""",
    """bind AS (SELECT cycle_id, CAST(b AS DATE) AS period_start, CAST(year(b) * 100 + month(b) + add AS BIGINT) AS dataset_version_id FROM (
  SELECT cycle_id, cycle_month - INTERVAL 1 MONTH AS b, 0 AS add FROM cyc WHERE month(cycle_month) <> 5
  UNION ALL SELECT cycle_id, cycle_month - INTERVAL 2 MONTH, 0 FROM cyc UNION ALL SELECT cycle_id, cycle_month - INTERVAL 3 MONTH, 0 FROM cyc
  UNION ALL SELECT cycle_id, cycle_month - INTERVAL 1 MONTH, 1000000 FROM cyc WHERE month(cycle_month) = 7
  UNION ALL SELECT cycle_id, cycle_month - INTERVAL 1 MONTH, 2000000 FROM cyc))""",
    """vers AS (SELECT cycle_id + add AS dataset_version_id, CASE WHEN add = 2000000 THEN 'ACTUAL' ELSE 'INVENTORY' END AS dataset_type, cycle_month AS m
  FROM cyc, (VALUES (0), (1000000), (2000000)) v(add))""",
    """states AS (SELECT c.cycle_id, cycle_month, CAST(cycle_month - INTERVAL 1 MONTH AS DATE) AS baseline_month,
  CASE WHEN count(v.dataset_version_id) = 0 THEN 'Baseline Missing' WHEN count(DISTINCT v.dataset_version_id) > 1 THEN 'Baseline Conflict' ELSE 'Ready' END AS baseline_state,
  CASE WHEN count(DISTINCT v.dataset_version_id) = 1 THEN min(v.dataset_version_id) END AS baseline_version_id
  FROM cyc c LEFT JOIN bind b ON b.cycle_id = c.cycle_id AND b.period_start = cycle_month - INTERVAL 1 MONTH
  LEFT JOIN vers v ON v.dataset_version_id = b.dataset_version_id AND v.dataset_type = 'INVENTORY' GROUP BY 1, 2)""",
    f"""prod_month AS (SELECT inventory_month, product_id, CAST(sum(ending_qty) AS {_QTY}) AS ending_qty FROM inv_plan GROUP BY 1, 2)""",
    """opening AS (SELECT cycle_id, product_id, ending_qty AS opening_qty FROM states JOIN prod_month ON inventory_month = baseline_month
  WHERE baseline_state = 'Ready')""",
    f"""bucket AS (SELECT cycle_id, product_id, {", ".join(f"CAST(coalesce(sum(q) FILTER (em = cycle_month + INTERVAL {n} MONTH), 0) AS {_QTY}) AS incoming_{n}" for n in range(4))},
  CAST(coalesce(sum(q) FILTER (em IS NULL), 0) AS {_QTY}) AS unscheduled, CAST(coalesce(sum(q) FILTER (em < cycle_month), 0) AS {_QTY}) AS overdue
  FROM cyc JOIN (SELECT CAST(order_no AS BIGINT) % 3 + 1 AS snapshot, product_id, date_trunc('month', eta) AS em, sum(shipment_qty) AS q FROM incoming_valid
    WHERE shipment_qty IS NOT NULL AND NOT warehouse_entry_recorded GROUP BY 1, 2, 3) USING (snapshot) GROUP BY 1, 2)""",
    f"""acm AS (SELECT channel_id, product_id, ship_month, CAST(sum(shipped_qty) AS {_QTY}) AS qty FROM actual_valid GROUP BY 1, 2, 3)""",
    """fc AS (SELECT cycle_id, cycle_month, channel_id, product_id, CAST(ship_month + INTERVAL 12 MONTH AS DATE) AS forecast_month, qty AS forecast_qty
  FROM acm JOIN cyc ON ship_month + INTERVAL 12 MONTH BETWEEN cycle_month AND cycle_month + INTERVAL 3 MONTH WHERE qty > 0)""",
    f"""ord AS (SELECT cycle_id, product_id, CAST(sum(forecast_qty) AS {_QTY}) AS order_qty,
  CASE WHEN product_id % 2 = 0 THEN 'CONFIRMED' ELSE 'UNCONFIRMED' END AS status FROM fc WHERE forecast_month = cycle_month GROUP BY 1, 2)""",
    """wp AS (SELECT cycle_id, product_id FROM fc UNION SELECT cycle_id, product_id FROM ord
  UNION SELECT cycle_id, product_id FROM cyc JOIN (SELECT DISTINCT CAST(order_no AS BIGINT) % 3 + 1 AS snapshot, product_id FROM incoming_valid) USING (snapshot)
  UNION SELECT cycle_id, product_id FROM bind b JOIN vers v USING (dataset_version_id) JOIN prod_month ON inventory_month = period_start
    WHERE dataset_type = 'INVENTORY' AND dataset_version_id < 1000000
  UNION SELECT cycle_id, product_id FROM bind b JOIN vers v USING (dataset_version_id) JOIN acm ON ship_month = period_start WHERE dataset_type = 'ACTUAL')""",
    f"""grid AS (SELECT w.cycle_id, w.product_id, h.channel_id, {", ".join(f"max(forecast_qty) FILTER (forecast_month = cycle_month + INTERVAL {n} MONTH) AS forecast_{n}" for n in range(4))}
  FROM wp w JOIN (SELECT DISTINCT cycle_id, channel_id FROM fc) h USING (cycle_id) LEFT JOIN fc f ON f.cycle_id = w.cycle_id AND f.product_id = w.product_id AND f.channel_id = h.channel_id GROUP BY 1, 2, 3)""",
    f"""totals AS (SELECT cycle_id, product_id, {", ".join(f"CAST(CASE WHEN count(forecast_{n}) = count(*) THEN sum(forecast_{n}) END AS {_QTY}) AS forecast_{n}" for n in range(4))}
  FROM grid GROUP BY 1, 2)""",
]


@query(
    "binding_validity",
    oracle(
        """SELECT cycle_id, b.dataset_version_id, period_start, v.dataset_type, CASE WHEN v.dataset_version_id IS NULL THEN 'VERSION_MISSING' ELSE 'VALID' END AS binding_state
FROM bind b LEFT JOIN vers v USING (dataset_version_id)""",
        *_CYCLES,
    ),
)
def binding_validity(spark, sf_dir):
    checked = cycle.binding_validity(bindings(spark, sf_dir), versions(spark, sf_dir))
    return checked.select("cycle_id", "dataset_version_id", "period_start", "dataset_type", "binding_state")


@query(
    "binding_overlaps",
    oracle(
        "SELECT cycle_id, dataset_type, period_start AS month, count(*) AS bindings FROM bind JOIN vers USING (dataset_version_id) GROUP BY ALL HAVING count(*) > 1",
        *_CYCLES,
    ),
)
def binding_overlaps(spark, sf_dir):
    return cycle.overlapping_months(bindings(spark, sf_dir), versions(spark, sf_dir), same_version_allowed=False)


@query("baseline_states", oracle("SELECT * FROM states", *_CYCLES))
def baseline_states(spark, sf_dir, facts=None):
    return cycle.baseline_states(*(f(spark, sf_dir, facts) for f in (cycles, bindings, versions)))


@query("workbench_opening", oracle("SELECT * FROM opening", *_CYCLES))
def workbench_opening(spark, sf_dir):
    facts = stored_facts(spark, sf_dir, "inventory")
    return cycle.openings(baseline_states(spark, sf_dir, facts), product_month_fact(spark, sf_dir, facts))


@query("incoming_buckets", oracle("SELECT * FROM bucket", *_CYCLES))
def incoming_buckets(spark, sf_dir):
    facts = stored_facts(spark, sf_dir, "incoming")
    return buckets(spark, sf_dir, facts)


@query("workbench_products", oracle("SELECT * FROM wp", *_CYCLES))
def workbench_products(spark, sf_dir):
    facts = stored_facts(spark, sf_dir, "actuals", "inventory", "incoming")
    return cycle_products(spark, sf_dir, facts)


@query("forecast_grid", oracle("SELECT * FROM grid", *_CYCLES))
def forecast_grid(spark, sf_dir):
    facts = stored_facts(spark, sf_dir, "actuals", "inventory", "incoming")
    return grid(spark, sf_dir, facts)


@query(
    "forecast_month_totals",
    oracle("SELECT * FROM totals WHERE (cycle_id, product_id) IN (SELECT (cycle_id, product_id) FROM fc)", *_CYCLES),
)
def forecast_month_totals(spark, sf_dir):
    facts = stored_facts(spark, sf_dir, "actuals")
    return cycle.forecast_totals(cells(spark, sf_dir, facts), cycle_channels(spark, sf_dir, facts))


def product_identity(spark, sf_dir, facts):
    masters = data.product(spark, sf_dir).select("product_id", "product_code", "product_name")
    wanted = stage(cycle_products(spark, sf_dir, facts))
    frozen = wanted.join(masters, "product_id").filter(F.col("product_id") % 10 != 0).withColumn("product_name", F.concat(F.lit("Frozen "), F.col("product_name")))
    return cycle.identities(cycles(spark, sf_dir, facts), wanted, masters, frozen, "product_id")


@query(
    "cycle_identity",
    oracle(
        """SELECT w.cycle_id, w.product_id, CASE WHEN NOT gap THEN product_code END AS product_code,
  CASE WHEN gap THEN NULL WHEN status = 'LOCKED' THEN 'Frozen ' || product_name ELSE product_name END AS product_name, gap AS identity_missing
FROM (SELECT w.*, status, status = 'LOCKED' AND product_id % 10 = 0 AS gap FROM wp w JOIN cyc USING (cycle_id)) w JOIN m_product USING (product_id)""",
        *_CYCLES,
    ),
)
def cycle_identity(spark, sf_dir):
    facts = stored_facts(spark, sf_dir, "actuals", "inventory", "incoming")
    return product_identity(spark, sf_dir, facts)


_INCOMING = ", ".join(f"CASE WHEN snapshot IS NOT NULL THEN coalesce(incoming_{n}, 0) END AS incoming_{n}" for n in range(4))
_PROJECTED = ", ".join(
    "CAST(opening_qty" + "".join(f" + incoming_{i} - forecast_{i}" for i in range(n + 1)) + f" AS {_QTY}) AS projected_{n}" for n in range(4)
)


@query(
    "four_month_projection",
    oracle(
        f"""SELECT *, {_PROJECTED} FROM (SELECT w.cycle_id, w.product_id, cycle_month, product_code, product_name, opening_qty, {_INCOMING},
  CASE WHEN snapshot IS NOT NULL THEN coalesce(unscheduled, 0) END AS unscheduled, CASE WHEN snapshot IS NOT NULL THEN coalesce(overdue, 0) END AS overdue,
  forecast_0, forecast_1, forecast_2, forecast_3, order_qty, coalesce(o.status, 'Missing') AS confirmation
FROM wp w JOIN cyc USING (cycle_id) LEFT JOIN m_product USING (product_id) LEFT JOIN opening USING (cycle_id, product_id)
LEFT JOIN bucket USING (cycle_id, product_id) LEFT JOIN totals USING (cycle_id, product_id) LEFT JOIN ord o USING (cycle_id, product_id))""",
        *_CYCLES,
    ),
)
def four_month_projection(spark, sf_dir):
    """The workbench: identity, opening, supply, forecast, order, projection."""
    facts = stored_facts(spark, sf_dir, "actuals", "inventory", "incoming")
    products = stage(cycle_products(spark, sf_dir, facts))
    masters = data.product(spark, sf_dir).select("product_id", "product_code", "product_name")
    identity = products.join(masters, "product_id")
    return cycle.workbench_rows(
        cycles(spark, sf_dir, facts),
        products,
        identity,
        cycle.openings(baseline_states(spark, sf_dir, facts), product_month_fact(spark, sf_dir, facts)),
        buckets(spark, sf_dir, facts),
        cycle.forecast_totals(cells(spark, sf_dir, facts), cycle_channels(spark, sf_dir, facts)),
        final_orders(spark, sf_dir, facts),
    )


@query(
    "sku_reconciliation",
    oracle(
        f"""SELECT s.inventory_month, s.product_id, s.sku_total, p.ending_qty + CASE WHEN p.product_id % 7 = 0 THEN 1 ELSE 0 END AS product_total,
  p.product_id % 7 <> 0 AS reconciled FROM (SELECT inventory_month, product_id, CAST(sum(ending_qty) AS {_QTY}) AS sku_total FROM inv_plan GROUP BY 1, 2) s
JOIN prod_month p USING (inventory_month, product_id)""",
        *_CYCLES,
    ),
)
def sku_reconciliation(spark, sf_dir):
    return _reconciliation(spark, sf_dir)


def _reconciliation(spark, sf_dir):
    sku_month = feeds.inventory_months(planning_inventory(spark, sf_dir), ["sku_id", "product_id"])
    product_month = feeds.inventory_months(planning_inventory(spark, sf_dir), ["product_id"])
    drifted = product_month.withColumn("ending_qty", (F.col("ending_qty") + F.when(F.col("product_id") % 7 == 0, 1).otherwise(0)).cast("decimal(18,3)"))
    return cycle.sku_reconciliation(sku_month, drifted, "inventory_month")


@query(
    "sku_stock_shares",
    oracle(
        f"""SELECT s.*, CASE WHEN product_id % 7 <> 0 THEN CAST(round_even(s.ending_qty * 100 / p.ending_qty, 2) AS DECIMAL(18,2)) END AS proportion
FROM (SELECT inventory_month, product_id, sku_id, CAST(sum(ending_qty) AS {_QTY}) AS ending_qty FROM inv_plan GROUP BY 1, 2, 3) s
JOIN prod_month p USING (inventory_month, product_id) WHERE s.ending_qty <> 0""",
        *_CYCLES,
    ),
)
def sku_stock_shares(spark, sf_dir):
    sku_month = feeds.inventory_months(planning_inventory(spark, sf_dir), ["sku_id", "product_id"])
    return cycle.sku_shares(sku_month, _reconciliation(spark, sf_dir), "inventory_month")


@query(
    "order_revision_chain",
    oracle(
        f"""SELECT l_orderkey AS cycle_id, 1 AS product_id, l_linenumber AS revision_no, qty AS from_qty,
  coalesce(lead(qty) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), CAST(l_orderkey % 100 AS {_QTY})) AS to_qty
FROM (SELECT l_orderkey, l_linenumber, CAST(sum(qty) AS {_QTY}) AS qty FROM line GROUP BY 1, 2)"""
    ),
)
def order_revision_chain(spark, sf_dir):
    lines = data.lines(spark, sf_dir)
    revisions = lines.groupBy(F.col("l_orderkey").alias("cycle_id"), F.lit(1).alias("product_id"), F.col("l_linenumber").alias("revision_no")).agg(
        F.sum("qty").cast("decimal(18,3)").alias("order_qty")
    )
    orders = data.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("cycle_id"), F.lit(1).alias("product_id"), (F.col("o_orderkey") % 100).cast("decimal(18,3)").alias("order_qty")
    )
    return cycle.revision_chain(revisions, orders, block_rows=4)
