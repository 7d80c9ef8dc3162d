"""Commits of checked deliveries: verdicts, the rows of every table, counts.

Each feed is delivered in twelve-month turns: the delivery of a January has a
checksum in capitals, of a February a key that is taken, of a March a source
that was imported before, of a September the key of the delivery before it;
June and December come with their faulty rows, which block them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.operators import planning_feeds as feeds
from stockweave.operators import sales_feed, sinks
from stockweave.plans import standins as data
from stockweave.plans.master_queries import _CUSTOMER, evaluated_customers
from stockweave.plans.planning_queries import _ACTUAL_FOUND, _INV_FOUND, checked_actuals, checked_incoming, checked_inventory, month_id
from stockweave.plans.registry import query
from stockweave.plans.sales_queries import _FOUND, _KEYED, _TYPED, checked_rows, mapped_rows
from stockweave.plans.standins import oracle
from stockweave.sources.staging import Steps, stage

_QTY = "DECIMAL(18,3)"


def _file_hash(batch):
    return F.sha2(F.concat(F.lit("file "), batch.cast("string")), 256)


def _requests(batches, kind):
    """``batches``: batch_id, turn (1 to 12)."""
    batch, turn = F.col("batch_id"), F.col("turn")
    key = lambda number: F.concat(F.lit(f"{kind}-"), number.cast("string"))
    checksum = _file_hash(batch)
    return batches.select(
        "batch_id",
        batch.alias("request_no"),
        F.when(turn == 2, f"{kind}-taken").when(turn == 9, key(batch - 1)).otherwise(key(batch)).alias("version_key"),
        F.when(turn == 1, F.upper(checksum)).otherwise(checksum).alias("source_checksum"),
        F.lit("export").alias("source_name"),
        F.lit("planner").alias("created_by"),
    )


def _registry(requests, previews, kind):
    """Versions stored before: the taken key, and the sources of every March under other keys."""
    known = requests.join(previews, "batch_id").join(requests.select("batch_id"), "batch_id").filter(F.col("turn") == 3)
    sources = known.select(F.lit(kind).alias("dataset_type"), F.concat(F.lit("old-"), "version_key").alias("version_key"), "period_start", "period_end", "source_checksum")
    taken = requests.filter(F.col("turn") == 2).select(F.lit("OTHER").alias("dataset_type"), "version_key", F.lit(None).cast("date").alias("period_start"), F.lit(None).cast("date").alias("period_end"), F.lit("0").alias("source_checksum"))
    return sources.unionByName(taken)


def _verdicts(previews, turns, kind):
    """``previews``: batch_id, commit_allowed, period; ``turns``: batch_id, turn."""
    asked = _requests(turns, kind)
    registry = _registry(asked.join(turns, "batch_id"), previews, kind)
    return stage(sinks.commit_verdicts(asked, previews, registry, kind))


def _outcome(verdicts, tables):
    """Each request with its verdict and the rows it gave each table."""
    counts = sinks.commit_counts(tables, "dataset_version_id").groupBy("dataset_version_id").agg(*[F.sum(F.when(F.col("table_name") == t, F.col("rows"))).alias(f"{t}_rows") for t in tables])
    return verdicts.select("batch_id", "version_key", "code", "dataset_version_id").join(counts, "dataset_version_id", "left")


def _code_sql(blocked: str, turn: str = "batch_id % 100", before: str = "EXISTS (SELECT 1 FROM raw_batches p WHERE p.batch_id = b.batch_id - 1 AND NOT p.blocked)") -> str:
    return f"CASE WHEN {blocked} THEN 'PREVIEW_BLOCKED' WHEN {turn} = 1 THEN 'CHECKSUM_INVALID' WHEN {turn} = 2 THEN 'VERSION_KEY_EXISTS' WHEN {turn} = 3 THEN 'SOURCE_ALREADY_IMPORTED' WHEN {turn} = 9 AND {before} THEN 'VERSION_KEY_EXISTS' END"


def _verdict_sql(kind: str) -> str:
    """From raw_batches (batch_id, blocked)."""
    key = f"CASE WHEN batch_id % 100 = 2 THEN '{kind}-taken' WHEN batch_id % 100 = 9 THEN '{kind}-' || (batch_id - 1) ELSE '{kind}-' || batch_id END"
    return f"""verdict AS (SELECT batch_id, version_key, code, CASE WHEN code IS NULL THEN sha256('{kind}|' || version_key) END AS dataset_version_id
  FROM (SELECT batch_id, {key} AS version_key, {_code_sql("blocked")} AS code FROM raw_batches b))"""


# --- shipments -------------------------------------------------------------


def delivered_actuals(spark, sf_dir):
    """Checked shipments by month of delivery; faulty rows come in June and December only."""
    values = F.create_map(F.lit("status"), F.col("document_status"), F.lit("quantity"), F.col("shipped_qty").cast("string"))
    rows = checked_actuals(spark, sf_dir).withColumn("batch_id", month_id("sales_date")).withColumn("erp_values", values)
    return rows.filter(feeds.is_clean() | (F.month("sales_date") % 6 == 0)).withColumn("batch_no", F.lit("LOT"))


def actual_commit(spark, sf_dir):
    checked = stage(delivered_actuals(spark, sf_dir))
    previews = feeds.actuals_summary(checked, "batch_id")
    turns = checked.select("batch_id", (F.col("batch_id") % 100).alias("turn")).distinct()
    verdicts = _verdicts(previews, turns, "ACTUAL")
    return verdicts, sinks.actual_tables(checked, verdicts)


_ACTUALS = [
    _ACTUAL_FOUND,
    """delivered AS (SELECT v.*, CAST(year(ship_month) * 100 + month(ship_month) AS BIGINT) AS batch_id FROM actual_valid v)""",
    """raw_batches AS (SELECT b.batch_id, coalesce(f.batch_id IS NOT NULL, false) AS blocked FROM (
  SELECT batch_id FROM delivered UNION SELECT CAST(year(sales_date) * 100 + month(sales_date) AS BIGINT) FROM actual_found WHERE month(sales_date) % 6 = 0) b
  LEFT JOIN (SELECT DISTINCT CAST(year(sales_date) * 100 + month(sales_date) AS BIGINT) AS batch_id FROM actual_found WHERE month(sales_date) % 6 = 0) f USING (batch_id))""",
    _verdict_sql("ACTUAL"),
    "stored AS (SELECT d.*, dataset_version_id FROM delivered d JOIN verdict USING (batch_id) WHERE code IS NULL)",
]


@query(
    "actual_commit_outcome",
    oracle(
        """SELECT verdict.*, v AS dataset_version_rows, r AS actual_raw_rows, c AS actual_channel_product_month_rows, p AS actual_product_production_month_rows
FROM verdict LEFT JOIN (SELECT dataset_version_id, 1 AS v, count(*) AS r, count(DISTINCT (channel_id, product_id, ship_month)) AS c,
  nullif(count(DISTINCT (product_id, production_date, ship_month)) FILTER (production_date IS NOT NULL), 0) AS p FROM stored GROUP BY 1) USING (dataset_version_id)""",
        *_ACTUALS,
    ),
)
def actual_commit_outcome(spark, sf_dir):
    return _outcome(*actual_commit(spark, sf_dir))


@query(
    "actual_commit_raw",
    oracle(
        f"""SELECT dataset_version_id, row_number AS source_row_no, 'NAME:' || customer_name AS erp_customer_code, sku_code AS source_sku_code, customer_id, channel_id, sku_id, product_id,
  sales_date, CAST(shipped_qty AS {_QTY}) AS shipped_qty, 'NAME:' || warehouse_name AS warehouse_code, production_date,
  '{{"source_row_number":' || row_number || ',"erp_values":{{"status":"已审核","quantity":"' || shipped_qty || '"}}}}' AS raw_payload FROM stored""",
        *_ACTUALS,
    ),
)
def actual_commit_raw(spark, sf_dir):
    raw = actual_commit(spark, sf_dir)[1]["actual_raw"]
    return raw.select("dataset_version_id", "source_row_no", "erp_customer_code", "source_sku_code", "customer_id", "channel_id", "sku_id", "product_id", "sales_date", "shipped_qty", "warehouse_code", "production_date", "raw_payload")


@query(
    "actual_commit_facts",
    oracle(
        f"""SELECT dataset_version_id, 'channel' AS fact, channel_id, product_id, NULL::DATE AS production_date, ship_month AS actual_month, CAST(sum(shipped_qty) AS {_QTY}) AS shipped_qty FROM stored GROUP BY ALL
UNION ALL SELECT dataset_version_id, 'production', NULL, product_id, production_date, ship_month, CAST(sum(shipped_qty) AS {_QTY}) FROM stored WHERE production_date IS NOT NULL GROUP BY ALL""",
        *_ACTUALS,
    ),
)
def actual_commit_facts(spark, sf_dir):
    tables = actual_commit(spark, sf_dir)[1]
    columns = ["dataset_version_id", "fact", "channel_id", "product_id", "production_date", "actual_month", "shipped_qty"]
    channel = tables["actual_channel_product_month"].select("*", F.lit("channel").alias("fact"), F.lit(None).cast("date").alias("production_date"))
    production = tables["actual_product_production_month"].select("*", F.lit("production").alias("fact"), F.lit(None).cast("bigint").alias("channel_id"))
    return channel.select(*columns).unionByName(production.select(*columns))


# --- stock -----------------------------------------------------------------


def inventory_commit(spark, sf_dir):
    checked = checked_inventory(spark, sf_dir).withColumn("batch_id", month_id("inventory_month"))
    checked = stage(checked.filter(feeds.no_errors() | (F.month("inventory_month") % 6 == 0)))
    allowed = (F.col("blocking_error_count") == 0) & (F.col("valid_rows") > 0)
    previews = feeds.inventory_summary(checked, "batch_id", "inventory_month").select(
        "batch_id", allowed.alias("commit_allowed"), F.col("inventory_month").alias("period_start"), F.col("inventory_month").alias("period_end")
    )
    turns = checked.select("batch_id", (F.col("batch_id") % 100).alias("turn")).distinct()
    verdicts = _verdicts(previews, turns, "INVENTORY")
    return verdicts, sinks.inventory_tables(checked, verdicts)


_STOCK = [
    _INV_FOUND,
    """judged AS (SELECT v.row_number, CAST(year(v.inventory_month) * 100 + month(v.inventory_month) AS BIGINT) AS batch_id, f.code, f.code IS NULL OR f.code LIKE '%EXCLUDED' AS ok
  FROM inventory v JOIN inv_found f USING (row_number))""",
    """raw_batches AS (SELECT batch_id, bool_or(NOT ok) AS blocked FROM judged WHERE ok OR batch_id % 100 % 6 = 0 GROUP BY 1)""",
    _verdict_sql("INVENTORY"),
    """stored AS (SELECT i.*, dataset_version_id FROM inv_valid i JOIN verdict ON batch_id = year(inventory_month) * 100 + month(inventory_month) WHERE verdict.code IS NULL)""",
]


@query(
    "inventory_commit_outcome",
    oracle(
        """SELECT verdict.*, v AS dataset_version_rows, r AS inventory_raw_rows, s AS inventory_sku_month_rows, p AS inventory_product_month_rows
FROM verdict LEFT JOIN (SELECT dataset_version_id, 1 AS v, count(*) AS r, nullif(count(DISTINCT sku_id) FILTER (planning_status = 'PLANNING_AVAILABLE'), 0) AS s,
  nullif(count(DISTINCT product_id) FILTER (planning_status = 'PLANNING_AVAILABLE'), 0) AS p FROM stored GROUP BY 1) USING (dataset_version_id)""",
        *_STOCK,
    ),
)
def inventory_commit_outcome(spark, sf_dir):
    return _outcome(*inventory_commit(spark, sf_dir))


@query(
    "inventory_commit_raw",
    oracle(
        """SELECT dataset_version_id, row_number AS source_row_no, inventory_month, sku_id, product_id, 'NAME:' || warehouse_name AS warehouse_code, production_date, opening_qty, ending_qty,
  '{"source_row_number":' || row_number || ',"warehouse_planning_status":"' || planning_status || '","planning_policy_version":"policy-1"}' AS raw_payload FROM stored""",
        *_STOCK,
    ),
)
def inventory_commit_raw(spark, sf_dir):
    raw = inventory_commit(spark, sf_dir)[1]["inventory_raw"]
    return raw.select("dataset_version_id", "source_row_no", "inventory_month", "sku_id", "product_id", "warehouse_code", "production_date", "opening_qty", "ending_qty", "raw_payload")


# --- supply ----------------------------------------------------------------


def incoming_commit(spark, sf_dir):
    """Twelve deliveries by order number; the sixth and twelfth with their faulty rows."""
    turn = F.col("order_no").cast("bigint") % 12 + 1
    checked = checked_incoming(spark, sf_dir).withColumn("batch_id", turn)
    checked = stage(checked.filter(feeds.is_clean() | (F.col("batch_id") % 6 == 0)))
    day = F.lit("1999-01-01").cast("date")
    summary = feeds.incoming_summary(checked, "batch_id")
    previews = summary.select("batch_id", ((F.col("blocking_error_count") == 0) & (F.col("valid_rows") > 0)).alias("commit_allowed"), day.alias("period_start"), day.alias("period_end"))
    verdicts = _verdicts(previews, checked.select("batch_id", F.col("batch_id").alias("turn")).distinct(), "INCOMING")
    return verdicts, sinks.incoming_tables(checked, verdicts)


_SUPPLY = [
    """judged AS (SELECT i.row_number, CAST(i.order_no AS BIGINT) % 12 + 1 AS batch_id, v.row_number IS NULL AS bad FROM incoming i LEFT JOIN incoming_valid v USING (row_number))""",
    "raw_batches AS (SELECT batch_id, bool_or(bad) AS blocked FROM judged WHERE NOT bad OR batch_id % 6 = 0 GROUP BY 1)",
    _verdict_sql("INCOMING"),
    "stored AS (SELECT i.*, dataset_version_id AS snapshot_id FROM incoming_valid i JOIN verdict ON batch_id = CAST(order_no AS BIGINT) % 12 + 1 WHERE code IS NULL)",
]


@query(
    "incoming_commit_outcome",
    oracle(
        f"""SELECT verdict.*, lines, products, qty FROM verdict LEFT JOIN (SELECT snapshot_id AS dataset_version_id, count(*) AS lines,
  nullif(count(DISTINCT product_id) FILTER (shipment_qty IS NOT NULL AND NOT warehouse_entry_recorded), 0) AS products,
  CAST(sum(shipment_qty) FILTER (NOT warehouse_entry_recorded) AS {_QTY}) AS qty FROM stored GROUP BY 1) USING (dataset_version_id)""",
        *_SUPPLY,
    ),
)
def incoming_commit_outcome(spark, sf_dir):
    verdicts, tables = incoming_commit(spark, sf_dir)
    lines = tables["incoming_snapshot_line"].groupBy(F.col("snapshot_id").alias("dataset_version_id")).agg(F.count(F.lit(1)).alias("lines"))
    totals = tables["product_totals"].groupBy(F.col("snapshot_id").alias("dataset_version_id")).agg(F.count(F.lit(1)).alias("products"), F.sum("incoming_qty").cast("decimal(18,3)").alias("qty"))
    answer = verdicts.select("batch_id", "version_key", "code", "dataset_version_id")
    return answer.join(lines, "dataset_version_id", "left").join(totals, "dataset_version_id", "left")


@query(
    "incoming_commit_lines",
    oracle(
        f"""SELECT snapshot_id, row_number AS source_row_no, sku_id, product_id, eta AS expected_arrival_date, CAST(shipment_qty AS {_QTY}) AS incoming_qty, warehouse_entry_recorded,
  '{{"source_sheet_name":"Sheet1","source_row_number":' || row_number || ',"order_group":"' || order_group || '","order_no":"' || order_no || '","order_qty":' ||
  coalesce('"' || order_qty || '"', 'null') || '}}' AS raw_payload FROM stored""",
        *_SUPPLY,
    ),
)
def incoming_commit_lines(spark, sf_dir):
    lines = incoming_commit(spark, sf_dir)[1]["incoming_snapshot_line"]
    return lines.select("snapshot_id", "source_row_no", "sku_id", "product_id", "expected_arrival_date", "incoming_qty", "warehouse_entry_recorded", "raw_payload")


# --- sales previews --------------------------------------------------------


def sales_commit(spark, sf_dir):
    """A file per month: June and December with their faulty rows, March delivered before, September the same file as August."""
    kept = checked_rows(spark, sf_dir, keep=stage).filter((F.size("findings") == 0) | (F.month("batch_month") % 6 == 0))
    # A row per file, read three times below: staged, or the rows are checked for each.
    verdicts = stage(sales_feed.file_verdict(kept, "batch_month").withColumn("batch_id", month_id("batch_month")))
    number = F.when(F.col("batch_id") % 100 == 9, F.col("batch_id") - 1).otherwise(F.col("batch_id"))
    files = verdicts.select("batch_id", F.col("batch_id").alias("request_no"), F.lit("sales.csv").alias("filename"), _file_hash(number).alias("file_hash"))
    stored = files.filter(F.col("batch_id") % 100 == 3).select("file_hash")
    return stage(sinks.sales_verdicts(files, verdicts.drop("batch_month"), stored))


#: What the counters of a preview read of a mapped row.
PREVIEW_COLUMNS = ("source_row_no", "source_customer_name", "source_sku_code", "source_sku_name", "actual_qty", "snapshot_month", "customer_id", "status", "mapping_reason")


_SALES = [
    _TYPED, _KEYED, _FOUND,
    """months AS (SELECT batch_month, CAST(year(batch_month) * 100 + month(batch_month) AS BIGINT) AS batch_id, bool_or(bad) AS blocked FROM (
  SELECT t.batch_month, t.row_number, f.row_number IS NOT NULL AS bad FROM typed t LEFT JOIN (SELECT DISTINCT row_number FROM found) f USING (row_number))
  WHERE NOT bad OR month(batch_month) % 6 = 0 GROUP BY 1)""",
    """file_code AS (SELECT batch_month, batch_id, CASE WHEN blocked THEN 'FILE_BLOCKED' WHEN batch_id % 100 = 3
  OR (batch_id % 100 = 9 AND EXISTS (SELECT 1 FROM months p WHERE p.batch_id = m.batch_id - 1 AND NOT blocked)) THEN 'FILE_ALREADY_IMPORTED' END AS code FROM months m)""",
    "open_rows AS (SELECT m.*, batch_id FROM mapped m JOIN file_code ON batch_month = snapshot_month WHERE code IS NULL)",
]


@query(
    "sales_preview_commit",
    oracle(
        """SELECT batch_id, code, b.* EXCLUDE (batch_id), issues FROM file_code LEFT JOIN (
  SELECT batch_id, 'PREVIEW_READY' AS status, count(*) AS total_rows, count(*) FILTER (status = 'READY') AS ready_rows, count(*) FILTER (status = 'SKIPPED') AS skipped_rows,
    CAST(sum(actual_qty) AS DECIMAL(28,4)) AS total_qty, count(*) FILTER (status = 'READY') AS candidates, count(customer_id) AS known_customers FROM open_rows GROUP BY 1) b USING (batch_id)
LEFT JOIN (SELECT batch_id, count(DISTINCT (kind, code)) AS issues FROM (SELECT batch_id, CASE mapping_reason WHEN 'SKU_AMBIGUOUS' THEN 'SKU_NOT_FOUND' ELSE mapping_reason END AS kind,
    CASE WHEN mapping_reason = 'CUSTOMER_NOT_FOUND' THEN source_customer_name ELSE source_sku_code END AS code FROM open_rows
    WHERE mapping_reason IN ('SKU_NOT_FOUND', 'SKU_AMBIGUOUS', 'PRODUCT_NOT_ASSIGNED', 'CUSTOMER_NOT_FOUND')) GROUP BY 1) USING (batch_id)""",
        *_SALES,
    ),
)
def sales_preview_commit(spark, sf_dir):
    verdicts = sales_commit(spark, sf_dir)
    rows = mapped_rows(spark, sf_dir, PREVIEW_COLUMNS, Steps()).withColumn("batch_id", month_id("snapshot_month"))
    tables = sinks.sales_preview_tables(rows, verdicts)
    batch = tables["sales_import_batch"].select("batch_id", "status", "total_rows", "ready_rows", "skipped_rows", "total_qty")
    candidates = tables["sales_import_candidate"].groupBy("batch_id").agg(F.count(F.lit(1)).alias("candidates"), F.count("customer_id").alias("known_customers"))
    issues = tables["sales_mapping_issue"].groupBy("batch_id").agg(F.count(F.lit(1)).alias("issues"))
    out = verdicts.select("batch_id", "code")
    for part in (batch, candidates, issues):
        out = out.join(part, "batch_id", "left")
    return out


@query(
    "sales_raw_commit",
    oracle("SELECT batch_id, source_row_no, source_document_no, source_line_no, sales_date, actual_qty, 'PENDING' AS status FROM open_rows", *_SALES),
)
def sales_raw_commit(spark, sf_dir):
    rows = data.sales_rows(spark, sf_dir).withColumn("batch_id", month_id("snapshot_month"))
    stored = sinks.sales_raw_tables(rows, sales_commit(spark, sf_dir))["sales_import_row"]
    return stored.select("batch_id", "source_row_no", "source_document_no", "source_line_no", "sales_date", "actual_qty", "status")


# --- import staging --------------------------------------------------------


def staged_import(spark, sf_dir, mode):
    rows = stage(evaluated_customers(spark, sf_dir))
    request = rows.select("batch_id").distinct().select("batch_id", F.lit("CUSTOMER").alias("entity_type"), F.lit(mode).alias("import_mode"), F.lit("ERP").alias("source_system"), _file_hash(F.col("batch_id")).alias("source_sha256"))
    return sinks.import_tables(rows, request, ["customer_code", "customer_name"])


@query(
    "import_staging_batch",
    oracle(
        """SELECT 'B1' AS batch_id, count(*) AS total_rows, count(*) FILTER (status <> 'ERROR') AS valid_rows, count(*) FILTER (status = 'WARNING') AS warning_rows,
  count(*) FILTER (status = 'ERROR') AS error_rows, CASE WHEN count(*) FILTER (status IN ('ERROR', 'WARNING')) > 0 THEN 'REVIEW' ELSE 'READY_TO_COMMIT' END AS status FROM cust_rows""",
        *_CUSTOMER,
    ),
)
def import_staging_batch(spark, sf_dir):
    return staged_import(spark, sf_dir, "OPERATIONAL")["import_batch"].select("batch_id", "total_rows", "valid_rows", "warning_rows", "error_rows", "status")


@query(
    "import_staging_rows",
    oracle(
        """SELECT a.row_number, CASE WHEN r.status = 'VALID' THEN 'READY' ELSE r.status END AS status, CASE WHEN r.action = 'EXISTING' THEN 'EXISTING' END AS commit_result,
  CASE WHEN r.status = 'VALID' THEN '{"customer_code":"' || a.code || '","customer_name":"' || a.name || '"}' END AS reviewed_values
FROM cust_rows r JOIN acted a USING (row_number)""",
        *_CUSTOMER,
    ),
)
def import_staging_rows(spark, sf_dir):
    return staged_import(spark, sf_dir, "OPERATIONAL")["import_row"].select("row_number", "status", "commit_result", "reviewed_values")


@query("import_staging_findings", oracle("SELECT row_number, code AS rule_code, severity, count(*) AS n FROM cust_found GROUP BY ALL", *_CUSTOMER))
def import_staging_findings(spark, sf_dir):
    return staged_import(spark, sf_dir, "OPERATIONAL")["import_finding"].groupBy("row_number", "rule_code", "severity").agg(F.count(F.lit(1)).alias("n"))
