"""Sales: typing, mapping, previews and dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.operators import dashboard, groups, resolution, sales_feed
from stockweave.operators.findings import finding_counts, issue_index
from stockweave.plans import standins as data
from stockweave.plans.registry import query
from stockweave.plans.standins import oracle

MONTH = ["snapshot_month"]


def mapped_rows(spark: SparkSession, sf_dir: str, columns=None, keep=None) -> DataFrame:
    return resolution.map_sales_rows(
        data.sales_rows(spark, sf_dir),
        data.sku(spark, sf_dir),
        data.product(spark, sf_dir),
        data.customer(spark, sf_dir),
        data.channel(spark, sf_dir),
        data.salesrep(spark, sf_dir),
        columns,
        keep,
    )


def sales_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = mapped_rows(spark, sf_dir).filter(F.col("status") == "READY")
    return ready.withColumn("source_system", F.lit(data.SOURCE_SYSTEM))


# --- typing and file rules -------------------------------------------------

_TYPED = """typed AS (
  SELECT source_row_no AS row_number, ship_month AS batch_month,
    CASE WHEN l_partkey % 29 <> 1 THEN CAST(l_orderkey AS VARCHAR) END AS source_document_no,
    CASE WHEN l_partkey % 29 <> 2 THEN CAST(l_linenumber AS VARCHAR) END AS source_line_no,
    CASE WHEN l_partkey % 29 <> 5 THEN ship_date END AS sales_date,
    CASE l_partkey % 29 WHEN 8 THEN NULL WHEN 9 THEN 1000 WHEN 10 THEN NULL WHEN 11 THEN NULL WHEN 12 THEN NULL
      ELSE CASE WHEN l_returnflag = 'R' THEN -qty ELSE qty END END::DECIMAL(18,4) AS actual_qty,
    l_partkey % 29 = 7 AS long_name FROM order_line)"""
_KEYED = """keyed AS (
  SELECT *, min(row_number) OVER (PARTITION BY batch_month, source_document_no, source_line_no) AS first_no,
    source_document_no IS NOT NULL AND source_line_no IS NOT NULL AS has_key FROM typed)"""
_FOUND = """found AS (
  SELECT batch_month, row_number, 'BUSINESS_KEY_INVALID' AS code, 'document_no' AS field FROM typed WHERE source_document_no IS NULL
  UNION ALL SELECT batch_month, row_number, 'BUSINESS_KEY_INVALID', 'line_no' FROM typed WHERE source_line_no IS NULL
  UNION ALL SELECT batch_month, row_number, 'BUSINESS_DATE_INVALID', 'business_date' FROM typed WHERE sales_date IS NULL
  UNION ALL SELECT batch_month, row_number, 'SHIPPED_QTY_INVALID', 'quantity' FROM typed WHERE actual_qty IS NULL
  UNION ALL SELECT batch_month, row_number, 'FILE_STRUCTURE_INVALID', 'sku_name' FROM typed WHERE long_name
  UNION ALL SELECT batch_month, row_number, 'DUPLICATE_BUSINESS_KEY', NULL FROM keyed WHERE has_key AND row_number > first_no)"""


def checked_rows(spark: SparkSession, sf_dir: str, keep=None) -> DataFrame:
    typed = sales_feed.type_sales_rows(data.raw_sales_text(spark, sf_dir))
    return sales_feed.duplicate_key_findings(typed, "batch_month", keep=keep)


@query(
    "sales_typed_rows",
    oracle(
        "SELECT row_number, source_document_no, source_line_no, sales_date, actual_qty FROM typed t "
        "WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.row_number = t.row_number)",
        _TYPED, _KEYED, _FOUND,
    ),
)
def sales_typed_rows(spark, sf_dir):
    rows = checked_rows(spark, sf_dir).filter(F.size("findings") == 0)
    return rows.select("row_number", "source_document_no", "source_line_no", "sales_date", "actual_qty")


@query(
    "sales_finding_counts",
    oracle(
        "SELECT batch_month, code, field, 'ERROR' AS severity, count(*) AS findings, count(DISTINCT row_number) AS affected_rows "
        "FROM found GROUP BY ALL",
        _TYPED, _KEYED, _FOUND,
    ),
)
def sales_finding_counts(spark, sf_dir):
    return finding_counts(checked_rows(spark, sf_dir), "batch_month")


@query(
    "issue_index",
    oracle("SELECT DISTINCT batch_month, code, row_number FROM found", _TYPED, _KEYED, _FOUND),
)
def sales_issue_index(spark, sf_dir):
    return issue_index(checked_rows(spark, sf_dir), "batch_month")


@query(
    "duplicate_business_key",
    oracle(
        "SELECT source_document_no, source_line_no, source_row_no, first_no AS first_row_no FROM (SELECT *, "
        "min(source_row_no) OVER (PARTITION BY source_document_no, source_line_no) AS first_no FROM sales) WHERE source_row_no > first_no"
    ),
)
def duplicate_business_key(spark, sf_dir):
    rows = data.sales_rows(spark, sf_dir).withColumnRenamed("source_row_no", "row_number")
    later = sales_feed.duplicate_business_keys(rows).filter(F.col("first_row_no").isNotNull())
    return later.select("source_document_no", "source_line_no", F.col("row_number").alias("source_row_no"), "first_row_no")


@query(
    "sales_file_verdict",
    oracle(
        """SELECT batch_month, count(*) AS row_count, count(n) AS rows_with_errors, CAST(coalesce(sum(n), 0) AS BIGINT) AS row_errors,
  min(sales_date) AS data_date_start, max(sales_date) AS data_date_end,
  CAST(sum(CASE WHEN n IS NULL THEN actual_qty END) AS DECIMAL(38,4)) AS total_qty,
  batch_month AS snapshot_month, false AS several_months, false AS total_overflow, coalesce(sum(n), 0) > 0 AS blocked
FROM typed LEFT JOIN errs USING (row_number) GROUP BY batch_month""",
        _TYPED, _KEYED, _FOUND, "errs AS (SELECT row_number, count(*) AS n FROM found GROUP BY 1)",
    ),
)
def sales_file_verdict(spark, sf_dir):
    return sales_feed.file_verdict(checked_rows(spark, sf_dir), "batch_month")


# --- mapping ---------------------------------------------------------------


@query(
    "sku_resolution_outcome",
    oracle(
        "SELECT source_row_no, status, mapping_reason, sku_id, product_id, customer_id, channel_id_snapshot, salesrep_id_snapshot FROM mapped"
    ),
)
def sku_resolution_outcome(spark, sf_dir):
    return mapped_rows(spark, sf_dir).select(
        "source_row_no", "status", "mapping_reason", "sku_id", "product_id", "customer_id", "channel_id_snapshot", "salesrep_id_snapshot"
    )


@query(
    "candidate_snapshot",
    oracle(f"SELECT source_row_no, {', '.join(resolution.SNAPSHOT_COLUMNS)} FROM fact"),
)
def candidate_snapshot(spark, sf_dir):
    ready = mapped_rows(spark, sf_dir).filter(F.col("status") == "READY")
    return ready.select("source_row_no", *resolution.SNAPSHOT_COLUMNS)


@query(
    "mapping_summary",
    oracle(
        """SELECT snapshot_month, count(*) AS raw_rows, count(*) FILTER (status = 'READY') AS ready_rows,
  count(*) FILTER (status = 'SKIPPED') AS skipped_rows, count(*) FILTER (mapping_reason = 'KIT_PARENT') AS kit_parent_skipped_rows,
  count(*) FILTER (mapping_reason = 'NONPOSITIVE_QTY') AS nonpositive_qty_skipped_rows,
  count(*) FILTER (mapping_reason IN ('SKU_NOT_FOUND', 'SKU_AMBIGUOUS')) AS sku_not_found_rows,
  count(*) FILTER (mapping_reason = 'PRODUCT_NOT_ASSIGNED') AS product_not_assigned_rows,
  count(*) FILTER (mapping_reason = 'CUSTOMER_NOT_FOUND') AS customer_not_found_rows,
  CAST(coalesce(sum(actual_qty) FILTER (status = 'READY'), 0) AS DECIMAL(28,4)) AS ready_qty,
  CAST(coalesce(sum(actual_qty) FILTER (status = 'SKIPPED'), 0) AS DECIMAL(28,4)) AS skipped_qty,
  CAST(coalesce(sum(actual_qty) FILTER (status = 'READY' AND customer_id IS NULL), 0) AS DECIMAL(28,4)) AS unassigned_qty
FROM mapped GROUP BY 1"""
    ),
)
def mapping_summary(spark, sf_dir):
    return sales_feed.mapping_summary(mapped_rows(spark, sf_dir), *MONTH)


@query(
    "mapping_issues",
    oracle(
        """SELECT issue_type, external_code, min_by(name, source_row_no) AS external_name, count(*) AS affected_row_count,
  CAST(sum(actual_qty) AS DECIMAL(28,4)) AS affected_qty,
  CASE issue_type WHEN 'CUSTOMER_NOT_FOUND' THEN 'WARNING' ELSE 'ERROR' END AS severity
FROM (SELECT source_row_no, actual_qty, CASE mapping_reason WHEN 'SKU_AMBIGUOUS' THEN 'SKU_NOT_FOUND' ELSE mapping_reason END AS issue_type,
    CASE WHEN mapping_reason = 'CUSTOMER_NOT_FOUND' THEN source_customer_name ELSE source_sku_code END AS external_code,
    CASE WHEN mapping_reason = 'CUSTOMER_NOT_FOUND' THEN source_customer_name ELSE source_sku_name END AS name
  FROM mapped WHERE mapping_reason IN ('SKU_NOT_FOUND', 'SKU_AMBIGUOUS', 'PRODUCT_NOT_ASSIGNED', 'CUSTOMER_NOT_FOUND'))
GROUP BY 1, 2"""
    ),
)
def mapping_issues(spark, sf_dir):
    return sales_feed.mapping_issues(mapped_rows(spark, sf_dir))


@query(
    "preview_reason_summary",
    oracle(
        """SELECT snapshot_month, reason AS mapping_reason, count(m.source_row_no) AS rows, CAST(coalesce(sum(actual_qty), 0) AS DECIMAL(28,4)) AS qty
FROM (SELECT DISTINCT snapshot_month FROM sales) CROSS JOIN (VALUES ('KIT_PARENT'), ('NONPOSITIVE_QTY'), ('SKU_NOT_FOUND'),
  ('SKU_AMBIGUOUS'), ('PRODUCT_NOT_ASSIGNED'), ('CUSTOMER_NOT_FOUND')) v(reason)
LEFT JOIN (SELECT snapshot_month, mapping_reason AS reason, source_row_no, actual_qty FROM mapped) m USING (snapshot_month, reason)
GROUP BY 1, 2"""
    ),
)
def preview_reason_summary(spark, sf_dir):
    return sales_feed.preview_reasons(mapped_rows(spark, sf_dir), *MONTH)


@query(
    "unassigned_summary",
    oracle(
        """SELECT snapshot_month, count(*) FILTER (lacking) AS rows, CAST(coalesce(sum(actual_qty) FILTER (lacking), 0) AS DECIMAL(28,4)) AS qty
FROM (SELECT *, channel_id_snapshot IS NULL OR salesrep_id_snapshot IS NULL AS lacking FROM fact) GROUP BY 1"""
    ),
)
def unassigned_summary(spark, sf_dir):
    return sales_feed.unassigned_summary(sales_fact(spark, sf_dir), *MONTH)


def _preview(dimension: str) -> None:
    dims = sales_feed.PREVIEW_DIMENSIONS[dimension]
    columns = ", ".join(dims)
    sql = f"SELECT snapshot_month, {columns}, count(*) AS rows, CAST(sum(actual_qty) AS DECIMAL(28,4)) AS qty FROM fact GROUP BY ALL"

    @query(f"preview_aggregate_{dimension.replace('-', '_')}", oracle(sql))
    def run(spark, sf_dir):
        return sales_feed.preview_aggregate(sales_fact(spark, sf_dir), dimension, *MONTH)


for _dimension in sales_feed.PREVIEW_DIMENSIONS:
    _preview(_dimension)


@query(
    "preview_aggregate_page",
    oracle(
        "SELECT product_id, product_code_snapshot, product_name_snapshot, count(*) AS rows, CAST(sum(actual_qty) AS DECIMAL(28,4)) AS qty "
        "FROM fact GROUP BY 1, 2, 3 ORDER BY qty DESC, 1, 2, 3 LIMIT 20 OFFSET 20"
    ),
)
def preview_aggregate_page(spark, sf_dir):
    rows = sales_feed.preview_aggregate(sales_fact(spark, sf_dir), "product")
    return dashboard.page(rows, sales_feed.preview_order("product"), 2, 20)


@query(
    "raw_row_listing",
    oracle(
        "SELECT source_row_no, source_document_no, source_line_no, sales_date, source_sku_code, actual_qty, status, mapping_reason "
        "FROM mapped WHERE mapping_reason = 'CUSTOMER_NOT_FOUND' ORDER BY source_row_no LIMIT 100"
    ),
)
def raw_row_listing(spark, sf_dir):
    rows = mapped_rows(spark, sf_dir).filter(F.col("mapping_reason") == "CUSTOMER_NOT_FOUND")
    listed = rows.select("source_row_no", "source_document_no", "source_line_no", "sales_date", "source_sku_code", "actual_qty", "status", "mapping_reason")
    return dashboard.page(listed, [F.col("source_row_no").asc()], 1, 100)


# --- dashboards ------------------------------------------------------------

_SHARE = "CAST(round_even(qty / sum(qty) OVER ({0}), 6) AS DECIMAL(18,6)) AS share, count(*) OVER ({0}) AS total_items"


def _grouped_sql(columns: str, scope: str = "snapshot_month", extra: str = "") -> str:
    window = f"PARTITION BY {scope}"
    return oracle(
        f"SELECT 'ERP' AS source_system, *, {_SHARE.format(window)} FROM (SELECT snapshot_month, {columns}, "
        f"CAST(sum(actual_qty) AS DECIMAL(28,4)) AS qty{extra} FROM fact GROUP BY ALL)"
    )


@query("product_page_share", _grouped_sql("product_id, product_name_snapshot AS product_name", extra=", count(DISTINCT sku_id) AS sku_count"))
def product_page_share(spark, sf_dir):
    return dashboard.products(sales_fact(spark, sf_dir))


@query(
    "product_page_top",
    oracle(
        f"SELECT 'ERP' AS source_system, *, {_SHARE.format('PARTITION BY snapshot_month')} FROM (SELECT snapshot_month, product_id, "
        "product_name_snapshot AS product_name, CAST(sum(actual_qty) AS DECIMAL(28,4)) AS qty, count(DISTINCT sku_id) AS sku_count "
        "FROM fact GROUP BY ALL) ORDER BY qty DESC, snapshot_month, product_id, product_name LIMIT 50 OFFSET 50"
    ),
)
def product_page_top(spark, sf_dir):
    rows = dashboard.products(sales_fact(spark, sf_dir))
    return dashboard.sorted_page(rows, "-qty", ["snapshot_month", "product_id", "product_name", "sku_count"], page_no=2, page_size=50)


@query(
    "product_sku_drilldown",
    _grouped_sql("product_id, sku_id, sku_code_snapshot AS sku_code, sku_name_snapshot AS sku_name", scope="snapshot_month, product_id"),
)
def product_sku_drilldown(spark, sf_dir):
    return dashboard.product_skus(sales_fact(spark, sf_dir))


def _matrix_sql(dimension: str) -> str:
    return _grouped_sql(
        f"{dimension}_id_snapshot AS {dimension}_id, coalesce({dimension}_name_snapshot, '未归属') AS {dimension}_name, "
        "product_id, product_name_snapshot AS product_name"
    )


@query("salesrep_product_matrix", _matrix_sql("salesrep"))
def salesrep_product_matrix(spark, sf_dir):
    return dashboard.salesrep_products(sales_fact(spark, sf_dir))


@query("channel_product_matrix", _matrix_sql("channel"))
def channel_product_matrix(spark, sf_dir):
    return dashboard.channel_products(sales_fact(spark, sf_dir))


@query(
    "dashboard_summary",
    oracle(
        "SELECT 'ERP' AS source_system, snapshot_month, CAST(sum(actual_qty) AS DECIMAL(28,4)) AS mtd_qty, "
        "count(DISTINCT product_id) AS product_count, count(DISTINCT sku_id) AS sku_count FROM fact GROUP BY 2"
    ),
)
def dashboard_summary(spark, sf_dir):
    return dashboard.summary(sales_fact(spark, sf_dir))


@query(
    "dashboard_summary_filtered",
    oracle(
        "SELECT 'ERP' AS source_system, snapshot_month, CAST(sum(actual_qty) AS DECIMAL(28,4)) AS mtd_qty, "
        "count(DISTINCT product_id) AS product_count, count(DISTINCT sku_id) AS sku_count FROM fact "
        "WHERE salesrep_id_snapshot IN (1, 2, 3) OR salesrep_id_snapshot IS NULL GROUP BY 2"
    ),
)
def dashboard_summary_filtered(spark, sf_dir):
    fact = dashboard.apply_filters(sales_fact(spark, sf_dir), dashboard.Filters(salesrep_ids=(1, 2, 3, None)))
    return dashboard.summary(fact)


@query(
    "filter_options",
    oracle(
        """SELECT DISTINCT snapshot_month, 'ERP' AS source_system, o.* FROM fact, LATERAL (VALUES
  ('channel', channel_id_snapshot, NULL, coalesce(channel_name_snapshot, '未归属')),
  ('salesrep', salesrep_id_snapshot, NULL, coalesce(salesrep_name_snapshot, '未归属')),
  ('product', product_id, NULL, product_name_snapshot), ('sku', sku_id, sku_code_snapshot, sku_name_snapshot)) o(option_kind, id, code, name)"""
    ),
)
def filter_options(spark, sf_dir):
    return dashboard.filter_options(sales_fact(spark, sf_dir))


@query(
    "deep_row_page",
    oracle(
        """, numbered_rows AS (SELECT source_row_no, sales_date, actual_qty, row_number() OVER (ORDER BY sales_date DESC, source_row_no) AS n, count(*) OVER () AS total FROM sales)
SELECT source_row_no, sales_date, actual_qty FROM numbered_rows WHERE n > 2990 AND n <= 3000 OR n > 55000 AND n <= 55500 OR n > total // 500 * 500"""
    ),
)
def deep_row_page(spark, sf_dir):
    """Pages 300 of ten rows, 111 of 500 and the last of 500 of all sales, newest first, from one sorted table."""
    rows = data.sales_rows(spark, sf_dir).select("source_row_no", "sales_date", "actual_qty")
    paged = groups.PagedTable(rows, [F.col("sales_date").desc(), F.col("source_row_no").asc()])
    total = sum(size for _, size in paged.sizes)
    return paged.page(300, 10).unionByName(paged.page(111, 500)).unionByName(paged.page(total // 500 + 1, 500)).distinct()
