"""Domain tables derived from the driver tables.

``lineitem`` with ``orders`` plays the sales, shipment, stock and supply feeds,
``part`` the SKU master (``p_brand`` + ``p_type`` its product), ``customer`` the
customer master, ``c_mktsegment`` the channel, ``nation`` the sales rep and
``supplier`` the warehouse. Every rule is local to a row or an aggregate, so a
stand-in scales like its source. Doubles become decimals at the scan. ``SQL``
holds the same rules for the comparison engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stockweave.functions.keys import identity_key, stable_id

SOURCE_SYSTEM = "ERP"
POLICY_VERSION = "policy-1"
CYCLE_MONTH = "2000-06-01"


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its schema is read from the file once per path."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def digest_id(*parts: Column, digits: int = 12) -> Column:
    """Positive number from the first hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, digits), 16, 10).cast("bigint")


# --- masters ---------------------------------------------------------------


def channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("channel_name")).distinct()
    return names.select(
        digest_id(F.col("channel_name")).alias("channel_id"),
        stable_id("CHANNEL", identity_key("channel", "channel_name")).alias("channel_stable_id"),
        F.substring("channel_name", 1, 4).alias("channel_code"),
        "channel_name",
        F.lit("ACTIVE").alias("channel_status"),
    )


def salesrep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + 1).cast("bigint").alias("salesrep_id"),
        stable_id("SALESREP", identity_key("salesrep", "n_nationkey")).alias("salesrep_stable_id"),
        F.concat(F.lit("E"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("salesrep_code"),
        F.col("n_name").alias("salesrep_name"),
        F.when(F.col("n_nationkey") % 11 == 5, "INACTIVE").otherwise("ACTIVE").alias("salesrep_status"),
    )


def region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(
        (F.col("r_regionkey") + 1).cast("bigint").alias("region_id"),
        F.concat(F.lit("REG_"), F.lpad(F.col("r_regionkey").cast("string"), 6, "0")).alias("region_stable_id"),
        F.col("r_name").alias("region_name"),
        F.lit("ACTIVE").alias("region_status"),
    )


def customer(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    """Customers; every 53rd has another code and name than its sales, so these stay unassigned.
    ``source``: the table as already read."""
    source = table(spark, sf_dir, "customer") if source is None else source
    moved = F.col("c_custkey") % 53 == 0
    name = F.when(moved, F.concat(F.lit("Formerly "), "c_name")).otherwise(F.col("c_name"))
    return source.select(
        (F.col("c_custkey") + 1).alias("customer_id"),
        stable_id("CUSTOMER", identity_key("customer_code_name", "c_custkey", name)).alias("customer_stable_id"),
        F.concat(F.when(moved, "OLD-").otherwise("C"), F.col("c_custkey").cast("string")).alias("customer_code"),
        name.alias("customer_name"),
        digest_id(F.col("c_mktsegment")).alias("channel_id"),
        (F.col("c_nationkey") + 1).cast("bigint").alias("salesrep_id"),
        F.when(F.col("c_custkey") % 37 == 0, "INACTIVE").otherwise("ACTIVE").alias("customer_status"),
    )


def product(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    name = F.concat_ws(" ", "p_brand", "p_type")
    return pairs.select(
        digest_id(F.col("p_brand"), F.col("p_type")).alias("product_id"),
        stable_id("PRODUCT", identity_key("product", name)).alias("product_stable_id"),
        F.concat_ws("-", F.substring("p_brand", 7, 3), F.substring("p_type", 1, 3)).alias("product_code"),
        name.alias("product_name"),
        F.col("p_brand").alias("brand"),
        F.when(F.col("p_brand") == "Brand#13", "INACTIVE").otherwise("ACTIVE").alias("product_status"),
    )


def sku(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    """SKUs with holes: codes nothing is sold under (97), no product (89), two codes that
    differ in edge spaces only (83), one code with an edge space (79). ``source``: as in :func:`customer`."""
    part = table(spark, sf_dir, "part") if source is None else source
    code = F.concat(F.when(F.col("p_partkey") % 97 == 0, "RETIRED-").otherwise("SKU-"), F.col("p_partkey").cast("string"))
    codes = (
        F.when(F.col("p_partkey") % 83 == 0, F.array(F.concat(F.lit(" "), code), F.concat(code, F.lit(" "))))
        .when(F.col("p_partkey") % 79 == 0, F.array(F.concat(code, F.lit(" "))))
        .otherwise(F.array(code))
    )
    return part.select("*", F.posexplode(codes).alias("_copy", "sku_code")).select(
        (F.col("p_partkey") * 2 + F.col("_copy") + 1).alias("sku_id"),
        stable_id("SKU", identity_key("sku", F.concat_ws(":", "p_partkey", "_copy"))).alias("sku_stable_id"),
        "sku_code",
        F.col("p_name").alias("sku_name"),
        F.when(F.col("p_partkey") % 89 != 0, digest_id(F.col("p_brand"), F.col("p_type"))).alias("product_id"),
        F.when(F.col("p_partkey") % 61 == 0, "INACTIVE").otherwise("ACTIVE").alias("sku_status"),
        F.col("p_type").alias("category_l1"),
        F.col("p_brand").alias("brand"),
        F.col("p_size").cast("decimal(12,3)").alias("case_pack"),
        F.col("p_partkey").alias("partkey"),
    )


def warehouse_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("s_suppkey") % 5
    status = F.when(turn == 0, "IN_TRANSIT").when(turn == 1, "NON_SELLABLE").otherwise("PLANNING_AVAILABLE")
    # two of ten warehouses go by another name, so their stock is unclassified
    name = F.when(turn == 2, F.concat(F.lit("Closed "), "s_name")).otherwise(F.col("s_name"))
    return table(spark, sf_dir, "supplier").select(F.lit(POLICY_VERSION).alias("policy_version"), name.alias("warehouse_name"), status.alias("planning_status"))


# --- sales feed ------------------------------------------------------------


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with decimal numbers, a date and a row number.

    The scan has no stable position both engines can read, so the row number
    is a digest of the whole line.
    """
    source = table(spark, sf_dir, "lineitem")
    typed = source.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        F.col("l_quantity").cast("decimal(18,4)").alias("qty"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        F.col("l_discount").cast("decimal(4,2)").alias("discount"),
        F.col("l_tax").cast("decimal(4,2)").alias("tax"),
        "l_returnflag",
        "l_linestatus",
        F.col("l_shipdate").cast("date").alias("ship_date"),
    )
    parts = [F.col(c).cast("string") for c in typed.columns]
    return typed.withColumn("source_row_no", digest_id(*parts, digits=15))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.col("o_orderdate").cast("date").alias("order_date")
    )
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    # Every line has its order and every order its customer; as outer joins the
    # optimizer may drop them where none of their columns is read. Orders meet
    # their customers first: they are fewer and narrower than the lines, which
    # then move once.
    named = orders.join(names, "o_custkey", "left")
    return lines(spark, sf_dir).join(named, "l_orderkey", "left")


def sales_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed rows of a sales export, one batch per ship month."""
    return order_lines(spark, sf_dir).select(
        "source_row_no",
        F.col("l_orderkey").cast("string").alias("source_document_no"),
        F.col("l_linenumber").cast("string").alias("source_line_no"),
        F.col("ship_date").alias("sales_date"),
        F.col("c_name").alias("source_customer_name"),
        F.when(F.col("l_partkey") % 41 == 0, "KIT_PARENT").otherwise("STANDARD").alias("source_product_type"),
        F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string")).alias("source_sku_code"),
        F.concat_ws("/", F.lit("Item"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("source_sku_name"),
        F.when(F.col("l_returnflag") == "R", -F.col("qty")).otherwise(F.col("qty")).cast("decimal(18,4)").alias("actual_qty"),
        F.trunc("ship_date", "MM").alias("snapshot_month"),
    )


def raw_sales_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same export untyped, with faulty cells: all columns are strings."""
    turn = F.col("l_partkey") % 29
    number = F.col("l_linenumber").cast("string")
    quantity = F.when(F.col("l_returnflag") == "R", -F.col("qty")).otherwise(F.col("qty")).cast("string")
    return order_lines(spark, sf_dir).select(
        F.col("source_row_no").alias("row_number"),
        F.trunc("ship_date", "MM").alias("batch_month"),
        F.when(turn == 1, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("l_orderkey").cast("string"))).alias("document_no"),
        F.when(turn == 2, F.concat(number, F.lit(".5")))
        .when(turn == 3, F.concat(F.lit("+00"), number, F.lit(".0")))
        .otherwise(number)
        .alias("line_no"),
        F.when(turn == 4, F.date_format("ship_date", "yyyy/M/d"))
        .when(turn == 5, F.lit("2000-02-30"))
        .when(turn == 6, F.date_diff(F.col("ship_date"), F.lit("1899-12-30").cast("date")).cast("string"))
        .otherwise(F.date_format("ship_date", "yyyy-MM-dd"))
        .alias("business_date"),
        F.col("c_name").alias("customer_name"),
        F.lit("STANDARD").alias("product_type"),
        F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string")).alias("sku_code"),
        F.when(turn == 7, F.repeat(F.lit("x"), 256)).otherwise(F.lit("Item")).alias("sku_name"),
        F.when(turn == 8, F.lit("1.00001")).when(turn == 9, F.lit("1e3")).when(turn == 10, F.lit(""))
        .when(turn == 11, F.lit("1.5e-2147483648")).when(turn == 12, F.lit("1.50e2147483647")).otherwise(quantity).alias("quantity"),
    )


# --- planning feeds --------------------------------------------------------


def planning_actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipment rows: the production date is the order quarter's first day."""
    quarter = F.to_date(F.date_trunc("quarter", F.col("order_date")))
    return order_lines(spark, sf_dir).select(
        F.col("source_row_no").alias("row_number"),
        F.col("ship_date").alias("sales_date"),
        F.col("c_name").alias("customer_name"),
        F.when(F.col("l_suppkey") % 31 == 7, "草稿").otherwise("已审核").alias("document_status"),
        F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string")).alias("sku_code"),
        F.lit("Item").alias("sku_name"),
        F.when(F.col("l_returnflag") == "R", -F.col("qty")).otherwise(F.col("qty")).cast("decimal(28,10)").alias("shipped_qty"),
        F.concat(F.lit("W"), F.col("l_suppkey").cast("string")).alias("warehouse_name"),
        F.concat(F.lit("LOT"), F.date_format(quarter, "yyyyMMdd")).alias("batch_no"),
        F.when(F.col("l_linenumber") != 7, quarter).alias("production_date"),
    )


def inventory_rows(spark: SparkSession, sf_dir: str, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per SKU, warehouse, lot and month in which stock left.

    A lot's whole stock is received in its first month or was there before.
    The window runs over month aggregates, so a lot has few rows. ``keep``
    stores these aggregates.
    """
    from pyspark.sql import Window

    lot = ["l_partkey", "l_suppkey", "production_date"]
    quarter = F.to_date(F.date_trunc("quarter", F.col("order_date")))
    issued = (
        order_lines(spark, sf_dir)
        .withColumn("production_date", quarter)
        .groupBy(*lot, F.trunc("ship_date", "MM").alias("inventory_month"))
        .agg(F.sum("qty").cast("decimal(18,3)").alias("issue_qty"))
    )
    issued = keep(issued) if keep else issued
    by_lot = Window.partitionBy(*lot)
    upto = by_lot.orderBy("inventory_month").rowsBetween(Window.unboundedPreceding, 0)
    stock = F.sum("issue_qty").over(by_lot) + F.when(F.col("l_partkey") % 3 == 0, 1).otherwise(0)
    left = F.col("_stock") - F.col("_out")
    first = F.col("inventory_month") == F.col("_first")
    existing = F.col("l_partkey") % 5 == 0
    nothing = F.lit(0).cast("decimal(18,3)")
    qty = "decimal(18,3)"
    return (
        issued.withColumns(
            {"_stock": stock, "_out": F.sum("issue_qty").over(upto), "_first": F.min("inventory_month").over(by_lot)}
        )
        .withColumn("opening_qty", F.when(first & ~existing, nothing).otherwise(left + F.col("issue_qty")).cast(qty))
        .withColumn("receipt_qty", F.when(first & ~existing, F.col("_stock")).otherwise(nothing).cast(qty))
        .withColumn("ending_qty", left.cast(qty))
        .select(
            digest_id(*[F.col(c).cast("string") for c in (*lot, "inventory_month")], digits=15).alias("row_number"),
            F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string")).alias("sku_code"),
            F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("warehouse_name"),
            "production_date",
            "inventory_month",
            "opening_qty",
            "receipt_qty",
            "issue_qty",
            "ending_qty",
        )
    )


def incoming_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select(
        F.lit("Sheet1").alias("source_sheet_name"),
        F.col("source_row_no").alias("row_number"),
        F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string")).alias("sku_code"),
        F.concat(F.lit("G"), (F.col("l_orderkey") % 100).cast("string")).alias("order_group"),
        F.col("l_orderkey").cast("string").alias("order_no"),
        F.when(F.col("l_linenumber") != 6, F.col("qty")).cast("decimal(28,10)").alias("shipment_qty"),
        F.when(F.col("l_linenumber") % 3 == 1, F.col("qty") * 2).cast("decimal(28,10)").alias("order_qty"),
        F.when(F.col("l_partkey") % 47 != 3, F.col("ship_date")).alias("eta"),
        (F.col("l_linestatus") == "F").alias("warehouse_entry_recorded"),
    )


SQL = """
line AS (
  SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
    CAST(l_quantity AS DECIMAL(18,4)) AS qty, CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
    CAST(l_discount AS DECIMAL(4,2)) AS discount, CAST(l_tax AS DECIMAL(4,2)) AS tax,
    l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS ship_date FROM lineitem),
numbered AS (
  SELECT *, CAST('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, qty, price,
    discount, tax, l_returnflag, l_linestatus, ship_date)), 1, 15) AS BIGINT) AS source_row_no FROM line),
order_line AS (
  SELECT n.*, o_custkey, CAST(o_orderdate AS DATE) AS order_date, c_name,
    CAST(date_trunc('quarter', o_orderdate) AS DATE) AS order_quarter,
    CAST(date_trunc('month', ship_date) AS DATE) AS ship_month
  FROM numbered n LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey),
m_channel AS (
  SELECT CAST('0x' || substr(md5(c_mktsegment), 1, 12) AS BIGINT) AS channel_id, substr(c_mktsegment, 1, 4) AS channel_code,
    c_mktsegment AS channel_name, 'ACTIVE' AS channel_status FROM (SELECT DISTINCT c_mktsegment FROM customer)),
m_salesrep AS (
  SELECT CAST(n_nationkey + 1 AS BIGINT) AS salesrep_id, 'E' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS salesrep_code,
    n_name AS salesrep_name, CASE WHEN n_nationkey % 11 = 5 THEN 'INACTIVE' ELSE 'ACTIVE' END AS salesrep_status FROM nation),
m_customer AS (
  SELECT c_custkey + 1 AS customer_id, CASE WHEN c_custkey % 53 = 0 THEN 'OLD-' ELSE 'C' END || c_custkey AS customer_code,
    CASE WHEN c_custkey % 53 = 0 THEN 'Formerly ' ELSE '' END || c_name AS customer_name,
    CAST('0x' || substr(md5(c_mktsegment), 1, 12) AS BIGINT) AS channel_id, CAST(c_nationkey + 1 AS BIGINT) AS salesrep_id,
    CASE WHEN c_custkey % 37 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS customer_status
  FROM customer),
m_product AS (
  SELECT CAST('0x' || substr(md5(p_brand || '|' || p_type), 1, 12) AS BIGINT) AS product_id,
    substr(p_brand, 7, 3) || '-' || substr(p_type, 1, 3) AS product_code, p_brand || ' ' || p_type AS product_name,
    p_brand AS brand, CASE WHEN p_brand = 'Brand#13' THEN 'INACTIVE' ELSE 'ACTIVE' END AS product_status
  FROM (SELECT DISTINCT p_brand, p_type FROM part)),
based AS (SELECT *, CASE WHEN p_partkey % 97 = 0 THEN 'RETIRED-' ELSE 'SKU-' END || p_partkey AS base FROM part),
m_sku AS (
  SELECT p_partkey * 2 + copy + 1 AS sku_id, code AS sku_code, p_name AS sku_name,
    CASE WHEN p_partkey % 89 <> 0 THEN CAST('0x' || substr(md5(p_brand || '|' || p_type), 1, 12) AS BIGINT) END AS product_id,
    CASE WHEN p_partkey % 61 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS sku_status,
    p_type AS category_l1, p_brand AS brand, CAST(p_size AS DECIMAL(12,3)) AS case_pack, p_partkey AS partkey
  FROM (
    SELECT *, 0 AS copy, CASE WHEN p_partkey % 83 = 0 THEN ' ' || base WHEN p_partkey % 79 = 0 THEN base || ' ' ELSE base END AS code FROM based
    UNION ALL
    SELECT *, 1 AS copy, base || ' ' AS code FROM based WHERE p_partkey % 83 = 0)),
policy AS (
  SELECT CASE WHEN s_suppkey % 5 = 2 THEN 'Closed ' ELSE '' END || s_name AS warehouse_name, CASE s_suppkey % 5 WHEN 0 THEN 'IN_TRANSIT' WHEN 1 THEN 'NON_SELLABLE'
    ELSE 'PLANNING_AVAILABLE' END AS planning_status FROM supplier),
sales AS (
  SELECT source_row_no, CAST(l_orderkey AS VARCHAR) AS source_document_no, CAST(l_linenumber AS VARCHAR) AS source_line_no,
    ship_date AS sales_date, c_name AS source_customer_name,
    CASE WHEN l_partkey % 41 = 0 THEN 'KIT_PARENT' ELSE 'STANDARD' END AS source_product_type,
    'SKU-' || l_partkey AS source_sku_code, 'Item/' || l_partkey || '/' || l_suppkey AS source_sku_name,
    CAST(CASE WHEN l_returnflag = 'R' THEN -qty ELSE qty END AS DECIMAL(18,4)) AS actual_qty, ship_month AS snapshot_month
  FROM order_line),
sku_norm AS (SELECT trim(sku_code) AS key, count(*) AS n, min(sku_id) AS sku_id FROM m_sku GROUP BY 1),
outcome AS (
  SELECT s.*, CASE WHEN source_product_type = 'KIT_PARENT' THEN 'KIT_PARENT' WHEN actual_qty <= 0 THEN 'NONPOSITIVE_QTY' END AS early,
    coalesce(e.sku_id, CASE WHEN k.n = 1 THEN k.sku_id END) AS hit, k.n AS hits
  FROM sales s LEFT JOIN m_sku e ON e.sku_code = source_sku_code LEFT JOIN sku_norm k ON k.key = trim(source_sku_code)),
mapped AS (
  SELECT o.* EXCLUDE (early, hit, hits), CASE WHEN p.product_id IS NOT NULL THEN k.sku_id END AS sku_id,
    CASE WHEN p.product_id IS NOT NULL THEN k.sku_code END AS sku_code_snapshot,
    CASE WHEN p.product_id IS NOT NULL THEN k.sku_name END AS sku_name_snapshot, p.product_id,
    p.product_code AS product_code_snapshot, p.product_name AS product_name_snapshot, c.customer_id,
    c.customer_code AS customer_code_snapshot, c.customer_name AS customer_name_snapshot,
    h.channel_id AS channel_id_snapshot, h.channel_code AS channel_code_snapshot, h.channel_name AS channel_name_snapshot,
    r.salesrep_id AS salesrep_id_snapshot, r.salesrep_code AS salesrep_code_snapshot, r.salesrep_name AS salesrep_name_snapshot,
    CASE WHEN early IS NULL AND p.product_id IS NOT NULL THEN 'READY' ELSE 'SKIPPED' END AS status,
    CASE WHEN early IS NOT NULL THEN early WHEN hit IS NULL AND hits > 1 THEN 'SKU_AMBIGUOUS' WHEN hit IS NULL THEN 'SKU_NOT_FOUND'
      WHEN p.product_id IS NULL THEN 'PRODUCT_NOT_ASSIGNED' WHEN c.customer_id IS NULL THEN 'CUSTOMER_NOT_FOUND' END AS mapping_reason
  FROM outcome o
  LEFT JOIN m_sku k ON early IS NULL AND k.sku_id = hit
  LEFT JOIN m_product p ON p.product_id = k.product_id
  LEFT JOIN m_customer c ON p.product_id IS NOT NULL AND c.customer_name = source_customer_name
  LEFT JOIN m_channel h ON h.channel_id = c.channel_id
  LEFT JOIN m_salesrep r ON r.salesrep_id = c.salesrep_id),
fact AS (SELECT * FROM mapped WHERE status = 'READY'),
actuals AS (
  SELECT source_row_no AS row_number, ship_date AS sales_date, c_name AS customer_name,
    CASE WHEN l_suppkey % 31 = 7 THEN '草稿' ELSE '已审核' END AS document_status, 'SKU-' || l_partkey AS sku_code,
    CAST(CASE WHEN l_returnflag = 'R' THEN -qty ELSE qty END AS DECIMAL(28,10)) AS shipped_qty,
    'W' || l_suppkey AS warehouse_name, CASE WHEN l_linenumber <> 7 THEN order_quarter END AS production_date, ship_month
  FROM order_line),
actual_valid AS (
  SELECT a.*, k.sku_id, k.product_id, c.channel_id, c.customer_id FROM actuals a
  JOIN m_customer c ON c.customer_name = a.customer_name JOIN m_sku k ON k.sku_code = a.sku_code AND k.product_id IS NOT NULL
  WHERE document_status = '已审核'),
lot_issue AS (
  SELECT l_partkey, l_suppkey, order_quarter AS production_date, ship_month AS inventory_month,
    CAST(sum(qty) AS DECIMAL(18,3)) AS issue_qty FROM order_line GROUP BY ALL),
lot_run AS (
  SELECT *, sum(issue_qty) OVER w + CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS stock,
    sum(issue_qty) OVER (w ORDER BY inventory_month) AS out_qty, min(inventory_month) OVER w AS first_month
  FROM lot_issue WINDOW w AS (PARTITION BY l_partkey, l_suppkey, production_date)),
inventory AS (
  SELECT CAST('0x' || substr(md5(concat_ws('|', l_partkey, l_suppkey, production_date, inventory_month)), 1, 15) AS BIGINT) AS row_number,
    'SKU-' || l_partkey AS sku_code, 'Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS warehouse_name,
    production_date, inventory_month,
    CAST(CASE WHEN inventory_month = first_month AND l_partkey % 5 <> 0 THEN 0 ELSE stock - out_qty + issue_qty END AS DECIMAL(18,3)) AS opening_qty,
    CAST(CASE WHEN inventory_month = first_month AND l_partkey % 5 <> 0 THEN stock ELSE 0 END AS DECIMAL(18,3)) AS receipt_qty,
    issue_qty, CAST(stock - out_qty AS DECIMAL(18,3)) AS ending_qty FROM lot_run),
inv_valid AS (
  SELECT i.*, k.sku_id, k.product_id, planning_status FROM inventory i
  JOIN m_sku k ON k.sku_code = i.sku_code AND k.sku_status = 'ACTIVE'
  JOIN m_product p ON p.product_id = k.product_id AND p.product_status = 'ACTIVE'
  JOIN policy w ON w.warehouse_name = i.warehouse_name),
inv_plan AS (SELECT * FROM inv_valid WHERE planning_status = 'PLANNING_AVAILABLE'),
incoming AS (
  SELECT 'Sheet1' AS source_sheet_name, source_row_no AS row_number, 'SKU-' || l_partkey AS sku_code,
    'G' || (l_orderkey % 100) AS order_group, CAST(l_orderkey AS VARCHAR) AS order_no,
    CASE WHEN l_linenumber <> 6 THEN CAST(qty AS DECIMAL(28,10)) END AS shipment_qty,
    CASE WHEN l_linenumber % 3 = 1 THEN CAST(qty * 2 AS DECIMAL(28,10)) END AS order_qty,
    CASE WHEN l_partkey % 47 <> 3 THEN ship_date END AS eta, l_linestatus = 'F' AS warehouse_entry_recorded FROM numbered),
incoming_valid AS (
  SELECT i.*, k.sku_id, k.product_id FROM incoming i JOIN m_sku k ON k.sku_code = i.sku_code AND k.product_id IS NOT NULL)
"""


def oracle(body: str, *more: str) -> str:
    """Comparison SQL: the stand-in views, further views, then ``body``.

    A body starting with a comma goes on with views of its own.
    """
    return "WITH " + ",\n".join([SQL.strip(), *more]) + "\n" + body
