"""Deliveries as files: scans by contract, header checks, file types, blank rows, merged cells.

A delivery is written with its source headers to the staging folder, as an
export would leave it, and read back through its contract.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stockweave.operators import sales_feed
from stockweave.plans import standins as data
from stockweave.plans.registry import query
from stockweave.plans.standins import oracle
from stockweave.sources import contracts, registry
from stockweave.sources.staging import shared_folder


def headers(contract, names=None):
    """Source headers of a contract's fields in order."""
    return [f.headers[0] for f in contract.fields if names is None or f.name in names]


def _named(frame, contract, alias=0):
    """Columns under their source headers; ``alias`` takes another name where a field has several."""
    fields = [f for f in contract.fields if f.name in frame.columns]
    return frame.select(*[F.col(f.name).alias(f.headers[min(alias, len(f.headers) - 1)]) for f in fields])


def deliver(frame, kind):
    """Writes the files of a delivery and gives their folder."""
    path = f"{shared_folder(frame.sparkSession)}/delivery-{uuid.uuid4().hex}"
    if kind == "parquet":
        frame.write.parquet(path)
    else:
        options = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}
        frame.write.options(**options).csv(path)
    return path


# --- scans -----------------------------------------------------------------

_BREAKS = "CASE l_partkey % 7 WHEN 1 THEN 'Item ' || chr(10) || '\"A\", ' || l_partkey WHEN 2 THEN chr(10) || chr(10) || 'x,' || l_suppkey || chr(10) WHEN 3 THEN 'back\\slash \"' ELSE 'Item' END"


def _broken_name():
    """Item names with line breaks, quotes, separators and backslashes."""
    turn, part = F.col("l_partkey") % 7, F.col("l_partkey").cast("string")
    return (
        F.when(turn == 1, F.concat(F.lit('Item \n"A", '), part))
        .when(turn == 2, F.concat(F.lit("\n\nx,"), F.col("l_suppkey").cast("string"), F.lit("\n")))
        .when(turn == 3, F.lit('back\\slash "'))
        .otherwise("Item")
    )


@query(
    "sales_export_scan",
    oracle(
        f"""SELECT CAST(l_linenumber AS VARCHAR) AS line_no, CAST(ship_date AS VARCHAR) AS business_date, CAST(l_orderkey AS VARCHAR) AS document_no, c_name AS customer_name,
  'STANDARD' AS product_type, 'SKU-' || l_partkey AS sku_code, {_BREAKS} AS sku_name, CAST(qty AS VARCHAR) AS quantity FROM order_line"""
    ),
)
def sales_export_scan(spark, sf_dir):
    """Every line of the sales export, breaks and quotes inside its cells included."""
    lines = data.order_lines(spark, sf_dir)
    text = lambda c: F.col(c).cast("string")
    rows = lines.select(
        text("l_linenumber").alias("line_no"),
        F.date_format("ship_date", "yyyy-MM-dd").alias("business_date"),
        text("l_orderkey").alias("document_no"),
        F.col("c_name").alias("customer_name"),
        F.lit("STANDARD").alias("product_type"),
        F.concat(F.lit("SKU-"), text("l_partkey")).alias("sku_code"),
        _broken_name().alias("sku_name"),
        text("qty").alias("quantity"),
    )
    path = deliver(_named(rows, contracts.SALES), "csv")
    scanned = contracts.scan_delimited(spark, path, headers(contracts.SALES))
    return contracts.apply_contract(scanned, contracts.SALES)


@query(
    "inventory_export_scan",
    oracle(
        """SELECT sku_code, warehouse_name || CASE WHEN row_number % 5 = 0 THEN chr(10) || 'hall "2"' ELSE '' END AS warehouse_name, CAST(production_date AS VARCHAR) AS production_day,
  opening_qty::VARCHAR AS opening, receipt_qty::VARCHAR AS receipt, issue_qty::VARCHAR AS issue, ending_qty::VARCHAR AS ending FROM inventory"""
    ),
)
def inventory_export_scan(spark, sf_dir):
    rows = data.inventory_rows(spark, sf_dir)
    hall = F.when(F.col("row_number") % 5 == 0, '\nhall "2"').otherwise("")
    cells = rows.select(
        "sku_code",
        F.concat("warehouse_name", hall).alias("warehouse_name"),
        F.date_format("production_date", "yyyy-MM-dd").alias("production_day"),
        *[F.col(f"{c}_qty").cast("string").alias(c) for c in ("opening", "receipt", "issue", "ending")],
    )
    named = _named(cells, contracts.INVENTORY)
    scanned = contracts.scan_delimited(spark, deliver(named, "csv"), named.columns)
    return contracts.apply_contract(scanned, contracts.INVENTORY).select(*cells.columns)


@query(
    "actuals_export_scan",
    oracle(
        """SELECT CAST(ship_date AS VARCHAR) AS business_date, c_name AS customer_name, 'SKU-' || l_partkey AS sku_code, CAST(qty AS VARCHAR) AS quantity,
  CASE WHEN l_linenumber <> 7 THEN CAST(order_quarter AS VARCHAR) END AS production_day, true AS numbered_once FROM order_line"""
    ),
)
def actuals_export_scan(spark, sf_dir):
    """A Parquet export; its rows are numbered from the line after the header of their file."""
    lines = data.order_lines(spark, sf_dir)
    quarter = F.to_date(F.date_trunc("quarter", F.col("order_date")))
    cells = lines.select(
        F.date_format("ship_date", "yyyy-MM-dd").alias("business_date"),
        F.col("c_name").alias("customer_name"),
        F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string")).alias("sku_code"),
        F.col("qty").cast("string").alias("quantity"),
        F.when(F.col("l_linenumber") != 7, F.date_format(quarter, "yyyy-MM-dd")).alias("production_day"),
    )
    scanned = contracts.scan_parquet(spark, deliver(_named(cells, contracts.ACTUALS), "parquet"))
    sizes = scanned.groupBy("source_file").agg(F.count(F.lit(1)).alias("_rows"), F.min("row_number").alias("_first"), F.max("row_number").alias("_last"))
    rows = contracts.apply_contract(scanned, contracts.ACTUALS, keep=("source_file", "row_number"))
    once = ((F.col("_first") == 2) & (F.col("_last") == F.col("_rows") + 1)).alias("numbered_once")
    return rows.join(sizes, "source_file").select(*cells.columns, once)


@query(
    "incoming_export_scan",
    oracle(
        """SELECT sku_code, 'Item' AS sku_name, CAST(shipment_qty AS VARCHAR) AS shipment_qty, order_group, order_no, CAST(order_qty AS VARCHAR) AS order_qty, CAST(eta AS VARCHAR) AS eta,
  NULL::VARCHAR AS factory FROM incoming"""
    ),
)
def incoming_export_scan(spark, sf_dir):
    """Two sheets of supply, one with the second name of every header that has two; an absent optional header gives NULL."""
    rows = data.incoming_rows(spark, sf_dir)
    text = lambda c: F.col(c).cast("string").alias(c)
    cells = rows.select("sku_code", F.lit("Item").alias("sku_name"), text("shipment_qty"), "order_group", "order_no", text("order_qty"), F.date_format("eta", "yyyy-MM-dd").alias("eta"))
    parts = []
    for alias in (0, 1):
        half = cells.filter((F.col("order_no").cast("bigint") % 2) == alias)
        scanned = contracts.scan_parquet(spark, deliver(_named(half, contracts.INCOMING, alias), "parquet"))
        parts.append(contracts.apply_contract(scanned, contracts.INCOMING).select(*cells.columns, "factory"))
    return parts[0].unionByName(parts[1])


@query(
    "master_file_scan",
    oracle(
        """SELECT 'CUSTOMER' AS file_type, 'C' || c_custkey AS code, c_name AS name, c_mktsegment AS detail FROM customer
UNION ALL SELECT 'PRODUCT', p_partkey::VARCHAR, p_name, p_brand FROM part UNION ALL SELECT 'SALESREP', NULL, n_name, NULL FROM nation UNION ALL SELECT 'CHANNEL', r_regionkey::VARCHAR, r_name, NULL FROM region"""
    ),
)
def master_file_scan(spark, sf_dir):
    table = lambda name: data.table(spark, sf_dir, name)
    files = {
        contracts.CUSTOMER: table("customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("customer_code"), F.col("c_name").alias("customer_name"), F.col("c_mktsegment").alias("channel_ref")),
        contracts.PRODUCT: table("part").select(F.col("p_partkey").cast("string").alias("product_code"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("brand")),
        contracts.SALESREP: table("nation").select(F.col("n_name").alias("salesrep_name")),
        contracts.CHANNEL: table("region").select(F.col("r_regionkey").cast("string").alias("source_index"), F.col("r_name").alias("channel_name")),
    }
    shown = {"CUSTOMER": ("customer_code", "customer_name", "channel_ref"), "PRODUCT": ("product_code", "product_name", "brand"), "SALESREP": (None, "salesrep_name", None), "CHANNEL": ("source_index", "channel_name", None)}
    out = None
    for contract, cells in files.items():
        rows = contracts.apply_contract(contracts.scan_parquet(spark, deliver(_named(cells, contract), "parquet")), contract)
        columns = [(F.col(c) if c else F.lit(None).cast("string")).alias(name) for c, name in zip(shown[contract.name], ("code", "name", "detail"), strict=True)]
        part = rows.select(F.lit(contract.name).alias("file_type"), *columns)
        out = part if out is None else out.unionByName(part)
    return out


# --- headers ---------------------------------------------------------------


def _header_cells(spark, sf_dir, contract):
    """A file per supplier with the contract's headers: of every fifth the first is missing, of every seventh the second stands twice."""
    names = F.array(*[F.lit(h) for h in headers(contract)])
    files = data.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("file"), F.lit(contract.sheet or "Sheet1").alias("sheet"))
    listed = F.when(F.col("s_suppkey") % 5 == 0, F.slice(names, 2, 999)).otherwise(names)
    listed = F.concat(listed, F.when(F.col("s_suppkey") % 7 == 0, F.slice(names, 2, 1)).otherwise(F.array().cast("array<string>")))
    return files.select("file", "sheet", F.posexplode(listed).alias("position", "header")).withColumn("header", F.concat(F.lit(" "), "header"))


@query(
    "header_findings",
    oracle(
        f"""SELECT s_name AS file, 'Sheet1' AS sheet, 'REQUIRED_COLUMN_MISSING' AS code, '{headers(contracts.SALES)[0]}' AS header FROM supplier WHERE s_suppkey % 5 = 0
UNION ALL SELECT s_name, 'Sheet1', 'DUPLICATE_COLUMN', '{headers(contracts.SALES)[1]}' FROM supplier WHERE s_suppkey % 7 = 0"""
    ),
)
def header_findings(spark, sf_dir):
    return contracts.header_findings(_header_cells(spark, sf_dir, contracts.SALES), contracts.SALES, spark)


@query(
    "file_types",
    oracle(
        """SELECT s_name AS file, CASE WHEN s_suppkey % 5 <> 0 THEN 'CUSTOMER' END AS file_type, CASE WHEN s_suppkey % 5 <> 0 THEN 1 ELSE 0 END AS matching_types FROM supplier"""
    ),
)
def file_types(spark, sf_dir):
    known = contracts.contract_headers(spark, contracts.DETECTABLE)
    return contracts.detect_file_types(_header_cells(spark, sf_dir, contracts.CUSTOMER), known)


@query("blank_rows", oracle("SELECT row_number FROM (SELECT source_row_no AS row_number, l_partkey FROM order_line) WHERE l_partkey % 4 <> 0"))
def blank_rows(spark, sf_dir):
    """Rows of spaces only go, a row with a single value stays."""
    turn = F.col("l_partkey") % 4
    rows = data.lines(spark, sf_dir).select(
        F.col("source_row_no").alias("row_number"),
        F.when(turn == 1, "x").when(turn == 0, " \t").alias("document_no"),
        F.when(turn == 2, " y ").when(turn == 0, "　").alias("sku_code"),
        F.when(turn == 3, "0").alias("quantity"),
    )
    return sales_feed.drop_blank_rows(rows, "document_no", "sku_code", "quantity").select("row_number")


# --- checksums and merged cells --------------------------------------------


@query(
    "checksum_format",
    oracle("SELECT o_orderkey, o_orderkey % 4 = 0 AS valid FROM orders"),
)
def checksum_format(spark, sf_dir):
    turn, digest = F.col("o_orderkey") % 4, F.sha2(F.col("o_orderkey").cast("string"), 256)
    orders = data.table(spark, sf_dir, "orders")
    given = F.when(turn == 0, digest).when(turn == 1, F.concat(F.lit("G"), F.substring(digest, 2, 63))).when(turn == 2, F.substring(digest, 1, 63))
    return orders.select("o_orderkey", given.alias("checksum")).select("o_orderkey", registry.checksum_valid("checksum").alias("valid"))


@query(
    "merged_cells",
    oracle(
        """, cell AS (SELECT l_suppkey AS sheet, o_custkey AS row, l_linenumber AS col, min(source_row_no) AS v FROM order_line GROUP BY 1, 2, 3),
band AS (SELECT s_suppkey AS sheet, b * 400 AS r0, b * 400 + 399 AS r1, 1 + b % 6 AS c0, 2 + b % 6 AS c1, 'merged ' || s_suppkey || ' ' || b AS v
  FROM supplier, (SELECT unnest(range(0, 60)) AS b) WHERE b % 2 = s_suppkey % 2)
SELECT c.sheet, c.row, c.col AS "column", coalesce(b.v, c.v::VARCHAR) AS value FROM cell c
LEFT JOIN band b ON b.sheet = c.sheet AND c.row BETWEEN r0 AND r1 AND c.col BETWEEN c0 AND c1"""
    ),
)
def merged_cells(spark, sf_dir):
    """A sheet per supplier, a row per customer; tall ranges two columns wide."""
    cells = data.order_lines(spark, sf_dir).groupBy(F.col("l_suppkey").alias("sheet"), F.col("o_custkey").alias("row"), F.col("l_linenumber").alias("column")).agg(F.min("source_row_no").cast("string").alias("value"))
    supplier = F.col("s_suppkey")
    bands = data.table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(59).cast("bigint"))).alias("b")).filter(F.col("b") % 2 == supplier % 2)
    ranges = bands.select(
        supplier.alias("sheet"),
        (F.col("b") * 400).alias("r0"),
        (F.col("b") * 400 + 399).alias("r1"),
        (1 + F.col("b") % 6).alias("c0"),
        (2 + F.col("b") % 6).alias("c1"),
        F.concat_ws(" ", F.lit("merged"), supplier.cast("string"), F.col("b").cast("string")).alias("value"),
    )
    return contracts.fill_merged(cells, ranges)
