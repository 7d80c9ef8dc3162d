"""File contracts: which columns a delivery must have and what they become.

Deliveries are delimited text or Parquet with string columns. Nothing is
inferred: a contract names the source headers, the field of each, its kind and
whether it is required. Header checks run on header rows, not on data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.functions import dates, numbers, text
from stockweave.sources.records import read_records


@dataclass(frozen=True)
class Field:
    name: str
    headers: tuple[str, ...]
    kind: str = "text"
    required: bool = False
    header_required: bool = True


@dataclass(frozen=True)
class Contract:
    name: str
    sheet: str | None
    fields: tuple[Field, ...]
    blank_row_fields: tuple[str, ...] = field(default=())

    @property
    def required_headers(self) -> list[str]:
        return [f.headers[0] for f in self.fields if f.header_required]


def _fields(pairs: dict[str, str], kinds: dict[str, str] | None = None, required: Sequence[str] = (), optional_headers: Sequence[str] = ()) -> tuple[Field, ...]:
    kinds = kinds or {}
    return tuple(
        Field(name, (header,), kinds.get(name, "text"), name in required, header not in optional_headers)
        for header, name in pairs.items()
    )


# Source headers and fields of the deliveries.
SALES = Contract(
    "SALES",
    None,
    _fields(
        {
            "明细信息行号": "line_no",
            "日期": "business_date",
            "单据编号": "document_no",
            "客户": "customer_name",
            "产品类型": "product_type",
            "物料编码": "sku_code",
            "物料名称": "sku_name",
            "实发数量": "quantity",
        }
    ),
)
ACTUALS = Contract(
    "ACTUALS",
    None,
    _fields(
        {
            "日期": "business_date",
            "客户": "customer_name",
            "单据状态": "document_status",
            "物料编码": "sku_code",
            "物料名称": "sku_name",
            "实发数量": "quantity",
            "仓库": "warehouse_name",
            "批号": "batch_no",
            "生产日期": "production_day",
        }
    ),
)
INVENTORY = Contract(
    "INVENTORY",
    None,
    _fields(
        {
            "物料编码": "sku_code",
            "物料名称": "sku_name",
            "仓库名称": "warehouse_name",
            "生产日期": "production_day",
            "有效期至": "expiry_day",
            "批号": "batch_no",
            "库存单位": "inventory_unit",
            "(期初) 数量（库存）": "opening",
            "(收入) 数量（库存）": "receipt",
            "(发出) 数量（库存）": "issue",
            "(结存) 数量（库存）": "ending",
        }
    ),
)
INCOMING = Contract(
    "INCOMING",
    None,
    (
        Field("sku_code", ("SKU编码",), required=True),
        Field("sku_name", ("商品名", "商品名(中)"), required=True),
        Field("shipment_qty", ("出荷数量",), required=True),
        Field("warehouse_entry", ("进仓时间",), required=True),
        Field("order_group", ("订单",), header_required=False),
        Field("factory", ("工厂",), header_required=False),
        Field("departure_port", ("发货港",), header_required=False),
        Field("destination_port", ("目的港",), header_required=False),
        Field("order_no", ("订单号",), header_required=False),
        Field("case_pack", ("入数",), header_required=False),
        Field("order_qty", ("订单数量", "订单数"), header_required=False),
        Field("shipped_total", ("已出合计",), header_required=False),
        Field("difference_qty", ("出荷差额", "差额"), header_required=False),
        Field("batch_no", ("批号",), header_required=False),
        Field("etd", ("ETD",), header_required=False),
        Field("eta", ("ETA",), header_required=False),
        Field("remark", ("备注",), header_required=False),
        Field("vessel_voyage", ("船名/航次",), header_required=False),
        Field("actual_port_arrival", ("实际到港时间", "到港时间"), header_required=False),
        Field("free_container_until", ("免箱期截至时间",), header_required=False),
    ),
    ("sku_code", "sku_name", "shipment_qty", "order_qty"),
)
CHANNEL = Contract("CHANNEL", "渠道属性", _fields({"索引": "source_index", "渠道": "channel_name"}, {"source_index": "code"}, ("channel_name",)))
SALESREP = Contract("SALESREP", "Sheet1", _fields({"销售员": "salesrep_name"}, required=("salesrep_name",)))
CUSTOMER = Contract(
    "CUSTOMER",
    "Customers",
    _fields(
        {
            "客户编码": "customer_code",
            "客户名称": "customer_name",
            "组织": "organization",
            "部门": "department",
            "Business Type": "business_type",
            "Market Type": "market_type",
            "渠道": "channel_ref",
            "销售地区": "region_ref",
            "省份": "province_ref",
            "业态": "format_type",
            "渠道明细": "channel_detail",
            "销售员": "salesrep_ref",
            "是否直营": "is_direct",
            "上级客户": "parent_customer_ref",
            "创建年月": "source_created_ym",
        },
        {"customer_code": "code", "is_direct": "boolean", "source_created_ym": "code"},
        ("customer_code", "customer_name", "channel_ref", "salesrep_ref"),
    ),
)
PRODUCT = Contract(
    "PRODUCT",
    "Product导入",
    _fields({"Product Code": "product_code", "Product 名称": "product_name", "品牌": "brand"}, {"product_code": "code"}, ("product_code", "product_name")),
)
_SKU_ATTRIBUTES = {
    "ERP分组": "product_group",
    "产品形式": "product_form",
    "产地": "origin",
    "产品一级分类（大类）": "category_l1",
    "产品二级分类（品类）": "category_l2",
    "产品三级分类（规格）": "category_l3",
    "产品四级分类（克数）": "category_l4",
    "简称": "short_name",
    "扩展分类": "category_extra",
    "箱规": "case_pack",
}
_SKU_KINDS = {"sku_code": "code", "case_pack": "decimal", "source_created_at": "date"}
SKU_BOOTSTRAP = Contract(
    "SKU",
    "物料列表",
    _fields(
        {"商品编码": "sku_code", "物料名称": "sku_name", **_SKU_ATTRIBUTES, "合并编码": "source_product_code", "创建日期": "source_created_at"},
        {**_SKU_KINDS, "source_product_code": "code"},
        ("sku_code", "sku_name"),
    ),
)
SKU_V1 = Contract(
    "SKU_V1",
    "SKU导入",
    _fields(
        {"SKU Code": "sku_code", "SKU 名称": "sku_name", "所属 Product Code": "product_code_ref", **_SKU_ATTRIBUTES, "创建日期": "source_created_at"},
        _SKU_KINDS,
        ("sku_code", "sku_name", "product_code_ref"),
    ),
)
GOODS = Contract(
    "PRODUCT_SKU",
    "商品导入",
    _fields(
        {
            "商品编码": "sku_code",
            "物料名称": "sku_name",
            **_SKU_ATTRIBUTES,
            "合并编码": "product_code",
            "创建日期": "source_created_at",
            "Product 名称": "product_name",
            "品牌": "brand",
        },
        {**_SKU_KINDS, "product_code": "code"},
        ("sku_code", "sku_name", "product_code"),
        optional_headers=("Product 名称", "品牌"),
    ),
)
DETECTABLE = (CHANNEL, SALESREP, CUSTOMER, PRODUCT, SKU_BOOTSTRAP)


# --- scans -----------------------------------------------------------------


def scan_parquet(spark: SparkSession, path: str, header_rows: int = 1) -> DataFrame:
    """Parquet export with its file name and source row number.

    Row numbers count from the line after the header, as in the source sheet;
    they come from the file's own row index, so no shuffle is needed.
    """
    raw = spark.read.parquet(path)
    return raw.select(
        F.col("_metadata.file_name").alias("source_file"),
        (F.col("_metadata.row_index") + F.lit(header_rows + 1)).alias("row_number"),
        *raw.columns,
    )


def scan_delimited(spark: SparkSession, path: str, headers: Sequence[str], separator: str = ",", header_row: int = 1) -> DataFrame:
    """Delimited export read as strings with its file name and row number.

    Records are told apart by the state of quoted cells (:mod:`records`), so a
    cell may hold line breaks, at the border of two splits too. The first
    ``header_row`` records of every file go by their place, whatever they hold.
    No data cell is looked at, so a blank cell or a record that repeats the
    header stays a row; only wholly blank records are left out.
    """
    body = read_records(spark, path, separator).filter((F.col("record_no") > header_row) & (F.trim("value") != ""))
    schema = ", ".join(f"`{h}` string" for h in headers)
    # the number of characters in a cell is not limited; quotes are doubled, a backslash is a character
    options = {"sep": separator, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}
    cells = F.from_csv("value", F.lit(schema), options).alias("_cells")
    return body.select(cells, "source_file", F.col("record_no").alias("row_number")).select("_cells.*", "source_file", "row_number")


def rows_after_header(raw: DataFrame, header_row: int) -> DataFrame:
    """Data rows of a sheet dump whose header stands on ``header_row``."""
    return raw.filter(F.col("row_number") > header_row)


def apply_contract(raw: DataFrame, contract: Contract, keep: Sequence[str] = ()) -> DataFrame:
    """Source columns renamed to fields; the first present header alias wins.

    Fields whose header is absent become NULL.
    """
    chosen = []
    for item in contract.fields:
        present = [h for h in item.headers if h in raw.columns]
        value = F.col(f"`{present[0]}`").cast("string") if present else F.lit(None).cast("string")
        chosen.append(value.alias(item.name))
    return raw.select(*keep, *chosen)


def with_raw_map(raw: DataFrame, headers: Sequence[str], name: str = "erp_values") -> DataFrame:
    """Keeps every source column, known or not, as a map."""
    return raw.withColumn(name, F.map_from_arrays(F.array(*[F.lit(h) for h in headers]), F.array(*[F.col(f"`{h}`").cast("string") for h in headers])))


def drop_blank_rows(rows: DataFrame, columns: Sequence[str], normalised: bool = False) -> DataFrame:
    """Rows with any value in ``columns``."""
    shape = text.normalize_text if normalised else text.blank_to_null
    return rows.filter(F.coalesce(*[shape(F.col(f"`{c}`")) for c in columns]).isNotNull())


# --- headers ---------------------------------------------------------------


def header_rows(frames: dict[tuple[str, str], DataFrame], spark: SparkSession) -> DataFrame:
    """(file, sheet, position, header) of the given deliveries' columns."""
    rows = [(f, s, i, c) for (f, s), frame in frames.items() for i, c in enumerate(frame.columns, 1)]
    return spark.createDataFrame(rows, "file string, sheet string, position int, header string")


def contract_headers(spark: SparkSession, contracts: Sequence[Contract]) -> DataFrame:
    rows = [(c.name, c.sheet, h) for c in contracts for h in c.required_headers]
    return spark.createDataFrame(rows, "file_type string, sheet string, header string")


def header_findings(headers: DataFrame, contract: Contract, spark: SparkSession) -> DataFrame:
    """Missing and repeated headers per (file, sheet): a batch-level finding each."""
    named = headers.withColumn("header", text.normalize_text("header"))
    files = named.select("file", "sheet").distinct()
    known = named.select("file", "sheet", "header").distinct()
    aliases = spark.createDataFrame(
        [(f.headers[0], h) for f in contract.fields if f.header_required for h in f.headers], "wanted string, header string"
    )
    wanted = aliases.select("wanted").distinct()
    found = known.join(F.broadcast(aliases), "header").select("file", "sheet", "wanted").distinct()
    expected = files.join(F.broadcast(wanted), F.lit(True))
    missing = expected.join(found, ["file", "sheet", "wanted"], "left_anti").select(
        "file", "sheet", F.lit("REQUIRED_COLUMN_MISSING").alias("code"), F.col("wanted").alias("header")
    )
    repeated = (
        named.filter(F.col("header").isNotNull())
        .groupBy("file", "sheet", "header")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("file", "sheet", F.lit("DUPLICATE_COLUMN").alias("code"), "header")
    )
    return missing.unionByName(repeated)


def detect_file_types(headers: DataFrame, contracts: DataFrame) -> DataFrame:
    """Type per file when exactly one contract has its sheet and all its headers."""
    needed = contracts.groupBy("file_type").agg(F.count_distinct("header").alias("needed"))
    matched = (
        headers.withColumn("header", text.strip("header"))
        .join(F.broadcast(contracts), ["sheet", "header"])
        .groupBy("file", "file_type")
        .agg(F.count_distinct("header").alias("matched"))
        .join(F.broadcast(needed), "file_type")
        .filter(F.col("matched") == F.col("needed"))
    )
    per_file = matched.groupBy("file").agg(F.count(F.lit(1)).alias("types"), F.min("file_type").alias("only"))
    files = headers.select("file").distinct()
    return files.join(per_file, "file", "left").select("file", F.when(F.col("types") == 1, F.col("only")).alias("file_type"), F.coalesce("types", F.lit(0)).alias("matching_types"))


def product_sheets(headers: DataFrame) -> DataFrame:
    """Incoming sheets are those with a product-name header; others are skipped."""
    aliases = next(f.headers for f in INCOMING.fields if f.name == "sku_name")
    named = headers.withColumn("header", text.normalize_text("header"))
    return named.filter(F.col("header").isin(*aliases)).select("file", "sheet").distinct()


# --- merged cells ----------------------------------------------------------


def fill_merged(cells: DataFrame, ranges: DataFrame, band: int = 256) -> DataFrame:
    """Every cell of a merged range takes the range's value.

    ``cells``: sheet, row, column, value. ``ranges``: sheet, r0, r1, c0, c1,
    value; ranges of a sheet do not overlap. A range is one row for each of its
    columns and bands of ``band`` rows, and a cell meets the ranges of its own
    band only: at most ``band`` of them, however many a column has. The pieces
    are many more than the ranges the optimizer counts, so they are shuffled
    like the cells and never broadcast through the driver.
    """
    pieces = ranges.withColumn("_c", F.explode(F.sequence("c0", "c1")))
    pieces = pieces.withColumn("_b", F.explode(F.sequence(F.floor(F.col("r0") / band), F.floor(F.col("r1") / band))))
    pieces = pieces.select(F.col("sheet").alias("_s"), "_c", "_b", "r0", "r1", F.struct(F.col("value").alias("v")).alias("_merged"))
    placed = cells.withColumn("_band", F.floor(F.col("row") / band))
    inside = (F.col("sheet") == F.col("_s")) & (F.col("column") == F.col("_c")) & (F.col("_band") == F.col("_b")) & F.col("row").between(F.col("r0"), F.col("r1"))
    joined = placed.join(pieces.hint("merge"), inside, "left")
    value = F.when(F.col("_merged").isNotNull(), F.col("_merged.v")).otherwise(F.col("value"))
    return joined.select("sheet", "row", "column", value.alias("value"))


# --- row normaliser --------------------------------------------------------


def normalize_field(name: str, kind: str, cell_kinds: bool = False) -> tuple[Column, Column]:
    """Normalised value and error text (NULL when fine) of one field."""
    source = F.col(name)
    cell_kind = F.col(f"{name}__kind") if cell_kinds else None
    none = F.lit(None).cast("string")
    if kind == "text":
        return text.normalize_text(source), none
    if kind == "code":
        if cell_kind is None:
            return text.code_text(source), none
        value = text.code_text(source, cell_kind, F.col(f"{name}__format"))
        return value, F.when(text.code_invalid(cell_kind), "code is a boolean")
    if kind == "boolean":
        return text.boolean_word(source).cast("string"), F.when(text.boolean_invalid(source), "not a boolean word")
    if kind == "decimal":
        value = numbers.decimal_text(source)
        return value, F.when(numbers.number_invalid(source), "not a number").when(text.normalize_text(source).isNotNull() & value.isNull(), "number too long")
    if kind == "date":
        value = dates.master_date(source)
        return value, F.when(text.normalize_text(source).isNotNull() & value.isNull(), "ambiguous date")
    raise ValueError(f"unknown field kind: {kind}")


def normalize_rows(rows: DataFrame, contract: Contract, cell_kinds: bool = False) -> DataFrame:
    """Fields normalised by kind; ``errors`` maps a failed field to its reason.

    Source values stay available as ``raw`` (a map).
    """
    names = [f.name for f in contract.fields]
    raw = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(F.col, names))).alias("raw")
    values, errors = [], []
    for item in contract.fields:
        value, error = normalize_field(item.name, item.kind, cell_kinds)
        values.append(value.alias(item.name))
        errors.append(F.struct(F.lit(item.name).alias("key"), error.alias("value")))
    others = [c for c in rows.columns if c not in names and not c.endswith(("__kind", "__format"))]
    failed = F.map_from_entries(F.filter(F.array(*errors), lambda e: e["value"].isNotNull()))
    return rows.select(*others, raw, *values, failed.alias("errors"))
