"""Scalar functions over whole tables: every row yields texts to parse."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.functions import dates, keys, numbers, text
from stockweave.plans import standins as data
from stockweave.plans.registry import query
from stockweave.plans.standins import oracle



def _stable_sql(kind: str, prefix: str, key: str) -> str:
    alphabet = keys.ID_ALPHABET
    digest = f"sha256('MDM_ID_V1|{kind}|' || {key})"
    symbols = []
    for part in range(4):
        number = f"CAST('0x' || substr({digest}, {part * 5 + 1}, 5) AS BIGINT)"
        symbols += [f"substr('{alphabet}', CAST(({number} >> {shift}) & 31 AS INTEGER) + 1, 1)" for shift in (15, 10, 5, 0)]
    return f"'{prefix}' || " + " || ".join(symbols)


@query("stable_ids", oracle(f"SELECT sku_id, {_stable_sql('SKU', 'SKU_', chr(39) + 'SKU:SOURCE_CODE:' + chr(39) + ' || trim(sku_code)')} AS stable_id FROM m_sku"))
def stable_ids(spark, sf_dir):
    key = keys.identity_key("sku", text.strip("sku_code"))
    return data.sku(spark, sf_dir).select("sku_id", keys.stable_id("SKU", key).alias("stable_id"))


@query(
    "customer_stable_ids",
    oracle(
        f"SELECT customer_id, {_stable_sql('CUSTOMER', 'CUS_', chr(39) + 'CUSTOMER:CODE_NAME:' + chr(39) + ' || (customer_id - 1) || ' + chr(39) + '|' + chr(39) + ' || customer_name')} AS customer_stable_id FROM m_customer"
    ),
)
def customer_stable_ids(spark, sf_dir):
    return data.customer(spark, sf_dir).select("customer_id", "customer_stable_id")


@query(
    "line_no_canonical",
    oracle(
        """SELECT source_row_no, CASE l_partkey % 5 WHEN 0 THEN l_linenumber::VARCHAR WHEN 1 THEN (-l_linenumber)::VARCHAR WHEN 2 THEN '0'
  WHEN 3 THEN NULL ELSE l_linenumber::VARCHAR END AS line_no FROM numbered"""
    ),
)
def line_no_canonical(spark, sf_dir):
    number, turn = F.col("l_linenumber").cast("string"), F.col("l_partkey") % 5
    raw = (
        F.when(turn == 0, F.concat(F.lit(" +00"), number, F.lit(".0 ")))
        .when(turn == 1, F.concat(F.lit("-"), number))
        .when(turn == 2, F.lit("-0"))
        .when(turn == 3, F.concat(number, F.lit(".5")))
        .otherwise(number)
    )
    return data.lines(spark, sf_dir).select("source_row_no", text.line_number(raw).alias("line_no"))


@query(
    "exact_quantity",
    oracle(
        """SELECT source_row_no, CASE l_partkey % 6 WHEN 0 THEN qty WHEN 1 THEN qty * 1000 WHEN 2 THEN NULL WHEN 3 THEN qty WHEN 4 THEN NULL
  ELSE -qty END::DECIMAL(18,4) AS quantity FROM numbered"""
    ),
)
def exact_quantity(spark, sf_dir):
    plain, turn = F.col("qty").cast("string"), F.col("l_partkey") % 6
    raw = (
        F.when(turn == 0, plain)
        .when(turn == 1, F.concat(plain, F.lit("e3")))
        .when(turn == 2, F.concat(plain, F.lit("1")))
        .when(turn == 3, F.concat(F.lit(" +"), plain, F.lit("00000 ")))
        .when(turn == 4, F.concat(F.lit("1"), F.repeat(F.lit("0"), 14)))
        .otherwise(F.concat(F.lit("-"), plain))
    )
    return data.lines(spark, sf_dir).select("source_row_no", numbers.sales_quantity(raw).alias("quantity"))


_FEED_NUMBERS = """feed_numbers AS (
  SELECT *, CASE l_partkey % 8 WHEN 0 THEN price WHEN 3 THEN qty WHEN 4 THEN 0 WHEN 5 THEN 0 WHEN 7 THEN qty END::DECIMAL(36,18) AS number FROM numbered)"""


@query(
    "planning_numbers",
    oracle(
        """SELECT source_row_no, number AS quantity, CASE WHEN l_partkey % 8 = 1 THEN 0 ELSE number END AS or_zero, l_partkey % 8 = 2 AS invalid, l_partkey % 8 = 6 AS wide,
  CASE WHEN l_partkey % 8 NOT IN (1, 2) THEN l_partkey % 8 = 4 END AS negative,
  CASE l_partkey % 8 WHEN 0 THEN rtrim(rtrim(price::VARCHAR, '0'), '.') WHEN 3 THEN rtrim(rtrim(qty::VARCHAR, '0'), '.') WHEN 4 THEN '-0.0000000000000000001'
    WHEN 5 THEN '15e-2147483649' WHEN 6 THEN '15e2147483646' WHEN 7 THEN qty || '00000000000000000123456789' END AS canonical FROM feed_numbers""",
        _FEED_NUMBERS,
    ),
)
def planning_numbers(spark, sf_dir):
    """The functions the feeds use, extreme exponents and digits beyond the stored ones on a share of rows."""
    turn = F.col("l_partkey") % 8
    plain = F.col("qty").cast("string")
    raw = (
        F.when(turn == 0, F.format_number("price", 2))
        .when(turn == 1, F.lit("  "))
        .when(turn == 2, F.lit("1,2x"))
        .when(turn == 4, F.lit("-1e-19"))
        .when(turn == 5, F.lit("1.5e-2147483648"))
        .when(turn == 6, F.lit("1.50e2147483647"))
        .when(turn == 7, F.concat(plain, F.lit("00000000000000000123456789")))
        .otherwise(plain)
    )
    rows = data.lines(spark, sf_dir).select("source_row_no", raw.alias("raw"))
    canonical = rows.select(
        "source_row_no",
        numbers.feed_quantity("raw").alias("quantity"),
        numbers.feed_quantity_or_zero("raw").alias("or_zero"),
        F.coalesce(numbers.number_invalid("raw"), F.lit(False)).alias("invalid"),
        F.coalesce(numbers.not_storable("raw"), F.lit(False)).alias("wide"),
        numbers.decimal_text("raw").alias("canonical"),
    )
    return canonical.withColumn("negative", numbers.is_negative("canonical"))


@query(
    "order_quantities",
    oracle(
        """SELECT source_row_no, CASE WHEN l_partkey % 6 IN (0, 2, 3, 5) THEN qty END::DECIMAL(18,3) AS order_qty, l_partkey % 6 IN (0, 2, 3, 4, 5) AS forecast_valid FROM numbered"""
    ),
)
def order_quantities(spark, sf_dir):
    turn, plain = F.col("l_partkey") % 6, F.col("qty").cast("string")
    raw = F.when(turn == 1, F.concat(F.lit("-"), plain, F.lit("e-2147483648"))).when(turn == 4, F.concat(plain, F.lit("e2147483647"))).otherwise(plain)
    return data.lines(spark, sf_dir).select("source_row_no", numbers.order_quantity(raw).alias("order_qty"), numbers.forecast_valid(raw).alias("forecast_valid"))


@query(
    "date_parsing",
    oracle(
        """SELECT source_row_no, CASE WHEN l_partkey % 7 IN (0, 1, 2, 3) THEN ship_date END AS sales_date,
  CASE WHEN l_partkey % 7 IN (0, 1, 3, 4, 5) THEN ship_date END AS planning_date,
  CASE WHEN l_partkey % 7 IN (0, 1, 4, 5) THEN ship_date::VARCHAR WHEN l_partkey % 7 = 2 THEN ship_date::VARCHAR || 'T08:30:00'
    WHEN l_partkey % 7 = 3 THEN ship_date::VARCHAR || 'T00:00:00' END AS master_date FROM numbered"""
    ),
)
def date_parsing(spark, sf_dir):
    turn = F.col("l_partkey") % 7
    raw = (
        F.when(turn == 0, F.date_format("ship_date", "yyyy-MM-dd"))
        .when(turn == 1, F.date_format("ship_date", "yyyy/M/d"))
        .when(turn == 2, F.date_format("ship_date", "yyyy-MM-dd 08:30:00"))
        .when(turn == 3, F.date_diff("ship_date", F.lit("1899-12-30").cast("date")).cast("string"))
        .when(turn == 4, F.date_format("ship_date", "yyyyMMdd"))
        .when(turn == 5, F.date_format("ship_date", "yyyy.MM.dd"))
        .otherwise(F.lit("2001-02-29"))
    )
    return data.lines(spark, sf_dir).select(
        "source_row_no", dates.sales_date(raw).alias("sales_date"), dates.planning_date(raw).alias("planning_date"), dates.master_date(raw).alias("master_date")
    )


@query(
    "month_arithmetic",
    oracle(
        """SELECT source_row_no, ship_month AS month, CAST(ship_month + INTERVAL 3 MONTH AS DATE) AS month_plus_3,
  day(order_date) = 1 AND ship_date = last_day(order_date) AS complete_month,
  CAST((year(ship_date) - year(order_date)) * 12 + month(ship_date) - month(order_date) + 1 AS INTEGER) AS months FROM order_line"""
    ),
)
def month_arithmetic(spark, sf_dir):
    return data.order_lines(spark, sf_dir).select(
        "source_row_no",
        dates.month_start("ship_date").alias("month"),
        dates.month_offset("ship_date", 3).alias("month_plus_3"),
        dates.is_complete_month("order_date", "ship_date").alias("complete_month"),
        dates.month_count("order_date", "ship_date").alias("months"),
    )


@query(
    "text_keys",
    oracle(
        """SELECT c_custkey, c_name || ' A' AS normalized, lower(c_name || ' A') AS folded, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS flag,
  c_custkey % 4 = 2 AS flag_invalid, 'NAME:' || c_name AS named FROM customer"""
    ),
)
def text_keys(spark, sf_dir):
    raw = F.concat(F.lit("  "), F.col("c_name"), F.lit(" \t　Ａ\n"))
    turn = F.col("c_custkey") % 4
    word = F.when(turn == 0, " YES").when(turn == 1, "否").when(turn == 2, "perhaps").otherwise(" ")
    return data.table(spark, sf_dir, "customer").select(
        "c_custkey",
        text.normalize_text(raw).alias("normalized"),
        text.fold_key(raw).alias("folded"),
        text.boolean_word(word).alias("flag"),
        text.boolean_invalid(word).alias("flag_invalid"),
        text.name_as_code("c_name").alias("named"),
    )


@query(
    "code_cells",
    oracle(
        """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN lpad(p_partkey::VARCHAR, 8, '0')
  WHEN 2 THEN NULL ELSE p_partkey || '.0' END AS code, p_partkey % 4 = 2 AS invalid FROM part"""
    ),
)
def code_cells(spark, sf_dir):
    turn = F.col("p_partkey") % 4
    number = F.col("p_partkey").cast("string")
    cells = data.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(number, F.lit(".0")).alias("cell"),
        F.when(turn == 2, "boolean").when(turn == 3, "text").otherwise("number").alias("kind"),
        F.when(turn == 1, "00000000").otherwise("General").alias("format"),
    )
    return cells.select("p_partkey", text.code_text("cell", "kind", "format").alias("code"), text.code_invalid("kind").alias("invalid"))


@query(
    "display_texts",
    oracle(
        """SELECT source_row_no, format('{:,}', CAST(floor(price) AS BIGINT)) || CASE WHEN price <> floor(price) THEN '.' || rtrim(split_part(price::VARCHAR, '.', 2), '0') ELSE '' END AS quantity,
  CAST(CAST(discount * 100 AS DECIMAL(18,1)) AS VARCHAR) || '%' AS percent FROM numbered"""
    ),
)
def display_texts(spark, sf_dir):
    return data.lines(spark, sf_dir).select("source_row_no", numbers.display_quantity("price").alias("quantity"), numbers.display_percent("discount").alias("percent"))


@query(
    "next_sequence_ids",
    oracle("SELECT 'REG_' || lpad(CAST(max(r_regionkey) + 1 AS VARCHAR), 6, '0') AS next_id FROM region"),
)
def next_sequence_ids(spark, sf_dir):
    last = keys.last_sequence(data.region(spark, sf_dir), "region_stable_id", "REG_")
    return last.select(keys.sequence_text("REG_", F.col("last_number") + 1).alias("next_id"))
