"""Golden values of the scalar functions."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stockweave.functions import dates, keys, numbers, text


@pytest.fixture(scope="module")
def run(spark):
    def apply(function, values):
        rows = [(i, v) for i, v in enumerate(values)]
        frame = spark.createDataFrame(rows, "i int, v string").withColumn("r", function(F.col("v")))
        return [r.r for r in frame.orderBy("i").collect()]

    return apply


def test_line_number(run):
    assert run(text.line_number, [" +007.0 ", "-0", "12", "1.5", "", None, "-003", "9" * 65]) == ["7", "0", "12", None, None, None, "-3", None]


def test_sales_quantity(run):
    got = run(numbers.sales_quantity, ["1.00001", "1e3", ".5", "-2.50000", "99999999999999.9999", "100000000000000", "1e-4", "1e-5", "x", None, "0e99"])
    assert got == [None, Decimal("1000"), Decimal("0.5"), Decimal("-2.5"), Decimal("99999999999999.9999"), None, Decimal("0.0001"), None, None, None, Decimal(0)]


def test_text_keys(run):
    assert run(text.normalize_text, ["ＳＫＵ（１）", " a \t b　c ", "   ", None]) == ["SKU(1)", "a b c", None, None]
    assert run(text.sku_fallback_key, ["　ＡＢ  Ｃ "]) == ["AB  C"]
    assert run(text.fold_key, ["STRASSE", "straße"]) == ["strasse", "strasse"]


def test_collation(spark):
    frame = spark.sql("select 'José' a, 'JOSE' b, 'Josef' c").select((text.collated("a") == text.collated("b")).alias("x"), (text.collated("a") == text.collated("c")).alias("y"))
    assert frame.first() == (True, False)


def test_booleans(run):
    assert run(text.boolean_word, ["是", "YES", "☑", "否", "0", "maybe", ""]) == [True, True, True, False, False, None, None]
    assert run(text.boolean_invalid, ["maybe", ""]) == [True, False]


def test_dates(run):
    day = dt.date(2000, 2, 15)
    assert run(dates.sales_date, ["2000-02-15", "2000/2/15 08:00:00", "36571", "20000215", "2000-02-30", "2000-02/15"]) == [day, day, day, None, None, None]
    assert run(dates.planning_date, ["20000131", "2000.01.31", "36571", "1", "59", "60"]) == [
        dt.date(2000, 1, 31), dt.date(2000, 1, 31), day, dt.date(1900, 1, 1), dt.date(1900, 2, 28), dt.date(1900, 2, 28)]
    assert run(dates.master_date, ["240131", "2024.1.5", "2024-01-31T10:00:00", "spring", "240231", "45000"]) == [
        "2024-01-31", "2024-01-05", "2024-01-31T10:00:00", None, None, "2023-03-15T00:00:00"]


def test_planning_numbers(run):
    assert run(numbers.feed_quantity, ["1,234.5", "", "x"]) == [Decimal("1234.5"), None, None]
    assert run(numbers.feed_quantity_or_zero, ["", "3", "x"]) == [Decimal(0), Decimal(3), None]
    assert run(numbers.decimal_text, ["1,000.500", "1e2", "0.0", "-3.10"]) == ["1000.5", "100", "0", "-3.1"]
    assert run(numbers.order_quantity, ["1.0005", "-1", "2.5"]) == [None, None, Decimal("2.5")]


def test_display(run):
    assert run(numbers.display_quantity, ["12345678901234.0001", "-1000.50", "abc"]) == ["12,345,678,901,234.0001", "-1,000.5", "—"]
    assert run(numbers.display_percent, ["0.1235", "1", "-0.2", "0.12345"]) == ["12.4%", "100.0%", "—", "12.3%"]


def test_share(spark):
    frame = spark.createDataFrame([(Decimal(1), Decimal(3)), (Decimal(1), Decimal(0)), (Decimal(1), Decimal(128))], "a decimal(18,4), b decimal(18,4)")
    assert [r.s for r in frame.select(numbers.share("a", "b").alias("s")).collect()] == [Decimal("0.333333"), Decimal(0), Decimal("0.007812")]


def test_stable_id(run):
    assert run(lambda c: keys.stable_id("SKU", c), ["SKU:SOURCE_CODE:A", " "]) == ["SKU_D1B9AA7Y1XZZJGSV", None]


def test_sequence(spark):
    ids = spark.createDataFrame([("CH000009",), ("CHX",), ("CH000012",)], "id string")
    assert keys.last_sequence(ids, "id", "CH").select(keys.sequence_text("CH", F.col("last_number") + 1)).first()[0] == "CH000013"


def test_codes(spark):
    rows = [("12.0", "number", "00000"), ("12.50", "number", "General"), ("007", "text", "0"), ("1", "boolean", None)]
    frame = spark.createDataFrame(rows, "v string, k string, f string")
    assert [r.c for r in frame.select(text.code_text("v", "k", "f").alias("c")).collect()] == ["00012", "12.5", "007", None]


def test_numbers_are_never_rounded(spark):
    texts = ["-0.00000000004", "1e18", "1,000", "0.12345678901", "-0", "x", "1.50", "12e-3", "+7.", "1.5e-2147483648", "-1.50e2147483647", "1e99999999999999999", "1e999999999999999999999", "-1e-19"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    text = numbers.decimal_text("t")
    got = {r.t: r for r in rows.select("t", text.alias("d"), numbers.is_negative(text).alias("n"), numbers.forecast_valid("t").alias("f"), numbers.sales_quantity("t").alias("s"), numbers.number_invalid("t").alias("bad")).collect()}
    assert [got[t].d for t in texts] == [
        "-0.00000000004", "1" + "0" * 18, "1000", "0.12345678901", "0", None, "1.5", "0.012", "7", "15e-2147483649", "-15e2147483646", "1e99999999999999999", None, "-0.0000000000000000001"]
    assert [t for t in texts if got[t].n] == ["-0.00000000004", "-1.50e2147483647", "-1e-19"]
    assert [t for t in texts if got[t].bad] == ["x", "1e999999999999999999999"]
    assert [t for t in texts if got[t].f] == ["1e18", "0.12345678901", "-0", "1.50", "12e-3", "+7.", "1.5e-2147483648", "1e99999999999999999"]
    assert got["1.5e-2147483648"].s is None and got["-1.50e2147483647"].s is None and got["1.50"].s == Decimal("1.5")


def test_balance_is_exact(spark):
    import random
    from fractions import Fraction

    rng, rows = random.Random(6), []
    for _ in range(300):
        number = lambda: f"{rng.choice(['', '-'])}{rng.randint(0, 10 ** rng.choice([1, 3, 20, 40]))}.{rng.randint(1, 10 ** rng.choice([1, 18, 19, 45]))}"
        a, b, c = number(), number(), number()
        total = Fraction(a) + Fraction(b) - Fraction(c)
        digits = len(a.split(".")[1] + b.split(".")[1] + c.split(".")[1])
        scaled = str(abs(int(total * 10**digits))).rjust(digits + 1, "0")
        d = ("-" if total < 0 else "") + scaled[:-digits] + "." + scaled[-digits:]
        rows.append((a, b, c, d, True))
        rows.append((a, b, c, d[:-1] + str((int(d[-1]) + 1) % 10), False))
    rows += [("1e20000", "5", "5", "1e20000", True), ("1e20000", "5", "5", "2e20000", False), ("0", "0", "0", "0", True), ("1", None, "1", "0", None)]
    frame = spark.createDataFrame(rows, "a string, b string, c string, d string, want boolean")
    got = frame.select("want", numbers.balanced([F.col("a"), F.col("b")], [F.col("c"), F.col("d")]).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_edge_spaces(run):
    for space in text.SPACES:
        assert run(text.strip, [f"{space}a{space}b{space}{space}"]) == [f"a{space}b"]
        assert run(text.squeeze, [f"{space}a{space}{space}b{space}"]) == ["a b"]
    assert len(text.SPACES) == 29 and run(text.strip, ["\u200bx", " ", ""]) == ["\u200bx", "", ""]


def test_numbers_are_valid_by_shape(spark):
    from stockweave.operators import planning_feeds

    texts = ["12.300000000000001", "0.12345678901", "5.551115123125783e-17", "1e-999999", "1" * 15 + "." + "1" * 40, "-999,999,999,999,999.9996", "1e15", "1e30000", "x", "1.2.3", " ", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r for r in rows.select("t", numbers.number_invalid("t").alias("bad"), numbers.not_storable("t").alias("wide"), numbers.feed_quantity("t").alias("q"), numbers.forecast_valid("t").alias("f")).collect()}
    assert [t for t in texts if got[t].bad] == ["x", "1.2.3"] and [t for t in texts if got[t].wide] == texts[5:8]
    assert [got[t].q for t in texts[:5]] == [Decimal(texts[0]), Decimal(texts[1]), Decimal("0.000000000000000056"), 0, Decimal("1" * 15 + "." + "1" * 18)]
    assert [t for t in texts if got[t].f] == [*texts[:5], "1e15", "1e30000"]
    cells = ["shipment_qty", "order_qty", "shipped_total", "difference_qty", "sku_code", "sku_name", "order_group", "order_no", "batch_no", "eta", "warehouse_entry"]
    raw = spark.createDataFrame([("12.300000000000001", "1e15", "x", " ", *["a"] * 5, "2000-01-01", None)], ", ".join(f"{c} string" for c in cells)).withColumn("row_number", F.lit(1))
    row = planning_feeds.type_incoming(raw).first()
    assert {(f.code, f.field) for f in row.findings} == {("INCOMING_QUANTITY_NOT_STORABLE", "order_qty"), ("INCOMING_QUANTITY_INVALID", "shipped_total")}
    assert row.shipment_qty == Decimal("12.300000000000001") and row.shipment_qty_text == "12.300000000000001" and row.difference_qty is None
