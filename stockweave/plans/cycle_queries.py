"""Forecast saves, versions and locks; overview and proposed actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.operators import cycle, masters
from stockweave.operators.resolution import proposed_action
from stockweave.plans import standins as data
from stockweave.plans.planning_queries import _CYCLES, bindings, cycles, month_id
from stockweave.plans.registry import query
from stockweave.plans.standins import oracle

_QTY = "DECIMAL(18,3)"
#: What some lines carry as quantity, by l_partkey % 29.
_ODD_QTY = {3: "-1", 4: "abc", 5: "-0.00000000004", 6: "1.23456", 8: "1e18"}


# --- forecast saves --------------------------------------------------------


def _keyed_lines(spark, sf_dir):
    """Every line with the segment of its customer and the name of its product."""
    orders = data.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    buyers = data.table(spark, sf_dir, "customer").select("c_custkey", F.substring("c_mktsegment", 1, 4).alias("channel_code"))
    parts = data.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_brand", "p_type").alias("product_name"))
    lines = data.lines(spark, sf_dir).withColumn("month", F.trunc("ship_date", "MM"))
    return lines.join(orders, "l_orderkey").join(buyers, "c_custkey").join(parts, "l_partkey")


def forecast_request(spark, sf_dir):
    """A forecast line per shipment, with every kind of fault on a share of them."""
    kind, supplier = F.col("l_partkey") % 29, F.col("l_suppkey") % 19
    text = F.col("qty").cast("string")
    for value, odd in _ODD_QTY.items():
        text = F.when(kind == value, odd).otherwise(text)
    ahead = F.add_months("month", (F.col("l_linenumber") - 1).cast("int"))
    return _keyed_lines(spark, sf_dir).select(
        (month_id("month") + F.when(F.col("l_suppkey") % 23 == 0, 500_000).otherwise(0)).alias("cycle_id"),
        F.when(supplier == 1, "  ").when(supplier == 2, "NOPE").otherwise(F.col("channel_code")).alias("channel_stable_id"),
        F.col("product_name").alias("product_stable_id"),
        F.when(F.col("l_partkey") % 43 == 5, F.date_add(ahead, 1)).otherwise(ahead).alias("forecast_month"),
        text.alias("forecast_qty"),
    )


def _request_masters(spark, sf_dir):
    channels = data.channel(spark, sf_dir).select(F.col("channel_code").alias("channel_stable_id"), "channel_id")
    products = data.product(spark, sf_dir).select(F.col("product_name").alias("product_stable_id"), "product_id")
    return cycles(spark, sf_dir), channels, products


_ODD = ", ".join(str(k) for k in _ODD_QTY)
_REQUEST = [
    _CYCLES[0],
    """keyed AS (SELECT o.*, year(ship_month) * 100 + month(ship_month) AS month_no, substr(c.c_mktsegment, 1, 4) AS channel_code, p_brand || ' ' || p_type AS product_name
  FROM order_line o JOIN customer c ON c.c_custkey = o.o_custkey JOIN part ON p_partkey = l_partkey)""",
    f"""request AS (SELECT CAST(month_no + CASE WHEN l_suppkey % 23 = 0 THEN 500000 ELSE 0 END AS BIGINT) AS cycle_id,
  CASE l_suppkey % 19 WHEN 1 THEN NULL WHEN 2 THEN 'NOPE' ELSE channel_code END AS channel_stable_id, product_name AS product_stable_id,
  CAST(ship_month + INTERVAL (l_linenumber - 1) MONTH + INTERVAL (CASE WHEN l_partkey % 43 = 5 THEN 1 ELSE 0 END) DAY AS DATE) AS forecast_month,
  l_partkey % 29 AS kind, CASE WHEN l_partkey % 29 NOT IN ({_ODD}) THEN CAST(qty AS {_QTY}) END AS forecast_qty FROM keyed)""",
    """checked AS (SELECT r.cycle_id, r.channel_stable_id, r.product_stable_id, channel_id, product_id, forecast_month, forecast_qty,
  CASE WHEN status IS NULL THEN 'CYCLE_NOT_FOUND' WHEN status <> 'OPEN' THEN 'CYCLE_LOCKED' WHEN r.channel_stable_id IS NULL THEN 'IDENTITY_REQUIRED'
    WHEN day(forecast_month) <> 1 THEN 'MONTH_NOT_FIRST_DAY'
    WHEN forecast_month NOT BETWEEN cycle_month AND cycle_month + INTERVAL 3 MONTH THEN 'MONTH_OUTSIDE_HORIZON'
    WHEN kind IN (3, 4, 5) THEN 'QUANTITY_INVALID' WHEN kind IN (6, 8) THEN 'QUANTITY_NOT_EXACT'
    WHEN channel_id IS NULL OR product_id IS NULL THEN 'IDENTITY_UNRESOLVED' WHEN copies > 1 THEN 'DUPLICATE_GRAIN' END AS code
  FROM (SELECT *, count(*) OVER (PARTITION BY cycle_id, channel_stable_id, product_stable_id, forecast_month) AS copies FROM request) r
  LEFT JOIN cyc USING (cycle_id) LEFT JOIN m_channel h ON h.channel_code = r.channel_stable_id LEFT JOIN m_product p ON p.product_name = r.product_stable_id)""",
]


@query("forecast_line_checks", oracle("SELECT * FROM checked", *_REQUEST))
def forecast_line_checks(spark, sf_dir):
    return cycle.check_forecast_lines(forecast_request(spark, sf_dir), *_request_masters(spark, sf_dir))


@query(
    "forecast_duplicate_grains",
    oracle(
        """SELECT cycle_id, channel_stable_id, product_stable_id, forecast_month, count(*) AS copies FROM request
WHERE channel_stable_id IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) > 1""",
        *_REQUEST,
    ),
)
def forecast_duplicate_grains(spark, sf_dir):
    named = forecast_request(spark, sf_dir).filter(F.trim("channel_stable_id") != "")
    return cycle.duplicate_grains(named, "cycle_id", "channel_stable_id", "product_stable_id", "forecast_month")


@query(
    "forecast_missing_cycles",
    oracle("SELECT DISTINCT cycle_id FROM request WHERE cycle_id NOT IN (SELECT cycle_id FROM cyc)", *_REQUEST),
)
def forecast_missing_cycles(spark, sf_dir):
    return cycle.missing_ids(forecast_request(spark, sf_dir), cycles(spark, sf_dir), "cycle_id")


def stored_versions(spark, sf_dir):
    """Versions 1 to 7 by the line numbers shipped; cycles of February have none yet."""
    found = data.lines(spark, sf_dir).select(F.trunc("ship_date", "MM").alias("month"), F.col("l_linenumber").cast("bigint").alias("version_no")).distinct()
    number = month_id("month")
    return found.filter(F.month("month") != 2).select(number.alias("cycle_id"), "version_no", (number * 10 + F.col("version_no")).alias("forecast_version_id"))


_VERSIONS = """stored AS (SELECT DISTINCT CAST(year(ship_month) * 100 + month(ship_month) AS BIGINT) AS cycle_id, CAST(l_linenumber AS BIGINT) AS version_no
  FROM order_line WHERE month(ship_month) <> 2)"""


@query("forecast_next_version", oracle("SELECT cycle_id, max(version_no) + 1 AS next_no FROM stored GROUP BY 1", _VERSIONS))
def forecast_next_version(spark, sf_dir):
    return cycle.next_version(stored_versions(spark, sf_dir), "cycle_id")


@query(
    "forecast_latest",
    oracle(
        """SELECT c.cycle_id, c.cycle_id * 10 + CASE WHEN status = 'LOCKED' THEN 1 ELSE max(version_no) END AS forecast_version_id
FROM cyc c JOIN stored USING (cycle_id) GROUP BY c.cycle_id, status""",
        _CYCLES[0],
        _VERSIONS,
    ),
)
def forecast_latest(spark, sf_dir):
    return cycle.latest_forecast(cycles(spark, sf_dir), stored_versions(spark, sf_dir))


@query(
    "forecast_new_version",
    oracle(
        f"""SELECT cycle_id, coalesce((SELECT max(version_no) + 1 FROM stored s WHERE s.cycle_id = g.cycle_id), 1) AS version_no, channel_id, product_id, forecast_month,
  CAST(sum(qty) AS {_QTY}) AS forecast_qty
FROM (SELECT CAST(month_no AS BIGINT) AS cycle_id, channel_code, product_name, CAST(ship_month + INTERVAL ((l_linenumber - 1) % 4) MONTH AS DATE) AS forecast_month, qty FROM keyed) g
JOIN m_channel USING (channel_code) JOIN m_product USING (product_name)
WHERE cycle_id IN (SELECT cycle_id FROM cyc WHERE status = 'OPEN')
  AND cycle_id NOT IN (SELECT month_no FROM keyed WHERE month_no % 2 = 1 AND l_suppkey % 19 = 1) GROUP BY ALL""",
        *_REQUEST,
        _VERSIONS,
    ),
)
def forecast_new_version(spark, sf_dir):
    """The shipments of a cycle's month as its next version; a blank channel refuses an odd month whole."""
    blank = (F.month("month") % 2 == 1) & (F.col("l_suppkey") % 19 == 1)
    grain = _keyed_lines(spark, sf_dir).select(
        month_id("month").alias("cycle_id"),
        F.when(~blank, F.col("channel_code")).alias("channel_stable_id"),
        F.col("product_name").alias("product_stable_id"),
        F.add_months("month", ((F.col("l_linenumber") - 1) % 4).cast("int")).alias("forecast_month"),
        "qty",
    )
    summed = grain.groupBy("cycle_id", "channel_stable_id", "product_stable_id", "forecast_month").agg(F.sum("qty").cast("string").alias("forecast_qty"))
    checked = cycle.check_forecast_lines(summed, *_request_masters(spark, sf_dir))
    return cycle.append_forecast_version(checked, stored_versions(spark, sf_dir))


@query(
    "forecast_save_findings",
    oracle(
        """, out AS (SELECT DISTINCT cycle_id FROM cyc JOIN order_line ON ship_month = cycle_month WHERE month(cycle_month) % 2 = 1 AND l_linenumber > 4)
SELECT cycle_id + 500000 AS cycle_id, 'CYCLE_NOT_FOUND' AS code FROM cyc WHERE month(cycle_month) = 5
UNION ALL SELECT cycle_id, 'CYCLE_LOCKED' FROM cyc WHERE month(cycle_month) <> 5 AND status = 'LOCKED'
UNION ALL SELECT cycle_id, 'FORECAST_SELECTION_CHANGED' FROM cyc WHERE month(cycle_month) = 3
UNION ALL SELECT cycle_id, 'STORED_MONTH_OUTSIDE_HORIZON' FROM cyc JOIN out USING (cycle_id) WHERE month(cycle_month) <> 5""",
        _CYCLES[0],
    ),
)
def forecast_save_findings(spark, sf_dir):
    frame, month = cycles(spark, sf_dir), F.month("cycle_month")
    requests = frame.select(
        (F.col("cycle_id") + F.when(month == 5, 500_000).otherwise(0)).alias("cycle_id"),
        (F.col("cycle_id") * 10 + F.when(month == 3, 2).otherwise(1)).alias("expected_version_id"),
    )
    start, ahead = F.trunc("ship_date", "MM"), F.col("l_linenumber") - 1
    stored = data.lines(spark, sf_dir).select(
        (month_id(start) * 10 + 1).alias("forecast_version_id"),
        F.add_months(start, F.when(F.month(start) % 2 == 1, ahead).otherwise(ahead % 4).cast("int")).alias("forecast_month"),
    )
    return cycle.forecast_save_findings(requests, frame, stored)


# --- locks -----------------------------------------------------------------


@query(
    "locked_writes",
    oracle(
        """, writes AS (SELECT l_orderkey * 10 + l_linenumber AS write_id, CASE WHEN l_linenumber % 2 = 1 THEN 'inventory_fact' ELSE 'forecast_line' END AS table_name,
  CASE WHEN l_linenumber % 2 = 1 THEN year(ship_month) * 100 + month(ship_month) END AS version_id,
  CASE WHEN l_linenumber % 2 = 0 THEN year(ship_month) * 100 + month(ship_month) END AS cycle_id FROM order_line)
SELECT write_id, table_name, 'VERSION_LOCKED' AS code FROM writes
WHERE version_id IN (SELECT dataset_version_id FROM bind WHERE cycle_id IN (SELECT cycle_id FROM cyc WHERE status = 'LOCKED'))
UNION ALL SELECT write_id, table_name, 'CYCLE_NOT_OPEN' FROM writes WHERE cycle_id IN (SELECT cycle_id FROM cyc WHERE status <> 'OPEN')""",
        *_CYCLES[:2],
    ),
)
def locked_writes(spark, sf_dir):
    odd = F.col("l_linenumber") % 2 == 1
    number = month_id(F.trunc("ship_date", "MM"))
    writes = data.lines(spark, sf_dir).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("write_id"),
        F.when(odd, "inventory_fact").otherwise("forecast_line").alias("table_name"),
        F.when(odd, number).alias("dataset_version_id"),
        F.when(~odd, number).alias("cycle_id"),
    )
    return cycle.locked_writes(writes, cycles(spark, sf_dir), bindings(spark, sf_dir))


# --- overview and proposed actions -----------------------------------------


@query(
    "overview_status_counts",
    oracle(
        " UNION ALL ".join(
            f"SELECT '{name}' AS master, count(*) FILTER (status = 'ACTIVE') AS active, count(*) FILTER (status = 'INACTIVE') AS inactive "
            f"FROM (SELECT {name}_status AS status FROM m_{name})"
            for name in ("channel", "salesrep", "customer", "product", "sku")
        )
    ),
)
def overview_status_counts(spark, sf_dir):
    frames = {f.__name__: (f(spark, sf_dir), f"{f.__name__}_status") for f in (data.channel, data.salesrep, data.customer, data.product, data.sku)}
    return masters.status_counts(frames)


def order_batches(spark, sf_dir):
    """Every order as a batch: its priority is the kind, its key gives the state."""
    states = F.array(*[F.lit(s) for s in _STATES])
    return data.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("batch_id"),
        F.col("o_orderpriority").alias("entity_type"),
        F.element_at(states, (F.col("o_orderkey") % len(_STATES) + 1).cast("int")).alias("status"),
        (F.col("o_custkey") % 100).cast("bigint").alias("total_rows"),
    )


_STATES = ("COMMITTED", *masters.WORK_LABELS)
_BATCHES = f"""batches AS (SELECT o_orderkey AS batch_id, o_orderpriority AS entity_type,
  [{", ".join(f"'{s}'" for s in _STATES)}][CAST(o_orderkey % {len(_STATES)} + 1 AS BIGINT)] AS status, CAST(o_custkey % 100 AS BIGINT) AS total_rows FROM orders)"""


@query(
    "overview_batch_totals",
    oracle("SELECT entity_type, status, count(*) AS batches, CAST(sum(total_rows) AS BIGINT) AS rows FROM batches GROUP BY 1, 2", _BATCHES),
)
def overview_batch_totals(spark, sf_dir):
    return masters.batch_totals(order_batches(spark, sf_dir))


@query(
    "overview_pending_work",
    oracle(
        "SELECT *, CASE status " + " ".join(f"WHEN '{s}' THEN '{w}'" for s, w in masters.WORK_LABELS.items()) + " END AS work FROM batches WHERE status <> 'COMMITTED'",
        _BATCHES,
    ),
)
def overview_pending_work(spark, sf_dir):
    return masters.pending_work(order_batches(spark, sf_dir))


@query(
    "proposed_actions",
    oracle(
        """SELECT c_custkey, CASE WHEN customer_id IS NULL THEN 'NEW' WHEN c_custkey % 7 = 0 OR c_custkey % 5 = 0 THEN 'UPDATE' ELSE 'UNCHANGED' END AS action
FROM customer LEFT JOIN m_customer ON customer_code = 'C' || c_custkey"""
    ),
)
def proposed_actions(spark, sf_dir):
    """Each customer as an import row: some renamed, some with an odd name in spaces, some assigned anew."""
    key, name = F.col("c_custkey"), F.col("c_name")
    rows = data.table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat(F.lit("C"), key.cast("string")).alias("customer_code"),
        F.when(key % 7 == 0, F.concat(name, F.lit(" Ltd"))).when(key % 3 == 0, F.concat(F.lit("  "), name, F.lit(" "))).otherwise(name).alias("source_name"),
        (F.col("c_nationkey") + F.when(key % 5 == 0, 2).otherwise(1)).alias("source_rep"),
    )
    known = data.customer(spark, sf_dir).select("customer_code", "customer_id", "customer_name", "salesrep_id")
    action = proposed_action("customer_id", {"source_name": "customer_name", "source_rep": "salesrep_id"})
    return rows.join(known, "customer_code", "left").select("c_custkey", action.alias("action"))
