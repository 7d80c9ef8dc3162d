"""Lot evidence, orders, source choice and the lock of cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.operators import cycle, lots
from stockweave.operators import planning_feeds as feeds
from stockweave.plans import standins as data
from stockweave.plans.planning_queries import _CYCLES, _EVIDENCE, _LOTS, baseline_states, bindings, cycle_products, cycles, final_orders, forecast_lines, lot_evidence, month_id, planning_inventory, stored_facts, versions
from stockweave.plans.registry import query
from stockweave.plans.standins import oracle
from stockweave.sources.staging import stage

_QTY = "DECIMAL(18,3)"

# --- lot evidence ----------------------------------------------------------


def evidence_tables(spark, sf_dir):
    """Revisions with their sources as rows; the first ones were made before some cycles were locked."""
    evidence = stage(lot_evidence(spark, sf_dir).select(*lots.LOT, "revision_id", "revision_no", "evidence", "lifecycle_state", "first_inbound_month", "final_sold_out_month", "consumption_months"))
    sources = evidence.select("revision_id", F.explode("evidence").alias("version"))
    made = F.when(F.col("revision_no") == 1, "1996-06-15").otherwise("2000-06-15").cast("date")
    return evidence.drop("evidence").withColumn("created_at", made), sources


def eligible_lots(spark, sf_dir, facts):
    revisions, sources = evidence_tables(spark, sf_dir)
    return stage(lots.eligible_revisions(revisions, sources, *(f(spark, sf_dir, facts) for f in (cycles, bindings, versions)))), sources


_ELIGIBLE = [
    *_LOTS,
    _EVIDENCE,
    *_CYCLES[:3],
    """lot_source AS (SELECT e.*, m.dataset_version_id AS version FROM evidence e JOIN (SELECT *, row_number() OVER (PARTITION BY product_id, production_date ORDER BY inventory_month) AS n FROM lot_month) m
  ON m.product_id = e.product_id AND m.production_date = e.production_date AND n <= size)""",
    """usable AS (SELECT DISTINCT cycle_id, b.dataset_version_id AS version FROM bind b JOIN vers v ON v.dataset_version_id = b.dataset_version_id AND v.m = b.period_start AND dataset_type = 'INVENTORY')""",
    """eligible AS (SELECT cycle_id, product_id, production_date, revision_id, revision_no, size FROM lot_source JOIN usable USING (version) JOIN cyc USING (cycle_id)
  WHERE status = 'OPEN' OR (CASE WHEN revision_no = 1 THEN DATE '1996-06-15' ELSE DATE '2000-06-15' END) <= last_day(cycle_month) GROUP BY ALL HAVING count(*) = size)""",
]


@query("lot_eligibility", oracle("SELECT cycle_id, product_id, production_date, revision_no, size AS source_count FROM eligible", *_ELIGIBLE))
def lot_eligibility(spark, sf_dir):
    """Two revisions of a lot differ by one source at most."""
    facts = stored_facts(spark, sf_dir)
    return eligible_lots(spark, sf_dir, facts)[0].select("cycle_id", *lots.LOT, "revision_no", "source_count")


def remaining_lots(spark, sf_dir):
    """Raw stock rows as stored, against a product fact that is off for every seventh product."""
    planned = stage(planning_inventory(spark, sf_dir))
    payload = F.to_json(F.struct(F.lit(feeds.PLANNING_AVAILABLE).alias("warehouse_planning_status"), F.col("policy_version").alias("planning_policy_version")))
    raw = planned.withColumn("raw_payload", payload)
    fact = feeds.inventory_months(planned, ["product_id"])
    off = fact.withColumn("ending_qty", (F.col("ending_qty") + F.when(F.col("product_id") % 7 == 0, 1).otherwise(0)).cast("decimal(18,3)"))
    return lots.lot_remaining(raw, off, "inventory_month")


_REMAINING = f"remaining AS (SELECT inventory_month, product_id, production_date, CAST(sum(ending_qty) AS {_QTY}) AS remaining_qty FROM inv_plan WHERE product_id % 7 <> 0 GROUP BY 1, 2, 3)"


@query("lot_remaining", oracle("SELECT * FROM remaining", _REMAINING))
def lot_remaining(spark, sf_dir):
    return remaining_lots(spark, sf_dir)


@query(
    "lot_details",
    oracle(
        f""", one AS (SELECT cycle_id, product_id, production_date, CASE WHEN count(*) FILTER (size = top) = 1 THEN min(revision_id) FILTER (size = top) END AS revision_id
  FROM (SELECT *, max(size) OVER (PARTITION BY cycle_id, product_id, production_date) AS top FROM eligible) GROUP BY 1, 2, 3)
SELECT o.cycle_id, o.product_id, o.production_date, e.lifecycle_state, CASE e.lifecycle_state {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lots.LOT_LABELS.items())} ELSE '{lots.AMBIGUOUS_LABEL}' END AS status_label,
  e.first_inbound_month, e.final_sold_out_month, CASE WHEN e.lifecycle_state = 'SOLD_OUT' THEN e.consumption_months END AS consumption_months, s.through AS observed_through,
  CASE WHEN o.revision_id IS NOT NULL THEN remaining_qty END AS remaining_qty, e.revision_no, coalesce(s.ids, '') AS source_version_ids
FROM one o LEFT JOIN evidence e USING (revision_id) LEFT JOIN (SELECT revision_id, max(m) AS through, string_agg(version, ',' ORDER BY version) AS ids FROM lot_source JOIN vers ON dataset_version_id = version GROUP BY 1) s USING (revision_id)
LEFT JOIN states t ON t.cycle_id = o.cycle_id AND baseline_state = 'Ready' LEFT JOIN remaining r ON r.inventory_month = t.baseline_month AND r.product_id = o.product_id AND r.production_date = o.production_date""",
        *_ELIGIBLE,
        _CYCLES[3],
        _REMAINING,
    ),
)
def lot_details(spark, sf_dir):
    facts = stored_facts(spark, sf_dir)
    eligible, sources = eligible_lots(spark, sf_dir, facts)
    ready = baseline_states(spark, sf_dir, facts).filter("baseline_state = 'Ready'").select("cycle_id", F.col("baseline_month").alias("inventory_month"))
    remaining = ready.join(remaining_lots(spark, sf_dir), "inventory_month").drop("inventory_month")
    shown = lots.lot_details(eligible, sources, versions(spark, sf_dir, facts), remaining)
    return shown.withColumn("source_version_ids", F.array_join("source_version_ids", ","))


# --- forecast history and identities as of the lock ------------------------


def all_versions(spark, sf_dir, facts):
    """Every forecast line as version 1 of its cycle, and twice as much of every even product as version 2."""
    lines = forecast_lines(spark, sf_dir, facts)
    numbered = lines.withColumn("version_no", F.explode(F.when(F.col("product_id") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return numbered.select("cycle_id", "version_no", (F.col("cycle_id") * 10 + F.col("version_no")).alias("forecast_version_id"), "channel_id", "product_id", "forecast_month", (F.col("forecast_qty") * F.col("version_no")).cast("decimal(18,3)").alias("forecast_qty"))


def frozen(spark, sf_dir, facts, wanted, master, key):
    """Identities of the locked cycles as their lock froze them, before the masters were renamed."""
    locked = cycles(spark, sf_dir, facts).filter("status = 'LOCKED'").select("cycle_id")
    return cycle.freeze_identities(wanted.join(locked, "cycle_id", "left_semi"), master, key)


def _renamed(master, name):
    return master.withColumn(name, F.concat(F.lit("Renamed "), name))


@query(
    "forecast_history",
    oracle(
        f"""SELECT cycle_id, cycle_id * 10 + v AS forecast_version_id, v AS version_no, channel_id, product_id, forecast_month, CAST(forecast_qty * v AS {_QTY}) AS forecast_qty,
  CASE WHEN status = 'LOCKED' THEN '' ELSE 'Renamed ' END || channel_name AS channel_name, product_code, CASE WHEN status = 'LOCKED' THEN '' ELSE 'Renamed ' END || product_name AS product_name
FROM fc JOIN (VALUES (1), (2)) n(v) ON v = 1 OR product_id % 2 = 0 JOIN cyc USING (cycle_id) JOIN m_channel USING (channel_id) JOIN m_product USING (product_id)""",
        *_CYCLES,
    ),
)
def forecast_history(spark, sf_dir):
    """A rename after the lock changes the open cycles and leaves the locked ones alone."""
    facts = stored_facts(spark, sf_dir, "actuals")
    lines = stage(all_versions(spark, sf_dir, facts))
    found = []
    for master, key, name in ((data.channel(spark, sf_dir).select("channel_id", "channel_name"), "channel_id", "channel_name"), (data.product(spark, sf_dir).select("product_id", "product_code", "product_name"), "product_id", "product_name")):
        wanted = lines.select("cycle_id", key).distinct()
        found.append(cycle.identities(cycles(spark, sf_dir, facts), wanted, _renamed(master, name), frozen(spark, sf_dir, facts, wanted, master, key), key))
    stored = lines.select("forecast_version_id", "cycle_id", "version_no").distinct()
    return cycle.forecast_history(stored, lines.drop("cycle_id", "version_no"), *found)


@query(
    "lock_snapshot",
    oracle(
        """SELECT cycle_id, 'product' AS kind, product_id AS id, product_name AS name FROM wp JOIN cyc USING (cycle_id) JOIN m_product USING (product_id) WHERE status = 'LOCKED'
UNION ALL SELECT DISTINCT cycle_id, 'channel', channel_id, channel_name FROM fc JOIN cyc USING (cycle_id, cycle_month) JOIN m_channel USING (channel_id) WHERE status = 'LOCKED'""",
        *_CYCLES,
    ),
)
def lock_snapshot(spark, sf_dir):
    """Products of sources, orders and every forecast version, channels of every forecast version."""
    facts = stored_facts(spark, sf_dir, "actuals", "inventory", "incoming")
    lines = all_versions(spark, sf_dir, facts)
    wanted = cycle_products(spark, sf_dir, facts).unionByName(lines.select("cycle_id", "product_id")).distinct()
    products = frozen(spark, sf_dir, facts, wanted, data.product(spark, sf_dir).select("product_id", "product_name"), "product_id")
    channels = frozen(spark, sf_dir, facts, lines.select("cycle_id", "channel_id"), data.channel(spark, sf_dir).select("channel_id", "channel_name"), "channel_id")
    shape = lambda frame, kind: frame.select("cycle_id", F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("id"), F.col(f"{kind}_name").alias("name"))
    return shape(products, "product").unionByName(shape(channels, "channel"))


# --- orders ----------------------------------------------------------------

_ORDERS = f"""stored_order AS (SELECT cycle_id, product_id, order_qty, status, CASE WHEN status = 'CONFIRMED' THEN 'boss' END AS confirmed_by FROM ord),
change AS (SELECT cycle_id, product_id, CAST(order_qty + CASE WHEN product_id % 3 = 1 THEN 1 ELSE 0 END AS {_QTY}) AS new_qty FROM ord WHERE product_id % 3 <> 2
  UNION ALL SELECT cycle_id + 500000, product_id, CAST(5 AS {_QTY}) FROM ord WHERE product_id % 7 = 0)"""


def order_tables(spark, sf_dir):
    """A third of the orders stays, a third gets one piece more, a third is not named; every seventh is asked for in a new cycle."""
    facts = stored_facts(spark, sf_dir, "actuals")
    day = F.lit("2000-01-01").cast("date")
    confirmed = F.col("status") == "CONFIRMED"
    orders = stage(final_orders(spark, sf_dir, facts)).withColumns(
        {"confirmed_by": F.when(confirmed, "boss"), "confirmed_at": F.when(confirmed, day), "updated_by": F.lit("planner"), "updated_at": day}
    )
    third = F.col("product_id") % 3
    same = orders.filter(third != 2).select("cycle_id", "product_id", (F.col("order_qty") + F.when(third == 1, 1).otherwise(0)).cast("decimal(18,3)").alias("new_qty"))
    fresh = orders.filter(F.col("product_id") % 7 == 0).select((F.col("cycle_id") + 500_000).alias("cycle_id"), "product_id", F.lit(5).cast("decimal(18,3)").alias("new_qty"))
    revisions = orders.filter(F.col("product_id") % 2 == 0).select("cycle_id", "product_id", F.explode(F.array(F.lit(1), F.lit(4))).alias("revision_no"))
    return orders, revisions, same.unionByName(fresh)


@query(
    "order_changes",
    oracle(
        """SELECT cycle_id, product_id, coalesce(new_qty, order_qty) AS order_qty, CASE WHEN order_qty IS NULL OR new_qty <> order_qty THEN 'UNCONFIRMED' ELSE status END AS status,
  CASE WHEN order_qty IS NULL OR new_qty <> order_qty THEN NULL ELSE confirmed_by END AS confirmed_by, CASE WHEN order_qty IS NULL OR new_qty <> order_qty THEN 'editor' ELSE 'planner' END AS updated_by
FROM stored_order FULL JOIN change USING (cycle_id, product_id)""",
        *_CYCLES,
        _ORDERS,
    ),
)
def order_changes(spark, sf_dir):
    after = cycle.apply_orders(*order_tables(spark, sf_dir), "editor", F.lit("2000-07-01").cast("date"))[0]
    return after.select("cycle_id", "product_id", "order_qty", "status", "confirmed_by", "updated_by")


@query(
    "order_revisions",
    oracle(
        """SELECT cycle_id, product_id, CASE WHEN product_id % 2 = 0 THEN 5 ELSE 1 END AS revision_no, order_qty, status, confirmed_by FROM stored_order JOIN change USING (cycle_id, product_id) WHERE new_qty <> order_qty""",
        *_CYCLES,
        _ORDERS,
    ),
)
def order_revisions(spark, sf_dir):
    appended = cycle.apply_orders(*order_tables(spark, sf_dir), "editor", F.lit("2000-07-01").cast("date"))[1]
    return appended.select("cycle_id", "product_id", "revision_no", "order_qty", "status", "confirmed_by")


def _confirmation(orders):
    named = orders.filter(F.col("product_id") % 5 < 2).select("cycle_id", "product_id")
    return named.unionByName(named.filter(F.col("product_id") % 5 == 0).select((F.col("cycle_id") + 500_000).alias("cycle_id"), "product_id")).unionByName(named)


@query(
    "order_confirmations",
    oracle(
        """SELECT cycle_id, product_id, order_qty, CASE WHEN product_id % 5 < 2 THEN 'CONFIRMED' ELSE status END AS status,
  CASE WHEN status = 'CONFIRMED' THEN 'boss' WHEN product_id % 5 < 2 THEN 'chief' END AS confirmed_by FROM stored_order""",
        *_CYCLES,
        _ORDERS,
    ),
)
def order_confirmations(spark, sf_dir):
    """Each order is asked for twice; a confirmed one keeps who confirmed it."""
    orders = order_tables(spark, sf_dir)[0]
    return cycle.confirm_orders(orders, _confirmation(orders), "chief", F.lit("2000-07-01").cast("date")).select("cycle_id", "product_id", "order_qty", "status", "confirmed_by")


@query("unknown_confirmations", oracle("SELECT cycle_id + 500000 AS cycle_id, product_id FROM stored_order WHERE product_id % 5 = 0", *_CYCLES, _ORDERS))
def unknown_confirmations(spark, sf_dir):
    orders = order_tables(spark, sf_dir)[0]
    return cycle.unknown_orders(orders, _confirmation(orders))


# --- lock ------------------------------------------------------------------


def lock_case(spark, sf_dir, facts):
    """Every cycle asks to be locked; each rule is broken by some."""
    frame = cycles(spark, sf_dir, facts)
    month, number = F.month("cycle_month"), F.col("cycle_id")
    requests = frame.select("cycle_id", "incoming_snapshot_id", "forecast_version_id")
    snapshots = frame.select("incoming_snapshot_id").distinct().filter("incoming_snapshot_id < 3")
    forecasts = frame.select(F.when(month == 4, number + 500_000).otherwise(number).alias("cycle_id"), "forecast_version_id")
    wanted = stage(cycle_products(spark, sf_dir, facts))
    lost = lambda key: F.when(F.col(key) % 10 == 0, -F.col(key)).otherwise(F.col(key)).alias(key)
    products = data.product(spark, sf_dir).select(lost("product_id"))
    channels = data.channel(spark, sf_dir).select("channel_id")
    lines = forecast_lines(spark, sf_dir, facts).select(F.col("cycle_id"), F.when(F.month("forecast_month") == 12, -F.col("channel_id")).otherwise(F.col("channel_id")).alias("channel_id")).distinct()
    present = frame.filter(month == 10).select("cycle_id")
    found = cycle.lock_findings(
        requests, frame, bindings(spark, sf_dir, facts), versions(spark, sf_dir, facts), snapshots, forecasts, final_orders(spark, sf_dir, facts), wanted, products, lines, channels, present, present.limit(0)
    )
    return frame, requests, stage(found)


_LOCK = [
    *_CYCLES,
    """checked_bind AS (SELECT b.*, v.dataset_type FROM bind b LEFT JOIN vers v USING (dataset_version_id))""",
    """lock_found AS (SELECT cycle_id, 'CYCLE_NOT_OPEN' AS code FROM cyc WHERE status <> 'OPEN'
  UNION SELECT cycle_id, 'BINDING_INVALID' FROM checked_bind WHERE dataset_type IS NULL
  UNION SELECT cycle_id, 'CONFLICTING_VERSIONS' FROM checked_bind WHERE dataset_type IS NOT NULL GROUP BY cycle_id, dataset_type, period_start HAVING count(DISTINCT dataset_version_id) > 1
  UNION SELECT cycle_id, 'ACTUAL_BINDING_MISSING' FROM cyc WHERE cycle_id NOT IN (SELECT cycle_id FROM checked_bind WHERE dataset_type = 'ACTUAL')
  UNION SELECT cycle_id, 'INVENTORY_BINDING_MISSING' FROM cyc WHERE cycle_id NOT IN (SELECT cycle_id FROM checked_bind WHERE dataset_type = 'INVENTORY')
  UNION SELECT cycle_id, 'INCOMING_SNAPSHOT_MISSING' FROM cyc WHERE snapshot IS NULL OR snapshot = 3
  UNION SELECT cycle_id, 'FORECAST_NOT_IN_CYCLE' FROM cyc WHERE month(cycle_month) = 4
  UNION SELECT cycle_id, 'ORDER_MISSING' FROM cyc WHERE cycle_id NOT IN (SELECT cycle_id FROM ord)
  UNION SELECT cycle_id, 'ORDER_UNCONFIRMED' FROM ord WHERE status <> 'CONFIRMED'
  UNION SELECT cycle_id, 'PRODUCT_UNRESOLVED' FROM wp WHERE product_id % 10 = 0
  UNION SELECT cycle_id, 'CHANNEL_UNRESOLVED' FROM fc WHERE month(forecast_month) = 12
  UNION SELECT cycle_id, 'SNAPSHOT_ALREADY_PRESENT' FROM cyc WHERE month(cycle_month) = 10)""",
]


@query("lock_findings", oracle("SELECT * FROM lock_found", *_LOCK))
def lock_findings(spark, sf_dir):
    return lock_case(spark, sf_dir, stored_facts(spark, sf_dir, "actuals", "inventory", "incoming"))[2]


@query(
    "cycle_lock",
    oracle(
        """SELECT cycle_id, CASE WHEN status = 'LOCKED' OR NOT refused THEN 'LOCKED' ELSE 'OPEN' END AS status, CASE WHEN NOT refused THEN 'chief' WHEN status = 'LOCKED' THEN 'planner' END AS locked_by
FROM (SELECT *, cycle_id IN (SELECT cycle_id FROM lock_found WHERE code IN ('CYCLE_NOT_OPEN', 'FORECAST_NOT_IN_CYCLE', 'SNAPSHOT_ALREADY_PRESENT', 'INCOMING_SNAPSHOT_MISSING')) AS refused FROM cyc)""",
        *_LOCK,
    ),
)
def cycle_lock(spark, sf_dir):
    """Orders and identities are taken as settled here, so that some cycles pass."""
    frame, requests, found = lock_case(spark, sf_dir, stored_facts(spark, sf_dir, "actuals", "inventory", "incoming"))
    standing = found.filter(F.col("code").isin("CYCLE_NOT_OPEN", "FORECAST_NOT_IN_CYCLE", "SNAPSHOT_ALREADY_PRESENT", "INCOMING_SNAPSHOT_MISSING"))
    return cycle.lock_cycles(frame, requests, standing, "chief", F.lit("2000-07-01").cast("date")).select("cycle_id", "status", "locked_by")


# --- source choice ---------------------------------------------------------


def source_choice(spark, sf_dir):
    """By quarter of the year: one month twice, one good month, a period that begins on the second, no request."""
    facts = stored_facts(spark, sf_dir)
    frame = cycles(spark, sf_dir, facts)
    turn, before = F.month("cycle_month") % 4, F.add_months("cycle_month", -1)
    entry = lambda start: F.struct(month_id(before).alias("dataset_version_id"), start.alias("period_start"), before.alias("period_end"))
    entries = F.when(turn == 0, F.array(entry(before), entry(before))).when(turn == 1, F.array(entry(before))).when(turn == 2, F.array(entry(F.date_add(before, 1))))
    chosen = frame.select("cycle_id", F.inline(entries))
    return cycle.choose_sources(bindings(spark, sf_dir, facts), chosen, frame, versions(spark, sf_dir, facts))


_CHOICE = [
    *_CYCLES[:3],
    """asked AS (SELECT cycle_id, month(cycle_month) % 4 AS turn, CAST(cycle_month - INTERVAL 1 MONTH AS DATE) AS b, status FROM cyc WHERE month(cycle_month) % 4 <> 3),
known AS (SELECT a.*, b IN (SELECT m FROM vers) AS known FROM asked a),
refusal AS (SELECT cycle_id, 'CYCLE_NOT_OPEN' AS code FROM known WHERE status <> 'OPEN'
  UNION ALL SELECT cycle_id, 'BINDING_INVALID' FROM known WHERE turn = 2 OR NOT known
  UNION ALL SELECT cycle_id, 'SOURCE_MONTHS_OVERLAP' FROM known WHERE turn = 0 AND known)""",
]


@query("source_refusals", oracle("SELECT * FROM refusal", *_CHOICE))
def source_refusals(spark, sf_dir):
    return source_choice(spark, sf_dir)[1]


@query(
    "source_selection",
    oracle(
        """SELECT cycle_id, dataset_version_id, period_start FROM bind WHERE cycle_id NOT IN (SELECT cycle_id FROM known) OR cycle_id IN (SELECT cycle_id FROM refusal)
UNION ALL SELECT cycle_id, year(b) * 100 + month(b), b FROM known WHERE turn = 1 AND cycle_id NOT IN (SELECT cycle_id FROM refusal)""",
        *_CHOICE,
    ),
)
def source_selection(spark, sf_dir):
    return source_choice(spark, sf_dir)[0].select("cycle_id", "dataset_version_id", "period_start")
