"""Contract status of every import kind, audits of every table, differences of known customers, listings, maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.operators import audit, cycle, dashboard, findings, master_import, masters
from stockweave.operators.findings import finding, no_findings, with_findings
from stockweave.plans import standins as data
from stockweave.plans.master_queries import _codes
from stockweave.plans.planning_queries import _CYCLES, bindings, cycles, stored_facts, versions
from stockweave.plans.registry import query
from stockweave.plans.sales_queries import sales_fact
from stockweave.plans.standins import oracle
from stockweave.sources import contracts

# --- contract status -------------------------------------------------------

_UNKNOWN = "MDM_IMPORT_SOMETHING_ELSE"
_KINDS = {kind: [*dict.fromkeys(code for codes in found.values() for code in codes), _UNKNOWN] for kind, found in findings.CATALOGUES.items()}


def _category(kind: str, code: str) -> str:
    return next((c for c, codes in findings.CATALOGUES[kind].items() if code in codes), "BLOCK")


def _status_sql() -> str:
    parts = []
    for kind, codes in _KINDS.items():
        n = len(codes) + 1
        listed = "[" + ", ".join(f"'{_category(kind, c)}'" for c in codes) + "]"
        pair = f"[{listed}[p_partkey % {n} + 1], {listed}[p_partkey // {n} % {n} + 1]]"
        status = f"CASE WHEN list_has_any(c, ['BLOCK', 'FILE']) THEN 'ERROR' WHEN list_contains(c, 'EXISTING') THEN 'EXISTING' WHEN list_contains(c, 'DECIDE') THEN 'WARNING' ELSE 'READY' END"
        parts.append(f"SELECT '{kind}' AS kind, p_partkey, {status} AS status FROM (SELECT p_partkey, {pair} AS c FROM part)")
    return " UNION ALL ".join(parts)


@query("contract_status_kinds", _status_sql())
def contract_status_kinds(spark, sf_dir):
    """Two findings a row, over every pair of codes of each import kind, an unknown code and none among them."""
    out = None
    for kind, codes in _KINDS.items():
        n, k = len(codes) + 1, F.col("p_partkey")
        rows = data.table(spark, sf_dir, "part").select("p_partkey", k.alias("row_number")).withColumn("findings", no_findings())
        listed = F.array(*[F.lit(c) for c in codes])
        for place in (k % n, F.floor(k / n) % n):
            code = F.try_element_at(listed, (place + 1).cast("int"))
            rows = with_findings(rows, [finding(code.isNotNull(), code)])
        part = rows.select(F.lit(kind).alias("kind"), "p_partkey", findings.contract_status(kind).alias("status"))
        out = part if out is None else out.unionByName(part)
    return out


# --- table rules -----------------------------------------------------------


def _faulty_tables(spark, sf_dir):
    """Every rule table from the orders: an order whose key ends in j breaks rule j and no other."""
    k = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    month = F.trunc(day, "MM")
    off = F.date_add(month, 1)
    none = lambda kind: F.lit(None).cast(kind)
    is_ = lambda j: k % 10 == j
    bad = lambda j, broken, fine: F.when(is_(j), broken).otherwise(fine)
    tables = {
        "sales_import_batch": {
            "file_hash": bad(0, F.lit("X"), F.sha2(k.cast("string"), 256)), "total_rows": bad(1, -1, 3), "ready_rows": F.lit(1), "skipped_rows": F.lit(1),
            "data_date_start": day, "data_date_end": bad(2, F.date_sub(day, 1), day), "status": bad(3, "ODD", "PUBLISHED"),
        },
        "sales_import_row": {"source_row_no": bad(0, 0, 5), "status": bad(1, "ODD", "READY")},
        "sales_mapping_issue": {"affected_row_count": bad(0, 0, 1)},
        "sales_fact": {"actual_qty": bad(0, -1, 1)},
        "planning_cycle": {"cycle_month": bad(0, off, month), "status": bad(1, "HALF", "OPEN"), "locked_at": none("date"), "locked_by": F.when(is_(2), "x")},
        "dataset_version": {"dataset_type": bad(0, "X", "ACTUAL"), "period_start": bad(2, off, month), "period_end": F.when(is_(1), F.add_months(month, -1)).when(is_(2), F.add_months(month, 1)).otherwise(month)},
        "inventory_raw": {"opening_qty": bad(1, -1, 5), "receipt_qty": F.lit(1), "issue_qty": F.lit(2), "ending_qty": F.when(is_(0), 9).when(is_(1), -2).otherwise(4), "inventory_month": bad(2, off, month)},
        "production_lot_lifecycle": {
            "lifecycle_state": F.when(is_(0), "ODD").when(is_(2) | is_(3), "SOLD_OUT").otherwise("ACTIVE"), "final_sold_out_month": F.when(is_(1) | is_(2) | is_(3), month),
            "consumption_months": F.when(is_(2), 0), "first_inbound_month": F.when(is_(2), month).when(is_(3), F.add_months(month, 1)),
        },
        "final_order": {"order_qty": bad(0, -1, 1), "status": F.when(is_(1), "ODD").when(is_(2), "CONFIRMED").otherwise("UNCONFIRMED"), "confirmed_by": none("string"), "confirmed_at": none("date")},
        "forecast_line": {"forecast_qty": bad(0, -1, 1), "forecast_month": bad(1, off, month)},
        "import_batch": {"total_rows": F.lit(3), "error_rows": bad(0, 5, 1), "warning_rows": F.lit(0), "review_version": bad(1, 0, 1)},
        "import_row": {"row_number": bad(0, 0, 1), "status": F.lit("READY"), "reviewed_values": bad(1, none("string"), F.lit("{}"))},
    }
    orders = data.table(spark, sf_dir, "orders")
    return {name: orders.select("o_orderkey", *[c.alias(n) for n, c in columns.items()]) for name, columns in tables.items()}


#: Rules by table in their order; the SQL counts the orders made to break each.
_RULES = {
    "sales_import_batch": ("file_hash", "row_counts", "date_range", "status"),
    "sales_import_row": ("row_number", "status"),
    "sales_mapping_issue": ("row_count",),
    "sales_fact": ("quantity_positive",),
    "planning_cycle": ("month_start", "status", "lock_columns"),
    "dataset_version": ("type", "period_order", "period_month_start"),
    "inventory_raw": ("balance", "non_negative", "month_start"),
    "production_lot_lifecycle": ("state", "sold_out", "consumption", "month_order"),
    "final_order": ("quantity", "status", "confirmation"),
    "forecast_line": ("quantity", "month_start"),
    "import_batch": ("counts", "review_version"),
    "import_row": ("row_number", "reviewed"),
}


@query(
    "constraint_audit_all",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{r}' AS rule, count(*) FILTER (o_orderkey % 10 = {j}) AS broken_rows FROM orders" for t, rules in _RULES.items() for j, r in enumerate(rules)),
)
def constraint_audit_all(spark, sf_dir):
    out = None
    for name, frame in _faulty_tables(spark, sf_dir).items():
        counts = audit.violation_counts(frame, name)
        out = counts if out is None else out.unionByName(counts)
    return out


# --- differences of known customers ----------------------------------------

_REFS = {"channel": "c_mktsegment", "salesrep": "n_name", "region": "r_name", "province": "n_name", "parent_customer": "c_name"}
_DIFFERENT = [*master_import.CUSTOMER_FIELDS, *[f"{r}_stable_id" for r in master_import.REFERENCES]]


@query(
    "existing_differences",
    oracle(
        f""", c AS (SELECT c_custkey AS k, c_mktsegment, c_name, [{", ".join(f"'{f}'" for f in _DIFFERENT)}][c_custkey % 15 + 1] AS field FROM customer)
SELECT k AS row_number, coalesce(field, '') AS fields, CASE WHEN field IS NOT NULL THEN CASE WHEN field LIKE '%stable_id' THEN 'ID ' ELSE 'own ' END || k END AS source_value,
  CASE WHEN field IS NOT NULL AND NOT field LIKE '%stable_id' THEN 'stored ' || k WHEN field IS NOT NULL AND k % 2 = 0 THEN 'OLD ' || k END AS master_value,
  c_mktsegment AS source_channel, 'Now ' || c_mktsegment AS master_channel, CASE WHEN k % 37 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS master_status FROM c"""
    ),
)
def existing_differences(spark, sf_dir):
    """Each customer differs in one field or reference, or in none; half of the references are missing in the master."""
    k, key = F.col("c_custkey"), F.col("c_custkey").cast("string")
    base = data.table(spark, sf_dir, "customer")
    base = base.join(data.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey")), "c_nationkey").join(data.table(spark, sf_dir, "region").select("r_regionkey", "r_name"), "r_regionkey")
    stable = F.concat(F.lit("CUS_"), key)
    turn = k % 15

    def fields(side):
        values = {}
        for i, name in enumerate(_DIFFERENT):
            own = F.concat(F.lit("ID " if name.endswith("stable_id") else "own "), key)
            stored = F.when(k % 2 == 0, F.concat(F.lit("OLD "), key)) if name.endswith("stable_id") else F.concat(F.lit("stored "), key)
            values[name] = own if side == "source" else F.when(turn == i, stored).otherwise(own)
        return [v.alias(n) for n, v in values.items()]

    names = [F.concat(F.lit("C"), key).alias("customer_code"), F.col("c_name").alias("customer_name")]
    rows = base.select(F.lit("B1").alias("batch_id"), k.alias("row_number"), stable.alias("matched_stable_id"), *names, *fields("source"), *[F.col(c).alias(f"{r}_ref") for r, c in _REFS.items()])
    status = F.when(k % 37 == 0, "INACTIVE").otherwise("ACTIVE").alias("customer_status")
    master = base.select(stable.alias("customer_stable_id"), *names, *fields("master"), *[F.concat(F.lit("Now "), F.col(c)).alias(f"{r}_name") for r, c in _REFS.items()], status)
    found = master_import.existing_differences(rows, master)
    pair = F.element_at(F.map_values("differences"), 1)
    value = lambda side: F.when(F.size("differences") > 0, F.get_json_object(pair, f"$.{side}")).alias(f"{side}_value")
    return found.select(
        "row_number",
        F.array_join(F.array_sort(F.map_keys("differences")), ",").alias("fields"),
        value("source"),
        value("master"),
        F.get_json_object("source_snapshot", "$.references.channel.value").alias("source_channel"),
        F.get_json_object("master_snapshot", "$.references.channel.name").alias("master_channel"),
        F.get_json_object("master_snapshot", "$.status").alias("master_status"),
    )


# --- bootstrap names, listings ---------------------------------------------


@query(
    "bootstrap_salesreps",
    oracle(
        """SELECT n_nationkey AS row_number, CASE WHEN n_nationkey % 4 < 2 THEN 'CONFLICT' ELSE 'NEW' END AS action,
  CASE WHEN n_nationkey % 7 = 3 THEN 'MDM_IMPORT_REQUIRED_FIELD_MISSING' WHEN n_nationkey % 4 < 2 THEN 'MDM_IMPORT_SALESREP_AMBIGUOUS' ELSE '' END AS codes
FROM nation WHERE n_nationkey % 7 <> 3 UNION ALL SELECT n_nationkey, 'NEW', 'MDM_IMPORT_REQUIRED_FIELD_MISSING' FROM nation WHERE n_nationkey % 7 = 3"""
    ),
)
def bootstrap_salesreps(spark, sf_dir):
    k = F.col("n_nationkey")
    name = F.when(k % 7 == 3, " ").when(k % 4 < 2, F.concat(F.lit("Shared "), (k % 4).cast("string"))).otherwise(F.col("n_name"))
    rows = data.table(spark, sf_dir, "nation").select(F.lit("B1").alias("batch_id"), k.alias("row_number"), name.alias("salesrep_name"))
    rows = master_import.start_rows(contracts.normalize_rows(rows, contracts.SALESREP), contracts.SALESREP)
    return master_import.bootstrap_salesreps(rows).select("row_number", "action", _codes())


@query(
    "overview_top_groups",
    oracle(
        """, latest AS (SELECT * FROM fact WHERE snapshot_month = (SELECT max(snapshot_month) FROM fact))
(SELECT 'product' AS dimension, product_name_snapshot AS name, CAST(sum(actual_qty) AS DECIMAL(28,4)) AS qty FROM latest GROUP BY product_id, product_name_snapshot ORDER BY qty DESC, product_id LIMIT 5)
UNION ALL (SELECT 'channel', channel_name_snapshot, CAST(sum(actual_qty) AS DECIMAL(28,4)) AS qty FROM latest GROUP BY channel_id_snapshot, channel_name_snapshot ORDER BY qty DESC, channel_id_snapshot NULLS FIRST LIMIT 5)"""
    ),
)
def overview_top_groups(spark, sf_dir):
    """Five largest products and channels of the newest month."""
    fact = sales_fact(spark, sf_dir)
    months = fact.groupBy("snapshot_month").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("snapshot_month")).limit(1).select("snapshot_month")
    latest = fact.join(months, "snapshot_month", "left_semi")
    shape = lambda frame, kind, name: frame.select(F.lit(kind).alias("dimension"), F.col(name).alias("name"), "qty")
    products = dashboard.top_groups(latest, ["product_id", "product_name_snapshot"])
    channels = dashboard.top_groups(latest, ["channel_id_snapshot", "channel_name_snapshot"])
    return shape(products, "product", "product_name_snapshot").unionByName(shape(channels, "channel", "channel_name_snapshot"))


@query("cycle_listing", oracle("SELECT cycle_id, cycle_month, status FROM cyc ORDER BY cycle_id DESC LIMIT 20 OFFSET 20", _CYCLES[0]))
def cycle_listing(spark, sf_dir):
    """The second page of the cycles, newest first."""
    return dashboard.page(cycles(spark, sf_dir).select("cycle_id", "cycle_month", "status"), [F.col("cycle_id").desc()], 2, 20)


@query(
    "source_options",
    oracle("SELECT dataset_version_id, dataset_type, m AS period_start FROM vers ORDER BY dataset_version_id DESC LIMIT 100", _CYCLES[0], _CYCLES[2]),
)
def source_options(spark, sf_dir):
    """The newest versions a cycle may choose."""
    return dashboard.page(versions(spark, sf_dir).select("dataset_version_id", "dataset_type", "period_start"), [F.col("dataset_version_id").desc()], 1, 100)


@query(
    "lock_overlaps",
    oracle(
        "SELECT cycle_id, dataset_type, period_start AS month, count(*) AS bindings FROM (SELECT * FROM bind UNION ALL SELECT * FROM bind WHERE cycle_id % 2 = 0) JOIN vers USING (dataset_version_id) GROUP BY ALL HAVING count(DISTINCT dataset_version_id) > 1",
        *_CYCLES[:3],
    ),
)
def lock_overlaps(spark, sf_dir):
    """A lock accepts the same version twice for a month, not two versions."""
    facts = stored_facts(spark, sf_dir)
    bound = bindings(spark, sf_dir, facts)
    return cycle.overlapping_months(bound.unionByName(bound.filter(F.col("cycle_id") % 2 == 0)), versions(spark, sf_dir, facts), same_version_allowed=True)


# --- maintenance -----------------------------------------------------------


def customer_changes(spark, sf_dir):
    """A change per customer: every fourth is a create; codes in use, repeated codes, blank names, unknown and inactive reps, own parents."""
    k, key = F.col("c_custkey"), F.col("c_custkey").cast("string")
    masters_ = data.customer(spark, sf_dir).select((F.col("customer_id") - 1).alias("c_custkey"), "customer_stable_id")
    reps = data.salesrep(spark, sf_dir).select((F.col("salesrep_id") - 1).cast("int").alias("c_nationkey"), "salesrep_stable_id")
    rows = data.table(spark, sf_dir, "customer").join(masters_, "c_custkey", "left").join(reps, "c_nationkey", "left")
    create = k % 4 == 0
    own = F.when(create, F.concat(F.lit("NEW_"), key)).otherwise(F.col("customer_stable_id"))
    return rows.select(
        k.alias("change_id"),
        own.alias("customer_stable_id"),
        F.when(k % 13 == 1, F.concat(F.lit("c"), (k + 1).cast("string"))).when(k % 13 == 2, F.concat(F.lit("twice"), F.floor(k / 26).cast("string"))).when(create, F.concat(F.lit("N"), key)).alias("customer_code"),
        F.when(k % 17 == 1, "  ").otherwise(F.concat(F.lit(" Name "), key)).alias("customer_name"),
        F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit(" note "), key)).alias("organization"),
        F.when(k % 19 == 1, "REP_X").otherwise(F.col("salesrep_stable_id")).alias("salesrep_stable_id"),
        F.when(k % 23 == 1, own).alias("parent_customer_stable_id"),
    )


_CHANGES = """chg AS (SELECT c_custkey AS k, c_nationkey, CASE WHEN c_custkey % 13 = 1 THEN 'c' || (c_custkey + 1) WHEN c_custkey % 13 = 2 THEN 'twice' || (c_custkey // 26) WHEN c_custkey % 4 = 0 THEN 'N' || c_custkey END AS code FROM customer),
chg_found AS (SELECT k AS change_id, 'CODE_IN_USE' AS code FROM chg WHERE EXISTS (SELECT 1 FROM m_customer m WHERE lower(m.customer_code) = lower(chg.code) AND (chg.k % 4 = 0 OR m.customer_id <> chg.k + 1))
  UNION ALL SELECT k, 'CODE_REPEATED_IN_REQUEST' FROM chg WHERE lower(code) IN (SELECT lower(code) FROM chg WHERE code IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT k, 'REQUIRED_CUSTOMER_NAME' FROM chg WHERE k % 17 = 1
  UNION ALL SELECT k, CASE WHEN k % 19 = 1 THEN 'REFERENCE_NOT_FOUND' ELSE 'INACTIVE_REFERENCE' END FROM chg WHERE k % 19 = 1 OR c_nationkey % 11 = 5
  UNION ALL SELECT k, 'SELF_PARENT' FROM chg WHERE k % 23 = 1)"""


def _change_findings(spark, sf_dir, changes):
    known = data.customer(spark, sf_dir)
    parts = [
        masters.save_findings(changes, known, "customer_stable_id", "customer_code"),
        masters.required_text_findings(changes, ["customer_name"]),
        masters.reference_findings(changes, "salesrep_stable_id", data.salesrep(spark, sf_dir), "salesrep_stable_id", "salesrep_status"),
        masters.self_parents(changes),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("master_change_findings", oracle("SELECT * FROM chg_found", _CHANGES))
def master_change_findings(spark, sf_dir):
    return _change_findings(spark, sf_dir, customer_changes(spark, sf_dir))


@query(
    "master_changes",
    oracle(
        """SELECT customer_code, trim(customer_name) AS customer_name, organization FROM (
  SELECT coalesce(g.code, m.customer_code) AS customer_code, coalesce(CASE WHEN g.k IS NOT NULL THEN ' Name ' || g.k END, m.customer_name) AS customer_name, CASE WHEN g.k IS NOT NULL AND g.k % 3 <> 0 THEN 'note ' || g.k ELSE 'old' END AS organization
  FROM m_customer m LEFT JOIN (SELECT * FROM chg WHERE k NOT IN (SELECT change_id FROM chg_found) AND k % 4 <> 0) g ON g.k + 1 = m.customer_id
  UNION ALL SELECT code, ' Name ' || k, CASE WHEN k % 3 <> 0 THEN 'note ' || k END FROM chg WHERE k NOT IN (SELECT change_id FROM chg_found) AND k % 4 = 0)""",
        _CHANGES,
    ),
)
def master_changes(spark, sf_dir):
    """Creates and updates together; blank optional texts are NULL and leave the stored value."""
    changes = masters.optional_text(customer_changes(spark, sf_dir), ["organization"])
    known = data.customer(spark, sf_dir).select("customer_stable_id", "customer_code", "customer_name", F.lit("old").alias("organization"))
    after = masters.apply_changes(known, changes, _change_findings(spark, sf_dir, changes), "customer_stable_id")
    return after.select("customer_code", F.trim("customer_name").alias("customer_name"), "organization")
