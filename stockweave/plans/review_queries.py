"""Review of staged batches: gates, acknowledgements, decisions, confirmation.

Every customer is a batch and its orders are the rows; each kind of finding is
on a thirteenth of them. Decisions miss a share of what they have to cover.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.operators import review
from stockweave.operators.findings import finding, with_findings
from stockweave.plans import standins as data
from stockweave.plans.registry import query
from stockweave.plans.standins import oracle
from stockweave.sources.staging import stage

CHANNEL, PARENT, CODE, SALES, NAME, MERGE = (
    "MDM_IMPORT_CHANNEL_UNRESOLVED",
    "MDM_IMPORT_PARENT_UNRESOLVED",
    "MDM_IMPORT_DUPLICATE_CUSTOMER_CODE",
    "MDM_IMPORT_NON_SALES_EXCLUDED",
    "MDM_IMPORT_CUSTOMER_NAME_CONFLICT",
    "MDM_IMPORT_PRODUCT_MERGE_RESOLVED",
)


def staged_rows(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = data.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("B"), F.col("o_custkey").cast("string")).alias("batch_id"),
        k.alias("row_number"),
        F.col("o_custkey").alias("b"),
        F.concat(F.lit("S"), k.cast("string")).alias("sku_code"),
        F.concat(F.lit("Name "), k.cast("string")).alias("sku_name"),
        F.concat(F.lit("P"), (k % 3).cast("string")).alias("source_product_code"),
    )
    turn, key = F.col("row_number") % 13, F.col("row_number").cast("string")
    third = F.concat(F.lit("C"), (F.col("row_number") % 3).cast("string"))
    rules = [
        finding(turn == 1, CHANNEL),
        finding(turn == 2, PARENT, severity="WARNING"),
        finding(turn == 3, CODE, severity="WARNING", candidate_key=third),
        finding(turn == 4, SALES, severity="INFO"),
        finding(turn == 5, NAME, severity="WARNING"),
        finding(turn == 6, MERGE, severity="INFO", candidate_key=F.col("source_product_code")),
        finding(turn == 7, NAME, severity="WARNING", candidate_key=key),
        finding(turn == 7, CHANNEL),
    ]
    status = F.when(turn.isin(1, 7), "ERROR").when(turn.isin(2, 3, 5), "WARNING").otherwise("VALID")
    return with_findings(rows.withColumn("status", status), rules)


_ROWS = f"""rows_ AS (SELECT 'B' || o_custkey AS batch_id, o_custkey AS b, o_orderkey AS k, o_orderkey % 13 AS t, o_orderkey % 3 AS m FROM orders),
gate AS (SELECT batch_id, b, k, CASE t WHEN 2 THEN 'ROW:' || k WHEN 3 THEN 'CUSTOMER_CODE:C' || m WHEN 4 THEN 'NON_SALES:INTERCOMPANY' ELSE 'PRODUCT_GROUP:P' || m END AS subject_key,
  CASE t WHEN 2 THEN '{PARENT}' WHEN 3 THEN '{CODE}' WHEN 4 THEN '{SALES}' ELSE '{MERGE}' END AS issue_code FROM rows_ WHERE t IN (2, 3, 4, 6)),
ack AS (SELECT batch_id, b, k FROM rows_ WHERE t IN (5, 7))"""


@query("resolution_gates", oracle("SELECT batch_id, subject_key, issue_code, k AS row_number FROM gate", _ROWS))
def resolution_gates(spark, sf_dir):
    return review.resolution_gates(staged_rows(spark, sf_dir))


@query(
    "historical_gates",
    oracle(
        f"""SELECT 'B' || c_custkey AS batch_id, 'HISTORICAL_CHANNEL:CHN-HISTORY-' || lpad((r_regionkey + 1)::VARCHAR, 3, '0') AS subject_key, r_name AS channel_name, 'MDM_IMPORT_HISTORICAL_CHANNEL' AS issue_code
FROM customer, region WHERE c_custkey % 4 = 1"""
    ),
)
def historical_gates(spark, sf_dir):
    """The governance list is the regions', a fixed handful."""
    batches = _batches(spark, sf_dir)
    listed = data.table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).alias("number"), F.col("r_name").alias("channel_name"))
    return review.historical_gates(batches, listed)


@query("warning_gates", oracle(f"SELECT batch_id, '{NAME}' AS issue_code, k AS row_number FROM ack", _ROWS))
def warning_gates(spark, sf_dir):
    return review.warning_gates(staged_rows(spark, sf_dir))


def decided(spark, sf_dir, rows):
    """Half of the parents and codes are resolved, exclusions of even batches, merges by a decision that is not allowed;
    names are acknowledged for all rows in every third batch and for all but the last elsewhere."""
    gates = review.resolution_gates(rows).join(rows.select("batch_id", "b").distinct(), "batch_id")
    even = F.col("row_number") % 2 == 0
    decision = F.when(F.col("issue_code") == PARENT, "SET_NULL").when(F.col("issue_code") == CODE, "KEEP_SEPARATE").when(F.col("issue_code") == SALES, "EXCLUDE_NON_SALES_INTERCOMPANY").otherwise("REJECT_GROUP")
    kind = F.when(F.col("issue_code").isin(SALES, MERGE), review.GOVERNANCE).otherwise(review.RESOLUTION)
    wanted = ((F.col("issue_code").isin(PARENT, CODE)) & even) | ((F.col("issue_code") == SALES) & (F.col("b") % 2 == 0)) | (F.col("issue_code") == MERGE)
    none = lambda type_, name: F.lit(None).cast(type_).alias(name)
    shape = lambda frame, subject, issue, kind_, what: frame.select("batch_id", F.lit(1).alias("review_version"), none("bigint", "finding_id"), none("bigint", "row_number"), subject.alias("subject_key"), issue.alias("issue_code"), kind_.alias("decision_type"), what.alias("decision"), F.lit("ok").alias("reason"), none("map<string,string>", "resolved"))
    subjects = gates.filter(wanted).select("batch_id", "subject_key", "issue_code").distinct()
    taken = shape(subjects, F.col("subject_key"), F.col("issue_code"), kind, decision)
    names = review.warning_gates(rows).join(rows.select("batch_id", "b").distinct(), "batch_id")
    acks = shape(names.select("batch_id").distinct(), F.lit(f"ISSUE:{NAME}"), F.lit(NAME), F.lit(review.WARNING_ACK), F.lit("ACKNOWLEDGE"))
    last = names.groupBy("batch_id").agg(F.max("row_number").alias("_last"))
    covered = names.join(last, "batch_id").filter((F.col("b") % 3 == 0) | (F.col("row_number") < F.col("_last"))).select("batch_id", "issue_code", "row_number")
    return taken.unionByName(acks), covered


_REPORT = f"""report AS (SELECT batch_id, 'ERROR' AS kind, NULL AS subject_key, '{CHANNEL}' AS issue_code, count(*) AS row_count FROM rows_ WHERE t IN (1, 7) GROUP BY 1
  UNION ALL SELECT batch_id, 'RESOLUTION', subject_key, issue_code, count(*) FROM gate GROUP BY batch_id, b, subject_key, issue_code
    HAVING NOT ((issue_code IN ('{PARENT}', '{CODE}') AND bool_or(k % 2 = 0)) OR (issue_code = '{SALES}' AND b % 2 = 0))
  UNION ALL SELECT batch_id, 'ACKNOWLEDGEMENT', 'ISSUE:{NAME}', '{NAME}', count(*) FROM ack WHERE b % 3 <> 0 GROUP BY 1)"""


@query("gate_report", oracle("SELECT * FROM report", _ROWS, _REPORT))
def gate_report(spark, sf_dir):
    rows = stage(staged_rows(spark, sf_dir))
    return review.gate_report(rows, *decided(spark, sf_dir, rows))


@query(
    "ready_batches",
    oracle("SELECT 'B' || c_custkey AS batch_id, ('B' || c_custkey) NOT IN (SELECT batch_id FROM report) AS ready_to_confirm FROM customer", _ROWS, _REPORT),
)
def ready_batches(spark, sf_dir):
    rows = stage(staged_rows(spark, sf_dir))
    report = review.gate_report(rows, *decided(spark, sf_dir, rows))
    return review.ready_to_confirm(_batches(spark, sf_dir), report).select("batch_id", "ready_to_confirm")


# --- acknowledgements ------------------------------------------------------


def _batches(spark, sf_dir):
    c = F.col("c_custkey")
    return data.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("B"), c.cast("string")).alias("batch_id"),
        F.element_at(F.array(*[F.lit(x) for x in ("CUSTOMER", "CHANNEL", "SALESREP", "CUSTOMER")]), (c % 4 + 1).cast("int")).alias("entity_type"),
        F.concat(F.lit("S"), F.col("c_nationkey").cast("string")).alias("source_system"),
        F.element_at(F.array(*[F.lit(x) for x in ("READY_FOR_REVIEW", "COMMITTED", "RESOLVING", "CONFIRMED", "READY_TO_CONFIRM")]), (c % 5 + 1).cast("int")).alias("status"),
        (1 + c % 2).cast("int").alias("review_version"),
        F.when(c % 6 == 5, 3).otherwise(0).cast("bigint").alias("error_rows"),
        c.alias("c"),
    )


_B = """batch AS (SELECT c_custkey AS c, 'B' || c_custkey AS batch_id, ['CUSTOMER', 'CHANNEL', 'SALESREP', 'CUSTOMER'][c_custkey % 4 + 1] AS entity_type, 'S' || c_nationkey AS source_system,
  ['READY_FOR_REVIEW', 'COMMITTED', 'RESOLVING', 'CONFIRMED', 'READY_TO_CONFIRM'][c_custkey % 5 + 1] AS status, 1 + c_custkey % 2 AS review_version, CASE WHEN c_custkey % 6 = 5 THEN 3 ELSE 0 END AS error_rows FROM customer)"""


@query(
    "acknowledgement_findings",
    oracle(
        """SELECT DISTINCT batch_id, finding_id, code FROM (SELECT 'B' || o_custkey AS batch_id, o_orderkey AS finding_id, CASE WHEN status IS NULL THEN 'BATCH_NOT_FOUND' WHEN status <> 'READY_FOR_REVIEW' THEN 'STATE_CONFLICT'
  WHEN o_orderkey % 11 = 1 THEN 'STALE_REVIEW_VERSION' WHEN error_rows > 0 THEN 'ERROR_ROWS_PRESENT' WHEN o_orderkey % 11 = 2 THEN 'FINDING_REPEATED' WHEN o_orderkey % 3 = 0 THEN 'WARNING_NOT_FOUND'
  WHEN o_orderkey % 5 = 0 THEN 'WARNING_ALREADY_ACKNOWLEDGED' END AS code FROM orders LEFT JOIN batch ON c = o_custkey) WHERE code IS NOT NULL""",
        _B,
    ),
)
def acknowledgement_findings(spark, sf_dir):
    """A request per order: warnings are two thirds of the findings, a fifth is acknowledged already."""
    batches = _batches(spark, sf_dir)
    k = F.col("o_orderkey")
    orders = data.table(spark, sf_dir, "orders").select(F.concat(F.lit("B"), F.col("o_custkey").cast("string")).alias("batch_id"), "o_orderkey")
    versions = batches.select("batch_id", F.col("review_version").alias("now"))
    named = orders.join(versions, "batch_id", "left")
    found = named.select("batch_id", F.col("now").alias("review_version"), k.alias("finding_id"), F.lit(None).cast("bigint").alias("origin_id"), k.alias("row_number"), F.lit(NAME).alias("code"), F.when(k % 3 == 0, "ERROR").otherwise("WARNING").alias("severity"))
    done = named.filter(k % 5 == 0).select("batch_id", F.col("now").alias("review_version"), k.alias("finding_id"), F.lit(review.WARNING_ACK).alias("decision_type"))
    asked = named.select("batch_id", F.when(k % 11 == 1, 7).otherwise(F.coalesce("now", F.lit(1))).alias("review_version"), k.alias("finding_id"))
    asked = asked.unionByName(asked.filter(F.col("finding_id") % 11 == 2))
    return review.acknowledgement_findings(asked, batches, found, done, needs_no_errors=True)


# --- decisions -------------------------------------------------------------


@query(
    "decision_findings",
    oracle(
        f"""SELECT batch_id, subject_key, issue_code, decision, code FROM (
  SELECT batch_id, 'ROW:' || k AS subject_key, '{PARENT}' AS issue_code, CASE WHEN k % 5 = 1 THEN 'EXCLUDE' WHEN k % 5 = 2 THEN 'MAP_PARENT' ELSE 'SET_NULL' END AS decision,
    CASE WHEN k % 7 = 1 THEN 'DECISION_REASON_REQUIRED' WHEN k % 5 = 1 THEN 'INVALID_DECISION' WHEN k % 5 = 2 AND k % 2 = 0 THEN 'MAPPING_WITHOUT_TARGET' END AS code FROM rows_ WHERE t = 2
  UNION ALL SELECT batch_id, subject_key, issue_code, 'KEEP_SEPARATE', CASE WHEN b % 3 <> 0 THEN 'DECISION_SCOPE_MISMATCH' END FROM gate WHERE issue_code = '{CODE}' GROUP BY batch_id, b, subject_key, issue_code
  UNION ALL SELECT batch_id, 'CHANNEL:' || k, '{CHANNEL}', 'MAP_EXISTING', CASE WHEN k % 2 = 0 THEN 'DECISION_SUBJECT_NOT_FOUND' END FROM rows_ WHERE t = 1
  UNION ALL SELECT batch_id, 'PRODUCT_GROUP:P' || m, '{MERGE}', 'MERGE_AS_ONE_PRODUCT', CASE WHEN max(k) % 2 = 0 THEN 'PRODUCT_REPRESENTATIVE_REQUIRED' END FROM rows_ WHERE t = 6 GROUP BY batch_id, m)""",
        _ROWS,
    ),
)
def decision_findings(spark, sf_dir):
    """Decisions of each kind; a scope that lacks its last row, a representative under another name, a row that is not there."""
    rows = stage(staged_rows(spark, sf_dir))
    k, key = F.col("row_number"), F.col("row_number").cast("string")
    none = lambda name: F.lit(None).cast("string").alias(name)
    turn = k % 13

    def shape(frame, subject, issue, decision, reason=F.lit("ok"), row=None, stable=None, sku=None, name=None, shown=None):
        text = lambda value, alias: none(alias) if value is None else value.alias(alias)
        row = F.lit(None).cast("bigint") if row is None else row.cast("bigint")
        return frame.select("batch_id", subject.alias("subject_key"), F.lit(issue).alias("issue_code"), decision.alias("decision"), reason.alias("reason"), row.alias("row_number"), text(stable, "stable_id"), text(sku, "representative_sku_code"), text(name, "representative_sku_name"), text(shown, "product_name"))

    parent = F.when(k % 5 == 1, "EXCLUDE").when(k % 5 == 2, "MAP_PARENT").otherwise("SET_NULL")
    parents = shape(rows.filter(turn == 2), F.concat(F.lit("ROW:"), key), PARENT, parent, F.when(k % 7 == 1, "  ").otherwise("ok"), k, F.when(k % 2 == 1, "CUS_X"))
    codes = rows.filter(turn == 3).groupBy("batch_id", "b", (k % 3).alias("m")).agg(F.max("row_number").alias("row_number"))
    separate = shape(codes, F.concat(F.lit("CUSTOMER_CODE:C"), F.col("m").cast("string")), CODE, F.lit("KEEP_SEPARATE"))
    channels = shape(rows.filter(turn == 1), F.concat(F.lit("CHANNEL:"), key), CHANNEL, F.lit("MAP_EXISTING"), row=F.when(k % 2 == 0, -1).otherwise(k), stable=F.lit("CHN_X"))
    groups = rows.filter(turn == 6).groupBy("batch_id", "source_product_code").agg(F.max("row_number").alias("row_number"))
    name = F.concat(F.lit("Name "), key)
    merges = shape(groups, F.concat(F.lit("PRODUCT_GROUP:"), "source_product_code"), MERGE, F.lit("MERGE_AS_ONE_PRODUCT"), sku=F.concat(F.lit("S"), key), name=name, shown=F.when(k % 2 == 0, "Other").otherwise(name))
    gates = review.resolution_gates(rows)
    last = codes.select("batch_id", F.concat(F.lit("CUSTOMER_CODE:C"), F.col("m").cast("string")).alias("subject_key"), "b", F.col("row_number").alias("_last"))
    scope = gates.join(last, ["batch_id", "subject_key"], "left").filter(F.col("_last").isNull() | (F.col("b") % 3 == 0) | (F.col("row_number") < F.col("_last"))).select("batch_id", "subject_key", "issue_code", "row_number")
    asked = parents.unionByName(separate).unionByName(channels).unionByName(merges)
    return review.decision_findings(asked, scope, rows).select("batch_id", "subject_key", "issue_code", "decision", "code")


@query(
    "carried_decisions",
    oracle(
        f"""SELECT 'B' || o_custkey AS batch_id, 2 AS review_version, 'ROW:' || o_orderkey AS subject_key, CASE WHEN o_orderkey % 3 = 0 THEN 'MAP_PARENT' ELSE 'SET_NULL' END AS decision FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0"""
    ),
)
def carried_decisions(spark, sf_dir):
    """Even orders are decided; every third is decided anew, whether it was before or not."""
    k = F.col("o_orderkey")
    rows = data.table(spark, sf_dir, "orders").select(F.concat(F.lit("B"), F.col("o_custkey").cast("string")).alias("batch_id"), "o_orderkey")

    def made(frame, version, decision):
        values = {"review_version": F.lit(version), "finding_id": F.lit(None).cast("bigint"), "row_number": k, "subject_key": F.concat(F.lit("ROW:"), k.cast("string")), "issue_code": F.lit(PARENT), "decision_type": F.lit(review.RESOLUTION), "decision": F.lit(decision), "reason": F.lit("ok"), "resolved": F.lit(None).cast("map<string,string>")}
        return frame.select("batch_id", *[v.alias(n) for n, v in values.items()])

    carried = review.carry_decisions(made(rows.filter(k % 2 == 0), 1, "SET_NULL"), made(rows.filter(k % 3 == 0), 2, "MAP_PARENT"))
    return carried.select("batch_id", "review_version", "subject_key", "decision")


@query(
    "resolved_errors",
    oracle(
        """SELECT batch_id, k AS row_number, CASE WHEN t IN (1, 7) AND k % 2 = 0 THEN CASE t WHEN 7 THEN 'WARNING' ELSE 'VALID' END WHEN t IN (1, 7) THEN 'ERROR' WHEN t IN (2, 3, 5) THEN 'WARNING' ELSE 'VALID' END AS status,
  CASE WHEN t IN (1, 7) AND k % 2 = 0 THEN 1 ELSE 0 END AS resolved FROM rows_""",
        _ROWS,
    ),
)
def resolved_errors(spark, sf_dir):
    rows = staged_rows(spark, sf_dir)
    decisions = rows.filter(F.col("row_number") % 2 == 0).select("batch_id", "row_number", F.lit(CHANNEL).alias("issue_code"), F.lit(review.RESOLUTION).alias("decision_type"))
    decisions = decisions.unionByName(rows.filter(F.col("row_number") % 2 == 1).select("batch_id", "row_number", F.lit(CHANNEL).alias("issue_code"), F.lit(review.WARNING_ACK).alias("decision_type")))
    solved = F.size(F.filter("findings", lambda f: f["resolved"])).alias("resolved")
    return review.resolve_errors(rows, decisions).select("batch_id", "row_number", "status", solved)


# --- confirmation ----------------------------------------------------------

_LACKING = """lacking AS (SELECT batch_id, source_system, need AS missing_entity_type FROM batch, (VALUES ('CHANNEL'), ('SALESREP')) n(need) WHERE entity_type = 'CUSTOMER'
  AND (source_system, need) NOT IN (SELECT (source_system, entity_type) FROM batch WHERE status = 'COMMITTED'))"""


@query("missing_dependencies", oracle("SELECT * FROM lacking", _B, _LACKING))
def missing_dependencies(spark, sf_dir):
    return review.missing_dependencies(_batches(spark, sf_dir))


@query(
    "confirmations",
    oracle(
        """SELECT batch_id, outcome, CASE WHEN outcome IN ('CONFIRMED', 'CANCELLED') THEN outcome ELSE status END AS status FROM (SELECT *, CASE WHEN c % 3 = 2 THEN 'UNTOUCHED'
  WHEN status = 'COMMITTED' OR (c % 3 = 0 AND status = 'CONFIRMED') THEN 'STATE_CONFLICT' WHEN c % 3 = 1 THEN 'CANCELLED' WHEN c % 7 = 0 THEN 'STALE_REVIEW_VERSION'
  WHEN c % 4 = 2 OR error_rows > 0 THEN 'REVIEW_INCOMPLETE' WHEN batch_id IN (SELECT batch_id FROM lacking) THEN 'DEPENDENCY_MISSING' ELSE 'CONFIRMED' END AS outcome FROM batch)""",
        _B,
        _LACKING,
    ),
)
def confirmations(spark, sf_dir):
    """A third asks to be confirmed, a third to be cancelled; a seventh names another version."""
    batches = _batches(spark, sf_dir)
    c = F.col("c")
    requests = batches.filter(c % 3 != 2).select("batch_id", F.when(c % 3 == 0, "CONFIRM").otherwise("CANCEL").alias("action"), (F.col("review_version") + F.when(c % 7 == 0, 1).otherwise(0)).alias("review_version"))
    report = batches.filter(c % 4 == 2).select("batch_id")
    return review.confirm_or_cancel(batches, requests, report).select("batch_id", "outcome", "status")


@query(
    "review_payload",
    oracle(
        f"""SELECT batch_id, k AS row_number, CASE t WHEN 1 THEN '{CHANNEL}' WHEN 2 THEN '{PARENT}' WHEN 3 THEN '{CODE}' WHEN 4 THEN '{SALES}' WHEN 5 THEN '{NAME}' WHEN 6 THEN '{MERGE}' WHEN 7 THEN '{CHANNEL},{NAME}' ELSE '' END AS codes,
  CASE WHEN k % 2 = 0 THEN 'KEEP,SET_NULL' ELSE '' END AS decisions FROM rows_""",
        _ROWS,
    ),
)
def review_payload(spark, sf_dir):
    rows = staged_rows(spark, sf_dir)
    even = rows.filter(F.col("row_number") % 2 == 0).select("batch_id", "row_number")
    decisions = even.select("*", F.explode(F.array(F.struct(F.lit("Z").alias("issue_code"), F.lit("SET_NULL").alias("decision")), F.struct(F.lit("A").alias("issue_code"), F.lit("KEEP").alias("decision")))).alias("d"))
    decisions = decisions.select("batch_id", "row_number", "d.*", F.lit(review.RESOLUTION).alias("decision_type"), F.lit("ok").alias("reason"))
    shown = review.review_payload(rows, decisions)
    names = lambda column, field: F.array_join(F.transform(column, lambda x: x[field]), ",")
    return shown.select("batch_id", "row_number", names("findings", "code").alias("codes"), names("decisions", "decision").alias("decisions"))
