"""Review of staged master batches: acknowledgements, gates, decisions.

Tables (all keyed by batch_id and review_version where they are versioned):

rows       batch_id, row_number, status, commit_result, final_values (map), findings
findings   batch_id, review_version, finding_id, origin_id, row_number, code, severity
decisions  batch_id, review_version, finding_id, row_number, subject_key,
           issue_code, decision_type, decision, reason, resolved (map)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.functions.text import blank_to_null
from stockweave.operators.findings import finding_rows

WARNING_ACK, RESOLUTION, GOVERNANCE = "WARNING_ACK", "RESOLUTION", "GOVERNANCE_CONFIRMATION"

# Decisions allowed per issue, and how an issue is decided.
ALLOWED_DECISIONS = {
    "MDM_IMPORT_PARENT_UNRESOLVED": ("SET_NULL", "MAP_PARENT"),
    "MDM_IMPORT_DUPLICATE_CUSTOMER_CODE": ("KEEP_SEPARATE",),
    "MDM_IMPORT_PRODUCT_MERGE_RESOLVED": ("MERGE_AS_ONE_PRODUCT",),
    "MDM_IMPORT_PRODUCT_MERGE_CONFLICT": ("MERGE_AS_ONE_PRODUCT", "KEEP_SEPARATE", "REJECT_GROUP"),
    "MDM_IMPORT_HISTORICAL_CHANNEL": ("CREATE_INACTIVE_HISTORICAL",),
    "MDM_IMPORT_NON_SALES_EXCLUDED": ("EXCLUDE_NON_SALES_INTERCOMPANY",),
    "MDM_IMPORT_CHANNEL_UNRESOLVED": ("MAP_EXISTING", "CREATE_BOOTSTRAP_ENTITY", "EXCLUDE"),
    "MDM_IMPORT_CHANNEL_CONFLICT": ("MAP_EXISTING", "CREATE_BOOTSTRAP_ENTITY"),
    "MDM_IMPORT_SALESREP_UNRESOLVED": ("MAP_EXISTING", "CREATE_BOOTSTRAP_ENTITY"),
    "MDM_IMPORT_REGION_UNRESOLVED": ("MAP_EXISTING", "CREATE_BOOTSTRAP_ENTITY"),
    "MDM_IMPORT_PROVINCE_UNRESOLVED": ("MAP_EXISTING", "CREATE_BOOTSTRAP_ENTITY"),
}
RESOLUTION_WARNINGS = ("MDM_IMPORT_DUPLICATE_CUSTOMER_CODE", "MDM_IMPORT_PARENT_UNRESOLVED")
GOVERNANCE_CODES = (
    "MDM_IMPORT_HISTORICAL_CHANNEL",
    "MDM_IMPORT_NON_SALES_EXCLUDED",
    "MDM_IMPORT_PRODUCT_MERGE_RESOLVED",
    "MDM_IMPORT_PRODUCT_MERGE_CONFLICT",
)
REVIEW_STATES = ("READY_FOR_REVIEW", "RESOLVING", "READY_TO_CONFIRM")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def current(table: DataFrame, batches: DataFrame) -> DataFrame:
    """Entries of each batch's current review version."""
    return table.join(batches.select("batch_id", "review_version"), ["batch_id", "review_version"], "left_semi")


def acknowledgement_findings(requests: DataFrame, batches: DataFrame, findings: DataFrame, decisions: DataFrame, needs_no_errors: bool) -> DataFrame:
    """Why an acknowledgement is refused: (batch_id, finding_id, code).

    ``requests``: batch_id, review_version, finding_id. Only current warnings
    that are still open may be acknowledged; product, SKU and goods batches
    also need a batch without error rows.
    """
    state = batches.select("batch_id", F.col("review_version").alias("_now"), "status", "error_rows")
    live = current(findings, batches).filter(F.col("severity") == "WARNING").select("batch_id", "finding_id", F.lit(True).alias("_live"))
    done = current(decisions, batches).filter(F.col("decision_type") == WARNING_ACK).select("batch_id", "finding_id").distinct().withColumn("_done", F.lit(True))
    twice = requests.groupBy("batch_id", "finding_id").agg(F.count(F.lit(1)).alias("_copies"))
    joined = (
        requests.join(state, "batch_id", "left")
        .join(live, ["batch_id", "finding_id"], "left")
        .join(done, ["batch_id", "finding_id"], "left")
        .join(twice, ["batch_id", "finding_id"], "left")
    )
    code = (
        F.when(F.col("status").isNull(), "BATCH_NOT_FOUND")
        .when(~F.col("status").isin("READY_FOR_REVIEW", "REVIEW", "READY_TO_COMMIT"), "STATE_CONFLICT")
        .when(F.col("review_version") != F.col("_now"), "STALE_REVIEW_VERSION")
        .when(F.lit(needs_no_errors) & (F.col("error_rows") > 0), "ERROR_ROWS_PRESENT")
        .when(F.col("_copies") > 1, "FINDING_REPEATED")
        .when(F.col("_live").isNull(), "WARNING_NOT_FOUND")
        .when(F.col("_done").isNotNull(), "WARNING_ALREADY_ACKNOWLEDGED")
    )
    return joined.withColumn("code", code).filter("code is not null").select("batch_id", "finding_id", "code").distinct()


def roll_version(batches: DataFrame, findings: DataFrame, decisions: DataFrame, acknowledged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Batches, findings and decisions after one more review version.

    Findings and decisions of the current version are copied to the next one,
    earlier versions stay; the acknowledgements are appended as decisions.
    ``acknowledged``: batch_id, finding_id, reason (accepted requests only).
    """
    ids = acknowledged.select("batch_id").distinct()
    up = F.col("review_version") + 1
    moving = batches.join(ids, "batch_id", "left_semi")
    copied_findings = current(findings, moving).withColumn("review_version", up)
    copied_decisions = current(decisions, moving).withColumn("review_version", up)
    fresh = (
        current(findings, moving)
        .join(acknowledged.select("batch_id", "finding_id", "reason"), ["batch_id", "finding_id"])
        .select(
            "batch_id",
            up.alias("review_version"),
            "finding_id",
            "row_number",
            F.concat(F.lit("FINDING:"), F.coalesce("origin_id", "finding_id").cast("string")).alias("subject_key"),
            F.col("code").alias("issue_code"),
            F.lit(WARNING_ACK).alias("decision_type"),
            F.lit("ACKNOWLEDGE").alias("decision"),
            blank_to_null("reason").alias("reason"),
            F.create_map(F.lit("acknowledged"), F.lit("true")).alias("resolved"),
        )
    )
    rolled = batches.join(ids.withColumn("_up", F.lit(1)), "batch_id", "left").withColumn(
        "review_version", F.col("review_version") + F.coalesce("_up", F.lit(0))
    )
    return (
        rolled.select(*batches.columns),
        findings.unionByName(copied_findings),
        decisions.unionByName(copied_decisions).unionByName(fresh),
    )


def open_warnings(batches: DataFrame, findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Warnings of the current version without an acknowledgement."""
    acknowledged = current(decisions, batches).filter(F.col("decision_type") == WARNING_ACK).select("batch_id", "finding_id")
    return current(findings, batches).filter(F.col("severity") == "WARNING").join(acknowledged, ["batch_id", "finding_id"], "left_anti")


def row_readiness(rows: DataFrame, batches: DataFrame, findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Row status EXISTING, ERROR, WARNING or READY, and its reviewed values.

    Only READY rows have reviewed values; an acknowledged unresolved parent
    becomes NULL there.
    """
    key = ["batch_id", "row_number"]
    live = current(findings, batches)
    marks = live.groupBy(*key).agg(
        F.max(F.col("severity") == "ERROR").alias("_error"), F.max(F.col("code") == "MDM_IMPORT_PARENT_UNRESOLVED").alias("_parent")
    )
    waiting = open_warnings(batches, findings, decisions).select(*key).distinct().withColumn("_open", F.lit(True))
    joined = rows.join(marks, key, "left").join(waiting, key, "left")
    status = (
        F.when(F.col("commit_result").eqNullSafe(F.lit("EXISTING")), "EXISTING")
        .when(F.coalesce("_error", F.lit(False)), "ERROR")
        .when(F.coalesce("_open", F.lit(False)), "WARNING")
        .otherwise("READY")
    )
    cleared = F.map_concat(
        F.map_filter("final_values", lambda k, v: ~k.isin("parent_customer_stable_id", "parent_resolution")),
        F.create_map(F.lit("parent_customer_stable_id"), F.lit(None).cast("string"), F.lit("parent_resolution"), F.lit("ACKNOWLEDGED_NULL")),
    )
    reviewed = F.when(F.coalesce("_parent", F.lit(False)), cleared).otherwise(F.col("final_values"))
    return joined.withColumn("status", status).withColumn("reviewed_values", F.when(F.col("status") == "READY", reviewed)).drop("_error", "_parent", "_open")


def batch_readiness(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("status") == "ERROR").alias("error_rows"),
        F.count_if(F.col("status") == "WARNING").alias("warning_rows"),
    )
    waiting = (F.col("error_rows") > 0) | (F.col("warning_rows") > 0)
    return counts.withColumn("valid_rows", F.col("total_rows") - F.col("error_rows")).withColumn(
        "status", F.when(waiting, "REVIEW").otherwise("READY_TO_COMMIT")
    )


# --- bootstrap gates -------------------------------------------------------


def resolution_gates(rows: DataFrame) -> DataFrame:
    """Required decisions: (batch_id, subject_key, issue_code, row_number).

    One row per gate and affected row, so a gate over many rows stays a
    relation. ``rows`` are evaluated rows with findings; customer codes,
    unresolved parents, exclusions and confirmed product merges have gates.
    """
    found = finding_rows(rows, "batch_id").select("batch_id", "code", F.col("row_number"), "candidate_key")
    subject = (
        F.when(F.col("code") == "MDM_IMPORT_DUPLICATE_CUSTOMER_CODE", F.concat(F.lit("CUSTOMER_CODE:"), "candidate_key"))
        .when(F.col("code") == "MDM_IMPORT_PARENT_UNRESOLVED", F.concat(F.lit("ROW:"), F.col("row_number").cast("string")))
        .when(F.col("code") == "MDM_IMPORT_NON_SALES_EXCLUDED", F.lit("NON_SALES:INTERCOMPANY"))
        .when(F.col("code") == "MDM_IMPORT_PRODUCT_MERGE_RESOLVED", F.concat(F.lit("PRODUCT_GROUP:"), "candidate_key"))
    )
    return found.withColumn("subject_key", subject).filter("subject_key is not null").select(
        "batch_id", "subject_key", F.col("code").alias("issue_code"), "row_number"
    )


def historical_gates(batches: DataFrame, historical: DataFrame) -> DataFrame:
    """Channel batches need a confirmation per historical channel.

    ``historical``: number, channel_name (a fixed governance list).
    """
    channels = batches.filter(F.col("entity_type") == "CHANNEL").select("batch_id")
    code = F.concat(F.lit("CHN-HISTORY-"), F.lpad(F.col("number").cast("string"), 3, "0"))
    rules = historical.select(F.concat(F.lit("HISTORICAL_CHANNEL:"), code).alias("subject_key"), "channel_name")
    return channels.join(F.broadcast(rules), F.lit(True)).withColumn("issue_code", F.lit("MDM_IMPORT_HISTORICAL_CHANNEL"))


def warning_gates(rows: DataFrame) -> DataFrame:
    """Warnings to acknowledge as a whole: (batch_id, issue_code, row_number)."""
    return (
        finding_rows(rows, "batch_id")
        .filter((F.col("severity") == "WARNING") & ~F.col("code").isin(*RESOLUTION_WARNINGS))
        .select("batch_id", F.col("code").alias("issue_code"), "row_number")
        .distinct()
    )


def same_row_sets(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ``left`` with ``same``: both sides list exactly the same rows.

    Sets are compared by size, sum and an order-free hash, so they may be large.
    """

    def digest(table: DataFrame, prefix: str) -> DataFrame:
        distinct = table.select(*keys, "row_number").distinct()
        return distinct.groupBy(*keys).agg(
            F.count(F.lit(1)).alias(f"{prefix}n"),
            F.sum(F.col("row_number").cast("decimal(38,0)")).alias(f"{prefix}s"),
            F.bit_xor(F.xxhash64("row_number")).alias(f"{prefix}h"),
        )

    joined = digest(left, "_l").join(digest(right, "_r"), keys, "left")
    same = (F.col("_ln") == F.col("_rn")) & (F.col("_ls") == F.col("_rs")) & (F.col("_lh") == F.col("_rh"))
    return joined.select(*keys, F.col("_ln").alias("row_count"), F.coalesce(same, F.lit(False)).alias("same"))


def gate_report(rows: DataFrame, decisions: DataFrame, acknowledged_rows: DataFrame) -> DataFrame:
    """Open gates per batch: kind, subject, issue, affected rows.

    ``decisions`` and ``acknowledged_rows`` (batch_id, issue_code, row_number)
    belong to the current version. A warning counts as acknowledged only when
    the acknowledged rows are exactly its rows.
    """
    errors = (
        finding_rows(rows, "batch_id")
        .filter((F.col("severity") == "ERROR") & ~F.col("resolved"))
        .groupBy("batch_id", F.col("code").alias("issue_code"))
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select("batch_id", F.lit("ERROR").alias("kind"), F.lit(None).cast("string").alias("subject_key"), "issue_code", "row_count")
    )
    gates = resolution_gates(rows).groupBy("batch_id", "subject_key", "issue_code").agg(F.count(F.lit(1)).alias("row_count"))
    wanted_type = F.when(F.col("issue_code").isin(*GOVERNANCE_CODES), GOVERNANCE).otherwise(RESOLUTION)
    taken = decisions.filter(decision_allowed()).filter(F.col("decision_type") == wanted_type).select("batch_id", "subject_key", "issue_code")
    resolutions = gates.join(taken, ["batch_id", "subject_key", "issue_code"], "left_anti").select(
        "batch_id", F.lit("RESOLUTION").alias("kind"), "subject_key", "issue_code", "row_count"
    )
    acks = decisions.filter(F.col("decision_type") == WARNING_ACK).select("batch_id", "issue_code").distinct()
    covered = acknowledged_rows.join(acks, ["batch_id", "issue_code"], "left_semi")
    waiting = (
        same_row_sets(warning_gates(rows), covered, ["batch_id", "issue_code"])
        .filter(~F.col("same"))
        .select("batch_id", F.lit("ACKNOWLEDGEMENT").alias("kind"), F.concat(F.lit("ISSUE:"), "issue_code").alias("subject_key"), "issue_code", "row_count")
    )
    return _union([errors, resolutions, waiting])


def ready_to_confirm(batches: DataFrame, report: DataFrame) -> DataFrame:
    opened = report.select("batch_id").distinct().withColumn("_open", F.lit(True))
    return batches.join(opened, "batch_id", "left").withColumn("ready_to_confirm", F.col("_open").isNull()).drop("_open")


def decision_allowed() -> Column:
    allowed = F.lit(False)
    for code, decisions in ALLOWED_DECISIONS.items():
        allowed = allowed | ((F.col("issue_code") == code) & F.col("decision").isin(*decisions))
    return allowed


def decision_findings(requested: DataFrame, requested_rows: DataFrame, rows: DataFrame) -> DataFrame:
    """Decisions with ``code``: the first rule each breaks, NULL when valid.

    ``requested``: batch_id, subject_key, issue_code, decision, reason,
    row_number, stable_id, representative_sku_code, representative_sku_name,
    product_name. ``requested_rows`` lists the rows a decision claims to cover.
    """
    gates = resolution_gates(rows)
    key = ["batch_id", "subject_key", "issue_code"]
    scope = same_row_sets(gates, requested_rows, key).select(*key, F.col("same").alias("_scope"))
    known_rows = rows.select("batch_id", "row_number").withColumn("_row", F.lit(True))
    # A representative must be a SKU of its product group and give it its name.
    member = (
        rows.filter(F.col("sku_code").isNotNull()).select(
            "batch_id",
            F.concat(F.lit("PRODUCT_GROUP:"), "source_product_code").alias("subject_key"),
            F.col("sku_code").alias("representative_sku_code"),
            F.col("sku_name").alias("_name"),
        )
        if "source_product_code" in rows.columns
        else None
    )
    joined = requested.join(scope, key, "left").join(known_rows, ["batch_id", "row_number"], "left")
    merge = F.col("decision") == "MERGE_AS_ONE_PRODUCT"
    if member is not None:
        named = member.groupBy("batch_id", "subject_key", "representative_sku_code").agg(F.max("_name").alias("_name"))
        joined = joined.join(named, ["batch_id", "subject_key", "representative_sku_code"], "left")
        wrong = merge & ~(F.col("_name").eqNullSafe(F.col("representative_sku_name")) & F.col("_name").eqNullSafe(F.col("product_name")) & F.col("_name").isNotNull())
    else:
        wrong = merge
    has_gate = F.col("_scope").isNotNull()
    whole_set = F.col("issue_code") != "MDM_IMPORT_PARENT_UNRESOLVED"
    code = (
        F.when(blank_to_null("reason").isNull(), "DECISION_REASON_REQUIRED")
        .when(~F.coalesce(decision_allowed(), F.lit(False)), "INVALID_DECISION")
        .when(has_gate & whole_set & ~F.col("_scope"), "DECISION_SCOPE_MISMATCH")
        .when(~has_gate & F.col("_row").isNull(), "DECISION_SUBJECT_NOT_FOUND")
        .when(F.col("decision").isin("MAP_EXISTING", "MAP_PARENT") & F.col("stable_id").isNull(), "MAPPING_WITHOUT_TARGET")
        .when(wrong, "PRODUCT_REPRESENTATIVE_REQUIRED")
    )
    return joined.withColumn("code", code).select(*requested.columns, "code")


def carry_decisions(previous: DataFrame, fresh: DataFrame) -> DataFrame:
    """Decisions of the next version: the fresh ones and all they do not replace."""
    key = ["batch_id", "subject_key", "issue_code", "decision_type"]
    kept = previous.join(fresh.select(*key).distinct(), key, "left_anti").withColumn("review_version", F.col("review_version") + 1)
    return kept.unionByName(fresh.select(*previous.columns))


def resolve_errors(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Errors with a RESOLUTION decision are resolved; a row without open
    errors becomes WARNING or VALID."""
    key = ["batch_id", "row_number"]
    decided = decisions.filter((F.col("decision_type") == RESOLUTION) & F.col("row_number").isNotNull())
    codes = decided.groupBy(*key).agg(F.collect_set("issue_code").alias("_codes"))
    joined = rows.join(codes, key, "left")

    def resolve(item: Column) -> Column:
        hit = (item["severity"] == "ERROR") & F.array_contains("_codes", item["code"])
        return F.when(F.coalesce(hit, F.lit(False)), item.withField("resolved", F.lit(True))).otherwise(item)

    marked = joined.withColumn("findings", F.transform("findings", resolve))
    still_open = F.exists("findings", lambda i: (i["severity"] == "ERROR") & ~i["resolved"])
    warned = F.exists("findings", lambda i: i["severity"] == "WARNING")
    status = F.when(F.col("_codes").isNull() | still_open, F.col("status")).when(warned, "WARNING").otherwise("VALID")
    return marked.withColumn("status", status).drop("_codes")


def missing_dependencies(batches: DataFrame) -> DataFrame:
    """Customer batches whose source has no committed channel or rep batch."""
    needed = F.explode(F.array(F.lit("CHANNEL"), F.lit("SALESREP")))
    wanted = batches.filter(F.col("entity_type") == "CUSTOMER").select("batch_id", "source_system", needed.alias("missing_entity_type"))
    committed = batches.filter(F.col("status") == "COMMITTED").select("source_system", F.col("entity_type").alias("missing_entity_type")).distinct()
    return wanted.join(committed, ["source_system", "missing_entity_type"], "left_anti")


def confirm_or_cancel(batches: DataFrame, requests: DataFrame, report: DataFrame) -> DataFrame:
    """Batches with ``outcome`` and their status after CONFIRM and CANCEL requests.

    ``requests``: batch_id, action, review_version.
    """
    opened = report.select("batch_id").distinct().withColumn("_open", F.lit(True))
    lacking = missing_dependencies(batches).select("batch_id").distinct().withColumn("_lacking", F.lit(True))
    asked = requests.select("batch_id", F.col("action").alias("_action"), F.col("review_version").alias("_asked"))
    joined = batches.join(asked, "batch_id", "left").join(opened, "batch_id", "left").join(lacking, "batch_id", "left")
    confirm, cancel = F.col("_action") == "CONFIRM", F.col("_action") == "CANCEL"
    reviewing = F.col("status").isin(*REVIEW_STATES)
    outcome = (
        F.when(F.col("_action").isNull(), "UNTOUCHED")
        .when((confirm & ~reviewing) | (cancel & ~F.col("status").isin(*REVIEW_STATES, "CONFIRMED")), "STATE_CONFLICT")
        .when(cancel, "CANCELLED")
        .when(~F.col("_asked").eqNullSafe(F.col("review_version")), "STALE_REVIEW_VERSION")
        .when(F.col("_open").isNotNull() | (F.col("error_rows") > 0), "REVIEW_INCOMPLETE")
        .when(F.col("_lacking").isNotNull(), "DEPENDENCY_MISSING")
        .otherwise("CONFIRMED")
    )
    marked = joined.withColumn("outcome", outcome)
    changed = F.col("outcome").isin("CONFIRMED", "CANCELLED")
    return marked.withColumn("status", F.when(changed, F.col("outcome")).otherwise(F.col("status"))).select(*batches.columns, "outcome")


def review_payload(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Row with its finding views and decisions, as nested columns.

    A row has few findings and decisions; they are sorted for a stable result.
    """
    per_row = decisions.groupBy("batch_id", "row_number").agg(
        F.array_sort(F.collect_list(F.struct("issue_code", "decision_type", "decision", "reason"))).alias("decisions")
    )
    return rows.join(per_row, ["batch_id", "row_number"], "left").withColumn("findings", F.array_sort(F.transform("findings", lambda f: F.struct(f["code"], f["severity"], f["field"], f["candidate_count"])))).withColumn(
        "decisions", F.coalesce("decisions", F.array().cast("array<struct<issue_code:string,decision_type:string,decision:string,reason:string>>"))
    )
