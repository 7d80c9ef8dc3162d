"""Production lots: month aggregation, lifecycle, revisions, remaining stock.

A lot is (product, production date). Its rows are reduced to one per month
before anything else, so a lot never holds more rows than there are months.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.functions.dates import month_count
from stockweave.operators.planning_feeds import BALANCE, PLANNING_AVAILABLE, STORED_QTY

LOT = ("product_id", "production_date")

# Labels of lot states.
LOT_LABELS = {"SOLD_OUT": "已售罄", "ACTIVE": "消耗中", "PRE_EXISTING": "期初已存在 / 首次入库未知"}
AMBIGUOUS_LABEL = "数据异常：批次记录来源无法唯一确定"


def source_findings(sources: DataFrame) -> DataFrame:
    """Selected sources that cannot be used together.

    ``sources``: dataset_version_id, inventory_month. One version per month,
    each version once, positive ids, months on their first day.
    """
    one = F.lit(1)
    ids = sources.groupBy("dataset_version_id").agg(F.count(one).alias("n"))
    months = sources.groupBy("inventory_month").agg(F.min("dataset_version_id").alias("a"), F.max("dataset_version_id").alias("b"))
    found = [
        ids.filter(F.col("dataset_version_id") <= 0).select(F.lit("VERSION_ID_NOT_POSITIVE").alias("code"), F.col("dataset_version_id").cast("string").alias("subject")),
        ids.filter("n > 1").select(F.lit("VERSION_SELECTED_TWICE").alias("code"), F.col("dataset_version_id").cast("string").alias("subject")),
        months.filter(F.dayofmonth("inventory_month") != 1).select(F.lit("MONTH_NOT_FIRST_DAY").alias("code"), F.col("inventory_month").cast("string").alias("subject")),
        months.filter("a <> b").select(F.lit("SEVERAL_VERSIONS_FOR_MONTH").alias("code"), F.col("inventory_month").cast("string").alias("subject")),
    ]
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def lot_months(planning: DataFrame) -> DataFrame:
    """One row per lot and month: four sums, version and policy.

    Needs dataset_version_id and policy_version. ``mixed`` marks a lot-month
    fed by several versions or policies, which must not be used.
    """
    grouped = planning.groupBy(*LOT, "inventory_month").agg(
        *[F.sum(c).cast(STORED_QTY).alias(c) for c in BALANCE],
        F.min("dataset_version_id").alias("dataset_version_id"),
        F.max("dataset_version_id").alias("_last_version"),
        F.min("policy_version").alias("policy_version"),
        F.max("policy_version").alias("_last_policy"),
    )
    mixed = (F.col("dataset_version_id") != F.col("_last_version")) | (F.col("policy_version") != F.col("_last_policy"))
    return grouped.withColumn("mixed", F.coalesce(mixed, F.lit(False))).drop("_last_version", "_last_policy")


def lifecycles(months: DataFrame) -> DataFrame:
    """Lifecycle of each lot from its observed months.

    First inbound: first month with a receipt, unknown when stock was there
    before. Sold out: first month of the trailing run of zero endings; missing
    months do not break the run. Lots never seen with stock are dropped.
    """
    observation = F.struct("inventory_month", *BALANCE, "dataset_version_id", "policy_version")
    lots = months.groupBy(*LOT).agg(
        F.array_sort(F.collect_list(observation)).alias("observations"),
        F.min_by("opening_qty", "inventory_month").alias("_first_opening"),
        F.min(F.when(F.col("receipt_qty") > 0, F.col("inventory_month"))).alias("_receipt"),
        F.max(F.when(F.col("ending_qty") != 0, F.col("inventory_month"))).alias("_stocked"),
    )
    existing = F.col("_first_opening") > 0
    tail = F.filter("observations", lambda m: F.col("_stocked").isNull() | (m["inventory_month"] > F.col("_stocked")))
    sold_out = F.try_element_at(tail, F.lit(1))["inventory_month"]
    first_inbound = F.when(~existing, F.col("_receipt"))
    state = F.when(sold_out.isNotNull(), "SOLD_OUT").when(existing, "PRE_EXISTING").otherwise("ACTIVE")
    return lots.filter(existing | F.col("_receipt").isNotNull()).select(
        *LOT,
        state.alias("lifecycle_state"),
        first_inbound.alias("first_inbound_month"),
        sold_out.alias("final_sold_out_month"),
        month_count(first_inbound, sold_out).alias("consumption_months"),
        "observations",
        F.transform("observations", lambda m: m["dataset_version_id"]).alias("source_versions"),
    )


def with_return_policy(lots: DataFrame, policy: Callable[[Column], Column] | None) -> DataFrame:
    """Adds the decision of a user policy over a lot's ordered months.

    ``policy`` maps the observations array to a struct (classification,
    policy_code, policy_version, policy_parameters) or NULL.
    """
    kind = "struct<classification:string,policy_code:string,policy_version:string,policy_parameters:map<string,string>>"
    decision = F.lit(None) if policy is None else policy(F.col("observations"))
    return lots.withColumn("return_decision", decision.cast(kind))


_BUSINESS = ("lifecycle_state", "first_inbound_month", "final_sold_out_month", "consumption_months")


def provenance() -> Column:
    """Sorted (version, policy) pairs behind a lifecycle result."""
    return F.array_sort(
        F.transform("observations", lambda m: F.struct(m["dataset_version_id"].alias("version"), m["policy_version"].alias("policy")))
    )


def provenance_findings(results: DataFrame, versions: DataFrame) -> DataFrame:
    """Observations whose version is unknown or does not cover their month."""
    seen = results.select(*LOT, F.explode("observations").alias("m")).select(*LOT, "m.inventory_month", "m.dataset_version_id")
    covers = versions.filter(F.col("dataset_type") == "INVENTORY").select("dataset_version_id", "period_start", "period_end")
    joined = seen.join(covers, "dataset_version_id", "left")
    code = F.when(F.col("period_start").isNull(), "SOURCE_VERSION_UNKNOWN").when(
        ~F.col("inventory_month").between(F.col("period_start"), F.col("period_end")), "MONTH_OUTSIDE_VERSION"
    )
    return joined.withColumn("code", code).filter("code is not null").select(*LOT, "inventory_month", "dataset_version_id", "code")


def next_revisions(results: DataFrame, stored: DataFrame) -> DataFrame:
    """Revision per result: a new one only when values or provenance changed.

    ``stored``: lot, revision_no, business values, return_decision, provenance.
    """
    fields = F.struct(*_BUSINESS, F.to_json("return_decision").alias("decision"), "provenance")
    latest = stored.groupBy(*LOT).agg(F.max("revision_no").alias("_no"), F.max_by(fields, "revision_no").alias("_old"))
    fresh = results.withColumn("provenance", provenance()).withColumn("_new", F.struct(*_BUSINESS, F.to_json("return_decision").alias("decision"), "provenance"))
    joined = fresh.join(latest, list(LOT), "left")
    same = F.col("_new").eqNullSafe(F.col("_old"))
    return (
        joined.withColumn("created", ~same)
        .withColumn("revision_no", F.when(same, F.col("_no")).otherwise(F.coalesce("_no", F.lit(0)) + 1))
        .drop("_new", "_old", "_no")
    )


def unambiguous_revisions(revisions: DataFrame) -> DataFrame:
    """The one revision of a lot whose evidence contains all others' evidence.

    Containing every other set means equalling their union, so no pair of
    revisions is compared. ``evidence`` is an array of distinct version ids.
    Output: the revision's columns, or NULL where none or several qualify.
    """
    evidence = revisions.select(*LOT, "revision_id", F.explode("evidence").alias("version"))
    union = evidence.groupBy(*LOT).agg(F.count_distinct("version").alias("_all"))
    covering = revisions.join(union, list(LOT)).filter(F.size("evidence") == F.col("_all"))
    return covering.groupBy(*LOT).agg(F.count(F.lit(1)).alias("covering"), F.min("revision_id").alias("_id")).join(
        revisions.select(*LOT).distinct(), list(LOT), "right"
    ).select(*LOT, F.when(F.col("covering") == 1, F.col("_id")).alias("revision_id"))


def eligible_revisions(revisions: DataFrame, sources: DataFrame, cycles: DataFrame, bindings: DataFrame, versions: DataFrame) -> DataFrame:
    """Revisions whose every source is bound whole and ends by T-1, per cycle, with their ``source_count``.

    ``sources``: revision_id, version. A relational division: as many of a
    revision's sources meet a usable version of the cycle as it has; no set is
    gathered, and a revision without sources is none. A locked cycle ignores
    revisions created after its lock.
    """
    inventory = versions.filter(F.col("dataset_type") == "INVENTORY").select(
        "dataset_version_id", F.col("period_start").alias("_vs"), F.col("period_end").alias("_ve")
    )
    baseline = F.add_months("cycle_month", -1)
    usable = (
        bindings.join(inventory, "dataset_version_id")
        .join(cycles.select("cycle_id", "cycle_month"), "cycle_id")
        .filter((F.col("period_start") == F.col("_vs")) & (F.col("period_end") == F.col("_ve")) & (F.col("_ve") <= baseline))
        .select("cycle_id", F.col("dataset_version_id").alias("version"))
        .distinct()
    )
    used = sources.select("revision_id", "version").distinct()
    needed = used.groupBy("revision_id").agg(F.count(F.lit(1)).alias("source_count"))
    hits = used.join(usable, "version").groupBy("cycle_id", "revision_id").agg(F.count(F.lit(1)).alias("_hits"))
    lock = cycles.select("cycle_id", "status", "locked_at")
    return (
        hits.join(needed, "revision_id")
        .filter(F.col("_hits") == F.col("source_count"))
        .join(revisions, "revision_id")
        .join(lock, "cycle_id")
        .filter((F.col("status") != "LOCKED") | (F.col("created_at") <= F.col("locked_at")))
        .drop("_hits", "status", "locked_at")
    )


def lot_remaining(raw: DataFrame, product_month: DataFrame, *scope: str) -> DataFrame:
    """Ending stock per lot from raw rows, where raw agrees with the product fact.

    ``raw`` holds the stored rows with their JSON payload. A product's lots are
    shown only when total and policy match the published product month.
    """
    status = F.get_json_object("raw_payload", "$.warehouse_planning_status")
    policy = F.get_json_object("raw_payload", "$.planning_policy_version")
    usable = raw.filter(status == PLANNING_AVAILABLE).withColumn("_policy", policy)
    by_lot = usable.groupBy(*scope, *LOT).agg(
        F.sum("ending_qty").cast(STORED_QTY).alias("remaining_qty"), F.min("_policy").alias("_p1"), F.max("_policy").alias("_p2")
    )
    totals = by_lot.groupBy(*scope, "product_id").agg(
        F.sum("remaining_qty").alias("_total"), F.min("_p1").alias("_p1"), F.max("_p2").alias("_p2")
    )
    fact = product_month.select(*scope, "product_id", F.col("ending_qty").alias("_fact"), "warehouse_policy_version")
    agreeing = totals.join(fact, [*scope, "product_id"]).filter(
        (F.col("_total") == F.col("_fact"))
        & (F.col("_p1") == F.col("warehouse_policy_version"))
        & (F.col("_p2") == F.col("warehouse_policy_version"))
    )
    return by_lot.join(agreeing.select(*scope, "product_id"), [*scope, "product_id"], "left_semi").drop("_p1", "_p2")


def lot_details(eligible: DataFrame, sources: DataFrame, versions: DataFrame, remaining: DataFrame | None = None) -> DataFrame:
    """Lots shown in a cycle: the unambiguous revision, or a marked gap."""
    chosen_ids = _unambiguous_per_cycle(eligible, sources)
    chosen = chosen_ids.join(eligible, ["cycle_id", *LOT, "revision_id"], "left")
    seen = chosen.select("cycle_id", *LOT, "revision_id").join(sources.select("revision_id", F.col("version").alias("dataset_version_id")).distinct(), "revision_id")
    # the shown list is one id for each source of one revision
    through = (
        seen.join(versions.select("dataset_version_id", "period_end"), "dataset_version_id")
        .groupBy("cycle_id", *LOT)
        .agg(F.max("period_end").alias("observed_through"), F.array_sort(F.collect_list("dataset_version_id")).alias("source_version_ids"))
    )
    label = F.lit(AMBIGUOUS_LABEL)
    for state, text in LOT_LABELS.items():
        label = F.when(F.col("lifecycle_state") == state, text).otherwise(label)
    details = chosen.join(through, ["cycle_id", *LOT], "left")
    if remaining is not None:
        details = details.join(remaining, ["cycle_id", *LOT], "left")
    else:
        details = details.withColumn("remaining_qty", F.lit(None).cast(STORED_QTY))
    known = F.col("revision_id").isNotNull()
    return details.select(
        "cycle_id",
        *LOT,
        "lifecycle_state",
        label.alias("status_label"),
        "first_inbound_month",
        "final_sold_out_month",
        F.when(F.col("lifecycle_state") == "SOLD_OUT", F.col("consumption_months")).alias("consumption_months"),
        "observed_through",
        F.when(known, F.col("remaining_qty")).alias("remaining_qty"),
        "revision_no",
        F.coalesce("source_version_ids", F.array().cast("array<bigint>")).alias("source_version_ids"),
    )


def _unambiguous_per_cycle(eligible: DataFrame, sources: DataFrame) -> DataFrame:
    """The one revision of a lot and cycle that has every source any of them has."""
    key = ["cycle_id", *LOT]
    used = eligible.select(*key, "revision_id").join(sources.select("revision_id", "version"), "revision_id")
    union = used.groupBy(*key).agg(F.count_distinct("version").alias("_all"))
    marked = eligible.join(union, key).withColumn("_covers", F.col("source_count") == F.col("_all"))
    return marked.groupBy(*key).agg(
        F.when(F.count_if("_covers") == 1, F.min(F.when(F.col("_covers"), F.col("revision_id")))).alias("revision_id")
    )
