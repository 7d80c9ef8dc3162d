"""Rows of a commit: one checked delivery becomes its version, raw and fact rows, all of them or none.

A commit answers for any number of deliveries (``batch_id``) at once. First a
verdict per request, then the tables of the accepted ones; a refused delivery
has rows in no table. A version's id is a digest of its kind and key, so every
table computes it by itself and a rerun gives the same rows. :func:`observed`
counts a table's rows while it is written; the tables are the caller's to store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from stockweave.operators import planning_feeds as feeds
from stockweave.operators.sales_feed import mapping_issues, mapping_summary
from stockweave.sources.registry import checksum_valid

_VERSION = ("dataset_version_id", "dataset_type", "version_key", "version_label", "period_start", "period_end", "source_name", "source_checksum", "created_by")


def version_id(kind: Column | str, key: str = "version_key") -> Column:
    return F.sha2(F.concat_ws("|", F.lit(kind) if isinstance(kind, str) else kind, F.col(key)), 256)


def commit_verdicts(requests: DataFrame, previews: DataFrame, registry: DataFrame, kind: str) -> DataFrame:
    """Requests with their period, version id and the ``code`` of the first rule they break.

    ``requests``: batch_id, request_no (their order), version_key,
    source_checksum and what the version row shows. ``previews``: batch_id,
    commit_allowed, period_start, period_end. ``registry``: dataset_type,
    version_key, period_start, period_end, source_checksum of stored versions.
    A key or a (period, checksum) may come once; of several requests that pass
    the other rules the first counts, as if they came one after the other.
    """
    seen = previews.select("batch_id", "commit_allowed", "period_start", "period_end")
    joined = requests.join(seen, "batch_id", "left")
    blocked = ~F.coalesce("commit_allowed", F.lit(False)) | F.col("period_start").isNull() | F.col("period_end").isNull()
    source = ["period_start", "period_end", "source_checksum"]
    keys = registry.select("version_key", F.lit(True).alias("_key_stored")).distinct()
    sources = registry.filter(F.col("dataset_type") == kind).select(*source, F.lit(True).alias("_source_stored")).distinct()
    judged = joined.join(keys, "version_key", "left").join(sources, source, "left").withColumn(
        "_own",
        F.when(blocked, "PREVIEW_BLOCKED")
        .when(~checksum_valid("source_checksum"), "CHECKSUM_INVALID")
        .when(F.col("_key_stored"), "VERSION_KEY_EXISTS")
        .when(F.col("_source_stored"), "SOURCE_ALREADY_IMPORTED"),
    )
    passed = judged.filter(F.col("_own").isNull())
    for name, by in (("_first_of_key", ["version_key"]), ("_first_of_source", source)):
        judged = judged.join(passed.groupBy(*by).agg(F.min("request_no").alias(name)), by, "left")
    code = (
        F.when(F.col("_own").isNotNull(), F.col("_own"))
        .when(F.col("request_no") > F.col("_first_of_key"), "VERSION_KEY_EXISTS")
        .when(F.col("request_no") > F.col("_first_of_source"), "SOURCE_ALREADY_IMPORTED")
    )
    kept = [*requests.columns, "period_start", "period_end"]
    return judged.withColumn("code", code).select(
        *kept, "code", F.lit(kind).alias("dataset_type"), F.when(F.col("code").isNull(), version_id(kind)).alias("dataset_version_id")
    )


def _accepted(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of the accepted deliveries with their version id."""
    return rows.join(verdicts.filter(F.col("code").isNull()).select("batch_id", "dataset_version_id"), "batch_id")


def _versions(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter(F.col("code").isNull()).select(*[c for c in _VERSION if c in verdicts.columns])


def _payload(rows: DataFrame, **fields: str) -> Column:
    """JSON of a row's place and source values; numbers as plain text."""
    shown = [F.col(c).cast("string").alias(name) if rows.schema[c].dataType.typeName() == "decimal" else F.col(c).alias(name) for name, c in fields.items()]
    return F.to_json(F.struct(*shown, *(["erp_values"] if "erp_values" in rows.columns else [])), {"ignoreNullFields": "false"}).alias("raw_payload")


def _present(rows: DataFrame, *names: str) -> list[str]:
    return [c for c in names if c in rows.columns]


def actual_tables(checked: DataFrame, verdicts: DataFrame) -> dict[str, DataFrame]:
    """Version, raw rows and both monthly facts of shipment deliveries (IO15)."""
    valid = _accepted(checked.filter(feeds.is_clean()), verdicts)
    raw = valid.select(
        "dataset_version_id",
        F.col("row_number").alias("source_row_no"),
        F.concat(F.lit("NAME:"), "customer_name").alias("erp_customer_code"),
        F.col("customer_name").alias("erp_customer_name"),
        F.col("sku_code").alias("source_sku_code"),
        F.col("sku_name").alias("source_sku_name"),
        *_present(valid, "customer_id", "customer_stable_id", "channel_id", "channel_stable_id", "sku_id", "sku_stable_id", "product_id", "product_stable_id"),
        "sales_date",
        F.col("shipped_qty").cast(feeds.STORED_QTY).alias("shipped_qty"),
        F.concat(F.lit("NAME:"), "warehouse_name").alias("warehouse_code"),
        "warehouse_name",
        "production_date",
        "batch_no",
        _payload(valid, source_row_number="row_number"),
    )
    return {
        "dataset_version": _versions(verdicts),
        "actual_raw": raw,
        "actual_channel_product_month": feeds.actual_channel_months(valid, "dataset_version_id"),
        "actual_product_production_month": feeds.actual_production_months(valid, "dataset_version_id"),
    }


def inventory_tables(checked: DataFrame, verdicts: DataFrame) -> dict[str, DataFrame]:
    """Version, raw rows with the excluded warehouses, and both monthly facts without them (IO16)."""
    stored = _accepted(feeds.inventory_raw(checked), verdicts)
    planning = feeds.planning_rows(stored)
    raw = stored.select(
        "dataset_version_id",
        F.col("row_number").alias("source_row_no"),
        "inventory_month",
        F.col("sku_code").alias("source_sku_code"),
        *_present(stored, "sku_id", "sku_stable_id", "product_id", "product_stable_id"),
        F.concat(F.lit("NAME:"), "warehouse_name").alias("warehouse_code"),
        "warehouse_name",
        "production_date",
        *_present(stored, "batch_no"),
        *[F.col(c).cast(feeds.STORED_QTY).alias(c) for c in feeds.BALANCE],
        _payload(stored, source_row_number="row_number", warehouse_planning_status="planning_status", planning_policy_version="policy_version"),
    )
    scope = F.lit(feeds.PLANNING_AVAILABLE).alias("warehouse_scope")
    return {
        "dataset_version": _versions(verdicts),
        "inventory_raw": raw,
        "inventory_sku_month": feeds.inventory_months(planning, ["sku_id", "product_id"], "dataset_version_id").select("*", scope),
        "inventory_product_month": feeds.inventory_months(planning, ["product_id"], "dataset_version_id").select("*", scope),
    }


def incoming_tables(checked: DataFrame, verdicts: DataFrame) -> dict[str, DataFrame]:
    """Snapshot and its lines; the product totals go with the answer (IO17)."""
    valid = _accepted(checked.filter(feeds.is_clean()), verdicts).withColumnRenamed("dataset_version_id", "snapshot_id")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    lines = valid.select(
        "snapshot_id",
        "source_sheet_name",
        F.col("row_number").alias("source_row_no"),
        F.col("sku_code").alias("source_sku_code"),
        *_present(valid, "sku_name", "sku_id", "sku_stable_id", "product_id", "product_stable_id"),
        F.col("eta").alias("expected_arrival_date"),
        F.col("shipment_qty").cast(feeds.STORED_QTY).alias("incoming_qty"),
        none("string", "warehouse_code"),
        "warehouse_entry_recorded",
        none("date", "production_date"),
        *_present(valid, "batch_no"),
        _payload(valid, source_sheet_name="source_sheet_name", source_row_number="row_number", **{c: c for c in _present(valid, "order_group", "order_no", "order_qty", "shipped_total", "difference_qty")}),
    )
    snapshots = verdicts.filter(F.col("code").isNull()).select(
        F.col("dataset_version_id").alias("snapshot_id"), F.col("version_key").alias("snapshot_key"), *_present(verdicts, "snapshot_at", "source_name", "source_checksum", "created_by")
    )
    return {"incoming_snapshot": snapshots, "incoming_snapshot_line": lines, "product_totals": feeds.future_supply(valid, "snapshot_id")}


def sales_verdicts(files: DataFrame, verdicts: DataFrame, registry: DataFrame) -> DataFrame:
    """Sales files with the ``code`` that keeps them out: blocked by their rows, or delivered before.

    ``files``: batch_id, request_no, filename, file_hash; ``verdicts``: batch_id
    and the columns of :func:`sales_feed.file_verdict`; ``registry``: file_hash
    of stored batches. Of equal files in one call the first that is not blocked counts.
    """
    joined = files.join(verdicts, "batch_id", "left").join(registry.select("file_hash", F.lit(True).alias("_stored")).distinct(), "file_hash", "left")
    open_ = joined.filter(~F.coalesce("blocked", F.lit(True)) & F.col("_stored").isNull())
    firsts = open_.groupBy("file_hash").agg(F.min("request_no").alias("_first"))
    code = F.when(F.coalesce("blocked", F.lit(True)), "FILE_BLOCKED").when(F.col("_stored") | (F.col("request_no") > F.col("_first")), "FILE_ALREADY_IMPORTED")
    return joined.join(firsts, "file_hash", "left").withColumn("code", code).drop("_stored", "_first")


_SALES_ROW = ("source_document_no", "source_line_no", "sales_date", "source_customer_name", "source_product_type", "source_sku_code", "source_sku_name", "actual_qty")


def sales_preview_tables(mapped: DataFrame, verdicts: DataFrame) -> dict[str, DataFrame]:
    """Batch, rows, candidates and issues of a mapped sales file, ready for review (IO18).

    ``mapped``: rows of :func:`resolution.map_sales_rows` with their batch_id.
    Rows and candidates show those of their columns that the rows carry.
    """
    accepted = verdicts.filter(F.col("code").isNull())
    rows = mapped.join(accepted.select("batch_id"), "batch_id", "left_semi")
    totals = mapping_summary(rows, "batch_id").select("batch_id", F.col("raw_rows").alias("total_rows"), "ready_rows", "skipped_rows", (F.col("ready_qty") + F.col("skipped_qty")).cast("decimal(28,4)").alias("total_qty"), "ready_qty", "skipped_qty")
    kept = [c for c in ("batch_id", "filename", "file_hash", "snapshot_month", "data_date_start", "data_date_end") if c in accepted.columns]
    batch = accepted.select(*kept).join(totals, "batch_id").withColumn("status", F.lit("PREVIEW_READY"))
    snapshot = [c for c in mapped.columns if c not in (*_SALES_ROW, "batch_id", "source_row_no", "status", "mapping_reason", "snapshot_month")]
    return {
        "sales_import_batch": batch,
        "sales_import_row": rows.select("batch_id", "source_row_no", *_present(rows, *_SALES_ROW), "status", "mapping_reason"),
        "sales_import_candidate": rows.filter(F.col("status") == "READY").select("batch_id", "source_row_no", *snapshot),
        "sales_mapping_issue": mapping_issues(rows, "batch_id"),
    }


def sales_raw_tables(rows: DataFrame, verdicts: DataFrame) -> dict[str, DataFrame]:
    """Batch and rows that wait for their mapping: a validated import alone (IO19)."""
    accepted = verdicts.filter(F.col("code").isNull())
    stored = rows.join(accepted.select("batch_id"), "batch_id", "left_semi")
    totals = stored.groupBy("batch_id").agg(F.count(F.lit(1)).alias("total_rows"), F.sum("actual_qty").cast("decimal(28,4)").alias("total_qty"))
    zero = F.lit(0).cast("bigint")
    batch = accepted.select(*_present(accepted, "batch_id", "filename", "file_hash", "snapshot_month", "data_date_start", "data_date_end")).join(totals, "batch_id")
    return {
        "sales_import_batch": batch.select("*", F.lit("VALIDATED").alias("status"), zero.alias("ready_rows"), zero.alias("skipped_rows")),
        "sales_import_row": stored.select("batch_id", "source_row_no", *_SALES_ROW, F.lit("PENDING").alias("status"), F.lit(None).cast("string").alias("mapping_reason")),
    }


def import_tables(evaluated: DataFrame, requests: DataFrame, normalised: list[str]) -> dict[str, DataFrame]:
    """Batch, rows and findings of an evaluated master import (IO20).

    ``evaluated``: rows with status, action, findings, raw (a map) and the
    matched entity where there is one; ``requests``: batch_id, entity_type,
    import_mode, source_system, source_sha256. Operational batches store their
    clean rows as READY, with the reviewed values, and one row per finding.
    """
    mode = requests.select("batch_id", "import_mode", "source_system")
    rows = evaluated.join(mode, "batch_id")
    operational = F.col("import_mode") == "OPERATIONAL"
    stored = F.when(operational & (F.col("status") == "VALID"), "READY").otherwise(F.col("status"))
    part = lambda severity: F.filter("findings", lambda f: f["severity"] == severity)
    some = lambda severity: F.when(F.size(part(severity)) > 0, F.to_json(part(severity)))
    existing = F.col("action") == "EXISTING"
    entity = F.col("entity") if "entity" in evaluated.columns else F.lit(None).cast("struct<entity_type: string, entity_id: bigint, stable_id: string>")
    values = F.struct(*[F.col(c) for c in normalised])
    meta = F.struct(
        F.struct("source_system", "row_number").alias("source"), F.col("import_mode").alias("mode"), "action", "would_write", part("INFO").alias("information")
    )
    row_table = rows.withColumn("_stored", stored).select(
        "batch_id",
        "row_number",
        F.to_json("raw", {"ignoreNullFields": "false"}).alias("raw_values"),
        F.to_json(F.struct(*[F.col(c) for c in normalised], meta.alias("_meta")), {"ignoreNullFields": "false"}).alias("normalized_values"),
        some("ERROR").alias("errors"),
        some("WARNING").alias("warnings"),
        entity["entity_id"].alias("resolved_entity_id"),
        F.when(existing, entity["stable_id"]).alias("final_target_stable_id"),
        F.when(existing, "EXISTING").alias("commit_result"),
        F.when(F.col("_stored") == "READY", F.to_json(values, {"ignoreNullFields": "false"})).alias("reviewed_values"),
        F.col("_stored").alias("status"),
    )
    found = rows.filter(operational).select("batch_id", "row_number", F.explode("findings").alias("f")).select(
        "batch_id", "row_number", F.lit(1).alias("review_version"), F.col("f.code").alias("rule_code"), "f.severity", F.col("f.field").alias("field_name"), F.to_json(F.struct("f.candidate_key", "f.candidate_count", "f.resolved", "f.details")).alias("details")
    )
    counts = evaluated.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("status") != "ERROR").alias("valid_rows"),
        F.count_if(F.col("status") == "WARNING").alias("warning_rows"),
        F.count_if(F.col("status") == "ERROR").alias("error_rows"),
    )
    status = (
        F.when(F.col("import_mode") != "OPERATIONAL", "READY_FOR_REVIEW")
        .when((F.col("warning_rows") > 0) | (F.col("error_rows") > 0), "REVIEW")
        .otherwise("READY_TO_COMMIT")
    )
    return {"import_batch": requests.join(counts, "batch_id").withColumn("status", status), "import_row": row_table, "import_finding": found}


def observed(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, Observation]]:
    """The tables with an observation each: its ``rows`` are known once the table is written, without another pass."""
    watches = {name: Observation(name) for name in tables}
    return {name: frame.observe(watches[name], F.count(F.lit(1)).alias("rows")) for name, frame in tables.items()}, watches


def commit_counts(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows per version in each table, as the commit's answer shows them."""
    counts = None
    for name, frame in tables.items():
        part = frame.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).select(key, F.lit(name).alias("table_name"), "rows")
        counts = part if counts is None else counts.unionByName(part)
    return counts
