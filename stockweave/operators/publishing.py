"""Publishing a monthly snapshot: integrity, gate, fact build, lineage.

All operators take the batches of any number of months at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.operators.dashboard import SCOPE, is_current

# Gate states and codes.
READY = "READY"
REQUIRES_CONFIRMATION = "REQUIRES_CONFIRMATION"
BLOCKED = "BLOCKED"
DROP_CONFIRMATION = "ABNORMAL_DROP_THRESHOLD"
DEFAULT_DROP_THRESHOLD = "0.8"

_QTY = "decimal(28,4)"

FACT_COLUMNS = (
    "import_row_id",
    "source_system",
    "source_document_no",
    "source_line_no",
    "snapshot_month",
    "sales_date",
    "actual_qty",
    "sku_id",
    "sku_code_snapshot",
    "sku_name_snapshot",
    "product_id",
    "product_name_snapshot",
    "customer_id",
    "channel_id_snapshot",
    "channel_name_snapshot",
    "salesrep_id_snapshot",
    "salesrep_name_snapshot",
)


def _sum(column: str, when: Column | None = None) -> Column:
    value = F.col(column) if when is None else F.when(when, F.col(column))
    return F.coalesce(F.sum(value), F.lit(0)).cast(_QTY)


def preview_integrity(batches: DataFrame, rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Violated counters per batch: label, actual and expected value.

    ``rows``: import_row_id, batch_id, status, actual_qty.
    ``candidates``: import_row_id, batch_id.
    """
    one, status = F.lit(1), F.col("status")
    row_side = rows.groupBy("batch_id").agg(
        F.count(one).alias("raw_rows"),
        F.count_if(status == "READY").alias("ready"),
        F.count_if(status == "SKIPPED").alias("skipped"),
        F.count_if(status == "PENDING").alias("pending"),
        _sum("actual_qty").alias("raw_qty"),
        _sum("actual_qty", status == "READY").alias("ready_sum"),
        _sum("actual_qty", status == "SKIPPED").alias("skipped_sum"),
    )
    origin = rows.select("import_row_id", F.col("batch_id").alias("_row_batch"), "status", "actual_qty")
    # One row per (batch, import row) first: repeated candidates are counted, not kept.
    # Dealt by import row, they are counted and joined where they are: rows and
    # candidates move once, and rows that meet none are seen in the same join.
    copies = candidates.select("import_row_id", "batch_id").repartition("import_row_id").groupBy("batch_id", "import_row_id").agg(F.count(one).alias("_copies"))
    joined = origin.join(copies, "import_row_id", "left")
    met = F.col("_copies").isNotNull()
    misaligned = (F.col("_row_batch") != F.col("batch_id")) | (status != "READY")
    sides = joined.groupBy(F.when(met, F.col("batch_id")).otherwise(F.col("_row_batch")).alias("batch_id")).agg(
        F.sum("_copies").alias("candidate_rows"),
        F.count_if(met).alias("candidate_unique"),
        F.coalesce(F.sum(F.col("_copies") * F.col("actual_qty")), F.lit(0)).cast(_QTY).alias("candidate_sum"),
        F.coalesce(F.sum(F.when(misaligned, F.col("_copies"))), F.lit(0)).alias("misaligned"),
        F.count_if(~met & (status == "READY")).alias("without_candidate"),
    )
    joined = batches.join(row_side, "batch_id", "left").join(sides, "batch_id", "left")

    def got(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast(_QTY)

    zero = F.lit(0).cast(_QTY)
    checks = {
        "raw_count": (got("raw_rows"), got("total_rows")),
        "row_sum": (got("ready") + got("skipped"), got("raw_rows")),
        "pending": (got("pending"), zero),
        "ready_count": (got("ready"), got("ready_rows")),
        "skipped_count": (got("skipped"), got("skipped_rows")),
        "candidate_count": (got("candidate_rows"), got("ready_rows")),
        "candidate_unique_rows": (got("candidate_unique"), got("candidate_rows")),
        "ready_without_candidate": (got("without_candidate"), zero),
        "misaligned_candidate": (got("misaligned"), zero),
        "ready_qty": (got("ready_sum"), got("ready_qty")),
        "candidate_qty": (got("candidate_sum"), got("ready_qty")),
        "skipped_qty": (got("skipped_sum"), got("skipped_qty")),
        "raw_qty": (got("raw_qty"), got("total_qty")),
    }
    entries = [
        F.struct(F.lit(label).alias("label"), actual.cast(_QTY).alias("actual"), expected.alias("expected"))
        for label, (actual, expected) in checks.items()
    ]
    return joined.select("batch_id", *SCOPE, F.inline(F.array(*entries))).filter(F.col("actual") != F.col("expected"))


def month_fact_stats(fact: DataFrame) -> DataFrame:
    return fact.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("fact_rows"), _sum("actual_qty").alias("fact_qty"))


def publish_gate(
    batches: DataFrame, rows: DataFrame, candidates: DataFrame, fact: DataFrame, threshold: str = DEFAULT_DROP_THRESHOLD
) -> DataFrame:
    """What publishing each batch would do.

    READY, REQUIRES_CONFIRMATION or BLOCKED, with the codes that decide it. A
    batch that already is the month's snapshot is an idempotent no-op; a
    replaced one is superseded.
    """
    limit = F.lit(threshold).cast("decimal(12,6)")
    broken = preview_integrity(batches, rows, candidates).select("batch_id").distinct().withColumn("_broken", F.lit(True))
    current = (
        batches.filter(is_current())
        .groupBy(*SCOPE)
        .agg(
            F.count(F.lit(1)).alias("_currents"),
            F.min_by(F.struct("batch_id", "data_date_end", "ready_rows", "ready_qty"), "batch_id").alias("_c"),
        )
    )
    view = batches.join(broken, "batch_id", "left").join(current, list(SCOPE), "left").join(month_fact_stats(fact), list(SCOPE), "left")
    view = view.withColumns({"fact_rows": F.coalesce("fact_rows", F.lit(0)), "fact_qty": F.coalesce("fact_qty", F.lit(0)).cast(_QTY)})

    published = F.col("status") == "PUBLISHED"
    superseded = published & F.col("replaced_at").isNotNull()
    idempotent = published & F.col("replaced_at").isNull()
    open_batch = F.col("status") == "PREVIEW_READY"
    other = open_batch & F.col("_c").isNotNull() & (F.col("_c.batch_id") != F.col("batch_id"))
    ends_known = F.col("_c.data_date_end").isNotNull() & F.col("data_date_end").isNotNull()
    regressed = ends_known & (F.col("data_date_end") < F.col("_c.data_date_end"))
    comparable = other & ends_known & ~regressed
    sound_current = (F.col("fact_rows") == F.col("_c.ready_rows")) & (F.col("fact_qty") == F.col("_c.ready_qty"))
    sound_self = (F.col("fact_rows") == F.col("ready_rows")) & (F.col("fact_qty") == F.col("ready_qty"))
    compared = comparable & sound_current
    ratio = F.when(
        compared,
        F.when(F.col("fact_qty") > 0, (F.col("fact_qty") - F.col("ready_qty")) / F.col("fact_qty")).otherwise(0),
    )
    drop = F.coalesce(ratio >= limit, F.lit(False))

    def codes(*pairs: tuple[Column, str]) -> Column:
        return F.filter(F.array(*[F.when(test, F.lit(code)) for test, code in pairs]), lambda c: c.isNotNull())

    blocking = codes(
        (superseded, "BATCH_SUPERSEDED"),
        (idempotent & ~sound_self, "CURRENT_MONTH_FACT_INTEGRITY_ERROR"),
        (~published & ~open_batch, "BATCH_NOT_PREVIEW_READY"),
        (open_batch & F.coalesce("_broken", F.lit(False)), "PREVIEW_INTEGRITY_INVALID"),
        (open_batch & (F.col("_currents") > 1), "CURRENT_BATCH_AMBIGUOUS"),
        (other & ~ends_known, "DATA_COVERAGE_UNAVAILABLE"),
        (other & regressed, "DATA_COVERAGE_REGRESSION"),
        (comparable & ~sound_current, "CURRENT_MONTH_FACT_INTEGRITY_ERROR"),
    )
    gated = view.select(
        "batch_id",
        *SCOPE,
        F.col("status").alias("batch_status"),
        blocking.alias("blocking"),
        codes((drop, DROP_CONFIRMATION)).alias("required_confirmations"),
        codes((compared & (F.col("ready_qty") < F.col("fact_qty")), "CUMULATIVE_QTY_DECLINE")).alias("warnings"),
        ratio.cast("decimal(12,6)").alias("drop_ratio"),
        F.coalesce(idempotent, F.lit(False)).alias("idempotent_current"),
        F.when(idempotent, F.col("batch_id")).when(compared | superseded, F.col("_c.batch_id")).alias("current_batch_id"),
        F.when(compared, F.col("_c.data_date_end")).alias("current_data_end_date"),
        F.when(compared, F.col("fact_qty")).alias("current_fact_qty"),
    )
    status = (
        F.when(F.size("blocking") > 0, BLOCKED)
        .when(F.size("required_confirmations") > 0, REQUIRES_CONFIRMATION)
        .otherwise(READY)
    )
    return gated.withColumn("gate_status", status)


def confirmation_verdict(gate: DataFrame, given: DataFrame) -> DataFrame:
    """PUBLISH, NO_OP, BLOCKED, CONFIRMATION_REQUIRED or CONFIRMATION_MISMATCH.

    The codes given for a batch must be exactly the required ones.
    """
    codes = given.groupBy("batch_id").agg(F.array_sort(F.collect_set("confirmation_code")).alias("_given"))
    joined = gate.join(codes, "batch_id", "left").withColumn("_given", F.coalesce("_given", F.array().cast("array<string>")))
    same = (F.size(F.array_except("_given", "required_confirmations")) == 0) & (
        F.size(F.array_except("required_confirmations", "_given")) == 0
    )
    verdict = (
        F.when(F.col("gate_status") == BLOCKED, "BLOCKED")
        .when(F.col("idempotent_current"), "NO_OP")
        .when((F.col("gate_status") == REQUIRES_CONFIRMATION) & ~same, "CONFIRMATION_REQUIRED")
        .when(~same, "CONFIRMATION_MISMATCH")
        .otherwise("PUBLISH")
    )
    return joined.withColumn("verdict", verdict).drop("_given")


def build_fact(rows: DataFrame, candidates: DataFrame, batches: DataFrame) -> DataFrame:
    """Fact rows of the given batches, tagged with their batch.

    Candidates of other batches go before the rows are looked up. Of the fact's
    columns, those come that the rows carry.
    """
    source = rows.select("import_row_id", *[c for c in ("source_document_no", "source_line_no", "sales_date", "actual_qty") if c in rows.columns])
    scope = batches.select("batch_id", *SCOPE)
    found = candidates.join(scope, "batch_id").join(source, "import_row_id")
    return found.select(F.col("batch_id").alias("import_batch_id"), *[c for c in FACT_COLUMNS if c in found.columns])


def replace_months(fact: DataFrame, new_fact: DataFrame, published: DataFrame) -> DataFrame:
    """Facts after publishing: whole months of ``published`` give way to the new rows."""
    kept = fact.join(published.select(*SCOPE).distinct(), list(SCOPE), "left_anti")
    fresh = new_fact.join(published.select(F.col("batch_id").alias("import_batch_id")), "import_batch_id", "left_semi")
    return kept.unionByName(fresh)


def inserted_mismatch(new_fact: DataFrame, batches: DataFrame) -> DataFrame:
    """Batches whose fact row count is not their ready row count."""
    counts = new_fact.groupBy(F.col("import_batch_id").alias("batch_id")).agg(F.count(F.lit(1)).alias("inserted_rows"))
    joined = batches.select("batch_id", "ready_rows").join(counts, "batch_id", "left")
    return joined.withColumn("inserted_rows", F.coalesce("inserted_rows", F.lit(0))).filter(F.col("inserted_rows") != F.col("ready_rows"))


def apply_lineage(batches: DataFrame, published: DataFrame, now: Column) -> DataFrame:
    """Batches after publishing: new ones PUBLISHED, the month's former one replaced."""
    winner = published.select(*SCOPE, F.col("batch_id").alias("_new"))
    joined = batches.join(winner, list(SCOPE), "left")
    is_new = F.coalesce(F.col("_new") == F.col("batch_id"), F.lit(False))
    replaced = is_current() & F.col("_new").isNotNull() & ~is_new
    # A batch is published once: publishing the current one again changes nothing.
    fresh = is_new & (F.col("status") != "PUBLISHED")
    return joined.withColumns(
        {
            "replaced_at": F.when(replaced, now).otherwise(F.col("replaced_at")),
            "replaced_by_batch_id": F.when(replaced, F.col("_new")).otherwise(F.col("replaced_by_batch_id")),
            "published_at": F.when(fresh, now).otherwise(F.col("published_at")),
            "status": F.when(fresh, "PUBLISHED").otherwise(F.col("status")),
        }
    ).select(*batches.columns)


def confirmation_rows(gate: DataFrame, published: DataFrame, user: str, now: Column) -> DataFrame:
    """Confirmations recorded with a successful publish."""
    return (
        gate.join(published.select("batch_id"), "batch_id", "left_semi")
        .select(
            "batch_id",
            F.explode("required_confirmations").alias("confirmation_code"),
            F.col("current_batch_id").alias("existing_published_batch_id"),
            F.col("current_data_end_date").alias("existing_data_end_date"),
            F.col("current_fact_qty").alias("existing_ready_qty"),
            "drop_ratio",
            F.lit(user).alias("confirmed_by"),
            now.alias("created_at"),
        )
    )
