"""Publishing monthly snapshots, and reads bound to the current one.

Every month has three batches: S (first 10 days, already replaced), C (first 20
days, current) and N (new), which by month is the whole month, too short, only
its last days, or carries wrong counters.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.operators import dashboard, publishing
from stockweave.plans.registry import query
from stockweave.plans.sales_queries import mapped_rows
from stockweave.plans.standins import SOURCE_SYSTEM, oracle
from stockweave.sources.staging import Steps, stage
from stockweave.sources.registry import accepted_files, gate_duplicates, raw_payload, restage_outcome

QTY = "DECIMAL(28,4)"


def batch_rows(mapped):
    """Rows of all three batches, as the preview step would have stored them."""
    day, month = F.dayofmonth("sales_date"), F.month("sales_date")
    new = F.when(month % 4 == 1, day <= 15).when(month % 4 == 2, day >= 28).otherwise(F.lit(True))
    kinds = F.array(
        *[
            F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("n")))
            for kind, n, test in (("S", 0, day <= 10), ("C", 1, day <= 20), ("N", 2, new))
        ]
    )
    tagged = mapped.select("*", F.inline(F.filter(kinds, lambda k: k.isNotNull())))
    return (
        tagged.withColumn("batch_id", F.concat("kind", F.lit("-"), F.date_format("snapshot_month", "yyyyMM")))
        .withColumn("import_row_id", F.col("source_row_no") * 4 + F.col("n"))
        .withColumn("source_system", F.lit(SOURCE_SYSTEM))
    )


#: What batches, gate and confirmations read of a row.
GATE_COLUMNS = ("import_row_id", "batch_id", "kind", "source_system", "snapshot_month", "sales_date", "actual_qty", "status")


def stored_rows(spark, sf_dir, columns=(*publishing.FACT_COLUMNS, "batch_id", "kind", "status")):
    """The mapped rows, of which ``columns`` are stored: those that a query goes on to read.
    A row is stored once, however many batches hold it."""
    made = ("import_row_id", "batch_id", "kind", "source_system")
    stored = dict.fromkeys(["source_row_no", "snapshot_month", "sales_date", *[c for c in columns if c not in made]])
    return batch_rows(mapped_rows(spark, sf_dir, list(stored), Steps())).select(*columns)


def batches(rows):
    ready, qty = F.col("status") == "READY", F.col("actual_qty")

    def total(when=None):
        value = qty if when is None else F.when(when, qty)
        return F.coalesce(F.sum(value), F.lit(0)).cast("decimal(28,4)")

    counted = (
        rows
        .groupBy("batch_id", "source_system", "snapshot_month", "kind")
        .agg(
            F.count(F.lit(1)).alias("total_rows"),
            F.count_if(ready).alias("_ready"),
            F.count_if(~ready).alias("skipped_rows"),
            total().alias("total_qty"),
            total(ready).alias("ready_qty"),
            total(~ready).alias("skipped_qty"),
            F.min("sales_date").alias("data_date_start"),
            F.max("sales_date").alias("data_date_end"),
        )
    )
    new, month = F.col("kind") == "N", F.month("snapshot_month")
    day = F.lit("2002-01-01").cast("date")
    return counted.select(
        "batch_id",
        "source_system",
        "snapshot_month",
        F.when(~new, "PUBLISHED").when(month == 5, "VALIDATED").otherwise("PREVIEW_READY").alias("status"),
        "total_rows",
        (F.col("_ready") + F.when(new & (month % 4 == 3), 1).otherwise(0)).alias("ready_rows"),
        "skipped_rows",
        "total_qty",
        "ready_qty",
        "skipped_qty",
        "data_date_start",
        "data_date_end",
        F.when(~new, day).alias("published_at"),
        F.when(F.col("kind") == "S", day).alias("replaced_at"),
        F.when(F.col("kind") == "S", F.concat(F.lit("C"), F.substring("batch_id", 2, 10))).alias("replaced_by_batch_id"),
    )


def candidates(rows):
    return rows.filter(F.col("status") == "READY").drop("source_row_no", "sales_date", "actual_qty", "source_document_no", "source_line_no", "source_system", "snapshot_month", "status")


def current_fact(rows):
    current = rows.filter((F.col("kind") == "C") & (F.col("status") == "READY"))
    return current.select(F.col("batch_id").alias("import_batch_id"), *[c for c in publishing.FACT_COLUMNS if c in rows.columns])


_TAGGED = """tag AS (
  SELECT m.*, kind, kind || '-' || strftime(snapshot_month, '%Y%m') AS batch_id, source_row_no * 4 + n AS import_row_id
  FROM mapped m, (VALUES ('S', 0), ('C', 1), ('N', 2)) v(kind, n)
  WHERE CASE kind WHEN 'S' THEN day(sales_date) <= 10 WHEN 'C' THEN day(sales_date) <= 20 ELSE
    CASE month(sales_date) % 4 WHEN 1 THEN day(sales_date) <= 15 WHEN 2 THEN day(sales_date) >= 28 ELSE true END END)"""
_BATCHES = f"""bat AS (
  SELECT batch_id, kind, snapshot_month, CASE WHEN kind <> 'N' THEN 'PUBLISHED' WHEN month(snapshot_month) = 5 THEN 'VALIDATED' ELSE 'PREVIEW_READY' END AS status,
    count(*) AS total_rows, count(*) FILTER (status = 'READY') AS true_ready,
    count(*) FILTER (status = 'READY') + CASE WHEN kind = 'N' AND month(snapshot_month) % 4 = 3 THEN 1 ELSE 0 END AS ready_rows,
    CAST(coalesce(sum(actual_qty) FILTER (status = 'READY'), 0) AS {QTY}) AS ready_qty, max(sales_date) AS data_date_end
  FROM tag GROUP BY 1, 2, 3)"""
_GATE = f"""gate AS (
  SELECT *, CASE WHEN blocking <> '' THEN 'BLOCKED' WHEN required_confirmations <> '' THEN 'REQUIRES_CONFIRMATION' ELSE 'READY' END AS gate_status FROM (
  SELECT batch_id, snapshot_month, batch_status,
    concat_ws(',', CASE WHEN kind = 'S' THEN 'BATCH_SUPERSEDED' END, CASE WHEN batch_status = 'VALIDATED' THEN 'BATCH_NOT_PREVIEW_READY' END,
      CASE WHEN batch_status = 'PREVIEW_READY' AND ready_rows <> true_ready THEN 'PREVIEW_INTEGRITY_INVALID' END,
      CASE WHEN batch_status = 'PREVIEW_READY' AND data_date_end < c_end THEN 'DATA_COVERAGE_REGRESSION' END) AS blocking,
    CASE WHEN compared AND c_qty > 0 AND (c_qty - ready_qty) / c_qty >= 0.8 THEN 'ABNORMAL_DROP_THRESHOLD' ELSE '' END AS required_confirmations,
    CASE WHEN compared AND ready_qty < c_qty THEN 'CUMULATIVE_QTY_DECLINE' ELSE '' END AS warnings,
    CAST(CASE WHEN compared THEN CASE WHEN c_qty > 0 THEN (c_qty - ready_qty) / c_qty ELSE 0 END END AS DECIMAL(12,6)) AS drop_ratio,
    kind = 'C' AS idempotent_current, CASE WHEN kind = 'C' THEN batch_id WHEN kind = 'S' OR compared THEN c_id END AS current_batch_id
  FROM (SELECT b.*, b.status AS batch_status, c.batch_id AS c_id, c.data_date_end AS c_end, c.ready_qty AS c_qty,
      coalesce(b.status = 'PREVIEW_READY' AND c.batch_id IS NOT NULL AND b.data_date_end >= c.data_date_end, false) AS compared
    FROM bat b LEFT JOIN bat c ON c.kind = 'C' AND c.snapshot_month = b.snapshot_month)))"""


def gate(rows):
    return publishing.publish_gate(batches(rows), rows, rows.filter(F.col("status") == "READY").select("import_row_id", "batch_id"), current_fact(rows))


@query(
    "preview_integrity",
    oracle(
        f"""SELECT batch_id, 'ERP' AS source_system, snapshot_month, label, CAST(true_ready AS {QTY}) AS actual, CAST(ready_rows AS {QTY}) AS expected
FROM bat, (VALUES ('ready_count'), ('candidate_count')) v(label) WHERE true_ready <> ready_rows""",
        _TAGGED, _BATCHES,
    ),
)
def preview_integrity(spark, sf_dir):
    rows = stored_rows(spark, sf_dir, GATE_COLUMNS)
    ready = rows.filter(F.col("status") == "READY").select("import_row_id", "batch_id")
    return publishing.preview_integrity(batches(rows), rows, ready)


@query("month_replace_gate", oracle("SELECT * FROM gate", _TAGGED, _BATCHES, _GATE))
def month_replace_gate(spark, sf_dir):
    rows = stored_rows(spark, sf_dir, GATE_COLUMNS)
    shown = gate(rows).drop("source_system", "current_data_end_date", "current_fact_qty")
    return shown.withColumns({c: F.array_join(c, ",") for c in ("blocking", "required_confirmations", "warnings")})


_VERDICTS = """SELECT batch_id, CASE WHEN gate_status = 'BLOCKED' THEN 'BLOCKED' WHEN idempotent_current THEN 'NO_OP'
  WHEN gate_status = 'REQUIRES_CONFIRMATION' AND NOT given THEN 'CONFIRMATION_REQUIRED'
  WHEN given <> (gate_status = 'REQUIRES_CONFIRMATION') THEN 'CONFIRMATION_MISMATCH' ELSE 'PUBLISH' END AS verdict
FROM (SELECT *, month(snapshot_month) IN (2, 6, 12) AS given FROM gate)"""


@query("publish_verdict", oracle(_VERDICTS, _TAGGED, _BATCHES, _GATE))
def publish_verdict(spark, sf_dir):
    rows = stored_rows(spark, sf_dir, GATE_COLUMNS)
    return verdicts(rows).select("batch_id", "verdict")


def verdicts(rows):
    view = gate(rows)
    given = batches(rows).filter(F.month("snapshot_month").isin(2, 6, 12)).select("batch_id", F.lit(publishing.DROP_CONFIRMATION).alias("confirmation_code"))
    return publishing.confirmation_verdict(view, given)


_PUBLISHED = f"""pub AS (SELECT batch_id, snapshot_month FROM gate JOIN ({_VERDICTS}) USING (batch_id) WHERE verdict = 'PUBLISH')"""


def published(rows):
    """Batches that the gate and their confirmations clear."""
    cleared = verdicts(rows).filter(F.col("verdict") == "PUBLISH").select("batch_id")
    return batches(rows).join(cleared, "batch_id", "semi")


@query(
    "fact_build",
    oracle(
        "SELECT batch_id AS import_batch_id, import_row_id, source_document_no, source_line_no, snapshot_month, actual_qty, sku_id, product_id, customer_id "
        "FROM tag WHERE status = 'READY' AND batch_id IN (SELECT batch_id FROM pub)",
        _TAGGED, _BATCHES, _GATE, _PUBLISHED,
    ),
)
def fact_build(spark, sf_dir):
    rows = stored_rows(spark, sf_dir, (*GATE_COLUMNS, "source_document_no", "source_line_no", "sku_id", "product_id", "customer_id"))
    # Staged, the gate's shuffles are gone before rows move again, and its few batches go to where the rows are.
    chosen = stage(published(rows))
    # The gate passes no batch of which a candidate names a row of another one.
    own = rows.join(chosen.select("batch_id"), "batch_id", "semi")
    fact = publishing.build_fact(own, candidates(rows), chosen)
    return fact.select("import_batch_id", "import_row_id", "source_document_no", "source_line_no", "snapshot_month", "actual_qty", "sku_id", "product_id", "customer_id")


@query(
    "month_replace",
    oracle(
        f"""SELECT snapshot_month, batch_id AS import_batch_id, count(*) AS fact_rows, CAST(sum(actual_qty) AS {QTY}) AS fact_qty FROM tag
WHERE status = 'READY' AND (batch_id IN (SELECT batch_id FROM pub) OR kind = 'C' AND snapshot_month NOT IN (SELECT snapshot_month FROM pub)) GROUP BY 1, 2""",
        _TAGGED, _BATCHES, _GATE, _PUBLISHED,
    ),
)
def month_replace(spark, sf_dir):
    rows = stored_rows(spark, sf_dir, GATE_COLUMNS)
    chosen = published(rows)
    fresh = publishing.build_fact(rows, candidates(rows), chosen)
    wrong = publishing.inserted_mismatch(fresh, chosen).select("batch_id")  # a batch with a wrong row count is not published
    chosen = chosen.join(wrong, "batch_id", "anti")
    fresh = fresh.join(wrong, F.col("import_batch_id") == F.col("batch_id"), "anti")
    after = publishing.replace_months(current_fact(rows), fresh, chosen)
    return after.groupBy("snapshot_month", "import_batch_id").agg(F.count(F.lit(1)).alias("fact_rows"), F.sum("actual_qty").cast("decimal(28,4)").alias("fact_qty"))


@query(
    "batch_lineage",
    oracle(
        """SELECT batch_id, CASE WHEN batch_id IN (SELECT batch_id FROM pub) THEN 'PUBLISHED' ELSE status END AS status,
  CASE WHEN kind = 'S' THEN 'C' || substr(batch_id, 2) WHEN kind = 'C' AND snapshot_month IN (SELECT snapshot_month FROM pub)
    THEN 'N' || substr(batch_id, 2) END AS replaced_by_batch_id FROM bat""",
        _TAGGED, _BATCHES, _GATE, _PUBLISHED,
    ),
)
def batch_lineage(spark, sf_dir):
    rows = stored_rows(spark, sf_dir, GATE_COLUMNS)
    after = publishing.apply_lineage(batches(rows), published(rows), F.lit("2002-02-02").cast("date"))
    return after.select("batch_id", "status", "replaced_by_batch_id")


@query(
    "publish_confirmations",
    oracle(
        "SELECT batch_id, required_confirmations AS confirmation_code, current_batch_id AS existing_published_batch_id, drop_ratio "
        "FROM gate WHERE gate_status = 'REQUIRES_CONFIRMATION' AND batch_id IN (SELECT batch_id FROM pub)",
        _TAGGED, _BATCHES, _GATE, _PUBLISHED,
    ),
)
def publish_confirmations(spark, sf_dir):
    rows = stored_rows(spark, sf_dir, GATE_COLUMNS)
    view = gate(rows)
    accepted = view.filter(F.col("gate_status") == publishing.REQUIRES_CONFIRMATION).join(published(rows).select("batch_id"), "batch_id", "semi")
    recorded = publishing.confirmation_rows(view, accepted, "planner", F.current_timestamp())
    return recorded.select("batch_id", "confirmation_code", "existing_published_batch_id", "drop_ratio")


# --- current snapshots -----------------------------------------------------


@query(
    "current_batch",
    oracle(
        """SELECT 'ERP' AS source_system, snapshot_month, CASE WHEN month(snapshot_month) = 9 THEN 2 ELSE 1 END AS current_batches,
  CASE WHEN month(snapshot_month) <> 9 THEN batch_id END AS batch_id, CASE WHEN month(snapshot_month) = 9 THEN 'AMBIGUOUS' ELSE 'CURRENT' END AS state
FROM bat WHERE kind = 'C'""",
        _TAGGED, _BATCHES,
    ),
)
def current_batch(spark, sf_dir):
    rows = stored_rows(spark, sf_dir)
    return dashboard.current_batches(doubtful_batches(rows))


def doubtful_batches(rows):
    """Batches in which every September has two current ones."""
    frame = batches(rows)
    again = frame.filter((F.month("snapshot_month") == 9) & dashboard.is_current())
    return frame.unionByName(again.withColumn("batch_id", F.concat(F.lit("D"), F.substring("batch_id", 2, 10))))


@query(
    "requested_batch_check",
    oracle(
        """SELECT batch_id, 'ERP' AS source_system, snapshot_month, CASE WHEN month(snapshot_month) <> 9 AND has_current THEN 'C' || substr(batch_id, 2) END AS current_batch_id,
  CASE WHEN month(snapshot_month) = 9 AND has_current THEN 'AMBIGUOUS' WHEN kind = 'C' THEN 'CURRENT' ELSE 'CHANGED' END AS outcome
FROM (SELECT *, EXISTS (SELECT 1 FROM bat c WHERE c.kind = 'C' AND c.snapshot_month = bat.snapshot_month) AS has_current FROM bat)
UNION ALL SELECT 'X-' || strftime(snapshot_month, '%Y%m'), NULL, NULL, NULL, 'NOT_FOUND' FROM bat WHERE kind = 'C'""",
        _TAGGED, _BATCHES,
    ),
)
def requested_batch_check(spark, sf_dir):
    rows = stored_rows(spark, sf_dir)
    frame = batches(rows)
    unknown = frame.filter(dashboard.is_current()).select(F.concat(F.lit("X"), F.substring("batch_id", 2, 10)).alias("batch_id"))
    return dashboard.check_requested(frame.select("batch_id").unionByName(unknown), doubtful_batches(rows))


@query(
    "snapshot_integrity",
    oracle(
        """SELECT batch_id, 'ERP' AS source_system, snapshot_month, ready_rows, ready_qty, ready_rows AS month_rows, ready_qty AS month_qty,
  ready_rows AS bound_rows, ready_qty AS bound_qty, true AS sound FROM bat WHERE kind = 'C'""",
        _TAGGED, _BATCHES,
    ),
)
def snapshot_integrity(spark, sf_dir):
    rows = stored_rows(spark, sf_dir)
    fact = current_fact(rows).drop("import_batch_id")
    return dashboard.snapshot_integrity(fact, rows, batches(rows))


@query(
    "scoped_fact_summary",
    oracle(
        f"""SELECT 'ERP' AS source_system, snapshot_month, CAST(sum(actual_qty) AS {QTY}) AS mtd_qty, count(DISTINCT product_id) AS product_count,
  count(DISTINCT sku_id) AS sku_count FROM tag WHERE kind = 'C' AND status = 'READY' AND channel_id_snapshot IS NULL GROUP BY 2""",
        _TAGGED,
    ),
)
def scoped_fact_summary(spark, sf_dir):
    rows = stored_rows(spark, sf_dir)
    fact = current_fact(rows).drop("import_batch_id")
    bound = dashboard.bind_fact(fact, rows, batches(rows))
    return dashboard.summary(dashboard.apply_filters(bound, dashboard.Filters(channel_ids=(None,))))


@query(
    "available_months",
    oracle("SELECT batch_id, snapshot_month, ready_rows, ready_qty FROM bat WHERE kind = 'C' AND month(snapshot_month) <> 9", _TAGGED, _BATCHES),
)
def available_months(spark, sf_dir):
    rows = stored_rows(spark, sf_dir)
    return dashboard.available_months(doubtful_batches(rows)).select("batch_id", "snapshot_month", "ready_rows", "ready_qty")


@query(
    "latest_month",
    oracle(
        "SELECT 'ERP' AS source_system, max(snapshot_month) AS snapshot_month, max_by(batch_id, snapshot_month) AS batch_id "
        "FROM bat WHERE kind = 'C' AND month(snapshot_month) <> 9",
        _TAGGED, _BATCHES,
    ),
)
def latest_month(spark, sf_dir):
    rows = stored_rows(spark, sf_dir)
    return dashboard.latest_month(doubtful_batches(rows))


@query(
    "batch_listing",
    oracle(
        "SELECT batch_id, snapshot_month, status, total_rows FROM bat WHERE status = 'PREVIEW_READY' ORDER BY snapshot_month DESC, batch_id LIMIT 20",
        _TAGGED, _BATCHES,
    ),
)
def batch_listing(spark, sf_dir):
    rows = stored_rows(spark, sf_dir)
    listed = batches(rows).filter(F.col("status") == "PREVIEW_READY").select("batch_id", "snapshot_month", "status", "total_rows")
    return dashboard.page(listed, [F.col("snapshot_month").desc(), F.col("batch_id").asc()], 1, 20)


# --- deliveries ------------------------------------------------------------


@query(
    "duplicate_file_gate",
    oracle(
        """SELECT batch_id, CASE WHEN kind = 'N' AND month(snapshot_month) % 3 = 0 THEN 'OLD-' || batch_id END AS duplicate_of,
  NOT (kind = 'N' AND month(snapshot_month) % 3 = 0) AS accepted FROM bat""",
        _TAGGED, _BATCHES,
    ),
)
def duplicate_file_gate(spark, sf_dir):
    rows = stored_rows(spark, sf_dir)
    hashed = batches(rows).withColumn("file_hash", F.sha2("batch_id", 256)).select("batch_id", "file_hash", "snapshot_month")
    old = hashed.filter(F.col("batch_id").startswith("N") & (F.month("snapshot_month") % 3 == 0)).withColumn("batch_id", F.concat(F.lit("OLD-"), "batch_id"))
    return gate_duplicates(hashed, old, ["file_hash"]).select("batch_id", "duplicate_of", "accepted")


@query(
    "accepted_deliveries",
    oracle("SELECT batch_id FROM bat WHERE NOT (kind = 'N' AND month(snapshot_month) % 3 = 0)", _TAGGED, _BATCHES),
)
def accepted_deliveries(spark, sf_dir):
    rows = stored_rows(spark, sf_dir)
    hashed = batches(rows).withColumn("file_hash", F.sha2("batch_id", 256)).select("batch_id", "file_hash", "snapshot_month")
    old = hashed.filter(F.col("batch_id").startswith("N") & (F.month("snapshot_month") % 3 == 0))
    return accepted_files(hashed, old, ["file_hash"]).select("batch_id")


@query(
    "restage_outcome",
    oracle(
        """SELECT batch_id, CASE WHEN kind = 'S' THEN 'NEW' WHEN kind = 'C' THEN 'RETURN_STORED' ELSE 'REJECTED' END AS outcome FROM bat""",
        _TAGGED, _BATCHES,
    ),
)
def restage(spark, sf_dir):
    rows = stored_rows(spark, sf_dir, GATE_COLUMNS)
    staged = batches(rows).select("batch_id", F.lit("CUSTOMER").alias("entity_type"), F.lit("OPERATIONAL").alias("import_mode"), F.sha2("batch_id", 256).alias("file_hash"))
    stored = staged.filter(~F.col("batch_id").startswith("S")).withColumn("file_hash", F.when(F.col("batch_id").startswith("N"), F.lit("0")).otherwise(F.col("file_hash")))
    return restage_outcome(staged, stored).select("batch_id", "outcome")


@query(
    "raw_payload",
    oracle(
        """SELECT source_row_no, '{"source_document_no":"' || source_document_no || '","sales_date":"' || sales_date || '","actual_qty":"' || actual_qty || '"}' AS payload FROM sales"""
    ),
)
def raw_payload_query(spark, sf_dir):
    from stockweave.plans.standins import sales_rows

    rows = sales_rows(spark, sf_dir)
    return rows.select("source_row_no", raw_payload(rows, ["source_document_no", "sales_date", "actual_qty"]).alias("payload"))
