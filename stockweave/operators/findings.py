"""Findings: what is wrong with a row, as data.

A rule is a Column giving a finding struct or NULL; a row's ``findings`` is the
array of those that apply. Candidate rows of a duplicate group are *not* copied
into each finding (a group of n rows would then hold n x n entries): a finding
carries the group's key and size, and the candidates stay rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = (
    "struct<code:string,severity:string,field:string,row_number:bigint,"
    "candidate_key:string,candidate_count:bigint,resolved:boolean,details:map<string,string>>"
)
FINDINGS = f"array<{FINDING}>"


def finding(
    when: Column,
    code: str | Column,
    severity: str | Column = "ERROR",
    field: str | None = None,
    row_number: str = "row_number",
    candidate_key: Column | None = None,
    candidate_count: Column | None = None,
    resolved: bool = False,
    details: Column | None = None,
) -> Column:
    """Finding struct where ``when`` is true, else NULL."""
    text = F.lit(None).cast("string")
    value = F.struct(
        (F.lit(code) if isinstance(code, str) else code).alias("code"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        F.lit(field).cast("string").alias("field"),
        F.col(row_number).cast("bigint").alias("row_number"),
        (text if candidate_key is None else candidate_key.cast("string")).alias("candidate_key"),
        (F.lit(None) if candidate_count is None else candidate_count).cast("bigint").alias("candidate_count"),
        F.lit(resolved).alias("resolved"),
        (F.lit(None) if details is None else details).cast("map<string,string>").alias("details"),
    )
    return F.when(F.coalesce(when, F.lit(False)), value)


def collect(rules: Iterable[Column]) -> Column:
    return F.filter(F.array(*rules), lambda item: item.isNotNull())


def no_findings() -> Column:
    return F.array().cast(FINDINGS)


def with_findings(rows: DataFrame, rules: Iterable[Column]) -> DataFrame:
    """Appends the rules that apply to the row's ``findings``."""
    fresh = collect(list(rules))
    if "findings" in rows.columns:
        fresh = F.concat("findings", fresh)
    return rows.withColumn("findings", fresh)


def has_severity(severity: str) -> Column:
    return F.exists("findings", lambda item: item["severity"] == severity)


def has_code(code: str) -> Column:
    return F.exists("findings", lambda item: item["code"] == code)


def finding_rows(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per finding.

    An inner explode would be preceded by a filter on the array's size, and with
    it by a second evaluation of every rule; a filter on what comes out is not.
    """
    return rows.select(*keep, F.explode_outer("findings").alias("finding")).filter(F.col("finding").isNotNull()).select(*keep, "finding.*")


def finding_counts(rows: DataFrame, *by: str) -> DataFrame:
    """Findings per code, field and severity."""
    return (
        finding_rows(rows, *by)
        .groupBy(*by, "code", "field", "severity")
        .agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("row_number").alias("affected_rows"))
    )


def issue_index(rows: DataFrame, *by: str) -> DataFrame:
    """Code with every distinct row number it applies to, one row each.

    The row numbers of a code are unbounded, so the index is a table ordered by
    (code, row number), not an array per code.
    """
    return finding_rows(rows, *by).select(*by, "code", "row_number").distinct()


def finalize(rows: DataFrame, excluded: Column | None = None) -> DataFrame:
    """Row outcome from its findings and its proposed action.

    Excluded rows are SKIPPED; then ERROR, EXISTING, WARNING, VALID in this
    order. Only a NEW or UPDATE row without error would be written.
    """
    skip = F.lit(False) if excluded is None else F.coalesce(excluded, F.lit(False))
    error = has_severity("ERROR")
    status = (
        F.when(skip, "SKIPPED")
        .when(error, "ERROR")
        .when(F.col("action") == "EXISTING", "EXISTING")
        .when(has_severity("WARNING"), "WARNING")
        .otherwise("VALID")
    )
    action = F.when(skip, "UNIMPORTABLE").when(error & (F.col("action") != "CONFLICT"), "UNIMPORTABLE").otherwise(F.col("action"))
    return (
        rows.withColumn("status", status)
        .withColumn("action", action)
        .withColumn("would_write", ~F.col("status").isin("SKIPPED", "ERROR") & F.col("action").isin("NEW", "UPDATE"))
    )


def import_counts(rows: DataFrame, *by: str) -> DataFrame:
    """Row counters of a batch, its commit eligibility and status."""
    status = F.col("status")
    counts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(status.isin("VALID", "READY")).alias("ready_rows"),
        F.count_if(status == "WARNING").alias("warning_rows"),
        F.count_if(status == "ERROR").alias("error_rows"),
        F.count_if(status == "EXISTING").alias("existing_rows"),
    )
    eligible = (F.col("error_rows") == 0) & (F.col("warning_rows") == 0)
    return (
        counts.withColumn("create_rows", F.col("total_rows") - F.col("error_rows") - F.col("existing_rows"))
        .withColumn("commit_eligible", eligible)
        .withColumn("batch_status", F.when(eligible, "READY_TO_COMMIT").otherwise("REVIEW"))
    )


def preview_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Rows per action, per status and per worst severity, and the commit flag."""
    actions = ("NEW", "UPDATE", "UNCHANGED", "EXISTING", "CONFLICT", "UNIMPORTABLE")
    statuses = ("VALID", "WARNING", "ERROR", "SKIPPED", "EXISTING")
    return (
        rows.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("total_rows"),
            *[F.count_if(F.col("action") == a).alias(f"action_{a.lower()}") for a in actions],
            *[F.count_if(F.col("status") == s).alias(f"status_{s.lower()}") for s in statuses],
            *[F.count_if(has_severity(s)).alias(f"rows_with_{s.lower()}") for s in ("ERROR", "WARNING", "INFO")],
            F.count_if("would_write").alias("would_write_rows"),
        )
        .withColumn("commit_allowed", (F.col("rows_with_error") == 0) & (F.col("would_write_rows") > 0))
    )


def keep_matching(rows: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Rows whose status, action or any finding severity is wanted."""
    values = [value.upper() for value in wanted]
    allowed = {"ERROR", "WARNING", "NEW", "UPDATE", "CONFLICT", "EXISTING"}
    if not set(values) <= allowed:
        raise ValueError(f"unsupported preview filters: {sorted(set(values) - allowed)}")
    return rows.filter(
        F.col("status").isin(values)
        | F.col("action").isin(values)
        | F.exists("findings", lambda item: item["severity"].isin(values))
    )


def raise_severity(rows: DataFrame, code: str, severity: str) -> DataFrame:
    """Findings of ``code`` get another severity."""
    return rows.withColumn(
        "findings",
        F.transform("findings", lambda item: F.when(item["code"] == code, item.withField("severity", F.lit(severity))).otherwise(item)),
    )


# How each import kind treats a finding code. BLOCK needs a new
# file, EXISTING ends the row, DECIDE waits for an acknowledgement.
_BLOCK_COMMON = (
    "MDM_IMPORT_REQUIRED_FIELD_MISSING",
    "MDM_IMPORT_VALUE_INVALID",
    "MDM_IMPORT_CODE_NOT_STRING_SAFE",
)
CATALOGUES: dict[str, dict[str, tuple[str, ...]]] = {
    "CUSTOMER": {
        "BLOCK": _BLOCK_COMMON
        + (
            "MDM_IMPORT_DUPLICATE_EXACT",
            "MDM_IMPORT_REFERENCE_UNRESOLVED",
            "MDM_IMPORT_INACTIVE_REFERENCE",
            "MDM_IMPORT_PARENT_CYCLE",
            "MDM_IMPORT_CUSTOMER_CODE_CONFLICT",
        ),
        "DECIDE": ("MDM_IMPORT_CUSTOMER_NAME_CONFLICT", "MDM_IMPORT_PARENT_UNRESOLVED"),
        "EXISTING": ("MDM_IMPORT_CUSTOMER_EXISTING",),
        "INFO": ("MDM_IMPORT_FIELD_MISSING_NONCRITICAL",),
        "FILE": ("MDM_IMPORT_FILE_INVALID", "MDM_IMPORT_SHEET_INVALID"),
    },
    "PRODUCT": {
        "BLOCK": _BLOCK_COMMON + ("MDM_IMPORT_DUPLICATE_UNIQUE_CODE", "MDM_IMPORT_PRODUCT_CODE_CONFLICT"),
        "DECIDE": ("MDM_IMPORT_PRODUCT_NAME_CONFLICT",),
        "EXISTING": ("MDM_IMPORT_PRODUCT_EXISTING",),
        "FILE": ("MDM_IMPORT_FILE_INVALID", "MDM_IMPORT_SHEET_INVALID"),
    },
    "SKU": {
        "BLOCK": _BLOCK_COMMON
        + (
            "MDM_IMPORT_DATE_INVALID",
            "MDM_IMPORT_DUPLICATE_UNIQUE_CODE",
            "MDM_IMPORT_SKU_CODE_CONFLICT",
            "MDM_IMPORT_SKU_PRODUCT_CONFLICT",
            "MDM_IMPORT_REFERENCE_UNRESOLVED",
            "MDM_IMPORT_INACTIVE_REFERENCE",
        ),
        "EXISTING": ("MDM_IMPORT_SKU_EXISTING",),
        "FILE": ("MDM_IMPORT_FILE_INVALID", "MDM_IMPORT_SHEET_INVALID"),
    },
    "PRODUCT_SKU": {
        "BLOCK": _BLOCK_COMMON
        + (
            "MDM_IMPORT_DATE_INVALID",
            "MDM_IMPORT_DUPLICATE_UNIQUE_CODE",
            "MDM_IMPORT_SKU_CODE_CONFLICT",
            "MDM_IMPORT_SKU_PRODUCT_CONFLICT",
            "MDM_IMPORT_PRODUCT_ATTR_CONFLICT",
            "MDM_IMPORT_PRODUCT_NAME_REQUIRED",
            "MDM_IMPORT_REFERENCE_UNRESOLVED",
            "MDM_IMPORT_INACTIVE_REFERENCE",
        ),
        "EXISTING": ("MDM_IMPORT_SKU_EXISTING",),
        "INFO": ("MDM_IMPORT_SKU_NAME_FORMAT_DIFFERENCE", "MDM_IMPORT_SOURCE_DATE_LABEL"),
        "FILE": ("MDM_IMPORT_FILE_INVALID", "MDM_IMPORT_SHEET_INVALID"),
    },
}
ACKNOWLEDGE = "ACKNOWLEDGE"


def codes_in(kind: str, category: str) -> tuple[str, ...]:
    return CATALOGUES[kind].get(category, ())


def finding_category(code: Column, kind: str) -> Column:
    """Category of a finding code; an unknown code blocks."""
    label = F.lit("BLOCK")
    for category, codes in CATALOGUES[kind].items():
        label = F.when(code.isin(*codes), category).otherwise(label)
    return label


def allowed_decision(code: Column, kind: str) -> Column:
    return F.when(finding_category(code, kind) == "DECIDE", ACKNOWLEDGE)


def contract_status(kind: str) -> Column:
    """ERROR, EXISTING, WARNING or READY of a row: its strictest category wins; a finding about the file is an error of each row."""

    def any_in(category: str) -> Column:
        return F.exists("findings", lambda item: finding_category(item["code"], kind) == category)

    return (
        F.when(any_in("BLOCK") | any_in("FILE"), "ERROR").when(any_in("EXISTING"), "EXISTING").when(any_in("DECIDE"), "WARNING").otherwise("READY")
    )
