"""Master queries and batch maintenance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.functions.text import blank_to_null, collated
from stockweave.operators.groups import attach_group, page

# Fields searched per master, and SKU fields offered as filters.
SEARCH_FIELDS = {
    "customer": ("customer_name", "customer_code", "customer_stable_id"),
    "sku": ("sku_name", "sku_code", "sku_stable_id", "short_name"),
    "product": ("product_code", "product_name", "product_stable_id"),
    "channel": ("channel_name", "channel_code", "channel_stable_id"),
    "salesrep": ("salesrep_name", "salesrep_code", "salesrep_stable_id"),
    "region": ("region_name", "region_code", "region_stable_id"),
    "province": ("province_name", "province_code", "province_stable_id"),
}
SKU_SIGNIFICANT_FIELDS = ("category_l3", "category_l4", "case_pack")


def matches(columns: Sequence[str], text: str, anywhere: bool) -> Column:
    """Any column starts with the text, or holds it anywhere, under the collation."""
    found = F.lit(False)
    for name in columns:
        value = collated(name)
        hit = F.contains(value, collated(F.lit(text))) if anywhere else F.startswith(value, collated(F.lit(text)))
        found = found | F.coalesce(hit, F.lit(False))
    return found


def search(master: DataFrame, kind: str, text: str) -> DataFrame:
    """Prefix search; SKUs and products are searched anywhere in the text."""
    columns = [c for c in SEARCH_FIELDS[kind] if c in master.columns]
    return master.filter(matches(columns, text, anywhere=kind in ("sku", "product")))


def search_products(product: DataFrame, sku: DataFrame, text: str) -> DataFrame:
    """Products found by their own fields or through one of their SKUs."""
    sku_columns = [c for c in ("sku_code", "sku_name", "short_name", "source_product_code") if c in sku.columns]
    hits = sku.filter(matches(sku_columns, text, anywhere=True)).select("product_id").distinct().withColumn("_hit", F.lit(True))
    own = matches([c for c in SEARCH_FIELDS["product"] if c in product.columns], text, anywhere=True)
    return product.join(hits, "product_id", "left").filter(own | F.col("_hit").isNotNull()).drop("_hit")


def search_skus(sku: DataFrame, product: DataFrame, text: str) -> DataFrame:
    """SKUs found by their own fields or through their product."""
    columns = [c for c in (*SEARCH_FIELDS["sku"], "source_product_code") if c in sku.columns]
    hits = product.filter(matches(("product_code", "product_name"), text, anywhere=True)).select("product_id").withColumn("_hit", F.lit(True))
    return sku.join(hits, "product_id", "left").filter(matches(columns, text, anywhere=True) | F.col("_hit").isNotNull()).drop("_hit")


def list_master(
    master: DataFrame,
    status: tuple[str, str],
    equal: dict[str, object] | None = None,
    any_of: dict[str, Sequence[object]] | None = None,
    updated_since: Column | None = None,
) -> DataFrame:
    """Filters of a master list; ``status`` is (column, value), 'ALL' keeps both."""
    column, value = status
    kept = master if value == "ALL" else master.filter(F.col(column) == value)
    for name, wanted in (equal or {}).items():
        kept = kept.filter(F.col(name) == wanted)
    for name, values in (any_of or {}).items():
        kept = kept.filter(F.col(name).isin(*values))
    return kept if updated_since is None else kept.filter(F.col("updated_at") >= updated_since)


def with_names(rows: DataFrame, dimensions: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Adds display columns of joined dimensions: id column -> (master, columns)."""
    for key, (master, columns) in dimensions.items():
        rows = rows.join(master.select(key, *columns), key, "left")
    return rows


def list_page(rows: DataFrame, sort: str, descending: bool, tie: str, page_no: int, page_size: int) -> DataFrame:
    first = F.col(sort).desc() if descending else F.col(sort).asc()
    return page(rows, [first, F.col(tie).asc()], page_no, page_size)


def filter_values(sku: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Distinct non-empty values per filter field."""
    entries = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
    return sku.select(F.inline(F.array(*entries))).filter((F.col("value").isNotNull()) & (F.col("value") != "")).distinct()


def products_with_sku_count(product: DataFrame, sku: DataFrame) -> DataFrame:
    counts = sku.groupBy("product_id").agg(F.count(F.lit(1)).alias("sku_count"))
    return product.join(counts, "product_id", "left").withColumn("sku_count", F.coalesce("sku_count", F.lit(0)))


def product_children(product: DataFrame, sku: DataFrame) -> DataFrame:
    """SKUs of each product, ordered by code within the product when read."""
    return product.select("product_id", "product_code", "product_name").join(
        sku.select("product_id", "sku_id", "sku_code", "sku_name", "case_pack", "sku_status"), "product_id"
    )


def reference_counts(links: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Records pointing at each master id, all and active.

    ``links``: label -> (child table, id column, status column).
    """
    parts = [
        child.filter(F.col(key).isNotNull()).select(F.lit(label).alias("link"), F.col(key).alias("target_id"), (F.col(status) == "ACTIVE").alias("_active"))
        for label, (child, key, status) in links.items()
    ]
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("target_id")
        .agg(F.count(F.lit(1)).alias("reference_count"), F.count_if("_active").alias("active_reference_count"))
    )


# --- maintenance -----------------------------------------------------------


def save_findings(changes: DataFrame, master: DataFrame, key: str, code: str, code_equal=collated) -> DataFrame:
    """Refusals of creates and updates: a code in use, within the request too.

    ``changes`` carry change_id, ``key`` (NULL for a create) and the new code.
    """
    wanted = changes.filter(F.col(code).isNotNull()).select("change_id", F.col(key).alias("_own"), code_equal(code).alias("_code"))
    used = master.select(F.col(key).alias("_user"), code_equal(code).alias("_used"))
    taken = wanted.join(used, F.col("_code") == F.col("_used")).filter(~F.col("_user").eqNullSafe(F.col("_own")))
    twice = wanted.groupBy("_code").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").withColumnRenamed("_code", "_again")
    repeated = wanted.join(twice, F.col("_code") == F.col("_again"))
    codes = [taken.select("change_id").distinct().withColumn("code", F.lit("CODE_IN_USE"))]
    codes.append(repeated.select("change_id").distinct().withColumn("code", F.lit("CODE_REPEATED_IN_REQUEST")))
    return reduce(DataFrame.unionByName, codes)


def reference_findings(changes: DataFrame, column: str, master: DataFrame, master_id: str, status: str) -> DataFrame:
    """References by stable id must name an ACTIVE record."""
    known = master.select(F.col(master_id).alias(column), F.col(status).alias("_status"))
    joined = changes.filter(F.col(column).isNotNull()).join(known, column, "left")
    code = F.when(F.col("_status").isNull(), "REFERENCE_NOT_FOUND").when(F.col("_status") != "ACTIVE", "INACTIVE_REFERENCE")
    return joined.withColumn("code", code).filter("code is not null").select("change_id", "code")


def self_parents(changes: DataFrame) -> DataFrame:
    own = changes.filter(F.col("parent_customer_stable_id") == F.col("customer_stable_id"))
    return own.select("change_id", F.lit("SELF_PARENT").alias("code"))


def required_text_findings(changes: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Required texts that are blank once trimmed."""
    found = F.filter(F.array(*[F.when(blank_to_null(f).isNull(), F.lit(f)) for f in fields]), lambda f: f.isNotNull())
    return changes.select("change_id", F.explode(found).alias("field")).select("change_id", F.concat(F.lit("REQUIRED_"), F.upper("field")).alias("code"))


def optional_text(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Optional texts trimmed, blank to NULL."""
    return rows.withColumns({f: blank_to_null(f) for f in fields})


def same_name_notice(changes: DataFrame, product: DataFrame) -> DataFrame:
    """New products whose name (ignoring case) is already in use."""
    names = product.select(F.lower("product_name").alias("_n"))
    return changes.join(names, F.lower("product_name") == F.col("_n"), "left_semi").select("change_id", F.lit("POSSIBLE_PRODUCT_MATCH").alias("code"))


def apply_changes(master: DataFrame, changes: DataFrame, refused: DataFrame, key: str) -> DataFrame:
    """Master after the accepted changes; a NULL in a change leaves the field.

    New records come with their key already set.
    """
    accepted = changes.join(refused.select("change_id").distinct(), "change_id", "left_anti")
    fields = [c for c in master.columns if c != key]
    given = [c for c in fields if c in changes.columns]
    fresh = accepted.select(key, *[F.col(c).alias(f"_n_{c}") for c in given])
    joined = master.join(fresh, key, "full")
    return joined.select(key, *[(F.coalesce(f"_n_{c}", c) if c in given else F.col(c)).alias(c) for c in fields])


def significant_changes(changes: DataFrame, sku: DataFrame) -> DataFrame:
    """SKU changes of level 3, level 4 or case pack that need a confirmation.

    ``changes``: change_id, sku_id, any of the fields, confirmed.
    """
    fields = [f for f in SKU_SIGNIFICANT_FIELDS if f in changes.columns and f in sku.columns]
    old = sku.select("sku_id", *[F.col(f).alias(f"_o_{f}") for f in fields])
    changed = F.filter(F.array(*[F.when(F.col(f).isNotNull() & ~F.col(f).eqNullSafe(F.col(f"_o_{f}")), F.lit(f)) for f in fields]), lambda f: f.isNotNull())
    joined = changes.join(old, "sku_id").withColumn("changed_fields", F.array_join(F.array_sort(changed), ","))
    needs = (F.col("changed_fields") != "") & ~F.coalesce("confirmed", F.lit(False))
    return joined.select("change_id", "sku_id", "changed_fields", needs.alias("needs_confirmation"))


def status_changes(changes: DataFrame, master: DataFrame, key: str, status: str, counts: DataFrame, policy: str) -> DataFrame:
    """Outcome of activations and deactivations.

    ``changes``: change_id, ``key``, new_status, confirmed. ``policy`` says what
    records pointing at the master do on deactivation: 'block' (active ones),
    'confirm_active' (products) or 'confirm_all' (channels, reps, regions, provinces).
    """
    joined = changes.join(master.select(key, status), key, "left").join(counts.withColumnRenamed("target_id", key), key, "left")
    column = "reference_count" if policy == "confirm_all" else "active_reference_count"
    pointing = F.coalesce(column, F.lit(0))
    off = F.col("new_status") == "INACTIVE"
    confirmed = F.coalesce("confirmed", F.lit(False))
    held = off & (pointing > 0)
    outcome = (
        F.when(F.col(status).isNull(), "NOT_FOUND")
        .when(held & F.lit(policy == "block"), "IN_USE")
        .when(held & ~confirmed, "CONFIRMATION_REQUIRED")
        .when(F.col(status) == F.col("new_status"), "UNCHANGED")
        .when(held, "CHANGED_REFERENCES_RETAINED")
        .otherwise("CHANGED")
    )
    return joined.select("change_id", key, "new_status", pointing.cast("bigint").alias("references"), outcome.alias("outcome"))


def reassign_skus(changes: DataFrame, sku: DataFrame, product: DataFrame) -> DataFrame:
    """Outcome of moving SKUs to another product.

    ``changes``: change_id, sku_id, target_product_id, confirmed. Notes when the
    move leaves its former product without SKUs.
    """
    sizes = sku.filter(F.col("product_id").isNotNull()).groupBy("product_id").agg(F.count(F.lit(1)).alias("_size"))
    target = product.select(F.col("product_id").alias("target_product_id"), F.col("product_status").alias("_target"))
    joined = (
        changes.join(sku.select("sku_id", "product_id", F.lit(True).alias("_sku")), "sku_id", "left")
        .join(sizes, "product_id", "left")
        .join(target, "target_product_id", "left")
    )
    same = F.col("product_id") == F.col("target_product_id")
    outcome = (
        F.when(F.col("_sku").isNull(), "SKU_NOT_FOUND")
        .when(F.col("product_id").isNull(), "PRODUCT_REQUIRED")
        .when(F.col("_target").isNull(), "TARGET_NOT_FOUND")
        .when(F.col("_target") != "ACTIVE", "INACTIVE_REFERENCE")
        .when(same, "UNCHANGED")
        .when(~F.coalesce("confirmed", F.lit(False)), "CONFIRMATION_REQUIRED")
        .otherwise("CHANGED")
    )
    moved = F.col("outcome").isin("CHANGED", "CONFIRMATION_REQUIRED")
    empty = moved & (F.col("_size") == 1)
    return joined.withColumn("outcome", outcome).select(
        "change_id", "sku_id", F.col("product_id").alias("source_product_id"), "target_product_id", "outcome", F.coalesce(empty, F.lit(False)).alias("source_product_empty")
    )


# --- overview --------------------------------------------------------------

# Work-list label per batch status.
WORK_LABELS = {
    "READY_FOR_REVIEW": "REVIEW",
    "REVIEW": "REVIEW",
    "RESOLVING": "REVIEW",
    "READY_TO_CONFIRM": "CONFIRM",
    "READY_TO_COMMIT": "COMMIT",
    "PREVIEW_READY": "PUBLISH",
}


def batch_totals(batches: DataFrame) -> DataFrame:
    """Batches per import kind and status."""
    return batches.groupBy("entity_type", "status").agg(F.count(F.lit(1)).alias("batches"), F.sum("total_rows").cast("bigint").alias("rows"))


def status_counts(masters: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Active and inactive records per master."""
    parts = [
        frame.agg(F.count_if(F.col(status) == "ACTIVE").alias("active"), F.count_if(F.col(status) == "INACTIVE").alias("inactive")).select(
            F.lit(name).alias("master"), "active", "inactive"
        )
        for name, (frame, status) in masters.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def pending_work(batches: DataFrame) -> DataFrame:
    """Batches waiting for somebody, with what they wait for."""
    label = F.lit(None).cast("string")
    for status, work in WORK_LABELS.items():
        label = F.when(F.col("status") == status, work).otherwise(label)
    return batches.withColumn("work", label).filter("work is not null")


def analysis_per_entity(rows: DataFrame) -> DataFrame:
    """Counters of a staged batch: duplicates, unresolved references, parents.

    A finding's group is counted once by its candidate key.
    """
    found = rows.select("batch_id", F.explode("findings").alias("f")).select("batch_id", "f.*")
    groups = found.groupBy("batch_id", "code", "candidate_key").agg(F.count(F.lit(1)).alias("_n"))
    return groups.groupBy("batch_id", "code").agg(F.sum("_n").alias("affected_rows"), F.count("candidate_key").alias("groups"))


def attach_sku_counts(sku: DataFrame, row_id: Sequence[str]) -> DataFrame:
    """SKU rows with the size of their product."""
    return attach_group(sku, ["product_id"], {"product_skus": F.count(F.lit(1))}, row_id)
