"""Committing reviewed master batches: gate, revalidation, creation, audit.

New ids are deterministic stable ids; surrogate ids follow the highest one in
use. Rows come from ``review.row_readiness`` joined with their fields.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.functions.keys import identity_key, stable_id
from stockweave.functions.text import casefold, collated, fold_key, normalize_text
from stockweave.operators.master_import import goods_plans

ROW = ["batch_id", "row_number"]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _found(rows: DataFrame, code: str) -> DataFrame:
    return rows.select("batch_id", F.col("row_number").cast("bigint").alias("row_number"), F.lit(code).alias("code"))


def quality_gate(rows: DataFrame, open_warnings: DataFrame, errors: DataFrame, code_key: Column) -> DataFrame:
    """What keeps a batch from being committed: (batch_id, row_number, code).

    No error, no open warning, every row READY or EXISTING, nothing committed
    before, and no code twice - existing rows included.
    """
    ready, existing = F.col("status") == "READY", F.col("status") == "EXISTING"
    done = F.col("committed_snapshot").isNotNull()
    create_only = (ready & (F.col("reviewed_values").isNull() | F.col("commit_result").isNotNull() | done)) | (
        existing & (~F.col("commit_result").eqNullSafe(F.lit("EXISTING")) | F.col("reviewed_values").isNotNull() | done)
    )
    repeated = rows.withColumn("_key", code_key).filter("_key is not null").groupBy("batch_id", "_key").agg(F.count(F.lit(1)).alias("_n"), F.min("row_number").alias("row_number"))
    return _union(
        [
            _found(errors, "ERROR_OPEN"),
            _found(open_warnings, "WARNING_OPEN"),
            _found(rows.filter(~(ready | existing)), "ROW_NOT_READY"),
            _found(rows.filter(create_only), "CREATE_ONLY_VIOLATION"),
            _found(repeated.filter("_n > 1"), "DUPLICATE_CODE"),
        ]
    ).distinct()


def _reference_findings(creates: DataFrame, column: str, master: DataFrame, master_id: str, status: str, required: bool) -> DataFrame:
    known = master.select(F.col(master_id).alias(column), F.col(status).alias("_status"))
    joined = creates.join(known, column, "left")
    missing = F.col(column).isNull() if required else F.lit(False)
    gone = F.col(column).isNotNull() & ~F.col("_status").eqNullSafe(F.lit("ACTIVE"))
    return _found(joined.filter(missing | gone), f"{column.removesuffix('_stable_id').upper()}_MISSING_OR_INACTIVE")


def revalidate_customers(rows: DataFrame, customer: DataFrame, references: dict[str, tuple[DataFrame, str, str, bool]]) -> DataFrame:
    """Changes since the review that forbid the commit.

    ``references``: row column -> (master, stable id column, status column, required).
    """
    creates, existing = rows.filter(F.col("status") == "READY"), rows.filter(F.col("status") == "EXISTING")
    now = customer.select(
        F.col("customer_stable_id").alias("matched_stable_id"), F.col("customer_code").alias("_code"), normalize_text("customer_name").alias("_name")
    )
    joined = existing.join(now, "matched_stable_id", "left")
    changed = F.col("_code").isNull() | (collated("_code") != collated("customer_code")) | ~F.col("_name").eqNullSafe(F.col("customer_name"))
    taken_codes = customer.select(collated("customer_code").alias("_taken"))
    taken = creates.join(taken_codes, collated("customer_code") == F.col("_taken"), "left_semi")
    parts = [_found(joined.filter(changed), "EXISTING_CHANGED"), _found(taken, "CODE_TAKEN")]
    parts += [_reference_findings(creates, column, *spec) for column, spec in references.items()]
    return _union(parts)


def revalidate_products(rows: DataFrame, product: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """``acknowledged``: batch_id, row_number, candidate_stable_id - the same-name
    products a reviewer accepted. Today's must be exactly those."""
    creates, existing = rows.filter(F.col("status") == "READY"), rows.filter(F.col("status") == "EXISTING")
    now = product.select(F.col("product_stable_id").alias("matched_stable_id"), fold_key("product_code").alias("_code"), fold_key("product_name").alias("_name"))
    joined = existing.join(now, "matched_stable_id", "left")
    changed = ~F.col("_code").eqNullSafe(casefold("product_code")) | ~F.col("_name").eqNullSafe(casefold("product_name"))
    codes = product.select(collated("product_code").alias("_taken"))
    taken = creates.join(codes, collated("product_code") == F.col("_taken"), "left_semi")
    names = product.select(collated("product_name").alias("_n"), F.col("product_stable_id").alias("candidate_stable_id"))
    today = creates.join(names, collated("product_name") == F.col("_n")).select(*ROW, "candidate_stable_id")
    fresh = today.join(acknowledged, [*ROW, "candidate_stable_id"], "left_anti")
    affected = today.select(*ROW).distinct()
    gone = acknowledged.join(affected, ROW, "left_semi").join(today, [*ROW, "candidate_stable_id"], "left_anti")
    conflict = fresh.select(*ROW).unionByName(gone.select(*ROW)).distinct()
    return _union([_found(joined.filter(changed), "EXISTING_CHANGED"), _found(taken, "CODE_TAKEN"), _found(conflict, "NAME_CONFLICT_CHANGED")])


def _sku_checks(rows: DataFrame, sku: DataFrame, name_key) -> list[DataFrame]:
    creates, existing = rows.filter(F.col("status") == "READY"), rows.filter(F.col("status") == "EXISTING")
    now = sku.select(F.col("sku_stable_id").alias("matched_stable_id"), casefold("sku_code").alias("_code"), name_key("sku_name").alias("_name"))
    joined = existing.join(now, "matched_stable_id", "left")
    changed = ~F.col("_code").eqNullSafe(casefold("sku_code")) | ~F.col("_name").eqNullSafe(name_key("sku_name"))
    codes = sku.select(F.lower("sku_code").alias("_taken"))
    taken = creates.join(codes, casefold("sku_code") == F.col("_taken"), "left_semi")
    return [_found(joined.filter(changed), "EXISTING_CHANGED"), _found(taken, "CODE_TAKEN")]


def revalidate_skus(rows: DataFrame, sku: DataFrame, product: DataFrame) -> DataFrame:
    creates = rows.filter(F.col("status") == "READY").withColumn("_ref", casefold("product_code_ref"))
    known = product.select(F.lower("product_code").alias("_ref"), F.col("product_status").alias("_status"))
    joined = creates.join(known, "_ref", "left")
    return _union(
        [
            *_sku_checks(rows, sku, casefold),
            _found(joined.filter(F.col("_status").isNull()), "PRODUCT_MISSING"),
            _found(joined.filter(F.col("_status") != "ACTIVE"), "PRODUCT_INACTIVE"),
        ]
    )


def revalidate_goods(rows: DataFrame, sku: DataFrame, product: DataFrame) -> DataFrame:
    """Rows carry their plan (plan_action, plan_product_stable_id)."""
    creates = rows.filter(F.col("status") == "READY").withColumn("_ref", casefold("product_code"))
    planned = product.select(F.col("product_stable_id").alias("plan_product_stable_id"), F.lower("product_code").alias("_code"), F.col("product_status").alias("_status"))
    bound = creates.filter(F.col("plan_action") == "EXISTING").join(planned, "plan_product_stable_id", "left")
    broken = bound.filter(~F.col("_code").eqNullSafe(F.col("_ref")) | ~F.col("_status").eqNullSafe(F.lit("ACTIVE")))
    codes = product.select(F.lower("product_code").alias("_ref"))
    taken = creates.filter(F.col("plan_action") == "CREATE").join(codes, "_ref", "left_semi")
    return _union([*_sku_checks(rows, sku, fold_key), _found(broken, "PRODUCT_MISSING_OR_INACTIVE"), _found(taken, "PRODUCT_CODE_TAKEN")])


# --- creation --------------------------------------------------------------


def create_customers(rows: DataFrame) -> DataFrame:
    """New customers of the READY rows, references and parents by stable id.

    A parent is the master named in the review or another new row of the batch.
    """
    creates = rows.filter(F.col("status") == "READY")
    own_id = stable_id("CUSTOMER", identity_key("customer_code_name", "customer_code", "customer_name"))
    made = creates.withColumn("customer_stable_id", own_id)
    siblings = made.select("batch_id", F.col("row_number").alias("parent_row"), F.col("customer_stable_id").alias("_sibling"))
    joined = made.join(siblings, ["batch_id", "parent_row"], "left")
    parent = F.when(F.col("parent_resolution") == "RESOLVED", F.coalesce("parent_stable_id", "_sibling"))
    return joined.withColumn("parent_customer_stable_id", parent).withColumn("customer_status", F.lit("ACTIVE")).drop("_sibling")


def parent_findings(created: DataFrame) -> DataFrame:
    """New customers that would be their own parent or whose parent is missing."""
    own = created.filter(F.col("parent_customer_stable_id") == F.col("customer_stable_id"))
    lost = created.filter((F.col("parent_resolution") == "RESOLVED") & F.col("parent_customer_stable_id").isNull())
    return _found(own, "PARENT_SELF").unionByName(_found(lost, "PARENT_ROW_NOT_CREATED"))


def create_products(rows: DataFrame) -> DataFrame:
    creates = rows.filter(F.col("status") == "READY")
    return creates.select(
        *ROW,
        stable_id("PRODUCT", identity_key("product", "product_code")).alias("product_stable_id"),
        "product_code",
        "product_name",
        "brand",
        F.lit("ACTIVE").alias("product_status"),
    )


def create_skus(rows: DataFrame, product: DataFrame) -> DataFrame:
    """New SKUs bound to the product they name."""
    creates = rows.filter(F.col("status") == "READY").withColumn("_ref", casefold("product_code_ref"))
    known = product.select(F.lower("product_code").alias("_ref"), "product_stable_id", F.col("product_code").alias("source_product_code"))
    return (
        creates.join(known, "_ref")
        .withColumn("sku_stable_id", stable_id("SKU", identity_key("sku", "sku_code")))
        .withColumn("sku_status", F.lit("ACTIVE"))
        .drop("_ref")
    )


def create_goods(rows: DataFrame, product: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New products, one per new code with the plan of its first row, and SKUs."""
    creates = rows.filter(F.col("status") == "READY").withColumn("_ref", casefold("product_code"))
    plan = F.struct("plan_code", "plan_name", "plan_brand")
    fresh = (
        creates.filter(F.col("plan_action") == "CREATE")
        .groupBy("batch_id", "_ref")
        .agg(F.min_by(plan, "row_number").alias("_p"), F.min("row_number").alias("first_row"))
        .select(
            "batch_id",
            "_ref",
            "first_row",
            stable_id("PRODUCT", identity_key("product", F.col("_p.plan_code"))).alias("product_stable_id"),
            F.col("_p.plan_code").alias("product_code"),
            F.col("_p.plan_name").alias("product_name"),
            F.col("_p.plan_brand").alias("brand"),
            F.lit("ACTIVE").alias("product_status"),
        )
    )
    created = fresh.select("batch_id", "_ref", F.col("product_stable_id").alias("_new"))
    skus = (
        creates.join(created, ["batch_id", "_ref"], "left")
        .withColumn("product_stable_id", F.coalesce("_new", "plan_product_stable_id"))
        .withColumn("sku_stable_id", stable_id("SKU", identity_key("sku", "sku_code")))
        .withColumn("sku_status", F.lit("ACTIVE"))
        .drop("_new", "_ref")
    )
    return fresh.drop("_ref"), skus


def goods_summary(rows: DataFrame) -> DataFrame:
    """Products and SKUs created, rows that existed, total per batch."""
    creates = F.col("status") == "READY"
    new_code = F.when(creates & (F.col("plan_action") == "CREATE"), casefold("product_code"))
    return rows.groupBy("batch_id").agg(
        F.count_distinct(new_code).alias("products_created"),
        F.count_if(creates).alias("skus_created"),
        F.count_if(F.col("status") == "EXISTING").alias("existing"),
        F.count_if(creates | (F.col("status") == "EXISTING")).alias("total"),
    )


def plan_goods(rows: DataFrame, product: DataFrame) -> DataFrame:
    """Rows with the plan of their product group attached."""
    return rows.withColumn("plan_key", casefold("product_code")).join(goods_plans(rows, product), ["batch_id", "plan_key"], "left")


def bootstrap_entities(
    rows: DataFrame, entity_type: str, key: Column, label: Column, mappings: DataFrame, master: DataFrame, stable_column: str, id_column: str
) -> DataFrame:
    """Entity of each bootstrap row through its source mapping or stable id.

    ``outcome``: MAPPED, FOUND (an entity with that stable id, mapping to add),
    CREATE, EXCLUDED, or SOURCE_KEY_REUSED when the key is bound to another name.
    """
    wanted = rows.withColumn("identity_key", key).withColumn("identity_label", label).withColumn("stable_id", stable_id(entity_type, F.col("identity_key")))
    active = mappings.filter((F.col("entity_type") == entity_type) & (F.col("status") == "ACTIVE")).select(
        "source_system", F.col("external_code").alias("identity_key"), F.col("external_name").alias("_label"), F.col("entity_id").alias("_mapped")
    )
    known = master.select(F.col(stable_column).alias("stable_id"), F.col(id_column).alias("_found"))
    ids = master.select(F.col(id_column).alias("_mapped"), F.lit(True).alias("_alive"))
    joined = wanted.join(active, ["source_system", "identity_key"], "left").join(ids, "_mapped", "left").join(known, "stable_id", "left")
    reused = F.col("_mapped").isNotNull() & (F.col("_alive").isNull() | (F.col("_label") != F.col("identity_label")))
    skipped = F.col("excluded") if "excluded" in rows.columns else F.lit(False)
    outcome = (
        F.when(skipped, "EXCLUDED")
        .when(F.coalesce(reused, F.lit(False)), "SOURCE_KEY_REUSED")
        .when(F.col("_mapped").isNotNull(), "MAPPED")
        .when(F.col("_found").isNotNull(), "FOUND")
        .otherwise("CREATE")
    )
    return joined.withColumn("outcome", outcome).withColumn("entity_id", F.coalesce("_mapped", "_found")).drop("_mapped", "_label", "_alive", "_found")


# --- audit -----------------------------------------------------------------


def change_log(before: DataFrame, after: DataFrame, key: str, fields: list[str], entity_type: str, actor: str) -> DataFrame:
    """Audit rows: one per changed field, one per created record.

    A changed reference is a RELATION_CHANGE, a changed status a
    STATUS_CHANGE, anything else an UPDATE. Both snapshots are kept as JSON.
    """

    def snapshot(frame: DataFrame, name: str) -> DataFrame:
        values = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.col(f).cast("string") for f in fields]))
        return frame.select(key, values.alias(name), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(f"{name}_json"))

    joined = snapshot(before, "_b").join(snapshot(after, "_a"), key, "full")
    created = F.col("_b").isNull()
    changed = F.filter(F.array(*map(F.lit, fields)), lambda f: ~F.try_element_at("_b", f).eqNullSafe(F.try_element_at("_a", f)))
    names = F.when(created, F.array(F.lit(None).cast("string"))).otherwise(changed)
    listed = joined.filter(F.col("_a").isNotNull()).withColumn("field_name", F.explode(names))
    field = F.col("field_name")
    action = (
        F.when(created, "CREATE")
        .when(field.endswith("_stable_id"), "RELATION_CHANGE")
        .when(field.endswith("status"), "STATUS_CHANGE")
        .otherwise("UPDATE")
    )
    return listed.select(
        F.lit(entity_type).alias("entity_type"),
        F.col(key).alias("entity_key"),
        action.alias("action"),
        "field_name",
        F.try_element_at("_b", field).alias("old_value"),
        F.try_element_at("_a", field).alias("new_value"),
        F.col("_b_json").alias("snapshot_before"),
        F.col("_a_json").alias("snapshot_after"),
        F.lit(actor).alias("actor"),
    )
