"""Writing a bootstrap batch: source mappings and entities checked from both sides, then every row or none.

A source key belongs to one entity and an entity to one source key of a system.
Both directions are aggregates over the batch's rows and the stored mappings,
least against greatest value, so no group is gathered. A batch with a conflict
writes nothing; in the others a key makes its entity once, from its first row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.functions.keys import identity_key, stable_id
from stockweave.operators.commit import ROW, _found, _union, bootstrap_entities


def relation_conflicts(rows: DataFrame, mappings: DataFrame, entity_type: str) -> DataFrame:
    """(batch_id, row_number, code) of rows whose key or entity is not one to one.

    ``rows``: outcome of :func:`commit.bootstrap_entities`. SOURCE_KEY_REUSED: the
    key is bound to another subject, or names several subjects in the batch.
    ENTITY_MAPPED_TWICE: the row's entity is reached from another key as well,
    of the batch or of the stored mappings.
    """
    open_ = rows.filter(F.col("outcome") != "EXCLUDED")
    stored = mappings.filter((F.col("entity_type") == entity_type) & (F.col("status") == "ACTIVE"))
    by_key = open_.groupBy("batch_id", "source_system", "identity_key").agg(F.min("identity_label").alias("_a"), F.max("identity_label").alias("_b")).filter("_a <> _b").select("batch_id", "source_system", "identity_key")
    claims = open_.filter(F.col("entity_id").isNotNull()).select("source_system", "entity_id", "identity_key").unionByName(stored.select("source_system", "entity_id", F.col("external_code").alias("identity_key")))
    by_entity = claims.groupBy("source_system", "entity_id").agg(F.min("identity_key").alias("_a"), F.max("identity_key").alias("_b")).filter("_a <> _b").select("source_system", "entity_id")
    return _union(
        [
            _found(open_.filter(F.col("outcome") == "SOURCE_KEY_REUSED"), "SOURCE_KEY_REUSED"),
            _found(open_.join(by_key, ["batch_id", "source_system", "identity_key"], "left_semi"), "SOURCE_KEY_REUSED"),
            _found(open_.join(by_entity, ["source_system", "entity_id"], "left_semi"), "ENTITY_MAPPED_TWICE"),
        ]
    ).distinct()


def write_entities(rows: DataFrame, conflicts: DataFrame, entity_type: str, values: list[str], defaults: dict[str, Column] | None = None) -> dict[str, DataFrame]:
    """Masters, mappings, audit rows, row results and the summary of the batches without conflict.

    ``rows``: as above with the columns ``values`` a new master takes;
    ``defaults`` are further columns of a new master.
    """
    clean = rows.join(conflicts.select("batch_id").distinct(), "batch_id", "left_anti")
    open_ = clean.filter(F.col("outcome") != "EXCLUDED")
    key = ["batch_id", "source_system", "identity_key"]
    first = open_.filter(F.col("outcome").isin("CREATE", "FOUND")).groupBy(*key, "stable_id", "outcome").agg(
        F.min("row_number").alias("row_number"), F.min_by(F.struct("identity_label", *values), "row_number").alias("_first")
    )
    made = first.filter(F.col("outcome") == "CREATE")
    masters = made.select(*ROW, "stable_id", *[F.col(f"_first.{c}").alias(c) for c in values], *[c.alias(name) for name, c in (defaults or {}).items()], F.lit("ACTIVE").alias("status"))
    mappings = first.select(
        "batch_id", F.lit(entity_type).alias("entity_type"), "stable_id", "source_system", F.col("identity_key").alias("external_code"), F.col("_first.identity_label").alias("external_name"), F.lit("ACTIVE").alias("status")
    )
    snapshot = F.to_json(F.struct("stable_id", *values), {"ignoreNullFields": "false"}).alias("snapshot_after")
    audit = masters.select("batch_id", F.lit(entity_type).alias("entity_type"), F.col("stable_id").alias("entity_stable_id"), F.lit("CREATE").alias("action"), F.lit(None).cast("string").alias("field_name"), snapshot)
    excluded = F.col("outcome") == "EXCLUDED"
    results = clean.select(*ROW, F.when(excluded, "SKIPPED").otherwise("COMMITTED").alias("status"), F.when(~excluded, F.coalesce("entity_stable_id", "stable_id")).alias("entity_stable_id"))
    created = masters.groupBy("batch_id").agg(F.count(F.lit(1)).alias("created_master_rows"))
    summary = clean.groupBy("batch_id").agg(F.count_if(~excluded).alias("committed_master_rows"), F.count_if(excluded).alias("excluded_rows"), F.count(F.lit(1)).alias("finalized_rows"))
    summary = summary.join(created, "batch_id", "left").withColumn("created_master_rows", F.coalesce("created_master_rows", F.lit(0)))
    return {"masters": masters, "mappings": mappings, "audit": audit, "rows": results, "summary": summary}


def located(rows: DataFrame, entity_type: str, key: Column, label: Column, mappings: DataFrame, master: DataFrame, stable_column: str, id_column: str) -> DataFrame:
    """Bootstrap rows with their entity, and the stable id of a stored one."""
    found = bootstrap_entities(rows, entity_type, key, label, mappings, master, stable_column, id_column)
    names = master.select(F.col(id_column).alias("entity_id"), F.col(stable_column).alias("entity_stable_id"))
    return found.join(names, "entity_id", "left")


def commit_channels(rows: DataFrame, mappings: DataFrame, channel: DataFrame, code_prefix: str) -> dict[str, DataFrame]:
    """Channels by their source index; a new one is coded by it, three digits at least."""
    key = identity_key("channel", "source_index")
    coded = rows.withColumn("channel_code", F.concat(F.lit(code_prefix), F.lpad("source_index", F.greatest(F.length("source_index"), F.lit(3)), F.lit("0"))))
    found = located(coded, "CHANNEL", key, F.col("channel_name"), mappings, channel, "channel_stable_id", "channel_id")
    conflicts = relation_conflicts(found, mappings, "CHANNEL")
    return write_entities(found, conflicts, "CHANNEL", ["channel_code", "channel_name"]) | {"conflicts": conflicts}


def commit_salesreps(rows: DataFrame, mappings: DataFrame, salesrep: DataFrame) -> dict[str, DataFrame]:
    """Sales reps by their row in the file; they have no employee code yet."""
    found = located(rows, "SALESREP", identity_key("salesrep", "row_number"), F.col("salesrep_name"), mappings, salesrep, "salesrep_stable_id", "salesrep_id")
    conflicts = relation_conflicts(found, mappings, "SALESREP")
    none = {"salesrep_code": F.lit(None).cast("string")}
    return write_entities(found, conflicts, "SALESREP", ["salesrep_name"], none) | {"conflicts": conflicts}


def commit_skus(rows: DataFrame, representatives: DataFrame, mappings: DataFrame, product: DataFrame, sku: DataFrame, values: list[str]) -> dict[str, DataFrame]:
    """Products named by their confirmed representative, then SKUs bound to them; all of a batch or nothing.

    ``rows``: sku_code, sku_name, source_product_code and ``values``;
    ``representatives``: batch_id, source_product_code, product_name as
    confirmed. ``sku`` has product_stable_id. A group without a representative,
    and a stored SKU of another product, keep their batch out.
    """
    open_ = rows if "excluded" not in rows.columns else rows.filter(~F.col("excluded"))
    named = rows.join(representatives.select("batch_id", "source_product_code", F.col("product_name").alias("_representative")), ["batch_id", "source_product_code"], "left")
    groups = open_.groupBy("batch_id", "source_system", "source_product_code").agg(F.min("row_number").alias("row_number"))
    groups = groups.join(representatives, ["batch_id", "source_product_code"], "left").withColumn("product_code", F.col("source_product_code"))
    products = located(groups, "PRODUCT", identity_key("product", "source_product_code"), F.col("source_product_code"), mappings, product, "product_stable_id", "product_id")
    bound = products.select("batch_id", "source_product_code", F.coalesce("entity_stable_id", "stable_id").alias("product_stable_id"))
    skus = located(named.join(bound, ["batch_id", "source_product_code"], "left"), "SKU", identity_key("sku", "sku_code"), F.col("sku_name"), mappings, sku.select("sku_id", "sku_stable_id"), "sku_stable_id", "sku_id")
    homes = sku.select(F.col("sku_id").alias("entity_id"), F.col("product_stable_id").alias("_home"))
    moved = skus.filter(F.col("outcome") != "EXCLUDED").join(homes, "entity_id").filter(~F.col("_home").eqNullSafe(F.col("product_stable_id")))
    lacking = skus.filter((F.col("outcome") != "EXCLUDED") & F.col("_representative").isNull())
    conflicts = _union(
        [
            relation_conflicts(products, mappings, "PRODUCT"),
            relation_conflicts(skus, mappings, "SKU"),
            _found(moved, "SKU_OF_OTHER_PRODUCT"),
            _found(lacking, "PRODUCT_REPRESENTATIVE_REQUIRED"),
        ]
    ).distinct()
    made = write_entities(products, conflicts, "PRODUCT", ["product_code", "product_name"])
    kept = write_entities(skus, conflicts, "SKU", ["sku_code", "sku_name", "product_stable_id", "source_product_code", *values])
    together = {name: made[name].unionByName(kept[name]) for name in ("mappings", "audit")}
    products_made = made["summary"].select("batch_id", F.col("created_master_rows").alias("created_product_rows"), F.col("committed_master_rows").alias("product_count"))
    return {"products": made["masters"], "skus": kept["masters"], **together, "rows": kept["rows"], "summary": kept["summary"].join(products_made, "batch_id", "left"), "conflicts": conflicts}
