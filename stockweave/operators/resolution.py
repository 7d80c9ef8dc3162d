"""Deterministic entity resolution: exact key first, then a normalised key that
must name exactly one record. Nothing is matched by similarity.

Keys are resolved once per distinct value and joined back, so the text
normaliser and the master join see each code or name once, not once per row.
Join strategy is left to the optimizer: a small key table is broadcast, a
large one is shuffled with skew handling.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.functions.text import collated, fold_key, normalize_text, sku_fallback_key
from stockweave.sources.staging import Steps

KIT_PARENT = "KIT_PARENT"
NONPOSITIVE_QTY = "NONPOSITIVE_QTY"
SKU_NOT_FOUND = "SKU_NOT_FOUND"
SKU_AMBIGUOUS = "SKU_AMBIGUOUS"
PRODUCT_NOT_ASSIGNED = "PRODUCT_NOT_ASSIGNED"
CUSTOMER_NOT_FOUND = "CUSTOMER_NOT_FOUND"

SNAPSHOT_COLUMNS = (
    "sku_id",
    "sku_code_snapshot",
    "sku_name_snapshot",
    "product_id",
    "product_code_snapshot",
    "product_name_snapshot",
    "customer_id",
    "customer_code_snapshot",
    "customer_name_snapshot",
    "channel_id_snapshot",
    "channel_code_snapshot",
    "channel_name_snapshot",
    "salesrep_id_snapshot",
    "salesrep_code_snapshot",
    "salesrep_name_snapshot",
)


def early_skip() -> Column:
    """Reason to skip a row before any lookup: kit parent, then quantity <= 0."""
    return F.when(F.col("source_product_type") == KIT_PARENT, KIT_PARENT).when(F.col("actual_qty") <= 0, NONPOSITIVE_QTY)


def resolve_sku_codes(codes: DataFrame, sku: DataFrame) -> DataFrame:
    """Distinct ``source_sku_code`` -> SKU columns and ``sku_problem``.

    Exact code first; else the fallback key, which must hit a single SKU.
    """
    found = sku.select("sku_id", "sku_code", "sku_name", "product_id")
    single = (
        found.withColumn("_key", sku_fallback_key("sku_code"))
        .groupBy("_key")
        .agg(F.count(F.lit(1)).alias("_hits"), F.min_by(F.struct(*found.columns), "sku_id").alias("_near"))
    )
    exact = codes.join(found.select(F.col("sku_code").alias("source_sku_code"), F.struct(*found.columns).alias("_exact")), "source_sku_code", "left")
    near = exact.withColumn("_key", F.when(F.col("_exact").isNull(), sku_fallback_key("source_sku_code"))).join(single, "_key", "left")
    chosen = F.coalesce("_exact", F.when(F.col("_hits") == 1, F.col("_near")))
    problem = (
        F.when(F.col("_exact").isNull() & (F.col("_hits") > 1), SKU_AMBIGUOUS)
        .when(chosen.isNull(), SKU_NOT_FOUND)
        .when(chosen["product_id"].isNull(), PRODUCT_NOT_ASSIGNED)
    )
    return near.select("source_sku_code", *[chosen[c].alias(c) for c in found.columns], problem.alias("sku_problem"))


def resolve_customer_names(names: DataFrame, customer: DataFrame, channel: DataFrame) -> DataFrame:
    """Distinct ``source_customer_name`` -> customer, NULL unless exactly one matches.

    A master counts when its name equals some source name under the collation
    and its normalised name equals this one's, and when it has a channel.
    """
    with_channel = customer.join(channel.select("channel_id"), "channel_id", "left_semi")
    seen = names.select(collated("source_customer_name").alias("_name"))
    listed = with_channel.join(seen, collated("customer_name") == F.col("_name"), "left_semi")
    unique = (
        listed.withColumn("_key", normalize_text("customer_name"))
        .groupBy("_key")
        .agg(F.count(F.lit(1)).alias("_matches"), F.min_by(F.struct(*customer.columns), "customer_id").alias("_customer"))
        .filter(F.col("_matches") == 1)
    )
    keyed = names.withColumn("_key", normalize_text("source_customer_name"))
    # A left join: an inner one would let the optimizer push "key is not null",
    # and with it the normaliser, below the distinct and onto every raw row.
    return keyed.join(unique, "_key", "left").select("source_customer_name", *[F.col("_customer")[c].alias(c) for c in customer.columns])


#: A stored lookup takes the rows of one part of its keys after the other.
PARTS = 2


def _looked_up(rows: DataFrame, found: DataFrame, key: str, parts: int) -> list[DataFrame]:
    """Left join on ``key``, as one frame per part of the keys."""
    if parts == 1:
        return [rows.join(found, key, "left")]
    part = F.pmod(F.xxhash64(key), F.lit(parts))
    return [rows.filter(part == n).join(found.filter(part == n), key, "left") for n in range(parts)]


def map_sales_rows(
    rows: DataFrame,
    sku: DataFrame,
    product: DataFrame,
    customer: DataFrame,
    channel: DataFrame,
    salesrep: DataFrame,
    columns: Sequence[str] | None = None,
    keep: Steps | None = None,
) -> DataFrame:
    """Rows with status READY or SKIPPED, reason and frozen dimension snapshot.

    A row without a customer stays READY: its customer, channel and rep are
    NULL and its reason says so. ``columns`` are those that come, all by
    default. ``keep`` stores the rows before and after each of the two lookups,
    and each lookup takes its keys in ``PARTS``: the plan above is worked out
    once, and what one part shuffles is gone before the next.
    """
    wanted = list(columns or (*rows.columns, *SNAPSHOT_COLUMNS, "status", "mapping_reason"))
    tagged = rows.withColumn("_skip", early_skip())
    if keep:
        needed = (*wanted, "source_customer_name", "source_sku_code", "_skip")
        tagged = keep(tagged.select(*[c for c in tagged.columns if c in needed]))
    eligible = tagged.filter(F.col("_skip").isNull())
    names = eligible.select("source_customer_name").filter(F.col("source_customer_name").isNotNull()).distinct()
    known = customer.select("customer_id", "customer_code", "customer_name", "channel_id", "salesrep_id")
    customer_of = resolve_customer_names(names, known, channel)
    customer_of = customer_of.join(channel.select("channel_id", "channel_code", "channel_name"), "channel_id", "left").join(
        salesrep.select("salesrep_id", "salesrep_code", "salesrep_name"), "salesrep_id", "left"
    )
    customer_of = customer_of.select(
        "source_customer_name",
        "customer_id",
        *[F.col(c).alias(f"{c}_snapshot") for c in ("customer_code", "customer_name")],
        *[F.col(c).alias(f"{c}_snapshot") for c in ("channel_id", "channel_code", "channel_name")],
        *[F.col(c).alias(f"{c}_snapshot") for c in ("salesrep_id", "salesrep_code", "salesrep_name")],
    )
    # Customers first: rows of one document come together and name the same one,
    # so what moves packs well.
    if keep:
        needed = (*wanted, "source_customer_name", "source_sku_code", "_skip", "customer_id")
        customer_of = keep.beside(customer_of.select(*[c for c in customer_of.columns if c in needed]))
    parts = [part.drop("source_customer_name") if keep and "source_customer_name" not in wanted else part for part in _looked_up(tagged, customer_of, "source_customer_name", PARTS if keep else 1)]
    placed = keep(*parts) if keep else parts[0]
    eligible = placed.filter(F.col("_skip").isNull()) if keep else eligible
    codes = eligible.select("source_sku_code").filter(F.col("source_sku_code").isNotNull()).distinct()
    sku_of = resolve_sku_codes(codes, sku).join(
        product.select("product_id", F.col("product_code").alias("product_code_snapshot"), F.col("product_name").alias("product_name_snapshot")),
        "product_id",
        "left",
    )
    if keep:
        sku_of = keep.beside(sku_of)
    problem = F.when(F.col("sku_id").isNull(), F.coalesce("sku_problem", F.lit(SKU_NOT_FOUND))).otherwise(F.col("sku_problem"))
    ready = F.col("_problem").isNull()
    snapshot = [c for c in (*sku_of.columns, *customer_of.columns) if c not in ("source_sku_code", "source_customer_name", "sku_problem")]
    kept = {c: F.when(ready, F.col(c)) for c in snapshot}

    def shaped(joined: DataFrame) -> DataFrame:
        frozen = joined.withColumn("_problem", F.coalesce("_skip", problem)).withColumns(kept).withColumnsRenamed({"sku_code": "sku_code_snapshot", "sku_name": "sku_name_snapshot"})
        return (
            frozen.withColumn("status", F.when(ready, "READY").otherwise("SKIPPED"))
            .withColumn("mapping_reason", F.coalesce("_problem", F.when(F.col("customer_id").isNull(), CUSTOMER_NOT_FOUND)))
            .select(*wanted)
        )

    parts = [shaped(part) for part in _looked_up(placed, sku_of, "source_sku_code", PARTS if keep else 1)]
    return keep(*parts) if keep else parts[0]


def sku_products(codes: DataFrame, sku: DataFrame, product: DataFrame, key: str = "raw") -> DataFrame:
    """Planning lookup: distinct ``sku_code`` -> SKU, product and both statuses.

    ``key='raw'`` compares codes as they are; ``key='text'`` takes masters whose
    code equals a wanted one under the collation and compares normalised codes.
    """
    masters = sku.select("sku_id", "sku_stable_id", F.col("sku_code").alias("_master_code"), "sku_status", "product_id").join(
        product.select("product_id", "product_stable_id", "product_name", "product_status"), "product_id", "left"
    )
    distinct = codes.select("sku_code").filter(F.col("sku_code").isNotNull()).distinct()
    if key == "raw":
        masters = masters.withColumnRenamed("_master_code", "sku_code")
    else:
        columns = [c for c in masters.columns if c != "_master_code"]
        wanted = distinct.select(collated("sku_code").alias("_wanted"))
        masters = (
            masters.join(wanted, collated("_master_code") == F.col("_wanted"), "left_semi")
            .withColumn("sku_code", normalize_text("_master_code"))
            .groupBy("sku_code")
            .agg(F.max_by(F.struct(*columns), "sku_id").alias("_m"))
            .select("sku_code", "_m.*")
        )
    return distinct.join(masters, "sku_code", "left")


# --- reference catalogue ---------------------------------------------------

CATALOGUE_COLUMNS = ("entity_type", "key_kind", "key", "entity_id", "entity_stable_id", "entity_name", "active", "staged_batch", "staged_row")


def catalogue_entries(
    master: DataFrame,
    entity_type: str,
    id_column: str,
    stable_column: str,
    name_column: str,
    code_column: str | None,
    status_column: str,
    folded: bool = False,
) -> DataFrame:
    """A master's entries by name, code and stable id, one row per key."""
    fold = fold_key if folded else normalize_text
    kinds = [F.struct(F.lit("NAME").alias("key_kind"), fold(name_column).alias("key"))]
    kinds.append(F.struct(F.lit("STABLE_ID").alias("key_kind"), F.col(stable_column).alias("key")))
    if code_column:
        kinds.append(F.struct(F.lit("CODE").alias("key_kind"), fold(code_column).alias("key")))
    return (
        master.withColumn("_k", F.explode(F.array(*kinds)))
        .select(
            F.lit(entity_type).alias("entity_type"),
            "_k.key_kind",
            "_k.key",
            F.col(id_column).alias("entity_id"),
            F.col(stable_column).alias("entity_stable_id"),
            F.col(name_column).alias("entity_name"),
            (F.col(status_column) == "ACTIVE").alias("active"),
            F.lit(None).cast("string").alias("staged_batch"),
            F.lit(None).cast("bigint").alias("staged_row"),
        )
        .filter(F.col("key").isNotNull())
    )


def linked_entries(catalogue: DataFrame, links: DataFrame, key_kind: str, key_column: Column) -> DataFrame:
    """Entries reached through active mappings or aliases of an entity.

    ``links``: entity_type, entity_id, status and the columns of the key.
    """
    entity = catalogue.filter(F.col("key_kind") == "STABLE_ID").drop("key", "key_kind")
    active = links.filter(F.col("status") == "ACTIVE").select("entity_type", "entity_id", key_column.alias("key"))
    return (
        active.filter(F.col("key").isNotNull())
        .join(entity, ["entity_type", "entity_id"])
        .withColumn("key_kind", F.lit(key_kind))
        .select(*CATALOGUE_COLUMNS)
    )


def staged_entries(rows: DataFrame, entity_type: str, name_column: str) -> DataFrame:
    """Channel or rep names of earlier batches that are still under review."""
    usable = rows.filter((F.col("batch_status") == "READY_FOR_REVIEW") & F.col("status").isin("VALID", "WARNING"))
    return usable.select(
        F.lit(entity_type).alias("entity_type"),
        F.lit("NAME").alias("key_kind"),
        normalize_text(name_column).alias("key"),
        F.lit(None).cast("bigint").alias("entity_id"),
        F.lit(None).cast("string").alias("entity_stable_id"),
        normalize_text(name_column).alias("entity_name"),
        F.lit(True).alias("active"),
        F.col("batch_id").cast("string").alias("staged_batch"),
        F.col("row_number").cast("bigint").alias("staged_row"),
    ).filter(F.col("key").isNotNull())


def reference_catalogue(parts: Sequence[DataFrame]) -> DataFrame:
    whole = parts[0].select(*CATALOGUE_COLUMNS)
    for part in parts[1:]:
        whole = whole.unionByName(part.select(*CATALOGUE_COLUMNS))
    return whole


def _by_key(catalogue: DataFrame, entity_type: str, key_kind: str, masters_only: bool = False) -> DataFrame:
    """Per key: number of candidates, number of active ones, and one of each."""
    kept = catalogue.filter((F.col("entity_type") == entity_type) & (F.col("key_kind") == key_kind))
    if masters_only:
        kept = kept.filter(F.col("entity_stable_id").isNotNull())
    entity = F.struct("entity_id", "entity_stable_id", "entity_name", "active", "staged_batch", "staged_row")
    order = F.struct(F.coalesce("entity_id", F.lit(1 << 62)), F.coalesce("staged_batch", F.lit("")), F.coalesce("staged_row", F.lit(0)))
    return kept.groupBy("key").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if("active").alias("active_candidates"),
        F.min_by(entity, order).alias("only"),
        F.min_by(F.when(F.col("active"), entity), F.when(F.col("active"), order)).alias("only_active"),
    )


def master_reference(names: DataFrame, column: str, catalogue: DataFrame, entity_type: str) -> DataFrame:
    """Operational reference: exactly one active master has this normalised name.

    Distinct ``column`` -> ``match`` (struct or NULL), ``method``, ``candidates``, ``inactive_only``.
    """
    hits = _by_key(catalogue.filter(F.col("staged_batch").isNull()), entity_type, "NAME")
    distinct = names.select(column).filter(F.col(column).isNotNull()).distinct()
    joined = distinct.withColumn("key", normalize_text(column)).join(hits, "key", "left")
    match = F.when(F.col("active_candidates") == 1, F.col("only_active"))
    return joined.select(
        column,
        match.alias("match"),
        F.when(match.isNotNull(), "EXACT_ACTIVE_MASTER_NAME").alias("method"),
        F.coalesce("candidates", F.lit(0)).alias("candidates"),
        F.coalesce((F.col("candidates") > 0) & (F.col("active_candidates") == 0), F.lit(False)).alias("inactive_only"),
    )


def reference(names: DataFrame, column: str, catalogue: DataFrame, entity_type: str, bootstrap: bool) -> DataFrame:
    """Reference by one active alias, else (bootstrap) by one active name.

    Same output as :func:`master_reference`; staged names count here.
    """
    distinct = names.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("key", normalize_text(column))
    alias = _by_key(catalogue, entity_type, "ALIAS").select("key", F.struct("*").alias("a"))
    named = _by_key(catalogue, entity_type, "NAME").select("key", F.struct("*").alias("n"))
    joined = distinct.join(alias, "key", "left").join(named, "key", "left")
    by_alias = F.when(F.col("a.active_candidates") == 1, F.col("a.only_active"))
    by_name = F.when(F.lit(bootstrap) & (F.col("n.active_candidates") == 1), F.col("n.only_active"))
    method = (
        F.when(by_alias.isNotNull(), "CONFIRMED_ALIAS")
        .when(by_name["staged_batch"].isNotNull(), "STAGED_NORMALIZED_NAME")
        .when(by_name.isNotNull(), "NORMALIZED_NAME")
    )
    counts = F.when(by_alias.isNotNull(), F.col("a.candidates")).otherwise(F.col("n.candidates"))
    return joined.select(
        column,
        F.coalesce(by_alias, by_name).alias("match"),
        method.alias("method"),
        F.coalesce(counts, F.lit(0)).alias("candidates"),
        F.coalesce((F.col("n.candidates") > 0) & (F.col("n.active_candidates") == 0), F.lit(False)).alias("inactive_only"),
    )


def identity(
    rows: DataFrame,
    catalogue: DataFrame,
    entity_type: str,
    stable_column: str | None,
    code_column: str | None,
    name_column: str | None,
    bootstrap: bool,
    folded: bool = False,
) -> DataFrame:
    """Rows with ``entity`` and ``entity_candidates``.

    Steps: stable id, external code, code, alias, name (bootstrap only). A
    given stable id decides alone; a step with several hits ends the search.
    """
    fold = fold_key if folded else normalize_text
    absent = F.lit(None).cast("string")
    keys = {
        "STABLE_ID": normalize_text(stable_column) if stable_column else absent,
        "EXTERNAL_CODE": fold(code_column) if code_column else absent,
        "CODE": fold(code_column) if code_column else absent,
        "ALIAS": fold(name_column) if name_column else absent,
        "NAME": fold(name_column) if name_column else absent,
    }
    joined = rows
    for kind, key in keys.items():
        hits = _by_key(catalogue, entity_type, kind, masters_only=kind == "NAME").select(
            F.col("key").alias(f"_k_{kind}"), F.struct("candidates", "only").alias(f"_h_{kind}")
        )
        joined = joined.withColumn(f"_q_{kind}", key)
        joined = joined.join(hits, F.col(f"_q_{kind}") == F.col(f"_k_{kind}"), "left")
    by_id = F.col("_q_STABLE_ID").isNotNull()
    entity = F.when(by_id, F.col("_h_STABLE_ID.only"))
    candidates = F.when(by_id, F.coalesce("_h_STABLE_ID.candidates", F.lit(0)))
    for kind in ("EXTERNAL_CODE", "CODE", "ALIAS"):
        count = F.col(f"_h_{kind}.candidates")
        entity = entity.when(count == 1, F.col(f"_h_{kind}.only")).when(count > 1, F.lit(None))
        candidates = candidates.when(count >= 1, count)
    count = F.coalesce("_h_NAME.candidates", F.lit(0))
    entity = entity.when(F.lit(bootstrap) & (count == 1), F.col("_h_NAME.only"))
    candidates = candidates.otherwise(count)
    return joined.select(*rows.columns, entity.alias("entity"), candidates.alias("entity_candidates"))


def proposed_action(entity: str, pairs: dict[str, str]) -> Column:
    """NEW without entity; else UNCHANGED or UPDATE by normalised comparison.

    ``pairs``: source column -> master column.
    """
    same = F.lit(True)
    for source, master in pairs.items():
        same = same & normalize_text(F.col(source).cast("string")).eqNullSafe(normalize_text(F.col(master).cast("string")))
    return F.when(F.col(entity).isNull(), "NEW").when(same, "UNCHANGED").otherwise("UPDATE")
