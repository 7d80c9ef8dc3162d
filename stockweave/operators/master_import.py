"""Master-data imports: identity rules, references, duplicates, plans.

Rows come from :func:`stockweave.sources.contracts.normalize_rows`: batch_id,
row_number, the contract's fields, ``raw`` and ``errors``. Each step appends
findings and may set ``action``; ``findings.finalize`` closes a row. A batch is
part of every within-file key, so many batches are evaluated in one job.

Groups of duplicates are never gathered: their size comes from a partial
aggregate, and a finding names the group by key (see ``findings``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.functions.text import blank_to_null, casefold, collated, fold_key, normalize_text
from stockweave.operators.findings import finding, no_findings, raise_severity, with_findings
from stockweave.operators.groups import attach_group
from stockweave.operators.resolution import identity, master_reference, proposed_action, reference
from stockweave.sources.contracts import Contract, normalize_rows
from stockweave.sources.staging import stage

BATCH = "batch_id"
ROW = ["batch_id", "row_number"]


def start_rows(normalized: DataFrame, contract: Contract) -> DataFrame:
    """Type and required-field findings; the action starts as NEW.

    A failed date is a warning, a failed code or other value an error.
    """
    rules = []
    for item in contract.fields:
        failed = F.col("errors").getItem(item.name).isNotNull()
        if item.kind == "date":
            rules.append(finding(failed, "MDM_IMPORT_DATE_INVALID", severity="WARNING", field=item.name))
        elif item.kind == "code":
            rules.append(finding(failed, "MDM_IMPORT_CODE_NOT_STRING_SAFE", field=item.name))
        else:
            rules.append(finding(failed, "MDM_IMPORT_VALUE_INVALID", field=item.name))
    rules += [finding(F.col(f.name).isNull(), "MDM_IMPORT_REQUIRED_FIELD_MISSING", field=f.name) for f in contract.fields if f.required]
    return with_findings(normalized.withColumn("findings", no_findings()), rules).withColumn("action", F.lit("NEW"))


def block_invalid_dates(rows: DataFrame) -> DataFrame:
    """SKU and goods imports: an unreadable date blocks the row."""
    return raise_severity(rows, "MDM_IMPORT_DATE_INVALID", "ERROR")


def _set_action(rows: DataFrame, when: Column, action: str) -> DataFrame:
    return rows.withColumn("action", F.when(F.coalesce(when, F.lit(False)), action).otherwise(F.col("action")))


def with_group_size(rows: DataFrame, key: Column, name: str, distinct: Column | None = None, source: DataFrame | None = None) -> DataFrame:
    """Adds ``_{name}_key`` and ``_{name}_rows``: size of the row's group in its batch.

    ``distinct`` also adds ``_{name}_values``, the number of different values.
    """
    keyed = rows.withColumn(f"_{name}_key", key)
    measures = {f"_{name}_rows": F.count(F.lit(1))}
    if distinct is not None:
        # NULL counts as a value of its own.
        measures[f"_{name}_values"] = F.count_distinct(F.coalesce(distinct, F.lit("\u0000")))
    base = None if source is None else source.withColumn(f"_{name}_key", key)
    return attach_group(keyed, [BATCH, f"_{name}_key"], measures, ROW, having=F.col(f"_{name}_rows") > 1, source=base)


def _drop_helpers(rows: DataFrame) -> DataFrame:
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


def differences(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """Map of the fields whose source and master value differ, as JSON pairs."""
    entries = []
    for name, (source, master) in pairs.items():
        source, master = source.cast("string"), master.cast("string")
        pair = F.to_json(F.struct(source.alias("source"), master.alias("master")), {"ignoreNullFields": "false"})
        entries.append(F.struct(F.lit(name).alias("key"), F.when(~source.eqNullSafe(master), pair).alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


# --- customers -------------------------------------------------------------

CUSTOMER_FIELDS = (
    "organization",
    "department",
    "business_type",
    "market_type",
    "format_type",
    "channel_detail",
    "is_direct",
    "source_created_ym",
)


REFERENCES = ("channel", "salesrep", "region", "province", "parent_customer")


def existing_differences(rows: DataFrame, customer: DataFrame) -> DataFrame:
    """What an EXISTING customer row says otherwise than its master, and both snapshots.

    ``rows``: batch_id, row_number, matched_stable_id, customer_code and name,
    the fields of :data:`CUSTOMER_FIELDS`, and for each reference its source
    text (``<name>_ref``) and the stable id it was resolved to. ``customer``
    has the same fields, ``<name>_stable_id`` and ``<name>_name`` of each
    reference, and customer_status. ``differences`` maps a field or reference
    to both values; the snapshots are JSON.
    """
    own = ("customer_code", "customer_name", *CUSTOMER_FIELDS)
    ids = tuple(f"{r}_stable_id" for r in REFERENCES)
    stored = customer.select(F.col("customer_stable_id").alias("matched_stable_id"), *[F.col(c).alias(f"_m_{c}") for c in (*own, *ids, *[f"{r}_name" for r in REFERENCES], "customer_status")])
    joined = rows.join(stored, "matched_stable_id")
    changed = differences({c: (F.col(c), F.col(f"_m_{c}")) for c in (*CUSTOMER_FIELDS, *ids)})

    def snapshot(prefix: str, shown: dict[str, str], *more: Column) -> Column:
        references = [F.struct(F.col(f"{prefix}{text}").alias(label), F.col(f"{prefix}{r}_stable_id").alias("stable_id")).alias(r) for r in REFERENCES for label, text in [(shown["label"], shown["text"].format(r))]]
        return F.to_json(F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in (*own, *ids)], F.struct(*references).alias("references"), *more), {"ignoreNullFields": "false"})

    source = snapshot("", {"label": "value", "text": "{}_ref"})
    master = snapshot("_m_", {"label": "name", "text": "{}_name"}, F.col("matched_stable_id").alias("stable_id"), F.col("_m_customer_status").alias("status"))
    return joined.select("batch_id", "row_number", changed.alias("differences"), source.alias("source_snapshot"), master.alias("master_snapshot"))


def customer_identity(rows: DataFrame, customer: DataFrame) -> DataFrame:
    """Existing, code conflict and name conflict against the masters.

    Codes are equal under the collation, names after normalisation. A row is
    EXISTING when its code names one master and that master has its name; its
    earlier findings then move into the details of that finding.
    """
    fields = [c for c in CUSTOMER_FIELDS if c in customer.columns and c in rows.columns]
    # One spelling stands for all codes equal under the collation.
    spelled = customer.withColumn("_code", collated(normalize_text("customer_code"))).withColumn("_name", normalize_text("customer_name"))
    by_code = spelled.groupBy("_code").agg(
        F.count(F.lit(1)).alias("_code_hits"), F.min_by(F.struct("customer_id", "customer_stable_id", "_name", *fields), "customer_id").alias("_m")
    )
    plain = customer.select(normalize_text("customer_code").alias("_pc"), normalize_text("customer_name").alias("_pn"))
    by_name = plain.groupBy("_pn").agg(F.count(F.lit(1)).alias("_name_hits"))
    by_both = plain.groupBy("_pn", "_pc").agg(F.count(F.lit(1)).alias("_own_hits"))

    keyed = rows.withColumn("_ckey", collated("customer_code"))
    joined = (
        keyed.join(by_code, F.col("_ckey") == F.col("_code"), "left")
        .join(by_name, F.col("customer_name") == F.col("_pn"), "left")
        .drop("_pn")
        .join(by_both, (F.col("customer_name") == F.col("_pn")) & (F.col("customer_code") == F.col("_pc")), "left")
    )
    existing = F.coalesce((F.col("_code_hits") == 1) & (F.col("_m._name") == F.col("customer_name")), F.lit(False))
    code_taken = ~existing & (F.col("_code_hits") > 0)
    other_codes = F.coalesce("_name_hits", F.lit(0)) - F.coalesce("_own_hits", F.lit(0))
    name_elsewhere = ~existing & (other_codes > 0)
    changed = differences({c: (F.col(c), F.col(f"_m.{c}")) for c in fields}) if fields else F.create_map().cast("map<string,string>")
    cleared = joined.withColumn("_old", F.col("findings")).withColumn("findings", F.when(existing, no_findings()).otherwise(F.col("findings")))
    details = F.map_concat(
        F.create_map(F.lit("target"), F.col("_m.customer_stable_id"), F.lit("source_findings"), F.to_json(F.col("_old"))), changed
    )
    found = with_findings(
        cleared,
        [
            finding(existing, "MDM_IMPORT_CUSTOMER_EXISTING", severity="INFO", resolved=True, details=details),
            finding(code_taken, "MDM_IMPORT_CUSTOMER_CODE_CONFLICT", field="customer_code", candidate_key=F.col("customer_code"), candidate_count=F.col("_code_hits")),
            finding(
                name_elsewhere, "MDM_IMPORT_CUSTOMER_NAME_CONFLICT", severity="WARNING", field="customer_name", candidate_key=F.col("customer_name"), candidate_count=other_codes
            ),
        ],
    )
    found = found.withColumn("matched_id", F.when(existing, F.col("_m.customer_id"))).withColumn(
        "matched_stable_id", F.when(existing, F.col("_m.customer_stable_id"))
    )
    return _drop_helpers(_set_action(_set_action(found, code_taken, "CONFLICT"), existing, "EXISTING"))


def customer_file_duplicates(rows: DataFrame) -> DataFrame:
    """Within the file: a repeated code blocks every occurrence; one name with
    several codes is a warning. Reads ``rows`` several times: pass a stored table."""
    # Codes equal under the collation share the smallest spelling as group key.
    spelling = (
        rows.select(BATCH, "customer_code")
        .filter(F.col("customer_code").isNotNull())
        .distinct()
        .withColumn("_c", collated("customer_code"))
    )
    shared = spelling.groupBy(BATCH, "_c").agg(F.min("customer_code").alias("_spelling"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    alias = spelling.join(shared, [BATCH, "_c"]).select(BATCH, "customer_code", "_spelling")
    keyed = rows.join(alias, [BATCH, "customer_code"], "left").withColumn("_spelling", F.coalesce("_spelling", "customer_code"))
    sized = with_group_size(keyed, F.col("_spelling"), "code", distinct=F.col("customer_name"))
    repeated = F.col("_code_rows") > 1
    code = F.when(F.col("_code_values") == 1, "MDM_IMPORT_DUPLICATE_EXACT").otherwise("MDM_IMPORT_CUSTOMER_CODE_CONFLICT")
    sized = with_findings(sized, [finding(repeated, code, candidate_key=F.col("_code_key"), candidate_count=F.col("_code_rows"))])
    sized = _drop_helpers(_set_action(sized, repeated, "CONFLICT"))
    sized = with_group_size(sized, F.col("customer_name"), "name", distinct=F.col("customer_code"), source=rows)
    several = (F.col("_name_values") > 1) & (F.col("action") != "EXISTING")
    return _drop_helpers(
        with_findings(
            sized,
            [
                finding(
                    several, "MDM_IMPORT_CUSTOMER_NAME_CONFLICT", severity="WARNING", field="customer_name", candidate_key=F.col("_name_key"), candidate_count=F.col("_name_rows")
                )
            ],
        )
    )


def operational_references(rows: DataFrame, catalogue: DataFrame, references: dict[str, tuple[str, str]], source: DataFrame | None = None) -> DataFrame:
    """Resolves references to the one active master of that name.

    ``references``: reference -> (column, entity type). Adds
    ``{reference}_stable_id``; inactive or unresolved names are errors unless
    the row already exists. Reads the names once per reference: pass a stored
    table, or as ``source`` the one that ``rows`` is a longer plan over.
    """
    base = rows if source is None else source
    for name, (column, entity_type) in references.items():
        resolved = master_reference(base, column, catalogue, entity_type).select(
            column, F.col("match.entity_stable_id").alias(f"{name}_stable_id"), F.col("inactive_only").alias("_inactive"), F.col("candidates").alias("_hits")
        )
        joined = rows.join(resolved, column, "left")
        missing = F.col(column).isNotNull() & F.col(f"{name}_stable_id").isNull() & (F.col("action") != "EXISTING")
        code = F.when(F.col("_inactive"), "MDM_IMPORT_INACTIVE_REFERENCE").otherwise("MDM_IMPORT_REFERENCE_UNRESOLVED")
        rows = _drop_helpers(with_findings(joined, [finding(missing, code, field=column, candidate_key=F.col(column), candidate_count=F.col("_hits"))]))
    return rows


def _unique_names(rows: DataFrame) -> DataFrame:
    """Names that occur once in their batch, with the row that has them."""
    return (
        rows.filter(F.col("customer_name").isNotNull())
        .groupBy(BATCH, F.col("customer_name").alias("parent_customer_ref"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min("row_number").alias("parent_row"), F.min("matched_stable_id").alias("_parent_sid"))
        .filter("_n = 1")
        .drop("_n")
    )


def customer_parents(rows: DataFrame, catalogue: DataFrame, bootstrap: bool = False, source: DataFrame | None = None) -> DataFrame:
    """Parent of each customer: itself (root), a unique name of the batch, a
    master, or unresolved (a warning; the final parent is NULL). Reads names and
    matched masters several times: pass a stored table, or as ``source`` the one
    that ``rows`` is a longer plan over."""
    base = rows if source is None else source
    if bootstrap:
        masters = reference(base, "parent_customer_ref", catalogue, "CUSTOMER", bootstrap=True)
    else:
        masters = master_reference(base, "parent_customer_ref", catalogue, "CUSTOMER")
    masters = masters.select("parent_customer_ref", F.col("match.entity_stable_id").alias("_master"), F.col("candidates").alias("_hits"))
    joined = rows.join(_unique_names(base), [BATCH, "parent_customer_ref"], "left").join(masters, "parent_customer_ref", "left")
    parent = F.col("parent_customer_ref")
    resolution = (
        F.when(parent.isNull(), "EMPTY")
        .when(parent == F.col("customer_name"), "ROOT_SOURCE_SELF")
        .when(F.col("parent_row").isNotNull() | F.col("_master").isNotNull(), "RESOLVED")
        .otherwise("UNRESOLVED")
    )
    linked = joined.withColumn("parent_resolution", resolution)
    resolved = F.col("parent_resolution") == "RESOLVED"
    target = F.when(F.col("parent_row").isNotNull(), F.col("_parent_sid")).otherwise(F.col("_master"))
    linked = linked.withColumn("parent_row", F.when(resolved, F.col("parent_row"))).withColumn("parent_stable_id", F.when(resolved, target))
    own = resolved & F.col("matched_stable_id").isNotNull() & (F.col("parent_stable_id") == F.col("matched_stable_id"))
    rules = [
        finding(
            (F.col("parent_resolution") == "UNRESOLVED") & (F.col("action") != "EXISTING"),
            "MDM_IMPORT_PARENT_UNRESOLVED",
            severity="WARNING",
            field="parent_customer_ref",
            candidate_key=parent,
            candidate_count=F.col("_hits"),
        )
    ]
    if bootstrap:
        rules.append(finding(own, "MDM_IMPORT_PARENT_SELF", field="parent_customer_ref"))
    return _drop_helpers(with_findings(linked, rules))


def cycle_rows(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """Children that lie on a cycle, not those merely leading to one.

    Every child has at most one parent. After 2^k steps along the edges only
    cycle members are still hit once all tails are shorter than 2^k, so the
    edges are doubled (a self-join per round) until the set of nodes reached
    stops shrinking. Each round is written to the shared folder, which cuts the
    lineage; there are about log2(longest tail) rounds.
    """
    jumps = stage(edges.select(F.col(child).alias("a"), F.col(parent).alias("b")).filter("a is not null and b is not null"))
    reached = None
    while True:
        count = jumps.agg(F.count_distinct("b")).first()[0]
        if count == 0 or count == reached:
            return jumps.select(F.col("b").alias(child)).distinct()
        reached = count
        onward = jumps.select(F.col("a").alias("b"), F.col("b").alias("c"))
        jumps = stage(jumps.join(onward, "b").select("a", F.col("c").alias("b")))


def parent_cycles(rows: DataFrame) -> DataFrame:
    """Rows on a parent cycle within their batch get an error.

    Edges of existing rows do not count.
    """
    node = F.struct(BATCH, "row_number")
    edges = rows.filter(F.col("parent_row").isNotNull() & (F.col("action") != "EXISTING")).select(
        node.alias("child"), F.struct(F.col(BATCH), F.col("parent_row").alias("row_number")).alias("parent")
    )
    looped = cycle_rows(edges).select("child.*").withColumn("_loop", F.lit(True))
    joined = rows.join(looped, ROW, "left")
    return _drop_helpers(with_findings(joined, [finding(F.col("_loop"), "MDM_IMPORT_PARENT_CYCLE", field="parent_customer_ref")]))


def evaluate_customers(raw: DataFrame, contract: Contract, customer: DataFrame, catalogue: DataFrame, references: dict[str, tuple[str, str]]) -> DataFrame:
    """A customer file from text to findings, action and references.

    The steps after the masters read names several times, which none of them
    changes: they take these from one stored table and are one plan over it, so
    each row is written once and a caller's columns are all that is shuffled.
    """
    matched = stage(customer_identity(start_rows(normalize_rows(raw, contract), contract), customer))
    rows = customer_file_duplicates(matched)
    rows = operational_references(rows, catalogue, references, matched)
    return customer_parents(rows, catalogue, source=matched)


# --- products --------------------------------------------------------------


def product_identity(rows: DataFrame, product: DataFrame) -> DataFrame:
    """Existing, code conflict, same name elsewhere, duplicates in the file."""
    keyed = product.withColumn("_pc", fold_key("product_code")).withColumn("_pn", fold_key("product_name"))
    by_code = keyed.groupBy("_pc").agg(F.count(F.lit(1)).alias("_code_hits"))
    by_both = keyed.groupBy(F.col("_pc").alias("_bc"), F.col("_pn").alias("_bn")).agg(
        F.count(F.lit(1)).alias("_exact"), F.min_by(F.struct("product_id", "product_stable_id", "brand"), "product_id").alias("_m")
    )
    by_name = keyed.groupBy(F.col("_pn").alias("_nn")).agg(F.count(F.lit(1)).alias("_name_hits"))
    joined = (
        rows.withColumn("_code", casefold("product_code"))
        .withColumn("_name", F.coalesce(casefold("product_name"), F.lit("")))
        .join(by_code, F.col("_code") == F.col("_pc"), "left")
        .join(by_both, (F.col("_code") == F.col("_bc")) & (F.col("_name") == F.coalesce("_bn", F.lit(""))), "left")
        .join(by_name, F.col("_name") == F.col("_nn"), "left")
    )
    existing = F.coalesce((F.col("_code_hits") > 0) & (F.col("_exact") == 1), F.lit(False))
    conflict = (F.col("_code_hits") > 0) & ~existing
    elsewhere = F.col("_code_hits").isNull() & (F.col("_name_hits") > 0)
    details = F.map_concat(F.create_map(F.lit("target"), F.col("_m.product_stable_id")), differences({"brand": (F.col("brand"), F.col("_m.brand"))}))
    found = with_findings(
        joined,
        [
            finding(existing, "MDM_IMPORT_PRODUCT_EXISTING", severity="INFO", resolved=True, details=details),
            finding(conflict, "MDM_IMPORT_PRODUCT_CODE_CONFLICT", field="product_code", candidate_key=F.col("_code"), candidate_count=F.col("_code_hits")),
            finding(elsewhere, "MDM_IMPORT_PRODUCT_NAME_CONFLICT", severity="WARNING", field="product_name", candidate_key=F.col("_name"), candidate_count=F.col("_name_hits")),
        ],
    ).withColumn("matched_stable_id", F.when(existing, F.col("_m.product_stable_id")))
    found = _drop_helpers(_set_action(_set_action(found, conflict, "CONFLICT"), existing, "EXISTING"))
    return duplicate_codes(found, "product_code")


def duplicate_codes(rows: DataFrame, column: str) -> DataFrame:
    """A code repeated in the file (ignoring case) blocks every occurrence."""
    sized = with_group_size(rows, casefold(column), "code")
    repeated = F.col("_code_rows") > 1
    found = with_findings(
        sized, [finding(repeated, "MDM_IMPORT_DUPLICATE_UNIQUE_CODE", field=column, candidate_key=F.col("_code_key"), candidate_count=F.col("_code_rows"))]
    )
    return _drop_helpers(_set_action(found, repeated, "CONFLICT"))


# --- SKUs ------------------------------------------------------------------

SKU_FIELDS = (
    "product_group",
    "product_form",
    "origin",
    "category_l1",
    "category_l2",
    "category_l3",
    "category_l4",
    "short_name",
    "category_extra",
    "case_pack",
    "source_created_at",
)


def _value_key(value: Column) -> Column:
    return F.coalesce(casefold(blank_to_null(value.cast("string"))), F.lit(""))


def _loose_differences(fields: list[str], master: str) -> Column:
    """Like :func:`differences`, but case and edge spaces do not count."""
    entries = []
    for name in fields:
        source, stored = F.col(name), F.col(f"{master}.{name}")
        pair = F.to_json(F.struct(source.cast("string").alias("source"), stored.cast("string").alias("master")), {"ignoreNullFields": "false"})
        entries.append(F.struct(F.lit(name).alias("key"), F.when(_value_key(source) != _value_key(stored), pair).alias("value")))
    if not entries:
        return F.create_map().cast("map<string,string>")
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def _sku_masters(sku: DataFrame, fields: list[str]) -> DataFrame:
    """Master SKU per folded code, only where the code names a single one."""
    kept = F.struct("sku_id", "sku_stable_id", "sku_name", "product_id", *fields)
    return (
        sku.withColumn("_mk", fold_key("sku_code"))
        .groupBy("_mk")
        .agg(F.count(F.lit(1)).alias("_n"), F.min_by(kept, "sku_id").alias("_m"))
        .filter("_n = 1")
        .drop("_n")
    )


def sku_identity(rows: DataFrame, sku: DataFrame, catalogue: DataFrame) -> DataFrame:
    """SKU import: product reference, then identity, then duplicates in the file."""
    fields = [c for c in SKU_FIELDS if c in rows.columns and c in sku.columns]
    found = identity(rows, catalogue, "PRODUCT", None, "product_code_ref", None, bootstrap=False, folded=True)
    given = F.col("product_code_ref").isNotNull()
    active = F.coalesce(F.col("entity.active"), F.lit(False))
    found = with_findings(
        found,
        [
            finding(given & F.col("entity").isNull(), "MDM_IMPORT_REFERENCE_UNRESOLVED", field="product_code_ref", candidate_key=F.col("product_code_ref"), candidate_count=F.col("entity_candidates")),
            finding(given & F.col("entity").isNotNull() & ~active, "MDM_IMPORT_INACTIVE_REFERENCE", field="product_code_ref", candidate_key=F.col("product_code_ref"), candidate_count=F.lit(1)),
        ],
    )
    found = found.withColumn("product_id", F.when(active, F.col("entity.entity_id"))).drop("entity", "entity_candidates")
    joined = found.withColumn("_code", casefold("sku_code")).join(_sku_masters(sku, fields), F.col("_code") == F.col("_mk"), "left")
    both = F.col("_m").isNotNull() & F.col("product_id").isNotNull()
    other_product = both & ~F.col("_m.product_id").eqNullSafe(F.col("product_id"))
    same_name = F.coalesce(casefold("sku_name"), F.lit("")) == F.coalesce(casefold("_m.sku_name"), F.lit(""))
    other_name = both & ~other_product & ~same_name
    existing = both & ~other_product & same_name
    details = F.map_concat(F.create_map(F.lit("target"), F.col("_m.sku_stable_id")), _loose_differences(fields, "_m"))
    found = with_findings(
        joined,
        [
            finding(other_product, "MDM_IMPORT_SKU_PRODUCT_CONFLICT", field="product_code_ref", candidate_key=F.col("_code"), candidate_count=F.lit(1)),
            finding(other_name, "MDM_IMPORT_SKU_CODE_CONFLICT", field="sku_name", candidate_key=F.col("_code"), candidate_count=F.lit(1)),
            finding(existing, "MDM_IMPORT_SKU_EXISTING", severity="INFO", resolved=True, details=details),
        ],
    ).withColumn("matched_stable_id", F.when(existing, F.col("_m.sku_stable_id")))
    found = _drop_helpers(_set_action(_set_action(found, other_product | other_name, "CONFLICT"), existing, "EXISTING"))
    return duplicate_codes(found, "sku_code")


# --- goods (product + SKU in one file) -------------------------------------

PLAN_ATTRIBUTES = ("product_form", "category_l1", "category_l2", "product_name", "brand")


def goods_plans(rows: DataFrame, product: DataFrame) -> DataFrame:
    """One plan per product code of a batch: EXISTING, UNRESOLVED or CREATE.

    A CREATE plan needs at most one value per product attribute and a name: the
    explicit one, else that of the only row whose SKU code is the product code.
    The values come from min/max aggregates, no group is gathered.
    """
    key = casefold("product_code")
    keyed = rows.filter(F.col("product_code").isNotNull()).withColumn("plan_key", key)
    own = F.coalesce(casefold("sku_code"), F.lit("")) == F.col("plan_key")
    values = {f"_lo_{c}": F.min(c) for c in PLAN_ATTRIBUTES} | {f"_hi_{c}": F.max(c) for c in PLAN_ATTRIBUTES}
    plans = keyed.groupBy(BATCH, "plan_key").agg(
        F.min_by("product_code", "row_number").alias("plan_code"),
        F.count(F.lit(1)).alias("plan_rows"),
        F.count_if(own).alias("_own"),
        F.min(F.when(own, F.col("row_number"))).alias("_own_row"),
        F.min_by(F.when(own, F.col("sku_name")), F.when(own, F.col("row_number"))).alias("_own_name"),
        *[value.alias(name) for name, value in values.items()],
    )
    masters = product.withColumn("_mk", fold_key("product_code")).groupBy("_mk").agg(
        F.count(F.lit(1)).alias("_masters"),
        F.min_by(F.struct("product_id", "product_stable_id", "product_name", "brand", "product_status"), "product_id").alias("_m"),
    )
    joined = plans.join(masters, F.col("plan_key") == F.col("_mk"), "left")
    conflicts = F.filter(
        F.array(*[F.when(F.col(f"_lo_{c}") != F.col(f"_hi_{c}"), F.lit(c)) for c in PLAN_ATTRIBUTES]), lambda c: c.isNotNull()
    )
    declared = F.when(F.col("_lo_product_name") == F.col("_hi_product_name"), F.col("_lo_product_name"))
    name = F.coalesce(declared, F.when(F.col("_own") == 1, F.col("_own_name")))
    create = F.col("_masters").isNull()
    conflicting = F.size(conflicts) > 0
    kind = F.when(F.col("_masters") > 1, "UNRESOLVED").when(create, "CREATE").otherwise("EXISTING")
    problem = (
        F.when(F.col("_masters") > 1, "MDM_IMPORT_REFERENCE_UNRESOLVED")
        .when(create & conflicting, "MDM_IMPORT_PRODUCT_ATTR_CONFLICT")
        .when(create & name.isNull(), "MDM_IMPORT_PRODUCT_NAME_REQUIRED")
        .when((F.col("_masters") == 1) & (F.col("_m.product_status") != "ACTIVE"), "MDM_IMPORT_INACTIVE_REFERENCE")
    )
    usable = create & ~conflicting
    return joined.select(
        BATCH,
        "plan_key",
        "plan_code",
        kind.alias("plan_action"),
        problem.alias("plan_problem"),
        F.when(create, conflicts).alias("conflict_fields"),
        F.when(usable, name).when(kind == "EXISTING", F.col("_m.product_name")).alias("plan_name"),
        F.when(usable & (F.col("_lo_brand") == F.col("_hi_brand")), F.col("_lo_brand")).when(kind == "EXISTING", F.col("_m.brand")).alias("plan_brand"),
        F.when(usable & name.isNotNull() & (F.col("_own") == 1), F.col("_own_row")).alias("representative_row"),
        F.when(kind == "EXISTING", F.col("_m.product_id")).alias("plan_product_id"),
        F.when(kind == "EXISTING", F.col("_m.product_stable_id")).alias("plan_product_stable_id"),
        "plan_rows",
    )


def goods_identity(rows: DataFrame, sku: DataFrame, product: DataFrame) -> DataFrame:
    """Goods import: group plan, SKU identity against it, duplicates."""
    fields = [c for c in SKU_FIELDS if c in rows.columns and c in sku.columns]
    plans = goods_plans(rows, product)
    planned = rows.withColumn("plan_key", casefold("product_code")).join(plans, [BATCH, "plan_key"], "left")
    problem = F.col("plan_problem")
    field = F.when(problem == "MDM_IMPORT_PRODUCT_NAME_REQUIRED", "product_name").otherwise("product_code")
    details = F.create_map(F.lit("product_code"), F.col("plan_code"), F.lit("conflict_fields"), F.array_join("conflict_fields", ","))
    broken = finding(problem.isNotNull(), problem, candidate_key=F.col("plan_key"), candidate_count=F.col("plan_rows"), details=details)
    planned = _set_action(with_findings(planned, [broken.withField("field", field)]), problem.isNotNull(), "CONFLICT")

    joined = planned.withColumn("_code", casefold("sku_code")).join(_sku_masters(sku, fields), F.col("_code") == F.col("_mk"), "left")
    # Rows without a plan, or with an inactive product, are not judged further.
    judged = F.col("_m").isNotNull() & F.col("plan_action").isin("CREATE", "EXISTING") & ~problem.eqNullSafe(F.lit("MDM_IMPORT_INACTIVE_REFERENCE"))
    other_product = judged & ((F.col("plan_action") == "CREATE") | ~F.col("_m.product_id").eqNullSafe(F.col("plan_product_id")))
    same_name = F.coalesce(fold_key("sku_name"), F.lit("")) == F.coalesce(fold_key("_m.sku_name"), F.lit(""))
    other_name = judged & ~other_product & ~same_name
    existing = judged & ~other_product & same_name
    raw_name = F.coalesce(F.col("raw").getItem("sku_name"), F.lit(""))
    format_only = existing & (raw_name != F.coalesce("_m.sku_name", F.lit("")))
    declared = F.coalesce(_value_key(F.col("product_name")), F.lit(""))
    renamed = F.when(
        (declared != "") & (declared != _value_key(F.col("plan_name"))),
        F.create_map(F.lit("product_name"), F.to_json(F.struct(F.col("product_name").alias("source"), F.col("plan_name").alias("master")))),
    ).otherwise(F.create_map().cast("map<string,string>"))
    details = F.map_concat(F.create_map(F.lit("target"), F.col("_m.sku_stable_id")), _loose_differences(fields, "_m"), renamed)
    names = F.create_map(F.lit("source_sku_name"), raw_name, F.lit("master_sku_name"), F.col("_m.sku_name"))
    found = with_findings(
        joined,
        [
            finding(other_product, "MDM_IMPORT_SKU_PRODUCT_CONFLICT", field="product_code", candidate_key=F.col("_code"), candidate_count=F.lit(1)),
            finding(other_name, "MDM_IMPORT_SKU_CODE_CONFLICT", field="sku_name", candidate_key=F.col("_code"), candidate_count=F.lit(1)),
            finding(format_only, "MDM_IMPORT_SKU_NAME_FORMAT_DIFFERENCE", severity="INFO", field="sku_name", details=names),
            finding(existing, "MDM_IMPORT_SKU_EXISTING", severity="INFO", resolved=True, details=details),
        ],
    ).withColumn("matched_stable_id", F.when(existing, F.col("_m.sku_stable_id")))
    found = _drop_helpers(_set_action(_set_action(found, other_product | other_name, "CONFLICT"), existing, "EXISTING"))
    return duplicate_codes(found, "sku_code")


# --- bootstrap imports -----------------------------------------------------


def mark_exact_duplicates(rows: DataFrame, fields: list[str]) -> DataFrame:
    """A row equal to an earlier one in every normalised field stays unchanged."""
    signature = F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)
    marked = attach_group(
        rows.withColumn("_sig", signature), [BATCH, "_sig"], {"_first": F.min("row_number"), "_n": F.count(F.lit(1))}, ROW, having=F.col("_n") > 1
    )
    later = F.col("row_number") > F.col("_first")
    details = F.create_map(F.lit("first_row"), F.col("_first").cast("string"))
    found = with_findings(marked, [finding(later, "MDM_IMPORT_DUPLICATE_EXACT", severity="INFO", details=details)])
    return _drop_helpers(_set_action(found, later, "UNCHANGED"))


def match_identity(
    rows: DataFrame, catalogue: DataFrame, entity_type: str, code: str | None, name: str, masters: DataFrame, pairs: dict[str, str], bootstrap: bool
) -> DataFrame:
    """Master of each row by the identity cascade, and the proposed action.

    ``masters``: entity_id and the columns compared; ``pairs``: source -> master column.
    """
    found = identity(rows, catalogue, entity_type, None, code, name, bootstrap, folded=entity_type == "PRODUCT")
    values = masters.select(F.col("entity_id").alias("_eid"), *[F.col(m).alias(f"_v_{m}") for m in set(pairs.values())])
    joined = found.join(values, F.col("entity.entity_id") == F.col("_eid"), "left")
    proposal = proposed_action("entity", {source: f"_v_{master}" for source, master in pairs.items()})
    action = (
        F.when(F.col("entity").isNotNull(), proposal).when(F.col("entity_candidates") > 1, "CONFLICT").otherwise(F.col("action"))
    )
    return _drop_helpers(
        joined.withColumn("action", action).withColumn("matched_stable_id", F.col("entity.entity_stable_id")).drop("entity", "entity_candidates")
    )


def bootstrap_channels(rows: DataFrame, bootstrap: bool = True) -> DataFrame:
    """A new channel needs confirmation; a repeated name is a conflict."""
    asked = rows
    if bootstrap:
        asked = with_findings(rows, [finding(F.col("action") == "NEW", "MDM_IMPORT_CHANNEL_BOOTSTRAP_REQUIRED", severity="WARNING", field="channel_name")])
    return _repeated_names(asked, "channel_name", "MDM_IMPORT_POSSIBLE_DUPLICATE_NAME")


def bootstrap_salesreps(rows: DataFrame) -> DataFrame:
    return _repeated_names(rows, "salesrep_name", "MDM_IMPORT_SALESREP_AMBIGUOUS")


def _repeated_names(rows: DataFrame, column: str, code: str) -> DataFrame:
    sized = with_group_size(rows, F.col(column), "name")
    repeated = F.col("_name_rows") > 1
    found = with_findings(sized, [finding(repeated, code, severity="WARNING", field=column, candidate_key=F.col("_name_key"), candidate_count=F.col("_name_rows"))])
    return _drop_helpers(_set_action(found, repeated, "CONFLICT"))


def bootstrap_customers(rows: DataFrame, catalogue: DataFrame, exclusions: DataFrame, historical: DataFrame) -> DataFrame:
    """Bootstrap customers: duplicate codes stay apart with a warning; channel
    and rep references; governance exclusions and historical channels.

    ``exclusions``: source_value, classification, exclusion_reason.
    ``historical``: channel_name, reason. Adds ``excluded``.
    """
    sized = with_group_size(rows, F.col("customer_code"), "code")
    rows = _drop_helpers(
        with_findings(
            sized,
            [
                finding(
                    F.col("_code_rows") > 1,
                    "MDM_IMPORT_DUPLICATE_CUSTOMER_CODE",
                    severity="WARNING",
                    field="customer_code",
                    candidate_key=F.col("_code_key"),
                    candidate_count=F.col("_code_rows"),
                )
            ],
        )
    )
    excluded = exclusions.groupBy(normalize_text("source_value").alias("channel_ref")).agg(F.min("classification").alias("_class"))
    past = historical.groupBy(normalize_text("channel_name").alias("channel_ref")).agg(F.lit(True).alias("_past"))
    channels = reference(rows, "channel_ref", catalogue, "CHANNEL", bootstrap=True).select(
        "channel_ref", F.col("match").alias("_channel"), F.col("candidates").alias("_ch"), F.col("inactive_only").alias("_ci")
    )
    reps = reference(rows, "salesrep_ref", catalogue, "SALESREP", bootstrap=True).select(
        "salesrep_ref", F.col("match").alias("_rep"), F.col("candidates").alias("_rh"), F.col("inactive_only").alias("_ri")
    )
    joined = rows.join(excluded, "channel_ref", "left").join(past, "channel_ref", "left").join(channels, "channel_ref", "left").join(reps, "salesrep_ref", "left")
    out = F.col("_class").isNotNull()
    kept = ~out & F.col("_past").isNotNull()
    open_channel = ~out & ~kept & F.col("_channel").isNull()
    hits, rep_hits = F.coalesce("_ch", F.lit(0)), F.coalesce("_rh", F.lit(0))
    channel_code = (
        F.when(F.coalesce("_ci", F.lit(False)), "MDM_IMPORT_INACTIVE_REFERENCE")
        .when(hits > 1, "MDM_IMPORT_CHANNEL_CONFLICT")
        .otherwise("MDM_IMPORT_CHANNEL_UNRESOLVED")
    )
    open_rep, rep_inactive = F.col("_rep").isNull(), F.coalesce("_ri", F.lit(False))
    found = with_findings(
        joined,
        [
            finding(out, "MDM_IMPORT_NON_SALES_EXCLUDED", severity="INFO", field="channel_ref", resolved=True),
            finding(kept, "MDM_IMPORT_HISTORICAL_CHANNEL", severity="INFO", field="channel_ref", resolved=True),
            finding(open_channel, channel_code, field="channel_ref", candidate_key=F.col("channel_ref"), candidate_count=hits),
            finding(open_rep & rep_inactive, "MDM_IMPORT_INACTIVE_REFERENCE", field="salesrep_ref", candidate_count=rep_hits),
            finding(open_rep & ~rep_inactive & (rep_hits > 1), "MDM_IMPORT_SALESREP_AMBIGUOUS", severity="WARNING", field="salesrep_ref", candidate_count=rep_hits),
            finding(open_rep & ~rep_inactive, "MDM_IMPORT_SALESREP_UNRESOLVED", field="salesrep_ref", candidate_count=rep_hits),
        ],
    )
    found = found.withColumns(
        {
            "excluded": out,
            "channel_stable_id": F.when(~out, F.col("_channel.entity_stable_id")),
            "salesrep_stable_id": F.col("_rep.entity_stable_id"),
        }
    )
    return _drop_helpers(found)


def bootstrap_skus(rows: DataFrame, merge_codes: DataFrame) -> DataFrame:
    """Bootstrap SKUs: product candidates, conflicting attributes, merge list.

    Missing optional fields are noted; a repeated code is a conflict.
    ``merge_codes``: source_product_code groups confirmed as one product.
    """
    compared = ("product_form", "category_l1", "category_l2")

    def raw_blank(name: str) -> Column:
        return blank_to_null(F.col("raw").getItem(name)).isNull()

    single = F.col("product_form").eqNullSafe(F.lit("单品"))
    noted = with_findings(
        rows,
        [
            finding(F.col("source_product_code").isNull(), "MDM_IMPORT_PRODUCT_CANDIDATE", severity="WARNING", field="source_product_code"),
            finding(raw_blank("short_name"), "MDM_IMPORT_FIELD_MISSING_NONCRITICAL", severity="INFO", field="short_name"),
            finding(raw_blank("case_pack"), "MDM_IMPORT_FIELD_MISSING_NONCRITICAL", severity=F.when(single, "WARNING").otherwise("INFO"), field="case_pack"),
            finding(raw_blank("source_created_at"), "MDM_IMPORT_FIELD_MISSING_NONCRITICAL", severity="INFO", field="source_created_at"),
        ],
    )
    noted = duplicate_exact_codes(noted, "sku_code")
    measures = {"_members": F.count(F.lit(1)), "_name": F.min_by("sku_name", "row_number")}
    measures |= {f"_lo_{c}": F.min(c) for c in compared} | {f"_hi_{c}": F.max(c) for c in compared}
    grouped = attach_group(noted, [BATCH, "source_product_code"], measures, ROW)
    confirmed = merge_codes.select(normalize_text("source_product_code").alias("source_product_code")).distinct().withColumn("_merge", F.lit(True))
    joined = grouped.join(confirmed, "source_product_code", "left")
    fields = F.filter(F.array(*[F.when(F.col(f"_lo_{c}") != F.col(f"_hi_{c}"), F.lit(c)) for c in compared]), lambda c: c.isNotNull())
    has_code = F.col("source_product_code").isNotNull()
    conflict = has_code & (F.size(fields) > 0)
    merged = conflict & F.col("_merge").isNotNull()
    open_conflict = conflict & ~merged
    details = F.create_map(F.lit("conflict_fields"), F.array_join(fields, ","))
    found = with_findings(
        joined,
        [
            finding(has_code, "MDM_IMPORT_PRODUCT_CANDIDATE", severity="WARNING", field="source_product_code", candidate_key=F.col("source_product_code"), candidate_count=F.col("_members")),
            finding(merged, "MDM_IMPORT_PRODUCT_MERGE_RESOLVED", severity="INFO", field="source_product_code", resolved=True, details=details),
            finding(open_conflict, "MDM_IMPORT_PRODUCT_MERGE_CONFLICT", field="source_product_code", details=details),
        ],
    ).withColumn(
        "product_candidate",
        F.when(
            has_code,
            F.struct(
                F.col("source_product_code"),
                F.col("_members").alias("sku_count"),
                open_conflict.alias("conflict"),
                conflict.alias("detected_conflict"),
                F.array_join(fields, ",").alias("conflict_fields"),
                F.col("_name").alias("proposed_product_name"),
            ),
        ),
    )
    return _drop_helpers(_set_action(found, open_conflict, "CONFLICT"))


def duplicate_exact_codes(rows: DataFrame, column: str) -> DataFrame:
    """A code repeated in the file as spelled blocks every occurrence."""
    sized = with_group_size(rows, F.col(column), "code")
    repeated = F.col("_code_rows") > 1
    found = with_findings(
        sized, [finding(repeated, "MDM_IMPORT_DUPLICATE_UNIQUE_CODE", field=column, candidate_key=F.col("_code_key"), candidate_count=F.col("_code_rows"))]
    )
    return _drop_helpers(_set_action(found, repeated, "CONFLICT"))
