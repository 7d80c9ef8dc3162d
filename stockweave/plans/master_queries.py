"""Master data: imports, review, commit, lists, maintenance, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.operators import audit, commit, findings, master_import, masters, resolution, review
from stockweave.plans import standins as data
from stockweave.plans.registry import query
from stockweave.plans.standins import oracle
from stockweave.sources import contracts
from stockweave.sources.staging import spread, stage

def one_batch():
    return F.lit("B1").alias("batch_id")


def master_catalogue(spark, sf_dir):
    """Masters by name, code and stable id, plus aliases, mappings and staged rows."""
    channel = data.channel(spark, sf_dir)
    customer = data.customer(spark, sf_dir, spread(data.table(spark, sf_dir, "customer")))
    sku = data.sku(spark, sf_dir, spread(data.table(spark, sf_dir, "part")))
    parts = [
        resolution.catalogue_entries(channel, "CHANNEL", "channel_id", "channel_stable_id", "channel_name", "channel_code", "channel_status"),
        resolution.catalogue_entries(data.salesrep(spark, sf_dir), "SALESREP", "salesrep_id", "salesrep_stable_id", "salesrep_name", "salesrep_code", "salesrep_status"),
        resolution.catalogue_entries(data.region(spark, sf_dir), "REGION", "region_id", "region_stable_id", "region_name", None, "region_status"),
        resolution.catalogue_entries(customer, "CUSTOMER", "customer_id", "customer_stable_id", "customer_name", "customer_code", "customer_status"),
        resolution.catalogue_entries(data.product(spark, sf_dir), "PRODUCT", "product_id", "product_stable_id", "product_name", "product_code", "product_status", folded=True),
        resolution.catalogue_entries(sku, "SKU", "sku_id", "sku_stable_id", "sku_name", "sku_code", "sku_status"),
    ]
    whole = resolution.reference_catalogue(parts)
    aliases = data.salesrep(spark, sf_dir).select(
        F.lit("SALESREP").alias("entity_type"), F.col("salesrep_id").alias("entity_id"), F.concat(F.lit("Rep "), "salesrep_name").alias("alias"), F.lit("ACTIVE").alias("status")
    )
    mappings = data.product(spark, sf_dir).select(
        F.lit("PRODUCT").alias("entity_type"), F.col("product_id").alias("entity_id"), F.lower(F.concat(F.lit("ext-"), "product_code")).alias("external_code"), F.lit("ACTIVE").alias("status")
    )
    staged = data.table(spark, sf_dir, "region").select(
        F.col("r_name").alias("channel_name"), F.lit("READY_FOR_REVIEW").alias("batch_status"), F.lit("VALID").alias("status"), F.lit("B0").alias("batch_id"), F.col("r_regionkey").alias("row_number")
    )
    return resolution.reference_catalogue(
        [
            whole,
            resolution.linked_entries(whole, aliases, "ALIAS", F.col("alias")),
            resolution.linked_entries(whole, mappings, "EXTERNAL_CODE", F.col("external_code")),
            resolution.staged_entries(staged, "CHANNEL", "channel_name"),
        ]
    )


@query(
    "reference_catalogue",
    oracle(
        """, e AS (SELECT 'CHANNEL' AS t, channel_name AS name, channel_code AS code, channel_status AS s FROM m_channel
  UNION ALL SELECT 'SALESREP', salesrep_name, salesrep_code, salesrep_status FROM m_salesrep
  UNION ALL SELECT 'REGION', r_name, NULL, 'ACTIVE' FROM region
  UNION ALL SELECT 'CUSTOMER', customer_name, customer_code, customer_status FROM m_customer
  UNION ALL SELECT 'PRODUCT', product_name, product_code, product_status FROM m_product
  UNION ALL SELECT 'SKU', sku_name, sku_code, sku_status FROM m_sku)
SELECT t AS entity_type, k AS key_kind, count(*) AS entries, count(*) FILTER (s = 'ACTIVE') AS active_entries FROM (
  SELECT t, s, 'NAME' AS k FROM e UNION ALL SELECT t, s, 'STABLE_ID' FROM e UNION ALL SELECT t, s, 'CODE' FROM e WHERE code IS NOT NULL
  UNION ALL SELECT t, s, 'ALIAS' FROM e WHERE t = 'SALESREP' UNION ALL SELECT t, s, 'EXTERNAL_CODE' FROM e WHERE t = 'PRODUCT'
  UNION ALL SELECT 'CHANNEL', 'ACTIVE', 'NAME' FROM region) GROUP BY 1, 2"""
    ),
)
def reference_catalogue(spark, sf_dir):
    return master_catalogue(spark, sf_dir).groupBy("entity_type", "key_kind").agg(F.count(F.lit(1)).alias("entries"), F.count_if("active").alias("active_entries"))


@query(
    "name_match_unique",
    oracle(
        """SELECT p_name, CASE WHEN active = 1 THEN one_id END AS matched_sku, n AS candidates, n > 0 AND active = 0 AS inactive_only
FROM (SELECT DISTINCT p_name FROM part) LEFT JOIN (SELECT sku_name AS p_name, count(*) AS n, count(*) FILTER (sku_status = 'ACTIVE') AS active,
  min(sku_id) FILTER (sku_status = 'ACTIVE') AS one_id FROM m_sku GROUP BY 1) USING (p_name)"""
    ),
)
def name_match_unique(spark, sf_dir):
    names = data.table(spark, sf_dir, "part").select("p_name")
    sku = resolution.catalogue_entries(data.sku(spark, sf_dir), "SKU", "sku_id", "sku_stable_id", "sku_name", "sku_code", "sku_status")
    found = resolution.master_reference(names, "p_name", sku, "SKU")
    return found.select("p_name", F.col("match.entity_id").alias("matched_sku"), "candidates", "inactive_only")


@query(
    "bootstrap_reference",
    oracle(
        """SELECT ref, CASE WHEN ref LIKE 'Rep %' AND salesrep_status = 'ACTIVE' THEN 'CONFIRMED_ALIAS' WHEN ref NOT LIKE 'Rep %' AND salesrep_status = 'ACTIVE'
  THEN 'NORMALIZED_NAME' END AS method, CASE WHEN salesrep_status = 'ACTIVE' THEN salesrep_id END AS salesrep_id
FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'Rep ' || n_name ELSE n_name END AS ref, n_nationkey + 1 AS id FROM nation) JOIN m_salesrep ON salesrep_id = id"""
    ),
)
def bootstrap_reference(spark, sf_dir):
    names = data.table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Rep "), "n_name")).otherwise(F.col("n_name")).alias("ref"))
    found = resolution.reference(names, "ref", master_catalogue(spark, sf_dir), "SALESREP", bootstrap=True)
    return found.select("ref", "method", F.col("match.entity_id").alias("salesrep_id"))


@query(
    "identity_cascade",
    oracle(
        """SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE m.product_id END AS product_id, CASE p_partkey % 4 WHEN 3 THEN 0 ELSE 1 END AS entity_candidates
FROM part JOIN m_product m ON m.product_name = p_brand || ' ' || p_type"""
    ),
)
def identity_cascade(spark, sf_dir):
    turn = F.col("p_partkey") % 4
    part = data.table(spark, sf_dir, "part")
    name = F.concat_ws(" ", "p_brand", "p_type")
    code = F.concat_ws("-", F.substring("p_brand", 7, 3), F.substring("p_type", 1, 3))
    rows = part.select(
        "p_partkey",
        F.when(turn == 0, F.upper(code)).when(turn == 1, F.concat(F.lit("EXT-"), code)).when(turn == 3, F.lit("none")).alias("code"),
        F.when(turn == 2, F.concat(F.lit(" "), F.upper(name))).alias("name"),
    )
    found = resolution.identity(rows, master_catalogue(spark, sf_dir), "PRODUCT", None, "code", "name", bootstrap=True, folded=True)
    return found.select("p_partkey", F.col("entity.entity_id").alias("product_id"), "entity_candidates")


# --- customer import -------------------------------------------------------


def customer_file(spark, sf_dir):
    """A customer workbook: mostly known customers, with repeated codes, changed
    names, unknown channels and odd parents."""
    k = F.col("c_custkey")
    key = k.cast("string")
    parent = F.when(k % 10 == 0, k - 3).otherwise(k + 1).cast("string")
    source = spread(data.table(spark, sf_dir, "customer")).join(
        data.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey", "left"
    )
    empty = F.lit(None).cast("string")
    columns = {f.name: empty for f in contracts.CUSTOMER.fields}
    columns |= {
        "customer_code": F.when(k % 40 == 1, F.concat(F.lit("C"), (k - 1).cast("string")))
        .when(k % 31 == 0, F.concat(F.lit("c"), key))
        .when(k % 17 == 0, F.concat(F.lit("N"), key))
        .otherwise(F.concat(F.lit("C"), key)),
        "customer_name": F.when(k % 29 == 0, F.concat(F.lit("Other  "), "c_name")).otherwise(F.col("c_name")),
        "channel_ref": F.when(k % 43 == 0, "NOWHERE").otherwise(F.col("c_mktsegment")),
        "salesrep_ref": F.col("n_name"),
        "is_direct": F.when(k % 47 == 0, "maybe").otherwise("Y"),
        "parent_customer_ref": F.when(k % 59 == 0, F.col("c_name")).when(k > 0, F.concat(F.lit("Customer#"), F.lpad(parent, 9, "0"))),
    }
    return source.select(one_batch(), (k + 2).alias("row_number"), *[value.alias(name) for name, value in columns.items()])


def evaluated_customers(spark, sf_dir):
    catalogue = stage(master_catalogue(spark, sf_dir))
    references = {"channel": ("channel_ref", "CHANNEL"), "salesrep": ("salesrep_ref", "SALESREP"), "region": ("region_ref", "REGION")}
    customer = data.customer(spark, sf_dir, spread(data.table(spark, sf_dir, "customer")))
    rows = master_import.evaluate_customers(customer_file(spark, sf_dir), contracts.CUSTOMER, customer, catalogue, references)
    return findings.finalize(rows)


_CUSTOMER = [
    """imp AS (SELECT c_custkey + 2 AS row_number, CASE WHEN c_custkey % 40 = 1 THEN 'C' || (c_custkey - 1) WHEN c_custkey % 31 = 0 THEN 'c' || c_custkey
    WHEN c_custkey % 17 = 0 THEN 'N' || c_custkey ELSE 'C' || c_custkey END AS code,
  CASE WHEN c_custkey % 29 = 0 THEN 'Other ' || c_name ELSE c_name END AS name, c_custkey % 43 = 0 AS no_channel,
  c_nationkey % 11 = 5 AS rep_off, c_custkey % 47 = 0 AS bad_flag,
  CASE WHEN c_custkey % 59 = 0 THEN c_name WHEN c_custkey > 0 THEN 'Customer#' || lpad(CAST(CASE WHEN c_custkey % 10 = 0 THEN c_custkey - 3 ELSE c_custkey + 1 END AS VARCHAR), 9, '0') END AS parent
  FROM customer)""",
    """ident AS (SELECT i.*, coalesce(m.customer_name = i.name, false) AS existing, m.customer_id IS NOT NULL AND m.customer_name <> i.name AS taken,
    EXISTS (SELECT 1 FROM m_customer n WHERE n.customer_name = i.name AND n.customer_code <> i.code) AS elsewhere,
    count(*) OVER (PARTITION BY lower(code)) AS copies, (SELECT count(DISTINCT j.name) FROM imp j WHERE lower(j.code) = lower(i.code)) AS names,
    (SELECT count(DISTINCT j.code) FROM imp j WHERE j.name = i.name) AS codes, (SELECT count(*) FROM imp j WHERE j.name = i.parent) AS parents,
    (SELECT count(*) FROM m_customer n WHERE n.customer_name = i.parent AND n.customer_status = 'ACTIVE') AS master_parents
  FROM imp i LEFT JOIN m_customer m ON lower(m.customer_code) = lower(i.code))""",
    """acted AS (SELECT *, CASE WHEN copies > 1 THEN 'CONFLICT' WHEN existing THEN 'EXISTING' WHEN taken THEN 'CONFLICT' ELSE 'NEW' END AS act FROM ident)""",
    """cust_found AS (
  SELECT row_number, 'MDM_IMPORT_VALUE_INVALID' AS code, 'ERROR' AS severity FROM acted WHERE bad_flag AND NOT existing
  UNION ALL SELECT row_number, 'MDM_IMPORT_CUSTOMER_EXISTING', 'INFO' FROM acted WHERE existing
  UNION ALL SELECT row_number, 'MDM_IMPORT_CUSTOMER_CODE_CONFLICT', 'ERROR' FROM acted WHERE taken
  UNION ALL SELECT row_number, 'MDM_IMPORT_CUSTOMER_NAME_CONFLICT', 'WARNING' FROM acted WHERE NOT existing AND elsewhere
  UNION ALL SELECT row_number, CASE WHEN names = 1 THEN 'MDM_IMPORT_DUPLICATE_EXACT' ELSE 'MDM_IMPORT_CUSTOMER_CODE_CONFLICT' END, 'ERROR' FROM acted WHERE copies > 1
  UNION ALL SELECT row_number, 'MDM_IMPORT_CUSTOMER_NAME_CONFLICT', 'WARNING' FROM acted WHERE codes > 1 AND act <> 'EXISTING'
  UNION ALL SELECT row_number, 'MDM_IMPORT_REFERENCE_UNRESOLVED', 'ERROR' FROM acted WHERE no_channel AND act <> 'EXISTING'
  UNION ALL SELECT row_number, 'MDM_IMPORT_INACTIVE_REFERENCE', 'ERROR' FROM acted WHERE rep_off AND act <> 'EXISTING'
  UNION ALL SELECT row_number, 'MDM_IMPORT_PARENT_UNRESOLVED', 'WARNING' FROM acted WHERE parent IS NOT NULL AND parent <> name AND parents <> 1
    AND master_parents <> 1 AND act <> 'EXISTING')""",
    """cust_rows AS (SELECT a.row_number, CASE WHEN e THEN 'ERROR' WHEN act = 'EXISTING' THEN 'EXISTING' WHEN w THEN 'WARNING' ELSE 'VALID' END AS status,
  CASE WHEN e AND act <> 'CONFLICT' THEN 'UNIMPORTABLE' ELSE act END AS action, coalesce(codes_found, '') AS codes,
  CASE WHEN parent IS NULL THEN 'EMPTY' WHEN parent = name THEN 'ROOT_SOURCE_SELF' WHEN parents = 1 OR master_parents = 1 THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS parent_resolution
  FROM acted a LEFT JOIN (SELECT row_number, string_agg(code, ',' ORDER BY code) AS codes_found, bool_or(severity = 'ERROR') AS e,
    bool_or(severity = 'WARNING') AS w FROM cust_found GROUP BY 1) f USING (row_number))""",
]


def _codes():
    return F.array_join(F.array_sort(F.transform("findings", lambda f: f["code"])), ",").alias("codes")


@query("customer_import", oracle("SELECT row_number, status, action, codes, parent_resolution FROM cust_rows", *_CUSTOMER))
def customer_import(spark, sf_dir):
    return evaluated_customers(spark, sf_dir).select("row_number", "status", "action", _codes(), "parent_resolution")


@query(
    "import_counts",
    oracle(
        """SELECT 'B1' AS batch_id, count(*) AS total_rows, count(*) FILTER (status = 'VALID') AS ready_rows, count(*) FILTER (status = 'WARNING') AS warning_rows,
  count(*) FILTER (status = 'ERROR') AS error_rows, count(*) FILTER (status = 'EXISTING') AS existing_rows,
  count(*) FILTER (status NOT IN ('ERROR', 'EXISTING')) AS create_rows, false AS commit_eligible, 'REVIEW' AS batch_status FROM cust_rows""",
        *_CUSTOMER,
    ),
)
def import_counts(spark, sf_dir):
    return findings.import_counts(evaluated_customers(spark, sf_dir), "batch_id")


_SUMMARY_SQL = ", ".join(
    [f"count(*) FILTER (action = '{a}') AS action_{a.lower()}" for a in ("NEW", "UPDATE", "UNCHANGED", "EXISTING", "CONFLICT", "UNIMPORTABLE")]
    + [f"count(*) FILTER (status = '{s}') AS status_{s.lower()}" for s in ("VALID", "WARNING", "ERROR", "SKIPPED", "EXISTING")]
)


@query("import_preview_summary", oracle(f"SELECT 'B1' AS batch_id, count(*) AS total_rows, {_SUMMARY_SQL} FROM cust_rows", *_CUSTOMER))
def import_preview_summary(spark, sf_dir):
    summary = findings.preview_summary(evaluated_customers(spark, sf_dir), "batch_id")
    return summary.drop("rows_with_error", "rows_with_warning", "rows_with_info", "would_write_rows", "commit_allowed")


@query(
    "contract_status",
    oracle(
        """SELECT row_number, CASE WHEN bool_or(severity = 'ERROR') THEN 'ERROR' WHEN bool_or(code LIKE '%EXISTING') THEN 'EXISTING'
  WHEN bool_or(severity = 'WARNING') THEN 'WARNING' ELSE 'READY' END AS contract_status FROM acted LEFT JOIN cust_found USING (row_number) GROUP BY 1""",
        *[c.replace("SELECT i.*,", "SELECT i.* EXCLUDE (code), i.code AS own_code,") if c.startswith("ident") else c for c in _CUSTOMER],
    ).replace("PARTITION BY lower(code)", "PARTITION BY lower(i.code)"),
)
def contract_status(spark, sf_dir):
    return evaluated_customers(spark, sf_dir).select("row_number", findings.contract_status("CUSTOMER").alias("contract_status"))


@query(
    "preview_filter",
    oracle("SELECT row_number, status, action FROM cust_rows WHERE status IN ('WARNING') OR action = 'WARNING' OR row_number IN (SELECT row_number FROM cust_found WHERE severity = 'WARNING')", *_CUSTOMER),
)
def preview_filter(spark, sf_dir):
    return findings.keep_matching(evaluated_customers(spark, sf_dir), ["warning"]).select("row_number", "status", "action")


@query(
    "import_analysis",
    oracle("SELECT 'B1' AS batch_id, code, count(*) AS affected_rows FROM cust_found GROUP BY 2", *_CUSTOMER),
)
def import_analysis(spark, sf_dir):
    return masters.analysis_per_entity(evaluated_customers(spark, sf_dir)).drop("groups")


@query(
    "parent_cycles",
    """WITH RECURSIVE edge AS (SELECT c_custkey AS child, CASE WHEN c_custkey % 10 = 0 THEN c_custkey - 3 ELSE c_custkey + 1 END AS parent FROM customer
  WHERE c_custkey > 0 AND c_custkey < (SELECT max(c_custkey) FROM customer)),
walk(start, node, steps) AS (SELECT child, parent, 1 FROM edge UNION ALL SELECT start, e.parent, steps + 1 FROM walk JOIN edge e ON e.child = node WHERE steps < 12 AND node <> start)
SELECT DISTINCT start AS c_custkey FROM walk WHERE node = start""",
)
def parent_cycles(spark, sf_dir):
    k = F.col("c_custkey")
    source = data.table(spark, sf_dir, "customer").select("c_custkey")
    last = source.agg(F.max("c_custkey").alias("_last"))
    edges = source.join(last, k < F.col("_last")).filter(k > 0)
    edges = edges.select(k.alias("child"), F.when(k % 10 == 0, k - 3).otherwise(k + 1).alias("parent"))
    return master_import.cycle_rows(edges).select(F.col("child").alias("c_custkey"))


# --- product, SKU and goods imports ----------------------------------------


def text_rows(frame, contract, columns):
    empty = F.lit(None).cast("string")
    return frame.select(one_batch(), "row_number", *[columns.get(f.name, empty).cast("string").alias(f.name) for f in contract.fields])


def product_file(spark, sf_dir):
    turn = F.col("product_id") % 7
    frame = data.product(spark, sf_dir).withColumn("row_number", F.col("product_id"))
    return text_rows(
        frame,
        contracts.PRODUCT,
        {
            "product_code": F.when(turn == 1, F.lower("product_code")).when(turn == 2, F.concat(F.lit("X-"), "product_code")).when(turn == 4, F.lit("dup")).when(turn == 5, F.lit("")).otherwise(F.col("product_code")),
            "product_name": F.when(turn == 3, F.lit("Something else")).otherwise(F.upper("product_name")),
            "brand": F.when(turn == 6, F.lit("New brand")).otherwise(F.col("brand")),
        },
    )


@query(
    "product_import",
    oracle(
        """SELECT product_id AS row_number, CASE t WHEN 2 THEN 'WARNING' WHEN 3 THEN 'ERROR' WHEN 4 THEN CASE WHEN n4 > 1 THEN 'ERROR' ELSE 'WARNING' END
  WHEN 5 THEN 'ERROR' ELSE 'EXISTING' END AS status,
  CASE t WHEN 2 THEN 'NEW' WHEN 3 THEN 'CONFLICT' WHEN 4 THEN CASE WHEN n4 > 1 THEN 'CONFLICT' ELSE 'NEW' END WHEN 5 THEN 'UNIMPORTABLE' ELSE 'EXISTING' END AS action,
  CASE t WHEN 2 THEN 'MDM_IMPORT_PRODUCT_NAME_CONFLICT' WHEN 3 THEN 'MDM_IMPORT_PRODUCT_CODE_CONFLICT'
    WHEN 4 THEN CASE WHEN n4 > 1 THEN 'MDM_IMPORT_DUPLICATE_UNIQUE_CODE,' ELSE '' END || 'MDM_IMPORT_PRODUCT_NAME_CONFLICT'
    WHEN 5 THEN 'MDM_IMPORT_PRODUCT_NAME_CONFLICT,MDM_IMPORT_REQUIRED_FIELD_MISSING' ELSE 'MDM_IMPORT_PRODUCT_EXISTING' END AS codes
FROM (SELECT product_id, product_id % 7 AS t, count(*) FILTER (product_id % 7 = 4) OVER () AS n4 FROM m_product)"""
    ),
)
def product_import(spark, sf_dir):
    rows = master_import.start_rows(contracts.normalize_rows(product_file(spark, sf_dir), contracts.PRODUCT), contracts.PRODUCT)
    rows = findings.finalize(master_import.product_identity(rows, data.product(spark, sf_dir)))
    return rows.select("row_number", "status", "action", _codes())


def part_rows(spark, sf_dir):
    code = F.concat_ws("-", F.substring("p_brand", 7, 3), F.substring("p_type", 1, 3))
    return data.table(spark, sf_dir, "part").select("*", F.col("p_partkey").alias("row_number"), code.alias("product_code"))


@query(
    "sku_import",
    oracle(
        """, f AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN (SELECT product_id FROM m_product WHERE product_code = '1-ECO') ELSE p.product_id END AS ref,
    CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN (SELECT product_status FROM m_product WHERE product_code = '1-ECO') ELSE p.product_status END AS ref_status, p.product_id AS own
  FROM part JOIN m_product p ON p.product_name = p_brand || ' ' || p_type),
s AS (SELECT k, ref, ref_status, own, m.partkey IS NOT NULL AS known, m.product_id AS has, k % 11 = 3 AS other_name, k % 23 = 4 AS bad_date FROM f LEFT JOIN m_sku m ON m.partkey = k AND k % 83 <> 0 AND m.sku_code LIKE 'SKU-%'),
j AS (SELECT *, ref IS NULL AS lost, ref IS NOT NULL AND ref_status <> 'ACTIVE' AS off, known AND ref IS NOT NULL AND ref_status = 'ACTIVE' AS judged FROM s),
c AS (SELECT *, judged AND has IS DISTINCT FROM ref AS wrong, judged AND has IS NOT DISTINCT FROM ref AND other_name AS renamed, judged AND has IS NOT DISTINCT FROM ref AND NOT other_name AS same FROM j)
SELECT k AS row_number, CASE WHEN lost OR off OR wrong OR renamed OR bad_date THEN 'ERROR' WHEN same THEN 'EXISTING' ELSE 'VALID' END AS status,
  CASE WHEN wrong OR renamed THEN 'CONFLICT' WHEN lost OR off OR bad_date THEN 'UNIMPORTABLE' WHEN same THEN 'EXISTING' ELSE 'NEW' END AS action,
  array_to_string(list_sort(list_filter([CASE WHEN bad_date THEN 'MDM_IMPORT_DATE_INVALID' END, CASE WHEN lost THEN 'MDM_IMPORT_REFERENCE_UNRESOLVED' END,
    CASE WHEN off THEN 'MDM_IMPORT_INACTIVE_REFERENCE' END, CASE WHEN wrong THEN 'MDM_IMPORT_SKU_PRODUCT_CONFLICT' END,
    CASE WHEN renamed THEN 'MDM_IMPORT_SKU_CODE_CONFLICT' END, CASE WHEN same THEN 'MDM_IMPORT_SKU_EXISTING' END], lambda x: x IS NOT NULL)), ',') AS codes FROM c"""
    ),
)
def sku_import(spark, sf_dir):
    k = F.col("p_partkey")
    rows = text_rows(
        part_rows(spark, sf_dir),
        contracts.SKU_V1,
        {
            "sku_code": F.concat(F.when(k % 7 == 1, "sku-").otherwise("SKU-"), k.cast("string")),
            "sku_name": F.when(k % 11 == 3, F.lit("Another name")).otherwise(F.upper("p_name")),
            "product_code_ref": F.when(k % 13 == 0, F.lit("ZZ")).when(k % 19 == 0, F.lit("1-eco")).otherwise(F.col("product_code")),
            "case_pack": F.col("p_size"),
            "source_created_at": F.when(k % 23 == 4, F.lit("spring")).otherwise(F.lit("2000-01-01")),
        },
    )
    rows = master_import.block_invalid_dates(master_import.start_rows(contracts.normalize_rows(rows, contracts.SKU_V1), contracts.SKU_V1))
    rows = findings.finalize(master_import.sku_identity(stage(rows), data.sku(spark, sf_dir), stage(master_catalogue(spark, sf_dir))))
    return rows.select("row_number", "status", "action", _codes())


def goods_file(spark, sf_dir):
    """Goods: known products every third row, else new groups of about ten rows,
    some with contradictory forms, some named, some with a representative SKU."""
    k = F.col("p_partkey")
    group = (k % 199).cast("string")
    code = F.when(k % 3 == 0, F.col("product_code")).otherwise(F.concat(F.lit("G"), group))
    return text_rows(
        part_rows(spark, sf_dir),
        contracts.GOODS,
        {
            "sku_code": F.when(k == k % 199, F.when(k % 5 == 0, code).otherwise(F.concat(F.lit("NEW-"), k.cast("string")))).otherwise(F.concat(F.when(k % 2 == 0, "NEW-").otherwise("SKU-"), k.cast("string"))),
            "sku_name": F.col("p_name"),
            "product_code": code,
            "product_form": F.when((k % 199) % 11 == 0, F.col("p_type")).otherwise("form"),
            "product_name": F.when((k % 199) % 7 == 0, F.concat(F.lit("Group "), group)),
            "brand": F.lit("house"),
        },
    )


_GOODS = [
    """g AS (SELECT p_partkey AS k, p_name AS sku_name, CASE WHEN p_partkey % 3 = 0 THEN substr(p_brand, 7, 3) || '-' || substr(p_type, 1, 3) ELSE 'G' || (p_partkey % 199) END AS code,
  CASE WHEN (p_partkey % 199) % 11 = 0 THEN p_type ELSE 'form' END AS form, CASE WHEN (p_partkey % 199) % 7 = 0 THEN 'Group ' || (p_partkey % 199) END AS pname,
  CASE WHEN p_partkey < 199 AND p_partkey % 5 = 0 THEN CASE WHEN p_partkey % 3 = 0 THEN substr(p_brand, 7, 3) || '-' || substr(p_type, 1, 3) ELSE 'G' || (p_partkey % 199) END
    WHEN p_partkey < 199 OR p_partkey % 2 = 0 THEN 'NEW-' || p_partkey ELSE 'SKU-' || p_partkey END AS sku_code FROM part)""",
    """plan AS (SELECT lower(code) AS plan_key, min_by(code, k) AS plan_code, count(*) AS plan_rows,
  CASE WHEN any_value(m.product_id) IS NOT NULL THEN 'EXISTING' ELSE 'CREATE' END AS plan_action,
  CASE WHEN any_value(m.product_id) IS NOT NULL THEN CASE WHEN any_value(m.product_status) <> 'ACTIVE' THEN 'MDM_IMPORT_INACTIVE_REFERENCE' END
    WHEN count(DISTINCT form) > 1 OR count(DISTINCT pname) > 1 THEN 'MDM_IMPORT_PRODUCT_ATTR_CONFLICT'
    WHEN count(DISTINCT pname) = 0 AND count(*) FILTER (lower(sku_code) = lower(code)) <> 1 THEN 'MDM_IMPORT_PRODUCT_NAME_REQUIRED' END AS plan_problem,
  CASE WHEN any_value(m.product_id) IS NOT NULL THEN any_value(m.product_name) WHEN count(DISTINCT form) > 1 OR count(DISTINCT pname) > 1 THEN NULL
    WHEN count(DISTINCT pname) = 1 THEN min(pname) WHEN count(*) FILTER (lower(sku_code) = lower(code)) = 1 THEN min(g.sku_name) FILTER (lower(sku_code) = lower(code)) END AS plan_name,
  any_value(m.product_id) AS plan_product_id FROM g LEFT JOIN m_product m ON lower(m.product_code) = lower(code) GROUP BY 1)""",
]


@query("goods_plans", oracle("SELECT 'B1' AS batch_id, plan_key, plan_code, plan_action, plan_problem, plan_name, plan_product_id, plan_rows FROM plan", *_GOODS))
def goods_plans(spark, sf_dir):
    rows = contracts.normalize_rows(goods_file(spark, sf_dir), contracts.GOODS)
    plans = master_import.goods_plans(rows, data.product(spark, sf_dir))
    return plans.select("batch_id", "plan_key", "plan_code", "plan_action", "plan_problem", "plan_name", "plan_product_id", "plan_rows")


_GOODS_ROWS = """goods AS (SELECT k, g.sku_code, plan_action, plan_problem, plan_name, dup, m.sku_id IS NOT NULL AND plan_problem IS DISTINCT FROM 'MDM_IMPORT_INACTIVE_REFERENCE' AS judged,
  plan_action = 'CREATE' OR m.product_id IS DISTINCT FROM plan_product_id AS wrong FROM (SELECT *, count(*) OVER (PARTITION BY lower(sku_code)) > 1 AS dup FROM g) g
  JOIN plan ON plan_key = lower(code) LEFT JOIN m_sku m ON m.partkey = k AND g.sku_code = 'SKU-' || k AND k % 83 <> 0 AND m.sku_code LIKE 'SKU-%')"""


@query(
    "goods_import",
    oracle(
        """SELECT k AS row_number, CASE WHEN plan_problem IS NOT NULL OR dup OR (judged AND wrong) THEN 'ERROR' WHEN judged THEN 'EXISTING' ELSE 'VALID' END AS status,
  CASE WHEN dup THEN 'CONFLICT' WHEN plan_problem IS NOT NULL AND NOT (judged AND NOT wrong) THEN 'CONFLICT' WHEN judged AND wrong THEN 'CONFLICT' WHEN judged THEN 'EXISTING' ELSE 'NEW' END AS action,
  array_to_string(list_sort(list_filter([plan_problem, CASE WHEN dup THEN 'MDM_IMPORT_DUPLICATE_UNIQUE_CODE' END, CASE WHEN judged AND wrong THEN 'MDM_IMPORT_SKU_PRODUCT_CONFLICT' END,
    CASE WHEN judged AND NOT wrong THEN 'MDM_IMPORT_SKU_EXISTING' END], lambda x: x IS NOT NULL)), ',') AS codes FROM goods""",
        *_GOODS,
        _GOODS_ROWS,
    ),
)
def goods_import(spark, sf_dir):
    return evaluated_goods(spark, sf_dir).select("row_number", "status", "action", _codes())


def evaluated_goods(spark, sf_dir):
    rows = contracts.normalize_rows(goods_file(spark, sf_dir), contracts.GOODS)
    rows = master_import.block_invalid_dates(master_import.start_rows(rows, contracts.GOODS))
    return findings.finalize(master_import.goods_identity(rows, data.sku(spark, sf_dir), data.product(spark, sf_dir)))


# --- bootstrap -------------------------------------------------------------


@query(
    "bootstrap_names",
    oracle(
        """SELECT n_nationkey AS row_number, CASE WHEN n_nationkey % 4 < 2 THEN 'CONFLICT' ELSE 'NEW' END AS action,
  CASE WHEN n_nationkey % 4 < 2 THEN 'MDM_IMPORT_CHANNEL_BOOTSTRAP_REQUIRED,MDM_IMPORT_POSSIBLE_DUPLICATE_NAME' ELSE 'MDM_IMPORT_CHANNEL_BOOTSTRAP_REQUIRED' END AS codes FROM nation"""
    ),
)
def bootstrap_names(spark, sf_dir):
    k = F.col("n_nationkey")
    rows = data.table(spark, sf_dir, "nation").select(
        one_batch(), k.alias("row_number"), k.cast("string").alias("source_index"), F.when(k % 4 < 2, F.concat(F.lit("Shared "), (k % 4).cast("string"))).otherwise(F.col("n_name")).alias("channel_name")
    )
    rows = master_import.start_rows(contracts.normalize_rows(rows, contracts.CHANNEL), contracts.CHANNEL)
    return master_import.bootstrap_channels(rows).select("row_number", "action", _codes())


@query(
    "exact_duplicate_rows",
    oracle(
        """SELECT c_custkey AS row_number, first_row, CASE WHEN c_custkey > first_row THEN 'UNCHANGED' ELSE 'NEW' END AS action
FROM (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_mktsegment, c_nationkey) AS first_row FROM customer)"""
    ),
)
def exact_duplicate_rows(spark, sf_dir):
    rows = data.table(spark, sf_dir, "customer").select(one_batch(), F.col("c_custkey").alias("row_number"), "c_mktsegment", "c_nationkey").withColumn("findings", findings.no_findings()).withColumn("action", F.lit("NEW"))
    marked = master_import.mark_exact_duplicates(rows, ["c_mktsegment", "c_nationkey"])
    first = F.try_element_at(F.col("findings"), F.lit(1))["details"].getItem("first_row").cast("bigint")
    return marked.select("row_number", F.coalesce(first, F.col("row_number")).alias("first_row"), "action")


@query(
    "bootstrap_customers",
    oracle(
        """SELECT c_custkey + 2 AS row_number, array_to_string(list_sort(list_filter([
  CASE WHEN copies > 1 THEN 'MDM_IMPORT_DUPLICATE_CUSTOMER_CODE' END,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'MDM_IMPORT_NON_SALES_EXCLUDED' WHEN c_mktsegment = 'FURNITURE' THEN 'MDM_IMPORT_HISTORICAL_CHANNEL'
    WHEN c_custkey % 43 = 0 THEN 'MDM_IMPORT_CHANNEL_UNRESOLVED' END,
  CASE WHEN c_nationkey % 11 = 5 THEN 'MDM_IMPORT_INACTIVE_REFERENCE' END], lambda x: x IS NOT NULL)), ',') AS codes,
  c_mktsegment = 'MACHINERY' AND c_custkey % 43 <> 0 AS excluded
FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 43 = 0 THEN 'NOWHERE' ELSE c_mktsegment END AS c_mktsegment,
  count(*) OVER (PARTITION BY CASE WHEN c_custkey % 40 = 1 THEN 'C' || (c_custkey - 1) WHEN c_custkey % 31 = 0 THEN 'c' || c_custkey
    WHEN c_custkey % 17 = 0 THEN 'N' || c_custkey ELSE 'C' || c_custkey END) AS copies FROM customer)"""
    ),
)
def bootstrap_customers(spark, sf_dir):
    rows = contracts.normalize_rows(customer_file(spark, sf_dir), contracts.CUSTOMER).withColumn("findings", findings.no_findings()).withColumn("action", F.lit("NEW"))
    exclusions = spark.createDataFrame([("MACHINERY", "NON_SALES", "intercompany")], "source_value string, classification string, exclusion_reason string")
    historical = spark.createDataFrame([("FURNITURE", "closed")], "channel_name string, reason string")
    done = master_import.bootstrap_customers(stage(rows), stage(master_catalogue(spark, sf_dir)), exclusions, historical)
    return done.select("row_number", _codes(), "excluded")


def bootstrap_sku_rows(spark, sf_dir):
    k = F.col("p_partkey")
    rows = text_rows(
        part_rows(spark, sf_dir),
        contracts.SKU_BOOTSTRAP,
        {
            "sku_code": F.when(k % 50 == 1, F.concat(F.lit("SKU-"), (k - 1).cast("string"))).otherwise(F.concat(F.lit("SKU-"), k.cast("string"))),
            "sku_name": F.col("p_name"),
            "product_form": F.when(k % 2 == 0, "单品").otherwise("组合"),
            "category_l1": F.when(F.col("p_size") % 10 == 0, F.col("p_type")),
            "short_name": F.lit("s"),
            "case_pack": F.when(k % 9 != 0, F.col("p_size")),
            "source_product_code": F.when(k % 13 != 0, F.concat_ws("-", F.col("p_brand"), (k % 2).cast("string"))),
            "source_created_at": F.lit("2000-01-01"),
        },
    )
    rows = contracts.normalize_rows(rows, contracts.SKU_BOOTSTRAP).withColumn("findings", findings.no_findings()).withColumn("action", F.lit("NEW"))
    merge = spark.createDataFrame([("Brand#3-0",), ("Brand#3-1",)], "source_product_code string")
    return master_import.bootstrap_skus(rows, merge)


_BOOT_SKU = """boot AS (SELECT p_partkey AS k, p_name, CASE WHEN p_partkey % 50 = 1 THEN p_partkey - 1 ELSE p_partkey END AS code_key, p_partkey % 2 = 0 AS single, p_partkey % 9 = 0 AS no_pack,
    CASE WHEN p_size % 10 = 0 THEN p_type END AS l1, CASE WHEN p_partkey % 13 <> 0 THEN p_brand || '-' || (p_partkey % 2) END AS pc FROM part),
  boot_found AS (SELECT k, pc, dup, pc IS NOT NULL AND pc NOT LIKE 'Brand#3-%' AND forms > 1 AS conflict, pc LIKE 'Brand#3-%' AND forms > 1 AS merged, no_pack, single FROM (
    SELECT *, count(*) OVER (PARTITION BY code_key) > 1 AS dup, (SELECT count(DISTINCT b.l1) FROM boot b WHERE b.pc = boot.pc) AS forms FROM boot))"""


@query(
    "bootstrap_skus",
    oracle(
        """SELECT k AS row_number, CASE WHEN dup OR conflict THEN 'CONFLICT' ELSE 'NEW' END AS action, array_to_string(list_sort(list_filter(['MDM_IMPORT_PRODUCT_CANDIDATE',
  CASE WHEN no_pack THEN 'MDM_IMPORT_FIELD_MISSING_NONCRITICAL' END, CASE WHEN dup THEN 'MDM_IMPORT_DUPLICATE_UNIQUE_CODE' END,
  CASE WHEN merged THEN 'MDM_IMPORT_PRODUCT_MERGE_RESOLVED' END, CASE WHEN conflict THEN 'MDM_IMPORT_PRODUCT_MERGE_CONFLICT' END], lambda x: x IS NOT NULL)), ',') AS codes FROM boot_found""",
        _BOOT_SKU,
    ),
)
def bootstrap_skus(spark, sf_dir):
    return bootstrap_sku_rows(spark, sf_dir).select("row_number", "action", _codes())


# --- review ----------------------------------------------------------------


def review_tables(spark, sf_dir):
    """The customer import staged for review; two thirds of its warnings are acknowledged."""
    rows = stage(evaluated_customers(spark, sf_dir).select("batch_id", "row_number", "status", "customer_code", "parent_resolution", "findings"))
    # A finding is identified by its row and its place among the row's findings.
    found = rows.select("batch_id", F.posexplode("findings").alias("place", "f")).select(
        "batch_id",
        F.lit(1).alias("review_version"),
        (F.col("f.row_number") * 100 + F.col("place")).alias("finding_id"),
        F.lit(None).cast("bigint").alias("origin_id"),
        "f.row_number",
        "f.code",
        "f.severity",
    )
    staged = rows.select(
        "batch_id",
        "row_number",
        "status",
        F.when(F.col("status") == "EXISTING", "EXISTING").alias("commit_result"),
        F.create_map(F.lit("customer_code"), F.col("customer_code"), F.lit("parent_resolution"), F.col("parent_resolution")).alias("final_values"),
    )
    batches = spark.createDataFrame([("B1", 1, "REVIEW", 0)], "batch_id string, review_version int, status string, error_rows int")
    empty = spark.createDataFrame([], review_schema())
    requests = found.filter((F.col("severity") == "WARNING") & (F.col("row_number") % 3 != 0)).select("batch_id", F.lit(1).alias("review_version"), "finding_id", F.lit(" seen ").alias("reason")).distinct()
    return staged, batches, found, empty, requests


def review_schema():
    return (
        "batch_id string, review_version int, finding_id bigint, row_number bigint, subject_key string, issue_code string, "
        "decision_type string, decision string, reason string, resolved map<string,string>"
    )


@query(
    "row_readiness",
    oracle(
        """SELECT row_number, CASE WHEN status IN ('ERROR', 'EXISTING') THEN status WHEN w AND row_number % 3 = 0 THEN 'WARNING' ELSE 'READY' END AS status,
  CASE WHEN status NOT IN ('ERROR', 'EXISTING') AND NOT (w AND row_number % 3 = 0) THEN CASE WHEN codes LIKE '%PARENT_UNRESOLVED%' THEN 'ACKNOWLEDGED_NULL' ELSE parent_resolution END END AS parent_resolution
FROM (SELECT *, EXISTS (SELECT 1 FROM cust_found f WHERE f.row_number = r.row_number AND severity = 'WARNING') AS w FROM cust_rows r)""",
        *_CUSTOMER,
    ),
)
def row_readiness(spark, sf_dir):
    staged, batches, found, decisions, requests = review_tables(spark, sf_dir)
    batches, found, decisions = review.roll_version(batches, found, decisions, requests)
    rows = review.row_readiness(staged, batches, found, decisions)
    return rows.select("row_number", "status", F.col("reviewed_values").getItem("parent_resolution").alias("parent_resolution"))


@query(
    "review_roll",
    oracle(
        """SELECT v AS review_version, 'FINDINGS' AS entry, (SELECT count(*) FROM cust_found) AS entries FROM (VALUES (1), (2)) t(v)
UNION ALL SELECT 2, 'DECISIONS', count(*) FROM cust_found WHERE severity = 'WARNING' AND row_number % 3 <> 0""",
        *_CUSTOMER,
    ),
)
def review_roll(spark, sf_dir):
    _, batches, found, decisions, requests = review_tables(spark, sf_dir)
    _, found, decisions = review.roll_version(batches, found, decisions, requests)
    counted = [
        frame.groupBy("review_version").agg(F.count(F.lit(1)).alias("entries")).select("review_version", F.lit(label).alias("entry"), "entries")
        for frame, label in ((found, "FINDINGS"), (decisions, "DECISIONS"))
    ]
    return counted[0].unionByName(counted[1])


# --- lists, maintenance ----------------------------------------------------


@query(
    "product_search_semi",
    oracle(
        "SELECT product_id, product_code, product_name FROM m_product p WHERE lower(product_name) LIKE '%#2%' OR lower(product_code) LIKE '%#2%' "
        "OR EXISTS (SELECT 1 FROM m_sku s WHERE s.product_id = p.product_id AND (lower(sku_name) LIKE '%#2%' OR lower(sku_code) LIKE '%#2%'))"
    ),
)
def product_search_semi(spark, sf_dir):
    product = data.product(spark, sf_dir).drop("product_stable_id")
    return masters.search_products(product, data.sku(spark, sf_dir), "#2").select("product_id", "product_code", "product_name")


@query(
    "sku_search",
    oracle(
        "SELECT sku_id, sku_code, sku_name FROM m_sku s LEFT JOIN m_product p USING (product_id) WHERE lower(sku_name) LIKE '%ring%' OR lower(sku_code) LIKE '%ring%' "
        "OR lower(p.product_name) LIKE '%ring%' OR lower(p.product_code) LIKE '%ring%'"
    ),
)
def sku_search(spark, sf_dir):
    sku = data.sku(spark, sf_dir).drop("sku_stable_id")
    return masters.search_skus(sku, data.product(spark, sf_dir), "RING").select("sku_id", "sku_code", "sku_name")


@query(
    "customer_prefix_search",
    oracle("SELECT customer_id, customer_name FROM m_customer WHERE lower(customer_name) LIKE 'customer#00000001%' OR lower(customer_code) LIKE 'customer#00000001%'"),
)
def customer_prefix_search(spark, sf_dir):
    customer = data.customer(spark, sf_dir).drop("customer_stable_id")
    return masters.search(customer, "customer", "CUSTOMER#00000001").select("customer_id", "customer_name")


@query(
    "master_list_page",
    oracle(
        "SELECT customer_id, customer_name, channel_name, salesrep_name FROM m_customer JOIN m_channel USING (channel_id) JOIN m_salesrep USING (salesrep_id) "
        "WHERE customer_status = 'ACTIVE' AND salesrep_id IN (1, 2, 3, 4) ORDER BY customer_name DESC, customer_id LIMIT 25 OFFSET 25"
    ),
)
def master_list_page(spark, sf_dir):
    kept = masters.list_master(data.customer(spark, sf_dir), ("customer_status", "ACTIVE"), any_of={"salesrep_id": [1, 2, 3, 4]})
    named = masters.with_names(kept, {"channel_id": (data.channel(spark, sf_dir), ["channel_name"]), "salesrep_id": (data.salesrep(spark, sf_dir), ["salesrep_name"])})
    return masters.list_page(named.select("customer_id", "customer_name", "channel_name", "salesrep_name"), "customer_name", True, "customer_id", 2, 25)


@query(
    "sku_filter_values",
    oracle("SELECT DISTINCT field, value FROM (SELECT 'category_l1' AS field, category_l1 AS value FROM m_sku UNION ALL SELECT 'brand', brand FROM m_sku)"),
)
def sku_filter_values(spark, sf_dir):
    return masters.filter_values(data.sku(spark, sf_dir), ["category_l1", "brand"])


@query(
    "product_sku_counts",
    oracle("SELECT product_id, product_code, count(s.sku_id) AS sku_count FROM m_product LEFT JOIN m_sku s USING (product_id) GROUP BY 1, 2"),
)
def product_sku_counts(spark, sf_dir):
    return masters.products_with_sku_count(data.product(spark, sf_dir), data.sku(spark, sf_dir)).select("product_id", "product_code", "sku_count")


@query(
    "product_children",
    oracle("SELECT product_id, product_code, product_name, sku_id, sku_code, sku_name, case_pack, sku_status FROM m_product JOIN m_sku USING (product_id)"),
)
def product_children(spark, sf_dir):
    return masters.product_children(data.product(spark, sf_dir), data.sku(spark, sf_dir))


def channel_counts(spark, sf_dir):
    return masters.reference_counts({"customer": (data.customer(spark, sf_dir), "channel_id", "customer_status")})


@query(
    "reference_counts",
    oracle(
        "SELECT channel_id AS target_id, count(*) AS reference_count, count(*) FILTER (customer_status = 'ACTIVE') AS active_reference_count FROM m_customer GROUP BY 1"
    ),
)
def reference_counts(spark, sf_dir):
    return channel_counts(spark, sf_dir)


@query(
    "status_changes",
    oracle(
        """SELECT product_id AS change_id, product_id, new_status, CASE WHEN new_status = 'INACTIVE' THEN n ELSE n END AS references,
  CASE WHEN new_status = 'INACTIVE' AND n > 0 AND product_id % 3 <> 0 THEN 'CONFIRMATION_REQUIRED' WHEN product_status = new_status THEN 'UNCHANGED'
    WHEN new_status = 'INACTIVE' AND n > 0 THEN 'CHANGED_REFERENCES_RETAINED' ELSE 'CHANGED' END AS outcome
FROM (SELECT product_id, product_status, CASE WHEN product_id % 2 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS new_status,
  (SELECT count(*) FROM m_sku s WHERE s.product_id = p.product_id AND sku_status = 'ACTIVE') AS n FROM m_product p)"""
    ),
)
def status_changes(spark, sf_dir):
    product = data.product(spark, sf_dir)
    changes = product.select(
        F.col("product_id").alias("change_id"), "product_id", F.when(F.col("product_id") % 2 == 0, "INACTIVE").otherwise("ACTIVE").alias("new_status"), (F.col("product_id") % 3 == 0).alias("confirmed")
    )
    counts = masters.reference_counts({"sku": (data.sku(spark, sf_dir), "product_id", "sku_status")})
    return masters.status_changes(changes, product, "product_id", "product_status", counts, "confirm_active")


@query(
    "sku_reassignment",
    oracle(
        """SELECT sku_id AS change_id, sku_id, s.product_id AS source_product_id, t.product_id AS target_product_id,
  CASE WHEN s.product_id IS NULL THEN 'PRODUCT_REQUIRED' WHEN t.product_status <> 'ACTIVE' THEN 'INACTIVE_REFERENCE' WHEN s.product_id = t.product_id THEN 'UNCHANGED'
    WHEN sku_id % 3 <> 0 THEN 'CONFIRMATION_REQUIRED' ELSE 'CHANGED' END AS outcome,
  coalesce(t.product_status = 'ACTIVE' AND s.product_id <> t.product_id AND (SELECT count(*) FROM m_sku x WHERE x.product_id = s.product_id) = 1, false) AS source_product_empty
FROM m_sku s JOIN m_product t ON t.product_name = CASE WHEN partkey % 4 = 0 THEN 'Brand#13 ' ELSE 'Brand#2 ' END || category_l1"""
    ),
)
def sku_reassignment(spark, sf_dir):
    sku, product = data.sku(spark, sf_dir), data.product(spark, sf_dir)
    name = F.concat(F.when(F.col("partkey") % 4 == 0, "Brand#13 ").otherwise("Brand#2 "), F.col("category_l1"))
    target = product.select(F.col("product_name").alias("_t"), F.col("product_id").alias("target_product_id"))
    changes = sku.withColumn("_t", name).join(target, "_t").select(F.col("sku_id").alias("change_id"), "sku_id", "target_product_id", (F.col("sku_id") % 3 == 0).alias("confirmed"))
    return masters.reassign_skus(changes, sku, product)


@query(
    "significant_changes",
    oracle(
        "SELECT sku_id AS change_id, sku_id, CASE WHEN sku_id % 2 = 0 THEN 'case_pack' ELSE '' END AS changed_fields, sku_id % 2 = 0 AND sku_id % 3 <> 0 AS needs_confirmation FROM m_sku"
    ),
)
def significant_changes(spark, sf_dir):
    sku = data.sku(spark, sf_dir)
    pack = (F.col("case_pack") + F.when(F.col("sku_id") % 2 == 0, 1).otherwise(0)).cast("decimal(12,3)")
    changes = sku.select(F.col("sku_id").alias("change_id"), "sku_id", pack.alias("case_pack"), (F.col("sku_id") % 3 == 0).alias("confirmed"))
    return masters.significant_changes(changes, sku)


@query(
    "change_log",
    oracle(
        """SELECT sku_id AS entity_key, CASE WHEN f = 'sku_status' THEN 'STATUS_CHANGE' ELSE 'UPDATE' END AS action, f AS field_name,
  CASE f WHEN 'sku_status' THEN sku_status ELSE sku_name END AS old_value, CASE f WHEN 'sku_status' THEN 'INACTIVE' ELSE sku_name || '!' END AS new_value
FROM m_sku, (VALUES ('sku_status'), ('sku_name')) v(f) WHERE CASE f WHEN 'sku_status' THEN sku_id % 4 = 0 AND sku_status <> 'INACTIVE' ELSE sku_id % 6 = 0 END"""
    ),
)
def change_log(spark, sf_dir):
    before = data.sku(spark, sf_dir).select("sku_id", "sku_name", "sku_status")
    after = before.withColumns(
        {
            "sku_name": F.when(F.col("sku_id") % 6 == 0, F.concat("sku_name", F.lit("!"))).otherwise(F.col("sku_name")),
            "sku_status": F.when(F.col("sku_id") % 4 == 0, "INACTIVE").otherwise(F.col("sku_status")),
        }
    )
    log = commit.change_log(before, after, "sku_id", ["sku_name", "sku_status"], "SKU", "planner")
    return log.select("entity_key", "action", "field_name", "old_value", "new_value")


# --- audits ----------------------------------------------------------------


@query(
    "constraint_audit",
    oracle(
        """SELECT 'inventory_raw' AS table_name, rule, CASE rule WHEN 'month_start' THEN 0 WHEN 'balance' THEN (SELECT count(*) FROM inventory WHERE row_number % 10 = 0)
  ELSE (SELECT count(*) FROM inventory WHERE ending_qty < 0 OR opening_qty < 0) END AS broken_rows FROM (VALUES ('balance'), ('non_negative'), ('month_start')) v(rule)"""
    ),
)
def constraint_audit(spark, sf_dir):
    rows = data.inventory_rows(spark, sf_dir)
    faulty = rows.withColumn("issue_qty", F.col("issue_qty") + F.when(F.col("row_number") % 10 == 0, 1).otherwise(0))
    return audit.violation_counts(faulty, "inventory_raw")


@query(
    "constraint_violations",
    oracle("SELECT source_row_no, 'quantity_positive' AS rule FROM sales WHERE actual_qty <= 0"),
)
def constraint_violations(spark, sf_dir):
    return audit.violations(data.sales_rows(spark, sf_dir), "sales_fact", ["source_row_no"])


@query(
    "grain_audit",
    oracle(
        "SELECT source_document_no, source_line_no, snapshot_month, count(*) AS copies FROM sales GROUP BY 1, 2, 3 HAVING count(*) > 1"
    ),
)
def grain_audit(spark, sf_dir):
    rows = data.sales_rows(spark, sf_dir)
    return audit.repeated_grains(rows, ["source_document_no", "source_line_no", "snapshot_month"])


@query(
    "referential_audit",
    oracle(
        """SELECT 'order customer' AS link, CAST(1000000000 + o_custkey AS VARCHAR) AS missing_id, count(*) AS rows FROM orders WHERE o_custkey % 53 = 0 GROUP BY 2
UNION ALL SELECT 'customer rep', CAST(c_nationkey + 101 AS VARCHAR), count(*) FROM customer WHERE c_custkey % 19 = 0 GROUP BY 2
UNION ALL SELECT 'line SKU', CAST(-l_partkey AS VARCHAR), count(*) FROM lineitem WHERE l_suppkey % 23 = 0 GROUP BY 2
UNION ALL SELECT 'SKU product', '-1', count(*) FROM m_sku WHERE sku_id % 31 = 0 AND product_id IS NOT NULL HAVING count(*) > 0"""
    ),
)
def referential_audit(spark, sf_dir):
    """Four links, each broken on a share of its rows only; a SKU without product breaks none."""
    off = lambda when, lost, name: F.when(when, lost).otherwise(F.col(name)).cast("bigint").alias(name)
    orders = data.table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_custkey") + 1).alias("customer_id"))
    orders = orders.select(off(F.col("o_custkey") % 53 == 0, F.col("o_custkey") + 1_000_000_000, "customer_id"))
    reps = data.customer(spark, sf_dir).select(off((F.col("customer_id") - 1) % 19 == 0, F.col("salesrep_id") + 100, "salesrep_id"))
    lines = data.lines(spark, sf_dir).select("l_suppkey", "l_partkey", (F.col("l_partkey") * 2 + 1).alias("sku_id"))
    lines = lines.select(off(F.col("l_suppkey") % 23 == 0, -F.col("l_partkey"), "sku_id"))
    skus = data.sku(spark, sf_dir)
    homes = skus.select(off((F.col("sku_id") % 31 == 0) & F.col("product_id").isNotNull(), F.lit(-1), "product_id"))
    return audit.orphans(
        [
            ("order customer", orders, "customer_id", data.customer(spark, sf_dir), "customer_id"),
            ("customer rep", reps, "salesrep_id", data.salesrep(spark, sf_dir), "salesrep_id"),
            ("line SKU", lines, "sku_id", skus, "sku_id"),
            ("SKU product", homes, "product_id", data.product(spark, sf_dir), "product_id"),
        ]
    )
