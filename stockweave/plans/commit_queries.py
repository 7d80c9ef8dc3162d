"""Commit of reviewed master batches: gate, revalidation, creation, bootstrap.

The batches are the customers of a nation and the parts of a size class; a
share of their rows breaks each rule.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.functions.keys import identity_key, stable_id
from stockweave.operators import bootstrap_commit, commit
from stockweave.plans import standins as data
from stockweave.plans.registry import query
from stockweave.plans.scalar_queries import _stable_sql
from stockweave.plans.standins import oracle
from stockweave.sources.staging import stage

# --- customers -------------------------------------------------------------


def reviewed_customers(spark, sf_dir):
    """Every third row is known already; the others are new under codes of their own, a few of which are taken by now."""
    k, key = F.col("c_custkey"), F.col("c_custkey").cast("string")
    known = k % 3 == 0
    masters = data.customer(spark, sf_dir).select((F.col("customer_id") - 1).alias("c_custkey"), "customer_stable_id")
    reps = data.salesrep(spark, sf_dir).select((F.col("salesrep_id") - 1).cast("int").alias("c_nationkey"), "salesrep_stable_id")
    channels = data.channel(spark, sf_dir).select(F.col("channel_name").alias("c_mktsegment"), "channel_stable_id")
    rows = data.table(spark, sf_dir, "customer").join(masters, "c_custkey", "left").join(reps, "c_nationkey", "left").join(channels, "c_mktsegment", "left")
    parent = F.when(k % 5 == 1, "MASTER").when(k % 5 == 2, "ROW").when((k % 5 == 3) & (k % 11 == 0), "SELF").when((k % 5 == 4) & (k % 13 == 0), "LOST").otherwise("NONE")
    bosses = data.customer(spark, sf_dir).select(F.col("customer_id").alias("c_custkey"), F.col("customer_stable_id").alias("_boss"))
    return rows.join(bosses, "c_custkey", "left").select(
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("batch_id"),
        (k + 2).alias("row_number"),
        F.when(known, "EXISTING").when(k % 97 == 1, "ERROR").otherwise("READY").alias("status"),
        F.when(known, F.concat(F.lit("C"), key)).when(k % 41 == 1, F.concat(F.lit("c"), (k - 1).cast("string"))).otherwise(F.concat(F.lit("NEW"), key)).alias("customer_code"),
        F.when(k % 37 == 3, F.concat("c_name", F.lit(" AG"))).otherwise(F.col("c_name")).alias("customer_name"),
        F.when(known, F.col("customer_stable_id")).alias("matched_stable_id"),
        F.when(k % 43 != 1, F.col("channel_stable_id")).alias("channel_stable_id"),
        "salesrep_stable_id",
        F.when(~known & (k % 71 != 1), "{}").alias("reviewed_values"),
        F.when(known & (k % 73 != 0), "EXISTING").alias("commit_result"),
        F.when(k % 79 == 1, "{}").alias("committed_snapshot"),
        F.when(parent == "NONE", "EMPTY").otherwise("RESOLVED").alias("parent_resolution"),
        F.when(parent == "MASTER", F.col("_boss")).when(parent == "SELF", stable_id("CUSTOMER", identity_key("customer_code_name", F.concat(F.lit("NEW"), key), "c_name"))).alias("parent_stable_id"),
        F.when(parent == "ROW", k + 2).when(parent == "LOST", F.lit(-1)).alias("parent_row"),
    )


_REVIEWED = """reviewed AS (
  SELECT 'N' || c_nationkey AS batch_id, c_custkey + 2 AS row_number, c_custkey AS k, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN 'EXISTING' WHEN c_custkey % 97 = 1 THEN 'ERROR' ELSE 'READY' END AS status,
    CASE WHEN c_custkey % 3 = 0 THEN 'C' || c_custkey WHEN c_custkey % 41 = 1 THEN 'c' || (c_custkey - 1) ELSE 'NEW' || c_custkey END AS code,
    c_name || CASE WHEN c_custkey % 37 = 3 THEN ' AG' ELSE '' END AS name FROM customer)"""


@query(
    "commit_quality_gate",
    oracle(
        """SELECT batch_id, row_number, 'ERROR_OPEN' AS code FROM reviewed WHERE status = 'ERROR'
UNION ALL SELECT batch_id, row_number, 'WARNING_OPEN' FROM reviewed WHERE k % 83 = 1
UNION ALL SELECT batch_id, row_number, 'ROW_NOT_READY' FROM reviewed WHERE status = 'ERROR'
UNION ALL SELECT batch_id, row_number, 'CREATE_ONLY_VIOLATION' FROM reviewed WHERE (status = 'READY' AND (k % 71 = 1 OR k % 79 = 1)) OR (status = 'EXISTING' AND (k % 73 = 0 OR k % 79 = 1))
UNION ALL SELECT batch_id, min(row_number), 'DUPLICATE_CODE' FROM reviewed GROUP BY batch_id, lower(code) HAVING count(*) > 1""",
        _REVIEWED,
    ),
)
def commit_quality_gate(spark, sf_dir):
    rows = stage(reviewed_customers(spark, sf_dir))
    warnings = rows.filter((F.col("row_number") - 2) % 83 == 1)
    return commit.quality_gate(rows, warnings, rows.filter("status = 'ERROR'"), F.lower("customer_code"))


@query(
    "customer_revalidation",
    oracle(
        """SELECT batch_id, row_number, 'EXISTING_CHANGED' AS code FROM reviewed WHERE status = 'EXISTING' AND (k % 53 = 0 OR k % 37 = 3)
UNION ALL SELECT batch_id, row_number, 'CODE_TAKEN' FROM reviewed WHERE status = 'READY' AND lower(code) IN (SELECT lower(customer_code) FROM m_customer)
UNION ALL SELECT batch_id, row_number, 'CHANNEL_MISSING_OR_INACTIVE' FROM reviewed WHERE status = 'READY' AND k % 43 = 1
UNION ALL SELECT batch_id, row_number, 'SALESREP_MISSING_OR_INACTIVE' FROM reviewed WHERE status = 'READY' AND c_nationkey % 11 = 5""",
        _REVIEWED,
    ),
)
def customer_revalidation(spark, sf_dir):
    references = {
        "channel_stable_id": (data.channel(spark, sf_dir), "channel_stable_id", "channel_status", True),
        "salesrep_stable_id": (data.salesrep(spark, sf_dir), "salesrep_stable_id", "salesrep_status", False),
    }
    return commit.revalidate_customers(stage(reviewed_customers(spark, sf_dir)), data.customer(spark, sf_dir), references)


def _batch_parents(rows):
    """A row's parent in its batch is the new row with the least number there; the first itself has none."""
    creates = rows.filter("status = 'READY'").groupBy("batch_id").agg(F.min("row_number").alias("_first"))
    joined = rows.join(creates, "batch_id", "left")
    named = (F.col("parent_row") > 0) & F.col("parent_row").isNotNull()
    return joined.withColumn("parent_row", F.when(named, F.col("_first")).otherwise(F.col("parent_row"))).drop("_first")


def _customer_stable(code, name):
    return _stable_sql("CUSTOMER", "CUS_", f"'CUSTOMER:CODE_NAME:' || {code} || '|' || {name}")


_MADE = f"""made AS (SELECT *, {_customer_stable("code", "name")} AS own, min(row_number) OVER (PARTITION BY batch_id) AS first_row FROM reviewed WHERE status = 'READY'),
parented AS (SELECT m.*, CASE WHEN k % 5 = 1 THEN {_customer_stable("(k - 1)", "boss.customer_name")} WHEN k % 5 = 2 THEN f.own
  WHEN k % 5 = 3 AND k % 11 = 0 THEN {_customer_stable("'NEW' || m.k", "c_name")} END AS parent, k % 5 IN (1, 2) OR (k % 5 = 3 AND k % 11 = 0) OR (k % 5 = 4 AND k % 13 = 0) AS resolved
  FROM made m JOIN customer ON c_custkey = k LEFT JOIN m_customer boss ON boss.customer_id = k LEFT JOIN (SELECT batch_id, row_number, own FROM made) f ON f.batch_id = m.batch_id AND f.row_number = m.first_row)"""


@query("customer_creation", oracle("SELECT batch_id, row_number, own AS customer_stable_id, code AS customer_code, parent AS parent_customer_stable_id, 'ACTIVE' AS customer_status FROM parented", _REVIEWED, _MADE))
def customer_creation(spark, sf_dir):
    """Parents of all kinds: a master, a new row of the batch, the row itself, a row that is not there, none."""
    made = commit.create_customers(_batch_parents(stage(reviewed_customers(spark, sf_dir))))
    return made.select("batch_id", "row_number", "customer_stable_id", "customer_code", "parent_customer_stable_id", "customer_status")


@query(
    "customer_parent_findings",
    oracle(
        """SELECT batch_id, row_number, 'PARENT_SELF' AS code FROM parented WHERE parent = own
UNION ALL SELECT batch_id, row_number, 'PARENT_ROW_NOT_CREATED' FROM parented WHERE resolved AND parent IS NULL""",
        _REVIEWED,
        _MADE,
    ),
)
def customer_parent_findings(spark, sf_dir):
    return commit.parent_findings(commit.create_customers(_batch_parents(stage(reviewed_customers(spark, sf_dir)))))


# --- products and SKUs -----------------------------------------------------


def _product_names(spark, sf_dir):
    """The master's products: one per brand and type, its name as code of its own."""
    return data.product(spark, sf_dir).withColumn("product_code", F.col("product_name"))


def reviewed_parts(spark, sf_dir):
    """Parts by size class: every fourth is a known SKU, the others are new; some name no product or one that is off."""
    k, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    known = k % 4 == 0
    skus = data.sku(spark, sf_dir).filter("sku_id = partkey * 2 + 1").select(F.col("partkey").alias("p_partkey"), F.col("sku_stable_id").alias("matched"), F.col("sku_code").alias("stored_code"))
    name = F.concat_ws(" ", "p_brand", "p_type")
    fresh = k % 7 == 1
    product = _product_names(spark, sf_dir).select(F.col("product_name").alias("_pn"), "product_stable_id")
    rows = data.table(spark, sf_dir, "part").join(skus, "p_partkey", "left").join(product, name == F.col("_pn"), "left")
    return rows.select(
        F.concat(F.lit("S"), (F.col("p_size") % 5).cast("string")).alias("batch_id"),
        (k + 2).alias("row_number"),
        F.when(known, "EXISTING").otherwise("READY").alias("status"),
        F.when(known, F.col("stored_code")).when(k % 41 == 1, F.concat(F.lit("SKU-"), key)).otherwise(F.concat(F.lit("NEW-"), key)).alias("sku_code"),
        F.when(k % 37 == 4, F.concat("p_name", F.lit(" XL"))).otherwise(F.col("p_name")).alias("sku_name"),
        F.when(known, F.col("matched")).alias("matched_stable_id"),
        F.when(k % 31 == 1, "nothing").otherwise(name).alias("product_code_ref"),
        F.when(fresh, F.concat(F.lit("Fresh "), (k % 50).cast("string"))).otherwise(name).alias("product_code"),
        F.when(fresh, "CREATE").otherwise("EXISTING").alias("plan_action"),
        F.when(fresh, F.concat(F.lit("Fresh "), (k % 50).cast("string"))).alias("plan_code"),
        F.when(fresh, F.concat(F.lit("Line "), (k % 50).cast("string"))).alias("plan_name"),
        F.col("p_brand").alias("plan_brand"),
        F.when(~fresh & (k % 29 != 1), F.col("product_stable_id")).alias("plan_product_stable_id"),
    )


_PARTS = """rp AS (SELECT 'S' || (p_size % 5) AS batch_id, p_partkey + 2 AS row_number, p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN 'EXISTING' ELSE 'READY' END AS status,
  p_brand, p_brand || ' ' || p_type AS product, CASE WHEN p_partkey % 4 <> 0 THEN CASE WHEN p_partkey % 41 = 1 THEN 'SKU-' || p_partkey ELSE 'NEW-' || p_partkey END END AS new_code,
  p_partkey % 7 = 1 AS fresh, 'Fresh ' || (p_partkey % 50) AS fresh_code FROM part)"""


@query(
    "sku_revalidation",
    oracle(
        """SELECT batch_id, row_number, 'EXISTING_CHANGED' AS code FROM rp WHERE status = 'EXISTING' AND k % 37 = 4
UNION ALL SELECT batch_id, row_number, 'CODE_TAKEN' FROM rp WHERE status = 'READY' AND new_code IN (SELECT sku_code FROM m_sku)
UNION ALL SELECT batch_id, row_number, 'PRODUCT_MISSING' FROM rp WHERE status = 'READY' AND k % 31 = 1
UNION ALL SELECT batch_id, row_number, 'PRODUCT_INACTIVE' FROM rp WHERE status = 'READY' AND k % 31 <> 1 AND p_brand = 'Brand#13'""",
        _PARTS,
    ),
)
def sku_revalidation(spark, sf_dir):
    return commit.revalidate_skus(stage(reviewed_parts(spark, sf_dir)), data.sku(spark, sf_dir), _product_names(spark, sf_dir))


@query(
    "goods_revalidation",
    oracle(
        """SELECT batch_id, row_number, 'EXISTING_CHANGED' AS code FROM rp WHERE status = 'EXISTING' AND k % 37 = 4
UNION ALL SELECT batch_id, row_number, 'CODE_TAKEN' FROM rp WHERE status = 'READY' AND new_code IN (SELECT sku_code FROM m_sku)
UNION ALL SELECT batch_id, row_number, 'PRODUCT_MISSING_OR_INACTIVE' FROM rp WHERE status = 'READY' AND NOT fresh AND (k % 29 = 1 OR p_brand = 'Brand#13')
UNION ALL SELECT batch_id, row_number, 'PRODUCT_CODE_TAKEN' FROM rp WHERE status = 'READY' AND fresh AND k % 50 = 8""",
        _PARTS,
    ),
)
def goods_revalidation(spark, sf_dir):
    """By the time of the commit one of the fresh codes has been given away."""
    taken = data.product(spark, sf_dir).limit(1).select("product_stable_id", F.lit("FRESH 8").alias("product_code"), F.lit("ACTIVE").alias("product_status"))
    masters = _product_names(spark, sf_dir).select("product_stable_id", "product_code", "product_status").unionByName(taken.withColumn("product_stable_id", F.lit("PRD_TAKEN")))
    return commit.revalidate_goods(stage(reviewed_parts(spark, sf_dir)), data.sku(spark, sf_dir), masters)


_SKU_ID = _stable_sql("SKU", "SKU_", "'SKU:SOURCE_CODE:' || new_code")
_PRODUCT_ID = lambda key: _stable_sql("PRODUCT", "PRD_", f"'PRODUCT:SOURCE_CODE:' || {key}")


@query(
    "sku_creation",
    oracle(
        f"SELECT batch_id, row_number, {_SKU_ID} AS sku_stable_id, new_code AS sku_code, {_PRODUCT_ID('product')} AS product_stable_id, 'ACTIVE' AS sku_status FROM rp WHERE status = 'READY' AND k % 31 <> 1",
        _PARTS,
    ),
)
def sku_creation(spark, sf_dir):
    made = commit.create_skus(stage(reviewed_parts(spark, sf_dir)).drop("product_code"), _product_names(spark, sf_dir))
    return made.select("batch_id", "row_number", "sku_stable_id", "sku_code", "product_stable_id", "sku_status")


@query(
    "goods_creation",
    oracle(
        f"""SELECT 'PRODUCT' AS entity, batch_id, min(row_number) AS row_number, {_PRODUCT_ID('fresh_code')} AS stable_id, fresh_code AS code, 'Line ' || substr(fresh_code, 7) AS name,
  NULL AS product_stable_id FROM rp WHERE status = 'READY' AND fresh GROUP BY batch_id, fresh_code
UNION ALL SELECT 'SKU', batch_id, row_number, {_SKU_ID}, new_code, p_name || CASE WHEN k % 37 = 4 THEN ' XL' ELSE '' END,
  CASE WHEN fresh THEN {_PRODUCT_ID('fresh_code')} WHEN k % 29 <> 1 THEN {_PRODUCT_ID('product')} END FROM rp JOIN part ON p_partkey = k WHERE status = 'READY'""",
        _PARTS,
    ),
)
def goods_creation(spark, sf_dir):
    products, skus = commit.create_goods(stage(reviewed_parts(spark, sf_dir)), _product_names(spark, sf_dir))
    made = products.select(F.lit("PRODUCT").alias("entity"), "batch_id", F.col("first_row").alias("row_number"), F.col("product_stable_id").alias("stable_id"), F.col("product_code").alias("code"), F.col("product_name").alias("name"), F.lit(None).cast("string").alias("product_stable_id"))
    return made.unionByName(skus.select(F.lit("SKU").alias("entity"), "batch_id", "row_number", F.col("sku_stable_id").alias("stable_id"), F.col("sku_code").alias("code"), F.col("sku_name").alias("name"), "product_stable_id"))


@query(
    "goods_commit_summary",
    oracle(
        """SELECT batch_id, count(DISTINCT CASE WHEN status = 'READY' AND fresh THEN fresh_code END) AS products_created, count(*) FILTER (status = 'READY') AS skus_created,
  count(*) FILTER (status = 'EXISTING') AS existing, count(*) AS total FROM rp GROUP BY 1""",
        _PARTS,
    ),
)
def goods_commit_summary(spark, sf_dir):
    return commit.goods_summary(reviewed_parts(spark, sf_dir))


def reviewed_products(spark, sf_dir):
    """Brand and type as new product codes; every fifth name is that of a known product."""
    pairs = _product_names(spark, sf_dir)
    k = F.col("product_id")
    known = k % 4 == 0
    return pairs.select(
        F.col("brand").alias("batch_id"),
        k.alias("row_number"),
        F.when(known, "EXISTING").otherwise("READY").alias("status"),
        F.when(known, F.col("product_name")).when(k % 9 == 1, F.upper("product_name")).otherwise(F.concat(F.lit("P-"), k.cast("string"))).alias("product_code"),
        F.when(k % 5 == 1, F.upper("product_name")).when(known & (k % 7 != 0), F.col("product_name")).otherwise(F.concat(F.lit("New "), "product_name")).alias("product_name"),
        F.when(known, F.col("product_stable_id")).alias("matched_stable_id"),
        "brand",
        F.col("product_stable_id").alias("_own"),
    )


@query(
    "product_revalidation",
    oracle(
        """, rq AS (SELECT brand AS batch_id, product_id AS row_number, product_id AS k, product_id % 4 = 0 AS known FROM m_product)
SELECT batch_id, row_number, 'EXISTING_CHANGED' AS code FROM rq WHERE known AND k % 7 = 0 AND k % 5 <> 1
UNION ALL SELECT batch_id, row_number, 'CODE_TAKEN' FROM rq WHERE NOT known AND k % 9 = 1
UNION ALL SELECT batch_id, row_number, 'NAME_CONFLICT_CHANGED' FROM rq WHERE NOT known AND k % 5 = 1 AND (k % 3 <> 0 OR k % 2 = 1)"""
    ),
)
def product_revalidation(spark, sf_dir):
    """Acknowledged are the conflicts of every third row, half of them with a product more that is gone by now; a row without a conflict today needs none."""
    rows = stage(reviewed_products(spark, sf_dir))
    acknowledged = rows.filter((F.col("status") == "READY") & (F.col("row_number") % 3 == 0)).select("batch_id", "row_number", F.col("_own").alias("candidate_stable_id"))
    gone = acknowledged.filter("row_number % 2 = 1").withColumn("candidate_stable_id", F.lit("PRD_GONE"))
    acknowledged = acknowledged.unionByName(gone)
    return commit.revalidate_products(rows, _product_names(spark, sf_dir), acknowledged)


@query(
    "product_creation",
    oracle(
        f""", rq AS (SELECT brand AS batch_id, product_id AS row_number, CASE WHEN product_id % 9 = 1 THEN upper(product_name) ELSE 'P-' || product_id END AS code,
  CASE WHEN product_id % 5 = 1 THEN upper(product_name) ELSE 'New ' || product_name END AS name, brand FROM m_product WHERE product_id % 4 <> 0)
SELECT batch_id, row_number, {_PRODUCT_ID('code')} AS product_stable_id, code AS product_code, name AS product_name, brand, 'ACTIVE' AS product_status FROM rq"""
    ),
)
def product_creation(spark, sf_dir):
    return commit.create_products(reviewed_products(spark, sf_dir))


# --- bootstrap -------------------------------------------------------------


def bootstrap_parts(spark, sf_dir):
    """A bootstrap of all parts in five batches, with stored mappings, found masters, excluded rows and every conflict in a batch of its own."""
    k, code = F.col("p_partkey"), F.concat(F.lit("SKU-"), F.col("p_partkey").cast("string"))
    part = data.table(spark, sf_dir, "part").withColumn("turn", F.col("p_size") % 5)
    product = F.concat_ws(" ", "p_brand", "p_type")
    rows = part.select(
        F.concat(F.lit("B"), F.col("turn").cast("string")).alias("batch_id"),
        (k + 2).alias("row_number"),
        F.lit("ERP").alias("source_system"),
        code.alias("sku_code"),
        F.col("p_name").alias("sku_name"),
        product.alias("source_product_code"),
        F.col("p_size").cast("string").alias("case_pack"),
        (k % 29 == 0).alias("excluded"),
    )
    names = rows.select("batch_id", "source_product_code").distinct()
    representatives = names.filter(~((F.col("batch_id") == "B2") & F.col("source_product_code").startswith("Brand#2"))).withColumn("product_name", F.concat(F.lit("The "), "source_product_code"))
    stored = part.filter(k % 6 == 0).select(
        F.lit("SKU").alias("entity_type"),
        (k * 2 + 1).alias("entity_id"),
        F.lit("ERP").alias("source_system"),
        identity_key("sku", code).alias("external_code"),
        F.when((F.col("turn") == 3) & (k % 9 == 0), "Another").otherwise(F.col("p_name")).alias("external_name"),
        F.lit("ACTIVE").alias("status"),
    )
    legacy = part.filter((F.col("turn") == 4) & (k % 44 == 4)).select(
        F.lit("SKU").alias("entity_type"), (k * 2 + 1).alias("entity_id"), F.lit("ERP").alias("source_system"), F.concat(F.lit("LEGACY-"), k.cast("string")).alias("external_code"), F.lit("old").alias("external_name"), F.lit("ACTIVE").alias("status")
    )
    products = data.product(spark, sf_dir).select("product_id", stable_id("PRODUCT", identity_key("product", "product_name")).alias("product_stable_id"))
    own = part.select(
        (k * 2 + 1).alias("sku_id"),
        F.when((k % 4 == 0) | (k % 6 == 0), stable_id("SKU", identity_key("sku", code))).otherwise(F.concat(F.lit("OLD_"), k.cast("string"))).alias("sku_stable_id"),
        F.when((F.col("turn") == 1) & (k % 60 == 12), F.lit("PRD_OTHER")).otherwise(stable_id("PRODUCT", identity_key("product", product))).alias("product_stable_id"),
    )
    return bootstrap_commit.commit_skus(rows, representatives, stored.unionByName(legacy), products, own, ["case_pack"])


_SKU_KEY = "'SKU:SOURCE_CODE:SKU-' || p_partkey"
_SKU_OWN = _stable_sql("SKU", "SKU_", _SKU_KEY)
_PRODUCT_OWN = _stable_sql("PRODUCT", "PRD_", "'PRODUCT:SOURCE_CODE:' || p_brand || ' ' || p_type")
_BOOT = [
    f"""boot AS (SELECT p_partkey AS k, 'B' || (p_size % 5) AS batch_id, p_partkey + 2 AS row_number, p_partkey % 29 = 0 AS excluded, p_brand || ' ' || p_type AS product, p_name, p_size,
  {_SKU_OWN} AS own, {_PRODUCT_OWN} AS product_id, CASE WHEN p_partkey % 29 = 0 THEN 'EXCLUDED' WHEN p_partkey % 6 = 0 THEN CASE WHEN p_size % 5 = 3 AND p_partkey % 9 = 0 THEN 'SOURCE_KEY_REUSED' ELSE 'MAPPED' END
    WHEN p_partkey % 4 = 0 THEN 'FOUND' ELSE 'CREATE' END AS outcome FROM part)""",
    """boot_found AS (SELECT batch_id, row_number, 'SOURCE_KEY_REUSED' AS code FROM boot WHERE outcome = 'SOURCE_KEY_REUSED'
  UNION ALL SELECT batch_id, row_number, 'ENTITY_MAPPED_TWICE' FROM boot WHERE batch_id = 'B4' AND k % 44 = 4 AND outcome IN ('MAPPED', 'FOUND')
  UNION ALL SELECT batch_id, row_number, 'SKU_OF_OTHER_PRODUCT' FROM boot WHERE batch_id = 'B1' AND k % 60 = 12 AND NOT excluded
  UNION ALL SELECT batch_id, row_number, 'PRODUCT_REPRESENTATIVE_REQUIRED' FROM boot WHERE batch_id = 'B2' AND product LIKE 'Brand#2%' AND NOT excluded)""",
    "clean AS (SELECT * FROM boot WHERE batch_id NOT IN (SELECT batch_id FROM boot_found))",
]


@query("bootstrap_conflicts", oracle("SELECT * FROM boot_found", *_BOOT))
def bootstrap_conflicts(spark, sf_dir):
    return bootstrap_parts(spark, sf_dir)["conflicts"]


@query(
    "bootstrap_masters",
    oracle(
        """SELECT 'SKU' AS entity, batch_id, row_number, own AS stable_id, 'SKU-' || k AS code, p_name AS name, product_id AS product_stable_id, p_size::VARCHAR AS case_pack FROM clean WHERE outcome = 'CREATE'""",
        *_BOOT,
    ),
)
def bootstrap_masters(spark, sf_dir):
    """New SKUs bound to their products; every product of the master has the stable id of its code, so none is new."""
    made = bootstrap_parts(spark, sf_dir)
    skus = made["skus"].select(F.lit("SKU").alias("entity"), "batch_id", "row_number", "stable_id", F.col("sku_code").alias("code"), F.col("sku_name").alias("name"), "product_stable_id", "case_pack")
    products = made["products"].select(F.lit("PRODUCT").alias("entity"), "batch_id", "row_number", "stable_id", F.col("product_code").alias("code"), F.col("product_name").alias("name"), F.lit(None).cast("string").alias("product_stable_id"), F.lit(None).cast("string").alias("case_pack"))
    return skus.unionByName(products)


@query(
    "bootstrap_mappings",
    oracle(
        """SELECT batch_id, 'SKU' AS entity_type, own AS stable_id, 'SKU:SOURCE_CODE:SKU-' || k AS external_code, p_name AS external_name FROM clean WHERE outcome IN ('CREATE', 'FOUND')
UNION ALL SELECT DISTINCT batch_id, 'PRODUCT', product_id, 'PRODUCT:SOURCE_CODE:' || product, product FROM clean WHERE NOT excluded""",
        *_BOOT,
    ),
)
def bootstrap_mappings(spark, sf_dir):
    return bootstrap_parts(spark, sf_dir)["mappings"].select("batch_id", "entity_type", "stable_id", "external_code", "external_name")


@query(
    "bootstrap_audit",
    oracle(
        """SELECT batch_id, 'SKU' AS entity_type, own AS entity_stable_id, 'CREATE' AS action, '{"stable_id":"' || own || '","sku_code":"SKU-' || k || '","sku_name":"' || p_name || '","product_stable_id":"' || product_id ||
  '","source_product_code":"' || product || '","case_pack":"' || p_size || '"}' AS snapshot_after FROM clean WHERE outcome = 'CREATE'""",
        *_BOOT,
    ),
)
def bootstrap_audit(spark, sf_dir):
    return bootstrap_parts(spark, sf_dir)["audit"].select("batch_id", "entity_type", "entity_stable_id", "action", "snapshot_after")


@query(
    "bootstrap_rows",
    oracle("SELECT batch_id, row_number, CASE WHEN excluded THEN 'SKIPPED' ELSE 'COMMITTED' END AS status, CASE WHEN NOT excluded THEN own END AS entity_stable_id FROM clean", *_BOOT),
)
def bootstrap_rows(spark, sf_dir):
    return bootstrap_parts(spark, sf_dir)["rows"]


@query(
    "bootstrap_summary",
    oracle(
        """SELECT batch_id, count(*) FILTER (NOT excluded) AS committed_master_rows, count(*) FILTER (excluded) AS excluded_rows, count(*) AS finalized_rows,
  count(*) FILTER (outcome = 'CREATE') AS created_master_rows, 0 AS created_product_rows, count(DISTINCT product) FILTER (NOT excluded) AS product_count FROM clean GROUP BY 1""",
        *_BOOT,
    ),
)
def bootstrap_summary(spark, sf_dir):
    return bootstrap_parts(spark, sf_dir)["summary"]
