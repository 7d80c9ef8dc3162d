"""Secret scans with corpus-wide ownership frequency.

Base spans, leftmost and not overlapping within a kind: `assign` (a name like password or token, a sign, a value of 12 or more characters), `access` (AKIA keys of 18 or more), `hex` (16 or more of `[0-9a-f]`). The method adds spans of two further kinds, `key` (tokens with a vendor's prefix) and `blob` (32 or more base64 characters with a letter and a digit, outside all base spans), but only such whose value looks live: every value, base or added, is counted over the corpus by distinct owners and repositories, and a value that `example_owners` owners or more share is an example that was copied around. Base spans always stay; the class of their values is reported beside them.

A repository is a document row, an owner is the `owner` column (null is an owner of its own). Offsets count code points, the end is exclusive. Null text is empty. Repeated rows are repositories each and get equal results; null ids match themselves. Other columns are not read.

Spark has no function for the places of all matches, so places come from the lengths of the pieces that `split` leaves and of the matches that `regexp_extract_all` finds: both walk the same matches. One pass over the texts leaves one narrow row per document; only candidate values are exploded, combined before the shuffle and joined back, so an example in a third of all documents is a few partial counts. All of it is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let
from .stage import written

# The patterns of the base and of the added kinds.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KEY = r"(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|AIza|[rs]k_live_|eyJ[A-Za-z0-9_-]{8,}\.)[A-Za-z0-9_.-]{16,}"
BLOB = r"[A-Za-z0-9+/]{32,}"
KINDS = ("assign", "access", "hex", "key", "blob")
_BASE = 3
_SPAN = "struct<start:int,kind:int,stop:int,h1:bigint,h2:bigint>"


def _spans(text: Column, kind: int, pattern: str, group: int, shortest: int) -> Column:
    """Spans of one kind in order; the value is the pattern's group. Texts without a match are not split."""

    def placed(pieces: Column) -> Column:
        def step(state: Column, x: Column) -> Column:
            start = state["at"] + F.length(x["piece"])
            stop = start + F.length(x["found"])
            span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), F.xxhash64(x["value"]).alias("h1"), F.xxhash64(F.lit(kind // _BASE), x["value"]).alias("h2")).cast(_SPAN)
            keep = F.length(x["value"]) >= shortest
            return F.struct(stop.alias("at"), F.when(keep, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

        return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans")), step, lambda s: s["spans"])

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    # the piece after the last match has no match beside it and is cut off
    pieces = let(F.arrays_zip(F.split(text, pattern, -1).alias("piece"), found.alias("found"), values.alias("value")), lambda z: F.slice(z, F.lit(1), F.size(z) - 1))
    return F.when(text.rlike(pattern), let(pieces, placed)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def scan(docs: DataFrame, owner: str = "source", example_owners: int = 3) -> DataFrame:
    """(doc_id, text, owner column) -> doc_id, base and added (arrays of start, kind, stop), and how many values of the row look live or like examples."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.col(owner).cast("string").alias("owner"), F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k2"), text.alias("text"))
    base = F.concat(_spans(F.col("text"), 0, ASSIGN, 2, 12), _spans(F.col("text"), 1, ACCESS, 0, 18), _spans(F.col("text"), 2, HEX, 0, 16))
    rows = rows.select("doc_id", "owner", "k1", "k2", F.array_sort(base).alias("base"), _spans(F.col("text"), 3, KEY, 0, 16).alias("keys"), _spans(F.col("text"), 4, BLOB, 0, 32).alias("blobs"), F.col("text"))
    covered = lambda s, spans: F.exists(spans, lambda b: (b["start"] <= s["start"]) & (b["stop"] >= s["stop"]))
    word = lambda s: F.substring(F.col("text"), s["start"] + 1, s["stop"] - s["start"])
    blobs = F.filter("blobs", lambda s: ~covered(s, F.col("base")) & ~covered(s, F.col("keys")) & word(s).rlike("[0-9]") & word(s).rlike("[A-Za-z]"))
    rows = rows.select("doc_id", "owner", "k1", "k2", "base", F.concat(F.filter("keys", lambda s: ~covered(s, F.col("base"))), blobs).alias("more"))
    rows = written(rows, "secret-spans")

    values = rows.select("k1", "k2", "owner", F.explode(F.array_distinct(F.transform(F.concat("base", "more"), lambda s: F.struct(s["h1"].alias("h1"), s["h2"].alias("h2"))))).alias("v"))
    values = values.select("k1", "k2", "owner", "v.h1", "v.h2")
    by_owner = values.groupBy("h1", "h2", "owner").agg(F.count("*").alias("n"))
    frequency = by_owner.groupBy("h1", "h2").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    frequency = written(frequency, "secret-frequency")
    known = values.join(frequency, ["h1", "h2"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("h1", "h2", "owners", "repositories")).alias("known"))
    rows = rows.join(known, ["k1", "k2"], "left")
    live = F.transform(F.filter("known", lambda v: v["owners"] < example_owners), lambda v: F.struct(v["h1"].alias("h1"), v["h2"].alias("h2")))
    rows = rows.withColumn("live", F.coalesce(live, F.array().cast("array<struct<h1:bigint,h2:bigint>>")))
    added = F.filter("more", lambda s: F.array_contains(F.col("live"), F.struct(s["h1"].alias("h1"), s["h2"].alias("h2"))))
    return rows.select("doc_id", "base", F.array_sort(added).alias("added"), F.size("live").cast("long").alias("n_live"), (F.size(F.coalesce("known", F.array())) - F.size("live")).cast("long").alias("n_example"))


def _written_out(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    found = scan(docs)
    of_kind = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    counts = [of_kind(i) for i in range(_BASE)]
    return found.select("doc_id", *counts, F.sha2(_written_out(F.col("base")), 256).alias("base_sha256"), _written_out(F.array_sort(F.concat("base", "added"))).alias("spans"), "n_live", "n_example")


def _kind_sql(kind: int, pattern: str, group: int, shortest: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, source, {kind} AS kind, text,
         list_sum([length(x) for x in parts[1:i]])::INT + coalesce(list_sum([length(x) for x in found[1:i - 1]]), 0)::INT AS start, length(found[i]) AS n, vals[i] AS v
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (
    SELECT doc_id, source, text, string_split_regex(text, '{p}') AS parts, regexp_extract_all(text, '{p}') AS found, regexp_extract_all(text, '{p}', {group}) AS vals
    FROM d WHERE regexp_matches(text, '{p}'))) WHERE length(vals[i]) >= {shortest}"""


OP8_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
b AS ({" UNION ALL ".join((_kind_sql(0, ASSIGN, 2, 12), _kind_sql(1, ACCESS, 0, 18), _kind_sql(2, HEX, 0, 16)))}),
k AS (SELECT * FROM ({_kind_sql(3, KEY, 0, 16)}) x WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = x.doc_id AND b.start <= x.start AND b.start + b.n >= x.start + x.n)),
bk AS (SELECT * FROM b UNION ALL {_kind_sql(3, KEY, 0, 16)}),
l AS (SELECT * FROM ({_kind_sql(4, BLOB, 0, 32)}) x WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
      AND NOT EXISTS (SELECT 1 FROM bk WHERE bk.doc_id = x.doc_id AND bk.start <= x.start AND bk.start + bk.n >= x.start + x.n)),
a AS (SELECT *, kind // 3 AS g FROM (SELECT * FROM b UNION ALL SELECT * FROM k UNION ALL SELECT * FROM l)),
f AS (SELECT g, v, count(DISTINCT coalesce(source, chr(1))) AS owners FROM a GROUP BY g, v),
s AS (SELECT a.*, owners, ['assign', 'access', 'hex', 'key', 'blob'][kind + 1] || ':' || start || ':' || (start + n) AS t FROM a JOIN f ON a.g = f.g AND a.v = f.v)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg(t, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
       coalesce(string_agg(t, ',' ORDER BY start, kind) FILTER (kind < 3 OR owners < 3), '') AS spans,
       count(DISTINCT g || ':' || v) FILTER (owners < 3) AS n_live, count(DISTINCT g || ':' || v) FILTER (owners >= 3) AS n_example
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
"""
