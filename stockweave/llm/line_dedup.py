"""Line dedup: explode normalised lines, hash, count documents per hash, drop frequent lines, reassemble by position.

A text is split at \\n; null or empty text is one empty line. A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends, A-Z lower-cased; keys with fewer than `min_chars` code points are never dropped. A key found in at least `min_docs` distinct documents, told by doc_id, loses all its lines everywhere. Repeated rows and rows that share a doc_id count once for a key and each get the same result; rows with a null doc_id count as one document and are matched to themselves. All other columns stay as they are. Very long texts are worked on whole; an empty table gives an empty result.

Plan: each row sends one row per distinct key (128-bit hash, line numbers). Documents are first made distinct per key, dealt by key and document, so a line in a third of all documents or a document in a third of all rows is dealt out; then counts combine before they are shuffled. The lines meet the frequent keys in a plain join, which the skew join may split, and the line numbers of equal rows combine to one set before they are gathered. Texts are shuffled once, to meet their own line numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import written

STRIPPED = b"\t\n\x0b\x0c\r "
_LINES = "doc_id bigint, text_hash bigint, h1 bigint, h2 bigint, at array<int>"
_KEPT = "kept string, n_lines bigint, n_dropped bigint"


def _exploded(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, h1, h2, at = [], [], [], [], []
            for doc, text_hash, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("text"), strict=True):
                places: dict[bytes, list[int]] = {}
                for i, line in enumerate((text.as_buffer().to_pybytes() if text.is_valid else b"").split(b"\n")):
                    key = line.strip(STRIPPED).lower()
                    if key and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
                        places.setdefault(xxhash.xxh3_128_digest(key), []).append(i)
                for digest, lines in places.items():
                    ids.append(doc)
                    hashes.append(text_hash)
                    h1.append(int.from_bytes(digest[:8], "little", signed=True))
                    h2.append(int.from_bytes(digest[8:], "little", signed=True))
                    at.append(lines)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(at, pa.list_(pa.int32()))], ["doc_id", "text_hash", "h1", "h2", "at"])

    return run


def _without_lines(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
    rows = []
    for text, drop in zip(texts, drops, strict=True):
        lines = (text or "").split("\n")
        gone = set() if drop is None else set(drop)
        rows.append(("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text or "", len(lines), len(gone)))
    return pd.DataFrame(rows, columns=["kept", "n_lines", "n_dropped"])


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Adds to each document _line_kept (its text without frequent lines), _line_n and _line_dropped."""
    keyed = docs.withColumn("_line_hash", F.xxhash64("text"))
    lines = keyed.select("doc_id", F.col("_line_hash").alias("text_hash"), "text").mapInArrow(_exploded(min_chars), _LINES)
    frequent = lines.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("h1", "h2")
    frequent = written(frequent, "frequent-lines")  # read back as a table of its own, the join on a hot line can be split
    hits = lines.join(frequent, ["h1", "h2"]).groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_set("at")).alias("_line_drop"))
    hits = hits.withColumnsRenamed({"doc_id": "_line_doc", "text_hash": "_line_text"})
    joined = keyed.join(hits, F.col("doc_id").eqNullSafe(F.col("_line_doc")) & (F.col("_line_hash") == F.col("_line_text")), "left")
    out = joined.withColumn("_line", F.pandas_udf(_without_lines, _KEPT)("text", "_line_drop"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("_line.kept").alias("_line_kept"), F.col("_line.n_lines").alias("_line_n"), F.col("_line.n_dropped").alias("_line_dropped"))


def clean_documents(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """The documents with frequent lines taken out of their texts; n_chars follows, all other columns stay. No row is lost; null text becomes empty."""
    out = drop_frequent_lines(docs, min_docs, min_chars)
    new = {"text": F.col("_line_kept"), "n_chars": F.length("_line_kept").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_frequent_lines(docs, 10, 1).select("doc_id", F.col("_line_n").alias("n_lines"), F.col("_line_dropped").alias("n_dropped"), F.sha2("_line_kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, ls[i] AS line,
         translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), frequent AS (
  SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.k IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM lines LEFT JOIN frequent f ON lines.k = f.k GROUP BY doc_id
"""
