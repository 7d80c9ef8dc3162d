"""Substring dedup: documents are cut into blocks by least anchors, blocks that occur elsewhere as a whole are duplicate spans, and places where they end are checked window by window.

This is not a greedy Lempel-Ziv parse: no longest match is searched and extended. A greedy factor ends where the reference it follows ends, and a window may be a duplicate across that place, so every such place would need the window check below anyway; cutting by anchors makes the cuts the same in all documents, so that no factor depends on where a parse began.

A window is `window` consecutive words (words `[^\\x20\\x09-\\x0D]+`, unchanged). A word goes if a window that covers it also starts anywhere else, same document included; all windows are judged on the input.

Blocks. Every window picks its least k-gram as anchor (the leftmost on ties), so equal windows have equal anchors at equal offsets. Neighbouring windows mostly share their anchor; the run of windows of one anchor, with the words they cover, is a block. Blocks are the reference: those whose anchor occurs nowhere else can't hold a duplicate and drop out. Of a block that occurs elsewhere as a whole all windows are duplicates. Where a block has a known anchor but occurs only once, a common stretch ends somewhere inside, and its windows are checked one by one against all windows of blocks with the same anchor; a block that repeats sends the windows of one occurrence only. So rows grow with blocks (one for about 14 words) and with the ends of common stretches, never with pairs of copies.

Equal blocks and windows are told by 128 bits. Counts combine before the shuffle and rows meet counts by plain joins, so a passage in a third of all documents is no hot task. Spans of equal rows combine to one set before they are gathered, so a row repeated m times costs m times its own spans, not their square. Texts are shuffled once. Null text has no words; very long texts are worked on whole and an empty table gives an empty result; repeated rows are copies of each other and lose all words of their windows; null doc_ids match themselves; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import own_columns
from .stage import written
from .words import BASE, MASK, WINDOW_BASE, Words, mix, signed, slices, text_column, window_sums

_BLOCK = "anchor bigint, block bigint, _sub_id bigint, _sub_hash bigint, lo int, hi int"
_WINDOW = "w1 bigint, w2 bigint, _sub_id bigint, _sub_hash bigint, start int"
_KEY = ["_sub_id", "_sub_hash"]


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values the place of the least, leftmost on ties."""
    at, reach = np.arange(len(values)), 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = at[:-step] if step else at, at[step:]
        at = np.where(values[left] <= values[right], left, right)
        reach += step
    return at


def _blocks(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch)
            ids, hashes = batch.column("_sub_id"), batch.column("_sub_hash")
            for begin, end in slices(texts):
                words = Words(texts.slice(begin, end - begin))
                counts = np.maximum(np.diff(words.first) - window + 1, 0)
                if not counts.sum():
                    continue
                total = len(words.hashes)
                grams = np.zeros(total - k + 1, np.uint64)
                for j in range(k):
                    grams = grams * np.uint64(WINDOW_BASE) + words.hashes[j : total - k + 1 + j]
                grams = mix(grams)
                least = least_places(grams, window - k + 1)
                doc = np.repeat(np.arange(len(counts)), counts)
                starts = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + words.first[:-1][doc]
                anchor = least[starts]
                new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
                lo = np.flatnonzero(new)
                hi = np.concatenate((lo[1:], [len(doc)])) - 1
                place, base = anchor[lo], words.first[:-1][doc[lo]]
                content = window_sums(words.hashes, starts[lo], starts[hi] + window, WINDOW_BASE)
                shape = (place - starts[lo]).astype(np.uint64) * np.uint64(4096) + (starts[hi] - starts[lo]).astype(np.uint64)
                block = mix(content + shape * np.uint64(BASE))
                rows = pa.array(doc[lo] + begin)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(grams[place])), pa.array(signed(block)), ids.take(rows), hashes.take(rows), pa.array((starts[lo] - base).astype(np.int32)), pa.array((starts[hi] - base).astype(np.int32))],
                    ["anchor", "block", "_sub_id", "_sub_hash", "lo", "hi"],
                )

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch)
            ids, hashes, asked = batch.column("_sub_id"), batch.column("_sub_hash"), batch.column("asked")
            for begin, end in slices(texts):
                words = Words(texts.slice(begin, end - begin))
                parts = []
                for d in range(begin, end):
                    for x in asked[d].as_py():
                        at = np.arange(x["lo"], x["hi"] + 1)
                        parts.append((at + words.first[d - begin], np.full(len(at), d), at if x["alone"] else np.full(len(at), -1)))
                if not parts:
                    continue
                starts, doc, tell = (np.concatenate(p) for p in zip(*parts, strict=True))
                first = mix(window_sums(words.hashes, starts, starts + window, WINDOW_BASE))
                second = mix(window_sums(mix(words.hashes + np.uint64(BASE & MASK)), starts, starts + window, BASE))
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(signed(first)), pa.array(signed(second)), ids.take(rows), hashes.take(rows), pa.array(tell.astype(np.int32))], ["w1", "w2", "_sub_id", "_sub_hash", "start"])

    return run


def _kept(window: int):
    def run(texts: pd.Series, factors: pd.Series, windows: pd.Series) -> pd.DataFrame:
        rows = []
        for text, factor, single in zip(texts, factors, windows, strict=True):
            words = (text or "").encode().split()
            edge = np.zeros(len(words) + 1, np.int64)
            for x in factor if factor is not None else ():
                edge[x["lo"]] += 1
                edge[x["hi"] + window] -= 1
            for start in single if single is not None else ():
                edge[start] += 1
                edge[start + window] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words)
            rows.append((kept.decode(), len(words), int(gone.sum())))
        return pd.DataFrame(rows, columns=["kept", "n_words", "n_removed"])

    return run


def remove_repeats(docs: DataFrame, window: int = 35, k: int = 8) -> DataFrame:
    """Adds to each document _sub_kept (its kept words, joined by one space), _sub_words and _sub_removed."""
    keyed = docs.select(*own_columns(docs.columns), F.col("doc_id").cast("long").alias("_sub_id"), F.xxhash64("text").alias("_sub_hash"))
    texts = keyed.select("_sub_id", "_sub_hash", "text")
    blocks = texts.mapInArrow(_blocks(window, k), _BLOCK)
    anchors = blocks.groupBy("anchor").agg(F.count("*").alias("n"), F.min("block").alias("lowest"), F.max("block").alias("highest")).filter("n > 1")
    anchors = written(anchors.select("anchor", (F.col("lowest") == F.col("highest")).alias("same")), "anchors")
    shared = written(blocks.join(anchors, "anchor"), "shared-blocks")
    several = shared.filter(~F.col("same"))
    mark = F.xxhash64("_sub_id", "_sub_hash", "lo")
    counted = several.groupBy("anchor", "block").agg(F.count("*").alias("n"), F.min(mark).alias("speaker"))
    several = several.join(written(counted, "block-counts"), ["anchor", "block"]).select(*_KEY, "lo", "hi", (F.col("n") == 1).alias("alone"), (mark == F.col("speaker")).alias("speaks"))
    several = written(several, "several-blocks")
    factors = shared.filter("same").select(*_KEY, "lo", "hi").unionByName(several.filter("not alone").select(*_KEY, "lo", "hi"))
    factors = factors.groupBy(*_KEY).agg(F.collect_set(F.struct("lo", "hi")).alias("_sub_factors"))
    asked = several.filter("alone or speaks").groupBy(*_KEY).agg(F.collect_set(F.struct("lo", "hi", "alone")).alias("asked"))
    windows = _with(texts, asked, "inner").select(*_KEY, "text", "asked").mapInArrow(_windows(window), _WINDOW)
    windows = written(windows, "windows")
    twice = written(windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1").select("w1", "w2"), "repeated-windows")
    single = windows.filter("start >= 0").join(twice, ["w1", "w2"]).groupBy(*_KEY).agg(F.collect_set("start").alias("_sub_singles"))
    out = _with(_with(keyed, factors, "left"), single, "left")
    out = out.withColumn("_sub", F.pandas_udf(_kept(window), "kept string, n_words bigint, n_removed bigint")("text", "_sub_factors", "_sub_singles"))
    return out.select(*own_columns(docs.columns), F.col("_sub.kept").alias("_sub_kept"), F.col("_sub.n_words").alias("_sub_words"), F.col("_sub.n_removed").alias("_sub_removed"))


def _with(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Rows meet by id and text hash; a null id meets a null id."""
    right = right.withColumnsRenamed({"_sub_id": "_r_id", "_sub_hash": "_r_hash"})
    return left.join(right, (F.col("_sub_hash") == F.col("_r_hash")) & F.col("_sub_id").eqNullSafe(F.col("_r_id")), how).drop("_r_id", "_r_hash")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, 35).select("doc_id", F.col("_sub_words").alias("n_words"), F.col("_sub_removed").alias("n_removed"), F.sha2("_sub_kept", 256).alias("kept_sha256"))


#: Every window as a list of its words, counted; a word goes if one of the windows that cover it counts twice or more.
OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
d AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM g JOIN d USING (h)),
k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.p) FILTER (c.p IS NULL) AS kept, count(c.p) AS n_removed
      FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) u LEFT JOIN c ON u.doc_id = c.doc_id AND u.p = c.p GROUP BY u.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
