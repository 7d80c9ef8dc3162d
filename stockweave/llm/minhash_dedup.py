"""MinHash near-dedup with tensored banding: table keys are pairs of smaller hash collections, candidates are verified on their full sets.

A document's set are its distinct runs of `n` words (words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased); with fewer words the whole sequence is its one element; without words the set is empty and links with nothing. Two documents link when 100 * common >= percent * union.

Tensored banding. Two collections hold `parts` sub-keys each, and a sub-key is made of `rows` minhashes. Every pair of a left and a right sub-key is the key of one table, so parts * parts tables of 2 * rows minhashes each come from 2 * parts * rows minhashes, about the square root of what as many tables of their own would take. Documents of similarity s meet in a table unless they differ in all left or in all right sub-keys: the chance to be missed is below 2 * (1 - s ** rows) ** parts. `parts_for` takes as many parts as keep that under one in 10,000 at the least similarity that links (10 parts, 40 minhashes, 100 tables for 0.8 and two rows); at higher similarity it falls fast (0.9: under 10 ** -6).

The tensor also saves rows: a document meets another in a table only if both sub-keys meet, so sub-keys that no other document has drop out first (20 short rows for a document), and only the pairs of those that are left become table rows. Most documents have none.

Classes. Documents with equal sets are one class from the start (128-bit digest of the set), so exact copies never form pairs; only the class's smallest doc_id goes on.

Pairs. In each table a key's documents first meet one of them only, the one whose sub-keys are the most common and so the least altered one of a group of copies: as many pairs as rows. What links joins components. Then only documents that share a table with another component form pairs, and only across components: they meet at their left sub-keys, in pairs of blocks of at most `BLOCK` where many share one, and a task writes a pair only if it is at its first left sub-key, shares a right sub-key too, that is a table, and its lengths and bitmaps leave a link possible. So a group of near copies costs rows in proportion to its size and to its links.

Bitmaps. Each set has 2,048 bits, one set for each element. Bits that differ count elements that only one of the sets has, and two linking sets have at most (n1 + n2) * (100 - percent) / (100 + percent) of those; a pair beyond that is no link, whatever its text. Of a set of more than 512 elements only those of a hashed half, quarter, ... are marked; the bound then leaves five and a half standard deviations, which a linking pair exceeds less than once in ten million, and sets marked at different rates are not compared. Every pair that is left is verified on the whole sets of its whole texts, each once.

Rows with a null doc_id take no part, get a null component and are kept; rows that share a doc_id are one document with the links of each; null text is empty; other columns are not read; an empty table gives an empty result. Memory is bounded by the longest text. Sets are compared by 64-bit hashes of their shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .ngram_join import _linked, _sets
from .stage import written
from .words import BASE, WORD_BASE, mix, signed, text_column

BLOCK = 1000
#: 64-bit numbers of a set's bitmap; sets of up to `SPARSE` elements are marked whole.
WORDS, SPARSE = 32, 512
_SET = "doc_id bigint, n bigint, d1 bigint, d2 bigint, keys array<bigint>, rate int, bits array<bigint>"


def parts_for(percent: int, rows: int = 2, missed: float = 1e-4) -> int:
    """Parts per collection so that a pair of the least similarity is missed with a chance of `missed` at most."""
    if percent >= 100:
        return 1
    return max(1, math.ceil(math.log(missed / 2) / math.log1p(-((percent / 100) ** rows))))


def _grouped(texts: pa.Array, n: int) -> Iterator[list[np.ndarray]]:
    waiting, size = [], 0
    for own in _sets(texts, n):
        waiting.append(own)
        size += len(own)
        if size > 1 << 18:
            yield waiting
            waiting, size = [], 0
    if waiting:
        yield waiting


def minhashes(sets: list[np.ndarray], count: int) -> np.ndarray:
    """One row of `count` minhashes for each set; zeros for empty sets."""
    out = np.zeros((len(sets), count), np.uint64)
    full = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        begin = np.concatenate(([0], np.cumsum([len(sets[i]) for i in full])[:-1]))
        seeds = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(BASE))
        for j in range(count):
            out[full, j] = np.minimum.reduceat((flat ^ seeds[2 * j]) * (seeds[2 * j + 1] | np.uint64(1)), begin)
    return out


def bitmaps(sets: list[np.ndarray]) -> tuple[list[int], np.ndarray]:
    """Of each set how often its elements were halved, and a bit for each element that is left."""
    rates, out = [], np.zeros((len(sets), 64 * WORDS), np.uint8)
    for row, own in zip(out, sets, strict=True):
        rate = max(0, math.ceil(math.log2(len(own) / SPARSE))) if len(own) else 0
        marked = own[(own >> np.uint64(24)) & np.uint64((1 << rate) - 1) == 0] if rate else own
        row[(marked & np.uint64(64 * WORDS - 1)).astype(np.int64)] = 1
        rates.append(rate)
    return rates, np.packbits(out, axis=1).view(np.uint64)


def _signed_sets(n: int, parts: int, rows: int):
    count = 2 * parts * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in _grouped(text_column(batch), n):
                hashes = minhashes(sets, count)
                keys = np.zeros((len(sets), 2 * parts), np.uint64)
                for r in range(rows):
                    keys = keys * np.uint64(WORD_BASE) + mix(hashes[:, r::rows])
                keys = mix(keys + np.arange(1, 2 * parts + 1, dtype=np.uint64) * np.uint64(BASE))
                sizes = np.array([len(s) for s in sets], np.int64)
                first = np.array([int(np.bitwise_xor.reduce(s * np.uint64(0xD6E8FEB86659FD93))) if len(s) else 0 for s in sets], np.uint64)
                second = np.array([int(np.add.reduce((s ^ (s >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F))) if len(s) else 0 for s in sets], np.uint64)
                rates, bits = bitmaps(sets)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * x.shape[1]), pa.array(signed(np.ascontiguousarray(x)).ravel())) for x in (keys, bits)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(sets)), pa.array(sizes), pa.array(signed(first)), pa.array(signed(second)), lists[0], pa.array(rates, pa.int32()), lists[1]],
                    ["doc_id", "n", "d1", "d2", "keys", "rate", "bits"],
                )
                at += len(sets)

    return run


def _near_lengths(percent: int, x: Column, y: Column) -> Column:
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _matrix(lists: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows."""
    return np.asarray(lists.flatten()).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0), np.int64)


def _near_bitmaps(percent: int, n1, n2, rate1, rate2, bits1, bits2) -> np.ndarray:
    """Whether few enough bits differ for a link; sets marked at different rates may link."""
    # of signed numbers only the absolute value would be counted
    apart = np.bitwise_count((bits1 ^ bits2).view(np.uint64)).sum(1, dtype=np.int64)
    most = (n1 + n2) * (100 - percent) // (100 + percent)
    marked = most / 2.0**rate1
    return (rate1 != rate2) | (apart <= np.where(rate1 == 0, most, marked + 5.5 * np.sqrt(marked) + 3))


def _open_pairs(group: dict[str, np.ndarray], percent: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one left sub-key's rows of two blocks (or of one): places of both."""
    low, high = group["lo"][0], group["hi"][0]
    x = np.flatnonzero(group["block"] == low)
    y = x if low == high else np.flatnonzero(group["block"] == high)
    side = lambda name: (group[name][x][:, None], group[name][y][None])
    (cx, cy), (dx, dy), (nx, ny) = side("c"), side("doc_id"), side("n")
    keep = (cx != cy) & (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny))
    if low == high:
        keep &= dx < dy
    left, right, here = group["keys"][:, :parts], group["keys"][:, parts:], int(group["i"][0])
    for i in range(here):
        keep &= left[x, i][:, None] != left[y, i][None]
    if keep.any():
        table = np.zeros(keep.shape, bool)
        for j in range(parts):
            table |= right[x, j][:, None] == right[y, j][None]
        keep &= table
    a, b = np.nonzero(keep)
    a, b = x[a], y[b]
    out = []
    for at in range(0, len(a), 1 << 16):
        p, q = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        out.append(_near_bitmaps(percent, group["n"][p], group["n"][q], group["rate"][p], group["rate"][q], group["bits"][p], group["bits"][q]))
    near = np.concatenate(out) if out else np.zeros(0, bool)
    return a[near], b[near]


def _pairs_of_rows(percent: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(rows: pa.Table, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
            columns = {c: _matrix(rows.column(c).combine_chunks()) if c in ("keys", "bits") else np.asarray(rows.column(c)) for c in rows.column_names}
            a, b = [], []
            for lo, hi in zip(begin.tolist(), end.tolist(), strict=True):
                if hi - lo > 1:
                    group = {c: v[lo:hi] for c, v in columns.items()}
                    x, y = _open_pairs(group, percent, parts)
                    a.append(group["doc_id"][x])
                    b.append(group["doc_id"][y])
            a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        waiting = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            waiting = rows if waiting is None else pa.concat_tables([waiting, rows])
            ids = [np.asarray(waiting.column(c)) for c in ("key", "lo", "hi")]
            border = np.flatnonzero(np.any([v[1:] != v[:-1] for v in ids], axis=0)) + 1
            if len(border):
                yield pairs(waiting, np.concatenate(([0], border[:-1])), border)
                waiting = waiting.slice(int(border[-1]))
        if waiting is not None and waiting.num_rows:
            yield pairs(waiting, np.array([0]), np.array([waiting.num_rows]))

    return run


def _possible(percent: int):
    """The rows (a, b) whose bitmaps leave a link possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: np.asarray(batch.column(c))
            near = _near_bitmaps(percent, column("x_n"), column("y_n"), column("x_rate"), column("y_rate"), _matrix(batch.column("x_bits")), _matrix(batch.column("y_bits"))) if len(batch) else np.zeros(0, bool)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return run


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, rows: int = 2) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, class_id (smallest doc_id with the same set), component_id, one row for each row."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    parts = parts_for(percent, rows)
    sets = written(docs.mapInArrow(_signed_sets(n, parts, rows), _SET), "minhash-sets")
    classes = written(sets.filter("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("class_id")), "minhash-classes")
    ours = sets.join(classes.withColumnRenamed("class_id", "doc_id"), ["doc_id", "n", "d1", "d2"], "semi")
    ours = written(ours.select("doc_id", "n", "keys", "rate", "bits"), "minhash-representatives")

    # sub-keys that two documents have at least
    single = ours.select("doc_id", "n", F.posexplode("keys").alias("i", "key"))
    common = written(single.groupBy("key").agg(F.count("*").alias("copies")).filter("copies > 1"), "sub-keys")
    mine = single.join(common.hint("merge"), "key").groupBy("doc_id", "n").agg(F.collect_list(F.struct("i", "key")).alias("keys"), F.sum("copies").alias("weight"))
    mine = written(mine, "document-keys")
    side = lambda test: F.transform(F.filter("keys", test), lambda k: k["key"])
    left, right = side(lambda k: k["i"] < parts), side(lambda k: k["i"] >= parts)
    tables = mine.select("doc_id", "n", "weight", left.alias("l"), right.alias("r"))
    tables = tables.select("doc_id", "n", "weight", F.explode(F.flatten(F.transform("l", lambda x: F.transform("r", lambda y: F.xxhash64(x, y))))).alias("key"))

    # the document with the most common sub-keys stands for its group
    hub = F.max(F.struct("weight", (-F.col("doc_id")).alias("minus"), "n")).alias("hub")
    hubs = tables.groupBy("key").agg(hub, F.count("*").alias("size")).filter("size > 1").select("key", (-F.col("hub.minus")).alias("hub"), F.col("hub.n").alias("hub_n"))
    met = written(tables.drop("weight").join(written(hubs, "minhash-hubs").hint("merge"), "key"), "table-rows")
    near = met.filter(F.col("doc_id") != F.col("hub")).filter(_near_lengths(percent, F.col("n"), F.col("hub_n")))
    tried = written(near.select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b")).distinct(), "hub-pairs")
    links = written(_verified(docs, ours, tried, n, percent), "hub-links")

    # documents that share a key with another component meet at their left sub-keys
    so_far = components(links)
    placed = written(met.join(so_far, met.doc_id == so_far.node, "left").select("key", "doc_id", "n", F.coalesce("component", "doc_id").alias("c")), "placed-rows")
    mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key")
    open_ = written(placed.join(mixed, "key").select("doc_id", "n", "c").distinct(), "open-documents")
    open_ = open_.join(ours, ["doc_id", "n"]).select("doc_id", "n", "c", "rate", "bits", "keys", F.posexplode(F.slice("keys", 1, parts)).alias("i", "key"))
    several = F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks")
    apart = open_.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), several).filter("lo < hi").select("key", "blocks")
    apart = open_.join(written(apart, "open-keys"), "key").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    # every block of a key meets every other in a group of its own
    apart = apart.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    apart = apart.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "i", "doc_id", "n", "c", "rate", "keys", "bits")
    dealt = apart.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    rest = dealt.mapInArrow(_pairs_of_rows(percent, parts), "a bigint, b bigint").distinct().join(tried, ["a", "b"], "anti")
    rest = written(rest, "rest-pairs")
    joined = components(written(links.unionByName(_verified(docs, ours, rest, n, percent)), "minhash-links"))

    classes = classes.join(joined, classes.class_id == joined.node, "left").select("n", "d1", "d2", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    out = sets.select("doc_id", "n", "d1", "d2").join(written(classes, "minhash-components"), ["n", "d1", "d2"], "left")
    alone = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id")).alias(c)
    return out.select("doc_id", F.col("n").alias("n_shingles"), alone("class_id"), alone("component_id"))


def _verified(docs: DataFrame, ours: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link: bitmaps first, then the sets of the whole texts of the documents that are left."""
    x, y = (ours.select(F.col("doc_id").alias(key), *[F.col(c).alias(f"{name}_{c}") for c in ("n", "rate", "bits")]) for key, name in (("a", "x"), ("b", "y")))
    possible = pairs.join(x, "a").join(y, "b").mapInArrow(_possible(percent), "a bigint, b bigint")
    possible = written(possible.distinct(), "possible-pairs")
    # written first, its true size decides how texts meet it
    named = written(possible.select(F.col("a").alias("doc_id")).union(possible.select("b")).distinct(), "named-documents")
    texts = written(docs.join(named, "doc_id", "semi"), "named-texts")
    side = lambda key, name: texts.select(F.col("doc_id").alias(key), F.col("text").alias(name))
    return possible.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(_linked(n, percent), "a bigint, b bigint").distinct()


def without_near_copies(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component stays, the one with the smallest doc_id; documents without words or without id all stay. Rows that share the kept doc_id all stay."""
    found = near_duplicates(docs, n, percent).filter("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias("_minhash_id")).distinct()
    return docs.join(found, F.col("doc_id") == F.col("_minhash_id"), "anti")


def op11(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return near_duplicates(docs, 4, 80).select("doc_id", "n_shingles", "component_id", kept, "class_id")


#: Reachability is recursive and slow on whole tables; the query is tested against brute force instead.
