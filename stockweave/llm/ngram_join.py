"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters, joined on prefix n-grams, each pair verified once.

A document's set are its distinct runs of `n` words (words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased); with fewer words the whole sequence is its one element; without words the set is empty and links with nothing. Two documents link when 100 * common >= percent * union.

Order. Elements are ordered by document frequency, counted over all documents in 2 ** 18 hashed cells (a fixed 2 ** 18 numbers go to the tasks, whatever the corpus), ties by hash. Any total order gives the same links; rarity only shortens posting lists.

Classes. Documents with equal sets are one class from the start (128-bit digest of the set), so exact copies never form pairs. One row per document gives its class; only the class's smallest doc_id goes on.

Pairs. A document posts the prefix of its ordered set. First every posting meets only one document of its n-gram, the one that has it earliest: as many pairs as postings. Links found so far join documents; then only n-grams whose documents are still in several components make pairs, and only pairs across components, since others change nothing. So a group of near copies costs rows in proportion to its size, and no link between components is lost. Postings meet by a plain join on the n-gram, which the skew join may split. The suffix filter compares counts of the two sets per hash range: the sum of the smaller counts bounds the common part. Pairs that pass are verified on their whole sets.

That makes a spanning set of links, enough for components. `every_link` makes all of them between representatives: documents meet at each common prefix n-gram except where they surely met at an earlier one (one of the `BEFORE` n-grams ahead of it is common as well), so a pair meets at its first common n-gram and seldom again. An n-gram in many documents is dealt out in blocks of `BLOCK` documents. Its output has one row per link, so it grows with the square of a group of near copies by its nature; `link_counts` gives the number of links of each document.

Rows with a null doc_id take no part and get a null component; rows that share a doc_id are one document with the links of each; null text is empty; other columns are not read. Sets are compared by 64-bit hashes of their n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .stage import written
from .words import Words, signed, slices, text_column

CELLS = 1 << 18
RANGES = 32
BEFORE, BLOCK = 8, 1000
_SET = "doc_id bigint, n bigint, d1 bigint, d2 bigint, prefix array<bigint>, ranges binary"


def _sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    for begin, end in slices(texts):
        run = Words(texts.slice(begin, end - begin), fold=True)
        hashes, at = run.grams(n)
        for d in range(end - begin):
            own = hashes[at[d] : at[d + 1]]
            if not len(own):
                rest = run.hashes[run.first[d] : run.first[d + 1]]
                own = np.array([hash_run(rest)], np.uint64) if len(rest) else own
            yield np.unique(own)


def hash_run(words: np.ndarray) -> int:
    """One hash for a sequence shorter than an n-gram, apart from those of n-grams."""
    total = 0x51_7C_C1_B7_27_22_0A_95
    for w in words.tolist():
        total = ((total ^ w) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)
    return total ^ len(words)


def _cells(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            waiting, size = [], 0
            for own in _sets(text_column(batch), n):
                waiting.append(own)
                size += len(own)
                if size > 1 << 20:
                    total += np.bincount(np.concatenate(waiting) >> np.uint64(64 - 18), minlength=CELLS)
                    waiting, size = [], 0
            if waiting:
                total += np.bincount(np.concatenate(waiting) >> np.uint64(64 - 18), minlength=CELLS)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(total[cell], pa.int64())], ["cell", "n"])

    return run


def _prefixes(n: int, percent: int, rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, d1, d2, prefix, ranges = [], [], [], [], []
            for own in _sets(text_column(batch), n):
                k = len(own)
                size.append(k)
                # two digests of the set: sums and mixes of its elements
                with np.errstate(over="ignore"):
                    first = int(np.bitwise_xor.reduce(own * np.uint64(0xD6E8FEB86659FD93))) if k else 0
                    second = int(np.add.reduce((own ^ (own >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F))) if k else 0
                d1.append(first)
                d2.append(second)
                take = k - -(-percent * k // 100) + 1
                # sets under 100 / (100 - percent) elements link only with equal ones
                if k * (100 - percent) < percent or not k:
                    prefix.append(np.zeros(0, np.int64))
                else:
                    order = np.lexsort((own, rank[own >> np.uint64(64 - 18)]))[:take]
                    prefix.append(signed(own[order]))
                ranges.append(np.minimum(np.bincount((own >> np.uint64(40)).astype(np.int64) % RANGES, minlength=RANGES), 65535).astype("<u2").tobytes())
            u64 = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            at = np.concatenate(([0], np.cumsum([len(p) for p in prefix]))).astype(np.int32)
            flat = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), u64(d1), u64(d2), lists, pa.array(ranges, pa.binary())], ["doc_id", "n", "d1", "d2", "prefix", "ranges"])

    return run


def _bounded(percent: int):
    """The rows (a, b) whose range counts x, y leave room for a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), "<u2"), np.frombuffer(y.as_buffer(), "<u2")
                size, common = int(x.sum(dtype=np.int64) + y.sum(dtype=np.int64)), int(np.minimum(x, y).sum(dtype=np.int64))
                clipped = x.max(initial=0) == 65535 or y.max(initial=0) == 65535  # clipped counts bound nothing
                if clipped or (100 + percent) * common >= percent * size:
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _linked(n: int, percent: int):
    """The rows (a, b) whose whole texts x, y link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(_sets(text_column(batch, "x"), n), _sets(text_column(batch, "y"), n), strict=True)):
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if common and (100 + percent) * common >= percent * len(both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _can_link(percent: int, n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
    """Length filter, and positional filter: the n-gram at places p1, p2 and what follows can reach the common part needed."""
    needed = F.floor((percent * (n1 + n2) + 99 + percent) / F.lit(100 + percent))
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (F.least(n1 - p1, n2 - p2) >= needed)


def _representatives(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, text) -> the set of each row, the classes of equal sets, and the sets of their smallest doc_ids that can link with others."""
    cells = docs.select("text").mapInArrow(_cells(n), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    rank = np.zeros(CELLS, np.int64)
    rank[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    sets = written(docs.mapInArrow(_prefixes(n, percent, rank), _SET), "sets")
    classes = sets.filter("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("class_id"))
    classes = written(classes, "classes")
    ours = sets.filter("size(prefix) > 0").join(classes.withColumnRenamed("class_id", "doc_id"), ["doc_id", "n", "d1", "d2"], "semi")
    ours = written(ours.select("doc_id", "n", "prefix", "ranges"), "representatives")
    return sets, classes, ours


def join_documents(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, class_id (smallest doc_id with the same set), component_id, one row for each row."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sets, classes, ours = _representatives(docs, n, percent)

    posted = ours.select("doc_id", "n", F.posexplode("prefix").alias("p", "gram"))
    # rare n-grams come first, so the document with the n-gram earliest is the least altered of a group: most others link with it
    first = F.min(F.struct("p", "doc_id", "n")).alias("hub")
    hubs = posted.groupBy("gram").agg(first, F.count("*").alias("size")).filter("size > 1").select("gram", F.col("hub.doc_id").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.p").alias("hub_p"))
    # the hubs grow with the corpus and are never sent whole to the tasks; the join can be split on a hot n-gram
    posted = written(posted.join(written(hubs, "hubs").hint("merge"), "gram"), "postings")  # n-grams in two documents or more
    near = posted.filter("doc_id <> hub").filter(_can_link(percent, F.col("n"), F.col("p"), F.col("hub_n"), F.col("hub_p")))
    tried = written(near.select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b")).distinct(), "hub-pairs")
    links = written(_verified(docs, ours, tried, n, percent), "hub-links")

    so_far = components(links)
    placed = posted.join(so_far, posted.doc_id == so_far.node, "left").select("gram", "doc_id", "n", "p", F.coalesce("component", "doc_id").alias("c"))
    placed = written(placed, "placed")
    mixed = placed.groupBy("gram").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("gram")
    open_ = written(placed.join(mixed, "gram"), "open-postings")
    x, y = (open_.select("gram", *[F.col(c).alias(f"{side}_{c}") for c in ("doc_id", "n", "p", "c")]) for side in "xy")
    across = x.join(y, (x.gram == y.gram) & (x.x_c != y.y_c) & (x.x_doc_id < y.y_doc_id) & _can_link(percent, x.x_n, x.x_p, y.y_n, y.y_p))
    rest = across.select(F.col("x_doc_id").alias("a"), F.col("y_doc_id").alias("b")).distinct().join(tried, ["a", "b"], "anti")
    rest = written(rest, "rest-pairs")
    links = links.unionByName(_verified(docs, ours, rest, n, percent))
    joined = components(written(links, "links"))

    classes = classes.join(joined, classes.class_id == joined.node, "left").select("n", "d1", "d2", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    out = sets.select("doc_id", "n", "d1", "d2").join(written(classes, "components"), ["n", "d1", "d2"], "left")
    alone = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id")).alias(c)
    return out.select("doc_id", F.col("n").alias("n_shingles"), alone("class_id"), alone("component_id"))


def _verified(docs: DataFrame, ours: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link: range counts first, then the sets of the whole texts of the documents that are left."""
    ranges = ours.select("doc_id", "ranges")
    side = lambda frame, key, value, name: frame.select(F.col("doc_id").alias(key), F.col(value).alias(name))
    bounded = pairs.join(side(ranges, "a", "ranges", "x"), "a").join(side(ranges, "b", "ranges", "y"), "b")
    bounded = written(bounded.mapInArrow(_bounded(percent), "a bigint, b bigint"), "bounded-pairs")
    # written first, its true size decides how texts meet it: an overestimate would shuffle all texts for a short list
    named = written(bounded.select(F.col("a").alias("doc_id")).union(bounded.select("b")).distinct(), "named")
    # texts travel, not their sets: hashes do not compress
    texts = written(docs.join(named, "doc_id", "semi"), "texts")
    both = bounded.join(side(texts, "a", "text", "x"), "a").join(side(texts, "b", "text", "y"), "b")
    return both.mapInArrow(_linked(n, percent), "a bigint, b bigint").distinct()


def every_link(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text) -> a, b with a < b: every link between representatives of classes (the class_ids of join_documents), each once."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    return _every_link(docs, _representatives(docs, n, percent)[2], n, percent)


def _every_link(docs: DataFrame, ours: DataFrame, n: int, percent: int) -> DataFrame:
    posted = ours.select("doc_id", "n", "prefix", F.posexplode("prefix").alias("p", "gram"))
    begin = F.greatest(F.col("p") - BEFORE, F.lit(0))
    posted = posted.select("doc_id", "n", "p", "gram", F.slice("prefix", begin + 1, F.col("p") - begin).alias("before"))
    blocks = F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks")
    met = posted.groupBy("gram").agg(blocks, F.count("*").alias("size")).filter("size > 1").select("gram", "blocks")
    posted = written(posted.join(written(met, "link-grams").hint("merge"), "gram"), "link-postings")
    side = lambda frame, name: frame.select("gram", "block", *[F.col(c).alias(f"{name}_{c}") for c in ("doc_id", "n", "p", "before")])
    # x is in one block of its n-gram, y in all of them
    x = side(posted.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")), "x")
    y = side(posted.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), "y")
    first = ~F.arrays_overlap("x_before", "y_before")
    near = x.join(y, ["gram", "block"]).filter((F.col("x_doc_id") < F.col("y_doc_id")) & first & _can_link(percent, *[F.col(c) for c in ("x_n", "x_p", "y_n", "y_p")]))
    pairs = written(near.select(F.col("x_doc_id").alias("a"), F.col("y_doc_id").alias("b")).distinct(), "pairs")
    return _verified(docs, ours, pairs, n, percent)


def link_counts(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text) -> doc_id, class_id, n_links: to how many other classes the class of a document links. One row for each document and class; documents without words or without id have none."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sets, classes, ours = _representatives(docs, n, percent)
    links = written(_every_link(docs, ours, n, percent), "every-link")
    counts = links.select(F.col("a").alias("class_id")).unionByName(links.select(F.col("b").alias("class_id"))).groupBy("class_id").agg(F.count("*").alias("n_links"))
    members = sets.filter("doc_id is not null").select("doc_id", "n", "d1", "d2").join(classes, ["n", "d1", "d2"]).select("doc_id", "class_id").distinct()
    return members.join(counts, "class_id", "left").select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def without_near_copies(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component stays, the one with the smallest doc_id; documents without words or without id all stay. Of rows that share the kept doc_id all stay if their texts differ, one if they are equal."""
    found = join_documents(docs, n, percent).filter("n_shingles > 0 and doc_id <> component_id").select("doc_id").distinct()
    return docs.join(found.withColumnRenamed("doc_id", "_near_id"), F.col("doc_id") == F.col("_near_id"), "anti")


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return join_documents(docs, 3, 90).select("doc_id", "n_shingles", "component_id", "class_id")


#: Reachability is recursive and slow on whole tables; the query is tested against brute force instead.
