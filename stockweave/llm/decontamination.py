"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle check.

Words are lower-cased runs without white space and ASCII punctuation, so case and marks at words do not hide a passage. A shingle is five words. It weighs ln(1 + items / items that have it), a shingle of no item as one of a single item. The weighted similarity of two shingle sets is the weight of the common part over that of the union.

For every length of an item, all windows of that many words are held against the items of that length:
1. A window can reach the similarity only if its shingles known from any item weigh enough for the lightest item of its length; other windows are left out without loss.
2. The 64-bit SimHash of the window is looked up in `radius + 1` bit blocks: within the radius two fingerprints agree in one block at least, so no fingerprint within it is missed.
3. Fingerprints within the radius are candidates, and the exact similarity decides. At similarity 0.8 fingerprints differ in 10 bits on average; with the default radius of 19 fewer than one such pair in a thousand is lost to the sketch.

The items go to the tasks in passes of at most `max_words` words (hash parts of the benchmark), so what is sent has a bound however large the benchmark is; each pass reads the corpus once and shuffles nothing but its matches. Weights are those of the whole benchmark in any number of passes: a shingle of one item weighs like one of none, so only shingles shared by items must be known, and with several passes their places in the corpus are looked up first, in parts of at most `max_words` shingles, and written with the texts.

Null and short texts (under five words) of either side match nothing. A row of documents is judged alone, so repeated rows match alike; a null doc_id is kept. Items with the same text are each reported. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import own_columns
from .stage import written
from .words import PUNCTUATION, Words, signed, slices, text_column

_FOUND = "doc_id bigint, item_id bigint, similarity double, word_start bigint, n_words bigint"


def fingerprints(shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """SimHash of shingles[s:s + width] for each start."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float64)
    total = np.vstack((np.zeros(64), np.cumsum((2 * bits - 1) * weights[:, None], axis=0)))
    return np.packbits(total[starts + width] - total[starts] > 1e-9, axis=1).view(np.uint64).ravel()


class Index:
    """Items by length, with their shingle weights, fingerprints and block tables."""

    def __init__(self, ids: list[int], texts: list[str], n_items: int, frequency: dict[int, int] | None, k: int, least: float, radius: int):
        self.k, self.least, self.radius = k, least, radius
        run = Words(pa.array(texts, pa.large_string()), gaps=PUNCTUATION)
        grams, at = run.grams(k)
        self.n_items, self.other = n_items, math.log(1 + n_items)
        sets = [np.unique(grams[at[i] : at[i + 1]]) for i in range(len(ids))]
        known, df = np.unique(np.concatenate(sets) if sets else grams, return_counts=True)
        if frequency is not None:
            df = np.array([frequency.get(x, 1) for x in known.tolist()])
        self.known, self.weight = known, np.log(1 + n_items / np.maximum(df, 1)) if len(known) else np.zeros(0)
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[known >> np.uint64(44)] = True
        ends = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.by_length: dict[int, list] = {}
        for i, own in enumerate(sets):
            width = int(at[i + 1] - at[i])
            if width:
                w = self.weights(own)
                print_ = fingerprints(grams[at[i] : at[i + 1]], self.weights(grams[at[i] : at[i + 1]]), np.array([0]), width)[0]
                self.by_length.setdefault(width, []).append((ids[i], dict(zip(own.tolist(), w.tolist(), strict=True)), float(w.sum()), print_))
        self.tables = {width: self._table(items) for width, items in self.by_length.items()}
        self.lightest = {width: min(x[2] for x in items) for width, items in self.by_length.items()}

    def _table(self, items: list) -> list[dict[int, list[int]]]:
        out = []
        for shift, mask in self.blocks:
            table: dict[int, list[int]] = {}
            for i, x in enumerate(items):
                table.setdefault(int((x[3] >> shift) & mask), []).append(i)
            out.append(table)
        return out

    def found(self, shingles: np.ndarray) -> np.ndarray:
        """Places of shingles that some item has."""
        places = np.flatnonzero(self.bitmap[shingles >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.known, shingles[places]), max(len(self.known) - 1, 0))
        return places[self.known[at] == shingles[places]] if len(self.known) else places[:0]

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(shingles), self.other)
        places = self.found(shingles)
        out[places] = self.weight[np.searchsorted(self.known, shingles[places])]
        return out

    def matches(self, shingles: np.ndarray, places: np.ndarray, shared: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of one document, the best window of each item. `shared`: places of shingles that items of any pass share, and how many items."""
        weights = self.weights(shingles)
        if shared is not None:
            weights[shared[0]] = np.log(1 + self.n_items / shared[1])
        hits = np.zeros(len(shingles))
        hits[places] = weights[places]
        reach = np.concatenate(([0.0], np.cumsum(hits)))
        best: dict[int, tuple[float, int, int]] = {}
        for width, items in self.by_length.items():
            if width > len(shingles):
                continue
            starts = np.flatnonzero(reach[width:] - reach[:-width] >= self.least * self.lightest[width] - 1e-9)
            if not len(starts):
                continue
            low, high = starts[0], starts[-1] + width
            prints = fingerprints(shingles[low:high], weights[low:high], starts - low, width)
            for start, print_ in zip(starts.tolist(), prints, strict=True):
                near: set[int] = set()
                for (shift, mask), table in zip(self.blocks, self.tables[width], strict=True):
                    near.update(table.get(int((print_ >> shift) & mask), ()))
                for i in near:
                    item, own, total, theirs = items[i]
                    if int(print_ ^ theirs).bit_count() > self.radius:
                        continue
                    window = dict(zip(shingles[start : start + width].tolist(), weights[start : start + width].tolist(), strict=True))
                    common = sum(w for x, w in window.items() if x in own)
                    similarity = common / (sum(window.values()) + total - common)
                    if similarity >= self.least - 1e-12 and (item not in best or (-similarity, start) < (-best[item][0], best[item][1])):
                        best[item] = (similarity, start, width + self.k - 1)
        return [(item, *b) for item, b in sorted(best.items())]


def _searched(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts, ids = text_column(batch), batch.column("doc_id")
            notes = batch.column("notes").to_pylist() if "notes" in batch.schema.names else [None] * batch.num_rows
            for begin, end in slices(texts):
                words = Words(texts.slice(begin, end - begin), gaps=PUNCTUATION)
                shingles, at = words.grams(index.k)
                places = index.found(shingles)
                if not len(places):
                    continue
                for d in np.unique(np.searchsorted(at, places, "right") - 1).tolist():
                    lo, hi = np.searchsorted(places, (at[d], at[d + 1]))
                    note = notes[begin + d]
                    shared = None if note is None else (np.array([x["at"] for x in note], np.int64), np.array([x["n"] for x in note], float))
                    found = index.matches(shingles[at[d] : at[d + 1]], places[lo:hi] - at[d], shared)
                    rows += [(ids[begin + d].as_py(), *m) for m in found]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "similarity", "word_start", "n_words"])

    return run


def find_items(docs: DataFrame, items: DataFrame, least: float = 0.8, k: int = 5, radius: int = 19, max_words: int = 2_000_000) -> DataFrame:
    """(doc_id, text), (item_id, text) -> each document and item it holds: doc_id, item_id, similarity, word_start, n_words (in words of this operator)."""
    items = items.select(F.col("item_id").cast("long"), F.lower("text").alias("text")).filter("text is not null")
    size, n_items = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*")).first()
    passes = max(1, -(-size // (5 * max_words)))
    frequency = None
    out = None
    lowered = docs.select(F.col("doc_id").cast("long"), F.lower("text").alias("text"))
    part = F.pmod(F.xxhash64("text"), F.lit(passes))
    if passes > 1:
        shared = _shared(items, k)
        lowered = _noted(lowered, shared, k, max_words)
    for p in range(passes):
        rows = items.filter(part == p).orderBy("item_id", "text").collect()  # at most about max_words words
        if passes > 1:
            frequency = _frequencies(shared, rows, k)
        index = Index([r[0] for r in rows], [r[1] for r in rows], n_items, frequency, k, least, radius)
        found = lowered.mapInArrow(_searched(index), _FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def _shared(items: DataFrame, k: int) -> DataFrame:
    """gram, n: the shingles that two items or more have, and how many."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, at = Words(text_column(batch), gaps=PUNCTUATION).grams(k)
            own = [np.unique(grams[at[i] : at[i + 1]]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(own)) if own else [], pa.int64())], ["gram"])

    counted = items.select("text").mapInArrow(shingles, "gram bigint").groupBy("gram").agg(F.count("*").alias("n"))
    return written(counted.filter("n > 1"), "shared-shingles")


def _frequencies(shared: DataFrame, rows: list, k: int) -> dict[int, int]:
    """In how many of all items each shared shingle of this pass occurs."""
    grams = Words(pa.array([r[1] for r in rows], pa.large_string()), gaps=PUNCTUATION).grams(k)[0]
    wanted = shared.sparkSession.createDataFrame([(x,) for x in np.unique(signed(grams)).tolist()], "gram bigint")
    return {r[0] & ((1 << 64) - 1): r[1] for r in shared.join(wanted, "gram").collect()}  # no more rows than shingles of this pass


_NOTES = "h1 bigint, h2 bigint, notes array<struct<at: int, n: bigint>>"


def _noting(grams: np.ndarray, counts: np.ndarray, k: int):
    """Texts that hold any of the sorted grams, with the places and counts of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts, h1, h2 = [], text_column(batch), batch.column("h1"), batch.column("h2")
            for begin, end in slices(texts):
                own, at = Words(texts.slice(begin, end - begin), gaps=PUNCTUATION).grams(k)
                found = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
                places = np.flatnonzero(grams[found] == own)
                for d in np.unique(np.searchsorted(at, places, "right") - 1).tolist():
                    lo, hi = np.searchsorted(places, (at[d], at[d + 1]))
                    notes = [{"at": int(p - at[d]), "n": int(counts[found[p]])} for p in places[lo:hi]]
                    rows.append((h1[begin + d].as_py(), h2[begin + d].as_py(), notes))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 3
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["h1", "h2", "notes"])

    return run


def _noted(docs: DataFrame, shared: DataFrame, k: int, most: int) -> DataFrame:
    """The documents with notes: where they have shingles that items share, and how many items (null where none)."""
    keyed = docs.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(5), "text")})
    parts = max(1, -(-shared.count() // most))
    notes = None
    for p in range(parts):
        rows = sorted((r[0] & ((1 << 64) - 1), r[1]) for r in shared.filter(F.pmod("gram", F.lit(parts)) == p).collect())  # about `most` rows
        if rows:
            grams, counts = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows])
            found = keyed.select("h1", "h2", "text").mapInArrow(_noting(grams, counts, k), _NOTES).groupBy("h1", "h2").agg(F.first("notes").alias("notes"))  # equal texts have equal notes
            notes = found if notes is None else notes.unionByName(found)
    if notes is None:
        return docs
    notes = notes.groupBy("h1", "h2").agg(F.flatten(F.collect_list("notes")).alias("notes"))
    return written(keyed.join(written(notes, "shared-places"), ["h1", "h2"], "left").select("doc_id", "text", "notes"), "noted-documents")


def without_benchmark(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark item. Rows that share a doc_id go together; all columns stay."""
    found = find_items(docs.select("doc_id", "text"), items, **options).select(F.col("doc_id").alias("_found_id")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_found_id")), "anti").select(*own_columns(docs.columns))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
