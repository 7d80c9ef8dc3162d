"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. The vector of three letters in a row is the product of the first's rotated twice, the second's rotated once and the third's; whatever is no letter is one boundary symbol. A document bundles (adds) the vectors of all its three-letter runs; a language's prototype bundles the unit vectors of its training documents; the prediction is the prototype with the greatest cosine, ties to the smaller name.

Training reads about `per_language` documents of each of the `max_languages` most frequent languages, chosen by hash with the odds that the language's count gives. Every text is read whole; a slice of documents is one product of a count matrix and a block of run vectors, so memory has a bound whatever the script.

Null texts, and texts without a letter, are `und` with score 0, and so is everything where nothing was learned. Null languages teach nothing. Rows are judged one by one, repeated rows agree, a null doc_id is not held out. The score is the cosine, cut at 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices, text_column

DIMENSIONS, BLOCK = 1024, 4096
_letters: dict[int, np.ndarray] = {}
_alpha: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    if not _alpha:
        _alpha.append(np.array([chr(c).isalpha() for c in range(0x110000)], bool))
    return _alpha[0]


def letter(code: int) -> np.ndarray:
    vector = _letters.get(code)
    if vector is None:
        vector = np.random.default_rng(1_000_003 + code).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1
        _letters[code] = vector
    return vector


def run_vectors(runs: np.ndarray) -> np.ndarray:
    """The vectors of runs packed as three 21-bit code points."""
    codes = np.stack((runs >> np.uint64(42), (runs >> np.uint64(21)) & np.uint64(0x1FFFFF), runs & np.uint64(0x1FFFFF)))
    known, at = np.unique(codes, return_inverse=True)
    base = np.array([letter(int(c)) for c in known], np.int8).reshape(len(known), DIMENSIONS)
    at = at.reshape(codes.shape)
    return (np.roll(base, 2, axis=1)[at[0]] * np.roll(base, 1, axis=1)[at[1]] * base[at[2]]).astype(np.float32)


def runs_of(text: str) -> np.ndarray:
    """All three-letter runs of a text, packed; none if it has no letter."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(is_letter()[codes], codes, 0)
    if not codes.any():
        return np.zeros(0, np.uint64)
    codes = np.concatenate(([0], codes, [0])).astype(np.uint64)
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
    return (codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]


def document_vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bundles of a few documents, and which of them have a letter."""
    counted = [np.unique(runs_of(t), return_counts=True) for t in texts]
    sizes = np.array([len(c[0]) for c in counted])
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    if sizes.sum():
        runs, at = np.unique(np.concatenate([c[0] for c in counted]), return_inverse=True)
        doc = np.repeat(np.arange(len(texts)), sizes)
        counts = np.concatenate([c[1] for c in counted]).astype(np.float32)
        for low in range(0, len(runs), BLOCK):
            inside = (at >= low) & (at < low + BLOCK)
            matrix = np.zeros((len(texts), min(BLOCK, len(runs) - low)), np.float32)
            matrix[doc[inside], at[inside] - low] = counts[inside]
            out += matrix @ run_vectors(runs[low : low + BLOCK])
    return out, sizes > 0


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = text_column(batch), batch.column("lang").to_pylist()
        for begin, end in slices(texts, 1 << 20):
            vectors, _ = document_vectors(texts.slice(begin, end - begin).to_pylist())
            for lang, vector in zip(langs[begin:end], _unit(vectors), strict=True):
                total[lang] = total.get(lang, 0) + vector.astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["lang", "v"])


def learn(docs: DataFrame, per_language: int = 2_000, max_languages: int = 5_000) -> tuple[list[str], np.ndarray]:
    """(text, lang, doc_id) -> languages in order, and their unit prototypes."""
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    # one row for each of the most frequent languages: bounded, so texts need no shuffle to meet their count
    counts = F.broadcast(rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(1 << 30)
    sample = rows.join(counts, "lang").filter(draw < per_language / F.col("n")).select("text", "lang")
    sums = sample.mapInArrow(_bundles, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    found = sums.groupBy("lang", "i").agg(F.sum("x").alias("x")).collect()  # languages x dimensions
    names = sorted({r[0] for r in found})
    prototypes = np.zeros((len(names), DIMENSIONS))
    place = {n: k for k, n in enumerate(names)}
    for lang, i, x in found:
        prototypes[place[lang], i] = round(x, 6)
    return names, _unit(prototypes).astype(np.float32)


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray) -> DataFrame:
    """(doc_id, text) -> doc_id, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch)
            lang, score = [], []
            for begin, end in slices(texts, 1 << 20):
                vectors, has = document_vectors(texts.slice(begin, end - begin).to_pylist())
                near = _unit(vectors) @ prototypes.T if names else np.zeros((end - begin, 0))
                for row, ok in zip(near, has, strict=True):
                    best = int(np.argmax(row)) if ok and len(row) else -1
                    lang.append(names[best] if best >= 0 else "und")
                    score.append(float(min(1.0, max(0.0, row[best]))) if best >= 0 else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.lower("text").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned = learn(docs.select("doc_id", F.lower("text").alias("text"), "lang"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return predict(docs.select("doc_id", "text"), *learned).select("doc_id", held.alias("held_out"), "lang_pred", "score")
