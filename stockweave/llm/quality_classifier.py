"""Quality classifier by co-training of two views.

The text view sees what is written: shares of symbols, capitals, digits, marks and white space, word length, share of distinct words and of words that repeat at once. The metadata view sees the page around it: source, language, sizes and line layout. Each view is a logistic model. In every round each view labels the pool rows it is surest of, and these join the training rows of the other view. Then each view is calibrated on labelled rows it was not trained on, and the calibrated log-odds are added by weights fitted on the same rows.

Training reads at most `max_rows` labelled rows, chosen by hash, and the whole pool of rows without label. Features of all rows are made by Spark tasks in one pass over whole texts and written once; their means and spreads, the Newton sums of each step and the histogram of certainties of each round are added up in tasks over that table, so the driver holds the labelled rows and fixed numbers only. The surest rows are those above a threshold that is found on a histogram of log-odds with `BINS` bins of 1/512: bins are taken whole, the surest first, until `share` of the pool is reached, so a round may exceed it by one bin. Which rows a view has been taught is computed anew from the thresholds of all rounds.

Null and empty texts have zero features and a score like others. Null metadata is a value of its own. Rows are judged one by one and repeated rows agree. Rows whose crc32(doc_id as text) mod 5 is 0 are held out from all training. Without labels the score is constant.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .logistic import fit, sigmoid
from .stage import written
from .toxicity import held_out
from .words import SPACES, Words, slices, text_column

SOURCE_CELLS, LANGUAGE_CELLS = 16, 8
N_TEXT, N_META = 10, 5 + SOURCE_CELLS + LANGUAGE_CELLS
BINS = 1 << 16


def _table(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)], np.int64)


CLASSES = np.stack(
    (
        _table(lambda b: chr(b) in "#*$%&|<>" and b < 128),
        _table(lambda b: 65 <= b <= 90),
        _table(lambda b: 48 <= b <= 57),
        _table(lambda b: chr(b) in "!?" and b < 128),
        _table(lambda b: chr(b) in ".,;:" and b < 128),
        _table(lambda b: bool(SPACES[b])),
        _table(lambda b: b == 10),
        _table(lambda b: b >= 128),
    )
)


def views(texts: pa.Array, source: list, lang: list) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of both views for a run of documents."""
    run = Words(texts)
    size = np.diff(run.offsets).astype(float)
    n = np.maximum(size, 1)
    sums = []
    for table in CLASSES:
        total = np.concatenate(([0], np.cumsum(table[run.data])))
        sums.append((total[run.offsets[1:]] - total[run.offsets[:-1]]).astype(float))
    symbols, upper, digits, calls, marks, spaces, breaks, other = sums
    words = np.diff(run.first).astype(float)
    w = np.maximum(words, 1)
    distinct, repeats = np.zeros(len(run)), np.zeros(len(run))
    for d in range(len(run)):
        own = run.hashes[run.first[d] : run.first[d + 1]]
        distinct[d] = len(np.unique(own))
        repeats[d] = (own[1:] == own[:-1]).sum()
    # the share of distinct words falls with length by itself; this is the excess over a slow fall
    text = np.stack((symbols / w, upper / n, digits / n, calls / w, marks / w, (size - spaces) / w, distinct / w, repeats / w, np.log1p(words) * distinct / w / 5, other / n), axis=1)
    meta = np.zeros((len(run), N_META))
    meta[:, 0], meta[:, 1], meta[:, 2] = np.log1p(size), np.log1p(breaks), np.log1p(size / (breaks + 1))
    meta[:, 3], meta[:, 4] = np.log1p(words), (size == 0).astype(float)
    for d, (s, g) in enumerate(zip(source, lang, strict=True)):
        meta[d, 5 + zlib.crc32(repr(s).encode()) % SOURCE_CELLS] = 1
        meta[d, 5 + SOURCE_CELLS + zlib.crc32(repr(g).encode()) % LANGUAGE_CELLS] = 1
    return text, meta


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    texts, source, lang = text_column(batch), batch.column("source").to_pylist(), batch.column("lang").to_pylist()
    parts = [views(texts.slice(a, b - a), source[a:b], lang[a:b]) for a, b in slices(texts)]
    return (np.vstack([p[0] for p in parts]), np.vstack([p[1] for p in parts])) if parts else (np.zeros((0, N_TEXT)), np.zeros((0, N_META)))


class View:
    """A standardised logistic model with its calibration."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        self.mean, self.spread = mean, spread
        self.w, self.a, self.b = np.zeros(len(mean) + 1), 1.0, 0.0

    def rows(self, x: np.ndarray) -> np.ndarray:
        return np.hstack((np.ones((len(x), 1)), np.clip((x - self.mean) / self.spread, -8, 8)))

    def raw(self, x: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
        return self.rows(x) @ (self.w if w is None else w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.a * self.raw(x) + self.b


class Model:
    def __init__(self, text: View, meta: View, mix: np.ndarray):
        self.text, self.meta, self.mix = text, meta, mix

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, m = self.text.logit(text), self.meta.logit(meta)
        return sigmoid(t), sigmoid(m), sigmoid(self.mix[0] + self.mix[1] * t + self.mix[2] * m)


def _newton(rows: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Number of rows, sum of y, slope and curvature of the likelihood at w, in one row of numbers."""
    p = sigmoid(rows @ w)
    return np.concatenate(([len(y), y.sum()], rows.T @ (y - p), ((rows * (p * (1 - p))[:, None]).T @ rows).ravel()))


def _bins(certainty: np.ndarray) -> np.ndarray:
    """Bins of log-odds, the surest have the highest number."""
    return np.clip(np.floor((certainty + BINS / 1024) * 512), 0, BINS - 1).astype(np.int64)


def taught(view: View, x: np.ndarray, free: np.ndarray, history: list, sure: float) -> np.ndarray:
    """The label that the teacher `view` has given each row in the rounds of `history` (weights, lowest bin of good, of bad), -1 where none."""
    out = np.full(len(x), -1)
    least = np.log(sure / (1 - sure))
    for w, *lowest in history:
        raw = view.raw(x, w)
        for label, certainty, low in ((1, raw, lowest[0]), (0, -raw, lowest[1])):
            out[free & (out < 0) & (certainty >= least) & (_bins(certainty) >= low)] = label
    return out


def _summed(pool: DataFrame, part) -> dict[int, float]:
    """Sums over all rows of the pool of part(text, meta, free) -> (places, values), a fixed number of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, float] = {}
        for batch in batches:
            if batch.num_rows:
                text, meta = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, n) for c, n in (("t", N_TEXT), ("m", N_META)))
                for at, value in zip(*(x.tolist() for x in part(text, meta, batch.column("free").to_numpy(zero_copy_only=False))), strict=True):
                    total[at] = total.get(at, 0.0) + value
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.float64())], ["at", "value"])

    return {r[0]: r[1] for r in pool.mapInArrow(run, "at bigint, value double").groupBy("at").agg(F.sum("value")).collect()}


def _dense(sums: dict[int, float], n: int) -> np.ndarray:
    out = np.zeros(n)
    out[list(sums)] = list(sums.values())
    return out


def _train(both: list[View], x: list[np.ndarray], y: np.ndarray, pool: DataFrame, history: list[list], sure: float, steps: int = 25) -> list[int]:
    """Fits both views to the labelled rows and all pool rows they have been taught; gives the number of the latter."""
    ends = np.cumsum([0] + [2 + len(v.w) + len(v.w) ** 2 for v in both])
    done, n_taught = [False, False], [0, 0]
    for turn in range(steps):
        now = [v.w for v in both]

        def part(text, meta, free, now=now):
            views_, out = (text, meta), []
            for pupil, view in enumerate(both):
                label = taught(both[1 - pupil], views_[1 - pupil], free, history[pupil], sure)
                out.append(_newton(view.rows(views_[pupil][label >= 0]), label[label >= 0].astype(float), now[pupil]))
            return np.arange(ends[-1]), np.concatenate(out)

        sums = _dense(_summed(pool, part), ends[-1]) if history[0] or history[1] else np.zeros(ends[-1])
        for i, view in enumerate(both):
            if done[i]:
                continue
            own = sums[ends[i] : ends[i + 1]]
            n_taught[i] = int(own[0])
            total = own + _newton(view.rows(x[i]), y, view.w)
            k = len(view.w)
            if total[0] == 0 or total[1] in (0, total[0]):
                share = (total[1] + 0.5) / (total[0] + 1)
                view.w, done[i] = np.concatenate(([np.log(share / (1 - share))], np.zeros(k - 1))), True
                continue
            pull = np.concatenate(([1e-6], np.ones(k - 1)))
            step = np.linalg.solve(total[2 + k :].reshape(k, k) + np.diag(pull + 1e-9), total[2 : 2 + k] - pull * view.w)
            view.w = view.w + step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
            done[i] = np.abs(step).max() < 1e-6
        if all(done):
            break
    return n_taught


def _lowest(counts: np.ndarray, quota: int) -> int:
    """The bin down to which the surest rows reach the quota."""
    enough = np.flatnonzero(np.cumsum(counts[::-1]) >= quota)
    return BINS - 1 - int(enough[0]) if len(enough) else 0


def co_train(both: list[View], views_: list[np.ndarray], y: np.ndarray, pool: DataFrame, n_free: int, rounds: int = 5, share: float = 0.02, sure: float = 0.9) -> Model:
    """Labelled rows with y, and a table of all rows with features t, m and whether they are free (without label). Every third labelled row only calibrates."""
    keep = np.arange(len(y)) % 3 == 0
    x, own, history = [v[~keep] for v in views_], y[~keep].astype(float), [[], []]
    least = np.log(sure / (1 - sure))
    for turn in range(rounds + 1):
        n_taught = _train(both, x, own, pool, history, sure)
        if turn == rounds or not n_free:
            break

        def part(text, meta, free):
            at = []
            for pupil, (teacher, rows) in enumerate(((both[1], meta), (both[0], text))):
                raw = teacher.raw(rows)[free & (taught(teacher, rows, free, history[pupil], sure) < 0)]
                at += [_bins(c[c >= least]) + (2 * pupil + i) * BINS for i, c in enumerate((raw, -raw))]
            return np.unique(np.concatenate(at), return_counts=True)

        counts = _dense(_summed(pool, part), 4 * BINS).reshape(4, BINS)
        for pupil in (0, 1):
            lowest = [_lowest(counts[2 * pupil + i], int(share * n_free) + 1) for i in (0, 1)]
            history[pupil].append((both[1 - pupil].w.copy(), *lowest))
    held = [v[keep] for v in views_]
    for view, rows in zip(both, held, strict=True):
        view.b, view.a = fit(view.raw(rows)[:, None], y[keep].astype(float), ridge=0.1, prior=np.ones(1))
    logits = np.stack([v.logit(r) for v, r in zip(both, held, strict=True)], axis=1)
    model = Model(*both, fit(logits, y[keep].astype(float), ridge=1.0, prior=np.array([0.5, 0.5])))
    model.history, model.taught = history, n_taught
    return model


_FEATURES = "doc_id bigint, y int, k bigint, t array<double>, m array<double>"


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, meta = _rows(batch)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "y", "k")], lists(text), lists(meta)], ["doc_id", "y", "k", "t", "m"])


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000) -> Model:
    """(doc_id, text, source, lang) and (doc_id, quality) -> model."""
    usable = F.col("doc_id").isNotNull() & ~held_out(5, 0)
    labelled = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y")).filter(usable & F.col("y").isin(0, 1))
    chosen = labelled.orderBy(F.xxhash64("doc_id", "y"), "doc_id").limit(max_rows)
    rows = docs.filter(usable).select(F.col("doc_id").cast("long"), "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("k"))
    featured = lambda frame: frame.select("doc_id", "y", "k", "text", "source", "lang").mapInArrow(_featured, _FEATURES)
    # at most max_rows ids are sent, and of ids in many rows as many different texts come back
    taught = rows.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "k", "y", "source", "lang"]).orderBy(F.xxhash64("doc_id", "k", "y"), "doc_id").limit(max_rows)
    known = featured(taught).select("y", "k", "t", "m").collect()
    known.sort(key=lambda r: (r.k, r.t))
    marked = labelled.select("doc_id").distinct().withColumn("known", F.lit(True))
    pool = featured(rows.withColumn("y", F.lit(None).cast("int"))).join(marked, "doc_id", "left")
    pool = written(pool.select("t", "m", F.col("known").isNull().alias("free")), "features")

    def part(text, meta, free):
        x = np.hstack((text, meta))
        values = np.concatenate(([len(x), free.sum()], x.sum(axis=0), (x * x).sum(axis=0)))
        return np.arange(len(values)), values

    n = N_TEXT + N_META
    sums = _dense(_summed(pool, part), 2 + 2 * n)
    mean = sums[2 : 2 + n] / max(sums[0], 1)
    spread = np.sqrt(np.maximum(sums[2 + n :] / max(sums[0], 1) - mean * mean, 0)) + 1e-6
    both = [View(mean[a:b], spread[a:b]) for a, b in ((0, N_TEXT), (N_TEXT, n))]
    if not sums[0]:
        return Model(*both, np.zeros(3))
    part_ = lambda name, width: np.array([r[name] for r in known]).reshape(-1, width)
    return co_train(both, [part_("t", N_TEXT), part_("m", N_META)], np.array([r.y for r in known], int), pool, int(sums[1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text, source, lang) -> doc_id, score_text, score_meta, score: how likely the document is good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [pa.array(c) for c in model.scores(*_rows(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "score_text", "score_meta", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(run, "doc_id bigint, score_text double, score_meta double, score double")


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    out = score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score_text", "score_meta", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
