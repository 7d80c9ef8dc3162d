"""Periodic runs of words, found with multi-scale minimizers, short periods by direct lag scans.

A run is a stretch of consecutive words (words `[^\\x20\\x09-\\x0D]+`, compared as they are) with smallest period q (words q apart are identical) and a length of at least max(`min_length`, `min_exponent` * q) words that no neighbouring word extends keeping period q.

Short periods. For every q below `SHORT` the words are compared with those q further on; long enough stretches of equality are runs.

Longer periods go by scales [A, B) with B = 3/2 A. A scale hashes all k-grams with k = B - 1 words. In a run of period q < B a k-gram has the length of a period at least, so it occurs again exactly q further on and not before. A minimizer is a k-gram that is the least of some window of w neighbouring k-grams; w is such that a run of q >= A holds a whole window and the same window q further on. Both choose the same k-gram, so each run shows as two neighbouring minimizers of equal value at distance q. These pairs are seeds: each is extended word by word to both sides. Candidates stay in proportion to the text at each scale, and there are about log(words) scales. Nothing is sampled: every run of a scale has a seed.

A stretch of period q that also has a smaller period (then a divisor of q) is the run of that period only.

Documents are joined to one array per slice of some megabytes, with a separator word of its own after each, so no stretch leaves its document. Words are compared by 64-bit hashes. Work is row by row in Spark tasks without a shuffle, so no key is hot and a lost executor costs its own tasks. Memory is bounded by a slice or, if longer, one text.

Null or empty text has no words and no runs; a very long text is worked on as a whole; repeated rows and rows with a null doc_id are treated each by itself; an empty table gives an empty result. Input columns stay, except that columns named like the results (`_run_*`) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let, own_columns, words
from .words import BASE, WORD_BASE, Words, mix, slices, text_column, window_sums

#: Periods below this are found by direct lag scans.
SHORT = 32
_RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_NAMES = ("_run_words", "_run_list", "_run_kept")


def _primes(q: int) -> list[int]:
    out, f = [], 2
    while f * f <= q:
        if q % f == 0:
            out.append(f)
            while q % f == 0:
                q //= f
        f += 1
    return [*out, q] if q > 1 else out


def _sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) of each run of `width` values."""
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        values = least(values[:-step], values[step:])
        reach += step
    return values


def _ahead(ids: np.ndarray, at: int, lag: int) -> int:
    """How many words from `at` on equal those `lag` further on."""
    n, size, limit = 0, 64, len(ids) - lag - at
    while n < limit:
        size = min(2 * size, limit - n)
        wrong = ids[at + n : at + n + size] != ids[at + lag + n : at + lag + n + size]
        if wrong.any():
            return n + int(wrong.argmax())
        n += size
    return n


def _behind(ids: np.ndarray, at: int, lag: int) -> int:
    """How many words before `at` equal those `lag` further on."""
    n, size = 0, 64
    while n < at:
        size = min(2 * size, at - n)
        wrong = ids[at - n - size : at - n] != ids[at + lag - n - size : at + lag - n]
        if wrong.any():
            return n + int(wrong[::-1].argmax())
        n += size
    return n


def _short_runs(ids: np.ndarray, min_length: int, min_exponent: int) -> Iterator[tuple[int, int, int]]:
    for q in range(1, SHORT):
        need = max(min_length, min_exponent * q) - q
        same = np.flatnonzero(ids[:-q] == ids[q:])
        if len(same) < need:
            continue
        cut = np.flatnonzero(np.diff(same) > 1)
        first = same[np.concatenate(([0], cut + 1))]
        last = same[np.concatenate((cut, [len(same) - 1]))]
        for i in np.flatnonzero(last - first + 1 >= need):
            yield int(first[i]), int(last[i]) + 1 + q, q


def _seeds(ids: np.ndarray, a: int, b: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances in [a, b) of neighbouring equal minimizers, ordered by distance and place."""
    k, width = b - 1, (min_exponent - 1) * a - b + 2
    places = np.arange(len(ids) - k + 1)
    grams = mix(window_sums(ids, places, places + k, WORD_BASE))
    edge = np.zeros(width - 1, np.uint64)
    least = _sliding(grams, width, np.minimum)
    chosen = np.flatnonzero(_sliding(np.concatenate((edge, least, edge)), width, np.maximum) == grams)
    values = grams[chosen]
    order = np.argsort(values, kind="stable")
    at, values = chosen[order], values[order]
    distance = at[1:] - at[:-1]
    keep = (values[1:] == values[:-1]) & (distance >= a) & (distance < b)
    at, distance = at[:-1][keep], distance[keep]
    order = np.lexsort((at, distance))
    return at[order], distance[order]


def _long_runs(ids: np.ndarray, begin: np.ndarray, min_length: int, min_exponent: int) -> Iterator[tuple[int, int, int]]:
    """`begin` holds where each document of `ids` begins, and the end; each has one separator."""
    sizes, a = np.diff(begin), SHORT
    while (fits := sizes > min_exponent * a).any():
        b = 3 * a // 2
        mine, back = ids, None
        if not fits.all():
            back = np.flatnonzero(np.repeat(fits, sizes))
            mine = ids[back]
        end, lag = -1, 0
        for at, q in zip(*(x.tolist() for x in _seeds(mine, a, b, min_exponent)), strict=True):
            if q == lag and at + q < end:
                continue
            start = at - _behind(mine, at, q)
            end, lag = at + q + _ahead(mine, at, q), q
            if end - start >= max(min_length, min_exponent * q):
                shift = 0 if back is None else int(back[start]) - start
                yield start + shift, end + shift, q
        a = b


def find_runs(ids: np.ndarray, begin: np.ndarray, min_length: int = 24, min_exponent: int = 3) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs by start and period, as places in `ids`."""
    found = [*_short_runs(ids, min_length, min_exponent), *_long_runs(ids, begin, min_length, min_exponent)] if len(ids) else []
    smallest = lambda s, e, q: all(not np.array_equal(ids[s : e - q // f], ids[s + q // f : e]) for f in _primes(q))
    return sorted(((s, e, q) for s, e, q in found if smallest(s, e, q)), key=lambda r: (r[0], r[2]))


def _separated(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words of all documents, each document followed by a word that occurs nowhere else, and where documents begin."""
    counts = np.diff(found.first)
    begin = np.concatenate(([0], np.cumsum(counts + 1)))
    ids = np.empty(begin[-1], np.uint64)
    last = begin[1:] - 1
    inside = np.ones(len(ids), bool)
    inside[last] = False
    ids[inside] = found.hashes[found.first[0] : found.first[-1]]
    ids[last] = mix(np.arange(1, len(last) + 1, dtype=np.uint64) * np.uint64(BASE) ^ np.uint64(0x5851F42D4C957F2D))
    return ids, begin


def _with_runs(min_length: int, min_exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch)
            for lo, hi in slices(texts):
                part = texts.slice(lo, hi - lo)
                ids, begin = _separated(Words(part))
                own: list[list[dict]] = [[] for _ in range(hi - lo)]
                for s, e, q in find_runs(ids, begin, min_length, min_exponent):
                    d = int(np.searchsorted(begin, s, "right")) - 1
                    own[d].append({"start": s - int(begin[d]), "length": e - s, "period": q})
                kept = []
                for text, runs in zip(part, own, strict=True):
                    split = text.as_buffer().to_pybytes().split()
                    if runs:
                        edge = np.zeros(len(split) + 1, np.int64)
                        for r in runs:
                            edge[r["start"] + r["period"]] += 1
                            edge[r["start"] + r["length"]] -= 1
                        split = [w for w, n in zip(split, np.cumsum(edge[:-1]).tolist(), strict=True) if not n]
                    kept.append(b" ".join(split))
                new = [pa.array(np.diff(begin) - 1, pa.int64()), pa.array(own, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, *new], [*batch.schema.names, *_NAMES])

    return run


def with_runs(docs: DataFrame, min_length: int = 24, min_exponent: int = 3) -> DataFrame:
    """Adds to each document _run_words (its number of words), _run_list (start, length, period of its runs by start, then period) and _run_kept: its words without those that a run holds after its first period, joined by one space. `min_exponent` is 3 or more."""
    if min_exponent < 3:
        raise ValueError("runs repeat their period three times at least")
    kept = docs.select(*own_columns([c for c in docs.columns if c not in _NAMES]))
    schema = f"{kept.schema.toDDL()}, _run_words bigint, _run_list {_RUNS}, _run_kept string"
    return kept.mapInArrow(_with_runs(min_length, min_exponent), schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; ties: smallest start, then period. Null if there is none."""

    def order(x: Column, y: Column) -> Column:
        left, right = x["length"] * y["period"], y["length"] * x["period"]
        before = (left > right) | ((left == right) & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"]))))
        same = (x["start"] == y["start"]) & (x["period"] == y["period"])
        return F.when(same, 0).when(before, -1).otherwise(1)

    return F.try_element_at(F.array_sort(runs, order), F.lit(1))


def damaged(docs: DataFrame) -> DataFrame:
    """(doc_id, text): one document of ten gets a periodic tail; a null doc_id gets none."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def tail(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = g % n
        p = F.floor((n - a) / (3 + g % 8)) + 1
        bound = let(F.struct(a.alias("a"), p.alias("p")), lambda t: F.transform(ws, lambda w, i: F.when(i < t["a"], w).otherwise(F.element_at(ws, (t["a"] + (i - t["a"]) % t["p"] + 1).cast("int")))))
        return F.when(n > 0, F.array_join(bound, " ")).otherwise(F.col("text"))

    return docs.withColumn("text", F.when(h % 10 == 0, let(words(F.col("text")), tail)).otherwise(F.col("text")))


def op13(spark, sf_dir: str) -> DataFrame:
    docs = damaged(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    best = strongest(F.col("_run_list"))
    lines = F.transform("_run_list", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = with_runs(docs).withColumn("best", best)
    return out.select(
        "doc_id",
        F.size("_run_list").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("_run_kept", 256).alias("collapsed_sha256"),
    )


def _op13_sql() -> str:
    """Runs by brute force over lags: a lag is tried if two neighbouring equal stretches of 2 ** j words lie that far apart, every tried lag is compared word by word, and a stretch inside one of a divisor's period goes. The levels reach periods of 32,768 words."""
    levels = [2**j for j in range(16)]
    grams = ["g1 AS (SELECT doc_id, i, hash(w) AS g FROM t)"]
    grams += [f"g{2 * k} AS (SELECT doc_id, i, hash(g, h) AS g FROM (SELECT doc_id, i, g, lead(g, {k}) OVER (PARTITION BY doc_id ORDER BY i) AS h FROM g{k}) WHERE h IS NOT NULL)" for k in levels[:-1]]
    lags = " UNION ".join(f"SELECT DISTINCT doc_id, q FROM (SELECT doc_id, i - lag(i) OVER (PARTITION BY doc_id, g ORDER BY i) AS q FROM g{k}) WHERE 2 * q >= {k} AND q <= {k}" for k in levels)
    return rf"""
WITH c AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) AS h
  FROM documents
), e AS (SELECT doc_id, ws, h, (h // 10) % greatest(len(ws), 1) AS a, len(ws) AS n, 3 + (h // 10) % 8 AS m FROM c),
d AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // m) END]) ELSE ws END AS ws FROM e),
t AS MATERIALIZED (SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS i FROM d),
{", ".join(grams)},
lags AS MATERIALIZED ({lags}),
same AS (SELECT l.doc_id, q, x.i FROM lags l JOIN t x ON x.doc_id = l.doc_id JOIN t y ON y.doc_id = l.doc_id AND y.i = x.i + q AND y.w = x.w),
stretches AS MATERIALIZED (SELECT doc_id, q, min(i) AS s, max(i) + 1 + q AS e FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM same)
  GROUP BY doc_id, q, part HAVING max(i) + 1 + q - min(i) >= greatest(24, 3 * q)),
runs AS MATERIALIZED (SELECT * FROM stretches x WHERE NOT EXISTS (SELECT 1 FROM stretches y WHERE y.doc_id = x.doc_id AND y.q < x.q AND x.q % y.q = 0 AND y.s <= x.s AND y.e >= x.e)),
best AS (SELECT doc_id, s, e - s AS length, q FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (e - s)::DOUBLE / q DESC, s, q) = 1),
listed AS (SELECT doc_id, count(*) AS n, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, e)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS words FROM t ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_runs, best.s AS start, best.length, best.q AS period, 1000 * best.length // best.q AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


OP13_SQL = _op13_sql()
