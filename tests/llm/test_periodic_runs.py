"""Periodic runs against brute force over all lags, and on hard tables."""

import random
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from stockweave.llm import periodic_runs
from stockweave.llm.words import Words
from tests.llm.test_llm import WORD, hard_rows, table


def brute(words, min_length=24, min_exponent=3):
    n, out = len(words), []
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(min_length, min_exponent * q) and all(any(words[x] != words[x + r] for x in range(s, e - r)) for r in range(1, q)):
                out.append((s, e, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng):
    words = []
    while len(words) < rng.randint(1, 700):
        size = rng.choice([2, 3, 50])
        if rng.random() < 0.4:
            words += [str(rng.randrange(size)) for _ in range(rng.randint(0, 60))]
        else:
            q = rng.choice([1, 2, 3, 5, 8, 31, 32, 33, 40, 47, 48, 64, 71, 72, 100, 108])
            base = [str(rng.randrange(size)) for _ in range(q)]
            if rng.random() < 0.3:
                base = (base[: max(1, q // 3)] * 4)[:q]
            words += [base[i % len(base)] for i in range(int(q * rng.uniform(2.5, 5)))]
    return words


def test_against_brute_force():
    rng, total = random.Random(11), 0
    for _ in range(120):
        docs = [random_words(rng) for _ in range(rng.randint(1, 5))]
        docs[0] = docs[-1]
        ids, begin = periodic_runs._separated(Words(pa.array([" ".join(d) for d in docs])))
        for exponent in (3, 5):
            want = [(s + int(begin[k]), e + int(begin[k]), q) for k, d in enumerate(docs) for s, e, q in brute(d, 24, exponent)]
            assert periodic_runs.find_runs(ids, begin, 24, exponent) == sorted(want, key=lambda r: (r[0], r[2]))
            total += len(want)
    assert total > 500


def test_hard_table(spark):
    rng = random.Random(2)
    long_tail = [f"v{i}" for i in range(9000)] * 4
    rows = hard_rows() + [(5000 + i, " ".join(random_words(rng)), "en", "a") for i in range(20)] + [(6000, "x " * 50_000, "en", "a"), (6001, " ".join(long_tail), None, None)]
    rows += [(6000, "x " * 50_000, "en", "a")] * 3
    docs = table(spark, rows).withColumn("_run_list", F.lit("clash"))
    out = periodic_runs.with_runs(docs)
    assert out.columns == [c for c in docs.columns if c != "_run_list"] + list(periodic_runs._NAMES)
    got = out.collect()
    assert len(got) == len(rows)
    want, found = Counter(), Counter()
    for r in got:
        words = WORD.findall(r.text or "")
        runs = brute(words) if len(words) < 5000 else [(0, 50_000, 1)] * (words[0] == "x") or [(0, 36_000, 9000)] * (words[0] == "v0")
        gone = {i for s, e, q in runs for i in range(s + q, e)}
        want[(r.doc_id, len(words), tuple((s, e - s, q) for s, e, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone))] += 1
        found[(r.doc_id, r._run_words, tuple(map(tuple, r._run_list)), r._run_kept)] += 1
    assert want == found and periodic_runs.with_runs(docs.filter("false")).count() == 0


def test_strongest_and_damage(spark):
    runs = [(9, 30, 10), (4, 60, 20), (4, 24, 8), (0, 24, 9)]
    frame = spark.createDataFrame([(runs,), ([],)], "r array<struct<start: bigint, length: bigint, period: bigint>>")
    assert [tuple(r.b) if r.b else None for r in frame.select(periodic_runs.strongest(F.col("r")).alias("b")).collect()] == [(4, 24, 8), None]
    rows = [(i, " ".join(f"w{j}" for j in range(i % 90))) for i in range(400)] + [(None, "a b"), (7, None)]
    for r in periodic_runs.damaged(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        text = dict(rows[:400]).get(r.doc_id) if r.doc_id is not None else "a b"
        if r.text is None:
            continue
        words, h = (text or "").split(), zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        if h % 10 == 0 and words:
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert r.text.split() == words
