"""MinHash near-dedup against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from stockweave.llm import minhash_dedup
from tests.llm.test_llm import WORD, hard_rows, table


def word_sets(rows, n):
    out = defaultdict(list)
    for doc, text in rows:
        w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        out[doc].append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    return out


def expected(rows, n, percent):
    sets = word_sets(rows, n)
    parent = {d: d for d in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            if a < b and any(100 * len(x & y) >= percent * len(x | y) and x for x in sets[a] for y in sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return Counter((d, len(s), None if d is None else find(d)) for d, own in sets.items() for s in own)


def near_copies(rng):
    """Groups of copies from barely altered to clearly below the bound, chains of copies of copies, and shared passages."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    altered = lambda ws, share: [word() if rng.random() < share else w for w in ws]
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([4, 9, 40, 150, 600]))]
        chain = base
        for i in range(10):
            rows.append((1000 * g + rng.randrange(1000), " ".join(altered(base, rng.choice([0, 0.01, 0.02, 0.04, 0.08])))))
            chain = altered(chain, 0.02)
            rows.append((1000 * g + rng.randrange(1000), " ".join(chain).upper()))
    passage = [word() for _ in range(120)]
    rows += [(50_000 + i, " ".join([word() for _ in range(60)] + passage + [word() for _ in range(rng.randint(0, 200))])) for i in range(40)]
    return list({d: (d, t) for d, t in rows}.values())


@pytest.mark.parametrize(("n", "percent"), [(4, 80), (3, 60), (5, 90)])
def test_against_brute_force(spark, monkeypatch, n, percent):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 3)
    rows = [(r[0], r[1]) for r in hard_rows()] + near_copies(random.Random(n))
    docs = table(spark, [(*r, "en", "a") for r in rows])
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(docs, n, percent).collect())
    assert got == expected(rows, n, percent)


def test_filter_and_edges(spark):
    docs = table(spark, [(5, "A b c d e f", "en", "a"), (3, "a B c d e f", "en", "a"), (7, "", "en", "a"), (None, "a b c d e f", "en", "a"), (8, None, None, None)])
    kept = minhash_dedup.without_near_copies(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter([3, 7, None, 8])
    assert minhash_dedup.near_duplicates(docs.filter("false")).count() == 0


def test_minhash_rates():
    rng = np.random.default_rng(4)
    common = rng.integers(0, 1 << 63, 800).astype(np.uint64)
    x, y = (np.concatenate((common, rng.integers(0, 1 << 63, 100).astype(np.uint64))) for _ in range(2))
    a, b = minhash_dedup.minhashes([x, y, np.zeros(0, np.uint64)], 2000)[:2]
    assert abs((a == b).mean() - 0.8) < 0.04
    assert minhash_dedup.parts_for(80) == 10


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(5)
    for n in (1, 30, 400, 3000):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate((x[: n * 8 // 10], rng.integers(0, 1 << 63, n // 4).astype(np.uint64))))
        rates, bits = minhash_dedup.bitmaps([x, y])
        apart = int(np.unpackbits((bits[0] ^ bits[1]).view(np.uint8)).sum())
        assert apart <= len(np.setxor1d(x, y)) and rates[0] == (3 if n == 3000 else 0)
