"""Conversation repair against a plain search over edit sequences."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from stockweave.llm import conversation_repair as repair

GRAMMAR = re.compile("(s?(ua)+)?")
GAPS = " \t\n\x0b\x0c\r"


def faults(rows):
    """Fault of each (role, text) in order."""
    out, seen = [], set()
    for role, text in rows:
        text_ = text.strip(GAPS)
        out.append("blank" if not text_ else "duplicate" if (role, text) in seen else "" if text_[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def best(rows):
    """(cost, audit, turns) by a search over (place, roles so far), the grammar tested on whole prefixes."""
    fault = faults(rows)

    def can_go_on(roles):
        return re.fullmatch("s?(ua)*u?", roles) is not None

    @lru_cache(None)
    def go(i, last, inserted):
        options = []
        if i == len(rows):
            if last in ("start", "a"):
                options.append((0, "", ()))
        else:
            role, text = rows[i]
            cost, audit, turns = go(i + 1, last, 0)
            options.append((cost + 4, "D" + audit, turns))
            if fault[i] in ("", "truncated"):
                extra = 3 if fault[i] else 0
                for edit, new, price in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if can_go_on(("" if last == "start" else {"s": "s", "u": "u", "a": "ua"}[last]) + (new[:1] or "?")):
                        cost, audit, turns = go(i + 1, new[:1], 0)
                        options.append((cost + extra + price, edit + audit, ((new, text), *turns)))
        if inserted < 3:
            for new in ("user", "assistant"):
                if can_go_on(("" if last == "start" else {"s": "s", "u": "u", "a": "ua"}[last]) + new[0]):
                    cost, audit, turns = go(i, new[0], inserted + 1)
                    options.append((cost + 3, "I" + audit, ((new, ""), *turns)))
        return min(options, default=(1 << 40, "", ()))

    return go(0, "start", 0)


def exhaustive(rows):
    """(cost, audit) over every edit sequence with up to two inserted rows at each place; for a few rows only."""
    fault, found = faults(rows), (1 << 40, "")
    choices = [[("D", None, 4)] + ([("K", r, 0), ("R", "user", 3), ("R", "assistant", 3)] if f in ("", "truncated") else []) for (r, _), f in zip(rows, fault)]
    inserts = [c for n in range(3) for c in itertools.product(("user", "assistant"), repeat=n)]
    for edits in itertools.product(*choices):
        for added in itertools.product(inserts, repeat=len(rows) + 1):
            roles, audit, cost = "", "", 0
            for i in range(len(rows) + 1):
                roles += "".join(r[0] for r in added[i])
                audit += "I" * len(added[i])
                cost += 3 * len(added[i])
                if i < len(rows):
                    edit, role, price = edits[i]
                    audit += edit
                    cost += price + (3 if edit != "D" and fault[i] else 0)
                    roles += role[:1] if role else ""
            if GRAMMAR.fullmatch(roles):
                found = min(found, (cost, audit))
    return found


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        named = lambda x: " " if x is None else str(x)
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{named(conv)}:{named(turn)}".encode()) % 20
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def expected(rows):
    """One row per conversation; turns of a conversation are distinct but for equal rows."""
    out = {}
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    for conv, own in groups.items():
        own = ordered(own)
        pairs = [(r, t) for _, _, r, t in own]
        fault = Counter(faults(pairs))
        turns = {t for _, t, _, _ in own if t is not None}
        first = [r[:1] if r[:1] in ("s", "u", "a") else "o" for r, _ in pairs]
        cost, audit, fixed = best(tuple(pairs))
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, fault["blank"], fault["duplicate"], fault["truncated"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest(),
        )
    return out


def conversations(rng, n):
    rows = []
    for c in range(n):
        turn = rng.randint(-2, 3)
        for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 40])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None])
            rows.append((c, turn, role, rng.choice([None, "", " \t", "Fine.", "Well!  ", "Why?\n", "cut", "a. b", "n\u2028", f"Own {rng.randint(0, 99)}.", f"Own {rng.randint(0, 99)}"])))
            turn += rng.choice([1, 1, 1, 2])
        if c % 7 == 0:
            rows.append((c, None, "system", "Be kind."))
    return rows


SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_search_is_exhaustive():
    rng = random.Random(1)
    for _ in range(60):
        rows = tuple((rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["", "Yes.", "No.", "cut"])) for _ in range(rng.randint(0, 3)))
        assert best(rows)[:2] == exhaustive(rows), rows


@pytest.mark.parametrize("piece", [4096, 3])
def test_against_search(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE", piece)
    rng = random.Random(piece)
    rows = conversations(rng, 60) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hello."), (1000, None, None, None)]
    rows += [(1001, i, ["user", "assistant"][i % 2], f"Turn {i}.") for i in range(300)] + [(1002, 5, "user", "Same.")] * 50
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(c).alias(c) for c in ("part", "seq", "u", "d1", "symbol", "audit")])
    frame.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.op12(spark, str(tmp_path)).collect()}
    want = expected(damage(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for conv in {r[0] for r in rows}:
        assert got.pop(conv) == want.get(conv, nothing), conv
    assert not got


def test_turns_and_empty_table(spark):
    frame = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hm."), (2, 0, "system", "S.")], SCHEMA)
    turns = repair.repaired_turns(frame).orderBy("conv_id", "at").collect()
    assert [(r.conv_id, r.edit, r.role, r.text) for r in turns] == [(1, "K", "user", "Hi."), (1, "R", "assistant", "Hm.")]
    assert repair.repaired_turns(frame.filter("false")).count() == 0 and repair.reports(frame.filter("false")).count() == 0
