"""Conversation structure repair: cheapest edits to a legal turn order, from a suffix-shared DAWG over all conversations.

A conversation's rows are taken by turn (nulls first; rows of one turn by role, then by a digest of their text; equal rows in any order, which changes nothing). A row's first fault counts: blank (no `[^\\x20\\x09-\\x0D]`), duplicate (role and text seen earlier in the conversation), truncated (last such character is none of `.!?`). Edits: Keep costs 0, Rerole to user or assistant 3, Delete 4 (required for blank and duplicate rows), Insert an empty user or assistant row 3; a truncated row that stays adds 3. The role initials of the result must be `(s?(ua)+)?`. Of the cheapest edit sequences the one whose initials are ASCII-least counts.

Signatures. A row becomes one symbol: `x` if it must go, else its role initial (`o` for any other role), upper case if truncated. The conversation is the string of its symbols; texts stay out of everything up to the end.

Automaton. All distinct strings are sorted from their ends, so those with a common suffix are neighbours and share the nodes of that suffix: the minimal acyclic automaton of the strings read backwards, walked with a stack. For each node and each of the four grammar states (nothing yet, after s, after u, after a) the cost to the end and the first edit of the best audit suffix are found once, from the node that follows; a conversation's audit is the walk along these edits. Strings are distinct, so a signature that a third of all conversations share is worked on once.

Long conversations. Rows are dealt by range of (conversation, turn, ...), so a conversation may begin in one task and end in another; it is then worked on in pieces of at most `PIECE` rows. A piece's costs from each state to each state (16 numbers) are composed from the last piece to the first, each piece's automaton runs again with the costs that follow it as its end, and the states are handed on from the first piece to the last. So a conversation that holds a third of all rows is no task of its own: only 16 numbers for each `PIECE` rows meet.

Output. `repaired_turns` has one row per turn that is left and never gathers a conversation; `reports` has one row per conversation with an audit of one character per edit. Only the query's digest joins the turns of a conversation to one string, as its contract asks.

Null role and text are one space (so blank); a null conv_id is a conversation of its own; empty tables give empty results; very long texts are only digested and looked at from the end; repeated rows are duplicates; extra columns are not read. Rows are told apart by 128-bit digests of role and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import written

PIECE = 4096
FAR = 1 << 40
#: Cost to accept in the states nothing yet, after s, after u, after a.
ACCEPT = (0, FAR, FAR, 0)
#: The state after a kept role, per state; the state after an inserted or changed role.
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT = (2, 2, 3, 2)
_GAP = r"[\x20\x09-\x0D]"
_KEY = ("d1", "d2")
_ENDS = ("t0", "t1", "t2", "t3")


def initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("o")


def _rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the digests of (role, text)."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    return rows.withColumn("d1", F.xxhash64("role", "text")).withColumn("d2", F.xxhash64(F.lit(1), "role", F.lit(2), "text"))


def _symbols(rows: DataFrame) -> DataFrame:
    """Each row with its number `u`, fault and symbol; without texts."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(rf"[.!?]{_GAP}*\z")
    keys = written(rows.select("conv_id", "turn", "role", *_KEY, blank.alias("blank"), cut.alias("cut"), F.monotonically_increasing_id().alias("u")), "turns")
    place = F.struct("turn", "u")
    firsts = keys.filter("not blank").groupBy("conv_id", *_KEY).agg(F.min(place).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("d1").alias("c1"), F.col("d2").alias("c2"), F.col("first.u").alias("first_u"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2"))
    again = ~F.col("blank") & F.col("first_u").isNotNull() & (F.col("first_u") != F.col("u"))
    fault = F.when(F.col("blank"), "blank").when(again, "duplicate").when(F.col("cut"), "truncated").otherwise("")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    marked = keys.join(firsts, same, "left").withColumn("fault", fault).withColumn("initial", initial(F.col("role")))
    return marked.select("conv_id", "turn", "role", *_KEY, "u", "fault", "initial", symbol.alias("symbol"))


_PIECE = (
    "part int, seq int, open boolean, signature string, roles array<string>, d1 array<bigint>, d2 array<bigint>, blank bigint, duplicate bigint, truncated bigint, illegal bigint,"
    " first_initial string, last_initial string, least_turn bigint, last_turn bigint, turns bigint"
)
LEGAL = {"su", "ua", "au"}


class _Piece:
    """Rows of one conversation that follow each other in one task."""

    def __init__(self, conv, part: int, seq: int, is_open: bool):
        self.conv, self.place, self.open = conv, (part, seq), is_open
        self.symbols, self.roles, self.d1, self.d2 = [], [], [], []
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        self.illegal, self.first, self.last, self.least, self.turn, self.turns = 0, None, None, None, None, 0

    def add(self, turn, role, d1, d2, fault, initial_, symbol) -> None:
        self.symbols.append(symbol)
        self.roles.append(role)
        self.d1.append(d1)
        self.d2.append(d2)
        self.faults[fault] += 1
        if self.last is None:
            self.first = initial_
        else:
            self.illegal += self.last + initial_ not in LEGAL
        self.last = initial_
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.turn
            self.turn = turn

    def row(self) -> dict:
        faults = {k: v for k, v in self.faults.items() if k}
        return {
            "conv_id": self.conv, "part": self.place[0], "seq": self.place[1], "open": self.open, "signature": "".join(self.symbols), "roles": self.roles, "d1": self.d1, "d2": self.d2, **faults,
            "illegal": self.illegal, "first_initial": self.first, "last_initial": self.last, "least_turn": self.least, "last_turn": self.turn, "turns": self.turns,
        }


def _pieces(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, piece, done = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            for conv, turn, role, d1, d2, fault, initial_, symbol in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "d1", "d2", "fault", "initial", "symbol")), strict=True):
                if piece is None or piece.conv != conv or len(piece.symbols) == PIECE:
                    # the first and last conversation of a task may go on in its neighbours
                    cut = piece is not None and piece.conv == conv
                    if piece is not None:
                        piece.open |= cut
                        done.append(piece.row())
                    piece, seq = _Piece(conv, part, seq, piece is None or cut), seq + 1
                piece.add(turn, role, d1, d2, fault, initial_, symbol)
            if sum(len(p["signature"]) for p in done) > 20_000:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if piece is not None:
            piece.open = True
            done.append(piece.row())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return run


def _node(symbol: str, after: tuple) -> tuple:
    """((cost, first edit) per state) of a suffix that begins with `symbol`, from that of the rest."""
    base = []
    for s in range(4):
        options = [(4 + after[s][0], "D")]
        if symbol != "x":
            extra = 3 if symbol.isupper() else 0
            kept = KEPT[s].get(symbol.lower())
            if kept is not None:
                options.append((extra + after[kept][0], "K"))
            options.append((3 + extra + after[NEXT[s]][0], "R"))
        base.append(min(options))
    return _closed(base)


def _closed(base: list) -> tuple:
    """Each state may first insert rows."""
    user = min(base[2], (3 + base[3][0], "I"))
    assistant = min(base[3], (3 + base[2][0], "I"))
    return (min(base[0], (3 + user[0], "I")), min(base[1], (3 + user[0], "I")), user, assistant)


def _walk(nodes: list, signature: str, state: int) -> tuple[str, int]:
    """The best edits from `state` along the nodes (the last one is the whole string), and the state they end in."""
    edits, depth = [], len(signature)
    while edit := nodes[depth][state][1]:
        edits.append(edit)
        if edit == "K":
            state = KEPT[state][signature[len(signature) - depth].lower()]
        elif edit != "D":
            state = NEXT[state]
        depth -= edit != "I"
    return "".join(edits), state


_SOLVED = "signature string, t0 bigint, t1 bigint, t2 bigint, t3 bigint, costs array<bigint>, audits array<string>, ends array<int>"


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings in the order of their ends: the stack holds the nodes of the current string's suffixes, shortest first."""
    before, end, nodes = "", None, []
    for batch in batches:
        costs, audits, ends = [], [], []
        for signature, *t in zip(*(batch.column(c).to_pylist() for c in ("signature", *_ENDS)), strict=True):
            if t != end:
                nodes, before, end = [_closed([(c, "") for c in t])], "", t
            shared = 0
            for x, y in zip(reversed(before), reversed(signature), strict=False):
                if x != y:
                    break
                shared += 1
            del nodes[shared + 1 :]
            for symbol in reversed(signature[: len(signature) - shared]):
                nodes.append(_node(symbol, nodes[-1]))
            before = signature
            costs.append([c for c, _ in nodes[-1]])
            walked = [_walk(nodes, signature, s) for s in range(4)]
            audits.append([w[0] for w in walked])
            ends.append([w[1] for w in walked])
        new = [pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([*batch.select(["signature", *_ENDS]).columns, *new], ["signature", *_ENDS, "costs", "audits", "ends"])


def solve(signatures: DataFrame) -> DataFrame:
    """Distinct (signature, t0..t3: cost that follows in each state) -> costs, audits and last states, each per first state."""
    ordered = signatures.distinct().withColumn("back", F.reverse("signature"))
    order = [*_ENDS, "back"]
    return ordered.repartitionByRange(*order).sortWithinPartitions(*order).select("signature", *_ENDS).mapInArrow(_solved, _SOLVED)


def _sorted_pieces(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.sort_values(["part", "seq"], kind="stable")


def _ends_of(frame: pd.DataFrame) -> pd.DataFrame:
    """From the last piece to the first: what follows each piece costs in each state."""
    frame = _sorted_pieces(frame)
    after, ends, taken = list(ACCEPT), [], 0
    for matrix in reversed(frame["matrix"].tolist()):
        ends.append(after)
        after = [min(FAR, *(matrix[4 * j + s] + after[j] for j in range(4))) for s in range(4)]
        # only differences count for the edits; without the common part, equal pieces mostly have equal ends
        taken += min(after)
        after = [x - min(after) for x in after]
    out = frame[["conv_id", "part", "seq", "signature"]].copy()
    for i, name in enumerate(_ENDS):
        out[name] = [e[i] for e in reversed(ends)]
    out["total"] = [taken + after[0], *[0] * (len(out) - 1)]
    return out


def _starts_of(frame: pd.DataFrame) -> pd.DataFrame:
    """From the first piece to the last: the state each piece begins in."""
    frame = _sorted_pieces(frame)
    state, starts = 0, []
    for ends in frame["ends"].tolist():
        starts.append(state)
        state = int(ends[state])
    out = frame[["conv_id", "part", "seq"]].copy()
    out["start"] = starts
    return out


def _audited(pieces: DataFrame) -> DataFrame:
    """Adds to each piece the state it begins in (start), its audit and a cost; the costs of a conversation's pieces add up to its own."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    accept = [F.lit(x).cast("long").alias(c) for x, c in zip(ACCEPT, _ENDS, strict=True)]
    whole = pieces.filter("not open").select("conv_id", "part", "seq", "signature", *accept, F.lit(None).cast("long").alias("total"))

    # pieces that may be parts: costs from each state to each state, composed from the end
    parts = pieces.filter("open").select("conv_id", "part", "seq", "signature")
    unit = F.explode(F.array(*[F.struct(*[F.lit(0 if i == j else FAR).cast("long").alias(c) for i, c in enumerate(_ENDS)]) for j in range(4)]))
    units = solve(parts.select("signature", unit.alias("t")).select("signature", "t.*"))
    j = sum((F.when(F.col(c) == 0, i).otherwise(0) for i, c in enumerate(_ENDS)), F.lit(0))
    matrices = units.groupBy("signature").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(j.alias("j"), "costs"))), lambda x: x["costs"])).alias("matrix"))
    ended = parts.join(matrices, "signature").groupBy("conv_id").applyInPandas(_ends_of, f"conv_id {kind}, part int, seq int, signature string, t0 bigint, t1 bigint, t2 bigint, t3 bigint, total bigint")
    ended = written(ended, "piece-ends")

    found = written(solve(whole.unionByName(ended).select("signature", *_ENDS)), "solved")
    starts = ended.join(found, ["signature", *_ENDS]).select("conv_id", "part", "seq", "ends").groupBy("conv_id").applyInPandas(_starts_of, f"conv_id {kind}, part int, seq int, start int")
    asked = whole.withColumn("start", F.lit(0)).unionByName(ended.join(starts.drop("conv_id"), ["part", "seq"]).select("conv_id", "part", "seq", "signature", *_ENDS, "total", "start"))
    at = lambda c: F.element_at(c, F.col("start") + 1)
    # the first of several pieces has the cost of all
    audits = asked.join(found, ["signature", *_ENDS]).select("part", "seq", "start", at("audits").alias("audit"), F.coalesce("total", at("costs")).alias("cost"))
    return pieces.join(audits, ["part", "seq"])


_EDIT = "part int, seq int, at int, edit string, role string, d1 bigint, d2 bigint"


def _edits(schema: pa.Schema):
    """One row for each turn that stays or is inserted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                state, i = row["start"], 0
                for at, edit in enumerate(row["audit"]):
                    turn = {"conv_id": row["conv_id"], "part": row["part"], "seq": row["seq"], "at": at, "edit": edit}
                    if edit == "I":
                        state = NEXT[state]
                        out.append(turn | {"role": "assistant" if state == 3 else "user"})
                        continue
                    if edit != "D":
                        state = KEPT[state][row["roles"][i][:1]] if edit == "K" else NEXT[state]
                        out.append(turn | {"role": row["roles"][i] if edit == "K" else "assistant" if state == 3 else "user", "d1": row["d1"][i], "d2": row["d2"][i]})
                    i += 1
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _arrow(ddl: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def analysed(conversations: DataFrame) -> DataFrame:
    """The pieces of all conversations with their signatures, counts and audits, in the shared folder."""
    spark = conversations.sparkSession
    symbols = _symbols(_rows(conversations))
    ddl = f"conv_id {symbols.schema['conv_id'].dataType.simpleString()}, {_PIECE}"
    order = ["conv_id", "turn", "role", *_KEY, "u"]
    pieces = symbols.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces(_arrow(ddl, spark)), ddl)
    return written(_audited(written(pieces, "pieces")), "audited")


def repaired_turns(conversations: DataFrame, pieces: DataFrame | None = None) -> DataFrame:
    """conv_id, part, seq, at (order of the turns), edit (K, R or I), role, text: every turn of the repaired conversations."""
    spark = conversations.sparkSession
    pieces = analysed(conversations) if pieces is None else pieces
    ddl = f"conv_id {pieces.schema['conv_id'].dataType.simpleString()}, {_EDIT}"
    edits = pieces.select("conv_id", "part", "seq", "start", "audit", "roles", *_KEY).mapInArrow(_edits(_arrow(ddl, spark)), ddl)
    place = ["conv_id", "part", "seq", "at", "edit", "role"]
    # a kept row is the first of its role and text in the conversation, so one text of the digest is enough
    texts = _rows(conversations).groupBy(F.col("conv_id").alias("c"), F.col("d1").alias("c1"), F.col("d2").alias("c2")).agg(F.first("text").alias("text"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2"))
    kept = edits.filter("edit <> 'I'").join(texts, same).select(*place, "text")
    return kept.unionByName(edits.filter("edit = 'I'").select(*place, F.lit("").alias("text")))


def reports(conversations: DataFrame, pieces: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation that has rows."""
    pieces = analysed(conversations) if pieces is None else pieces
    part = F.struct("part", "seq", "first_initial", "last_initial", "least_turn", "last_turn", "audit")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns", "cost")]
    per = pieces.groupBy("conv_id").agg(*sums, F.min("least_turn").alias("least"), F.max("last_turn").alias("most"), F.array_sort(F.collect_list(part)).alias("parts"))
    borders = lambda test: F.size(F.filter(F.sequence(F.lit(1), F.size("parts")), lambda i: (i < F.size("parts")) & test(F.col("parts")[i - 1], F.col("parts")[i])))
    shared = borders(lambda x, y: F.coalesce(x["last_turn"] == y["least_turn"], F.lit(False)))
    illegal = borders(lambda x, y: ~F.concat(x["last_initial"], y["first_initial"]).isin(*sorted(LEGAL)))
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - (F.col("turns") - shared), F.lit(0))
    return per.select("conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + illegal).alias("illegal"), "cost", F.array_join(F.transform("parts", lambda p: p["audit"]), "").alias("audit"))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the damage of the query: a fifth code drops, empties, cuts, repeats or changes a row."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20
    rows = conversations.select("conv_id", "turn", space("role"), space("text"), code.alias("code")).filter("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op12(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = damaged(conversations)
    pieces = analysed(rows)
    line = F.concat("role", F.lit(":"), "text").alias("line")
    lines = repaired_turns(rows, pieces).groupBy(F.col("conv_id").alias("c")).agg(F.array_sort(F.collect_list(F.struct("part", "seq", "at", line))).alias("lines"))
    lines = lines.select("c", F.sha2(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), 256).alias("repaired_sha256"))
    found = reports(rows, pieces).withColumnRenamed("conv_id", "r")
    out = conversations.select("conv_id").distinct()
    out = out.join(found, F.col("conv_id").eqNullSafe(F.col("r")), "left").join(lines, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    none = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return out.select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), none)


def _op12_sql() -> str:
    """The cheapest audits by recursion from the last row to the first; a value is twelve digits of cost, then the audit, so the least text is the answer."""
    grown = lambda v, cost, edit: f"lpad((substr({v}, 1, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || '{edit}' || substr({v}, 13)"
    closed = lambda v, rest: f"least({v}, {grown(rest, 3, 'I')})"
    base = []
    for s in range(4):
        keep = " ".join(f"WHEN k = '{k}' THEN {grown(f'v{to}', 'late', 'K')}" for k, to in KEPT[s].items())
        base.append(f"least({grown(f'v{s}', 4, 'D')}, CASE {keep} END, CASE WHEN k <> 'x' THEN {grown(f'v{NEXT[s]}', 'late + 3', 'R')} END) AS b{s}")
    zero = "'000000000000'"
    return rf"""
WITH RECURSIVE coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
             lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 20 AS code
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded WHERE code <> 0
), numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
         CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS first
  FROM numbered
), turns AS MATERIALIZED (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' ELSE first END AS k, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS late FROM judged),
back AS (
  SELECT conv_id, max(i) + 1 AS i, {zero} AS v0, '000000000006II' AS v1, '000000000003I' AS v2, {zero} AS v3 FROM turns GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, {closed("b0", "u")} AS v0, {closed("b1", "u")} AS v1, u AS v2, a AS v3 FROM (
    SELECT *, {closed("b2", "b3")} AS u, {closed("b3", "b2")} AS a FROM (
      SELECT t.conv_id, t.i, {", ".join(base)} FROM back JOIN turns t ON t.conv_id = back.conv_id AND t.i = back.i - 1))
), audits AS MATERIALIZED (SELECT conv_id, substr(v0, 1, 12)::BIGINT AS cost, substr(v0, 13) AS audit FROM back WHERE i = 1),
walk AS (
  SELECT conv_id, audit, 0 AS n, 1::BIGINT AS i, 0 AS state, NULL::VARCHAR AS line FROM audits
  UNION ALL
  SELECT w.conv_id, w.audit, w.n + 1, CASE WHEN e = 'I' THEN w.i ELSE w.i + 1 END,
         CASE WHEN e = 'D' THEN state WHEN e = 'K' THEN CASE t.first WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END WHEN state = 2 THEN 3 ELSE 2 END,
         CASE WHEN e <> 'D' THEN CASE WHEN e = 'K' THEN t.role WHEN state = 2 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN e = 'I' THEN '' ELSE t.text END END
  FROM (SELECT *, substr(audit, n + 1, 1) AS e FROM walk WHERE n < length(audit)) w LEFT JOIN turns t ON t.conv_id = w.conv_id AND t.i = w.i
), lines AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY n) AS lines FROM walk GROUP BY conv_id),
pairs AS (SELECT conv_id, turn, fault, first || lead(first) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM turns),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM pairs GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts USING (conv_id) LEFT JOIN audits USING (conv_id) LEFT JOIN lines USING (conv_id)
"""


OP12_SQL = _op12_sql()
