"""Records of delimited files whose quoted cells may hold line breaks.

A line break ends a record unless it stands inside a quoted cell, and whether
it does depends on everything before it in the file. A line is therefore a
function from the state before it (between records, or inside a cell) to the
state after it; functions of the lines of a split compose to one of the split,
and those of the splits of a file give the state each split begins in. Most
lines have no quote and change nothing.

Two scans and no shuffle of texts: the first gives one row per split, the
second marks the lines. Only the lines of records that go over several lines
are grouped, by file and record number.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LINES = "path string, block bigint, value string"
_SPLIT = "path string, block bigint, end_out boolean, end_in boolean, records_out bigint, records_in bigint"
_MARKED = "path string, block bigint, at bigint, value string, out_before boolean, out_after boolean, out_record bigint, in_before boolean, in_after boolean, in_record bigint"


def _patterns(separator: str) -> tuple[str, str]:
    """Lines that end inside a quoted cell when they begin between records, and when they begin inside a cell."""
    sep = re.escape(separator)
    inside = '(?:[^"]|"")*'
    # after the closing quote anything up to the separator belongs to the cell
    rest = f'(?:[^"{sep}][^{sep}]*)?'
    cell = f'(?:"{inside}"{rest}|[^"{sep}][^{sep}]*)?'
    return f'^(?:{cell}{sep})*"{inside}$', f'^{inside}(?:"{rest}{sep}(?:{cell}{sep})*"{inside})?$'


class _Scan:
    """State along the lines of one split, for both states it may begin in (False: between records)."""

    def __init__(self):
        self.at, self.state, self.records = 0, [False, True], [0, 0]

    def follow(self, n: int, changes: list[tuple[int, bool, bool]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """State before and after and record number of the next n lines; `changes` are those with a quote: place, end when begun outside, end when begun inside."""
        out = []
        for s in (0, 1):
            state, before, last = self.state[s], np.empty(n + 1, bool), 0
            for i, from_out, from_in in changes:
                before[last : i + 1] = state
                state, last = from_in if state else from_out, i + 1
            before[last:] = state
            numbers = self.records[s] + np.cumsum(~before[:-1])
            self.state[s] = state
            self.records[s] = int(numbers[-1]) if n else self.records[s]
            out.append((before[:-1], before[1:], numbers))
        self.at += n
        return out


def _runs(batches: Iterator[pa.RecordBatch], separator: str):
    """Runs of lines of one split in order: path, block, values, changes."""
    outside, inside = _patterns(separator)
    for batch in batches:
        if not batch.num_rows:
            continue
        paths, blocks, values = (batch.column(i) for i in range(3))
        places = pc.indices_nonzero(pc.fill_null(pc.match_substring(values, '"'), False))
        some = values.take(places)
        changes = list(zip(places.to_pylist(), pc.match_substring_regex(some, outside).to_pylist(), pc.match_substring_regex(some, inside).to_pylist(), strict=True))
        names, starts = np.asarray(paths.dictionary_encode().indices), np.asarray(blocks)
        border = np.flatnonzero((names[1:] != names[:-1]) | (starts[1:] != starts[:-1])) + 1
        for begin, end in zip([0, *border.tolist()], [*border.tolist(), len(names)], strict=True):
            lo, hi = bisect_left(changes, (begin,)), bisect_left(changes, (end,))
            yield paths[begin].as_py(), blocks[begin].as_py(), values.slice(begin, end - begin), [(i - begin, x, y) for i, x, y in changes[lo:hi]]


def _splits(separator: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, scan, rows = None, None, []

        def close() -> None:
            if scan is not None:
                rows.append((*key, *scan.state, *scan.records))

        for path, block, values, changes in _runs(batches, separator):
            if (path, block) != key:
                close()
                key, scan = (path, block), _Scan()
            scan.follow(len(values), changes)
        close()
        names = [c.split()[0] for c in _SPLIT.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return run


def _marked(separator: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, scan = None, None
        names = [c.split()[0] for c in _MARKED.split(", ")]
        for path, block, values, changes in _runs(batches, separator):
            if (path, block) != key:
                key, scan = (path, block), _Scan()
            n, at = len(values), scan.at
            flags = [pa.array(x) for marks in scan.follow(n, changes) for x in marks]
            place = [pa.array([path] * n, pa.string()), pa.array(np.full(n, block)), pa.array(np.arange(at, at + n))]
            yield pa.RecordBatch.from_arrays([*place, values, *flags], names)

    return run


def split_states(splits: DataFrame) -> DataFrame:
    """path, block, inside (the state the split begins in), records (how many begin before it). One row per split, gathered per file."""
    item = F.struct("block", "end_out", "end_in", "records_out", "records_in")
    per_file = splits.groupBy("path").agg(F.array_sort(F.collect_list(item)).alias("splits"))
    empty = F.expr("named_struct('inside', false, 'records', 0L, 'out', cast(array() as array<struct<block: bigint, inside: boolean, records: bigint>>))")

    def step(state, x):
        seen = F.struct(x["block"].alias("block"), state["inside"].alias("inside"), state["records"].alias("records"))
        return F.struct(
            F.when(state["inside"], x["end_in"]).otherwise(x["end_out"]).alias("inside"),
            (state["records"] + F.when(state["inside"], x["records_in"]).otherwise(x["records_out"])).alias("records"),
            F.concat(state["out"], F.array(seen)).alias("out"),
        )

    return per_file.select("path", F.inline(F.aggregate("splits", empty, step, lambda s: s["out"])))


def read_records(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """source_file, record_no (from 1 within the file), value: one row per record, its line breaks kept."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    states = split_states(lines.mapInArrow(_splits(separator), _SPLIT))
    marked = lines.mapInArrow(_marked(separator), _MARKED).join(states, ["path", "block"])
    choose = lambda name: F.when(F.col("inside"), F.col(f"in_{name}")).otherwise(F.col(f"out_{name}")).alias(name)
    placed = marked.select("path", "block", "at", "value", choose("before"), choose("after"), (F.col("records") + choose("record")).alias("record_no"))
    whole = placed.filter("not before and not after").select("path", "record_no", "value")
    parts = placed.filter("before or after").groupBy("path", "record_no").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("lines"))
    joined = parts.select("path", "record_no", F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("value"))
    name = F.element_at(F.split("path", "/"), -1).alias("source_file")
    return whole.unionByName(joined).select(name, "record_no", F.regexp_replace("value", "\r$", "").alias("value"))


def as_text(cells: list, separator: str = ","):
    """One record of a delimited file from text columns; a cell is quoted where it needs to be, NULL is empty."""
    needs = "[\"\r\n" + re.escape(separator) + "]"

    def cell(c):
        return F.coalesce(F.when(c.rlike(needs), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c), F.lit(""))

    return F.concat_ws(separator, *[cell(c) for c in cells])
