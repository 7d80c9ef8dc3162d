"""Quality rules, line first: rules on punctuation, navigation and boilerplate judge each line, failing lines go, and a document that loses too much of its text is rejected.

Rules, each on one \\n-split line that has a word (other lines pass and carry no words):
* punctuation: over `max_noise` of its words carry a run of symbols or of two or more `!` or `?`; or it has `long_line` words or more and none ends a sentence or clause;
* navigation: over `max_separators` of its words are lone separators (`|`, `>`, bullets and the like);
* boilerplate: a licence, rights, cookie or script notice.

Null text is an empty document; it has no words and fails the base. Ties do not arise: every rule reads one row. Repeated rows get equal results, and all other columns stay. Everything is built-in functions on one row: no shuffle, no Python. Values used more than once are bound with `let`, since a lambda would recompute them for each element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import GAP, WORD, let, own_columns, words

BOILERPLATE = r"(?i)all rights reserved|licensed under|released under the|terms of (use|service)|privacy policy|cookie|javascript|lorem ipsum"
NOISE = r"[#*$%&<>^~=_]{2,}|[!?]{2,}"
SEPARATOR = r"(?:^|(?<=[\x20\x09-\x0D]))[|>/»·•←→-]+(?=[\x20\x09-\x0D]|$)"
CLAUSE_END = r"[.!?:;,…。！？)\"'»”](?=[\x20\x09-\x0D]|$)"
#: A text with fewer repeated windows than this is searched value by value, others by sorting; both give the same count.
_FEW = 16


def _spread(places: Column) -> Column:
    """Words covered by 3-word windows at these ascending places."""
    gaps = F.zip_with(F.slice(places, F.lit(2), F.greatest(F.size(places) - 1, F.lit(0))), F.slice(places, F.lit(1), F.greatest(F.size(places) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
    return F.when(F.size(places) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda total, x: total + x))


def repeated_words(w: Column) -> Column:
    """Words in 3-word windows found twice or more in the text, the first included. Windows are compared by 64-bit hash."""

    def by_sorting(h: Column) -> Column:
        def repeated(pairs: Column) -> Column:
            twice = F.filter(pairs, lambda p, i: (p["h"] == F.get(pairs, i - 1)["h"]) | (p["h"] == F.get(pairs, i + 1)["h"]))
            return F.array_sort(F.transform(twice, lambda p: p["i"]))

        return let(let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), repeated), _spread)

    def count(h: Column) -> Column:
        def by_value(twice: Column) -> Column:
            places = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i)), lambda i: i.isNotNull())
            return F.when(F.size(twice) <= _FEW, let(places, _spread)).otherwise(by_sorting(h))

        twice = let(F.array_sort(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(twice, by_value))

    windows = let(w, lambda v: F.transform(F.slice(v, F.lit(1), F.greatest(F.size(v) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(v, i + 1), F.get(v, i + 2))))
    return let(windows, count).cast("long")


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, under these names with `_q_` before them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    # one struct in one projection: the words are split once
    counts = let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    dup_lines = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    symbols = F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long")
    out = docs.select(*own_columns(docs.columns), counts.alias("_q"), symbols.alias("_q_n_symbols"), dup_lines.alias("_q_n_dup_lines"))
    failed = (F.col("_q.n_words") < 50) | (100 * F.col("_q.n_repeat_words") > 50 * F.col("_q.n_words"))
    named = [F.col(f"_q.{c}").alias(f"_q_{c}") for c in ("n_words", "word_chars", "n_repeat_words")]
    return out.select(*own_columns(docs.columns), *named, F.col("_q_n_symbols"), F.col("_q_n_dup_lines"), failed.alias("_q_base_failed"))


def kept_lines(text: Column, max_noise: float = 0.2, max_separators: float = 0.2, long_line: int = 40) -> Column:
    """Struct of the text without failing lines, the words it had and the words it keeps."""

    def judged(line: Column) -> Column:
        def rules(n: Column) -> Column:
            noisy = line.rlike(NOISE) & (F.regexp_count(line, F.lit(NOISE)) > max_noise * n)
            endless = (n >= long_line) & ~line.rlike(CLAUSE_END)
            menu = line.rlike(SEPARATOR) & (F.regexp_count(line, F.lit(SEPARATOR)) > max_separators * n)
            return F.struct(line.alias("line"), n.alias("n"), (n == 0) | ~(noisy | endless | menu | line.rlike(BOILERPLATE)))

        return let(F.size(F.filter(F.split(line, GAP), lambda w: w != "")), rules)

    def text_of(lines: Column) -> Column:
        good = F.filter(lines, lambda x: x["col3"])
        count = lambda rows: F.aggregate(rows, F.lit(0).cast("long"), lambda total, x: total + x["n"])
        return let(good, lambda g: F.struct(F.array_join(F.transform(g, lambda x: x["line"]), "\n").alias("text"), count(lines).alias("before"), count(g).alias("after")))

    return let(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), judged), text_of)


def judge(docs: DataFrame, min_kept: float = 0.5, **rules) -> DataFrame:
    """Adds the base counts, _q_text (the text without failing lines), _q_kept_words and _q_kept: the base holds and at least `min_kept` of the words stay."""
    out = base_counts(docs)
    out = out.select(*own_columns(out.columns), kept_lines(F.col("text"), **rules).alias("_q"))
    verdict = ~F.col("_q_base_failed") & (F.col("_q.after") >= min_kept * F.col("_q.before"))
    return out.select(*own_columns(out.columns[:-1]), F.col("_q.text").alias("_q_text"), F.col("_q.after").alias("_q_kept_words"), verdict.alias("_q_kept"))


def clean_documents(docs: DataFrame, min_kept: float = 0.5, **rules) -> DataFrame:
    """The accepted documents, with failing lines taken out of their texts; n_chars follows, all other columns stay."""
    out = judge(docs, min_kept, **rules).filter("_q_kept")
    new = {"text": F.col("_q_text"), "n_chars": F.length("_q_text").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_words")
    return judge(docs).select("doc_id", *[F.col(f"_q_{c}").alias(c) for c in names])


#: The same rules, over the tables; words and lines unnested. The verdict follows the rules of `kept_lines`.
OP2_SQL = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws, string_split(coalesce(text, ''), chr(10)) AS ls,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols FROM documents
), g AS (
  SELECT doc_id, i, g, count(*) OVER (PARTITION BY doc_id, g) AS c
  FROM (SELECT doc_id, i, ws[i:i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w))
), r AS (
  SELECT doc_id, sum(least(3, coalesce(nxt - i, 3))) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM g WHERE c > 1) GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, sum(n) AS before,
         sum(CASE WHEN noise > 0.2 * n OR (n >= 40 AND NOT ends) OR seps > 0.2 * n OR boiler THEN 0 ELSE n END) AS after
  FROM (SELECT doc_id, line, len(regexp_extract_all(line, '{WORD}')) AS n,
               len(regexp_extract_all(line, '[#*$%&<>^~=_]{{2,}}|[!?]{{2,}}')) AS noise,
               len([x for x in regexp_extract_all(line, '{WORD}') if regexp_full_match(x, '[|>/»·•←→-]+')]) AS seps,
               regexp_matches(line, '[.!?:;,…。！？)"''»”]([\x20\x09-\x0D]|$)') AS ends,
               regexp_matches(line, '{BOILERPLATE}') AS boiler
        FROM (SELECT doc_id, unnest(ls) AS line FROM w)) WHERE n > 0 GROUP BY doc_id
)
SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum([length(x) for x in ws]), 0)::BIGINT AS word_chars, n_symbols,
       coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
       len(ws) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(ws) AS base_failed,
       NOT (len(ws) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(ws)) AND coalesce(after, 0) >= 0.5 * coalesce(before, 0) AS kept,
       coalesce(after, 0)::BIGINT AS kept_words
FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)
"""
