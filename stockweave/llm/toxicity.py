"""Toxicity by a weighted finite-state pattern grammar over clauses.

A text is read as lower-case letter runs and clause marks. Transducers run in composition:
* lexicon: a word form or word stem becomes insult or threat with a weight; fixed words become target, negation or report;
* negation: opens a window of three words in which matches count as negated;
* reported speech: from a verb of saying to the end of the clause matches count as reported;
* target: a match with a person named in the same clause counts as targeted.
Their product is one table: (state, class) -> (next state, channel). A clause without a match costs nothing and scores nothing; so no word counts alone: its clause decides the channel its weight goes to.

Insults are learned: word forms and stems (3 to 8 letters) whose document frequency among toxic training rows stands out (log-likelihood ratio). The weights of the channels are learned too, from priors that let negated and reported matches count less and targeted ones more. Training reads at most `max_rows` labelled rows, those with the least hashes; their words are counted by Spark.

Null and empty texts have no match and get the score of a text without any. Rows are scored one by one, so repeated rows agree; null labels are no labels; a doc_id with several labels gives several training rows; a null doc_id is never a label and not held out. Without training rows every score is 0.5's smoothed share and only fixed words match. Inputs of a score: the text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .logistic import fit, sigmoid
from .stage import written
from .words import text_column

# Words of the grammar's own classes.
TARGETS = "you your yours u he she they them him her du dich ihr sie euch tu te toi vous il elle ils usted ustedes ellos ella él".split()
NEGATIONS = "not no never nobody isn aren wasn don doesn nicht kein keine nie ne pas jamais non nunca".split()
REPORTS = "said says say wrote writes reported quoted called calls claims sagte sagt schrieb dit disait écrit dijo dice escribió".split()
THREATS = "kill murder shoot stab hang lynch töten umbringen tuer matar".split()

MATCH, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)
CHANNELS = ("plain", "targeted", "negated", "reported")
PRIOR = np.array([1.0, 1.3, 0.3, 0.5, 0.0])
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")
_WINDOW = 3
_STEMS = range(3, 9)


def machine() -> dict[tuple[int, int, int, int], tuple[tuple[int, int, int], int | None]]:
    """(words of negation left, reported, target seen, class) -> (next state, channel of a match or None)."""
    table = {}
    for left in range(_WINDOW + 1):
        for reported in (0, 1):
            for target in (0, 1):
                for kind in range(6):
                    after = max(left - 1, 0)
                    if kind in (MATCH, THREAT):
                        channel = 2 if left else 3 if reported else 1 if target else 0
                        table[left, reported, target, kind] = ((after, reported, target), channel)
                    else:
                        state = (_WINDOW if kind == NEGATION else after, reported or int(kind == REPORT), target or int(kind == TARGET))
                        table[left, reported, target, kind] = (state, None)
    return table


def features_of(word: str) -> list[str]:
    """The word form, marked, and its stems."""
    return [word + "$", *[word[:k] for k in _STEMS if k <= len(word)]]


class Grammar:
    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.table = machine()
        self.fixed = {w: (kind, 0.0) for kind, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
        self.fixed |= {w: (THREAT, 3.0) for w in THREATS}
        self.seen: dict[str, tuple[int, float]] = {}

    def read(self, word: str) -> tuple[int, float]:
        got = self.seen.get(word)
        if got is None:
            weight = max((self.lexicon[f] for f in features_of(word) if f in self.lexicon), default=0.0)
            got = self.fixed.get(word) or ((MATCH, weight) if weight > 0 else (OTHER, 0.0))
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[word] = got
        return got

    def channels(self, text: str) -> np.ndarray:
        """Weights per channel, and the log of how many clauses match."""
        tokens = _TOKEN.findall(text.lower())
        read = self.read
        hits = [i for i, w in enumerate(tokens) if read(w)[1] > 0]
        out, clauses, done = [0.0] * 4, 0, -1
        for hit in hits:
            if hit <= done:
                continue
            begin, end = hit, hit
            while begin > 0 and tokens[begin - 1][0].isalpha():
                begin -= 1
            while end < len(tokens) and tokens[end][0].isalpha():
                end += 1
            done, clauses = end, clauses + 1
            clause = [read(w) for w in tokens[begin:end]]
            # a target may follow the match in its clause
            state = (0, 0, int(any(kind == TARGET for kind, _ in clause)))
            for kind, weight in clause:
                state, channel = self.table[*state, kind]
                if channel is not None:
                    out[channel] += weight
        return np.array([*[math.log1p(x) for x in out], math.log1p(clauses)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sides = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(text_column(batch), batch.column("toxic").to_pylist(), strict=True):
            own = {f for w in set(re.findall(r"[^\W\d_]+", text.as_py().lower())) for f in features_of(w)}
            sides[toxic].update(own)
        if len(sides[0]) + len(sides[1]) > 500_000:
            yield from _flush(sides)
    yield from _flush(sides)


def _flush(sides: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
    names = list(sides[0].keys() | sides[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sides[1][n] for n in names], pa.int64()), pa.array([sides[0][n] for n in names], pa.int64())], ["feature", "pos", "neg"])
    sides[0].clear()
    sides[1].clear()


def held_out(parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == part, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, least_ratio: float = 25.0) -> tuple[Grammar, np.ndarray]:
    """Grammar and channel weights from (doc_id, toxic) rows that are not held out: at most max_rows of them, different in id or text. The lexicon has every feature of theirs that passes the ratio, so it is bounded by them too."""
    chosen = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(5, 0))
    chosen = chosen.orderBy(F.xxhash64("doc_id", "toxic"), "doc_id").limit(max_rows)
    # at most max_rows ids are sent, and of ids in many rows as many different texts come back
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text", "toxic"])
    rows = written(rows.orderBy(F.xxhash64("doc_id", "text", "toxic"), "doc_id").limit(max_rows).select("text", "toxic"), "toxic-train")
    total = rows.groupBy("toxic").count().collect()
    n = {r[0]: r[1] for r in total}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    counts = rows.mapInArrow(_count, "feature string, pos bigint, neg bigint").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    both = F.col("pos") + F.col("neg")
    share = (n1 + 0.5) / (n1 + n0 + 1)
    xlog = lambda k, p: F.when(k > 0, k * F.log(k / (both * p))).otherwise(0.0)
    ratio = 2 * (xlog(F.col("pos"), share) + xlog(F.col("neg"), 1 - share))
    weight = F.log((F.col("pos") + 0.5) / (n1 + 1) * (n0 + 1) / (F.col("neg") + 0.5))
    found = counts.filter("pos >= 4").select("feature", ratio.alias("g"), weight.alias("w")).filter((F.col("g") >= least_ratio) & (F.col("w") > 1.5))
    grammar = Grammar({r[0]: r[2] for r in found.orderBy(F.desc("g"), "feature").collect()})

    def channels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [grammar.channels(t.as_py()).tolist() for t in text_column(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"])

    data = rows.mapInArrow(channels, "x array<double>, toxic int").collect()  # at most max_rows short rows
    data.sort(key=lambda r: (r[1], r[0]))
    x = np.array([r[0] for r in data]).reshape(-1, 5)
    return grammar, fit(x, np.array([r[1] for r in data], float), ridge=1.0, prior=PRIOR)


def score(docs: DataFrame, grammar: Grammar, weights: np.ndarray) -> DataFrame:
    """(doc_id, text) -> doc_id, score and the channel sums behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([grammar.channels(t.as_py()) for t in text_column(batch)]).reshape(-1, 5)
            columns = [batch.column("doc_id"), pa.array(sigmoid(weights[0] + x @ weights[1:])), *[pa.array(x[:, i]) for i in range(4)]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", *CHANNELS])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, score double, " + ", ".join(f"{c} double" for c in CHANNELS))


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, *learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *CHANNELS)
