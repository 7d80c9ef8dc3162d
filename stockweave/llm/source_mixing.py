"""Mixing sources to target weights by pivotal dependent rounding, reduced through a distributed tree.

Each source gets a target in words by its weight, never over `max_repeat` times its size (the excess is shared again by weight). A document of a source is taken target / size times in expectation: a whole number of copies plus a fraction. Fractions are rounded in pairs: mass moves from one document of a pair to the other, in words, until one fraction is 0 or 1; the other goes on to the next pair. The moves are random with the odds that keep every expectation, and they keep the words of the pair, so a source misses its target by less than one document.

The tree: documents of a source fall into blocks of about `block` rows by hash; a block is folded in order and leaves at most one open fraction, which enters the next level. Levels are as many as the largest source needs. A block's array has a bounded size, so a source with a third of all rows is only more blocks. Identical rows (same id, source and text) are counted first and numbered, so a repeated row is spread over blocks as well. All randomness comes from hashes of (seed, level, row, number): reruns agree.

Null text has size 0; size 0 takes nothing. A null source is a source of its own, last in order. A null id is an id like any other. Everything is DataFrame functions; only one count per level comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import let, own_columns, words
from .stage import written

#: o orders a block: large documents first, so that the one left open at the end tends to be small.
_ITEM = "struct<o:bigint,r:double,k1:bigint,k2:bigint,id:bigint,no:bigint,size:bigint,base:bigint,p:double>"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: float = 3.0) -> DataFrame:
    """(source, source_size) -> one row per source with target and rate, as DataFrame work on the source table (a row per source).

    Sources fill their caps in the order of cap / weight; those up to a point are full and the rest share what is left by weight, so one ordered pass finds the point. The ordered pass runs over as many rows as there are sources.
    """
    total = F.sum("source_size").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    out = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")).withColumn("total", total.cast("double"))
    out = out.withColumn("cap", max_repeat * F.col("source_size"))
    order = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("level", (F.col("total") - before) / rest)
    # the first source whose fair share stays within its cap sets the level for itself and all after it
    level = F.first(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    target = F.coalesce(level * F.col("weight"), F.col("cap"))
    out = out.withColumn("target", F.least(target, F.col("cap")))
    return out.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))


def _unit(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11).cast("double")) / F.lit(float(1 << 53))


def _fold(items: Column, seed: int, level: int) -> Column:
    """Rounds a block in order: {done: items with whole fractions, open: the item still open, if any}."""

    def step(state: Column, x: Column) -> Column:
        a = state["open"]
        up = F.least(1 - a["p"], x["p"] * x["size"] / a["size"])  # how far a may rise, x falling
        down = F.least(a["p"], (1 - x["p"]) * x["size"] / a["size"])
        draw = _unit(seed + 7919 * (level + 1), a["k1"], a["no"], x["k1"], x["no"])

        def moved(rise: Column) -> Column:
            # which of the two becomes whole; whole values are set, not computed
            a_whole = F.when(rise, (1 - a["p"]) * a["size"] <= x["p"] * x["size"]).otherwise(a["p"] * a["size"] <= (1 - x["p"]) * x["size"])
            pa = F.when(a_whole, F.when(rise, 1.0).otherwise(0.0)).otherwise(a["p"] + F.when(rise, up).otherwise(-down))
            px = F.when(~a_whole, F.when(rise, 0.0).otherwise(1.0)).otherwise(x["p"] - F.when(rise, up).otherwise(-down) * a["size"] / x["size"])
            return let(F.struct(pa.alias("a"), px.alias("x"), a_whole.alias("w")), pair)

        def pair(m: Column) -> Column:
            item = lambda s, p: F.struct(*[s[c].alias(c) for c in ("o", "r", "k1", "k2", "id", "no", "size", "base")], p.alias("p"))
            na, nx = item(a, m["a"]), item(x, m["x"])
            whole, other = F.when(m["w"], na).otherwise(nx), F.when(m["w"], nx).otherwise(na)
            both = F.when(m["w"], (m["x"] <= 0) | (m["x"] >= 1)).otherwise((m["a"] <= 0) | (m["a"] >= 1))
            done = F.when(both, F.concat(state["done"], F.array(whole, other))).otherwise(F.concat(state["done"], F.array(whole)))
            return F.struct(done.alias("done"), F.when(~both, other).alias("open"))

        paired = let(draw * (up + down) < down, moved)
        return F.when(a.isNull(), F.struct(state["done"].alias("done"), x.alias("open"))).otherwise(paired)

    return F.aggregate(items, F.struct(F.array().cast(f"array<{_ITEM}>").alias("done"), F.lit(None).cast(_ITEM).alias("open")), step)


def identity(*columns: str) -> list[Column]:
    """Two hashes that tell rows apart by the columns (id, source and text by default); never null. A null is marked, so that it is no blank and moves no value to another column."""
    marked = [c for name in columns or ("doc_id", "source", "text") for c in (F.col(f"`{name}`").isNull(), F.col(f"`{name}`"))]
    return [F.xxhash64(*marked).alias("k1"), F.xxhash64(F.lit(1), *marked).alias("k2")]


def mix(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: float = 3.0, block: int = 200, seed: int = 17) -> DataFrame:
    """(k1, k2, doc_id, source, size) -> one row for each row: these and source_size, target, copies, taken."""
    same = ["k1", "k2", "doc_id", "source", "size"]
    rows = written(rows.groupBy(*same).agg(F.count("*").alias("m")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).cast("long").alias("source_size"))
    keyed = written(targets(sizes, weights, max_repeat), "mix-sources").withColumnRenamed("source", "key")
    units = rows.withColumn("no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    units = units.join(keyed.select("key", "rate"), units.source.eqNullSafe(keyed.key), "left")
    base = F.floor("rate").cast("long")
    p = F.when(F.col("size") > 0, F.col("rate") - base).otherwise(0.0)
    item = F.struct((-F.col("size")).alias("o"), _unit(seed, F.col("k1"), F.col("k2"), F.col("no")).alias("r"), F.col("k1"), F.col("k2"), F.col("doc_id").alias("id"), F.col("no"), F.col("size"), base.alias("base"), p.alias("p"))
    units = units.select("source", item.cast(_ITEM).alias("x"))
    parts, level = [units.filter("x.p <= 0 or x.p >= 1")], 0
    left = units.filter("x.p > 0 and x.p < 1")
    while True:
        counts = left.groupBy("source").agg(F.count("*").alias("n"))
        biggest = counts.agg(F.max("n")).first()[0] or 0
        # as many blocks for a source as its open rows need; the hash spreads rows over them
        counts = counts.select(F.col("source").alias("key"), F.ceil(F.col("n") / block).alias("blocks"))
        place = F.floor(_unit(seed + level + 1, F.col("x.k1"), F.col("x.k2"), F.col("x.no")) * F.col("blocks"))
        dealt = left.join(counts, left.source.eqNullSafe(counts.key)).select("source", "x", place.alias("b"))
        folded = dealt.groupBy("source", "b").agg(_fold(F.array_sort(F.collect_list("x")), seed, level).alias("f"))
        folded = written(folded.select("source", "f.done", "f.open"), f"mix-{level}")
        parts.append(folded.select("source", F.explode("done").alias("x")))
        left = folded.filter("open is not null").select("source", F.col("open").alias("x"))
        level += 1
        if biggest <= block:  # one block for each source: what is open now is one document, rounded by its own odds
            chance = _unit(seed + 104729, F.col("x.k1"), F.col("x.k2"), F.col("x.no")) < F.col("x.p")
            parts.append(left.select("source", F.col("x").withField("p", F.when(chance, 1.0).otherwise(0.0)).alias("x")))
            break
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = out.select("source", "x.k1", "x.k2", F.col("x.id").alias("doc_id"), "x.size", (F.col("x.base") + F.col("x.p").cast("long")).alias("copies"))
    out = out.join(keyed.select("key", "source_size", "target"), out.source.eqNullSafe(keyed.key), "left")
    return out.select("k1", "k2", "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def size_in_words() -> Column:
    return F.size(words(F.col("text"))).cast("long")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with all their columns and _mix_copies, _mix_size, _mix_taken, _mix_source_size and _mix_target. Rows that agree in every column come back once, with the copies of all of them; rows that differ anywhere stay apart."""
    own = identity(*[f.name for f in docs.schema if f.dataType.typeName() not in ("map", "variant")])
    rows = docs.select(*own, "doc_id", "source", size_in_words().alias("size"))
    chosen = mix(rows, **options).filter("copies > 0").groupBy("k1", "k2").agg(F.sum("copies").alias("_mix_copies"), F.max("size").alias("_mix_size"), F.sum("taken").alias("_mix_taken"), F.max("source_size").alias("_mix_source_size"), F.max("target").alias("_mix_target"))
    keyed = docs.select(*own_columns(docs.columns), *[k.alias(f"_mix_{n}") for k, n in zip(own, ("k1", "k2"), strict=True)])
    chosen = chosen.withColumnsRenamed({"k1": "_mix_k1", "k2": "_mix_k2"})
    out = keyed.dropDuplicates(["_mix_k1", "_mix_k2"]).join(chosen, ["_mix_k1", "_mix_k2"])
    return out.select(*own_columns(docs.columns), "_mix_copies", "_mix_size", "_mix_taken", "_mix_source_size", "_mix_target")


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix(docs.select(*identity(), "doc_id", "source", size_in_words().alias("size")))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
