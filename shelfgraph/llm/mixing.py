r"""Mixing sources to target weights by Pareto order sampling.

A source's target of words is its weighted share of the total, cut at MOST_COPIES times its size, the excess
going to the others by weight until none is above. Each document of a source first gets floor(target / size)
certain copies. What is left of the target is met by whole documents whose inclusion probabilities f differ: inside a
source they fall with the TEMPER power of a document's size (by powers of two), so that a few long documents don't
decide where a source ends, and they are scaled, at most 1, so that the expected words are what is left.

The sample is Pareto's (Rosen, 1997): all documents of all sources are ranked together by random odds over inclusion
odds, (u / (1 - u)) / (f / (1 - f)), and the round(sum of f) least are taken, a fixed number. Then each source is
corrected: the documents next to the cut in rank, behind it if words lack, before it if they are too many, change sides
as long as they fit the gap; this repeats among those behind the first that does not fit until the gap is below
CLOSE of the target or none fits. One more document, the one whose size is nearest to the gap, changes sides if that
comes nearer to the target. u is a hash of id and text: reruns agree.

Cuts in the ranking are found by sums over 4,096 intervals of the rank, then over 4,096 intervals of the one
that holds the cut, then over the rows of one of those, so no task orders a source, however large. What is known of a
source is one row, sent to all tasks if there are at most MOST_SENT rows, else joined on source and a salt.

Defined results: a null text has size 0; documents without words are never sampled; a source without words has target 0
and takes none; null sources are one source, the last; repeated rows (same id and text) are ranked side by side; an
empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfgraph.llm.shared import fresh
from shelfgraph.session import dropped, written

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
TEMPER = 0.25
CLOSE = 0.002
CELLS = 4096
MOST_SENT = 100_000  # rows of under 200 bytes, one a source and size class
SALTS = 64
KEY = ("doc_id", "tie")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """From (source, source_size): source, source_size, target. One row a source: the windows run over sources, not documents."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    every = Window.partitionBy()
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double"))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    # sources that reach their cap first come first
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    w = w.withColumn("level", level).withColumn("open", F.col("cap") > F.col("weight") * F.col("level"))
    # the level at the first source below its cap holds for all those behind it
    c = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(every)["level"]
    return w.select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * c, F.col("cap"))).alias("target"))


def inclusion(classes: DataFrame) -> DataFrame:
    """From (source, class, words, rest): f, each class's inclusion probability. f * words adds up to rest over a source's classes."""
    g = F.pow(F.lit(2.0), -F.lit(TEMPER) * F.col("class"))
    w = classes.withColumn("g", g).withColumn("gw", F.col("g") * F.col("words"))
    # shorter classes reach 1 first
    order = Window.partitionBy("source").orderBy("class")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = F.greatest(F.lit(0.0), F.col("rest") - F.coalesce(F.sum("words").over(before), F.lit(0))) / F.sum("gw").over(after)
    w = w.withColumn("level", level).withColumn("open", F.col("g") * F.col("level") < 1)
    c = F.min(F.when(F.col("open"), F.struct("class", "level"))).over(Window.partitionBy("source"))["level"]
    return w.select("source", "class", F.when(F.col("rest") <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("g") * F.coalesce(c, F.lit(1e300)))).alias("f"))


def pareto_rank(u: Column, f: Column) -> Column:
    """Random odds over inclusion odds as a number between 0 and 1, increasing with them."""
    f = F.least(F.lit(1 - 1e-12), f)
    odds = (u / (1 - u)) / (f / (1 - f))
    return odds / (1 + odds)


def _send(rows: DataFrame, table: DataFrame, few: bool, on: str = "source") -> DataFrame:
    """rows with the one row of table that has their source (and class): sent to all tasks, or met by salted keys."""
    keys = [c.strip() for c in on.split(",")]
    t = table.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    if few:
        return rows.join(F.broadcast(t), same, "left").drop(*[f"__{k}" for k in keys])
    t = t.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("__own", F.pmod(F.xxhash64(*KEY), F.lit(SALTS)).cast("int"))
    return salted.join(t, same & (F.col("__own") == F.col("__salt")), "left").drop("__own", "__salt", *[f"__{k}" for k in keys])


def _cut(pool: DataFrame, value: str, amount: str, budget: DataFrame, few: bool) -> DataFrame:
    """(source, stop, filled): the first row in the order of value (0 to 1) and KEY at which the sum of amount passes the source's budget, and the sum before it; no row where all fit."""
    at = pool.withColumn("cell", F.least(F.floor(F.col(value) * CELLS), F.lit(CELLS - 1)))
    at = at.withColumn("fine", F.least(F.floor((F.col(value) * CELLS - F.col("cell")) * CELLS), F.lit(CELLS - 1)))

    def passed(frame: DataFrame, by: str, known: DataFrame) -> DataFrame:
        """The first interval at whose end the sum passes the budget, and the sum before it, beside what is known of a source."""
        sums = _send(frame.groupBy("source", by).agg(F.sum(amount).alias("n")).withColumns({k: F.lit(0) for k in KEY}), known, few)
        end = F.col("gone") + F.sum("n").over(Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
        past = sums.withColumn("end", end).where("end > budget").groupBy("source").agg(F.min(F.struct(F.col(by), (F.col("end") - F.col("n")).alias("gone"), "budget")).alias("x"))
        return past.select("source", F.col("x")[by].alias(f"{by}_cut"), F.col("x.gone").alias("gone"), F.col("x.budget").alias("budget"))

    coarse = written(passed(at, "cell", budget.withColumn("gone", F.lit(0).cast(pool.schema[amount].dataType))), "mix-cut")
    inside = _send(at, coarse, few).where("cell = cell_cut").drop("gone", "budget")
    fine = written(passed(inside, "fine", coarse.drop("cell_cut")).join(coarse.select(F.col("source").alias("s"), "cell_cut"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-cut")
    last = _send(at, fine, few).where("cell = cell_cut AND fine = fine_cut")
    end = F.col("gone") + F.sum(amount).over(Window.partitionBy("source").orderBy(value, *KEY).rowsBetween(Window.unboundedPreceding, 0))
    ends = last.withColumn("end", end).where("end > budget")
    return ends.groupBy("source").agg(F.min(F.struct(value, *KEY, (F.col("end") - F.col(amount)).alias("filled"))).alias("x")).select("source", F.struct(F.col(f"x.{value}").alias("v"), *[f"x.{k}" for k in KEY]).alias("stop"), F.col("x.filled").alias("filled"))


def pareto_sample(ranked: DataFrame) -> DataFrame:
    """ranked (doc_id, tie, f, rank, ...) with taken: the round(sum of f) rows of least rank with f > 0, whatever their source."""
    whole = ranked.where("f > 0").select(F.lit(None).cast("string").alias("source"), *KEY, "rank", "f", F.lit(1).cast("long").alias("one"))
    budget = whole.agg(F.coalesce(F.round(F.sum("f")), F.lit(0)).cast("long").alias("budget")).select(F.lit(None).cast("string").alias("source"), "budget")
    # one row
    stop = written(_cut(whole, "rank", "one", budget, True).select("stop"), "mix-stop")
    return ranked.join(F.broadcast(stop), F.lit(True), "left").withColumn("taken", (F.col("f") > 0) & F.coalesce(F.struct(F.col("rank").alias("v"), *KEY) < F.col("stop"), F.lit(True))).drop("stop")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES, seed: int = 42, doc_id: str = "doc_id", text: str = "text", source: str = "source", rank: Column | None = None) -> DataFrame:
    """doc_id, tie (hash of the text), source, size, source_size, target, f, copies for each row. rank: another order of (u, f), for tests."""
    tie = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), tie.alias("tie"), F.col(source).alias("source"), size.alias("size"))
    sizes = written(rows.withColumn("class", F.when(F.col("size") > 0, F.floor(F.log2("size")))), "mix-sizes")
    targets = source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("whole", F.floor(ratio)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = written(targets, "mix-targets")

    classes = sizes.where("size > 0").groupBy("source", "class").agg(F.sum("size").alias("words"))
    classes = classes.join(targets.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    chances = written(inclusion(classes), "mix-classes")
    few = chances.count() <= MOST_SENT
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "tie"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    placed = _send(sizes, chances, few, "source, class").withColumn("f", F.coalesce("f", F.lit(0.0))).withColumn("u", u)
    placed = placed.withColumn("rank", F.when(F.col("f") > 0, pareto_rank(F.col("u"), F.col("f")) if rank is None else rank).otherwise(1.0))
    placed = written(pareto_sample(placed.select("doc_id", "tie", "source", "size", "f", "rank")), "mix-ranks")
    dropped(sizes, chances)

    # per source: the gap in words, which side changes, and where each round stopped
    words = placed.groupBy("source").agg(F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).alias("words"))
    gap = words.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn("off", F.col("rest") - F.col("words"))
    state = written(gap.select("source", "source_size", "target", "whole", (F.col("off") > 0).alias("add"), F.abs("off").alias("gap"), F.lit(None).cast("struct<v:double,doc_id:bigint,tie:bigint>").alias("stop")), "mix-state")
    changed = F.lit(False)
    step = 0
    while True:
        step += 1
        side = F.col("taken") != F.col("add")
        # documents next to the cut come first: the least ranks to add, the greatest to drop
        rows = _send(placed, state, few).withColumn("v", F.when(F.col("add"), F.col("rank")).otherwise(1 - F.col("rank")))
        fits = side & (F.col("f") > 0) & (F.col("gap") > F.lit(CLOSE) * F.col("target")) & (F.col("size") <= F.col("gap"))
        fits = fits & F.coalesce(F.struct("v", *KEY) > F.col("stop"), F.lit(True)) & ~changed
        pool = rows.where(fits).select("source", *KEY, "v", F.col("size").cast("double").alias("size"))
        total = written(pool.groupBy("source").agg(F.sum("size").alias("all")), "mix-pool")
        if total.isEmpty():
            break
        cut = _cut(pool, "v", "size", state.select("source", F.col("gap").alias("budget")), few)
        known = total.join(cut.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumnRenamed("stop", "next")
        after = state.join(known.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
        state = written(after.select(*[c for c in state.columns if c not in ("gap", "stop")], (F.col("gap") - F.coalesce("filled", "all", F.lit(0.0))).alias("gap"), F.coalesce("next", "stop").alias("stop"),
            F.col("gap").alias(f"gap{step}"), F.col("stop").alias(f"stop{step}"), F.col("next").alias(f"next{step}"), F.col("all").isNotNull().alias(f"open{step}")), "mix-state")
        changed = changed | (F.col(f"open{step}") & (F.col("taken") != F.col("add")) & (F.col("f") > 0) & (F.col("size") <= F.col(f"gap{step}"))
            & F.coalesce(F.struct("v", *KEY) > F.col(f"stop{step}"), F.lit(True)) & F.coalesce(F.struct("v", *KEY) < F.col(f"next{step}"), F.lit(True)))
    rows = rows.withColumn("changed", F.coalesce(changed, F.lit(False)))
    free = ~F.col("changed") & (F.col("taken") != F.col("add")) & (F.col("f") > 0)
    nearest = rows.where(free & (F.abs(F.col("size") - F.col("gap")) < F.col("gap"))).groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "v", *KEY)).alias("x"))
    nearest = nearest.select("source", F.struct("x.v", *[f"x.{k}" for k in KEY]).alias("closing"))
    done = _send(rows, nearest, few)
    turned = F.col("changed") | (free & F.coalesce(F.struct("v", *KEY) == F.col("closing"), F.lit(False)))
    extra = (F.col("taken") != turned).cast("int")
    return done.select("doc_id", "tie", "source", "size", "source_size", "target", "f", (F.col("whole") + extra).cast("int").alias("copies"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """docs' rows, each as often as the mix takes it. Rows without words stay once: they weigh nothing."""
    p = fresh(docs, "__mx_")
    copies = mix(docs, doc_id=doc_id, text=text, source=source, **options)
    copies = copies.groupBy("doc_id", "tie").agg(F.sum("copies").alias(f"{p}copies"), F.count("*").alias(f"{p}rows"), F.max("size").alias(f"{p}size")).withColumnsRenamed({"doc_id": f"{p}id", "tie": f"{p}tie"})
    keyed = docs.withColumn(f"{p}key", F.xxhash64(F.coalesce(F.col(text), F.lit("")))).withColumn(f"{p}source", F.col(source))
    one = Window.partitionBy(doc_id, f"{p}key").orderBy(f"{p}source")
    joined = keyed.join(copies, keyed[doc_id].cast("long").eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}key") == F.col(f"{p}tie")))
    joined = joined.withColumn(f"{p}row", F.row_number().over(one))
    # repeated rows share their copies out evenly
    own = F.expr(f"CASE WHEN {p}size = 0 THEN 1 ELSE CAST(floor(({p}copies + {p}rows - {p}row) / {p}rows) AS INT) END")
    return joined.withColumn(f"{p}n", own).where(f"{p}n > 0").withColumn(f"{p}each", F.explode(F.expr(f"sequence(1, {p}n)"))).select(*docs.columns)
