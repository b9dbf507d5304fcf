"""Mixing sources to target weights by Pareto order sampling.

A source's target is a number of words. Every document first gets its certain whole copies (the whole part of
its expected copies). The rest is drawn without replacement: each document has an inclusion probability p
and a random number u; documents are ranked by ``(u / (1 - u)) / (p / (1 - p))`` and taken from the smallest until
the words still wanted are reached. One document of a source, of the best fitting size, then fills the gap that is left;
this one alone is not drawn by its odds.

No source is gathered in one task. The cut in a source's ranking is found by zooming: sizes are summed into
``BINS`` bins of the rank, the bin holding the cut is divided again, until few documents are left in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingspark.operators.ranks import running_by_key
from listingspark.plans.shared import Workspace, running_total

from .text import uniform, word_count

BINS = 1024
#: A cut interval is ranked row by row once it has no more rows than this in any source.
FEW = 4096
#: At most so many zooms; only rows with equal random numbers (repeated rows) can be left together then, and are ranked
#: over several partitions.
ZOOMS = 4


def source_key(source: Column) -> Column:
    """A key that joins null with null."""
    return F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source.cast("string")))


def cyclic_weights(ws: Workspace, sources: DataFrame, cycle: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """sources(source, key, source_size) with ``weight``: the cycle by code point of the source, null last."""
    order = sources.withColumn("_null", F.col("source").isNull().cast("int"))
    ranked = running_total(ws, order, ["_null", "source"], None, "_rank")
    at = F.pmod(F.col("_rank"), F.lit(len(cycle)))
    return ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (at + 1).cast("int")).cast("long")).drop("_null", "_rank")


def water_fill(sources: DataFrame, max_copies: int = 3) -> DataFrame:
    """Adds ``target``: all words shared by weight, none above ``max_copies`` times the source, the excess
    reshared among the others by weight. Each round is an aggregate; only sums reach the driver."""
    cap = F.col("source_size") * F.lit(max_copies)
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()
    level, capped = (total.t / total.w if total.w else 0.0), -1
    while True:
        full = cap <= F.lit(float(level)) * F.col("weight")
        r = sources.agg(
            F.count(F.when(full, 1)).alias("n"), F.coalesce(F.sum(F.when(full, cap)), F.lit(0)).alias("c"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("w")
        ).first()
        if r.n == capped or not r.w:
            return sources.withColumn("target", F.when(full, cap.cast("double")).otherwise(F.lit(float(level)) * F.col("weight")))
        level, capped = (total.t - r.c) / r.w, r.n


def mix(docs: DataFrame, *, size: Column | None = None, preference: Column | None = None, cycle: tuple[int, ...] = (5, 2, 1), weights: DataFrame | None = None, max_copies: int = 3, seed: int = 17, rows: bool = False) -> DataFrame:
    """Copies of each document so that sources reach their target share of all words.

    docs: doc_id, source and the columns of ``size`` (default: words of ``text``) and ``preference`` (relative
    chance of a document, default 1). weights: (source, weight) or else the cycle. Returns doc_id, source, size,
    source_size, target, copies, taken = copies * size; one row per input row. With ``rows`` it returns the columns of
    docs and copies (in place of a column of that name), for the rows of one word and one copy or more.

    Null text: size 0, no copies drawn. Null source: a source of its own, last in order. Null preference: 1. Rows of
    equal doc_id are separate documents that share a random number. Empty input: empty result. Other columns of
    docs are ignored, so their names can't clash.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "mix")
    size = word_count(F.col("text")) if size is None else size.cast("long")
    liked = F.lit(1.0) if preference is None else F.greatest(F.coalesce(preference.cast("double"), F.lit(1.0)), F.lit(0.0))
    whole = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc")] if rows else []
    keep_rows, names = rows, [c for c in docs.columns if c != "copies"]
    rows = ws.write(
        docs.select(*whole, docs["doc_id"], F.col("source").cast("string").alias("source"), size.alias("size"), liked.alias("liked"))
        .withColumn("key", source_key(F.col("source")))
        .withColumn("u", uniform(seed, F.col("doc_id")))
        .withColumn("row", F.monotonically_increasing_id()),
        "rows",
    )
    sums = ws.write(rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("liked")).alias("liked_size")), "sources")
    if weights is None:
        sums = cyclic_weights(ws, sums, cycle)
    else:
        own = weights.select(source_key(F.col("source")).alias("key"), F.col("weight")).groupBy("key").agg(F.max("weight").alias("weight"))
        sums = sums.join(own, "key", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    sources = ws.write(water_fill(ws.write(sums, "weighted"), max_copies), "targets")

    # certain whole copies, then the words still wanted
    # a source that is full gives all it may, whatever is preferred
    full = F.col("target") >= F.col("source_size") * F.lit(max_copies)
    expected = F.when(F.col("liked_size") > 0, F.when(full, float(max_copies)).otherwise(F.col("target") * F.col("liked") / F.col("liked_size"))).otherwise(F.lit(0.0))
    expected = F.least(expected, F.lit(float(max_copies)))
    held = rows.join(sources.select("key", "source_size", "target", "liked_size"), "key").withColumn("expected", expected).withColumn("certain", F.floor("expected"))
    wanted = ws.write(
        held.groupBy("key").agg((F.first("target") - F.sum(F.col("certain") * F.col("size"))).alias("wanted")).filter("wanted > 0"),
        "wanted",
    )
    # a document longer than all that is wanted is less likely in proportion
    p = (F.col("expected") - F.col("certain")) * F.least(F.lit(1.0), F.col("wanted") / F.col("size"))
    odds = F.col("u") / (F.lit(1.0) - F.col("u")) * (F.lit(1.0) - F.col("p")) / F.col("p")
    drawn = ws.write(
        held.filter("size > 0").join(wanted, "key").withColumn("p", p).filter("p > 0").select("key", "row", "doc_id", "size", (odds / (F.lit(1.0) + odds)).alias("v")),
        "ranked",
    )
    cut = ws.write(wanted.select("key", F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), F.col("wanted").alias("need")), "cut")
    most = 0
    for _ in range(ZOOMS):
        inside = drawn.join(cut, "key").filter("v >= lo and v < hi")
        bins = inside.withColumn("bin", F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1)))
        sums = bins.groupBy("key", "bin").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.min("v").alias("first"), F.max("v").alias("last"))
        upto = F.sum("words").over(Window.partitionBy("key").orderBy("bin"))
        # the first bin that passes what is needed; its bounds are values of rows, so that rounding can't lose one
        passed = sums.withColumn("upto", upto).join(cut.select("key", "need"), "key").filter("upto > need")
        best = F.min(F.struct("bin", (F.col("need") - (F.col("upto") - F.col("words"))).alias("need"), "first", "last", "n"))
        hit = passed.groupBy("key").agg(best.alias("b")).select("key", "b.*")
        hit = ws.write(hit.select("key", F.col("first").alias("lo"), (F.col("last") * (1 + 2.0**-52)).alias("hi"), "need", "n"), "cut")
        # sources whose rows end before their cut take all
        whole = cut.join(hit, "key", "left_anti").select("key", F.lit(2.0).alias("lo"), F.lit(2.0).alias("hi"), F.lit(0.0).alias("need"))
        most = hit.agg(F.max("n")).first()[0] or 0
        cut = ws.write(hit.drop("n").unionByName(whole), "cut")
        if most <= FEW:
            break
    placed = drawn.join(cut, "key")
    edge, order = placed.filter("v >= lo and v < hi"), ["v", "doc_id", "size", "row"]
    if most <= FEW:
        edge = edge.withColumn("upto", F.sum("size").over(Window.partitionBy("key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    else:  # very many rows of one random number
        edge = running_by_key(ws, edge, ["key"], [F.col(x) for x in order], "size")
    edge = edge.filter("upto <= need").select("row")
    taken = ws.write(placed.filter("v < lo").select("row").unionByName(edge), "taken")
    # one more document fills what is left
    got = drawn.join(taken, "row").groupBy("key").agg(F.sum("size").alias("got"))
    gap = wanted.join(got, "key", "left").select("key", (F.col("wanted") - F.coalesce("got", F.lit(0))).alias("gap"))
    off = F.abs(F.col("size") - F.col("gap"))
    fill = (
        drawn.join(taken, "row", "left_anti").join(ws.write(gap, "gap"), "key").filter(off < F.col("gap")).groupBy("key").agg(F.min(F.struct(off, F.col("v"), F.col("doc_id"), F.col("row"))).alias("best")).select("best.row")
    )
    extra = taken.unionByName(fill).withColumn("extra", F.lit(1))
    copies = F.col("certain") + F.coalesce("extra", F.lit(0))
    out = held.join(extra, "row", "left")
    if keep_rows:
        return out.filter("size > 0").select(*[F.col("doc")[c].alias(c) for c in names], copies.alias("copies")).filter("copies > 0")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
