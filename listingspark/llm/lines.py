"""Line dedup by a suffix array over line-ID sequences.

Lines with a word get numbers that grow by doc_id and place. A line that stands once in the corpus ends every repeated
run, so the suffix array holds the suffixes of the stretches between such lines. Suffixes are ranked by prefix
doubling, two doublings a round: the rank of the first 4k lines of a suffix is that of its four ranks of k lines, in the
order of a distributed sort of the distinct keys. Rounds end when no two suffixes share more than the last one told apart.

Neighbours of the sorted suffixes give the longest common prefixes. Suffixes that agree in n lines or more are an interval
of the array, cut off where the prefix that neighbours share is shorter. In each interval the first copy, by doc_id and
place, stays; the lines with which the other suffixes of the interval begin are deleted. Any line of a later copy of a
maximal run of ``min_lines`` lines or more is among the first ``min_lines`` of such a suffix, so these intervals decide.

A prefix whose line before is equal too is part of a longer one; the others are the maximal repeated runs. Their lengths
are measured where they are asked for: ranks tell the power of four that they reach, the rest is compared line by
line (n log n lines in all, as these prefixes can't be extended to the left).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingspark.plans.shared import Workspace, in_order

from .text import has_word, words

KEY = ["doc_id", "fp"]
#: Ranks are of so many pieces of the ranks before.
PIECES = 4


def line_lists(docs: DataFrame, need: int) -> DataFrame:
    """doc_id, fp (hash of the text, tells rows of equal doc_id apart), lines: of those with a word h, g (hashes; 96 bits
    together), at (index in the text) and size (words, counted only where ``need`` can be reached)."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("line"), i.alias("at"))), lambda x: has_word(x["line"]))
    size = lambda x: F.when(F.length(x) >= 2 * need - 1, F.size(words(x))).otherwise(F.lit(0)) if need else F.lit(0)
    listed = F.transform(lines, lambda x: F.struct(F.xxhash64(x["line"]).alias("h"), F.hash(x["line"]).alias("g"), x["at"].alias("at"), size(x["line"]).alias("size")))
    return docs.filter("text is not null and doc_id is not null").select("doc_id", F.xxhash64("text").alias("fp"), listed.alias("lines"))


def numbered_lines(ws: Workspace, docs: DataFrame, need: int) -> DataFrame:
    """gid (grows by doc_id, fp and place; neighbours in a text differ by 1), doc (gid of the text's first line), doc_id,
    fp, h, g, at, size. Equal rows are one text."""
    texts = ws.write(line_lists(docs, need), "texts")
    n = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_texts = texts.repartitionByRange(n, *KEY).dropDuplicates(KEY).sortWithinPartitions(*KEY)
    rows = sorted_texts.select(*KEY, F.posexplode("lines").alias("pos", "l")).withColumn("gid", F.monotonically_increasing_id())
    out = ws.write(rows.select("gid", (F.col("gid") - F.col("pos")).alias("doc"), *KEY, "l.*"), "lines")
    ws.drop(texts)
    return out


def repeated_stretches(ws: Workspace, lines: DataFrame, min_lines: int) -> DataFrame:
    """The lines that stand twice or more, as suffixes: gid, doc, doc_id, fp, at, size, line (gid of the line's first copy),
    seg (first gid of the stretch of such lines), rest (lines from here to its end), before (line before it there), head
    (its first ``min_lines`` lines, null beyond its end)."""
    firsts = ws.write(lines.groupBy("h", "g").agg(F.min("gid").alias("line"), F.max("gid").alias("last")).filter("line < last").drop("last"), "firsts")
    own = Window.partitionBy("doc").orderBy("gid")
    df = lines.join(firsts, ["h", "g"]).drop("h", "g")
    df = df.withColumns({"_run": F.col("gid") - F.row_number().over(own)})
    whole = Window.partitionBy("doc", "_run")
    df = df.withColumns({"seg": F.min("gid").over(whole), "rest": F.max("gid").over(whole) - F.col("gid") + 1, "before": F.lag("line").over(whole.orderBy("gid")), "head": F.array("line", *[F.lead("line", i).over(whole.orderBy("gid")) for i in range(1, min_lines)])})
    return ws.write(df.drop("_run"), "stretches")


def suffix_array(ws: Workspace, stretches: DataFrame) -> DataFrame:
    """gid, doc, seg, rest, before, head, path: the ranks of the first 1, 4, 16, ... lines of each suffix, told apart as far as
    any two suffixes agree. Suffixes that are equal to the ends of their stretches keep equal ranks."""
    own = Window.partitionBy("seg").orderBy("gid")
    keys = [f"_{i}" for i in range(PIECES)]
    state, k = stretches.select("gid", "doc", "seg", "rest", "before", "head", F.array("line").alias("path")), 1
    while True:
        rank = F.element_at("path", -1)
        pieces = state.withColumns({c: rank if i == 0 else F.lead(rank, i * k, -1).over(own) for i, c in enumerate(keys)})
        order = in_order(ws, pieces.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, f"order{k * PIECES}", "rank")
        state = ws.write(pieces.join(order.drop("n"), keys).withColumn("path", F.concat("path", F.array("rank"))).drop("rank", *keys), f"ranks{k * PIECES}")
        if not order.filter(f"n > 1 and {keys[-1]} <> -1").limit(1).count():
            return state
        k *= PIECES


def in_array_order(ws: Workspace, suffixes: DataFrame) -> DataFrame:
    """The suffixes written in order, with number (grows in that order) and _part (the partition that they are in)."""
    return in_order(ws, suffixes.withColumn("_rank", F.element_at("path", -1)), ["_rank", "gid"], "sorted").drop("_rank").withColumn("_part", F.shiftright("number", 33))


def neighbours(table: DataFrame, said: list[str]) -> DataFrame:
    """The suffixes, each with the one before it in order as _p (null for the first of all): its columns ``said``."""
    inside = table.withColumn("_p", F.lag(F.struct(*said)).over(Window.partitionBy("_part").orderBy("number")))
    # the first of a partition follows the last of the partition before; there is a row for each partition
    last = table.groupBy("_part").agg(F.max_by(F.struct(*said), "number").alias("_last"))
    last = last.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_last"))
    return inside.join(F.broadcast(last), "_part").withColumn("_p", F.coalesce("_p", "_last")).drop("_last")


def later_copies(ws: Workspace, table: DataFrame, lengths: list[int]) -> DataFrame:
    """gid and, for each n of lengths, _later{n}: whether the suffix is in an interval of n common lines or more of which
    another is the first by gid.

    An interval is known by the number of its first suffix. One that reaches over partitions is put together from the
    first and last pieces of each, which are as many rows as partitions; no interval is in one task."""
    shared = lambda n: (F.slice("head", 1, n) == F.slice(F.col("_p")["head"], 1, n)) & (F.col("rest") >= n) & (F.col("_p")["rest"] >= n)
    upto = Window.partitionBy("_part").orderBy("number")
    begins = {f"_s{n}": F.max(F.when(~F.coalesce(shared(n), F.lit(False)), F.col("number"))).over(upto) for n in lengths}
    df = marked = ws.write(neighbours(table, ["head", "rest"]).withColumns(begins).select("gid", "_part", *begins), "intervals")
    for n in lengths:
        s = F.col(f"_s{n}")
        pieces = marked.groupBy("_part", s.alias("s")).agg(F.min("gid").alias("least"))
        ends = pieces.groupBy("_part").agg(F.max("s").alias("last"), F.max_by("least", "s").alias("last_least"), F.max(F.when(F.col("s").isNull(), F.col("least"))).alias("open_least"))
        ends = ws.write(ends.withColumn("open", F.max("last").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))), "ends")
        over = ends.select(F.col("open").alias("_start"), F.col("open_least").alias("_over")).unionByName(ends.select(F.col("last").alias("_start"), F.col("last_least").alias("_over")))
        over = over.filter("_over is not null").groupBy("_start").agg(F.min("_over").alias("_over"))
        df = df.join(F.broadcast(ends.select("_part", "open")), "_part").withColumn("_start", F.coalesce(s, "open")).drop("open")
        df = df.withColumn("_own", F.min("gid").over(Window.partitionBy("_part", "_start"))).join(F.broadcast(over), "_start", "left")
        df = df.withColumn(f"_later{n}", F.col("gid") > F.least("_own", "_over")).drop("_start", "_own", "_over")
    return df.drop("_part", *begins)


def maximal_runs(ws: Workspace, stretches: DataFrame, table: DataFrame) -> DataFrame:
    """gid, doc, pgid, pdoc, run: neighbours in the suffix array that agree in ``run`` lines and not in the line before."""
    said = ["gid", "doc", "seg", "rest", "before", "path"]
    both = neighbours(table, said).filter("_p is not null").select(*said, *[F.col("_p")[x].alias(f"p{x}") for x in said])
    pairs = both.filter("path[0] = ppath[0] and not coalesce(before = pbefore, false)")
    differ = F.array_position(F.transform("path", lambda x, i: x != F.get("ppath", i)), True)
    base = F.pow(F.lit(PIECES), differ - 2).cast("int")
    left = F.least("rest", "prest") - base
    pairs = pairs.select("gid", "doc", "seg", "pgid", "pdoc", "pseg", F.when(differ == 0, F.col("rest").cast("int")).otherwise(base).alias("base"), F.when(differ == 0, 0).otherwise(F.least(left, base * (PIECES - 1))).cast("int").alias("more"))
    pairs = ws.write(pairs, "pairs")
    ids = stretches.groupBy("seg").agg(F.transform(F.array_sort(F.collect_list(F.struct("gid", "line"))), lambda x: x["line"]).alias("ids"))
    ids = ws.write(ids, "ids")
    part = lambda c, s: F.slice("ids", (F.col(c) - F.col(s)).cast("int") + F.col("base") + 1, F.col("more"))
    open_pairs = pairs.filter("more > 0").join(ids, "seg").withColumn("x", part("gid", "seg")).drop("ids")
    open_pairs = open_pairs.join(ids.withColumnRenamed("seg", "pseg"), "pseg").withColumn("y", part("pgid", "pseg"))
    agree = F.array_position(F.zip_with("x", "y", lambda a, b: a != b), True)
    measured = open_pairs.select("gid", "doc", "pgid", "pdoc", (F.col("base") + F.when(agree == 0, F.col("more")).otherwise(agree - 1)).alias("run"))
    return pairs.filter("more <= 0").select("gid", "doc", "pgid", "pdoc", F.col("base").alias("run")).unionByName(measured)


def lines_gone(stretches: DataFrame, later: DataFrame, lengths: list[int], min_words: int | None) -> DataFrame:
    """doc, doc_id, fp, gone (sorted indexes of the lines to delete), for texts that have repeated lines."""
    df, min_lines = stretches.join(later, "gid"), lengths[-1]
    listed = df.groupBy("doc").agg(F.first("doc_id").alias("doc_id"), F.first("fp").alias("fp"), F.array_sort(F.collect_list(F.struct("gid", "at", "size", *[f"_later{n}" for n in lengths]))).alias("l"))
    l = F.col("l")  # noqa: E741

    def covers(x: Column, i: Column, n: int, d: int) -> Column:
        """Whether a later copy of n lines begins d lines before x."""
        at = F.get(l, i - d)
        ok = (at["gid"] == x["gid"] - d) & at[f"_later{n}"]
        if n < min_lines:
            ok = ok & (reduce(lambda a, b: a + b, [F.get(l, i - d + e)["size"] for e in range(n)]) >= min_words)
        return F.coalesce(ok, F.lit(False))

    gone = F.filter(l, lambda x, i: reduce(lambda a, b: a | b, [covers(x, i, n, d) for n in lengths for d in range(n)]))
    return listed.select("doc", *KEY, F.transform(gone, lambda x: x["at"]).alias("gone"))


def repeated_lines(ws: Workspace, docs: DataFrame, min_lines: int, min_words: int | None, longest: bool) -> DataFrame:
    """doc_id, fp, n_lines, gone and, with ``longest``, longest (lines of the longest repeated run), for all texts with lines."""
    lines = numbered_lines(ws, docs, 0 if min_words is None else min_words if min_lines == 2 else 1)
    stretches = repeated_stretches(ws, lines, min_lines)
    table = in_array_order(ws, suffix_array(ws, stretches))
    lengths = [*([] if min_words is None else range(1, min_lines)), min_lines]
    gone = lines_gone(stretches, later_copies(ws, table, lengths), lengths, min_words).drop(*KEY)
    out = lines.groupBy("doc").agg(F.first("doc_id").alias("doc_id"), F.first("fp").alias("fp"), F.count(F.lit(1)).alias("n_lines")).join(gone, "doc", "left")
    if longest:
        runs = ws.write(maximal_runs(ws, stretches, table), "runs")
        both = runs.select("doc", "run").unionByName(runs.select(F.col("pdoc").alias("doc"), "run"))
        out = out.join(both.groupBy("doc").agg(F.max("run").alias("longest")), "doc", "left")
    return ws.write(out.drop("doc"), "gone")


def drop_repeated_lines(docs: DataFrame, *, min_lines: int = 2, min_words: int | None = 50, longest: bool = True, prefix: str = "_") -> DataFrame:
    """docs with the text of later copies of repeated runs deleted: runs of ``min_lines`` equal lines or more, and runs of
    fewer lines (one is enough) of ``min_words`` words or more; None: by lines alone. Adds n_lines (lines with a word before),
    n_removed and, unless ``longest`` is false, longest_run (lines of the longest run that the text has in common with
    another place, its own included; 0 for none), their names with ``prefix`` before.

    Runs are whole lines that follow each other, lines without a word left out; those stay where they are. The first
    copy, by doc_id and place, stays; rows of equal doc_id and text are one document and lose the same lines. Null
    or empty texts, and rows without doc_id, stay as they are. Empty input: empty result. Other columns are kept,
    whatever their names; choose a ``prefix`` that none of them begins with."""
    ws = Workspace(docs.sparkSession, "lines")
    found = repeated_lines(ws, docs, min_lines, min_words, longest)
    # texts and deletions are dealt by key at every size, as the table of deletions grows with the corpus
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("fp"))
    df = rows.join(found.hint("merge"), KEY, "left")
    text, gone = F.col("row")["text"], F.col("gone")
    # lines that stay lie between those that go: the text is cut there, in steps of the number of lines
    pieces = F.when(F.size(gone) > 0, F.split(text, "\n"))
    edges = F.concat(F.array(F.lit(-1)), gone, F.array(F.size("pieces")))
    df = df.withColumn("pieces", pieces).withColumn("edges", F.when(F.col("pieces").isNotNull(), edges))
    e = F.col("edges")
    kept = F.transform(F.slice(e, 2, F.size(e) - 1), lambda x, i: F.slice(F.col("pieces"), F.get(e, i) + 2, x - F.get(e, i) - 1))
    new = F.when(F.col("pieces").isNull(), text).otherwise(F.array_join(F.flatten(kept), "\n"))
    own = F.when(F.col("doc_id").isNull() & text.isNotNull(), F.size(F.filter(F.split(text, "\n"), has_word)))
    out = [new.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    number = lambda x, name: F.coalesce(x, F.lit(0)).cast("long").alias(prefix + name)
    more = [number(F.coalesce("n_lines", own), "n_lines"), number(F.when(F.size(gone) > 0, F.size(gone)), "n_removed")]
    return df.select(*out, *more, *([number(F.col("longest"), "longest_run")] if longest else []))
