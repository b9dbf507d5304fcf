"""Near-duplicate documents: fast similarity sketching, banding, exact verification, connected components.

A sketch has t coordinates. In round i < t each element of a set is placed by a hash of (element, i) into a bin with
a value; a bin keeps the least value of the first round that reached it. Rounds stop when all bins are full; rounds
t to 2t - 1 put every element into bin i - t, so that each coordinate is filled. Equal coordinates of two sketches then
estimate the sets' similarity with concentration bounds, for small sets as for large ones.

Sets with equal elements are one class. Classes that share a band of coordinates are compared with one of them first
(a star), which joins nearly all that belong together. What is still apart from its star is compared with the others
of its bands by their rarest shingles, so that a bucket's pairs are never listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingspark.plans.shared import Workspace, in_order

from .tokens import SPACED_LOWER, mix, tokenize, windows

SHINGLE = 5
#: 60 bands of 5: a pair of similarity 0.75 shares none of them with probability 9e-8.
BANDS, ROWS = 60, 5
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, hashes): the distinct shingles of each row, ascending; a row of fewer words has all of them as one."""
    w = tokenize(column, SPACED_LOWER)
    n = np.diff(w.first)
    rows, hashes = [], []
    for size in range(1, shingle + 1):
        h, ok = windows(w, size, size)
        if size < shingle:  # only rows of just this many words
            ok = ok & (n[w.docs[: len(h)]] == size) if len(h) else ok
        rows.append(w.docs[: len(h)][ok])
        hashes.append(h[ok])
    rows, hashes = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def sketch(rows: np.ndarray, hashes: np.ndarray, n: int, t: int) -> np.ndarray:
    """n sketches of t coordinates; those of empty sets stay at the largest number."""
    out = np.full(n * t, _FULL)
    full = np.bincount(rows, minlength=n) == 0
    for i in range(2 * t):
        live = ~full[rows]
        rows, hashes = rows[live], hashes[live]
        if not len(rows):
            break
        g = mix(hashes, 100 + i)
        place = ((g >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.int64(i - t)
        value = (np.uint64(i) << np.uint64(40)) | (g & np.uint64((1 << 40) - 1))
        np.minimum.at(out, rows * t + place, value)
        full |= (out.reshape(n, t) != _FULL).all(1)
    return out.reshape(n, t)


def summaries(shingle: int, bands: int, band_rows: int):
    """doc_id, fp, text -> doc_id, fp, n (set size), s1, s2 (hash of the set), keys (of the bands; empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows, hashes = shingle_sets(batch["text"], shingle)
                n = np.bincount(rows, minlength=batch.num_rows)
                first = np.concatenate([[0], np.cumsum(n)])
                with np.errstate(over="ignore"):
                    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes, k), dtype=np.uint64)]) for k in (11, 12)]
                    s1, s2 = (x[first[1:]] - x[first[:-1]] for x in sums)
                    grid = sketch(rows, hashes, batch.num_rows, bands * band_rows).reshape(-1, bands, band_rows)
                    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), grid.shape[:2])
                    for k in range(band_rows):
                        keys = mix(keys ^ mix(grid[:, :, k], 13), 14 + k)
                some = n > 0
                ends = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], batch["fp"], pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].reshape(-1).view(np.int64)))],
                    ["doc_id", "fp", "n", "s1", "s2", "keys"],
                )

    return run


def whole_sets(shingle: int):
    """cls, text -> cls, items (the set's hashes, ascending as unsigned numbers). Columns between them go along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows, hashes = shingle_sets(batch["text"], shingle)
                ends = pa.array(np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(hashes.view(np.int64)))], [*batch.schema.names[:-1], "items"])

    return run


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """node, label (least node reachable) of edges(a, b): least labels of neighbours, then labels of labels, until
    nothing changes. Each round is written, so a lost executor costs one round."""
    both = ws.write(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = ws.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("lower"))
        new = ws.write(step.join(jump, "low").select("node", F.least("low", "lower").alias("label"), (F.least("low", "lower") < F.col("label")).alias("moved")), "labels")
        if not new.filter("moved").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")


#: Sizes within this factor are one size class.
SIZE_STEP = 1.02


def prefix_pairs(ws: Workspace, left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs of left(cls, n, label, out), of different labels and one of them out, that can be similar.

    The shingles of each set are ordered from the rarest to the most frequent. Sets of n and m shingles that share the
    o = ceil(s / (1 + s) * (n + m)) which similarity s asks for have a common one among the first n - o + 1 of one and
    the first m - o + 1 of the other. Sets that differ in their rare shingles thus never meet, however many frequent
    ones they share. Exact for any order; the one by frequency makes it selective."""
    s = percent / 100
    share = s / (1 + s)
    need = lambda n, m: F.ceil(F.lit(share) * (n + m) - 1e-9)
    items = left.join(sets, "cls").select("cls", F.explode("items").alias("h"))
    often = items.groupBy("h").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    weighed = items.join(often, "h", "left").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(1)).alias("f"), "h"))).alias("order"))
    ranked = ws.write(weighed.join(left, "cls").withColumn("order", F.slice("order", 1, (F.col("n") - F.ceil(F.col("n") * s - 1e-9) + 1).cast("int"))), "ranked")
    step = math.log(SIZE_STEP)
    kind = lambda n: F.floor(F.ln(n) / step)
    place = F.posexplode("order").alias("pos", "x")
    known = ranked.select("cls", "n", "label", kind(F.col("n")).alias("kind"), place).filter("x.f > 1").select("cls", "n", "label", "kind", (F.col("pos") + 1).alias("pos"), F.col("x.h").alias("h"))
    # what is out asks for each size class on its own, with as many shingles as its smallest member calls for
    asked = ranked.filter("out").select("cls", "n", "label", "order", F.explode(F.sequence(kind(F.col("n") * s) - 1, kind(F.col("n") / s) + 1)).alias("kind"))
    least = F.greatest(F.exp(F.col("kind") * step) * (1 - 1e-9), F.col("n") * s)
    asked = asked.withColumn("order", F.slice("order", 1, F.greatest(F.col("n") - need(F.col("n"), least) + 1, F.lit(0)).cast("int")))
    asked = asked.select(F.col("cls").alias("other"), F.col("n").alias("other_n"), F.col("label").alias("other_label"), "kind", place).filter("x.f > 1")
    asked = asked.select("other", "other_n", "other_label", "kind", (F.col("pos") + 1).alias("other_pos"), F.col("x.h").alias("h"))
    o = need(F.col("n"), F.col("other_n"))
    near = (F.col("label") != F.col("other_label")) & (F.col("pos") <= F.col("n") - o + 1) & (F.col("other_pos") <= F.col("other_n") - o + 1)
    met = known.join(asked, (known["h"] == asked["h"]) & (known["kind"] == asked["kind"]) & near)
    return met.select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs(a, b) whose sets are similar enough. The set of a travels to that of b, so name the end that many
    pairs have in common b."""
    x, y = (sets.select(F.col("cls").alias(c), F.col("items").alias(v)) for c, v in (("a", "x"), ("b", "y")))
    shared = F.size(F.array_intersect("x", "y"))
    return pairs.join(x, "a").join(y, "b").filter(shared * 100 >= (F.size("x") + F.size("y") - shared) * percent).select("a", "b")


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = 75, bands: int = BANDS, band_rows: int = ROWS) -> DataFrame:
    """Groups of documents linked by 100 * shared shingles >= percent * all shingles of the two.

    Returns doc_id, fp (xxhash64 of the text), n_shingles, component_id (least doc_id reachable by links, itself
    included) and kept (doc_id is component_id); one row per input row. Every link is confirmed on the full sets of hashed
    shingles.

    Null or empty text, or one without words: empty set, linked with nothing. Fewer words than a shingle: the
    whole sequence is one. Rows of equal doc_id with different texts are documents of their own, linked by their own
    texts; repeated rows have equal results. Null doc_id: in no group, component_id null and kept. Empty input: empty
    result. Other columns are ignored."""
    ws = Workspace(docs.sparkSession, "near")
    kind = dict(docs.dtypes)["doc_id"]
    text = F.col("text").cast("string")
    df = docs.select("doc_id", F.xxhash64(text).alias("fp"), text.alias("text"))
    rows = ws.write(df.mapInArrow(summaries(shingle, bands, band_rows), f"doc_id {kind}, fp long, n long, s1 long, s2 long, keys array<long>"), "sketches")
    # classes of equal sets, numbered in the order of their least doc_id, so that a least number has a least doc_id
    same = ["s1", "s2", "n"]
    classes = rows.filter("n > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("first"), F.min_by("fp", "doc_id").alias("fp"))
    classes = in_order(ws, classes, ["first", "s1", "s2"], "classes", "cls")
    members = ws.write(rows.drop("keys").join(classes.select(*same, "cls"), same, "left"), "members")
    own = classes.withColumnRenamed("first", "doc_id")
    reps = ws.write(rows.join(own, ["doc_id", "fp", *same]).dropDuplicates(["cls"]).select("cls", "n", "keys"), "representatives")
    banded = reps.select("cls", "n", F.explode("keys").alias("key"))
    shared = ws.write(banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "shared")
    hits = ws.write(banded.join(shared, "key"), "hits")
    ws.drop(reps, shared)
    # the star of a bucket is its class that meets the most others over all bands: the text that copies come from
    central = hits.groupBy("cls").agg(F.sum("size").alias("central"))
    mark = F.struct("central", F.xxhash64("cls").alias("mark"), F.col("cls").alias("star"), F.col("n").alias("star_n"))
    chosen = ws.write(hits.join(central, "cls").groupBy("key").agg(F.max(mark).alias("m")).select("key", "m.star", "m.star_n"), "chosen")
    buckets = ws.write(hits.join(chosen, "key").drop("size"), "buckets")
    ws.drop(hits, chosen)
    sized = lambda x, y: (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)
    stars = ws.write(buckets.filter((F.col("cls") != F.col("star")) & sized("n", "star_n")).select(F.col("cls").alias("a"), F.col("star").alias("b")).distinct(), "stars")
    # full sets of the classes that share a bucket
    wanted = own.join(buckets.select("cls").distinct(), "cls").select("doc_id", "fp", "cls")
    sets = ws.write(df.join(wanted, ["doc_id", "fp"]).dropDuplicates(["cls"]).select("cls", "text").mapInArrow(whole_sets(shingle), "cls long, items array<long>"), "sets")
    links = ws.write(confirmed(stars, sets, percent), "links")
    labels = components(ws, links)
    # pairs of a bucket that are still apart: at least one of them is apart from the star
    apart = buckets.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    starred = labels.select(F.col("node").alias("star"), F.col("label").alias("star_label"))
    apart = ws.write(apart.join(starred, "star", "left").withColumn("out", F.col("label") != F.coalesce("star_label", "star")).select("key", "cls", "n", "label", "out"), "apart")
    ws.drop(buckets, stars)
    mixed = ws.write(apart.filter("out").select("key").distinct(), "mixed")
    left = ws.write(apart.join(mixed, "key", "left_semi").groupBy("cls", "n", "label").agg(F.max("out").alias("out")), "left")
    ws.drop(apart)
    if left.limit(1).count():
        rest = ws.write(prefix_pairs(ws, left, sets, percent), "rest")
        more = ws.write(confirmed(rest, sets, percent), "more")
        if more.limit(1).count():
            labels = components(ws, links.unionByName(more))
    named = labels.join(classes.select(F.col("cls").alias("label"), F.col("first").alias("component")), "label").select(F.col("node").alias("cls"), "component")
    alone = classes.select("cls", F.col("first").alias("own"))
    out = members.join(alone.join(named, "cls", "left"), "cls", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "own", "doc_id"))
    return out.select("doc_id", "fp", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
