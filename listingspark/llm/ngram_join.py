"""Jaccard join on sets of word n-grams by rare-first prefixes.

The n-grams of each set are put in one order for all: first a fixed part of all n-grams (by hash), from the rarest in the corpus
to the most frequent, then the others. Two sets of n and m n-grams that are similar share o = ceil(s / (1 + s) * (n + m)) of
them, so a common one is among the first n - ceil(s * n) + 1 of each. The part is a few times as large as such a prefix, so n-grams
outside it need not be counted: a set that has too few inside goes on with the least of its others. The part of small sets is
all that they have; sets of a size between may be similar to either kind and are taken as both, each kind with its own keys.
Prefixes alone are joined, under three filters, of which each is exact:

* length: the smaller set has at least s times the n-grams of the larger;
* position: after the first common n-gram both sets must have enough left to reach o;
* suffix: what follows in the two sets differs in no more n-grams than o allows. The difference is bounded from below by
  parities: of each of 512 parts of the n-grams a bit tells whether the suffix holds an odd number of them.

n-grams that one set alone holds fill prefixes but join nothing. A set with more of them than a similar one may lack has
no partner. That is settled for most sets before; n-grams of the others alone are counted for the order.

A group of similar sets isn't compared pair by pair: the sets that share an n-gram of their prefixes are compared with one of
them (a star) first, then those of other components with a second star; pairs that are still in different components are
joined. Each pair is verified once, on full sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingspark.plans.shared import Workspace, in_order

from .decontaminate import bitmap_bits
from .near_dups import components, confirmed, shingle_sets, whole_sets
from .tokens import mix

#: Sets up to this size have all their n-grams in their part.
SMALL = 100
#: Words of 64 parities.
SIGNS = 8
_U = np.uint64


def set_sums(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two hashes of each of the n sets."""
    size = np.bincount(rows, minlength=n)
    first = np.concatenate([[0], np.cumsum(size)])
    with np.errstate(over="ignore"):
        sums = [np.concatenate([np.zeros(1, _U), np.cumsum(mix(hashes, k), dtype=_U)]) for k in (11, 12)]
        s1, s2 = (x[first[1:]] - x[first[:-1]] for x in sums)
    return size, s1.view(np.int64), s2.view(np.int64)


def outlines(shingle: int):
    """doc_id, fp, text -> doc_id, fp, n (set size), s1, s2 (hash of the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sums = set_sums(*shingle_sets(batch["text"], shingle), batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["fp"], *map(pa.array, sums)], ["doc_id", "fp", "n", "s1", "s2"])

    return run


def part_of(rows: np.ndarray, hashes: np.ndarray, size: np.ndarray, small: bool, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the sets that are taken as small ones (or as large ones): which n-grams are theirs, the keys of these (odd for
    small sets), and which of them are in the part."""
    n = size[rows]
    own = n <= SMALL if small else n * 100 >= (SMALL + 1) * percent
    part = np.ones(int(own.sum()), bool) if small else mix(hashes[own], 77) % _U(max(1, 40 // max(1, 100 - percent))) == 0
    return own, hashes[own] & ~_U(1) | _U(small), part


def fixed_part(shingle: int, percent: int):
    """text -> h, s1: the keys of the part, with the hash of their set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows, hashes = shingle_sets(batch["text"], shingle)
                size, s1, _ = set_sums(rows, hashes, batch.num_rows)
                for small in (False, True):
                    own, keys, part = part_of(rows, hashes, size, small, percent)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[part].view(np.int64)), pa.array(s1[rows[own][part]])], ["h", "s1"])

    return run


def unnested(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and n-grams of cls, items; sizes."""
    ends = batch["items"].offsets.to_numpy()
    size = np.diff(ends)
    return np.repeat(np.arange(len(size)), size), batch["items"].values.to_numpy()[ends[0] : ends[-1]].view(_U), size


def part_items(percent: int):
    """cls, as_small, as_large, items -> cls, h: the keys of the part, for each kind that the set is taken as."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows, hashes, size = unnested(batch)
                for small, wanted in ((False, "as_large"), (True, "as_small")):
                    own, keys, part = part_of(rows, hashes, size, small, percent)
                    part &= batch[wanted].to_numpy(zero_copy_only=False)[rows[own]]
                    yield pa.RecordBatch.from_arrays([pa.array(batch["cls"].to_numpy()[rows[own][part]]), pa.array(keys[part].view(np.int64))], ["cls", "h"])

    return run


def part_outlines(percent: int):
    """cls, as_small, as_large, items -> a row for each kind that the set is taken as: cls, small, n, counted (keys in the part),
    more (the least others that a prefix needs when the part is shorter), rest (parities of the others without these)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch, out = whole.slice(start, 512), []
                rows, hashes, size = unnested(batch)
                for small, wanted in ((False, "as_large"), (True, "as_small")):
                    own, keys, part = part_of(rows, hashes, size, small, percent)
                    counted = np.bincount(rows[own][part], minlength=len(size))
                    at, others = rows[own][~part], keys[~part].view(np.int64)
                    others, ends = others[np.lexsort((others, at))], np.searchsorted(at, np.arange(len(size) + 1))
                    for i in np.flatnonzero(batch[wanted].to_numpy(zero_copy_only=False)):
                        n, rest = int(size[i]), others[ends[i] : ends[i + 1]]
                        short = max(0, n * (100 - percent) // 100 + 1 - int(counted[i]))
                        signs = np.bitwise_xor.reduce(parities(rest[short:].view(_U)), axis=0)
                        out.append((batch["cls"][int(i)].as_py(), int(small), n, int(counted[i]), rest[:short].tolist(), signs.view(np.int64).tolist()))
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(PART_OUTLINE.types)], schema=PART_OUTLINE)

    return run


PART_OUTLINE = pa.schema([("cls", pa.int64()), ("small", pa.int64()), ("n", pa.int64()), ("counted", pa.int64()), ("more", pa.list_(pa.int64())), ("rest", pa.list_(pa.int64()))])


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each n-gram, the words of parities with its own bit set."""
    part = mix(hashes, 78) % _U(64 * SIGNS)
    return np.where((part // _U(64))[:, None] == np.arange(SIGNS, dtype=_U), _U(1) << (part % _U(64))[:, None], _U(0))


SIGN_NAMES = [f"sign{k}" for k in range(SIGNS)]
POSTING = pa.schema([("h", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), ("pos", pa.int64()), ("after", pa.int64()), *[(s, pa.int64()) for s in SIGN_NAMES]])
POSTING_DDL = ", ".join(f"{f.name} long" for f in POSTING)


def prefixes(percent: int):
    """cls, n, shared (f, h of the n-grams that other sets hold too) -> a row for each of them in the prefix: its place
    (from 1, the set's own n-grams before it), the shared ones after it and their parities. Where only a part was counted:
    counted, more, rest of ``part_outlines``; others than the part count as shared and come last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch["shared"]
            f, h = (column.values.field(k).to_numpy(zero_copy_only=False) for k in ("f", "h"))
            ends, out = column.offsets.to_numpy(), []
            sizes, in_part = batch["n"].to_pylist(), "counted" in batch.schema.names
            outline = zip(*(batch[c].to_pylist() for c in ("counted", "more", "rest")), strict=True) if in_part else ((n, [], [0] * SIGNS) for n in sizes)
            for i, (cls, n, (counted, more, rest)) in enumerate(zip(batch["cls"].to_pylist(), sizes, outline, strict=True)):
                own_f, own_h = f[ends[i] : ends[i + 1]], h[ends[i] : ends[i + 1]]
                alone = counted - len(own_h)
                size = n * (100 - percent) // 100 + 1 - alone
                if size <= 0:
                    continue
                own_h = np.concatenate([own_h[np.lexsort((own_h, own_f))], np.array(more, np.int64)])
                signs = parities(own_h.view(_U))
                after = np.bitwise_xor.reduce(signs, axis=0) ^ np.bitwise_xor.accumulate(signs[:size], axis=0) ^ np.array(rest, np.int64).view(_U)
                k = np.arange(len(after))
                out.append([own_h[:size], np.full(len(k), cls), np.full(len(k), n), alone + k + 1, n - alone - k - 1, *after.view(np.int64).T])
            columns = [np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64) for j in range(len(POSTING))]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns], schema=POSTING)

    return run


def long_enough(n: Column, m: Column, percent: int) -> Column:
    return (n * 100 >= m * percent) & (m * 100 >= n * percent)


def may_be_similar(x: str, y: str, percent: int) -> Column:
    """Whether postings of one n-gram, columns of aliases x and y, leave room for enough common ones. True for the first
    common n-gram of any similar pair."""
    c = lambda a, name: F.col(f"{a}.{name}")
    both = c(x, "n") + c(y, "n")
    need = F.floor((both * percent + (99 + percent)) / (100 + percent))  # at most 2^53, where doubles are exact
    place = F.least(c(x, "after"), c(y, "after")) + 1 >= need
    place = place & (F.least(c(x, "n") - c(x, "pos"), c(y, "n") - c(y, "pos")) + 1 >= need)
    differ = sum((F.bit_count(c(x, s).bitwiseXOR(c(y, s))) for s in SIGN_NAMES), F.lit(0))
    return place & (c(x, "after") + c(y, "after") - differ >= 2 * (need - 1))


def likely_in(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id and fp are in wanted, and few others (by one bit each, of 16 for each of wanted, 2^25 at
    most), so that other texts aren't shuffled to be joined. The words of bits are broadcast: 2^19 at most."""
    place = F.pmod(F.xxhash64("doc_id", "fp"), F.lit(bitmap_bits(wanted.count())))
    bit = (place % 64).cast("int")
    bits = wanted.select(F.shiftright(place, 6).alias("_word"), bit.alias("_bit"))
    words = bits.groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_mask"))
    met = docs.withColumns({"_word": F.shiftright(place, 6), "_bit": bit}).join(F.broadcast(words), "_word")
    return met.filter(F.expr("getbit(_mask, _bit) = 1")).drop("_word", "_bit", "_mask")


def labelled(hits: DataFrame, labels: DataFrame) -> DataFrame:
    return hits.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))


def similar_groups(docs: DataFrame, *, shingle: int = 3, percent: int = 90, stars: int = 2) -> DataFrame:
    """Groups of documents linked by 100 * shared n-grams >= percent * all n-grams of the two. Words are lower-cased (A-Z)
    and end at ASCII white space.

    Returns doc_id, fp (xxhash64 of the text), n_shingles (set size), class_id (least doc_id with an equal set) and component_id
    (least doc_id reachable by links, itself included); one row per input row.

    Null or empty text, or one without words: empty set, linked with nothing. Fewer words than an n-gram has: the whole
    sequence is one. Rows of equal doc_id with different texts are linked each by its own text; repeated rows have equal
    results. Null doc_id: in no group, class_id and component_id null. Empty input: empty result. Other columns are
    ignored. Sets are compared by 64-bit hashes of their n-grams."""
    ws = Workspace(docs.sparkSession, "join")
    kind, text = dict(docs.dtypes)["doc_id"], F.col("text").cast("string")
    df = docs.select("doc_id", F.xxhash64(text).alias("fp"), text.alias("text"))
    rows = ws.write(df.mapInArrow(outlines(shingle), f"doc_id {kind}, fp long, n long, s1 long, s2 long"), "outlines")
    # classes of equal sets, numbered in the order of their least doc_id, so that a least number has a least doc_id
    same = ["s1", "s2", "n"]
    texts = rows.filter("n > 0 and doc_id is not null").groupBy(*same, "doc_id", "fp").agg(F.count(F.lit(1)).alias("times"))
    classes = texts.groupBy(*same).agg(F.min("doc_id").alias("first"), F.min_by(F.struct("fp", "times"), "doc_id").alias("t")).select(*same, "first", "t.*")
    classes = in_order(ws, classes, ["first", "s1", "s2"], "classes", "cls")
    members = ws.write(rows.join(classes.select(*same, "cls"), same, "left"), "members")
    own = classes.withColumnRenamed("first", "doc_id")
    # n-grams of one set alone: copies have the same hash of their set
    part = df.filter("doc_id is not null").select("text").mapInArrow(fixed_part(shingle, percent), "h long, s1 long")
    alone = part.groupBy("h").agg(F.min("s1").alias("s1"), F.max("s1").alias("other")).filter("s1 = other")
    small = F.col("h").bitwiseAND(1)
    alone = ws.write(alone.groupBy("s1").agg(F.sum(small).alias("small"), F.sum(1 - small).alias("large")), "alone")
    ws.drop(rows)
    few = lambda c: F.coalesce(c, F.lit(0)) * 100 <= F.col("n") * (100 - percent)
    kinds = ((F.col("n") <= SMALL) & few("small")).alias("as_small"), ((F.col("n") * 100 >= (SMALL + 1) * percent) & few("large")).alias("as_large")
    # below this size no other set is similar
    hopeful = own.filter(F.col("n") * (100 - percent) >= percent).join(alone, "s1", "left").select("cls", "doc_id", "fp", "times", *kinds)
    hopeful = ws.write(hopeful.filter("as_small or as_large"), "hopeful")
    # one text of each class; only rows that are repeated have to be brought together for that
    likely = likely_in(df, hopeful)
    named = lambda p: likely.join(hopeful.filter(p).drop("times"), ["doc_id", "fp"]).select("cls", "as_small", "as_large", "text")
    one = named("times = 1")
    if hopeful.filter("times > 1").limit(1).count():
        one = one.unionByName(named("times > 1").dropDuplicates(["cls"]))
    sets = ws.write(one.mapInArrow(whole_sets(shingle), "cls long, as_small boolean, as_large boolean, items array<long>"), "sets")
    items = sets.mapInArrow(part_items(percent), "cls long, h long")
    # written, so that an n-gram of very many sets is dealt among several tasks
    often = ws.write(items.groupBy("h").agg(F.count(F.lit(1)).alias("f")).filter("f > 1"), "frequencies")
    shared = items.join(often, "h").groupBy("cls", small.alias("small")).agg(F.collect_list(F.struct("f", "h")).alias("shared"))
    outline = ws.write(sets.mapInArrow(part_outlines(percent), "cls long, small long, n long, counted long, more array<long>, rest array<long>"), "part-outlines")
    shared = outline.join(shared, ["cls", "small"], "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<struct<f:long,h:long>>")))
    postings = ws.write(shared.select("cls", "n", "shared", "counted", "more", "rest").mapInArrow(prefixes(percent), POSTING_DDL), "postings")
    ws.drop(often)
    lists = ws.write(postings.groupBy("h").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("h"), "lists")
    hits = ws.write(postings.join(lists, "h"), "hits")
    compared = ws.write(sets.join(hits.select("cls").distinct(), "cls", "left_semi"), "compared")
    ws.drop(postings, sets)

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs whose sets are similar enough; sets of no pair stay where they are."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        return confirmed(pairs, compared.join(ends, "cls", "left_semi"), percent)

    labels, links, done = None, None, None
    free = hits.select("h", "cls", "n", F.col("cls").alias("label"), F.lit(True).alias("out"))
    for _ in range(stars):
        # the star of a list is the one of its sets, among those that are apart from the last star, that is in most lists
        candidates = free.filter("out")
        central = candidates.groupBy("cls").agg(F.count(F.lit(1)).alias("central"))
        mark = F.struct("central", F.xxhash64("cls").alias("mark"), F.col("cls").alias("star"), F.col("n").alias("star_n"))
        chosen = ws.write(candidates.join(central, "cls").groupBy("h").agg(F.max(mark).alias("m")).select("h", "m.star", "m.star_n"), "chosen")
        met = free.join(chosen, "h").filter((F.col("cls") != F.col("star")) & long_enough(F.col("n"), F.col("star_n"), percent))
        if labels is not None:
            met = met.join(labels.select(F.col("node").alias("star"), F.col("label").alias("star_label")), "star", "left").filter(F.col("label") != F.coalesce("star_label", "star"))
        pairs = met.select(F.least("cls", "star").alias("a"), F.greatest("cls", "star").alias("b")).distinct()
        pairs = ws.write(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        done = pairs if done is None else done.unionByName(pairs)
        found = ws.write(verified(pairs), "links")
        links = found if links is None else links.unionByName(found)
        labels = components(ws, links)
        starred = labels.select(F.col("node").alias("star"), F.col("label").alias("star_label"))
        apart = labelled(free.drop("label", "out"), labels).join(chosen.select("h", "star"), "h").join(starred, "star", "left")
        apart = ws.write(apart.select("h", "cls", "n", "label", (F.col("label") != F.coalesce("star_label", "star")).alias("out")), "apart")
        mixed = ws.write(apart.filter("out").select("h").distinct(), "mixed")
        free = ws.write(apart.join(mixed, "h", "left_semi"), "free")
    # what is still apart: at least one of a pair is apart from the last star of their list
    if free.limit(1).count():
        step = math.log(100 / percent)
        open_lists = hits.join(free.select("h", "cls", "label", "out"), ["h", "cls"]).withColumn("kind", F.floor(F.log("n") / step))
        open_lists = ws.write(open_lists, "open")
        asked = open_lists.filter("out").withColumn("kind", F.explode(F.sequence(F.col("kind") - 1, F.col("kind") + 1)))
        x, y = open_lists.alias("x"), asked.alias("y")
        on = (F.col("x.h") == F.col("y.h")) & (F.col("x.kind") == F.col("y.kind")) & (F.col("x.label") != F.col("y.label"))
        met = x.join(y, on & long_enough(F.col("x.n"), F.col("y.n"), percent) & may_be_similar("x", "y", percent))
        pairs = met.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()
        pairs = ws.write(pairs.join(done, ["a", "b"], "left_anti"), "rest")
        more = ws.write(verified(pairs), "more")
        if more.limit(1).count():
            labels = components(ws, links.unionByName(more))
    named = labels.join(classes.select(F.col("cls").alias("label"), F.col("first").alias("component")), "label").select(F.col("node").alias("cls"), "component")
    out = members.join(classes.select("cls", F.col("first").alias("class_id")).join(named, "cls", "left"), "cls", "left")
    said = lambda *c: F.when(F.col("doc_id").isNotNull(), F.coalesce(*c, "doc_id"))
    return out.select("doc_id", "fp", F.col("n").alias("n_shingles"), said("class_id").alias("class_id"), said("component", "class_id").alias("component_id"))
