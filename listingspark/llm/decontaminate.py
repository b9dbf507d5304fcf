"""Benchmark decontamination by a positional inverted index.

The index has a posting (term, document, place) for each word of the documents that a benchmark phrase could cover:
words in a stretch whose neighbours all are neighbours in some benchmark window. That test uses bitmaps of a bounded
size, which let no such word go. A window is then looked up from its rarest term: the postings of that term give the
places where it could start, and the postings of its other terms, moved by their offsets, are intersected with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingspark.plans.shared import Workspace

from .tokens import ALNUM_LOWER, mix, tokenize

SIZE = 10
#: The least and the most bits of a bitmap; the most is also what is ever broadcast for a window length (4 MB). Between
#: them it has 16 bits for each pair of words in the benchmark's windows, so that few pairs are taken for one by chance.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 25
#: A document: its doc_id (0 for null) and a hash of its text and of whether doc_id is null.
KEY = ["k", "fp"]


def pair_hashes(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes[:-1] ^ mix(hashes[1:], 21), 22)


def item_windows(size: int):
    """item_id, text -> item_id, n (words of the window), terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = tokenize(batch["text"], ALNUM_LOWER)
            rows, terms = [], []
            for i, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
                own = w.hashes[a:b].view(np.int64)
                for at in range(max(1, len(own) - size + 1)) if len(own) else ():
                    rows.append(i)
                    terms.append(own[at : at + size].tolist())
            yield pa.RecordBatch.from_arrays([batch["item_id"].take(pa.array(rows, pa.int64())), pa.array([len(t) for t in terms], pa.int64()), pa.array(terms, pa.list_(pa.int64()))], ["item_id", "n", "terms"])

    return run


def window_marks(size: int):
    """n, terms -> n, bit (of ``size``): of each pair of neighbours; of the term itself in windows of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, bit = [], []
            for k, terms in zip(batch["n"].to_pylist(), batch["terms"].to_pylist(), strict=True):
                own = np.array(terms, np.int64).view(np.uint64)
                bits = (pair_hashes(own) if k > 1 else mix(own, 23)) % np.uint64(size)
                n += [k] * len(bits)
                bit += bits.astype(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(bit, pa.int64())], ["n", "bit"])

    return run


def bitmap_bits(pairs: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * pairs).bit_length()))


def bitmaps(windows: DataFrame) -> dict[int, np.ndarray]:
    """A bitmap for each window length that occurs (``size`` at most), of ``MOST_BITS`` at most whatever the benchmark's size.
    Neighbouring windows share all but one of their pairs, so that there are about as many pairs as windows."""
    size = bitmap_bits(windows.count())
    bits = windows.select("n", "terms").mapInArrow(window_marks(size), "n long, bit long")
    words = bits.groupBy("n", F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("mask"))
    out: dict[int, np.ndarray] = {}
    for n, word, mask in words.toLocalIterator():
        out.setdefault(n, np.zeros(size // 64, np.int64))[word] = mask
    return {n: np.unpackbits(x.view(np.uint8), bitorder="little").astype(bool) for n, x in out.items()}


def post(maps):
    """doc_id, k, fp, text -> doc_id, k, fp, n_words, postings (place and term of the words that a window could cover).
    maps: broadcast packed bitmaps by window length; None posts every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None if maps is None else {n: np.unpackbits(x).astype(bool) for n, x in maps.value.items()}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                w = tokenize(batch["text"], ALNUM_LOWER)
                keep = np.full(len(w.hashes), tables is None)
                for n, table in (tables or {}).items():
                    bits = np.uint64(len(table))
                    if n == 1:
                        keep |= table[(mix(w.hashes, 23) % bits).astype(np.int64)]
                        continue
                    if len(w.hashes) < n:
                        continue
                    joined = table[(pair_hashes(w.hashes) % bits).astype(np.int64)] & (w.docs[1:] == w.docs[:-1])
                    # stretches of n words or more whose neighbours are all joined
                    edge = np.diff(np.concatenate([[0], joined.view(np.int8), [0]]))
                    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
                    long = b - a >= n
                    mark = np.zeros(len(w.hashes) + 1, np.int32)
                    np.add.at(mark, a[long], 1)
                    np.add.at(mark, b[long], -1)
                    keep |= np.cumsum(mark)[:-1] > 0
                at_word = np.flatnonzero(keep)
                rows = w.docs[at_word]
                postings = pa.StructArray.from_arrays([pa.array((at_word - w.first[rows]).astype(np.int32)), pa.array(w.hashes[at_word].view(np.int64))], ["pos", "term"])
                ends = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["k"], batch["fp"], pa.array(np.diff(w.first)), pa.ListArray.from_arrays(pa.array(ends), postings)], ["doc_id", "k", "fp", "n_words", "postings"])

    return run


def text_key(doc_id: Column, text: Column) -> Column:
    """A hash of the text and of whether doc_id is null."""
    return F.xxhash64(text.cast("string"), doc_id.isNull())


def index(ws: Workspace, docs: DataFrame, windows: DataFrame | None) -> DataFrame:
    """The written index: doc_id, k, fp, n_words, postings of each document; of all words if windows is None."""
    text, kind = F.col("text").cast("string"), dict(docs.dtypes)["doc_id"]
    key = F.coalesce("doc_id", F.lit(0).cast(kind)).alias("k")
    df = docs.select("doc_id", key, text_key(F.col("doc_id"), text).alias("fp"), text.alias("text"))
    maps = None if windows is None else docs.sparkSession.sparkContext.broadcast({n: np.packbits(x) for n, x in bitmaps(windows).items()})
    return ws.write(df.mapInArrow(post(maps), f"doc_id {kind}, k {kind}, fp long, n_words long, postings array<struct<pos:int,term:long>>"), "index")


def postings(indexed: DataFrame) -> DataFrame:
    return indexed.select(*KEY, F.inline("postings"))


def phrase_matches(ws: Workspace, indexed: DataFrame, windows: DataFrame) -> DataFrame:
    """k, fp, start, n, wid: all places of the windows (wid, n, terms) in the index."""
    lists = postings(indexed)
    terms = windows.select("wid", "n", F.posexplode("terms").alias("off", "term"))
    length = ws.write(lists.groupBy("term").agg(F.count(F.lit(1)).alias("f")).join(terms.select("term").distinct(), "term"), "lengths")
    # a window with a term that has no posting can't occur
    rarest = terms.join(length, "term").groupBy("wid", "n").agg(F.min(F.struct("f", "off", "term")).alias("m"), F.count(F.lit(1)).alias("have")).filter("have = n").select("wid", "n", "m.term", "m.off")
    starts = lists.join(rarest, "term").select(*KEY, (F.col("pos") - F.col("off")).alias("start"), "wid", "n").filter("start >= 0").distinct()
    need = starts.join(terms.select("wid", "off", "term"), "wid").withColumn("pos", F.col("start") + F.col("off"))
    met = need.join(lists.distinct(), [*KEY, "pos", "term"]).groupBy(*KEY, "start", "wid", "n").agg(F.count(F.lit(1)).alias("met"))
    return met.filter("met = n").drop("met")


def densest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k, fp, item_id, need, span, postings (pos and term, any order) -> k, fp, item_id, place, found: the first stretch of
    ``span`` words with the most different terms, where these are ``need`` or more."""
    for batch in batches:
        keep, place, found = [], [], []
        for row, (need, span, said) in enumerate(zip(*(batch[c].to_pylist() for c in ("need", "span", "postings")), strict=True)):
            said = sorted((x["pos"], x["term"]) for x in said)
            inside: dict[int, int] = {}
            best, at, low = 0, 0, 0
            for pos, term in said:
                inside[term] = inside.get(term, 0) + 1
                while said[low][0] <= pos - span:
                    inside[said[low][1]] -= 1
                    if not inside[said[low][1]]:
                        del inside[said[low][1]]
                    low += 1
                if len(inside) > best:
                    best, at = len(inside), said[low][0]
            if best >= need:
                keep.append(row)
                place.append(at)
                found.append(best)
        rows = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch["k"].take(rows), batch["fp"].take(rows), batch["item_id"].take(rows), pa.array(place, pa.int64()), pa.array(found, pa.int64())], ["k", "fp", "item_id", "place", "found"])


def proximity_matches(docs: DataFrame, benchmark: DataFrame, *, share: float = 0.8, slack: float = 2.0) -> DataFrame:
    """doc_id, item_id, place, found: the items of which ``share`` or more of the distinct terms stand, in any order, in a
    stretch of ``slack`` times as many words as the item has. place: the first word of the densest such stretch (the first
    of equals), found: its different terms.

    A set of so many terms holds one of the item's total - needed + 1 rarest terms in the corpus, so a document is looked at
    for an item only if it has one of these and enough of the item's terms at all; an item of nothing but frequent words
    meets many documents. Uses a full index of the documents' words. Items without words match nothing; null texts have
    no words; rows without doc_id are left out; repeated rows, and rows of equal doc_id with different texts, count apart
    only by their texts. Empty tables: empty result."""
    ws = Workspace(docs.sparkSession, "proximity")
    lists = postings(index(ws, docs.filter("doc_id is not null"), None)).distinct()
    kind, id_kind = dict(benchmark.dtypes)["item_id"], dict(docs.dtypes)["doc_id"]
    words = benchmark.filter("item_id is not null").select("item_id", "text").mapInArrow(item_windows(1 << 30), f"item_id {kind}, n long, terms array<long>")
    items = words.groupBy("item_id").agg(F.max("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    items = ws.write(items.select("item_id", "terms", F.ceil(F.size("terms") * share).alias("need"), F.ceil(F.col("n") * slack).alias("span")), "items")
    terms = items.select("item_id", "need", "span", F.size("terms").alias("total"), F.explode("terms").alias("term"))
    used = ws.write(lists.join(terms.select("term").distinct(), "term"), "postings")
    often = used.groupBy("term").agg(F.count(F.lit(1)).alias("f"))
    ranked = terms.join(often, "term", "left").fillna(0, ["f"]).withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("f", "term")))
    anchors = ranked.filter("rank <= total - need + 1 and f > 0").select("item_id", "term")
    pairs = used.join(anchors, "term").select(*KEY, "item_id").distinct()
    # a pair's terms first, then their postings in its document, so that a frequent term's postings meet no other item
    said = pairs.join(terms.drop("total"), "item_id").join(used, [*KEY, "term"]).groupBy(*KEY, "item_id", "need", "span").agg(F.collect_list(F.struct("pos", "term")).alias("postings"), F.count_distinct("term").alias("have"))
    found = said.filter("have >= need").drop("have").mapInArrow(densest, f"k {id_kind}, fp long, item_id {kind}, place long, found long")
    return found.select(F.col("k").alias("doc_id"), "item_id", "place", "found")


def contamination(docs: DataFrame, benchmark: DataFrame, *, size: int = SIZE) -> DataFrame:
    """Words of each document that occurrences of benchmark windows cover, and the items they are from.

    A window is ``size`` consecutive words of an item; an item of fewer words is one window. Returns doc_id, fp
    (``text_key``), n_words, n_hit, items (sorted as strings), hits (start and words of each occurrence); one row per input row.

    Null or empty text: no words, no hit. Rows of equal doc_id with different texts are looked up apart; repeated rows
    give repeated results. Items without words, and null item_ids, are in no list of items (words are hit all the
    same). Empty documents: empty result; empty benchmark: no hit. Other columns are ignored."""
    ws = Workspace(docs.sparkSession, "decontaminate")
    kind = dict(benchmark.dtypes)["item_id"]
    text = F.col("text").cast("string").alias("text")
    own = ws.write(benchmark.select("item_id", text).mapInArrow(item_windows(size), f"item_id {kind}, n long, terms array<long>").withColumn("wid", F.sha2(F.to_json("terms"), 256)), "windows")
    unique = own.select("wid", "n", "terms").dropDuplicates(["wid"])
    indexed = index(ws, docs, unique)
    found = ws.write(phrase_matches(ws, indexed, unique), "matches")
    covered = found.select(*KEY, F.explode(F.expr("sequence(start, start + cast(n as int) - 1)")).alias("pos")).distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_hit"))
    items = own.select("wid", F.col("item_id").cast("string").alias("item")).filter("item is not null").distinct()
    named = found.select(*KEY, "wid").distinct().join(items, "wid").groupBy(*KEY).agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = found.select(*KEY, "start", "n").distinct().groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "n"))).alias("hits"))
    out = indexed.drop("postings").join(covered, KEY, "left").join(named, KEY, "left").join(hits, KEY, "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "fp", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), "hits")
