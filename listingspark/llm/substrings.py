"""Substring dedup: every 50-word window that an earlier document has is removed.

Windows are compared by Rabin-Karp hashes of 64 + 32 bits. Two equal windows have the same least hash among their
16-word parts, so a window can only be repeated if its least part is in two documents. Least parts change slowly along
a text (one in about 18 words) and are counted first; the windows over repeated parts are then counted themselves.
Whole copies are found by a hash of all words and need no windows. No window that may be repeated is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingspark.plans.shared import Workspace

from .hot import hot_keys, salted_join
from .tokens import SPACED, Words, mix, sliding_min, tokenize, windows

PART = 16
KEY = ["doc_id", "fp"]


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def lists(values: pa.Array, rows: np.ndarray, n: int) -> pa.ListArray:
    """values by row (rows ascending) as a list for each of n rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), values)


def least_parts(w: Words, size: int) -> np.ndarray:
    """For each window of ``size`` words, the least hash of its parts."""
    parts, _ = windows(w, min(PART, size))
    return sliding_min(parts, size - min(PART, size) + 1)[: max(0, len(w.hashes) - size + 1)]


def joined_sha256(w: Words, a: int, b: int, keep: np.ndarray | None = None) -> str:
    """SHA-256 of words a to b (those that ``keep`` marks), joined by one space."""
    at = range(a, b) if keep is None else (np.flatnonzero(keep) + a)
    data = w.buf.tobytes() if len(w.buf) < 4096 else memoryview(w.buf)
    return hashlib.sha256(b" ".join([bytes(data[w.starts[i] : w.ends[i]]) for i in at])).hexdigest()


def row_sha256(text: str | None) -> str:
    return hashlib.sha256(b" ".join((text or "").encode("utf-8", "surrogatepass").split())).hexdigest()


def summaries(size: int):
    """doc_id, fp, text -> doc_id, fp, n_words, sha, words (hash of all words), parts (distinct least parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                w = tokenize(batch["text"], SPACED)
                least = least_parts(w, size)
                docs = w.docs[: len(least)]
                ok = w.docs[size - 1 :] == docs
                least, docs = least[ok], docs[ok]
                new = np.ones(len(least), bool)
                new[1:] = (least[1:] != least[:-1]) | (docs[1:] != docs[:-1])
                place = np.arange(len(w.hashes)) - w.first[w.docs] if len(w.hashes) else np.zeros(0, np.int64)
                with np.errstate(over="ignore"):
                    terms = mix(w.hashes ^ mix(place.astype(np.uint64), 5), 6)
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
                    all_words = sums[w.first[1:]] - sums[w.first[:-1]]
                n = np.diff(w.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"],
                        batch["fp"],
                        pa.array(n),
                        pa.array([row_sha256(t) for t in batch["text"].to_pylist()]),
                        as_long(all_words),
                        lists(as_long(least[new]), docs[new], batch.num_rows),
                    ],
                    ["doc_id", "fp", "n_words", "sha", "words", "parts"],
                )

    return run


def candidate_windows(size: int):
    """doc_id, fp, text, parts (the repeated ones) -> doc_id, fp, pos, h, g of the windows over them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                w = tokenize(batch["text"], SPACED)
                least = least_parts(w, size)
                if not len(least):
                    continue
                h, ok = windows(w, size)
                g, _ = windows(w, size, 9)
                docs = w.docs[: len(h)]
                # repeated parts of each row, mixed with the row so that one lookup serves the batch
                own = batch["parts"]
                rows = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(own.offsets)))
                wanted = np.asarray(own.flatten()).view(np.uint64)
                tag = lambda x, d: mix(x ^ mix(d.astype(np.uint64), 7), 8)
                hit = ok & np.isin(tag(least, docs), tag(wanted, rows))
                row = pa.array(docs[hit])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].take(row),
                        batch["fp"].take(row),
                        pa.array((np.flatnonzero(hit) - w.first[docs[hit]]).astype(np.int32)),
                        as_long(h[hit]),
                        pa.array((g[hit] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)),
                    ],
                    ["doc_id", "fp", "pos", "h", "g"],
                )

    return run


def cut_out(size: int):
    """doc_id, fp, text, places (starts of repeated windows, any order) -> doc_id, fp, n_removed, kept_sha256,
    removed (maximal intervals of word numbers, end exclusive), kept (the words left)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, places in zip(batch["text"].to_pylist(), batch["places"], strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                starts = np.unique(np.asarray(places.values)) if places.values is not None else np.zeros(0, int)
                edge = np.flatnonzero(np.diff(starts, prepend=-size - 1) > size)
                begin, end = starts[edge], starts[np.append(edge[1:] - 1, len(starts) - 1)[: len(edge)]] + size
                gone = np.zeros(len(words) + 1, np.int32)
                np.add.at(gone, begin, 1)
                np.add.at(gone, end, -1)
                keep = np.cumsum(gone)[: len(words)] == 0
                kept = b" ".join([words[i] for i in np.flatnonzero(keep)])
                out[0].append(int(len(words) - keep.sum()))
                out[1].append(hashlib.sha256(kept).hexdigest())
                out[2].append([{"start": int(a), "end": int(b)} for a, b in zip(begin, end, strict=True)])
                out[3].append(kept.decode("utf-8", "replace"))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["fp"], pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], span), pa.array(out[3], pa.string())], ["doc_id", "fp", "n_removed", "kept_sha256", "removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, *, size: int = 50, texts: bool = False) -> DataFrame:
    """Words of each text that a window of ``size`` words covers which also starts in a document of smaller doc_id.

    Returns doc_id, n_words, n_removed, kept_sha256, removed (maximal intervals of word numbers, end exclusive) and, with
    ``texts``, kept (the words left, joined by one space; null where nothing was removed). One row per input row.

    Null or empty text: no words. Null doc_id: neither removed from nor a reason to remove. Rows of equal doc_id are one
    document: none is earlier than the other. Texts below ``size`` words have no window. Empty input: empty
    result. Other columns are ignored."""
    spark = docs.sparkSession
    ws = Workspace(spark, "substrings")
    text = F.col("text").cast("string")
    df = docs.select("doc_id", F.xxhash64(text).alias("fp"), text.alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    rows = ws.write(df.mapInArrow(summaries(size), f"doc_id {kind}, fp long, n_words long, sha string, words long, parts array<long>"), "summaries")
    # whole copies: an earlier document has all their words in order, so each of their windows starts there too and one hash
    # decides what window by window would come out the same. The texts that have copies are written, so that a text with
    # very many is dealt among several tasks
    firsts = rows.filter(f"doc_id is not null and n_words >= {size}").groupBy("words", "n_words").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    firsts = ws.write(firsts.filter("first < last").drop("last"), "firsts")
    rows = ws.write(rows.join(firsts, ["words", "n_words"], "left").withColumn("copy", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))).drop("first", "words"), "copies")
    # parts in two documents or more
    parts = rows.filter("not copy and doc_id is not null").select(*KEY, F.explode("parts").alias("part"))
    repeated = parts.groupBy("part").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("n")).filter("a < b").select("part", "n")
    repeated = ws.write(repeated, "repeated")
    # no more parts or windows than words
    total = rows.filter("not copy").agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    wanted = salted_join(parts, repeated.select("part"), ["part"], hot_keys(repeated, ["part"], "n", total)).groupBy(*KEY).agg(F.collect_set("part").alias("parts"))
    some = ws.write(df.join(wanted, KEY).dropDuplicates(KEY), "candidates")
    found = some.select(*KEY, "text", "parts").mapInArrow(candidate_windows(size), f"doc_id {kind}, fp long, pos int, h long, g int")
    least = found.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("first < last").drop("last")
    least = ws.write(least, "least")
    later = salted_join(found, least.drop("n"), ["h", "g"], hot_keys(least, ["h", "g"], "n", total)).filter("doc_id > first")
    places = later.groupBy(*KEY).agg(F.collect_list("pos").alias("places"))
    cut = some.select(*KEY, "text").join(places, KEY).mapInArrow(
        cut_out(size), f"doc_id {kind}, fp long, n_removed long, kept_sha256 string, removed array<struct<start:long,end:long>>, kept string"
    )
    if not texts:
        cut = cut.drop("kept")
    cut = ws.write(cut, "cut")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    out = rows.drop("parts").join(cut, KEY, "left").select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(F.col("copy"), whole).otherwise(F.coalesce("removed", F.slice(whole, 1, 0))).alias("removed"),
        *([F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept")).alias("kept")] if texts else []),
    )
    return out
