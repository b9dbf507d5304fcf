"""Hard negatives, aligned tokens and the n-gram join against plain Python on small tables, and their odd cases."""

from __future__ import annotations

import functools
import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from listingspark.llm import alignment, hard_negatives, ngram_join

from . import brute


# 11
def vectors(seed, n=260, dim=8, size=1.0):
    r = random.Random(seed)
    out = [(i * 5 % 1300, [r.uniform(-size, size) + (i % 4) * size / 3 for _ in range(dim)], r.randrange(4)) for i in range(n)]
    return out + [(3, out[0][1], 1), (7, out[0][1], 1), (11, None, 1), (12, [1.0] * dim, None), (13, [math.nan] * dim, 2), (14, [math.inf] * dim, 2), (16, [None] * dim, 2)]


def mined(rows, positives=5, negatives=10):
    """The contract by plain loops."""
    ok = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, av, al in ok:
        if a % 100:
            continue
        score = sorted((-sum(x * y for x, y in zip(av, v, strict=True)), i, c) for i, v, c in ok if len(v) == len(av))
        for s, p, _ in [x for x in score if x[2] == al and x[1] != a][:positives]:
            hard = [x for x in score if x[2] != al and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(a, p, k, i, -s, -t) for k, (t, i, _) in enumerate(hard, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("seed, size", [(1, 1.0), (2, 30.0), (3, 3e6), (4, 1e-3)])
def test_negatives(spark, monkeypatch, seed, size):
    """Blocks of a few rows and anchors; components from a few bits to more than two of them fit in 64."""
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    rows = vectors(seed, size=size)
    out = hard_negatives.mine_hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("vec_id") % 100 == 0).collect()
    want = mined(rows)
    assert sorted(map(tuple, out)) == want and (size < 0.1 or len(want) > 50)


def test_negatives_of_ties_and_few(spark):
    same = [(i, [0.5, 0.25], i % 2) for i in range(40)]
    got = sorted(map(tuple, hard_negatives.mine_hard_negatives(spark.createDataFrame(same, VECTORS), F.col("vec_id") == 0, high=100).collect()))
    assert got == sorted((0, p, k, 2 * k - 1, 20480, 20480) for p in (2, 4, 6, 8, 10) for k in range(1, 11))


def test_negatives_odd(spark):
    rows = spark.createDataFrame([(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (2, [1.0], 1), (3, [1.0, 0.0], 1), (4, [0.5, 0.0], 2), (5, [], 2), (200, [], 2), (6, [], 2), (None, [1.0, 0.0], 2)], VECTORS).withColumns({c: F.lit(7) for c in ("id", "dim", "asks", "rows", "anchors", "n", "start")})
    got = sorted(map(tuple, hard_negatives.mine_hard_negatives(rows, F.col("vec_id") % 100 == 0).collect()))
    assert got == [(100, 3, 1, 4, 65536, 32768)]
    assert hard_negatives.mine_hard_negatives(rows.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine_hard_negatives(rows, F.lit(None).cast("boolean")).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("top", [0, 1, 5, 300, 10**6, 2**28, 2**40])
def test_packed_products(top):
    r = random.Random(top)
    kind = np.int64 if top < 2**31 else object
    rows, anchors = (np.array([[r.randint(-top, top) for _ in range(7)] for _ in range(n)], kind) for n in (23, 5))
    packed = hard_negatives.Packed(rows, hard_negatives.size_sums(anchors))
    assert packed.fields > 1 or top >= 10**6
    want = [[sum(int(x) * int(y) for x, y in zip(a, v, strict=True)) for v in rows] for a in anchors]
    assert packed.scores(anchors).tolist() == want


def test_packed_products_at_the_edges():
    """Fields that are full to the last bit on one side and empty on the other."""
    rows = np.array([[127] * 3, [-128] * 3, [0] * 3, [-128, 127, -128]], np.int64)
    anchors = np.array([[255] * 3, [-255] * 3, [255, -255, 255], [0] * 3], np.int64)
    assert (hard_negatives.Packed(rows, 765).scores(anchors) == anchors @ rows.T).all()


# 12
@functools.cache
def whole_coders():
    own = tokenizers.Tokenizer.from_file(alignment.A_PATH)
    own.encode_special_tokens = True
    return own, sentencepiece.SentencePieceProcessor(model_file=alignment.B_PATH)


def aligned(texts):
    """The contract with the libraries on whole texts and plain loops."""
    own, pieces = whole_coders()
    letters = alignment.byte_letters()
    found = []
    for t in texts:
        if not t:
            found.append(None)
            continue
        raw = (" " + t).encode()
        e = own.encode(" " + t, add_special_tokens=False)
        a = [(i, bytes(letters[c] for c in w)) for i, w in zip(e.ids, e.tokens, strict=True)]
        b = [(i, bytes([int(w[3:5], 16)]) if pieces.is_byte(i) else w.replace("▁", " ").encode()) for i, w in ((i, pieces.id_to_piece(i)) for i in pieces.encode(t))]
        found.append((a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else None)
    rows, held = [], Counter()
    for both in found:
        if both is None:
            rows.append(None)
            continue
        spans = []
        for tokens in both:
            at, own_spans = 0, []
            for i, x in tokens:
                own_spans.append((at, at := at + len(x), i))
            spans.append(own_spans)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        start, groups, links = 0, [], []
        for end in ends:
            a, b = ([s for s in x if start <= s[0] and s[1] <= end] for x in spans)
            groups.append(",".join(str(s[2]) for s in a) + "|" + ",".join(str(s[2]) for s in b))
            links += [(x[2], y[2]) for x in a for y in b if max(x[0], y[0]) < min(x[1], y[1])]
            start = end
        rows.append((len(spans[0]), len(spans[1]), len(groups), links, ";".join(groups)))
        held.update(set(links))
    most = defaultdict(int)
    for (a, _), k in held.items():
        most[a] = max(most[a], k)
    zero = (0, 0, 0, 0, 0, 0, "")
    return [zero if r is None else (*r[:3], len(r[3]), sum(held[x] == most[x[0]] for x in r[3]), sum(held[x] for x in r[3]), brute.sha(r[4])) for r in rows]


ODD_TEXTS = [
    None, "", " ", "   ", "a", " a", "a  b\n c", "x \n  y\t\tz  ", "<|endoftext|> <s> </s> <unk>", "naïve café œuvre — “quoted” … 東京 に 行く", "a  b 　c  d \x85 e \x1c f\x7f g", "U+2581 is ▁ here", "\x00\x01 zero", "👍🏽 emoji 👨‍👩‍👧 family",
    "don't we'll I'M they've 's 't", "1234567890 12 345,67 0x1F", "aaaa" * 50, "é" * 40, "\n\n\n", "tail   ", "ﬁ ligature Ａ full width ² half ½", "é combining", "​ zero width ﻿ bom", "Привет мир как дела", "\r\n crlf \r\n",
]
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def collected(df):
    return {r["doc_id"]: tuple(r[c] for c in NAMES) for r in df.collect()}


@pytest.mark.parametrize("long", [1 << 16, 20])
def test_alignment(spark, long):
    """All texts in one task each, and those of more than 20 characters in segments that are composed by a tree."""
    texts = ODD_TEXTS + [r[1] for r in brute.corpus(5, 40)] + [" ".join(random.Random(3).choice(["the", "Größe", "d'été,", "x_y", "(a)", " ", "\n"]) for _ in range(3000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = collected(alignment.align_documents(df, long=long, segment=100))
    assert got == dict(enumerate(aligned(texts)))


def test_alignment_of_given_texts(spark):
    """Documents of four languages, pages and chats against the libraries on whole texts."""
    sf = "/root/testdata/sf0.001"
    texts = [r[0] for t, c in (("documents", "text"), ("pages", "html"), ("conversations", "text")) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(c).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert collected(alignment.align_documents(df, long=5000, segment=1000)) == dict(enumerate(aligned(texts)))


def coders():
    return alignment.byte_coder(alignment.A_PATH), alignment.piece_coder(alignment.B_PATH)


def finish(f):
    """Groups and pairs of the fragment of a whole text."""
    text, pairs = alignment.closed(f.head_a, f.head_b, *coders())
    return text + f.text, alignment.merged(pairs, f.pairs), f.n_a, f.n_b, f.tail_a, f.tail_b


def test_fragments_are_a_monoid():
    """Any cuts of the bytes, composed in any grouping, give the fragment of the whole."""
    first, second = coders()
    r = random.Random(6)
    for text in (" the naïve Größe d'été (unbelievable) 12345 xyzzyx", " " + "zxqj" * 40, " 東京 tower — internationalisation"):
        raw = text.encode()
        (a, _, _), (b, _, _) = (alignment.encoded(c, [text], [raw]) for c in (first, second))
        a_ends, b_ends = np.cumsum(first.lengths[a]), np.cumsum(second.lengths[b])
        whole = alignment.fragment(a, b, a_ends, b_ends, first, second)
        assert not whole.tail_a and not whole.tail_b
        for _ in range(30):
            cuts = [0, *sorted(r.sample(range(1, len(raw)), r.randint(1, 12))), len(raw)]
            parts = []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                i, j = (np.searchsorted(e, [lo, hi], "right") for e in (a_ends, b_ends))
                parts.append(alignment.fragment(a[i[0] : i[1]], b[j[0] : j[1]], a_ends[i[0] : i[1]], b_ends[j[0] : j[1]], first, second))
            while len(parts) > 1:
                k = r.randrange(len(parts) - 1)
                parts[k : k + 2] = [alignment.compose(parts[k], parts[k + 1], first, second)]
            assert finish(parts[0]) == finish(whole)
        assert alignment.compose(alignment.EMPTY, whole, first, second) == whole == alignment.compose(whole, alignment.EMPTY, first, second)


def test_stretches_are_told_apart(monkeypatch):
    """Texts of equal hashes are compared, so that they stay apart."""
    buf = np.frombuffer(b" ab cd ab ef", np.uint8)
    starts, ends = np.array([0, 3, 6, 9]), np.array([3, 6, 9, 12])
    ones, which = alignment.distinct(buf, starts, ends)
    assert len(ones) == 3 and which[0] == which[2] and len(set(which.tolist())) == 3
    monkeypatch.setattr(alignment, "mix", lambda x, salt=0: np.zeros(len(x), np.uint64))
    ones, which = alignment.distinct(buf, starts, ends)
    assert [bytes(buf[starts[ones[w]] : ends[ones[w]]]) for w in which] == [b" ab", b" cd", b" ab", b" ef"]


def test_a_segment_with_other_bytes_spoils_its_text(spark):
    texts = ["plain words " * 30 + "▁ " + "more words " * 30, "plain words " * 60]
    got = collected(alignment.align_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), long=10, segment=50))
    assert got == dict(enumerate(aligned(texts))) and got[0][0] == 0 < got[1][0]


def test_coders_differ_in_nothing_from_the_library(monkeypatch):
    by_rank = alignment.byte_coder(alignment.A_PATH)
    monkeypatch.setattr(alignment.itertools, "pairwise", lambda x: [(1, 0)])
    by_merges = alignment.byte_coder.__wrapped__(alignment.A_PATH)
    texts = [f" {t}" for t in ODD_TEXTS if t]
    assert by_rank.encode(texts) == by_merges.encode(texts)


def test_alignment_odd(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "at", "pairs", "spaced", "fp")})
    out = alignment.align_documents(df).collect()
    assert sorted((r["doc_id"] or 0, r["n_a"], r["count_sum"]) for r in out) == [(0, 2, 6), (1, 2, 6), (1, 2, 6), (2, 0, 0)]
    assert alignment.align_documents(df.limit(0)).count() == 0


def test_texts_are_cut_in_blocks():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (10, 0, 3 * alignment.AT_ONCE, 5, alignment.AT_ONCE // 2, alignment.AT_ONCE // 2 + 1)])], ["t"])
    assert [p.num_rows for p in alignment.blocks_of(batch, "t")] == [2, 1, 2, 1]


# 13
def joined(rows, size, percent):
    sets = [(i, brute.shingles(t, size)) for i, t in rows]
    ids = sorted({i for i, _ in sets})
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, (a, s) in enumerate(sets):
        for b, t in sets[x + 1 :]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return {i: (len(s), min(j for j, t in sets if t == s) if s else i, top(i)) for i, s in sets}


def near_copies(seed, n, edits, words=120):
    r = random.Random(seed)
    base, out = [f"b{k}" for k in range(words)], []
    for i in range(n):
        w = list(base)
        for _ in range(r.choice(edits)):
            w[r.randrange(words)] = f"e{r.randrange(40 if i % 2 else 10**6)}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("percent, size, edits, stars", [(90, 3, [0, 1, 1, 2, 2, 3, 4], 2), (90, 3, [2, 3, 4], 1), (60, 2, [5, 9, 14], 2), (100, 3, [0, 1], 1)])
def test_join(spark, percent, size, edits, stars):
    rows = near_copies(percent + size + len(edits), 90, edits) + [(200 + i, t) for i, t, *_ in brute.corpus(9, 60)] + [(400, "a b"), (401, "A  B"), (402, "a"), (403, None), (404, ""), (405, " \t")]
    out = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shingle=size, percent=percent, stars=stars).collect()
    want = joined(rows, size, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["class_id"], r["component_id"]) for r in out} == want
    assert len({w[2] for w in want.values()}) < len(want) - 5


def test_filters_keep_all_similar_pairs():
    """The first common n-gram of any similar pair is in both prefixes and passes every filter, and the filters are of use."""
    r, cut, seen = random.Random(2), 0, 0
    for _ in range(400):
        n, percent = r.randint(3, 60), r.choice([60, 75, 90])
        universe = list(range(n + 30))
        x, y = set(r.sample(universe, n)), set()
        y = (x - set(r.sample(sorted(x), r.randint(0, max(1, n // 6))))) | set(r.sample(universe, r.randint(0, 4)))
        counts = {g: 2 + g % 5 for g in universe} | {g: 1 for g in x ^ y if r.random() < 0.5}
        posted = []
        for s in (x, y):
            shared = [{"f": counts[g], "h": g} for g in s if counts[g] > 1]
            batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([len(s)]), pa.array([shared], pa.list_(pa.struct([("f", pa.int64()), ("h", pa.int64())])))], ["cls", "n", "shared"])
            posted.append([p for b in ngram_join.prefixes(percent)([batch]) for p in b.to_pylist()])
        similar = 100 * len(x & y) >= percent * len(x | y)
        common = [(p, q) for p in posted[0] for q in posted[1] if p["h"] == q["h"]]
        seen += similar
        assert not similar or common
        if common:
            p, q = min(common, key=lambda z: z[0]["pos"])
            need = -(-percent * (len(x) + len(y)) // (100 + percent))
            differ = sum(((p[s] ^ q[s]) & (2**64 - 1)).bit_count() for s in ngram_join.SIGN_NAMES)
            ok = min(p["after"], q["after"]) + 1 >= need and min(len(x) - p["pos"], len(y) - q["pos"]) + 1 >= need and p["after"] + q["after"] - differ >= 2 * (need - 1)
            assert ok or not similar
            cut += not ok
    assert seen > 50 and cut > 20


def test_join_odd(spark):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(1, text), (1, "other words here now"), (1, text), (2, text + " z"), (None, text), (None, None), (3, "x " * 30000), (4, "x " * 29000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("cls", "h", "n", "some", "label", "fp", "first")})
    got = sorted(((r["doc_id"], r["n_shingles"], r["class_id"], r["component_id"]) for r in ngram_join.similar_groups(df).collect()), key=str)
    assert got == sorted([(1, 48, 1, 1), (1, 48, 1, 1), (1, 2, 1, 1), (2, 49, 2, 1), (None, 48, None, None), (None, 0, None, None), (3, 1, 3, 3), (4, 1, 3, 3)], key=str)
    assert ngram_join.similar_groups(df.limit(0)).count() == 0


def test_parts_keep_all_similar_pairs():
    """Only a part of large sets' n-grams is counted for the order; the first common key of any similar pair is posted by both
    all the same, by sets on either side of the border and by those whose part is shorter than their prefix."""
    r, seen, short = random.Random(5), 0, 0
    percent, counted, total = 90, 0, 0
    for _ in range(300):
        n = r.choice([r.randint(9, 40), r.randint(85, 125), r.randint(101, 300)])
        x = set(r.sample(range(2**62), n))
        gone = r.randint(0, n // 15)
        sets = [x, (x - set(r.sample(sorted(x), gone))) | set(r.sample(range(2**62), r.randint(0, n // 30)))]
        if r.random() < 0.4:  # nearly nothing of the sets is in the part
            keep = [np.array(sorted(s), np.uint64) for s in sets]
            outside = [ngram_join.mix(k, 77) % np.uint64(4) != 0 for k in keep]
            sets = [set(k[o].tolist()) for k, o in zip(keep, outside, strict=True)]
        if min(map(len, sets)) < 9:
            continue
        sizes = [len(s) for s in sets]
        flags = [[k <= ngram_join.SMALL for k in sizes], [100 * k >= 90 * (ngram_join.SMALL + 1) for k in sizes]]
        batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), *map(pa.array, flags), pa.array([sorted(s) for s in sets], pa.list_(pa.int64()))], ["cls", "as_small", "as_large", "items"])
        keys = [(p["cls"], p["h"]) for b in ngram_join.part_items(percent)([batch]) for p in b.to_pylist()]
        if min(sizes) > ngram_join.SMALL:
            counted, total = counted + len(keys), total + sum(sizes)
        freq = {h: 2 + h % 5 for _, h in keys}
        both = {h for c, h in keys if c == 0} & {h for c, h in keys if c == 1}
        rows = [o for b in ngram_join.part_outlines(percent)([batch]) for o in b.to_pylist()]
        short += any(o["more"] for o in rows)
        shared = [[{"f": freq[h], "h": h} for c, h in keys if c == o["cls"] and h & 1 == o["small"] and h in both] for o in rows]
        columns = [pa.array([o[k] for o in rows], t) for k, t in zip(ngram_join.PART_OUTLINE.names, ngram_join.PART_OUTLINE.types, strict=True)]
        whole = pa.RecordBatch.from_arrays([*columns, pa.array(shared, pa.list_(pa.struct([("f", pa.int64()), ("h", pa.int64())])))], [*ngram_join.PART_OUTLINE.names, "shared"])
        posted = [p for b in ngram_join.prefixes(percent)([whole]) for p in b.to_pylist()]
        a, b = ({p["h"]: p for p in posted if p["cls"] == c} for c in (0, 1))
        if sets[0] == sets[1] or 100 * len(sets[0] & sets[1]) < percent * len(sets[0] | sets[1]):
            continue
        seen += 1
        need = -(-percent * sum(sizes) // (100 + percent))
        passed = 0
        for h in a.keys() & b.keys():
            p, q = a[h], b[h]
            differ = sum(((p[s] ^ q[s]) & (2**64 - 1)).bit_count() for s in ngram_join.SIGN_NAMES)
            passed += min(p["after"], q["after"]) + 1 >= need and min(sizes[0] - p["pos"], sizes[1] - q["pos"]) + 1 >= need and p["after"] + q["after"] - differ >= 2 * (need - 1)
        assert passed
    assert seen > 80 and short > 20 and counted < 0.35 * total


def test_texts_of_other_sets_are_not_joined(spark):
    """All wanted rows and few others are left before texts are shuffled."""
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("fp"), F.lit("t").alias("text"))
    wanted = docs.filter("doc_id % 10 = 3").drop("text")
    got = [r["doc_id"] for r in ngram_join.likely_in(docs, wanted).collect()]
    assert len(set(got)) == len(got) and set(range(3, 20000, 10)) <= set(got) and len(got) < 2000 + 18000 / 8
    assert ngram_join.likely_in(docs, wanted.limit(0)).count() == 0
    assert ngram_join.likely_in(docs.unionByName(docs), wanted.limit(1)).filter("doc_id % 10 = 3").count() >= 2
