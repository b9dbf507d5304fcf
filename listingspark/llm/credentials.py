"""Secret scan: fixed patterns, and values in credential contexts judged by the cost of guessing them.

The cost of a value is that of its cheapest segmentation into words, dates, repeats, keyboard walks and brute-force
spans, found by dynamic programming from left to right. Places that already cost as much as a secret are not gone on
from, so that a value of any length takes a few steps more than its first secret part.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingspark.plans.shared import ship_package

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Words that name a credential before a value, wider than the base pattern. After bearer a blank is enough, and a scheme
#: may come before the value.
CONTEXT = re.compile(
    r"(?:(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[ _-]?key|(?:access|private|signing|encryption)[ _-]?key|auth(?:orization)?|bearer)"
    r"[\"']?[\x20\t]*(?::=|[:=]|\x20is\x20)[\x20\t]*[\"']?|bearer[\x20\t]+[\"']?)(?:(?:bearer|basic|digest|token|api-?key)[\x20\t]+[\"']?)?",
    re.IGNORECASE | re.ASCII,
)
#: A value: visible characters up to a quote, a bracket, or a separator before another field's name.
VALUE = re.compile(r"(?:(?![&;,][A-Za-z_][\w.-]*(?:\x20[\w.-]+)?[\"']?[=:])[^\s\"'<>])+", re.ASCII)
#: The fewest characters of a value.
SHORTEST = 8
#: log10 of the guesses from which a value counts as a secret: two less than 8 random characters need, the least length of
#: a value, so that a stretch that looks like a word by chance doesn't hide one.
LEAST_COST = 6.0

# Common words of passwords, the most common first.
WORDS = (
    "password 123456 qwerty letmein welcome admin monkey dragon master login princess sunshine shadow football baseball superman"
    " iloveyou trustno1 hello freedom whatever michael jordan secret summer winter spring autumn flower ninja mustang access"
    " batman killer soccer hockey charlie thomas robert daniel jessica ashley michelle computer internet service server"
    " example sample default change changeme test testing user guest root system private public token bearer value none null true"
    " false string your insert here redacted xxxx hidden please enter the and for you love money house happy lucky star"
    " angel cookie coffee orange banana apple purple yellow silver golden diamond company office manager"
).split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
LONGEST = max(map(len, WORDS))
# Rows of a keyboard and runs of the alphabet and the digits, in which walks are looked up.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "qazwsxedcrfvtgbyhnujmikolp", "abcdefghijklmnopqrstuvwxyz", "0123456789")
NEXT = {(a, b) for row in ROWS for x in (row, row[::-1]) for a, b in zip(x, x[1:], strict=False)}
# Letters that digits and signs stand for.
LEET = str.maketrans("@4301!5$7", "aaeoiisst")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:19|20)?\d\d")
# The letters that follow each letter in words of English, French, German and Spanish.
FOLLOW = dict(
    zip(
        "abcdefghijklmnopqrstuvwxyz",
        "bcdfghiklmnpqrstuvwyz aeiloruysb aehiklorstuyc aeioruydsgl abcdefgimlnopqrstuvwxy aeiflorut aeghilnorsuy aeiotruylnmw abcdefglmnopqrstvzk aeou aeinslyt abcdefikloptusvymg abeimopuyns acdefgiklnostuvyzj abcdefgiklmnoprstuvwy aehiloprstuy u abcdefgiklmnoprstuvyw acehiklmnopqstuwy aehiorstuylwcz abcdefgilmnprstvxyz aeiouyr aehionrsl aeitpc aeilmnopst aeiouzyt".split(),
        strict=True,
    )
)
#: log10 of the guesses for a word of a language that is not in the list; the most letters that one has.
WORD_COST, WORD_LENGTH = 5.0, 24


#: The longest block whose repetition is looked for; a longer one of cheap parts costs what these do.
LONGEST_BLOCK = 64


def word_ends(value: str, low: str, at: int) -> Iterator[int]:
    """Ends of stretches of six letters or more from ``at`` that could be a word: one case after the first letter, or all
    capitals, and letters that follow each other in words."""
    end, n, capitals = at + 1, min(len(value), at + WORD_LENGTH), value[at : at + 2].isupper()
    if not value[at].isalpha():
        return
    while end < n and value[end].isalpha() and value[end].isupper() == capitals and (low[end] in FOLLOW.get(low[end - 1], low[end]) or low[end] > "z"):
        end += 1
        if end - at >= 6:
            yield end


def period_end(value: str, at: int, size: int) -> int:
    """The end of the longest stretch from ``at`` whose characters are those ``size`` places before, compared in slices that
    double in length and then halve."""
    end, step = at + size, 1
    while step:
        same = end + step <= len(value) and value[end : end + step] == value[end - size : end - size + step]
        end += step if same else 0
        step = step * 2 if same else step // 2
    return end


def walk_end(low: str, at: int) -> int:
    end = at + 1
    while end < len(low) and (low[end - 1], low[end]) in NEXT:
        end += 1
    return end


def spans_from(value: str, low: str, plain: str, at: int, ranks: dict[str, int], longest: int) -> Iterator[tuple[int, float]]:
    """(end, log10 of the guesses) of the spans that begin at a place. Walks and repeats are those that can't be made longer
    on either side, so that each is followed once."""
    yield at + 1, 1.0  # brute force: ten guesses a character
    if m := DATE.match(value, at):
        yield m.end(), math.log10(365 * 60) if m.end() - at > 4 else math.log10(60)
    if not at or (low[at - 1], low[at]) not in NEXT:
        end = walk_end(low, at)
        if end - at >= 3:
            yield end, math.log10(40 * (end - at))
    for end in range(at + 3, min(len(value), at + longest) + 1):
        rank = ranks.get(low[at:end]) or ranks.get(plain[at:end])
        if rank:
            yield end, math.log10(rank + 1) + math.log10(2) * (value[at:end] != low[at:end]) + math.log10(2) * (low[at:end] not in ranks)
    for end in word_ends(value, low, at):
        yield end, WORD_COST + math.log10(2) * (value[at:end] != low[at:end])
    for size in range(1, min(LONGEST_BLOCK, (len(value) - at) // 2) + 1):
        # a block that is repeated at once costs itself and the number of its copies
        if value[at] != value[at + size] or (at and value[at - 1] == value[at + size - 1]):
            continue
        k = (period_end(value, at, size) - at) // size
        if size == 1 and k >= 3:
            yield at + k, math.log10(60 * k)
        elif size > 1 and k > 1:
            yield at + k * size, guess_cost(value[at : at + size], math.inf, ranks, longest) + math.log10(k)


def guess_cost(value: str, limit: float = math.inf, ranks: dict[str, int] = RANK, longest: int = LONGEST) -> float:
    """log10 of the guesses that the cheapest segmentation needs, or ``limit`` if that is not less; 0 for an empty value."""
    low = value.lower()
    if len(low) != len(value):
        low = "".join(x if len(x) == 1 else c for c, x in zip(value, map(str.lower, value), strict=True))
    plain = low.translate(LEET)
    best, places = {0: 0.0}, [0]
    while places:
        at = heapq.heappop(places)
        here = best.pop(at)
        if at == len(value):
            return min(here, limit)
        for end, cost in spans_from(value, low, plain, at, ranks, longest):
            if here + cost < min(limit, best.get(end, math.inf)):
                if end not in best:
                    heapq.heappush(places, end)
                best[end] = here + cost
    return limit


def find_spans(text: str, least: float, ranks: dict[str, int] = RANK) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]], int]:
    """(base spans as (start, kind, end), spans that the costs add, base assignments of a cost below ``least``)."""
    base, weak = [], 0
    longest = max(map(len, ranks), default=0)
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 8:
            base.append((m.start(), 0, m.end()))
            weak += guess_cost(m[2], least, ranks, longest) < least
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    # base spans can overlap; the furthest end so far tells whether one reaches a place
    starts = [s for s, _, _ in base]
    reach = list(itertools.accumulate((e for _, _, e in base), max))
    more = []
    named, end = list(CONTEXT.finditer(text)), 0
    for k, m in enumerate(named):
        a = m.end()
        # from places inside a value the same end is met
        if a >= end:
            end = found.end() if (found := VALUE.match(text, a)) else a
        b = end
        # a context inside the value starts a value of its own
        if k + 1 < len(named) and b - named[k + 1].end() >= SHORTEST:
            b = max(a, named[k + 1].start())
        b = a + len(text[a:b].rstrip(".,;:!?)&"))
        # the parts that no base span covers
        before = bisect.bisect_left(starts, a)
        parts, at = [], max(a, reach[before - 1]) if before else a
        for s, _, e in base[before : bisect.bisect_left(starts, b)]:
            parts.append((at, s))
            at = max(at, e)
        parts.append((at, b))
        more += [(x, y) for x, y in parts if y - x >= SHORTEST and guess_cost(text[x:y], least, ranks, longest) >= least]
    return base, more, weak


KINDS = ("assign", "access", "hex", "guess")


def scan(least: float, ranks):
    """ranks: a broadcast of the words' ranks besides the list's; None for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = RANK if ranks is None else ranks.value | RANK
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for text in batch["text"].to_pylist():
                base, more, weak = find_spans(text or "", least, known)
                for k in range(3):
                    out[k].append(sum(kind == k for _, kind, _ in base))
                said = lambda spans: ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)
                out[3].append(hashlib.sha256(said(base).encode()).hexdigest())
                out[4].append(said(sorted([*base, *((a, 3, b) for a, b in more)])))
                out[5].append(len(more))
                out[6].append(weak)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(x, t) for x, t in zip(out, kinds, strict=True)]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "n_weak"])

    return run


#: The most words of a table of ranks that go to the tasks: the lowest ranks, as the others cost like brute force.
MOST_WORDS = 200_000


def find_secrets(docs: DataFrame, *, least_cost: float = LEAST_COST, words: DataFrame | None = None) -> DataFrame:
    """Secrets in each whole text.

    Returns doc_id, n_assign, n_access, n_hex (base spans by kind), base_sha256, spans (all as kind:start:end, code
    points, end exclusive), n_guess (spans that the guess cost adds: values of at least ``least_cost`` decimal digits of
    guesses in a credential context, or the part of one that no base span covers) and n_weak (base assignments of lower cost, such as
    placeholders; they stay). words: (word, rank), lower-case words of three letters or more and their place among the
    most common ones, used besides the built-in list, up to ``MOST_WORDS`` of them. One row per input row; null text counts as empty; repeated rows give repeated results;
    empty input: empty result. Other columns are ignored."""
    ship_package(docs.sparkSession)
    df = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ranks = None
    if words is not None:
        few = words.filter("word is not null and rank is not null and length(word) >= 3").orderBy("rank", "word").limit(MOST_WORDS)
        ranks = docs.sparkSession.sparkContext.broadcast({r["word"]: int(r["rank"]) for r in few.collect()})
    return df.mapInArrow(scan(least_cost, ranks), f"doc_id {dict(docs.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, n_weak long")
