"""The operators' results by plain Python, for small tables."""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def corpus(seed, n=60):
    """(doc_id, text, lang, source, n_chars) with copies, near copies, shared passages, repeated rows, nulls."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["Über", "ÉTÉ", "naïve,", "THE", "the"]
    line = lambda k: " ".join(r.choice(vocab) for _ in range(k)) + "."
    passage, common = line(70), [line(9), line(8), line(7)]
    rows = []
    for i in range(n):
        kind = r.random()
        parts = [line(r.randint(3, 25)) for _ in range(r.randint(1, 8))]
        if kind < 0.2 and rows:
            text = r.choice(rows)[1]
            if text and r.random() < 0.6:
                w = text.split(" ")
                for _ in range(r.randint(1, 3)):
                    w[r.randrange(len(w))] = r.choice(vocab)
                text = " ".join(w)
        elif kind < 0.3:
            text = "\n".join([*parts, passage, *parts[:1]])
        elif kind < 0.45:
            at = r.randint(0, len(parts))
            text = "\n".join([*parts[:at], *common[: r.randint(1, 3)], *parts[at:]])
        elif kind < 0.5:
            text = r.choice([None, "", "   \n\t", "one", "one two three", "\n\nÀ\n"])
        else:
            text = "\n".join(parts)
        rows.append((i * 3 - 20, text, "en", r.choice(["a", "b", "c", None]), len(text or "")))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def statistics(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, hit = Counter(tri), set()
    for i, t in enumerate(tri):
        if count[t] > 1:
            hit.update(range(i, i + 3))
    return len(w), sum(map(len, w)), sum((text or "").count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def repeats(rows, size=50):
    first = {}
    for i, text, *_ in rows:
        w = words(text)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, text, *_ in rows:
        w, gone = words(text), set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def shingles(text, k=5):
    w = words(folded(text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near(rows, percent=75):
    sets = {i: shingles(t) for i, t, *_ in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def line_dedup(rows, min_lines=2, min_words=None):
    """Runs of ``min_lines`` lines lose their later copies, and those of fewer that have ``min_words`` words."""
    at = {i: [(k, x) for k, x in enumerate((t or "").split("\n")) if words(x)] for i, t, *_ in rows}
    lengths = [min_lines] if min_words is None else range(1, min_lines + 1)
    runs = {i: [(p, tuple(x for _, x in v[p : p + n])) for n in lengths for p in range(len(v) - n + 1)] for i, v in at.items()}
    first, out = {}, {}
    for i in sorted(runs):
        for p, run in runs[i]:
            first.setdefault(run, (i, p))
    for i, t, *_ in rows:
        gone = {k for p, run in runs[i] if first[run] != (i, p) and (len(run) == min_lines or sum(len(words(x)) for x in run) >= min_words) for k, _ in at[i][p : p + len(run)]}
        out[i] = (len(at[i]), len(gone), None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone))
    return out


def longest_runs(rows):
    """((doc_id, lines), lines of the longest run that stands elsewhere too); rows of equal doc_id and text count once."""
    texts = sorted({(i, t or "") for i, t, *_ in rows})
    at = [[x for x in t.split("\n") if words(x)] for _, t in texts]
    live, best, n = [(d, p) for d, v in enumerate(at) for p in range(len(v))], [0] * len(at), 1
    while live:
        seen = Counter(tuple(at[d][p : p + n]) for d, p in live)
        live = [(d, p) for d, p in live if seen[tuple(at[d][p : p + n])] > 1]
        for d, _ in live:
            best[d] = n
        n += 1
        live = [(d, p) for d, p in live if p + n <= len(at[d])]
    return [((i, len(v)), k) for (i, _), v, k in zip(texts, at, best, strict=True)]


def leaks(rows, items, size=10):
    alnum = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(t))
    wins = defaultdict(set)
    for item, text in items:
        w = alnum(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            wins[tuple(w[k : k + size])].add(item)
    out = {}
    for i, t, *_ in rows:
        w, hit, found = alnum(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[key]
        out[i] = (len(w), len(hit), sorted(str(x) for x in found if x is not None))
    return out


def near_terms(rows, items, share, slack):
    """(doc_id, item_id) -> place and number of different terms of the densest stretch, where they are enough."""
    alnum = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(t))
    out = {}
    for item, text in items:
        own = alnum(text)
        if item is None or not own:
            continue
        need, span = -(-len(set(own)) * round(share * 100) // 100), -(-len(own) * round(slack * 100) // 100)
        for i, t, *_ in rows:
            at = [(p, x) for p, x in enumerate(alnum(t)) if x in set(own)]
            best = max(((len({x for q, x in at if p <= q < p + span}), -p) for p, _ in at), default=(0, 0))
            if best[0] >= need:
                out[i, item] = (-best[1], best[0])
    return out


def sha1_base32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def secrets(text):
    out = []
    for m in re.finditer(r"(?a:([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))", text or ""):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    for k, p, n in ((1, r"AKIA[A-Z0-9]+", 16), (2, r"[0-9a-f]+", 32)):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text or "") if len(m[0]) >= n]
    return sorted(out)
