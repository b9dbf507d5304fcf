"""Quality rules: decision lists learned by sequential covering over threshold conjunctions.

Statistics of whole texts are Column expressions. Rules are grown one threshold at a time by information gain,
pruned on held-out rows, and emitted as an ordered chain of Spark ``when`` expressions. Each learning step is
one aggregate over the labelled rows; the driver sees only counts for each (feature, threshold).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingspark.plans.shared import Workspace

from .text import has_word, uniform, words

#: Fixed values of the base statistics and of the base test.
SYMBOLS = "#*$%&|<>"
WINDOW = 3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Ratios that rules may test: name, numerator, denominator.
RATIOS = (
    ("word_length", "word_chars", "n_words"),
    ("symbol_share", "n_symbols", "n_words"),
    ("shout_share", "n_shouts", "n_words"),
    ("upper_share", "n_upper", "word_chars"),
    ("digit_share", "n_digits", "word_chars"),
    ("dup_line_share", "n_dup_lines", "n_lines"),
    ("repeat_share", "n_repeat_words", "n_words"),
    ("words_a_line", "n_words", "n_lines"),
)


def text_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and the counts of each whole text. Null text counts as empty: all counts 0.

    n_repeat_words: words in windows of three that occur twice or more in the text. Windows are compared by a
    64-bit hash within their text; they are sorted with their place, equal neighbours marked and the marked
    places' spans added up, in n log n steps for a text of any length."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    df = docs.select(*keep, docs["text"].cast("string").alias("_text")).withColumn("_w", words(F.col("_text")))
    lines = F.filter(F.split(text, "\n"), has_word)
    df = df.select(
        *keep,
        "_w",
        F.size("_w").alias("n_words"),
        F.length(F.array_join("_w", "")).alias("word_chars"),
        without(SYMBOLS).alias("n_symbols"),
        without("!?").alias("n_shouts"),
        without("0123456789").alias("n_digits"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).alias("n_upper"),
        lines.alias("_l"),
    )
    df = df.withColumn("n_lines", F.size("_l")).withColumn("n_dup_lines", F.size("_l") - F.size(F.array_distinct("_l"))).drop("_l")
    w = F.col("_w")
    hashes = F.transform(F.slice(w, 1, F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    df = df.withColumn("_h", hashes).drop("_w")
    h = F.col("_h")
    placed = F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    df = df.withColumn("_s", placed).drop("_h")
    s = F.col("_s")
    same = lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
    df = df.withColumn("_p", F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))).drop("_s")
    p = F.col("_p")
    spans = F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(WINDOW), x - F.get(p, i - 1)), F.lit(WINDOW)))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(spans, F.lit(0), lambda a, b: a + b), F.lit(0))).drop("_p")
    counts = [c for c in df.columns if c not in keep]
    return df.select(*keep, *[F.col(c).cast("long").alias(c) for c in counts])


def ratios() -> list[Column]:
    return [F.when(F.col(below) > 0, F.col(above) / F.col(below)).otherwise(F.lit(0.0)).alias(name) for name, above, below in RATIOS]


@dataclass(frozen=True)
class Test:
    """One threshold of a rule."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= F.lit(self.threshold) if self.above else c < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Test, ...]


def all_of(rule: Rule) -> Column:
    out = F.lit(True)
    for test in rule:
        out = out & test.column()
    return out


def learn_decision_list(
    labelled: DataFrame,
    features: list[str],
    label: str,
    *,
    thresholds: int = 32,
    max_rules: int = 8,
    max_tests: int = 4,
    min_precision: float = 0.9,
    min_cover: int = 3,
    max_rows: int = 200_000,
    seed: int = 5,
) -> list[Rule]:
    """Rules for the rows whose ``label`` is true, in order; a row that no rule covers is of the other class.

    labelled: the features (double), label (boolean) and ``doc_id``. max_rows bounds the fitting sample: above it a
    fraction is taken by a hash of doc_id. A third of the rows is held out for pruning: of a rule's prefixes
    the one with the best (p - n) / (p + n) there is kept. Learning ends with the first rule below ``min_precision``
    or ``min_cover`` there. Null labels are dropped; without rows of both classes there are no rules."""
    ws = Workspace(labelled.sparkSession, "rules")
    rows = labelled.filter(F.col(label).isNotNull()).select("doc_id", *features, F.col(label).cast("int").alias("_bad"))
    n = rows.count()
    if n > max_rows:
        rows = rows.filter(uniform(seed, F.col("doc_id")) < max_rows / n)
    rows = rows.withColumn("_held", uniform(seed + 1, F.col("doc_id")) < 1 / 3)
    probs = [(i + 0.5) / thresholds for i in range(thresholds)]
    found = rows.agg(*[F.percentile(f, F.array(*map(F.lit, probs))).alias(f) for f in features], *[F.percentile(F.when(F.col("_bad") == 1, F.col(f)), F.array(*map(F.lit, probs))).alias(f"{f}_bad") for f in features]).first()
    cuts = {f: sorted({*(found[f] or ()), *(found[f"{f}_bad"] or ())}) for f in features}
    # each feature's value as the number of cuts at or below it
    code = lambda f: F.size(F.filter(F.array(*map(F.lit, cuts[f])), lambda t: t <= F.col(f))) if cuts[f] else F.lit(0)
    rows = ws.write(rows.select("_bad", "_held", *features, F.array(*[code(f) for f in features]).alias("_codes")), "labelled")
    left, rules = F.lit(True), []
    while len(rules) < max_rules:
        rule: Rule = ()
        while len(rule) < max_tests:
            counted = rows.filter(left & all_of(rule) & ~F.col("_held")).select("_bad", F.posexplode("_codes").alias("f", "code")).groupBy("f", "code").agg(F.sum("_bad").alias("p"), F.sum(1 - F.col("_bad")).alias("n")).collect()
            best = best_test(counted, features, cuts, min_cover)
            if best is None:
                break
            rule += (best[1],)
            if best[2] == 0:
                break
        if not rule:
            break
        tests = [all_of(rule[: i + 1]) for i in range(len(rule))]
        r = rows.filter(left & F.col("_held")).agg(*[F.sum(F.when(t, F.col("_bad")).otherwise(0)).alias(f"p{i}") for i, t in enumerate(tests)], *[F.sum(F.when(t, 1 - F.col("_bad")).otherwise(0)).alias(f"n{i}") for i, t in enumerate(tests)]).first()
        worth = [((p - n) / (p + n) if p + n else -1.0, p, -i) for i in range(len(rule)) for p, n in [(r[f"p{i}"] or 0, r[f"n{i}"] or 0)]]
        value, p, i = max(worth)
        if p < min_cover or (value + 1) / 2 < min_precision:
            break
        rules.append(rule[: 1 - i])
        left = left & ~all_of(rules[-1])
    return rules


def best_test(counted: list, features: list[str], cuts: dict[str, list[float]], min_cover: int) -> tuple[float, Test, int] | None:
    """The threshold of most information gain over the rows counted by (feature, code); None without a gain."""
    by: dict[int, dict[int, tuple[int, int]]] = {}
    for r in counted:
        by.setdefault(r.f, {})[r.code] = (r.p, r.n)
    best = None
    for f, codes in by.items():
        all_p, all_n = (sum(x[k] for x in codes.values()) for k in (0, 1))
        if not all_p or not all_n:
            continue
        base = math.log2(all_p / (all_p + all_n))
        for at in range(1, len(cuts[features[f]]) + 1):
            up = [sum(x[k] for c, x in codes.items() if c >= at) for k in (0, 1)]
            for above, (p, n) in ((True, up), (False, (all_p - up[0], all_n - up[1]))):
                if p < min_cover:
                    continue
                gain = p * (math.log2(p / (p + n)) - base)
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = gain, Test(features[f], above, cuts[features[f]][at - 1]), n
    return best


def decision(rules: list[Rule]) -> Column:
    """The ordered conditional: the number of the first rule that covers a row, null where none does."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(all_of(rule), F.lit(i)).otherwise(out)
    return out


def _judged(docs: DataFrame, labels: DataFrame, keep: list[str], learning: dict) -> DataFrame:
    """keep (columns of docs, doc_id among them), the counts, base_failed, rule and kept."""
    ws = Workspace(docs.sparkSession, "quality")
    stats = ws.write(text_statistics(docs, *keep), "statistics")
    names = [name for name, _, _ in RATIOS]
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    judged = stats.select("*", *ratios(), failed.alias("base_failed"))
    rows = judged.filter("not base_failed").join(known, "doc_id").groupBy("doc_id").agg(F.min(F.struct(*names, "quality")).alias("r")).select("doc_id", "r.*")
    rules = learn_decision_list(rows.select("doc_id", *names, (F.col("quality") == 0).alias("_low")), names, "_low", **learning)
    return judged.withColumn("rule", decision(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).drop(*names)


def judge_quality(docs: DataFrame, labels: DataFrame, **learning) -> DataFrame:
    """Statistics, base test and verdict of each document, learned from labels(doc_id, quality 0 or 1).

    Returns doc_id, the counts of ``text_statistics``, base_failed, rule (number of the rule that rejects, null for
    none) and kept. Null text fails the base test. Repeated rows are judged alike. A null doc_id is judged by the rules.
    Labels without a document, with null quality or given twice with different values (the lowest counts) do no harm; of
    texts that share a labelled doc_id the one of the least ratios is learned from; no labels: no rules.
    Empty input: empty result. Other columns are ignored."""
    return _judged(docs, labels, ["doc_id"], learning)


def good_documents(docs: DataFrame, labels: DataFrame, **learning) -> DataFrame:
    """The rows of docs that ``judge_quality`` keeps, each judged by its own text: one with null text goes, one with null
    doc_id and a good text stays, repeated rows stay or go together. All columns are kept, whatever their names; empty
    input: empty result. Rows travel with their statistics, so that no join has to bring them together again."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    return _judged(rows, labels, ["row", "doc_id"], learning).filter("kept").select(*[F.col("row")[c].alias(c) for c in docs.columns])
