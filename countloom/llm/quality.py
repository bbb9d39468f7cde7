"""Quality rules as a learned decision list (built-in functions only).

``statistics`` gives each document counts over its whole text. ``learn`` fits an ordered list of rules by
sequential covering on the statistics of labelled documents: a rule grows by the threshold condition of largest
information gain on one part of the sample and is pruned backwards on the other; the documents it covers go,
and the next rule is learned from the rest. A rule that is not precise enough on the pruning part is not taken.
``Rules.reject`` turns the list into one ordered CASE expression, so that scoring a corpus is a plain projection.

The fit sees at most ``sample`` labelled documents (those of smallest seeded hash; the stated bound of what the
driver holds). Everything else covers every row and the whole text.

Null and empty texts have no words and zero counts. Labels that are null, contradict each other or belong to no
document are left out; with no usable labels the list is empty and only the base rule rejects. Repeated rows are
scored each for itself. Other columns pass through; columns named like a statistic are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from countloom.llm.common import private
from countloom.session import cut

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_digits", "n_marks", "n_distinct")
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "distinct_share", "words_a_line")


def let(value: Column, body) -> Column:
    """``body`` with ``value`` computed once a row (a lambda variable, so it is not computed again inside lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more in the text."""

    def covered(at: Column) -> Column:  # sorted starts of repeated windows
        steps = F.transform(at, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(pairs: Column) -> Column:  # (hash, start), sorted
        same = lambda p, q: F.coalesce(F.get(pairs, q)["h"] == p["h"], F.lit(False))
        at = F.transform(F.filter(pairs, lambda p, j: same(p, j - 1) | same(p, j + 1)), lambda p: p["i"])
        return let(F.array_sort(at), covered)

    def counted(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(pairs, repeated))

    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).otherwise(let(hashes, counted))


@private("_w", "_l")
def statistics(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts BASE and MORE (long) of the whole text."""
    made = (*BASE, *MORE)
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    words = F.array_remove(F.split(text, SPACE + "+", -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(
        words,
        lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("repeat"), F.size(F.array_distinct(w)).cast("long").alias("distinct")),
    )
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("distinct")))
    base = docs.drop(*made)
    out = base.select(
        "*",
        by_words.alias("_w"),
        by_lines.alias("_l"),
        (F.char_length(text) - count(SPACE)).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        count(r"\p{Lu}").alias("n_upper"),
        count(r"[0-9]").alias("n_digits"),
        count(r"[!?:;=+@^~]").alias("n_marks"),
    )
    counted = {"n_words": F.col("_w.n"), "n_repeat_words": F.col("_w.repeat"), "n_distinct": F.col("_w.distinct"), "n_lines": F.col("_l.n"), "n_dup_lines": F.col("_l.n") - F.col("_l.distinct")}
    return out.select(*base.columns, *(counted.get(c, F.col(c)).alias(c) for c in made))


def features() -> dict[str, Column]:
    """The features that rules test, from the statistics; shares of nothing are 0."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / n,
        "symbol_share": F.col("n_symbols") / n,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / n,
        "upper_share": F.col("n_upper") / chars,
        "digit_share": F.col("n_digits") / chars,
        "mark_share": F.col("n_marks") / n,
        "distinct_share": F.col("n_distinct") / n,
        "words_a_line": F.col("n_words") / lines,
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass
class Rules:
    """An ordered list; each rule is a conjunction of (feature, '<=' or '>', threshold) that rejects."""

    rules: list[list[tuple[str, str, float]]] = field(default_factory=list)

    def reject(self) -> Column:
        """The number of the first rule that fires (from 1), or null: an ordered CASE."""
        known, case = features(), None
        for k, rule in enumerate(self.rules, 1):
            hit = F.lit(True)
            for name, op, at in rule:
                hit = hit & (known[name] <= at if op == "<=" else known[name] > at)
            case = F.when(hit, F.lit(k)) if case is None else case.when(hit, F.lit(k))
        return F.lit(None).cast("int") if case is None else case

    def __str__(self) -> str:
        return "\n".join(f"{k}. reject if " + " and ".join(f"{n} {o} {t:.6g}" for n, o, t in r) for k, r in enumerate(self.rules, 1))


def cover(x: np.ndarray, bad: np.ndarray, grow: np.ndarray, *, precision: float = 0.95, max_rules: int = 16, max_conditions: int = 4, cuts: int = 64, least: int = 3) -> Rules:
    """Sequential covering over a matrix of features; ``bad`` marks what to reject, ``grow`` the growing part."""
    found, left = Rules(), np.ones(len(bad), bool)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, cuts + 1)[1:-1], method="inverted_cdf")) for f in range(x.shape[1])] if len(bad) else []
    tests = [(f, op, t, x[:, f] <= t if op == "<=" else x[:, f] > t) for f, e in enumerate(edges) for t in e.tolist() for op in ("<=", ">")]
    while len(found.rules) < max_rules and (bad & left & grow).sum() >= least:
        rule, hit = [], left & grow
        while len(rule) < max_conditions and (hit & ~bad).any():
            p0, n0 = (hit & bad).sum(), (hit & ~bad).sum()
            best, gain = None, 0.0
            for f, op, t, mask in tests:
                h = hit & mask
                p = (h & bad).sum()
                if p < least:
                    continue
                g = p * (np.log2(p / h.sum()) - np.log2(p0 / (p0 + n0)))
                if g > gain + 1e-9:
                    best, gain = (f, op, t, mask), g
            if best is None:
                break
            rule.append(best)
            hit = hit & best[3]

        def worth(part: list, on: np.ndarray) -> tuple[float, int, int]:
            m = left & on
            for c in part:
                m = m & c[3]
            p, n = int((m & bad).sum()), int((m & ~bad).sum())
            return ((p - n) / (p + n) if p + n else -1.0), p, n

        if not rule:
            break
        parts = [rule[:k] for k in range(len(rule), 0, -1)]
        rule = max(parts, key=lambda part: worth(part, ~grow)[0])  # the longest of equals comes first
        _, p, n = worth(rule, np.ones(len(bad), bool))
        _, held_p, held_n = worth(rule, ~grow)
        if p < precision * (p + n) or held_p < precision * (held_p + held_n):
            break
        # thresholds go to the middle of the gap between the values on either side, so that near misses are not rejected
        middle = lambda f, op, m: (x[m, f].max() + x[~m, f].min()) / 2 if op == "<=" else (x[~m, f].max() + x[m, f].min()) / 2
        found.rules.append([(FEATURES[f], op, float(middle(f, op, m)) if m.any() and not m.all() else t) for f, op, t, m in rule])
        left &= ~np.logical_and.reduce([c[3] for c in rule])
    return found


def learn(docs: DataFrame, labels: DataFrame, *, sample: int = 4000, seed: int = 7, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text", **options) -> Rules:
    """Fit on at most ``sample`` labelled documents."""
    key = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL")
    key = key.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z").select("_id", "_y", F.xxhash64(F.lit(seed), "_id").alias("_h"))
    chosen = key.orderBy("_h").limit(sample)  # a bounded table: at most `sample` rows of three numbers
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")
    rows = cut(rows, "labelled")  # else the filter below is pushed under the join and scores every document
    rows = statistics(rows).where(~base_failed()).groupBy("_id", "_y", "_h").agg(*(F.min(c).alias(c) for c in (*BASE, *MORE)))
    known = features()
    got = rows.orderBy("_h").limit(sample).select("_y", F.pmod("_h", F.lit(3)).alias("_part"), *(known[c].alias(f"f_{c}") for c in FEATURES)).collect()
    x = np.array([r[2:] for r in got], float).reshape(len(got), len(FEATURES))
    return cover(x, np.array([r[0] == 0 for r in got], bool), np.array([r[1] != 0 for r in got], bool), **options)


def judge(docs: DataFrame, rules: Rules, *, text_col: str = "text") -> DataFrame:
    """``docs`` with the statistics, ``base_failed``, ``rule`` (the first that rejects) and ``kept``."""
    out = statistics(docs, text_col=text_col).withColumns({"base_failed": base_failed(), "rule": rules.reject()})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
