"""Quality rules, native: a learned decision list over text statistics.

Statistics are Spark expressions over whole texts. Sequential covering learns on the
statistics of labelled documents: it grows a conjunction of thresholds by information
gain on one part of the rows, prunes it on the other, keeps it if it is precise enough,
takes away what it covers and goes on. The list becomes one ordered CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvspark.llm.base import WORD_GAP, fresh, let

WINDOW = 8
#: Statistics that rules may test, by name: what they divide.
RATIOS = {
    "symbol_ratio": ("n_symbols", "word_chars"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "mean_word": ("word_chars", "n_words"),
    "upper_ratio": ("n_upper", "word_chars"),
}
#: Characters that are counted, by statistic.
MARKS = {"n_symbols": "#*$%&|<>", "n_upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


@dataclass(frozen=True)
class Test:
    """``name`` at least (``above``) or at most ``limit``."""

    name: str
    above: bool
    limit: float

    def holds(self, stats: dict[str, np.ndarray]) -> np.ndarray:
        return stats[self.name] >= self.limit if self.above else stats[self.name] <= self.limit

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.name] >= self.limit if self.above else of[self.name] <= self.limit


Rule = tuple[Test, ...]


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeat_words(words: Column) -> Column:
    """Words in windows of eight that occur twice or more. Windows are compared by their 64-bit hashes.

    Without two equal windows this is one pass; else windows are sorted by hash, runs of
    equal ones are found, and the union of the positions they cover is measured.
    """
    longs = "array<bigint>"
    hashes = F.when(F.size(words) > WINDOW, F.slice(F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WINDOW)])), 1, F.size(words) - WINDOW + 1)).otherwise(F.array().cast(longs))

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda x, k: F.coalesce(x["v"] == F.get(s, k)["v"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

        def measure(at: Column) -> Column:
            zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
            step = lambda s, i: F.struct((i + WINDOW).alias("end"), (s["n"] + WINDOW - F.greatest(s["end"] - i, F.lit(0))).alias("n"))
            return F.aggregate(at, zero, step, lambda s: s["n"])

        return let(let(ranked, starts), measure)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))


def text_stats(df: DataFrame, text_col: str = "text", out: str = "stats") -> DataFrame:
    """Adds the struct ``out`` of counts over the whole text. Null texts count as empty: all zero."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WORD_GAP))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"), _repeat_words(w).cast("bigint").alias("n_repeat_words")
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))

    by_word, by_line = fresh(df, "words", "lines")
    rows = df.withColumns({by_word: let(words, of_words), by_line: let(lines, of_lines)})
    counts = {c: F.col(by_word)[c] for c in ("n_words", "word_chars", "n_repeat_words")} | {c: F.col(by_line)[c] for c in ("n_lines", "n_dup_lines")}
    counts |= {c: _count(text, chars) for c, chars in MARKS.items()}
    return rows.withColumn(out, F.struct(*[c.cast("bigint").alias(n) for n, c in counts.items()])).drop(by_word, by_line)


def ratios(stats: Column) -> dict[str, Column]:
    """The statistics that rules test; 0 where nothing can be divided."""
    return {n: F.coalesce(F.try_divide(stats[a].cast("double"), stats[b].cast("double")), F.lit(0.0)) for n, (a, b) in RATIOS.items()}


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 20) | (stats["n_repeat_words"] * 100 > stats["n_words"] * 30)


def cover(stats: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95, max_rules: int = 12, max_tests: int = 3, min_covered: int = 5, cuts: int = 48) -> list[Rule]:
    """Sequential covering on the driver over a bounded number of rows. Rows alternate between the growing and the pruning part."""
    rows = np.arange(len(bad))
    grow, rules = rows % 3 != 2, []
    left = np.ones(len(bad), bool)
    edges = {n: np.unique(np.quantile(v, np.linspace(0, 1, cuts + 1))) if len(v) else v for n, v in stats.items()}
    while len(rules) < max_rules and (bad & left & grow).sum() >= min_covered:
        rule, inside = [], left & grow
        while len(rule) < max_tests and (inside & ~bad).any():
            p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
            best, gain = None, 1e-9
            for name in stats:
                values = stats[name]
                order = np.sort(values[inside & bad]), np.sort(values[inside & ~bad])
                for above in (True, False):
                    cut = edges[name]
                    p, n = (len(o) - np.searchsorted(o, cut, "left") if above else np.searchsorted(o, cut, "right") for o in order)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        g = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - math.log2(p0 / (p0 + n0))), -1.0)
                    k = int(np.argmax(g)) if len(g) else -1
                    if k >= 0 and g[k] > gain:
                        best, gain = Test(name, above, float(cut[k])), float(g[k])
            if best is None:
                break
            rule.append(best)
            inside = inside & best.holds(stats)
        if not rule:
            break

        def worth(r: list[Test], part: np.ndarray) -> tuple[float, int, int]:
            hit = left & part
            for t in r:
                hit = hit & t.holds(stats)
            p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
            return ((p - n) / (p + n) if p + n else -1.0), p, n

        options = [rule[:k] for k in range(len(rule), 0, -1)]
        rule = max(options, key=lambda r: worth(r, ~grow)[0])
        _, p, n = worth(rule, np.ones(len(bad), bool))
        _, pp, pn = worth(rule, ~grow)
        if p < min_covered or p < precision * (p + n) or pp < precision * (pp + pn):
            break
        rules.append(tuple(rule))
        for t in rule:
            hit = t.holds(stats) if t is rule[0] else hit & t.holds(stats)
        left &= ~hit
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 12_000, **options) -> list[Rule]:
    """Learns rules that say "bad" on at most ``max_labelled`` labelled documents, those of the smallest id hashes.

    A document with several labels counts as bad if one says so. Rows without an id or a label are not used;
    without labels there are no rules.
    """
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("good")).dropna()
        .groupBy("id").agg(F.min("good").alias("good"))
        .orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    )
    # at most max_labelled rows of two numbers: bounded, so it can be sent to all tasks
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    stats = F.col("stats")
    found = (
        text_stats(rows, "text", "stats").select("id", "good", base_failed(stats).alias("failed"), *[c.alias(n) for n, c in ratios(stats).items()])
        # repeated rows count once; the base test comes after the aggregate, where the statistics need not be computed again for it
        .groupBy("id", "good").agg(F.max("failed").alias("failed"), *[F.min(n).alias(n) for n in RATIOS])
        .filter(~F.col("failed")).orderBy(F.xxhash64("id"), "id").limit(max_labelled).toPandas()
    )
    return cover({n: found[n].to_numpy(float) for n in RATIOS}, found["good"].to_numpy(float) == 0, **options)


def decision(rules: list[Rule], stats: Column) -> Column:
    """The ordered list as one CASE: 0 for the base rule, the number of the first rule that fits, null if none does."""
    of, out = ratios(stats), F.when(base_failed(stats), F.lit(0))
    for k, rule in enumerate(rules, 1):
        fits = rule[0].column(of)
        for t in rule[1:]:
            fits = fits & t.column(of)
        out = out.when(fits, F.lit(k))
    return out


def apply_rules(df: DataFrame, rules: list[Rule], text_col: str = "text", out: str = "stats", by: str = "rejected_by") -> DataFrame:
    """Adds the statistics and the number of the rule that rejects a document (null: kept)."""
    return text_stats(df, text_col, out).withColumn(by, decision(rules, F.col(out)))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: statistics, the base verdict, the list's verdict and the rule that decided."""
    rules = learn_rules(docs, labels)
    rows = apply_rules(docs.select("doc_id", "text"), rules)
    stats = F.col("stats")
    return rows.select(
        "doc_id",
        *[stats[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed(stats).alias("base_failed"), F.col("rejected_by").isNull().alias("kept"), "rejected_by",
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the list keeps, columns unchanged."""
    out, by = fresh(docs, "stats", "by")
    return apply_rules(docs, learn_rules(docs, labels), out=out, by=by).filter(F.col(by).isNull()).select(docs.columns)
