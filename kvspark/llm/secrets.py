"""Secret scans, native.

Base patterns propose assignments, access keys and hex runs. The entropy scan adds
spans: a window slides over each candidate string, counts per symbol are kept as one
symbol enters and one leaves, and windows whose Shannon entropy reaches the limit of
the string's character class are joined to spans. Candidates on the allow-list and
spans that touch a base span are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvspark.llm.base import fresh, has_any, has_digit, let, regex_spans, span_text

# The patterns of the contract, with run starts and possessive
# repeats made explicit so that a search is linear in the text.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KINDS = ("assign", "access", "hex", "entropy")
_SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


@dataclass(frozen=True)
class EntropyRule:
    """window: symbols in a window. limits: bits per symbol that a window must reach, by class of the candidate.

    Classes: ``hex`` (hex digits only), ``mixed`` (letters and digits), ``plain`` (all others).
    A candidate without a digit, or one that matches ``allow``, gives no span.
    """

    window: int = 20
    limits: dict[str, float] = field(default_factory=lambda: {"hex": 3.0, "mixed": 3.7, "plain": 4.1})
    allow: tuple[str, ...] = (
        r"(?i)example|sample|dummy|placeholder|changeme",
        r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
        r"^[^0-9]*$",
        r"^[0-9]+([-_/+=][0-9]+)*$",
    )


def _entropy_spans(candidate: Column, rule: EntropyRule) -> Column:
    """Joined windows of one candidate string that reach the limit, as array<struct<start,end>> inside it."""
    w, symbols = rule.window, len(ALPHABET)
    cost = F.array(*[F.lit(float(c * math.log2(c)) if c else 0.0) for c in range(w + 2)])
    limit = (
        F.when(candidate.rlike(r"^[0-9a-fA-F]+$"), F.lit(rule.limits["hex"]))
        .when(candidate.rlike(r"[0-9]") & candidate.rlike(r"[A-Za-z]"), F.lit(rule.limits["mixed"]))
        .otherwise(F.lit(rule.limits["plain"]))
    )
    codes = F.transform(F.split(candidate, ""), lambda ch: F.instr(F.lit(ALPHABET), ch) - 1)
    pairs = "array<struct<start:bigint,end:bigint>>"

    def scan(bound: Column) -> Column:
        seq, bits = bound["codes"], bound["limit"]
        zero = F.struct(
            F.lit(0).cast("bigint").alias("i"),
            F.array_repeat(F.lit(0), symbols).alias("counts"),
            F.lit(0.0).alias("cost"),
            F.array().cast(pairs).alias("out"),
        )

        def step(s: Column, enter: Column) -> Column:
            leave = F.when(s["i"] >= w, F.get(seq, (s["i"] - w).cast("int"))).otherwise(F.lit(-1))
            before_in = F.get(s["counts"], enter)
            # the symbol that leaves is counted before the one that enters; equal symbols change nothing
            before_out = F.get(s["counts"], leave)
            same = enter == leave
            moved = F.when(same, s["cost"]).otherwise(
                s["cost"] + F.get(cost, before_in + 1) - F.get(cost, before_in)
                + F.when(leave >= 0, F.get(cost, before_out - 1) - F.get(cost, before_out)).otherwise(F.lit(0.0))
            )
            counts = F.when(same, s["counts"]).otherwise(
                F.transform(s["counts"], lambda c, k: c + (k == enter).cast("int") - (k == leave).cast("int"))
            )
            hot = (s["i"] >= w - 1) & ((F.lit(math.log2(w)) - moved / w) >= bits)
            start, end = s["i"] - (w - 1), s["i"] + 1
            last = F.element_at(s["out"], -1)
            joins = (F.size(s["out"]) > 0) & F.coalesce(last["end"] >= start, F.lit(False))
            out = (
                F.when(hot & joins, F.concat(F.slice(s["out"], 1, F.size(s["out"]) - 1), F.array(F.struct(last["start"].alias("start"), end.alias("end")))))
                .when(hot, F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end")))))
                .otherwise(s["out"])
            )
            return F.struct((s["i"] + 1).alias("i"), counts.alias("counts"), moved.alias("cost"), out.alias("out"))

        # element_at of an empty array is an error in ANSI mode, so the state begins with a span that nothing joins
        first = zero.withField("out", F.array(F.struct(F.lit(-10).cast("bigint").alias("start"), F.lit(-10).cast("bigint").alias("end"))))
        return F.aggregate(seq, first, step, lambda s: F.filter(s["out"], lambda x: x["start"] >= 0))

    allowed = F.lit(False)
    for pattern in rule.allow:
        allowed = allowed | candidate.rlike(pattern)
    return F.when(allowed, F.array().cast(pairs)).otherwise(let(F.struct(codes.alias("codes"), limit.alias("limit")), scan))


def find_secrets(df: DataFrame, text_col: str = "text", rule: EntropyRule | None = None, out: str = "spans") -> DataFrame:
    """Adds ``out``: array<struct<start,rank,end,kind>> of all secrets, ordered by start, then kind.

    Null and empty texts have no spans; repeated rows are scanned alike; other columns pass through, but one that is called ``out`` is replaced.
    """
    rule = rule or EntropyRule()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    assign, access, hexes, tries = fresh(df, "assign", "access", "hex", "tries")
    run = f"[A-Za-z0-9+/_=-]{{{rule.window},}}+"

    def tag(name: str, kind: str, keep=None) -> Column:
        spans = F.col(name) if keep is None else F.filter(F.col(name), keep)
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    found = df.withColumns({
        assign: regex_spans(text, ASSIGN, 2, has_any(F.lower(text), "password", "passwd", "secret", "token", "apikey", "api_key")),
        access: regex_spans(text, ACCESS, only=has_any(text, "AKIA")),
        hexes: regex_spans(text, HEX),
        tries: regex_spans(text, run, only=has_digit(text)),
    })
    base = F.concat(tag(assign, "assign", lambda s: F.length(s["part"]) >= 12), tag(access, "access"), tag(hexes, "hex"))

    def inside(b: Column) -> Column:
        spread = F.flatten(F.transform(F.col(tries), lambda c: F.transform(
            _entropy_spans(c["hit"], rule),
            lambda s: F.struct((c["start"] + s["start"]).alias("start"), F.lit(3).alias("rank"), (c["start"] + s["end"]).alias("end"), F.lit("entropy").alias("kind")),
        )))
        return F.filter(spread, lambda s: ~F.exists(b, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"])))

    # candidates that lie in a base span whole need no scan of their own
    return found.withColumn(out, let(base, lambda b: F.array_sort(F.concat(b, F.when(F.size(F.col(tries)) > 0, inside(b)).otherwise(F.array().cast(_SPANS)))))).drop(assign, access, hexes, tries)


def secret_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: EntropyRule | None = None) -> DataFrame:
    """One row per document: counts by kind, digest of the base spans, all spans as text."""
    rows = find_secrets(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", rule, "found")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")
    return rows.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(span_text(F.filter("found", lambda s: s["kind"] != "entropy")), 256).alias("base_sha256"),
        span_text(F.col("found")).alias("spans"),
        count("entropy").alias("n_entropy"),
    )
