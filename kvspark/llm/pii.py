"""Personal data, native.

Regular expressions propose spans; octet bounds, Luhn and mod-97 checks and digit
counts confirm them; context words near a span raise its score. The base kinds stay
whatever their score; the added kinds (``iban``, ``ssn``) need ``min_score``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvspark.llm.base import fresh, has_any, has_digit, let, regex_spans, span_text

# The patterns of the contract, with run starts and possessive
# repeats made explicit so that a search is linear and cannot exhaust the stack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Account numbers' countries by length; of others the longest match is taken.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_BY_LENGTH = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
_LISTED = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
IBAN = rf"(?<![A-Za-z0-9])(?:{_BY_LENGTH}|(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}})(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = 4
_SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double>>"


@dataclass(frozen=True)
class PiiRule:
    """prior: score of a confirmed span by kind. A context word within ``reach`` code points before it, or behind it in the same clause, adds ``bonus``."""

    prior: dict[str, float] = field(default_factory=lambda: {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4})
    context: dict[str, str] = field(default_factory=lambda: {
        "email": r"(?i)\b(e-?mail|contact|write)\b",
        "ip": r"(?i)\b(ip|host|server|address)\b",
        "card": r"(?i)\b(card|visa|mastercard|credit|payment)\b",
        "phone": r"(?i)\b(phone|call|tel|mobile|fax)\b",
        "iban": r"(?i)\b(iban|account|bank|transfer)\b",
        "ssn": r"(?i)\b(ssn|social|security)\b",
    })
    reach: int = 40
    bonus: float = 0.2
    min_score: float = 0.6


def luhn(digits: Column) -> Column:
    """True if the digit string passes the Luhn check."""
    chars = F.reverse(F.transform(F.split(digits, ""), lambda c: F.ascii(c) - 48))

    def weigh(d: Column, k: Column) -> Column:
        twice = d * 2
        return F.when(k % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(chars, weigh), F.lit(0), lambda s, x: s + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """True if the account number, its first four symbols moved to the end and letters read as 10 to 35, leaves 1 by 97."""
    moved = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    codes = F.transform(F.split(moved, ""), lambda c: F.ascii(c))
    fold = lambda s, c: F.when(c <= 57, s * 10 + (c - 48)).otherwise(s * 100 + (c - 55)) % 97
    return F.aggregate(codes, F.lit(0), fold) == 1


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _confirmed(kind: str, span: Column) -> Column:
    digits = _digits(span["hit"])
    if kind == "ip":
        return span["hit"].rlike(OCTETS)
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(span["hit"], " ", ""))
    if kind == "ssn":
        return ~span["hit"].rlike(r"^(000|666|9..)|-00-|-0000$")
    return F.lit(True)


def find_pii(df: DataFrame, text_col: str = "text", rule: PiiRule | None = None, out: str = "spans") -> DataFrame:
    """Adds ``out``: array<struct<start,rank,end,kind,score>>, ordered by kind, then start.

    Null and empty texts have none; other columns pass through, but one that is called ``out`` is replaced; repeated rows are treated alike.
    An added span that touches a base span is left out.
    """
    rule = rule or PiiRule()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names = dict(zip(KINDS, fresh(df, *KINDS), strict=True))
    patterns = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE, IBAN, SSN), strict=True))
    only = {"email": has_any(text, "@"), "phone": has_any(text, "+")}
    found = df.withColumns({names[k]: regex_spans(text, patterns[k], only=only.get(k, has_digit(text))) for k in KINDS})

    def scored(kind: str) -> Column:
        def tag(s: Column) -> Column:
            from_ = F.greatest(s["start"] - rule.reach, F.lit(0))
            near = F.substr(text, (from_ + 1).cast("int"), (s["start"] - from_).cast("int"))
            behind = F.substring_index(F.translate(F.substr(text, (s["end"] + 1).cast("int"), F.lit(rule.reach)), ",;!?\n", "....."), ".", 1)
            score = F.lit(rule.prior[kind]) + F.when(near.rlike(rule.context[kind]) | behind.rlike(rule.context[kind]), F.lit(rule.bonus)).otherwise(F.lit(0.0))
            return F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.least(score, F.lit(1.0)).alias("score"))

        spans = F.transform(F.filter(F.col(names[kind]), lambda s: _confirmed(kind, s)), tag)
        return spans if KINDS.index(kind) < BASE else F.filter(spans, lambda s: s["score"] >= rule.min_score)

    base, added = F.concat(*map(scored, KINDS[:BASE])), F.concat(*map(scored, KINDS[BASE:]))
    joined = let(base, lambda b: F.concat(b, F.filter(added, lambda s: ~F.exists(b, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"])))))
    some = F.lit(False)
    for name in names.values():
        some = some | (F.size(name) > 0)
    return found.withColumn(out, F.when(some, joined).otherwise(F.array().cast(_SPANS))).drop(*names.values())


def redact(df: DataFrame, text_col: str = "text", rule: PiiRule | None = None) -> DataFrame:
    """Replaces each span by its kind in brackets, e.g. ``[EMAIL]``. Spans that overlap become one, named after the first.

    Texts without spans, null texts among them, stay as they are.
    """
    (spans,) = fresh(df, "spans")
    rows = find_pii(df, text_col, rule, spans)
    text = F.col(text_col)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substr(text, (s["at"] + 1).cast("int"), F.greatest(x["start"] - s["at"], F.lit(0)).cast("int"))
        new = F.concat(s["out"], F.array(gap, F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] < s["at"], s["out"]).otherwise(new).alias("out"))

    masked = F.aggregate(ordered, zero, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substr(text, (s["at"] + 1).cast("int"), F.length(text))))
    return rows.withColumn(text_col, F.when(F.size(spans) > 0, masked).otherwise(text)).select(df.columns)


def pii_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: PiiRule | None = None) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans as text, spans of added kinds, largest score."""
    rows = find_pii(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", rule, "found")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")
    return rows.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:BASE]],
        F.sha2(span_text(F.filter("found", lambda s: s["rank"] < BASE)), 256).alias("base_sha256"),
        span_text(F.col("found")).alias("spans"),
        *[count(k).alias(f"n_{k}") for k in KINDS[BASE:]],
        F.array_max(F.transform("found", lambda s: s["score"])).alias("top_score"),
    )
