"""What every operator has to stand: nulls, empty and very long texts, repeated rows, clashing columns, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from kvspark.llm import decontaminate, importance, near_copies, pieces, pii, quality_rules, secrets, simhash, suffixes, token_counts, url_rules

public_tokenizers = pytest.importorskip("public_tokenizers")
R = random.Random(11)
LONG = " ".join("".join(R.choice("etaoinshr") for _ in range(R.randint(1, 9))) for _ in range(60_000))
ROWS = [(1, "A short text of some words with mail a@b.co in it."), (1, "A short text of some words with mail a@b.co in it."), (2, None), (None, None), (3, ""), (4, LONG), (None, "no number here"), (5, "  \n\t ")]
CLASHING = ["spans", "stats", "rejected_by", "fingerprint", "component_id", "n_tokens", "ids", "k1", "k2", "node", "h", "text_2", "start", "number", "digest", "mark", "kept", "verdict"]
LABELS = [(1, 1, 0), (4, 0, 0), (9, 1, 1)]
ITEMS = [(1, "some words with mail"), (2, None), (None, "lost"), (3, "")]


OPERATORS = {
    "op1": lambda d, l, b: importance.resample(d, l),
    "op2": lambda d, l, b: secrets.secret_report(d),
    "op2 spans": lambda d, l, b: secrets.find_secrets(d),
    "op3": lambda d, l, b: quality_rules.quality_report(d, l),
    "op3 kept": lambda d, l, b: quality_rules.keep_good(d, l),
    "op4": lambda d, l, b: simhash.near_duplicates(d),
    "op4 kept": lambda d, l, b: near_copies.keep_one(d),
    "op5": lambda d, l, b: decontaminate.find_overlaps(d, b),
    "op5 kept": lambda d, l, b: decontaminate.clean_documents(d, b),
    "op6": lambda d, l, b: token_counts.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json")),
    "op7": lambda d, l, b: pii.pii_report(d),
    "op7 text": lambda d, l, b: pii.redact(d),
    "op8": lambda d, l, b: suffixes.cut_repeats(d),
    "op9": lambda d, l, b: url_rules.judge_urls(d, url_rules.RULES, "text", "doc_id"),
    "op10": lambda d, l, b: pieces.encode(d, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True),
}
#: Those that may return fewer rows than they get.
FEWER = {"op1", "op3 kept", "op4 kept", "op5", "op5 kept"}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, name):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit("mine") for c in CLASHING})
    labels, items = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"), spark.createDataFrame(ITEMS, "item_id long, text string")
    run = OPERATORS[name]
    out = run(docs, labels, items)
    rows = out.collect()
    if name not in FEWER:
        assert len(rows) == len(ROWS)
        key = "doc_id" if "doc_id" in out.columns else "id"
        same = [tuple(str(v) for v in r) for r in rows if r[key] == 1]
        assert len(same) == 2 and same[0] == same[1]  # repeated rows are treated alike
    if name in ("op3 kept", "op4 kept", "op5 kept", "op7 text"):
        assert out.columns == docs.columns and all(r["spans"] == "mine" for r in rows)
    assert run(docs.limit(0), labels, items).collect() == []
    run(docs.limit(0), labels.limit(0), items.limit(0)).collect()


def test_results_of_the_edges(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    kept = {(r.doc_id, (r.text or "")[:30]) for r in near_copies.keep_one(docs).collect()}
    assert kept == {(1, ROWS[0][1][:30]), (4, LONG[:30]), (None, "no number here"), (None, "")}  # of the wordless, the one without an id
    found = decontaminate.find_overlaps(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.n_equal) for r in found] == [(1, 1, 4), (1, 1, 4)]
    assert suffixes.cut_repeats(docs).filter("n_removed > 0").count() == 0
    encoded = {r.n_tokens > 0 for r in pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).filter("lossless").collect()}
    assert encoded == {True, False}


def test_more_rules_than_one_pass_takes(spark):
    r = random.Random(2)
    hosts = ["org", "com", "a.org", "b.a.org", "b.com", "c.b.com", "d.com"]
    rules = [url_rules.UrlRule(r.choice(["allow", "block"]), h, p) for h in hosts for p in ("/", "/x", "/x/y", "/z")]
    df = spark.createDataFrame([(i, f"http://{r.choice(['', 'w.'])}{r.choice(hosts)}{r.choice(['/', '/x', '/x/yy', '/q', '/z/1'])}") for i in range(200)], "page_id long, url string")
    whole, parts = (sorted(map(tuple, url_rules.judge_urls(df, rules, max_rules=n).collect())) for n in (1000, 5))
    assert whole == parts and len({x[4] for x in whole}) > 5
