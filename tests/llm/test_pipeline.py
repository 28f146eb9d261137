import hashlib
import struct

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from kvspark.llm import pieces  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, docs, labels=(), items=()):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def prose(i, n=60):
    return " ".join(f"word{i}x{k}" for k in range(n))


def test_stages(spark, tmp_path):
    import public_tokenizers

    item = " ".join(f"bench{k}" for k in range(25))
    docs = [(i, prose(i)) for i in range(10)] + [(20, prose(3)), (21, prose(3)), (22, prose(22) + " " + item), (23, prose(23) + " a@b.co"), (24, "too short"), (25, None), (26, " ".join(f"w{k}###" for k in range(40)))]
    docs += [(100 + i, " ".join(f"q{i}w{k}###" for k in range(40))) for i in range(40)]
    labels = [(100 + i, 0, 0) for i in range(40)] + [(i, 1, 0) for i in range(10)]
    write(spark, tmp_path, docs, labels, [(1, item)])
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(rows) == [*range(10), 23]
    encoder = pieces.Encoder(public_tokenizers.path("piece_bpe_32k.model"), 0.1, 7)
    assert rows[23].n_tokens == len(encoder.encode(prose(23) + " [EMAIL]", 23)) // 4
    assert all(r.lossless for r in rows.values())


def test_the_encoding_is_written(spark, tmp_path):
    write(spark, tmp_path, [(1, prose(1)), (2, prose(2))])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    name, stage = corpus_pipeline.STAGES[-1]
    rows = stage(spark, docs, str(tmp_path)).collect()
    assert name == "encoding" and {r.doc_id for r in rows} == {1, 2}
    for r in rows:
        assert len(r.ids) == r.n_tokens > 0
        assert hashlib.sha256(struct.pack(f"<{len(r.ids)}i", *r.ids)).hexdigest() == r.ids_sha256


def test_stages_keep_the_columns(spark, tmp_path):
    write(spark, tmp_path, [(1, prose(1)), (1, prose(1)), (None, None)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_empty(spark, tmp_path):
    write(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
