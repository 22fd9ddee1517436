"""run() against a plain form of its stages."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from cuetrail.llm import toxicity
from cuetrail.llm.bpe import byte_bpe, defaults
from cuetrail.llm.secrets import _redacted, base_spans, linked_spans

from .test_llm import components, hits

SF = "/root/testdata/sf0.001"


def test_run(spark):
    got = {r.doc_id: (r.n_tokens, list(r.ids)) for r in corpus_pipeline.run(spark, SF).collect()}
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train_on_folds(docs, labels)
    mild = {r.doc_id for r in toxicity.score(docs, model).where("score < 0.5").collect()}
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if r.doc_id in mild]
    kept = {i for i, (_, c) in components(rows, 5, 80).items() if i == c}
    rows = [(i, t) for i, t in rows if i in kept]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {i for i, *_, bad in hits(rows, items) if bad}
    rows = [(i, _redacted(t, sorted(base_spans(t) + linked_spans(t, base_spans(t))))) for i, t in rows if i not in leaked]
    b = byte_bpe(*defaults())
    expected = {i: (len(c) // 4, [int.from_bytes(c[k : k + 4], "little") for k in range(0, len(c), 4)]) for (i, _), c in zip(rows, b.encode([t for _, t in rows]), strict=True)}
    assert got == expected
    assert not any(re.search("AKIA[A-Z0-9]{16}", t) for _, t in rows)


def test_stages_return_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(5).unionByName(spark.createDataFrame([(None, None, None, None, None), (900_000, "", "en", "s", 0)], docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        assert name == "byte_bpe" or out.columns == docs.columns
        assert out.count() <= 7 and out.where(F.col("doc_id") == 900_000).count() == 1


def test_filters_take_rows_not_ids(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").first().text
    text = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    rows = [(None, item), (None, text("clean")), (1, item), (1, text("one")), (None, text("a")), (None, text("a")), (7, text("b")), (7, text("b")), (8, text("b")), (None, text("b")), (9, text("c")), (None, text("c")), (10, text("d")), (10, text("e")), (None, ""), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], spark.read.parquet(f"{SF}/documents.parquet").schema)
    listed = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    for parts in (1, 3):
        clean = corpus_pipeline.drop_contaminated(spark, docs.repartition(parts), SF)
        assert listed(clean) == sorted((r for r in rows if r[1] != item), key=str)
        kept = [(None, text("clean")), (1, text("one")), (None, text("a")), (7, text("b")), (9, text("c")), (10, text("d")), (10, text("e")), (None, ""), (None, None), (None, None)]
        assert listed(corpus_pipeline.drop_near_duplicates(spark, clean, SF)) == sorted(kept, key=str)
