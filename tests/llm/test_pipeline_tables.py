"""The pipeline's own tables: nothing of it stays in the catalogue, and nothing of others goes."""

from test_llm import DOCS, ODD

import corpus_pipeline
from chatloom.llm import near_copies
from chatloom.llm.common import materialize, own_tables, release


def test_no_table_is_left(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    before = {t.name for t in spark.catalog.listTables()}
    with own_tables() as written:
        kept = materialize(near_copies.keep_one(docs), "kept")
        release(spark, keep=[written[-1]])
        assert len(written) == 1
    assert kept.count() > 5 and {t.name for t in spark.catalog.listTables()} == before


def test_two_runs_in_one_driver(spark, monkeypatch):
    """Two runs, one begun before the other is read, beside a table of neither; stages are cut down to what writes tables."""
    outside = materialize(spark.range(4), "outside")
    stages = [("keep", lambda s, docs, d: near_copies.keep_one(docs)), ("again", lambda s, docs, d: docs.where("doc_id is not null")), ("last", lambda s, docs, d: docs)]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    monkeypatch.setattr(corpus_pipeline, "table", lambda s, d, name: s.createDataFrame(ODD, DOCS))
    before = {t.name for t in spark.catalog.listTables()}
    one = corpus_pipeline.run(spark, "")
    two = corpus_pipeline.run(spark, "")
    assert sorted(r.doc_id for r in one.collect()) == sorted(r.doc_id for r in two.collect()) and outside.count() == 4
    assert {t.name for t in spark.catalog.listTables()} == before
