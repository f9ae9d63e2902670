"""The registered queries against their SQL, and the pipeline."""

import duckdb
import pytest

from voidloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = queries.QUERIES[name](spark, sf_dir)
    told = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in told.description]
    assert sorted(found.columns) == sorted(names)
    order = [found.columns.index(c) for c in names]
    assert sorted(str([r[i] for i in order]) for r in found.collect()) == sorted(str(list(r)) for r in told.fetchall())


def test_pipeline_stages_keep_columns_and_clean_documents(spark, sf_dir):
    import corpus_pipeline
    from voidloom.llm.common import table

    docs = table(spark, sf_dir, "documents")
    out = corpus_pipeline.run(spark, sf_dir)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "MinHash near-dedup", "benchmark decontamination", "SentencePiece ids"]
    rows = out.collect()
    assert 0 < len(rows) < docs.count() and all(r["round_trip"] for r in rows)
    assert len({r["doc_id"] for r in rows}) == len(rows)
