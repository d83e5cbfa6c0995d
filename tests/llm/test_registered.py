"""The registered queries against their SQL, and the pipeline against its own stages by brute force."""

import importlib.util
import os
import sys

import duckdb
import pytest

from candlewright.llm import queries as Q

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, con, name):
    a = Q.queries()[name](spark, sf_dir)
    b = con.sql(Q.oracle_sql()[name])
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    key = lambda r: str(r)
    assert sorted([tuple(r) for r in a.select(*cols).collect()], key=key) == sorted(b.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall(), key=key)


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_query_without_sql_runs_whole(spark, sf_dir, name):
    n = Q.queries()[name](spark, sf_dir).count()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert n == docs if name in ("op6_sentencepiece", "op10_hmm_score") else 0 < n <= docs


def test_pipeline_stages(spark, sf_dir, tmp_path):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["quality_classifier", "minhash_dedup", "suffix_dedup", "mixing", "sentencepiece"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs]
    for i, (_, f) in enumerate(P.STAGES):
        f(spark, seen[-1], sf_dir).write.parquet(f"file://{tmp_path}/{i}")
        seen.append(spark.read.parquet(f"file://{tmp_path}/{i}"))
        assert i == 4 or seen[-1].columns == docs.columns
    ids = [{r[0] for r in s.select("doc_id").collect()} for s in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and len(ids[5]) == len(ids[4]) > 0
    # near copies: brute force over what the classifier kept
    from tests.llm.test_dedup import brute_groups, brute_spans, grams  # noqa: F401

    rows = [(r["doc_id"], r["text"]) for r in seen[1].collect()]
    gone = {i for g in brute_groups(rows).values() for i in g[1:]}
    assert ids[2] == ids[1] - gone
    # passages: brute force over what is left
    rows = [(r["doc_id"], r["text"]) for r in seen[2].collect()]
    cut = {}
    for i, a, b, k in brute_spans(rows, 50):
        if k:
            cut.setdefault(i, []).append((a, b))
    want = {i: [w for j, w in enumerate(t.split()) if not any(a <= j < b for a, b in cut.get(i, []))] for i, t in rows}
    assert {r["doc_id"]: r["text"].split() for r in seen[3].collect()} == {i: w for i, w in want.items() if w}
    # the mixture is SQL, the pieces give the text back
    from candlewright.llm import sentencepieces

    back = {r["doc_id"]: r["text"] for r in sentencepieces.decode(seen[5]).collect()}
    assert back == {r["doc_id"]: r["text"] for r in seen[4].collect()}
    assert {r["doc_id"] for r in P.run(spark, sf_dir).select("doc_id").collect()} == ids[5]


def test_pipeline_with_nulls_clashing_columns_and_an_empty_table(spark, tmp_path):
    """Rows without text or id pass every stage but the mixture's budget; an empty table stays empty; names of helpers do no harm."""
    import corpus_pipeline as P

    long_ = " ".join(f"word{i}" for i in range(80))
    rows = [(i, f"{long_} tail{i}", "en", "src0", 10, i, "x") for i in range(6)] + [(7, None, "en", "src1", None, 0, None), (8, "", None, None, 0, 0, "y"), (None, "a lone text of few words", "en", "src1", 5, 1, "z"), (9, "again and again", "en", "src0", 5, 1, "z"), (9, "again and again", "en", "src0", 5, 1, "z")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, h1 long, tokens string"
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    for name, part in (("full", rows), ("none", [])):
        docs = spark.createDataFrame(part, schema)
        for i, (_, stage) in enumerate(P.STAGES):
            before = docs.columns
            stage(spark, docs, f"file://{tmp_path}").write.parquet(f"file://{tmp_path}/{name}{i}")
            docs = spark.read.parquet(f"file://{tmp_path}/{name}{i}")
            assert i == 4 or docs.columns == before
        assert docs.columns == ["doc_id", "source", "tokens"] and (docs.count() > 0) == bool(part)


def test_entry_lists_all():
    spec = importlib.util.find_spec("__spark_entry__")
    e = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(e)
    assert set(Q.queries()) | {"pipeline"} <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
