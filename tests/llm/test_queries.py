"""Every registered query of the subpackage at the smallest scale, with its SQL where it has one; the pipeline as a whole."""

import glob
import os
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from corpusloom.llm import queries, stages
from corpusloom.llm.common import read, release

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, tables, name):
    df = queries.QUERIES[name](spark, SMALL)
    cols, rows = sorted(df.columns), df.collect()
    if name in queries.ORACLE:
        r = tables.execute(queries.ORACLE[name])
        at = [d[0] for d in r.description]
        assert sorted(at) == cols
        want = sorted(repr([rounded(w[at.index(c)]) for c in cols]) for w in r.fetchall())
        assert sorted(repr([rounded(r[c]) for c in cols]) for r in rows) == want
    else:
        table, key = ("pages", "page_id") if name == "op8_html" else ("documents", "doc_id")
        ids = [r[0] for r in tables.execute(f"SELECT {key} FROM {table}").fetchall()]
        assert Counter(r[key] for r in rows) == Counter(ids)


def test_pipeline_is_its_stages(spark):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=stages.VOCABULARY)
    docs = read(spark, SMALL, "documents")
    everything = {r.doc_id: r.text for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), docs.schema)
    want = sorted((r.doc_id, tuple(sp.encode(r.text))) for r in docs.collect())
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in out) == want
    assert all(r.n_tokens == len(r.ids) and r.round_trip for r in out)
    taken = Counter(r.doc_id for r in out)
    assert max(taken.values()) <= 2 and set(taken) <= set(everything)
    for r in out:  # what is left of a text are lines of it
        lines = sp.decode(np.array(r.ids).tolist()).split("\n")
        assert not Counter(lines) - Counter(everything[r.doc_id].split("\n"))
    release(spark)
