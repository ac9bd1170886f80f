"""The queries against their SQL, and the pipeline against its stages by hand."""

import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from cataloom.llm import packing, pii, queries

from .test_exact import brute_report
from .test_near_copies import brute_kept

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_give_their_oracles_rows(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        duck.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    want = duck.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_pipeline(spark):
    """Each stage by hand on what the one before kept."""
    from tokenizers import Tokenizer

    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    kept, _ = brute_kept(rows)
    rows = [(i, t) for i, t in rows if i in kept]
    clean = {r[0] for r in brute_report(rows, bench) if not r[5]}
    rows = [(i, t) for i, t in rows if i in clean]
    tagger = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = set()
    for (i, text), (_, every) in zip(rows, pii.find([t for _, t in rows], tagger), strict=True):
        ids = [*tokenizer.encode(pii.redacted(text, every), add_special_tokens=False).ids, 0]
        want |= {(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)}
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert len(got) == len(want) and {tuple(r)[:5] for r in got} == want


def test_stages_keep_columns_and_stand_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "", "", 0), (None, "a word", "en", "s", 6), (3, "a word", "en", "s", 6), (3, "a word", "en", "s", 6)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.count() <= 5, name
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
