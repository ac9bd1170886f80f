"""Every repeated window keeps its link to its first place."""

from cataloom.llm import queries, suffix_dedup

from .test_exact import brute_windows

SIZE = suffix_dedup.LENGTH
FOLDER = "/root/testdata/sf0.001"


def test_abutting_passages_keep_both_sources(spark):
    a, b = ([f"{x}{k}" for k in range(80)] for x in "ab")
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(a + b)), (4, "alone"), (5, " ".join([*b, "mid", *b]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in suffix_dedup.sources(docs).collect()}
    assert got == {(1, 0, 80, 80, 1, 0), (2, 0, 80, 80, 2, 0), (3, 0, 80, 80, 1, 0), (3, 80, 160, 80, 2, 0), (5, 0, 80, 80, 2, 0), (5, 81, 161, 80, 2, 0)}
    assert suffix_dedup.sources(docs.limit(0)).count() == 0


def test_rows_rebuild_all_links(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op6_suffix_sources"](spark, FOLDER).collect()
    links = {(r.doc_id, k): (r.first_doc_id, r.first_start + k - r.start) for r in got for k in range(r.start, r.stop - SIZE + 1)}
    assert sum(r.n_words - SIZE + 1 for r in got) == len(links) and links == brute_windows(rows)
