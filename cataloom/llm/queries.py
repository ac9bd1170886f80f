"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cataloom.llm import langid

    return langid.identify(_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cataloom.llm import pii

    return pii.detect(_table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cataloom.llm import html_extract

    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cataloom.llm import simhash

    return simhash.groups(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cataloom.llm import quality

    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cataloom.llm import suffix_dedup

    return suffix_dedup.passages(_table(spark, sf_dir, "documents"))


def op6_suffix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cataloom.llm import suffix_dedup

    return suffix_dedup.sources(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cataloom.llm import packing

    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cataloom.llm import url_filter

    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cataloom.llm import decontaminate

    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cataloom.llm import topk

    return topk.nearest(_table(spark, sf_dir, "embeddings"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cataloom.llm import merkle

    return merkle.prove(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cataloom.llm import whitening

    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cataloom.llm import cuckoo

    return cuckoo.dedup(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_pii": op2_pii,
    "op3_html": op3_html,
    "op4_simhash": op4_simhash,
    "op5_quality": op5_quality,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op6_suffix_sources": op6_suffix_sources,
    "op7_packing": op7_packing,
    "op8_url_filter": op8_url_filter,
    "op9_decontaminate": op9_decontaminate,
    "op10_topk": op10_topk,
    "op11_merkle": op11_merkle,
    "op12_whitening": op12_whitening,
    "op13_exact_dedup": op13_exact_dedup,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP6_WINDOWS = rf"""
WITH d AS (
  SELECT doc_id, md5(coalesce(text, '')) AS mark, [x FOR x IN string_split_regex({_LOWER}, '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM documents WHERE doc_id IS NOT NULL
), windows AS (
  SELECT doc_id, mark, i - 1 AS start, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS k
  FROM d, unnest(range(1, len(w) - 48)) AS t(i)
), shared AS (
  SELECT k, min({{'d': doc_id, 's': start}}) AS least FROM windows GROUP BY k HAVING count(*) > 1
), found AS (
  SELECT DISTINCT doc_id, mark, start, least.d AS first_doc_id, least.s AS first_start FROM windows JOIN shared USING (k)
)"""

OP6_SQL = f"""{_OP6_WINDOWS}, marked AS (
  SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY doc_id, mark ORDER BY start) <= 50 THEN 0 ELSE 1 END AS fresh FROM found
), numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, mark ORDER BY start ROWS UNBOUNDED PRECEDING) AS passage FROM marked
)
SELECT doc_id, min(start) AS start, max(start) + 50 AS stop, max(start) + 50 - min(start) AS n_words, min(first_doc_id) AS first_doc_id
FROM numbered GROUP BY doc_id, mark, passage
"""

OP6_SOURCES_SQL = f"""{_OP6_WINDOWS}, marked AS (
  SELECT *, CASE WHEN start = 1 + lag(start) OVER w AND first_doc_id = lag(first_doc_id) OVER w AND first_start = 1 + lag(first_start) OVER w
            THEN 0 ELSE 1 END AS fresh
  FROM found WINDOW w AS (PARTITION BY doc_id, mark ORDER BY start)
), numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, mark ORDER BY start ROWS UNBOUNDED PRECEDING) AS run FROM marked
)
SELECT doc_id, min(start) AS start, max(start) + 50 AS stop, max(start) + 50 - min(start) AS n_words,
       min(first_doc_id) AS first_doc_id, min(first_start) AS first_start
FROM numbered GROUP BY doc_id, mark, run
"""

_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark
), patterns AS (
  SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
  FROM (SELECT *, least(10, len(w)) AS n FROM items WHERE len(w) > 0), unnest(range(1, len(w) - n + 2)) AS t(i)
), hits AS (
  SELECT r, i, x.n, item
  FROM (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
        FROM d, (SELECT DISTINCT n FROM patterns), unnest(range(1, len(w) - n + 2)) AS t(i)) x
  JOIN patterns p ON p.k = x.k AND p.n = x.n
), hit_words AS (
  SELECT r, count(DISTINCT pos) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(pos) GROUP BY r
), hit_items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

OP10_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

_FIELD = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(concat({}, {{}}))".format(", ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")))
_UPWARDS = """
  SELECT tree, (n + 15) // 16, level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM {} WHERE n > 1 GROUP BY tree, n, level, idx // 16"""
_STEP = """
  SELECT w.r, w.tree, w.level + 1, w.up, w.up // 16,
         sha256(concat(array_to_string(ds[:w.idx % 16], ''), acc, array_to_string(ds[w.idx % 16 + 2:], ''))),
         concat(proof, array_to_string(ds[:w.idx % 16], ''), array_to_string(ds[w.idx % 16 + 2:], ''))
  FROM {} w JOIN {} s ON s.tree = w.tree AND s.level = w.level AND s.up = w.up"""

OP11_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))
), d AS (
  SELECT row_number() OVER () AS r, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS tree, doc_id, {_LEAF.format(_FIELD.format("text"))} AS leaf,
         CASE WHEN xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
                                   lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0
              THEN {_LEAF.format(_FIELD.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))} END AS tampered
  FROM documents, crc
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM d
), nodes(tree, n, level, idx, digest) AS (
  SELECT tree, n, 0, idx, leaf FROM leaves UNION ALL {_UPWARDS.format("nodes")}
), sides AS (
  SELECT tree, level, idx // 16 AS up, list(digest ORDER BY idx) AS ds FROM nodes WHERE n > 1 GROUP BY ALL
), subroots AS (
  SELECT tree AS source_tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
), above(tree, n, level, idx, digest) AS (
  SELECT '', n, 0, idx, subroot FROM subroots UNION ALL {_UPWARDS.format("above")}
), above_sides AS (
  SELECT tree, level, idx // 16 AS up, list(digest ORDER BY idx) AS ds FROM above WHERE n > 1 GROUP BY ALL
), walk(r, tree, level, idx, up, acc, proof) AS (
  SELECT r, tree, 0, idx, idx // 16, coalesce(tampered, leaf), '' FROM leaves UNION ALL {_STEP.format("walk", "sides")}
), arrived AS (
  SELECT r, arg_max(acc, level) AS acc, arg_max(proof, level) AS proof FROM walk GROUP BY r
), climb(r, tree, level, idx, up, acc, proof) AS (
  SELECT r, '', 0, s.idx, s.idx // 16, acc, proof FROM arrived JOIN leaves USING (r) JOIN subroots s ON tree = source_tree
  UNION ALL {_STEP.format("climb", "above_sides")}
), ended AS (
  SELECT r, arg_max(acc, level) AS acc, arg_max(proof, level) AS proof FROM climb GROUP BY r
)
SELECT doc_id, leaf, subroot, a.digest AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = a.digest AS verified
FROM leaves JOIN ended USING (r) JOIN subroots ON tree = source_tree, (SELECT digest FROM above WHERE n = 1) a
"""

OP13_SQL = r"""
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY k) AS group_size, row_number() OVER w = 1 AS kept, sha256(k) AS text_sha256
FROM (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents)
WINDOW w AS (PARTITION BY k ORDER BY n DESC, doc_id NULLS LAST)
"""

#: The others have learned parts, XXH64, a tokenizer or eigenvectors, which SQL has not; their tests compare them with brute force.
ORACLES: dict[str, str] = {"op6_suffix_dedup": OP6_SQL, "op6_suffix_sources": OP6_SOURCES_SQL, "op9_decontaminate": OP9_SQL, "op10_topk": OP10_SQL, "op11_merkle": OP11_SQL, "op13_exact_dedup": OP13_SQL}
