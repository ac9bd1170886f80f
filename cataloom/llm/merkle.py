"""A Merkle manifest of a table: a tree of digests a source, a tree over their roots, and a proof for every row.

Leaves are hashed by Spark's own functions, ranged by source and order, counted by range, and numbered. Each task walks the runs of its
ranges with a mountain-range stack: nodes wait at their level until the sixteenth of an aligned run carries them, as one digest, into the
level above; what the range's edges leave incomplete stays an open peak. Open peaks of all ranges then meet level by level, grouped by
their run of at most sixteen, and so do the short runs at a tree's end, which are hashed as they are, without padding. So no task
holds more than one stack and one batch, however many rows a source has. Roots of the sources are the leaves of one more such tree.

Proofs go downwards: every node's siblings are put before those of its parent, run by run, so a document costs one join with its parent
and the rest is shared by sixteen.

Edge cases: rows are ordered by doc_id, null first, then by leaf, so rows that share a doc_id have a fixed order and equal rows change places
freely; a null source is a source of its own, before all others. Null fields hash as ``-``, empty ones as ``0:``. A lone leaf is its source's root, a
lone source's root is the table's. Without rows there are no nodes and no root. Other columns of the table don't count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cataloom.llm.scratch import drop, written

#: Nodes of a run, and the fields of a leaf in their order.
FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<before:string,after:string>>"


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 over each field's byte count and value, or ``-`` for null."""
    said = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*said), 256)


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


class _Stack:
    """One range's mountains: the nodes of each level that no run of sixteen has taken up yet."""

    def __init__(self, key: str, n: int):
        self.key, self.n, self.waiting = key, n, []

    def push(self, level: int, index: int, digest: str, row: tuple, out: list[tuple]) -> None:
        if level == len(self.waiting):
            self.waiting.append([])
        run = self.waiting[level]
        run.append((index, digest, row))
        if index % FANOUT == FANOUT - 1:
            whole = len(run) == FANOUT
            self._emit(level, not whole, out)
            if whole:
                parent = hashlib.sha256("".join(x[1] for x in run).encode()).hexdigest()
                self.push(level + 1, index // FANOUT, parent, (None,) * len(row), out)
            self.waiting[level] = []

    def _emit(self, level: int, peak: bool, out: list[tuple]) -> None:
        out += [(self.key, self.n, level, index, digest, peak, *row) for index, digest, row in self.waiting[level]]

    def end(self, out: list[tuple]) -> None:
        for level in range(len(self.waiting)):
            self._emit(level, True, out)


def _walk(schema: pa.Schema):
    """Nodes of sorted leaves (key, range, before, n, digest, carried columns); ``schema`` is that of the nodes."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, at, index = None, None, 0
        for batch in batches:
            out: list[tuple] = []
            for key, part, before, n, digest, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (key, part):
                    if stack:
                        stack.end(out)
                    stack, at, index = _Stack(key, n), (key, part), before
                stack.push(0, index, digest, tuple(row), out)
                index += 1
            yield _batch(out, schema)
        if stack:
            stack.end(out := [])
            yield _batch(out, schema)

    return walk


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Tree:
    """One tree a key, from leaves (key, digest) in a total order.

    ``leaves`` has key, n (the key's leaves), index, digest and the ``carried`` columns, ``upper`` the nodes above, with their level. Both lie in the shared
    folder until ``drop``.
    """

    def __init__(self, leaves: DataFrame, order: Sequence[str], carried: Sequence[str] = ()):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.spark, self.carried = leaves.sparkSession, list(carried)
        ranged, ranged_path = written(leaves.repartitionByRange("key", *order).withColumn("range", F.spark_partition_id()), "leaves")
        whole = Window.partitionBy("key")
        before = F.sum("rows").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
        counts = ranged.groupBy("key", "range").agg(F.count("*").alias("rows"))
        counts = counts.select("key", "range", F.coalesce(before, F.lit(0)).alias("before"), F.sum("rows").over(whole).alias("n"))
        counts, counts_path = written(counts, "counts")
        placed = ranged.join(counts, ["key", "range"]).repartition("key", "range").sortWithinPartitions("key", "range", *order)
        kinds = {f.name: f.dataType.simpleString() for f in leaves.schema}
        spec = ", ".join(["key string", "n long", "level int", "index long", "digest string", "peak boolean", *[f"`{c}` {kinds[c]}" for c in self.carried]])
        schema = to_arrow_schema(self.spark.createDataFrame([], spec).schema)
        nodes = placed.select("key", "range", "before", "n", "digest", *self.carried).mapInArrow(_walk(schema), spec)
        nodes, nodes_path = written(nodes, "nodes")
        most = counts.agg(F.max("n")).first()[0] or 0
        drop(self.spark, ranged_path, counts_path)
        self.paths, self.height = [nodes_path], 0
        while FANOUT**self.height < most:
            self.height += 1
        self.leaves = nodes.where("level = 0").drop("peak", "level")
        self._merge(nodes)

    def _merge(self, nodes: DataFrame) -> None:
        """Peaks of all ranges meet, level by level."""
        columns = ["key", "n", "index", "digest"]
        peaks, peaks_path = written(nodes.where("peak").select("level", *columns), "peaks")
        self.upper, path = written(nodes.where("level > 0").select("level", *columns), "upper")
        self.paths.append(path)
        met = None
        for level in range(self.height):
            own = peaks.where(F.col("level") == level).select(columns)
            own = (own if met is None else own.unionByName(met)).where(F.col("n") > FANOUT**level)
            run = F.transform(F.array_sort(F.collect_list(F.struct("index", "digest"))), lambda x: x["digest"])
            met = own.groupBy("key", "n", F.expr(f"index div {FANOUT}").alias("index")).agg(F.sha2(_joined(run), 256).alias("digest"))
            met, path = written(met.select(columns), "merged")
            self.paths.append(path)
            self.upper = self.upper.unionByName(met.withColumn("level", F.lit(level + 1)))
        drop(self.spark, peaks_path)

    def level(self, level: int) -> DataFrame:
        return self.upper.where(F.col("level") == level).drop("level") if level else self.leaves

    def nodes(self) -> DataFrame:
        """key, level, index and digest of all nodes."""
        return self.leaves.select("key", F.lit(0).alias("level"), "index", "digest").unionByName(self.upper.select("key", "level", "index", "digest"))

    def _of_height(self, level: int) -> Column:
        """Whether a key's root is at this level."""
        return F.col("n").between((FANOUT ** (level - 1) if level else 0) + 1, FANOUT**level)

    def roots(self) -> DataFrame:
        """(key, n, digest) of every key's root."""
        return reduce(DataFrame.unionByName, [self.level(k).where(self._of_height(k)).select("key", "n", "digest") for k in range(self.height + 1)])

    def proofs(self, above: DataFrame) -> DataFrame:
        """The leaves with ``path``: for each level upwards what stands before and after the own node in its run.

        ``above`` (key, n, path, further columns) goes on from the roots; its further columns come along.
        """
        rest = [c for c in above.columns if c not in ("key", "n")]
        found = None
        for level in range(self.height, -1, -1):
            up = above.where(self._of_height(level)).select("key", F.lit(0).cast("long").alias("up"), *rest)
            if found is not None:
                up = up.unionByName(found.select("key", F.col("index").alias("up"), *rest))
            nodes = self.level(level)
            own = [c for c in nodes.columns if c not in ("key", "n")]
            runs = nodes.groupBy("key", "n", F.expr(f"index div {FANOUT}").alias("up")).agg(F.array_sort(F.collect_list(F.struct(*own))).alias("run"))
            each = runs.join(up, ["key", "up"]).select("*", F.transform("run", lambda x: x["digest"]).alias("digests"), F.posexplode("run").alias("at", "own"))
            beside = F.struct(_joined(F.slice("digests", F.lit(1), F.col("at"))).alias("before"), _joined(F.slice("digests", F.col("at") + 2, F.lit(FANOUT))).alias("after"))
            path = F.when(F.col("n") <= FANOUT**level, F.col("path")).otherwise(F.concat(F.array(beside), "path"))
            found = each.select("key", *[F.col("own")[c].alias(c) for c in own], path.alias("path"), *[c for c in rest if c != "path"])
        return found

    def drop(self) -> None:
        drop(self.spark, *self.paths)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda digest, side: F.sha2(F.concat(side["before"], digest, side["after"]), 256))


def _leaves(documents: DataFrame) -> DataFrame:
    """key, doc_id, digest, and as ``tampered`` the leaf of the lower-cased text where the row is to be tampered with."""
    fields = [F.col(c) for c in FIELDS]
    lowered = [F.translate(c, _UPPER, _LOWER) if name == "text" else c for name, c in zip(FIELDS, fields, strict=True)]
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    key = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))
    return documents.select(key.alias("key"), "doc_id", leaf_digest(fields).alias("digest"), F.when(chosen, leaf_digest(lowered)).alias("tampered"))


def manifest(documents: DataFrame) -> DataFrame:
    """All nodes of the manifest: source (null also for the tree over the sources), level, index, digest, and ``of_sources`` for that tree's nodes."""
    trees = Tree(_leaves(documents).select("key", "doc_id", "digest"), ["doc_id", "digest"])
    top = Tree(trees.roots().select(F.lit("").alias("key"), F.col("key").alias("source_key"), "digest"), ["source_key"])
    source = F.when(F.col("key").startswith("1"), F.substring("key", 2, 2**31 - 1))
    return trees.nodes().select(source.alias("source"), "level", "index", "digest", F.lit(False).alias("of_sources")).unionByName(
        top.nodes().select(F.lit(None).cast("string").alias("source"), "level", "index", "digest", F.lit(True).alias("of_sources"))
    )


def prove(documents: DataFrame) -> DataFrame:
    """The proof of every row and what comes of it when some texts are tampered with."""
    trees = Tree(_leaves(documents), ["doc_id", "digest"], ["doc_id", "tampered"])
    top = Tree(trees.roots().select(F.lit("").alias("key"), F.col("key").alias("source_key"), F.col("n").alias("leaves"), "digest"), ["source_key"], ["source_key", "leaves"])
    root = top.roots().select("key", "n", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    above = top.proofs(root).select(F.col("source_key").alias("key"), F.col("leaves").alias("n"), "path", F.col("digest").alias("subroot"), "root")
    above, _ = written(above, "above")  # a row a source, read at every level
    rows = trees.proofs(above)
    siblings = _joined(F.transform("path", lambda side: F.concat(side["before"], side["after"])))
    return rows.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
        fold(F.coalesce("tampered", "digest"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
