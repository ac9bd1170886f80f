"""Near copies by word shingles: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Equal sets collapse first. Candidates come from two places, and every candidate is confirmed by the similarity of the whole sets:

* the Gray-order index over SimHash fingerprints of the same shingles (``simhash.links``), which finds what differs in 4 of 64 bits;
* bands of ``ROWS`` minima, ``BANDS`` of them, for what it can't reach: at a similarity of 0.8 about ten bits differ, which no banding
  of 64 bits finds at size. A pair at 0.8 shares no band in 3 of 100,000 cases.

Every set of a band's group meets the first of it, in groups of more than ``GROUP`` also the last. Where a group still falls into several components,
the other pairs follow that would join two of them: all at once in small groups, in large ones between the sets outside the largest component and
those of other components, in blocks of ``PART``. Sizes and signatures (a byte of each minimum) discard most pairs before any set is sent, the whole sets
decide. A pair at 0.8 falls below ``AGREED`` agreeing bytes in one of a million cases. A group of one component, as groups of copies are,
costs its rows and not its pairs.

Words are op4's. Edge cases: a text of one to four words has one shingle; texts without words, null ones too, are copies of each other;
rows without a doc_id are copies like others and come after them in the order. Of a group the row with the smallest doc_id stays, of rows
that share it the one with the least md5 of its text, of those the least as JSON. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm import simhash
from cataloom.llm.components import components
from cataloom.llm.scratch import drop, tidy, written

#: Words of a shingle, least similarity of near copies.
WORDS, LEAST = 5, 0.8
#: Bands, minima of a band; sets of a group that all meet.
BANDS, ROWS, GROUP = 20, 4, 32
#: Agreeing bytes of two signatures that may be near; sets of a block of a large group.
AGREED, PART = 47, 2048

#: Bytes of texts whose results are held at once.
CHUNK = 1 << 20
#: Rows of ids and digests (40 bytes each) that are broadcast, so that texts needn't be shuffled to meet them; beyond, both sides are.
SMALL = 1_000_000

_R = np.random.default_rng(5)
_TIMES, _PLUS = _R.integers(0, 2**63, (2, BANDS * ROWS), np.uint64)
_TIMES = _TIMES * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """Hashes of a text's shingles, repeats included."""
    found = list(simhash.shingle_hashes(text or b"", WORDS))
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of each permutation over a set of shingles."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for lo in range(0, len(found), 256):
        np.minimum(least, (found[lo : lo + 256, None] * _TIMES + _PLUS).min(0), out=least)
    return least


def _mapped(docs: DataFrame, fields: str, row) -> DataFrame:
    """``row(shingles)`` for each document in the place of its text; a tuple of columns."""
    schema = docs.drop("text").sparkSession.createDataFrame([], docs.drop("text").schema.simpleString().removeprefix("struct<").removesuffix(">") + f", {fields}").schema
    names = [c for c in docs.columns if c != "text"]
    types = {"bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    own = [types[f.dataType.simpleString()] for f in schema[len(names) :]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.asarray(pc.fill_null(pc.binary_length(batch.column("text").cast(pa.binary())), 0), np.int64)
            chunk = np.cumsum(length + 64) // CHUNK  # rows up to some bytes of text at once, a longer text alone
            for lo, hi in zip(starts := np.flatnonzero(np.diff(chunk, prepend=-1)).tolist(), [*starts[1:], len(length)], strict=True):
                part = batch.slice(lo, hi - lo)
                rows = [row(shingles(t)) for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(own))], names=schema.names)

    return docs.mapInArrow(tidy(run), schema)


def _marks(found: np.ndarray) -> tuple:
    """Digest of the set, SimHash fingerprint, band keys, signature and size."""
    distinct = np.unique(found)
    least = minima(distinct)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), b) for b, row in enumerate(least.reshape(BANDS, ROWS))]
    return (xxhash.xxh3_128_digest(distinct.tobytes()), int(np.uint64(simhash.majority([found])).astype(np.int64)), np.array(keys, np.uint64).view(np.int64), least.astype(np.uint8).tobytes(), len(distinct))


def _sent(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast where it is counted to be small."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """(u, v) from the Gray-order index: a forest over sets with near fingerprints."""
    equal = nodes.groupBy("fp").agg(F.min("node").alias("v"))
    same = nodes.select("fp", F.col("node").alias("u")).join(equal, "fp").where("u <> v").select("u", "v")
    return simhash.links(equal.select("fp", F.col("v").alias("node"))).select("u", "v").union(same)


def _band_pairs(members: DataFrame) -> DataFrame:
    """(u, v) from ``members(key, node, n, least, most)``: each set of a group with the first of it, in large groups also with the last."""
    first = members.select(F.col("node").alias("u"), F.col("least").alias("v"))
    return first.union(members.where(F.col("n") > GROUP).select(F.col("node").alias("u"), F.col("most").alias("v"))).where("u <> v")


def _other_pairs(members: DataFrame, rooted: DataFrame) -> DataFrame:
    """(u, v): the other pairs of small groups, where they are not in one component by now."""
    few = members.where(F.col("n") <= GROUP).select("key", "node").join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = few.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key")
    few = few.join(split, "key", "left_semi")
    u, v = (few.select("key", F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "uv")
    return u.join(v, "key").where("u < v and root_u <> root_v").select("u", "v")


def _members(nodes: DataFrame) -> DataFrame:
    """(key, node, n, least, most) of the groups of two sets or more."""
    banded, path = written(nodes.select("node", F.explode("bands").alias("key")), "banded")
    sized = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    out, _ = written(banded.join(sized, "key"), "members")
    drop(nodes.sparkSession, path)
    return out


def join_parts(asks: list, known: list) -> list[tuple[int, int]]:
    """Edges between components, from two blocks of sets (node, root, signature, set): at most one for each pair of components that it joins."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    signature = np.frombuffer(b"".join(r[2] for r in known), np.uint8).reshape(len(known), -1)
    roots = np.array([r[1] for r in known])
    size = np.array([len(r[3]) for r in known])
    out = []
    for node, root, own, s in asks:
        mine = np.frombuffer(own, np.uint8)
        near = (roots != root) & (np.minimum(size, len(s)) >= LEAST * np.maximum(size, len(s)))
        near = np.flatnonzero(near)
        near = near[(signature[near] == mine).sum(1) >= AGREED]
        for k in near.tolist():
            a, b = find(root), find(int(roots[k]))
            if a == b:
                continue
            both = np.intersect1d(s, known[k][3], assume_unique=True).size
            if both >= LEAST * (len(s) + size[k] - both):
                parent[max(a, b)] = min(a, b)
                out.append((node, known[k][0]))
    return out


def _joined(members: DataFrame, nodes: DataFrame, sets: _Sets, rooted: DataFrame) -> DataFrame | None:
    """(u, v) near pairs between the components that large groups still fall into; None if there are none.

    Signatures and sizes go through all blocks, sets only to those blocks in which they may have a partner.
    """
    large = members.where(F.col("n") > GROUP).select("key", "node").join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sized = large.groupBy("key", "root").count()
    top = sized.groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("top"), F.max("count").alias("most"), F.sum("count").alias("n")).where("n > most")
    blocks = lambda n: F.ceil(n / PART).cast("int")
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows = large.join(top, "key").withColumns({"parts": blocks(F.col("n")), "asking": blocks(F.col("n") - F.col("most"))})
    known = rows.select("key", own(F.col("parts")).alias("part"), all_(F.col("asking")).alias("block"), F.lit(False).alias("asks"), "node", "root")
    asks = rows.where("root <> top").select("key", all_(F.col("parts")).alias("part"), own(F.col("asking")).alias("block"), F.lit(True).alias("asks"), "node", "root")
    dealt = known.union(asks).join(nodes.select("node", "signature", "size"), "node")

    def survive(table: pa.Table) -> pa.Table:
        near = survivors(table)
        return table.select(["key", "part", "block", "asks", "node", "root", "signature"]).filter(pa.array(near))

    kinds = "key long, part int, block int, asks boolean, node long, root long, signature binary"
    left, _ = written(dealt.groupBy("key", "part", "block").applyInArrow(survive, kinds), "survivors")
    if left.isEmpty():
        return None
    with_sets = left.join(sets.at(left), "node")

    def compare(table: pa.Table) -> pa.Table:
        values = [np.asarray(x.values) for x in table.column("s")]
        rows = list(zip(*(table.column(c).to_pylist() for c in ("node", "root", "signature")), values, strict=True))
        asking = table.column("asks").to_pylist()
        found = join_parts([r for r, a in zip(rows, asking, strict=True) if a], [r for r, a in zip(rows, asking, strict=True) if not a])
        return pa.Table.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(2)], names=["u", "v"])

    out, _ = written(with_sets.groupBy("key", "part", "block").applyInArrow(compare, "u long, v long"), "joined")
    return None if out.isEmpty() else out


def survivors(table: pa.Table) -> np.ndarray:
    """Which rows of a block (asks, root, size, signature) have one on the other side, of another component, that signature and size let be near."""
    asks, root, size = (table.column(c).to_numpy() for c in ("asks", "root", "size"))
    marks = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(len(table), -1)
    known, out = np.flatnonzero(~asks), np.zeros(len(table), bool)
    for i in np.flatnonzero(asks).tolist():
        near = known[(root[known] != root[i]) & (np.minimum(size[known], size[i]) >= LEAST * np.maximum(size[known], size[i]))]
        near = near[(marks[near] == marks[i]).sum(1) >= AGREED]
        if len(near):
            out[near] = out[i] = True
    return out


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct pairs (u, v) that sizes and signatures of ``nodes`` let be near: some eighty bytes a set are sent, no set."""
    ordered = pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    own = lambda x: nodes.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("signature").alias(f"signature_{x}"))
    met = ordered.join(own("u"), "u").join(own("v"), "v").where(F.least("size_u", "size_v") >= LEAST * F.greatest("size_u", "size_v"))
    out, _ = written(met.mapInArrow(tidy(_agreeing), "u long, v long"), "alike")
    return out


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(f"signature_{x}")).to_pylist()), np.uint8).reshape(len(batch), -1) for x in "uv")
        yield batch.select(["u", "v"]).filter(pa.array((a == b).sum(1) >= AGREED))


def _confirmed(alike: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets, of ``sets(node, s)``, are similar enough."""
    met = alike.join(sets.select(F.col("node").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("s").alias("b")), "v")
    both = F.size(F.array_intersect("a", "b"))
    out, _ = written(met.withColumn("both", both).where(F.col("both") >= LEAST * (F.size("a") + F.size("b") - F.col("both"))).select("u", "v"), "near")
    return out


class _Sets:
    """Whole sets of those nodes that are asked for, cut to 32 bits a shingle: two different shingles are taken for one in one of 4e9 cases."""

    def __init__(self, texts: DataFrame, marks: DataFrame, nodes: DataFrame):
        self.texts, self.nodes = texts, nodes.select("node", "first.doc_id", "first.mark")
        #: rows that stand there several times: the only ones of which one has to be chosen
        self.twice = marks.groupBy("doc_id", "mark").count().where("count > 1").select("doc_id", "mark", F.lit(True).alias("twice"))

    def of(self, pairs: DataFrame) -> DataFrame:
        return self.at(pairs.select(F.col("u").alias("node")).union(pairs.select("v")))

    def at(self, some: DataFrame) -> DataFrame:
        named = self.nodes.join(some.select("node").distinct(), "node", "left_semi")
        named = named.join(self.twice, named["doc_id"].eqNullSafe(self.twice["doc_id"]) & (named["mark"] == self.twice["mark"]), "left").select("node", named["doc_id"], named["mark"], F.coalesce("twice", F.lit(False)).alias("twice"))
        named, _ = written(named, "named")
        met = self.texts.join(_sent(named), self.texts["doc_id"].eqNullSafe(named["doc_id"]) & (self.texts["mark"] == named["mark"])).select("node", "twice", "text")
        cut = lambda found: (np.unique((found >> np.uint64(32)).astype(np.uint32)).view(np.int32),)
        one = _mapped(met.where("not twice").select("node", "text"), "s array<int>", cut)
        two = met.where("twice").groupBy("node").agg(F.first("text").alias("text"))
        out, _ = written(one.unionByName(_mapped(two, "s array<int>", cut)), "sets")
        return out


def groups(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``texts(doc_id, mark, text)``, marks being digests of texts: (doc_id, mark, digest) of every row, and (digest, root) of every set."""
    spark = texts.sparkSession
    marks, _ = written(_mapped(texts, "digest binary, fp long, bands array<long>, signature binary, size long", _marks), "marks")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    nodes = marks.groupBy("digest").agg(F.min(first).alias("first"), *(F.first(c).alias(c) for c in ("fp", "bands", "signature", "size")))
    nodes, _ = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = _members(nodes)
    proposed, proposed_path = written(_fingerprint_pairs(nodes).union(_band_pairs(members)), "candidates")
    pairs = _alike(proposed, nodes)
    drop(spark, proposed_path)
    sets = _Sets(texts, marks, nodes)
    edges = _confirmed(pairs, sets.of(pairs))
    rooted = components(edges)
    rest = _alike(_other_pairs(members, rooted), nodes)
    if not rest.isEmpty():
        edges = edges.union(_confirmed(rest, sets.of(rest)))
        rooted = components(edges)
    if more := _joined(members, nodes, sets, rooted):
        rooted = components(edges.union(more))
    rooted = nodes.select("node", "digest", "first").join(rooted, "node", "left").select("digest", "first", F.coalesce("root", "node").alias("root"))
    return marks.select("doc_id", "mark", "digest"), rooted


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, that with the smallest doc_id; all columns as they came."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("mark"), F.struct(*docs.columns).alias("row"))
    texts = packed.select("doc_id", "mark", F.coalesce(F.col("row.text").cast("string"), F.lit("")).alias("text"))
    rows, rooted = groups(texts)
    first = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.mark", F.lit(True).alias("stays"))
    counted = rows.groupBy("doc_id", "mark").count()
    same = counted["doc_id"].eqNullSafe(first["doc_id"]) & (counted["mark"] == first["mark"])
    state = counted.join(first, same, "left").select(counted["doc_id"], counted["mark"], "count", F.coalesce("stays", F.lit(False)).alias("stays"))
    # rows that go, or that are several: few beside those that simply stay, which are found by their absence
    odd, _ = written(state.where("not stays or count > 1").drop("count"), "odd")
    same = packed["doc_id"].eqNullSafe(odd["doc_id"]) & (packed["mark"] == odd["mark"])
    alone = packed.join(_sent(odd), same, "left_anti")
    several = packed.join(_sent(odd.where("stays")), same, "left_semi").groupBy("doc_id", "mark").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return alone.select("row.*").unionByName(several.select("row.*"))
