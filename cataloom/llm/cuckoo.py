"""Exact dedup by an index of cuckoo filters over content digests.

The index is dealt to shards by digest. In a shard a filter of four-slot buckets holds a 16-bit fingerprint of every live digest, which may
stand in either of two buckets and is moved on when both are full. A lookup that meets its fingerprint is only a hit when the whole SHA-256
kept with that slot agrees; a shard that can't place a digest doubles its buckets and takes the digests in again from the stored ones.
Digests are deleted when their last row goes.

Rows are numbered as they are digested and cut into parts of ``PART`` rows. A first pass runs them through an index of each part, so a text
that is a third of all rows comes to its shard once a part, not once a row; the shard answers each part with the group's size and the row that
stays, and rows meet that answer by part and digest. So no key holds more rows than a part has, and no list of members is ever gathered.

Edge cases: a null text is an empty one, and texts of white space alone are equal to it. Of equal texts with equally many code points the
smallest doc_id stays, a row without one last; of rows that agree in that too, one. Without rows there are no groups.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.scratch import written

#: Rows of a part; rows that a shard is meant for; slots of a bucket; moves before a filter grows.
PART, SHARD, SLOTS, MOVES = 1 << 16, 200_000, 4, 250


class CuckooIndex:
    """Digests (bytes of SHA-256) with the state of their groups: number of rows and the best row."""

    def __init__(self, buckets: int = 256):
        self.digests: list[bytes | None] = []
        self.sizes: list[int] = []
        self.best: list[Any] = []
        self.free: list[int] = []
        self.resizes = 0
        self._clear(buckets)

    def __len__(self) -> int:
        return len(self.digests) - len(self.free)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.marks = array("H", bytes(2 * SLOTS * buckets))
        self.entries = array("q", bytes(8 * SLOTS * buckets))

    @staticmethod
    def _mark(digest: bytes) -> int:
        return int.from_bytes(digest[:2], "little") or 1

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def find(self, digest: bytes) -> int:
        """The slot of a digest, or -1: a fingerprint counts only with the stored digest."""
        mark, bucket = self._mark(digest), int.from_bytes(digest[2:10], "little") & self.mask
        for b in (bucket, self._other(bucket, mark)):
            for slot in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.marks[slot] == mark and self.digests[self.entries[slot]] == digest:
                    return slot
        return -1

    def _place(self, entry: int) -> bool:
        digest = self.digests[entry]
        mark, bucket = self._mark(digest), int.from_bytes(digest[2:10], "little") & self.mask
        for b in (bucket, self._other(bucket, mark)):
            for slot in range(b * SLOTS, b * SLOTS + SLOTS):
                if not self.marks[slot]:
                    self.marks[slot], self.entries[slot] = mark, entry
                    return True
        moved = []
        for k in range(MOVES):
            slot = bucket * SLOTS + (k + mark) % SLOTS
            moved.append((slot, self.marks[slot], self.entries[slot]))
            self.marks[slot], self.entries[slot], mark, entry = mark, entry, self.marks[slot], self.entries[slot]
            bucket = self._other(bucket, mark)
            for free in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.marks[free]:
                    self.marks[free], self.entries[free] = mark, entry
                    return True
        for slot, mark, entry in reversed(moved):
            self.marks[slot], self.entries[slot] = mark, entry
        return False

    def _grow(self) -> None:
        """Twice the buckets, filled from the stored digests; again where even these don't do."""
        buckets = self.mask + 1
        live = [i for i, d in enumerate(self.digests) if d is not None]
        while True:
            buckets *= 2
            self.resizes += 1
            self._clear(buckets)
            if all(self._place(i) for i in live):
                return

    def add(self, digest: bytes, rows: int, best: Any) -> int:
        """Takes in rows of a digest, the least of ``best`` stays; returns the entry."""
        slot = self.find(digest)
        if slot >= 0:
            entry = self.entries[slot]
            self.sizes[entry] += rows
            if best < self.best[entry]:
                self.best[entry] = best
            return entry
        if self.free:
            entry = self.free.pop()
            self.digests[entry], self.sizes[entry], self.best[entry] = digest, rows, best
        else:
            entry = len(self.digests)
            self.digests.append(digest)
            self.sizes.append(rows)
            self.best.append(best)
        if not self._place(entry):
            self._grow()
        return entry

    def remove(self, digest: bytes, rows: int) -> bool:
        """Takes rows of a digest out, and with its last row the digest; whether it was there."""
        slot = self.find(digest)
        if slot < 0:
            return False
        entry = self.entries[slot]
        self.sizes[entry] -= rows
        if self.sizes[entry] <= 0:
            self.marks[slot] = 0
            self.digests[entry] = self.best[entry] = None
            self.free.append(entry)
        return True


def digested(documents: DataFrame) -> DataFrame:
    """doc_id, row, part, digest and points (code points of the text as it was). Rows are numbered as they are read: write the result before use."""
    text = F.coalesce("text", F.lit(""))
    plain = F.translate(text, " \t\n\x0b\f\r", "")
    rows = documents.select("doc_id", F.unhex(F.sha2(plain, 256)).alias("digest"), F.length(text).cast("long").alias("points"))
    return rows.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", PART.bit_length() - 1))


def _rank(points: int, doc_id: Any, row: int) -> tuple:
    return (-points, doc_id is None, 0 if doc_id is None else doc_id, row)


def _columns(batch: pa.RecordBatch, *names: str) -> zip:
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def _table(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _groups_of_parts(schema: pa.Schema):
    """Rows to groups (part, digest, rows, best row), one index a part."""

    def out(part: int, index: CuckooIndex) -> pa.RecordBatch:
        points, ids, rows = [], [], []
        for best in index.best:
            points.append(-best[0])
            ids.append(None if best[1] else best[2])
            rows.append(best[3])
        return _table([[part] * len(index), index.digests, index.sizes, points, ids, rows], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index = None, None
        for batch in batches:
            for part, digest, points, doc_id, row in _columns(batch, "part", "digest", "points", "doc_id", "row"):
                if part != at:
                    if index is not None:
                        yield out(at, index)
                    at, index = part, CuckooIndex()
                index.add(digest, 1, _rank(points, doc_id, row))
        if index is not None:
            yield out(at, index)

    return run


def _answers(schema: pa.Schema, parts: bool):
    """Groups of parts to groups of the shard: to each part that has more than its own row (``parts``), or once a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, asked = CuckooIndex(), []
        for batch in batches:
            entries = []
            for part, digest, rows, points, doc_id, row in _columns(batch, "part", "digest", "rows", "points", "doc_id", "row"):
                entries.append((index.add(digest, rows, _rank(points, doc_id, row)), part))
            asked.append(np.array(entries, np.int64).reshape(-1, 2))
        if not asked:
            return
        sizes = np.array(index.sizes, np.int64)
        if parts:
            # a part whose rows were split over tasks asks twice
            pairs = np.unique(np.concatenate(asked), axis=0)
            pairs = pairs[sizes[pairs[:, 0]] > 1]
        else:
            pairs = np.column_stack([np.arange(len(sizes)), np.zeros(len(sizes), np.int64)])
        for lo in range(0, len(pairs), 10_000):
            some = pairs[lo : lo + 10_000]
            best = [index.best[e] for e in some[:, 0]]
            yield _table([some[:, 1], [index.digests[e] for e in some[:, 0]], sizes[some[:, 0]], [-b[0] for b in best], [None if b[1] else b[2] for b in best], [b[3] for b in best]], schema)

    return run


def _spec(rows: DataFrame) -> str:
    return f"part long, digest binary, rows long, points long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, row long"


def _sharded(partial: DataFrame, n_rows: int, parts: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = partial.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // SHARD))
    return partial.repartition(shards, "digest").mapInArrow(_answers(to_arrow_schema(partial.schema), parts), partial.schema)


def _partial(rows: DataFrame) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    spec = _spec(rows)
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], spec).schema)
    return rows.select("part", "digest", "points", "doc_id", "row").mapInArrow(_groups_of_parts(schema), spec)


def build(rows: DataFrame) -> DataFrame:
    """The index of digested rows, a row for each live digest: digest, rows, and points, doc_id and row of the one that stays."""
    return _sharded(_partial(rows), rows.count(), parts=False).drop("part")


def update(index: DataFrame, live: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The index after rows have come and gone; all but the index as ``digested`` gives them, ``live`` being the rows as they are now.

    Every shard loads its digests, adds and removes, and deletes what has no row left. Only groups whose staying row has gone are
    looked at again in ``live``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    key = ["digest", "rows", "points", "doc_id", "row"]
    changes = _partial(removed).withColumns({"rows": -F.col("rows"), "points": F.lit(0).cast("long"), "doc_id": F.lit(None).cast(index.schema["doc_id"].dataType), "row": F.lit(-1).cast("long")})
    every = index.select(key).unionByName(_partial(added).select(key)).unionByName(changes.select(key))
    schema = to_arrow_schema(every.select(key).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, leaving = CuckooIndex(), []
        for batch in batches:
            for digest, rows, points, doc_id, row in _columns(batch, *key):
                if rows > 0:
                    shard.add(digest, rows, _rank(points, doc_id, row))
                else:
                    leaving.append((digest, -rows))
        for digest, rows in leaving:
            shard.remove(digest, rows)
        left = [(d, n, b) for d, n, b in zip(shard.digests, shard.sizes, shard.best, strict=True) if d is not None]
        yield _table([[x[0] for x in left], [x[1] for x in left], [-x[2][0] for x in left], [None if x[2][1] else x[2][2] for x in left], [x[2][3] for x in left]], schema)

    after = every.repartition("digest").mapInArrow(run, every.select(key).schema)
    after, _ = written(after, "index")
    gone = removed.select(F.col("digest").alias("__digest"), F.col("doc_id").alias("__id"), F.col("points").alias("__points")).distinct()
    lost = (F.col("digest") == F.col("__digest")) & F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("points") == F.col("__points"))
    doubtful = after.join(gone, lost, "left_semi").select("digest")
    again = build(live.join(doubtful, "digest", "left_semi"))
    return after.join(doubtful, "digest", "left_anti").select(key).unionByName(again.select(key))


def dedup(documents: DataFrame) -> DataFrame:
    """Every row with the row of its group that stays."""
    rows, _ = written(digested(documents), "digests")
    answers = _sharded(_partial(rows), rows.count(), parts=True)
    said = answers.select(F.col("part").alias("__part"), F.col("digest").alias("__digest"), F.col("rows").alias("group_size"), F.col("doc_id").alias("keep_id"), F.col("row").alias("__keep"))
    joined = rows.join(said, (F.col("part") == F.col("__part")) & (F.col("digest") == F.col("__digest")), "left")
    alone = F.col("__keep").isNull()
    return joined.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("__keep") == F.col("row"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
