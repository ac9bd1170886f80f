"""Benchmark decontamination by Wu-Manber multi-pattern search.

Patterns are the 10-word windows of the benchmark items (a shorter item is one window), as normalised bytes
`` word word ... `` with a space at either end. Each length class has a block shift table: a block of bytes that stands
in no pattern lets the search skip ahead, a zero shift leads to the bucket of the block's suffix hash, and a direct comparison of bytes
confirms. The search steps along many stretches of a batch at once in numpy.

The documents are only mapped: no shuffle, no hot keys. The benchmark is read in blocks of at most ``BLOCK_CHARS``
characters; each block is one bounded broadcast and one pass, so a large benchmark costs passes, not memory.

Edge cases: null texts, or texts without a word, give n_words 0 and no hits. Items without a word have no window. A
null item_id stands as the empty string; rows that repeat an item_id count as one item. Repeated documents give
repeated rows. An empty benchmark leaves all documents clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.scratch import tidy, written

#: Consecutive words of a window.
WINDOW = 10
#: Most characters of benchmark text that are broadcast at once.
BLOCK_CHARS = 8_000_000
#: Entries of a shift table, and stretches searched side by side.
TABLE, LANES = 1 << 18, 4096
#: Documents are searched in buffers of about this many bytes.
BUFFER = 4 << 20

#: Bytes outside words become spaces, A-Z becomes a-z; bytes of non-ASCII characters belong to words.
_FOLD = bytes(32 if b < 0x30 or 0x39 < b < 0x41 or 0x5A < b < 0x61 or 0x7A < b < 0x80 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8: runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return (text or b"").translate(_FOLD).split()


def windows(text: bytes | None, size: int = WINDOW) -> set[bytes]:
    w = words(text)
    return {b" " + b" ".join(w[i : i + size]) + b" " for i in range(max(1, len(w) - size + 1))} if w else set()


class WuManber:
    """Finds all occurrences of byte patterns. One table per class of pattern lengths, so short patterns don't shorten all shifts."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = sorted(set(patterns))
        classes: dict[int, list[int]] = {}
        for i, p in enumerate(self.patterns):
            classes.setdefault(min(len(p).bit_length(), 6), []).append(i)
        self.tables = [self._table(members) for _, members in sorted(classes.items())]

    def _table(self, members: list[int]) -> dict:
        least = min(len(self.patterns[i]) for i in members)
        block = min(4, least)
        heads = np.frombuffer(b"".join(self.patterns[i][:least] for i in members), np.uint8).reshape(-1, least)
        shift = np.full(TABLE, least - block + 1, np.int32)
        for end in range(block, least + 1):
            np.minimum.at(shift, _block_hash(heads, end, block), least - end)
        suffix = min(8, least)
        keys = _pack(heads, least, suffix)
        buckets: dict[int, list[int]] = {}
        for key, i in zip(keys.tolist(), members, strict=True):
            buckets.setdefault(key, []).append(i)
        return {"least": least, "block": block, "shift": shift, "suffix": suffix, "keys": np.unique(keys), "buckets": buckets}

    def find(self, buffer: bytes) -> list[tuple[int, int]]:
        """(start, pattern number) of every occurrence, overlapping ones too."""
        data = np.frombuffer(buffer, np.uint8)
        found = []
        for t in self.tables:
            least, block = t["least"], t["block"]
            if len(data) < least:
                continue
            edges = np.linspace(least, len(data) + 1, min(LANES, len(data)) + 1).astype(np.int64)
            at, stop = edges[:-1].copy(), edges[1:]
            live = at < stop
            at, stop = at[live], stop[live]
            ends = []
            while len(at):
                h = _block_hash_at(data, at, block)
                step = t["shift"][h]
                zero = step == 0
                if zero.any():
                    ends.append(at[zero])
                    step = step + zero
                at = at + step
                live = at < stop
                if not live.all():
                    at, stop = at[live], stop[live]
            if not ends:
                continue
            end = np.concatenate(ends)
            key = _pack_at(data, end, t["suffix"])
            pos = np.searchsorted(t["keys"], key)
            pos[pos == len(t["keys"])] = 0
            same = t["keys"][pos] == key
            for e, k in zip(end[same].tolist(), key[same].tolist(), strict=True):
                for i in t["buckets"][k]:
                    if buffer.startswith(self.patterns[i], e - least):
                        found.append((e - least, i))
        return found


def _block_hash(heads: np.ndarray, end: int, block: int) -> np.ndarray:
    return _mix(_pack(heads, end, block))


def _block_hash_at(data: np.ndarray, end: np.ndarray, block: int) -> np.ndarray:
    return _mix(_pack_at(data, end, block))


def _pack(heads: np.ndarray, end: int, n: int) -> np.ndarray:
    out = np.zeros(len(heads), np.uint64)
    for k in range(n):
        out = (out << np.uint64(8)) | heads[:, end - n + k].astype(np.uint64)
    return out


def _pack_at(data: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(end), np.uint64)
    for k in range(n):
        out = (out << np.uint64(8)) | data[end - n + k].astype(np.uint64)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)


def _search(matcher: WuManber, owners: list[list[str]], texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, set[str]]]:
    """n_words, sorted hit word numbers and ids of the items found, of each text."""
    group: list[bytes] = []
    counts: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        w = words(text)
        group.append(b" " + b" ".join(w) + b" ")
        counts.append(len(w))
        size += len(group[-1])
        if size < BUFFER and i + 1 < len(texts):
            continue
        starts = np.cumsum([0, *(len(g) + 1 for g in group)])
        hits: dict[int, list[tuple[int, int]]] = {}
        found = matcher.find(b"\n".join(group))
        for (pos, pattern), d in zip(found, np.searchsorted(starts, [f[0] for f in found], "right").tolist() if found else [], strict=True):
            hits.setdefault(d - 1, []).append((pos - int(starts[d - 1]), pattern))
        for d, n in enumerate(counts):
            if d not in hits:
                yield n, np.empty(0, np.int64), set()
                continue
            spaces = np.flatnonzero(np.frombuffer(group[d], np.uint8) == 32)
            first = np.searchsorted(spaces, [p for p, _ in hits[d]])
            length = np.array([matcher.patterns[k].count(b" ") - 1 for _, k in hits[d]])
            delta = np.zeros(n + 1, np.int64)
            np.add.at(delta, first, 1)
            np.add.at(delta, first + length, -1)
            yield n, np.flatnonzero(np.cumsum(delta)[:n]), {x for _, k in hits[d] for x in owners[k]}
        group, counts, size = [], [], 0


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple]]:
    """The benchmark's rows in blocks of about ``block_chars`` characters."""
    bench = benchmark.select("item_id", F.col("text").alias("item"))
    n = max(1, -(-(bench.agg(F.sum(F.length("item"))).first()[0] or 0) // block_chars))
    for b in range(n):
        yield [tuple(r) for r in bench.where(F.pmod(F.coalesce(F.xxhash64("item"), F.lit(0)), F.lit(n)) == b).collect()]


def _owners(items: list[tuple], window: int) -> tuple[list[bytes], list[list[str]]]:
    """Patterns and the ids of the items that hold each."""
    owners: dict[bytes, set[str]] = {}
    for item_id, text in items:
        for p in windows(text.encode() if text is not None else None, window):
            owners.setdefault(p, set()).add("" if item_id is None else str(item_id))
    return sorted(owners), [sorted(owners[p]) for p in sorted(owners)]


def _pass(docs: DataFrame, items: list[tuple], window: int) -> DataFrame:
    """One pass with one block of the benchmark: adds to the hits and items found so far. One row stays one row."""
    shared = docs.sparkSession.sparkContext.broadcast(_owners(items, window))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, owned = shared.value
        matcher = WuManber(patterns)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = list(_search(matcher, owned, part.column("text").cast(pa.binary()).to_pylist()))
                hits, names = ([x or () for x in part.column(c).to_pylist()] for c in ("hits", "items"))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text"),
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([np.union1d(h, r[1]).astype(np.int64) for h, r in zip(hits, rows, strict=True)], pa.list_(pa.int64())),
                        pa.array([sorted({*k, *r[2]}) for k, r in zip(names, rows, strict=True)], pa.list_(pa.string())),
                    ],
                    names=["doc_id", "text", "n_words", "hits", "items"],
                )

    return docs.mapInArrow(tidy(search), "doc_id long, text string, n_words long, hits array<long>, items array<string>")


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_words, hits (numbers of the hit words), items (ids of items with an occurring window), per document.

    A benchmark of more than ``block_chars`` characters is searched block by block; between two passes the table is written.
    """
    none = F.array()
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), none.cast("array<long>").alias("hits"), none.cast("array<string>").alias("items"))
    for b, items in enumerate(_blocks(benchmark, block_chars)):
        out = _pass(written(out, "windows")[0] if b else out, items, window)
    return out.drop("text")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Digest per document: counts, the hash of the sorted item ids, and whether any word is hit."""
    found = find_windows(docs, benchmark, window)
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any hit word, all columns as they came. Rows are filtered where they are; nothing is shuffled."""
    kept = docs
    for items in _blocks(benchmark, BLOCK_CHARS):
        shared = docs.sparkSession.sparkContext.broadcast(_owners(items, window)[0])

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = WuManber(shared.value)
            none = [[] for _ in matcher.patterns]
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    part = batch.slice(lo, 512)
                    hit = [len(r[1]) > 0 for r in _search(matcher, none, part.column("text").cast(pa.binary()).to_pylist())]
                    yield part.filter(pa.array([not h for h in hit], pa.bool_()))

        kept = kept.mapInArrow(tidy(clean), docs.schema)
    return kept
