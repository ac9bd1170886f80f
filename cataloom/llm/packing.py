"""Best-fit packing of tokenised documents into sequences, with matching of large items.

The plan is made over piece lengths, not pieces: a histogram of at most ``capacity`` lengths is all that reaches the
driver. Pieces above a third of the capacity go at most two to a bin, by greedy matching (largest first, with the largest
partner that fits); smaller ones, in falling length, fill the smallest gap that holds them. Pieces then look up their place by
their rank among the pieces of equal length; ranks are counted over ranges of rows, so a hot length is spread over tasks. Full pieces, the
commonest of all, need neither rank nor plan: each is a sequence, with a negative number.

Edge cases: a null or empty text is one piece of the end token alone. Repeated rows are packed as often as they come. A
null doc_id is kept as null. An empty table gives an empty result. Extra columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.scratch import tidy, written
from cataloom.operators.keys import numbered

CAPACITY = 2048
END = 0
#: Latin words, and what stands in a text other than such words with single marks between them. The tokenizer lower-cases
#: such words and takes the marks apart; composed Latin letters are left as they are.
_WORD, _OTHER = re.compile("[a-zß-öø-ÿ]+"), re.compile("[^A-Za-zÀ-ÖØ-öø-ÿ \\n.,]|[.,]{2}")
#: Chunks whose ids a task remembers.
CACHE = 500_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """ids of whole texts. The vocabulary's tokens never span white space, so the ids of blank-separated chunks are remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    def _learn_words(self, new: list[str]) -> None:
        """Words of letters are one unit of the tokenizer each, so many are encoded as one text."""
        texts = [new[lo : lo + 500] for lo in range(0, len(new), 500)]
        for part, e in zip(texts, self.tokenizer.encode_batch([" ".join(x) for x in texts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4").tobytes()
            bounds = (4 * (np.flatnonzero(np.diff(e.word_ids)) + 1)).tolist()
            self.known.update((w, ids[a:b]) for w, a, b in zip(part, [0, *bounds], [*bounds, len(ids)], strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without special tokens around it."""
        if len(self.known) > CACHE:
            self.known = {}
        known = self.known
        split = [self._units(t or "") for t in texts]
        fresh = set().union(*split).difference(known)
        plain = [c for c in fresh if c.isalpha() and _WORD.fullmatch(c)]
        self._learn_words(plain)
        odd = list(fresh.difference(plain))
        for c, e in zip(odd, self.tokenizer.encode_batch(odd, add_special_tokens=False), strict=True):
            known[c] = np.array(e.ids, "<u4").tobytes()
        return [b"".join(map(known.__getitem__, units)) for units in split]

    @staticmethod
    def _units(text: str) -> list[str]:
        """Parts of a text that the tokenizer takes one by one."""
        if not _OTHER.search(text):
            return text.lower().replace(",", " , ").replace(".", " . ").split()
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


#: An encoder by path: Spark keeps its Python workers, and so what they remember, from task to task.
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    end = np.array([END], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), own.encode(part.column("text").to_pylist()), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        rows.append((doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(pieces), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of equal bins: (number of bins, [(length, pieces of it in each bin)])."""
    left = {s: n for s, n in counts.items() if n}
    large = sorted(s for s in left if 3 * s > capacity)
    gaps: dict[int, list[tuple[int, list]]] = {}
    order: list[int] = []

    def put(n: int, inside: list[tuple[int, int]], gap: int) -> None:
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append((n, inside))

    while large:
        a = large[-1]
        k = bisect_right(large, min(a, capacity - a)) - 1
        b = large[k] if k >= 0 else None
        if b == a and left[a] > 1:
            put(left[a] // 2, [(a, 2)], capacity - 2 * a)
            left[a] %= 2
        elif b is not None and (b != a or k > 0):
            b = b if b != a else large[k - 1]
            n = min(left[a], left[b])
            put(n, [(a, 1), (b, 1)], capacity - a - b)
            left[a] -= n
            left[b] -= n
            if not left[b]:
                large.remove(b)
        else:
            put(left[a], [(a, 1)], capacity - a)
            left[a] = 0
        if not left[a]:
            large.pop()

    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            k = bisect_left(order, s)
            if k == len(order):
                each = capacity // s
                if n >= each:
                    put(n // each, [(s, each)], capacity - each * s)
                if n % each:
                    put(1, [(s, n % each)], capacity - n % each * s)
                break
            gap = order[k]
            bins, inside = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(k)
            each = gap // s
            full = min(bins, n // each)
            if full:
                put(full, [*inside, (s, each)], gap - each * s)
                bins -= full
                n -= full * each
            if bins and n and n < each:
                put(1, [*inside, (s, n)], gap - n * s)
                bins -= 1
                n = 0
            if bins:
                put(bins, inside, gap)
    return [g for gap in order for g in gaps[gap]]


def places(groups: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """Per length, a table of (first rank, first bin, pieces in a bin, offset), by rank."""
    tables: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for bins, inside in groups:
        offset = 0
        for s, each in inside:
            tables.setdefault(s, []).append((ranks.get(s, 0), first, each, offset))
            ranks[s] = ranks.get(s, 0) + bins * each
            offset += s * each
        first += bins
    return {s: np.array(t, np.int64) for s, t in tables.items()}


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces, _ = written(cut(docs, path or tokenizer_path(), capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = dict(map(tuple, pieces.where(F.col("length") < capacity).groupBy("length").count().collect()))
    shared = docs.sparkSession.sparkContext.broadcast(places(plan(counts, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            rank = rank - 1
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            by = np.argsort(length, kind="stable")
            bounds = np.flatnonzero(np.diff(length[by])) + 1
            for rows in np.split(by, bounds):
                if len(rows):
                    s = int(length[rows[0]])
                    t = tables[s]
                    at = t[np.searchsorted(t[:, 0], rank[rows], "right") - 1]
                    sequence[rows] = at[:, 1] + (rank[rows] - at[:, 0]) // at[:, 2]
                    offset[rows] = at[:, 3] + (rank[rows] - at[:, 0]) % at[:, 2] * s
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = numbered(pieces.where(F.col("length") < capacity), ["length"], ["row"], "rank")
    shared_bins = ranked.mapInArrow(tidy(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    own_bin = pieces.where(F.col("length") == capacity).select(*kept, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return shared_bins.unionByName(own_bin)
