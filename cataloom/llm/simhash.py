"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints of equal value collapse first, so groups of exact copies cost one row. Distinct ones are dealt to blocks that
agree in one of five bit bands: of two fingerprints that differ in at most four bits, one band is equal in both, so no link
is lost. Where there are too many for that, blocks agree in two of six bands, or three of seven. In a block, fingerprints are sorted by Gray rank,
which puts those with shared bit patterns side by side. Leaves of sixteen hold the bits that all their members share; upper nodes hold what their
children share. Two nodes whose shared bits differ too often are dropped with all that lies below them; nodes already known to be connected are
dropped too. A block sends on a spanning forest, not its pairs. Blocks beyond ``BLOCK_ROWS`` are split in parts that meet pairwise.

Edge cases: a text without words (null, empty, blank) has fingerprint zero and links like any other. A null doc_id takes no part
in linking; its row gets the component of its fingerprint, null if no other row has that. Repeated rows stay rows. An empty table
gives an empty result; extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.components import components
from cataloom.llm.scratch import written

#: Words of a shingle, seed of its hash, most differing bits of a link.
WORDS, SEED, BITS = 4, 42, 4
#: Rows of a block before it is split; members of a node.
BLOCK_ROWS, FAN = 65_536, 16
#: Bytes of a text whose words are held at once.
STRETCH = 1 << 20

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, size: int) -> Iterator[np.ndarray]:
    """XXH64 of all shingles, some at a time. Words are runs of bytes other than space and 09-0D, A-Z lower-cased."""
    text = text.translate(_FOLD)
    carry: list[bytes] = []
    short = True
    at = 0
    while at < len(text) or at == 0:
        stop = at + STRETCH
        while stop < len(text) and text[stop] not in b" \t\n\v\f\r":
            stop += 1
        words = carry + text[at:stop].split()
        at = max(stop, 1)
        n = len(words) - size + 1
        if n > 0:
            short = False
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            digest = xxhash.xxh64_intdigest
            yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)
        carry = words[max(0, n) :]
    if short and carry:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)


def majority(hashes: Iterable[np.ndarray]) -> int:
    """A bit is set where it is set in over half of the hashes; zero without hashes."""
    total, ones = 0, np.zeros((8, 8), np.int64)
    for h in hashes:
        total += len(h)
        columns = h.astype("<u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[k] += np.bincount(columns[:, k], minlength=256) @ _BYTE_BITS
    return int(np.packbits((ones * 2 > total).reshape(-1), bitorder="little").view("<u8")[0]) if total else 0


def fingerprint(text: bytes | None, size: int = WORDS) -> int:
    """SimHash of a text's shingles."""
    return majority(shingle_hashes(text or b"", size))


def fingerprints(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """doc_id and the fingerprint as a signed long, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                values = np.array([fingerprint(t, size) for t in part.column("text").cast(pa.binary()).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a bit pattern in the Gray code's order."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(k))
    return x


def _levels(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pattern, shared bits) of the nodes, from the fingerprints up to the roots."""
    pattern, shared = fp, np.full(len(fp), 0xFFFFFFFFFFFFFFFF, np.uint64)
    out = [(pattern, shared)]
    while len(pattern) > FAN:
        firsts = np.arange(0, len(pattern), FAN)
        same_one, same_zero = pattern & shared, ~pattern & shared
        one, zero = np.bitwise_and.reduceat(same_one, firsts), np.bitwise_and.reduceat(same_zero, firsts)
        pattern, shared = one, one | zero
        out.append((pattern, shared))
    return out


def _hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of a and b; afterwards root[x] is the smallest position of x's tree."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def link_block(fp: np.ndarray, bits: int = BITS) -> np.ndarray:
    """For each fingerprint of a block sorted by Gray rank, the position of its tree's root."""
    levels = _levels(fp)
    root = np.arange(len(fp))
    top = len(levels) - 1
    n = len(levels[top][0])
    stack = [(top, *np.triu_indices(n))]
    while stack:
        level, a, b = stack.pop()
        if len(a) > 8192:  # a bounded part of the pairs at a time
            for lo in range(0, len(a), 8192):
                stack.append((level, a[lo : lo + 8192], b[lo : lo + 8192]))
            continue
        pattern, shared = levels[level]
        near = np.bitwise_count((pattern[a] ^ pattern[b]) & shared[a] & shared[b]) <= bits
        a, b = a[near], b[near]
        if level == 0:
            _hook(root, a, b)
            continue
        span = FAN**level
        firsts = np.arange(0, len(fp), span)
        low, high = np.minimum.reduceat(root, firsts), np.maximum.reduceat(root, firsts)
        open_ = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
        a, b = a[open_], b[open_]
        below = len(levels[level - 1][0])
        k = np.arange(FAN)
        x = np.broadcast_to((a[:, None] * FAN + k)[:, :, None], (len(a), FAN, FAN)).reshape(-1)
        y = np.broadcast_to((b[:, None] * FAN + k)[:, None, :], (len(b), FAN, FAN)).reshape(-1)
        ok = (x < below) & (y < below) & (x <= y)
        if ok.any():
            stack.append((level - 1, x[ok], y[ok]))
    return root


def _link_run(tile: np.ndarray, fp: np.ndarray, node: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges of whole blocks: rows ordered by block. The bits that a block shares don't change the Gray order of the others."""
    order = np.lexsort((gray_rank(fp), tile))
    tile, fp, node = tile[order], fp[order], node[order]
    starts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
    length = np.diff(np.append(starts, len(tile)))
    root = np.arange(len(tile))
    small = np.repeat(length <= FAN, length)
    for step in range(1, FAN):  # blocks of one leaf: all of them side by side
        a = np.flatnonzero(small[:-step] & (tile[:-step] == tile[step:])) if step < len(tile) else np.empty(0, np.int64)
        if not len(a):
            break
        a = a[np.bitwise_count(fp[a] ^ fp[a + step]) <= bits]
        _hook(root, a, a + step)
    for s, n in zip(starts[length > FAN].tolist(), length[length > FAN].tolist(), strict=True):
        root[s : s + n] = s + link_block(fp[s : s + n], bits)
    linked = root != np.arange(len(root))
    return node[linked], node[root[linked]]


def deals(rows: int, bits: int = BITS, block_rows: int = BLOCK_ROWS) -> tuple[int, int]:
    """(bands, bands of a block): as few as leave blocks of a moderate size. Of so many bands, ``bits`` differing bits leave so many equal."""
    for k in (1, 2, 3):
        if rows <= block_rows << (k * (64 // (bits + k))) >> 4:
            break
    return bits + k, k


def masks(bands: int, chosen: int) -> list[int]:
    """For each choice of bands the bits of those bands."""
    edges = np.linspace(0, 64, bands + 1).astype(int).tolist()
    own = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(own, chosen)]


def links(distinct: DataFrame, bits: int = BITS, block_rows: int = BLOCK_ROWS, deal: tuple[int, int] | None = None) -> DataFrame:
    """Edges (u, v) between the nodes of ``distinct(fp, node)`` that connect all fingerprints within ``bits`` bits."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    chosen = masks(*(deal or deals(distinct.count(), bits, block_rows)))
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long"))) for i, m in enumerate(chosen)])
    dealt = distinct.select("fp", "node", F.explode(keys).alias("block"))
    large = dealt.groupBy("block").count().where(F.col("count") > block_rows).select("block", F.ceil(F.col("count") / block_rows).cast("int").alias("n"))
    if large.isEmpty():
        dealt = dealt.withColumn("part", F.lit(0).cast("long"))
    else:
        n = F.coalesce("n", F.lit(1))
        dealt = dealt.join(large, "block", "left").withColumns({"n": n, "mine": F.pmod(F.xxhash64("fp"), n).cast("int")})
        rest = F.array_except(F.sequence(F.lit(0), F.col("n") - 1), F.array("mine"))
        dealt = dealt.withColumn("other", F.explode(F.when(F.col("n") == 1, F.array(F.lit(0))).otherwise(rest)))
        dealt = dealt.withColumn("part", F.least("mine", "other").cast("long") * (1 << 31) + F.greatest("mine", "other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> pa.RecordBatch:
            block, part = rows.column("block").to_numpy(), rows.column("part").to_numpy().astype(np.int64)
            _, inverse = np.unique(part, return_inverse=True)
            out = [[], []]
            for p in range(inverse.max() + 1 if len(inverse) else 0):
                own = inverse == p
                u, v = _link_run(block[own], rows.column("fp").to_numpy()[own].view(np.uint64), rows.column("node").to_numpy()[own], bits)
                out[0].append(u)
                out[1].append(v)
            u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in out)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 4 * block_rows:
                continue
            table = pa.Table.from_batches(held)
            block, part = table.column("block").to_numpy(), table.column("part").to_numpy()
            last = int(np.flatnonzero((block != block[-1]) | (part != part[-1]))[-1]) + 1 if ((block != block[-1]) | (part != part[-1])).any() else 0
            if last:
                yield flush(table.slice(0, last))
                held = table.slice(last).to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    sorted_ = dealt.repartition("block", "part").sortWithinPartitions("block", "part")
    return sorted_.select("block", "part", "fp", "node").mapInArrow(run, "u long, v long")


def groups(docs: DataFrame, size: int = WORDS, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links) of every row."""
    prints, _ = written(fingerprints(docs, size), "prints")
    distinct, _ = written(prints.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null"), "distinct")
    rooted = components(links(distinct, bits))
    named, _ = written(distinct.join(rooted, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id")), "named")
    return prints.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
