"""Repeated passages by sparse suffix arrays.

A window of ``LENGTH`` words is repeated if it stands at two places at least, of one document or of several. Suffixes are kept only at
minimiser positions, which the text itself selects, so equal windows keep the same suffix at the same offset; the suffix owns them.

1. Every text gives its retained suffixes: a hash of the first words, the position, the windows owned. A suffix whose hash comes
   once can't match. The hash only discards: nothing is taken for equal by it.
2. Equal texts stand together as one from here on: the document with the smallest doc_id fetches the words to the right of its
   remaining suffixes, by which they are sorted, and those to the left.
3. The suffixes are range-partitioned and sorted by their words. In the sorted order neighbours are compared word by word: the lengths of
   their common prefixes cut the order into classes at every depth. Every class is then extended to the left, word by word. A window is
   repeated where a suffix shares enough words to the right and to the left with another.
4. Suffixes with the same first words are sorted in one task, up to ``RUN_ROWS``. A run of more is spread over tasks, and its windows
   meet by a 128-bit digest of their words, combined before the shuffle; so a line that a third of all texts hold costs no task more.

A text's rows are gathered for merging: about one for each eighteen of its words, never a passage's documents.

Words are those between blanks (space, 09-0D), A-Z lower-cased. Edge cases: texts of fewer than ``LENGTH`` words, null ones among them,
have no passages. Rows that share doc_id and text are repeats of each other and give one set of passages; rows that share a doc_id
alone give one each. A row with a null doc_id takes no part and has none. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.scratch import drop, written

#: Words of a window; candidates for its minimiser; words that a candidate is ranked by; words that every match has right of its suffix.
LENGTH, CHOICE, GRAM = 50, 36, 5
LEAST = LENGTH - CHOICE + 1
#: Suffixes of a range, on average; suffixes compared at once; most suffixes of a run that one task compares.
RANGE_ROWS, CHUNK_ROWS, RUN_ROWS = 100_000, 16_384, 50_000
#: Words whose hashes a task remembers.
CACHE = 300_000

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h


class Hasher:
    """Hashes of all windows of a text's words."""

    def __init__(self) -> None:
        self.words = _Hashes()
        self.up = self.down = np.ones(1, np.uint64)

    def prefix(self, text: bytes | None) -> np.ndarray:
        """Sums of the words' hashes, each times a power of the base."""
        words = (text or b"").translate(_FOLD).split()
        if len(self.words) > CACHE:
            self.words.clear()
        if len(self.up) <= len(words):
            n = 2 * len(words) + 2
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)], dtype=np.uint64) for b in (_BASE, _INVERSE))
        own = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        return np.r_[np.uint64(0), np.cumsum(own * self.up[: len(own)], dtype=np.uint64)]

    def windows(self, prefix: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        x = (prefix[at + size] - prefix[at]) * self.down[at]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def minimisers(self, prefix: np.ndarray) -> np.ndarray:
        """For each window's start, the position of its minimiser."""
        starts = len(prefix) - LENGTH
        if starts < 1:
            return np.empty(0, np.int64)
        grams = self.windows(prefix, np.arange(starts + CHOICE - 1), GRAM)
        out = np.empty(starts, np.int64)
        for lo in range(0, starts, 1 << 15):
            part = np.lib.stride_tricks.sliding_window_view(grams[lo : lo + (1 << 15) + CHOICE - 1], CHOICE)[: starts - lo]
            out[lo : lo + len(part)] = np.arange(lo, lo + len(part)) + part.argmin(1)
        return out


_SUFFIXES = "key long, doc_id long, mark binary, pos int, first int, last int"


def _suffixes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """The retained suffixes of ``docs(doc_id, mark, text)``: ``bits`` of a hash of the first words, place, first and last start of the windows owned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = part.column("text").cast(pa.binary()).to_pylist()
                key, pos, first, last, size = [], [], [], [], []
                for text in texts:
                    prefix = hasher.prefix(text)
                    chosen = hasher.minimisers(prefix)  # never falls from a window to the next
                    begin = np.flatnonzero(np.diff(chosen, prepend=-1))
                    kept = chosen[begin]
                    size.append(len(kept))
                    key.append((hasher.windows(prefix, kept, LEAST) >> np.uint64(64 - bits)).view(np.int64))
                    pos.append(kept)
                    first.append(begin)
                    last.append(np.append(begin[1:], len(chosen))[: len(begin)] - 1)
                row = pa.array(np.repeat(np.arange(len(texts)), size))
                columns = [np.concatenate(key), *(np.concatenate(c).astype(np.int32) for c in (pos, first, last))]
                key, pos, first, last = map(pa.array, columns)
                yield pa.RecordBatch.from_arrays([key, part.column("doc_id").take(row), part.column("mark").take(row), pos, first, last], names=["key", "doc_id", "mark", "pos", "first", "last"])

    return docs.mapInArrow(run, _SUFFIXES)


_CONTEXTS = "doc_id long, mark binary, pos int, first int, last int, wide boolean, right binary, left binary"


def _contexts(docs: DataFrame) -> DataFrame:
    """The words of the windows that the suffixes of ``docs(doc_id, mark, text, at)`` own; each word right of a position ends with a blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1)
                words = part.column("text").cast(pa.binary())[0].as_py().translate(_FOLD).split()
                at = part.column("at").flatten()
                for lo in range(0, len(at), 8192):
                    pos, first, last, wide = (at.field(k).slice(lo, 8192) for k in range(4))
                    places = list(zip(pos.to_pylist(), first.to_pylist(), last.to_pylist(), strict=True))
                    right = [b" ".join(words[p : z + LENGTH]) + b" " for p, _, z in places]
                    left = [b" ".join(words[a:p]) for p, a, _ in places]
                    same = pa.array(np.zeros(len(places), np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(same), part.column("mark").take(same), pos, first, last, wide, pa.array(right, pa.binary()), pa.array(left, pa.binary())],
                        names=["doc_id", "mark", "pos", "first", "last", "wide", "right", "left"],
                    )

    return docs.mapInArrow(run, _CONTEXTS)


def _matrix(words: pa.Array, width: int, backwards: bool = False) -> np.ndarray:
    """Numbers of the words of each row, from the first (or the last) on; -1 where a row has no more."""
    lists = pc.split_pattern(words, " ")
    flat = pc.dictionary_encode(lists.flatten()).indices.to_numpy()
    stops = lists.offsets.to_numpy()
    stops, starts = stops[1:] - (not backwards), stops[:-1]  # a right side ends with a blank
    steps = np.arange(width)
    at = stops[:, None] - 1 - steps if backwards else starts[:, None] + steps
    inside = at >= starts[:, None] if backwards else at < stops[:, None]
    return np.where(inside, flat[np.clip(at, 0, max(0, len(flat) - 1))], np.int32(-1)) if len(flat) else np.full(at.shape, -1, np.int32)


def _common(right: np.ndarray) -> np.ndarray:
    """Words that each row shares with the row before it; 0 for the first."""
    same = right[1:] == right[:-1]
    return np.append(0, np.where(same.all(1), right.shape[1], same.argmin(1)))


def _repeats(rows: pa.Table, right: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset, row of the first place) of every owned window that another of these suffixes shares."""
    n = len(common)
    left = _matrix(rows.column("left").combine_chunks(), CHOICE - 1, backwards=True)
    pos, first, last, doc = (rows.column(c).to_numpy().astype(np.int64) for c in ("pos", "first", "last", "doc_id"))
    place = np.empty(n, np.int64)
    place[np.lexsort((pos, doc))] = np.arange(n)
    extended = np.zeros(n, np.int64)  # class of the words to the left, so far
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for offset in range(CHOICE):
        if offset:
            words = left[:, offset - 1].astype(np.int64) + 1
            _, extended = np.unique(extended * (int(words.max()) + 1) + words, return_inverse=True)
        agreed = np.cumsum(common < LENGTH - offset)
        own = np.flatnonzero((pos - last <= offset) & (offset <= pos - first))
        window = extended[own] * (n + 1) + agreed[own]
        order = np.lexsort((place[own], window))
        own, window = own[order], window[order]
        fresh = np.append(True, window[1:] != window[:-1])[: len(own)]
        head = np.flatnonzero(fresh)
        size = np.diff(np.append(head, len(own)))
        many = np.repeat(size > 1, size)
        out.append((own[many], np.full(int(many.sum()), offset), own[np.repeat(head, size)][many]))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


_FOUND = "mark binary, start int, stop int, first_doc_id long, first_start int, doc_id long, digest binary"


def _rows(rows: pa.Table, at: np.ndarray, start: np.ndarray, stop: np.ndarray, first_doc=None, first_start=None, digest=None) -> pa.RecordBatch:
    at = pa.array(at)
    n = len(at)
    source = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())] if first_doc is None else [pa.array(first_doc, pa.int64()), pa.array(first_start.astype(np.int32))]
    columns = [rows.column("mark").combine_chunks().take(at), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), *source]
    columns += [rows.column("doc_id").combine_chunks().take(at), pa.array(digest, pa.binary()) if digest else pa.nulls(n, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["mark", "start", "stop", "first_doc_id", "first_start", "doc_id", "digest"])


def _matched(rows: pa.Table, right: np.ndarray, common: np.ndarray) -> pa.RecordBatch:
    """Repeated windows of these suffixes, neighbours with the same source as one row: starts from ``start`` to before ``stop``."""
    row, offset, head = _repeats(rows, right, common)
    doc, pos = (rows.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "pos"))
    start = pos[row] - offset
    order = np.lexsort((start, row))
    row, start, head, offset = row[order], start[order], head[order], offset[order]
    cut = np.append(True, (np.diff(row) != 0) | (np.diff(start) != 1) | (np.diff(head) != 0))[: len(row)]
    at = np.flatnonzero(cut)
    end = np.append(at[1:], len(row))[: len(at)] - 1
    return _rows(rows, row[at], start[at], start[end] + 1, doc[head[at]], pos[head[at]] - offset[at])


def _windows(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """A row with a digest for every window that these suffixes own."""
    for lo in range(0, rows.num_rows, 2048):
        part = rows.slice(lo, 2048)
        at, start, digest = [], [], []
        for row, (first, last, right, left) in enumerate(zip(*(part.column(c).to_pylist() for c in ("first", "last", "right", "left")), strict=True)):
            words = [*(left.split(b" ") if left else ()), *right.split(b" ")]
            for k in range(last - first + 1):
                at.append(row)
                start.append(first + k)
                digest.append(xxhash.xxh3_128_digest(b" ".join(words[k : k + LENGTH])))
        start = np.array(start)
        yield _rows(part, np.array(at), start, start + 1, digest=digest)


def _compared(suffixes: DataFrame, ranges: int, chunk_rows: int) -> DataFrame:
    """Repeated windows of the sorted suffixes; of those in wide runs all windows, with a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(end: bool) -> Iterator[pa.RecordBatch]:
            """All runs but the last, which may go on."""
            nonlocal held
            rows = pa.Table.from_batches(held)
            wide = rows.column("wide").to_numpy(zero_copy_only=False)
            if wide.any():
                yield from _windows(rows.filter(pa.array(wide)))
                rows = rows.filter(pa.array(~wide)).combine_chunks()
            held = []
            if not rows.num_rows:
                return
            right = _matrix(rows.column("right").combine_chunks(), LENGTH)
            common = _common(right)
            stop = rows.num_rows if end else int(np.flatnonzero(common < LEAST)[-1])
            if stop:
                yield _matched(rows.slice(0, stop), right[:stop], common[:stop])
            held = rows.slice(stop).to_batches()

        limit = chunk_rows
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= limit:
                    yield from flush(False)
                    limit = chunk_rows + sum(b.num_rows for b in held)
        if held:
            yield from flush(True)

    # ranges of first words, so that a run is in one of them unless it is wide
    start = F.substring_index(F.col("right").cast("string"), " ", LEAST)
    spread = F.when(F.col("wide"), F.xxhash64("mark", "pos")).otherwise(0)
    return suffixes.repartitionByRange(ranges, start, spread).sortWithinPartitions("right", "doc_id", "mark", "pos").mapInArrow(run, _FOUND)


def _found(docs: DataFrame, range_rows: int = RANGE_ROWS, chunk_rows: int = CHUNK_ROWS, run_rows: int = RUN_ROWS, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(mark, own, windows, w) of the texts with repeats, and (doc_id, mark) of all.

    ``w`` has the repeated windows with the first place of each. Of a text that several documents have, ``own`` is the smallest of them and ``windows``
    the number of its windows: those that aren't in ``w`` first stand in ``own``.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    base = base.select("doc_id", F.unhex(F.md5("text")).alias("mark"), "text")
    kept, kept_path = written(_suffixes(base, bits), "suffixes")
    twice = kept.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", (F.col("n") > run_rows).alias("wide"))
    at = kept.join(twice, "key").groupBy("mark").agg(F.min("doc_id").alias("doc_id"), F.collect_set(F.struct("pos", "first", "last", "wide")).alias("at"))
    one = base.join(at, ["doc_id", "mark"]).groupBy("doc_id", "mark").agg(F.first("text").alias("text"), F.first("at").alias("at"))
    contexts, context_path = written(_contexts(one), "contexts")
    found, found_path = written(_compared(contexts, max(1, -(-contexts.count() // range_rows)), chunk_rows), "found")
    drop(spark, context_path)
    open_ = found.where("digest is not null").select("mark", "start", "stop", "doc_id", "digest")
    shared = open_.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start")).alias("f")).where("n > 1").select("digest", F.col("f.doc_id").alias("first_doc_id"), F.col("f.start").alias("first_start"))
    columns = ["mark", "start", "stop", "first_doc_id", "first_start"]
    every = found.where("digest is null").select(columns).unionByName(open_.join(shared, "digest").select(columns))
    every = every.groupBy("mark").agg(F.collect_list(F.struct("first_start", "first_doc_id", "start", "stop")).alias("w"))
    ids, _ = written(kept.groupBy("mark", "doc_id").agg(F.count_if(F.col("first") == 0).alias("n"), (F.max("last") + 1).alias("windows")), "ids")
    copied = ids.groupBy("mark").agg(F.sum("n").alias("n"), F.min("doc_id").alias("own"), F.max("windows").alias("windows")).where("n > 1").select("mark", "own", "windows")
    result, _ = written(copied.join(every, "mark", "full").select("mark", "own", "windows", "w"), "repeats")
    drop(spark, kept_path, found_path)
    return result, ids


_ROWS = "mark binary, start long, stop long, n_words long, first_doc_id long, first_start long"


def _merged(rows: pd.DataFrame, joined: bool) -> pd.DataFrame:
    """Passages of some texts. ``joined``: what touches or overlaps is one passage, else a row for each run with one source."""
    out = [pd.DataFrame(columns=["mark", "start", "stop", "n_words", "first_doc_id", "first_start"]).astype({c: "int64" for c in ("start", "stop", "n_words", "first_doc_id", "first_start")})]
    for mark, own, windows, w in rows.itertuples(index=False):
        found = [(r["start"], r["stop"], r["first_doc_id"], r["first_start"]) for r in w] if w is not None else []
        if windows == windows and windows is not None:  # copied: what is found nowhere else stands first in the text itself
            at = 0
            for a, b in [*sorted(f[:2] for f in found), (int(windows), int(windows))]:
                if a > at:
                    found.append((at, a, int(own), at))
                at = b
        start, stop, first, place = np.array(sorted(found), np.int64).T
        if joined:
            cut = np.append(True, start[1:] - (stop[:-1] - 1) > LENGTH)
        else:
            cut = np.append(True, (start[1:] != stop[:-1]) | (np.diff(first) != 0) | (np.diff(start - place) != 0))
        begin = np.flatnonzero(cut)
        end = stop[np.append(begin[1:], len(stop)) - 1] - 1 + LENGTH
        out.append(pd.DataFrame({"mark": [mark] * len(begin), "start": start[begin], "stop": end, "n_words": end - start[begin], "first_doc_id": np.minimum.reduceat(first, begin), "first_start": place[begin]}))
    return pd.concat(out)


def _of_documents(docs: DataFrame, joined: bool) -> DataFrame:
    texts, ids = _found(docs)
    return ids.select("doc_id", "mark").join(texts.mapInPandas(lambda frames: (_merged(f, joined) for f in frames), _ROWS), "mark")


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, start, stop (in words, stop exclusive), n_words, first_doc_id of every repeated passage.

    Repeated windows that touch or overlap are one passage. ``first_doc_id`` is the smallest doc_id that has a window of it: its own
    where no smaller document does. Documents without a repeated passage have no row.
    """
    return _of_documents(docs, True).select("doc_id", "start", "stop", "n_words", "first_doc_id")


def sources(docs: DataFrame) -> DataFrame:
    """The columns of ``passages`` and first_start, with a row for each run of neighbouring windows that have the same source.

    The run stands word for word in ``first_doc_id`` from ``first_start`` on: the first place, by doc_id and position, of each of its
    windows. A passage made of several documents' passages keeps a row, and a link, for each; a row whose source is its own place is
    the first of its kind.
    """
    return _of_documents(docs, False).select("doc_id", "start", "stop", "n_words", "first_doc_id", "first_start")
