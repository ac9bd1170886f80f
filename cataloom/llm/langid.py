"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) its letters' vectors, each permuted by its
place; a text's vector bundles (adds) those of all its trigrams; a language's prototype bundles its training texts. A text gets
the language whose prototype has the largest cosine.

Prototypes are fitted on about ``PER_LANGUAGE`` labelled documents of each language, drawn by the hash of doc_id and text (all,
where there are fewer). What reaches the driver and is broadcast has a row for each language, 4 kB of it. Prediction is one map over whole texts, without a
shuffle; vectors are built for a bounded number of trigrams at once, whatever letters a text mixes. Letters beyond a-z share 37 vectors by
their code, so scripts are told apart by their letters' mix, not by name.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if nothing could be learned. Rows with a
null doc_id are never trained on and count as not held out. Repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.llm.scratch import tidy

#: Symbols (0 is the boundary), dimensions of the vectors, labelled documents of a language that are learned from.
SYMBOLS, DIMENSIONS, PER_LANGUAGE = 64, 1024, 1500
#: Documents and characters that are scored together; distinct trigrams whose vectors are held at once.
BATCH, CHARS, VECTORS = 128, 1 << 20, 8192
SEED = 20_250_101
UNKNOWN = "und"


@cache
def _symbols() -> np.ndarray:
    """Symbol by code point: a-z have their own, other letters share the rest by their code, all else is the boundary."""
    table = np.zeros(0x110000, np.uint8)
    for code in range(128, 0x110000):
        if chr(code).isalpha():
            table[code] = 27 + code % (SYMBOLS - 27)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return table


@cache
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters' vectors as first, second and third of a trigram."""
    one = np.random.default_rng(SEED).integers(0, 2, (SYMBOLS, DIMENSIONS)).astype(np.float32) * 2 - 1
    return np.roll(one, 2, axis=1), np.roll(one, 1, axis=1), one


def trigram_vectors(trigrams: np.ndarray) -> np.ndarray:
    first, second, third = _letters()
    return first[trigrams // SYMBOLS**2] * second[trigrams // SYMBOLS % SYMBOLS] * third[trigrams % SYMBOLS]


def trigrams(text: str | None) -> np.ndarray:
    """Numbers of all trigrams of letters and word boundaries; empty without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.concatenate([[0], _symbols()[codes], [0]]).astype(np.int64)
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
    if len(s) < 3:
        return np.empty(0, np.int64)
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


def bundles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' vectors, and which of them have a letter."""
    parts = [trigrams(t) for t in texts]
    length = np.array([len(p) for p in parts])
    every = np.concatenate(parts) if parts else np.empty(0, np.int64)
    seen = np.zeros(SYMBOLS**3, bool)
    seen[every] = True
    distinct = np.flatnonzero(seen)
    place = np.zeros(SYMBOLS**3, np.int64)
    place[distinct] = np.arange(len(distinct))
    text = np.repeat(np.arange(len(parts)), length)
    column = place[every]
    out = np.zeros((len(parts), DIMENSIONS), np.float32)
    for lo in range(0, len(distinct), VECTORS):
        some = distinct[lo : lo + VECTORS]
        own = (column >= lo) & (column < lo + len(some)) if len(distinct) > VECTORS else slice(None)
        counts = np.bincount(text[own] * len(some) + column[own] - lo, minlength=len(parts) * len(some))
        out += counts.reshape(len(parts), len(some)).astype(np.float32) @ trigram_vectors(some)
    return out, length > 0


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes (unit length), from labelled documents outside the held-out third."""
    allowed = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    sizes = allowed.groupBy("lang").agg(F.least(F.lit(1.0), per_language / F.count("*")).alias("share"))
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000_000)) < F.col("share") * 1_000_000_000
    sample = allowed.join(F.broadcast(sizes), "lang").where(drawn).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                parts = [trigrams(t) for t in batch.column("text").filter(pa.array(langs == lang)).to_pylist()]
                which, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(which), pa.string()), pa.array(which, pa.int64()), pa.array(n, pa.int64())], names=["lang", "trigram", "n"])

    def prototype(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("trigram").to_numpy())
        which, n = (table.column(c).to_numpy()[order] for c in ("trigram", "n"))
        v = np.zeros(DIMENSIONS)
        for lo in range(0, len(which), VECTORS):
            v += (n[lo : lo + VECTORS] / n.sum()) @ trigram_vectors(which[lo : lo + VECTORS])
        v /= max(np.linalg.norm(v), 1e-12)
        return pa.table({"lang": table.column("lang").slice(0, 1), "v": pa.array([v.tolist()], pa.list_(pa.float64()))})

    counts = sample.mapInArrow(tidy(count), "lang string, trigram long, n long").groupBy("lang", "trigram").agg(F.sum("n").alias("n"))
    rows = sorted(map(tuple, counts.groupBy("lang").applyInArrow(prototype, "lang string, v array<double>").collect()))  # 4 kB a language
    return [r[0] for r in rows], np.array([r[1] for r in rows], np.float32).reshape(len(rows), DIMENSIONS)


def _predict(texts: list[str | None], langs: list[str], prototypes: np.ndarray) -> tuple[list[str], np.ndarray]:
    names, scores = [], []
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and stop - at < BATCH and (size < CHARS or stop == at):
            size += len(texts[stop] or "")
            stop += 1
        vectors, lettered = bundles(texts[at:stop])
        cosine = vectors @ prototypes.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        known = lettered & bool(langs)
        best = cosine.argmax(1) if langs else np.zeros(len(lettered), int)
        names += [langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        scores.append(np.where(known, np.clip(cosine.max(1, initial=0), 0, 1), 0.0))
        at = stop
    return names, np.concatenate(scores) if scores else np.empty(0)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the cosine, 0 to 1) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prototypes = shared.value
        for batch in batches:
            names, scores = _predict(batch.column("text").to_pylist(), langs, prototypes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held = is_held_out(F.col("doc_id")).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, "text").mapInArrow(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.0, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """The documents in a learned language with a score of ``least`` or more, all columns as they came."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prototypes = shared.value
        for batch in batches:
            names, scores = _predict(batch.column("text").to_pylist(), langs, prototypes)
            yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
