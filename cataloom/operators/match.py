"""Approximate matching: sliding Hamming distance, vector neighbours with greedy assignment, text containment, path suffixes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cataloom.scratch import cut_lineage

#: Characters of the parts that one automaton holds; parts longer than ``LONG`` are tried on every text, ``TRIED`` of them in a pass.
AUTOMATON, LONG, TRIED = 500_000, 1_000, 1_000
#: Queries whose scores a task holds at once, targets that it has them for, and more than what rounding to nine digits moves a score by.
STRIP, SPAN, NEAR = 128, 4096, 2e-9


def sliding_hamming(a: str, b: str) -> int:
    """Least number of mismatches of the shorter string against any equally long part of the longer one, case aside."""
    a, b = sorted((a.lower(), b.lower()), key=len)
    if not a:
        return 0
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (a, b))
    return int((np.lib.stride_tricks.sliding_window_view(y, len(x)) != x).sum(1).min())


def _pieces(text: Column, size: Column, step: Column, last: Column) -> Column:
    """Parts of ``size`` characters at every ``step``-th place up to ``last``, with their size."""
    return F.transform(F.sequence(F.lit(1), last, step), lambda i: F.concat_ws(":", size.cast("string"), F.substr(text, i, size)))


def _sharing(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """Pairs (name, candidate) of strings longer than ``most``, of which the shorter has one of its ``most`` + 1 equal blocks somewhere in the longer.

    Of any two within ``most`` mismatches this holds, as each mismatch spoils one block.
    """
    size = lambda c: F.floor(F.length(c) / (most + 1)).cast("int")
    sizes = left.select(size("low").alias("g")).union(right.select(size("low"))).distinct()
    every = sizes.groupBy().agg(F.array_sort(F.collect_set("g")).alias("gs"))  # as many as there are lengths of names

    def blocks(df: DataFrame) -> DataFrame:
        g = size("low")
        return df.withColumn("key", F.explode(F.array_distinct(_pieces(F.col("low"), g, g, g * most + 1))))

    def parts(df: DataFrame) -> DataFrame:
        sized = df.join(F.broadcast(every)).withColumn("g", F.explode("gs")).where(F.col("g") <= size("low"))
        return sized.withColumn("key", F.explode(F.array_distinct(_pieces(F.col("low"), F.col("g"), F.lit(1), F.length("low") - F.col("g") + 1)))).drop("g", "gs")

    pairs = lambda a, b, longer: a.join(b.withColumnsRenamed({"low": "other"}), "key").where(longer).select("name", "candidate")
    return pairs(blocks(left), parts(right), F.length("low") <= F.length("other")).union(pairs(parts(left), blocks(right), F.length("low") > F.length("other"))).distinct()


def _pattern_keys(low: Column, most: int, whole: bool) -> Column:
    """Keys of what stands at some places of a string of up to ``most`` characters (``whole``), or of any part as long of a longer one.

    A key is a length, places and their characters; with it goes the number of places left open. Two strings share a key with ``d`` open places if, and only if,
    the shorter one lies somewhere in the longer with ``d`` mismatches or fewer.
    """
    def keys(k: int, places: tuple[int, ...]) -> Column:
        head = F.lit(f"{k}:{','.join(map(str, places))}:")
        spots = F.array(F.lit(1)) if whole else F.sequence(F.lit(1), F.length(low) - k + 1)
        said = F.transform(spots, lambda i: F.concat(head, *[F.substr(low, i + p, F.lit(1)) for p in places])) if places else F.array(head)
        open_ = F.lit(k - len(places)).alias("distance")
        fits = F.length(low) == k if whole else F.length(low) >= k
        return F.when(fits, F.transform(said, lambda x: F.struct(x.alias("key"), open_))).otherwise(F.array().cast("array<struct<key:string,distance:int>>"))

    found = [keys(k, places) for k in range(1, most + 1) for m in range(k + 1) for places in combinations(range(k), m)]
    return F.array_distinct(F.flatten(F.array(*found)))


def _nearest_short(names: DataFrame, candidates: DataFrame, most: int) -> DataFrame:
    """(name, distance, candidate) where the shorter string has ``most`` characters or fewer: each name's least candidate by keys.

    Of each key only the least candidate is kept before names look it up, so strings that everything is near to make no pairs.
    """

    def looked_up(asking: DataFrame, known: DataFrame, short_name: bool) -> DataFrame:
        best = known.select("candidate", F.explode(_pattern_keys(F.col("low"), most, not short_name)).alias("k")).groupBy("k.key").agg(F.min("candidate").alias("candidate"))
        return asking.select("name", F.explode(_pattern_keys(F.col("low"), most, short_name)).alias("k")).select("name", "k.key", "k.distance").join(best, "key").select("name", "distance", "candidate")

    short = F.length("low") <= most
    return looked_up(names.where(short), candidates, True).union(looked_up(names, candidates.where(short), False))


def nearest_names(names: DataFrame, name: str, candidates: DataFrame, candidate: str, most: int = 3) -> DataFrame:
    """(name, candidate, distance): for each distinct name its nearest candidate of at most ``most`` mismatches; ties go to the lesser one.

    Strings meet in an equi-join over shared blocks, and only those pairs are measured. Strings of ``most`` characters or fewer, which are
    near to everything, are found by the characters at their places. Blank strings are near to nothing.
    """
    own = lambda df, c, to: df.select(F.col(c).alias(to), F.lower(c).alias("low")).where(F.trim(to) != "").distinct()
    left, right = own(names, name, "name"), own(candidates, candidate, "candidate")
    long = F.length("low") > most
    pairs = _sharing(left.where(long), right.where(long), most)
    distance = F.pandas_udf(lambda a, b: pd.Series([sliding_hamming(x, y) for x, y in zip(a, b, strict=True)], dtype="int32"), "int")
    found = pairs.withColumn("distance", distance("name", "candidate")).select("name", "distance", "candidate")
    found = found.unionByName(_nearest_short(left, right, most)).where(F.col("distance") <= most)
    return found.groupBy("name").agg(F.min(F.struct("distance", "candidate")).alias("b")).select("name", "b.candidate", "b.distance")


def best_vectors(queries: DataFrame, targets: DataFrame, id_: str, vector: str, least: float = 0.6, keep: int = 1, block: int = 65_536, held: DataFrame | None = None) -> DataFrame:
    """(query, target, score): each query's best ``keep`` targets by inner product, of at least ``least``; ties go to the lesser id.

    Targets are dealt to chunks by hash and queries to blocks, of ``block`` rows at most or as few as parallel tasks need; a task multiplies one block with one chunk,
    ``STRIP`` queries with ``SPAN`` targets at once. A target in ``held(target, holder)`` is out of reach of all queries from its holder on.
    """
    t = targets.select(F.col(id_).alias("id"), F.col(vector).alias("v"), F.lit(False).alias("asks"))
    q = queries.select(F.col(id_).alias("id"), F.col(vector).alias("v"), F.lit(True).alias("asks"), F.lit(None).cast("long").alias("holder"))
    t = t.join(held.select(F.col("target").alias("id"), F.col("holder").cast("long").alias("holder")), "id", "left") if held is not None else t.withColumn("holder", F.lit(None).cast("long"))
    chunks, blocks = _grid(t.count(), q.count(), block, 2 * targets.sparkSession.sparkContext.defaultParallelism)
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = t.withColumn("chunk", own(chunks)).withColumn("block", all_(blocks)).unionByName(q.withColumn("chunk", all_(chunks)).withColumn("block", own(blocks)))
    if chunks * blocks > 1:
        dealt = dealt.repartition(4 * chunks * blocks, "chunk", "block")  # so many that seldom two meet in one

    def multiply(table: pa.Table) -> pa.Table:
        asks = np.array(table.column("asks").to_pylist(), bool)
        ids = np.array(table.column("id").to_pylist(), np.int64)
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if asks.any() and not asks.all():
            said = table.column("v").combine_chunks()
            if said.null_count or len(np.unique(said.value_lengths().to_numpy())) > 1:
                raise ValueError("vectors must be there and of one length")
            v = said.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            order = np.argsort(ids[~asks], kind="stable")
            names, mat = ids[~asks][order], v[~asks][order].astype(np.float64)
            free_until = table.column("holder").fill_null(np.iinfo(np.int64).max).to_numpy()[~asks][order]
            asking, vectors = ids[asks], v[asks].astype(np.float64)
            for start in range(0, len(asking), STRIP):
                some = slice(start, start + STRIP)
                out.append(_best_of(asking[some], vectors[some], names, mat, free_until, least, keep))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query", "target", "score"])

    found = dealt.groupBy("chunk", "block").applyInArrow(multiply, "query long, target long, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "target")
    return found.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= keep).drop("__n")


def _grid(targets: int, queries: int, block: int, tasks: int) -> tuple[int, int]:
    """Chunks of targets and blocks of queries: none of more rows than ``block``, enough for so many tasks of ``SPAN`` by ``SPAN`` rows at least, and the fewest copies that allows."""
    least = [max(1, -(-n // block)) for n in (targets, queries)]
    tasks = max(1, min(tasks, targets * queries // SPAN**2))
    ways = [(c, max(least[1], -(-tasks // c))) for c in range(least[0], least[0] + tasks)]
    return min(ways, key=lambda w: (w[0] * queries + w[1] * targets, w))


def _best_of(asking: np.ndarray, vectors: np.ndarray, names: np.ndarray, mat: np.ndarray, free_until: np.ndarray, least: float, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``keep`` of the targets ``names``, which ascend, for each of some queries; scores count to nine digits, so all within ``NEAR`` of the last one kept are rounded and compared."""
    row, target, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    bar = np.full(len(asking), least - NEAR)
    for lo in range(0, len(names), SPAN):
        here = names[lo:lo + SPAN]
        s = vectors @ mat[lo:lo + SPAN].T
        s[np.isnan(s)] = -np.inf
        for i, (a, b) in enumerate(zip(np.searchsorted(here, asking, "left"), np.searchsorted(here, asking, "right"), strict=True)):
            s[i, a:b] = -np.inf
        until = free_until[lo:lo + SPAN]
        if until.min() <= asking.max():
            s[until <= asking[:, None]] = -np.inf
        if keep <= len(here):
            bar = np.maximum(bar, (s.max(1) if keep == 1 else np.partition(s, -keep, 1)[:, -keep]) - NEAR)
        i, j = np.nonzero(s >= bar[:, None])
        row, target, score = np.concatenate([row, i]), np.concatenate([target, here[j]]), np.concatenate([score, np.round(s[i, j], 9)])
        order = np.lexsort((target, -score, row))
        row, target, score = row[order], target[order], score[order]
        fine = (np.arange(len(row)) - np.searchsorted(row, row) < keep) & (score >= least)
        row, target, score = row[fine], target[fine], score[fine]
    return asking[row], target, score


def _settle(queries: DataFrame, offers: Callable[[DataFrame, DataFrame | None], DataFrame], block: int) -> DataFrame:
    """Rounds of proposals from ``queries(query)``: ``offers(free, held)`` has the free queries' best targets that no earlier query holds.

    A task folds one block of queries: each takes its best target that is still unused there and goes without if its offers are used up. Of
    all holders a target keeps the earliest; the others ask again. A target's holder only ever becomes an earlier query, so no refusal has
    to be taken back, and the rounds end with what the queries' choosing one after the other gives.
    """
    queries = cut_lineage(queries.distinct())
    blocks = max(1, -(-queries.count() // block))
    held = None

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        used, rows = set(), []
        for q, own in frame.sort_values(["query", "score", "target"], ascending=[True, False, True]).groupby("query", sort=False):
            for t, s in zip(own["target"], own["score"], strict=True):
                if t not in used:
                    used.add(t)
                    rows.append((q, t, s))
                    break
        return pd.DataFrame(rows, columns=["query", "target", "score"])

    while True:
        free = queries if held is None else queries.join(held.select(F.col("holder").alias("query")), "query", "left_anti")
        own = offers(free, held).withColumn("__block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
        new = cut_lineage(own.groupBy("__block").applyInPandas(fold, "query long, target long, score double"))
        if new.isEmpty():
            break
        new = new.select("target", F.col("query").alias("holder"), "score")
        every = new if held is None else held.unionByName(new)
        held = cut_lineage(every.groupBy("target").agg(F.min(F.struct("holder", "score")).alias("b")).select("target", "b.holder", "b.score"))
    return new if held is None else held.select(F.col("holder").alias("query"), "target", "score")


def assign_greedily(pairs: DataFrame, query: str = "query", target: str = "target", score: str = "score", keep: int = 64, block: int = 4096) -> DataFrame:
    """One target for each query at most, and one query for each target: queries choose in their order, each the best that is left.

    ``keep`` is the number of offers that a query gets a round and ``block`` the queries of a task; neither changes the result.
    """
    all_ = cut_lineage(pairs.select(F.col(query).cast("long").alias("query"), F.col(target).cast("long").alias("target"), F.col(score).cast("double").alias("score")))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "target")

    def offers(free: DataFrame, held: DataFrame | None) -> DataFrame:
        open_ = all_.join(free, "query", "left_semi")
        if held is not None:
            open_ = open_.join(held.select("target", "holder"), "target", "left").where("holder is null or holder > query").drop("holder")
        return open_.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= keep).drop("__n")

    return _settle(all_.select("query"), offers, block)


def assign_vectors(queries: DataFrame, targets: DataFrame, id_: str, vector: str, least: float = 0.6, keep: int = 64, block: int = 4096) -> DataFrame:
    """``assign_greedily`` over all pairs of vectors with an inner product of at least ``least``, of which no table is made."""

    def offers(free: DataFrame, held: DataFrame | None) -> DataFrame:
        asking = queries.join(free.select(F.col("query").alias(id_)), id_, "left_semi")
        return best_vectors(asking, targets, id_, vector, least, keep, block, held)

    return _settle(queries.select(F.col(id_).cast("long").alias("query")), offers, block)


def with_unmatched(queries: DataFrame, id_: str, found: DataFrame) -> DataFrame:
    """(query, target, score) of all queries: those without a target have a score of zero."""
    every = queries.select(F.col(id_).cast("long").alias("query")).distinct().join(found, "query", "left")
    return every.withColumn("score", F.coalesce("score", F.lit(0.0)))


def containing(texts: DataFrame, text_id: str, text: str, parts: DataFrame, part_id: str, part: str, anchor_words: int = 6) -> DataFrame:
    """(text_id, part_id) where a text contains a part.

    An automaton reads every text once and finds the parts without inner words (one or two words), with all others that it has room for, those of
    the fewest inner words first. The rest may be any number: their inner words stand between blanks in any text that contains them. Such parts and texts meet
    in an equi-join over the hash of a run of inner words, ``anchor_words`` of them or as many as a shorter part has; only ids and hashes take part
    in it, but each number of words takes all runs of all texts. The texts and parts that met are then compared as a whole.
    """
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    body = texts.select(F.col(text_id).alias("doc"), F.col(text).alias("body"))
    own = parts.select(F.col(part_id).alias("part"), F.col(part).alias("said")).where("said is not null and said <> ''")
    inner = F.slice(words(F.col("said")), 2, F.greatest(F.size(words(F.col("said"))) - 2, F.lit(0)))
    sized = own.withColumn("inner", inner).withColumn("n", F.least(F.size("inner"), F.lit(anchor_words)))
    sizes = dict(map(tuple, sized.groupBy("n").agg(F.sum(F.length("said"))).collect()))  # at most anchor_words + 1 rows
    room = [n for n in sorted(sizes) if n and sum(c for k, c in sizes.items() if k <= n) <= AUTOMATON]
    split = body.select("doc", words(F.col("body")).alias("words"))
    hits, met = [], []
    if room or 0 in sizes:
        hits.append(_scanned(body, sized.where(F.col("n").isin(room) | (F.col("n") == 0) & (F.length("said") <= LONG)).select("part", "said")))
    for n in sorted(sizes.keys() - room):
        some = sized.where(F.col("n") == n)
        if n:
            keyed = some.select("part", F.xxhash64(F.concat_ws(" ", F.slice("inner", 1, n))).alias("key"))
            runs = split.where(F.size("words") >= n).select("doc", F.explode(F.array_distinct(_runs(F.col("words"), n))).alias("key"))
            met.append(runs.join(keyed, "key").select("doc", "part"))
            continue
        some = some.where(F.length("said") > LONG)
        passes = -(-some.count() // TRIED)
        for k in range(passes):
            tried = some.where(F.pmod(F.xxhash64("part"), F.lit(passes)) == k).select("part", "said")
            hits.append(body.join(F.broadcast(tried), F.col("body").contains(F.col("said"))).select("doc", "part"))
    if met:
        pairs = reduce(DataFrame.unionByName, met).distinct()
        hits.append(pairs.join(body, "doc").join(own, "part").where(F.col("body").contains(F.col("said"))).select("doc", "part"))
    if not hits:
        return texts.select(text_id, F.lit(None).cast(parts.schema[part_id].dataType).alias(part_id)).limit(0)
    return reduce(DataFrame.unionByName, hits).distinct().select(F.col("doc").alias(text_id), F.col("part").alias(part_id))


def _scanned(body: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc, part) of ``body(doc, body)`` and few or short ``parts(part, said)``: an Aho-Corasick automaton of the distinct parts reads each text.

    Parts are dealt by hash to automata of about ``AUTOMATON`` characters, which bounds what is broadcast; every one of them is a pass over the texts.
    """
    spark = body.sparkSession
    said = parts.select("said").distinct()
    passes = -(-(said.agg(F.sum(F.length("said"))).first()[0] or 0) // AUTOMATON)
    found = body.select("doc", F.lit("").alias("said")).limit(0)
    for k in range(passes):
        block = [r.said for r in said.where(F.pmod(F.xxhash64("said"), F.lit(passes)) == k).toLocalIterator()]
        if not block:
            continue
        found = found.unionByName(body.where("body is not null").mapInArrow(_scanner(spark.sparkContext.broadcast(block)), found.schema))
    return found.join(parts, "said").select("doc", "part")


def _scanner(block) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for part in block.value:
            automaton.add_word(part, part)
        automaton.make_automaton()
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column(batch.schema.get_field_index("body")).to_pylist()):
                own = {part for _, part in automaton.iter(text)}
                rows += [i] * len(own)
                out += own
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc")).take(pa.array(rows, pa.int64())), pa.array(out, pa.string())], names=["doc", "said"])

    return run


def _runs(words, n: int):
    return F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(F.concat_ws(" ", F.slice(words, i, F.lit(n)))))


def best_suffix(paths: DataFrame, path: str, candidates: DataFrame, candidate: str) -> DataFrame:
    """(path, match, common): for each distinct path the candidate that it stands for.

    A candidate with the same last component, case aside, comes first: the one with the fewest components (``common`` is 0). Without one
    it is the candidate that shares the longest run of last components (``common`` of them), of these the one with the fewest. Ties go to the lesser one. For
    runs, bundle folders go by their plain name, and a file named after the bundle that it stands in may stand for it.

    Candidates are reduced to the best of each last component and of each run before anything is joined, so common names make no pairs.
    """
    parts = lambda c: F.filter(F.split(c, "/"), lambda x: x != "")
    asked = paths.select(F.col(path).alias("path")).distinct().withColumn("parts", parts(F.col("path"))).where(F.size("parts") > 0)
    known = candidates.select(F.col(candidate).alias("match")).distinct().withColumn("parts", parts(F.col("match"))).where(F.size("parts") > 0)
    last = lambda c: F.element_at(c, -1)
    best = F.min(F.struct(F.size("parts").alias("n"), "match")).alias("best")
    named = asked.join(known.groupBy(F.lower(last("parts")).alias("name")).agg(best), F.lower(last("parts")) == F.col("name"), "left")
    direct = named.where("best is not null").select("path", "best.match", F.lit(0).alias("common"))
    ends = lambda c: F.transform(F.sequence(F.lit(1), F.size(c)), lambda k: F.array_join(F.slice(c, -k, k), "/"))
    runs = known.withColumn("parts", _plain(F.col("parts"))).withColumn("end", F.explode(ends(F.col("parts")))).groupBy("end").agg(best)
    p = F.col("parts")
    folder = F.when(F.size(p) > 1, F.element_at(p, -2))
    base = F.regexp_extract(folder, BUNDLE, 1)
    bundled = (base != "") & F.startswith(F.lower(last(p)), F.concat(F.lower(base), F.lit(".")))
    ways = F.array_compact(F.array(_plain(p), F.when(bundled, _plain(F.slice(p, 1, F.size(p) - 1)))))
    way = named.where("best is null").select("path", F.explode(ways).alias("way")).select("path", F.posexplode(ends(F.col("way"))).alias("k", "end"))
    found = way.join(runs, "end").groupBy("path").agg(F.min(F.struct((-F.col("k") - 1).alias("k"), "best")).alias("b"))
    return direct.union(found.select("path", "b.best.match", -F.col("b.k")))


# A bundle's folder and the other name of bundles.
BUNDLE, BUNDLES = r"^(.+)\.(?i:lwc)$", ("lwc_bundle", "lwc")


def _plain(parts: Column) -> Column:
    bare = lambda x: F.regexp_replace(x, r"\.lwc$", "")
    return F.transform(parts, lambda x: F.when(bare(x) == BUNDLES[0], BUNDLES[1]).otherwise(bare(x)))
