"""Strong components and reachability of edge tables (src, dst), in few rounds however long the ways are.

Each round takes off nodes that no cycle can pass, merges what is led to both ways, and passes over nodes with one way in and one way out, whole
chains at once by doubling pointers. What was merged or passed is written down and told its component at the end, backwards. Only a core that
withstands all this is coloured: every node takes the greatest name that reaches it, names being drawn by hash, so heads are found all over the core and
each colour goes on by itself. Where names have far to go, edges are helped by shortcuts: one way out of every node, doubled again and again.

Each step is a table written to the folder of spark.checkpoint.dir, which executors share.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.scratch import forget, passing, tabled

#: Layers of dead ends that a round takes off; hops before shortcuts are made; share of edges that a round must take off to go without colours.
LAYERS, HOPS, ENOUGH = 3, 6, 0.05
#: Rows of pairs that a task of a closure has, about.
ROWS = 1_000_000


def _ends(edges: DataFrame, end: str, name: str) -> DataFrame:
    return edges.select(F.col(end).alias(name)).distinct()


def peeled(edges: DataFrame, layers: int = LAYERS) -> DataFrame:
    """Edges whose start has a way in and whose end has a way out, looked at ``layers`` times."""
    for _ in range(layers):
        edges = edges.join(_ends(edges, "dst", "src"), "src", "left_semi").join(_ends(edges, "src", "dst"), "dst", "left_semi").select("src", "dst")
    return edges


def followed(pointers: DataFrame) -> DataFrame:
    """(node, to, low, ring) of pointers (node, to), one a node: the last node that each leads to, or, on a ``ring``, where ``low`` is its least node.

    A round doubles the way, so there are as many as the longest way has binary digits. A way that isn't on a ring has a node that finds its end in every round,
    and the lows of a ring stay once they are its least node's: a round that changes nothing is the last one.
    """
    now = tabled(pointers.select("node", "to", F.col("node").alias("low"), F.lit(True).alias("ring"), F.lit(True).alias("new")))
    while not now.where("new").isEmpty():
        on = now.select(F.col("node").alias("to"), F.col("to").alias("__to"), F.col("low").alias("__low"), F.col("ring").alias("__ring"))
        step, was = now.where("ring").join(on, "to", "left"), now
        ends = ~F.coalesce("__ring", F.lit(False))
        step = step.select("node", F.coalesce("__to", "to").alias("to"), F.least("low", "__low").alias("low"), (~ends).alias("ring"), (ends | (F.col("__low") < F.col("low"))).alias("new"))
        now = tabled(step.unionByName(now.where("not ring").withColumn("new", F.lit(False))))
        forget(was)
    return now.drop("new")


def _renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges between other nodes: (child, parent) gives names; loops go."""
    for end in ("src", "dst"):
        edges = edges.join(names.select(F.col("child").alias(end), "parent"), end, "left").withColumn(end, F.coalesce("parent", end)).drop("parent")
    return edges.where("src <> dst").select("src", "dst").distinct()


def _without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("node").alias(end)), end, "left_anti")
    return edges.select("src", "dst")


class _Condensing:
    """The core that is left, and what has been found on the way to it."""

    def __init__(self, edges: DataFrame):
        edges = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
        self.edges = tabled(edges)
        #: steps in their order: ("merged", (child, parent)) or ("passed", (node, a, b))
        self.log: list[tuple[str, DataFrame]] = []
        self.cyclic = [self.edges.where("src = dst").select(F.col("src").alias("node"))]
        self.core = self.edges.where("src <> dst")
        self.rounds = self.colourings = 0

    def run(self) -> None:
        size = self.core.count()
        while size:
            self.rounds += 1
            self._merge_pairs()
            self.core = tabled(peeled(self.core))
            self._pass_chains()
            left = self.core.count()
            if left > (1 - ENOUGH) * size:
                self._colour()
                left = self.core.count()
            size = left

    def _merged(self, rows: DataFrame) -> None:
        """Notes (child, parent); parents lie on cycles from now on."""
        self.log.append(("merged", rows))
        self.cyclic.append(rows.select(F.col("parent").alias("node")).distinct())

    def _merge_pairs(self) -> None:
        pair = self.core.groupBy(F.least("src", "dst").alias("to"), F.greatest("src", "dst").alias("node")).agg(F.count("*").alias("ways")).where("ways = 2")
        pointers = tabled(pair.groupBy("node").agg(F.min("to").alias("to")))
        if not pointers.isEmpty():
            names = followed(pointers).select(F.col("node").alias("child"), F.col("to").alias("parent"))
            self._merged(names)
            self.core = _renamed(self.core, names)

    def _pass_chains(self) -> None:
        into = self.core.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("before")).where("n = 1").drop("n")
        out = self.core.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("after")).where("n = 1").drop("n")
        inner = tabled(into.join(out, "node"))
        if inner.isEmpty():
            return
        named = inner.select(F.col("node").alias("__inner"))
        pointers = inner.join(named, F.col("after") == F.col("__inner"), "left_semi").select("node", F.col("after").alias("to"))
        way = followed(pointers)
        ring = way.where("ring").select(F.col("node").alias("child"), F.col("low").alias("parent"))
        last = inner.join(way.select("node", "to", "ring"), "node", "left").where("not coalesce(ring, false)").withColumn("last", F.coalesce("to", "node"))
        starts = last.join(named, F.col("before") == F.col("__inner"), "left_anti").select("last", F.col("before").alias("a"))
        stops = last.where("last = node").select("last", F.col("after").alias("b"))
        chains = tabled(starts.join(stops, "last"))
        self.log.append(("passed", last.select("node", "last").join(chains, "last").select("node", "a", "b")))
        self.cyclic.append(chains.where("a = b").select(F.col("a").alias("node")).distinct())
        if not ring.isEmpty():
            self._merged(ring.where("child <> parent"))
        over = chains.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        self.core = tabled(_without(self.core, inner.select("node")).unionByName(over).distinct())

    def _colour(self) -> None:
        """Retires the component of every node that keeps its own name, and cuts between colours."""
        self.colourings += 1
        name = F.struct(F.xxhash64("node", F.lit(self.colourings)).alias("rank"), F.col("node").alias("head"))
        nodes = _ends(self.core, "src", "node").union(_ends(self.core, "dst", "node")).distinct()
        colours = spread(self.core, nodes.withColumn("name", name))
        colours = tabled(colours.select("node", F.col("name.head").alias("head")))
        start, end = (colours.select(F.col("node").alias(x), F.col("head").alias(f"__{x}")) for x in ("src", "dst"))
        same = tabled(self.core.join(start, "src").join(end, "dst").where("__src = __dst").select("src", "dst"))
        heads = colours.where("node = head").select("node", F.col("node").alias("name"))
        back = spread(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), heads)
        part = tabled(back.where("name is not null").select("node", F.col("name").alias("head")))
        self._merged(part.where("node <> head").select(F.col("node").alias("child"), F.col("head").alias("parent")))
        self.core = tabled(_without(same, part))

    def components(self) -> DataFrame:
        """(node, component) of the nodes that lie on a cycle."""
        cyclic = tabled(reduce(DataFrame.union, self.cyclic).distinct())
        moved = [rows.select(F.col("child" if kind == "merged" else "node").alias("node")) for kind, rows in self.log]
        own = cyclic.join(reduce(DataFrame.union, moved), "node", "left_anti") if moved else cyclic
        done = own.select("node", F.col("node").alias("component"))
        for kind, rows in reversed(self.log):
            if kind == "merged":
                more = rows.join(done.select(F.col("node").alias("parent"), "component"), "parent").select(F.col("child").alias("node"), "component")
            else:
                a, b = (done.select(F.col("node").alias(x), F.col("component").alias(f"__{x}")) for x in ("a", "b"))
                loops = cyclic.select("node", F.lit(True).alias("loop"))
                more = rows.join(a, "a", "left").join(b, "b", "left").join(loops, "node", "left")
                more = more.select("node", F.when(F.col("__a") == F.col("__b"), F.col("__a")).when(F.col("loop"), F.col("node")).alias("component")).where("component is not null")
            done = tabled(done.unionByName(more))
        return done


def spread(edges: DataFrame, names: DataFrame) -> DataFrame:
    """The greatest name that reaches each node, its own included, from ``names`` (node, and one or more columns of names, each for itself)."""
    columns = [c for c in names.columns if c != "node"]
    now = tabled(names.withColumn("new", F.lit(True)))
    ways, hops = edges.select("src", "dst"), 0
    while True:
        news = now.where("new").drop("new")
        come = ways.join(news.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(*[F.max(c).alias(f"__{c}") for c in columns])
        more = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"__{c}") > F.col(c), F.col(c).isNull() & F.col(f"__{c}").isNotNull()) for c in columns])
        step, was = now.drop("new").join(come, "node", "full_outer"), now
        now = tabled(step.select("node", *[F.greatest(c, f"__{c}").alias(c) for c in columns], more.alias("new")))
        forget(was)
        hops += 1
        if now.where("new").isEmpty():
            return now.drop("new")
        if hops == HOPS:
            ways, now = tabled(ways.unionByName(shortcuts(edges).drop("steps"))), now.withColumn("new", F.lit(True))


def shortcuts(edges: DataFrame) -> DataFrame:
    """(src, dst, steps): where one way out of each node leads after 2, 4, 8 ... steps. Every pair is one that edges reach; there are as many a step as nodes."""
    now = tabled(edges.groupBy("src").agg(F.max_by("dst", F.xxhash64("dst")).alias("dst")))
    none, found, steps = edges.select("src", "dst").limit(0), [], 1
    for _ in range(math.ceil(math.log2(now.count() + 1))):
        steps *= 2
        now = tabled(now.join(now.select(F.col("src").alias("dst"), F.col("dst").alias("__on")), "dst").select("src", F.col("__on").alias("dst")).where("src <> dst"))
        if now.isEmpty():
            break
        found.append(now.withColumn("steps", F.lit(steps).cast("long")))
    return reduce(DataFrame.union, found, none.withColumn("steps", F.lit(1).cast("long")))


def levels(edges: DataFrame, jumps: DataFrame) -> DataFrame:
    """(node, level) of a graph without cycles: the most edges that lead on from a node. ``jumps`` are its shortcuts, so a long way is not walked edge by edge."""
    ways = tabled(edges.select("src", "dst", F.lit(1).cast("long").alias("steps")).unionByName(jumps))
    now = tabled(edges.select(F.col("dst").alias("node")).union(edges.select("src")).distinct().select("node", F.lit(0).cast("long").alias("level"), F.lit(True).alias("new")))
    while not now.where("new").isEmpty():
        come = ways.join(now.where("new").select(F.col("node").alias("dst"), "level"), "dst").groupBy(F.col("src").alias("node")).agg(F.max(F.col("level") + F.col("steps")).alias("come"))
        step, was = now.join(come, "node", "left"), now
        now = tabled(step.select("node", F.greatest("level", "come").alias("level"), F.coalesce(F.col("come") > F.col("level"), F.lit(False)).alias("new")))
        forget(was)
    forget(ways)
    return now.drop("new")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes that lie on a cycle, loops included; a component goes by its greatest node. Edges without an end don't count."""
    with passing() as kept:
        steps = _Condensing(edges)
        steps.run()
        parts = steps.components()
        names = parts.groupBy("component").agg(F.max("node").alias("__greatest"))
        out = tabled(parts.join(names, "component").select("node", F.col("__greatest").alias("component")), "components")
        kept.append(out)
    return out


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """Edges (u, v) where v reaches u, which are those within a strong component."""
    parts = strong_components(edges)
    a, b = (parts.select(F.col("node").alias(end), F.col("component").alias(f"__{end}")) for end in ("src", "dst"))
    return edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("__src = __dst").select("src", "dst")


def condensed(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges between components (and nodes on no cycle), from strong components (node, component): they have no cycle."""
    return _renamed(edges, parts.select(F.col("node").alias("child"), F.col("component").alias("parent")))


def _dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Where ``rows`` are too many for the usual number of partitions, ``df`` in as many as leave ``ROWS`` to each: a task's memory doesn't grow with the table."""
    n = -(-rows // ROWS)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(src, dst, depth): all that each node reaches over one edge or more, with the least number of edges.

    A round doubles the depth: what is exactly as far as the last round reached is joined with all that is found, so a pair is proposed once for each node
    at that one distance on its ways. The pairs themselves are the size of the result; ``reaches`` answers for given pairs without them.
    """
    with passing() as kept:
        found = tabled(edges.select("src", "dst").where("src is not null and dst is not null").distinct().withColumn("depth", F.lit(1)))
        reach = 1
        while max_depth is None or reach < max_depth:
            far = found.where(F.col("depth") == reach).select("src", F.col("dst").alias("__via"))
            if far.isEmpty():
                break
            on = found.select(F.col("src").alias("__via"), "dst", (F.col("depth") + reach).alias("depth"))
            if max_depth is not None:
                on = on.where(F.col("depth") <= max_depth)
            size = 2 * found.count()  # what is there, and about as much again
            new = _dealt(far.join(on, "__via").select("src", "dst", "depth"), size, "src", "dst").groupBy("src", "dst").agg(F.min("depth").alias("depth"))
            new = new.join(_dealt(found.select("src", "dst"), size, "src", "dst"), ["src", "dst"], "left_anti")
            found, reach = tabled(found.unionByName(new)), 2 * reach
        kept.append(found)
    return found


def closure_from(edges: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """The closure of some nodes, ``sources(src)``: a hop a round from what the last one found, so nothing is kept that they don't reach."""
    edges = tabled(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    found = tabled(edges.join(sources.select("src").distinct(), "src", "left_semi").withColumn("depth", F.lit(1)))
    frontier, depth = found, 1
    while not frontier.isEmpty() and (max_depth is None or depth < max_depth):
        depth += 1
        step = frontier.select("src", F.col("dst").alias("__via")).join(edges.select(F.col("src").alias("__via"), "dst"), "__via")
        frontier = tabled(step.select("src", "dst").distinct().join(found.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)))
        found = tabled(found.unionByName(frontier)) if depth % 8 == 0 else found.unionByName(frontier)
    return found


def upstream(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """The closure against the edges."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return closure(back) if sources is None else closure_from(back, sources)


class ReachIndex:
    """Labels that tell which nodes can't reach which, over the condensed graph, and shortcuts that lead towards those that can.

    A node's label has its level, the most edges that lead on from it, and for each of ``n`` random ranks the least and the greatest of what it reaches, itself
    included. A node that reaches another is on a higher level and has the other's intervals within its own. So labels rule most pairs out,
    and guide the search for the rest: it goes by edges, and by the longest jump that stays above its goal. Size: a row a node for labels, a row a
    node and power of two for jumps.
    """

    def __init__(self, edges: DataFrame, n: int = 3):
        with passing() as kept:
            edges = tabled(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
            self.parts = strong_components(edges)
            self.edges = tabled(condensed(edges, self.parts))
            self.n = n
            own = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
            nodes = own.join(self.parts, "node", "left").select(F.coalesce("component", "node").alias("node")).distinct()
            back = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            # the greatest of the ranks and of their negatives
            names = [(F.shiftright(F.xxhash64("node", F.lit(k)), 1) * sign).alias(f"{side}{k}") for k in range(n) for side, sign in (("high", 1), ("low", -1))]
            self.jumps = tabled(shortcuts(self.edges))
            ranks = spread(back, nodes.select("node", *names))
            self.labels = tabled(ranks.join(levels(self.edges, self.jumps), "node", "left").fillna(0, ["level"]))
            kept += [self.parts, self.edges, self.jumps, self.labels]

    def _within(self, over: str, under: str) -> Column:
        """Whether the label ``over`` may reach the label ``under``."""
        wide = [F.col(f"{over}.{s}{k}") >= F.col(f"{under}.{s}{k}") for k in range(self.n) for s in ("high", "low")]
        return reduce(lambda a, b: a & b, wide, F.col(f"{over}.level") > F.col(f"{under}.level"))

    def reaches(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs (src, dst) with ``reached``: whether dst can be come to from src over one edge or more."""
        pairs = pairs.select("src", "dst").distinct()
        mark = F.struct("level", *[f"{s}{k}" for k in range(self.n) for s in ("high", "low")])
        labels = self.labels.select("node", mark.alias("label"))
        asked = pairs
        for end in ("src", "dst"):
            asked = asked.join(self.parts.select(F.col("node").alias(end), F.col("component").alias(f"__{end}")), end, "left")
        asked = asked.withColumn("same", F.coalesce(F.col("__src") == F.col("__dst"), F.lit(False)))
        asked = asked.select("src", "dst", "same", F.coalesce("__src", "src").alias("a"), F.coalesce("__dst", "dst").alias("b"))
        asked = tabled(asked)
        open_ = asked.where("not same and a <> b").select("a", "b").distinct()
        for end in ("a", "b"):
            open_ = open_.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"__{end}")), end)
        open_ = tabled(open_.where(self._within("__a", "__b")).select("a", "b", F.col("__b").alias("goal"), F.col("a").alias("at")))
        seen, yes = open_.select("a", "b", "at"), None
        while not open_.isEmpty():
            step = self.edges.withColumn("steps", F.lit(0).cast("long")).unionByName(self.jumps)
            step = open_.join(step.withColumnsRenamed({"src": "at", "dst": "to"}), "at").select("a", "b", "goal", "at", "to", "steps")
            met = tabled(step.join(labels.select(F.col("node").alias("to"), "label"), "to").where((F.col("to") == F.col("b")) | self._within("label", "goal")).drop("label"))
            leap = met.where("steps > 0").groupBy("a", "b", "goal", "at").agg(F.max_by("to", "steps").alias("to"))
            go = met.where("steps = 0").drop("steps").unionByName(leap).select("a", "b", "goal", F.col("to").alias("at")).distinct()
            go = tabled(go.join(seen, ["a", "b", "at"], "left_anti"))
            hit = go.where("at = b").select("a", "b").distinct()
            yes = hit if yes is None else tabled(yes.unionByName(hit))
            open_ = tabled(go.join(hit, ["a", "b"], "left_anti"))
            seen = tabled(seen.join(hit, ["a", "b"], "left_anti").unionByName(open_.select("a", "b", "at")))
        found = asked.withColumn("__met", F.lit(None).cast("boolean")) if yes is None else asked.join(yes.withColumn("__met", F.lit(True)), ["a", "b"], "left")
        return found.select("src", "dst", (F.col("same") | F.coalesce("__met", F.lit(False))).alias("reached"))
