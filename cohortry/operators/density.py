"""Density clusters of all rows: a hierarchy over mutual reachability, from which the most stable clusters are kept.

The graph has the neighbours of each row; an edge weighs the largest of its length and the core distances of its ends. In the tree that
single linkage would build, a group of fewer than ``least`` rows matters only for when its rows reach a group of that size. So small groups
are joined first, in rounds: each small group knows its lightest edge outward; two whose lightest edge is the same join, and one whose
lightest edge leads to a large group falls into it at that weight. Every row then has the level at which it belonged to a large
group, and which one. Large groups (rows / ``least`` at most) are joined by Boruvka rounds; only their tree, not the rows, is laid out
by the driver, which picks the clusters by excess of mass from stabilities that Spark has summed.

Rows whose neighbour lists never lead to each other join at an infinite distance. Rows that reach no large group, or lie below
no chosen cluster, are noise (-1).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortry.operators.neighbours import nearest_rows
from cohortry.staging import Staged, stage

SHORT = 1e-10


def reachability(df: DataFrame, cols: list[str], samples: int = 5, neighbours: int = 15, key: str = "row_id") -> DataFrame:
    """u < v and weight: the edges of the neighbour graph by mutual reachability. A core distance reaches to the ``samples``-th other row."""
    near = stage(nearest_rows(df, cols, max(neighbours, samples), key).select(F.col(key).alias("i"), "other", "distance"), "density-near")
    place = F.row_number().over(W.partitionBy("i").orderBy("distance", "other"))
    core = stage(near.withColumn("_k", place).filter(F.col("_k") <= samples).groupBy("i").agg(F.max("distance").alias("core")), "density-core")
    both = near.join(core, "i").join(core.select(F.col("i").alias("other"), F.col("core").alias("_core")), "other")
    weight = F.greatest("distance", "core", "_core", F.lit(SHORT))
    return stage(both.groupBy(F.least("i", "other").alias("u"), F.greatest("i", "other").alias("v")).agg(F.min(weight).alias("weight")), "density-edges")


def _lightest(edges: DataFrame) -> DataFrame:
    """a, and ``e``: the lightest edge (w, u, v, b) of each group to another."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w", "u", "v"))
    return both.groupBy("a").agg(F.min(F.struct("w", "u", "v", "b")).alias("e"))


def _renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges between groups after renaming (old, new); one lightest edge for each pair of groups, none within a group."""
    first, second = names.select(F.col("old").alias("a"), F.col("new").alias("_a")), names.select(F.col("old").alias("b"), F.col("new").alias("_b"))
    moved = edges.join(first, "a", "left").join(second, "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "w", "u", "v").filter("a != b")
    best = moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.struct("w", "u", "v")).alias("e"))
    return best.select("a", "b", "e.w", "e.u", "e.v")


def atoms(rows: DataFrame, edges: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Each row's large group and the edge by which it came to it (i, atom, at: w, u, v; null where it reaches none), and the lightest edges between large groups (a, b, w, u, v)."""
    large = F.col("size") >= least
    groups = Staged(rows.select(F.col("i").alias("g"), F.lit(1).cast("long").alias("size")), "density-groups")
    members = Staged(rows.select("i", F.col("i").alias("g"), F.lit(None).cast("long").alias("atom"), F.lit(None).cast("struct<w: double, u: long, v: long>").alias("at")), "density-members")
    left = Staged(edges.select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("weight").alias("w"), "u", "v"), "density-left")
    while True:
        small = groups.df.filter(~large).select(F.col("g").alias("a"))
        sized = groups.df.select(F.col("g").alias("_b"), F.col("size").alias("_size"))
        asks = stage(_lightest(left.df).join(small, "a", "left_semi").select("a", "e.b", "e.w", "e.u", "e.v").join(sized, F.col("b") == F.col("_b")).drop("_b"), "density-asks")
        other = asks.select(F.col("a").alias("_a"), F.col("b").alias("_back"))
        into = asks.filter(F.col("_size") >= least).select(F.col("a").alias("old"), F.col("b").alias("new"), F.struct("w", "u", "v").alias("by"), F.lit(True).alias("falls"))
        pairs = asks.filter(F.col("_size") < least).join(other, F.col("b") == F.col("_a")).filter("_back = a")
        joins = pairs.select(F.greatest("a", "b").alias("old"), F.least("a", "b").alias("new"), F.struct("w", "u", "v").alias("by"), F.lit(False).alias("falls")).distinct()
        moves = stage(into.unionByName(joins), "density-moves")
        if moves.isEmpty():
            break
        merged = groups.df.join(moves.select(F.col("old").alias("g"), "new"), "g", "left").groupBy(F.coalesce("new", "g").alias("g")).agg(F.sum("size").alias("size"))
        grown = Staged(merged, "density-groups")
        # rows of a joined pair that is large now have their level, as have those that fell into a large group
        born = moves.filter("not falls").join(grown.df.filter(large).select(F.col("g").alias("new")), "new", "left_semi").select(F.col("new").alias("g"), F.col("by").alias("_born"))
        named = members.df.join(moves.select(F.col("old").alias("g"), F.col("new").alias("_new"), F.col("by").alias("_fell"), "falls"), "g", "left")
        named = named.withColumn("g", F.coalesce("_new", "g")).join(born, "g", "left")
        open_ = F.col("atom").isNull()
        reached = F.when(F.col("falls"), F.col("_fell")).otherwise(F.col("_born"))
        done = named.select("i", "g", F.when(open_ & reached.isNotNull(), F.col("g")).otherwise(F.col("atom")).alias("atom"), F.when(open_, reached).otherwise(F.col("at")).alias("at"))
        later = Staged(done, "density-members"), Staged(_renamed(left.df, moves.select("old", "new")), "density-left")
        for gone in (groups, members, left):
            gone.drop()
        groups, (members, left) = grown, later
    kept = groups.df.filter(large).select("g")
    between = left.df.join(kept.withColumnRenamed("g", "a"), "a", "left_semi").join(kept.withColumnRenamed("g", "b"), "b", "left_semi")
    return members.df.select("i", "atom", "at"), between


def spanning_forest(edges: DataFrame) -> DataFrame:
    """u, v, w, a, b: the edges (between groups a and b, as they were) of a minimum spanning forest, by Boruvka rounds."""
    now, chosen = Staged(edges.select("a", "b", "w", "u", "v"), "forest-edges"), []
    ends = edges.select(F.col("u").alias("_u"), F.col("v").alias("_v"), F.col("a").alias("_a"), F.col("b").alias("_b"))
    while not now.df.isEmpty():
        picks = stage(_lightest(now.df).select("a", "e.b", "e.w", "e.u", "e.v"), "forest-picks")
        chosen.append(picks.select("u", "v", "w").distinct())
        back = picks.select(F.col("a").alias("_a"), F.col("b").alias("_back"))
        root = (F.col("_back") == F.col("a")) & (F.col("a") < F.col("b"))
        point = Staged(picks.join(back, F.col("b") == F.col("_a")).select(F.col("a").alias("old"), F.when(root, F.col("a")).otherwise(F.col("b")).alias("new")), "forest-pointers")
        while True:
            above = point.df.select(F.col("old").alias("_o"), F.col("new").alias("_n"))
            further = Staged(point.df.join(above, F.col("new") == F.col("_o")).select("old", F.col("_n").alias("new"), (F.col("_n") != F.col("new")).alias("moved")), "forest-pointers")
            point.drop()
            point = further
            if further.df.filter("moved").isEmpty():
                break
        before, now = now, Staged(_renamed(now.df, point.df.select("old", "new")), "forest-edges")
        before.drop()
    out = None
    for part in chosen:
        out = part if out is None else out.unionByName(part)
    if out is None:
        return edges.select("u", "v", "w", "a", "b").limit(0)
    return out.join(ends, (F.col("u") == F.col("_u")) & (F.col("v") == F.col("_v"))).select("u", "v", "w", F.col("_a").alias("a"), F.col("_b").alias("b"))


class Tree:
    """The hierarchy of large groups: node 0 is the root; a node has its lambda of birth, its parts and the lambda at which it splits."""

    def __init__(self, leaves: list[int], merges: list[tuple[tuple[float, int, int], int, int]]):
        parent, self.parts, self.split, self.birth = {}, {}, {}, {}
        self.made: dict[str, tuple[float, int, int]] = {}
        top = {a: f"atom {a}" for a in leaves}
        union = {a: a for a in leaves}

        def find(a: int) -> int:
            while union[a] != a:
                union[a] = union[union[a]]
                a = union[a]
            return a

        for n, (edge, a, b) in enumerate(merges):
            x, y = find(a), find(b)
            node = f"merge {n}"
            self.parts[node], self.split[node], self.made[node] = (top[x], top[y]), 1 / edge[0], edge
            union[y], top[x] = x, node
        roots = sorted({top[find(a)] for a in leaves})
        if len(roots) != 1:
            self.parts["root"], self.split["root"], self.made["root"] = tuple(roots), 0.0, (math.inf, 0, 0)
            roots = ["root"]
        self.root = roots[0] if roots else None
        order = [self.root] if roots else []
        for node in order:
            for part in self.parts.get(node, ()):
                parent[part], self.birth[part] = node, self.split[node]
                order.append(part)
        self.birth[self.root] = 0.0
        self.parent, self.order = parent, order

    def paths(self, leaves: list[int]) -> list[tuple[int, str, tuple, tuple]]:
        """atom, node, and the edges between which rows of the atom come to the node: after the one that made it, before the one that made its parent."""
        out = []
        for a in leaves:
            node = f"atom {a}"
            while node is not None:
                above = self.parent.get(node)
                out.append((a, node, self.made.get(node, (-1.0, 0, 0)), self.made[above] if above else (math.inf, 1, 1)))
                node = above
        return out

    def chosen(self, left: dict[str, tuple[int, float]]) -> set[str]:
        """Nodes of the largest total stability, no one above another; the root is none. ``left``: rows that leave each node, and the sum of their lambdas."""
        size, stability, best, kept = {}, {}, {}, {}
        for node in reversed(self.order):
            n, lambdas = left.get(node, (0, 0.0))
            below = [size[p] for p in self.parts.get(node, ())]
            size[node] = n + sum(below)
            stability[node] = lambdas - n * self.birth[node] + sum(below) * (self.split.get(node, 0.0) - self.birth[node] if below else 0.0)
            parts = sum(best[p] for p in self.parts.get(node, ()))
            kept[node] = node != self.root and (not below or stability[node] >= parts)
            best[node] = stability[node] if kept[node] else parts
        out, free = set(), [self.root]
        for node in free:
            if node is not None and kept.get(node):
                out.add(node)
            else:
                free += self.parts.get(node, ())
        return out


def density_clusters(df: DataFrame, cols: list[str], least: int = 15, samples: int = 5, neighbours: int = 15, key: str = "row_id") -> DataFrame:
    """key, ``cluster`` (0 for the largest; -1: noise) and ``lambda``, the density at which the row leaves the hierarchy (null: it reached no large group)."""
    rows = df.select(F.col(key).cast("long").alias("i"))
    members, between = atoms(rows, reachability(df, cols, samples, neighbours, key), least)
    leaves = [r[0] for r in members.filter("atom is not null").select("atom").distinct().orderBy("atom").collect()]  # rows / least at most
    merges = [((r["w"], r["u"], r["v"]), r["a"], r["b"]) for r in spanning_forest(stage(between, "density-between")).orderBy("w", "u", "v").collect()]  # one fewer
    known = members.withColumn("lambda", 1 / F.col("at.w"))
    if not leaves:
        return known.select(F.col("i").alias(key), F.lit(-1).alias("cluster"), F.col("lambda"))
    tree = Tree(leaves, merges)
    spark = df.sparkSession
    edge = "struct<w: double, u: long, v: long>"
    paths = spark.createDataFrame(tree.paths(leaves), f"_atom long, node string, low {edge}, high {edge}")
    inside = (F.col("atom") == F.col("_atom")) & (F.col("at") > F.col("low")) & (F.col("at") < F.col("high"))
    placed = stage(known.join(paths, inside, "left").select("i", "lambda", "node"), "density-placed")
    left = {r["node"]: (r["n"], r["s"]) for r in placed.filter("node is not null").groupBy("node").agg(F.count("*").alias("n"), F.sum("lambda").alias("s")).collect()}
    chosen, owner = tree.chosen(left), {}
    for node in tree.order:
        owner[node] = node if node in chosen else owner.get(tree.parent.get(node))
    counts: dict[str, int] = {}
    for node, (n, _) in left.items():
        if owner[node]:
            counts[owner[node]] = counts.get(owner[node], 0) + n
    number = {c: i for i, c in enumerate(sorted(counts, key=lambda c: (-counts[c], c)))}
    names = spark.createDataFrame([(node, number[o]) for node, o in owner.items() if o in number], "node string, cluster int")
    return placed.join(names, "node", "left").select(F.col("i").alias(key), F.coalesce("cluster", F.lit(-1)).alias("cluster"), "lambda")
