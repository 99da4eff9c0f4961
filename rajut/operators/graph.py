"""Graph metrics and walks (G1-G17) over node and edge tables.

Nodes have ``grade`` and ``name``; edges ``src_grade, src, tgt_grade, tgt`` and
``rel_type``. Everything is counts, joins and aggregations; iterative operators
cut their lineage in the shared checkpoint folder.
"""

from __future__ import annotations

import heapq
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rajut.functions import vocab
from rajut.functions.normalize import strip
from rajut.functions.scalars import ratio
from rajut.session import cut

ENDS = ["src_grade", "src", "tgt_grade", "tgt"]


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected degree of every node; parallel edges count, a self-loop counts once, isolated nodes are 0."""
    a = edges.select(F.col("src_grade").alias("grade"), F.col("src").alias("name"))
    loop = (F.col("src_grade") == F.col("tgt_grade")) & (F.col("src") == F.col("tgt"))
    b = edges.where(~loop).select(F.col("tgt_grade").alias("grade"), F.col("tgt").alias("name"))
    counted = a.unionByName(b).groupBy("grade", "name").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("grade", "name").join(counted, ["grade", "name"], "left").fillna(0, ["degree"])


def average_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G1."""
    return degrees(nodes, edges).agg(F.coalesce(F.avg("degree"), F.lit(0.0)).alias("average_degree"), F.count(F.lit(1)).alias("n_nodes"))


def _one_row(*frames: DataFrame) -> DataFrame:
    """Frames of one row side by side."""
    keyed = [f.withColumn("_k", F.lit(0)) for f in frames]
    return reduce(lambda a, b: a.join(b, "_k"), keyed).drop("_k")


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """E / (N (N - 1)), 0 for fewer than two nodes."""
    both = _one_row(nodes.agg(F.count(F.lit(1)).alias("n_nodes")), edges.agg(F.count(F.lit(1)).alias("n_edges")))
    n = F.col("n_nodes").cast("double")
    return both.select("n_nodes", "n_edges", ratio(F.col("n_edges"), n * (n - 1)).alias("density"))


def grade_modularity(edges: DataFrame) -> DataFrame:
    """Directed modularity of the partition by grade; 0 without edges."""
    out = edges.groupBy(F.col("src_grade").alias("grade")).agg(F.count(F.lit(1)).alias("k_out"), F.sum(F.when(F.col("src_grade") == F.col("tgt_grade"), 1).otherwise(0)).alias("inside"))
    into = edges.groupBy(F.col("tgt_grade").alias("grade")).agg(F.count(F.lit(1)).alias("k_in"))
    by = out.join(into, "grade", "full_outer").fillna(0, ["k_out", "inside", "k_in"])
    m = F.sum("k_out").over(Window.partitionBy()).cast("double")  # one row per grade
    term = F.col("inside") / m - F.col("k_out") * F.col("k_in") / (m * m)
    return by.withColumn("term", term).agg(F.coalesce(F.sum("term"), F.lit(0.0)).alias("modularity"), F.coalesce(F.sum("k_out"), F.lit(0)).alias("n_edges"))


def robustness(nodes: DataFrame, edges: DataFrame, wrong: Column) -> DataFrame:
    """Average degree, density, modularity, nodes and edges, with and without wrong edges, one metric a row."""
    # every metric reads both, so they are made once
    nodes, edges = cut(nodes.select("grade", "name")), cut(edges.select(*ENDS, wrong.alias("_wrong")))
    rows = []
    for variant, e in (("all", edges), ("without_wrong", edges.where(~F.col("_wrong")))):
        one = _one_row(average_degree(nodes, e).select("average_degree"), density(nodes, e), grade_modularity(e).select("modularity"))
        rows.append(one.select(F.lit(variant).alias("variant"), F.expr("stack(5, 'average_degree', average_degree, 'density', density, 'modularity', modularity, 'nodes', cast(n_nodes as double), 'edges', cast(n_edges as double)) as (metric, value)")))
    return rows[0].unionByName(rows[1])


def simple_edges(edges: DataFrame) -> DataFrame:
    """Undirected edges without loops and repetitions, as a < b of node keys."""
    key = lambda g, n: F.concat_ws("\x1f", F.coalesce(F.col(g), F.lit("")), F.col(n))
    ends = edges.select(key("src_grade", "src").alias("u"), key("tgt_grade", "tgt").alias("v")).where(F.col("u") != F.col("v"))
    return ends.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def simple_graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G5 without the community part: mean normalised degree, undirected density and components, rounded to 3."""
    simple = cut(simple_edges(edges))
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes"))
    m = simple.agg(F.count(F.lit(1)).alias("n_edges"))
    comps = components(nodes, edges).agg(F.countDistinct("component").alias("n_components"))
    nn = F.col("n_nodes").cast("double")
    return _one_row(n, m, comps).select("n_nodes", "n_edges", "n_components", ratio(2 * F.col("n_edges"), nn * (nn - 1), 3).alias("degree_centrality"), ratio(2 * F.col("n_edges"), nn * (nn - 1), 3).alias("density"))


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Grade, name, component (its smallest node key) by alternating large and small stars.

    Each round points nodes at the least of their neighbours; the number of rounds
    grows with the logarithm of the longest path. Minima are combined before the
    shuffle, so a hub costs no more than its edges.
    """
    key = F.concat_ws("\x1f", F.coalesce("grade", F.lit("")), F.col("name"))
    e = cut(simple_edges(edges).select(F.col("b").alias("u"), F.col("a").alias("v")))

    def state(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    before = state(e)
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = cut(small.where(F.col("u") != F.col("v")).distinct())
        after = state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    root = e.groupBy("u").agg(F.min("v").alias("root"))
    keyed = nodes.select("grade", "name", key.alias("u"))
    return keyed.join(root, "u", "left").select("grade", "name", F.coalesce("root", "u").alias("component"))


def completeness(descriptions: DataFrame, column: str) -> DataFrame:
    """Share of rows whose text is not blank."""
    full = (strip(F.coalesce(F.col(column), F.lit(""))) != "").cast("int")
    return descriptions.agg(F.count(F.lit(1)).alias("n"), F.sum(full).alias("n_described"), F.coalesce(F.avg(full), F.lit(0.0)).alias("completeness"))


def empty_rate(parents: DataFrame, children: DataFrame, keys: list[str]) -> DataFrame:
    """Share of parents without any child, 0 without parents."""
    counted = parents.select(*keys).distinct().join(children.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, "left")
    empty = F.col("n").isNull().cast("int")
    return counted.agg(F.count(F.lit(1)).alias("n_parents"), F.coalesce(F.sum(empty), F.lit(0)).alias("n_empty"), F.coalesce(F.avg(empty), F.lit(0.0)).alias("empty_rate"))


def typed_ratio(edges: DataFrame, types: tuple[str, ...] = vocab.RELATION_TYPES, structural: tuple[str, ...] = vocab.STRUCTURAL_TYPES) -> DataFrame:
    """Share of non-structural edges whose type is in the vocabulary; null without any."""
    counted = edges.where(~F.coalesce(F.col("rel_type"), F.lit("")).isin(*structural))
    typed = F.coalesce(F.col("rel_type").isin(*types), F.lit(False)).cast("int")
    return counted.agg(F.coalesce(F.sum(typed), F.lit(0)).alias("n_typed"), F.count(F.lit(1)).alias("n_edges"), F.avg(typed).alias("typed_ratio"))


def longest_chain(edges: DataFrame, most: int = 10) -> DataFrame:
    """The longest path of at most ``most`` edges that ends where no edge leaves; edges are not repeated.

    ``edges``: edge_id, u, v. One row: n_edges, chain. Ties go to the smallest chain.
    """
    paths = edges.select(F.col("v").alias("end"), F.array("edge_id").alias("used"), F.array("u", "v").alias("chain"))
    sinks = edges.select(F.col("v").alias("end")).distinct().join(edges.select(F.col("u").alias("end")).distinct(), "end", "left_anti")
    steps = cut(edges.select("edge_id", "u", F.col("v").alias("next")))
    paths = cut(paths)
    best = None
    for length in range(1, most + 1):
        done = paths.join(sinks, "end", "left_semi").agg(F.min("chain").alias("chain")).where(F.col("chain").isNotNull()).select(F.lit(length).alias("n_edges"), "chain")
        best = done if best is None else best.unionByName(done)
        if length == most:
            break
        grown = paths.join(steps, F.col("end") == F.col("u")).where(~F.array_contains("used", F.col("edge_id")))
        paths = cut(grown.select(F.col("next").alias("end"), F.concat("used", F.array("edge_id")).alias("used"), F.concat("chain", F.array("next")).alias("chain")))
        if paths.isEmpty():
            break
    return best.orderBy(F.desc("n_edges"), "chain").limit(1)


def parents_within(nodes: DataFrame, edges: DataFrame, steps: int) -> DataFrame:
    """U and the least node from which it is reached in 1 to ``steps`` edges. edges: u, v."""
    reached = edges.select(F.col("u").alias("top"), F.col("v").alias("u")).distinct()
    walk, every = reached, reached
    for _ in range(steps - 1):
        walk = walk.join(edges.select("u", F.col("v").alias("next")), "u").select("top", F.col("next").alias("u")).distinct()
        every = every.unionByName(walk)
    least = every.groupBy("u").agg(F.min("top").alias("parent"))
    return nodes.join(least, "u", "left")


def top_out_edges(edges: DataFrame, most: int = 5) -> DataFrame:
    """The ``most`` out-edges of each node by confidence (null is 0), ties by type, target and id."""
    w = Window.partitionBy("src_grade", "src").orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), "rel_type", "tgt", "rel_id")
    return edges.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most)


def contexts(nodes: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """Chapter and top out-edges of every node; nodes without edges have an empty list."""
    item = F.struct("pos", "rel_type", F.col("tgt").alias("target"), "confidence")
    lists = top_out_edges(edges, most).groupBy(F.col("src_grade").alias("grade"), F.col("src").alias("name")).agg(F.array_sort(F.collect_list(item)).alias("l"))  # at most ``most`` elements
    bare = F.transform("l", lambda e: F.struct(e["rel_type"].alias("rel_type"), e["target"].alias("target"), e["confidence"].alias("confidence")))
    none = F.array().cast("array<struct<rel_type:string,target:string,confidence:double>>")
    return nodes.join(lists, ["grade", "name"], "left").withColumn("out_edges", F.coalesce(bare, none)).drop("l")


def typed_edges(edges: DataFrame, types: tuple[str, ...], prefix: str) -> DataFrame:
    """Edges of a type list or with a prefix."""
    return edges.where(F.col("rel_type").isin(*types) | F.col("rel_type").startswith(prefix))


def between_grades(edges: DataFrame) -> DataFrame:
    """G15."""
    return edges.where(F.col("src_grade") != F.col("tgt_grade")).agg(F.count(F.lit(1)).alias("n_cross"))


#: Graphs are contracted by moves made in parallel until this many edges are left, which one task finishes.
LOCAL_EDGES = 1_000_000
#: Rounds of parallel moves of one level, and levels at most (each at least halves what a graph with communities holds).
MOVE_ROUNDS, MOST_LEVELS = 8, 40

Weighted = list[tuple[str, str, float]]


def louvain_local(edges: Weighted, degrees: dict[str, float], most_levels: int = 20) -> dict[str, str]:
    """Deterministic Louvain on an undirected graph without loops: node -> least node of its community.

    ``degrees`` may exceed the sum of a node's edges by what a contracted node holds inside.
    """
    names = sorted(degrees)
    index = {x: i for i, x in enumerate(names)}
    near: list[dict[int, float]] = [{} for _ in names]
    for a, b, w in edges:
        near[index[a]][index[b]] = near[index[b]][index[a]] = w
    member = list(range(len(names)))
    degree = [degrees[x] for x in names]
    two_m = sum(degree)
    for _ in range(most_levels if two_m else 0):
        n = len(near)
        com, total, moved = list(range(n)), degree[:], False
        for _ in range(50):
            changed = False
            for i in range(n):
                weight: dict[int, float] = {}
                for j, w in near[i].items():
                    weight[com[j]] = weight.get(com[j], 0.0) + w
                own = com[i]
                total[own] -= degree[i]
                best, gain = own, weight.get(own, 0.0) - total[own] * degree[i] / two_m
                for c in sorted(weight):
                    g = weight[c] - total[c] * degree[i] / two_m
                    if g > gain + 1e-12:
                        best, gain = c, g
                total[best] += degree[i]
                if best != own:
                    com[i], changed, moved = best, True, True
            if not changed:
                break
        if not moved:
            break
        label = {c: k for k, c in enumerate(sorted(set(com)))}
        merged: list[dict[int, float]] = [{} for _ in label]
        sums = [0.0] * len(label)
        for i in range(n):
            a = label[com[i]]
            sums[a] += degree[i]
            for j, w in near[i].items():
                b = label[com[j]]
                if a != b:
                    merged[a][b] = merged[a].get(b, 0.0) + w
        member = [label[com[m]] for m in member]
        near, degree = merged, sums
    least: dict[int, str] = {}
    for x, m in zip(names, member):
        least[m] = min(least.get(m, x), x)
    return {x: least[m] for x, m in zip(names, member)}


def greedy_local(edges: Weighted, degrees: dict[str, float]) -> dict[str, str]:
    """Greedy agglomeration by modularity gain: node -> least node of its community."""
    degree = dict(degrees)
    m = sum(degree.values()) / 2
    link: dict[str, dict[str, float]] = {x: {} for x in degree}
    for a, b, w in edges:
        link[a][b] = link[b][a] = w
    group = {x: [x] for x in degree}
    gain = lambda a, b: link[a][b] / m - degree[a] * degree[b] / (2.0 * m * m)
    heap = [(-gain(a, b), a, b) for a in link for b in link[a] if a < b]
    heapq.heapify(heap)
    while heap:
        g, a, b = heapq.heappop(heap)
        if a not in link or b not in link or b not in link[a] or abs(-g - gain(a, b)) > 1e-15:
            continue
        if -g <= 1e-12:
            break
        for c, w in link.pop(b).items():
            if c == a:
                continue
            link[a][c] = link[a].get(c, 0) + w
            link[c][a] = link[a][c]
            del link[c][b]
        del link[a][b]
        degree[a] += degree.pop(b)
        group[a] += group.pop(b)
        for c in link[a]:
            x, y = min(a, c), max(a, c)
            heapq.heappush(heap, (-gain(x, y), x, y))
    return {x: min(g) for g in group.values() for x in g}


def _both_ways(edges: DataFrame) -> DataFrame:
    return cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "w").unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"), "w")))


def _moves(nodes: DataFrame, edges: DataFrame, two_m: float) -> DataFrame:
    """u, k, com: a level of Louvain in parallel: each round half of the nodes, by hash, may move to the best community next to them."""
    both = _both_ways(edges)
    state = nodes.withColumn("com", F.col("u"))
    for r in range(MOVE_ROUNDS):
        totals = state.groupBy("com").agg(F.sum("k").alias("total"))
        links = both.join(state.select(F.col("u").alias("v"), F.col("com").alias("c")), "v").groupBy("u", "c").agg(F.sum("w").alias("w"))
        offers = links.join(totals.select(F.col("com").alias("c"), F.col("total").alias("there")), "c").join(state.join(totals, "com"), "u")
        without_me = F.col("there") - F.when(F.col("c") == F.col("com"), F.col("k")).otherwise(0.0)
        offers = offers.withColumn("gain", F.col("w") - without_me * F.col("k") / two_m)
        stay = F.coalesce(F.max(F.when(F.col("c") == F.col("com"), F.col("gain"))), F.max(-(F.col("total") - F.col("k")) * F.col("k") / two_m))
        best = offers.groupBy("u").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "c")).alias("best"), stay.alias("stay"))
        go = (-F.col("best.loss") > F.col("stay") + 1e-12) & (F.pmod(F.xxhash64("u", F.lit(r)), F.lit(2)) == 0)
        state = cut(state.join(best, "u", "left").select("u", "k", F.when(go, F.col("best.c")).otherwise(F.col("com")).alias("com"), F.coalesce(go, F.lit(False)).alias("went")))
        if r and state.where("went").isEmpty():
            break
        state = state.drop("went")
    return state.select("u", "k", "com")


def _matches(nodes: DataFrame, edges: DataFrame, two_m: float) -> DataFrame:
    """u, k, com: a round of greedy agglomeration in parallel: nodes that are each other's best merge."""
    both = _both_ways(edges)
    k = lambda n: nodes.select(F.col("u").alias(n), F.col("k").alias(f"k{n}"))
    gain = F.col("w") - F.col("ku") * F.col("kv") / two_m
    best = both.join(k("u"), "u").join(k("v"), "v").where(gain > 1e-12).groupBy("u").agg(F.min(F.struct((-gain).alias("loss"), F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))).alias("p")).select("u", "p.a", "p.b")
    pair = best.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 2).select(F.col("b").alias("u"), F.col("a").alias("com"))
    return nodes.join(pair, "u", "left").select("u", "k", F.coalesce("com", "u").alias("com"))


def communities(edges: DataFrame, method: str = "louvain", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """U and community (its least node) by Louvain or greedy agglomeration of the simple graph.

    Both work by moves and contraction. A graph of more than ``local_edges`` edges is
    moved in parallel and contracted, level by level, until it has no more than that
    or nothing gains; one task then finishes the contracted graph with the same
    method's sequential moves.
    """
    step, finish = {"louvain": (_moves, louvain_local), "greedy": (_matches, greedy_local)}[method]
    left = cut(simple_edges(edges).select("a", "b", F.lit(1.0).alias("w")))
    nodes = cut(left.select(F.col("a").alias("u"), "w").unionByName(left.select(F.col("b").alias("u"), "w")).groupBy("u").agg(F.sum("w").alias("k")))
    member = nodes.select("u", F.col("u").alias("top"))
    n = two_m = left.count()
    two_m = 2.0 * two_m
    for _ in range(MOST_LEVELS):
        if n <= local_edges:
            break
        placed = cut(step(nodes, left, two_m))
        member = cut(member.join(placed.select(F.col("u").alias("top"), "com"), "top").select("u", F.col("com").alias("top")))
        to = lambda c, n: placed.select(F.col("u").alias(c), F.col("com").alias(n))  # noqa: B023, E731
        met = left.join(to("a", "x"), "a").join(to("b", "y"), "b").where(F.col("x") != F.col("y"))
        left = cut(met.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w")))
        nodes = cut(placed.groupBy("com").agg(F.sum("k").alias("k")).withColumnRenamed("com", "u"))
        before, n = n, left.count()
        if n == before:
            break

    if n > local_edges:  # nothing gains any more
        top = member.select("u", F.col("top").alias("community"))
    else:

        def run(batches):
            rows = [r for b in batches for r in zip(b["a"], b["b"], b["w"])]
            degrees = {a: w for a, b, w in rows if b is None}
            found = finish(sorted(r for r in rows if r[1] is not None), degrees)
            yield pd.DataFrame({"top": list(found), "community": list(found.values())}, dtype=object)

        every = left.unionByName(nodes.select(F.col("u").alias("a"), F.lit(None).cast("string").alias("b"), F.col("k").alias("w")))
        solved = every.coalesce(1).mapInPandas(run, "top string, community string")
        top = member.join(solved, "top").select("u", "community")
    least = top.groupBy("community").agg(F.min("u").alias("least"))
    return top.join(least, "community").select("u", F.col("least").alias("community"))


def community_quality(edges: DataFrame, method: str) -> DataFrame:
    """Number and modularity of the communities."""
    return undirected_modularity(edges, cut(communities(edges, method)))


def undirected_modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Modularity of a partition (u, community) of the simple undirected graph, and the number of communities."""
    simple = simple_edges(edges)
    placed = simple.join(membership.select(F.col("u").alias("a"), F.col("community").alias("ca")), "a").join(membership.select(F.col("u").alias("b"), F.col("community").alias("cb")), "b")
    inside = placed.where(F.col("ca") == F.col("cb")).groupBy(F.col("ca").alias("community")).agg(F.count(F.lit(1)).alias("inside"))
    ends = placed.select(F.col("ca").alias("community")).unionByName(placed.select(F.col("cb").alias("community"))).groupBy("community").agg(F.count(F.lit(1)).alias("k"))
    by = ends.join(inside, "community", "left").fillna(0, ["inside"])
    total = by.agg(F.sum("k").alias("two_m"), F.sum("inside").alias("inside"), F.sum(F.col("k").cast("double") * F.col("k")).alias("kk"), F.count(F.lit(1)).alias("n_communities"))
    return total.select("n_communities", F.coalesce(F.col("inside") * 2.0 / F.col("two_m") - F.col("kk") / (F.col("two_m").cast("double") * F.col("two_m")), F.lit(0.0)).alias("modularity"))
