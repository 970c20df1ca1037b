"""Symbol graphs: edges by joins, ranks and components by rounds, queries over nodes and edges.

symbols: id, name, full_source, ordinal (order of insertion), is_exported. edges: src, dst, type, weight. Rounds cut their lineage
through the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut, numbered

DAMPING, ROUNDS, CUT_EVERY = 0.85, 20, 5
WEIGHTS = {"call": 1.0, "inheritance": 2.0, "implementation": 1.5, "import": 1.0}
#: Names up to which the name side of the substring join is broadcast.
BROADCAST_NAMES = 200_000


def _edge(df: DataFrame, kind: str) -> DataFrame:
    return df.select("src", "dst", F.lit(kind).alias("type"), F.lit(WEIGHTS[kind]).alias("weight"))


def call_edges(symbols: DataFrame, ignore: str | None = None) -> DataFrame:
    """a -> every symbol named n, where n isn't a's name and occurs anywhere in a's source, whatever the case. The substring
    join is over distinct names; only its hits meet the symbols of those names."""
    s = symbols if ignore is None else symbols.filter(~F.col("name").rlike(ignore))
    names = s.select("name").distinct()
    if names.count() <= BROADCAST_NAMES:
        names = F.broadcast(names)
    hits = s.select(F.col("id").alias("src"), F.col("name").alias("own"), F.lower("full_source").alias("low")).join(
        names, (F.col("own") != F.col("name")) & F.col("low").contains(F.lower("name"))
    )
    return _edge(hits.select("src", "name").join(s.select("name", F.col("id").alias("dst")), "name"), "call")


def inheritance_edges(symbols: DataFrame) -> DataFrame:
    parent = F.regexp_extract("full_source", "extends\\s+([A-Za-z0-9_]+)", 1)
    kids = symbols.select(F.col("id").alias("src"), parent.alias("name")).filter("name != ''")
    return _edge(kids.join(symbols.select("name", F.col("id").alias("dst")), "name"), "inheritance")


def implementation_edges(symbols: DataFrame) -> DataFrame:
    listed = F.regexp_extract("full_source", "implements\\s+([A-Za-z0-9_.,\\s]+)", 1)
    each = symbols.select(F.col("id").alias("src"), F.explode(F.split(listed, ",")).alias("name")).select("src", F.trim("name").alias("name")).filter("name != ''")
    return _edge(each.join(symbols.select("name", F.col("id").alias("dst")), "name"), "implementation")


def unique_edges(edges: DataFrame) -> DataFrame:
    """No loops; one edge for each (src, dst, type)."""
    return edges.filter("src != dst").dropDuplicates(["src", "dst", "type"])


def all_edges(symbols: DataFrame) -> DataFrame:
    return unique_edges(call_edges(symbols).unionByName(inheritance_edges(symbols)).unionByName(implementation_edges(symbols)))


def add_imports(edges: DataFrame, imports: DataFrame) -> DataFrame:
    """edges, and an import edge for each (src, dst) of imports that has no edge of any type."""
    new = imports.select("src", "dst").filter("src != dst").distinct().join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    return edges.unionByName(_edge(new, "import"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("fan_out"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    return nodes.select("id").join(out, "id", "left").join(into, "id", "left").na.fill(0, ["fan_out", "fan_in"])


def page_rank(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(id, page_rank) after a fixed number of rounds. A node gives rank / outgoing edges times the edge's weight; what nodes
    without edges hold is spread over all."""
    ids = nodes.select("id").distinct()
    n = ids.count()
    if not n:
        return ids.withColumn("page_rank", F.lit(0.0))
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("outs"))
    links = cut(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("outs")).alias("share")))
    dangling = cut(ids.join(out.withColumnRenamed("src", "id"), "id", "left").select("id", F.col("outs").isNull().alias("dangling")))
    pr = dangling.withColumn("page_rank", F.lit(1.0 / n))
    for k in range(rounds):
        lost = pr.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("page_rank"))), F.lit(0.0)).alias("lost"))
        got = links.join(pr.select(F.col("id").alias("src"), "page_rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("page_rank") * F.col("share")).alias("got"))
        new = F.lit((1 - damping) / n) + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)
        pr = dangling.join(got, "id", "left").crossJoin(F.broadcast(lost)).select("id", "dangling", new.alias("page_rank"))
        if k % CUT_EVERY == CUT_EVERY - 1:
            pr = cut(pr)
    return pr.select("id", "page_rank")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cluster): components of the undirected graph, numbered by their first node's ordinal. Labels jump to their label's label
    each round, so rounds grow with the logarithm of the diameter."""
    both = cut(_both_ways(edges))
    lab = cut(nodes.select("id", F.col("ordinal").cast("long").alias("own"), F.col("ordinal").cast("long").alias("label")))
    while True:
        near = both.join(lab.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("m"))
        low = lab.join(near, "id", "left").select("id", "own", F.least("label", F.coalesce("m", "label")).alias("label"), F.col("label").alias("old"))
        jump = low.select(F.col("own").alias("label"), F.col("label").alias("far"))
        new = cut(low.join(jump, "label").select("id", "own", F.least("label", "far").alias("label"), "old"))
        if new.filter("label != old").isEmpty():
            break
        lab = new.drop("old")
    ranks = numbered(new.select("label").distinct(), "cluster", "label")
    return new.join(ranks, "label").select("id", F.col("cluster").cast("long").alias("cluster"))


def depths(nodes: DataFrame, edges: DataFrame, entries: DataFrame, most: int = 0) -> DataFrame:
    """(id, depth): steps from the nearest node that entries name, over edges either way; 0 where none leads. most: steps, 0 for any."""
    both = cut(_both_ways(edges))
    seen = cut(nodes.join(entries.select("name").distinct(), "name", "left_semi").select("id", F.lit(0).cast("long").alias("depth")))
    front, k = seen, 0
    while not most or k < most:
        k += 1
        front = cut(both.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(k).cast("long")))
        if front.isEmpty():
            break
        seen = cut(seen.union(front))
    return nodes.select("id").join(seen, "id", "left").na.fill(0, ["depth"])


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id")))
    return nodes.join(ends, "id", "left_anti")


def entry_candidates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.filter("is_exported").join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row; nodes with cluster and page_rank."""
    n = nodes.agg(F.count(F.lit(1)).alias("total_nodes"), F.countDistinct("cluster").alias("clusters"), F.avg("page_rank").alias("mean_page_rank"))
    kinds = [F.count(F.when(F.col("type") == k, 1)).alias(f"{k}_edges") for k in WEIGHTS]
    return n.crossJoin(edges.agg(F.count(F.lit(1)).alias("total_edges"), *kinds))


def named(nodes: DataFrame, name: Column | str) -> DataFrame:
    return nodes.filter(F.col("name") == name)


def shortest_paths(nodes: DataFrame, edges: DataFrame, start: str, goal: str) -> DataFrame:
    """(path, total_weight, depth), one for each pair of nodes with those names. Breadth first over edges either way; of equally short
    ways the one found first counts (order of the node it comes from, then of the edge). edges need an ordinal."""
    e = edges.select("src", "dst", "weight", F.col("ordinal").alias("eo"))
    steps = cut(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "eo")))
    goals = nodes.filter(F.col("name") == goal).select(F.col("id").alias("goal"), F.col("ordinal").alias("go"))
    name = nodes.select("id", "name", "ordinal")
    front = name.filter(F.col("name") == start).select(F.col("id").alias("root"), "id", F.array("name").alias("path"), F.lit(0.0).alias("total_weight"), F.col("ordinal").cast("long").alias("pos"))
    seen = front = cut(front)
    while True:
        step = steps.join(front.withColumnRenamed("id", "src"), "src").join(seen.select("root", F.col("id").alias("dst")), ["root", "dst"], "left_anti")
        first = Window.partitionBy("root", "dst").orderBy("pos", "eo")
        new = step.withColumn("r", F.row_number().over(first)).filter("r = 1").join(name.select(F.col("id").alias("dst"), "name"), "dst")
        order = Window.partitionBy("root").orderBy("pos", "eo")
        new = new.select("root", F.col("dst").alias("id"), F.concat("path", F.array("name")).alias("path"), (F.col("total_weight") + F.col("weight")).alias("total_weight"), F.row_number().over(order).cast("long").alias("pos"))
        front = cut(new)
        if front.isEmpty():
            break
        seen = cut(seen.union(front))
    return seen.join(goals, F.col("id") == F.col("goal")).select("path", "total_weight", (F.size("path") - 1).alias("depth"))


def hot_path(nodes: DataFrame, edges: DataFrame) -> list[str]:
    """Names from the node with the highest rank along the heaviest edges to nodes not yet passed; at most 21. Each step looks
    at one node's edges."""
    top = nodes.orderBy(F.desc("page_rank"), "ordinal").select("id", "name").first()
    if top is None:
        return []
    ids, names = [top.id], [top.name]
    while len(ids) <= 20:
        nxt = edges.filter((F.col("src") == ids[-1]) & ~F.col("dst").isin(ids)).orderBy(F.desc("weight"), "ordinal").select("dst").first()
        if nxt is None:
            break
        ids.append(nxt.dst)
        names.append(nodes.filter(F.col("id") == nxt.dst).first().name)
    return names


def build(symbols: DataFrame, entries: DataFrame | None = None, max_depth: int = 0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with every figure of a node."""
    edges = cut(all_edges(symbols))
    nodes = symbols.join(page_rank(symbols, edges), "id").join(components(symbols, edges), "id").join(degrees(symbols, edges), "id")
    if entries is None:
        return nodes.withColumn("depth", F.lit(0).cast("long")), edges
    return nodes.join(depths(symbols, edges, entries, max_depth), "id"), edges
