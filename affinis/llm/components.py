"""Problem 4: one group for all records linked directly or through others, by low-diameter decomposition.

Each level draws an exponential shift for every vertex from a hash of its number, level and seed. Vertices start
growing clusters at the negative of their shift, a hop costs one, and each vertex joins the cluster that reaches it
first. Clusters contract to single vertices, edges between clusters go to the next level, and the assignments of all
levels compose to the component. A level relabels within components only, so any number of hops keeps the result
exact; shifts decide only how fast the graph shrinks.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from affinis.llm.common import WHITE
from affinis.runtime import stage

#: Rate of the exponential shifts: an edge survives a level with probability of about 1 - exp(-BETA).
BETA = 0.35
#: Hops that clusters grow within a level before they contract.
HOPS = 3


def _grow(edges: DataFrame, level: int, seed: int) -> DataFrame:
    """(v, c): each vertex of a level with the cluster that reaches it first within HOPS hops."""
    unit = (F.shiftright(F.xxhash64("v", F.lit(level), F.lit(seed)), 11).bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))
    state = edges.select(F.col("src").alias("v")).distinct().select("v", F.struct((F.log(unit) / F.lit(BETA)).alias("t"), F.col("v").alias("c")).alias("best"))
    for _ in range(HOPS):
        sent = edges.join(state, edges.src == state.v).select(F.col("dst").alias("v"), F.struct((F.col("best.t") + 1).alias("t"), F.col("best.c").alias("c")).alias("best"))
        state = state.unionByName(sent).groupBy("v").agg(F.min("best").alias("best"))
    return state.select("v", F.col("best.c").alias("c"))


def connected_components(edges: DataFrame, src: str, dst: str, seed: int = 7) -> DataFrame:
    """(node, component): every endpoint of an edge with the smallest endpoint of its component.

    Edges may repeat, run in both directions or be loops; rows with a null endpoint are ignored. A loop alone yields a
    component of one. Hubs are safe: messages combine before the shuffle, and a vertex has one row on the state side,
    so adaptive execution can split a hub's edges. An empty input gives an empty result.
    """
    spark = edges.sparkSession
    links = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null").distinct()
    links = stage(links, "cc-links")
    names = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    names = stage(names.select("node", F.monotonically_increasing_id().alias("v")), "cc-nodes")
    a, b = names.select(F.col("node").alias("a"), F.col("v").alias("src")), names.select(F.col("node").alias("b"), F.col("v").alias("dst"))
    level_edges = stage(both_ways(links.where("a <> b").join(a, "a").join(b, "b").select("src", "dst")), "cc-edges")
    moves, level = [], 0
    while not level_edges.isEmpty():
        grown = stage(_grow(level_edges, level, seed), "cc-level")
        moves.append(grown)
        s, d = grown.select(F.col("v").alias("src"), F.col("c").alias("cs")), grown.select(F.col("v").alias("dst"), F.col("c").alias("cd"))
        crossing = level_edges.where("src < dst").join(s, "src").join(d, "dst").where("cs <> cd").select(F.col("cs").alias("src"), F.col("cd").alias("dst"))
        level_edges = stage(both_ways(crossing), "cc-edges")
        level += 1
    out = names.select("node", F.col("v").alias("root"))
    if moves:
        total = moves[-1].select(F.col("v"), F.col("c").alias("root"))
        for k, earlier in enumerate(reversed(moves[:-1])):
            later = total.select(F.col("v").alias("c"), "root")
            total = earlier.join(later, "c", "left").select("v", F.coalesce("root", "c").alias("root"))
            if k % 4 == 3:
                total = stage(total, "cc-compose")
        out = names.join(total, "v", "left").select("node", F.coalesce("root", "v").alias("root"))
    out = stage(out, "cc-roots")
    least = out.groupBy("root").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("members"))
    return out.join(least, "root").select("node", "component", "members")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.src", "e.dst").distinct()


def tidy_id(col: str):
    """Identifiers compare lower-cased and without outer white space; blank ones count as null."""
    t = F.lower(F.regexp_replace(F.col(col), f"^{WHITE}+|{WHITE}+$", ""))
    return F.when(t != "", t)


def record_links(results: DataFrame, records: DataFrame, min_score: float = 0.85) -> DataFrame:
    """(src, dst) ties between documents: a scored pair at min_score or above, or equal hashes of stored records.

    Scores above 1.001 are percentages. Documents of one hash are tied as a star around the smallest id, so a hash
    shared by n documents gives n rows, not n * n. Every id, tied or not, also has a loop so that it stays a record.
    """
    score = F.when(F.col("similarityScore") > 1.001, F.col("similarityScore") / 100).otherwise(F.col("similarityScore"))
    pairs = results.select(tidy_id("documentAId").alias("src"), tidy_id("documentBId").alias("dst"), (F.coalesce(score, F.lit(-1.0)) >= min_score).alias("tied"))
    tied = pairs.where("tied and src is not null and dst is not null").select("src", "dst")
    stored = records.select(tidy_id("documentId").alias("src"), F.lower(F.trim("sha256Hash")).alias("h")).where("src is not null")
    hashed = stored.where("h is not null and h <> ''").distinct()
    centre = hashed.groupBy("h").agg(F.min("src").alias("dst"))
    star = hashed.join(centre, "h").select("src", "dst")
    loops = stored.select("src").unionByName(pairs.select("src")).unionByName(pairs.select(F.col("dst").alias("src"))).where("src is not null").select("src", F.col("src").alias("dst"))
    return tied.unionByName(star).unionByName(loops).distinct()


def record_groups(results: DataFrame, records: DataFrame, min_score: float = 0.85) -> DataFrame:
    """(document_id, group_id, members) for every id in stored records or scored pairs; group_id is the smallest id."""
    found = connected_components(record_links(results, records, min_score), "src", "dst")
    return found.select(F.col("node").alias("document_id"), F.col("component").alias("group_id"), "members")
