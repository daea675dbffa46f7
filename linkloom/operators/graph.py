"""Graph queries over entities and relationships."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import values
from linkloom.operators.ordering import first_rows
from linkloom.operators.resolve import edges_bidi
from linkloom.session import cut_lineage



def subgraph(
    ents: DataFrame,
    rels: DataFrame,
    entity_type: str | None = None,
    limit: int | None = None,
    offset: int = 0,
    keep_dangling: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Nodes, optionally of one type and paged by id, and the edges among them."""
    nodes = ents
    if entity_type is not None:
        nodes = nodes.where(F.col("type") == entity_type)
    if limit is not None:
        nodes = nodes.orderBy("investigation_id", "id").offset(offset).limit(limit)
    elif offset:
        nodes = nodes.orderBy("investigation_id", "id").offset(offset)
    narrowed = entity_type is not None or limit is not None or offset
    if keep_dangling or not narrowed:
        return nodes, rels
    return nodes, induced_edges(nodes.select("investigation_id", "id"), rels, [])


def induced_edges(nodes: DataFrame, rels: DataFrame, per: list[str]) -> DataFrame:
    """Edges with both ends among the nodes. ``per`` names columns that tell several node sets apart."""
    keys = ["investigation_id"]
    ids = nodes.select(*per, *keys, "id").distinct()
    if not per:
        for end in ("source_id", "target_id"):
            rels = rels.join(ids.withColumnRenamed("id", end), [*keys, end], "left_semi")
        return rels
    at_source = rels.join(ids.withColumnRenamed("id", "source_id"), [*keys, "source_id"])
    return at_source.join(ids.withColumnRenamed("id", "target_id"), [*per, *keys, "target_id"], "left_semi")


def _links(rels: DataFrame, hops: int) -> DataFrame:
    """Distinct links in both directions; written once when several hops read them."""
    links = edges_bidi(rels).distinct()
    return cut_lineage(links) if hops > 1 else links


def reach(rels: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Nodes within ``depth`` hops of every seed, with the least number of hops.

    ``seeds``: investigation_id, seed. Each hop joins only the newest nodes with the edges and drops the ones already
    seen. Deep searches write every frontier to the checkpoint folder, so a plan never repeats an earlier hop.
    """
    if depth < 1:
        raise ValueError("depth must be 1 or more")
    keys = ["investigation_id", "seed"]
    links = _links(rels, depth)
    frontier = seeds.select(*keys, F.col("seed").alias("node")).distinct()
    seen = frontier.withColumn("hops", F.lit(0))
    for hop in range(1, depth + 1):
        step = (
            frontier.withColumnRenamed("node", "from_id")
            .join(links, ["investigation_id", "from_id"])
            .select(*keys, F.col("to_id").alias("node"))
            .distinct()
        )
        frontier = step.join(seen.select(*keys, "node"), [*keys, "node"], "left_anti")
        if hop > 1 or depth > 2:
            frontier = cut_lineage(frontier)
        seen = seen.unionByName(frontier.withColumn("hops", F.lit(hop)))
    return seen


def neighbors(
    ents: DataFrame, rels: DataFrame, seeds: DataFrame, depth: int = 1, max_nodes: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Entities within ``depth`` hops of every seed, and all edges among them.

    ``max_nodes`` keeps the nearest nodes of each seed, ties by id; it is off by default.
    """
    near = reach(rels, seeds, depth)
    if max_nodes is not None:
        from pyspark.sql import Window as W

        window = W.partitionBy("investigation_id", "seed").orderBy("hops", "node")
        near = near.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= max_nodes).drop("_n")
    near = near.withColumnRenamed("node", "id")
    nodes = near.join(ents, ["investigation_id", "id"])
    return nodes, induced_edges(near, rels, ["seed"])


def entity_relationships(rels: DataFrame, ids: DataFrame, incident_only: bool = False) -> DataFrame:
    """Edges around entities (investigation_id, seed): those at the entity and, by default, those between its neighbours."""
    if not incident_only:
        return induced_edges(reach(rels, ids, 1).withColumnRenamed("node", "id"), rels, ["seed"])
    seeds = ids.select("investigation_id", "seed").distinct()
    at_source = rels.join(
        seeds.withColumn("source_id", F.col("seed")), ["investigation_id", "source_id"]
    )
    at_target = rels.where(F.col("source_id") != F.col("target_id")).join(
        seeds.withColumn("target_id", F.col("seed")), ["investigation_id", "target_id"]
    )
    return at_source.unionByName(at_target)


def _grown(front: DataFrame, links: DataFrame, forward: bool) -> DataFrame:
    """Half paths one edge longer: forward ones at their last node, backward ones before their first."""
    inv = "investigation_id"
    here, there = ("from_id", "to_id") if forward else ("to_id", "from_id")
    new = F.array(there)
    longer = F.concat("path", new) if forward else F.concat(new, "path")
    step = front.withColumnRenamed("node", here).join(links, [inv, here])
    step = step.where(~F.array_contains("path", F.col(there)))
    return step.select(inv, "end", F.col(there).alias("node"), longer.alias("path"))


def _meeting(pairs: DataFrame, ahead: DataFrame, back: DataFrame) -> DataFrame:
    """Paths of the pairs that consist of a half path from the source and one to the target that share their middle."""
    inv = "investigation_id"
    # Half paths that meet nothing are not multiplied by the targets of their source.
    ahead = ahead.join(back.select(inv, "node").distinct(), [inv, "node"], "left_semi")
    first = pairs.join(ahead.withColumnRenamed("end", "src"), [inv, "src"])
    rest = back.select(inv, F.col("end").alias("dst"), "node", F.expr("slice(path, 2, size(path))").alias("_rest"))
    return (
        first.join(rest, [inv, "dst", "node"])
        .where(~F.arrays_overlap("path", "_rest"))
        .select(inv, "src", "dst", F.concat("path", "_rest").alias("path"))
    )


def paths(rels: DataFrame, pairs: DataFrame, max_hops: int = 4, keep: int | None = None) -> DataFrame:
    """All simple paths of at most ``max_hops`` edges between the pairs (investigation_id, src, dst).

    Half paths grow from every source and to every target, once however many pairs share it, and meet in the middle: a
    path of L edges is a half of L/2 edges, rounded up, and one of the rest that share a node and no other. So
    nothing longer than half a path is carried along. ``keep`` keeps that many paths per pair, shortest first; a pair
    that has them is not searched any further.
    """
    if max_hops < 1:
        raise ValueError("max_hops must be 1 or more")
    inv = "investigation_id"
    links = _links(rels, max_hops)
    pairs = pairs.select(inv, "src", "dst").distinct()
    if max_hops > 2:
        pairs = cut_lineage(pairs)
    same = pairs.where(F.col("src") == F.col("dst")).select(inv, "src", "dst", F.array("src").alias("path"))
    pairs = pairs.where(F.col("src") != F.col("dst"))

    def ends(side: str) -> DataFrame:
        return pairs.select(inv, F.col(side).alias("end")).distinct()

    halves = {
        side: [ends(side).select(inv, "end", F.col("end").alias("node"), F.array("end").alias("path"))]
        for side in ("src", "dst")
    }
    reach_of = {"src": (max_hops + 1) // 2, "dst": max_hops // 2}
    done = [same]
    for hops in range(1, max_hops + 1):
        side = "src" if hops % 2 else "dst"
        front = halves[side][-1]
        if keep is not None:
            front = front.join(ends(side), [inv, "end"], "left_semi")
        longer = _grown(front, links, side == "src")
        grown = len(halves[side])
        # A half that a longer one builds on is read several times.
        halves[side].append(cut_lineage(longer) if 1 < grown < reach_of[side] else longer)
        found = _meeting(pairs, halves["src"][(hops + 1) // 2], halves["dst"][hops // 2])
        if keep is not None and 1 < hops < max_hops:
            found = cut_lineage(found)
        done.append(found)
        if keep is not None and 1 < hops < max_hops:
            # All paths found later are longer.
            all_found = functools.reduce(DataFrame.unionByName, done)
            full = all_found.groupBy(inv, "src", "dst").count().where(F.col("count") >= keep).drop("count")
            pairs = cut_lineage(pairs.join(full, [inv, "src", "dst"], "left_anti"))
    every = functools.reduce(DataFrame.unionByName, done)
    found = every.select(inv, "src", "dst", "path", (F.size("path") - 1).alias("hops"))
    if keep is not None:
        found = first_rows(found, [inv, "src", "dst"], [F.col("hops"), F.col("path")], keep)
    return found


def path_graph(ents: DataFrame, rels: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes on the paths of every pair, and all edges among them."""
    per = ["src", "dst"]
    on_path = found.select("investigation_id", *per, F.explode("path").alias("id")).distinct()
    return on_path.join(ents, ["investigation_id", "id"]), induced_edges(on_path, rels, per)


def entity_detail(ents: DataFrame, ids: DataFrame) -> DataFrame:
    """Entities by (investigation_id, id), with type and value of the id apart."""
    rows = ents.join(ids.select("investigation_id", "id").distinct(), ["investigation_id", "id"], "left_semi")
    return rows.withColumn("id_type", values.id_type(F.col("id"))).withColumn("id_value", values.id_value(F.col("id")))


def to_graph_json(ents: DataFrame, rels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge elements, each one JSON object under ``data``."""
    source_list = F.coalesce("sources", F.array().cast("array<string>"))
    node = F.struct(
        "id",
        F.col("value").alias("label"),
        "type",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        "first_seen",
        "last_seen",
        F.coalesce(F.nullif("source_count", F.lit(0)), F.size(source_list)).alias("source_count"),
        source_list.alias("sources"),
        "properties",
    )
    edge = F.struct(
        "id",
        F.col("source_id").alias("source"),
        F.col("target_id").alias("target"),
        "relationship_type",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        "discovered_at",
        F.coalesce("method", F.lit("")).alias("method"),
    )
    return (
        ents.select("investigation_id", "id", F.to_json(F.struct(node.alias("data"))).alias("element")),
        rels.select("investigation_id", "id", F.to_json(F.struct(edge.alias("data"))).alias("element")),
    )
