"""Lineage graph: assets, typed edges, reachability and impact.

Closures without paths are one breadth-first search for all starts and both directions.  Starts are numbered and packed
64 to a word: a row is a node with the mask of the starts that reach it, and one ``bit_or`` per round moves them all a step on.
So a round has at most (nodes x starts / 64) rows, and counts and depths per start come from the new bits of the rounds without
unpacking them.  Each round writes its new bits as a table in the checkpoint folder; the driver only learns whether it found anything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.functions.distributed import cut_lineage, number_rows

#: Rounds after which the seen set is rewritten as one table.
COMPACT_EVERY = 8
#: Starts in a word.
BITS = 64
BOTH = ("downstream", "upstream")


def lineage_edges(catalog: DataFrame, fks: DataFrame) -> DataFrame:
    """DIRECT edges from foreign keys whose two tables are in the catalog."""
    known = catalog.select("table_name").distinct()
    ok = fks.join(known.withColumnRenamed("table_name", "source_table"), "source_table", "left_semi").join(
        known.withColumnRenamed("table_name", "target_table"), "target_table", "left_semi"
    )
    return ok.select(
        F.concat(F.lit("fk_"), "constraint_name").alias("relationship_id"),
        F.concat(F.lit("table_"), "source_table").alias("source_asset_id"),
        F.concat(F.lit("table_"), "target_table").alias("target_asset_id"),
        F.lit("direct").alias("lineage_type"),
        F.concat(F.lit("Foreign key relationship: "), "source_column", F.lit(" -> "), "target_column").alias("description"),
    )


def neighbors(edges: DataFrame, asset: object, direction: str = "both") -> DataFrame:
    """Direct upstream and downstream assets with the touching edge."""
    up = edges.where(F.col("dst") == asset).select(F.lit("upstream").alias("direction"), F.col("src").alias("asset"), "src", "dst")
    down = edges.where(F.col("src") == asset).select(F.lit("downstream").alias("direction"), F.col("dst").alias("asset"), "src", "dst")
    if direction == "upstream":
        return up
    if direction == "downstream":
        return down
    return up.unionByName(down)


def _oriented(edges: DataFrame, direction: str) -> DataFrame:
    a, b = ("src", "dst") if direction == "downstream" else ("dst", "src")
    return edges.select(F.col(a).alias("_from"), F.col(b).alias("_to")).distinct()


def numbered_starts(starts: DataFrame) -> DataFrame:
    """``start, word, bit``: the distinct starts, 64 to a word."""
    one = starts.select(F.col(starts.columns[0]).alias("start")).distinct()
    place = F.col("row_no") - 1
    return cut_lineage(
        number_rows(one, [], ["start"]).select("start", F.floor(place / BITS).alias("word"), (place % BITS).cast("int").alias("bit"))
    )


def levels(
    edges: DataFrame, numbered: DataFrame, directions: Sequence[str] = BOTH, max_hops: int | None = None, target: object | None = None
) -> DataFrame:
    """``direction, node, word, mask, distance``: the starts that reach a node first in that many steps.

    A node that was seen never returns to a start, so cycles end and a start is not its own descendant.
    """
    step = None
    for way in directions:
        one = _oriented(edges, way).withColumn("direction", F.lit(way))
        step = one if step is None else step.unionByName(one)
    step = cut_lineage(step)  # read once per round
    keys = ["direction", "node", "word"]
    own = F.expr("shiftleft(1L, bit)").alias("mask")
    seeds = numbered.select(F.explode(F.lit(list(directions))).alias("direction"), F.col("start").alias("node"), "word", own)
    frontier = cut_lineage(seeds.groupBy(*keys).agg(F.bit_or("mask").alias("mask")))
    seen, found, hops = frontier, [], 0
    while max_hops is None or hops < max_hops:
        hops += 1
        at = (F.col("f.direction") == F.col("s.direction")) & (F.col("f.node") == F.col("s._from"))
        moved = frontier.alias("f").join(step.alias("s"), at).select("f.direction", F.col("s._to").alias("node"), "f.word", "f.mask")
        zero = F.lit(0).cast("bigint")
        both = moved.withColumn("old", zero).unionByName(seen.select(*keys, zero.alias("mask"), F.col("mask").alias("old")))
        grown = both.groupBy(*keys).agg(F.bit_or("mask").alias("mask"), F.bit_or("old").alias("old"))
        fresh = grown.select(*keys, F.col("mask").bitwiseAND(F.bitwise_not("old")).alias("mask")).where("mask <> 0")
        frontier = cut_lineage(fresh)
        if frontier.isEmpty():
            break
        found.append(frontier.withColumn("distance", F.lit(hops)))
        seen = seen.unionByName(frontier)
        if hops % COMPACT_EVERY == 0:
            seen = cut_lineage(seen.groupBy(*keys).agg(F.bit_or("mask").alias("mask")))
        if target is not None and not frontier.where(F.col("node") == target).isEmpty():
            break
    out = seeds.where("false").withColumn("distance", F.lit(0))
    for level in found:
        out = out.unionByName(level)
    return out


def per_start(masks: DataFrame, numbered: DataFrame) -> DataFrame:
    """``start, direction, distance, n``: how many nodes each start first reaches at each distance.

    Bits are counted by place on the map side, so what is shuffled is a row for each word, direction, distance and task.
    """
    counts = [F.sum(F.shiftrightunsigned("mask", i).bitwiseAND(F.lit(1))) for i in range(BITS)]
    per_word = masks.groupBy("word", "direction", "distance").agg(F.array(*counts).alias("counts"))
    single = per_word.select("word", "direction", "distance", F.posexplode("counts").alias("bit", "n")).where("n > 0")
    return single.join(numbered, ["word", "bit"]).select("start", "direction", "distance", "n")


def reachable(
    edges: DataFrame,
    starts: DataFrame,
    direction: str = "downstream",
    with_path: bool = False,
    max_hops: int | None = None,
    target: object | None = None,
) -> DataFrame:
    """Nodes reachable from each start: ``start, node, distance`` and optionally a path.

    ``starts`` has one column.  Cycles end by themselves because a seen node never returns;
    a start is not its own descendant.  Among shortest paths the smallest array is kept.
    ``target`` stops the search once that node was reached.
    """
    if with_path:
        return _with_paths(edges, starts, direction, max_hops, target)
    numbered = numbered_starts(starts)
    masks = levels(edges, numbered, [direction], max_hops, target)
    return _unpacked(masks, numbered).select("start", "node", "distance")


def _unpacked(masks: DataFrame, numbered: DataFrame) -> DataFrame:
    """``start, direction, node, distance``, a row for each set bit."""
    places = F.expr(f"filter(sequence(0, {BITS - 1}), i -> getbit(mask, i) = 1)")
    single = masks.select("direction", "node", "word", "distance", F.explode(places).alias("bit"))
    return single.join(numbered, ["word", "bit"]).select("start", "direction", "node", "distance")


def _with_paths(
    edges: DataFrame, starts: DataFrame, direction: str, max_hops: int | None = None, target: object | None = None
) -> DataFrame:
    """The closure with the smallest shortest path of every pair."""
    step = cut_lineage(_oriented(edges, direction))  # read once per round
    first = F.col(starts.columns[0])
    seeds = starts.select(first.alias("start"), first.alias("node"), F.lit(0).alias("distance"), F.array(first).alias("path")).distinct()
    frontier = cut_lineage(seeds)
    seen, hops = frontier, 0
    while max_hops is None or hops < max_hops:
        hops += 1
        grown = frontier.join(step, F.col("node") == F.col("_from"))
        path = F.min(F.concat("path", F.array("_to"))).alias("path")
        fresh = grown.groupBy("start", F.col("_to").alias("node")).agg(F.lit(hops).alias("distance"), path)
        frontier = cut_lineage(fresh.join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if hops % COMPACT_EVERY == 0:
            seen = cut_lineage(seen)
        if target is not None and not frontier.where(F.col("node") == target).isEmpty():
            break
    return seen.where("distance > 0")


def _meeting(step: DataFrame, down: DataFrame, up: DataFrame) -> tuple[list[DataFrame], list[DataFrame], DataFrame] | None:
    """Levels of nodes below one node and above another, widened where the newest has fewer rows until the newest two share nodes.

    No level before had a node in common, so those shared lie on every shortest path.  None if the levels end before.
    """
    levels, seen, sizes = ([down], [up]), [down, up], [down.count(), up.count()]
    while all(sizes):
        middle = levels[0][-1].join(levels[1][-1], "node", "left_semi")
        if not middle.isEmpty():
            return (*levels, middle)
        which = 0 if sizes[0] <= sizes[1] else 1
        near, far = ("src", "dst") if which == 0 else ("dst", "src")
        grown = levels[which][-1].join(step, F.col("node") == F.col(near)).select(F.col(far).alias("node")).distinct()
        fresh = cut_lineage(grown.join(seen[which], "node", "left_anti"))
        levels[which].append(fresh)
        sizes[which] = fresh.count()
        seen[which] = seen[which].unionByName(fresh)
        if len(levels[which]) % COMPACT_EVERY == 0:
            seen[which] = cut_lineage(seen[which])
    return None


def _followed(start: DataFrame, pointers: DataFrame, length: int) -> DataFrame:
    """``place, node`` of the nodes met in ``length`` pointers (``src, dst``) from a node on.

    Pointers are doubled: each round the known part of the way is as long again, so the rounds are the logarithm of the length.
    """
    way, known, jump = start.select(F.lit(0).alias("place"), "node"), 1, pointers
    while known <= length:
        ahead = way.join(jump, F.col("node") == F.col("src")).select((F.col("place") + known).alias("place"), F.col("dst").alias("node"))
        way = cut_lineage(way.unionByName(ahead))
        known *= 2
        if known <= length:
            twice = jump.select("src", F.col("dst").alias("via")).join(jump.toDF("via", "dst"), "via")
            jump = cut_lineage(twice.select("src", "dst"))
    return way


def data_flow(edges: DataFrame, source: object, target: object) -> DataFrame:
    """Edges of the smallest shortest path in order with its length; no rows if unreachable.

    The search goes from both ends and keeps nodes, not paths.  Every node on a shortest path then points to its smallest successor on one,
    and the pointers are followed from the source.
    """
    step = cut_lineage(edges.select("src", "dst").distinct())  # read once per round
    none = step.where("false").select(F.lit(0).alias("path_length"), F.lit(0).alias("step"), "src", "dst")
    first = cut_lineage(step.where(F.col("src") == source).select(F.col("src").alias("node")).limit(1))
    last = cut_lineage(step.where(F.col("dst") == target).select(F.col("dst").alias("node")).limit(1))
    found = _meeting(step, first, last)
    if found is None:
        return none
    down, up, ahead = found
    length = len(down) + len(up) - 2
    if not length:
        return none
    # behind the middle every step to the next level leads on, before it only those into nodes that lead on
    above = up[0].select("node", F.lit(0).alias("left"))
    for left, level in enumerate(up[1:], 1):
        above = above.unionByName(level.select("node", F.lit(left).alias("left")))
    above = cut_lineage(above)
    leading = step.join(above.toDF("src", "left"), "src").join(above.toDF("dst", "left_behind"), "dst")
    smallest = F.min("dst").alias("dst")
    pointers = leading.where("left = left_behind + 1").groupBy("src").agg(smallest)
    for level in reversed(down[:-1]):
        into = step.join(ahead.toDF("dst"), "dst", "left_semi").join(level.toDF("src"), "src", "left_semi")
        taken = cut_lineage(into.groupBy("src").agg(smallest))
        pointers = pointers.unionByName(taken)
        ahead = taken.select(F.col("src").alias("node"))
    way = _followed(first, cut_lineage(pointers), length)
    behind = way.select((F.col("place") - 1).alias("place"), F.col("node").alias("dst"))
    steps = way.withColumnRenamed("node", "src").join(behind, "place")
    return steps.select(F.lit(length).alias("path_length"), (F.col("place") + 1).alias("step"), "src", "dst")


def lineage_depth(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Largest shortest-path distance in either direction (0 for an isolated asset)."""
    numbered = numbered_starts(starts)
    deep = per_start(levels(edges, numbered), numbered).groupBy("start").agg(F.max("distance").alias("d"))
    return numbered.join(deep, "start", "left").select("start", F.coalesce("d", F.lit(0)).alias("lineage_depth"))


def impact_score(edges: DataFrame, starts: DataFrame, assets: DataFrame) -> DataFrame:
    """Descendants plus ancestors as a share of all assets, at most 1."""
    numbered = numbered_starts(starts)
    touched = per_start(levels(edges, numbered), numbered).groupBy("start").agg(F.sum("n").alias("n"))
    total = assets.select(F.count(F.lit(1))).scalar()
    share = F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)), total), F.lit(0.0))
    return numbered.join(touched, "start", "left").select("start", F.least(share, F.lit(1.0)).alias("impact_score"))


def impact_analysis(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Counts and depths of every start in both directions, from the new bits of each round."""
    numbered = numbered_starts(starts)
    down, up = F.col("direction") == "downstream", F.col("direction") == "upstream"
    zero = F.lit(0)
    counted = per_start(levels(edges, numbered), numbered).groupBy("start").agg(
        F.sum(F.when(down, F.col("n")).otherwise(zero)).alias("total_downstream_assets"),
        F.sum(F.when(up, F.col("n")).otherwise(zero)).alias("total_upstream_assets"),
        F.coalesce(F.max(F.when(down, F.col("distance"))), zero).alias("max_downstream_depth"),
        F.coalesce(F.max(F.when(up, F.col("distance"))), zero).alias("max_upstream_depth"),
        F.sum("n").alias("total_impact_score"),
    )
    return numbered.select("start").join(counted, "start", "left").na.fill(0)


def critical_paths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """The closure rows in both directions with a shortest path each, read from the ancestor to the descendant."""
    down = _with_paths(edges, starts, "downstream").withColumn("direction", F.lit("downstream"))
    up = _with_paths(edges, starts, "upstream").withColumn("direction", F.lit("upstream"))
    return down.unionByName(up.withColumn("path", F.reverse("path")))


def graph_export(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge rows in one table, each with the totals."""
    none = F.lit(None)
    nodes = assets.select(
        F.lit("node").alias("kind"),
        F.col("asset_id").cast("string").alias("id"),
        F.col("name").alias("label"),
        F.col("asset_type").alias("type"),
        "owner",
        "quality_score",
        none.cast("string").alias("source"),
        none.cast("string").alias("target"),
    )
    links = edges.select(
        F.lit("edge").alias("kind"),
        F.concat_ws("-", "src", "dst").alias("id"),
        none.cast("string").alias("label"),
        F.lit("direct").alias("type"),
        none.cast("string").alias("owner"),
        none.cast("double").alias("quality_score"),
        F.col("src").cast("string").alias("source"),
        F.col("dst").cast("string").alias("target"),
    )
    n_nodes = assets.select(F.count(F.lit(1))).scalar()
    n_edges = edges.select(F.count(F.lit(1))).scalar()
    return nodes.unionByName(links).withColumns({"total_nodes": n_nodes, "total_edges": n_edges})
