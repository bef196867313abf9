"""Graphs as edge tables: families, dependency levels, components, clusters, menu trees.

Loops run over rounds, never over rows.  Every round is written to the checkpoint
folder, so lost executors only cost the current round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.plans import ordered
from tracewell.plans.lineage import settle

MAX_DOUBLINGS = 64


def roots(nodes: DataFrame) -> DataFrame:
    """Root and depth of every node of a forest of (id, parent) rows.

    Pointer doubling: the distance bridged doubles each round, so a chain of n nodes
    takes log2(n) rounds.  A parent that is no node counts as none; nodes on or below
    a cycle get no root.
    """
    known = nodes.select(F.col("id").alias("pid"))
    state = settle(
        nodes.join(known, nodes["parent"] == known["pid"], "left").select(
            "id", F.coalesce("pid", "id").alias("up"), F.when(F.col("pid").isNotNull(), 1).otherwise(0).cast("long").alias("depth")
        )
    )
    total = nodes.count()
    for _ in range(MAX_DOUBLINGS):
        above = state.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        state2 = settle(
            state.join(above, "up").select(
                "id", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("up") != F.col("up2")).alias("moved")
            )
        )
        state = state2.drop("moved")
        shallowest = state2.where("moved").agg(F.min("depth")).first()[0]
        # only nodes of a cycle can still move once they have come further than there are nodes
        if shallowest is None or shallowest > total:
            break
    tops = nodes.join(known, nodes["parent"] == known["pid"], "left_anti").select(F.col("id").alias("root"))
    return state.join(tops, state["up"] == tops["root"], "left").select(
        "id", "root", F.when(F.col("root").isNotNull(), F.col("depth")).alias("depth")
    )


def families(runs: DataFrame) -> DataFrame:
    """Family of every run: root through the parents, depth, and number of members."""
    placed = roots(runs.select(F.col("run_id").alias("id"), F.col("parent_run_id").alias("parent")))
    sizes = placed.groupBy("root").agg(F.count(F.lit(1)).alias("family_size"))
    return placed.join(sizes, "root", "left").select(
        F.col("id").alias("run_id"), F.col("root").alias("root_run_id"), "depth", "family_size"
    )


def _none(rows: DataFrame) -> bool:
    return rows.limit(1).count() == 0


def _through(links: DataFrame) -> DataFrame:
    """(node, to, dist, inner): where the chain that begins at each node leads, and how far that is.

    ``links``: node, next, inner (whether next is a node of a chain itself).  Pointer doubling, so a
    chain of n nodes takes log2(n) rounds; ``inner`` stays true on rings, which lead nowhere else.
    """
    state = settle(links.select("node", F.col("next").alias("to"), F.lit(1).cast("long").alias("dist"), "inner"))
    total = state.count()
    while True:
        nearest = state.where("inner").agg(F.min("dist")).first()[0]
        # only nodes of a ring can still move once they have come further than there are nodes
        if nearest is None or nearest > total:
            return state
        ahead = state.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("dist").alias("dist2"), F.col("inner").alias("inner2"))
        state = settle(
            state.join(ahead, "to", "left").select(
                "node", F.coalesce("to2", "to").alias("to"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"),
                F.coalesce("inner2", F.lit(False)).alias("inner"),
            )
        )


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components, named by their largest node.

    Colours are pushed forward until every node has the largest one that reaches it; the nodes of a
    colour that reach its first node are a component.  They are taken out and the rest goes on.
    """
    left = settle(nodes.select("node").distinct())
    links = settle(edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct())
    out = None
    while not _none(left):
        colour = settle(left.select("node", F.col("node").alias("colour")))
        while True:
            pushed = links.join(colour, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("got"))
            new = settle(
                colour.join(pushed, "node", "left").select(
                    "node", F.greatest("colour", "got").alias("colour"), F.coalesce(F.col("got") > F.col("colour"), F.lit(False)).alias("moved")
                )
            )
            colour = new.drop("moved")
            if _none(new.where("moved")):
                break
        ends = [colour.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_colour")) for end in ("src", "dst")]
        inner = settle(links.join(ends[0], "src").join(ends[1], "dst").where(F.col("src_colour") == F.col("dst_colour")).select("src", "dst"))
        found = settle(colour.where(F.col("node") == F.col("colour")))
        fresh = found
        while not _none(fresh):
            back = inner.join(fresh.select(F.col("node").alias("dst"), "colour"), "dst").select(F.col("src").alias("node"), "colour").distinct()
            fresh = settle(back.join(found, "node", "left_anti"))
            found = settle(found.unionByName(fresh))
        part = found.select("node", F.col("colour").alias("component"))
        out = part if out is None else out.unionByName(part)
        left = settle(left.join(found, "node", "left_anti"))
        gone = found.select(F.col("node").alias("gone"))
        links = links.join(gone, F.col("src") == F.col("gone"), "left_anti")
        links = settle(links.join(gone, F.col("dst") == F.col("gone"), "left_anti"))
    return out if out is not None else left.withColumn("component", F.col("node"))


def _peeled(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Longest distances of the nodes that need no cycle, then the nodes and edges that are left.

    ``edges``: src, dst, len.  One round per level of the nodes.
    """
    left = settle(nodes.select("node", F.lit(0).cast("long").alias("level")))
    links, placed = settle(edges), []
    while True:
        ready = settle(left.join(links.select(F.col("src").alias("node")), "node", "left_anti"))
        if _none(ready):
            break
        placed.append(ready)
        far = links.join(ready.select(F.col("node").alias("dst"), F.col("level").alias("at")), "dst").groupBy(F.col("src").alias("node"))
        far = far.agg(F.max(F.col("at") + F.col("len")).alias("far"))
        left = left.join(ready, "node", "left_anti").join(far, "node", "left")
        left = settle(left.select("node", F.greatest("level", "far").alias("level")))
        links = settle(links.join(ready.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst", "len"))
    levels = left.limit(0)
    for part in placed:
        levels = levels.unionByName(part)
    return levels, left.select("node"), links


def dependency_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level, in_cycle): level 0 without dependencies, else one above the highest dependency.

    ``edges`` are (src, dst): src needs dst.  A node on a cycle or that needs one has no level;
    ``in_cycle`` tells the members of a cycle from those that only need one.  A node that needs
    itself is not counted as a cycle.

    Chains (nodes with one dependency and one dependent) are drawn together to one edge by pointer
    doubling first, so rounds grow with the branching depth and the logarithm of the chains.  Of
    what has no level, nodes that nothing left needs are taken off, and strongly connected
    components are sought in the rest.
    """
    nodes = settle(nodes.select("node").distinct())
    clean = edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct()
    for end in ("src", "dst"):
        clean = clean.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
    clean = settle(clean)
    one_out = clean.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("node")
    one_in = clean.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("node")
    simple = settle(one_out.join(one_in, "node"))

    def led(here: str, there: str) -> DataFrame:
        marked = simple.select(F.col("node").alias(there), F.lit(True).alias("inner"))
        own = clean.join(simple.select(F.col("node").alias(here)), here).join(marked, there, "left")
        return _through(own.select(F.col(here).alias("node"), F.col(there).alias("next"), F.coalesce("inner", F.lit(False)).alias("inner")))

    ahead, behind = led("src", "dst"), led("dst", "src")
    rings = ahead.where("inner").select("node")
    hubs = settle(nodes.join(simple, "node", "left_anti"))
    ends = ahead.where(~F.col("inner")).select(F.col("node").alias("dst"), "to", "dist")
    drawn = clean.join(hubs.select(F.col("node").alias("src")), "src").join(ends, "dst", "left")
    drawn = drawn.select("src", F.coalesce("to", "dst").alias("dst"), (F.lit(1) + F.coalesce("dist", F.lit(0))).alias("len"))
    drawn = settle(drawn.groupBy("src", "dst").agg(F.max("len").alias("len")))

    levels, left, links = _peeled(hubs, drawn)
    while True:  # nodes that nothing left needs are on no cycle
        kept = settle(left.join(links.select(F.col("dst").alias("node")), "node", "left_semi"))
        fewer = settle(links.join(kept.select(F.col("node").alias("src")), "src", "left_semi"))
        stable = _none(left.join(kept, "node", "left_anti"))
        left, links = kept, fewer
        if stable:
            break
    strong = settle(strong_components(left, links))
    loops = links.where(F.col("src") == F.col("dst")).select(F.col("src").alias("node"))
    several = strong.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    cyclic = settle(strong.join(several, "component", "left_semi").select("node", "component").unionByName(
        strong.join(loops, "node", "left_semi").join(several, "component", "left_anti").select("node", "component")
    ))

    yes, no = F.lit(True), F.lit(False)
    of_hubs = hubs.join(levels, "node", "left").join(cyclic.select("node", yes.alias("c")), "node", "left")
    of_hubs = of_hubs.select("node", "level", F.coalesce("c", no).alias("in_cycle"))
    chained = ahead.where(~F.col("inner")).select("node", F.col("to").alias("end"), "dist")
    chained = chained.join(behind.select("node", F.col("to").alias("start")), "node")
    chained = chained.join(levels.select(F.col("node").alias("end"), "level"), "end", "left")
    for end in ("start", "end"):
        chained = chained.join(cyclic.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part")), end, "left")
    on_cycle = F.coalesce(F.col("start_part") == F.col("end_part"), no)
    of_chains = chained.select("node", (F.col("level") + F.col("dist")).alias("level"), on_cycle.alias("in_cycle"))
    of_rings = rings.select("node", F.lit(None).cast("long").alias("level"), yes.alias("in_cycle"))
    return of_hubs.unionByName(of_chains).unionByName(of_rings)


def dependency_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Level of every node: 0 without dependencies, else one above its highest dependency, null on a
    cycle or above one.  ``edges`` are (src, dst): src needs dst."""
    return dependency_order(nodes, edges).select("node", "level")


def generation_plan(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Level, root / leaf marks, cycle marks and suggested rows per entity.

    ``in_cycle`` marks members of a cycle, ``blocked`` these and what needs one.

    ``nodes``: node, storage_type.  Masters get 200 rows, dependent entities 100, file
    based ones 150.
    """
    clean = edges.where(F.col("src") != F.col("dst"))
    needs = clean.select(F.col("src").alias("node")).distinct().withColumn("needs", F.lit(True))
    needed = clean.select(F.col("dst").alias("node")).distinct().withColumn("needed", F.lit(True))
    levels = dependency_order(nodes, edges)
    root = F.col("needs").isNull()
    return (
        nodes.join(levels, "node")
        .join(needs, "node", "left")
        .join(needed, "node", "left")
        .select(
            "node", "level", "in_cycle", F.col("level").isNull().alias("blocked"), root.alias("is_root"),
            F.col("needed").isNull().alias("is_leaf"),
            F.when(root, 200).when(F.col("storage_type").isin("isam", "recital"), 150).otherwise(100).alias("suggested_rows"),
        )
    )


def _edge_state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected component of every node, named by its smallest node.

    Large-star / small-star: each round only looks up minima by node, so a hub's
    neighbours are never gathered, and the number of rounds is logarithmic.
    """
    pairs = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).where(F.col("u") != F.col("v"))
    star = settle(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _edge_state(star)
    while True:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        large = large.where(F.col("u") != F.col("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        star = settle(small.where(F.col("u") != F.col("v")).distinct())
        now = _edge_state(star)
        if now == before:
            break
        before = now
    return nodes.select("node").distinct().join(star.select(F.col("u").alias("node"), "v"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("component")
    )


def flows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Components of two and more nodes with their size and number of dependencies per node."""
    placed = components(nodes, edges)
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= 2)
    needs = edges.where(F.col("src") != F.col("dst")).distinct().groupBy(F.col("src").alias("node")).agg(
        F.count(F.lit(1)).alias("dependencies")
    )
    return (
        placed.join(sizes, "component")
        .join(needs, "node", "left")
        .select("component", "size", "node", F.coalesce("dependencies", F.lit(0)).cast("long").alias("dependencies"))
    )


def name_prefix(name: Column) -> Column:
    """Module part of an entity name: letters up to a digit, else the first four characters."""
    low = F.lower(name)
    part = F.rtrim(F.regexp_extract(low, r"^([a-z_]+?)(?:_?\d|$)", 1), F.lit("_"))
    return F.when(F.length(part) >= 2, part).otherwise(F.substring(low, 1, 4))


def name_clusters(nodes: DataFrame, edges: DataFrame, small: int = 5) -> DataFrame:
    """Clusters by name prefix; a cluster below ``small`` joins the largest one it depends on."""
    prefixed = nodes.select("node", name_prefix(F.col("node")).alias("prefix"))
    sizes = prefixed.groupBy("prefix").agg(F.count(F.lit(1)).alias("size"))
    sized = prefixed.join(sizes, "prefix")
    targets = sized.where(F.col("size") >= small).select(
        F.col("node").alias("dst"), F.col("prefix").alias("to_prefix"), F.col("size").alias("to_size")
    )
    best = (
        sized.where(F.col("size") < small)
        .select(F.col("node").alias("src"), "prefix")
        .join(edges.select("src", "dst").distinct(), "src")
        .join(targets, "dst")
        .groupBy("prefix")
        .agg(F.min_by("to_prefix", F.struct(-F.col("to_size"), F.col("to_prefix"))).alias("to_prefix"))
    )
    return prefixed.join(best, "prefix", "left").select("node", F.coalesce("to_prefix", "prefix").alias("cluster"))


def edge_roles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Root (needs nobody), leaf (needed by nobody) and orphan marks."""
    clean = edges.where(F.col("src") != F.col("dst"))
    needs = clean.select(F.col("src").alias("node")).distinct().withColumn("needs", F.lit(True))
    needed = clean.select(F.col("dst").alias("node")).distinct().withColumn("needed", F.lit(True))
    marked = nodes.join(needs, "node", "left").join(needed, "node", "left")
    root, leaf = F.col("needs").isNull(), F.col("needed").isNull()
    return marked.select("node", root.alias("is_root"), leaf.alias("is_leaf"), (root & leaf).alias("is_orphan"))


def edge_rules(edges: DataFrame) -> DataFrame:
    """One rule per edge: the source needs the target."""
    clean = edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct()
    text = F.concat(F.lit("'"), "src", F.lit("' referencia/depende de '"), "dst", F.lit("'"))
    return clean.select(F.col("dst").alias("depends_on"), F.col("src").alias("enables"), text.alias("description"))


def menu_parents(menus: DataFrame, calls: DataFrame) -> DataFrame:
    """Parent of each menu: the deepest menu that calls it, else its route prefix in the module.

    ``menus``: menu_id, stem, module, route (dotted).  ``calls``: menu_id, called.
    Of the callers of a stem only the two best are kept, so a popular stem pairs with
    two rows (two, because a menu does not count as its own caller).
    """
    depth = F.size(F.filter(F.split("route", r"[.\-]"), lambda x: x != ""))
    sized = menus.withColumn("route_depth", depth)
    callers = calls.select("menu_id", F.upper("called").alias("called")).distinct().join(
        sized.select("menu_id", "route_depth"), "menu_id"
    ).withColumn("minus_depth", -F.col("route_depth"))
    ranked = ordered.scan(callers, ["called"], ["minus_depth", "menu_id"], place=ordered.row_number())
    best = ranked.where(F.col("place") <= 2).select(F.col("called").alias("stem"), F.col("menu_id").alias("caller"), "place")
    explicit = (
        menus.select("menu_id", F.upper("stem").alias("stem"))
        .join(best, "stem")
        .where(F.col("caller") != F.col("menu_id"))
        .groupBy("menu_id")
        .agg(F.min_by("caller", "place").alias("caller"))
    )
    steps = F.filter(F.split(F.lower("route"), r"[.\-]"), lambda x: x != "")
    prefixes = F.when(
        F.size(steps) > 1,
        F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, F.lit(1), n), ".")),
    ).otherwise(F.array().cast("array<string>"))
    wanted = menus.select("menu_id", "module", F.explode(F.array_union(prefixes, F.array(F.lit("0")))).alias("prefix"))
    by_route = sized.where(F.col("route") != "").select(
        F.array_join(steps, ".").alias("prefix"), "module", F.col("menu_id").alias("above"), "route_depth"
    )
    rank = F.struct(
        F.when(F.col("prefix") == "0", 0).otherwise(1), F.col("route_depth"), F.col("above")
    )
    by_prefix = (
        wanted.join(by_route, ["module", "prefix"])
        .where(F.col("above") != F.col("menu_id"))
        .groupBy("menu_id")
        .agg(F.max_by("above", rank).alias("above"))
    )
    return menus.select("menu_id").join(explicit, "menu_id", "left").join(by_prefix, "menu_id", "left").select(
        "menu_id", F.coalesce("caller", "above").alias("parent_id"),
        F.when(F.col("caller").isNotNull(), "call").when(F.col("above").isNotNull(), "route").otherwise("root").alias("link"),
    )


def unreached(inventory: DataFrame, calls: DataFrame) -> DataFrame:
    """Programs of the inventory that no menu calls."""
    return inventory.join(calls.select(F.upper("called").alias("program")).distinct(), "program", "left_anti")
