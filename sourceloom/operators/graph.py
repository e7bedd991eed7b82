"""Graph jobs over dependency edges.

All of them are rounds of joins on (repo, path).  What a round no longer needs leaves the
edge table, every round is written to the shared folder, and the write itself counts the rows
that decide whether to go on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.operators import ordered
from sourceloom.session import Workspace

HOPS_PER_ROUND = 2
PLAIN_ROUNDS = 3  # rounds along plain edges before the shortcuts of chains are worked out
ENDLESS = 1 << 40  # steps of a way that goes round a cycle stop here
FEW_WAYS, GROWTH = 4, 4  # open ways of a node that others go through, while there are at most so many times the edges


def simple_edges(edges: DataFrame) -> DataFrame:
    """The edge set: repo, src depends on dst."""
    return edges.select("repo", F.col("source_file").alias("src"), F.col("target_file").alias("dst")).distinct()


def graph_degrees(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges in and out per file, duplicates counted, zeros included."""
    outs = edges.groupBy("repo", F.col("source_file").alias("path")).agg(F.count("*").alias("out_degree"))
    ins = edges.groupBy("repo", F.col("target_file").alias("path")).agg(F.count("*").alias("in_degree"))
    return (
        paths.select("repo", "path")
        .join(outs, ["repo", "path"], "left")
        .join(ins, ["repo", "path"], "left")
        .select(
            "repo", "path",
            F.coalesce("out_degree", F.lit(0)).cast("bigint").alias("out_degree"),
            F.coalesce("in_degree", F.lit(0)).cast("bigint").alias("in_degree"),
        )
    )


def _longest_ways(ws: Workspace, edges: DataFrame) -> DataFrame:
    """Ways to where dependencies end: repo, node, end, steps; ``end`` is null on a way that is at its end, ``steps`` the longest such way.

    A node is settled when all its ways are at their end, and then its longest one is its layer.  Nodes on a cycle or above one are never settled.
    In every round, a way is lengthened by the ways of the node it has come to, so settled stretches and chains double in length.  To keep
    the table from growing, a way stops for a round at a node with more than a few open ways; at least what only has settled nodes below gets
    settled, so a round without gain is the last.
    """
    repo_node = edges.select("repo", F.explode(F.array("src", "dst")).alias("node")).distinct()
    sources = edges.select("repo", F.col("src").alias("node")).distinct()
    ends = repo_node.join(sources, ["repo", "node"], "left_anti").select("repo", "node", F.lit(None).cast("string").alias("end"), F.lit(0).cast("bigint").alias("steps"))
    first = edges.select("repo", F.col("src").alias("node"), F.col("dst").alias("end"), F.lit(1).cast("bigint").alias("steps"))
    ways, seen = ws.save_counted(first.unionAll(ends), going=F.count_if(F.col("end").isNotNull()))
    most, open_before = (seen["going"] or 0) * GROWTH, None
    while seen["going"]:
        degree, counted = ws.save_counted(
            ways.groupBy("repo", "node").agg(F.count_if(F.col("end").isNotNull()).alias("open")), unsettled=F.count_if(F.col("open") > 0))
        if counted["unsettled"] == open_before:
            break
        open_before = counted["unsettled"]
        passable = degree.where(F.col("open") <= (FEW_WAYS if seen["going"] <= most else 1)).select("repo", F.col("node").alias("via"))
        via = ways.select("repo", F.col("node").alias("via"), F.col("end").alias("next"), F.col("steps").alias("more"), F.lit(True).alias("goes")).join(
            passable, ["repo", "via"], "left_semi")
        going = ways.where("end IS NOT NULL").join(via.withColumnRenamed("via", "end"), ["repo", "end"], "left").select(
            "repo", "node", F.when(F.col("goes"), F.col("next")).otherwise(F.col("end")).alias("end"),
            F.least(F.col("steps") + F.coalesce("more", F.lit(0)), F.lit(ENDLESS)).alias("steps"))
        longer = going.unionAll(ways.where("end IS NULL").select("repo", "node", "end", "steps")).groupBy("repo", "node", "end").agg(F.max("steps").alias("steps"))
        old = ways
        ways, seen = ws.save_counted(longer, going=F.count_if(F.col("end").isNotNull()))
        ws.release(old, degree)
    return ways


def topo_layers(ws: Workspace, paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Layer of each file: 0 without dependencies, else one more than its deepest dependency.

    Files on a cycle, or above one, never become free and get NULL.  Rounds grow with the logarithm of the depth where dependencies are
    chains, trees or ladders.
    """
    simple = ws.save(simple_edges(edges))
    ways = _longest_ways(ws, simple)
    # a self-loop never ends either
    settled = ways.groupBy("repo", F.col("node").alias("path")).agg(
        F.when(F.count_if(F.col("end").isNotNull()) == 0, F.max("steps")).alias("layer"), F.lit(True).alias("linked"))
    nodes = paths.select("repo", "path").join(settled, ["repo", "path"], "left")
    return nodes.select("repo", "path", F.when(F.col("linked").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("layer")).alias("layer"))


def order_key(layer: Column, path: Column) -> Column:
    """Sorts files dependencies first, unlayered files last, by path within a layer."""
    return F.struct(F.coalesce(layer, F.lit((1 << 63) - 1)).alias("layer"), path.alias("path"))


def migration_order(ws: Workspace, layers: DataFrame) -> DataFrame:
    """Dense position from 1 in dependency order."""
    by = [F.col("layer").asc_nulls_last(), F.col("path")]
    return ordered.positions(ws, layers, ["repo"], by, "position")


def _unsettled(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(repo, node): nodes from which a cycle can be reached.

    The rounds of ``_longest_ways`` without lengths: a way whose end is settled goes, and with its last way a node is settled, so the table
    shrinks to what leads to cycles.
    """
    ways, seen = ws.save_counted(edges.select("repo", F.col("src").alias("node"), F.col("dst").alias("end")))
    most, open_before = (seen["rows"] or 0) * GROWTH, None
    while seen["rows"]:
        degree, counted = ws.save_counted(ways.groupBy("repo", "node").agg(F.count(F.lit(1)).alias("open")))
        if counted["rows"] == open_before:
            ws.release(degree)
            break
        open_before = counted["rows"]
        passable = F.col("open") <= (FEW_WAYS if seen["rows"] <= most else 1)
        # a node that is not gone through leads to itself
        hops = ways.join(degree, ["repo", "node"]).select(
            "repo", F.col("node").alias("via"), F.when(passable, F.col("end")).otherwise(F.col("node")).alias("next")).distinct()
        onward = ways.join(hops.withColumnRenamed("via", "end"), ["repo", "end"]).select("repo", "node", F.col("next").alias("end")).distinct()
        old = ways
        ways, seen = ws.save_counted(onward)
        ws.release(old, degree)
    return ways.select("repo", "node").distinct()


def _within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return (
        edges.join(nodes.select("repo", F.col("node").alias("src")), ["repo", "src"], "left_semi")
        .join(nodes.select("repo", F.col("node").alias("dst")), ["repo", "dst"], "left_semi")
        .select("repo", "src", "dst")
    )


def cycle_core(ws: Workspace, edges: DataFrame) -> DataFrame:
    """The edges between nodes that lead to a cycle and are led to by one.

    Empty exactly when the graph has no cycle; what is left lies on cycles or between them.
    """
    below, seen = ws.save_counted(_within(edges, _unsettled(ws, edges)))
    if not seen["rows"]:
        return below
    back = below.select("repo", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return ws.save(_within(below, _unsettled(ws, back)))


def with_shortcuts(ws: Workspace, core: DataFrame) -> DataFrame:
    """``core`` with further edges (repo, src, dst, steps) along its chains: over 2, 4, 8, ... nodes that have one way on, or one way in.

    They lead where the chain leads, so nothing becomes reachable that was not, and a chain is crossed in as many hops as the logarithm of its length.
    """
    plain = core.where("src <> dst").select("repo", "src", "dst").distinct()
    found = [core.select("repo", "src", "dst", F.lit(1).cast("bigint").alias("steps"))]
    for end, other in (("src", "dst"), ("dst", "src")):
        one = plain.groupBy("repo", F.col(end).alias("node")).agg(F.min(other).alias("to"), F.count(F.lit(1)).alias("n")).where("n = 1").select("repo", "node", "to")
        jump, seen = ws.save_counted(one)
        most, steps = seen["rows"] or 0, 1
        while seen["rows"] and steps < most:  # no chain has more nodes than there are with one way
            onward = jump.select("repo", F.col("node").alias("to"), F.col("to").alias("far"))
            jump, seen = ws.save_counted(jump.join(onward, ["repo", "to"]).select("repo", "node", F.col("far").alias("to")))
            steps *= 2
            src, dst = ("node", "to") if end == "src" else ("to", "node")
            found.append(jump.select("repo", F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(steps).cast("bigint").alias("steps")))
    return ws.save(reduce(DataFrame.unionAll, found))


class _Reach:
    """Edges (repo, src, dst, steps) to hop along; after a few rounds that were not enough, with the shortcuts of chains."""

    def __init__(self, ws: Workspace, core: DataFrame):
        self.ws, self.core, self.rounds = ws, core, 0
        self.edges, self.extended = core.select("repo", "src", "dst", F.lit(1).cast("bigint").alias("steps")), False

    def next_round(self) -> DataFrame:
        self.rounds += 1
        if self.rounds > PLAIN_ROUNDS and not self.extended:
            self.edges, self.extended = with_shortcuts(self.ws, self.core), True
        return self.edges

    def release(self) -> None:
        if self.extended:
            self.ws.release(self.edges)


def _spread_labels(ws: Workspace, core: DataFrame, turn: int) -> DataFrame:
    """Give each node the label of the node that comes first, in an order drawn anew each turn, among those from which it can be reached."""
    nodes = core.select("repo", F.explode(F.array("src", "dst")).alias("node")).distinct()
    saved = ws.save(nodes.withColumn("label", F.struct(F.xxhash64("node", F.lit(turn)).alias("draw"), F.col("node").alias("root"))))
    reach = _Reach(ws, core)
    while True:
        step, edges = saved.withColumn("old", F.col("label")), reach.next_round()
        for _ in range(HOPS_PER_ROUND):
            sent = edges.join(step.select("repo", F.col("node").alias("src"), "label"), ["repo", "src"]).select(
                "repo", F.col("dst").alias("node"), "label", F.lit(None).cast(step.schema["label"].dataType).alias("old")
            )
            step = (
                step.select("repo", "node", "label", "old").unionAll(sent)
                .groupBy("repo", "node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
            )
        older = saved
        saved, seen = ws.save_counted(step.withColumn("moved", F.col("label") != F.col("old")), changed=F.count_if("moved"))
        ws.release(older)
        if not seen["changed"]:
            reach.release()
            return saved.select("repo", "node", F.col("label.root").alias("label"))


def _members(ws: Workspace, inner: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes that reach the root of their label; ``inner`` holds edges within one label."""
    found, seen = ws.save_counted(labels.filter("node = label"))
    count, reach = -1, _Reach(ws, inner)
    while seen["rows"] != count:
        count, step, edges = seen["rows"], found, reach.next_round()
        for _ in range(HOPS_PER_ROUND):
            # all nodes of an edge have one label
            back = edges.join(step.select("repo", F.col("node").alias("dst"), "label"), ["repo", "dst"]).select("repo", F.col("src").alias("node"), "label")
            step = step.select("repo", "node", "label").unionAll(back).distinct()
        older = found
        found, seen = ws.save_counted(step)
        ws.release(older)
    reach.release()
    return found


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """Strongly connected components that hold a cycle: repo, path, component.

    A component is named by its smallest path.  Each pass draws an order of the nodes; every node takes the first that leads to it, and
    those that lead back to it are a component.  So components that follow one another come off in about as many passes as the logarithm of their number;
    what is left goes into the next pass, without what no longer lies between cycles.
    """
    core = cycle_core(ws, edges)
    results, turn = [], 0
    while not core.isEmpty():
        labels = _spread_labels(ws, core, turn)
        inner = ws.save(
            core.join(labels.select("repo", F.col("node").alias("src"), "label"), ["repo", "src"])
            .join(labels.select("repo", F.col("node").alias("dst"), F.col("label").alias("other")), ["repo", "dst"])
            .filter("label = other").select("repo", "src", "dst")
        )
        members = _members(ws, inner, labels)
        results.append(members)
        gone = members.select("repo", "node")
        rest, seen = ws.save_counted(
            inner.join(gone.withColumnRenamed("node", "src"), ["repo", "src"], "left_anti")
            .join(gone.withColumnRenamed("node", "dst"), ["repo", "dst"], "left_anti")
            .select("repo", "src", "dst")
        )
        ws.release(core, inner)
        core, turn = cycle_core(ws, rest) if seen["rows"] else rest, turn + 1
    if not results:
        return edges.limit(0).select("repo", F.col("src").alias("path"), F.col("dst").alias("component"))
    found = reduce(DataFrame.unionAll, results)
    sized = found.groupBy("repo", "label").agg(F.count("*").alias("size"), F.min("node").alias("component"))
    loops = edges.filter("src = dst").select("repo", F.col("src").alias("node"), F.lit(True).alias("loop"))
    return (
        found.join(sized, ["repo", "label"])
        .join(loops, ["repo", "node"], "left")
        .filter("size > 1 OR loop")
        .select("repo", F.col("node").alias("path"), "component")
    )


def cyclic_files(ws: Workspace, edges: DataFrame) -> DataFrame:
    return components(ws, edges).select("repo", "path")


def has_cycle(ws: Workspace, repos: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per repository."""
    cyclic = _unsettled(ws, edges).select("repo").distinct().withColumn("has_cycle", F.lit(True))
    return (
        repos.select("repo").distinct().join(cyclic, "repo", "left")
        .select("repo", F.coalesce("has_cycle", F.lit(False)).alias("has_cycle"))
    )


def short_cycles(ws: Workspace, edges: DataFrame, longest: int = 3) -> DataFrame:
    """Elementary cycles of at most ``longest`` files, closed and starting at the smallest path.

    Walks stay inside one component and above their start, so each cycle appears once.
    """
    comp = ws.save(components(ws, edges))
    inner = (
        edges.join(comp.select("repo", F.col("path").alias("src"), "component"), ["repo", "src"])
        .join(comp.select("repo", F.col("path").alias("dst"), "component"), ["repo", "dst", "component"])
        .select("repo", "src", "dst")
    )
    inner = ws.save(inner)
    walks = inner.filter("dst >= src").select("repo", F.array("src", "dst").alias("cycle"), F.col("dst").alias("tip"))
    closed = [walks.filter("cycle[0] = tip")]
    walks = walks.filter("cycle[0] < tip")
    hop = inner.select("repo", F.col("src").alias("tip"), F.col("dst").alias("next"))
    for length in range(2, longest + 1):
        stepped = walks.join(hop, ["repo", "tip"])
        closed.append(
            stepped.filter("next = cycle[0]")
            .select("repo", F.array_append("cycle", F.col("next")).alias("cycle"), F.col("next").alias("tip"))
        )
        walks = stepped.filter("next > cycle[0] AND NOT array_contains(cycle, next)").select(
            "repo", F.array_append("cycle", F.col("next")).alias("cycle"), F.col("next").alias("tip")
        )
    return reduce(DataFrame.unionAll, closed).select("repo", "cycle")


def _jumps(ws: Workspace, parents: DataFrame, longest: int) -> list[DataFrame]:
    """Tables (repo, node, to): 1, 2, 4, ... steps up a tree given as (repo, node, to)."""
    tables, steps = [ws.save(parents)], 1
    while 2 * steps <= longest:
        last = tables[-1]
        onward = last.select("repo", F.col("node").alias("to"), F.col("to").alias("far"))
        tables.append(ws.save(last.join(onward, ["repo", "to"]).select("repo", "node", F.col("far").alias("to"))))
        steps *= 2
    return tables


def _ascend(rows: DataFrame, at: str, steps: str, jumps: list[DataFrame]) -> DataFrame:
    """``rows`` with column ``at`` moved up by ``steps``, one power of two after the other."""
    for k, jump in enumerate(jumps):
        moves = F.when(F.getbit(F.col(steps), F.lit(k)) == 1, F.col(at))
        rows = rows.withColumn("_from", moves).join(
            jump.select("repo", F.col("node").alias("_from"), F.col("to").alias("_to")), ["repo", "_from"], "left").withColumn(
            at, F.coalesce("_to", at)).drop("_from", "_to")
    return rows


def back_edge_cycles(ws: Workspace, edges: DataFrame) -> DataFrame:
    """One elementary cycle of any length for each back edge: repo, cycle (closed list of paths), length.

    In every component, a tree of shortest ways starts at the smallest path; a file's parent in it is the smallest one among those a step nearer.  An
    edge that leads to the file itself or to one above it in the tree closes a cycle: the way down the tree to where the edge starts, and back.  Every component has
    one at least, as an edge leads to its first file; there are no more cycles than edges.  Rounds grow with the logarithm of chains.
    """
    comp = ws.save(components(ws, edges))
    inner = ws.save(
        edges.join(comp.select("repo", F.col("path").alias("src"), "component"), ["repo", "src"])
        .join(comp.select("repo", F.col("path").alias("dst"), "component"), ["repo", "dst", "component"])
        .select("repo", "src", "dst")
    )
    reach = _Reach(ws, inner)
    distance = ws.save(comp.select("repo", F.col("path").alias("node"), F.when(F.col("path") == F.col("component"), F.lit(0).cast("bigint")).alias("steps")))
    while True:
        step, hops = distance.withColumn("old", F.col("steps")), reach.next_round()
        for _ in range(HOPS_PER_ROUND):
            sent = hops.join(step.where("steps IS NOT NULL").select("repo", F.col("node").alias("src"), F.col("steps").alias("upto")), ["repo", "src"]).select(
                "repo", F.col("dst").alias("node"), (F.col("upto") + F.col("steps")).alias("steps"), F.lit(None).cast("bigint").alias("old"))
            step = step.unionAll(sent).groupBy("repo", "node").agg(F.min("steps").alias("steps"), F.max("old").alias("old"))
        older = distance
        distance, seen = ws.save_counted(
            step, changed=F.count_if(~F.col("steps").eqNullSafe(F.col("old"))), deepest=F.max("steps"))
        ws.release(older)
        if not seen["changed"]:
            break
    far = lambda end: distance.select("repo", F.col("node").alias(end), F.col("steps").alias(f"{end}_steps"))
    measured = ws.save(inner.join(far("src"), ["repo", "src"]).join(far("dst"), ["repo", "dst"]))
    parents = measured.where("dst_steps = src_steps + 1").groupBy("repo", F.col("dst").alias("node")).agg(F.min("src").alias("to"))
    jumps = _jumps(ws, parents, max(seen["deepest"] or 0, 1))
    upward = measured.where("dst_steps <= src_steps").select(
        "repo", "src", "dst", (F.col("src_steps") - F.col("dst_steps")).alias("up"), F.col("src").alias("above"))
    closing = ws.save(_ascend(upward, "above", "up", jumps).where("above = dst").select("repo", "src", "dst", "up"))
    along = closing.select("repo", "src", "dst", F.col("src").alias("path"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("up"))).alias("back"), "up")
    placed = _ascend(along, "path", "back", jumps)
    listed = placed.groupBy("repo", "src", "dst").agg(
        F.sort_array(F.collect_list(F.struct((F.col("up") - F.col("back")).alias("at"), "path"))).alias("steps"))
    return listed.select("repo", F.array_append(F.col("steps.path"), F.col("dst")).alias("cycle"), F.size("steps").cast("bigint").alias("length"))
