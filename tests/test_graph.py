import random

from sourceloom.operators import graph


def edge_rows(spark, pairs):
    rows = [("r", a, b, "x", i, 1) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(
        rows, "repo string, source_file string, target_file string, import_statement string, pattern_no int, match_no int"
    )


def brute(pairs):
    nodes = {n for p in pairs for n in p}
    out = {n: {b for a, b in pairs if a == n} for n in nodes}

    def reached(n):
        seen, todo = set(), list(out[n])
        while todo:
            m = todo.pop()
            if m not in seen:
                seen.add(m)
                todo += out[m]
        return seen

    reach = {n: reached(n) for n in nodes}
    comp = {n: min(m for m in reach[n] if n in reach[m]) for n in nodes if n in reach[n]}
    layer = {}
    while True:
        ready = {n for n in nodes - set(layer) if out[n] <= set(layer)}
        if not ready:
            break
        layer.update({n: 1 + max((layer[m] for m in out[n]), default=-1) for n in ready})
    return comp, layer


def test_components_and_layers_match_brute_force(spark, ws):
    rng = random.Random(5)
    # two random parts, a ring, a chain into it, a self-loop, a doubled edge
    pairs = [(f"a{rng.randrange(9)}", f"a{rng.randrange(9)}") for _ in range(10)]
    pairs += [(f"b{rng.randrange(12)}", f"b{rng.randrange(12)}") for _ in range(14)]
    pairs += [(f"ring{i}", f"ring{(i + 1) % 5}") for i in range(5)]
    pairs += [("top", "mid"), ("mid", "ring0"), ("self", "self"), ("z2", "z1"), ("z2", "z1"), ("z1", "z0")]
    edges = edge_rows(spark, pairs)
    comp, layer = brute(set(pairs))
    found = {r.path: r.component for r in graph.components(ws, graph.simple_edges(edges)).collect()}
    assert found == comp
    nodes = spark.createDataFrame([("r", n) for n in {n for p in pairs for n in p}], "repo string, path string")
    layers = {r.path: r.layer for r in graph.topo_layers(ws, nodes, edges).collect()}
    assert {k: v for k, v in layers.items() if v is not None} == layer


def test_short_cycles(spark, ws):
    pairs = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("d", "d"), ("c", "b")]
    cycles = graph.short_cycles(ws, graph.simple_edges(edge_rows(spark, pairs)), 3)
    assert sorted(r.cycle for r in cycles.collect()) == [
        ["a", "b", "a"], ["a", "b", "c", "a"], ["b", "c", "b"], ["d", "d"],
    ]


def test_no_edges(spark, ws):
    edges = edge_rows(spark, [("a", "b")]).limit(0)
    nodes = spark.createDataFrame([("r", "a")], "repo string, path string")
    assert graph.components(ws, graph.simple_edges(edges)).count() == 0
    assert [(r.path, r.layer) for r in graph.topo_layers(ws, nodes, edges).collect()] == [("a", 0)]
    assert graph.has_cycle(ws, nodes, graph.simple_edges(edges)).head().has_cycle is False


def test_degrees_count_duplicates(spark):
    edges = edge_rows(spark, [("a", "b"), ("a", "b"), ("b", "b")])
    nodes = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "c")], "repo string, path string")
    found = {r.path: (r.out_degree, r.in_degree) for r in graph.graph_degrees(nodes, edges).collect()}
    assert found == {"a": (2, 0), "b": (1, 3), "c": (0, 0)}


def counted(ws):
    """How often the workspace has saved a table."""
    return ws._saved


def shuffled_names(n, seed):
    names = [f"n{k:05d}" for k in range(n)]
    random.Random(seed).shuffle(names)
    return names


def layers_of(spark, ws, pairs):
    nodes = spark.createDataFrame([("r", n) for n in {n for p in pairs for n in p}], "repo string, path string")
    return {r.path: r.layer for r in graph.topo_layers(ws, nodes, edge_rows(spark, pairs)).collect()}


def test_long_chain_is_layered_in_few_rounds(spark, ws):
    names = shuffled_names(2000, 1)
    layers = layers_of(spark, ws, list(zip(names, names[1:])))
    assert layers == {name: 1999 - k for k, name in enumerate(names)}
    # two tables a round, the edges and the first ways
    assert (counted(ws) - 2) / 2 <= 15


def test_ladder_tree_and_random_graph_are_layered(spark, ws):
    ladder = [(f"l{k}{a}", f"l{k + 1}{b}") for k in range(100) for a in "xy" for b in "xy"]
    assert (layers_of(spark, ws, ladder)["l0x"], (counted(ws) - 2) // 2 <= 12) == (100, True)
    rng = random.Random(9)
    pairs = [(f"d{a}", f"d{b}") for a, b in (sorted(rng.sample(range(120), 2)) for _ in range(500))]
    pairs += [(f"d{rng.randrange(120)}", f"t{k}") for k in range(40)] + [("c1", "c2"), ("c2", "c1"), ("above", "c1"), ("d3", "c1"), ("me", "me")]
    _, layer = brute(pairs)
    assert {k: v for k, v in layers_of(spark, ws, pairs).items() if v is not None} == layer


def test_long_ring_with_a_long_tail_is_one_component(spark, ws):
    names = shuffled_names(600, 2)
    ring, tail = names[:300], names[300:]
    pairs = list(zip(ring, ring[1:] + ring[:1])) + list(zip(tail, tail[1:])) + [(tail[-1], ring[0])]
    edges = graph.simple_edges(edge_rows(spark, pairs))
    found = {r.path: r.component for r in graph.components(ws, edges).collect()}
    assert found == dict.fromkeys(ring, min(ring))
    assert counted(ws) < 120


def test_rings_in_a_row_come_off_in_few_passes(spark, ws):
    rings = [[f"r{k:03d}-{j}" for j in range(3)] for k in range(12)]
    pairs = [(a, b) for r in rings for a, b in zip(r, r[1:] + r[:1])] + [(a[1], b[2]) for a, b in zip(rings, rings[1:])]
    found = {r.path: r.component for r in graph.components(ws, graph.simple_edges(edge_rows(spark, pairs))).collect()}
    assert found == {n: r[0] for r in rings for n in r}


def test_cycles_of_any_length(spark, ws):
    rng = random.Random(4)
    ring = [f"a{k:02d}" for k in range(60)]
    pairs = list(zip(ring, ring[1:] + ring[:1])) + [(ring[40], ring[7]), (ring[9], ring[30]), ("self", "self"), ("x", "y"), ("y", "x"), ("y", "z")]
    pairs += [(f"m{rng.randrange(25)}", f"m{rng.randrange(25)}") for _ in range(60)]
    edges = set(pairs)
    comp, _ = brute(edges)
    rows = graph.back_edge_cycles(ws, graph.simple_edges(edge_rows(spark, pairs))).collect()
    assert len(rows) <= len(edges) and len({tuple(r.cycle) for r in rows}) == len(rows)
    for r in rows:
        assert r.cycle[0] == r.cycle[-1] and len(set(r.cycle)) == len(r.cycle) - 1 == r.length
        assert all(e in edges for e in zip(r.cycle, r.cycle[1:])) and len({comp[n] for n in r.cycle}) == 1
    assert {comp[r.cycle[0]] for r in rows} == set(comp.values())
    assert sorted(tuple(r.cycle) for r in rows) == sorted(slow_cycles(edges, comp))
    assert max(r.length for r in rows) >= 34


def slow_cycles(edges, comp):
    """Back edges of the tree of shortest ways, one component after the other."""
    out = []
    for root in set(comp.values()):
        inner = {(a, b) for a, b in edges if comp.get(a) == comp.get(b) == root}
        depth, ring = {root: 0}, [root]
        while ring:
            ring = sorted({b for a, b in inner if a in ring and b not in depth})
            depth.update({b: max(depth.values()) + 1 for b in ring})
        parent = {b: min(a for a, c in inner if c == b and depth[a] == depth[b] - 1) for b in depth if b != root}
        for a, b in inner:
            way = [a]
            while way[-1] != b and way[-1] in parent:
                way.append(parent[way[-1]])
            if way[-1] == b:
                out.append((*reversed(way), b))
    return out
