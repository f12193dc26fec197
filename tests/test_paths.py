"""Event paths: clocks, budgets, and exact counts without making the paths."""

from __future__ import annotations

import itertools

from kinetra.operators import network as nw
from kinetra.operators import paths as pt

INSTANCES = "array<struct<species:string,atoms:string>>"
NODES = f"replicate string, event_id string, t long, reaction_key string, status string, reactants array<string>, products array<string>, consumed {INSTANCES}, produced {INSTANCES}, before_timestep long, after_timestep long"


def _nodes(spark, items):
    """Items (replicate, t, consumed, produced) of matched events; instances are (species, atoms)."""
    rows = []
    for i, (rep, t, a, b) in enumerate(items):
        left, right = sorted(s for s, _ in a), sorted(s for s, _ in b)
        rows.append((rep, f"{rep}-{i:03}", t, "+".join(left) + "->" + "+".join(right), "matched", left, right, a, b, 10 * t, 10 * t + 10))
    return spark.createDataFrame(rows, NODES)


def _chain(rep, atoms, steps="ABCD"):
    return [(rep, t, [(a, str(x))], [(b, str(x))]) for x in atoms for t, (a, b) in enumerate(itertools.pairwise(steps))]


def test_three_clocks_of_a_chain(spark):
    nodes = _nodes(spark, _chain("rep1", (0, 1)) + _chain("rep2", (0,)))
    edges = pt.event_edges(nodes)
    paths = pt.event_paths(nodes, edges, 3).cache()
    assert {(tuple(r["gaps"]), tuple(r["idle_gaps"]), tuple(r["anchor_gaps"]), r["complete"]) for r in paths.collect()} == {((1, 1), (0, 0), (10, 10), True)}
    got = {(r["edge"], r["clock"]): (r["n"], r["gap_min"], r["gap_median"], r["gap_mean"], r["gap_max"]) for r in pt.clock_statistics(paths).collect()}
    assert got == {(e, c): (3, v, float(v), float(v), v) for e in (0, 1) for c, v in (("interval", 1), ("idle", 0), ("anchor", 10))}
    details = pt.path_details(paths, edges).collect()
    assert {(r["position"], r["gap"], r["idle_gap"], r["anchor_gap"], tuple(r["carriers"] or ())) for r in details if r["replicate"] == "rep2"} == {(0, None, None, None, ()), (1, 1, 0, 10, ("0",)), (2, 1, 0, 10, ("0",))}
    # The networks of both replicates: A->B, X->B, B->C, C->D, C->Z allow four sequences, of which one occurs.
    one = nw.merge_reactions(spark.createDataFrame([(i, a, b, 1) for i, (a, b) in enumerate([(["A"], ["B"]), (["X"], ["B"]), (["B"], ["C"]), (["C"], ["D"]), (["C"], ["Z"])])], "line_no long, reactants array<string>, products array<string>, tp long"))
    from pyspark.sql import functions as F

    merged = one.select("reaction_key", "reactants", "products", F.explode(F.array(F.lit("rep1"), F.lit("rep2"), F.lit("rep3"))).alias("replicate"))
    rows = {r["replicate"]: r for r in pt.compare_with_network(paths, merged).collect()}
    assert all((rows[r]["n_reachable"], rows[r]["n_actual"], rows[r]["n_confirmed"], rows[r]["n_actual_only"], rows[r]["n_aggregate_only"], rows[r]["realised"]) == (4, 1, 1, 0, 3, 0.25) for r in ("rep1", "rep2"))
    assert (rows["rep3"]["n_reachable"], rows["rep3"]["n_actual"], rows["rep3"]["realised"]) == (4, 0, 0.0)
    few = {r["replicate"]: r for r in pt.compare_with_network(pt.event_paths(nodes, edges, 3, max_paths=1), merged).collect()}
    assert few["rep1"]["actual_is_lower_bound"] and few["rep1"]["realised"] is None and not few["rep2"]["actual_is_lower_bound"]
    assert pt.event_paths(nodes, edges, 3, max_idle=0).count() == 3
    late = nodes.where("reaction_key <> 'B->C'").union(nodes.where("reaction_key = 'B->C'").withColumn("before_timestep", F.lit(15).cast("long")))
    assert pt.event_paths(late, pt.event_edges(late), 3, max_idle=4).count() == 0


def test_a_dense_graph_makes_only_chains_of_atoms(spark):
    """Each event takes all molecules of the last one apart and makes as many new: events in a row share every atom, but paths are few."""
    width, depth = 40, 8
    items = []
    for t in range(depth):
        # Two events a transition, each takes half of the molecules of either event before.
        for half in (0, 1):
            mine = [x for x in range(2 * width) if x // (1 if t == 0 else width) % 2 == half]
            items.append(("r", t, [(f"S{t}", str(x)) for x in mine], [(f"S{t + 1}", str(x)) for x in mine]))
    nodes = _nodes(spark, items)
    edges = pt.event_edges(nodes)
    paths = pt.event_paths(nodes, edges, 6).cache()
    lineages = {tuple(r["event_ids"]): set(r["lineage"]) for r in paths.collect()}
    assert all(lineages.values()) and sum(map(len, lineages.values())) == (depth - 5) * 2 * width
    counts = {r["from_id"]: r["n"] for r in pt.count_paths(nodes, edges, 6).collect()}
    made: dict[str, int] = {}
    for ids, atoms in lineages.items():
        made[ids[0]] = made.get(ids[0], 0) + len(atoms)
    assert counts == made
    few = pt.event_paths(nodes, edges, 6, max_paths=1).collect()
    assert few and not any(r["complete"] for r in few) and {r["event_ids"][0] for r in few} == {"r-000"}
    assert pt.path_signatures(pt.event_paths(nodes, edges, 6, max_paths=1)).first()["support_is_lower_bound"]
    assert not pt.path_signatures(paths).first()["support_is_lower_bound"]


def test_sequences_of_a_dense_network_are_counted_not_made(spark):
    """Every reaction follows on every other: 60 ** 8 sequences, which no one can make."""
    rows = [(i, [f"A{i}", "W"], [f"B{i}", "W"], 1) for i in range(60)]
    merged = nw.merge_reactions(spark.createDataFrame(rows, "line_no long, reactants array<string>, products array<string>, tp long"))
    assert int(pt.count_reachable(merged, 8).first()["n"]) == 60**8
    assert int(pt.count_reachable(merged, 3, "A7").first()["n"]) == 60**2
    keys = sorted(r["reaction_key"] for r in merged.collect())
    got = pt.reachable_with_bridges(merged, 8, max_paths=130).collect()
    want = list(itertools.islice(itertools.product(keys, repeat=8), 130))
    assert sorted(tuple(r["reaction_keys"]) for r in got) == want and all(r["truncated"] and r["bridges"] == [["W"] * 7] for r in got)
