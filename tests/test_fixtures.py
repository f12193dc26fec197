"""The literal cases of FIXTURES.md."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from kinetra.functions.reactions import contains_terms, multiset_minus, net_key, radical_class, reaction_key, split_terms, stable_id
from kinetra.functions.species import formula_counts, hill_formula, species_dim
from kinetra.operators import abundance as ab
from kinetra.operators import network as nw
from kinetra.operators import occurrences as oc
from kinetra.operators import paths as pt
from kinetra.operators import replicates as rp
from kinetra.operators import space as sp

P = "[H][O][C]1[C]([H])=[C]([H])[C]([H])=[C]([H])[C]=1[Cl]"


def _reactions(spark, *items):
    """Items 'tp A+B->C'."""
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "line_no long, x string")
    sides = F.split(F.substring_index("x", " ", -1), "->")
    return df.select("line_no", split_terms(sides[0]).alias("reactants"), split_terms(sides[1]).alias("products"), F.substring_index("x", " ", 1).cast("long").alias("tp"))


def _abundance(spark, frames):
    return spark.createDataFrame([(t, s, n) for t, row in frames.items() for s, n in row.items()], "timestep long, smiles string, count long")


def _one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_columns(spark):
    a = lambda *x: F.array(*[F.lit(i) for i in x])
    assert _one(spark, split_terms(F.lit("[H+]+[O-] + [C]"))) == ["[H+]", "[O-]", "[C]"]
    assert _one(spark, reaction_key(a("b", "a"), a("c"))) == "a+b->c"
    assert _one(spark, net_key(a("x", "a", "a"), a("a", "b"))) == "a+x->b"
    assert _one(spark, multiset_minus(a("a", "a", "b"), a("a"))) == ["a", "b"]
    assert _one(spark, multiset_minus(a("a"), a("b"))) == ["a"]
    assert _one(spark, contains_terms(a("a", "a"), {"a": 2})) and not _one(spark, contains_terms(a("a"), {"a": 2}))
    assert _one(spark, F.to_json(formula_counts(F.lit("C2H5ClC")))) == '{"C":3,"Cl":1,"H":5}'
    assert len(_one(spark, stable_id(F.lit("a"), F.lit(1)))) == 16
    assert _one(spark, radical_class(a("C6H5O", "O2"), a("C6H5O3"), "C6H5O")) == "oxidation"
    assert _one(spark, radical_class(a("C6H5O"), a("C5H5", "CO"), "C6H5O")) == "fragmentation"
    assert _one(spark, radical_class(a("C6H5O", "HCl"), a("C6H6O", "Cl"), "C6H5O")) == "hydrogen transfer"


def test_species_dimension(spark):
    rows = {r["smiles"]: r for r in species_dim(spark.createDataFrame([(P,), ("[H][Cl]",), ("[U]",)], "smiles string")).collect()}
    assert rows[P]["formula"] == "C6H5ClO" and rows[P]["has_ring"] and rows[P]["n_heavy"] == 8
    assert rows["[H][Cl]"]["nominal_mass"] == 36 and math.isclose(rows["[H][Cl]"]["exact_mass"], 35.97667771423)
    assert rows["[U]"]["exact_mass"] is None and rows["[U]"]["nominal_mass"] is None
    assert _one(spark, hill_formula(formula_counts(F.lit("OH4C")))) == "CH4O"


def test_net(spark):
    merged = nw.merge_reactions(_reactions(spark, "6 [C]+[O]->[C][O]", "4 [O]+[C]->[C][O]", "4 [C][O]->[C]+[O]"))
    rows = {r["reaction_key"]: r for r in nw.with_reverse(merged).collect()}
    assert rows["[C]+[O]->[C][O]"]["net_tp"] == 6 and rows["[C]+[O]->[C][O]"]["reactants"] == ["[O]", "[C]"]
    stats = {r["species"]: r for r in nw.species_stats(merged).collect()}["[C][O]"]
    assert (stats["tp_produce"], stats["tp_consume"]) == (10, 4)
    twice = {r["species"]: r for r in nw.species_stats(_merged(spark, "5 [A]+[A]->[B]")).collect()}["[A]"]
    assert (twice["tp_consume"], twice["n_consume"]) == (10, 2)


def _merged(spark, *items):
    return nw.merge_reactions(_reactions(spark, *items))


def test_abundance(spark):
    a = _abundance(spark, {0: {P: 8, "[O]=[O]": 52}, 100: {P: 6, "[O]=[O]": 48, "[C][O]": 2, "[H][Cl]": 1}, 200: {"[O]=[C]=[O]": 4, "[C][O]": 3, "[H][Cl]": 5, "[C][C][O]": 2}})
    dim = species_dim(a)
    by_c = {(r["timestep"], r["group_count"]): r["count"] for r in ab.element_distribution(a, dim, "C", max_count=6).collect()}
    assert by_c[0, 6] == 8 and by_c[200, 1] == 7 and (0, 0) not in by_c
    series = ab.dense_series(a, spark.createDataFrame([(P,)], "smiles string")).orderBy("timestep").collect()
    assert [r["count"] for r in series] == [8, 6, 0]
    summary = {r["smiles"]: r for r in ab.species_summary(a).collect()}
    assert summary["[O]=[C]=[O]"]["peak_count"] == 4 and summary["[C][O]"]["peak_timestep"] == 200
    assert summary[P]["start_count"] == 8 and summary[P]["end_count"] == 0 and summary[P]["fwhm_frames"] == 2
    assert {r["element"] for r in dim.select(F.explode(F.map_keys("atom_counts")).alias("element")).distinct().collect()} == {"C", "H", "O", "Cl"}


def test_zero_groups(spark):
    a = _abundance(spark, {0: {"[N]#[N]": 2, "[S]": 3, "[N][S]": 4}, 10: {"[N]#[N]": 1, "[S]": 5, "[N][S]": 6}})
    rows = ab.element_distribution(a, species_dim(a), "N", present=("S",), include_zero=True).collect()
    assert {tuple(r) for r in rows} == {(0, 0, 3), (0, 1, 4), (10, 0, 5), (10, 1, 6)}
    with pytest.raises(ValueError):
        ab.element_distribution(a, species_dim(a), "N", ranges={"N": (3, 1)})


def test_time(spark):
    a = _abundance(spark, {5: {"C": 0}, 10: {"C": 2}, 30: {"C": 9}})
    assert ab.timeline_summary(a).first()["uniform_step"] is None
    assert ab.change_frames(a).first()["peak_timestep"] == 30
    w = a.select("smiles", "timestep", ab.moving_average(F.col("count"), ("smiles",), "timestep", 3).alias("m"), ab.normalise(F.col("count"), ("smiles",), "timestep", "first").alias("n")).orderBy("timestep").collect()
    assert [r["m"] for r in w] == [1.0, 11 / 3, 5.5] and [r["n"] for r in w] == [0, 0, 0]


def _associate(spark, events, molecules):
    e = spark.createDataFrame([("d", t, i, r, p) for i, (t, r, p) in enumerate(events)], "dataset string, transition long, source_row long, reactants array<string>, products array<string>")
    m = spark.createDataFrame([("d", f, s, a) for f, s, a in molecules], "dataset string, frame long, species string, atom_ids array<bigint>")
    return oc.associate(e, m).orderBy("source_row").collect()


def test_association(spark):
    rows = _associate(spark, [(0, ["[H]", "[O]"], ["[H][O]"]), (0, ["[O]", "[H]"], ["[H][O]"])], [(0, "[H]", [1]), (0, "[O]", [2]), (1, "[H][O]", [1, 2]), (2, "[H][O]", [1, 2])])
    assert [(r["reaction_key"], r["status"], r["atom_ids"]) for r in rows] == [("[H]+[O]->[H][O]", "matched", [1, 2]), ("[H]+[O]->[H][O]", "unresolved", None)]


def test_association_with_spectator(spark):
    big = "[H][C]([H])[O]"
    rows = _associate(spark, [(0, [big], ["[C]", "[H][O][H]"])], [(0, "[H]", [1]), (0, big, [2, 3, 4, 5]), (1, "[C]", [2]), (1, "[H]", [3]), (1, "[H][O][H]", [1, 4, 5])])
    assert rows[0]["status"] == "matched" and rows[0]["atom_ids"] == [1, 2, 3, 4, 5]


def test_long_chains_are_one_component(spark):
    rows = []
    for d, name in (("rising", lambda i: f"{i:04d}"), ("mixed", lambda i: f"{i * 7919 % 1000:04d}")):
        for i in range(260):  # a product shares an atom with each of two reactants
            rows += [(d, 0, f"R{name(i)}", [2 * i, 2 * i + 1]), (d, 1, f"P{name(i)}", [2 * i + 1, 2 * i + 2])]
    m = spark.createDataFrame(rows, "dataset string, frame long, species string, atom_ids array<bigint>")
    got = oc.changed_components(m, 20).collect()
    assert sorted((r["dataset"], len(r["reactants"]), len(r["products"]), len(r["atom_ids"])) for r in got) == [("mixed", 260, 260, 521), ("rising", 260, 260, 521)]
    with pytest.raises(RuntimeError):
        oc.changed_components(m, 2)


def _nodes(spark, items):
    """Items (replicate, t, A, B, consumed atom, produced atom, status)."""
    rows = [(rep, f"{rep}-{i}", t, f"{a}->{b}", st, [a], [b], [(a, str(x))], [(b, str(y))]) for i, (rep, t, a, b, x, y, st) in enumerate(items)]
    inst = "array<struct<species:string,atoms:string>>"
    return spark.createDataFrame(rows, f"replicate string, event_id string, t long, reaction_key string, status string, reactants array<string>, products array<string>, consumed {inst}, produced {inst}")


def test_chain(spark):
    steps = [("A", "B"), ("B", "C"), ("C", "D")]
    items = [("rep1", t, a, b, atom, atom, "matched") for atom in (0, 1) for t, (a, b) in enumerate(steps)] + [("rep2", t, a, b, 0, 0, "matched") for t, (a, b) in enumerate(steps)]
    nodes = _nodes(spark, items)
    paths = pt.event_paths(nodes, pt.event_edges(nodes), 3)
    sig = pt.path_signatures(paths).collect()
    assert len(sig) == 1 and (sig[0]["n_occurrences"], sig[0]["n_lineages"], sig[0]["n_replicates"], sig[0]["support"]) == (3, 3, 2, 1.0)
    assert {tuple(r["gaps"]) for r in paths.collect()} == {(1, 1)}
    merged = _merged(spark, "5 A->B", "2 X->B", "5 B->C", "5 C->D", "2 C->Z")
    rows = pt.compare_paths(paths, pt.reachable_paths(merged, 3)).collect()
    assert {(r["n_reachable"], r["n_confirmed"], r["n_aggregate_only"], r["realised"]) for r in rows} == {(4, 1, 3, 0.25)}
    assert sum(r["n_reachable"] for r in rows) == 8 and sum(r["n_actual"] for r in rows) == 2
    assert pt.path_details(paths).count() == 9


def test_mismatch(spark):
    nodes = _nodes(spark, [("r", 0, "A", "B", 0, 0, "matched"), ("r", 1, "B", "C", 1, 1, "matched"), ("r", 2, "C", "D", 1, 1, "matched")])
    assert pt.event_paths(nodes, pt.event_edges(nodes), 3).count() == 0


def test_recross(spark):
    nodes = _nodes(spark, [("r", t, a, b, 0, 0, "matched") for t, (a, b) in enumerate([("A", "B"), ("B", "C"), ("C", "B"), ("B", "D")])])
    found = {tuple(r["reaction_keys"]) for r in pt.event_paths(nodes, pt.event_edges(nodes), 2).collect()}
    assert found == {("A->B", "B->C"), ("B->C", "C->B"), ("C->B", "B->D")}


def test_barrier(spark):
    nodes = _nodes(spark, [("r", 0, "A", "B", 0, 0, "matched"), ("r", 1, "B", "Q", 0, 0, "unresolved"), ("r", 2, "B", "C", 0, 0, "matched")])
    assert pt.event_edges(nodes).count() == 0


def test_batch(spark):
    counts = spark.createDataFrame([("g", "1", "[C]->[O]", "[O]->[C]", 10), ("g", "2", "[C]->[O]", "[O]->[C]", 20), ("g", "1", "[O]->[C]", "[C]->[O]", 2), ("g", "2", "[O]->[C]", "[C]->[O]", 4)], "group_name string, replicate string, reaction_key string, reverse_key string, tp long")
    conditions = rp.require_unique(counts.select("group_name", "replicate").distinct())
    table = rp.replicate_table(counts, conditions, counts.select("reaction_key", "reverse_key").distinct()).where("reaction_key = '[C]->[O]'")
    f, n = rp.statistics(table, "forward").first(), rp.statistics(table, "net").first()
    assert f["mean"] == 15 and round(f["sd"], 2) == 7.07 and (round(f["ci_low"], 2), round(f["ci_high"], 2)) == (-48.53, 78.53)
    assert n["mean"] == 12 and round(n["sd"], 2) == 5.66
    assert abs(_one(spark, rp.t_quantile(F.lit(31))) - 2.0395) < 1e-3
    c = _one(spark, rp.parse_condition(F.lit("2500K_O2-0.5_P1.5_rep2")))
    assert tuple(c) == (2500.0, 0.5, 1.5, 2)
    with pytest.raises(ValueError):
        rp.require_unique(counts.select("group_name", "replicate"))


def test_scores(spark):
    v = lambda *x: [F.lit(i).cast("double") for i in x]
    assert math.isclose(_one(spark, pt.step_score(*v(0.5, 0.8, 0.75, 0.1))), 0.40 * 0.50 + 0.25 * 0.80 + 0.20 * 0.75 + 0.15 * 0.10)
    assert math.isclose(_one(spark, pt.step_score(*v(0.5, 0.8, None, None))), (0.40 * 0.50 + 0.25 * 0.80) / 0.65)
    assert math.isclose(_one(spark, pt.path_score(F.array(*v(0.81, 0.49)))), 0.70 * math.sqrt(0.81 * 0.49) + 0.30 * 0.49)


def test_candidate_paths(spark):
    merged = _merged(spark, "10 A->B", "4 B->A", "6 B->C", "2 C->D", "3 A->D")
    steps = pt.candidate_steps(merged)
    share = {(r["focal_input"], r["focal_output"]): r["net_share"] for r in steps.collect()}
    assert share["A", "B"] == 6 / 9 and share["A", "D"] == 3 / 9
    starts = spark.createDataFrame([("A",)], "start string")
    rows = pt.candidate_paths(steps, starts, max_depth=3).orderBy("rank").collect()
    assert {tuple(r["species"]) for r in rows} == {("A", "B", "C", "D"), ("A", "D")} and [r["rank"] for r in rows] == [1, 2]
    dim = spark.createDataFrame([("A", {"C": 5}), ("B", {"C": 4}), ("C", {"C": 1}), ("D", {"O": 1})], "smiles string, atom_counts map<string,int>")
    hits = pt.candidate_paths(steps, starts, dim=dim, target_max_carbon=1).collect()
    assert [tuple(r["species"]) for r in hits] == [("A", "B", "C")]
    assert pt.path_steps(pt.candidate_paths(steps, starts)).count() == 4


def test_ranges_and_bonds(spark):
    r = spark.createDataFrame([(1, 0, 2), (1, 3, 5), (1, 7, 8), (2, 1, 1)], "molecule_id long, start_frame long, end_frame long")
    assert {tuple(x) for x in oc.transitions_of_ranges(r).collect()} == {(1, -1, 1), (1, 5, -1), (1, 6, 1), (1, 8, -1), (2, 0, 1), (2, 1, -1)}
    b = spark.createDataFrame([("e", "before", 1, 2), ("e", "after", 2, 1), ("e", "after", 3, 4), ("e", "before", 5, 6)], "event_id string, side string, atom1 long, atom2 long")
    assert {tuple(x)[1:] for x in oc.bond_changes(b).collect()} == {(1, 2, "kept"), (3, 4, "formed"), (5, 6, "broken")}


def test_space(spark):
    atoms = spark.createDataFrame([(0, 1, 0.5, 0.5, 0.5), (0, 2, 9.5, 0.5, 0.5), (0, 3, 5.0, 5.0, 5.0), (0, 4, 1.5, 0.5, 0.5)], "timestep long, id long, x double, y double, z double")
    cores = spark.createDataFrame([("e", 0, 1)], "event_id string, timestep long, id long")
    near = sp.local_environment(atoms, cores, (10.0, 10.0, 10.0), 2.0)
    assert {(r["id"], r["dist"]) for r in near.collect()} == {(2, 1.0), (4, 1.0)}  # without the core
    moved = {r["id"]: (r["x"], r["scope"]) for r in sp.recentred(atoms, near.select("event_id", "id").union(cores.select("event_id", "id")), cores, (10.0, 10.0, 10.0)).collect()}
    assert moved == {1: (0.0, "core"), 2: (-1.0, "environment"), 4: (1.0, "environment")}
    frames = spark.createDataFrame([("d", 0), ("d", 5000), ("d", 10000)], "dataset string, timestep long")
    events = spark.createDataFrame([("d", "a", 2500), ("d", "b", 2600), ("d", "c", 10000), ("d", "x", 99999)], "dataset string, event_id string, timestep long")
    assert {r["event_id"]: r["frame_timestep"] for r in sp.nearest_frame(events, frames).collect()} == {"a": 0, "b": 5000, "c": 10000, "x": 10000}


def test_evidence_and_continuations(spark):
    rows = spark.createDataFrame([("d", "e1", 0, 0, ["A"], ["B"], "A->B", "matched"), ("d", "e2", 3, 1, ["B"], ["C"], "B->C", "unresolved"), ("d", "e3", 1, 2, ["B"], ["D"], "B->D", "matched")], "dataset string, event_id string, transition long, source_row long, reactants array<string>, products array<string>, reaction_key string, status string")
    anchors = spark.createDataFrame([("d", "e1", "A->B", "B"), ("d", "e2", "B->C", "C")], "dataset string, event_id string, reaction_key string, species string")
    near = oc.adjacent_events(rows, anchors.drop("reaction_key"), "later").orderBy("rank").collect()
    assert [(r["other_id"], r["gap"]) for r in near] == [("e3", 1), ("e2", 3)]
    merged = _merged(spark, "5 A->B", "4 B->C", "3 B->D", "2 C->Z")
    found = {(r["event_id"], r["next_key"], r["evidence_level"]) for r in oc.continuations(rows, merged, anchors).collect()}
    assert found == {("e1", "B->D", "events"), ("e1", "B->C", "events"), ("e2", "C->Z", "network")}
    summary = oc.reaction_summary(rows)
    linked = {r["reaction_key"]: r for r in oc.with_evidence(merged, summary).collect()}
    assert linked["C->Z"]["total_events"] == 0 and linked["A->B"]["event_coverage"] == 1.0
    assert {r["evidence_status"] for r in oc.with_evidence(merged, None).collect()} == {"network_only"}
    assert oc.expand_counts(spark.createDataFrame([(1, 3), (2, 0)], "id long, count long")).count() == 3


def test_bridges(spark):
    merged = nw.merge_reactions(_reactions(spark, "1 A+B->C+D", "1 C+D->E+F", "1 E+F->G", "1 C->E"))
    rows = pt.reachable_with_bridges(merged, 3, max_variants=3).collect()
    assert [(r["reaction_keys"], r["bridges"], r["truncated"]) for r in sorted(rows, key=lambda r: r["reaction_keys"])] == [
        (["A+B->C+D", "C+D->E+F", "E+F->G"], [["C", "E"], ["C", "F"], ["D", "E"]], False),
        (["A+B->C+D", "C->E", "E+F->G"], [["C", "E"]], False),
    ]
    cut = pt.reachable_with_bridges(merged, 3, max_paths=1).collect()
    assert [(r["reaction_keys"][1], r["truncated"]) for r in cut] == [("C+D->E+F", True)]
    with pytest.raises(ValueError):
        pt.reachable_with_bridges(merged, 9)


def test_condition_groups(spark):
    key = lambda s: _one(spark, rp.group_key(F.lit(s)))
    assert key("x/T2500_O2=0.5_run3") == "T2500K_O2=0.5" and key("TEMP=1999.6K_PRESSURE2atm_seed1/") == "T2000K_P=2"
    assert key("a/b/case_rep2") == "a/b/case" and key("case") == "case" and key("_rep1") == "_rep1"
    assert tuple(_one(spark, rp.parse_condition(F.lit("T300K_O2_1_P1.5_seed4")))) == (300.0, 1.0, 1.5, 4)


def test_snapshot_of_unknown_timestep(spark):
    rows = spark.createDataFrame([(0, "C", 1)], "timestep long, smiles string, count long")
    assert ab.snapshot(rows, 0).count() == 1
    with pytest.raises(KeyError):
        ab.snapshot(rows, 7)


def test_frame_window(spark):
    frames = spark.createDataFrame([("d", t) for t in (0, 10, 20, 3000, 3010)], "dataset string, timestep long")
    events = spark.createDataFrame([("d", "a", 11, 19), ("d", "b", 3009, 2990), ("d", "c", -5, -5)], "dataset string, event_id string, before_timestep long, after_timestep long")
    got: dict = {}
    for r in sp.frame_window(events, frames, 1, 1).collect():
        got.setdefault(r["event_id"], set()).add(r["frame_timestep"])
    assert got == {"a": {0, 10, 20, 3000}, "b": {20, 3000, 3010}, "c": {0, 10}}


def test_frame_window_like_a_search_of_all_frames(spark):
    frames = {"many": sorted({(i * i * 7919) % 40000 - 2000 for i in range(3000)}), "few": [t * 50000 for t in range(-9, 9)], "far": [0, *range(10**11, 10**11 + 40)], "one": [5]}
    at = [-10**6, -2001, -1, 0, 6, 16383, 16384, 30000, 32768, 75000, 10**6, 10**11 - 1, 10**11 + 20]
    events = [(d, f"e{t}/{length}", t, t + length) for d in [*frames, "none"] for t in at for length in (0, 1, 3600, -3600, 40000)]
    events += [("many", "twice", 100, 200), ("many", "twice", 9000, 8000), ("many", "half", None, 7), ("many", "null", None, None), ("many", None, 5, 9), (None, "e", 1, 2)]
    rows = spark.createDataFrame(events, "dataset string, event_id string, before_timestep long, after_timestep long")
    steps = spark.createDataFrame([(d, t) for d, x in frames.items() for t in x] + [("many", frames["many"][0]), ("many", None)], "dataset string, timestep long")
    for before, after in ((1, 2), (0, 0), (-1, 1500)):
        spans: dict = {}
        for d, e, *ts in events:
            spans.setdefault((d, e), []).extend(min(range(len(frames[d])), key=lambda i: abs(frames[d][i] - t)) for t in ts if d in frames and t is not None)
        want = {(d, e, t) for (d, e), n in spans.items() if n for t in frames[d][max(0, min(n) - max(0, before)) : max(n) + after + 1]}
        got = [tuple(r) for r in sp.frame_window(rows, steps, before, after).collect()]
        assert len(got) == len(want) and set(got) == want


def test_frame_windows_are_not_shuffled(spark):
    frames = spark.range(3000).select(F.lit("d").alias("dataset"), F.col("id").alias("timestep"))
    events = spark.range(50).select(F.lit("d").alias("dataset"), F.col("id").alias("event_id"), F.col("id").alias("before_timestep"), (F.col("id") + 2000).alias("after_timestep"))
    rows = sp.frame_window(events, frames)
    assert rows.count() == sum(min(2000 + i + 1, 2999) - max(i - 1, 0) + 1 for i in range(50))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert all(f"\n   {branch} Generate explode(times" in plan for branch in (":-", "+-"))  # the rows are made last, above every exchange
