"""Evidence, environments and exports on hand-made rows."""

from __future__ import annotations

import pytest

from kinetra.functions.reactions import match_formulas
from kinetra.operators import occurrences as oc
from kinetra.operators import paths as pt
from kinetra.operators import space as sp
from kinetra.sources import readers

from pyspark.sql import functions as F


def test_core_atoms_do_not_use_up_the_cap(spark):
    atoms = spark.createDataFrame([(0, i, "C", float(i), 0.0, 0.0) for i in range(6)], "timestep long, id long, element string, x double, y double, z double")
    cores = spark.createDataFrame([("e", 0, 0), ("e", 0, 1)], "event_id string, timestep long, id long")
    rows = sp.local_environment(atoms, cores, (20.0, 20.0, 20.0), 4.0, 2).collect()
    assert sorted((r["id"], r["dist"]) for r in rows) == [(2, 1.0), (3, 2.0)]


def test_evidence_of_several_datasets_keeps_one_row(spark):
    merged = spark.createDataFrame([("a->b", 5), ("b->a", 1), ("c->d", 2)], "reaction_key string, tp long")
    summary = spark.createDataFrame([("x", "a->b", 4, 2, 2, 10), ("y", "a->b", 2, 1, 1, 5), ("y", "b->a", 1, 1, 1, 5)], "dataset string, reaction_key string, total_events long, matched_events long, distinct_intervals long, available_intervals long")
    rows = {r["reaction_key"]: r for r in oc.with_evidence(merged, summary).collect()}
    assert len(rows) == 3 and rows["a->b"]["total_events"] == 6 and rows["a->b"]["event_coverage"] == 0.5 and rows["a->b"]["time_coverage"] == 3 / 15
    assert rows["c->d"]["total_events"] == 0 and rows["c->d"]["event_coverage"] == 0.0


def test_bad_native_evidence_is_an_error(spark, tmp_path):
    good = {
        "frames": [(0, 0, 0), (0, 1, 10)], "reaction_types": [(1, "A", "B", 1)], "reaction_events": [(0, 1, 2)], "species": [(1, "A")],
        "molecules": [(1, 1, [0], [])], "molecule_ranges": [(1, 0, 1)],
    }

    def write(name, **change):
        for t, rows in (good | change).items():
            spark.createDataFrame(rows, readers.TIMELINE[t]).write.parquet(f"{tmp_path}/{name}/{t}.parquet")
        return f"{tmp_path}/{name}"

    rows = readers.timed_events(spark, "d", timeline=write("good")).collect()
    assert [(r["transition"], r["reaction_key"], r["source_kind"]) for r in rows] == [(0, "A->B", "timeline")] * 2
    for name, change, said in (("type", {"reaction_events": [(0, 7, 1)]}, "unknown reaction id"), ("twice", {"species": [(1, "A"), (1, "B")]}, "repeated species id"), ("over", {"molecule_ranges": [(1, 0, 1), (1, 1, 1)]}, "overlap"), ("late", {"reaction_events": [(1, 1, 1)]}, "outside")):
        with pytest.raises(ValueError, match=said):
            readers.timed_events(spark, "d", timeline=write(name, **change), events="unused")
    path = write("column")
    spark.createDataFrame([(1,)], "species_id int").write.mode("overwrite").parquet(f"{path}/species.parquet")
    with pytest.raises(ValueError, match="name"):
        readers.read_timeline(spark, path)


def test_formula_match(spark):
    rows = spark.createDataFrame([(1, ["C2", "H2"], ["C2H4"]), (2, ["C2", "H2", "H2"], ["C2H4", "H2"]), (3, ["H2"], ["C2H4"])], "id int, r array<string>, p array<string>")
    ids = lambda *a: [x["id"] for x in rows.where(match_formulas(F.col("r"), F.col("p"), *a)).orderBy("id").collect()]
    assert ids({"C2": 1, "H2": 1}, {}) == [1, 2] and ids({"C2": 1, "H2": 1}, {}, "exact") == [1] and ids({}, {"C2H4": 1}, "exact") == [1, 3]
    with pytest.raises(ValueError, match="mode"):
        ids({}, {}, "like")


def test_unknown_event_is_an_error(spark):
    rows = spark.createDataFrame([("d", "e1", 1)], "dataset string, event_id string, transition long")
    assert oc.event_by_id(rows, "d", "e1").first()["transition"] == 1
    with pytest.raises(KeyError):
        oc.event_by_id(rows, "d", "e2")


def test_members_across_parts(spark):
    ranges = spark.createDataFrame([(1, 0, 1000), (2, 255, 256), (3, 700, 700)], "molecule_id long, start_frame long, end_frame long")
    frames = spark.createDataFrame([(0,), (255,), (256,), (257,), (700,), (1001,)], "frame long")
    got = sorted(map(tuple, oc.members_at(ranges, frames).collect()))
    assert got == [(0, 1), (255, 1), (255, 2), (256, 1), (256, 2), (257, 1), (700, 1), (700, 3)]


def test_representatives_over_many_spans(spark):
    rows = spark.createDataFrame([("d", f"e{i:04d}", i * 7 % 1000, "a->b", "matched" if i % 3 else "unresolved") for i in range(500)], "dataset string, event_id string, transition long, reaction_key string, status string")
    frames = spark.createDataFrame([("d", f) for f in range(0, 1001, 2)] + [("d", 501)], "dataset string, frame long")
    got = oc.representative_events(rows, frames).collect()
    want = sorted(got, key=lambda r: (r["tier"], r["transition"], r["event_id"]))
    assert [r["rank"] for r in want] == list(range(1, 501))


def test_export_has_all_columns(spark):
    merged = spark.createDataFrame([("A->B", ["A"], ["B"], 5), ("B->C", ["B"], ["C"], 3)], "reaction_key string, reactants array<string>, products array<string>, tp long")
    steps = pt.candidate_steps(merged)
    paths = pt.candidate_paths(steps, spark.createDataFrame([("A",)], "start string"))
    rows = pt.export_steps(paths, steps, references="ref").orderBy("path_rank", "step_index").collect()
    # The columns of the export.
    names = "path_rank step_index path_species reaction_key traversal_direction focal_input focal_output reactants products forward_tp reverse_tp net_tp net_share directionality event_coverage time_coverage event_total matched_event_total distinct_intervals path_score step_score evidence_status score_version source_references"
    assert rows[0].asDict().keys() - {"start"} == set(names.split())
    assert [(r["focal_input"], r["focal_output"], r["forward_tp"], r["evidence_status"]) for r in rows if r["path_species"] == "A > B > C"] == [("A", "B", 5, "network_only"), ("B", "C", 3, "network_only")]


def _brute(atoms, cores, vectors, pbc, radius):
    """Nearest distance of each other atom to the cores over all images, by trying many."""
    import itertools

    import numpy as np

    place = {r[1]: np.array(r[2:]) for r in atoms}
    shifts = np.array(list(itertools.product(*[range(-20, 21) if p else (0,) for p in pbc]))) @ np.array(vectors)
    out = {}
    for i, r in place.items():
        d = min(np.linalg.norm(shifts + (r - place[c]), axis=1).min() for c in cores)
        if i not in cores and d <= radius:
            out[i] = round(float(d), 9)
    return out


@pytest.mark.parametrize(("radius", "pbc"), [(6.5, (True, True, True)), (13.0, (True, False, True)), (13.0, (False, False, False))])
def test_environment_in_a_flat_tilted_box(spark, radius, pbc):
    """One edge is shorter than the radius, the tilt more than an edge, and atoms lie outside of the box."""
    import random

    rng = random.Random(8)
    vectors = [(9.0, 0.0, 0.0), (13.5, 4.0, 0.0), (-3.0, 1.5, 11.0)]
    rows = [(0, i, *(rng.uniform(-8, 20) for _ in range(3))) for i in range(25)]
    atoms = spark.createDataFrame(rows, "timestep long, id long, x double, y double, z double")
    box = spark.createDataFrame([(0, *map(list, vectors), [1.0, -2.0, 0.0], list(pbc))], "timestep long, a array<double>, b array<double>, c array<double>, origin array<double>, pbc array<boolean>")
    cores = spark.createDataFrame([("e", 0, 3), ("e", 0, 4)], "event_id string, timestep long, id long")
    got = sp.local_environment(atoms, cores, box, radius, 1000).collect()
    assert {r["id"]: round(r["dist"], 9) for r in got} == _brute(rows, {3, 4}, vectors, pbc, radius)
    assert all(r["n_raw"] == len(got) and not r["truncated"] for r in got)
    few = sp.local_environment(atoms, cores, box, radius, 1).collect()
    assert len(few) <= 1 and all(r["truncated"] == (len(got) > 1) for r in few)


def test_recentring_takes_the_nearest_core_atom(spark):
    atoms = spark.createDataFrame([(0, 1, 1.0, 0.0, 0.0), (0, 2, 8.0, 0.0, 0.0), (0, 3, 13.5, 0.0, 0.0), (5, 3, 2.0, 2.0, 2.0)], "timestep long, id long, x double, y double, z double")
    cores = spark.createDataFrame([("e", 0, 1), ("e", 0, 2)], "event_id string, timestep long, id long")
    selected = spark.createDataFrame([("e", 1), ("e", 2), ("e", 3)], "event_id string, id long")
    rows = {r["id"]: (r["x"], r["scope"]) for r in sp.recentred(atoms, selected, cores, (20.0, 20.0, 20.0)).collect()}
    assert rows == {1: (-3.5, "core"), 2: (3.5, "core"), 3: (9.0, "environment")}
    # A frame without core atoms is centred on the first selected one.
    frames = selected.withColumn("timestep", F.lit(5).cast("long"))
    assert [(r["id"], r["x"]) for r in sp.recentred(atoms, frames, cores, (20.0, 20.0, 20.0)).collect()] == [(3, 0.0)]


def test_view_of_an_event(spark):
    atoms = spark.createDataFrame([(t, i, float(i), 0.0, 0.0) for t in (0, 1, 2, 3) for i in range(6)], "timestep long, id long, x double, y double, z double")
    events = spark.createDataFrame([("e", 1, 3, 3)], "event_id string, before_timestep long, after_timestep long, anchor_timestep long")
    windows = spark.createDataFrame([("e", t) for t in (0, 1, 2, 3)], "event_id string, timestep long")
    participants = spark.createDataFrame([("e", 0), ("e", 1), ("e", 2)], "event_id string, id long")
    bonds = oc.bond_table(spark.createDataFrame([("e", "before", 0, 1, 1), ("e", "before", 1, 2, 1), ("e", "after", 0, 1, 1), ("e", "after", 0, 2, 1)], "event_id string, side string, atom1 long, atom2 long, bond_order int"))
    view = sp.local_view(atoms, (50.0, 50.0, 50.0), events, windows, participants, bonds, 1.5).cache()
    assert {r["timestep"]: r["bond_state"] for r in view.collect()} == {0: "before", 1: "before", 2: "intermediate", 3: "after"}
    assert {(r["id"], r["scope"]) for r in view.collect()} == {(0, "core"), (1, "core"), (2, "core"), (3, "environment")}
    assert {tuple(r)[1:4] for r in sp.view_bonds(view, bonds).collect()} == {(0, 0, 1), (0, 1, 2), (1, 0, 1), (1, 1, 2), (3, 0, 1), (3, 0, 2)}
    assert {(r["event_id"], r["id"]) for r in sp.core_atoms(participants, bonds.where("false")).collect()} == {("e", 0), ("e", 1), ("e", 2)}
