"""Several datasets, searches, grouped comparisons, exports and materialised evidence on hand-made rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kinetra.functions.reactions import radical_subclass
from kinetra.functions.species import species_dim, strict_formula
from kinetra.operators import abundance as ab
from kinetra.operators import network as nw
from kinetra.operators import occurrences as oc
from kinetra.operators import paths as pt
from kinetra.operators import replicates as rp
from kinetra.sources import readers, sinks


def test_three_datasets_in_one_model(spark, tmp_path):
    rows = [("first", 0, "[N][N]", 2), ("first", 10, "[N][N]", 4), ("second", 0, "[N][N][N]", 3)]
    (tmp_path / "t.csv").write_text("time,species,count,dataset\n0,[N][N][N][N],5,third\n")
    tidy = ab.tidy_counts(readers.read_tidy(spark, f"{tmp_path}/t.csv"))
    counts = spark.createDataFrame(rows, "dataset string, timestep long, smiles string, count long").unionByName(tidy)
    got = ab.distribution_model(counts, species_dim(counts), "N", width=2, groups=[("large", 4, None)], window=2).collect()
    assert {(r["dataset"], r["timestep"], r["label"], r["raw_count"], r["count"]) for r in got} == {("first", 0, "N2-3", 2, 2.0), ("first", 10, "N2-3", 4, 3.0), ("second", 0, "N2-3", 3, 3.0), ("third", 0, "large", 5, 5.0)}
    assert {tuple(r) for r in ab.frames(counts, ("dataset",)).collect()} == {("first", 0, 0), ("first", 10, 1), ("second", 0, 0), ("third", 0, 0)}
    many = spark.range(100).select(F.col("id").alias("frame"))
    assert [r["frame"] for r in ab.every_nth(many, 40).orderBy("frame").collect()] == [0, 40, 80, 99]
    with pytest.raises(ValueError):
        ab.every_nth(many, 0)


def test_frames_are_numbered_by_ranges(spark):
    steps = [0, 5, 1023, 1024, 9000, 10**12]
    a = spark.createDataFrame([(t, "x", 1) for t in steps] * 2, "timestep long, smiles string, count long")
    assert [tuple(r) for r in ab.frames(a).orderBy("frame").collect()] == [(t, i) for i, t in enumerate(steps)]
    assert "Window [row_number" not in ab.frames(a)._jdf.queryExecution().optimizedPlan().toString().replace("[row_number() windowspecdefinition(part", "")
    assert ab.timeline_summary(a).first()["uniform_step"] is None


def test_search_in_any_case_and_species_of_reactions_only(spark):
    a = spark.createDataFrame([(0, "[C]1[Cl]", 4), (0, "[O]", 9), (5, "[O]", 2)], "timestep long, smiles string, count long")
    summary, dim = ab.species_summary(a), species_dim(spark.createDataFrame([("[C]1[Cl]",), ("[O]",), ("[N][O]",)], "smiles string"))
    stats = spark.createDataFrame([("[N][O]",), ("[O]",)], "species string")
    find = lambda *x, **k: [(r["smiles"], r["total_count"], r["source"]) for r in ab.search_species(summary, dim, *x, **k).collect()]
    assert find("smiles", "CL", stats=stats) == [("[C]1[Cl]", 4, "species")]
    assert find("smiles", "[n]", stats=stats) == [("[N][O]", 0, "reactions")]
    assert find("smiles", "[o]", stats=stats) == [("[O]", 11, "species")]  # found in the frames, so reactions aren't asked
    assert find() == [("[O]", 11, "species"), ("[C]1[Cl]", 4, "species")]
    assert find("formula", "O") == [("[O]", 11, "species")] and find("smiles", "zz") == []
    lists = {r["smiles"]: (r["consumption_frames"], r["production_frames"]) for r in ab.change_frame_lists(a).collect()}
    assert lists == {"[C]1[Cl]": ([], []), "[O]": ([5], [])}


def test_subclasses(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    t = "C6H5O"
    assert one(radical_subclass(a(t, "O2"), a("C6H5O3"), t)) == "+ O2 -> C6H5O3"
    assert one(radical_subclass(a(t), a("C5H5", "CO"), t)) == "-> C5H5 + CO"
    assert one(radical_subclass(a(t), a(t), t)) == "rearrangement"
    assert one(radical_subclass(a(t), a("C6H6O"), t)) == "-> C6H6O"
    assert one(radical_subclass(a(t, "CH3", "HCl"), a("X"), t)) == "+ HCl -> X"


def test_strict_formulas(spark):
    def one(text):
        r = spark.range(1).select(strict_formula(F.lit(text).cast("string")).alias("f")).first()["f"]
        return r["error"] or r["counts"]

    assert one("C6H5ClO") == {"C": 6, "H": 5, "Cl": 1, "O": 1} and one("CH3 + C2H5") == {"C": 3, "H": 8} and one("∅ + O2H0") == {"O": 2}
    assert [one(x) for x in ("c6", "C6-", "", None, "H0", "C 6")] == ["invalid formula", "invalid formula", "empty formula", "empty formula", "no atoms", "invalid formula"]


def test_tiers_need_bond_changes(spark):
    rows = [(f"e{i}", t, s) for i, (t, s) in enumerate([(0, "matched"), (0, "matched"), (1, "matched"), (0, "unresolved")])]
    events = spark.createDataFrame([("d", e, t, "A->B", s, [1]) for e, t, s in rows] + [("d", "e9", 0, "A->B", "matched", [])], "dataset string, event_id string, transition long, reaction_key string, status string, atom_ids array<long>")
    frames = spark.createDataFrame([("d", 0), ("d", 1)], "dataset string, frame long")
    bonds = oc.bond_table(spark.createDataFrame([("e0", "before", 1, 2, 1), ("e0", "after", 1, 2, 1), ("e1", "before", 1, 2, 1), ("e1", "after", 2, 1, 2)], "event_id string, side string, atom1 long, atom2 long, bond_order int"))
    got = {r["event_id"]: (r["recommendation"], r["rank"], r["changed_atoms"]) for r in oc.representative_events(events, frames, bonds).collect()}
    assert got == {"e1": ("recommended", 1, [1, 2]), "e0": ("reviewable", 2, []), "e3": ("unavailable", 3, []), "e9": ("unavailable", 4, []), "e2": ("unavailable", 5, [])}


def test_endings_and_fragments(spark):
    dim = species_dim(spark.createDataFrame([(x,) for x in ("CCCCCC", "CCCC", "CC", "C", "O")], "smiles string"))
    rows = [("CCCCCC", 1, ["CCCCCC", "CCCC", "C"], ["CCCCCC->CC+CCCC", "CCCC+O->C+C+CC"]), ("CCCC", 1, ["CCCC", "CCCCCC"], ["CC+CCCC->CCCCCC"]), ("CC", 1, ["CC", "CCCC"], ["CC+CC->CCCC"])]
    paths = spark.createDataFrame(rows, "start string, rank int, species array<string>, reaction_keys array<string>")
    got = {r["start"]: (r["termination"], r["small_fragments"], r["fragmentation_steps"], r["fragmentation_step"]) for r in pt.annotate_endings(paths, dim, 2, target_max_carbon=1).collect()}
    assert got == {"CCCCCC": ("small_molecule_goal", ["CC", "CCCC", "C"], [1, 2], 1), "CCCC": ("no_positive_continuation", [], [], None), "CC": ("no_positive_continuation", [], [], None)}
    assert {r["termination"] for r in pt.annotate_endings(paths, dim, 2, truncated=True).collect()} == {"depth_limit", "search_truncated"}


def test_grouped_report_is_all_or_nothing(spark):
    counts = spark.createDataFrame([("g", 1, "A->B", "B->A", 10), ("g", 2, "A->B", "B->A", 20), ("g", 1, "B->A", "A->B", 2), ("h", 1, "B->A", "A->B", 7)], "group_name string, replicate int, reaction_key string, reverse_key string, tp long")
    conditions = spark.createDataFrame([("g", 1, "a"), ("g", 2, "b"), ("h", 1, "c")], "group_name string, replicate int, source string")
    rows = {r["reaction_key"]: r for r in rp.grouped_report(counts, conditions).collect()}
    ab_, ba = rows["A->B"], rows["B->A"]
    assert (ab_["rank"], ab_["total_tp"], ab_["total_net_tp"]) == (1, 30, 21) and (ba["rank"], ba["total_tp"], ba["total_net_tp"]) == (2, 9, -21)
    assert [(g["group_name"], g["n_replicates"], g["detection_rate"], g["mean_tp"], round(g["std_tp"], 4), g["mean_net_tp"]) for g in ab_["groups"]] == [("g", 2, 1.0, 15.0, 7.0711, 14.0), ("h", 1, 0.0, 0.0, 0.0, -7.0)]
    bad = spark.createDataFrame([("g", 1, "a"), ("g", 1, "b"), ("g", 0, "a"), ("", 1, "x"), ("h", None, None), ("i", 1, None)], "group_name string, replicate int, source string")
    found = {tuple(r) for r in rp.audit_groups(bad, counts).collect()}
    assert found == {("g", "1", "replicate given twice"), ("g", "0", "bad replicate number"), ("g", "1", "source used twice"), ("g", "0", "source used twice"), ("", "1", "group without a name"), ("h", None, "group without replicates"), ("i", "1", "replicate without a source"), ("g", "0", "no reactions"), ("", "1", "no reactions")}
    with pytest.raises(ValueError, match="9 faults"):
        rp.grouped_report(counts, bad)
    with pytest.raises(ValueError):
        rp.grouped_report(counts, conditions, top=0)


def test_names_of_conditions(spark):
    one = lambda s: tuple(spark.range(1).select(rp.parse_condition(F.lit(s)).alias("c")).first()["c"])
    assert one("runs/T2500K_O2-0.5_P1.0_rep2/") == (2500.0, 0.5, 1.0, 2)
    assert one("TEMP=900_o2=1_PRESSURE-2.5atm_seed_7") == (900.0, 1.0, 2.5, 7)
    assert one("300K_run3") == (300.0, None, None, 3) and one("plain") == (None, None, None, None) and one("T2.5.1_P.5") == (None, None, None, None)
    key = lambda s: spark.range(1).select(rp.group_key(F.lit(s)).alias("k")).first()["k"]
    assert [key(x) for x in ("a/case5_rep2", "a/case5_rep_2", "rep2", "a/b_seed3/", "x__run=4")] == ["a/case5", "a/case5", "rep2", "a/b", "x"]


def _exchanged(plan: str, table: str) -> bool:
    """Whether an Exchange stands above the scan of the table without an aggregate between them."""
    above: list[tuple[int, str]] = []
    for line in plan.splitlines():
        name = line.lstrip(" :+-*0123456789()")
        depth = len(line) - len(name)
        above = [x for x in above if x[0] < depth]
        if name.startswith("FileScan") and table in line:
            for _, up in reversed(above):
                if "Aggregate" in up:
                    break
                if up.startswith("Exchange"):
                    return True
        above.append((depth, name))
    return False


def test_evidence_in_buckets_is_joined_without_a_shuffle(spark):
    rows = [("d", f"e{i}", i % 50, i, ["A"], ["B"], "A->B", "matched", [i]) if i % 2 else ("d", f"e{i}", i % 50, i, ["B"], ["C"], "B->C", "matched", [i]) for i in range(400)]
    events = spark.createDataFrame(rows, "dataset string, event_id string, transition long, source_row long, reactants array<string>, products array<string>, reaction_key string, status string, atom_ids array<long>")
    counts = spark.createDataFrame([("d", t, "A", 1 + t) for t in range(9)], "dataset string, timestep long, smiles string, count long")
    sinks.write_evidence_tables("bucket_test", events, counts, 4)
    tables = sinks.read_evidence_tables(spark, "bucket_test")
    assert tables["event_atoms"].count() == 400 and tables["event_species"].count() == 800 and tables["species_summary"].first()["peak_count"] == 9 and tables["reaction_summary"].count() == 2
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        steps = events.select("reaction_key").distinct()
        check = oc.occurrence_check(steps, tables["occurrences"], 2)
        assert not _exchanged(check._jdf.queryExecution().executedPlan().toString(), "bucket_test_occurrences")
        anchors = events.where("event_id = 'e1'").select("dataset", "event_id", F.explode("products").alias("species"), "transition")
        later = oc.adjacent_events(events, anchors, "later", 3, tables["event_species"])
        assert not _exchanged(later._jdf.queryExecution().executedPlan().toString(), "bucket_test_event_species")
        got = sorted(tuple(r) for r in later.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["reaction_key"]: (r["n_events"], r["events"]) for r in check.collect()} == {"A->B": (200, ["e1", "e101"]), "B->C": (200, ["e0", "e100"])}
    assert got == sorted(tuple(r) for r in oc.adjacent_events(events, anchors, "later", 3).collect()) and len(got) == 3


def test_exports(spark):
    merged = nw.merge_reactions(spark.createDataFrame([(0, ["C", "O"], ["CO"], 20), (1, ["CO"], ["C", "O"], 5)], "line_no long, reactants array<string>, products array<string>, tp long"))
    dim = species_dim(nw.sides(merged), "species").withColumnRenamed("species", "smiles")
    assert [(r["rank"], r["tp"], r["reactant_smiles"], r["product_formulas"]) for r in sinks.ranked_reactions(merged, dim).orderBy("rank").collect()] == [(1, 20, "C + O", "CO"), (2, 5, "CO", "C + O")]
    assert [r["rank"] for r in sinks.ranked_species(nw.species_stats(merged), dim, 2).collect()] == [1, 2]
    variants = sinks.smiles_variants(spark.createDataFrame([("OC", 2), ("CO", 3), ("OC", 4), ("N", 1)], "smiles string, count long"), spark.createDataFrame([("OC", "CO"), ("CO", "CO")], "smiles string, canonical string"))
    assert {tuple(r) for r in variants.collect()} == {("CO", 9, 1, "OC", 6), ("CO", 9, 2, "CO", 3), ("N", 1, 1, "N", 1)}
    view = spark.createDataFrame([(1, "core"), (2, "participant"), (3, "environment")], "id long, scope string")
    assert [sinks.scoped_atoms(view, s).count() for s in ("core", "participants", "context")] == [1, 2, 3]
    with pytest.raises(ValueError):
        sinks.scoped_atoms(view, "all")
