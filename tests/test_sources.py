"""Readers, audits and writers on small files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kinetra.sources import audits, readers, sinks


def _file(tmp_path, name, text):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_reactions(spark, tmp_path):
    path = _file(tmp_path, "a.reactionabcd", "10 [C]+[O]->[C][O]\n\nx [A]->[B]\n4 [C][O]->[C]+[O]\n3 [A]\n2 [A]->[B]->[C]\n0 [A]->[B]\n1 [H+]+[O-]->[H][O]\n")
    rows = readers.read_reactions(spark, path).orderBy("line_no").collect()
    assert [(r["tp"], r["reactants"], r["products"]) for r in rows] == [(10, ["[C]", "[O]"], ["[C][O]"]), (4, ["[C][O]"], ["[C]", "[O]"]), (1, ["[H+]", "[O-]"], ["[H][O]"])]


def test_abundance(spark, tmp_path):
    path = _file(tmp_path, "a.species", "Timestep 0: [C] 3 [O] x [N] 2\nTimestep 10: [C] 1\nnothing\n")
    assert {tuple(r)[1:] for r in readers.read_abundance(spark, path).collect()} == {(0, "[C]", 3), (0, "[N]", 2), (10, "[C]", 1)}
    tidy = readers.tidy_abundance(readers.read_abundance(spark, path), "s", "r", "ps", 0.5, spark.createDataFrame([("[C]", "carbon"), ("[N]", "carbon")], "smiles string, name string"))
    assert {tuple(r) for r in tidy.collect()} == {("s", "r", 0.0, "carbon", 5), ("s", "r", 5.0, "carbon", 1)}
    with pytest.raises(ValueError):
        readers.time_of(F.col("t"), "ps", None)
    both = readers.labelled_abundance(spark, [("s", "1", path), ("s", "2", path)])
    assert both.count() == 6


def test_tidy(spark, tmp_path):
    path = _file(tmp_path, "t.csv", "time,species,count,system\n0,C,3,x\n")
    assert tuple(readers.read_tidy(spark, path).first()) == ("x", 0.0, "C", 3)
    with pytest.raises(ValueError):
        readers.read_tidy(spark, _file(tmp_path, "u.csv", "time,count\n0,3\n"))


def test_events_and_molecules(spark, tmp_path):
    events = readers.timed_events(spark, "d", events=_file(tmp_path, "e.csv", "Timestep_Index,Reactant,Product\n0,[H]+[O],[H][O]\n0,[O]+[H],[H][O]\n"))
    assert {r["reaction_key"] for r in events.collect()} == {"[H]+[O]->[H][O]"}
    m = readers.read_molecules(spark, _file(tmp_path, "m.csv", "Timestep,Species,AtomIDs,BondIDs\n0,[H],0,\n0,[O],1,\n10,[H][O],0;1,0-1-1\n"), "d").orderBy("frame", "species").collect()
    assert [(r["frame"], r["species"], r["atom_ids"]) for r in m] == [(0, "[H]", [1]), (0, "[O]", [2]), (1, "[H][O]", [1, 2])]
    assert m[2]["bonds"][0].asDict() == {"a": 1, "b": 2, "order": 1}
    assert audits.audit_events(events).count() == 0
    with pytest.raises(ValueError):
        readers.timed_events(spark, "d")


def test_timeline(spark, tmp_path):
    tables = {
        "frames": [(0, 0, 0), (0, 1, 10)], "reaction_types": [(1, "[H]+[O]", "[H][O]", 2)], "reaction_events": [(0, 1, 2)], "species": [(1, "[H]")],
        "molecules": [(7, 1, [1], [])], "molecule_ranges": [(7, 0, 1)],
    }
    for name, rows in tables.items():
        spark.createDataFrame(rows, readers.TIMELINE[name]).write.parquet(f"{tmp_path}/t/{name}.parquet")
    read = readers.read_timeline(spark, f"{tmp_path}/t")
    audits.require_clean(audits.audit_timeline(read))
    assert [r["source_row"] for r in readers.timed_events(spark, "d", timeline=f"{tmp_path}/t").orderBy("source_row").collect()] == [1, 2]
    bad = dict(read, molecule_ranges=spark.createDataFrame([(8, 3, 1)], readers.TIMELINE["molecule_ranges"]))
    assert {r["rule"] for r in audits.audit_timeline(bad).collect()} == {"unknown molecule id", "range ends before it starts"}
    with pytest.raises(ValueError):
        audits.require_clean(audits.audit_timeline(bad))


def test_frames_of_a_source_increase(spark):
    none = {t: spark.createDataFrame([], schema) for t, schema in readers.TIMELINE.items()}
    steps = [(1, 0, 0), (1, 1, 10), (1, 70_000, 10), (1, 140_000, 20), (2, 0, 5), (2, 9, 4)]
    found = audits.audit_timeline(none | {"frames": spark.createDataFrame(steps, readers.TIMELINE["frames"])}).collect()
    assert {tuple(r) for r in found} == {("timesteps don't increase", "1 70000"), ("timesteps don't increase", "2 9")}


def test_trajectory(spark, tmp_path):
    frame = "ITEM: TIMESTEP\n{t}\nITEM: NUMBER OF ATOMS\n2\nITEM: BOX BOUNDS pp pp pp\n0 10\n0 10\n0 12\nITEM: ATOMS id type x y z\n1 1 0.5 1 2\n2 2 3 4 5\n"
    frames, atoms = readers.read_trajectory(spark, _file(tmp_path, "a.dump", frame.format(t=0) + frame.format(t=100)))
    assert [(r["timestep"], r["n_atoms"], r["box"][2]["hi"]) for r in frames.orderBy("timestep").collect()] == [(0, 2, 12.0), (100, 2, 12.0)]
    assert atoms.count() == 4 and {(r["id"], r["x"], r["element"]) for r in atoms.collect()} == {(1, 0.5, None), (2, 3.0, None)}


def test_faulty_frames_are_named(spark, tmp_path):
    def frame(step="1", n="2", box="0 9\n0 9\n0 9", head="id x", rows="1 1.5\n2 2.5", kinds="pp pp pp"):
        return f"ITEM: TIMESTEP\n{step}\nITEM: NUMBER OF ATOMS\n{n}\nITEM: BOX BOUNDS {kinds}\n{box}\nITEM: ATOMS {head}\n{rows}\n"

    blocks = [frame("1"), frame("2", n="3"), frame("3", box="0 9\n0 9"), frame("4", head="x y"), frame("5", rows="1 1\n1 2"), frame("6", rows="1\n2 2"), frame("7", n="x"), frame("8", rows="1 1\n2 2\n3 3"), frame("1")]
    frames, atoms = readers.read_trajectory(spark, _file(tmp_path, "a.dump", "ITEM: UNITS\nreal\n" + "".join(blocks)))
    found = {(r["rule"], r["detail"].split(" ")[-1]) for r in audits.audit_trajectory(frames).collect()}
    assert found == {("too few atoms", "2"), ("incomplete box", "3"), ("no column id", "4"), ("repeated id", "5"), ("too few columns", "6"), ("no atom count", "7"), ("timestep given twice", "1")}
    assert atoms.where("timestep = 8").count() == 2  # what stands behind the counted atoms is none of them


def test_tilted_box_and_scaled_coordinates(spark, tmp_path):
    text = "ITEM: TIMESTEP\n7\nITEM: BOX BOUNDS xy xz yz pp ff pp\n-3.0 12.0 2.0\n-1.0 11.0 -3.0\n0.0 8.0 1.0\nITEM: NUMBER OF ATOMS\n2\nITEM: ATOMS id type element xs ysu zs\n4 1 X 0.5 0.5 0.5\n9 2 cl 0 0 0\n"
    frames, atoms = readers.read_trajectory(spark, _file(tmp_path, "t.dump", text), {1: "H"})
    f = frames.first()
    assert (f["a"], f["b"], f["c"], f["origin"], f["pbc"], f["error"]) == ([10.0, 0.0, 0.0], [2.0, 11.0, 0.0], [-3.0, 1.0, 8.0], [0.0, -1.0, 0.0], [True, False, True], None)
    assert {(r["id"], r["element"], r["label"], r["x"], r["y"], r["z"]) for r in atoms.collect()} == {(4, "H", "H", 4.5, 5.0, 4.0), (9, "Cl", "Cl", 0.0, -1.0, 0.0)}


def test_labels_come_from_one_scan(spark, tmp_path):
    sources = [("s", str(i), _file(tmp_path, f"many/run {i}%+.species", f"Timestep {i}: A {i + 1}\n")) for i in range(500)]
    rows = readers.labelled_abundance(spark, [*sources, ("other", "x", sources[3][2]), ("folder", "y", f"{tmp_path}/many")])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [value") == 1 and "Union" not in plan
    got = {tuple(r) for r in rows.collect()}
    assert got == {(a, b, i, "A", i + 1) for i in range(500) for a, b in [("s", str(i)), ("folder", "y"), *[("other", "x")] * (i == 3)]}


def test_order_of_events_across_ranges(spark):
    rows = [("a", i, i // 3) for i in range(1000)] + [("b", 5, 9), ("b", 6, 8), ("b", 6, 9), ("b", 900, 7), ("c", 1, 1)]
    df = spark.createDataFrame(rows, "dataset string, source_row long, transition long")
    want = {("events out of order", "b 6 8"), ("events out of order", "b 900 7"), ("source row given twice", "b 6"), ("source rows missing", "b 7 899")}
    for span in (1, 7, 1 << 16):
        assert {tuple(r) for r in audits.audit_events(df, span).collect()} == want
    assert audits.audit_events(df.limit(0)).collect() == []


def test_scan(spark, tmp_path):
    for name in ("root/a/x.reactionabcd", "root/a/b/y.reactionabcd", "root/c/d/z2.reactionabcd", "root/c/d/z1.reactionabcd"):
        _file(tmp_path, name, "1 A->B\n")
    rows = readers.scan_conditions(spark, f"{tmp_path}/root").collect()
    assert {(r["directory"].rsplit("root/", 1)[1], r["file"].rsplit("/", 1)[1]) for r in rows} == {("a", "x.reactionabcd"), ("c/d", "z1.reactionabcd")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"])], "id long, x array<string>")
    sinks.write(df, f"{tmp_path}/o", "csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/o").first()["x"] == '["a","b"]'
    wide = sinks.evolution_table(spark.createDataFrame([(0, 0, "a", 1), (0, 0, "b", 2)], "frame long, timestep long, series string, count long"), ["a", "b"])
    assert tuple(wide.first()) == (0, 0, 1, 2)
    sinks.write_evidence(df.select("id"), "evidence_test", 2, "id")
    assert spark.table("evidence_test").count() == 1
    assert sinks.with_query_columns(df, "r1", "s1", "{}").columns[-3:] == ["rule_version", "score_version", "query"]
