"""Queries over files: the given tables are written in a source's format, read back by its reader, and compared with SQL on the tables.

Also the queries of operators that work on events, signatures and routes and that have no query in catalog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reactions import match_formulas, stable_id
from ..operators import abundance as ab
from ..operators import network as nw
from ..operators import occurrences as oc
from ..operators import paths as pt
from ..operators import replicates as rp
from ..operators import space as sp
from ..session import cut, scratch
from ..sources import audits, readers, sinks
from . import adapters as ad
from .catalog import PATHS, SQL, A, E, N, X, _abundance, _edges, _r, query


def _text(rows: DataFrame, value) -> str:
    """Write one line a row; the folder."""
    path = scratch(rows.sparkSession)
    rows.select(value.alias("value")).write.text(path)
    return path


def _csv(rows: DataFrame) -> str:
    path = scratch(rows.sparkSession)
    sinks.write(rows, path, "csv")
    return path


@query("SELECT k AS reaction_key, tp FROM m", N)
def reaction_file(spark, d):
    """Reactions written as lines '<tp> A+B->C+D'."""
    path = _text(ad.network(spark, d), F.concat_ws(" ", "tp", "reaction_key"))
    rows = readers.read_reactions(spark, path)
    return nw.merge_reactions(rows).select("reaction_key", "tp")


@query("SELECT t AS timestep, smi AS smiles, n AS count FROM a", A)
def abundance_file(spark, d):
    """Abundances written as a line for each timestep."""
    merged = _abundance(spark, d)[0]
    pairs = F.array_join(F.collect_list(F.concat_ws(" ", "smiles", "count")), " ")
    path = _text(merged.groupBy("timestep").agg(pairs.alias("p")), F.concat(F.lit("Timestep "), "timestep", F.lit(": "), "p"))
    return readers.read_abundance(spark, path).select("timestep", "smiles", "count")


@query("SELECT 'sys' AS system, 'one' AS replicate, t * 0.5::DOUBLE AS time, formula AS species, sum(n)::BIGINT AS count FROM a JOIN dim USING (smi) GROUP BY ALL", A)
def tidy_table(spark, d):
    """Abundances by formula as the name of a species, over time in ps."""
    merged, dim = _abundance(spark, d)
    names = dim.select("smiles", F.col("formula").alias("name"))
    return readers.tidy_abundance(merged, "sys", "one", "ps", 0.5, names)


@query("SELECT 'd' AS dataset, t::DOUBLE AS time, smi AS species, n AS count FROM a", A)
def tidy_file(spark, d):
    path = _csv(_abundance(spark, d)[0].select(F.lit("d").alias("dataset"), F.col("timestep").alias("time"), F.col("smiles").alias("species"), "count"))
    return readers.read_tidy(spark, path)


@query("SELECT s AS system, t AS timestep, smi AS smiles, n AS count FROM a, (VALUES ('one'), ('two')) v(s)", A)
def labelled_files(spark, d):
    """Two sources with labels of their own."""
    merged = _abundance(spark, d)[0]
    pairs = F.array_join(F.collect_list(F.concat_ws(" ", "smiles", "count")), " ")
    path = _text(merged.groupBy("timestep").agg(pairs.alias("p")), F.concat(F.lit("Timestep "), "timestep", F.lit(": "), "p"))
    return readers.labelled_abundance(spark, [("one", "1", path), ("two", "1", path)]).select("system", "timestep", "smiles", "count")


@query("SELECT t AS transition, k AS reaction_key, count(*) AS n FROM ev GROUP BY 1, 2", E)
def event_file(spark, d):
    rows = ad.event_nodes(spark, d).select(F.col("t").alias("Timestep_Index"), F.get("reactants", F.lit(0)).alias("Reactant"), F.get("products", F.lit(0)).alias("Product"))
    read = readers.timed_events(spark, "d", events=_csv(rows))
    return read.groupBy("transition", "reaction_key").agg(F.count("*").alias("n"))


@query("SELECT dense_rank() OVER (ORDER BY t) - 1 AS frame, t AS timestep, now AS species, (user_id + 1)::VARCHAR AS atom_ids, (user_id + 1) || '-' || (user_id + 2) || '-1' AS bonds FROM dy", E)
def molecule_file(spark, d):
    """Users of a day as molecules of one atom, with a bond to the next one."""
    days = ad.table(spark, d, "events").groupBy("user_id", F.date_diff(F.col("ts").cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("Timestep")).agg(F.max_by("event_type", "ts").alias("Species"))
    path = _csv(days.select("Timestep", "Species", F.concat(F.col("user_id"), F.lit(";")).alias("AtomIDs"), F.concat("user_id", F.lit("-"), F.col("user_id") + 1, F.lit("-1;")).alias("BondIDs")))
    rows = readers.read_molecules(spark, path, "d")
    bonds = F.transform("bonds", lambda b: F.concat_ws("-", b["a"], b["b"], b["order"]))
    return rows.select("frame", "timestep", "species", F.array_join(F.col("atom_ids").cast("array<string>"), ";").alias("atom_ids"), F.array_join(bonds, ";").alias("bonds"))


def _timeline(spark, d: str, path: str, faulty: bool = False) -> None:
    """Native evidence of the events: a frame for each day with changes, and one more."""
    nodes = ad.event_nodes(spark, d)
    days = oc.ranked(nodes.select("t").distinct(), [F.col("t")], "n").select("t", (F.col("n") - 1).cast("bigint").alias("transition_index"))
    end = days.agg((F.max("transition_index") + 1).alias("source_frame"), (F.max("t") + 1).alias("timestep"))
    frames = days.select(F.col("transition_index").alias("source_frame"), F.col("t").alias("timestep")).unionByName(end)
    keys = oc.ranked(nodes.groupBy("reaction_key", "reactants", "products").agg(F.count("*").alias("total_count")), [F.col("reaction_key")], "reaction_id")
    counts = nodes.groupBy("t", "reaction_key").agg(F.count("*").alias("count")).join(keys, "reaction_key").join(days, "t")
    users = nodes.select(F.explode("consumed").alias("c"), "t").select(F.col("c.atoms").cast("bigint").alias("molecule_id"), "t").join(days, "t")
    tables = {
        "frames": frames.select(F.lit(0).alias("source_id"), "source_frame", "timestep"),
        "reaction_types": keys.select("reaction_id", F.get("reactants", F.lit(0)).alias("reactant"), F.get("products", F.lit(0)).alias("product"), "total_count"),
        "reaction_events": counts.select("transition_index", "reaction_id", "count"),
        "species": spark.range(1).select(F.lit(1).alias("species_id"), F.lit("user").alias("name")),
        "molecules": users.select("molecule_id").distinct().select("molecule_id", F.lit(1).alias("species_id"), F.array("molecule_id").alias("atom_ids"), F.expr("cast(array() as array<struct<a:bigint,b:bigint,order:int>>)").alias("bonds")),
        "molecule_ranges": users.groupBy("molecule_id").agg(F.min("transition_index").alias("start_frame"), F.max("transition_index").alias("end_frame")),
    }
    if faulty:  # one reaction without a type, users without a molecule, and each range twice
        tables["reaction_types"] = tables["reaction_types"].where("reactant <> 'click' or product <> 'view'")
        tables["molecules"] = tables["molecules"].where("molecule_id % 7 <> 0")
        tables["molecule_ranges"] = tables["molecule_ranges"].union(tables["molecule_ranges"])
    for name, rows in tables.items():
        rows.select(*[F.col(c).cast(t) for c, t in rows.sparkSession.createDataFrame([], readers.TIMELINE[name]).dtypes]).write.parquet(f"{path}/{name}.parquet")


@query("SELECT dense_rank() OVER (ORDER BY t) - 1 AS transition, k AS reaction_key, 'timeline' AS source_kind FROM ev", E)
def timeline_source(spark, d):
    """Events of native evidence, which passes its audit; a row for each occurrence."""
    path = scratch(spark)
    _timeline(spark, d, path)
    return readers.timed_events(spark, "d", timeline=path).select("transition", "reaction_key", "source_kind")


@query(
    """SELECT 'unknown reaction id' AS rule, count(DISTINCT t) AS n FROM ev WHERE k = 'click->view' UNION ALL SELECT 'unknown molecule id', 2 * count(DISTINCT user_id) FROM ev WHERE user_id % 7 = 0
UNION ALL SELECT 'ranges overlap', count(DISTINCT user_id) FROM ev""",
    E,
)
def timeline_audit(spark, d):
    """What the audit finds in evidence with planted faults."""
    path = scratch(spark)
    _timeline(spark, d, path, faulty=True)
    return audits.audit_timeline(readers.read_timeline(spark, path)).groupBy("rule").agg(F.count("*").alias("n"))


@query(
    """SELECT t AS timestep, id, CASE WHEN id % 3 = 0 THEN 'O' ELSE 'C' END AS element, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, n AS n_atoms, 20.0 + t % 3 AS ax, t % 7 - 3.0 AS bx, 19.0 AS "by", 2.5 AS cx, -4.0 * (t % 4) AS cy, 21.0 AS cz, t % 5 <> 4 AS periodic
FROM mv JOIN (SELECT t, count(*) AS n FROM mv GROUP BY 1) USING (t)""",
    ad.MOVING_SQL,
)
def trajectory_file(spark, d):
    """Frames written as a text dump of one block each: tilted boxes, scaled coordinates in the odd ones, elements by type."""
    atoms, boxes = ad.moving_atoms(spark, d)
    rows = atoms.join(boxes, "timestep")
    at = lambda c, i: F.get(c, F.lit(i))
    sz = (F.col("z") - at("origin", 2)) / at("c", 2)
    sy = (F.col("y") - at("origin", 1) - sz * at("c", 1)) / at("b", 1)
    sx = (F.col("x") - at("origin", 0) - sz * at("c", 0) - sy * at("b", 0)) / at("a", 0)
    scaled = F.col("timestep") % 2 == 1
    line = F.concat_ws(" ", F.col("id") % 3 + 1, "id", *[F.when(scaled, s).otherwise(F.col(c)) for s, c in ((sx, "x"), (sy, "y"), (sz, "z"))])
    frames = rows.groupBy("timestep").agg(F.count("*").alias("n"), F.array_join(F.collect_list(line), "\n").alias("body"), *[F.first(c).alias(c) for c in ("a", "b", "c", "origin")])
    xy, xz, yz = at("b", 0), at("c", 0), at("c", 1)
    least, most = lambda *c: F.least(F.lit(0.0), *c), lambda *c: F.greatest(F.lit(0.0), *c)
    bound = lambda i, edge, lo, hi, tilt: F.concat_ws(" ", at("origin", i) + lo, at("origin", i) + edge + hi, tilt)
    bounds = F.concat_ws("\n", bound(0, at("a", 0), least(xy, xz, xy + xz), most(xy, xz, xy + xz), xy), bound(1, at("b", 1), least(yz), most(yz), xz), bound(2, at("c", 2), F.lit(0.0), F.lit(0.0), yz))
    head = F.concat(F.lit("ITEM: UNITS\nreal\nITEM: TIMESTEP\n"), "timestep", F.lit("\nITEM: NUMBER OF ATOMS\n"), "n", F.lit("\nITEM: BOX BOUNDS xy xz yz pp pp "), F.when(F.col("timestep") % 5 == 4, "ff").otherwise("pp"), F.lit("\n"), bounds, F.lit("\nITEM: ATOMS type id "), F.when(scaled, "xs ys zs").otherwise("x y z"), F.lit("\n"), "body")
    read, rows = readers.read_trajectory(spark, _text(frames, head), {1: "O", 2: "C", 3: "C"})
    boxed = read.where("error is null").select("timestep", "n_atoms", *[_r(at(v, i)).alias(v + "xyz"[i]) for v, i in (("a", 0), ("b", 0), ("b", 1), ("c", 0), ("c", 1), ("c", 2))], at("pbc", 2).alias("periodic"))
    return rows.join(boxed, "timestep").select("timestep", "id", "element", *[_r(c).alias(c) for c in "xyz"], "n_atoms", "ax", "bx", "by", "cx", "cy", "cz", "periodic")


@query(
    """, s AS (SELECT rep, t, row_number() OVER (PARTITION BY rep ORDER BY t, id) + CASE WHEN t % 11 = 0 THEN -9 ELSE 0 END + CASE WHEN t > 700 THEN 5 ELSE 0 END AS n FROM ev)
SELECT 'events out of order' AS rule, count(*) AS n FROM (SELECT t, max(t) OVER (PARTITION BY rep ORDER BY n RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s) WHERE m > t
UNION ALL SELECT 'source row given twice', count(*) FROM (SELECT rep, n FROM s GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'source rows missing', count(*) FROM (SELECT n - lag(n) OVER (PARTITION BY rep ORDER BY n) AS g FROM s) WHERE g > 1""",
    E,
)
def event_audit(spark, d):
    """Faults of a source whose rows of every eleventh day have moved ahead, and which has a gap behind day 700."""
    rows = ad.occurrences(spark, d)
    number = oc.numbered(rows.withColumn("part", F.floor(F.col("transition") / 8)), ["dataset"], "part", ["transition", "event_id"], "n")
    moved = F.col("n").cast("long") + F.when(F.col("transition") % 11 == 0, -9).otherwise(0) + F.when(F.col("transition") > 700, 5).otherwise(0)
    return audits.audit_events(number.withColumn("source_row", moved), 16).groupBy("rule").agg(F.count("*").alias("n"))


@query("SELECT t AS timestep, " + ", ".join(f"coalesce(sum(n) FILTER (smi = '{s}'), 0)::BIGINT AS s{i}" for i, s in enumerate(("[C]", "[C][O]", "[C][C]"))) + " FROM a GROUP BY 1", A)
def evolution_export(spark, d):
    """Counts of three species, a column each, by timestep."""
    names = {"[C]": "s0", "[C][O]": "s1", "[C][C]": "s2"}
    merged = _abundance(spark, d)[0]
    labels = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    series = merged.join(ab.frames(merged), "timestep").select("frame", "timestep", F.coalesce(labels[F.col("smiles")], F.lit("other")).alias("series"), "count")
    return sinks.evolution_table(series, list(names.values())).fillna(0, list(names.values())).select("timestep", *[F.col(c).cast("long").alias(c) for c in names.values()])


# Species and reactions


@query("SELECT smi AS smiles, total AS total_count, peak AS peak_count FROM su WHERE contains(lower(smi), lower('[c][O]'))", A)
def smiles_search(spark, d):
    """Species whose SMILES contains a carbon next to an oxygen, asked for in mixed case."""
    return ab.search_smiles(ab.species_summary(_abundance(spark, d)[0]), "[c][O]").select("smiles", "total_count", "peak_count")


def _formulas(spark, d) -> DataFrame:
    merged = ad.network(spark, d)
    dim = nw.sides(merged).select("species").distinct()
    from ..functions.species import species_dim

    return nw.reaction_dim(merged, species_dim(dim, "species").withColumnRenamed("species", "smiles"))


_SIDES = ", rf AS (SELECT k, tp, (SELECT list(formula) FROM dim, unnest(m.r) u(x) WHERE smi = x) AS lf, (SELECT list(formula) FROM dim, unnest(m.p) u(x) WHERE smi = x) AS pf FROM m)"


@query(_SIDES + " SELECT k AS reaction_key, tp FROM rf WHERE list_sort(lf) = ['C2', 'C3'] AND len(list_filter(pf, lambda x: x = 'C2')) >= 0", N)
def formula_match_exact(spark, d):
    """Reactions whose reactants are exactly one C2 and one C3."""
    rows = _formulas(spark, d)
    return rows.where(match_formulas(F.col("reactants_formulas"), F.col("products_formulas"), {"C2": 1, "C3": 1}, {}, "exact")).select("reaction_key", "tp")


@query(_SIDES + " SELECT k AS reaction_key, tp FROM rf WHERE list_contains(lf, 'C2') AND list_contains(pf, 'C2O')", N)
def formula_match(spark, d):
    """Reactions from something with a C2 to something with a C2O."""
    rows = _formulas(spark, d)
    return rows.where(match_formulas(F.col("reactants_formulas"), F.col("products_formulas"), {"C2": 1}, {"C2O": 1})).select("reaction_key", "tp")


# Events


@query("SELECT rep AS dataset, id AS event_id, t AS transition, k AS reaction_key FROM ev WHERE rep = 'rep1' ORDER BY t, id LIMIT 1", E)
def event_by_id(spark, d):
    """The first event of a replicate, looked up by its id."""
    rows = ad.occurrences(spark, d)
    first = rows.where("dataset = 'rep1'").orderBy("transition", "event_id").first()
    return oc.event_by_id(rows, "rep1", first["event_id"]).select("dataset", "event_id", "transition", "reaction_key")


@query("SELECT rep AS dataset, id AS event_id, side, species, 1 AS ordinal FROM (SELECT rep, id, 'reactant' AS side, was AS species FROM ev UNION ALL SELECT rep, id, 'product', now FROM ev)", E)
def event_terms(spark, d):
    return oc.event_species(ad.occurrences(spark, d)).select("dataset", "event_id", "side", "species", "ordinal")


@query("SELECT k AS reaction_key, unnest(range(1, tp + 1)) AS ordinal, substr(sha1(k || chr(0) || tp), 1, 16) AS id FROM nt", E)
def expanded_counts(spark, d):
    """A row for each occurrence of a counted reaction, with a stable id of the record."""
    rows = oc.expand_counts(ad.event_network(spark, d).withColumnRenamed("tp", "count"))
    return rows.select("reaction_key", "ordinal", stable_id(F.col("reaction_key"), F.col("count")).alias("id"))


@query("SELECT transition, reactants || '->' || products AS reaction_key, 'matched' AS status, atom_ids FROM (" + SQL["changed_components"] + ")")
def associated_events(spark, d):
    """Events of the changed components, associated with the molecules again by net key and order."""
    molecules = ad.paired_molecules(spark, d)
    found = cut(oc.changed_components(molecules))
    events = found
    order = Window.partitionBy("dataset", "transition").orderBy("reactants", "products", "atom_ids")
    events = events.withColumn("source_row", F.row_number().over(order).cast("long")).drop("atom_ids")
    rows = oc.associate(events, molecules, found)
    return rows.select("transition", "reaction_key", "status", F.array_join(F.col("atom_ids").cast("array<string>"), ",").alias("atom_ids"))


@query(
    """, p AS (SELECT x.rep, x.id, x.now AS species, y.k AS nk, row_number() OVER (PARTITION BY x.rep, x.id ORDER BY y.t - x.t, y.id) AS rank FROM ev x JOIN ev y ON x.rep = y.rep AND y.was = x.now AND y.t > x.t),
q AS (SELECT x.k, y.k AS nk, row_number() OVER (PARTITION BY x.k ORDER BY y.tp DESC, y.k) AS rank FROM nt x JOIN nt y ON y.was = x.now AND x.k <> y.k)
SELECT rep AS dataset, id AS event_id, nk AS next_key, rank, 'events' AS evidence_level, true AS can_assert_order FROM p WHERE rank <= 2
UNION ALL SELECT ev.rep, ev.id, q.nk, q.rank, 'network', false FROM ev JOIN q ON ev.k = q.k AND q.rank <= 2 WHERE (ev.rep, ev.id) NOT IN (SELECT (rep, id) FROM p)""",
    E,
)
def event_continuations(spark, d):
    """Up to two continuations of each event, from later events or, where there are none, from the network."""
    rows = ad.occurrences(spark, d)
    anchors = rows.select("dataset", "event_id", "reaction_key", F.explode("products").alias("species"))
    return oc.continuations(rows, ad.event_network(spark, d), anchors, 2).select("dataset", "event_id", "next_key", "rank", "evidence_level", "can_assert_order")


@query("SELECT DISTINCT q.t AS frame, r.user_id AS molecule_id FROM dy r JOIN (SELECT DISTINCT t FROM dy WHERE t % 30 = 0) q ON q.t BETWEEN r.t AND r.t + 2", E)
def members_at_frames(spark, d):
    """Users present (for three days from each active one) on every thirtieth day."""
    days = ad.table(spark, d, "events").select(F.col("user_id").alias("molecule_id"), F.date_diff(F.col("ts").cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("start_frame")).distinct()
    frames = days.select(F.col("start_frame").alias("frame")).where("frame % 30 = 0").distinct()
    return oc.members_at(days.withColumn("end_frame", F.col("start_frame") + 2), frames)


@query(
    """, b AS (SELECT user_id, was AS s, count(*) AS n FROM ev GROUP BY 1, 2), a AS (SELECT user_id, now AS s, count(*) AS n FROM ev GROUP BY 1, 2)
SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN coalesce(a.n, 0) > coalesce(b.n, 0) THEN 'appeared' ELSE 'vanished' END AS change, abs(coalesce(a.n, 0) - coalesce(b.n, 0)) AS n
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.s = b.s WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
    E,
)
def changed_states(spark, d):
    """States that a user has left more often than taken, or the other way round."""
    nodes = ad.event_nodes(spark, d)
    side = lambda c: nodes.select(F.explode(c).alias("i")).select(F.col("i.atoms").cast("long").alias("user_id"), oc.state_key(F.col("i.species"), F.array("i.atoms"), F.array().cast("array<string>")).alias("state"))
    return oc.changed_states(side("consumed"), side("produced"), ("user_id",)).select("user_id", "change", "n")


# Paths


@query("SELECT signature, row_number() OVER (ORDER BY n_replicates DESC, n_atoms DESC, n_occurrences DESC, signature) AS place FROM (" + SQL["path_signatures"] + ") WHERE support >= 0.5 AND n_atoms >= 2 AND split_part(signature, ' => ', 1) <> split_part(signature, ' => ', 3)")
def ranked_signatures(spark, d):
    """Signatures with enough support, without those that return to their first reaction, with their place."""
    rows = pt.filter_signatures(pt.path_signatures(pt.event_paths(*_edges(spark, d), 3)), hide_pure_h=True, hide_return_cycles=True, min_support=0.5, min_lineages=2)
    return oc.ranked(rows, [F.desc("n_replicates"), F.desc("n_atoms"), F.desc("n_occurrences"), F.col("signature")], "place").select("signature", "place")


@query("SELECT rep AS replicate, e1 || ',' || e2 || ',' || e3 AS event_ids, i AS position, string_split(sig, ' => ')[i + 1] AS reaction_key, [e1, e2, e3][i + 1] AS event_id FROM pa, range(3) r(i)", PATHS)
def path_details(spark, d):
    """A row for each event of each path."""
    paths = pt.event_paths(*_edges(spark, d), 3)
    ids = paths.select("path_id", F.array_join("event_ids", ",").alias("event_ids"))
    return pt.path_details(paths).join(ids, "path_id").select("replicate", "event_ids", "position", "reaction_key", "event_id")


@query(
    ", g AS (SELECT sig, e.i AS edge, CASE e.i WHEN 0 THEN y.t - x.t ELSE z.t - y.t END AS gap FROM pa JOIN ev x ON x.rep = pa.rep AND x.id = e1 JOIN ev y ON y.rep = pa.rep AND y.id = e2 JOIN ev z ON z.rep = pa.rep AND z.id = e3, range(2) e(i)) "
    "SELECT sig AS signature, edge, count(*) AS n, min(gap) AS gap_min, median(gap)::DOUBLE AS gap_median, round(avg(gap), 9) AS gap_mean, max(gap) AS gap_max FROM g GROUP BY 1, 2",
    PATHS,
)
def signature_gaps(spark, d):
    return pt.gap_statistics(pt.event_paths(*_edges(spark, d), 3)).withColumn("gap_mean", _r("gap_mean", 9))


@query("SELECT sig AS signature, row_number() OVER (PARTITION BY sig ORDER BY rep, ta, tb, [e1, e2, e3]) AS n_example, rep AS replicate, e1 || ',' || e2 || ',' || e3 AS event_ids FROM pa QUALIFY n_example <= 5", PATHS)
def signature_examples(spark, d):
    """Five paths of every signature."""
    return pt.example_paths(pt.event_paths(*_edges(spark, d), 3)).withColumn("event_ids", F.array_join("event_ids", ","))


def _routes(spark, d) -> tuple[DataFrame, DataFrame]:
    merged = ad.network(spark, d)
    steps = pt.candidate_steps(merged)
    return pt.candidate_paths(steps, nw.sides(merged).select(F.col("species").alias("start")).distinct()), steps


@query("SELECT start, rank, len(string_split(reaction_keys, ' => ')) AS n_steps, string_split(species, ' > ')[-1] AS \"end\", (length(string_split(species, ' > ')[-1]) - length(replace(string_split(species, ' > ')[-1], '[C]', ''))) // 3 = 1 AS small_end FROM (" + SQL["candidate_paths"] + ")")
def path_endings(spark, d):
    """How each candidate route ends, and whether in a fragment of one carbon."""
    from ..functions.species import species_dim

    routes, _ = _routes(spark, d)
    dim = species_dim(nw.sides(ad.network(spark, d)), "species").withColumnRenamed("species", "smiles")
    return pt.path_endings(routes, dim).select("start", "rank", "n_steps", "end", "small_end")


@query(
    "SELECT c.start, c.rank AS path_rank, i + 1 AS step_index, c.species AS path_species, f.k AS reaction_key, 'downstream' AS traversal_direction, split_part(f.k, '->', 1) AS reactants, split_part(f.k, '->', 2) AS products, "
    "string_split(c.species, ' > ')[i + 1] AS focal_input, string_split(c.species, ' > ')[i + 2] AS focal_output, f.tp AS forward_tp, f.rev AS reverse_tp, f.net AS net_tp, 'network_only' AS evidence_status, c.score AS path_score "
    "FROM (" + SQL["candidate_paths"] + ") c, range(3) r(i) JOIN (" + SQL["net_flux"].replace("SELECT k AS reaction_key, tp, rev AS reverse_tp, net AS net_tp, reversible FROM f", "SELECT k, tp, rev, net FROM f") + ") f ON f.k = string_split(c.reaction_keys, ' => ')[i + 1]"
)
def path_export(spark, d):
    """The export of candidate routes, a row for each step."""
    rows = pt.export_steps(*_routes(spark, d))
    return rows.select("start", "path_rank", "step_index", "path_species", "reaction_key", "traversal_direction", "reactants", "products", "focal_input", "focal_output", "forward_tp", "reverse_tp", "net_tp", "evidence_status", _r("path_score", 9).alias("path_score"))


@query(
    """, fo AS (SELECT x.k AS k1, y.k AS k2, list_sort(list_distinct(list_intersect(x.p, y.r))) AS b FROM m x JOIN m y ON len(list_intersect(x.p, y.r)) > 0 WHERE list_contains(x.r, '[C][O]'))
SELECT k1 || ' => ' || k2 AS signature, array_to_string(b, ' | ') AS bridges, (SELECT count(*) FROM fo) > 1000 AS truncated FROM fo ORDER BY k1, k2 LIMIT 1000""",
    N,
)
def bridged_paths(spark, d):
    """The first thousand pairs of reactions from one species on, with the species that link them."""
    rows = pt.reachable_with_bridges(ad.network(spark, d), 2, "[C][O]", 1000)
    return rows.select(F.array_join("reaction_keys", " => ").alias("signature"), F.array_join(F.flatten("bridges"), " | ").alias("bridges"), "truncated")


# Classes, curves, bonds, frames and conditions


@query("SELECT k AS reaction_key, m.tp, arg_min(CASE WHEN l_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END, l_orderkey) AS kind FROM rx JOIN m ON k = array_to_string(rx.r, '+') || '->' || array_to_string(rx.p, '+') GROUP BY 1, 2", N)
def classed_reactions(spark, d):
    """Merged reactions with the class (here, whether its number is even) of the first line of each."""
    rows = ad.reactions(spark, d).withColumn("kind", F.when(F.col("line_no") % 2 == 0, "even").otherwise("odd"))
    return nw.merge_reactions(rows, kind="kind").select("reaction_key", "tp", "kind")


@query(
    """, mb AS (SELECT series, kind, smi, row_number() OVER (PARTITION BY series ORDER BY total DESC, smi) AS i FROM (SELECT smi, sum(n) AS total FROM a GROUP BY 1) JOIN dim USING (smi) JOIN (VALUES ('one', 'smiles', '[C]'), ('two', 'formula', 'C2O'), ('three', 'formula', 'C4ClO3')) v(series, kind, val) ON (kind = 'smiles' AND val = smi) OR (kind = 'formula' AND val = formula)),
nm AS (SELECT series, smi FROM mb UNION ALL SELECT series || '[' || i || ']', smi FROM mb WHERE kind = 'formula')
SELECT series, t AS timestep, sum(n)::BIGINT AS count FROM nm JOIN a USING (smi) GROUP BY 1, 2""",
    A,
)
def split_curves(spark, d):
    """Curves of formulas, added up and by member."""
    merged, dim = _abundance(spark, d)
    targets = spark.createDataFrame([("one", "smiles", "[C]"), ("two", "formula", "C2O"), ("three", "formula", "C4ClO3"), ("none", "formula", "N2")], "series string, kind string, value string")
    return ab.curves(merged, dim, targets, mode="both")[0]


@query(
    """WITH b AS (SELECT l_orderkey AS e, l_returnflag = 'R' AS was, least(l_suppkey % 5, l_partkey % 7) AS x, greatest(l_suppkey % 5, l_partkey % 7) AS y, l_linenumber % 2 + 1 AS o FROM lineitem),
g AS (SELECT e, x, y, o, bool_or(was) AS w, bool_or(NOT was) AS n FROM b GROUP BY ALL)
SELECT e AS event_id, 'reactant' AS state, x AS atom1, y AS atom2, o AS bond_order, CASE WHEN n THEN 'unchanged' ELSE 'broken' END AS change FROM g WHERE w UNION ALL SELECT e, 'product', x, y, o, CASE WHEN w THEN 'unchanged' ELSE 'formed' END FROM g WHERE n"""
)
def bond_table(spark, d):
    """Bonds with their orders on both sides of each event."""
    side = F.when(F.col("l_returnflag") == "R", "before").otherwise("after").alias("side")
    rows = ad.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), side, (F.col("l_suppkey") % 5).alias("atom1"), (F.col("l_partkey") % 7).alias("atom2"), (F.col("l_linenumber") % 2 + 1).alias("bond_order"))
    return oc.bond_table(rows)


@query(
    """WITH e AS (SELECT 'rep' || (user_id % 3) AS ds, event_id, floor(epoch(ts))::BIGINT AS t, event_type FROM events),
f AS (SELECT ds, t, row_number() OVER (PARTITION BY ds ORDER BY t) AS n FROM (SELECT DISTINCT ds, t FROM e WHERE event_type = 'purchase')),
nr AS (SELECT x.ds, x.event_id, arg_min(f.n, (abs(f.t - x.t), f.t)) AS n FROM (SELECT ds, event_id, t FROM e UNION ALL SELECT ds, event_id, t + 3600 FROM e) x JOIN f USING (ds) GROUP BY x.ds, x.event_id, x.t)
SELECT w.ds AS dataset, event_id::VARCHAR AS event_id, f.t AS frame_timestep FROM (SELECT ds, event_id, min(n) AS a, max(n) AS b FROM nr GROUP BY 1, 2) w JOIN f ON f.ds = w.ds AND f.n BETWEEN a - 1 AND b + 2"""
)
def frame_windows(spark, d):
    """Purchases stand for frames: those from one before each event to two behind the hour that follows it."""
    rows = ad.table(spark, d, "events").select(F.concat(F.lit("rep"), F.col("user_id") % 3).alias("dataset"), "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("before_timestep"), "event_type")
    frames = rows.where("event_type = 'purchase'").select("dataset", F.col("before_timestep").alias("timestep")).distinct()
    return sp.frame_window(rows.withColumn("after_timestep", F.col("before_timestep") + 3600), frames, 1, 2)


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'T' || (1000 + o_custkey % 5 * 500) || 'K_O2=0.5' || CASE WHEN o_orderkey % 3 = 0 THEN '_P=2' ELSE '' END ELSE 'runs/case' || (o_custkey % 5) END AS group_key FROM orders"""
)
def condition_groups(spark, d):
    """Groups of conditions by names that hold fields, and by those that don't."""
    fields = F.concat(F.lit("runs/t"), F.col("o_custkey") % 5 * 500 + 1000, F.lit("K_O2-0.5"), F.when(F.col("o_orderkey") % 3 == 0, "_P2.0atm").otherwise(""), F.lit("_rep"), F.col("o_orderkey") % 7)
    name = F.when(F.col("o_orderkey") % 2 == 0, fields).otherwise(F.concat(F.lit("runs/case"), F.col("o_custkey") % 5, F.lit("_seed"), F.col("o_orderkey") % 7))
    return ad.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), rp.group_key(name).alias("group_key"))


# Lattices


def _view_events(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Atoms, boxes, an event at every other frame and the next but one, its participants and its bonds; every other event changes none."""
    atoms, boxes = ad.moving_atoms(spark, d)
    frames = atoms.select("timestep").distinct()
    events = frames.where("timestep % 2 = 0").join(frames.select((F.col("timestep") - 2).alias("timestep")), "timestep")
    events = events.select(F.lit("d").alias("dataset"), F.col("timestep").alias("event_id"), F.col("timestep").alias("before_timestep"), (F.col("timestep") + 2).alias("after_timestep"), (F.col("timestep") + 2).alias("anchor_timestep"))
    ids = spark.range(50).select("id")
    participants = events.select("event_id", (F.col("event_id") % 7).alias("m")).join(ids.withColumn("m", F.col("id") % 7), "m").select("event_id", "id")
    side = lambda name, lo, hi: participants.where((F.col("id") >= lo) & (F.col("id") < hi) & (F.col("event_id") % 4 != 0)).select("event_id", F.lit(name).alias("side"), F.col("id").alias("atom1"), (F.col("id") + 7).alias("atom2"), F.lit(1).alias("bond_order"))
    return atoms, boxes, events, participants, oc.bond_table(side("before", 0, 14).union(side("after", 7, 21)))


_VIEW = """
, ev AS (SELECT DISTINCT t AS e FROM mv WHERE t % 2 = 0 AND t + 2 IN (SELECT t FROM mv)),
pt AS (SELECT e, id FROM ev, range(50) r(id) WHERE id % 7 = e % 7),
nr AS (SELECT e, m.id, min(pow(m.x - q.x + sx, 2) + pow(m.y - q.y + sy, 2) + pow(m.z - q.z + sz, 2)) AS d2
       FROM pt JOIN mv q ON q.t = e + 2 AND q.id = pt.id JOIN mv m ON m.t = e + 2 JOIN im ON im.t = e + 2 WHERE (e, m.id) NOT IN (SELECT (e, id) FROM pt) GROUP BY 1, 2 HAVING d2 <= 25),
en AS (SELECT e, id, d2, count(*) OVER (PARTITION BY e) AS n FROM nr QUALIFY row_number() OVER (PARTITION BY e ORDER BY d2, id) <= 12)
"""


@query("SELECT e AS event_id, id, round(sqrt(d2), 6) AS dist, n AS n_raw, n > 12 AS truncated FROM en", ad.MOVING_SQL + _VIEW)
def lattice_environment(spark, d):
    """The twelve atoms next to several ones, in tilted boxes that differ from frame to frame."""
    atoms, boxes, events, participants, _ = _view_events(spark, d)
    cores = participants.join(events.select("event_id", F.col("anchor_timestep").alias("timestep")), "event_id")
    return sp.local_environment(atoms, cores, boxes, 5.0, 12).withColumn("dist", _r("dist"))


@query(
    """, co AS (SELECT e, id FROM pt WHERE e % 4 = 0 OR id < 28),
sel AS (SELECT e, id, mv.t, x, y, z FROM (SELECT e, id FROM pt UNION SELECT e, id FROM en) JOIN mv USING (id) WHERE mv.t BETWEEN e - 1 AND e + 3),
cm AS (SELECT e, t, id, x, y, z FROM sel JOIN co USING (e, id)),
o AS (SELECT e, t, x AS ox, y AS oy, z AS oz FROM cm QUALIFY row_number() OVER (PARTITION BY e, t ORDER BY id) = 1),
un AS (SELECT e, t, id, x, y, z, x + sx AS ux, y + sy AS uy, z + sz AS uz FROM cm JOIN o USING (e, t) JOIN im USING (t)
       QUALIFY row_number() OVER (PARTITION BY e, t, id ORDER BY pow(x + sx - ox, 2) + pow(y + sy - oy, 2) + pow(z + sz - oz, 2)) = 1),
ce AS (SELECT e, t, avg(ux) AS mx, avg(uy) AS my, avg(uz) AS mz FROM un GROUP BY 1, 2),
best AS (SELECT s.e, s.t, s.id, s.x, s.y, s.z, ux + (s.x - un.x + sx) AS px, uy + (s.y - un.y + sy) AS py, uz + (s.z - un.z + sz) AS pz FROM sel s JOIN un USING (e, t) JOIN im USING (t)
         QUALIFY row_number() OVER (PARTITION BY s.e, s.t, s.id ORDER BY pow(s.x - un.x + sx, 2) + pow(s.y - un.y + sy, 2) + pow(s.z - un.z + sz, 2), un.id) = 1)
SELECT e AS event_id, t AS timestep, id, round(x, 6) AS x, round(px - mx, 5) + 0.0::DOUBLE AS display_x, round(py - my, 5) + 0.0::DOUBLE AS display_y, round(pz - mz, 5) + 0.0::DOUBLE AS display_z,
       CASE WHEN (e, id) IN (SELECT (e, id) FROM co) THEN 'core' WHEN (e, id) IN (SELECT (e, id) FROM pt) THEN 'participant' ELSE 'environment' END AS scope,
       CASE WHEN t <= e THEN 'before' WHEN t >= e + 2 THEN 'after' ELSE 'intermediate' END AS bond_state FROM best JOIN ce USING (e, t)""",
    ad.MOVING_SQL + _VIEW,
)
def local_view(spark, d):
    """Events with several core atoms, in all frames from one before to one behind."""
    atoms, boxes, events, participants, bonds = _view_events(spark, d)
    windows = sp.frame_window(events, atoms.select(F.lit("d").alias("dataset"), "timestep").distinct(), 1, 1).select("event_id", F.col("frame_timestep").alias("timestep"))
    rows = sp.local_view(atoms, boxes, events, windows.withColumn("event_id", F.col("event_id").cast("long")), participants, bonds, 5.0, 12)
    return rows.select("event_id", "timestep", "id", _r("x").alias("x"), *[(_r(f"display_{c}", 5) + 0.0).alias(f"display_{c}") for c in "xyz"], "scope", "bond_state")
