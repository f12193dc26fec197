"""Queries of several datasets, searches, recommendations, endings and grouped comparisons, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reactions import radical_subclass
from ..functions.species import species_dim, strict_formula
from ..operators import abundance as ab
from ..operators import network as nw
from ..operators import occurrences as oc
from ..operators import paths as pt
from ..operators import replicates as rp
from ..session import cut, scratch
from ..sources import readers, sinks
from . import adapters as ad
from .catalog import RDIM, SQL, A, E, N, R, _abundance, _net_dim, _r, query

# Several datasets


def _datasets(spark, d) -> tuple[DataFrame, DataFrame]:
    """The abundances of each return flag as a dataset."""
    c, o = (F.col("p_size") % 7 + 1).cast("int").alias("c"), (F.col("p_partkey") % 4).cast("int").alias("o")
    smiles = F.concat(F.expr("repeat('[C]', c)"), F.expr("repeat('[O]', o)"))
    species = ad.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), c, o).select("l_partkey", smiles.alias("smiles"))
    lines = ad.table(spark, d, "lineitem").select("l_partkey", F.col("l_returnflag").alias("dataset"), ((F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate") - 1).cast("long").alias("timestep"))
    merged = ab.merge_counts(lines.groupBy("dataset", "l_partkey", "timestep").agg(F.count("*").alias("count")).join(species, "l_partkey"), ("dataset", "timestep", "smiles"))
    return merged, species_dim(merged)


D = """
sp AS (SELECT p_partkey, repeat('[C]', (p_size % 7 + 1)::INT) || repeat('[O]', (p_partkey % 4)::INT) AS smi, (p_size % 7 + 1)::INT AS c, (p_partkey % 4)::INT AS o FROM part),
a AS (SELECT l_returnflag AS ds, ((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1)::BIGINT AS t, smi, any_value(c) AS c, any_value(o) AS o, count(*) AS n FROM lineitem JOIN sp ON l_partkey = p_partkey GROUP BY 1, 2, 3),
fr AS (SELECT ds, t, row_number() OVER (PARTITION BY ds ORDER BY t) - 1 AS frame, count(*) OVER (PARTITION BY ds) AS nf FROM (SELECT DISTINCT ds, t FROM a))
"""


@query(
    """, sa AS (SELECT DISTINCT ds, frame FROM (SELECT ds, nf, CASE WHEN nf > 20 THEN round_even(i * (nf - 1) / 19, 0)::BIGINT ELSE i END AS frame FROM (SELECT DISTINCT ds, nf FROM fr), range(100) r(i) WHERE i < 20 OR (nf <= 20 AND i < nf))),
g AS (SELECT ds, t, CASE WHEN c >= 6 THEN 'large' ELSE 'C' || (c // 2) * 2 || '-' || ((c // 2) * 2 + 1) END AS label, sum(n)::BIGINT AS n FROM a JOIN fr USING (ds, t) JOIN sa USING (ds, frame) WHERE o > 0 GROUP BY ALL)
SELECT ds AS dataset, t AS timestep, label, n AS raw_count, round(avg(n) OVER (PARTITION BY ds, label ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 9) AS count FROM g""",
    D,
)
def dataset_bins(spark, d):
    """Bins of carbon in oxygen species, in twenty frames of each dataset, smoothed over three."""
    rows = ab.distribution_model(*_datasets(spark, d), "C", present=("O",), max_points=20, width=2, groups=[("large", 6, None)], window=3)
    return rows.withColumn("count", _r("count", 9))


@query(
    """, s0 AS (SELECT ds, smi, sum(n)::BIGINT AS total, max(n) AS peak, arg_min(t, (-n, t)) AS peak_t, coalesce(sum(n) FILTER (t = t0), 0)::BIGINT AS n0, coalesce(sum(n) FILTER (t = t1), 0)::BIGINT AS n1 FROM a JOIN (SELECT ds, min(t) AS t0, max(t) AS t1 FROM a GROUP BY 1) USING (ds) GROUP BY 1, 2),
hm AS (SELECT ds, smi, max(k) AS fwhm FROM (SELECT ds, smi, g, count(*) AS k FROM (SELECT a.ds, a.smi, frame - row_number() OVER (PARTITION BY a.ds, a.smi ORDER BY frame) AS g FROM a JOIN fr USING (ds, t) JOIN s0 ON s0.ds = a.ds AND s0.smi = a.smi WHERE n * 2 >= peak) GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT ds AS dataset, smi AS smiles, total AS total_count, peak AS peak_count, peak_t AS peak_timestep, n0 AS start_count, n1 AS end_count, fwhm AS fwhm_frames FROM s0 JOIN hm USING (ds, smi)""",
    D,
)
def dataset_summaries(spark, d):
    return ab.species_summary(_datasets(spark, d)[0], ("dataset",))


@query("SELECT ds AS dataset, max(nf) AS n_frames, min(t) AS first_timestep, max(t) AS last_timestep, CASE WHEN count(DISTINCT s) = 1 THEN max(s) END AS uniform_step FROM (SELECT *, t - lag(t) OVER (PARTITION BY ds ORDER BY t) AS s FROM fr) GROUP BY 1", D)
def dataset_timelines(spark, d):
    return ab.timeline_summary(_datasets(spark, d)[0], ("dataset",))


@query("SELECT ds AS dataset, t AS timestep, frame FROM fr WHERE frame % 7 = 0 OR frame = nf - 1", D)
def every_seventh_frame(spark, d):
    """Every seventh frame of each dataset and the last one."""
    return ab.every_nth(ab.frames(_datasets(spark, d)[0], ("dataset",)), 7, ("dataset",))


@query(
    """, c AS (SELECT smi, t, n, n - lag(n) OVER (PARTITION BY smi ORDER BY t) AS d FROM a)
SELECT smi AS smiles, coalesce(string_agg(t, ',' ORDER BY t) FILTER (d < 0), '') AS consumption_frames, coalesce(string_agg(t, ',' ORDER BY t) FILTER (d > 0), '') AS production_frames, max(n) AS peak_count FROM c GROUP BY 1""",
    A,
)
def change_frame_lists(spark, d):
    """At which timesteps each species falls and rises."""
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return ab.change_frame_lists(_abundance(spark, d)[0]).select("smiles", text("consumption_frames"), text("production_frames"), "peak_count")


# Searches


@query("SELECT s AS smiles, 0 AS total_count, formula, 'reactions' AS source FROM stats JOIN dim ON s = smi WHERE contains(lower(s), '[c][o]')", N)
def reaction_only_species(spark, d):
    """A search in mixed case that no species of the frames fits: the summary is that of the species without oxygen."""
    merged, dim = _net_dim(spark, d)
    summary = ab.species_summary(ab.merge_counts(ad.abundance(spark, d)).where("not contains(smiles, '[O]')"))
    rows = ab.search_species(summary, dim, "smiles", "[c][O]", nw.species_stats(merged))
    return rows.select("smiles", F.col("total_count").cast("long").alias("total_count"), "formula", "source")


@query(
    """, st AS (SELECT repeat('[C]', (p_size % 3 + 1)::INT) || repeat('[O]', (p_partkey % 2)::INT) AS s FROM part)
SELECT smi AS smiles, total AS total_count, peak AS peak_count, peak_t AS peak_timestep FROM su WHERE contains(smi, '[Cl]') UNION ALL SELECT DISTINCT s, 0, 0, NULL::BIGINT FROM st""",
    A,
)
def catalogue_with_reactions(spark, d):
    """The chlorine species of the frames and all species of the reactions, the latter at abundance 0."""
    summary = ab.species_summary(_abundance(spark, d)[0]).where("contains(smiles, '[Cl]')")
    stats = ad.table(spark, d, "part").select((F.col("p_size") % 3 + 1).cast("int").alias("c"), (F.col("p_partkey") % 2).cast("int").alias("o")).select(ad._smiles(F.col("c"), F.col("o")).alias("species")).distinct()
    return ab.catalogue(summary, species_dim(summary), stats).select("smiles", "total_count", "peak_count", "peak_timestep")


@query("SELECT formula, round(mass, 6) AS exact_mass, nominal AS nominal_mass, sum(total)::BIGINT AS total_count, count(*) AS n_species, round(mass - 60.0, 6) AS mass_error, arg_min(smi, (-total, smi)) AS smiles FROM su JOIN dim USING (smi) WHERE abs(mass - 60.0::DOUBLE) <= 4 GROUP BY ALL", A)
def mass_catalogue(spark, d):
    """Formulas within four of mass 60."""
    merged, dim = _abundance(spark, d)
    rows = ab.search_species(ab.species_summary(merged), dim, "mass", "60", tolerance=4.0)
    return rows.select("formula", _r("exact_mass").alias("exact_mass"), "nominal_mass", "total_count", "n_species", _r("mass_error").alias("mass_error"), "smiles")


@query(
    """, q AS (SELECT DISTINCT repeat('[C]', (p_size % 5 + 1)::INT) || repeat('[O]', (p_partkey % 2)::INT) AS s, p_size % 5 + 1 AS c, p_partkey % 2 AS o FROM part)
SELECT q.s AS smiles, 'C' || CASE WHEN c > 1 THEN c::VARCHAR ELSE '' END || CASE o WHEN 1 THEN 'O' ELSE '' END AS formula, round(12.0::DOUBLE * c + 15.99491461957::DOUBLE * o, 6) AS exact_mass, 12 * c + 16 * o AS nominal_mass,
       coalesce(tc, 0) AS tp_consume, coalesce(tpr, 0) AS tp_produce, coalesce(thr, 0) AS throughput, coalesce(nc, 0) AS n_consume, coalesce(np, 0) AS n_produce FROM q LEFT JOIN stats ON stats.s = q.s""",
    N,
)
def species_details(spark, d):
    """Species of the network, and larger ones that it doesn't have."""
    part = ad.table(spark, d, "part").select((F.col("p_size") % 5 + 1).cast("int").alias("c"), (F.col("p_partkey") % 2).cast("int").alias("o"))
    rows = nw.species_detail(part.select(ad._smiles(F.col("c"), F.col("o")).alias("smiles")), nw.species_stats(ad.network(spark, d)))
    return rows.withColumn("exact_mass", _r("exact_mass"))


@query(
    """, o AS (SELECT k, tp, string_split(rf, '+') AS rl, string_split(pf, '+') AS pl, list_filter(string_split(rf, '+'), lambda x: x <> 'C') AS o FROM rd JOIN m USING (k))
SELECT k AS reaction_key, CASE WHEN list_contains(o, 'CO') THEN '+ CO -> ' WHEN len(list_filter(o, lambda x: contains(x, 'C'))) > 0 THEN '+ ' || list_filter(o, lambda x: contains(x, 'C'))[1] || ' -> ' ELSE '-> ' END || array_to_string(pl, ' + ') AS subclass FROM o""",
    N + RDIM,
)
def radical_subclasses(spark, d):
    merged, dim = _net_dim(spark, d)
    rows = nw.reaction_dim(merged, dim)
    return rows.select("reaction_key", radical_subclass(F.col("reactants_formulas"), F.col("products_formulas"), "C", ("C", "CO")).alias("subclass"))


# Events and paths


@query(
    """, q AS (SELECT rep, k, id, t, ok AND (rep, t) IN (SELECT (rep, t) FROM ev) AND (rep, t + 1) IN (SELECT (rep, t) FROM ev) AS ready FROM ev),
z AS (SELECT *, CASE WHEN ready AND t % 3 = 0 THEN 0 WHEN ready THEN 1 ELSE 2 END AS tier FROM q)
SELECT rep AS dataset, k AS reaction_key, id AS event_id, tier, ['recommended', 'reviewable', 'unavailable'][tier + 1] AS recommendation, row_number() OVER (PARTITION BY rep, k ORDER BY tier, t, id) AS rank, CASE WHEN t % 3 = 0 THEN '1,2,3' ELSE '' END AS changed_atoms FROM z""",
    E,
)
def recommended_events(spark, d):
    """Events by what can be checked of them: every third day one bond breaks and one forms, on the next days bonds stay, and then there are none."""
    rows = ad.occurrences(spark, d)
    frames = rows.select("dataset", F.col("transition").alias("frame")).distinct()
    bond = lambda side, a, b: F.struct(F.lit(side).alias("side"), F.lit(a).cast("long").alias("atom1"), F.lit(b).cast("long").alias("atom2"), F.lit(1).alias("bond_order"))
    some = F.when(F.col("transition") % 3 == 0, F.array(bond("before", 1, 2), bond("after", 3, 2), bond("before", 7, 8), bond("after", 8, 7))).when(F.col("transition") % 3 == 1, F.array(bond("before", 4, 5), bond("after", 5, 4)))
    bonds = oc.bond_table(rows.select("event_id", F.explode(some).alias("b")).select("event_id", "b.*"))
    ranked = oc.representative_events(rows, frames, bonds)
    return ranked.select("dataset", "reaction_key", "event_id", "tier", "recommendation", "rank", F.array_join(F.col("changed_atoms").cast("array<string>"), ",").alias("changed_atoms"))


@query(
    """, cp AS (SELECT start, rank, string_split(species, ' > ') AS sp, string_split(reaction_keys, ' => ') AS ks FROM (%s)),
st AS (SELECT start, rank, i, j, sp[i + 1] AS focal, string_split(split_part(ks[i + 1], '->', 2), '+')[j + 1] AS made FROM cp, range(3) r(i), range(2) q(j) WHERE i < len(ks)),
sm AS (SELECT *, (length(focal) - length(replace(focal, '[C]', ''))) // 3 AS fc, (length(made) - length(replace(made, '[C]', ''))) // 3 AS mc FROM st WHERE made IS NOT NULL),
fg AS (SELECT start, rank, min((i, j)) AS pos, made, min(i) + 1 AS step FROM sm WHERE mc BETWEEN 1 AND 4 AND fc > mc GROUP BY 1, 2, 4),
fs AS (SELECT start, rank, string_agg(i + 1, ',' ORDER BY i) AS steps FROM (SELECT DISTINCT start, rank, i FROM sm WHERE mc BETWEEN 1 AND 4 AND fc > mc) GROUP BY 1, 2),
fl AS (SELECT start, rank, string_agg(made, ',' ORDER BY pos) AS fragments FROM fg GROUP BY 1, 2)
SELECT start, rank, (length(sp[-1]) - length(replace(sp[-1], '[C]', ''))) // 3 AS end_carbon, CASE WHEN (length(sp[-1]) - length(replace(sp[-1], '[C]', ''))) // 3 BETWEEN 1 AND 1 THEN 'small_molecule_goal' WHEN len(ks) >= 3 THEN 'depth_limit' ELSE 'search_truncated' END AS termination,
       split_part(ks[-1], '->', 2) AS terminal_products, coalesce(fragments, '') AS small_fragments, coalesce(steps, '') AS fragmentation_steps, coalesce(split_part(steps, ',', 1)::INT, 0) AS first_step
FROM cp LEFT JOIN fs USING (start, rank) LEFT JOIN fl USING (start, rank)"""
    % SQL["candidate_paths"].replace("WITH", "WITH", 1),
    "one AS (SELECT 1)",
)
def path_fragments(spark, d):
    """How candidate routes end, and in which steps small fragments break off."""
    merged = ad.network(spark, d)
    paths = pt.candidate_paths(pt.candidate_steps(merged), nw.sides(merged).select(F.col("species").alias("start")).distinct())
    dim = species_dim(nw.sides(merged), "species").withColumnRenamed("species", "smiles")
    rows = pt.annotate_endings(paths, dim, 3, target_max_carbon=1, truncated=True)
    text = lambda c, sep=",": F.array_join(F.col(c).cast("array<string>"), sep).alias(c)
    return rows.select("start", "rank", "end_carbon", "termination", text("terminal_products", "+"), text("small_fragments"), text("fragmentation_steps"), F.coalesce("fragmentation_step", F.lit(0)).alias("first_step"))


@query(
    "SELECT transition, reactants || '->' || products AS reaction_key, 'matched' AS status, atom_ids FROM (" + SQL["changed_components"] + ") WHERE transition % 7 <> 3 UNION ALL SELECT transition, reactants || '->' || products, 'unresolved', NULL FROM (" + SQL["changed_components"] + ") WHERE transition % 7 <> 3 AND transition % 5 = 2"
)
def partly_resolved_events(spark, d):
    """Events of the components without those of every seventh transition, and with those of every fifth given twice: the second ones find no atoms."""
    molecules = ad.paired_molecules(spark, d)
    found = cut(oc.changed_components(molecules))
    order = Window.partitionBy("dataset", "transition").orderBy("copy", "reactants", "products", "atom_ids")
    events = found.where("transition % 7 <> 3").withColumn("copy", F.explode(F.when(F.col("transition") % 5 == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    events = events.withColumn("source_row", F.row_number().over(order).cast("long")).drop("atom_ids", "copy")
    rows = oc.associate(events, molecules, found)
    return rows.select("transition", "reaction_key", "status", F.array_join(F.col("atom_ids").cast("array<string>"), ",").alias("atom_ids"))


@query(
    'SELECT c.start, c.rank AS path_rank, i + 1 AS step_index, c.species AS path_species, s.reaction_key, \'downstream\' AS traversal_direction, s.focal_input, s.focal_output, split_part(s.reaction_key, \'->\', 1) AS reactants, split_part(s.reaction_key, \'->\', 2) AS products, '
    "s.forward_tp, s.reverse_tp, s.net_tp, s.net_share, s.directionality, NULL::DOUBLE AS event_coverage, NULL::DOUBLE AS time_coverage, NULL::BIGINT AS event_total, NULL::BIGINT AS matched_event_total, NULL::BIGINT AS distinct_intervals, c.score AS path_score, s.score AS step_score, "
    "'network_only' AS evidence_status, '7' AS score_version, 'run 1' AS source_references "
    "FROM (" + SQL["candidate_paths"] + ") c, range(3) r(i) JOIN (SELECT DISTINCT * FROM (" + SQL["candidate_steps"] + ")) s ON s.reaction_key = string_split(c.reaction_keys, ' => ')[i + 1] AND s.focal_input = string_split(c.species, ' > ')[i + 1] AND s.focal_output = string_split(c.species, ' > ')[i + 2]"
)
def path_export_full(spark, d):
    """All columns of the export of candidate routes; without evidence those of it are null."""
    merged = ad.network(spark, d)
    steps = pt.candidate_steps(merged)
    routes = pt.candidate_paths(steps, nw.sides(merged).select(F.col("species").alias("start")).distinct())
    rows = pt.export_steps(routes, steps, score_version="7", references="run 1")
    return rows.withColumns({c: _r(c, 9) for c in ("net_share", "directionality", "path_score", "step_score")})


# Grouped comparisons


def _groups(spark, d) -> tuple[DataFrame, DataFrame]:
    """(counts, conditions): regions as groups, nations as numbered replicates."""
    nations = ad.table(spark, d, "nation").join(ad.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("group_name"), F.col("n_name").alias("name"), (F.col("n_nationkey") + 1).alias("replicate"))
    counts = ad.replicate_counts(spark, d).withColumnRenamed("replicate", "name").join(nations, ["group_name", "name"]).drop("name")
    return counts, nations.select("group_name", "replicate", F.col("name").alias("source"))


@query(
    """, rk AS (SELECT k, count(*) FILTER (fwd > 0) / count(*) AS dr, sum(fwd) AS tp, sum(net) AS net, row_number() OVER (ORDER BY count(*) FILTER (fwd > 0) / count(*) DESC, sum(fwd) DESC, k) AS rank FROM tab GROUP BY 1 QUALIFY rank <= 10)
SELECT k AS reaction_key, rank, round(dr, 9) AS detection_rate, tp::BIGINT AS total_tp, rk.net::BIGINT AS total_net_tp, g AS group_name, count(*) AS n_replicates, round(count(*) FILTER (fwd > 0) / count(*), 9) AS group_rate, round(avg(fwd), 9) AS mean_tp, round(coalesce(stddev_samp(fwd), 0), 6) AS std_tp, round(avg(tab.net), 9) AS mean_net_tp
FROM tab JOIN rk USING (k) GROUP BY ALL""",
    R,
)
def grouped_report(spark, d):
    """The ten first changes over all nations, with each region's share."""
    rows = rp.grouped_report(*_groups(spark, d), top=10).select("*", F.explode("groups").alias("g"))
    return rows.select("reaction_key", "rank", _r("detection_rate", 9).alias("detection_rate"), "total_tp", "total_net_tp", "g.group_name", "g.n_replicates", _r("g.detection_rate", 9).alias("group_rate"), _r("g.mean_tp", 9).alias("mean_tp"), _r("g.std_tp").alias("std_tp"), _r("g.mean_net_tp", 9).alias("mean_net_tp"))


@query(
    """WITH n AS (SELECT r_name AS g, n_nationkey + 1 AS i, n_name AS s FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT 'replicate given twice' AS rule, count(*) AS n FROM n WHERE g = 'ASIA' UNION ALL SELECT 'source used twice', count(*) FROM n WHERE g = 'ASIA' UNION ALL SELECT 'bad replicate number', count(*) FROM n WHERE g = 'AFRICA'
UNION ALL SELECT 'no reactions', count(*) FROM n WHERE g IN ('AFRICA', 'EUROPE') UNION ALL SELECT 'replicate without a source', count(*) FROM n WHERE g = 'AMERICA' UNION ALL SELECT 'group without replicates', 1"""
)
def group_faults(spark, d):
    """All that keeps a comparison from being made: in each region something else is wrong."""
    counts, conditions = _groups(spark, d)
    bad = conditions.withColumn("replicate", F.when(F.col("group_name") == "AFRICA", -F.col("replicate")).otherwise(F.col("replicate"))).withColumn("source", F.when(F.col("group_name") != "AMERICA", F.col("source")))
    bad = bad.union(conditions.where("group_name = 'ASIA'")).union(spark.range(1).select(F.lit("empty"), F.lit(None).cast("long"), F.lit(None).cast("string")))
    return rp.audit_groups(bad, counts.where("group_name <> 'EUROPE'")).groupBy("rule").agg(F.count("*").alias("n"))


# Exports and materialised evidence


def _evidence(spark, d) -> dict[str, DataFrame]:
    """Events and abundances written as bucketed tables of a new name, and read again."""
    name = scratch(spark).rsplit("/", 1)[-1].replace("-", "_")
    sinks.write_evidence_tables(name, ad.occurrences(spark, d), _datasets(spark, d)[0], 8)
    return sinks.read_evidence_tables(spark, name)


@query(SQL["adjacent_events"])
def bucketed_neighbours(spark, d):
    """The five nearest later events that consume what each event made, from evidence in buckets."""
    tables = _evidence(spark, d)
    anchors = tables["event_species"].where("side = 'product'").select("dataset", "event_id", "species", "transition").distinct()
    return oc.adjacent_events(tables["occurrences"], anchors, "later", 5, tables["event_species"]).select("dataset", "event_id", "species", "other_id", "gap", "rank")


@query("SELECT nt.k AS reaction_key, tp, count(ev.id) AS n_events, coalesce(min(ev.t), -1) AS first_transition FROM nt LEFT JOIN ev ON ev.k = nt.k GROUP BY 1, 2", E)
def bucketed_check(spark, d):
    """Reactions of the network with all events that bear exactly their key, from evidence in buckets."""
    events = _evidence(spark, d)["occurrences"]
    rows = oc.occurrence_check(ad.event_network(spark, d).select("reaction_key", "tp"), events, 1)
    first = events.groupBy("reaction_key").agg(F.min("transition").alias("t"))
    return rows.join(first, "reaction_key", "left").select("reaction_key", "tp", "n_events", F.coalesce("t", F.lit(-1)).cast("long").alias("first_transition"))


@query(
    """SELECT row_number() OVER (ORDER BY sc DESC, s) AS rank, formula, s AS smiles, thr AS throughput, tpr AS produce_tp, tc AS consume_tp, tpr - tc AS net, nc + np AS hub_score, c + o AS n_heavy, false AS has_ring
FROM (SELECT *, thr * log2(nc + np + 1) AS sc FROM stats JOIN dim ON s = smi WHERE thr >= 10) QUALIFY rank <= 4""",
    N,
)
def ranked_species_table(spark, d):
    """The four first species, written as CSV and read again."""
    merged, dim = _net_dim(spark, d)
    rows = sinks.ranked_species(nw.species_stats(merged), dim, 4)
    sinks.write(rows, path := scratch(spark), "csv")
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query(
    """, t AS (SELECT k, tp, r, p, row_number() OVER (ORDER BY tp DESC, k) AS rank FROM m QUALIFY rank <= 30)
SELECT rank, tp, replace(rf, '+', ' + ') AS reactant_formulas, replace(pf, '+', ' + ') AS product_formulas, array_to_string(r, ' + ') AS reactant_smiles, array_to_string(p, ' + ') AS product_smiles FROM t JOIN rd USING (k)""",
    N + RDIM,
)
def ranked_reactions_table(spark, d):
    return sinks.ranked_reactions(*_net_dim(spark, d), 30)


@query(
    """, c AS (SELECT f.k, rf || '->' || pf AS ch, net, net * (len(list_filter(r, lambda x: x = '[C][C]')) - len(list_filter(p, lambda x: x = '[C][C]'))) AS loss,
      len(list_filter(string_split(rf, '+'), lambda x: x = 'C2')) - len(list_filter(string_split(pf, '+'), lambda x: x = 'C2')) AS ch_c FROM f JOIN rd USING (k) WHERE net > 0 AND list_contains(r, '[C][C]')),
q AS (SELECT * FROM c WHERE loss >= 1 AND ch_c > 0),
g AS (SELECT ch, sum(loss)::BIGINT AS pl, sum(net)::BIGINT AS pn, row_number() OVER (ORDER BY sum(loss) DESC, ch) AS parent_rank FROM q GROUP BY 1 QUALIFY parent_rank <= 6)
SELECT parent_rank, ch AS parent_channel, pl AS parent_net_start_loss, pn AS parent_net_events, row_number() OVER (PARTITION BY ch ORDER BY loss DESC, k) AS branch_rank, round(loss / pl * 100, 3) AS branch_share_pct, k AS branch_reaction, loss AS branch_net_start_loss FROM q JOIN g USING (ch)""",
    N + RDIM,
)
def channel_branch_table(spark, d):
    """The branches of the six channels by which most of a species is lost."""
    merged, dim = _net_dim(spark, d)
    return sinks.channel_branches(nw.initiation_channels(merged, dim, "[C][C]"), 6)


@query(
    """, v AS (SELECT smi AS s, replace(smi, '[Cl]', '') AS can, sum(n)::BIGINT AS n FROM a GROUP BY 1, 2)
SELECT can AS canonical, sum(n) OVER (PARTITION BY can)::BIGINT AS total, row_number() OVER (PARTITION BY can ORDER BY n DESC, s) AS rank, s AS smiles, n AS count FROM v""",
    A,
)
def smiles_variant_table(spark, d):
    """Species with and without chlorine as variants of one; those without are given no canonical form."""
    merged = _abundance(spark, d)[0]
    canonical = merged.where("contains(smiles, '[Cl]')").select("smiles", F.replace("smiles", F.lit("[Cl]"), F.lit("")).alias("canonical")).distinct()
    return sinks.smiles_variants(merged, canonical)


@query("SELECT event_id, timestep, id, scope FROM (" + SQL.get("local_view", "SELECT 1") + ") WHERE scope <> 'environment'")
def participant_atoms(spark, d):
    """The atoms of local views that take part, written by event and read again."""
    from .sources import local_view

    view = sinks.scoped_atoms(local_view(spark, d), "participants").select("event_id", "timestep", "id", "scope")
    sinks.write(view, path := scratch(spark), partition_by=("event_id",))
    return spark.read.schema(view.schema).parquet(path)


@query("SELECT smi AS smiles, total AS total_count, 'rules 1' AS rule_version, 'score 2' AS score_version, '{\"text\": \"cl\"}' AS query FROM su WHERE contains(smi, '[Cl]')", A)
def audited_candidates(spark, d):
    """Candidates with the versions of the rules and the query next to each, written as CSV and read again."""
    rows = ab.search_smiles(ab.species_summary(_abundance(spark, d)[0]), "cl").select("smiles", "total_count")
    rows = sinks.with_query_columns(rows, "rules 1", "score 2", '{"text": "cl"}')
    sinks.write(rows, path := scratch(spark), "csv")
    return spark.read.schema(rows.schema).option("header", True).option("escape", "\\").csv(path)


@query(
    """WITH r AS (SELECT r_regionkey AS i, 'r' || r_regionkey || CASE WHEN r_regionkey % 2 = 0 THEN '/deep' ELSE '' END AS dir FROM region)
SELECT dir AS directory, 'a' || i || '.reactionabcd' AS file FROM r"""
)
def scanned_conditions(spark, d):
    """A folder for each region, some one deeper, all with two reaction files and with a folder inside that doesn't count."""
    root = scratch(spark)
    rows = ad.table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey", F.when(F.col("r_regionkey") % 2 == 0, "/deep").otherwise("")).alias("dir"), "r_regionkey")
    files = rows.select(F.explode(F.array(F.concat("dir", F.lit("/a"), "r_regionkey"), F.concat("dir", F.lit("/b"), "r_regionkey"), F.concat("dir", F.lit("/inside/a"), "r_regionkey"))).alias("f"))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in files.limit(1000).collect():  # three names a region
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{r.f}.reactionabcd")
        out = path.getFileSystem(conf).create(path)
        out.write(10)
        out.close()
    found = readers.scan_conditions(spark, root)
    tail = root.rsplit("/", 1)[-1]
    return found.select(F.substring_index("directory", f"{tail}/", -1).alias("directory"), F.substring_index("file", "/", -1).alias("file"))


@query(
    """WITH s AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'C1CC' || (p_size % 3 + 1) || '=O1' WHEN p_partkey % 4 = 1 THEN '[13C]' || repeat('[C]', p_size) ELSE repeat('[C]', p_size) END AS smi, p_size, p_partkey FROM part)
SELECT id, p_partkey % 4 < 2 AS has_ring, CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_size % 3 = 0 THEN 2 ELSE 4 END WHEN 1 THEN 2 ELSE 0 END AS ring_atoms, CASE WHEN p_partkey % 4 = 0 THEN 4 ELSE p_size END::INT AS n_heavy FROM s"""
)
def ring_species(spark, d):
    """Ring digits; the second digit of an isotope counts as one, the first, right behind its bracket, doesn't."""
    part = ad.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("int").alias("n"))
    smiles = F.when(F.col("id") % 4 == 0, F.concat(F.lit("C1CC"), (F.col("n") % 3 + 1).cast("string"), F.lit("=O1"))).when(F.col("id") % 4 == 1, F.concat(F.lit("[13C]"), F.expr("repeat('[C]', n)"))).otherwise(F.expr("repeat('[C]', n)"))
    rows = part.select("id", smiles.alias("smiles"))
    dim = species_dim(rows).select("smiles", "has_ring", "ring_atoms", "n_heavy")
    return rows.join(dim, "smiles").select("id", "has_ring", "ring_atoms", "n_heavy")


@query(
    """WITH f AS (SELECT p_partkey AS id, p_size AS n, p_partkey % 6 AS k FROM part)
SELECT id, CASE k WHEN 1 THEN 'invalid formula' WHEN 2 THEN 'empty formula' WHEN 3 THEN 'no atoms' END AS error, CASE k WHEN 0 THEN n + 1 WHEN 4 THEN n + 2 WHEN 5 THEN n END AS carbon, CASE k WHEN 0 THEN 2 WHEN 4 THEN n END AS hydrogen FROM f"""
)
def strict_formulas(spark, d):
    """Formulas that are right, wrong, empty, without atoms, joined, and with an empty set."""
    part = ad.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("int").alias("n"))
    k = F.col("id") % 6
    text = F.when(k == 0, F.concat(F.lit("C"), "n", F.lit("H2C"))).when(k == 1, F.concat(F.lit("C"), "n", F.lit("h-2"))).when(k == 2, " ").when(k == 3, "C0H0").when(k == 4, F.concat(F.lit("C"), "n", F.lit(" + C2H"), "n")).otherwise(F.concat(F.lit("C"), "n", F.lit(" + ∅")))
    rows = part.select("id", strict_formula(text).alias("f"))
    return rows.select("id", "f.error", F.try_element_at("f.counts", F.lit("C")).alias("carbon"), F.try_element_at("f.counts", F.lit("H")).alias("hydrogen"))


@query(
    """, p AS (SELECT s, o, max(net) AS net FROM (SELECT unnest(list_distinct(r)) AS s, k, p, net FROM f WHERE net > 0 AND net / tp >= 0.05), unnest(p) u(o) WHERE s <> o GROUP BY 1, 2)
SELECT DISTINCT s AS start, o AS "end" FROM p WHERE (length(o) - length(replace(o, '[C]', ''))) // 3 = 1""",
    N,
)
def small_carbon_targets(spark, d):
    """Which species of one carbon can be reached in one step, all branches kept."""
    merged, dim = _net_dim(spark, d)
    starts = nw.sides(merged).select(F.col("species").alias("start")).distinct()
    rows = pt.candidate_paths(pt.candidate_steps(merged), starts, max_depth=1, max_branches=100, max_paths=500, dim=dim, target_max_carbon=1)
    return rows.where("size(species) = 2").select("start", F.element_at("species", -1).alias("end")).distinct()


# Variants of queries in catalog: longer sides, second order, other ways of scaling


@query(
    """WITH sp AS (SELECT p_partkey, repeat('[C]', (p_size % 2 + 1)::INT) AS smi FROM part),
rx AS (SELECT l_orderkey, l_orderkey % 3 + 1 AS tp, array_to_string(list_sort(list(smi) FILTER (l_linenumber % 2 = 1)), '+') AS r, array_to_string(list_sort(list(smi) FILTER (l_linenumber % 2 = 0)), '+') AS p FROM lineitem JOIN sp ON l_partkey = p_partkey GROUP BY 1),
m AS (SELECT r || '->' || p AS k, p || '->' || r AS rk, sum(tp)::BIGINT AS tp FROM rx WHERE r IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2)
SELECT m.k AS reaction_key, m.tp, coalesce(b.tp, 0) AS reverse_tp, m.tp - coalesce(b.tp, 0) AS net_tp FROM m LEFT JOIN m b ON m.rk = b.k"""
)
def long_reactions(spark, d):
    """A reaction for each order, of all its lines, odd ones to even ones, counted up to three times and read from text."""
    c = (F.col("p_size") % 2 + 1).cast("int").alias("c")
    species = ad.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), c).select("l_partkey", F.expr("repeat('[C]', c)").alias("smi"))
    lines = ad.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(species, "l_partkey")
    side = lambda odd: F.array_join(F.collect_list(F.when(F.col("l_linenumber") % 2 == odd, F.col("smi"))), "+")
    rows = lines.groupBy("l_orderkey").agg(side(1).alias("r"), side(0).alias("p")).where("r <> '' and p <> ''")
    rows.select(F.concat((F.col("l_orderkey") % 3 + 1).cast("string"), F.lit(" "), "r", F.lit("->"), "p").alias("value")).write.text(path := scratch(spark))
    return nw.with_reverse(nw.merge_reactions(readers.read_reactions(spark, path))).select("reaction_key", "tp", "reverse_tp", "net_tp")


@query(
    """, e AS (SELECT formula, t, sum(n) AS n FROM a JOIN dim USING (smi) GROUP BY 1, 2), mean AS (SELECT formula, avg(n) AS x FROM e GROUP BY 1), sec AS (SELECT (max(t) - min(t)) * 0.5 * 1e-12 AS s FROM e)
SELECT p.formula || '+' || q.formula AS reaction_key, round(1000 * 6.022140857e23 * (1e6 * 1e-27) / (s * p.x * q.x) / 1e12, 4) AS k FROM mean p JOIN mean q ON p.formula < q.formula, sec WHERE p.formula IN ('C2', 'C2O')""",
    A,
)
def second_order_rates(spark, d):
    """Constants of a thousand events of two formulas each, per litre, mol and ps."""
    merged, dim = _abundance(spark, d)
    series = merged.join(dim.select("smiles", "formula"), "smiles").groupBy("formula", "timestep").agg(F.sum("count").alias("count"))
    names = series.select("formula").distinct()
    pairs = names.where("formula in ('C2', 'C2O')").select(F.col("formula").alias("a")).join(names.select(F.col("formula").alias("b")), F.col("a") < F.col("b"))
    rates = pairs.select(F.concat_ws("+", "a", "b").alias("reaction_key"), F.array("a", "b").alias("reactants_formulas"), F.lit(1000).alias("count"))
    return ab.rate_constants(rates, series, 1e6, 0.5).select("reaction_key", _r(F.col("k") / 1e12, 4).alias("k"))


@query("SELECT smi AS smiles, t AS timestep, round(CASE WHEN f = 0 THEN 0 ELSE n / f END, 6) AS relative FROM (SELECT *, first(n) OVER (PARTITION BY smi ORDER BY t) AS f FROM a)", A)
def series_by_first(spark, d):
    """Counts over the first count of each species."""
    rows = _abundance(spark, d)[0]
    return rows.select("smiles", "timestep", _r(ab.normalise(F.col("count"), ("smiles",), "timestep", "first")).alias("relative"))


@query("SELECT smi AS smiles, t AS timestep, t::DOUBLE AS time, n AS count FROM a WHERE t <= (SELECT min(m) FROM (SELECT max(t) AS m FROM a GROUP BY smi))", A)
def truncated_time(spark, d):
    """Series cut at the earliest end of all."""
    return ab.align_time(_abundance(spark, d)[0], ("smiles",), "truncate").select("smiles", "timestep", "time", "count")


@query(
    """WITH s AS (SELECT o_orderpriority AS g, count(*) AS n, avg(o_totalprice::DOUBLE) AS m, stddev_samp(o_totalprice::DOUBLE) AS sd FROM orders GROUP BY 1), z AS (SELECT *, 1.959963984540054::DOUBLE AS z, (n - 1)::DOUBLE AS df FROM s),
q AS (SELECT *, z + (pow(z, 3) + z) / (4 * df) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * df * df) + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / (384 * df * df * df) AS t FROM z)
SELECT g AS group_name, n, round(m, 4) AS mean, round(m - t * sd / sqrt(n), 4) AS ci_low, round(m + t * sd / sqrt(n), 4) AS ci_high FROM q"""
)
def large_samples(spark, d):
    """Intervals of groups of more than thirty: the quantile by its expansion."""
    rows = rp.statistics(ad.table(spark, d, "orders").select(F.col("o_orderpriority").alias("group_name"), F.col("o_totalprice").cast("double").alias("v")), "v", ("group_name",))
    return rows.select("group_name", "n", *[_r(c, 4).alias(c) for c in ("mean", "ci_low", "ci_high")])


@query(
    """, b AS (SELECT user_id, was AS s, t % 3 AS o, count(*) AS n FROM ev GROUP BY 1, 2, 3), a AS (SELECT user_id, now AS s, t % 2 AS o, count(*) AS n FROM ev GROUP BY 1, 2, 3)
SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN coalesce(a.n, 0) > coalesce(b.n, 0) THEN 'appeared' ELSE 'vanished' END AS change, abs(coalesce(a.n, 0) - coalesce(b.n, 0)) AS n
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.s = b.s AND a.o = b.o WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
    E,
)
def bonded_states(spark, d):
    """States that differ in the order of a bond are other states."""
    nodes = ad.event_nodes(spark, d)

    def side(c, orders):
        bond = F.concat(F.col("i.atoms"), F.lit("-x-"), (F.col("t") % orders).cast("string"))
        return nodes.select("t", F.explode(c).alias("i")).select(F.col("i.atoms").cast("long").alias("user_id"), oc.state_key(F.col("i.species"), F.array("i.atoms"), F.array(bond)).alias("state"))

    return oc.changed_states(side("consumed", 3), side("produced", 2), ("user_id",)).select("user_id", "change", "n")


@query("SELECT formula AS series, smi AS smiles, row_number() OVER (PARTITION BY formula ORDER BY total DESC, smi) AS n, row_number() OVER (PARTITION BY formula ORDER BY total DESC, smi) <= 1 AS kept FROM su JOIN dim USING (smi) WHERE formula IN ('C2O', 'C4ClO3')", A)
def members_of_curves(spark, d):
    """Species of two formulas, of which one each is kept."""
    targets = spark.createDataFrame([(f, "formula", f) for f in ("C2O", "C4ClO3", "N2")], "series string, kind string, value string")
    return ab.curve_members(*_abundance(spark, d), targets, 1).select("series", "smiles", "n", "kept")
