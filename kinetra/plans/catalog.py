"""The registered queries and their SQL. Doubles are rounded here, at the sink; operators don't round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.reactions import net_key, radical_class
from ..functions.species import species_dim
from ..operators import abundance as ab
from ..operators import network as nw
from ..operators import occurrences as oc
from ..operators import paths as pt
from ..operators import replicates as rp
from ..operators import space as sp
from . import adapters as ad

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str = "", ctes: str = ""):
    """Register a query by its function's name, with its SQL: the adapters' CTEs and a final statement."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {ctes.strip()}\n{sql}" if ctes else sql
        return f

    return add


def _r(c: str | Column, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def _net_dim(spark, d) -> tuple[DataFrame, DataFrame]:
    merged = ad.network(spark, d)
    return merged, species_dim(nw.sides(merged), "species").withColumnRenamed("species", "smiles")


def _abundance(spark, d) -> tuple[DataFrame, DataFrame]:
    merged = ab.merge_counts(ad.abundance(spark, d))
    return merged, species_dim(merged)


N, A, E, R, X = ad.NETWORK_SQL, ad.ABUNDANCE_SQL, ad.EVENTS_SQL, ad.REPLICATES_SQL, ad.ATOMS_SQL


# Reaction network


@query("SELECT k AS reaction_key, tp, rev AS reverse_tp, net AS net_tp, reversible FROM f", N)
def net_flux(spark, d):
    return nw.with_reverse(ad.network(spark, d)).select("reaction_key", "tp", "reverse_tp", "net_tp", "reversible")


@query("SELECT k AS reaction_key, tp AS gross_forward, rev AS gross_reverse, net AS net_count FROM f WHERE net > 0", N)
def net_flux_pairs(spark, d):
    return nw.net_flux_pairs(ad.network(spark, d))


@query("SELECT s AS species, tc AS tp_consume, tpr AS tp_produce, nc AS n_consume, np AS n_produce, thr AS throughput, tpr - tc AS net_production, nc + np AS hub_score FROM stats", N)
def species_stats(spark, d):
    return nw.species_stats(ad.network(spark, d))


@query("SELECT k AS reaction_key, tp FROM (SELECT DISTINCT k, tp FROM sides WHERE s = '[C]' AND role = 'consume') ORDER BY tp DESC, k LIMIT 20", N)
def top_consumption(spark, d):
    return nw.top_reactions(ad.network(spark, d), "[C]", "consume", 20)


@query(
    "SELECT s AS species, role, k AS reaction_key, tp::BIGINT AS tp, round(tp / sum(tp) OVER (PARTITION BY s, role), 9) AS ratio, row_number() OVER (PARTITION BY s, role ORDER BY tp DESC, k) AS rank FROM (SELECT s, role, k, sum(tp) AS tp FROM sides GROUP BY ALL)",
    N,
)
def channel_ratios(spark, d):
    return nw.channel_ratios(ad.network(spark, d)).withColumn("ratio", _r("ratio", 9))


@query("SELECT stats.s AS species, formula, thr AS throughput, round(thr / sum(thr) OVER (PARTITION BY formula), 9) AS share, row_number() OVER (PARTITION BY formula ORDER BY thr DESC, s) AS rank FROM stats JOIN dim ON s = smi", N)
def species_of_formula(spark, d):
    merged, dim = _net_dim(spark, d)
    return nw.species_of_formula(nw.species_stats(merged), dim).select("species", "formula", "throughput", _r("share", 9).alias("share"), "rank")


@query("SELECT stats.s AS species, formula, c + o AS n_heavy, thr AS throughput, round(thr * log2(nc + np + 1), 4) AS score FROM stats JOIN dim ON s = smi WHERE thr >= 10 AND formula NOT IN ('C')", N)
def rank_intermediates(spark, d):
    merged, dim = _net_dim(spark, d)
    return nw.rank_intermediates(nw.species_stats(merged), dim, exclude=("C",)).select("species", "formula", "n_heavy", "throughput", _r("score", 4).alias("score"))


@query("SELECT formula, arg_max(s, (thr, s)) AS species FROM stats JOIN dim ON s = smi GROUP BY 1", N)
def resolve_start(spark, d):
    merged, dim = _net_dim(spark, d)
    return nw.resolve_start(nw.species_stats(merged), dim)


RDIM = """
, side AS (SELECT k, 1 AS l, unnest(r) AS smi FROM m UNION ALL SELECT k, 0, unnest(p) FROM m),
rd AS (SELECT k, array_to_string(list_sort(list(formula) FILTER (l = 1)), '+') AS rf, array_to_string(list_sort(list(formula) FILTER (l = 0)), '+') AS pf, sum((12 * c + 16 * o) * l)::BIGINT AS rn, sum((12 * c + 16 * o) * (1 - l))::BIGINT AS pn,
       sum(c * l)::BIGINT AS rc, sum(c * (1 - l))::BIGINT AS pc, sum(o * l)::BIGINT AS ro, sum(o * (1 - l))::BIGINT AS po FROM side JOIN dim USING (smi) GROUP BY 1)
"""


@query("SELECT k AS reaction_key, rf AS reactants_formulas, pf AS products_formulas, rn AS reactants_nominal, pn AS products_nominal, pn - rn AS nominal_delta, round(12.0::DOUBLE * (pc - rc) + 15.99491461957::DOUBLE * (po - ro), 6) AS exact_delta FROM rd", N + RDIM)
def reaction_masses(spark, d):
    merged, dim = _net_dim(spark, d)
    rows = nw.reaction_dim(merged, dim)
    return rows.select("reaction_key", F.array_join("reactants_formulas", "+").alias("reactants_formulas"), F.array_join("products_formulas", "+").alias("products_formulas"), "reactants_nominal", "products_nominal", "nominal_delta", _r("exact_delta").alias("exact_delta"))


@query("SELECT k AS reaction_key, 'C' AS element, rc AS n_reactants, pc AS n_products FROM rd WHERE rc <> pc UNION ALL SELECT k, 'O', ro, po FROM rd WHERE ro <> po", N + RDIM)
def mass_balance(spark, d):
    return nw.unbalanced(*_net_dim(spark, d))


@query("SELECT k AS reaction_key, tp, t AS target FROM (SELECT m.k, m.tp, unnest(list_distinct(list_concat(string_split(rf, '+'), string_split(pf, '+')))) AS t FROM rd JOIN m USING (k)) WHERE t IN ('CO', 'C2O')", N + RDIM)
def reactions_with_formulas(spark, d):
    merged, dim = _net_dim(spark, d)
    targets = dim.where(F.col("formula").isin("CO", "C2O")).select(F.col("formula").alias("target")).distinct()
    return nw.reactions_with_formulas(nw.reaction_dim(merged, dim), targets)


@query(
    "SELECT class, count(*) AS n_reactions, sum(tp)::BIGINT AS tp FROM (SELECT m.tp, CASE WHEN list_contains(o, 'CO') THEN 'cross coupling' WHEN len(list_filter(o, lambda x: contains(x, 'C'))) > 0 THEN 'with organic species' ELSE 'other' END AS class FROM (SELECT k, list_filter(string_split(rf, '+'), lambda x: x <> 'C') AS o FROM rd) JOIN m USING (k)) GROUP BY 1",
    N + RDIM,
)
def radical_classes(spark, d):
    merged, dim = _net_dim(spark, d)
    rows = nw.reaction_dim(merged, dim)
    kind = radical_class(F.col("reactants_formulas"), F.col("products_formulas"), "C", ("C", "CO"))
    return rows.groupBy(kind.alias("class")).agg(F.count("*").alias("n_reactions"), F.sum("tp").alias("tp"))


@query(
    """SELECT k AS reaction_key, array_to_string(list_sort(nr), '+') || '->' || array_to_string(list_sort(np), '+') AS net_key FROM (
  SELECT k, coalesce(list(s) FILTER (x > 0), []) AS nr, coalesce(list(s) FILTER (x < 0), []) AS np FROM (
    SELECT k, s, x, unnest(range(abs(x)::BIGINT)) FROM (SELECT k, s, sum(CASE role WHEN 'consume' THEN 1 ELSE -1 END) AS x FROM sides GROUP BY ALL) WHERE x <> 0
    UNION ALL SELECT k, '', 0, 0 FROM m) GROUP BY 1)""",
    N,
)
def net_keys(spark, d):
    return ad.network(spark, d).select("reaction_key", net_key(F.col("reactants"), F.col("products")).alias("net_key"))


@query(
    """, ch AS (SELECT f.k, rf || '->' || pf AS ch, tp, rev, net, (len(list_filter(r, lambda x: x = '[C][C]')) - len(list_filter(p, lambda x: x = '[C][C]'))) * net AS loss,
       len(list_filter(string_split(pf, '+'), lambda x: x = 'C2')) - len(list_filter(string_split(rf, '+'), lambda x: x = 'C2')) AS df FROM f JOIN rd USING (k) WHERE list_contains(r, '[C][C]') AND net > 0)
SELECT ch AS channel, sum(tp)::BIGINT AS forward_tp, sum(rev)::BIGINT AS reverse_tp, sum(net)::BIGINT AS net_events, sum(loss)::BIGINT AS net_start_loss, round(sum(loss) / sum(sum(loss)) OVER (), 9) AS share_of_loss, count(*) AS n_branches FROM ch WHERE loss >= 1 AND df < 0 GROUP BY 1""",
    N + RDIM,
)
def initiation_channels(spark, d):
    merged, dim = _net_dim(spark, d)
    return nw.initiation_channels(merged, dim, "[C][C]").withColumn("share_of_loss", _r("share_of_loss", 9)).withColumn("n_branches", F.size("branches").cast("long")).drop("branches")


@query(
    """, top AS (SELECT DISTINCT k, tp FROM sides WHERE s = '[C][O]' AND role = 'consume' ORDER BY tp DESC, k LIMIT 10)
SELECT k AS reaction_key, tp, x AS product, 1 AS had, o AS has, CASE WHEN o < 1 THEN 'lost' WHEN o > 1 THEN 'gained' ELSE 'retained' END AS fate FROM (SELECT top.k, top.tp, unnest(m.p) AS x FROM top JOIN m USING (k)) JOIN dim ON x = smi""",
    N,
)
def element_fate(spark, d):
    return nw.element_fate(*_net_dim(spark, d), "[C][O]", "O", 10)


@query(
    """, hit AS (SELECT k, tp, rev, net FROM f JOIN rd USING (k) WHERE list_contains(string_split(rf, '+'), 'CO')), top AS (SELECT * FROM hit ORDER BY tp DESC, abs(net) DESC, k LIMIT 50)
SELECT k AS reaction_key, tp, rev AS reverse_tp, net AS net_tp, round(tp / sum(tp) OVER (), 9) AS share, round(sum(tp) OVER (ORDER BY tp DESC, abs(net) DESC, k ROWS UNBOUNDED PRECEDING) / sum(tp) OVER (), 9) AS cumulative FROM top""",
    N + RDIM,
)
def formula_reactions(spark, d):
    """The 50 largest reactions with CO on the reactant side, with shares of what is returned."""
    merged, dim = _net_dim(spark, d)
    rows = nw.with_reverse(merged).join(nw.formulas_of("reactants", dim, merged), "reaction_key").where(F.array_contains("reactants_formulas", "CO"))
    order = [F.desc("tp"), F.desc(F.abs("net_tp")), F.col("reaction_key")]
    rows = nw.with_share(rows.orderBy(*order).limit(50).select("reaction_key", "tp", "reverse_tp", "net_tp"), F.col("tp"), order)
    return rows.withColumn("share", _r("share", 9)).withColumn("cumulative", _r("cumulative", 9))


@query("SELECT k AS reaction_key, role, s AS species, count(*) AS multiplicity, any_value(formula) AS formula FROM sides JOIN dim ON s = smi GROUP BY 1, 2, 3", N)
def reaction_terms(spark, d):
    return nw.reaction_terms(*_net_dim(spark, d))


@query(
    """, u AS (SELECT DISTINCT s, role, k, tp FROM sides), r AS (SELECT *, row_number() OVER (PARTITION BY s, role ORDER BY tp DESC, k) AS n FROM u),
t AS (SELECT s, coalesce(string_agg(k || ' (tp=' || tp || ')', ' | ' ORDER BY n) FILTER (role = 'produce'), '') AS top_sources, coalesce(string_agg(k || ' (tp=' || tp || ')', ' | ' ORDER BY n) FILTER (role = 'consume'), '') AS top_sinks FROM r WHERE n <= 3 GROUP BY 1)
SELECT s AS smiles, tc AS tp_consume, tpr AS tp_produce, tpr - tc AS net_production, top_sources, top_sinks FROM stats JOIN t USING (s)""",
    N,
)
def flux_enrichment(spark, d):
    merged, dim = _net_dim(spark, d)
    return ab.with_flux(dim.select("smiles"), nw.species_stats(merged), nw.sides(merged))


CASCADE_LEVEL = """
r{d} AS (SELECT start, here, seen, k, tp, frac, net, reversible, n, outs, list_filter(outs, lambda x: NOT list_contains(seen, x)) AS fresh FROM f{p} JOIN cc ON s = here),
x{d} AS (SELECT * FROM (SELECT *, coalesce(fresh[1], outs[1]) AS smi FROM r{d}) QUALIFY row_number() OVER (PARTITION BY start, seen, smi ORDER BY n) = 1),
y{d} AS (SELECT * FROM x{d} QUALIFY row_number() OVER (PARTITION BY start, seen ORDER BY n) <= 3),
f{d} AS (SELECT start, smi AS here, list_append(seen, smi) AS seen FROM y{d} WHERE len(fresh) > 0)"""


@query(
    """, dc AS (SELECT DISTINCT s, k, tp, frac FROM (SELECT s, k, tp, tp / sum(tp) OVER (PARTITION BY s) AS frac FROM sides WHERE role = 'consume')),
ou AS (SELECT k, list(x ORDER BY hv DESC, x) AS outs FROM (SELECT DISTINCT k, unnest(p) AS x FROM m) JOIN (SELECT smi AS x, c + o AS hv FROM dim) USING (x) GROUP BY 1),
cc AS (SELECT q.*, f.net, f.reversible, outs FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY tp DESC, k) AS n FROM dc) q JOIN f USING (k) JOIN ou USING (k) WHERE n <= 9 AND f.net >= 1 AND frac >= 0.01),
f0 AS (SELECT DISTINCT s AS start, s AS here, [s] AS seen FROM sides),"""
    + ",".join(CASCADE_LEVEL.format(d=i, p=i - 1) for i in (1, 2, 3))
    + " ".join(f"{'UNION ALL' if i > 1 else ''} SELECT start, {i} AS depth, here AS parent, smi AS smiles, k AS reaction_key, tp, round(frac, 9) AS fraction, net AS net_tp, reversible FROM y{i}" for i in (1, 2, 3)),
    N,
)
def cascade(spark, d):
    """Three levels downstream of every species."""
    merged, dim = _net_dim(spark, d)
    rows = pt.cascade(merged, dim, dim.select(F.col("smiles").alias("start")), max_depth=3, branches=3)
    return rows.withColumn("fraction", _r("fraction", 9))


# Abundance


@query("SELECT t AS timestep, smi AS smiles, n AS count FROM a", A)
def abundance(spark, d):
    return _abundance(spark, d)[0]


@query("SELECT smi AS smiles, formula, round(mass, 6) AS exact_mass, nominal AS nominal_mass, c + o + cl AS n_heavy FROM dim WHERE smi IN (SELECT smi FROM a)", A)
def species_dimension(spark, d):
    return _abundance(spark, d)[1].select("smiles", "formula", _r("exact_mass").alias("exact_mass"), "nominal_mass", "n_heavy")


@query("SELECT smi AS smiles, fwhm AS fwhm_frames, total AS total_count, peak AS peak_count, peak_t AS peak_timestep, n0 AS start_count, n1 AS end_count FROM su", A)
def species_summary(spark, d):
    return ab.species_summary(_abundance(spark, d)[0])


@query("SELECT count(*) AS n_frames, min(t) AS first_timestep, max(t) AS last_timestep, CASE WHEN count(DISTINCT x) = 1 THEN max(x) END AS uniform_step FROM (SELECT t, t - lag(t) OVER (ORDER BY t) AS x FROM fr)", A)
def timeline(spark, d):
    return ab.timeline_summary(_abundance(spark, d)[0])


@query("SELECT t AS timestep, smi AS smiles, n AS count FROM a WHERE t = 60", A)
def snapshot(spark, d):
    return ab.snapshot(_abundance(spark, d)[0], 60)


@query(
    """, g AS (SELECT x.smi, fr.t, frame, coalesce(n, 0) AS n FROM fr CROSS JOIN (SELECT smi FROM dim WHERE formula IN ('C2', 'C3O2')) x LEFT JOIN a ON a.t = fr.t AND a.smi = x.smi)
SELECT smi AS smiles, t AS timestep, n AS count, round(avg(n) OVER (PARTITION BY smi ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth, round(avg(n) OVER (PARTITION BY smi ORDER BY frame ROWS 2 PRECEDING), 6) AS trailing,
       round(CASE WHEN max(n) OVER (PARTITION BY smi) = 0 THEN 0 ELSE n / max(n) OVER (PARTITION BY smi) END, 6) AS relative FROM g""",
    A,
)
def species_series(spark, d):
    """Zero-filled series with a centred mean of 5, a trailing mean of 3 and the share of the maximum."""
    merged, dim = _abundance(spark, d)
    rows = ab.dense_series(merged, dim.where(F.col("formula").isin("C2", "C3O2")).select("smiles"))
    key, n = ("smiles",), F.col("count")
    return rows.select("smiles", "timestep", "count", _r(ab.moving_average(n, key, "frame", 5)).alias("smooth"), _r(ab.trailing_mean(n, key, "frame", 3)).alias("trailing"), _r(ab.normalise(n, key, "frame", "max")).alias("relative"))


@query("SELECT t AS timestep, c AS group_count, sum(n)::BIGINT AS count FROM a JOIN dim USING (smi) WHERE o > 0 AND cl = 0 AND c BETWEEN 1 AND 6 GROUP BY 1, 2", A)
def element_distribution(spark, d):
    return ab.element_distribution(*_abundance(spark, d), "C", present=("O",), absent=("Cl",), ranges={"C": (1, 6)})


@query("SELECT t AS timestep, CASE WHEN c >= 6 THEN 'large' ELSE (c // 2 * 2) || '-' || (c // 2 * 2 + 1) END AS label, sum(n)::BIGINT AS count FROM a JOIN dim USING (smi) GROUP BY 1, 2", A)
def element_bins(spark, d):
    return ab.binned_distribution(ab.element_distribution(*_abundance(spark, d), "C"), 2, [("large", 6, None)])


@query("SELECT fr.t AS timestep, coalesce(sum(n) FILTER (smi = '[C][C][O]'), 0)::BIGINT AS reference, greatest(0, coalesce(sum(n), 0) - coalesce(sum(n) FILTER (smi = '[C][C][O]'), 0))::BIGINT AS others FROM fr LEFT JOIN (SELECT * FROM a JOIN dim USING (smi) WHERE c = 2) q ON q.t = fr.t GROUP BY 1", A)
def reference_and_others(spark, d):
    return ab.reference_and_others(*_abundance(spark, d), "[C][C][O]", "C")


@query("SELECT series, t AS timestep, sum(n)::BIGINT AS count FROM a JOIN dim USING (smi) JOIN (VALUES ('one', 'smiles', '[C]'), ('two', 'formula', 'C2O'), ('three', 'formula', 'C4ClO3')) v(series, kind, val) ON (kind = 'smiles' AND val = smi) OR (kind = 'formula' AND val = formula) GROUP BY 1, 2", A)
def target_curves(spark, d):
    merged, dim = _abundance(spark, d)
    targets = spark.createDataFrame([("one", "smiles", "[C]"), ("two", "formula", "C2O"), ("three", "formula", "C4ClO3"), ("none", "formula", "N2")], "series string, kind string, value string")
    return ab.curves(merged, dim, targets)[0]


@query("SELECT smi AS smiles, count(*) FILTER (x < 0) AS n_consumption, count(*) FILTER (x > 0) AS n_production, min(t) AS first_timestep, max(t) AS last_timestep, arg_min(t, (-n, t)) AS peak_timestep FROM (SELECT *, n - lag(n) OVER (PARTITION BY smi ORDER BY t) AS x FROM a) GROUP BY 1", A)
def change_frames(spark, d):
    return ab.change_frames(_abundance(spark, d)[0])


@query("SELECT smi AS smiles, t AS timestep, round(CASE WHEN max(t) OVER w = min(t) OVER w THEN 0 ELSE (t - min(t) OVER w) / (max(t) OVER w - min(t) OVER w) END, 9) AS time, n AS count FROM a WINDOW w AS (PARTITION BY smi)", A)
def aligned_time(spark, d):
    rows = ab.align_time(_abundance(spark, d)[0], ("smiles",), "relative")
    return rows.select("smiles", "timestep", _r("time", 9).alias("time"), "count")


@query("SELECT t AS timestep, frame FROM fr WHERE frame IN (SELECT round_even(i * (SELECT max(frame) FROM fr) / 11.0, 0)::BIGINT FROM range(12) t(i))", A)
def downsampled_frames(spark, d):
    return ab.downsample(ab.frames(_abundance(spark, d)[0]), 12).select("timestep", "frame")


@query(
    """, q AS (SELECT su.*, formula, nominal, n0 / peak AS a0, n1 / peak AS a1 FROM su JOIN dim USING (smi)),
c AS (SELECT *, CASE WHEN a0 <= 0.5 AND a1 < 0.8 THEN 'intermediate' WHEN a0 <= 0.5 AND a1 >= 0.95 THEN 'product' WHEN a0 > 0.5 AND a0 >= 0.9 AND n1 < n0 THEN 'reactant' ELSE 'other' END AS class FROM q)
SELECT smi AS smiles, formula, nominal AS nominal_mass, class, round(CASE class WHEN 'intermediate' THEN peak * greatest(0, 1 - a1) ELSE peak END, 6)::DOUBLE AS score, fwhm AS fwhm_frames FROM c WHERE class <> 'intermediate' OR fwhm >= 1""",
    A,
)
def screening(spark, d):
    merged, dim = _abundance(spark, d)
    rows = ab.screen_intermediates(ab.species_summary(merged), dim, kind="all", start_ratio_max=0.5)
    return rows.select("smiles", "formula", "nominal_mass", "class", _r("score").alias("score"), "fwhm_frames")


@query("SELECT su.smi AS smiles, total AS total_count, target, round((mass - target) / target * 1e6, 4) AS ppm FROM su JOIN dim USING (smi) JOIN (VALUES (44.0::DOUBLE), (59.97::DOUBLE), (84.0::DOUBLE)) v(target) ON abs(mass - target) <= 0.05", A)
def mass_search(spark, d):
    merged, dim = _abundance(spark, d)
    rows = ab.catalogue(ab.species_summary(merged), dim)
    targets = spark.createDataFrame([(44.0,), (59.97,), (84.0,)], "target double")
    return ab.mass_hits(rows, targets, 0.05).select("smiles", "total_count", "target", _r("ppm", 4).alias("ppm"))


@query("SELECT formula, sum(total)::BIGINT AS total_count, count(*) AS n_species, arg_min(smi, (-total, smi)) AS representative FROM su JOIN dim USING (smi) GROUP BY 1", A)
def formula_catalogue(spark, d):
    merged, dim = _abundance(spark, d)
    return ab.by_formula(ab.catalogue(ab.species_summary(merged), dim)).drop("exact_mass")


@query("SELECT DISTINCT e AS element FROM (SELECT unnest(['C', CASE WHEN o > 0 THEN 'O' END, CASE WHEN cl > 0 THEN 'Cl' END]) AS e FROM dim WHERE smi IN (SELECT smi FROM a)) WHERE e IS NOT NULL", A)
def elements(spark, d):
    return _abundance(spark, d)[1].select(F.explode(F.map_keys("atom_counts")).alias("element")).distinct()


@query(
    """, e AS (SELECT formula, t, sum(n) AS n FROM a JOIN dim USING (smi) GROUP BY 1, 2), mean AS (SELECT formula, avg(n) AS x FROM e GROUP BY 1), sec AS (SELECT (max(t) - min(t)) * 0.5 * 1e-12 AS s FROM e)
SELECT 'loss of ' || formula AS reaction_key, total::BIGINT AS count, round(total / (s * x) / 1e12, 6) AS k FROM (SELECT formula, sum(n) AS total FROM e GROUP BY 1) JOIN mean USING (formula), sec""",
    A,
)
def rate_constants(spark, d):
    """First-order constants (per ps) of the loss of each formula, counted by its abundance."""
    merged, dim = _abundance(spark, d)
    series = merged.join(dim.select("smiles", "formula"), "smiles").groupBy("formula", "timestep").agg(F.sum("count").alias("count"))
    rates = series.groupBy("formula").agg(F.sum("count").alias("count")).select(F.concat(F.lit("loss of "), "formula").alias("reaction_key"), F.array("formula").alias("reactants_formulas"), "count")
    return ab.rate_constants(rates, series, 1e6, 0.5).select("reaction_key", "count", (_r(F.col("k") / 1e12)).alias("k"))


@query("SELECT su.smi AS smiles, formula, coalesce(a.n, 0) AS current_count, peak AS peak_count, peak_t AS peak_timestep, total AS total_count FROM su JOIN dim USING (smi) LEFT JOIN a ON a.smi = su.smi AND a.t = 60 WHERE c = 2 AND o > 0", A)
def drilldown(spark, d):
    merged, dim = _abundance(spark, d)
    return ab.drilldown(merged, ab.species_summary(merged), dim, "C", 2, 60, present=("O",))


# Occurrences


@query("SELECT rep AS dataset, k AS reaction_key, count(*) AS total_events, count(*) FILTER (ok) AS matched_events, count(DISTINCT t) AS distinct_intervals, any_value(av) AS available_intervals FROM ev JOIN (SELECT rep, count(DISTINCT t) AS av FROM ev GROUP BY 1) USING (rep) GROUP BY 1, 2", E)
def event_summary(spark, d):
    return oc.reaction_summary(ad.occurrences(spark, d))


@query("SELECT rep AS dataset, id AS event_id, t AS transition, (SELECT count(*) FROM ev WHERE k = 'click->view') AS total FROM ev WHERE k = 'click->view' ORDER BY t, t, id LIMIT 100 OFFSET 20", E)
def event_page(spark, d):
    return oc.events_page(ad.occurrences(spark, d), "click->view", 100, 20).select("dataset", "event_id", "transition", "total")


@query(
    """, p AS (SELECT x.rep, x.id, x.now AS species, y.id AS other, y.t - x.t AS gap, row_number() OVER (PARTITION BY x.rep, x.id ORDER BY y.t - x.t, y.id) AS rank FROM ev x JOIN ev y ON x.rep = y.rep AND y.was = x.now AND y.t > x.t)
SELECT rep AS dataset, id AS event_id, species, other AS other_id, gap, rank FROM p WHERE rank <= 5""",
    E,
)
def adjacent_events(spark, d):
    """The five nearest later events that consume what each event made."""
    rows = ad.occurrences(spark, d)
    anchors = rows.select("dataset", "event_id", F.explode("products").alias("species"))
    return oc.adjacent_events(rows, anchors, "later", 5).select("dataset", "event_id", "species", "other_id", "gap", "rank")


@query("SELECT x.k AS anchor_key, x.now AS species, y.k AS next_key, y.tp, row_number() OVER (PARTITION BY x.k ORDER BY y.tp DESC, y.k) AS rank FROM nt x JOIN nt y ON y.was = x.now AND x.k <> y.k QUALIFY rank <= 3", E)
def network_continuations(spark, d):
    return oc.network_continuations(ad.event_network(spark, d), 3).select("anchor_key", "species", "next_key", "tp", "rank")


@query("SELECT x.k AS anchor_key, x.now AS species, y.k AS next_key, CASE WHEN x.was = y.now THEN '->' ELSE x.was || '->' || y.now END AS net_key FROM nt x JOIN nt y ON y.was = x.now AND x.k <> y.k QUALIFY row_number() OVER (PARTITION BY x.k ORDER BY y.tp DESC, y.k) <= 3", E)
def composed_pairs(spark, d):
    return oc.composed_pairs(ad.event_network(spark, d), 3)


@query(
    """, s AS (SELECT k, count(*) AS te, count(*) FILTER (ok) AS me, count(DISTINCT t) AS di FROM ev WHERE rep = 'rep0' GROUP BY 1), av AS (SELECT count(DISTINCT t) AS n FROM ev WHERE rep = 'rep0')
SELECT k AS reaction_key, tp, coalesce(te, 0) AS total_events, round(coalesce(me / te, 0), 9) AS event_coverage, round(coalesce(di / n, 0), 9) AS time_coverage FROM nt LEFT JOIN s USING (k), av""",
    E,
)
def evidence_coverage(spark, d):
    summary = oc.reaction_summary(ad.occurrences(spark, d).where("dataset = 'rep0'"))
    return oc.with_evidence(ad.event_network(spark, d), summary).select("reaction_key", "tp", "total_events", _r("event_coverage", 9).alias("event_coverage"), _r("time_coverage", 9).alias("time_coverage"))


@query("SELECT rep AS dataset, k AS reaction_key, id AS event_id, CASE WHEN ok AND (rep, t) IN (SELECT (rep, t) FROM ev) AND (rep, t + 1) IN (SELECT (rep, t) FROM ev) THEN 1 ELSE 2 END AS tier FROM ev", E)
def representative_events(spark, d):
    """Without bonds no event is of the first tier; recommended_events has some."""
    rows = ad.occurrences(spark, d)
    frames = rows.select("dataset", F.col("transition").alias("frame")).distinct()
    return oc.representative_events(rows, frames).select("dataset", "reaction_key", "event_id", "tier")


@query(
    """, ends AS (SELECT min(t) AS a, max(t) AS b FROM dy), gr AS (SELECT user_id AS u, unnest(range(a, b + 1)) AS t FROM (SELECT DISTINCT user_id FROM dy), ends),
sx AS (SELECT u, gr.t, coalesce(last_value(now IGNORE NULLS) OVER (PARTITION BY u ORDER BY gr.t ROWS UNBOUNDED PRECEDING), 'none') AS s FROM gr LEFT JOIN dy ON user_id = u AND dy.t = gr.t),
tr AS (SELECT u, t, s AS x, lead(s) OVER (PARTITION BY u ORDER BY t) AS y FROM sx),
pr AS (SELECT l.t, l.u AS u1, r.u AS u2, l.x AS x1, l.y AS y1, r.x AS x2, r.y AS y2 FROM tr l LEFT JOIN tr r ON r.u = l.u + 1 AND r.t = l.t WHERE l.u % 2 = 0 AND l.y IS NOT NULL
  UNION ALL SELECT t, u, NULL, x, y, NULL, NULL FROM tr WHERE u % 2 = 1 AND y IS NOT NULL AND u - 1 NOT IN (SELECT u FROM sx)),
co AS (SELECT t, CASE WHEN x1 = x2 THEN [x1 || '2'] ELSE list_sort([x1, x2]) END AS r, CASE WHEN y1 = y2 THEN [y1 || '2'] ELSE list_sort([y1, y2]) END AS p, [u1, u2] AS ids FROM pr WHERE u2 IS NOT NULL AND (x1 = x2 OR y1 = y2)
  UNION ALL SELECT t, [x1], [y1], [u1] FROM pr WHERE u2 IS NULL OR (x1 <> x2 AND y1 <> y2)
  UNION ALL SELECT t, [x2], [y2], [u2] FROM pr WHERE u2 IS NOT NULL AND x1 <> x2 AND y1 <> y2)
SELECT t AS transition, array_to_string(r, '+') AS reactants, array_to_string(p, '+') AS products, array_to_string(ids, ',') AS atom_ids FROM co WHERE r <> p""",
    E,
)
def changed_components(spark, d):
    rows = oc.changed_components(ad.paired_molecules(spark, d))
    joined = lambda c, by: F.array_join(F.col(c).cast("array<string>"), by).alias(c)
    return rows.select("transition", joined("reactants", "+"), joined("products", "+"), joined("atom_ids", ","))


@query(
    """, i AS (SELECT user_id, t, sum(CASE WHEN t <= p + 2 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t) AS g FROM (SELECT user_id, t, coalesce(lag(t) OVER (PARTITION BY user_id ORDER BY t), -99) AS p FROM dy)),
m AS (SELECT user_id, min(t) AS a, max(t) + 1 AS b FROM i GROUP BY user_id, g)
SELECT user_id AS molecule_id, a - 1 AS transition, 1 AS change FROM m UNION ALL SELECT user_id, b, -1 FROM m""",
    E,
)
def molecule_transitions(spark, d):
    """A user is present on an active day and the next."""
    days = ad.table(spark, d, "events").select(F.col("user_id").alias("molecule_id"), F.date_diff(F.col("ts").cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("start_frame")).distinct()
    return oc.transitions_of_ranges(days.withColumn("end_frame", F.col("start_frame") + 1))


@query(
    """b AS (SELECT l_orderkey AS e, l_returnflag = 'R' AS was, least(l_suppkey % 5, l_partkey % 7) AS x, greatest(l_suppkey % 5, l_partkey % 7) AS y FROM lineitem)
SELECT e AS event_id, x AS atom1, y AS atom2, CASE WHEN bool_or(was) AND bool_or(NOT was) THEN 'kept' WHEN bool_or(was) THEN 'broken' ELSE 'formed' END AS state FROM b GROUP BY 1, 2, 3""".replace("b AS", "WITH b AS", 1)
)
def bond_changes(spark, d):
    rows = ad.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.when(F.col("l_returnflag") == "R", "before").otherwise("after").alias("side"), (F.col("l_suppkey") % 5).alias("atom1"), (F.col("l_partkey") % 7).alias("atom2"))
    return oc.bond_changes(rows)


@query(
    """WITH e AS (SELECT 'rep' || (user_id % 3) AS ds, event_id, floor(epoch(ts))::BIGINT AS t, event_type FROM events), f AS (SELECT DISTINCT ds, t FROM e WHERE event_type = 'purchase')
SELECT e.ds AS dataset, e.event_id::VARCHAR AS event_id, e.t AS timestep, arg_min(f.t, (abs(f.t - e.t), f.t)) AS frame_timestep FROM e JOIN f USING (ds) GROUP BY 1, 2, 3"""
)
def nearest_frame(spark, d):
    """Purchases stand for frames: the one nearest to each event of a third of the users."""
    rows = ad.table(spark, d, "events").select(F.concat(F.lit("rep"), F.col("user_id") % 3).alias("dataset"), "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("timestep"), "event_type")
    return sp.nearest_frame(rows.drop("event_type"), rows.where("event_type = 'purchase'").select("dataset", "timestep").distinct())


# Event paths. In this adapter an instance is (type, user), so edges join consecutive changes of a user.

EDGES = """
, act AS (SELECT rep, was AS s, user_id AS u, t, 1 AS ph, id FROM ev WHERE ok UNION ALL SELECT rep, now, user_id, t, 2, id FROM ev WHERE ok),
lg AS (SELECT *, lag(ph) OVER w AS pph, lag(id) OVER w AS pid, lag(t) OVER w AS ptm FROM act WINDOW w AS (PARTITION BY rep, s, u ORDER BY t, ph)),
bar AS (SELECT rep, was AS s, t FROM ev WHERE NOT ok UNION SELECT rep, now, t FROM ev WHERE NOT ok),
eg AS (SELECT rep, pid AS a, id AS b, ptm AS ta, t AS tb, u FROM lg WHERE ph = 1 AND pph = 2 AND NOT EXISTS (SELECT 1 FROM bar WHERE bar.rep = lg.rep AND bar.s = lg.s AND bar.t > lg.ptm AND bar.t <= lg.t)),
pa AS (SELECT x.rep, x.a AS e1, x.b AS e2, y.b AS e3, x.u, x.ta, y.tb, k1.k || ' => ' || k2.k || ' => ' || k3.k AS sig FROM eg x JOIN eg y ON x.rep = y.rep AND x.b = y.a AND x.u = y.u JOIN ev k1 ON k1.id = x.a JOIN ev k2 ON k2.id = x.b JOIN ev k3 ON k3.id = y.b)
"""


def _edges(spark, d, with_barriers=False):
    nodes = ad.event_nodes(spark, d, with_barriers)
    return nodes, pt.event_edges(nodes)


#: The same without unresolved events; with them, few chains of three are left.
PATHS = E.replace("was <> 'error' AND now <> 'error' AS ok", "TRUE AS ok") + EDGES


@query("SELECT rep AS replicate, a AS from_id, b AS to_id, ta AS t_from, tb AS t_to, u::VARCHAR AS carriers FROM eg", E + EDGES)
def event_edges(spark, d):
    return _edges(spark, d, True)[1].withColumn("carriers", F.array_join("carriers", ",")).drop("idle_gap", "anchor_gap")


@query("SELECT rep AS replicate, e1 || ',' || e2 || ',' || e3 AS event_ids, u::VARCHAR AS lineage, ta AS t_first, tb AS t_last FROM pa", PATHS)
def event_paths(spark, d):
    return pt.event_paths(*_edges(spark, d), 3).select("replicate", F.array_join("event_ids", ",").alias("event_ids"), F.array_join("lineage", ",").alias("lineage"), "t_first", "t_last")


@query("SELECT sig AS signature, count(*) AS n_occurrences, count(DISTINCT (rep, u)) AS n_lineages, count(DISTINCT rep) AS n_replicates, min(tb - ta) AS span_min, median(tb - ta)::DOUBLE AS span_median, round(avg(tb - ta), 9) AS span_mean, max(tb - ta) AS span_max, count(DISTINCT (rep, u)) AS n_atoms, round(count(DISTINCT rep) / (SELECT count(DISTINCT rep) FROM pa), 9) AS support FROM pa GROUP BY 1", PATHS)
def path_signatures(spark, d):
    return pt.path_signatures(pt.event_paths(*_edges(spark, d), 3)).drop("support_is_lower_bound").withColumn("span_mean", _r("span_mean", 9)).withColumn("support", _r("support", 9))


@query("SELECT x.k || ' => ' || y.k || ' => ' || z.k AS signature FROM nt x JOIN nt y ON x.now = y.was JOIN nt z ON y.now = z.was", E)
def reachable_paths(spark, d):
    return pt.reachable_paths(ad.event_network(spark, d), 3).select(F.array_join("reaction_keys", " => ").alias("signature"))


@query(
    """, re AS (SELECT x.k || ' => ' || y.k || ' => ' || z.k AS sig FROM nt x JOIN nt y ON x.now = y.was JOIN nt z ON y.now = z.was), ac AS (SELECT DISTINCT rep, sig FROM pa)
SELECT rep AS replicate, count(*) AS n_actual, count(*) FILTER (sig IN (SELECT sig FROM re)) AS n_confirmed, (SELECT count(*) FROM re) AS n_reachable, count(*) FILTER (sig NOT IN (SELECT sig FROM re)) AS n_actual_only, (SELECT count(*) FROM re) - count(*) FILTER (sig IN (SELECT sig FROM re)) AS n_aggregate_only, round(count(*) FILTER (sig IN (SELECT sig FROM re)) / (SELECT count(*) FROM re), 9) AS realised FROM ac GROUP BY 1""",
    PATHS,
)
def path_comparison(spark, d):
    rows = pt.compare_paths(pt.event_paths(*_edges(spark, d), 3), pt.reachable_paths(ad.event_network(spark, d), 3))
    return rows.withColumn("realised", _r("realised", 9))


def _clocked(spark, d) -> tuple[DataFrame, DataFrame]:
    """The same events with transitions of several lengths."""
    begin = F.col("t") * 10
    nodes = ad.event_nodes(spark, d, False).withColumns({"before_timestep": begin, "after_timestep": begin + 3 + F.col("t") % 5 * 4})
    return nodes, pt.event_edges(nodes)


@query(
    """, tm AS (SELECT *, t * 10 AS bf, t * 10 + 3 + t % 5 * 4 AS af FROM ev),
g AS (SELECT sig, e.i AS edge, CASE e.i WHEN 0 THEN x ELSE y END AS p, CASE e.i WHEN 0 THEN y ELSE z END AS q FROM pa JOIN tm x ON x.id = e1 JOIN tm y ON y.id = e2 JOIN tm z ON z.id = e3, range(2) e(i)),
c AS (SELECT sig, edge, 'interval' AS clock, q.t - p.t AS gap FROM g UNION ALL SELECT sig, edge, 'idle', greatest(0, q.bf - p.af) FROM g UNION ALL SELECT sig, edge, 'anchor', q.af - p.af FROM g)
SELECT sig AS signature, edge, clock, count(*) AS n, min(gap) AS gap_min, median(gap)::DOUBLE AS gap_median, round(avg(gap), 9) AS gap_mean, max(gap) AS gap_max FROM c GROUP BY 1, 2, 3""",
    PATHS,
)
def path_clocks(spark, d):
    """Gaps by interval, idle time and time between the ends, for each edge of every signature."""
    return pt.clock_statistics(pt.event_paths(*_clocked(spark, d), 3)).withColumn("gap_mean", _r("gap_mean", 9))


@query(
    """, st AS (SELECT rep, e1, ta, sum(n) OVER (PARTITION BY rep ORDER BY ta, e1) - n AS before FROM (SELECT rep, e1, ta, count(*) AS n FROM pa GROUP BY ALL)),
kp AS (SELECT pa.* FROM pa JOIN st USING (rep, e1) WHERE before < 40)
SELECT sig AS signature, count(*) AS n_occurrences, count(DISTINCT (rep, u)) AS n_lineages, count(DISTINCT rep) AS n_replicates, any_value(lb) AS support_is_lower_bound FROM kp, (SELECT max(before) >= 40 AS lb FROM st) GROUP BY 1""",
    PATHS,
)
def budgeted_signatures(spark, d):
    """Signatures of the earliest paths only, about forty a replicate."""
    rows = pt.path_signatures(pt.event_paths(*_edges(spark, d), 3, max_paths=40))
    return rows.select("signature", "n_occurrences", "n_lineages", "n_replicates", "support_is_lower_bound")


@query(
    """, rn AS (SELECT DISTINCT rep, k, was, now FROM ev WHERE user_id % 2 = 0),
re AS (SELECT x.rep, x.k || ' => ' || y.k || ' => ' || z.k AS sig FROM rn x JOIN rn y ON x.rep = y.rep AND x.now = y.was JOIN rn z ON y.rep = z.rep AND y.now = z.was WHERE x.was <> 'error'),
ac AS (SELECT DISTINCT rep, sig FROM pa), ct AS (SELECT rep, count(*) AS n FROM re GROUP BY 1)
SELECT rep AS replicate, any_value(ct.n)::DOUBLE AS n_reachable, count(*) AS n_actual, count(*) FILTER ((rep, sig) IN (SELECT (rep, sig) FROM re)) AS n_confirmed, count(*) FILTER ((rep, sig) NOT IN (SELECT (rep, sig) FROM re)) AS n_actual_only,
       any_value(ct.n) - count(*) FILTER ((rep, sig) IN (SELECT (rep, sig) FROM re))::DOUBLE AS n_aggregate_only, round(count(*) FILTER ((rep, sig) IN (SELECT (rep, sig) FROM re)) / any_value(ct.n), 9) AS realised, false AS actual_is_lower_bound
FROM ac JOIN ct USING (rep) GROUP BY 1""",
    PATHS,
)
def network_comparison(spark, d):
    """Paths of all users against the networks of those with even numbers, from anything but errors on, one network a replicate."""
    merged = ad.event_nodes(spark, d, False).where(F.get("consumed", F.lit(0))["atoms"].cast("long") % 2 == 0).select("replicate", "reaction_key", "reactants", "products").distinct()
    # A start is a species: the reactions that errors begin don't count as starts.
    marked = merged.withColumn("reactants", F.when(F.array_contains("reactants", "error"), F.col("reactants")).otherwise(F.array_append("reactants", F.lit("any"))))
    rows = pt.compare_with_network(pt.event_paths(*_edges(spark, d), 3), marked, "any")
    return rows.withColumns({"realised": _r("realised", 9), **{c: F.col(c).cast("double") for c in ("n_reachable", "n_aggregate_only")}})


# Candidate paths

STEPS = """
, po AS (SELECT k, tp, rev, net, s, unnest(p) AS o FROM (SELECT k, tp, rev, net, p, unnest(list_distinct(r)) AS s FROM f WHERE net > 0)),
ps AS (SELECT *, net / sum(net) OVER (PARTITION BY s) AS share, net / tp AS dir FROM po),
sc AS (SELECT *, (0.40 * share + 0.25 * dir) / 0.65 AS score FROM ps)
"""


@query("SELECT s AS focal_input, o AS focal_output, k AS reaction_key, tp AS forward_tp, rev AS reverse_tp, net AS net_tp, round(share, 9) AS net_share, round(dir, 9) AS directionality, round(score, 9) AS score FROM sc", N + STEPS)
def candidate_steps(spark, d):
    rows = pt.candidate_steps(ad.network(spark, d))
    return rows.select("focal_input", "focal_output", "reaction_key", "forward_tp", "reverse_tp", "net_tp", _r("net_share", 9).alias("net_share"), _r("directionality", 9).alias("directionality"), _r("score", 9).alias("score"))


PATH_LEVEL = """
c{d} AS (SELECT l.start, l.species AS ps, l.keys AS pk, l.ns AS pn, list_append(l.species, o) AS species, list_append(l.keys, k) AS keys, list_append(l.scores, score) AS scores, list_append(l.ns, n) AS ns FROM l{p} l JOIN us ON l.species[-1] = us.s WHERE NOT list_contains(l.species, o)),
l{d} AS (SELECT * EXCLUDE (b) FROM (SELECT *, row_number() OVER (PARTITION BY start, ps, pk, pn ORDER BY -(0.7 * pow(list_product(scores), 1.0::DOUBLE / len(scores)) + 0.3 * list_min(scores)), species, keys, ns) AS b FROM c{d}) WHERE b <= 5)"""


@query(
    """, us AS (SELECT s, o, n, k, score FROM (SELECT k, s, unnest(p) AS o, generate_subscripts(p, 1) AS n FROM (SELECT k, p, unnest(list_distinct(r)) AS s FROM f WHERE net > 0)) JOIN (SELECT DISTINCT s, k, dir, net, score FROM sc) USING (s, k) WHERE net >= 1 AND dir >= 0.05),
l0 AS (SELECT DISTINCT s AS start, [s] AS species, []::VARCHAR[] AS keys, []::DOUBLE[] AS scores, []::BIGINT[] AS ns FROM sides),"""
    + ",".join(PATH_LEVEL.format(d=i, p=i - 1) for i in (1, 2, 3))
    + """,
dn AS (SELECT start, species, keys, scores, ns FROM l1 WHERE NOT EXISTS (SELECT 1 FROM l2 WHERE l2.start = l1.start AND l2.ps = l1.species AND l2.pk = l1.keys AND l2.pn = l1.ns)
  UNION ALL SELECT start, species, keys, scores, ns FROM l2 WHERE NOT EXISTS (SELECT 1 FROM l3 WHERE l3.start = l2.start AND l3.ps = l2.species AND l3.pk = l2.keys AND l3.pn = l2.ns)
  UNION ALL SELECT start, species, keys, scores, ns FROM l3),
rk AS (SELECT *, 0.7 * pow(list_product(scores), 1.0::DOUBLE / len(scores)) + 0.3 * list_min(scores) AS sco FROM dn)
SELECT start, row_number() OVER (PARTITION BY start ORDER BY sco DESC, species, keys, ns) AS rank, array_to_string(species, ' > ') AS species, array_to_string(keys, ' => ') AS reaction_keys, round(sco, 9) AS score FROM rk QUALIFY rank <= 20""",
    N + STEPS,
)
def candidate_paths(spark, d):
    """The 20 best routes of at most three steps from every species."""
    merged = ad.network(spark, d)
    starts = nw.sides(merged).select(F.col("species").alias("start")).distinct()
    rows = pt.candidate_paths(pt.candidate_steps(merged), starts)
    return rows.select("start", "rank", F.array_join("species", " > ").alias("species"), F.array_join("reaction_keys", " => ").alias("reaction_keys"), _r("score", 9).alias("score"))


@query("SELECT nt.k AS reaction_key, tp, count(ev.id) AS n_events, coalesce(min(ev.t), -1) AS first_transition, count(ev.id) > 0 AS can_assert_occurrence FROM nt LEFT JOIN ev ON ev.k = nt.k AND ev.ok GROUP BY 1, 2", E)
def occurrence_check(spark, d):
    """Reactions of the network with the matched events that bear exactly their key."""
    events = ad.occurrences(spark, d).where("status = 'matched'")
    rows = oc.occurrence_check(ad.event_network(spark, d).select("reaction_key", "tp"), events, 1)
    first = events.groupBy("reaction_key").agg(F.min("transition").alias("t"))
    return rows.join(first, "reaction_key", "left").select("reaction_key", "tp", "n_events", F.coalesce("t", F.lit(-1)).cast("long").alias("first_transition"), "can_assert_occurrence")


# Replicates


@query("SELECT g AS group_name, rep AS replicate, k AS reaction_key, fwd AS forward, rev AS reverse, net FROM tab", R)
def replicate_table(spark, d):
    return _table(spark, d)


def _table(spark, d):
    counts = ad.replicate_counts(spark, d)
    return rp.replicate_table(counts, counts.select("group_name", "replicate").distinct(), rp.common_reactions(counts))


@query("SELECT k AS reaction_key, count(*) AS n_replicates, count(*) FILTER (fwd > 0) AS n_detected, sum(fwd)::BIGINT AS total, round(count(*) FILTER (fwd > 0) / count(*), 9) AS detection_rate FROM tab GROUP BY 1", R)
def detection_rates(spark, d):
    return rp.detection_rates(_table(spark, d)).withColumn("detection_rate", _r("detection_rate", 9))


@query(
    "SELECT g AS group_name, k AS reaction_key, count(*) AS n, round(avg(fwd), 6) AS mean, round(stddev_samp(fwd), 6) AS sd, min(fwd) AS low, max(fwd) AS high, round(avg(fwd) - 2.776 * stddev_samp(fwd) / sqrt(5), 6) AS ci_low, round(avg(fwd) + 2.776 * stddev_samp(fwd) / sqrt(5), 6) AS ci_high FROM tab GROUP BY 1, 2",
    R,
)
def replicate_statistics(spark, d):
    """Five nations a region: four degrees of freedom."""
    rows = rp.statistics(_table(spark, d), "forward")
    return rows.select("group_name", "reaction_key", "n", *[_r(c).alias(c) for c in ("mean", "sd")], "low", "high", *[_r(c).alias(c) for c in ("ci_low", "ci_high")])


# Space


@query(
    """, core AS (SELECT t, min(id) AS id FROM xyz GROUP BY 1), c AS (SELECT xyz.* FROM xyz JOIN core USING (t, id)),
dd AS (SELECT c.t AS ev, xyz.id, (xyz.x - c.x) - 20 * round((xyz.x - c.x) / 20) AS dx, (xyz.y - c.y) - 20 * round((xyz.y - c.y) / 20) AS dy, (xyz.z - c.z) - 20 * round((xyz.z - c.z) / 20) AS dz FROM c JOIN xyz ON c.t = xyz.t AND c.id <> xyz.id)
SELECT ev AS event_id, id, round(sqrt(dx * dx + dy * dy + dz * dz), 6) AS dist, count(*) OVER (PARTITION BY ev) AS n_raw, count(*) OVER (PARTITION BY ev) > 500 AS truncated
FROM dd WHERE dx * dx + dy * dy + dz * dz <= 36 QUALIFY row_number() OVER (PARTITION BY ev ORDER BY dx * dx + dy * dy + dz * dz, id) <= 500""",
    X,
)
def local_environment(spark, d):
    """Around the first atom of every frame, atoms within 6."""
    atoms = ad.atoms(spark, d)
    cores = atoms.groupBy("timestep").agg(F.min("id").alias("id")).select(F.col("timestep").alias("event_id"), "timestep", "id")
    return sp.local_environment(atoms, cores, (20.0, 20.0, 20.0), 6.0).withColumn("dist", _r("dist"))


@query(
    """, core AS (SELECT t, min(id) AS id FROM xyz GROUP BY 1), c AS (SELECT xyz.* FROM xyz JOIN core USING (t, id)),
dd AS (SELECT c.t AS ev, xyz.id, c.id AS cid, (xyz.x - c.x) - 20 * round((xyz.x - c.x) / 20) AS dx, (xyz.y - c.y) - 20 * round((xyz.y - c.y) / 20) AS dy, (xyz.z - c.z) - 20 * round((xyz.z - c.z) / 20) AS dz FROM c JOIN xyz USING (t))
SELECT ev AS event_id, id, round(dx, 6) + 0.0::DOUBLE AS x, round(dy, 6) + 0.0::DOUBLE AS y, round(dz, 6) + 0.0::DOUBLE AS z, CASE WHEN id = cid THEN 'core' ELSE 'environment' END AS scope FROM dd WHERE dx * dx + dy * dy + dz * dz <= 36""",
    X,
)
def recentred_environment(spark, d):
    """The same atoms around their core."""
    atoms = ad.atoms(spark, d)
    cores = atoms.groupBy("timestep").agg(F.min("id").alias("id")).select(F.col("timestep").alias("event_id"), "timestep", "id")
    near = sp.local_environment(atoms, cores, (20.0, 20.0, 20.0), 6.0, 1_000_000)
    rows = sp.recentred(atoms, near.select("event_id", "id").union(cores.select("event_id", "id")), cores, (20.0, 20.0, 20.0))
    return rows.select("event_id", "id", *[(_r(c) + 0.0).alias(c) for c in "xyz"], "scope")


@query("SELECT t AS timestep, frame FROM fr WHERE frame BETWEEN 3 AND 5 OR frame BETWEEN 10 AND 12 OR frame >= 80", A)
def frames_in_ranges(spark, d):
    ranges = spark.createDataFrame([(3, 5), (10, 12), (80, 10_000)], "start long, end long")
    return sp.frames_in_ranges(ab.frames(_abundance(spark, d)[0]), ranges)


@query("SELECT k AS reaction_key, " + ", ".join(f"round(avg(fwd) FILTER (g = '{g}'), 6) AS {g.replace(' ', '_').lower()}" for g in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM tab GROUP BY 1", R)
def comparison_matrix(spark, d):
    groups = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    rows = rp.matrix(_table(spark, d), "forward", groups)
    return rows.select("reaction_key", *[_r(F.col(f"`{g}`")).alias(g.replace(" ", "_").lower()) for g in groups])


from . import sources, reports  # noqa: E402, F401, I001  (register their queries)
