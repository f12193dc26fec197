"""Species abundance over time. abundance: timestep bigint, smiles string, count bigint; a missing row is a count of 0.

by names the columns that tell several sources apart, such as ("dataset",): each then has frames, summaries and series of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.species import count_of, matches_elements
from ..session import cut
from .occurrences import numbered


def merge_counts(abundance: DataFrame, by: tuple[str, ...] = ("timestep", "smiles")) -> DataFrame:
    """Species repeated in a frame add up."""
    return abundance.groupBy(*by).agg(F.sum("count").alias("count"))


def frames(abundance: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, timestep, frame): the distinct timesteps, numbered in each source; by ranges of 1024, so that no task has all of them."""
    steps = cut(abundance.select(*by, "timestep").distinct().withColumn("part", F.floor(F.col("timestep") / 1024)))
    return numbered(steps, [*by], "part", ["timestep"], "n").select(*by, "timestep", (F.col("n") - 1).cast("long").alias("frame"))


def timeline_summary(abundance: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Frame count, first and last timestep, and the step if it is the same everywhere."""
    steps = cut(frames(abundance, by))
    last = steps.select(*by, F.col("timestep").alias("sooner"), (F.col("frame") + 1).alias("frame"))
    steps = steps.join(last, [*by, "frame"], "left").withColumn("d", F.col("timestep") - F.col("sooner"))
    return steps.groupBy(*by).agg(F.count("*").alias("n_frames"), F.min("timestep").alias("first_timestep"), F.max("timestep").alias("last_timestep"), F.when(F.countDistinct("d") == 1, F.max("d")).alias("uniform_step"))


def species_summary(merged: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per species: total, peak and its first timestep, counts at the first and last frame, longest run of frames at half the peak or more."""
    at = merged.where("count > 0").join(frames(merged, by), [*by, "timestep"])
    ends = merged.groupBy(*by).agg(F.min("timestep").alias("t0"), F.max("timestep").alias("t1"))
    at = at.join(ends, [*by]) if by else at.join(ends, how="cross")  # one row
    w = Window.partitionBy(*by, "smiles")
    at = at.withColumn("peak", F.max("count").over(w))
    half = at.where(F.col("count") * 2 >= F.col("peak")).withColumn("island", F.col("frame") - F.row_number().over(w.orderBy("frame")))
    runs = half.groupBy(*by, "smiles", "island").agg(F.count("*").alias("n")).groupBy(*by, "smiles").agg(F.max("n").alias("fwhm_frames"))
    sums = at.groupBy(*by, "smiles").agg(
        F.sum("count").alias("total_count"), F.max("count").alias("peak_count"), F.min_by("timestep", F.struct(-F.col("count"), F.col("timestep"))).alias("peak_timestep"),
        F.sum(F.when(F.col("timestep") == F.col("t0"), F.col("count")).otherwise(0)).alias("start_count"), F.sum(F.when(F.col("timestep") == F.col("t1"), F.col("count")).otherwise(0)).alias("end_count"),
    )
    return sums.join(runs, [*by, "smiles"])


def snapshot(merged: DataFrame, timestep: int) -> DataFrame:
    """The counts of one timestep; a timestep that no row has is an error."""
    rows = merged.where(F.col("timestep") == timestep)
    if not rows.take(1):
        raise KeyError(f"no timestep {timestep}")
    return rows


def dense_series(merged: DataFrame, species: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, smiles, timestep, frame, count) of the given species (a short list) at every frame, absent ones 0."""
    grid = frames(merged, by).join(species.select("smiles").distinct(), how="cross")
    return grid.join(merged, [*by, "timestep", "smiles"], "left").select(*by, "smiles", "timestep", "frame", F.coalesce("count", F.lit(0)).alias("count"))


def moving_average(value: Column, series: tuple[str, ...], order: str, window: int) -> Column:
    """Centred mean over window // 2 points on both sides, fewer at the ends; as it is for window <= 1 or up to two points."""
    w = Window.partitionBy(*series)
    half = window // 2
    mean = F.avg(value).over(w.orderBy(order).rowsBetween(-half, half))
    return value.cast("double") if window <= 1 else F.when(F.count("*").over(w) <= 2, value.cast("double")).otherwise(mean)


def trailing_mean(value: Column, series: tuple[str, ...], order: str, window: int) -> Column:
    return F.avg(value).over(Window.partitionBy(*series).orderBy(order).rowsBetween(-(window - 1), 0))


def normalise(value: Column, series: tuple[str, ...], order: str, by: str) -> Column:
    """Divide by the first value or the maximum of the series; 0 where that is 0."""
    w = Window.partitionBy(*series)
    d = F.first(value).over(w.orderBy(order)) if by == "first" else F.max(value).over(w)
    return F.when(d == 0, 0.0).otherwise(value / d)


def element_distribution(merged: DataFrame, dim: DataFrame, element: str, present: tuple = (), absent: tuple = (), ranges: dict | None = None, include_zero: bool = False, max_count: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, timestep, group_count, count): abundance by the number of atoms of an element."""
    keep = dim.where(matches_elements(F.col("atom_counts"), present, absent, ranges)).select("smiles", count_of(F.col("atom_counts"), element).alias("group_count"))
    keep = keep if include_zero else keep.where("group_count > 0")
    keep = keep if max_count is None else keep.where(F.col("group_count") <= max_count)
    return merged.join(keep, "smiles").groupBy(*by, "timestep", "group_count").agg(F.sum("count").alias("count"))


def binned_distribution(distribution: DataFrame, width: int, ranges: list[tuple[str, int, int | None]] = (), by: tuple[str, ...] = (), element: str = "") -> DataFrame:
    """(*by, timestep, label, count): named ranges first, then bins of the width; bins are named by the element, if given, and their ends."""
    low = F.floor(F.col("group_count") / width) * width
    label = F.concat(F.lit(element), low.cast("string"), F.lit("") if width == 1 else F.concat(F.lit("-"), (low + width - 1).cast("string")))
    for name, a, b in reversed(ranges):
        label = F.when((F.col("group_count") >= a) & (F.lit(True) if b is None else F.col("group_count") <= b), name).otherwise(label)
    return distribution.withColumn("label", label).groupBy(*by, "timestep", "label").agg(F.sum("count").alias("count"))


def tidy_counts(tidy: DataFrame) -> DataFrame:
    """Rows of read_tidy as (dataset, timestep, smiles, count): times become whole timesteps."""
    return tidy.select("dataset", F.col("time").cast("long").alias("timestep"), F.col("species").alias("smiles"), "count")


def distribution_model(
    counts: DataFrame, dim: DataFrame, element: str, present: tuple = (), absent: tuple = (), ranges: dict | None = None, include_zero: bool = False, max_count: int | None = None,
    max_points: int | None = None, width: int = 1, groups: list[tuple[str, int, int | None]] = (), window: int = 1,
) -> DataFrame:
    """(dataset, timestep, label, raw_count, count): the element distribution of several datasets (dataset, timestep, smiles, count) at once.

    Each dataset is sampled to max_points frames of its own, its species grouped by their atoms of the element, and the groups
    binned. count is the trailing mean of raw_count over the last `window` rows of a dataset's group; frames without a row of
    the group don't count as 0.
    """
    by = ("dataset",)
    merged = merge_counts(counts, ("dataset", "timestep", "smiles"))
    if max_points is not None:
        sampled = downsample(frames(merged, by), max(2, min(max_points, 4000)), by)
        merged = merged.join(sampled.select("dataset", "timestep"), ["dataset", "timestep"], "left_semi")
    found = element_distribution(merged, dim, element, present, absent, ranges, include_zero, max_count, by)
    rows = binned_distribution(found, width, groups, by, element).withColumnRenamed("count", "raw_count")
    return rows.withColumn("count", trailing_mean(F.col("raw_count"), ("dataset", "label"), "timestep", max(1, window)))


def reference_and_others(merged: DataFrame, dim: DataFrame, reference: str, element: str) -> DataFrame:
    """At every frame: the reference species, and the others of its element count."""
    counts = dim.select("smiles", count_of(F.col("atom_counts"), element).alias("g"))
    group = counts.join(counts.where(F.col("smiles") == reference).select("g"), "g").select("smiles")
    sums = merged.join(group, "smiles").groupBy("timestep").agg(F.sum("count").alias("all"), F.sum(F.when(F.col("smiles") == reference, F.col("count")).otherwise(0)).alias("reference"))
    rows = frames(merged).join(sums, "timestep", "left")
    ref = F.coalesce("reference", F.lit(0))
    return rows.select("timestep", ref.alias("reference"), F.greatest(F.lit(0), F.coalesce("all", F.lit(0)) - ref).alias("others"))


def curve_members(merged: DataFrame, dim: DataFrame, targets: DataFrame, max_members: int = 20) -> DataFrame:
    """(series, kind, smiles, total, n, kept): the species of each target, most abundant first; kept is false for those beyond max_members."""
    totals = merged.groupBy("smiles").agg(F.sum("count").alias("total")).join(dim.select("smiles", "formula"), "smiles")
    by = lambda kind, column: targets.where(F.col("kind") == kind).join(totals, F.col("value") == F.col(column)).select("series", "kind", "smiles", "total")
    members = by("smiles", "smiles").union(by("formula", "formula"))
    return members.withColumn("n", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("total"), "smiles"))).withColumn("kept", F.col("n") <= max_members)


def curves(merged: DataFrame, dim: DataFrame, targets: DataFrame, max_members: int = 20, mode: str = "sum") -> tuple[DataFrame, DataFrame]:
    """(series, timestep, count), and the targets without any member. targets: series, kind (smiles or formula), value.

    mode: sum adds up the members of a formula, split makes a series of each, named series[1] for the most abundant and so on, both does both.
    Members beyond max_members take no part; curve_members tells which.
    """
    if mode not in ("sum", "split", "both"):
        raise ValueError("mode must be sum, split or both")
    members = curve_members(merged, dim, targets, max_members).where("kept")
    one = F.concat("series", F.lit("["), "n", F.lit("]"))
    names = {"sum": F.array("series"), "split": F.array(one), "both": F.array("series", one)}[mode]
    named = members.select("smiles", F.explode(F.when(F.col("kind") == "smiles", F.array("series")).otherwise(names)).alias("series"))
    lines = named.join(merged, "smiles").groupBy("series", "timestep").agg(F.sum("count").alias("count"))
    return lines, targets.join(members, "series", "left_anti")


def align_time(series: DataFrame, group: tuple[str, ...], mode: str) -> DataFrame:
    """time as it is (raw), cut at the earliest end of all groups (truncate), or 0 to 1 in each group (relative)."""
    w = Window.partitionBy(*group)
    first, last = F.min("timestep").over(w), F.max("timestep").over(w)
    if mode == "truncate":
        end = series.groupBy(*group).agg(F.max("timestep").alias("e")).agg(F.min("e").alias("_end"))
        return series.join(end, how="cross").where("timestep <= _end").drop("_end").withColumn("time", F.col("timestep").cast("double"))
    if mode == "relative":
        return series.withColumn("time", F.when(last == first, 0.0).otherwise((F.col("timestep") - first) / (last - first)))
    return series.withColumn("time", F.col("timestep").cast("double"))


def change_frame_lists(merged: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per species, over the frames that list it: the timesteps at which its count is below, and above, that of the frame before."""
    w = Window.partitionBy(*by, "smiles").orderBy("timestep")
    rows = merged.withColumn("d", F.col("count") - F.lag("count").over(w))
    at = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("timestep"))))
    return rows.groupBy(*by, "smiles").agg(at(F.col("d") < 0).alias("consumption_frames"), at(F.col("d") > 0).alias("production_frames"), F.max("count").alias("peak_count"))


def change_frames(merged: DataFrame) -> DataFrame:
    """Per species, over the frames that list it: frames where it falls and rises, first and last above 0, and first at the peak."""
    w = Window.partitionBy("smiles").orderBy("timestep")
    rows = merged.withColumn("d", F.col("count") - F.lag("count").over(w))
    return rows.groupBy("smiles").agg(
        F.count_if(F.col("d") < 0).alias("n_consumption"), F.count_if(F.col("d") > 0).alias("n_production"), F.min(F.when(F.col("count") > 0, F.col("timestep"))).alias("first_timestep"),
        F.max(F.when(F.col("count") > 0, F.col("timestep"))).alias("last_timestep"), F.min_by("timestep", F.struct(-F.col("count"), F.col("timestep"))).alias("peak_timestep"),
    )


def downsample(series: DataFrame, points: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Frames spread evenly over each source, the first and the last among them; all if there are no more. series has column frame."""
    n = series.groupBy(*by).agg((F.max("frame") + 1).alias("_n"))
    index = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    wanted = n.select(*by, "_n", index.alias("i")).select(*by, F.bround(F.col("i") * (F.col("_n") - 1) / F.lit(max(points - 1, 1))).cast("long").alias("frame")).distinct()
    sized = series.join(n, [*by]) if by else series.join(n, how="cross")  # one row
    some = sized.where(F.col("_n") > points).drop("_n").join(wanted, [*by, "frame"], "left_semi").select(*series.columns)
    return sized.where(F.col("_n") <= points).drop("_n").select(*series.columns).union(some)


def every_nth(series: DataFrame, stride: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Every stride-th frame of each source from the first on, and the last one. series has column frame."""
    if stride < 1:
        raise ValueError("stride must be positive")
    last = series.groupBy(*by).agg(F.max("frame").alias("_last"))
    sized = series.join(last, [*by]) if by else series.join(last, how="cross")  # one row
    return sized.where((F.col("frame") % stride == 0) | (F.col("frame") == F.col("_last"))).drop("_last")


def catalogue(summary: DataFrame, dim: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Every species of the summary with its dimension; with stats, also those that occur in reactions only, at abundance 0."""
    columns = ["smiles", "total_count", "peak_count", "peak_timestep", "start_count", "end_count", "fwhm_frames"]
    rows = summary.select(*columns)
    if stats is not None:
        only = stats.select(F.col("species").alias("smiles")).join(summary, "smiles", "left_anti").distinct()
        rows = rows.union(only.select("smiles", *[F.lit(0).cast("long").alias(c) if c != "peak_timestep" else F.lit(None).cast("long").alias(c) for c in columns[1:]]))
    return rows.join(dim, "smiles", "left")


def search_smiles(rows: DataFrame, part: str) -> DataFrame:
    """rows (column smiles) whose SMILES contains the text, taken literally but for upper and lower case."""
    return rows.where(F.lower("smiles").contains(part.lower()))


def search_species(summary: DataFrame, dim: DataFrame, kind: str = "all", text: str = "", stats: DataFrame | None = None, tolerance: float = 0.5) -> DataFrame:
    """The species catalogue by one way of searching: all, formula (as it is), smiles (a part of it) or mass; most abundant first.

    smiles falls back, if no species of the summary fits, to species that only reactions have (stats: species), at abundance 0;
    source says which it is (species or reactions). mass gives a row for each formula within the tolerance, with the errors and
    its most abundant species as smiles; an empty smiles text is all.
    """
    if kind not in ("all", "formula", "smiles", "mass"):
        raise ValueError("kind must be all, formula, smiles or mass")
    rows = summary.join(dim, "smiles", "left").withColumn("source", F.lit("species"))
    if kind == "formula":
        rows = rows.where(F.col("formula") == text)
    elif kind == "mass":
        target = summary.sparkSession.createDataFrame([(float(text),)], "target double")
        hits = mass_hits(rows, target, max(0.0, tolerance)).groupBy("formula", "exact_mass", "nominal_mass", "ppm").agg(F.sum("total_count").alias("total_count"), F.count("*").alias("n_species"), F.min_by("smiles", F.struct(-F.col("total_count"), F.col("smiles"))).alias("smiles"))
        return hits.withColumn("mass_error", F.col("exact_mass") - float(text)).orderBy(F.desc("total_count"), "formula")
    elif kind == "smiles":
        rows = search_smiles(rows, text)
        if stats is not None and text:
            only = search_smiles(stats.select(F.col("species").alias("smiles")).distinct(), text).join(summary, "smiles", "left_anti").join(dim, "smiles", "left").withColumn("source", F.lit("reactions"))
            none = rows.limit(1).agg((F.count("*") == 0).alias("_none"))  # one row
            only = only.join(none, how="cross").where("_none").drop("_none")
            counts = [c for c in summary.columns if c != "smiles"]
            rows = rows.unionByName(only.withColumns({c: F.lit(0 if c != "peak_timestep" else None).cast(dict(summary.dtypes)[c]) for c in counts}))
    return rows.orderBy(F.desc("total_count"), "smiles")


def mass_hits(rows: DataFrame, targets: DataFrame, tolerance: float) -> DataFrame:
    """Species within the tolerance of a target mass (targets: a short list, column target), by the masses' whole parts; with the error in ppm."""
    near = targets.select("target", F.explode(F.sequence(F.floor(F.col("target") - tolerance), F.floor(F.col("target") + tolerance))).alias("_m"))
    hits = rows.withColumn("_m", F.floor("exact_mass")).join(near, "_m").where(F.abs(F.col("exact_mass") - F.col("target")) <= tolerance)
    return hits.withColumn("ppm", (F.col("exact_mass") - F.col("target")) / F.col("target") * 1e6).drop("_m")


def by_formula(rows: DataFrame, activity: str = "total_count") -> DataFrame:
    """One row per formula: the sum of activity, the number of species and the most active of them (ties: the first by name)."""
    first = F.min_by("smiles", F.struct(-F.col(activity), F.col("smiles")))
    return rows.groupBy("formula", "exact_mass").agg(F.sum(activity).alias(activity), F.count("*").alias("n_species"), first.alias("representative"))


def screen_intermediates(
    summary: DataFrame, dim: DataFrame, kind: str = "intermediate", min_peak: int = 1, start_ratio_max: float = 0.1, decay_alpha: float = 0.8, product_ratio_min: float = 0.95, reactant_start_ratio_min: float = 0.9, fwhm_min: float = 1.0, require_fwhm: bool = True
) -> DataFrame:
    """Classes by the shape of the abundance, with a score for ranking."""
    rows = summary.where(F.col("peak_count") >= min_peak).withColumn("start_ratio", F.col("start_count") / F.col("peak_count")).withColumn("end_ratio", F.col("end_count") / F.col("peak_count"))
    start, end = F.col("start_ratio"), F.col("end_ratio")
    early = start <= start_ratio_max
    kind_of = F.when(early & (end < decay_alpha), "intermediate").when(early & (end >= product_ratio_min), "product").when(~early & (start >= reactant_start_ratio_min) & (F.col("end_count") < F.col("start_count")), "reactant").otherwise("other")
    rows = rows.withColumn("class", kind_of)
    rows = rows if kind == "all" else rows.where(F.col("class") == kind)
    rows = rows.where((F.col("class") != "intermediate") | (F.col("fwhm_frames") >= fwhm_min)) if require_fwhm else rows
    score = F.when(F.col("class") == "intermediate", F.col("peak_count") * F.greatest(F.lit(0.0), 1 - end)).otherwise(F.col("peak_count").cast("double"))
    return rows.withColumn("score", score).join(dim.select("smiles", "formula", "nominal_mass"), "smiles", "left")


def rate_constants(rates: DataFrame, series: DataFrame, volume_a3: float, timestep_ps: float) -> DataFrame:
    """First- and second-order rate constants. rates: reaction_key, reactants_formulas, count; series: formula, timestep, count.

    Means are over the frames that list a formula. Volume in litres is A^3 * 1e-27. Null k where a mean is missing or zero.
    """
    if not timestep_ps or timestep_ps <= 0:
        raise ValueError("rate constants need a positive timestep_ps")
    span = series.agg(F.min("timestep").alias("a"), F.max("timestep").alias("b"), F.countDistinct("timestep").alias("n"))
    seconds = span.select((F.when(F.col("n") >= 2, F.col("b") - F.col("a")).otherwise(F.col("b")) * timestep_ps * 1e-12).alias("t"))
    means = series.groupBy("formula").agg(F.avg("count").alias("mean"))
    a = means.select(F.col("formula").alias("reactant_a"), F.col("mean").alias("mean_a"))
    b = means.select(F.col("formula").alias("reactant_b"), F.col("mean").alias("mean_b"))
    rows = rates.withColumn("k_order", F.size("reactants_formulas")).withColumn("reactant_a", F.get("reactants_formulas", F.lit(0))).withColumn("reactant_b", F.when(F.col("k_order") == 2, F.get("reactants_formulas", F.lit(1))))
    rows = rows.join(a, "reactant_a", "left").join(b, "reactant_b", "left").join(seconds, how="cross")
    # Fixed value: the Avogadro constant.
    second = F.col("count") * F.lit(6.022140857e23) * F.lit(volume_a3 * 1e-27) / (F.col("t") * F.col("mean_a") * F.col("mean_b"))
    k = F.when((F.col("k_order") == 1) & (F.col("t") > 0) & (F.col("mean_a") > 0), F.col("count") / (F.col("t") * F.col("mean_a"))).when((F.col("k_order") == 2) & (F.col("t") > 0) & (F.col("mean_a") > 0) & (F.col("mean_b") > 0), second)
    missing = F.filter(F.array(F.when(F.coalesce("mean_a", F.lit(0.0)) == 0, F.col("reactant_a")), F.when((F.col("k_order") == 2) & (F.coalesce("mean_b", F.lit(0.0)) == 0), F.col("reactant_b"))), lambda x: x.isNotNull())
    return rows.select("reaction_key", "count", "k_order", "reactant_a", "reactant_b", "mean_a", "mean_b", k.alias("k"), missing.alias("k_missing"))


def drilldown(merged: DataFrame, summary: DataFrame, dim: DataFrame, element: str, group_count: int, timestep: int, present: tuple = (), absent: tuple = (), ranges: dict | None = None) -> DataFrame:
    """Species of one element count: the count at a timestep, the peak and its time."""
    keep = dim.where(matches_elements(F.col("atom_counts"), present, absent, ranges) & (count_of(F.col("atom_counts"), element) == group_count)).select("smiles", "formula")
    now = merged.where(F.col("timestep") == timestep).select("smiles", F.col("count").alias("current_count"))
    rows = summary.join(keep, "smiles").join(now, "smiles", "left")
    return rows.select("smiles", "formula", F.coalesce("current_count", F.lit(0)).alias("current_count"), "peak_count", "peak_timestep", "total_count")


def with_flux(candidates: DataFrame, stats: DataFrame, merged_sides: DataFrame, n: int = 3) -> DataFrame:
    """Screened species with their throughput, and the n largest reactions that make and that take them, as text."""
    one = merged_sides.select("species", "role", "reaction_key", "tp").distinct()
    top = one.withColumn("n", F.row_number().over(Window.partitionBy("species", "role").orderBy(F.desc("tp"), "reaction_key"))).where(F.col("n") <= n)
    line = F.struct("n", F.concat(F.col("reaction_key"), F.lit(" (tp="), F.col("tp").cast("string"), F.lit(")")).alias("x"))
    text = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, line))), lambda s: s["x"]), " | ")
    tops = top.groupBy("species").agg(text("produce").alias("top_sources"), text("consume").alias("top_sinks"))
    flux = stats.select("species", "tp_consume", "tp_produce", "net_production").join(tops, "species").withColumnRenamed("species", "smiles")
    return candidates.join(flux, "smiles", "left")
