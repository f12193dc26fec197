"""Reaction-network aggregation. Reactions: reactants array<string>, products array<string>, tp bigint, and line_no where order matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reactions import reaction_key, stoich_delta
from ..functions.species import species_dim
from ..session import cut
from .occurrences import numbered


def merge_reactions(reactions: DataFrame, order: str = "line_no", kind: str | None = None) -> DataFrame:
    """One row per reaction key with the sum of tp; the sides as last seen and, if a column kind holds classes, the class as first seen."""
    keyed = reactions.withColumn("reaction_key", reaction_key(F.col("reactants"), F.col("products")))
    named = [kind] if kind else []
    first = [F.min_by(c, F.col(order)).alias(c) for c in named]
    return keyed.groupBy("reaction_key").agg(F.sum("tp").alias("tp"), F.max_by(F.struct("reactants", "products"), F.col(order)).alias("s"), *first).select("reaction_key", "s.reactants", "s.products", "tp", *named)


def with_reverse(merged: DataFrame) -> DataFrame:
    """Adds reverse_tp, net_tp and reversible, by a join on the reverse key."""
    back = merged.select(reaction_key(F.col("products"), F.col("reactants")).alias("reaction_key"), F.col("tp").alias("reverse_tp"))
    rows = merged.join(back, "reaction_key", "left")
    return rows.withColumn("reversible", F.col("reverse_tp").isNotNull()).withColumn("reverse_tp", F.coalesce("reverse_tp", F.lit(0))).withColumn("net_tp", F.col("tp") - F.col("reverse_tp"))


def net_flux_pairs(merged: DataFrame) -> DataFrame:
    """One row for each reversible pair in its net direction; pairs without a net and directions against it go."""
    return with_reverse(merged).where("net_tp > 0").select("reaction_key", F.col("tp").alias("gross_forward"), F.col("reverse_tp").alias("gross_reverse"), F.col("net_tp").alias("net_count"))


def sides(merged: DataFrame) -> DataFrame:
    """(species, role, reaction_key, tp): a row for each term, so that stoichiometry weighs."""
    term = F.explode(F.concat(F.transform("reactants", lambda x: F.struct(F.lit("consume").alias("role"), x.alias("species"))), F.transform("products", lambda x: F.struct(F.lit("produce").alias("role"), x.alias("species")))))
    return merged.select("reaction_key", "tp", term.alias("t")).select("t.species", "t.role", "reaction_key", "tp")


def species_stats(merged: DataFrame) -> DataFrame:
    """Throughput, channels, net production and hub score of every species."""
    is_c = F.col("role") == "consume"
    rows = sides(merged).groupBy("species").agg(
        F.sum(F.when(is_c, F.col("tp")).otherwise(0)).alias("tp_consume"), F.sum(F.when(~is_c, F.col("tp")).otherwise(0)).alias("tp_produce"), F.count_if(is_c).alias("n_consume"), F.count_if(~is_c).alias("n_produce")
    )
    return rows.select("*", (F.col("tp_consume") + F.col("tp_produce")).alias("throughput"), (F.col("tp_produce") - F.col("tp_consume")).alias("net_production"), (F.col("n_consume") + F.col("n_produce")).alias("hub_score"))


def channel_ratios(merged: DataFrame, top_n: int | None = None) -> DataFrame:
    """Share of every channel in its species' consumption or production, ranked; top_n of each if given."""
    group = ["species", "role"]
    rows = cut(sides(merged).groupBy(*group, "reaction_key").agg(F.sum("tp").alias("tp")))
    totals = rows.groupBy(*group).agg(F.sum("tp").alias("_total"))
    # Numbered by tp and the beginning of the key, so that a hub such as water is no task of its own.
    parts = rows.withColumn("part", F.struct((-F.col("tp")).alias("a"), F.substring("reaction_key", 1, 12).alias("b")))
    ranked = numbered(parts, group, "part", [F.desc("tp"), "reaction_key"], "rank").drop("part")
    ranked = ranked if top_n is None else ranked.where(F.col("rank") <= top_n)
    return ranked.join(totals, group).select(*group, "reaction_key", "tp", (F.col("tp") / F.col("_total")).alias("ratio"), "rank")


def top_reactions(merged: DataFrame, species: str, role: str, n: int) -> DataFrame:
    """The n largest reactions that consume or produce a species."""
    return sides(merged).where((F.col("species") == species) & (F.col("role") == role)).select("reaction_key", "tp").distinct().orderBy(F.desc("tp"), "reaction_key").limit(n)


def formulas_of(side: str, dim: DataFrame, merged: DataFrame) -> DataFrame:
    """(reaction_key, <side>_formulas sorted) by a join with the species dimension."""
    terms = merged.select("reaction_key", F.explode(side).alias("smiles")).join(dim.select("smiles", "formula"), "smiles")
    return terms.groupBy("reaction_key").agg(F.array_sort(F.collect_list("formula")).alias(f"{side}_formulas"))


def reaction_dim(merged: DataFrame, dim: DataFrame) -> DataFrame:
    """Formulas, nominal and exact mass of both sides of every reaction, and their difference; null if a mass is unknown."""
    rows = merged.select("reaction_key", "tp")
    for side in ("reactants", "products"):
        terms = merged.select("reaction_key", F.explode(side).alias("smiles")).join(dim, "smiles")
        known = F.count("nominal_mass") == F.count("*")
        one = terms.groupBy("reaction_key").agg(
            F.array_sort(F.collect_list("formula")).alias(f"{side}_formulas"), F.when(known, F.sum("nominal_mass")).alias(f"{side}_nominal"), F.when(known, F.sum("exact_mass")).alias(f"{side}_exact"), F.sum("n_heavy").alias(f"{side}_heavy")
        )
        rows = rows.join(one, "reaction_key")
    return rows.withColumn("nominal_delta", F.col("products_nominal") - F.col("reactants_nominal")).withColumn("exact_delta", F.col("products_exact") - F.col("reactants_exact"))


def unbalanced(merged: DataFrame, dim: DataFrame) -> DataFrame:
    """(reaction_key, element, n_reactants, n_products) of the elements that a reaction doesn't conserve."""
    signed = F.explode(F.concat(F.transform("reactants", lambda x: F.struct(x.alias("smiles"), F.lit(1).alias("left"))), F.transform("products", lambda x: F.struct(x.alias("smiles"), F.lit(0).alias("left")))))
    terms = merged.select("reaction_key", signed.alias("t")).select("reaction_key", "t.*").join(dim.select("smiles", "atom_counts"), "smiles")
    each = terms.select("reaction_key", "left", F.explode("atom_counts").alias("element", "n"))
    sums = each.groupBy("reaction_key", "element").agg(F.sum(F.col("n") * F.col("left")).alias("n_reactants"), F.sum(F.col("n") * (1 - F.col("left"))).alias("n_products"))
    return sums.where("n_reactants <> n_products")


def species_of_formula(stats: DataFrame, dim: DataFrame) -> DataFrame:
    """Every species with its share of its formula's throughput, and its rank there."""
    rows = stats.join(dim.select(F.col("smiles").alias("species"), "formula", "n_heavy"), "species")
    totals = rows.groupBy("formula").agg(F.sum("throughput").alias("_total"))
    rank = F.row_number().over(Window.partitionBy("formula").orderBy(F.desc("throughput"), "species"))  # the isomers of one formula
    return rows.join(totals, "formula").withColumn("share", F.col("throughput") / F.col("_total")).drop("_total").withColumn("rank", rank)


def species_detail(species: DataFrame, stats: DataFrame) -> DataFrame:
    """What is known of each given species (column smiles), in reactions or not: formula, masses, and its part in the network, 0 where it has none."""
    known = stats.select(F.col("species").alias("smiles"), "tp_consume", "tp_produce", "n_consume", "n_produce")
    rows = species_dim(species).join(known, "smiles", "left").fillna(0, ["tp_consume", "tp_produce", "n_consume", "n_produce"])
    throughput = F.col("tp_consume") + F.col("tp_produce")
    return rows.select("smiles", "formula", "exact_mass", "nominal_mass", "tp_consume", "tp_produce", throughput.alias("throughput"), "n_consume", "n_produce")


def rank_intermediates(stats: DataFrame, dim: DataFrame, min_heavy: int = 1, min_throughput: int = 10, exclude: tuple[str, ...] = ()) -> DataFrame:
    """score = throughput * log2(hub score + 1)."""
    rows = stats.join(dim.select(F.col("smiles").alias("species"), "formula", "n_heavy"), "species").where((F.col("n_heavy") >= min_heavy) & (F.col("throughput") >= min_throughput))
    rows = rows.where(~F.col("formula").isin(*exclude)) if exclude else rows
    return rows.withColumn("score", F.col("throughput") * F.log2(F.col("hub_score") + 1))


def resolve_start(stats: DataFrame, dim: DataFrame) -> DataFrame:
    """(formula, species): the most active species of each formula."""
    rows = stats.join(dim.select(F.col("smiles").alias("species"), "formula"), "species")
    return rows.groupBy("formula").agg(F.max_by("species", F.struct("throughput", "species")).alias("species"))


def reactions_with_formulas(dimmed: DataFrame, targets: DataFrame, role: str = "any") -> DataFrame:
    """Reactions that have a target formula (column target) on the reactant side, the product side or any; once for each target."""
    sides_ = {"reactant": ["reactants_formulas"], "product": ["products_formulas"], "any": ["reactants_formulas", "products_formulas"]}[role]
    terms = dimmed.select("reaction_key", "tp", F.explode(F.array_distinct(F.concat(*sides_))).alias("target"))
    return terms.join(targets, "target", "left_semi")


def initiation_channels(merged: DataFrame, dim: DataFrame, start: str, by: str = "formula", keep_formula: bool = False, min_loss: int = 1) -> DataFrame:
    """Channels by which a species is lost, net of the reverse reactions, with their shares and SMILES branches."""
    start_col = F.lit(start)
    rows = with_reverse(merged).where(F.array_contains("reactants", start) & (F.col("net_tp") > 0))
    rows = rows.withColumn("delta", stoich_delta(F.col("reactants"), F.col("products"), start_col)).where("delta < 0")
    rows = rows.join(formulas_of("reactants", dim, merged), "reaction_key").join(formulas_of("products", dim, merged), "reaction_key")
    rows = rows.join(dim.where(F.col("smiles") == start).select(F.col("formula").alias("start_formula")), how="cross")  # one row
    change = F.size(F.filter("products_formulas", lambda x: x == F.col("start_formula"))) - F.size(F.filter("reactants_formulas", lambda x: x == F.col("start_formula")))
    rows = rows if keep_formula else rows.where(change < 0)
    rows = rows.withColumn("loss", -F.col("delta") * F.col("net_tp")).where(F.col("loss") >= min_loss)
    formula_key = F.concat(F.array_join("reactants_formulas", "+"), F.lit("->"), F.array_join("products_formulas", "+"))
    rows = rows.withColumn("channel", formula_key if by == "formula" else F.col("reaction_key"))
    branch = F.struct((-F.col("loss")).alias("o"), F.col("reaction_key").alias("reaction_key"), F.col("loss").alias("net_start_loss"))
    out = rows.groupBy("channel").agg(F.sum("tp").alias("forward_tp"), F.sum("reverse_tp").alias("reverse_tp"), F.sum("net_tp").alias("net_events"), F.sum("loss").alias("net_start_loss"), F.array_sort(F.collect_list(branch)).alias("branches"))
    total = out.agg(F.sum("net_start_loss").alias("total"))
    return out.join(total, how="cross").select("channel", "forward_tp", "reverse_tp", "net_events", "net_start_loss", (F.col("net_start_loss") / F.col("total")).alias("share_of_loss"), F.transform("branches", lambda b: F.struct(b["reaction_key"], b["net_start_loss"])).alias("branches"))


def element_fate(merged: DataFrame, dim: DataFrame, start: str, element: str, top_n: int = 10) -> DataFrame:
    """Products of the top consuming reactions of a species: the element lost, gained or retained against it."""
    n = F.coalesce(F.try_element_at("atom_counts", F.lit(element)), F.lit(0))
    had = dim.where(F.col("smiles") == start).select(n.alias("had"))
    top = top_reactions(merged, start, "consume", top_n).join(merged.select("reaction_key", "products"), "reaction_key")
    rows = top.select("reaction_key", "tp", F.explode("products").alias("smiles")).join(dim.select("smiles", n.alias("has")), "smiles").join(had, how="cross")
    fate = F.when(F.col("has") < F.col("had"), "lost").when(F.col("has") > F.col("had"), "gained").otherwise("retained")
    return rows.select("reaction_key", "tp", F.col("smiles").alias("product"), "had", "has", fate.alias("fate"))


def with_share(rows: DataFrame, metric: Column, order: list) -> DataFrame:
    """share and cumulative share of a metric. The total is one aggregate; the running sum is over the rows given, a ranked top."""
    total = rows.agg(F.sum(metric).alias("_total"))
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(total, how="cross").withColumn("share", F.when(F.col("_total") != 0, metric / F.col("_total")).otherwise(0.0))
    return rows.withColumn("cumulative", F.when(F.col("_total") != 0, F.sum(metric).over(w) / F.col("_total")).otherwise(0.0)).drop("_total")


def reaction_terms(merged: DataFrame, dim: DataFrame) -> DataFrame:
    """(reaction_key, role, species, multiplicity, formula): the distinct terms of both sides."""
    rows = sides(merged).groupBy("reaction_key", "role", "species").agg(F.count("*").alias("multiplicity"))
    return rows.join(dim.select(F.col("smiles").alias("species"), "formula"), "species", "left")
