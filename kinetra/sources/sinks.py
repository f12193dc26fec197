"""Tables for export. Each function shapes the rows; write() stores them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import abundance as ab
from ..operators import network as nw
from ..operators import occurrences as oc


def write(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Parquet, CSV with a header, or JSON. In CSV, arrays and structs become JSON text."""
    if fmt == "csv":
        df = df.select(*[F.to_json(c).alias(c) if k.startswith(("array", "struct", "map")) else F.col(c) for c, k in df.dtypes])
    writer = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    writer.option("header", True).format(fmt).save(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_evidence(df: DataFrame, table: str, buckets: int, *keys: str) -> None:
    """A bucketed and sorted table of the catalogue, so that later joins and lookups by the keys need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(table)


#: Materialised evidence: table -> the keys of its buckets, by which later queries group and join.
EVIDENCE = {
    "occurrences": ("reaction_key",), "event_atoms": ("dataset", "event_id"), "event_species": ("dataset", "species"),
    "reaction_summary": ("reaction_key",), "abundance": ("dataset", "smiles"), "species_summary": ("dataset", "smiles"),
}


def write_evidence_tables(name: str, occurrences: DataFrame, abundance: DataFrame, buckets: int) -> None:
    """The six tables of materialised evidence, as <name>_<table> in the catalogue, each in `buckets` buckets by the keys of EVIDENCE.

    occurrences: rows of associate (or any with dataset, event_id, transition, sides, reaction_key, status, and atom_ids if there are
    atoms); abundance: dataset, timestep, smiles, count. Choose so many buckets that one fits an executor's memory: a bucket is a
    task of every later join.
    """
    merged = ab.merge_counts(abundance, ("dataset", "timestep", "smiles"))
    atoms = occurrences if "atom_ids" in occurrences.columns else occurrences.withColumn("atom_ids", F.array().cast("array<bigint>"))
    tables = {
        "occurrences": occurrences, "event_atoms": atoms.select("dataset", "event_id", F.explode("atom_ids").alias("atom")), "event_species": oc.event_species(occurrences),
        "reaction_summary": oc.reaction_summary(occurrences), "abundance": merged, "species_summary": ab.species_summary(merged, ("dataset",)),
    }
    for table, rows in tables.items():
        # Dealt out by the keys first, so that a bucket is one file.
        write_evidence(rows.repartition(buckets, *EVIDENCE[table]), f"{name}_{table}", buckets, *EVIDENCE[table])


def read_evidence_tables(spark: SparkSession, name: str) -> dict[str, DataFrame]:
    """The tables that write_evidence_tables has written under the name.

    Joins of a bucketed table on more columns than its buckets' keys, such as those of adjacent_events, need no shuffle of it if
    spark.sql.requireAllClusterKeysForCoPartition is false.
    """
    return {table: spark.table(f"{name}_{table}") for table in EVIDENCE}


def ranked_species(stats: DataFrame, dim: DataFrame, top: int = 100) -> DataFrame:
    """The species of the largest throughput by score, for export: rank, formula, smiles, throughput, both directions, net, hub score, heavy atoms, ring."""
    rows = nw.rank_intermediates(stats, dim).join(dim.select(F.col("smiles").alias("species"), "has_ring"), "species")
    rows = rows.orderBy(F.desc("score"), "species").limit(top)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "species"))  # top rows
    return rows.select(rank.alias("rank"), "formula", F.col("species").alias("smiles"), "throughput", F.col("tp_produce").alias("produce_tp"), F.col("tp_consume").alias("consume_tp"), F.col("net_production").alias("net"), "hub_score", "n_heavy", "has_ring")


def ranked_reactions(merged: DataFrame, dim: DataFrame, top: int = 200) -> DataFrame:
    """The largest reactions, for export: rank, tp, and both sides as formulas and as SMILES."""
    rows = merged.orderBy(F.desc("tp"), "reaction_key").limit(top)
    rows = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("tp"), "reaction_key")))  # top rows
    rows = rows.join(nw.formulas_of("reactants", dim, rows), "reaction_key", "left").join(nw.formulas_of("products", dim, rows), "reaction_key", "left")
    text = lambda c, name: F.array_join(c, " + ").alias(name)
    return rows.select("rank", "tp", text("reactants_formulas", "reactant_formulas"), text("products_formulas", "product_formulas"), text("reactants", "reactant_smiles"), text("products", "product_smiles"))


def channel_branches(channels: DataFrame, top: int = 500) -> DataFrame:
    """A row for each SMILES branch of the largest initiation channels (rows of initiation_channels), with its share of its channel."""
    rows = channels.orderBy(F.desc("net_start_loss"), "channel").limit(top)
    rows = rows.withColumn("parent_rank", F.row_number().over(Window.orderBy(F.desc("net_start_loss"), "channel")))  # top rows
    rows = rows.select("parent_rank", F.col("channel").alias("parent_channel"), F.col("net_start_loss").alias("parent_net_start_loss"), F.col("net_events").alias("parent_net_events"), F.posexplode("branches").alias("i", "b"))
    share = F.round(F.col("b.net_start_loss") / F.col("parent_net_start_loss") * 100, 3)
    return rows.select("parent_rank", "parent_channel", "parent_net_start_loss", "parent_net_events", (F.col("i") + 1).alias("branch_rank"), share.alias("branch_share_pct"), F.col("b.reaction_key").alias("branch_reaction"), F.col("b.net_start_loss").alias("branch_net_start_loss"))


def smiles_variants(counts: DataFrame, canonical: DataFrame) -> DataFrame:
    """(canonical, total, rank, smiles, count): the SMILES written for each canonical one (canonical: smiles, canonical; missing ones stand for themselves), with their counts.

    counts: smiles, count, repeated ones add up. rank orders the variants of a canonical SMILES by count, then name.
    """
    one = counts.groupBy("smiles").agg(F.sum("count").alias("count")).join(canonical.select("smiles", "canonical").distinct(), "smiles", "left").withColumn("canonical", F.coalesce("canonical", "smiles"))
    totals = one.groupBy("canonical").agg(F.sum("count").alias("total"))
    rank = F.row_number().over(Window.partitionBy("canonical").orderBy(F.desc("count"), "smiles"))
    return one.withColumn("rank", rank).join(totals, "canonical").select("canonical", "total", "rank", "smiles", "count")


def evolution_table(series: DataFrame, names: list[str]) -> DataFrame:
    """Raw counts, a column for each series, by frame and timestep."""
    return series.groupBy("frame", "timestep").pivot("series", names).agg(F.first("count")).orderBy("frame")


def with_query_columns(rows: DataFrame, rules: str, score: str, query: str) -> DataFrame:
    """The versions of rules and score, and the query's JSON, next to every row."""
    return rows.select("*", F.lit(rules).alias("rule_version"), F.lit(score).alias("score_version"), F.lit(query).alias("query"))


def scoped_atoms(view: DataFrame, scope: str) -> DataFrame:
    """The rows of a local view that a scope takes in: core, participants (the core among them) or context (all)."""
    names = {"core": ("core",), "participants": ("core", "participant"), "context": ("core", "participant", "environment")}
    if scope not in names:
        raise ValueError(f"scope must be one of {', '.join(names)}")
    return view.where(F.col("scope").isin(*names[scope]))
