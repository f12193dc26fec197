"""Integrity audits: each returns rows (rule, detail) of what is wrong; require_clean raises if there are any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.occurrences import numbered
from ..session import cut


def _found(rows: DataFrame, rule: str, *detail: str) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.concat_ws(" ", *[F.col(c).cast("string") for c in detail]).alias("detail"))


def audit_timeline(tables: dict[str, DataFrame]) -> DataFrame:
    """Unknown and repeated ids, bad and overlapping ranges, bad counts, and frames out of order."""
    frames, events, types, species, molecules, ranges = (tables[n] for n in ("frames", "reaction_events", "reaction_types", "species", "molecules", "molecule_ranges"))
    n = frames.agg(F.count("*").alias("n_frames"))
    # Frames are numbered by ranges, so that no task holds a source, and meet the one before by its number.
    order = numbered(frames.withColumn("part", F.floor(F.col("source_frame") / (1 << 16))), ["source_id"], "part", ["source_frame"], "n")
    order = order.join(order.select("source_id", (F.col("n") + 1).alias("n"), F.col("timestep").alias("p")), ["source_id", "n"])
    sooner = F.max("end_frame").over(Window.partitionBy("molecule_id").orderBy("start_frame", "end_frame").rowsBetween(Window.unboundedPreceding, -1))
    twice = lambda rows, c: _found(rows.groupBy(c).agg(F.count("*").alias("n")).where("n > 1"), f"repeated {c.replace('_', ' ')}", c)
    return reduce(
        DataFrame.union,
        [
            *(twice(rows, c) for rows, c in ((types, "reaction_id"), (species, "species_id"), (molecules, "molecule_id"))),
            _found(ranges.withColumn("sooner", sooner).where("start_frame <= sooner"), "ranges overlap", "molecule_id", "start_frame"),
            _found(events.join(types, "reaction_id", "left_anti"), "unknown reaction id", "transition_index", "reaction_id"),
            _found(molecules.join(species, "species_id", "left_anti"), "unknown species id", "molecule_id", "species_id"),
            _found(ranges.join(molecules, "molecule_id", "left_anti"), "unknown molecule id", "molecule_id"),
            _found(ranges.where("start_frame > end_frame"), "range ends before it starts", "molecule_id", "start_frame"),
            _found(ranges.join(n, how="cross").where("start_frame < 0 or end_frame >= n_frames"), "range outside of the frames", "molecule_id", "start_frame"),
            _found(events.join(n, how="cross").where("transition_index < 0 or transition_index >= n_frames - 1"), "transition outside of the frames", "transition_index"),
            _found(events.where("count <= 0"), "count not positive", "transition_index", "reaction_id"),
            _found(order.where("p >= timestep"), "timesteps don't increase", "source_id", "source_frame"),
        ],
    )


def audit_events(events: DataFrame, span: int = 1 << 16) -> DataFrame:
    """Events of a source (dataset) that stand behind one of a later transition, source rows that are given twice, and gaps between them.

    Source rows are cut into ranges of `span` numbers. Each range hands the greatest transition and the last row so far to the next
    ones, so that no task holds a source; a window over ranges has a row for each. Ranges count from the row's own number, so far
    apart rows are far apart ranges. Null transitions or rows are left to other checks.
    """
    rows = events.where("source_row is not null and transition is not null").select("dataset", "source_row", "transition", F.floor(F.col("source_row") / span).alias("range"))
    ends = rows.groupBy("dataset", "range").agg(F.max("transition").alias("top"), F.max("source_row").alias("last"), F.min("source_row").alias("first"))
    before = Window.partitionBy("dataset").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = cut(ends.select("dataset", "range", F.max("top").over(before).alias("top"), F.max("last").over(before).alias("last")))
    inside = Window.partitionBy("dataset", "range").orderBy("source_row")
    so_far = F.max("transition").over(inside.rangeBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("inside", so_far).withColumn("p", F.max("source_row").over(inside.rangeBetween(Window.unboundedPreceding, -1)))
    twice = _found(rows.groupBy("dataset", "source_row").agg(F.count("*").alias("n")).where("n > 1"), "source row given twice", "dataset", "source_row")
    rows = rows.join(ends, ["dataset", "range"]).withColumn("sooner", F.greatest("inside", "top")).withColumn("p", F.coalesce("p", "last"))
    gaps = rows.where("p < source_row - 1").select("dataset", (F.col("p") + 1).alias("from"), (F.col("source_row") - 1).alias("to")).distinct()
    return _found(rows.where("sooner > transition"), "events out of order", "dataset", "source_row", "transition").union(twice).union(_found(gaps, "source rows missing", "dataset", "from", "to"))


def audit_trajectory(frames: DataFrame) -> DataFrame:
    """Frames that the trajectory reader finds wrong, and timesteps given twice."""
    bad = frames.where("error is not null").select(F.col("error").alias("rule"), F.concat_ws(" ", F.element_at(F.split("file", "/"), -1), F.col("timestep").cast("string")).alias("detail"))
    return bad.union(_found(frames.groupBy("timestep").agg(F.count("*").alias("n")).where("timestep is not null and n > 1"), "timestep given twice", "timestep"))


def require_clean(audit: DataFrame) -> None:
    if bad := audit.limit(20).collect():
        raise ValueError("bad evidence: " + "; ".join(f"{r['rule']}: {r['detail']}" for r in bad))
