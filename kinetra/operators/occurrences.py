"""Reaction occurrences: association of events with molecules, evidence summaries, neighbours of events.

events: dataset, transition bigint, source_row bigint, reactants array<string>, products array<string>
molecules: dataset, frame bigint, species string, atom_ids array<bigint>
occurrences: events with event_id, status, atom_ids
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reactions import compose, net_key, reaction_key, stable_id
from ..session import cut


def numbered(rows: DataFrame, group: list[str], part: str, order: list, name: str) -> DataFrame:
    """rows with their number in the group, by part, then order. A window holds one part of a group, never the whole."""
    counts = rows.groupBy(*group, part).agg(F.count("*").alias("_n"))
    starts = counts.select(*group, part, F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*group, part).orderBy(*order)))
    return inside.join(starts, [*group, part]).withColumn(name, (F.col("_start") + F.col("_i")).cast("int")).drop("_start", "_i")


def running_total(rows: DataFrame, group: list[str], part: str, order: list, value: str, name: str) -> DataFrame:
    """rows with the sum of value over the rows of the group that come before, by part, then order. A window holds one part, never a whole group."""
    upto = lambda *cols: Window.partitionBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    starts = rows.groupBy(*group, part).agg(F.sum(value).alias("_n")).select(*group, part, F.coalesce(F.sum("_n").over(upto(*group).orderBy(part)), none).alias("_start"))
    inside = rows.withColumn("_i", F.coalesce(F.sum(value).over(upto(*group, part).orderBy(*order)), none))
    return inside.join(starts, [*group, part]).withColumn(name, F.col("_start") + F.col("_i")).drop("_start", "_i")


def ordered_parts(rows: DataFrame, *order: str | Column) -> DataFrame:
    """rows with the column part: parts that follow each other in the given order, as many as shuffle partitions. Written, so that the cuts between them stay the same."""
    return cut(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))


def ranked(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with their number from 1 in the given order of all of them; parts follow each other, and no window holds more than one."""
    return numbered(ordered_parts(rows, *order), [], "part", order, name).drop("part")


def expand_counts(records: DataFrame) -> DataFrame:
    """A row for each of the count occurrences of a record, with its ordinal."""
    return records.where("count > 0").withColumn("ordinal", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count").cast("long"))))


def _sided(molecules: DataFrame) -> DataFrame:
    """Molecules as they stand before (side 0) and after (side 1) each transition, with a 64-bit node; those that don't change are left out."""
    state = molecules.select("dataset", "frame", "species", F.array_sort("atom_ids").alias("atoms"))
    ends = state.groupBy("dataset").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    state = state.join(ends, "dataset")
    before = state.where("frame < last").select("dataset", F.col("frame").alias("transition"), "species", "atoms")
    after = state.where("frame > first").select("dataset", (F.col("frame") - 1).alias("transition"), "species", "atoms")
    same = ["dataset", "transition", "species", "atoms"]
    gone = before.join(after.select(*same), same, "left_anti").withColumn("side", F.lit(0))
    came = after.join(before.select(*same), same, "left_anti").withColumn("side", F.lit(1))
    return gone.unionByName(came).withColumn("node", F.xxhash64("dataset", "transition", "side", "species", "atoms"))


def changed_components(molecules: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(dataset, transition, reactants, products, atom_ids): molecules linked by shared atoms over each transition.

    Unchanged molecules leave before the join. A node is 64 bits that stand for a molecule on its side of a transition; two that
    share them are an error, found before the search. The components of all transitions are found at once by passing on the
    smallest label, to a node's neighbours and to the node that its old label names, and by replacing labels by their labels; so
    long chains take few rounds too, each checkpointed. Labels that still move after max_rounds are an error. A component is put
    together in two levels, first by 64 parts of its nodes; so one that spans a whole frame is gathered from partial lists.
    """
    nodes = cut(_sided(molecules))
    t = ["dataset", "transition"]
    told = nodes.groupBy("node").agg(F.countDistinct(*t, "side", "species", "atoms").alias("n")).where("n > 1").limit(1)
    if told.take(1):
        raise RuntimeError("two molecules have the same 64 bits")
    # Links go from a molecule to the smallest one that holds the atom, before or after: as many as atoms, and as well connected.
    atoms = nodes.select(*t, "node", F.explode("atoms").alias("atom"))
    hubs = atoms.groupBy(*t, "atom").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    links = atoms.join(hubs, [*t, "atom"]).select(F.col("node").alias("u"), "v").where("u <> v").distinct()
    links = cut(links.union(links.select("v", "u")))
    labels = nodes.select("node", F.col("node").alias("label")).distinct()
    for _ in range(max_rounds):
        near = links.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        lower = cut(labels.join(near, "node").where("near < label"))
        if not lower.take(1):
            break
        told = lower.select("node", "near").union(lower.select(F.col("label").alias("node"), "near")).groupBy("node").agg(F.min("near").alias("near"))
        labels = cut(labels.join(told, "node", "left").select("node", F.least("label", "near").alias("label")))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = cut(labels.join(up, "label").select("node", F.col("next").alias("label")))
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    side = lambda s: F.collect_list(F.when(F.col("side") == s, F.col("species")))
    parts = nodes.join(labels, "node").withColumn("part", F.pmod("node", F.lit(64)))
    parts = parts.groupBy(*t, "label", "part").agg(side(0).alias("a"), side(1).alias("b"), F.flatten(F.collect_list("atoms")).alias("atoms"))
    whole = lambda c: F.array_sort(F.flatten(F.collect_list(c)))
    parts = parts.groupBy(*t, "label").agg(whole("a").alias("reactants"), whole("b").alias("products"), F.array_distinct(whole("atoms")).alias("atom_ids"))
    return parts.where("size(reactants) > 0 and size(products) > 0 and reactants <> products").drop("label")


def associate(events: DataFrame, molecules: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """events with event_id, reaction_key, status (matched or unresolved) and atom_ids: the n-th event of a transition and net key goes with its n-th component.

    components: rows of changed_components of the molecules, if there are some already.
    """
    parts = (changed_components(molecules) if components is None else components).withColumn("net", net_key(F.col("reactants"), F.col("products")))
    group = Window.partitionBy("dataset", "transition", "net")
    parts = parts.withColumn("n", F.row_number().over(group.orderBy("reactants", "products", "atom_ids"))).select("dataset", "transition", "net", "n", "atom_ids")
    keyed = events.withColumn("net", net_key(F.col("reactants"), F.col("products"))).withColumn("n", F.row_number().over(group.orderBy("source_row")))
    rows = keyed.join(parts, ["dataset", "transition", "net", "n"], "left")
    key = reaction_key(F.col("reactants"), F.col("products"))
    return rows.select(
        "dataset", stable_id(F.col("dataset"), F.col("transition"), F.col("source_row"), key).alias("event_id"), "transition", "source_row", "reactants", "products", key.alias("reaction_key"),
        F.when(F.col("atom_ids").isNotNull(), "matched").otherwise("unresolved").alias("status"), "atom_ids",
    )


def transitions_of_ranges(ranges: DataFrame) -> DataFrame:
    """(molecule_id, transition, change): where molecules appear (+1) and vanish (-1), from presence ranges (start_frame, end_frame).

    Ranges that touch or overlap are merged first; only their ends make rows, frames are never expanded.
    """
    w = Window.partitionBy("molecule_id").orderBy("start_frame", "end_frame")
    upto = F.max("end_frame").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start_frame") <= F.col("upto") + 1, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    merged = ranges.withColumn("upto", upto).withColumn("island", island).groupBy("molecule_id", "island").agg(F.min("start_frame").alias("a"), F.max("end_frame").alias("b"))
    ends = F.explode(F.array(F.struct((F.col("a") - 1).alias("transition"), F.lit(1).alias("change")), F.struct(F.col("b").alias("transition"), F.lit(-1).alias("change"))))
    return merged.select("molecule_id", ends.alias("e")).select("molecule_id", "e.*")


def changed_states(before: DataFrame, after: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, change): states (columns by and state, of state_key) that only one side has: vanished or appeared; equal ones cancel one for one."""
    count = lambda df, n: df.groupBy(*by, "state").agg(F.count("*").alias(n))
    both = count(before, "b").join(count(after, "a"), [*by, "state"], "full").fillna(0, ["a", "b"]).where("a <> b")
    return both.select(*by, "state", F.when(F.col("a") > F.col("b"), "appeared").otherwise("vanished").alias("change"), F.abs(F.col("a") - F.col("b")).alias("n"))


def members_at(ranges: DataFrame, frames: DataFrame) -> DataFrame:
    """(frame, molecule_id) of the molecules present at each of the frames (column frame), from ranges (molecule_id, start_frame, end_frame).

    Ranges are cut at multiples of 256 frames and meet frames by an equi join on the part; so neither side is expanded to all frames.
    """
    part = lambda c: F.floor(F.col(c) / 256)
    parts = ranges.withColumn("part", F.explode(F.sequence(part("start_frame"), part("end_frame"))))
    rows = parts.join(frames.select("frame", part("frame").alias("part")).distinct(), "part").where("frame between start_frame and end_frame")
    return rows.select("frame", "molecule_id").distinct()


def state_key(species: Column, atoms: Column, bonds: Column) -> Column:
    """One key for molecules of the same species, atoms and bonds (array of strings)."""
    return F.sha2(F.concat_ws("|", species, F.array_join(F.array_sort(atoms).cast("array<string>"), ","), F.array_join(F.array_sort(bonds), ",")), 256)


def reaction_summary(occurrences: DataFrame) -> DataFrame:
    """Per reaction key: total and matched events, distinct transitions, and the transitions of its dataset."""
    rows = occurrences.groupBy("dataset", "reaction_key").agg(F.count("*").alias("total_events"), F.count_if(F.col("status") == "matched").alias("matched_events"), F.countDistinct("transition").alias("distinct_intervals"))
    return rows.join(occurrences.groupBy("dataset").agg(F.countDistinct("transition").alias("available_intervals")), "dataset")


def events_page(occurrences: DataFrame, key: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of a reaction's events in order, at most 10000, each row with the total of all pages."""
    if not 0 < limit <= 10_000 or offset < 0:
        raise ValueError("limit must be 1 to 10000 and offset not negative")
    rows = occurrences.where(F.col("reaction_key") == key)
    page = rows.orderBy("transition", "source_row", "event_id").offset(offset).limit(limit)
    return page.join(rows.agg(F.count("*").alias("total")), how="cross")


def event_by_id(occurrences: DataFrame, dataset: str, event_id: str) -> DataFrame:
    """The one event of an id; an unknown id is an error."""
    row = occurrences.where((F.col("dataset") == dataset) & (F.col("event_id") == event_id))
    if not row.take(1):
        raise KeyError(f"{dataset} has no event {event_id}")
    return row


def event_species(occurrences: DataFrame) -> DataFrame:
    """(dataset, event_id, transition, species, side, ordinal): a row for each term, numbered by place per event, side and species."""
    side = lambda c, name: F.transform(c, lambda x, i: F.struct(F.lit(name).alias("side"), x.alias("species"), i.alias("place")))
    term = F.explode(F.concat(side("reactants", "reactant"), side("products", "product")))
    rows = occurrences.select("dataset", "event_id", "transition", "reaction_key", "status", term.alias("t")).select("dataset", "event_id", "transition", "reaction_key", "status", "t.*")
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("dataset", "event_id", "side", "species").orderBy("place"))).drop("place")


def adjacent_events(occurrences: DataFrame, anchors: DataFrame, direction: str = "later", limit: int = 10, terms: DataFrame | None = None) -> DataFrame:
    """For anchors (dataset, event_id, species, and transition if they have it): up to limit events strictly later that consume, or earlier that produce, the species; nearest first.

    Events of a species are numbered in order of time, by ranges of 64 transitions, so that a common species is no task of its
    own. An anchor counts those up to its own time, and takes the next `limit` numbers by an equi join; pairs beyond the limit
    are never made. terms: rows of event_species, if there are some already; a table in buckets by dataset and species is not
    shuffled (see sinks.read_evidence_tables).
    """
    sign, side = (1, "reactant") if direction == "later" else (-1, "product")
    terms = (event_species(occurrences) if terms is None else terms).where(F.col("side") == side).select("dataset", "species", F.col("event_id").alias("other_id"), F.col("transition").alias("other_transition")).distinct()
    start = anchors if "transition" in anchors.columns else anchors.join(occurrences.select("dataset", "event_id", "transition"), ["dataset", "event_id"])
    span = F.floor(F.col("u") / 64).alias("span")
    terms = terms.withColumn("u", sign * F.col("other_transition")).select("*", span)
    numbers = numbered(terms, ["dataset", "species"], "span", ["u", "other_id"], "r")
    # How many events of a span lie up to each time, and in all spans before: an anchor takes the last of these up to its own.
    upto = numbers.groupBy("dataset", "species", "span", "u").agg(F.max("r").alias("r"))
    tops = upto.groupBy("dataset", "species", "span").agg(F.max("r").alias("top"))
    anchored = start.select("dataset", "species", (sign * F.col("transition")).alias("u"), "event_id", "transition").select("*", span)
    # In an anchor's own span by a join on it, else from the spans before: the anchor's place among the spans of its species.
    own = anchored.join(upto.select("dataset", "species", "span", F.col("u").alias("v"), "r"), ["dataset", "species", "span"]).where("v <= u").groupBy("dataset", "species", "event_id", "transition").agg(F.max("r").alias("own"))
    places = anchored.select("dataset", "species", "span").distinct().withColumn("top", F.lit(None).cast("int")).unionByName(tops)
    places = places.groupBy("dataset", "species", "span").agg(F.max("top").alias("top"))
    sooner = F.max("top").over(Window.partitionBy("dataset", "species").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    places = places.select("dataset", "species", "span", F.coalesce(sooner, F.lit(0)).alias("sooner"))
    terms = numbers.drop("span")
    both = anchored.join(places, ["dataset", "species", "span"]).join(own, ["dataset", "species", "event_id", "transition"], "left")
    before = F.coalesce("own", "sooner")
    wanted = both.withColumn("before", before).select("dataset", "species", "event_id", "transition", "before", F.explode(F.sequence(F.lit(1), F.lit(limit))).alias("rank"))
    rows = wanted.withColumn("r", (F.col("before") + F.col("rank")).cast("int")).join(terms.drop("u"), ["dataset", "species", "r"])
    return rows.select("dataset", "event_id", "species", "transition", "other_id", "other_transition", F.abs(F.col("other_transition") - F.col("transition")).alias("gap"), "rank")


def network_continuations(merged: DataFrame, limit: int = 10) -> DataFrame:
    """(anchor_key, species, next_key, tp): other reactions that consume a product of a reaction; no order in time is claimed."""
    made = merged.select(F.col("reaction_key").alias("anchor_key"), F.explode(F.array_distinct("products")).alias("species"))
    used = merged.select(F.col("reaction_key").alias("next_key"), "tp", F.explode(F.array_distinct("reactants")).alias("species"))
    # Rank the consumers of a species before the join: an anchor needs limit + 1 of them at most, itself being one.
    used = used.withColumn("n", F.row_number().over(Window.partitionBy("species").orderBy(F.desc("tp"), "next_key"))).where(F.col("n") <= limit + 1)
    rows = made.join(used, "species").where("anchor_key <> next_key")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_key", "species").orderBy("n"))).where(F.col("rank") <= limit).drop("n")


def continuations(occurrences: DataFrame, merged: DataFrame, anchors: DataFrame, limit: int = 10) -> DataFrame:
    """Continuations of anchors (dataset, event_id, reaction_key, species) from later events where there are any, from the network otherwise; evidence_level says which."""
    seen = adjacent_events(occurrences, anchors.select("dataset", "event_id", "species"), "later", limit)
    seen = seen.join(occurrences.select("dataset", F.col("event_id").alias("other_id"), F.col("reaction_key").alias("next_key")), ["dataset", "other_id"])
    first = seen.select("dataset", "event_id", "species", "next_key", "rank", F.lit("events").alias("evidence_level"), F.lit(True).alias("can_assert_order"))
    rest = anchors.join(seen.select("dataset", "event_id", "species"), ["dataset", "event_id", "species"], "left_anti")
    network = network_continuations(merged, limit)
    second = rest.join(network, (rest["reaction_key"] == network["anchor_key"]) & (rest["species"] == network["species"])).select("dataset", "event_id", rest["species"], "next_key", "rank", F.lit("network").alias("evidence_level"), F.lit(False).alias("can_assert_order"))
    return first.union(second)


def composed_pairs(merged: DataFrame, limit: int = 3) -> DataFrame:
    """Net change of each reaction with its continuations: (anchor_key, species, next_key, net_key)."""
    pairs = network_continuations(merged, limit)
    a = merged.select(F.col("reaction_key").alias("anchor_key"), F.col("reactants").alias("r1"), F.col("products").alias("p1"))
    b = merged.select(F.col("reaction_key").alias("next_key"), F.col("reactants").alias("r2"), F.col("products").alias("p2"))
    rows = pairs.join(a, "anchor_key").join(b, "next_key")
    left, right = compose(F.col("r1"), F.col("p1"), F.col("r2"), F.col("p2"), F.col("species"))
    return rows.select("anchor_key", "species", "next_key", net_key(left, right).alias("net_key"))


def with_evidence(merged: DataFrame, summary: DataFrame | None) -> DataFrame:
    """merged with event counts and coverages: zeros where a reaction has no events, nulls and network_only where there is no evidence at all.

    Several datasets of a summary add up, so every reaction keeps one row.
    """
    if summary is None:
        empty = {c: F.lit(None).cast("double" if "coverage" in c else "long") for c in ("total_events", "matched_events", "distinct_intervals", "event_coverage", "time_coverage")}
        return merged.withColumns(empty).withColumn("evidence_status", F.lit("network_only"))
    columns = ["total_events", "matched_events", "distinct_intervals"]
    sums = summary.groupBy("reaction_key").agg(*[F.sum(c).alias(c) for c in columns])
    available = summary.select("dataset", "available_intervals").distinct().agg(F.coalesce(F.sum("available_intervals"), F.lit(0)).alias("available_intervals"))
    rows = merged.join(sums, "reaction_key", "left").fillna(0, columns).join(available, how="cross")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return rows.withColumn("event_coverage", share("matched_events", "total_events")).withColumn("time_coverage", share("distinct_intervals", "available_intervals")).withColumn("evidence_status", F.lit("evidence_linked"))


def changed_atoms(bonds: DataFrame) -> DataFrame:
    """(event_id, n_broken, n_formed, atoms): of the rows of bond_table, how many bonds change and the sorted atoms at their ends."""
    ends = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("change") != "unchanged", F.array("atom1", "atom2"))))))
    return bonds.groupBy("event_id").agg(F.count_if(F.col("change") == "broken").alias("n_broken"), F.count_if(F.col("change") == "formed").alias("n_formed"), ends.alias("atoms"))


def representative_events(occurrences: DataFrame, frames: DataFrame, bonds: DataFrame | None = None) -> DataFrame:
    """occurrences with their rank in their reaction, and why: recommended, reviewable or unavailable (tier 0, 1 or 2).

    Recommended are matched events with frames on both sides whose bonds change (bonds: rows of bond_table; without, none do);
    reviewable those whose bonds don't; all others are unavailable. frames: dataset, frame; an event stands between its transition
    and the next frame. Ties go by transition and event_id.
    """
    before = frames.select("dataset", F.col("frame").alias("transition")).distinct()
    after = frames.select("dataset", (F.col("frame") - 1).alias("transition")).distinct()
    both = before.join(after, ["dataset", "transition"]).withColumn("framed", F.lit(True))
    rows = occurrences.join(both, ["dataset", "transition"], "left").withColumn("trajectory_ready", F.coalesce("framed", F.lit(False))).drop("framed")
    if bonds is None:
        rows = rows.withColumns({"n_broken": F.lit(0).cast("long"), "n_formed": F.lit(0).cast("long"), "changed_atoms": F.array().cast("array<bigint>")})
    else:
        rows = rows.join(changed_atoms(bonds).withColumnRenamed("atoms", "changed_atoms"), "event_id", "left")
        rows = rows.withColumns({"n_broken": F.coalesce("n_broken", F.lit(0)), "n_formed": F.coalesce("n_formed", F.lit(0)), "changed_atoms": F.coalesce("changed_atoms", F.array())})
    matched = (F.col("status") == "matched") & (F.size("atom_ids") > 0 if "atom_ids" in occurrences.columns else F.lit(True))
    ready, changes = matched & F.col("trajectory_ready"), F.col("n_broken") + F.col("n_formed") > 0
    tier = F.when(ready & changes, 0).when(ready, 1).otherwise(2)
    reason = F.when(ready & changes, "atoms, bond changes and frames can be checked").when(ready, "no bond changes that tell the sides apart").when(~matched, "no atoms are associated").otherwise("frames before or after are missing")
    rows = rows.withColumns({"tier": tier, "reason": reason, "recommendation": F.get(F.array(F.lit("recommended"), F.lit("reviewable"), F.lit("unavailable")), tier)})
    # Numbered by tier and ranges of 64 transitions, so that a common reaction is no task of its own.
    rows = rows.withColumn("part", F.struct("tier", F.floor(F.col("transition") / 64).alias("span")))
    return numbered(rows, ["dataset", "reaction_key"], "part", ["transition", "event_id"], "rank").drop("part")


def bond_changes(bonds: DataFrame) -> DataFrame:
    """(event_id, atom1, atom2, state): bonds formed, broken or kept. bonds: event_id, side (before or after), atom1, atom2."""
    rows = bonds.select("event_id", "side", F.least("atom1", "atom2").alias("atom1"), F.greatest("atom1", "atom2").alias("atom2"))
    seen = rows.groupBy("event_id", "atom1", "atom2").agg(F.max((F.col("side") == "before").cast("int")).alias("b"), F.max((F.col("side") == "after").cast("int")).alias("a"))
    return seen.select("event_id", "atom1", "atom2", F.when(F.col("b") + F.col("a") == 2, "kept").when(F.col("a") == 1, "formed").otherwise("broken").alias("state"))


def bond_table(bonds: DataFrame) -> DataFrame:
    """(event_id, state, atom1, atom2, bond_order, change): each bond of each side once; one of another order is another bond.

    bonds: event_id, side (before or after), atom1, atom2, bond_order. state is reactant or product, change broken, formed or unchanged.
    """
    rows = bonds.select("event_id", "side", F.least("atom1", "atom2").alias("atom1"), F.greatest("atom1", "atom2").alias("atom2"), "bond_order")
    seen = rows.groupBy("event_id", "atom1", "atom2", "bond_order").agg(F.max(F.col("side") == "before").alias("b"), F.max(F.col("side") == "after").alias("a"))
    state = F.explode(F.filter(F.array(F.when(F.col("b"), "reactant"), F.when(F.col("a"), "product")), lambda s: s.isNotNull()))
    change = F.when(F.col("a") & F.col("b"), "unchanged").when(F.col("b"), "broken").otherwise("formed")
    return seen.select("event_id", state.alias("state"), "atom1", "atom2", "bond_order", change.alias("change"))


def occurrence_check(steps: DataFrame, occurrences: DataFrame, limit: int = 3) -> DataFrame:
    """Path steps (start, rank, step, reaction_key) with the number of events of exactly that key, the first of them, and whether there is any."""
    # The first of each of 64 parts of a reaction's events, then the first of those.
    salted = occurrences.withColumn("salt", F.pmod(F.xxhash64("event_id"), F.lit(64)))
    heads = salted.withColumn("n", F.row_number().over(Window.partitionBy("reaction_key", "salt").orderBy("transition", "event_id"))).where(F.col("n") <= limit)
    heads = heads.withColumn("n", F.row_number().over(Window.partitionBy("reaction_key").orderBy("transition", "event_id"))).where(F.col("n") <= limit)
    heads = heads.groupBy("reaction_key").agg(F.array_sort(F.collect_list(F.struct("n", "event_id"))).alias("first"))
    seen = occurrences.groupBy("reaction_key").agg(F.count("*").alias("n_events")).join(heads, "reaction_key")
    rows = steps.join(seen, "reaction_key", "left")
    return rows.select(*steps.columns, F.coalesce("n_events", F.lit(0)).alias("n_events"), F.transform(F.coalesce("first", F.expr("cast(array() as array<struct<n:int,event_id:string>>)")), lambda x: x["event_id"]).alias("events"), F.col("n_events").isNotNull().alias("can_assert_occurrence"))
