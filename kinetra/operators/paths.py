"""Event paths along atoms, reachable paths of the aggregated network, and bounded candidate paths.

nodes: replicate, event_id, t bigint, reaction_key, status, reactants and products array<string>,
consumed and produced array<struct<species:string, atoms:string>> (atoms: sorted ids, comma-joined)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reactions import stable_id
from ..session import cut
from .network import with_reverse
from .occurrences import ordered_parts, running_total


def event_edges(nodes: DataFrame, bucket: int = 64) -> DataFrame:
    """(replicate, from_id, to_id, t_from, t_to, idle_gap, anchor_gap, carriers): a product molecule and the first later event that consumes it.

    Consumption in a transition comes before production. An instance that two events of a transition consume, or produce, is
    ambiguous and makes no edge. An unresolved event ends all open instances of its species. nodes may have before_timestep and
    after_timestep, the ends of an event's transition; without, a transition lasts from t to t + 1. idle_gap is the time between the
    end of the first and the begin of the second event's transition, anchor_gap that between their ends.
    """
    clock = lambda c, other: (F.col(c) if c in nodes.columns else other).cast("long").alias(c)
    nodes = nodes.withColumns({"before_timestep": clock("before_timestep", F.col("t")), "after_timestep": clock("after_timestep", F.col("t") + 1)})
    act = lambda side, phase: nodes.where("status = 'matched'").select("replicate", "event_id", "t", "before_timestep", "after_timestep", F.explode(F.array_distinct(side)).alias("i")).select("replicate", "i.species", "i.atoms", "t", F.lit(phase).alias("phase"), "event_id", "before_timestep", "after_timestep")
    actions = act("consumed", 1).union(act("produced", 2))
    actions = actions.groupBy("replicate", "species", "atoms", "t", "phase").agg(F.min(F.struct("event_id", "before_timestep", "after_timestep")).alias("e"), (F.count("*") > 1).alias("many"))
    w = Window.partitionBy("replicate", "species", "atoms").orderBy("t", "phase")
    last = F.lag(F.struct("t", "phase", "e", "many")).over(w)
    open_ = actions.withColumn("p", last).where("phase = 1 and not many and p.phase = 2 and not p.many and p.t < t")
    idle, anchor = F.greatest(F.lit(0).cast("long"), F.col("e.before_timestep") - F.col("p.e.after_timestep")), F.col("e.after_timestep") - F.col("p.e.after_timestep")
    pairs = open_.select("replicate", "species", "atoms", F.col("p.e.event_id").alias("from_id"), F.col("e.event_id").alias("to_id"), F.col("p.t").alias("t_from"), F.col("t").alias("t_to"), idle.alias("idle_gap"), anchor.alias("anchor_gap"))
    barriers = nodes.where("status <> 'matched'").select("replicate", F.explode(F.array_union("reactants", "products")).alias("species"), F.col("t").alias("b")).distinct()
    # The last barrier up to t_to, by ranges of t, so that a common species is no task of its own.
    edges = pairs.select("replicate", "species", F.col("t_to").alias("t")).distinct().join(barriers.select("replicate", "species").distinct(), ["replicate", "species"], "left_semi")
    both = edges.select("replicate", "species", "t", F.lit(None).cast("long").alias("b")).union(barriers.select("replicate", "species", F.col("b").alias("t"), "b")).withColumn("r", F.floor(F.col("t") / bucket))
    tops = both.groupBy("replicate", "species", "r").agg(F.max("b").alias("top"))
    tops = tops.select("replicate", "species", "r", F.max("top").over(Window.partitionBy("replicate", "species").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    inside = F.max("b").over(Window.partitionBy("replicate", "species", "r").orderBy("t").rangeBetween(Window.unboundedPreceding, 0))
    lasts = both.withColumn("i", inside).where("b is null").join(tops, ["replicate", "species", "r"]).select("replicate", "species", F.col("t").alias("t_to"), F.coalesce("i", "before").alias("b"))
    pairs = pairs.join(lasts, ["replicate", "species", "t_to"], "left").where("b is null or b <= t_from")
    carriers = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("atoms", ",")))))
    return pairs.groupBy("replicate", "from_id", "to_id", "t_from", "t_to", "idle_gap", "anchor_gap").agg(carriers.alias("carriers"))


def _atom_edges(nodes: DataFrame, edges: DataFrame, max_gap: int | None, max_idle: int | None, start: str | None) -> tuple[DataFrame, DataFrame]:
    """Edges that keep the limits, a row for each atom that they carry, with the second event's key; and of these the ones a path may begin with."""
    if "idle_gap" not in edges.columns:
        edges = edges.withColumns({"idle_gap": F.greatest(F.lit(0).cast("long"), F.col("t_to") - F.col("t_from") - 1), "anchor_gap": F.col("t_to") - F.col("t_from")})
    kept = edges if max_gap is None else edges.where(F.col("t_to") - F.col("t_from") <= max_gap)
    kept = kept if max_idle is None else kept.where(F.col("idle_gap") <= max_idle)
    keys = nodes.select("replicate", F.col("event_id").alias("to_id"), F.col("reaction_key").alias("to_key"))
    rows = kept.join(keys, ["replicate", "to_id"]).select("replicate", "from_id", "to_id", "to_key", "t_from", "t_to", "idle_gap", "anchor_gap", F.explode("carriers").alias("atom"))
    first = (nodes if start is None else nodes.where(F.array_contains("reactants", start))).select("replicate", F.col("event_id").alias("from_id"), F.col("reaction_key").alias("from_key"))
    return rows, rows.join(first, ["replicate", "from_id"])


def count_paths(nodes: DataFrame, edges: DataFrame, length: int = 3, max_gap: int | None = None, start: str | None = None, max_idle: int | None = None) -> DataFrame:
    """(replicate, from_id, t_from, n): how many paths of `length` events begin with an event, counted once for each atom that runs through them.

    By dynamic programming from the last events back: an event's count for an atom is the sum of those of the next ones. No path
    is made, so this is exact and cheap on any graph. Events without paths are left out.
    """
    rows, first = _atom_edges(nodes, edges, max_gap, max_idle, start)
    ahead = None
    for step in range(length - 1):
        here = first if step == length - 2 else rows
        if ahead is not None:
            here = here.join(ahead.select("replicate", "atom", F.col("from_id").alias("to_id"), F.col("n").alias("m")), ["replicate", "atom", "to_id"])
        ahead = here.groupBy("replicate", "atom", "from_id", "t_from").agg((F.count("*") if ahead is None else F.sum("m")).alias("n"))
        ahead = ahead if step == length - 2 else ahead.drop("t_from")
    return ahead.groupBy("replicate", "from_id", "t_from").agg(F.sum("n").alias("n"))


def event_paths(nodes: DataFrame, edges: DataFrame, length: int = 3, max_gap: int | None = None, start: str | None = None, max_idle: int | None = None, max_paths: int | None = None, bucket: int = 64) -> DataFrame:
    """(replicate, path_id, event_ids, reaction_keys, lineage, t_first, t_last, gaps, idle_gaps, anchor_gaps, complete): chains of `length` events that at least one atom runs through.

    Paths are followed atom by atom, as the lineage is the set of atoms that every edge carries: no chain is made that no atom runs
    through. max_paths limits the work in each replicate: the paths are counted first (count_paths), and only those that begin with
    the earliest events are made, up to the event that reaches the limit. complete is false in a replicate where some are left out.
    """
    if not 2 <= length <= 8 or (max_paths is not None and max_paths < 1):
        raise ValueError("length must be 2 to 8 and max_paths positive")
    rows, paths = _atom_edges(nodes, edges, max_gap, max_idle, start)
    complete = None
    if max_paths is not None:
        counts = count_paths(nodes, edges, length, max_gap, start, max_idle).withColumn("part", F.floor(F.col("t_from") / bucket))
        counts = cut(running_total(counts, ["replicate"], "part", ["t_from", "from_id"], "n", "before"))
        paths = paths.join(counts.where(F.col("before") < max_paths).select("replicate", "from_id"), ["replicate", "from_id"])
        complete = counts.groupBy("replicate").agg((F.max("before") < max_paths).alias("complete"))
    gaps = {"gaps": F.col("t_to") - F.col("t_from"), "idle_gaps": F.col("idle_gap"), "anchor_gaps": F.col("anchor_gap")}
    paths = paths.select("replicate", "atom", F.col("to_id").alias("end"), F.array("from_id", "to_id").alias("event_ids"), F.array("from_key", "to_key").alias("reaction_keys"), F.col("t_from").alias("t_first"), F.col("t_to").alias("t_last"), *[F.array(g).alias(c) for c, g in gaps.items()])
    for _ in range(length - 2):
        step = paths.join(rows.withColumnRenamed("from_id", "end"), ["replicate", "atom", "end"])
        paths = step.select("replicate", "atom", F.col("to_id").alias("end"), F.array_append("event_ids", F.col("to_id")).alias("event_ids"), F.array_append("reaction_keys", F.col("to_key")).alias("reaction_keys"), "t_first", F.col("t_to").alias("t_last"), *[F.array_append(c, g).alias(c) for c, g in gaps.items()])
    paths = paths.groupBy("replicate", "event_ids", "reaction_keys", "t_first", "t_last", *gaps).agg(F.array_sort(F.collect_set("atom")).alias("lineage"))
    paths = paths.withColumn("path_id", stable_id(F.col("replicate"), F.array_join("event_ids", "\x00")))
    paths = paths.withColumn("complete", F.lit(True)) if complete is None else paths.join(complete, "replicate")
    return paths.select("replicate", "path_id", "event_ids", "reaction_keys", "lineage", "t_first", "t_last", *gaps, "complete")


def path_signatures(paths: DataFrame) -> DataFrame:
    """Per sequence of reaction keys: occurrences, distinct (replicate, atom) pairs, lineage sets, replicates and their share, and the spans.

    support_is_lower_bound says that paths of some replicate were left out, so that all counts may be too small.
    """
    signature = F.array_join("reaction_keys", " => ")
    rows = paths.withColumn("signature", signature).withColumn("span", F.col("t_last") - F.col("t_first"))
    replicates = paths.agg(F.countDistinct("replicate").alias("all"), F.coalesce(~F.bool_and("complete"), F.lit(False)).alias("support_is_lower_bound"))
    atoms = rows.select("signature", "replicate", F.explode("lineage").alias("atom")).distinct().groupBy("signature").agg(F.count("*").alias("n_atoms"))
    main = rows.groupBy("signature").agg(
        F.count("*").alias("n_occurrences"), F.countDistinct("replicate", F.array_join("lineage", ",")).alias("n_lineages"), F.countDistinct("replicate").alias("n_replicates"),
        F.min("span").alias("span_min"), F.median("span").alias("span_median"), F.avg("span").alias("span_mean"), F.max("span").alias("span_max"),
    )
    return main.join(atoms, "signature").join(replicates, how="cross").select("*", (F.col("n_replicates") / F.col("all")).alias("support")).drop("all")


def path_details(paths: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(path_id, replicate, position, event_id, reaction_key, gap, idle_gap, anchor_gap, carriers): a row for each event of each path.

    Gaps are those to the event before, and carriers the atoms that the edge from it carries (null without edges); both are null
    for the first event.
    """
    rows = paths.select("path_id", "replicate", "gaps", "idle_gaps", "anchor_gaps", "event_ids", F.posexplode("reaction_keys").alias("position", "reaction_key"))
    at = lambda c: F.get(c, F.col("position") - 1)
    rows = rows.select("path_id", "replicate", "position", F.get("event_ids", F.col("position")).alias("event_id"), at("event_ids").alias("from_id"), "reaction_key", at("gaps").alias("gap"), at("idle_gaps").alias("idle_gap"), at("anchor_gaps").alias("anchor_gap"))
    if edges is None:
        return rows.drop("from_id").withColumn("carriers", F.lit(None).cast("array<string>"))
    carried = edges.select("replicate", "from_id", F.col("to_id").alias("event_id"), "carriers")
    return rows.join(carried, ["replicate", "from_id", "event_id"], "left").select("path_id", "replicate", "position", "event_id", "reaction_key", "gap", "idle_gap", "anchor_gap", "carriers")


def _follows(merged: DataFrame, *by: str) -> DataFrame:
    """(*by, from_key, to_key, via): reactions that make what another one takes, with the species that link them, in order."""
    takes = merged.select(*by, F.col("reaction_key").alias("to_key"), F.explode(F.array_distinct("reactants")).alias("species"))
    makes = merged.select(*by, F.col("reaction_key").alias("from_key"), F.explode(F.array_distinct("products")).alias("species"))
    return makes.join(takes, [*by, "species"]).groupBy(*by, "from_key", "to_key").agg(F.array_sort(F.collect_set("species")).alias("via"))


def count_reachable(merged: DataFrame, length: int = 3, start: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, n): how many reachable sequences of `length` reactions there are, by dynamic programming; none is made. n is a decimal, as it may pass 64 bits."""
    follows = cut(_follows(merged, *by).select(*by, "from_key", "to_key"))
    counts = merged.select(*by, F.col("reaction_key").alias("to_key"), F.lit(1).cast("decimal(38,0)").alias("n"))
    for _ in range(length - 1):
        counts = follows.join(counts, [*by, "to_key"]).groupBy(*by, "from_key").agg(F.sum("n").cast("decimal(38,0)").alias("n")).withColumnRenamed("from_key", "to_key")
    first = (merged if start is None else merged.where(F.array_contains("reactants", start))).select(*by, F.col("reaction_key").alias("to_key"))
    return counts.join(first, [*by, "to_key"]).groupBy(*by).agg(F.sum("n").cast("decimal(38,0)").alias("n"))


def reachable_paths(merged: DataFrame, length: int = 3, start: str | None = None) -> DataFrame:
    """(reaction_keys): sequences in which each reaction makes a species that the next one takes; by joins on the shared species."""
    takes = merged.select("reaction_key", F.explode(F.array_distinct("reactants")).alias("species"))
    makes = merged.select(F.col("reaction_key").alias("from_key"), F.explode(F.array_distinct("products")).alias("species"))
    follows = cut(makes.join(takes, "species").select("from_key", F.col("reaction_key").alias("to_key")).distinct())
    paths = (merged if start is None else merged.where(F.array_contains("reactants", start))).select(F.array("reaction_key").alias("reaction_keys"), F.col("reaction_key").alias("from_key"))
    for _ in range(length - 1):
        paths = paths.join(follows, "from_key").select(F.array_append("reaction_keys", F.col("to_key")).alias("reaction_keys"), F.col("to_key").alias("from_key"))
    return paths.select("reaction_keys")


def reachable_with_bridges(merged: DataFrame, length: int = 3, start: str | None = None, max_paths: int = 100_000, max_variants: int = 20) -> DataFrame:
    """(reaction_keys, bridges, truncated): the first max_paths reachable sequences in order of their keys, with the species that link their steps.

    bridges holds the first max_variants choices of a linking species for each step, in order; a prefix has an extension
    whenever its path has, so cutting the choices at every step loses none of them. truncated says that there are more paths.
    """
    if not 2 <= length <= 8 or max_paths < 1:
        raise ValueError("length must be 2 to 8 and max_paths positive")
    follows = cut(_follows(merged))
    # ahead[k]: how many sequences of k more reactions follow on a reaction, or max_paths + 1 if there are more.
    some = max_paths + 1
    ahead = [merged.select("reaction_key", F.lit(1).cast("long").alias("n"))]
    for _ in range(length - 1):
        more = follows.join(ahead[-1].withColumnRenamed("reaction_key", "to_key"), "to_key").groupBy("from_key").agg(F.least(F.sum("n"), F.lit(some)).cast("long").alias("n"))
        ahead.append(cut(more.withColumnRenamed("from_key", "reaction_key")))
    first = merged if start is None else merged.where(F.array_contains("reactants", start))
    paths = first.select("reaction_key", F.array("reaction_key").alias("reaction_keys"), F.array(F.array().cast("array<string>")).alias("bridges"))
    for left in range(length - 1, -1, -1):
        # In order of keys, the beginnings whose sequences are among the first; each has at least one, so max_paths + 1 at most stay.
        rows = ordered_parts(paths.join(ahead[left], "reaction_key"), "reaction_keys").withColumn("one", F.lit(0))
        paths = cut(running_total(rows, ["one"], "part", ["reaction_keys"], "n", "before").where(F.col("before") < some).select("reaction_key", "reaction_keys", "bridges", "before"))
        if left:
            further = F.flatten(F.transform("bridges", lambda done: F.transform("via", lambda s: F.array_append(done, s))))
            paths = paths.join(follows.withColumnRenamed("from_key", "reaction_key"), "reaction_key").select(F.col("to_key").alias("reaction_key"), F.array_append("reaction_keys", F.col("to_key")).alias("reaction_keys"), F.slice(further, 1, max_variants).alias("bridges"))
    truncated = paths.agg((F.count("*") > max_paths).alias("truncated"))
    return paths.where(F.col("before") < max_paths).crossJoin(F.broadcast(truncated)).select("reaction_keys", "bridges", "truncated")


def compare_with_network(paths: DataFrame, merged: DataFrame, start: str | None = None, length: int = 3) -> DataFrame:
    """Per replicate of merged (its own reactions: replicate, reaction_key, reactants, products): paths that occur against those its network allows.

    (replicate, n_reachable, n_actual, n_confirmed, n_actual_only, n_aggregate_only, realised, actual_is_lower_bound). The network's
    sequences are counted, not made, and a sequence that occurs is confirmed by its steps, so no count is a lower bound on their
    account. Where paths of a replicate were left out, n_aggregate_only and realised are null. Replicates of paths without reactions
    are left out; those without paths have no actual ones.
    """
    follows = _follows(merged, "replicate").select("replicate", "from_key", "to_key").withColumn("ok", F.lit(True))
    actual = paths.select("replicate", "reaction_keys").distinct().withColumn("signature", F.array_join("reaction_keys", " => "))
    first = merged if start is None else merged.where(F.array_contains("reactants", start))
    begins = actual.join(first.select("replicate", F.col("reaction_key").alias("k")), (F.col("k") == F.get("reaction_keys", F.lit(0))) & (actual["replicate"] == first["replicate"]), "left_semi").select("replicate", "signature")
    pairs = actual.select("replicate", "signature", F.posexplode(F.slice("reaction_keys", 2, 8)).alias("i", "to_key"), "reaction_keys").withColumn("from_key", F.get("reaction_keys", F.col("i"))).drop("reaction_keys")
    steps = pairs.join(follows, ["replicate", "from_key", "to_key"], "left").groupBy("replicate", "signature").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("linked"))
    confirmed = steps.where("linked").join(begins, ["replicate", "signature"], "left_semi").groupBy("replicate").agg(F.count("*").alias("n_confirmed"))
    found = actual.groupBy("replicate").agg(F.count("*").alias("n_actual")).join(paths.groupBy("replicate").agg((~F.bool_and("complete")).alias("cut")), "replicate")
    rows = merged.select("replicate").distinct().join(count_reachable(merged, length, start, ("replicate",)), "replicate", "left").join(found, "replicate", "left").join(confirmed, "replicate", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = rows.select("replicate", F.coalesce("n", F.lit(0)).cast("decimal(38,0)").alias("n_reachable"), zero("n_actual"), zero("n_confirmed"), F.coalesce("cut", F.lit(False)).alias("actual_is_lower_bound"))
    whole = ~F.col("actual_is_lower_bound")
    share = F.when(F.col("n_reachable") > 0, F.col("n_confirmed") / F.col("n_reachable").cast("double")).otherwise(0.0)
    return rows.select("replicate", "n_reachable", "n_actual", "n_confirmed", (F.col("n_actual") - F.col("n_confirmed")).alias("n_actual_only"), F.when(whole, F.col("n_reachable") - F.col("n_confirmed")).cast("decimal(38,0)").alias("n_aggregate_only"), F.when(whole, share).alias("realised"), "actual_is_lower_bound")


def compare_paths(paths: DataFrame, reachable: DataFrame) -> DataFrame:
    """Per replicate: signatures that occur, that are also reachable, that only occur, that are only reachable, and the realised share."""
    actual = paths.select("replicate", F.array_join("reaction_keys", " => ").alias("signature")).distinct()
    possible = reachable.select(F.array_join("reaction_keys", " => ").alias("signature")).distinct().withColumn("known", F.lit(True))
    rows = actual.join(possible, "signature", "left").groupBy("replicate").agg(F.count("*").alias("n_actual"), F.count("known").alias("n_confirmed"))
    total = possible.agg(F.count("*").alias("n_reachable"))
    rows = rows.join(total, how="cross")
    return rows.select("*", (F.col("n_actual") - F.col("n_confirmed")).alias("n_actual_only"), (F.col("n_reachable") - F.col("n_confirmed")).alias("n_aggregate_only"), F.when(F.col("n_reachable") > 0, F.col("n_confirmed") / F.col("n_reachable")).otherwise(0.0).alias("realised"))


def step_score(share: Column, direction: Column, events: Column, times: Column) -> Column:
    """Weights 0.40, 0.25, 0.20 and 0.15; the first two over 0.65 where there is no evidence."""
    network = (0.40 * share + 0.25 * direction) / 0.65
    return F.when(events.isNull(), network).otherwise(0.40 * share + 0.25 * direction + 0.20 * events + 0.15 * times)


def path_score(scores: Column) -> Column:
    """0.7 geometric mean + 0.3 minimum of an array of step scores."""
    product = F.aggregate(scores, F.lit(1.0), lambda a, x: a * x)
    return 0.70 * F.pow(product, 1.0 / F.size(scores)) + 0.30 * F.array_min(scores)


def candidate_steps(merged: DataFrame, direction: str = "downstream") -> DataFrame:
    """(focal_input, focal_output, n, reaction_key, forward_tp, reverse_tp, net_tp, net_share, directionality, score): all positive net steps.

    Shares are over all positive (reaction, output) pairs of an input, repeated outputs counted. merged may carry
    event_coverage and time_coverage.
    """
    rows = with_reverse(merged).where("net_tp > 0").withColumn("directionality", F.col("net_tp") / F.col("tp"))
    source, target = ("reactants", "products") if direction == "downstream" else ("products", "reactants")
    evidence = [F.col(c) if c in merged.columns else F.lit(None).cast("double").alias(c) for c in ("event_coverage", "time_coverage")]
    rows = rows.select("reaction_key", "tp", "reverse_tp", "net_tp", "directionality", *evidence, F.explode(F.array_distinct(source)).alias("focal_input"), F.array_sort(target).alias("outputs"))
    rows = rows.select("*", F.posexplode("outputs").alias("n", "focal_output")).drop("outputs")
    totals = rows.groupBy("focal_input").agg(F.sum("net_tp").alias("_total"))  # an aggregate, so that a hub is no task of its own
    rows = rows.join(totals, "focal_input").withColumn("net_share", F.col("net_tp") / F.col("_total")).drop("_total")
    return rows.withColumn("score", step_score(F.col("net_share"), F.col("directionality"), F.col("event_coverage"), F.col("time_coverage"))).withColumnRenamed("tp", "forward_tp")


def candidate_paths(steps: DataFrame, starts: DataFrame, max_depth: int = 3, max_branches: int = 5, max_paths: int = 20, min_net_tp: int = 1, min_directionality: float = 0.05, dim: DataFrame | None = None, target_max_carbon: int | None = None) -> DataFrame:
    """(start, rank, species, reaction_keys, scores, score): the best loop-free routes of every start (column start), by joins level by level.

    A state keeps its max_branches best children, so the frontier of a start has at most max_branches ^ depth rows. Without
    a target a route ends at the depth limit or where nothing follows. With target_max_carbon (which takes the species
    dimension) it ends at a species of 1 to that many carbon atoms, and states keep hits first, then children of few carbons.
    """
    if not (1 <= max_depth <= 12 and 1 <= max_branches <= 100 and 1 <= max_paths <= 500):
        raise ValueError("depth 1 to 12, branches 1 to 100, paths 1 to 500")
    usable = cut(steps.where((F.col("net_tp") >= min_net_tp) & (F.col("directionality") >= min_directionality)).select("focal_input", "focal_output", "n", "reaction_key", F.col("score").alias("step_score")))
    frontier = starts.select("start", F.array("start").alias("species"), F.array().cast("array<string>").alias("reaction_keys"), F.array().cast("array<double>").alias("scores"), F.array().cast("array<int>").alias("ns"))
    state, done = ["start", "species", "reaction_keys", "scores", "ns"], []
    carbon = None if target_max_carbon is None else dim.select(F.col("smiles").alias("focal_output"), F.coalesce(F.try_element_at("atom_counts", F.lit("C")), F.lit(0)).alias("carbon"))
    hit = None if carbon is None else carbon.where(F.col("carbon").between(1, target_max_carbon)).select(F.col("focal_output").alias("_end"))
    usable = usable.withColumn("carbon", F.lit(0)) if carbon is None else usable.join(carbon, "focal_output", "left").fillna(0, ["carbon"])
    goal = [] if carbon is None else [F.when(F.col("carbon").between(1, target_max_carbon), 0).otherwise(1), F.when(F.col("carbon") > 0, F.col("carbon")).otherwise(10**9)]
    for depth in range(max_depth + 1):
        if depth and hit is not None:
            last = frontier.withColumn("_end", F.element_at("species", -1))
            done.append(last.join(hit, "_end", "left_semi").select(*state))
            frontier = last.join(hit, "_end", "left_anti").select(*state)
        if depth == max_depth:
            if hit is None:
                done.append(frontier)
            break
        children = frontier.withColumn("focal_input", F.element_at("species", -1)).join(usable, "focal_input").where(~F.array_contains(F.col("species"), F.col("focal_output")))
        children = children.select("start", *[F.col(c).alias(f"p_{c}") for c in state[1:]], F.array_append("species", F.col("focal_output")).alias("species"), F.array_append("reaction_keys", F.col("reaction_key")).alias("reaction_keys"), F.array_append("scores", F.col("step_score")).alias("scores"), F.array_append("ns", F.col("n")).alias("ns"), "carbon")
        order = Window.partitionBy("start", "p_species", "p_reaction_keys", "p_ns").orderBy(*goal, F.desc(path_score(F.col("scores"))), "species", "reaction_keys", "ns")
        children = cut(children.withColumn("_b", F.row_number().over(order)).where(F.col("_b") <= max_branches))
        if depth and hit is None:
            parents = children.select("start", F.col("p_species").alias("species"), F.col("p_reaction_keys").alias("reaction_keys"), F.col("p_ns").alias("ns")).distinct()
            done.append(frontier.join(parents, ["start", "species", "reaction_keys", "ns"], "left_anti").select(*state))
        frontier = children.select(*state)
    every = done[0]
    for d in done[1:]:
        every = every.union(d)
    every = every.withColumn("score", path_score(F.col("scores")))
    rank = F.row_number().over(Window.partitionBy("start").orderBy(F.desc("score"), "species", "reaction_keys", "ns"))
    return every.withColumn("rank", rank).where(F.col("rank") <= max_paths).drop("ns")


def path_endings(paths: DataFrame, dim: DataFrame, small_carbon: int = 1) -> DataFrame:
    """paths with n_steps, end, end_carbon and whether the end is a small carbon fragment (0 < C <= small_carbon)."""
    carbon = dim.select(F.col("smiles").alias("end"), F.coalesce(F.try_element_at("atom_counts", F.lit("C")), F.lit(0)).alias("end_carbon"))
    rows = paths.withColumn("n_steps", F.size("reaction_keys")).withColumn("end", F.element_at("species", -1)).join(carbon, "end", "left")
    return rows.withColumn("small_end", (F.col("end_carbon") > 0) & (F.col("end_carbon") <= small_carbon))


def annotate_endings(paths: DataFrame, dim: DataFrame, max_depth: int, direction: str = "downstream", target_max_carbon: int | None = None, small_carbon: int = 4, truncated: bool = False) -> DataFrame:
    """paths (start, rank, species, reaction_keys, ...) with how they end and where they break.

    termination: small_molecule_goal (the end has 1 to target_max_carbon carbons), search_truncated (the search was cut off before
    max_depth), depth_limit, or no_positive_continuation. terminal_products are all species that the last reaction makes (upstream:
    takes); small_fragments those of all steps with 1 to small_carbon carbons, but fewer than what the step began with, each once in
    order; fragmentation_steps the steps (from 1) that make one, fragmentation_step the first of them.
    """
    side = 1 if direction == "downstream" else 0
    sides = lambda key: F.split(F.get(F.split(key, "->"), F.lit(side)), r"\+")
    carbon = dim.select(F.col("smiles").alias("s"), F.coalesce(F.try_element_at("atom_counts", F.lit("C")), F.lit(0)).alias("c"))
    steps = paths.select("start", "rank", "species", F.posexplode("reaction_keys").alias("i", "key"))
    steps = steps.select("start", "rank", "i", F.get("species", F.col("i")).alias("focal"), F.posexplode(sides(F.col("key"))).alias("j", "made"))
    steps = steps.join(carbon.withColumnsRenamed({"s": "focal", "c": "focal_c"}), "focal", "left").join(carbon.withColumnsRenamed({"s": "made", "c": "made_c"}), "made", "left")
    small = steps.where((F.col("made_c") > 0) & (F.col("made_c") <= small_carbon) & (F.coalesce("focal_c", F.lit(0)) > F.col("made_c")))
    first = small.groupBy("start", "rank", "made").agg(F.min(F.struct("i", "j")).alias("at")).groupBy("start", "rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "made"))), lambda x: x["made"]).alias("small_fragments"))
    broken = small.groupBy("start", "rank").agg(F.array_sort(F.collect_set(F.col("i") + 1)).alias("fragmentation_steps"))
    rows = paths.withColumn("end", F.element_at("species", -1)).join(carbon.withColumnsRenamed({"s": "end", "c": "end_carbon"}), "end", "left").join(first, ["start", "rank"], "left").join(broken, ["start", "rank"], "left")
    n = F.size("reaction_keys")
    goal = F.lit(False) if target_max_carbon is None else F.coalesce((F.col("end_carbon") > 0) & (F.col("end_carbon") <= target_max_carbon), F.lit(False))
    why = F.when(goal, "small_molecule_goal").when(F.lit(truncated) & (n < max_depth), "search_truncated").when(n >= max_depth, "depth_limit").otherwise("no_positive_continuation")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return rows.select(*paths.columns, "end", F.coalesce("end_carbon", F.lit(0)).alias("end_carbon"), why.alias("termination"), sides(F.element_at("reaction_keys", -1)).alias("terminal_products"), none("small_fragments", "string"), none("fragmentation_steps", "int"), F.get("fragmentation_steps", F.lit(0)).alias("fragmentation_step"))


def path_steps(paths: DataFrame) -> DataFrame:
    """One row per step, for export: start, rank, step, input, output, reaction_key, step_score, path_score."""
    return paths.select("start", "rank", "species", "scores", "score", F.posexplode("reaction_keys").alias("i", "reaction_key")).select(
        "start", "rank", (F.col("i") + 1).alias("step"), F.get("species", F.col("i")).alias("input"), F.get("species", F.col("i") + 1).alias("output"), "reaction_key", F.get("scores", F.col("i")).alias("step_score"), F.col("score").alias("path_score")
    )


def export_steps(paths: DataFrame, steps: DataFrame, direction: str = "downstream", score_version: str = "1", references: str = "") -> DataFrame:
    """One row per step with all columns of the export: the path, the step's fluxes and sides, its evidence, and the versions.

    steps: rows of candidate_steps, one for each (focal_input, focal_output, reaction_key), with the columns of with_evidence if
    there is evidence; without, counts and coverages are null and evidence_status is network_only.
    """
    rows = paths.select("start", F.col("rank").alias("path_rank"), F.array_join("species", " > ").alias("path_species"), "species", "scores", F.col("score").alias("path_score"), F.posexplode("reaction_keys").alias("i", "reaction_key"))
    rows = rows.withColumns({"focal_input": F.get("species", F.col("i")), "focal_output": F.get("species", F.col("i") + 1), "step_score": F.get("scores", F.col("i")), "step_index": F.col("i") + 1})
    kinds = {"event_coverage": "double", "time_coverage": "double", "total_events": "long", "matched_events": "long", "distinct_intervals": "long", "evidence_status": "string"}
    known = steps.dropDuplicates(["focal_input", "focal_output", "reaction_key"]).withColumns({c: F.lit("network_only" if k == "string" else None).cast(k) for c, k in kinds.items() if c not in steps.columns})
    known = known.select("focal_input", "focal_output", "reaction_key", "forward_tp", "reverse_tp", "net_tp", "net_share", "directionality", *kinds)
    rows = rows.join(known, ["focal_input", "focal_output", "reaction_key"], "left")
    return rows.select(
        "start", "path_rank", "step_index", "path_species", "reaction_key", F.lit(direction).alias("traversal_direction"), "focal_input", "focal_output",
        F.substring_index("reaction_key", "->", 1).alias("reactants"), F.substring_index("reaction_key", "->", -1).alias("products"),
        "forward_tp", "reverse_tp", "net_tp", "net_share", "directionality", "event_coverage", "time_coverage", F.col("total_events").alias("event_total"), F.col("matched_events").alias("matched_event_total"), "distinct_intervals",
        "path_score", "step_score", "evidence_status", F.lit(score_version).alias("score_version"), F.lit(references).alias("source_references"),
    )


def gap_statistics(paths: DataFrame) -> DataFrame:
    """(signature, edge, n, gap_min, gap_median, gap_mean, gap_max): the gaps between consecutive events, by place in the sequence."""
    rows = paths.select(F.array_join("reaction_keys", " => ").alias("signature"), F.posexplode("gaps").alias("edge", "gap"))
    return rows.groupBy("signature", "edge").agg(F.count("*").alias("n"), F.min("gap").alias("gap_min"), F.median("gap").alias("gap_median"), F.avg("gap").alias("gap_mean"), F.max("gap").alias("gap_max"))


def clock_statistics(paths: DataFrame) -> DataFrame:
    """(signature, edge, clock, n, gap_min, gap_median, gap_mean, gap_max): the gaps of all three clocks (interval, idle, anchor) in one pass."""
    clocks = F.explode(F.array(*[F.struct(F.lit(name).alias("clock"), F.col(c).alias("gaps")) for name, c in (("interval", "gaps"), ("idle", "idle_gaps"), ("anchor", "anchor_gaps"))]))
    rows = paths.select(F.array_join("reaction_keys", " => ").alias("signature"), clocks.alias("c")).select("signature", "c.clock", F.posexplode("c.gaps").alias("edge", "gap"))
    return rows.groupBy("signature", "edge", "clock").agg(F.count("*").alias("n"), F.min("gap").alias("gap_min"), F.median("gap").alias("gap_median"), F.avg("gap").alias("gap_mean"), F.max("gap").alias("gap_max"))


def example_paths(paths: DataFrame, n: int = 5) -> DataFrame:
    """(signature, n_example, replicate, event_ids): the first paths of every sequence, by replicate, time and events.

    The first of each of 64 parts of a sequence's paths, then the first of those, so a common sequence is no task of its own.
    """
    order = ["replicate", "t_first", "t_last", "event_ids"]
    rows = paths.select(F.array_join("reaction_keys", " => ").alias("signature"), *order).withColumn("salt", F.pmod(F.xxhash64("event_ids"), F.lit(64)))
    for keys in (["signature", "salt"], ["signature"]):
        rows = rows.withColumn("n_example", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("n_example") <= n)
    return rows.select("signature", "n_example", "replicate", "event_ids")


# The two events of a hydrogen molecule that falls apart and forms again.
PURE_H_KEYS = ("[H]+[H]->[H][H]", "[H][H]->[H]+[H]")


def filter_signatures(signatures: DataFrame, hide_pure_h: bool = False, hide_return_cycles: bool = False, min_support: float = 0.0, min_lineages: int = 0) -> DataFrame:
    """Signatures that pass, ranked: by support, lineages and occurrences, then by name."""
    keys = F.split("signature", " => ", -1)
    rows = signatures.withColumn("pure_h_cycle", F.forall(keys, lambda k: k.isin(*PURE_H_KEYS))).withColumn("return_cycle", (F.size(keys) >= 3) & (F.get(keys, F.lit(0)) == F.element_at(keys, -1)))
    rows = rows.where((F.col("support") >= min_support) & (F.col("n_atoms") >= min_lineages))
    rows = rows.where("not pure_h_cycle") if hide_pure_h else rows
    rows = rows.where("not return_cycle") if hide_return_cycles else rows
    return rows.orderBy(F.desc("n_replicates"), F.desc("n_atoms"), F.desc("n_occurrences"), "signature")


def cascade(merged: DataFrame, dim: DataFrame, starts: DataFrame, max_depth: int = 5, branches: int = 5, min_net: int = 1, min_fraction: float = 0.01, direction: str = "downstream") -> DataFrame:
    """(start, depth, parent, smiles, reaction_key, tp, fraction, net_tp, reversible): from each start (column start) the largest channels, each followed to its heaviest new species.

    A state looks at its 3 * branches largest channels, drops those below the limits, keeps one for each major species, and
    of these the first `branches`; so the frontier of a start is bounded, and its levels are joins.
    """
    source, target = ("reactants", "products") if direction == "downstream" else ("products", "reactants")
    flux = with_reverse(merged)
    terms = flux.select("reaction_key", "tp", "net_tp", "reversible", F.col(target).alias("outs"), F.explode(source).alias("here"))
    totals = terms.groupBy("here").agg(F.sum("tp").alias("_total"))
    channels = terms.dropDuplicates(["here", "reaction_key"]).withColumn("salt", F.pmod(F.xxhash64("reaction_key"), F.lit(64)))
    for keys in (["here", "salt"], ["here"]):  # the first of each of 64 parts, then the first of those
        channels = channels.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("tp"), "reaction_key"))).where(F.col("n") <= 3 * branches)
    channels = channels.drop("salt").join(totals, "here").withColumn("fraction", F.col("tp") / F.col("_total")).drop("_total")
    heavy = dim.select(F.col("smiles").alias("o"), F.col("n_heavy"))
    outs = channels.select("here", "reaction_key", F.explode(F.array_distinct("outs")).alias("o")).join(heavy, "o")
    ranked = outs.groupBy("here", "reaction_key").agg(F.array_sort(F.collect_list(F.struct((-F.col("n_heavy")).alias("w"), "o"))).alias("outs"))
    channels = cut(channels.drop("outs").where((F.col("net_tp") >= min_net) & (F.col("fraction") >= min_fraction)).join(ranked, ["here", "reaction_key"]))
    frontier = starts.select("start", F.col("start").alias("here"), F.array("start").alias("seen"))
    levels = []
    for depth in range(1, max_depth + 1):
        rows = frontier.join(channels, "here")
        fresh = F.filter("outs", lambda x: ~F.array_contains(F.col("seen"), x["o"]))
        rows = rows.withColumn("smiles", F.coalesce(F.get(fresh, F.lit(0))["o"], F.get("outs", F.lit(0))["o"])).withColumn("new", F.size(fresh) > 0)
        state = Window.partitionBy("start", "seen")
        rows = rows.withColumn("m", F.row_number().over(Window.partitionBy("start", "seen", "smiles").orderBy("n"))).where("m = 1").withColumn("m", F.row_number().over(state.orderBy("n"))).where(F.col("m") <= branches)
        rows = cut(rows)
        levels.append(rows.select("start", F.lit(depth).alias("depth"), F.col("here").alias("parent"), "smiles", "reaction_key", "tp", "fraction", "net_tp", "reversible"))
        frontier = rows.where("new").select("start", F.col("smiles").alias("here"), F.array_append("seen", F.col("smiles")).alias("seen"))
    every = levels[0]
    for level in levels[1:]:
        every = every.union(level)
    return every
