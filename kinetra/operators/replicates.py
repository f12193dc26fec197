"""Statistics over replicates. counts: group_name, replicate, reaction_key, tp; conditions: group_name, replicate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Two-sided 95 % quantiles of Student's t for 1 to 30 degrees of freedom, and of the normal distribution.
T_95 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042)
Z_95 = 1.959963984540054


def t_quantile(df: Column) -> Column:
    """From the table up to 30 degrees of freedom, by the Cornish-Fisher expansion above."""
    z, d = Z_95, df.cast("double")
    above = F.lit(z) + (z**3 + z) / (4 * d) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * d * d) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * d * d * d)
    return F.when(df <= len(T_95), F.get(F.array(*map(F.lit, T_95)), (df - 1).cast("int"))).otherwise(above)


def require_unique(conditions: DataFrame) -> DataFrame:
    """The conditions, or an error if a replicate is there twice or there is none."""
    bad = conditions.groupBy("group_name", "replicate").count().where("count > 1").limit(5).collect()
    if bad:
        raise ValueError(f"replicates given twice: {[tuple(r)[:2] for r in bad]}")
    if not conditions.take(1):
        raise ValueError("no replicates given")
    return conditions


def common_reactions(counts: DataFrame, top: int = 500) -> DataFrame:
    """(reaction_key, reverse_key): the reactions of the most replicates, then of the largest sum of tp, then first by key; a bounded list."""
    rows = counts.where("tp > 0").groupBy("reaction_key", "reverse_key").agg(F.countDistinct("group_name", "replicate").alias("n"), F.sum("tp").alias("tp"))
    return rows.orderBy(F.desc("n"), F.desc("tp"), "reaction_key").limit(top).select("reaction_key", "reverse_key")


def replicate_table(counts: DataFrame, conditions: DataFrame, reactions: DataFrame) -> DataFrame:
    """Forward, reverse and net counts of the given reactions (reaction_key, reverse_key; a ranked top) in every replicate, absent ones 0."""
    grid = conditions.join(reactions, how="cross")
    one = lambda key, name: counts.select("group_name", "replicate", F.col("reaction_key").alias(key), F.col("tp").alias(name))
    rows = grid.join(one("reaction_key", "forward"), ["group_name", "replicate", "reaction_key"], "left").join(one("reverse_key", "reverse"), ["group_name", "replicate", "reverse_key"], "left")
    f, r = F.coalesce("forward", F.lit(0)), F.coalesce("reverse", F.lit(0))
    return rows.select("group_name", "replicate", "reaction_key", f.alias("forward"), r.alias("reverse"), (f - r).alias("net"))


def detection_rates(table: DataFrame) -> DataFrame:
    """(reaction_key, n_replicates, n_detected, detection_rate, total)."""
    rows = table.groupBy("reaction_key").agg(F.count("*").alias("n_replicates"), F.count_if(F.col("forward") > 0).alias("n_detected"), F.sum("forward").alias("total"))
    return rows.withColumn("detection_rate", F.col("n_detected") / F.col("n_replicates"))


def statistics(table: DataFrame, value: str, by: tuple[str, ...] = ("group_name", "reaction_key")) -> DataFrame:
    """n, mean, sample sd (0 for one replicate), min, max and the 95 % interval of the mean."""
    rows = table.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"))
    margin = F.when(F.col("n") > 1, t_quantile(F.col("n") - 1) * F.col("sd") / F.sqrt("n")).otherwise(0.0)
    return rows.withColumn("ci_low", F.col("mean") - margin).withColumn("ci_high", F.col("mean") + margin)


def matrix(table: DataFrame, value: str, columns: list[str]) -> DataFrame:
    """reaction_key by group, the mean of a value; columns: the groups, named beforehand so that no extra job lists them."""
    return table.groupBy("reaction_key").pivot("group_name", columns).agg(F.avg(value))


# The words by which a directory name introduces a temperature, an oxygen ratio, a pressure and a replicate, and their units.
WORDS = {"temperature": (("temp", "t"), "k"), "o2_ratio": (("o2",), ""), "pressure": (("pressure", "p"), "atm"), "replicate": (("replicate", "rep", "run", "seed"), "")}


def _leaf(name: Column) -> Column:
    return F.element_at(F.filter(F.concat(F.array(F.lit("")), F.split(name, "/")), lambda x, i: (x != "") | (i == 0)), -1)


def _tokens(leaf: Column) -> Column:
    return F.split(leaf, "[_-]")


def _number(text: Column, unit: str) -> Column:
    """The number of a text such as 2500K or 0.5, null if it is none."""
    bare = F.when(F.lower(text).endswith(unit), F.substring(text, F.lit(1), F.length(text) - len(unit))).otherwise(text) if unit else text
    digits = F.translate(bare, "0123456789", "")
    return F.when((digits == "") & (bare != "") | ((digits == ".") & ~bare.startswith(".") & ~bare.endswith(".")), bare)


def _named(leaf: Column, what: str) -> Column:
    """The first number that one of the words introduces: in its own token, with or without =, or in the next token."""
    words, unit = WORDS[what]
    tokens = _tokens(leaf)

    def value(token: Column, i: Column) -> Column:
        found = []
        for w in words:
            rest = F.when(F.lower(token).startswith(w), F.substring(token, F.lit(len(w) + 1), F.length(token)))
            rest = F.when(rest.startswith("="), F.substring(rest, F.lit(2), F.length(rest))).otherwise(rest)
            found.append(_number(F.when(F.lower(token) == w, F.get(tokens, i + 1)).otherwise(rest), unit))
        return F.coalesce(*found)

    return F.get(F.filter(F.transform(tokens, value), lambda x: x.isNotNull()), F.lit(0))


def parse_condition(name: Column) -> Column:
    """struct(temperature, o2_ratio, pressure, replicate) out of the last part of a path, such as T2500K_O2-0.5_P1.0_rep2; null where absent.

    The part is cut at _ and - into tokens. A temperature may also stand alone, as in 2500K.
    """
    leaf = _leaf(name)
    alone = F.get(F.filter(F.transform(_tokens(leaf), lambda x: F.when(F.lower(x).endswith("k"), _number(x, "k"))), lambda x: x.isNotNull()), F.lit(0))
    return F.struct(
        F.coalesce(_named(leaf, "temperature"), alone).cast("double").alias("temperature"), _named(leaf, "o2_ratio").cast("double").alias("o2_ratio"),
        _named(leaf, "pressure").cast("double").alias("pressure"), _named(leaf, "replicate").try_cast("int").alias("replicate"),
    )


def _without_replicate(leaf: Column) -> Column:
    """A name less the token or two that give its replicate, if something stands before them, and less the separators at its end."""
    tokens = _tokens(leaf)
    words, _ = WORDS["replicate"]
    last, before, n = F.lower(F.element_at(tokens, -1)), F.lower(F.get(tokens, F.size(tokens) - 2)), F.size(tokens)
    digits = lambda x: (x != "") & (F.translate(x, "0123456789", "") == "")
    own = F.lit(False)
    for w in words:
        rest = F.when(last.startswith(w), F.substring(last, F.lit(len(w) + 1), F.length(last)))
        own |= F.coalesce(digits(F.when(rest.startswith("="), F.substring(rest, F.lit(2), F.length(rest))).otherwise(rest)), F.lit(False))
    two = digits(last) & F.coalesce(before.isin(*words), F.lit(False))
    cut = F.when(own & (n > 1), F.length(last) + 1).when(two & (n > 2), F.length(last) + F.length(before) + 2).otherwise(0)
    return F.rtrim(F.substring(leaf, F.lit(1), F.length(leaf) - cut), F.lit("_-"))


def group_key(name: Column) -> Column:
    """The group of a condition: its temperature, ratio and pressure; a path without any goes by its own name less the replicate suffix."""
    c = parse_condition(name)
    plain = lambda x: F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
    fields = F.concat_ws("_", F.concat(F.lit("T"), F.bround(c["temperature"]).cast("long").cast("string"), F.lit("K")), F.concat(F.lit("O2="), plain(c["o2_ratio"])), F.concat(F.lit("P="), plain(c["pressure"])))
    path, leaf = F.rtrim(name, F.lit("/")), _leaf(name)
    short = F.coalesce(F.nullif(_without_replicate(leaf), F.lit("")), leaf)
    return F.coalesce(F.nullif(fields, F.lit("")), F.concat(F.substring(path, F.lit(1), F.length(path) - F.length(leaf)), short))


def audit_groups(conditions: DataFrame, counts: DataFrame) -> DataFrame:
    """(group_name, replicate, rule): everything that keeps a grouped comparison from being made, of all groups at once.

    conditions: group_name, replicate, source (what its reactions were read from); counts: group_name, replicate, reaction_key, tp.
    A group needs a name and a replicate (a group without any is one whose replicate is null), a replicate a number from 1 on that is
    there once in its group, a source that no other replicate uses, and reactions.
    """
    c = conditions.select("group_name", F.col("replicate").cast("string").alias("replicate"), F.col("replicate").try_cast("long").alias("n"), "source")
    rule = lambda rows, name: rows.select("group_name", "replicate", F.lit(name).alias("rule"))
    given = c.where("replicate is not null")
    again = lambda rows, *by: rows.groupBy(*by).agg(F.count("*").alias("times")).where("times > 1").drop("times")
    shared = given.join(again(given.where("source is not null"), "source"), "source")
    bare = given.join(counts.where("tp > 0").select("group_name", F.col("replicate").cast("string").alias("replicate")).distinct(), ["group_name", "replicate"], "left_anti")
    found = [
        rule(c.where("group_name is null or trim(group_name) = ''"), "group without a name"), rule(c.where("replicate is null"), "group without replicates"), rule(given.where("n is null or n < 1"), "bad replicate number"),
        rule(again(given, "group_name", "replicate"), "replicate given twice"), rule(given.where("source is null"), "replicate without a source"), rule(shared, "source used twice"), rule(bare.where("source is not null"), "no reactions"),
    ]
    return reduce(DataFrame.union, found).distinct()


def grouped_report(counts: DataFrame, conditions: DataFrame, min_detection_rate: float = 0.0, top: int = 50) -> DataFrame:
    """The first `top` reactions over all replicates, with what each group has of them; nothing at all if audit_groups finds a fault.

    (reaction_key, rank, detection_rate, total_tp, total_net_tp, groups: array of structs group_name, n_replicates, detection_rate,
    mean_tp, std_tp, mean_net_tp, in order of group_name). counts: group_name, replicate, reaction_key, reverse_key, tp. Replicates
    without a reaction count as 0 by arithmetic: sums over those that have it, divided by all; no grid of replicates and reactions
    is made. Ranked by detection rate, then total_tp, then key.
    """
    if not 0 <= min_detection_rate <= 1 or not 1 <= top <= 500:
        raise ValueError("min_detection_rate must be 0 to 1 and top 1 to 500")
    if bad := audit_groups(conditions, counts).limit(200).collect():
        raise ValueError(f"comparison not made, {len(bad)} faults: " + "; ".join(sorted(f"{r['group_name']} / {r['replicate']}: {r['rule']}" for r in bad)))
    own = counts.join(conditions.select("group_name", "replicate"), ["group_name", "replicate"], "left_semi")
    # A reaction's net count is its own less that of its reverse, which may be there alone.
    both = own.select("group_name", "replicate", "reaction_key", "tp", F.col("tp").alias("net")).union(own.select("group_name", "replicate", "reverse_key", F.lit(0).cast("long"), -F.col("tp")))
    one = both.groupBy("group_name", "replicate", "reaction_key").agg(F.sum("tp").alias("tp"), F.sum("net").alias("net"))
    sums = one.groupBy("group_name", "reaction_key").agg(F.sum("tp").alias("s"), F.sum(F.col("tp") * F.col("tp")).alias("ss"), F.sum("net").alias("net"), F.count_if(F.col("tp") > 0).alias("seen"))
    sizes = conditions.groupBy("group_name").agg(F.count("*").alias("n"))
    n_all = conditions.agg(F.count("*").alias("all"))
    total = sums.groupBy("reaction_key").agg(F.sum("seen").alias("seen"), F.sum("s").alias("total_tp"), F.sum("net").alias("total_net_tp")).where("seen > 0").join(n_all, how="cross")  # one row
    total = total.withColumn("detection_rate", F.col("seen") / F.col("all")).where(F.col("detection_rate") >= min_detection_rate)
    first = total.orderBy(F.desc("detection_rate"), F.desc("total_tp"), "reaction_key").limit(top)
    first = first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("detection_rate"), F.desc("total_tp"), "reaction_key")))  # top rows
    grid = first.select("reaction_key").join(sizes, how="cross")  # at most 500 reactions by the groups
    v = lambda c: F.coalesce(c, F.lit(0))
    rows = grid.join(sums, ["group_name", "reaction_key"], "left").select("reaction_key", "group_name", "n", v("s").alias("s"), v("ss").alias("ss"), v("net").alias("net"), v("seen").alias("seen"))
    spread = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)))).otherwise(0.0)
    group = F.struct("group_name", F.col("n").alias("n_replicates"), (F.col("seen") / F.col("n")).alias("detection_rate"), (F.col("s") / F.col("n")).alias("mean_tp"), spread.alias("std_tp"), (F.col("net") / F.col("n")).alias("mean_net_tp"))
    groups = rows.groupBy("reaction_key").agg(F.array_sort(F.collect_list(group)).alias("groups"))
    return first.join(groups, "reaction_key").select("reaction_key", "rank", "detection_rate", "total_tp", "total_net_tp", "groups")
