"""The given tables as reactions, abundances, occurrences, replicates and atoms. The SQL next to each says the same in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.network import merge_reactions


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _smiles(carbon: Column, oxygen: Column) -> Column:
    return F.concat(F.expr("repeat('[C]', c)"), F.expr("repeat('[O]', o)"))


def reactions(spark: SparkSession, d: str, by: tuple[str, ...] = ()) -> DataFrame:
    """A reaction for each order of four lines or more: the species of lines 1 and 2 react to those of 3 and 4."""
    species = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 3 + 1).cast("int").alias("c"), (F.col("p_partkey") % 2).cast("int").alias("o"))
    species = species.select("l_partkey", _smiles(F.col("c"), F.col("o")).alias("smi"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = lines.join(species, "l_partkey").withColumn("n", F.row_number().over(w)).where("n <= 4")
    side = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("smi"))))
    rows = lines.groupBy("l_orderkey").agg(side(F.col("n") <= 2).alias("reactants"), side(F.col("n") > 2).alias("products"), F.count("*").alias("n")).where("n = 4")
    return rows.select(F.col("l_orderkey").alias("line_no"), "reactants", "products", F.lit(1).cast("long").alias("tp"))


def network(spark: SparkSession, d: str) -> DataFrame:
    return merge_reactions(reactions(spark, d))


NETWORK_SQL = """
sp AS (SELECT p_partkey, repeat('[C]', (p_size % 3 + 1)::INT) || repeat('[O]', (p_partkey % 2)::INT) AS smi FROM part),
ln AS (SELECT l_orderkey, smi, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem JOIN sp ON l_partkey = p_partkey),
rx AS (SELECT l_orderkey, list_sort(list(smi) FILTER (n <= 2)) AS r, list_sort(list(smi) FILTER (n > 2)) AS p FROM ln WHERE n <= 4 GROUP BY 1 HAVING count(*) = 4),
m AS (SELECT array_to_string(r, '+') || '->' || array_to_string(p, '+') AS k, array_to_string(p, '+') || '->' || array_to_string(r, '+') AS rk, any_value(r) AS r, any_value(p) AS p, count(*) AS tp FROM rx GROUP BY 1, 2),
f AS (SELECT m.*, coalesce(b.tp, 0) AS rev, m.tp - coalesce(b.tp, 0) AS net, b.tp IS NOT NULL AS reversible FROM m LEFT JOIN m b ON m.rk = b.k),
sides AS (SELECT k, tp, 'consume' AS role, unnest(r) AS s FROM m UNION ALL SELECT k, tp, 'produce', unnest(p) FROM m),
dim AS (SELECT smi, c, o, 'C' || CASE WHEN c > 1 THEN c::VARCHAR ELSE '' END || CASE o WHEN 0 THEN '' WHEN 1 THEN 'O' ELSE 'O' || o END AS formula
        FROM (SELECT DISTINCT smi, (length(smi) - length(replace(smi, '[C]', ''))) // 3 AS c, (length(smi) - length(replace(smi, '[O]', ''))) // 3 AS o FROM sp)),
st AS (SELECT s, sum(tp) FILTER (role = 'consume') AS tc, sum(tp) FILTER (role = 'produce') AS tpr, count(*) FILTER (role = 'consume') AS nc, count(*) FILTER (role = 'produce') AS np FROM sides GROUP BY 1),
stats AS (SELECT s, coalesce(tc, 0)::BIGINT AS tc, coalesce(tpr, 0)::BIGINT AS tpr, nc, np, (coalesce(tc, 0) + coalesce(tpr, 0))::BIGINT AS thr FROM st)
"""


def abundance(spark: SparkSession, d: str) -> DataFrame:
    """Lines shipped per month and synthetic species of their part."""
    c, o = (F.col("p_size") % 7 + 1).cast("int").alias("c"), (F.col("p_partkey") % 4).cast("int").alias("o")
    species = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), c, o, F.when(F.col("p_partkey") % 5 == 0, "[Cl]").otherwise("").alias("cl"))
    species = species.select("l_partkey", F.concat(_smiles(F.col("c"), F.col("o")), "cl").alias("smiles"))
    lines = table(spark, d, "lineitem").select("l_partkey", ((F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate") - 1).cast("long").alias("timestep"))
    # Counted by part before the join, so that the join moves parts and months instead of lines.
    parts = lines.groupBy("l_partkey", "timestep").agg(F.count("*").alias("count"))
    return parts.join(species, "l_partkey").select("timestep", "smiles", "count")


ABUNDANCE_SQL = """
sp AS (SELECT p_partkey, repeat('[C]', (p_size % 7 + 1)::INT) || repeat('[O]', (p_partkey % 4)::INT) || CASE WHEN p_partkey % 5 = 0 THEN '[Cl]' ELSE '' END AS smi, (p_size % 7 + 1)::INT AS c, (p_partkey % 4)::INT AS o, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS cl FROM part),
a AS (SELECT ((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1)::BIGINT AS t, smi, count(*) AS n FROM lineitem JOIN sp ON l_partkey = p_partkey GROUP BY 1, 2),
dim AS (SELECT DISTINCT smi, c, o, cl, 'C' || CASE WHEN c > 1 THEN c::VARCHAR ELSE '' END || CASE cl WHEN 1 THEN 'Cl' ELSE '' END || CASE o WHEN 0 THEN '' WHEN 1 THEN 'O' ELSE 'O' || o END AS formula,
        12.0::DOUBLE * c + 34.968852682::DOUBLE * cl + 15.99491461957::DOUBLE * o AS mass, 12 * c + 35 * cl + 16 * o AS nominal FROM sp),
fr AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS frame FROM (SELECT DISTINCT t FROM a)),
s0 AS (SELECT smi, sum(n)::BIGINT AS total, max(n) AS peak, arg_min(t, (-n, t)) AS peak_t, coalesce(sum(n) FILTER (t = (SELECT min(t) FROM a)), 0)::BIGINT AS n0, coalesce(sum(n) FILTER (t = (SELECT max(t) FROM a)), 0)::BIGINT AS n1 FROM a GROUP BY 1),
hm AS (SELECT smi, max(k) AS fwhm FROM (SELECT smi, g, count(*) AS k FROM (SELECT a.smi, frame - row_number() OVER (PARTITION BY a.smi ORDER BY frame) AS g FROM a JOIN fr USING (t) JOIN s0 USING (smi) WHERE n * 2 >= peak) GROUP BY 1, 2) GROUP BY 1),
su AS (SELECT * FROM s0 JOIN hm USING (smi))
"""


def event_nodes(spark: SparkSession, d: str, with_barriers: bool = True) -> DataFrame:
    """Users change from the last event type of one active day to that of the next; the user is the atom, the day the transition."""
    days = table(spark, d, "events").groupBy("user_id", F.date_diff(F.col("ts").cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("t")).agg(F.max_by("event_type", "ts").alias("now"))
    rows = days.withColumn("was", F.lag("now").over(Window.partitionBy("user_id").orderBy("t"))).where("was <> now")
    unresolved = (F.col("was") == "error") | (F.col("now") == "error") if with_barriers else F.lit(False)
    instance = lambda c: F.array(F.struct(F.col(c).alias("species"), F.col("user_id").cast("string").alias("atoms")))
    return rows.select(
        F.concat(F.lit("rep"), F.col("user_id") % 3).alias("replicate"), F.concat_ws("-", "user_id", "t").alias("event_id"), "t", F.concat("was", F.lit("->"), "now").alias("reaction_key"),
        F.when(unresolved, "unresolved").otherwise("matched").alias("status"), F.array("was").alias("reactants"), F.array("now").alias("products"), instance("was").alias("consumed"), instance("now").alias("produced"),
    )


def occurrences(spark: SparkSession, d: str) -> DataFrame:
    nodes = event_nodes(spark, d)
    return nodes.select(F.col("replicate").alias("dataset"), "event_id", F.col("t").alias("transition"), F.col("t").alias("source_row"), "reactants", "products", "reaction_key", "status")


def event_network(spark: SparkSession, d: str) -> DataFrame:
    """The aggregated network of the same events."""
    return event_nodes(spark, d, False).groupBy("reaction_key", "reactants", "products").agg(F.count("*").alias("tp"))


EVENTS_SQL = """
dy AS (SELECT user_id, date_diff('day', DATE '1992-01-01', ts::DATE)::BIGINT AS t, arg_max(event_type, ts) AS now FROM events GROUP BY 1, 2),
ev AS (SELECT 'rep' || (user_id % 3) AS rep, user_id, user_id || '-' || t AS id, t, was, now, was || '->' || now AS k, was <> 'error' AND now <> 'error' AS ok
       FROM (SELECT *, lag(now) OVER (PARTITION BY user_id ORDER BY t) AS was FROM dy) WHERE was <> now),
nt AS (SELECT k, was, now, count(*) AS tp FROM ev GROUP BY ALL)
"""


def paired_molecules(spark: SparkSession, d: str) -> DataFrame:
    """Each user's last event type so far, on every day; the users 2k and 2k + 1 are one molecule of two atoms while theirs are the same."""
    days = table(spark, d, "events").groupBy("user_id", F.date_diff(F.col("ts").cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("t")).agg(F.max_by("event_type", "ts").alias("now"))
    ends = days.agg(F.min("t").alias("a"), F.max("t").alias("b"))
    grid = days.select("user_id").distinct().join(ends, how="cross").select("user_id", F.explode(F.sequence("a", "b")).alias("t"))
    w = Window.partitionBy("user_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    states = grid.join(days, ["user_id", "t"], "left").withColumn("s", F.coalesce(F.last("now", ignorenulls=True).over(w), F.lit("none")))
    pair = states.groupBy(F.floor(F.col("user_id") / 2).alias("p"), "t", "s").agg(F.array_sort(F.collect_list("user_id")).alias("atom_ids"))
    species = F.when(F.size("atom_ids") == 2, F.concat("s", F.lit("2"))).otherwise(F.col("s"))
    return pair.select(F.lit("d").alias("dataset"), F.col("t").alias("frame"), species.alias("species"), "atom_ids")


def replicate_counts(spark: SparkSession, d: str) -> DataFrame:
    """Changes of order priority from one order of a customer to the next, by region and nation."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("replicate"), F.col("r_name").alias("group_name"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(nations, "c_nationkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = orders.withColumn("was", F.lag("o_orderpriority").over(w)).where("was <> o_orderpriority").groupBy("o_custkey", "was", "o_orderpriority").agg(F.count("*").alias("n"))
    rows = rows.join(customers, "o_custkey")
    return rows.groupBy("group_name", "replicate", F.concat("was", F.lit("->"), "o_orderpriority").alias("reaction_key"), F.concat("o_orderpriority", F.lit("->"), "was").alias("reverse_key")).agg(F.sum("n").alias("tp"))


REPLICATES_SQL = """
ch AS (SELECT o_custkey, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS was, o_orderpriority AS now FROM orders),
rc AS (SELECT r_name AS g, n_name AS rep, was || '->' || now AS k, now || '->' || was AS rk, count(*) AS tp FROM ch JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE was <> now GROUP BY ALL),
cond AS (SELECT DISTINCT g, rep FROM rc),
keys AS (SELECT DISTINCT k, rk FROM rc),
tab AS (SELECT cond.g, cond.rep, keys.k, coalesce(a.tp, 0) AS fwd, coalesce(b.tp, 0) AS rev, coalesce(a.tp, 0) - coalesce(b.tp, 0) AS net FROM cond CROSS JOIN keys
        LEFT JOIN rc a ON a.g = cond.g AND a.rep = cond.rep AND a.k = keys.k LEFT JOIN rc b ON b.g = cond.g AND b.rep = cond.rep AND b.k = keys.rk)
"""


def atoms(spark: SparkSession, d: str, edge: float = 20.0) -> DataFrame:
    """A frame for each label, with the first three coordinates of its vectors scaled into a periodic box."""
    place = lambda i: F.pmod(F.get("embedding", F.lit(i)).cast("double") * 40, F.lit(edge)).alias("xyz"[i])
    return table(spark, d, "embeddings").select(F.col("label").cast("long").alias("timestep"), F.col("vec_id").alias("id"), *map(place, range(3)))


ATOMS_SQL = """
xyz AS (SELECT label::BIGINT AS t, vec_id AS id, e[1] - 20 * floor(e[1] / 20) AS x, e[2] - 20 * floor(e[2] / 20) AS y, e[3] - 20 * floor(e[3] / 20) AS z FROM (SELECT label, vec_id, [embedding[1]::DOUBLE * 40, embedding[2]::DOUBLE * 40, embedding[3]::DOUBLE * 40] AS e FROM embeddings))
"""


def moving_atoms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Fifty vectors are a frame, the places of fifty atoms, in a lattice of its own: (atoms, boxes)."""
    place = [F.pmod(F.get("embedding", F.lit(i)).cast("double") * 40, F.lit(20.0)).alias(c) for i, c in enumerate("xyz")]
    atoms = table(spark, d, "embeddings").select(F.expr("vec_id div 50").alias("timestep"), (F.col("vec_id") % 50).alias("id"), *place)
    t = F.col("timestep")
    row = lambda *x: F.array(*[(F.lit(v) if isinstance(v, float) else v).cast("double") for v in x])
    boxes = atoms.select("timestep").distinct().select("timestep", row(t % 3 + 20, 0.0, 0.0).alias("a"), row(t % 7 - 3, 19.0, 0.0).alias("b"), row(2.5, -(t % 4) * 4, 21.0).alias("c"), row(-1.0, 0.5, 0.0).alias("origin"), F.array(F.lit(True), F.lit(True), t % 5 != 4).alias("pbc"))
    return atoms, boxes


MOVING_SQL = """
mv AS (SELECT vec_id // 50 AS t, vec_id % 50 AS id, e1 - 20 * floor(e1 / 20) AS x, e2 - 20 * floor(e2 / 20) AS y, e3 - 20 * floor(e3 / 20) AS z FROM (SELECT vec_id, embedding[1]::DOUBLE * 40 AS e1, embedding[2]::DOUBLE * 40 AS e2, embedding[3]::DOUBLE * 40 AS e3 FROM embeddings)),
im AS (SELECT t, i * (t % 3 + 20) + j * (t % 7 - 3) + k * 2.5::DOUBLE AS sx, j * 19 - k * (t % 4) * 4 AS sy, k * 21 AS sz
       FROM (SELECT DISTINCT t FROM mv), range(-3, 4) x(i), range(-3, 4) y(j), range(-3, 4) z(k) WHERE t % 5 <> 4 OR k = 0)
"""
