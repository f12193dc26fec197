"""Readers. Explicit schemas everywhere; order in a file is kept as an increasing line_no."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.reactions import reaction_key, split_terms
from ..operators.abundance import frames
from .audits import audit_timeline, require_clean

TIDY = "time double, species string, count bigint, dataset string, system string"
EVENTS = "Timestep_Index bigint, Reactant string, Product string"
MOLECULES = "Timestep bigint, Species string, AtomIDs string, BondIDs string"
#: Native timed evidence: table -> columns, one Parquet table each.
TIMELINE = {
    "frames": "source_id int, source_frame bigint, timestep bigint",
    "reaction_types": "reaction_id int, reactant string, product string, total_count bigint",
    "reaction_events": "transition_index bigint, reaction_id int, count bigint",
    "species": "species_id int, name string",
    "molecules": "molecule_id bigint, species_id int, atom_ids array<bigint>, bonds array<struct<a:bigint,b:bigint,order:int>>",
    "molecule_ranges": "molecule_id bigint, start_frame bigint, end_frame bigint",
}


def _lines(spark: SparkSession, paths: str | list[str], sep: str | None = None) -> DataFrame:
    reader = spark.read if sep is None else spark.read.option("lineSep", sep)
    return reader.text(paths).select("value", F.monotonically_increasing_id().alias("line_no"), F.col("_metadata.file_path").alias("file"))


def read_reactions(spark: SparkSession, paths: str | list[str], min_tp: int = 1) -> DataFrame:
    """Lines '<tp> A+B->C+D'; those without exactly one arrow, or with a count that is no integer or below min_tp, are left out."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    rows = _lines(spark, paths).withColumn("tp", F.expr("try_cast(split(trim(value), '\\\\s+', 2)[0] as bigint)")).withColumn("sides", F.split(F.get(parts, F.lit(1)), "->"))
    rows = rows.where((F.col("tp") >= min_tp) & (F.size("sides") == 2))
    return rows.select("file", "line_no", split_terms(F.get("sides", F.lit(0))).alias("reactants"), split_terms(F.get("sides", F.lit(1))).alias("products"), "tp")


def read_abundance(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines 'Timestep N: SMILES count SMILES count ...'; where a count is no integer the reader goes on one token later."""
    rows = _lines(spark, paths).select("file", "line_no", F.expr(r"try_cast(regexp_extract(value, '^\\s*Timestep\\s+(-?[0-9]+)\\s*:', 1) as bigint)").alias("timestep"), F.regexp_replace("value", r"^\s*Timestep\s+-?[0-9]+\s*:", "").alias("rest"))
    pair = F.lit(r"(?<!\S)(\S+)\s+([+-]?[0-9]+)(?!\S)")
    pairs = F.explode(F.arrays_zip(F.regexp_extract_all("rest", pair, 1).alias("s"), F.regexp_extract_all("rest", pair, 2).alias("n"))).alias("p")
    return rows.where("timestep is not null").select("file", "timestep", pairs).select("file", "timestep", F.col("p.s").alias("smiles"), F.col("p.n").cast("bigint").alias("count"))


def time_of(timestep: Column, axis: str, timestep_ps: float | None) -> Column:
    """step, ps or ns; the last two need a positive factor."""
    if axis == "step":
        return timestep.cast("double")
    if not timestep_ps or timestep_ps <= 0:
        raise ValueError("a time axis in ps or ns needs a positive timestep_ps")
    return timestep * timestep_ps / (1000 if axis == "ns" else 1)


def tidy_abundance(abundance: DataFrame, system: str = "", replicate: str = "", axis: str = "step", timestep_ps: float | None = None, names: DataFrame | None = None) -> DataFrame:
    """(system, replicate, time, species, count); names (smiles, name) maps species, and those of one name add up."""
    rows = abundance.withColumn("species", F.col("smiles"))
    if names is not None:
        rows = rows.join(names, "smiles", "left").withColumn("species", F.coalesce("name", "smiles"))
    rows = rows.groupBy(time_of(F.col("timestep"), axis, timestep_ps).alias("time"), "species").agg(F.sum("count").alias("count"))
    return rows.select(F.lit(system).alias("system"), F.lit(replicate).alias("replicate"), "time", "species", "count")


def read_tidy(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """CSV with time, species and count, and dataset or system."""
    head = spark.read.option("header", True).csv(paths)
    if missing := {"time", "species", "count"} - set(head.columns):
        raise ValueError(f"columns are missing: {sorted(missing)}")
    label = [F.col(c) for c in ("dataset", "system") if c in head.columns]
    return head.select(F.coalesce(*label, F.lit("tidy")).alias("dataset"), F.col("time").cast("double").alias("time"), "species", F.expr("try_cast(`count` as bigint)").alias("count"))


def read_events(spark: SparkSession, paths: str | list[str], dataset: str = "") -> DataFrame:
    """Event CSV: transition, source_row, both sides and the key."""
    raw = spark.read.option("header", True).schema(EVENTS).csv(paths)
    rows = raw.select(F.lit(dataset).alias("dataset"), F.col("Timestep_Index").alias("transition"), F.monotonically_increasing_id().alias("source_row"), split_terms(F.col("Reactant")).alias("reactants"), split_terms(F.col("Product")).alias("products"))
    return rows.withColumn("reaction_key", reaction_key(F.col("reactants"), F.col("products")))


def read_molecules(spark: SparkSession, paths: str | list[str], dataset: str = "") -> DataFrame:
    """Molecule CSV: frame is the ordinal of the timestep; atoms count from 1, bonds 'a-b-order' too."""
    raw = spark.read.option("header", True).schema(MOLECULES).csv(paths)
    parts = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x) != "")
    steps = frames(raw.select(F.col("Timestep").alias("timestep"))).select(F.col("timestep").alias("Timestep"), "frame")
    number = lambda x, i: F.get(F.split(x, "-"), F.lit(i)).cast("bigint")
    bonds = F.transform(parts(F.col("BondIDs")), lambda x: F.struct((number(x, 0) + 1).alias("a"), (number(x, 1) + 1).alias("b"), number(x, 2).cast("int").alias("order")))
    return raw.join(steps, "Timestep").select(F.lit(dataset).alias("dataset"), "frame", F.col("Timestep").alias("timestep"), F.col("Species").alias("species"), F.transform(parts(F.col("AtomIDs")), lambda x: F.trim(x).cast("bigint") + 1).alias("atom_ids"), bonds.alias("bonds"))


def read_timeline(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The six tables of native timed evidence below path; a missing column is an error, not a column of nulls."""
    for name, schema in TIMELINE.items():
        want = {c.split()[0] for c in re.split(r",(?![^<]*>)\s*", schema)}
        if missing := want - set(spark.read.parquet(f"{path}/{name}.parquet").columns):
            raise ValueError(f"{name} has no column {sorted(missing)}")
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}.parquet") for name, schema in TIMELINE.items()}


def timeline_events(tables: dict[str, DataFrame], dataset: str = "") -> DataFrame:
    """Events of native evidence, a row for each of a record's occurrences."""
    from ..operators.occurrences import expand_counts

    rows = expand_counts(tables["reaction_events"]).join(tables["reaction_types"], "reaction_id")
    row = F.struct("transition_index", "reaction_id", "ordinal")
    rows = rows.select(F.lit(dataset).alias("dataset"), F.col("transition_index").alias("transition"), F.row_number().over(Window.partitionBy("transition_index").orderBy(row)).cast("bigint").alias("source_row"), split_terms(F.col("reactant")).alias("reactants"), split_terms(F.col("product")).alias("products"))
    return rows.withColumn("reaction_key", reaction_key(F.col("reactants"), F.col("products")))


def timed_events(spark: SparkSession, dataset: str, timeline: str | None = None, events: str | None = None) -> DataFrame:
    """Events of the native source if one is given, else of the CSV; a bad native source is an error, not a reason to fall back."""
    if timeline:
        tables = read_timeline(spark, timeline)
        require_clean(audit_timeline(tables))
        return timeline_events(tables, dataset).withColumn("source_kind", F.lit("timeline"))
    if events:
        return read_events(spark, events, dataset).withColumn("source_kind", F.lit("csv"))
    raise ValueError("no event source is given")


def read_trajectory(spark: SparkSession, paths: str | list[str], elements: dict[int, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(frames, atoms) of LAMMPS text dumps; a record of the text source is a frame, its sections may stand in any order.

    frames: file, timestep, n_atoms, box (lo and hi of the three axes), the lattice (a, b, c, origin, pbc; tilted if the header says
    so), and error, which names what is wrong with a frame (see audit_trajectory) or is null. atoms: file, timestep, id, type,
    element (as written, or by `elements` from the type), label, x, y, z; scaled coordinates are taken through the frame's lattice.
    """
    raw = _lines(spark, paths, "ITEM: TIMESTEP\n").withColumn("parts", F.split("value", r"(?:^|\n)ITEM: "))
    raw = raw.withColumn("step", F.expr("try_cast(split(trim(parts[0]), '\\\\s+')[0] as bigint)")).where(F.col("step").isNotNull() | F.exists("parts", lambda x: x.rlike("^(NUMBER OF )?ATOMS")))  # what stands before the first frame is none
    section = lambda name: F.split(F.get(F.filter("parts", lambda x: x.startswith(name)), F.lit(0)), "\n")
    rows = raw.select("file", F.col("step").alias("timestep"), section("NUMBER OF ATOMS").alias("n"), section("BOX BOUNDS").alias("box"), section("ATOMS").alias("atoms"))
    tokens = lambda x: F.split(F.trim(x), r"\s+")
    number = lambda line, i: F.get(tokens(F.get("box", F.lit(line))), F.lit(i)).try_cast("double")
    filled = lambda x: F.trim(x) != ""
    rows = rows.select(
        "file", "timestep", F.expr("try_cast(split(trim(n[1]), '\\\\s+')[0] as bigint)").alias("n_atoms"), F.filter("box", filled).alias("box"),
        F.slice(tokens(F.get("atoms", F.lit(0))), 2, 1000).alias("names"), F.filter(F.slice("atoms", 2, 1 << 30), filled).alias("body"),
    )
    # The header's words are the tilts, if any, and a kind for each axis; with tilts the bounds are those of the whole box.
    head = tokens(F.get("box", F.lit(0)))
    rows = rows.withColumn("kinds", F.slice(F.reverse(head), 1, 3)).withColumn("tilted", F.array_contains(head, "xy"))
    for i, axis in enumerate("xyz"):
        tilt = F.when(F.col("tilted"), number(i + 1, 2)).otherwise(F.lit(0.0))
        rows = rows.withColumn(("xy", "xz", "yz")[i], tilt).withColumn(f"{axis}lo", number(i + 1, 0)).withColumn(f"{axis}hi", number(i + 1, 1))
    least, most = lambda *c: F.least(F.lit(0.0), *c), lambda *c: F.greatest(F.lit(0.0), *c)
    xy, xz, yz = F.col("xy"), F.col("xz"), F.col("yz")
    rows = rows.withColumn("xlo", F.col("xlo") - least(xy, xz, xy + xz)).withColumn("xhi", F.col("xhi") - most(xy, xz, xy + xz)).withColumn("ylo", F.col("ylo") - least(yz)).withColumn("yhi", F.col("yhi") - most(yz))
    zero, edge = F.lit(0.0), lambda c: F.col(f"{c}hi") - F.col(f"{c}lo")
    body = F.slice("body", 1, F.greatest(F.coalesce("n_atoms", F.lit(0)), F.lit(0)).cast("int"))
    cells = F.transform(body, tokens)
    id_at = F.array_position("names", "id").cast("int")
    ids = F.transform(F.col("cells"), lambda x: F.get(x, id_at - 1))
    rows = rows.select(
        "file", "timestep", "n_atoms", F.array(*[F.struct(F.col(f"{c}lo").alias("lo"), F.col(f"{c}hi").alias("hi")) for c in "xyz"]).alias("box"), F.array(edge("x"), zero, zero).alias("a"), F.array(xy, edge("y"), zero).alias("b"), F.array(xz, yz, edge("z")).alias("c"),
        F.array("xlo", "ylo", "zlo").alias("origin"), F.reverse(F.transform("kinds", lambda x: x.startswith("p"))).alias("pbc"), "names", cells.alias("cells"),
    )
    faults = [
        (F.col("timestep").isNull(), "no timestep"), (F.col("n_atoms").isNull() | (F.col("n_atoms") < 0), "no atom count"), (F.exists("box", lambda x: x["lo"].isNull() | x["hi"].isNull()) | (F.size("pbc") < 3) | F.get("c", F.lit(1)).isNull(), "incomplete box"),
        (id_at == 0, "no column id"), (F.size("cells") < F.col("n_atoms"), "too few atoms"), (F.exists("cells", lambda x: F.size(x) < F.size("names")), "too few columns"), (F.size(F.array_distinct(ids)) < F.size("cells"), "repeated id"),
    ]
    frames = rows.select("file", "timestep", "n_atoms", "box", "a", "b", "c", "origin", "pbc", F.coalesce(*[F.when(test, what) for test, what in faults]).alias("error"))
    atoms = rows.select("file", "timestep", "names", "a", "b", "c", "origin", F.explode("cells").alias("cell"))
    atoms = atoms.select("file", "timestep", "a", "b", "c", "origin", F.map_from_arrays("names", F.slice("cell", 1, F.size("names"))).alias("m"))
    value = lambda c, kind: F.try_element_at("m", F.lit(c)).try_cast(kind)
    named = F.create_map(*[F.lit(x) for kv in (elements or {-1: None}).items() for x in kv])
    # No element: a number, or X, which stands for an unknown one.
    written = F.when(F.initcap(value("element", "string")).rlike("^[A-Z][a-z]?$") & (value("element", "string") != "X"), F.initcap(value("element", "string")))
    place = [
        F.coalesce(value(c, "double"), value(f"{c}u", "double"), F.get("origin", F.lit(i)) + sum((F.coalesce(value(f"{s}s", "double"), value(f"{s}su", "double")) * F.get(v, F.lit(i)) for s, v in zip("xyz", "abc", strict=True)), F.lit(0.0))).alias(c)
        for i, c in enumerate("xyz")
    ]
    atoms = atoms.select("file", "timestep", value("id", "bigint").alias("id"), value("type", "int").alias("type"), F.coalesce(written, F.try_element_at(named, value("type", "int"))).alias("element"), *place)
    label = F.coalesce("element", F.concat(F.lit("T"), "type"), F.concat(F.lit("A"), "id"))
    return frames, atoms.select("file", "timestep", "id", "type", "element", label.alias("label"), *"xyz")


def labelled_abundance(spark: SparkSession, sources: list[tuple[str, str, str]]) -> DataFrame:
    """Abundance of several sources (system, replicate, path of a file or of a folder of files) with their labels.

    One scan reads all files; each line finds its label by its file's path or its folder. A source given with two labels has its
    rows once for each.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def whole(path: str) -> str:
        p = hadoop(path)
        return p.getFileSystem(conf).makeQualified(p).toString()

    labels = spark.createDataFrame([(system, replicate, whole(path)) for system, replicate, path in sources], "system string, replicate string, place string")
    rows = read_abundance(spark, sorted({path for _, _, path in sources}))
    # Spark writes three slashes where Hadoop writes one.
    file = F.regexp_replace(F.expr("url_decode(replace(file, '+', '%2B'))"), "^file:/+", "file:/")
    rows = rows.withColumn("file", file).withColumn("place", F.explode(F.array_distinct(F.array("file", F.regexp_replace("file", "/[^/]*$", "")))))
    return rows.join(F.broadcast(labels), "place").select("system", "replicate", "timestep", "smiles", "count")


def scan_conditions(spark: SparkSession, root: str, max_depth: int = 4) -> DataFrame:
    """(directory, file): below root, directories that hold *.reactionabcd files, with the first by name; those inside a found one don't count."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.reactionabcd").load(root).select("path")
    rows = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("directory"), "path").groupBy("directory").agg(F.min("path").alias("file"))
    # Spark writes paths with a scheme: depth counts from the end of the root's own path.
    below = F.expr("size(split(substring(directory, locate(root, directory) + length(root)), '/')) - 1")
    rows = rows.withColumn("root", F.lit(root.rstrip("/"))).where(below <= max_depth).drop("root")
    # A directory's ancestors: an equi join on each prefix.
    ups = rows.select(F.col("directory").alias("d"), F.explode(F.sequence(F.lit(1), F.size(F.split("directory", "/")) - 1)).alias("n")).select("d", F.expr("substring_index(d, '/', n)").alias("directory"))
    nested = ups.join(rows.select("directory"), "directory", "left_semi").select(F.col("d").alias("directory")).distinct()
    return rows.join(nested, "directory", "left_anti")
