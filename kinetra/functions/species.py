"""Columns of one species, from its SMILES: atom counts, formula, masses, rings. Computed once per distinct species and joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Monoisotopic and nominal masses.
MONOISOTOPIC_MASS = {"H": 1.00782503223, "C": 12.0, "N": 14.00307400443, "O": 15.99491461957, "F": 18.99840316273, "P": 30.97376199842, "S": 31.9720711744, "Cl": 34.968852682, "Br": 78.9183376, "I": 126.9044719, "Si": 27.97692653465}
NOMINAL_MASS = {"H": 1, "C": 12, "N": 14, "O": 16, "F": 19, "P": 31, "S": 32, "Cl": 35, "Br": 79, "I": 127, "Si": 28}


def _literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def atoms_of(smiles: Column) -> Column:
    """Element symbols of a SMILES in order, bracket atoms first; a bare pair of letters such as Cc is one element."""
    bare = F.regexp_replace(smiles, r"\[.*?\]", "")
    return F.concat(F.regexp_extract_all(smiles, F.lit(r"\[([A-Z][a-z]?)"), 1), F.regexp_extract_all(bare, F.lit(r"([A-Z][a-z]?)"), 1))


def atom_counts(smiles: Column) -> Column:
    """map element -> count, elements sorted."""
    atoms = atoms_of(smiles)
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(atoms)), lambda e: F.struct(e.alias("key"), F.size(F.filter(atoms, lambda a: a == e)).alias("value"))))


def count_of(counts: Column, element: str) -> Column:
    return F.coalesce(F.try_element_at(counts, F.lit(element)), F.lit(0))


def hill_formula(counts: Column) -> Column:
    """C, then H, then the others by name; a count of 1 isn't written."""
    ordered = F.array_sort(F.transform(F.map_entries(counts), lambda e: F.struct(F.when(e["key"] == "C", 0).when(e["key"] == "H", 1).otherwise(2).alias("o"), e["key"].alias("k"), e["value"].alias("n"))))
    return F.array_join(F.transform(ordered, lambda e: F.when(e["n"] == 1, e["k"]).otherwise(F.concat(e["k"], e["n"].cast("string")))), "")


def formula_counts(formula: Column) -> Column:
    """map element -> count of a formula string; a repeated element adds up."""
    pairs = F.arrays_zip(F.regexp_extract_all(formula, F.lit(r"([A-Z][a-z]?)([0-9]*)"), 1).alias("e"), F.regexp_extract_all(formula, F.lit(r"([A-Z][a-z]?)([0-9]*)"), 2).alias("n"))
    number = lambda p: F.when(p["n"] == "", 1).otherwise(p["n"].cast("int"))
    names = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["e"])))
    return F.map_from_entries(F.transform(names, lambda e: F.struct(e.alias("key"), F.aggregate(F.filter(pairs, lambda p: p["e"] == e), F.lit(0), lambda acc, p: acc + number(p)).alias("value"))))


def strict_formula(formula: Column) -> Column:
    """struct(counts, error): the counts of a formula that is nothing but elements and counts, or what is wrong with it and no counts.

    A plus sign joins the formulas of several species, whose counts add up; blanks around them don't matter, and the sign for an
    empty set stands for no species. An element whose counts add up to 0 is left out.
    """
    parts = F.filter(F.transform(F.split(F.coalesce(formula, F.lit("")), r"\+"), lambda x: F.trim(x)), lambda x: (x != "") & (x != "∅"))
    text = F.array_join(parts, "")
    rest = F.regexp_replace(text, "[A-Z][a-z]?[0-9]{0,9}", "")
    counts = F.map_filter(formula_counts(F.when(rest == "", text)), lambda k, n: n > 0)
    error = F.when(text == "", "empty formula").when(rest != "", "invalid formula").when(F.size(F.map_keys(counts)) == 0, "no atoms")
    return F.struct(F.when(error.isNull(), counts).alias("counts"), error.alias("error"))


def exact_mass(counts: Column) -> Column:
    """Null if an element has no mass."""
    return F.aggregate(F.map_entries(counts), F.lit(0.0), lambda acc, e: acc + F.try_element_at(_literal_map(MONOISOTOPIC_MASS), e["key"]) * e["value"])


def nominal_mass(counts: Column) -> Column:
    return F.aggregate(F.map_entries(counts), F.lit(0), lambda acc, e: acc + F.try_element_at(_literal_map(NOMINAL_MASS), e["key"]) * e["value"])


def heavy_atoms(counts: Column) -> Column:
    return F.aggregate(F.map_entries(counts), F.lit(0), lambda acc, e: acc + F.when(e["key"] == "H", 0).otherwise(e["value"]))


def has_ring(smiles: Column) -> Column:
    """Any digit that isn't right behind a bracket."""
    return smiles.rlike(r"(?<!\[)[0-9]")


def ring_atoms(smiles: Column) -> Column:
    """Two atoms for each distinct ring digit."""
    return 2 * F.size(F.array_distinct(F.regexp_extract_all(smiles, F.lit(r"(?<!\[)([0-9])"), 1)))


def species_dim(species: DataFrame, smiles: str = "smiles") -> DataFrame:
    """One row per distinct species: formula, atom_counts, exact_mass, nominal_mass, n_heavy, has_ring, ring_atoms."""
    rows = species.select(smiles).where(F.col(smiles).isNotNull()).distinct().withColumn("atom_counts", atom_counts(F.col(smiles)))
    c = F.col("atom_counts")
    return rows.select(
        smiles, "atom_counts", hill_formula(c).alias("formula"), exact_mass(c).alias("exact_mass"), nominal_mass(c).alias("nominal_mass"), heavy_atoms(c).alias("n_heavy"), has_ring(F.col(smiles)).alias("has_ring"), ring_atoms(F.col(smiles)).alias("ring_atoms")
    )


def matches_elements(counts: Column, present: tuple = (), absent: tuple = (), ranges: dict | None = None) -> Column:
    """Element filters: all of present, none of absent, and counts in [min, max]."""
    test = F.lit(True)
    for e in present:
        test &= count_of(counts, e) > 0
    for e in absent:
        test &= count_of(counts, e) == 0
    for e, (low, high) in (ranges or {}).items():
        if low is not None and low < 0 or high is not None and high < (low or 0):
            raise ValueError("a range needs 0 <= min <= max")
        test &= (count_of(counts, e) >= (low or 0)) & (F.lit(True) if high is None else count_of(counts, e) <= high)
    return test
