"""Columns of one reaction, from its two sides (arrays of species)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_terms(side: Column, separators: str = "+") -> Column:
    """Terms of 'A+B'; a plus inside square brackets is a charge and doesn't split."""
    return F.filter(F.transform(F.split(side, rf"[{separators}](?![^\[]*\])"), lambda x: F.trim(x)), lambda x: x != "")


def side_key(side: Column) -> Column:
    return F.array_join(F.array_sort(side), "+")


def reaction_key(reactants: Column, products: Column) -> Column:
    """Multiplicity counts, order within a side doesn't."""
    return F.concat(side_key(reactants), F.lit("->"), side_key(products))


def _without_first(items: Column, x: Column) -> Column:
    """items without the first x, if it is there."""
    at = F.array_position(items, x)
    return F.when(at > 0, F.concat(F.slice(items, F.lit(1), (at - 1).cast("int")), F.slice(items, (at + 1).cast("int"), F.greatest(F.size(items) - at.cast("int"), F.lit(0))))).otherwise(items)


def multiset_minus(left: Column, right: Column) -> Column:
    """left without one match for each term of right."""
    return F.aggregate(right, left, _without_first)


def net_key(reactants: Column, products: Column) -> Column:
    """Key of what is left when species common to both sides cancel one for one."""
    return reaction_key(multiset_minus(reactants, products), multiset_minus(products, reactants))


def count_in(side: Column, species: Column) -> Column:
    return F.size(F.filter(side, lambda x: x == species))


def stoich_delta(reactants: Column, products: Column, species: Column) -> Column:
    return count_in(products, species) - count_in(reactants, species)


def contains_terms(have: Column, need: dict[str, int]) -> Column:
    """Multiset containment; an empty need holds for any side."""
    test = F.lit(True)
    for term, n in need.items():
        test &= count_in(have, F.lit(term)) >= n
    return test


def equal_terms(have: Column, need: dict[str, int]) -> Column:
    """Multiset equality; an empty need holds for any side."""
    return contains_terms(have, need) & (F.size(have) == sum(need.values())) if need else F.lit(True)


def match_formulas(reactants: Column, products: Column, left: dict[str, int], right: dict[str, int], mode: str = "contains") -> Column:
    """Whether the formulas of both sides contain, or are exactly, the terms asked for."""
    if mode not in ("contains", "exact"):
        raise ValueError("mode must be contains or exact")
    test = contains_terms if mode == "contains" else equal_terms
    return test(reactants, left) & test(products, right)


def compose(anchor_reactants: Column, anchor_products: Column, next_reactants: Column, next_products: Column, bridge: Column) -> tuple[Column, Column]:
    """Sides of the net change of two reactions chained over one molecule of the bridge species."""
    return F.concat(anchor_reactants, _without_first(next_reactants, bridge)), F.concat(_without_first(anchor_products, bridge), next_products)


def stable_id(*parts: Column, length: int = 16) -> Column:
    """First hex digits of the SHA-1 of the parts, joined by a zero character."""
    return F.substring(F.sha1(F.concat_ws("\x00", *[p.cast("string") for p in parts]).cast("binary")), 1, length)


# Formulas of oxidisers and of hydrogen species.
OXIDIZERS = ("O2", "HO", "HO2", "O", "H2O2", "O3")
H_SPECIES = ("H", "HCl", "H2")


def radical_class(reactants: Column, products: Column, target: str, targets: tuple[str, ...] = (), oxidizers: tuple[str, ...] = OXIDIZERS, h_species: tuple[str, ...] = H_SPECIES) -> Column:
    """Class of a reaction of the target formula; the sides are arrays of formulas, and the first rule that holds counts."""
    t, others = F.lit(target), F.filter(reactants, lambda x: x != target)
    any_of = lambda values: F.exists(others, lambda x: x.isin(*values)) if values else F.lit(False)
    alone = (F.size(reactants) == 1) & (F.get(reactants, 0) == t)
    return (
        F.when(alone & (F.size(products) == 1), "isomerisation")
        .when(alone, "fragmentation")
        .when(any_of(oxidizers), "oxidation")
        .when(any_of(tuple(x for x in targets if x != target)), "cross coupling")
        .when(F.array_contains(others, "Cl"), "chlorine coupling")
        .when(any_of(h_species), "hydrogen transfer")
        .when(F.exists(others, lambda x: x.contains("C")), "with organic species")
        .when(F.size(others) > 0, "other bimolecular")
        .otherwise("other")
    )


def radical_subclass(reactants: Column, products: Column, target: str, targets: tuple[str, ...] = (), oxidizers: tuple[str, ...] = OXIDIZERS, h_species: tuple[str, ...] = H_SPECIES) -> Column:
    """What a reaction of the target does in its class: the first partner that puts it there, and the products, as '+ O2 -> C6H5O3'."""
    kind = radical_class(reactants, products, target, targets, oxidizers, h_species)
    others = F.filter(reactants, lambda x: x != target)
    first = lambda test: F.get(F.filter(others, test), F.lit(0))
    partner = (
        F.when(kind == "oxidation", first(lambda x: x.isin(*oxidizers)))
        .when(kind == "cross coupling", first(lambda x: x.isin(*targets)))
        .when(kind == "chlorine coupling", F.lit("Cl"))
        .when(kind == "hydrogen transfer", first(lambda x: x.isin(*h_species)))
        .when(kind == "with organic species", first(lambda x: x.contains("C")))
        .when(kind == "other bimolecular", F.get(others, F.lit(0)))
    )
    made = F.concat(F.lit("-> "), F.array_join(products, " + "))
    same = (kind == "isomerisation") & (F.get(products, F.lit(0)) == target)
    return F.when(same, "rearrangement").when(partner.isNotNull(), F.concat(F.lit("+ "), partner, F.lit(" "), made)).otherwise(made)
