"""Rules that turn purposes and label lists into one class per building."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gevel.functions.scalars import any_differs

# Registry vocabulary and class names.
DWELLING = "woonfunctie"
OTHER_PURPOSE = "overige gebruiksfunctie"
UNIT_IN_USE = "Verblijfsobject in gebruik"
BUILDING_IN_USE = "Pand in gebruik"
UNIT_PREFIX = "NL.IMBAG.Verblijfsobject."
RESIDENTIAL = "Residential"
MIXED = "Mixed-residential"
SINGLE_FUNCTION = "Non-residential (single-function)"
MULTI_FUNCTION = "Non-residential (multi-function)"
OTHERS = "Others"
UNKNOWN = "Unknown"
APARTMENT = "Appartement"
MAISONETTE = "Maisonnette"
GALLERY = "Galerijwoning"
PORCH = "Portiekwoning"
FLAT = "Flatwoning (overig)"
VOTED_MAISONETTE = "Maisonette"
SEMI_DETACHED = "Twee-onder-één-kap"
END_HOUSE = "Rijwoning hoek"
TERRACED = "Rijwoning tussen"
DETACHED = "Vrijstaande Woning"

# Final spelling of each label; others stay as they are.
CANONICAL = {
    "Flatwoning (overig)": "Flatwoning",
    "Rijwoning hoek": "Hoekwoning",
    "Maisonette": "Maisonnettewoning",
    "Maisonnette": "Maisonnettewoning",
    "Rijwoning tussen": "Tussenwoning",
    "Twee-onder-één-kap": "Twee-onder-een-kapwoning",
    "Vrijstaande woning": "Vrijstaande Woning",
}


def function_class(uses: Column) -> Column:
    """Class of a building from the distinct set of its purposes."""
    only_dwelling = uses == F.array(F.lit(DWELLING))
    only_other = uses == F.array(F.lit(OTHER_PURPOSE))
    commercial = any_differs(uses, DWELLING) & ~only_other
    return (
        F.when(only_dwelling, RESIDENTIAL)
        .when(~only_dwelling & F.array_contains(uses, DWELLING), MIXED)
        .when(commercial & (F.cardinality(uses) == 1), SINGLE_FUNCTION)
        .when(commercial & (F.cardinality(uses) > 1), MULTI_FUNCTION)
        .when(only_other, OTHERS)
        .when(uses.isNull(), UNKNOWN)
    )


def counts_for_adjacency(function: Column) -> Column:
    """False for unknown, odd and missing functions."""
    return F.coalesce(~function.isin(OTHERS, UNKNOWN), F.lit(False))


def is_kept_residential(function: Column) -> Column:
    """Dwellings stay; so do rows without any function."""
    return function.isNull() | function.isin(RESIDENTIAL, MIXED)


def majority_label(a: Column, m: Column, g: Column, p: Column, f: Column) -> Column:
    """Winner among five counts: apartment, maisonette, gallery, porch, flat.

    A specific type wins ties against the two general ones (apartment, flat);
    ties between specific types have no winner.
    """

    def wins(x: Column, general: list[Column], specific: list[Column]) -> Column:
        cond = F.lit(True)
        for other in general:
            cond = cond & (x >= other)
        for other in specific:
            cond = cond & (x > other)
        return cond

    return (
        F.when(wins(a, [], [m, g, p, f]), FLAT)
        .when(wins(m, [a, f], [g, p]), VOTED_MAISONETTE)
        .when(wins(g, [a, f], [m, p]), GALLERY)
        .when(wins(p, [a, f], [m, g]), PORCH)
        .when(wins(f, [a], [m, g, p]), FLAT)
    )


def canonical_label(label: Column) -> Column:
    pairs = [F.lit(x) for kv in CANONICAL.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label), label)


def row_house_label(adjacent: Column, adjacent_of_adjacent: Column, dwellings: Column) -> Column:
    """Split the shared semi-detached / end-house label by position in the row."""
    single = dwellings == 1
    return (
        F.when(single & (adjacent > 1), TERRACED)
        .when(single & (adjacent == 1) & (adjacent_of_adjacent > 1), END_HOUSE)
        .when(single & (adjacent == 1) & (adjacent_of_adjacent == 1), SEMI_DETACHED)
    )
