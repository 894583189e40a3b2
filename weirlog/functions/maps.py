"""Map and list column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sorted_map(column: Column) -> Column:
    return F.map_from_entries(F.sort_array(F.map_entries(column)))


def normalise_headers(column: Column) -> Column:
    """Lower-case the names and turn an empty list of values into NULL.

    Names that differ only in case become one name with all the values.
    """
    values = F.transform_values(column, lambda _, v: F.when(F.size(v) > 0, v))
    names = F.array_distinct(F.transform(F.map_keys(column), F.lower))
    merged = F.map_from_entries(
        F.transform(
            names,
            lambda name: F.struct(
                name,
                F.flatten(
                    F.filter(
                        F.map_values(F.map_filter(column, lambda k, _: F.lower(k) == name)),
                        lambda v: v.isNotNull(),
                    )
                ),
            ),
        )
    )
    merged = F.transform_values(merged, lambda _, v: F.when(F.size(v) > 0, v))
    unique = F.size(names) == F.size(F.map_keys(column))
    plain = F.map_from_arrays(F.transform(F.map_keys(values), F.lower), F.map_values(values))
    return F.when(F.size(column) > 0, F.when(unique, plain).otherwise(merged))


def first_value(headers: Column, name: str) -> Column:
    """First value of a header in a normalised map, NULL where absent or empty."""
    return F.nullif(F.get(F.try_element_at(headers, F.lit(name)), F.lit(0)), F.lit(""))


def collapse_values(column: Column) -> Column:
    """A list as a VARIANT for rendering: none is NULL, one a scalar, more a list."""
    return F.when(F.size(column) == 1, F.get(column, F.lit(0)).cast("variant")).when(
        F.size(column) > 1, column.cast("variant")
    )


def expand_values(column: Column) -> Column:
    """The reverse of :func:`collapse_values`."""
    return F.coalesce(
        F.try_variant_get(column, "$", "array<string>"),
        F.when(column.isNotNull() & ~F.is_variant_null(column), F.array(F.try_variant_get(column, "$", "string"))),
    )
