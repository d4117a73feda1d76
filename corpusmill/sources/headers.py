"""Short labelled headers put in front of library items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def labelled_lines(fields: dict[str, Column]) -> Column:
    """``Label: value`` lines; blank and missing values leave no line."""
    return F.concat_ws("\n", *[
        F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{label}: "), value))
        for label, value in fields.items()])


def tag_names(tags: Column, field: str) -> Column:
    return F.array_join(F.filter(F.transform(tags, lambda t: t[field]), lambda n: n != ""), ", ")


def creator_names(creators: Column) -> Column:
    """Names of struct(name, firstName, lastName), in order."""
    def shown(c: Column) -> Column:
        return F.coalesce(F.nullif(c["name"], F.lit("")),
                          F.trim(F.concat_ws(" ", F.nullif(c["firstName"], F.lit("")), F.nullif(c["lastName"], F.lit("")))))

    return F.array_join(F.filter(F.transform(creators, shown), lambda n: n != ""), ", ")


def with_header(header: Column, body: Column) -> Column:
    return F.when(header != "", F.concat(header, F.lit("\n\n"), body)).otherwise(body)
