"""Names, labels and effective coordinates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(name: Column) -> Column:
    return F.size(F.split(name, " "))


def last_word(name: Column) -> Column:
    return F.substring_index(name, " ", -1)


def epithet(hybrid: Column, species: Column) -> Column:
    """`x` and the hybrid's last word, else the second word of the species."""
    return F.when(hybrid != "", F.concat(F.lit("x "), last_word(hybrid))).otherwise(F.coalesce(F.get(F.split(species, " "), F.lit(1)), F.lit("")))


def unclassified_label(name: Column, suffix: str = " (unclassified)") -> Column:
    return F.when(words(name) == 1, F.concat(name, F.lit(suffix))).otherwise(name)


def present(private: Column, public: Column) -> Column:
    """The private value where its column exists, blank or not."""
    return F.coalesce(private, public)


def valued(private: Column, public: Column) -> Column:
    """The private value where it exists and is not blank."""
    return F.when(F.coalesce(private, F.lit("")) != "", private).otherwise(public)


def service(private: Column, obscured: Column) -> Column:
    precise = (F.coalesce(private, F.lit("")) != "") | (obscured != "true")
    return F.when(precise, "in-precise").otherwise("in-obscured")


def clock(observed: Column) -> Column:
    """Time of day of `<date> <time> <zone>`; midnight without one."""
    return F.coalesce(F.nullif(F.split_part(observed, F.lit(" "), F.lit(2)), F.lit("")), F.lit("00:00:00"))


def percent(part: Column, whole: Column) -> Column:
    """Unrounded; null where the whole is 0."""
    return F.try_divide(part.cast("double") * 100, whole.cast("double"))


def csv_line(columns: list[Column]) -> Column:
    """Cells as a CSV line; those with commas, quotes or line breaks are quoted, null is blank."""
    cells = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    quoted = [F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in cells]
    return F.concat_ws(",", *quoted)
