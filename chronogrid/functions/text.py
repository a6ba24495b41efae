"""Display helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dataset_title(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def prettify(c: Column) -> Column:
    s = F.replace(c, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.left(s, F.lit(1))), F.lower(F.substr(s, F.lit(2))))


def preview(c: Column, most: int = 200) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("..."))).otherwise(c)


def shown_tags(tags: Column, n: int = 2) -> Column:
    return F.slice(tags, 1, n)


def more_tags(tags: Column, n: int = 2) -> Column:
    return F.greatest(F.size(tags) - n, F.lit(0))


def period_label(start: Column, end: Column) -> Column:
    return F.when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))


def translated(c: Column, words: dict[str, str]) -> Column:
    """Words of a small dictionary; unknown ones stay."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), c), c)


#: Shown names of content types.
CONTENT_TYPES = {"image": "Afbeelding", "person": "Persoon", "text": "Tekst"}


def pairs(m: Column, keys: list[str]) -> Column:
    """The wanted entries of a map as an array of (key, value)."""
    return F.map_entries(F.map_filter(m, lambda k, _: k.isin(keys)))


def set_label(chosen: Column, every: Column, word: str = "all types") -> Column:
    """`word` when all are chosen, else the chosen ones."""
    return F.when(F.size(F.array_except(every, chosen)) == 0, F.lit(word)).otherwise(F.array_join(chosen, ", "))


def page_bounds(total: Column, number: Column, size: Column) -> Column:
    """struct(pages, first, last): how many pages, and the records on this one, counted from 1."""
    first = (number - 1) * size + 1
    return F.struct(F.ceil(total / size).alias("pages"), first.alias("first"), F.least(number * size, total).alias("last"))
