"""Finding fields by header alias, for fixed columns and for keyed rows.

`ColumnLookup` is for a DataFrame whose columns are the headers: aliases are
resolved while the plan is built, so a record projection is plain generated
code. `EntryLookup` is for rows whose headers are only known at run time, held
as ARRAY<STRUCT<header, value>> in column order.
Both follow the same rules: a header matches by its normalised form, the first
non-blank value of a normalised header wins, and aliases are tried in order.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import (
    clean_cell,
    half_even,
    normalize_header,
    nullable_cell,
    parse_numeric,
)
from tidemark.vocabulary import CAPACITY_EXCLUDES, CAPACITY_HINTS

CAPACITY_TYPE = "struct<capacity_mw:bigint,capacity_source_field:string>"
ENTRY_TYPE = "array<struct<header:string,value:string>>"


def header_name(text: str) -> str:
    """`normalize_header` for a header known while the plan is built."""
    return re.sub("[^a-z0-9]+", "", text.lower())


def is_capacity_name(name: str) -> bool:
    return any(h in name for h in CAPACITY_HINTS) and not any(x in name for x in CAPACITY_EXCLUDES)


def is_capacity_header(name: Column) -> Column:
    """The same test on a column of normalised headers."""
    return name.rlike("|".join(CAPACITY_HINTS)) & ~name.rlike("|".join(CAPACITY_EXCLUDES))


def _ranked(number: Column, position: Column, header: Column) -> Column:
    """Orders candidates: positive first, then by size; the earlier column wins a tie."""
    return F.struct(
        (number > 0).alias("positive"),
        number.alias("number"),
        (-position).alias("earliness"),
        header.alias("header"),
    )


def _best_capacity(candidates: Column) -> Column:
    best = F.array_max(F.filter(candidates, lambda c: c["number"].isNotNull()))
    return F.transform(
        F.array(best),
        lambda b: F.struct(
            half_even(b["number"]).alias("capacity_mw"),
            b["header"].alias("capacity_source_field"),
        ),
    )[0].cast(CAPACITY_TYPE)


class ColumnLookup:
    """Aliases over named columns.

    `prepare` cleans every cell once, into one array. Cleaning them as separate
    columns would repeat its code for each, into a generated method too large
    for the JVM to compile.
    """

    def __init__(self, headers: Sequence[str]):
        self.headers = list(headers)
        self.names = [header_name(h) for h in self.headers]

    def prepare(self, rows: DataFrame) -> DataFrame:
        cells = F.array(*[F.col(f"`{h}`").cast("string") for h in self.headers])
        cleaned = rows.withColumn("_cells", F.transform(cells, lambda c: clean_cell(c)))
        return cleaned.withColumn(
            "_values", F.transform("_cells", lambda c: nullable_cell(c))
        ).drop(*self.headers)

    def _is_first(self, index: int) -> Column:
        """The cell has text and no earlier column of the same name has any."""
        earlier = [j for j in range(index) if self.names[j] == self.names[index]]
        return reduce(
            lambda a, b: a & b,
            [F.get("_cells", F.lit(j)) == "" for j in earlier],
            F.get("_cells", F.lit(index)) != "",
        )

    def value(self, aliases: Sequence[str]) -> Column:
        options = []
        for alias in aliases:
            same = [i for i, name in enumerate(self.names) if name == alias]
            if len(same) == 1:
                options.append(F.get("_values", F.lit(same[0])))
            elif same:
                options.append(
                    F.coalesce(
                        *[F.when(self._is_first(i), F.get("_values", F.lit(i))) for i in same]
                    )
                )
        return F.coalesce(*options) if options else F.lit(None).cast("string")

    def capacity(self) -> Column:
        found = [
            F.struct(
                F.when(self._is_first(i), F.get("_cells", F.lit(i))).alias("text"),
                F.lit(i).alias("position"),
                F.lit(self.headers[i]).alias("header"),
            )
            for i, name in enumerate(self.names)
            if is_capacity_name(name)
        ]
        if not found:
            return F.lit(None).cast(CAPACITY_TYPE)
        return _best_capacity(
            F.transform(
                F.array(*found), lambda c: _ranked(parse_numeric(c["text"]), c["position"], c["header"])
            )
        )

    def source_row(self) -> Column:
        """MAP of the non-blank cells, whole."""
        if len(set(self.headers)) < len(self.headers):
            names = F.array(*[F.lit(h) for h in self.headers])
            pairs = F.arrays_zip(names.alias("header"), F.col("_cells").alias("value"))
            return compact_row(F.filter(pairs, lambda e: e["value"] != ""))
        return F.map_filter(
            F.map_from_arrays(F.array(*[F.lit(h) for h in self.headers]), F.col("_cells")),
            lambda _, value: value != "",
        )


class EntryLookup:
    """Aliases over rows that carry their cells as ARRAY<STRUCT<header, value>> `entries`.

    `prepare` builds the map from normalised header to value once per row.
    """

    def prepare(self, rows: DataFrame) -> DataFrame:
        named = rows.withColumn(
            "_names", F.transform("entries", lambda e: normalize_header(e["header"]))
        )
        # The first of several entries with the same normalised header counts.
        firsts = F.filter(
            F.arrays_zip(F.col("_names").alias("name"), F.col("entries").alias("entry")),
            lambda e, i: F.array_position(F.col("_names"), e["name"]) == i + 1,
        )
        firsts = named.withColumn("_firsts", firsts)
        usable = F.filter(
            F.transform(
                "_firsts",
                lambda e: F.struct(
                    e["name"].alias("key"), nullable_cell(e["entry"]["value"]).alias("value")
                ),
            ),
            lambda e: e["value"].isNotNull(),
        )
        return firsts.withColumn("_values", F.map_from_entries(usable))

    def value(self, aliases: Sequence[str]) -> Column:
        return F.coalesce(*[F.try_element_at("_values", F.lit(a)) for a in aliases])

    def capacity(self) -> Column:
        candidates = F.transform(
            "_firsts",
            lambda e, i: _ranked(
                F.when(is_capacity_header(e["name"]), parse_numeric(e["entry"]["value"])),
                i,
                e["entry"]["header"],
            ),
        )
        return _best_capacity(candidates)

    def source_row(self) -> Column:
        return compact_row(F.col("entries"))


def compact_row(entries: Column) -> Column:
    """MAP of the entries, whole; of repeated headers the first place and the last value count."""
    keys = F.transform(entries, lambda e: e["header"])
    pairs = F.transform(entries, lambda e: F.struct(e["header"].alias("key"), e["value"].alias("value")))
    merged = F.transform(
        F.array_distinct(keys),
        lambda k: F.element_at(F.filter(pairs, lambda x: x["key"] == k), -1),
    )
    distinct = F.when(F.size(F.array_distinct(keys)) == F.size(keys), pairs).otherwise(merged)
    return F.map_from_entries(distinct)
