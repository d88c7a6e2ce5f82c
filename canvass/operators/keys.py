"""Composite keys flattened to one text column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions.na import paste
from canvass.functions.text import plain_text


def key_of(df: DataFrame, parts: Sequence[str | Column], sep: str = "_") -> Column:
    """Key text of the named columns (or literal columns), in order."""
    return paste(*[plain_text(df, p) if isinstance(p, str) else p for p in parts], sep=sep)


def with_keys(df: DataFrame, keys: Mapping[str, Sequence[str | Column]]) -> DataFrame:
    """Add several keys; one that begins as an earlier one does continues its text, so no part is printed twice."""
    if any(isinstance(p, Column) or p in keys for parts in keys.values() for p in parts):
        return df.withColumns({name: key_of(df, parts) for name, parts in keys.items()})
    made: dict[str, list[str]] = {}
    for name, parts in keys.items():
        begun = [n for n in made if made[n] == list(parts[:len(made[n])])]
        longest = max(begun, key=lambda n: len(made[n]), default=None)
        rest = parts if longest is None else [longest, *parts[len(made[longest]):]]
        df = df.withColumn(name, key_of(df, rest))
        made[name] = list(parts)
    return df


def place_keys(stand: str, segment: str, dwelling: str, family: str | None = None,
               person: str | None = None, participant: str | None = None
               ) -> dict[str, list[str | Column]]:
    """The hierarchical keys a table can have, given its column names."""
    keys: dict[str, list[str | Column]] = {
        "segment_key": [stand, segment],
        "dwelling_key": [stand, segment, dwelling],
    }
    if family:
        keys["family_key"] = [stand, segment, dwelling, family]
    if family and person:
        keys["person_key"] = [stand, segment, dwelling, family, person]
    if participant:
        keys["participant_key"] = [stand, segment, dwelling, participant]
    return keys


def typed_participant_key(df: DataFrame, participant: str, case_type: str | int,
                          stand="standid", segment="segmentid", dwelling="dwellingid", place: str | None = None) -> Column:
    """Participant key qualified by the case type, a column name or a constant; ``place`` names the
    dwelling's key, if the table has it."""
    kind = case_type if isinstance(case_type, str) else F.lit(case_type)
    return key_of(df, [*([place] if place else [stand, segment, dwelling]), participant, kind])
