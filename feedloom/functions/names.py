"""Column-name heuristics, as columns over a catalog and as plain rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Role words by column name; the last three need a numeric column.
ROLE_WORDS = (
    ("resolver", ("assigned", "resolver", "owner"), False),
    ("agent", ("agent", "handler"), False),
    ("category", ("category", "type"), False),
    ("status", ("status", "state"), False),
    ("duration", ("time", "hour", "duration", "days", "age"), True),
    ("cost", ("cost", "price", "amount", "revenue"), True),
    ("count", ("count", "num", "tickets"), True),
)

# Dataset tags by column name.
TAG_WORDS = (
    ("location", ("address", "city", "zip")),
    ("temporal", ("date", "time", "timestamp")),
    ("financial", ("amount", "revenue", "cost")),
    ("status-tracking", ("status", "state")),
    ("records", ("ticket",)),
)
LATITUDE_WORDS = ("lat",)
LONGITUDE_WORDS = ("lon", "lng", "long")

# Leaderboard name hints and headline column names.
GROUP_WORDS = ("assign", "owner", "resolver", "agent", "team")
VALUE_WORDS = ("time", "hour", "duration", "resolve", "age", "days")
HEADLINE_NAMES = ("category", "severity", "status", "owner", "assignee")


def has_word(name: Column, words: tuple[str, ...]) -> Column:
    """True when the lower-cased name contains any of the words."""
    lowered = F.lower(name)
    test = F.lit(False)
    for word in words:
        test = test | lowered.contains(word)
    return test


def looks_like_id(name: Column) -> Column:
    return F.array_contains(F.split(F.lower(name), "_"), "id")


def role_hint(name: Column, numeric: Column) -> Column:
    """Role of a column by name, first match wins, NULL when none fits."""
    chain = None
    for role, words, needs_number in ROLE_WORDS:
        test = has_word(name, words)
        test = test & numeric if needs_number else test
        chain = F.when(test, role) if chain is None else chain.when(test, role)
    return chain


def role_of(name: str, numeric: bool) -> str | None:
    """:func:`role_hint` for one name known to the driver."""
    lowered = name.lower()
    fits = (
        role
        for role, words, needs_number in ROLE_WORDS
        if (numeric or not needs_number) and any(word in lowered for word in words)
    )
    return next(fits, None)


def dataset_tags(name: Column) -> Column:
    """Aggregate: the sorted tags a set of column names implies."""
    tests = [(tag, F.bool_or(has_word(name, words))) for tag, words in TAG_WORDS]
    geo = F.bool_or(has_word(name, LATITUDE_WORDS)) & F.bool_or(has_word(name, LONGITUDE_WORDS))
    tests.append(("geospatial", geo))
    return F.array_sort(F.array_compact(F.array(*[F.when(test, tag) for tag, test in tests])))


def merge_tags(*tags: Column) -> Column:
    """Sorted union of tag arrays."""
    return F.array_sort(F.array_distinct(F.concat(*[F.coalesce(t, F.array()) for t in tags])))
