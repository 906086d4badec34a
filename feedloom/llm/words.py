"""Words of whole texts as native columns, and the row key that tells repeated rows apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words: ASCII other than digits and small letters, or ASCII white space.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACES = r"[\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character kept; null gives an empty text.

    ``lower`` also changes other letters, so it serves only texts that are ASCII throughout.
    """
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def with_words(df: DataFrame, text: Column, separators: str, name: str) -> DataFrame:
    """Add the array of words: ``split`` without the empty strings at the two ends."""
    parts = f"{name}_parts"
    p = F.col(parts)
    lead = (F.get(p, F.lit(0)) == "").cast("int")
    trail = ((F.size(p) > 1) & (F.element_at(p, -1) == "")).cast("int")
    return (
        df.withColumn(parts, F.split(text, separators))
        .withColumn(name, F.slice(p, lead + 1, F.size(p) - lead - trail))
        .drop(parts)
    )


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """Number the rows, so that rows which repeat stay apart.

    The numbers follow the partitions of the scan; the frame must be a stored table, so that a task
    that runs again numbers its rows alike.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def set_aside(df: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str], list[str]]:
    """Rename the columns that begin with an underscore, as the operators' own columns do.

    Returns the frame, the names to give back at the end, and what the columns ``used`` are called now.
    """
    taken, now = set(df.columns), {}
    for name in df.columns:
        if name.startswith("_"):
            other = f"user{name}"
            while other in taken:
                other = f"user_{other}"
            taken.add(other)
            now[name] = other
    return df.withColumnsRenamed(now), {new: old for old, new in now.items()}, [now.get(name, name) for name in used]
