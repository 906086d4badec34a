"""Text functions: normalizing, row rendering, windows over long text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.types import col

#: Unicode white space plus the four ASCII separators.
BLANKS = r"(?U)[\s\x1c-\x1f]+"
EDGE_BLANKS = {
    "left": r"(?U)^[\s\x1c-\x1f]+",
    "right": r"(?U)[\s\x1c-\x1f]+$",
    "both": r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$",
}


def collapse_whitespace(c: Column) -> Column:
    """Every run of white space becomes one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def strip(c: Column, side: str = "both") -> Column:
    return F.regexp_replace(c, EDGE_BLANKS[side], "")


def normalize_phrase(c: Column) -> Column:
    """Lower case, ``_`` as space, punctuation other than ``. % -`` dropped."""
    spaced = F.replace(F.lower(c), F.lit("_"), F.lit(" "))
    return collapse_whitespace(F.regexp_replace(spaced, r"[^\p{L}\p{N}\s.%-]", " "))


def normalize_identifier(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def row_text(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """``name: value | name: value`` over the columns, NULL as empty text."""
    parts = [
        F.concat(F.lit(f"{name}: "), F.coalesce(col(name).cast("string"), F.lit("")))
        for name in (columns or df.columns)
    ]
    return F.concat_ws(" | ", *parts)


def check_window(max_chars: int, overlap: int) -> None:
    if max_chars < 1 or overlap < 0 or overlap >= max_chars:
        raise ValueError("need 0 <= overlap < max_chars")


#: Windows cut from one slice of the text; keeps substring offsets short.
WINDOWS_PER_SLICE = 64


def text_windows(text: Column, max_chars: int = 800, overlap: int = 120) -> Column:
    """Array of windows over already collapsed text; short text is one window.

    Character offsets are found by walking the bytes, so the text is first cut
    into slices of 64 windows and each window is cut from its slice: long
    documents cost far less than one walk from the start per window.
    """
    check_window(max_chars, overlap)
    step = max_chars - overlap
    span = step * WINDOWS_PER_SLICE
    length = F.length(text)
    last = F.greatest(F.lit(0), F.ceil((length - max_chars) / step)).cast("int")

    def cut_slice(s: Column) -> Column:
        piece = F.substring(text, (s * span + 1).cast("int"), F.lit(span + overlap))
        upto = F.least(last - s * WINDOWS_PER_SLICE, F.lit(WINDOWS_PER_SLICE - 1)).cast("int")
        return F.struct(piece.alias("piece"), upto.alias("upto"))

    slices = F.transform(
        F.sequence(F.lit(0), F.floor(last / WINDOWS_PER_SLICE).cast("int")), cut_slice
    )
    return F.flatten(
        F.transform(
            slices,
            lambda s: F.transform(
                F.sequence(F.lit(0), s["upto"]),
                lambda i: F.substring(s["piece"], (i * step + 1).cast("int"), F.lit(max_chars)),
            ),
        )
    )
