"""Plain phrases such as ``status is open and balance over 100`` as predicates.

A phrase is compiled once, on the driver, against a schema; the result is an
ordinary predicate that Spark pushes into the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame

from feedloom.operators.predicates import Condition, fold
from feedloom.types import logical_type

# Words and their operators, in order of precedence.
OPERATOR_WORDS = (
    ("greater than or equal to", "gte"),
    ("at least", "gte"),
    ("no less than", "gte"),
    ("less than or equal to", "lte"),
    ("at most", "lte"),
    ("no more than", "lte"),
    ("greater than", "gt"),
    ("more than", "gt"),
    ("over", "gt"),
    ("less than", "lt"),
    ("under", "lt"),
    ("below", "lt"),
    ("does not equal", "neq"),
    ("not equal to", "neq"),
    ("not", "neq"),
    ("equals", "eq"),
    ("equal to", "eq"),
    ("is", "eq"),
    ("==", "eq"),
    ("=", "eq"),
    ("contains", "contains"),
    ("includes", "contains"),
)

# Phrases and words that carry no condition.
FILLERS = (
    "show me", "all rows", "show rows", "show records", "all", "rows", "records", "users",
    "where", "with", "that have", "that has", "who have",
)

# Fixed values: (words in the phrase, hints in a column name) per role.
ROLE_CUES = (
    (
        ("resolved", "unresolved", "open", "closed", "pending", "escalated", "active"),
        ("status", "state", "resolution", "outcome", "stage"),
    ),
    (
        ("owner", "assignee", "agent", "handler"),
        ("owner", "assignee", "agent", "handler", "resolver"),
    ),
    (
        ("urgent", "priority", "high", "medium", "low", "severity"),
        ("priority", "severity", "impact"),
    ),
)
STATUS_VALUES = ROLE_CUES[0][0]
STATUS_COLUMN_HINTS = ("status", "state", "resolution", "stage")

_NUMBER = re.compile(r"-?\d+(?:\.\d+)?%?")
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}(?:[ t]\d{2}:\d{2}(?::\d{2})?)?")


def _plain(text: str) -> str:
    """Phrase normal form; ``=`` survives because it is an operator."""
    kept = re.sub(r"[^\w\s.%=:-]", " ", text.lower().replace("_", " "))
    return " ".join(re.sub(r"(==?)", r" \1 ", kept).split())


def _without(text: str, words: str) -> str | None:
    """The text less the first whole-word occurrence of the words, or None."""
    pattern = rf"(?<![\w]){re.escape(words)}(?![\w])" if words[0] != "=" else re.escape(words)
    rest, hits = re.subn(pattern, " ", text, count=1)
    return " ".join(rest.split()) if hits else None


def _number(text: str) -> int | float:
    if text.endswith("%"):
        return float(text[:-1]) / 100.0
    return float(text) if "." in text else int(text)


class _Clause:
    def __init__(self, text: str, df: DataFrame, quoted: list[str]):
        self.rest, self.df, self.quoted = _plain(text), df, quoted
        self.column = self._named_column() or self._column_by_role()
        if self.column is None:
            raise ValueError(f"could not understand condition {text!r}")
        self.kind = logical_type(df.schema[self.column].dataType)

    def _named_column(self) -> str | None:
        for name in sorted(self.df.columns, key=lambda c: -len(_plain(c))):
            rest = _without(self.rest, _plain(name)) if _plain(name) else None
            if rest is not None:
                self.rest = rest
                return name
        return None

    def _column_by_role(self) -> str | None:
        words = set(self.rest.split())
        for cues, hints in ROLE_CUES:
            if words & set(cues):
                for name in self.df.columns:
                    if any(hint in name.lower() for hint in hints):
                        return name
        return None

    def condition(self) -> Condition:
        op = "eq"
        for words, code in OPERATOR_WORDS:
            rest = _without(self.rest, words)
            if rest is not None:
                op, self.rest = code, rest
                break
        value = self._value()
        if value == "":
            raise ValueError(f"no value for column {self.column!r}")
        ordered = op in ("gt", "gte", "lt", "lte")
        numeric = self.kind in ("integer", "float", "decimal")
        if ordered and numeric and isinstance(value, str):
            raise ValueError(f"{value!r} is not a number; {self.column!r} is numeric")
        return Condition(self.column, op, value)

    def _value(self) -> object:
        for word in self.rest.split():
            if re.fullmatch(r"quoted\d+q", word):
                return self.quoted[int(word[6:-1])]
        if self.kind == "datetime":
            found = _DATE.search(self.rest)
            return found.group(0) if found else self.rest
        if any(hint in self.column.lower() for hint in STATUS_COLUMN_HINTS):
            known = [w for w in self.rest.split() if w in STATUS_VALUES]
            if known:
                return known[-1]
        text = re.sub(r"^(is|be|the)\s+", "", self.rest)
        found = _NUMBER.search(text)
        if found and (self.kind != "string" or found.group(0) == text):
            number = _number(found.group(0))
            return str(number) if self.kind == "string" else number
        return text


def parse(phrase: str, df: DataFrame) -> tuple[list[Condition], list[str]]:
    """Conditions of a phrase and the connectors between them."""
    quoted: list[str] = []

    def hide(match: re.Match) -> str:
        quoted.append(match.group(1) or match.group(2))
        return f" quoted{len(quoted) - 1}q "

    text = re.sub(r"\"([^\"]+)\"|'([^']+)'", hide, phrase).lower().replace("?", " ")
    for filler in FILLERS:
        text = re.sub(rf"\b{filler}\b", " ", text)
    if not text.strip():
        raise ValueError("the phrase holds no condition")
    pieces = [p.strip() for p in re.split(r"\b(and|or)\b", text)]
    clauses = [p for p in pieces if p and p not in ("and", "or")]
    links = [p for p in pieces if p in ("and", "or")]
    return [_Clause(c, df, quoted).condition() for c in clauses], links


def phrase_predicate(df: DataFrame, phrase: str) -> Column:
    return fold(df, *parse(phrase, df))


def filter_by_phrase(df: DataFrame, phrase: str) -> DataFrame:
    return df.where(phrase_predicate(df, phrase))
