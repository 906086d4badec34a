"""Routing and answering tables of questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.names import role_of
from feedloom.operators.profile import (
    bottom_values,
    leaderboard_pairs,
    leaderboards,
    top_values,
)
from feedloom.types import is_numeric

# Words of questions that data answers, and of those wanting rows.
DATA_WORDS = (
    "average", "avg", "mean", "count", "number of", "sum", "total", "min", "max", "median",
    "percent", "percentage", "rate", "trend", "over time", "by ", "group", "breakdown", "top",
    "highest", "lowest", "most", "least", "duplicate", "unique", "distribution", "priority",
    "status", "assignee", "tickets", "list", "show", "resolve", "resolution",
)
LIST_WORDS = ("show", "list", "display", "give me", "see all", "all rows", "show me")

# Words of superlative questions.
MOST_WORDS = ("most", "highest", "largest", "top", "greatest")
LEAST_WORDS = ("fewest", "least", "lowest", "smallest")
FAST_WORDS = ("fastest", "quickest", "shortest", "lowest", "best")
SLOW_WORDS = ("slowest", "longest", "highest", "worst")
PEOPLE_WORDS = ("ticket", "resolve", "assigned", "who")
PEOPLE_ROLES = ("resolver", "owner", "assignee", "agent")


def mentions(question: Column, words: Sequence[str]) -> Column:
    """True when the question contains any of the words, in any case."""
    lowered, test = F.lower(question), F.lit(False)
    for word in words:
        test = test | lowered.contains(word)
    return F.coalesce(test, F.lit(False))


def says(question: Column, words: Sequence[str]) -> Column:
    """Like :func:`mentions`, but whole words: "slowest" does not say "lowest"."""
    return F.coalesce(F.lower(question).rlike(rf"\b({'|'.join(words)})\b"), F.lit(False))


def intent(question: Column) -> Column:
    return (
        F.when(mentions(question, ("dup",)), "duplicates")
        .when(mentions(question, ("count",)), "count")
        .when(mentions(question, ("list", "show")), "list")
        .otherwise("unknown")
    )


def needs_data(question: Column) -> Column:
    return (intent(question) != "unknown") | mentions(question, DATA_WORDS)


def wants_list(question: Column) -> Column:
    return mentions(question, LIST_WORDS)


def _contains(question: Column, word: str) -> Column:
    return F.lower(question).contains(word.lower())


def _roles(df: DataFrame) -> dict[str, str]:
    found = {f.name: role_of(f.name, is_numeric(f.dataType)) for f in df.schema.fields}
    return {name: role for name, role in found.items() if role}


def matched_column(question: Column, df: DataFrame, counted: Sequence[str]) -> Column:
    """The column a question is about, by role word, name, or a hint at people.

    The columns come from the schema, so this is one expression per question
    row and needs no join.
    """
    roles = _roles(df)
    choices = [
        F.when(_contains(question, role) | _contains(question, name), F.lit(name))
        for name, role in roles.items()
    ]
    choices += [F.when(_contains(question, name), F.lit(name)) for name in counted]
    person = next((n for n, role in roles.items() if role in PEOPLE_ROLES), None)
    if person is not None:
        choices.append(F.when(mentions(question, PEOPLE_WORDS), F.lit(person)))
    return F.coalesce(*choices, F.lit(None).cast("string"))


def _entries(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The first five ranked entries of each key as one array; keys come from the schema."""
    ranked = F.sort_array(F.collect_list(F.struct("rank", *fields)))
    return df.groupBy(*keys).agg(ranked.alias("entries"))


def answer(questions: DataFrame, df: DataFrame, question: str = "question") -> DataFrame:
    """Each question with ``answer``, NULL when the data does not answer it.

    "Most" and "fewest" rank all values of the column a question is about, from
    the most and from the least frequent on; missing values are not ranked among
    the fewest. "Fastest" and "slowest" look at the group means of matching columns.
    """
    q = F.col(question)
    counted = [f.name for f in df.schema.fields if not is_numeric(f.dataType)]
    out = questions
    parts = []
    if counted:
        ranked = top_values(df, counted, 3).withColumn("__end", F.lit("most"))
        ranked = ranked.unionByName(bottom_values(df, counted, 3).withColumn("__end", F.lit("fewest")))
        tops = _entries(ranked, ["column", "__end"], ["label", "count"]).select(
            F.concat_ws("\n", "__end", "column").alias("__column"), F.col("entries").alias("__top")
        )
        superlative = says(q, MOST_WORDS + LEAST_WORDS)
        fewest = says(q, LEAST_WORDS)
        end = F.when(fewest, "fewest").otherwise("most")
        about = F.when(superlative, F.concat(end, F.lit("\n"), matched_column(q, df, counted)))
        # Two rows per text column of the schema.
        out = out.withColumn("__about", about).join(
            F.broadcast(tops), F.col("__about") == F.col("__column"), "left"
        )
        order = F.col("__top")
        first, rest = F.get(order, F.lit(0)), F.slice(order, 2, 2)
        # Fixed value: the wording of the answer.
        head = F.format_string(
            "%s handled the %s tickets (%d).",
            first["label"], end, first["count"],
        )
        peers = F.array_join(
            F.transform(rest, lambda e: F.format_string("%s (%d)", e["label"], e["count"])), ", "
        )
        tail = F.when(F.size(rest) > 0, F.concat(F.lit(" Next: "), peers, F.lit("."))).otherwise("")
        parts.append(F.when(F.size(order) > 0, F.concat(head, tail)))
    pairs = leaderboard_pairs(df)
    if pairs:
        boards = _entries(leaderboards(df, pairs, 5), ["group", "value", "side"], ["label", "mean"])
        boards = boards.select(
            F.concat_ws("\n", "group", "value", "side").alias("__key"), F.col("entries").alias("__board")
        )
        fast, slow = says(q, FAST_WORDS), says(q, SLOW_WORDS)
        roles = _roles(df)
        fits = []
        for group, value in pairs:
            role = roles.get(group)
            about = _contains(q, group)
            if role:
                about = about | _contains(q, role)
            if role == "resolver":
                about = about | _contains(q, "ticket")
            fits.append(F.when(about, F.lit(f"{group}\n{value}")))
        side = F.when(fast, "best").when(slow, "worst")
        key = F.concat(F.coalesce(*fits), F.lit("\n"), side)
        # One row per leaderboard and side; leaderboards come from the schema.
        out = out.withColumn("__want", key).join(
            F.broadcast(boards), F.col("__want") == F.col("__key"), "left"
        )
        first, rest = F.get("__board", F.lit(0)), F.slice("__board", 2, 2)
        value_name = F.replace(F.split("__want", "\n")[1], F.lit("_"), F.lit(" "))
        # Fixed value: the wording of the answer.
        head = F.format_string(
            "%s is the %s for %s (%.2f).",
            first["label"], F.when(fast, "fastest").otherwise("slowest"), value_name, first["mean"],
        )
        peers = F.array_join(
            F.transform(rest, lambda e: F.format_string("%s (%.2f)", e["label"], e["mean"])), ", "
        )
        tail = F.when(F.size(rest) > 0, F.concat(F.lit(" Next: "), peers, F.lit("."))).otherwise("")
        parts.append(F.when(F.size("__board") > 0, F.concat(head, tail)))
    answered = F.coalesce(*parts) if parts else F.lit(None).cast("string")
    return out.select(*questions.columns, answered.alias("answer"))
