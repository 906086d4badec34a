"""Line dedup: repeated runs of lines, found in a suffix array over line ids by prefix doubling.

Only lines that occur more than once can be part of a repeated run, so documents are first reduced to
stretches of neighbouring repeated lines, and equal stretches (those of copied documents) to the first of
them. The suffixes of the stretches that are left are named by prefix doubling: a round sorts the distinct
pairs of names (of a suffix, and of the suffix 2^k lines on) over the cluster and numbers them in order,
so after k rounds the names are the suffix array's ranks by the first 2^k lines, and equal names are the
intervals whose longest common prefix is that long.

A run counts when it holds ``min_words`` words. Whether a line lies in such a repeated run is decided by
the shortest such runs that start at each line and that end at it, so no prefix longer than
``min_words`` lines is ever compared and log2(min_words) rounds do. A depth between two powers of two is
the pair of names of its first and its last 2^k lines; the suffixes that share it are one interval, of which
the first occurrence stays and the lines of all others are deleted.

No step gathers a line's or a run's occurrences: intervals are summed up map-side to their first
occurrence, which is joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.llm.words import SPACES, set_aside
from feedloom.session import materialize


def _numbered(df: DataFrame, keys: list, name: str) -> DataFrame:
    """Distinct keys with numbers that follow their order over the whole cluster, stored."""
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(ordered.withColumn(name, F.monotonically_increasing_id()), "names")


def _lines(docs: DataFrame, id: str, text: str) -> DataFrame:
    """One row per line that holds a word: _id, _text_hash, line (its number), seq (among these lines), hashes, words.

    Documents are told apart by id and text, so a row that repeats counts as one document.
    """
    whole = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    whole = whole.withColumn("_text_hash", F.xxhash64("_text"))  # before the split, else each line hashes the whole text
    split = whole.select("_id", "_text_hash", F.posexplode(F.split("_text", "\n")).alias("line", "_line"))
    words = F.size(F.split(F.regexp_replace("_line", rf"^{SPACES}|{SPACES}$", ""), SPACES))
    full = split.filter(F.col("_line").rlike(r"[^\x20\x09-\x0D]"))
    return full.select("_id", "_text_hash", "line", F.xxhash64("_line").alias("h1"), F.hash("_line").alias("h2"), words.alias("words"))


def _stretches(lines: DataFrame) -> DataFrame:
    """Runs of neighbouring repeated lines: _id, _text_hash, start, at (array of line, h1, h2, words)."""
    repeated = materialize(
        lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("h1").alias("r1"), F.col("h2").alias("r2")),
        "repeated-lines",
    )
    kept = lines.join(repeated, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2"))).drop("r1", "r2")
    by_document = kept.groupBy("_id", "_text_hash").agg(
        F.sort_array(F.collect_set(F.struct("seq", "line", "h1", "h2", "words"))).alias("at")
    )
    by_line = by_document.select("_id", "_text_hash", F.posexplode("at").alias("_i", "a")).withColumn("_run", F.col("a.seq") - F.col("_i"))
    return by_line.groupBy("_id", "_text_hash", "_run").agg(F.sort_array(F.collect_list("a")).alias("at"))


def _doubled(stretches: DataFrame, levels: int) -> DataFrame:
    """Add ``names0`` to ``names<levels>``: by place, the suffix's rank by its first 2^k lines.

    Beyond the end of a stretch no line is repeated, so nothing is shared there; the end ranks first.
    """
    first = stretches.select("sid", F.posexplode("at").alias("off", "a")).select("sid", "off", F.col("a.h1").alias("x"), F.col("a.h2").cast("long").alias("y"))
    for k in range(levels + 1):
        names = _numbered(first.select("x", "y").distinct().withColumnsRenamed({"x": "nx", "y": "ny"}), ["nx", "ny"], "name")
        named = first.join(names, (F.col("x") == F.col("nx")) & (F.col("y") == F.col("ny")))
        arrays = named.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("off", "name"))).alias("_n"))
        arrays = arrays.select("sid", F.transform("_n", lambda n: n["name"]).alias(f"names{k}"))
        stretches = materialize(stretches.join(arrays, "sid"), "stretches")
        ahead = F.slice(f"names{k}", F.lit(2**k + 1), F.size(f"names{k}"))
        pairs = F.arrays_zip(F.col(f"names{k}").alias("x"), ahead.alias("y"))
        first = stretches.select("sid", F.posexplode(pairs).alias("off", "p")).select("sid", "off", "p.x", F.coalesce("p.y", F.lit(-1)).alias("y"))
    return stretches


def _heavy_runs(stretches: DataFrame, levels: int, min_words: int) -> DataFrame:
    """The shortest runs of ``min_words`` words from each line on, and up to each line: sid, off, size, a, b."""

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for row in frame.itertuples(index=False):
                words = np.asarray(row.words, np.int64)
                names = [np.asarray(getattr(row, f"names{k}")) for k in range(levels + 1)]
                sums = np.concatenate(([0], np.cumsum(words)))
                start = np.arange(len(words))
                end = np.searchsorted(sums, sums[:-1] + min_words)  # from each line on
                begin = np.searchsorted(sums, sums[1:] - min_words, side="right") - 1  # up to each line
                on, upto = end <= len(words), begin >= 0
                off = np.concatenate((start[on], begin[upto]))
                size = np.concatenate(((end - start)[on], (start + 1 - begin)[upto]))
                off, size = np.unique(np.stack([off, size]), axis=1)
                level = np.frexp(size)[1] - 1
                a, b = np.empty(len(off), np.int64), np.empty(len(off), np.int64)
                for k in np.unique(level):
                    at = level == k
                    a[at], b[at] = names[k][off[at]], names[k][off[at] + size[at] - 2**k]
                made.append(pd.DataFrame({"sid": row.sid, "off": off, "size": size, "a": a, "b": b}))
            if made:
                yield pd.concat(made, ignore_index=True)

    narrow = stretches.select("sid", F.transform("at", lambda a: a["words"]).alias("words"), *(f"names{k}" for k in range(levels + 1)))
    return narrow.mapInPandas(runs, "sid long, off long, size long, a long, b long")


def repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """Lines to delete: _id, _text_hash, lines (sorted numbers of lines, from 0).

    A line goes when it lies in a run of at least ``min_words`` words that equals a run which starts
    earlier, by id (nulls last), then by a hash of the text, then by line. Lines without a word are
    passed over: they neither break a run nor go.
    """
    lines = _lines(docs, id, text)
    order = Window.partitionBy("_id", "_text_hash").orderBy("line")
    lines = materialize(lines.withColumn("seq", F.dense_rank().over(order)), "lines")
    stretches = _stretches(lines)
    content = F.transform("at", lambda a: F.struct(a["h1"], a["h2"]))
    total = F.aggregate("at", F.lit(0).cast("long"), lambda s, a: s + a["words"])
    stretches = stretches.select("*", F.xxhash64(content).alias("c1"), F.hash(content).alias("c2"), F.size("at").alias("n"), total.alias("total"))
    stretches = materialize(stretches.filter(F.col("total") >= min_words), "stretches")  # a lighter one holds no run that counts

    place = F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_text_hash", "_run")
    classes = materialize(stretches.groupBy("c1", "c2", "n").agg(F.min(place).alias("first")), "stretch-classes")
    classes = classes.withColumnsRenamed({"c1": "k1", "c2": "k2", "n": "kn"})
    same = (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2")) & (F.col("n") == F.col("kn"))
    marked = materialize(stretches.join(classes, same).withColumn("is_first", place == F.col("first")).select(*stretches.columns, "is_first"), "marked")
    copies = marked.filter(~F.col("is_first")).select("_id", "_text_hash", F.transform("at", lambda a: a["line"]).alias("lines"))

    firsts = marked.filter("is_first").select("_id", "_text_hash", "_run", "at").withColumn("no_id", F.col("_id").isNull())
    firsts = _numbered(firsts, ["no_id", "_id", "_text_hash", "_run"], "sid").drop("no_id")
    levels = max(min_words, 1).bit_length() - 1
    ranked = _doubled(firsts, levels)
    runs = materialize(_heavy_runs(ranked, levels, min_words), "runs")
    start = F.struct("sid", "off")
    intervals = runs.groupBy("size", "a", "b").agg(F.min(start).alias("first"), F.count("*").alias("times")).filter("times > 1")
    intervals = materialize(intervals, "intervals").withColumnsRenamed({"size": "ks", "a": "ka", "b": "kb"})
    same = (F.col("size") == F.col("ks")) & (F.col("a") == F.col("ka")) & (F.col("b") == F.col("kb"))
    later = runs.join(intervals, same).filter(start != F.col("first")).select("sid", "off", (F.col("off") + F.col("size")).alias("end"))
    earlier = Window.partitionBy("sid").orderBy("off", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = later.withColumn("from", F.greatest("off", F.max("end").over(earlier))).filter("from < end")  # each line once
    covered = fresh.select("sid", F.explode(F.sequence("from", F.col("end") - 1)).alias("off")).groupBy("sid").agg(F.collect_list("off").alias("offs"))
    line_at = F.transform("offs", lambda i: F.get("at", i.cast("int"))["line"])
    later = ranked.join(covered, "sid").select("_id", "_text_hash", line_at.alias("lines"))
    return copies.union(later).groupBy("_id", "_text_hash").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"))


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """``docs`` with the later copies of repeated line runs cut out of ``text``, and n_lines, n_removed.

    n_lines counts the lines of the text as it was. See ``repeated_lines`` for what goes; a run that
    overlaps its own earlier copy (a line repeated many times) goes too. Null texts stay null and have no
    lines, empty texts have one; a text may become empty. Rows that repeat in id and text are one
    document: each gets the same result. An empty table gives an empty result; columns called n_lines
    or n_removed are replaced.
    """
    docs, back, (id, text) = set_aside(docs, id, text)
    gone = materialize(repeated_lines(docs, id, text, min_words), "line-deletions").withColumnsRenamed({"_id": "_gone_id", "_text_hash": "_gone_hash", "lines": "_gone"})
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(*kept, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_text_hash"))
    # a join by shuffle at every size: the deletions grow with the texts
    joined = keyed.join(gone.hint("merge"), F.col(id).eqNullSafe(F.col("_gone_id")) & (F.col("_text_hash") == F.col("_gone_hash")), "left")
    joined = joined.withColumn("_lines", F.split(text, "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    cut = F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")
    return joined.select(
        *(F.when(F.col("_gone").isNull(), F.col(c)).otherwise(cut).alias(c) if c == text else F.col(c) for c in kept),
        F.when(F.col(text).isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
    ).withColumnsRenamed(back)
