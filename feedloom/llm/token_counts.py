"""Token counts from flat token files that have no index, by a scan for end-of-document ids.

A token file is nothing but ids of fixed width, each document followed by an end-of-document id. Files are
cut into blocks of equal size, wherever that falls; each block is read once and its separators are found
in numpy. What a block knows of itself (its separators, the ids before the first and after the last)
is a row; a running sum over a file's rows, the prefix scan, tells every block how many documents ended
before it and how many ids of an unfinished document it takes over, which stitches the documents that
cross blocks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.window import Window

from feedloom.llm.hash_arrays import new_file, read_range
from feedloom.session import materialize, scratch_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that cuts texts before byte pairs are merged; it belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_DOCUMENT = 50256
BLOCK_TOKENS = 8_000_000


@lru_cache(maxsize=2)
def encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_token_files(
    docs: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end: int = END_OF_DOCUMENT
) -> tuple[str, DataFrame]:
    """Encode texts into one flat file per partition; returns their folder and who is where: id, file, ordinal.

    Ids are little-endian, of two bytes where ``end`` and the vocabulary fit, else four. Null and empty texts
    are an end only. ``vocabulary`` must be readable under that path by every executor.
    """
    folder = scratch_path(docs.sparkSession, "tokens")
    kind = docs.schema[id].dataType
    width = "<u2" if max(end, encoding(vocabulary).max_token_value) < 1 << 16 else "<u4"

    def write(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ordinal = encoding(vocabulary).encode_ordinary, 0
        name = f"part-{TaskContext.get().partitionId():05d}.{width[1:]}"
        with new_file(folder, name) as out:
            for frame in frames:
                for value in frame.column(1):
                    out.write(np.array([*encode(value.as_py() or ""), end], width).tobytes())
                n = frame.num_rows
                places = pa.array(np.arange(ordinal, ordinal + n))
                yield pa.RecordBatch.from_arrays([frame.column(0), pa.array([name] * n), places], ["id", "file", "ordinal"])
                ordinal += n

    schema = StructType().add("id", kind).add("file", StringType()).add("ordinal", LongType())
    return folder, materialize(docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(write, schema), "token-files")


def scan_token_files(
    spark: SparkSession, folder: str, end: int = END_OF_DOCUMENT, width: int = 2, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """One row per document in the files of a folder: file, ordinal, start (in tokens), n_tokens, ended.

    n_tokens does not count the end itself. Tokens after a file's last end are a document that has not
    ended. Files that are empty have no documents; a size that is no multiple of ``width`` is an error.
    """
    files = spark.read.format("binaryFile").load(folder).select(F.col("path").alias("uri"), "length")
    files = files.withColumn("file", F.element_at(F.split("uri", "/"), -1)).filter("length > 0")
    last = F.floor((F.col("length") - 1) / (block_tokens * width))
    blocks = files.select("uri", "file", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    blocks = blocks.repartition("uri", "block")
    kind = f"<u{width}"

    def scan(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for row in frame.to_pylist():
                if row["length"] % width:
                    raise ValueError(f"{row['uri']}: {row['length']} bytes are no whole number of ids")
                data = read_range(row["uri"], row["block"] * block_tokens * width, block_tokens * width)
                ids = np.frombuffer(data, kind)
                ends = np.flatnonzero(ids == end)
                sizes = np.diff(ends, prepend=-1) - 1
                tail = len(ids) - 1 - (ends[-1] if len(ends) else -1)
                yield pa.RecordBatch.from_pylist([
                    {"file": row["file"], "block": row["block"], "size": len(ids), "tail": int(tail), "sizes": sizes.tolist()}
                ], schema=out)

    out = pa.schema([("file", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("tail", pa.int64()), ("sizes", pa.list_(pa.int64()))])
    found = materialize(blocks.mapInArrow(scan, "file string, block long, size long, tail long, sizes array<long>"), "token-blocks")

    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per_file = Window.partitionBy("file")
    rows = found.select("file", "block", "size", "tail", F.size("sizes").alias("n"))
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    rows = rows.withColumn("ordinal", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    ended = F.last(F.when(F.col("n") > 0, F.col("before") + F.col("size") - F.col("tail")), ignorenulls=True).over(ahead)
    rows = rows.withColumn("carry", F.col("before") - F.coalesce(ended, F.lit(0)))
    rows = rows.withColumn("is_last", F.col("block") == F.max("block").over(per_file))
    stitched = found.select("file", "block", "sizes").join(rows, ["file", "block"])
    whole = stitched.select("*", F.posexplode("sizes").alias("i", "own"))
    sums = Window.partitionBy("file", "block").orderBy("i")
    whole = whole.withColumn("n_tokens", F.col("own") + F.when(F.col("i") == 0, F.col("carry")).otherwise(0))
    whole = whole.withColumn("start", F.col("before") - F.col("carry") + F.sum(F.col("n_tokens") + 1).over(sums) - F.col("n_tokens") - 1)
    whole = whole.select("file", (F.col("ordinal") + F.col("i")).alias("ordinal"), "start", "n_tokens", F.lit(True).alias("ended"))
    rest = F.when(F.col("n") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("size"))
    open_ = rows.filter(F.col("is_last") & (rest > 0)).select(
        "file", (F.col("ordinal") + F.col("n")).alias("ordinal"), (F.col("before") + F.col("size") - rest).alias("start"),
        rest.alias("n_tokens"), F.lit(False).alias("ended"),
    )
    return whole.union(open_)


def token_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per row of ``docs``: its id and n_tokens, counted by scanning the token files written from it.

    Null and empty texts have 0 tokens, null ids stay null, rows that repeat are counted each, an empty
    table gives an empty result. Columns other than the two named are not looked at.
    """
    folder, places = write_token_files(docs, id, text, vocabulary)
    width = 2 if max(END_OF_DOCUMENT, encoding(vocabulary).max_token_value) < 1 << 16 else 4
    if not places.take(1):
        return places.select(F.col("id").alias(id), F.col("ordinal").alias("n_tokens"))
    counts = scan_token_files(docs.sparkSession, folder, END_OF_DOCUMENT, width, block_tokens)
    return places.join(counts, ["file", "ordinal"]).select(F.col("id").alias(id), "n_tokens")
