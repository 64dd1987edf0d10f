"""Line dedup by overlapping three-line windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, lookup, row_key, written


def _windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key, hash, p0, p1, p2: every run of three lines that aren't blank, with their positions."""
    lines = F.filter(
        F.transform(F.split(F.col(text_col), "\n", -1), lambda x, i: F.struct(i.alias("p"), F.trim(x).alias("line"))),
        lambda x: x["line"] != "",
    )
    at = lambda i, k: F.get(F.col("lines"), i + k)
    windows = F.transform(
        F.sequence(F.lit(0), F.size("lines") - 3),
        lambda i: F.struct(
            F.xxhash64(at(i, 0)["line"], at(i, 1)["line"], at(i, 2)["line"]).alias("hash"),
            *[at(i, k)["p"].alias(f"p{k}") for k in range(3)],
        ),
    )
    return (
        docs.where(F.instr(F.col(text_col), "\n") > 0)
        .select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), lines.alias("lines"))
        .where(F.size("lines") >= 3)
        .select("doc_id", "key", F.explode(windows).alias("w"))
        .select("doc_id", "key", "w.*")
    )


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, covered: positions of the lines that later occurrences of repeated windows cover, merged.

    The first occurrence of a window is the one with the least (doc_id, key,
    position). Its search combines before the shuffle, so a boilerplate window of
    a billion copies is no hot key there; in the join that follows, adaptive
    execution splits it.
    """
    windows = _windows(docs, id_col, text_col)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "p0")
    first = windows.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("hash", "first")
    later = windows.join(first, "hash").where(place > F.col("first"))
    return later.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list(F.array("p0", "p1", "p2")))).alias("covered"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False) -> DataFrame:
    """Takes out the lines of every later occurrence of a repeated window of three lines.

    Lines are compared without surrounding spaces; blank lines are no part of
    windows and stay. Returns the columns of docs with the text shortened, and
    n_removed (under another name where docs has one).

    - A null or empty text, or one of fewer than three lines, stays as it is.
    - Where windows overlap, the covered positions are merged: each line goes once.
    - Rows that repeat an id with the same text are one document, and are
      shortened alike; equal texts under two ids are two documents, of which the
      one with the lesser id keeps its lines.
    - A null id comes after all others. Windows are compared, and documents told
      apart, by 64-bit hashes.
    - A document whose every line goes keeps an empty text, or with
      drop_emptied goes itself. An empty table gives an empty table.
    """
    key, cov, removed = (fresh(docs.columns, n) for n in ("__key", "__covered", "n_removed"))
    covered = written(covered_lines(docs, id_col, text_col).select(F.col("key").alias(key), F.col("covered").alias(cov)), "covered")
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(cov))
    text = F.when(F.col(cov).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    out = docs.withColumn(key, row_key(id_col, text_col)).join(lookup(covered, broadcast=False), key, "left")
    out = out.select(*[(text.alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns], F.coalesce(F.size(cov), F.lit(0)).alias(removed))
    return out.where((F.col(removed) == 0) | (F.trim(F.regexp_replace(text_col, "\n", "")) != "")) if drop_emptied else out
