"""Exact dedup by progressive refinement: length, then a prefix hash, then the full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import ascii_lower, by_ids, cut_lineage, keyed_texts, small

PREFIX_CHARS = 64


def _length(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit("")))


def _prefix_hash(text: Column) -> Column:
    return F.xxhash64(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, PREFIX_CHARS)))


def _digest(text: Column) -> Column:
    return F.sha2(F.encode(ascii_lower(F.coalesce(text, F.lit(""))), "utf-8"), 256)


def _several(rows: DataFrame, *keys: str) -> DataFrame:
    """The values of ``keys`` that two or more rows have; counted before anything moves."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row, dropped ones too.

    Texts are equal when identical after lower-casing A-Z only (a null text equals an empty one); the row
    with the largest doc_id of a group stays. The digest is part of every row's result, so the scan that
    measures a text also digests it: one pass over the texts, and no text is shuffled. Each step then regroups
    only what the step before left in groups of two or more: rows by byte length, survivors by (length, hash of
    the first characters), their survivors by the full digest. The groups are counts and maxima, combined before
    the shuffle, so a group that holds a third of all rows is a single row at every step; what a step lets through
    is counted and meets the rows by broadcast if it is small, else in an equi-join on a unique right side, which
    adaptive execution splits where a key is hot. Repeated rows with one doc_id are members of one group and all of
    them count as kept if that doc_id stays. An empty table gives an empty result.
    """
    text = F.col("text")
    sketch = keyed_texts(docs).select("doc_id", _length(text).alias("n_bytes"), _prefix_hash(text).alias("prefix_hash"), _digest(text).alias("text_sha256"))
    rows = cut_lineage(sketch)
    same_length = by_ids(rows, _several(rows, "n_bytes"), "n_bytes", "left_semi")
    same_prefix = by_ids(same_length, _several(same_length, "n_bytes", "prefix_hash"), ["n_bytes", "prefix_hash"], "left_semi")
    groups = same_prefix.groupBy("n_bytes", "prefix_hash", "text_sha256").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("text_sha256", "top", "n")
    keep = F.coalesce("top", "doc_id")
    return rows.join(small(groups), "text_sha256", "left").select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (F.col("doc_id") == keep).alias("kept"), "text_sha256")


def keep_last_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts of ``docs(doc_id, text, ...)``, all columns: the one with the largest doc_id.

    Here no digest is asked for, so only rows that share length and prefix with another are read whole and digested.
    Rows are told apart by their own text, so of rows that share a doc_id only the copies go. A null text equals an
    empty one; a null doc_id is smaller than any other; of rows equal in both doc_id and text one stays, which one is
    not defined. An empty table gives an empty result.
    """
    text, names = F.col("text"), docs.columns
    n, p, d, met, top, times = _free(names, "n", "p", "d", "met", "top", "times")
    sketch = cut_lineage(docs.select(_length(text).alias(n), _prefix_hash(text).alias(p)))
    lengths = by_ids(sketch, _several(sketch, n), n, "left_semi")
    suspects = small(_several(lengths, n, p))
    measured = docs.withColumns({n: _length(text), p: _prefix_hash(text)})
    digests = measured.join(suspects, [n, p], "left_semi").select("doc_id", _digest(text).alias(d))
    by_id = digests.groupBy(d, "doc_id").agg(F.count(F.lit(1)).alias(times))
    last = by_id.groupBy(d).agg(F.max(F.struct("doc_id", times)).alias("last"), F.sum(times).alias("all")).filter(F.col("all") > 1)
    groups = small(last.select(d, F.col("last.doc_id").alias(top), F.col(f"last.{times}").alias(times)))
    marked = measured.join(suspects.withColumn(met, F.lit(True)), [n, p], "left")
    joined = marked.withColumn(d, F.when(F.col(met), _digest(text))).join(groups, d, "left")
    is_last = F.col("doc_id").eqNullSafe(F.col(top))
    once = joined.filter(F.col(times).isNull() | is_last & (F.col(times) == 1)).select(*names)
    if groups.filter(F.col(times) > 1).isEmpty():
        return once
    return once.unionByName(joined.filter(is_last & (F.col(times) > 1)).dropDuplicates([d]).select(*names))


def _free(taken: list[str], *names: str) -> list[str]:
    """Column names that ``taken`` does not hold."""
    out = []
    for name in names:
        name = f"_{name}"
        while name in taken:
            name += "_"
        out.append(name)
    return out
