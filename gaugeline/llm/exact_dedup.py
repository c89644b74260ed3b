"""Exact dedup: group by a 128-bit content hash, compare bytes inside the groups, keep the smallest id.

Two texts are equal when they are identical after each run of white space
(0x20, 0x09-0x0D) has become one space. Defined results for odd input: a null text
counts as empty; a group whose ids are all null has a null keep_id; null ids never
stay where another id exists. Rows that repeat both id and text are one document:
`mark` gives them the same verdict and `deduplicate` returns one of them. An empty
table gives an empty table. Extra columns pass through, and internal columns take
names that the table does not have; output columns replace columns of their name.

Everything is DataFrame functions. A group meets in one task only as one partial row
per map task (smallest id, count, smallest and largest text), so copies that are a third
of all rows are as cheap as others; the join back to the rows is one row per group
against the rows, which AQE splits where a group is hot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import fresh
from gaugeline.operators.staging import stage


def normalised(text: Column) -> Column:
    """Each run of white space as one space; single spaces are not touched, which saves most of the work."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def content_hash(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def _mark(docs: DataFrame, text: str, id_col: str, hash_of: Callable[[Column], Column]) -> tuple[DataFrame, list[str]]:
    """The marked rows, and the columns that name a group."""
    docs = docs.drop("keep_id", "group_size", "kept")
    norm, key, lo, hi = (fresh(docs, f"_dd_{x}") for x in ("norm", "hash", "lo", "hi"))
    rows = docs.withColumn(norm, normalised(F.col(text))).withColumn(key, hash_of(F.col(norm)))
    counts = (F.min(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = stage(
        rows.groupBy(key).agg(*counts, F.min(norm).alias(lo), F.max(norm).alias(hi)).select(key, "keep_id", "group_size", (F.col(lo) == F.col(hi)).alias(lo)),
        "hash-groups",
    )
    same, mixed = groups.filter(lo).drop(lo), groups.filter(~F.col(lo)).select(key)
    kept = F.col(id_col).eqNullSafe(F.col("keep_id"))
    if mixed.isEmpty():
        return rows.drop(norm).join(same, key).withColumn("kept", kept), [key]
    # hashes that several texts share: the text itself is the key there
    shared = rows.join(mixed, key, "left_semi")
    split = shared.join(shared.groupBy(key, norm).agg(*counts), [key, norm])
    out = rows.join(same, key).select(*rows.columns, "keep_id", "group_size").unionByName(split.select(*rows.columns, "keep_id", "group_size"))
    return out.withColumn("kept", kept), [key, norm]


def mark(docs: DataFrame, text: str = "text", id_col: str = "doc_id", hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """All rows and columns, with keep_id, group_size and kept."""
    out, _ = _mark(docs, text, id_col, hash_of)
    return out.select(*(c for c in docs.columns if c not in ("keep_id", "group_size", "kept")), "keep_id", "group_size", "kept")


def deduplicate(docs: DataFrame, text: str = "text", id_col: str = "doc_id", hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row of each group of equal texts, with the columns of docs but for any named as mark's own."""
    out, group = _mark(docs, text, id_col, hash_of)
    return out.filter("kept").dropDuplicates(group).select(*(c for c in docs.columns if c in out.columns and c not in ("keep_id", "group_size", "kept")))
