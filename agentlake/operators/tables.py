"""Keyed tables without a merge statement: upserts, replacement, deletion, differences, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .numbering import numbered


def upsert(base: DataFrame, updates: DataFrame, key: tuple[str, ...], keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Rows of ``updates`` win by key, but ``keep`` columns stay as they were."""
    names = base.columns
    old = base.select(*key, *(F.col(c).alias(f"old_{c}") for c in names if c not in key), F.lit(True).alias("was"))
    new = updates.select(*key, *(F.col(c).alias(f"new_{c}") for c in names if c not in key), F.lit(True).alias("is"))
    both = old.join(new, list(key), "full")
    pick = lambda c: F.when(F.col("is") & ~(F.col("was").isNotNull() & F.lit(c in keep)), F.col(f"new_{c}")).otherwise(F.col(f"old_{c}"))
    return both.select(*(F.col(c) if c in key else pick(c).alias(c) for c in names))


def replaced(base: DataFrame, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """All rows of the keys in ``new`` give way to its rows."""
    return base.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def deleted(base: DataFrame, keys: DataFrame, key: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """What stays, and how many rows of each key go."""
    gone = base.join(keys, list(key), "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("rows"))
    return base.join(keys, list(key), "left_anti"), gone


def upsert_vectors(base: DataFrame, new: DataFrame, dim: int) -> DataFrame:
    """By chunk_id; a vector of another length is an error."""
    right = F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.lit(f"vector length is not {dim}")))
    return base.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new.withColumn("embedding", right))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """added, deleted, modified or unchanged of each key, by hash."""
    both = before.select("key", F.col("hash").alias("b")).join(after.select("key", F.col("hash").alias("a")), "key", "full")
    return both.select("key", F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "deleted").when(F.col("a") == F.col("b"), "unchanged").otherwise("modified").alias("change"))


def manifest_diff(snapshots: DataFrame) -> DataFrame:
    """Changes between the snapshots of a session that follow each other: session, version, path, change.

    A path's row is compared with its own row in the version before, so paths meet by one window and one join of
    (session, version) pairs, not by joining whole snapshots.
    """
    versions = snapshots.select("session", "version").distinct().withColumn("next", F.lead("version").over(Window.partitionBy("session").orderBy("version")))
    own = Window.partitionBy("session", "path").orderBy("version")
    rows = snapshots.join(versions, ["session", "version"]).withColumns({"before": F.lag("hash").over(own), "seen": F.lag("next").over(own), "follow": F.lead("version").over(own)})
    first = F.min("version").over(Window.partitionBy("session"))
    present = rows.withColumn("first", first).where("version > first").select("session", "version", "path", F.when(~F.col("seen").eqNullSafe(F.col("version")), "added").when(F.col("before") == F.col("hash"), "unchanged").otherwise("modified").alias("change"))
    gone = rows.where(F.col("next").isNotNull() & ~F.col("follow").eqNullSafe(F.col("next"))).select("session", F.col("next").alias("version"), "path", F.lit("deleted").alias("change"))
    return present.unionByName(gone)


def latest_by(df: DataFrame, key: tuple[str, ...], *order: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*(F.col(o).desc() for o in order))
    return df.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def assign_idx(new: DataFrame, base: DataFrame, key: str, *order: str) -> DataFrame:
    """New rows numbered on from their key's count."""
    counts = base.groupBy(key).agg(F.count(F.lit(1)).alias("had"))
    w = Window.partitionBy(key).orderBy(*order)
    return new.join(counts, key, "left").withColumn("idx", F.coalesce("had", F.lit(0)) + F.row_number().over(w) - 1).drop("had")


def dedupe_files(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Files of a user whose content is there already reuse that id; of equal new ones the first id stays."""
    w = Window.partitionBy("user_id", "sha256")
    first = new.withColumn("first", F.min("file_id").over(w))
    known = existing.groupBy("user_id", "sha256").agg(F.min("file_id").alias("known"))
    return first.join(known, ["user_id", "sha256"], "left").select("user_id", "file_id", F.coalesce("known", "first").alias("uses"))


def completeness(chunks: DataFrame, docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per document: chunks, vectors, expected; complete if all agree."""
    counts = chunks.groupBy("doc_key").agg(F.count(F.lit(1)).alias("chunks")).join(vectors.groupBy("doc_key").agg(F.count(F.lit(1)).alias("vectors")), "doc_key", "full")
    out = docs.select("doc_key", "expected").join(counts, "doc_key", "full").fillna(0, ["chunks", "vectors", "expected"])
    return out.withColumn("complete", (F.col("chunks") == F.col("expected")) & (F.col("vectors") == F.col("expected")))


def newest(df: DataFrame, n: int, *order: str) -> DataFrame:
    """A listing, so the limit is the feature."""
    return df.orderBy(*(F.col(o).desc() for o in order)).limit(n)


def table_blocks(df: DataFrame, order: str, rows_per_block: int = 20, head_columns: int = 20) -> DataFrame:
    """A delimited table as text blocks of ``rows_per_block`` rows in the order of any column (ties by their text).

    Block 0 tells the first columns and the row count, the others hold ``col: val`` lines.  Rows without a value do not count; a
    row of nothing but blank marks counts and gives no line, and a block of such rows is left out.  ``order`` itself is not shown.
    """
    names = [c for c in df.columns if c != order]
    value = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    shown = lambda c: F.when(~F.trim(value(c)).isin("", "?", "None", "nan"), F.concat(F.lit(f"{c}: "), value(c)))
    filled = df.where(F.concat(*(F.trim(value(c)) for c in names)) != "")
    lines = numbered(filled.select(F.col(f"`{order}`").alias("key"), F.concat_ws("; ", *map(shown, names)).alias("line")), ["key", "line"])
    placed = lines.where("line <> ''").withColumn("block", F.floor(F.col("position") / rows_per_block) + 1)
    body = placed.groupBy("block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n").alias("text"))
    head = filled.agg(F.concat(F.lit(f"columns({len(names)}): {', '.join(names[:head_columns])}; rows: "), F.count(F.lit(1)).cast("string")).alias("text")).select(F.lit(0).cast("long").alias("block"), "text")
    return head.unionByName(body.select(F.col("block").cast("long").alias("block"), "text"))


def first_users(users: DataFrame, limit: int = 200) -> DataFrame:
    """The user list: the first by id; a listing, so the limit is the feature."""
    return users.orderBy("user_id").limit(limit)
