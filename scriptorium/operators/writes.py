"""Keyed writes as rewrites of DataFrames: upserts, inserts that ignore conflicts, updates, deletes, validation and row security."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def upsert(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """target with the rows of changes in place of its own; changes hold one row for each key."""
    return target.join(changes.select(*keys), keys, "left_anti").select(target.columns).unionByName(changes.select(target.columns))


def stamped(df: DataFrame, at: Column, column: str = "updated_at") -> DataFrame:
    """df with the time at which its rows were written; the clock is an argument, so that a run can be repeated."""
    return df.withColumn(column, at)


def coalesce_update(target: DataFrame, changes: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """target with the columns of changes (one row for each key) where those are not null; all other values stay."""
    fresh = changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    held = target.join(fresh, keys, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns})
    return held.select(target.columns)


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The rows that an insert would add: the first of each key that target lacks."""
    return latest(rows, keys, *order).join(target.select(*keys), keys, "left_anti")


def keyed_update(df: DataFrame, condition: Column, **values) -> DataFrame:
    return df.withColumns({c: F.when(condition, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def delete_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.where(~F.coalesce(F.col(column).startswith(prefix), F.lit(False)))


def cascade_delete(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """The children that still have a parent."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_semi")


def set_null_delete(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """All children; those without a parent lose their key."""
    known = parents.select(F.col(parent_key).alias(child_key)).distinct().withColumn("_known", F.lit(True))
    return children.join(known, child_key, "left").withColumn(child_key, F.when(F.col("_known"), F.col(child_key))).drop("_known")


def checked(df: DataFrame, **rules: Column) -> DataFrame:
    """df with violations: the names of the rules that a row breaks; a rule that is null is kept, as in SQL."""
    broken = [F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


def validated(df: DataFrame, **rules: Column) -> DataFrame:
    """df with errors: the names of the rules that a row does not meet; what is null meets none."""
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])))


def feedback(rows: DataFrame, length: int = 500) -> tuple[DataFrame, DataFrame]:
    """The rows (consulta_id, util as text, comentario) to insert, and those that are refused, with the first reason."""
    reason = F.when(~T.is_uuid4(F.col("consulta_id")), "bad_id").when(~F.coalesce(F.col("util").isin("true", "false"), F.lit(False)), "bad_flag")
    held = rows.withColumn("reason", reason)
    taken = held.where("reason is null").withColumns({"util": F.col("util") == "true", "comentario": F.substring(T.trimmed(F.col("comentario")), 1, length)})
    return taken.drop("reason"), held.where("reason is not null")


def approved_orders(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a provider's messages (status, order_id, organization_id, tier), the tiers to upsert and the orders to insert."""
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    held = messages.where(F.col("status").eqNullSafe(F.lit("approved")) & some("organization_id"))
    tiers = held.where(some("tier")).select(F.col("organization_id").alias("id"), F.col("tier").alias("billing_tier"))
    orders = held.where(some("order_id")).select(
        "order_id", "organization_id", F.coalesce("tier", F.lit("pro")).alias("tier"), F.lit(0).alias("amount"), F.lit("HNL").alias("currency"), F.lit("approved").alias("status")
    )
    return tiers, orders


def visible(df: DataFrame, role: str, user: str | None = None, owner: str = "user_identifier") -> DataFrame:
    """The rows that a role may see: all for the service, a user's own, none for others."""
    if role == "service_role":
        return df
    if role == "authenticated" and user is not None:
        return df.where(F.col(owner) == user)
    return df.where(F.lit(False))


def append(df: DataFrame, path: str, mode: str = "append", kind: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).format(kind).save(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
