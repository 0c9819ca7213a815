"""Steps over whole tables that keep little on disk: ids as bytes, hashes before rows, shuffles that end with their step.

A hash only ever picks rows to look at again; what is returned is settled on the ids themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .traverse import cut

FEW = 1 << 21
"""Rows of a stored table of one short value that is broadcast; beyond that the join is by shuffle."""
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back; the shuffles that it took are removed once it is written."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return cut(df, compression="zstd", **{"parquet.dictionary.page.size": str(8 << 20)})
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def packed(col: Column) -> Column:
    """An id as bytes, without loss: 32 hex digits at its end as 16 bytes and then what stands before them, any other as it is."""
    head = F.encode(F.substring(col, F.lit(1), F.length(col) - 32), "utf-8")
    plain = F.concat(F.encode(col, "utf-8"), F.lit(b"\0"))
    short = F.concat(F.unhex(F.right(col, F.lit(32))), head, F.lit(b"\1"))
    return F.when((F.length(col) >= 32) & (F.lower(col) == col), F.coalesce(short, plain)).otherwise(plain)


def few(stored: DataFrame) -> DataFrame | None:
    """A stored table marked for broadcast if it has no more than FEW rows; None if it has none."""
    n = stored.count()
    return None if not n else F.broadcast(stored) if n <= FEW else stored


def values(ids: DataFrame) -> DataFrame | None:
    """The ids of a table as values to look up."""
    return few(settle(ids.where("id is not null").select(packed(F.col("id")).alias("packed_id"))))


def strays(df: DataFrame, column: str, ids: DataFrame) -> DataFrame | None:
    """The values of a column, null too, that aren't among ids."""
    used = df.select(packed(F.col(column)).alias("packed_id")).distinct()
    return few(settle(used.join(ids.select(packed(F.col("id")).alias("packed_id")), "packed_id", "left_anti")))


def within(df: DataFrame, column: str, found: DataFrame | None, how: str = "left_semi") -> DataFrame:
    """The rows of df whose column is among found, or with left_anti those whose column isn't."""
    if found is None:
        return df.limit(0) if how == "left_semi" else df
    return df.join(found, packed(F.col(column)).eqNullSafe(F.col("packed_id")), how)


def repeated(df: DataFrame, key: str = "id") -> DataFrame | None:
    """Hashes that more than one row's key has."""
    return few(settle(df.select(F.xxhash64(key).alias("id_hash")).groupBy("id_hash").count().where("count > 1").select("id_hash")))


def suspects(df: DataFrame, keys: list[tuple[str, DataFrame]]) -> tuple[list[DataFrame | None], DataFrame | None]:
    """For each column and the ids that it may have, its strays, and the hashes of repeated ids; in one pass over df."""
    hash_ = F.unhex(F.hex(F.xxhash64("id")))
    each = [F.struct(F.lit(k).alias("rule"), packed(F.col(column)).alias("packed_id")) for k, (column, _) in enumerate(keys)]
    each.append(F.struct(F.lit(-1).alias("rule"), hash_.alias("packed_id")))
    seen = df.select(F.explode(F.array(*each)).alias("x")).select("x.*").groupBy("rule", "packed_id").count().where("rule >= 0 or count > 1")
    for k, (_, ids) in enumerate(keys):
        own = ids.select(F.lit(k).alias("rule"), packed(F.col("id")).alias("packed_id"))
        targets = targets.unionByName(own) if k else own
    found = settle((seen.join(targets, ["rule", "packed_id"], "left_anti") if keys else seen).select("rule", "packed_id"))
    n = {r.rule: r["count"] for r in found.groupBy("rule").count().collect()}

    def of(rule: int, value: Column) -> DataFrame | None:
        out = found.where(F.col("rule") == rule).select(value)
        return None if rule not in n else F.broadcast(out) if n[rule] <= FEW else out

    repeats = of(-1, F.conv(F.hex("packed_id"), 16, -10).cast("long").alias("id_hash"))
    return [of(k, F.col("packed_id")) for k in range(len(keys))], repeats


def hashed(df: DataFrame, hash_: Column, found: DataFrame | None, how: str = "left_semi") -> DataFrame:
    """The rows of df whose hash is among found, or with left_anti those whose hash isn't."""
    if found is None:
        return df.limit(0) if how == "left_semi" else df
    return df.join(found, hash_ == F.col("id_hash"), how)


def one_each(df: DataFrame) -> DataFrame:
    """One row of each id."""
    again = repeated(df)
    if again is None:
        return df
    h = F.xxhash64("id")
    return hashed(df, h, again, "left_anti").unionByName(hashed(df, h, again).dropDuplicates(["id"]))
