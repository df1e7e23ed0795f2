"""Roles, API keys, and reachability over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed values: (role, permissions).
PERMISSIONS = (
    ("admin", ("scan:read", "scan:write", "finding:read", "finding:write", "finding:triage", "org:manage", "api_key:manage", "report:read", "report:write")),
    ("security", ("scan:read", "scan:write", "finding:read", "finding:write", "finding:triage", "report:read", "report:write")),
    ("developer", ("scan:read", "finding:read", "finding:write")),
    ("viewer", ("scan:read", "finding:read", "report:read")),
    ("ci", ("scan:read", "scan:write")),
)
ROLES = tuple(r for r, _ in PERMISSIONS)


def permissions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, p) for r, ps in PERMISSIONS for p in ps], "role string, permission string")


def permitted(spark: SparkSession, users: DataFrame, permission: str) -> DataFrame:
    """Rows of ``users`` whose role has ``permission``. [C12]"""
    return users.join(F.broadcast(permissions(spark).where(F.col("permission") == permission).select("role")), "role", "left_semi")


def hashed_keys(keys: DataFrame) -> DataFrame:
    """(id, key_hash, prefix) of rows (id, plaintext); the plaintext is not kept. [H22]"""
    return keys.select("id", F.sha2("plaintext", 256).alias("key_hash"), F.concat(F.left("plaintext", F.lit(10)), F.lit("...")).alias("prefix"))


def valid_keys(presented: DataFrame, stored: DataFrame, now: str) -> DataFrame:
    """Stored keys that match a presented plaintext and have not expired. [F13]"""
    met = presented.select(F.sha2("plaintext", 256).alias("key_hash")).join(stored, "key_hash")
    return met.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp")))


def keys_of(stored: DataFrame, org_id: str) -> DataFrame:
    """An organisation's keys, without their hashes. [F13]"""
    return stored.where(F.col("org_id") == org_id).drop("key_hash")


def without_key(stored: DataFrame, key_id) -> DataFrame:
    """The keys that are left when one is revoked; null ids stay. [F13]"""
    return stored.where(~F.col("id").eqNullSafe(F.lit(key_id)))


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "orders", "customer", "supplier")}
    li = t["lineitem"]
    e = li.join(t["orders"], li["l_orderkey"] == t["orders"]["o_orderkey"]).join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
    return e.where("s_nationkey <> c_nationkey").select(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b")).distinct()


def supply_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(0,)], "node int")


def reach(edges: DataFrame, start: DataFrame, depth: int, decay: float = 0.95) -> DataFrame:
    """Nodes within ``depth`` hops of ``start`` over edges (a, b): fewest hops, and confidence that decays by hop. [B23, C9]"""
    found = start.select("node", F.lit(0).alias("hops"))
    for hop in range(1, depth + 1):
        new = found.where(F.col("hops") == hop - 1).join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node"), F.lit(hop).alias("hops")).distinct()
        found = found.union(new).groupBy("node").agg(F.min("hops").alias("hops"))
    return found.withColumn("confidence", F.round(F.pow(F.lit(decay), F.col("hops")), 9))
