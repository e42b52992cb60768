"""Who asks, and what a surface serves them: users by their groups, and requests by grants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import small

#: Fields that a request may not bring along, since identity comes from the session alone.
IDENTITY_FIELDS = ("persona", "role", "user", "user_id", "group")


def identities(users: DataFrame, memberships: DataFrame, groups: DataFrame) -> DataFrame:
    """(user_id, group, persona): every user's first group by name, of those that ``groups`` (group, persona) knows.

    Users without a known group have null in both. Repeated memberships (user_id, group) count once; a user of any number
    of groups is one row before the shuffle.
    """
    known = memberships.join(small(groups.where("group is not null").groupBy("group").agg(F.min("persona").alias("persona"))), "group")
    first = known.groupBy("user_id").agg(F.min(F.struct("group", "persona")).alias("g"))
    return users.select("user_id").distinct().join(first, "user_id", "left").select("user_id", "g.group", "g.persona")


def served(requests: DataFrame, known: DataFrame, grants: DataFrame) -> DataFrame:
    """(request_id, status, module, persona) of (request_id, user_id, surface, fields).

    400 where a request's fields name an identity, whoever asks; 401 for users that ``identities`` doesn't know; 403 where
    ``grants`` (surface, group, module) has no row for the surface and the user's group; else 200 with the module, and the
    persona as which the request runs. Grants are few and broadcast after a check of their size; of several modules the first by name is served.
    """
    forged = F.coalesce(F.arrays_overlap(F.transform("fields", F.lower), F.array(*[F.lit(f) for f in IDENTITY_FIELDS])), F.lit(False))
    modules = grants.groupBy("surface", "group").agg(F.min("module").alias("module"))
    rows = requests.withColumn("_forged", forged).join(known.select("user_id", "group", "persona", F.lit(True).alias("_known")), "user_id", "left").join(small(modules), ["surface", "group"], "left")
    status = F.when(F.col("_forged"), 400).when(F.col("_known").isNull(), 401).when(F.col("module").isNull(), 403).otherwise(200)
    only = lambda c: F.when(F.col("_status") == 200, F.col(c)).alias(c)
    return rows.withColumn("_status", status).select("request_id", F.col("_status").alias("status"), only("module"), only("persona"))


def metadata_json(columns: dict[str, Column]) -> Column:
    """The descriptive fields of a chunk as one JSON text, in the given order; null ones and empty lists are left out."""
    return F.to_json(F.struct(*[c.alias(name) for name, c in columns.items()]))


def chunk_rows(chunks: DataFrame, typed: list[str], described: dict[str, Column]) -> DataFrame:
    """``chunks`` as they are stored: the ``typed`` columns that filters use, and ``metadata`` with the rest as JSON."""
    return chunks.select(*typed, metadata_json(described).alias("metadata"))
