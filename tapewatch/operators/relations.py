"""Which accounts belong together: the same account, a shared owner, or an explicit link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.operators.components import component_labels


def relation_keys(entities: DataFrame) -> DataFrame:
    """account_id and key: two accounts are related if and only if they are equal or share a key.

    An owner is one key, a link another; so joins on the key replace a join on the relation, and
    no list of all pairs of an owner's accounts is made. Links to accounts that aren't registered
    still relate the two.
    """
    owned = entities.filter(F.col("owner_id").isNotNull() & (F.col("owner_id") != "")).select("account_id", F.concat(F.lit("owner "), F.col("owner_id")).alias("key"))
    links = entities.select("account_id", F.explode("linked_account_ids").alias("other"))
    key = F.concat(F.lit("link "), F.least("account_id", "other"), F.lit(" "), F.greatest("account_id", "other"))
    linked = links.select("account_id", key.alias("key")).unionByName(links.select(F.col("other").alias("account_id"), key.alias("key")))
    return owned.unionByName(linked).distinct()


def is_related(a: Column, b: Column, owner_a: Column, owner_b: Column, links_a: Column, links_b: Column) -> Column:
    """The relation as an expression; nulls stand for accounts that aren't registered."""
    yes = (a == b) | ((owner_a == owner_b) & (owner_a != "")) | F.array_contains(links_a, b) | F.array_contains(links_b, a)
    return F.coalesce(a == b, F.lit(False)) | F.coalesce(yes, (owner_a == owner_b) & (owner_a != ""), F.array_contains(links_a, b), F.array_contains(links_b, a), F.lit(False))


def related_pairs(entities: DataFrame) -> DataFrame:
    """account_a < account_b for all related pairs (a report: it grows with the square of an owner's accounts)."""
    keys = relation_keys(entities)
    a, b = keys.withColumnRenamed("account_id", "account_a"), keys.withColumnRenamed("account_id", "account_b")
    return a.join(b, "key").filter("account_a < account_b").select("account_a", "account_b").distinct()


def account_components(entities: DataFrame) -> DataFrame:
    """account_id and component_id, the smallest account that chains of the relation reach."""
    keys = relation_keys(entities)
    least = keys.groupBy("key").agg(F.min("account_id").alias("b"))  # a key's accounts form a star around the smallest
    labels = component_labels(keys.join(least, "key").select(F.col("account_id").alias("a"), "b"))
    accounts = entities.select("account_id").distinct().join(labels.withColumnRenamed("node", "account_id"), "account_id", "left")
    return accounts.select("account_id", F.coalesce("label", "account_id").alias("component_id"))
