"""User accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiffin.functions.text import name_key, trimmed

PROFILE = ["user_id", "username", "email", "full_name", "phone", "role"]


def user_profiles(users: DataFrame) -> DataFrame:
    return users.select(*PROFILE)


def users_per_role(users: DataFrame) -> DataFrame:
    return users.groupBy("role").agg(F.count("*").alias("user_count"))


def resolve_users(users: DataFrame, logins: DataFrame) -> DataFrame:
    """The account of each login text, given as username or as e-mail address.

    Two equi-joins instead of one OR condition, which would compare every login
    with every user. Usernames and addresses are unique, so a login keeps one row;
    a username match wins over an e-mail match.
    """
    account = users.select("user_id", "username", "email", "role", "full_name")
    fields = F.struct(*account.columns)
    by_name = account.select(name_key(F.col("username")).alias("_key"), fields.alias("_by_name"))
    by_email = account.select(name_key(F.col("email")).alias("_key"), fields.alias("_by_email"))
    text = trimmed(F.col("login"))
    wanted = logins.filter(text != "").select("login_id", name_key(text).alias("_key"))
    found = wanted.join(by_name, "_key", "left").join(by_email, "_key", "left")
    return (
        found.withColumn("u", F.coalesce("_by_name", "_by_email"))
        .filter("u IS NOT NULL")
        .select(
            "login_id",
            "u.*",
            F.when(F.col("_by_name").isNotNull(), "username").otherwise("email").alias("matched_on"),
        )
    )
