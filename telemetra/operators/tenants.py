"""Tenant checks: known organisations and API quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# APIs allowed per plan when no flag overrides them; null is unlimited, other plans get 1.
PLAN_LIMITS = {"free": 1, "pro": 10, "business": None}


def known_orgs(events: DataFrame, orgs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events of known organisations, events of unknown ones)."""
    ids = orgs.select(F.col("id").alias("org_id")).distinct()
    return events.join(ids, "org_id", "left_semi"), events.join(ids, "org_id", "left_anti")


def apis_per_org(apis: DataFrame) -> DataFrame:
    return apis.groupBy("org_id").agg(F.count(F.lit(1)).alias("apis"))


def quota_status(orgs: DataFrame, apis: DataFrame, flags: DataFrame) -> DataFrame:
    """Per organisation: its limit (an enabled ``api_quota`` flag wins), API count and whether one more fits."""
    plan = F.lower(F.coalesce(F.nullif("plan", F.lit("")), F.lit("free")))
    static = F.coalesce(
        *[F.when(F.col("plan") == name, F.lit(n).cast("int")) for name, n in PLAN_LIMITS.items() if n is not None],
        F.when(~F.col("plan").isin(list(PLAN_LIMITS)), F.lit(1)),
    )
    dynamic = (
        flags.filter((F.col("feature_key") == "api_quota") & F.col("enabled") & F.col("limit").isNotNull())
        .groupBy("plan")
        .agg(F.min("limit").alias("flag_limit"))
    )
    return (
        orgs.select(F.col("id").alias("org_id"), plan.alias("plan"))
        .join(dynamic, "plan", "left")
        .join(apis_per_org(apis), "org_id", "left")
        .select(
            "org_id",
            "plan",
            F.coalesce("flag_limit", static).cast("bigint").alias("api_limit"),
            F.coalesce("apis", F.lit(0)).cast("bigint").alias("apis"),
        )
        .withColumn("under_quota", F.col("api_limit").isNull() | (F.col("apis") < F.col("api_limit")))
    )
