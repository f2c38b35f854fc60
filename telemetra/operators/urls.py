"""Origin and address checks over tables of URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetra.functions.urls import clean_relative_path, host, literal_ip_verdict, origin_fault, origin_text, port, scheme, url_path


def with_origin(df: DataFrame, column: str) -> DataFrame:
    """Adds scheme, host, port, origin, path and ``origin_fault`` (null for a usable URL)."""
    out = df.withColumns({"scheme": scheme(column), "host": host(column), "port": port(column)})
    origin = F.when(F.col("origin_fault").isNull(), origin_text(F.col("scheme"), F.col("host"), F.col("port")))
    return (
        out.withColumn("origin_fault", origin_fault(column))
        .withColumn("origin", origin)
        .withColumn("path", clean_relative_path(url_path(column)))
    )


def allowed_targets(df: DataFrame, apis: DataFrame, column: str = "url") -> DataFrame:
    """URLs whose (scheme, host, port) is registered as a base URL of the same organisation."""
    at = ["org_id", "scheme", "host", "port"]
    registered = with_origin(apis.select("org_id", "base_url"), "base_url").filter(F.col("origin_fault").isNull())
    usable = with_origin(df, column).filter(F.col("origin_fault").isNull())
    return usable.join(registered.select(*at).distinct(), at, "left_semi")


def public_literal_ip(df: DataFrame, column: str = "host") -> DataFrame:
    """Adds ``ip_verdict``: public, blocked, or null for a host name. Range tests only: no join, no look-up."""
    return df.withColumn("ip_verdict", literal_ip_verdict(F.col(column)))
