"""Diagnostics as a relation: aggregation, severity, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITY = {"note": 0, "warning": 1, "failure": 2}
SAMPLES, GROUPS = 4, 16 * 1024
_MOST = 9_223_372_036_854_775_807


def rank(severity: Column) -> Column:
    return F.when(severity == "failure", 2).when(severity == "warning", 1).otherwise(0)


def exploded(parsed: DataFrame, *keys: str) -> DataFrame:
    """One row per report and context."""
    return parsed.select(*keys, F.explode("reports").alias("r")).select(*keys, "r.*").select("*", F.explode_outer("contexts").alias("context")).drop("contexts")


def aggregate(reports: DataFrame, *keys: str) -> DataFrame:
    """reports (keys, seq, code, consequence, directions, severity, count, context) -> one row a (keys, code, consequence,
    directions): counts summed without wrapping, the worst severity, the first sequence, and the first four distinct
    contexts.  At most 16 Ki groups a document stay, and the last of them says how many were left out."""
    by = [*keys, "code", "consequence", "directions"]
    total = F.least(F.sum(F.col("count").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("bigint")
    base = reports.groupBy(*by).agg(total.alias("count"), F.max(rank(F.col("severity"))).alias("severity_rank"), F.min("seq").alias("seq"))
    firsts = reports.where("context is not null").groupBy(*by, "context").agg(F.min("seq").alias("at"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("at", "context"))
    some = firsts.withColumn("k", place).where(F.col("k") <= SAMPLES).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "context"))), lambda x: x["context"]).alias("contexts"))
    both = base.join(some, by, "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("seq", "code", "consequence", "directions"))
    kept = both.withColumn("group", n)
    over = kept.where(F.col("group") > GROUPS).groupBy(*keys).agg(F.count("*").alias("count"), F.min("seq").alias("seq"))
    cut = over.select(*keys, F.lit("core.reports-truncated").alias("code"), F.lit("").alias("consequence"), F.lit("").alias("directions"), "count", F.lit(1).alias("severity_rank"), "seq", F.array().cast("array<string>").alias("contexts"))
    return kept.where(F.col("group") <= GROUPS).drop("group").unionByName(cut)


def worst(reports: DataFrame, *keys: str) -> DataFrame:
    return reports.groupBy(*keys).agg(F.max("severity_rank").alias("worst"))


def as_json(reports: Column | str) -> Column:
    return F.to_json(reports)


def as_text(reports: Column | str) -> Column:
    reports = F.col(reports) if isinstance(reports, str) else reports
    line = F.transform(reports, lambda r: F.concat(r["severity"], F.lit("["), r["code"], F.lit("]"), F.when(F.length(r["consequence"]) > 0, F.concat(F.lit(": "), r["consequence"])).otherwise(""), F.when(r["count"] > 1, F.concat(F.lit(" (x"), r["count"].cast("string"), F.lit(")"))).otherwise(""), F.when(F.size(r["contexts"]) > 0, F.concat(F.lit("\n  at "), F.array_join(r["contexts"], ", "))).otherwise("")))
    return F.array_join(line, "\n")
