"""Rollups and filters over scored listings."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwarden.operators.rules import FLAGS
from listwarden.plans.scoring import OUTPUT_COLUMNS, TIERS

# Cluster signals of the report, with the flag each one counts.
CLUSTER_SIGNALS = {
    "Shared phone": "SHARED_PHONE",
    "Shared address": "SHARED_ADDRESS",
    "Shared email": "SHARED_EMAIL",
    "Shared domain": "SHARED_DOMAIN",
    "Residential address (RDI)": "RESIDENTIAL_ADDRESS",
}
# Raw headers that identify a reseller or a column worth reviewing.
RESELLER_HEADERS = ("reseller_id", "reseller_name", "reseller", "partner_id")
RESELLER_HEADERS_WIDE = (*RESELLER_HEADERS, "partner_name")
NAME_HEADERS = ("business_name", "name", "company")
ADDRESS_HEADERS = ("address", "street", "street_address")


def tier_summary(scored: DataFrame) -> DataFrame:
    """Every tier in fixed order: ``position, risk_tier, records, percent, total``.

    A single aggregate over the table; tiers without rows and empty tables give zeros.
    """
    counts = scored.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("risk_tier") == tier).alias(f"t{at}") for at, tier in enumerate(TIERS)],
    )
    rows = F.array(*[
        F.struct(F.lit(at + 1).alias("position"), F.lit(tier).alias("risk_tier"),
                 F.col(f"t{at}").alias("records"))
        for at, tier in enumerate(TIERS)
    ])
    percent = F.when(F.col("total") > 0, F.col("records") * 100.0 / F.col("total")).otherwise(0.0)
    return counts.select("total", F.inline(rows)).select(
        "position", "risk_tier", "records", percent.alias("percent"), "total"
    )


def flag_frequency(scored: DataFrame, top: int | None = None) -> DataFrame:
    """``flag, n`` by falling count; ``top`` keeps that many."""
    flag = F.explode(F.split("flags_triggered", ",")).alias("flag")
    counts = (
        scored.filter(F.col("flags_triggered") != "")
        .select(flag)
        .select(F.trim("flag").alias("flag"))
        .filter(F.col("flag") != "")
        .groupBy("flag")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "flag")
    )
    return counts if top is None else counts.limit(top)


def tallies() -> list[Column]:
    """Aggregates over scored rows from which both reports can be made, for ``observe``.

    One counter for each tier and flag, and ``other``: flags outside of the catalog, or named
    twice in a row, which these counters miss.
    """
    named = F.filter(F.transform(F.split("flags_triggered", ","), F.trim), lambda f: f != "")
    known = F.size(F.array_intersect(named, F.array(*[F.lit(flag) for flag in FLAGS])))
    return [
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("risk_tier") == tier).alias(f"tier_{at}")
          for at, tier in enumerate(TIERS)],
        *[F.count_if(F.array_contains(named, flag)).alias(f"flag_{at}")
          for at, flag in enumerate(FLAGS)],
        F.coalesce(F.sum(F.size(named) - known), F.lit(0)).alias("other"),
    ]


def tier_summary_of(spark: SparkSession, seen: Mapping[str, int]) -> DataFrame:
    """What ``tier_summary`` returns, from tallies."""
    total = seen["total"]
    rows = [(at + 1, tier, seen[f"tier_{at}"], seen[f"tier_{at}"] * 100.0 / total if total else 0.0,
             total) for at, tier in enumerate(TIERS)]
    schema = "position int, risk_tier string, records long, percent double, total long"
    return spark.createDataFrame(rows, schema).coalesce(1)  # a row for each tier, in order


def flag_frequency_of(spark: SparkSession, seen: Mapping[str, int]) -> DataFrame:
    """What ``flag_frequency`` returns, from tallies without others."""
    counts = [(flag, seen[f"flag_{at}"]) for at, flag in enumerate(FLAGS) if seen[f"flag_{at}"]]
    counts.sort(key=lambda row: (-row[1], row[0]))
    return spark.createDataFrame(counts, "flag string, n long").coalesce(1)  # in order


def cluster_sizes(
    scored: DataFrame, signals: Iterable[str] | None = None, keep_empty: bool = True
) -> DataFrame:
    """``position, signal, records`` flagged per cluster signal, in one aggregate."""
    chosen = list(CLUSTER_SIGNALS) if signals is None else list(signals)
    counts = scored.agg(*[
        F.count_if(F.contains(F.col("flags_triggered"), F.lit(CLUSTER_SIGNALS[signal])))
        .alias(f"s{at}")
        for at, signal in enumerate(chosen)
    ])
    rows = counts.select(F.inline(F.array(*[
        F.struct(F.lit(at + 1).alias("position"), F.lit(signal).alias("signal"),
                 F.col(f"s{at}").alias("records"))
        for at, signal in enumerate(chosen)
    ])))
    return rows if keep_empty else rows.filter(F.col("records") > 0)


def reseller_breakdown(
    scored: DataFrame, headers: Sequence[str] = RESELLER_HEADERS, top: int | None = None,
    digits: int | None = None,
) -> DataFrame | None:
    """``reseller, records, avg_score`` by falling mean; None without a reseller column."""
    column = _first_header(scored, headers)
    if column is None:
        return None
    mean = F.avg("spam_score")
    result = (
        scored.select(_raw(column).alias("reseller"), "spam_score")
        .filter(F.col("reseller").isNotNull())
        .groupBy("reseller")
        .agg(F.count("spam_score").alias("records"), mean.alias("avg_score"))
        .orderBy(F.desc("avg_score"), "reseller")
    )
    if top is not None:
        result = result.limit(top)
    if digits is not None:
        result = result.withColumn("avg_score", F.bround("avg_score", digits))
    return result


def filter_scored(
    scored: DataFrame,
    tiers: Iterable[str] = (),
    min_score: int = 0,
    flag_search: str = "",
) -> DataFrame:
    """Rows of some tiers, from some score, with flags that match a pattern.

    An empty choice of tiers, a zero score or a blank search does not filter.
    """
    result = scored
    tiers = list(tiers)
    if tiers:
        result = result.filter(F.col("risk_tier").isin(*tiers))
    if min_score > 0:
        result = result.filter(F.col("spam_score") >= min_score)
    if flag_search.strip():
        result = result.filter(F.col("flags_triggered").rlike(f"(?i){flag_search.strip()}"))
    return result


def results_first(scored: DataFrame) -> DataFrame:
    """Output columns, then the input columns."""
    rest = [_raw(name) for name in scored.columns if name not in OUTPUT_COLUMNS]
    return scored.select(*OUTPUT_COLUMNS, *rest)


def residential_review(scored: DataFrame) -> DataFrame:
    """Rows at residential addresses, with the columns a reviewer needs."""
    shown = [
        _first_header(scored, headers)
        for headers in (NAME_HEADERS, ADDRESS_HEADERS, ("city",), ("state",))
    ]
    columns = [_raw(name) for name in shown if name is not None]
    return scored.filter(
        F.contains(F.col("flags_triggered"), F.lit("RESIDENTIAL_ADDRESS"))
    ).select(*columns, "spam_score", "risk_tier", "flags_triggered")


def _first_header(scored: DataFrame, headers: Sequence[str]) -> str | None:
    return next((name for name in scored.columns if name.lower() in headers), None)


def _raw(name: str):
    return F.col("`" + name.replace("`", "``") + "`")
