"""Counts, coverage, gaps and facets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known(df: DataFrame, field: str) -> Column:
    """Not NULL and, for texts, not blank."""
    c = F.col(field)
    return c.isNotNull() & (F.trim(c) != "") if dict(df.dtypes)[field] == "string" else c.isNotNull()


def pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, 2)).otherwise(F.lit(0.0))


def coverage(df: DataFrame, fields: Sequence[str], by: Sequence[str] = (), where: Mapping[str, Column] | None = None) -> DataFrame:
    """field, known, total, pct in one pass; `where` narrows the population of single fields."""
    where = where or {}
    of = {f: where.get(f, F.lit(True)) for f in fields}
    wide = df.groupBy(*by).agg(*[F.count_if(known(df, f) & of[f]).alias(f"k_{f}") for f in fields], *[F.count_if(of[f]).alias(f"t_{f}") for f in fields])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"k_{f}").alias("known"), F.col(f"t_{f}").alias("total")) for f in fields]))
    return wide.select(*by, rows.alias("r")).select(*by, "r.field", "r.known", "r.total", pct(F.col("r.known"), F.col("r.total")).alias("pct"))


def count_by(df: DataFrame, key: Column, name: str = "value") -> DataFrame:
    """Counts by a key, largest first, then by key."""
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(name).asc_nulls_first())


def facets(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """facet, value, n of several facets in one pass; NULL values are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("facet"), v.cast("string").alias("value")) for k, v in values.items()]))
    return df.select(pairs.alias("p")).where("p.value is not null").groupBy("p.facet", "p.value").agg(F.count(F.lit(1)).alias("n"))


def flag_counts(df: DataFrame, flag: Column, strict_parity: bool = False) -> DataFrame:
    """yes, no and unknown counts of a three-valued flag; parity counts no unknown among NULLs."""
    unknown = F.lit(0).cast("long") if strict_parity else F.count_if(flag.isNull())
    return df.agg(F.count_if(flag == 1).alias("yes"), F.count_if(flag == 0).alias("no"), unknown.alias("unknown"))


def key_checks(df: DataFrame, key: str, flag: Column) -> DataFrame:
    """keys, keys without a flagged row, with several, and with two rows or more."""
    per = df.groupBy(key).agg(F.count_if(flag).alias("f"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("f") == 0).alias("without"), F.count_if(F.col("f") > 1).alias("several"), F.count_if(F.col("n") > 1).alias("repeated"))


def weighted_mean(df: DataFrame, by: Sequence[str], weight: Column, value: Column) -> DataFrame:
    """Weighted mean of the known values with the weight they cover; NULL where nothing is covered."""
    covered = F.sum(F.when(value.isNotNull(), weight))
    out = df.groupBy(*by).agg(F.sum(weight * value).alias("_s"), F.coalesce(covered, F.lit(0.0)).alias("covered_weight"), F.sum(weight).alias("total_weight"))
    return out.select(*by, F.when(F.col("covered_weight") > 0, F.col("_s") / F.col("covered_weight")).alias("weighted_value"), "covered_weight", "total_weight")


def gap_rows(df: DataFrame, key: str, fields: Sequence[str], expected: Mapping[str, Column] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Rows with a missing field: missing_fields (comma list in the fields' order) and n_missing."""
    expected = expected or {}
    missing = F.array_compact(F.array(*[F.when(~known(df, f) & expected.get(f, F.lit(True)), F.lit(f)) for f in fields]))
    out = df.select(key, *keep, missing.alias("m")).where(F.size("m") > 0)
    return out.select(key, *keep, F.concat_ws(",", "m").alias("missing_fields"), F.size("m").cast("long").alias("n_missing"))


def gap_summary(gaps: DataFrame) -> DataFrame:
    """How many rows miss each field."""
    return gaps.select(F.explode(F.split("missing_fields", ",")).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def gap_counts(gaps: DataFrame, by: Mapping[str, Column]) -> DataFrame:
    """facet, value, n: how many rows with gaps miss each field and have each value of the given columns; one pass."""
    fields = F.transform(F.split("missing_fields", ","), lambda x: F.struct(F.lit("missing_field").alias("facet"), x.alias("value")))
    rest = F.array(*[F.struct(F.lit(k).alias("facet"), v.cast("string").alias("value")) for k, v in by.items()])
    return gaps.select(F.explode(F.concat(fields, rest)).alias("p")).where("p.value is not null").groupBy("p.facet", "p.value").agg(F.count(F.lit(1)).alias("n"))


def value_range(df: DataFrame, value: Column, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """low, high of the known values to two decimals; the given bounds where none is known."""
    return df.agg(F.coalesce(F.round(F.min(value), 2), F.lit(low)).alias("low"), F.coalesce(F.round(F.max(value), 2), F.lit(high)).alias("high"))


def ingest_sanity(instrument: DataFrame, listing: DataFrame) -> DataFrame:
    """measure, value, n: totals, listings by venue, funds with several listings, and repeated keys."""
    per_fund = listing.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n"))
    per_key = listing.groupBy("instrument_id", "venue_mic", "ticker").agg(F.count(F.lit(1)).alias("n"))
    per_isin = instrument.groupBy("isin").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string").alias("value")
    one = lambda name, df, n: df.agg(n.alias("n")).select(F.lit(name).alias("measure"), none, "n")
    venues = listing.groupBy(F.col("venue_mic").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("venue").alias("measure"), "value", "n")
    return (
        one("instruments", instrument, F.count(F.lit(1)))
        .unionByName(venues)
        .unionByName(one("multi_listed", per_fund, F.count_if(F.col("n") >= 2)))
        .unionByName(one("repeated_isins", per_isin, F.count_if(F.col("n") > 1)))
        .unionByName(one("repeated_listings", per_key, F.count_if(F.col("n") > 1)))
    )


def refine_report(before: DataFrame, after: DataFrame, key: str, currency: str, venue: str, issuer: str, quality: str) -> DataFrame:
    """measure, value, n: blank currencies before and after, imputed ones, rows by venue and currency, and by issuer."""
    blank = F.coalesce(F.trim(currency), F.lit("")) == ""
    none = F.lit(None).cast("string").alias("value")
    one = lambda name, df, n: df.agg(n.alias("n")).select(F.lit(name).alias("measure"), none, "n")
    pair = F.concat_ws(" | ", F.col(venue), F.coalesce(currency, F.lit("NULL")))
    by = lambda name, c: after.groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("measure"), "value", "n")
    return (
        one("before_null", before, F.count_if(blank))
        .unionByName(one("after_null", after, F.count_if(blank)))
        .unionByName(one("imputed", after, F.count_if(F.col(quality) == "imputed")))
        .unionByName(by("venue_currency", pair))
        .unionByName(by("issuer", F.coalesce(issuer, F.lit("NULL"))))
    )


def funnel(latest: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """total and how many rows pass each step and all before it."""
    passed, aggs = F.lit(True), [F.count(F.lit(1)).alias("total")]
    for name, test in steps.items():
        passed = passed & F.coalesce(test, F.lit(False))
        aggs.append(F.count_if(passed).alias(name))
    return latest.agg(*aggs)


def stage_kpis(attempts: DataFrame, by: str, flags: Sequence[str]) -> DataFrame:
    """attempted and, for each flag, how many and what share."""
    out = attempts.groupBy(by).agg(F.count(F.lit(1)).alias("attempted"), *[F.count_if(F.col(f)).alias(f"n_{f}") for f in flags])
    return out.select(by, "attempted", *[F.col(f"n_{f}") for f in flags], *[pct(F.col(f"n_{f}"), F.col("attempted")).alias(f"pct_{f}") for f in flags])
