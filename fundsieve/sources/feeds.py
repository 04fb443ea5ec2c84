"""Landed feeds, snapshot logs and report sinks."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators.ranks import settled


@dataclass(frozen=True)
class FeedSpec:
    """How a delimited feed is read: its separator, what marks the header, and the aliases of each column."""

    separator: str
    header: str
    columns: Mapping[str, Sequence[str]]
    header_within: int = 50
    default_venue: str | None = None
    keep: Mapping[str, Sequence[str]] = field(default_factory=dict)


def plain(c: Column) -> Column:
    """A header for comparing: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


#: Characters that stand for quotes, separators and line ends within cells; Unicode gives them no meaning.
QUOTE, SEPARATOR, RETURN, NEWLINE = "\ue000", "\ue001", "\ue002", "\ue003"


def records(text: Column, separator: str) -> Column:
    """The records of a delimited text; line ends and separators within quoted cells are masked (see `cells`).

    Between quotes the parts of a text lie alternately outside and inside of quoted cells, so one split tells them
    apart. A quote between other characters is itself, as is a doubled one within quotes. A quote that is not closed
    reaches to the end of the text.
    """
    sep = re.escape(separator)
    text = F.regexp_replace(text, rf'(?<=[^"\r\n{sep}])"(?=[^"\r\n{sep}])', QUOTE)
    parts = F.transform(F.split(text, '"'), lambda x, i: F.when(i % 2 == 1, F.translate(x, f"{separator}\r\n", SEPARATOR + RETURN + NEWLINE)).otherwise(x))
    return F.split(F.array_join(parts, '"'), "\r?\n")


def cells(record: Column, separator: str) -> Column:
    """The cells of a record: trimmed, without their quotes, masked characters as they were."""
    bare = lambda x: F.replace(F.regexp_replace(F.trim(x), '(?s)^"(.*)"$', "$1"), F.lit('""'), F.lit('"'))
    opened = lambda x: F.translate(bare(x), QUOTE + SEPARATOR + RETURN + NEWLINE, f'"{separator}\r\n')
    return F.transform(F.split(record, re.escape(separator)), opened)


def read_feed(spark: SparkSession, path: str, spec: FeedSpec) -> DataFrame:
    """The records below each file's header, by column alias; the first alias that exists counts.

    Files are UTF-8, or Latin-1 where that fails, of a few MB each. A header is the first record, within the first
    ones, that holds the header word; files without one give no rows. line_no counts records from 0.
    """
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    whole = settled(raw, _records=records(F.regexp_replace(text, "^\ufeff", ""), spec.separator)).drop("content")
    held = F.transform(F.slice("_records", 1, spec.header_within), lambda r: F.contains(F.lower(r), F.lit(spec.header.lower())))
    headed = settled(whole, _head=F.array_position(held, True)).where("_head > 0")
    headed = settled(headed, _names=F.transform(cells(F.element_at("_records", F.col("_head").cast("int")), spec.separator), plain))
    below = headed.select("file", "_head", "_names", F.posexplode(F.slice("_records", F.col("_head") + 1, F.greatest(F.size("_records") - F.col("_head"), F.lit(0)))).alias("_n", "_record"))
    body = settled(below.where("_record <> ''"), _cells=cells(F.col("_record"), spec.separator))
    pick = {}
    for name, aliases in spec.columns.items():
        wanted = ["".join(ch for ch in a.lower() if ch.isalnum()) for a in aliases]
        pick[name] = F.coalesce(*[F.when(F.array_contains("_names", w), F.get("_cells", F.array_position("_names", w).cast("int") - 1)) for w in wanted])
    out = body.select("file", (F.col("_head") + F.col("_n")).cast("int").alias("line_no"), *[X.null_if_blank(c).alias(n) for n, c in pick.items()])
    for name, values in spec.keep.items():
        out = out.where(F.upper(name).isin([v.upper() for v in values]))
    return out


def write_counted(df: DataFrame, path: str, where: str | None = None, **counts: Column) -> dict[str, int]:
    """Write the rows of df (those that pass `where`) as Parquet and return aggregates over df, observed in the write."""
    seen = Observation()
    told = df.observe(seen, *[c.alias(name) for name, c in counts.items()])
    (told.where(where) if where else told).write.mode("overwrite").parquet(path)
    return dict(seen.get)


def listings(rows: DataFrame, default_venue: str | None = None) -> DataFrame:
    """Valid listings of feed rows: rows without an identifier go, missing venues get the default, names fall back."""
    out = rows.withColumn("isin", X.isin_norm(F.col("isin"))).where("isin is not null")
    name = F.coalesce(X.squeeze(F.col("instrument_name")), X.squeeze(F.col("short_name"))) if "short_name" in rows.columns else X.squeeze(F.col("instrument_name"))
    return out.select("isin", name.alias("instrument_name"), F.coalesce("venue_mic", F.lit(default_venue)).alias("venue_mic"), X.ticker_norm(F.col("ticker")).alias("ticker"), X.currency_norm(F.col("trading_currency")).alias("trading_currency"))


def dedup_observations(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def table_or_empty(spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
    """A table with the schema's columns; missing tables are empty, missing columns NULL."""
    if not spark.catalog.tableExists(name):
        return spark.createDataFrame([], schema)
    df = spark.table(name)
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def append_snapshot(df: DataFrame, path: str, by: str = "asof_date") -> None:
    """Append rows to a log kept by date."""
    df.write.mode("append").partitionBy(by).parquet(path)


def write_csv_report(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str]) -> None:
    """A report with fixed columns and a header, in order; sorted files follow one another."""
    df.select(*columns).orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def write_json_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def export_bundle(bundle: Mapping[str, DataFrame], path: str) -> None:
    """Each table of a bundle as Parquet in a folder of its own."""
    for name, df in bundle.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
