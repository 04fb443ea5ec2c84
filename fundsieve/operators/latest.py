"""Latest, preferred and coalesced rows per key.

Three meanings of "latest" are kept apart: by (date, id) over accepted rows, by largest id, and by precedence of logs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Quality flags of cost rows that count as accepted.
ACCEPTED_FLAGS = ("ok", "partial", "issuer_page_ok", "amundi_factsheet_ok", "avantis_kid_ok", "wisdomtree_kid_ok", "invesco_kid_ok", "lse_ter_ok")


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key by a total order; Spark limits the groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(rank or "_rank", F.row_number().over(w)).where(F.col(rank or "_rank") <= n)
    return out if rank else out.drop("_rank")


def latest_accepted(log: DataFrame, key: str, value: str, flag: str, flags: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each key whose value is known and whose flag is accepted; order: newest first, total."""
    return top_rows(log.where(F.col(value).isNotNull() & F.col(flag).isin(*flags)), [key], [F.col(c).desc() for c in order])


def latest_known(log: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """The newest value of each key that is not NULL (texts: not blank)."""
    known = F.col(value).isNotNull()
    if dict(log.dtypes)[value] == "string":
        known = known & (F.trim(value) != "")
    return top_rows(log.where(known), [key], [F.col(c).desc() for c in order]).select(key, value)


def latest_by_id(log: DataFrame, key: str, id_: str) -> DataFrame:
    """The row with the largest id of each key, by one grouped aggregate."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), id_).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def latest_by_source(log: DataFrame, key: str, source: str, wanted: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The newest row of one source and the newest of any, side by side."""
    newest = F.struct(*order)
    pick = F.struct(*fields)
    mine = F.max_by(pick, F.when(F.col(source) == wanted, newest))
    got = log.groupBy(key).agg(mine.alias("a"), F.max_by(pick, newest).alias("b"))
    return got.select(key, *[F.col(f"a.{f}").alias(f"{wanted}_{f}") for f in fields], *[F.col(f"b.{f}").alias(f"latest_{f}") for f in fields])


def rank_of(value: Column, order: Sequence[str], unknown: int | None = None, null: int | None = None) -> Column:
    """Position in a fixed order; unknown and NULL values come after it unless given ranks of their own."""
    last = len(order) if unknown is None else unknown
    found = F.coalesce(*[F.when(value == v, F.lit(i)) for i, v in enumerate(order)], F.lit(last)) if order else F.lit(last)
    return F.when(value.isNull(), F.lit(last if null is None else null)).otherwise(found)


def choose_primary(rows: DataFrame, key: str, venue: str, currency: str, ties: Sequence[str], venues: Sequence[str], currencies: Sequence[str], flag: str = "primary_flag") -> DataFrame:
    """Exactly one primary row a key: by venue rank and name, currency rank and name, then the ties."""
    order = [rank_of(F.col(venue), venues), F.col(venue).asc_nulls_first(), rank_of(F.upper(currency), currencies), F.upper(currency).asc_nulls_first(), *[F.col(t).asc_nulls_first() for t in ties]]
    return rows.withColumn(flag, (F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1).cast("int"))


def representative(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """One active row a key: primary first, then the given order."""
    return top_rows(rows.where(F.coalesce("status", F.lit("active")) == "active"), [key], [F.coalesce("primary_flag", F.lit(0)).desc(), *order])


def coalesce_by_precedence(log: DataFrame, key: str, order: Column, fields: Sequence[str]) -> DataFrame:
    """Of each field the first value that is not NULL in the log's order (smallest first); fields may mix rows."""
    first = [F.min_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields]
    return log.groupBy(key).agg(*first)


def mode_by(rows: DataFrame, keys: Sequence[str], value: str, rank: Column, name: str) -> DataFrame:
    """The most frequent value of each key that is not NULL; ties by rank, then alphabetical."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), rank, F.upper(value))).alias(name))


def dominant(rows: DataFrame, key: str, label: str, weight: str, position: str) -> DataFrame:
    """The label with the largest weight of each key, the first on ties."""
    return rows.groupBy(key).agg(F.max_by(label, F.struct(weight, -F.col(position))).alias(label), F.max(weight).alias(weight))


def listed_by_venue(rows: DataFrame, key: str, venues: Sequence[str]) -> DataFrame:
    """One active row a key that has a ticker and a currency: primary first, then by venue, then by id."""
    whole = (F.trim(F.coalesce("ticker", F.lit(""))) != "") & (F.trim(F.coalesce("trading_currency", F.lit(""))) != "")
    return representative(rows.where(whole), key, [rank_of(F.col("venue_mic"), venues), F.col("listing_id")])


def best_document(docs: DataFrame, key: str, language: str, recorded: str, alias: str, name: str, mark: str = "/ETF/") -> DataFrame:
    """The document of each key: English first, then the newest, then those whose alias has a mark, then by name."""
    order = [
        (F.lower(F.trim(language)) != "english").cast("int").asc_nulls_last(),
        F.col(recorded).desc_nulls_last(),
        (~F.coalesce(F.col(alias).contains(mark), F.lit(False))).cast("int"),
        F.coalesce(name, F.lit("")),
    ]
    return top_rows(docs, [key], order)


def rank_candidates(cands: DataFrame, key: str, url: str, score: str, label: str, n: int = 10) -> DataFrame:
    """The best n candidates of each key with rank: each url once with its best score, then by score, label and url."""
    best = cands.groupBy(key, url).agg(F.max(score).alias(score), F.min_by(label, F.struct(-F.col(score), label)).alias(label))
    return top_rows(best, [key], [F.col(score).desc(), F.col(label), F.col(url)], n, "rank")


def fee_outliers(cost: DataFrame, key: str, value: str, order: Sequence[str], low: float = 0.0, high: float = 3.0) -> DataFrame:
    """Keys whose newest known value, whatever its flag, is out of range."""
    return latest_known(cost, key, value, order).where(~F.col(value).between(low, high))
