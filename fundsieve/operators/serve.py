"""Search, facets as filters, whitelisted sorts, pages, work queues, exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

BLANK, PAGE, LARGEST_PAGE, LAST_OFFSET = "__blank__", 50, 250, 100_000
NEEDLE_SPACE = " \t\n\r"


def everything(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def any_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def facet_tests(values: Mapping[str, Column], params: Mapping[str, str | None]) -> list[Column]:
    """An equality test for each parameter that is not empty; the blank token means missing. Unknown names raise."""
    if wrong := set(params) - set(values):
        raise ValueError(f"unknown facets: {sorted(wrong)}")
    return [blank(values[k]) if v == BLANK else values[k] == v for k, v in params.items() if v]


def tri_state(text: str | None) -> bool | None:
    """true/1/yes, false/0/no, or nothing; anything else raises."""
    if text is None or not text.strip():
        return None
    low = text.strip().lower()
    if low in ("1", "true", "yes"):
        return True
    if low in ("0", "false", "no"):
        return False
    raise ValueError(f"not a truth value: {text!r}")


def hedge_test(profile: Column, taxonomy: Column, wanted: bool | None) -> list[Column]:
    """Hedged: the profile says so, or is silent and the taxonomy does. Not hedged: the profile says so."""
    if wanted is None:
        return []
    return [(profile == 1) | (profile.isNull() & (taxonomy == 1)) if wanted else profile == 0]


def range_tests(value: Column, low: float | None, high: float | None) -> list[Column]:
    """Inclusive bounds; NULL is outside as soon as one is given."""
    return [value >= low] * (low is not None) + [value <= high] * (high is not None)


def search_test(columns: Sequence[Column], needle: str | None) -> list[Column]:
    """Substring in any column, whatever the case; % and _ in the needle stay wildcards."""
    text = (needle or "").strip(NEEDLE_SPACE)
    return [any_of([F.coalesce(c.ilike(f"%{text}%"), F.lit(False)) for c in columns])] if text else []


def ids_by_alias(aliases: DataFrame, key: str, ticker: str, needle: str) -> DataFrame:
    """Keys with an active alias row whose ticker holds the needle."""
    return aliases.where(F.coalesce("status", F.lit("active")) == "active").where(F.col(ticker).ilike(f"%{needle.strip()}%")).select(key).distinct()


def filter_identifiers(df: DataFrame, aliases: DataFrame, key: str, isin: str, ticker: str, isins: Sequence[str], tickers: Sequence[str]) -> DataFrame:
    """Rows whose isin is listed, or that have an active alias with a listed ticker; lists are upper-cased."""
    isins = sorted({x.strip().upper() for x in isins if x.strip()})
    tickers = sorted({x.strip().upper() for x in tickers if x.strip()})
    if not isins and not tickers:
        return df
    ids = aliases.where(F.coalesce("status", F.lit("active")) == "active").where(F.upper(F.trim(ticker)).isin(tickers)).select(key).distinct().withColumn("_hit", F.lit(True))
    return df.join(ids, key, "left").where(F.col(isin).isin(isins) | F.col("_hit")).drop("_hit")


def sort_columns(known: Mapping[str, Column], key: str, direction: str, tie: str, nulls_last: Sequence[str] = ()) -> list[Column]:
    """A whitelisted sort; NULLs lowest, but last both ways for the named keys. Unknown keys or directions raise."""
    if key not in known or direction not in ("asc", "desc"):
        raise ValueError(f"unknown sort: {key} {direction}")
    c = known[key]
    if key in nulls_last:
        first = c.asc_nulls_last() if direction == "asc" else c.desc_nulls_last()
    else:
        first = c.asc_nulls_first() if direction == "asc" else c.desc_nulls_last()
    return [first, F.col(tie).asc_nulls_first()]


def page(df: DataFrame, order: Sequence[Column], limit: int | None = None, offset: int | None = None) -> DataFrame:
    """One page: at most LARGEST_PAGE rows (a page is the feature), from an offset of at most LAST_OFFSET."""
    limit = min(max(PAGE if limit is None else limit, 1), LARGEST_PAGE)
    offset = min(max(offset or 0, 0), LAST_OFFSET)
    return df.orderBy(*order).offset(offset).limit(limit)


def page_after(df: DataFrame, key: str, tie: str, last: tuple, limit: int = PAGE) -> DataFrame:
    """The page after a given (key, tie), for deep paging without skipping rows."""
    return df.where((F.col(key) > last[0]) | ((F.col(key) == last[0]) & (F.col(tie) > last[1]))).orderBy(key, tie).limit(limit)


def work_queue(df: DataFrame, missing: Sequence[Column], tie: str, limit: int = 0) -> DataFrame:
    """Rows by what they lack, most wanted first, then the tie; 0: no limit."""
    ordered = df.orderBy(*[F.when(m, 0).otherwise(1) for m in missing], F.col(tie).asc_nulls_first())
    return ordered.limit(limit) if limit else ordered


def pending(df: DataFrame, log: DataFrame, key: str, order: str, version: Column, current: str | Sequence[str]) -> DataFrame:
    """Rows whose newest log row does not carry the current version, or one of several accepted values."""
    accepted = [current] if isinstance(current, str) else list(current)
    done = log.groupBy(key).agg(F.max_by(version, order).alias("_v")).where(F.col("_v").isin(accepted)).select(key)
    return df.join(done, key, "left_anti")


def order_ci(c: Column | str) -> list[Column]:
    """Alphabetical whatever the letters' case, then by the text itself."""
    c = F.col(c) if isinstance(c, str) else c
    return [F.lower(c).asc_nulls_first(), c.asc_nulls_first()]


def lookup(df: DataFrame, ref: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """df with the fields of the first row of ref for its keys; every row of df stays once."""
    from .latest import top_rows

    return df.join(top_rows(ref, list(keys), list(order)), list(keys), "left")


def issuer_terms(texts: Sequence[str]) -> list[str]:
    """Terms of comma lists: trimmed, upper case, each once."""
    return list(dict.fromkeys(" ".join(x.split()).upper() for t in texts for x in t.split(",") if x.strip()))


#: Houses whose documents follow a template.
TEMPLATE_HOUSES = ("VANGUARD", "INVESCO", "XTRACKERS", "AMUNDI", "HSBC", "WISDOMTREE")


def filter_issuers(df: DataFrame, terms: Sequence[str], columns: Sequence[str] = ("issuer_hint", "issuer_name", "instrument_name"), template_only: bool = False) -> DataFrame:
    """Rows with any term in any of the columns, whatever the case; template_only also asks for a house with a template."""
    holds = lambda words, cs: any_of([F.contains(F.upper(F.coalesce(c, F.lit(""))), F.lit(w)) for c in cs for w in words])
    wanted = issuer_terms(terms)
    out = df.where(holds(wanted, columns)) if wanted else df
    return out.where(holds(TEMPLATE_HOUSES, [c for c in columns if c != "issuer_hint"])) if template_only else out


def needs_enrichment(df: DataFrame, fields: Sequence[str]) -> Column:
    """Any of the fields is missing; a blank text counts as missing."""
    kinds = dict(df.dtypes)
    return any_of([blank(F.col(f)) if kinds[f] == "string" else F.col(f).isNull() for f in fields])


def fee_targets(df: DataFrame, fee: str, houses: Sequence[str], issuer: str, at_most: float | None = None) -> DataFrame:
    """Plain funds of some houses whose fee is missing or, if a bound is given, suspiciously small."""
    wanted = F.col(fee).isNull() if at_most is None else F.col(fee).isNull() | (F.col(fee) <= at_most)
    return df.where((F.upper(F.coalesce("instrument_type", F.lit(""))) == "ETF") & wanted & F.upper(F.coalesce(issuer, F.lit(""))).isin([h.upper() for h in houses]))


def closure(tables: Mapping[str, tuple[DataFrame, str]], ids: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table restricted to rows whose column is among the ids."""
    ids = ids.select(key).distinct()
    return {name: df.join(ids.withColumnRenamed(key, column), column, "left_semi") for name, (df, column) in tables.items()}


def bundle_counts(bundle: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, n for every table of a bundle, in one job."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in bundle.items()]
    return reduce(DataFrame.unionByName, parts)


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either that the other lacks; empty if both give the same answers."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("only_in", F.lit("a")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("b")))


def candidate_label(ticker: Column, isin: Column, fee: Column, venue: Column) -> Column:
    """A candidate as `TICK (0.20%) | VENUE`; what is not known is left out, and the id stands for a missing ticker."""
    name = F.coalesce(T.known_text(ticker), isin, F.lit(""))
    left = F.when(fee.isNotNull(), F.concat(name, F.lit(" ("), T.show_percent(fee), F.lit(")"))).otherwise(name)
    return F.concat_ws(" | ", left, T.known_text(venue))


def bucket_tables(rows: DataFrame, bucket: str, order: str, label: Column) -> DataFrame:
    """bucket, n, line: the labels of each bucket's candidates in order; rows hold as many as a report shows."""
    told = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), label.alias("label"))))
    return rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(told, lambda r: r["label"]), "; ").alias("line"))


def mix_lines(rows: DataFrame, strategy: str, order: str, bucket: str, weight: str) -> DataFrame:
    """strategy, line: the buckets of each strategy with their target weights in percent, as `60% equity global / ...`."""
    named = F.concat(T.fixed(F.col(weight), 0), F.lit("% "), F.lower(F.replace(F.col(bucket), F.lit("_"), F.lit(" "))))
    told = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), named.alias("label"))))  # as many as it has buckets
    return rows.groupBy(strategy).agg(F.array_join(F.transform(told, lambda r: r["label"]), " / ").alias("line"))
