"""Facts from text and HTML columns by expressions: values near words, labelled fields, tables, links, ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

ISIN = r"\b[A-Z]{2}[A-Z0-9]{9}[0-9]\b"


def window_value(docs: DataFrame, key: str, text: str, keyword: str, value: str, width: int, low: float, high: float) -> DataFrame:
    """key, n_hits, value: after every hit of a keyword the first number within `width` characters and in range.

    The answer is that of the earliest hit that has one after it, else the smallest found before any hit.
    """
    parts = docs.select(key, F.split(F.lower(text), keyword).alias("p")).where(F.size("p") > 1)
    hits = parts.select(key, F.posexplode("p").alias("i", "part"))
    numbers = lambda s: F.filter(F.transform(F.regexp_extract_all(s, F.lit(value), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double")), lambda x: x.between(low, high))
    after = F.when(F.col("i") > 0, F.get(numbers(F.substring("part", 1, width)), F.lit(0)))
    before = F.array_min(numbers(F.right("part", F.lit(width))))
    got = hits.select(key, "i", after.alias("a"), before.alias("b"))
    out = got.groupBy(key).agg((F.count(F.lit(1)) - 1).alias("n_hits"), F.min_by("a", F.when(F.col("a").isNotNull(), F.col("i"))).alias("direct"), F.min("b").alias("near"))
    return out.select(key, "n_hits", F.coalesce("direct", "near").alias("value"))


def label_value(text: Column, labels: Sequence[str], pattern: str, width: int) -> Column:
    """The first value at most `width` characters after a label, labels in order."""
    return F.coalesce(*[T.null_if_blank(F.regexp_extract(text, rf"(?is){label}.{{0,{width}}}?{pattern}", 1)) for label in labels])


def labelled_fields(docs: DataFrame, key: str, text: str, spec: Mapping[str, tuple[Sequence[str], str, int]]) -> DataFrame:
    """One column for each field of a spec: labels, pattern with one group, width."""
    return docs.select(key, *[label_value(F.col(text), *s).alias(name) for name, s in spec.items()])


def html_facts(pages: DataFrame, key: str, html: str, name: str = r"<th[^>]*>(.*?)</th>", data: str = r"<td[^>]*>(.*?)</td>") -> DataFrame:
    """key, facts: captions to data of a page in order; the first of equal captions counts."""
    plain = lambda a: F.transform(a, lambda x: F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"(?U)\s+", " "))))
    captions = plain(F.regexp_extract_all(html, F.lit("(?is)" + name), F.lit(1)))
    values = F.transform(F.regexp_extract_all(html, F.lit("(?is)" + data), F.lit(1)), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"(?U)\s+", " ")))
    rows = pages.select(key, captions.alias("c"), values.alias("v"))
    pairs = F.filter(F.arrays_zip("c", "v"), lambda x: x["c"].isNotNull() & x["v"].isNotNull())
    once = F.filter(F.transform(pairs, lambda x, i: F.struct(x["c"].alias("c"), x["v"].alias("v"), i.alias("i"))), lambda x: F.array_position(F.col("c"), x["c"]) == x["i"] + 1)
    return rows.select(key, F.map_from_entries(F.transform(once, lambda x: F.struct(x["c"], x["v"]))).alias("facts"))


def fact(facts: Column, exact: Sequence[str], contains: Sequence[str] = ()) -> Column:
    """The value of the first exact caption, else of the first caption that contains a word."""
    keys = F.map_keys(facts)
    holding = lambda w: F.get(F.filter(keys, lambda k: k.contains(w)), F.lit(0))
    some = [F.try_element_at(facts, holding(w)) for w in contains]
    return F.coalesce(*[F.try_element_at(facts, F.lit(k)) for k in exact], *some)


def extract_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, table_no, row_no, cells of every HTML table."""
    cut = lambda c, e: F.regexp_extract_all(c, F.lit(e), F.lit(1))
    tables = pages.select(key, F.posexplode(cut(html, r"(?is)<table[^>]*>(.*?)</table>")).alias("table_no", "t"))
    rows = tables.select(key, "table_no", F.posexplode(cut("t", r"(?is)<tr[^>]*>(.*?)</tr>")).alias("row_no", "r"))
    cells = F.transform(cut("r", r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"(?U)\s+", " ")))
    return rows.select(key, "table_no", "row_no", cells.alias("cells"))


def extract_links(pages: DataFrame, key: str, html: str, pattern: str | None = None) -> DataFrame:
    """key, link: the distinct canonical links of a page that match a pattern."""
    links = F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(r'(?i)href\s*=\s*"([^"]*)"'), F.lit(1)), T.url_canonical))
    out = pages.select(key, F.explode(links).alias("link")).where("link <> ''")
    return out.where(F.col("link").rlike(pattern)) if pattern else out


def extract_ids(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, isin: the distinct valid identifiers of a text, in order."""
    ids = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({ISIN})"), F.lit(1))), T.isin_ok)
    return docs.select(key, F.posexplode(ids).alias("pos", "isin"))


def choose_known(ids: DataFrame, key: str, id_: str, known: DataFrame) -> DataFrame:
    """Of each text's ids the smallest that is known, else the first."""
    marked = ids.join(known.select(id_).distinct().withColumn("_k", F.lit(True)), id_, "left")
    return marked.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("_k"), F.col(id_))), F.min_by(id_, "pos")).alias(id_))


def values_after_keys(docs: DataFrame, key: str, text: str, keys: DataFrame, id_: str, pattern: str, value: str, width: int, low: float, high: float) -> DataFrame:
    """key, id, value: the first number in range within `width` characters after an id; an equi join on found ids."""
    places = docs.select(key, F.col(text).alias("_t"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))).alias(id_))
    hit = places.join(keys.select(id_).distinct(), id_)
    after = F.expr(f"substr(_t, instr(_t, `{id_}`) + length(`{id_}`), {width})")
    numbers = F.filter(F.transform(F.regexp_extract_all(after, F.lit(value), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double")), lambda x: x.between(low, high))
    return hit.select(key, id_, F.get(numbers, F.lit(0)).alias("value"))


def assemble_costs(facts: DataFrame, value: str, parts: Sequence[str], low: float = 0.0, high: float = 3.0) -> DataFrame:
    """quality: parse_fail without a value, outlier outside its range, partial if a part lacks, else ok."""
    lacks = F.lit(False)
    for p in parts:
        lacks = lacks | F.col(p).isNull()
    return facts.withColumn("quality", F.when(F.col(value).isNull(), "parse_fail").when(~F.col(value).between(low, high), "outlier").when(lacks, "partial").otherwise("ok"))


def first_success(tries: DataFrame, key: str, order: str, value: str, status: str) -> DataFrame:
    """The value of the first attempt that succeeded, how many were made, and the last status where none did."""
    ok = F.col(value).isNotNull()
    out = tries.groupBy(key).agg(F.min_by(value, F.when(ok, F.col(order))).alias(value), F.count(F.lit(1)).alias("attempts"), F.max_by(status, order).alias("_last"))
    return out.select(key, value, "attempts", F.when(F.col(value).isNotNull(), "ok").otherwise(F.col("_last")).alias("outcome"))


def attempt_log(tries: DataFrame, key: str, order: str, value: str, source: str, url: str, fetched: str) -> DataFrame:
    """key, value, source, attempts, outcome, log: sources tried in order until one gives a value.

    What comes after the first success was not tried. Without a success the outcome is no_source (no url at all),
    download_fail (nothing fetched) or parse_fail; log: the tries as source:status, in order.
    """
    has_url, got, ok = F.col(url).isNotNull(), F.coalesce(F.col(fetched), F.lit(False)), F.col(value).isNotNull()
    status = F.when(ok, "ok").when(~has_url, "no_source").when(~got, "download_fail").otherwise("parse_fail")
    first = tries.groupBy(key).agg(F.min(F.when(ok, F.col(order))).alias("_first"))
    made = tries.withColumn("_status", status).join(first, key).where(F.col("_first").isNull() | (F.col(order) <= F.col("_first")))
    worst = F.max(F.when(F.col("_status") == "parse_fail", 2).when(F.col("_status") == "download_fail", 1).otherwise(0))
    out = made.groupBy(key).agg(
        F.max(F.when(ok, F.col(value))).alias(value),
        F.max(F.when(ok, F.col(source))).alias(source),
        F.count(F.lit(1)).alias("attempts"),
        worst.alias("_worst"),
        F.array_sort(F.collect_list(F.struct(order, F.concat_ws(":", source, "_status").alias("t")))).alias("_log"),  # a row for each source of the chain
    )
    outcome = F.when(F.col(value).isNotNull(), "ok").otherwise(F.element_at(F.array(*map(F.lit, ("no_source", "download_fail", "parse_fail"))), F.col("_worst") + 1))
    return out.select(key, value, source, "attempts", outcome.alias("outcome"), F.array_join(F.transform("_log", lambda x: x["t"]), ",").alias("log"))


def score_links(links: DataFrame, url: str, allowed: Sequence[str], banned: Sequence[str], words: Sequence[str], id_: str | None = None, texts: Sequence[str] = (), evidence: str | None = None) -> DataFrame:
    """decision and reason for candidate links: scheme, banned hosts, document-like path, key words, the id, the host.

    With `id_` the id must stand in the url or one of the texts. A host that is not allowed passes only with the
    evidence of another column (a flag), if one is named.
    """
    host = T.url_host(F.col(url))
    low = F.lower(url)
    known = T.domain_in(host, allowed)
    proved = F.coalesce(F.col(evidence), F.lit(False)) if evidence else F.lit(False)
    out = F.when(~low.rlike("^https?://"), "scheme").when(T.domain_in(host, banned), "banned_domain").when(~known & ~proved, "unknown_domain").when(~low.contains(".pdf"), "not_a_document").when(~F.lower(F.concat_ws(" ", url, *texts)).rlike("|".join(words)), "no_keyword")
    if id_:
        out = out.when(~F.contains(F.upper(F.concat_ws(" ", url, *texts)), F.upper(id_)), "no_id")
    return links.withColumn("reason", out).withColumn("decision", F.when(out.isNull(), F.when(known, "allowlisted").otherwise("evidence")).otherwise("reject") if evidence else F.when(out.isNull(), "accept").otherwise("reject"))


def drop_missing_pages(pages: DataFrame, html: str) -> DataFrame:
    low = F.lower(html)
    return pages.where((F.trim(html) != "") & ~low.contains("sorry, no data") & ~low.rlike(r"no results .{0,80} among etfs\."))


def verify_pages(cands: DataFrame, pages: DataFrame, url: str, id_: str, html: str) -> DataFrame:
    """Candidates whose page holds the id, with the canonical link where the page has one."""
    both = cands.join(pages, url).where(F.upper(html).contains(F.upper(id_)))
    canonical = T.null_if_blank(F.regexp_extract(html, r'(?i)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1))
    return both.select(*cands.columns, F.coalesce(canonical, F.col(url)).alias("resolved_url"))


def page_listings(pages: DataFrame, key: str, html: str, venues: Mapping[str, str]) -> DataFrame:
    """key, venue_mic, ticker, trading_currency: distinct listings in markup cells of exchange, ticker and currency."""
    cell = r"<td[^>]*>\s*([^<]*?)\s*</td>\s*"
    row = r"(?is)" + cell + cell + cell
    group = lambda n: F.regexp_extract_all(html, F.lit(row), F.lit(n))
    found = pages.select(key, F.explode(F.arrays_zip(group(1).alias("e"), group(2).alias("t"), group(3).alias("c"))).alias("z"))
    known = F.create_map(*[F.lit(x) for kv in venues.items() for x in kv])
    out = found.select(key, F.try_element_at(known, F.lower(F.trim("z.e"))).alias("venue_mic"), T.ticker_norm(F.col("z.t")).alias("ticker"), T.currency_norm(F.col("z.c")).alias("trading_currency"))
    return out.where("venue_mic is not null and ticker is not null").distinct()


# Labelled fields of a factsheet in running text, one group each.
FACTSHEET = {
    "ongoing_charges": r"(?i)\bOngoing charge\b(?:\s+\d+)?\s+(\d+\.\d+)\s*%",
    "benchmark_name": r"(?i)\bIndex\s+(.+?)\s+Index currency\b",
    "replication_method": r"(?i)\bReplication method\s+(Physical|Synthetic)\b",
    "domicile_country": r"(?i)\bDomicile\s+(.+?)\s+Dividend treatment\b",
    "distribution_policy": r"(?i)\bDividend treatment\s+(Distributing|Accumulating)\b",
    "hedged": r"(?i)\bCurrency hedged\s+(Yes|No)\b",
    "ucits": r"(?i)\bUCITS compliant\s+(Yes|No)\b",
}


def factsheet_fields(docs: DataFrame, keep: Sequence[str], text: str, spec: Mapping[str, str] = FACTSHEET) -> DataFrame:
    """The labelled fields of a factsheet's text: numbers as numbers, yes and no as flags, methods in lower case."""
    plain = F.regexp_replace(text, r"(?U)\s+", " ")
    found = {name: T.squeeze(F.regexp_extract(plain, e, 1)) for name, e in spec.items()}
    flag = lambda c: F.when(F.lower(c) == "yes", 1).when(F.lower(c) == "no", 0)
    made = {"ongoing_charges": lambda c: c.try_cast("double"), "replication_method": F.lower, "hedged": flag, "ucits": flag}
    names = {"hedged": "hedged_flag", "ucits": "ucits_compliant"}
    return docs.select(*keep, *[made.get(n, lambda c: c)(c).alias(names.get(n, n)) for n, c in found.items()])


def sector_weights(pages: DataFrame, key: str, html: str, known: Column | None = None) -> DataFrame:
    """key, pos, label, sector, weight: the rows of tables whose first cells are sectors with shares in percent."""
    cells = extract_tables(pages, key, html)
    label, share = F.get("cells", F.lit(0)), F.get("cells", F.lit(1))
    rows = cells.where(F.size("cells") >= 2).select(key, F.struct("table_no", "row_no").alias("pos"), T.squeeze(label).alias("label"), T.to_percent(share).alias("weight"))
    rows = rows.where("label is not null and label <> '--' and lower(label) <> 'other' and weight is not null")
    return rows.select(key, "pos", "label", T.norm_sector(F.col("label")).alias("sector"), "weight")


def dominant_sector(weights: DataFrame, key: str) -> DataFrame:
    """key, sector_hint, sector_weight: the sector with the largest share, the first on ties."""
    order = F.struct("weight", (-F.col("pos.table_no")).alias("t"), (-F.col("pos.row_no")).alias("r"))
    return weights.groupBy(key).agg(F.max_by("sector", order).alias("sector_hint"), F.max("weight").alias("sector_weight"))


def objective_hints(c: Column) -> dict[str, Column]:
    """Equity size and style by the words of an objective."""
    low = F.lower(c)
    word = lambda w: low.rlike(rf"\b{w}\b")
    size = T.first_match([(word("large") & word("mid") & word("small"), "all_cap"), (word("large"), "large"), (word("mid"), "mid"), (word("small"), "small")])
    style = T.first_match([(low.contains("value"), "value"), (low.contains("growth"), "growth"), (low.rlike("blend|core"), "blend"), (size == "all_cap", "blend")])
    return {"equity_size_hint": size, "equity_style_hint": style}


def listing_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, isin, symbol, name, currency: rows of HTML tables whose header names an ISIN and a symbol column.

    The first row of a table is its header; cells are chosen by the header's words, rows shorter than it needs are left.
    """
    rows = extract_tables(pages, key, html)
    head = rows.where("row_no = 0").select(key, "table_no", F.transform("cells", F.lower).alias("head"))
    at = lambda *words: F.array_position(F.transform("head", lambda h: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(h, w))), True)
    spots = head.select(key, "table_no", at("isin").alias("i"), at("symbol", "ticker", "mnemonic").alias("s"), at("name", "instrument").alias("n"), at("currency").alias("c")).where("i > 0 and s > 0")
    body = rows.where("row_no > 0").join(spots, [key, "table_no"]).where(F.size("cells") >= F.greatest("i", "s"))
    cell = lambda c: F.when((F.col(c) > 0) & (F.col(c) <= F.size("cells")), T.squeeze(F.try_element_at("cells", F.col(c).cast("int"))))
    return body.select(key, T.isin_norm(cell("i")).alias("isin"), T.ticker_norm(cell("s")).alias("symbol"), cell("n").alias("name"), T.currency_norm(cell("c")).alias("currency")).where("isin is not null and symbol is not null")


#: Facts of a page that belong to a share class and not to its family.
CLASS_FACTS = ("ter", "use_of_income", "ucits_compliant", "share_class_size")


def resolve_identity(targets: DataFrame, pages: DataFrame, key: str, page: str, id_: str, name: str, facts: Sequence[str], useful: Sequence[str]) -> DataFrame:
    """key, page, match, facts: for each target the page with its id, else one of its family of names with useful facts.

    Pages are reduced to the first one of an id and of a family before the joins, so both are equi joins of single
    rows. A family match drops the facts of the share class.
    """
    some = F.coalesce(*[F.col(c).cast("string") for c in useful]).isNotNull()
    row = F.struct(F.col(page), *facts)
    exact = pages.where(F.col(id_).isNotNull()).groupBy(F.upper(id_).alias("_id")).agg(F.min_by(row, page).alias("e"))
    named = pages.where(some).withColumn("_family", T.family_signature(F.col(name))).where("_family is not null")
    family = named.groupBy("_family").agg(F.min_by(row, page).alias("f"))
    asked = targets.select(key, F.upper(id_).alias("_id"), T.family_signature(F.col(name)).alias("_family"))
    both = asked.join(exact, "_id", "left").join(family, "_family", "left").where("e is not null or f is not null")
    is_exact = F.col("e").isNotNull()
    shared = lambda c: F.when(is_exact, F.col(f"e.{c}")) if c in CLASS_FACTS else F.when(is_exact, F.col(f"e.{c}")).otherwise(F.col(f"f.{c}"))
    return both.select(key, F.when(is_exact, F.col(f"e.{page}")).otherwise(F.col(f"f.{page}")).alias(page), F.when(is_exact, "isin").otherwise("family").alias("match"), *[shared(c).alias(c) for c in facts])


def known_url(key: str, mapped: DataFrame, documents: DataFrame, candidates: DataFrame, url: str, order: str, hosts: Sequence[str]) -> DataFrame:
    """key, url, url_source: the mapped url, else the newest document's, else the newest candidate's, of given hosts."""
    here = T.domain_in(T.url_host(F.col(url)), hosts)
    newest = lambda df, name: df.where(here).groupBy(key).agg(F.max_by(url, order).alias(name))
    out = newest(mapped, "m").join(newest(documents, "d"), key, "full_outer").join(newest(candidates, "c"), key, "full_outer")
    source = T.first_match([(F.col("m").isNotNull(), "map"), (F.col("d").isNotNull(), "document"), (F.col("c").isNotNull(), "candidate")])
    return out.select(key, F.coalesce("m", "d", "c").alias(url), source.alias("url_source"))


def enrich_stage(targets: DataFrame, pages: DataFrame, key: str, url: str, text: str, source: str, asof: str, spec: Mapping[str, str] = FACTSHEET, low: float = 0.0, high: float = 3.0) -> dict[str, DataFrame]:
    """One enrichment stage: targets with their pages to cost and metadata snapshots, url map, log and KPIs.

    targets: key (queued rows). pages: key, url, text; text NULL where the download failed. Every target gives a log row
    with its status, so failures are rows as well and what succeeded stays.
    """
    joined = targets.select(key).distinct().join(pages.groupBy(key).agg(F.min_by(F.struct(url, text), F.struct(F.col(text).isNull().alias("n"), url)).alias("p")), key, "left")
    rows = factsheet_fields(joined.select(key, F.col(f"p.{url}").alias(url), F.col(f"p.{text}").alias(text)), [key, url, text], text, spec)
    fee = F.col("ongoing_charges")
    status = F.when(F.col(url).isNull(), "no_source").when(F.col(text).isNull(), "download_fail").when(fee.isNull(), "parse_fail").when(~fee.between(low, high), "outlier").otherwise("ok")
    fields = [c for c in rows.columns if c not in (key, url, text)]
    raw = F.to_json(F.struct(F.lit(source).alias("source"), F.col(url).alias("source_url"), F.struct(*[c for c in fields if c not in ("ongoing_charges", "distribution_policy", "ucits_compliant")]).alias("profile_metadata"), "distribution_policy", "ucits_compliant"))
    rows = rows.withColumns({"quality_flag": status, "asof_date": F.lit(asof), "source": F.lit(source), "raw_json": raw})
    done = rows.where("quality_flag in ('ok', 'outlier', 'parse_fail')")
    kpi = rows.groupBy("source").agg(F.count(F.lit(1)).alias("attempted"), *[F.count_if(F.col("quality_flag") == s).alias(f"n_{s}") for s in ("ok", "outlier", "parse_fail", "download_fail", "no_source")])
    return {
        "cost": done.select(key, "asof_date", "ongoing_charges", "quality_flag", "raw_json"),
        "metadata": done.select(key, "asof_date", "source", F.col(url).alias("source_url"), fee.alias("ter"), F.col("distribution_policy").alias("use_of_income"), "ucits_compliant", "quality_flag", "raw_json"),
        "url_map": done.select(key, F.lit(f"{source}_factsheet").alias("url_type"), url),
        "log": rows.select(key, "source", "asof_date", url, "quality_flag"),
        "kpi": kpi,
    }
