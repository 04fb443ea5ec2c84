"""Current state from observations: merges, reconciliation, life cycle, imputation, aliases, versions.

No table format is at hand, so a merge is a full join whose result goes to a new place; a job never overwrites what it
reads.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked

Rule = Callable[[Column, Column], Column]


def sticky(old: Column, new: Column) -> Column:
    """The new value unless it is NULL."""
    return F.coalesce(new, old)


def first_wins(old: Column, new: Column) -> Column:
    return F.coalesce(old, new)


def new_wins(old: Column, new: Column) -> Column:
    return new


def either_flag(old: Column, new: Column) -> Column:
    """1 if either is; never back to 0; NULL only if both are."""
    return F.greatest(old, new)


def merge(current: DataFrame, updates: DataFrame, keys: Sequence[str], rules: Mapping[str, Rule]) -> DataFrame:
    """Full join on the keys; each column by its rule where both sides have the row, else from the side that has it."""
    old = current.select(*keys, F.struct(*[F.col(c) for c in rules]).alias("o"), F.lit(True).alias("_old"))
    new = updates.select(*keys, F.struct(*[F.col(c) for c in rules]).alias("n"), F.lit(True).alias("_new"))
    both = old.join(new, list(keys), "full_outer")
    pick = lambda c, rule: F.when(F.col("_new").isNull(), F.col(f"o.{c}")).when(F.col("_old").isNull(), F.col(f"n.{c}")).otherwise(rule(F.col(f"o.{c}"), F.col(f"n.{c}")))
    return both.select(*keys, *[pick(c, rule).alias(c) for c, rule in rules.items()])


def merge_profile(current: DataFrame, new: DataFrame, key: str, fields: Sequence[str], needed: Sequence[str] | None = None) -> DataFrame:
    """Sticky merge: known values are never cleared; a new row needs one of `needed` fields."""
    some = F.coalesce(*[F.col(f).cast("string") for f in needed or fields]).isNotNull()
    return merge(current, new.where(some), [key], {f: sticky for f in fields})


def not_seen(listing: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the state that a run did not observe."""
    return listing.join(observed.select(*keys).distinct(), list(keys), "left_anti")


def has_active(entities: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return entities.join(rows.where("status = 'active'").select(key), key, "left_semi")


def reconcile(listing: DataFrame, observed: DataFrame, keys: Sequence[str], source: str, run_source: str) -> DataFrame:
    """The listing state after a run of one source: observed rows active, its others inactive, other sources as before.

    listing: keys, source, status. observed: keys (repeats count once).
    """
    seen = observed.select(*keys).distinct().withColumn("_seen", F.lit(True))
    both = listing.join(seen, list(keys), "full_outer")
    was = F.col("status")
    now = F.when(F.col("_seen"), "active").when(F.col(source) == run_source, "inactive").otherwise(was)
    of = F.when(F.col("_seen"), F.lit(run_source)).otherwise(F.col(source))
    return both.select(*keys, of.alias(source), now.alias("status"))


def entity_status(listing: DataFrame, key: str) -> DataFrame:
    """An entity is active while any of its listings is, whatever the source."""
    return listing.groupBy(key).agg(F.max(F.when(F.col("status") == "active", 1).otherwise(0)).alias("a")).select(key, F.when(F.col("a") == 1, "active").otherwise("inactive").alias("status"))


def diff_events(before: DataFrame, after: DataFrame, keys: Sequence[str], entity: str) -> DataFrame:
    """One row for each inserted, deactivated or reactivated entity, with its previous and new status."""
    old = before.select(*keys, F.col("status").alias("previous_status"))
    new = after.select(*keys, F.col("status").alias("new_status"))
    both = old.join(new, list(keys), "full_outer")
    kind = F.when(F.col("previous_status").isNull() & F.col("new_status").isNotNull(), "inserted").when((F.col("previous_status") == "active") & (F.col("new_status") == "inactive"), "deactivated").when((F.col("previous_status") == "inactive") & (F.col("new_status") == "active"), "reactivated")
    return both.select(F.lit(entity).alias("entity_type"), *keys, "previous_status", "new_status", kind.alias("event_type")).where("event_type is not null")


def run_ledger(source: str, asof: str, rows: Column, notes: Column, error: Column | None = None) -> list[Column]:
    """The columns of a finished run's row, for an aggregate over its observations; an error makes it a failed one."""
    status = F.lit("succeeded") if error is None else F.when(error.isNull(), "succeeded").otherwise("failed")
    return [F.lit(source).alias("source_name"), F.lit(asof).alias("asof_date"), status.alias("status"), rows.alias("rows_observed"), notes.alias("notes")]


def run_states(log: DataFrame, run: str, order: str) -> DataFrame:
    """Of an append-only log of run rows (running, then succeeded or failed) the last of each run."""
    rest = [c for c in log.columns if c != run]
    return log.groupBy(run).agg(F.max_by(F.struct(*rest), order).alias("r")).select(run, "r.*")


def merge_instruments(current: DataFrame, feed: DataFrame, order: str) -> DataFrame:
    """Instruments after a feed, by isin: isin, instrument_name, ucits_flag, issuer_id, status, event.

    The first known name and issuer stay, a compliance flag only rises, and a row that changes by that is active again;
    of repeated feed rows the first known values by `order` count. event: inserted, updated, reactivated or NULL.
    """
    name = F.nullif(F.col("instrument_name"), F.lit(""))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col(order)))
    new = feed.where("isin is not null").groupBy("isin").agg(first(name).alias("name"), F.max("ucits_flag").alias("flag"), first(F.col("issuer_id")).alias("house"), F.lit(True).alias("_new"))
    both = current.withColumn("_old", F.lit(True)).join(new, "isin", "full_outer")
    after = {
        "instrument_name": F.coalesce(name, F.col("name")),
        "ucits_flag": either_flag(F.col("ucits_flag"), F.col("flag")),
        "issuer_id": F.coalesce("issuer_id", "house"),
    }
    changed = F.lit(False)
    for c, v in after.items():
        changed = changed | ~v.eqNullSafe(F.col(c))
    event = F.when(F.col("_old").isNull(), "inserted").when(changed & (F.coalesce("status", F.lit("")) != "active"), "reactivated").when(changed, "updated")
    return both.select("isin", *[v.alias(c) for c, v in after.items()], F.when(event.isNotNull(), "active").otherwise(F.col("status")).alias("status"), event.alias("event"))


def merge_listings(current: DataFrame, feed: DataFrame, source: str, asof: str, order: str) -> DataFrame:
    """Listings after a feed, by instrument, venue and ticker: new known names and currencies win, primary is never lost.

    Observed rows become active and carry the feed's source and date; of repeated feed rows the last known values by
    `order` count. event: inserted, updated, reactivated or NULL.
    """
    keys = ["instrument_id", "venue_mic", "ticker"]
    last = lambda c: F.max_by(c, F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.col(order)))
    new = feed.groupBy(*keys).agg(last("exchange_name").alias("e"), last("trading_currency").alias("t"), F.max("primary_flag").alias("p"), F.lit(True).alias("_new"))
    both = current.withColumn("_old", F.lit(True)).join(new, keys, "full_outer")
    flag = F.when((F.col("primary_flag") == 1) | (F.col("p") == 1), 1).otherwise(0)
    after = {
        "exchange_name": F.coalesce("e", "exchange_name"),
        "trading_currency": F.coalesce("t", "trading_currency"),
        "primary_flag": flag,
        "status": F.lit("active"),
        "data_source": F.lit(source),
        "asof_date": F.lit(asof),
    }
    changed = F.lit(False)
    for c, v in after.items():
        changed = changed | ~v.eqNullSafe(F.col(c))
    event = F.when(F.col("_new"), F.when(F.col("_old").isNull(), "inserted").when(changed & (F.coalesce("status", F.lit("")) != "active"), "reactivated").when(changed, "updated"))
    return both.select(*keys, *[F.when(F.col("_new"), v).otherwise(F.col(c)).alias(c) for c, v in after.items()], event.alias("event"))


def merge_issuers(issuer: DataFrame, names: DataFrame) -> DataFrame:
    """issuer_id, issuer_name, normalized_name, domain after names (name, domain) were looked up or added.

    A name is known if it is some issuer's normalized name, else if it is its name; a domain is filled once.
    """
    wanted = names.where(F.trim("name") != "").groupBy("name").agg(F.min("domain").alias("new_domain"))
    by = lambda c: issuer.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("name")).agg(F.min("issuer_id").alias(f"by_{c}"))
    found = wanted.join(by("normalized_name"), "name", "left").join(by("issuer_name"), "name", "left").withColumn("issuer_id", F.coalesce("by_normalized_name", "by_issuer_name"))
    filled = issuer.join(found.where("issuer_id is not null").groupBy("issuer_id").agg(F.min("new_domain").alias("new_domain")), "issuer_id", "left")
    old = filled.select("issuer_id", "issuer_name", "normalized_name", F.coalesce("domain", "new_domain").alias("domain"))
    fresh = found.where("issuer_id is null").select(F.col("name").alias("issuer_name"), "new_domain")
    ids = assign_ids(fresh, "issuer_name", "issuer_id", issuer.select("issuer_name", "issuer_id"))
    added = fresh.join(ids, "issuer_name").select("issuer_id", "issuer_name", F.col("issuer_name").alias("normalized_name"), F.col("new_domain").alias("domain"))
    return old.unionByName(added)


def apply_aliases(issuer: DataFrame, alias: DataFrame) -> DataFrame:
    """issuer_id, issuer_name, target_id, canonical_name, domain: each issuer by the alias table, else itself.

    alias: alias, issuer_id; the smallest id where an alias is repeated.
    """
    to = alias.groupBy(F.col("alias").alias("issuer_name")).agg(F.min("issuer_id").alias("target_id"))
    known = issuer.select(F.col("issuer_id").alias("target_id"), F.coalesce("normalized_name", "issuer_name").alias("canonical_name"), "domain")
    rows = issuer.select("issuer_id", "issuer_name").join(to, "issuer_name", "left").withColumn("target_id", F.coalesce("target_id", "issuer_id"))
    return rows.join(known, "target_id", "left").select("issuer_id", "issuer_name", "target_id", "canonical_name", "domain")


def merge_taxonomy(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The taxonomy after a classification: new rows replace old ones whole, rows that left the universe are kept."""
    return merge(current, new, [key], {c: new_wins for c in new.columns if c != key})


def set_distribution(profile: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Distribution policies overwritten by the last writer, unlike the sticky merge."""
    return merge(profile, new, [key], {"distribution_policy": new_wins})


def seed_instruments(current: DataFrame, seeds: DataFrame, url: str = "url", default: str = "UCITS ETF") -> DataFrame:
    """Instruments after seeds (isin, url, issuer_id): only gaps are filled; a new one's name comes from its page's url."""
    from ..functions.text import name_from_url

    named = seeds.select("isin", name_from_url(F.col(url), default=default).alias("instrument_name"), F.lit(1).alias("ucits_flag"), "issuer_id", F.lit("active").alias("status"))
    once = named.groupBy("isin").agg(*[F.min(c).alias(c) for c in named.columns if c != "isin"])
    rules = dict.fromkeys(("instrument_name", "ucits_flag", "issuer_id"), first_wins) | {"status": first_wins}
    return merge(current, once, ["isin"], rules)


def fill_currency(listing: DataFrame, feed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blank currencies of primary listings filled from a secondary feed; filled says where."""
    from ..functions.text import null_if_blank

    new = feed.groupBy(*keys).agg(F.min(F.upper(null_if_blank(F.col("trading_currency")))).alias("_new"))
    wanted = (F.coalesce("primary_flag", F.lit(0)) == 1) & null_if_blank(F.col("trading_currency")).isNull()
    both = listing.join(new, list(keys), "left").withColumn("filled", wanted & F.col("_new").isNotNull())
    return both.withColumn("trading_currency", F.when(F.col("filled"), F.col("_new")).otherwise(F.col("trading_currency"))).drop("_new")


def backfill_issuers(instrument: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Issuer names for instruments without an issuer, by the first word rule of their name, with the tag of the source."""
    from ..functions.rules import classify

    rows = instrument.where("issuer_id is null").withColumn("issuer_name", classify(F.upper("instrument_name"), rules))
    return rows.where("issuer_name is not null").select("instrument_id", "issuer_name", F.lit("stage1").alias("alias_note"), F.lit("name_heuristic").alias("issuer_source"))


def refresh_types(instrument: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Instruments with types and flags by name, and one row of how many changed, field by field; NULL equals NULL."""
    from ..functions.text import type_flags

    new = type_flags(F.col("instrument_name"))
    both = instrument.withColumns({f"_new_{c}": v for c, v in new.items()})
    counts = [F.count_if(~F.col(c).eqNullSafe(F.col(f"_new_{c}"))).alias(f"changed_{c}") for c in new]
    after = both.withColumns({c: F.col(f"_new_{c}") for c in new}).drop(*[f"_new_{c}" for c in new])
    return after, both.agg(F.count(F.lit(1)).alias("total"), *counts)


def impute(rows: DataFrame, value: str, modes: DataFrame, keys: Sequence[str], mode: str, quality: str) -> DataFrame:
    """Fill missing values with the mode of their keys; quality says ok, imputed or missing."""
    joined = rows.join(modes, list(keys), "left")
    said = F.when(F.col(value).isNotNull(), "ok").when(F.col(mode).isNotNull(), "imputed").otherwise("missing")
    return joined.withColumn(quality, said).withColumn(value, F.coalesce(value, mode)).drop(mode)


def assign_ids(names: DataFrame, name: str, id_: str, existing: DataFrame) -> DataFrame:
    """New names with ids above the existing ones, in the names' order; existing names keep theirs.

    Ids are exact ranks of the names dealt out by ranges, so no task numbers all of them, however many begin alike.
    """
    known = existing.select(name, id_)
    top = known.agg(F.coalesce(F.max(id_), F.lit(0)).alias("_top"))  # one row
    fresh = names.select(name).where(F.col(name).isNotNull()).distinct().join(known, name, "left_anti")
    out = ranked(fresh, name, name="_rank").withColumn("_one", F.lit(1)).join(F.broadcast(top.withColumn("_one", F.lit(1))), "_one")
    return known.unionByName(out.select(name, (F.col("_top") + F.col("_rank")).cast("long").alias(id_)))


def alias_targets(rows: DataFrame, bucket: Column, id_: str, name: str) -> DataFrame:
    """Rows of one canonical bucket point to its smallest id; rows without a bucket to none.

    The smallest ids are a grouped minimum, pre-aggregated where the rows are, so no bucket lies in one task.
    """
    out = rows.select(F.col(name).alias("alias"), bucket.alias("canonical"), F.col(id_).alias("own_id")).where("canonical is not null")
    return out.join(out.groupBy("canonical").agg(F.min("own_id").alias("target_id")), "canonical").select("alias", "canonical", "own_id", "target_id")


def version_documents(current: DataFrame, new: DataFrame, keys: Sequence[str], url: str, digest: str) -> DataFrame:
    """New documents against the stored: same digest is reused, another digest gets a url of its own."""
    old = current.select(*keys, F.col(url), F.col(digest).alias("_old"))
    both = new.join(old, [*keys, url], "left")
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_old") == F.col(digest), "reuse").otherwise("version")
    named = F.when(F.col("_old").isNull() | (F.col("_old") == F.col(digest)), F.col(url)).otherwise(F.concat(url, F.lit("#sha256="), F.substring(digest, 1, 12)))
    return both.withColumn("stored_url", named).withColumn("action", action).drop("_old")


def resolve_flag(snapshot: Column, by_name: Column, existing: Column) -> tuple[Column, Column]:
    """A compliance flag and where it comes from: snapshot, then the name, then what is stored."""
    value = F.coalesce(snapshot, by_name, existing)
    source = F.when(snapshot.isNotNull(), "snapshot").when(by_name.isNotNull(), "name_pattern").when(existing == 1, "legacy_seed")
    return value, source


def normalize_issuers(issuer: DataFrame, known: Sequence[tuple[str, str, str]]) -> DataFrame:
    """issuer_id, issuer_name, normalized_name, domain, target_id: canonical names of known issuers, cleaned ones else.

    The first rule whose words stand in the name counts. Issuers of one canonical name point to the smallest id; the
    domain of others is cleared.
    """
    from ..functions.text import clean_issuer, first_match

    up = F.upper("issuer_name")
    rows = issuer.select("issuer_id", "issuer_name", first_match([(up.rlike(w), n) for n, _, w in known]).alias("canonical"))
    domain = first_match([(F.col("canonical") == n, d) for n, d, _ in known])
    least = rows.where("canonical is not null").groupBy("canonical").agg(F.min("issuer_id").alias("target_id"))
    out = rows.join(F.broadcast(least), "canonical", "left")  # a row for each known issuer
    return out.select("issuer_id", "issuer_name", F.coalesce("canonical", clean_issuer(F.col("issuer_name"))).alias("normalized_name"), domain.alias("domain"), F.coalesce("target_id", "issuer_id").alias("target_id"))
