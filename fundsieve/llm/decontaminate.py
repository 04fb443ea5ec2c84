"""Benchmark decontamination: size-partitioned MinHash containment search (operator 2), DataFrame functions only.

Texts are sets of five-word shingles, as 64-bit hashes. An item of n shingles is contained in a document that holds at
least `need` = ceil(0.8 n) of them, however long the document. Items are partitioned by size (powers of two of n).
An item's MinHash sketch is its n - need + 1 smallest hashes: a document that contains the item lacks at most
n - need of its shingles, so it holds one of the sketch, and the search misses nothing. Of a document only the
hashes up to its partitions' largest sketch value take part (the document's own MinHash sketch, whose size follows
the document's), and only items whose `need` the document's size reaches. Candidate pairs are verified by exact
containment of the shingles as strings.

Words are runs of letters, marks and digits, in lower case. A text of one to four words is one shingle, so an item of
fewer than five words is found only in a document that consists of these words.

Defined results: null and empty texts, items and documents, contain nothing and are contained in nothing. A null
doc_id or item_id is in no pair. A shingle that very many documents hold meets only the items that hold it. Repeated
rows count once; of rows with one id and several texts a pair is reported
once, with its largest containment. Extra columns are not read. Empty tables give no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, settled, small

SHINGLE, LEAST = 5, 0.8
#: Candidate pairs, of two ids each, that are broadcast; more are joined.
PAIR_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")


def with_shingles(df: DataFrame, text: str, name: str, make, size: int = SHINGLE) -> DataFrame:
    """df with make(words of one shingle) for every shingle of a text; a shorter text is one shingle.

    Words and shingles are settled, so that they are made once a row and not once a shingle.
    """
    of = F.col("_words")
    each = F.transform(F.sequence(F.lit(0), F.size(of) - size), lambda i: make(*[F.get(of, i + k) for k in range(size)]))
    short = F.array(make(*[F.get(of, F.lit(k)) for k in range(size)]))
    found = F.when(F.size(of) >= size, each).when(F.size(of) > 0, short).otherwise(F.array().cast(each_type(make)))
    return settled(settled(df, "_words", words(F.col(text))), name, found).drop("_words")


def each_type(make) -> str:
    return "array<bigint>" if make is hashed else "array<string>"


def hashed(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def joined(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def sketches(items: DataFrame, least: float = LEAST) -> DataFrame:
    """item_id, text, n, need, part (size partition) and sketch, of items with words."""
    sets = with_shingles(items, "text", "h", hashed).withColumn("h", F.array_distinct("h")).withColumn("n", F.size("h")).where("n > 0")
    sized = sets.withColumn("need", F.ceil(F.col("n") * F.lit(least)).cast("int")).withColumn("part", F.floor(F.log2("n")).cast("int"))
    return sized.withColumn("sketch", F.slice(F.sort_array("h"), F.lit(1), F.col("n") - F.col("need") + 1)).drop("h")


def contained(docs: DataFrame, items: DataFrame, least: float = LEAST, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, n_common, n_item, containment of each pair at `least` or more of the item's shingles."""
    docs = docs.select(F.col(doc_key).alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    items = items.select(F.col(item_key).alias("item_id"), F.col(text).cast("string").alias("text")).where("item_id is not null")
    sets = durable(sketches(items, least), "items")
    parts = sets.groupBy("part").agg(F.max(F.element_at("sketch", -1)).alias("top"), F.min("need").alias("smallest"), F.count(F.lit(1)).alias("items"), F.sum(F.size("sketch")).alias("rows")).collect()  # a row for each power of two
    postings = small(sets.select("item_id", "need", F.explode("sketch").alias("h")), sum(p["rows"] for p in parts))
    # a document's sketch reaches as far as those of the partitions whose smallest item it can hold
    reach = F.greatest(F.lit(-(2**63)), *[F.when(F.col("size") >= p["smallest"], p["top"]) for p in parts]) if parts else F.lit(-(2**63))
    shingled = with_shingles(docs, "text", "all", hashed).select("doc_id", "all").withColumn("size", F.size("all"))
    shingled = settled(shingled, "reach", reach)
    sketched = shingled.select("doc_id", "size", F.explode_outer(F.filter("all", lambda h: h <= F.col("reach"))).alias("h"))
    pairs = durable(sketched.join(postings, "h").where("size >= need").select("doc_id", "item_id").distinct(), "candidates")
    # few documents hold an item: the pairs go to the documents, which stay where they are, and the items to the pairs
    there = docs.join(small(pairs, pairs.count(), PAIR_ROWS), "doc_id")
    known = sets.select("item_id", F.col("text").alias("item_text"), "need", "n")
    wanted = there.join(small(known, sum(p["items"] for p in parts)), "item_id")
    both = with_shingles(with_shingles(wanted, "text", "s", joined), "item_text", "t", joined)
    common = both.select("doc_id", "item_id", "need", F.col("n").alias("n_item"), F.size(F.array_intersect("t", "s")).alias("n_common"))
    share = F.col("n_common") / F.col("n_item")
    of_texts = F.struct(share.alias("containment"), F.col("n_common").cast("long").alias("n_common"), F.col("n_item").cast("long").alias("n_item"))
    best = common.where("n_common >= need").groupBy("doc_id", "item_id").agg(F.max(of_texts).alias("best"))  # of one text and one item's text
    return best.select("doc_id", "item_id", "best.n_common", "best.n_item", "best.containment")


#: The same pairs in SQL, without sketches.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT row_number() OVER () AS r, item_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
ds AS (SELECT DISTINCT r, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
si AS (SELECT DISTINCT r, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM i),
n AS (SELECT r, count(*) AS n_item FROM si GROUP BY r),
c AS (SELECT ds.r AS dr, ds.id AS doc_id, si.r AS ir, si.id AS item_id, count(*) AS n_common FROM ds JOIN si ON ds.s = si.s GROUP BY ALL),
p AS (SELECT doc_id, item_id, n_common, n_item, n_common::DOUBLE / n_item AS containment FROM c JOIN n ON n.r = c.ir WHERE n_common >= ceil(n_item * 0.8::DOUBLE))
SELECT doc_id, item_id, n_common, n_item, containment FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY containment DESC, n_common DESC, n_item DESC) = 1
"""
