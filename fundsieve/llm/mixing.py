"""Mixing sources to target weights by systematic sampling (operator 11), DataFrame functions only.

A source's target is its share of all words by weight, but at most CAP times its own words; what it cannot take goes to
the other sources by weight, until none is above. A document's expected copies are its source's target over the
source's words at first. Within a source these are summed up from document to document, one random offset is added, and a
document is emitted once for each integer that its part of the sum crosses. Documents are ordered by size from the largest on, and
the expected copies of each class of sizes make up for what larger ones have taken more or less than expected, so what
is taken in the end differs from the target by about one small document.

The prefix sum needs no task that holds a source. Sizes fall into classes (sixteen a power of two, in order), a class
into blocks by a hash of the id, about a quarter of the root of its documents' number of them; counts by block are
summed over the blocks of a class, and the documents of one block are summed in one task, in rows of numbers without
texts. Sums are whole numbers, in units of 2**-28 copies.

Defined results: a null text has size 0; documents without words are not taken and have no part in the sum. A null
source is a source of its own, the last. Targets are zero where there are no words. Repeated rows and ids are sampled
each on its own, in the order of id and text; rows alike in both are interchangeable. Null ids come first. Reruns
agree, whatever the partitions. Extra columns stay, but for those that have the name of a new one. Empty tables give
empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fundsieve.operators.ranks import ranked

from .common import durable, settled, small

#: Weights of the sources by code point, repeating; times that a source may be taken; seed of offsets and blocks.
WEIGHTS, CAP, SEED = (5, 2, 1), 3, 2024
#: Columns that mix() adds; those of the documents with these names are replaced.
ADDED = ("size", "source_size", "target", "copies")
#: Bits after the point in sums of copies: up to 10**10 documents a source stay within 63 bits.
BITS = 28
#: The share of a source's words, of its smallest documents, that keep the expected copies of those before.
KEPT = 0.05
#: Hash values that blocks are made of, in hexadecimal digits.
DIGITS = 3


def size_of(text: Column) -> Column:
    r"""The runs of [^\x20\x09-\x0D] in a text."""
    whole = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(whole == "", 0).otherwise(F.size(F.split(whole, r"[\x20\x09-\x0D]+"))).cast("long")


def marked(docs: DataFrame, key: str, source: str, text: str, seed: int) -> DataFrame:
    """docs with size, _source (never null, in order), _class (of sizes, in order) and _hash."""
    named = F.when(F.col(source).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))
    drawn = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256), 1, DIGITS), 16, 10).cast("int")
    sized = settled(docs, "size", size_of(F.col(text).cast("string"))).withColumns({"_source": named, "_hash": drawn})
    octave = sized.withColumn("_octave", F.length(F.bin("size")))
    sixteenth = F.expr("shiftright(shiftleft(size, 4), _octave - 1)") % 16
    return octave.withColumn("_class", F.when(F.col("size") > 0, F.col("_octave") * 16 + sixteenth).otherwise(0).cast("int")).drop("_octave")


def targets(sources: DataFrame, weights=WEIGHTS, cap: int = CAP, share: float = 1.0) -> DataFrame:
    """sources (_source, source_size) with weight and target.

    The water level (words a unit of weight) rises in rounds until no further source is at its cap; each round is one
    aggregate over the sources. Sums are whole numbers, so the level does not depend on their order.
    """
    place = ((F.col("_rank") - 1) % len(weights) + 1).cast("int")
    weighed = ranked(sources, "_source", name="_rank").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place).cast("long"))
    weighed = durable(weighed.drop("_rank"), "mix-weights")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    most = F.col("source_size") * cap
    left, of, capped = int(total * share), None, -1
    full = F.lit(False)
    while True:
        row = weighed.agg(F.count_if(full).alias("capped"), F.sum(F.when(full, most).otherwise(0)).alias("used"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("of")).first()
        if row.capped == capped or not row["of"]:
            break
        capped, left, of = row.capped, int(total * share) - row.used, row["of"]
        full = F.col("weight") * F.lit(left) > most * F.lit(of)
    open_share = F.col("weight") * F.lit(left) / F.lit(of or 1)
    return weighed.withColumn("target", F.when(full, most.cast("double")).otherwise(open_share))


def rates(classes: DataFrame, aimed: DataFrame, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """_source, source_size, target, _class, _copies and _before of each class of sizes that has words.

    _copies are the expected copies of one document of the class, _before what comes before its first one in the sum of
    its source, the random offset included. The classes of a source, some hundreds, are gone through from the largest
    documents on: each takes of what is left of the target its part of what is left of the words, so what large
    documents have taken more or less is made up for by the smaller ones. The last KEPT of the words keep their rate.
    """
    each = F.struct("_class", "n", "words")
    listed = classes.where("_class > 0").groupBy("_source").agg(F.sort_array(F.collect_list(each), asc=False).alias("classes")).join(aimed, "_source")
    offset = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), "_source"), 256), 1, BITS // 4), 16, 10).cast("long")
    none = F.array().cast("array<struct<_class:int,_copies:bigint,_before:bigint>>")
    start = F.struct(offset.alias("upto"), F.lit(0.0).alias("taken"), F.col("source_size").alias("left"), F.lit(0.0).alias("rate"), none.alias("found"))

    def step(state, c):
        aim = F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), (F.col("target") - state["taken"]) / state["left"]))
        aim = F.when(F.col("target") >= F.col("source_size") * cap, float(cap)).otherwise(aim)
        rate = F.when(state["left"] >= F.col("source_size") * F.lit(KEPT), aim).otherwise(state["rate"])
        copies = F.floor(rate * (1 << BITS)).cast("long")
        upto = state["upto"] + c["n"] * copies
        got = F.shiftright(upto, BITS) - F.shiftright(state["upto"], BITS)
        found = F.struct(c["_class"].alias("_class"), copies.alias("_copies"), state["upto"].alias("_before"))
        taken = state["taken"] + got.cast("double") * c["words"].cast("double") / c["n"]
        return F.struct(upto.alias("upto"), taken.alias("taken"), (state["left"] - c["words"]).alias("left"), rate.alias("rate"), F.concat(state["found"], F.array(found)).alias("found"))

    folded = listed.select("_source", F.explode(F.aggregate("classes", start, step, lambda x: x["found"])).alias("c"))
    return folded.select("_source", "c.*")


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, share: float = 1.0, seed: int = SEED, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs with size, source_size, target (of the source) and copies: how often the mix takes each document."""
    plain = {name: f"c{i}" for i, name in enumerate(docs.columns)}  # so that no column of docs has the name of a new one
    rows = marked(docs.toDF(*plain.values()), plain[key], plain[source], plain[text], seed)
    fine = durable(rows.groupBy("_source", "_class", "_hash").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "mix-counts")
    classes = fine.groupBy("_source", "_class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    aimed = targets(classes.groupBy("_source").agg(F.sum("words").alias("source_size")), weights, cap, share)
    parts = classes.select("_source", "_class", F.ceil(F.sqrt("n") / 4).cast("int").alias("_parts"))
    known = parts.join(rates(classes, aimed, cap, seed), ["_source", "_class"], "left").join(aimed, "_source")
    known = durable(known.withColumn("_copies", F.coalesce("_copies", F.lit(0))), "mix-classes")
    of_block = lambda df: df.withColumn("_block", F.col("_hash") % F.col("_parts"))
    counts = of_block(fine.join(known.select("_source", "_class", "_parts", "_copies", "_before"), ["_source", "_class"]))
    blocks = counts.groupBy("_source", "_class", "_block", "_copies", "_before").agg(F.sum("n").alias("n"))
    earlier = W.partitionBy("_source", "_class").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    since = F.coalesce("_before", F.lit(0)) + F.col("_copies") * F.coalesce(F.sum("n").over(earlier), F.lit(0))
    blocks = durable(blocks.select("_source", "_class", "_block", since.alias("_since")), "mix-blocks")
    there = rows.withColumn("_text", F.xxhash64(F.col(plain[text]).cast("string"))).join(small(known.drop("_before"), known.count()), ["_source", "_class"])
    there = of_block(there).join(small(blocks, blocks.count()), ["_source", "_class", "_block"])
    order = W.partitionBy("_source", "_class", "_block").orderBy(F.desc("size"), "_hash", F.asc_nulls_first(plain[key]), "_text")
    upto = F.col("_since") + F.sum("_copies").over(order.rowsBetween(W.unboundedPreceding, 0))
    summed = there.withColumn("_upto", upto).withColumn("copies", F.shiftright("_upto", BITS) - F.shiftright(F.col("_upto") - F.col("_copies"), BITS))
    return summed.select(*[F.col(c).alias(name) for name, c in plain.items() if name not in ADDED], *ADDED)


def emitted(mixed: DataFrame) -> DataFrame:
    """The documents of mix() that are taken, each as many times as it is, with copy from 1."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))


#: The same in SQL, with one window over all documents of a source.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS s FROM documents),
t AS (SELECT s, sum(size)::BIGINT AS source_size, ([5, 2, 1])[(row_number() OVER (ORDER BY s) - 1) % 3 + 1]::BIGINT AS weight FROM d GROUP BY s),
levels(n, level_of, level_by) AS (
    SELECT 0, sum(source_size)::BIGINT, sum(weight)::BIGINT FROM t
    UNION ALL
    SELECT n + 1, (SELECT sum(source_size) - coalesce(sum(3 * source_size) FILTER (WHERE weight * l.level_of > 3 * source_size * l.level_by), 0) FROM t)::BIGINT,
        (SELECT coalesce(sum(weight) FILTER (WHERE weight * l.level_of <= 3 * source_size * l.level_by), 0) FROM t)::BIGINT
    FROM levels l WHERE n < (SELECT count(*) FROM t) AND level_by > 0),
level AS (SELECT level_of, level_by FROM levels WHERE level_by > 0 ORDER BY n DESC LIMIT 1),
a AS (SELECT s, source_size, CASE WHEN weight * level_of > 3 * source_size * level_by THEN (3 * source_size)::DOUBLE ELSE (weight * level_of)::DOUBLE / level_by END AS target FROM t, level),
k AS (SELECT doc_id, s, size, CASE WHEN size > 0 THEN len(bin(size)) * 16 + ((size << 4) >> (len(bin(size)) - 1)) % 16 ELSE 0 END AS class, ('0x' || substr(sha256('2024:' || doc_id), 1, 3))::INT AS h FROM d),
c AS (SELECT s, class, count(*) AS n, sum(size)::BIGINT AS words, row_number() OVER (PARTITION BY s ORDER BY class DESC) AS i FROM k WHERE size > 0 GROUP BY s, class),
f AS (
    SELECT s, 0::BIGINT AS i, 0 AS class, 0::BIGINT AS copies, 0::BIGINT AS since, ('0x' || substr(sha256('2024:' || s), 1, 7))::BIGINT AS upto, 0::DOUBLE AS taken, source_size AS left_over, 0::DOUBLE AS rate, source_size, target FROM a
    UNION ALL
    SELECT s, i, class, e, upto, upto + n * e, taken + ((upto + n * e) // 268435456 - upto // 268435456)::DOUBLE * words::DOUBLE / n, left_over - words, new, source_size, target
    FROM (SELECT *, floor(new * 268435456)::BIGINT AS e FROM (SELECT f.s, c.i, c.class, c.n, c.words, upto, taken, left_over, source_size, target,
        CASE WHEN left_over < source_size * 0.05::DOUBLE THEN rate WHEN target >= source_size * 3 THEN 3 ELSE greatest(0, least(3, (target - taken) / left_over)) END::DOUBLE AS new
        FROM f JOIN c ON c.s = f.s AND c.i = f.i + 1))),
b AS (SELECT *, h % ceil(sqrt(count(*) OVER (PARTITION BY s, class)) / 4)::INT AS block FROM k),
r AS (SELECT doc_id, size, b.s, copies, since + copies * row_number() OVER (PARTITION BY b.s, b.class ORDER BY block, size DESC, h, doc_id) AS upto FROM b LEFT JOIN f ON f.s = b.s AND f.class = b.class AND f.i > 0)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE (upto // 268435456 - (upto - copies) // 268435456) * size END::BIGINT AS taken FROM r JOIN a USING (s)
"""
