"""Importance resampling towards a target distribution (operator 13): array-scored weights, sorted by regular sampling.

Features are runs of words, hashed into buckets. What a bucket gains is the logarithm of its share in the target texts
over its share in all documents; these gains are one array of BUCKETS numbers that goes to all tasks, and a document's
weight is the sum over its features. With Gumbel noise added to the weights, the highest scores are a sample without
replacement by weight.

Ranks come from parallel sorting by regular sampling. Every partition of scored rows is a run: it is sorted where it
lies and numbered as it is written. Every so many rows of each run are samples, and regular places among the sorted
samples are the splitters. Rows go to the segment between two splitters, each segment is sorted by itself, and a row's
rank is its place there and the counts of the segments before. The order ends with the number that a row has from its
run, so no two rows are equal and no score, however frequent, fills a segment. Segments beyond the last drawn rank are
counted and not exchanged.

Defined results: a null text has no words. A null id counts as an empty one in the noise and comes last among equal
scores. Repeated rows are scored and ranked each on its own. Extra columns are not read. Empty tables: no documents
give no rows; without target texts all gains follow from t = T = 0.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Memo
from .common import durable

#: Words of a run, buckets, seed of the noise, words that a drawn document has at least, documents drawn of a hundred.
RUN, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: Samples a segment for the splitters, besides one for each run: they are sorted on the driver.
SAMPLES = 64
#: Rows of a segment, on average; there are at least as many segments as shuffle partitions.
SEGMENT_ROWS = 1_000_000
#: Words: what is not ASCII other than letters and digits.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bits of a monotonically increasing id that count within its partition.
WITHIN = 33


def words(text: str | None) -> list[bytes]:
    """The words of a text with A-Z in lower case, in UTF-8; bytes.lower is the ASCII rule asked for."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def features(ws: list[bytes], run: int = RUN) -> list[bytes]:
    """All runs of 1 to `run` consecutive words."""
    return [b" ".join(ws[i : i + k]) for k in range(1, run + 1) for i in range(len(ws) - k + 1)] if run > 1 else ws


def bucket_counts(texts: DataFrame, run: int = RUN, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """bucket, n: features of all texts."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            found: Counter = Counter()
            for t in batch.column(0).to_pylist():
                found.update(features(words(t), run))
            at = np.fromiter((zlib.crc32(f) % buckets for f in found), np.int64, len(found))
            np.add.at(total, at, np.fromiter(found.values(), np.int64, len(found)))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    return texts.select(F.col(text).cast("string")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket in thousandths, from the bucket counts of all documents and of the target texts."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for row in source.withColumn("of", F.lit(0)).unionByName(target.withColumn("of", F.lit(1))).collect():  # `buckets` rows each at most
        (t if row["of"] else s)[row.bucket] = row.n
    many, few = int(s.sum()) + buckets, int(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log((y + 1) * many / ((x + 1) * few))) for x, y in zip(s.tolist(), t.tolist())], np.int64)


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score."""
    of = gains(bucket_counts(docs, run, buckets, text), bucket_counts(target, run, buckets, text), buckets)
    sent = docs.sparkSession.sparkContext.broadcast(of)  # an array of `buckets` numbers

    def weigh(batches):
        of = sent.value.tolist()
        gain = Memo(lambda f: of[zlib.crc32(f) % buckets])
        for batch in batches:
            found = [words(t) for t in batch.column(1).to_pylist()]
            made = [features(ws, run) for ws in found]
            sums = [sum(map(gain.__getitem__, fs)) for fs in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (map(len, found), map(len, made), sums))], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    weighed = rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    return weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def ranked_by_sampling(rows: DataFrame, quota: Column, highest: str = "score", then: str = "doc_id", drawn: str = "drawn") -> DataFrame:
    """rows with rank: places among those that are `drawn`, by `highest` descending, then `then`, null beyond the quota.

    quota: an expression of n, the number of rows that are `drawn`.
    """
    order = [F.desc(drawn), F.desc(highest), F.asc_nulls_last(then)]
    runs = durable(rows.sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()), "runs")
    n, most = runs.agg(F.count_if(drawn).alias("n")).select("n", quota.cast("long")).first()
    segments = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / SEGMENT_ROWS))
    keys = [-F.col(highest), F.col(then).isNull().cast("long"), F.coalesce(F.col(then), F.lit(0)), F.col("row")]
    keys = [k.cast("long").alias(f"k{i}") for i, k in enumerate(keys)]
    stride = max(1, n // (SAMPLES * segments))
    within = F.col("row").bitwiseAND((1 << WITHIN) - 1)
    samples = runs.where(F.col(drawn) & (within % stride == stride // 2)).select(*keys).toPandas().to_numpy(np.int64).reshape(-1, 4).T
    samples = samples[:, np.lexsort(samples[::-1])]
    sent = runs.sparkSession.sparkContext.broadcast(samples[:, np.unique(np.arange(1, segments) * samples.shape[1] // segments)] if samples.size else samples)
    names = runs.columns

    def split(batches):
        """A row's segment: the number of splitters before it, from its place among them and the rows of the batch."""
        cuts = sent.value
        for batch in batches:
            mine = np.stack([batch.column(len(names) + i).to_numpy() for i in range(4)])
            both = np.concatenate([cuts, mine], axis=1)
            # a splitter is a row itself and goes before it
            at = np.lexsort((np.arange(both.shape[1]) >= cuts.shape[1], *both[::-1]))
            segment = np.empty(both.shape[1], np.int64)
            segment[at] = np.cumsum(at < cuts.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(segment[cuts.shape[1] :])], [*names, "segment"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema)
    dealt = durable(runs.where(drawn).select("*", *keys).mapInArrow(split, f"{schema}, segment long"), "segments")
    before, counts = 0, []
    for segment, size in sorted(tuple(r) for r in dealt.groupBy("segment").count().collect()):  # `segments` rows at most
        counts.append((segment, before))
        before += size
    met = [(s, b) for s, b in counts if b < most]
    offsets = F.broadcast(runs.sparkSession.createDataFrame(met, "segment long, before long"))
    merged = Window.partitionBy("segment").orderBy(F.desc(highest), F.asc_nulls_last(then), "row")
    place = F.row_number().over(merged) + F.col("before")
    reached = dealt.join(offsets, "segment").withColumn("rank", place.cast("long"))
    reached = reached.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).select(*names, "rank")
    gone = F.col("segment").isin([s for s, _ in met]) if met else F.lit(False)
    rest = dealt.where(~gone).select(*names).unionByName(runs.where(~F.col(drawn))).withColumn("rank", F.lit(None).cast("long"))
    return reached.unionByName(rest).drop("row")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, run: int = RUN, buckets: int = BUCKETS, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document; rank is null for those that are not drawn.

    Of the documents with `least_words` or more, `percent` of a hundred are drawn, rounded down.
    """
    rows = scored(docs, target, run, buckets, seed, key, text).withColumn("drawn", F.col("n_words") >= least_words)
    return ranked_by_sampling(rows, F.expr(f"{percent} * n div 100")).drop("drawn")


#: The same in SQL; the checksums are computed bit by bit, once a distinct word.
SQL = r"""
WITH step AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY ALL),
tw AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY w),
h AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM tw)),
b AS (SELECT w, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::BIGINT, 2))::BIGINT)), lambda c, y: xor(c >> 8, t[xor(c & 255, y) + 1]))) % 10000 AS bucket FROM h, step),
s AS (SELECT bucket, sum(n)::BIGINT AS n FROM dw JOIN b USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::BIGINT AS n FROM tw JOIN b USING (w) GROUP BY bucket),
g AS (SELECT i AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM s), 0) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain
    FROM (SELECT unnest(range(10000)) AS i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i),
v AS (SELECT r, sum(n * gain)::BIGINT AS weight FROM dw JOIN b USING (w) JOIN g USING (bucket) GROUP BY r),
o AS (SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN v USING (r)),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM o WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM o LEFT JOIN k USING (r)
"""
