"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables (operator 6).

A rotation is learned (ITQ: alternate between binary codes and the rotation that fits them best) on a bounded sample,
SAMPLE vectors by hash, whatever the table's size; every vector is then coded and indexed. Vectors are centred before
they are coded, as they are before the rotation is learned, so that codes are balanced. A code is cut into substrings;
each is a table key, and a vector also probes the keys one bit away. So a pair is found if in some table its
substrings differ in one bit at most. The number of tables follows from the threshold: a bit of two vectors differs
with probability t / pi, t being the angle in which the centre sees them, and rotations are added until a pair at the
threshold is expected to be found with probability RECALL (tests measure it against brute force). The nearer the
centre, the wider that angle; the centre is moved toward the origin until all but one in a hundred of the sample see a
pair at the threshold within WIDEST.

Equal vectors are one class. Classes within half the threshold's angle of a leader, the first of a table key, are one
ball: all of a ball link with each other, so they are counted and not paired. Balls meet in the tables, each once for a
key; those whose codes or leaders are too far apart for any link are left, and those whose leaders are so near that
all of their members link are counted as wholes. For the rest the members' original vectors are compared in double
precision, block by block of at most BLOCK vectors, and only the numbers of links leave a block. No link is below the
threshold.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are
kept. Vectors of unequal lengths are never linked. Repeated rows are copies; a null vec_id links as others do, but is
no component's id (a component of null ids only has a null id and is not kept). Extra columns are not read. Empty
tables give empty tables.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, small
from .graph import components

THRESHOLD, SAMPLE, RECALL, ROUNDS = 0.95, 5_000, 0.995, 30
#: Angle over pi of a pair at the threshold, seen from the centre, that the tables are planned for at most.
WIDEST = 0.15
#: Vectors of one side of a comparison; rounds in which leaders are chosen, each by the keys of another table.
BLOCK, LEADERS = 256, 2
#: Slack of the balls' angles, so that rounding links nothing below the threshold.
SLACK = 1e-6


def at_most(n: int, p: float, k: int) -> float:
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(min(k, n) + 1))


def learn(sample: np.ndarray, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """A rotation for balanced binary codes of centred vectors (columns: bits)."""
    dim = sample.shape[1]
    turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    if len(sample) < 2:
        return turn
    _, _, axes = np.linalg.svd(sample, full_matrices=len(sample) < dim)
    principal = sample @ axes.T
    for _ in range(rounds):
        codes = np.where(principal @ turn >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(codes.T @ principal)
        turn = (u @ v).T
    return axes.T @ turn


def centre(sample: np.ndarray, threshold: float) -> tuple[np.ndarray, float]:
    """The point that vectors are centred on, and the angle over pi in which it sees a pair at the threshold."""
    mean, apart = sample.mean(axis=0), math.sqrt(2 - 2 * threshold)
    for part in np.linspace(1, 0, 21):
        near = float(np.quantile(np.linalg.norm(sample - part * mean, axis=1), 0.01))
        p = 2 * math.asin(min(apart / 2 / max(near, 1e-9), 1.0)) / math.pi
        if p <= WIDEST:
            break
    return part * mean, p


def plan(n: int, dim: int, p: float) -> tuple[int, int, int]:
    """Bits of a table key, rotations, and differing bits of whole codes that a pair at the threshold stays within."""
    bits = min(dim, 64)
    size = min(bits, max(8, min(24, math.ceil(math.log2(max(n, 2))))))
    miss = (1 - at_most(size, p, 1)) ** max(bits // size, 1)
    rotations = max(1, math.ceil(math.log(1 - RECALL) / math.log(miss))) if miss > 0 else 1
    most = next(k for k in range(bits + 1) if at_most(bits, p, k) >= 0.999)
    return size, rotations, most


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def angle(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    return F.acos(F.least(F.greatest(dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(-1.0)), F.lit(1.0)))


def coded(vectors: np.ndarray, middle: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The first 64 bits of the centred vectors' codes."""
    bits = ((vectors - middle) @ turn >= 0)[:, :64]
    return (bits.astype(np.uint64) << np.arange(bits.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def unit_rows(b: pa.RecordBatch, at: int) -> np.ndarray:
    vectors = np.array(b.column(at).to_pylist(), float)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def codes(classes: DataFrame, middle: np.ndarray, turns: list[np.ndarray]) -> DataFrame:
    """cls, codes: of every rotation."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                vectors = unit_rows(b, 1)
                found = np.stack([coded(vectors, middle, t) for t in turns], axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(found), pa.list_(pa.int64()))], ["cls", "codes"])

    return classes.select("cls", "v").mapInArrow(run, "cls long, codes array<long>")


def table_key(code: Column, table: int, size: int) -> Column:
    return F.shiftrightunsigned(code, table * size).bitwiseAND(F.lit((1 << size) - 1))


def balls(members: DataFrame, size: int, tables: int, half: float) -> DataFrame:
    """members (cls, copies, v, codes) with ball (its leader's cls) and the angle and bits to the leader.

    In a round the first unplaced member of each key leads; those near it join it. A leader's group is not gathered:
    its vector is joined to the members of its key. Members near no leader are balls of their own.
    """
    alone = members.withColumns({"ball": F.col("cls"), "off": F.lit(0.0), "bits": F.lit(0)})
    for k in range(min(LEADERS, tables)):
        free = alone.where("ball = cls") if k else alone
        led = alone.where("ball <> cls").select(F.col("ball").alias("cls")).distinct() if k else None
        free = (free.join(led, "cls", "left_anti") if k else free).withColumn("key", table_key(F.get("codes", F.lit(0)), k, size))
        first = free.groupBy("key").agg(F.min("cls").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "leader")
        lead = first.join(members.select(F.col("cls").alias("leader"), F.col("v").alias("lead_v"), F.get("codes", F.lit(0)).alias("lead_code")), "leader")
        off = angle(F.col("v"), F.col("lead_v"))
        near = free.join(lead, "key").where("cls <> leader").withColumn("to", off).where(F.col("to") <= half)
        placed = near.select("cls", F.col("leader").alias("new"), "to", F.bit_count(F.get("codes", F.lit(0)).bitwiseXOR(F.col("lead_code"))).alias("b"))
        joined = alone.join(placed, "cls", "left")
        alone = durable(joined.select(*members.columns, F.coalesce("new", "ball").alias("ball"), F.coalesce("to", "off").alias("off"), F.coalesce("b", "bits").alias("bits")), "balls")
    return alone


def ball_pairs(members: DataFrame, size: int, tables: int, rotations: int, most: int, theta: float) -> DataFrame:
    """a, b (a < b), whole: balls that meet in a table and whose leaders do not rule a link out."""
    number = lambda r, t: F.lit((r * tables + t) << 32)
    slots = [(r, t) for r in range(rotations) for t in range(tables)]
    keys = F.array(*[number(r, t).bitwiseOR(table_key(F.get("codes", F.lit(r)), t, size)) for r, t in slots])
    index = durable(members.select("ball", F.explode(keys).alias("key")).distinct(), "keys")
    # of two keys one bit apart one has the bit: it is the one that probes
    bits = F.array(*[F.lit(1 << i) for i in range(size)])
    lower = F.transform(F.filter(bits, lambda m: F.col("key").bitwiseAND(m) != 0), lambda m: F.col("key").bitwiseXOR(m))
    probes = index.select(F.col("ball").alias("u"), F.explode(F.concat(F.array("key"), lower)).alias("key"), F.col("key").alias("own"))
    met = probes.join(index.withColumnRenamed("ball", "v"), "key").where((F.col("u") < F.col("v")) | ((F.col("own") != F.col("key")) & (F.col("u") > F.col("v"))))
    met = met.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    size_of = members.groupBy("ball").agg(F.max("off").alias("off"), F.max("bits").alias("bits"))
    leaders = members.where("ball = cls").select("ball", "v", F.get("codes", F.lit(0)).alias("code")).join(size_of, "ball")
    side = lambda x: leaders.select(F.col("ball").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("v", "code", "off", "bits")])
    codes_of = lambda x: side(x).drop(f"{x}_v", f"{x}_off")
    differ = F.bit_count(F.col("a_code").bitwiseXOR(F.col("b_code"))) - F.col("a_bits") - F.col("b_bits")
    near = met.join(codes_of("a"), "a").join(codes_of("b"), "b").where(differ <= most).select("a", "b")
    vectors = lambda x: side(x).drop(f"{x}_code", f"{x}_bits")
    apart = near.join(vectors("a"), "a").join(vectors("b"), "b").withColumn("apart", angle(F.col("a_v"), F.col("b_v")))
    spread = F.col("a_off") + F.col("b_off")
    lone = (F.col("a_off") == 0) & (F.col("b_off") == 0)
    apart = apart.where(F.col("apart") - spread <= theta + SLACK).withColumn("whole", ~lone & (F.col("apart") + spread <= theta - SLACK))
    return apart.select("a", "b", "whole")


def compared(pairs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """cls, n (linked copies in the other ball), u, v (the balls): one row a member with links, from blocks of members."""
    sized = members.groupBy("ball").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK).select("ball", "size")
    part = F.when(F.col("size") > BLOCK, F.pmod(F.xxhash64("cls"), F.ceil(2 * F.col("size") / BLOCK))).otherwise(0)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("ball")).distinct()
    held = members.join(wanted, "ball").join(sized, "ball", "left").withColumn("part", part)
    # a ball of more than BLOCK members is dealt out, so a block holds about BLOCK / 2 and is never a whole hot group
    row = F.struct("cls", "copies", "v")
    packed = durable(held.groupBy("ball", "part").agg(F.collect_list(row).alias("rows")), "blocks")
    of = lambda x: packed.select(F.col("ball").alias(x), F.col("rows").alias(f"{x}_rows"))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                out = []
                for a, b, left, right in zip(*[c.to_pylist() for c in whole.slice(at, 64).columns]):
                    x, y = (np.array([r["v"] for r in side], float) for side in (left, right))
                    x, y = (z / np.linalg.norm(z, axis=1, keepdims=True) for z in (x, y))
                    linked = x @ y.T >= threshold
                    for side, mine, n in ((left, a, linked @ np.array([r["copies"] for r in right])), (right, b, linked.T @ np.array([r["copies"] for r in left]))):
                        out += [(r["cls"], int(k), mine, b if mine == a else a) for r, k in zip(side, n) if k]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*out) if out else [[]] * 4)], ["cls", "n", "u", "v"])

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_rows", "b_rows").mapInArrow(run, "cls long, n long, u long, v long")


def links(classes: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame] | None:
    """For each class (cls, copies, v of one length) its ball and linked copies in others; and linked balls (u, v)."""
    found = None
    for row in classes.groupBy(F.size("v").alias("dim")).count().collect():  # a row for each vector length
        dim, n = row["dim"], row["count"]
        of = classes.where(F.size("v") == dim)
        share = min(1.0, 2 * SAMPLE / n)  # by the hash's range, so that no task or driver gets much more than the sample
        drawn = of.withColumn("h", F.xxhash64("v"))
        drawn = drawn.where(F.col("h") < int(-(2**63) + share * (2**64 - 1))) if share < 1 else drawn
        sample = np.array([r["v"] for r in drawn.orderBy("h", "cls").limit(SAMPLE).select("v").collect()], float).reshape(-1, dim)
        sample /= np.linalg.norm(sample, axis=1, keepdims=True)
        middle, p = centre(sample, threshold) if len(sample) else (np.zeros(dim), math.acos(threshold) / math.pi)
        size, rotations, most = plan(n, dim, p)
        turns = [learn(sample - middle, s) for s in range(rotations)]
        tables, theta = max(min(dim, 64) // size, 1), math.acos(threshold)
        members = durable(of.join(codes(of, middle, turns), "cls"), "codes")
        members = balls(members, size, tables, theta / 2 - SLACK)
        pairs = durable(ball_pairs(members, size, tables, rotations, most, theta), "ball-pairs")
        near = durable(compared(pairs.where("not whole"), members, threshold), "compared")
        total = members.groupBy("ball").agg(F.sum("copies").alias("all"))
        both = pairs.where("whole").select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        others = both.join(total.withColumnRenamed("ball", "v"), "v").groupBy(F.col("u").alias("ball")).agg(F.sum("all").alias("beside"))
        single = near.groupBy("cls").agg(F.sum("n").alias("n"))
        counted = members.select("cls", "ball", "copies").join(total, "ball").join(others, "ball", "left").join(single, "cls", "left")
        n_links = F.col("all") - 1 + F.coalesce("beside", F.lit(0)) + F.coalesce("n", F.lit(0))
        mine = counted.select("cls", "ball", n_links.alias("n")), near.select("u", "v").unionByName(both).distinct()
        found = mine if found is None else tuple(x.unionByName(y) for x, y in zip(found, mine))
    return found


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    # equal vectors meet by two hashes of 64 bits; a class is then numbered, so that no hash stands for a vertex
    rows = rows.withColumn("ok", usable(F.col("v"))).withColumns({"h": F.when(F.col("ok"), F.xxhash64("v")), "g": F.when(F.col("ok"), F.xxhash64(F.lit(7), "v"))})
    grouped = rows.where("ok").groupBy("h", "g").agg(F.any_value("v").alias("v"), F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    classes = durable(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")
    found = links(classes.select("cls", "copies", "v"), threshold)
    members = rows.select("vec_id", "ok", "h", "g")
    if found is None:
        return members.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    counted, edges = found
    counted = durable(counted, "counted")
    of_ball = components(edges).select(F.col("vertex").alias("ball"), "root")
    rooted = classes.select("cls", "h", "g", "first_id").join(counted, "cls").join(of_ball, "ball", "left").withColumn("root", F.coalesce("root", "ball"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = durable(rooted.join(least, "root").select("h", "g", "component_id", "n"), "numbered")
    out = members.join(small(of, of.count()), ["h", "g"], "left")
    component = F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.when(F.col("ok"), F.coalesce(F.col("vec_id") == component, F.lit(False))).otherwise(F.lit(True)).alias("kept"))
