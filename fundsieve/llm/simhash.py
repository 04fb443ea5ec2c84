"""SimHash near-duplicates by Golay-code fuzzy keys (operator 8).

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. Two differing bits leave one segment without
an error whose follower (cyclically) has one error at most: of the error counts (2,0,0), (1,1,0) and their rotations
each has such a place. So a key joins one segment as it is with the index of a Golay codeword near its follower. The
binary (23,12) Golay code is perfect: every word has one codeword within three bits. The indexed side carries the
codeword of its follower segment; the probing side carries the codewords of that segment and of all words one bit
away, so words with one differing bit always meet. Candidates are verified on the whole fingerprints.

Equal fingerprints are one vertex. Keys that more than CROWD fingerprints share are not paired: their fingerprints
are linked through the words one bit away from each (two fingerprints at two bits or fewer share such a word, and
those that share one differ in two bits at most), which costs 65 rows a fingerprint whatever the group's size.

Defined results: a null text is empty and has the fingerprint zero, as has a text without words. Repeated rows and
repeated ids have the same fingerprint and so the same component. A null id is no component's smallest id; a
component with null ids only has a null component_id. Extra columns are not read. Empty tables give empty tables.

similar() is the pipeline's setting: sets of five-word shingles and Jaccard similarity 0.8. Such sets differ in 15 % of
a SimHash's bits, 10 of 64, which no exact keys cover, so its SimHash has 256 bits and many tables of keys. A key is
the Golay codeword of 23 bits with as many plain bits as keep keys small; the number of tables follows from an expected
recall of 0.995 at the similarity. Pairs that meet are verified on the shingles of the texts. They are met in steps,
so that a large group of copies is not paired with itself: the first vertex of a key with all others of the key; in
crowded keys, those that leaders connect, block by block in one task each, of which only links come out; then, of what these links have not joined, every other pair of a key. No pair that meets in a key is left, unless its
components are one already.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, small, tidy
from .graph import components

SHINGLE, SEED, BITS = 3, 42, 2
#: (first bit, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
CROWD = 64
#: Generator polynomial of the (23,12) Golay code.
GENERATOR = 0b101011100011
#: The setting of similar(): words of a shingle, Jaccard similarity, bits of its SimHash and expected recall.
STAGE_SHINGLE, LEAST, WIDE, RECALL = 5, 0.8, 256, 0.995
#: Bits of the first 64 and of all in which a pair may differ before its texts are compared (10 and 39 are expected at
#: the similarity, 12 and 48 for the shortest texts that can reach it).
FIRST_BITS, ALL_BITS = 24, 68
#: Vertices from which a key is crowded; words of one block of a crowd.
CROWDED, BLOCK_WORDS = 12, 50_000
#: Linked vertices whose component is broadcast to the keys; more are joined.
LINKED_ROWS = 1_000_000


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles; bytes.lower and bytes.split are the ASCII rules asked for."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        bits = np.unpackbits(h[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp: the fingerprint as a signed 64-bit integer."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, fp long")


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    left = words.astype(np.int64)
    for bit in range(22, 10, -1):
        left = np.where(left >> bit & 1, left ^ GENERATOR << bit - 11, left)
    return left


def corrections() -> np.ndarray:
    """The error of three bits or fewer for each of the 2048 syndromes."""
    one = 1 << np.arange(23)
    two = (one[:, None] | one[None, :]).ravel()
    errors = np.unique(np.concatenate([[0], one, two, (two[:, None] | one[None, :]).ravel()]))
    out = np.zeros(2048, np.int64)
    out[syndrome(errors)] = errors
    return out


def codeword(words: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    return (words ^ table[syndrome(words)]) >> 11


def golay_keys(fps: DataFrame) -> DataFrame:
    """fp, key, probe: the index key (probe false) and probe keys of each fingerprint for each pair of segments."""

    def run(batches):
        table = corrections()
        flips = np.concatenate([[0], 1 << np.arange(23)])
        for b in batches:
            signed = b.column(0).to_numpy()
            fp = signed.view(np.uint64)
            out = []
            for i, (at, size) in enumerate(SEGMENTS):
                to, width = SEGMENTS[(i + 1) % 3]
                same = (fp >> np.uint64(at)).astype(np.int64) & (1 << size) - 1
                near = (fp >> np.uint64(to)).astype(np.int64) & (1 << width) - 1
                base = (np.int64(i) << 60) | same << 12
                found = np.sort(codeword(near[:, None] ^ flips[None, : width + 1], table), axis=1)
                fresh = np.ones(found.shape, bool)
                fresh[:, 1:] = found[:, 1:] != found[:, :-1]
                row, col = np.nonzero(fresh)
                out.append((signed, base | codeword(near, table), np.zeros(len(fp), bool)))
                out.append((signed[row], base[row] | found[row, col], np.ones(len(row), bool)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["fp", "key", "probe"])

    return fps.select("fp").mapInArrow(tidy(run), "fp long, key long, probe boolean")


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """u, v: fingerprints that differ in few bits; every pair in a key of CROWD or fewer, stars in crowded ones."""
    keys = durable(golay_keys(fps), "golay")
    crowd = keys.where("not probe").groupBy("key").count()
    # a probe needs its key among the indexed ones; a lone key can only meet its own fingerprint
    index = keys.where("not probe").select(F.col("fp").alias("v"), "key")
    probes = keys.where("probe").select(F.col("fp").alias("u"), "key")
    calm = crowd.where(F.col("count") <= CROWD).select("key")
    pairs = index.join(calm, "key").join(probes, "key").where("u <> v").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits)
    crowded = crowd.where(F.col("count") > CROWD).select("key")
    packed = index.join(crowded, "key").select(F.col("v").alias("fp")).unionByName(probes.join(crowded, "key").select(F.col("u").alias("fp"))).distinct()
    masks = F.array(F.lit(0), *[F.expr(f"shiftleft(1L, {i})") for i in range(64)])
    words = packed.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("word"))
    hubs = words.groupBy("word").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").select("word", "v")
    stars = words.join(hubs, "word").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.select("u", "v").unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links at `bits` (two) or fewer differing bits reach."""
    if bits > BITS:
        raise ValueError(f"the keys cover {BITS} differing bits, not {bits}")
    marked = durable(fingerprints(docs, key, text), "simhash")
    classes = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    found = components(links(classes, bits))
    rooted = classes.join(found.withColumnRenamed("vertex", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", "fp", "component_id")


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit words."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


def shingle_hashes(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles, each made of the hashes of its words."""
    digest = xxhash.xxh64_intdigest
    words = np.array([digest(w.encode("utf-8", "surrogatepass"), SEED) for w in WORDS.findall((text or "").lower())], np.uint64)
    if not len(words):
        return words
    k = min(STAGE_SHINGLE, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        h = mixed(h + words[j : len(words) - k + 1 + j])
    return np.unique(h)


def wide_fingerprint(text: str | None) -> tuple[bytes, bytes]:
    """A digest of a text's set of word shingles, empty without words, and its SimHash of WIDE bits."""
    h = shingle_hashes(text)
    if not len(h):
        return b"", bytes(WIDE // 8)
    out = []
    for j in range(WIDE // 64):
        x = mixed(h + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        counts = np.zeros(64, np.int64)
        for at in range(0, len(x), 4096):
            counts += np.unpackbits(x[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * counts > len(x), bitorder="little").tobytes())
    return xxhash.xxh3_128_digest(h.tobytes()), b"".join(out)


#: The words of similar().
WORDS = re.compile(r"\w+")


def word_shingles(text: str | None) -> set[str]:
    r"""The distinct runs of STAGE_SHINGLE \w+ words in lower case; a shorter text is one shingle."""
    ws = WORDS.findall((text or "").lower())
    return {" ".join(ws[i : i + STAGE_SHINGLE]) for i in range(max(len(ws) - STAGE_SHINGLE + 1, min(len(ws), 1)))}


def key_plan(vertices: int, least: float) -> tuple[int, int]:
    """Plain bits of a key, so that a key has about one vertex by chance, and tables for the expected RECALL at `least`.

    Two sets of Jaccard similarity `least` differ in each bit with the probability `off` at most. A table finds them if
    a codeword and the plain bits agree.
    """
    plain = max(0, (max(vertices, 1) - 1).bit_length() - 12)
    off = math.acos(2 * least / (1 + least)) / math.pi
    table = corrections()
    # a cell of the code is its 2048 errors; a difference keeps a word in its cell if it leads to another of them
    weights = np.bitwise_count(table)
    apart = np.bitwise_count(table[:, None] ^ table[None, :])
    assert weights.max() == 3
    met = float(np.sum(off ** apart.astype(float) * (1 - off) ** (23.0 - apart))) / 2048 * (1 - off) ** plain
    return plain, 1 if met >= 1 else max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - met)))


def table_keys(classes: DataFrame, plain: int, tables: int) -> DataFrame:
    """key, id, f: a key of every table for each vertex, and the first 64 bits of its fingerprint."""

    def run(batches):
        code = corrections()
        rnd = np.random.default_rng(SEED)
        picks = [rnd.permutation(WIDE)[: 23 + plain] for _ in range(tables)]
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                ids = b.column(0).slice(at, 1000).to_numpy()
                raw = np.frombuffer(b"".join(b.column(1).slice(at, 1000).to_pylist()), np.uint8).reshape(len(ids), -1)
                f = np.ascontiguousarray(raw[:, :8]).view("<i8").ravel()
                bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.int64)
                for t, pick in enumerate(picks):
                    word = bits[:, pick[:23]] @ (1 << np.arange(23))
                    more = bits[:, pick[23:]] @ (1 << np.arange(plain)) if plain else np.zeros(len(ids), np.int64)
                    key = (np.int64(t) << 44) | codeword(word, code) << plain | more
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(f)], ["key", "id", "f"])

    return classes.select("id", "fp").mapInArrow(tidy(run), "key long, id long, f long")


def near(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y)) <= FIRST_BITS


def led(keys: DataFrame) -> DataFrame:
    """key, id, f, first, near, n: each vertex of a key of n with the key's first, and whether they are near in 64 bits.

    The first is a grouped minimum that is joined back; a task streams the vertices of a key and holds none.
    """
    # stated here, as tests for null that only one of the joins implies would keep them from sharing an exchange
    keys = keys.where("key is not null and id is not null and f is not null")
    first = keys.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = keys.join(first, "key")
    # the first's own row is already where the key's others are, so its bits need not come along with the minimum
    rows = met.join(met.where("id - first = 0").select("key", F.col("f").alias("first_f")), "key")
    rows = rows.select("key", "id", "f", "first", near(F.col("f"), F.col("first_f")).alias("near"), "n")
    return rows.where("n > 2 or (near and id <> first)")


def rooted(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with the root of id and, as lead, that of first; found: vertex, root."""
    known = small(found, found.count(), LINKED_ROWS)
    of = lambda df, c, name: df.join(known.select(F.col("vertex").alias(c), F.col("root").alias(name)), c, "left").withColumn(name, F.coalesce(name, c))
    return of(of(rows, "id", "root"), "first", "lead")


def crowds(rows: DataFrame) -> DataFrame:
    """id, crowd: the vertices that crowded keys bring together, through leaders that they are near to."""
    met = rows.where((F.col("n") >= CROWDED) & F.col("near") & (F.col("id") != F.col("first"))).select(F.col("id").alias("u"), F.col("first").alias("v"))
    return with_roots(components(met)).select(F.col("vertex").alias("id"), F.col("root").alias("crowd"))


def with_roots(found: DataFrame) -> DataFrame:
    """vertex, root with the roots as vertices of their own."""
    return found.unionByName(found.select(F.col("root").alias("vertex"), "root").distinct())


def crowd_links(crowd: DataFrame, found: DataFrame, docs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """u, v: links of the similarity `least` or more between the components of one crowd, enough of them to join all.

    Vertices of a crowd are dealt into blocks of about BLOCK_WORDS / 2 words and each pair of blocks is compared by itself:
    near fingerprints first, then their shingles. Pairs that the links of the task have joined are not compared again.
    """

    def sets(batches):
        for b in batches:
            made = [shingle_hashes(t) for t in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array([m.tobytes() for m in made], pa.binary())], ["id", "crowd", "root", "fp", "hashes"])

    def compare(batches):
        """Rows sorted by block pair; a pair is compared when the next one begins."""
        held, last = [], None
        for whole in batches:
            for r in zip(*[whole.column(i).to_pylist() for i in range(8)]):
                if r[:3] != last and held:
                    yield linked_rows(held)
                    held = []
                held.append(r)
                last = r[:3]
        if held:
            yield linked_rows(held)

    def linked_rows(rows):
        left, right = ([dict(zip(("id", "root", "fp", "hashes"), r[4:])) for r in rows if r[3] == at] for at in (rows[0][1], rows[0][2]))
        out = block_links(left, right, least)
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["u", "v"])

    roots = small(found, found.count(), LINKED_ROWS)
    of = crowd.join(classes.select("id", "fp", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash")), "id")
    of = durable(of.join(roots.select(F.col("vertex").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id")), "crowds")
    texts = docs.join(small(of, of.count(), LINKED_ROWS), ["doc_id", "text_hash"]).select("id", "crowd", "root", "fp", "text")
    made = durable(texts.mapInArrow(tidy(sets), "id long, crowd long, root long, fp binary, hashes binary"), "sets").dropDuplicates(["id"])
    sizes = made.groupBy("crowd").agg(F.ceil(F.sum(F.length("hashes")) / (4 * BLOCK_WORDS)).cast("long").alias("parts"))
    dealt = made.join(small(sizes, sizes.count()), "crowd").withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    # a row for each block that a vertex's block meets: (a, b) holds the vertices of parts a and b
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = met.select("crowd", F.least("part", "with").alias("a"), F.greatest("part", "with").alias("b"), "part", "id", "root", "fp", "hashes")
    return met.repartition("crowd", "a", "b").sortWithinPartitions("crowd", "a", "b", "id").mapInArrow(tidy(compare), "u long, v long").distinct()


def block_links(left: list, right: list, least: float) -> list[tuple[int, int]]:
    """Links between two blocks of vertices (id, root, fp, hashes) that join all components that any link joins."""
    x, y = (np.frombuffer(b"".join(r["fp"] for r in rows), np.uint64).reshape(len(rows), -1) for rows in (left, right))
    xs, ys = ([np.frombuffer(r["hashes"], np.uint64) for r in rows] for rows in (left, right))
    head: dict[int, int] = {}

    def top(v: int) -> int:
        while head.get(v, v) != v:
            head[v] = head.get(head[v], head[v])
            v = head[v]
        return v

    out = []
    for i, r in enumerate(left):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ y).sum(axis=1) <= ALL_BITS):
            s = right[j]
            m, n = len(xs[i]), len(ys[j])
            if top(r["root"]) == top(s["root"]) or min(m, n) < least * max(m, n):
                continue
            common = len(np.intersect1d(xs[i], ys[j], assume_unique=True))
            if common >= least * (m + n - common):
                head[top(r["root"])] = top(s["root"])
                out.append((max(r["id"], s["id"]), min(r["id"], s["id"])))
    return out


def apart(rows: DataFrame, found: DataFrame, crowd: DataFrame) -> DataFrame:
    """u, v: pairs of one key, neither its first nor of one crowd, that no link has joined yet and that are near.

    Of a pair one at least is joined to others than the key's first is. A large group of copies is joined to the first
    of its keys, so only what is not of the group is paired with it.
    """
    told = rooted(rows.where("n > 2 and id <> first"), found).join(small(crowd, crowd.count(), LINKED_ROWS), "id", "left")
    told = told.select("key", "id", "f", "root", "crowd", (F.col("root") != F.col("lead")).alias("other"))
    u, v = (told.select("key", *[F.col(c).alias(f"{x}_{c}") for c in ("id", "f", "root", "crowd", "other")]) for x in "uv")
    once = ~F.col("v_other") | (F.col("u_id") < F.col("v_id"))
    new = (F.col("u_root") != F.col("v_root")) & F.coalesce(F.col("u_crowd") != F.col("v_crowd"), F.lit(True))
    met = u.where("u_other").join(v, "key").where(new & once & near(F.col("u_f"), F.col("v_f")))
    return met.select(F.greatest("u_id", "v_id").alias("u"), F.least("u_id", "v_id").alias("v")).distinct()


def near_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose whole fingerprints differ in ALL_BITS or fewer."""

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint64).reshape(-1, WIDE // 64) for i in (2, 3))
            kept = np.bitwise_count(x ^ y).sum(axis=1) <= ALL_BITS
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(kept))

    of = lambda name: classes.select(F.col("id").alias(name), F.col("fp").alias(f"{name}_fp"))
    return pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "u_fp", "v_fp").mapInArrow(tidy(run), "u long, v long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs of classes whose texts have shingle sets of the similarity `least` or more."""

    def run(batches):
        for b in batches:
            kept = []
            for s, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                s, t = word_shingles(s), word_shingles(t)
                common = len(s & t)
                kept.append(common >= least * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(kept, pa.bool_()))

    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct().join(classes.select("id", "first.*"), "id")
    asked = durable(ids.select("id", "doc_id", "text_hash"), "asked")
    texts = docs.join(small(asked, asked.count(), LINKED_ROWS), ["doc_id", "text_hash"]).select("id", "text").dropDuplicates(["id"])
    texts = durable(texts, "texts")
    of = lambda name: texts.select(F.col("id").alias(name), F.col("text").alias(f"{name}_text"))
    return pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "u_text", "v_text").mapInArrow(tidy(run), "u long, v long")


def similar(docs: DataFrame, least: float = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, n, component_id, first: one row for each id and text, and how many rows have them; no null ids.

    component_id is the smallest doc_id that links of shingle similarity `least` or more reach; first marks the text of
    that id that stands for the component. Texts with the same shingles, or without any, are linked. Of an id with
    several texts each is judged on its own.
    """

    def run(batches):
        for b in batches:
            made = [wide_fingerprint(t) for t in b.column(2).to_pylist()]
            columns = [b.column(0), b.column(1), *(pa.array([m[k] for m in made], pa.binary()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "shingles", "fp"])

    docs = with_text_hash(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))).where("doc_id is not null")
    marked = durable(docs.select("doc_id", "text_hash", "text").mapInArrow(tidy(run), "doc_id long, text_hash long, shingles binary, fp binary"), "wide")
    grouped = marked.groupBy("shingles", "fp").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    classes = durable(grouped.withColumn("id", F.monotonically_increasing_id()), "classes")
    worded = classes.where(F.length("shingles") > 0).select("id", "fp")
    rows = durable(led(table_keys(worded, *key_plan(worded.count(), least))), "led")
    check = lambda met: durable(verified(durable(near_pairs(met, worded), "near-pairs"), docs, classes, least), "similar")
    star = rows.where("near and id <> first").select(F.col("id").alias("u"), F.col("first").alias("v")).distinct()
    links = check(star)
    found = durable(components(links), "joined")
    crowd = durable(crowds(rows), "crowd")
    links = links.unionByName(durable(crowd_links(crowd, found, docs, classes, least), "crowd-links"))
    found = durable(components(links), "joined")
    links = links.unionByName(check(apart(rows, found, crowd)))
    found = with_roots(durable(components(links), "joined"))
    linked = classes.join(found.withColumnRenamed("vertex", "id"), "id").select("shingles", "fp", "first", "root")
    least_of = linked.groupBy("root").agg(F.min("first").alias("least"))
    of = linked.join(small(least_of, least_of.count(), LINKED_ROWS), "root").select("shingles", "fp", "least")
    alone = classes.join(found.select(F.col("vertex").alias("id")), "id", "left_anti").select("shingles", "fp", F.col("first").alias("least"))
    of = durable(of.unionByName(alone), "components")
    texts = marked.groupBy("doc_id", "text_hash", "shingles", "fp").agg(F.count(F.lit(1)).alias("n"))
    is_first = F.struct("doc_id", "text_hash") == F.col("least")
    return texts.join(of, ["shingles", "fp"]).select("doc_id", "text_hash", "n", F.col("least.doc_id").alias("component_id"), is_first.alias("first"))


def with_text_hash(docs: DataFrame) -> DataFrame:
    """docs with text_hash, which tells the texts of one id apart; a null text is empty."""
    return docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
