"""Removal of repeated byte strings by merging Burrows-Wheeler transforms (operator 3).

A byte goes if some string of WINDOW bytes that covers it also starts earlier: in a document with a smaller id, or
earlier in the same document. Three steps, each spread over the cluster:

1. Windows are dealt out by their minimizer, the least hash of the GRAM-byte strings inside, so equal windows always
   meet. Consecutive windows with one minimizer at one place form a stretch (in which no window
   stands twice), of which only hash and place travel. Equal stretches
   are combined before the shuffle (per batch of documents) and after it: all but the first are repeats as a whole.
2. Only stretches that share their minimizer with an unequal stretch can still hold repeats of another's windows.
   Their bytes are cut out of the documents and brought together by minimizer. Each task holds them in shards, sorts
   each shard's suffixes once to get its Burrows-Wheeler transform, and merges the transforms by refining the
   interleave: after round h it is the order of all suffixes by their first h bytes, and the boundaries that
   appeared so far are the places where common prefixes are shorter than h. After WINDOW rounds the intervals
   between boundaries are the repeated windows; suffixes are never sorted again.
   A minimizer that more than CROWD unequal stretches share is no single task's work: their windows are dealt out one
   by one by a 128-bit hash of their bytes, with a grouped minimum in place of the transforms.
3. The repeats of a document are gathered by its id and cut out of its text.

Defined results: a null text is empty. A null doc_id has nothing removed and is earlier than nothing. Repeated
rows (one id, one text) are the same document and do not remove each other; of rows with one id and several texts,
strings with the same start are ordered by the texts' hash. Extra columns are not
read. Empty tables give empty tables. A text shorter than WINDOW bytes stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, small

WINDOW, GRAM = 100, 24
#: Bytes of documents that are hashed at once, and of stretches whose transforms are merged at once.
HASH_BYTES, MERGE_BYTES, SHARDS = 1 << 20, 1 << 19, 2
#: Unequal stretches of one minimizer that one task still merges; more go window by window.
CROWD = 20_000
PRIME = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on, by doubling: 8, then 16, then 24 bytes."""
    h, size, power = data.astype(np.uint64) + np.uint64(1), 1, PRIME
    while size < 8:
        h, power, size = h[:-size] * power + h[size:], power * power, 2 * size
    eight = h
    h = eight[:-8] * power + eight[8:]
    return mix(h[:-8] * power + eight[16:])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def stretches(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """document (its number in ends), start, windows, minimizer and content hash of the stretches in joined documents."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    with np.errstate(over="ignore"):
        grams = gram_hashes(data)
        least = sliding_min(grams, WINDOW - GRAM + 1)
        begins = np.concatenate([[0], ends[:-1]])
        new = np.ones(n, bool)
        new[1:] = (least[1:] != least[:-1]) | (grams[: n - 1] == least[:-1])  # or its first place is left behind
        new[begins[begins < n]] = True
        stops = np.unique(np.clip(ends - WINDOW + 1, 0, n))  # the windows from here to the document's end cross it
        new[stops[stops < n]] = True
        start = np.flatnonzero(new)
        stop = np.append(start[1:], n)
        document = np.searchsorted(ends, start, side="right")
        whole = start + WINDOW <= ends[document]
        start, stop, document = start[whole], stop[whole], document[whole]
        powers = np.cumprod(np.full(len(grams), PRIME))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(grams * powers)])
        content = (sums[stop + WINDOW - GRAM] - sums[start]) * np.cumprod(np.full(len(grams), INVERSE))[start]
        return document, start - begins[document], stop - start, least[start], mix(content + (stop - start).astype(np.uint64))


PLACES = "doc_id long, text_hash int, start int, windows int, minimizer long, content long, repeat boolean"


def _place_batches(batches):
    """Stretches of whole documents; repeats of a stretch of the same batch are marked and need no partner."""
    for b in batches:
        ids, hashes = b.column(0).to_numpy(), b.column(1).to_numpy()
        texts = [t.encode("utf-8", "surrogatepass") for t in b.column(2).to_pylist()]
        at, parts = 0, []
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= HASH_BYTES):
                size, to = size + len(texts[to]), to + 1
            ends = np.cumsum([len(t) for t in texts[at:to]])
            document, *rest = stretches(np.frombuffer(b"".join(texts[at:to]), np.uint8), ends)
            parts.append((document + at, *rest))
            at = to
        if not parts:
            continue
        document, start, windows, minimizer, content = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((hashes[document], start, ids[document], content, minimizer))
        document, start, windows, minimizer, content = (x[order] for x in (document, start, windows, minimizer, content))
        doc = ids[document]
        first = np.ones(len(doc), bool)
        first[1:] = (minimizer[1:] != minimizer[:-1]) | (content[1:] != content[:-1])
        lead = np.flatnonzero(first)[np.cumsum(first) - 1] if len(doc) else np.zeros(0, np.int64)
        text_hash = hashes[document]
        tied = (doc == doc[lead]) & (start == start[lead]) & (text_hash == text_hash[lead])
        columns = [doc, text_hash, start.astype(np.int32), windows.astype(np.int32), minimizer.view(np.int64), content.view(np.int64), ~tied]
        for k in range(0, len(doc), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 100_000]) for c in columns], [x.split()[0] for x in PLACES.split(", ")])


def _meet(batches):
    """Over places sorted by minimizer, content, id, start: repeats as they are; of the firsts, those whose minimizer has other contents."""
    names = [x.split()[0] for x in PLACES.split(", ")]
    held: list[np.ndarray] | None = None  # the last first, whose next neighbour is not yet seen, and whether it is shared
    shared = False
    last = None  # minimizer, content, doc, start and text hash of the last first
    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
        done = cols[6]
        if done.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[done]) for c in cols], names)
        cols = [c[~done] for c in cols]
        n = len(cols[0])
        if not n:
            continue
        doc, text_hash, start, m, c = cols[0], cols[1], cols[2], cols[4], cols[5]
        first = np.ones(n, bool)
        first[1:] = (m[1:] != m[:-1]) | (c[1:] != c[:-1])
        first[0] = last is None or (m[0], c[0]) != last[:2]
        lead = np.maximum.accumulate(np.where(first, np.arange(n), -1))
        lead_doc = np.where(lead >= 0, doc[lead], last[2] if last else 0)
        lead_start = np.where(lead >= 0, start[lead], last[3] if last else 0)
        lead_hash = np.where(lead >= 0, text_hash[lead], last[4] if last else 0)
        later = ~first & ((doc != lead_doc) | (start != lead_start) | (text_hash != lead_hash))
        if later.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[later]) for x in cols[:6]] + [pa.array(np.ones(later.sum(), bool))], names)
        keep = np.flatnonzero(first)
        if len(keep):
            last = (m[keep[-1]], c[keep[-1]], doc[keep[-1]], start[keep[-1]], text_hash[keep[-1]])
            firsts = [x[keep] for x in cols]
            if held is not None:
                firsts = [np.concatenate([h, x]) for h, x in zip(held, firsts)]
            fm = firsts[4]
            same = fm[1:] == fm[:-1]
            both = np.append(same, False) | np.concatenate([[shared if held is not None else False], same])
            out = np.flatnonzero(both[:-1])
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in firsts], names)
            held, shared = [x[-1:] for x in firsts], bool(both[-1])
    if held is not None and shared:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names)


def suffix_order(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of strings that end in a terminator (symbol 0) of their own, in order, and each one's rank.

    Prefix doubling, from as many symbols as fit a word; only suffixes that still tie are sorted again.
    """
    n = len(text)
    symbols = text.astype(np.int64) + len(ends)
    symbols[ends] = np.arange(len(ends))
    bits = int(257 + len(ends)).bit_length()
    size = 62 // bits
    padded = np.concatenate([symbols, np.zeros(size, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(size):
        key = key << bits | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    key = key[order]
    place = np.arange(n)
    rank = np.empty(n, np.int64)
    while True:
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[order[place]] = place[np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))]
        tied = ~fresh
        tied[:-1] |= tied[1:]
        place = place[tied]
        if not len(place):
            return order, rank
        suffix = order[place]
        key = rank[suffix] * n + rank[suffix + size]
        moved = np.argsort(key, kind="stable")
        order[place], key = suffix[moved], key[moved]
        size *= 2


def transform(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A shard's Burrows-Wheeler transform (0: terminator), where each row's symbol leads, its suffixes, their offsets."""
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int16) + 1
    sizes = np.array([len(s) + 1 for s in strings])
    ends = np.cumsum(sizes) - 1
    text[ends] = 0
    order, rank = suffix_order(text, ends)
    offset = np.arange(len(text)) - np.repeat(ends + 1 - sizes, sizes)
    return text[order - 1], rank[order - 1], order, offset[order]


def merged_intervals(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of all shards that share their first `depth` bytes with another: their rows, and where intervals begin.

    shards: transform, leads, offsets. A row is a suffix's place in its shard's order, shards joined. A round deals
    the interleave out by the transforms' symbols in a stable way, which leads from each suffix to the one before it
    and makes the order one byte deeper; an interval splits where the symbol or the interval that a suffix comes from
    differs. Suffixes that begin too early in their string to lead to one of `depth` bytes take no part, and every
    few rounds those alone in their interval are left: what they lead to is alone as well.
    """
    base = np.cumsum([0] + [len(t) for t, _, _ in shards])
    symbols = np.concatenate([t for t, _, _ in shards])
    leads = np.concatenate([lead + at for (_, lead, _), at in zip(shards, base)]).astype(np.int32)
    rows = np.flatnonzero(np.concatenate([o for _, _, o in shards]) >= depth)  # the interleave: shard after shard at first
    digits_of = (symbols - 1).astype(np.uint8)  # terminators are never read
    begins = np.zeros(len(rows), bool)
    begins[:1] = True
    for deep in range(1, depth + 1):
        if not len(rows):
            break
        digits = digits_of[rows]
        moved = np.argsort(digits, kind="stable")
        interval = np.cumsum(begins, dtype=np.int32)[moved]
        digits, rows = digits[moved], leads[rows[moved]]
        begins = np.ones(len(rows), bool)
        begins[1:] = (digits[1:] != digits[:-1]) | (interval[1:] != interval[:-1])
        if deep % 8 == 0 or deep == depth:
            alone = begins.copy()
            alone[:-1] &= begins[1:]
            rows, begins = rows[~alone], begins[~alone]
    return rows, np.flatnonzero(begins)


def repeated_windows(strings: list[bytes]) -> list[np.ndarray]:
    """For strings in order of their places: the window starts in each that also start at an earlier place."""
    cut = np.cumsum([len(s) for s in strings])
    bounds = [int(np.searchsorted(cut, cut[-1] * k / SHARDS, side="left")) for k in range(1, SHARDS)]
    groups = [g for g in np.split(np.arange(len(strings)), bounds) if len(g)]
    built = [transform([strings[i] for i in g]) for g in groups]
    rows, begins = merged_intervals([(t, lead, offset) for t, lead, _, offset in built], WINDOW)
    bases = np.cumsum([0] + [len(t) for t, _, _, _ in built])
    place = np.concatenate([order + at for (_, _, order, _), at in zip(built, bases)])[rows]  # in all strings joined
    if not len(place):
        return [place] * len(strings)
    least = np.repeat(np.minimum.reduceat(place, begins), np.diff(np.append(begins, len(place))))
    again = np.sort(place[place > least])
    starts = np.concatenate([[0], np.cumsum([len(s) + 1 for s in strings])])
    cuts = np.searchsorted(again, starts)
    return [again[a:b] - at for at, a, b in zip(starts, cuts[:-1], cuts[1:])]


def runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Consecutive numbers as (first, how many)."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) != 1) + 1
    return [(int(p[0]), len(p)) for p in np.split(starts, cuts)]


def _merge_batches(batches):
    """Over cut-out stretches sorted by minimizer: the repeats among those of the same minimizers, MERGE_BYTES at once."""

    def work(rows):
        rows = sorted({(r[0], r[2], r[1]): r for r in rows}.items())  # repeated rows bring a piece several times
        rows = [r for _, r in rows]
        out = []
        for (doc, text_hash, start, _, _), again in zip(rows, repeated_windows([r[4] for r in rows])):
            out += [(doc, text_hash, start + a, n) for a, n in runs(again)]
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "text_hash", "start", "windows"])

    rows, size, last = [], 0, None
    for b in batches:
        for r in zip(*[b.column(i).to_pylist() for i in range(5)]):
            if size >= MERGE_BYTES and r[3] != last:
                yield work(rows)
                rows, size = [], 0
            rows.append(r)
            size, last = size + len(r[4]), r[3]
    if rows:
        yield work(rows)


def cut_out(docs: DataFrame, places: DataFrame, make, schema: str) -> DataFrame:
    """make(batches of doc_id, text_hash, text, places) over the documents that have places; a document's places stay with it."""
    cuts = places.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "windows", "minimizer")).alias("cuts"))
    return docs.join(cuts, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "cuts").mapInArrow(make, schema)


PIECES = "doc_id long, text_hash int, start int, minimizer long, content binary"
WINDOWS = "doc_id long, text_hash int, start int, h1 long, h2 long"


def _cuts(b):
    """doc_id, text_hash, start, minimizer and bytes of each place of a batch."""
    for doc, text_hash, text, cuts in zip(*[b.column(i).to_pylist() for i in range(4)]):
        raw = text.encode("utf-8", "surrogatepass")
        for c in cuts:
            yield doc, text_hash, c["start"], c["minimizer"], raw[c["start"] : c["start"] + c["windows"] + WINDOW - 1]


def _pieces(batches):
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    for b in batches:
        out = list(_cuts(b))
        for k in range(0, len(out), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out[k : k + 5000]), kinds)], [x.split()[0] for x in PIECES.split(", ")])


def _window_hashes(batches):
    """A 128-bit hash of every window of the places."""
    for b in batches:
        for doc, text_hash, start, _, raw in _cuts(b):
            data, n = np.frombuffer(raw, np.uint8), len(raw) - WINDOW + 1
            halves = []
            with np.errstate(over="ignore"):
                for odd in (PRIME, PRIME * np.uint64(3)):
                    h = mix(data.astype(np.uint64) * odd + odd)
                    powers = np.cumprod(np.full(WINDOW, odd))[::-1]
                    halves.append(mix((np.lib.stride_tricks.sliding_window_view(h, WINDOW) * powers).sum(axis=1, dtype=np.uint64)).view(np.int64))
            columns = [np.full(n, doc, np.int64), np.full(n, text_hash, np.int32), np.arange(start, start + n, dtype=np.int32), *halves]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), [x.split()[0] for x in WINDOWS.split(", ")])


def later_windows(windows: DataFrame) -> DataFrame:
    """Windows that are not the first of their hash, by a grouped minimum and a join that can be split."""
    windows = durable(windows, "windows")
    place = F.struct("doc_id", "start", "text_hash")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"))
    return windows.join(first, ["h1", "h2"]).where(place != F.col("first")).select("doc_id", "text_hash", "start", F.lit(1).alias("windows"))


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, windows: runs of windows that start earlier elsewhere too."""
    places = docs.where("doc_id is not null").select("doc_id", "text_hash", "text").mapInArrow(_place_batches, PLACES)
    # what is known to repeat needs no partner: it is spread by its place
    key = F.when(F.col("repeat"), F.xxhash64("doc_id", "start")).otherwise(F.col("minimizer"))
    dealt = places.withColumn("key", key).repartition("key").sortWithinPartitions("minimizer", "content", "doc_id", "start", "text_hash").drop("key")
    met = durable(dealt.mapInArrow(_meet, PLACES), "stretches")
    known = met.where("repeat").select("doc_id", "text_hash", "start", "windows")
    open_ = met.where("not repeat").select("doc_id", "text_hash", "start", "windows", "minimizer")
    crowds = durable(open_.groupBy("minimizer").count().where(F.col("count") > CROWD).select("minimizer"), "crowds")
    n_crowds = crowds.count()
    calm = cut_out(docs, open_.join(small(crowds, n_crowds), "minimizer", "left_anti"), _pieces, PIECES)
    sorted_ = calm.repartition("minimizer").sortWithinPartitions("minimizer", "doc_id", "start")
    found = sorted_.mapInArrow(_merge_batches, "doc_id long, text_hash int, start int, windows int")
    found = known.unionByName(found)
    if n_crowds:
        found = found.unionByName(later_windows(cut_out(docs, open_.join(small(crowds, n_crowds), "minimizer", "left_semi"), _window_hashes, WINDOWS)))
    return durable(found, "repeats")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, removed: array of (start, end) in bytes, maximal runs; kept: the remaining bytes joined."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("text_hash", F.hash("text"))
    gathered = repeats(docs).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "windows")).alias("found"))
    joined = docs.join(gathered, ["doc_id", "text_hash"], "left").select("doc_id", "text", "found")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def remove(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                sizes, spans, kept = [], [], []
                for t, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    raw = t.encode("utf-8", "surrogatepass")
                    gone, last, left = [], 0, []
                    for s, e in sorted((x["start"], x["start"] + x["windows"] + WINDOW - 1) for x in found or []):
                        if gone and s <= gone[-1]["end"]:
                            gone[-1]["end"] = max(gone[-1]["end"], e)
                        else:
                            gone.append({"start": s, "end": e})
                    for x in gone:
                        left.append(raw[last : x["start"]])
                        last = x["end"]
                    sizes.append(len(raw))
                    spans.append(gone)
                    kept.append(b"".join([*left, raw[last:]]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    return joined.mapInArrow(remove, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
