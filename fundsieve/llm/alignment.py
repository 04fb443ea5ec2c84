"""Alignment of two tokenizers over the same text, by lockstep vectorised merging (operator 12).

Of each document the byte ranges of its tokens by tokenizer A and by tokenizer B are walked like two sorted lists. One
NumPy state vector holds the A and B pointer of every document of a batch; each step emits the link between the two
tokens that are pointed at, emits a cut where both end, advances the pointer whose token ends first (both at a cut) and
drops the lanes that have ended. A document takes several lanes if it is long: at a space that follows a letter both
tokenizers always begin anew, so a lane may begin there. Batches are bounded in bytes of text, lanes in chunks.

Tokens come from the tokenizers' own libraries. Texts are cut into chunks at such spaces, which neither tokenizer's
tokens cross, and a task asks its libraries for each distinct chunk once,
many at a time as one text; that this gives the chunks' own bytes and ends is checked each time.

How often an id pair is linked in the whole corpus is a grouped sum. Pairs with more than one in HOT of all links are
HOT at most, by arithmetic, and their counts go to the tasks as an array; all others go through a shuffled join in
which no key has more than one in HOT of all links. So no pair, however frequent, meets in one task.

Defined results: a text that is null, empty, or whose tokens' joined bytes by either tokenizer differ from space + text
has no tokens and no links. Rows are independent: repeated rows count each, and null ids come out as they went in.
Extra columns are not read. An empty table gives an empty table. A run without a space is one chunk, however long.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import durable, in_slices, tidy

#: Bytes of text of one batch of documents; chunks of one lane.
BATCH_BYTES, LANE = 4_000_000, 256
#: Chunks that a task remembers, and their characters; characters that are encoded as one text.
MEMO, MEMO_CHARS, TOGETHER = 300_000, 8_000_000, 50_000
#: Most id pairs whose counts are sent to all tasks.
HOT = 100_000
#: From a space that follows a non-space to the next one.
CHUNK = re.compile(r" *\S*(?:[^\S ]\s*\S*)*")


class Tokens:
    """Ids of texts that begin with a space by a library, and the bytes of each id."""

    def __init__(self, encode, strings: list[bytes]):
        self.encode, self.strings = encode, strings
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.decimals = pa.array([str(i) for i in range(len(strings))])

    def bytes_of(self, ids) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids))


def byte_level(path: str) -> Tokens:
    """A byte-level BPE of the tokenizers library; strings of special tokens are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are parallel already
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    back = {s: b for b, s in enumerate(byte_symbols())}
    strings = [t.id_to_token(i) or "" for i in range(t.get_vocab_size(True))]
    return Tokens(lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)], [bytes(back[c] for c in s if c in back) for s in strings])


def pieces(path: str) -> Tokens:
    """A sentencepiece model, which puts a space before what it encodes: the chunk's own."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any("▁" in name.lstrip("▁") for name in names):
        raise ValueError("a piece has a space after other characters, so texts cannot be cut at spaces")
    strings = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    space = [model.piece_to_id("▁")]  # a last space alone: the library gives an empty text no tokens
    return Tokens(lambda texts: [ids or space for ids in model.encode([t[1:] for t in texts], num_threads=1)], strings)


class Known:
    """Ids of the chunks that were met, by both tokenizers, as flat arrays; starts anew when full."""

    def __init__(self, sides: tuple[Tokens, Tokens]):
        self.sides = sides
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.size = 0  # bytes of all of them
        self.whole = np.zeros(0, bool)  # whether the bytes of both are those of the chunk
        self.ends, self.ids = ([np.zeros(1, np.int64)] * 2, [np.zeros(0, np.int64)] * 2)

    def number(self, chunks: list[str]) -> np.ndarray:
        """The number of each chunk."""
        new = [c for c in dict.fromkeys(chunks) if c not in self.places]
        # what ends with a letter may be encoded in one go with what follows
        plain, odd = [], []
        for c in new:
            (odd if c[-1].isspace() or "▁" in c else plain).append(c)
        at = held = 0
        for k, c in enumerate(plain):
            held += len(c)
            if held > TOGETHER or k == len(plain) - 1:
                if not self.add_together(plain[at : k + 1]):
                    odd += plain[at : k + 1]
                at, held = k + 1, 0
        if odd:
            found = [side.encode(odd) for side in self.sides]
            whole = [all(side.bytes_of(ids[k]) == c.encode() for side, ids in zip(self.sides, found)) for k, c in enumerate(odd)]
            self.add(odd, whole, [(np.array([i for ids in side for i in ids], np.int64), np.cumsum([len(ids) for ids in side])) for side in found])
        return np.fromiter(map(self.places.__getitem__, chunks), np.int64, len(chunks))

    def add_together(self, chunks: list[str]) -> bool:
        """Encode chunks as one text; False if the tokens' bytes are not those of the text or cross a chunk's end."""
        text = "".join(chunks)
        raw, found = text.encode(), []
        stops = np.cumsum([len(c.encode()) for c in chunks])
        for side in self.sides:
            (ids,) = side.encode([text])
            if side.bytes_of(ids) != raw:
                return False
            ids = np.array(ids, np.int64)
            byte = np.cumsum(side.sizes[ids])
            ends = np.searchsorted(byte, stops)
            if (byte[ends] != stops).any():
                return False
            found.append((ids, ends + 1))
        self.add(chunks, [True] * len(chunks), found)
        return True

    def add(self, chunks: list[str], whole: list[bool], found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """found: for each side the ids of all chunks and the places at which each chunk's end."""
        self.places |= zip(chunks, range(len(self.places), len(self.places) + len(chunks)))
        self.size += sum(map(len, chunks))
        self.whole = np.append(self.whole, np.array(whole, bool))
        for k, (ids, ends) in enumerate(found):
            self.ends[k] = np.append(self.ends[k], ends + len(self.ids[k]))
            self.ids[k] = np.append(self.ids[k], ids)

    def forget(self) -> None:
        """After a batch: everything if there is too much of it."""
        if len(self.places) > MEMO or self.size > MEMO_CHARS:
            self.clear()

    def tokens(self, side: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, one after the other, and how many each has."""
        ends = self.ends[side]
        counts = ends[numbers + 1] - ends[numbers]
        upto = np.cumsum(counts)
        at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(ends[numbers] - upto + counts, counts)
        return self.ids[side][at], counts


def lockstep(a_end: np.ndarray, b_end: np.ndarray, a_from: np.ndarray, b_from: np.ndarray, a_stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (A and B token places) and cuts (places of the A and B tokens that end there) of all lanes.

    a_end, b_end: the byte at which each token ends. A lane begins at a_from, b_from and ends before a_stop, where both
    sides end at one byte.
    """
    state = np.stack([a_from, b_from, a_stop])[:, a_from < a_stop]
    links, cuts = [], []
    while state.shape[1]:
        i, j = state[0], state[1]
        links.append(state[:2].copy())
        x, y = a_end[i], b_end[j]
        first, second = x <= y, y <= x
        cuts.append(state[:2, first & second])
        i += first
        j += second
        live = i < state[2]
        if not live.all():
            state = state[:, live]
    none = np.zeros((2, 0), np.int64)
    (la, lb), (ca, cb) = (np.concatenate([none, *x], axis=1) for x in (links, cuts))
    return la, lb, ca, cb


def spread(counts: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Sums of counts over consecutive runs of `per` of them."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    at = np.concatenate([[0], np.cumsum(per)])
    return ends[at[1:]] - ends[at[:-1]]


def aligned_batch(texts: list[str | None], known: Known) -> list[pa.Array]:
    """n_a, n_b, n_groups, n_links, groups, pairs, times of each text of one batch."""
    sides, width = known.sides, len(known.sides[1].strings)
    cut = [CHUNK.findall(" " + t) if t else [] for t in texts]
    for c in cut:
        if c:
            c.pop()  # the empty match at the end
    per = np.array([len(c) for c in cut], np.int64)
    numbers = known.number([c for found in cut for c in found])
    whole = known.whole[numbers]
    bad = np.flatnonzero(spread(~whole, per))
    if len(bad):  # a text all of whose bytes agree is kept even if the bytes of its chunks lie differently
        ends = np.cumsum(per)
        kept = np.ones(len(numbers), bool)
        for d in bad:
            mine = numbers[ends[d] - per[d] : ends[d]]
            raw = (" " + texts[d]).encode()
            if any(side.bytes_of(known.tokens(k, mine)[0]) != raw for k, side in enumerate(sides)):
                kept[ends[d] - per[d] : ends[d]] = False
                per[d] = 0
        numbers = numbers[kept]
    (a, a_per), (b, b_per) = (known.tokens(k, numbers) for k in (0, 1))
    a_end, b_end = np.cumsum(sides[0].sizes[a]), np.cumsum(sides[1].sizes[b])
    # lanes: every LANE chunks of a document, where the chunks before have the same bytes on both sides
    first = np.concatenate([[0], np.cumsum(per)])[:-1]
    within = np.arange(len(numbers)) - np.repeat(first, per)
    a_at, b_at = np.cumsum(a_per) - a_per, np.cumsum(b_per) - b_per
    agree = np.concatenate([[0], a_end])[a_at] == np.concatenate([[0], b_end])[b_at]
    begin = np.flatnonzero((within == 0) | (within % LANE == 0) & agree)
    a_from, b_from = a_at[begin], b_at[begin]
    la, lb, ca, cb = lockstep(a_end, b_end, a_from, b_from, np.append(a_from, len(a))[1:])
    n_a, n_b = spread(a_per, per), spread(b_per, per)
    doc_of = np.repeat(np.arange(len(texts)), n_a)
    n_links, n_groups = (np.bincount(doc_of[x], minlength=len(texts)) for x in (la, ca))
    # distinct id pairs of each document; the document in the upper bits keeps them apart
    key, times = np.unique(doc_of[la] << 40 | a[la] * width + b[lb], return_counts=True)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(key >> 40, minlength=len(texts)))]).astype(np.int32)
    groups = [joined(side.decimals.take(pa.array(ids)), np.sort(places) + 1, ",") for side, ids, places in ((sides[0], a, ca), (sides[1], b, cb))]
    groups = joined(pc.binary_join_element_wise(*groups, "|"), np.cumsum(n_groups), ";")
    lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (key & (1 << 40) - 1, times)]
    return [*(pa.array(n, pa.int64()) for n in (n_a, n_b, n_groups, n_links)), groups, *lists]


def joined(strings: pa.Array, ends: np.ndarray, by: str) -> pa.Array:
    """Strings up to each end joined to one."""
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, strings), by)


@lru_cache(maxsize=2)
def load(a_path: str, b_path: str) -> Known:
    known = Known((byte_level(a_path), pieces(b_path)))
    if max(len(known.sides[0].strings), 1) * max(len(known.sides[1].strings), 1) >= 1 << 40:
        raise ValueError("id pairs need more than 40 bits")
    return known


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times: a row for each row of docs.

    groups is `a1,a2|b1;a3|b2,b3`, the ids between cuts; pairs are the distinct linked ids as A's * B's vocabulary +
    B's, times how many links of the document each has.
    """

    def run(batches):
        known = load(a_path, b_path)
        for batch in batches:
            for part in in_slices(batch, 1, BATCH_BYTES):
                found = aligned_batch(part.column(1).to_pylist(), known)
                known.forget()
                yield pa.RecordBatch.from_arrays([part.column(0), *found], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run, lambda: load(a_path, b_path).clear()), "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>")


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """pair, n, best: links of each id pair in all documents, and whether no pair of its B id has more."""

    def partial(batches):
        for batch in batches:
            pairs, times = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1))
            distinct, place = np.unique(pairs, return_inverse=True)
            sums = np.bincount(place, weights=times, minlength=len(distinct)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(distinct, pa.int64()), pa.array(sums)], ["pair", "n"])

    counts = durable(aligned.select("pairs", "times").mapInArrow(tidy(partial), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    of = (F.col("pair") % b_size).alias("b")
    most = F.broadcast(counts.groupBy(of).agg(F.max("n").alias("most")))  # a row for each id of B's vocabulary at most
    return counts.withColumn("b", of).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_counts(aligned: DataFrame, b_size: int, hot: int = HOT) -> DataFrame:
    """aligned (with row, unique) without pairs and times, with n_best and count_sum.

    n_best: links whose pair no pair of the same B id exceeds in the corpus; count_sum: the corpus counts of all links.
    """
    counts = durable(pair_counts(aligned, b_size), "pairs")
    links = counts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * hot > links  # true for fewer than `hot` pairs, as their counts sum to no more than all links
    known = counts.where(often).orderBy("pair").toPandas()
    sent = aligned.sparkSession.sparkContext.broadcast(tuple(known[c].to_numpy() for c in ("pair", "n", "best")))
    rest = [c for c in aligned.columns if c not in ("pairs", "times")]

    def look_up(batches):
        pair, n, best = sent.value
        for batch in batches:
            lists = batch.column(len(rest))
            pairs, times = (batch.column(len(rest) + k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1))
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            at = np.searchsorted(pair, pairs)
            there = np.zeros(len(pairs), bool)
            there[at < len(pair)] = pair[at[at < len(pair)]] == pairs[at < len(pair)]
            at, hits, k = at[there], times[there], row[there]
            sums = [exact_sums(k, x, batch.num_rows) for x in (hits * best[at], hits * n[at])]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row[~there], minlength=batch.num_rows))]).astype(np.int32)
            left = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[~there], pa.int64())) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *map(pa.array, sums), *left], [*rest, "n_best", "count_sum", "pairs", "times"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.select(*rest).schema)
    found = durable(aligned.select(*rest, "pairs", "times").mapInArrow(tidy(look_up), f"{kept}, n_best long, count_sum long, pairs array<long>, times array<long>"), "links")
    seldom = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times")
    met = seldom.join(counts.where(~often), F.col("pairs") == F.col("pair"))
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    both = found.drop("pairs", "times").join(sums, "row", "left")
    add = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
    return both.select(*rest, add("n_best", F.col("more_best")), add("count_sum", F.col("more_sum")))


def exact_sums(place: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of integers by ascending place, without the rounding of floats."""
    ends = np.concatenate([[0], np.cumsum(values.astype(np.int64))])
    at = np.searchsorted(place, np.arange(size + 1))
    return ends[at[1:]] - ends[at[:-1]]


def aligned_digests(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 (empty without tokens), n_best, count_sum."""
    said = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    found = align(docs, a_path, b_path, key, text).select("doc_id", "n_a", "n_b", "n_groups", "n_links", said, "pairs", "times")
    found = durable(found.withColumn("row", F.monotonically_increasing_id()), "aligned")
    return link_counts(found, len(load(a_path, b_path).sides[1].strings)).drop("row")
