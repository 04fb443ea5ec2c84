"""BPE encoding, decoding and token counts (operators 9 and 10).

A pre-token is encoded with a priority queue of merge ranks over a doubly linked list of symbols; queue entries
whose symbols have meanwhile been merged are stale and skipped. Decoding joins the vocabulary strings of the ids.
A chunk of text between white space is encoded once and remembered. The tokenizer file is a parameter and is read
where the tasks run; which of its strings encode alone as one token is proved once, before, and sent to the tasks.

Defined results: a null text is the empty text (no tokens, empty decoded text). Texts are read whole, whatever
their length. Rows are independent, so repeated rows and null ids come out as they went in. Extra columns of the
input are not read, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Entries of a task's memo of encoded words; it starts anew when full, so memory stays bounded.
MEMO = 200_000
#: Rows of one output batch; ids and decoded text are larger than the text itself.
OUT_ROWS = 256


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    shifted = iter(range(256, 512))
    keep = set(printable)
    return [chr(b) if b in keep else chr(next(shifted)) for b in range(256)]


class Memo(dict):
    """Results by word, made when first asked for; starts anew when full."""

    def __init__(self, make, limit: int = MEMO):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word: str):
        if len(self) >= self.limit:
            self.clear()
        out = self[word] = self.make(word)
        return out


class WordBpe:
    """A byte-level BPE with word ends, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.added).items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        symbols = byte_symbols()
        self.inner = [self.vocab.get(s) for s in symbols]
        self.last = [self.vocab.get(s + self.end) for s in symbols]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.words = Memo(self.merge)
        self.packed = Memo(lambda c: pack([i for w in self.pieces(c) for i in self.words[w]]))
        self.listed = pa.array([self.strings.get(i, "") for i in range(max(self.strings, default=-1) + 1)], pa.large_string())

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        raw = word.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        ids = [i for i in ids if i is not None]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        merges = self.merges
        queue = []
        for i in range(n - 1):
            found = merges.get((ids[i], ids[i + 1]))
            if found:
                queue.append((found[0], i, found[1]))
        heapq.heapify(queue)
        while queue:
            rank, i, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j >= n or merges.get((ids[i], ids[j])) != (rank, new):
                continue  # stale
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = merges.get((new, ids[k]))
                if found:
                    heapq.heappush(queue, (found[0], i, found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((ids[h], new))
                if found:
                    heapq.heappush(queue, (found[0], h, found[1]))
        return tuple(i for i in ids if i >= 0)

    def forget(self) -> None:
        """What has been remembered of texts goes."""
        self.words.clear()
        self.packed.clear()

    def single_tokens(self) -> frozenset[str]:
        """The pre-tokens that encode alone as one token: vocabulary strings whose own encoding is that string.

        Only strings that the pre-tokenizer keeps whole count; each is proved by encoding it, not by its presence.
        """
        back = {s: b for b, s in enumerate(byte_symbols())}
        out = set()
        for s, i in self.vocab.items():
            if not s.endswith(self.end) or s == self.end or not all(c in back for c in s[: len(s) - len(self.end)]):
                continue
            try:
                word = bytes(back[c] for c in s[: len(s) - len(self.end)]).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if self.pieces(word) == [word] and self.merge(word) == (i,):
                out.add(word)
        return frozenset(out)

    def chunks(self, text: str) -> list[str]:
        """Normalised text, cut at white space: NFC, lower case by character."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        # str.split also splits at the separators U+001C to U+001F, which the pattern keeps
        return SPACE.split(text) if SEPARATORS.search(text) else text.split()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        out: list[bytes] = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            out += [pack([self.added[part]])] if k % 2 else map(self.packed.__getitem__, self.chunks(part))
        return b"".join(out)

    def decode(self, packed: list[bytes]) -> pa.Array:
        """For each list of ids their vocabulary strings, with one space between, as a tokenizer without decoder joins them."""
        offsets = pa.array(np.cumsum([0, *(len(x) // 4 for x in packed)]), pa.int32())
        strings = self.listed.take(pa.array(np.frombuffer(b"".join(packed), "<u4")))
        return pc.binary_join(pa.ListArray.from_arrays(offsets, strings), pa.scalar(" ", pa.large_string())).cast(pa.string())

    def count(self, text: str | None, of: Memo) -> int:
        """Tokens of a text; `of`: the tokens of each chunk."""
        if not text:
            return 0
        parts = self.special.split(text) if self.special else [text]
        return len(parts) // 2 + sum(sum(map(of.__getitem__, self.chunks(part))) for part in parts[::2])

    def counts(self, whole: frozenset[str]) -> Memo:
        """Tokens by chunk: pre-tokens that are proved to be whole tokens count one each, the rest are merged."""
        return Memo(lambda c: sum(1 if w in whole else len(self.words[w]) for w in self.pieces(c)), 2 * MEMO)


SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
SEPARATORS = regex.compile(r"[\x1c-\x1f]")


def pack(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def _columns(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers, packed), decoded (their vocabulary strings joined)."""

    def run(batches):
        bpe = load(path)
        for whole in batches:
            for at in range(0, whole.num_rows, OUT_ROWS):
                part = whole.slice(at, OUT_ROWS)
                ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), bpe.decode(ids)], ["doc_id", "ids", "decoded"])

    return _columns(docs, key, text).mapInArrow(tidy(run, lambda: load(path).forget()), "doc_id long, ids binary, decoded string")


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, decoded: the text of packed ids; null ids are no ids."""

    def run(batches):
        bpe = load(path)
        for part in batches:
            yield pa.RecordBatch.from_arrays([part.column(0), bpe.decode([x or b"" for x in part.column(1).to_pylist()])], ["doc_id", "decoded"])

    return encoded.select(F.col(key).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, decoded string")


@lru_cache(maxsize=4)
def proved(path: str) -> frozenset[str]:
    """The whole tokens of a tokenizer file, proved once."""
    return load(path).single_tokens()


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens."""
    whole = docs.sparkSession.sparkContext.broadcast(proved(path))  # of the vocabulary's size

    def run(batches):
        bpe = load(path)
        of = bpe.counts(whole.value)
        for part in batches:
            n = [bpe.count(t, of) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = _columns(docs, key, text).withColumn("n_bytes", F.coalesce(F.octet_length("text").cast("long"), F.lit(0)))
    return rows.mapInArrow(tidy(run, lambda: load(path).forget()), "doc_id long, n_bytes long, n_tokens long")
