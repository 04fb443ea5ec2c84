"""The alignment of two tokenizers against a plain walk with the libraries, and its edges."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from fundsieve.llm import alignment

SCHEMA = "doc_id long, text string, n_a int, groups string, row int, pairs int"
NAMES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(ids[i] if ids else i, t, 1, "x", 2, 3) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def paths():
    found = pytest.importorskip("public_tokenizers")
    return tuple(found.path(n) for n in NAMES)


@pytest.fixture(scope="module")
def libraries(paths):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(paths[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=paths[1])


def ends_of(parts):
    return np.cumsum([len(p) for p in parts]).tolist()


def brute(texts, libraries):
    """Rows by whole-text encoding, all overlapping ranges and Counter."""
    a, b = libraries
    back = {s: n for n, s in enumerate(alignment.byte_symbols())}
    rows, links = [], []
    for t in texts:
        x = a.encode(" " + t, add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        xs = [bytes(back[c] for c in a.id_to_token(i)) for i in x]
        ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not t or any(b"".join(z) != (" " + t).encode() for z in (xs, ys)):
            x, y, xs, ys = [], [], [], []
        ex, ey = ends_of(xs), ends_of(ys)
        cuts = sorted(set(ex) & set(ey))
        mine = [(x[i], y[j]) for i in range(len(x)) for j in range(len(y)) if max(ex[i] - len(xs[i]), ey[j] - len(ys[j])) < min(ex[i], ey[j])] if len(x) < 400 else None
        if mine is None:
            mine, j = [], 0
            for i in range(len(x)):
                while ey[j] <= ex[i] - len(xs[i]):
                    j += 1
                k = j
                while k < len(y) and ey[k] - len(ys[k]) < ex[i]:
                    mine.append((x[i], y[k]))
                    k += 1
        said = [[",".join(str(ids[k]) for k in range(len(ids)) if lo < ends[k] <= hi) for ids, ends in ((x, ex), (y, ey))] for lo, hi in zip([0, *cuts], cuts)] if len(x) < 400 else None
        rows.append((len(x), len(y), len(cuts), len(mine), None if said is None else ";".join("|".join(g) for g in said)))
        links.append(mine)
    counts = Counter(p for mine in links for p in mine)
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return rows, [(sum(counts[p] == most[p[1]] for p in mine), sum(counts[p] for p in mine)) for mine in links]


EDGES = [
    None,
    "",
    " ",
    "   a  b ",
    "a\n\n b \t\nc  ",
    "x▁y and more",
    "<|endoftext|> <s> </s> <unk> <0x41>",
    "don't WE'LL it's 1234567890 3.14",
    "café naïve ﬁ é é 日本語 テキスト 😀👍🏽 ​ 　x",
    "a\x00b\x1c \x1d c\x1f d \x85 e",
    "word " * 700,
    "nospace" * 300,
    "=" * 1000 + " " * 50 + "!" * 30,
    "same text here", "same text here",
]


def texts():
    rnd = random.Random(5)
    parts = ["the", " ", "  ", "\n", "Zürich", "'s", "123", "\t", "é", "日本", "▁", "😀", "qwxz", "_", "-", "\x1c", "　", "ing", "un", "(", ")."]
    return EDGES + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 120))) for _ in range(150)]


@pytest.mark.parametrize("hot, lane, size", [(100_000, 256, 4_000_000), (20, 1, 300), (0, 3, 4_000_000)])
def test_alignment_equals_brute_force(spark, paths, libraries, monkeypatch, hot, lane, size):
    monkeypatch.setattr(alignment, "LANE", lane)
    monkeypatch.setattr(alignment, "BATCH_BYTES", size)
    data = texts()
    want, sums = brute(data, libraries)
    rows = sorted(alignment.align(docs(spark, data), *paths).collect())
    assert [r.doc_id for r in rows] == list(range(len(data)))
    for r, w, t in zip(rows, want, data):
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == w[:4], t
        assert w[4] is None or r.groups == w[4], t
        assert sum(r.times) == r.n_links and len(set(r.pairs)) == len(r.pairs)
    assert {w[0] > 0 for w in want} == {True, False}
    from pyspark.sql import functions as F

    found = alignment.durable(alignment.align(docs(spark, data), *paths).withColumn("row", F.monotonically_increasing_id()), "test")
    counted = {r.doc_id: (r.n_best, r.count_sum) for r in alignment.link_counts(found, 32_000, hot).collect()}
    assert counted == dict(enumerate(sums))


def test_lockstep_on_random_ranges():
    rnd = random.Random(7)
    for _ in range(50):
        lanes = []
        for _ in range(rnd.randint(1, 6)):
            n = rnd.randint(1, 30)
            lanes.append([sorted({n, *rnd.sample(range(1, n + 1), rnd.randint(0, n - 1))}) for _ in "ab"])
        base, ends, starts = 0, ([], []), ([], [])
        for lane in lanes:
            for k in (0, 1):
                starts[k].append(len(ends[k]))
                ends[k].extend(base + e for e in lane[k])
            base = ends[0][-1]
        la, lb, ca, cb = alignment.lockstep(np.array(ends[0]), np.array(ends[1]), np.array(starts[0]), np.array(starts[1]), np.array([*starts[0][1:], len(ends[0])]))
        ranges = [list(zip([0, *e], e)) for e in ends]
        assert sorted(zip(la.tolist(), lb.tolist())) == [(i, j) for i, (s, e) in enumerate(ranges[0]) for j, (u, v) in enumerate(ranges[1]) if max(s, u) < min(e, v)]
        assert sorted(ends[0][i] for i in ca) == sorted(ends[1][j] for j in cb) == sorted(set(ends[0]) & set(ends[1]))


def test_a_small_memo_changes_nothing(spark, paths, monkeypatch):
    data = texts()
    want = [tuple(r) for r in sorted(alignment.align(docs(spark, data), *paths).select("doc_id", "n_a", "groups").collect())]
    known = alignment.Known(alignment.load(*paths).sides)
    monkeypatch.setattr(alignment, "MEMO", 10)
    monkeypatch.setattr(alignment, "TOGETHER", 30)
    got = []
    for at in range(0, len(data), 7):
        found = alignment.aligned_batch(data[at : at + 7], known)
        known.forget()
        got += [(at + k, n, g) for k, (n, g) in enumerate(zip(found[0].to_pylist(), found[4].to_pylist()))]
    assert got == want


def test_empty_tables_repeats_and_null_ids(spark, paths):
    assert alignment.aligned_digests(docs(spark, []), *paths).count() == 0
    rows = alignment.aligned_digests(docs(spark, ["two words", "two words", "two words", None, ""], [3, 3, None, 4, None]), *paths).collect()
    full = [r for r in rows if r.n_a]
    assert sorted(r.doc_id or 0 for r in full) == [0, 3, 3] and {r.n_links for r in full} == {2}
    assert {(r.n_best, r.count_sum) for r in full} == {(2, 6)} and len({r.groups_sha256 for r in full}) == 1
    assert [(r.n_b, r.groups_sha256, r.n_best, r.count_sum) for r in rows if not r.n_a] == [(0, "", 0, 0)] * 2


def test_the_query(spark, paths, tmp_path):
    from fundsieve.llm import queries

    spark.createDataFrame([(1, "a small text")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    row = queries.op12_tokenizer_alignment(spark, str(tmp_path)).first()
    groups = alignment.align(spark.read.parquet(f"{tmp_path}/documents.parquet"), *paths).first().groups
    assert row.groups_sha256 == hashlib.sha256(groups.encode()).hexdigest() and row.doc_id == 1
