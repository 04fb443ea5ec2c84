"""The mix of sources and the importance resampling against plain computations, and their edges."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from fundsieve.llm import mixing, resampling

SCHEMA = "doc_id long, text string, source string, n_words int, size string, score int, weight int, _source int, _class int"


def docs(spark, rows):
    """rows: id, text, source."""
    return spark.createDataFrame([(i, t, s, 1, "x", 2, 3, 4, 5) for i, t, s in rows], SCHEMA)


def made(rnd, n, sources, ids=None):
    return [(i if ids is None else ids[i], rnd.choice([None, "", " \t"] + ["w\n" * min(int(rnd.paretovariate(0.8) * 5), 3000)] * 9), rnd.choice(sources)) for i in range(n)]


def water(sizes, weights, cap):
    """Targets by the literal rounds, in fractions."""
    total, capped = Fraction(sum(sizes.values())), {}
    while True:
        open_ = [s for s in sizes if s not in capped]
        left = total - sum(capped.values())
        shares = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        above = {s: Fraction(cap * sizes[s]) for s in open_ if shares[s] > cap * sizes[s]}
        if not above:
            return shares | capped
        capped |= above


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_taken_words(spark, seed):
    rnd = random.Random(seed)
    sources = ["b", "a", None, "Z", "é", "big", "big", "big", "tiny"]
    rows = [r for r in made(rnd, 3000, sources) if r[2] != "tiny" or rnd.random() < 0.05]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows) and {"weight", "score", "text", "copies"} <= set(got[0].asDict())
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = water(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 3)
    taken = Counter()
    for r in got:
        assert r.size == size(r.text) and r.source_size == sizes[r.source] and 0 <= r.copies <= 3
        assert r.target == pytest.approx(float(want[r.source]), rel=1e-12)
        taken[r.source] += r.copies * r.size
    for s in sizes:  # of a source of some documents only, one of them may be too much or too little
        few = max(r.size for r in got if r.source == s) if s == "tiny" else 30
        assert abs(taken[s] - want[s]) <= max(0.01 * want[s], few), s
    assert sum(taken.values()) == pytest.approx(sum(sizes.values()), rel=0.01)


def test_the_sum_is_systematic(spark):
    """Within a source copies follow the expected ones: the count of any run of equal documents differs by less than two."""
    rows = [(i, "w " * 7, "a") for i in range(500)] + [(i, "w " * 100, "b") for i in range(500, 520)]
    got = {r.doc_id: r for r in mixing.mix(docs(spark, rows), weights=(1, 1)).collect()}
    rate = got[0].target / got[0].source_size
    assert sum(got[i].copies for i in range(500)) == pytest.approx(500 * rate, abs=1) and 0 < rate < 1
    assert {got[i].copies for i in range(500)} == {0, 1}


def test_reruns_agree_and_partitions_do_not_matter(spark):
    rows = made(random.Random(9), 2000, ["a", "b", None])
    one, two = (sorted((r.doc_id, r.copies) for r in mixing.mix(docs(spark, rows).repartition(n)).collect()) for n in (1, 13))
    assert one == two
    other = mixing.mix(docs(spark, rows), seed=5).collect()
    assert sorted((r.doc_id, r.copies) for r in other) != one


def test_one_source_keeps_everything_and_emission_repeats(spark):
    rows = [(k, "a b c", "s") for k in range(50)]
    assert {r.copies for r in mixing.mix(docs(spark, rows)).collect()} == {1}
    rows = [(k, "a b c", "s") for k in range(5)] + [(9, "x " * 1000, "t")]
    out = mixing.emitted(mixing.mix(docs(spark, rows))).collect()
    assert Counter(r.doc_id for r in out if r.source == "s") == {k: 3 for k in range(5)}
    assert sorted(r.copy for r in out if r.doc_id == 2) == [1, 2, 3]


def test_edges_of_the_mix(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    none = mixing.mix(docs(spark, [(1, None, None), (2, "", "a"), (None, " ", "a")])).collect()
    assert {(r.size, r.source_size, r.target, r.copies) for r in none} == {(0, 0, 0.0, 0)} and len(none) == 3
    again = mixing.mix(docs(spark, [(7, "a b", "s")] * 40 + [(None, "a b", "s"), (7, "c d", "s")])).collect()
    assert len(again) == 42 and {r.copies for r in again} == {1}


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(rows, target, run, buckets, percent, least):
    def feats(t):
        ws = re.findall(WORD, lower(t))
        return len(ws), [" ".join(ws[i : i + k]) for k in range(1, run + 1) for i in range(len(ws) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in feats(x)[1]) for texts in ([r[1] for r in rows], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, text, *_ in rows:
        n, fs = feats(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    drawn = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(drawn[: percent * len(drawn) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=repr)


@pytest.mark.parametrize("run, buckets, segment_rows, samples", [(1, 10_000, 1_000_000, 64), (1, 3, 10, 3), (2, 50, 7, 1), (3, 10_000, 100, 7)])
def test_resampling_equals_brute_force(spark, monkeypatch, run, buckets, segment_rows, samples):
    monkeypatch.setattr(resampling, "SEGMENT_ROWS", segment_rows)
    monkeypatch.setattr(resampling, "SAMPLES", samples)
    rnd = random.Random(run * 100 + buckets)
    vocabulary = ["The", "cat", "Äpfel", "été", "X1", "日本", "b"]
    say = lambda n: rnd.choice([" ", ", ", "\n", "\x00"]).join(rnd.choice(vocabulary) for _ in range(n))
    rows = [(i, say(rnd.randint(0, 60)), "s") for i in range(700)] + [(-3, None, "s"), (701, "", "s"), (702, "! ?", "s")]
    target = [say(30) for _ in range(5)] + ["cat cat cat", None]
    items = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, doc_id int")
    got = resampling.resample(docs(spark, rows).repartition(9), items, run=run, buckets=buckets, percent=37, least_words=10)
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()), key=repr)
    assert got == brute(rows, target, run, buckets, 37, 10)


def test_ranks_are_whole_with_ties_repeats_and_null_ids(spark):
    text = "one two three " * 10
    rows = [(5, text, "s")] * 300 + [(None, text, "s")] * 100 + [(k, text, "s") for k in range(100)]
    items = spark.createDataFrame([("one",)], "text string")
    got = resampling.resample(docs(spark, rows).repartition(5), items, percent=100).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 501))
    ordered = sorted(got, key=lambda r: r["rank"])
    assert [(-r.score, r.doc_id is None, r.doc_id or 0) for r in ordered] == sorted((-r.score, r.doc_id is None, r.doc_id or 0) for r in got)
    assert all(r["rank"] is None for r in resampling.resample(docs(spark, rows), items, percent=0).collect())


def test_edges_of_resampling(spark):
    items = spark.createDataFrame([("one",)], "text string")
    assert resampling.resample(docs(spark, []), items).count() == 0
    got = resampling.resample(docs(spark, [(1, "few words", "s"), (2, None, "s")]), items.limit(0)).collect()
    assert sorted((r.doc_id, r.n_features, r["rank"]) for r in got) == [(1, 2, None), (2, 0, None)]


def test_the_queries_equal_their_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from fundsieve.llm import queries

    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["alpha", "Beta", "été", "x9", "\x0b"]) for _ in range(rnd.randint(0, 90))), rnd.choice(["a", "b", "c", None])) for i in range(400)] + [(900, None, None), (901, "", "d")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "beta beta x9 gamma")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("op11_source_mix", "op13_importance_resampling"):
        got = queries.queries()[name](spark, str(tmp_path))
        want = con.execute(queries.oracle_sql()[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))
