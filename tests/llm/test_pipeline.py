"""The pipeline, stage by stage, on a small corpus with planted cases, against brute-force decisions."""

import random
import struct

import pytest

import corpus_pipeline

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, tmp_path):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 8))) for _ in range(800)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    prose = lambda: ". ".join(say(rnd.randint(5, 14)).capitalize() for _ in range(10))
    texts = [prose() if i % 5 else " ".join(rnd.choice(words).upper() + "!!" for _ in range(90)) for i in range(200)]
    items = [say(25) for _ in range(4)]
    texts[101] = prose() + " " + items[2].upper() + ". " + prose()
    texts[102] = prose() + ' token = "abcdef0123456789abcdef0123" ' + prose()
    texts[104] = texts[103]
    rows = [(i, t, "en", f"s{i % 5}", len(t)) for i, t in enumerate(texts)] + [(103, texts[103], "en", "s3", 1), (None, prose(), None, None, None)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return texts


def test_stages_take_effect_one_after_another(spark, tmp_path):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    texts = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out-{k}")
        docs = spark.read.parquet(f"{tmp_path}/out-{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        kept.append({r.doc_id: r for r in docs.collect()})
    good = {i for i in range(200) if i % 5}
    assert set(kept[0]) - {None} == good  # junk goes, clean documents stay
    assert set(kept[1]) - {None} == good - {104} and spark.read.parquet(f"{tmp_path}/out-1").where("doc_id = 103").count() == 1
    assert set(kept[2]) - {None} == good - {104, 101}
    assert all(kept[3][i].text == texts[i] for i in kept[2] if i not in (None, 102))
    assert "abcdef0123" not in kept[3][102].text and kept[3][102].n_chars == len(kept[3][102].text)
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    for i in list(kept[4])[:20]:
        ids = library.encode(kept[3][i].text, add_special_tokens=False).ids
        assert bytes(kept[4][i].ids) == struct.pack(f"<{len(ids)}I", *ids) and kept[4][i].n_tokens == len(ids)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {(r.doc_id, r.n_tokens) for r in got.collect()} == {(i, r.n_tokens) for i, r in kept[4].items()}


def test_an_empty_corpus_passes_through(spark, tmp_path):
    corpus(spark, tmp_path)
    docs = spark.createDataFrame([], DOCUMENTS)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/none-{k}")
        docs = spark.read.parquet(f"{tmp_path}/none-{k}")
    assert docs.count() == 0


def test_near_copies_of_similarity_four_fifths_go(spark, tmp_path):
    rnd = random.Random(4)
    say = lambda n: ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    shingles = lambda ws: {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
    rows, copies = [], set()
    for n in range(150):
        words = say(rnd.randint(60, 300))
        other = words[:]
        # a word changed takes five shingles of each side: the similarity is from 0.8 to 0.97, or just below 0.7
        changed = max(1, round(len(words) * (rnd.uniform(0.003, 0.02) if n % 3 else 0.045)))
        for at in range(changed):
            other[10 + at * (len(words) - 20) // changed] = "changed" + str(n)
        alike = len(shingles(words) & shingles(other)) / len(shingles(words) | shingles(other))
        copies |= {1000 + n} if alike >= 0.8 else set()
        rows += [(n, " ".join(words), "en", "s", 1), (1000 + n, " ".join(other).upper(), "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert 90 <= len(copies) <= 110 and kept == {r[0] for r in rows} - copies


def test_a_large_group_of_near_copies_is_one_component(spark):
    from fundsieve.llm import simhash

    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(w if i != 20 + k % 150 else f"x{k}" for i, w in enumerate(words)) for k in range(400)] + ["", None, "one two", "One  two!"]
    frame = spark.createDataFrame(list(enumerate(texts)) + [(None, "one two")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar(frame).collect()}
    assert got == {i: 0 for i in range(400)} | {400: 400, 401: 400, 402: 402, 403: 402}
    assert simhash.similar(frame.where("false")).count() == 0


def test_bits_beyond_the_golay_keys_are_refused(spark):
    from fundsieve.llm import simhash

    with pytest.raises(ValueError):
        simhash.near_duplicates(spark.createDataFrame([(1, "a")], "doc_id long, text string"), bits=3)


def test_different_texts_of_one_id_are_judged_each_on_its_own(spark, tmp_path):
    rnd = random.Random(5)
    say = lambda: " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(60))
    a, b, c = say(), say(), say()
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (1, b, "de", "s", 1), (2, b, "en", "s", 1), (3, c, "en", "s", 2), (3, c, "en", "s", 1), (None, a, "en", "s", 1)]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCUMENTS), str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text, r.lang, r.n_chars) for r in out) == sorted([(0, a, "en", 1), (1, a, "en", 1), (1, b, "de", 1), (3, c, "en", 1)])


def test_no_shared_folder_on_a_cluster_is_an_error():
    from types import SimpleNamespace

    from fundsieve.llm import common

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        common.shared_dir(SimpleNamespace(conf={}, sparkContext=context))
