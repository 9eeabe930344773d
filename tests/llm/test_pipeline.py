"""The corpus pipeline, stage by stage, against what each must do to its own input."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gridlens.llm import quality, queries
from tests.llm.test_duplicates import roots
from tests.llm.test_texts import base_spans


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    prose = lambda rng, n: " ".join(rng.choice(vocabulary) for _ in range(n))
    plain = [prose(rng, 200) for _ in range(30)]
    shared = prose(rng, 60)
    near = plain[3].split()
    near[50] = "other"
    rows = [(i, t) for i, t in enumerate(plain)] + [(100, plain[0]), (101, " ".join(near)), (102, f"{prose(rng, 150)} {shared} {prose(rng, 20)}"), (103, f"{prose(rng, 100)} {shared}")]
    rows += [(200, "short"), (201, "ab cd " * 300), (202, None), (300, f"{prose(rng, 80)} mail me@host.org card 4111111111111111 {prose(rng, 40)}")]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(201, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="module")
def stages(spark, corpus, tmp_path_factory):
    """Each stage's name, input and output as lists of rows."""
    top, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{corpus}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, corpus).write.parquet(f"{top}/{name}")
        after = spark.read.parquet(f"{top}/{name}")
        out.append((name, docs.collect(), after.collect(), docs.columns == after.columns))
        docs = after
    return {name: rest for name, *rest in out}


def test_columns_stay(stages):
    assert [same for _, _, same in stages.values()] == [True] * 4 + [False]


def test_quality(stages):
    before, after, _ = stages["quality_rules"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} >= {200, 201, 202}
    assert {r.doc_id for r in after} >= set(range(1, 30)) and {r.doc_id: r.text for r in after}.items() <= {r.doc_id: r.text for r in before}.items()


def test_quality_stage_judges_by_all_trusted_documents(spark, tmp_path):
    rng = random.Random(4)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(4)) for _ in range(500)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randint(15, 40)))) for i in range(1800)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1800)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    judged = sorted((r.score, r.doc_id) for r in quality.quality_rules(docs, labels).collect() if not r.base_failed)
    after = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert 1000 < len(judged) < 1800 and sorted(r.doc_id for r in after.collect()) == sorted(i for _, i in judged[1:])  # rank 2 at MISSED


def test_near_duplicates(stages):
    before, after, _ = stages["simhash_near_dedup"]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (r.text.lower().split() for r in before)]
    close = [(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = roots(len(before), close)
    least = {}
    for r, k in zip(before, root):
        least[k] = min(r.doc_id, least.get(k, r.doc_id))
    assert sorted(r.doc_id for r in after) == sorted(least.values()) and not {100, 101} & {r.doc_id for r in after}


def test_repeated_passages(stages):
    before, after, _ = stages["suffix_array_dedup"]
    first, text = {}, {r.doc_id: r for r in after}
    for r in before:
        data = r.text.encode()
        for p in range(len(data) - 49):
            first[data[p : p + 50]] = min(r.doc_id, first.get(data[p : p + 50], r.doc_id))
    for r in before:
        data = r.text.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 49):
            if first[data[p : p + 50]] < r.doc_id:
                gone[p : p + 50] = b"\1" * 50
        left = bytes(c for c, g in zip(data, gone) if not g).decode("utf-8", "ignore")
        assert text[r.doc_id].text == left and text[r.doc_id].n_chars == len(left)
    assert len(text[103].text) < 1000 and any(r.text != text[r.doc_id].text for r in before)


def test_personal_data(stages):
    before, after, _ = stages["personal_data"]
    text = {r.doc_id: r.text for r in after}
    for r in before:
        want = r.text
        for kind, s, e in sorted(base_spans(r.text), key=lambda x: -x[1]):
            want = f"{want[:s]}<{kind}>{want[e:]}"
        assert text[r.doc_id] == want
    assert "<email>" in text[300] and "<card>" in text[300]


def test_packing(stages):
    before, after, _ = stages["best_fit_packing"]
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: [*whole.encode(r.text, add_special_tokens=False).ids, 2] for r in before}
    room = {}
    for r in after:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        room[r.sequence_id] = room.get(r.sequence_id, 0) + r.length
    assert sum(r.length for r in after) == sum(map(len, ids.values())) and max(room.values()) <= 1024
    assert len(room) <= max(-(-sum(room.values()) // 1024), sum(r.length > 512 for r in after)) + 1


def test_run(spark, corpus, stages):
    out = corpus_pipeline.run(spark, corpus)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, out.collect())) == sorted(map(key, stages["best_fit_packing"][1]))


def test_every_operator_has_a_query():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()} == set(range(1, 11)) and set(queries.oracle_sql()) <= set(queries.queries())
