"""The registered queries and the pipeline over a small folder of tables, against brute force."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from compval.llm import quality, queries, secret_scan, simhash
from compval.llm.common import written
from tests.llm.test_operators import brute_components, brute_fingerprint, brute_marks, check_packing

WORDS = ["the", "thing", "is", "of", "and", "on", "are", "sting", "ction", "für", "que", "wh"]


def corpus(seed=11):
    rnd = random.Random(seed)
    sentence = lambda k: " ".join(rnd.choices(WORDS, k=k)).capitalize() + "."
    passage = sentence(60)
    texts = [sentence(rnd.choice([30, 80, 200])) for _ in range(120)]
    texts += [f"{t} {passage} {sentence(20)}" for t in texts[:25]]
    texts += texts[30:40] + [t + " end" for t in texts[110:118]]  # copies and near copies
    texts += [f"{sentence(30)} token = \"{rnd.getrandbits(160):040x}\" {sentence(9)}" for _ in range(12)]
    junk = [" ".join(w.upper() + "!!" for w in rnd.choices(WORDS, k=60)) for _ in range(40)]
    texts = [*texts, *junk, None, ""]
    ids = list(range(1000, 1000 + len(texts)))
    rnd.shuffle(ids)
    bad = set(range(len(texts) - 42, len(texts) - 2))
    labels = [(ids[i], int(i not in bad), 0) for i in range(0, len(texts) - 2, 2)]
    return dict(zip(ids, texts)), labels, {ids[i] for i in bad}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    docs, labels, junk = corpus()
    rows = [(d, t, "en", f"src{d % 4}", len(t or "")) for d, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    rnd = random.Random(1)
    vectors = [(i, [rnd.uniform(-1, 1) for _ in range(8)]) for i in range(250)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{root}/embeddings.parquet")
    turns = [(c, t, rnd.choice(["user", "assistant"]), rnd.choice(["hi", "### x", None])) for c in range(9) for t in range(4)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{root}/conversations.parquet")
    return str(root), docs, junk


def test_every_query_covers_its_whole_table(spark, folder):
    root, docs, _ = folder
    for name, query in queries.QUERIES.items():
        rows = query(spark, root).collect()
        if name == "op1_topk_search":
            assert len(rows) == 3 * 10
        elif name == "op9_chat":
            assert {r["conv_id"] for r in rows} == {-7, *range(9)}
        else:
            assert {r["doc_id"] for r in rows} == set(docs), name


def test_quality_query(spark, folder):
    root, docs, junk = folder
    keep = {r["doc_id"]: r["keep"] for r in queries.op5_quality(spark, root).collect()}
    assert not any(keep[d] for d in junk)
    assert all(keep[d] for d, t in docs.items() if t and d not in junk)


def test_stages_against_brute_force(spark, folder):
    root, docs, junk = folder
    frame = spark.read.parquet(f"{root}/documents.parquet")
    texts = {d: t or "" for d, t in docs.items()}
    stages = dict(corpus_pipeline.STAGES)
    get = lambda df: {r["doc_id"]: r["text"] or "" for r in df.collect()}

    kept = {r["doc_id"] for r in quality.quality(frame, spark.read.parquet(f"{root}/labels.parquet")).where("keep").collect()}
    frame = written(stages["quality"](spark, frame, root), "t1")
    assert get(frame) == (texts := {d: texts[d] for d in kept}) and not kept & junk

    frame = written(stages["near_dedup"](spark, frame, root), "t2")
    second = {d: simhash._majority(simhash._other_bits(simhash.shingle_hashes(t))) for d, t in texts.items()}
    root_of = brute_components({d: brute_fingerprint(t) for d, t in texts.items()}, corpus_pipeline.RADIUS, second, corpus_pipeline.CHECK)
    texts = {d: t for d, t in texts.items() if root_of[d] == d}
    assert get(frame) == texts

    frame = written(stages["substring_dedup"](spark, frame, root), "t3")
    want = {}
    for d, mark in brute_marks({d: t.encode() for d, t in texts.items()}).items():
        raw = texts[d].encode()
        inner = mark.copy()
        for i in range(len(raw)):  # a character stays whole if any of its bytes stays
            if raw[i] & 0xC0 != 0x80:
                j = i + 1
                while j < len(raw) and raw[j] & 0xC0 == 0x80:
                    j += 1
                inner[i:j] = mark[i:j].all()
        text = bytes(np.frombuffer(raw, np.uint8)[~inner]).decode()
        if text or not raw:
            want[d] = text
    assert get(frame) == want
    assert {r["doc_id"]: r["n_chars"] or 0 for r in frame.collect()} == {d: len(t) for d, t in want.items()}

    spans = {r["doc_id"]: r["spans"] for r in secret_scan.secret_spans(frame).collect()}
    frame = written(stages["secrets"](spark, frame, root), "t4")
    texts = {d: secret_scan.redact(t, spans[d]) for d, t in want.items()}
    assert get(frame) == texts and sum("<SECRET>" in t for t in texts.values()) == 12
    assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    rows = stages["packing"](spark, frame, root).collect()
    check_packing(rows, texts, 2048)
    assert {r["doc_id"] for r in rows} == set(texts)
    digest = lambda rs: hashlib.sha256(repr(sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rs)).encode()).hexdigest()
    assert digest(corpus_pipeline.run(spark, root).collect()) == digest(rows)


CLASH = "doc_id long, text string, lang string, source string, n_chars long, _key string, _was int, _MARKS int, _spans string, first int, size int"


def test_pipeline_of_null_ids_clashing_columns_and_an_empty_table(spark, tmp_path):
    rnd = random.Random(2)
    say = lambda k: " ".join(f"{rnd.getrandbits(40):x}" for _ in range(k))
    secret = f'token = "Zq{rnd.getrandbits(120):x}"'
    texts = [say(30), f"{say(20)} {secret} {say(9)}", say(25), "", None, "x"]
    texts += [texts[0]]
    rows = [(None, t, "en", "s", None, "k", 1, 2, "p", 3, 4) for t in texts] + [(7, say(40), None, None, 1, None, None, None, None, None, None)]
    for name, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, CLASH).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for stage, change in corpus_pipeline.STAGES[:-1]:
            docs = written(change(spark, docs, f"{tmp_path}/{name}"), stage)
            assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in spark.read.parquet(f"{tmp_path}/{name}/documents.parquet").schema]
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        if not data:
            assert docs.count() == len(out) == 0
            continue
        left = [r["text"] for r in docs.collect()]
        assert sorted(t[:20] for t in left if t and t != "x") == sorted(t[:20] for t in {*texts[:3], rows[-1][1]})
        assert not any(secret in (t or "") for t in left) and sum("<SECRET>" in (t or "") for t in left) == 1
        assert sum(r["_key"] == "k" for r in docs.collect()) == len(left) - 1
        assert len(out) == len(left) and sum(r["doc_id"] is None for r in out) == len(out) - 1
