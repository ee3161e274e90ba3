"""The stages of the corpus pipeline on a small corpus of known cases."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pytest
from tokenizers import Tokenizer


_R = random.Random(1)
VOCABULARY = ["".join(_R.choice("abcdeimnorstu") for _ in range(_R.randint(2, 9))) for _ in range(300)]


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def junk(seed: int, n: int) -> str:
    return " ".join(w.upper() + "!!" for w in words(seed, n).split())


PASSAGE = words(900, 90)
#: A passage of a little over 50 words.
SHORT = words(901, 52)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    texts = {i: words(i, 150) for i in range(40)} | {i: junk(i, 150) for i in range(40, 60)}
    texts |= {60: texts[5], 61: texts[6] + " tail", 62: words(62, 80) + " " + PASSAGE + " " + words(63, 80)}
    texts |= {63: PASSAGE + " " + words(64, 120), 64: words(65, 90) + ' token = "abcdef0123456789" ' + words(66, 20), 65: None, 66: ""}
    texts |= {67: words(67, 90) + " " + SHORT + " " + words(68, 70), 68: words(69, 100) + " " + SHORT + " " + words(70, 60)}
    rows = [(i, t, "en", "s", None if t is None else len(t), "more") for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string").write.parquet(
        f"{folder}/documents.parquet"
    )
    labels = [(i, 1, 0) for i in range(30)] + [(i, 0, 0) for i in range(40, 50)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, texts


def test_stages_take_effect(spark, corpus):
    folder, texts = corpus
    frame, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        frame = corpus_pipeline.stored(stage(spark, frame, folder), name)
        seen[name] = frame
        if name != "packing":
            assert frame.columns == list(corpus_pipeline.COLUMNS)
    rows = {name: {r["doc_id"]: r for r in df.collect()} for name, df in seen.items() if name != "packing"}
    assert set(range(40)) <= set(rows["quality"]) and not set(range(40, 60)) & set(rows["quality"])
    kept = set(rows["near_duplicates"])
    assert set(range(40)) <= kept and not {60, 61} & kept and {62, 63, 64, 65, 66} <= kept
    cut = rows["repeats"]
    assert PASSAGE not in cut[62]["text"] + cut[63]["text"] and cut[62]["text"].startswith(words(62, 80))
    assert all(cut[i]["text"] == texts[i] for i in range(40))
    assert len(SHORT.encode()) >= corpus_pipeline.PASSAGE_BYTES and SHORT not in cut[67]["text"] + cut[68]["text"]
    assert cut[62]["n_chars"] == len(cut[62]["text"])
    assert "abcdef0123456789" not in rows["secrets"][64]["text"] and "[secret]" in rows["secrets"][64]["text"]
    assert set(rows["secrets"]) == set(cut)
    packed = seen["packing"].collect()
    tokenizer = Tokenizer.from_file(corpus_pipeline.WORD_TOKENIZER)
    want = {i: len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for i, r in rows["secrets"].items()}
    got: dict[int, int] = {}
    room: dict[int, int] = {}
    for r in packed:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        room[r["sequence_id"]] = room.get(r["sequence_id"], 0) + r["length"]
    assert got == want and max(room.values()) <= 2048
    assert np.ceil(sum(want.values()) / 2048) <= len(room)


def test_stages_of_an_empty_table(spark, corpus):
    folder, _ = corpus
    frame = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, folder)
        assert frame.count() == 0
