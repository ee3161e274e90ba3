"""Token alignment against the two tokenizers on whole texts, with any blocks, and the bitmaps by themselves."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from partsight.llm import alignment, queries

A, B = queries.BYTE_TOKENIZER, queries.PIECE_MODEL
ODD = [
    None, "", " ", "  ", "a", "\n", "a ", "a  ", " a", "<|endoftext|> x", "<s> y </s>", "▁a", "a▁b", "<0x41>", "é" * 50, "日本語 テスト",
    "😀 😀x", "  x", "x  y", "x\x1c y", "ﬁ fi", "á á", "\x00b c", "don't  stop\t\tnow \r\n ok", "a" * 3000, " " * 3000 + "x", "x \n y",
    "word " * 4000, "café " * 50, "same text here", "same text here",
]


def brute(texts):
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters, names = alignment._byte_letters(), {i: t for t, i in a.get_vocab().items()}
    held, counts = [], collections.Counter()
    for text in texts:
        a_ids = a.encode(" " + text, add_special_tokens=False).ids if text else []
        b_ids = b.encode(text) if text else []
        a_raw = [bytes(letters[c] for c in names[i]) for i in a_ids]
        b_raw = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
        if not text or b"".join(a_raw) != (" " + text).encode() or b"".join(b_raw) != (" " + text).encode():
            held.append(None)
            continue
        a_end, b_end = (np.cumsum([len(x) for x in raw]).tolist() for raw in (a_raw, b_raw))
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(a_end) & set(b_end)):
            i2, j2 = a_end.index(end, i) + 1, b_end.index(end, j) + 1
            groups.append(",".join(map(str, a_ids[i:i2])) + "|" + ",".join(map(str, b_ids[j:j2])))
            for x in range(i, i2):
                for y in range(j, j2):
                    if a_end[x] - len(a_raw[x]) < b_end[y] and b_end[y] - len(b_raw[y]) < a_end[x]:
                        links.append((a_ids[x], b_ids[y]))
            i, j = i2, j2
        counts.update(links)
        held.append((len(a_ids), len(b_ids), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most: dict[int, int] = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for found in held:
        if found is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, digest = found
        out.append((n_a, n_b, n_groups, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest))
    docs = collections.Counter(x for f in held if f for x in set(f[3]))
    return out, {x: (docs[x], n, n == most[x[1]]) for x, n in counts.items()}


@pytest.mark.parametrize("block, part", [(4 << 20, 1 << 20), (3000, 700)])
def test_alignment_equals_whole_texts(spark, monkeypatch, block, part):
    given = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = ODD + given
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, block string, pair int, key int").repartition(3)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(alignment, "PART_BYTES", part)
    aligner = alignment.Aligner(A, B)
    long = " ".join(t for t in texts if t)
    assert " ".join(c for chunks in aligner.chunks(long) for c in chunks) == long
    indexed = alignment.index(docs, A, B)
    pairs = alignment.pair_counts(indexed)
    want, counts = brute(texts)
    assert {r["doc_id"]: tuple(r)[1:] for r in alignment.scores(indexed, pairs).collect()} == dict(enumerate(want))
    assert {(r["a"], r["b"]): (r["n_docs"], r["n_links"], r["best"]) for r in pairs.collect()} == counts


def test_planes_keep_their_members():
    r = random.Random(1)
    sets = [sorted(r.sample(range(1000), n)) for n in (0, 1, 3, 62, 63, 500, 1000)]
    planes = alignment.packed_planes(np.array(sum(sets, [])), np.cumsum([len(s) for s in sets]), 1000)
    assert [alignment.plane_members(p).tolist() for p in planes] == sets
    assert max(map(len, planes)) <= 126


def test_alignment_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(docs, A, B).count() == 0
    rows = alignment.align(spark.createDataFrame([(None, None), (None, "")], "doc_id long, text string"), A, B).collect()
    assert [tuple(r) for r in rows] == [(None, 0, 0, 0, 0, 0, 0, "")] * 2
