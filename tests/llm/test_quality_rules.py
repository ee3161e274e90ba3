"""Quality rules: counts against plain Python, sketches under merging, thresholds and odd texts."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from partsight.llm import quality_rules as qr

DOCS = "doc_id long, text string, lang string, source string, kept string, n_words long, fences string"


def words(seed, n, lo=2, hi=9):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeimnorstu") for _ in range(r.randint(lo, hi))) for _ in range(n))


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 5, "y") for r in rows], DOCS).repartition(parts)


def brute(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows: dict = {}
    for i in range(len(found) - 7):
        windows.setdefault(tuple(found[i : i + 8]), []).append(i)
    again = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(found), sum(map(len, found)), symbols, len(lines) - len(set(lines)), len(again), len(lines)


TEXTS = [
    None, "", " \n\t", "a", words(1, 7), words(2, 8), words(2, 8) + " " + words(2, 8), words(3, 9) + "\n" + words(3, 9) + "\n x\n x\n",
    "é" * 9 + " ü ö x " + "日本 " * 30, "# $ <b> & | * %" * 9, "\n" * 3000, ("la " * 500), words(4, 40000), "x" * 300000,
    "\x1c a\x1d b \x85 c", "a\r\nb\r\na\r\n", words(5, 60) + " " + words(5, 20) + " z " + words(5, 60),
]


def test_counts_equal_plain_python(spark, monkeypatch):
    docs = frame(spark, [(i, t, "en", "s") for i, t in enumerate(TEXTS)])
    got = {r["doc_id"]: tuple(r)[1:] for r in qr.measures(docs, ("doc_id",)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}
    monkeypatch.setattr(qr, "_PART_BYTES", 50)
    numbers = qr._Numbers()
    assert len(qr._words(words(6, 400).encode(), numbers)) == 400 and set(numbers) == set(words(6, 400).encode().split())


def test_buckets_keep_order_and_are_narrow(spark):
    values = [*range(3000), *(3**i for i in range(1, 38))]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", qr.bucket("v").alias("b")).select("v", "b", qr.least_of(F.col("b")).alias("low"))
    found = sorted(tuple(r) for r in rows.collect())
    assert all(a[1] <= b[1] for a, b in zip(found, found[1:]))
    assert all(low <= v and (v - low) * qr.SUB <= v for v, _, low in found)


def plain_quartiles(values):
    def low(v):
        e = max(v.bit_length() - 6, 0)
        return (v >> e) << e

    values = sorted(values)
    return low(values[-(-len(values) // 4) - 1]), low(values[-(-3 * len(values) // 4) - 1])


def test_quartiles_of_any_split_are_the_same(spark):
    r = random.Random(2)
    rows = [(m, g, int(r.paretovariate(1) * 40)) for m in ("one", "two") for g in ("a", "b") for _ in range(r.randint(1, 700))]
    docs = spark.createDataFrame(rows, "measure string, lang string, value long")
    sketch = docs.repartition(7).select("lang", "measure", qr.bucket("value").cast("int").alias("bucket")).groupBy("lang", "measure", "bucket").count()
    found = qr.quartiles(sketch.withColumnRenamed("count", "n"), ("lang",)).collect()
    assert len(found) == 4
    for x in found:
        assert (x["q1"], x["q3"]) == plain_quartiles([v for m, g, v in rows if (m, g) == (x["measure"], x["lang"])])


@pytest.fixture(scope="module")
def judged(spark):
    """A source of marked-up texts, one of plain ones, a small one, and the same odd text in each."""
    odd = words(7, 60) + " ##" * 6
    rows = [(i, words(i, 80) + " #" * (i % 9), "en", "markup") for i in range(300)]
    rows += [(i, words(i, 80), "en", "plain") for i in range(300, 700)]
    rows += [(700, odd, "en", "markup"), (701, odd, "en", "plain"), (702, odd, "en", "small"), (703, words(703, 60), "en", "small")]
    rows += [(704, odd, None, None), (705, words(705, 90), None, ""), (706, words(9, 19), "en", "plain"), (707, "ha " * 90, "en", "plain")]
    rows += [(708, words(10, 60, 30, 40), "en", "plain"), (709, words(11, 60, 1, 1), "en", "plain"), (None, words(12, 70), "en", "plain")]
    return {r["doc_id"]: r for r in qr.judge(frame(spark, rows)).collect()}


def test_each_source_sets_its_own_fences(judged):
    assert all(judged[i]["kept"] for i in range(700))
    assert judged[700]["kept"] and not judged[701]["kept"] and judged[701]["failed"] == ["symbol_rate"]
    # 'small' and the null language have too few documents: their language, then all, decide.
    assert judged[703]["kept"] and judged[705]["kept"] and judged[None]["kept"]
    assert [judged[i]["base_failed"] for i in (706, 707)] == [True, True] and not judged[706]["kept"] and judged[706]["failed"] == []
    assert judged[708]["failed"] == ["word_length"] == judged[709]["failed"]


def test_thresholds_fall_back_to_merged_sketches(spark, judged):
    rows = [(i, i, 25, 100 + i, 0, 0, 0, 5, "en" if i < 150 else "de", "a" if i % 2 else "b") for i in range(250)]
    names = "doc_id long, k long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, lang string, source string"
    found = {(r["lang"], r["source"]): r["fences"] for r in qr.thresholds(spark.createDataFrame(rows, names)).collect()}
    assert len(found) == 4 and {f["docs"] for f in found.values()} == {250}  # none has 200 of its own, nor has a language


def test_nothing_and_only_bad_documents(spark):
    assert qr.judge(frame(spark, [])).count() == 0
    rows = qr.judge(frame(spark, [(1, None, None, None), (1, None, None, None), (2, "", "en", "s")])).collect()
    assert len(rows) == 3 and not any(r["kept"] for r in rows) and all(r["base_failed"] for r in rows)
