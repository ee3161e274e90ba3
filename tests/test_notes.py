"""Files on disk, value types, and that no value reaches a report."""

from __future__ import annotations

from pyspark.sql import functions as F

from partsight.functions import values as V
from partsight.operators import profile as pf
from partsight.sources import notes as nt
from partsight.sources import pages as pg

NOTE = """---
sku: CANARY-123456
tags: [a, b]
nested:
  one: 1
text: |
  line
empty:
---
# Title
state:: CANARY-654321
| code | photo |
|---|---|
| CANARY-123456 | ![[CANARY-123456.jpg]] |
```dataview
hidden:: x
```
"""


def test_tree_and_encodings(spark, tmp_path):
    (tmp_path / "a" / ".hidden").mkdir(parents=True)
    (tmp_path / "a" / "u8.md").write_bytes("Скидка".encode())
    (tmp_path / "a" / "bom.md").write_bytes(b"\xef\xbb\xbf" + "Скидка".encode())
    (tmp_path / "a" / "u16.md").write_bytes("Скидка".encode("utf-16"))
    (tmp_path / "cp.md").write_bytes("Скидка №1".encode("cp1251"))
    (tmp_path / "a" / "bad16.md").write_bytes(b"\xff\xfe\x00\xd8\x41")
    (tmp_path / "a" / ".hidden" / "no.md").write_bytes(b"x")
    tree = nt.scan_tree(spark, str(tmp_path))
    got = {r.name: (r.encoding, r.text) for r in nt.decode(tree).collect()}
    assert set(got) == {"u8.md", "bom.md", "u16.md", "cp.md", "bad16.md"}
    assert got["u8.md"] == ("utf-8", "Скидка")
    assert got["bom.md"] == ("utf-8-bom", "Скидка")
    assert got["u16.md"] == ("utf-16", "Скидка")
    assert got["cp.md"] == ("cp1251", "Скидка №1")


def test_cut_utf8_is_still_utf8(spark):
    df = spark.createDataFrame([(bytearray("аб".encode()),)], "content binary")
    row = nt.decode(df, max_bytes=3).first()
    assert (row.encoding, row.text, row.cut) == ("utf-8", "а", True)


def _note(spark):
    return spark.createDataFrame([(1, NOTE)], "note_id int, text string")


def test_frontmatter(spark):
    rows = nt.frontmatter_fields(nt.split_frontmatter(_note(spark)), "note_id").collect()
    got = {r["key"]: (r["kind"], r["items"]) for r in rows}
    assert got == {
        "sku": ("scalar", ["CANARY-123456"]), "tags": ("list", ["a", "b"]), "nested": ("object", ["x"]),
        "nested.one": ("scalar", ["1"]), "text": ("block", ["line"]), "empty": ("scalar", [""]),
    }


def test_reports_hold_no_values(spark):
    notes = _note(spark)
    fields = nt.frontmatter_fields(nt.split_frontmatter(notes), "note_id").withColumn("source", F.lit("fm"))
    observed = pf.observe(fields)
    body = nt.split_frontmatter(notes).withColumn("text", F.col("body"))
    reports = [
        pf.field_stats(observed), pf.type_counts(observed),
        pf.key_candidates(observed, pf.field_stats(observed)), pf.table_groups(nt.table_rows(body, "note_id")),
        pf.link_counts(pf.links(notes, nt.without_fences(F.col("text")))),
    ]
    rows = [str(v) for df in reports for r in df.collect() for v in r]
    assert rows and not any("CANARY" in v for v in rows)


def test_value_types(spark):
    cases = {
        "": "boş", "null": "boş", "да": "evet/hayır", "![[a.png]]": "görsel", "[[a]], [[b|c]]": "bağlantı",
        "[x](y.md)": "bağlantı", "https://a.b": "url", "www.a.b": "url", "2024-01-31": "tarih", "1.2.2024": "tarih",
        "15 000 ₽": "para", "A 213 885 14 00": "kod", "12345678": "kod", "123": "sayı", "слово": "metin",
        "\"'": "metin", "12.5": "sayı",
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r.v: r.t for r in df.select("v", V.value_type(F.col("v")).alias("t")).collect()} == cases


def test_shapes(spark):
    cases = {"A 213 885-14": "A ### ###-##", "Жб1": "ЯЯ#", "é!": "Ω?", "x" * 40: "A" * 32 + "…"}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r.v: r.s for r in df.select("v", V.shape(F.col("v")).alias("s")).collect()} == cases


def test_pages(spark):
    bodies = ['{"chats": [{"id": "a"}, {"created": 1}, {"id": 5, "created": "x"}, 7]}', '{"chats": null}',
              '{"other": 1}', "not json", '{"chats": []}']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "page int, body string")
    entries = pg.list_entries(df, "chats_list")
    parsed = {(r.page, r["index"]): list(r.issues) for r in pg.parse_entries(entries, "chat").collect()}
    assert parsed == {(0, 0): [], (0, 1): ["id"], (0, 2): ["created"], (0, 3): ["<root>"]}
    shape = {r.page: (r.shape_ok, r.raw_count) for r in entries.select("page", "shape_ok", "raw_count").distinct().collect()}
    assert shape == {0: (True, 4), 1: (True, 0), 2: (False, 0), 3: (False, 0), 4: (True, 0)}


def test_saved_pages_are_read(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"id": "m", "created": 1, "content": {"text": 5, "image": "no"}}]')
    entries = pg.list_entries(pg.read_pages(spark, str(tmp_path)), "messages_list")
    assert pg.parse_entries(entries, "message").first().issues == ["content.image"]


def test_error_codes(spark):
    cases = {'{"error": {"code": 400}}': "400", '{"code": "x"}': "x", '{"errors": [{"code": "e"}]}': "e",
             '{"error": "plain"}': "plain", "[]": None, '{"error": {"code": {}}}': None, "": None,
             '{"code": "' + "y" * 80 + '"}': "y" * 64}
    df = spark.createDataFrame([(k,) for k in cases], "b string")
    assert {r.b: r.c for r in df.select("b", pg.error_code(F.col("b")).alias("c")).collect()} == cases


def test_notes_of_one_partition_are_dealt_over_the_cores(spark):
    notes = spark.createDataFrame([(i, f"---\nsku: {i}\n---\nsize:: {i}\n| a |\n|---|\n| {i} |\n") for i in range(640)], "note_id long, text string").coalesce(1)
    bodies = nt.split_frontmatter(notes).withColumn("text", F.col("body"))
    for rows in (nt.table_rows(bodies, "note_id"), nt.inline_fields(notes, "note_id")):
        assert rows.select(F.spark_partition_id().alias("p")).distinct().count() >= 8
        assert rows.count() == 640
