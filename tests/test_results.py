"""Results written and read again, siblings and drawers of unknown ids, drawer levels."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import catalog, report
from scriptorium.operators import sections as S
from scriptorium.plans.rules import LATIN
from scriptorium.sources import text
from scriptorium.sources.text import from_json, read_docx, read_results, registry, to_docx, to_json, write_json


@pytest.fixture(scope="module")
def docs(spark):
    lines = [f"{k}. This is sentence {k} of a text that has “signs” & <marks>; it goes on with words from a list." for k in range(120)]
    return spark.createDataFrame([("a", "\n".join(lines)), ("b", ""), ("c", None)], "doc_id string, text string")


def test_samples_are_read_as_they_were_written(spark, docs, tmp_path):
    about = registry(spark, [("a", "One", "first", "/x/y/one.docx", 3600)]).withColumnRenamed("sample_id", "doc_id")
    made = report.samples(docs, LATIN, about)
    write_json(made, str(tmp_path / "out"))
    again = {r.doc_id: r for r in read_results(spark, str(tmp_path / "out"), made.schema).collect()}
    rows = {r.doc_id: r for r in made.collect()}
    assert again == rows and set(rows) == {"a", "b", "c"}
    assert (rows["a"].title, rows["a"].source_file) == ("One", "one.docx") and rows["b"].title is None
    assert rows["a"].stats.chunks == len(rows["a"].chunks) > 1 and "“signs” &amp; &lt;marks&gt;" in rows["a"].versions["clean"]
    assert rows["b"].chunks == [] and rows["b"].versions["study"] == "" and list(rows["c"].review_items) == list(LATIN.flags)
    as_text = from_json(to_json(report.stats(docs, LATIN)), "doc_id string, chunks int")
    assert {r.doc_id: r.chunks for r in as_text.collect()} == {k: v.stats.chunks for k, v in rows.items()}


def test_drawer_levels(spark):
    own = spark.createDataFrame([("l1", 0, "own")], "lesson_id string, ord long, title string")
    every = spark.createDataFrame([(0, "every"), (1, "every")], "ord long, title string")
    words = spark.createDataFrame([(0, "word"), (1, "word"), (2, "word")], "ord long, title string")
    asked = spark.createDataFrame([("l1", i) for i in range(4)] + [("l2", 0)], "lesson_id string, ord long")
    found = {(r.lesson_id, r.ord): (r.level, r.title) for r in catalog.drawer(asked, own, every, words, ["title"]).collect()}
    assert found == {("l1", 0): (0, "own"), ("l1", 1): (1, "every"), ("l1", 2): (2, "word"), ("l2", 0): (1, "every")}


def test_a_version_without_such_sections_is_shown_whole(spark, docs):
    s = S.sections(docs, LATIN)
    out = catalog.compare(report.render_sections(s, LATIN, "raw"), report.render_sections(s, LATIN, "clean").where("chunk_no = 1"), report.render(s, LATIN, "outline"))
    for r in out.collect():
        assert ('class="outline-list"' in r.version_html) == (r.chunk_id != "c01")


def test_tables_of_a_catalogue(spark, tmp_path):
    (tmp_path / "words.json").write_text('{"ord": 0, "title": "凝练", "points": ["a", "b"]}\n', encoding="utf-8")
    (row,) = catalog.read_table(spark, str(tmp_path / "words.json"), "words").collect()
    assert (row.title, row.points, row.summary) == ("凝练", ["a", "b"], None)
    assert catalog.courses(spark).count() == 4
    assert catalog.listed(catalog.courses(spark)).where(F.col("review") == "无").count() == 1


def test_word_files_are_read_as_they_were_written(spark, docs, tmp_path):
    odd = docs.unionByName(spark.createDataFrame([("d", "a\tb\r\n\n <x> & \x07 “y”\r z")], "doc_id string, text string"))
    for r in to_docx(odd).collect():
        (tmp_path / f"{r.doc_id}.docx").write_bytes(r.content)
    found = {r.doc_id.rsplit("/", 1)[-1][0]: r.text for r in read_docx(spark, str(tmp_path)).collect()}
    want = {r.doc_id: (r.text or "").replace("\x07", " ") for r in odd.collect()}
    assert found == want


def test_word_files_are_made_a_few_at_a_time(spark):
    """Rows of one batch (a limit makes one partition) come back in order of the pieces they were taken in."""
    sizes = [b.num_rows for b in text._few(iter([pa.RecordBatch.from_pydict({"k": list(range(text.FILES * 2 + 3))}), pa.RecordBatch.from_pydict({"k": []})]))]
    assert sizes == [text.FILES, text.FILES, 3]
    rows = spark.range(700).coalesce(1).select(F.col("id").alias("doc_id"), F.format_string("t%d\nx", "id").alias("text"))
    assert {r.doc_id: r.text for r in text.docx_texts(to_docx(rows), "doc_id").collect()} == {i: f"t{i}\nx" for i in range(700)}
