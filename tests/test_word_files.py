"""Word files written by tasks and read by the data source, with defective ones among them."""

import io
import zipfile

from pyspark.sql import functions as F

from scriptorium.sources.text import docx_content
from scriptorium.sources.word_files import paragraphs_of, read_word_files, write_word_files


def test_files_are_read_as_they_were_written(spark, tmp_path):
    path = f"{tmp_path}/files"
    texts = [(i % 7, i, t) for i, t in enumerate(["a", "", None, "x & <y> “z”", "tab\there", "two\nlines", "漢字😀", " blank "] * 20)]
    lines = spark.createDataFrame(texts, "file int, no int, text string").repartition(5)
    assert {r.file: r.paragraphs for r in write_word_files(lines, path, "file", "no").collect()} == {k: sum(f == k for f, *_ in texts) for k in range(7)}
    for task_bytes in (1, 1 << 20):
        found = read_word_files(spark, path, task_bytes)
        assert found.rdd.getNumPartitions() == (7 if task_bytes == 1 else 1)
        got = {}
        for r in found.orderBy("path", "line_no").collect():
            assert r.error is None
            got.setdefault(int(r.path.rsplit("/", 1)[-1][:-5]), []).append(r.text)
        assert got == {k: [(t or "").replace("\n", " ") for f, _, t in texts if f == k] for k in range(7)}


def test_defective_files_have_a_row_each(spark, tmp_path):
    good = docx_content("one\ntwo")
    cut = io.BytesIO()
    with zipfile.ZipFile(cut, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>first</w:t></w:r></w:p><w:p>')
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        z.writestr("something.xml", "<a/>")
    for name, data in (("good", good), ("empty", b""), ("junk", b"not a file" * 100), ("short", good[:-30]), ("cut", cut.getvalue()), ("other", other.getvalue())):
        (tmp_path / f"{name}.docx").write_bytes(data)
    (tmp_path / "ignored.txt").write_text("x")
    found = {}
    for r in read_word_files(spark, str(tmp_path)).orderBy("path", F.col("line_no").asc_nulls_last()).collect():
        found.setdefault(r.path.rsplit("/", 1)[-1][:-5], []).append(r.text if r.error is None else "error")
    assert found == {"good": ["one", "two"], "empty": ["error"], "junk": ["error"], "short": ["error"], "cut": ["first", "error"], "other": ["error"]}


def test_a_long_file_is_read_in_little_memory():
    data = docx_content("\n".join(f"paragraph {i}" for i in range(100_000)))
    assert sum(1 for _ in paragraphs_of(io.BytesIO(data))) == 100_000


def test_a_folder_without_files(spark, tmp_path):
    assert read_word_files(spark, str(tmp_path)).count() == 0
