"""Sections beside all the sections of a version, which the registered query only shows for every other one."""

from pyspark.sql import functions as F

from scriptorium.operators import catalog, report
from scriptorium.queries import P, sections_of


def test_every_section_meets_its_own_of_the_version(spark, small):
    s = sections_of(spark, small)
    raw, clean, outline = report.render_sections(s, P, "raw"), report.render_sections(s, P, "clean"), report.render(s, P, "outline")
    own = {(r.doc_id, r.chunk_id): r.html for r in clean.collect()}
    found = catalog.compare(raw, clean, outline).collect()
    assert {(r.doc_id, r.chunk_id): r.version_html for r in found} == own and len(found) == len(own)
    whole = {r.doc_id: r.html for r in outline.collect()}
    none = catalog.compare(raw, clean.where(F.lit(False)), outline).collect()
    assert len(none) == len(own) and all(r.version_html == whole[r.doc_id] for r in none)
