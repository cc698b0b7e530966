import hashlib

from tests.llm.helpers import AWKWARD, pages
from twinlens.llm.licenses import known_licenses, page_licenses, scan_licenses

EMPTY = hashlib.sha256(b"").hexdigest()


def test_spelling_case_marks_and_copyright_lines_do_not_matter(spark):
    rows = [
        ("/mit", "Copyright (c) 2020 Somebody\n\n  RELEASED under the MIT licence!!\nAll rights reserved."), ("/gpl", "this WORK is licenced under the\nGNU General Public License, version 3"),
        ("/more", "Released under the MIT License. And more"), ("/line", "Intro\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.\nLicensed under CC BY NC 4 0"),
    ]
    got = {r["path"]: (r["license_id"], r["block_licenses"]) for r in page_licenses(pages(spark, rows), known_licenses(spark)).collect()}
    assert got == {"/mit": ("MIT", "MIT"), "/gpl": ("GPL-3.0", ""), "/more": (None, ""), "/line": (None, "CC-BY-NC-4.0,MIT")}


def test_awkward_rows_and_licences(spark):
    known = spark.createDataFrame([("B", "One, two"), ("A", "one two"), (None, "word"), ("E", ""), ("N", None)], "license_id string, text string")
    got = scan_licenses(pages(spark, AWKWARD), known).collect()
    assert len(got) == len(AWKWARD)
    assert all(r["digest"] == EMPTY and r["license_id"] is None for r in got if r["path"] in ("/a", "/b", "/c"))
    assert [r["license_id"] for r in got if r["path"] == "/d"] == ["A", "A"]


def test_empty_tables_and_native_plan(spark, capsys):
    none = spark.createDataFrame([], "license_id string, text string")
    assert page_licenses(pages(spark, []), known_licenses(spark)).collect() == []
    out = page_licenses(pages(spark, [("/a", "x")]), none)
    assert out.collect()[0]["license_id"] is None
    out.explain()
    assert "Python" not in capsys.readouterr().out.replace("PythonUDF registered", "")
