import pytest

from sitecast.llm import licences
from sitecast.llm.common import table
from tests.conftest import DATA


@pytest.fixture(scope="module")
def model(spark):
    return licences.train(table(spark, DATA, "documents"))


def found(docs, model, rows):
    got = licences.scan(docs(rows, extra=True), model).collect()
    return sorted(((r["doc_id"] or 0, r["paragraph"], r["family"], r["confirmed"]) for r in got))


def test_every_template_is_named_inside_prose(docs, model):
    flat = [(f, t) for f, texts in licences.TEMPLATES.items() for t in texts]
    rows = [(i, f"Some prose first\n{t} And more prose after it, as it goes.\nlast line") for i, (_, t) in enumerate(flat)]
    got = found(docs, model, rows)
    right = sum(g == (i, 1, f, True) for i, (f, _) in enumerate(flat) for g in got if g[0] == i)
    assert right >= 0.95 * len(flat)


def test_notices_not_trained_on(docs, model):
    rows = [
        (1, "the code was Released under the MIT License"),
        (2, "Licensed under the Apache License, Version 2.0, see the file"),
        (3, "This work is licensed under the GNU General Public License, version 3"),
        (4, "Licensed under the Frobnicate Proprietary Software License, all rights reserved."),
        (5, "The cat sat on the mat and renewed nothing at all."),
        (6, "Her driving license was lost by the general public library."),
    ]
    got = found(docs, model, rows)
    assert [(g[0], g[2]) for g in got if g[3]] == [(1, "MIT"), (2, "Apache-2.0"), (3, "GPL-3.0")]
    assert not [g for g in got if g[0] in (5, 6) and g[2] != licences.UNKNOWN]
    assert not [g for g in got if g[0] == 4 and g[2] != licences.UNKNOWN]


def test_lines_of_the_tables(spark, model):
    docs = table(spark, DATA, "documents")
    want = {
        (r["doc_id"], i)
        for r in docs.select("doc_id", "text").collect()
        for i, line in enumerate((r["text"] or "").split("\n"))
        if "icense" in line
    }
    got = {(r["doc_id"], r["paragraph"]) for r in licences.scan(docs, model).collect() if r["confirmed"]}
    assert got == want


def test_edges(docs, model):
    notice = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "MIT"), (5, notice), (5, notice), (None, notice)]
    assert found(docs, model, rows) == [(0, 0, "MIT", True), (5, 0, "MIT", True), (5, 0, "MIT", True)]
    assert found(docs, model, []) == []
