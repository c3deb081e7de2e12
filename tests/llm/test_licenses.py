"""Licenses are told from their siblings, in their usual phrasings."""

import pytest

from marketspark.llm import license_scan as scan


def notice(name, version):
    return scan._gnu("program", name, version)


CASES = [
    ("licensed under the GNU General Public License, version 2", {"GPL-2.0"}),
    ("licensed under the GNU General Public License, version 3", {"GPL-3.0"}),
    (notice("General Public License", "2"), {"GPL-2.0-notice"}),
    (notice("General Public License", "3"), {"GPL-3.0-notice"}),
    (notice("Lesser General Public License", "3") + " You should have received a copy of the GNU General Public License along with it.", {"LGPL-3.0-notice"}),
    (notice("Lesser General Public License", "2.1").replace("program", "library"), {"LGPL-2.1-notice"}),
    (notice("Affero General Public License", "3"), {"AGPL-3.0-notice"}),
    (f"{scan._BSD}: {scan._BSD_2} THIS SOFTWARE IS PROVIDED AS IS", {"BSD-notice", "BSD-2-Clause-notice"}),
    (f"{scan._BSD}: {scan._BSD_2} 3. {scan._BSD_3}. THIS SOFTWARE IS PROVIDED AS IS", {"BSD-notice", "BSD-3-Clause-notice"}),
    ("Licensed under the MIT License", {"MIT"}),
    ("Released under the ISC License", {"ISC"}),
    ("Licensed under the Apache License, Version 1.1", set()),
]


def test_siblings_are_told_apart(spark):
    df = spark.createDataFrame([(k, f"a b c d {t} e f g h") for k, (t, _) in enumerate(CASES)], "doc_id long, text string")
    rows = scan.scan_licenses(df).collect()
    assert [{r["license"] for r in rows if r["doc_id"] == k} for k in range(len(CASES))] == [want for _, want in CASES]
    assert len({(r["doc_id"], r["license"]) for r in rows}) == len(rows)


def test_telling_words_must_be_in_the_template():
    with pytest.raises(ValueError):
        scan._telling("licensed under the MIT License", ("isc",))
