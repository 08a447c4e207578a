"""License notices that wrap over line breaks."""

from crawlvis.llm import licenses

WRAPPED = (
    ("This work is licensed under the GNU General Public\nLicense, version 3.", "gpl-3"),
    ("Licensed under the\nGNU Lesser\nGeneral Public\nLicense", "lgpl"),
    ("All rights\nreserved", "all-rights-reserved"),
    ("Subject to the terms\nof the Mozilla Public\r\nLicense, v. 2.0", "mpl-2"),
    ("Licensed under the GNU General Public License version 2", "gpl-2"),
    ("All\n" + "word " * 60 + "\nrights reserved", ""),
    ("", ""),
    (None, ""),
)


def test_wrapped_notices_are_found_wherever_they_stand(spark):
    rows = [(f"{i}-{n}", ("x " * n + t if n else t) if t else t) for i, (t, _) in enumerate(WRAPPED) for n in (0, 1, 7, 10, 11, 12, 23, 100)]
    got = {x["doc_id"]: x["labels"] for x in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {i: WRAPPED[int(i.split("-")[0])][1] for i, _ in rows}
