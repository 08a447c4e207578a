"""Creative Commons notices, whose templates contain each other but for a word."""

from crawlvis.llm import licenses

NOTICE = "Licensed under a Creative Commons Attribution{} 4.0 International License"


def test_each_notice_has_its_own_label(spark):
    rows = [(1, NOTICE.format("")), (2, NOTICE.format("-NonCommercial")), (3, NOTICE.format("-ShareAlike")), (4, "This work is l" + NOTICE.format("")[1:] + "."), (5, "Licensed under the Apache License, Version 2.0"), (6, NOTICE.format("") + "\n" + "word " * 40 + "\n" + NOTICE.format("-ShareAlike"))]
    got = {x["doc_id"]: (x["labels"], x["score"]) for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("cc-by", 1.0), 2: ("cc-by-nc", 1.0), 3: ("cc-by-sa", 1.0), 4: ("cc-by", 1.0), 5: ("apache-2", 1.0), 6: ("cc-by,cc-by-sa", 1.0)}
