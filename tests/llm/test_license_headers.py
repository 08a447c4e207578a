"""Header notices, license identifiers, look-alikes, and templates of any length."""

import random

from crawlvis.llm import licenses

CASES = {
    "we keep not all rights reserved for the king": "", "All rights reserved.": "all-rights-reserved", "The MIT License (MIT)": "mit", "/* SPDX-License-Identifier: GPL-2.0-only */": "gpl-2", "SPDX-License-Identifier: CC-BY-NC-SA-4.0": "cc-by-nc,cc-by-nc-sa",
    "SPDX-License-Identifier: CC-BY-4.0": "cc-by", "SPDX-License-Identifier: BSD-3-Clause": "bsd-3", "spdx license identifier lgpl 2 1 or later": "lgpl", "SPDX license identifier": "",
    "Licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "cc-by-nc-sa", "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n Copyright (C) 2007": "gpl-3", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "lgpl",
}


def test_headers_and_identifiers(spark):
    rows = spark.createDataFrame([(t, t) for t in CASES], "doc_id string, text string")
    assert {r["doc_id"]: r["labels"] for r in licenses.scan(rows).collect()} == CASES


def test_templates_of_any_length(spark):
    r = random.Random(1)
    words = [f"w{r.randint(0, 5000)}" for _ in range(3000)]
    texts = ((" ".join(words), "long"), ("all rights reserved", "short"))
    assert [t.size for t in licenses.templates_of(texts)] == [4096, 16]
    changed = [("x" if i % 40 == 0 else w) for i, w in enumerate(words)]  # more than nine of ten tokens stay
    broken = [("x" if i % 20 == 0 else w) for i, w in enumerate(words)]
    docs = [(k, "some text ahead " * n + " ".join(body) + " tail" * n) for k, (n, body) in enumerate([(0, words), (700, words), (3000, changed), (10, broken), (5, words[:2500])])]
    found = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), texts=texts).collect()
    assert {x["doc_id"]: x["labels"] for x in found} == {0: "long", 1: "long", 2: "long", 3: "", 4: ""}
