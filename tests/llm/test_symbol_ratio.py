"""Quality policy 3 against menu-like text, which policy 2 keeps."""

from crawlvis.llm import quality


def test_menus_are_rejected_and_prose_with_some_symbols_kept(spark):
    menu = " | ".join(f"item{i} page{i}" for i in range(60))
    prose = " ".join(f"word{i}" + ("%" if i % 10 == 0 else "") for i in range(100))
    edge = " ".join(f"word{i}" + ("*" if i % 5 == 0 else "") for i in range(100))
    docs = spark.createDataFrame([(1, menu), (2, prose), (3, edge), (4, edge + " *")], "doc_id long, text string")
    kept = lambda v: {x["doc_id"] for x in quality.judged(quality.ledger(docs), v).where("kept").collect()}
    assert kept(2) == {1, 2, 3, 4} and kept(3) == {2, 3}
    assert {x["doc_id"] for x in quality.kept_documents(docs).collect()} == {2, 3}
