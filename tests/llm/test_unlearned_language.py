"""The pipeline's language stage on texts in languages that the model hasn't learned."""

import random

from crawlvis.llm import language

LEARNED = {"en": "the of and to in that it was for on with his they be at one have this from", "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als"}
UNLEARNED = {
    "ru": "президент сказал что экономическая ситуация в стране не очень хорошая и правительство должно больше",
    "fi": "hallitus on tehnyt uuden lain joka tulee voimaan ensi vuonna kaikissa kunnissa saadaan rahaa koulujen rakentamiseen",
    "gibberish": "qwv zrtk hjeth ofand plotht zder undthe mnicht xin wasfor thonew dieauf krindem",
}


def test_unlearned_languages_are_rejected_at_any_length(spark):
    r = random.Random(5)
    text = lambda words, n: " ".join(r.choice(words.split()) for _ in range(n))
    train = [(i, text(LEARNED[x], 60), x) for i, x in enumerate(("en", "de") * 40)]
    model = language.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert (model.grams[1].find(language.hashed(["\x02", "\x03"])) < 0).all()
    rows = [(f"{x}-{n}", text(words, n)) for x, words in {**LEARNED, **UNLEARNED}.items() for n in (20, 65, 400, 3000)] + [("ru-2", "экономическая ситуация"), ("zh", "总统表示经济形势不好")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "cast(null as string) as lang")
    kept = {x["doc_id"] for x in language.kept_documents(docs, model).collect()}
    assert kept == {f"{x}-{n}" for x in LEARNED for n in (20, 65, 400, 3000)}
    nothing = language.fit(docs)  # unlabelled input teaches no language
    assert language.kept_documents(docs, nothing).count() == 0
