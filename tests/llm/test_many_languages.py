"""Languages beyond the 64th, and rare ones among many documents."""

import pytest

from tempograin.llm import language


def test_every_language_is_told(spark):
    word = lambda k: "".join(chr(97 + (k * 7 + i * (k + 3)) % 26) for i in range(9)) + f"{k:02d}"
    code = lambda k: chr(97 + k // 26) + chr(97 + k % 26)
    rows = [(k * 100 + i, code(k), f"{word(k)} " * 20) for k in range(70) for i in range(1 if k == 69 else 2)]
    d = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    languages, table = language.learn_language_model(d)
    assert languages == sorted(code(k) for k in range(70)) and len(table) == 70
    pages = spark.createDataFrame([(k, "", f'<html lang="{code(k)}"><p>{word(k)} {word(k)}</p>') for k in range(70)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["lang"], r["declared_lang"]) for r in language.identify(pages, languages, table).collect()}
    assert got == {k: (code(k), code(k)) for k in range(70)}
    with pytest.raises(ValueError, match="more than 69"):
        language.learn_language_model(d, most=69)


def test_a_rare_language_is_sampled_whole(spark):
    d = spark.range(3000).selectExpr("id as doc_id", "if(id % 1000 = 7, 'xx', 'en') as lang", "if(id % 1000 = 7, 'zzzz zzzz', 'the and') as text")
    languages, table = language.learn_language_model(d, sample=4)
    assert languages == ["en", "xx"] and all(row.max() > row.min() for row in table)
