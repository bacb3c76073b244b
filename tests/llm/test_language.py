import zlib

import numpy as np
import pytest

from tracelake.llm import language, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_every_row(spark):
    rows = {r.doc_id: r for r in queries.op5_language(spark, SF).collect()}
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    assert len(rows) == len(truth)
    assert all(rows[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in truth)
    held = [r for r in truth if rows[r.doc_id].held_out]
    assert np.mean([rows[r.doc_id].lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_texts_without_letters_long_texts_and_null_rows(spark):
    words = {"xx": "aba bab abba baab ", "yy": "oko kok okko koko "}
    data = [(i, words[k] * (5 + i % 7), k, "a", "b") for i in range(80) for k in words] + [(None, "aba", "xx", "a", "b"), (900, None, "xx", "a", "b"), (901, "12 ,,", "yy", "a", "b"), (902, "", None, "a", "b"), (903, "oko kok " * 300000, None, "a", "b"), (904, "日本語の文章", None, "a", "b")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, score string, accepted string")
    model = language.fit(docs)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    for i in (900, 901, 902):
        assert (got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False)
    assert got[903].lang_pred == "yy" and got[903].accepted
    assert got[904].lang_pred in words
    assert got[None].lang_pred == "xx"
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns
    assert {900, 901, 902}.isdisjoint(r.doc_id for r in kept.collect())
    nothing = language.identify(docs.limit(0), language.fit(docs.limit(0)))
    assert nothing.count() == 0


def test_a_text_is_scored_alike_alone_and_among_others():
    model = language.train([("aba bab " * n, "x") for n in range(1, 30)] + [("oko kok " * n, "y") for n in range(1, 30)])
    texts = ["aba", "", "oko kok aba", "!", "kok", "b"]
    together = model.logits(texts)
    alone = np.concatenate([model.logits([t]) for t in texts])
    assert np.allclose(together, alone)
    bags = np.array([model.table[:, language._bag(t)[0]] @ language._bag(t)[1] + model.bias for t in texts])
    assert np.allclose(together, bags, atol=1e-5)


def test_ranges_of_a_very_long_text_count_each_gram_once(monkeypatch):
    model = language.train([(f"the house and the tree {i}", "en") for i in range(30)] + [(f"das haus und der baum {i}", "de") for i in range(30)])
    texts = ["the tree stands by the house " * 40, "der baum steht am haus", "x", ""]
    whole = model.logits(texts)
    monkeypatch.setattr(language, "_CHUNK", 50)
    assert np.allclose(model.logits(texts), whole, rtol=0, atol=1e-12)


def test_labels_that_are_no_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 3)
    docs = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(60)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        language.fit(docs)
