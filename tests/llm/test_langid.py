import zlib

from pyspark.sql import functions as F

from sedimark.llm import langid, queries


def test_held_out_languages_are_predicted(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op3_langid(spark, sf).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    out = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out]
    assert sum(out) >= 0.98 * len(out)


def test_families_pairs_and_texts_without_letters():
    texts = ["the cat and the dog with that", "der hund und die katze mit nicht", "le chat et les chiens avec des", "el gato y los perros con una", "кот и собака"] * 6
    model = langid.fit_rows(texts, ["en", "de", "fr", "es", "ru"] * 6)
    assert model.families == ["germanic", "romance", "slavic"] and model.languages["romance"] == ["es", "fr"]
    assert [model.predict(t)[0] for t in texts[:5]] == ["en", "de", "fr", "es", "ru"]
    assert all(model.predict(t) == ("und", 0.0) for t in (None, "", "12 !! ½", " \n"))
    assert model.predict("the and that " * 200_000)[0] == "en"


def test_few_labels(spark):
    docs = spark.createDataFrame([(1, "the cat", "en", "x"), (1, "the cat", "en", "x"), (None, "die katze", "de", "y"), (4, None, "en", "z"), (5, "le chat", None, "w")], "doc_id bigint, text string, lang string, lang_pred string")
    one = langid.fit(docs, F.lit(True))
    rows = langid.identify(docs, one).collect()
    assert sorted((r.text or "", r.lang_pred, r.score) for r in rows) == [("", "und", 0.0), ("die katze", "en", 1.0), ("le chat", "en", 1.0), ("the cat", "en", 1.0), ("the cat", "en", 1.0)]
    none = langid.fit(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(docs.limit(0), one).count() == 0
    assert sorted(r.text for r in langid.identified(docs, one, 0.3).collect()) == ["die katze", "le chat", "the cat", "the cat"]


def test_the_sample_is_bounded(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("the cat").alias("text"), F.when(F.col("id") < 4990, "en").otherwise("de").alias("lang"))
    assert langid.fit(docs, F.lit(True), max_rows=40).languages == {"germanic": ["de", "en"]}


def test_repeated_ids_and_many_labels_stay_bounded(spark, monkeypatch):
    docs = spark.range(3000).select(F.lit(5).alias("doc_id"), F.lit("the cat and the dog").alias("text"), F.lit("en").alias("lang"))
    more = spark.range(300).select((F.col("id") + 10).alias("doc_id"), F.concat(F.lit("word "), "id").alias("text"), F.concat(F.lit("l"), "id").alias("lang"))
    fitted = []
    monkeypatch.setattr(langid, "fit_matrix", lambda x, langs, make=langid.fit_matrix: fitted.append(langs) or make(x, langs))
    model = langid.fit(docs.union(more), F.lit(True), max_rows=50, max_langs=3)
    assert sorted(fitted[0]) == ["en", "l0", "l1"] and sorted(model.families) == ["germanic", "l0", "l1"]


def test_vote_equals_a_second_implementation():
    texts = ["the cat and the dog with that", "der hund und die katze mit nicht", "de hond en de kat met niet", "le chat et les chiens avec des", "el gato y los perros con una"] * 5
    model = langid.fit_rows(texts, ["en", "de", "nl", "fr", "es"] * 5)
    for text in [*texts[:5], "die and le", "kat gato", "x"]:
        x = [*langid.vector(text).tolist(), 1.0]
        dot = lambda w: sum(a * b for a, b in zip(w.tolist(), x, strict=True))  # noqa: E731, B023
        margins = [dot(w) for w in model.family_weights]
        names = model.languages[model.families[margins.index(max(margins))]]
        wins, at = dict.fromkeys(names, 0.0), 0
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                wins[a if dot(model.pair_weights[model.families[margins.index(max(margins))]][at]) >= 0 else b] += 1
                at += 1
        most = max(wins.values())
        assert model.predict(text)[0] in [n for n in names if wins[n] == most]
