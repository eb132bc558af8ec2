from pyspark.sql import functions as F

from ledgerlake.llm import language as L

WORDS = {"en": "the of and to that with this from have would", "de": "der die und nicht von mit das ist auf ein", "fr": "le les des est dans que pour une avec pas", "es": "el los de que en por una con para las", "fi": "ja on ei se että oli hän niin kuin mutta"}


def corpus():
    rows = []
    for k, (lang, words) in enumerate(WORDS.items()):
        w = words.split()
        rows += [(1000 * k + i, " ".join(w[(i * j + j) % 10] for j in range(30)) + " 12", lang, "src") for i in range(60)]
    return rows


SCHEMA = "doc_id bigint, text string, lang string, raw string"


def test_held_out_accuracy_and_defined_results(spark):
    extra = [(90001, None, "en", ""), (90002, "12 34 !!", None, ""), (None, "the of and to that", "en", ""), (5, corpus()[5][1], "en", "")]
    docs = spark.createDataFrame([*corpus(), *extra], SCHEMA)
    model = L.fit(docs, sample=40)
    assert model["langs"] == sorted(WORDS)
    got = L.predict(docs, model).collect()
    truth = {r[0]: r[2] for r in corpus()}
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[90001].lang_pred == by_id[90002].lang_pred == "und" and by_id[90001].score == 0
    assert by_id[None].lang_pred == "en"
    assert sum(by_id[i].lang_pred == x for i, x in truth.items()) >= 0.97 * len(truth)
    assert all(0 <= r.score <= 1 for r in got)


def test_training_never_sees_held_out_rows_and_is_bounded(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    marked = docs.withColumn("text", F.when(L.held_out(F.col("doc_id")), "HELD").otherwise(F.col("text")))
    rows = L.training_rows(marked, sample=20)
    assert rows.where(F.col("raw") == F.lit(b"HELD")).count() == 0
    assert {r["count"] for r in rows.groupBy("lang").count().collect()} == {20}


def test_no_labels_one_language_and_empty(spark):
    none = spark.createDataFrame([(1, "text", None, "")], SCHEMA)
    assert L.predict(none, L.fit(none)).first().lang_pred == "und"
    one = spark.createDataFrame([(1, "text", "xx", ""), (4, "more", "xx", "")], SCHEMA)
    assert [r.lang_pred for r in L.predict(one, L.fit(one)).collect()] == ["xx", "xx"]
    assert L.predict(one.limit(0), L.fit(one.limit(0))).collect() == []


def brute_features(text):
    """Relative frequencies' square roots of byte pairs and triples of lower-cased letters, runs of other ASCII as one blank."""
    import re

    raw = re.sub(rb"[\x00-\x60\x7b-\x7f]+", b" ", b" " + text.encode().lower() + b" ")
    found = {}
    for i in range(len(raw) - 1):
        at = ((raw[i] * 256 + raw[i + 1]) * 2654435761 % 2**32) >> 18
        found[at] = found.get(at, 0) + 1
    for i in range(len(raw) - 2):
        code = (raw[i] * 256 + raw[i + 1]) * 256 + raw[i + 2]
        at = ((code * 2246822519 + 97) % 2**32) >> 18
        found[at] = found.get(at, 0) + 1
    total = sum(found.values())
    return {k: (v / total) ** 0.5 for k, v in found.items()}


def test_the_query_votes_as_brute_force_does(spark, tmp_path):
    rows = corpus() + [(80000, " ".join(x.split()[0] for x in WORDS.values()), None, "s"), (80001, "Ünï çode only é", None, "s"), (80002, None, "en", "s"), (80003, "1 2 3", "en", "s"), (80004, "the of and to that with this " * 20000, None, "s")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = L.fit(docs.select("doc_id", "text", "lang"))
    fams = sorted({L.family(x) for x in model["langs"]})

    def winner(level, classes, x):
        won = {c: [0, 0.0] for c in classes}
        for i, a in enumerate(classes):
            for b in classes[i + 1 :]:
                w = model["machines"][level, a, b]
                m = float(w[-1]) + sum(float(w[k]) * v for k, v in x.items())
                won[a if m >= 0 else b][0] += 1
                won[a][1] += m
                won[b][1] -= m
        return max(classes, key=lambda c: won[c])

    got = {r.doc_id: r for r in L.op8_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        if text is None or not any(c.isalpha() for c in text):
            assert got[doc_id].lang_pred == "und"
            continue
        x = brute_features(text)
        fam = winner("family", fams, x)
        assert got[doc_id].lang_pred == winner("lang", [y for y in model["langs"] if L.family(y) == fam], x), text[:60]


def test_a_family_gets_no_more_rows_than_a_language(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    rows = L.sampled_features(L.training_rows(docs, sample=30))
    assert rows.count() == 150
    model = L.fit(docs, sample=30)
    assert {k[0] for k in model["machines"]} == {"family", "lang"}


def test_very_long_text_is_predicted_whole(spark):
    """Two million words of one language after a first part in another."""
    words = {"de": "der die und nicht wasser über straße", "en": "the and with water street over not"}
    docs = spark.createDataFrame([(i, " ".join([words[lang]] * 5), lang) for i, lang in enumerate(["de", "en"] * 20)], "doc_id long, text string, lang string")
    long = (words["de"] + " ") * 50 + (words["en"] + " ") * 280_000
    got = L.predict(spark.createDataFrame([(1, long), (2, None)], "doc_id long, text string"), L.fit(docs))
    assert {r.doc_id: r.lang_pred for r in got.collect()} == {1: "en", 2: "und"}
