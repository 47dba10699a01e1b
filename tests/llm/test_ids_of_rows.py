"""What a reviewer found in round 4: a language stage that turned on ids."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("xxhash")

from landmosaic.llm import lang_id

LETTERS = {"aa": "abcdefghi", "bb": "jklmnopqr", "cc": "stuvwxyz"}


def said(lang: str, seed: int) -> str:
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(LETTERS[lang]) for _ in range(r.randrange(2, 8))) for _ in range(20))


@pytest.mark.parametrize("doc_id", ["8", "7", "NULL", "id % 2"])  # 7 is held out by the contract of op2
def test_f3_no_row_is_dropped_for_its_id(spark, doc_id, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(lang_id.fit, "__defaults__", (*lang_id.fit.__defaults__[:-1], 30))
    rows = [(i, said(lang, i), lang) for lang in LETTERS for i in range(100)] + [(i, None, "aa") for i in range(3)] + [(0, "12 34", None)]
    df = spark.createDataFrame(rows, "id long, text string, lang string").selectExpr(f"CAST({doc_id} AS LONG) AS doc_id", "text", "lang").repartition(3)
    got = corpus_pipeline.identify(spark, df, "")
    assert got.columns == df.columns and sorted(r.text for r in got.collect()) == sorted(t for _, t, _ in rows[:300])


def test_f3_the_sample_has_a_text_once(spark, monkeypatch):
    """Of copies one is learned from, so that they neither crowd out other texts nor come to the driver."""
    seen, ftrl = [], lang_id.ftrl
    monkeypatch.setattr(lang_id, "ftrl", lambda rows, *a, **k: seen.extend(rows) or ftrl(rows, *a, **k))
    df = spark.createDataFrame([(said("aa", 0), "aa")] * 3000 + [(said(k, i), k) for k in ("aa", "bb") for i in range(1 - (k == "bb"), 10)], "text string, lang string")
    model = lang_id.fit(df, per_language=20)
    assert len(seen) == 8 + 8 and model.predict([said("aa", 50), said("bb", 50)])[0] == ["aa", "bb"]
    assert lang_id.drop_unknown(df.withColumn("doc_id", F.lit(1)), least=0.4).count() == 3019
