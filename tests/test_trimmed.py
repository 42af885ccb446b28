"""Lines and parts that begin or end in the digits of their place."""

from isogloss.functions import segment as S
from isogloss.functions import text as T
from pyspark.sql import functions as F


def test_digits_stay(spark):
    df = spark.createDataFrame([(1, " 01 a 0 \n10 b 101\n 2 c. 22 "), (2, "0\n1\n\n3")], "doc_id long, text string")
    got = {(r.doc_id, r.par_no): r.text for r in S.explode_paragraphs(df).collect()}
    assert got == {(1, 0): "01 a 0", (1, 1): "10 b 101", (1, 2): "2 c. 22", (2, 0): "0", (2, 1): "1", (2, 2): "3"}
    assert [r[0] for r in df.orderBy("doc_id").select(T.drop_lines(F.col("text"), ["b"])).collect()] == ["01 a 0 2 c. 22", "0 1 3"]


def test_rejoined(spark):
    df = spark.range(1).select(S.rejoined(F.array(F.lit(" 00 words. "), F.lit("1 more 1"), F.lit(" "))).alias("s"))
    assert df.first().s == ["00 words.", "1 more 1"]


def test_prevert(spark, tmp_path):
    from isogloss.sources import readers as R

    (tmp_path / "a.txt").write_text('<doc id="1">\n<p id="1">\n0 first 0\n 1 second 21 \n</p>\n</doc>')
    assert R.prevert(spark, str(tmp_path)).first().text == "0 first 0 1 second 21"
