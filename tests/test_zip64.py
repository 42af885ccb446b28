"""A zip file of more members than two bytes count."""

import zipfile

from isogloss.sources import readers as R
from isogloss.sources import writers as W
from pyspark.sql import functions as F


def test_many_members(spark, tmp_path):
    n = 70_000
    path = str(tmp_path / "z")
    d = spark.range(n).select(F.concat(F.lit("d/"), F.col("id").cast("string")).alias("name"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("text"))
    W.zipped(d.coalesce(1), path, "name", "text")
    (file,) = [p for p in (tmp_path / "z").iterdir() if p.name.startswith("part-")]
    with zipfile.ZipFile(file) as z:
        assert len(z.infolist()) == n and z.read("d/69999") == b"line 69999" and z.read("d/0") == b"line 0"
    got = R.zipped_lines(spark, path).agg(F.count("*"), F.count_distinct("member"), F.count_if(F.col("value") == F.concat(F.lit("line "), F.substring("member", F.lit(3), F.lit(9))))).first()
    assert tuple(got) == (n, n, n)
