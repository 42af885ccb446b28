"""References are resolved once."""

from isogloss.sources import readers as R
from pyspark.sql import functions as F


def test_references_once(spark):
    df = spark.createDataFrame([("<p>a&amp;amp b &amp;lt; &#233;&eacute; x&nbsp;&lt;y&#38;lt; c&amp</p>",)], "h string")
    assert df.select(R.visible_text(F.col("h"), True)).first()[0] == "a&amp b &lt; éé x <y&lt; c&amp"
