"""N-grams of documents are counted where their text is."""

import pandas as pd

from isogloss.plans import registry

registry.load()


def test_repeated_ids(spark, tmp_path):
    rows = [(1, "a b a b"), (1, "a b c"), (2, ""), (3, None), (4, "x")]
    pd.DataFrame({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "lang": "en", "source": "s", "n_chars": 1}).to_parquet(tmp_path / "documents.parquet")
    out = registry.QUERIES["txt_25_ngrams"](spark, str(tmp_path))
    assert sorted(map(tuple, out.select("doc_id", "grams", "kinds").collect())) == [(1, 15, 9), (4, 1, 1)]
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
