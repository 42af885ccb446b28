"""Values of a key in first-seen order: by a number that no sort stands before, in the order of the struct."""

from isogloss.operators import lexicon as L
from isogloss.plans import lexicons


def test_order_of_structs_and_numbers_agree(spark, tmp_path):
    ids = [-(2**63), -1, 0, 1, 2**31, 2**62, 2**63 - 1]
    rows = [(i, "en", "s", f"A{abs(i) % 7} b c. X{n} b d. A b", 1) for n, i in enumerate(ids)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    p = lexicons.pairs(spark, str(tmp_path))
    order = [tuple(r.seq) for r in p.orderBy("place").select("seq").collect()]
    assert order == sorted(order) and len(set(order)) == len(order)
    by_seq, by_place = (sorted(map(str, L.ambiguity_points(p, order=o).collect())) for o in ("seq", "place"))
    assert by_seq == by_place and by_seq
    assert sorted(map(str, L.alternatives(p, order="seq").collect())) == sorted(map(str, L.alternatives(p, order="place").collect()))


def test_no_rows_are_sorted_before_the_shuffle(spark, sf):
    for name in ("ambiguity_points", "alternatives"):
        plan = getattr(lexicons, name)(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "array_sort" not in plan
