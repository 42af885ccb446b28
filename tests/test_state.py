"""Zip files by members, state tables of streams, and coverage until nothing lacks."""

from __future__ import annotations

import io
import random
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from isogloss.operators import selection as L
from isogloss.sources import readers, writers
from isogloss.streaming import jobs


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_members_of_one_zip_go_to_many_tasks(spark, tmp_path, small_splits):
    r = random.Random(1)
    texts = {f"d/{i}é.txt": "".join(r.choice("abc\n é") for _ in range(r.randrange(4000))) for i in range(60)}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/", "")
        for i, (name, text) in enumerate(texts.items()):
            z.writestr(name, text, zipfile.ZIP_DEFLATED if i % 3 else zipfile.ZIP_STORED)
    stream = io.BytesIO()
    stream.seekable = lambda: False  # sizes stand behind the data then
    with zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in texts.items():
            z.writestr(name, text)
    (tmp_path / "b.zip").write_bytes(stream.getvalue())
    for file in ("a", "b"):
        found = readers.zipped_members(spark, str(tmp_path / f"{file}.zip"))
        assert found.rdd.getNumPartitions() > 1
        assert {m.member: bytes(m.content).decode() for m in found.collect()} == texts


def test_signature_inside_of_a_member_and_damage(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("x", "PK\x03\x04 again PK\x03\x04")
    with zipfile.ZipFile(tmp_path / "o.zip", "w") as z:
        z.writestr("inner.zip", inner.getvalue())
        z.writestr("last", "text")
    found = {m.member: bytes(m.content) for m in readers.zipped_members(spark, str(tmp_path / "o.zip")).collect()}
    assert found == {"inner.zip": inner.getvalue(), "last": b"text"}
    data = (tmp_path / "o.zip").read_bytes().replace(b"text", b"tex!")
    (tmp_path / "bad.zip").write_bytes(data)
    with pytest.raises(Exception, match="checksum"):
        readers.zipped_members(spark, str(tmp_path / "bad.zip")).collect()


def test_zip_round_trip(spark, tmp_path):
    rows = [(f"n{i}", "é\n" * i) for i in range(40)] + [(None, "x"), ("y", None)]
    writers.zipped(spark.createDataFrame(rows, "name string, text string").repartition(3), str(tmp_path / "z"), "name", "text")
    seen = {}
    for f in (tmp_path / "z").glob("part-*"):
        with zipfile.ZipFile(f) as z:
            assert z.testzip() is None
            seen |= {n: z.read(n).decode() for n in z.namelist()}
    assert seen == dict(rows[:40])
    lines = readers.zipped_lines(spark, str(tmp_path / "z"))
    assert Counter(r.member for r in lines.collect()) == Counter({f"n{i}": i for i in range(1, 40)})


def files(spark, path, *batches):
    for b in batches:
        spark.createDataFrame(b, "id int, text string").coalesce(1).write.mode("append").parquet(path)


def test_first_texts_by_a_table(spark, tmp_path):
    files(spark, f"{tmp_path}/in", [(1, "a b"), (2, "A  b 7"), (3, None)], [(4, "a b"), (5, "c")], [(6, "c"), (7, ""), (8, "d")])
    run = lambda: jobs.keep_first_by_table(jobs.new_documents(spark, f"{tmp_path}/in", "id int, text string", 1), "text", ["id"], f"{tmp_path}/out", f"{tmp_path}/seen", f"{tmp_path}/state", 2).awaitTermination()
    run()
    kept = spark.read.parquet(f"{tmp_path}/out")
    assert Counter((r.text or "").lower().replace(" 7", "").replace("  ", " ") for r in kept.collect()) == Counter(["a b", "", "c", "d"])
    files(spark, f"{tmp_path}/in", [(9, "d"), (10, "e")])
    run()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect())[-1] == 10 and spark.read.parquet(f"{tmp_path}/out").count() == 5
    # What the last base holds has gone, and a batch done twice writes the same.
    assert jobs._written(spark, f"{tmp_path}/seen", "base") == [3] and jobs._written(spark, f"{tmp_path}/seen", "batch") == []
    assert jobs.kept_state(spark, f"{tmp_path}/seen").count() == 5


def test_counts_from_a_base_and_deltas(spark, tmp_path):
    for n in range(7):
        delta = spark.createDataFrame([("a", 1), (None, n)], "source string, count long")
        for _ in range(2):  # a retry changes nothing
            jobs.add_delta(delta, n, f"{tmp_path}/c", 3, jobs._summed(["source"]))
    assert {r.source: r["count"] for r in jobs.last_counts(spark, ["source"], f"{tmp_path}/c").collect()} == {"a": 7, None: 21}
    assert jobs._written(spark, f"{tmp_path}/c", "base") == [5] and jobs._written(spark, f"{tmp_path}/c", "batch") == [6]


def test_coverage_fills_a_quota(spark):
    pool = spark.range(3000).select("id", F.array(F.lit("x")).alias("labels"))
    assert L.coverage(pool, "id", "labels", 1000, 1000).count() == 1000


def test_coverage_against_plain_greedy(spark):
    r = random.Random(3)
    rows = [(i, r.sample("abcdefg", r.randrange(1, 4)), r.randrange(8)) for i in range(120)]
    freq = Counter(x for _, ls, _ in rows for x in ls)
    quota, n = 6, 16
    have, used, chosen = Counter(), Counter(), []
    while len(chosen) < n:
        score = lambda row: sum(10 / freq[x] ** 0.5 for x in row[1] if have[x] < min(quota, freq[x]))
        best = max((row for row in rows if row not in chosen and used[row[2]] < 3), key=lambda row: (score(row), -row[0]), default=None)
        if best is None or not score(best):
            break
        chosen.append(best)
        have.update(best[1])
        used[best[2]] += 1
    got = L.coverage(spark.createDataFrame(rows, "id int, labels array<string>, g int"), "id", "labels", n, quota, caps={"g": 3}).collect()
    filled = lambda some: sum(min(quota, c) for c in Counter(x for row in some for x in row[1]).values())
    assert len(got) <= n and max(Counter(x.g for x in got).values()) <= 3
    assert filled([(x.id, x.labels) for x in got]) >= 0.9 * filled(chosen)


def test_chapters_by_headings(spark):
    rows = [(1, "<p>intro</p><h1>One &amp; a</h1><p>t</p><h2 class='x'><b>Two</b></h2><script><h3>no</h3></script>"), (2, "<h2>First</h2>text"), (3, "plain"), (4, None), (5, "")]
    got = [tuple(r) for r in readers.headed_chapters(spark.createDataFrame(rows, "page_id int, html string")).orderBy("page_id", "chapter").collect()]
    assert got == [(1, 0, None, None, "intro"), (1, 1, 1, "One & a", "t"), (1, 2, 2, "Two", ""), (2, 1, 2, "First", "text"), (3, 0, None, None, "plain")]
