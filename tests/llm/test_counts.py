import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbspan.llm import bitmaps, frequent, overlaps, sparse, terms


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# 1: distinct counts


@pytest.mark.parametrize("n", [1, 50, 3000, 60_000, 800_000])
def test_estimates_stay_within_the_stated_error(spark, n):
    d = spark.range(n).select((F.col("id") * 7919 % 10_000_019).alias("x"))
    d = d.union(d.limit(min(n, 1000)))
    got = bitmaps.estimate(bitmaps.sketch(d, [], "x"), []).first()
    assert got["n"] == n + min(n, 1000)
    assert abs(got["estimate"] - n) <= max(1.0, 4 * bitmaps.ERROR * n)


def test_error_over_many_groups(spark):
    d = spark.range(200 * 5000).select((F.col("id") % 200).alias("k"), F.col("id").alias("x"))
    wrong = np.array([r["estimate"] / 5000 - 1 for r in bitmaps.estimate(bitmaps.sketch(d, ["k"], "x"), ["k"]).collect()])
    assert wrong.std() < bitmaps.ERROR and abs(wrong.mean()) < bitmaps.ERROR / 4


def test_partial_sketches_add_up(spark):
    d = spark.range(30_000).select((F.col("id") % 3).alias("day"), (F.col("id") % 7000).alias("x"))
    whole = bitmaps.sketch(d, [], "x")
    parts = [bitmaps.sketch(d.where(f"day = {k}"), [], "x") for k in range(3)]
    again = bitmaps.merge(parts[0].union(parts[1]).union(parts[2]), [])
    assert rows(again.select("slot", "word", "n")) == rows(whole.select("slot", "word", "n"))


def test_grouping_sets_equal_single_sketches(spark):
    d = spark.range(20_000).select((F.col("id") % 4).alias("a"), (F.col("id") % 5).alias("b"), (F.col("id") % 900).alias("x"), F.lit(1).alias("n"))
    got = sparse.group_estimates(d, ["a", "b"], "x", [["a", "b"], ["a"], ["b"], []])
    for by in (["a", "b"], ["a"], ["b"], []):
        want = rows(bitmaps.estimate(bitmaps.sketch(d, by, "x"), by))
        part = got
        for k in ("a", "b"):
            part = part.where(F.col(k).isNotNull() if k in by else F.col(k).isNull())
        assert rows(part.select(*by, "n", "estimate")) == want


def test_sparse_groups_against_brute_force(spark):
    rng = random.Random(4)
    data = []
    for g in range(60):
        n = rng.randrange(50, 400)
        d = max(1, int(n * rng.choice([0.05, 0.19, 0.2, 0.21, 0.6])))
        data += [(g % 6, f"g{g}", int(x % d) + 1000 * g, "x") for x in range(n)]
    data += [(None, "g1", 3, "x"), (1, None, 3, "x"), (1, "g1", None, "x")]
    d = spark.createDataFrame(data, "a int, b string, x bigint, __n string")
    got = rows(sparse.sparse_groups(d, ["a", "b"], "x", [["a", "b"], ["a"]], 100, 0.2))
    want, groups = [], {}
    for a, b, x, _ in data:
        if None not in (a, b, x):
            for key in ((a, b), (a, None)):
                groups.setdefault(key, []).append(x)
    want = [k for k, v in groups.items() if len(v) >= 100 and len(set(v)) * 5 < len(v)]
    assert got == sorted(want, key=str)
    assert rows(sparse.sparse_groups(d.limit(0), ["a", "b"], "x", [["a"]], 100, 0.2)) == []


# 2: frequent items


def skewed(spark, n=60_000, parts=7):
    d = spark.range(n).select(F.when(F.col("id") % 10 < 3, 1).when(F.col("id") % 50 == 7, 2).otherwise(F.col("id") * 17 % 40_009).alias("x"))
    return d.repartition(parts)


def test_summary_bounds_hold(spark):
    d, counters = skewed(spark), 40
    truth = {r["x"]: r["count"] for r in d.groupBy("x").count().collect()}
    total = sum(truth.values())
    kept = frequent.space_saving(d, "x", counters).collect()
    end = [r for r in kept if r["item"] is None][0]
    assert end["count"] == total and len(kept) == counters + 1
    for r in kept:
        if r["item"] is not None:
            assert r["count"] - r["error"] <= truth[r["item"]] <= r["count"]
    held = {r["item"] for r in kept}
    assert {k for k, v in truth.items() if v > end["error"]} <= held and end["error"] <= 2 * total / counters


def test_frequent_items_are_exact(spark):
    d = skewed(spark).union(spark.range(500).select(F.lit(None).cast("bigint").alias("x")))
    truth = {r["x"]: r["count"] for r in d.where("x is not null").groupBy("x").count().collect()}
    total = sum(truth.values())
    for share in (0.5, 0.1, 0.01):
        assert rows(frequent.frequent_items(d, "x", share)) == sorted(((k, v, 0) for k, v in truth.items() if v >= share * total), key=str)
    loose = {r["item"] for r in frequent.frequent_items(d, "x", 0.01, exact=False).collect()}
    assert {1, 2} <= loose
    words = d.select(F.col("x").cast("string").alias("item"), F.lit(0).alias("count"))
    assert {r[0] for r in frequent.frequent_items(words, "item", 0.1).collect()} == {"1"}
    assert rows(frequent.frequent_items(d.limit(0), "x", 0.1)) == []
    assert rows(frequent.frequent_items(d.where("x is null"), "x", 0.1)) == []


def test_ties_at_the_share(spark):
    d = spark.range(100).select((F.col("id") % 10).alias("x"))
    assert [r[0] for r in rows(frequent.frequent_items(d, "x", 0.1))] == list(range(10))


# 6: all terms


def test_term_counts_against_brute_force(spark):
    d = skewed(spark, 20_000).select("x", (F.rand(3) * 50).cast("int").alias("record"), F.lit(9).alias("n"))
    d = d.union(d.limit(300)).union(spark.createDataFrame([(None, 1, 9), (1, None, 9), (77_777_777, None, 9)], "x bigint, record int, n int"))
    d = spark.createDataFrame(d.collect(), d.schema)
    want = d.where("x is not null").groupBy("x").agg(F.count("*"), F.countDistinct("record"))
    assert rows(terms.term_counts(d, "x", "record")) == rows(want)
    assert rows(terms.term_counts(d.limit(0), "x", "record")) == []
    marks = {r["term"]: r["mark"] for r in terms.marked(terms.term_counts(d, "x", "record"), 50).collect()}
    assert marks[1] == "common" and marks[77_777_777] == "rare"


def test_term_counts_of_words_far_record_numbers_and_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(terms, "CHUNK", 1000)
    d = skewed(spark, 12_000).select("x", (F.rand(4) * 60).cast("int").alias("r")).where("x is not null")
    d = spark.createDataFrame(d.collect(), d.schema)
    far = (F.col("r") - 30).cast("bigint") * F.lit(1 << 56)
    for record in (far, F.col("r").cast("string"), F.when(F.col("r") > 3, F.col("r")).cast("double")):
        e = d.select(F.concat(F.lit("t"), F.col("x")).alias("term"), record.alias("record"), F.lit(0).alias("kind"))
        want = e.groupBy("term").agg(F.count("*"), F.countDistinct("record"))
        counts, total = terms.count_table(e, "term", "record")
        assert rows(counts) == rows(want) and total.first()[0] == e.select("record").dropna().distinct().count()
    marks = terms.marked_counts(e, "term", "record")
    assert marks.where("term = 't1' and mark = 'common'").count() == 1


# 7: overlaps


@pytest.mark.parametrize("long, split, most", [(1, 3, 500_000), (3, 1024, 0), (64, 1024, 500_000)])
def test_overlaps_against_brute_force(spark, monkeypatch, long, split, most):
    monkeypatch.setattr(overlaps, "LONG", long)
    monkeypatch.setattr(overlaps, "SPLIT", split)
    monkeypatch.setattr(overlaps, "MOST_BROADCAST", most)
    rng = random.Random(long)
    sets = {k: {int(40 * rng.random() ** 2) for _ in range(rng.randrange(1, 9))} for k in range(40)}
    sets[40] = sets[3] | {100, 101}
    data = [(k, x, 1) for k, s in sets.items() for x in s for _ in range(rng.randrange(1, 3))]
    data += [(None, 1, 1), (2, None, 1)]
    d = spark.createDataFrame(data, "set_id bigint, item bigint, size int")
    for share in (0.3, 1.0, 0.01):
        want = []
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if a < b and n and n >= share * min(len(sets[a]), len(sets[b])):
                    want.append((a, b, n, len(sets[a]), len(sets[b])))
        assert rows(overlaps.overlaps(d, share)) == sorted(want, key=str)
    assert rows(overlaps.overlaps(d.limit(0), 0.3)) == []
    with pytest.raises(ValueError):
        overlaps.overlaps(d, 0)
