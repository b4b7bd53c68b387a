import random

import pytest
from pyspark.sql import functions as F

from orbspan.llm import simpairs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def jaccard(a, b):
    return len(a & b) / len(a | b)


def families(seed, many=60):
    rng = random.Random(seed)
    sets = {}
    for k in range(many):
        base = [rng.randrange(4000) for _ in range(rng.randrange(1, 60))] + [rng.randrange(6) for _ in range(3)]
        for j in range(rng.randrange(1, 4)):
            s = [x for x in base if rng.random() > 0.12 * j] + [rng.randrange(9000) for _ in range(j * 2)]
            sets[10 * k + j] = s + s[:2] * (j % 2)
    sets[9001] = sets[9002] = sets[9003] = [5, 6, 7]  # exact copies
    sets[9004], sets[9005] = [], None
    sets[9006], sets[9007] = [1], [1, 2]
    return sets


def table(spark, sets):
    data = [(k, v if v is None else [*v, None], "x") for k, v in sets.items()] + [(None, [1], "x")]
    return spark.createDataFrame(data, "id bigint, items array<bigint>, n string")


@pytest.mark.parametrize("threshold, split", [(0.3, 2), (0.5, 1024), (0.8, 2), (1.0, 1024)])
def test_pairs_against_brute_force(spark, monkeypatch, threshold, split):
    monkeypatch.setattr(simpairs, "SPLIT", split)
    sets = families(1)
    clean = {k: set(v) for k, v in sets.items() if v}
    want = sorted((a, b) for a in clean for b in clean if a < b and jaccard(clean[a], clean[b]) >= threshold)
    assert rows(simpairs.similar_pairs(table(spark, sets), threshold)) == want and len(want) >= 3


def test_pairs_between_tables(spark):
    left, right = families(2, 25), {k + 7: v for k, v in families(2, 25).items()}
    a, b = ({k: set(v) for k, v in s.items() if v} for s in (left, right))
    want = sorted((x, y) for x in a for y in b if jaccard(a[x], b[y]) >= 0.5)
    assert rows(simpairs.similar_pairs(table(spark, left), 0.5, other=table(spark, right))) == want


@pytest.mark.parametrize("threshold, split", [(0.5, 2), (0.8, 1024)])
def test_segments_find_the_share_they_tell(spark, monkeypatch, threshold, split):
    monkeypatch.setattr(simpairs, "SPLIT", split)
    sets = families(4, 150)
    every = set(rows(simpairs.similar_pairs(table(spark, sets), threshold)))
    some = set(rows(simpairs.similar_pairs(table(spark, sets), threshold, method="segments")))
    assert some <= every and len(some) >= 0.95 * len(every) > 50
    assert 0.63 < simpairs.recall(0.5) < 0.66 and simpairs.recall(0.8) > 0.99 and simpairs.recall(1.0) == 1.0
    with pytest.raises(ValueError):
        simpairs.similar_pairs(table(spark, sets), 0.5, method="bands")


def test_links_of_representatives_and_membership(spark):
    sets = {1: [1, 2, 3], 2: [1, 2, 3], 3: [1, 2, 3], 4: [1, 2, 3, 4], 5: [9], 6: [9]}
    named = spark.createDataFrame(list(sets.items()), "id bigint, items array<bigint>")
    links, owner = simpairs.similar_sets(named, 0.5)
    assert rows(links) == [(1, 4, 3, 3, 4)]
    assert rows(owner) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5)]


def test_edges(spark):
    empty = table(spark, {}).where("id is not null")
    assert rows(simpairs.similar_pairs(empty, 0.5)) == []
    for bad in (0.0, 1.1):
        with pytest.raises(ValueError):
            simpairs.similar_pairs(empty, bad)


def test_radius_keeps_pairs_at_the_threshold(spark):
    rng = random.Random(9)
    sets = []
    for k in range(300):
        common = [rng.randrange(10**12) for _ in range(20)]
        sets += [(2 * k, common + [rng.randrange(10**12) for _ in range(10)]), (2 * k + 1, common + [rng.randrange(10**12) for _ in range(10)])]
    s = simpairs.sketches(spark.createDataFrame(sets, "id bigint, items array<bigint>"), "id", "items").withColumn("k", F.floor(F.col("id") / 2))
    a, b = s.where("id % 2 = 0").alias("a"), s.where("id % 2 = 1").alias("b")
    far = [r[0] for r in a.join(b, F.col("a.k") == F.col("b.k")).select(simpairs.hamming("a", "b")).collect()]
    assert max(far) <= simpairs.radius(0.5) < simpairs.SKETCH / 2
    assert abs(sum(far) / len(far) - simpairs.SKETCH / 4) < 3
