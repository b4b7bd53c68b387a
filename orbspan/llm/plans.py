"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import is_cell_id
from ..lineage import cut
from ..plans import sqltext as S
from ..sources.arrays import batch_slices, well_formed_batches
from . import frequent, overlaps, simpairs, sparse, terms

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


VALID = S.is_cell("cell_id")
_DAYS = [["day", "instrument", "resolution"], ["day", "instrument"], ["day", "resolution"], ["day"]]


def _daily(spark, sf_dir):
    rows = read(spark, sf_dir, "coverage").where(is_cell_id("cell_id"))
    return rows.select(F.to_date("covered_at").alias("day"), "instrument", "resolution", "cell_id")


def _starred(df: DataFrame, *more):
    star = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*")).alias(c)
    return df.select(F.col("day").cast("string").alias("covered_day"), star("instrument"), star("resolution"), *more)


@query(f"""SELECT strftime(covered_at, '%Y-%m-%d') AS covered_day, coalesce(instrument, '*') AS instrument, coalesce(CAST(resolution AS VARCHAR), '*') AS resolution
FROM (SELECT CAST(covered_at AS DATE) AS covered_at, instrument, resolution, cell_id FROM coverage
      WHERE {VALID} AND covered_at IS NOT NULL AND instrument IS NOT NULL AND resolution IS NOT NULL)
GROUP BY GROUPING SETS ((covered_at, instrument, resolution), (covered_at, instrument), (covered_at, resolution), (covered_at))
HAVING count(*) >= 100 AND count(DISTINCT cell_id) * 5 < count(*)""")
def p1_found(spark, sf_dir):
    keys = ["day", "instrument", "resolution"]
    return _starred(sparse.sparse_groups(_daily(spark, sf_dir), keys, "cell_id", _DAYS, least=100, share=0.2))


@query()
def p1_estimates(spark, sf_dir):
    """Estimated different cells of every group, with the stated standard deviation."""
    from .bitmaps import ERROR

    keys = ["day", "instrument", "resolution"]
    found = sparse.group_estimates(_daily(spark, sf_dir).dropna(), keys, "cell_id", _DAYS)
    return _starred(found, "n", F.round("estimate").cast("bigint").alias("cells"), F.round(F.col("estimate") * ERROR, 1).alias("deviation"))


@query(f"""SELECT strftime(covered_at, '%Y-%m-%d') AS covered_day, coalesce(instrument, '*') AS instrument, coalesce(CAST(resolution AS VARCHAR), '*') AS resolution,
CAST(count(DISTINCT cell_id) AS BIGINT) AS cells, true AS within
FROM (SELECT CAST(covered_at AS DATE) AS covered_at, instrument, resolution, cell_id FROM coverage
      WHERE {VALID} AND covered_at IS NOT NULL AND instrument IS NOT NULL AND resolution IS NOT NULL)
GROUP BY GROUPING SETS ((covered_at, instrument, resolution), (covered_at, instrument), (covered_at, resolution), (covered_at))""")
def p1_within(spark, sf_dir):
    """The different cells of every group counted exactly, and whether the estimate is within five of the stated deviations."""
    from .bitmaps import ERROR

    keys = ["day", "instrument", "resolution"]
    rows = _daily(spark, sf_dir).dropna()
    found = sparse.group_estimates(rows, keys, "cell_id", _DAYS).select("__set", *keys, "estimate")
    kinds = {k: rows.schema[k].dataType for k in keys}
    groups = [F.struct(*[(F.col(k) if k in s else F.lit(None).cast(kinds[k])).alias(k) for k in keys]) for s in _DAYS]
    exact = rows.select("cell_id", F.explode(F.array(*groups)).alias("g")).distinct().groupBy("g").agg(F.count("*").alias("cells"))
    match = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"g.{k}"))
        match = one if match is None else match & one
    off = F.abs(F.col("estimate") - F.col("cells"))
    return _starred(found.join(exact, match), "cells", (off <= 5 * ERROR * F.col("cells") + 2).alias("within"))


@query(f"WITH v AS (SELECT cell_id FROM coverage WHERE {VALID}) SELECT cell_id FROM v GROUP BY cell_id HAVING count(*) * 100 >= (SELECT count(*) FROM v)")
def p2_found(spark, sf_dir):
    rows = read(spark, sf_dir, "coverage").where(is_cell_id("cell_id"))
    return frequent.frequent_items(rows, "cell_id", 0.01).select(F.col("item").alias("cell_id"))


@query(f"WITH v AS (SELECT cell_id FROM coverage WHERE {VALID}) SELECT cell_id, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY cell_id HAVING count(*) * 1000 >= (SELECT count(*) FROM v)")
def p2_counts(spark, sf_dir):
    rows = read(spark, sf_dir, "coverage").where(is_cell_id("cell_id"))
    return frequent.frequent_items(rows, "cell_id", 0.001).select(F.col("item").alias("cell_id"), "n")


_SETS = f"""WITH {S.BATCHES}, el AS (SELECT batch_id, footprint_id, unnest(cells) AS cell_id FROM slices),
m AS (SELECT DISTINCT batch_id, footprint_id, cell_id FROM el WHERE {VALID})"""


@query(f"""{_SETS}, s AS (SELECT DISTINCT footprint_id AS f, cell_id AS c FROM m WHERE footprint_id IS NOT NULL), z AS (SELECT f, count(*) AS n FROM s GROUP BY f),
p AS (SELECT x.f AS a, y.f AS b, count(*) AS o FROM s x JOIN s y ON x.c = y.c AND x.f < y.f GROUP BY 1, 2)
SELECT a AS footprint_a, b AS footprint_b FROM p JOIN z za ON za.f = a JOIN z zb ON zb.f = b WHERE 2 * o >= za.n + zb.n - o""")
def p4_found(spark, sf_dir):
    return simpairs.similar_pairs(_slice_sets(spark, sf_dir), 0.5).select(F.col("id_a").alias("footprint_a"), F.col("id_b").alias("footprint_b"))


def _slice_sets(spark, sf_dir):
    slices = batch_slices(read(spark, sf_dir, "coverage_batches"))
    return slices.select(F.col("footprint_id").alias("id"), F.filter("cells", is_cell_id).alias("items"))


@query(f"""{_SETS}, s AS (SELECT DISTINCT footprint_id AS f, cell_id AS c FROM m WHERE footprint_id IS NOT NULL), z AS (SELECT f, count(*) AS n FROM s GROUP BY f),
p AS (SELECT x.f AS a, y.f AS b, count(*) AS o FROM s x JOIN s y ON x.c = y.c AND x.f < y.f GROUP BY 1, 2)
SELECT CAST(count(*) AS BIGINT) AS pairs, true AS recalled, true AS only_pairs FROM p JOIN z za ON za.f = a JOIN z zb ON zb.f = b WHERE 2 * o >= za.n + zb.n - o""")
def p4_recall(spark, sf_dir):
    """All pairs, whether segments of the codes find nine tenths of them, and whether they find nothing else."""
    sets = cut(_slice_sets(spark, sf_dir))
    every, some = (simpairs.similar_pairs(sets, 0.5, method=m).select("id_a", "id_b", F.lit(m).alias("by")) for m in ("prefix", "segments"))
    by = every.union(some).groupBy("id_a", "id_b").agg(F.max((F.col("by") == "prefix").cast("int")).alias("p"), F.max((F.col("by") == "segments").cast("int")).alias("s"))
    counts = by.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for n, c in (("pairs", F.col("p")), ("found", F.col("s")), ("both", F.col("p") * F.col("s")))))
    return counts.select("pairs", (F.col("both") * 10 >= F.col("pairs") * 9).alias("recalled"), (F.col("both") == F.col("found")).alias("only_pairs"))


_TERMS = f"""v AS (SELECT cell_id, footprint_id FROM coverage WHERE {VALID} AND footprint_id IS NOT NULL),
t AS (SELECT cell_id, count(*) AS n, count(DISTINCT footprint_id) AS r FROM v GROUP BY cell_id), a AS (SELECT count(DISTINCT footprint_id) AS f FROM v),
marks AS (SELECT cell_id, CAST(n AS BIGINT) AS n, CAST(r AS BIGINT) AS footprints, CASE WHEN r = 1 THEN 'rare' WHEN r * 5 >= f THEN 'common' END AS mark FROM t, a)"""


def _terms(spark, sf_dir):
    rows = read(spark, sf_dir, "coverage").where(is_cell_id("cell_id") & F.col("footprint_id").isNotNull())
    return terms.marked_counts(rows, "cell_id", "footprint_id").withColumnRenamed("term", "cell_id")


@query(f"WITH {_TERMS} SELECT cell_id, mark FROM marks WHERE mark IS NOT NULL")
def p6_found(spark, sf_dir):
    return _terms(spark, sf_dir).where("mark is not null").select("cell_id", "mark")


@query(f"WITH {_TERMS} SELECT cell_id, n, footprints, mark FROM marks")
def p6_counts(spark, sf_dir):
    return _terms(spark, sf_dir).select("cell_id", "n", F.col("records").alias("footprints"), "mark")


_OVER = """s AS (SELECT DISTINCT batch_id AS f, cell_id AS c FROM m), z AS (SELECT f, count(*) AS n FROM s GROUP BY f),
p AS (SELECT x.f AS a, y.f AS b, count(*) AS o FROM s x JOIN s y ON x.c = y.c AND x.f < y.f GROUP BY 1, 2),
done AS (SELECT a AS batch_a, b AS batch_b, CAST(o AS BIGINT) AS common, least(za.n, zb.n) AS least_size FROM p JOIN z za ON za.f = a JOIN z zb ON zb.f = b)"""


def _batch_overlaps(spark, sf_dir, share):
    once = well_formed_batches(read(spark, sf_dir, "coverage_batches")).where(F.size("footprint_ids") > 0)
    cells = cut(once.select("batch_id", "cell_ids")).select(F.col("batch_id").alias("set_id"), F.explode(F.array_distinct("cell_ids")).alias("item"))
    return overlaps.overlaps(cells.where(is_cell_id("item")), share, unique=True)


@query(f"{_SETS}, {_OVER} SELECT batch_a, batch_b FROM done WHERE common * 10 >= least_size * 3")
def p7_found(spark, sf_dir):
    return _batch_overlaps(spark, sf_dir, 0.3).select(F.col("set_a").alias("batch_a"), F.col("set_b").alias("batch_b"))


@query(f"{_SETS}, {_OVER} SELECT batch_a, batch_b, common FROM done WHERE common * 20 >= least_size")
def p7_sizes(spark, sf_dir):
    return _batch_overlaps(spark, sf_dir, 0.05).select(F.col("set_a").alias("batch_a"), F.col("set_b").alias("batch_b"), "common")


#: Folder of the public vocabularies.
VOCABULARIES = "/opt/tokenizers"


@query()
def p8_ids(spark, sf_dir):
    from .bpe import encode_texts

    return encode_texts(read(spark, sf_dir, "documents"), f"{VOCABULARIES}/byte_bpe_50k.json")


@query()
def p9_found(spark, sf_dir):
    from .leaks import leaks

    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


@query()
def p9_spans(spark, sf_dir):
    """Stretches of each page to take out, in characters."""
    from .leaks import leaks, removal_spans

    return removal_spans(leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items")))


@query()
def p10_found(spark, sf_dir):
    from .reading import reading_grades

    return reading_grades(read(spark, sf_dir, "documents"), read(spark, sf_dir, "reading_samples"))
