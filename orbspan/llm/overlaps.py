"""Overlap sizes between many large sets, from membership signatures, in SQL.

The signature of an identifier is the sorted list of the sets it is in.
Identifiers with the same signature are collapsed to one row with their number, so
pairs are made per signature, not per identifier, and common identifiers are never
listed.

An identifier in more than LONG sets (hot) makes no pairs.  Hot identifiers are
numbered, and a set holds them as words of 64 numbers; what they add to a pair is
the number of bits that its two sets have in common, counted word by word, and only
for pairs that can still reach the asked share.  A pair that shares hot identifiers
only has to share one of the rarest of its smaller set, so only these meet; the
sets of an identifier are split in parts of SPLIT.  All of it is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

#: Longest signature that is expanded to pairs: at most 2016 of them.
LONG = 64
#: Sets of a hot identifier that meet in one place.
SPLIT = 1024
#: Rows of two numbers up to which a table is sent to all executors (about 20 MB); larger ones are joined by shuffle.
MOST_BROADCAST = 500_000


def sent_if_small(table: DataFrame, rows: int | None = None) -> DataFrame:
    """The table, marked for broadcast if it has at most ``rows`` rows (MOST_BROADCAST); it should be cheap to count."""
    return F.broadcast(table) if table.count() <= (MOST_BROADCAST if rows is None else rows) else table


def overlaps(members: DataFrame, share: float, unique: bool = False) -> DataFrame:
    """(set_a, set_b, common, size_a, size_b), a < b, where common >= share * the smaller size.

    ``members`` has (set_id, item); repeated rows count once, rows with a null
    count nowhere, sets without items are in no pair.  ``share`` is above 0.
    ``unique`` tells that no row is repeated, which saves a shuffle.
    """
    if not share > 0:
        raise ValueError("share must be above 0.")
    spark = members.sparkSession
    m = members.selectExpr("set_id", "item").where("set_id is not null and item is not null")
    m = m if unique else m.distinct()
    degree = cut(spark.sql("select item, count(*) as held from {m} group by item having count(*) > 1", m=m))
    shared = cut(spark.sql("select m.set_id, m.item, d.held from {m} m join {degree} d on m.item = d.item", m=m, degree=sent_if_small(degree)))
    numbered = cut(spark.sql("select item, monotonically_increasing_id() as k from {degree} where held > {long}", degree=degree, long=LONG))
    hot = cut(
        spark.sql("select s.set_id, s.item, s.held, n.k from {shared} s join {numbered} n on s.item = n.item", shared=shared, numbered=sent_if_small(numbered))
    )
    words = cut(
        spark.sql(
            "select set_id, shiftright(k, 6) as block, bit_or(shiftleft(1L, cast(k & 63 as int))) as word from {hot} group by set_id, shiftright(k, 6)",
            hot=hot,
        )
    )
    sized = cut(
        spark.sql(
            """
            with sizes as (select set_id, count(*) as size from {m} group by set_id)
            select s.set_id, s.size, coalesce(h.hot, 0) as hot from sizes s
            left join (select set_id, sum(bit_count(word)) as hot from {words} group by set_id) h on s.set_id = h.set_id""",
            m=m, words=words,
        )
    )
    light = spark.sql(
        """
        with short as (select item, sort_array(collect_list(set_id)) as signature from {shared} where held <= {long} group by item),
             signed as (select signature, count(*) as weight from short group by signature),
             firsts as (select signature, weight, posexplode(signature) as (at, a) from signed),
             pairs as (select a, explode(slice(signature, at + 2, size(signature))) as b, weight from firsts where at < size(signature) - 1)
        select a, b, sum(weight) as common from pairs group by a, b""",
        shared=shared, long=LONG,
    )
    # pairs without a short signature in common: the smaller set is made of hot items to the asked share
    only_hot = spark.sql(
        """
        with own as (select h.set_id, h.item, h.held, z.hot, ceil({share} * z.size - 1e-9) as least
                     from {hot} h join {sized} z on h.set_id = z.set_id where z.hot >= {share} * z.size - 1e-9),
             ranked as (select *, row_number() over (partition by set_id order by held, item) as rank from own),
             rare as (select set_id, item, explode(sequence(0, cast((held - 1) div {split} as int))) as part from ranked where rank <= hot - least + 1),
             met as (select set_id, item, cast(pmod(xxhash64(set_id), (held - 1) div {split} + 1) as int) as part from {hot})
        select distinct least(o.set_id, h.set_id) as a, greatest(o.set_id, h.set_id) as b, cast(0 as bigint) as common
        from rare o join met h on o.item = h.item and o.part = h.part and o.set_id <> h.set_id""",
        hot=hot, sized=sized, share=share, split=SPLIT,
    )
    return spark.sql(
        """
        with pairs as (select a, b, sum(common) as common from (select * from {light} union all select * from {only_hot}) group by a, b),
             able as (select p.a, p.b, p.common, x.size as size_a, y.size as size_b, least(x.hot, y.hot) as hot
                      from pairs p join {sized} x on p.a = x.set_id join {sized} y on p.b = y.set_id
                      where p.common + least(x.hot, y.hot) >= {share} * least(x.size, y.size) - 1e-9),
             more as (select p.a, p.b, sum(bit_count(x.word & y.word)) as common
                      from able p join {words} x on p.a = x.set_id join {words} y on p.b = y.set_id and x.block = y.block
                      where p.hot > 0 group by p.a, p.b),
             done as (select p.a, p.b, p.common + coalesce(q.common, 0) as common, p.size_a, p.size_b
                      from able p left join more q on p.a = q.a and p.b = q.b)
        select a as set_a, b as set_b, common, size_a, size_b from done where common >= {share} * least(size_a, size_b) - 1e-9""",
        light=light, only_hot=only_hot, sized=sent_if_small(sized), words=words, share=share,
    )
