"""Every query of the subpackage: against its SQL, or against a plainer rule where there is none."""

import difflib
import os
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest
from test_queries import DATA, compare

from orbspan.llm import leaks, plans

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - {"p8_ids"}))
def test_query(spark, name):
    compare(spark, plans.QUERIES, plans.SQL, name)


def column(table, *names):
    return list(zip(*(pq.read_table(f"{DATA}/{table}.parquet", columns=[n]).column(0).to_pylist() for n in names)))


def longest(context, page):
    """Letters of runs of ten and more that an item and a page have in common, in order."""
    blocks = difflib.SequenceMatcher(None, context, page, autojunk=False).get_matching_blocks()
    return sum(b.size for b in blocks if b.size >= 10)


def test_leaks_are_on_the_page_and_what_holds_much_of_an_item_is_found(spark):
    texts = {k: leaks.fold(t) for k, t in column("documents", "doc_id", "text") if t}
    items = {k: leaks.fold(c) for k, c in column("eval_items", "item_id", "context") if k is not None and c}
    found = {tuple(r) for r in plans.p9_found(spark, DATA).collect()}
    assert found and len(found) == len(set(found))
    for d, i in found:
        assert longest(items[i], texts[d]) >= 45
    # fifteen of the longest words have fewer than 180 letters
    sure = {(d, i) for i, c in items.items() for d, t in texts.items() if any(c[k : k + 180] in t for k in range(0, len(c) - 180, 10))}
    assert sure
    assert sure <= found
    spans = plans.p9_spans(spark, DATA).collect()
    by_page: dict[int, list] = {}
    for r in spans:
        by_page.setdefault(r["doc_id"], []).append((r["start"], r["stop"]))
    whole = dict(column("documents", "doc_id", "text"))
    assert set(by_page) == {d for d, _ in found}
    for d, parts in by_page.items():
        parts.sort()
        assert all(0 <= a < b <= len(whole[d]) for a, b in parts) and all(x[1] < y[0] for x, y in zip(parts, parts[1:]))


def test_grades_are_given_to_english_pages(spark):
    rows = column("documents", "doc_id", "text", "lang")
    got = dict(map(tuple, plans.p10_found(spark, DATA).collect()))
    assert len(got) == plans.p10_found(spark, DATA).count() and set(got.values()) == {1, 2, 3, 4}
    long = {k: (t, lang) for k, t, lang in rows if t and len(t.split()) >= 50}
    assert set(got) <= set(long)
    # a page with many a "the" is English, one with none is not
    often = {k: len(re.findall(r"\bthe\b", t.lower())) / len(t.split()) for k, (t, _) in long.items()}
    assert all((k in got) == (share > 0.05) for k, share in often.items() if share > 0.05 or share < 0.01)
    # harder pages have longer words
    mean = Counter()
    for k, g in got.items():
        words = re.findall(r"[a-z]+", long[k][0].lower())
        mean[g] += sum(map(len, words)) / len(words) / list(got.values()).count(g)
    assert mean[1] < mean[2] < mean[3] < mean[4]
