import random

import numpy as np
from pyspark.sql import functions as F

from orbspan.llm import leaks
from orbspan.llm.fmindex import DEPTH, FmIndex

SYLLABLES = "ba co du fe gi ho ka li mu ne po qui ra so tu ve wy za bri cle dro fla gre pla sto tri".split()


def vocabulary(seed, many):
    rng = random.Random(seed)
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(2, 4))) + rng.choice(["r", "n", "ck", "l", "st"]) for _ in range(many)]


NOUNS, VERBS, KINDS = vocabulary(1, 300), vocabulary(2, 100), vocabulary(3, 150)


def prose(rng, words):
    out = []
    while len(out) < words:
        out += ["the", rng.choice(KINDS), rng.choice(NOUNS), rng.choice(VERBS), "every", rng.choice(KINDS), rng.choice(NOUNS)]
    return out[:words]


def damage(rng, words):
    out = []
    for w in words:
        if rng.random() < 0.08:
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + rng.choice("ecolint") + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + " " + w[k:], w[:k] + "-\n" + w[k:]])
        out.append(w.upper() if rng.random() < 0.05 else w)
    return out


def lines(words, wide=6):
    return [" ".join(words[k : k + wide]) for k in range(0, len(words), wide)]


def test_index_counts_and_places_every_phrase():
    rng = np.random.default_rng(0)
    letters = np.concatenate([rng.integers(1, 4, 900), [0], np.tile([1, 2, 3], 60), [0]]).astype(np.uint8)
    index, text = FmIndex(letters), letters.tobytes()
    for k in (1, 5, 12, DEPTH):
        phrases = np.stack([letters[s : s + k] for s in [*range(0, 800, 37), *range(910, 1000, 7)]] + [np.full(k, 9, np.uint8)])
        low, high = index.search(phrases)
        who, at = index.locate(low, high)
        for q, p in enumerate(phrases):
            want = [s for s in range(len(text) - k + 1) if text[s : s + k] == p.tobytes()]
            assert sorted(at[who == q].tolist()) == want
    low, high = index.search(letters[None, 12:24])
    assert [x.tolist() for x in index.search(letters[None, :12], low, high)] == [x.tolist() for x in index.search(letters[None, :24])]
    assert FmIndex(np.zeros(0, np.uint8)).search(np.ones((1, 3), np.uint8))[1].tolist() == [0]


def corpus(seed=3):
    rng = random.Random(seed)
    items = [(k, " ".join(prose(rng, 60))) for k in range(12)]
    pages, truth = [], set()
    for d in range(120):
        body = prose(rng, 120)
        kind, item = d % 6, d % 12
        part = items[item][1].split()
        at = rng.randrange(0, 35)
        if kind == 0:  # a damaged part
            body[40:40] = part[at : at + 22]
            text = "\r\n".join(lines(damage(rng, body)))
            truth.add((d, item))
        elif kind == 1:  # one of two columns, run together
            a, b = lines(damage(rng, prose(rng, 20) + part + prose(rng, 20))), lines(damage(rng, body[:100]))
            text = "\n".join(f"{x}   | {y}" for x, y in zip(a, b))
            truth.add((d, item))
        elif kind == 2:  # an advert inside, and a replaced word
            body[30:30] = part[at : at + 12] + ["TRY", "OUR", "SOAP.", "9d.", "per", "tin", "of", "all", "grocers"] + part[at + 12 : at + 16] + ["zebra"] + part[at + 17 : at + 25]
            text = "\n".join(lines(body))
            truth.add((d, item))
        elif kind == 4:  # from the foot of the left column to the head of the right one, read line by line
            left, right = lines(prose(rng, 66) + part[at : at + 12]), lines(part[at + 12 : at + 24] + prose(rng, 66))
            text = "\n".join(x for pair in zip(left, right) for x in pair)
            truth.add((d, item))
        elif kind == 3:  # too little
            body[30:30] = part[at : at + 6]
            text = "\n".join(lines(body))
        else:
            text = "\n".join(lines(damage(rng, body)))
        pages.append((d, text))
    return items, pages, truth


def test_planted_passages_are_found(spark, monkeypatch):
    items, pages, truth = corpus()
    extra = [(1000, None), (1001, ""), (1002, " \n"), (1003, "short"), (1004, pages[0][1]), (1004, pages[0][1]), (1005, "x " * 50_000 + pages[0][1])]
    d = spark.createDataFrame([(k, t, 1) for k, t in pages + extra], "doc_id bigint, text string, item_id int").repartition(3, "doc_id")
    i = spark.createDataFrame([(k, c, c) for k, c in items + items[:2]] + [(None, "x", None), (99, None, None), (98, "few words", None)], "item_id bigint, context string, text string")
    want = truth | {(1004, 0), (1005, 0)}
    for shard in (leaks.SHARD, 9000):
        monkeypatch.setattr(leaks, "SHARD", shard)
        got = leaks.leaks(d, i)
        assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    assert got.where("doc_id = 1004").count() == 1
    monkeypatch.setattr(leaks, "SHARD", 20_000)
    monkeypatch.setattr(leaks, "OVERLAP", 2_000)
    long = spark.createDataFrame([(k, "\n".join(pages[j][1] for j in range(3 + k, 103 + k))) for k in range(3)], "doc_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in leaks.leaks(long, i).collect()}
    assert {x for x in found if x[1] % 6 != 4} == {(k, x) for k in range(3) for x in range(12) if x % 6 in (0, 1, 2)}
    monkeypatch.setattr(leaks, "BLOCK", 2000)
    assert {(r["doc_id"], r["item_id"]) for r in leaks.leaks(d, i).collect()} == want
    monkeypatch.setattr(leaks, "PASS", 3000)
    assert {(r["doc_id"], r["item_id"]) for r in leaks.leaks(d, i).collect()} == want
    assert leaks.leaks(d.limit(0), i).count() == 0 and leaks.leaks(d, i.limit(0)).count() == 0


def test_spans_hold_the_passage_and_merge(spark):
    items, pages, truth = corpus()
    d = spark.createDataFrame([(k, "ſé — " + t) for k, t in pages], "doc_id bigint, text string")
    found = leaks.leaks(d, spark.createDataFrame(items, "item_id bigint, context string"))
    texts = dict(pages)
    for r in found.collect():
        assert r["spans"] and (r["doc_id"], r["item_id"]) in truth
        item = leaks.fold(dict(items)[r["item_id"]])
        for s in r["spans"]:
            held = leaks.fold(("ſé — " + texts[r["doc_id"]])[s["start"] : s["stop"]])
            # a damaged end belongs to the passage: most of its letters are the item's, in place
            for end in (held[:16], held[-16:]):
                assert max(sum(x == y for x, y in zip(end, item[k:])) for k in range(len(item))) >= 9
    rows = [(1, [(0, 5), (3, 9)]), (1, [(20, 30), (9, 10)]), (2, [(4, 6)])]
    d = spark.createDataFrame(rows, "doc_id bigint, spans array<struct<start:bigint,stop:bigint>>")
    assert sorted(map(tuple, leaks.removal_spans(d).collect())) == [(1, 0, 10), (1, 20, 30), (2, 4, 6)]


def test_many_copies_of_a_page_are_all_reported(spark):
    items, pages, _ = corpus()
    d = spark.createDataFrame([(k, pages[0][1]) for k in range(700)], "doc_id bigint, text string").coalesce(1)
    assert leaks.leaks(d, spark.createDataFrame(items, "item_id bigint, context string")).where("item_id = 0").count() == 700


def test_alignment_against_plain_programme():
    rng = np.random.default_rng(2)

    def plain(a, b):
        row, best = [0] * (len(b) + 1), 0
        for x in a:
            new = [0] * (len(b) + 1)
            for j in range(1, len(b) + 1):
                from_ = max(row[j - 1], max(row[max(0, j - 256) : j]) - 8)
                new[j] = max(0, from_ + (1 if b[j - 1] == x else -2), row[j] - 2)
            # one skipped page letter at a time, from the values before skipping
            new = [max(v, new[j - 1] - 2) if j else v for j, v in enumerate(new)]
            row, best = new, max(best, *new)
        return best

    pairs = []
    for _ in range(8):
        a = rng.integers(1, 5, rng.integers(5, 60)).astype(np.uint8)
        b = np.concatenate([rng.integers(1, 5, 30), a[:20], rng.integers(1, 5, 15), a[20:]]).astype(np.uint8)
        pairs.append((a, b))
    want = [plain(a.tolist(), b.tolist()) for a, b in pairs]
    assert leaks.align(*map(list, zip(*pairs)))[0].tolist() == want == leaks.align(*map(list, zip(*pairs)), where=False).tolist()


def search(items, pages):
    return {(d, i): cut for d, i, _, cut in leaks.search_shard(pages, [leaks.Items(items)], leaks.WORDS - leaks.SLACK)}


def test_passage_beside_stock_phrases_with_more_letters():
    rng = random.Random(11)
    item = prose(rng, 150)
    body = prose(rng, 1500)
    for k in range(6):  # each a chance phrase of the item, in its order, with other words between
        body[20 + 8 * k : 20 + 8 * k] = item[8 * k : 8 * k + 3]
    body[1200:1200] = item[120:136]
    assert (0, 5) in search([(5, " ".join(item))], [" ".join(body)])


def every(letters, step, other="x"):
    """A letter after every ``step - 1`` replaced."""
    return "".join(other if k % step == step - 1 and c != " " else c for k, c in enumerate(letters))


def test_a_damaged_passage_is_found_however_often_it_is_printed():
    rng = random.Random(21)
    items = [(k, " ".join(prose(rng, 70))) for k in range(3)]
    part = every(" ".join(items[1][1].split()[20:42]), 17)
    for many in (1, 25, 100):
        pages = [" ".join(prose(rng, 60)) + " " + part + " " + " ".join(prose(rng, 60)) for _ in range(many)]
        assert set(search(items, pages)) == {(d, 1) for d in range(many)}


def test_result_does_not_depend_on_shards(spark, monkeypatch):
    items, pages, truth = corpus(5)
    d = spark.createDataFrame(pages * 3, "doc_id bigint, text string").withColumn("doc_id", F.monotonically_increasing_id())
    i = spark.createDataFrame(items, "item_id bigint, context string")
    found = []
    for shard, parts in ((leaks.SHARD, 1), (leaks.SHARD, 7), (3000, 2)):
        monkeypatch.setattr(leaks, "SHARD", shard)
        found.append(sorted(map(str, leaks.leaks(d.repartition(parts, "doc_id"), i).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) >= 3 * len(truth)


def test_spans_stay_on_their_page():
    rng = random.Random(31)
    item = prose(rng, 60)
    # the passage goes on at the head of the next page, where one letter is lost for the end of the page
    cut, rest = " ".join(item[:30]), " ".join(item[30:])
    pages = [cut, rest[1:]] * 3
    found = search([(1, " ".join(item))], pages)
    assert {d for d, _ in found} == set(range(6))
    assert all(0 <= s["start"] < s["stop"] <= len(pages[d]) for (d, _), spans in found.items() for s in spans)


def test_pages_without_links_and_with_repeats():
    rng = random.Random(33)
    item = " ".join(prose(rng, 40))
    assert set(search([(1, item)], [item])) == {(0, 1)} and search([(1, item)], ["", None, "x"]) == {}
    # where a diagonal ends does not hang on the pages around
    again = "aaaa bbbb " * 40
    pages = [item, again, "bbbb " + again, item, again]
    alone = {(d, i): spans for d, p in enumerate(pages) for (_, i), spans in search([(1, item), (2, again)], [p]).items()}
    assert search([(1, item), (2, again)], pages) == alone and len(alone) == 5


def test_long_items_and_other_alphabets():
    rng = random.Random(8)
    long = " ".join(prose(rng, 2400))
    greek = "ο μύλος του χωριού άλεσε όλο το σιτάρι πριν από τη γιορτή και ο γέρος μυλωνάς έφυγε αργά το βράδυ για την πόλη"
    pages = [every(long, 23), " ".join(prose(rng, 40)) + greek.upper() + " ".join(prose(rng, 40)), " ".join(prose(rng, 300))]
    assert set(search([(1, long), (2, greek)], pages)) == {(0, 1), (1, 2)}


def test_damaged_passage_of_frequent_phrases():
    rng = random.Random(12)
    item = prose(rng, 40)
    # a wrong letter after every 15: no 24 letters in a row are right
    letters = list("".join(item[10:26]))
    letters[15::16] = "x" * len(letters[15::16])
    pages = [" ".join(item)] * 60 + [" ".join(prose(rng, 80)) + " " + "".join(letters) + " " + " ".join(prose(rng, 80))]
    assert (60, 3) in search([(3, " ".join(item))], pages)
