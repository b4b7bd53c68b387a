"""Passages of evaluation texts inside scanned pages.

Texts are folded to letters: case, marks, spaces, hyphens and line ends go, and
letters that scans mix up share a symbol, so broken and joined words don't matter.
Letters outside ASCII that are no accented ones share ten further symbols.
Each task indexes its pages in shards (FM-index) and searches all overlapping
phrases of HALF letters of the items; all their occurrences count, however many.

1. Occurrences of one diagonal merge to spans, the maximal exact matches.
2. Spans of a page and an item are chained in the order of the item, and a chain is
   scored in words: words covered, less words left out between spans and a price for
   each jump on the page.  Stock phrases of long words have many letters but few
   words, so nearly all chance pairs stay below GATE, half of what is asked for.
3. For the pairs left all chains are followed letter by letter along their diagonals.
   A chain whose exact letters alone have enough words is a passage; one that may
   have is aligned letter by letter: a substituted letter or a lost one costs, and a
   jump forward on the page has one price up to REACH letters.  The words of the
   aligned stretch are counted.

Every step looks at one page and one item only, so the result does not depend on
which pages share a shard or on how often a phrase occurs.

A page and an item are reported from ``words`` words on, less SLACK for words
that are damaged beyond recognition at the ends.  Null and empty texts match
nothing; items with fewer words match nothing; rows of an item count as one item
with several contexts, rows of a page count as one page.  Texts above PART
characters are searched in parts that have OVERLAP characters in common.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fmindex import HALF, FmIndex, packed

WORDS = 15
SLACK = 2
#: Letters of a shard, of items that are searched together, and of items that travel with the tasks of one pass.
SHARD = 4_000_000
BLOCK = 4_000_000
PASS = 16_000_000
#: Phrases of items that are placed on pages at a time.
HITS = 2_000_000
#: Characters of the parts of a long text, and characters that two of them have in common.
PART, OVERLAP = 120_000, 40_000
#: Letters of the shortest exact match that counts.  Passages with every 14th letter wrong are still found by their matches.
SHORTEST = 13
#: Longest interruption on the page and in the item, in letters.
REACH, SKIP = 900, 90
#: Words of a chain, less its price, from which a page and an item get a closer look.
GATE = 7.0
#: Words of the chains that are followed then; shorter ones only in spans of PIECE letters.
LEAST = 3.0
#: The same for pieces in different columns together.
PIECES = 8.0
#: Price of a chain in words: for each word left out, a jump on the page, a shift by a few letters, a jump to another column.
_LEFT, _LEAP, _SHIFT, _COLUMN = 0.5, 1.0, 0.3, 2.0
_PRICE = np.array([0.0] + [_SHIFT] * HALF + [_LEAP], dtype=np.float32)
#: Score of a passage, for each of its words, that pieces have together.
LETTERS = 3.2
#: The same as a share of the letters, where words are short.
SHARE = 0.65
#: Score of a chain as a share of the letters that the words asked for have at its place, and its words as a share of
#: them, which together are enough for an alignment.  Passages have 1.2 and more, 2 without damage.
PLACE = 1.15
#: Letters of a piece that is continued elsewhere on the page, and letters of the item between two such pieces.
PIECE, NEXT = 20, 30
#: Letters of the item after which a chain is cut in two.
LONG = 2000
_MISS, _JUMP, _FAR = 2, 8, 256
_EDGE = 130

# Letters by symbol: those that scans mix up stand together.
_GROUPS = ("a4", "b68", "ce3", "d", "f", "g9", "h", "ijl1|!", "k", "m", "nu", "o0q", "p", "r", "s5", "t7", "v", "w", "x", "y", "z2")


#: Stand-ins of letters that are not Latin, and their symbols.
_OTHER = range(14, 24)


def _tables() -> tuple[bytes, bytes]:
    table = bytearray(256)
    for code, group in enumerate(_GROUPS, 1):
        for c in group + group.upper():
            table[ord(c)] = code
    for code, c in enumerate(_OTHER, len(_GROUPS) + 1):
        table[c] = code
    return bytes(table), bytes(b for b in range(256) if not table[b])


_TABLE, _DROPPED = _tables()


def fold(text: str) -> bytes:
    """Symbols 1..31 of a text's letters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.casefold())
        for c in set(text):
            if c > "\x7f" and c.isalpha():
                text = text.replace(c, chr(_OTHER[ord(c) % len(_OTHER)]))
    return text.encode("ascii", "ignore").translate(_TABLE, _DROPPED)


class Items:
    """Folded contexts with the place of each word, and their different phrases.

    ``flat`` has all contexts one after the other with a letter between them that is on no page;
    ``word`` is the number of words up to each letter, with fractions inside of words.
    """

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = np.array([i for i, _ in rows], dtype=np.int64)
        self.letters, self.words, flat, word = [], [], [np.full(1, 255, np.uint8)], [np.zeros(1)]
        for _, context in rows:
            parts = [w for w in map(fold, (context or "").split()) if w]
            self.letters.append(np.frombuffer(b"".join(parts), np.uint8))
            size = np.array([len(p) for p in parts], dtype=np.int64)
            ends = np.cumsum(size)
            self.words.append((ends - size, ends))
            flat += [self.letters[-1], np.full(1, 255, np.uint8)]
            inside = np.arange(int(size.sum())) - np.repeat(ends - size, size)
            word += [np.repeat(np.arange(len(size)), size) + inside / np.repeat(size, size), np.full(1, float(len(size)))]
        self.flat, self.word = np.concatenate(flat), np.concatenate(word).astype(np.float32)
        self.sizes = sizes = np.array([len(x) for x in self.letters], dtype=np.int64)
        self.starts = (np.cumsum(sizes + 1) - sizes).astype(np.int32)
        self._runs: dict[int, list[np.ndarray]] = {}
        self.longest = max((len(b) for b, _ in self.words), default=0) + 1
        owner = np.repeat(np.arange(len(rows)), np.maximum(0, sizes - HALF + 1))
        begins = np.cumsum(np.maximum(0, sizes - HALF + 1))
        offset = np.arange(len(owner)) - np.repeat(np.r_[0, begins[:-1]] if len(begins) else begins, np.maximum(0, sizes - HALF + 1))
        at = self.starts[owner] + offset
        keys = packed(np.where(self.flat == 255, 0, self.flat))[at]
        order = np.argsort(keys, kind="stable")
        new = np.r_[True, keys[order][1:] != keys[order][:-1]] if len(order) else np.empty(0, bool)
        first = at[order[new]]
        self.phrases = self.flat[first[:, None] + np.arange(HALF)] if len(at) else np.empty((0, HALF), np.uint8)
        # places of the phrases, those of one phrase together
        self.kind_start = np.r_[np.flatnonzero(new), len(order)]
        self.place, self.owner = at[order].astype(np.int32), owner[order].astype(np.int32)
        self.before = self.flat[self.place - 1]

    def least(self, words: int) -> np.ndarray:
        """Score that the pieces of a passage of ``words`` words have at least, by item: LETTERS a word, or SHARE of the item's shortest run of words."""
        many = words + SLACK
        run = [(e[many - 1 :] - b[: len(b) - many + 1]).min() if len(b) >= many else np.inf for b, e in self.words]
        return np.minimum(SHARE * np.array(run, dtype=float), LETTERS * words)

    def runs(self, words: int) -> list[np.ndarray]:
        """By item, for each word: the fewest letters of ``words`` words in a row that it is one of."""
        if words in self._runs:
            return self._runs[words]
        out = self._runs[words] = []
        for b, e in self.words:
            run = np.full(len(b) + words - 1, np.iinfo(np.int64).max)
            if len(b) >= words:
                run[words - 1 : len(b)] = e[words - 1 :] - b[: len(b) - words + 1]
            out.append(np.lib.stride_tricks.sliding_window_view(run, words).min(1) if len(b) else run[:0])
        return out


def _length(letters: np.ndarray, page: np.ndarray, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Letters that are the same from each place on, HALF at least; both texts end with letters of their own."""
    length = np.full(len(page), HALF, dtype=np.int32)
    open_, step = np.arange(len(page)), 0
    while len(open_):
        wide = 1 if step < 12 else 64
        step += 1
        if wide == 1:
            open_ = open_[letters[page[open_] + length[open_]] == flat[at[open_] + length[open_]]]
            length[open_] += 1
            continue
        more = []
        for lo in range(0, len(open_), 1 << 15):
            part, k = open_[lo : lo + (1 << 15)], np.arange(wide)
            x, y = (page[part] + length[part])[:, None] + k, (at[part] + length[part])[:, None] + k
            same = letters[np.minimum(x, len(letters) - 1)] == flat[np.minimum(y, len(flat) - 1)]
            run = np.where(same.all(1), wide, same.argmin(1))
            length[part] += run
            more.append(part[run == wide])
        open_ = np.concatenate(more)
    return length


def spans(index: FmIndex, items: Items, letters: np.ndarray, docs: np.ndarray):
    """(doc, item row, page letter, item letter, length): maximal exact matches, in blocks of documents.

    ``docs`` has the first letter of each document in the shard.  A block has about HITS phrases of items, or one document.
    """
    which, position = index.locate(*index.search(items.phrases))
    kinds = np.full(index.n, -1, dtype=np.int32)
    kinds[position] = which
    position = np.flatnonzero(kinds >= 0).astype(np.int32)
    kind = kinds[position]
    times = items.kind_start[kind + 1] - items.kind_start[kind]
    doc = (np.searchsorted(docs, position, side="right") - 1).astype(np.int32)
    ends = np.cumsum(times)
    lo = 0
    while lo < len(kind):
        hi = int(np.searchsorted(ends, ends[lo] - times[lo] + HITS, side="right"))
        if hi < len(kind):
            hi = int(np.searchsorted(doc, doc[hi]))
            if hi <= lo:
                hi = int(np.searchsorted(doc, doc[lo], side="right"))
        yield _matches(items, letters, docs, kind[lo:hi], position[lo:hi], doc[lo:hi], times[lo:hi])
        lo = hi


def _matches(items: Items, letters: np.ndarray, docs: np.ndarray, kind, position, doc, times):
    many = np.cumsum(times)
    nth = np.arange(many[-1], dtype=np.int32)
    nth += np.repeat((items.kind_start[kind] - (many - times)).astype(np.int32), times)
    # a match begins where the letters before differ
    begins = np.repeat(letters[position - 1], times) != items.before[nth]
    nth = nth[begins]
    source = np.repeat(np.arange(len(kind), dtype=np.int32), times)[begins]
    page, at, item = position[source], items.place[nth], items.owner[nth]
    length = _length(letters, page, items.flat, at)
    long = np.flatnonzero(length >= SHORTEST)
    source, item, page, at, length = (x[long] for x in (source, item, page, at, length))
    return doc[source], item, page, at - items.starts[item], length


def likely(doc, item, page, offset, length, items: Items):
    """The spans of the pages and items that have a chain of at least GATE words, sorted by page, item and page letter."""
    code = doc.astype(np.int64) * len(items.ids) + item
    at = items.starts[item] + offset
    first, last = items.word[at], items.word[at + length]
    low = code.min() if len(code) else 0
    if len(code) and code.max() - low < 1 << 23:
        pays = np.bincount(code - low, last - first) >= GATE
        kept = np.flatnonzero(pays[code - low])
    else:
        _, group = np.unique(code, return_inverse=True)
        kept = np.flatnonzero((np.bincount(group, last - first) >= GATE)[group])
    bits = int(offset.max()).bit_length() if len(offset) else 0
    kept = kept[np.argsort((code[kept] - low) << bits | offset[kept])]
    if not len(kept):
        return tuple(x[kept] for x in (doc, item, page, offset, length))
    doc, item, page, offset, length, code, first, last = (x[kept] for x in (doc, item, page, offset, length, code, first, last))
    # a chain takes each word of the item once, however often the page has it
    new = np.r_[True, code[1:] != code[:-1]]
    group = np.cumsum(new, dtype=np.int32) - 1
    before = np.maximum.accumulate(last + group * np.float64(items.longest)) - group * np.float64(items.longest)
    before = np.where(new, 0.0, np.r_[0.0, before[:-1]])
    once = np.maximum(0.0, last - np.maximum(first, before))
    start = np.flatnonzero(new)
    may = np.flatnonzero((np.add.reduceat(once, start) >= GATE - 1e-3)[group])
    doc, item, page, offset, length, code, first, last = (x[may] for x in (doc, item, page, offset, length, code, first, last))
    if not len(may):
        return doc, item, page, offset, length
    group = np.cumsum(np.r_[False, code[1:] != code[:-1]], dtype=np.int32)
    end, words = offset + length, last - first
    far = int(end.max()) + 1
    furthest = (np.maximum.accumulate(end + group * np.int64(far)) - group * np.int64(far)).astype(np.int32)
    links, a = [], np.arange(len(code), dtype=np.int32)
    for lag in range(1, len(code)):
        a = a[: np.searchsorted(a, len(code) - lag)]
        b = a + lag
        near = np.flatnonzero((group[a] == group[b]) & (offset[b] - furthest[a] <= SKIP))
        a, b = a[near], b[near]
        if not len(a):
            break
        gap, on = offset[b] - end[a], page[b] - page[a]
        shift = on - (offset[b] - offset[a])
        forward = (shift >= -25) & (on <= REACH + length[a])
        ok = np.flatnonzero((offset[b] > offset[a]) & (gap <= np.where(forward, np.int32(SKIP), np.int32(NEXT))) & (end[b] > end[a]))
        x, y, forward, shift = a[ok], b[ok], forward[ok], np.abs(shift[ok])
        apart = first[y] - last[x]
        price = np.where(forward, _PRICE[np.minimum(shift, HALF + 1)], np.float32(_COLUMN))
        links.append((x, y, np.minimum(apart, -_LEFT * apart) - price))
    x, y, value = (np.concatenate(k) for k in zip(*links)) if links else (a[:0], a[:0], words[:0])
    score = _reached(words, x, y, value + words[y])
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    good = (np.maximum.reduceat(score, start) >= GATE)[group]
    # spans that no chain of some words goes through are left out
    inner = np.flatnonzero(good[x])
    x, y, value = x[inner], y[inner], value[inner]
    through = score + _reached(np.where(good, words, 0), y, x, value + words[x]) - words
    kept = np.flatnonzero(good & ((through >= LEAST) | (length >= PIECE)))
    kept = kept[np.lexsort((page[kept], group[kept]))]
    return tuple(x[kept] for x in (doc, item, page, offset, length))


def _reached(alone: np.ndarray, x: np.ndarray, y: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Best sum that a path along the links x -> y collects up to each place, which has ``alone`` by itself."""
    score = alone.copy()
    changed, now = np.zeros(len(score), dtype=bool), np.arange(len(x))
    while True:
        reached = score[x[now]] + value[now]
        better = reached > score[y[now]] + 1e-4
        if not better.any():
            return score
        np.maximum.at(score, y[now[better]], reached[better])
        changed[:] = False
        changed[y[now[better]]] = True
        now = np.flatnonzero(changed[x])


def _gathered(blocks, many: int = 200_000):
    """Blocks of spans of the same kind, put together up to about ``many`` spans."""
    waiting, size = [], 0
    for block in blocks:
        waiting.append(block)
        size += len(block[0])
        if size >= many:
            yield tuple(np.concatenate(x) for x in zip(*waiting))
            waiting, size = [], 0
    if waiting:
        yield tuple(np.concatenate(x) for x in zip(*waiting))


def _links(doc, item, page, offset, length):
    """Pairs of spans (from, to) of a page and an item that may follow each other in a passage, and letters they share in the item."""
    group = np.cumsum(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
    longest = int(length.max())
    out, a = [], np.arange(len(doc) - 1)
    for lag in range(1, len(doc)):
        a = a[a + lag < len(doc)]
        b = a + lag
        near = (group[a] == group[b]) & (page[b] - page[a] <= REACH + longest)
        a, b = a[near], b[near]
        if not len(a):
            break
        dp, do = page[b] - page[a], offset[b] - offset[a]
        over = np.maximum(0, length[a] - do)
        ok = (do > 0) & (length[b] - over > 3) & (do - length[a] <= SKIP) & (dp - do >= -25) & (dp <= REACH + length[a])
        out.append((a[ok], b[ok], over[ok]))
    if not out:
        return (np.empty(0, np.int64),) * 3
    a, b, over = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((a, b))
    return a[order], b[order], over[order]


def _along(letters: np.ndarray, page: np.ndarray, flat: np.ndarray, item: np.ndarray, width: np.ndarray, step: int) -> np.ndarray:
    """+1 or -1 for each of the next letters on a diagonal, forward or back, far less from the end of the page on, 0 from ``width`` on."""
    k = np.arange(int(width.max()) if len(width) else 0)
    at = page[:, None] + step * k
    got = np.where((at >= 0) & (at < len(letters)), letters[np.clip(at, 0, len(letters) - 1)], 0)
    same = got == flat[np.clip(item[:, None] + step * k, 0, len(flat) - 1)]
    value = np.where(same, 1, -1)
    value[np.logical_or.accumulate(got == 0, axis=1)] = -64
    return np.where(k < width[:, None], value, 0).astype(np.int16)


def _beyond(letters, page, items: Items, item, offset, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Most that the letters before or behind a place add on its diagonal, where a wrong one costs one, and how many letters that takes."""
    room = offset + 1 if step < 0 else items.sizes[item] - offset
    at = items.starts[item] + offset
    out, far = np.zeros(len(page), np.int64), np.zeros(len(page), np.int64)
    for lo in range(0, len(page), 1 << 14):
        part = slice(lo, lo + (1 << 14))
        v = _along(letters, page[part], items.flat, at[part], np.minimum(room[part], 64), step)
        if v.size:
            v = np.cumsum(v, 1, dtype=np.int16)
            best = v.argmax(1)
            gain = v[np.arange(len(v)), best]
            out[part], far[part] = np.maximum(0, gain), np.where(gain > 0, best + 1, 0)
    return out, far


def _between(letters, items: Items, item, page0, offset0, page1, offset1) -> np.ndarray:
    """What two spans gain or lose between their ends: the letters on the one diagonal up to some place, on the other from there on."""
    gap = np.maximum(0, offset1 - offset0)
    shift = np.abs((page1 - page0) - (offset1 - offset0))
    out = -np.minimum(_JUMP, 2 * shift)
    at = items.starts[item]
    wide = np.flatnonzero(gap)
    for lo in range(0, len(wide), 1 << 14):
        w = wide[lo : lo + (1 << 14)]
        a = np.cumsum(_along(letters, page0[w], items.flat, at[w] + offset0[w], gap[w], 1), 1, dtype=np.int16)
        b = np.cumsum(_along(letters, page1[w] - 1, items.flat, at[w] + offset1[w] - 1, gap[w], -1), 1, dtype=np.int16)
        a, b = (np.pad(x, ((0, 0), (1, 0))) for x in (a, b))
        k = np.arange(a.shape[1])
        rest = np.take_along_axis(b, np.maximum(0, gap[w][:, None] - k), 1)
        out[w] += np.where(k <= gap[w][:, None], a + rest, -SKIP).max(1)
    return out


def _words(items: Items, row: int, chain: list[tuple[int, int, int]]) -> float:
    """Words of the exact letters of a chain, less the price of its links."""
    word, start = items.word, int(items.starts[row])
    total, before = 0.0, None
    for p, o, n in chain:
        first, last = word[start + o], word[start + o + n]
        if before:
            shift = abs((p - before[0]) - (o - before[1]))
            apart = first - before[2]
            total += (-_LEFT * apart if apart > 0 else apart) - (_LEAP if shift > HALF else _SHIFT * (shift > 0))
        total += last - first
        before = (p, o, last)
    return total


def chains(doc, item, page, offset, length, items: Items, letters: np.ndarray, words: int):
    """(doc, item, stretches) of each passage that a page and an item may have in common.

    A stretch is (page from, to, item from, to, exact letters, score, words less their price,
    page from, to with the letters that go on along the diagonal).

    All chains are followed, not only the best: stock phrases that an item shares with
    a long page often have more exact letters than the passage.  A chain counts with
    the letters between its spans and at its ends, compared along their diagonals.
    The first stretch is the chain.  A passage that goes on in the next column of a
    page that was read line by line across its columns continues anywhere on the page,
    also further up; so the chains before and after in the item follow, where they are
    close to the first there.
    """
    out = []
    if not len(doc):
        return out
    a, b, over = _links(doc, item, page, offset, length)
    # a span that begins within the one before counts from there on
    value = _between(letters, items, item[a], page[a] + length[a], offset[a] + length[a], page[b] + over, offset[b] + over) - over
    # a link that costs more than the span on one side of it brings is better left out
    pays = value > -np.minimum(length[a], length[b]) - 8
    a, b, value = a[pays], b[pays], value[pays]
    ahead, on = _beyond(letters, page + length, items, item, offset + length, 1)
    behind, back = _beyond(letters, page - 1, items, item, offset - 1, -1)
    p, o, n = page.tolist(), offset.tolist(), length.tolist()
    # for each span the best that leads to it and the best that follows
    score, gain = (behind + length).tolist(), ahead.tolist()
    before, after = [-1] * len(p), [-1] * len(p)
    links = list(zip(a.tolist(), b.tolist(), value.tolist()))
    for x, y, v in links:
        if score[x] + v + n[y] >= score[y]:
            score[y], before[y] = score[x] + v + n[y], x
    for x, y, v in reversed(links):
        if v + n[y] + gain[y] >= gain[x]:
            gain[x], after[x] = v + n[y] + gain[y], y
    least, runs = items.least(words), items.runs(words)
    whole = np.array(score) + np.array(gain)
    may = np.flatnonzero(whole >= PIECE)
    used = set()
    by_group: dict[tuple[int, int], list] = {}
    for k in may[np.argsort(-whole[may], kind="stable")].tolist():
        if k in used:
            continue
        chain, x = [k], before[k]
        while x >= 0:
            chain.append(x)
            x = before[x]
        chain.reverse()
        x = after[k]
        while x >= 0:
            chain.append(x)
            x = after[x]
        used.update(chain)
        start = 0
        for stop in range(1, len(chain) + 1):
            if stop < len(chain) and o[chain[stop]] + n[chain[stop]] - o[chain[start]] <= LONG:
                continue
            part, start = chain[start:stop], stop
            c, d = part[0], part[-1]
            exact = n[c] + sum(min(n[j], o[j] + n[j] - o[i] - n[i]) for i, j in zip(part, part[1:]))
            ends = p[c] - int(back[c]), p[d] + n[d] + int(on[d])
            total = int(whole[k]) if len(part) == len(chain) else exact
            row = int(item[k])
            net = _words(items, row, [(p[j], o[j], n[j]) for j in part])
            stretch = (p[c], p[d] + n[d], o[c], o[d] + n[d], min(exact, o[d] + n[d] - o[c]), total, net, *ends)
            by_group.setdefault((int(doc[k]), row), []).append(stretch)
    for (page_, row), found in by_group.items():
        last, seen = items.words[row][1], set()
        solid = [y for y in found if y[4] >= PIECE and y[5] >= max(PIECE, 0.46 * (y[3] - y[2]))]
        for x in found:
            o0, o1 = x[2], x[3]
            more = []
            if len(solid) > 1 and x[4] >= PIECE and x[5] >= max(PIECE, 0.46 * (o1 - o0)):
                more = [y for y in solid if y is not x and (y[3] <= o0 + 6 and o0 - y[3] <= NEXT or y[2] >= o1 - 6 and y[2] - o1 <= NEXT)]
            # short pieces from all over a long page add up, so only the best chain is taken with one on each side, others in pairs
            sides = [[y for y in more if y[3] <= o0 + 6], [y for y in more if y[2] >= o1 - 6]]
            both = [[x, *(max(z, key=lambda y: y[4]) for z in sides if z)]] if x is found[0] else []
            middle = min(int(np.searchsorted(last, (o0 + o1) // 2, side="right")), len(last) - 1)
            ways = [[x]] if x[5] / runs[row][middle] + x[6] / words >= PLACE else []
            ways += [w for w in both + [[x, y] for y in more] if len(w) > 1 and sum(y[6] - _COLUMN for y in w[1:]) + x[6] >= PIECES and all(x[k] + max(y[k] for y in w[1:]) >= least[row] for k in (4, 5))]
            for way in ways:
                same = frozenset(way)
                if same not in seen or len(way) == 1:
                    out.append((page_, row, way))
                seen.add(same)
    return out


def _slide(row: np.ndarray, spare: tuple[np.ndarray, np.ndarray], width: int) -> np.ndarray:
    """Greatest of the last ``width`` values in each row, in one of two spare arrays; width is a power of two."""
    from_, step = row, 1
    for k in range(width.bit_length() - 1):
        to = spare[k % 2]
        np.maximum(from_[:, step:], from_[:, :-step], out=to[:, step:])
        to[:, :step] = from_[:, :step]
        from_, step = to, step * 2
    return from_


def align(items: list[np.ndarray], pages: list[np.ndarray], where: bool = True):
    """(score, from, to) of the best local alignment of each item stretch on its page stretch.

    All pairs go through the rows of one dynamic programme together.  A cell packs
    its score and where its alignment began in the item (stretches below 4096).
    Without ``where`` only the scores are found, in small integers.
    """
    many, n, m = len(items), max(map(len, items)), max(map(len, pages))
    kind, k = (np.int32, 4096) if where else (np.int16, 1)
    text = np.zeros((many, m), dtype=np.uint8)
    asked = np.full((many, n), 255, dtype=np.uint8)
    for r, (a, b) in enumerate(zip(items, pages)):
        asked[r, : len(a)] = a
        text[r, : len(b)] = b
    begin = lambda i: kind(k - 1 - i if where else 0)
    row = np.full((many, max(m + 1, _FAR)), begin(0), dtype=kind)
    m = row.shape[1] - 1
    text = np.pad(text, ((0, 0), (0, m - text.shape[1])))
    spare, new, plus, same = (np.empty_like(row), np.empty_like(row)), np.empty_like(row), np.empty_like(row[:, 1:]), np.empty(text.shape, bool)
    best, at = np.zeros(many, kind), np.zeros(many, np.int32)
    # a wrong letter costs as much as a lost one, so both start from the row less this
    less, jump, hit = kind(_MISS * k), kind((_JUMP + _MISS) * k), kind((1 + _MISS) * k)
    for i in range(1, n + 1):
        from_ = _slide(row, spare, _FAR)
        np.subtract(row, less, out=new)
        from_ -= jump
        np.maximum(from_, new, out=from_)
        np.equal(text, asked[:, i - 1 : i], out=same)
        np.multiply(same, hit, out=plus)
        plus += from_[:, :-1]
        new[:, 0] = begin(i)
        np.maximum(new[:, 1:], plus, out=new[:, 1:])
        np.subtract(new[:, :-1], less, out=plus)
        np.maximum(new[:, 1:], plus, out=new[:, 1:])
        np.maximum(new, begin(i), out=new)
        row, new = new, row
        top = row.max(1)
        better = top // k > best // k
        best[better], at[better] = top[better], i
    return (best // k, k - 1 - best % k, at) if where else best


def _parts(pairs: list[tuple], block: int):
    """Pairs of about the same size together, so that little is padded and a part stays in the cache."""
    pairs = sorted(pairs, key=lambda x: (x[5] - x[4] >> 5, x[3] - x[2]))
    lo = 0
    while lo < len(pairs):
        hi, wide = lo + 1, pairs[lo][3] - pairs[lo][2]
        while hi < len(pairs) and (hi + 1 - lo) * max(wide, pairs[hi][3] - pairs[hi][2]) < block:
            wide = max(wide, pairs[hi][3] - pairs[hi][2])
            hi += 1
        yield pairs[lo:hi]
        lo = hi


def enough(score: int, length: int) -> bool:
    """Whether an aligned stretch is a printed passage, not two phrases that meet by chance."""
    return score >= 0.58 * length or (score >= 60 and score >= 0.45 * length)


def verify(found, items: Items, letters: np.ndarray, docs: np.ndarray, ends: np.ndarray, words: int, block: int = 1 << 16):
    """Pairs with at least ``words`` aligned words: (doc, item, words, [(page from, to)])."""

    def count(item: int, parts) -> int:
        first, last = items.words[item]
        inside = sum(np.maximum(0, np.minimum(b, last) - np.maximum(a, first)) for a, b in parts)
        return int((inside >= 0.6 * (last - first)).sum())

    def job(doc, item, stretch, others=()):
        """Page and item letters around a stretch; in the item not beyond where another one begins."""
        p0, p1, o0, o1, *_, q0, q1 = stretch
        low = max([0, o0 - _EDGE, *(x[3] for x in others if x[3] <= o0 + 6)])
        high = min([len(items.letters[item]), o1 + _EDGE, *(x[2] for x in others if x[2] >= o1 - 6)])
        low, high = min(low, o0), max(high, o1)
        # the page around as far as the letters that are left of the item may reach
        before, behind = (min(400, 3 * k + 60) if k else 0 for k in (o0 - low, high - o1))
        return (doc, item, max(docs[doc], p0 - before), min(ends[doc], p1 + behind), low, high, q0, q1)

    sure, waiting, pieces = [], [], []
    taken: dict[tuple[int, int], list] = {}
    # the chains of a page and item come best first; one within a passage that is found adds nothing
    within = lambda at, q0, q1: any(a <= q0 and q1 <= b for a, b in taken.get(at, ()))
    for doc, item, (best, *more) in found:
        _, _, o0, o1, exact, value, net, q0, q1 = best
        if more:
            if 2 * count(item, [(x[2], x[3]) for x in (best, *more)]) + 6 >= words:
                pieces.append((doc, item, (best, *more)))
        elif not within((doc, item), q0, q1):
            many = count(item, [(o0, o1)])
            if min(many, net) >= words and max(exact, value) >= 0.75 * (o1 - o0):
                # as many words as are asked for, by the exact letters alone and jumps set against them
                sure.append((doc, item, many, [(q0, q1)]))
                taken.setdefault((doc, item), []).append((q0, q1))
            elif 2 * many + 6 >= words and o1 - o0 + 2 * _EDGE < 4096:
                waiting.append((job(doc, item, best), o0, o1))
    stretch = lambda part: ([items.letters[x[1]][x[4] : x[5]] for x in part], [letters[x[2] : x[3]] for x in part])
    shortest = [r.min() if len(r) else np.inf for r in items.runs(words)]
    placed = {}

    def place(jobs):
        for part in _parts(sorted(set(jobs) - placed.keys()), block):
            for x, s, a, b in zip(part, *(r.tolist() for r in align(*stretch(part)))):
                placed[x] = (s, a + x[4], b + x[4])

    while waiting:
        # of chains that overlap in page and item the best is aligned first
        now, later, held = [], [], {}
        for x in waiting:
            one, o0, o1 = x
            q0, q1 = one[6:]
            if within(one[:2], q0, q1):
                continue
            others = held.setdefault(one[:2], [])
            if any(a < q1 and q0 < b and c < o1 and o0 < d for a, b, c, d in others):
                later.append(x)
            else:
                others.append((q0, q1, o0, o1))
                now.append(one)
        able = []
        for part in _parts(now, 2 * block):
            able += [x for x, s in zip(part, align(*stretch(part), where=False).tolist()) if enough(s, shortest[x[1]])]
        place(able)
        for x in able:
            s, a, b = placed[x]
            many = count(x[1], [(a, b)])
            if many >= words and enough(s, b - a):
                sure.append((x[0], x[1], many, [x[6:]]))
                taken.setdefault(x[:2], []).append(x[6:])
        waiting = later
    settled = {x[:2] for x in sure}
    asked = []
    for doc, item, way in pieces:
        if (doc, item) in settled:
            # the passage goes on here: its stretches are taken out too
            sure.append((doc, item, 0, [x[7:] for x in way]))
        else:
            asked.append([job(doc, item, x, [y for y in way if y is not x]) for x in way])
    # the first piece has to be solid by itself; only then the others are aligned
    is_solid = lambda x: placed[x][0] >= PIECE and placed[x][0] >= 0.58 * (placed[x][2] - placed[x][1])
    place(way[0] for way in asked)
    asked = [way for way in asked if is_solid(way[0])]
    place(x for way in asked for x in way)
    for part in asked:
        solid = [x for x in part if is_solid(x)]
        good = sorted(placed[x][1:] for x in solid)
        joined = [list(good[0])] if good else []
        for a, b in good[1:]:
            if a - joined[-1][1] <= NEXT:
                joined[-1] = [joined[-1][0], max(b, joined[-1][1])]
            else:
                joined.append([a, b])
        # pieces may meet by chance, so together they have to reach further
        many = max((count(part[0][1], [x for x in good if j[0] <= x[0] < j[1]]) for j in joined), default=0)
        if many >= words + SLACK:
            sure.append((part[0][0], part[0][1], many, [x[6:] for x in solid]))
    return sure


def letter_places(text: str) -> np.ndarray:
    """Position in the text of each folded letter."""
    if text.isascii():
        return np.flatnonzero(np.frombuffer(text.encode().translate(_TABLE), np.uint8))
    counts = {c: len(fold(c)) for c in set(text)}
    return np.repeat(np.arange(len(text)), [counts[c] for c in text])


def search_shard(texts: list[str | None], blocks: Iterable[Items], words: int):
    """(text number, item id, words, [{start, stop}]) of one shard; start and stop are characters of the text."""
    folded = [fold(t) if t else b"" for t in texts]
    sizes = np.array([len(f) + 1 for f in folded], dtype=np.int64)
    docs = np.cumsum(sizes) - sizes
    letters = np.frombuffer(b"\0".join([*folded, b""]), np.uint8)
    if len(letters) <= HALF:
        return
    index = FmIndex(letters)
    for items in blocks:
        found = [x for block in _gathered(likely(*block, items) for block in spans(index, items, letters, docs)) for x in chains(*block, items, letters, words)]
        best: dict[tuple[int, int], int] = {}
        placed: dict[tuple[int, int], list] = {}
        for doc, item, many, stretches in verify(found, items, letters, docs, docs + sizes - 1, words):
            at = (doc, int(items.ids[item]))
            best[at] = max(best.get(at, 0), many)
            placed.setdefault(at, []).extend(stretches)
        where: dict[int, np.ndarray] = {}
        for (doc, item), many in best.items():
            if doc not in where:
                where[doc] = letter_places(texts[doc])
            # letters that go on along a diagonal may be those of the page before or behind
            place, base, end = where[doc], int(docs[doc]), int(sizes[doc]) - 1
            parts_ = sorted((max(0, a - base), min(end, b - base)) for a, b in placed[doc, item])
            cut = [{"start": int(place[a]), "stop": int(place[b - 1]) + 1} for a, b in parts_]
            yield doc, item, many, cut


def leaks(docs: DataFrame, items: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, words, spans), one row per case: items of (item_id, context) with at least ``words`` words in a row on a page.

    ``spans`` are the stretches of the page that hold the passage, [{start, stop}] in
    characters.  The items travel with the tasks, at most PASS characters of context at once: a shard is
    indexed once and searched for them in blocks of BLOCK; more items take more passes over the pages, not more memory.
    """
    size = items.selectExpr("sum(length(context))").first()[0] or 0
    passes = max(1, -(-size // PASS))
    once = items.select("item_id", "context").where("item_id is not null and context is not null").distinct()
    out = None
    for k in range(passes):
        rows = sorted((r[0], r[1]) for r in once.where(f"pmod(xxhash64(item_id), {passes}) = {k}").collect())
        one = _one_pass(docs, rows, words, key, text)
        out = one if out is None else out.union(one)
    return out.groupBy(key, "item_id").agg(
        F.max("words").alias("words"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans")
    )


def removal_spans(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, stop): the spans of all items on a page, those that overlap or touch merged."""
    s = found.select(F.col(key), F.explode("spans").alias("s")).select(key, "s.start", "s.stop")
    order = Window.partitionBy(key).orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("__new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    s = s.withColumn("__n", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(key, "__n").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("__n")


def parts(text: str):
    """(start, text) of the whole text, or of parts of at most PART characters that overlap."""
    overlap = min(OVERLAP, SHARD // 2)
    size = min(PART, SHARD)
    if len(text) <= size:
        return [(0, text)]
    return [(at, text[at : at + size]) for at in range(0, len(text) - overlap, size - overlap)]


def item_blocks(rows: list[tuple[int, str]]) -> list[list[tuple[int, str]]]:
    """The rows in blocks of about BLOCK characters."""
    out, size = [[]], 0
    for row in rows:
        if out[-1] and size + len(row[1]) > BLOCK:
            out.append([])
            size = 0
        out[-1].append(row)
        size += len(row[1])
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _one_pass(docs: DataFrame, rows, words: int, key: str, text: str) -> DataFrame:
    from pyspark.sql import types as T

    need = max(1, words - SLACK)
    kind = docs.schema[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = item_blocks(rows)
        # several blocks are made anew for each shard, as all at once would take too much memory
        one = [Items(split[0])] if len(split) == 1 else None

        def shard(keys, texts, starts):
            found = list(search_shard(texts, one or map(Items, split), need))
            if found:
                doc, item, many, cut = zip(*found)
                cut = [[{k: v + starts[d] for k, v in one.items()} for one in c] for d, c in zip(doc, cut)]
                columns = [pa.concat_arrays(keys).take(pa.array(doc)), pa.array(item, pa.int64()), pa.array(many, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cut, _SPANS)], [key, "item_id", "words", "spans"])

        keys, texts, starts, size = [], [], [], 0
        for batch in batches:
            for k, t in enumerate(batch.column(1).to_pylist()):
                for start, part in parts(t or ""):
                    keys.append(batch.column(0).slice(k, 1))
                    texts.append(part)
                    starts.append(start)
                    size += len(part) + 1
                    if size >= SHARD:
                        yield from shard(keys, texts, starts)
                        keys, texts, starts, size = [], [], [], 0
        if texts:
            yield from shard(keys, texts, starts)

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
    more = [T.StructField("item_id", T.LongType()), T.StructField("words", T.LongType()), T.StructField("spans", T.ArrayType(span))]
    schema = T.StructType([kind, *more])
    return docs.where(f"`{text}` is not null").select(key, text).mapInArrow(run, schema)
