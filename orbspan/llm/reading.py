"""Reading grade of scanned English pages.

All models are fitted on the graded passages; nothing is a list of words or phrases.

- Lines: letter trigrams of the passages, broken into lines and damaged as scans are,
  give each line of a page a score, less the score that passages have on average and
  in standard deviations of a line of its length.  Headings and adverts (capitals,
  prices, names without sentences) lie FAR below and are left out.
- Language: the mean score of a page's trigrams of small letters.  A page is English
  above BORDER of the way from damaged passages down to passages with shuffled letters.
- Grade: a sentence is classified by a regularised softmax over its words, their letter
  trigrams and its length; the weights of a word and its trigrams are summed once
  per different word, so a page costs a lookup a word.  Sentences are words between
  full stops; pages with columns run together keep the number of words per stop.
  A page's grade is the mean of its sentences' log probabilities, weighted by their
  words, after a calibration of each grade's offset on damaged copies of held-out
  passages.

Words broken at line ends are joined; tokens without letters don't count.  A page is
graded if it has at least LEAST words and is English.  Null, empty and short texts
get no row.

The model is fitted on the driver on at most MOST_SAMPLES passages (the first by
id); the corpus is never sampled.  A sentence is kept as its words, and a step of the
fit takes at most STEP sentences, so the fit takes about 0.5 GB at MOST_SAMPLES.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LEAST = 50
#: Damaged letters in the copies that the model is fitted and calibrated on.
RATE = 0.02
MOST_SAMPLES = 20_000
#: Sentences of a step of the fit.
STEP = 1 << 14
GRADES = 4
TRIGRAMS = 1024
_LENGTHS = (0, 4, 6, 8, 10, 13, 16, 20, 25, 31, 38, 46, 60)
#: Standard deviations below the passages from which a line is no text of an article; share of the way to shuffled letters that is no English.
FAR, BORDER = -4.0, 0.22

_BREAK = re.compile(r"(?<=\w)[-¬\xad=~]\s*\n\s*(?=[a-z])")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?]")
_GAP = re.compile(r"[ \t|]{2,}")
_STOPS = frozenset(".!?")

_SMALL = "abcdefghijklmnopqrstuvwxyz"
_SYMBOLS = 37
_SPACE, _OTHER, _END = 28, 35, 36


def _symbol_table() -> bytes:
    """Small letters, one symbol for capitals, one for digits, space, some marks, all else, line end."""
    table = bytearray([_OTHER] * 256)
    for k, group in enumerate([*_SMALL, _SMALL.upper(), "0123456789", " \t", ".", ",", ";", "-", "'", "!"]):
        for c in group:
            table[ord(c)] = k
    table[ord("\n")] = _END
    return bytes(table)


_TABLE = _symbol_table()


class Lines:
    """Letter trigrams of passages: which lines are text like theirs, which pages are in their language."""

    def __init__(self, passages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.score = self._count(passages[1::2] or passages, rng)
        held = passages[::2]
        worn = [_lines(_worn(t, RATE, rng), int(rng.integers(24, 60))) for t in held]
        total, size = self.lines([x for page in worn for x in page])
        many = np.maximum(1, size)
        self.mean = float(total.sum() / max(1, size.sum()))
        self.deviation = float(np.std((total / many - self.mean) * np.sqrt(many))) if len(total) else 1.0
        english = np.mean([self.page("\n".join(x)) for x in worn]) if worn else 0.0
        shuffled = np.mean([self.page("".join(rng.permutation(list(t)))) for t in held if t]) if worn else 0.0
        self.border = float(english + BORDER * (shuffled - english))

    def _count(self, passages: list[str], rng) -> np.ndarray:
        """Log probability of each trigram given its first two symbols, smoothed by shorter ones."""
        k = _SYMBOLS
        three = np.zeros(k**3)
        for t in passages:
            for text in (t, _worn(t, RATE, rng)):
                three += np.bincount(self._trigrams("\n" + "\n".join(_lines(text, int(rng.integers(24, 60)))) + "\n"), minlength=k**3)
        three = three.reshape(k, k, k)
        two = three.sum(0)
        one = (two.sum(0) + 0.5) / (two.sum() + 0.5 * k)
        two = (two + 2 * one) / (two.sum(1, keepdims=True) + 2)
        three = (three + 2 * two) / (three.sum(2, keepdims=True) + 2)
        return np.log(three).reshape(-1).astype(np.float32)

    @staticmethod
    def _trigrams(text: str) -> np.ndarray:
        c = np.frombuffer(text.encode("ascii", "replace").translate(_TABLE), np.uint8).astype(np.int32)
        return (c[:-2] * _SYMBOLS + c[1:-1]) * _SYMBOLS + c[2:] if len(c) > 2 else np.empty(0, np.int32)

    def lines(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the scores of its trigrams, their number) for each line."""
        if not lines:
            return np.empty(0), np.empty(0, np.int64)
        k = self._trigrams("\n" + "\n".join(lines) + "\n\n")
        size = np.fromiter(map(len, lines), np.int64, len(lines))
        start = np.cumsum(size + 1) - (size + 1)
        return np.add.reduceat(self.score[k], start).astype(np.float64), size

    def page(self, text: str) -> float:
        """Mean score of the trigrams of small letters and spaces."""
        k = self._trigrams(text)
        k = k[_PLAIN[k]]
        return float(self.score[k].mean()) if len(k) else -np.inf

    def articles(self, texts: list[str]) -> list[str | None]:
        """Each text without the lines that are no text of an article, null where it is not English."""
        # the gaps between columns that are run together are no letters
        texts = [_GAP.sub(" ", t.replace("\r", "")) for t in texts]
        pages = [t.split("\n") for t in texts]
        total, size = self.lines([x for page in pages for x in page])
        good = (total - self.mean * size) >= FAR * self.deviation * np.sqrt(size)
        out, at = [], 0
        for text, page in zip(texts, pages):
            keep = good[at : at + len(page)].tolist()
            at += len(page)
            out.append("\n".join(x for x, k in zip(page, keep) if k) if self.page(text) >= self.border else None)
        return out


def _plain() -> np.ndarray:
    one = np.zeros(_SYMBOLS, bool)
    one[: len(_SMALL)] = one[_SPACE] = True
    return (one[:, None, None] & one[:, None] & one).reshape(-1)


_PLAIN = _plain()


def _lines(text: str, wide: int) -> list[str]:
    """The text in lines of about ``wide`` characters."""
    out, now = [], ""
    for w in text.split():
        if now and len(now) + len(w) >= wide:
            out.append(now)
            now = w
        else:
            now = f"{now} {w}" if now else w
    return [*out, now] if now else out


def _worn(text: str, rate: float, rng) -> str:
    """The text with letters replaced, lost and split off."""
    letters = list(text)
    for k in np.flatnonzero(rng.random(len(letters)) < rate).tolist():
        kind = rng.random()
        letters[k] = "eocnitlr~.^"[int(rng.integers(11))] if kind < 0.7 else "" if kind < 0.9 else letters[k] + " "
    return "".join(letters)


def tokens(text: str) -> list[str]:
    """Lower-case words and full stops, words broken at line ends joined."""
    return _TOKEN.findall(_BREAK.sub("", text.replace("\r", "")).lower())


def damaged(words: list[str], rate: float, rng) -> list[str]:
    """Words with letters replaced, lost or split off, as scans do."""
    out = []
    for w in words:
        if w not in _STOPS and rng.random() < rate * len(w):
            k = int(rng.integers(len(w)))
            kind = rng.random()
            if kind < 0.6:
                w = w[:k] + "eocnitlr"[int(rng.integers(8))] + w[k + 1 :]
            elif kind < 0.8:
                w = w[:k] + w[k + 1 :]
            elif 0 < k:
                out.append(w[:k])
                w = w[k:]
        if w:
            out.append(w)
    return out


def copies(pages: list[list[str]], rng) -> list[list[list[str]]]:
    """The pages clean, damaged, and damaged with the columns of two neighbours run together."""
    worn = [damaged(p, RATE, rng) for p in pages]
    mixed = []
    for k, a in enumerate(worn):
        b = worn[k - 1] if k else worn[-1]
        wide = int(rng.integers(3, 9))
        mixed.append([w for at in range(0, max(len(a), len(b)), wide) for w in a[at : at + wide] + b[at : at + wide]])
    return [pages, worn, mixed]


def sentences(words: list[str]) -> list[list[str]]:
    out, now = [], []
    for w in words:
        if w in _STOPS:
            if now:
                out.append(now)
            now = []
        else:
            now.append(w)
    if now:
        out.append(now)
    return out


def _trigrams(word: str) -> np.ndarray:
    w = f"<{word}>"
    return np.array([zlib.crc32(w[k : k + 3].encode()) % TRIGRAMS for k in range(len(w) - 2)], dtype=np.int64)


class Model:
    """Weights by word, trigram and length; ``offset`` is the calibration of the grades."""

    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray, offset: np.ndarray, text: Lines | None = None):
        self.vocabulary, self.weights, self.offset, self.text = vocabulary, weights, offset, text
        self.known: dict[str, int] = {}
        self.vectors = np.zeros((0, GRADES))

    def __getstate__(self):
        return {"vocabulary": self.vocabulary, "weights": self.weights, "offset": self.offset, "text": self.text}

    def __setstate__(self, state):
        self.__init__(**state)

    def columns(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """Columns of a word and their values."""
        grams = _trigrams(word)
        at = self.vocabulary.get(word)
        columns = grams + len(_LENGTHS) + 1
        values = np.full(len(grams), 1.0 / len(grams))
        if at is not None:
            columns, values = np.r_[columns, at + len(_LENGTHS) + 1 + TRIGRAMS], np.r_[values, 1.0]
        return columns, values

    def _learn(self, words: set[str]) -> None:
        if len(self.known) > 400_000:
            self.known, self.vectors = {}, np.zeros((0, GRADES))
        new = sorted(words.difference(self.known))
        if new:
            rows = np.empty((len(new), GRADES))
            for k, w in enumerate(new):
                columns, values = self.columns(w)
                rows[k] = values @ self.weights[columns]
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.vectors = np.concatenate([self.vectors, rows])

    def pages(self, pages: list[list[str]]) -> np.ndarray:
        """(pages, grades) mean log probability, words as weights, before the offset."""
        lists = [sentences(p) for p in pages]
        flat = [w for page in lists for s in page for w in s]
        if not flat:
            return np.zeros((len(pages), GRADES))
        self._learn(set(flat))
        index = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        sizes = np.array([len(s) for page in lists for s in page], dtype=np.int64)
        logits = np.add.reduceat(self.vectors[index], np.cumsum(sizes) - sizes) / np.sqrt(sizes)[:, None]
        logits += self.weights[np.searchsorted(_LENGTHS, sizes, "right") - 1] + self.weights[len(_LENGTHS)]
        logits -= np.logaddexp.reduce(logits, axis=1, keepdims=True)
        owner = np.repeat(np.arange(len(pages)), [len(x) for x in lists])
        out = np.zeros((len(pages), GRADES))
        np.add.at(out, owner, np.maximum(logits, -8.0) * sizes[:, None])
        return out / np.maximum(1, np.bincount(owner, weights=sizes, minlength=len(pages)))[:, None]

    def grades(self, pages: list[list[str]]) -> np.ndarray:
        return (self.pages(pages) + self.offset).argmax(1) + 1


class _Sentences:
    """Sentences as numbers of words; a word's features are held once, whatever the number of sentences."""

    def __init__(self, model: Model, sentences_: list[list[str]], labels: list[int]):
        words = sorted({w for s in sentences_ for w in s})
        number = dict(zip(words, range(len(words))))
        self.words = np.fromiter((number[w] for s in sentences_ for w in s), np.int32)
        self.sizes = np.array([len(s) for s in sentences_], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.labels = np.array(labels, dtype=np.int64)
        self.many, self.width = len(words), len(model.weights)
        parts = [model.columns(w) for w in words]
        self.columns = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int64)
        self.values = np.concatenate([p[1] for p in parts]) if parts else np.empty(0)
        self.owner = np.repeat(np.arange(len(words)), [len(p[0]) for p in parts])
        self.first = np.cumsum([0, *(len(p[0]) for p in parts)])[:-1]

    def gradient(self, w: np.ndarray, part: slice) -> np.ndarray:
        """Gradient of the mean loss of some sentences: length, constant and the mean of the words, scaled by the root of their number."""
        sizes, labels = self.sizes[part], self.labels[part]
        begin = int(self.starts[part][0])
        words = self.words[begin : begin + int(sizes.sum())]
        starts, scale = np.cumsum(sizes) - sizes, 1.0 / np.sqrt(sizes)
        length = np.searchsorted(_LENGTHS, sizes, "right") - 1
        vectors = np.add.reduceat(self.values[:, None] * w[self.columns], self.first)
        z = np.add.reduceat(vectors[words], starts) * scale[:, None] + w[length] + w[len(_LENGTHS)]
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        z[np.arange(len(z)), labels] -= 1.0
        z /= len(z)
        out = np.zeros((self.width, GRADES))
        np.add.at(out, length, z)
        out[len(_LENGTHS)] += z.sum(0)
        each = np.repeat(z * scale[:, None], sizes, axis=0)
        for k in range(GRADES):
            by_word = np.bincount(words, weights=each[:, k], minlength=self.many)
            out[:, k] += np.bincount(self.columns, weights=self.values * by_word[self.owner], minlength=self.width)
        return out


def _softmax_fit(data: _Sentences, penalty: float, steps: int = 120) -> np.ndarray:
    """Multinomial logistic regression with an L2 penalty, by Adam over all sentences, or over STEP of them in turn."""
    w = np.zeros((data.width, GRADES))
    m, v = np.zeros_like(w), np.zeros_like(w)
    blocks = max(1, -(-len(data.labels) // STEP))
    order = [slice(len(data.labels) * k // blocks, len(data.labels) * (k + 1) // blocks) for k in range(blocks)]
    for t in range(1, max(steps, 4 * blocks) + 1):
        if not len(data.labels):
            break
        g = data.gradient(w, order[t % blocks]) + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def fit(samples: list[tuple[str, int]], penalty: float = 1e-4, seed: int = 7) -> Model:
    """Model from (text, grade) passages; each is used clean and damaged."""
    rng = np.random.default_rng(seed)
    known = [(t, g - 1) for t, g in samples if t and g in range(1, GRADES + 1)]
    text = Lines([t for t, _ in known], seed)
    pages = [(tokens(t), g) for t, g in known]
    pages.sort(key=lambda x: x[1])  # so that every fold has every grade
    words = sorted({w for p, _ in pages for w in p if w not in _STOPS})
    counted: dict[str, int] = {}
    for p, _ in pages:
        for w in set(p):
            counted[w] = counted.get(w, 0) + 1
    vocabulary = {w: k for k, w in enumerate(w for w in words if counted[w] > 1)}
    width = len(_LENGTHS) + 1 + TRIGRAMS + len(vocabulary)
    empty = Model(vocabulary, np.zeros((width, GRADES)), np.zeros(GRADES))

    def train(part):
        found, labels = [], []
        for grade in range(GRADES):
            for pages_ in copies([p for p, g in part if g == grade], rng):
                for s in (s for p in pages_ for s in sentences(p)):
                    found.append(s)
                    labels.append(grade)
        order = rng.permutation(len(found))
        return _softmax_fit(_Sentences(empty, [found[k] for k in order], [labels[k] for k in order]), penalty)

    # offsets from passages that the weights have not seen
    folds, held = 2, []
    for k in range(folds):
        model = Model(vocabulary, train([x for n, x in enumerate(pages) if n % folds != k]), np.zeros(GRADES))
        for grade in range(GRADES):
            for pages_ in copies([p for n, (p, g) in enumerate(pages) if n % folds == k and g == grade], rng):
                held.append((model.pages(pages_), np.full(len(pages_), grade)))
    scores, truth = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
    offset = np.zeros(GRADES)
    for _ in range(200):
        z = np.exp(10 * (scores + offset - (scores + offset).max(1, keepdims=True)))
        z /= z.sum(1, keepdims=True)
        offset -= 0.05 * (z.mean(0) - np.bincount(truth, minlength=GRADES) / len(truth))
    return Model(vocabulary, train(pages), offset, text)


def reading_grades(docs: DataFrame, samples: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, grade BIGINT) of the English pages with at least LEAST words."""
    rows = samples.where("text is not null and grade is not null").orderBy("sample_id").limit(MOST_SAMPLES).select("text", "grade").collect()
    model = fit([(r[0], r[1]) for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo in range(0, len(texts), 2000):
                long = [k for k in range(lo, min(len(texts), lo + 2000)) if texts[k] and len(texts[k].split()) >= LEAST]
                articles = model.text.articles([texts[k] for k in long])
                who = [k for k, t in zip(long, articles) if t is not None]
                pages = [tokens(t) for t in articles if t is not None]
                if who:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), pa.array(model.grades(pages), pa.int64())], [key, "grade"])

    schema = T.StructType([docs.schema[key], T.StructField("grade", T.LongType())])
    return docs.where(f"`{text}` is not null").select(key, text).mapInArrow(run, schema)
