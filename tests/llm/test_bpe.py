import json
import os

import numpy as np
import pytest

from orbspan.llm import bpe

PATH = "/opt/tokenizers/byte_bpe_50k.json"
TEXTS = [
    None, "", " ", "a", "don't we'll 'S it's", "<|endoftext|> is ordinary <|endoftext|>", "x" * 255, "y" * 256, "z" * 257, "ab" * 700 + "\n\n\n  c",
    "aaaa" * 300, "日本語 テキスト" * 30, "\r\n\t  é́ ſ ﬁ ¬ ■ 12345 3/4", "\x00\x01", "word  two   three \n", "The weath-\ner wàs fair. " * 400, "naïve", "🙂🙃" * 9,
]


def tiny(tmp_path):
    """A vocabulary of bytes and four merges; pieces that overlap and meet."""
    letters = bpe.byte_letters()
    merges = ["a a", "aa a", "a b", "aa ab"]
    tokens = letters + [m.replace(" ", "") for m in merges]
    path = tmp_path / "v.json"
    path.write_text(json.dumps({"model": {"vocab": {t: k for k, t in enumerate(tokens)}, "merges": merges}}))
    return str(path)


def brute(piece: bytes, byte_ids, pairs, merged):
    rank = {tuple(p): k for k, p in enumerate(pairs.tolist())}
    ids = [int(byte_ids[b]) for b in piece]
    while len(ids) > 1:
        best = min((rank.get((a, b), 1 << 60), k) for k, (a, b) in enumerate(zip(ids, ids[1:])))
        if best[0] == 1 << 60:
            break
        ids[best[1] : best[1] + 2] = [int(merged[best[0]])]
    return ids


def test_merges_against_brute_force(tmp_path):
    tables = bpe.load(tiny(tmp_path))
    e = bpe.Encoder(*tables)
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("aab"), n)) for n in [*range(1, 40), 255, 256, 257, 700, 3000] for _ in range(5)]
    ids, offsets = e.encode(words)
    for k, w in enumerate(words):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == brute(w.encode(), *tables), w


def test_forgetting_changes_nothing(tmp_path, monkeypatch):
    e = bpe.Encoder(*bpe.load(tiny(tmp_path)))
    first = e.encode(["ab aab", "b"])
    monkeypatch.setattr(bpe, "REMEMBERED", 0)
    for got, want in zip(e.encode(["ab aab", "b"]), first):
        assert got.tolist() == want.tolist()


@pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file")
def test_ids_equal_the_public_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    d = spark.createDataFrame([(k, x, "clash") for k, x in enumerate(TEXTS)], "doc_id bigint, text string, ids string").repartition(3)
    for block in (1, 1 << 23):
        got = {r["doc_id"]: r["ids"] for r in bpe.encode_texts(d, PATH, block=block).collect()}
        for k, x in enumerate(TEXTS):
            assert got[k] == t.encode(x or "", add_special_tokens=False).ids, repr(x)[:60]
    vocab = {v: k for k, v in t.get_vocab().items()}
    back = {c: b for b, c in enumerate(bpe.byte_letters())}
    for k, x in enumerate(TEXTS):
        assert bytes(back[c] for i in got[k] for c in vocab[i]).decode() == (x or "")
    assert bpe.encode_texts(d.limit(0), PATH).count() == 0
