"""Byte-level BPE against the tiktoken library, and the round trip."""

import hashlib
import random

import pytest
import tiktoken

from cairn.llm import bpe
from cairn.llm.queries import tokenizer

VOCABULARY, PATTERN = tokenizer()


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(VOCABULARY), special_tokens={})


def texts():
    rng = random.Random(3)
    out = [None, "", " ", "\n\n  x  \t", "don't <|endoftext|> we'll", "naïve café ñandú über straße", "日本語 текст 🙂🙂", "a" * 2500, "ab" * 900]
    out += ["".join(rng.choice("abcde ") for _ in range(400)) for _ in range(20)]
    out += ["".join(rng.choice("abcdeé") for _ in range(1500)), "word " * 20_000, " x y\x0b\x00z"]
    return out


def test_against_library(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(texts())] + [(None, "no id", "c"), (1, "again", "c"), (1, "again", "c")]
    df = bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), VOCABULARY, PATTERN)
    got = sorted((r.doc_id if r.doc_id is not None else -1, list(r.ids), bytes(r.decoded)) for r in df.collect())
    want = sorted((i if i is not None else -1, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows)
    assert got == want
    first = bpe.digests(df).filter("doc_id = 5").first()
    ids = library.encode_ordinary(rows[5][1])
    assert (first.n_tokens, first.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert first.decoded_sha256 == hashlib.sha256(rows[5][1].encode()).hexdigest()
    assert bpe.digests(df).filter("doc_id = 0").first().ids_sha256 == hashlib.sha256(b"").hexdigest()


def long_words():
    rng = random.Random(5)
    return ["a" * 100_000, "ab" * 3000, "aab" * 2000 + "a" * 333, "=" * 5001, "".join(rng.choice("etaoinshrdlu") for _ in range(20_000)), "".join(rng.choice("абвгдежз") for _ in range(3000))]


def test_long_words(library):
    words = long_words()
    coder = bpe.Coder(bpe.read_ranks(VOCABULARY))
    counts, ids = coder.encode([w.encode() for w in ["short", *words, "", " one"]])
    want = [library.encode_ordinary(w) for w in ["short", *words, "", " one"]]
    assert counts.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]


def test_both_queries_agree_at_every_length(library):
    rng = random.Random(6)
    words = ["".join(rng.choice("abes tn") for _ in range(n)).encode() for n in range(1, 65) for _ in range(5)]
    coder = bpe.Coder(bpe.read_ranks(VOCABULARY))
    by = [[x.tolist() for x in coder._encode(words, q)] for q in (bpe._SHORT, bpe._LONG)]
    assert by[0] == by[1]


def test_rules_and_their_order():
    single = {bytes([i]): i for i in range(256)}
    rules = bpe.merge_rules(single | {b"ab": 256, b"abc": 257, b"bc": 258, b"xyz": 259})
    assert rules.to_pylist() == [{"l": 97, "r": 98, "t": 256}, {"l": 256, "r": 99, "t": 257}, {"l": 98, "r": 99, "t": 258}]  # xyz never comes to be
    with pytest.raises(ValueError):
        bpe.merge_rules(single | {b"abc": 256, b"ab": 257})


def test_memory_of_words_is_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 40)
    known, rng = bpe.Words(bpe.Coder(bpe.read_ranks(VOCABULARY))), random.Random(7)
    for _ in range(20):
        texts = [[rng.choice([" the", " cat", " sat", f" w{rng.randrange(10**6)}"]) for _ in range(30)] for _ in range(2)] + [[]]
        counts, ids = known.ids_of(texts)
        want = [library.encode_ordinary("".join(x)) for x in texts]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
        assert len(known) <= 40 + 60
    assert " the" in known


def test_decode(spark):
    rows = [(1, [1, 0, 300]), (2, []), (3, None), (None, [None, 5, 10**9]), (1, [1, 0, 300])]
    got = bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), VOCABULARY).collect()
    by_rank = {r: t for t, r in bpe.read_ranks(VOCABULARY).items()}
    want = [(i, b"".join(by_rank.get(k, b"") for k in ids or [])) for i, ids in rows]
    assert sorted(((r.doc_id, bytes(r.decoded)) for r in got), key=str) == sorted(want, key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(bpe.encode_decode(df, VOCABULARY, PATTERN)).count() == 0
