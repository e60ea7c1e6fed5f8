import random

import public_tokenizers as p
import pytest
import regex
import tiktoken
from cases import docs

from tracewell.llm import bpe_replay as b


@pytest.fixture(scope="module")
def ranks():
    return b.read_ranks(None, p.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_like_the_library(spark, ranks, library):
    rng = random.Random(3)
    letters = "abetherion aaaa  \n\t'séß漢字日本१२ \x1c\x85😀👍🏽01 !?%$"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += ["a" * 3000, "ab" * 1000, "<|endoftext|>", "the " * 5000]
    df = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    both = b.decode(b.encode(df, ranks, p.PATTERN), ranks)
    for r in both.collect():
        want = library.encode_ordinary(texts[r.doc_id])
        assert bytes(r.ids) == packed(want) and r.n_tokens == len(want)
        assert bytes(r.decoded) == texts[r.doc_id].encode()


def test_cases(spark, ranks, library):
    df = docs(spark)
    got = b.encode(df, ranks, p.PATTERN, and_decode=True).collect()
    want = sorted((str(r.doc_id), packed(library.encode_ordinary(r.text or ""))) for r in df.collect())
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == want
    assert all(bytes(r.decoded) in {(x.text or "").encode() for x in df.collect()} for r in got)
    assert b.encode(df.limit(0), ranks, p.PATTERN).count() == 0


def test_merges_out_of_order_are_noticed():
    # "bc" comes before "abc" can be built from "ab"; random vocabularies hit every order.
    rng = random.Random(5)
    for _ in range(60):
        tokens = [bytes([x]) for x in range(256)]
        seen = set(tokens)
        while len(tokens) < 300:
            t = bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5)))
            if t not in seen:
                seen.add(t)
                tokens.append(t)
        merges = b.Merges({t: i for i, t in enumerate(tokens)})
        own = tiktoken.Encoding("x", pat_str=r"[a-z]+", mergeable_ranks=merges.ranks, special_tokens={})
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14))) for _ in range(200)]
        assert merges.replay(words) == [packed(own.encode_ordinary(w.decode())) for w in words]


def test_blocks_do_not_change_the_result(spark, ranks, monkeypatch):
    df = docs(spark, [(i, f"word{i} again and again {i % 7}", "s") for i in range(300)])
    whole = sorted(map(tuple, b.encode(df, ranks, p.PATTERN).collect()))
    monkeypatch.setattr(b, "REPLAY_BYTES", 50)
    monkeypatch.setattr(b, "KEEP_WORDS", 5)
    import pyarrow as pa

    class Shared:
        value = ranks

    batch = pa.RecordBatch.from_pylist([{"doc_id": r.doc_id, "body": r.text} for r in df.collect()])
    got = [tuple(x.values()) for out in b._encoder(Shared, p.PATTERN)([batch]) for x in out.to_pylist()]
    assert sorted(got) == [(i, n, bytes(x)) for i, n, x in whole]
    assert regex.findall(p.PATTERN, "a  b") == ["a", " ", " b"]
