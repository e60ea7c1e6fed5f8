import random

import public_tokenizers as p
import pytest
import sentencepiece
from cases import docs

from tracewell.llm import piece_counts as c

MODEL = p.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_like_the_library(spark, library):
    rng = random.Random(5)
    letters = "abtheriong  ▁\n\t\r'.,|</s>0é日本​\x00😀　ﬁ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 3000, "ab" * 2000, "</s><s><unk><0x0A>", "the " * 20_000, " " * 5000, "日" * 2000 + "\n" * 500, "x.y,z" * 3000]
    df = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    for r in c.count_tokens(df, MODEL).collect():
        want = len(library.encode(texts[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want, len(texts[r.doc_id].encode()), want > 4096), texts[r.doc_id][:80]


def test_cases(spark, library):
    df = docs(spark)
    texts = [(r.doc_id, len(library.encode(r.text or ""))) for r in df.collect()]
    out = c.count_tokens(df, MODEL)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((r.doc_id or -1, r.n_tokens) for r in out.collect()) == sorted((i or -1, n) for i, n in texts)
    assert c.count_tokens(df.limit(0), MODEL).count() == 0


def test_parts_are_cut_only_where_no_piece_reaches():
    plain = c.PieceCounter({"a": 9, SP + "a": 0, "a.": 1, "b": 8}) if (SP := c.SPACE) else None
    assert plain.parts(f"{SP}ab.{SP}a\n") == [f"{SP}ab.", f"{SP}a", "\n"]
    assert c.PieceCounter({"a": 1, "b": 0}).parts(f"{SP}ab.{SP}a\n") == [f"{SP}ab", ".", f"{SP}a", "\n"]
    assert c.PieceCounter({"a" + SP: 0}).parts(f"{SP}a{SP}a") == [f"{SP}a{SP}a"]


def test_memory_is_bounded_and_forgetting_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(c, "KEEP", 50)
    counter = c.read_model(MODEL)
    rng = random.Random(1)
    for _ in range(300):
        text = " ".join("".join(rng.choice("abcdehrt") for _ in range(rng.randint(1, 9))) for _ in range(20))
        assert counter.text(text) == len(library.encode(text)) and len(counter) <= 50 and len(counter.older) <= 50


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as model

    proto = model.ModelProto()
    with open(MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError):
        c.read_model(str(tmp_path / "m.model"))
