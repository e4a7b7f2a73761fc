import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from weft.llm.bpe import Codec, encode_documents, model_bytes, read_ranks, token_digests
from weft.llm.pretokens import pieces

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(PATH)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_rank_library_on_odd_texts(ranks, reference):
    own, r = Codec(ranks, P.PATTERN), random.Random(2)
    letters = " \n\t\r\x0b\x1c\x85\xa0 　'sabté.É1²漢🙂#́﻿"
    for _ in range(20_000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 14)))
        ids = own.encode(text)
        assert ids == reference.encode_ordinary(text) and own.decode(ids) == text.encode()


def test_cache_that_overflows_changes_nothing(ranks, reference):
    own, r = Codec(ranks, P.PATTERN), random.Random(3)
    own.encoder.most = 5
    for _ in range(50):
        text = " ".join("".join(r.choice("abcdé") for _ in range(r.randint(1, 6))) for _ in range(30))
        assert own.encode(text) == reference.encode_ordinary(text)


def test_pieces_cover_the_text():
    for text in ("a b\nc", " a", "a \nb", "", "\n", "a  b"):
        assert "".join(pieces(text)) == text
    assert pieces("a   b") is None and pieces("a \n b") is None and pieces("a \n") is None
    assert pieces("".join(map(chr, range(0xE000, 0xE010)))) is None


def test_bad_vocabularies():
    with pytest.raises(ValueError):
        model_bytes({b"a": 0, b"b": 2})
    with pytest.raises(ValueError):
        model_bytes({b"a": 0})


def test_rows(spark, ranks, reference):
    rows = [(1, None, 7), (2, "", 7), (None, "null id", 7), (3, "twice", 7), (3, "twice", 7), (4, "long " * 50_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    out = token_digests(df, PATH, P.PATTERN).collect()
    want = []
    for doc_id, text, _ in rows:
        ids = reference.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)
    full = encode_documents(df, PATH, P.PATTERN).where("doc_id = 3").collect()
    assert [list(r["ids"]) for r in full] == [reference.encode_ordinary("twice")] * 2 and bytes(full[0]["decoded"]) == b"twice"
    assert token_digests(df.limit(0), PATH, P.PATTERN).count() == 0


def test_a_generated_model_of_bytes_and_one_merge():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256}
    own = Codec(ranks, P.PATTERN)
    assert own.encode("abab a") == [256, 256, 32, 97] and base64.b64encode(own.decode([256, 32])) == b"YWIg"
