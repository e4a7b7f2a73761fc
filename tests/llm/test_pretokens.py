import pyarrow as pa
import public_tokenizers as P
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm.pretokens import Encoder, is_word

FIND = regex.compile(P.PATTERN).findall
ODD = st.text(st.sampled_from(list("ab Zé'’st.,!?-_()\"\n\t 0９²ªßʰɐ中́ ​😀Ġ")), max_size=40)


@settings(max_examples=1500, deadline=None)
@given(st.one_of(ODD, st.text(max_size=40)))
def test_same_matches_as_the_pattern(text):
    def mark(pretoken):
        return f"<{pretoken}>".encode()

    encoder = Encoder(FIND, mark, most=8)
    wanted = b"".join(map(mark, FIND(text)))
    assert encoder.encode(text) == wanted and encoder.encode(text) == wanted


def test_words():
    for word in ("a", " ab", "Zé", " ßü"):
        assert is_word(word) and FIND(word) == [word]
    for other in ("", " ", "a.", "a1", "  a", "a b", "ɐ", "中", "a'", "\ta"):
        assert not is_word(other)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.one_of(st.none(), ODD, st.text(max_size=40)), max_size=6), st.integers(0, 3))
def test_columns_give_the_same_matches(texts, skipped):
    def mark(pretoken):
        return f"<{pretoken}>".encode()

    encoder = Encoder(FIND, mark, most=8)
    wanted = [b"".join(map(mark, FIND(t or ""))) for t in texts]
    column = pa.array(texts, pa.string())
    for _ in range(2):
        assert encoder.encode_many(column) == wanted
        assert encoder.encode_many(column.slice(skipped)) == wanted[skipped:]


def test_a_word_is_encoded_once_whatever_signs_follow():
    asked = []

    def mark(pretoken):
        asked.append(pretoken)
        return f"<{pretoken}>".encode()

    texts = ["a word, a word. a word", "word!\nword: été, été", "x  " * 50 + "   y" + "z" * 100, "z" * 100 + "  　 a"]
    encoder = Encoder(FIND, mark)
    for _ in range(2):
        assert encoder.encode_many(pa.array(texts)) == [b"".join(f"<{p}>".encode() for p in FIND(t)) for t in texts]
    assert asked.count(" word") == asked.count("word") == asked.count(" été") == 1
    assert max(map(len, encoder.of_bytes)) <= 64
