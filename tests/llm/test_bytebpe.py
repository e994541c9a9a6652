import base64
import random
from array import array

import public_tokenizers
import pytest
import tiktoken

from scatterlake.llm.bytebpe import ByteBPE, PrefixEncoder, byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    return ByteBPE(open(PATH, "rb").read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    alphabet = ["the", "ing", "tion", "é", "ß", "ñ", "1", "23", " ", " ", "  ", "\n", "\n\n", "\t", "\x1c", "\x85", " ", " ",
                "'s", "'ll", "!!", "%%%", "a", "b", "aaa", "日本", "😀", "́", "_", "²", "Ⅷ", "ǅ", "﻿", "​", "|"]
    yield from ["", " ", "  ", "a  ", "a   b", " a", "\n \n b", "x" * 3000, "a b" * 500, "é" * 700, " " * 300 + "z", "aaaaaaaaaaaa aaaaa"]
    for _ in range(1500):
        yield "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40)))


def test_matches_the_library_and_decodes(coder, library):
    for text in texts():
        ids = coder.encode(text)
        assert list(array("I", ids)) == library.encode_ordinary(text), repr(text)
        assert coder.decode(ids) == text.encode()


def test_append_and_edit_equal_encoding_anew(coder):
    rng = random.Random(5)
    v = coder.vocabulary
    for _ in range(60):
        data = bytes(rng.choice(b"abcdeting onthe\xc3\xa9") for _ in range(rng.randint(0, 200)))
        grown = PrefixEncoder(v)
        for i in range(0, len(data), 7):
            grown.append(data[i : i + 7])
        assert grown.ids() == PrefixEncoder(v, data).ids()
        a = rng.randint(0, len(data))
        b = min(len(data), a + rng.randint(0, 5))
        new = bytes(rng.choice(b"xyz the") for _ in range(rng.randint(0, 6)))
        grown.replace(a, b, new)
        assert grown.ids() == PrefixEncoder(v, data[:a] + new + data[b:]).ids()


def test_an_edit_is_local(coder):
    whole = PrefixEncoder(coder.vocabulary, b"the quick thing " * 400)
    assert whole.replace(20, 22, b"zz") < 2000


def test_nulls_and_extra_columns(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (2, "the same", "y"), (None, "the same", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(byte_bpe(df, PATH, public_tokenizers.PATTERN).collect(), key=str)
    assert len(got) == 4
    n = len(library.encode_ordinary("the same"))
    assert sorted(r["n_tokens"] for r in got) == [0, 0, n, n]
    assert byte_bpe(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
