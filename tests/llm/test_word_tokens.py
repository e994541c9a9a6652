import random
from array import array

import public_tokenizers
from tokenizers import Tokenizer, pre_tokenizers

from scatterlake.llm.packing import WordCache, WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def equal(coder, library, texts):
    for text, ids in zip(texts, coder.encode_all(texts), strict=True):
        assert list(array("I", ids)) == library.encode(text, add_special_tokens=False).ids, repr(text)


class Counted:
    """A tokenizer that counts the texts that go through all of it."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **how):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **how)


def test_latin_words_go_to_the_model_alone():
    library, coder, rng = Tokenizer.from_file(PATH), WordTokenizer(PATH), random.Random(7)
    coder.tokenizer = Counted(coder.tokenizer)
    parts = ["word", "Straße", "ÉTÉ", "Āłž", "ſŉŀ", "'s", "'LL", "'", "\"'", "***", "(", "2024", "7", "_", "-", "<", "|>", "don't", "http://a.b/c?d=1"]
    texts = [" ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(20)).replace("<|", "<") for _ in range(400)]
    equal(coder, library, texts)
    assert coder.tokenizer.texts == 0
    equal(coder, library, ["日本 a", "a\x1cb", "µ ª x²"])
    assert coder.tokenizer.texts > 0


def test_special_tokens_are_found_before_texts_are_lower_cased():
    library, coder = Tokenizer.from_file(PATH), WordTokenizer(PATH)
    equal(coder, library, ["A <|ENDOFTEXT|> B", "a<|endoftext|>B <|StartOfText|>", "<| x", "<|endoftext|>", "The <|endoftext |> End"])


def test_a_tokenizer_with_other_rules_is_used_whole(tmp_path):
    other = Tokenizer.from_file(PATH)
    other.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    other.save(str(tmp_path / "other.json"))
    texts = ["Word's (two) 2024, don't", "<|endoftext|> ÉTÉ***"]
    equal(WordTokenizer(str(tmp_path / "other.json")), other, texts)
    other.add_special_tokens(["[end]"])
    other.save(str(tmp_path / "other.json"))
    equal(WordTokenizer(str(tmp_path / "other.json")), other, [*texts, "a [END] b [end] c"])


def test_a_word_that_is_asked_again_stays_in_the_cache():
    asked = []
    cache = WordCache(lambda word: asked.append(word) or word.encode(), 2)
    for word in "abcabc":
        assert cache[word] == word.encode()
    cache.turn()
    assert len(cache) == 0 and cache["a"] == b"a" and asked == ["a", "b", "c"]
    for word in "def":
        assert cache[word] == word.encode()
    cache.turn()
    assert cache["a"] == b"a" and cache["b"] == b"b" and asked == ["a", "b", "c", "d", "e", "f", "b"]
