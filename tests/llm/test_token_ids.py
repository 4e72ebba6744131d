"""Ids of whole texts against the tokenizer itself."""

import os
import random
import sys

import numpy as np
import pyarrow as pa
import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"

from quern.llm.packing import TextIds, tokenizer_path  # noqa: E402


@pytest.fixture(scope="module")
def ids():
    return TextIds(tokenizer_path(None))


def same(ids, texts):
    found, at = ids.of_texts(pa.array(texts, pa.string()))
    for text, a, b in zip(texts, at[:-1], at[1:]):
        assert found[a:b].tolist() == ids.tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_every_code_point_between_letters_and_before_final_punctuation(ids):
    assert ids.by_words
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 11 == 0)]
    for k in range(0, len(points), 400):
        part = [chr(c) for c in points[k : k + 400]]
        same(ids, [" ".join(f"a{c}b X{c}. {c}, x.{c} y{c}$ {c}" for c in part), "".join(f"a{c}" for c in part)])


def test_odd_texts(ids):
    texts = [None, "", " ", "\n\t", "İLGİLİ.", "teşekkürler İLGİLİ, x", "ΟΔΟΣ. ΣΑΣ, Σ.", "ÅÉ. é, ́x", "K. ﬁ. ǅ,", "don't DON'T. 'S it's,", "a...b x.. y.,", "<|endoftext|>", "x<|endoftext|>.", "<|ENDOFTEXT|> A.", "1.000,5. No.5,", "a b. c,", "\x1cq.\x85w,", "ῼ.", "가나다. 가,", "ﬀ.", "😀. 😀😀,", "a‍."]
    same(ids, texts)
    rng = random.Random(1)
    same(ids, ["ab$$$", "*x", "a.***", "", "$", "y!", "<b>a<|endoftext|>", "a|>"])
    letters = "aAbZ.,$*'’- \n\tİıσΣςéÉéǆDžͅẞßﬃ中文1२<|>"
    same(ids, ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(3000)])


def test_the_cache_may_be_small(ids):
    small = TextIds(tokenizer_path(None), room=5, at_once=3)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["The", "cat.", "naïve,", "x-y", "cat", "ΟΔΟΣ."]) for _ in range(30)) for _ in range(20)]
    for text in texts:
        same(small, [text])


def test_a_tokenizer_with_other_steps_encodes_whole_texts():
    import public_tokenizers

    other = TextIds(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_words
    same(other, ["The  cat.\n", None, "İLGİLİ, x", "a" * 1000])
    assert other.of_texts(pa.array([], pa.string()))[1].tolist() == [0]


def test_long_texts(ids):
    text = "Word, words. naïve " * 60_000
    found, at = ids.of_texts(pa.array([text]))
    assert np.array_equal(found, np.array(ids.tokenizer.encode(text, add_special_tokens=False).ids))
