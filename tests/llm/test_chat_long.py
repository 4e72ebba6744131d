"""Long texts: their ids are those of the tokenizer on the whole text."""

import random

import numpy as np
import pytest

from quern.llm.chat import Codec, format_turns, read_back


@pytest.fixture(scope="module")
def codec():
    return Codec(None)


def test_long_texts_have_the_tokenizers_ids(codec):
    rng = random.Random(6)
    for text in ("The quick, brown fox's 12 a. naïve  words\n" * 12_000, "ab" * 150_000, "é" * 120_000, "".join(rng.choices("ab '\n.1é", k=300_000))):
        assert len(text) > 100_000 and codec.encode(text) == codec.coder.encode_ordinary(text)


def test_long_white_space(codec):
    spaces = [" ", "\n", "\t ", "  ", "　", " \n", "\x85"]
    for before in ("", "x", "x.", "don'"):
        for space in spaces:
            for after in ("", "y", ".", "1", "'s"):
                for n in (999, 1000, 1001, 3000):
                    text = before + space * n + after + space * 1500 + after
                    assert codec.encode(text) == codec.coder.encode_ordinary(text), (before, space, after, n)
    huge = "x" + " " * 1_000_000 + "\n y"
    assert codec.decode(codec.encode(huge)) == huge


def test_long_conversation(spark):
    import hashlib

    text = "### User: a long </turn> text\\ " * 8_000
    rows = [(1, k, "assistant" if k % 2 else "user", text + str(k)) for k in range(4)]
    (got,) = read_back(format_turns(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))).collect()
    loss = text + "1" + text + "3"
    assert got["n_turns"] == 4 and got["loss_chars"] == len(loss) and got["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
