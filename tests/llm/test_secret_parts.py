"""Keys behind names, and allowances for plain words only."""

import random

import pytest

from tempograin.llm import secrets


def entropy(text):
    return [(a, b) for a, k, b in secrets.scan(text) if secrets.KINDS[k] == "entropy"]


@pytest.mark.parametrize("name", ["KEY=", "AWS_KEY=", "my-key_", "x/", ""])
def test_hex_key_behind_a_name(name):
    rnd = random.Random(5)
    for _ in range(300):
        key = "".join(rnd.choice("0123456789ABCDEF") for _ in range(64))
        hit = {i for a, b in entropy(f"é {name}{key}") for i in range(a, b)}
        assert len(hit & set(range(2 + len(name), 66 + len(name)))) >= 24, name + key


def test_letters_are_allowed_only_as_plain_words():
    assert entropy("KEY=qZwXeRtYuIoPaSdFgHjKlMvB") and entropy("qZwXeRtYuIoPaSdFgHjKlMvB")
    for plain in ("some-long-slug-of-plain-words-only", "Some_Long/Path.Of=Plain/WORDS/only", "2024-01-01_and_some_more_words", "123e4567-e89b-12d3-a456-426614174000"):
        assert not entropy(plain), plain


def test_a_whole_base64_key_stays_found():
    assert entropy("KEY=Zq8fT2mXw9L/rB4kVn7+s3JdYpQ1=") and entropy("x Zq8fT2mXw9LrB4kVn7Hs3JdY y")
