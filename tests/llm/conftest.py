"""Small documents for the corpus operators."""

from __future__ import annotations

import random

import pytest

SYLLABLES = {"en": "the tion ing er and on at re th es".split(), "de": "sch der und ein keit ung auf zu ß ö".split(), "fr": "le eau oi ment que é è tion aux ou".split()}


@pytest.fixture(scope="session")
def prose():
    def make(rng: random.Random, n_words: int, lang: str = "en") -> str:
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n_words)]
        lines, i = [], 0
        while i < n_words:
            k = rng.randint(3, 25)
            lines.append(" ".join(words[i : i + k]).capitalize() + ".")
            i += k
        return "\n".join(lines)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and blank texts, one word, other scripts, special strings, a very long text, long gaps."""
    return [None, "", " ", "\n", "word", "a  b\n\n\tc ", "日本語 テキスト。", "<|endoftext|> x", "x" * 300_000, "the same word " * 30_000, "!!! ***", "a\x00b", "É é ß", " "]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The odd texts with null ids, langs and sources, repeated rows and columns of clashing names."""
    rows = [(i, t, ["en", None, "de"][i % 3], ["s1", None][i % 2], 1, "x", 0.5) for i, t in enumerate(odd_texts)]
    rows += [(None, "the tion ing and on", "en", "s1", 1, "x", 0.5), rows[4], rows[4]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, size double")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
