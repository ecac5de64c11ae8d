"""The search analyzer as column expressions: split, fold, stop words, suffix stemming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# The stop words of the index. Those with an apostrophe can't match, as words are split there.
STOP_WORDS = """
a about above after again against all am an and any are aren't as at be because been before being below
between both but by can't cannot could couldn't did didn't do does doesn't doing don't down during each few
for from further had hadn't has hasn't have haven't having he he'd he'll he's her here here's hers herself him
himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my
myself no nor not of off on once only or other ought our ours ourselves out over own same shan't she she'd
she'll she's should shouldn't so some such than that that's the their theirs them themselves then there
there's these they they'd they'll they're they've this those through to too under until up very was wasn't we
we'd we'll we're we've were weren't what what's when when's where where's which while who who's whom why why's
with won't would wouldn't you you'd you'll you're you've your yours yourself yourselves
""".split()


def fold(text: Column) -> Column:
    """Lower case of ASCII letters only."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


# The suffix rules, in this order.
def stem(word: Column) -> Column:
    """The first suffix rule that fits; lengths are in bytes."""
    n = F.octet_length(word)
    cut = lambda k: F.substring(word, F.lit(1), F.length(word) - k)
    return (
        F.when(word.endswith("ing") & (n > 5), cut(3))
        .when(word.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(word.endswith("es") & (n > 4), cut(2))
        .when(word.endswith("ed") & (n > 3), cut(2))
        .when(word.endswith("s") & ~word.endswith("ss") & (n > 3), cut(1))
        .otherwise(word)
    )


#: What separates words: anything but letters (with the vowel signs of scripts that have them) and numbers.
SEPARATOR = r"[^\p{IsAlphabetic}\p{N}]+"


def split_words(text: Column) -> Column:
    """The words of a text as one array, folded, with stop words and empty ones."""
    return F.split(fold(F.coalesce(text, F.lit(""))), SEPARATOR)


def index_terms(docs: DataFrame, id_col: str, text_col: str, stemmed: bool = True) -> DataFrame:
    """doc_id, term: a row for each index term of each text, with repeats. Words are exploded first, so that the rest is plain columns."""
    words = docs.select(F.col(id_col).alias("doc_id"), F.explode(split_words(F.col(text_col))).alias("word"))
    words = words.where((F.col("word") != "") & ~F.col("word").isin(STOP_WORDS))
    return words.select("doc_id", (stem(F.col("word")) if stemmed else F.col("word")).alias("term"))


def tokens(text: Column, stemmed: bool = True) -> Column:
    """The index terms of a text as one array, in order, with repeats."""
    words = F.filter(split_words(text), lambda w: (w != "") & ~w.isin(STOP_WORDS))
    return F.transform(words, stem) if stemmed else words
