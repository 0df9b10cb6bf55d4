"""Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980), applied to a vocabulary.

The rules below are the paper's. Stemming is done once for each distinct term, then joined back, so texts never pass through
Python for it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The suffixes of steps 2, 3 and 4 of the paper.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _form(stem: str) -> str:
    """v for each vowel and c for each consonant; y is a vowel after a consonant."""
    out = ""
    for ch in stem:
        vowel = ch in "aeiou" or ch == "y" and out[-1:] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _form(stem)))


def _ends_cvc(stem: str) -> bool:
    return _form(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _longest(word: str, rules: dict[str, str], least: int) -> str:
    """The rule of the longest suffix that the word has is the only one tried."""
    for n in range(min(7, len(word)), 0, -1):
        if word[-n:] in rules:
            stem = word[:-n]
            return stem + rules[word[-n:]] if _measure(stem) >= least else word
    return word


def porter(word: str) -> str:
    """The stem of a folded word; words of under 3 or over 64 characters stay. What is no vowel counts as a consonant."""
    if not 3 <= len(word) <= 64:
        return word
    for suffix, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + to
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and "v" in _form(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif word[-2:-1] == word[-1:] and _form(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _ends_cvc(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _form(word[:-1]):
        word = word[:-1] + "i"
    word = _longest(_longest(word, STEP_2, 1), STEP_3, 1)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _ends_cvc(word[:-1]):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


#: Words whose stems a task keeps in mind.
KEPT = 200_000


def head(word: str) -> str:
    """The first three letters, of which the rules change no more than y to i, so a word begins as its stem does."""
    return word[:3].replace("y", "i")


def words_of(stems: Iterable[str]) -> Callable[[Collection[str]], dict[str, str]]:
    """A function that tells, of some words, those whose stem is one of these, and the stem. Only words that begin as a stem are
    stemmed, and once as long as they are kept."""
    stems = set(stems)
    heads, told = {head(s) for s in stems}, {}

    def found(words: Collection[str]) -> dict[str, str]:
        if len(told) > KEPT:
            told.clear()
        for w in words:
            if w not in told:
                begin = head(w)
                told[w] = s if (begin in heads or begin[:2] in heads or begin[:1] in heads) and (s := porter(w)) in stems else None
        return {w: s for w in words if (s := told[w]) is not None}

    return found


@F.pandas_udf(T.StringType())
def stem(term: pd.Series) -> pd.Series:
    return term.map(porter, na_action="ignore")


def with_stems(rows: DataFrame, term: str = "term") -> DataFrame:
    """rows with the term replaced by its stem. Only distinct terms are stemmed."""
    vocabulary = rows.select(term).distinct().withColumn("_stem", stem(F.col(term)))
    return rows.join(vocabulary, term).drop(term).withColumnRenamed("_stem", term)
