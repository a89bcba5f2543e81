"""English stems by the published Snowball English ("Porter2") rules, worked out once per distinct word."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the published algorithm.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    **{w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")},
}
SETTLED = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
LONG_STARTS = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_AFTER = "cdeghkmnrt"
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
VOWELS = "aeiouy"


def _after(w: str, start: int) -> int:
    """The place after the first consonant that follows a vowel from `start` on."""
    for i in range(start + 1, len(w)):
        if w[i] not in VOWELS and w[i - 1] in VOWELS:
            return i + 1
    return len(w)


def _has_vowel(w: str) -> bool:
    return any(c in VOWELS for c in w)


def _short_end(w: str) -> bool:
    """A short syllable: vowel and consonant at the very start, or consonant, vowel and a consonant other than w, x and Y."""
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-1] not in VOWELS and w[-1] not in "wxY" and w[-2] in VOWELS and w[-3] not in VOWELS


def _longest(w: str, ends) -> str:
    return max((e for e in ends if w.endswith(e)), key=len, default="")


def stem(word: str) -> str:
    """The stem of a lower-case word; words of at most two letters stay."""
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = ""
    for c in word:  # y is a consonant at the start and after a vowel
        w += "Y" if c == "y" and (not w or w[-1] in VOWELS) else c
    r1 = next((len(s) for s in LONG_STARTS if w.startswith(s)), None) or _after(w, 0)
    r2 = _after(w, r1)

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]):
        w = w[:-1]
    if w in SETTLED:
        return w

    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end.startswith("eed"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and _has_vowel(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"

    end = _longest(w, SECOND)
    at = len(w) - len(end)
    if end and at >= r1 and (end != "ogi" or w[at - 1] == "l") and (end != "li" or w[at - 1] in LI_AFTER):
        w = w[:at] + SECOND[end]
    end = _longest(w, THIRD)
    at = len(w) - len(end)
    if end and at >= (r2 if end == "ative" else r1):
        w = w[:at] + THIRD[end]
    end = _longest(w, FOURTH)
    at = len(w) - len(end)
    if end and at >= r2 and (end != "ion" or w[at - 1] in "st"):
        w = w[:at]
    last = len(w) - 1
    if w.endswith("e"):
        if last >= r2 or (last >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and last >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def with_stem(words: DataFrame, word: str) -> DataFrame:
    """Adds `stem`: give it distinct words. Words with anything but letters are their own stem; null stays null."""

    @F.pandas_udf("string")
    def stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda w: stem(w) if w is not None and w.isalpha() else w).astype(object)

    return words.withColumn("stem", stems(F.col(word)))
