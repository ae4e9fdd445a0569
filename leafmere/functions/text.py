"""Words for search: tokens, stop-words, stemmers for English and German and a language gate for them."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[\p{L}\p{N}]+(?:['’][\p{L}]+)*"
# Words that search leaves out.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
# Common short words of languages, for the language gate.
COMMON = {
    "en": "the and of to in is that it for was with as on be at by this have from not are but an they which or we you",
    "de": "der die und das ist nicht ein eine zu den mit von sich auf für des im dem wenn auch es an werden aus hat",
    "fr": "le la les et des est un une du dans que pour qui sur pas au avec ne se par plus ce chaque puis encore",
    "es": "el la los las de y que en un una es por con no se para su al lo como más pero cuando este cada",
    "it": "il la di che e un una per non sono con del si da come le dei nel alla gli",
    "pt": "o a os as de que e do da em um uma para com não por se mais como dos",
    "nl": "de het een en van is dat niet op te zijn met voor aan er ook als maar bij",
}


def tokens(text: Column) -> Column:
    """Lower-case words of ``text``; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def without_stop_words(words: Column, stop: list[str] | None = None) -> Column:
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS if stop is None else stop))


def search_terms(text: Column, stop: bool = True, stemmed: bool = False, language: str | None = "en") -> Column:
    """The terms that are indexed and searched: tokens, without stop-words, stemmed on demand in a language (None: not at all)."""
    words = tokens(text)
    words = without_stop_words(words) if stop else words
    return stems(words, language) if stemmed else words


VOWELS = "aeiouy"
# Fixed values of the public Snowball algorithm for English: words with stems of their own, words left after the first step,
# beginnings that shift the first region, and suffixes with what becomes of them.
ENGLISH_WORDS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
                 **{w: w for w in "sky news howe atlas cosmos bias andes".split()}}
ENGLISH_KEPT = set("inning outing canning herring earring proceed exceed succeed".split())
ENGLISH_BEGINNINGS = ("gener", "commun", "arsen")
ENGLISH_2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al",
             "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": ""}
ENGLISH_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
ENGLISH_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def regions(word: str, vowels: str) -> tuple[int, int]:
    """Where the regions after the first and the second non-vowel that follows a vowel begin."""
    pattern = re.compile(f"[{vowels}][^{vowels}]")
    first = m.end() if (m := pattern.search(word)) else len(word)
    return first, m.end() if (m := pattern.search(word, first)) else len(word)


def longest(word: str, suffixes) -> str | None:
    return max((x for x in suffixes if word.endswith(x)), key=len, default=None)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """English stem of a lower-case word by the public Snowball algorithm."""
    word = word.replace("’", "'")
    if len(word) < 3:
        return word
    if word in ENGLISH_WORDS:
        return ENGLISH_WORDS[word]
    word = word.removeprefix("'")
    # A y that is a consonant, at the beginning or after a vowel, is told by a capital.
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    r1, r2 = regions(word, VOWELS)
    if beginning := next((x for x in ENGLISH_BEGINNINGS if word.startswith(x)), None):
        r1 = len(beginning)
        r2 = m.end() if (m := re.compile("[aeiouy][^aeiouy]").search(word, r1)) else len(word)
    short = lambda w: bool(re.search(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", w))
    word = re.sub(r"'(?:s'?)?$", "", word)
    # Plurals.
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search("[aeiouy]", word[:-2]):
        word = word[:-1]
    if word in ENGLISH_KEPT:
        return word
    # Past forms and participles.
    suffix = longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if suffix in ("eed", "eedly"):
        if len(word) - len(suffix) >= r1:
            word = word[: -len(suffix)] + "ee"
    elif suffix and re.search("[aeiouy]", word[: -len(suffix)]):
        word = word[: -len(suffix)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif short(word) and r1 >= len(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    # Suffixes of derived words, within the first region.
    suffix = longest(word, ENGLISH_2)
    if suffix and len(word) - len(suffix) >= r1:
        rest = word[: -len(suffix)]
        if not (suffix == "ogi" and not rest.endswith("l")) and not (suffix == "li" and rest[-1:] not in tuple("cdeghkmnrt")):
            word = rest + ENGLISH_2[suffix]
    suffix = longest(word, ENGLISH_3)
    if suffix and len(word) - len(suffix) >= (r2 if suffix == "ative" else r1):
        word = word[: -len(suffix)] + ENGLISH_3[suffix]
    # Within the second one.
    suffix = longest(word, ENGLISH_4)
    if suffix and len(word) - len(suffix) >= r2 and (suffix != "ion" or word[: -len(suffix)].endswith(("s", "t"))):
        word = word[: -len(suffix)]
    if word.endswith("e") and (len(word) - 1 >= r2 or len(word) - 1 >= r1 and not short(word[:-1])):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


@lru_cache(maxsize=200_000)
def german_stem(word: str) -> str:
    """German stem of a lower-case word by the public Snowball algorithm."""
    vowels = "aeiouyäöü"
    word = word.replace("ß", "ss")
    word = re.sub(f"(?<=[{vowels}])([uy])(?=[{vowels}])", lambda m: m[1].upper(), word)
    r1, r2 = regions(word, vowels)
    r1 = max(r1, 3)
    inside = lambda suffix, r: len(word) - len(suffix) >= r
    suffix = longest(word, ("em", "ern", "er", "e", "en", "es", "s"))
    if suffix and inside(suffix, r1) and (suffix != "s" or word[-2:-1] in tuple("bdfghklmnrt")):
        word = word[: -len(suffix)]
        if suffix in ("e", "en", "es") and word.endswith("niss"):
            word = word[:-1]
    suffix = longest(word, ("en", "er", "est", "st"))
    if suffix and inside(suffix, r1) and (suffix != "st" or word[-3:-2] in tuple("bdfghklmnt") and len(word) >= 6):
        word = word[: -len(suffix)]
    suffix = longest(word, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if suffix and inside(suffix, r2) and not (suffix in ("ig", "ik", "isch") and word[: -len(suffix)].endswith("e")):
        word = word[: -len(suffix)]
        if suffix in ("end", "ung") and word.endswith("ig") and inside("ig", r2) and not word.endswith("eig"):
            word = word[:-2]
        elif suffix in ("lich", "heit") and word.endswith(("er", "en")) and inside("er", r1):
            word = word[:-2]
        elif suffix == "keit" and (more := longest(word, ("lich", "ig"))) and inside(more, r2):
            word = word[: -len(more)]
    return word.lower().translate(str.maketrans("äöü", "aou"))


STEMMERS = {"en": stem, "de": german_stem}


def stems(words: Column, language: str | None = "en") -> Column:
    """The stem of every word; without a language, or in one that has no stemmer here, the words themselves."""
    one = STEMMERS.get(language or "")
    if one is None:
        return words

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def stemmed(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ws: None if ws is None else [one(w) for w in ws])

    return stemmed(words)


def language_scores(text: Column) -> Column:
    """Map of language to the share of its common words among the tokens; all in SQL."""
    words = tokens(text)
    share = lambda known: F.size(F.filter(words, lambda w: w.isin(known.split()))) / F.greatest(F.size(words), F.lit(1))
    return F.map_from_arrays(F.array(*[F.lit(k) for k in COMMON]), F.array(*[share(v) for v in COMMON.values()]))


def language(text: Column, margin: float = 0.12, least_words: int = 2, default: str = "en") -> Column:
    """The language whose common words lead by ``margin``, else the default; also for null or very short texts."""
    ranked = F.array_sort(F.transform(F.map_entries(language_scores(text)), lambda e: F.struct((-e["value"]).alias("score"), e["key"].alias("name"))))
    first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    sure = (second["score"] - first["score"] >= margin) & (F.size(tokens(text)) >= least_words)
    return F.when(sure, first["name"]).otherwise(F.lit(default))
