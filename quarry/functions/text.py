"""Text analysis as Column expressions: tokenizers, stop words, stem classes, mail cleaning; Porter's stemmer by Arrow batches."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words may hold dots inside ("u.s"). Letters and digits of any script; the same in Java's and RE2's dialect.
WORDS = r"[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*"
_PUNCTUATION = string.punctuation.replace(".", "")


def words(text: Column) -> Column:
    """Index tokens: ASCII punctuation but the dot becomes a space, lower case, runs of word characters. Null: none."""
    plain = F.translate(F.coalesce(text, F.lit("")), _PUNCTUATION, " " * len(_PUNCTUATION))
    return F.regexp_extract_all(F.lower(plain), F.lit(WORDS), F.lit(0))


def strip_punctuation(text: Column) -> Column:
    """Drops what is neither word, space, dot nor hyphen, and dots and hyphens that are not inside a word."""
    text = F.regexp_replace(text, r"(?U)[^\w\s.-]|(?<!\S)[.-](?!\S)|(?<=\s)[.-]|(?<=\S)[.-](?=\s)|[.-]\z", "")
    return F.regexp_replace(text, r"(?U)\.(?=\s|$)", " ")


def spaced(text: Column) -> Column:
    """Parts between white space; none for null or blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def without(tokens: Column, stop_words: list[str]) -> Column:
    """Tokens whose lower case is not among the (few, literal) stop words."""
    if not stop_words:
        return tokens
    stops = F.array(*[F.lit(w.lower()) for w in stop_words])
    return F.filter(tokens, lambda w: ~F.array_contains(stops, F.lower(w)))


def mapped(tokens: Column, stems: dict[str, str]) -> Column:
    """Each token's class root by a literal map; tokens outside it as they are."""
    if not stems:
        return tokens
    table = F.create_map(*[F.lit(x) for kv in stems.items() for x in kv])
    return F.transform(tokens, lambda w: F.coalesce(F.element_at(table, w), w))


def analyse_news(text: Column, stop_words: list[str] = (), stems: dict[str, str] | None = None) -> Column:
    """Strip punctuation, split at white space, lower case, stop words, stem classes."""
    tokens = F.transform(spaced(strip_punctuation(text)), lambda w: F.lower(w))
    return mapped(without(tokens, list(stop_words)), stems or {})


def analyse_spaced(text: Column, stop_words: list[str] = ()) -> Column:
    """Split at white space, stop words on the raw token, lower case, then ``words`` of the rejoined text."""
    return words(F.array_join(F.transform(without(spaced(text), list(stop_words)), lambda w: F.lower(w)), " "))


def analyse_query(text: Column, stop_words: list[str] = ()) -> Column:
    """``words`` without stop words and words of one character."""
    return F.filter(without(words(text), list(stop_words)), lambda w: F.length(w) > 1)


def letter_words(text: Column) -> Column:
    """Lower-case words that are letters only."""
    return F.filter(unigrams(text), lambda w: w.rlike(r"^\p{L}+$"))


def analyse_page(text: Column, stop_words: list[str] = ()) -> Column:
    """Lower case, words of letters only, stop words, Porter stems."""
    return porter(without(letter_words(text), list(stop_words)))


def clean_mail(text: Column) -> Column:
    """Tags out, then everything but ASCII letters, digits and white space; runs of white space become one space."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^a-zA-Z0-9\s]", ""), r"\s+", " "))


def unigrams(text: Column) -> Column:
    """Lower-case runs of word characters, one character or more."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def without_table(tokens: DataFrame, stop_words: DataFrame, term: str = "term") -> DataFrame:
    """Token rows without those of a stop list that is a table; Catalyst broadcasts it only while it is small."""
    stops = stop_words.select(F.lower("term").alias("__stop")).distinct()
    return tokens.join(stops, F.lower(F.col(term)) == F.col("__stop"), "left_anti")


def stemmed_by_table(tokens: DataFrame, classes: DataFrame, term: str = "term") -> DataFrame:
    """Token rows with the class root of each word (word, root; the largest root of a word listed twice)."""
    roots = classes.groupBy(F.col("word").alias("__word")).agg(F.max("root").alias("__root"))
    joined = tokens.join(roots, F.col(term) == F.col("__word"), "left")
    return joined.withColumn(term, F.coalesce("__root", term)).drop("__word", "__root")


# -- Porter's stemmer (Porter 1980) --------------------------------------------------------------------------------------

_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
#: Stems that a task remembers.
MEMO = 200_000


def _form(stem: str) -> str:
    out = ""
    for i, c in enumerate(stem):
        out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _form(stem)))


def _short(stem: str) -> bool:
    return len(stem) > 2 and _form(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _form(stem)[-1] == "c"


def porter_stem(w: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(w) < 3:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    elif (stem := next((w[: -len(x)] for x in ("ed", "ing") if w.endswith(x)), None)) is not None and "v" in _form(stem):
        w = stem
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and "v" in _form(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        end = max((x for x in table if w.endswith(x)), key=len, default=None)
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = max((x for x in _STEP4 if w.endswith(x)), key=len, default=None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if _double(w) and w.endswith("l") and _measure(w[:-1]) > 1 else w


def porter(tokens: Column) -> Column:
    """Porter stems of an array of words, batch by batch."""

    @F.pandas_udf("array<string>")
    def stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict[str, str] = {}
        for ts in batches:
            if len(memo) > MEMO:
                memo.clear()
            yield pd.Series([None if t is None else [memo.get(w) or memo.setdefault(w, porter_stem(w)) for w in t] for t in ts])

    return stems(tokens)
