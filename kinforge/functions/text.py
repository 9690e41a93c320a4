"""Normalization of names and addresses as column expressions.

All rules are native expressions, Unicode folding too, so no row leaves the JVM.
Word boundaries are written as look-arounds so that results do not hang on the JVM's
idea of a word.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.functions import rules

#: White space as Python's str.strip and re see it.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Not inside a word: letters, numbers and the underscore make words here ...
BEFORE, AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: ... and combining marks too where blocking keys are made.
KEY_BEFORE, KEY_AFTER = r"(?<![\p{L}\p{M}\p{N}_])", r"(?![\p{L}\p{M}\p{N}_])"


def _folded(c: Column, compatible: bool) -> Column:
    """Folded by the Unicode library that Spark ships, in the JVM; ASCII takes the short way."""
    fold, compose = F.lit("com.ibm.icu.lang.UCharacter"), F.lit("com.ibm.icu.text.Normalizer")
    text = F.reflect(compose, F.lit("compose"), c, F.lit(True)) if compatible else c
    folded = F.reflect(fold, F.lit("foldCase"), text, F.lit(True))
    return F.when(c.rlike(r"[^\x00-\x7F]"), folded).otherwise(F.lower(c))


def nfkc_casefold(c: Column) -> Column:
    return _folded(c, True)


def casefold(c: Column) -> Column:
    return _folded(c, False)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def is_missing(c: Column, words: Iterable[str] = rules.MISSING) -> Column:
    return c.isNull() | F.lower(trim(c)).isin(*words)


def reader_nulls(c: Column) -> Column:
    """Null where a reader with default settings would have made the text a missing value."""
    return F.when(~c.isin("", *rules.READER_NA), c)


def strip_marks(c: Column) -> Column:
    """Every character that is no letter, combining mark or number becomes a space."""
    return F.regexp_replace(c, r"[^\p{L}\p{M}\p{N}]", " ")


def apply_rules(c: Column, table) -> Column:
    """Replace whole words by an ordered table of (patterns, replacement)."""

    def one(text: Column, rule) -> Column:
        patterns, replacement = rule
        space = [p.replace(r"\s", SPACE[1:-1]) for p in patterns]
        return F.regexp_replace(text, "|".join(f"{BEFORE}{p}{AFTER}" for p in space), replacement)

    return reduce(one, table, c)


def expand_symbols(c: Column) -> Column:
    for sign, word in (("&", " and "), ("@", " at "), (r"\+", " and ")):
        c = F.regexp_replace(c, sign, word)
    return c


def strip_possessive(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"['’]s{AFTER}", ""), "['’]", "")


def join_acronyms(c: Column) -> Column:
    """Dotted legal forms to one word; the order of the three is part of the rule."""
    for letters in ("lp", "llc", "llp"):
        dotted = rf"{SPACE}*\.{SPACE}*".join(letters)
        c = F.regexp_replace(c, rf"{BEFORE}{dotted}{SPACE}*\.(?=[\p{{L}}\p{{N}}_])|{BEFORE}{dotted}{AFTER}", f" {letters} ")
    return c


def clean_name(norm: Column) -> Column:
    """A normalized name without legal forms; the name itself if nothing is left."""
    phrases = [BEFORE + p.replace(" ", f"{SPACE}+") + AFTER for p in rules.SUFFIX_PHRASES]
    phrases += [p.replace(" ", f"{SPACE}+") for p in rules.SUFFIX_PHRASES_ANYWHERE]
    text = reduce(lambda c, p: F.regexp_replace(c, p, " "), phrases, norm)
    kept = F.filter(F.split(collapse(text), " "), lambda t: (t != "") & ~t.isin(*rules.SUFFIX_TOKENS))
    joined = F.array_join(kept, " ")
    joined = F.regexp_replace(joined, "^(?:(?:and|&)(?: |$))+", "")
    joined = F.regexp_replace(joined, "(?:(?:^| )(?:and|&))+$", "")
    return F.when(joined == "", norm).otherwise(joined)


def tokens(norm: Column) -> Column:
    """Tokens of a text that is normalized already."""
    return F.filter(F.split(norm, " "), lambda t: t != "")


def digit_tokens(toks: Column) -> Column:
    """[(i, t)] of the tokens made of digits only, i from 0."""
    return F.filter(F.transform(toks, lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda x: x["t"].rlike(r"^\p{Nd}+$"))


def postal_and_street(toks: Column, digits: Column) -> tuple[Column, Column]:
    """(postal code, street number) by place and length of the digit tokens."""
    n, m = F.size(toks), F.size(digits)
    first, last = F.try_element_at(digits, F.lit(1)), F.try_element_at(digits, F.lit(-1))
    one, late = m == 1, first["i"] >= n / 2
    long = F.length(first["t"]) >= 3
    postal = (
        F.when(one & (first["i"] <= 1), F.when((F.length(first["t"]) >= 4) & (first["i"] >= n - 2), first["t"]))
        .when(one, F.when(late & long, first["t"]))
        .when(m > 1, F.when((F.length(last["t"]) >= 3) | (last["i"] >= n - 2), last["t"]))
    )
    street = (
        F.when(one & (first["i"] <= 1), first["t"])
        .when(one, F.when(~late | ~long, first["t"]))
        .when(m > 1, F.when(first["i"] <= 2, first["t"]))
    )
    return F.when(m > 0, postal), F.when(m > 0, street)


def normalize(df: DataFrame, name: str = "business_name", address: str = "business_address", country: str = "country") -> DataFrame:
    """`df` with n_raw, n_norm, n_clean, n_tokens, n_has and a_raw, a_norm,
    a_tokens, a_has, a_postal, a_street, c_norm.

    Missing names and addresses have empty texts and no tokens; text of marks
    only is missing too but keeps its raw form."""
    out = df.withColumns(
        {
            "n_raw": F.when(is_missing(F.col(name)), "").otherwise(trim(F.col(name))),
            "a_raw": F.when(is_missing(F.col(address)), "").otherwise(trim(F.col(address))),
            "c_norm": F.when(is_missing(F.col(country)), "").otherwise(trim(F.col(country))),
        }
    )
    out = out.withColumns({"n_norm": nfkc_casefold(F.col("n_raw")), "a_norm": nfkc_casefold(F.col("a_raw"))})
    named = collapse(strip_marks(join_acronyms(strip_possessive(expand_symbols(F.col("n_norm"))))))
    placed = F.regexp_replace(strip_possessive(F.regexp_replace(F.col("a_norm"), "&", " and ")), r"[/\\,]", " ")
    out = out.withColumns({"n_norm": named, "a_norm": apply_rules(placed, rules.ADDRESS_ABBREVIATIONS)})
    expanded = apply_rules(apply_rules(F.col("n_norm"), rules.LEGAL_SUFFIXES), rules.GENERIC_ABBREVIATIONS)
    out = out.withColumns({"n_norm": collapse(expanded), "a_norm": collapse(strip_marks(F.col("a_norm")))})
    out = out.withColumns(
        {
            "n_clean": clean_name(F.col("n_norm")),
            "n_tokens": tokens(F.col("n_norm")),
            "n_has": F.col("n_norm") != "",
            "a_tokens": tokens(F.col("a_norm")),
            "a_has": F.col("a_norm") != "",
        }
    )
    out = out.withColumn("_digits", digit_tokens(F.col("a_tokens")))
    postal, street = postal_and_street(F.col("a_tokens"), F.col("_digits"))
    return out.withColumns({"a_postal": postal, "a_street": street}).drop("_digits")
