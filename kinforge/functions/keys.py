"""Blocking keys of records: four families, built from the raw text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.functions import rules
from kinforge.functions.text import KEY_AFTER, KEY_BEFORE, casefold, is_missing, trim

_LETTERS = "".join(rules.SOUNDEX)
_CODES = "".join(code * len(letters) for letters, code in rules.SOUNDEX.items())


def soundex(word: Column) -> Column:
    """Soundex in which every letter without a code, H and W too, ends a run;
    empty unless the word begins with A-Z."""
    upper = F.upper(word)
    codes = F.translate(F.regexp_replace(upper, f"[^{_LETTERS}]", "0"), _LETTERS, _CODES)
    rest = F.replace(F.substring(F.regexp_replace(codes, r"(.)\1+", "$1"), 2, 1_000_000), F.lit("0"), F.lit(""))
    code = F.rpad(F.concat(F.substring(upper, 1, 1), F.substring(rest, 1, 3)), 4, "0")
    return F.when(upper.rlike("^[A-Z]"), code).otherwise("")


def name_words(folded: Column) -> Column:
    """Words of a case-folded name that make keys."""
    text = F.regexp_replace(folded, rf"\.(?:{'|'.join(rules.DOMAINS)}){KEY_AFTER}", " ")
    found = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}\p{N}]+"), 0)
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(*rules.SUFFIX_TOKENS))


def address_numbers(raw: Column) -> Column:
    return F.regexp_extract_all(raw, F.lit(rf"{KEY_BEFORE}\p{{Nd}}+{KEY_AFTER}"), 0)


def address_words(folded: Column) -> Column:
    found = F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{M}]+"), 0)
    return F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(*rules.ADDRESS_STOPWORDS))


def _some(condition: Column, key: Column) -> Column:
    """[key] where the condition holds, else []."""
    return F.when(condition, F.array(key)).otherwise(F.array().cast("array<string>"))


def _pre(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.array_join(F.array(*parts), "_"))


def key_lists(df: DataFrame, name: str = "business_name", address: str = "business_address") -> DataFrame:
    """`df` with k_name_tokens, k_char_ngrams, k_phonetic and k_address: the keys
    of each family in their order, repeats kept."""
    no_address = is_missing(F.col(address), rules.MISSING_ADDRESS_KEYS)
    out = df.withColumns({"_name": casefold(F.coalesce(F.col(name), F.lit(""))), "_raw": F.when(no_address, "").otherwise(trim(F.col(address)))})
    out = out.withColumns({"_t": name_words(F.col("_name")), "_numbers": address_numbers(F.col("_raw")), "_words": address_words(casefold(F.col("_raw")))})
    t, numbers, words = F.col("_t"), F.col("_numbers"), F.col("_words")
    out = out.withColumns(
        {
            "_t1": F.try_element_at(t, F.lit(1)),
            "_t2": F.try_element_at(t, F.lit(2)),
            "_joined": F.array_join(t, ""),
            "_street": F.try_element_at(numbers, F.lit(1)),
            "_postal": F.try_element_at(F.filter(F.slice(numbers, F.greatest(F.size(numbers), F.lit(1)), 1), lambda x: F.length(x) >= 3), F.lit(1)),
            "_w1": F.substring(F.try_element_at(words, F.lit(1)), 1, 5),
            "_w2": F.substring(F.try_element_at(words, F.lit(2)), 1, 5),
        }
    )
    out = out.withColumn("_sx", soundex(F.col("_t1")))
    t1, t2, street, postal, sx = (F.col(c) for c in ("_t1", "_t2", "_street", "_postal", "_sx"))
    two = t2.isNotNull()
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat(F.lit("ash_"), a, F.lit("_"), b),
    )
    out = out.withColumns(
        {
            "k_name_tokens": F.concat(F.filter(t, lambda x: F.length(x) >= 3), _some(two, F.concat(t1, F.lit("_"), t2))),
            "k_char_ngrams": F.concat(
                _some(F.length("_joined") >= 4, F.concat(F.lit("p4_"), F.substring("_joined", 1, 4))),
                _some(two, F.concat(F.lit("init2_"), F.substring(t1, 1, 2), F.substring(t2, 1, 2))),
            ),
            "k_phonetic": F.concat(_some(sx != "", _pre("sx_", sx)), _some((sx != "") & two, _pre("sx2_", sx, F.substring(t2, 1, 2)))),
            "k_address": F.concat(
                _some(postal.isNotNull(), _pre("pin_", postal)),
                _some(postal.isNotNull() & t1.isNotNull(), _pre("post_name_", postal, F.substring(t1, 1, 2))),
                _some(postal.isNotNull() & street.isNotNull(), _pre("post_num_", postal, street)),
                _some(street.isNotNull() & F.col("_w1").isNotNull(), _pre("st_num_word_", street, F.col("_w1"))),
                _some(street.isNotNull() & F.col("_w2").isNotNull(), _pre("st_num_word2_", street, F.col("_w2"))),
                pairs,
                F.transform(F.filter(words, lambda w: F.length(w) >= 5), lambda w: F.concat(F.lit("aw_"), w)),
            ),
        }
    )
    return out.drop("_name", "_raw", "_t", "_numbers", "_words", "_t1", "_t2", "_joined", "_street", "_postal", "_w1", "_w2", "_sx")


def exploded(df: DataFrame, *keep: str, name: str = "business_name", address: str = "business_address") -> DataFrame:
    """One row per key: the columns kept, strategy, key, pos (place among all keys of the record)."""

    def tagged(strategy: str) -> Column:
        return F.transform(f"k_{strategy}", lambda k: F.struct(F.lit(strategy).alias("strategy"), k.alias("key")))

    lists = [tagged(s) for s in rules.STRATEGIES]
    listed = key_lists(df, name, address).select(*keep, F.posexplode(F.concat(*lists)).alias("pos", "k"))
    return listed.select(*keep, "k.strategy", "k.key", "pos")


def key_weight(strategy: Column, key: Column, idf: Column) -> Column:
    """Weight of a key at query time."""
    bonus = rules.IDF_BONUS
    name = idf + F.when(key.contains("_"), bonus["bigram"]).otherwise(0.0)
    address = idf + (
        F.when(key.startswith("post_name_") | key.startswith("post_num_"), bonus["post_name_"])
        .when(key.startswith("ash_") | key.startswith("st_num_word"), bonus["ash_"])
        .otherwise(0.0)
    )
    fixed = rules.FIXED_WEIGHT
    return (
        F.when(strategy == "name_tokens", name)
        .when(strategy == "char_ngrams", fixed["char_ngrams"])
        .when(strategy == "phonetic", fixed["phonetic"])
        .otherwise(address)
    )
