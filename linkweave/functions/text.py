"""Text normalisation as column expressions.

Letters up to U+024F are folded by one ``translate`` and a few ``replace`` calls, so Latin text never
leaves the JVM. Only strings with other letters go through an Arrow UDF.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.constants import ABBREVIATIONS, HONORIFICS, LEGAL, NAME_NOISE

WORD = r"([\p{L}\p{N}]+)"
#: What the native fold does not cover: anything above U+024F that is no combining mark of the first block.
BEYOND = r"[^\x{0000}-\x{024F}\x{0300}-\x{036F}]"


def fold_string(s: str) -> str:
    """Casefold; compatibility forms decomposed, and marks of a combining class dropped."""
    s = s.casefold()
    if s.isascii():
        return s
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def _latin_fold() -> tuple[str, str, list[tuple[str, str]]]:
    """(from, to) of translate for letters that fold to one character, and the pairs that fold to several."""
    single, many = [], []
    for code in range(0x80, 0x250):
        c = chr(code)
        to = fold_string(c)
        if to != c:
            (single if len(to) == 1 else many).append((c, to))
    return "".join(c for c, _ in single), "".join(t for _, t in single), [m for m in many]


_FROM, _TO, _MANY = _latin_fold()


def _folded_udf():
    @F.pandas_udf(T.StringType())
    def folded(values: pd.Series) -> pd.Series:
        return values.map(lambda s: None if s is None else fold_string(s))

    return folded


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def fold(c: Column, native_only: bool = False) -> Column:
    """The folded string. native_only: letters beyond U+024F are only lower-cased, and no UDF is planned."""
    out = F.translate(c, _FROM, _TO)
    # The rare letters that fold to several share one test, so common strings skip the replacements.
    wide = out
    for a, b in _MANY:
        wide = F.replace(wide, F.lit(a), F.lit(b))
    wide = F.regexp_replace(wide, r"[\x{0300}-\x{036F}]", "")
    # Strings of ASCII alone, which have a byte for each letter, need none of it.
    out = F.lower(F.when(is_ascii(c), c).when(out.rlike("[^\\x00-\\x7F]"), wide).otherwise(out))
    if native_only:
        return out
    other = c.rlike(BEYOND)
    return F.when(other, _folded_udf()(F.when(other, c))).otherwise(out)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(1))


def words_text(c: Column) -> Column:
    """The natively folded tokens joined by spaces, without an array of them."""
    plain = F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")
    return F.trim(F.when(is_ascii(c), plain).otherwise(F.regexp_replace(fold(c, native_only=True), r"[^\p{L}\p{N}]+", " ")))


def norm_tokens(c: Column, native_only: bool = False) -> Column:
    """Tokens of the folded text, & read as "and", with abbreviations put short."""
    short = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    return F.transform(tokens(F.replace(fold(c, native_only), F.lit("&"), F.lit(" and "))), lambda t: F.coalesce(F.try_element_at(short, t), t))


def norm(c: Column, native_only: bool = False) -> Column:
    return F.array_join(norm_tokens(c, native_only), " ")


def without(array: Column, words: list[str]) -> Column:
    return F.filter(array, lambda t: ~t.isin(*words))


def prepared(records: DataFrame, native_only: bool = True) -> DataFrame:
    """records with n, a (normalised name and address), nt (distinct core tokens, sorted), at (distinct
    address tokens, sorted), nums (distinct digit runs of the address, sorted) and c (country).

    A name of legal words alone keeps them as its core.
    """
    name, address = norm_tokens(F.col("business_name"), native_only), norm_tokens(F.col("business_address"), native_only)
    return (
        records.withColumns({"__n": name, "__a": address, "c": norm(F.col("country"), native_only)})
        .withColumns({"__core": without(F.col("__n"), LEGAL)})
        .withColumns(
            {
                "n": F.array_join("__n", " "),
                "a": F.array_join("__a", " "),
                "nt": F.sort_array(F.array_distinct(F.when(F.size("__core") > 0, F.col("__core")).otherwise(F.col("__n")))),
                "at": F.sort_array(F.array_distinct("__a")),
                "plain": F.col("__core"),
            }
        )
        .withColumn("nums", F.sort_array(F.array_distinct(F.regexp_extract_all("a", F.lit(r"(\p{Nd}+)"), F.lit(1)))))
        .drop("__n", "__a", "__core")
    )


def extended(prepared_records: DataFrame, native_only: bool = True) -> DataFrame:
    """with core (text), compact, acronym, words (address tokens that are no numbers) and nonascii.

    Spelled-out legal forms (L.L.C., L.L.P., P.V.T.), web decoration, honorifics and long numbers go; the
    order of tokens and their repetitions stay.
    """
    name = F.lower("business_name")
    for pattern in NAME_NOISE:
        # Letters of all scripts are word characters.
        name = F.regexp_replace(name, f"(?U){pattern}", " ")
    kept = F.filter(norm_tokens(name, native_only), lambda t: ~t.isin(*LEGAL, *HONORIFICS) & ~t.rlike(r"^\p{Nd}{7,}$"))
    return prepared_records.withColumn("__e", kept).withColumns(
        {
            "core": F.array_join("__e", " "),
            "compact": F.array_join("__e", ""),
            "acronym": F.array_join(F.transform("__e", lambda t: F.substring(t, 1, 1)), ""),
            "words": F.filter("at", lambda t: ~t.rlike(r"^\p{Nd}+$")),
            "nonascii": F.col("n").rlike(r"[^\x00-\x7F]"),
        }
    ).drop("__e")


_PLAIN_WORD = re.compile(r"[^\W_]+")


def norm_string(s: str) -> str:
    """norm of one string; for driver-side values and tests."""
    return " ".join(ABBREVIATIONS.get(t, t) for t in _PLAIN_WORD.findall(fold_string(s).replace("&", " and ")))


def first_words(c: Column, k: int) -> Column:
    """The beginning of a string that holds its first k words, marks on them included; the rest isn't read."""
    return F.regexp_extract(c, rf"^(?:[^\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\p{{M}}]*+){{0,{k}}}+", 0)
