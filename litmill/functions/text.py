"""Text functions of the bibliographic tables. All stay in the JVM but for Unicode folding, for which Spark has none."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The stop words that keep function words out of topic word lists.
STOP_WORDS = (
    "a an and are as at be but by for from has have in into is it its of on or that the this to was were will with we our "
    "their they these those than then there which who whom whose if so such not no yes do does did been being between "
    "among also however thus may can could should would might must shall"
).split()


def strip_prefix(value: Column, prefix: str) -> Column:
    """Trimmed text without a URL prefix; null gives empty text."""
    text = F.trim(F.coalesce(value, F.lit("")))
    return F.when(text.startswith(prefix), F.substring(text, F.lit(len(prefix) + 1), F.length(text))).otherwise(text)


def trim_slashes(value: Column) -> Column:
    return F.regexp_replace(value, "^/+|/+$", "")


def fold(text: str | None) -> str:
    """Compatibility-decomposed ASCII text in lower case; what has no ASCII form goes."""
    return unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode().lower()


@F.pandas_udf(T.StringType())
def folded_letters(names: pd.Series) -> pd.Series:
    """The letters a to z of a folded name."""
    return names.map(lambda x: re.sub("[^a-z]", "", fold(x)))


@F.pandas_udf(T.StringType())
def compatible(text: pd.Series) -> pd.Series:
    """NFKC, trimmed, in lower case, with single spaces."""
    return text.map(lambda x: " ".join(unicodedata.normalize("NFKC", x or "").lower().split()))


def last_token(name: Column) -> Column:
    """The last word of a name; empty if there is none."""
    return F.coalesce(F.try_element_at(F.filter(F.split(F.coalesce(name, F.lit("")), r"\s+"), lambda t: t != ""), F.lit(-1)), F.lit(""))


def last_name(name: Column) -> Column:
    return folded_letters(last_token(name))


def first_initial(name: Column) -> Column:
    """The first letter of a folded name."""
    return F.substring(folded_letters(F.coalesce(name, F.lit(""))), 1, 1)


def short_hash(text: Column, n: int = 16) -> Column:
    return F.substring(F.sha1(text), 1, n)


def heuristic_id(salt: str, last: Column, initial: Column, signal: Column) -> Column:
    """The id of an author known by name only; the doubled prefix is part of the format."""
    parts = [F.coalesce(x, F.lit("")) for x in (F.lit(salt), last, initial, signal)]
    return F.concat(F.lit("H:H"), short_hash(F.concat_ws("|", *parts)))


def tokens(text: Column, stop_words: list[str] | None = None, least: int = 2) -> Column:
    """Lower-case runs of ASCII letters and digits, without short ones and stop words; null and blank give none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    stop = F.array(*map(F.lit, STOP_WORDS if stop_words is None else stop_words)) if stop_words is None or stop_words else None
    keep = lambda t: (F.length(t) >= least) & (~F.array_contains(stop, t) if stop is not None else F.lit(True))
    return F.filter(found, keep)


def ngrams(words: Column, n: int) -> Column:
    """Space-joined runs of ``n`` words."""
    last = F.size(words) - n + 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, n), " ")))


def unfence(text: Column) -> Column:
    """The inside of a Markdown code fence around a whole text; text that doesn't begin with one stays."""
    body = F.substring(text, F.lit(4), F.length(text))
    line = F.trim(F.substring_index(body, "\n", 1))
    tagged = body.contains("\n") & line.rlike(r"^[\p{L}\p{N}]*$")
    body = F.when(tagged, F.substring(body, F.instr(body, "\n") + 1, F.length(body))).otherwise(body)
    body = F.regexp_replace(body, r"```\z", "")
    return F.when(text.startswith("```"), F.regexp_replace(body, r"^\s+|\s+\z", "")).otherwise(text)


def preview(text: Column, n: int = 200) -> Column:
    """One line of ``n`` characters at most, with an ellipsis where it was cut."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), "\n", " ")
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("..."))).otherwise(flat)


def join_nonempty(items: Column, separator: str = " ") -> Column:
    return F.array_join(F.filter(items, lambda x: x != ""), separator)


def title_and_abstract(title: Column, abstract: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(abstract, F.lit("")))


def has_text(text: Column, least: int = 50) -> Column:
    """The filter of texts worth embedding."""
    return text.isNotNull() & (F.length(text) > least)


def prompt(head: str, text: Column, examples: list[tuple[str, str]] = ()) -> Column:
    """A prompt: head, worked examples, then the text and the place for its JSON."""
    shots = [part for a, j in examples for part in (f"Abstract: {a}", f"JSON: {j}", "")]
    return F.concat(F.lit("\n".join([head, "", *shots]) + "\n"), F.lit("Abstract: "), F.coalesce(text, F.lit("")), F.lit("\nJSON:"))


def sql_literal(value: str) -> str:
    """A text as a literal of SQL, its quotes and backslashes kept; parameters are the better way where there are any."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
