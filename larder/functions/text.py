"""Column functions for names, labels, keys and lists of recipe data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_filled(columns: Sequence[str | Column], default: str | None = None) -> Column:
    """The first column that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(col(c)), F.lit("")) for c in columns], F.lit(default))


def source_key(title: str | Column, url: str | Column, image: str | Column) -> Column:
    """32 hexadecimal digits of the SHA-1 of title|url|image, nulls as empty texts."""
    parts = [F.coalesce(col(c), F.lit("")) for c in (title, url, image)]
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 32)


def label(c: str | Column) -> Column:
    """trimmed, lower case, hyphens and spaces as underscores."""
    return F.translate(F.lower(F.trim(col(c))), "- ", "__")


def class_key(c: str | Column) -> Column:
    """ing_7 and ING_00007 become ing_00007; other labels pass."""
    digits = F.regexp_extract(col(c), r"(?i)^ing_(\d+)$", 1)
    number = F.regexp_replace(digits, "^0+(?=.)", "")
    padded = F.concat(F.lit("ing_"), F.when(F.length(number) < 5, F.lpad(number, 5, "0")).otherwise(number))
    return F.when(digits != "", padded).otherwise(col(c))


def class_id(c: str | Column) -> Column:
    """the number in a class key, else null."""
    return F.regexp_extract(col(c), r"(?i)^ing_(\d+)$", 1).try_cast("bigint")


def without_parentheses(c: str | Column) -> Column:
    """ASCII and full-width parentheses go with what they hold."""
    return F.trim(F.regexp_replace(col(c), r"\s*[\(（][^)）]*[\)）]", ""))


def without_fragment(c: str | Column) -> Column:
    """F16: a URL up to its first #."""
    return F.split_part(col(c), F.lit("#"), F.lit(1))


def alias_list(c: str | Column) -> Column:
    """a comma list as an array of trimmed texts."""
    return F.transform(F.split(col(c), ","), lambda x: F.trim(x))


def embedding_text(normalized: str | Column, canonical: str | Column) -> Column:
    """the text that is embedded: the name, and the original name where it differs."""
    n, c = col(normalized), col(canonical)
    both = F.concat(F.lit("식재료: "), n, F.lit(". 원문: "), c)
    return F.when(c.isNotNull() & (c != "") & (c != n), both).otherwise(F.concat(F.lit("식재료: "), n))


def queries_for(c: str | Column, suffixes: Sequence[str]) -> Column:
    """a phrase, and the phrase with each suffix, distinct."""
    phrase = F.trim(col(c))
    return F.array_distinct(F.concat(F.array(phrase), F.transform(F.array(*map(F.lit, suffixes)), lambda s: F.concat(phrase, s))))


def short_first(c: str | Column) -> Column:
    """Phrases by number of words, then length, then place."""
    marked = F.transform(col(c), lambda x, i: F.struct(F.size(F.split(F.trim(x), r"\s+")).alias("words"), F.length(x).alias("length"), i.alias("at"), x.alias("text")))
    return F.transform(F.array_sort(marked), lambda x: x["text"])


def collapsed(c: str | Column) -> Column:
    """runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def non_letter_ratio(c: str | Column) -> Column:
    """share of characters that are no letters; 1 for an empty text."""
    x = col(c)
    return F.when(F.length(x) == 0, 1.0).otherwise(1.0 - F.length(F.regexp_replace(x, r"[^\p{L}]", "")) / F.length(x))


def number_or(c: str | Column, default: float = 0.0) -> Column:
    """a number, else the default."""
    return F.coalesce(col(c).try_cast("double"), F.lit(default))


def user_key(c: str | Column) -> Column:
    """An integer id in its plain form, else the text."""
    return F.coalesce(col(c).try_cast("bigint").cast("string"), col(c))


def approved(flag: str | Column, suggestion: str | Column) -> Column:
    """A flag of consent, and a suggestion that is not blank."""
    yes = F.upper(F.trim(F.coalesce(col(flag), F.lit("")))).isin("Y", "YES", "TRUE", "1", "승인")
    return yes & (F.trim(F.coalesce(col(suggestion), F.lit(""))) != "")


def digits_id(c: str | Column) -> Column:
    """An id of digits alone as a number, else null."""
    return F.when(col(c).rlike("^[0-9]+$"), col(c).try_cast("bigint"))


def word_prefixes(c: str | Column) -> Column:
    """All prefixes of a name that end with a whole word, shortest first."""
    words = F.split(col(c), " ")
    return F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.concat_ws(" ", F.slice(words, 1, n)))


def fenced_json(c: str | Column) -> Column:
    """text without the code fence around it."""
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+\z", "")
    opened = F.regexp_replace(bare(col(c)), r"^```(json)?\s*", "")
    return bare(F.regexp_replace(opened, r"\s*```\z", ""))


def braced_json(c: str | Column) -> Column:
    """from the first { to the last }, else null."""
    return F.nullif(F.regexp_extract(col(c), r"(?s)\{.*\}", 0), F.lit(""))


def rounded(c: str | Column) -> Column:
    """four places, halves away from zero."""
    return F.round(col(c), 4)
