"""Text to features: newsgroup cleaning, word and character n-grams, skip-grams, all by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_posting(raw: Column) -> Column:
    """Drops headers up to the first blank line, quoted lines, the signature behind the last "--" line, addresses and hosts."""
    lines = F.split(F.regexp_replace(raw, "\r\n?", "\n"), "\n")
    blank = F.coalesce(F.array_position(F.transform(lines, lambda x: F.trim(x) == ""), True), F.lit(0))
    body = F.when(blank > 0, F.slice(lines, (blank + 1).cast("int"), F.greatest(F.size(lines) - blank, F.lit(0)).cast("int"))).otherwise(lines)
    quoted = lambda x: ~F.ltrim(x).rlike(r"^[>|%:]")
    body = F.filter(body, quoted)
    marks = F.filter(F.transform(body, lambda x, i: F.when(F.trim(x).startswith("--"), i)), lambda i: i.isNotNull())
    body = F.when(F.size(marks) > 0, F.slice(body, 1, F.element_at(marks, -1))).otherwise(body)
    text = F.array_join(body, "\n")
    text = F.regexp_replace(text, r"\S+@\S+", " ")
    return F.trim(F.regexp_replace(text, r"(?i)\b[\w-]+(\.[\w-]+)*\.(edu|com|org|net|gov)\b", " "))


def words(text: Column, least: int = 1, most: int = 40) -> Column:
    """Lower-case runs of letters and digits of a length within the bounds."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: (F.length(w) >= least) & (F.length(w) <= most))


def ngrams(tokens: Column, n: int, skip: int = 0) -> Column:
    """Runs of n tokens, ``skip`` left out between neighbours."""
    step = skip + 1
    last = F.size(tokens) - (n - 1) * step
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.concat_ws(" ", *[F.element_at(tokens, (i + k * step).cast("int")) for k in range(n)]))).otherwise(F.array().cast("array<string>"))


def char_ngrams(token: Column, n: int) -> Column:
    last = F.length(token) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(token, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _marked(w: Column, n: int) -> Column:
    return F.flatten(F.transform(w, lambda t: F.transform(char_ngrams(t, n), lambda c: F.concat(F.lit("#"), c))))


def tokens(text: Column, ngram: int = 1, chars: tuple[int, ...] = (), skips: int = 0, least: int = 1, most: int = 40) -> Column:
    """Distinct features of a text: words, their n-grams and skip-grams, and character n-grams of each word."""
    w = words(text, least, most)
    parts = [w] + [ngrams(w, n) for n in range(2, ngram + 1)] + [ngrams(w, 2, s) for s in range(1, skips + 1)]
    parts += [_marked(w, n) for n in chars]
    return F.array_distinct(F.concat(*parts))
