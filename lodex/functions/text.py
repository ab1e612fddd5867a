"""Text expressions: folding, splitting, cutting, title measures and title clean-up."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"\p{IsWhite_Space}+"
#: The same characters for Python's patterns.
WHITE_CLASS = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def lower(c: Column) -> Column:
    """Lower case by character, whatever its neighbours: capital sigma has one small form, dotted I has i."""
    return F.lower(F.translate(c, "Σİ", "σi"))


def fields(c: Column) -> Column:
    """What Unicode white space parts, without empty strings."""
    return F.filter(F.split(c, WHITE), lambda x: x != "")


def keywords(q: Column, most: int = 8) -> Column:
    """The first `most` words of a query, A-Z lower-cased."""
    return F.slice(fields(ascii_lower(q)), 1, most)


def byte_prefix(c: Column, most: int = 200) -> Column:
    """The longest prefix of at most `most` UTF-8 bytes that splits no character."""
    ends = F.sequence(F.lit(0), F.least(F.length(c), F.lit(most)))
    return F.when(F.octet_length(c) <= most, c).otherwise(F.left(c, F.array_max(F.filter(ends, lambda n: F.octet_length(F.left(c, n)) <= most))))


def one_space(c: Column) -> Column:
    """White-space runs as one space, none at the ends."""
    return F.array_join(fields(c), " ")


def one_line(c: Column) -> Column:
    return F.translate(c, "\n\r\t", "   ")


def escaped_query(c: Column) -> Column:
    """Query escaping: space as +, letters, digits and -_.~ as they are."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def size_label(n: Column) -> Column:
    """GB with one digit, MB without, or bytes; exact ties go to the even digit."""
    gib, mib = n / F.lit(float(1 << 30)), n / F.lit(float(1 << 20))
    even = lambda x, d: F.format_string(f"%.{d}f", F.bround(x, d))
    return F.when(n >= 1 << 30, F.concat(even(gib, 1), F.lit("GB"))).when(n >= 1 << 20, F.concat(even(mib, 0), F.lit("MB"))).otherwise(F.concat(n.cast("string"), F.lit("B")))


def unfenced(c: Column) -> Column:
    """Text without a code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"\A```[A-Za-z]*\s*", ""), r"\s*```\s*\z", ""))


# Measures of a title.


def has_alnum(c: Column) -> Column:
    return c.rlike(r"[\p{L}\p{Nd}]")


def other_share(c: Column) -> Column:
    """Share of characters that are neither letters, digits nor white space; 0 for empty text."""
    return F.when(F.length(c) == 0, 0.0).otherwise(F.length(F.regexp_replace(c, r"[\p{L}\p{Nd}\p{IsWhite_Space}]", "")) / F.length(c))


def stuffed_word(c: Column) -> Column:
    """struct(word, n): the most repeated lower-cased word of two or more characters; of equally frequent ones, the one that
    reaches the number first. n is 0 without words. Words are sorted with their places, so equal ones are neighbours
    and the k-th of them is where the word reaches k."""
    found = F.filter(fields(lower(c)), lambda w: F.length(w) >= 2)
    items = F.array_sort(F.transform(found, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit("").alias("word"), F.lit(0).alias("n"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["last"] == x["w"], acc["run"] + 1).otherwise(1)
        best = (run > acc["n"]) | ((run == acc["n"]) & (x["i"] < acc["at"]))
        keep = lambda new, old: F.when(best, new).otherwise(old)
        return F.struct(x["w"].alias("last"), run.alias("run"), keep(x["w"], acc["word"]).alias("word"), keep(run, acc["n"]).alias("n"), keep(x["i"], acc["at"]).alias("at"))

    return F.aggregate(items, start, step, lambda acc: F.struct(acc["word"].alias("word"), acc["n"].alias("n")))


def random_looking(path: Column, least: int = 20) -> Column:
    """A file's base name, without its last extension, is `least` or more ASCII letters and digits without a vowel."""
    base = F.regexp_replace(path, r"(?s)\A.*[/\\]", "")
    stem = F.regexp_replace(base, r"(?s)\A(.+)\.[^.]*\z", "$1")
    return stem.rlike(r"\A[0-9B-DF-HJ-NP-TV-Zb-df-hj-np-tv-z]{%d,}\z" % least)


def common_dir(paths: Column) -> Column:
    """Longest common directory prefix, with its last slash; '' for fewer than two paths."""
    a, b = F.array_min(paths), F.array_max(paths)
    same = F.array_max(F.filter(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), lambda n: F.left(a, n) == F.left(b, n)))
    return F.when(F.size(paths) < 2, "").otherwise(F.regexp_extract(F.left(a, same), r"(?s)\A(.*/)", 1))


# Terms.


def terms_pattern(terms: list[str]) -> str:
    """One pattern for lower-cased text: terms of up to four ASCII characters as whole words, others anywhere."""
    short = sorted({t.lower() for t in terms if t and len(t) <= 4 and t.isascii()})
    long = sorted({t.lower() for t in terms if t} - set(short))
    whole = [r"(?<![A-Za-z0-9_])(?:" + "|".join(map(re.escape, short)) + r")(?![A-Za-z0-9_])"] if short else []
    return "|".join([*map(re.escape, long), *whole]) or r"(?!)"


# Clean-up of titles.


def is_subsequence(sub: Column, of: Column) -> Column:
    """`sub` is what deleting characters of `of` can leave."""
    step = lambda p, c: F.when((p == 0) | (c == ""), p).otherwise(F.coalesce(F.nullif(F.call_function("locate", c, of, p), F.lit(0)) + 1, F.lit(0)))
    return F.aggregate(F.split(sub, ""), F.lit(1), step) > 0


def accepted_title(raw: Column, proposed: Column) -> Column:
    """A proposed title, if it only deletes characters of the raw one and keeps enough of them; else ''."""
    full = one_line(raw)
    new = F.btrim(one_space(proposed), F.lit(" \t-_|"))
    fits = (F.length(full) <= 200) & (new != "") & (new != full) & (new != one_space(full)) & (F.length(new) <= F.length(full)) & (F.length(new) >= 4) & (F.length(new) >= 0.25 * F.length(full))
    return F.coalesce(F.when(fits & is_subsequence(new, full), new), F.lit(""))


def original_name(full: Column, title: Column) -> Column:
    """The Latin name behind a known title in another script, without a year in brackets; '' if there is none."""
    plain = F.regexp_replace(full, r"\s*\(\d{4}\)\s*\z", "")
    rest = F.when((title != "") & F.startswith(plain, title), F.substr(plain, F.length(title) + 1)).otherwise(F.regexp_replace(plain, r"(?s)\A.*[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]", ""))
    name = F.regexp_replace(rest, r"\A[\p{IsWhite_Space}\p{C}\p{Zl}\p{Zp}]+|[\p{IsWhite_Space}\p{C}\p{Zl}\p{Zp}]+\z", "")
    return F.when(name.rlike("[A-Za-z]"), name).otherwise("")
