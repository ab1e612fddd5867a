"""Content rules: category terms, spam shapes of titles and file lists, and the size floor."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodex.functions import text
from lodex.functions.automaton import automaton, first_of, is_whole


@dataclass(frozen=True)
class Rules:
    """What the rules are given: term lists and patterns (for lower-cased text, `weak` for the name as it is) and limits."""

    terms: tuple[str, ...] = ()
    name_terms: tuple[str, ...] = ()
    exceptions: tuple[str, ...] = ()
    domain: str = r"(?!)"
    strong: str = r"(?!)"
    weak: str = r"(?!)"
    least_size: int = 100 << 20
    most_size: int = 20 << 40
    most_name: int = 300
    most_files: int = 20_000
    most_other: float = 0.5
    repeats: int = 4
    random_files: int = 5
    random_share: float = 0.3
    random_length: int = 20


def without_exceptions(c: Column, rules: Rules) -> Column:
    for e in rules.exceptions:
        c = F.replace(c, F.lit(e.lower()), F.lit(""))
    return c


def first_terms(rules: Rules):
    """A function of three columns, the name without exceptions, the whole name and the paths without exceptions (all in small
    letters): struct(term, banner, files) of the first term in the name, the first name term, and the first term of each path;
    '' where there is none. Of terms that begin at one place, longer lists' order decides: those that count anywhere first,
    then whole words, each by code points. One walk of an automaton of both lists over each batch."""
    known = automaton((*rules.terms, *rules.name_terms))
    order = {t: i for i, t in enumerate(sorted(known.terms, key=lambda t: (is_whole(t), t)))}
    own, banners = (np.array([order[t] if t in low else -1 for t in known.terms], np.int64) for low in ({t.lower() for t in terms} for terms in (rules.terms, rules.name_terms)))
    said = np.array([*known.terms, ""], object)

    @F.arrow_udf("struct<term:string,banner:string,files:array<string>>")
    def hits(plain: pa.Array, whole: pa.Array, paths: pa.Array) -> pa.Array:
        n = len(plain)
        flat = paths.flatten()
        texts = [t or "" for column in (plain, whole, flat) for t in column.to_pylist()]
        found = known.occurrences(texts)
        terms, names = said[first_of(found, own, len(texts))], said[first_of(found[(found[:, 0] >= n) & (found[:, 0] < 2 * n)], banners, 2 * n)[n:]]
        offsets = np.concatenate([[0], np.cumsum(paths.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        files = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(terms[2 * n :], pa.string()))
        return pa.StructArray.from_arrays([pa.array(terms[:n], pa.string()), pa.array(names, pa.string()), files], names=["term", "banner", "files"])

    return hits


def term_hits(listings: DataFrame, rules: Rules) -> DataFrame:
    """info_hash and term for each term that occurs in a name (each term of the list by itself). One walk of an automaton over
    each name."""
    known = automaton(rules.terms)
    spelled: dict[str, list[str]] = {}
    for t in dict.fromkeys(rules.terms):
        spelled.setdefault(t.lower(), []).append(t)
    given = [spelled[k] for k in known.terms]

    @F.arrow_udf("array<string>")
    def hits(names: pa.Array) -> pa.Array:
        out: list[list[str]] = [[] for _ in range(len(names))]
        for text, k in np.unique(known.occurrences([t or "" for t in names.to_pylist()])[:, [0, 2]], axis=0).tolist():
            out[text] += given[k]
        return pa.array(out, pa.list_(pa.string()))

    name = without_exceptions(text.lower(F.col("name")), rules)
    return listings.select("info_hash", F.explode(hits(name)).alias("term"))


def signal(term: Column, plain: Column, rules: Rules) -> Column:
    """The kind and text of a category signal: the term, or else what the domain pattern finds; '' without one."""
    domain = F.regexp_extract(plain, f"({rules.domain})", 1)
    return F.when(term != "", F.concat(F.lit("term:"), term)).when(plain.rlike(rules.domain), F.concat(F.lit("domain:"), domain)).otherwise("")


def with_reasons(listings: DataFrame, rules: Rules, tested: bool = True) -> DataFrame:
    """The listings and reasons: the codes of all signals in the rules' order: category, spam, size (the last two if
    `tested`). Terms are found by one automaton in Arrow batches of names and paths; all else is native. Each signal is a
    column of its own first, so that none is computed twice."""
    low = text.lower(F.col("name"))
    rows = listings.withColumns({
        "_plain": without_exceptions(low, rules),
        "_low": low,
        "_paths": F.transform(F.col("files.path"), lambda p: without_exceptions(text.lower(p), rules)),
    })
    rows = rows.withColumn("_hits", first_terms(rules)("_plain", "_low", "_paths"))
    in_files = F.transform(F.arrays_zip("_paths", "_hits.files"), lambda x: signal(x["files"], F.coalesce(x["_paths"], F.lit("")), rules))
    rows = rows.withColumns({
        "_name": signal(F.col("_hits.term"), F.col("_plain"), rules),
        "_studio": F.regexp_extract("_low", f"({rules.strong})", 1),
        "_files": F.transform(F.filter(in_files, lambda h: h != ""), lambda h: F.concat(F.lit("file-"), h)),
        "_weak": F.col("name").rlike(rules.weak),
    })
    has = lambda c: F.col(c) != ""
    found = F.when(has("_name"), F.concat(F.lit("name-"), "_name")).when(has("_hits.banner"), F.concat(F.lit("banner:"), "_hits.banner")).when(has("_studio"), F.concat(F.lit("strong:"), "_studio"))
    weak = F.when((found.isNotNull() | (F.size("_files") > 0)) & F.col("_weak"), F.lit("weak"))
    tests = title_tests(rules) | size_tests(rules) | file_tests(rules) if tested else {}
    said = F.concat(F.array_compact(F.array(found)), F.col("_files"), F.array_compact(F.array(weak, *(F.when(t, F.lit(code)) for code, t in tests.items()))))
    return rows.withColumn("reasons", said).drop("_plain", "_low", "_paths", "_hits", "_name", "_studio", "_files", "_weak")


def title_tests(rules: Rules) -> dict[str, Column]:
    """Spam signals of the title."""
    name = F.col("name")
    return {
        "blank": text.one_space(name) == "",
        "no-letters": (text.one_space(name) != "") & ~text.has_alnum(name),
        "long": F.length(name) > rules.most_name,
        "stuffed": text.stuffed_word(name)["n"] >= rules.repeats,
        "other": text.other_share(name) > rules.most_other,
    }


def size_tests(rules: Rules) -> dict[str, Column]:
    n = F.col("total_size")
    return {"no-size": n <= 0, "huge": n > rules.most_size, "small": (n > 0) & (n < rules.least_size)}


def file_tests(rules: Rules) -> dict[str, Column]:
    n = F.size("files")
    odd = F.size(F.filter(F.col("files.path"), lambda p: (F.length(p) >= rules.random_length) & text.random_looking(p, rules.random_length)))
    return {"files": n > rules.most_files, "random-files": F.when(n >= rules.random_files, odd / n > rules.random_share).otherwise(False)}


CATEGORY_CODES = r"\A(?:name-|banner:|strong:|file-|weak)"


def screened(listings: DataFrame, rules: Rules) -> DataFrame:
    """The listings with reasons, category, spam, too_small, rejected and route (the one counter of the row: category
    before spam before size, else fetched)."""
    rows = with_reasons(listings, rules)
    is_category = F.exists("reasons", lambda r: r.rlike(CATEGORY_CODES))
    spam = F.exists("reasons", lambda r: ~r.rlike(CATEGORY_CODES) & (r != "small"))
    small = F.array_contains("reasons", "small")
    rows = rows.withColumns({"category": is_category, "spam": spam, "too_small": small})
    rejected = F.col("category") | F.col("spam") | F.col("too_small")
    route = F.when(F.col("category"), "filtered_category").when(F.col("spam"), "filtered_spam").when(F.col("too_small"), "filtered_small").otherwise("fetched")
    return rows.withColumns({"rejected": rejected, "route": route})


def evaluate(rows: DataFrame, label: str = "label") -> DataFrame:
    """By label: titles, those caught (any rule, size too) and those flagged by category or spam alone."""
    return rows.groupBy(label).agg(F.count("*").alias("n"), F.count_if("rejected").alias("caught"), F.count_if(F.col("category") | F.col("spam")).alias("flagged"))
