"""Column expressions, each against a table of cases; one Spark job a table."""

import pytest
from pyspark.sql import functions as F

from lodex.functions import keys, text
from lodex.operators import requests


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(list(enumerate_rows(rows)), f"n int, {schema}").select("n", column.alias("v")).orderBy("n").select("v").collect()]


def enumerate_rows(rows):
    return ((i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows))


def test_ascii_lower_leaves_other_letters(spark):
    assert values(spark, ["ABCÉ"], "s string", text.ascii_lower(F.col("s"))) == ["abcÉ"]


def test_lower_is_by_character(spark):
    assert values(spark, ["ΣΑΣ", "İx"], "s string", text.lower(F.col("s"))) == ["σασ", "ix"]


def test_keywords_split_at_unicode_space_and_are_eight(spark):
    got = values(spark, ["  A　b C ", "1 2 3 4 5 6 7 8 9", "", "   "], "s string", text.keywords(F.col("s")))
    assert got == [["a", "b", "c"], list("12345678"), [], []]


def test_byte_prefix(spark):
    assert [len(x.encode()) for x in values(spark, ["あ" * 67, "abc", "", "é" * 150], "s string", text.byte_prefix(F.col("s")))] == [198, 3, 0, 200]


def test_query_escape(spark):
    assert values(spark, ["a b*c~d-_.é/"], "s string", text.escaped_query(F.col("s"))) == ["a+b%2Ac~d-_.%C3%A9%2F"]


@pytest.mark.parametrize(("n", "want"), [(5 << 28, "1.2GB"), (7 << 28, "1.8GB"), (1 << 30, "1.0GB"), (3 << 19, "2MB"), (5 << 19, "2MB"), (1000, "1000B")])
def test_size_label_rounds_ties_to_even(spark, n, want):
    assert values(spark, [n], "s bigint", text.size_label(F.col("s"))) == [want]


def test_unfenced(spark):
    assert values(spark, ["```json\n[1]\n```", "```\n[1]```", " [1] "], "s string", text.unfenced(F.col("s"))) == ["[1]"] * 3


def test_stuffed_word_is_the_first_to_reach_the_number(spark):
    got = values(spark, ["a b bb cc cc bb", "Movie movie MOVIE x movie", "", "a a a"], "s string", text.stuffed_word(F.col("s")))
    assert [tuple(x) for x in got] == [("cc", 2), ("movie", 4), ("", 0), ("", 0)]


def test_other_share(spark):
    assert values(spark, ["", "ab", "a!", "  ", "é́"], "s string", text.other_share(F.col("s"))) == [0.0, 0.0, 0.5, 0.0, 0.5]


def test_random_looking(spark):
    rows = ["x/bcdfghjklmnpqrstvwxz.mkv", "bcdfghjklmnpqrstvwxz", "a\\BCDFGHJKLMNPQRSTVWX9", "bcdfghjklmnpqrstvwxa.mkv", "bcdf.mkv", ".bcdfghjklmnpqrstvwxz"]
    assert values(spark, rows, "s string", text.random_looking(F.col("s"))) == [True, True, True, False, False, False]


def test_common_dir(spark):
    rows = [(["a/b/x", "a/b/y"],), (["a/bc", "a/bd"],), (["a"],), (["/x", "y"],), ([],)]
    assert values(spark, rows, "s array<string>", text.common_dir(F.col("s"))) == ["a/b/", "a/", "", "", ""]


def test_terms_are_whole_words_if_short_and_ascii(spark):
    p = text.terms_pattern(["av", "女優", "longer"])
    assert values(spark, ["av女優", "have", "an av.", "xlongerx", "女優達", ""], "s string", F.col("s").rlike(p)) == [True, False, True, True, True, False]
    assert values(spark, ["", "x"], "s string", F.col("s").rlike(text.terms_pattern([]))) == [False, False]


def test_subsequence(spark):
    rows = [("abc", "abc"), ("ac", "abc"), ("", "abc"), ("abc", "ab"), ("ba", "abc"), ("三体", "【广告】三体 第二季")]
    assert values(spark, rows, "a string, b string", text.is_subsequence(F.col("a"), F.col("b"))) == [True, True, True, False, False, True]


def test_accepted_titles(spark):
    rows = [
        ("{get it at depot.invalid} ~ Harbour Lights", "- Harbour Lights", "Harbour Lights"),  # marks at the ends go
        ("Copper Kettle depot.invalid uncut", "Copper Kettle   uncut", "Copper Kettle uncut"),  # the middle goes, runs of blanks are one
        ("Nine Grey Geese", "Nine Grey Geese", ""),  # nothing went
        ("Nine Grey Geese", "Nine  Grey Geese ", ""),  # nothing but blanks went
        ("Nine Grey Geese", "Geese Nine", ""),  # another order
        ("Nine Grey Geese", "Nine Grey Geese at Sea", ""),  # something came
        ("Nine Grey Geese", " \t ", ""),
        ("A lantern that hangs over the slowest river", "A la", ""),  # under a quarter
        ("ninety", "nin", ""),  # under four characters
        ("ninety", "nine", "nine"),
        ("g" * 201, "g" * 150, ""),  # too long to begin with
        ("p q", None, ""),
    ]
    assert values(spark, [r[:2] for r in rows], "a string, b string", text.accepted_title(F.col("a"), F.col("b"))) == [r[2] for r in rows]


def test_original_name(spark):
    rows = [
        ("灯塔1987 (1987)", "灯塔1987", ""),  # no Latin letter is left
        ("风铃草 The Bluebell 3‎ (2011)", "风铃草", "The Bluebell 3"),
        ("Q号码头 Pier Q\u200b (1999)", "Q号码头", "Pier Q"),
        ("雨 Rain on Slate (2016)", "not its title", "Rain on Slate"),  # what follows the last character of another script
        ("かぜ Wind 한 Two", "", "Two"),
        ("风铃草 (2011)", "风铃草", ""),
        ("Plain Name", "Plain Name", ""),
        ("Plain Name", "none", "Plain Name"),
    ]
    assert values(spark, [r[:2] for r in rows], "a string, b string", text.original_name(F.col("a"), F.col("b"))) == [r[2] for r in rows]


def test_valid_keys(spark):
    ok = "".join(f"{(7 * i + 3) % 16:x}" for i in range(40))
    rows = {ok: True, ok.swapcase(): True, "f" * 40: True, "0" * 39 + "8": True, "0" * 40: False, "": False, ok[1:]: False, ok * 2: False, "g" + ok[1:]: False, f" {ok}": False, f"{ok}\n": False}
    assert values(spark, [*rows, None], "s string", keys.valid_key(F.col("s"))) == [*rows.values(), False]


def test_host_port(spark):
    assert values(spark, ["udp://t.example:80/announce", "http://x/", "udp:///a", "UDP://u@h:1?x"], "s string", keys.host_port(F.col("s"))) == ["t.example:80", None, None, "h:1"]


def test_interval(spark):
    assert values(spark, [None, 1, 86400, 300, 0, -5], "s bigint", keys.interval(F.col("s"))) == [900, 60, 7200, 300, 900, 900]


OUTER, OTHER = "192.0.2.44", "192.0.2.45"


@pytest.mark.parametrize(
    ("remote", "xff", "real", "want"),
    [
        (f"{OUTER}:5", OTHER, OTHER, OUTER),  # what a public peer forwards isn't believed
        ("10.1.2.3:5", OTHER, "", OTHER),
        ("172.20.0.9:5", f"{OUTER} , {OTHER}", "", OTHER),  # the last hop that isn't our own
        ("192.168.7.7:5", f"{OTHER},169.254.1.1,172.31.0.1", "", OTHER),
        ("[::1]:5", f"{OTHER}, unknown, 10.9.9.9", "", "::/64"),  # an unreadable hop ends the search
        ("[fd00::7]:5", "", f" {OTHER} ", OTHER),
        ("10.1.2.3:5", "10.1.1.1, 10.1.1.2", "nothing", "10.1.2.3"),
        ("[2001:db8:aa:bb:1::9]:5", "", "", "2001:db8:aa:bb::/64"),
        (f"[::ffff:{OUTER}]:5", "", "", OUTER),
        ("10.1.2.3:5", "2001:db8:1::1", "", "2001:db8:1::/64"),
        ("no address", "", "", "no address"),
    ],
)
def test_client_keys(remote, xff, real, want):
    assert requests.key_of(remote, xff, real) == want
