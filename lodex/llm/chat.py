"""Chat formatting in DataFrame functions only: turns become marked text in windows of a token budget.

The template writes a turn as <s>[MARK] text [/MARK]</s>. Backslashes in texts are doubled and a backslash and a dot go
into every control string, so no text looks like a mark and every text can be read back. Prefix sums of turn tokens
choose the windows: a window takes the turns that lie wholly within one stretch of the budget, and the turn across a
stretch's end where it still fits, else that turn has a window of its own. Windows after the first repeat the
conversation's system turn and the last turns before them, up to a number of turns and tokens; in what is repeated no
text is a target. Prefix sums run over the parts of a range partitioning first, without the texts, so a conversation of
any length, or with any turn numbers, is never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodex.llm.common import stored

#: Tokens (words and marks) of a window and of the repeated turns, the number of those, and a turn's own tokens.
BUDGET, HISTORY, HISTORY_TURNS, TURN_TOKENS = 2048, 256, 2, 8
# The roles' marks; other roles have ROLE and their name, URL-escaped.
MARKS = {"system": "SYS", "user": "INST", "assistant": "OUT"}
_CONTROL = r"(?=/?s>|/?(?:SYS|INST|OUT)\]|/?ROLE[:\]])"
_TURN = r"(?s)<s>\[(SYS|INST|OUT|ROLE:[^\]]*)\] (.*?) \[/(?:SYS|INST|OUT|ROLE)\]</s>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"([<\[])" + _CONTROL, r"$1\\.")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:(\\)|\.)", "$1")


def tokens(text: Column) -> Column:
    """Words and single marks of a text, and those of the turn's template."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]")) + TURN_TOKENS


def prefix_sums(rows: DataFrame, by: str, part: str, order: list, values: dict[str, Column], first: dict[str, str] | None = None) -> DataFrame:
    """Adds the sums of `values` (by name) over the rows of `by` up to and with each, in order of `part` and then `order`, and
    what the first of these rows has in columns, by name. Parts are summed first; only a conversation's parts, not its
    turns, come together."""
    up_to = Window.partitionBy(by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.withColumns({n: F.sum(v).over(up_to) for n, v in values.items()})
    before = Window.partitionBy(by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    head = F.struct(*(F.col(c).alias(n) for n, c in (first or {"_": by}).items()))
    parts = rows.groupBy(by, part).agg(*(F.sum(v).alias(n) for n, v in values.items()), F.min_by(head, F.struct(*order)).alias("_head"))
    of_all = F.first("_head").over(Window.partitionBy(by).orderBy(part))
    parts = parts.select(F.col(by).alias("_by"), F.col(part).alias("_part"), of_all.alias("_head"), *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in values))
    joined = inner.join(parts, inner[by].eqNullSafe(parts["_by"]) & (inner[part] == parts["_part"]))
    found = {n: F.col(n) + F.col(f"_{n}") for n in values} | {n: F.col("_head")[n] for n in first or {}}
    return joined.withColumns(found).drop("_by", "_part", "_head", *(f"_{n}" for n in values))


def windows(conversations: DataFrame, id_col: str = "conv_id", budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """`id_col`, window (from 0), n_repeated (turns at its head that other windows have, too), tokens, formatted, and loss
    (ranges of code points, end exclusive: the assistant texts of turns that aren't repeated).

    A turn alone over the budget has a window of its own, whole. Null texts are as empty ones, null roles as the role
    ''. Turns are in order of turn, role and a hash of the text, null turns first, repeated rows stay repeated; rows with a
    null id are one conversation. An empty table gives an empty result; further columns are left out. Where `id_col` is named
    like an added column, it takes its place.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    texts = conversations.select(F.col(id_col).alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn"), role.alias("role"), text.alias("text"))
    texts = stored(texts.withColumns({"tie": F.xxhash64("text"), "n": tokens(F.col("text")).cast("long"), "row": F.monotonically_increasing_id()}), "texts")
    order = ["conv", "turn", "role", "tie", "row"]
    slim = texts.select(*order, "n").repartitionByRange(*order).sortWithinPartitions(*order)
    slim = stored(slim.withColumn("part", F.spark_partition_id()), "turns")  # the parts lie in the conversations' order
    rows = prefix_sums(slim, "conv", "part", order[1:], {"place": F.lit(1).cast("long"), "sum": F.col("n")}, {"head_role": "role", "head": "row", "head_n": "n"})
    if_system = lambda c: F.when(F.col("head_role") == "system", F.col(c))
    rows = stored(rows.select("conv", "part", "place", "sum", "role", "row", "n", if_system("head").alias("system"), if_system("head_n").alias("system_n")), "sums")
    stretch = F.greatest(F.lit(budget - history) - F.coalesce("system_n", F.lit(0)), F.lit(budget // 4)).cast("long")
    rows = rows.withColumn("stretch", stretch).withColumn("first", F.floor((F.col("sum") - F.col("n")) / F.col("stretch"))).withColumn("last", F.floor((F.col("sum") - 1) / F.col("stretch")))
    whole = rows.where("first = last").groupBy(F.col("conv").alias("_conv"), F.col("first").alias("_first")).agg(F.sum("n").alias("inner"))
    rows = rows.join(whole, rows["conv"].eqNullSafe(whole["_conv"]) & (rows["first"] == whole["_first"]), "left").drop("_conv", "_first")
    alone = (F.col("first") < F.col("last")) & (F.coalesce("inner", F.lit(0)) + F.col("n") > F.col("stretch"))
    rows = stored(rows.select("conv", "part", "place", "role", "row", "n", "system", "system_n", (2 * F.col("first") + alone.cast("int")).alias("key")), "keys")
    # A window begins where the key differs from the turn before's; parts meet through the places.
    before = rows.select(F.col("conv").alias("_conv"), (F.col("place") + 1).alias("_place"), F.col("key").alias("_key"))
    rows = rows.join(before, rows["conv"].eqNullSafe(before["_conv"]) & (rows["place"] == before["_place"]), "left").drop("_conv", "_place")
    rows = prefix_sums(rows, "conv", "part", ["place"], {"window": (~F.col("key").eqNullSafe(F.col("_key"))).cast("long")})
    rows = stored(rows.select("conv", "place", "role", "row", "n", "system", "system_n", (F.col("window") - 1).alias("window")), "windows")
    own = rows.select("conv", "window", F.lit(False).alias("repeated"), "place", "row", "n")
    back = Window.partitionBy("conv", "window").orderBy(F.desc("place"))
    tail = rows.withColumn("_rank", F.row_number().over(back)).withColumn("_sum", F.sum("n").over(back)).where((F.col("_rank") <= history_turns) & (F.col("_sum") <= history) & (F.col("role") != "system"))
    heads = rows.groupBy(F.col("conv").alias("_conv"), F.col("window").alias("_window")).agg(F.max("system").alias("_system"), F.max("system_n").alias("_n")).where("_window > 0")  # each row knows its conversation's system turn
    tail = tail.withColumn("window", F.col("window") + 1)
    tail = tail.join(heads, tail["conv"].eqNullSafe(heads["_conv"]) & (tail["window"] == heads["_window"]), "left_semi").select("conv", "window", F.lit(True).alias("repeated"), "place", "row", "n")
    kept = heads.where("_system is not null").select(F.col("_conv").alias("conv"), F.col("_window").alias("window"), F.lit(True).alias("repeated"), F.lit(0).cast("long").alias("place"), F.col("_system").alias("row"), F.col("_n").alias("n"))
    # Only now, with the windows known, do the texts move.
    all_turns = own.unionByName(tail).unionByName(kept).join(texts.select("row", "role", "text"), "row")
    mark = F.lit(None).cast("string")
    for r, m in MARKS.items():
        mark = F.when(F.col("role") == r, F.lit(m)).otherwise(mark)
    open_, close = F.concat(F.lit("<s>["), F.coalesce(mark, F.concat(F.lit("ROLE:"), F.url_encode("role"))), F.lit("] ")), F.concat(F.lit(" [/"), F.coalesce(mark, F.lit("ROLE")), F.lit("]</s>"))
    pieces = all_turns.withColumn("body", escaped(F.col("text"))).withColumn("open", open_).withColumn("piece", F.concat("open", "body", close))
    order = Window.partitionBy("conv", "window").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("at", F.coalesce(F.sum(F.length("piece").cast("long")).over(order), F.lit(0)) + F.length("open"))
    loss = F.when((F.col("role") == "assistant") & ~F.col("repeated"), F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end")))
    out = pieces.groupBy("conv", "window").agg(
        F.count_if("repeated").alias("n_repeated"),
        F.sum("n").alias("tokens"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda p: p["piece"]), "").alias("formatted"),
        F.array_sort(F.collect_list(loss)).alias("loss"),
    )
    return out.select(F.col("conv").alias(id_col), *(c for c in out.columns[1:] if c.lower() != id_col.lower()))


def read_back(formatted: DataFrame) -> DataFrame:
    """The columns of windows() and turns (array of role and text of turns that aren't repeated) and target (the text under
    the loss mask, unescaped), both read from the formatted text alone and the numbers beside it."""
    roles, bodies = F.regexp_extract_all("formatted", F.lit(_TURN), 1), F.regexp_extract_all("formatted", F.lit(_TURN), 2)
    named = lambda m: F.when(m == "SYS", "system").when(m == "INST", "user").when(m == "OUT", "assistant").otherwise(F.url_decode(F.substr(m, F.lit(6))))
    turns = F.transform(F.arrays_zip(roles.alias("role"), bodies.alias("text")), lambda t: F.struct(named(t["role"]).alias("role"), unescaped(t["text"]).alias("text")))
    spans = F.transform("loss", lambda s: unescaped(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumns({"turns": F.slice(turns, (F.col("n_repeated") + 1).cast("int"), F.greatest(F.size(turns) - F.col("n_repeated").cast("int"), F.lit(0))), "target": F.array_join(spans, "")})


def report(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The digest of windows(): per conversation the number and hash of the turns read back, the characters and hash of the
    targets, and the characters of all windows. A hash over a whole conversation needs its text in one place."""
    read = read_back(formatted)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    whole = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window", c.alias("said")))), lambda w: w["said"]), "")
    out = read.groupBy(id_col).agg(F.sum(F.size("turns")).alias("n_turns"), whole(told).alias("told"), whole(F.col("target")).alias("target"), F.sum(F.length("formatted").cast("long")).alias("formatted_chars"))
    return out.select(id_col, F.col("n_turns").cast("long").alias("n_turns"), F.sha2("told", 256).alias("turns_sha256"), F.length("target").cast("long").alias("loss_chars"), F.sha2("target", 256).alias("loss_sha256"), "formatted_chars")
