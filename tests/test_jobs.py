"""Jobs over small tables: what happens twice, ties, empty tables, and what the streams share with the batch forms."""

import random

import pytest
from pyspark.sql import functions as F

from lodex.operators import charts, merge, rank, requests, review, rules, schedule, search, stats
from lodex.plans import jobs
from lodex.sources import shared
from lodex.sources import tables as T
from lodex.streaming import jobs as streams

SCHEMA = ", ".join(f"{c} {k}" for c, k in T.LISTING.items())


def listings(spark, *rows):
    """Rows (hash, name, created_at[, size[, files]])."""
    full = [(h, n, (r + [700 << 20])[0] if r else 700 << 20, 1, [(f, 1) for f in (r[1] if len(r) > 1 else ["f"])], at, 0, "") for h, n, at, *r in rows]
    return spark.createDataFrame(full, SCHEMA)


def blocked(spark, *keys):
    return spark.createDataFrame([(k, "old", "", 0) for k in keys], "info_hash string, reason string, name string, created_at long")


def keys(df):
    return [r.info_hash for r in df.collect()]


def test_search(spark):
    rows = listings(spark, ("aa", "Big Buck Bunny", 100), ("bb", "100 per cent", 200), ("cc", "Sintel", 300))
    assert keys(search.search(rows, "")) == ["cc", "bb", "aa"]
    assert keys(search.search(rows, "bunny BIG")) == ["aa"]
    assert keys(search.search(rows, "100%")) == []
    assert keys(search.search(rows, "", 2, 2)) == ["aa"]
    assert keys(search.search(rows, "", 0, 0)) == ["cc"]


def test_search_meets_raw_and_clean_names(spark):
    rows = merge.set_clean_names(listings(spark, ("aa", "[site] Bloods", 1)), spark.createDataFrame([("aa", "Bloods 1080p")], "info_hash string, clean string"))
    got = search.search(rows, "site 1080p").first()
    assert got.name == "Bloods 1080p" and rows.first().name == "[site] Bloods"


def test_page_parameters(spark):
    asked = spark.createDataFrame([(1, "x", "99999999", "100"), (2, "x", "0", "0"), (3, "x", "no", None), (4, "x", "2", "7")], "query_id long, q string, page string, page_size string")
    assert [(r.page, r.page_size) for r in search.page_parameters(asked).orderBy("query_id").collect()] == [(101, 100), (1, 20), (1, 20), (2, 7)]


def test_search_batch_equals_search(spark):
    rows = listings(spark, *((f"{i:02}", f"name {i % 3}", i) for i in range(30)))
    asked = spark.createDataFrame([(1, "NAME 1", "2", "3"), (2, "none", None, None)], "query_id long, q string, page string, page_size string")
    got = search.search_batch(rows, asked).orderBy("place").collect()
    assert [r.info_hash for r in got] == keys(search.search(rows, "name 1", 2, 3)) and {r.total for r in got} == {10}


RULES = rules.Rules(terms=("av", "badword"), name_terms=("banner",), exceptions=("badword family",), domain=r"[a-z]+\.xyz", strong=r"\bssis-\d{3}", weak=r"[A-Z]{3,5}-\d{3}")


@pytest.mark.parametrize(
    ("name", "files", "size", "category", "spam", "small"),
    [
        ("Ubuntu 24.04", ["u.iso"], 700 << 20, False, False, False),
        ("a badword", ["f"], 700 << 20, True, False, False),
        ("The Badword Family", ["f"], 700 << 20, False, False, False),
        ("have", ["dir/badword.txt"], 700 << 20, True, False, False),
        ("see banner", ["f"], 700 << 20, True, False, False),
        ("fine", ["banner.txt"], 700 << 20, False, False, False),
        ("ABC-123 fine", ["f"], 700 << 20, False, False, False),
        ("SSIS-123 fine", ["f"], 700 << 20, True, False, False),
        ("movie movie movie movie", ["f"], 700 << 20, False, True, False),
        ("  ", ["f"], 700 << 20, False, True, False),
        ("!!!", ["f"], 700 << 20, False, True, False),
        ("fine", ["f"], 0, False, True, False),
        ("fine", ["f"], 30 << 40, False, True, False),
        ("a" * 301, ["f"], 700 << 20, False, True, False),
        ("fine", [f"bcdfghjklmnpqrstvwx{i}" for i in range(10)], 700 << 20, False, True, False),
        ("fine", ["f"], 99 << 20, False, False, True),
        ("fine", ["f"], 100 << 20, False, False, False),
    ],
)
def test_rules(spark, name, files, size, category, spam, small):
    r = rules.screened(listings(spark, ("aa", name, 1, size, files)), RULES).first()
    assert (r.category, r.spam, r.too_small, r.rejected) == (category, spam, small, category or spam or small), r.reasons


def test_reasons_follow_the_rules_order(spark):
    r = rules.screened(listings(spark, ("aa", "badword x x x.xyz ABC-123", 1, 0, ["badword", "av"])), RULES).first()
    assert r.reasons == ["name-term:badword", "file-term:badword", "file-term:av", "weak", "no-size"] and r.route == "filtered_category"


def test_insert_is_idempotent_and_minds_the_block_list(spark):
    new, bad = listings(spark, ("aa", "first", 2), ("aa", "second", 3), ("bb", "x", 1)), blocked(spark, "bb")
    once = merge.insert_ignore(listings(spark), new, bad)
    assert [(r.info_hash, r.name) for r in once.collect()] == [("aa", "first")]
    assert merge.insert_ignore(once, new, bad).count() == 1


def test_not_in_minds_nulls(spark):
    rows, none = listings(spark, ("aa", "x", 1), (None, "y", 2)), blocked(spark)
    assert sorted(keys(merge.not_in(rows, blocked(spark, "bb")))) == ["aa"]
    assert merge.not_in(rows, blocked(spark, "bb", None)).count() == 0
    assert merge.not_in(rows, none).count() == 2


def test_block_counts_what_went_and_keeps_reasons(spark):
    rejects = spark.createDataFrame([("aa", "new", "n"), ("zz", "new", "n"), ("aa", "other", "n")], "info_hash string, reason string, name string")
    left, grown, removed = merge.block(listings(spark, ("aa", "x", 1), ("bb", "y", 2)), blocked(spark, "zz"), rejects, 9)
    assert keys(left) == ["bb"] and removed.first().removed == 1 and {r.info_hash: r.reason for r in grown.collect()} == {"aa": "new", "zz": "old"}
    with pytest.raises(ValueError):
        merge.paired(spark, ["a", "b"], ["x"], "spam")


def test_delta_mark_is_strict_unless_told(spark):
    rows = listings(spark, ("aa", "x", 1), ("bb", "y", 2), ("cc", "z", 2))
    assert merge.delta(rows, 2).count() == 0 and merge.delta(rows, 2, inclusive=True).count() == 2


def test_sync_twice(spark, tmp_path):
    source, bad = listings(spark, ("aa", "x", 1), ("bb", "y", 2)), blocked(spark, "bb")
    listings(spark).write.parquet(f"{tmp_path}/t/v=0")
    args = (f"{tmp_path}/t", bad, f"{tmp_path}/mark")
    assert jobs.sync_once(spark, source, args[0], 0, *args[1:]) == 1
    assert jobs.sync_once(spark, source, args[0], 1, *args[1:]) == 1 and jobs.read_mark(spark, args[2]) == 2
    assert keys(spark.read.schema(SCHEMA).parquet(f"{tmp_path}/t/v=1")) == ["aa"]


def test_old_tables_are_upgraded(spark):
    old = spark.createDataFrame([("aa", "x", 1, 2, '[{"path":"p","size":3}]', 4), ("bb", "x", 1, 2, "", 4)], "info_hash string, name string, total_size long, file_count int, files_json string, created_at long")
    rows = {r.info_hash: r for r in T.upgraded(old).collect()}
    assert rows["aa"].files[0].path == "p" and rows["bb"].files == [] and rows["aa"].reviewed_at == 0 and rows["aa"].clean_name == ""
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        T.upgraded(old.withColumn("files_json", F.lit("[{"))).collect()


def test_snapshot_is_published_whole(spark, tmp_path):
    got = merge.snapshot(listings(spark, ("aa", "x", 1)), f"{tmp_path}/s").first()
    assert got.n == 1 and got.verified and merge.read_snapshot(spark, f"{tmp_path}/s", SCHEMA).count() == 1
    merge.snapshot(listings(spark, ("aa", "x", 1), ("bb", "y", 1)), f"{tmp_path}/s")
    assert merge.read_snapshot(spark, f"{tmp_path}/s", SCHEMA).count() == 2
    assert merge.fingerprint(listings(spark, ("aa", "x", 1), ("aa", "x", 1))).drop("n").first() != merge.fingerprint(listings(spark)).drop("n").first()


def test_journal_lines(spark):
    lines = spark.createDataFrame([('10:00 adult ' + "ab" * 20 + ' "a title"',), ("other",)], "value string")
    assert [tuple(r) for r in T.parsed_journal(lines).collect()] == [("adult", "ab" * 20, "a title")]


def test_kept_files(spark):
    r = T.kept_files(listings(spark, ("aa", "x", 1, 5, [str(i) for i in range(60)]))).first()
    assert r.file_count == 60 and len(r.files) == 50


def test_ranking(spark):
    given = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "hash string")
    replies = spark.createDataFrame([("a", 2), ("b", 40), ("b", None), ("c", 900), ("d", None)], "hash string, seeders int")
    best = rank.best_seeders(given, replies)
    assert {r.hash: r.seeders for r in best.collect()} == {"a": 2, "b": 40, "c": 900, "d": 0}
    assert rank.rank_counters(best, replies, 3).first().asDict() == {"scraped": 4, "seeded": 3, "evicted": 1, "errors": 2}
    assert rank.rank_counters(best, replies).first().evicted == 0


def test_queue_is_stable_and_evicts(spark):
    rows = spark.createDataFrame([("a", 5, 1), ("b", 9, 2), ("c", 5, 3), ("d", 3, 4)], "hash string, seeders int, seq int")
    assert [r.hash for r in rank.queue(rows, None, 3).collect()] == ["b", "a", "c"] and [r.hash for r in rank.evicted(rows, 3).collect()] == ["d"]


def test_answers_are_aligned(spark):
    asked = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["d"])], "batch_id int, hashes array<string>")
    given = spark.createDataFrame([(1, [7]), (2, [8, 9])], "batch_id int, seeders array<int>")
    assert {r.hash: r.seeders for r in rank.aligned(asked, given).collect()} == {"a": 7, "b": 0, "c": 0, "d": 8}


def test_no_tracker_is_an_error(spark):
    urls = spark.createDataFrame([("http://x/",)], "url string")
    with pytest.raises(ValueError):
        rank.some_host(rank.tracker_hosts(urls))


def test_numbered(spark):
    rows = rank.numbered(spark.range(205).select(F.col("id").alias("v")), [F.desc("v")], 100)
    got = {r.v: (r.batch, r.i) for r in rows.collect()}
    assert got[204] == (0, 1) and got[105] == (0, 100) and got[104] == (1, 1) and got[0] == (2, 5)
    assert "ExistingRDD" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rank.numbered(spark.range(0), [F.col("id")], 7).count() == 0
    same = rank.numbered(spark.range(30).select(F.lit(1).alias("v"), "id"), [F.col("v")], 7)
    assert sorted((r.batch, r.i) for r in same.collect()) == [(k // 7, k % 7 + 1) for k in range(30)]


VERDICT = '```json\n[{"i":1,"label":" Spam "},{"i":1,"label":"ok"},{"i":2,"label":"odd","clean":"x"},{"i":99,"label":"adult"},{"i":2,"label":"ok","clean":"Jungle Book"}]\n```'


def test_verdicts_and_review(spark):
    rows = listings(spark, ("aa", "bad", 1), ("bb", "[x] Jungle Book", 2), ("cc", "late", 3))
    replies = spark.createDataFrame([(0, VERDICT), (1, "not json")], "batch_id long, content string")
    judged = review.judged(review.sweep(rows, 0, 2), review.verdicts(replies), replies)
    assert {r.info_hash: (r.label, r.clean) for r in judged.collect()} == {"aa": ("spam", ""), "bb": ("ok", "Jungle Book")}
    out = review.apply(rows, blocked(spark), judged, 9)
    assert {r.info_hash: (r.reviewed_at, r.clean_name) for r in out.listings.collect()} == {"bb": (9, "Jungle Book"), "cc": (0, "")}
    assert keys(out.blocked) == ["aa"] and out.summary.first().asDict() == {"reviewed": 2, "adult": 0, "spam": 1, "trimmed": 1}
    assert sorted(r.kind for r in out.audit.collect()) == ["spam", "trim"]
    dry = review.apply(rows, blocked(spark), judged, 9, dry_run=True)
    assert dry.listings.where("reviewed_at = 9 and clean_name = ''").count() == 2 and dry.blocked.count() == 0


def test_a_sweep_stops_at_the_first_failed_batch(spark):
    rows = listings(spark, *((f"{i:02}", f"[x] Name number {i}", i) for i in range(6)))
    reply = '[{"i":1,"label":"spam"}]'
    replies = spark.createDataFrame([(0, reply), (1, "error"), (2, reply)], "batch_id long, content string")
    out = jobs.review_once(rows, blocked(spark), replies, 9, 0)
    assert out.summary.first().reviewed == 6 and keys(out.blocked) == ["00"]  # one batch of a hundred
    judged = review.judged(review.sweep(rows, 0, 2), review.verdicts(replies), replies)
    assert sorted(keys(judged)) == ["00", "01"]
    late = replies.where("batch_id = 0")  # no reply at all is a failure, too
    assert sorted(keys(review.judged(review.sweep(rows, 0, 2), review.verdicts(late), late))) == ["00", "01"]
    assert review.judged(review.sweep(rows, 0, 2), review.verdicts(replies.where("batch_id > 0")), replies.where("batch_id > 0")).count() == 0


def test_audit_rows_are_appended_once(spark, tmp_path):
    rows = spark.createDataFrame([("spam", "aa", "t", "", False)], "kind string, info_hash string, title string, clean string, dry_run boolean")
    for run in (1, 2, 2):
        review.append_audit(rows, f"{tmp_path}/audit", run)
    assert sorted(r.run for r in review.audit_log(spark, f"{tmp_path}/audit").collect()) == [1, 2]


def test_term_lists(spark, tmp_path):
    (tmp_path / "terms.txt").write_text("  One term\t\n\nsecond\n\u3000second\n")
    assert T.term_list(spark, str(tmp_path / "terms.txt")) == ("One term", "second")
    assert T.terms_of(spark.createDataFrame([("b",), ("a",), (None,)], "term string")) == ("a", "b")
    with pytest.raises(ValueError):
        T.term_list(spark, str(tmp_path / "terms.txt"), 1)


@pytest.mark.parametrize("q", ["The AND", "a\x1cb c", "a\u3000B\x85c\u2003d e f g h i", "é" * 120 + " x", "x " * 150, "", "\u200b y"])
def test_query_words_are_those_of_a_batch(spark, q):
    asked = spark.createDataFrame([(1, q, None, None)], "query_id long, q string, page string, page_size string")
    assert search.query_words(q) == search.page_parameters(asked).first().words


def test_differences_over_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(n, t, 10 * t + t % 3) for n in ("a", "b", None) for t in range(60)] + [("a", 5, 90), ("c", 1, 4)]
        got = stats.differences(spark.createDataFrame(rows, "name string, ts int, value long").repartition(5))
        want, last = [], {}
        for n, t, v in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
            want.append((n, t, v - last.get(n, 0)))
            last[n] = v
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_counters(spark):
    deltas = spark.createDataFrame([("seen", 3), ("seen", 2)], "key string, delta long")
    assert stats.totals(deltas).first().value == 5 and stats.as_map(stats.totals(deltas)).first().stats == {"seen": 5}
    readings = spark.createDataFrame([("a", 1, 5), ("a", 2, 9)], "name string, ts int, value long")
    assert [r.delta for r in stats.differences(readings).orderBy("ts").collect()] == [5, 4]
    assert stats.shares(stats.totals(deltas), ["no", "none"], ("seen", "no")).first()[2] is None


def test_charts_keep_the_last_good_list(spark):
    old = spark.createDataFrame([("a", 1, 1, "old", 1), ("b", 1, 2, "old", 1)], "chart string, place int, id int, title string, updated_at long")
    new = old.where("chart = 'a'").drop("updated_at").withColumn("title", F.lit("new"))
    got = charts.keep_last(old, new, 5)
    assert {(r.chart, r.title, r.updated_at) for r in got.collect()} == {("a", "new", 5), ("b", "old", 1)}
    assert {r.chart: r.titles for r in charts.lists(got, ["a", "b", "c"]).collect()} == {"a": ["new"], "b": ["old"], "c": []}


def test_due_nodes(spark):
    obs = spark.createDataFrame([("a", 1, 1000, 300), ("a", 1, 2000, None), ("b", 0, 1, 1), ("c", 1, 5000, 1)], "addr string, port int, ts long, interval_s long").withColumn("ts", F.timestamp_seconds("ts"))
    assert {r.addr: r.next_due for r in schedule.next_due(obs).collect()} == {"a": 2900, "c": 5060}
    assert [r.addr for r in schedule.due(obs, 3000).collect()] == ["a"]


def test_a_run_clears_its_own_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_dir", lambda spark: str(tmp_path))
    (tmp_path / "lodex-other").mkdir()
    held = shared.stored(spark.range(3), "x")
    assert held.count() == 3 and len(list(tmp_path.iterdir())) == 2 and shared.folders(spark, str(tmp_path), "lodex-other")
    shared.clear(spark)
    assert [p.name for p in tmp_path.iterdir()] == ["lodex-other"] and shared.stored(spark.range(2), "x").count() == 2
    shared.clear(spark)
    shared.clear(spark)


LOG = [("a", 1000), ("a", 1000), ("a", 1000), ("a", 1001), ("a", 1001), ("b", 1000)]


def test_bucket_audit(spark):
    log = spark.createDataFrame(LOG, "client string, t long").select("client", F.timestamp_seconds("t").alias("ts"))
    assert {r.client: (r.allowed, r.rejected) for r in requests.bucket_audit(log, 1.0, 2.0).collect()} == {"a": (3, 2), "b": (1, 0)}
    idle = spark.createDataFrame([("a", 0), ("a", 0), ("a", 0), ("a", 601)], "client string, t long").select("client", F.timestamp_seconds("t").alias("ts"))
    assert requests.bucket_audit(idle, 0.0, 2.0, 600.0).first().allowed == 3 and requests.bucket_audit(idle, 0.0, 2.0, None).first().allowed == 2


def test_bucket_audit_of_odd_logs(spark):
    log = spark.createDataFrame([("hot", t) for t in range(3000)] + [(None, 1), (None, 1), ("x", None)], "client string, t long").select("client", F.timestamp_seconds("t").alias("ts"))
    got = {r.client: (r.allowed, r.rejected) for r in requests.bucket_audit(log.repartition(6), 0.5, 1.0).collect()}
    assert got == {"hot": (1500, 1500), None: (1, 1)} and requests.bucket_audit(log.where("false")).count() == 0


def plain_audit(log, rate, burst, idle=None):
    """client → (allowed, rejected), one request after the other."""
    out, state = {}, {}
    for c, t in sorted(log, key=lambda r: (str(r[0]), r[1])):
        tokens, last = state.get(c, (burst, None))
        tokens = requests.level(tokens, last, t, rate, burst, idle)
        yes = tokens >= 1
        state[c] = (tokens - yes, t)
        a, b = out.get(c, (0, 0))
        out[c] = (a + yes, b + (not yes))
    return out


@pytest.mark.parametrize("idle", [None, 40.0])
def test_bucket_sections_over_ranges(spark, idle):
    rng = random.Random(5)
    log, t = [], 0.0
    for c in ("hot", None, "b"):
        for _ in range(4000 if c == "hot" else 200):
            t += rng.choice([0, 0, 0.125, 0.5, 1, 3]) if rng.random() < 0.97 else rng.choice([9, 10, 11, 45, 100])
            log.append((c, t))
        t = 0.0
    log += [("steady", 0.25 * i) for i in range(3000)]  # one section over many parts
    given = spark.createDataFrame(log, "client string, t double").select("client", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("ts")).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.client: (r.allowed, r.rejected) for r in requests.bucket_audit(given, 0.5, 5.0, idle).collect()}
        parts = requests.sections(given.select("client", F.col("ts").cast("double").alias("t")), 0.5, 5.0, idle)
        of = {(r.client, r.part, r.section) for r in parts.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain_audit(log, 0.5, 5.0, idle)
    assert sum(c == "hot" for c, *_ in of) > 50 and sum(c == "steady" for c, *_ in of) == 1


def test_a_million_requests_of_one_client(spark):
    t = F.col("id") * 0.25 + F.floor(F.col("id") / 1000) * 60
    log = spark.range(0, 1_000_000, 1, 4).select(F.lit("hot").alias("client"), F.timestamp_micros((t * 1_000_000).cast("long")).alias("ts"))
    got = requests.bucket_audit(log, 1.0, 10.0, None).first()
    assert (got.allowed, got.rejected) == tuple(1000 * n for n in plain_audit([("x", 0.25 * i) for i in range(1000)], 1.0, 10.0)["x"])


def files(spark, tmp_path, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in")


def test_bucket_stream_over_batches_equals_the_audit(spark, tmp_path):
    log = files(spark, tmp_path, [LOG[:3], LOG[3:]], "client string, t long").select("client", F.timestamp_seconds("t").alias("ts"))
    got = {}

    def take(batch, _):
        for r in batch.collect():
            a, b = got.get(r.client, (0, 0))
            got[r.client] = (a + r.allowed, b + r.rejected)

    streams.buckets(log, 1.0, 2.0).writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    assert got == {"a": (3, 2), "b": (1, 0)}


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.mark.parametrize("idle", [None, 40.0])
def test_bucket_stream_of_many_clients_in_any_state_store(spark, tmp_path, idle):
    rng = random.Random(3)
    log = sorted(((rng.choice([None, *range(300)]), rng.randrange(1000, 1900)) for _ in range(6000)), key=lambda r: r[1])
    rows = files(spark, tmp_path, [log[i : i + 1500] for i in range(0, 6000, 1500)], "client long, t long").select("client", F.timestamp_seconds("t").alias("ts"))
    got, own = {}, spark.conf.get(PROVIDER)

    def take(batch, _):
        for r in batch.collect():
            a, b = got.get(r.client, (0, 0))
            got[r.client] = (a + r.allowed, b + r.rejected)

    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        streams.buckets(rows, 0.02, 2.0, idle).writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.set(PROVIDER, own)
    assert got == plain_audit(log, 0.02, 2.0, idle)


def test_rank_stream_merges_batches(spark, tmp_path):
    rows = files(spark, tmp_path, [[("a", 5, 1), ("b", 9, 2)], [("c", 7, 3), ("d", 1, 4)]], "hash string, seeders int, seq int")
    stream = streams.ranked(rows, f"{tmp_path}/out", f"{tmp_path}/c", 3)
    stream.awaitTermination(120)
    last = streams.drained(spark, f"{tmp_path}/out", "hash string, seeders int, seq int", stream.lastProgress["batchId"])
    assert [r.hash for r in last.collect()] == ["b", "c", "a"]


def test_rank_stream_hands_out_the_best_of_each_batch(spark, tmp_path):
    rows = files(spark, tmp_path, [[("a", 5, 1), ("b", 9, 2), ("c", 9, 3)], [("d", 7, 4), ("e", 1, 5)]], "hash string, seeders int, seq int")
    stream = streams.ranked(rows, f"{tmp_path}/out", f"{tmp_path}/c", 3, hand_out=1)
    stream.awaitTermination(120)
    n = stream.lastProgress["batchId"]
    assert {(r.hash, r.batch) for r in spark.read.parquet(f"{tmp_path}/out/out").collect()} == {("b", n - 1), ("c", n)}
    assert [r.hash for r in streams.drained(spark, f"{tmp_path}/out", "hash string, seeders int, seq int", n).collect()] == ["d", "a"]


def test_batch_stream_numbers_each_micro_batch(spark, tmp_path):
    rows = files(spark, tmp_path, [[(f"a{i}", i) for i in range(5)], [("b", 0)]], "hash string, seq int")
    streams.batched(rows, f"{tmp_path}/out", f"{tmp_path}/c", [F.col("seq")], 2, None).awaitTermination(120)
    got = sorted((r.hash, r.batch, r.i) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a0", 0, 1), ("a1", 0, 2), ("a2", 1, 1), ("a3", 1, 2), ("a4", 2, 1), ("b", 0, 1)]


def test_idle_clients_leave_the_state(spark, tmp_path):
    log = files(spark, tmp_path, [[("a", 1000)] * 3 + [("b", 1000)], [("c", 9000)], [("a", 9001), ("d", 9001)]], "client string, t long").select("client", F.timestamp_seconds("t").alias("ts"))
    got, held = {}, []

    def take(batch, _):
        for r in batch.collect():
            got.setdefault(r.client, []).append((r.allowed, r.rejected))

    stream = streams.buckets(log, 0.0, 2.0, 600.0).writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    stream.awaitTermination(120)
    held = [o["numRowsTotal"] for p in stream.recentProgress for o in p["stateOperators"]]
    assert got == {"a": [(2, 1), (1, 0)], "b": [(1, 0)], "c": [(1, 0)], "d": [(1, 0)]}
    assert held[-1] == 3  # of a, b, c and d


def test_bare_keys_are_indexed_without_rules(spark, tmp_path):
    rows = files(spark, tmp_path, [[("aa", 5), ("aa", 6)], [("aa", 7), ("zz", 8)]], "info_hash string, t long").select("info_hash", F.timestamp_seconds("t").alias("ts"))
    streams.index(streams.bare_records(rows), f"{tmp_path}/out", lambda s: blocked(s, "zz"), None, f"{tmp_path}/c").awaitTermination(120)
    assert [(r.info_hash, r.name, r.total_size, r.created_at) for r in spark.read.parquet(f"{tmp_path}/out/listing").collect()] == [("aa", "aa", 1, 5)]
    counts = {r.key: r.value for r in stats.totals(spark.read.schema("key string, delta long").parquet(f"{tmp_path}/out/counters")).collect()}
    assert counts == {"seen": 4, "inserted": 1}


def test_index_stream_inserts_once_over_batches(spark, tmp_path):
    row = lambda h, size: (h, "fine", size, 1, [("f", 1)], 1, 0, "")
    rows = files(spark, tmp_path, [[row("aa", 700 << 20), row("bb", 1)], [row("aa", 700 << 20), row("zz", 700 << 20)]], SCHEMA)
    streams.index(rows, f"{tmp_path}/out", lambda s: blocked(s, "zz"), RULES, f"{tmp_path}/c").awaitTermination(120)
    assert keys(spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out/listing")) == ["aa"]
    counts = {r.key: r.value for r in stats.totals(spark.read.schema("key string, delta long").parquet(f"{tmp_path}/out/counters")).collect()}
    assert counts == {"fetched": 3, "filtered_small": 1, "inserted": 1}


def test_index_stream_screens_one_file_in_many_tasks(spark, tmp_path, monkeypatch):
    row = lambda h: (h, "fine", 700 << 20, 1, [("f", 1)], 1, 0, "")
    rows, tasks, screened = files(spark, tmp_path, [[row(f"a{i}") for i in range(50)]], SCHEMA), [], streams.rules.screened
    monkeypatch.setattr(streams.rules, "screened", lambda batch, rule: tasks.append(batch.rdd.getNumPartitions()) or screened(batch, rule))
    streams.index(rows, f"{tmp_path}/out", lambda s: blocked(s, "a7"), RULES, f"{tmp_path}/c").awaitTermination(120)
    assert len(tasks) == 1 and tasks[0] >= 4
    assert len(keys(spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out/listing"))) == 49


def test_dedupe_stream(spark, tmp_path):
    rows = files(spark, tmp_path, [[("a", 1), ("a", 2)], [("a", 3), ("b", 4)]], "info_hash string, t long").select("info_hash", F.timestamp_seconds("t").alias("ts"))
    kept = streams.dedupe(rows)
    kept.writeStream.format("memory").queryName("kept").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(keys(spark.table("kept"))) == ["a", "b"]


def test_rank_discovered(spark):
    a, b, zero = "ab" * 20, "cd" * 20, "0" * 40
    given = spark.createDataFrame([(a, 1), (b, 2), (a, 3), (zero, 4), ("zz", 5)], "hash string, seq int")
    replies = spark.createDataFrame([(b, 4)], "hash string, seeders int")
    assert [(r.hash, r.seeders, r.seq) for r in jobs.rank_discovered(given, replies).collect()] == [(b, 4, 2), (a, 0, 1)]


def test_due_stream_over_batches(spark, tmp_path):
    rows = [[("a", 1, 100, False, None), ("a", 1, 130, False, None), ("b", 0, 100, False, None)], [("a", 1, 150, True, 300), ("a", 1, 170, False, None)], [("a", 1, 449, False, None), ("a", 1, 450, False, None)]]
    obs = files(spark, tmp_path, rows, "addr string, port int, t long, answered boolean, interval_s long").withColumn("ts", F.timestamp_seconds("t"))
    got = []
    streams.due_nodes(obs).writeStream.foreachBatch(lambda batch, _: got.extend((r.addr, r["at"]) for r in batch.collect())).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    assert got == [("a", 100.0), ("a", 450.0)]


def test_due_stream_of_many_nodes_in_any_state_store(spark, tmp_path):
    rng = random.Random(4)
    rows = sorted(((rng.choice([None, *range(200)]), rng.choice([0, 1, 1]), rng.randrange(9000), rng.random() < 0.2, rng.choice([None, 0, 5, 300, 9999])) for _ in range(4000)), key=lambda r: r[2])
    obs = files(spark, tmp_path, [rows[i : i + 1000] for i in range(0, 4000, 1000)], "addr long, port int, t long, answered boolean, interval_s long").withColumn("ts", F.timestamp_seconds("t"))
    got, own, want, when = [], spark.conf.get(PROVIDER), [], {}
    for a, port, t, answered, interval in sorted(rows, key=lambda r: (r[2], (min(max(r[4] or 900, 60), 7200)) if r[3] else 0)):
        if port and answered:
            when[a] = t + min(max(interval or 900, 60), 7200)
        elif port and t >= when.get(a, 0):
            want.append((a, t))
            when[a] = t + 60
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        streams.due_nodes(obs).writeStream.foreachBatch(lambda batch, _: got.extend((r.addr, r["at"]) for r in batch.collect())).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.set(PROVIDER, own)
    assert sorted(got, key=str) == sorted(((a, float(t)) for a, t in want), key=str)


def test_due_stream_forgets(spark, tmp_path):
    rows = [[("a", 1, 100, False, None), ("b", 1, 100, True, 7200)], [("c", 1, 90_000, False, None)], [("a", 1, 90_001, False, None)]]
    obs = files(spark, tmp_path, rows, "addr string, port int, t long, answered boolean, interval_s long").withColumn("ts", F.timestamp_seconds("t"))
    got = []
    stream = streams.due_nodes(obs).writeStream.foreachBatch(lambda batch, _: got.extend((r.addr, r["at"]) for r in batch.collect())).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert stream.awaitTermination(120)
    assert got == [("a", 100.0), ("c", 90000.0), ("a", 90001.0)] and [o["numRowsTotal"] for p in stream.recentProgress for o in p["stateOperators"]][-1] == 2
