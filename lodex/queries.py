"""The registered queries of the listing index, over the views of lodex.sources.tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodex.functions import keys, text
from lodex.operators import changes, charts, merge, pages, rank, requests, review, rules, schedule, search, search_index, stats
from lodex.plans import jobs
from lodex.sources import tables as T
from lodex.sources.shared import folders, scratch
from lodex.streaming import bounded
from lodex.streaming import jobs as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NOW, MARK = 1_800_000_000, 1_704_067_200 + 300 * 60
#: Neutral stand-ins for rule lists, of words that the invented texts have.
RULES = rules.Rules(terms=("with", "from", "reation", "keitver"), name_terms=("thanwh",), exceptions=("that from",), domain=r"[a-z0-9]+\.(?:com|org)", strong=r"akia[a-z0-9]{4,}", weak=r"[A-Z]{2,6}-?[0-9]{3,5}", most_other=0.1)
ASKED = [(1, "the AND", "1", "20"), (2, "ist", "2", "5"), (3, "", "x", "3"), (4, "que  los", "999999", "100"), (5, "100%", None, None)]

# Common table expressions of the views, for DuckDB.
LISTING = "listing AS (SELECT lpad(lower(to_hex(d.doc_id + 1)), 40, '0') AS info_hash, d.doc_id, split_part(d.text, chr(10), 1) AS name, d.n_chars * 65536 AS total_size, string_split(d.text, chr(10)) AS paths, len(string_split(d.text, chr(10)))::INTEGER AS file_count, 1704067200 + d.doc_id * 60 AS created_at, (CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END)::BIGINT AS reviewed_at, '' AS clean_name FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id))"
BLOCKED = "blocked AS (SELECT lpad(lower(to_hex(doc_id + 1)), 40, '0') AS info_hash, 'toxic' AS reason FROM labels WHERE toxic = 1)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOW_NAME = f"translate(name, '{UPPER}', '{LOWER}')"


def query(sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Registers a query under its function's name, with SQL for the same rows where there is any."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = ("WITH " + ", ".join(ctes) + " " if ctes else "") + sql
        return f

    return register


# Search.


@query(f"SELECT info_hash, name, total_size, file_count, created_at FROM listing WHERE contains({LOW_NAME}, 'the') AND contains({LOW_NAME}, 'and') ORDER BY created_at DESC, info_hash LIMIT 20", (LISTING,))
def search_page(spark, sf_dir):
    return search.search(T.listing(spark, sf_dir), "The AND", 1, 20)


@query(f"SELECT (SELECT count(*) FROM listing WHERE contains({LOW_NAME}, 'the') AND contains({LOW_NAME}, 'and')) AS matched, (SELECT count(*) FROM listing) AS total, (SELECT count(*) FROM listing WHERE reviewed_at = 0) AS pending, (SELECT count(*) FROM blocked) AS blocked", (LISTING, BLOCKED))
def search_total(spark, sf_dir):
    return search.totals(T.listing(spark, sf_dir), T.blocked(spark, sf_dir), "the and")


@query("SELECT info_hash, name, total_size, file_count, created_at FROM listing ORDER BY created_at DESC, info_hash LIMIT 20 OFFSET 20", (LISTING,))
def latest_page(spark, sf_dir):
    return search.latest(T.listing(spark, sf_dir), 2)


_PAGES = "SELECT query_id, total, place, info_hash, name FROM (SELECT query_id, info_hash, name, page, page_size, count(*) OVER (PARTITION BY query_id) AS total, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, info_hash)::INTEGER AS place FROM hits) WHERE place > (page - 1) * page_size AND place <= page * page_size"
_HITS = f"hits AS (SELECT * FROM listing, asked WHERE contains({LOW_NAME}, a) AND contains({LOW_NAME}, b))"


@query(_PAGES, (LISTING, "asked(query_id, a, b, page, page_size) AS (VALUES (1::BIGINT, 'the', 'and', 1, 20), (2, 'ist', '', 2, 5), (3, '', '', 1, 3), (4, 'que', 'los', 101, 100), (5, '100%', '', 1, 20))", _HITS))
def search_batch(spark, sf_dir):
    asked = spark.createDataFrame(ASKED, "query_id long, q string, page string, page_size string")
    return search.search_batch(T.listing(spark, sf_dir), asked)


@query(_PAGES, (LISTING, "asked(query_id, a, b, page, page_size) AS (VALUES (1::BIGINT, 'the', 'and', 1, 20), (2, 'ist', '', 2, 5), (3, '', '', 1, 3), (4, 'que', 'los', 101, 100), (5, '100%', '', 1, 20), (6, 'ie', 'dieser', 1, 50), (7, 'réau', 'é', 1, 50), (8, 'e', 'a', 3, 10), (9, 'thing', 'edesst', 1, 100))", _HITS))
def search_index_batch(spark, sf_dir):
    """An index of all listings in two segments, and a table of queries of long, short and no keywords by it."""
    out, listings = scratch(spark, "search"), T.listing(spark, sf_dir)
    for k in range(2):
        search_index.add(listings.where(F.col("created_at") / 60 % 2 == k), out, k)
    asked = [*ASKED, (6, "ie DIESER", None, "50"), (7, "réau é", "1", "50"), (8, "E a", "3", "10"), (9, "thing edesst", None, "100")]
    return search_index.search_batch(spark, out, spark.createDataFrame(asked, "query_id long, q string, page string, page_size string"))


@query("SELECT info_hash, 'magnet:?xt=urn:btih:' || info_hash || '&dn=' || replace(url_encode(name), '%20', '+') || '&tr=udp%3A%2F%2Ft.example%3A80%2Fa' AS link FROM listing", (LISTING,))
def listing_links(spark, sf_dir):
    return search.links(T.listing(spark, sf_dir), ["udp://t.example:80/a", " "])


@query("SELECT info_hash, name, total_size, file_count, created_at FROM listing ORDER BY created_at DESC, info_hash LIMIT 50 OFFSET 100", (LISTING,))
def page_by_histogram(spark, sf_dir):
    """The third page of 50, by the running sums of a histogram of the listings by time."""
    out = scratch(spark, "pages")
    pages.write(T.listing(spark, sf_dir), out)
    return pages.latest(spark, out, 3, 50)


@query(f"SELECT info_hash, name, total_size, file_count, created_at FROM listing WHERE contains({LOW_NAME}, 'ist') ORDER BY created_at DESC, info_hash LIMIT 20 OFFSET 20", (LISTING,))
def page_by_key(spark, sf_dir):
    """The second page of a search, behind the last row of the first."""
    listings = T.listing(spark, sf_dir)
    last = pages.search_after(listings, "ist").orderBy("created_at", F.desc("info_hash")).first()
    return pages.search_after(listings, "ist", (last.created_at, last.info_hash))


@query(
    "SELECT info_hash, CASE WHEN len(paths) < 2 THEN '' ELSE regexp_extract(left(a, list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda n: left(a, n) = left(b, n)))), '(?s)^(.*/)', 1) END AS common_dir, (file_count - least(10, file_count))::BIGINT AS hidden, greatest(1, ceil(file_count / 10))::BIGINT AS pages FROM (SELECT *, list_min(paths) AS a, list_max(paths) AS b FROM listing)",
    (LISTING,),
)
def file_rollup(spark, sf_dir):
    return search.file_rollup(T.listing(spark, sf_dir))


@query(f"SELECT to_json({{info_hash: info_hash, name: name, total_size: total_size, file_count: file_count, created_at: created_at}})::VARCHAR AS record FROM (SELECT * FROM listing WHERE contains({LOW_NAME}, 'ist') ORDER BY created_at DESC, info_hash LIMIT 20)", (LISTING,))
def search_json(spark, sf_dir):
    return search.as_json(search.search(T.listing(spark, sf_dir), "ist"))


@query("SELECT info_hash, file_count, least(50, file_count)::INTEGER AS n_kept, list_sum(list_transform(paths[1:50], lambda p: length(p)))::BIGINT AS bytes FROM listing", (LISTING,))
def kept_files(spark, sf_dir):
    size = F.aggregate("files", F.lit(0).cast("long"), lambda n, f: n + f["size"])
    return T.kept_files(T.listing(spark, sf_dir)).select("info_hash", "file_count", F.size("files").alias("n_kept"), size.alias("bytes"))


@query("SELECT CASE WHEN toxic = 1 THEN 'adult' ELSE 'spam' END AS label, lpad(lower(to_hex(doc_id + 1)), 40, '0') AS info_hash, 'title ' || doc_id AS title FROM labels WHERE doc_id % 3 > 0")
def journal_lines(spark, sf_dir):
    """The labels as lines of a journal, some without a title, and read back."""
    label = F.when(F.col("toxic") == 1, "adult").otherwise("spam")
    title = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit(' "title '), F.col("doc_id").cast("string"), F.lit('"'))).otherwise("")
    lines = T.table(spark, sf_dir, "labels").select(F.concat(F.lit("2024/01/01 00:00:00 review: "), label, F.lit(" "), T.key_of(F.col("doc_id")), title).alias("value"))
    return T.parsed_journal(lines)


# Rules. RE2's word boundary is the ASCII one that the Spark patterns spell out.

_PLAIN = "replace(lower(name), 'that from', '')"
_TERM = r"(reation|keitver|\b(?:from|with)\b)"


@query(
    f"SELECT info_hash, term FROM (SELECT info_hash, {_PLAIN} AS p FROM listing), (VALUES ('with', '\\bwith\\b'), ('from', '\\bfrom\\b'), ('reation', 'reation'), ('keitver', 'keitver')) t(term, re) WHERE regexp_matches(p, re)",
    (LISTING,),
)
def rule_terms(spark, sf_dir):
    return rules.term_hits(T.listing(spark, sf_dir), RULES)


_HIT = rf"(CASE WHEN regexp_matches(P, '{_TERM}') THEN 'term:' || regexp_extract(P, '{_TERM}', 1) WHEN regexp_matches(P, '[a-z0-9]+\.(?:com|org)') THEN 'domain:' || regexp_extract(P, '[a-z0-9]+\.(?:com|org)') END)"
_CATEGORY = (
    "hits AS (SELECT *, " + _HIT.replace("P", _PLAIN) + " AS h, nullif(regexp_extract(lower(name), 'thanwh'), '') AS banner, nullif(regexp_extract(lower(name), 'akia[a-z0-9]{4,}'), '') AS strong, list_filter(list_transform(paths, lambda x: " + _HIT.replace("P", "replace(lower(x), 'that from', '')") + "), lambda x: x IS NOT NULL) AS fh FROM listing), "
    "category AS (SELECT *, list_concat(list_filter(['name-' || h, CASE WHEN h IS NULL THEN 'banner:' || banner END, CASE WHEN h IS NULL AND banner IS NULL THEN 'strong:' || strong END], lambda x: x IS NOT NULL), list_transform(fh, lambda x: 'file-' || x), CASE WHEN (h IS NOT NULL OR banner IS NOT NULL OR strong IS NOT NULL OR len(fh) > 0) AND regexp_matches(name, '[A-Z]{2,6}-?[0-9]{3,5}') THEN ['weak'] ELSE [] END) AS reasons FROM hits)"
)


@query("SELECT info_hash, array_to_string(reasons, '|') AS reasons FROM category", (LISTING, _CATEGORY))
def rule_reasons(spark, sf_dir):
    return rules.with_reasons(T.listing(spark, sf_dir), RULES, tested=False).select("info_hash", F.array_join("reasons", "|").alias("reasons"))


@query(r"SELECT info_hash, regexp_matches(lower(name), '[a-z0-9]+\.(?:com|org)') AS has_domain, regexp_matches(lower(name), 'akia[a-z0-9]{4,}') AS has_strong, regexp_matches(name, '[A-Z]{2,6}-?[0-9]{3,5}') AS has_weak FROM listing", (LISTING,))
def rule_patterns(spark, sf_dir):
    low = text.lower(F.col("name"))
    return T.listing(spark, sf_dir).select("info_hash", low.rlike(RULES.domain).alias("has_domain"), low.rlike(RULES.strong).alias("has_strong"), F.col("name").rlike(RULES.weak).alias("has_weak"))


_OTHER = r"(CASE WHEN length(name) = 0 THEN 0 ELSE length(regexp_replace(name, '[\p{L}\p{Nd}\s\v\p{Z}\x{85}]', '', 'g')) / length(name)::DOUBLE END)"
_BLANK = r"(regexp_replace(name, '[\s\v\p{Z}\x{85}]+', '', 'g') = '')"


@query(f"SELECT info_hash, {_BLANK} AS blank, NOT {_BLANK} AND NOT regexp_matches(name, '[\\p{{L}}\\p{{Nd}}]') AS no_letters, length(name) > 300 AS long, {_OTHER} > 0.1 AS other FROM listing", (LISTING,))
def rule_title_shape(spark, sf_dir):
    t = rules.title_tests(RULES)
    return T.listing(spark, sf_dir).select("info_hash", t["blank"].alias("blank"), t["no-letters"].alias("no_letters"), t["long"].alias("long"), t["other"].alias("other"))


_STUFFED = r"ws AS (SELECT info_hash, unnest(list_filter(regexp_split_to_array(lower(name), '[\s\v\p{Z}\x{85}]+'), lambda w: length(w) >= 2)) AS w, generate_subscripts(list_filter(regexp_split_to_array(lower(name), '[\s\v\p{Z}\x{85}]+'), lambda w: length(w) >= 2), 1) AS i FROM listing), occ AS (SELECT info_hash, w, i, row_number() OVER (PARTITION BY info_hash, w ORDER BY i) AS k FROM ws), stuffed AS (SELECT info_hash, w AS word, k::INTEGER AS n FROM occ QUALIFY row_number() OVER (PARTITION BY info_hash ORDER BY k DESC, i) = 1)"


@query("SELECT info_hash, coalesce(word, '') AS word, coalesce(n, 0)::INTEGER AS n FROM listing LEFT JOIN stuffed USING (info_hash)", (LISTING, _STUFFED))
def rule_word_stuffing(spark, sf_dir):
    return T.listing(spark, sf_dir).withColumn("s", text.stuffed_word(F.col("name"))).select("info_hash", F.col("s.word").alias("word"), F.col("s.n").alias("n"))


@query(
    "SELECT info_hash, len(f)::INTEGER AS n_files, len(list_filter(f, lambda p: regexp_matches(regexp_replace(regexp_replace(p, '(?s)^.*[/\\\\]', ''), '(?s)^(.+)\\.[^.]*$', '\\1'), '^[0-9B-DF-HJ-NP-TV-Zb-df-hj-np-tv-z]{4,}$')))::INTEGER AS n_random FROM (SELECT lpad(lower(to_hex(doc_id + 1)), 40, '0') AS info_hash, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> '') AS f FROM documents)"
)
def rule_random_files(spark, sf_dir):
    odd = F.filter(F.col("files.path"), lambda p: text.random_looking(p, 4))
    return T.word_files(spark, sf_dir).select("info_hash", F.size("files").alias("n_files"), F.size(odd).alias("n_random"))


@query("SELECT info_hash, total_size <= 0 AS no_size, total_size > 21990232555520 AS huge, total_size > 0 AND total_size < 104857600 AS small FROM listing", (LISTING,))
def rule_size(spark, sf_dir):
    t = rules.size_tests(RULES)
    return T.listing(spark, sf_dir).select("info_hash", t["no-size"].alias("no_size"), t["huge"].alias("huge"), t["small"].alias("small"))


_SCREENED = f"""odd AS (SELECT info_hash, len(list_filter(paths, lambda p: regexp_matches(regexp_replace(regexp_replace(p, '(?s)^.*[/\\\\]', ''), '(?s)^(.+)\\.[^.]*$', '\\1'), '^[0-9B-DF-HJ-NP-TV-Zb-df-hj-np-tv-z]{{20,}}$'))) AS k FROM listing),
screened AS (SELECT c.*, len(reasons) > 0 AS category, {_BLANK} OR NOT regexp_matches(name, '[\\p{{L}}\\p{{Nd}}]') OR length(name) > 300 OR coalesce(s.n, 0) >= 4 OR {_OTHER} > 0.1 OR total_size <= 0 OR total_size > 21990232555520 OR len(paths) > 20000 OR (len(paths) >= 5 AND k / len(paths) > 0.3) AS spam, total_size > 0 AND total_size < 104857600 AS too_small FROM category c LEFT JOIN stuffed s USING (info_hash) JOIN odd USING (info_hash)),
routed AS (SELECT *, CASE WHEN category THEN 'filtered_category' WHEN spam THEN 'filtered_spam' WHEN too_small THEN 'filtered_small' ELSE 'fetched' END AS route FROM screened)"""
_ROUTED = (LISTING, _CATEGORY, _STUFFED, _SCREENED)


@query("SELECT info_hash, route FROM routed", _ROUTED)
def screen_route(spark, sf_dir):
    return rules.screened(T.listing(spark, sf_dir), RULES).select("info_hash", "route")


@query("SELECT label, count(*) AS n, count(*) FILTER (WHERE category OR spam OR too_small) AS caught, count(*) FILTER (WHERE category OR spam) AS flagged FROM (SELECT s.*, CASE WHEN toxic = 1 THEN 'removed' ELSE 'approved' END AS label FROM screened s JOIN labels USING (doc_id)) GROUP BY label", _ROUTED)
def rule_eval(spark, sf_dir):
    truth = T.table(spark, sf_dir, "labels").select(T.key_of(F.col("doc_id")).alias("info_hash"), F.when(F.col("toxic") == 1, "removed").otherwise("approved").alias("label"))
    return rules.evaluate(rules.screened(T.listing(spark, sf_dir), RULES).join(truth, "info_hash"))


@query("SELECT p_partkey AS part, lower(p_type) AS term FROM part WHERE p_type <> '' AND length(p_type) > 4 UNION ALL SELECT p_partkey, t FROM part, (SELECT DISTINCT lower(p_brand) AS t FROM part) WHERE regexp_matches(lower(p_brand), t) AND length(t) > 4")
def rule_term_files(spark, sf_dir):
    """Types and brands of the parts as term lists, one a line, written, read back and looked for."""
    part, out = T.table(spark, sf_dir, "part"), scratch(spark, "terms")
    part.select(F.concat(F.lit(" "), F.lower("p_type"), F.lit("\t"))).union(part.select(F.lower("p_brand"))).union(part.limit(1).select(F.lit(""))).write.text(out)
    named = part.select(F.col("p_partkey").alias("info_hash"), F.concat_ws(" ", "p_type", "p_brand").alias("name"))
    return rules.term_hits(named, rules.Rules(terms=T.term_list(spark, out))).select(F.col("info_hash").alias("part"), "term")


# Merge.


@query("SELECT info_hash, created_at FROM listing WHERE doc_id % 2 = 0 OR info_hash NOT IN (SELECT info_hash FROM blocked)", (LISTING, BLOCKED))
def insert_ignore(spark, sf_dir):
    listings = T.listing(spark, sf_dir)
    again = listings.withColumn("created_at", F.col("created_at") + 7)
    out = merge.insert_ignore(listings.where(F.col("created_at") % 120 == 0), listings.unionByName(again), T.blocked(spark, sf_dir))
    return out.select("info_hash", "created_at")


@query(f"SELECT info_hash, created_at, CASE WHEN created_at <= {MARK} THEN reviewed_at ELSE 0 END AS reviewed_at FROM listing WHERE created_at <= {MARK} OR info_hash NOT IN (SELECT info_hash FROM blocked)", (LISTING, BLOCKED))
def sync_merge(spark, sf_dir):
    listings = T.listing(spark, sf_dir)
    out = merge.sync(listings.where(F.col("created_at") <= MARK), merge.delta(listings, MARK - 600), T.blocked(spark, sf_dir))
    return out.select("info_hash", "created_at", "reviewed_at")


@query("SELECT info_hash FROM listing WHERE info_hash NOT IN (SELECT info_hash FROM blocked)", (LISTING, BLOCKED))
def sync_not_in(spark, sf_dir):
    return merge.not_in(T.listing(spark, sf_dir), T.blocked(spark, sf_dir)).select("info_hash")


@query(f"SELECT info_hash, name, total_size, file_count, created_at, (SELECT max(created_at) FROM listing WHERE created_at > {MARK}) AS mark FROM listing WHERE created_at > {MARK}", (LISTING,))
def delta_extract(spark, sf_dir):
    rows = merge.delta(T.listing(spark, sf_dir), MARK)
    return rows.drop("files").crossJoin(merge.delta_mark(rows).select("mark"))  # one row


@query(
    f"SELECT info_hash, reason, created_at FROM (SELECT info_hash, reason, 1704067200::BIGINT AS created_at FROM blocked WHERE info_hash LIKE '%1' UNION ALL SELECT lpad(lower(to_hex(doc_id + 1)), 40, '0') AS info_hash, CASE WHEN toxic = 1 THEN 'adult' ELSE 'spam' END AS reason, {NOW}::BIGINT AS created_at FROM labels WHERE (toxic = 1 OR quality = 0) AND NOT (toxic = 1 AND lower(to_hex(doc_id + 1)) LIKE '%1'))",
    (BLOCKED,),
)
def block_apply(spark, sf_dir):
    rejects = T.table(spark, sf_dir, "labels").where("toxic = 1 OR quality = 0").select(T.key_of(F.col("doc_id")).alias("info_hash"), F.when(F.col("toxic") == 1, "adult").otherwise("spam").alias("reason"), F.lit("").alias("name"))
    known = T.blocked(spark, sf_dir).where(F.col("info_hash").endswith("1"))
    _, grown, _ = merge.block(T.listing(spark, sf_dir), known, rejects, NOW)
    return grown.select("info_hash", "reason", "created_at")


@query(f"SELECT info_hash, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN {NOW} ELSE reviewed_at END AS reviewed_at FROM listing", (LISTING,))
def mark_reviewed(spark, sf_dir):
    batch = T.table(spark, sf_dir, "labels").where("quality = 1").select(T.key_of(F.col("doc_id")).alias("info_hash"))
    return merge.mark_reviewed(T.listing(spark, sf_dir), batch, NOW).select("info_hash", "reviewed_at")


@query("SELECT info_hash, name, CASE WHEN doc_id % 5 = 0 AND left(name, 10) <> '' THEN left(name, 10) ELSE name END AS shown FROM listing", (LISTING,))
def set_clean_names(spark, sf_dir):
    listings = T.listing(spark, sf_dir)
    trims = listings.where(F.col("created_at") % 300 == 0).select("info_hash", F.left("name", F.lit(10)).alias("clean"))
    return merge.set_clean_names(listings, trims).select("info_hash", "name", search.display_name().alias("shown"))


@query("SELECT info_hash, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE file_count END::INTEGER AS n_files, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE list_sum(list_transform(paths, lambda p: length(p))) END::BIGINT AS bytes, 0::BIGINT AS reviewed_at, '' AS clean_name FROM listing", (LISTING,))
def schema_upgrade(spark, sf_dir):
    listings = T.listing(spark, sf_dir)
    old = listings.select("info_hash", "name", "total_size", "file_count", F.when(F.col("created_at") % 180 == 0, "").otherwise(F.to_json("files")).alias("files_json"), "created_at")
    size = F.aggregate("files", F.lit(0).cast("long"), lambda n, f: n + f["size"])
    return T.upgraded(old).select("info_hash", F.size("files").alias("n_files"), size.alias("bytes"), "reviewed_at", "clean_name")


@query("SELECT count(*) AS n, true AS verified FROM documents")
def snapshot_verify(spark, sf_dir):
    return merge.snapshot(T.listing(spark, sf_dir), scratch(spark, "snapshot")).select("n", "verified")


# Ranking.


def discovered(spark, sf_dir) -> DataFrame:
    """Keys of the events' users; some are zero keys, some aren't hexadecimal."""
    u = F.col("user_id")
    return T.events(spark, sf_dir).select(F.when(u % 7 == 0, F.repeat(F.lit("0"), F.lit(40))).when(u % 7 == 1, F.lit("zzzz")).otherwise(T.key_of(u)).alias("info_hash"), "ts", F.col("event_id").alias("seq"))


@query("SELECT DISTINCT lpad(lower(to_hex(user_id + 1)), 40, '0') AS info_hash FROM events WHERE user_id % 7 > 1")
def valid_keys(spark, sf_dir):
    return rank.valid_keys(discovered(spark, sf_dir)).select("info_hash").distinct()


@query("SELECT page_id, regexp_extract(url, '^https://(?:[^/?#@]*@)?([^/?#@]+)', 1) AS host FROM pages WHERE regexp_matches(url, '^https://(?:[^/?#@]*@)?[^/?#@]+')")
def udp_hosts(spark, sf_dir):
    return rank.tracker_hosts(T.table(spark, sf_dir, "pages").select("page_id", "url"), "https")


@query("SELECT p_partkey AS hash, greatest(0, coalesce(max(l_quantity::INTEGER), 0))::INTEGER AS seeders FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def best_seeders(spark, sf_dir):
    given = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("hash"))
    return rank.best_seeders(given, T.replies(spark, sf_dir))


@query("SELECT count(*) AS scraped, count(*) FILTER (WHERE q > 20) AS seeded, greatest(0, count(*) - 150)::BIGINT AS evicted, (SELECT count(*) FROM lineitem WHERE l_quantity <= 20) AS errors FROM (SELECT p_partkey, max(l_quantity) AS q FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey)")
def rank_counters(spark, sf_dir):
    """Small quantities stand for trackers that failed."""
    given = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("hash"))
    replies = T.replies(spark, sf_dir).withColumn("seeders", F.when(F.col("seeders") > 20, F.col("seeders")))
    return rank.rank_counters(rank.best_seeders(given, replies), replies, 150)


@query(
    "SELECT o.l_orderkey AS batch_id, (o.k - 1)::INTEGER AS pos, o.l_partkey AS hash, coalesce(r.q, 0)::INTEGER AS seeders FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem) o LEFT JOIN (SELECT l_orderkey, l_quantity::INTEGER AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem) r ON r.l_orderkey = o.l_orderkey AND r.k = o.k AND o.k <= 3"
)
def align_replies(spark, sf_dir):
    rows = T.replies(spark, sf_dir).groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("pos", "hash", "tracker", "seeders"))).alias("x"))
    asked = rows.select("batch_id", F.col("x.hash").alias("hashes"))
    return rank.aligned(asked, rows.select("batch_id", F.slice("x.seeders", 1, 3).alias("seeders")))


_QUEUE = "items AS (SELECT l_partkey AS hash, max(l_quantity::INTEGER)::INTEGER AS seeders, l_partkey AS seq FROM lineitem GROUP BY l_partkey), placed AS (SELECT *, row_number() OVER (ORDER BY seeders DESC, seq) AS k FROM items)"


def items(spark, sf_dir) -> DataFrame:
    return T.replies(spark, sf_dir).groupBy("hash").agg(F.max("seeders").alias("seeders")).withColumn("seq", F.col("hash"))


@query("SELECT hash, seeders, seq FROM placed WHERE k <= 500", (_QUEUE,))
def topk_queue(spark, sf_dir):
    rows = items(spark, sf_dir)
    return rank.queue(rows.where("hash % 2 = 0"), rows.where("hash % 2 = 1"), 500)


@query("SELECT hash, seeders, seq FROM placed WHERE k > 500", (_QUEUE,))
def evicted(spark, sf_dir):
    return rank.evicted(items(spark, sf_dir), 500)


_NUMBERED = "numbered AS (SELECT *, ((row_number() OVER (ORDER BY created_at, info_hash) - 1) // 100)::BIGINT AS batch_id, ((row_number() OVER (ORDER BY created_at, info_hash) - 1) % 100 + 1)::INTEGER AS i FROM listing WHERE reviewed_at = 0)"


@query("SELECT info_hash, ((row_number() OVER (ORDER BY created_at, info_hash) - 1) // 70)::BIGINT AS batch, ((row_number() OVER (ORDER BY created_at, info_hash) - 1) % 70 + 1)::INTEGER AS i FROM listing", (LISTING,))
def batch_numbers(spark, sf_dir):
    return rank.numbered(T.listing(spark, sf_dir).select("info_hash", "created_at"), [F.col("created_at"), F.col("info_hash")], rank.BATCH).select("info_hash", "batch", "i")


# Review.


@query("SELECT info_hash, name, total_size, file_count, created_at FROM listing WHERE reviewed_at = 0 ORDER BY created_at, info_hash LIMIT 2000", (LISTING,))
def candidates(spark, sf_dir):
    return review.candidates(T.listing(spark, sf_dir), review.BATCH * review.BATCHES)


_TITLE = "translate(name, chr(10) || chr(13) || chr(9), '   ')"
_SIZE = "CASE WHEN total_size >= 1073741824 THEN printf('%.1fGB', total_size / 1073741824.0) WHEN total_size >= 1048576 THEN printf('%.0fMB', total_size / 1048576.0) ELSE total_size || 'B' END"


@query(f"SELECT batch_id, i, CASE WHEN length({_TITLE}) > 200 THEN left({_TITLE}, 200) || '…' ELSE {_TITLE} END AS title, {_SIZE} AS size, file_count AS files FROM numbered", (LISTING, _NUMBERED))
def review_requests(spark, sf_dir):
    told = review.requests(review.sweep(T.listing(spark, sf_dir), 0))
    rows = told.select("batch_id", F.explode(F.from_json("content", "array<struct<i:int,title:string,size:string,files:int>>")).alias("x"))
    return rows.select("batch_id", "x.*")


def answers(listings: DataFrame) -> DataFrame:
    """Replies about all candidates, fenced: long names are rejected, others get a shorter title; batch 3 has no JSON."""
    rows = review.sweep(listings, 0)
    label = F.when(F.length("name") % 7 == 0, " Spam").when(F.length("name") % 11 == 0, "ADULT").when(F.length("name") % 3 == 0, "ok").otherwise("unsure")
    item = F.struct("i", label.alias("label"), F.regexp_replace("name", r" [^ ]+\z", "").alias("clean"))
    told = F.concat(F.lit("```json\n"), F.to_json(F.array_sort(F.collect_list(item))), F.lit("\n```"))
    return rows.groupBy("batch_id").agg(told.alias("content")).withColumn("content", F.when(F.col("batch_id") == 3, "no answer").otherwise(F.col("content")))


_LABEL = "CASE WHEN length(name) % 7 = 0 THEN 'spam' WHEN length(name) % 11 = 0 THEN 'adult' END"
_PROPOSED = "regexp_replace(name, ' [^ ]+$', '')"


@query(f"SELECT batch_id, i, {_LABEL} AS label, {_PROPOSED} AS clean FROM numbered WHERE batch_id <> 3", (LISTING, _NUMBERED))
def parse_verdicts(spark, sf_dir):
    return review.verdicts(answers(T.listing(spark, sf_dir)))


def _accepted(proposed: str) -> str:
    spaced = r"trim(regexp_replace({}, '[\s\v\p{{Z}}\x{{85}}]+', ' ', 'g'))"
    new, full = f"trim({spaced.format(proposed)}, ' ' || chr(9) || '-_|')", _TITLE
    sub = f"regexp_matches({full}, '(?s)' || array_to_string(list_transform(string_split({new}, ''), lambda c: regexp_escape(c)), '.*'))"
    return f"CASE WHEN length({full}) <= 200 AND {new} <> '' AND {new} <> {full} AND {new} <> {spaced.format(full)} AND length({new}) <= length({full}) AND length({new}) >= 4 AND length({new}) >= 0.25 * length({full}) AND {sub} THEN {new} ELSE '' END"


_CASES = "CASE doc_id % 4 WHEN 0 THEN regexp_replace(name, ' [^ ]+$', '') WHEN 1 THEN reverse(name) WHEN 2 THEN '- ' || left(name, 12) ELSE name || 'x' END"


@query(f"SELECT info_hash, {_accepted('p')} AS clean FROM (SELECT info_hash, name, {_CASES} AS p FROM listing)", (LISTING,))
def accept_titles(spark, sf_dir):
    n, name = F.col("created_at") / 60 % 4, F.col("name")
    n = n - F.lit(1704067200 / 60 % 4)
    proposed = F.when(F.pmod(n, F.lit(4)) == 0, F.regexp_replace(name, r" [^ ]+\z", "")).when(F.pmod(n, F.lit(4)) == 1, F.reverse(name)).when(F.pmod(n, F.lit(4)) == 2, F.concat(F.lit("- "), F.left(name, F.lit(12)))).otherwise(F.concat(name, F.lit("x")))
    return T.listing(spark, sf_dir).select("info_hash", text.accepted_title(name, proposed).alias("clean"))


_JUDGED = f"judged AS (SELECT *, coalesce({_LABEL}, 'ok') AS label, CASE WHEN ({_LABEL}) IS NULL THEN {_accepted(_PROPOSED)} ELSE '' END AS clean FROM numbered WHERE batch_id < 3)"
_REVIEW = (LISTING, BLOCKED, _NUMBERED, _JUDGED)


def reviewed(spark, sf_dir) -> review.Applied:
    return jobs.review_once(T.listing(spark, sf_dir), T.blocked(spark, sf_dir), answers(T.listing(spark, sf_dir)), NOW, 0)


@query("SELECT count(*) AS reviewed, count(*) FILTER (WHERE label = 'adult') AS adult, count(*) FILTER (WHERE label = 'spam') AS spam, count(*) FILTER (WHERE clean <> '') AS trimmed FROM judged", _REVIEW)
def review_summary(spark, sf_dir):
    return reviewed(spark, sf_dir).summary


#: Three runs: each judges the three batches before the one without JSON, the second is a dry one.
_RUNS = (LISTING, BLOCKED, _NUMBERED, _JUDGED.replace("SELECT *, coalesce", "SELECT *, batch_id // 3 + 1 AS run, coalesce", 1).replace("batch_id < 3", "batch_id < 9"))


def review_store(spark, sf_dir) -> str:
    """A store of the listings after these runs, with a base made after the first; the second is done twice."""
    out = scratch(spark, "changes")
    changes.start(T.listing(spark, sf_dir), T.blocked(spark, sf_dir), out)
    for run in (1, 2, 2, 3):
        changes.review_run(spark, out, answers(changes.listings(spark, out, run)), run, NOW, 0, dry_run=run == 2)
        if run == 1:
            changes.compact(spark, out)
    return out


@query(f"SELECT l.info_hash, CASE WHEN j.info_hash IS NOT NULL THEN {NOW} ELSE l.reviewed_at END AS reviewed_at, CASE WHEN j.run <> 2 THEN j.clean ELSE '' END AS clean_name FROM listing l LEFT JOIN judged j USING (info_hash) WHERE coalesce(j.label, 'ok') = 'ok' OR j.run = 2", _RUNS)
def review_apply(spark, sf_dir):
    return changes.listings(spark, review_store(spark, sf_dir)).select("info_hash", "reviewed_at", "clean_name")


@query(f"SELECT info_hash, reason FROM blocked UNION ALL SELECT info_hash, label AS reason FROM judged WHERE label <> 'ok' AND run <> 2 AND info_hash NOT IN (SELECT info_hash FROM blocked)", _RUNS)
def review_blocked(spark, sf_dir):
    return changes.blocked(spark, review_store(spark, sf_dir)).select("info_hash", "reason")


@query("SELECT CASE WHEN label <> 'ok' THEN label ELSE 'trim' END AS kind, info_hash, name AS title, clean, false AS dry_run FROM judged WHERE label <> 'ok' OR clean <> ''", _REVIEW)
def review_audit(spark, sf_dir):
    return reviewed(spark, sf_dir).audit


@query("SELECT CASE WHEN label <> 'ok' THEN label ELSE 'trim' END AS kind, info_hash, name AS title, clean, run = 2 AS dry_run, run FROM judged WHERE label <> 'ok' OR clean <> ''", _RUNS)
def review_audit_log(spark, sf_dir):
    return changes.audit(spark, review_store(spark, sf_dir))


# Counters.


@query("SELECT string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS stats FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)")
def stats_map(spark, sf_dir):
    return stats.as_map(counted(spark, sf_dir)).select(F.array_join(F.transform(F.array_sort(F.map_entries("stats")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("stats"))


def counted(spark, sf_dir) -> DataFrame:
    return stats.totals(T.events(spark, sf_dir).select(F.col("event_type").alias("key"), F.lit(1).cast("long").alias("delta")))


@query("SELECT event_type AS key, count(*) AS value FROM events GROUP BY event_type")
def counter_totals(spark, sf_dir):
    return counted(spark, sf_dir)


@query("SELECT count(*) FILTER (WHERE event_type = 'view') AS \"view\", count(*) FILTER (WHERE event_type = 'click') AS click, 0::BIGINT AS never, (SELECT count(*) FROM listing) AS total, (SELECT count(*) FROM listing WHERE reviewed_at = 0) AS pending, (SELECT count(*) FROM blocked) AS blocked FROM events", (LISTING, BLOCKED))
def stats_report(spark, sf_dir):
    return stats.report(counted(spark, sf_dir), T.listing(spark, sf_dir), T.blocked(spark, sf_dir), ["view", "click", "never"])


@query("SELECT event_type AS name, event_id AS ts, event_id * 3 - coalesce(lag(event_id * 3) OVER (PARTITION BY event_type ORDER BY event_id), 0) AS delta FROM events")
def counter_deltas(spark, sf_dir):
    readings = T.events(spark, sf_dir).select(F.col("event_type").alias("name"), F.col("event_id").alias("ts"), (F.col("event_id") * 3).alias("value"))
    return stats.differences(readings)


@query("SELECT count(*) FILTER (WHERE event_type = 'view') / count(*) FILTER (WHERE event_type IN ('view', 'error'))::DOUBLE AS view_share, count(*) FILTER (WHERE event_type = 'error') / count(*) FILTER (WHERE event_type IN ('view', 'error'))::DOUBLE AS error_share, count(*) FILTER (WHERE event_type = 'purchase') / count(*) FILTER (WHERE event_type = 'click')::DOUBLE AS yield FROM events")
def outcome_ratios(spark, sf_dir):
    return stats.shares(counted(spark, sf_dir), ["view", "error"], ("purchase", "click"))


# Charts, nodes, requests.

_CHART = "placed AS (SELECT p_type AS chart, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey)::INTEGER AS place, p_partkey AS id, p_name AS title FROM part)"


@query("SELECT chart, place, id, title FROM placed WHERE place <= 10", (_CHART,))
def chart_topn(spark, sf_dir):
    return charts.first_n(T.charts(spark, sf_dir))


@query("SELECT chart, place, id, title, CASE WHEN id % 3 = 0 THEN title WHEN id % 3 = 1 THEN 'Alt ' || id ELSE title END AS shown FROM placed WHERE place <= 10", (_CHART,))
def chart_resolve(spark, sf_dir):
    rows = T.charts(spark, sf_dir)
    full = F.concat("title", F.lit(" Alt "), F.col("id").cast("string"), F.lit("‎ (2024)"))
    names = rows.where("id % 3 > 0").select("id", F.when(F.col("id") % 3 == 1, full).otherwise(F.concat("title", F.lit(" (2020)"))).alias("full_title"))
    return charts.resolved(charts.first_n(rows), names)


@query("SELECT chart, place, id, title, CASE WHEN chart LIKE 'S%' THEN 1 ELSE 2 END::BIGINT AS updated_at FROM placed WHERE (chart LIKE 'S%' AND place <= 5) OR (chart NOT LIKE 'S%' AND place <= 10)", (_CHART,))
def chart_keep_last(spark, sf_dir):
    rows = T.charts(spark, sf_dir)
    old = charts.first_n(rows, 5).withColumn("updated_at", F.lit(1).cast("long"))
    return charts.keep_last(old, charts.first_n(rows.where("chart NOT LIKE 'S%'")), 2)


@query("SELECT chart, array_to_string(list(title ORDER BY place), '|') AS titles FROM placed WHERE place <= 10 GROUP BY chart UNION ALL SELECT 'none', ''", (_CHART,))
def chart_lists(spark, sf_dir):
    rows = charts.first_n(T.charts(spark, sf_dir))
    names = [r.chart for r in rows.select("chart").distinct().collect()]  # the charts asked for
    return charts.lists(rows, [*names, "none"]).select("chart", F.array_join("titles", "|").alias("titles"))


@query(
    "SELECT addr, last_seen, last_seen + CASE WHEN coalesce(k, 0) <= 0 THEN 900 ELSE least(greatest(k, 60), 7200) END AS next_due FROM (SELECT user_id AS addr, floor(epoch(max(ts)))::BIGINT AS last_seen, arg_max(CAST(json_extract(props, '$.k') AS BIGINT) * 120, ts) AS k FROM events WHERE event_type <> 'error' GROUP BY user_id) WHERE next_due <= 1706600000"
)
def due_nodes(spark, sf_dir):
    return schedule.due(T.node_observations(spark, sf_dir), 1_706_600_000)


@query("SELECT addr, port, count(*) AS n FROM (SELECT user_id AS addr, 6881 AS port FROM events UNION ALL SELECT event_id % 50 AS addr, 6882 AS port FROM events WHERE event_id % 2 = 0) GROUP BY addr, port")
def merged_nodes(spark, sf_dir):
    """Replies with two node lists; the second is empty in every other one."""
    node = lambda a, port: F.struct(a.alias("addr"), F.lit(port).alias("port"))
    second = F.array(node(F.col("event_id") % 50, 6882))
    replies = T.events(spark, sf_dir).select("ts", F.lit(None).cast("long").alias("interval_s"), F.array(node(F.col("user_id"), 6881)).alias("nodes"), F.when(F.col("event_id") % 2 == 0, second).otherwise(F.slice(second, 1, 0)).alias("nodes6"))
    return schedule.merged_replies(replies).groupBy("addr", "port").agg(F.count("*").alias("n"))


_BUCKET = "RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1000000.0 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events), b AS (SELECT user_id, k, t, 1.0::DOUBLE AS tokens, true AS ok FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, e.t, (CASE WHEN least(2.0::DOUBLE, b.tokens + (e.t - b.t) * (1.0::DOUBLE / 14400)) >= 1 THEN least(2.0::DOUBLE, b.tokens + (e.t - b.t) * (1.0::DOUBLE / 14400)) - 1 ELSE least(2.0::DOUBLE, b.tokens + (e.t - b.t) * (1.0::DOUBLE / 14400)) END)::DOUBLE, least(2.0::DOUBLE, b.tokens + (e.t - b.t) * (1.0::DOUBLE / 14400)) >= 1 FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1)"
_BUCKET_ROWS = "SELECT user_id AS client, count(*) FILTER (WHERE ok) AS allowed, count(*) FILTER (WHERE NOT ok) AS rejected FROM b GROUP BY user_id"


def request_log(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"))


@query(_BUCKET_ROWS, (_BUCKET,))
def token_bucket_audit(spark, sf_dir):
    return requests.bucket_audit(request_log(T.events(spark, sf_dir)), 1 / 14400, 2.0, None)


@query("SELECT CASE WHEN user_id % 4 = 0 THEN '198.51.100.' || user_id % 200 WHEN user_id % 4 = 1 THEN '203.0.113.' || user_id % 250 WHEN user_id % 4 = 2 THEN '127.0.0.1' ELSE '2001:db8:1:2::/64' END AS client, count(*) AS n FROM events GROUP BY 1")
def client_keys(spark, sf_dir):
    u = F.col("user_id")
    text_of = lambda head, m: F.concat(F.lit(head), (u % m).cast("string"))
    host = F.concat_ws(":", *(F.lower(F.hex(F.shiftrightunsigned(F.coalesce(u, F.lit(0)), n).bitwiseAND(F.lit(0xFFFF)))) for n in (48, 32, 16, 0)))
    log = T.events(spark, sf_dir).select(
        F.when(u % 4 == 1, F.concat(text_of("203.0.113.", 250), F.lit(":1234"))).when(u % 2 == 0, "127.0.0.1:80").otherwise(F.concat(F.lit("[2001:db8:1:2:"), host, F.lit("]:443"))).alias("remote"),
        F.when(u % 4 == 0, F.concat(F.lit("1.2.3.4, "), text_of("198.51.100.", 200), F.lit(", 10.0.0.5"))).when(u % 4 == 2, "1.2.3.4, garbage, 10.0.0.5").alias("xff"),
        F.lit("").alias("real_ip"),
    )
    return requests.client_keys(log).groupBy("client").agg(F.count("*").alias("n"))


# Streams: each reads a table's files to their end.


def finished(stream) -> None:
    """Waits for a stream that ends by itself, however long its table is; what fails it is raised."""
    stream.awaitTermination()


@query("SELECT DISTINCT user_id AS info_hash FROM events")
def stream_dedupe(spark, sf_dir):
    out = scratch(spark, "dedupe")
    rows = streams.read_table(spark, sf_dir, "events").select(F.col("user_id").alias("info_hash"), "ts")
    kept = streams.dedupe(rows, horizon="60 days")
    finished(kept.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start())
    return spark.read.schema(kept.schema).parquet(f"{out}/rows").select("info_hash")


#: Rows of a micro-batch, about, where its rows are few groups' rows.
FED = 500_000


def fed(rows: DataFrame, by: str, parts: int = 5, most: int | None = None, **again: DataFrame) -> DataFrame:
    """The rows as a stream of as many files, one a micro-batch, in order of `by`; then those of `again`, a file each. With `most`,
    more files where they would have more rows than that. Rows are ranged and stored once, then read a range at a time."""
    spark, out, ranges = rows.sparkSession, scratch(rows.sparkSession, "fed"), scratch(rows.sparkSession, "ranges")
    parts = max(parts, -(-rows.count() // most)) if most else parts
    rows.repartitionByRange(parts, by).withColumn("_part", F.spark_partition_id()).write.partitionBy("_part").parquet(ranges)
    for own in sorted(folders(spark, ranges, "_part="), key=lambda f: int(f.rpartition("=")[2])):
        spark.read.schema(rows.schema).parquet(own).coalesce(1).write.mode("append").parquet(out)
    for rest in again.values():
        rest.coalesce(1).write.mode("append").parquet(out)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(out)


@query("SELECT route AS key, (count(*) + count(*) FILTER (WHERE doc_id % 3 = 0) + count(*) FILTER (WHERE doc_id % 5 = 0))::BIGINT AS delta FROM routed GROUP BY route UNION ALL SELECT 'inserted', count(*) FROM routed WHERE route = 'fetched' AND info_hash NOT IN (SELECT info_hash FROM blocked)", (*_ROUTED, BLOCKED))
def stream_index(spark, sf_dir):
    """Seven micro-batches: all documents in five, then a third and a fifth of them again."""
    out, docs = scratch(spark, "index"), T.table(spark, sf_dir, "documents")
    records = T.records(fed(docs, "doc_id", third=docs.where("doc_id % 3 = 0"), fifth=docs.where("doc_id % 5 = 0")))
    finished(streams.index(records, out, lambda s: T.blocked(s, sf_dir), RULES, f"{out}/state"))
    return stats.totals(spark.read.schema("key string, delta long").parquet(f"{out}/counters")).withColumnRenamed("value", "delta")


@query("SELECT 'seen' AS key, count(*) AS delta FROM events UNION ALL SELECT 'inserted', count(DISTINCT user_id) FILTER (WHERE lpad(lower(to_hex(user_id + 1)), 40, '0') NOT IN (SELECT info_hash FROM blocked)) FROM events", (BLOCKED,))
def stream_bare_keys(spark, sf_dir):
    out = scratch(spark, "bare")
    keys_of = fed(T.table(spark, sf_dir, "events"), "event_id").select(T.key_of(F.col("user_id")).alias("info_hash"), "ts")
    finished(streams.index(streams.bare_records(keys_of), out, lambda s: T.blocked(s, sf_dir), None, f"{out}/state"))
    return stats.totals(spark.read.schema("key string, delta long").parquet(f"{out}/counters")).withColumnRenamed("value", "delta")


_STREAM_RANK = "ranked AS (SELECT l_partkey AS hash, l_quantity::INTEGER AS seeders, l_orderkey * 8 + l_linenumber AS seq, row_number() OVER (ORDER BY l_quantity::INTEGER DESC, l_orderkey * 8 + l_linenumber) AS place FROM lineitem)"


def rank_stream(spark, sf_dir, out: str, hand_out: int = 0):
    rows = streams.read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("hash"), F.col("l_quantity").cast("int").alias("seeders"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"))
    stream = streams.ranked(rows, out, f"{out}-state", 1000, hand_out=hand_out)
    finished(stream)
    return rows.schema, stream.lastProgress["batchId"]


@query("SELECT hash, seeders, seq FROM ranked WHERE place <= 1000", (_STREAM_RANK,))
def stream_rank(spark, sf_dir):
    out = scratch(spark, "rank")
    return streams.drained(spark, out, *rank_stream(spark, sf_dir, out))


@query("SELECT hash, seeders, seq, place <= 300 AS handed_out FROM ranked WHERE place <= 1000", (_STREAM_RANK,))
def stream_hand_out(spark, sf_dir):
    """The best of the queue leave it, the others wait."""
    out = scratch(spark, "rank")
    schema, n = rank_stream(spark, sf_dir, out, 300)
    gone = spark.read.schema(schema).parquet(f"{out}/out").drop("batch")
    return gone.withColumn("handed_out", F.lit(True)).unionByName(streams.drained(spark, out, schema, n).withColumn("handed_out", F.lit(False)))


@query("SELECT user_id AS hash, event_id AS seq, ((row_number() OVER (ORDER BY event_id) - 1) // 70)::BIGINT AS batch, ((row_number() OVER (ORDER BY event_id) - 1) % 70 + 1)::INTEGER AS i FROM events")
def stream_batches(spark, sf_dir):
    out = scratch(spark, "requests")
    rows = streams.read_table(spark, sf_dir, "events").select(F.col("user_id").alias("hash"), F.col("event_id").alias("seq"))
    finished(streams.batched(rows, out, f"{out}-state", [F.col("seq")], every=None))
    return spark.read.schema("hash long, seq long, batch long, i int").parquet(out).drop("part")


_DUE = "RECURSIVE e AS (SELECT user_id AS addr, epoch_us(ts) / 1000000.0 AS t, CASE WHEN event_type = 'purchase' THEN CASE WHEN coalesce(k, 0) <= 0 THEN 900 ELSE least(greatest(k, 60), 7200) END ELSE 0 END AS wait, row_number() OVER (PARTITION BY user_id ORDER BY ts, CASE WHEN event_type = 'purchase' THEN CASE WHEN coalesce(k, 0) <= 0 THEN 900 ELSE least(greatest(k, 60), 7200) END ELSE 0 END) AS n FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) * 120 AS k FROM events WHERE event_type <> 'error')), d AS (SELECT addr, n, t, CASE WHEN wait > 0 THEN t + wait ELSE t + 3600 END AS due, wait = 0 AS offered FROM e WHERE n = 1 UNION ALL SELECT e.addr, e.n, e.t, CASE WHEN e.wait > 0 THEN e.t + e.wait WHEN e.t >= d.due THEN e.t + 3600 ELSE d.due END, e.wait = 0 AND e.t >= d.due FROM d JOIN e ON e.addr = d.addr AND e.n = d.n + 1)"


@query("SELECT addr, t AS at FROM d WHERE offered", (_DUE,))
def stream_due(spark, sf_dir):
    """Purchases stand for replies, other events for sightings, an hour is reserved."""
    out = scratch(spark, "due")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    e = fed(T.table(spark, sf_dir, "events"), "ts")
    obs = e.select(F.col("user_id").alias("addr"), F.when(F.col("event_type") == "error", 0).otherwise(6881).alias("port"), "ts", (F.col("event_type") == "purchase").alias("answered"), (F.get_json_object("props", "$.k").cast("long") * 120).alias("interval_s"))
    return kept_rows(spark, streams.due_nodes(obs, 3600.0, late="60 days"), out)


def kept_rows(spark, rows: DataFrame, out: str) -> DataFrame:
    """What a stream of updates gives over all its batches."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")

    finished(rows.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start())
    return spark.read.schema(rows.schema).parquet(f"{out}/rows").drop("batch")


@query(_BUCKET_ROWS, (_BUCKET,))
def stream_bucket(spark, sf_dir):
    out = scratch(spark, "bucket")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    log = request_log(fed(T.table(spark, sf_dir, "events"), "ts"))
    rows = kept_rows(spark, streams.buckets(log, 1 / 14400, 2.0), out)
    return rows.groupBy("client").agg(F.sum("allowed").alias("allowed"), F.sum("rejected").alias("rejected"))


_IDLE = _BUCKET.replace("(CASE WHEN least(2.0", "(CASE WHEN e.t - b.t > 36000 THEN 1.0::DOUBLE WHEN least(2.0").replace("END)::DOUBLE, least(2.0", "END)::DOUBLE, e.t - b.t > 36000 OR least(2.0")


@query(_BUCKET_ROWS, (_IDLE,))
def stream_bucket_idle(spark, sf_dir):
    """Clients idle for ten hours are forgotten."""
    out = scratch(spark, "bucket")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    log = request_log(fed(T.table(spark, sf_dir, "events"), "ts"))
    rows = kept_rows(spark, streams.buckets(log, 1 / 14400, 2.0, 36000.0, "60 days"), out)
    return rows.groupBy("client").agg(F.sum("allowed").alias("allowed"), F.sum("rejected").alias("rejected"))


_OLDEST = "RECURSIVE e AS (SELECT user_id, event_id, user_id % 4 AS shard, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS k FROM events), r AS (SELECT shard, k, user_id, event_id, [user_id] AS held, true AS fresh FROM e WHERE k = 1 UNION ALL SELECT e.shard, e.k, e.user_id, e.event_id, CASE WHEN list_contains(r.held, e.user_id) THEN r.held WHEN len(r.held) < 10 THEN list_append(r.held, e.user_id) ELSE list_append(r.held[2:], e.user_id) END, NOT list_contains(r.held, e.user_id) FROM r JOIN e ON e.shard = r.shard AND e.k = r.k + 1)"


@query("SELECT user_id::VARCHAR AS key, event_id AS seq FROM r WHERE fresh", (_OLDEST,))
def stream_dedupe_oldest(spark, sf_dir):
    """Four shards remember ten keys each, over at least five micro-batches."""
    out = scratch(spark, "oldest")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    keys_of = fed(T.table(spark, sf_dir, "events"), "event_id", most=FED).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"))
    kept = bounded.dedupe_oldest(keys_of, F.col("key") % 4, 40, 4)
    finished(kept.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start())
    return spark.read.schema(kept.schema).parquet(f"{out}/rows")


@query("SELECT shard, ((k - 1) // 70)::BIGINT AS batch, ((k - 1) % 70 + 1)::INTEGER AS i, user_id::VARCHAR AS hash, event_id AS seq FROM (SELECT event_id % 4 AS shard, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) AS k, count(*) OVER (PARTITION BY event_id % 4) AS n, user_id, event_id FROM events) WHERE k <= n // 70 * 70")
def stream_requests(spark, sf_dir):
    """The full requests of four shards, filled over at least five micro-batches; what is left waits for an hour."""
    out, rows = scratch(spark, "full"), T.table(spark, sf_dir, "events")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    due = rows.groupBy((F.col("event_id") % 4).alias("shard")).count().agg(F.sum(F.floor(F.col("count") / rank.BATCH) * rank.BATCH)).first()[0]
    sent = bounded.request_batches(fed(rows, "event_id", most=FED).select(F.col("user_id").alias("hash"), F.col("event_id").alias("seq")), F.col("seq") % 4, wait=3600.0)
    n, until = [0], [time.time() + 600]

    def write(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch_no={k}")
        more = spark.read.parquet(f"{out}/rows/batch_no={k}").count()
        n[0] += more
        if more:  # 600 seconds without a request are an error, however long the table is
            until[0] = time.time() + 600

    stream = sent.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{out}/state").trigger(processingTime="100 milliseconds").start()
    while n[0] < due and stream.isActive and time.time() < until[0]:  # with timers a stream doesn't end by itself
        time.sleep(0.2)
    stream.stop()
    if n[0] < due:
        raise TimeoutError(f"the stream did not hand out its requests: {stream.exception()}")
    return spark.read.schema(sent.schema).parquet(f"{out}/rows").select("shard", "batch", "i", "hash", "seq")
