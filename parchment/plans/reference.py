"""The operators as queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parchment.functions import text as T
from parchment.operators import relational as R
from parchment.operators import trees

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
c = F.col


def query(sql: str | None, session: bool = False):
    """Registers a query of a reader of tables or, with `session`, of the session and the folder."""

    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir) if session else f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        _QUERIES[f.__name__] = run
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


#: White space in SQL as text.SPACE has it.
WIDE = r"[\s\x0B\p{Z}\x{FEFF}]"
WORDS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')"


SPOKEN = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '\b(uh|um|erm|er|ah|hmm|mm+|uhh+|umm+)\b', ' ', 'g'), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, len({WORDS.format('text')}) AS n_words FROM documents WHERE contains(lower(text), 'the') ORDER BY n_words DESC, doc_id LIMIT 20")
def top_documents(t):
    return t("documents").where(R.contains_any_case("the", "text")).select("doc_id", T.words(c("text")).alias("n_words")).orderBy(F.desc("n_words"), "doc_id").limit(20)


@query(f"SELECT doc_id, len({WORDS.format('text')}) AS n_words FROM documents")
def doc_word_count(t):
    return t("documents").select("doc_id", T.words(c("text")).alias("n_words"))


@query(f"SELECT doc_id, len(list_distinct(list_filter(list_transform({WORDS.format('lower(text)')}, lambda w: regexp_replace(w, '[^a-z0-9À-ɏ]', '', 'g')), lambda w: w <> ''))) AS n_words FROM documents")
def doc_unique_words(t):
    return t("documents").select("doc_id", T.distinct_words(c("text")).alias("n_words"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM pages")
def page_strip_html(t):
    return t("pages").select("page_id", T.strip_html(c("html")).alias("plain"))


@query("SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS normalized, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS folded, regexp_replace(text, '\\s+', '', 'g') AS compact FROM documents")
def normalized_text(t):
    return t("documents").select("doc_id", T.collapse(c("text")).alias("normalized"), F.lower(T.collapse(c("text"))).alias("folded"), T.compact(c("text")).alias("compact"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}][\\p{L}\\p{N}''-]*')) AS n_tokens FROM documents")
def token_count(t):
    return t("documents").select("doc_id", F.size(T.tokens(c("text"))).alias("n_tokens"))


@query("SELECT doc_id, (length(text) - length(replace(text, 'th', ''))) // 2 AS n FROM documents")
def occurrence_count(t):
    return t("documents").select("doc_id", T.occurrences(c("text"), "th").cast("long").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'an')")
def haystack_filter(t):
    return t("part").where(R.contains_any_case(" AN ", "p_name", "p_brand", "p_type")).select("p_partkey", "p_name")


@query("SELECT doc_id, coalesce(l.quality, -1) AS quality FROM documents LEFT JOIN labels l USING (doc_id)")
def left_lookup_default(t):
    return R.lookup(t("documents").select("doc_id"), t("labels"), ["doc_id"], "quality", ["toxic", "quality"], -1)


@query("SELECT 'semi' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'anti', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def semi_anti(t):
    keys = t("orders").select(c("o_custkey").alias("c_custkey"))
    return t("customer").join(keys, "c_custkey", "left_semi").agg(F.lit("semi").alias("kind"), F.count("*").alias("n")).unionByName(t("customer").join(keys, "c_custkey", "left_anti").agg(F.lit("anti").alias("kind"), F.count("*").alias("n"))).select("kind", "n")


@query("SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'assistant') AS n_assistant FROM conversations GROUP BY conv_id")
def count_by_category(t):
    return t("conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(c("role") == "assistant").alias("n_assistant"))


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY source")
def pivot_counts(t):
    langs = ["en", "de", "fr", "es"]
    return t("documents").groupBy("source").pivot("lang", langs).count().fillna(0, langs)


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def distinct_on_first(t):
    return R.first_by(t("events"), ["user_id"], [c("ts"), c("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT p_brand, count(*) AS n, min(p_size) AS first_size, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS types FROM part GROUP BY p_brand")
def group_collect(t):
    return t("part").groupBy("p_brand").agg(F.count("*").alias("n"), F.min("p_size").alias("first_size"), F.array_join(F.sort_array(F.collect_set("p_type")), "|").alias("types"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS ord FROM events")
def order_in_series(t):
    return R.numbered(t("events"), ["user_id", "event_type"], [c("ts"), c("event_id")]).select("event_id", "ord")


@query("SELECT conv_id, turn, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_at FROM conversations")
def running_offset(t):
    return R.running_offset(t("conversations"), ["conv_id"], [c("turn")], F.length("text") + 1).select("conv_id", "turn", "start_at")


@query("""WITH w AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, island, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN before IS NULL OR epoch_us(ts) - epoch_us(before) > 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS island FROM w) GROUP BY ALL""")
def gap_islands(t):
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = t("events").select("user_id", "event_id", "ts", F.timestamp_diff("MICROSECOND", before, c("ts")).alias("gap"))
    return R.islands(rows, ["user_id"], [c("ts"), c("event_id")], c("gap") > 86_400_000_000).groupBy("user_id", "island").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def last_n_history(t):
    return R.last_n(t("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id")


@query("""SELECT e.event_id, (SELECT max_by(s.event_id, (s.ts, s.event_id)) FROM events s WHERE s.event_type = 'purchase' AND s.user_id = e.user_id AND s.ts <= e.ts) AS last_purchase FROM events e WHERE e.event_type = 'click'""")
def asof_state(t):
    e = t("events")
    states = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("state"))
    return R.as_of(e.where("event_type = 'click'").select("user_id", "ts", "event_id"), states, ["user_id"], "ts", "state", "last_purchase").select("event_id", "last_purchase")


@query("""WITH a AS (SELECT l_orderkey % 50 AS k, l_partkey AS a_from, l_partkey + 40 AS a_to FROM lineitem), b AS (SELECT o_orderkey % 50 AS k, o_custkey AS b_from, o_custkey + 25 AS b_to FROM orders)
SELECT k, count(*) AS n, sum(least(a_to, b_to) - greatest(a_from, b_from))::BIGINT AS common FROM a JOIN b USING (k) WHERE a_from < b_to AND b_from < a_to GROUP BY k""")
def overlap_ranges(t):
    a = t("lineitem").select((c("l_orderkey") % 50).alias("k"), c("l_partkey").alias("a_from"), (c("l_partkey") + 40).alias("a_to"))
    b = t("orders").select((c("o_orderkey") % 50).alias("k"), c("o_custkey").alias("b_from"), (c("o_custkey") + 25).alias("b_to"))
    return R.overlaps(a, b, ["k"], 64).groupBy("k").agg(F.count("*").alias("n"), F.sum(c("to") - c("from")).alias("common"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 4")
def topk_coalesce(t):
    return t("orders").where("o_orderstatus = 'O'").orderBy(F.coalesce("o_orderdate"), "o_orderkey").limit(4).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, CASE WHEN s_suppkey IS NOT NULL THEN s_acctbal ELSE c_acctbal END AS acctbal FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey UNION ALL SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)")
def upsert(t):
    rows = t("customer").select("c_custkey", c("c_acctbal").alias("acctbal"))
    return R.upsert(rows, t("supplier").select(c("s_suppkey").alias("c_custkey"), c("s_acctbal").alias("acctbal")), "c_custkey")


_EDGES = "SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier"


@query(f"WITH RECURSIVE e AS ({_EDGES}), up AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT up.node, e.parent, depth + 1 FROM up JOIN e ON e.child = up.ancestor) SELECT * FROM up")
def ancestor_closure(t):
    label = lambda p, k: F.concat(F.lit(p), c(k).cast("string"))
    edges = t("nation").select(label("n", "n_nationkey").alias("child"), label("r", "n_regionkey").alias("parent"))
    return trees.ancestors(edges.unionByName(t("supplier").select(label("s", "s_suppkey").alias("child"), label("n", "s_nationkey").alias("parent"))), "child", "parent")


@query("SELECT floor(l_extendedprice / 1000)::BIGINT AS bucket, count(*) AS votes FROM lineitem GROUP BY 1 HAVING count(*) >= greatest(3, ceil(0.01 * (SELECT count(*) FROM lineitem))) ORDER BY votes DESC, bucket LIMIT 2")
def vote_histogram(t):
    rows = t("lineitem").groupBy(F.floor(c("l_extendedprice") / 1000).alias("bucket")).agg(F.count("*").alias("votes"))
    everything = Window.partitionBy(F.lit(1))
    return rows.withColumn("all", F.sum("votes").over(everything)).where(c("votes") >= F.greatest(F.lit(3), F.ceil(0.01 * c("all")))).select("bucket", "votes").orderBy(F.desc("votes"), "bucket").limit(2)


@query("SELECT doc_id, CASE WHEN n_chars < 50 THEN 'scanned' WHEN n_chars < 300 THEN 'mixed' ELSE 'text' END AS kind FROM documents")
def density_class(t):
    return t("documents").select("doc_id", F.when(c("n_chars") < 50, "scanned").when(c("n_chars") < 300, "mixed").otherwise("text").alias("kind"))


@query("SELECT CASE WHEN o_orderkey > 100 THEN o_orderkey + 1 ELSE o_orderkey END AS page, o_custkey FROM orders WHERE o_orderkey <> 57")
def key_shift(t):
    return t("orders").where("o_orderkey <> 57").select(F.when(c("o_orderkey") > 100, c("o_orderkey") + 1).otherwise(c("o_orderkey")).alias("page"), "o_custkey")


@query("SELECT event_id, avg(value) OVER w AS mean_value, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)".replace("avg(value) OVER w", "max(value) OVER w").replace("mean_value", "max_value"))
def rolling_range(t):
    us = F.unix_micros(c("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(us).rangeBetween(-3_600_000_000, 0)
    return t("events").select("event_id", F.max("value").over(w).alias("max_value"), F.count("*").over(w).alias("n"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS label FROM events")
def date_labels(t):
    return t("events").select("event_id", F.coalesce(F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("—")).alias("label"))


@query("SELECT doc_id, CASE WHEN n_chars // 3600 > 0 THEN printf('%d:%02d:%02d', n_chars // 3600, n_chars % 3600 // 60, n_chars % 60) WHEN n_chars = 0 THEN '' ELSE printf('%d:%02d', n_chars // 60, n_chars % 60) END AS clock FROM documents")
def durations(t):
    return t("documents").select("doc_id", T.clock(c("n_chars")).alias("clock"))


@query("SELECT s_suppkey, regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM supplier")
def slugs(t):
    return t("supplier").select("s_suppkey", T.slug(c("s_name")).alias("slug"))


@query(f"SELECT conv_id, turn, {SPOKEN} AS key FROM conversations")
def dictation_clean(t):
    return t("conversations").select("conv_id", "turn", T.dictation_key(c("text")).alias("key"))


@query("""WITH d AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM documents) SELECT doc_id, n_chars FROM d WHERE coalesce(before, 0) < 50000 ORDER BY n_chars DESC, doc_id LIMIT 10""")
def early_stop_topk(t):
    d = t("documents").select("doc_id", "n_chars")
    block = F.floor(c("doc_id") / 1000)  # running sums in two levels: blocks first, so no window holds all rows
    d = d.withColumn("block", block)
    blocks = d.groupBy("block").agg(F.sum("n_chars").alias("s"))
    blocks = blocks.select("block", (F.sum("s").over(Window.orderBy("block")) - c("s")).alias("earlier"))
    own = F.coalesce(F.sum("n_chars").over(Window.partitionBy("block").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("own", own).join(blocks, "block").where(c("own") + c("earlier") < 50_000).select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(10)
