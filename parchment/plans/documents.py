"""Queries for text, pages, entities and streams; those without SQL are tested against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parchment.functions import geometry as G
from parchment.functions import text as T
from parchment.operators import documents, search, strokes
from parchment.operators import relational as R
from parchment.plans.reference import SPOKEN, WIDE, WORDS, query
from parchment.streaming import events

c = F.col


@query(r"""WITH a AS (SELECT page_id, replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '</(h1|h2|h3|h4|h5|h6|p|li|div|tr|section|article|ol|ul)>', ' ' || chr(10), 'gi'), '<br\s*/?>', chr(10), 'gi'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), chr(13), '') AS s FROM pages)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '^\s+|\s+\z', '', 'g') AS plain FROM a""")
def page_structured_text(t):
    return t("pages").select("page_id", T.structured_text(c("html")).alias("plain"))


def _markdown_sql() -> str:
    s = "text"
    for pattern, stands in T.MARKDOWN:
        s = f"regexp_replace({s}, '{pattern}', '{stands.replace('$', chr(92))}', 'g')"
    return f"SELECT doc_id, regexp_replace({s}, '^{WIDE}+|{WIDE}+\\z', '', 'g') AS plain FROM documents"


@query(_markdown_sql())
def markdown_clean(t):
    return t("documents").select("doc_id", T.plain_markdown(c("text")).alias("plain"))


_LEADER = r"regexp_replace({}, '(^|\n)[ \t]*[.\-_=*~]{{4,}}(\s|[\p{{L}}\p{{N}}]|\z)', '\1\2', 'g')"


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + _LEADER.format(_LEADER.format("text")) + r", '[ \t]+\n', chr(10), 'g'), '\n[ \t]+', chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+\z', '', 'g') AS plain FROM documents")
def selection_clean(t):
    return t("documents").select("doc_id", T.selected(c("text")).alias("plain"))


@query(r"SELECT doc_id, len(string_split(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '([.!?]) ([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS n_chunks FROM documents")
def sentence_chunks(t):
    return t("documents").select("doc_id", F.size(T.sentence_chunks(c("text"))).alias("n_chunks"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(lower(regexp_replace(text, '^\s+|\s+\z', '', 'g')), '\s+', ' ', 'g'), '[.,;:]+\z', '') AS noun, regexp_extract(text, '([\p{L}\p{N}''-]+)\z', 1) AS last_word, nullif(regexp_extract(text, '(?m)^#{1,6}\s+(.+)$', 1), '') AS heading, len(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '')) AS n_lines FROM documents")
def text_keys(t):
    text = c("text")
    return t("documents").select("doc_id", T.noun_key(text).alias("noun"), T.word_before(text).alias("last_word"), T.first_heading(text).alias("heading"), F.size(T.lines_to_list(text)).alias("n_lines"))


@query(r"SELECT page_id, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN coalesce(nullif(substr(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda q: starts_with(q, 'v='))[1], 3), ''), nullif(regexp_extract(url, '(?:youtu\.be/|/embed/|/shorts/)([A-Za-z0-9_-]{11})', 1), '')) END AS video FROM pages")
def video_ids(t):
    return t("pages").select("page_id", T.video_id(c("url")).alias("video"))


@query("SELECT p_partkey, upper(substr(split_part(p_name, ' ', 1), 1, 1)) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) AS initials FROM part")
def initials(t):
    return t("part").select("p_partkey", T.initials(c("p_name")).alias("initials"))


@query(f"""WITH w AS (SELECT conv_id, turn, list_distinct({WORDS.format(SPOKEN)}) AS a FROM conversations),
l AS (SELECT *, lag(a) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM w)
SELECT conv_id, turn, CASE WHEN b IS NULL OR len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect(a, b)) / greatest(len(a), len(b)), 6) END AS similarity FROM l""")
def lag_similarity(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    d = t("conversations").select("conv_id", "turn", F.array_distinct(T.word_list(T.dictation_key(c("text")))).alias("a"))
    d = d.withColumn("b", F.lag("a").over(w))
    return d.select("conv_id", "turn", F.coalesce(F.round(T.set_similarity(c("a"), F.coalesce("b", F.array().cast("array<string>"))), 6), F.lit(0.0)).alias("similarity"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k, coalesce((props->>'missing'), 'none') AS other FROM events")
def json_props(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("other"))


@query("SELECT l_orderkey, string_agg(CASE WHEN l_linenumber = 2 THEN 'done' ELSE l_returnflag END, ',' ORDER BY l_linenumber, l_partkey, l_returnflag) AS states FROM lineitem GROUP BY l_orderkey")
def nested_arrays(t):
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag")))
    changed = F.transform(rows, lambda r: F.when(r["l_linenumber"] == 2, "done").otherwise(r["l_returnflag"]))
    return t("lineitem").groupBy("l_orderkey").agg(F.array_join(changed, ",").alias("states"))


_CELLS = "SELECT DISTINCT l_orderkey AS table_id, l_linenumber % 3 AS row, l_linenumber % 2 AS col, l_linenumber AS ord FROM lineitem"


@query(f"WITH c AS ({_CELLS}), e AS (SELECT table_id, row + i AS r, col + j AS c, ord, i = 0 AND j = 0 AS owner FROM c, range(2) a(i), range(2) b(j)) SELECT table_id, r, c, max(ord) AS ord, max_by(owner, ord) AS owner FROM e GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY table_id, r, c"))
def grid_expand(t):
    cells = R.spread(t("lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey").select(c("l_orderkey").alias("table_id"), (c("l_linenumber") % 3).alias("row"), (c("l_linenumber") % 2).alias("col"), c("l_linenumber").alias("ord"), F.lit(2).alias("row_span"), F.lit(2).alias("col_span"))
    return R.grid(cells.distinct(), ["table_id"])


@query("SELECT 'either' AS kind, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'only', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT s_suppkey FROM supplier)")
def union_except(t):
    either = t("customer").select("c_nationkey").union(t("supplier").select("s_nationkey")).distinct().agg(F.lit("either").alias("kind"), F.count("*").alias("n"))
    only = t("orders").select("o_custkey").subtract(t("supplier").select("s_suppkey")).agg(F.lit("only").alias("kind"), F.count("*").alias("n"))
    return either.unionByName(only)


@query("SELECT l_orderkey, l_linenumber, least(l_quantity, l_discount * 100) * 1.5 AS \"left\", abs(l_discount * 100 - l_quantity) * 1.5 AS width, round(sqrt((l_quantity - least(greatest(l_quantity, 0), 10)) ** 2 + (l_tax * 100) ** 2), 6) AS distance FROM lineitem")
def boxes(t):
    d = t("lineitem").withColumn("r", G.scaled_rect(F.array("l_quantity", "l_tax", c("l_discount") * 100, "l_tax"), F.lit(1.5)))
    zero, ten = F.lit(0.0), F.lit(10.0)
    return d.select("l_orderkey", "l_linenumber", c("r.left").alias("left"), c("r.width").alias("width"), F.round(G.segment_distance(c("l_quantity"), c("l_tax") * 100, zero, zero, ten, zero), 6).alias("distance"))


@query("SELECT doc_id, CASE WHEN contains(s, 'of the') THEN 'exact' WHEN contains(lower(s), 'of the') THEN 'case_insensitive' WHEN contains(lower(replace(s, ' ', '')), 'ofthe') THEN 'compact' END AS stage FROM (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS s FROM documents)")
def search_exact_ci(t):
    return t("documents").select("doc_id", search.exact_stage(c("text"), "of the").alias("stage"))


@query(None)
def search_hits(t):
    return search.search_pages(t("documents"), "doc_id", "text", "and the")


@query("""WITH RECURSIVE i AS (SELECT l_orderkey AS k, l_partkey::DOUBLE AS x1, l_partkey + 5.0 AS x2, l_quantity AS y1, l_quantity + 10 AS y2, l_returnflag AS text, l_linenumber AS ord, greatest(4, 0.6 * avg(10.0) OVER (PARTITION BY l_orderkey)) AS tolerance, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_partkey, l_returnflag) AS n FROM lineitem),
f AS (SELECT k, n, y1 AS top, 0 AS line FROM i WHERE n = 1 UNION ALL SELECT i.k, i.n, CASE WHEN abs(i.y1 - f.top) > tolerance THEN i.y1 ELSE f.top END, f.line + (abs(i.y1 - f.top) > tolerance)::INT FROM f JOIN i ON i.k = f.k AND i.n = f.n + 1)
SELECT i.k AS l_orderkey, line, min(y1) AS y1, max(y2) AS y2, min(x1) AS x1, max(x2)::DOUBLE AS x2, string_agg(text, ' ' ORDER BY x1, y1, ord, text) AS text FROM i JOIN f ON i.k = f.k AND i.n = f.n GROUP BY i.k, line""")
def page_lines(t):
    q = c("l_quantity")
    return documents.page_lines(t("lineitem").select("l_orderkey", c("l_partkey").alias("x1"), (c("l_partkey") + 5).alias("x2"), q.alias("y1"), (q + 10).alias("y2"), c("l_returnflag").alias("text"), c("l_linenumber").alias("ord")), ["l_orderkey"])


@query("""WITH e AS (SELECT l_orderkey, l_linenumber AS ord, CASE WHEN l_returnflag = 'N' THEN 'main' ELSE l_returnflag END AS flow, l_suppkey AS i FROM lineitem WHERE l_linenumber <> 3),
f AS (SELECT *, min(i) OVER (PARTITION BY l_orderkey, flow) AS a, min(ord) OVER (PARTITION BY l_orderkey, flow) AS b FROM e)
SELECT l_orderkey, ord, flow, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY a, b) AS flow_rank, row_number() OVER (PARTITION BY l_orderkey, flow ORDER BY i, ord) AS place FROM f""")
def flow_order(t):
    d = t("lineitem").select("l_orderkey", c("l_linenumber").alias("ord"), F.when(c("l_linenumber") == 3, "p").alias("parent_id"), F.when(c("l_returnflag") != "N", c("l_returnflag")).alias("flow_region_id"), c("l_suppkey").alias("reading_order_index"))
    return documents.reading_order(d, ["l_orderkey"]).select("l_orderkey", "ord", "flow", "flow_rank", "place")


@query("""WITH s AS (SELECT n_name AS schema, CASE WHEN r_name = 'ASIA' THEN 'Unassigned Domain' ELSE r_name END AS domain, s_suppkey FROM nation JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE n_name NOT LIKE '%U%'),
v AS (SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS ord, l_suppkey, l_shipdate, l_quantity FROM lineitem)
SELECT domain, schema, 'TRACE ' || l_suppkey AS trace, v.ord::VARCHAR AS id, l_quantity::BIGINT::VARCHAR AS value, row_number() OVER (PARTITION BY schema ORDER BY l_shipdate, v.ord) AS place FROM v LEFT JOIN s ON l_suppkey = s_suppkey""")
def entity_series(t):
    n, s = t("nation").where("n_name not like '%U%'"), t("supplier")  # readings of the other nations have no schema
    text = lambda e, name: F.expr(e).cast("string").alias(name)
    schemas = n.join(t("region"), c("n_regionkey") == c("r_regionkey")).select(text("n_nationkey", "id"), F.lit("schema").alias("type"), c("n_name").alias("name"), F.nullif("r_name", F.lit("ASIA")).alias("domain"), c("n_nationkey").cast("long").alias("ord"))
    traces = s.join(n, c("s_nationkey") == c("n_nationkey")).select(text("s_suppkey", "id"), F.lit("trace").alias("type"), text("'Trace ' || s_suppkey", "name"), F.lower("n_name").alias("parent_schema"), c("s_suppkey").alias("ord"))
    number = ((c("l_orderkey") * 10 + c("l_linenumber")) * 100_000 + c("l_partkey")) * 10_000 + c("l_suppkey")  # order and line alone repeat
    values = t("lineitem").select(number.cast("string").alias("id"), F.lit("trace_value").alias("type"), text("'TRACE ' || l_suppkey", "trace_name"), text("cast(l_quantity as bigint)", "value"), F.lit(None).cast("string").alias("unit"), c("l_shipdate").alias("created_at"), number.alias("ord"))
    log = schemas.unionByName(traces, allowMissingColumns=True).unionByName(values, allowMissingColumns=True)
    return documents.entity_series(log).select("domain", "schema", "trace", "id", "value", "place")


@query("SELECT DISTINCT user_id, event_type FROM events", session=True)
def stream_dedupe(spark, sf_dir):
    return events.run_available(spark, f"{sf_dir}/events.parquet", lambda s: events.first_seen(s.select("user_id", "event_type"), ["user_id", "event_type"]))


@query(f"""WITH w AS (SELECT conv_id AS key, turn AS ord, text, {WORDS.format(SPOKEN)} AS a FROM conversations),
l AS (SELECT *, coalesce(lag(a) OVER (PARTITION BY key ORDER BY ord), []) AS b FROM w),
m AS (SELECT *, len(a) >= 5 AND len(b) >= 5 AND len(a) >= len(b) - 3 AND len(a) <= len(b) + 5 AND len(list_intersect(list_distinct(a), list_distinct(b))) / greatest(len(list_distinct(a)), len(list_distinct(b))) >= 0.82 AS replaces FROM l)
SELECT key, (sum(CASE WHEN replaces THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY ord))::BIGINT AS phrase, ord, replaces, text FROM m""", session=True)
def stream_phrases(spark, sf_dir):
    return events.run_available(spark, f"{sf_dir}/conversations.parquet", lambda s: events.phrases(s, "conv_id", "turn", "text"))


@query("""WITH s AS (SELECT event_id, user_id, epoch_us(ts) AS t, value FROM events),
f AS (SELECT *, first_value(t) OVER w AS ft, first_value(value) OVER w AS fv FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW))
SELECT event_id, CASE WHEN t > ft THEN round((value - fv) / (t - ft) * 1e9, 6) ELSE 0.0 END AS vx FROM f""")
def rolling_velocity(t):
    d = t("events").select("event_id", "user_id", F.unix_micros(c("ts").cast("timestamp")).alias("t"), "value")
    return strokes.velocity(d, ["user_id"], "t", "event_id", "value", "value", 86_400_000_000).select("event_id", F.when(c("vx") != 0, F.round(c("vx") * 1e9, 6)).otherwise(F.lit(0.0)).alias("vx"))


@query("SELECT conv_id, arg_max(text, turn) AS caption FROM conversations GROUP BY conv_id HAVING arg_max(role, turn) <> 'assistant'")
def open_captions(t):
    return events.captions(t("conversations").withColumn("final", c("role") == "assistant"), "conv_id", "turn", "text", "final")


@query(None)
def pen_strokes(t):
    point = F.struct(c("l_linenumber").cast("double").alias("t"), c("l_quantity").alias("x"), (c("l_discount") * 100).alias("y"), F.lit(0.5).alias("pressure"))
    points = F.transform(F.sort_array(F.collect_list(point)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["t"].alias("t"), p["pressure"].alias("pressure")))
    lines = R.spread(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), "l_orderkey")  # rows are shuffled, arrays that tasks made before would spill
    return lines.groupBy("l_orderkey").agg(points.alias("points")).select("l_orderkey", strokes.finish_strokes(c("points"), dynamic=True).alias("points"))
