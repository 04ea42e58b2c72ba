"""Queries of further text rules, filters, guards, and of tables that are written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parchment.functions import geometry as G
from parchment.functions import text as T
from parchment.operators import places
from parchment.operators import relational as R
from parchment.plans.inline import Beside, Rows
from parchment.plans.reference import SPOKEN, WIDE, WORDS, query
from parchment.plans.texts import ALL_TEXTS, texts, trim_sql
from parchment.sources import tables, versions
from parchment.sources.scratch import new_path
from parchment.streaming import events

c = F.col


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT CASE WHEN o_orderkey > 57 THEN o_orderkey - 1 ELSE o_orderkey END AS page, o_custkey FROM orders WHERE o_orderkey <> 57")
def deleted_page(t):
    return t("orders").where("o_orderkey <> 57").select(F.when(c("o_orderkey") > 57, c("o_orderkey") - 1).otherwise(c("o_orderkey")).alias("page"), "o_custkey")


@query("SELECT page_id, trim(coalesce(split_part(url, '/', 3), '')) || '::' || page_id % 3 AS grp FROM pages WHERE page_id % 3 = 1 AND contains(lower(page_id || ' ' || coalesce(url, '') || ' ' || trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' ', 'g'), '\\s+', ' ', 'g'))), 'the')")
def objectives(t):
    d = t("pages").withColumn("grp", F.concat(F.trim(F.coalesce(F.split_part("url", F.lit("/"), F.lit(3)), F.lit(""))), F.lit("::"), (c("page_id") % 3).cast("string")))
    d = d.withColumn("id", c("page_id").cast("string")).withColumn("plain", T.strip_html(c("html"))).withColumn("url", F.coalesce("url", F.lit("")))
    return d.where((c("page_id") % 3 == 1) & R.contains_any_case(" The ", "id", "url", "plain")).select("page_id", "grp")


@query("WITH l AS (SELECT n_regionkey AS level, list(n_name ORDER BY n_nationkey) AS cards FROM nation GROUP BY n_regionkey), f AS (SELECT level, unnest(cards) AS card FROM l) SELECT level, card, card IN ('CHINA', 'FRANCE', 'NATION_7', 'KENYA', 'PERU') AS building FROM f")
def level_cards(t):
    levels = t("nation").groupBy(c("n_regionkey").alias("level")).agg(F.collect_list("n_name").alias("cards"))
    return levels.select("level", F.explode("cards").alias("card")).withColumn("building", c("card").isin("CHINA", "FRANCE", "NATION_7", "KENYA", "PERU"))


_WANTED = Rows("wish long, id long", [(1, 3), (2, -5), (3, None)])


@query(f"SELECT wish, c_name AS name FROM {_WANTED.sql} LEFT JOIN customer ON c_custkey = id", session=True)
def found_or_none(spark, sf_dir):
    return _WANTED.frame(spark).join(table(spark, sf_dir, "customer").select(c("c_custkey").alias("id"), c("c_name").alias("name")), "id", "left").select("wish", "name")


@query("SELECT p_brand, string_agg(p_partkey, ',' ORDER BY p_partkey) FILTER (p_size % 3 = 0) AS zero, string_agg(p_partkey, ',' ORDER BY p_partkey) FILTER (p_size % 3 = 1) AS one, count(*) FILTER (p_size % 3 < 2) AS n FROM part GROUP BY p_brand")
def pivoted_lists(t):
    keys = t("part").select("p_brand", "p_partkey", F.element_at(F.array(F.lit("zero"), F.lit("one"), F.lit("two")), c("p_size") % 3 + 1).alias("mode"))
    d = keys.groupBy("p_brand").pivot("mode", ["zero", "one"]).agg(F.sort_array(F.collect_list("p_partkey")))
    show = lambda n: F.when(F.size(n) > 0, F.array_join(F.transform(n, lambda x: x.cast("string")), ","))
    return d.select("p_brand", show("zero").alias("zero"), show("one").alias("one"), (F.coalesce(F.size("zero"), F.lit(0)) + F.coalesce(F.size("one"), F.lit(0))).cast("long").alias("n"))


@query("SELECT lower(n_name) AS schema, string_agg(DISTINCT 'Trace ' || s_suppkey % 7, '|' ORDER BY 'Trace ' || s_suppkey % 7) AS traces FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY lower(n_name)")
def trace_names(t):
    s = t("supplier").join(t("nation"), c("s_nationkey") == c("n_nationkey"))
    return s.groupBy(F.lower("n_name").alias("schema")).agg(F.array_join(F.sort_array(F.collect_set(F.concat(F.lit("Trace "), (c("s_suppkey") % 7).cast("string")))), "|").alias("traces"))


@query("""WITH p AS (SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page, event_id % 400 AS chars FROM events), a AS (SELECT *, max(page) OVER (PARTITION BY k) AS n FROM p), s AS (SELECT *, least(10, n) AS most, greatest(1, n // least(10, n)) AS step FROM a)
SELECT k, round(avg(chars), 6) AS chars_per_page, CASE WHEN avg(chars) < 50 THEN 'scanned' WHEN avg(chars) < 300 THEN 'mixed' ELSE 'text-based' END AS kind FROM s WHERE (page - 1) % step = 0 AND (page - 1) // step < most GROUP BY k""")
def sampled_densities(t):
    p = t("events").select(c("user_id").alias("k"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("page"), (c("event_id") % 400).alias("chars"))
    return places.sampled_density(p, ["k"], "page", "chars").withColumn("chars_per_page", F.round("chars_per_page", 6))


_SPOKEN_STEPS = (("```[\\s\\S]*?```", ", code block,"), ("`([^`]+)`", "\\1"), ("(?m)^#{1,6}\\s+", ""), ("\\*{1,3}([^*]+)\\*{1,3}", "\\1"), ("(?m)^\\s*[-*]\\s", ""), ("(?m)^\\s*\\d+\\.\\s", ""), ("\\[([^\\]]+)\\]\\([^)]+\\)", "\\1"), ("(?m)^>\\s*", ""), ("---+", ""), ("\\s+", " "))


def _spoken_sql() -> str:
    s = "text"
    for pattern, stands in _SPOKEN_STEPS:
        s = f"regexp_replace({s}, '{pattern}', '{stands}', 'g')"
    return trim_sql(s)


_KEY = SPOKEN.replace(r"\s+", WIDE + "+").replace(r"[^\p{L}\p{N}\s]", r"[^\p{L}\p{N}\s\p{Z}\x{FEFF}]")


@query(f"""SELECT doc_id, {_spoken_sql()} AS spoken, {trim_sql(f"regexp_replace(replace(text, chr(13), ''), '{WIDE}+', ' ', 'g')")} AS ocr, regexp_replace(text, '<[^>]*>', ' ', 'g') AS untagged,
 {trim_sql("text")} <> '' AND (regexp_matches(lower(text), '\\b(uh|um|erm|er|ah|hmm|mm+|uhh+|umm+)\\b') OR regexp_matches({_KEY}, '(?i)\\b[a-z]{{1,2}}(?:\\s+[a-z]{{1,2}}){{3,}}\\b') OR len({WORDS.format(_KEY)}) >= 14) AS corrected FROM {ALL_TEXTS}""", session=True)
def spoken_rules(spark, sf_dir):
    text = c("text")
    return texts(spark, sf_dir).select("doc_id", T.spoken_markdown(text).alias("spoken"), T.ocr_text(text).alias("ocr"), T.plain_tags(text).alias("untagged"), T.needs_correction(text).alias("corrected"))


_BLOCKED = r"""regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)</(h1|h2|h3|h4|h5|h6|p|li|div|tr|section|article|ol|ul)>', ' ' || chr(10), 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), chr(13), ''),
 '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g')"""


@query(f"""WITH p AS (SELECT doc_id, {trim_sql(_BLOCKED)} AS text FROM {ALL_TEXTS}), s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n{{2,}}')) AS p FROM p),
b AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(p, '\\n+', ' ', 'g'), '[^.!?]+[.!?]+|[^.!?]+\\z')) AS u FROM s) SELECT doc_id, count(*) FILTER ({trim_sql('u')} <> '') AS n_units, sum(length({trim_sql('u')}))::BIGINT AS n_signs FROM b GROUP BY doc_id HAVING count(*) FILTER ({trim_sql('u')} <> '') > 0""", session=True)
def sentence_counts(spark, sf_dir):
    d = texts(spark, sf_dir).select("doc_id", T.sentence_units(c("text")).alias("u"))
    return d.select("doc_id", F.size("u").cast("long").alias("n_units"), F.length(F.array_join("u", "")).cast("long").alias("n_signs")).where("n_units > 0")


_SIGNS = Rows("id long, text string", [(1, "β-blocker and αΔ"), (2, "modern corn clever"), (3, "vvrn cl-rn"), (4, ""), (5, "μ-π σ τφω")])


@query(f"""SELECT id, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, 'α', 'alpha'), 'β', 'beta'), 'γ', 'gamma'), 'δ', 'delta'), 'ε', 'epsilon'), 'θ', 'theta'), 'λ', 'lambda'), 'μ', 'mu'), 'π', 'pi'), 'σ', 'sigma'), 'τ', 'tau'), 'φ', 'phi'), 'ω', 'omega'), '-', '') AS named,
 replace(replace(replace(text, 'rn', 'm'), 'vv', 'w'), 'cl', 'd') AS scanned FROM (SELECT * FROM {_SIGNS.sql} UNION ALL SELECT doc_id + 10, text FROM documents)""", session=True)
def folded_signs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((c("doc_id") + 10).alias("id"), "text").unionByName(_SIGNS.frame(spark))
    return d.select("id", T.alias_fold(c("text")).alias("named"), T.ocr_canonical(c("text")).alias("scanned"))


_PAIRS = Beside(Rows("id long, a string, b string", [(1, "bradycardia", "tachycardia"), (2, "hypertension", "hypotension"), (3, "hypotension", "hypertension"), (4, "antigen", "progeny"), (5, "heart", "heart"), (6, "no pain", "some pain"), (7, "not here", "never there"), (8, "denies pain", "denies pain"), (9, "", "x")]), "part", "p_partkey + 10", "concat(CASE p_size % 3 WHEN 0 THEN 'hyper' WHEN 1 THEN 'no ' ELSE '' END, p_name)", "concat(CASE p_size % 2 WHEN 0 THEN 'hypo' ELSE '' END, lower(p_type))")


@query(f"""WITH p AS (SELECT *, list_has_any(string_split(a, ' '), ['no', 'not', 'without', 'denies', 'negative', 'absent', 'never']) AS na, list_has_any(string_split(b, ' '), ['no', 'not', 'without', 'denies', 'negative', 'absent', 'never']) AS nb FROM {_PAIRS.sql})
SELECT id, starts_with(a, 'brady') AND starts_with(b, 'tachy') OR starts_with(a, 'tachy') AND starts_with(b, 'brady') OR starts_with(a, 'hyper') AND starts_with(b, 'hypo') OR starts_with(a, 'hypo') AND starts_with(b, 'hyper') OR starts_with(a, 'anti') AND starts_with(b, 'pro') OR starts_with(a, 'pro') AND starts_with(b, 'anti')
 OR starts_with(a, 'intra') AND starts_with(b, 'extra') OR starts_with(a, 'extra') AND starts_with(b, 'intra') OR starts_with(a, 'endo') AND starts_with(b, 'exo') OR starts_with(a, 'exo') AND starts_with(b, 'endo') AS opposite, na <> nb AS negated, round(greatest(0, 1 - levenshtein(a, b) / greatest(length(a), length(b), 1)), 6) AS similarity FROM p""", session=True)
def meaning_guards(spark, sf_dir):
    a, b = c("a"), c("b")
    return _PAIRS.frame(spark, sf_dir).select("id", T.opposite(a, b).alias("opposite"), T.negation_differs(F.split(a, " "), F.split(b, " ")).alias("negated"), F.round(T.similarity_of(F.levenshtein(a, b), a, b), 6).alias("similarity"))


_SETTINGS = Beside(Rows("id long, text string", [(1, "0.5"), (2, "nope"), (3, None), (4, "99"), (5, "-3"), (6, "NaN"), (7, "Infinity"), (8, "")]), "customer", "c_custkey + 10", ("CASE WHEN c_custkey % 2 = 0 THEN cast(c_nationkey as string) ELSE c_name END", "CASE WHEN c_custkey % 2 = 0 THEN c_nationkey::VARCHAR ELSE c_name END"))


@query(f"SELECT id, CASE WHEN try_cast(text AS DOUBLE) IS NULL OR isnan(try_cast(text AS DOUBLE)) OR isinf(try_cast(text AS DOUBLE)) THEN 0.25 ELSE least(greatest(try_cast(text AS DOUBLE), 0.0), 10.0) END AS setting FROM {_SETTINGS.sql}", session=True)
def number_settings(spark, sf_dir):
    return _SETTINGS.frame(spark, sf_dir).select("id", G.number_setting(c("text"), 0.0, 10.0, 0.25).alias("setting"))


_SAID = Rows("id long, body string", [(-1, '{"type": "end"}'), (-2, " hello "), (-3, '{"text": "json", "role": "user", "type": "say"}'), (-4, "{broken"), (-5, '"quoted"'), (-6, "12"), (-7, "[1]"), (-8, "null"), (-9, " "), (-10, None), (-11, '{"text": ""}'), (-12, '{"text": 0}'),
                                        (-13, '{"text": 12, "interrupted": true}'), (-14, '{"text": "cut", "interrupted": "true"}'), (-15, '{"text": "cut", "role": "nobody", "interrupted": true}'), (-16, '{"text": false}'), (-17, '{"type": "end", "text": "x", "role": "user"}'), (-18, '{"role": "user"}'), (-19, '{"text": null}')])


@query(f"""WITH b AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn % 2 = 1 THEN to_json({{'role': role, 'text': text, 'interrupted': turn % 3 = 0}})::VARCHAR ELSE text END AS body FROM conversations UNION ALL SELECT * FROM {_SAID.sql}),
r AS (SELECT id, {trim_sql('body')} AS raw FROM b), m AS (SELECT *, CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN raw::JSON END AS j FROM r WHERE raw <> ''),
f AS (SELECT *, coalesce(j->>'type' = 'end' AND json_type(j->'type') = 'VARCHAR', FALSE) AS control, coalesce(j->>'text', '') <> '' AND NOT (json_type(j->'text') = 'BOOLEAN' AND j->>'text' = 'false') AND NOT (json_type(j->'text') NOT IN ('VARCHAR', 'BOOLEAN') AND coalesce(try_cast(j->>'text' AS DOUBLE), 1) = 0) AS told FROM m)
SELECT id, control, CASE WHEN told AND NOT control AND j->>'role' = 'user' THEN 'user' ELSE 'assistant' END AS who, CASE WHEN told AND NOT control THEN j->>'text' ELSE raw END AS text, coalesce(told AND NOT control AND json_type(j->'interrupted') = 'BOOLEAN' AND j->>'interrupted' = 'true', FALSE) AS interrupted FROM f""", session=True)
def typed_messages(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").select((c("conv_id") * 1000 + c("turn")).alias("id"), F.when(c("turn") % 2 == 1, F.to_json(F.struct("role", "text", (c("turn") % 3 == 0).alias("interrupted")))).otherwise(c("text")).alias("body"))
    m = d.unionByName(_SAID.frame(spark)).select("id", events.message(c("body"), "end").alias("m")).where("m is not null")
    return m.select("id", "m.control", "m.who", "m.text", "m.interrupted")


@query("""WITH RECURSIVE h AS (SELECT l_orderkey AS k, round(l_discount * 10) / 10 + 0.5 AS confidence, l_partkey % 60 AS s, l_partkey % 60 + 3 + l_suppkey % 12 AS e, l_linenumber AS ord FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY confidence DESC, ord, s, e) AS n FROM h),
f AS (SELECT k, n, [{'s': s, 'e': e, 'c': confidence}] AS kept FROM n WHERE n = 1 UNION ALL SELECT n.k, n.n, CASE WHEN len(list_filter(f.kept, lambda x: n.s < x.e AND n.e > x.s)) > 0 THEN f.kept ELSE list_append(f.kept, {'s': n.s, 'e': n.e, 'c': n.confidence}) END FROM f JOIN n ON n.k = f.k AND n.n = f.n + 1),
l AS (SELECT k, arg_max(kept, n) AS kept FROM f GROUP BY k), u AS (SELECT k, unnest(kept) AS x FROM l) SELECT k, x.c AS confidence, x.s AS start_at, x.e AS end_at FROM u""")
def surest_hits(t):
    d = t("lineitem").select(c("l_orderkey").alias("k"), (F.round(c("l_discount") * 10) / 10 + 0.5).alias("confidence"), (c("l_partkey") % 60).alias("start"), (c("l_partkey") % 60 + 3 + c("l_suppkey") % 12).alias("end"), c("l_linenumber").alias("ord"))
    return places.without_overlaps(d, ["k"], ["ord"]).select("k", "confidence", c("start").alias("start_at"), c("end").alias("end_at"))


@query("SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS models, min(text) FILTER (turn = least_turn) AS first FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS least_turn FROM conversations) GROUP BY conv_id")
def first_and_all(t):
    d = t("conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("own"), F.collect_list("role").alias("others"), F.min_by("text", "turn").alias("first"))
    return d.select("conv_id", F.array_join(F.sort_array(F.array_distinct(F.concat(F.array("own"), "others"))), ",").alias("models"), "first")


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", session=True)
def landed_snapshots(spark, sf_dir):
    """Two JSON documents as they land, read as tables and joined."""
    out = {}
    for name, schema in (("nation", "n_nationkey int, n_name string, n_regionkey int"), ("region", "r_regionkey int, r_name string")):
        path = new_path(spark, name)
        table(spark, sf_dir, name).agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(path)
        out[name] = tables.snapshot(spark, path, schema)
    return out["nation"].join(out["region"], c("n_regionkey") == c("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query("SELECT s_suppkey, s_name FROM supplier", session=True)
def moved_history(spark, sf_dir):
    """Rows moved to a table once, however often the move is asked for."""
    s, path = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), new_path(spark, "history")
    versions.commit(s.where("s_suppkey % 3 = 0"), path)
    for _ in range(2):
        out = tables.migrated(s, path, "s_suppkey")
    return out


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id", session=True)
def autosaves(spark, sf_dir):
    """The last state of each key of a stream, saved as it comes and read again."""
    source, path = new_path(spark, "states"), new_path(spark, "saved")
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    e.write.parquet(source)
    tables.autosaved(spark.readStream.schema(e.schema).parquet(source), path, f"{path}-log", "user_id", "event_id").awaitTermination()
    return versions.current(spark, path).groupBy("user_id").agg(F.max("event_id").alias("event_id"))


@query("SELECT l_orderkey, count(*) AS n, sum(l_quantity)::BIGINT AS total FROM lineitem GROUP BY l_orderkey", session=True)
def saved_extractions(spark, sf_dir):
    """Nested rows appended with their metadata, and read again."""
    path = new_path(spark, "extractions")
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag")).alias("items"))
    tables.append(d, path, {"kind": F.lit("extraction")})
    add = F.aggregate("items", F.lit(0.0), lambda s, i: s + i["l_quantity"])
    return tables.where_equal(spark.read.parquet(path), {"kind": "extraction"}).select("l_orderkey", F.size("items").cast("long").alias("n"), add.cast("long").alias("total"))


@query("SELECT event_id, upper(replace(coalesce(nullif(CASE WHEN event_id % 4 > 0 THEN replace(event_type, '_', '-') END, ''), 'brand post'), '-', ' ')) AS label FROM events")
def campaign_labels(t):
    return t("events").select("event_id", T.campaign_label(F.when(c("event_id") % 4 > 0, F.replace("event_type", F.lit("_"), F.lit("-")))).alias("label"))
