"""Queries of nested values, trees, lookups, orders, sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parchment.functions import text as T
from parchment.operators import nested as N
from parchment.operators import places, search, trees
from parchment.operators import relational as R
from parchment.plans.inline import Beside, Rows
from parchment.plans.reference import query
from parchment.sources import tables, versions
from parchment.sources.scratch import new_path
from parchment.streaming import events

c = F.col
MODES = ("A", "N", "R")

# Line items as nouns of an extraction: the card by supplier, the mode by return flag.
_CARDS = "CASE l_suppkey % 6 WHEN 0 THEN 'objects' WHEN 1 THEN 'entities' WHEN 2 THEN 'traces' WHEN 3 THEN 'phenomena' WHEN 4 THEN 'concept' ELSE 'unknown' END"
_NOUNS = f"SELECT l_orderkey AS k, ((l_linenumber * 100000)::BIGINT + l_partkey) * 100000 + l_suppkey AS ord, l_partkey::INT AS num, 'n' || l_partkey AS noun, {_CARDS} AS card, CASE WHEN l_partkey % 9 = 0 THEN 'other' ELSE l_returnflag END AS mode, CASE WHEN l_linenumber % 2 = 0 THEN 'because' END AS reason, CASE WHEN l_tax > 0.04 THEN 'done' END AS status FROM lineitem"


def nouns(t):
    card = F.element_at(F.array(*map(F.lit, ("objects", "entities", "traces", "phenomena", "concept", "unknown"))), (c("l_suppkey") % 6 + 1).cast("int"))
    return t("lineitem").select(c("l_orderkey").alias("k"), ((c("l_linenumber").cast("long") * 100_000 + c("l_partkey")) * 100_000 + c("l_suppkey")).alias("ord"), c("l_partkey").cast("int").alias("num"), F.concat(F.lit("n"), c("l_partkey").cast("string")).alias("noun"), card.alias("card"),
                                F.when(c("l_partkey") % 9 == 0, "other").otherwise(c("l_returnflag")).alias("mode"), F.when(c("l_linenumber") % 2 == 0, "because").alias("reason"), F.when(c("l_tax") > 0.04, "done").alias("status"))


@query(f"""WITH n AS ({_NOUNS}), d AS (SELECT *, CASE WHEN card = 'objects' THEN 'entities' ELSE card END AS c2 FROM n), e AS (SELECT * FROM d WHERE c2 IN ('entities', 'traces', 'phenomena', 'concept', 'models') AND mode IN ('A', 'N', 'R'))
SELECT k, c2 AS card, mode, row_number() OVER (PARTITION BY k, c2, mode ORDER BY ord, num, noun) - 1 AS at, num, noun, coalesce(reason, '') AS reason, coalesce(status, 'pending') AS status,
 row_number() OVER (PARTITION BY k ORDER BY list_position(['entities', 'traces', 'phenomena', 'concept', 'models'], c2), list_position(['A', 'N', 'R'], mode), ord, num, noun) AS place FROM e""")
def extraction_rows(t):
    return N.deflated(N.inflated(nouns(t), ["k"], MODES), ["k"], MODES).select("k", "card", "mode", c("at"), "num", "noun", "reason", "status", "place")


_TAGS = Beside(Rows("id long, tags map<string,array<string>>", [(1, {"verb": ["go", "run"], "noun": ["cat"]}), (2, {"noun": [], "verb": ["x", "y", "z"], "other": ["o"]}), (3, {})]), "part", "p_partkey + 10", ("map('verb', array(p_type, p_brand), 'noun', split(p_name, ' '))", "MAP {'verb': [p_type, p_brand], 'noun': string_split(p_name, ' ')}"))


@query(f"""WITH m AS (SELECT id, unnest(map_entries(tags)) AS e FROM {_TAGS.sql}), r AS (SELECT id, e.key AS unit, e.value AS texts FROM m), x AS (SELECT id, unit, unnest(texts) AS text, generate_subscripts(texts, 1) AS pos FROM r)
SELECT id, unit || '-' || (row_number() OVER (PARTITION BY id ORDER BY unit, pos) - 1) AS tag, unit, text FROM x""", session=True)
def unit_tags(spark, sf_dir):
    return N.tag_rows(_TAGS.frame(spark, sf_dir).withColumnRenamed("id", "doc"), ["doc"], "tags").select(c("doc").alias("id"), c("id").alias("tag"), "unit", "text")


@query("""WITH n AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS row FROM events WHERE event_type IN ('click', 'purchase'))
SELECT user_id, row, max(event_id) FILTER (event_type = 'click')::VARCHAR AS click, max(event_id) FILTER (event_type = 'purchase')::VARCHAR AS purchase, (SELECT count(*) FROM n m WHERE m.user_id = n.user_id AND event_type = 'click') AS n_click, (SELECT count(*) FROM n m WHERE m.user_id = n.user_id AND event_type = 'purchase') AS n_purchase FROM n GROUP BY user_id, row""")
def ragged_units(t):
    e = t("events").select("user_id", "event_type", "ts", "event_id", c("event_id").cast("string").alias("text"))
    return N.ragged(e, ["user_id"], "event_type", "text", ["click", "purchase"], [c("ts"), c("event_id")])


@query("WITH n AS (SELECT n_regionkey AS k, list(n_name ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey) SELECT k, array_to_string(CASE WHEN list_contains(names, 'CHINA') THEN list_filter(names, lambda x: x <> 'CHINA') ELSE list_append(names, 'CHINA') END, ',') AS toggled, array_to_string([names[2], names[1]] || names[3:], ',') AS up, array_to_string(names, ',') AS same FROM n")
def toggled_and_moved(t):
    n = t("nation").groupBy(c("n_regionkey").alias("k")).agg(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("names"))
    as_items = F.transform("names", lambda x: F.struct(x.alias("url")))
    show = lambda a: F.array_join(F.transform(a, lambda x: x["url"]), ",")
    return n.select("k", F.array_join(N.toggled(c("names"), F.lit("CHINA")), ",").alias("toggled"), show(N.moved(as_items, "url", F.get("names", F.lit(1)), True)).alias("up"), show(N.moved(as_items, "url", F.get("names", F.lit(0)), True)).alias("same"))


@query("""WITH s AS (SELECT l_orderkey AS k, l_suppkey % 3 AS src, l_linenumber % 2 AS span, list(l_linenumber ORDER BY l_linenumber) AS done FROM lineitem GROUP BY ALL), u AS (SELECT k, src, span, CASE WHEN src = 1 AND span = 0 THEN CASE WHEN list_contains(done, 2) THEN list_filter(done, lambda p: p <> 2) ELSE list_append(done, 2) END ELSE done END AS done FROM s)
SELECT k, sum(len(list_filter(done, lambda p: p BETWEEN 2 AND 5)))::BIGINT AS done, (count(*) * 4)::BIGINT AS total FROM u GROUP BY k""")
def plan_progress(t):
    spans = t("lineitem").groupBy(c("l_orderkey").alias("k"), (c("l_suppkey") % 3).alias("src"), (c("l_linenumber") % 2).alias("span")).agg(F.sort_array(F.collect_list("l_linenumber")).alias("done"))
    sources = spans.groupBy("k", "src").agg(F.sort_array(F.collect_list(F.struct(c("span").alias("id"), F.lit(2).alias("from_page"), F.lit(5).alias("to_page"), c("done").alias("completed")))).alias("spans"))
    exams = sources.groupBy("k").agg(F.sort_array(F.collect_list(F.struct(c("src").alias("id"), "spans"))).alias("sources"))
    now = exams.select("k", N.page_toggled(c("sources"), F.lit(1), F.lit(0), F.lit(2)).alias("s"))
    progress = now.select("k", F.explode(F.flatten(F.transform("s", lambda s: s["spans"]))).alias("span")).select("k", N.span_progress(c("span")).alias("p"))
    return progress.groupBy("k").agg(F.sum("p.done").alias("done"), F.sum("p.total").alias("total"))


@query("WITH m AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) SELECT conv_id, string_agg(CASE WHEN back = 1 THEN text || ' +' ELSE text END, '|' ORDER BY turn) AS appended, string_agg(CASE WHEN back = 1 THEN 'Error: x' ELSE text END, '|' ORDER BY turn) AS replaced FROM m GROUP BY conv_id")
def last_messages(t):
    d = t("conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("m"))
    show = lambda m: F.array_join(F.transform(m, lambda x: x["content"]), "|")
    return d.select("conv_id", show(N.last_changed(c("m"), lambda x: F.concat(x, F.lit(" +")))).alias("appended"), show(N.last_changed(c("m"), lambda x: F.lit("Error: x"))).alias("replaced"))


_POSTS = Beside(Rows("id long, asset string, media_url string, listed array<string>, written string", [(1, "a", "b", ["c"], "d"), (2, "", "b", ["c"], "d"), (3, None, "", ["c", "x"], "d"), (4, None, None, [], " d \ne"), (5, None, None, [""], "  \n"), (6, "", "", [], None)]), "pages", "page_id + 10", "CASE WHEN page_id % 4 = 0 THEN url END", "CASE WHEN page_id % 4 = 1 THEN url END", ("array(CASE WHEN page_id % 4 = 2 THEN url END)", "[CASE WHEN page_id % 4 = 2 THEN url END]"), "concat(' ', chr(10), url, ' ')")


@query(f"SELECT id, coalesce(nullif(asset, ''), nullif(media_url, ''), nullif(listed[1], ''), list_filter(list_transform(string_split(coalesce(written, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '') AS media FROM {_POSTS.sql}", session=True)
def preview_media(spark, sf_dir):
    assets = F.when(c("asset").isNotNull(), F.array(F.struct(c("asset").alias("url")))).otherwise(F.array().cast("array<struct<url:string>>"))
    post = F.struct(assets.alias("assets"), "media_url", c("listed").alias("media_urls"), c("written").alias("media_text"))
    return _POSTS.frame(spark, sf_dir).select("id", post.alias("p")).select("id", N.preview_media(c("p")).alias("media"))


_ATTRIBUTES = Beside(Rows("id long, names array<string>, vals array<string>", [(1, ["a", "b", "c"], ["1.5", "", None]), (2, ["pitch", "rate"], ["-2", "x"]), (3, ["rate", "a"], ["0", " 3 "])]), "events", "event_id + 10", ("array('a', 'pitch', event_type)", "['a', 'pitch', event_type]"), ("array(cast(user_id as string), cast(user_id - 10 as string), props)", "[user_id::VARCHAR, (user_id - 10)::VARCHAR, props]"))


@query(f"""WITH a AS (SELECT *, list_transform(range(len(names)), lambda i: {{'n': names[i + 1], 'v': vals[i + 1]}}) AS p FROM {_ATTRIBUTES.sql})
SELECT id, array_to_string(list_transform(list_filter(p, lambda x: coalesce(x.v, '') <> ''), lambda x: x.n), ',') AS filled, array_to_string(list_transform(list_filter(['a', 'pitch', 'rate'], lambda n: try_cast(list_filter(p, lambda x: x.n = n)[1].v AS DOUBLE) IS NOT NULL), lambda n: n || CASE WHEN list_filter(p, lambda x: x.n = n)[1].v::DOUBLE >= 0 THEN '+' ELSE '-' END), ',') AS numbers FROM a""", session=True)
def attribute_pairs(spark, sf_dir):
    d = _ATTRIBUTES.frame(spark, sf_dir)
    pairs = F.zip_with("names", "vals", lambda n, v: F.struct(n.alias("name"), v.alias("value")))
    numbers = N.number_deltas(F.map_from_arrays("names", "vals"), ["a", "pitch", "rate"])
    return d.select("id", F.array_join(F.transform(N.filled(pairs), lambda p: p["name"]), ",").alias("filled"), F.array_join(F.transform(numbers, lambda n: F.concat(n["name"], F.when(n["rises"], "+").otherwise("-"))), ",").alias("numbers"))


_QUIZ = Beside(Rows("id long, options array<string>, answer string, reasons map<string,string>", [(1, ["a", "b", "c"], "b", {"a": " too small ", "c": "  "}), (2, ["x"], "x", {}), (3, ["x", "y"], "z", {"y": "no"})]), "part", "p_partkey + 10", ("array(p_brand, p_type, p_name)", "[p_brand, p_type, p_name]"), "p_type", ("map(p_brand, concat(' ', p_name, ' '), p_name, ' ')", "MAP {p_brand: concat(' ', p_name, ' '), p_name: ' '}"))


@query(f"SELECT id, array_to_string(list_transform(list_filter(options, lambda o: o <> answer), lambda o: o || ': ' || coalesce(nullif(trim(coalesce(reasons[o], '')), ''), 'Reason not provided.')), '; ') AS wrong FROM {_QUIZ.sql}", session=True)
def wrong_options(spark, sf_dir):
    out = N.wrong_options(c("options"), c("answer"), c("reasons"))
    return _QUIZ.frame(spark, sf_dir).select("id", F.array_join(F.transform(out, lambda o: F.concat(o["option"], F.lit(": "), o["reason"])), "; ").alias("wrong"))


_BODIES = Beside(Rows("id long, body string", [(1, '{"error": "bad", "details": ["x", "y"]}'), (2, '{"error": {"message": "deep"}}'), (3, '{"ok": 1}'), (4, "plain text"), (5, ""), (6, None), (7, '{"moveX": 1, "moveY": 2.5, "zoom": -3}'), (8, '{"moveX": "1", "moveY": 2, "zoom": 3}'), (9, '{"moveX": null, "moveY": 2, "zoom": 3}'), (10, '{"error": "", "details": []}')]), "events", "event_id + 100", "CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN event_type WHEN 2 THEN concat('{\"error\": \"', event_type, '\", \"details\": [\"', user_id, '\"]}') ELSE concat('{\"moveX\": ', user_id, ', \"moveY\": 2, \"zoom\": 1}') END")


@query(f"""WITH b AS (SELECT id, body, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM {_BODIES.sql})
SELECT id, CASE WHEN coalesce(body, '') = '' THEN NULL WHEN j IS NULL THEN body WHEN json_type(j->'error') = 'VARCHAR' THEN j->>'error' WHEN (j->'error') IS NULL THEN NULL ELSE (j->'error')::VARCHAR END AS error,
 coalesce(CASE WHEN json_type(j->'error') = 'VARCHAR' THEN j->>'error' END, nullif(j->'error'->>'message', ''), 'failed') || CASE WHEN json_array_length(j->'details') > 0 THEN ' ' || array_to_string(json_extract_string(j, '$.details[*]'), '; ') ELSE '' END AS shown,
 CASE WHEN json_type(j->'moveX') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND json_type(j->'moveY') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND json_type(j->'zoom') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN (j->>'moveX')::DOUBLE + (j->>'moveY')::DOUBLE + (j->>'zoom')::DOUBLE END AS moved FROM b""", session=True)
def answer_bodies(spark, sf_dir):
    moved = N.numbers_of(c("body"), ["moveX", "moveY", "zoom"])
    return _BODIES.frame(spark, sf_dir).select("id", N.payload(c("body"), "error string")["error"].alias("error"), N.error_text(c("body"), "failed").alias("shown"), (moved["moveX"] + moved["moveY"] + moved["zoom"]).alias("moved"))


_ENTITIES = Beside(Rows("id long, type string, type_label string, name string, domain string, parent_schema string, trace_name string, value string, unit string, source_text string", [
    (1, "schema", "Schema", "Heart", "Body", None, None, None, None, "src"), (2, "schema", "Schema", "", "", None, None, None, None, ""), (3, "trace", "Trace", None, None, None, None, None, None, "t"), (4, "trace_value", "Value", None, None, None, "pulse", "", "bpm", "from text"),
    (5, "instance", "Instance", "i", None, "Heart", "pulse", "70", None, None), (6, "intervener", "Intervener", None, None, None, None, None, "", "changed"), (7, "other", None, None, None, None, None, None, None, None)]), "events", "event_id + 10", ("element_at(array('schema', 'trace', 'trace_value', 'instance', 'intervener', 'x'), cast(user_id % 6 + 1 as int))", "(['schema', 'trace', 'trace_value', 'instance', 'intervener', 'x'])[user_id % 6 + 1]"), "event_type", "CASE WHEN event_id % 3 = 0 THEN event_type END", "'Body'", "props", "event_type", "CASE WHEN event_id % 2 = 0 THEN props END", "nullif(event_type, 'click')", "props")
_OR = lambda f, d: f"coalesce(nullif({f}, ''), {d})"


@query(f"""SELECT id, 'AMCTOSHS Sub-Entity:' || chr(10) || '1. Entity Type: ' || coalesce(type_label, '') || CASE type
 WHEN 'schema' THEN chr(10) || '2. Entity Schema: ' || {_OR('name', "'Untitled Schema'")} || chr(10) || '3. AMCTOSHS Sub-Entity schema Domain: ' || coalesce(domain, '') || chr(10) || '4. Ontic Object Text: ' || coalesce(source_text, '')
 WHEN 'trace' THEN chr(10) || '2. Entity Schema Trace: ' || {_OR('name', "'Untitled Trace'")} || chr(10) || '3. Nested Inside Entity Schema: ' || {_OR('parent_schema', "'Not specified'")} || chr(10) || '4. Trace Source Text: ' || coalesce(source_text, '')
 WHEN 'trace_value' THEN chr(10) || '2. Entity Schema Trace: ' || {_OR('trace_name', "'Not specified'")} || chr(10) || '3. Entity Schema Trace Value: ' || {_OR('value', "coalesce(source_text, '')")} || chr(10) || '4. Unit: ' || coalesce(unit, '')
 WHEN 'instance' THEN chr(10) || '2. Entity Schema Instance: ' || {_OR('name', "'Untitled Instance'")} || chr(10) || '3. Entity Schema Name: ' || {_OR('parent_schema', "'Not specified'")} || chr(10) || '4. Entity Schema Trace Name: ' || {_OR('trace_name', "'Not specified'")} || chr(10) || '5. Entity Schema Trace Value Entry: ' || {_OR('value', "'Not specified'")}
 WHEN 'intervener' THEN chr(10) || '2. Entity Intervener: ' || {_OR('name', "'Untitled Intervener'")} || chr(10) || '3. Target Entity Schema Trace Value: ' || {_OR('trace_name', "'Not specified'")} || chr(10) || '4. Change: ' || {_OR('value', "coalesce(source_text, '')")} || chr(10) || '5. Unit: ' || {_OR('unit', "'Not specified'")}
 ELSE '' END AS text FROM {_ENTITIES.sql}""", session=True)
def entity_texts(spark, sf_dir):
    return _ENTITIES.frame(spark, sf_dir).select("id", N.entity_text(c("type"), c("type_label"), c).alias("text"))


@query("SELECT l_orderkey, 'Body map saved' || CASE WHEN l_orderkey % 2 = 0 THEN ' for pain ' || l_orderkey || '.' ELSE '.' END || ' Marked regions: ' || string_agg(n || '. ' || l_returnflag || ' (' || l_linestatus || ', intensity ' || l_linenumber || '/10)', ' ' ORDER BY n) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus) AS n FROM lineitem) GROUP BY l_orderkey")
def body_summaries(t):
    mark = F.struct(c("l_linenumber").alias("intensity"), c("l_returnflag").alias("region"), c("l_linestatus").alias("distribution"))
    d = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(mark)).alias("m"))
    symptom = F.when(c("l_orderkey") % 2 == 0, F.concat(F.lit("pain "), c("l_orderkey").cast("string")))
    return d.select("l_orderkey", N.body_summary(symptom, c("m")).alias("summary"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS kinds, bool_and(event_type <> 'purchase') AS never_bought, bool_or(value > 100) AS some_large, count(*) FILTER (event_type = 'click') AS n_clicks FROM events GROUP BY user_id")
def user_facts(t):
    kinds = F.array_join(F.array_distinct(F.filter(F.sort_array(F.collect_list("event_type")), lambda x: x != "")), ", ")
    return t("events").groupBy("user_id").agg(kinds.alias("kinds"), F.every(c("event_type") != "purchase").alias("never_bought"), F.some(c("value") > 100).alias("some_large"), F.count_if(c("event_type") == "click").alias("n_clicks"))


_ELEMENTS = Beside(Rows("id string, parent_id string, child_ids array<string>, ord long", [
    ("a", None, ["b", "c", "nowhere"], 1), ("b", "a", ["d"], 2), ("c", "a", [], 3), ("d", "b", ["a", "e"], 4), ("e", "d", None, 5), ("f", None, ["f", "g"], 6), ("g", "f", [], 7), ("c", "a", ["e"], 8)]), "part", ("cast(p_partkey as string)", "p_partkey::VARCHAR"), ("CASE WHEN p_partkey > 0 THEN cast((p_partkey - 1) div 3 as string) END", "CASE WHEN p_partkey > 0 THEN ((p_partkey - 1) // 3)::VARCHAR END"), ("array(cast(3 * p_partkey + 1 as string), cast(3 * p_partkey + 2 as string), cast(3 * p_partkey + 3 as string))", "[(3 * p_partkey + 1)::VARCHAR, (3 * p_partkey + 2)::VARCHAR, (3 * p_partkey + 3)::VARCHAR]"), "p_partkey")


@query(f"""WITH RECURSIVE e AS (SELECT id, parent_id, child_ids FROM {_ELEMENTS.sql} QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1), l AS (SELECT id AS up, unnest(child_ids) AS id, generate_subscripts(child_ids, 1) - 1 AS at FROM e),
w AS (SELECT id AS root, id, [id] AS path, []::BIGINT[] AS place FROM e WHERE parent_id IS NULL UNION ALL SELECT w.root, l.id, list_append(w.path, l.id), list_append(w.place, l.at) FROM w JOIN l ON l.up = w.id JOIN e ON e.id = l.id WHERE NOT list_contains(w.path, l.id))
SELECT root, id, array_to_string(path, '/') AS path, array_to_string(place, '.') AS place, len(path) - 1 AS depth FROM w""", session=True)
def element_forest(spark, sf_dir):
    return trees.forest(_ELEMENTS.frame(spark, sf_dir)).select("root", "id", F.array_join("path", "/").alias("path"), F.array_join(F.transform("place", lambda x: x.cast("string")), ".").alias("place"), "depth")


_TERMS = "SELECT 'r' || r_regionkey AS id, r_name AS label, []::VARCHAR[] AS synonyms, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, [lower(n_name) || ' land'], 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, s_name, [s_suppkey::VARCHAR], CASE WHEN s_suppkey % 10 = 0 THEN 'gone' ELSE 'n' || s_nationkey END FROM supplier"


@query(f"""WITH RECURSIVE t AS ({_TERMS}), h AS (SELECT id FROM t WHERE contains(lower(label || ' ' || array_to_string(synonyms, ' ')), 'ia land') OR contains(lower(label), '7')), u AS (SELECT id, TRUE AS matched FROM h UNION ALL SELECT t.parent, FALSE FROM u JOIN t ON t.id = u.id JOIN t p ON p.id = t.parent)
SELECT id, bool_or(matched) AS matched FROM u GROUP BY id""")
def visible_terms(t):
    label = lambda p, k: F.concat(F.lit(p), c(k).cast("string"))
    r = t("region").select(label("r", "r_regionkey").alias("id"), c("r_name").alias("label"), F.array().cast("array<string>").alias("synonyms"), F.lit(None).cast("string").alias("parent"))
    n = t("nation").select(label("n", "n_nationkey").alias("id"), c("n_name").alias("label"), F.array(F.concat(F.lower("n_name"), F.lit(" land"))).alias("synonyms"), label("r", "n_regionkey").alias("parent"))
    s = t("supplier").select(label("s", "s_suppkey").alias("id"), c("s_name").alias("label"), F.array(c("s_suppkey").cast("string")).alias("synonyms"), F.when(c("s_suppkey") % 10 == 0, "gone").otherwise(label("n", "s_nationkey")).alias("parent"))
    terms = r.unionByName(n).unionByName(s)
    seen = trees.visible_terms(terms, " IA land ").unionByName(trees.visible_terms(terms.withColumn("synonyms", F.array().cast("array<string>")), "7"))
    return seen.groupBy("id").agg(F.max("matched").alias("matched"))


_VOICES = Rows("ord long, uri string, lang string, local boolean", [(1, "u1", "fr-FR", True), (2, "u2", "en-GB", False), (3, "u3", "en-US", False), (4, "u4", "en-AU", True), (5, "u5", "en-US", True), (6, "u6", "de-DE", False)])
_WISHES = Beside(Rows("wish long, uri string, lang string", [(1, "u2", "de-DE"), (2, "gone", "en-US"), (3, None, "en-NZ"), (4, None, "de-AT"), (5, None, "ja-JP"), (6, None, None), (7, None, "")]), "customer", "c_custkey + 10", "CASE WHEN c_custkey % 3 = 0 THEN concat('u', c_custkey % 8) END", "CASE c_custkey % 5 WHEN 0 THEN 'en-US' WHEN 1 THEN 'fr-CA' WHEN 2 THEN 'de-DE' WHEN 3 THEN '' ELSE 'ja' END")


@query(f"""WITH v AS (SELECT * FROM {_VOICES.sql}), w AS (SELECT wish, uri, coalesce(nullif(lang, ''), 'en-US') AS lang FROM {_WISHES.sql})
SELECT wish, (SELECT v.uri FROM v ORDER BY CASE WHEN v.uri = w.uri THEN 0 WHEN v.lang = w.lang AND local THEN 1 WHEN starts_with(v.lang, split_part(w.lang, '-', 1)) AND local THEN 2 WHEN starts_with(v.lang, split_part(w.lang, '-', 1)) THEN 3 ELSE 4 END, ord LIMIT 1) AS voice FROM w""", session=True)
def picked_voices(spark, sf_dir):
    return R.picked_voice(_VOICES.frame(spark), _WISHES.frame(spark, sf_dir))


_SHAPES = Beside(Rows("standard string, alias string, at int", [("jawOpen", "jawOpen", 0), ("jawOpen", "mouthOpen", 1), ("blink", "blink", 0), ("blink", "eyeBlink", 1), ("smile", "smile", 0), ("gone", "gone", 0)]), "part", "p_type", "lower(p_brand)", "p_partkey")
_REAL = Beside(Rows("name string, ord long", [("MOUTHOPEN", 1), ("JawOpen", 2), ("jawopen", 3), ("EyeBlink", 4), ("other", 5)]), "part", "upper(p_brand)", "p_partkey + 10")


@query(f"WITH r AS (SELECT lower(name) AS k, arg_max(name, ord) AS name FROM {_REAL.sql} GROUP BY 1) SELECT standard, arg_min(r.name, s.\"at\") AS name FROM {_SHAPES.sql} s JOIN r ON r.k = lower(alias) GROUP BY standard", session=True)
def first_aliases(spark, sf_dir):
    return R.first_alias(_REAL.frame(spark, sf_dir), _SHAPES.frame(spark, sf_dir))


@query("WITH a AS (SELECT o_custkey % 50 AS noun, o_orderstatus AS mode, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS means FROM orders GROUP BY ALL) SELECT c_custkey, a.means FROM customer LEFT JOIN a ON a.noun = c_custkey % 50 AND a.mode = CASE WHEN c_nationkey % 2 = 0 THEN 'O' ELSE 'F' END")
def composite_lookup(t):
    pool = t("customer").select("c_custkey", (c("c_custkey") % 50).alias("noun"), F.when(c("c_nationkey") % 2 == 0, "O").otherwise("F").alias("mode"))
    given = t("orders").select((c("o_custkey") % 50).alias("noun"), c("o_orderstatus").alias("mode"), c("o_orderpriority").alias("means"), "o_orderdate", "o_orderkey")
    return R.lookup(pool, given, ["noun", "mode"], "means", ["o_orderdate", "o_orderkey"]).select("c_custkey", "means")


@query("""WITH s AS (SELECT conv_id AS k, turn AS i, (length(text) * 7 % 300) AS start FROM conversations), q AS (SELECT conv_id AS k, turn AS id, turn * 29 % 310 AS at FROM conversations) SELECT k, id, (SELECT max(i) FROM s WHERE s.k = q.k AND s.start <= q.at) AS active FROM q""")
def active_segments(t):
    d = t("conversations")
    s = d.select(c("conv_id").alias("k"), c("turn").alias("i"), (F.length("text") * 7 % 300).cast("long").alias("at"))
    q = d.select(c("conv_id").alias("k"), c("turn").alias("id"), (c("turn") * 29 % 310).alias("at"))
    return R.as_of(q, s, ["k"], "at", "i", "active", order="i").select("k", "id", "active")


@query("SELECT p_partkey, row_number() OVER (ORDER BY contains(lower(p_name), 'an') DESC, p_name, p_partkey) AS place FROM (SELECT p_partkey, lower(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS p_name FROM part) QUALIFY place <= 40")
def priority_sort(t):
    d = t("part").select("p_partkey", F.lower(F.regexp_replace("p_name", "[^A-Za-z]", "")).alias("p_name"))
    first = d.orderBy(*R.by_flag_and_name(d, R.any_hint(c("p_name"), ["an"]), "p_name", ["p_partkey"])).limit(40)
    w = Window.orderBy(*R.by_flag_and_name(first, R.any_hint(c("p_name"), ["an"]), "p_name", ["p_partkey"]))
    return first.withColumn("place", F.row_number().over(w)).select("p_partkey", "place")


_GROUPS = Beside(Rows("ord long, id string, title string", [(1, " 1 ", "Zed"), (2, "2", "école"), (3, "1", "Zed "), (4, None, None), (5, "", "eagle"), (6, "3", "Eagle"), (7, "4", "")]), "customer", "c_custkey + 10", ("cast(c_nationkey as string)", "c_nationkey::VARCHAR"), "concat(c_mktsegment, ' ')")


@query(f"SELECT DISTINCT trim(coalesce(id, '')) AS id, trim(coalesce(title, '')) AS title FROM {_GROUPS.sql} WHERE trim(coalesce(id, '')) <> '' OR trim(coalesce(title, '')) <> ''", session=True)
def group_titles(spark, sf_dir):
    return R.last_titles(_GROUPS.frame(spark, sf_dir), c("id"), c("title"), ["ord"])


@query("""WITH w AS (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS word FROM documents), n AS (SELECT word, count(*) AS n FROM w GROUP BY word) SELECT word, n FROM n WHERE starts_with(word, 'th') ORDER BY n DESC, word LIMIT 6""")
def suggestions(t):
    w = t("documents").select(F.explode(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return R.prefixed(w, "word", "n", "Th")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS due, o_orderdate + to_days((o_custkey % 9)::INT) AS updated, o_orderstatus FROM orders) WHERE due IS NOT NULL OR o_orderstatus IN ('P', 'F') ORDER BY coalesce(due, updated), o_orderkey LIMIT 4")
def weekly_queue(t):
    d = t("orders").select("o_orderkey", F.when(c("o_orderkey") % 3 == 0, c("o_orderdate")).alias("due"), (c("o_orderdate") + F.make_dt_interval((c("o_custkey") % 9).cast("int"))).alias("updated"), "o_orderstatus")
    return d.where("due is not null or o_orderstatus in ('P', 'F')").orderBy(F.coalesce("due", "updated"), "o_orderkey").limit(4).select("o_orderkey")


_KEYS = Beside(Rows("grp long, key string, value long", [(-1, "10", 1), (-1, "9", 2), (-1, "2", 3), (-1, "-1", 4), (-1, "100", 5)]), "conversations", "conv_id", ("cast(turn * 7 % 12 as string)", "(turn * 7 % 12)::VARCHAR"), "turn")


@query(f"SELECT grp, key, row_number() OVER w AS place, first_value(key) OVER w AS first FROM {_KEYS.sql} WINDOW w AS (PARTITION BY grp ORDER BY key::INT)", session=True)
def numeric_keys(spark, sf_dir):
    w = Window.partitionBy("grp").orderBy(c("key").cast("int"))
    return _KEYS.frame(spark, sf_dir).select("grp", "key", F.row_number().over(w).alias("place"), F.first("key").over(w).alias("first"))


@query("""WITH d AS (SELECT * FROM (VALUES ('AFRICA'), ('AMERICA'), ('EUROPE'), ('OCEANIA')) v(domain)), s AS (SELECT r_name AS domain, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name)
SELECT domain, coalesce(n, 0) AS n, TRUE AS known FROM d LEFT JOIN s USING (domain) UNION ALL SELECT domain, n, FALSE FROM s WHERE domain NOT IN (SELECT domain FROM d)""", session=True)
def domain_tabs(spark, sf_dir):
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    fixed = spark.createDataFrame([(x,) for x in ("AFRICA", "AMERICA", "EUROPE", "OCEANIA")], "domain string")
    found = t("region").join(t("nation"), c("n_regionkey") == c("r_regionkey")).groupBy(c("r_name").alias("domain")).agg(F.count("*").alias("n"))
    kept = fixed.join(found, "domain", "left").select("domain", F.coalesce("n", F.lit(0)).alias("n"), F.lit(True).alias("known"))
    return kept.unionAll(found.join(fixed, "domain", "left_anti").select("domain", "n", F.lit(False)))


@query("SELECT word, count(*) AS n, min(ord) AS first FROM (SELECT lower(split_part(p_name, ' ', 1)) AS word, p_partkey AS ord FROM part UNION ALL SELECT lower(n_name), 1000000 + n_nationkey FROM nation) GROUP BY word")
def joined_vocabulary(t):
    own = t("part").select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("word"), c("p_partkey").alias("ord"))
    both = own.unionAll(t("nation").select(F.lower("n_name"), (c("n_nationkey") + 1_000_000).cast("long")))
    return both.groupBy("word").agg(F.count("*").alias("n"), F.min("ord").alias("first"))


_MARKED = Beside(Rows("id long, text string", [(1, "before\n=== Page 3 ===\none\ntwo\n=== Page 10 ===\r\nthree"), (2, "no marks at all"), (3, ""), (4, "=== Page 1 ===\n=== Page 2 ===\nx"), (5, "a === Page 1 === b")]), "documents", "doc_id + 10", "concat('=== Page ', doc_id, ' ===', chr(10), text, chr(10), '=== Page 7 ===', chr(10), lang)")


@query(f"""WITH m AS (SELECT id, text, regexp_extract_all(text, '(?m)^=== Page (\\d+) ===\\r?\\n?', 1) AS numbers, regexp_extract_all(text, '(?m)^=== Page \\d+ ===\\r?\\n?') AS marks, regexp_split_to_array(text, '(?m)^=== Page \\d+ ===\\r?\\n?') AS parts FROM {_MARKED.sql}),
x AS (SELECT id, numbers, marks, parts, unnest(range(1, len(numbers) + 1)) AS i FROM m WHERE len(numbers) > 0)
SELECT id, numbers[i]::BIGINT AS page, parts[i + 1] AS text, (list_sum(list_transform(parts[1:i], lambda p: length(p))) + list_sum(list_transform(marks[1:i], lambda p: length(p))))::BIGINT AS start FROM x UNION ALL SELECT id, NULL, text, 0 FROM m WHERE len(numbers) = 0 AND text <> ''""", session=True)
def marked_pages(spark, sf_dir):
    return _MARKED.frame(spark, sf_dir).select("id", F.explode(places.marked_pages(c("text"))).alias("p")).select("id", "p.page", "p.text", "p.start")


@query("""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n{2,}')) AS p, generate_subscripts(regexp_split_to_array(text, '\\n{2,}'), 1) - 1 AS paragraph FROM documents), o AS (SELECT *, coalesce(sum(length(p) + 2) OVER (PARTITION BY doc_id ORDER BY paragraph ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM p),
l AS (SELECT doc_id, paragraph, pos, unnest(string_split(p, chr(10))) AS l, generate_subscripts(string_split(p, chr(10)), 1) - 1 AS line FROM o), b AS (SELECT doc_id, paragraph, line, length(l) AS n, pos + coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id, paragraph ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM l)
SELECT doc_id, paragraph, line, begins::BIGINT AS begins, (CASE WHEN 180 > begins AND 60 < begins + n THEN greatest(0, 60 - begins) END)::BIGINT AS mark_from, (CASE WHEN 180 > begins AND 60 < begins + n THEN least(n, 180 - begins) END)::BIGINT AS mark_to FROM b""")
def paragraph_places(t):
    return places.paragraph_lines(t("documents"), "doc_id", "text", 60, 180)


@query("""WITH l AS (SELECT conv_id AS k, turn, CASE WHEN turn % 4 = 3 THEN '  ' ELSE text END AS text, turn % 7 = 5 AS brk FROM conversations), s AS (SELECT *, trim(text) = '' OR brk AS stop FROM l), g AS (SELECT *, sum(stop::INT) OVER (PARTITION BY k ORDER BY turn) AS g FROM s)
SELECT k, row_number() OVER (PARTITION BY k ORDER BY g) AS paragraph, text FROM (SELECT k, g, string_agg(text, '<br />' ORDER BY turn) AS text FROM g WHERE NOT stop GROUP BY k, g)""")
def draft_paragraphs(t):
    d = t("conversations").select(c("conv_id").alias("k"), "turn", F.when(c("turn") % 4 == 3, "  ").otherwise(c("text")).alias("text"))
    return places.paragraphs_of_lines(d, ["k"], "turn", "text", c("turn") % 7 == 5)


@query("SELECT e.event_id, CASE WHEN e.event_id % 10 = 0 THEN 'fixed' ELSE e.event_type END AS event_type, e.value FROM (SELECT * FROM events UNION ALL SELECT event_id + 1000000, ts, user_id, 'added', value, props FROM events WHERE user_id = 1) e WHERE e.event_id % 15 <> 7", session=True)
def entity_log(spark, sf_dir):
    """A log that is appended to, then corrected and thinned by id."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = new_path(spark, "log")
    versions.commit(e, path)
    for _ in range(2):  # the second time is a try again
        versions.commit(e.where("user_id = 1").withColumns({"event_id": c("event_id") + 1_000_000, "event_type": F.lit("added")}), path, tag="added")
    log = versions.current(spark, path)
    changes = log.select("event_id", F.when(c("event_id") % 10 == 0, "fixed").alias("event_type"), (c("event_id") % 15 == 7).alias("gone")).where("event_type is not null or gone")
    versions.commit(tables.corrected(log, changes, "event_id", "gone"), path, replace=True)
    return versions.current(spark, path).select("event_id", "event_type", "value")


@query("""WITH d AS (SELECT user_id, max(event_id) AS page, max_by(event_type, event_id) AS body FROM events GROUP BY user_id), a AS (SELECT *, user_id % 6 AS way FROM d)
SELECT user_id, CASE WHEN way IN (2, 4) THEN 'saved' ELSE 'draft' END AS state, CASE WHEN way = 4 THEN body WHEN way = 5 THEN body || ' twice' ELSE body || ' again' END AS body FROM a WHERE way <> 3""", session=True)
def page_structures(spark, sf_dir):
    """Drafts of pages saved, drafted again, saved, discarded or deleted, each step a version of one table. Way 0 and 1 are drafts over what is saved, 2 is saved again, 3 deleted, 4 discarded, 5 drafted twice."""
    path, key, schema = new_path(spark, "structures"), ["user_id"], "user_id long, state string, body string"
    first = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("body"))
    again = first.withColumn("body", F.concat("body", F.lit(" again")))
    of = lambda way: first.where(c("user_id") % 6 == way)
    steps = [lambda t: versions.drafted(t, first, key), lambda t: versions.saved(t, first, key), lambda t: versions.drafted(t, again, key), lambda t: versions.saved(t, of(2), key), lambda t: versions.deleted(t, of(3), key),
             lambda t: versions.discarded(t, of(4), key), lambda t: versions.drafted(t, of(5).withColumn("body", F.concat("body", F.lit(" twice"))), key)]
    for n, step in enumerate(steps):
        for _ in range(1 + n % 2):  # some are tried again
            versions.changed(spark, path, step, schema, tag=str(n))
    return versions.shown(versions.current(spark, path), key).select("user_id", "state", "body")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AND p_brand = (SELECT min(p_brand) FROM part)", session=True)
def exported_rows(spark, sf_dir):
    """Selected ids to a JSON file and back."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    path = new_path(spark, "export")
    ids = t("lineitem").where("l_quantity > 49").select(c("l_partkey").alias("p_partkey"))
    brand = t("part").agg(F.min("p_brand")).first()[0]
    tables.export_json(tables.where_equal(t("part"), {"p_brand": brand, "p_type": ""}), ids, "p_partkey", path)
    return spark.read.schema("p_partkey long, p_name string").json(path)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = (SELECT min(o_orderpriority) FROM orders) ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def filtered_questions(t):
    first = t("orders").agg(F.min("o_orderpriority")).first()[0]
    return tables.where_equal(t("orders"), {"o_orderstatus": "F", "o_orderpriority": first, "o_custkey": None}, 200, [F.desc("o_orderdate"), c("o_orderkey")]).select("o_orderkey", "o_custkey")


@query("WITH p AS (SELECT doc_id, n_chars, text FROM documents WHERE doc_id BETWEEN 20 AND 140) SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'served ' || doc_id ELSE text END AS text FROM p")
def page_range_texts(t):
    pages = tables.page_range(t("documents"), "doc_id", 20, 140)
    served = pages.select("doc_id", F.when(c("doc_id") % 3 == 0, F.concat(F.lit("served "), c("doc_id").cast("string"))).otherwise(" ").alias("text"))
    return tables.page_text(pages.select("doc_id"), served, pages.select("doc_id", "text"), ["doc_id"], "text")


@query("WITH s AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 4 <> 0) SELECT c.c_custkey, CASE WHEN c.c_custkey % 5 = 0 THEN 0.5 ELSE c.c_acctbal END AS content FROM customer c LEFT JOIN s USING (c_custkey) WHERE s.c_custkey IS NULL OR c.c_custkey % 5 = 0 AND s.c_acctbal IS DISTINCT FROM 0.5")
def changed_drafts(t):
    rows = t("customer").select("c_custkey", F.when(c("c_custkey") % 5 == 0, 0.5).otherwise(c("c_acctbal")).alias("content"))
    saved = t("customer").where("c_custkey % 4 <> 0").select("c_custkey", c("c_acctbal").alias("content"))
    return tables.only_changed(rows, saved, ["c_custkey"], "content")


@query("WITH n AS (SELECT text, min(doc_id) AS doc_id FROM documents WHERE doc_id % 2 = 1 GROUP BY text) SELECT doc_id FROM n WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)")
def new_uploads(t):
    d = t("documents").select("doc_id", "text")
    return tables.new_content(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0"), "text", [c("doc_id")]).select("doc_id")


@query("""WITH v AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'draft' WHEN 'purchase' THEN 'saved' ELSE 'discarded' END AS state FROM events) SELECT user_id, event_id, state FROM v WHERE state <> 'discarded' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY state, event_id DESC) = 1""")
def page_versions(t):
    state = F.when(c("event_type") == "click", "draft").when(c("event_type") == "purchase", "saved").otherwise("discarded")
    return tables.latest_version(t("events").select("user_id", "event_id", state.alias("state")), ["user_id"], "event_id", "state").select("user_id", "event_id", "state")


@query("SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, coalesce(l.quality, d.n_chars) AS value FROM labels l FULL JOIN documents d ON l.doc_id = d.doc_id")
def cached_values(t):
    return tables.cached_or(t("labels").select("doc_id", c("quality").cast("long").alias("value")), t("documents").select("doc_id", c("n_chars").alias("value")), ["doc_id"], "value")


@query("""WITH w AS (SELECT lang AS pool, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) > 2)) AS word FROM documents WHERE lang <> 'de') SELECT pool, word, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= 3""")
def prediction_pools(t):
    w = t("documents").where("lang <> 'de'").select(c("lang").alias("pool"), F.explode(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) > 2)).alias("word"))
    return w.groupBy("pool", "word").agg(F.count("*").alias("n")).where("n >= 3")


@query("SELECT page_id, regexp_matches(url, '(?i)\\.(pdf|docx?)$') AS is_document, CASE WHEN url LIKE 'http:%' THEN 'speaking' ELSE 'silent' END AS phase FROM pages WHERE NOT starts_with(url, 'ftp') OR url IS NULL")
def source_filters(t):
    return t("pages").where(~F.startswith("url", F.lit("ftp")) | c("url").isNull()).select("page_id", c("url").rlike(r"(?i)\.(pdf|docx?)\z").alias("is_document"), F.when(c("url").startswith("http:"), "speaking").otherwise("silent").alias("phase"))


@query("SELECT user_id, event_id FROM (SELECT *, coalesce(sum((event_type IN ('purchase'))::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over_ FROM events) WHERE over_ = 0")
def job_polls(t):
    return events.until_terminal(t("events"), "user_id", ["ts", "event_id"], "event_type", ["purchase"]).select("user_id", "event_id")


@query("SELECT event_id FROM (SELECT event_id, event_type, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS gap FROM events) WHERE (gap IS NULL OR gap > 7200000000) AND length(event_type) >= 5")
def settled_queries(t):
    return events.settled(t("events"), ["user_id"], "ts", ["ts", "event_id"], 7_200_000_000, "event_type", 5).select("event_id")


@query("""WITH s AS (SELECT conv_id AS key, string_agg(replace(text, 'e ', 'e' || chr(10)), '' ORDER BY turn) AS s FROM conversations GROUP BY conv_id), l AS (SELECT key, string_split(s, chr(10)) AS parts FROM s) SELECT key, unnest(range(len(parts) - 1)) AS n, unnest(parts[1:len(parts) - 1]) AS line FROM l""", session=True)
def stream_lines(spark, sf_dir):
    return events.run_available(spark, f"{sf_dir}/conversations.parquet", lambda s: events.chunk_lines(s.withColumn("text", F.replace("text", F.lit("e "), F.lit("e\n"))), "conv_id", "turn", "text"))


@query("""WITH e AS (SELECT user_id AS key, event_id AS ord, event_type AS place, event_type || (value / 40)::INT AS noun FROM events), f AS (SELECT key, noun, min(ord) AS ord, arg_min(place, ord) AS place FROM e GROUP BY key, noun) SELECT key, place, noun, row_number() OVER (PARTITION BY key, place ORDER BY ord) AS num FROM f""", session=True)
def stream_nouns(spark, sf_dir):
    noun = F.concat("event_type", F.rint(c("value") / 40).cast("int").cast("string"))
    return events.run_available(spark, f"{sf_dir}/events.parquet", lambda s: events.numbered_nouns(s.withColumn("noun", noun), "user_id", "event_id", c("event_type"), "noun"))


@query("""WITH s AS (SELECT event_id AS ord, user_id AS key, epoch_us(ts) / 1e6 AS t, value FROM events), f AS (SELECT *, first_value(t) OVER w AS ft, first_value(value) OVER w AS fv FROM s WINDOW w AS (PARTITION BY key ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)) SELECT key, ord, CASE WHEN t > ft THEN round((value - fv) / (t - ft) * 1e3, 6) ELSE 0.0 END AS vx FROM f""", session=True)
def stream_velocity(spark, sf_dir):
    seconds = F.unix_micros(c("ts").cast("timestamp")) / 1e6
    out = events.run_available(spark, f"{sf_dir}/events.parquet", lambda s: events.tracked(s.withColumn("t", seconds), "user_id", "t", "event_id", "value", 86_400.0))
    return out.select("key", "ord", F.when(c("vx") != 0, F.round(c("vx") * 1e3, 6)).otherwise(F.lit(0.0)).alias("vx"))


_TOLD = Beside(Rows("k long, ord long, line string", [(1, 1, 'data: {"delta": "Hel"}'), (1, 2, 'data: {"delta": "lo"}'), (1, 3, "data: [DONE]"), (2, 1, 'data: {"delta": "x"}'), (2, 2, 'data: {"error": "gone"}'), (2, 3, 'data: {"delta": "!"}'), (3, 1, ": comment"), (3, 2, "data: {broken"), (3, 3, 'data: {"other": 1}')]), "conversations", "conv_id + 10", "turn", "concat('data: {\"', CASE WHEN turn % 5 = 4 THEN 'error' ELSE 'delta' END, '\": \"', role, turn, '\"}')")


@query(f"""WITH l AS (SELECT k, ord, substr(line, 7) AS body FROM {_TOLD.sql} WHERE starts_with(line, 'data: ') AND json_valid(substr(line, 7)) AND line <> 'data: [DONE]'), e AS (SELECT k, ord, body->>'delta' AS delta, body->>'error' AS error FROM l), x AS (SELECT k, max(ord) FILTER (error IS NOT NULL) AS last FROM e GROUP BY k)
SELECT e.k, coalesce(max('Error: ' || error) FILTER (ord = last), '') || coalesce(string_agg(delta, '' ORDER BY ord) FILTER (last IS NULL OR ord > last), '') AS content FROM e JOIN x ON e.k = x.k GROUP BY e.k""", session=True)
def told_answers(spark, sf_dir):
    parsed = events.data_events(_TOLD.frame(spark, sf_dir), "line", "delta string, error string")
    return events.told(parsed, ["k"], "ord", c("event.delta"), c("event.error"))


_ANSWERS = Beside(Rows("id long, request string, latest string, page int, current int", [(1, "r1", "r1", 3, 3), (2, "r1", "r2", 3, 3), (3, "r2", "r2", 3, 4), (4, None, None, 1, 1), (5, "r", None, 1, 1)]), "orders", "o_orderkey + 10", "o_orderstatus", "CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus ELSE o_orderpriority END", "o_custkey % 7", "o_orderkey % 7")


@query(f"SELECT id, request IS NOT DISTINCT FROM latest AND page IS NOT DISTINCT FROM current AS still_current FROM {_ANSWERS.sql.replace('current)', 'current)')}", session=True)
def current_answers(spark, sf_dir):
    return _ANSWERS.frame(spark, sf_dir).select("id", events.still_current(c("request"), c("latest"), c("page"), c("current")).alias("still_current"))


@query("SELECT conv_id, turn, length(text) - length(replace(text, ' ', '')) AS n FROM conversations")
def blank_counts(t):
    return t("conversations").select("conv_id", "turn", T.occurrences(c("text"), " ").alias("n"))


@query("""WITH s AS (SELECT l_orderkey AS k, l_suppkey % 3 AS trace, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 3 ORDER BY l_shipdate, l_linenumber, l_partkey) AS place, l_shipdate FROM lineitem), g AS (SELECT k, trace, min(l_shipdate) AS first, count(*) AS n FROM s GROUP BY k, trace)
SELECT k, trace, n, row_number() OVER (PARTITION BY k ORDER BY first, trace) AS rank, sum(n) OVER (PARTITION BY k)::BIGINT AS total FROM g""")
def trace_groups(t):
    g = t("lineitem").groupBy(c("l_orderkey").alias("k"), (c("l_suppkey") % 3).alias("trace")).agg(F.min("l_shipdate").alias("first"), F.count("*").alias("n"))
    w = Window.partitionBy("k")
    return g.select("k", "trace", "n", F.row_number().over(w.orderBy("first", "trace")).alias("rank"), F.sum("n").over(w).alias("total"))
