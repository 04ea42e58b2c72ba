"""Queries of text, number and date functions, over the test tables and rows written out."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parchment.functions import dates as D
from parchment.functions import text as T
from parchment.operators import nested as N
from parchment.operators import places
from parchment.plans.documents import _markdown_sql
from parchment.plans.inline import ODD_TEXTS, Beside, Rows
from parchment.plans.reference import WIDE, query

c = F.col

def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WIDE}+|{WIDE}+\\z', '', 'g')"


ALL_TEXTS = f"(SELECT doc_id, text FROM documents UNION ALL SELECT * FROM {ODD_TEXTS.sql})"


def texts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(ODD_TEXTS.frame(spark))


@query(f"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '{WIDE}+'), lambda w: w <> '')) AS n_words, {trim_sql(f'''regexp_replace(replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '{WIDE}+', ' ', 'g')''')} AS plain, len(list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda s: {trim_sql('s')}), lambda s: s <> '')) AS n_lines FROM {ALL_TEXTS}", session=True)
def wide_blanks(spark, sf_dir):
    text = c("text")
    return texts(spark, sf_dir).select("doc_id", T.words(text).alias("n_words"), T.strip_html(text).alias("plain"), F.size(T.lines_to_list(text)).alias("n_lines"))


@query(f"""WITH n AS (SELECT doc_id, text, translate(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(text, '[\\s\\x0B\\p{{Z}}]+', ' ', 'g'), '[\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{FEFF}}\\x{{00AD}}]', '', 'g'),
 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬅ', 'st'), 'ﬆ', 'st'), '…', '...'), '‘’‚‛“”„‟–—−', repeat(chr(39), 4) || repeat('"', 4) || '---') AS normalized FROM {ALL_TEXTS})
SELECT doc_id, length(text) AS n_original, normalized, lower(replace(normalized, '\u0130', 'i\u0307')) AS folded, len(regexp_extract_all(normalized, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}''-]*')) AS n_tokens,
 len(list_filter(list_transform(string_split(regexp_replace(regexp_replace(normalized, '{WIDE}+', ' ', 'g'), '([.!?]) ([A-Z(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: {trim_sql('s')}), lambda s: s <> '')) AS n_chunks FROM n""", session=True)
def page_index(spark, sf_dir):
    d = places.page_index(texts(spark, sf_dir), "text", ["doc_id"])
    return d.select("doc_id", F.length("original").alias("n_original"), "normalized", "folded", F.size("tokens").alias("n_tokens"), F.size("chunks").alias("n_chunks"))


@query(f"""SELECT doc_id, replace(regexp_replace(replace(regexp_replace(text, '-({WIDE}*[\\n\\r]{WIDE}*)(\\p{{Ll}})', chr(1) || '\\2', 'g'), chr(1), ''), '{WIDE}+', '', 'g'), chr(1), '') AS compact,
 regexp_replace(regexp_replace(lower(replace({trim_sql('text')}, '\u0130', 'i\u0307')), '{WIDE}+', ' ', 'g'), '[.,;:]+\\z', '') AS noun, {trim_sql("substr(text, 1, 1200)")} AS context FROM {ALL_TEXTS}""", session=True)
def compact_and_keys(spark, sf_dir):
    text = c("text")
    return texts(spark, sf_dir).select("doc_id", T.compact(text).alias("compact"), T.noun_key(text).alias("noun"), T.context_before(text).alias("context"))


_URLS = Rows("id long, url string, format string", [(1, "https://y.t/watch?v=one&x=1&v=two", None), (2, "https://y.t/watch?x=v=3&w=1", "Reel "), (3, "http://youtu.be/abcdefghijk?v=", ""), (4, "no scheme ?v=1", "Single image"), (5, None, "IG Story"), (6, "https://a.b/c.MP4?x", None),
                                                     (7, "https://a.b/c.mp4x", "carousel"), (8, "x:?v=%C3%A9", "reel"), (9, "https://a.b/embed/ABCDEFGHIJK", None)])


@query(f"""WITH u AS (SELECT page_id AS id, url, NULL::VARCHAR AS format FROM pages UNION ALL SELECT * FROM {_URLS.sql}),
p AS (SELECT *, list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda q: starts_with(q, 'v='))[1] AS first FROM u)
SELECT id, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN coalesce(nullif(url_decode(substr(first, 3)), ''), nullif(regexp_extract(url, '(?:youtu\\.be/|/embed/|/shorts/)([A-Za-z0-9_-]{{11}})', 1), '')) END AS video,
 CASE WHEN regexp_matches(lower(coalesce(url, '')), '\\.(mp4|mov|m4v|webm)(\\?|\\z)') OR trim(lower(coalesce(format, ''))) = 'reel' THEN 'video' ELSE 'image' END AS kind,
 CASE WHEN contains(lower(coalesce(format, '')), 'story') OR contains(lower(coalesce(format, '')), 'reel') THEN 'story' WHEN contains(lower(coalesce(format, '')), 'single') THEN 'square' ELSE 'portrait' END AS preset FROM p""", session=True)
def media_of_urls(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/pages.parquet").select(c("page_id").alias("id"), "url", F.lit(None).cast("string").alias("format")).unionByName(_URLS.frame(spark))
    return d.select("id", T.video_id(c("url")).alias("video"), T.asset_kind(c("url"), c("format")).alias("kind"), T.preset_of(c("format")).alias("preset"))


_MD = _markdown_sql().replace("FROM documents", f"FROM {ALL_TEXTS}")


@query(f"""WITH p AS ({_MD}), l AS (SELECT doc_id, plain, list_filter(list_transform(regexp_split_to_array(plain, '\\n{{2,}}'), lambda s: {trim_sql('s')}), lambda s: s <> '') AS parts FROM p)
SELECT doc_id, len(list_filter(regexp_split_to_array(plain, '{WIDE}+'), lambda w: w <> '')) AS words, length(plain) AS chars,
 CASE WHEN len(parts) > 0 THEN array_to_string(list_transform(parts, lambda s: '<div>' || replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br />') || '</div>'), '') ELSE '<div><br></div>' END AS html FROM l""", session=True)
def draft_html(spark, sf_dir):
    d = texts(spark, sf_dir).select("doc_id", T.plain_markdown(c("text")).alias("plain"))  # once for all that follows from it
    return d.select("doc_id", T.words(c("plain")).alias("words"), F.length("plain").alias("chars"), T.draft_blocks(c("plain")).alias("html"))


_RECENT = "(CASE WHEN list_contains(taken, TRUE) THEN len(nodes) + 1 - list_position(list_reverse(taken), TRUE) END)"
_LESS_WORD = f"regexp_replace(regexp_replace(%s, '{WIDE}*[^\\s\\x0B\\p{{Z}}\\x{{FEFF}}]+{WIDE}*\\z', ' '), '{WIDE}{{2,}}', ' ', 'g')"


@query(f"""WITH d AS (SELECT *, strpos(lower(replace(text, '\u0130', 'i\u0307')), 'the') AS spot FROM {ALL_TEXTS})
SELECT doc_id, regexp_replace(text, '(?i)the', '(x$1)') AS replaced,
 CASE WHEN regexp_matches(text, '(?i)the') THEN regexp_replace(regexp_replace(text, '(?is)\\A(.*?){WIDE}*the{WIDE}*', '\\1 '), '{WIDE}{{2,}}', ' ', 'g') ELSE text END AS deleted,
 {_LESS_WORD % 'text'} AS less_word,
 regexp_replace(regexp_replace(text, '{WIDE}*[^.!?]*[.!?]["'']?{WIDE}*\\z', ' '), '{WIDE}{{2,}}', ' ', 'g') AS less_sentence,
 CASE WHEN spot > 0 THEN spot - 1 END AS from_place, CASE WHEN spot > 0 THEN spot + 2 END AS to_place FROM d""", session=True)
def dictated_changes(spark, sf_dir):
    text = c("text")
    place = T.first_place(text, F.lit("THE"))
    return texts(spark, sf_dir).select("doc_id", T.replace_first(text, " The ", "(x$1)").alias("replaced"), T.delete_text(text, "THE").alias("deleted"), T.without_last_word(text).alias("less_word"), T.without_last_sentence(text).alias("less_sentence"), place["start"].alias("from_place"), place["end"].alias("to_place"))


@query(f"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS nodes FROM {ALL_TEXTS}), v AS (SELECT *, list_transform(nodes, lambda x: {trim_sql('x')} <> '') AS seen FROM d),
t AS (SELECT *, list_transform(nodes, lambda x, i: seen[i] AND regexp_matches(x, '(?i)the')) AS taken FROM v), r AS (SELECT *, {_RECENT} AS spot FROM t),
u AS (SELECT doc_id, nodes, seen, list_transform(nodes, lambda x, i: CASE WHEN i = spot THEN regexp_replace(x, '(?i)the', '$0/') ELSE x END) AS replaced,
 CASE WHEN regexp_matches(nodes[1], '(?i)the') THEN 1 ELSE spot END AS opened FROM r),
w AS (SELECT *, list_transform(nodes, lambda x, i: seen[i] AND {_LESS_WORD % 'x'} <> x) AS taken FROM u), y AS (SELECT *, {_RECENT} AS last_word FROM w)
SELECT doc_id, array_to_string(replaced, '|') AS replaced,
 array_to_string(list_transform(nodes, lambda x, i: CASE WHEN i = opened THEN regexp_replace(regexp_replace(x, '(?is)\\A(.*?){WIDE}*the{WIDE}*', '\\1 '), '{WIDE}{{2,}}', ' ', 'g') ELSE x END), '|') AS deleted,
 array_to_string(list_transform(nodes, lambda x, i: CASE WHEN i = last_word THEN {_LESS_WORD % 'x'} ELSE x END), '|') AS less_word FROM y""", session=True)
def recent_edits(spark, sf_dir):
    """The lines of a text as the nodes of an editor: replaced in the most recent node, deleted in the first if it fits, the last word gone."""
    nodes = F.split("text", "\n")
    return texts(spark, sf_dir).select("doc_id", *(F.array_join(x, "|").alias(n) for n, x in (("replaced", T.replace_recent(nodes, "the ", "$0/")), ("deleted", T.delete_recent(nodes, "THE", F.lit(0))), ("less_word", T.without_recent_word(nodes)))))


_FENCED = Beside(Rows("id long, text string", [(1, "```html\n<p>x</p>\n```"), (2, "```\n[\"a\", \" b \"]\n```"), (3, "say [\"x\", null, 3] now"), (4, "no array"), (5, None), (6, "[1,"), (7, "``` \nx```\n")]), "documents", "doc_id + 10", "CASE WHEN doc_id % 3 = 0 THEN concat('```json', chr(10), '[\"', lang, '\", \" ', source, ' \"]', chr(10), '```') ELSE concat('say ', lang, ' [', doc_id, '] now') END")


@query(f"""WITH f AS (SELECT id, {trim_sql("regexp_replace(regexp_replace(coalesce(text, ''), '\\A```[a-zA-Z0-9_-]*\\n?', ''), '\\n?```\\z', '')")} AS plain FROM {_FENCED.sql}),
j AS (SELECT *, regexp_extract(plain, '(\\[[\\s\\S]*\\])', 1) AS a FROM f)
SELECT id, plain, CASE WHEN a <> '' THEN array_to_string(list_transform(json_extract_string(a, '$[*]'), lambda x: trim(coalesce(x, ''))), '|') END AS items FROM j""", session=True)
def fenced_answers(spark, sf_dir):
    return _FENCED.frame(spark, sf_dir).select("id", T.without_fence(c("text")).alias("plain"), F.array_join(T.listed(c("text")), "|").alias("items"))


_LABELS = Beside(Rows("id long, label string, code string", [(1, "\U0001F1E8\U0001F1E6 Canada (+1)", "CA"), (2, "\U0001F1E9\U0001F1EA Germany (+49)", "DE"), (3, "Nowhere", "N"), (4, "X Land (north) (+7)", "XL"), (5, "", "+"), (6, "Côte (+225) d", "CI")]), "customer", "c_custkey + 10", "concat('F ', c_mktsegment, ' (+', c_nationkey, ')')", "c_mktsegment")


@query(f"SELECT id, regexp_extract(label, '^(\\S+)', 1) AS flag, regexp_replace(regexp_replace(label, '^\\S+\\s', ''), '\\s*\\(\\+\\d+\\)\\z', '') AS country FROM {_LABELS.sql} WHERE contains(lower(label), 'an') OR contains(code, 'N')", session=True)
def country_labels(spark, sf_dir):
    d = _LABELS.frame(spark, sf_dir)
    return d.where(F.lower("label").contains("an") | c("code").contains("N")).select("id", T.flag_of(c("label")).alias("flag"), T.country_of(c("label")).alias("country"))


_ANSWERS = Beside(Rows("id long, message string, status int, bytes long", [(1, "File SIZE exceeded", 400, 1), (2, None, 413, 1048576), (3, "Payload too large", None, 3407872), (4, "not found", 404, 0), (5, "", None, 104857600), (6, "Maximum reached", 500, 157286)]), "pages", "page_id + 10", "CASE WHEN page_id % 3 = 0 THEN 'Request TOO large' ELSE url END", "400 + page_id % 20", "length(html) * 37")


@query(f"SELECT id, coalesce(status = 413, FALSE) OR regexp_matches(coalesce(message, ''), '(?i)cloudinary|file size|too large|payload too large|maximum|max size|limit exceeded') AS too_large, printf('%.1f MB', floor(bytes / 1048576.0 * 10 + 0.5) / 10) AS size FROM {_ANSWERS.sql}", session=True)
def upload_answers(spark, sf_dir):
    return _ANSWERS.frame(spark, sf_dir).select("id", T.is_size_error(c("message"), c("status")).alias("too_large"), D.megabytes(c("bytes")).alias("size"))


#: Sounds and the shapes of a mouth.
SHAPES = {"TH": "viseme_TH", "DH": "viseme_TH", "L": "viseme_L", "R": "viseme_R", "S": "viseme_S", "Z": "viseme_S"}
_SOUNDS = Rows("id long, code string, text string", [(1, "th", "amctoshs and AMCTOSHS"), (2, "Z", "nothing"), (3, None, None), (4, "qq", "AMCTOSHSX"), (5, "sil", "")])


@query(f"SELECT id, CASE upper(code) WHEN 'TH' THEN 'viseme_TH' WHEN 'DH' THEN 'viseme_TH' WHEN 'L' THEN 'viseme_L' WHEN 'R' THEN 'viseme_R' WHEN 'S' THEN 'viseme_S' WHEN 'Z' THEN 'viseme_S' ELSE 'mouthClose' END AS shape, regexp_replace(coalesce(text, ''), '(?i)AMCTOSHS', 'Amek Tosh Ess', 'g') AS spoken, greatest(600, 55 * length(coalesce(text, ''))) AS ms FROM (SELECT * FROM {_SOUNDS.sql} UNION ALL SELECT conv_id * 1000 + turn + 10, role, text FROM conversations)", session=True)
def spoken_texts(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((c("conv_id") * 1000 + c("turn") + 10).alias("id"), c("role").alias("code"), "text").unionByName(_SOUNDS.frame(spark))
    return d.select("id", T.viseme(c("code"), SHAPES).alias("shape"), T.speakable(c("text")).alias("spoken"), D.speaking_ms(c("text")).alias("ms"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN '•' WHEN l_linestatus = 'O' THEN chr((97 + l_partkey % 26)::INT) || '.' ELSE (l_partkey + 1) || '.' END AS marker, l_partkey FROM lineitem")
def list_markers(t):
    style = F.when(c("l_linestatus") == "O", "Lower-Alpha")
    return t("lineitem").select("l_orderkey", "l_linenumber", T.list_marker(c("l_returnflag") != "R", style, c("l_partkey")).alias("marker"), "l_partkey")


_NAMES = Rows("id long, name string", [(1, "multi_word_name"), (2, "ALREADY_Upper"), (3, ""), (4, None), (5, "_lead"), (6, "été_x")])


@query(f"SELECT id, array_to_string(list_transform(string_split(coalesce(name, ''), '_'), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS title FROM (SELECT * FROM {_NAMES.sql} UNION ALL SELECT event_id + 10, event_type FROM events)", session=True)
def titles(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/events.parquet").select((c("event_id") + 10).alias("id"), c("event_type").alias("name")).unionByName(_NAMES.frame(spark))
    return d.select("id", T.title_words(c("name")).alias("title"))


_SCRIPTS = Rows("id long, html string", [(1, "<p>قلب heart</p>"), (2, "123 !?"), (3, None), (4, "قلب"), (5, "<b>abc</b>&nbsp;ق")])


@query(f"WITH s AS (SELECT id, regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g') AS s FROM {_SCRIPTS.sql} UNION ALL SELECT page_id + 10, regexp_replace(html, '<[^>]+>', ' ', 'g') FROM pages) SELECT id, CASE WHEN len(regexp_extract_all(s, '[A-Za-z\\x{{0600}}-\\x{{06FF}}]')) - 4 * 0 = 0 THEN 0.0 ELSE round(len(regexp_extract_all(replace(s, '&nbsp;', ' '), '[\\x{{0600}}-\\x{{06FF}}]')) / len(regexp_extract_all(replace(s, '&nbsp;', ' '), '[A-Za-z\\x{{0600}}-\\x{{06FF}}]')), 6) END AS share FROM s".replace("len(regexp_extract_all(s, '[A-Za-z\\x{0600}-\\x{06FF}]')) - 4 * 0 = 0", "len(regexp_extract_all(replace(s, '&nbsp;', ' '), '[A-Za-z\\x{0600}-\\x{06FF}]')) = 0"), session=True)
def arabic_shares(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/pages.parquet").select((c("page_id") + 10).alias("id"), "html").unionByName(_SCRIPTS.frame(spark))
    return d.select("id", F.round(T.arabic_share(c("html")), 6).alias("share"))


@query(f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM {ALL_TEXTS}), w AS (SELECT doc_id, list_filter(regexp_split_to_array(line, '{WIDE}+'), lambda x: x <> '') AS words FROM l) SELECT doc_id, sum(len(words))::BIGINT AS n_words, sum(length(array_to_string(words, '')))::BIGINT AS n_chars, max(len(words)) AS longest FROM w GROUP BY doc_id", session=True)
def line_words(spark, sf_dir):
    d = texts(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", T.word_list(c("line")).alias("words"))
    return d.groupBy("doc_id").agg(F.sum(F.size("words")).alias("n_words"), F.sum(F.length(F.array_join("words", ""))).alias("n_chars"), F.max(F.size("words")).alias("longest"))


_CALLS = Rows("id long, start string, stop string", [(1, "2026-03-01 10:00:00", "2026-03-01 10:01:05.5"), (2, "2026-03-01 10:00:00", None), (3, None, "2026-03-01 10:00:00"), (4, "2026-03-01 10:00:00", "2026-03-01 09:00:00"), (5, "2026-03-01 10:00:00", "2026-03-01 12:03:04.4")])


@query(f"""WITH k AS (SELECT id, start::TIMESTAMP AS a, stop::TIMESTAMP AS b FROM {_CALLS.sql} UNION ALL SELECT event_id + 10, ts, ts + to_microseconds((value * 1e6)::BIGINT) FROM events),
s AS (SELECT *, greatest(0, floor((epoch_ms(b) - epoch_ms(a)) / 1000 + 0.5))::BIGINT AS s FROM k)
SELECT id, CASE WHEN a IS NULL THEN '' WHEN b IS NULL THEN 'ongoing' ELSE printf('%d:%02d', s // 60, s % 60) END AS clock FROM s""", session=True)
def call_clocks(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.unix_micros(c("ts").cast("timestamp"))
    d = e.select((c("event_id") + 10).alias("id"), F.timestamp_micros(us).alias("a"), F.timestamp_micros(us + F.round(c("value") * 1e6).cast("long")).alias("b"))
    d = d.unionByName(_CALLS.frame(spark).select("id", D.time_of(c("start")).alias("a"), D.time_of(c("stop")).alias("b")))
    return d.select("id", D.call_clock(c("a"), c("b")).alias("clock"))


_TIMES = Rows("id long, time string", [(1, "2026-11-03 14:05:00"), (2, "bad"), (3, None), (4, "1999-12-31 23:59:59")])


@query(f"""WITH k AS (SELECT id, try_cast(time AS TIMESTAMP) AS x FROM {_TIMES.sql} UNION ALL SELECT event_id + 10, ts FROM events), n AS (SELECT *, TIMESTAMP '2026-11-03 20:00:00' AS now FROM k)
SELECT id, coalesce(strftime(x, '%Y-%m-%d %H:%M'), '—') AS minute, coalesce(strftime(x, '%Y-%m-%dT%H:%M'), '') AS input, coalesce(strftime(x, '%b %-d, %Y'), '—') AS day,
 coalesce(CASE WHEN x::DATE = now::DATE THEN strftime(x, '%-I:%M %p') WHEN year(x) = year(now) THEN strftime(x, '%b %-d') ELSE strftime(x, '%b %-d, %Y') END, '') AS listed FROM n""", session=True)
def date_forms(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/events.parquet").select((c("event_id") + 10).alias("id"), c("ts").cast("timestamp").alias("x")).unionByName(_TIMES.frame(spark).select("id", D.time_of(c("time")).alias("x")))
    now = F.lit("2026-11-03 20:00:00").cast("timestamp")
    return d.select("id", D.minute_label(c("x")).alias("minute"), D.input_label(c("x")).alias("input"), D.day_label(c("x")).alias("day"), D.list_label(c("x"), now).alias("listed"))


@query("""WITH o AS (SELECT user_id, event_id, ts, lag(ts::DATE) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS before FROM events), n AS (SELECT max(ts) AS now FROM events)
SELECT user_id, event_id, CASE WHEN before IS NULL OR before <> ts::DATE THEN CASE now::DATE - ts::DATE WHEN 0 THEN 'Today' WHEN 1 THEN 'Yesterday' ELSE strftime(ts, '%B %-d, %Y') END END AS header FROM o, n""")
def day_headers(t):
    e = t("events").select("user_id", "event_id", "ts")
    before = F.lag(F.to_date("ts")).over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    now = e.agg(F.max("ts")).first()[0]
    rows = e.withColumn("before", before)
    header = F.when(c("before").isNull() | (c("before") != F.to_date("ts")), D.relative_day(c("ts"), F.lit(now)))
    return rows.select("user_id", "event_id", header.alias("header"))


@query("SELECT doc_id, CASE WHEN n_chars = 0 THEN '' WHEN n_chars >= 1000000 THEN printf('%.1fM views', floor(n_chars / 1e5 + 0.5) / 10) WHEN n_chars >= 1000 THEN printf('%.1fK views', floor(n_chars / 1e2 + 0.5) / 10) ELSE n_chars || ' views' END AS views FROM documents")
def view_counts(t):
    return t("documents").select("doc_id", T.short_number(c("n_chars")).alias("views"))


_CAPTURES = Beside(Rows("id long, texts array<string>, names string", [(1, [" a ", "", None, "b\n"], " x, ,y ,"), (2, [None, "  "], ""), (3, ["0123456789" * 3], "one"), (4, [], ",")]), "conversations", "conv_id * 1000 + turn + 10", ("array(role, null, text)", "[role, NULL, text]"), "concat(role, ', ,', turn)")


@query(f"SELECT id, left(array_to_string(list_filter(list_transform(texts, lambda s: {trim_sql('''coalesce(s, '')''')}), lambda s: s <> ''), chr(10) || chr(10)), 25) AS captured, array_to_string(list_filter(list_transform(string_split(names, ','), lambda s: trim(s)), lambda s: s <> ''), '|') AS names FROM {_CAPTURES.sql}", session=True)
def captured_texts(spark, sf_dir):
    return _CAPTURES.frame(spark, sf_dir).select("id", T.joined_captures(c("texts"), 25).alias("captured"), F.array_join(T.trimmed_list(c("names")), "|").alias("names"))


@query("""WITH s AS (SELECT l_orderkey, least(255, round(l_quantity * 5))::INT AS v FROM lineitem) SELECT l_orderkey, round(least(1, 4 * sqrt(avg(((v - 128) / 128.0) ** 2))), 6) AS open FROM s GROUP BY l_orderkey""")
def mouth_openings(t):
    v = F.least(F.lit(255), F.round(c("l_quantity") * 5)).cast("int")
    return t("lineitem").groupBy("l_orderkey").agg(F.collect_list(v).alias("v")).select("l_orderkey", F.round(N.loudness(c("v")), 6).alias("open"))
