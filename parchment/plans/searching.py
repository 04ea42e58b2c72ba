"""Queries of the page index, of tolerant search and of what it finds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parchment.functions import text as T
from parchment.operators import correction, documents, layout, nested, search
from parchment.operators import page_index as P
from parchment.plans.inline import Rows
from parchment.plans.reference import WIDE, query
from parchment.plans.texts import ALL_TEXTS, texts, trim_sql

c = F.col

#: Compatibility forms, hyphens at line breaks, invisible signs beside blanks.
FORMS = Rows("doc_id long, text string", [(-101, "H²O ½ cup ①\n㎏ ¨ ǆ eﬃcient"), (-102, "wide Ａ１　end…"), (-103, "cardio- \n vascular well-\r\n-known IL-\n6 COVID-\nX a-\nb"), (-104, "a ​\n b­-\nc ﻿"), (-105, "-\na--\nb"), (-106, "😀 smile 😀- \n x"), (-107, "\n\n\nx\n\n"),
                                                 (-108, "x OF\u00a0the y Of \n The"), (-109, "o f t h e and oft he"), (-110, "of-the of -the"), (-111, "of • the, o; f. the of\u200b the"), (-112, "OF—THE o-f-t-h-e")])
ALL_FORMS = f"(SELECT * FROM {ALL_TEXTS} UNION ALL SELECT * FROM {FORMS.sql})"

#: Signs of the odd texts and their folded forms, written out for SQL.
_FOLDS = ", ".join(f"('{a}', '{b}')" for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("…", "..."), ("‘", "''"), ("’", "''"), ("“", '"'), ("”", '"'), ("—", "-"), ("–", "-"), ("²", "2"), ("½", "1⁄2"), ("①", "1"), ("㎏", "kg"), ("¨", " ̈"), ("ǆ", "dž"), ("Ａ", "A"), ("１", "1")))


def _key(form: str, place: str) -> str:
    """SQL of one number for a form of a text and a place in it, so that joins on two places do not meet on the text alone."""
    return f"((doc_id * 2 + ({form} = 'normal')::INT)::HUGEINT * 1000000000 + {place})"


#: The signs of each text in order: sign, original place, runs of blanks put together, folded form; then normalized signs n and compact ones z.
SIGNS = f"""t AS (SELECT doc_id, text, regexp_extract_all(text, '(?s).') AS l FROM {ALL_FORMS}), s AS (SELECT doc_id, unnest(l) AS ch, generate_subscripts(l, 1) - 1 AS i FROM t),
k AS (SELECT *, regexp_matches(ch, '[\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{FEFF}}\\x{{00AD}}]') AS inv, regexp_matches(ch, '{WIDE}') AND ch <> chr(65279) AS sp FROM s),
f AS (SELECT *, sp AND NOT coalesce(lag(sp) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS first FROM k),
g AS (SELECT *, sum(CASE WHEN first OR NOT sp THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS unit FROM f WHERE NOT inv),
u AS (SELECT doc_id, unit, min(i) AS os, max(i) + 1 AS oe, CASE WHEN bool_or(sp) THEN ' ' ELSE any_value(coalesce(v.b, ch)) END AS out, bool_or(ch IN (chr(10), chr(13))) AS brk FROM g LEFT JOIN (VALUES {_FOLDS}) v(a, b) ON v.a = ch GROUP BY doc_id, unit),
e AS (SELECT doc_id, unit, os, oe, brk, unnest(regexp_extract_all(out, '(?s).')) AS ch, generate_subscripts(regexp_extract_all(out, '(?s).'), 1) AS sub FROM u),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY unit, sub) - 1 AS p FROM e),
y AS (SELECT *, ch = '-' AND coalesce(lead(ch) OVER w = ' ' AND lead(brk) OVER w AND regexp_matches(lead(ch, 2) OVER w, '\\p{{Ll}}'), FALSE) AS soft FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
z AS (SELECT doc_id, p AS np, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS p FROM y WHERE ch <> ' ' AND NOT soft)"""


@query(f"""WITH {SIGNS}, m AS (SELECT *, {_key('form', 'p')} AS place FROM (SELECT 'normal' AS form, doc_id, p, os, oe FROM n UNION ALL SELECT 'compact', z.doc_id, z.p, os, oe FROM z JOIN n ON n.doc_id = z.doc_id AND n.p = z.np)),
h AS (SELECT form, doc_id, max(p) + 1 AS size FROM m GROUP BY ALL), r AS (SELECT form, doc_id, unnest(range(0, size, 53)) AS a, size FROM h),
b AS (SELECT form, doc_id, a, least(size, a + 1 + a * 7 % 61) AS b FROM r), bk AS (SELECT *, {_key('form', 'a')} AS ka, {_key('form', 'b - 1')} AS kb FROM b), o AS (SELECT bk.*, x.os, y.oe FROM bk JOIN m x ON x.place = ka JOIN m y ON y.place = kb),
li AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM t),
lo AS (SELECT doc_id, n - 1 AS item, length(line) AS wide, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(line) - 1 AS start FROM li)
SELECT o.form, o.doc_id, a AS start_at, b AS end_at, os AS from_at, oe AS to_at, count(item)::INT AS n_items, min(item)::INT AS first_item, max(item)::INT AS last_item, arg_min(greatest(os, start) - start, item)::INT AS first_from, arg_max(least(oe, start + wide) - start, item)::INT AS last_to
 FROM o LEFT JOIN lo ON lo.doc_id = o.doc_id AND wide > 0 AND os < start + wide AND oe > start GROUP BY ALL""", session=True)
def page_ranges(spark, sf_dir):
    """Ranges of the normalized and of the compact text of each page, in the original and in its items (lines)."""

    def steps(sizes):
        counts = -(-sizes // 53)
        a = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)) * 53
        return counts, a, np.minimum(np.repeat(sizes, counts), a + 1 + a * 7 % 61)

    out = P.located(_pages(spark, sf_dir), "text", steps).withColumnRenamed("items", "i")
    first, last = F.get("i", F.lit(0)), F.try_element_at("i", F.lit(-1))
    return out.select("form", "doc_id", c("given.start").alias("start_at"), c("given.end").alias("end_at"), c("found.start").alias("from_at"), c("found.end").alias("to_at"), F.size("i").alias("n_items"), first["item"].alias("first_item"), last["item"].alias("last_item"), first["local_start"].alias("first_from"), last["local_end"].alias("last_to"))


def _places(stage: int, text: str, needle: str, form: str) -> str:
    """SQL of the places of a text that do not overlap, by what stands between them."""
    return f"""SELECT doc_id, {stage} AS stage, '{form}' AS form, spot + (n - 1) * {len(needle)} AS a, spot + n * {len(needle)} AS b FROM (SELECT doc_id, n, last, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY n) AS spot
 FROM (SELECT doc_id, unnest(l) AS part, generate_subscripts(l, 1) AS n, len(l) AS last FROM (SELECT doc_id, string_split({text}, '{needle}') AS l FROM x))) WHERE n < last"""


_LEADS = " UNION ALL ".join(f"SELECT doc_id, a, (lead(b, {k}) OVER w) AS b, {' || '.join(['w', *(f'lead(w, {i}) OVER w' for i in range(1, k + 1))])} AS joined FROM tk WINDOW w AS (PARTITION BY doc_id ORDER BY a)" for k in range(5))

#: Hits h of 'of the' in each text by the first stage that has any: stage, original places os to oe.
HITS = f"""{SIGNS}, zc AS (SELECT z.*, n.ch FROM z JOIN n ON n.doc_id = z.doc_id AND n.p = z.np), al AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS q FROM zc WHERE ch <> '-'),
x AS (SELECT * FROM (SELECT doc_id, string_agg(ch, '' ORDER BY p) AS normal FROM n GROUP BY doc_id) LEFT JOIN (SELECT doc_id, string_agg(lower(ch), '' ORDER BY p) AS compact FROM zc GROUP BY doc_id) USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(lower(ch), '' ORDER BY p) AS alias FROM al GROUP BY doc_id) USING (doc_id)),
wc AS (SELECT *, regexp_matches(ch, '[\\p{{L}}\\p{{N}}]') AS core, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS island FROM n WHERE regexp_matches(ch, '[\\p{{L}}\\p{{N}}''-]')), wf AS (SELECT *, bool_or(core) OVER (PARTITION BY doc_id, island ORDER BY p) AS begun FROM wc),
tk AS (SELECT doc_id, min(p) AS a, max(p) + 1 AS b, lower(string_agg(ch, '' ORDER BY p)) AS w FROM wf WHERE begun GROUP BY doc_id, island),
al_hits AS ({_places(4, 'alias', 'ofthe', 'compact')}),
every AS ({_places(1, 'normal', 'of the', 'normal')} UNION ALL {_places(2, 'lower(normal)', 'of the', 'normal')} UNION ALL {_places(3, 'compact', 'ofthe', 'compact')} UNION ALL SELECT h.doc_id, 4, 'compact', i.p, j.p + 1 FROM (SELECT *, {_key("'x'", 'a')} AS ka, {_key("'x'", 'b - 1')} AS kb FROM al_hits) h JOIN (SELECT p, {_key("'x'", 'q')} AS place FROM al) i ON i.place = ka JOIN (SELECT p, {_key("'x'", 'q')} AS place FROM al) j ON j.place = kb
 UNION ALL SELECT doc_id, 5, 'normal', a, b FROM ({_LEADS}) WHERE joined = 'ofthe'), best AS (SELECT *, min(stage) OVER (PARTITION BY doc_id) AS least FROM every),
m AS (SELECT *, {_key('form', 'p')} AS place FROM (SELECT 'normal' AS form, doc_id, p, os, oe FROM n UNION ALL SELECT 'compact', z.doc_id, z.p, os, oe FROM z JOIN n ON n.doc_id = z.doc_id AND n.p = z.np)),
bk AS (SELECT *, {_key('form', 'a')} AS ka, {_key('form', 'b - 1')} AS kb FROM best WHERE stage = least), h AS (SELECT bk.doc_id, stage, u.os, v.oe FROM bk JOIN m u ON u.place = ka JOIN m v ON v.place = kb)"""
_STAGE = "CASE stage WHEN 1 THEN 'exact' WHEN 2 THEN 'case_insensitive' WHEN 3 THEN 'compact' WHEN 4 THEN 'alias' ELSE 'token' END"
_SURE = "CASE stage WHEN 1 THEN 1.0 WHEN 2 THEN 0.97 WHEN 3 THEN 0.93 WHEN 4 THEN 0.9 ELSE 0.85 END::DOUBLE"


def _pages(spark, sf_dir):
    return texts(spark, sf_dir).unionByName(FORMS.frame(spark))


@query(f"""WITH {HITS}, li AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM t), lo AS (SELECT doc_id, k - 1 AS item, length(line) AS wide, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(line) - 1 AS start FROM li)
SELECT h.doc_id, {_STAGE} AS stage, {_SURE} AS confidence, os AS start_at, oe AS end_at, count(item)::INT AS n_items, min(item)::INT AS first_item, arg_min(greatest(os, start) - start, item)::INT AS first_from, arg_max(least(oe, start + wide) - start, item)::INT AS last_to
 FROM h LEFT JOIN lo ON lo.doc_id = h.doc_id AND wide > 0 AND os < start + wide AND oe > start GROUP BY ALL""", session=True)
def search_stages(spark, sf_dir):
    """Every page searched, from exact to word by word, with the lines that each hit touches."""
    pages = _pages(spark, sf_dir)
    hits = search.search_pages(pages, "doc_id", "text", "of the", fuzzy=False)
    d = search.hits_with_items(hits, pages.withColumn("lines", P.line_items(c("text"))), "doc_id", "lines")
    first, last = F.get("items", F.lit(0)), F.try_element_at("items", F.lit(-1))
    return d.select("doc_id", "stage", "confidence", c("start").alias("start_at"), c("end").alias("end_at"), F.size("items").alias("n_items"), first["item"].alias("first_item"), first["local_start"].alias("first_from"), last["local_end"].alias("last_to"))


@query(f"""WITH {HITS}, b AS (SELECT doc_id, coalesce(sum(count(*)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h GROUP BY doc_id)
SELECT h.doc_id, {_STAGE} AS stage, os AS start_at, oe AS end_at FROM h JOIN b USING (doc_id) WHERE before < 50 ORDER BY {_SURE} DESC, h.doc_id, os LIMIT 50""", session=True)
def search_topk(spark, sf_dir):
    """The first fifty hits of a reader who goes page by page; later pages are not searched."""
    return search.first_hits(_pages(spark, sf_dir), "doc_id", "text", "of the", 50, fuzzy=False).select("doc_id", "stage", c("start").alias("start_at"), c("end").alias("end_at"))


_LISTS = Rows("id long, kind string, child_ids array<bigint>", [(-1, "list", [-2, -3, -2, -99]), (-2, "list_item", [-4]), (-3, "list_item", [-5, -4]), (-4, "list", [-6]), (-5, "text", []), (-6, "list_item", None), (-7, "list", [-8]), (-8, "list_item", [-7]), (-10, "list", []), (-11, "list_item", [-1])])


@query(f"""WITH RECURSIVE p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 1 THEN 'list' ELSE 'list_item' END AS kind, [3 * p_partkey - 1, 3 * p_partkey + 1] AS child_ids FROM part UNION ALL SELECT * FROM {_LISTS.sql}),
c AS (SELECT id, kind, unnest(child_ids) AS child, generate_subscripts(child_ids, 1) AS n FROM p), l AS (SELECT c.*, k.kind AS child_kind FROM c JOIN p k ON k.id = c.child),
i AS (SELECT id AS list_id, child AS item_id, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS n FROM l WHERE kind = 'list' AND child_kind = 'list_item'), d AS (SELECT id AS item_id, arg_min(child, n) AS list_id FROM l WHERE kind = 'list_item' AND child_kind = 'list' GROUP BY id),
t AS (SELECT list_id AS root, item_id, n::VARCHAR AS place, 1 AS depth, [list_id] AS met FROM i WHERE list_id NOT IN (SELECT list_id FROM d) UNION ALL SELECT t.root, i.item_id, t.place || '.' || i.n, t.depth + 1, list_append(t.met, d.list_id) FROM t JOIN d ON d.item_id = t.item_id JOIN i ON i.list_id = d.list_id WHERE NOT list_contains(t.met, d.list_id))
SELECT root, item_id, place, depth FROM t""", session=True)
def list_trees(spark, sf_dir):
    """Parts as lists and items by turns, each part n with the children 3 n - 1 and 3 n + 1, beside lists with repeats, strangers and a circle."""
    p = c("p_partkey").cast("long")
    d = spark.read.parquet(f"{sf_dir}/part.parquet").select(p.alias("id"), F.when(p % 2 == 1, "list").otherwise("list_item").alias("kind"), F.array(3 * p - 1, 3 * p + 1).alias("child_ids"))
    return documents.list_tree(d.unionByName(_LISTS.frame(spark))).select("root", "item_id", F.array_join(F.transform("place", lambda x: x.cast("string")), ".").alias("place"), "depth")


def _alike(x: str, y: str) -> str:
    return f"CASE WHEN {x} = {y} THEN 0.0 WHEN {x} IN ('l', 'i', '1') AND {y} IN ('l', 'i', '1') OR {x} IN ('o', '0') AND {y} IN ('o', '0') THEN 0.4 ELSE 1.0 END"


_SCANNED = "replace(replace(replace({}, 'rn', 'm'), 'vv', 'w'), 'cl', 'd')"
_BARE = "regexp_replace({}, '[^\\p{{L}}\\p{{N}}]', '', 'g')"
#: The names of parts as scans and line breaks leave them, one way in ten.
_SPOILT = """CASE p_partkey % 10 WHEN 0 THEN p_name WHEN 1 THEN concat(a, ' ', left(b, 2), ' ', substr(b, 3)) WHEN 2 THEN concat(a, ' ', left(b, 2), '-', chr(10), substr(b, 3)) WHEN 3 THEN concat(a, '-', chr(10), b) WHEN 4 THEN concat(a, ' ', b, 'x')
 WHEN 5 THEN concat(a, '  ', b) WHEN 6 THEN concat(a, ' ', replace(replace(b, 'l', '1'), 'o', '0')) WHEN 7 THEN concat(left(b, 1), 'q', substr(b, 2)) WHEN 8 THEN concat(upper(a), ' ', b, '., (', b, ')') ELSE concat('ﬁne ', b) END"""


@query(f"""WITH RECURSIVE n AS (SELECT p_partkey, p_name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part), t AS (SELECT p_partkey, {_SPOILT} AS text FROM n),
w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part), l AS (SELECT list(word) AS known FROM w),
h AS (SELECT *, regexp_extract(text, '(\\p{{L}}+)-[ \\t]*\\n[ \\t]*(\\p{{Ll}}\\p{{L}}*)', 1) AS h1, regexp_extract(text, '(\\p{{L}}+)-[ \\t]*\\n[ \\t]*(\\p{{Ll}}\\p{{L}}*)', 2) AS h2 FROM t, l),
j AS (SELECT *, h1 <> '' AS broken, h1 <> '' AND list_contains(known, lower(h1 || h2)) AS joins, CASE WHEN h1 = '' THEN text ELSE replace(text, h1 || '-' || chr(10) || h2, CASE WHEN list_contains(known, lower(h1 || h2)) THEN h1 || h2 ELSE h1 || '-' || h2 END) END AS joined FROM h),
f AS (SELECT *, string_split(replace(regexp_replace(joined, '\\s+', ' ', 'g'), 'ﬁ', 'fi'), ' ') AS parts, contains(joined, 'ﬁ') AS lig, regexp_matches(joined, '\\s{{2,}}|\\t|\\n') AS wide FROM j),
s AS (SELECT *, list_transform(parts, lambda x: lower({_BARE.format('x')})) AS bare, list_transform(parts, lambda x: lower(regexp_extract(x, '^[\\p{{L}}\\p{{N}}]*'))) AS heads, list_transform(parts, lambda x: regexp_replace(x, '^[\\p{{L}}\\p{{N}}]*', '')) AS tails FROM f),
q AS (SELECT *, list_filter(range(1, len(parts)), lambda i: bare[i] <> '' AND heads[i + 1] <> '' AND list_contains(known, bare[i] || heads[i + 1]) AND NOT (list_contains(known, bare[i]) AND list_contains(known, heads[i + 1])))[1] AS k FROM s),
o AS (SELECT *, CASE WHEN k IS NULL THEN parts ELSE list_concat(list_append(parts[1:k - 1], {_BARE.format('parts[k]')} || regexp_extract(parts[k + 1], '^[\\p{{L}}\\p{{N}}]*') || tails[k + 1]), parts[k + 2:]) END AS fixed FROM q),
c AS (SELECT *, array_to_string(fixed, ' ') AS whole_text, list_filter(list_transform(fixed, lambda x: {_BARE.format('x')}), lambda x: x <> '' AND NOT list_contains(known, lower(x))) AS unknown, lower({_BARE.format("array_to_string(fixed, ' ')")}) AS whole, broken::INT + lig::INT + wide::INT + (k IS NOT NULL)::INT AS n FROM o),
terms AS (SELECT DISTINCT term FROM (SELECT lower(unnest(unknown)) AS term FROM c UNION ALL SELECT whole FROM c WHERE n = 0) WHERE length(term) BETWEEN 4 AND 40), pairs AS (SELECT term, word, {_SCANNED.format('term')} AS x, {_SCANNED.format('word')} AS y FROM terms, w WHERE abs(length(term) - length(word)) <= floor(greatest(3, length(term) * 0.5))),
dp AS (SELECT term, word, x, y, 0 AS i, list_transform(range(0, length(y) + 1), lambda v: v::DOUBLE) AS r FROM pairs UNION ALL SELECT term, word, x, y, i + 1, list_transform(range(0, length(y) + 1), lambda v: v + list_min(list_transform(range(0, v + 1), lambda u: (CASE WHEN u = 0 THEN i + 1 ELSE least(r[u + 1] + 1, r[u] + {_alike('substr(x, i + 1, 1)', 'substr(y, u, 1)')}) END) - u))) FROM dp WHERE i < length(x)),
near AS (SELECT term, word, greatest(0, 1 - r[length(y) + 1] / greatest(length(term), length(word), 1)) AS sure FROM dp WHERE i = length(x)), best AS (SELECT term, arg_min(word, {{'a': -sure, 'b': word}}) AS word, max(sure) AS sure FROM near WHERE sure > 0 GROUP BY term),
u AS (SELECT p_partkey, unnest(unknown) AS one, generate_subscripts(unknown, 1) AS place FROM c), g AS (SELECT p_partkey, list({{'word': word, 'sure': sure, 'place': place}} ORDER BY place) AS found FROM u JOIN best ON term = lower(one) WHERE sure >= 0.75 AND length(one) >= 4 GROUP BY p_partkey),
z AS (SELECT c.*, coalesce(found, []) AS found, CASE WHEN n = 0 AND found IS NULL AND len(unknown) > 0 AND length(whole) BETWEEN 5 AND 40 AND best.sure >= 0.6 THEN best.word END AS guess, best.sure AS guess_sure FROM c LEFT JOIN g USING (p_partkey) LEFT JOIN best ON best.term = whole),
y AS (SELECT *, guess IS NOT NULL AND guess_sure >= 0.9 AS sure_guess FROM z)
SELECT p_partkey, CASE WHEN sure_guess THEN guess ELSE whole_text END AS corrected, round(confidence, 6) AS confidence, confidence < 0.9 AS uncertain, n + sure_guess::INT AS n_changes, change_types, candidates FROM (SELECT *,
 CASE WHEN n > 0 OR sure_guess THEN least(CASE WHEN joins THEN 0.95 WHEN broken THEN 0.85 ELSE 1 END, CASE WHEN lig THEN 0.99 ELSE 1 END, CASE WHEN wide OR k IS NOT NULL THEN 0.97 ELSE 1 END, CASE WHEN sure_guess THEN guess_sure ELSE 1 END) WHEN len(found) > 0 THEN found[1].sure WHEN guess IS NOT NULL THEN guess_sure ELSE 1.0 END::DOUBLE AS confidence,
 array_to_string(list_filter([CASE WHEN broken THEN 'hyphenation_repair' END, CASE WHEN lig THEN 'ligature_expansion' END, CASE WHEN wide THEN 'whitespace_repair' END, CASE WHEN k IS NOT NULL THEN 'split_word_repair' END, CASE WHEN sure_guess THEN 'fuzzy_dictionary_match' END], lambda x: x IS NOT NULL), '|') AS change_types,
 CASE WHEN guess IS NOT NULL AND NOT sure_guess THEN guess ELSE array_to_string(list_transform(list_sort(list_transform(found, lambda x: {{'s': -x.sure, 'p': x.place, 'w': x.word}})), lambda x: x.w), '|') END AS candidates FROM y)""", session=True)
def text_correction(spark, sf_dir):
    """Names of parts with split words, hyphens at line breaks, wide blanks, ligatures and misread letters, corrected by the words of all names."""
    n = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("a"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("b"))
    words = n.select(F.explode(T.word_list(F.lower("p_name"))).alias("word")).distinct()
    d = correction.correct_texts(n.selectExpr("p_partkey", f"{_SPOILT} AS text"), "p_partkey", "text", words)
    return d.withColumn("confidence", F.round("confidence", 6))


_SAID = Rows("id long, text string", [(-1, "it was not there, and no one"), (-2, "thereand"), (-3, "THE-re\u00a0an d"), (-4, "therc  ancl"), (-5, "hypo there hyper and"), (-6, ""), (-7, "tnere, (ard) there. amd then"), (-8, "without there ant"), (-9, "tlnere vvnd thcre cnd")])
_NEGATIONS = "['no', 'not', 'without', 'denies', 'negative', 'absent', 'never']"


@query(f"""WITH RECURSIVE a AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations UNION ALL SELECT * FROM {_SAID.sql}), s AS (SELECT id, regexp_replace(text, '{WIDE}+', ' ', 'g') AS flat FROM a WHERE text <> ''),
l AS (SELECT id, lower(replace(flat, ' ', '')) AS compact, list_transform(regexp_extract_all(flat, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}''-]*'), lambda x: lower(x)) AS words FROM s), p AS (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM l), v AS (SELECT *, unnest(range(1, 9)) AS size FROM p),
win AS (SELECT id, compact, i, size, words[i:i + size - 1] AS own, array_to_string(words[i:i + size - 1], '') AS joined FROM v WHERE i + size - 1 <= len(words)), near AS (SELECT * FROM win WHERE abs(length(joined) - 8) <= 4),
texts AS (SELECT DISTINCT joined, {_SCANNED.format('joined')} AS y FROM near), dp AS (SELECT joined, y, 'thereand' AS x, 0 AS i, list_transform(range(0, length(y) + 1), lambda v: v::DOUBLE) AS r FROM texts UNION ALL SELECT joined, y, x, i + 1, list_transform(range(0, length(y) + 1), lambda v: v + list_min(list_transform(range(0, v + 1), lambda u: (CASE WHEN u = 0 THEN i + 1 ELSE least(r[u + 1] + 1, r[u] + {_alike('substr(x, i + 1, 1)', 'substr(y, u, 1)')}) END) - u))) FROM dp WHERE i < length(x)),
sure AS (SELECT joined, greatest(0, 1 - r[length(y) + 1] / greatest(length(joined), 8)) AS sure FROM dp WHERE i = length(x)), surer AS (SELECT DISTINCT id FROM win WHERE contains(replace(compact, '-', ''), 'thereand') OR joined = 'thereand'),
ok AS (SELECT id, i, size, sure, row_number() OVER (PARTITION BY id ORDER BY sure DESC, size, i) AS n FROM near JOIN sure USING (joined) WHERE sure >= 0.75 AND size <= 6 AND id NOT IN (SELECT id FROM surer) AND NOT list_has_any(own, {_NEGATIONS})),
g AS (SELECT id, n, [{{'i': i, 'size': size, 'sure': sure}}] AS kept FROM ok WHERE n = 1 UNION ALL SELECT ok.id, ok.n, CASE WHEN len(list_filter(g.kept, lambda k: k.i < ok.i + ok.size AND ok.i < k.i + k.size)) > 0 THEN g.kept ELSE list_append(g.kept, {{'i': ok.i, 'size': ok.size, 'sure': ok.sure}}) END FROM g JOIN ok ON ok.id = g.id AND ok.n = g.n + 1),
last AS (SELECT id, unnest(arg_max(kept, n)) AS k FROM g GROUP BY id) SELECT id, round(k.sure, 6) AS confidence, array_to_string(words[k.i:k.i + k.size - 1], '') AS letters FROM last JOIN l USING (id)""", session=True)
def search_nearly(spark, sf_dir):
    """What people said that is nearly 'there and' where nothing surer is found: the surest windows that do not overlap, by their letters."""
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((c("conv_id") * 1000 + c("turn")).alias("id"), "text").unionByName(_SAID.frame(spark))
    hits = search.search_pages(said, "id", "text", "there and").where("stage = 'fuzzy'")
    words = F.regexp_extract_all(c("matched"), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}'-]*"), F.lit(0))
    return hits.select("id", F.round("confidence", 6).alias("confidence"), F.lower(F.array_join(words, "")).alias("letters"))


#: Blocks z of pages of twenty orders, not yet in reading order.
_BLOCKS = """WITH RECURSIVE g AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS s, min(l_returnflag) AS flag FROM lineitem GROUP BY ALL), o AS (SELECT *, l_orderkey // 20 AS page, l_orderkey % 20 AS nth, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n, count(*) OVER (PARTITION BY l_orderkey) AS m FROM g),
i AS (SELECT page, l_orderkey * 10 + n AS ord, CASE WHEN nth % 6 = 0 THEN (n - 1) * 70.0 WHEN n <= 3 THEN (n - 1) * 60.0 ELSE 330.0 + (n - 4) * 60 END AS x1, x1 + CASE WHEN nth % 6 = 0 THEN 60.0 ELSE 50.0 END AS x2, nth * 20.0 + s % 3 AS y1, y1 + 10.0 AS y2, CASE WHEN nth % 6 = 1 AND n = 4 AND m = 4 THEN 'iv' ELSE flag || n END AS text FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y1, ord) AS k, greatest(4, 0.6 * avg(y2 - y1) OVER (PARTITION BY page)) AS tolerance FROM i),
f AS (SELECT page, k, y1 AS top, 0 AS line FROM r WHERE k = 1 UNION ALL SELECT r.page, r.k, CASE WHEN abs(r.y1 - f.top) > tolerance THEN r.y1 ELSE f.top END, f.line + (abs(r.y1 - f.top) > tolerance)::INT FROM f JOIN r ON r.page = f.page AND r.k = f.k + 1),
a AS (SELECT r.*, line FROM r JOIN f ON f.page = r.page AND f.k = r.k), l AS (SELECT page, line, min(y1) AS ly1, max(y2) AS ly2 FROM a GROUP BY ALL), h AS (SELECT page, avg(ly2 - ly1) AS height FROM l GROUP BY page),
t AS (SELECT a.*, height, greatest(16, 1.7 * height) AS gap, max(x2) OVER (PARTITION BY a.page, line ORDER BY x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM a JOIN h USING (page)), u AS (SELECT *, sum(CASE WHEN reach IS NULL OR x1 > reach + gap THEN 1 ELSE 0 END) OVER (PARTITION BY page, line ORDER BY x1 ROWS UNBOUNDED PRECEDING) AS part FROM t),
p AS (SELECT page, line, part, any_value(height) AS height, min(x1) AS x1, max(x2) AS x2, string_agg(text, '' ORDER BY x1) AS alone, string_agg(text, ' ' ORDER BY x1) AS text, list(ord ORDER BY x1) AS ords FROM u GROUP BY ALL), v AS (SELECT *, lag(x2) OVER (PARTITION BY page, line ORDER BY part) AS before, count(*) OVER (PARTITION BY page, line) AS parts FROM p),
voters AS (SELECT page, count(*) AS n FROM v WHERE parts > 1 AND part = 1 GROUP BY page), votes AS (SELECT page, (before + x1) / 2 AS middle, x1 - before AS wide, floor((before + x1) / 2 / greatest(20, 2 * height) + 0.5) AS bucket FROM v WHERE before IS NOT NULL AND NOT (length(alone) <= 5 AND regexp_full_match(alone, '(?i)[ivxlcdm0-9]+'))),
b AS (SELECT votes.page, bucket, count(*) AS n, avg(middle) AS middle, avg(wide) AS wide FROM votes GROUP BY votes.page, bucket), b2 AS (SELECT b.*, row_number() OVER (PARTITION BY b.page ORDER BY wide DESC, bucket) AS rank, first_value(b.n) OVER (PARTITION BY b.page ORDER BY wide DESC, bucket) AS most FROM b JOIN voters USING (page) WHERE b.n >= greatest(3, ceil(voters.n * 0.3))),
gut AS (SELECT page, list(middle ORDER BY middle) AS gutters FROM b2 WHERE rank = 1 OR rank = 2 AND n >= 0.6 * most GROUP BY page), c AS (SELECT u.*, coalesce(gutters, []) AS gutters, len(list_filter(coalesce(gutters, []), lambda g: (x1 + x2) / 2 > g)) AS col FROM u LEFT JOIN gut USING (page)),
cl AS (SELECT page, line, col, any_value(gutters) AS gutters, any_value(height) AS height, min(x1) AS x1, max(x2) AS x2, min(y1) AS y1, max(y2) AS y2, list({'x': x1, 't': text, 'o': ord}) AS texts FROM c WHERE len(gutters) > 0 GROUP BY ALL),
jn AS (SELECT x.page, x.line, x.col AS ca, y.col AS cb FROM cl x JOIN cl y ON x.page = y.page AND x.line = y.line AND y.col = x.col + 1 WHERE y.x1 - x.x2 < greatest(16, 1.7 * x.height) AND abs(x.y1 + x.y2 - y.y1 - y.y2) / 2 <= greatest(4, 0.6 * x.height)),
own AS (SELECT cl.*, coalesce(jn.ca, cl.col) AS home, jn.ca IS NOT NULL AS joined FROM cl LEFT JOIN jn ON jn.page = cl.page AND jn.line = cl.line AND cl.col IN (jn.ca, jn.cb)),
bl AS (SELECT page, any_value(gutters) AS gutters, any_value(height) AS height, min(x1) AS x1, max(x2) AS x2, min(y1) AS y1, max(y2) AS y2, home AS col, bool_or(joined) AS joined, list_sort(flatten(list(texts))) AS texts FROM own GROUP BY page, line, home),
w AS (SELECT page, gutters, x1, x2, y1, y2, CASE WHEN joined OR len(list_filter(gutters, lambda g: x1 < g - greatest(4, 0.5 * height) AND x2 > g + greatest(4, 0.5 * height))) > 0 THEN NULL ELSE col END AS col, array_to_string(list_transform(texts, lambda q: q.t), ' ') AS text, list_transform(texts, lambda q: q.o) AS ords FROM bl
 UNION ALL SELECT p.page, [], p.x1, p.x2, ly1, ly2, 0, p.text, p.ords FROM p JOIN l USING (page, line) WHERE p.page NOT IN (SELECT page FROM gut)),
z AS (SELECT *, sum((col IS NULL)::INT) OVER (PARTITION BY page ORDER BY y1, x1 ROWS UNBOUNDED PRECEDING) AS zone FROM w)"""
_ORDER = "(row_number() OVER (PARTITION BY page ORDER BY zone, coalesce(col, -1), y1, x1) - 1)::INT"


@query(f"""{_BLOCKS}
SELECT page, {_ORDER} AS place, col::INT AS "column", len(gutters) + 1 AS columns, coalesce(gutters[1], 0) AS gutter, x1, x2, y1, y2, text, len(string_split(text, ' ')) AS n_words FROM z""")
def page_layout(t):
    """Orders as lines of pages of twenty: two columns, some lines across both, some with a page number at the right."""
    return layout.page_layout(_order_items(t), ["page"]).select("page", "place", "column", "columns", F.coalesce(F.get("gutters", F.lit(0)), F.lit(0.0)).alias("gutter"), "x1", "x2", "y1", "y2", "text", "n_words")


def _order_items(t):
    g = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.min("l_returnflag").alias("flag"))
    order = Window.partitionBy("l_orderkey")
    o = g.select("*", (c("l_orderkey") % 20).alias("nth"), F.row_number().over(order.orderBy("l_linenumber")).alias("n"), F.count("*").over(order).alias("m"))
    whole = c("nth") % 6 == 0
    x1 = F.when(whole, (c("n") - 1) * 70.0).when(c("n") <= 3, (c("n") - 1) * 60.0).otherwise(330.0 + (c("n") - 4) * 60)
    text = F.when((c("nth") % 6 == 1) & (c("n") == 4) & (c("m") == 4), "iv").otherwise(F.concat("flag", c("n").cast("string")))
    return o.select(F.floor(c("l_orderkey") / 20).alias("page"), x1.alias("x1"), (x1 + F.when(whole, 60.0).otherwise(50.0)).alias("x2"), (c("nth") * 20.0 + c("s") % 3).alias("y1"), (c("nth") * 20.0 + c("s") % 3 + 10).alias("y2"), text.alias("text"), (c("l_orderkey") * 10 + c("n")).alias("ord"))


@query(f"""{_BLOCKS}, q AS (SELECT page, {_ORDER} AS place, x1, x2, y1, y2, text, ords, gutters FROM z), d AS (SELECT page, ord, 1.5 * x1 + 7 AS x1, 1.5 * x2 + 7 AS x2, 1.5 * y1 + 9 AS y1, 1.5 * y2 + 9 AS y2 FROM i WHERE ord % 3 <> 0),
e AS (SELECT page, place, unnest(ords) AS ord FROM q), m AS (SELECT e.page, place, min(x1) AS x1, max(x2) AS x2, min(y1) AS y1, max(y2) AS y2 FROM e JOIN d ON d.page = e.page AND d.ord = e.ord GROUP BY e.page, place)
SELECT q.page, q.place, coalesce(m.x1, q.x1) AS x, coalesce(m.y1, q.y1) AS y, coalesce(m.x2 - m.x1, q.x2 - q.x1) AS width, coalesce(m.y2 - m.y1, q.y2 - q.y1) AS height, array_to_string(ords, ',') AS items, len(string_split(text, ' ')) AS n_words, length(replace(text, ' ', '')) AS n_chars, coalesce(1.5 * gutters[1] + 7, 0) AS gutter
 FROM q LEFT JOIN m ON m.page = q.page AND m.place = q.place""")
def segmented_layout(t):
    """The same pages as they are seen at half as large again, a third of the items out of sight."""
    items = _order_items(t)
    seen = items.where("ord % 3 <> 0").select("page", "ord", *((c(n) * 1.5 + d).alias(n) for n, d in (("x1", 7), ("x2", 7), ("y1", 9), ("y2", 9))))
    d = layout.segmented_layout(items, ["page"], seen, 1.5, 7.0)
    return d.select("page", "place", "x", "y", "width", "height", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), "n_words", "n_chars", F.coalesce(F.get("gutters", F.lit(0)), F.lit(0.0)).alias("gutter"))


@query("""WITH RECURSIVE i AS (SELECT l_orderkey AS k, (l_partkey % 400)::DOUBLE AS x, l_quantity AS y, 30.0 AS w, 8.0 + 4 * (l_linenumber % 3) AS h FROM lineitem), r AS (SELECT *, y + h / 2 AS c, row_number() OVER (PARTITION BY k ORDER BY y, x, h) AS n FROM i),
f AS (SELECT k, n, [{'c': c, 'h': h, 'x1': x, 'x2': x + w, 'y1': y, 'y2': y + h, 'n': 1}] AS ls FROM r WHERE n = 1 UNION ALL SELECT k, n, CASE WHEN p IS NULL THEN list_append(ls, {'c': c, 'h': h, 'x1': x, 'x2': x + w, 'y1': y, 'y2': y + h, 'n': 1})
 ELSE list_transform(ls, lambda l, j: CASE WHEN j = p THEN {'c': l.c, 'h': l.h, 'x1': least(l.x1, x), 'x2': greatest(l.x2, x + w), 'y1': least(l.y1, y), 'y2': greatest(l.y2, y + h), 'n': l.n + 1} ELSE l END) END
 FROM (SELECT r.*, ls, nullif(list_position(list_transform(ls, lambda l: abs(l.c - r.c) < greatest(r.h, l.h) * 0.5), TRUE), 0) AS p FROM f JOIN r ON r.k = f.k AND r.n = f.n + 1)),
l AS (SELECT k, arg_max(ls, n) AS ls FROM f GROUP BY k), u AS (SELECT k, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS line FROM l) SELECT k, line, l.x1 AS x1, l.x2 AS x2, l.y1 AS y1, l.y2 AS y2, l.n AS n FROM u""")
def centre_lines(t):
    d = t("lineitem").select(c("l_orderkey").alias("k"), (c("l_partkey") % 400).alias("x"), c("l_quantity").alias("y"), F.lit(30.0).alias("w"), (c("l_linenumber") % 3 * 4 + 8).alias("h"))
    return documents.centre_lines(d, ["k"])


@query("""WITH n AS (SELECT conv_id, CASE WHEN turn % 5 = 3 THEN NULL WHEN role = 'user' OR conv_id % 3 > 0 THEN 'DIV' ELSE 'UL' END AS tag, CASE WHEN turn % 7 = 2 THEN 'draft_page_break_marker' ELSE 'x' END AS class, CASE WHEN conv_id % 5 = 0 THEN text ELSE chr(10) || ' ' END AS text, conv_id % 4 = 1 AND turn = 1 AS nested FROM conversations)
SELECT conv_id, bool_and(CASE WHEN tag IS NULL THEN trim(replace(text, chr(10), ' ')) = '' ELSE class <> 'x' OR tag = 'DIV' AND NOT nested END) AS legacy FROM n GROUP BY conv_id UNION ALL SELECT -1, FALSE""", session=True)
def legacy_drafts(spark, sf_dir):
    """Drafts whose top nodes are made of the turns of a conversation, and one without any."""
    tag = F.when(c("turn") % 5 == 3, F.lit(None)).when((c("role") == "user") | (c("conv_id") % 3 > 0), "DIV").otherwise("UL")
    kind = F.array(F.when(c("turn") % 7 == 2, "draft_page_break_marker").otherwise("x"))
    node = F.struct(tag.alias("tag"), kind.alias("classes"), F.when(c("conv_id") % 5 == 0, c("text")).otherwise("\n ").alias("text"), ((c("conv_id") % 4 == 1) & (c("turn") == 1)).alias("nested"))
    d = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.collect_list(node).alias("nodes"))
    none = spark.createDataFrame([(-1, [])], d.schema)
    return d.unionByName(none).select("conv_id", nested.legacy_extraction(c("nodes")).alias("legacy"))


@query(f"""WITH t AS (SELECT doc_id, lower(replace(text, '\u0130', 'i\u0307')) AS low FROM {ALL_TEXTS}) SELECT doc_id, {trim_sql(f"regexp_replace(regexp_replace(low, '[.,;:]+\\z', ''), '{WIDE}+', ' ', 'g')")} AS key FROM t""", session=True)
def selection_keys(spark, sf_dir):
    """The keys of selected texts: final punctuation goes before white space is tidied."""
    return texts(spark, sf_dir).select("doc_id", T.selection_key(c("text")).alias("key"))
