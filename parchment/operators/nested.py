"""Nested values: extractions as maps and rows, tags by unit, study plans, messages, media lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Cards in the order in which they are written, and one name for another.
CARDS = ("entities", "traces", "phenomena", "concept", "models")
CARD_ALIAS = {"objects": "entities"}


def card_name(card: Column) -> Column:
    for old, new in CARD_ALIAS.items():
        card = F.when(card == old, new).otherwise(card)
    return card


def inflated(nouns: DataFrame, keys: Sequence[str], modes: Sequence[str]) -> DataFrame:
    """Rows (num, noun, card, mode, reason, status, ord) to one map card -> mode -> list of items per key. Unknown cards and modes go; no reason is
    empty, no status `pending`; lists keep the order of `ord`."""
    rows = nouns.withColumn("card", card_name(F.col("card"))).where(F.col("card").isin(*CARDS) & F.col("mode").isin(*modes))
    item = F.struct("ord", "num", "noun", F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("status", F.lit("pending")).alias("status"))
    lists = rows.groupBy(*keys, "card", "mode").agg(F.transform(F.sort_array(F.collect_list(item)), lambda i: i.dropFields("ord")).alias("items"))
    by_card = lists.groupBy(*keys, "card").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("mode", "items")))).alias("modes"))
    return by_card.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("card", "modes"))).alias("data"))


def deflated(extractions: DataFrame, keys: Sequence[str], modes: Sequence[str], data: str = "data") -> DataFrame:
    """The way back: rows card, mode, at (from 0), and the item's fields, with `place`, their number in the fixed order of cards and modes."""
    cards = extractions.select(*keys, F.explode(data).alias("card", "_modes"))
    rows = cards.select(*keys, "card", F.explode("_modes").alias("mode", "_items")).select(*keys, "card", "mode", F.posexplode("_items").alias("at", "_i")).select(*keys, "card", "mode", "at", "_i.*")
    order = [F.array_position(F.array(*map(F.lit, names)), F.col(c)) for c, names in (("card", CARDS), ("mode", modes))]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "at")))


def tag_rows(sources: DataFrame, keys: Sequence[str], tags: str) -> DataFrame:
    """A map unit -> texts to rows: unit, text, and an id of unit and running number (from 0, units in alphabetical order)."""
    rows = sources.select(*keys, F.explode(tags).alias("unit", "_t")).select(*keys, "unit", F.posexplode("_t").alias("at", "text"))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("unit", "at")) - 1
    return rows.select(*keys, F.concat_ws("-", "unit", n).alias("id"), "unit", "text")


def ragged(tags: DataFrame, keys: Sequence[str], unit: str, text: str, units: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One column per unit, the texts of each below each other: row (from 0) and, for each unit, its text there and the unit's count n_<unit>."""
    w = Window.partitionBy(*keys, unit)
    rows = tags.where(F.col(unit).isin(*units)).withColumn("row", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    texts = [F.max(F.when(F.col(unit) == u, F.col(text))).alias(u) for u in units]
    counts = [F.coalesce(F.max(f"_n_{u}"), F.lit(0)).alias(f"_c_{u}") for u in units]
    marked = rows.withColumns({f"_n_{u}": F.when(F.col(unit) == u, F.col("_n")) for u in units})
    cells = marked.groupBy(*keys, "row").agg(*texts, *counts)
    everywhere = Window.partitionBy(*keys)
    return cells.select(*keys, "row", *units, *(F.max(f"_c_{u}").over(everywhere).alias(f"n_{u}") for u in units))


def toggled(values: Column, one: Column) -> Column:
    """An array without an element it has, else with it at the end."""
    return F.when(F.array_contains(values, one), F.filter(values, lambda v: v != one)).otherwise(F.concat(values, F.array(one)))


def page_toggled(sources: Column, source: Column, span: Column, page: Column) -> Column:
    """Sources (id, spans(id, from_page, to_page, completed)) with a page of one span marked as done, or no more."""
    changed = lambda s: s.withField("completed", F.when(s["id"] == span, toggled(s["completed"], page)).otherwise(s["completed"]))
    return F.transform(sources, lambda s: F.when(s["id"] == source, s.withField("spans", F.transform(s["spans"], changed))).otherwise(s))


def span_progress(span: Column) -> Column:
    """struct(done, total) of a span of pages (from_page, to_page, completed)."""
    total = F.greatest(F.lit(0), span["to_page"] - span["from_page"] + 1)
    done = F.size(F.filter(F.coalesce(span["completed"], F.array().cast("array<int>")), lambda p: p.between(span["from_page"], span["to_page"])))
    return F.struct(done.alias("done"), total.alias("total"))


def last_changed(messages: Column, change) -> Column:
    """Messages (role, content) with `change` applied to the content of the last one; none stay none."""
    n = F.size(messages)
    return F.transform(messages, lambda m, i: F.when(i == n - 1, m.withField("content", change(m["content"]))).otherwise(m))


def moved(items: Column, key: str, value: Column, up: bool) -> Column:
    """An array with the first element of this key one place up or down; as it is at the end, or without such an element."""
    at = F.array_position(F.transform(items, lambda x: x[key]), value).cast("int") - 1
    to = at - 1 if up else at + 1
    swapped = F.transform(items, lambda x, i: F.when(i == at, F.get(items, to)).when(i == to, F.get(items, at)).otherwise(x))
    return F.when((at < 0) | (to < 0) | (to >= F.size(items)), items).otherwise(swapped)


def preview_media(post: Column) -> Column:
    """The first of a post's media that is not empty: of its assets, its own url, the list of urls, the urls as text; else empty."""
    some = lambda x: F.nullif(x, F.lit(""))
    lines = F.filter(F.transform(F.split(F.coalesce(post["media_text"], F.lit("")), "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(some(F.get(post["assets"], F.lit(0))["url"]), some(post["media_url"]), some(F.get(post["media_urls"], F.lit(0))), F.get(lines, F.lit(0)), F.lit(""))


def filled(pairs: Column) -> Column:
    """Pairs (name, value) whose value is not null or empty."""
    return F.filter(pairs, lambda p: F.coalesce(p["value"], F.lit("")) != "")


def number_deltas(values: Column, names: Sequence[str]) -> Column:
    """Of a map of texts those entries of a fixed list that are numbers: name, value, shown (with its sign), rises."""
    entries = F.array(*(F.struct(F.lit(n).alias("name"), F.try_element_at(values, F.lit(n)).try_cast("double").alias("value")) for n in names))
    kept = F.filter(entries, lambda e: e["value"].isNotNull())
    return F.transform(kept, lambda e: F.struct(e["name"].alias("name"), e["value"].alias("value"), (e["value"] >= 0).alias("rises")))


def wrong_options(options: Column, right: Column, reasons: Column, default: str = "Reason not provided.") -> Column:
    """Ids of the options that are not right, with the reason given for each, trimmed."""
    reason = lambda o: F.coalesce(F.nullif(F.trim(F.coalesce(F.try_element_at(reasons, o), F.lit(""))), F.lit("")), F.lit(default))
    return F.transform(F.filter(options, lambda o: o != right), lambda o: F.struct(o.alias("option"), reason(o).alias("reason")))


def payload(body: Column, schema: str, error: str = "error") -> Column:
    """A JSON object; what is no JSON goes into its field `error`; nothing gives an object without fields."""
    return F.when(F.coalesce(body, F.lit("")) == "", F.from_json(F.lit("{}"), schema)).when(F.try_parse_json(body).isNotNull(), F.from_json(body, schema)).otherwise(F.from_json(F.to_json(F.struct(body.alias(error))), schema))


def error_text(body: Column, fallback: str) -> Column:
    """What a JSON answer says of an error: `error` itself or its message, else the fallback; then the details, if it has a list of them."""
    v = F.try_parse_json(body)
    own = F.try_variant_get(v, "$.error.message", "string")
    plain = F.when(F.schema_of_variant(F.try_variant_get(v, "$.error", "variant")) == "STRING", F.try_variant_get(v, "$.error", "string"))
    base = F.coalesce(plain, F.nullif(own, F.lit("")), F.lit(fallback))
    details = F.from_json(F.get_json_object(body, "$.details"), "array<string>")
    return F.when(F.size(F.coalesce(details, F.array().cast("array<string>"))) > 0, F.concat(base, F.lit(" "), F.array_join(details, "; "))).otherwise(base)


def numbers_of(body: Column, names: Sequence[str]) -> Column:
    """A struct of numbers from JSON, null unless every one is a number (not text, not null)."""
    v = F.try_parse_json(body)
    number = lambda n: F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)")
    every = number(names[0])
    for n in names[1:]:
        every = every & number(n)
    return F.when(F.coalesce(every, F.lit(False)), F.struct(*(F.try_variant_get(v, f"$.{n}", "double").alias(n) for n in names)))


def body_summary(symptom: Column, marks: Column) -> Column:
    """Marks (region, distribution, intensity) of a body map as a sentence."""
    head = F.when(F.coalesce(symptom, F.lit("")) != "", F.concat(F.lit("Body map saved for "), symptom, F.lit("."))).otherwise("Body map saved.")
    each = F.transform(marks, lambda m, i: F.concat((i + 1).cast("string"), F.lit(". "), m["region"], F.lit(" ("), m["distribution"], F.lit(", intensity "), m["intensity"].cast("string"), F.lit("/10)")))
    return F.when(F.coalesce(F.size(marks), F.lit(0)) > 0, F.concat(head, F.lit(" Marked regions: "), F.array_join(each, " "))).otherwise(head)


#: The lines in which an entity is written, by its type: label, field, what stands for nothing (None: the source text; "": as it is).
ENTITY_HEAD, ENTITY_TYPE = "AMCTOSHS Sub-Entity:", "1. Entity Type: "
ENTITY_LINES = {
    "schema": (("2. Entity Schema: ", "name", "Untitled Schema"), ("3. AMCTOSHS Sub-Entity schema Domain: ", "domain", ""), ("4. Ontic Object Text: ", "source_text", "")),
    "trace": (("2. Entity Schema Trace: ", "name", "Untitled Trace"), ("3. Nested Inside Entity Schema: ", "parent_schema", "Not specified"), ("4. Trace Source Text: ", "source_text", "")),
    "trace_value": (("2. Entity Schema Trace: ", "trace_name", "Not specified"), ("3. Entity Schema Trace Value: ", "value", None), ("4. Unit: ", "unit", "")),
    "instance": (("2. Entity Schema Instance: ", "name", "Untitled Instance"), ("3. Entity Schema Name: ", "parent_schema", "Not specified"), ("4. Entity Schema Trace Name: ", "trace_name", "Not specified"), ("5. Entity Schema Trace Value Entry: ", "value", "Not specified")),
    "intervener": (("2. Entity Intervener: ", "name", "Untitled Intervener"), ("3. Target Entity Schema Trace Value: ", "trace_name", "Not specified"), ("4. Change: ", "value", None), ("5. Unit: ", "unit", "Not specified")),
}


def entity_text(type: Column, type_label: Column, fields) -> Column:
    """An entity as numbered lines; unknown types have only the first. fields: a function from names to columns."""
    plain = lambda name: F.coalesce(fields(name), F.lit(""))

    def line(label: str, name: str, default: str | None) -> Column:
        stands = plain("source_text") if default is None else F.lit(default)
        return F.concat(F.lit(f"\n{label}"), F.coalesce(F.nullif(fields(name), F.lit("")), stands))

    body: Column = F.lit("")
    for kind, lines in ENTITY_LINES.items():
        body = F.when(type == kind, F.concat(*(line(*x) for x in lines))).otherwise(body)
    return F.concat(F.lit(f"{ENTITY_HEAD}\n{ENTITY_TYPE}"), F.coalesce(type_label, F.lit("")), body)


def loudness(samples: Column) -> Column:
    """How open a mouth is for a block of samples (0 to 255): four times their root mean square, 1 at most."""
    square = F.aggregate(samples, F.lit(0.0), lambda s, x: s + F.pow((x - 128) / 128, F.lit(2)))
    return F.least(F.lit(1.0), 4 * F.sqrt(square / F.size(samples)))


#: The class of a mark between pages, and the tag of a line in texts extracted the old way.
PAGE_MARK, LINE_TAG = "draft_page_break_marker", "DIV"


def legacy_extraction(nodes: Column) -> Column:
    """Whether the top nodes of a draft (array of struct: tag, null for text; classes array<string>; text; nested, whether it holds lists, tables, quotes or headings) are those of a text
    extracted the old way: there are some, and each is blank text, a mark between pages or a plain line."""
    blank = lambda n: F.trim(F.translate(F.coalesce(n["text"], F.lit("")), "\t\r\n\u00a0", "    ")) == ""
    mark = lambda n: F.coalesce(F.array_contains(n["classes"], PAGE_MARK), F.lit(False))
    plain = lambda n: (n["tag"] == LINE_TAG) & ~F.coalesce(n["nested"], F.lit(False))
    return F.coalesce((F.size(nodes) > 0) & F.forall(nodes, lambda n: F.when(n["tag"].isNull(), blank(n)).otherwise(mark(n) | plain(n))), F.lit(False))
