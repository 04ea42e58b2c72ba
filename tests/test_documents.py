import pytest
from pyspark.sql import functions as F

from parchment.functions import geometry as G
from parchment.operators import documents as D
from parchment.plans import documents, reference  # noqa: F401 - both register their queries
from parchment.streaming import events


def brute_lines(items):
    """Items (ord, y1, y2, x1, text) of one page."""
    height = sum(i[2] - i[1] for i in items) / len(items)
    tolerance, lines = max(4, 0.6 * height), []
    for it in sorted(items, key=lambda i: (i[1], i[0])):
        if not lines or abs(it[1] - lines[-1][0][1]) > tolerance:
            lines.append([])
        lines[-1].append(it)
    return [" ".join(i[4] for i in sorted(line, key=lambda i: (i[3], i[1], i[0]))) for line in lines]


def test_page_lines(spark):
    rows = [(p, n, float(n * 3 % 17 * 2), float(n * 3 % 17 * 2 + 8), float(n * 7 % 5), f"w{n}") for p in range(3) for n in range(20 + p)]
    df = spark.createDataFrame(rows, "page long, ord long, y1 double, y2 double, x1 double, text string").withColumn("x2", F.col("x1") + 1)
    got = {}
    for r in D.page_lines(df, ["page"]).orderBy("page", "line").collect():
        got.setdefault(r.page, []).append(r.text)
    assert got == {p: brute_lines([r[1:] for r in rows if r[0] == p]) for p in range(3)}
    assert D.page_lines(df.limit(0), ["page"]).collect() == []


def test_entity_series_first_wins(spark):
    log = spark.createDataFrame([
        ("s1", "schema", "Heart", "Organs", None, None, None, 1, 1), ("s2", "schema", "heart", "Other", None, None, None, 2, 2), ("t1", "trace", "Rate", None, "HEART", None, None, 3, 3), ("t2", "trace", "rate", None, "Lung", None, None, 4, 4),
        ("v1", "trace_value", None, None, None, "RATE", "70", 9, 5), ("v2", "trace_value", None, None, None, "rate", "72", 8, 6), ("v3", "instance", None, None, "nowhere", "odd", "1", 7, 7), ("v4", "instance", None, None, None, None, "1", 7, 8),
    ], "id string, type string, name string, domain string, parent_schema string, trace_name string, value string, created_at long, ord long").withColumn("unit", F.lit(None).cast("string"))
    got = {r.id: (r.domain, r.schema, r.place) for r in D.entity_series(log).collect()}
    assert got == {"v1": ("Organs", "Heart", 2), "v2": ("Organs", "Heart", 1), "v3": (None, None, 1)}


def test_geometry(spark):
    row = spark.range(1).select(
        G.half_up(F.lit(-2.5)).alias("h"), G.segment_distance(*map(F.lit, (3.0, 4.0, 0.0, 0.0, 0.0, 0.0))).alias("d"), G.affine(F.array(*map(F.lit, (2.0, 0.0, 0.0, 3.0, 1.0, 1.0))), F.lit(1.0), F.lit(2.0)).alias("p"),
        G.affine_product(F.array(*map(F.lit, (2.0, 0.0, 0.0, 3.0, 1.0, 1.0))), F.array(*map(F.lit, (1.0, 0.0, 0.0, 1.0, 5.0, 6.0)))).alias("m"), *(G.number_setting(F.lit(x), 0, 10, 5).alias(n) for n, x in (("a", "12"), ("b", "x"), ("e", "nan")))).first()
    assert row.h == -2 and row.d == 5 and tuple(row.p) == (3, 7) and row.m == [2, 0, 0, 3, 11, 19] and (row.a, row.b, row.e) == (10, 5, 5)


def test_server_events(spark):
    lines = spark.createDataFrame([("data: {\"noun\": \"a\"}",), ("data: [DONE]",), ("data: {bad",), (": ping",), ("",), (None,)], "line string")
    assert [r.event.noun for r in events.data_events(lines, "line", "noun string").collect()] == ["a"]
    got = lines.select(events.message(F.col("line"), "end").alias("m")).collect()
    assert got[1].m.text == "data: [DONE]"


@pytest.mark.parametrize("name", ["search_hits", "text_correction", "page_lines", "pen_strokes", "page_layout"])
def test_runs(spark, sf, name):
    assert reference.queries()[name](spark, sf).count() > 0
