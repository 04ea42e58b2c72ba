import math

import numpy as np
from pyspark.sql import functions as F

from parchment.functions import text as T
from parchment.operators import documents as D
from parchment.operators import layout as L
from parchment.operators import strokes as S
from parchment.operators import trees

SCHEMA = "page long, x1 double, x2 double, y1 double, y2 double, text string, ord long"


def two_columns(page, rows, extra=()):
    out = []
    for k, (a, b) in enumerate(rows):
        y = 100.0 + 20 * k
        out += [(page, 50.0, 50.0 + 6 * len(a), y, y + 10, a), (page, 320.0, 320.0 + 6 * len(b), y, y + 10, b)]
    return [(*r, n) for n, r in enumerate([*out, *extra])]


def texts(spark, items):
    got = {}
    for r in L.page_layout(spark.createDataFrame(items, SCHEMA), ["page"]).orderBy("page", "place").collect():
        got.setdefault(r.page, []).append((r.text, r.column, r.columns))
    return got


def test_columns_titles_and_page_numbers(spark):
    rows = [(f"left column row {k} words words here", f"right row {k}") for k in range(6)]
    left, right = [a for a, _ in rows], [b for _, b in rows]
    title = (1, 40.0, 500.0, 60.0, 70.0, "A title over both")
    middle = (2, 40.0, 500.0, 161.0, 169.0, "A heading")
    got = texts(spark, two_columns(0, rows) + two_columns(1, rows, [title]) + two_columns(2, [r for k, r in enumerate(rows) if k != 3], [])
                + [(3, 50.0, 300.0, 100.0 + 20 * k, 110.0 + 20 * k, f"line {k}", k) for k in range(4)] + [(5, None, 1.0, 1.0, 1.0, "lost", 0)]
                + [(4, 50.0, 200.0, 100.0 + 20 * k, 110.0 + 20 * k, f"entry {k}", k) for k in range(5)] + [(4, 400.0, 412.0, 100.0 + 20 * k, 110.0 + 20 * k, str(k), 9 + k) for k in range(5)])
    assert [t for t, _, _ in got[0]] == left + right and {n for _, _, n in got[0]} == {2}
    assert got[1][0] == ("A title over both", None, 2) and [t for t, _, _ in got[1][1:]] == left + right
    assert [t for t, _, _ in got[3]] == [f"line {k}" for k in range(4)] and got[3][0][2] == 1
    assert [t for t, _, _ in got[4]] == [x for k in range(5) for x in (f"entry {k}", str(k))] and got[4][0][2] == 1  # numbers make no column
    assert 5 not in got
    heading = texts(spark, [r for r in two_columns(2, rows) if r[3] != 160] + [(*middle, 99)])[2]
    assert [t for t, _, _ in heading] == left[:3] + right[:3] + ["A heading"] + left[4:] + right[4:]
    page = L.page_texts(spark.createDataFrame(two_columns(0, rows), SCHEMA), ["page"]).first().text
    assert page.split("\n") == left + right
    assert L.page_layout(spark.createDataFrame([], SCHEMA), ["page"]).collect() == []


def test_list_tree(spark):
    rows = [("L", "list", ["a", "x", "b", "gone"]), ("a", "list_item", ["p", "M", "N"]), ("b", "list_item", None), ("x", "paragraph", []), ("p", "paragraph", None), ("M", "list", ["c", "d"]), ("c", "list_item", []), ("d", "list_item", ["M"]), ("N", "list", ["e"]), ("e", "list_item", [])]
    got = {(r.root, r.item_id): r.place for r in D.list_tree(spark.createDataFrame(rows, "id string, kind string, child_ids array<string>")).collect()}
    assert got == {("L", "a"): [0], ("L", "b"): [1], ("L", "c"): [0, 0], ("L", "d"): [0, 1], ("N", "e"): [0]}


def test_strokes(spark):
    line = np.array([[k * 0.1, 0, k, 0.5] for k in range(101)], float)
    assert len(S.thinned(line, 0.25)) == 34 and S.thinned(line[:1], 1).tolist() == line[:1].tolist()
    even = S.spaced(line, 1.0)
    assert np.allclose(even[:, 0], np.arange(11)) and np.allclose(even[:, 2], np.arange(11) * 10)
    assert np.allclose(S.spaced(np.array([[0, 0, 0, 0.5], [0, 0, 5, 0.5], [2.5, 0, 9, 0.5]]), 1)[:, 0], [0, 1, 2, 2.5])
    arc = np.array([[math.cos(a), math.sin(a), a, 0.5] for a in np.linspace(0, 3, 12)])
    curve = S.smoothed(arc, 0.5, 1)
    assert np.abs(np.hypot(*curve[:, :2].T) - 1).max() < 0.02 and np.allclose(curve[-1], arc[-1])
    soft = S.pressures(arc * [1, 1, 1000, 1], "ball", 0, 1)
    assert soft[0] < soft[5] and soft.min() >= 0.08
    felt = np.array([[k, 0, k, v] for k, v in enumerate((0.2, 0.6, 0.9))], float)
    by_hand = [0.2 + (0.5 - 0.2) * 0.35, 0.6 + (0.68 - 0.6) * 0.35, 0.9 + (0.5 - 0.9) * 0.35]
    assert np.allclose(S.pressures(felt, "ball", 100, 1), [by_hand[0] * 0.92, by_hand[1], by_hand[2] * 0.92])
    made = S.pressures(np.array([[0, 0, 0, 0.5], [3, 4, 10, 0.5], [6, 8, 20, 0.5]]), "fountain", 50, 2)
    assert np.allclose(made, np.clip([0.7 + 0.08 + 0.18 * r - 0.5 * 2 * (0.34 + 0.08) for r in (0, 1, 0)], 0.08, 0.94))
    df = spark.createDataFrame([(1, [(float(k), 0.0, float(k), None) for k in range(5)]), (2, [(1.0, None, None, None)]), (3, None), (4, [])], "id long, p array<struct<x:double,y:double,t:double,pressure:double>>")
    got = {r.id: r.q for r in df.select("id", S.finish_strokes(F.col("p")).alias("q")).collect()}
    assert got[1][0].x == 0 and abs(got[1][-1].x - 4) < 0.24 and {p.pressure for p in got[1]} == {0.5}
    assert len(got[2]) == 1 and got[3] is None and got[4] == []


def test_velocity(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.0), (1, 50, 1, 5.0), (1, 100, 2, 20.0), (1, 300, 3, 0.0)], "k long, t long, o long, x double")
    assert [r.vx for r in S.velocity(df, ["k"], "t", "o", "x", "x").orderBy("t").collect()] == [0, 0.1, 0.3, 0]


def test_texts(spark):
    show = lambda f, *xs: [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k long, s string").orderBy("k").select(f(F.col("s"))).collect()]
    assert show(T.dictation_key, "Um, the  Heart-rate, uh mmm rises!", None) == ["the heart rate rises", None]
    assert show(T.needs_correction, "uh", "all is well", "a b c d", "", None) == [True, False, True, False, False]
    assert show(T.plain_markdown, "# T\n- **a** and `b`\n1. [c](d)\n> _e_\n---\n```\nf\n```") == ["T\na and b\nc\ne\n\nf"]
    assert show(T.spoken_markdown, "## T\n- *a* `b`\n```x```") == ["T a b , code block,"]
    assert show(T.structured_text, "<p>a&nbsp; b</p><div>c<br/>d</div>") == ["a b\n c\nd"]
    assert show(T.sentence_units, "<p>One. Two!</p>\n\n<p>three</p>") == [["One.", "Two!", "three"]]
    assert show(T.selected, "......\n------ Title\n\n\n\nx   y", "a....b") == ["Title\n\nx y", "a....b"]
    assert show(T.video_id, "https://a/watch?t=1&v=abc#x", "https://youtu.be/ABCDEFGHIJK", "youtu.be/ABCDEFGHIJK", None) == ["abc", "ABCDEFGHIJK", None, None]
    assert show(lambda s: T.short_number(s.cast("long")), "0", "999", "1500", None) == ["", "999 views", "1.5K views", ""]
    said = spark.range(1).select(*(T.replaces_phrase(F.lit(a), F.lit(b)) for a, b in (("a b c d e", "a b c d e f"), ("a b c d", "a b c d"), ("a b c d e", "a b c x y"), ("a b c d e f g h i", "a b c d e")))).first()
    assert list(said) == [True, False, False, False]


def test_marks_double_their_steps(spark):
    chain = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    more = spark.createDataFrame([(5, 9000), (9000, 9001), (9001, 9000), (9002, None), (None, 4), (7, 7)], "a long, b long")
    seeds = spark.createDataFrame([(2,), (9001,), (None,), (2,), (-1,)], "node long")
    got = sorted(r.node for r in trees.reached(seeds, chain.unionByName(more), "a", "b").collect())
    assert got == [-1, *range(2, 3001), 9000, 9001]
    assert trees.reached(seeds.limit(0), chain, "a", "b").count() == 0


def test_deeply_nested_lists(spark):
    rows = [(f"l{k}", "list", [f"x{k}", f"i{k}"]) for k in range(200)] + [(f"i{k}", "list_item", [f"l{k + 1}"]) for k in range(200)] + [(f"x{k}", "list_item", []) for k in range(200)]
    got = {r.item_id: (r.root, r.place) for r in D.list_tree(spark.createDataFrame(rows, "id string, kind string, child_ids array<string>")).collect()}
    assert len(got) == 400 and all(got[f"i{k}"] == ("l0", [1] * (k + 1)) and got[f"x{k}"] == ("l0", [1] * k + [0]) for k in range(200))
