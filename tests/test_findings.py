"""Cases of a review: boundaries, keys and texts that larger tables hold."""

from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parchment.functions import text as T
from parchment.llm import op04_packing, op05_toxicity, op06_token_counts
from parchment.llm.shared import PORTION, Memo, portions
from parchment.operators import boxes as B
from parchment.operators import page_index as P
from parchment.operators import relational as R
from parchment.operators import strokes as S
from parchment.plans import documents, reference, shapes, texts  # noqa: F401 - register their queries
from parchment.sources import tables


def test_corrections_of_one_key_count_once(spark):
    log = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id long, v string")
    changes = spark.createDataFrame([(1, "x", False), (1, "x", False)], "id long, v string, gone boolean")
    assert sorted(map(tuple, tables.corrected(log, changes, "id", "gone").collect())) == [(1, "x"), (1, "x"), (2, "c")]


def test_points_just_at_the_radius_as_sql_has_them(spark):
    points = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((140.0, 428.0), (400.0, 118.0), (40.0, 268.0))))
    left, = spark.range(1).select(F.size(B.untouched_points(points, F.lit(250.0), F.lit(200.0), F.lit(40.0) * B.PRECISE))).first()
    assert left == 3


def test_long_runs_of_short_words_need_correction(spark):
    rows = spark.range(3).select(F.element_at(F.array(F.repeat(F.lit("ab c "), 20_000), F.lit("one ab c de end"), F.lit("x ab c de")), (F.col("id") + 1).cast("int")).alias("t"))
    assert [r[0] for r in rows.select(T.needs_correction(F.col("t"))).collect()] == [True, False, True]


def test_batches_are_worked_on_in_bounded_portions():
    batch = pa.RecordBatch.from_pydict({"k": list(range(6))})
    parts = [p.column(0).to_pylist() for p in P.slices(batch, np.array([3, 3, 9, 1, 1, 6]), 6)]
    assert parts == [[0, 1], [2], [3, 4], [5]]


def test_ranges_of_texts_in_one_pass(spark):
    pages = spark.createDataFrame([(1, "a ​ b\n\n-\ncar-\nd eﬀ"), (2, None), (3, "\n"), (4, "x")], "k long, text string")

    def each(sizes):
        doc = np.repeat(np.arange(len(sizes)), sizes)
        a = np.arange(sizes.sum()) - (np.cumsum(sizes) - sizes)[doc]
        return sizes, a, np.minimum(a + 3, sizes[doc])

    got = {(r.k, r.form, r.given.start): (r.found, r["items"]) for r in P.located(pages, "text", each).collect()}
    maps = P.with_maps(pages, "text").withColumn("lines", P.line_items(F.coalesce("text", F.lit(""))))
    for form, text, way in (("normal", "normalized", ["normal_map"]), ("compact", "compact", ["compact_map", "normal_map"])):
        n = F.length(text)
        given = F.transform(F.filter(F.sequence(F.lit(0), n), lambda a: a < n), lambda a: F.struct(a.alias("start"), F.least(a + 3, n).alias("end")))
        rows = P.with_items(P.mapped(maps.withColumn("given", given), "given", way, "found"), "found", "lines", "i").collect()
        want = {(r.k, form, g.start): (f, i) for r in rows for g, f, i in zip(r.given, r.found, r.i)}
        assert want == {k: v for k, v in got.items() if k[1] == form} and want


def test_points_meet_the_topmost_stroke_once_a_square(spark):
    """Many points that one long stroke hits, and strokes below it: segments are shuffled by wide squares, and only points without a hit go on."""
    line = lambda x1, y1, x2, y2: [(x1, y1), (x2, y2)]
    strokes = spark.createDataFrame([(1, 10, 1, line(0.0, 5.0, 900.0, 5.0)), (1, 11, 2, line(0.0, 8.0, 400.0, 8.0)), (1, 12, None, line(0.0, 5.0, 9.0, 5.0)), (None, 13, 9, line(0.0, 5.0, 9.0, 5.0)), (1, 14, 7, [(1.0, 5.0)])], "k long, id long, z long, p array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 1, 3.0, 5.0), (1, 2, 700.0, 5.5), (1, 3, 100.0, 40.0), (2, 4, 3.0, 5.0), (None, 5, 3.0, 5.0), (1, 6, None, 5.0), (1, 7, 403.0, 8.0)], "k long, point_id long, x double, y double")
    got = B.topmost_stroke(points, strokes, ["k"], ["x", "y"], "p", "z", "id", F.lit(3.0), 32.0)
    assert {r.point_id: r.hit for r in got.collect()} == {1: 11, 2: 10, 3: None, 4: None, 5: None, 6: None, 7: 11}
    x = np.arange(2000.0)
    assert B.first_near(x, x * 0, *(np.array([v, v]) for v in (0.0, 0.0, 999.0, 0.0, 1.0))).tolist() == [0] * 1001 + [-1] * 999
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_grid_and_partitions_of_large_tables(spark, sf):
    cells = spark.createDataFrame([(1, 0, 0, 2, 2, 1), (1, 1, 1, 1, 1, 2), (1, 1, 1, 1, 1, 2)], "k long, row int, col int, row_span int, col_span int, ord int")
    grid = R.grid(cells, ["k"])
    assert sorted(map(tuple, grid.collect())) == [(1, 0, 0, 1, True), (1, 0, 1, 1, False), (1, 1, 0, 1, False), (1, 1, 1, 2, True)]
    assert "SortAggregate" not in grid._jdf.queryExecution().executedPlan().toString()
    read = spark.read.parquet(f"{sf}/lineitem.parquet")
    assert R.spread(read, "l_orderkey").rdd.getNumPartitions() == max(8, 8 * read.rdd.getNumPartitions())


def test_boxes_of_items_on_two_lines(spark, tmp_path):
    rows = [(1, 1, 12, 5.0, 0.5, "N"), (1, 2, 2, 9.0, 0.5, "A"), (1, 2, 2, 7.0, 0.5, "R"), (1, 3, None, 1.0, 0.1, "N"), (None, 1, 1, 1.0, 0.1, "N")]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_tax double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.k, r.line): (r.x, r.width, r.n_items) for r in reference.queries()["display_boxes"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0): (5.0, 2.5, 1), (1, 2): (5.0, 2.5, 1), (1, None): (None, None, 0), (None, 1): (None, None, 1)}


def test_markdown_is_cleared_once_for_a_draft(spark, sf):
    plan = reference.queries()["draft_html"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert all(line.count("```\\s*(") <= 1 for line in plan.splitlines())


def test_texts_become_objects_in_bounded_portions():
    batch = pa.RecordBatch.from_pydict({"k": list(range(5)), "t": [b"x" * (PORTION // 2), None, b"x" * (PORTION // 2), b"x" * (2 * PORTION), b""]})
    parts = list(portions([batch, batch.slice(0, 0)], 1))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1, 2], [3], [4]]
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))


def test_boxes_in_frames_are_summed_without_pairs(spark):
    """Held against the plain join: equal edges, boxes without extent or turned about, nulls, keys over the size of a group, many equal values."""
    rng = np.random.default_rng(7)
    n, m = 3000, 1500
    box = lambda k, x, w: (int(k), {"x": float(x[0]), "y": float(x[1]), "w": float(w[0]), "h": float(w[1])})
    keys = lambda n: np.where(rng.random(n) < 0.8, 1, rng.integers(2, 6, n))
    place = lambda n: np.where(rng.random((n, 2)) < 0.3, 20.0, rng.integers(0, 60, (n, 2)) / 2)
    kind = "struct<x:double,y:double,w:double,h:double>"
    for least in (1, -1):
        a = spark.createDataFrame([(*box(k, x, w), i) for i, (k, x, w) in enumerate(zip(keys(n), place(n), rng.integers(least, 9, (n, 2))))] + [(1, None, 5), (None, box(1, (1, 1), (9, 9))[1], 6)], f"k long, box {kind}, v long")
        b = spark.createDataFrame([(*box(k, x, w), i // 2) for i, (k, x, w) in enumerate(zip(keys(m), place(m), rng.integers(least, 9, (m, 2))))] + [(1, None, 5)], f"k long, frame {kind}, id long")
        joined = a.join(b, "k").where(B.intersect(F.col("box"), F.col("frame"))).groupBy("id").agg(F.count("*"), F.sum("v"))
        want = {r[0]: tuple(r)[1:] for r in joined.collect()}
        for group in (1 << 20, 400):
            got = B.box_sums(a, b, ["k"], "box", "frame", "id", {"v": F.col("v")}, 8.0, group)
            assert {r.id: (r.n, r.v) for r in got.collect()} == want and want
            assert least < 0 or "SortMergeJoin" not in B.box_sums(a, b, ["k"], "box", "frame", "id", {}, 8.0)._jdf.queryExecution().executedPlan().toString()


def test_strokes_together_as_each_alone(spark):
    """Strokes of one point, of equal points, of a NaN and longer than LONG, finished at once; rows in one batch, null and empty ones among them."""
    rng = np.random.default_rng(3)
    sizes = np.array([1, 5, 2, 40, S.LONG + 90, 3, 7])
    points = np.column_stack([rng.integers(0, 50, sizes.sum()), rng.integers(0, 11, sizes.sum()), np.arange(sizes.sum()), np.full(sizes.sum(), 0.5)]).astype(float)
    points[1:6, :2], points[10, 1] = 7.0, np.nan
    points[np.cumsum(sizes)[4] - S.LONG :, :2] /= 40
    apart = np.split(points, np.cumsum(sizes)[:-1])
    settings = (True, 50.0, 50.0, "ball", 1.0)
    done, n = S.finished(points, sizes, *settings)
    alone = [S.finished(p, np.array([len(p)]), *settings)[0] for p in apart]
    assert n.tolist() == list(map(len, alone)) and n[:2].tolist() == [1, 1] and np.array_equal(done, np.concatenate(alone), equal_nan=True)
    rows = [(k, [tuple(x) for x in p.tolist()]) for k, p in enumerate(apart)] + [(7, None), (8, []), (9, [(1.0, None, None, None), (3.0, 0.0, 1.0, None)])]
    df = spark.createDataFrame(rows, f"k long, p {S.POINTS}").coalesce(1)
    got = {r.k: r.q for r in df.select("k", S.finish_strokes(F.col("p"), dynamic=True).alias("q")).collect()}
    assert got[7] is None and got[8] == [] and len(got[9]) > 2
    for k, want in enumerate(alone):
        assert np.array_equal(np.array([tuple(x) for x in got[k]]), want, equal_nan=True)


def test_lines_of_strokes_are_shuffled_as_rows(spark, sf):
    """No arrays are made before the shuffle, where they would be sorted and spilled; strokes held against each finished alone."""
    df = reference.queries()["pen_strokes"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" in plan and "Aggregate" not in plan[plan.index("Exchange") :]
    lines = defaultdict(list)
    for k, t, x, y in spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_orderkey", "double(l_linenumber)", "l_quantity", "l_discount * 100").collect():
        lines[k].append((t, x, y))
    got = {r.l_orderkey: [tuple(p) for p in r.points] for r in df.collect()}
    assert got.keys() == lines.keys()
    for k, rows in lines.items():
        p = np.array([(x, y, t, 0.5) for t, x, y in sorted(rows)])
        want = S.finished(p, np.array([len(p)]), True, 50.0, 50.0, "ball", 1.0)[0] if len(p) > 1 else p
        assert np.array_equal(np.array(got[k]), want)


def test_words_encoded_together_as_each_alone():
    """Also words that the file composes or lower-cases, added strings, white space that bytes.split() leaves, and bytes that are no UTF-8."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    words = ["one", "It's", "a.b,", "<|endoftext|>", "x<|ENDOFTEXT|>", "Ǻ", "́x", "İI", "ﬁn", "a b", "\x1cab", "　", "\x00", "中文", "\U0001f600"]
    want = [e.ids for e in tok.encode_batch(words, add_special_tokens=False)]
    calls = []
    alone = lambda texts: calls.append(len(texts)) or [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert op06_token_counts.encoded_together(words, alone, tok.normalizer, op06_token_counts.byte_sizes(tok)) == want
    assert max(calls) <= 3 and len(calls) == 3
    assert op06_token_counts.encoder(path)([*(w.encode() for w in words), b"\xff\xfea"])[:-1] == want
    none = np.zeros(tok.get_vocab_size(), np.int64)
    assert op06_token_counts.encoded_together(words, alone, tok.normalizer, none) == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_of_many_texts_are_learned_together(name):
    """New words of a megabyte of texts are one call of the tokenizer, not one for each text; with a memo that is too small, too."""
    path = public_tokenizers.path(name)
    tok, how, encode = Tokenizer.from_file(path), op06_token_counts.reading(path), op06_token_counts.encoder(path)
    texts = ["", *(f"New{k} wörd{k}é, été. x\x1cy{k} a\u0301{k}\n{k}### {'<|endoftext|>' * (k % 3)}{k}" for k in range(300)), "long " * 300_000, "Last1 one."]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    batch = pa.record_batch({"k": range(len(texts)), "t": [t.encode() for t in texts]})
    calls: list[int] = []
    asked = lambda words, form: calls.append(len(words)) or encode(words, form)
    known = Memo(None, 100)
    got = [(row, b"".join(parts)) for row, parts in op06_token_counts.looked_up(batch, 1, how, known, known, asked, op04_packing.packed_ids)]
    assert got == [(k, np.array(ids, "<u4").tobytes()) for k, ids in enumerate(want)]
    assert len(calls) <= 3 and len(known) <= 100
    first, rest = {b"long": len(tok.encode("long", add_special_tokens=False).ids)}, Memo(None)
    got = [(row, sum(parts)) for row, parts in op06_token_counts.looked_up(batch, 1, how, first, rest, encode, op06_token_counts.id_counts)]
    assert got == [(k, len(ids)) for k, ids in enumerate(want)] and b"long" not in rest


def test_toxicity_is_fitted_in_a_task(spark, sf, monkeypatch):
    """The driver gets a model, not the texts of the sample; it is the model of these texts."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = op05_toxicity.labelled_texts(docs, labels, 100, 65_536)
    texts, toxic = [t for t, _ in got], [y for _, y in got]
    want = op05_toxicity.fit_ordinal(texts, op05_toxicity.severity_grades(texts, toxic))
    model = lambda d: op05_toxicity.train(d, labels, rows=100)
    none = model(docs.limit(0))
    assert none.index == {} and not len(none.weights)
    monkeypatch.setattr(op05_toxicity, "severity_grades", None)
    found = model(docs)
    assert found.index == want.index and np.array_equal(found.weights, want.weights) and np.array_equal(found.thresholds, want.thresholds)
