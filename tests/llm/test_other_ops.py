import numpy as np
import pytest
from pyspark.sql import functions as F

from parchment.llm import op03_embeddings as near
from parchment.llm import op07_url_filter as urls
from parchment.llm import op08_neighbours as ann
from parchment.llm.queries import RULES
from parchment.llm.shared import components
from tests.llm.test_text_ops import union_find

KIND = "vec_id long, embedding array<float>, label int, n_links string, v string, cell string, score string"


def vectors(seed=0, n=400, dim=16):
    """Random vectors, dense groups, chains, copies, and rows that can't take part."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        if k % 4 == 0 or k < 8:
            v = rng.standard_normal(dim)
        elif k % 4 == 1:
            v = np.array(out[int(rng.integers(0, len(out)))][1]) * rng.uniform(0.5, 2)
        else:
            base = np.array(out[int(rng.integers(0, len(out)))][1])
            v = base + rng.standard_normal(dim) * np.linalg.norm(base) * rng.uniform(0.0, 0.08)
        out.append((k, [float(x) for x in np.float32(v)], int(k % 3) if k % 7 else None))
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * dim, [nan] * dim, [inf] * dim, [None] * dim, [1.0] * (dim - 1)]
    out += [(n + i, v, 1) for i, v in enumerate(odd)]
    return [(*r, "a", "b", "c", "d") for r in out]


def ok(v, dim=16):
    return v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute_links(rows, cosine=0.98):
    good = [r for r in rows if ok(r[1]) and r[2] is not None]
    x = np.array([r[1] for r in good], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = (x @ x.T >= cosine) & (np.array([r[2] for r in good])[:, None] == np.array([r[2] for r in good])[None])
    np.fill_diagonal(hit, False)
    ids = [r[0] for r in good]
    root = union_find([(ids[i], ids[j]) for i, j in zip(*np.nonzero(hit), strict=True)], [r[0] for r in rows])
    n = dict(zip(ids, hit.sum(1).tolist(), strict=True))
    return {r[0]: (r[0], n.get(r[0], 0), root[r[0]], root[r[0]] == r[0]) for r in rows}


@pytest.mark.parametrize("options", [{}, {"cell": 20}, {"cell": 30, "part_rows": 25}, {"part_rows": 40}])
def test_near_vectors(spark, options):
    rows = vectors()
    got = {r.vec_id: tuple(r) for r in near.near_vectors(spark.createDataFrame(rows, KIND), **options).collect()}
    assert got == brute_links(rows)
    assert sum(n > 0 for _, n, _, _ in got.values()) > 100


@pytest.mark.parametrize("options", [{}, {"cell": 2, "part_rows": 3}])
def test_near_vectors_of_several_lengths(spark, options):
    rng = np.random.default_rng(3)
    a, b = (rng.standard_normal(n).tolist() for n in (8, 16))
    rows = [(1, a, 1), (2, a, 1), (3, b, 1), (4, b, 1), (5, b, 2), (6, a, None), (7, [2 * x for x in b], 1)] + [(100 + i, rng.standard_normal(16).tolist(), 1) for i in range(20)]
    got = {r.vec_id: tuple(r) for r in near.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), **options).collect()}
    assert {k: got[k][1:3] for k in range(1, 8)} == {1: (1, 1), 2: (1, 1), 3: (2, 3), 4: (2, 3), 5: (0, 5), 6: (0, 6), 7: (2, 3)}


def test_near_vectors_with_equal_ids(spark):
    v = [[1.0, 0.0], [0.0, 1.0], [1.0, 0.01]]
    rows = [(1, v[0], 1), (1, v[1], 1), (2, v[2], 1), (None, v[2], 1)]
    got = [tuple(r) for r in near.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()]
    assert sorted(got, key=str) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True)]


def test_near_vectors_empty(spark):
    assert near.near_vectors(spark.createDataFrame([], KIND)).collect() == []
    assert near.near_vectors(spark.createDataFrame(vectors()[-7:-1], KIND)).count() == 6


def brute_nearest(rows, every=20, k=20):
    good = [r for r in rows if ok(r[1])]
    x, ids = np.array([r[1] for r in good], float), np.array([r[0] for r in good])
    out = {}
    for i, q in enumerate(ids):
        if q % every == 0:
            s = (x * x[i]).sum(1)
            s[i] = -np.inf
            best = np.lexsort((ids, -s))[:k]
            out[int(q)] = [(int(ids[b]), s[b]) for b in best if b != i]
    return out


@pytest.mark.parametrize("options", [{}, {"shard_rows": 90, "block_rows": 7}])
def test_nearest(spark, options):
    rows = vectors(1, 600)
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, KIND), **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(got[r.query_id]) == r.rank
    want = brute_nearest(rows)
    assert got.keys() == want.keys()
    right = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert right >= 0.95 * sum(map(len, want.values()))
    for q in got:
        assert got[q] == sorted(got[q], key=lambda p: (-p[1], p[0])) and len(got[q]) == len(want[q])


def test_nearest_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    x, ids = np.array([r[1] for r in rows], float), np.array([r[0] for r in rows])
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        hit += len(got[ids[i]] & set(ids[np.argsort(-s)[:20]].tolist()))
        total += 20
    assert hit >= 0.9 * total


@pytest.mark.parametrize("options", [{}, {"shard_rows": 40, "block_rows": 3}])
def test_nearest_ties_lengths_and_visits(spark, options):
    rng = np.random.default_rng(6)
    some = [rng.standard_normal(8).tolist() for _ in range(30)]
    rows = [(i, some[i % 30]) for i in range(240)] + [(240 + i, [*some[i % 30], 1.0]) for i in range(60)] + [(20, some[0]), (None, some[0]), (400, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, k=10, visits="n_verified", sure=0.999, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert 0 < r.n_verified <= 300
    used = {i: v for i, v in rows if i is not None}
    used[20] = min(some[0], some[20])
    assert got.keys() == {i for i in used if i % 20 == 0} - {400}
    for q, found in got.items():
        scores = sorted(((-float((np.array(v) * np.array(used[q])).sum()), i) for i, v in used.items() if i != q and len(v) == len(used[q])))[:10]
        assert [i for i, _ in found] == [i for _, i in scores] and np.allclose([s for _, s in found], [-s for s, _ in scores])


def test_nearest_few_rows(spark):
    assert ann.nearest(spark.createDataFrame([], KIND)).collect() == []
    rows = [(i, [1.0, float(i)], 0, "a", "b", "c", "d") for i in (0, 1, 20)]
    assert len(ann.nearest(spark.createDataFrame(rows, KIND)).collect()) == 4


def brute_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        at = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at]), rest[at:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    best = None
    for rule, verdict in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, best


ODD_URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y#z", "https://net", "https://net/", "https://example.net/en", "x://example.com/de/", "x://notexample.com/de/1", "x://b.org/fr/#q",
            "a://b?c=http://d.net/", "https://\u00c9cole.org/fr/\n/x", "https://user@h.net:80/p", "s://" + "long" * 30_000 + ".net/" + "p" * 50_000]


def test_url_verdicts(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", F.lit("x").alias("host"), F.lit("y").alias("label"))
    pages = pages.unionByName(spark.createDataFrame([(10_000 + i, u, "x", "y") for i, u in enumerate(ODD_URLS)], "page_id long, url string, host string, label string"))
    texts = {r.page_id: r.url for r in pages.collect()}
    rows = urls.url_verdicts(pages, RULES).collect()
    assert len(rows) == len(texts)
    for r in rows:
        host, path, best = brute_url(texts[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[0]), texts[r.page_id]
        assert r.verdict == (best[1] if best else "block" if r.p_block >= 0.5 else "allow")
    assert urls.url_verdicts(pages.limit(0), RULES).collect() == []


def test_url_classifier_learns(spark):
    rng = np.random.default_rng(0)
    make = lambda bad: (f"{rng.choice(['win', 'bet', 'casino'] if bad else ['news', 'wiki', 'docs'])}{rng.integers(0, 99)}.example", f"/{rng.choice(['spin', 'bonus'] if bad else ['article', 'guide'])}/{rng.integers(0, 999)}", int(bad))
    train = spark.createDataFrame([make(i % 2) for i in range(200)], "host string, path string, label int")
    test = [make(i % 2) for i in range(100)]
    pages = spark.createDataFrame([(i, f"https://{h}{p}") for i, (h, p, _) in enumerate(test)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.url_verdicts(pages, (), labelled=train).collect()}
    assert sum((got[i] == "block") == bool(y) for i, (_, _, y) in enumerate(test)) >= 95


def test_url_classifier_by_brute_force(spark, sf):
    """Weights by plain stochastic gradient descent over the same features, and the score of every page."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    host, path = urls.url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("f", urls.ngram_features(F.col("host"), F.col("path"), 512)).withColumn("k", F.xxhash64("host", "path")).collect()
    train = {}
    for r in rows:
        train.setdefault((r.host, r.path), r)
    labelled = [(h, p, int(i % 3 == 0)) for i, (h, p) in enumerate(sorted(train))]
    got = urls.fit(spark.createDataFrame(labelled, "host string, path string, label int"), epochs=3)
    data = sorted((train[h, p].k, float(y), train[h, p].f) for h, p, y in labelled)
    share = np.mean([y for _, y, _ in data])
    w = np.zeros(513)
    for _ in range(3):
        for _, y, f in data:
            x = np.zeros(513)
            x[0] = 1.0
            x[f] = 1 / np.sqrt(max(1, len(f)))
            move = 0.5 * (0.5 / share if y else 0.5 / (1 - share)) * (y - 1 / (1 + np.exp(-(w @ x))))
            w = w * (1 - 0.5e-4) + move * x
    assert np.allclose(got, w, atol=1e-9)
    scored = urls.url_verdicts(pages, (), labelled=spark.createDataFrame(labelled, "host string, path string, label int")).collect()
    full = np.array(urls.fit(spark.createDataFrame(labelled, "host string, path string, label int")))
    by_id = {r.page_id: r for r in rows}
    for r in scored:
        f = by_id[r.page_id].f
        assert r.p_block == pytest.approx(1 / (1 + np.exp(-(full[0] + full[f].sum() / np.sqrt(max(1, len(f)))))), abs=1e-9)


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 2000 + i) for i in range(50)] + [(5, 5)]
    nodes = {n for a, b in edges for n in (a, b) if a != b}
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union_find(edges, {n for e in edges for n in e})
    assert got == {n: want[n] for n in nodes}
