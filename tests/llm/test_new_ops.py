"""Whitening, tokenizer alignment and token files against brute force."""

import hashlib
import math
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from parchment.llm import op11_embedding_whitening as whitening
from parchment.llm import op12_tokenizer_alignment as alignment
from parchment.llm import op13_token_ids as files
from parchment.llm import queries
from parchment.llm.encoding import TextEncoder, byte_letters

A, B = map(public_tokenizers.path, queries.ALIGNED)
ODD = ["", " ", "  ", "a", " a", "a ", "  a  b\n c \n", "\n\nthe.\nThe", "x \t y", "<|endoftext|> is a <s> string </s>", "say ▁ this", "<0x0A>", "ééé ﬁ 中文 😀", "\x00 null", "it's\r\nOK", "　wide  space\xa0"]


def hostile(n, seed):
    r = np.random.default_rng(seed)
    bits = ["a", "B", " ", "  ", "\n", " \n", "\n ", "\t", "é", "é", "　", "\xa0", "▁", "<|endoftext|>", "<s>", "'s", "1", "23", ".", ",", "!?", "-", "中文", "\x1c", "\x85", "😀", "\r\n", "the", "on)", " x", "</s>", "<0x0A>"]
    return ["".join(r.choice(bits, r.integers(1, 14))) for _ in range(n)]


@pytest.mark.parametrize("name,plain", [("byte_bpe_50k.json", True), ("byte_bpe_50k.json", False), ("piece_bpe_32k.model", True), ("word_bpe_49k.json", False)])
def test_parts_give_the_ids_of_whole_texts(name, plain):
    encoder = TextEncoder(public_tokenizers.path(name), plain, most=500)
    texts = ODD + hostile(3000, 3)
    for at in range(0, len(texts), 700):
        some = texts[at : at + 700]
        want = iter(encoder.whole([t for t in some if t]))
        assert encoder.packed([*some, None]) == [next(want) if t else b"" for t in some] + [b""]
    spaced = TextEncoder(public_tokenizers.path(name), plain, most=500, space=True)
    want = iter(spaced.whole([t if spaced.pieces else f" {t}" for t in texts if t]))
    assert spaced.packed(texts) == [next(want) if t else b"" for t in texts]


def brute_links(texts):
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = byte_letters()
    out, held = [], Counter()
    for text in texts:
        a = one.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in one.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(two.id_to_piece(i)[3:-1], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if text and not b"".join(bytes_a) == b"".join(bytes_b) == f" {text}".encode():
            a, b, bytes_a, bytes_b = [], [], [], []
        ends_a, ends_b = np.cumsum([0, *map(len, bytes_a)]).tolist(), np.cumsum([0, *map(len, bytes_b)]).tolist()
        links = [(i, j) for i in range(len(a)) for j in range(len(b)) if ends_a[i] < ends_b[j + 1] and ends_b[j] < ends_a[i + 1]]
        cuts = sorted({*ends_a} & {*ends_b})
        groups = ";".join(",".join(str(a[i]) for i in range(len(a)) if p <= ends_a[i] < q) + "|" + ",".join(str(b[j]) for j in range(len(b)) if p <= ends_b[j] < q) for p, q in zip(cuts, cuts[1:]))
        held.update({(a[i], b[j]) for i, j in links})
        out.append((a, b, links, groups, max(0, len(cuts) - 1)))
    best = {}
    for (a, _), n in held.items():
        best[a] = max(n, best.get(a, 0))
    rows = []
    for a, b, links, groups, n_groups in out:
        counts = [(held[a[i], b[j]], best[a[i]]) for i, j in links]
        rows.append((len(a), len(b), n_groups, len(links), sum(n == m for n, m in counts), sum(n for n, _ in counts), groups or None, links))
    return rows


@pytest.mark.parametrize("most", [2_000_000, 300, 0])
def test_alignment_equals_brute_force(spark, most):
    texts = [*ODD, *hostile(60, 8), "the house of the " * 60, "the house of the " * 60, None]
    rows = [(i if i % 7 else None, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long")
    got = alignment.alignments(docs, A, B, links=True, most=most).collect()
    want = [(i if i % 7 else None, *w) for i, w in enumerate(brute_links(texts))]
    mine = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups, [tuple(x) for x in r.links]) for r in got]
    assert sorted(mine, key=repr) == sorted(want, key=repr)


def test_alignment_query_on_documents(spark, sf):
    rows = queries.op12_alignment(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == texts.keys()
    short = [k for k in texts if len(texts[k] or "") < 1500]
    by_id = {r.doc_id: r for r in rows}
    for k, w in zip(short, brute_links([texts[k] for k in short]), strict=True):
        r = by_id[k]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == w[:4]
        assert r.groups_sha256 == (hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "")


def test_alignment_of_no_rows(spark):
    assert alignment.alignments(spark.createDataFrame([], "doc_id string, text string, n long"), A, B).count() == 0


@pytest.mark.parametrize("lane", [1, 3, 512])
def test_lockstep_walks_alike_in_lanes_of_any_size(lane):
    r = np.random.default_rng(lane)
    docs = [(r.integers(1, 5, n), n) for n in (0, 1, 7, 40, 0, 200)]
    lengths_a = [d for d, _ in docs]
    lengths_b = []
    for d in lengths_a:
        cuts = np.flatnonzero(r.random(max(0, d.sum() - 1)) < 0.4) + 1
        lengths_b.append(np.diff(np.r_[0, cuts, d.sum()]) if len(d) else np.zeros(0, int))
    ends = [np.cumsum(np.concatenate(x)) for x in (lengths_a, lengths_b)]
    walk = alignment.lockstep(*ends, np.cumsum([0, *map(len, lengths_a)]), lane)
    begins = [np.r_[0, e[:-1]] for e in ends]
    want = {(i, j) for i in range(len(ends[0])) for j in range(len(ends[1])) if begins[0][i] < ends[1][j] and begins[1][j] < ends[0][i]}
    got = list(zip(walk.a.tolist(), walk.b.tolist(), strict=True))
    assert len(got) == len(want) and set(got) == want
    common = set(ends[0].tolist()) & set(ends[1].tolist())
    assert [e in common for e in ends[0].tolist()] == walk.cut_a.tolist() and [e in common for e in ends[1].tolist()] == walk.cut_b.tolist()


def test_any_token_can_be_read_by_itself():
    r = np.random.default_rng(2)
    for ids in (np.zeros(1, np.uint32), r.integers(0, 256, 3000), r.integers(0, 50_257, 5001), 2 ** r.integers(0, 32, 4000) - 1 + r.integers(0, 2, 4000)):
        ids = np.minimum(ids, 2**32 - 1).astype(np.uint32)
        starts = np.array([0, 0, len(ids) // 2])
        data = files.encode_file(ids, [3, None, -4], starts)
        asked = []

        def read(at, n):
            asked.append(n)
            return data[at : at + n]

        file = files.TokenFile(read)
        assert file.documents()[0] == [3, None, -4] and file.documents()[1].tolist() == [0, 0, len(ids) // 2, len(ids)]
        for i in r.integers(0, len(ids), 200).tolist():
            asked.clear()
            assert file.token(i) == ids[i]
            assert sum(asked) <= 5 * 80  # per level a chunk, a count and at most 64 + 1 bytes of bitmap
        for a, b in np.sort(r.integers(0, len(ids) + 1, (200, 2)), axis=1).tolist():
            assert (file.tokens(a, b) == ids[a:b]).all()
        with pytest.raises(IndexError):
            file.tokens(0, len(ids) + 1)


def brute_files(rows):
    tok = Tokenizer.from_file(A)
    out, start = [], 0
    for key, text in rows:
        ids = np.array([*(tok.encode(text, add_special_tokens=False).ids if text else []), 0], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_equal_the_library(spark, sf, tmp_path):
    got = sorted(map(tuple, queries.op13_token_files(spark, sf).collect()))
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    assert got == brute_files([(r.doc_id, r.text) for r in docs])
    # small files, odd texts, columns of one's own
    rows = [(k - 5, t) for k, t in enumerate([*ODD, None, *hostile(40, 5), "the house " * 3000])]
    odd = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id int, text string, t string, tie string")
    path = f"file://{tmp_path}/odd"
    files.write_tokens(odd, A, path, ids_per_file=100)
    assert sorted(map(tuple, files.read_tokens(spark, path).collect())) == brute_files(rows)
    listed = [r.name for r in spark.read.parquet(f"{path}/files").collect()]
    assert len(listed) > 5 and {p.name for p in (tmp_path / "odd").glob("*.dac")} == set(listed)
    whole = files.open_file(f"{path}/{max(listed, key=lambda x: (tmp_path / 'odd' / x).stat().st_size)}")
    assert whole.token(whole.n_ids - 1) == 0
    ids = {r.doc_id: r.ids for r in files.read_tokens(spark, path, with_ids=True).collect()}
    tok = Tokenizer.from_file(A)
    assert all(ids[k] == [*(tok.encode(t, add_special_tokens=False).ids if t else []), 0] for k, t in rows)


def test_token_files_of_null_equal_and_no_ids(spark, tmp_path):
    rows = [(None, "b b"), (None, "a"), (1, "x"), (1, "x"), (1, None), (1, "y y y")]
    files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), A, f"{tmp_path}/ties")
    got = sorted(files.read_tokens(spark, f"{tmp_path}/ties").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 1, 1, 1, 1]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got[:-1]]).tolist()
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == Counter((k, c) for k, _, _, c in brute_files(rows))
    files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), A, f"{tmp_path}/none")
    assert files.read_tokens(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(TypeError):
        files.write_tokens(spark.createDataFrame([("a", "b")], "doc_id string, text string"), A, f"{tmp_path}/text")


def check_whitening(rows, vectors, components=32):
    """rows of op11 against exact sums and numpy's eigenvectors of the covariance."""
    kept = {k: v for k, v in vectors.items() if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    n, size = len(kept), len(next(iter(kept.values())))
    x = {k: [math.floor(64 * c) + 1_000_000 for c in v] for k, v in kept.items()}
    sums = [sum(c) for c in zip(*x.values(), strict=True)]
    y = np.array([[float(Fraction(c * n - s, n)) for c, s in zip(v, sums, strict=True)] for v in x.values()])
    cov = y.T @ y / n
    values, vectors_ = np.linalg.eigh(cov)
    want = y @ (vectors_[:, ::-1] / np.sqrt(values[::-1]))[:, :components]
    assert len(rows) == n * min(components, size)
    got = np.zeros((n, min(components, size)))
    place = {k: i for i, k in enumerate(x)}
    for r in rows:
        got[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and abs(r.explained - values[-r.component] / values.sum()) < 1e-9 and r.identity_error < 1e-9
    assert {r.vec_id: r.deviation for r in rows} == {k: sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for k, v in x.items()}
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got - signs * want).max() < 1e-6
    assert np.abs(got.T @ got / n - np.eye(got.shape[1])).max() < 1e-9


def test_whitening_equals_numpy(spark, sf):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    check_whitening(queries.op11_whitening(spark, sf).collect(), vectors)


def whitened(spark, rows, schema="vec_id long, embedding array<double>", **options):
    df = spark.createDataFrame(rows, schema)
    return whitening.whiten(df, whitening.fit(df, **options))


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.5]), (3, [0.25, -2.0]), (3, [0.25, -2.0]), (None, [3.0, 1.0]), (5, None), (6, []), (7, [nan, 1.0]), (8, [1.0, None]), (9, [inf, 0.0]), (10, [1.0, 2.0, 3.0])]
    got = whitened(spark, [(k, v, 7) for k, v in rows], "vec_id long, embedding array<float>, n int")
    assert got.columns == ["vec_id", "embedding", "whitened", "n", "deviation", "shares", "identity_error"]
    got = got.collect()
    assert sorted((r.vec_id or 0, len(r.whitened), r.n) for r in got) == [(0, 2, 5), (1, 2, 5), (2, 2, 5), (3, 2, 5), (3, 2, 5), (10, 3, 1)]
    lone = next(r for r in got if r.vec_id == 10)
    assert (lone.whitened, lone.shares, lone.identity_error, lone.deviation) == ([None] * 3, [None] * 3, None, 0)
    z = np.array([r.whitened for r in got if r.n == 5])
    assert np.abs(z.T @ z / 5 - np.eye(2)).max() < 1e-12
    assert whitened(spark, []).count() == 0
    flat = whitened(spark, [(i, [float(i % 3), 5.0, 2.0 * (i % 3)]) for i in range(9)]).collect()
    assert all(r.whitened[0] is not None and r.whitened[1:] == [None, None] and r.identity_error < 1e-12 for r in flat)
    far = whitened(spark, [(i, [1e6 * i, -3e7 * i * i]) for i in range(12)]).collect()
    x = [[64 * 10**6 * i + 10**6, -64 * 3 * 10**7 * i * i + 10**6] for i in range(12)]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert {r.vec_id: int(r.deviation) for r in far} == {i: sum((12 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in enumerate(x)}
    assert whitened(spark, [(1, [1e300]), (2, [-1e300])]).count() == 2


def test_refinement_tells_clustered_eigenvalues_apart():
    r = np.random.default_rng(1)
    for spectrum in (np.linspace(1, 2, 64), 1 + 1e-3 * r.normal(size=40), np.r_[1 + 1e-9 * np.arange(8), 2 + 1e-11 * np.arange(8), np.linspace(4, 5, 24)], np.r_[np.ones(9), np.linspace(2, 3, 9), np.zeros(4)], [5.0], [0.0, 0.0]):
        spectrum = np.array(spectrum, np.longdouble)
        q = np.linalg.qr(r.normal(size=(len(spectrum),) * 2))[0].astype(np.longdouble)
        for _ in range(3):
            q = q @ (3 * np.eye(len(q)) - q.T @ q) / 2
        a = (q * spectrum) @ q.T
        values, x = whitening.refined((a + a.T) / 2)
        wide = x.astype(np.longdouble)
        top = max(1, float(spectrum.max()))
        assert np.abs(values - np.sort(spectrum)[::-1]).max() < 1e-15 * top
        assert np.abs(a @ wide - wide * values).max() < 1e-15 * top and np.abs(wide.T @ wide - np.eye(len(q))).max() < 1e-15
        order = np.argsort(-spectrum, kind="stable")
        lone = np.r_[True, np.diff(-spectrum[order]) > 1e-12] & np.r_[np.diff(-spectrum[order]) > 1e-12, True]
        assert (1 - np.abs((q[:, order] * wide).sum(axis=0)))[lone].max(initial=0) < 1e-13
