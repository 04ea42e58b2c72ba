import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchment.functions import matching as M
from parchment.operators import correction as C
from parchment.operators import page_index as P
from parchment.operators import search as S


def hits(text, query, **options):
    return [(h[0], text[h[2] : h[3]]) for h in S.search_text(text, S.Query(query), **options)]


@pytest.mark.parametrize("text, query, want", [
    ("the renal artery", "renal artery", [("exact", "renal artery")]),
    ("the Renal\n  Artery", "renal artery", [("case_insensitive", "Renal\n  Artery")]),
    ("a ren al art ery b", "renal artery", [("compact", "ren al art ery")]),
    ("cardio-\nvascular risk", "cardiovascular", [("compact", "cardio-\nvascular")]),
    ("well-controlled", "wellcontrolled", [("alias", "well-controlled")]),
    ("a β-blocker dose", "beta blocker", [("alias", "β-blocker")]),
    ("renal • artery", "renal artery", [("token", "renal • artery")]),
    ("the eﬃcient pump", "efficient", [("exact", "eﬃcient")]),
    ("soft­hyphen", "softhyphen", [("exact", "soft­hyphen")]),
    ("Bradi DycaR dia", "bradycardia", [("fuzzy", "Bradi DycaR dia")]),
    ("tachycardia", "bradycardia", []),
    ("never any chest pains", "chest pain at", []),
    ("aaaa", "aa", [("exact", "aa"), ("exact", "aa")]),
    ("", "x", []), (None, "x", []), ("x", "  ", []),
])
def test_cascade(text, query, want):
    got = hits(text or "", query)
    if want and want[0][0] == "fuzzy":
        assert got and got[0][0] == "fuzzy"
    elif query == "chest pain at":
        assert not any("never" in h[1] for h in got)
    else:
        assert got == want


def test_distance():
    assert M.weighted_distance("bum", "burn") == 0 and M.weighted_distance("l0", "1o") == pytest.approx(0.8)
    assert M.weighted_distance("", "abc") == 3 and M.similarity("abc", "abd") == pytest.approx(2 / 3) and M.similarity("abc", "xyz", 0.5) == 0


def test_search_pages(spark):
    pages = spark.createDataFrame([(1, "Heart and heart", 5), (2, None, 5), (3, "", 5), (4, "h e a r t", 5)], "id long, body string, start int")
    got = sorted((r.id, r.stage, r.start, r.end) for r in S.search_pages(pages, "id", "body", "heart").collect())
    assert got == [(1, "exact", 10, 15), (4, "compact", 0, 9)]
    assert [r.id for r in S.top_hits(S.search_pages(pages, "id", "body", "heart"), "id", 1).collect()] == [1]
    assert {r.id: r.s for r in pages.select("id", S.exact_stage(pages.body, "heart").alias("s")).collect()} == {1: "exact", 2: None, 3: None, 4: "compact"}


WORDS = C.Dictionary(["infarction", "cardiovascular", "heart", "the", "renal", "bradycardia"])


@pytest.mark.parametrize("text, corrected, kinds, candidates", [
    ("infar ction.", "infarction.", ["split_word_repair"], []),
    ("cardio-\nvascular", "cardiovascular", ["hyphenation_repair"], []),
    ("well-\ncontrolled", "well-controlled", ["hyphenation_repair"], []),
    ("the heart", "the heart", [], []),
    ("the hearp", "the hearp", [], ["heart"]),
    ("bradyc ard1a", "bradycard1a", None, None),
    ("", "", [], []), (None, "", [], []), ("zzzzqqqq", "zzzzqqqq", [], []),
])
def test_correction(text, corrected, kinds, candidates):
    got = C.correct(text, WORDS)
    if kinds is None:
        assert not got["changes"] or got["corrected"] == "bradycardia"
        return
    assert got["corrected"] == corrected and [c[2] for c in got["changes"]] == kinds and [c[1] for c in got["candidates"]] == candidates


def test_correct_texts(spark):
    rows = spark.createDataFrame([(1, "infar ction"), (2, None)], "k long, t string")
    vocabulary = spark.createDataFrame([("infarction",), (None,)], "word string")
    got = {r.k: (r.corrected, r.n_changes) for r in C.correct_texts(rows, "k", "t", vocabulary).collect()}
    assert got == {1: ("infarction", 1), 2: ("", 0)}


def test_a_large_vocabulary_is_joined_to_the_same_results(spark):
    texts = ["infar ction.", "cardio-\nvascular", "well-\ncontrolled", "the heart", "the hearp", "bradyc ard1a", "", None, "Infarctlon of the renaI artery", "heart  the", "eﬃcient hearts", "re nal hear t", "The HEART", "card-\nio vascular", "infarc tion infarction"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    words = spark.createDataFrame([(w,) for w in ("infarction", "Cardiovascular", "heart", "the", "renal", "bradycardia", None, "hearth", "hearty", "artery")], "word string")
    small = sorted(map(tuple, C.correct_texts(rows, "id", "t", words).collect()))
    assert sorted(map(tuple, C.correct_texts(rows, "id", "t", words, most=3).collect())) == small
    assert len(small) == len(texts) and any(r[6] for r in small)


def brute_fuzzy(text, q, floor):
    page = M.Folded(text)
    words, found = page.tokens(), []
    for size in S.window_sizes(len(q.words)):
        for i in range(len(words) - size + 1):
            window = [w for w, _, _ in words[i : i + size]]
            joined = "".join(window)
            if abs(len(joined) - len(q.compact)) <= max(4, len(q.compact) * 0.5) and not M.opposite(q.compact, joined) and not M.negation_differs(q.words, window):
                sure = max(0.0, 1 - M.weighted_distance(q.compact, joined) / max(len(joined), len(q.compact), 1))
                if sure >= floor:
                    found.append(("fuzzy", sure, words[i][1], words[i + size - 1][2]))
    return found


@pytest.mark.parametrize("query", ["burnt clover", "vvvow", "no pain", "hypotension", "l0cal", "a", "modern clinic"])
def test_fuzzy_windows_equal_brute_force(query):
    r = random.Random(query)
    bits = ["burn", "bum", "t", "clover", "dover", "vv", "v", "w", "wow", "no", "pain", "pains", "hypo", "hyper", "tension", "local", "10cal", "lo", "cal", "a", "rn", "r", "n", "c", "l", "d", "modern", "modem", "clinic", "dinic", "'s", "-", "x2"]
    pages = [" ".join(r.choice(bits) + r.choice(["", "", r.choice(bits)]) for _ in range(r.randint(0, 30))) for _ in range(150)]
    q = S.Query(query)
    got = S.fuzzy_hits([S.tokens_of(M.Folded(p).text) for p in pages], q, 0.75)
    assert [[(h[0], h[1], h[3], h[4]) for h in page] for page in got] == [brute_fuzzy(p, q, 0.75) for p in pages]
    assert sum(map(len, got)) >= 2


def test_index_equals_one_sign_at_a_time():
    r = random.Random(4)
    signs = ["a", "B", " ", "  ", "\n", "-\n", "-", "​", "ﬃ", "²", "½", "¨", " ", "­", "…", "“", "x", "é", "İ", "😀", "﻿", "　", "\r\n", "ǆ"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 25))) for _ in range(800)]
    normal, compact, to_original, to_normal = P.indexed(texts)
    for form, maps in ((normal, (to_original,)), (compact, (to_normal, to_original))):
        some = [(i, a, r.randint(a + 1, len(t))) for i, t in enumerate(form.to_pylist()) if t for a in (r.randrange(len(t)),)]
        doc, start, end = map(np.array, zip(*some))
        for m in maps:
            start, end, known = P.through(m, doc, start, end)
            assert known.all()
        for (i, a, b), x, y in zip(some, start.tolist(), end.tolist()):
            page = M.Folded(texts[i])
            assert (form[i].as_py(), (x, y)) == ((page.text, page.span(a, b)) if form is normal else (page.compact, page.compact_span(a, b)))


def test_pages_are_read_in_waves(spark):
    pages = spark.createDataFrame([(i if i else None, "the heart" if i % 3 == 0 else "no", "x") for i in range(400)], "id long, body string, _n string")
    got = S.first_hits(pages, "id", "body", "heart", 5, wave=4)
    assert [r.id for r in got.collect()] == [3, 6, 9, 12, 15]
    assert S.first_hits(pages, "id", "body", "heart", 500, wave=4).count() == 134
    assert S.first_hits(pages, "id", "body", "nothing", 5).count() == 0 and S.first_hits(pages.limit(0), "id", "body", "heart", 5).count() == 0


def test_hits_know_their_items(spark):
    page = [(1, "first heart\n\nhe\nart and heart")]
    pages = spark.createDataFrame(page, "id long, body string").withColumn("lines", P.line_items(F.col("body")))
    hits = S.search_pages(pages, "id", "body", "heart", always_fuzzy=False).unionByName(S.search_pages(pages, "id", "body", "he art"))
    got = sorted((r.stage, r.start, r.end, [tuple(x) for x in r.items]) for r in S.hits_with_items(hits, pages, "id", "lines").collect())
    assert got == [("exact", 6, 11, [(0, 6, 11, 11)]), ("exact", 13, 19, [(2, 0, 2, 2), (3, 0, 3, 13)]), ("exact", 24, 29, [(3, 8, 13, 13)])]
