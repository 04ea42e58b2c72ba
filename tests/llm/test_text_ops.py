import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parchment.llm import op01_line_dedup as line
from parchment.llm import op02_mixing as mixing
from parchment.llm import op04_packing as packing
from parchment.llm import op05_toxicity as toxicity
from parchment.llm import op06_token_counts as counts
from parchment.llm import op09_minhash as minhash
from parchment.llm import op10_suffix as suffix

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string, n_bytes string, size int, component_id string, sequence_id int, key string, own int, t string"
ODD = ["", None, " \t\n", "a", "word " * 20_000, "Tab\tand\x0bvertical\x0cfeed\x1cseparator", "caf\u00e9 cafe\u0301 \u0130stanbul \u03a3\u03a3\u03a3 \u4e2d\u6587", "<|endoftext|> x<|startoftext|>y", "it's we'll 12 3.4 !?", "\u00a0nbsp\u2003em\u0085nel"]


def odd(spark, texts=ODD):
    rows = [(i, t, [None, "", "a", "b"][i % 4], "x", 1, "c", 2, "k", 3, "t") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def library(text):
    tok = Tokenizer.from_file(PATH)
    return tok.encode(text or "", add_special_tokens=False).ids


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def union_find(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# 6

def test_token_counts_equal_the_library(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    tok = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in counts.token_counts(docs, PATH).collect()}
    for r in docs.collect():
        n = len(tok.encode(r.text, add_special_tokens=False).ids)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (n, len(r.text.encode()), n > 2048)


def test_token_counts_odd_texts(spark):
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in counts.token_counts(odd(spark), PATH).collect()}
    assert got == {i: (len((t or "").encode()), len(library(t))) for i, t in enumerate(ODD)}
    assert counts.token_counts(odd(spark, []), PATH).collect() == []


DECOMPOSED = [f"{a}{mark} {a}{mark}x. Plain {a}{mark}" for a, mark in zip("HJTWYhjtwy", "\u0331\u030c\u0308\u030a\u030a" * 2)]


def test_letters_that_compose_in_lower_case_only(spark):
    got = {r.doc_id: r.n_tokens for r in counts.token_counts(odd(spark, DECOMPOSED), PATH).collect()}
    assert got == {i: len(library(t)) for i, t in enumerate(DECOMPOSED)}
    check_packing(packing.pack(odd(spark, DECOMPOSED), PATH).collect(), dict(enumerate(DECOMPOSED)))


def test_token_counts_by_pieces(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r.n_tokens for r in counts.token_counts(odd(spark), path).collect()}
    assert got == {i: len(model.encode(t or "")) for i, t in enumerate(ODD)}


def test_how_tokenizers_read():
    assert counts.reading(PATH) == counts.Reading(False, True, (b"<|endoftext|>", b"<|startoftext|>"))
    assert counts.reading(public_tokenizers.path("byte_bpe_50k.json")).whole and counts.reading(public_tokenizers.path("piece_bpe_32k.model")).whole


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_tokens_of_whole_texts(spark, name):
    path = public_tokenizers.path(name)
    tok = Tokenizer.from_file(path)
    got = {r.doc_id: r.n_tokens for r in counts.token_counts(odd(spark), path).collect()}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(ODD)}
    lengths = Counter()
    for r in packing.pack(odd(spark), path).collect():
        lengths[r.doc_id] += r.length
    assert lengths == {i: n + 1 for i, n in got.items()}


def test_frequent_pretokens_are_merged_in_a_tree(spark):
    docs = spark.createDataFrame([(f"a b{i % 3} c{i}",) for i in range(90)], "text string").repartition(4)
    got = counts.frequent_pretokens(docs, counts.Reading(False, True, ()), most=3, fan_in=2)
    assert got == [b"a", b"b0", b"b1"]


# 4

def check_packing(rows, texts):
    bins = defaultdict(list)
    ids = {}
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        ids.setdefault(r.doc_id, []).append(r)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    tok = Tokenizer.from_file(PATH)
    total = 0
    for key, text in texts.items():
        whole = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(whole)
        parts = sorted(ids[key], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(-(-len(whole) // 2048)))
        for p in parts:
            want = whole[p.start : p.start + 2048]
            assert p.start == 2048 * p.piece and p.length == len(want) and p.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
    return len(bins), -(-total // 2048)


def test_packing(spark, sf):
    docs = documents(spark, sf)
    used, bound = check_packing(packing.pack(docs, PATH, shard_rows=50).collect(), {r.doc_id: r.text for r in docs.collect()})
    assert used <= bound * 1.01 + 1


def test_packing_odd_texts(spark):
    check_packing(packing.pack(odd(spark), PATH).collect(), dict(enumerate(ODD)))
    assert packing.pack(odd(spark, []), PATH).collect() == []
    twice = odd(spark, ["a b"]).unionAll(odd(spark, ["a b"]))
    assert sorted((r.doc_id, r.offset) for r in packing.pack(twice, PATH).collect()) == [(0, 0), (0, 3)]


@pytest.mark.parametrize("seed", range(6))
def test_histogram_is_packed_whole(seed):
    rng = np.random.default_rng(seed)
    room = int(rng.integers(4, 300))
    lengths = rng.integers(1, room + 1, int(rng.integers(1, 800)))
    histogram = dict(Counter(lengths.tolist()))
    plan = packing.pack_histogram(histogram, room)
    got = Counter()
    for pattern, times in plan:
        assert sum(n * k for n, k in pattern) <= room
        for n, k in pattern:
            got[n] += times * k
    assert dict(got) == histogram
    best_fit = sorted(lengths.tolist(), reverse=True)
    bins: list[int] = []
    for n in best_fit:
        fits = [i for i, free in enumerate(bins) if free >= n]
        if fits:
            bins[min(fits, key=bins.__getitem__)] -= n
        else:
            bins.append(room - n)
    assert sum(t for _, t in plan) <= len(bins) * 1.02 + 1


# 1

def brute_lines(texts):
    where, total = {}, Counter()
    for key in sorted(texts):
        for no, c in enumerate(line.chunks_of((texts[key] or "").encode())):
            if line.body_of(c) is not None:
                total[line.body_of(c)] += 1
                where.setdefault(line.body_of(c), (key, no))
    out = {}
    for key, text in texts.items():
        kept = [c for no, c in enumerate(line.chunks_of((text or "").encode())) if line.body_of(c) is None or where[line.body_of(c)] == (key, no)]
        out[key] = None if text is None else b"".join(kept).decode()
    return out


def test_line_dedup(spark, sf):
    docs = documents(spark, sf)
    got = {r.doc_id: r.text for r in line.dedup_lines(docs).collect()}
    want = brute_lines({r.doc_id: r.text for r in docs.collect()})
    assert got == want and any(want[r.doc_id] != r.text for r in docs.collect())


def test_line_dedup_odd_texts(spark):
    block = "\n".join(f"line {i}" for i in range(40))
    texts = [*ODD, block, f"own\n{block}", f"{block}\nmore\n", "x\ny", "x\ny", "\n\n\n", "\n\n\n"]
    rows = line.dedup_lines(odd(spark, texts)).collect()
    assert {r.doc_id: r.text for r in rows} == brute_lines(dict(enumerate(texts)))
    assert {r.doc_id: r.n_bytes for r in rows} == dict.fromkeys(range(len(texts)), "x")
    assert line.dedup_lines(odd(spark, [])).collect() == []


def test_chunks_resist_shifts():
    lines = [f"line number {i * i % 97} of {i}".encode() for i in range(200)]
    a, b = line.chunks_of(b"\n".join(lines)), line.chunks_of(b"\n".join([b"new", *lines[:100], b"other", *lines[100:]]))
    assert b"".join(a) == b"\n".join(lines)
    assert len(set(a) & set(b)) >= len(a) - 6


def repeated_passages(texts):
    """Line numbers by text of all that a passage of two visible lines, or a line of over 50 words, repeats of an earlier place."""
    seen, out = set(), {}
    for key in sorted(texts):
        lines = texts[key].split("\n")
        visible = [i for i, x in enumerate(lines) if x.strip(" \t\n\v\f\r")]
        gone = out[key] = set()
        places = [(a, b + 1) for a, b in zip(visible, visible[1:])] + [(i, i + 1) for i in visible if len(lines[i].encode().split()) > 50]
        for a, b in sorted(places):
            passage = tuple(lines[a:b])
            if passage in seen:
                gone.update(range(a, b))
            seen.add(passage)
    return out


def test_line_dedup_finds_all_passages(spark, sf):
    texts = {r.doc_id: r.text for r in documents(spark, sf).collect()}
    for k in range(40):
        texts[90_000 + k] = "\n".join([f"before {k}", *(f"{k // 2} shared {j}" for j in range(2 + k // 2 % 4)), f"after {k}"])
    texts[91_000] = texts[91_001] = "word " * 60
    texts[91_002] = "first of a pair\n\nsecond of a pair\nown end"
    texts[91_003] = "own start\nfirst of a pair\n\nsecond of a pair"
    got = {r.doc_id: r.text for r in line.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), extend=True).collect()}
    gone = repeated_passages(texts)
    for key, text in texts.items():
        kept = [x for i, x in enumerate(text.split("\n")) if i not in gone[key] and x.strip()]
        assert [x for x in got[key].split("\n") if x.strip()] == kept
    assert got[91_003] == "own start\n" and got[91_001] == "" and got[90_001] == "before 1\nafter 1"


@pytest.mark.parametrize("extend", [False, True])
def test_line_dedup_null_and_equal_ids(spark, extend):
    block = "\n".join(f"line {i}" for i in range(40))
    rows = [(1, block), (1, f"{block}\nother words\nof the second row"), (1, None), (1, "short"), (None, block), (None, f"{block}\nnew"), (2, "x\ny"), (2, "x\ny"), (None, None)]
    got = line.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), extend=extend).collect()
    by_id = {k: [r.text for r in got if r.doc_id == k] for k in (1, 2, None)}
    assert {k: len(v) for k, v in by_id.items()} == {1: 4, 2: 2, None: 3}
    assert block in by_id[1] and None in by_id[1] and "short" in by_id[1]
    assert sorted(by_id[2]) == ["", "x\ny"]
    assert None in by_id[None] and any(t == "" for t in by_id[None])
    texts = [t for v in by_id.values() for t in v if t]
    assert sum(t.count("line 20") for t in texts) == 1 and sum("of the second row" in t for t in texts) == 1


def brute_starts(lines):
    """Chunk boundaries by the rule as it is told, with plain numbers."""
    mask = 2**64 - 1
    out, before = [0], 0
    for i, x in enumerate(lines):
        h = xxhash.xxh3_64_intdigest(x)
        rolled = ((h * int(line.MIX) + before) & mask) * int(line.MIX) & mask
        before = h
        long, size = len(x.split()) > line.LONG and len(x) > 2 * line.LONG, i + 1 - out[-1]
        next_long = i + 1 < len(lines) and len(lines[i + 1].split()) > line.LONG and len(lines[i + 1]) > 2 * line.LONG
        if long or next_long or (size >= line.LEAST and (rolled >> 40) & line.MASK == 0) or size == line.MOST:
            out.append(i + 1)
    return out if out[-1] == len(lines) else [*out, len(lines)]


def test_chunk_boundaries():
    rng = np.random.default_rng(7)
    for n in (1, 2, 3, 17, 40, 200):
        for _ in range(30):
            lines = [b" ".join(b"w%d" % k for k in rng.integers(0, 9, 60 if rng.random() < 0.05 else 3)) for _ in range(n)]
            assert line.chunk_starts(lines) == brute_starts(lines)
    text = b"\n".join(lines)
    assert b"".join(line.chunks_of(text)) == text


# 9

def brute_near(texts, percent=85):
    sets = {}
    for key, text in texts.items():
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
        sets[key] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    keys = sorted(k for k in sets if sets[k])
    links = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = union_find(links, texts)
    return {k: (k, len(sets[k]), root[k], root[k] == k) for k in texts}


def test_near_duplicates(spark, sf):
    docs = documents(spark, sf)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in rng.integers(0, 5000, 300)]
    for k in range(40):  # a group whose members are linked through few of them
        copy = list(base)
        for at in rng.integers(0, 300, k % 9):
            copy[at] = f"edit{k}"
        texts[10_000 + k] = " ".join(copy)
    got = {r.doc_id: tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), part_docs=7).collect()}
    assert got == brute_near(texts)


@pytest.mark.parametrize("part", [dict(part_docs=25), dict(part_items=4_000)])
def test_near_duplicates_of_large_families(spark, part):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in rng.integers(0, 5000, 250)]
    second = [f"v{i}" if rng.random() < 0.03 else w for i, w in enumerate(base)]  # much like the first
    texts = {}
    for k in range(240):
        copy = list(base if k % 2 else second)
        for at in rng.integers(0, len(copy), k % 12):
            copy[at] = f"edit{rng.integers(0, 60)}"
        if k % 5 == 0:
            del copy[3 : 3 + k % 14]
        if k % 7 == 0:
            copy[9:9] = [f"more{i}" for i in range(k % 11)]
        texts[k * 3] = " ".join(copy)
    rows = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), bands=64, rows=4, **part).collect()
    assert {r.doc_id: tuple(r) for r in rows} == brute_near(texts)


@pytest.mark.parametrize("order", [1, -1])
def test_near_duplicates_with_equal_and_null_ids(spark, order):
    a, b = (" ".join(f"{x}{i}" for i in range(100)) for x in "ab")
    rows = [(1, a), (1, b), (2, f"{b} more"), (3, "other words that are like none of these at all"), (None, a), (None, a), (4, None), (4, ""), (5, a), (3, a)][::order]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), detail=True).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept, r.n_shingles) for r in got) == sorted(
        [(1, 1, True, 96), (1, 1, True, 96), (2, 1, False, 97), (3, 3, True, 6), (-1, -1, True, 96), (-1, -1, True, 96), (4, 4, True, 0), (4, 4, True, 0), (5, 1, False, 96), (3, 1, False, 96)])
    assert len({r.group for r in got if r.group is not None}) == 3
    assert len({r.text_hash for r in got if r.doc_id == 1}) == 2


def test_near_duplicates_odd_texts(spark):
    texts = [*ODD, "One two Three", "one  two\tthree", "one two three four five", "ONE two three four five six", "a"]
    rows = minhash.near_duplicates(odd(spark, texts)).collect()
    assert {r.doc_id: tuple(r) for r in rows} == brute_near(dict(enumerate(texts)))
    assert minhash.near_duplicates(odd(spark, [])).collect() == []


def test_sketch_is_filled_and_unbiased():
    rng = np.random.default_rng(0)
    with np.errstate(over="ignore"):
        for n in (1, 2, 30, 500):
            assert (minhash.sketch(np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)), 64) >> np.uint64(48) < 128).all()
        both = rng.integers(0, 2**63, 600, dtype=np.uint64)
        a, b = np.unique(both[:500]), np.unique(both[100:])
        assert abs((minhash.sketch(a, 2048) == minhash.sketch(b, 2048)).mean() - 400 / 600) < 0.05


# 10

def brute_suffix(texts, span=200):
    data = {k: (t or "").encode() for k, t in texts.items()}
    seen = Counter(hash(d[i : i + span]) for d in data.values() for i in range(len(d) - span + 1))  # 64 bits
    out = {}
    for k, d in data.items():
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - span + 1):
            if seen[hash(d[i : i + span])] > 1:
                gone[i : i + span] = True
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        edges = np.diff(np.r_[0, gone.astype(int)])
        out[k] = (k, len(d), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("options", [{}, {"hot": 3, "shard_bytes": 20_000}])
def test_suffix_dedup(spark, sf, options):
    docs = documents(spark, sf)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rng = np.random.default_rng(3)
    passage = "".join(rng.choice(list("abcdef "), 420))
    for k in range(12):
        texts[9_000 + k] = f"{k} own start {'x' * k}{passage[k : 400 + k]} end {k}"
    texts[9_100] = "periodic " * 60
    texts[9_101] = "ab" * 101
    texts[9_102] = "".join(rng.choice(list("xyz"), 200))
    got = {r.doc_id: tuple(r) for r in suffix.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), **options).collect()}
    assert got == brute_suffix(texts)


def test_suffix_dedup_odd_texts(spark):
    texts = [*ODD, "q" * 199, "q" * 200, "\u00e9" * 150]
    assert {r.doc_id: tuple(r) for r in suffix.remove_repeats(odd(spark, texts)).collect()} == brute_suffix(dict(enumerate(texts)))
    assert suffix.remove_repeats(odd(spark, [])).collect() == []


@pytest.mark.parametrize("options", [{}, {"hot": 2, "shard_bytes": 1_000}])
def test_suffix_dedup_with_null_and_equal_ids(spark, options):
    rng = np.random.default_rng(5)
    noise = lambda n: "".join(rng.choice(list("mnopqr "), n))
    passage = noise(500)
    rows = [(1, passage + noise(80)), (1, noise(900)), (2, passage), (None, f"{passage}{noise(50)}"), (None, noise(400)), (3, twin := noise(300)), (3, twin), (None, ""), (None, None)]
    want = brute_suffix({i: t for i, (_, t) in enumerate(rows)})
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    assert sorted(map(str, got)) == sorted(str(got[0].__class__(doc_id=rows[i][0], n_bytes=w[1], n_removed=w[2], n_spans=w[3], kept_sha256=w[4])) for i, w in want.items())
    names = suffix.remove_repeats(spark.createDataFrame([(f"{k}", t) for k, t in rows], "doc_id string, text string"), **options).collect()
    assert sorted(tuple(r)[1:] for r in names) == sorted(tuple(r)[1:] for r in got)


# 2

def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed = {}
    while True:
        rest = sum(sizes.values()) - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        target = {s: rest * w[s] / sum(w[f] for f in free) for s in free}
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return fixed | target
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mixing(spark, sf):
    docs = documents(spark, sf)
    rows = mixing.mix_plan(docs, shard_docs=7).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_plan(docs, shard_docs=7).collect()), key=str)
    texts = {r.doc_id: r for r in docs.collect()}
    sizes, taken = Counter(), Counter()
    for r in rows:
        assert r.size == len(words(texts[r.doc_id].text)) and 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = brute_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 5, s
    mixed = Counter()
    for r in mixing.mix(docs, shard_docs=7).collect():
        mixed[r.source] += len(words(r.text))
    assert mixed == +taken


def test_mixing_odd_texts(spark):
    rows = mixing.mix_plan(odd(spark)).collect()
    assert {r.doc_id: r.size for r in rows} == {i: len(words(t)) for i, t in enumerate(ODD)}
    assert mixing.mix_plan(odd(spark, [])).collect() == [] and mixing.mix(odd(spark, [])).collect() == []
    assert all(r.taken == 0 for r in mixing.mix_plan(odd(spark, ["", None])).collect())


def test_sainte_lague(spark):
    votes = {"a": 53_000.0, "b": 24_000.0, "c": 23_000.0, "d": 0.0, "e": 7.0}
    for seats in (0, 1, 7, 100):
        want = Counter()
        for _ in range(seats):
            best = max((p for p in votes if votes[p]), key=lambda p: (votes[p] / (2 * want[p] + 1), votes[p]))
            want[best] += 1
        got = mixing.sainte_lague(spark.createDataFrame([(p, v, seats) for p, v in votes.items()], "p string, votes double, seats long"), ["p"])
        assert {r.p: r.quota for r in got.collect() if r.quota} == dict(want)


# 5

def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 3 <> 0"))
    held = toxicity.expected_severity(docs.join(labels.where("doc_id % 3 = 0"), "doc_id"), model).select("toxic", "severity_toxic").collect()
    right = sum(r.toxic == r.severity_toxic for r in held) / len(held)
    false = sum(r.severity_toxic and not r.toxic for r in held)
    assert right >= 0.93 and false <= 2


def brute_severity(text, model):
    """Expected severity from the model's weights, with features counted in the plainest way."""
    chunks = [x for x in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode()) if x]
    seen = Counter()
    for chunk in chunks:
        for w in re.findall(r"[^\W\d_]+", chunk.decode("utf-8", "replace").lower()):
            seen.update([w] + [w[:n] + "*" for n in (4, 5, 6, 7, 8) if len(w) > n])
    z = sum(model.weights[model.index[f]] * (np.log1p(200 * n / max(1, len(chunks))) if f.endswith("*") else 1.0) for f, n in seen.items() if f in model.index)
    return float(sum(1 / (1 + np.exp(np.clip(t - z, -40, 40))) for t in model.thresholds))


def test_severity_by_brute_force(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text").unionByName(odd(spark).select((F.col("doc_id") + 100_000).alias("doc_id"), "text"))
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert model.index and len(model.thresholds) == 3
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.expected_severity(docs, model).collect():
        assert r.severity == pytest.approx(brute_severity(texts[r.doc_id], model), abs=1e-9) and r.severity_toxic == (r.severity >= 0.5)


def test_training_sample_is_settled(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "x" * 30), (3, None), (None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 0), (None, 1), (4, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.labelled_texts(docs, labels, 10, 20) == [(b"a", 1), (b"", 0)]
    assert toxicity.labelled_texts(docs, labels, 10, 64) == [(b"a", 1), (b"x" * 30, 1), (b"", 0)]


def test_ordinal_grades_are_ordered(spark):
    rng = np.random.default_rng(0)
    texts, grades = [], []
    for _ in range(600):
        g = int(rng.integers(0, 4))
        texts.append(" ".join([*(f"clean{chr(97 + i % 26) * (1 + i // 26)}" for i in rng.integers(0, 30, 12)), *(f"harsh{chr(97 + i)}" for i in rng.choice(12, 3 * g, replace=False))]).encode())
        grades.append(g)
    model = toxicity.fit_ordinal(texts[:500], grades[:500])
    assert (np.diff(model.thresholds) > 0).all()
    memo = toxicity.feature_memo(model.index)
    got = [model.severity(toxicity.document_features(t, memo)) for t in texts[500:]]
    assert np.abs(np.array(got) - grades[500:]).mean() < 0.35
    rows = toxicity.expected_severity(odd(spark), model).collect()
    assert len(rows) == len(ODD) and all(r.severity < 0.5 and r.key == "k" for r in rows)
    assert toxicity.expected_severity(odd(spark, []), model).collect() == []
    assert toxicity.fit_ordinal([], []).severity({}) < 0.01


def forged_pair():
    """Two unrelated texts of equal length with the same CRC-32, and the passage that the first begins with."""
    r = np.random.default_rng(4)
    passage = "\n".join(f"shared line {k} {k * k % 89}" for k in range(30))
    other = "".join(r.choice(list("abcdefgh \n"), len(passage)))
    tails = ["".join(x) for x in r.choice(list("klmnopqr"), (300_000, 9))]
    first = {zlib.crc32(t.encode(), zlib.crc32(passage.encode() + b"\n")): t for t in tails}
    tail, same = next((t, first[c]) for t in tails if (c := zlib.crc32(t.encode(), zlib.crc32(other.encode() + b"\n"))) in first)
    return f"{passage}\n{same}", f"{other}\n{tail}", passage


def test_texts_of_one_id_and_checksum_are_told_apart(spark):
    a, b, passage = forged_pair()
    assert zlib.crc32(a.encode()) == zlib.crc32(b.encode()) and a != b
    for doc_id in (1, None):
        docs = spark.createDataFrame([(doc_id, a), (doc_id, b), (2, passage)], "doc_id long, text string")
        got = Counter((r.n_bytes, r.n_removed) for r in suffix.remove_repeats(docs).collect())
        assert got == Counter([(len(a), len(passage)), (len(b), 0), (len(passage), len(passage))])
        for extend in (False, True):
            kept = Counter(r.text for r in line.dedup_lines(docs, extend=extend).collect())
            assert kept[b] == 1 and sum(kept.values()) == 3


@pytest.mark.parametrize("blank", [" ", "\n"])
def test_texts_of_over_a_megabyte(spark, blank):
    r = np.random.default_rng(6)
    words = ["".join(x) for x in r.choice(list("abcdefghij"), (150_000, 7))]
    long = blank.join(words)
    docs = spark.createDataFrame([(1, long), (2, long), (3, blank.join(words[:5000])), (4, "short")], "doc_id long, text string")
    assert len(long) > 1_000_000
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix.remove_repeats(docs).collect()}
    assert got == {1: (len(long), 1), 2: (len(long), 1), 3: (39_999, 1), 4: (0, 0)}
    kept = {r.doc_id: r.text for r in line.dedup_lines(docs, extend=True).collect()}
    assert kept[1] == long and kept[4] == "short" and kept[2] == "" and kept[3].strip() == ("" if blank == "\n" else blank.join(words[:5000]))
    near = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert near == {1: 1, 2: 1, 3: 3, 4: 4}
