"""Toxicity by cumulative-link ordinal regression: P(grade >= k) = sigmoid(w.x - threshold_k), one weight
vector for all thresholds, sparse binary text features (words and beginnings of words), and the expected
severity, the sum of these probabilities, as result.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.op06_token_counts import as_bytes, worker_memo
from parchment.llm.shared import Memo

LETTERS = re.compile(r"[^\W\d_]+")
SHARE = 200.0


def features_of(chunk: bytes, prefixes: tuple[int, ...] = (4, 5, 6, 7, 8)) -> list[str]:
    """Features of one blank-delimited chunk: its lower-case words and their beginnings (marked with *)."""
    out = []
    for word in LETTERS.findall(chunk.decode("utf-8", "replace").lower()):
        out.append(word)
        out += [f"{word[:n]}*" for n in prefixes if len(word) > n]
    return out


def document_features(text: bytes, memo: Memo) -> dict:
    """Values of the features of a text. A word counts 1 where it occurs; the beginning of a word, which chance also
    makes in long texts, counts by the log of its share of all words."""
    chunks = Counter(text.split())
    out: dict = {}
    for chunk, n in chunks.items():
        for f in memo[chunk]:
            out[f] = out.get(f, 0) + n
    total = max(1, sum(chunks.values()))
    share = memo.is_share
    return {f: math.log1p(SHARE * n / total) if share(f) else 1.0 for f, n in out.items()}


def feature_memo(index: dict[str, int] | None = None) -> Memo:
    """Features of chunks, by name, or by number for those in the index."""
    if index is None:
        memo = Memo(features_of, 30_000)
        memo.is_share = lambda f: f.endswith("*")
    else:
        memo = Memo(lambda c: [index[f] for f in features_of(c) if f in index])
        shares = {i for f, i in index.items() if f.endswith("*")}
        memo.is_share = shares.__contains__
    return memo


@dataclass
class OrdinalModel:
    index: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def severity(self, active) -> float:
        z = sum(self.weights[f] * x for f, x in active.items())
        return float((1 / (1 + np.exp(np.clip(self.thresholds - z, -40, 40)))).sum())


def fit_ordinal(texts: list[bytes], grades: list[int], most: int = 6_000, least: int = 4, margin: float = 1.0, steps: int = 300, l2: float = 1e-4, rate: float = 0.1) -> OrdinalModel:
    """Maximum likelihood by Adam over full batches. Features: the `most` with the strongest association (in
    absolute log-likelihood ratio) between presence and grade > 0, among those in at least `least` documents whose
    ratio exceeds the log of the number of features tried by `margin`, so that chance alone selects few."""
    y = np.array(grades, dtype=np.int64)
    top = int(y.max(initial=0))
    if not top or not (y == 0).any():
        return OrdinalModel({}, np.zeros(0), np.full(max(top, 1), 40.0 if not top else -40.0))
    # documents are counted in hashed slots first, then by name in slots with enough of them: most names occur once
    memo, slots = feature_memo(), np.zeros(1 << 22, np.uint16)
    slot = lambda f: zlib.crc32(f.encode()) & 0x3FFFFF
    for t in texts:
        found = np.unique(np.fromiter(map(slot, document_features(t, memo)), np.int64))
        slots[found] += slots[found] < 65_535
        memo.trim()
    inside, outside = Counter(), Counter()
    for t, g in zip(texts, grades, strict=True):
        (inside if g else outside).update(f for f in document_features(t, memo) if slots[slot(f)] >= least)
        memo.trim()
    n1, n0 = int((y > 0).sum()), int((y == 0).sum())

    def gain(f: str) -> float:
        a, b = inside[f], outside[f]
        p, p1, p0 = (a + b) / (n1 + n0), a / n1, b / n0
        ll = lambda k, n, q: (k * math.log(q) if k else 0.0) + ((n - k) * math.log(1 - q) if n > k else 0.0)
        return ll(a, n1, p1) + ll(b, n0, p0) - ll(a + b, n1 + n0, p)

    known = [f for f in inside.keys() | outside.keys() if inside[f] + outside[f] >= least]
    gains = {f: gain(f) for f in known}
    bar = math.log(max(1, len(known))) + margin
    kept = sorted((f for f in known if gains[f] >= bar), key=lambda f: (-gains[f], f))[:most]
    index = {f: i for i, f in enumerate(kept)}
    del inside, outside, known, gains
    few = feature_memo(index)
    own = []
    for t in texts:
        own.append(sorted(document_features(t, few).items()))
        few.trim()
    row, col = np.repeat(np.arange(len(own)), [len(x) for x in own]), np.array([i for x in own for i, _ in x], dtype=np.int64)
    value = np.array([x for pairs in own for _, x in pairs])
    balance = np.where(y > 0, 0.25 / n1, 0.75 / n0)  # a false alarm weighs more than a miss at equal numbers
    # parameters: weights, the first threshold, logs of the gaps to the next ones
    theta = np.zeros(len(kept) + top)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    k = np.arange(top)
    for step in range(1, steps + 1):
        w, cuts = theta[: len(kept)], np.cumsum(np.r_[theta[len(kept)], np.exp(theta[len(kept) + 1 :])])
        z = np.bincount(row, w[col] * value, len(y)) if len(col) else np.zeros(len(y))
        above = 1 / (1 + np.exp(np.clip(cuts[None] - z[:, None], -40, 40)))  # P(y >= k + 1)
        full = np.c_[np.ones(len(y)), above, np.zeros(len(y))]
        p = np.maximum(full[np.arange(len(y)), y] - full[np.arange(len(y)), y + 1], 1e-12)
        slope = above * (1 - above)
        sign = ((y[:, None] == k + 1).astype(float) - (y[:, None] == k)) * slope / p[:, None] * balance[:, None]  # d log p / d (z - cut_k)
        g_cut, g_z = -sign.sum(0), sign.sum(1)
        grad = np.r_[np.bincount(col, g_z[row] * value, len(kept)) if len(col) else np.zeros(len(kept)), np.zeros(top)]
        grad[len(kept)] = g_cut.sum()
        for j in range(1, top):
            grad[len(kept) + j] = g_cut[j:].sum() * np.exp(theta[len(kept) + j])
        grad[: len(kept)] -= l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    cuts = np.cumsum(np.r_[theta[len(kept)], np.exp(theta[len(kept) + 1 :])])
    return OrdinalModel(index, theta[: len(kept)], cuts)


def labelled_rows(docs: DataFrame, labels: DataFrame, rows: int, text_bytes: int, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> DataFrame:
    """(k, y, t) of at most `rows` labelled documents of at most `text_bytes` bytes each, those with the smallest hash of their id. Rows without id or
    label are left out; an id with several labels counts as toxic if one says so; of several texts of an id the smallest is used. Labels without such
    a document take no place in the sample."""
    told = labels.where(F.col(doc_id).isNotNull() & F.col(toxic).isin(0, 1)).groupBy(F.col(doc_id).alias("k")).agg(F.max(F.col(toxic).cast("int")).alias("y"))
    short = docs.select(F.col(doc_id).alias("k"), as_bytes(text).alias("t")).where(F.octet_length("t") <= text_bytes)
    few = told.join(short.select("k"), "k", "left_semi").orderBy(F.xxhash64("k"), "k").limit(rows)
    return short.join(F.broadcast(few), "k").groupBy("k", "y").agg(F.min("t").alias("t"))


def labelled_texts(docs: DataFrame, labels: DataFrame, rows: int, text_bytes: int) -> list[tuple[bytes, int]]:
    """labelled_rows() in order of k, on the driver."""
    return [(bytes(r.t), r.y) for r in sorted(labelled_rows(docs, labels, rows, text_bytes).collect(), key=lambda r: r.k)]


def severity_grades(texts: list[bytes], toxic: list[int]) -> list[int]:
    """Grades 0 to 3: 0 is not toxic; toxic documents are split at the thirds of their share of words that occur in
    at least three toxic and in no clean document of the sample."""
    memo = Memo(lambda c: [w for w in LETTERS.findall(c.decode("utf-8", "replace").lower())])
    inside, outside = Counter(), set()
    for t, y in zip(texts, toxic, strict=True):
        words = set().union(*map(memo.__getitem__, set(t.split())))
        inside.update(words) if y else outside.update(words)
    harsh = {w for w, n in inside.items() if n >= 3 and w not in outside}
    rate = [sum(1 for c in t.split() for w in memo[c] if w in harsh) / (1 + len(t.split())) if y else 0.0 for t, y in zip(texts, toxic, strict=True)]
    some = sorted(r for r, y in zip(rate, toxic, strict=True) if y)
    if not some:
        return [0] * len(texts)
    low, high = some[len(some) // 3], some[2 * len(some) // 3]
    return [(1 + (r > low) + (r > high)) if y else 0 for r, y in zip(rate, toxic, strict=True)]


def fitted(batches) -> Iterator[pa.RecordBatch]:
    """One row with the model of all rows (k, y, t), taken in order of k."""
    got = sorted(((k, y, t) for b in batches for k, y, t in zip(*(b.column(n).to_pylist() for n in ("k", "y", "t")))), key=lambda r: r[0])
    texts, toxic = [t for _, _, t in got], [y for _, y, _ in got]
    model = fit_ordinal(texts, severity_grades(texts, toxic))
    columns = [pa.array([c], t) for c, t in zip((list(model.index), model.weights, model.thresholds), (pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.float64())))]
    yield pa.RecordBatch.from_arrays(columns, ["names", "weights", "thresholds"])


def train(docs: DataFrame, labels: DataFrame, rows: int = 6_000, text_bytes: int = 65_536) -> OrdinalModel:
    """The model from at most `rows` labelled documents of at most `text_bytes` bytes (documented bounds of the sample it is fitted on: one task holds their
    texts; the driver gets features, weights and thresholds). Documents of any length are scored whole."""
    sample = labelled_rows(docs, labels, rows, text_bytes).repartition(1)
    found = sample.mapInArrow(fitted, "names array<string>, weights array<double>, thresholds array<double>").collect()
    if not found:  # no partition at all
        return fit_ordinal([], [])
    names, weights, thresholds = found[0]
    return OrdinalModel({f: i for i, f in enumerate(names)}, np.array(weights, dtype=float), np.array(thresholds, dtype=float))


def expected_severity(docs: DataFrame, model: OrdinalModel, text: str = "text", into: str = "severity", at: float = 0.5) -> DataFrame:
    """docs with `into` double (0 to the highest grade) and `into`_toxic boolean (severity >= at). An existing column of
    either name is replaced. Null and empty text: the severity of a text without features. Whole texts are read;
    repeated rows get equal values; an empty table gives an empty table."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def severity(texts: pd.Series) -> pd.Series:
        own = shared.value
        memo, out = worker_memo(("toxicity", own.key), lambda: feature_memo(own.index)), []
        for text in texts:
            out.append(own.severity(document_features(text, memo)))
            memo.trim()
        return pd.Series(out, dtype=float)

    severity = F.pandas_udf(severity, "double")
    return docs.withColumn(into, severity(as_bytes(text))).withColumn(f"{into}_toxic", F.col(into) >= at)
