"""Token counts by a two-tier lookup on the map side: a broadcast table of the corpus' frequent
pre-tokens and their lengths, and a cache in each Python worker for the rest.

A pre-token is a maximal run of bytes other than ASCII white space. The tokenizer drops white space
and none of its matches spans any, so the lengths of the pre-tokens add up to the text's.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.llm.shared import Memo, portions
from parchment.operators.page_index import slices, text_bytes

#: Bytes of text whose unknown pre-tokens are encoded together.
TOGETHER = 1 << 20
_WORKER: dict = {}


def worker_memo(key, make):
    """The memo of this name in this Python worker; memos of other operators are dropped, so that one is held at a time."""
    for k in [k for k in _WORKER if isinstance(k, tuple) and k != key]:
        del _WORKER[k]
        pa.default_memory_pool().release_unused()
    if key not in _WORKER:
        _WORKER[key] = make()
    return _WORKER[key]


def byte_sizes(tok) -> np.ndarray | None:
    """How many bytes of a text each token of a byte-level file stands for; None for other files."""
    told = json.loads(tok.to_str())
    split = told["pre_tokenizer"] or {}
    if "ByteLevel" not in {p.get("type") for p in (split, *split.get("pretokenizers", ()))} or told["model"].get("continuing_subword_prefix"):
        return None
    suffix, added = told["model"].get("end_of_word_suffix") or "", {t["id"]: len(t["content"].encode()) for t in told["added_tokens"]}
    sizes = np.zeros(1 + max((*tok.get_vocab().values(), 0)), np.int64)
    for token, i in tok.get_vocab().items():
        sizes[i] = added.get(i, len(token.removesuffix(suffix) if suffix else token))
    return sizes


def id_lists(ids: list[int], ends: np.ndarray) -> list[list[int]]:
    """Ids of words that end at `ends`."""
    cuts = ends.tolist()
    return [ids[a:b] for a, b in zip([0, *cuts], cuts)]


def id_counts(ids: list[int], ends: np.ndarray) -> list[int]:
    """How many ids words have that end at `ends`."""
    return np.diff(ends, prepend=0).tolist()


def encoded_together(words: list[str], alone, normalizer, sizes: np.ndarray, form=id_lists) -> list:
    """Ids of words, for a file whose tokens never span white space: as one text of many words, which the bytes of its tokens part again. Where these
    do not add up to the words as the file normalizes them, and for words that hold white space of another kind, each word is encoded alone.
    form(ids, ends) gives what is returned for words, many at a time."""
    out: dict[str, list[int]] = {}
    for kind in ([w for w in words if w.isascii()], [w for w in words if not w.isascii()]):
        for at in range(0, len(kind), 512):
            some = kind[at : at + 512]
            text = " ".join(some)
            if text.split() != some:
                some = [w for w in some if len(w.split()) == 1]
                text = " ".join(some)
            read = some if normalizer is None or text.isascii() else normalizer.normalize_str(text).split(" ")
            if not some or len(read) != len(some):
                continue
            ids, want = alone([text])[0], np.cumsum([*map(len, read if text.isascii() else map(str.encode, read))])
            ends = np.cumsum(sizes[ids])
            cuts = np.searchsorted(ends, want)
            if len(ends) and ends[-1] == want[-1] and (ends[cuts] == want).all():
                out.update(zip(some, form(ids, cuts + 1)))
    left = [w for w in words if w not in out]
    out.update(zip(left, (form(ids, np.array([len(ids)]))[0] for ids in alone(left))))
    return [out[w] for w in words]


def encoder(path: str):
    """A function from a list of byte strings to lists of token ids, or what `form` makes of them; one tokenizer per worker and file."""
    if path not in _WORKER:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            alone, sizes = (lambda texts: model.encode(texts, num_threads=1)), None
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            alone = lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
            sizes = None if reading(path).whole else byte_sizes(tok)

        def encode(texts: list[bytes], form=id_lists) -> list:
            said = [t.decode("utf-8", "replace") for t in texts]
            if sizes is not None:
                return encoded_together(said, alone, tok.normalizer, sizes, form)
            return [form(ids, np.array([len(ids)]))[0] for ids in alone(said)]

        _WORKER[path] = encode
    return _WORKER[path]


@dataclass(frozen=True)
class Reading:
    """How a tokenizer file reads texts. whole: texts can't be parted at white space. fold: it lower-cases, and parts letters from full
    stops and commas. marks: its added strings in lower case, which it finds inside words."""

    whole: bool
    fold: bool
    marks: tuple[bytes, ...]


def reading(path: str) -> Reading:
    """Asked of the tokenizer itself: whether its pre-tokens ever hold white space, and what it does to capitals and punctuation."""
    if path.endswith(".model"):
        return Reading(True, False, ())
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    split = (lambda t: tok.pre_tokenizer.pre_tokenize_str(t)) if tok.pre_tokenizer else (lambda t: [(t, (0, len(t)))])
    kinds = ("a", "B", "1", ".", "(", "'s", "\u00e9", "\u4e2d")
    probe = "".join(f"{x}{blank}{y}" for x in kinds for y in kinds for blank in (*" \t\n\x0b\x0c\r", "  "))
    marks = tuple(sorted(t.content.lower().encode() for t in tok.get_added_tokens_decoder().values() if t.content))
    whole = any(set(probe[a:b]) & set(" \t\n\x0b\x0c\r") for _, (a, b) in split(probe)) or any(len(m.split()) != 1 for m in marks)
    lower = tok.normalizer is not None and tok.normalizer.normalize_str("AZaz") == "azaz"
    return Reading(whole, lower and all(len(split(f"a{x}")) == 2 for x in ".,"), marks)


def pretokens(text: bytes, how: Reading) -> list[bytes]:
    """The pre-tokens of a text; where the tokenizer folds, A-Z are lower-cased (so that one entry serves both), unless the text might hold
    an added string, whose case counts. The tokenizer composes letters before it lower-cases them, and some compose in lower case only: where a
    text holds marks that A-Z compose with (U+0300 to U+036F, bytes CC and CD), only pre-tokens of pure ASCII are folded."""
    if how.whole:
        return [text] if text else []
    if not how.fold:
        return text.split()
    low = text.lower()
    if any(m in low for m in how.marks):
        return text.split()
    if low.isascii() or (b"\xcc" not in low and b"\xcd" not in low):
        return low.split()
    return [w if w.isascii() else o for w, o in zip(low.split(), text.split(), strict=True)]


def learn(known: Memo, words, encode, form, fold: bool) -> None:
    """Add the words that `known` lacks. What `form` gives must be additive: a word that ends in a single full stop or comma after a
    letter is the sum of both, as punctuation is a pre-token of its own."""
    new = {w for w in words if w not in known}
    if not new:
        return
    split = [w for w in new if fold and len(w) > 1 and w[-1] in b".," and 97 <= w[-2] <= 122]
    ask = list({w[:-1] for w in split if w[:-1] not in known} | {p for p in (b".", b",") if split and p not in known} | new.difference(split))
    for at in range(0, len(ask), 4096):
        part = ask[at : at + 4096]
        known.update(zip(part, encode(part, form), strict=True))
    for w in split:
        known[w] = known[w[:-1]] + known[w[-1:]]


def looked_up(batch: pa.RecordBatch, column: int, how: Reading, first: dict, known: Memo, encode, form) -> Iterator[tuple[int, list]]:
    """For each text of a column its row, and what `form` gives for its pre-tokens, as `first` or `known` have it. What both lack is learned for a
    megabyte of texts at a time."""
    row = 0
    for some in slices(batch, text_bytes(batch.column(column)), TOGETHER):
        texts = [pretokens(t.as_py(), how) for t in some.column(column)]
        words = list(chain.from_iterable(texts))
        if how.whole:
            parts = encode(words, form)
        else:
            parts = list(map(first.get, words))
            gaps = [k for k, p in enumerate(parts) if p is None]
            learn(known, [words[k] for k in gaps], encode, form, how.fold)
            for k in gaps:
                parts[k] = known[words[k]]
            known.trim()
        at = 0
        for text in texts:
            yield row, parts[at : at + len(text)]
            row, at = row + 1, at + len(text)


def as_bytes(column: str) -> Column:
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def frequent_pretokens(docs: DataFrame, how: Reading, text: str = "text", most: int = 32_768, per_task: int = 4_096, fan_in: int = 64) -> list[bytes]:
    """The `most` pre-tokens with the largest counts over all documents. Each task counts all it reads and hands on a table
    of its `per_task` largest; tables are merged `fan_in` at a time, by the numbers of their tasks, until one is left. No
    pre-token is ever the key of a shuffle, and what a merge or the driver holds is bounded. The choice affects speed only, never a count."""
    schema = "g int, w binary, n long"

    def table(g: int, seen: Counter, size: int) -> pa.Table:
        top = [(k, n) for k, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:size]]
        return pa.table({"g": pa.array([g] * len(top), pa.int32()), "w": pa.array([k for k, _ in top], pa.binary()), "n": pa.array([n for _, n in top], pa.int64())})

    def largest(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(pretokens(text.as_py(), how))
            if len(seen) > 500_000:
                seen = Counter(dict(seen.most_common(100_000)))
        yield from table(0, Counter({k: n for k, n in seen.items() if n > 1 and len(k) <= 64}), per_task).to_batches()

    def merge(part: pa.Table) -> pa.Table:
        seen: Counter = Counter()
        for w, n in zip(part["w"].to_pylist(), part["n"].to_pylist(), strict=True):
            seen[w] += n
        return table(part["g"][0].as_py(), seen, most)

    rows = docs.select(as_bytes(text).alias("t"))
    tables = rows.rdd.getNumPartitions()
    counts = rows.mapInArrow(largest, schema).withColumn("g", F.spark_partition_id())
    while tables > 1:
        counts = counts.withColumn("g", F.floor(F.col("g") / fan_in).cast("int")).groupBy("g").applyInArrow(merge, schema)
        tables = -(-tables // fan_in)
    return [bytes(r.w) for r in counts.orderBy(F.desc("n"), "w").collect()]


def token_counts(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes long, n_tokens long, over_limit boolean.

    tokenizer: a file for the tokenizers library (.json) or for sentencepiece (.model), at the same path on every executor.
    Where its pieces cross white space the whole text is one pre-token (see reading). Null text: 0 bytes, 0 tokens. Nulls in other columns and extra
    columns play no part; repeated rows are counted each by itself; an empty table gives an empty table.
    Special strings inside a text are tokens, as the library reads them by default.
    """
    spark = docs.sparkSession
    how = reading(tokenizer)
    common = [] if how.whole else frequent_pretokens(docs, how, text)
    table = spark.sparkContext.broadcast({w: len(ids) for w, ids in zip(common, encoder(tokenizer)(common), strict=True)} if common else {})

    def count(batches):
        encode = encoder(tokenizer)
        tier, rest = table.value, worker_memo(("lengths", tokenizer), lambda: Memo(None))
        for batch in portions(batches, 2):
            out = [sum(parts) for _, parts in looked_up(batch, 2, how, tier, rest, encode, id_counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), as_bytes(text).alias("t"))
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
