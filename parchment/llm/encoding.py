"""Token ids of whole texts, looked up part by part: parts that no token crosses are encoded once per worker and remembered."""

from __future__ import annotations

import json
import re
import sys
from array import array

import numpy as np

from parchment.llm.shared import Memo

#: A part begins at a space that follows anything but white space.
PART = re.compile(r"(?<=\S)(?= )")
BATCH = 8_192
TOGETHER = 512  # parts that are encoded as one text


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: visible Latin-1 signs stand for themselves, other bytes, in
    order, for the signs from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(other)}


LETTERS = byte_letters()


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class TextEncoder:
    """Ids of texts by a file for the tokenizers library (.json) or sentencepiece (.model), packed as little-endian uint32.

    plain: special strings inside texts are ordinary text (sentencepiece takes them so anyway); else they are tokens, as the library's default has it.
    A text is cut before spaces where the file allows it: byte-level files that part texts by their own pattern and change nothing,
    and pieces of which none holds a space after another sign, without normalisation. Otherwise whole texts are encoded.
    exact: parts whose tokens do not add up to their bytes have no ids, so that ids that add up to as many bytes as the text are those of its bytes.
    space: read a space before each text; pieces always are. A worker remembers `most` parts; when it has more, it forgets the half that came last, as frequent parts come early.
    """

    def __init__(self, path: str, plain: bool = False, exact: bool = False, most: int = 1_000_000, space: bool = False):
        self.led, self.raw = Memo(None, most), Memo(None, most)
        self.exact = exact
        self.spaced = space or path.endswith(".model")
        self.stands: list[bytes] = []
        self.sizes: np.ndarray | None = None
        self.pieces = path.endswith(".model")
        if self.pieces:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
            probe = " ".join(("a", "", "ééﬁ \t　Ａ", "b\n", ""))
            self.parted = not any(re.search("[^▁]▁", p) for p in names) and b"".join(map(self.token_bytes, self.model.encode(probe))) == f" {probe}".encode()
            self.space = self.model.piece_to_id("▁")
            self.marks = ("▁",)  # read as spaces
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()
            self.model.encode_special_tokens = plain
            told = json.loads(self.model.to_str())
            split = told["pre_tokenizer"] or {}
            self.parted = told["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
            self.marks = tuple(t["content"] for t in told["added_tokens"] if t["content"] and not (plain and t["special"]))

    def token_bytes(self, token: int) -> bytes:
        """What a token stands for in a text."""
        if self.pieces:
            piece = self.model.id_to_piece(token)
            return bytes([int(piece[3:-1], 16)]) if self.model.is_byte(token) else piece.replace("▁", " ").encode()
        entry = self.model.id_to_token(token) or ""
        return bytes(map(LETTERS.__getitem__, entry)) if LETTERS.keys() >= set(entry) else entry.encode()

    def spelled(self, ids: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        if not self.stands:
            self.stands = [self.token_bytes(i) for i in range(self.size())]
        return b"".join(map(self.stands.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def size(self) -> int:
        return self.model.get_piece_size() if self.pieces else self.model.get_vocab_size(with_added_tokens=True)

    def lengths(self) -> np.ndarray:
        """Number of bytes of each token."""
        return np.fromiter((len(self.token_bytes(i)) for i in range(self.size())), np.int64, self.size())

    def whole(self, texts: list[str]) -> list[bytes]:
        """The library's ids of whole texts."""
        out = []
        for at in range(0, len(texts), BATCH):
            some = texts[at : at + BATCH]
            ids = self.model.encode(some, num_threads=1) if self.pieces else [e.ids for e in self.model.encode_batch_fast(some, add_special_tokens=False)]
            out += map(packed, ids)
        return out

    def _learn(self, memo: Memo, keys: set[str], lead: str) -> None:
        """Ids of parts. Parts that a space leads are encoded many at a time: each begins where a token does, so token lengths tell them apart. Pieces get
        their leading space from the model itself."""
        keys = list(keys)
        alone = keys
        if lead:
            alone = []
            for at in range(0, len(keys), TOGETHER):
                alone += self._learn_together(memo, keys[at : at + TOGETHER])
        memo.update(zip(alone, self.whole([k if lead else k[1:] for k in alone] if self.pieces else [lead + k for k in alone]), strict=True))
        if self.pieces:
            memo.update((k, packed([self.space])) for k in alone if lead + k == " ")
        self._drop_changed(memo, alone, lead)

    def _learn_together(self, memo: Memo, keys: list[str]) -> list[str]:
        """Remember the ids of these words; returns those that must be encoded alone, as lengths of tokens do not add up to those of the words."""
        if self.sizes is None:
            self.sizes = self.lengths()
        text = " ".join(keys)
        (ids,) = self.whole([text if self.pieces else f" {text}"])
        ends, want = np.cumsum(self.sizes[np.frombuffer(ids, "<u4")]), np.cumsum([1 + len(k.encode()) for k in keys])
        at = np.searchsorted(ends, want)
        if not len(ends) or ends[-1] != want[-1] or (ends[at] != want).any() or (self.exact and self.pieces and self.spelled(ids) != f" {text}".encode()):
            return keys
        cuts = (4 * (at + 1)).tolist()
        memo.update((k, ids[a:b]) for k, a, b in zip(keys, [0, *cuts], cuts))
        return []

    def _drop_changed(self, memo: dict, keys: list, lead: str) -> None:
        """Parts whose tokens are other bytes get no ids. Byte-level tokens are the bytes of the text or fewer, which their lengths tell."""
        if self.exact and (self.pieces or not self.parted):
            memo.update((k, b"") for k in keys if self.spelled(memo[k]) != (lead + k).encode())

    def _wholes(self, texts: list[str | None]) -> list[bytes]:
        some = [t for t in texts if t]
        lead = " " if self.spaced else ""
        memo = dict(zip(some, self.whole(some if self.pieces else [lead + t for t in some]), strict=True))
        self._drop_changed(memo, list(memo), lead)
        return [memo[t] if t else b"" for t in texts]

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text, b"" for a null or empty one."""
        if not self.parted:
            return self._wholes(texts)
        led, raw, get = self.led, self.raw, self.led.get
        out: list = [b""] * len(texts)
        late, slow, missing, heads, whole = [], [], set(), set(), []
        for i, text in enumerate(texts):
            if not text:
                continue
            if any(m in text for m in self.marks):
                whole.append(i)
                continue
            words = text.split(" ")
            parts = list(map(get, words))
            if not self.spaced:
                parts[0] = raw.get(words[0]) if words[0] else None
            if None not in parts:
                out[i] = b"".join(parts)
                continue
            gaps = [k for k, p in enumerate(parts) if p is None]
            # an empty word or one that ends in white space: spaces meet white space, and the quick cut does not hold
            if any(not words[k] or words[k][-1].isspace() for k in gaps):
                words = PART.split(f" {text}" if self.spaced else text)
                heads.update(w for w in words if w not in raw)
                slow.append((i, words))
                continue
            if not self.spaced and gaps[0] == 0:
                heads.add(words[0])
                missing.update(words[k] for k in gaps[1:])
            else:
                missing.update(words[k] for k in gaps)
            late.append((i, words, parts, gaps))
        self._learn(led, missing, " ")
        self._learn(raw, heads, "")
        for i, words, parts, gaps in late:
            for k in gaps:
                parts[k] = led[words[k]] if k or self.spaced else raw[words[0]]
            out[i] = b"".join(parts)
        for i, words in slow:
            out[i] = b"".join(map(raw.__getitem__, words))
        if whole:
            for i, x in zip(whole, self._wholes([texts[i] for i in whole]), strict=True):
                out[i] = x
        led.trim()
        raw.trim()
        return out


def batched(values: list, sizes, most: int):
    """(from, to) of consecutive values whose sizes add up to about `most`; at least one at a time."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(values):
        yield at, len(values)
