"""Text as search sees it, with the way back to places in the original; plain Python for one text, called from Arrow batches."""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import numpy as np
import regex

# What is invisible, white space, punctuation folds, Greek names, pairs of opposite prefixes, words of negation.
INVISIBLE = frozenset(map(chr, (0x200B, 0x200C, 0x200D, 0xFEFF, 0x00AD)))
SPACE = frozenset(map(chr, (*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
PUNCTUATION = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "–": "-", "—": "-", "−": "-", "…": "..."}
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "θ": "theta", "λ": "lambda", "μ": "mu", "π": "pi", "σ": "sigma", "τ": "tau", "φ": "phi", "ω": "omega"}
OPPOSITES = (("brady", "tachy"), ("hyper", "hypo"), ("anti", "pro"), ("intra", "extra"), ("endo", "exo"))
NEGATIONS = frozenset(["no", "not", "without", "denies", "negative", "absent", "never"])
ALIKE = (frozenset("li1"), frozenset("o0"))
#: Pairs of letters that scans read for one, in the order in which they go.
SCANS = (("rn", "m"), ("vv", "w"), ("cl", "d"))

TOKEN = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}'-]*")


@lru_cache(maxsize=4096)
def fold(ch: str) -> str:
    """One character: punctuation variants, then compatibility forms; none beyond the basic plane."""
    return ch if ord(ch) > 0xFFFF else PUNCTUATION.get(ch) or "".join(PUNCTUATION.get(x, x) for x in unicodedata.normalize("NFKC", ch))


RUN = regex.compile("[" + "".join(map(regex.escape, sorted(SPACE))) + "]+")
#: A hyphen at a line break before a letter, which a compact text may lose.
BROKEN = regex.compile(r"-[^\S\n\r]*[\n\r]")


class Folded:
    """A text without invisible characters, each run of white space one space, characters folded; span() gives the place in the original of
    a part of `text`, in code points. `compact` has no spaces, nor a hyphen at a line break before a lower-case letter.

    Where every character is its own folded form, only runs of white space move places: those of other lengths than one are noted, and the
    rest is found by bisection. Other texts are walked sign by sign."""

    def __init__(self, original: str):
        self.place = self._at = None
        signs = set(original)
        if signs & INVISIBLE or any(fold(x) != x for x in signs - SPACE) or BROKEN.search(original):
            self._walk(original)
            return
        self.text = RUN.sub(" ", original)
        self.compact = self.text.replace(" ", "")
        # where a run of another length stands in the text, and how far places behind it are moved
        self._runs, self._moved, moved = [], [], 0
        if len(self.text) != len(original):
            for m in RUN.finditer(original):
                if m.end() - m.start() > 1:
                    self._runs.append(m.start() - moved)
                    moved += m.end() - m.start() - 1
                    self._moved.append(moved)

    def _walk(self, original: str) -> None:
        out, place, breaks, i, n = [], [], set(), 0, len(original)
        while i < n:
            ch, start = original[i], i
            i += 1
            if ch in INVISIBLE:
                continue
            if ch in SPACE:
                while i < n and original[i] in SPACE:
                    i += 1
                if any(x in "\n\r" for x in original[start:i]):
                    breaks.add(len(out))
                out.append(" ")
                place.append((start, i))
            else:
                for x in fold(ch):
                    out.append(x)
                    place.append((start, i))
        self.text, self.place = "".join(out), place
        at: list[int] = []
        for k, x in enumerate(out):
            if x != " ":
                at.append(k)
            elif at and out[at[-1]] == "-" and k in breaks and k + 1 < len(out) and out[k + 1].islower():
                at.pop()
        self._at, self.compact = at, "".join(out[k] for k in at)

    @property
    def compact_at(self) -> list[int]:
        """The place in `text` of each sign of `compact`."""
        if self._at is None:
            self._at = [k for k, x in enumerate(self.text) if x != " "]
        return self._at

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Places in the original of text[start:end]."""
        if self.place is not None:
            return self.place[start][0], self.place[end - 1][1]
        before = bisect_left(self._runs, start)  # runs before `start` move it; those up to `end` move the end
        upto = bisect_left(self._runs, end)
        return start + (self._moved[before - 1] if before else 0), end + (self._moved[upto - 1] if upto else 0)

    def compact_span(self, start: int, end: int) -> tuple[int, int]:
        return self.span(self.compact_at[start], self.compact_at[end - 1] + 1)

    def tokens(self) -> list[tuple[str, int, int]]:
        """Lower-case words with their places in `text`."""
        return [(m[0].lower(), *m.span()) for m in TOKEN.finditer(self.text)]


def lower_each(text: str) -> str:
    """Lower case character by character where that keeps the length, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x.lower() if len(x.lower()) == 1 else x for x in text)


def named_greek(text: str) -> tuple[str, list[int]]:
    """Greek letters to names, hyphens dropped; with the place in `text` of each character."""
    out, at = [], []
    for k, ch in enumerate(text):
        if ch != "-":
            name = GREEK.get(ch, ch)
            out.append(name)
            at.extend([k] * len(name))
    return "".join(out), at


def scan_fold(text: str) -> str:
    for pair, one in SCANS:
        text = text.replace(pair, one)
    return text


def weighted_distance(a: str, b: str, limit: float = float("inf")) -> float:
    """Edit distance after folding pairs that scans confuse; letters alike in print cost 0.4. Beyond `limit` any larger number may return."""
    a, b = scan_fold(a), scan_fold(b)
    if not a or not b:
        return float(len(a) + len(b))
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], float(i)
        for j, y in enumerate(b, 1):
            cost = 0.0 if x == y else 0.4 if any(x in s and y in s for s in ALIKE) else 1.0
            best = last if cost == 0.0 else min(last + cost, row[j] + 1, row[j - 1] + 1)
            last, row[j] = row[j], best
        if min(row) > limit:
            return float("inf")
    return row[-1]


@lru_cache(maxsize=65_536)
def bag(text: str) -> Counter:
    """How often each letter stands in a text as scans read it, letters alike in print as one."""
    return Counter(scan_fold(text).translate({ord("l"): "1", ord("i"): "1", ord("o"): "0"}))


@lru_cache(maxsize=65_536)
def similarity(a: str, b: str, floor: float = 0.0) -> float:
    """1 less the distance over the longer, not folded, length; 0 where it is below `floor`. The distance is at least what letters one text has more
    of than the other, which settles most pairs before it is computed."""
    longest = max(len(a), len(b), 1)
    x, y = bag(a), bag(b)
    if max((x - y).total(), (y - x).total()) > (1 - floor) * longest + 1e-9:
        return 0.0
    value = max(0.0, 1 - weighted_distance(a, b, (1 - floor) * longest + 1e-9) / longest)
    return value if value >= floor else 0.0


def weighted_distances(a: str, texts: list[str]) -> np.ndarray:
    """weighted_distance(a, b) of many texts at once: one step of the table is a vector over all of them."""
    a, folded = scan_fold(a), [scan_fold(t) for t in texts]
    size = np.fromiter(map(len, folded), np.int64, len(folded))
    width = int(size.max(initial=0))
    codes = np.zeros((len(folded), width), np.uint32)
    codes[np.arange(width) < size[:, None]] = np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), "<u4")
    row = np.repeat(np.arange(width + 1, dtype=float)[:, None], len(folded), axis=1)
    for i, x in enumerate(a, 1):
        near = np.zeros(codes.shape, bool)
        for same in (s for s in ALIKE if x in s):
            near |= np.isin(codes, list(map(ord, same)))
        cost = np.where(codes == ord(x), 0.0, np.where(near, 0.4, 1.0)).T
        last = row
        row = np.empty_like(last)
        row[0] = i
        for j in range(1, width + 1):
            row[j] = np.minimum(np.minimum(last[j - 1] + cost[j - 1], last[j] + 1), row[j - 1] + 1)
    return row[size, np.arange(len(folded))] if a else size.astype(float)


def similarities(a: str, texts: list[str]) -> np.ndarray:
    """similarity(a, b) of many texts at once."""
    longest = np.maximum(np.fromiter(map(len, texts), np.int64, len(texts)), max(len(a), 1))
    return np.maximum(0.0, 1 - weighted_distances(a, texts) / longest)


def opposite(a: str, b: str) -> bool:
    return any((a.startswith(x) and b.startswith(y)) or (a.startswith(y) and b.startswith(x)) for x, y in OPPOSITES)


def negation_differs(a: list[str], b: list[str]) -> bool:
    return NEGATIONS.isdisjoint(a) != NEGATIONS.isdisjoint(b)
