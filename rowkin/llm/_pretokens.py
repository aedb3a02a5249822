"""Vectorised pre-tokenisation: Unicode classes, piece boundaries and the distinct pieces of a batch.

Both public BPE vocabularies split text into short pieces before any merge, so a batch needs only its distinct pieces
encoded; every occurrence is then a table lookup.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from rowkin.llm import _words

SPACES, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: The code points that the tokenizers' regular expressions call white space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    if not _classes:
        kinds = {"L": LETTER, "N": NUMBER}
        out = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        out[WHITE] = SPACES
        _classes.append(out)
    return _classes[0]


def classes_of(pre_tokenizer) -> np.ndarray:
    """Classes as the tokenizer's own rules have them: code points that Python's tables don't know are shown to it.

    A letter stays with a letter before it, another symbol with a symbol, a number with neither. Unassigned planes are left out.
    """
    out = classes().copy()
    unknown = [i for i in (*range(0x40000), *range(0xE0000, 0xF0000)) if unicodedata.category(chr(i)) == "Cn"]
    if unknown:
        spans = pre_tokenizer.pre_tokenize_str("".join(f"a{chr(i)} !{chr(i)} " for i in unknown))
        split = np.zeros(6 * len(unknown) + 1, bool)
        split[[start for _, (start, _) in spans]] = True
        with_letter, with_symbol = ~split[1::6], ~split[4::6]
        out[unknown] = np.where(with_letter, LETTER, np.where(with_symbol, OTHER, NUMBER))
    return out


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the rows' offsets counted in code points."""
    cps = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    ahead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=ahead[1:])
    return cps, ahead[offsets]


def contractions(cps: np.ndarray, kind: np.ndarray, begins: np.ndarray, at: np.ndarray):
    """(positions of apostrophes that open 's 't 'm 'd 're 've 'll, letters each takes)."""
    s, t, m, d, r, v, e, ll = (ord(x) for x in "stmdrvel")
    n = len(cps)
    at = at[(at + 1 < n)]
    at = at[(kind[at + 1] == LETTER) & ~begins[at + 1]]
    one = cps[at + 1]
    two = np.where((at + 2 < n) & ~begins[np.minimum(at + 2, n - 1)], cps[np.minimum(at + 2, n - 1)], 0)
    pair = ((one == r) & (two == e)) | ((one == v) & (two == e)) | ((one == ll) & (two == ll))
    single = (one == s) | (one == t) | (one == m) | (one == d)
    return at[single | pair], np.where(single, 1, 2)[single | pair]


def byte_level_starts(cps: np.ndarray, offsets: np.ndarray, kinds: np.ndarray | None = None) -> np.ndarray:
    """Starts of the byte-level pieces: a run of letters, digits or other symbols with one space before it, or spaces."""
    n = len(cps)
    kind = (classes() if kinds is None else kinds)[cps]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    begins = begins[:n]
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    start = change | begins
    ends_run = np.zeros(n, bool)
    ends_run[:-1] = (kind[1:] != SPACES) & ~begins[1:]
    last_space = (kind == SPACES) & ends_run
    start |= last_space
    joined = np.flatnonzero(last_space & (cps == 0x20)) + 1
    start[joined] = False
    lone = np.flatnonzero((cps == 0x27) & start)
    follows = np.ones(len(lone), bool)
    inside = lone + 1 < n
    follows[inside] = kind[lone[inside] + 1] != OTHER
    at, took = contractions(cps, kind, begins, lone[follows])
    start[at + 1] = False
    after = at + 1 + took
    after = after[after < n]
    start[after] = True
    return np.flatnonzero(start)


def word_level_spans(cps: np.ndarray, offsets: np.ndarray, kinds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of letter runs, single numbers and runs of other symbols; white space is dropped."""
    n = len(cps)
    kind = (classes() if kinds is None else kinds)[cps]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    begins = begins[:n]
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= begins | (kind == NUMBER)
    lone = np.flatnonzero((cps == 0x27) & start)
    follows = np.ones(len(lone), bool)
    inside = lone + 1 < n
    follows[inside] = start[lone[inside] + 1]
    at, took = contractions(cps, kind, begins, lone[follows])
    start[at + 1] = False
    after = at + 1 + took
    after = after[after < n]
    start[after] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    keep = kind[starts] != SPACES
    return starts[keep], ends[keep]


def distinct_pieces(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(hash of each distinct piece, a place of each, which one every piece is)."""
    hashes = _words.span_hashes(_words.mix(cps.astype(np.uint64) + np.uint64(0x51ED2701)), starts, ends)
    keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    return keys, first, which


class Memo:
    """Places of the keys seen so far, in order of arrival; sorted arrays, so a million keys take 16 MB."""

    def __init__(self):
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def places_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each of these distinct keys, indices of those that were new and got the next places)."""
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        out = np.empty(len(keys), np.int64)
        out[known] = self.places[at[known]]
        new = np.flatnonzero(~known)
        out[new] = len(self.keys) + np.arange(len(new))
        merged = np.concatenate([self.keys, keys[new]])
        order = np.argsort(merged, kind="stable")
        self.keys, self.places = merged[order], np.concatenate([self.places, out[new]])[order]
        return out, new


def gather(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + lens[i]] for every i, one after another."""
    ends = np.cumsum(lens)
    return values[np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)]


def piece_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of the pieces one after another, length of each) of spans counted in code points."""
    leads = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    lens = leads[ends] - leads[starts]
    return gather(data, leads[starts], lens), lens
