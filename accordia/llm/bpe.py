"""Public tokenizers' ids of whole texts, by the tokenizers library, with a memo of words.

Byte-pair merges never cross the words of a tokenizer's own splitting pattern, so the ids of the words, one after
another, are the ids of the text. Each distinct word goes through the library once while it is remembered. Texts of
Latin letters are split all at once, by arrays of their bytes' kinds, and only their distinct words are looked up.

Strings of special tokens in a text are ordinary text, as the tokenizers' own notes have it (encode_special_tokens).
"""

from __future__ import annotations

import unicodedata
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from . import common

#: Words remembered by a worker at most, unless it is told otherwise; then the memo starts anew.
MEMO = 450_000
#: The splitting patterns of the two kinds of tokenizer files.
BYTE_LEVEL = regex.compile(public_tokenizers.PATTERN)
WORD_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
OTHER, LETTER, DIGIT, SPACE = range(4)
#: Kinds of the bytes of Latin texts: ASCII without control characters but white space, and the letters from À to ÿ (bytes C3 80 to C3 BF).
KIND = np.full(256, OTHER, np.uint8)
KIND[[*range(65, 91), *range(97, 123), *range(128, 192), 0xC3]] = LETTER
KIND[48:58] = DIGIT
KIND[[32, *range(9, 14)]] = SPACE
FOREIGN = np.ones(256, bool)
FOREIGN[[*range(9, 14), *range(32, 127), *range(128, 192), 0xC3]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def latin(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text between the places `at` is Latin; × and ÷ are not, though their bytes look like it."""
    bad = FOREIGN[raw]
    sign = np.flatnonzero(raw[:-1] == 0xC3)
    bad[sign[(raw[sign + 1] == 0x97) | (raw[sign + 1] == 0xB7)]] = True
    out = np.ones(len(at) - 1, bool)
    out[np.searchsorted(at, np.flatnonzero(bad), side="right") - 1] = False
    return out


def lowered(raw: np.ndarray) -> np.ndarray:
    """Latin bytes in lower case."""
    out = LOWER[raw]
    second = np.flatnonzero(raw[:-1] == 0xC3) + 1
    upper = second[(raw[second] < 0x9F)]
    out[upper] += 32
    return out


def starts(raw: np.ndarray, at: np.ndarray, by_word: bool) -> tuple[np.ndarray, np.ndarray]:
    """Whether a word of the splitting pattern, or (by_word) a run of white space, starts at each byte of Latin texts; and
    the bytes' kinds. at: where texts start, with the end."""
    n = len(raw)
    kind = KIND[raw]
    first = np.zeros(n + 4, bool)
    first[at] = True
    edge = np.zeros(n + 4, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge |= first
    if by_word:
        edge[:n] |= kind == DIGIT
    else:
        # the last character of white space before a word: a space joins the word, any other stands alone
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n])
        edge[last] = True
        edge[last[raw[last] == 32] + 1] = False
    # an apostrophe that starts a word, with the letters of a contraction
    wide = np.concatenate([raw, np.zeros(4, np.uint8)])
    q = np.flatnonzero((raw == 39) & edge[:n])
    a, b = wide[q + 1], wide[q + 2]
    one = q[np.isin(a, [*b"stmd"]) & ~first[q + 1]]
    two = q[(((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)) & ~first[q + 1] & ~first[q + 2]]
    edge[one + 1] = edge[two + 1] = False
    edge[one + 2] = edge[two + 3] = True
    return edge[:n], kind


#: Byte-level tokenizers' characters for bytes: printable ones of Latin-1 for themselves, the others from U+0100 on; 0 separates words here.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPELLING = {chr(b): chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in PRINTED) if b}


class Encoder:
    """encode(texts): all ids, one text's after another's, and how many each text has; null and empty: none."""

    def __init__(self, path: str, room: int = MEMO):
        self.room = room
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.tok.no_padding()
        self.tok.no_truncation()
        self.by_word = self.tok.normalizer is not None
        self.find = (WORD_LEVEL if self.by_word else BYTE_LEVEL).findall
        self.memo: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def words(self, text: str) -> list[str]:
        """The words of any text, by the pattern itself."""
        if self.by_word:
            if "Σ" in text:  # its lower case depends on its place, here but not in the library
                text = self.tok.normalizer.normalize_str(text)
            else:
                text = unicodedata.normalize("NFC", text)
            text = text.lower()
        return self.find(text)

    def latin_words(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray]:
        """The words of Latin texts as codes, the distinct words, and how many words each text has."""
        if not len(raw):
            return np.zeros(0, np.int64), [], np.zeros(len(at) - 1, np.int64)
        if self.by_word:
            raw = lowered(raw)
        edge, kind = starts(raw, at, self.by_word)
        if self.by_word:
            inside = kind != SPACE
            edge &= inside
            # white space is left out, so that words follow one another
            place = np.concatenate([[0], np.cumsum(inside)])
            first = np.flatnonzero(edge)
            cuts, raw = np.append(place[first], place[-1]), raw[inside]
        else:
            first = np.flatnonzero(edge)
            cuts = np.append(first, len(raw))
        return *common.spans(raw, cuts), np.diff(np.searchsorted(first, at))

    def learn(self, new: list[str]) -> None:
        """Words' ids by the library's merges alone: they are split already, and their bytes are spelled as it spells them."""
        merge, memo = self.tok.model.tokenize, self.memo
        spelled = "\0".join(new).encode().decode("latin-1")
        for c in set(spelled).intersection(SPELLING):
            spelled = spelled.replace(c, SPELLING[c])
        spelled = spelled.split("\0")
        if len(spelled) == len(new):
            for word, own in zip(new, spelled, strict=True):
                memo[word] = array("I", [t.id for t in merge(own)]).tobytes()
        else:  # one of them holds the separator
            memo.update((word, self.whole(word)) for word in new)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, at = common.text_bytes(texts)
        plain, size = latin(raw, at), np.diff(at)
        if plain.all():
            codes, distinct, n = self.latin_words(raw, at)
            odd = []
        else:
            own = size[plain]
            codes, distinct, n = self.latin_words(raw[np.repeat(plain, size)], np.append(0, np.cumsum(own)))
            odd = [self.words(raw[a:b].tobytes().decode()) for a, b in zip(at[:-1][~plain].tolist(), at[1:][~plain].tolist(), strict=True)]
        ids = list(map(self.memo.get, distinct))
        new = {w for w, i in zip(distinct, ids, strict=True) if i is None}.union(*odd).difference(self.memo)
        if new:
            if len(self.memo) + len(new) > self.room:
                self.memo.clear()
                new = set(distinct).union(*odd)
            self.learn(list(new))
            ids = list(map(self.memo.__getitem__, distinct))
        each = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        counts = each[codes]
        flat = common.gather(np.frombuffer(b"".join(ids), "<u4"), (np.cumsum(each) - each)[codes], counts)
        ends = np.append(0, np.cumsum(counts))[np.append(0, np.cumsum(n))]
        if not odd:
            return flat, np.diff(ends)
        mine = iter(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        other = iter(odd)
        parts = [flat[slice(*next(mine))] if ok else np.frombuffer(b"".join(map(self.memo.__getitem__, next(other))), "<u4") for ok in plain.tolist()]
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        ids, n = self.encode(pa.array(texts, pa.large_string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])] if len(n) else []


def with_ends(ids: np.ndarray, n: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of texts with an end after each."""
    ends = np.cumsum(n + 1) - 1
    out = np.full(len(ids) + len(n), end_id, "<u4")
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = ids
    return out, n + 1


_loaded: dict[str, Encoder] = {}


def encoder(path: str, room: int = MEMO) -> Encoder:
    """One for each worker and file. path: a file's path, or a name that public_tokenizers knows; room: words remembered."""
    if path not in _loaded:
        _loaded[path] = Encoder(path if "/" in path else str(public_tokenizers.path(path)), room)
    return _loaded[path]
