"""Token ids of whole texts by the ``tokenizers`` library.

A text is cut before blanks that follow a non-blank, and between a Latin
letter or digit and a full stop or comma; neither a pre-tokeniser pattern
nor a normaliser of the supported files reaches over such a place, so the
ids of the parts, one after the other, are the ids of the text. Parts
repeat a lot, and each worker asks the library once for a part it hasn't
seen; parts are known by 64-bit hashes (sums of bytes times fixed random
factors by place). Texts with any other white space than blank, tab and
line ends are encoded whole. tests/llm compares with whole-text encoding.

Most parts are a blank and Latin letters, which every pre-tokeniser takes as
one word. For these the library runs without its normaliser and splitter:
the blank and capitals are dealt with before, and the mark that the
vocabulary sets at a word's end or start tells the words' ids apart. A
tokenizer file for which this isn't so on a few probes goes the plain way.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import text_groups

_ODD = re.compile("[^\\S \t\n\r]|[\u180e\u200b\ufeff]")
#: Bytes that a text with odd white space has at least one of.
_ODD_BYTES = bytes([0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF])
_BLANK, _STOP, _ALNUM = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t\n\r")] = _BLANK
_KIND[list(b".,")] = _STOP
_KIND[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = _ALNUM
_FACTOR = np.random.default_rng(11).integers(1, 1 << 63, 1 << 12, np.uint64) * np.uint64(2) + np.uint64(1)


_PLAIN = re.compile(" [A-Za-zÀ-ÖØ-öø-ÿ]+")
_PROBES = [" the", " Words", " UNDERSTANDING", " Été", " xqzzyß", " a"]


def _odd(text: str, raw: bytes) -> bool:
    return len(raw.translate(None, _ODD_BYTES)) < len(raw) and _ODD.search(text) is not None


def part_starts(raw: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where parts begin in the joined bytes of texts that begin at ``texts``."""
    kind = _KIND[raw]
    blank, stop = kind == _BLANK, kind == _STOP
    cut = np.zeros(len(raw) + 1, bool)
    cut[1:-1] = blank[1:] & ~blank[:-1]
    latin = np.zeros(len(raw), bool)                     # ends a letter from U+00C0 to U+00FF
    latin[1:] = (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    cut[1:-1] |= stop[1:] & (latin | (kind == _ALNUM))[:-1]
    cut[texts] = True
    return np.flatnonzero(cut[:-1])


def part_hashes(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    place = np.arange(len(raw)) - np.repeat(starts, sizes)
    factor = _FACTOR[place & (len(_FACTOR) - 1)]
    if len(sizes) and sizes.max() > len(_FACTOR):
        factor = factor * ((place >> 12).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    h = np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * factor, starts)
    return h ^ (h >> np.uint64(31))


class PartTokenizer:
    """Encodes texts part by part; forgets all parts beyond ``most_parts`` (about 50 bytes
    each). With ``plain`` the strings of special tokens are ordinary text."""

    def __init__(self, path: str, most_parts: int = 1_000_000, plain: bool = False):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        self.bare = Tokenizer(self.library.model)            # the same model, without the rest
        self.most_parts = most_parts
        self._forget()
        kind = json.loads(self.library.to_str())
        self.lower = "Lowercase" in json.dumps(kind["normalizer"])
        self.bare.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.suffix = kind["model"].get("end_of_word_suffix") or ""
        vocabulary = self.library.get_vocab()
        self.mark = np.zeros(max(vocabulary.values()) + 1, bool)
        self.mark[[i for t, i in vocabulary.items()
                   if (t.endswith(self.suffix) if self.suffix else t.startswith("Ġ"))]] = True
        slow, fast = self._encode_any(_PROBES), self._encode_plain(_PROBES)
        self.plain = fast is not None and all(np.array_equal(x, y) for x, y in zip(slow, fast))

    odd = staticmethod(_odd)
    part_starts = staticmethod(part_starts)

    def _forget(self) -> None:
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)     # by hash
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)       # by number
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _encode_any(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the parts, and the number of ids of each."""
        got = self.library.encode(parts, is_pretokenized=True, add_special_tokens=False)
        if not got.ids:
            return np.zeros(0, np.uint32), np.zeros(len(parts), np.int64)
        return np.asarray(got.ids, np.uint32), np.bincount(np.asarray(got.word_ids, np.int64), minlength=len(parts))

    def _encode_plain(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The same for parts that match ``_PLAIN``; None if the marks don't tell them apart."""
        if self.suffix:
            parts = [p[1:].lower() if self.lower else p[1:] for p in parts]
        elif self.lower:
            parts = [p.lower() for p in parts]
        ids = np.asarray(self.bare.encode_batch_fast([parts], is_pretokenized=True,
                                                     add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(self.mark[ids])
        edge = np.concatenate(([0], at + 1)) if self.suffix else np.append(at, len(ids))
        return (ids, np.diff(edge)) if len(at) == len(parts) and edge[0] == 0 and edge[-1] == len(ids) else None

    def _groups(self, parts: list[str]):
        """(which of the parts, all their ids, the number of ids of each) until all are told."""
        plain = np.fromiter((self.plain and _PLAIN.fullmatch(p) is not None for p in parts), bool, len(parts))
        got = self._encode_plain([p for p, k in zip(parts, plain.tolist()) if k]) if plain.any() else None
        if got is None:
            plain[:] = False
        for mask, own in ((plain, got), (~plain, None)):
            if mask.any():
                yield mask, *(own or self._encode_any([p for p, k in zip(parts, mask.tolist()) if k]))

    def _encode_whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _learn(self, hashes: np.ndarray, parts: list[str]) -> None:
        first, count = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        for mask, ids, n in self._groups(parts):
            if mask.any():
                while self.used + len(ids) > len(self.ids):
                    self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
                self.ids[self.used:self.used + len(ids)] = ids
                first[mask], count[mask] = self.used + np.cumsum(n) - n, n
                self.used += len(ids)
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.number = np.insert(self.number, at, np.arange(len(self.count), len(self.count) + len(parts)))
        self.first, self.count = np.concatenate((self.first, first)), np.concatenate((self.count, count))

    def _numbers(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        sizes = np.diff(np.append(starts, len(raw)))
        own, where, back = np.unique(part_hashes(raw, starts, sizes), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, own), max(0, len(self.known) - 1))
        fresh = self.known[at] != own if len(self.known) else np.ones(len(own), bool)
        if fresh.any():
            spans = zip(starts[where[fresh]].tolist(), sizes[where[fresh]].tolist())
            self._learn(own[fresh], [raw[a:a + n].tobytes().decode() for a, n in spans])
            at = np.searchsorted(self.known, own)
        return self.number[at][back]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text."""
        if len(self.known) > self.most_parts:
            self._forget()
        raws = [t.encode() if t else b"" for t in texts]
        odd = [i for i, (t, r) in enumerate(zip(texts, raws)) if r and self.odd(t, r)]
        whole = {i: self._encode_whole(texts[i]) for i in odd}
        for i in odd:
            raws[i] = b""
        edge = np.cumsum([0, *map(len, raws)])
        raw = np.frombuffer(b"".join(raws), np.uint8)
        starts = self.part_starts(raw, edge) if len(raw) else np.zeros(0, np.int64)
        number = self._numbers(raw, starts) if len(raw) else starts
        count = self.count[number] if len(raw) else starts
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.first[number] - ends + count, count) + np.arange(total)] if total \
            else np.zeros(0, np.uint32)
        sums = np.concatenate(([0], ends))[np.searchsorted(starts, edge)]
        n = np.diff(sums)
        if whole:
            ids = np.concatenate([np.asarray(whole[i], np.uint32) if i in whole else ids[sums[i]:sums[i + 1]]
                                  for i in range(len(texts))])
            n = np.array([len(whole[i]) if i in whole else n[i] for i in range(len(texts))])
        return ids, n


class PieceTokenizer(PartTokenizer):
    """The same for a sentencepiece model with blanks kept, for texts that begin with the blank
    that the model would add. Parts begin at a blank that follows something else: no piece of the
    model reaches over such a place (else texts are encoded whole)."""

    def __init__(self, path: str, most_parts: int = 1_000_000):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        self.most_parts = most_parts
        self.blank = [self.library.piece_to_id("\u2581")]
        self.whole = any(re.search("[^\u2581]\u2581", self.library.id_to_piece(i))
                         for i in range(self.library.get_piece_size()))
        self._forget()

    def odd(self, text: str, raw: bytes) -> bool:
        return self.whole or text[0] != " " or b"\xe2\x96\x81" in raw

    @staticmethod
    def part_starts(raw: np.ndarray, texts: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(raw) + 1, bool)
        cut[1:-1] = (raw[1:] == 32) & (raw[:-1] != 32)
        cut[texts] = True
        return np.flatnonzero(cut[:-1])

    def _encode_whole(self, text: str) -> list[int]:
        return self.library.encode(text[1:] if text[0] == " " else text) or self.blank

    def _groups(self, parts: list[str]):
        ids = self.library.encode([p[1:] for p in parts], num_threads=1)
        ids = [x or self.blank for x in ids]             # a lone blank
        yield (np.ones(len(parts), bool), np.fromiter((i for x in ids for i in x), np.uint32),
               np.array([len(x) for x in ids], np.int64))


class TokenBytes:
    """The bytes that each token id stands for."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The bytes of all ids (with their sizes), one after the other."""
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.first[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(maxsize=2)
def byte_level_bytes(path: str) -> TokenBytes:
    """Of a byte-level vocabulary: printable Latin-1 bytes stand for themselves in it, the
    others, in order, for the characters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown}
    byte_of |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    vocabulary = tokenizer(path, True).library.get_vocab()
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return TokenBytes(out)


@lru_cache(maxsize=2)
def piece_bytes(path: str) -> TokenBytes:
    """Of a sentencepiece model: U+2581 is a blank, ``<0xHH>`` a byte."""
    library = piece_tokenizer(path).library
    return TokenBytes([bytes([int(library.id_to_piece(i)[3:5], 16)]) if library.is_byte(i)
                       else library.id_to_piece(i).replace("\u2581", " ").encode()
                       for i in range(library.get_piece_size())])


@lru_cache(maxsize=2)
def piece_tokenizer(path: str) -> PieceTokenizer:
    return PieceTokenizer(path)


@lru_cache(maxsize=2)
def tokenizer(path: str, plain: bool = False) -> PartTokenizer:
    """One for each worker process and file; kept from task to task."""
    return PartTokenizer(path, plain=plain)


def with_end(batches: Iterator[pa.RecordBatch], path: str, end_id: int, most: int = 1 << 20):
    """For groups of rows: the rows, all ids with ``end_id`` after each text, and each
    text's number of ids with it. The text is the last column."""
    own = tokenizer(path)
    for b in batches:
        for i, texts in text_groups(b.column(b.num_columns - 1), most):
            ids, n = own.encode(texts)
            yield b.slice(i, len(texts)), np.insert(ids, np.cumsum(n), end_id), n + 1
