"""Counting and encoding with a tokenizers file: batches balanced by bytes, split at safe places, pieces remembered."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np

from cohortloom.llm.piece_store import PieceStore, sums

#: Bytes worked on at a time, bytes given to one call of the library, pieces remembered.
BATCH_BYTES, CALL_BYTES, MEMORY = 1 << 20, 1 << 18, 900_000
#: What a byte is: an ASCII letter, a blank or line feed, other ASCII white space or control, other ASCII, or part of
#: a character beyond ASCII.
LETTER, BLANK, CONTROL, OTHER, HIGH = range(5)
_KIND = np.array([LETTER if chr(b).isalpha() else BLANK if b in (0x20, 0x0A) else CONTROL if b < 0x20 or b == 0x7F else OTHER
                  for b in range(128)] + [HIGH] * 128, np.uint8)
#: Two-byte letters of the Latin blocks; two signs among them are none.
LATIN = rb"[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4\xc5][\x80-\xbf]"
#: A blank and letters: one match of the byte-level pattern.
MATCH = re.compile(rb" ?(?:" + LATIN + rb")+")
#: The character that a byte-level vocabulary writes for each byte: its own if it is visible, else the next from 256 on.
_VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_NAMES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _VISIBLE)}


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Places at which a text may be cut without a change in its tokens.

    A byte-level pattern ends a match where a letter is followed by an ASCII character that is none, and where
    ASCII that is not white space is followed by a blank; the next match does not look back.
    """
    kind = _KIND[data]
    letter = kind == LETTER
    # The second byte of a Latin letter; elsewhere a byte beyond ASCII says nothing about its character.
    second = np.zeros(len(data), bool)
    lead, tail = data[:-1], data[1:]
    second[1:] = ((lead == 0xC3) & (tail >= 0x80) & (tail != 0x97) & (tail != 0xB7)) | (((lead == 0xC4) | (lead == 0xC5)) & (tail >= 0x80))
    ends = letter | second
    now = kind[1:]
    cut = (ends[:-1] & (now != LETTER) & (now != HIGH)) | ((kind[:-1] == OTHER) & (now == BLANK))
    return np.flatnonzero(cut) + 1


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def balanced(texts: list, size: int) -> Iterator[list]:
    """Consecutive texts of about ``size`` together; one longer text stands alone."""
    part, held = [], 0
    for text in texts:
        if part and held + len(text) > size:
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text)
    if part:
        yield part


class CachedEncoder:
    """Token ids and counts of whole texts, as the library gives them, with its own treatment of special strings."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = self.tokenizer.pre_tokenizer
        self.direct = type(kind).__name__ == "ByteLevel" and kind.use_regex and not kind.add_prefix_space and self.tokenizer.normalizer is None
        self.store = PieceStore(self._learn, MEMORY)

    def _learn(self, pieces: list[bytes]) -> list[list[int]]:
        merges = self.tokenizer.model.tokenize
        out = [[t.id for t in merges(p.decode("latin-1").translate(BYTE_NAMES))] if MATCH.fullmatch(p) else None for p in pieces]
        rest = [k for k, ids in enumerate(out) if ids is None]
        texts = [pieces[k].decode("utf-8", "replace") for k in rest]
        whole = (e.ids for part in balanced(texts, CALL_BYTES) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False))
        for k, ids in zip(rest, whole):
            out[k] = ids
        return out

    def _numbers(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of joined texts, and how many pieces each text has."""
        raw = data.tobytes()
        cuts = safe_cuts(data) if self.direct else np.zeros(0, np.int64)
        for special in self.special:  # a text with a special string is left whole
            at = raw.find(special)
            while at >= 0:
                text = np.searchsorted(offsets, at, "right") - 1
                cuts = cuts[(cuts <= offsets[text]) | (cuts >= offsets[text + 1])]
                at = raw.find(special, offsets[text + 1])
        edge = np.zeros(len(data) + 1, bool)
        edge[cuts] = edge[offsets] = True
        edges = np.flatnonzero(edge)
        begin, end = edges[:-1], edges[1:]
        counts = np.searchsorted(begin, offsets[1:]) - np.searchsorted(begin, offsets[:-1])
        self.store.forget()
        return self.store.number([raw[a:b] for a, b in zip(begin.tolist(), end.tolist())]), counts

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Token count of each text."""
        numbers, counts = self._numbers(data, offsets)
        return sums(self.store.lengths[numbers], counts)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the token count of each."""
        numbers, counts = self._numbers(data, offsets)
        return self.store.ids(numbers), sums(self.store.lengths[numbers], counts)


@functools.cache
def encoder(path: str) -> CachedEncoder:
    """One for each Python worker: what a task has learnt serves the next."""
    return CachedEncoder(path)
