"""Ids of a byte-level tokenizers file without a memory of pieces: its merges by rank, its special strings by its own library."""

from __future__ import annotations

import functools

import numpy as np
import public_tokenizers
import tiktoken

from cohortloom.llm.tokenizer_cache import BATCH_BYTES, BYTE_NAMES, load, safe_cuts


class RankEncoder:
    """Token ids of whole texts as the tokenizers library gives them for a byte-level BPE file whose ids are merge ranks.

    The pattern and the merges are those of the file, so texts without a special string are encoded by rank
    (tests compare both libraries); texts with one go through the tokenizers library as they are.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = self.tokenizer.pre_tokenizer
        if type(kind).__name__ != "ByteLevel" or not kind.use_regex or kind.add_prefix_space or self.tokenizer.normalizer is not None:
            raise ValueError(f"{path} is no plain byte-level file")
        names = {chr(BYTE_NAMES.get(b, b)): b for b in range(256)}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        ranks = {bytes(names[c] for c in name): k for name, k in vocabulary.items() if name not in self.special}
        self.ranked = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def size(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _one(self, raw: bytes) -> list[np.ndarray]:
        text = raw.decode("utf-8", "replace")
        if any(s in text for s in self.special):
            return [np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)]
        if len(raw) <= BATCH_BYTES:
            return [np.array(self.ranked.encode_ordinary(text), np.int32)]
        # A long text goes in portions that end at safe places, so that what is held besides ids is bounded.
        cuts = safe_cuts(np.frombuffer(raw, np.uint8))
        at = np.unique(np.append(cuts[np.searchsorted(cuts, np.arange(BATCH_BYTES, len(raw), BATCH_BYTES)).clip(max=max(0, len(cuts) - 1))]
                                 if len(cuts) else [], [0, len(raw)])).astype(int).tolist()
        return [np.array(self.ranked.encode_ordinary(raw[a:b].decode("utf-8", "replace")), np.int32) for a, b in zip(at, at[1:])]

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the token count of each."""
        raw, at = data.tobytes(), offsets.tolist()
        parts = [self._one(raw[a:b]) for a, b in zip(at, at[1:])]
        counts = np.array([sum(map(len, p)) for p in parts], np.int64)
        return np.concatenate([np.zeros(0, np.int32), *(x for p in parts for x in p)]), counts


@functools.cache
def rank_encoder(path: str) -> RankEncoder:
    """One for each Python worker."""
    return RankEncoder(path)
