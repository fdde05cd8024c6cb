"""Token ids of whole texts, each distinct chunk tokenised once a task.

Byte-level BPE with a pre-tokenizer that lets no token reach over a lone space
or newline between two non-space characters, nor from a letter to an ASCII
mark, gives the same ids for a text as for its chunks that begin there.  Chunks are found and hashed in
the Arrow buffer; only chunks not met before are handed to the tokenizer.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from gridloom.llm.textops import SPACE, mix, powers, slices, utf8

CACHED_CHUNKS = 1_500_000
CACHED_BYTES = 64
SLICE_BYTES = 1 << 20
_SOLID = ~SPACE
_SOLID[0x1C:0x20] = False
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[33, 34, *range(35, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def default_tokenizer() -> str:
    """Path of the public byte-level BPE file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def solid_bytes(part: np.ndarray) -> np.ndarray:
    """False at every byte of a white-space character, Unicode's included."""
    solid = _SOLID[part]
    for lead, width, is_space in (
        (0xC2, 2, lambda b: (b[1] == 0x85) | (b[1] == 0xA0)),
        (0xE1, 3, lambda b: (b[1] == 0x9A) & (b[2] == 0x80)),
        (0xE2, 3, lambda b: ((b[1] == 0x80) & ((b[2] <= 0x8A) | np.isin(b[2], (0xA8, 0xA9, 0xAF)))) | ((b[1] == 0x81) & (b[2] == 0x9F))),
        (0xE3, 3, lambda b: (b[1] == 0x80) & (b[2] == 0x80)),
    ):
        at = np.flatnonzero(part[: len(part) - width + 1] == lead)
        if len(at):
            at = at[is_space([part[at + k] for k in range(width)])]
            for k in range(width):
                solid[at + k] = False
    return solid


class ChunkTokenizer:
    """Tokenises string columns; keeps the ids of short chunks between batches."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def rows(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each row; nulls count as empty."""
        raw, offsets = utf8(column)
        for lo, hi in slices(offsets, SLICE_BYTES):  # each slice copies the kept ids once
            part, at = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            if part.tobytes().find(b"<|endoftext|>") >= 0:  # its string is one token wherever it stands
                for a, b in zip(at[:-1], at[1:]):
                    yield np.array(self.encode([part[a:b].tobytes().decode()])[0], np.uint32)
            else:
                yield from self._slice(part, at)

    def _slice(self, part: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        n = len(part)
        if not n:
            yield from (np.zeros(0, np.uint32) for _ in at[1:])
            return
        solid = solid_bytes(part)
        begins = np.zeros(n, bool)
        if n > 2:
            begins[1:-1] = ((part[1:-1] == 32) | (part[1:-1] == 10)) & solid[:-2] & solid[2:]
            begins[1:] |= _MARK[part[1:]] & _LETTER[part[:-1]]
        inner = at[(at > 0) & (at < n)]
        begins[inner - 1] &= _MARK[part[inner - 1]]  # a row's last space has no right neighbour
        begins[at[:-1][at[:-1] < n]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], n)
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
        unique, sample, which = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, unique)
        place[place == len(self.keys)] = 0
        known = self.keys[place] == unique if len(self.keys) else np.zeros(len(unique), bool)
        new = np.flatnonzero(~known)
        data = part.tobytes()
        fresh = self.encode([data[start[i] : end[i]].decode() for i in sample[new]])
        fresh_count = np.array([len(x) for x in fresh], np.int64)
        fresh_ids = np.fromiter((y for x in fresh for y in x), np.uint32, int(fresh_count.sum()))
        fresh_at = np.concatenate([[0], np.cumsum(fresh_count)[:-1]]).astype(np.int64) if len(new) else np.zeros(0, np.int64)
        old_size = len(self.ids)
        ids = np.concatenate([self.ids, fresh_ids])
        first, count = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
        if len(self.keys):
            first[known], count[known] = self.at[place[known]], self.count[place[known]]
        first[new], count[new] = fresh_at + old_size, fresh_count
        lens, froms = count[which], first[which]
        total = np.concatenate([[0], np.cumsum(lens)])
        flat = ids[np.repeat(froms - total[:-1], lens) + np.arange(total[-1])]
        cuts = total[np.searchsorted(start, at, "left")]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield flat[a:b]
        keep = new[(end - start)[sample[new]] <= CACHED_BYTES]
        if len(keep):
            if len(self.keys) + len(keep) > CACHED_CHUNKS:
                self.forget()
            else:
                where = np.searchsorted(self.keys, unique[keep])
                self.at, self.count = np.insert(self.at, where, first[keep]), np.insert(self.count, where, count[keep])
                self.keys, self.ids = np.insert(self.keys, where, unique[keep]), ids
