"""Elias-Fano sequences over numpy, and a trie of n-gram levels on them."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

HEAD = "<QQQQ"


class EliasFano:
    """A non-decreasing sequence: low bits packed side by side, high parts in unary, and the ones before each 64 bits."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.bitwise_count(high)
        self.before = np.concatenate(([0], np.cumsum(ones, dtype=np.int64)))

    @staticmethod
    def build(values: np.ndarray) -> EliasFano:
        values = np.ascontiguousarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros(-(-n * low_bits // 64) + 1, np.uint64)
        at = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
        part = values & np.uint64((1 << low_bits) - 1)
        if low_bits:
            np.bitwise_or.at(low, (at >> np.uint64(6)).astype(np.int64), part << (at & np.uint64(63)))
            spill = (at & np.uint64(63)) + np.uint64(low_bits) > np.uint64(64)
            np.bitwise_or.at(low, (at[spill] >> np.uint64(6)).astype(np.int64) + 1, part[spill] >> (np.uint64(64) - (at[spill] & np.uint64(63))))
        place = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(place[-1]) // 64 + 1) * 64 if n else 0, np.uint8)
        bits[place] = 1
        return EliasFano(n, low_bits, low, np.packbits(bits, bitorder="little").view(np.uint64))

    def slice(self, lo: int, hi: int) -> np.ndarray:
        """Values lo..hi-1: select the words that hold these ones, take them apart."""
        if hi <= lo:
            return np.empty(0, np.int64)
        a = int(np.searchsorted(self.before, lo, "right")) - 1
        b = int(np.searchsorted(self.before, hi, "left"))
        ones = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high[a:b]).view(np.uint8), bitorder="little"))
        skip = lo - int(self.before[a])
        place = 64 * a + ones[skip : skip + hi - lo]
        out = (place - np.arange(lo, hi)) << self.low_bits
        if self.low_bits:
            at = np.arange(lo, hi, dtype=np.uint64) * np.uint64(self.low_bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            part = self.low[word] >> shift
            part |= np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0)) if len(self.low) > 1 else np.uint64(0)
            out |= (part & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)
        return out

    def to_bytes(self) -> bytes:
        return struct.pack(HEAD, self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @staticmethod
    def read(buffer, at: int) -> tuple[EliasFano, int]:
        n, low_bits, n_low, n_high = struct.unpack_from(HEAD, buffer, at)
        at += struct.calcsize(HEAD)
        low = np.frombuffer(buffer, np.uint64, n_low, at)
        high = np.frombuffer(buffer, np.uint64, n_high, at + 8 * n_low)
        return EliasFano(n, low_bits, low, high), at + 8 * (n_low + n_high)


class Trie:
    """Two levels: contexts, and each context's successors with a quantised log10 probability.

    Contexts and the pointers to their successors are monotone. So are the successors once each context's are raised
    by its place times the number of ids: one sequence holds them all, and a successor is sought relative to its
    context. Codes are 16 bits over [low, 0]; `low` is below all stored values.
    """

    MAGIC = b"EFTRIE02"

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, ids: int, codes: np.ndarray):
        self.contexts, self.pointers, self.successors, self.ids, self.codes = contexts, pointers, successors, ids, codes

    @staticmethod
    def build(context: np.ndarray, successor: np.ndarray, code: np.ndarray) -> bytes:
        """From n-grams sorted by context and successor."""
        new = np.concatenate(([True], context[1:] != context[:-1])) if len(context) else np.empty(0, bool)
        ids = int(successor.max()) + 1 if len(successor) else 1
        first = np.flatnonzero(new)
        raised = successor + (np.cumsum(new) - 1) * ids if len(context) else successor
        parts = [EliasFano.build(x).to_bytes() for x in (context[first], np.append(first, len(context)), raised)]
        return Trie.MAGIC + struct.pack("<Q", ids) + b"".join(parts) + struct.pack("<Q", len(code)) + code.astype("<u2").tobytes()

    @staticmethod
    def read(buffer) -> Trie:
        if bytes(buffer[: len(Trie.MAGIC)]) != Trie.MAGIC:
            raise ValueError("not a trie")
        at = len(Trie.MAGIC)
        (ids,) = struct.unpack_from("<Q", buffer, at)
        contexts, at = EliasFano.read(buffer, at + 8)
        pointers, at = EliasFano.read(buffer, at)
        successors, at = EliasFano.read(buffer, at)
        (n,) = struct.unpack_from("<Q", buffer, at)
        return Trie(contexts, pointers, successors, ids, np.frombuffer(buffer, "<u2", n, at + 8))

    @staticmethod
    def open(fs, path: str) -> Trie:
        """Maps a local file to memory; reads one of another store."""
        if isinstance(fs, pa.fs.LocalFileSystem):
            return Trie.read(memoryview(pa.memory_map(path).read_buffer()))
        with fs.open_input_file(path) as f:
            return Trie.read(memoryview(f.read_buffer()))

    def find(self, context: np.ndarray, successor: np.ndarray, step: int = 1 << 20) -> np.ndarray:
        """Codes of n-grams (sorted by context and successor), 0 where there is none. The pointers of the contexts asked
        for give where their successors lie; these are taken apart for about `step` successors at a time, with what lies
        between them unless that is more than `step` / 16, and each n-gram is sought among the successors of its context."""
        out = np.zeros(len(context), np.uint16)
        if not len(context) or not self.contexts.n:
            return out
        known = self.contexts.slice(0, self.contexts.n)
        place = np.searchsorted(known, context)
        ok = np.flatnonzero((known[np.minimum(place, len(known) - 1)] == context) & (successor < self.ids))
        if not len(ok):
            return out
        pointer = self.pointers.slice(0, self.pointers.n)
        place = place[ok]
        asked, first = np.unique(place, return_index=True)
        first = np.append(first, len(place))
        lo, hi = pointer[asked], pointer[asked + 1]
        stretch = hi // step
        cuts = np.concatenate(([0], np.flatnonzero((np.diff(stretch) > 0) | (lo[1:] - hi[:-1] > step // 16)) + 1, [len(asked)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            mine = slice(first[a], first[b])
            own = self.successors.slice(int(lo[a]), int(hi[b - 1]))
            sought = place[mine] * self.ids + successor[ok[mine]]
            at = np.minimum(np.searchsorted(own, sought), len(own) - 1)
            hit = own[at] == sought
            out[ok[mine][hit]] = self.codes[int(lo[a]) + at[hit]]
        return out
