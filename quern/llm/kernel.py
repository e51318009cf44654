"""Vectorised text kernel: words, n-grams and hashes straight from Arrow string buffers.

All functions work on UTF-8 bytes and offsets with numpy; none makes a Python object per word. Long texts are handled in
segments of about ``SEGMENT`` bytes, so memory stays bounded by one segment plus 24 bytes a word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
SEGMENT = 1 << 18
#: Bytes that separate words: space and \t \n \v \f \r.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1 << 32, 1 << 63, 256, dtype=np.uint64) | U(1)
_GRAM = _rng.integers(1 << 32, 1 << 63, 64, dtype=np.uint64) | U(1)
_BASE = U(0x9E3779B97F4A7C15)


#: For tokens without punctuation: all ASCII but letters and digits separates, and A-Z count as a-z.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
FOLDED = _BYTE.copy()
FOLDED[65:91] = _BYTE[97:123]


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_POW = powers(int(_BASE), 1 << 16)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    if not len(column) or at is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


@dataclass
class Words:
    """Words of a batch: byte spans, 64-bit hashes, and for each text its first word (``at`` has one entry more)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    at: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.at)


def _cuts(data: np.ndarray, offs: np.ndarray, segment: int) -> list[int]:
    """Ends of segments; a segment ends where a text does or after a separator."""
    cuts, at, n = [], 0, len(data)
    while at < n:
        want = at + segment
        if want >= n:
            cuts.append(n)
            break
        k = int(offs[np.searchsorted(offs, want)])
        step = want
        while step < k:
            hit = np.flatnonzero(SEPARATOR[data[step : min(step + 4096, k)]])
            if len(hit):
                k = step + int(hit[0]) + 1
                break
            step += 4096
        cuts.append(at := k)
    return cuts


def words(data: np.ndarray, offs: np.ndarray, segment: int = SEGMENT, separator: np.ndarray = SEPARATOR, byte: np.ndarray = _BYTE) -> Words:
    """Runs of bytes that are no separators, within each text; ``byte`` gives each byte's part in the hash."""
    starts, ends, hashes, low = [], [], [], 0
    with np.errstate(over="ignore"):
        for high in _cuts(data, offs, segment):
            a = data[low:high]
            inner = ~separator[a]
            first = inner.copy()
            first[1:] &= ~inner[:-1]
            edge = offs[np.searchsorted(offs, low, "left") : np.searchsorted(offs, high, "left")] - low
            edge = edge[(edge >= 0) & (edge < len(a))]
            first[edge] = inner[edge]
            s = np.flatnonzero(first)
            if len(s):
                inside = np.flatnonzero(inner)
                k = np.searchsorted(inside, s)
                size = np.diff(k, append=len(inside))
                place = np.arange(len(inside)) - np.repeat(k, size)
                hashes.append(mix(np.add.reduceat(byte[a[inside]] * _POW[place & 0xFFFF], k) ^ (size.astype(np.uint64) * _BASE)))
                starts.append(s + low)
                ends.append(s + low + size)
            low = high
    z = np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else z
    return Words(start, np.concatenate(ends) if ends else z, np.concatenate(hashes) if hashes else z.astype(np.uint64), np.searchsorted(start, offs))


def grams(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``n`` neighbours in ``h`` (uint64), text by text, and each text's first run.

    A text with fewer than ``n`` but at least one neighbour has one run: all of them.
    """
    size = np.diff(at)
    count = np.where(size >= n, size - n + 1, (size > 0).astype(size.dtype))
    out_at = np.concatenate([[0], np.cumsum(count)])
    with np.errstate(over="ignore"):
        if not len(h):
            return h.astype(np.uint64), out_at
        g = np.zeros(len(h), np.uint64)
        for k in range(n):
            g[: len(h) - k] += h[k:] * _GRAM[k % 64]
        keep = np.arange(int(out_at[-1])) - np.repeat(out_at[:-1], count) + np.repeat(at[:-1], count)
        out = g[keep]
        for d in np.flatnonzero((size > 0) & (size < n)):
            part = h[at[d] : at[d + 1]]
            out[out_at[d]] = np.sum(part * _GRAM[np.arange(len(part)) % 64], dtype=np.uint64) + U(len(part))
        return mix(out), out_at


def code_points(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Code points of each text."""
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    return np.diff(lead[offs])


def sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` in each span [at[i], at[i+1])."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at])


def choose_bands(threshold: float, recall: float, rows: int) -> int:
    """The least number of bands of ``rows`` values by which a pair at ``threshold`` meets with probability ``recall``."""
    return int(np.ceil(np.log1p(-recall) / np.log1p(-(threshold**rows))))


def minhash(h: np.ndarray, at: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """(texts, k) minima of k hash functions over each text's hashes; a text without any gets all ones."""
    rng = np.random.Generator(np.random.PCG64(seed))
    a, b = rng.integers(0, 1 << 63, (2, k), dtype=np.uint64)
    a |= U(1)
    out = np.full((len(at) - 1, k), ~U(0))
    full = np.flatnonzero(np.diff(at) > 0)
    low = 0
    with np.errstate(over="ignore"):
        while low < len(full):
            high = low + 1
            while high < len(full) and at[full[high] + 1] - at[full[low]] <= 1 << 15:
                high += 1
            part = full[low:high]
            if high == low + 1:
                d = part[0]
                for s in range(int(at[d]), int(at[d + 1]), 1 << 15):
                    x = h[s : min(s + (1 << 15), int(at[d + 1]))]
                    out[d] = np.minimum(out[d], ((x[None, :] ^ b[:, None]) * a[:, None]).min(axis=1))
            else:
                x = h[at[part[0]] : at[part[-1] + 1]]
                out[part] = np.minimum.reduceat((x[None, :] ^ b[:, None]) * a[:, None], at[part] - at[part[0]], axis=1).T
            low = high
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) keys; the band's number is part of the key."""
    out = np.empty((len(signature), bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            x = np.full(len(signature), U(b + 1) * _BASE)
            for r in range(rows):
                x = mix(x ^ signature[:, b * rows + r]) + U(r)
            out[:, b] = x
    return out
