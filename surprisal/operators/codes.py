"""Characters and grams of Arrow batches, counted with array operations.

The texts of a batch are one flat array of code points, rows one after the other. A gram is a number:
the codes of its characters, from the last one up, in as many bits as the characters met so far need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Positions that are worked on at once, and distinct grams that a task holds before it hands them on.
WINDOW, HELD = 1 << 20, 1 << 21
#: Bits of a gram up to which grams are counted in a plain array.
DENSE = 21
CODE_POINTS = 0x110000


def points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, and where each begins, with the end; null is empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    if not len(raw) or raw.max() < 0x80:
        return raw, at
    try:
        flat = raw.tobytes().decode()
        begun = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at]
    except UnicodeDecodeError:
        each = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
        flat, begun = "".join(each), np.concatenate([[0], np.cumsum([len(t) for t in each])]).astype(np.int64)
    return np.frombuffer(flat.encode("utf-32-le"), np.uint32), begun


def chunked(flat: np.ndarray, at: np.ndarray, size: int, pad: int, mark: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for the rows' chunks of size characters, each with pad marks on either side."""
    many = -(-np.diff(at) // size)
    first = np.repeat(np.cumsum(many) - many, many)
    begin = np.repeat(at[:-1], many) + (np.arange(len(first)) - first) * size
    length = np.minimum(size, np.repeat(at[1:], many) - begin)
    out = np.full(int(length.sum() + 2 * pad * len(length)), mark, np.uint32)
    out[np.arange(len(flat)) + np.repeat(pad * (2 * np.arange(len(length)) + 1), length)] = flat
    return out, np.concatenate([[0], np.cumsum(length + 2 * pad)])


class Codes:
    """Codes from 1 of the characters met so far."""

    def __init__(self) -> None:
        self.table, self.symbols, self.bits = np.zeros(CODE_POINTS, np.int32), [0], 5

    def unmet(self, flat: np.ndarray) -> np.ndarray:
        seen = np.zeros(CODE_POINTS, bool)
        seen[flat] = True
        return np.flatnonzero(seen & (self.table == 0))

    def meet(self, new: np.ndarray) -> None:
        self.table[new] = np.arange(len(new)) + len(self.symbols)
        self.symbols += new.tolist()
        self.bits = max(self.bits, len(self.symbols).bit_length())

    def windows(self, flat: np.ndarray, at: np.ndarray, depth: int, off: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """row, position, reach and key of each character with up to depth before it in its row; those of a row's first off are passed over.

        Where a key has not room for all characters, those met so far go by their rank, so that keys hold within a window only."""
        for a in range(0, len(flat), WINDOW):
            b, low = min(len(flat), a + WINDOW), max(0, a - depth)
            r0, r1 = np.searchsorted(at, a, "right") - 1, np.searchsorted(at, b, "left")
            row = np.repeat(np.arange(r0, r1), np.diff(np.clip(at[r0 : r1 + 1], a, b)))
            reach = np.arange(a, b) - at[row]
            code = np.concatenate([np.zeros(depth - (a - low), np.int64), self.table[flat[low:b]]])
            key, used = code[depth:].copy(), self.bits
            for d in range(1, depth + 1):
                if used + self.bits > 63:
                    key = np.unique(key, return_inverse=True)[1].astype(np.int64)
                    used = WINDOW.bit_length()
                key += np.where(reach >= d, code[depth - d : len(code) - d], 0) << used
                used += self.bits
            where = np.arange(a, b)
            if off is not None and off.any():
                kept = reach >= off[row]
                row, where, reach, key = row[kept], where[kept], reach[kept], key[kept]
            yield row, where, np.minimum(reach, depth), key

    def strings(self, keys: np.ndarray, depth: int) -> pa.Array:
        """The grams of keys that hold everywhere."""
        named = np.array(self.symbols, "<u4")
        code = np.stack([(keys >> (self.bits * d)) & ((1 << self.bits) - 1) for d in range(depth, -1, -1)], axis=1) if len(keys) else np.zeros((0, depth + 1), np.int64)
        size = (code > 0).sum(axis=1)
        flat = named[code[code > 0]].tobytes().decode("utf-32-le")
        ends = np.cumsum(size)
        return pa.array([flat[e - n : e] for e, n in zip(ends.tolist(), size.tolist(), strict=True)], pa.string())


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def gram_batches(batches: Iterator[pa.RecordBatch], depth: int, chunk: int = 0, pad: int = 0, mark: int = 1) -> Iterator[pa.RecordBatch]:
    """gram, cnt of batches of text and off, the characters that only stand before others; a gram may come several times. With chunk, of the padded chunks."""
    codes, held, dense, distinct = Codes(), [], None, 0

    def batch(grams: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([grams, pa.array(counts, pa.int64())], names=["gram", "cnt"])

    def told() -> Iterator[pa.RecordBatch]:
        nonlocal held, dense, distinct
        if dense is not None:
            held.append((keys := np.flatnonzero(dense), dense[keys]))
        if held:
            keys, counts = summed(*map(np.concatenate, zip(*held, strict=True)))
            for i in range(0, len(keys), 1 << 17):
                yield batch(codes.strings(keys[i : i + (1 << 17)], depth), counts[i : i + (1 << 17)])
        held, dense, distinct = [], None, 0

    for each in batches:
        flat, at = points(each.column("text"))
        off = each.column("off").to_numpy(zero_copy_only=False)
        if chunk:
            (flat, at), off = chunked(flat, at, chunk, pad, mark), None
        if len(new := codes.unmet(flat)):
            if (len(codes.symbols) + len(new)).bit_length() > codes.bits:
                yield from told()
            codes.meet(new)
        wide = codes.bits * (depth + 1)
        for _, where, reach, key in codes.windows(flat, at, depth, off):
            if wide <= DENSE:
                dense = np.zeros(1 << wide, np.int64) if dense is None else dense
                dense += np.bincount(key, minlength=1 << wide)
            elif wide <= 63:
                held.append(np.unique(key, return_counts=True))
                distinct += len(held[-1][0])
                if distinct > HELD:
                    held = [summed(*map(np.concatenate, zip(*held, strict=True)))]
                    distinct = len(held[0][0])
                    if distinct > HELD // 2:
                        yield from told()
            else:
                _, first, counts = np.unique(key, return_index=True, return_counts=True)
                spans = zip((where[first] - reach[first]).tolist(), (where[first] + 1).tolist(), strict=True)
                yield batch(pa.array([flat[a:b].astype("<u4").tobytes().decode("utf-32-le") for a, b in spans], pa.string()), counts)
    yield from told()


def row_counts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """row, code point, count of the characters of each text, by some rows at a time."""
    flat, at = points(texts)
    met = np.flatnonzero(np.bincount(flat)) if len(flat) else np.zeros(0, np.int64)
    place = np.zeros(int(met[-1]) + 1 if len(met) else 0, np.int64)
    place[met] = np.arange(len(met))
    r0 = 0
    while r0 < len(at) - 1:
        most = max(1, min((1 << 20) // max(1, len(met)), np.searchsorted(at, at[r0] + WINDOW, "right") - 1 - r0))
        r1 = min(len(at) - 1, r0 + most)
        row = np.repeat(np.arange(r1 - r0), np.diff(at[r0 : r1 + 1]))
        counts = np.bincount(row * len(met) + place[flat[at[r0] : at[r1]]], minlength=0)
        cell = np.flatnonzero(counts)
        if len(cell):
            yield cell // len(met) + r0, met[cell % len(met)], counts[cell]
        r0 = r1


def char_batches(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """by, ch, cnt of batches of by and text: for each row, or without by for the whole task."""
    total = np.zeros(CODE_POINTS, np.int64)
    for each in batches:
        if not by:
            flat, _ = points(each.column("text"))
            if len(flat):
                found = np.bincount(flat)
                total[: len(found)] += found
            continue
        for row, char, count in row_counts(each.column("text")):
            kinds, place = np.unique(char, return_inverse=True)
            ch = pa.array([chr(c) for c in kinds], pa.string()).take(pa.array(place))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(each.column(k).take(at) for k in by), ch, pa.array(count, pa.int64())], names=[*by, "ch", "cnt"])
    if len(kinds := np.flatnonzero(total)):
        yield pa.RecordBatch.from_arrays([pa.array([chr(c) for c in kinds], pa.string()), pa.array(total[kinds], pa.int64())], names=["ch", "cnt"])


class Lookup:
    """A number for each of some grams, kept so that the sum over a text's characters is a few array operations."""

    def __init__(self, grams: list[str], numbers: np.ndarray, depth: int) -> None:
        self.depth, self.codes = depth, Codes()
        self.codes.meet(np.array(sorted({ord(c) for c in set("".join(grams))}), np.int64))
        bits = self.codes.bits
        place = {chr(s): i for i, s in enumerate(self.codes.symbols) if i}
        keys = np.zeros(len(grams), np.int64)
        for i, g in enumerate(grams):
            key = 0
            for c in g:
                key = key << bits | place[c]
            keys[i] = key
        order = np.argsort(keys)
        self.keys, self.numbers = keys[order], np.asarray(numbers, float)[order]
        self.dense = None
        if bits * (depth + 1) <= DENSE:
            self.dense = np.zeros(1 << (bits * (depth + 1)))
            self.dense[self.keys] = self.numbers

    @staticmethod
    def fits(symbols: int, depth: int) -> bool:
        return max(5, (symbols + 1).bit_length()) * (depth + 1) <= 63

    def sums(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The characters of each text and the sum of their grams' numbers; all grams are known."""
        flat, at = points(texts)
        out = np.zeros(len(at) - 1)
        for row, _, _, key in self.codes.windows(flat, at, self.depth):
            found = self.dense[key] if self.dense is not None else self.numbers[np.searchsorted(self.keys, key)]
            low = row[0] if len(row) else 0
            some = np.bincount(row - low, weights=found)
            out[low : low + len(some)] += some
        return np.diff(at), out
