"""A static range asymmetric numeral system (rANS) over numpy lanes, and the block images that hold its output.

A block takes whole documents, in pieces of PIECE tokens (the last may be shorter), so a very long document is many pieces. A
piece's tokens are dealt to LANES lanes (token t to lane t mod LANES), each lane is an independent 64-bit coder, and lanes of
pieces of like size advance together, so one numpy step codes a token of each. All share one frequency table. A lane's state stays
in [2^31, 2^63) and moves 32-bit words, which a piece keeps in the order its decoder wants them.

Block image, little-endian: magic `CLRC`, u32 lanes, u64 documents, u64 tokens, u64 piece size, u64 pieces, then for each piece
u64 words and u64 states[lanes] (the checkpoint that its decoding starts from), i64 token counts[documents], i64 ids[documents], u8
id-is-null[documents], u32 words[] of all pieces, and a u32 CRC-32 of all before it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

U64 = np.uint64
LANES = 64
LOW = 1 << 31
PIECE = 1 << 16
#: Tokens that are padded and coded together.
ROOM = 1 << 21
MAGIC = b"CLRC"
_HEAD = struct.Struct("<4sIQQQQ")


def quantised(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Frequencies that add up to 2^bits, at least 1 for each symbol that occurs (a uniform one if none does)."""
    seen = np.flatnonzero(counts)
    if not len(seen):
        counts, seen = np.ones(1, np.int64), np.zeros(1, np.int64)
    bits = max(12, int(len(seen)).bit_length() + 4)
    total, free = counts[seen].sum(), (1 << bits) - len(seen)
    share = counts[seen] / total * free
    part = np.floor(share).astype(np.int64)
    rest = free - int(part.sum())
    part[np.argsort(-(share - part), kind="stable")[:rest]] += 1
    freq = np.zeros(len(counts), np.int64)
    freq[seen] = part + 1
    return freq, bits


def _alike(sizes: list[int]) -> list[list[int]]:
    """Numbers of pieces in groups whose padded tokens are ROOM at most (or one piece), shortest first."""
    out: list[list[int]] = []
    for k in sorted(range(len(sizes)), key=sizes.__getitem__):
        if out and (len(out[-1]) + 1) * sizes[k] <= ROOM:
            out[-1].append(k)
        else:
            out.append([k])
    return out


class Codec:
    def __init__(self, freq: np.ndarray, bits: int):
        self.bits = bits
        self.freq = freq.astype(U64)
        self.start = (np.cumsum(freq) - freq).astype(U64)
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq)), self.freq.astype(np.int64)).astype(np.uint32)
        return self._symbol

    def encode(self, blocks: list[np.ndarray], lanes: int = LANES, piece: int = PIECE) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """(states, words) of each piece of each block of symbols."""
        cut = [(k, b[at : at + piece]) for k, b in enumerate(blocks) for at in range(0, max(1, len(b)), piece)]
        done: list = [None] * len(cut)
        for group in _alike([len(x) for _, x in cut]):
            for g, coded in zip(group, self._encode([cut[g][1] for g in group], lanes), strict=True):
                done[g] = coded
        out: list[list] = [[] for _ in blocks]
        for (k, _), coded in zip(cut, done, strict=True):
            out[k].append(coded)
        return out

    def decode(self, coded: list[list[tuple[np.ndarray, np.ndarray, int]]]) -> list[np.ndarray]:
        """The symbols of each block, given (states, words, tokens) of its pieces."""
        every = [p for pieces in coded for p in pieces]
        done: list = [None] * len(every)
        for group in _alike([n for _, _, n in every]):
            for g, symbols in zip(group, self._decode([every[g] for g in group]), strict=True):
                done[g] = symbols
        ends = np.cumsum([len(pieces) for pieces in coded]).tolist()
        return [done[e - len(p)] if len(p) == 1 else np.concatenate(done[e - len(p) : e]) for e, p in zip(ends, coded, strict=True)]

    def _encode(self, blocks: list[np.ndarray], lanes: int) -> list[tuple[np.ndarray, np.ndarray]]:
        sizes = np.array([len(b) for b in blocks])
        steps = max(1, int(-(-sizes.max() // lanes)))
        sym = np.zeros((len(blocks), steps * lanes), np.uint32)
        for k, b in enumerate(blocks):
            sym[k, : len(b)] = b
        sym = np.ascontiguousarray(sym.reshape(len(blocks), steps, lanes).transpose(1, 0, 2).reshape(steps, -1))
        room = np.maximum(sizes[:, None] - np.arange(lanes)[None, :], 0)
        of_lane = (-(-room // lanes)).reshape(-1)  # tokens of each lane
        x = np.full(len(blocks) * lanes, LOW, U64)
        words = np.zeros(sym.shape, np.uint32)
        moved = np.zeros(sym.shape, bool)
        shift, top = U64(self.bits), U64(63 - self.bits)
        least = int(of_lane.min())
        for t in range(steps - 1, -1, -1):
            f, c = self.freq[sym[t]], self.start[sym[t]]
            on = None
            if t >= least:
                on = of_lane > t
                f = np.where(on, f, U64(1))
            out = x >= (f << top)
            if on is not None:
                out &= on
            words[t] = x.astype(np.uint32)
            moved[t] = out
            y = np.where(out, x >> U64(32), x)
            q = y // f
            y = (q << shift) + (y - q * f) + c
            x = y if on is None else np.where(on, y, x)
        states = x.reshape(len(blocks), lanes)
        words = words.reshape(steps, len(blocks), lanes).transpose(1, 0, 2)
        moved = moved.reshape(steps, len(blocks), lanes).transpose(1, 0, 2)
        return [(states[k], words[k][moved[k]]) for k in range(len(blocks))]

    def _decode(self, coded: list[tuple[np.ndarray, np.ndarray, int]]) -> list[np.ndarray]:
        lanes = len(coded[0][0])
        sizes = np.array([n for _, _, n in coded])
        steps = int(-(-sizes.max() // lanes))
        room = np.maximum(sizes[:, None] - np.arange(lanes)[None, :], 0)
        of_lane = -(-room // lanes)
        x = np.stack([s for s, _, _ in coded]).astype(U64)
        stream = np.concatenate([*(w for _, w, _ in coded), np.zeros(1, np.uint32)])
        at = np.concatenate([[0], np.cumsum([len(w) for _, w, _ in coded])])[:-1]
        out = np.empty((steps, len(coded), lanes), np.uint32)
        mask, shift, low, symbol = U64((1 << self.bits) - 1), U64(self.bits), U64(LOW), self.symbol
        least = int(of_lane.min()) if len(coded) else 0
        for t in range(steps):
            slot = x & mask
            s = symbol[slot.astype(np.int64)]
            out[t] = s
            y = self.freq[s] * (x >> shift) + slot - self.start[s]
            need = y < low
            if t >= least:
                on = of_lane > t
                need &= on
                y = np.where(on, y, x)
            got = np.cumsum(need, axis=1)
            where = np.minimum(at[:, None] + got - 1, len(stream) - 1)
            x = np.where(need, (y << U64(32)) | stream[where].astype(U64), y)
            at = at + got[:, -1]
        flat = out.transpose(1, 0, 2).reshape(len(coded), -1)
        return [flat[k, :n] for k, n in enumerate(sizes.tolist())]


def image(pieces: list[tuple[np.ndarray, np.ndarray]], counts: np.ndarray, ids: np.ndarray, null: np.ndarray, piece: int = PIECE) -> bytes:
    marks = [x for states, words in pieces for x in (struct.pack("<Q", len(words)), states.astype("<u8").tobytes())]
    head = _HEAD.pack(MAGIC, len(pieces[0][0]), len(counts), int(counts.sum()), piece, len(pieces))
    body = b"".join([head, *marks, counts.astype("<i8").tobytes(), ids.astype("<i8").tobytes(), null.astype(np.uint8).tobytes(), *(w.astype("<u4").tobytes() for _, w in pieces)])
    return body + struct.pack("<I", zlib.crc32(body))


def parsed(data: bytes) -> tuple[list[tuple[np.ndarray, np.ndarray, int]], np.ndarray, np.ndarray, np.ndarray]:
    """((states, words, tokens) of each piece, counts, ids, null) of a block image; ValueError if it is damaged."""
    if len(data) < _HEAD.size + 4 or data[:4] != MAGIC:
        raise ValueError("not a block image")
    if zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("block image: checksum differs")
    _, lanes, docs, tokens, piece, n = _HEAD.unpack_from(data)
    mark = np.dtype([("words", "<u8"), ("states", "<u8", (lanes,))])
    marks = np.frombuffer(data, mark, n, _HEAD.size)
    at, columns = _HEAD.size + marks.nbytes, []
    for kind in ("<i8", "<i8", "u1"):
        columns.append(np.frombuffer(data, kind, docs, at))
        at += columns[-1].nbytes
    pieces = []
    for k in range(n):
        words = np.frombuffer(data, "<u4", int(marks["words"][k]), at)
        at += words.nbytes
        pieces.append((marks["states"][k], words, min(piece, tokens - k * piece)))
    return pieces, *columns
