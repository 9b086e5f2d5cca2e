"""A baseline JPEG encoder in whole arrays: no loop over pixels, blocks or symbols."""

from __future__ import annotations

import heapq
import struct

import numpy as np

# The example quantisation tables of the JPEG standard, for luminance and chrominance.
LUMINANCE = np.array([
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
])
CHROMINANCE = np.array([
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
])
_EYE = np.arange(8)
#: Orthonormal cosines: row u holds the u-th frequency.
_COSINES = np.cos((2 * _EYE + 1) * _EYE[:, None] * np.pi / 16) * np.where(_EYE[:, None] == 0, np.sqrt(1 / 8), 1 / 2)
#: Places of a block by diagonals, the direction turning from one to the next.
_ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_END, _SIXTEEN = 0x00, 0xF0


def quantisation(base: np.ndarray, quality: int) -> np.ndarray:
    """The usual scaling of a table to a quality from 1 to 100."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((base * scale + 50) // 100, 1, 255)


def _blocks(plane: np.ndarray) -> np.ndarray:
    """8 by 8 blocks row by row; the last row and column are repeated to fill them."""
    height, width = plane.shape
    full = np.pad(plane, ((0, -height % 8), (0, -width % 8)), mode="edge")
    return full.reshape(full.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)


def coefficients(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Quantised cosine coefficients of a plane of 0 to 255, 64 a block in zigzag order."""
    spectrum = (_COSINES @ (_blocks(plane.astype(float)) - 128) @ _COSINES.T).reshape(-1, 64)
    return np.rint(spectrum / table).astype(np.int64)[:, _ZIGZAG]


def _sizes(values: np.ndarray) -> np.ndarray:
    """Bits of absolute values."""
    return np.ceil(np.log2(np.abs(values) + 1)).astype(np.int64)


def _amplitudes(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.where(values >= 0, values, values + (1 << sizes) - 1)


def _symbols(zigzag: np.ndarray) -> tuple[np.ndarray, ...]:
    """block, first-of-block flag, symbol, size and amplitude of all symbols of one component, in order."""
    n = len(zigzag)
    steps = np.diff(zigzag[:, 0], prepend=0)
    dc = _sizes(steps)
    block, place = np.nonzero(zigzag[:, 1:])
    values = zigzag[:, 1:][block, place]
    sizes = _sizes(values)
    before = np.where(np.diff(block, prepend=-1) != 0, -1, np.concatenate([[-1], place[:-1]]))
    run = place - before - 1
    more = run // 16
    last = np.full(n, -1)
    last[block] = place  # the last one of a block stays
    ended = np.flatnonzero(last < 62)
    # sixteen zeros come before their coefficient; an end of block comes last
    parts = [
        (np.arange(n), np.full(n, -1), np.zeros(n, int), dc, dc, _amplitudes(steps, dc)),
        (np.repeat(block, more), np.repeat(place, more), np.zeros(more.sum(), int), np.full(more.sum(), _SIXTEEN), np.zeros(more.sum(), int), np.zeros(more.sum(), int)),
        (block, place, np.ones(len(block), int), run % 16 << 4 | sizes, sizes, _amplitudes(values, sizes)),
        (ended, np.full(len(ended), 64), np.zeros(len(ended), int), np.full(len(ended), _END), np.zeros(len(ended), int), np.zeros(len(ended), int)),
    ]
    block, place, turn, symbol, size, amplitude = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((turn, place, block))
    return block[order], place[order] == -1, symbol[order], size[order], amplitude[order]


def code_lengths(symbols: np.ndarray) -> dict[int, int]:
    """Huffman code lengths of at most 16 bits; no code is all ones."""
    found, counts = np.unique(symbols, return_counts=True)
    counts = counts.astype(np.int64)
    while True:
        heap = [(int(c), i, (int(s),)) for i, (s, c) in enumerate(zip(found, counts, strict=True))] + [(0, -1, (-1,))]  # -1 takes the code of all ones
        heapq.heapify(heap)
        depth = dict.fromkeys([int(s) for s in found] + [-1], 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], max(a[1], b[1]), a[2] + b[2]))
        if max(depth.values()) <= 16:
            return {s: n for s, n in depth.items() if s >= 0}
        counts = (counts + 1) // 2


def _table(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Codes and lengths by symbol, and the table as a file holds it."""
    lengths = code_lengths(symbols)
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    codes, bits, code, had = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, lengths[order[0]]
    for s in order:
        code <<= lengths[s] - had
        had = lengths[s]
        codes[s], bits[s] = code, had
        code += 1
    counts = bytes(sum(n == k for n in lengths.values()) for k in range(1, 17))
    return codes, bits, counts + bytes(order)


def _packed(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """Values of the given bits one after the other, the last byte filled with ones; 0xFF bytes are followed by a zero."""
    ends = np.cumsum(lengths)
    out = np.ones(-(-int(ends[-1]) // 8) * 8, np.uint8)
    for bit in range(int(lengths.max())):
        some = lengths > bit
        out[ends[some] - 1 - bit] = values[some] >> bit & 1
    return np.packbits(out).tobytes().replace(b"\xff", b"\xff\x00")


def encoded_jpeg(image: np.ndarray, quality: int = 82) -> bytes:
    """A baseline JPEG of a gray (height, width) or red-green-blue (height, width, 3) array."""
    height, width = image.shape[:2]
    if image.ndim == 3:
        r, g, b = np.moveaxis(image.astype(float), -1, 0)
        planes = [0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b]
    else:
        planes = [image.astype(float)]
    tables = [quantisation(t, quality) for t in (LUMINANCE, CHROMINANCE)[: min(2, len(planes))]]
    parts = [(np.full(len(s[0]), k), *s) for k, s in ((k, _symbols(coefficients(p, tables[min(k, 1)]))) for k, p in enumerate(planes))]
    component, block, first, symbol, size, amplitude = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((np.arange(len(block)), component, block))  # block by block, the components of each in turn
    component, first, symbol, size, amplitude = (x[order] for x in (component, first, symbol, size, amplitude))
    codes, bits, huffman = np.zeros(len(symbol), np.int64), np.zeros(len(symbol), np.int64), []
    for k in range(len(tables)):
        for kind in (0, 1):
            mine = (np.minimum(component, 1) == k) & (first == (kind == 0))
            code, length, text = _table(symbol[mine])
            codes[mine], bits[mine] = code[symbol[mine]], length[symbol[mine]]
            huffman.append(bytes([kind << 4 | k]) + text)
    data = _packed(codes << size | amplitude, bits + size)
    segment = lambda mark, body: b"\xff" + bytes([mark]) + struct.pack(">H", len(body) + 2) + body
    frame = struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([k + 1, 0x11, min(k, 1)]) for k in range(len(planes)))
    scan = bytes([len(planes)]) + b"".join(bytes([k + 1, min(k, 1) << 4 | min(k, 1)]) for k in range(len(planes))) + bytes([0, 63, 0])
    return b"".join([
        b"\xff\xd8", segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"), *[segment(0xDB, bytes([k]) + bytes(t[_ZIGZAG].tolist())) for k, t in enumerate(tables)],
        segment(0xC0, frame), *[segment(0xC4, h) for h in huffman], segment(0xDA, scan), data, b"\xff\xd9",
    ])
