"""SentencePiece encoding and decoding by batched Viterbi in numpy.

Texts are escaped as SentencePiece does (a space in front, spaces as U+2581),
cut where no piece can cross, and the distinct chunks of a batch are grouped by length.
All chunks of one length advance together: hashes of all their substrings
probe the sorted hashes of the pieces, and for each end place the maximum over
piece lengths is kept with its backpointer.  The segmentation is the one of
greatest total piece score (the unigram algorithm); of equal ones the longer
last piece wins.  Characters without a piece fall back to their UTF-8 bytes.

Decoding concatenates the bytes of the pieces and takes the leading space off;
it restores every text exactly, U+2581 included, since that character is always
encoded as bytes.

Defined results: null and empty texts have no ids; null decodes as the empty text.
Repeated rows are encoded alike, extra columns ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, bound_batches
from .wordhash import mix, prefix_sums, run_hashes

SPACE = "▁"
#: Characters of text handled at once, and chunks remembered between batches.
SLICE_CHARS = 1_000_000
CACHE_CHUNKS = 200_000
#: Longer chunks are looked through for places to cut.
LONG_CHUNK = 24
#: Score below the least piece for a character that has none.
UNKNOWN_PENALTY = 10.0
_FILTER_BITS = 20


@dataclass
class PieceTable:
    """Pieces by id with scores, as a model file has them."""

    pieces: list[str]
    scores: np.ndarray
    byte_ids: np.ndarray
    silent: frozenset[int] = frozenset()
    keys: np.ndarray = field(init=False, repr=False)
    key_ids: np.ndarray = field(init=False, repr=False)
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        by_byte = {int(i): b for b, i in enumerate(self.byte_ids)}
        plain = [i for i in range(len(self.pieces)) if i not in by_byte and i not in self.silent and self.pieces[i]]
        keys = np.array([_text_key(self.pieces[i]) for i in plain], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_ids = keys[order], np.array(plain, np.int32)[order]
        if (np.diff(self.keys) == 0).any():
            raise ValueError("two pieces share a hash")
        self.longest = max(len(self.pieces[i]) for i in plain)
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[self.keys >> np.uint64(64 - _FILTER_BITS)] = True
        self.unknown = float(min(self.scores[i] for i in plain)) - UNKNOWN_PENALTY
        raw = [bytes([by_byte[i]]) if i in by_byte else b"" if i in self.silent else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_len = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in plain):
            raise ValueError("pieces that cross a space are not supported")
        # neighbours inside some piece: nowhere else does a piece cross
        inside = [_code_points(self.pieces[i]).astype(np.uint64) for i in plain]
        self.pairs = np.unique(np.concatenate([p[:-1] << np.uint64(32) | p[1:] for p in inside]))
        self.newline_alone = not any("\n" in self.pieces[i] for i in plain)

    @classmethod
    def load(cls, path: str) -> PieceTable:
        """Read a model file on the driver; the table is as large as the vocabulary."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        silent = frozenset(i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        return cls([model.id_to_piece(i) for i in ids], np.array([model.get_score(i) for i in ids], float), byte_ids, silent)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _text_key(text: str) -> np.uint64:
    sums = prefix_sums(mix(_code_points(text).astype(np.uint64)))
    return mix(sums[-1:] + np.uint64(len(text)))[0]


class Encoder:
    """Encodes batches; remembers the ids of chunks it has met, up to a fixed number."""

    def __init__(self, table: PieceTable):
        self.table = table
        cut = r"\n" if table.newline_alone else ""
        self.chunks = re.compile(f"{SPACE}+[^{SPACE}{cut}]*|[^{SPACE}{cut}]+" + (r"|\n" if cut else ""))
        self.literal = object()
        self._reset()

    def _reset(self) -> None:
        self.place: dict = {self.literal: 0}
        self.flat = self.table.byte_ids[list(SPACE.encode())]
        self.at, self.size = np.zeros(1, np.int64), np.full(1, len(self.flat), np.int64)

    def _split(self, text: str) -> list:
        if SPACE not in text:
            return self._chunks(SPACE + text.replace(" ", SPACE))
        out: list = []
        for i, part in enumerate(text.split(SPACE)):
            if i:
                out.append(self.literal)
            out += self._chunks((SPACE if i == 0 else "") + part.replace(" ", SPACE))
        return out

    def _chunks(self, text: str) -> list[str]:
        """The chunks of a text; long ones, unspaced scripts for instance, are cut further between characters that stand together in no piece."""
        found = self.chunks.findall(text)
        if len(found) and max(map(len, found)) > LONG_CHUNK:
            return [part for chunk in found for part in (self._cut(chunk) if len(chunk) > LONG_CHUNK else (chunk,))]
        return found

    def _cut(self, chunk: str) -> list[str]:
        points, pairs = _code_points(chunk).astype(np.uint64), self.table.pairs
        beside = points[:-1] << np.uint64(32) | points[1:]
        met = pairs[np.minimum(np.searchsorted(pairs, beside), len(pairs) - 1)] == beside
        cuts = [0, *(np.flatnonzero(~met) + 1).tolist(), len(chunk)]
        return [chunk[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as int32 arrays."""
        split = [self._split(t) if t else [] for t in texts]
        flat = [c for chunks in split for c in chunks]
        if len(self.place) > CACHE_CHUNKS:
            self._reset()
        fresh = list(dict.fromkeys(c for c in flat if c not in self.place))
        if fresh:
            self._learn(fresh)
        where = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        sizes = self.size[where]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.at[where] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.cumsum([len(c) for c in split])] if split else []
        return np.split(ids, bounds[:-1]) if len(split) else []

    def _learn(self, chunks: list[str]) -> None:
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ids: list[np.ndarray] = []
        order: list[int] = []
        for n in np.unique(lengths):
            group = np.flatnonzero(lengths == n)
            step = max(1, 200_000 // int(n))
            for i in range(0, len(group), step):
                part = group[i : i + step]
                ids += self._viterbi([chunks[k] for k in part], int(n))
                order += part.tolist()
        start, base = len(self.flat), len(self.at)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.flat = np.concatenate([self.flat, *ids])
        self.at = np.concatenate([self.at, start + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.place.update((chunks[k], base + j) for j, k in enumerate(order))

    def _viterbi(self, chunks: list[str], n: int) -> list[np.ndarray]:
        table, m = self.table, len(chunks)
        points = _code_points("".join(chunks)).reshape(m, n)
        sums = prefix_sums(mix(points.ravel().astype(np.uint64)))
        starts = np.arange(m * n).reshape(m, n)
        top = min(n, table.longest)
        scores, found = [None] * (top + 1), [None] * (top + 1)
        for size in range(1, top + 1):
            at = starts[:, : n - size + 1].T
            keys = mix(run_hashes(sums, at, at + size) + np.uint64(size))
            maybe = np.flatnonzero(table.seen[keys >> np.uint64(64 - _FILTER_BITS)].ravel())
            probe = keys.ravel()[maybe]
            slot = np.minimum(np.searchsorted(table.keys, probe), len(table.keys) - 1)
            hit = table.keys[slot] == probe
            piece = np.full(keys.size, -1, np.int32)
            piece[maybe[hit]] = table.key_ids[slot[hit]]
            found[size] = piece.reshape(keys.shape)
            scores[size] = np.where(found[size] >= 0, table.scores[found[size]], table.unknown if size == 1 else -np.inf)
        best = np.full((n + 1, m), -np.inf)
        best[0] = 0
        back = np.ones((n + 1, m), np.int16)
        for end in range(1, n + 1):
            for size in range(min(top, end), 0, -1):
                total = best[end - size] + scores[size][end - size]
                better = total > best[end]
                best[end][better] = total[better]
                back[end][better] = size
        left, rows = np.full(m, n), np.arange(m)
        steps = []
        while len(rows):
            size = back[left, rows]
            left = left - size
            steps.append((rows, left.copy(), size))
            rows, left = rows[left > 0], left[left > 0]
        row, at, size = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.lexsort((at, row))
        row, at, size = row[order], at[order], size[order]
        piece = np.empty(len(row), np.int32)
        for k in np.unique(size):
            pick = size == k
            piece[pick] = found[k][at[pick], row[pick]]
        return self._with_bytes(chunks, row, at, piece)

    def _with_bytes(self, chunks: list[str], row: np.ndarray, at: np.ndarray, piece: np.ndarray) -> list[np.ndarray]:
        bounds = np.searchsorted(row, np.arange(1, len(chunks)))
        out = np.split(piece, bounds)
        unknown = np.flatnonzero(piece < 0)
        for r in np.unique(row[unknown]):
            own = np.flatnonzero(row == r) if len(chunks) < 64 else np.arange(*np.searchsorted(row, [r, r + 1]))
            parts = []
            for i in own:
                parts.append(piece[i : i + 1] if piece[i] >= 0 else self.table.byte_ids[list(chunks[r][at[i]].encode("utf-8", "surrogatepass"))])
            out[r] = np.concatenate(parts)
        return out


def decode(table: PieceTable, ids: np.ndarray) -> str:
    """The text of the ids of one document."""
    if not len(ids):
        return ""
    sizes = table.raw_len[ids]
    ends = np.cumsum(sizes)
    raw = table.raw[np.repeat(table.raw_at[ids] - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes()
    text = raw.decode("utf-8", "surrogatepass")
    return text.removeprefix(" ")


def _slices(texts: list[str | None]):
    start, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= SLICE_CHARS:
            yield texts[start : i + 1]
            start, chars = i + 1, 0
    yield texts[start:]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str, table: PieceTable) -> Encoder:
    """One encoder per Python worker, so that its memory of chunks outlives a batch."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(table)
    return _ENCODERS[path]


def encoded(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids: one row per document row."""
    table = docs.sparkSession.sparkContext.broadcast(PieceTable.load(model_path))  # as large as the vocabulary
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            doc_ids, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text"))
            encoder, start = _encoder(model_path, table.value), 0
            for part in _slices(texts.to_pylist()):  # one output batch per slice keeps memory even
                rows = encoder.encode(part)
                sizes = np.fromiter(map(len, rows), np.int64, len(rows))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([doc_ids.slice(start, len(part)), pa.array(sizes), ids], ["doc_id", "n_tokens", "ids"])
                start += len(part)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def codec_digest(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document row: doc_id, n_tokens, SHA-256 of the ids as little-endian 32-bit integers, and whether decoding restores the text."""
    table = docs.sparkSession.sparkContext.broadcast(PieceTable.load(model_path))

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        encoder = _encoder(model_path, table.value)
        out = {"doc_id": batch.column(batch.schema.get_field_index("doc_id")), "n_tokens": [], "ids_sha256": [], "round_trip": []}
        for part in _slices(texts):
            for text, ids in zip(part, encoder.encode(part), strict=True):
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(np.ascontiguousarray(ids, "<i4").tobytes()).hexdigest())
                out["round_trip"].append(decode(table.value, ids) == (text or ""))
        return out

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean")


def public_model_path() -> str:
    """The SentencePiece model of the installed public_tokenizers package."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))
