"""Benchmark decontamination by multi-pattern search in the manner of Wu and Manber.

Every run of WINDOW words of a test item is a string to look for (an item of fewer
words is one string).  Texts and strings are brought into one form: A-Z lower-cased,
words between single blanks, a blank at either end, so a string occurs as bytes
exactly where its words occur as words.  Strings of about the same length form a
set.  Of every string in it the first m bytes count, m being the shortest length of the set.  A
table tells for each block of a few bytes how far the search may move on when it
reads that block: the least distance of the block from the end of those m bytes, or past it
where no string has the block.  Where the distance is 0, the block and the first bytes of
the place select a bucket of strings, and the bytes are compared.  Many stretches of
text are searched at once, each with a place of its own.

The strings are broadcast in shards of at most SHARD_BYTES.  A benchmark of more
becomes several shards, each searched for in a pass of its own over the documents, and the
documents' hits are put together by row.

Defined results: null texts have no words and no hits; an item without words occurs
nowhere.  Items without an item_id mark words but are not listed.  Rows that repeat a doc_id are
judged each by its own text, and so are rows that repeat an item_id, which is listed once.
Empty tables give no rows and no hits.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map
from .wordhash import ranges, row_pieces, text_bytes

WINDOW = 10
#: Bytes of strings, with their item ids, that are broadcast at once.
SHARD_BYTES = 16 << 20
#: Sets of strings: shortest length and bytes of a block.
_SETS = ((128, 8), (64, 8), (32, 8), (16, 8), (8, 4), (3, 2))
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Stretches of text that are searched side by side.
_LANES = 1024


@dataclass(frozen=True)
class Plain:
    """Neighbouring rows in one form: ' word word ' and a NUL per row."""

    first_row: int
    text: np.ndarray
    #: Places of the words' first bytes.
    starts: np.ndarray
    #: Row r (counted from first_row) has the words bounds[r] to bounds[r + 1].
    bounds: np.ndarray

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.bounds)


def plain_rows(column: pa.Array) -> Iterator[Plain]:
    data, offsets = text_bytes(column)
    for first, last in row_pieces(offsets):
        part, edges = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        solid = _WORD[part]
        begins, finish = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        finish[:-1] &= ~solid[1:]
        inner = edges[(edges > 0) & (edges < len(part))]
        begins[inner] = solid[inner]
        finish[inner - 1] = solid[inner - 1]
        at = np.flatnonzero(begins)
        length = np.flatnonzero(finish) + 1 - at
        bounds = np.searchsorted(at, edges)
        words = np.diff(bounds)
        # a blank before each word, and a blank and a NUL after each row
        starts = np.cumsum(length) - length + np.arange(1, len(at) + 1) + 2 * np.repeat(np.arange(len(words)), words)
        done = np.concatenate([[0], np.cumsum(length)])[bounds[1:]]
        ends = done + bounds[1:] + 2 * np.arange(len(words)) + 1
        size = int(ends[-1]) + 1
        inside = np.zeros(size + 1, np.int8)
        inside[starts] = 1
        inside[starts + length] -= 1
        out = np.full(size, 32, np.uint8)
        out[np.cumsum(inside[:-1], dtype=np.int8).view(bool)] = _LOWER[part[solid]]
        out[ends] = 0
        yield Plain(first, out, starts, bounds)


def windows(plain: Plain, size: int = WINDOW) -> Iterator[tuple[int, list[bytes]]]:
    """Row and the strings to look for of each row that has words."""
    whole = plain.text.tobytes()
    for row, (low, high) in enumerate(zip(plain.bounds[:-1], plain.bounds[1:], strict=True)):
        if high > low:
            places = plain.starts[low:high]
            stop = np.append(places[1:], whole.index(b"\0", places[-1]))  # one past the blank behind each word
            width = min(size, high - low)
            yield plain.first_row + row, [whole[a - 1 : b] for a, b in zip(places, stop[width - 1 :], strict=False)]


class StringSet:
    """Shift table and buckets of strings that have at least `least` bytes; numbers are the caller's."""

    def __init__(self, strings: list[bytes], numbers: list[int], block: int):
        self.least = min(map(len, strings))
        self.block = block
        self.numbers = dict(zip(strings, numbers, strict=True))
        self.mask = np.uint64((1 << 8 * block) - 1)
        heads = np.frombuffer(b"".join(s[: self.least] + b"\0" * 8 for s in strings), np.uint8).reshape(len(strings), -1)
        places = self.least - block + 1
        blocks = [self._values(heads, j) for j in range(places)]
        distinct = len(np.unique(np.concatenate(blocks)))
        self.drop = np.uint64(64 - min(24, max(12, int(distinct).bit_length() + 3)))
        self.shift = np.full(1 << int(64 - self.drop), min(places, 255), np.uint8)
        for j, values in enumerate(blocks):
            self.shift[self._slots(values)] = min(places - 1 - j, 255)
        keys = self._keys(blocks[-1], self._values(heads, 0))
        self.buckets: dict[int, set[int]] = {}
        for key, string in zip(keys.tolist(), strings, strict=True):
            self.buckets.setdefault(key, set()).add(len(string))
        self.known = np.array(sorted(self.buckets), np.uint64)

    def _values(self, heads: np.ndarray, at: int) -> np.ndarray:
        return np.ascontiguousarray(heads[:, at : at + 8]).view("<u8")[:, 0] & self.mask

    def _slots(self, values: np.ndarray) -> np.ndarray:
        return (values * _ODD) >> self.drop

    @staticmethod
    def _keys(suffixes: np.ndarray, heads: np.ndarray) -> np.ndarray:
        return (suffixes * _ODD) ^ heads

    def places(self, blocks: np.ndarray, size: int) -> np.ndarray:
        """Where blocks stand that end the first bytes of some string; `blocks` has the eight bytes from each place on."""
        first, last = self.least - self.block, size - self.block + 1
        if last <= first:
            return np.zeros(0, np.int64)
        lanes = min(_LANES, last - first)
        edges = first + (last - first) * np.arange(lanes + 1) // lanes
        at, end, found = edges[:-1], edges[1:], []
        while len(at):
            step = self.shift[self._slots(blocks[at] & self.mask)].astype(np.int64)
            hit = step == 0
            if hit.any():
                found.append(at[hit])
                step[hit] = 1
            at = at + step
            live = at < end
            if not live.all():
                at, end = at[live], end[live]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def occurrences(self, whole: bytes, blocks: np.ndarray, size: int) -> list[tuple[int, int, int]]:
        """Place, length and number of every string that stands in the text."""
        at = self.places(blocks, size)
        starts = at - (self.least - self.block)
        keys = self._keys(blocks[at] & self.mask, blocks[starts] & self.mask)
        slots = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        same = self.known[slots] == keys
        out = []
        for start, key in zip(starts[same].tolist(), keys[same].tolist(), strict=True):
            for length in self.buckets[key]:
                number = self.numbers.get(whole[start : start + length])
                if number is not None:
                    out.append((start, length, number))
        return out


class Strings:
    """All strings of a shard, in sets of about the same length, and the items that have them."""

    def __init__(self, strings: list[bytes], items: list[list[str]]):
        self.items = items
        self.sets = []
        lengths = np.array([len(s) for s in strings])
        upper = 1 << 62
        for least, block in _SETS:
            chosen = np.flatnonzero((lengths >= least) & (lengths < upper)).tolist()
            upper = least
            if chosen:
                self.sets.append(StringSet([strings[i] for i in chosen], chosen, block))

    def hits(self, plain: Plain) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Per word whether an occurrence covers it; (row, number) of each string that a row holds."""
        size = len(plain.text)
        padded = np.concatenate([plain.text, np.zeros(8, np.uint8)])
        blocks = np.ndarray(size, "<u8", padded, strides=(1,))
        whole = plain.text.tobytes()
        found = [x for s in self.sets for x in s.occurrences(whole, blocks, size)]
        cover = np.zeros(len(plain.starts) + 1, np.int64)
        if not found:
            return cover[:-1] > 0, []
        start, length, number = (np.array(x) for x in zip(*found, strict=True))
        first, last = np.searchsorted(plain.starts, start), np.searchsorted(plain.starts, start + length)
        np.add.at(cover, first, 1)
        np.add.at(cover, last, -1)
        row = plain.first_row + np.searchsorted(plain.bounds, first, "right") - 1
        return np.cumsum(cover[:-1]) > 0, list(zip(row.tolist(), number.tolist(), strict=True))


def test_strings(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """string (binary), items: the ids of the items that hold it; every distinct string once."""

    def cut(batch: pa.RecordBatch) -> dict:
        ids, out_ids, strings = batch.column(1).to_pylist(), [], []
        for plain in plain_rows(batch.column(0)):
            for row, found in windows(plain, window):
                found = set(found)
                out_ids += [ids[row]] * len(found)
                strings += found
        return {"string": strings, "item_id": out_ids}

    cutting = arrow_map(benchmark.select("text", F.col("item_id").cast("string")), cut, "string binary, item_id string")
    return cutting.groupBy("string").agg(F.collect_set("item_id").alias("items"))


def _searched(docs: DataFrame, strings: Strings) -> DataFrame:
    """The rows of docs with n_words, hits (runs of word numbers from, until) and items (ids of a shard's items)."""
    kept = [c for c in docs.columns if c != "text"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")

    def search(batch: pa.RecordBatch) -> dict:
        n = batch.num_rows
        n_words, hits, items = np.zeros(n, np.int64), [[]] * n, [[]] * n
        for plain in plain_rows(batch.column(batch.schema.get_field_index("text"))):
            n_words[plain.first_row : plain.first_row + len(plain.n_words)] = plain.n_words
            cover, found = strings.hits(plain)
            by_row: dict[int, set[int]] = {}
            for row, number in found:
                by_row.setdefault(row, set()).add(number)
            for row, numbers in by_row.items():
                low, high = plain.bounds[row - plain.first_row : row - plain.first_row + 2]
                turns = np.flatnonzero(np.diff(np.concatenate([[False], cover[low:high], [False]])))
                hits[row] = [{"from": int(a), "until": int(b)} for a, b in turns.reshape(-1, 2)]
                items[row] = sorted({item for i in numbers for item in strings.items[i]})
        return {c: batch.column(batch.schema.get_field_index(c)) for c in kept} | {"n_words": n_words, "hits": hits, "items": items}

    return arrow_map(docs, search, f"{fields}, n_words long, hits array<struct<`from`: long, `until`: long>>, items array<string>")


def _merged(hits: Column) -> Column:
    """Sorted runs as disjoint ones."""

    def add(done: Column, run: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["from"].alias("from"), F.greatest(last["until"], run["until"]).alias("until"))
        touches = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["until"] >= run["from"])
        return F.when(touches, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(run)))

    return F.aggregate(F.sort_array(hits), F.array().cast("array<struct<`from`: bigint, `until`: bigint>>"), add)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, hits (disjoint runs of hit words, numbered from 0) and items (sorted ids of the items found) per document."""
    scratch = Scratch(docs.sparkSession)
    strings = scratch.keep(test_strings(benchmark, window))
    weight = F.octet_length("string") + 16 + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 16)
    shards = int(strings.agg(F.ceil(F.sum(weight.cast("long")) * 2 / shard_bytes)).first()[0] or 0) or 1
    rows = docs.select("doc_id", "text")
    if shards > 1:  # a number per row, written so that every pass sees the same one
        rows = scratch.keep(rows.withColumn("row", F.monotonically_increasing_id()))
    passes = []
    for shard in range(shards):
        part = strings.filter(F.pmod(F.xxhash64("string"), F.lit(shards)) == shard).orderBy("string").toArrow()
        passes.append(_searched(rows, Strings(part.column("string").to_pylist(), part.column("items").to_pylist())))
    if shards == 1:
        return passes[0].select("doc_id", "n_words", "hits", "items")
    both = scratch.keep(passes[0])
    for one in passes[1:]:
        both = both.unionByName(scratch.keep(one))
    merged = both.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items"))
    return merged.select("doc_id", "n_words", _merged(F.col("hits")).alias("hits"), F.array_sort(F.array_distinct("items")).alias("items"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that hold a window of the benchmark; rows without a doc_id stay."""
    bad = benchmark_hits(docs.filter("doc_id is not null"), benchmark).filter(F.size("hits") > 0).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated per document."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, run: a + run["until"] - run["from"])
    return benchmark_hits(docs, benchmark).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )
