"""What five quality filters remove alone, together and in every order.

Filters, as failure conditions of a whole text: A under 200 words, B fewer distinct words than half of
them, C more than 3 in 100 characters in A-Z, D any of #$%&*|, E the text of a
document with a smaller doc_id.

E needs equal texts to meet.  Texts are dealt by range over adaptive prefixes: a prefix
is lengthened (PREFIXES) while more than its share of all bytes begins with it,
and texts that still share the longest are told apart by a hash of the whole.  So every task gets a
stretch of text order, and groups of equal (prefix, hash) one after the other.  Each group is
inserted into a compressed radix trie whose terminals hold the smallest id of their text;
walking the trie gives every document its flag.  Before the exchange, a task
settles each row whose text (by SHA-256) it has already seen with a smaller id: that row fails E
anyway and travels without its text, so copies are not gathered.  Rows of a batch that agree in
doc_id, lang and text travel as one.

The flags become masks of five bits, counted by part, mask and labels.  All
orders are worked out from these counts: what a filter does at a step depends only on
the set of filters before it.

Defined results: null texts are empty; a null lang is the part ''.  A document without doc_id is never
smaller than another and never fails E; neither do rows that share the smallest doc_id of their text.
Documents count as good (toxic) if any of their label rows says so; labels without doc_id say nothing.
An empty table has no parts.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, bound_batches
from .wordhash import text_bytes

FILTERS = "ABCDE"
MIN_WORDS = 200
#: Characters of a prefix, tried in this order while it is crowded.
PREFIXES = (4, 16, 64, 256, 1024)
#: A partition's share of text bytes that the number of partitions aims at.
PARTITION_BYTES = 32 << 20
#: Rows after which a trie is walked and given up, at the end of its group.
_TRIE_ROWS = 1000
_CAPITALS = bytes(range(65, 91))
_SYMBOLS = b"#$%&*|"
_FOLLOWING = bytes(range(0x80, 0xC0))
_DUPLICATE = 1 << FILTERS.index("E")


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text (UTF-8) fails."""
    words = text.split()  # breaks at 0x20 and 0x09-0x0D only
    n, size = len(words), len(text)
    characters = len(text.translate(None, _FOLLOWING))
    capitals = size - len(text.translate(None, _CAPITALS))
    symbols = size - len(text.translate(None, _SYMBOLS))
    return (n < MIN_WORDS) | (100 * len(set(words)) < 50 * n) << 1 | (100 * capitals > 3 * characters) << 2 | (symbols > 0) << 3


class Trie:
    """A compressed radix trie over bytes; its terminals hold the smallest id of their text and who has it."""

    def __init__(self):
        self.root = [b"", {}, None]

    def insert(self, text: bytes, doc_id: int | None, row) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                leaf = [text[at:], {}, None]
                node[1][text[at]] = leaf
                node = leaf
                break
            edge = child[0]
            if text.startswith(edge, at):
                node, at = child, at + len(edge)
                continue
            low, high = 1, min(len(edge), len(text) - at)  # the first byte is equal
            while low < high:
                middle = (low + high + 1) // 2
                if text.startswith(edge[:middle], at):
                    low = middle
                else:
                    high = middle - 1
            between = [edge[:low], {edge[low]: child} if low < len(edge) else {}, None]
            child[0] = edge[low:]
            node[1][text[at]] = between
            node, at = between, at + low
        if node[2] is None:
            node[2] = [doc_id, [(doc_id, row)]]
            return
        least = node[2][0]
        node[2][0] = doc_id if least is None else least if doc_id is None else min(least, doc_id)
        node[2][1].append((doc_id, row))

    def flags(self) -> Iterator[tuple[object, bool]]:
        """Every inserted row and whether its text has a smaller id."""
        below = [self.root]
        while below:
            _, children, held = below.pop()
            below.extend(children.values())
            if held is not None:
                for doc_id, row in held[1]:
                    yield row, doc_id is not None and held[0] < doc_id


def _levels(text: Column) -> list[Column]:
    return [F.xxhash64(F.substring(text, 1, n)) for n in PREFIXES]


def crowded_prefixes(texts: DataFrame, partitions: int) -> tuple[list[np.ndarray], int]:
    """Per length the hashes of the prefixes that begin over a quarter of a partition's share of all bytes, and all bytes.

    At most 4 hashes per partition and length, whatever the texts.
    """
    size = F.octet_length("text").cast("long")
    total = texts.agg(F.sum(size)).first()[0] or 0
    pairs = F.array(*[F.struct(F.lit(i).alias("level"), h.alias("h")) for i, h in enumerate(_levels(F.col("text")))])
    sums = texts.select(F.explode(pairs).alias("p"), size.alias("size")).groupBy("p.level", "p.h").agg(F.sum("size").alias("size"))
    out: list[list[int]] = [[] for _ in PREFIXES]
    for level, h in sums.filter(F.col("size") > total / (4 * _partitions(partitions, total))).select("level", "h").collect():
        out[level].append(h)
    return [np.array(sorted(x), np.int64) for x in out], total


def _partitions(least: int, total: int) -> int:
    return max(least, math.ceil(total / PARTITION_BYTES))


def _screened(docs: DataFrame, crowded: list[np.ndarray]) -> DataFrame:
    """doc_id, lang, n (rows alike), fails (A to D), text (null where the rows are settled), width of the prefix, slice."""

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            whole, ids, langs = data.tobytes(), batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [whole[a:b] for a, b in itertools.pairwise(offsets.tolist())]
            alike: dict[tuple, list] = {}  # row, n, fails, text
            for i in sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i])):
                digest = hashlib.sha256(texts[i]).digest()
                known = alike.setdefault((ids[i], langs[i], digest), [i, 0, 0, None])
                known[1] += 1
                if known[1] > 1:
                    continue
                known[2] = failures(texts[i])
                if ids[i] is None:
                    continue
                if seen.get(digest, ids[i]) < ids[i]:
                    known[2] |= _DUPLICATE
                else:
                    seen[digest] = ids[i]
                    known[3] = texts[i]
            width, apart = np.zeros(len(ids), np.int32), np.ones(len(ids), bool)
            for level, length in enumerate(PREFIXES):
                width[apart] = length
                apart &= np.isin(batch.column(3 + level).to_numpy(zero_copy_only=False), crowded[level])
            slices = np.where(apart, batch.column(3 + len(PREFIXES)).to_numpy(zero_copy_only=False), 0)
            rows, n, fails, kept = (list(x) for x in zip(*alike.values(), strict=True)) if alike else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), batch.column(1).take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), pa.array(fails, pa.int32()), pa.array(kept, pa.binary()), pa.array(width[rows]), pa.array(slices[rows])],
                ["doc_id", "lang", "n", "fails", "text", "width", "slice"],
            )

    bound_batches(docs.sparkSession)
    levels = [h.alias(f"h{i}") for i, h in enumerate(_levels(F.col("text")))]
    found = docs.select("doc_id", "lang", "text", *levels, F.xxhash64("text").alias("h"))
    return found.mapInArrow(screen, "doc_id long, lang string, n long, fails int, text binary, width int, slice long")


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (prefix, slice) to doc_id, lang, n, fails with the bit of E; a trie takes whole groups of equal (prefix, slice)."""

    def of(trie: Trie) -> Iterator[pa.RecordBatch]:
        rows = [(doc_id, lang, n, fails | (_DUPLICATE if later else 0)) for (doc_id, lang, n, fails), later in trie.flags()]
        if rows:
            types = (pa.int64(), pa.string(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "lang", "n", "fails"])

    trie, key, held = Trie(), None, 0
    for batch in batches:
        for doc_id, lang, n, fails, text, prefix, slice_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (prefix, slice_) != key:
                key = (prefix, slice_)
                if held >= _TRIE_ROWS:
                    yield from of(trie)
                    trie, held = Trie(), 0
            trie.insert(text, doc_id, (doc_id, lang, n, fails))
            held += 1
    yield from of(trie)


def failure_masks(docs: DataFrame) -> DataFrame:
    """doc_id, lang, fails, n: bits 0 to 4 for the filters A to E that a document's text fails, and how many rows alike a row stands for."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    crowded, total = crowded_prefixes(texts, partitions)
    prefix = F.substring(F.col("text").cast("string"), F.lit(1), F.col("width")).cast("binary")
    screened = scratch.keep(_screened(texts, crowded).withColumn("prefix", prefix))
    apart = screened.filter("text is not null").select("doc_id", "lang", "n", "fails", "text", "prefix", "slice")
    dealt = apart.repartitionByRange(_partitions(partitions, total), "prefix", "slice").sortWithinPartitions("prefix", "slice")
    flagged = dealt.mapInArrow(_flagged, "doc_id long, lang string, n long, fails int")
    return flagged.unionByName(screened.filter("text is null").select("doc_id", "lang", "n", "fails"))


def _steps() -> list[tuple[int, int, str, int]]:
    """(filters before, filter, order, step) of all orders; sets of filters as bits."""
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[f] for f in order), 0
        for step, f in enumerate(order):
            out.append((before, 1 << f, name, step + 1))
            before |= 1 << f
    return out


def order_audit(counts: DataFrame) -> DataFrame:
    """From counts (part, fails, good, toxic, n): one row per part, filter_order and step."""
    steps: dict[tuple[int, int], list[str]] = {}
    for before, bit, order, step in _steps():
        steps.setdefault((before, bit), []).append(f"named_struct('filter_order', '{order}', 'step', {step})")
    cases = ", ".join(f"named_struct('before', {before}, 'bit', {bit}, 'places', array({', '.join(places)}))" for (before, bit), places in steps.items())
    fails, before, bit = F.col("fails"), F.col("c.before"), F.col("c.bit")
    hit, earlier = fails.bitwiseAND(bit) != 0, fails.bitwiseAND(before) != 0

    def total(condition: Column, weight: Column = F.lit(1)) -> Column:
        return F.sum(F.when(condition, F.col("n") * weight).otherwise(0)).cast("long")

    found = counts.withColumn("c", F.explode(F.expr(f"array({cases})"))).groupBy("part", before.alias("before"), bit.alias("bit"), F.col("c.places").alias("places")).agg(
        total(~hit & ~earlier).alias("kept"), total(hit & ~earlier).alias("removed"), total(hit & earlier).alias("redundant"), total(fails == bit).alias("unique_fails"),
        total(hit & ~earlier & F.col("good")).alias("good_lost"), total(hit & ~earlier & F.col("toxic")).alias("toxic_lost"),
        # of all orders, a text is removed by each of the filters it fails equally often
        total(hit, F.lit(math.factorial(len(FILTERS))) / F.greatest(F.bit_count(fails), F.lit(1))).alias("shapley"),
    )
    return found.select("part", F.inline("places"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    judged = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marked = failure_masks(docs).join(judged, "doc_id", "left")
    key = (F.coalesce("lang", F.lit("")).alias("part"), "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    return order_audit(marked.groupBy(*key).agg(F.sum("n").alias("n")))
