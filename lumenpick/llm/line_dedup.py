"""Line deduplication by a deletion-neighbourhood join.

A line goes if an earlier line of the corpus (smaller doc_id, then smaller line
number) has the same words, or, from MIN_WORDS words on, the same words up to one
word inserted, dropped or replaced.  Lines are compared by their words, so spacing
does not matter.

1. Lines are reduced to hashes where the text is read; equal lines collapse to
   their earliest place, and the hot ones with them.
2. Two lines within one edit share their first or their last words up to half of the
   shorter line.  Distinct lines that share such a half with no other line have no
   near line and leave here.
3. The rest emit, as hashed keys, the line itself and every variant with one word
   of the half that may differ left out, once with and once without the place.
   Equal keys join: a key with its place holds lines that differ in that word
   only, and a key without it holds one whole line and lines with one more word.
   So the earliest line of a key is within the bound of all others (or of the
   whole line), and no pairs are listed.
4. The partner so found is verified on the words, word by word.

Defined results: null texts have no lines; lines without words are never removed;
lines of fewer than MIN_WORDS words go as exact repeats only, since one word of so few
makes another line.  Rows that repeat a doc_id are cut by their own texts, and lines
at the same place tie and all stay.  Rows without a doc_id have no place in the order:
they are returned whole and remove nothing.  Lines are judged on the input, not on what
is left.  Extra columns pass through where whole rows are returned, whatever their names;
dedup_lines replaces columns named n_lines, n_removed or kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import Scratch, arrow_map, words_of
from .wordhash import column_words, joined, mix, offsets_array, prefix_sums, ranges, run_hashes

#: Shorter lines go as exact repeats only.
MIN_WORDS = 5

_HEAD, _TAIL = 1, 2


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _gathered(parts: list[dict], kinds: dict[str, pa.DataType]) -> dict:
    """Columns of several pieces, one after the other."""
    return {k: pa.concat_arrays([v if isinstance(v := p[k], pa.Array) else pa.array(v, t) for p in parts]) if parts else pa.array([], t) for k, t in kinds.items()}


_LINE = {"doc_id": pa.int64(), "row": pa.int64(), "line_no": pa.int32(), "h1": pa.int64(), "h2": pa.int64(), "halves": pa.list_(pa.int64())}


def _line_rows(min_words: int):
    """Per line with words: its place, two hashes of its words and, from min_words on, the hashes of its halves."""

    def run(batch: pa.RecordBatch) -> dict:
        parts, ids, own = [], _column(batch, "doc_id").to_numpy(zero_copy_only=False), _column(batch, "row").to_numpy(zero_copy_only=False)
        for words in column_words(_column(batch, "text")):
            if not len(words.hashes):
                continue
            rows, breaks = words.rows, np.flatnonzero(words.data == 10)
            above = np.searchsorted(breaks, words.starts)
            first = np.flatnonzero(np.r_[True, (np.diff(above) != 0) | (np.diff(rows) != 0)])
            ends = np.append(first[1:], len(rows))
            sizes, rows = ends - first, rows[first]
            # line breaks between the beginning of the row and the line
            row_starts = np.searchsorted(breaks, words.row_starts)[rows - words.first_row]
            sums, other = prefix_sums(words.hashes), prefix_sums(mix(words.hashes ^ np.uint64(0x5851F42D4C957F2D)))
            keys = []
            for half in (sizes // 2, (sizes - 1) // 2):
                salt = half.astype(np.uint64) * np.uint64(4)
                keys.append(mix(run_hashes(sums, first, first + half) + salt + np.uint64(_HEAD)))
                keys.append(mix(run_hashes(sums, ends - half, ends) + salt + np.uint64(_TAIL)))
            # both halves of an odd line are the same words
            used = np.where(sizes < min_words, 0, np.where(sizes % 2 == 0, 4, 2))
            flat = np.stack(keys, axis=1)[np.arange(4) < used[:, None]]
            parts.append({
                "doc_id": ids[rows], "row": own[rows], "line_no": (above[first] - row_starts).astype(np.int32), "halves": offsets_array(flat.view(np.int64), used),
                "h1": mix(run_hashes(sums, first, ends)).view(np.int64), "h2": mix(run_hashes(other, first, ends)).view(np.int64),
            })
        return _gathered(parts, _LINE)

    return run


def _wanted_lines(batch: pa.RecordBatch) -> dict:
    """The words of the wanted lines of a text."""
    out = {k: [] for k in ("h1", "h2", "sides", "doc_id", "line_no", "words")}
    columns = (_column(batch, k).to_pylist() for k in ("doc_id", "text", "wanted"))
    for doc_id, text, wanted in zip(*columns, strict=True):
        lines = text.split("\n")
        for w in wanted:
            out["doc_id"].append(doc_id)
            out["words"].append(b" ".join(words_of(lines[w["line_no"]])).decode("utf-8", "surrogatepass"))
            for k in ("h1", "h2", "sides", "line_no"):
                out[k].append(w[k])
    return out


_KEYED = {"h1": pa.int64(), "h2": pa.int64(), "doc_id": pa.int64(), "line_no": pa.int32(), "key": pa.int64(), "kind": pa.int32()}


def _variant_rows(batch: pa.RecordBatch) -> dict:
    """The keys of a line: itself, and itself without one word of a half that may differ.

    sides: 1 if another line has the same head (so the tail may differ), 2 for the tail, 3 for both.
    """
    parts = []
    sides, *places = (_column(batch, k).to_numpy() for k in ("sides", "h1", "h2", "doc_id", "line_no"))
    for words in column_words(_column(batch, "words")):
        n = np.diff(words.bounds)
        lines = words.first_row + np.arange(len(n))
        head, tail = (sides[lines] & _HEAD) > 0, (sides[lines] & _TAIL) > 0
        # the shared half may be as short as (n - 1) // 2 words
        low, high = np.where(tail, 0, (n - 1) // 2), np.where(head, n, n - (n - 1) // 2)
        variants = high - low
        line, at = np.repeat(np.arange(len(n)), variants), ranges(low, variants)
        first, size = words.bounds[line], n[line].astype(np.uint64)
        sums = prefix_sums(words.hashes)
        without = joined(run_hashes(sums, first, first + at), run_hashes(sums, first + at + 1, words.bounds[line + 1]), at)
        placed = mix(without + (at.astype(np.uint64) + size + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) + size)
        whole = mix(run_hashes(sums, words.bounds[:-1], words.bounds[1:]) + n.astype(np.uint64))
        keys, of = np.concatenate([placed, mix(without + size - np.uint64(1)), whole]), np.concatenate([line, line, np.arange(len(n))])
        kinds = np.repeat(np.arange(3, dtype=np.int32), [len(line), len(line), len(n)])
        parts.append({k: v[lines[of]] for k, v in zip(("h1", "h2", "doc_id", "line_no"), places, strict=True)} | {"key": keys.view(np.int64), "kind": kinds})
    return _gathered(parts, _KEYED)


def within_one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether two word lists differ by at most one word inserted, dropped or replaced."""
    if abs(len(a) - len(b)) > 1:
        return False
    short = min(len(a), len(b))
    head = next((i for i in range(short) if a[i] != b[i]), short)
    tail = next((i for i in range(short - head) if a[-1 - i] != b[-1 - i]), short - head)
    return max(len(a), len(b)) - head - tail <= 1


@F.arrow_udf(BooleanType())
def _verified(left: pa.Array, right: pa.Array) -> pa.Array:
    pairs = zip(left.to_pylist(), right.to_pylist(), strict=True)
    return pa.array([within_one_edit(words_of(a), words_of(b)) for a, b in pairs], pa.bool_())


def _order() -> Column:
    return F.struct("doc_id", "line_no")


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, row (hash of the text), lines: the numbers of the lines that go, where there are any."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("row"), "text")
    lines = scratch.keep(arrow_map(texts, _line_rows(min_words), "doc_id long, row long, line_no int, h1 long, h2 long, halves array<long>"))
    distinct = lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no", "row")).alias("first"), F.any_value("halves").alias("halves"), F.count("*").alias("copies"))
    distinct = scratch.keep(distinct)

    halves = distinct.select("h1", "h2", F.posexplode("halves").alias("side", "half")).withColumn("side", F.col("side") % 2 + 1)
    shared = halves.groupBy("half").agg(F.count("*").alias("lines")).filter("lines > 1").select("half")
    sides = halves.join(shared, "half").groupBy("h1", "h2").agg(F.bit_or("side").alias("sides"))
    candidates = distinct.select("h1", "h2", "first").join(sides, ["h1", "h2"])
    wanted = candidates.groupBy("first.doc_id", "first.row").agg(F.collect_list(F.struct("first.line_no", "h1", "h2", "sides")).alias("wanted"))
    # of repeated rows one is enough
    near = arrow_map(texts.join(wanted, ["doc_id", "row"]), _wanted_lines, "h1 long, h2 long, sides int, doc_id long, line_no int, words string")
    near = scratch.keep(near.dropDuplicates(["h1", "h2"]))

    keyed = scratch.keep(arrow_map(near, _variant_rows, "h1 long, h2 long, doc_id long, line_no int, key long, kind int"))
    line = F.struct("doc_id", "line_no", "h1", "h2")
    whole = F.col("kind") == 2
    buckets = keyed.groupBy("key").agg(
        F.min(F.when(F.col("kind") != 1, line)).alias("same_place"),
        F.min(F.when(whole, line)).alias("whole"),
        F.min(F.when(F.col("kind") == 1, line)).alias("longer"),
        F.count("*").alias("rows"),
    ).filter("rows > 1").drop("rows")
    partner = F.when(F.col("kind") == 0, F.col("same_place")).when(F.col("kind") == 1, F.col("whole")).otherwise(F.col("longer"))
    found = (
        keyed.join(buckets, "key").withColumn("partner", partner)
        .filter(F.col("partner").isNotNull() & (F.struct("partner.doc_id", "partner.line_no") < _order()))
        .groupBy("h1", "h2").agg(F.min("partner").alias("partner"))
    )
    text_of = near.select("h1", "h2", "words")
    partner_text = text_of.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("words").alias("other"))
    verified = (
        found.select("h1", "h2", F.col("partner.h1").alias("p1"), F.col("partner.h2").alias("p2"))
        .join(text_of, ["h1", "h2"]).join(partner_text, ["p1", "p2"])
        .filter(_verified("words", "other")).select("h1", "h2", F.lit(True).alias("near"))
    )
    verified = scratch.keep(verified)
    scratch.drop(keyed)
    scratch.drop(near)
    judged = distinct.select("h1", "h2", "first", "copies").join(verified, ["h1", "h2"], "left")
    judged = scratch.keep(judged.filter("near or copies > 1").select("h1", "h2", "first.doc_id", "first.line_no", "near").withColumnsRenamed({"doc_id": "first_doc", "line_no": "first_line"}))
    scratch.drop(distinct)
    later = (F.col("doc_id") > F.col("first_doc")) | (F.col("line_no") > F.col("first_line"))
    gone = lines.select("doc_id", "row", "line_no", "h1", "h2").join(judged, ["h1", "h2"]).filter(later | F.col("near"))
    removed = scratch.keep(gone.groupBy("doc_id", "row").agg(F.collect_set("line_no").alias("lines")))
    for used in (lines, judged, verified):
        scratch.drop(used)
    return removed


def _cut_rows(docs: DataFrame, min_words: int) -> DataFrame:
    """whole (the row as a struct), n_lines, n_removed, kept; the texts stay in the JVM, and only those that lose lines are taken apart."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), "doc_id", F.xxhash64("text").alias("row"), F.col("text").alias("text"))
    rows = rows.join(removed_lines(docs, min_words), ["doc_id", "row"], "left")
    parts = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("lines"))
    kept = F.when(F.col("lines").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return rows.select("whole", F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of docs with n_lines, n_removed and kept, the text without the removed lines."""
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed", "kept")]
    return _cut_rows(docs, min_words).select(*[F.col(f"whole.`{c}`") for c in own], "n_lines", "n_removed", "kept")


def line_digest(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document row: doc_id, n_lines, n_removed and the SHA-256 of the kept text (null text: of nothing)."""
    kept = dedup_lines(docs.select("doc_id", "text"), min_words)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def without_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The document rows with their texts cut; documents that lose every line leave, n_chars follows the text."""
    kept = _cut_rows(docs, min_words).filter((F.col("n_removed") == 0) | (F.length(F.regexp_replace("kept", r"[\x20\x09-\x0D]+", "")) > 0))
    new = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("whole.n_chars")) if "n_chars" in docs.columns else None}
    return kept.select(*[new.get(c, F.col(f"whole.`{c}`")).alias(c) for c in docs.columns])
