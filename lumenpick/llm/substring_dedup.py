"""Removal of long repeated passages with suffix automata over shards of the corpus.

A window is WINDOW consecutive words of one document.  Words covered by a
window whose words also start in a document with a smaller doc_id go.

Broadcasting automata of the whole corpus to every document would grow with the
square of the corpus, so documents are routed instead: only texts that can share a
window meet in one shard.

1. Every window has an anchor, the least hash among its short word runs.  Equal
   windows have equal anchors, and neighbouring windows mostly share theirs, so a
   document becomes a few segments: runs of windows with one anchor.
2. Anchors that occur in one document only leave.  Equal segments collapse to their
   smallest doc_id; all other copies are covered whole.
3. The distinct segments of an anchor form its reference shard.  Shards are
   streamed in order of doc_id: each segment first runs through the suffix automaton
   of the segments of smaller documents, which yields its matching statistics
   (the longest match that ends at each word), and is then added to it.  Places
   where the statistic reaches the window length give the maximal spans to remove.
4. A shard of more than SHARD_SEGMENTS distinct segments (a passage in countless
   surroundings) is too long for one task, so its segments are dealt anew by anchors of longer
   runs, as if they were documents.  The longest anchor is the window itself, whose shards
   hold a few lengths of one repeated window at most, so every shard ends up in automata that fit.

Defined results: null texts have no words; texts shorter than a window lose
nothing.  Rows that repeat a doc_id are judged by their own texts and don't remove
words from each other.  Rows without a doc_id have no place in the order: they lose nothing and remove
nothing.  Extra columns are ignored.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, words_of
from .wordhash import column_words, mix, prefix_sums, ranges, run_hashes, window_hashes

WINDOW = 50
#: Words of the runs among which a window finds its anchor, and of those that split too long a shard; at last the window itself.
ANCHOR_WORDS = (8, 16, 32)
#: Longest segment, in windows.
SEGMENT_WINDOWS = 64
#: Distinct segments that one automaton takes: at most 350,000 words, some 150 MB of states.
SHARD_SEGMENTS = 3072


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each `width` neighbours, by doubling."""
    done = 1
    out = x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


_SEGMENT = {"doc_id": pa.int64(), "row": pa.int64(), "at": pa.int32(), "windows": pa.int32(), "anchor": pa.int64(), "segment": pa.int64()}


def _segment_rows(window: int, anchor_words: int):
    """First window, number of windows, anchor and hash of the segments of all texts."""

    def run(batch: pa.RecordBatch) -> dict:
        ids, own = (_column(batch, c).to_numpy(zero_copy_only=False) for c in ("doc_id", "row"))
        parts = []
        for words in column_words(_column(batch, "text")):
            windows = np.maximum(0, np.diff(words.bounds) - window + 1)
            if not windows.any():
                continue
            sums = prefix_sums(words.hashes)
            anchors = sliding_min(mix(window_hashes(sums, anchor_words)), window - anchor_words + 1)
            at, row = ranges(words.bounds[:-1], windows), np.repeat(np.arange(len(windows)), windows)
            anchors = anchors[at]
            starts = np.flatnonzero(np.r_[True, (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])])
            lengths = np.diff(np.append(starts, len(at)))
            pieces = -(-lengths // SEGMENT_WINDOWS)
            rank = ranges(np.zeros_like(pieces), pieces)
            starts = np.repeat(starts, pieces) + rank * SEGMENT_WINDOWS
            lengths = np.minimum(SEGMENT_WINDOWS, np.repeat(lengths, pieces) - rank * SEGMENT_WINDOWS)
            first, row = at[starts], row[starts]
            hashes = mix(run_hashes(sums, first, first + lengths + window - 1) + lengths.astype(np.uint64))
            parts.append({
                "doc_id": ids[words.first_row + row], "row": own[words.first_row + row], "at": (first - words.bounds[row]).astype(np.int32), "windows": lengths.astype(np.int32),
                "anchor": anchors[starts].view(np.int64), "segment": hashes.view(np.int64),
            })
        return {k: pa.concat_arrays([pa.array(p[k], t) for p in parts]) if parts else pa.array([], t) for k, t in _SEGMENT.items()}

    return run


class SuffixAutomaton:
    """Suffix automaton over word sequences; `add` starts a new sequence, `matches` gives matching statistics."""

    def __init__(self) -> None:
        self.length, self.link, self.next = [0], [-1], [{}]

    def add(self, words: list) -> None:
        length, link, nexts = self.length, self.link, self.next
        last = 0
        for w in words:
            step = nexts[last].get(w)
            if step is not None and length[step] == length[last] + 1:
                last = step
                continue
            if step is not None:  # the run is known, but only inside longer ones
                last = self._clone(last, w, step)
                continue
            state = len(length)
            length.append(length[last] + 1)
            link.append(0)
            nexts.append({})
            p = last
            while p >= 0 and w not in nexts[p]:
                nexts[p][w] = state
                p = link[p]
            if p >= 0:
                q = nexts[p][w]
                link[state] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
            last = state

    def _clone(self, p: int, w, q: int) -> int:
        length, link, nexts = self.length, self.link, self.next
        copy = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        nexts.append(dict(nexts[q]))
        link[q] = copy
        while p >= 0 and nexts[p].get(w) == q:
            nexts[p][w] = copy
            p = link[p]
        return copy

    def matches(self, words: list) -> list[int]:
        """Per word the length of the longest match that ends there."""
        length, link, nexts = self.length, self.link, self.next
        state, size, out = 0, 0, []
        for w in words:
            while state and w not in nexts[state]:
                state = link[state]
                size = length[state]
            if w in nexts[state]:
                state = nexts[state][w]
                size += 1
            out.append(size)
        return out


def _runs(marks: list[bool]) -> list[dict]:
    """Maximal runs of true marks as half-open ranges."""
    out, start = [], None
    for i, m in enumerate([*marks, False]):
        if m and start is None:
            start = i
        elif not m and start is not None:
            out.append({"start": start, "end": i})
            start = None
    return out


def match_shard(shard: list[tuple[int, object, list]], window: int) -> list[tuple[object, list[dict]]]:
    """shard: (doc_id, key, words) by doc_id; per key with matches the ranges of matched windows."""
    automaton, out = SuffixAutomaton(), []
    by_doc = [list(rows) for _, rows in groupby(shard, key=lambda r: r[0])]
    for k, rows in enumerate(by_doc):
        for _, key, words in rows if k else ():
            ranges = _runs([m >= window for m in automaton.matches(words)[window - 1 :]])
            if ranges:
                out.append((key, ranges))
        if k + 1 < len(by_doc):
            for _, _, words in rows:
                automaton.add(words)
    return out


def _matched_segments(routed: DataFrame, window: int) -> DataFrame:
    """Stream the shards of a partition: routed has anchor, segment, doc_id, words."""

    def run(batches):
        def flush(anchor, shard):
            found = match_shard(shard, window) if len(shard) > 1 else []
            return [(anchor, key, ranges) for key, ranges in found]

        anchor, shard, done = None, [], []
        for batch in batches:
            columns = (_column(batch, c).to_pylist() for c in ("anchor", "segment", "doc_id", "words"))
            for a, segment, doc_id, words in zip(*columns, strict=True):
                if a != anchor:
                    done += flush(anchor, shard)
                    anchor, shard = a, []
                shard.append((doc_id, segment, words.split(" ")))
            if len(done) > 1000:
                yield _ranges_batch(done)
                done = []
        yield _ranges_batch(done + flush(anchor, shard))

    ordered = routed.select("anchor", "segment", "doc_id", "words").repartition("anchor").sortWithinPartitions("anchor", "doc_id")
    return ordered.mapInArrow(run, "anchor long, segment long, ranges array<struct<start:int, end:int>>")


_RANGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _ranges_batch(rows: list[tuple]) -> pa.RecordBatch:
    anchor, segment, ranges = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(segment, pa.int64()), pa.array(ranges, _RANGES)], ["anchor", "segment", "ranges"])


def _segment_words(window: int):
    """The words of the wanted segments of a document."""

    def run(batch: pa.RecordBatch) -> dict:
        out = {k: [] for k in ("anchor", "segment", "doc_id", "split", "words")}
        columns = (_column(batch, c).to_pylist() for c in ("doc_id", "text", "wanted"))
        for doc_id, text, wanted in zip(*columns, strict=True):
            words = words_of(text)
            for w in wanted:
                out["anchor"].append(w["anchor"])
                out["segment"].append(w["segment"])
                out["doc_id"].append(doc_id)
                out["split"].append(w["split"])
                out["words"].append(b" ".join(words[w["at"] : w["at"] + w["windows"] + window - 1]).decode("utf-8", "surrogatepass"))
        return out

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """doc_id, row (hash of the text), ranges: the windows that start in a smaller document too, as half-open ranges of first words."""
    texts = docs.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("row"), "text")
    widths = [*[w for w in ANCHOR_WORDS if w < window], window]
    return _repeated(texts, window, shard_segments, widths, Scratch(docs.sparkSession))


def _repeated(texts: DataFrame, window: int, shard_segments: int, widths: list[int], scratch: Scratch) -> DataFrame:
    """doc_id, row, ranges for texts (doc_id, row, text): by anchors of the first width, too long shards by the others."""
    schema = "doc_id long, row long, at int, windows int, anchor long, segment long"
    all_segments = scratch.keep(arrow_map(texts, _segment_rows(window, widths[0]), schema))
    shared = all_segments.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("anchor")
    # small sides are written before they are joined, so that a hot anchor's rows can be split over tasks
    own = scratch.keep(all_segments.join(scratch.keep(shared), "anchor"))
    scratch.drop(all_segments)

    distinct = scratch.keep(own.groupBy("anchor", "segment").agg(F.min("doc_id").alias("first")))
    shards = distinct.groupBy("anchor").agg(F.count("*").alias("segments")).filter("segments > 1")
    too_long = (F.col("segments") > shard_segments) if len(widths) > 1 else F.lit(False)
    shards = scratch.keep(shards.select("anchor", too_long.alias("split")))
    to_match = scratch.keep(distinct.join(shards, "anchor"))

    key = ["anchor", "segment"]
    wanted = own.join(to_match, key).filter("doc_id = first").groupBy(*key).agg(
        F.min(F.struct("doc_id", "row", "at", "windows", "split")).alias("w")
    )
    wanted = wanted.select("w.*", *key).groupBy("doc_id", "row").agg(F.collect_list(F.struct("at", "windows", "anchor", "segment", "split")).alias("wanted"))
    routed = arrow_map(texts.join(wanted, ["doc_id", "row"]), _segment_words(window), "anchor long, segment long, doc_id long, split boolean, words string")
    routed = scratch.keep(routed)

    ranges_ = scratch.keep(_matched_segments(routed.filter("not split"), window))
    parts = routed.filter("split").select("anchor", "segment", "doc_id", F.xxhash64(*key).alias("row"), F.col("words").alias("text"))
    if len(widths) > 1 and not parts.isEmpty():
        parts = scratch.keep(parts)
        again = _repeated(parts.select("doc_id", "row", "text"), window, shard_segments, widths[1:], scratch)
        again = again.join(parts.select("doc_id", "row", *key), ["doc_id", "row"]).select(*key, "ranges")
        ranges_ = scratch.keep(ranges_.unionByName(again))
    scratch.drop(routed)

    judged = own.join(scratch.keep(distinct.join(ranges_, key, "left")), key)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("windows").alias("end")))
    judged = judged.withColumn("ranges", F.when(F.col("first") < F.col("doc_id"), whole).otherwise(F.col("ranges"))).filter("ranges is not null")
    moved = F.transform("ranges", lambda r: F.struct((r["start"] + F.col("at")).alias("start"), (r["end"] + F.col("at")).alias("end")))
    return judged.select("doc_id", "row", F.explode(moved).alias("range")).groupBy("doc_id", "row").agg(F.collect_list("range").alias("ranges"))


def kept_words(words: list, ranges: list[dict], window: int) -> list:
    """The words that no window of the ranges covers."""
    if not ranges:
        return words
    edge = np.zeros(len(words) + 1, np.int32)
    for r in ranges:
        edge[r["start"]] += 1
        edge[min(len(words), r["end"] - 1 + window)] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def without_repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept, the kept words joined by single spaces; one row per document row."""
    ranges_ = repeated_windows(docs, window)
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), "text").join(ranges_, ["doc_id", "row"], "left")

    def run(batch: pa.RecordBatch) -> dict:
        out = {"doc_id": _column(batch, "doc_id"), "n_words": [], "n_removed": [], "kept": []}
        for text, r in zip(_column(batch, "text").to_pylist(), _column(batch, "ranges").to_pylist(), strict=True):
            words = words_of(text)
            kept = kept_words(words, r or [], window)
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(kept))
            out["kept"].append(b" ".join(kept).decode("utf-8", "surrogatepass"))
        return out

    return arrow_map(rows, run, "doc_id long, n_words long, n_removed long, kept string")


def passage_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document row: doc_id, n_words, n_removed, kept_sha256."""
    kept = without_repeated_passages(docs, window)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
