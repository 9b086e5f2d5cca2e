"""Media columns: chroma fingerprints of recordings and their alignment.

A recording is a column of 8-bit samples.  Overlapping frames are transformed,
and the power of their bins is folded into twelve pitch classes.  Filters over
the frame-by-class image, sums of rectangles from an integral image, compare
neighbouring areas; each response becomes two bits (Gray code), and sixteen
filters make one packed 32-bit integer per frame.

Frames for alignment begin anew at every anchor, a place where the smoothed signal
peaks, so a copy has the same ones wherever it starts.  Landmarks are hashes of two of these
integers, at each anchor and at every eighth frame after it.

Two recordings are linked if at one offset at least MIN_SHARE of the different landmarks of the
one that has fewer agree (the offset histogram, in which a repeated landmark votes with all its places) and if at most MAX_BIT_ERROR of the bits
differ over the whole overlap of their plain fingerprints.

1. Equal fingerprints collapse to classes, so copies are never paired.
2. Candidates come from an exact prefix join: in order of rising frequency a recording
   has a shared landmark among its first ones, all but the share that it may miss.
   So a passage that countless recordings hold makes candidates only of
   those that it fills to that share.
3. Per landmark the least class is compared with those that ask for it, and components
   are formed; so for the least of those left, in rounds for as long as many are left.  What
   then remains, candidates of different components, is listed and compared in full.

Alignment finds near-duplicates: each recording gets its component.  alignment_links
lists the links themselves, all pairs of alike classes, for small tables.

Defined results: null samples and recordings too short for a fingerprint have no
frames and link with nothing; recordings without landmarks link with equal ones only.
Rows that repeat a doc_id are one recording whose rows link as any of them does; rows
without a doc_id are returned and link with nothing.  aligned_to is an earlier recording, the
closest of those compared.  Classes are told apart by 64-bit hashes.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import Scratch, arrow_map
from .wordhash import mix, offsets_array, ranges, row_pieces, text_bytes

SAMPLE_RATE = 8000
FRAME = 128
HOP = 32
FILTERS = 16
#: Frames that the widest filter spans.
SPAN = 16
#: Responses beyond this on either side take the outer two of four levels.
LEVEL = 0.12
#: The frames whose integers make a landmark: 64 bits, so that unrelated recordings hardly ever share one.
LAGS = (0, 10)
#: An anchor is the greatest value of so many samples on either side.
ANCHOR_REACH = 96
#: Frames from one landmark to the next where no anchor comes.
STRIDE = 8
MIN_SHARE = 0.2
MIN_OVERLAP = 16
MAX_BIT_ERROR = 0.25

#: The rest is listed once it is at most so many candidates per open landmark of a class, or after so many rounds of leaders.
LISTED = 16
LEADER_ROUNDS = 4

_CHUNK_FRAMES = 4096
#: The peak shape that smooths the signal.
_SMOOTH = np.rint(1000 * np.hanning(41)[1:-1]).astype(np.int64)
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def _fold() -> np.ndarray:
    """Bins to pitch classes; bins below 100 Hz are left out."""
    hertz = np.fft.rfftfreq(FRAME, 1 / SAMPLE_RATE)
    out = np.zeros((len(hertz), 12), np.float32)
    for b, f in enumerate(hertz):
        if f >= 100:
            out[b, int(round(12 * np.log2(f / 440.0))) % 12] = 1
    return out


_FOLD = _fold().astype(np.float64)
#: Chroma in fixed point, so that sums do not depend on what was summed before.
_UNIT = 1 << 24
_HANN = np.hanning(FRAME).astype(np.float32)


def _chroma(frames: np.ndarray) -> np.ndarray:
    frames = frames.astype(np.float32) - 128
    spectrum = np.fft.rfft((frames - frames.mean(axis=1, keepdims=True)) * _HANN, axis=1)
    out = (spectrum.real**2 + spectrum.imag**2).astype(np.float64) @ _FOLD
    total = out.sum(axis=1, keepdims=True)
    return np.where(total > 1e-6, out / np.maximum(total, 1e-6), 1 / 12)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames by twelve classes, each frame scaled to sum one (silence: even)."""
    return _chroma_at(samples, np.arange(0, len(samples) - FRAME + 1, HOP))


def _chroma_at(samples: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(starts), 12))
    if len(starts):
        frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)
        for i in range(0, len(starts), _CHUNK_FRAMES):
            out[i : i + _CHUNK_FRAMES] = _chroma(frames[starts[i : i + _CHUNK_FRAMES]])
    return out


def filter_shapes() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames): four kinds in four widths, classes dealt round the octave."""
    return [(i % 4, (3 * i) % 7, 6, SPAN // 4 * (i // 4 + 1)) for i in range(FILTERS)]


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """One packed integer per frame that has SPAN - 1 frames after it."""
    return fingerprints([samples])[0]


def fingerprints(recordings: list[np.ndarray]) -> list[np.ndarray]:
    """The fingerprints of all recordings, computed as one image."""
    edges = np.cumsum([0] + [len(r) for r in recordings])
    packed, counts = _plain(np.concatenate([*recordings, np.zeros(0, np.uint8)]), edges)
    return np.split(packed, np.cumsum(counts)[:-1])


def _plain(samples: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the recordings between the edges, one after the other, and their lengths."""
    frames = np.maximum(0, (np.diff(edges) - FRAME) // HOP + 1)
    return _fingerprints_at(samples, np.repeat(edges[:-1], frames) + HOP * ranges(np.zeros_like(frames), frames), frames)


def _fingerprints_at(samples: np.ndarray, starts: np.ndarray, frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed integers of recordings with the given numbers of frames that begin at the given starts."""
    counts = np.maximum(0, frames - SPAN + 1)
    if len(starts) < SPAN:
        return np.zeros(0, np.uint32), counts
    return _packed(_chroma_at(samples, starts))[ranges(np.cumsum(frames) - frames, counts)], counts


def _packed(image: np.ndarray) -> np.ndarray:
    n = len(image) - SPAN + 1
    integral = np.zeros((13, len(image) + 1), np.int64)
    integral[1:, 1:] = np.rint(image.T * _UNIT).cumsum(axis=1).cumsum(axis=0)
    wide = {}

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        key = (t0, t1, c0, c1)
        if key not in wide:
            a, b = slice(t0, t0 + n), slice(t1, t1 + n)
            wide[key] = integral[c1, b] - integral[c0, b] - integral[c1, a] + integral[c0, a]
        return wide[key]

    packed, more = np.zeros(n, np.uint32), 0.01 * _UNIT
    for kind, low, height, width in filter_shapes():
        high, middle, half = low + height, low + height // 2, width // 2
        whole = area(0, width, low, high)
        if kind == 0:  # lower against upper classes
            part = area(0, width, low, middle)
        elif kind == 1:  # earlier against later frames
            part = area(0, half, low, high)
        elif kind == 2:  # inner against outer classes
            part = area(0, width, low + height // 4, high - height // 4)
        else:  # one diagonal against the other
            part = area(0, half, low, middle) + area(half, width, middle, high)
        part, rest = part + more, whole - part + more
        level = (part > rest * np.exp(-LEVEL)).astype(np.uint8) + (part > rest) + (part > rest * np.exp(LEVEL))
        packed = packed << np.uint32(2) | _GRAY[level]
    return packed


def _sliding_max(x: np.ndarray, width: int) -> np.ndarray:
    """Greatest value of each `width` neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.maximum(x[: len(x) - step], x[step:])
        done += step
    return x


def anchors(samples: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Places where the smoothed change of the signal is greatest of its surroundings (the first of equal ones)."""
    sizes, half = np.diff(edges), len(_SMOOTH) // 2
    # silence between the recordings, so that none is judged by its neighbours
    gap = ANCHOR_REACH + half
    shifted = edges[:-1] + gap * np.arange(len(sizes))
    change = np.zeros(len(samples) + gap * len(sizes), np.int64)
    inner = np.abs(np.diff(samples.astype(np.int64), append=samples[-1:]))
    inner[edges[1:][sizes > 0] - 1] = 0
    change[ranges(shifted, sizes)] = inner
    smooth = np.convolve(np.pad(change, half), _SMOOTH, "valid")
    padded = np.pad(smooth, ANCHOR_REACH, constant_values=-1)
    before, after = _sliding_max(padded[:-1], ANCHOR_REACH)[: len(smooth)], _sliding_max(padded[1:], ANCHOR_REACH)[ANCHOR_REACH:]
    at = np.flatnonzero((smooth > before) & (smooth >= after[: len(smooth)]))
    own = np.searchsorted(shifted, at, "right") - 1
    place = at - shifted[own]
    return (place + edges[own])[place < sizes[own]]


def landmarks(samples: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Recording, place (a sample of it) and hash of the landmarks of the recordings between the edges."""
    at = anchors(samples, edges)
    own = np.searchsorted(edges, at, "right") - 1
    # a segment goes from its anchor to the next one, the last of a recording to its end
    until = np.minimum(np.append(at[1:], len(samples)), np.where(np.append(own[1:], -1) == own, len(samples), edges[own + 1] - FRAME + 1))
    frames = np.maximum(0, -(-(until - at) // HOP))
    starts, place = np.repeat(at, frames) + HOP * ranges(np.zeros_like(frames), frames), ranges(np.zeros_like(frames), frames)
    fits = starts + FRAME <= edges[np.repeat(own, frames) + 1]
    starts, place, of = starts[fits], place[fits], np.repeat(own, frames)[fits]
    frames = np.bincount(of, minlength=len(edges) - 1)
    packed, counts = _fingerprints_at(samples, starts, frames)
    used = ranges(np.cumsum(frames) - frames, np.maximum(0, counts - max(LAGS)))
    used = used[place[used] % STRIDE == 0]
    # integers are fewer than frames
    inside = used - (np.cumsum(frames) - frames)[of[used]] + (np.cumsum(counts) - counts)[of[used]]
    hashes = np.zeros(len(used), np.uint64)
    for k in LAGS:
        hashes = mix(hashes * np.uint64(3) + packed[inside + k])
    return of[used], starts[used] - edges[of[used]], hashes


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, float]:
    """Overlap when b starts `offset` frames after the start of a, and the share of differing bits in it."""
    start, end = max(0, offset), min(len(a), offset + len(b))
    if end <= start:
        return 0, 1.0
    differ = np.bitwise_count(a[start:end] ^ b[start - offset : end - offset]).sum()
    return end - start, float(differ) / (32 * (end - start))


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _class_of(packed: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(packed.tobytes(), digest_size=8).digest(), "little", signed=True)


def _fingerprint_rows(batch: pa.RecordBatch) -> dict:
    """doc_id, n_frames, class, packed, and the landmarks with their places, repeated ones with each."""
    data, offsets = text_bytes(_column(batch, "samples"))
    out = {k: [] for k in ("n_frames", "class", "packed")}
    marks, places, sizes = [], [], []
    for first, last in row_pieces(offsets):
        samples, edges = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        packed, counts = _plain(samples, edges)
        split = np.split(packed, np.cumsum(counts)[:-1])
        out["n_frames"] += counts.tolist()
        out["class"] += [_class_of(x) if len(x) else None for x in split]
        out["packed"] += [x.tobytes() for x in split]
        own, place, mark = landmarks(samples, edges) if len(samples) else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((place, mark, own))
        marks.append(mark[order].view(np.int64))
        places.append(place[order].astype(np.int32))  # a text has fewer than 2^31 bytes
        sizes.append(np.bincount(own.astype(np.int64), minlength=last - first))
    join = lambda x, kind=np.int64: np.concatenate(x) if x else np.zeros(0, kind)
    return out | {"doc_id": _column(batch, "doc_id"), "marks": offsets_array(join(marks), join(sizes)), "places": offsets_array(join(places, np.int32), join(sizes))}


def stored(packed: np.ndarray) -> bytes:
    """A fingerprint as tables hold it: neighbouring integers share most of their bits, so each is stored as what changed, compressed."""
    return zlib.compress(np.concatenate([packed[:1], packed[1:] ^ packed[:-1]]).tobytes(), 1)


def restored(data: bytes) -> np.ndarray:
    """The fingerprint that was stored."""
    return np.bitwise_xor.accumulate(np.frombuffer(zlib.decompress(data), np.uint32))


def _print_rows(batch: pa.RecordBatch) -> dict:
    out = _fingerprint_rows(batch)
    return out | {"packed": [stored(np.frombuffer(x, np.uint32)) for x in out["packed"]]}


#: Votes of two recordings that are counted at a time.
_VOTES = 1 << 20


def _offset_votes(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Offsets in frames and how many different landmarks agree at each, of two recordings given as (packed, marks, places).

    A landmark that repeats votes with all its places, once per offset.
    """
    a, b = ((x[0], x[1], x[2].astype(np.int64)) for x in (a, b))
    marks, rows_a = np.unique(a[1], return_inverse=True)
    at = np.minimum(np.searchsorted(marks, b[1]), max(0, len(marks) - 1))
    here = marks[at] == b[1] if len(marks) else np.zeros(0, bool)
    places_b, rows_b = b[2][here], at[here]
    order_a, order_b = np.lexsort((a[2], rows_a)), np.lexsort((places_b, rows_b))
    starts_a, starts_b = (np.searchsorted(r, np.arange(len(marks) + 1)) for r in (rows_a[order_a], rows_b[order_b]))
    sorted_a, sorted_b = a[2][order_a], places_b[order_b]
    offsets, votes = np.zeros(0, np.int64), np.zeros(0, np.int64)
    n_a, n_b = np.diff(starts_a), np.diff(starts_b)

    def add(some: np.ndarray) -> None:
        nonlocal offsets, votes
        offsets, place = np.unique(np.concatenate([offsets, some]), return_inverse=True)
        votes = np.bincount(place, np.concatenate([votes, np.ones(len(some), np.int64)])).astype(np.int64)

    single = np.flatnonzero((n_a == 1) & (n_b == 1))
    add(np.rint((sorted_a[starts_a[single]] - sorted_b[starts_b[single]]) / HOP).astype(np.int64))
    for m in np.flatnonzero((n_a * n_b > 1)):
        mine, others = sorted_a[starts_a[m] : starts_a[m + 1]], sorted_b[starts_b[m] : starts_b[m + 1]]
        step, own = max(1, _VOTES // len(others)), np.zeros(0, np.int64)
        for i in range(0, len(mine), step):
            own = np.union1d(own, np.rint((mine[i : i + step, None] - others) / HOP).astype(np.int64))
        add(own)
    return offsets, votes


def align(a: tuple, b: tuple) -> tuple[int, int, float, bool]:
    """Offset in frames, overlap, bit error and whether they are linked, of two recordings given as (packed, marks, places).

    Every offset at which enough landmarks agree is looked at; there are at most some 3 / MIN_SHARE where landmarks do not repeat.
    """
    offsets, votes = _offset_votes(a, b)
    # a start within a hop may belong to either neighbour
    votes = votes + sum(np.where(np.isin(offsets + k, offsets), votes[np.searchsorted(offsets, offsets + k) % max(1, len(offsets))], 0) for k in (-1, 1))
    needed = max(1, int(np.ceil(MIN_SHARE * min(len(np.unique(a[1])), len(np.unique(b[1]))))))
    best = (0, 0, 1.0)
    for offset in np.unique((offsets[votes >= needed][:, None] + np.array([-1, 0, 1])).ravel()).tolist():
        overlap, error = bit_error(a[0], b[0], offset)
        if overlap >= MIN_OVERLAP and (error, abs(offset), -offset) < (best[2], abs(best[0]), -best[0]):
            best = (offset, overlap, error)
    return best[0], best[1], round(best[2], 6), best[2] <= MAX_BIT_ERROR


def _alignment_rows(batch: pa.RecordBatch) -> dict:
    out = {"a": _column(batch, "a"), "b": _column(batch, "b"), "frame_offset": [], "overlap": [], "bit_error": [], "linked": []}
    columns = {c: _column(batch, c) for c in ("a_packed", "a_marks", "a_places", "b_packed", "b_marks", "b_places")}
    for i in range(batch.num_rows):
        a, b = ((restored(columns[f"{s}_packed"][i].as_py()), columns[f"{s}_marks"][i].values.to_numpy(), columns[f"{s}_places"][i].values.to_numpy()) for s in "ab")
        for name, value in zip(("frame_offset", "overlap", "bit_error", "linked"), align(a, b), strict=True):
            out[name].append(value)
    return out


def _compared(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b, frame_offset, overlap, bit_error, linked of pairs (a, b) of classes."""
    # merge joins at every size: the sides grow with the input, and equal plans make figures comparable
    left, right = (classes.select(F.col("class").alias(c), *[F.col(n).alias(f"{c}_{n}") for n in ("packed", "marks", "places")]).hint("merge") for c in ("a", "b"))
    return arrow_map(pairs.select("a", "b").join(left, "a").join(right, "b"), _alignment_rows, "a long, b long, frame_offset int, overlap int, bit_error double, linked boolean")


def _pairs(left: str, right: str) -> list:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def _askers(slim: DataFrame, scratch: Scratch) -> DataFrame:
    """mark, class, asks of the landmarks that several classes have; slim: class, marks, some rows maybe repeated.

    Of its n landmarks in order of rising frequency a class must share one among the first
    n - needed + 1 with whatever it links to as the one with fewer landmarks.
    """
    own = F.array_distinct("marks")
    marks = scratch.keep(slim.select("class", F.size(own).alias("n"), F.explode(own).alias("mark")))
    shared = scratch.keep(marks.groupBy("mark").agg(F.count("*").alias("holders")).filter("holders > 1"))
    # repeated rows of a leader are one
    held = scratch.keep(marks.join(shared, "mark").distinct())
    scratch.drop(marks)
    needed = F.greatest(F.lit(1), F.ceil(F.col("n") * MIN_SHARE))
    ordered = held.groupBy("class", "n").agg(F.array_sort(F.collect_list(F.struct("holders", "mark"))).alias("m"))
    # landmarks of its own come first, and need no look
    front = F.size("m") - needed + 1
    ordered = ordered.select("class", F.posexplode("m").alias("place", "x"), front.alias("front"))
    members = scratch.keep(ordered.select("class", "x.mark", (F.col("place") < F.col("front")).alias("asks")))
    scratch.drop(shared)
    scratch.drop(held)
    return members


def candidates(slim: DataFrame, scratch: Scratch) -> DataFrame:
    """All pairs (a, b) of classes that could be linked: grows with the square of a group of alike classes."""
    members = _askers(slim, scratch)
    one, two = members.filter("asks").select("mark", F.col("class").alias("one")), members.select("mark", F.col("class").alias("two"))
    return one.join(two, "mark").filter("one <> two").select(*_pairs("one", "two")).distinct()


def _connected(prints: DataFrame, leaders_of: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Compared pairs that are linked, and node, component of all classes with a link; prints goes, since no later step needs it."""
    members = _askers(_led(prints.select("doc_id", "class", "marks"), leaders_of), scratch)
    # only classes that share a landmark are fetched whole
    classes = _whole(prints, leaders_of, members.select("class").distinct(), scratch)
    scratch.drop(prints)
    leaders = scratch.keep(members.groupBy("mark").agg(F.min("class").alias("leader"), F.count("*").alias("n"), F.bool_or("asks").alias("asked")).filter("n > 1 and asked").select("mark", "leader"))
    pairs = members.join(leaders, "mark").filter("class <> leader and asks").select(*_pairs("leader", "class")).distinct()
    known = scratch.keep(_compared(pairs, classes))
    led = leaders
    for turn in range(1, LEADER_ROUNDS + 1):
        linked = known.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
        labels = scratch.keep(components(linked, scratch))
        own = labels.withColumnRenamed("node", "class")
        marked = scratch.keep(members.select("mark", "class", "asks").join(own, "class", "left").withColumn("component", F.coalesce("component", "class")))
        open_marks = marked.groupBy("mark").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count_if("asks").alias("asked"), F.count("*").alias("n")).filter("low < high and asked > 0")
        open_marks = scratch.keep(open_marks.select("mark", "asked", "n"))
        rest = open_marks.agg(F.sum("n").alias("n"), F.sum(F.col("asked") * F.col("n")).alias("pairs")).first()
        if rest["n"] is None:
            return known.filter("linked").drop("linked"), labels
        members = scratch.keep(marked.join(open_marks.select("mark"), "mark"))
        if rest["pairs"] <= LISTED * rest["n"] or turn == LEADER_ROUNDS:
            one, two = members.filter("asks").select("mark", F.col("class").alias("one"), F.col("component").alias("c1")), members.select("mark", F.col("class").alias("two"), F.col("component").alias("c2"))
            pairs = one.join(two, "mark").filter("c1 <> c2").select(*_pairs("one", "two")).distinct()
        else:
            # per landmark the least class outside the components of its leaders so far
            places = led.join(own.withColumnRenamed("class", "leader"), "leader", "left").select("mark", F.coalesce("component", "leader").alias("component")).distinct()
            leaders = scratch.keep(members.join(places, ["mark", "component"], "left_anti").groupBy("mark").agg(F.min(F.struct("class", "component")).alias("l")).select("mark", F.col("l.class").alias("leader"), F.col("l.component").alias("of_leader")))
            led = scratch.keep(led.unionByName(leaders.select("mark", "leader")))
            pairs = members.join(leaders, "mark").filter("asks and component <> of_leader").select(*_pairs("leader", "class")).distinct()
        fresh = scratch.keep(_compared(pairs.join(known.select("a", "b"), ["a", "b"], "left_anti"), classes))
        known = scratch.keep(known.unionByName(fresh))
        if rest["pairs"] <= LISTED * rest["n"]:
            break
    linked = known.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return known.filter("linked").drop("linked"), scratch.keep(components(linked, scratch))


def _prints(media: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Numbered fingerprints of all rows, and class, leader (its smallest doc_id), row (of the leader; one, if it has several), frames of all classes."""
    schema = "doc_id long, n_frames long, class long, packed binary, marks array<long>, places array<int>"
    prints = scratch.keep(arrow_map(media.select("doc_id", "samples"), _print_rows, schema).withColumn("row", F.monotonically_increasing_id()))
    leaders = prints.filter("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("leader"), F.min_by("row", "doc_id").alias("row"), F.max("n_frames").alias("frames"))
    return prints, scratch.keep(leaders)


def _led(prints: DataFrame, leaders_of: DataFrame) -> DataFrame:
    """The rows of the leaders of classes; a leader whose row is repeated has several."""
    return prints.join(leaders_of.select(F.col("leader").alias("doc_id"), "class"), ["doc_id", "class"])


def _whole(prints: DataFrame, leaders_of: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """class, packed, marks, places of the wanted classes: a row each by its number, so whole rows are dealt once."""
    return scratch.keep(prints.select("row", "class", "packed", "marks", "places").join(leaders_of.join(wanted, "class").select("row"), "row").drop("row"))


def alignment_links(media: DataFrame) -> DataFrame:
    """All links between recordings of different fingerprints: a, b (the smallest doc_id of either class), frame_offset, overlap, bit_error.

    Lists every pair of alike classes, so it is meant for tables without large groups of them.
    """
    scratch = Scratch(media.sparkSession)
    prints, of = _prints(media, scratch)
    classes = _whole(prints, of, of.select("class"), scratch)
    found = _compared(candidates(classes, scratch), classes).filter("linked").drop("linked")
    of = of.select("class", "leader")
    named = found.join(of.withColumnsRenamed({"class": "a", "leader": "la"}), "a").join(of.withColumnsRenamed({"class": "b", "leader": "lb"}), "b")
    turned = F.when(F.col("la") < F.col("lb"), F.col("frame_offset")).otherwise(-F.col("frame_offset"))
    return named.select(*_pairs("la", "lb"), turned.alias("frame_offset"), "overlap", "bit_error")


def aligned_recordings(media: DataFrame) -> DataFrame:
    """Per row of media (doc_id, samples): doc_id, n_frames, component_id, component_size and an earlier recording it aligns with, with offset, overlap and bit error."""
    scratch = Scratch(media.sparkSession)
    prints, leaders = _prints(media, scratch)
    rows = scratch.keep(prints.select("doc_id", "n_frames", "class"))
    links, labels = _connected(prints, leaders, scratch)
    links = scratch.keep(links)
    members = scratch.keep(rows.filter("class is not null and doc_id is not null").select("doc_id", "class").distinct())
    # classes of one doc_id belong together
    several = members.groupBy("doc_id").agg(F.min("class").alias("least"), F.max("class").alias("greatest")).filter("least < greatest").select("doc_id", "least")
    same = members.join(several, "doc_id").filter("least < class").select(F.col("least").alias("u"), F.col("class").alias("v"))
    if not same.isEmpty():
        labels = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(same), scratch)
    named = leaders.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    first = named.groupBy("component").agg(F.min("leader").alias("component_id"))
    named = scratch.keep(named.join(first, "component").drop("component"))
    both = links.select(F.col("a").alias("other"), F.col("b").alias("class"), "frame_offset", "overlap", "bit_error")
    both = both.unionByName(links.select(F.col("b").alias("other"), F.col("a").alias("class"), (-F.col("frame_offset")).alias("frame_offset"), "overlap", "bit_error"))
    earlier = both.join(leaders.select("class", F.col("leader").alias("own")), "class").join(leaders.select(F.col("class").alias("other"), "leader"), "other").filter("leader < own")
    closest = earlier.groupBy("class").agg(F.min(F.struct("bit_error", "leader", "frame_offset", "overlap")).alias("near"))
    by_class = named.join(closest, "class", "left")
    copied = F.when(F.col("leader") < F.col("doc_id"), F.struct(F.lit(0.0).alias("bit_error"), "leader", F.lit(0).alias("frame_offset"), F.col("frames").cast("int").alias("overlap")))
    per_doc = members.join(by_class, "class").withColumn("best", F.least(copied, "near")).groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.min("best").alias("best"))
    per_doc = scratch.keep(per_doc)
    sizes = scratch.keep(per_doc.groupBy("component_id").agg(F.count("*").alias("component_size")))
    out = rows.select("doc_id", "n_frames").join(per_doc.join(sizes, "component_id"), "doc_id", "left")
    return out.select(
        "doc_id", "n_frames", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("component_size", F.lit(1)).alias("component_size"),
        F.col("best.leader").alias("aligned_to"), F.col("best.frame_offset").alias("frame_offset"), F.col("best.overlap").alias("overlap"), F.col("best.bit_error").alias("bit_error"),
    )


def as_recordings(documents: DataFrame) -> DataFrame:
    """The texts' bytes read as 8-bit samples, so that copies and shared passages become copied recordings."""
    return documents.select("doc_id", F.col("text").cast("binary").alias("samples"))
