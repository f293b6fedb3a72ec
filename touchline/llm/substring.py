"""Repeated word windows: a count-min prefilter, then exact grouping of what it estimates repeated.

Windows are too many to move, so they are named by content: the anchor of a window is the least of
the hashes of its 8-word pieces.  Equal windows have equal anchors at equal offsets, and
neighbouring windows mostly share their anchor, so a run of windows with one anchor is one row.

1. Each partition counts its anchors in a count-min sketch; the sketches are merged by summing.  A
   window's estimate is that of its anchor, the least of its cells' counts, which is never below the
   window's own count: a window estimated single is single.  All others go on: none is lost.  The
   sketch's width follows the text's size, so its load is the same at every size; it is made of
   blocks that are merged apart.  Up to BROADCAST_BYTES its cells of two or more are broadcast as
   bits; beyond, the runs of windows meet those cells by a join.
2. Runs estimated repeated are grouped by a 128-bit content hash of two independent halves.  A run
   that occurs twice has only repeated windows.  Where an anchor has differing runs, the single ones
   are compared window by window, also by 128-bit hash, with one occurrence of each other run of that
   anchor.
3. The spans found join their documents, which move once.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MASK64, mix64, staged, table, text_blocks

WINDOW, PIECE = 35, 8
#: Count-min sketch: rows, cells of a row in a block, characters of text for each cell of a row (there are about
#: two cells to an anchor), and the greatest size that is broadcast.
DEPTH, BLOCK, CHARS_A_CELL = 2, 1 << 18, 36
BROADCAST_BYTES = 96_000_000
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class WordPairs(dict):
    """The two halves of words' hashes, each of a seed of its own, by a remembered place in two arrays; the second only where asked for."""

    LIMIT = 300_000

    def __init__(self, both: bool):
        import xxhash

        self.hash, self.both, self.halves = xxhash.xxh3_64_intdigest, both, (array("Q"), array("Q"))

    def __missing__(self, word):
        at = self[word] = len(self)
        self.halves[0].append(self.hash(word, 3))
        if self.both:
            self.halves[1].append(self.hash(word, 11))
        return at

    def places(self, words: list) -> np.ndarray:
        """Places of one text's words, good until the next call."""
        if len(self) > self.LIMIT:
            self.clear()
            self.halves = (array("Q"), array("Q"))
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def half(self, which: int, at: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.halves[which], np.uint64)[at]


class Rolling:
    """128-bit hashes of word ranges from prefix sums of weighted word hashes; the halves share nothing."""

    def __init__(self, both: bool = True):
        self.words = WordPairs(both)
        self.size = 0

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(2 * n, 1 << 16)
            self.up = [_powers(b, self.size) for b in BASES]
            self.down = [_powers(pow(b, -1, 1 << 64), self.size) for b in BASES]

    def load(self, words: list) -> None:
        self._grow(len(words) + 1)
        self.at = self.words.places(words)
        self.n = len(self.at)
        self.sums = [None, None]

    def _sums(self, which: int) -> np.ndarray:
        if self.sums[which] is None:
            s = self.sums[which] = np.zeros(self.n + 1, np.uint64)
            np.cumsum(self.words.half(which, self.at) * self.up[which][: self.n], out=s[1:])
        return self.sums[which]

    def ranges(self, start: np.ndarray, stop: np.ndarray, which: int) -> np.ndarray:
        sums = self._sums(which)
        return mix64((sums[stop] - sums[start]) * self.down[which][start])

    def runs(self, window: int, piece: int):
        """(anchor, first window, windows) of each run of windows whose least piece is at one place."""
        n = self.n - window + 1
        if n < 1:
            return None
        m = self.n - piece + 1
        sums = self._sums(0)
        g = mix64((sums[piece:] - sums[:m]) * self.down[0][:m]) ^ np.uint64(0x5851F42D4C957F2D)
        span = window - piece + 1
        # Least piece of each window, by doubling the span that a running minimum covers.
        least, have = g, 1
        while have < span:
            step = min(have, span - have)
            least = np.minimum(least[: len(least) - step], least[step:])
            have += step
        # The leftmost least piece changes where it leaves the window or a smaller one enters.
        first = np.concatenate([[0], 1 + np.nonzero((g[: n - 1] == least[:-1]) | (least[1:] != least[:-1]))[0]])
        return mix64(least[first]), first, np.diff(np.append(first, n))


def sketch_blocks(chars: int) -> int:
    """Blocks of the sketch of a corpus of so many characters."""
    return max(1, -(-chars // (CHARS_A_CELL * BLOCK)))


def cells(values: np.ndarray, blocks: int) -> list:
    """The sketch cell of each value in each row; values are well mixed. All rows of a value lie in the block that its upper half names."""
    first = ((values >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)) * np.uint64(DEPTH * BLOCK)
    mask = np.uint64(BLOCK - 1)
    out = [(first + (values & mask)).view(np.int64)]
    for d in range(1, DEPTH):
        out.append((first + np.uint64(d * BLOCK) + (mix64(values + np.uint64(0x9E3779B97F4A7C15 * d & MASK64)) & mask)).view(np.int64))
    return out


PARTS = "block int, cells binary, counts binary"


def _counted(anchors: np.ndarray, blocks: int) -> pa.RecordBatch:
    """One partition's sketch: per block the cells that it hit and their counts, up to 255."""
    hit, n = np.unique(np.concatenate(cells(anchors, blocks)), return_counts=True)
    n, per = np.minimum(n, 255).astype(np.uint8), DEPTH * BLOCK
    block = hit // per
    cuts = np.append(np.nonzero(np.diff(block, prepend=-1))[0], len(hit))
    local = (hit - block * per).astype(np.uint32)
    rows = [(int(block[i]), local[i:j].tobytes(), n[i:j].tobytes()) for i, j in zip(cuts, cuts[1:])]
    return _batch(list(zip(*rows)) or [(), (), ()], [pa.int32(), pa.binary(), pa.binary()], ["block", "cells", "counts"])


def _merged(lists: pa.Table, need: int) -> np.ndarray:
    """Which cells of a block have a merged count of at least need?"""
    count = np.zeros(DEPTH * BLOCK, np.uint16)
    for cell, n in zip(lists.column("cells"), lists.column("counts")):
        at = np.frombuffer(cell.as_buffer(), np.uint32)  # different within one part
        count[at] = np.minimum(count[at] + np.frombuffer(n.as_buffer(), np.uint8), 255)
    return count >= need


class Bits:
    """A merged sketch as a bit array: is each of a value's cells set?"""

    def __init__(self, packed: np.ndarray, blocks: int):
        self.packed, self.blocks = packed, blocks

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), bool)
        for i in cells(values, self.blocks):
            out &= (self.packed[i >> 3] >> (i & 7).astype(np.uint8)) & 1 > 0
        return out


def _bits(parts: DataFrame, blocks: int, need: int) -> np.ndarray:
    """The merged sketch of parts, on the driver; its size is checked before."""

    def merge(key, lists):
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(_merged(lists, need), bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    per = DEPTH * BLOCK // 8
    out = np.zeros(per * blocks, np.uint8)
    for r in parts.groupBy("block").applyInArrow(merge, "block int, bits binary").toLocalIterator():
        out[r["block"] * per : (r["block"] + 1) * per] = np.frombuffer(r["bits"], np.uint8)
    return out


def _full_cells(parts: DataFrame, need: int) -> DataFrame:
    """(cell): the cells of parts with a merged count of at least need, as rows."""

    def merge(key, lists):
        found = np.nonzero(_merged(lists, need))[0] + key[0].as_py() * DEPTH * BLOCK
        return pa.Table.from_arrays([pa.array(found, pa.int64())], ["cell"])

    return parts.groupBy("block").applyInArrow(merge, "cell long")


def _batch(columns: list, kinds: list, names: list):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _documents(batches, window: int, piece: int, rolling: "Rolling"):
    """Per block of texts, the joined words' runs; a run never crosses documents.

    Yields (batch, row, runs).
    """
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for i, j in text_blocks(texts):
            for row in range(i, j):
                words = (texts[row] or "").encode("utf-8", "surrogatepass").split()
                if len(words) < window:
                    continue
                rolling.load(words)
                runs = rolling.runs(window, piece)
                if runs is not None:
                    yield batch, row, runs


def repeated_spans(docs: DataFrame, window: int = WINDOW, piece: int = PIECE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, text_hash, start, windows): runs of window starts whose word sequence also starts elsewhere.

    docs(doc_id, text_hash, text). Windows never cross rows; repeated rows repeat each other's windows.
    """
    spark = docs.sparkSession
    blocks = sketch_blocks(docs.agg(F.sum(F.length("text"))).first()[0] or 0)
    fits = blocks * DEPTH * BLOCK // 8 <= broadcast_bytes

    def sketch(batches):
        rolling, held, size = Rolling(both=False), [], 0
        for _, _, (anchor, _, _) in _documents(batches, window, piece, rolling):
            held.append(anchor)
            size += len(anchor)
            if size > 2_000_000:
                yield _counted(np.concatenate(held), blocks)
                held, size = [], 0
        if held:
            yield _counted(np.concatenate(held), blocks)

    counted = docs.select("text").mapInArrow(sketch, PARTS)

    def content(rolling, anchor, first, count, which):
        h = rolling.ranges(first, first + count + window - 1, which)
        return mix64(h + anchor * np.uint64(3) + count.astype(np.uint64))

    def place(doc_id, text_hash, first):
        seed = ((doc_id or 0) * 0x9E3779B97F4A7C15 ^ (text_hash & MASK64)) & MASK64
        return mix64(np.uint64(seed) + first.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def emit(batches, pick, columns, sieve=None):
        """Blocks of result rows; columns(rolling, picked run arrays) gives the long columns after the row's own, sieve a mask of rows by the first."""
        rolling, held, size = Rolling(), [], 0
        for batch, row, runs in _documents(batches, window, piece, rolling):
            doc_id, text_hash = batch.column("doc_id")[row].as_py(), batch.column("text_hash")[row].as_py()
            keep = slice(None) if pick is None else pick(batch, row, runs)
            if pick is None or keep.any():
                out = columns(rolling, doc_id, text_hash, *(x[keep] for x in runs))
                held.append((doc_id, text_hash, out))
                size += len(out[0])
            if size > 100_000:
                yield gathered(held, sieve)
                held, size = [], 0
        if held:
            yield gathered(held, sieve)

    def gathered(held, sieve):
        counts = [len(out[0]) for _, _, out in held]
        ids = pa.array([d for d, _, _ in held], pa.int64()).take(pa.array(np.repeat(np.arange(len(held)), counts)))
        hashes = np.repeat(np.array([h for _, h, _ in held], np.int64), counts)
        longs = [np.concatenate(c).astype(np.uint64, copy=False).view(np.int64) for c in zip(*(out for _, _, out in held))]
        if sieve is not None:
            kept = sieve(longs[0].view(np.uint64))
            ids, hashes, longs = ids.filter(pa.array(kept)), hashes[kept], [c[kept] for c in longs]
        return pa.RecordBatch.from_arrays([ids, pa.array(hashes), *map(pa.array, longs)], names=["doc_id", "text_hash", *(f"c{i}" for i in range(len(longs)))])

    def run_columns(rolling, doc_id, text_hash, anchor, first, count):
        both = [content(rolling, anchor, first, count, i) for i in (0, 1)]
        return [anchor, *both, place(doc_id, text_hash, first), first.astype(np.uint64), count.astype(np.uint64)]

    fields = "doc_id long, text_hash long, c0 long, c1 long, c2 long, c3 long, c4 long, c5 long"
    named = {"c0": "anchor", "c1": "k1", "c2": "k2", "c3": "place", "c4": "start", "c5": "windows"}
    if fits:
        often = spark.sparkContext.broadcast(_bits(counted, blocks, 2))

        def run_rows(batches):
            return emit(batches, None, run_columns, Bits(often.value, blocks))

        runs = docs.mapInArrow(run_rows, fields).withColumnsRenamed(named)
    else:
        full = staged(_full_cells(counted, 2), "cells")

        def all_rows(batches):
            columns = lambda *args: [*run_columns(*args), *cells(args[3], blocks)]
            return emit(batches, None, columns)

        runs = docs.mapInArrow(all_rows, fields + "".join(f", c{6 + d} long" for d in range(DEPTH)))
        for d in range(DEPTH):
            runs = runs.join(full, F.col(f"c{6 + d}") == full["cell"], "left_semi")
        runs = runs.drop(*(f"c{6 + d}" for d in range(DEPTH))).withColumnsRenamed(named)
    runs = staged(runs, "runs")

    kinds = staged(runs.groupBy("k1", "k2", "anchor").agg(F.count("*").alias("n"), F.min("place").alias("one")), "kinds")
    mixed = staged(kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1").select("anchor"), "mixed")
    wanted = kinds.join(mixed, "anchor", "left_semi").select("one")

    def window_columns(rolling, doc_id, text_hash, anchor, first, count):
        start = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return [rolling.ranges(start, start + window, 0), rolling.ranges(start, start + window, 1), start.astype(np.uint64)]

    # One occurrence of each run is compared window by window.
    fields = "doc_id long, text_hash long, c0 long, c1 long, c2 long"
    if fits:
        # It is marked in a Bloom filter of the sketch's size: a false mark only adds a true occurrence.
        def marks(batches):
            held = [np.asarray(b.column(0)).view(np.uint64) for b in batches]
            if held:
                yield _counted(np.concatenate(held), blocks)

        chosen = spark.sparkContext.broadcast(_bits(wanted.mapInArrow(marks, PARTS), blocks, 1))

        def window_rows(batches):
            picked = Bits(chosen.value, blocks)
            return emit(batches, lambda batch, row, runs: picked(place(batch.column("doc_id")[row].as_py(), batch.column("text_hash")[row].as_py(), runs[1])), window_columns)

        windows = docs.mapInArrow(window_rows, fields)
    else:
        own = runs.join(wanted, runs["place"] == wanted["one"], "left_semi").groupBy("doc_id", "text_hash").agg(F.collect_set("start").alias("starts"))
        own = staged(own.withColumnsRenamed({"doc_id": "d", "text_hash": "h"}), "starts")
        held = docs.join(own, docs["doc_id"].eqNullSafe(own["d"]) & (docs["text_hash"] == own["h"])).select("doc_id", "text_hash", "text", "starts")
        windows = held.mapInArrow(lambda batches: emit(batches, lambda batch, row, runs: np.isin(runs[1], batch.column("starts")[row].values.to_numpy()), window_columns), fields)
    windows = staged(windows.withColumnsRenamed({"c0": "w1", "c1": "w2", "c2": "start"}), "windows")
    again = staged(windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2"), "again")
    singles = windows.join(again, ["w1", "w2"], "left_semi").select("doc_id", "text_hash", "start", F.lit(1).cast("long").alias("windows"))
    whole = staged(kinds.where("n > 1").select("k1", "k2"), "whole")
    return runs.join(whole, ["k1", "k2"], "left_semi").select("doc_id", "text_hash", "start", "windows").union(singles)


def remove_repeats(docs: DataFrame, window: int = WINDOW, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: each word that a repeated window covers is removed.

    Words are split at ASCII white space; kept words are joined by one space.  A null text has no
    words.  Repeated rows and copies lose all their windows, as each starts elsewhere too.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_hash"), F.coalesce(text_col, F.lit("")).alias("text"))
    spans = repeated_spans(docs, window, piece, broadcast_bytes).select("doc_id", "text_hash", F.struct("start", "windows").alias("s")).groupBy("doc_id", "text_hash").agg(F.collect_set("s").alias("spans"))
    spans = staged(spans.withColumnsRenamed({"doc_id": "d", "text_hash": "h"}), "spans")
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(spans["d"]) & (docs["text_hash"] == spans["h"]), "left").select("doc_id", "text", F.col("spans.start").alias("starts"), F.col("spans.windows").alias("counts"))

    def cut(batches):
        for batch in batches:
            out = []
            for doc_id, text, starts, counts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words = text.encode("utf-8", "surrogatepass").split()
                n, gone = len(words), 0
                if starts:
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, np.array(starts), 1)
                    np.add.at(edge, np.array(starts) + np.array(counts) + window - 1, -1)
                    covered = np.cumsum(edge[:n]) > 0
                    gone = int(covered.sum())
                    words = [w for w, c in zip(words, covered.tolist()) if not c]
                out.append((doc_id, n, gone, b" ".join(words).decode("utf-8", "surrogatepass")))
            yield _batch(list(zip(*out)) or [(), (), (), ()], [pa.int64(), pa.int64(), pa.int64(), pa.string()], ["doc_id", "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")


def op5_substring_dedup(spark, sf_dir):
    """Words, removed words and a digest of the rest for each document; a null or empty text has none of either."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
