"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, mix64, table, text_blocks

SHINGLE, BINS, BITS = 5, 256, 4
#: Odd multipliers that give each position in a shingle its own weight.
WEIGHTS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF for i in range(1, 64)], np.uint64)
#: Upper bound of the key ranges that rows are dealt into for their order.
MAX_RANGES = 8_192
ROWS_A_RANGE = 400
#: Bins that an empty bin tries at once.
TRIES = 64


class OnePermutation:
    """Fingerprints of word shingles; values are bytes, the empty string for a text without words."""

    def __init__(self, shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS):
        assert 8 % bits == 0 and bins & (bins - 1) == 0
        self.shingle, self.bins, self.bits, self.words = shingle, bins, bits, WordHashes(1)
        self.blocks: dict = {}

    def tries(self, k: int) -> np.ndarray:
        """TRIES more rows of bins to try: an empty bin goes down its column, which is the same for all texts, to the first full one."""
        if k not in self.blocks:
            at, t = np.arange(self.bins, dtype=np.uint64), np.arange(k * TRIES, (k + 1) * TRIES, dtype=np.uint64)[:, None]
            self.blocks[k] = (mix64(at * np.uint64(1_000_003) + t + np.uint64(1)) & np.uint64(self.bins - 1)).astype(np.int64)
        return self.blocks[k]

    def shingles(self, text: str) -> np.ndarray:
        w = self.words.array(text.encode("utf-8", "surrogatepass").split())
        k = self.shingle if len(w) >= self.shingle else len(w)
        if not k:
            return w
        total = np.zeros(len(w) - k + 1, np.uint64)
        for i in range(k):
            total += w[i : len(w) - k + 1 + i] * WEIGHTS[i]
        return mix64(total + np.uint64(k))

    def __call__(self, text: str | None) -> bytes:
        h = self.shingles(text or "")
        if not len(h):
            return b""
        bins = (h >> np.uint64(64 - self.bins.bit_length() + 1)).astype(np.int64)
        least = np.full(self.bins, 0xFFFFFFFFFFFFFFFF, np.uint64)
        np.minimum.at(least, bins, h << np.uint64(self.bins.bit_length() - 1))
        full = np.zeros(self.bins, bool)
        full[bins] = True
        empty = np.nonzero(~full)[0]
        k = 0
        while len(empty):  # ends: every bin comes up in every column
            tries = self.tries(k)[:, empty]
            ok = full[tries]
            hit = ok.any(axis=0)
            least[empty[hit]] = least[tries[ok.argmax(axis=0)[hit], np.nonzero(hit)[0]]]
            empty, k = empty[~hit], k + 1
        low = (mix64(least) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        per = 8 // self.bits
        packed = np.zeros(self.bins // per, np.uint8)
        for i in range(per):
            packed |= low[i::per] << np.uint8(self.bits * i)
        return packed.tobytes()

    def likeness(self, a: bytes, b: bytes) -> float:
        """Resemblance estimate: the share of equal bins, less what low-order bits agree by chance."""
        if not a or not b:
            return float(a == b)
        differ, mask = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8), (1 << self.bits) - 1
        equal = sum(int(np.count_nonzero((differ >> (self.bits * i)) & mask == 0)) for i in range(8 // self.bits))
        chance = 2.0**-self.bits
        return min(1.0, max(0.0, (equal / self.bins - chance) / (1.0 - chance)))


def with_next(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) dealt into key ranges, in which each row is followed by the next in order.

    The order is descending doc_id, null last, then text; each range also holds, last and with
    halo true, the row that follows its own last row; the last range has the first row of all.
    Result: (range, doc_id, text, halo), partitioned by range and sorted. The texts move once.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    stats = docs.agg(F.count("*").alias("n"), F.max(key).alias("top")).first()
    ranges = max(1, min(MAX_RANGES, stats["n"] // ROWS_A_RANGE))
    cuts = docs.select(key.alias("k")).agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)] or [0.5], 10 * ranges)).first()[0] if stats["n"] else []
    cuts = np.unique(np.array(cuts if ranges > 1 else [], np.int64))
    shipped = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def range_of(k):
        import pandas as pd

        return pd.Series(np.searchsorted(shipped.value, k.to_numpy(), side="right").astype(np.int32))

    # The greatest key of each range heads it; the range before it in order ends with that row.
    heads = sorted((r[0], r[1]) for r in docs.select(key.alias("k")).groupBy(range_of("k").alias("r")).agg(F.max("k").alias("k")).collect())
    before = {heads[i][1]: heads[i + 1][0] for i in range(len(heads) - 1)}
    if heads:
        before[heads[-1][1]] = heads[0][0]
    keys = np.array(sorted(before), np.int64)
    targets = spark.sparkContext.broadcast((keys, np.array([before[k] for k in keys.tolist()], np.int32)))

    @F.pandas_udf("int")
    def halo_of(k):
        import pandas as pd

        heads, to = targets.value
        at = np.minimum(np.searchsorted(heads, k.to_numpy()), max(len(heads) - 1, 0))
        return pd.Series(np.where(heads[at] == k.to_numpy(), to[at], -1).astype(np.int32) if len(heads) else np.full(len(k), -1, np.int32))

    rows = docs.select("doc_id", "text", key.alias("k")).select("doc_id", "text", "k", range_of("k").alias("own"), halo_of("k").alias("other"))
    none = F.lit(None).cast("struct<r:int,halo:boolean>")
    places = F.array_compact(
        F.array(
            F.struct(F.col("own").alias("r"), F.lit(False).alias("halo")),
            F.when(F.col("other") >= 0, F.struct(F.col("other").alias("r"), F.lit(True).alias("halo"))).otherwise(none),
        )
    )
    dealt = rows.select("doc_id", "text", "k", F.explode(places).alias("p")).select(F.col("p.r").alias("range"), F.col("p.halo").alias("halo"), "k", "doc_id", "text")
    return dealt.repartition("range").sortWithinPartitions("range", "halo", F.desc("k"), "text").select("range", "doc_id", "text", "halo")


def edited_text(text: str, following: str) -> str:
    """text with its last third replaced by as many characters, or all, of the start of following."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of docs(doc_id, text).

    A null text is empty; a text without words has an empty fingerprint, alike only to its like.
    Rows of equal doc_id follow one another by text; a lone row is its own next row.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        make, held, last_range = OnePermutation(), None, None  # held: the row whose next one is still to come
        for batch in batches:
            ids, texts, ranges, halos = (batch.column(n).to_pylist() for n in ("doc_id", "text", "range", "halo"))
            for i, j in text_blocks(texts):
                out = []
                for doc_id, text, r, halo in zip(ids[i:j], texts[i:j], ranges[i:j], halos[i:j]):
                    text = text or ""
                    if r != last_range:
                        held, last_range = None, r
                    if halo and held is None:
                        continue
                    own = make(text)
                    if held is not None:
                        d, t, f = held
                        changed = edited_text(t, text)
                        g = f if changed == t else make(changed)
                        out.append((d, len(t), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), f.hex(), g.hex(), make.likeness(f, g), make.likeness(f, own)))
                    held = None if halo else (doc_id, text, own)
                columns = list(zip(*out)) if out else [()] * len(names)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, schema)


def op4_fingerprints(spark, sf_dir):
    """Fingerprints of each document and of its edited text, with their likeness; a null text is empty."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))
