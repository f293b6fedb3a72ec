"""Language identification by compression with per-language raw-content dictionaries."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import crc_mod, free_name, table

#: Bounds of the training sample of a language: rows of least hash are taken whole, at most SAMPLE_TEXTS of them,
#: until they have SAMPLE_CHARS code points; the first is taken whatever its length.
SAMPLE_TEXTS, SAMPLE_CHARS = 240, 110_000
#: Pieces that are compressed on their own, so that a long text does not become its own dictionary.
PIECE_BYTES = 2_048
LEVEL = 6
#: A best size must beat the next by this share of itself, else the text is rejected.
MIN_MARGIN = 0.005
OTHERS = re.compile(r"[\W\d_]+").sub


def has_letter(text: str) -> bool:
    """Is a character of text a letter (of a Unicode category L*)? Digits and numbers like a half are none."""
    return any(map(str.isalpha, text))


def plain(text: str) -> bytes:
    """What is compressed: lower-case words between single spaces."""
    return (" " + OTHERS(" ", text.lower()).strip() + " ").encode("utf-8", "surrogatepass")


def learn_dictionaries(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", key_col: str = "doc_id") -> dict:
    """{language: dictionary bytes} from a bounded sample of labelled rows per language, whole texts each.

    Rows with a null language or text are not used. The sample is a fixed one: the rows of least hash
    of key and text, so rows that share a key, or have none, are as likely as others; equal hashes are
    ordered by text and repeated rows count once each. A language's rate is set by its count of rows.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(key_col, text_col).alias("h")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    rates = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 2.0 * SAMPLE_TEXTS / n + 50.0 / n)))])
    picked = rows.where(F.pmod("h", F.lit(1 << 30)) < rates[F.col("lang")] * (1 << 30))
    order = Window.partitionBy("lang").orderBy("h", "text")
    first = picked.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE_TEXTS)
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sample = first.withColumn("before", before).where(F.col("before") < SAMPLE_CHARS)
    out: dict = {lang: [] for lang in counts}
    for r in sample.select("lang", "n", "text").collect():
        out[r["lang"]].append((r["n"], r["text"]))
    return {lang: b"".join([plain(t) for _, t in sorted(texts, reverse=True)]) for lang, texts in sorted(out.items())}


class CompressionClassifier:
    """Sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict, level: int = LEVEL):
        import zstandard as z

        self.langs = list(dictionaries)
        self.by = []
        for data in dictionaries.values():
            d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
            params = z.ZstdCompressionParameters.from_level(level, write_checksum=False, write_content_size=False, write_dict_id=False)
            d.precompute_compress(compression_params=params)
            self.by.append(z.ZstdCompressor(dict_data=d, compression_params=params).compress)

    def sizes(self, text: str) -> list:
        data = plain(text)
        pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
        return [sum([len(c(p)) for p in pieces]) for c in self.by]

    def __call__(self, text: str | None) -> tuple:
        """(language, score, rejected): 'und', 0 and rejected without a letter; ties go to the first language by name.

        Fewer than two languages leave no margin to judge, so a text with a letter is not rejected
        then: with one it gets that language and score 1, with none 'und' and score 0.
        """
        if not text or not has_letter(text):
            return "und", 0.0, True
        if len(self.langs) < 2:
            return (self.langs[0], 1.0, False) if self.langs else ("und", 0.0, False)
        sizes = self.sizes(text)
        best = min(sizes)
        at = sizes.index(best)
        second = min([s for i, s in enumerate(sizes) if i != at])
        score = 1.0 / sum([math.exp(-min(50.0, 0.5 * (s - best))) for s in sizes])
        return self.langs[at], score, second - best < MIN_MARGIN * best


FOUND = ("lang_pred", "score", "rejected")


def identify(docs: DataFrame, dictionaries: dict, text_col: str = "text", names: tuple = FOUND) -> DataFrame:
    """docs and three columns for each whole text, called lang_pred, score and rejected unless names says otherwise.

    A null or empty text and one without a letter is 'und', 0 and rejected. Columns of docs stay as they
    are: a name that docs has already is an error.
    """
    clash = set(names) & set(docs.columns)
    if clash:
        raise ValueError(f"docs has columns {sorted(clash)} already; give other names")
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(dictionaries)
    columns = docs.columns
    at = columns.index(text_col)
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in zip(names, ("string", "double", "boolean")))).fields])

    def run(batches):
        classify = CompressionClassifier(shipped.value)
        for batch in batches:
            found = [classify(t) for t in batch.column(at).to_pylist()]
            lang, score, rejected = zip(*found) if found else ((), (), ())
            made = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*columns, *names])

    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, dictionaries: dict, text_col: str = "text") -> DataFrame:
    """The rows of docs that identify() does not reject, with docs' own columns, whatever their names."""
    names = tuple(free_name(docs, n) for n in FOUND)
    return identify(docs, dictionaries, text_col, names).where(~F.col(names[2])).select(*docs.columns)


def op7_langid(spark, sf_dir):
    """Predicted language of each document, learnt from rows that are not held out; null and letterless texts are und."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    dictionaries = learn_dictionaries(docs.where(~held_out))
    return identify(docs.select("doc_id", "text"), dictionaries).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
