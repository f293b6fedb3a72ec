"""Benchmark decontamination by template windows, in DataFrame expressions.

Numbers, names and units become typed placeholders that keep their value aside; windows of
placeholders and words are hashed and joined to the benchmark's; where templates agree, each value of
the item must stand for one value of the document, as in a question asked again with other parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, table

WINDOW = 5
#: Share of an item's windows that a document must hold, in consistent places.
COVERAGE = 0.5
#: Benchmarks of up to so many windows (about 50 bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_WINDOWS = 400_000

#: Units of measure and currency.
UNITS = "mm cm dm m km in ft yd mi g kg mg t lb oz ml cl l s sec min h hr hrs days weeks months years km/h mph kmh usd eur gbp dollars euros pounds percent celsius fahrenheit hz khz mhz ghz kb mb gb tb w kw mw v a j kj cal kcal".split()

MARK, VALUE = "\u0001", "\u0002"
NAME = r"([\p{L}\p{N},;] )(\p{Lu}\p{Ll}+)"
NUMBER = r"([0-9]+(?:[.,][0-9]+)*)"
UNIT = "(" + MARK + "num" + VALUE + r"[0-9.,]+) ?(" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")\b"
OTHER = r"[^\p{L}\p{N}\x01\x02\x20\x09-\x0D]+"


def _named(text: Column) -> Column:
    """text with a mark before each name, a capitalised word inside a sentence."""
    # Neighbouring names need a second pass, as a match uses up the letter before it.
    once = F.regexp_replace(text, NAME, f"$1{MARK}name{VALUE}$2")
    return F.when(text.rlike(NAME), F.regexp_replace(once, NAME, f"$1{MARK}name{VALUE}$2")).otherwise(text)


def _slotted(named: Column) -> Column:
    """named with a mark before each number and unit too."""
    return F.when(named.rlike("[0-9]"), F.regexp_replace(F.regexp_replace(named, NUMBER, f"{MARK}num{VALUE}$1"), "(?i)" + UNIT, f"$1 {MARK}unit{VALUE}$2")).otherwise(named)


def _split(slotted: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(slotted), OTHER, ""), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def template_tokens(text: Column) -> Column:
    """Lower-case words without punctuation; a slot is MARK, its type, VALUE and its value."""
    return _split(_slotted(_named(text)))


def template_windows(rows: DataFrame, size: int, keys: list) -> DataFrame:
    """(*keys, n, pos, h, slots): a row per window of size tokens; slots is null where a window has none.

    Each step is a column of its own, and short texts go by an empty list, not by a filter: a filter
    would be moved below the steps and take them all once more.
    """
    named = rows.select(*keys, _named(F.coalesce("text", F.lit(""))).alias("_named"))
    tokens = named.select(*keys, _slotted(F.col("_named")).alias("_slotted")).select(*keys, _split(F.col("_slotted")).alias("_t"))
    slotted = F.exists("_t", lambda w: w.startswith(MARK))
    shape = F.transform("_t", lambda w: F.when(w.startswith(MARK), F.substring_index(w, VALUE, 1)).otherwise(w))
    split = tokens.select(*keys, "_t", slotted.alias("_any"))
    split = split.select(*keys, "_t", "_any", F.transform(F.when(F.col("_any"), shape).otherwise(F.col("_t")), lambda w: F.xxhash64(w)).alias("_c"))

    def window(i):
        parts = [F.get("_c", i + k) for k in range(size)]
        values = F.filter(F.slice("_t", i + 1, size), lambda w: w.startswith(MARK))
        return F.struct(i.alias("pos"), F.xxhash64(*parts).alias("h"), F.when(F.col("_any"), F.when(F.size(values) > 0, values)).alias("slots"))

    starts = F.when(F.size("_c") >= size, F.sequence(F.lit(0), F.size("_c") - size))
    return split.select(*keys, (F.size("_c") - size + 1).alias("n"), F.explode(F.transform(starts, window)).alias("w")).select(*keys, "n", "w.*")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, n_matched, n_windows, coverage, n_slots, reparameterised: a row per document and item it holds.

    docs(doc_id, text), items(item_id, text). An item of fewer tokens than a window is one window of
    its own length. Null and empty texts match nothing; repeated rows give one row. On each diagonal a
    window counts where it has no slots, or where its values agree with the diagonal's binding: two
    values of the item may share one of the document, and one value changed in some of its places costs
    only the windows of those places. Other columns of either table are not looked at.
    """
    return keyed_contamination(docs, items, window, coverage).drop("doc_key").distinct()


def keyed_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """contamination() with doc_key, a hash of the document's text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("doc_key"), "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    lengths = items.select(F.least(F.size(template_tokens(F.coalesce("text", F.lit("")))), F.lit(window)).alias("n")).where("n > 0").groupBy("n").agg(F.count("*").alias("items")).collect()
    hits = None
    for size in sorted((r["n"] for r in lengths), reverse=True):  # at most `window` lengths, one as a rule
        own = items if size == window else items.where(F.size(template_tokens(F.coalesce("text", F.lit("")))) == size)
        asked = template_windows(own, size, ["item_id"]).withColumnsRenamed({"pos": "item_pos", "n": "n_windows", "slots": "item_slots"})
        if asked.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
            asked = F.broadcast(asked)
        found = template_windows(docs, size, ["doc_id", "doc_key"]).drop("n").join(asked, "h")
        hits = found if hits is None else hits.union(found)
    if hits is None:
        empty = docs.where("false")
        return empty.select("doc_id", "doc_key", *[F.lit(None).cast(t).alias(n) for n, t in (("item_id", "long"), ("n_matched", "long"), ("n_windows", "long"), ("coverage", "double"), ("n_slots", "long"), ("reparameterised", "boolean"))])
    pairs = F.when(F.col("item_slots").isNotNull(), F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")))
    # Windows of one copy lie on one diagonal, a row for each of their slots or one without any; a diagonal is as long as an item at most.
    line = ["doc_id", "doc_key", "item_id", "line"]
    slots = hits.select("doc_id", "doc_key", "item_id", "n_windows", (F.col("pos") - F.col("item_pos")).alias("line"), F.col("item_pos").alias("at"), F.explode_outer(pairs).alias("p"))
    slots = slots.repartition(*line).select(*line, "n_windows", "at", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    # A value of the item is bound to the most frequent of the document; ties go to its like, then to the greatest.
    votes = slots.withColumn("n", F.count("*").over(Window.partitionBy(*line, "a", "b")))
    bound = votes.withColumn("best", F.max(F.struct("n", F.col("a") == F.col("b"), F.col("b").alias("b"))).over(Window.partitionBy(*line, "a"))["b"])
    off = F.max(F.col("a").isNotNull() & (F.col("b") != F.col("best"))).over(Window.partitionBy(*line, "at"))
    fits = bound.withColumn("off", off).where("NOT off")
    whole = fits.groupBy("doc_id", "doc_key", "item_id", "n_windows").agg(
        F.countDistinct("at").alias("n_matched"),
        F.countDistinct(F.when(F.col("a").isNotNull(), F.struct("a", "b"))).alias("n_slots"),
        F.coalesce(F.max(F.col("a") != F.col("b")), F.lit(False)).alias("reparameterised"),
    )
    share = F.col("n_matched") / F.col("n_windows")
    kept = whole.where(share >= coverage)
    return kept.select("doc_id", "doc_key", "item_id", "n_matched", F.col("n_windows").cast("long").alias("n_windows"), share.alias("coverage"), "n_slots", "reparameterised")


def decontaminate(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that hold no benchmark item, with docs' own columns. Rows are told by their text, so rows without an id and repeated ones go alike."""
    key = free_name(docs, "_held_key")
    held = keyed_contamination(docs, items, coverage=coverage).select(F.col("doc_key").alias(key)).distinct()
    return docs.join(held, F.xxhash64(docs["text"]) == held[key], "left_anti")


def op8_decontaminate(spark, sf_dir):
    """Documents that hold benchmark items, with the items; null and empty texts hold none."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_sql() -> str:
    """DuckDB SQL for op8 where every item has at least WINDOW tokens."""
    name = NAME.replace("'", "''")
    unit = r"(?i)(\x01num\x02[0-9.,]+) ?(" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")\b"
    canon = f"regexp_replace(regexp_replace(text, '{name}', '\\1' || chr(1) || 'name' || chr(2) || '\\2', 'g'), '{name}', '\\1' || chr(1) || 'name' || chr(2) || '\\2', 'g')"
    canon = f"regexp_replace(regexp_replace({canon}, '{NUMBER}', chr(1) || 'num' || chr(2) || '\\1', 'g'), '{unit}', '\\1 ' || chr(1) || 'unit' || chr(2) || '\\2', 'g')"
    canon = f"regexp_replace(lower({canon}), '{OTHER}', '', 'g')"
    return f"""
WITH texts AS (
  SELECT true AS is_doc, doc_id AS id, md5(coalesce(text, '')) AS k, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT false, item_id, '', coalesce(text, '') FROM benchmark),
tok AS (SELECT is_doc, id, k, list_filter(regexp_split_to_array({canon}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS t FROM texts),
shape AS (SELECT *, list_transform(t, lambda w: CASE WHEN starts_with(w, chr(1)) THEN split_part(w, chr(2), 1) ELSE w END) AS c, unnest(range(0, len(t) - {WINDOW} + 1)) AS pos FROM tok WHERE len(t) >= {WINDOW}),
win AS (SELECT is_doc, id, k, len(t) - {WINDOW} + 1 AS n, pos, array_to_string(c[pos + 1 : pos + {WINDOW}], ' ') AS w,
   list_filter(t[pos + 1 : pos + {WINDOW}], lambda x: starts_with(x, chr(1))) AS slots FROM shape),
hits AS (SELECT d.id AS doc_id, d.k, i.id AS item_id, i.n AS n_windows, i.pos AS item_pos, d.pos - i.pos AS line, i.slots AS a, d.slots AS b
   FROM win d JOIN win i ON d.w = i.w WHERE d.is_doc AND NOT i.is_doc),
slot AS (SELECT doc_id, k, item_id, n_windows, item_pos, line, unnest(CASE WHEN len(a) > 0 THEN list_transform(range(1, len(a) + 1), lambda j: {{'a': a[j], 'b': b[j]}}) ELSE [NULL] END) AS x FROM hits),
vote AS (SELECT *, x.a AS a, x.b AS b, count(*) OVER (PARTITION BY doc_id, k, item_id, line, x.a, x.b) AS n FROM slot),
bound AS (SELECT *, a IS NOT NULL AND b <> first_value(b) OVER (PARTITION BY doc_id, k, item_id, line, a ORDER BY n DESC, a = b DESC, b DESC) AS bad FROM vote),
fit AS (SELECT *, bool_or(bad) OVER (PARTITION BY doc_id, k, item_id, line, item_pos) AS off FROM bound)
SELECT DISTINCT doc_id, item_id, n_matched, n_windows, n_matched / CAST(n_windows AS DOUBLE) AS coverage, n_slots, reparameterised FROM (
  SELECT doc_id, k, item_id, CAST(n_windows AS BIGINT) AS n_windows, count(DISTINCT item_pos) AS n_matched, count(DISTINCT (a, b)) FILTER (WHERE a IS NOT NULL) AS n_slots, coalesce(bool_or(a <> b), false) AS reparameterised
  FROM fit WHERE NOT off GROUP BY ALL)
WHERE n_matched / CAST(n_windows AS DOUBLE) >= {COVERAGE}
"""
