"""Source divergence audit: how far the word use of each source is from its language and from the other sources."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table, unstage, word_chunks
from .radix import radix_top

#: A language keeps terms of so many of its documents; so many terms are told per group.
MIN_DOCS, TOP = 10, 10
#: Bytes of text and distinct entries that a task counts before it passes its counts on.
FLUSH_BYTES, FLUSH_ENTRIES = 64_000_000, 400_000
#: ASCII letters in lower case, other ASCII bytes as separators, bytes of other letters as they are.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"


def _counted(batches):
    """Rows of COUNTS for a task's texts; a row with an empty term counts a group's documents."""
    held: dict = {}
    size = 0

    def rows():
        for (lang, source), (n, docs, total) in held.items():
            terms = list(n)
            for i in range(0, max(len(terms), 1), 50_000):
                part = terms[i : i + 50_000]
                extra = [b""] if i == 0 else []
                texts = pa.array(extra + part, pa.binary()).cast(pa.string())
                count = [0] * len(extra) + [n[t] for t in part]
                of = [total] * len(extra) + [docs[t] for t in part]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(texts), pa.string()), pa.array([source] * len(texts), pa.string()), texts, pa.array(count, pa.int64()), pa.array(of, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, batch.column(2)):
            own = held.get((lang, source))
            if own is None:
                own = held[lang, source] = [Counter(), Counter(), 0]
            own[2] += 1
            data, seen = text.as_py(), set()
            before = len(own[0])
            for words in word_chunks(data.translate(LETTERS)):
                own[0].update(words)
                seen.update(words)
            own[1].update(seen)
            size += len(data) + (len(own[0]) - before) * (FLUSH_BYTES // FLUSH_ENTRIES)
            if size >= FLUSH_BYTES:
                yield from rows()
                held, size = {}, 0
    yield from rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group, staged.

    Nulls are ''.  Each group has a row of the empty term, whose docs counts its documents.  Tasks
    count their texts before the shuffle, so that a large group costs as many rows as terms.
    """
    picked = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return staged(picked.mapInArrow(_counted, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), exactly; null without terms."""
    whole = (count + 2).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.call_function("div", whole, F.nullif(total + 2 * terms, F.lit(0).cast("long")).cast("decimal(20,0)")).cast("long") + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares, exactly."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for each (lang, source) group of docs(text, lang, source).

    Part `pair`: item is another source of the language and value the gaps of their shares summed
    over all kept terms, a language's terms of min_docs documents or more; it is 0 where none is kept.
    Part `term`: item is a term that the group has and uses more than its language does, value the
    gap; the `top` greatest.  Ranks go by value descending, then item ascending by UTF-8 bytes.

    Nulls in text, lang and source are ''; an empty text is a document of its group; each row is a
    document, repeated or not; other columns are not looked at; without rows the result is empty.

    Pairs are sparse: each starts from the gap of both sources' shares of an absent term, taken for
    all terms at once, is corrected by the terms of either source alone (by how many terms share a
    count), and then by the terms that both have.
    """
    counts = term_counts(docs)
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    entries = staged(counts.where("term <> ''").select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "entries")
    by_lang = entries.groupBy("lang", "term").agg(F.first("n_lang").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    by_group = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = counts.where("term = ''").select("lang", "source").join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("total", "terms", "lang_total"))).withColumn("base", share(zero, F.col("total"), F.col("terms")))
    groups = staged(groups, "groups")
    shares = entries.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("n_lang"), F.col("lang_total"), F.col("terms")).alias("q"), "base"
    )
    shares = staged(shares, "shares")
    unstage(counts, entries)

    c = F.col
    one, two = groups.select("lang", c("source").alias("a"), c("base").alias("base_a"), "terms"), groups.select("lang", c("source").alias("b"), c("base").alias("base_b"))
    absent = one.join(two, "lang").where("a < b").select("lang", "a", "b", F.coalesce(c("terms") * gap(c("base_a"), c("base_b")), zero).alias("v"))
    alike = shares.groupBy("lang", c("source").alias("a"), c("base").alias("base_a"), "p").agg(F.count("*").alias("m"))
    alone = alike.join(two, "lang").where("a <> b").select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (c("m") * (gap(c("p"), c("base_b")) - gap(c("base_a"), c("base_b")))).alias("v"))
    left, right = (shares.select("lang", "term", c("source").alias(s), c("p").alias(f"p_{s}"), c("base").alias(f"base_{s}")) for s in ("a", "b"))
    both = left.join(right, ["lang", "term"]).where("a < b").select(
        "lang", "a", "b", (gap(c("p_a"), c("p_b")) - gap(c("p_a"), c("base_b")) - gap(c("base_a"), c("p_b")) + gap(c("base_a"), c("base_b"))).alias("v")
    )
    summed = absent.union(alone).union(both).groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))
    sides = F.explode(F.array(F.struct(c("a").alias("source"), c("b").alias("item")), F.struct(c("b").alias("source"), c("a").alias("item"))))
    pairs = summed.select("lang", sides.alias("s"), "value").select("lang", "s.source", "s.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(c("value").desc(), "item")))
    over = shares.where("p > q").select("lang", "source", "term", gap(c("p"), c("q")).alias("value"))
    terms = radix_top(over, ["lang", "source"], "value", "term", top)
    row = lambda df, part, item: df.select("lang", "source", F.lit(part).alias("part"), c(item).alias("item"), "value", "rank")
    return row(pairs, "pair", "item").union(row(terms, "term", "term"))


def op11_divergence(spark, sf_dir):
    """Pairs of sources and the ten most overused terms of each source, over all documents."""
    return source_divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 10),
langs AS (SELECT lang, count(*) AS terms, sum(n) AS total FROM kept GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
dense AS (SELECT g.lang, g.source, kept.term, coalesce(n.n, 0) AS n, kept.n AS n_lang,
  sum(coalesce(n.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, langs.total AS lang_total, langs.terms AS terms
  FROM g JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term),
s AS (SELECT lang, source, term, n,
  1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * terms) AS p, 1 + (1000000000::HUGEINT * (n_lang + 2)) // (lang_total + 2 * terms) AS q FROM dense),
pair AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
  FROM s x JOIN s y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, y.source AS item, CAST(coalesce(pair.value, 0) AS BIGINT) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pair ON pair.lang = x.lang AND pair.source = x.source AND pair.item = y.source),
terms AS (SELECT lang, source, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM s WHERE n > 0 AND p > q),
parts AS (SELECT *, 'pair' AS part FROM pairs UNION ALL SELECT *, 'term' AS part FROM terms)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM parts
QUALIFY part = 'pair' OR rank <= 10
"""
