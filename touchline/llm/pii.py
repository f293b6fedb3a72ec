"""Personal data: fixed patterns, and weakly supervised spans, in DataFrame expressions.

Base kinds are found by pattern.  Candidates of further kinds get votes of pattern, gazetteer and
context labelers; expectation-maximisation over the counts of vote patterns estimates each labeler's
reliability, and its posteriors train a classifier of spans by features of the span and its context.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, table, unstage

#: The base patterns, by kind. Possessive forms of the contract's patterns: the same matches,
#: in time linear in the text. A match may start only where the run of its first class starts or the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")

#: What candidates of the learnt kinds look like, each with the word or assignment before it, if any.
#: A secret is a whole token of 16 letters and digits or more, both present; an account is two letters, two digits
#: and groups of four; a name is two or three capitalised words.
SECRET = r"(?:(?<![A-Za-z_])[A-Za-z_]{2,24}+ ?[=:] ?[\"']?)?(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{16,}+(?!@)"
ACCOUNT = r"(?:(?<![\p{L}])\p{L}{2,24}+\.?[ :=]{1,3}+)?(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
NAME = r"(?:(?<![\p{L}\p{N}])\p{L}{1,16}+\.?[ :]{1,2}+)?(?<![\p{L}\p{N}])\p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++){1,2}(?![\p{L}\p{N}])"
#: Gazetteers of words that introduce a candidate, of countries of accounts, and of first names.
SECRET_WORDS = "token password passwd pwd secret key apikey api_key access_key auth bearer credential credentials pin passphrase".split()
ACCOUNT_WORDS = "iban account konto kontonummer compte cuenta bank acct".split()
COUNTRIES = "AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK".split()
NAME_WORDS = "mr mrs ms dr prof sir madam herr frau monsieur madame mme señor señora named called name contact signed".split()
TITLES = "Mr Mrs Ms Dr Prof Mme Sr Sra".split()
FIRST_NAMES = "Alice Anna Anne Antonio Carlos Charles Claire Daniel David Elena Emma Eva Francisco Hans Ian Isabel James Jan Jean John José Juan Karl Klaus Laura Linda Lucia Luis Maria Marie Mark Martin Mary Michael Miguel Paul Peter Pierre Robert Sarah Sophie Susan Thomas".split()
MIN_POSTERIOR = 0.5
#: Buckets that the word before a candidate is hashed into.
CONTEXTS = 64


@dataclass(frozen=True)
class LearntKind:
    """A kind found by weak supervision: its candidates, what of a candidate is the span, and its labelers.

    A labeler maps (whole candidate, span, lower-case word before it) to (for, against) conditions and
    abstains where neither holds.
    """

    pattern: str
    span: str
    may: str
    labelers: dict


def _mod97(span: Column) -> Column:
    """Remainder of an account number modulo 97, its first four characters moved to the end and letters read as 10 to 35."""
    flat = F.regexp_replace(span, " ", "")
    turned = F.concat(F.substring(flat, 5, 1 << 20), F.substring(flat, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97))


def _share(span: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(span, f"[^{kept}]", "")) / F.length(span)


LEARNT = {
    "secret": LearntKind(
        SECRET,
        "([A-Za-z0-9]+)$",
        "[0-9]",
        {
            "prefix": lambda hit, span, before: (span.rlike("^(AKIA|ASIA|ghp|xoxb|sk)[A-Za-z0-9]{12,}$"), F.lit(False)),
            "hex": lambda hit, span, before: (span.rlike("^[0-9a-f]+$"), span.rlike("[g-z]")),
            "gazetteer": lambda hit, span, before: (before.isin(*SECRET_WORDS), before != ""),
            "assignment": lambda hit, span, before: (hit.rlike("[=:] ?[\"']?[A-Za-z0-9]+$"), F.length(before) == 0),
            "mix": lambda hit, span, before: (_share(span, "0-9").between(0.15, 0.9), _share(span, "0-9") < 0.1),
        },
    ),
    "account": LearntKind(
        ACCOUNT,
        "((?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)$",
        "[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}",
        {
            "checksum": lambda hit, span, before: (_mod97(span) == 1, _mod97(span) != 1),
            "country": lambda hit, span, before: (F.substring(span, 1, 2).isin(*COUNTRIES), ~F.substring(span, 1, 2).isin(*COUNTRIES)),
            "gazetteer": lambda hit, span, before: (before.isin(*ACCOUNT_WORDS), F.lit(False)),
            "mix": lambda hit, span, before: (_share(span, "0-9") > 0.6, _share(span, "0-9") < 0.3),
        },
    ),
    "name": LearntKind(
        NAME,
        r"((?<![\p{L}\p{N}])\p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++){1,2})$",
        r"\p{Lu}\p{Ll}++ \p{Lu}\p{Ll}",
        {
            "gazetteer": lambda hit, span, before: (F.substring_index(span, " ", 1).isin(*FIRST_NAMES), F.lit(False)),
            "context": lambda hit, span, before: (before.isin(*NAME_WORDS), before == ""),
            "title": lambda hit, span, before: (hit.rlike("^(" + "|".join(TITLES) + r")\. "), F.lit(False)),
        },
    ),
}


def running(items: Column, first: Column, step, block: int = 256) -> Column:
    """Exclusive running values of an int array under an associative step, block by block, so that the work is not quadratic in its size."""

    def run(part, start):
        return F.slice(F.aggregate(part, F.array(start), lambda acc, x: F.array_append(acc, step(F.element_at(acc, -1), x))), F.lit(1), F.size(part))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / block).cast("int")), lambda b: F.slice(items, b * block + 1, F.lit(block)))
    totals = F.transform(blocks, lambda b: F.aggregate(b, first, step))
    return F.when(F.size(items) == 0, F.array().cast("array<int>")).otherwise(F.flatten(F.zip_with(blocks, run(totals, first), run)))


def span_array(hits: Column, gaps: Column) -> Column:
    """array<struct<start, end, hit>> of matches, from the matches and what lies between them."""
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))
    ends = F.zip_with(running(steps, F.lit(0), lambda acc, x: acc + x), steps, lambda s, x: s + x)
    return F.zip_with(ends, hits, lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("hit")))


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Does a digit string pass the Luhn test?"""
    value = lambda i: F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
    doubled = lambda i: value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0)
    terms = F.transform(F.sequence(F.lit(0), F.length(number) - 1), lambda i: F.when(i % 2 == 1, doubled(i)).otherwise(value(i)))
    return F.aggregate(terms, F.lit(0), lambda acc, x: acc + x) % 10 == 0


def passes(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        n = digits(hit)
        return F.when(F.length(n).between(16, 19), luhn(n)).otherwise(False)
    if kind == "phone":
        return F.length(digits(hit)).between(8, 15)
    return F.lit(True)


def _test(kind: str):
    return lambda s: passes(kind, s["hit"])


def _line(kind: str):
    return lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))


def _ranked(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(f"[{kind.upper()}]").alias("mark"))


def span_of(kind: LearntKind, hit: Column) -> Column:
    return F.regexp_extract(hit, kind.span, 1)


def candidate_votes(kind: LearntKind, hit: Column) -> Column:
    """One digit per labeler: 0 against, 1 abstains, 2 for."""
    span = span_of(kind, hit)
    before = _word_before(hit, span)
    return F.concat(*(F.when(yes, "2").when(no, "0").otherwise("1") for yes, no in (labeler(hit, span, before) for labeler in kind.labelers.values())))


def _word_before(hit: Column, span: Column) -> Column:
    """The lower-case word or identifier in what a candidate has before its span; empty where there is none."""
    return F.lower(F.regexp_extract(F.substring(hit, F.lit(1), F.length(hit) - F.length(span)), r"([\p{L}_]+)", 1))


def span_features(kind: LearntKind, hit: Column) -> Column:
    """Names of the features that a candidate has: of the span its length, digits, letters, variety and beginning, and of the context the word and sign before it."""
    span = span_of(kind, hit)
    before, n = _word_before(hit, span), F.length(span)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.substring(span, 1, 3), r"\p{Lu}", "A"), r"\p{Ll}", "a"), "[0-9]", "0")
    named = lambda name, value: F.concat(F.lit(name + "="), value.cast("string"))
    return F.array(
        named("length", F.least(F.floor(F.log2(n)), F.lit(8))),
        named("digits", F.floor(_share(span, "0-9") * 3.999)),
        named("capitals", F.floor(_share(span, r"\p{Lu}") * 3.999)),
        named("variety", F.floor(F.size(F.array_distinct(F.split(span, ""))) / n * 3.999)),
        named("shape", shape),
        named("sign", F.regexp_extract(F.substring(hit, F.lit(1), F.length(hit) - n), r"([=:.]) ?[\"']?$", 1)),
        named("word", F.when(before == "", F.lit(-1)).otherwise(F.pmod(F.xxhash64(before), F.lit(CONTEXTS)))),
    )


def aggregate_votes(counts: dict, rounds: int = 50) -> dict:
    """{votes: probability} from counts by vote pattern, as candidate_votes() writes them.

    Expectation-maximisation of the two-class model in which labelers vote independently given the
    class, each with a reliability of its own; started from the majority vote.
    """
    if not counts:
        return {}
    n, total = len(next(iter(counts))), sum(counts.values())
    post = {p: min(0.95, max(0.05, 0.5 + 0.15 * sum(int(v) - 1 for v in p))) for p in counts}
    for _ in range(rounds):
        mass = [sum(c * (post[p] if k else 1 - post[p]) for p, c in counts.items()) for k in (0, 1)]
        prior = [(m + 1) / (total + 2) for m in mass]
        rate = [[[(sum(c * (post[p] if k else 1 - post[p]) for p, c in counts.items() if p[i] == v) + (2 if v == "2" and k or v == "0" and not k else 0.5)) / (mass[k] + 3) for v in "012"] for i in range(n)] for k in (0, 1)]
        new = {}
        for p in counts:
            score = [math.log(prior[k]) + sum(math.log(rate[k][i][int(p[i])]) for i in range(n)) for k in (0, 1)]
            new[p] = 1 / (1 + math.exp(max(-50.0, min(50.0, score[0] - score[1]))))
        moved = max(abs(new[p] - post[p]) for p in counts)
        post = new
        if moved < 1e-6:
            break
    return post


def learn(docs: DataFrame, text_col: str = "text") -> dict:
    """{kind: {feature: weight}} of the span classifier of each learnt kind, from all candidates in docs.

    The labelers' votes are aggregated to a probability per candidate; a naive Bayes model of span and
    context features, and of the votes, is trained on these: a feature's weight is its log ratio, '' has
    that of the classes.  The driver gets counts by vote pattern, at most 3 to the number of labelers, and
    sums by feature, of which there are a few hundred.  A kind without candidates has no weights. Null
    texts have none; repeated rows count as often as they occur.
    """
    text = F.coalesce(text_col, F.lit(""))
    picked = [F.transform(F.when(text.rlike(k.may), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))), _named(name)) for name, k in LEARNT.items()]
    hits = docs.select(F.explode(F.flatten(F.array(*(F.coalesce(p, F.array().cast("array<struct<kind:string,hit:string>>")) for p in picked)))).alias("c")).select("c.*")
    votes, features = (_by_kind(lambda k, f=f: f(k, F.col("hit"))) for f in (candidate_votes, span_features))
    found = staged(hits.select("kind", votes.alias("votes"), features.alias("features")), "candidates")
    counts: dict = {name: {} for name in LEARNT}
    for r in found.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect():
        counts[r["kind"]][r["votes"]] = r["n"]
    post = {(name, p): x for name, c in counts.items() for p, x in aggregate_votes(c).items()}
    if not post:
        return {}
    sure = F.create_map(*[F.lit(x) for (name, p), v in sorted(post.items()) for x in (f"{name}:{p}", v)])
    own = found.select("kind", sure[F.concat_ws(":", "kind", "votes")].cast("decimal(12,9)").alias("p"), F.concat(F.array(F.lit("")), "features", F.transform(F.split("votes", ""), lambda v, i: F.concat(F.lit("vote"), i.cast("string"), F.lit("="), v))).alias("f"))
    sums = own.select("kind", "p", F.explode("f").alias("f")).groupBy("kind", "f").agg(F.sum("p").cast("double").alias("yes"), F.count("*").alias("n")).collect()
    unstage(found)
    whole = {r["kind"]: (r["yes"], r["n"] - r["yes"]) for r in sums if r["f"] == ""}
    model: dict = {}
    for r in sums:
        yes, no = whole[r["kind"]]
        ratio = math.log((yes + 1) / (no + 1)) if r["f"] == "" else math.log((r["yes"] + 0.5) / (yes + 1)) - math.log((r["n"] - r["yes"] + 0.5) / (no + 1))
        model.setdefault(r["kind"], {})[r["f"]] = ratio
    return model


def _named(name: str):
    return lambda h: F.struct(F.lit(name).alias("kind"), h.alias("hit"))


def _by_kind(of) -> Column:
    out = F.lit(None)
    for name, kind in LEARNT.items():
        out = F.when(F.col("kind") == name, of(kind)).otherwise(out)
    return out


def is_span(kind: LearntKind, weights: dict, hit: Column) -> Column:
    """Does the trained classifier take a candidate for a span? One that no labeler is for is never taken."""
    table = F.create_map(*[F.lit(x) for f, w in sorted(weights.items()) for x in (f, w)])
    votes = candidate_votes(kind, hit)
    names = F.concat(F.array(F.lit("")), span_features(kind, hit), F.transform(F.split(votes, ""), lambda v, i: F.concat(F.lit("vote"), i.cast("string"), F.lit("="), v)))
    score = F.aggregate(names, F.lit(0.0), lambda acc, f: acc + F.coalesce(table[f], F.lit(0.0)))
    return votes.contains("2") & (score >= math.log(MIN_POSTERIOR / (1 - MIN_POSTERIOR)))


def find_spans(docs: DataFrame, model: dict, keys: list, text_col: str = "text") -> DataFrame:
    """(*keys, email, ip, card, phone, secret, account, name): per kind array<struct<start, end, hit>> in code points, end exclusive.

    A null or empty text has no spans. Matches of a kind don't overlap; those of two kinds may. Rows are
    independent: repeated rows and null keys stay as they are.
    """
    text = F.coalesce(text_col, F.lit(""))
    none = F.array().cast("array<string>")
    every = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    learnt = {name: LEARNT[name] for name in LEARNT if model.get(name)}
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE} | {name: k.pattern for name, k in learnt.items()}
    may = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), "phone": text.contains("+")} | {name: text.rlike(k.may) for name, k in learnt.items()}
    hits = docs.select(*keys, text.alias("_text"), *(F.when(may[k], every(p)).otherwise(none).alias(f"_{k}") for k, p in patterns.items()))
    gaps = hits.select("*", *(F.when(F.size(f"_{k}") > 0, F.split("_text", p, -1)).otherwise(none).alias(f"_gaps_{k}") for k, p in patterns.items()))
    empty = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    spans = gaps.select(*keys, *(F.when(F.size(f"_{k}") > 0, span_array(F.col(f"_{k}"), F.col(f"_gaps_{k}"))).otherwise(empty).alias(k) for k in patterns))
    return spans.select(*keys, *(F.filter(k, _test(k)).alias(k) for k in BASE), *((_accepted(name, k, model[name]) if (k := learnt.get(name)) else empty).alias(name) for name in LEARNT))


def _accepted(name: str, kind: LearntKind, weights: dict) -> Column:
    own = F.filter(name, lambda s: is_span(kind, weights, s["hit"]))
    return F.transform(own, lambda s: F.struct((s["end"] - F.length(span_of(kind, s["hit"]))).alias("start"), s["end"].alias("end"), span_of(kind, s["hit"]).alias("hit")))


def listed(kinds) -> Column:
    """kind:start:end of each span, by kind as given, then start; comma-joined."""
    return F.concat_ws(",", F.flatten(F.array(*(F.transform(k, _line(k)) for k in kinds))))


def redact(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; other columns stay, whatever their names.

    Spans that overlap are replaced together, by the kind of the first to start, of those the longest.
    """
    kinds = (*BASE, *LEARNT)
    columns = docs.columns
    found = find_spans(docs.select(F.struct(*columns).alias("_row"), F.col(text_col).alias("_own")), model, ["_row"], "_own")
    every = F.array_sort(F.flatten(F.array(*(F.transform(k, _ranked(k)) for k in kinds))))
    text = F.col("_row")[text_col]
    found = found.select("_row", every.alias("_all"))
    # Where all spans before one end; a span that starts there or later begins a new gap.
    reach = found.withColumn("_before", running(F.transform("_all", lambda s: -s["back"]), F.lit(0), lambda acc, x: F.greatest(acc, x)))
    heads = F.filter(F.zip_with("_all", "_before", lambda s, b: F.struct(s["start"].alias("start"), b.alias("before"), s["mark"].alias("mark"))), lambda h: h["start"] >= h["before"])
    cut = reach.select("_row", heads.alias("_heads"), F.array_max(F.transform("_all", lambda s: -s["back"])).alias("_end"), F.when(F.size("_all") > 0, F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))).alias("_chars"))
    kept = lambda start, n: F.array_join(F.slice("_chars", start + 1, n), "")
    pieces = F.transform("_heads", lambda h: F.concat(kept(h["before"], h["start"] - h["before"]), h["mark"]))
    new = F.when(F.size("_heads") > 0, F.concat(F.array_join(pieces, ""), kept(F.col("_end"), F.size("_chars") - F.col("_end")))).otherwise(text)
    return cut.select(*(new.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in columns))


def op6_pii(spark, sf_dir):
    """Counts and places of personal data in each document; a null or empty text has none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_spans(docs, learn(docs), ["doc_id"])
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(listed(BASE), 256).alias("base_sha256"),
        listed((*BASE, *LEARNT)).alias("spans"),
    )
