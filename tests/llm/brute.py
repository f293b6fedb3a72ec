"""Plain versions of the operators, one text or one pair at a time, to hold the Spark ones against."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


def simhash(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows):
    """rows: (doc_id, fingerprint); {doc_id: least doc_id reachable over links of 2 or fewer bits}."""
    top = {d: d for d, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, (a, f) in enumerate(rows):
        for b, g in rows[:i]:
            if (f ^ g).bit_count() <= 2:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {d: find(d) for d in top}


def without_repeats(texts, window=35):
    """(n_words, n_removed, kept) per text."""
    split = [WORDS.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    """(kind, start, end) of the fixed kinds, by kind, then start."""
    only = lambda s: re.sub("[^0-9]", "", s)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(only(s)) <= 19 and luhn(only(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(only(s)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text or "") if ok(m[0])]


def spelled(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def auc(scores, labels):
    good = [s for s, y in zip(scores, labels) if y]
    bad = [s for s, y in zip(scores, labels) if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def _learnt_candidates(text):
    """(kind, whole candidate, span, its start, word before) of each candidate of the learnt kinds."""
    import regex

    from touchline.llm import pii

    inner = {"secret": r"[A-Za-z0-9]+$", "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?$", "name": r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++){1,2}$"}
    for kind, pattern in (("secret", pii.SECRET), ("account", pii.ACCOUNT), ("name", pii.NAME)):
        for m in regex.finditer(pattern, text):
            at = regex.search(inner[kind], m[0]).start()
            word = regex.search(r"[\p{L}_]+", m[0][:at])
            yield kind, m[0], m[0][at:], m.start() + at, word[0].lower() if word else ""


def _learnt_votes(kind, hit, span, before):
    from touchline.llm import pii

    digits = sum(c in "0123456789" for c in span) / len(span)
    if kind == "secret":
        own = (
            (re.search("^(AKIA|ASIA|ghp|xoxb|sk)[A-Za-z0-9]{12,}$", span), False), (re.search("^[0-9a-f]+$", span), re.search("[g-z]", span)), (before in pii.SECRET_WORDS, before != ""),
            (re.search("[=:] ?[\"']?[A-Za-z0-9]+$", hit), before == ""), (0.15 <= digits <= 0.9, digits < 0.1),
        )
    elif kind == "account":
        flat = span.replace(" ", "")
        sound = int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
        known = span[:2] in pii.COUNTRIES
        own = ((sound, not sound), (known, not known), (before in pii.ACCOUNT_WORDS, False), (digits > 0.6, digits < 0.3))
    else:
        own = ((span.split(" ")[0] in pii.FIRST_NAMES, False), (before in pii.NAME_WORDS, before == ""), (hit.split(".")[0] in pii.TITLES and ". " in hit, False))
    return "".join("2" if yes else "0" if no else "1" for yes, no in own)


def _learnt_features(hit, span, before, word_bucket):
    import math

    import regex

    share = lambda p: math.floor(len(regex.findall(p, span)) / len(span) * 3.999)
    shape = "".join("A" if regex.match(r"\p{Lu}", c) else "a" if regex.match(r"\p{Ll}", c) else "0" if c in "0123456789" else c for c in span[:3])
    sign = re.search("([=:.]) ?[\"']?$", hit[: len(hit) - len(span)])
    return (min(math.floor(math.log2(len(span))), 8), share("[0-9]"), share(r"\p{Lu}"), math.floor(len(set(span)) / len(span) * 3.999), shape, sign[1] if sign else "", word_bucket[before] if before else -1)


def learnt_spans(texts, word_bucket, rounds=50):
    """Spans of the learnt kinds in each text; word_bucket maps a word to its bucket."""
    import math
    from collections import defaultdict

    rows = [[(k, h, s, at, b, _learnt_votes(k, h, s, b), _learnt_features(h, s, b, word_bucket)) for k, h, s, at, b in _learnt_candidates(t or "")] for t in texts]
    flat = [c for r in rows for c in r]
    weight = {}
    for kind in {c[0] for c in flat}:
        votes = [c[5] for c in flat if c[0] == kind]
        good = [min(0.95, max(0.05, 0.5 + 0.15 * sum(int(v) - 1 for v in p))) for p in votes]
        for _ in range(rounds):
            side = lambda k, g=tuple(good): [x if k else 1 - x for x in g]
            odds = [0.0] * len(votes)
            for k, sign in ((1, 1), (0, -1)):
                w = side(k)
                total = sum(w)
                odds = [o + sign * math.log((total + 1) / (len(votes) + 2)) for o in odds]
                for i in range(len(votes[0])):
                    held = {v: sum(x for x, p in zip(w, votes) if p[i] == v) for v in "012"}
                    bonus = {v: 2 if (v == "2" and k) or (v == "0" and not k) else 0.5 for v in "012"}
                    odds = [o + sign * math.log((held[p[i]] + bonus[p[i]]) / (total + 3)) for o, p in zip(odds, votes)]
            new = [1 / (1 + math.exp(-max(-50, min(50, o)))) for o in odds]
            moved = max(abs(a - b) for a, b in zip(new, good))
            good = new
            if moved < 1e-6:
                break
        yes, no = defaultdict(float), defaultdict(float)
        own = [c for c in flat if c[0] == kind]
        for c, g in zip(own, good):
            for f in [*enumerate(c[6]), *(("v", i, v) for i, v in enumerate(c[5]))]:
                yes[f] += g
                no[f] += 1 - g
        p, q = sum(good), len(good) - sum(good)
        weight[kind] = (math.log((p + 1) / (q + 1)), {f: math.log((yes[f] + 0.5) / (p + 1)) - math.log((no[f] + 0.5) / (q + 1)) for f in yes})
    out = []
    for r in rows:
        spans = []
        for k, _, s, at, _, votes, features in r:
            base, of = weight[k]
            if "2" in votes and base + sum(of[f] for f in [*enumerate(features), *(("v", i, v) for i, v in enumerate(votes))]) >= 0:
                spans.append((k, at, at + len(s)))
        out.append(sorted(spans, key=lambda x: (("secret", "account", "name").index(x[0]), x[1])))
    return out


def redacted(text, spans):
    """Overlapping spans are replaced together, by the kind of the first to start, of those the longest."""
    out, at = "", 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]
