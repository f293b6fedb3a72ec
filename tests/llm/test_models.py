"""Kernel, hinge model, fingerprints and compressed sizes against plain versions."""

import random
from itertools import combinations

import numpy as np

from touchline.llm import langid, linear, minhash, toxicity


def subsequences(text):
    out = {}
    n = min(3, len(text))
    for at in combinations(range(len(text)), n):
        if at[-1] - at[0] <= toxicity.SPREAD:
            key = "".join(text[i] for i in at)
            out[key] = out.get(key, 0.0) + toxicity.DECAY ** (at[-1] - at[0])
    return out


def plain_kernel(a, b):
    f, g = subsequences(a), subsequences(b)
    dot = lambda p, q: sum(v * q.get(k, 0.0) for k, v in p.items())
    return dot(f, g) / (dot(f, f) * dot(g, g)) ** 0.5


def test_kernel_is_the_plain_sum():
    landmarks = ["^idiot", "^scum", "^no"]
    units = ["^student", "^idiot", "^i.diot", "^ixdxixot", "^aabbaabbaa", "^zzzzqqqq", "^s", "^日本語日本", "^scuum"]
    got = toxicity.SubsequenceKernel(landmarks)(units)
    want = [[plain_kernel(u, x) for x in landmarks] for u in units]
    assert np.allclose(got, want, atol=1e-5)


def test_kernel_of_long_units_takes_the_greatest_part():
    unit = "^" + "q" * 30 + "idiot" + "q" * 20
    got = toxicity.SubsequenceKernel(["^idiot"])([unit])[0, 0]
    step = toxicity.UNIT_CHARS // 2
    want = max(plain_kernel(unit[k : k + toxicity.UNIT_CHARS], "^idiot") for k in range(0, len(unit) - step, step))
    assert abs(got - want) < 1e-5


def test_hinge_model_is_at_its_optimum():
    """No dual variable can be moved to gain: the conditions of the optimum hold for every example."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 6))
    y = (x[:, 0] + 0.5 * rng.normal(size=120) > 0).astype(int)
    index = np.arange(6)
    w, b = linear.fit_hinge([index] * 120, list(x), y, 6, 0.7, epochs=4_000)
    sign = np.where(y > 0, 1.0, -1.0)
    loss = lambda v, c: 0.5 * (v @ v + c * c) + 0.7 * np.maximum(0, 1 - sign * (x @ v + c)).sum()
    best = loss(w, b)
    for _ in range(300):
        d = rng.normal(size=7) * 10.0 ** -rng.integers(1, 5)
        assert loss(w + d[:6], b + d[6]) >= best - 2e-3 * best


def plain_fingerprint(text, make):
    """Bins, densification and packing, one shingle and one bin at a time."""
    mask, bins, width = (1 << 64) - 1, make.bins, make.bins.bit_length() - 1
    least = {}
    for h in make.shingles(text).tolist():
        at, value = h >> (64 - width), (h << width) & mask
        least[at] = min(least.get(at, mask), value)
    if not least:
        return b""
    full = dict(least)
    for at in range(bins):
        if at not in least:
            for tries in make.tries:
                if int(tries[at]) in least:
                    full[at] = least[int(tries[at])]
                    break
            else:
                full[at] = least[min((b for b in least if b >= at), default=min(least))]

    def mixed(v):
        v ^= v >> 33
        v = v * 0xFF51AFD7ED558CCD & mask
        v ^= v >> 33
        v = v * 0xC4CEB9FE1A85EC53 & mask
        return (v ^ v >> 33) & 15

    low = [mixed(full[at]) for at in range(bins)]
    return bytes(a | b << 4 for a, b in zip(low[::2], low[1::2]))


def test_fingerprint_against_a_plain_version():
    make, rnd = minhash.OnePermutation(), random.Random(6)
    for n in (0, 1, 4, 5, 6, 30, 200, 900, 4_000):
        text = " ".join(f"w{rnd.randrange(3_000)}" for _ in range(n))
        assert make(text) == plain_fingerprint(text, make), n


def test_sizes_are_those_of_the_library():
    import zstandard as z

    rnd = random.Random(8)
    dictionaries = {n: " ".join(rnd.choices(words, k=3_000)).encode() for n, words in (("aa", ["one", "two", "three"]), ("bb", ["uno", "dos", "tres"]))}
    text = " ".join(rnd.choices(["one", "dos", "three"], k=900))
    data = langid.plain(text)
    want = []
    for d in dictionaries.values():
        c = z.ZstdCompressor(level=langid.LEVEL, dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)
        want.append(sum(len(c.compress(data[i : i + langid.PIECE_BYTES])) for i in range(0, len(data), langid.PIECE_BYTES)))
    got = langid.CompressionClassifier(dictionaries).sizes(text)
    assert all(abs(a - b) <= 0.05 * b for a, b in zip(got, want)) and (got[0] < got[1]) == (want[0] < want[1])
