"""BPE encoding and decoding over a trie of distinct words.

A byte-pair encoding is characterised by its neighbours: a token sequence is the encoding of its
bytes exactly if each adjacent pair is one that the merge rules would leave alone.  So the last
token of a prefix is the one token ending there whose predecessor, the last token of what is before
it, is compatible with it.  A depth-first walk of the trie computes that last token once per node,
for all words that share the prefix; a word's encoding is read off by following last tokens back.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import sys
import unicodedata
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import table, text_blocks

#: Of the byte-level alphabet: bytes that stand for themselves; the others follow from code point 256.
PRINTABLE = (*range(33, 127), *range(161, 173), *range(174, 256))
ASCII_SPACE = re.compile(r"[\x20\x09-\x0D]+").split


def byte_alphabet() -> list[str]:
    """The character that stands for each byte."""
    others = iter(range(256, 512))
    return [chr(b) if b in PRINTABLE else chr(next(others)) for b in range(256)]


class Memo:
    """Encodings by string in two generations under one byte budget: what is used lives on, the rest goes."""

    #: What an entry takes beside its key and value: a slot of the table and the objects' headers.
    ENTRY = 130

    def __init__(self, budget: int):
        self.half, self.held, self.young, self.old = budget // 2, 0, {}, {}

    def get(self, key: str) -> bytes | None:
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key: str, value: bytes) -> None:
        self.young[key] = value
        self.held += self.ENTRY + len(key) + len(value)
        if self.held > self.half:
            self.old, self.young, self.held = self.young, {}, 0


class TrieBPE:
    """Encoder and decoder of one tokenizer file (BPE, byte-level alphabet, word-end suffix).

    What it holds is bounded: the automaton by the vocabulary, what it remembers by MEMO_BYTES,
    PAIRS and JUMPS.  Strings of more than MEMO_CHARS characters are encoded and not remembered.
    """

    #: Bytes that the remembered encodings of words and chunks may take, and the longest remembered one.
    MEMO_BYTES, MEMO_CHARS = 80_000_000, 64
    #: Most remembered token pairs, and transitions found by fallback; both are forgotten or left out beyond.
    PAIRS, JUMPS = 150_000, 200_000

    def __init__(self, spec: str):
        import regex
        from tokenizers import Tokenizer

        spec = json.loads(spec)
        model, special = spec["model"], spec.get("added_tokens", ())
        # The normaliser and splitter of the file, without its vocabulary.
        rules = Tokenizer.from_str(json.dumps(spec | {"model": model | {"vocab": {}, "merges": []}, "added_tokens": []}))
        self.normalise, self.presplit = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        size = 1 + max([*vocab.values(), *(t["id"] for t in special)])
        #: Of a pair of tokens (left << 20 | right) the rank of its rule; of a built token its parts and their rank.
        self.rank: dict = {}
        self.left, self.right, self.built = (array("i", [-1]) * size for _ in range(3))
        for at, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, ab = vocab[left], vocab[right], vocab[left + right]
            if (a << 20 | b) not in self.rank:
                self.rank[a << 20 | b] = at
                if self.built[ab] < 0:
                    self.left[ab], self.right[ab], self.built[ab] = a, b, at
        strings = [None] * size
        for token, i in vocab.items():
            strings[i] = token
        for t in special:
            strings[t["id"]] = t["content"]
        self.strings = pa.array(strings, pa.string())
        alphabet = byte_alphabet()
        self.byte = dict(zip(alphabet, range(256)))
        self._automaton(vocab)
        self.special = {t["content"]: t["id"].to_bytes(4, sys.byteorder) for t in special}
        #: What the file's pre-tokenizer keeps, and text in which Python's character classes agree with it.
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.plain = regex.compile(r"[\x20-\u024F\t\n\r\u2010-\u2027\u20AC]*+").fullmatch
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.pair_ok: dict = {}
        self.word_memo, self.chunk_memo = Memo(self.MEMO_BYTES // 2), Memo(self.MEMO_BYTES // 2)

    def _automaton(self, vocab: dict) -> None:
        """Suffix automaton of the tokens that merges build: transitions by state << 9 | symbol, per state its
        fallback and the (token, length) of those that end there, longest first. A final symbol is its byte + 256."""
        goto, ends, into = {}, [None], [(0, 0)]
        for token, i in vocab.items():
            final = bool(self.suffix) and token.endswith(self.suffix) and token != self.suffix
            body = token[: -len(self.suffix)] if final else token
            if not body or any(c not in self.byte for c in body) or (len(body) > 1 and self.built[i] < 0):
                continue
            state = 0
            for n, c in enumerate(body, 1):
                symbol = self.byte[c] + 256 * (final and n == len(body))
                to = goto.get(state << 9 | symbol)
                if to is None:
                    to = goto[state << 9 | symbol] = len(ends)
                    ends.append(None)
                    into.append((state, symbol))
                state = to
            ends[state] = (i, len(body))
        depth = array("i", [0]) * len(ends)
        for state in range(1, len(ends)):  # a state comes after the one that leads to it
            depth[state] = depth[into[state][0]] + 1
        back, found = array("i", [0]) * len(ends), [()] * len(ends)
        for state in sorted(range(1, len(ends)), key=depth.__getitem__):
            before, symbol = into[state]
            at = back[before]
            while at and (at << 9 | symbol) not in goto:
                at = back[at]
            if before:
                back[state] = goto.get(at << 9 | symbol, 0)
            found[state] = ((ends[state],) if ends[state] else ()) + found[back[state]]
        self.goto, self.back, self.found, self.jumps = goto, back, found, len(goto) + self.JUMPS

    def _step(self, state: int, symbol: int) -> int:
        """Next automaton state by fallback; remembered as a transition as long as there is room."""
        goto, at = self.goto, state
        while (at << 9 | symbol) not in goto and at:
            at = self.back[at]
        to = goto.get(at << 9 | symbol, 0)
        if len(goto) < self.jumps:
            goto[state << 9 | symbol] = to
        return to

    def _compatible(self, a: int, b: int) -> bool:
        """Undo the merges of both tokens from the latest back; a rule across the boundary that
        comes before the merge just undone would have run first.  At one rank the leftmost place merges first."""
        limit, limit_left = float("inf"), True
        while True:
            rule = self.rank.get(a << 20 | b, -1)
            if rule >= 0 and (rule < limit or (rule == limit and limit_left)):
                return False
            left, right = self.built[a], self.built[b]
            if left < 0 and right < 0:
                return True
            # The boundary symbols change by the later of the two merges.
            if left > right:
                a, limit, limit_left = self.right[a], left, False
            else:
                b, limit, limit_left = self.left[b], right, True

    def learn(self, words) -> dict:
        """{word: packed ids} of distinct words, by one depth-first walk of their trie.

        The sorted words are the trie in depth-first order: what a word shares with the one before
        it is the path that stays, and its states are kept; only the new nodes are computed.
        """
        goto, step, found, pair_ok, out = self.goto, self._step, self.found, self.pair_ok, {}
        if len(pair_ok) > self.PAIRS:
            pair_ok.clear()
        final = 256 * bool(self.suffix)
        states, ends, before = [0], [(-1, 0)], b""  # per depth: automaton state; last token and its length
        for data, word in sorted([(w.encode("utf-8"), w) for w in words]):
            size = len(data)
            shared, most = 0, min(len(before), size) - 1
            while shared < most and before[shared] == data[shared]:
                shared += 1
            del states[shared + 1 :], ends[shared + 1 :]
            state = states[shared]
            for depth in range(shared + 1, size + 1):
                symbol = data[depth - 1] + final * (depth == size)
                to = goto.get(state << 9 | symbol)
                state = step(state, symbol) if to is None else to
                for end in found[state]:
                    left = ends[depth - end[1]][0]
                    if left == -1:
                        if end[1] == depth:
                            break
                    elif left >= 0:
                        pair = left << 20 | end[0]
                        ok = pair_ok.get(pair)
                        if ok is None:
                            ok = pair_ok[pair] = self._compatible(left, end[0])
                        if ok:
                            break
                else:
                    end = (-2, 0)  # only inside a character's bytes: no word ends here
                states.append(state)
                ends.append(end)
            ids, at = array("i"), size
            while at > 0:
                token, length = ends[at]
                ids.append(token)
                at -= length
            ids.reverse()
            out[word] = ids.tobytes()
            before = data
        return out

    def pieces(self, text: str) -> list:
        """The words of a piece of text after normalisation."""
        low = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower() if self.plain(text) else None
        if low is not None:
            return [low] if low.isalpha() else self.words(low)
        # Character classes differ between Unicode versions: here the file's own splitter decides.
        byte = self.byte
        return [bytes([byte[c] for c in w]).decode("utf-8") for w, _ in self.presplit(self.normalise(text))]

    def chunked(self, text: str) -> list:
        """Text cut where no word can span: at ASCII white space, and at special tokens, which stay as their packed ids."""
        out: list = []
        for part in self.special_split(text) if self.special_split and "<|" in text else [text]:
            if part in self.special:
                out.append(self.special[part])
            else:
                out += part.split() if self.plain(part) else [c for c in ASCII_SPACE(part) if c]
        return out

    def encode_block(self, texts: list) -> list:
        """Packed ids of each text."""
        split = [self.chunked(t) if t else [] for t in texts]
        ids, fresh, pieces, known = {}, [], {}, {}
        for c in set(chain.from_iterable(split)):
            packed = c if type(c) is bytes else self.chunk_memo.get(c)
            if packed is None:
                fresh.append(c)
            else:
                ids[c] = packed
        unknown = set()
        for c in fresh:
            pieces[c] = self.pieces(c)
            for w in pieces[c]:
                if w not in known and w not in unknown:
                    packed = self.word_memo.get(w)
                    if packed is None:
                        unknown.add(w)
                    else:
                        known[w] = packed
        learnt = self.learn(unknown)
        for w, packed in learnt.items():
            if len(w) <= self.MEMO_CHARS:
                self.word_memo.put(w, packed)
        known |= learnt
        for c, words in pieces.items():
            ids[c] = known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words])
            if len(c) <= self.MEMO_CHARS:
                self.chunk_memo.put(c, ids[c])
        return [b"".join([ids[c] for c in chunks]) for chunks in split]

    def encode(self, text: str | None) -> list:
        return np.frombuffer(self.encode_block([text])[0], np.int32).tolist()

    def decode_lists(self, ids: pa.ListArray) -> pa.Array:
        """As a decoder-less tokenizer file decodes: the tokens' own strings joined by one space; unknown ids are left out."""
        flat = ids.values
        known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(self.strings)))
        strings = self.strings.take(pc.if_else(known, flat, pa.scalar(None, pa.int32())))
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, pc.fill_null(strings, "")), " ") if not strings.null_count else pa.array([" ".join([t for t in row if t is not None]) for row in pa.ListArray.from_arrays(ids.offsets, strings).to_pylist()], pa.string())

    def decode(self, ids: list) -> str:
        return self.decode_lists(pa.array([ids], pa.list_(pa.int32())))[0].as_py()


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """(doc_id, ids array<int>, decoded, *keep) of whole texts; a null or empty text has no ids and decodes to nothing.

    decoded comes from the ids. Rows are independent: repeated rows, null ids and any other column stay as they are.

    The tokenizer file is read once on the driver and shipped to the tasks: its size is that of a
    vocabulary, whatever the corpus.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *keep)
    schema = StructType([*picked.drop("_text").schema.fields, *StructType.fromDDL("ids array<int>, decoded string").fields])

    names = schema.names

    def run(batches):
        bpe = shared_encoder(spec.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in text_blocks(texts):
                packed = bpe.encode_block(texts[i:j])
                ids = np.frombuffer(b"".join(packed), np.int32)
                ends = np.cumsum([0] + [len(p) // 4 for p in packed])
                part = batch.slice(i, j - i)
                columns = [part.column(c) for c in range(part.num_columns) if c != 1]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*columns, lists, bpe.decode_lists(lists)], names=names)

    return picked.mapInArrow(run, schema)


_ENCODERS: dict = {}


def shared_encoder(spec: str) -> TrieBPE:
    """One encoder per worker process and tokenizer file."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = TrieBPE(spec)
        gc.freeze()  # the automaton stays as long as the process: collections need not visit it
    return _ENCODERS[key]


def op10_bpe(spark, sf_dir, tokenizer_path: str | None = None):
    """n_tokens and digests of the ids and of what they decode to, for each document; null and empty texts have no ids."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    out = encode(table(spark, sf_dir, "documents"), tokenizer_path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
