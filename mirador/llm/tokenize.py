"""Problem 8: encoding a corpus with a public byte-level BPE vocabulary.

Method: prefix-sharing trie traversal. The distinct words of an Arrow batch are put in byte order, which is the order in
which a depth-first walk visits the trie of these words; a stack holds, for every byte of the current path, the last
token of the encoding of the path up to there. A word shares the stack of the prefix that it has in common with the
word before, so encodings of shared prefixes are computed once. The tokens of a word are read off its path backwards.

The last token of a path is the one token that (a) is a suffix of the path and (b) is *compatible* with the last token
of the rest: byte-pair encoding of the two tokens' bytes gives just these two. This holds for one suffix only, and makes
the work linear in the bytes of a word however long it is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The pattern by which this family of vocabularies splits text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Pieces that a worker remembers, and the characters up to which it does. Beyond it forgets all: a cache, not a limit.
REMEMBER, REMEMBER_CHARS = 500_000, 64
#: Pairs of tokens of which a worker remembers whether they are compatible, likewise.
REMEMBER_PAIRS = 2_000_000


def printable_bytes() -> dict[str, int]:
    """The reversible map of byte-level vocabularies: printable bytes stand for themselves, others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class TrieEncoder:
    """Encodes sets of words by a depth-first walk over their trie. Instances live in one Python worker."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        to_byte = printable_bytes()
        raw = lambda s: bytes(to_byte[c] for c in s)
        ids = model["vocab"]
        self.token = {raw(s): i for s, i in ids.items() if all(c in to_byte for c in s)}
        self.longest = max(map(len, self.token))
        self.merged: dict[tuple[int, int], int] = {}  # rank of the merge, by pair
        self.parts: dict[int, tuple[int, int, int]] = {}  # rank, left and right token of the merge that makes a token
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = ids[a], ids[b], ids[a + b]
            self.merged.setdefault((left, right), rank)
            self.parts.setdefault(whole, (rank, left, right))
        self.pairs: dict[int, bool] = {}
        self.words = regex.compile(PATTERN)
        self.blank_then_space = regex.compile(r" \s")
        self.known: dict[str, tuple[int, ...]] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging never crosses the border between tokens ``a`` and ``b``.

        The merges that built both tokens are undone from the latest to the earliest. Two parts that touch at the border
        would have been merged across it if their pair has an earlier rank than the merge that consumed either.
        """
        if (known := self.pairs.get(key := a << 20 | b)) is not None:
            return known
        merged, parts, left, right, before, ok = self.merged, self.parts, a, b, 1 << 30, True
        while True:
            # A pair across the border merges first if its rank is lower than that of the merge undone last. At equal
            # ranks (the same pair overlapping itself) the leftmost goes first: the left token's merge is the earlier.
            rank = merged.get((left, right))
            if rank is not None and rank < before:
                ok = False
                break
            x, y = parts.get(left), parts.get(right)
            if x is None and y is None:
                break
            if y is None or x is not None and x[0] > y[0]:
                before, left = x[0], x[2]
            else:
                before, right = y[0] + 1, y[1]
        if len(self.pairs) >= REMEMBER_PAIRS:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def encode_sorted(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each of ``words``, which are distinct and in byte order (the trie's depth-first order)."""
        token, longest, compatible, found = self.token, self.longest, self.compatible, []
        last: list[int] = []  # last token of the path, per byte
        size: list[int] = []  # and that token's bytes
        before = b""
        for w in words:
            n, common = len(w), 0
            for common in range(min(n, len(before)) + 1):
                if common == min(n, len(before)) or w[common] != before[common]:
                    break
            del last[common:], size[common:]
            for end in range(common + 1, n + 1):
                for start in range(max(0, end - longest), end):
                    t = token.get(w[start:end])
                    if t is not None and (not start or compatible(last[start - 1], t)):
                        last.append(t)
                        size.append(end - start)
                        break
            at, ids = n, []
            while at:
                ids.append(last[at - 1])
                at -= size[at - 1]
            found.append(tuple(ids[::-1]))
            before = w
        return found

    def learn(self, pieces: set[str]) -> dict[str, tuple[int, ...]]:
        """Encodings of ``pieces`` of text (each of one or more words)."""
        split = {p: self.words.findall(p) for p in pieces}
        raw = {w: w.encode("utf-8", "surrogatepass") for w in set(chain.from_iterable(split.values()))}
        order = sorted(set(raw.values()))
        ids = dict(zip(order, self.encode_sorted(order)))
        return {p: tuple(chain.from_iterable(ids[raw[w]] for w in ws)) if len(ws) != 1 else ids[raw[ws[0]]] for p, ws in split.items()}

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of ``texts``. Null and empty texts have no ids.

        A blank followed by anything but white space always begins a word of the pattern, so a text where this holds for
        each blank can be cut at blanks; pieces repeat a lot and are looked up. Other texts are one piece.
        """
        cut = []
        for t in texts:
            if not t:
                cut.append(())
            elif self.blank_then_space.search(t):
                cut.append((t,))
            else:
                head, *tail = t.split(" ")
                cut.append(([head] if head else []) + [" " + x for x in tail])
        known = self.known
        new = set(chain.from_iterable(cut)).difference(known)
        here = self.learn(new) if new else {}
        if len(known) + len(here) > REMEMBER:
            kept = {p: known[p] for p in set(chain.from_iterable(cut)) if p in known}
            known.clear()
            known |= kept
        known |= here
        each = [[known[p] for p in c] for c in cut]
        counts = np.fromiter((sum(map(len, e)) for e in each), np.int64, len(each))
        ids = np.fromiter(chain.from_iterable(chain.from_iterable(each)), np.int32, int(counts.sum()))
        for p in here:
            if len(p) > REMEMBER_CHARS:
                del known[p]
        return np.concatenate([[0], np.cumsum(counts)]), ids


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """The worker's encoder for the vocabulary at ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(``key``, ``ids``): the token ids of each row's text, without special tokens; one row out for each row in.

    Null and empty texts have the empty list. Text that spells a special token is ordinary text. Repeated rows and keys
    stay as they are; other columns are not read. No shuffle: each Arrow batch is encoded where it is read, and a hot
    source or document only makes a longer batch. The driver reads ``vocabulary`` and sends it to the executors as a file.
    """
    import os

    from pyspark import SparkFiles

    name = os.path.basename(vocabulary)
    docs.sparkSession.sparkContext.addFile(vocabulary)
    kind = docs.schema[key].dataType.simpleString()
    narrow = docs.select(key, text)
    at_key, at_text = 0, 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name))
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                offsets, ids = enc.encode_batch(part.column(at_text).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(at_key), lists], names=["k", "ids"])

    return narrow.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)
