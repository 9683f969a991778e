"""BPE encoding and decoding (operator 7) by speculate and verify.

The vocabulary is a byte-level BPE file of the tokenizers library, given by path; nothing is trained.  Words that a
worker has not seen yet are encoded together:
1. speculate: greedy longest match proposes tokens for every word;
2. verify: a token sequence is the BPE encoding exactly if every adjacent pair is compatible, that is, if BPE of the
   two tokens' bytes gives the two tokens again.  All pairs are tested at once with numpy, by following the splits
   of the two tokens from the boundary and looking for a merge across it that would have come first;
3. words with a failing pair, and only these, go through exact merging.
The encodings of words are kept in a bounded cache."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

#: Words kept with their encodings, and the longest of them in bytes.
CACHE_WORDS = 200_000
CACHE_BYTES = 64
#: How byte-level BPE cuts texts into words, a fixed value of the vocabulary; below, the same for Latin-1 texts.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
SPLIT_LATIN = re.compile(rf" ?[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def split_words(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return SPLIT.findall(text)
    return SPLIT_LATIN.findall(text)


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level BPE files write bytes: printable Latin-1 ones stand for themselves, the
    others take the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_alphabet()
        raw = {text: bytes(letters[c] for c in text) for text in model["vocab"]}
        self.id_of = {raw[text]: i for text, i in model["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max(chain(self.id_of.values(), self.added.values()))
        self.bytes_of = [b""] * size
        for b, i in self.id_of.items():
            self.bytes_of[i] = b
        for text, i in self.added.items():
            self.bytes_of[i] = text.encode()
        self.longest = max(map(len, self.id_of))
        never = np.int64(1) << 40
        #: rank: position of the merge that makes a token, -1 for bytes; left, right: its parts.
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.arange(size), np.arange(size)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for k, merge in enumerate(model["merges"]):
            a, b = (self.id_of[raw[x]] for x in (merge if isinstance(merge, list) else merge.split(" ")))
            made = self.id_of[self.bytes_of[a] + self.bytes_of[b]]
            self.merges[a, b] = (k, made)
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = k, a, b
        self.byte_id = [self.id_of.get(bytes([b]), -1) for b in range(256)]
        self.pair_rank = {pair: k for pair, (k, _) in self.merges.items()}
        self.made_by = [made for _, made in self.merges.values()]
        keys = np.array([a * size + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.size, self.never = size, never
        self.keys, self.ranks = keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.added_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        #: The spelled-out token must be reachable by its own merges, or greedy proposals could hold it wrongly.
        self.sound = np.array([len(b) == 1 or self.rank[i] >= 0 for i, b in enumerate(self.bytes_of)])
        #: Ids as text, and the bytes decoded from them, of the words that a worker keeps.
        self.kept: dict[str, tuple[str, bytes]] = {t: (str(i), t.encode()) for t, i in self.added.items()}

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.never)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair: does BPE leave the boundary between a and b alone?  The tokens on both sides of the
        boundary are undone step by step, the later merge first.  The pair fails if at some moment the two boundary
        pieces had a merge that ranks before the next step of either (of the left piece: at or before it, as the
        leftmost of equal merges goes first)."""
        ok = self.sound[a] & self.sound[b]
        live = np.flatnonzero(ok)
        x, y = a[live].copy(), b[live].copy()
        # The merge that consumed x (y) as it was built; never: it is whole.
        used_x = np.full(len(live), self.never)
        used_y = np.full(len(live), self.never)
        while len(live):
            across = self.merge_rank(x, y)
            # x is consumed by a merge to its left, which goes first if equal; y by one to its right, which goes later.
            bad = (across < used_x) & (across <= used_y) & (across < self.never)
            ok[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, used_x, used_y, rx, ry = (v[go] for v in (live, x, y, used_x, used_y, rx, ry))
            step = rx >= ry
            used_x, x = np.where(step, rx, used_x), np.where(step, self.right[x], x)
            used_y, y = np.where(step, used_y, ry), np.where(step, y, self.left[y])
        return ok

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        get, out, i, n = self.id_of.get, [], 0, len(word)
        while i < n:
            j = min(n, i + self.longest)
            while (t := get(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: the lowest-ranked adjacent merge first, leftmost of equals."""
        return self._merge_short(word) if len(word) <= 48 else self._merge_long(word)

    def _merge_short(self, word: bytes) -> list[int]:
        """Over a list of the ranks of all adjacent pairs."""
        ids, rank, none = [self.byte_id[c] for c in word], self.pair_rank, 1 << 40
        ranks = [rank.get(p, none) for p in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            ids[i : i + 2] = [self.made_by[low]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = rank.get((ids[i - 1], ids[i]), none)
        return ids

    def _merge_long(self, word: bytes) -> list[int]:
        """Over a linked list and a heap."""
        ids = [self.byte_id[c] for c in word]
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := merges.get((made, ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, made, ids[after[i]], m[1]))
            if before[i] >= 0 and (m := merges.get((ids[before[i]], made))):
                heapq.heappush(heap, (m[0], before[i], ids[before[i]], made, m[1]))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Speculate for all words, verify all pairs at once, merge the failing words."""
        proposed = [self.propose(w) for w in words]
        length = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter(chain.from_iterable(proposed), np.int64, int(length.sum()))
        owner = np.repeat(np.arange(len(words)), length)
        pair = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) > 1 else np.empty(0, np.int64)
        keys, where = np.unique(flat[pair] * self.size + flat[pair + 1], return_inverse=True)
        good = self.compatible(keys // self.size, keys % self.size)[where]
        alone = ~self.sound[flat]
        for k in np.unique(np.concatenate([owner[pair[~good]], owner[alone]])).tolist():
            proposed[k] = self.merge(words[k])
        return proposed

    def learn(self, words: list[str]) -> dict[str, tuple[str, bytes]]:
        """Encodings of words: ids as text, and the bytes decoded from the ids."""
        out = {}
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            for w, ids in zip(part, self.encode_words([w.encode() for w in part])):
                out[w] = (",".join(map(str, ids)), b"".join([self.bytes_of[t] for t in ids]))
        return out

    def pieces(self, text: str) -> list[str]:
        if self.added_pattern is None or not any(t in text for t in self.added):
            return split_words(text)
        out: list[str] = []
        for k, part in enumerate(self.added_pattern.split(text)):
            out += [part] if k % 2 else split_words(part)
        return out

    def encode_texts(self, texts: list[str]) -> list[tuple[int, str, bytes]]:
        """(number of tokens, ids joined by commas, decoded bytes) of each text.  New words of all texts are encoded
        together; once the cache is full they are forgotten after the call, long ones always."""
        split = [self.pieces(t) for t in texts]
        found = [list(map(self.kept.get, words)) for words in split]
        missing = {w for words, at in zip(split, found) if None in at for w, e in zip(words, at) if e is None}
        if missing:
            fresh = self.learn(list(missing))
            found = [[fresh[w] if e is None else e for w, e in zip(words, at)] if None in at else at for words, at in zip(split, found)]
            if len(self.kept) < CACHE_WORDS:
                self.kept |= {w: e for w, e in fresh.items() if len(w) <= CACHE_BYTES}
        out = []
        for at in found:
            joined = ",".join([e[0] for e in at])
            out.append((joined.count(",") + 1 if at else 0, joined, b"".join([e[1] for e in at])))
        return out

    def encode(self, text: str) -> list[int]:
        ids = self.encode_texts([text])[0][1]
        return [int(i) for i in ids.split(",")] if ids else []

    def decode(self, ids: Iterable[int]) -> str:
        """Bytes that are not UTF-8 become U+FFFD; special tokens are kept."""
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    """A worker reads the vocabulary once."""
    return ByteBPE(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: token count, digest of the decimal ids joined by
    commas and digest of the text decoded from them.

    Null and empty texts have no tokens.  Repeated rows and null doc_ids are encoded like any other; extra columns
    are ignored; an empty table gives an empty result."""
    tune(docs.sparkSession)
    path = path or default_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            count, ids, decoded = [], [], []
            for i in range(0, len(texts), 100):
                for n, joined, raw in bpe.encode_texts(texts[i : i + 100]):
                    count.append(n)
                    ids.append(sha256(joined.encode()).hexdigest())
                    decoded.append(sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
