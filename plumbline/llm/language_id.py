"""Language ID (operator 6): segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  The probability of a word is the sum
over all its segmentations into pieces, by the forward algorithm; a text's score is the product over its words.
The probabilities are fitted by EM on a bounded sample of labelled rows.  Forward and backward passes run over many
words at once, position by position, for all languages together."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tune

#: Labelled documents per language in the sample that the model is fitted on (expected number; all, if fewer).
FIT_DOCS = 400
ROUNDS = 3
SMOOTH = 0.02
#: Words of more characters are summed in logarithms, so that no product underflows.
LONG = 40
#: Positions x words of one lattice, so that its memory does not depend on how long the words are.
LATTICE = 1 << 17
CACHE_WORDS = 150_000
UNDETERMINED = "und"
#: Runs of letters; numerals that this also takes have no piece and no say.
WORD = re.compile(r"[^\W\d_]+")
#: Lower-case letters and all bytes of other characters stay, the rest of ASCII separates.
RUNS = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
BASE = np.uint64(0x100000001B3)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """All letter pieces of the vocabulary, found by rolling hash.  Word starts carry U+2581, as in the vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        known = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
        fits = {p for p in known if p.strip("▁") and p.lstrip("▁").isalpha() and len(p) - len(p.lstrip("▁")) <= 1}
        self.pieces = sorted(fits)
        self.longest = max(map(len, self.pieces))
        #: Sorted hashes and ids of the pieces of each length.
        self.keys, self.ids = [], []
        for k in range(1, self.longest + 1):
            of_length = [i for i, p in enumerate(self.pieces) if len(p) == k]
            hashes = np.array([self._hash(self.pieces[i]) for i in of_length], np.uint64)
            order = np.argsort(hashes)
            self.keys.append(np.append(hashes[order], np.uint64(0xFFFFFFFFFFFFFFFF)))
            self.ids.append(np.append(np.array(of_length, np.int32)[order], np.int32(-1)))
        self.size = len(self.pieces) + 1  # the last: any single character

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 7) & 0xFFFFFFFFFFFFFFFF
        return h

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(length, ids): ids[j, k, n] is the piece of word n that ends before position j + 1 and has k + 1
        characters, -1 if there is none; a single character that is no piece has the id of any character."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        width = int(length.max(initial=1))
        codes = np.zeros((width, len(words)), np.uint64)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(7)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
        codes[at, np.repeat(np.arange(len(words)), length)] = flat
        ids = np.full((width, self.longest, len(words)), -1, np.int32)
        h = np.zeros_like(codes)
        for k in range(min(self.longest, width)):
            # The hash of the k + 1 characters up to each position, from that of the k before it.
            h = h[: width - k] * BASE + codes[k:] if k == 0 else h[:-1] * BASE + codes[k:]
            found = np.searchsorted(self.keys[k], h.ravel()).reshape(h.shape)
            got = np.where(self.keys[k][found] == h, self.ids[k][found], -1)
            if k == 0:
                got = np.where(got < 0, self.size - 1, got)
            inside = np.arange(k + 1, width + 1)[:, None] <= length[None, :]
            ids[k:, k] = np.where(inside, got, -1)
        return length, ids


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def marked(word: str) -> str:
    """A word as the model sees it, with the start mark."""
    return "▁" + word


def forward(ids: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """alpha[j, n, language]: probability of the first j characters over all segmentations.  prob[-1] is 0."""
    width, longest, n = ids.shape
    alpha = np.zeros((width + 1, n, prob.shape[1]))
    alpha[0] = 1
    for j in range(width):
        for k in range(min(longest, j + 1)):
            hit = np.flatnonzero(ids[j, k] >= 0)
            if len(hit):
                alpha[j + 1, hit] += alpha[j - k, hit] * prob[ids[j, k, hit]]
    return alpha


def _steps(ids: np.ndarray, log_prob: np.ndarray) -> np.ndarray:
    """Log probabilities (position, piece length, language) of one word's pieces; none has minus infinity."""
    return np.where(ids[:, :, None] >= 0, log_prob[ids], -np.inf)


def log_forward(vocab: Pieces, word: str, prob: np.ndarray) -> np.ndarray:
    """The logarithm of forward() for one word of any length, block by block: log alpha[j, language]."""
    log_prob, longest = np.log(prob), vocab.longest
    out = np.full((len(word) + 1, prob.shape[1]), -np.inf)
    out[0] = 0
    for start in range(0, len(word), 1 << 14):
        back = max(0, start - longest + 1)
        ids = vocab.lattice([word[back : start + (1 << 14)]])[1][start - back :, :, 0]
        step = _steps(ids, log_prob)
        for j in range(start, start + len(ids)):
            least = max(0, j + 1 - longest)
            ways = out[least : j + 1][::-1] + step[j - start, : j + 1 - least]
            top = ways.max(axis=0)
            out[j + 1] = top + np.log(np.exp(ways - top).sum(axis=0))
    return out


def _blocks(words: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of words, sorted by length, whose lattices have at most LATTICE cells."""
    start = 0
    while start < len(words):
        end = start + 1
        while end < len(words) and end - start < 4096 and len(words[end]) * (end + 1 - start) <= LATTICE:
            end += 1
        yield start, end
        start = end


def log_likelihood(vocab: Pieces, words: list[str], prob: np.ndarray) -> np.ndarray:
    """log P(word) in each language."""
    out = np.empty((len(words), prob.shape[1]))
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    few = [i for i in order if len(words[i]) <= LONG]
    for a, b in _blocks([words[i] for i in few]):
        length, ids = vocab.lattice([words[i] for i in few[a:b]])
        out[few[a:b]] = np.log(forward(ids, prob)[length, np.arange(len(length))])
    for i in order[len(few) :]:
        out[i] = log_forward(vocab, words[i], prob)[-1]
    return out


def _expected_of_long(vocab: Pieces, word: str, weight: float, prob: np.ndarray, total: np.ndarray) -> None:
    """Add a long word's expected uses, for one language, in logarithms."""
    alpha, longest = log_forward(vocab, word, prob)[:, 0], vocab.longest
    log_prob = np.log(prob[:, 0])
    beta = np.full(len(word) + 1, -np.inf)
    beta[-1] = 0
    for end in range(len(word), 0, -(1 << 14)):
        start = max(0, end - (1 << 14))
        back = max(0, start - longest + 1)
        ids = vocab.lattice([word[back:end]])[1][start - back :, :, 0]
        for j in range(end - 1, start - 1, -1):
            k = np.flatnonzero(ids[j - start] >= 0)
            p = ids[j - start, k]
            through = beta[j + 1] + log_prob[p]
            np.add.at(total, p, weight * np.exp(alpha[j - k] + through - alpha[-1]))
            beta[j - k] = np.logaddexp(beta[j - k], through)


def expected_counts(vocab: Pieces, words: list[str], weight: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Expected use of each piece over all segmentations of the words, for one language."""
    total = np.zeros(vocab.size)
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    few = [i for i in order if len(words[i]) <= LONG]
    for a, b in _blocks([words[i] for i in few]):
        length, ids = vocab.lattice([words[i] for i in few[a:b]])
        alpha = forward(ids, prob)[:, :, 0]
        width, longest, n = ids.shape
        beta = np.zeros((width + 1, n))
        beta[length, np.arange(n)] = weight[few[a:b]] / alpha[length, np.arange(n)]
        for j in range(width - 1, -1, -1):
            for k in range(min(longest, j + 1)):
                hit = np.flatnonzero(ids[j, k] >= 0)
                if len(hit):
                    p, back = ids[j, k, hit], beta[j + 1, hit] * prob[ids[j, k, hit], 0]
                    np.add.at(total, p, alpha[j - k, hit] * back)
                    beta[j - k, hit] += back
    for i in order[len(few) :]:
        _expected_of_long(vocab, words[i], float(weight[i]), prob, total)
    return total


def normalised(counts: np.ndarray) -> np.ndarray:
    """Smoothed probabilities (pieces, languages)."""
    return (counts + SMOOTH) / (counts.sum(0) + SMOOTH * len(counts))


class Model:
    def __init__(self, languages: list[str], prob: np.ndarray, path: str):
        self.languages, self.prob, self.path = languages, prob, path
        #: Row of self.scores for each known run; row 0 is for runs without a letter.
        self.rows: dict[bytes, int] = {}
        self.scores = np.zeros((1, len(languages)))

    def __getstate__(self):
        return self.languages, self.prob.astype(np.float32), self.path

    def __setstate__(self, state):
        languages, prob, path = state
        self.__init__(languages, prob.astype(np.float64), path)

    def learn(self, runs: list[bytes], rows: dict[bytes, int], scores: np.ndarray) -> np.ndarray:
        """Add runs to rows, and their scores below `scores`: sums over the words of a run."""
        cut = {}
        for run in runs:
            words = [w for w in WORD.findall(run.decode("utf-8", "replace")) if any(map(str.isalpha, w))]
            if words:
                cut[run] = list(map(marked, words))
            else:
                rows[run] = 0
        words = sorted({w for x in cut.values() for w in x})
        of_word = dict(zip(words, log_likelihood(load(self.path), words, self.prob)))
        new = np.array([of_word[x[0]] if len(x) == 1 else np.sum([of_word[w] for w in x], axis=0) for x in cut.values()]).reshape(-1, scores.shape[1])
        rows.update(zip(cut, range(len(scores), len(scores) + len(new))))
        return np.concatenate([scores, new])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Runs of letters and non-ASCII characters are looked up; new ones are scored together.  Once the table is
        full, further runs are scored anew for each call."""
        if not self.languages:
            return [(UNDETERMINED, 0.0)] * len(texts)
        split = [(t or "").lower().encode("utf-8", "replace").translate(RUNS).split() for t in texts]
        found = [list(map(self.rows.get, runs)) for runs in split]
        scores, rows = self.scores, self.rows
        missing = {r for runs, at in zip(split, found) if None in at for r, k in zip(runs, at) if k is None}
        if missing:
            full = len(rows) >= CACHE_WORDS
            rows = {} if full else rows
            scores = self.learn(list(missing), rows, scores)
            found = [[rows[r] if k is None else k for r, k in zip(runs, at)] if None in at else at for runs, at in zip(split, found)]
            if not full:
                self.scores = scores
        out = []
        for at in found:
            at = np.array(at, np.int64)
            if not at.any():
                out.append((UNDETERMINED, 0.0))
                continue
            total = scores[at].sum(0)
            best = int(total.argmax())
            out.append((self.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def held_out():
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2.  A null id is not."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, path: str | None = None, fit_docs: int = FIT_DOCS, rounds: int = ROUNDS) -> Model:
    """Fit on the labelled rows that are not held out, at most about fit_docs a language, drawn by a hash of the id.
    The sample's words are counted in Spark, EM rounds run over the word table in parallel, and the driver only sees
    (pieces of the vocabulary) x (languages) sums."""
    path, spark = path or default_path(), docs.sparkSession
    tune(spark)
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    share = {r["lang"]: min(1.0, fit_docs / r["n"]) for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(share)
    vocab = load(path)
    if not languages:
        return Model([], np.zeros((vocab.size + 1, 0)), path)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 20)) / float(1 << 20)
    chosen = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col("lang")]

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w, n in Counter(filter(str.isalpha, WORD.findall(text.lower()))).items():
                    seen[lang, marked(w)] += n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    sample = usable.where(draw < chosen).select("lang", "text").mapInArrow(count, "lang string, word string, n long")
    words = materialize(sample.groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
    prob = np.full((vocab.size, len(languages)), 1.0 / vocab.size)
    for _ in range(rounds):
        now = prob

        def expect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocab, sums = load(path), {}
            for batch in batches:
                df = batch.to_pandas()
                for lang, rows in df.groupby("lang"):
                    k = languages.index(lang)
                    got = expected_counts(vocab, rows["word"].tolist(), rows["n"].to_numpy(float), now[:, k : k + 1])
                    sums[k] = sums.get(k, 0) + got
            for k, got in sums.items():
                used = np.flatnonzero(got)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k)), pa.array(used), pa.array(got[used])], ["k", "piece", "x"])

        got = words.mapInArrow(expect, "k long, piece long, x double").groupBy("k", "piece").agg(F.sum("x").alias("x")).toPandas()
        counts = np.zeros_like(prob)
        counts[got["piece"].to_numpy(int), got["k"].to_numpy(int)] = got["x"].to_numpy(float)
        prob = normalised(counts)
    return Model(languages, prob, path)


def identify(docs: DataFrame, model: Model | None = None, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; score is the posterior of lang_pred under equal priors.

    `und` with score 0 if the text is null or has no letter, or if no labelled row was there to learn from; doc_id,
    lang and source are never inputs of a prediction.  Long texts are scored whole.  Repeated rows each return;
    equal texts get equal predictions; extra columns are ignored; an empty table gives an empty result."""
    model = model or fit(docs, **options)
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts, out = batch.column(2).to_pylist(), []
            for i in range(0, len(texts), 200):
                out += model.predict(texts[i : i + 200])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


#: The pipeline rejects documents without a language and those whose best language has a posterior below this.
SURE = 0.5


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """The documents whose language is determined, with the columns of docs.  The decision is made in the same pass
    over the rows, so rows are neither joined nor shuffled."""
    model = fit(docs, **options)
    tune(docs.sparkSession)
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts, out = batch.column(names.index("text")).to_pylist(), []
            for i in range(0, len(texts), 200):
                out += model.predict(texts[i : i + 200])
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= SURE for lang, score in out], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
