"""LM scoring (operator 12): a gated recurrent model with a class-factored softmax, and counts beside it.

The recurrent part is a minimal gated unit: each input has a share of the state that stays and a new state that takes
the rest, so that both are computed once an input and not once a token.

Words of all training documents are counted in Spark.  The most frequent are the heads of the model: they are dealt to
classes by frequency, and P(word) = P(class | state) P(word | class, state).  All other words share one class, in
which a word has the probability that the counts of the whole corpus give it; so the distribution covers every text,
and what it rests on grows with the corpus.  The recurrent part is trained on all training documents by truncated
backpropagation in numpy, in shards side by side whose parameters are averaged after each round.  Scoring runs many documents in lanes and carries
the state from window to window, so a document of any length is scored whole."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, tune

#: Words with weights of their own, the classes that they are dealt to, and buckets of word ends for other words.
HEADS = 2048
CLASSES = 32
SUFFIXES = 512
STATE = 32
#: Words whose counts go along with the tasks, at most; the counts of all others are joined.
CARRIED = 200_000
#: Rounds of training, between which the shards' parameters are averaged.  A round takes all training documents, or if
#: there are several times ROUND_DOCS an equal part of them, up to one in ROUNDS, so that all have their turn.
ROUNDS = 4
ROUND_DOCS = 2000
#: Documents of a shard and round, about, and the least and most shards.
SHARD_DOCS = 4000
SHARDS = (4, 256)
#: Tokens that a shard lays out in lanes together, and parameters that are averaged together.
TRAIN_TOKENS = 1 << 21
PIECE = 1 << 14
#: Steps of a window, lanes at most, and the updates that training is to come to at least with fewer lanes.
WINDOW = 32
LANES = 256
UPDATES = 256
#: Tokens that are scored together, at least as long as the task has them; a document is not cut.
BLOCK_TOKENS = 1 << 21
#: Words and counts that a counting task holds before it adds them up and gives them away.
HELD_WORDS = 500_000
END = b""  # no word is empty


def held_out(modulus: int = 7) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 7, is 2.  A null id is not."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == 2, F.lit(False))


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """tokens() of all texts, one after the other, and the bounds between the texts."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string(), safe=False)))
    words = lists.flatten()
    real = pc.not_equal(words, "")  # white space at a text's ends sets off empty words
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    bounds = lists.offsets.to_numpy()
    return before[bounds - bounds[0]], words.filter(real).cast(pa.binary())


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over all training texts; the end of a text counts as the empty word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def give() -> list[pa.RecordBatch]:
            return pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"]).to_batches() if held else []

        for batch in batches:
            found = split(batch.column(0))[1].value_counts()
            held += [pa.table([found.field(0), found.field(1)], ["word", "c"]), pa.table([pa.array([END]), pa.array([len(batch)])], ["word", "c"])]
            if sum(map(len, held)) > HELD_WORDS:
                yield from give()
                held.clear()
        yield from give()

    return texts.where("not held_out").select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The carried words by falling count, with the first of them as heads; END is a head and comes first."""

    def __init__(self, words: list[bytes], counts: list[int], total: int, distinct: int, heads: int = HEADS, classes: int = CLASSES, suffixes: int = SUFFIXES):
        order = sorted(range(len(words)), key=lambda i: (words[i] != END, -counts[i], words[i]))
        self.words = [END] * (END not in words) + [words[i] for i in order]
        self.counts = np.array([0] * (END not in words) + [counts[i] for i in order], np.int64)
        self.table = pa.array(self.words, pa.binary())
        self.total, self.distinct, self.suffixes = total, distinct, suffixes
        self.heads = min(heads, len(self.words))
        self.members = -(-self.heads // classes)
        self.classes = -(-self.heads // self.members)
        #: Counts and number of the words that are no heads, and the smoothed mass of their class.
        self.rare = total + distinct + 1 - int(self.counts[: self.heads].sum()) - min(self.heads, distinct)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "words"}  # which tasks have as the table

    @property
    def inputs(self) -> int:
        return self.heads + self.suffixes

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """(bounds, known, input, words) of the words of all texts, END left out: the bounds between the texts and of
        each word its place among the carried words or -1, and its input."""
        bounds, words = split(texts)
        known = pc.index_in(words, value_set=self.table).fill_null(-1).to_numpy()
        inputs = known.astype(np.int32)
        other = (known < 0) | (known >= self.heads)
        ends = pc.binary_slice(words.filter(pa.array(other)), -3).dictionary_encode()
        inputs[other] = np.array([self.heads + crc32(w) % self.suffixes for w in ends.dictionary.to_pylist()], np.int32)[ends.indices.to_numpy()]
        return bounds, known, inputs, words

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(known, input) of the words of one text, and the words that are not carried."""
        _, known, inputs, words = self.encode_all(pa.array([text], pa.binary()))
        return known, inputs, words.filter(pa.array(known < 0)).to_pylist()


def initial(vocab: Vocabulary, state: int = STATE, seed: int = 12, kind=np.float32) -> dict[str, np.ndarray]:
    rnd = np.random.default_rng(seed)
    shapes = {"E": (vocab.inputs, state), "W": (2, state, state), "b": (2, 1, state), "C": (state, vocab.classes + 1), "c": (vocab.classes + 1,), "O": (vocab.classes, state, vocab.members), "o": (vocab.classes, vocab.members)}
    out = {k: (rnd.standard_normal(s) * (0.1 if k == "E" else s[-2] ** -0.5) if k.isupper() else np.zeros(s)).astype(kind) for k, s in shapes.items()}
    out["b"][0, 0] = np.linspace(-4, 4, state)  # units that forget soon and units that remember long
    out["o"].ravel()[vocab.heads :] = -np.inf  # places of the last class that no word has
    return out


def room(held: dict, name: str, shape: tuple, kind: np.dtype) -> np.ndarray:
    """An array of that shape, not filled, in memory that held keeps from call to call."""
    size = math.prod(shape)
    if name not in held or held[name].size < size:
        held[name] = np.empty(size, kind)
    return held[name][:size].reshape(shape)


def gates(p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Of each input the share of the state that stays and the new state that takes the rest, and their slopes.
    Both are a / (1 + |a|), the share moved to 0..1: numpy has no fast tanh on all machines."""
    a = p["E"] @ p["W"] + p["b"]
    scale = 1 / (1 + np.abs(a))
    both, slope = a * scale, scale * scale
    both[0] *= 0.5
    both[0] += 0.5
    slope[0] *= 0.5
    return both, slope


def steps(p: dict, h: np.ndarray, x: np.ndarray, reset: np.ndarray, active: np.ndarray, keep: dict | None = None, held: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """States after each step (steps, lanes, state) and the last state.  reset: lanes whose document begins; active:
    number of lanes, the first ones, that go on at each step.  keep gets what backpropagation needs, in memory of held."""
    held, out = {} if held is None else held, np.zeros((len(x), *h.shape), h.dtype)
    (stay_of, new_of), slope = gates(p)
    stay, new = (np.take(of, x, axis=0, out=room(held, name, out.shape, h.dtype), mode="clip") for of, name in ((stay_of, "stay"), (new_of, "new")))
    before = room(held, "before", out.shape, h.dtype)
    for t in range(len(x)):
        n = active[t]
        prev, now = before[t, :n], out[t, :n]
        prev[:] = h[:n]
        prev[reset[t, :n]] = 0
        np.subtract(prev, new[t, :n], out=now)
        now *= stay[t, :n]
        now += new[t, :n]
        h[:n] = now
        before[t, n:] = 0
    if keep is not None:
        keep.update(before=before, stay=stay, new=new, slope=slope)
    return out, h


def _softmax(x: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each column the log of the softmax at the row that is chosen, and the sum by which x gives the softmax."""
    x -= x.max(axis=0)
    columns = np.arange(x.shape[1])
    score = x[chosen, columns]
    np.exp(x, out=x)
    total = x.sum(axis=0)
    return score - np.log(total), total


def outputs(p: dict, states: np.ndarray, target: np.ndarray, members: int, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log P(target | state), where target is a head's place or -1 for the shared class, without what that
    class gives its words; with grad, the gradient of the negative sum is added there and returned for the states."""
    classes = p["C"].shape[1] - 1
    which = np.where(target < 0, classes, target // members)
    order = np.argsort(which.astype(np.uint16), kind="stable")
    states, which, target = states[order], which[order], target[order]
    ends = np.searchsorted(which, np.arange(classes + 1))
    d = p["C"].T @ states.T + p["c"][:, None]
    found, total = _softmax(d, which)
    score, d_states = found.astype(np.float64), None
    if grad is not None:
        d /= total
        d[which, np.arange(len(which))] -= 1
        grad["C"] += (d @ states).T
        grad["c"] += d.sum(axis=1)
        d_states = d.T @ p["C"].T
    for k in range(classes):
        at = slice(ends[k], ends[k + 1])
        if at.start < at.stop:
            own, member = states[at], target[at] - k * members
            d = p["O"][k].T @ own.T + p["o"][k][:, None]
            found, total = _softmax(d, member)
            score[at] += found
            if grad is not None:
                d /= total
                d[member, np.arange(len(own))] -= 1
                grad["O"][k] += (d @ own).T
                grad["o"][k] += d.sum(axis=1)
                d_states[at] += d.T @ p["O"][k].T
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return score[back], None if d_states is None else d_states[back]


def gradient(p: dict, h: np.ndarray, x: np.ndarray, target: np.ndarray, reset: np.ndarray, active: np.ndarray, members: int, held: dict | None = None) -> tuple[float, dict, np.ndarray]:
    """Log-likelihood of a window, its negative gradient within the window, and the state after it."""
    keep: dict = {}
    states, h = steps(p, h.copy(), x, reset, active, keep, held)
    on = np.arange(x.shape[1])[None, :] < active[:, None]
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    score, d_on = outputs(p, states[on], target[on], members, grad)
    d_states = np.zeros_like(states)
    d_states[on] = d_on
    before, stay, new, d_next = keep["before"], keep["stay"], keep["new"], np.zeros_like(h)
    for t in range(len(x) - 1, -1, -1):
        n = active[t]
        d_states[t, :n] += d_next[:n]
        np.multiply(d_states[t, :n], stay[t, :n], out=d_next[:n])
        d_next[:n][reset[t, :n]] = 0
    # All that reaches the same input's gates is summed first, then carried on to its weights.
    before -= new
    before *= d_states
    np.subtract(1, stay, out=stay)
    stay *= d_states
    into = x.ravel().astype(np.intp)
    for k, part in enumerate((before, stay)):
        columns = np.ascontiguousarray(part.reshape(-1, h.shape[1]).T)
        d = np.stack([np.bincount(into, column, len(p["E"])) for column in columns], axis=1).astype(h.dtype) * keep["slope"][k]
        grad["E"] += d @ p["W"][k].T
        grad["W"][k] += p["E"].T @ d
        grad["b"][k] += d.sum(axis=0)
    return float(score.sum()), grad, h


def lanes(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Documents dealt to at most `most` lanes of near equal length, the longest lane first."""
    out: list[list[int]] = [[] for _ in range(min(most, len(lengths)))]
    size = np.zeros(len(out), np.int64)
    for d in np.argsort(-lengths, kind="stable"):
        k = int(size.argmin())
        out[k].append(int(d))
        size[k] += lengths[d]
    return [out[k] for k in np.argsort(-size, kind="stable")]


def laid_out(docs: list[tuple[np.ndarray, np.ndarray]], most: int, heads: int) -> tuple[np.ndarray, ...]:
    """Documents (known, inputs) in lanes: arrays (steps, lanes) of inputs, targets, document beginnings and document
    numbers, and the lanes that are active at each step.  A document's first input is END, its last target too."""
    sizes = np.array([len(k) + 1 for k, _ in docs], np.int64)
    dealt = lanes(sizes, most)
    total = np.array([sizes[own].sum() for own in dealt])
    x, target, number = (np.zeros((len(dealt), total[0]), np.int32) for _ in range(3))
    reset = np.zeros(x.shape, bool)
    for k, own in enumerate(dealt):
        at = 0
        for d in own:
            known, inputs = docs[d]
            end = at + len(known)
            x[k, at + 1 : end + 1] = inputs
            target[k, at:end] = np.where(known < heads, known, -1)
            number[k, at : end + 1] = d
            reset[k, at] = True
            at = end + 1
    active = len(total) - np.searchsorted(total[::-1], np.arange(total[0]), side="right")
    return *(np.ascontiguousarray(a.T) for a in (x, target, reset, number)), active


def log_likelihoods(p: dict, docs: list[tuple[np.ndarray, np.ndarray]], vocab: Vocabulary, window: int = WINDOW, most: int = LANES) -> np.ndarray:
    """Natural log probability of each whole document, without what the shared class gives its words."""
    out = np.zeros(len(docs))
    if not docs:
        return out
    x, target, reset, number, active = laid_out(docs, most, vocab.heads)
    h, held = np.zeros((x.shape[1], p["E"].shape[1]), p["E"].dtype), {}
    for a in range(0, len(x), window):
        w = slice(a, a + window), slice(active[a])
        states, h = steps(p, h[w[1]], x[w], reset[w], active[w[0]], held=held)
        on = np.arange(active[a])[None, :] < active[w[0], None]
        out += np.bincount(number[w][on], outputs(p, states[on], target[w][on], vocab.members)[0], len(docs))
    return out


def train(p: dict, docs: list[tuple[np.ndarray, np.ndarray]], vocab: Vocabulary, moments: dict | None = None, rate: float = 0.01) -> tuple[dict, int]:
    """Parameters after one pass of Adam over the documents (known, inputs), window by window with the state carried
    on, and the tokens used.  A window in which few lanes go on moves the parameters by its share.  moments holds what
    Adam goes on with from call to call."""
    most = min(LANES, max(8, sum(len(k) + 1 for k, _ in docs) // (WINDOW * UPDATES)))
    x, target, reset, _, active = laid_out(docs, most, vocab.heads)
    p = {k: v.copy() for k, v in p.items()}
    moments, held = {} if moments is None else moments, {}
    first, second = (moments.setdefault(m, {k: np.zeros_like(v) for k, v in p.items()}) for m in ("first", "second"))
    h, used, n = np.zeros((x.shape[1], p["E"].shape[1]), p["E"].dtype), 0, moments.get("steps", 0)
    for a in range(0, len(x), WINDOW):
        w = slice(a, a + WINDOW), slice(active[a])
        _, grad, h = gradient(p, h[w[1]], x[w], target[w], reset[w], active[w[0]], vocab.members, held)
        n, size = n + 1, int(active[w[0]].sum())
        used += size
        scale = 1 / size
        norm = scale * math.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        scale *= min(1.0, 1 / max(norm, 1e-9))
        for k, g in grad.items():
            g *= scale
            first[k] *= 0.9
            first[k] += 0.1 * g
            g *= g
            g *= 0.01
            second[k] *= 0.99
            second[k] += g
            np.sqrt(second[k], out=g)
            g += 1e-8
            np.divide(first[k], g, out=g)
            g *= rate * size / (WINDOW * x.shape[1]) * math.sqrt(1 - 0.99**n) / (1 - 0.9**n)
            p[k] -= g
    moments["steps"] = n
    return p, used


class Model:
    def __init__(self, vocab: Vocabulary, parameters: dict):
        self.vocab, self.parameters = vocab, parameters


def trained(p: dict, texts: DataFrame, vocab: Vocabulary, shards: int) -> dict:
    """The mean of the parameters that the shards of texts(key, text) come to, each weighted by its tokens."""
    spark, names = texts.sparkSession, list(p)
    shared = spark.sparkContext.broadcast((vocab, p))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, p = shared.value
        moments, held, size, used = {}, [], 0, 0
        for batch in batches:
            bounds, known, inputs, _ = vocab.encode_all(batch.column(0))
            held += [(known[a:b], inputs[a:b]) for a, b in itertools.pairwise(bounds.tolist())]
            size += len(known) + len(batch)
            if size >= TRAIN_TOKENS:
                p, n = train(p, held, vocab, moments)
                held, size, used = [], 0, used + n
        if held:
            p, n = train(p, held, vocab, moments)
            used += n
        if used:
            flat = np.concatenate([p[k].ravel() for k in names]).astype(np.float32)
            pieces = [flat[a : a + PIECE].tobytes() for a in range(0, len(flat), PIECE)]
            columns = [pa.array(np.arange(len(pieces)), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(pieces), pa.int32()), pa.array([used] * len(pieces), pa.int64()), pa.array(pieces, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["piece", "shard", "used", "values"])

    def mean(own: pa.Table) -> pa.Table:
        rows = sorted(own.to_pylist(), key=lambda r: r["shard"])
        total = sum(r["used"] for r in rows)
        with np.errstate(invalid="ignore"):
            values = sum(np.frombuffer(r["values"], np.float32) * (r["used"] / total) for r in rows).astype(np.float32)
        return pa.table({"piece": own["piece"].slice(0, 1), "values": pa.array([values.tobytes()], pa.binary())})

    # Whatever number of partitions a shuffle is held to, there are that many shards: each gives all parameters.
    dealt = texts.repartition(shards, "key").coalesce(shards).sortWithinPartitions("key").select("text")
    means = dealt.mapInArrow(run, "piece int, shard int, used long, values binary").groupBy("piece").applyInArrow(mean, "piece int, values binary")
    flat = b"".join(bytes(r["values"]) for r in sorted(means.collect(), key=lambda r: r["piece"]))
    shared.unpersist()
    if not flat:
        return p
    ends = np.cumsum([v.size for v in p.values()])[:-1]
    return {k: v.reshape(p[k].shape).copy() for k, v in zip(names, np.split(np.frombuffer(flat, np.float32), ends))}


def fit(texts: DataFrame, words: DataFrame, rounds: int = ROUNDS) -> Model:
    """Fit the model to texts(doc_id, held_out, text) and their word counts(word, c)."""
    spark = texts.sparkSession
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # The most frequent words, down to the level of counts below which there would be more than CARRIED.
    level = F.floor(F.log("c") * 64).cast("int")
    least, n = None, 0
    for r in sorted(words.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        n += r["count"]
        if n > CARRIED:
            break
        least = r["level"]
    carried = words.where((F.col("word") == END) | (level >= least if least is not None else F.lit(False))).select("word", "c").toArrow()
    vocab = Vocabulary(carried["word"].to_pylist(), carried["c"].to_pylist(), total, distinct)
    p = initial(vocab)
    if not total:
        return Model(vocab, p)
    n_docs = words.where(F.col("word") == END).first()["c"]
    parts = max(1, min(rounds, n_docs // ROUND_DOCS))
    shards = min(SHARDS[1], max(SHARDS[0], n_docs // parts // SHARD_DOCS))
    learnt = texts.where("not held_out").select(F.xxhash64("doc_id", "text").alias("key"), "text")
    for k in range(rounds):
        p = trained(p, learnt.where(F.pmod("key", F.lit(parts)) == k % parts), vocab, shards)
    return Model(vocab, p)


def _passed(texts: DataFrame, model: Model) -> DataFrame:
    """One pass over the texts: for each a row (row, doc_id, held_out, n_tokens, n_known, base, score) of sums over
    the words that are carried, END and the model's classes, and rows (row, word, n) for its other words."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, p = shared.value.vocab, shared.value.parameters
        logs = np.log10(vocab.counts + 1.0)
        row = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0

        def give() -> Iterator[pa.RecordBatch]:
            found = log_likelihoods(p, [h[0] for h in held], vocab) / math.log(10)
            base, in_class, known, n = (np.array([h[k] for h in held]) for k in range(1, 5))
            columns = [pa.array([h[5] for h in held], pa.int64()), pa.array([h[6] for h in held], pa.int64()), pa.array([h[7] for h in held], pa.bool_()), pa.nulls(len(held), pa.binary()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(found + in_class, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, NAMES)

        for batch in batches:
            bounds, known, inputs, words = vocab.encode_all(batch.column(2))
            docs, sizes = np.repeat(np.arange(len(batch)), np.diff(bounds)), np.diff(bounds) + 1
            is_known, in_rest = known >= 0, known >= vocab.heads
            base = np.bincount(docs, np.where(is_known, logs[known], 0), len(batch)) + logs[0]
            n_known = np.bincount(docs[is_known], minlength=len(batch)) + int(vocab.counts[0] > 0)
            # Words of the shared class that are carried; the others' log counts are added after the join.
            in_class = np.bincount(docs, np.where(in_rest, logs[known], 0), len(batch)) - np.bincount(docs[in_rest | ~is_known], minlength=len(batch)) * math.log10(vocab.rare)
            for k, (doc_id, out) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                at = slice(bounds[k], bounds[k + 1])
                held.append(((known[at], inputs[at]), base[k], in_class[k], n_known[k], sizes[k], row + k, doc_id, out))
            size += int(sizes.sum())
            others = words.filter(pa.array(~is_known)).dictionary_encode()
            if len(others):
                found, n = np.unique(docs[~is_known] * len(others.dictionary) + others.indices.to_numpy(), return_counts=True)
                of, word = np.divmod(found, len(others.dictionary))
                none = [pa.nulls(len(found), kind) for kind in (pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(row + of), none[0], none[1], others.dictionary.take(pa.array(word)), pa.array(n), none[2], none[3], none[4]], NAMES)
            row += len(batch)
            if size >= BLOCK_TOKENS:
                yield from give()
                held.clear()
                size = 0
        if held:
            yield from give()

    return texts.mapInArrow(run, "row long, doc_id long, held_out boolean, word binary, n long, known long, base double, score double")


NAMES = ["row", "doc_id", "held_out", "word", "n", "known", "base", "score"]


def score(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    A null text is empty and consists of its end; texts of any length are scored whole, and equal texts alike up to
    the rounding of sums; a null id is no held-out row; repeated rows count and return each; extra columns are
    ignored.  With nothing to learn from, every count is 0 and so is base_score; an empty table gives an empty
    result."""
    tune(docs.sparkSession)
    texts = _texts(docs)
    words = materialize(count_words(texts), "lm-words")
    model = fit(texts, words, **options)
    passed = materialize(_passed(texts, model), "lm-passed")
    vocab = model.vocab
    own = passed.where("word is not null").select("row", "word", F.col("n").alias("times")).join(words, "word")
    own = own.groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("logs"))
    rows = passed.where("word is null").join(own, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    base = F.col("base") + logs - F.col("n") * math.log10(vocab.total + vocab.distinct + 1)
    return rows.select("doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + logs).alias("score"))
