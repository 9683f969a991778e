"""Collocations, recurrent language model and lexical search against brute force."""

import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from plumbline.llm import collocations, lexical, recurrent

SCHEMA = "doc_id long, text string, lang string, n long, phrase string, row long, word string"
SYLLABLES = "ka lo mi tu re".split()


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def rows_of(seed, n):
    rnd = random.Random(seed)
    draw = lambda: "".join(rnd.choice(SYLLABLES) for _ in range(rnd.choice((1, 1, 2))))
    texts = ["".join(draw() + rnd.choice((" ", " ", " ", "  ", "\t", ". ", "\n", ", ")) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    texts += [None, "", " ", "KA ka KA ka", "a a a a. a a", "Ähre ähre ÄHRE", "x\x00y \x1cz", "ka\xa0lo mi", "ka " * 3000, ".;:!?", "lo lo lo\r\nlo lo\x0blo"]
    langs = ["en", "fr", None, "und"]
    rows = [(i, t, langs[i % 4], 1, "p", 2, "w") for i, t in enumerate(texts)]
    return rows + rows[:7] + [(None, "ka lo mi", None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return rows_of(1, 150)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- op11


def brute_collocations(rows, least=10, longest=3, top=2000, absorbed=50):
    n, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", fold(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    inside = lambda short, long: any(long[i : i + len(short)] == short for i in range(len(long) - len(short) + 1))
    out = []
    for (lang, words), a in candidates.items():
        if any(g == lang and len(w) > len(words) and inside(words, w) and 100 * b >= absorbed * a for (g, w), b in candidates.items()):
            continue
        score, _, left, right = min((1000000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words)))
        out.append((lang, -score, -a, " ".join(words).encode(), left, right))
    ranked, place = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        place[lang] += 1
        if place[lang] <= top:
            ranked.append((lang, place[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(ranked)


@pytest.mark.parametrize("options", [{}, {"chunk": 400, "range_entries": 50}, {"least": 4, "longest": 4, "top": 5, "absorbed": 80}, {"least": 300}])
def test_collocations_match_brute_force(docs, rows, options):
    own = {k: v for k, v in options.items() if k not in ("chunk", "range_entries")}
    got = sorted(map(tuple, collocations.collocations(docs, **options).collect()))
    assert got == brute_collocations(rows, **own)
    assert got or options.get("least") == 300 or not own


def test_collocation_scores_are_exact_beyond_64_bits(spark):
    a = 3_000_000_019
    counts = spark.createDataFrame([("en", "a b", 2, a), ("en", "a", 1, 4_000_000_007), ("en", "b", 1, 5_000_000_029)], "lang string, phrase string, words int, n long")
    row = collocations._scored(counts.where("words = 2").withColumnRenamed("n", "a"), counts, 3).first()
    assert row.score == 1000000 * a * a // (4_000_000_007 * 5_000_000_029)


def test_collocations_of_an_empty_table(empty):
    assert collocations.collocations(empty).collect() == []


def test_a_text_in_chunks_is_the_whole_text():
    text = ("Ka lo. Mi\ttu, " * 50).encode()
    lines = collocations.guarded(text)
    assert b"\n".join(collocations._cut(lines, 30)) == lines
    assert collocations.scan(b" a a a \n a a ", [b" a a ", b" a a a "]).tolist() == [3, 1]


# ---------------------------------------------------------------- op12


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", fold(text or ""))


def test_base_score_matches_brute_force(docs, rows, monkeypatch):
    monkeypatch.setattr(recurrent, "CARRIED", 8)  # most words go through the join
    monkeypatch.setattr(recurrent, "HEADS", 6)
    held = [i is not None and crc32(str(i).encode()) % 7 == 2 for i, *_ in rows]
    c = Counter(w for (_, t, *_), out in zip(rows, held) if not out for w in [*words_of(t), ""])
    total, distinct = sum(c.values()), len(c)
    want = []
    for (i, text, *_), out in zip(rows, held):
        own = [*words_of(text), ""]
        want.append((str(i), out, len(own), sum(c[w] > 0 for w in own), total, round(sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in own), 4)))
    got = recurrent.score(docs, rounds=1).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == sorted(want)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def vocabulary():
    c = Counter({b"": 20, b"the": 30, b"of": 12, b"cat": 7, b"sat": 5, b"mat": 4, b"dog": 1})
    return recurrent.Vocabulary(list(c), list(c.values()), sum(c.values()), len(c), heads=5, classes=2, suffixes=4), c


def test_the_gradient_is_right():
    vocab, _ = vocabulary()
    p = recurrent.initial(vocab, state=3, kind=np.float64)
    docs = [vocab.encode(t)[:2] for t in (b"the cat sat of the mat", b"of dog the", b"")]
    x, target, reset, _, active = recurrent.laid_out(docs, 2, vocab.heads)
    h = np.random.default_rng(5).standard_normal((x.shape[1], 3))
    value, grad, _ = recurrent.gradient(p, h, x, target, reset, active, vocab.members)
    for name, g in grad.items():
        for at in np.ndindex(*g.shape):
            if np.isfinite(p[name][at]):
                old = p[name][at]
                p[name][at] = old + 1e-6
                up = recurrent.gradient(p, h, x, target, reset, active, vocab.members)[0]
                p[name][at] = old
                assert -(up - value) / 1e-6 == pytest.approx(g[at], abs=2e-4), (name, at)


def test_probabilities_sum_to_one_and_windows_do_not_matter():
    vocab, c = vocabulary()
    p = recurrent.initial(vocab, state=3, kind=np.float64)

    def total(text):
        known, inputs, others = vocab.encode(text)
        shared = [int(c[w]) for w in recurrent.tokens(text) if vocab.index.get(w, -1) not in range(vocab.heads)]
        return recurrent.log_likelihoods(p, [(known, inputs)], vocab)[0] + sum(math.log((n + 1) / vocab.rare) for n in shared)

    # After "the": every known word or an unknown one, or the end; told apart by what one more word adds.
    known, inputs, _ = vocab.encode(b"the")
    states = recurrent.steps(p, np.zeros((1, 3)), np.array([[0], [inputs[0]]]), np.array([[True], [False]]), np.array([1, 1]))[0][1]
    logs = {w: recurrent.outputs(p, states, np.array([k if k < vocab.heads else -1]), vocab.members)[0][0] for k, w in enumerate(vocab.words)}
    heads = sum(math.exp(logs[w]) for w in vocab.words[: vocab.heads])
    shared = [w for w in vocab.words[vocab.heads :]] + [b"unknown"]
    rest = sum(math.exp(recurrent.outputs(p, states, np.array([-1]), vocab.members)[0][0]) * (c[w] + 1) / vocab.rare for w in shared)
    assert heads + rest == pytest.approx(1)
    texts = [b"the cat " * 40, b"of", b"", b"dog sat " * 25]
    docs = [vocab.encode(t)[:2] for t in texts]
    one = [recurrent.log_likelihoods(p, [d], vocab, window=10**6)[0] for d in docs]
    for window, most in ((1, 1), (7, 2), (32, 4)):
        assert recurrent.log_likelihoods(p, docs, vocab, window, most) == pytest.approx(one)


def test_the_model_learns_an_order_that_counts_do_not_see(spark):
    rnd = random.Random(3)
    texts = []
    for _ in range(300):
        word, out = rnd.choice("abcdef"), []
        for _ in range(40):
            out.append(word)
            word = "abcdef"["abcdef".index(word) - 5] if rnd.random() < 0.95 else rnd.choice("abcdef")
        texts.append(" ".join(out))
    got = recurrent.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("held_out").collect()
    assert sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got)


def test_scores_of_empty_tables_and_without_training_rows(spark, empty):
    assert recurrent.score(empty).collect() == []
    out = next(i for i in range(100) if crc32(str(i).encode()) % 7 == 2)
    row = recurrent.score(spark.createDataFrame([(out, "a b", "extra")], "doc_id long, text string, base string")).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0)


# ---------------------------------------------------------------- op13

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def brute_search(rows, items, top=10):
    texts = [(i, Counter(re.findall(TERM, fold(t or "")))) for i, t, *_ in rows]
    texts = [(i, c, sum(c.values())) for i, c in texts if c]
    n_docs, n_terms = len(texts), sum(n for *_, n in texts)
    df = Counter(w for _, c, _ in texts for w in c)
    out = []
    for item, text in items:
        found = []
        for k, (i, c, n) in enumerate(texts):
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w in set(re.findall(TERM, fold(text or ""))) if c[w])
            if score > 0:
                found.append((-score, i is None, i, k))
        out += [(str(item), rank + 1, str(i), -s) for rank, (s, _, i, _) in enumerate(sorted(found)[:top])]
    return sorted(out)


ITEMS = [(1, "KA lo. mitu!"), (2, "rere-rere ähre ÄHRE x"), (2, "tulo"), (3, None), (4, ""), (5, "nowhere"), (None, "loka mi"), (6, "ka " * 500)]


def test_search_matches_brute_force(spark, docs, rows, tmp_path):
    items = spark.createDataFrame([(*x, "clash", 7) for x in ITEMS], "item_id long, text string, term string, rank int")
    want = brute_search(rows, ITEMS)
    index = lexical.postings(docs)
    got = lambda index: sorted((str(r.item_id), r["rank"], str(r.doc_id), r.score) for r in lexical.search(index, items).collect())
    assert got(index) == want
    lexical.write_index(docs, f"{tmp_path}/index")
    assert got(lexical.read_index(spark, f"{tmp_path}/index")) == want


def test_search_in_empty_tables(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(lexical.postings(empty), items).collect() == []
    assert lexical.search(lexical.postings(docs), items.limit(0)).collect() == []
