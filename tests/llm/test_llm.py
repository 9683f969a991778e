"""Brute force, round trips and edge cases of the training-data operators."""

import gzip
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, language_id, license_scan, pii, sharding, simhash, sketch, sql, url_filter, warc
from plumbline.llm.common import lookup
from plumbline.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, shard int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 30)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = [prose(i, 60 + i) for i in range(12)]
    return [None, "", "   ", "one", "a b c d", *base, base[0], base[0], base[1] + " tail", "Ärger 中文 ½ — naïve x", "x" * 5000, prose(99, 4000)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    # extra columns whose names clash with those that operators use inside
    rows = [(i * 7, t, "en" if i % 2 else "fr", "s", len(t or ""), 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (7, "", "fr", "s", 0, 1, 2), (None, "no id here at all", None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- op3


def brute_fingerprint(text, size=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(i)].append(r.doc_id)
    want = sorted((str(r.doc_id), f"{fps[i]:016x}", str(min(least[find(i)], default=None))) for i, r in enumerate(rows))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == want


def test_bit_sliced_cells_match_popcount():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = np.array([b ^ np.uint64(sum(1 << int(k) for k in rnd.choice(64, rnd.integers(0, 6), False))) for b in base for _ in range(40)])
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    reach = close.copy()
    for _ in range(8):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    want = reach.argmax(axis=1)
    assert (simhash.large_cell(fps[:, None], 4) == want).all()
    few = simhash.small_cells(fps[:40, None], np.zeros(40, int), 4)
    assert (few == want[:40]).all()


def test_every_choice_of_masks_covers_the_radius():
    for distinct in (10, 10**5, 10**7):
        masks = simhash.block_masks(4, distinct)
        for seed in range(50):
            flipped = sum(1 << k for k in random.Random(seed).sample(range(64), 4))
            assert any(m & flipped == 0 for m in masks)


def test_large_cells_are_cut_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    rows = [(i, prose(1, 300) + f" {i // 2}") for i in range(60)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), radius=4).collect()
    fps = {i: brute_fingerprint(t) for i, t in rows}
    for a in got:
        for b in got:
            if (fps[a.doc_id] ^ fps[b.doc_id]).bit_count() <= 4:
                assert a.component_id == b.component_id


def test_keep_one_takes_near_copies_and_leaves_others(spark):
    words = prose(5, 400).split()
    near = [*words[:200], "changed", *words[201:]]
    rows = [(3, " ".join(words)), (1, " ".join(near)), (2, " ".join(words)), (4, prose(6, 400)), (5, prose(7, 400))]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = simhash.keep_one(docs)
    assert sorted(r.doc_id for r in out.collect()) == [1, 4, 5] and out.columns == docs.columns


def jaccard(a, b, size=5):
    x, y = (set(zip(*(t.split()[k:] for k in range(size)))) for t in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("changed,stays", [(20, 1), (33, 1), (34, 2), (42, 2), (52, 2)])
def test_keep_one_links_at_exactly_the_similarity(spark, changed, stays):
    # 301 words, 297 shingles; a changed tail of k words changes k shingles: J = (297 - k) / (297 + k), 0.8 at 33
    pairs = []
    for seed in range(20):
        base = [f"w{seed}x{i}" for i in range(301)]
        pairs.append((" ".join(base), " ".join([*base[:-changed], *(f"z{seed}x{i}" for i in range(changed))])))
    assert stays == (1 if jaccard(*pairs[0]) >= 0.8 else 2)
    docs = spark.createDataFrame([(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)], "doc_id long, text string")
    got = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert sorted(got) == [2 * i + k for i in range(20) for k in range(stays)]


def test_keep_one_matches_brute_force_over_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    monkeypatch.setattr(simhash, "MEMBERS", 9)
    monkeypatch.setattr(simhash, "COLUMNS", 64)
    rnd, texts = random.Random(8), []
    for g in range(6):
        base = prose(700 + g, 120).split()
        texts += [" ".join("new%d" % rnd.randint(0, 9**9) if rnd.random() < rate else w for w in base) for rate in (0.005, 0.01, 0.02) for _ in range(22 if g < 2 else 4)]
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bands=60, rows=2, radius=110)
    assert sorted(r.doc_id for r in got.collect()) == [i for i in range(len(texts)) if find(i) == i]


def test_minhash_bands_are_independent():
    rnd, same = np.random.default_rng(0), []
    for _ in range(2000):
        a = rnd.integers(0, 1 << 63, 200, dtype=np.uint64) * np.uint64(2)
        b = np.concatenate([a[:-22], rnd.integers(0, 1 << 63, 22, dtype=np.uint64)])
        same.append((simhash.minhash_bands(a, 14, 3) == simhash.minhash_bands(b, 14, 3)).sum())
    p = (178 / 222) ** 3
    assert np.mean(same) == pytest.approx(14 * p, rel=0.02) and np.var(same) == pytest.approx(14 * p * (1 - p), rel=0.15) and min(same) > 0


def test_intersections_and_forests_match_brute_force(monkeypatch):
    rnd = random.Random(4)
    for columns in (64, 8192):
        monkeypatch.setattr(simhash, "COLUMNS", columns)
        for n in (1, 2, 7, 40):
            sets = [set(rnd.sample(range(300), rnd.choice([0, 1, 5, 250, 280]))) for _ in range(n)]
            arrays = [np.array(sorted(x), np.int64) for x in sets]
            want = np.array([[len(x & y) if i < j else 0 for j, y in enumerate(sets)] for i, x in enumerate(sets)])
            assert (simhash.shared_counts(arrays) == want).all()
            root = list(range(n))
            find = lambda i: i if root[i] == i else find(root[i])
            for i in range(n):
                for j in range(i):
                    if (len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 1.0) >= 0.8:
                        a, b = sorted((find(i), find(j)))
                        root[b] = a
            assert simhash.similar_forest(arrays, 0.8).tolist() == [find(i) for i in range(n)]


def test_near_copies_of_the_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, simhash.shingle_hashes((r.text or "").encode(), 5)) for r in docs.collect()]
    sets = [np.unique(h).view(np.int64) for _, h in rows]
    root = simhash.similar_forest(sets, 0.8)
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(least.get(r, i), i)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(least.values())


def test_keep_one_knows_rows_by_text_and_id(spark):
    near = lambda seed: prose(seed, 400) + " tail"
    rows = [(None, prose(i, 400)) for i in range(800, 806)]  # clean, without id
    rows += [(5, prose(i, 400)) for i in range(810, 813)]  # clean, one id
    rows += [(None, near(800)), (9, near(810)), (5, prose(820, 400)), (4, near(820)), (7, near(801)), (5, prose(811, 400))]
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [(r.doc_id, r.text) for r in out.collect()]
    of_800 = [g for g in got if g[1] in (prose(800, 400), near(800))]
    assert len(of_800) == 1 and of_800[0][0] is None
    want = [(7, near(801)), *((None, prose(i, 400)) for i in range(802, 806)), *((5, prose(i, 400)) for i in range(810, 813)), (4, near(820))]
    assert sorted(map(str, set(got) - set(of_800))) == sorted(map(str, want)) and len(got) == len(want) + 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


@pytest.mark.parametrize("hub", [0, 150, 1000])
def test_components_of_a_star_and_others(spark, hub):
    leaves = [i for i in range(1, 300) if i != hub]
    edges = [(hub, i) for i in leaves] + [(2000 + 2 * i, 2001 + 2 * i) for i in range(50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: min(hub, 1) for i in [hub, *leaves]}, **{2000 + 2 * i + k: 2000 + 2 * i for i in range(50) for k in (0, 1)}}


def test_lookup_gives_hot_and_other_keys_their_value(spark):
    rows = spark.createDataFrame([(0, i) for i in range(900)] + [(k, 0) for k in range(1, 100)], "k long, x long")
    table = spark.createDataFrame([(k, None if k == 0 else k * k, 900 if k == 0 else 1) for k in range(99)], "k long, v long, n long")
    got = lookup(rows, table, "k", "v", "n", 999)
    assert got.dtypes == [("k", "bigint"), ("x", "bigint"), ("v", "bigint")]
    assert sorted(map(tuple, got.where("k > 0").collect())) == [(k, 0, k * k) for k in range(1, 99)]
    assert got.where("k = 0 and v is null").count() == 900


# ---------------------------------------------------------------- op7


def test_bpe_matches_the_library(docs, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    got = {r.doc_id: r for r in bpe.encode_documents(docs).where("doc_id is not null and doc_id != 7").collect()}
    for i, t in enumerate(texts):
        if i == 1:
            continue
        ids = lib.encode(t or "", add_special_tokens=False).ids
        r = got[i * 7]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_on_random_text():
    from tokenizers import Tokenizer

    lib, own, rnd = Tokenizer.from_file(bpe.default_path()), bpe.load(bpe.default_path()), random.Random(3)
    for _ in range(400):
        t = "".join(rnd.choice(["th", "e", " ", "in", "'s", "<|endoftext|>", "\n", "é", "9", "Ω", ".", "\t", "\xa0", "²"]) for _ in range(rnd.randint(0, 80)))
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_verification_agrees_with_exact_merging():
    own, rnd = bpe.load(bpe.default_path()), random.Random(4)
    words = [bytes(rnd.choice(b"etaoinshrdlu") for _ in range(rnd.randint(1, 90))) for _ in range(2000)]
    assert own.encode_words(words) == [own._merge_long(w) for w in words] == [own._merge_short(w) for w in words]


# ---------------------------------------------------------------- op5, op9


def test_sketch_edits_and_order(docs):
    got = {r.doc_id: r for r in sketch.edited_pairs(docs.where("doc_id is null or doc_id != 7")).collect()}
    rows = sorted(((r.doc_id, r.text or "") for r in docs.where("doc_id != 7").collect()), reverse=True)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        third = len(t) // 3
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - third] + after[:third]).encode()).hexdigest()
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1
    same = [got[i].fingerprint for i, t in rows if t == prose(0, 60)]
    assert len(same) == 3 and len(set(same)) == 1
    assert got[None].n_chars == 17 and got[7 * 22].near_edited > 0.3


def brute_shingles(text, size=5):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    out = set()
    for k in range(max(0, len(words) - size) + 1 if words else 0):
        h = 42
        for w in words[k : k + size]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        out.add(h - (1 << 64) if h >> 63 else h)
    return out


def brute_sketch(shingles):
    limit = -(2**63) + 2**61
    below = sorted(h for h in shingles if h < limit)
    return below if len(below) >= sketch.LEAST else sorted(shingles)[: sketch.LEAST]


def brute_compare(a, b):
    limit, end = -(2**63) + 2**61, 2**63 - 1
    for s in (a, b):
        if len(s) >= sketch.LEAST:
            end = min(end, max(limit - 1, s[-1]))
    x, y = ({h for h in s if h <= end} for s in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0, len(x & y) / len(x) if x else None


def test_sketches_match_brute_force(docs):
    got = {r.doc_id: r for r in sketch.edited_pairs(docs.where("doc_id != 7")).collect()}
    rows = sorted(((r.doc_id, r.text or "") for r in docs.where("doc_id != 7").collect()), reverse=True)
    hexed = lambda s: "".join(f"{h & (2**64 - 1):016x}" for h in s)
    for k, (i, t) in enumerate(rows):
        after, third = rows[(k + 1) % len(rows)][1], len(t) // 3
        s, e, x = (brute_sketch(brute_shingles(v)) for v in (t, t[: len(t) - third] + after[:third], after))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (hexed(s), hexed(e))
        assert (got[i].near_edited, got[i].contained_edited) == brute_compare(s, e)
        assert (got[i].near_next, got[i].contained_next) == brute_compare(s, x)


def test_short_texts_are_told_apart_and_estimates_are_near(spark):
    rnd = random.Random(31)
    pairs = [(f"only one shingle {i}", f"another text number {i}") for i in range(20)] + [("", ""), ("", "x"), ("a b c d e f", "a b c d e g")]
    for n in (30, 300, 3000):
        for rate in (0.0, 0.02, 0.1):
            a = prose(rnd.random(), n).split()
            pairs.append((" ".join(a), " ".join(w if rnd.random() > rate else "new" for w in a)))
    pairs.append((prose(77, 200), prose(78, 9000) + " " + prose(77, 200)))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", sketch.sketch(F.col("a")).alias("s"), sketch.sketch(F.col("b")).alias("t"))
    rows = df.select("a", "b", "s", "t", sketch.jaccard(F.col("s"), F.col("t")).alias("j"), sketch.containment(F.col("s"), F.col("t")).alias("c"), sketch.merge(F.col("s"), F.col("t")).alias("m")).collect()
    for r in rows:
        x, y = brute_shingles(r.a), brute_shingles(r.b)
        assert (r.s, r.t, r.m) == (brute_sketch(x), brute_sketch(y), brute_sketch(x | y))
        want = len(x & y) / len(x | y) if x | y else 1.0
        assert r.j == pytest.approx(want, abs=1e-12 if len(x | y) < sketch.LEAST else 0.25)
        assert not x or r.c is None or abs(r.c - len(x & y) / len(x)) <= 0.25
    assert rows[-1].c == 1.0 and all(r.j == 0 for r in rows[:20])


def test_next_ids_over_sparse_ids(spark):
    ids = sorted({random.Random(k).randint(-(1 << 62), 1 << 62) for k in range(50)} | set(range(2000, 3100)))
    got = {r.id: r.next for r in sketch.next_ids(spark.createDataFrame([(i,) for i in ids], "id long")).collect()}
    assert got == {i: ids[k - 1] for k, i in enumerate(ids)}


def brute_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, at = (low + high) // 2, 1, 0
        for s in sizes:
            used, at = (used, at + s) if at + s <= mid else (used + 1, s)
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


def test_minimax_matches_brute_force():
    for seed in range(200):
        rnd = random.Random(seed)
        runs = sorted({rnd.randint(1, 60): rnd.randint(1, 6) for _ in range(rnd.randint(1, 9))}.items(), reverse=True)
        sizes, counts, shards = np.array([r[0] for r in runs]), np.array([r[1] for r in runs]), rnd.randint(1, 6)
        flat = np.repeat(sizes, counts)
        starts = np.concatenate([[0], np.cumsum(counts)])
        at = [0, *[int(starts[r]) + t for r, t in sharding.minimax(sizes, counts, shards)]]
        assert at[-1] == len(flat) and at == sorted(at)
        assert max(flat[a:b].sum() for a, b in zip(at, at[1:])) == brute_capacity(flat.tolist(), shards)


def test_shards_are_whole_and_gapless(docs, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 2)
    rows = sharding.shard_by_bytes(docs, 4).collect()
    assert len(rows) == docs.count()
    slots, of_text = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        of_text[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())
    one = next(r for r in rows if r.doc_id == 35)
    assert (one.size, one.text_crc32) == (len(prose(0, 60)) + 16, zlib.crc32(prose(0, 60).encode()))


# ---------------------------------------------------------------- op6


def test_language_is_learned_and_never_read(spark):
    rnd = random.Random(1)
    make = {"xx": ["ka", "lo", "mi", "pu", "re"], "yy": ["sch", "ung", "ein", "lich", "der"]}
    rows = [(i, " ".join("".join(rnd.choice(make[l]) for _ in range(rnd.randint(1, 3))) for _ in range(30)), l) for i in range(80) for l in [list(make)[i % 2]]]
    docs = spark.createDataFrame([*[(i, t, l if i % 5 else None) for i, t, l in rows], (900, None, "xx"), (901, "123 ... ½", "yy")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert all(got[i].lang_pred == l for i, _, l in rows)
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901)] == [("und", 0.0)] * 2
    kept = language_id.keep_identified(docs)
    assert kept.count() == 80 and kept.columns == docs.columns


def test_forward_sums_all_segmentations():
    vocab = language_id.load(language_id.default_path())
    prob = language_id.normalised(np.random.default_rng(0).random((vocab.size, 2)))
    index = {p: i for i, p in enumerate(vocab.pieces)}

    def brute(word):
        ways = [np.zeros(2)]
        for j in range(1, len(word) + 1):
            ends = [ways[k] + np.log(prob[index.get(word[k:j], vocab.size - 1)]) for k in range(max(0, j - vocab.longest), j) if word[k:j] in index or j - k == 1]
            ways.append(np.logaddexp.reduce(ends))
        return ways[-1]

    words = ["▁the", "▁international", "▁ça", "▁中文", "▁x", "▁" + "donaudampfschiff" * 9, "▁" + "中文" * 200, "▁" + "x" * 40_000]
    assert np.allclose(language_id.log_likelihood(vocab, words, prob), [brute(w) for w in words])
    assert vocab.longest == max(map(len, vocab.pieces)) == 16


def test_expected_counts_are_the_gradient_of_the_likelihood():
    vocab = language_id.load(language_id.default_path())
    prob = language_id.normalised(np.random.default_rng(1).random((vocab.size, 1)))
    length = np.array([*map(len, vocab.pieces), 1])
    for word in ("▁internationale", "▁" + "überraschung" * 8):
        used = language_id.expected_counts(vocab, [word], np.array([3.0]), prob)
        assert (used * length).sum() == pytest.approx(3 * len(word))
        for piece in np.flatnonzero(used)[:: max(1, np.count_nonzero(used) // 8)]:
            more = prob.copy()
            more[piece] *= 1 + 1e-6
            change = (language_id.log_likelihood(vocab, [word], more) - language_id.log_likelihood(vocab, [word], prob))[0, 0] / 1e-6
            assert 3 * change == pytest.approx(used[piece], rel=1e-3, abs=1e-4)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred != 'und'").collect()
    right = sum(r.lang == r.lang_pred for r in rows)
    assert len(rows) > 200 and right / len(rows) >= 0.99


# ---------------------------------------------------------------- op8, op10, op1


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), places


def test_license_scan(spark):
    texts = [None, "", "Released under the MIT License.", "Licensed under CC-BY-NC 4.0, under the mit\nlicense", "Apache License, Version 2.0", "GNU General Public License, version 3", "the license of this is any", "über Permission is hereby granted, free of charge, to any person obtaining a copy", "under the mit license " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    for i, t in enumerate(texts):
        n, places = brute_base(t)
        starts, labels = [p for p, _ in places], sorted({l for _, l in places})
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, len(places), min(starts, default=None), max(starts, default=None), ",".join(labels))
        assert set(labels) <= set(r.labels.split(",")) | {""}
    assert got[5].labels == "gpl-3" and got[6].labels == "" and got[7].labels == "mit"


def test_license_scan_finds_every_template_of_a_file():
    index, every = license_scan.Index(), [w for _, w, _ in license_scan.TEMPLATES]
    of = lambda label, k=0: [w for a, w, _ in license_scan.TEMPLATES if a == label][k]
    scan = lambda text: set(index.scan(license_scan.words_of(text.encode()))[1])
    assert scan(" . and so on . ".join(every)) == {label for label, _, _ in license_scan.TEMPLATES}
    for a, x, _ in license_scan.TEMPLATES:
        for b, y, _ in license_scan.TEMPLATES:
            assert scan(f"{x} or else {y}") >= {a, b}
    english = "the associated binary charge code conditions file files following form free copy general creative international documentation " * 300
    assert scan(english) == set()
    assert scan(f"{english} {of('mit', 1)} {english} {of('mpl-2')} {english} {of('gpl-3')} {english}") == {"mit", "mpl-2", "gpl-3"}
    for label, text, phrase in license_scan.TEMPLATES:
        assert scan(text) == {label}
        # words put in, left out or changed outside the key phrase
        words, key = license_scan.words_of(text.encode()), license_scan.words_of(phrase.encode())
        at = next(k for k in range(len(words)) if words[k : k + len(key)] == key)
        head, tail = words[:at], words[at + len(key) :]
        if len(words) > 20:
            assert scan(b" ".join([*head[: len(head) // 2], b"namely", b"here", *head[len(head) // 2 :], *key, b"also", *tail[:-1]]).decode()) == {label}
            assert label not in scan(b" ".join([*head, *key[:-1], b"something", *tail]).decode()) or len(key) < 3


def brute_scan(words):
    """Every start against every template, by the definition."""
    index, found = license_scan.Index(), {}
    for t in index.templates:
        for start in range(-len(t.words), len(words) + 1):
            agree = t.agreeing(start, words)
            if agree >= license_scan.AGREE:
                found[t.label] = max(found.get(t.label, 0.0), agree)
    return found


def test_license_labels_match_a_search_at_every_start():
    index, rnd = license_scan.Index(), random.Random(12)
    every = [license_scan.words_of(w.encode()) for _, w, _ in license_scan.TEMPLATES]
    for _ in range(60):
        words = [w.encode() for w in prose(rnd.random(), 10).split()]
        for part in rnd.sample(every, 2):
            words += [w for w in part if rnd.random() > rnd.choice([0.0, 0.1, 0.3])] + [b"word"] * rnd.randint(0, 9)
        assert set(index.scan(words)[1]) == set(brute_scan(words))


def brute_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return pii.ordered(out)


def test_base_spans_match_the_patterns():
    rnd = random.Random(2)
    for _ in range(5000):
        t = "".join(rnd.choice("a1@.+- ()25é") for _ in range(rnd.randint(0, 40)))
        assert pii.base_spans(t) == brute_spans(t)
    assert pii.base_spans("9" * 50_000 + "a" * 50_000 + "@" + "." * 1000 + "999." * 20_000) == []
    assert pii.base_spans("0" * 6000 + "7.1.2.3") == [("ip", 0, 6007)]


def test_crf_adds_and_leaves_clean_text_alone():
    crf = pii.train()
    spans = lambda t: [t[a:b] for _, a, b in pii.all_spans(crf, [t])[0][1]]
    assert spans("dial 415-555-2671.") == ["415-555-2671"]
    assert spans("mail jane.doe [at] example [dot] org soon") == ["jane.doe [at] example [dot] org"]
    assert spans("in 2024-01-15 at 10:30 we met 300-400 people for 4785380592391138") == []
    for text in ("020 7946 0958", "06 12 34 56 78", "jane at example dot com", "mary.jones at company dot co dot uk", "2001:db8:1234::99", "4111.1111.1111.1111", "8[.]8[.]8[.]8"):
        assert spans(f"it is {text} today") == [text]
    for text in ("we met at the dot com party", "pages 100 200 300 400", "id 1234567890", "RFC 2616 section 14.9.3", "12 13 14 15 16 17 18 19"):
        assert pii.all_spans(crf, [text])[0][1] == pii.base_spans(text)


def test_viterbi_is_the_best_of_all_label_sequences():
    from itertools import product

    crf, rnd = pii.train(), np.random.default_rng(3)
    sequences = [rnd.normal(size=(n, pii.LABELS)) * 3 for n in (1, 2, 3, 4)]
    for scores, path in zip(sequences, crf.viterbi(sequences)):
        value = lambda y: sum(scores[t, k] + crf.move[y[t - 1] if t else pii.LABELS, k] for t, k in enumerate(y))
        assert value(tuple(path)) == pytest.approx(max(map(value, product(range(pii.LABELS), repeat=len(scores)))))


def test_crf_on_lines_that_it_has_not_seen():
    lines, right, wanted, found = list(filter(None, pii.LABELLED.splitlines())), 0, 0, 0
    for fold in range(3):
        crf = pii.train("\n".join(x for k, x in enumerate(lines) if k % 3 != fold))
        for line in lines[fold::3]:
            text, want = pii.marked(line)
            got = [s for s in pii.crf_spans(crf, [text])[0] if pii.possible(s[0], text[s[1] : s[2]])]
            right, wanted, found = right + len(set(got) & set(want)), wanted + len(want), found + len(got)
    # forms that the other folds do not have at all are among them: 32 of 66 spans, 32 of 39 found are right
    assert right / wanted >= 0.45 and right / found >= 0.75, (right, wanted, found)


def test_crf_adds_nothing_to_the_documents_of_the_tables():
    import pyarrow.parquet as pq

    crf, texts = pii.train(), pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    assert all(own == every for own, every in pii.all_spans(crf, [t or "" for t in texts]))


def test_crf_finds_spans_at_cuts_and_of_any_length():
    crf = pii.train()
    spans = lambda t: [t[a:b] for _, a, b in pii.all_spans(crf, [t])[0][1]]
    for shift in range(12):
        numbers = [f"{200 + i % 700}-555-{1000 + i}" for i in range(400)]
        assert spans("x " * shift + "call " + " or call ".join(numbers)) == numbers
    for local, domain in (("jane.doe" * 8, "example [dot] org"), ("jane", "department" * 6 + " [dot] org"), ("jane", " [dot] ".join(["department"] * 9)), ("maria.luisa.fernandez.de.la.cruz.gomez", "x" * 40 + ".example.org")):
        address = f"{local} [at] {domain}"
        assert spans(f"mail {address} soon") == [address]
    text = "1" * 40 + " [at] " + "word " * 50 + "7" * 3 + " x" * 30
    assert all(a == 0 or text[a - 1].isspace() for a, _ in pii.windows(text)) and pii.windows("9" * 10**6) == [(0, 10**6)]


def test_pii_query_and_redaction(spark, docs):
    df = spark.createDataFrame([(1, "to a.b@c.de or +1 (476) 555-6291", 5), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    r = {x.doc_id: x for x in pii.find_personal_data(df).collect()}
    assert (r[1].n_email, r[1].n_phone, r[1].spans) == (1, 1, "email:3:11,phone:15:32")
    assert r[1].base_sha256 == hashlib.sha256(b"email:3:11,phone:15:32").hexdigest() and r[2].spans == ""
    out = {x.doc_id: x for x in pii.redact(df).collect()}
    assert out[1].text == "to [email] or [phone]" and out[1].n_chars == 21 and out[2].text is None and out[3].n_chars == 5


def test_url_rules_and_model(spark):
    urls = [None, "no scheme", "http://Www.Example.com/en/1?x#y", "https://blog.example.com/en/2", "ftp://x.example.com", "http://a.net/es/", "http://b.net/en/?q=/fr/", "http://notnet/fr/", "http://net/fr/1", "http://c.com/", "http://c.com?x=/"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(100 + i, f"http://good{i}.com/a/{i}") for i in range(60)] + [(300 + i, f"http://bad{i}.net/es/{i}") for i in range(60)]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(got) == len(rows)
    rules = {i: got[i].rule for i in range(len(urls))}
    assert rules == {0: None, 1: None, 2: "www.example.com/en/", 3: "example.com/en/", 4: None, 5: "net/es/", 6: None, 7: None, 8: "net/fr/", 9: "com/", 10: None}
    assert (got[2].host, got[2].path) == ("www.example.com", "/en/1") and (got[10].host, got[10].path) == ("c.com", "")
    assert all(got[i].verdict in ("allow", "block") for i in got)


def brute_difference(url, train):
    codes = lambda u: b"\x02" + u.split("://", 1)[-1].lower().encode() + b"\x03"
    counts = [defaultdict(int), defaultdict(int)]
    grams = lambda c: ((i, k, c[max(0, i - k) : i], k > i) for i in range(1, len(c)) for k in range(url_filter.ORDERS))
    for u, verdict in train:
        c = codes(u)
        for i, k, before, _ in grams(c):
            counts[verdict == "block"][k, before] += 1
            counts[verdict == "block"][k, before, c[i]] += 1
    c, total = codes(url), 0.0
    p = np.full((2, len(c)), 1 / 256)
    for i, k, before, _ in grams(c):
        for side in (0, 1):
            p[side, i] = (counts[side][k, before, c[i]] + url_filter.BACKOFF * p[side, i]) / (counts[side][k, before] + url_filter.BACKOFF)
    return float((np.log(p[0, 1:]) - np.log(p[1, 1:])).mean())


def test_url_model_keeps_every_gram_apart(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "POSITIONS", 500)
    rnd = random.Random(9)
    letters = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c) not in "#?/:") + "éß中"
    noise = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    train = [(f"http://a{i}.com/{noise(700)}", "allow") for i in range(60)] + [(f"http://b.net/es/{noise(700)}", "block") for i in range(60)]
    asked = [u[:300] for u, _ in train[::20]] + ["", "x", "Http://ABC.org/" + noise(200)]
    grams = url_filter.count_grams(spark.createDataFrame(train, "url string, verdict string"))
    got = {r.url: r.difference for r in url_filter.differences(spark.createDataFrame([(u,) for u in asked], "url string"), grams).collect()}
    assert grams.count() > 1 << 18
    assert got == {u: pytest.approx(brute_difference(u, train), abs=1e-9) for u in asked}


# ---------------------------------------------------------------- op2, op4


def test_leaks_tolerate_substitutions(spark):
    item = prose(50, 40).split()
    changed = ["other" if k % 8 == 3 else w for k, w in enumerate(item)]
    half = item[:20] + prose(51, 40).split()
    rows = [(1, prose(1, 30) + ", " + " ".join(item).upper() + " " + prose(2, 30)), (2, prose(3, 9) + " " + " ".join(changed)), (3, " ".join(half)), (4, prose(4, 200)), (5, None), (6, ""), (None, " ".join(item)), (1, "x")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    marks = spark.createDataFrame([(9, " ".join(item)), (8, "too short"), (7, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.overlap for r in decontaminate.find_leaks(docs, marks).collect()}
    assert got == {(1, 9): 1.0, (2, 9): pytest.approx(0.875), (None, 9): 1.0}
    kept = sorted((str(r.doc_id), r.text) for r in decontaminate.remove_leaks(docs, marks).collect())
    assert kept == sorted((str(i), t) for i, t in [rows[2], rows[3], rows[4], rows[5], (1, "x")])


def brute_overlap(text, item):
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) if w]
    a, b = words(text), words(item)
    return max((sum(0 <= at + k < len(a) and a[at + k] == w for k, w in enumerate(b)) / len(b) for at in range(-len(b), len(a) + 1)), default=0.0)


def test_leaks_match_every_diagonal_for_items_of_any_length(spark):
    rnd, items, texts = random.Random(21), {}, {}
    for n in [1, 2, 3, 4, *range(5, 13), 15, 20, 31, 44]:
        for k in range(4):
            words = prose(1000 * n + k, n).split()
            items[100 * n + k] = " ".join(words)
            changed = list(words)
            for p in rnd.sample(range(n), min(n, rnd.choice([n // 5, n // 5, n // 5 + 1]))):
                changed[p] = f"other{p}"
            # at the start, within and at the end of a text; and without an id
            around = [(0, 9), (7, 9), (7, 0)][k % 3]
            texts[100 * n + k] = " ".join([*prose(n + k, around[0]).split(), *changed, *prose(n - k, around[1]).split()])
            texts[100 * n + k + 50] = " ".join(changed[1:])
    docs = spark.createDataFrame([*texts.items(), (None, "a " + items[803])], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.overlap for r in decontaminate.find_leaks(docs, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    rows = [*texts.items(), (None, "a " + items[803])]
    want = {(i, j): o for i, t in rows for j, b in items.items() for o in [brute_overlap(t, b)] if o >= 0.8}
    assert got == pytest.approx(want) and (None, 803) in got


def test_leaks_of_benchmarks_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    item = prose(50, 40)
    docs = spark.createDataFrame([(i, f"{prose(i, 20)} {item}" if i % 2 else prose(i, 60)) for i in range(20)], "doc_id long, text string")
    got = decontaminate.find_leaks(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.overlap) for r in got) == [(i, 1.0) for i in range(1, 20, 2)]


def test_leaks_in_upper_case_of_other_letters(spark):
    item = "la niñez según él fue más difícil después también allá où l'été était à Москва это где жить ist größer für Äpfel öde über".split()
    rows = [(1, prose(1, 30) + " " + " ".join(item).upper().replace("SS", "ß") + " " + prose(2, 30)), (2, " ".join(item)), (3, prose(3, 60))]
    got = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.overlap) for r in got) == [(1, 1.0), (2, 1.0)]


def test_warc_round_trip(spark):
    html = "<html lang='x'><head><title> A  b </title><script>var t='</p>';</script></head><body><p>One &amp; <b>two</b></p><!-- no --><p>three</p></body></html>"
    rows = warc.derive(warc.responses(spark.createDataFrame([(1, "http://a/", html), (2, None, None)], "page_id long, url string, html string"))).collect()
    assert len(rows) == 4 and {r.refers_to for r in rows if r.page_id == 1} != {r.refers_to for r in rows if r.page_id == 2}
    text = next(r for r in rows if r.page_id == 1 and r.record_type == "conversion")
    assert text.block == "A b\nOne & two\nthree" and text.source_digest == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    for r in rows:
        (back,) = warc.parse(warc.serialize(r.asDict()))
        assert (back["block"], back["record_id"], back.get("refers_to")) == (r.block, r.record_id, r.refers_to)
        assert r.block_digest == "sha256:" + hashlib.sha256(back["block"].encode()).hexdigest()


def test_warc_text_keeps_comparisons_and_resolves_references(spark):
    cases = {
        "<p>3 < 4 and 5 > 2</p>": "3 < 4 and 5 > 2",
        "caf&eacute; &#233; &#xE9; &mdash; &amp;lt; &unknown; & &#0; &#xD800; &#1114112; &hearts; a&nbsp;b": "café é é — &lt; &unknown; & &#0; &#xD800; &#1114112; ♥ a b",
        "<!DOCTYPE html><a href='x'>y</a><br/>z<": "y\nz<",
        "no markup": "no markup",
        "": "",
    }
    html = "<HTML lang = 'Fr'><title>a &amp; b</title>"
    df = spark.createDataFrame([*enumerate(cases), (99, html)], "page_id long, html string").withColumn("url", F.lit("http://a/")).withColumn("payload", F.lit("clash")).withColumn("block", F.lit(1))
    got = {(r.page_id, r.record_type): r for r in warc.derive(warc.responses(df)).collect()}
    assert [got[i, "conversion"].block for i in range(len(cases))] == list(cases.values())
    assert got[99, "metadata"].block.startswith("title: a & b\r\nlang: fr\r\n")


def test_warc_ids_headers_and_files(spark, tmp_path):
    rows = [(1, "http://a/%41\r\nX: y", "<p>one</p>"), (1, "http://a/%41\r\nX: y", "<p>two</p>"), (2, "http://b/", "<p>long " + "x " * 200_000 + "</p>"), (3, "u", "same"), (3, "u", "same")]
    pages = spark.createDataFrame([(*r, "2024-05-06T00:00:00Z", "HTTP/1.1 200 OK\r\nServer: 50%") for r in rows], "page_id long, url string, html string, seen string, sent string")
    sources = warc.responses(pages, date="seen", headers="sent")
    assert sources.select("record_id").distinct().count() == 4
    out = warc.derive(sources)
    warc.write(out, str(tmp_path / "out"))
    members = [r.warc for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    back = [x for m in members for x in warc.parse(bytes(m))]
    key = lambda r: (r["record_id"], r["block_digest"])
    want = sorted((r.asDict() for r in out.collect()), key=key)
    for a, b in zip(sorted(back, key=key), want, strict=True):
        assert {k: a[k] for _, k in warc.HEADERS} | {"block": a["block"]} == {k: b[k] for _, k in warc.HEADERS} | {"block": b["block"]}
    # a file of responses, read back as records
    message = lambda r: f"{r.source_headers}\r\n\r\n{r.payload}".encode()
    raw = b"".join(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {r.record_id}\r\nWARC-Target-URI: http://x/\r\nWARC-Date: {r.date}\r\nContent-Length: {len(message(r))}\r\n\r\n".encode() + message(r) + b"\r\n\r\n" for r in sources.collect())
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc").write_bytes(raw)
    (tmp_path / "in" / "b.warc.gz").write_bytes(gzip.compress(raw[: len(raw)]))
    read = warc.read(spark, str(tmp_path / "in")).collect()
    assert sorted((r.record_id, r.payload, r.source_headers, r.source_digest, r.date) for r in read) == sorted(2 * [(r.record_id, r.payload, r.source_headers, r.source_digest, r.date) for r in sources.collect()])
    assert warc.derive(warc.read(spark, str(tmp_path / "in"))).count() == 20


def test_sql_is_given_for_registered_queries():
    from plumbline.llm.queries import QUERIES

    assert set(sql.ORACLES) <= set(QUERIES)


# ---------------------------------------------------------------- empty tables, the pipeline


def test_empty_tables(spark, empty):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    marks = spark.createDataFrame([], "item_id long, text string")
    frames = [
        url_filter.filter_urls(pages), decontaminate.find_leaks(empty, marks), simhash.near_duplicates(empty), warc.derive(warc.responses(pages)), sketch.edited_pairs(empty),
        language_id.identify(empty), bpe.encode_documents(empty), license_scan.scan_licenses(empty), sharding.shard_by_bytes(empty), pii.find_personal_data(empty),
    ]
    assert [f.count() for f in frames] == [0] * 10
    stages = [language_id.keep_identified(empty), simhash.keep_one(empty), decontaminate.remove_leaks(empty, marks), pii.redact(empty)]
    assert [(f.count(), f.columns) for f in stages] == [(0, empty.columns)] * 4


def test_stages_keep_columns_that_clash_with_their_own(spark, docs):
    names = ["_node", "_id", "_none", "_leak", "_text", "_stay", "hash", "lang_pred", "component"]
    wide = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    marks = spark.createDataFrame([(1, prose(3, 63))], "item_id long, text string")
    for stage in (language_id.keep_identified, simhash.keep_one, lambda d: decontaminate.remove_leaks(d, marks), pii.redact):
        rows = stage(wide).collect()
        assert rows and all(tuple(r)[-len(names) :] == tuple(range(len(names))) for r in rows)
    assert decontaminate.remove_leaks(wide, marks).count() == wide.count() - 1


def test_clashing_columns_repeats_and_long_texts(spark):
    long = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. " + prose(5, 120_000) + " mail a@b.org"
    texts = [long, long, None, "", "x" * 300_000, "the same text of a mail to a@b.org"] * 2
    extra = "words string, labels string, spans string, score double, held_out string, difference string, rule string, key long, chunk long, n long, host string, payload string, block string, _text string"
    values = ("w", "l", "s", 0.5, "h", "d", "r", 1, 2, 3, "o", "p", "b", "t")
    docs = spark.createDataFrame([(k // 2 if k < 11 else None, t, "en", *values) for k, t in enumerate(texts)], "doc_id long, text string, lang string, " + extra)
    assert license_scan.scan_licenses(docs).count() == pii.find_personal_data(docs).count() == language_id.identify(docs).count() == len(texts)
    assert sum("mit" in r.labels for r in license_scan.scan_licenses(docs).collect()) == 4
    assert sum(r.n_email for r in pii.find_personal_data(docs).collect()) == 6
    marks = spark.createDataFrame([(1, "the same text of a mail to a b org")], "item_id long, text string")
    assert sorted(str(r.doc_id) for r in decontaminate.find_leaks(docs, marks).collect()) == ["2", "None"]
    pages = spark.createDataFrame([(k // 2, "http://" + (t or "")[:100_000].replace(" ", "/"), t, *values) for k, t in enumerate(texts)], "page_id long, url string, html string, " + extra)
    assert url_filter.filter_urls(pages).count() == len(texts) and warc.derive(warc.responses(pages)).count() == 2 * len(texts)


def test_url_model_on_urls_that_it_has_not_seen(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    host, path = url_filter.host_and_path(F.col("url"))
    _, action = url_filter.rule_of(host, path)
    rows = pages.select("url", action.alias("verdict")).where("verdict is not null").distinct()
    fold = F.pmod(F.xxhash64("url"), F.lit(4))
    grams = url_filter.count_grams(rows.where(fold > 1)).cache()
    scored = lambda k: url_filter.differences(rows.where(fold == k), grams).join(rows, "url")
    threshold = url_filter.calibrate(scored(0))
    right = {r.verdict: r.right for r in scored(1).groupBy("verdict").agg(F.avg(((F.col("difference") >= threshold) == (F.col("verdict") == "allow")).cast("int")).alias("right")).collect()}
    assert min(right.values()) >= 0.9, right


def test_pipeline_keeps_the_columns_of_documents(spark):
    import corpus_pipeline
    from plumbline.llm.common import materialize, table

    d = "/root/testdata/sf0.001"
    docs = first = table(spark, d, "documents")
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, d))
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == first.columns
    assert 0 < counts[-1] <= first.count() and counts == sorted(counts, reverse=True)
