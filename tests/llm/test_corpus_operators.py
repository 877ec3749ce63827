from __future__ import annotations

import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.llm import ann, components, labelled, ngram_join, pieces, quality_fm, toxicity

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    words = (text or "").translate(LOWER).encode().split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < 5 else frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            shared = len(a & b)
            if a and b and 100 * shared >= 80 * (len(a) + len(b) - shared):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_texts(seed):
    """Groups of copies from light to heavy edits, passages that many share, short and odd texts."""
    r = random.Random(seed)
    words = [f"v{i}" for i in range(5000)]
    fresh = lambda k: [r.choice(words) for _ in range(k)]
    texts = []
    for _ in range(4):
        base = fresh(r.choice([12, 60, 150]))
        for _ in range(25):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
                t[r.randrange(len(t))] = r.choice(words)
            texts.append(" ".join(t[: len(t) - r.choice([0, 0, 0, 1, 5])]))
    passage = fresh(40)
    for _ in range(25):
        t = fresh(r.choice([5, 30, 100]))
        at = r.randrange(len(t))
        texts.append(" ".join(t[:at] + passage + t[at:]))
    texts += [" ".join(fresh(r.choice([1, 2, 4, 5, 30]))) for _ in range(30)]
    texts += ["one two three", "ONE  two\tthree", "one two three four", "", " \n", None, "É a b c d", "é a b c d", "z " * 3000, "z " * 9]
    r.shuffle(texts)
    return list(enumerate(texts))


def test_near_duplicates_against_brute_force(spark):
    for seed in (1, 2, 3):
        texts = near_texts(seed)
        d = spark.createDataFrame([(i, t, "clash", 0) for i, t in texts], "doc_id long, text string, component_id string, n long")
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(d).collect()}
        assert got == brute_components(texts)
    kept = ngram_join.one_of_each(d)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in got.values()})


def test_near_duplicates_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None), (3, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(d).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (None, 0, None), (None, 2, None)], key=str)
    assert ngram_join.near_duplicates(d.where("false")).count() == 0


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(200, 260)]
    got = {x["node"]: x["component"] for x in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {i: i for e in edges for i in e}
    for _ in range(100):
        for u, v in edges:
            parent[u] = parent[v] = min(parent[u], parent[v])
    assert got == {i: parent[i] for i in {i for u, v in edges if u != v for i in (u, v)}}


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16))
    rows = [(i, [float(v) for v in x[i]]) for i in range(600)]
    rows += [(600, None), (650, [0.0] * 16), (700, [float("nan")] * 16), (750, [1.0, None] + [0.0] * 14), (800, [float("inf")] * 16), (850, [1.0, 2.0]), (601, rows[0][1]), (602, rows[0][1])]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, score string")
    got = defaultdict(dict)
    for r in ann.nearest(d, F.col("vec_id") % 50 == 0).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    ids = np.array([*range(600), 601, 602])
    y = np.vstack([x, x[:1], x[:1]])
    u = y / np.linalg.norm(y, axis=1, keepdims=True)
    hits = 0
    assert set(got) == set(range(0, 600, 50))
    for q in got:
        cos = u[q] @ u.T
        order = [int(ids[k]) for k in np.lexsort((ids, -cos.round(12))) if ids[k] != q][:5]
        found = [got[q][k][0] for k in range(1, 6)]
        hits += len(set(order) & set(found))
        assert all(abs(got[q][k][1] - cos[list(ids).index(got[q][k][0])]) < 1e-12 for k in range(1, 6))
    assert hits / (5 * len(got)) >= 0.9
    assert [got[0][k][0] for k in (1, 2)] == [601, 602]
    short = d.union(spark.createDataFrame([(i, [1.0, float(i)], "") for i in (1000, 1001, 1050, 1100)], d.schema))
    of = [(r["rank"], r["vec_id"]) for r in ann.nearest(short, F.col("vec_id") == 1050).collect()]
    assert sorted(of) == [(1, 1100), (2, 1001), (3, 1000), (4, 850)]
    copies = spark.createDataFrame([(i % 300, [1.0, 2.0, 3.0]) for i in range(900)] + [(7, [3.0, 2.0, 1.0])], "vec_id long, embedding array<float>")
    many = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(copies, F.col("vec_id") % 100 == 0).collect())
    assert many == [(q, i + 1, v) for q in (0, 100, 200) for i, v in enumerate([1, 1, 1, 2, 2] if q == 0 else [0, 0, 0, 1, 1])]
    few = ann.nearest(d.where("vec_id < 3"), F.lit(True)).collect()
    assert len(few) == 6
    assert ann.nearest(d.where("false"), F.lit(True)).count() == 0


def test_radius_is_complete():
    """Every code within the pigeonhole radius is retrieved, each pair at one substring and in one part only."""
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 1 << 16, (400, ann.SUBSTRINGS), dtype=np.uint16)
    queries = rows[:20].copy()
    for i in range(20):
        for b in rng.choice(ann.SUBSTRINGS * ann.BITS, 10 * i, replace=False):
            queries[i, b // ann.BITS] ^= np.uint16(1 << (b % ann.BITS))
    far = np.full(len(queries), ann.SUBSTRINGS * ann.BITS)
    apart = np.bitwise_count(queries[:, None] ^ rows[None])
    for s in (0, 3):
        prefix = rows >> (ann.BITS - s)
        parts = [(j, p, np.flatnonzero(prefix[:, j] == p)) for j in range(ann.SUBSTRINGS) for p in range(1 << s)]
        earlier = set()
        for f in range(ann.FLIPS + 1):
            flips = np.full(len(queries), f)
            made = [(int(x), int(at[y])) for j, p, at in parts for i, k in ann.Postings(rows[at], j, s, p).pairs(queries, flips, flips - 1, far) for x, y in zip(i, k, strict=True)]
            assert len(made) == len(set(made)) and not earlier & set(made)
            earlier |= set(made)
            assert earlier == {(int(x), int(y)) for x, y in np.argwhere((apart <= f).any(2))}
            within = np.argwhere(apart.sum(2, dtype=int) <= ann.SUBSTRINGS * (f + 1) - 1)
            assert len(within) and {(int(x), int(y)) for x, y in within} <= earlier


def test_index_splits_heavy_parts(spark, monkeypatch):
    """Many rows and queries with one code, parts split in both directions: the pairs are those of a plain loop."""
    monkeypatch.setattr(ann, "ROWS", 40)
    monkeypatch.setattr(ann, "QUERIES", 7)
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 16, (300, ann.SUBSTRINGS), dtype=np.uint16)
    codes[:150] = codes[0]
    table = spark.createDataFrame([(i, c.tobytes()) for i, c in enumerate(codes)], "id long, code binary")
    asking = table.where("id % 10 = 0").select("id", "code", F.lit(2).alias("flips"), F.lit(-1).alias("seen"), F.lit(ann.SUBSTRINGS * ann.BITS).alias("reach"))
    for s in (0, 2, 5):
        index = ann.postings(table, s)
        got = sorted(map(tuple, ann._retrieved(asking, index, s, ann._heavy(index, ann.ROWS, "wide")).collect()))
        near = (np.bitwise_count(codes[::10, None] ^ codes[None]) <= 2).any(2)
        assert got == [(int(q) * 10, int(r)) for q, r in np.argwhere(near)]


def test_code_distance_falls_as_the_table_grows_beyond_its_sample(spark):
    """Where a sample holds less than one of a row's k nearest, the distance follows the number of rows still."""
    x = np.random.default_rng(4).normal(size=(700, 64))
    rows = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(x)], "ca long, cb long, embedding array<double>")
    far = [ann.fit_index(rows, 64, 5, n * len(x))[1] for n in (1, 5, 30)]
    assert far[0] > far[1] > far[2] > 0


def test_close_neighbours_read_few_postings(spark):
    """Queries with near copies are done after one flip, which reads a small share of the postings, and no block is compared whole."""
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(300, 64)), 8, axis=0)
    x += 0.1 * rng.normal(size=x.shape)
    rows = spark.createDataFrame([(i, v.tolist(), [i]) for i, v in enumerate(x)], "id long, embedding array<double>, ids array<long>")
    index = ann.fit_index(rows.withColumnsRenamed({"id": "ca"}).withColumn("cb", F.col("ca")), 64, 5, len(x))
    queries = rows.where("id % 50 = 0")
    found = ann.found_by_codes(queries, rows, 5, index)
    assert found.count() == 48 * 6 and found.where("q div 8 = r div 8").count() == 48 * 6
    assert index[2] == 1 and ann._next(ann._ends(found, ann.coded(queries, index), 5), index[1], 1).isEmpty()
    codes = ann.codes_of(ann._unit(x), index[0])
    read = sum(len(q) for j in range(ann.SUBSTRINGS) for q, _ in ann.Postings(codes, j).near(codes[::50], np.ones(48, int)))
    assert read < 0.1 * 48 * len(x)


TOXIC = ["trashy", "blorgus", "snivel"]


def labelled_texts(seed=0, n=500):
    r = random.Random(seed)
    usual = [a + b for a in "the of and re on in at er st".split() for b in ["", "en", "ing", "ly", "ou"]]
    rows, marks = [], []
    for i in range(n):
        words = r.choices(usual, k=r.randint(20, 120))
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(TOXIC))
        junk = i % 5 == 0
        text = " ".join(w.upper() + "!!" if junk else w for w in words)
        rows.append((i, text, "clash"))
        marks.append((i, 0 if junk else 1, int(bad)))
    return rows + [(n, None, ""), (n + 1, "", ""), (n + 2, "\n", ""), (n + 3, "word " * 30_000, "")], marks


def test_odd_rows_score_and_encode(spark):
    """Null and repeated ids, copies, null and very long texts, extra columns: a row out for each row in, copies alike."""
    rows, marks = labelled_texts(4, 200)
    odd = [(None, None, ""), (None, "a b", ""), (5, "trashy word", ""), (5, "trashy word", ""), (5, "other", ""), (9, "é" * 200_000, ""), (10, "w " * 200_000, "")]
    d = spark.createDataFrame(rows + odd, "doc_id long, text string, score string")
    m = spark.createDataFrame([*marks, (5, 1, 0), (5, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for f in (toxicity.toxicity_scores, quality_fm.quality_scores):
        out = f(d, m).collect()
        assert len(out) == len(rows) + len(odd) and not any(r["held_out"] for r in out if r["doc_id"] is None)
        assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in out)
        again = sorted((str(r["doc_id"]), r["score"]) for r in f(d, m).collect())
        assert again == sorted((str(r["doc_id"]), r["score"]) for r in out)
    got = pieces.sampled_pieces(d).collect()
    assert len(got) == len(rows) + len(odd) and all(r["lossless"] for r in got if r["ids"] is not None)
    assert sum(r["ids"] is None for r in got) == 2
    twins = [tuple(r["ids"]) for r in got if r["doc_id"] == 5]
    assert max(twins.count(x) for x in twins) >= 2


def accuracy(out, marks, at):
    truth = {i: m for i, *m in marks}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert held
    return sum(r["predicted"] == truth[r["doc_id"]][at] for r in held) / len(held)


def test_classifiers(spark):
    rows, marks = labelled_texts()
    d = spark.createDataFrame(rows, "doc_id long, text string, score string")
    m = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    for f, at in ((toxicity.toxicity_scores, 1), (quality_fm.quality_scores, 0)):
        out = f(d, m).collect()
        assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
        assert accuracy(out, marks, at) >= 0.95
        assert f(d.where("false"), m).count() == 0
        assert {r["score"] for r in f(d, m.where("false")).collect()} == {0.0}
    model = toxicity.learn_toxicity(d, m)
    kept = {r["doc_id"] for r in toxicity.without_toxic(d, model).collect()}
    assert {500, 501, 502, 503} <= kept and len(kept & {i for i, _, t in marks if t}) <= 10


def test_machine_identity():
    rng = np.random.default_rng(2)
    d = len(quality_fm.STATISTICS)
    m = quality_fm.Machine(0.3, rng.normal(size=quality_fm.BUCKETS + d), rng.normal(size=(quality_fm.BUCKETS + d, 4)), np.zeros(d), np.ones(d))
    b, x, dense = np.array([3, 77, 500]), np.array([0.5, 0.2, 0.7]), rng.normal(size=(1, d))
    at = np.concatenate([b, np.arange(d) + quality_fm.BUCKETS])
    full = np.concatenate([x, dense[0]])
    slow = m.w0 + m.w[at] @ full + sum(m.v[at[i]] @ m.v[at[j]] * full[i] * full[j] for i in range(len(at)) for j in range(i))
    assert abs(m.raw(np.array([0, 3]), b, x, dense)[0] - slow) < 1e-9


def test_held_out(spark):
    import zlib

    got = {r["id"]: r["h"] for r in spark.range(50).select("id", labelled.held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}


def toy_lattice():
    plain = {3: b"ab", 4: b"a", 5: b"b", 6: b" ", 7: b" a", 8: b"abc", 9: b"c", 10: "é".encode()}
    return plain, pieces.build_lattice(plain, list(range(100, 356)))


def test_sampling_follows_the_lattice():
    plain, z = toy_lattice()
    text = b"abc"
    ways = {(8,): z.weight[8], (3, 9): z.weight[3] * z.weight[9], (4, 5, 9): z.weight[4] * z.weight[5] * z.weight[9]}
    n = 20_000
    raw = np.frombuffer(text * n, np.uint8)
    ids, counts = pieces.encode_bytes(raw, np.arange(n + 1) * 3, np.arange(n), z, 1)
    at = np.concatenate([[0], np.cumsum(counts)])
    seen = Counter(tuple(int(x) for x in ids[at[i] : at[i + 1]]) for i in range(n))
    assert set(seen) == set(ways)
    for w, p in ways.items():
        assert abs(seen[w] / n - p / sum(ways.values())) < 0.02


def test_long_units_follow_the_lattice():
    """Units of 30 and 70 bytes: every piece's share at each place is that of all segmentations."""
    plain, z = toy_lattice()
    r = random.Random(5)
    for n in (30, 70, 300):
        text = bytes(r.choice(b"abc") for _ in range(n))
        first, running, size, ids = pieces._filtered(np.frombuffer(text, np.uint8), np.array([0]), np.array([n]), z)
        alpha = [1.0] + [0.0] * n
        for e in range(1, n + 1):
            share = {i: z.weight[i] * alpha[e - len(b)] for i, b in plain.items() if text[:e].endswith(b)}
            alpha[e] = sum(share.values())
            got = {int(ids[m]): running[m] - (running[m - 1] if m > first[e - 1] else e - 1) for m in range(first[e - 1], first[e])}
            assert set(got) == set(share) and all(abs(got[i] - share[i] / alpha[e]) < 1e-9 for i in share)
            if alpha[e] < 1e-100:
                alpha = [x / alpha[e] for x in alpha]


def test_pieces_of_a_million_bytes_without_space():
    z = pieces.lattice_of()
    r = random.Random(6)
    text = "".join(r.choice("etaoinshrdlué界") for _ in range(900_000)).encode()
    assert len(text) > 1_000_000
    raw = np.frombuffer(text, np.uint8)
    ids = pieces.encode_long(raw, np.array([3]), z, 1)
    assert pieces.decode_ids(ids, z).tobytes() == text
    assert (z.offset[ids + 1] - z.offset[ids]).max() > 3
    spaced = np.frombuffer(b" ".join([text[:0], b"w" * 200, b"a bc  d", b"xyz" * 9]) * 9, np.uint8)
    whole = pieces.encode_bytes(spaced, np.array([0, len(spaced)]), np.array([3]), z, 1)[0]
    parts = [pieces.encode_bytes(spaced[a:b], np.array([0, b - a]), np.array([3]), z, 1, a)[0] for a, b in pieces.stretches(spaced, True, 50)]
    assert len(parts) > 5 and np.array_equal(whole, np.concatenate(parts))


def test_pieces_round_trip_and_seed(spark):
    texts = ["ab abc", "", None, "é漢字 \n\t<s> ▁ a", "a" * 5000, " " * 50 + "x", "\x00\x7f", "ab abc"]
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    one = pieces.sampled_pieces(d)
    rows = {r["doc_id"]: r for r in one.collect()}
    assert all(r["lossless"] and r["n_tokens"] == len(r["ids"]) for i, r in rows.items() if texts[i] is not None)
    assert rows[2]["ids"] is None and rows[1]["ids"] == []
    assert {r["doc_id"]: r["text"] for r in pieces.decoded(one).collect()} == dict(enumerate(texts))
    again = {r["doc_id"]: r["ids"] for r in pieces.sampled_pieces(d.repartition(3)).collect()}
    assert again == {i: r["ids"] for i, r in rows.items()}
    other = {r["doc_id"]: r["ids"] for r in pieces.sampled_pieces(d, seed=9).collect()}
    assert other != again
    assert pieces.sampled_pieces(d.where("false")).count() == 0


def plain_toxicity(model, text):
    """Score and largest evidence, from the compressed length of every word, one word at a time."""
    ordinary, toxic = toxicity.compressor(model.ordinary), toxicity.compressor(model.toxic)
    words = (text or "").translate(LOWER).encode().split()
    if not words:
        return 0.0, 0.0
    found = []
    for w in words:
        raw = np.frombuffer(w, np.uint8)
        window = toxicity.word_windows(raw, np.array([0]), np.array([len(w)]))[0]
        a, b = len(ordinary.compress(window)), len(toxic.compress(window))
        found.append(model.evidence[min(a, toxicity.LENGTHS - 1) * toxicity.SAVINGS + min(max(a - b + toxicity.SAVINGS // 2, 0), toxicity.SAVINGS - 1)])
    x = [max(0, *found), np.log1p(sum(max(v - np.log(toxicity.NEED), 0) for v in found)), np.log1p(len(words))]
    return 1 / (1 + np.exp(-np.clip(np.dot(x, model.weights[:3]) + model.weights[3], -30, 30))), x[0]


def test_toxicity_is_that_of_plain_lengths(spark):
    rows, marks = labelled_texts(3, 300)
    rows = [*rows, (0, rows[0][1], ""), (None, rows[1][1], ""), (7, "trashy", ""), (8, "a\tb\x0bc \r d" * 9, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = toxicity.learn_toxicity(d, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    got = toxicity.scored(d, model).select("_doc.text", "score", "distance").collect()
    assert len(got) == len(rows)
    for r in got:
        score, most = plain_toxicity(model, r["text"])
        assert abs(r["score"] - score) < 1e-9 and abs(r["distance"] - most) < 1e-9


def test_words_are_found_and_remembered(monkeypatch):
    raw = np.frombuffer(b" one  Two\nthree", np.uint8)
    digest, row, starts, sizes = toxicity.word_spans(raw, np.array([0, 6, 6, len(raw)]))
    assert list(row) == [0, 2, 2] and list(starts) == [1, 6, 10] and list(sizes) == [3, 3, 5]
    assert [len(w) for w in toxicity.word_windows(raw, starts, sizes)] == [16, 16, 32]
    table = np.random.default_rng(0).normal(size=toxicity.LENGTHS * toxicity.SAVINGS)
    texts = pa.array([" ".join(f"w{i * j % 97}" for j in range(50)) for i in range(40)] + [None, ""])
    whole = toxicity.Evidence(b"w1" * 50, b"w2" * 50, table).features(texts)
    monkeypatch.setattr(toxicity, "REMEMBERED", 5)
    forgetful = toxicity.Evidence(b"w1" * 50, b"w2" * 50, table)
    parts = np.vstack([forgetful.features(texts.slice(i, 7)) for i in range(0, 42, 7)])
    assert np.allclose(whole, parts) and not whole[40:].any()


def brute_class_links(texts):
    sets = defaultdict(list)
    for i, t in texts:
        sets[shingles(t)].append(i)
    near = lambda a, b: a != b and 100 * len(a & b) >= 80 * len(a | b)
    return {i: (min(ids), sum(near(s, z) for z in sets if s and z)) for s, ids in sets.items() if s for i in ids}


def near_copies(seed, groups=4, rows=40):
    """Groups of differing near copies, all of which share columns."""
    r = random.Random(seed)
    texts = []
    for g in range(groups):
        base = [f"g{g}w{k}" for k in range(r.choice([60, 100, 200]))]
        for _ in range(rows):
            t = list(base)
            for _ in range(r.choice([0, 1, 1, 2])):
                t[r.randrange(len(t))] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(t))
    r.shuffle(texts)
    return list(enumerate(texts))


def test_every_link_is_counted(spark, monkeypatch):
    for seed, block in ((1, 1024), (2, 16)):
        monkeypatch.setattr(ngram_join, "BLOCK", block, raising=False)
        texts = near_copies(seed) + [(1000 + i, t) for i, t in near_texts(seed)]
        d = spark.createDataFrame(texts, "doc_id long, text string")
        out = ngram_join.near_duplicates(d).collect()
        want = brute_class_links(texts)
        assert {r["doc_id"]: (r["class_id"], r["class_links"]) for r in out if r["n_shingles"]} == want
        assert max(k for _, k in want.values()) > 20
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_components(texts)


def test_near_copies_of_a_set_first_met_without_id(spark):
    words = [f"w{k}" for k in range(60)]
    text, near = " ".join(words), " ".join(words[:-1])
    d = spark.createDataFrame([(None, text), (5, text), (6, near)], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: (r["component_id"], r["class_links"]) for r in ngram_join.near_duplicates(d).collect()}
    assert got[5] == (5, 1) and got[6] == (5, 1)
    assert {r["doc_id"] for r in ngram_join.one_of_each(d).where("doc_id is not null").collect()} == {5}


def test_one_row_of_each_group_stays(spark):
    words = [f"w{k}" for k in range(60)]
    t, near, v, u = " ".join(words), " ".join(words[:-1]), "another text of six words here", "a text without any id at all"
    rows = [(5, t), (5, t), (9, t), (9, v), (7, near), (None, t), (None, u), (None, u), (None, None), (3, None), (3, None), (4, "z y x w v u")]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, component string")
    kept = ngram_join.one_of_each(d)
    assert kept.columns == d.columns
    want = [(5, t), (9, v), (None, u), (None, None), (3, None), (4, "z y x w v u")]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)
    assert ngram_join.one_of_each(d.where("false")).count() == 0
    got = {(r["doc_id"], r["class_links"]) for r in ngram_join.near_duplicates(d).collect() if r["doc_id"] in (5, 7, 9)}
    assert got == {(5, 1), (7, 1), (9, 1), (9, 0)}


@pytest.mark.parametrize(("folder", "least", "most"), [("sf0.1", 0.85, 0.01), ("sf0.01", 0.6, 0.02)])
def test_toxicity_finds_held_out_documents(spark, folder, least, most):
    """The figures of the README: the recall and the share of false alarms over the held-out rows."""
    sf_dir = f"/root/testdata/{folder}"
    if not Path(sf_dir).exists():
        pytest.skip("no test tables here")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = toxicity.toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels).join(labels, "doc_id").where("held_out")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= least * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= most * (n[0, 0] + n.get((0, 1), 0))
