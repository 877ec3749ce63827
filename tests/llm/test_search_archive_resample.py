from __future__ import annotations

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from leafmill.llm import lexical, resample, terms, warc

TERM = re.compile(terms.TERM)
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, source string, weight string, query string, rank string, _row string"


def frame(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "s", "clash", "clash", "clash", "clash") for i, t in rows], SCHEMA)


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def corpus(seed, n=250):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "日本", "a1b", "İ"]
    rows = [(i, " ".join(r.choices(vocabulary, k=r.choice([0, 1, 5, 20, 40, 120])))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "!? -- ..."), (n + 3, "w1,W1;w2 " * 4000), (None, "w1 w2 w3 " * 10), (n + 4, "twin w9 " * 15), (n + 5, "twin w9 " * 15), (n + 5, "twin w9 " * 15)]
    return rows, r


def test_terms():
    text = "Ab-c9_Ünï x Ｅ İ\x7fend\ttab[q]`z{}"
    assert [t.decode() for t in terms.terms_of(text)] == words(text)
    many = ("aZ09 é" * 1000).encode().translate(terms._BYTES)
    assert [t for piece in terms._pieces(many, 64) for t in piece] == many.split()


def brute_search(docs, items, k=10):
    held = [(i, words(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n, length = len(held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for i, w in held:
            tf, m = Counter(w), 100 - 75 + (75 * len(w) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in words(text) if t in tf)
            scored += [(-s, i is None, i or 0)] if s > 0 else []
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_search_is_that_of_brute_force(spark, seed, monkeypatch):
    rows, r = corpus(seed)
    items = [(q, " ".join(r.choices([f"w{i}" for i in range(60)], k=12))) for q in range(20)] + [(20, None), (21, "nowhere"), (22, "twin TWIN twin"), (None, "日本 Ünï"), (3, "w1 w1")]
    queries = spark.createDataFrame([(i, t, "clash", "clash") for i, t in items], "item_id long, text string, query string, doc_id string")
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", 7)
    index = lexical.build_index(frame(spark, rows).repartition(5))
    found = lexical.ranked_search(index, queries)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == brute_search(rows, items)


def test_search_by_many_shards(monkeypatch):
    rows, _ = corpus(3, 60)
    shards, shard = [], lexical.Shard()
    monkeypatch.setattr(lexical, "SHARD_DOCS", 7)
    for i, t in rows:
        w = shard.vocabulary.ids((t or "").encode().translate(terms._BYTES))
        if len(w):
            shard.add(i, w)
        if shard.full():
            shards.append(shard.row(50, 5000))
            shard = lexical.Shard()
    assert len(shards) > 4 and all(len(s[4]) == 7 * 8 for s in shards)


def test_search_of_nothing(spark):
    rows, _ = corpus(4, 5)
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical.ranked_search(lexical.build_index(frame(spark, [])), items).collect() == []
    assert lexical.ranked_search(lexical.build_index(frame(spark, rows)), items.where("false")).collect() == []


def test_suffix_runs_are_all_ngrams():
    r = random.Random(5)
    texts = [[r.choice("abc") for _ in range(r.choice([0, 1, 2, 7, 30]))] for _ in range(40)]
    number = {w: i for i, w in enumerate("abc")}
    ids = resample.np.array([number[w] for t in texts for w in t], resample.np.int32)
    sizes = [len(t) for t in texts]
    ends = resample.np.repeat(resample.np.cumsum(sizes), sizes)
    for d, (place, code) in enumerate(resample.bucket_rows(ids, ends, [b"a", b"b", b"c"], 4, 97), 1):
        wanted, at = {}, 0
        for t in texts:
            wanted |= {at + i: zlib.crc32(" ".join(t[i : i + d]).encode()) % 97 for i in range(len(t) - d + 1)}
            at += len(t)
        assert dict(zip(place.tolist(), code.tolist(), strict=True)) == wanted


def brute_resample(docs, target, longest=1, buckets=10_000, percent=10, least=20):
    features = lambda t: [zlib.crc32(" ".join(w[i : i + d]).encode()) % buckets for w in [words(t)] for d in range(1, longest + 1) for i in range(len(w) - d + 1)]
    s, t = Counter(b for _, x in docs for b in features(x)), Counter(b for x in target for b in features(x))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in s}
    rows = []
    for i, x in docs:
        f = features(x)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    able = sorted((x for x in rows if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    for k, x in enumerate(able[: len(able) * percent // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in rows), key=str)


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_is_that_of_brute_force(spark, longest, monkeypatch):
    rows, _ = corpus(6)
    rows += [(400, "same text of w1 w2 " * 8)] * 30 + [(None, "w5 " * 30)] * 5
    target = ["w1 w2 w3 w1 w2", None, "", "Ünï w7"]
    monkeypatch.setattr(resample, "RANGE_ROWS", 40)
    out = resample.resampled(frame(spark, rows).repartition(4), spark.createDataFrame([(t,) for t in target], "text string"), longest=longest)
    got = out.select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == brute_resample(rows, target, longest)


def test_resampling_without_rows(spark):
    rows, _ = corpus(7, 20)
    assert resample.resampled(frame(spark, []), frame(spark, rows)).collect() == []
    out = resample.resampled(frame(spark, rows), frame(spark, []).select("text"), percent=100).collect()
    assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, sum(len(words(t)) >= 20 for _, t in rows) + 1))


def page_rows():
    r = random.Random(8)
    long = ["<p>" + "".join(r.choices("abcdef <>\n", k=1500)) + "</p>" for _ in range(4)]
    urls = ["http://a.example/x", "http://A.example:80/x", "https://b.example/y?q=1", "no url", None, "http://c.example/\r\nX: y z"]
    rows = [(i, r.choice(urls), r.choice([*long, "short", "short", f"own {i}" * 300])) for i in range(120)]
    inner = "<a>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 60 + warc.BETWEEN.decode("latin-1")
    rows += [(200, "http://z.example", inner), (201, "http://z.example", inner), (202, urls[0], None), (203, urls[0], ""), (204, urls[2], "é" * 500), (205, urls[2], "é" * 500), (206, urls[2], "é" * 499)]
    return rows + [(None, urls[0], long[0]), (207, urls[0], long[0]), (207, urls[0], long[0]), (None, urls[1], "n" * 2000), (None, urls[1], "n" * 2000), (208, urls[0], "x" * 3_000_000)]


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_archives_hold_every_page(spark, broadcast, monkeypatch, tmp_path):
    rows = page_rows()
    monkeypatch.setattr(warc, "RANGE_ROWS", 30)
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, sha1 string, response string").repartition(3)
    path = f"file://{tmp_path}/archives"
    warc.write_archives(pages, path, broadcast)
    merged = warc.merged_captures(warc.capture_runs(spark, path))
    got = merged.collect()
    last = defaultdict(list)
    for i, _, h in rows:
        last[h or ""].append(i)
    wanted = []
    for i, _, h in rows:
        data = (h or "").encode()
        top = max((x for x in last[h or ""] if x is not None), default=None)
        again = len(data) >= 1000 and top is not None and (i is None or i < top)
        wanted.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None))
    assert sorted(map(tuple, merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == sorted(wanted, key=str)
    assert [(r["url_key"], r["captured"]) for r in got] == sorted((r["url_key"], r["captured"]) for r in got)
    assert merged.rdd.getNumPartitions() > 2
    # The files themselves are plain gzip, and a record can be read by its place.
    files = {p.name: p.read_bytes() for p in (tmp_path / "archives").glob("part-*")}
    assert sum(gzip.decompress(f).count(b"WARC/1.1\r\nWARC-Type") for f in files.values()) == len(rows)
    for r in got[:20]:
        one = gzip.decompress(files[r["archive"]][r["at"] : r["at"] + r["length"]])
        assert warc.parsed(one)["payload_digest"] == r["payload_digest"]


def test_archives_of_nothing(spark):
    assert warc.archived_captures(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_broken_archives_are_refused():
    good = warc.record(1, "http://a.example", "2024-01-01T00:00:00Z", hashlib.sha1(b"abc").hexdigest(), b"abc", None)
    assert warc.parsed(good)["page_id"] == 1
    with pytest.raises(ValueError, match="digest"):
        warc.parsed(good.replace(b"\r\n\r\nabc", b"\r\n\r\nabd"))
    with pytest.raises(ValueError, match="cut short"):
        warc.parsed(good[:-5])
    with pytest.raises(ValueError, match="ends within"):
        list(warc.members(warc.member(good)[:-3]))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    r = random.Random(k)
    runs = [sorted((r.randrange(50), j) for _ in range(r.choice([0, 1, 20]))) for j in range(k)]
    assert list(warc.loser_tree([iter(x) for x in runs])) == sorted(y for x in runs for y in x)


def test_url_keys():
    assert warc.url_key("http://User@www.Example.com:80/A?b=C#f") == "com,example,www)/a?b=c"
    assert warc.url_key("https://x.org:8443") == "org,x:8443)/"
    assert [warc.url_key(u) for u in ("", "not a url", "http://[bad")] == ["", "not a url", "http://[bad"]
