from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from leafmill.llm import chat, mixing, quality_rules, sharding, url_filter

SCHEMA = "doc_id long, text string, source string, size string, _doc string, host string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, s, "clash", "clash", "clash") for i, t, s in rows], SCHEMA)


def corpus(seed=1, n=300):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(r.choices(words, k=r.choice([0, 1, 3, 20, 60, 200]))), r.choice(["a", "a", "a", "b", "c", None])) for i in range(n)]
    return rows + [(n, None, "b"), (n + 1, "", None), (n + 2, "x " * 5000, "c"), (n + 3, "same text here", "a"), (n + 4, "same text here", "a")]


def test_mixing(spark):
    rows = corpus()
    out = {r["doc_id"]: r for r in mixing.fair_mix(frame(spark, rows)).collect()}
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    assert {i: r["size"] for i, r in out.items()} == size
    total, by = sum(size.values()), defaultdict(int)
    for i, _, s in rows:
        by[s] += size[i]
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(total)
    while True:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 3 * by[s]}
        if not full:
            break
        for s in full:
            target[s] = 3.0 * by[s]
            left -= target[s]
        free -= full
    target |= {s: weight[s] * level for s in free}
    taken, largest = defaultdict(int), max(size.values())
    for i, _, s in rows:
        assert out[i]["target"] == pytest.approx(target[s]) and out[i]["source_size"] == by[s]
        assert out[i]["taken"] in [k * size[i] for k in range(4)]
        taken[s] += out[i]["taken"]
    assert all(abs(taken[s] - target[s]) <= largest for s in names) and sum(taken.values()) <= total
    again = {r["doc_id"]: r["taken"] for r in mixing.fair_mix(frame(spark, rows[::-1])).collect()}
    assert again == {i: r["taken"] for i, r in out.items()}


def test_mixed_documents_and_edges(spark):
    rows = corpus(2, 60)
    d = frame(spark, rows)
    epochs = {r["doc_id"]: r["epochs"] for r in mixing.fair_mix(d).collect()}
    got = Counter(r["doc_id"] for r in mixing.mixed_documents(d).collect())
    assert got == {i: n for i, n in epochs.items() if n}
    assert mixing.mixed_documents(d).columns == d.columns
    finishes = [r["mix_finish"] for r in mixing.mix_in_order(d.select("doc_id", "text", "source")).collect()]
    assert finishes == sorted(finishes)
    assert mixing.fair_mix(frame(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.fair_mix(frame(spark, [(1, "", "a"), (2, None, None)])).collect()] == [0, 0]


def test_mix_of_repeated_rows(spark):
    """Copies of one row at the cut are taken as often as the budget allows; the mix is that of the counts."""
    rows = [(7, "a b c", "x")] * 30 + [(7, "d e f", "x")] * 3 + [(None, "g h", "x"), (None, None, None), (1, "one two", None)]
    rows += [(i, "w " * (i % 5 + 1), "y") for i in range(10, 20)]
    for share in (0.3, 0.55, 1.0):
        d = frame(spark, rows)
        mix = mixing.fair_mix(d, share=share)
        want = {r["source"]: r["n"] for r in mix.groupBy("source").agg(F.sum("taken").alias("n")).collect() if r["n"]}
        got = Counter()
        for r in mixing.mixed_documents(d, share=share).collect():
            got[r["source"]] += len(r["text"].split())
        assert got == want
        assert sorted(map(str, mixing.mixed_documents(d, share=share).collect())) == sorted(map(str, mixing.mixed_documents(d, share=share).collect()))


def test_sharding(spark):
    rows = corpus(3, 400)
    out = sharding.assign_shards(frame(spark, rows), 7).collect()
    assert len(out) == len(rows)
    shards = defaultdict(list)
    for r in out:
        shards[r["shard"]].append(r)
    counts = [len(x) for x in shards.values()]
    assert len(shards) == 7 and max(counts) - min(counts) <= 1
    share = Counter(s for _, _, s in rows)
    for x in shards.values():
        assert sorted(r["slot"] for r in x) == list(range(len(x)))
        mine = Counter(r["source"] for r in x)
        assert all(abs(mine[s] - share[s] / 7) <= 2 for s in share)
    size = {i: len((t or "").encode()) + 16 for i, t, _ in rows}
    assert all(r["size"] == size[r["doc_id"]] and r["law"] == "rows" and r["grown_shard"] is None for r in out)
    assert sharding.assign_shards(frame(spark, [])).count() == 0
    assert sorted(r["shard"] for r in sharding.assign_shards(frame(spark, rows[:3]), 40).collect()) == [0, 13, 26]


def measured(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {k for i, w in enumerate(windows) if many[w] > 1 for k in (i, i + 1, i + 2)}
    full = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(full) - len(set(full)), len(covered))


def plain_shards(rows, shards):
    """Placement by the definition: ranks in a seeded shuffle, fractional ranks, equal stretches."""
    made = []
    for i, text, source in rows:
        b = (text or "").encode()
        key = int(hashlib.md5(f"shard|{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        made.append((source is None, source or "", key, i is not None, i or 0, len(b) + 16, zlib.crc32(b)))
    out = []
    for s in {m[:2] for m in made}:
        mine = sorted(m for m in made if m[:2] == s)
        out += [((2 * r + 1) / (2 * len(mine)), *m[:2], *m[3:]) for r, m in enumerate(mine)]
    out.sort()
    n = len(out)
    first = lambda k: -(-k * n // shards)
    return [(m[4] if m[3] else None, m[5], m[6], p * shards // n, p - first(p * shards // n)) for p, m in enumerate(out)]


@pytest.mark.parametrize("odd", [False, True])
def test_shards_against_their_definition(spark, odd):
    rows = corpus(5, 400)
    if odd:  # repeated and null ids, copies, a long text
        rows += [(3, "other text", "a"), (3, "other text", "a"), (None, "no id", "b"), (None, None, None), (7, "y " * 60_000, "c")]
    got = sharding.assign_shards(frame(spark, rows), 7).collect()
    of = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got]
    assert sorted(of, key=str) == sorted(plain_shards(rows, 7), key=str)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}


def test_quality_rules(spark):
    r = random.Random(5)
    texts = [None, "", " \t\n", "a b", "a b c a b c", "x y z " * 200, "l one\nl two\nl one\n \n \n", "é# *$%&|<>\x0b\x0cw", "long " * 20_000]
    texts += [" ".join(r.choices("the of and a b c d".split(), k=r.randint(0, 80))) + "\n" * r.randint(0, 3) for _ in range(60)]
    got = {x["doc_id"]: x for x in quality_rules.quality_verdicts(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        x, want = got[i], measured(t)
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == want
        assert x["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (x["kept"] and x["base_failed"])
    assert quality_rules.quality_verdicts(frame(spark, [])).count() == 0


def test_quality_rules_keep_and_drop(spark):
    words = [f"word{i}" for i in range(60)]
    good = "The " + " of the ".join(words) + "."
    shout = " ".join(w.upper() + "!!" for w in words)
    bars = " | ".join(words)
    d = frame(spark, [(0, good, "s"), (1, shout, "s"), (2, bars, "s"), (3, good, "s")])
    assert sorted(r["doc_id"] for r in quality_rules.kept_documents(d).collect()) == [0, 3]
    assert quality_rules.kept_documents(d).columns == d.columns


def test_chat_round_trip(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "a<|b|>\\|<\\|"), (1, 2, "assistant", None), (1, 3, "user", "<"), (1, 4, "user", "|x|>\n"),
        (2, 0, "a\nb%0A<|im_sep|>", ""), (3, 0, "user", said), (3, 1, "assistant", said), (4, None, None, "first"), (4, 1, "assistant", "x" * 100_000),
        (5, 0, "user", "same"), (5, 0, "user", "same"), (None, 0, "assistant", "no id"),
    ]
    d = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.chat_digest(d).collect()}
    by = defaultdict(list)
    for c, n, role, text in turns:
        by[c].append((-1 if n is None else n, role or "", text or ""))
    assert set(got) == set(by)
    for c, x in by.items():
        x.sort()
        all_text = "".join(f"{r}\n{t}\n" for _, r, t in x)
        loss = "".join(t for _, r, t in x if r == "assistant")
        assert got[c]["n_turns"] == len(x)
        assert got[c]["turns_sha256"] == hashlib.sha256(all_text.encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    f = {r["conv_id"]: r["formatted"] for r in chat.format_chats(d).collect()}
    assert f[1].startswith("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\na<\\|b|>") and f[1].count("<|im_start|>") == 3
    assert chat.chat_digest(d.where("false")).count() == 0


def test_url_filter(spark):
    caps = [
        (1, "http://a.x.com/p", "2024-01-05"), (2, "https://u@A.x.com:80", "2024-02-01"), (3, "http://b.x.com", "2024-01-05"), (4, "http://x.com.", "2024-01-01"), (5, None, "2024-01-05"),
        (6, "nohost", "2024-01-05"), (7, "http://a.x.com/p", None), (8, "http://other.org", "2024-01-05"), (8, "http://other.org", "2024-01-05"), (9, "http://[::1]/", "2024-01-05"),
    ]
    c = spark.createDataFrame(caps, "id long, url string, day string").select("id", "url", F.col("day").cast("date").alias("fetched"), F.lit("clash").alias("host"))
    entries = [("x.com", "block", "2024-01-02"), ("a.x.com", "allow", "2024-01-03"), ("a.x.com", "block", "2024-01-20"), ("x.com", "allow", "2024-01-02"), (None, "block", "2024-01-01"), ("other.org", None, "2024-01-01")]
    e = spark.createDataFrame(entries, "domain string, verdict string, day string").select("domain", "verdict", F.col("day").cast("date").alias("listed_on"))
    got = [(r["_row"]["id"], r["rule"], r["verdict"], r["kept"]) for r in url_filter.judged(c, e).collect()]
    none = lambda i: (i, None, "none", True)
    assert sorted(got, key=str) == sorted([(1, "a.x.com", "allow", True), (2, "a.x.com", "block", False), (3, "x.com", "block", False), none(4), none(5), none(6), none(7), none(8), none(8), none(9)], key=str)
    odd = {
        "http://u@v@evil.com/x": "evil.com", " \x01http://evil.com": "evil.com", "ht\ntp://e\tvil.com/": "evil.com", "http:\\\\evil.com\\@good.com": "evil.com", "HTTP://Evil.com.:80?@x": "evil.com",
        "http://[2001:db8::1]:80/": "[2001:db8::1]", "http://1.2.3.4:8/": "1.2.3.4", "mailto:a@b.c": None, "ftp://": None, "": None,
        "http:///evil.com/": "evil.com", "http:/evil.com/": "evil.com", "http:evil.com": "evil.com", "http://ev%69l.com/": "evil.com", "http://evil.com../": "evil.com", "http://evil\u3002com": "evil.com",
        "http://0x01020304/": "1.2.3.4", "http://1.2.772": "1.2.3.4", "http://01.0x2.3.4": "1.2.3.4", "http://16909060/": "1.2.3.4", "other:/evil": None,
    }
    hosts = spark.createDataFrame([(u,) for u in odd], "u string").select("u", url_filter.host_of(F.col("u")).alias("h"), url_filter.domains_of(url_filter.host_of(F.col("u"))).alias("d")).collect()
    assert {r["u"]: r["h"] for r in hosts} == odd
    assert {tuple(r["d"]) for r in hosts if r["h"] and r["h"] != "evil.com"} == {("[2001:db8::1]",), ("1.2.3.4",)}
    left = {"http://a%zz.b/": "a%zz.b", "http://256.1.1.1": "256.1.1.1", "http://1.2.3.4.5": "1.2.3.4.5", "http://4294967296": "4294967296"}
    assert {r["u"]: r["h"] for r in spark.createDataFrame([(u,) for u in left], "u string").select("u", url_filter.host_of(F.col("u")).alias("h")).collect()} == left
    assert url_filter.judged(c, e.where("false")).where("verdict <> 'none'").count() == 0
    assert url_filter.judged(c.where("false"), e).count() == 0
