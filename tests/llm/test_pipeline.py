from __future__ import annotations

import hashlib
import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
from leafmill.llm import ngram_join, quality_rules, toxicity

sys.path.insert(0, str(Path(__file__).parent))
from test_corpus_operators import brute_components, plain_toxicity  # noqa: E402
from test_text_operators import measured  # noqa: E402


def corpus(spark, folder):
    """Clean, toxic, shouting and copied documents, written as the tables of a folder."""
    r = random.Random(1)
    usual = "the of and to in that is was it for with as on be at by this".split()
    made = [a + b for a in usual for b in ("ere", "ou", "nd", "st")]
    docs, labels = [], []
    for i in range(160):
        words = [r.choice(usual if r.random() < 0.5 else made) + r.choice(["", "", "a", "x"]) for _ in range(r.randint(60, 160))]
        bad, shout = i % 4 == 1, i % 8 == 2
        if bad:
            for w in ("trashy", "blorgus", "snivel", "trashy"):
                words.insert(r.randrange(len(words)), w)
        docs.append((i, " ".join(w.upper() + "!!" for w in words) if shout else " ".join(words), "en", f"s{i % 3}", 0))
        labels.append((i, int(not shout), int(bad)))
    docs += [(200 + i, docs[i * 4][1], "en", "s0", 0) for i in range(10)] + [(300, None, None, None, None), (301, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, labels


def test_stages_and_run(spark, tmp_path):
    folder = str(tmp_path)
    docs, labels = corpus(spark, folder)
    toxic = {i for i, _, t in labels if t}
    shouting = {i for i, q, _ in labels if not q}
    table = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, table, folder)
    assert clean.columns == table.columns
    left = {r["doc_id"] for r in clean.collect()}
    assert {300, 301} <= left and len(left & toxic) <= 4 and len(set(range(160)) - toxic - left) <= 4
    ruled = {r["doc_id"] for r in stages["quality rules"](spark, table, folder).collect()}
    assert not ruled & (shouting | {300, 301}) and set(range(160)) - shouting <= ruled
    single = {r["doc_id"] for r in stages["near duplicates"](spark, table, folder).collect()}
    assert not single & set(range(200, 210)) and set(range(160)) <= single
    mixed = stages["mixing"](spark, table, folder)
    assert mixed.columns == table.columns and 0 < mixed.count()
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and all(r["lossless"] for r in out)
    ids = {r["doc_id"] for r in out}
    assert ids <= left & ruled & single and not ids & set(range(200, 302))


def plain_mix(rows):
    """How often the mix takes each row (doc_id, text, source): the queues' entries in order of finish time."""
    size = {i: measured(t)[0] for i, t, _ in rows}
    by = defaultdict(list)
    for i, _, s in rows:
        by[s].append(i)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(by, key=lambda s: (s is None, s or "")))}
    entries, total = [], sum(size.values())
    for s, ids in by.items():
        ids.sort(key=lambda i: (int(hashlib.md5(f"mix|{i}".encode()).hexdigest()[:8], 16), i))
        whole, sent = sum(size[i] for i in ids), 0
        for i in ids:
            sent += size[i]
            entries += [((e * whole + sent) / weight[s], s is None, s or "", i, size[i], e) for e in range(3) if size[i]]
    taken, spent = Counter(), 0
    for finish, _, _, i, n, _ in sorted(entries):
        spent += n
        if spent > total:
            break
        taken[i] += 1
    return taken


def test_run_against_plain_stages(spark, tmp_path):
    """The rows of run() are those of every stage redone by brute force."""
    folder = str(tmp_path)
    docs, _ = corpus(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.learn_toxicity(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    left = [d for d in docs if plain_toxicity(model, d[1])[0] < 0.5]
    ruled = {r["doc_id"]: r for r in quality_rules.quality_verdicts(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    for d in left:
        n, _, _, _, repeats = measured(d[1])
        assert ruled[d[0]]["base_failed"] == (n < 50 or 100 * repeats > 50 * n)
    left = [d for d in left if ruled[d[0]]["kept"]]
    groups = brute_components([(d[0], d[1]) for d in left])
    left = [d for d in left if groups[d[0]][1] == d[0]]
    want = plain_mix([(d[0], d[1], d[3]) for d in left])
    out = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r["doc_id"] for r in out) == want and all(r["lossless"] for r in out)


def test_stages_on_empty_and_odd_tables(spark, tmp_path):
    """No stage fails on an empty table, on null rows or on columns that clash with its own."""
    folder = str(tmp_path)
    corpus(spark, folder)
    names = "score distance _doc m n fa fb component cid size epochs taken _at ids lossless base_failed".split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    long = " ".join(f"w{i % 997}a the" for i in range(30_000))
    rows = [(1, long, "en", None, 1), (1, long, "en", None, 1), (None, None, None, None, None), (2, "", "en", "a", 0), (None, "the of and " * 30, None, "a", 3)]
    d = spark.createDataFrame([(*r, *["clash"] * len(names)) for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, folder)
        if name != "sentencepiece":
            assert out.columns == d.columns
        assert out.count() <= 3 * len(rows)
        assert stage(spark, d.where("false"), folder).count() == 0


def test_shape():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "near duplicates", "mixing", "sentencepiece"]
    assert corpus_pipeline.ORACLE_SQL is None
    assert re.search("five words", ngram_join.__doc__) or ngram_join.PERCENT == 80
    assert {r.measure for r in quality_rules.RULES}
