import base64
import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from test_decontaminate import brute as leaks
from test_quality import text as sample_text
from test_simhash import brute_fingerprint, brute_groups, jaccard

import corpus_pipeline
from codeloom.llm import common, decontaminate, pii, quality


def tables():
    rng = random.Random(8)
    good = [i % 5 > 0 for i in range(240)]
    rows = [(i, sample_text(rng, g), "en", f"s{i % 3}", 1) for i, g in enumerate(good)]
    labels = [(i, int(g), 0) for i, g in enumerate(good)]
    clean = [i for i, g in enumerate(good) if g]
    benchmark = [(0, rows[clean[3]][1]), (1, " ".join(f"q{k}" for k in range(14))), (2, None)]
    rows.append((300, rows[clean[0]][1] + " and more words of " + benchmark[1][1] + " to read. " + sample_text(rng, True), "en", "s", 1))
    rows.append((301, sample_text(rng, True) + " Write to a.b@example.com or +1 (743) 555-3824 soon. Then 743-555-3824.", "en", "s", 1))
    rows += [(310 + k, rows[clean[k % 4 + 5]][1], "en", "s", 1) for k in range(20)]
    near = rows[clean[10]][1].split()
    near[7] = "changed"
    rows += [(340, " ".join(near), "en", "s", 1), (341, None, None, None, None), (342, "", "en", "s", 0), (None, rows[clean[12]][1], "en", "s", 1), (clean[13], rows[clean[13]][1], "en", "s", 1)]
    return rows, labels, benchmark


def brute(rows, model):
    import numpy as np

    kept = [r for r in rows if model.score(np.array([quality.statistics((r[1] or "").encode())]))[0] >= quality.KEEP]
    prints = [brute_fingerprint(r[1], 5) for r in kept]
    groups = brute_groups(len(kept), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3 or jaccard(kept[a][1], kept[b][1]) >= 0.8)
    first = {}
    for r, g in zip(kept, groups, strict=True):
        if g not in first or (r[0] is None, r[0] or 0) < (first[g][0] is None, first[g][0] or 0):
            first[g] = r
    alone = list(first.values())
    return kept, alone


def test_stages_match_a_brute_force_version(spark, make_tables):
    rows, labels, benchmark = tables()
    sf = make_tables(documents=rows, labels=labels, benchmark=benchmark)
    docs = common.documents(spark, sf)
    model = quality.learn(docs.select("doc_id", "text"), common.table(spark, sf, "labels"))
    kept, alone = brute(rows, model)
    names = docs.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    stages = [f for _, f in corpus_pipeline.STAGES]

    out = common.written(stages[0](spark, docs, sf), "t")
    assert out.columns == names and sorted(map(tuple, out.collect()), key=key) == sorted(kept, key=key)
    assert 150 < len(kept) < len(rows) - 30
    out = common.written(stages[1](spark, out, sf), "t")
    assert out.columns == names and sorted(map(tuple, out.collect()), key=key) == sorted(alone, key=key)
    assert len(alone) < len(kept) - 20
    out = common.written(stages[2](spark, out, sf), "t")
    bad = {r[0] for r in leaks([(r[0], r[1]) for r in alone], benchmark) if r[5]}
    clean = [r for r in alone if r[0] not in bad]
    assert out.columns == names and sorted(map(tuple, out.collect()), key=key) == sorted(clean, key=key) and 300 in bad
    out = common.written(stages[3](spark, out, sf), "t")
    want = []
    for r in clean:
        (_, spans), = pii.find([r[1] or ""])
        text = pii.redacted(r[1], spans) if spans else r[1]
        want.append((r[0], text, r[2], r[3], len(text) if spans else r[4]))
    assert out.columns == names and sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)
    assert any("[EMAIL] or [PHONE] soon. Then [PHONE]." in (r[1] or "") for r in want)
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = corpus_pipeline.run(spark, sf).select("doc_id", "ids").collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.ids) for r in got)) == sorted((r[0] is None, r[0] or 0, library.encode_ordinary(r[1] or "")) for r in want)


def test_other_columns_stay(spark, make_tables):
    rows, labels, benchmark = tables()
    sf = make_tables(documents=rows, labels=labels, benchmark=benchmark)
    docs = common.documents(spark, sf).withColumns({c: F.lit(c) for c in ("_row", "score", "predicted", "words", "spans", "redacted", "contaminated", "_at", "sid")})
    docs = common.written(docs, "t")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = common.written(stage(spark, docs, sf), "t")
        assert out.columns == docs.columns and out.select("_row", "words", "sid").distinct().collect() == [("_row", "words", "sid")]
        docs = out


def test_a_benchmark_for_several_automata(spark, make_tables, monkeypatch):
    rows, labels, benchmark = tables()
    sf = make_tables(documents=rows, labels=labels, benchmark=benchmark)
    docs = common.documents(spark, sf).withColumn("_row", F.lit("x"))
    want = sorted(map(repr, corpus_pipeline.drop_benchmark_leaks(spark, docs, sf).collect()))
    monkeypatch.setattr(decontaminate.scan, "__defaults__", ("text", 300))
    out = common.written(corpus_pipeline.drop_benchmark_leaks(spark, docs, sf), "t")
    assert out.columns == docs.columns and sorted(map(repr, out.collect())) == want
    assert 0 < len(want) < len(rows)


def test_empty_tables(spark, make_tables):
    assert corpus_pipeline.run(spark, make_tables()).collect() == []
