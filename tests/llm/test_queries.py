"""The registered queries: against their SQL, or against brute force on whole tables."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from compare import connect, of_duck, of_spark

from graphloom.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", list(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    assert of_spark(QUERIES[name](spark, sf_dir)) == of_duck(connect(sf_dir), ORACLES[name])


def documents(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def components(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def slow_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_simhash(docs):
    prints = {i: slow_fingerprint(t) for i, t in docs.items()}
    ids = sorted(prints)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3]
    return {i: (f"{prints[i]:016x}", c) for i, c in components(links, ids).items()}


def test_simhash(spark, sf_dir):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op3_simhash"](spark, sf_dir).collect()}
    assert got == slow_simhash(documents(spark, sf_dir))


def slow_substring(docs, width=13):
    seen, out = {}, {}
    for i in sorted(docs):
        words = WORD.findall(docs[i] or "")
        gone = [False] * len(words)
        for k in range(len(words) - width + 1):
            if seen.setdefault(tuple(words[k : k + width]), i) < i:
                gone[k : k + width] = [True] * width
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring_dedup(spark, sf_dir):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op5_substring_dedup"](spark, sf_dir).collect()}
    assert got == slow_substring(documents(spark, sf_dir))


def test_bpe(spark, sf_dir):
    import public_tokenizers as P
    import tiktoken

    from graphloom.llm.bpe import load_ranks

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op10_bpe"](spark, sf_dir).collect()}
    want = {}
    for i, t in documents(spark, sf_dir).items():
        ids = own.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert got == want


def test_html(spark, sf_dir):
    import html

    got = {r.page_id: (r.text, r.n_chars) for r in QUERIES["op1_html_text"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert got[r.page_id] == (want, len(want))


def test_embedding_recall_on_near_copies(spark):
    from graphloom.llm.embedding_dedup import near_duplicates

    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 64))
    rows = []
    for i, v in enumerate(base):
        v = v / np.linalg.norm(v)
        for _ in range(4):
            w = v + rng.normal(size=64) * rng.choice([0.0, 0.008, 0.016, 0.02])
            rows.append((len(rows), w.tolist(), i % 3))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(df, block=5).collect()}
    x = np.array([r[1] for r in rows])
    cos = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    same = np.array([r[2] for r in rows])
    link = (cos >= 0.98) & (same[:, None] == same[None, :]) & ~np.eye(len(x), dtype=bool)
    want = components([(int(a), int(b)) for a, b in zip(*np.nonzero(link), strict=True)], range(len(x)))
    found = sum(n for n, _ in got.values())
    assert link.sum() > 300 and found <= link.sum() and found >= 0.99 * link.sum()
    assert np.mean([got[i][1] == want[i] for i in want]) >= 0.99


def test_embedding_recall_beside_a_large_group(spark):
    """A group of near copies that is most of the input leaves pivots, and so recall, to the others; lists stay far below all pairs."""
    from graphloom.llm.embedding_dedup import indexed, near_duplicates

    rng = np.random.default_rng(8)
    base = rng.normal(size=(401, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    x = np.concatenate([base[:1] + rng.normal(size=(700, 64)) * 0.008, *[base[1:] + rng.normal(size=(400, 64)) * s for s in (0.005, 0.015)]])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    cos = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    want = ((cos >= 0.98).sum(axis=1) - 1).tolist()
    got = {r.vec_id: r.n_links for r in near_duplicates(df, block=100).collect()}
    assert all(got[i] <= n for i, n in enumerate(want)) and sum(got.values()) >= 0.99 * sum(want)
    small = [i for i in range(700, 1500) if want[i]]
    assert len(small) > 100 and sum(got[i] for i in small) >= 0.95 * sum(want[i] for i in small)
    lists = indexed(df.select("vec_id", "embedding", "label"))[2]
    unrelated = sum(r.n * (r.n - 1) // 2 for r in lists.where("n < 300").collect())
    assert unrelated < 0.1 * len(x) ** 2 / 2


def test_topk_prunes_and_agrees(spark):
    from pyspark.sql import functions as F

    from graphloom.llm.topk import search

    rng = np.random.default_rng(3)
    rows = [(i, np.round(rng.normal(size=6), 1).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in search(df, F.col("vec_id") % 100 == 0, k=7, leaf=16, min_shard=700, task_queries=4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    alone = search(df, F.col("vec_id") % 100 == 0, k=7).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in alone) == sorted((q, *x) for q, xs in got.items() for x in xs)
    q = np.floor(np.array([r[1] for r in rows]) * 64).astype(int)
    for i in range(0, 3000, 100):
        s = q @ q[i]
        order = [j for j in np.lexsort((np.arange(3000), -s)) if j != i][:7]
        assert sorted(got[i]) == [(n + 1, j, int(s[j])) for n, j in enumerate(order)]


def slow_features(text):
    """The classifier's features, from its docstring."""
    import math

    words = (text or "").split()
    distinct, found = set(words), set()
    caps = ends = marks = 0
    for w in distinct:
        core = re.sub(r"^[\W_]+", "", w)
        end = re.search(r"[\W_]*$", core)[0]
        core = core[: len(core) - len(end)] if end else core
        if not core:
            end = ""
        found.add(core.lower())
        if len(end) > 1:
            found.add("\x00end" + end)
            ends += 1
        caps += len(core) > 1 and core.isupper()
        marks += not core
    n = max(len(distinct), 1)
    shares = {"capitals": caps / n, "ends": ends / n, "marks": marks / n, "distinct": math.log2(1 + len(distinct)) / math.log2(2 + len(words)), "words": math.log2(1 + len(words)) / 16}
    return {xxhash.xxh64_intdigest(f) % 2**18 for f in found | {f"\x00{k}{round(v * 8)}" for k, v in shares.items()}}


def test_quality_against_brute_force(spark, sf_dir):
    """Every row of the registered query: expected grade and tail probability from the fitted weights, word by word."""
    import math

    from graphloom.llm import quality

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in QUERIES["op7_quality"](spark, sf_dir).collect()}
    assert len(got) == docs.count() and len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    for i, text in documents(spark, sf_dir).items():
        score = math.fsum(float(model.weights[p]) for p in slow_features(text))
        tails = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert got[i].expected_grade == pytest.approx(sum(tails), abs=2e-6) and got[i].tail_probability == pytest.approx(tails[1], abs=2e-6), i
        assert got[i].kept == (got[i].tail_probability >= 0.5) or abs(tails[1] - 0.5) < 1e-5


def test_cumulative_link_fit_reaches_the_maximum():
    """Grades drawn from a known model: the fit's probabilities come near those of plain gradient ascent on the same likelihood."""
    from graphloom.llm.quality import fit

    rng = np.random.default_rng(2)
    x = rng.random((3000, 4)) < 0.5
    true = x @ np.array([2.0, -1.5, 1.0, 0.0])
    p1, p2 = 1 / (1 + np.exp(-(true + 0.5))), 1 / (1 + np.exp(-(true - 1.0)))
    u = rng.random(3000)
    grades = (u < p1).astype(int) + (u < p2)
    m = fit([np.nonzero(r)[0].astype(np.int32) for r in x], grades, epochs=60, l1=0.0)
    own = m.tails(np.array([m.weights[np.nonzero(r)[0]].sum() for r in x], float))
    w, t = np.zeros(4), np.array([-0.1, 0.1])

    def likelihood(w, t):
        e = 1 / (1 + np.exp(-((x @ w)[:, None] - t)))
        e = np.concatenate([np.ones((3000, 1)), e, np.zeros((3000, 1))], axis=1)
        return np.log(np.maximum(e[np.arange(3000), grades] - e[np.arange(3000), grades + 1], 1e-12)).mean()

    for _ in range(400):  # numeric gradients: independent of the code under test
        v = np.concatenate([w, t])
        g = np.array([(likelihood(*np.split(v + d, [4])) - likelihood(*np.split(v - d, [4]))) / 2e-5 for d in np.eye(6) * 1e-5])
        w, t = np.split(v + 2.0 * g, [4])
    best = 1 / (1 + np.exp(-((x @ w)[:, None] - t)))
    assert np.abs(own - best).max() < 0.05
    assert likelihood(m.weights[:4].astype(float), m.thresholds) > likelihood(w, t) - 0.003


def test_quality_on_held_out_labels(spark):
    """Fitted on documents whose id is not a multiple of four, judged on the others."""
    from pyspark.sql import functions as F

    from graphloom.llm.quality import score

    root = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    got = score(docs, labels.where("doc_id % 4 <> 0")).join(labels.where("doc_id % 4 = 0"), "doc_id")
    clean, toxic, junk = (F.col("quality") == 1) & (F.col("toxic") == 0), F.col("toxic") == 1, F.col("quality") == 0
    r = got.agg(*[F.avg(F.when(c, F.col("kept").cast("int"))).alias(n) for n, c in (("clean", clean), ("toxic", toxic), ("junk", junk))]).first()
    assert r.clean > 0.99 and r.toxic < 0.3 and r.junk < 0.1


def read_stages(spark, sf_dir):
    """(name, input rows, output rows) of every stage but the last, then the last one's input frame."""
    import corpus_pipeline

    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir).cache()
        assert after.columns == docs.columns, name
        out.append((name, docs.collect(), after.collect()))
        docs = after
    return out, docs


def test_pipeline_stages(spark, sf_dir):
    """Each stage on its own input, against brute force."""
    import math
    from collections import Counter

    import corpus_pipeline
    import duckdb
    import pandas as pd
    import public_tokenizers as P

    from graphloom.llm import line_dedup, mixing, quality
    from graphloom.llm.bpe import Codec, load_ranks

    stages, last = read_stages(spark, sf_dir)

    # classifier: the documents whose tail probability, word by word, is at least the cutoff
    _, before, after = stages[0]
    model = quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    tail = {r.doc_id: 1 / (1 + math.exp(float(model.thresholds[1]) - math.fsum(float(model.weights[p]) for p in slow_features(r.text)))) for r in before}
    assert sorted(r.doc_id for r in after) == sorted(i for i, t in tail.items() if t >= quality.CUTOFF)

    # lines: those on more than the ratio of a source's pages, and on enough of them
    _, before, after = stages[1]
    pages, on = Counter(r.source for r in before), Counter()
    for r in before:
        on.update({(r.source, line.strip(" \t\r")) for line in (r.text or "").split("\n")})
    gone = {k for k, n in on.items() if k[0] is not None and k[1] and n >= line_dedup.MIN_PAGES and n / pages[k[0]] > line_dedup.RATIO}
    want = {r.doc_id: "\n".join(line for line in r.text.split("\n") if (r.source, line.strip(" \t\r")) not in gone) for r in before}
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)

    # near-duplicates: five words, similarity 0.8; none goes that brute force keeps
    _, before, after = stages[2]

    def shingles(text):
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()

    own = {r.doc_id: shingles(r.text) for r in before}
    ids = sorted(own)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])]
    group = components(near, ids)
    kept = {r.doc_id for r in after}
    assert set(group.values()) <= kept and {r.doc_id: r.text for r in before if r.doc_id in kept} == {r.doc_id: r.text for r in after}
    to_go = [i for i in ids if group[i] != i]
    assert len(to_go) > 5 and sum(i not in kept for i in to_go) >= 0.9 * len(to_go)

    # mix: as often as SQL takes each document
    _, before, after = stages[3]
    con = duckdb.connect()
    con.register("stage_docs", pd.DataFrame([r.asDict() for r in before]))
    want = {i: n for i, n in con.sql(f"WITH {mixing.mix_sql('stage_docs')} SELECT doc_id, n FROM taken_rows WHERE n > 0").fetchall()}
    assert Counter(r.doc_id for r in after) == want
    texts = {r.doc_id: r for r in before}
    assert all(r == texts[r.doc_id] for r in after)

    # tokens
    codec = Codec(load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    want = sorted((r.doc_id, codec.encode(r.text or "")) for r in after)
    assert sorted((r.doc_id, r.token_ids) for r in corpus_pipeline.STAGES[-1][1](spark, last, sf_dir).collect()) == want
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()) == [i for i, _ in want]


def test_pipeline_on_odd_tables(spark, tmp_path):
    """No rows; null and repeated ids, null and empty texts, null sources, labels of nothing."""
    import corpus_pipeline

    schema, labels = "doc_id long, text string, lang string, source string, n_chars long, _kept int", "doc_id long, quality int, toxic int"
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], schema).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], labels).write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
    odd = str(tmp_path / "odd")
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words, "en", "a", 1, 1), (1, words, "en", "a", 1, 1), (1, f"x {words} y", "en", None, 1, 2), (None, None, None, None, None, None), (2, None, "en", "a", None, 3), (3, "", "en", "b", 0, 4), (None, "some other words here", "en", "b", 5, 5)]
    spark.createDataFrame(rows, schema).write.parquet(f"{odd}/documents.parquet")
    spark.createDataFrame([(99, 1, 0), (1, None, 0)], labels).write.parquet(f"{odd}/labels.parquet")
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    stages = corpus_pipeline.STAGES
    assert stages[0][1](spark, docs, odd).count() == len(rows)  # no usable label: all stay
    lines = stages[1][1](spark, docs, odd)
    assert lines.columns == docs.columns and sorted(map(str, lines.select("doc_id", "text", "_kept").collect())) == sorted(map(str, docs.select("doc_id", "text", "_kept").collect()))
    one = stages[2][1](spark, docs, odd).collect()
    # the copy inside x ... y has similarity 36/38 and the same id: either may be the one that stays
    assert sorted((r.doc_id or -1, (r.text or "").strip("xy ")) for r in one) == sorted([(-1, "some other words here"), (1, words), (2, "")])
    mixed = stages[3][1](spark, docs, odd)
    assert mixed.columns == docs.columns
    assert corpus_pipeline.run(spark, odd).columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]
    assert corpus_pipeline.run(spark, odd).where("doc_id = 1").count() >= 1
