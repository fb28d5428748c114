"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib

import pytest
from pyspark.sql import functions as F, types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["_text", "_kept", "_n", "fp", "host", "shift", "rate", "kind", "key", "label_", "_spans", "_doc", "component", "token_ids_"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS)


LONG = " ".join(f"w{i % 977}" for i in range(60_000))
TEXTS = [(1, None, "a"), (2, "", "a"), (3, " \t\n\r\x0b\x0c ", None), (4, LONG, "a"), (5, LONG, "b"), (6, "one two", None), (7, "Żółw 日本 😀 one two", "b"), (7, "Żółw 日本 😀 one two", "b"), (None, "x y z", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, TEXTS)


# ---- html


def test_html_cases(spark):
    from graphloom.llm.html_text import extract, main_text

    prose = "<p>" + "Words of prose, which go on. " * 5 + "</p>"
    text = ("Words of prose, which go on. " * 5).strip()
    page = f"<body><header>Top</header><div class='main'><h2>T&amp;amp;</h2>{prose}<p>Short.</p></div><div class=sidebar>{prose}</div><div id=comments>{prose}</div><div class='cookie-notice'>ok, ok.</div><form>{prose}</form></body>"
    assert extract(page) == f"T&amp;\n{text}\nShort."
    assert extract(f"<article>{prose}<section class='comments'><article class='comment'>{prose * 4}</article></section></article>") == text
    assert extract("<article><p>a<br>b&nbsp;<i>c</i>d\n e</p></article>") == "a b cd e"
    for broken in ("<", "<p", "<!-- x", "<script>x", "<div " * 50, "</p></b>"):
        extract(broken)
    assert len(extract("<p>" + "x" * 500_000 + "</p>")) == 500_000
    assert extract("<div>x" * 5000).count("x") >= 1
    df = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 1), (3, "u", page, 1), (3, "u", page, 1)], "page_id long, url string, html string, text int")
    got = sorted((r.page_id, r.url or "", r.n_chars) for r in main_text(df).collect())
    n = len(extract(page))
    assert got == [(1, "u", 0), (2, "", 0), (3, "u", n), (3, "u", n)]
    assert main_text(df.limit(0)).count() == 0


# ---- embeddings


def vectors(spark, rows, more=""):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label int{more}")


def test_embedding_cases(spark):
    from graphloom.llm.embedding_dedup import near_duplicates

    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [0.0, 0.0], 0), (3, [1.0, nan], 0), (4, [1.0, inf], 0), (5, [1.0, None], 0), (6, [1.0, 0.0], None), (7, [], 0), (20, [1.0, 0.0], 0), (21, [2.0, 0.0], 0), (22, [1.0, 0.0], 0), (22, [1.0, 0.0], 0), (23, [1.0, 0.0], 1), (24, [1.0, 0.0, 0.0], 0), (25, [-1.0, -0.0], 0)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicates(vectors(spark, rows)).collect())
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 7)]
    assert got == [*alone, (20, 3, 20, True), (21, 3, 20, False), (22, 3, 20, False), (22, 3, 20, False), (23, 0, 23, True), (24, 0, 24, True), (25, 0, 25, True)]
    assert near_duplicates(vectors(spark, [])).count() == 0
    hot = vectors(spark, [(i, [1.0, 0.5], 0) for i in range(3000)] + [(5000, [1.0, 0.51], 0)] + [(6000 + i, [float(i), -3.0], 1) for i in range(40)])
    got = near_duplicates(hot, block=7).where("vec_id <= 5000").groupBy("n_links", "component_id").count().collect()
    assert [tuple(r) for r in got] == [(3000, 0, 3001)]
    clash = vectors(spark, [(1, [1.0], 0, 5), (2, [1.0], 0, 5)], ", class long")
    assert {r.component_id for r in near_duplicates(clash).collect()} == {1}


# ---- simhash


def test_simhash_cases(spark, odd):
    from graphloom.llm.simhash import keep_one, near_duplicates

    got = {}
    for r in near_duplicates(odd).collect():
        got.setdefault(r.doc_id, set()).add((r.fp, r.component_id))
    assert got[1] == got[2] == got[3] == {(0, 1)}
    assert got[4] == got[5] and {c for _, c in got[4]} == {4}
    assert near_duplicates(odd.limit(0)).count() == 0
    kept = keep_one(odd.withColumn("fp", F.lit(1)).withColumn("_kept", F.lit(2)))
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == sorted([(1, None), (4, LONG), (6, "one two"), (7, "Żółw 日本 😀 one two"), (-1, "x y z")], key=lambda r: r[0])


def test_keep_one_with_repeated_and_null_ids(spark):
    from graphloom.llm import near_dedup, simhash

    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(3, a, "s"), (5, b, "s"), (5, a, "s"), (None, c, "s"), (8, None, "s"), (9, None, "s"), (9, None, "s")]
    for module in (simhash, near_dedup):
        got = sorted(((r.doc_id or -1, r.text) for r in module.keep_one(docs(spark, rows)).collect()), key=str)
        assert got == sorted([(3, a), (5, b), (-1, c), (8, None)], key=str), module


def test_simhash_long_runs_pass_through_the_second_index(spark):
    """A ball of fingerprints around one: runs longer than the limit take the other way, with the same links."""
    import numpy as np

    from graphloom.llm.simhash import links

    rng = np.random.default_rng(1)
    center = int(rng.integers(1 << 62))
    ball = sorted({center ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (300, 2))} | {int(x) for x in rng.integers(0, 1 << 62, 200)})
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in ball]

    def classes(pairs):
        parent = {x: x for x in signed}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[find(a)] = find(b)
        out = {}
        for x in signed:
            out.setdefault(find(x), []).append(x)
        return sorted(map(sorted, out.values()))

    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = classes([(signed[i], signed[j]) for i in range(len(ball)) for j in range(i) if (ball[i] ^ ball[j]).bit_count() <= 3])
    for limit in (8192, 8):
        assert classes([(r.a, r.b) for r in links(df, limit).collect()]) == want


def test_components_of_a_long_path(spark):
    from graphloom.llm.common import components

    n = 200
    order = [(i * 37) % n for i in range(n)]
    df = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(500, 501), (501, 501)], "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert {got[i] for i in range(n)} == {0} and got[500] == got[501] == 500 and len(got) == n + 2


# ---- lines


def test_line_cases(spark):
    from graphloom.llm.line_dedup import drop_lines

    rows = [(i, f"menu\nown {i}\n\n menu \t\nmenu2", "s") for i in range(6)] + [(10, None, "s"), (11, "", "s"), (12, "menu\nrest", None), (13, "menu\nrest", "t"), (14, "menu", "t"), (5, "menu\nown 5\n\n menu \t\nmenu2", "s")]
    df = docs(spark, rows).withColumn("host", F.lit("clash")).withColumn("line", F.lit(1)).withColumn("_drop", F.lit(2))
    for limit in (1000, 0):  # the broadcast and the join
        got = sorted((r.doc_id, r.text, r._n_lines, r._n_removed) for r in drop_lines(df.drop("_drop"), ratio=0.5, min_pages=5, max_broadcast=limit).collect() if r.doc_id not in (10,))
        assert got == sorted([(i, f"own {i}\n", 5, 3) for i in [0, 1, 2, 3, 4, 5, 5]] + [(11, "", 1, 0), (12, "menu\nrest", 2, 0), (13, "menu\nrest", 2, 0), (14, "menu", 1, 0)])
        null = [r for r in drop_lines(df, ratio=0.5, min_pages=5, max_broadcast=limit).collect() if r.doc_id == 10] if limit is None else [r for r in drop_lines(df.drop("_drop"), ratio=0.5, min_pages=5, max_broadcast=limit).collect() if r.doc_id == 10]
        assert [(r.text, r._n_lines, r._n_removed) for r in null] == [(None, 0, 0)]
    assert drop_lines(df.drop("_drop").limit(0)).count() == 0


# ---- substrings


def test_substring_cases(spark, odd):
    from graphloom.llm.substring_dedup import digests, remove

    got = {}
    for r in digests(odd).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept_sha256))
    empty = hashlib.sha256(b"").hexdigest()
    assert got[1] == got[2] == got[3] == [(0, 0, empty)]
    assert got[4] == [(60_000, 0, hashlib.sha256(LONG.encode()).hexdigest())] and got[5] == [(60_000, 60_000, empty)]
    assert got[None] == [(3, 0, hashlib.sha256(b"x y z").hexdigest())] and len(got[7]) == 2
    assert digests(odd.limit(0)).count() == 0
    clash = odd.withColumn("_spans_", F.lit(1)).withColumn("text_key", F.lit(1)).withColumn("spans", F.lit(2))
    out = {r.doc_id: r for r in remove(clash).collect()}
    assert out[1].text is None and out[5].text == "" and out[5]._n_removed == 60_000 and out[5].spans == 2


def test_substring_rows_with_the_same_id(spark):
    from graphloom.llm.substring_dedup import digests

    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    rows = [(1, a, "s"), (2, f"x {a} y", "s"), (2, b, "s"), (2, a, "s"), (3, f"{b} {a}", "s")]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in digests(docs(spark, rows)).collect())
    assert got == [(1, 20, 0), (2, 20, 0), (2, 20, 20), (2, 22, 20), (3, 40, 40)]


def test_substring_windows_with_colliding_hashes(monkeypatch):
    """Where the first hash says nothing, the bucket still tells windows apart; every window travels once or goes."""
    import numpy as np
    import pyarrow as pa

    from graphloom.llm import substring_dedup as sd

    true = sd.window_hashes
    monkeypatch.setattr(sd, "window_hashes", lambda w, width, base=sd.BASES[0]: np.zeros(max(len(w) - width + 1, 0), np.uint64) if base == sd.BASES[0] else true(w, width, base))
    a, b = " ".join(f"a{i}" for i in range(14)), " ".join(f"b{i}" for i in range(15))
    batch = pa.RecordBatch.from_arrays([pa.array([3, 1, 2]), pa.array([a, a, b])], ["doc_id", "text"])
    out = [r for x in sd._windows(13, 17, False)(iter([batch])) for r in x.to_pylist()]
    kept = sorted(d for r in out if r["kind"] == 0 for d in r["docs"])
    assert kept == [1, 1, 2, 2, 2] and [(r["docs"], r["hashes"]) for r in out if r["kind"] == 1] == [([3], [14])]


# ---- mixing


def test_mixing_cases(spark):
    from graphloom.llm.mixing import decide, emit, plan, sizes_of, targets

    t = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 1000)], "source string, source_size long")
    got = {r.source: r.target for r in targets(t).collect()}
    # a stops at 30; what is left, 2980, is shared 2 : 1 : 5
    assert got == pytest.approx({"a": 30.0, "b": 745.0, "c": 372.5, None: 1862.5})
    df = docs(spark, [(i, "w " * (1 + i % 7), f"s{i % 4}" if i % 5 else None) for i in range(600)] + [(1000, None, "s1"), (1001, "", "zero")])
    sizes = sizes_of(df)
    rows = decide(sizes, plan(sizes)).collect()
    assert len(rows) == 602 and sorted(map(tuple, rows)) == sorted(map(tuple, decide(sizes.repartition(7), plan(sizes.repartition(3))).collect()))
    assert all(r.taken <= 3 * r.size for r in rows)
    source = {r.doc_id: r.source for r in df.collect()}
    for one in set(source.values()):
        own = [r for r in rows if source[r.doc_id] == one]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 10
    clash = df.withColumn("rate", F.lit(7)).withColumn("shift", F.lit(8))
    out = emit(clash)
    assert out.columns == clash.columns and out.where("doc_id < 1000").count() == sum(r.taken // r.size for r in rows if r.size)
    assert emit(df.limit(0)).count() == 0


# ---- quality


def test_quality_cases(spark, odd):
    from graphloom.llm.quality import score, select

    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    none = score(odd, labels([])).collect()
    assert len(none) == len(TEXTS) and all(r.kept and r.tail_probability is None for r in none)
    some = labels([(4, 1, 0), (6, 0, 0), (6, 0, 1), (99, 1, 0), (7, None, 0), (2, 0, 0)])
    got = score(odd, some).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in got)
    clash = odd.withColumn("grade", F.lit(1)).withColumn("places", F.lit(2)).withColumn("_id", F.lit(3))
    assert set(select(clash, some).columns) == set(clash.columns)
    assert score(odd.limit(0), some).count() == 0
    assert [tuple(r) for r in score(odd, some).orderBy("doc_id").collect()] == [tuple(r) for r in score(odd.repartition(5), some).orderBy("doc_id").collect()]


def test_a_repeated_id_is_one_rating_a_label(spark):
    """A doc_id on many rows sends the fit one text for each label."""
    from graphloom.llm import quality

    many = docs(spark, [(1, "good words here", "a")] * 500 + [(2, "BAD words !!", "a"), (3, "other good words", "a")])
    once = docs(spark, [(1, "good words here", "a"), (2, "BAD words !!", "a"), (3, "other good words", "a")])
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    a, b = quality.train(many, labels), quality.train(once, labels)
    assert (a.weights == b.weights).all() and (a.thresholds == b.thresholds).all()


def test_cumulative_link_probabilities():
    import numpy as np

    from graphloom.llm.quality import fit

    rng = np.random.default_rng(0)
    features, grades = [], []
    for _ in range(600):
        y = int(rng.integers(3))
        features.append(np.array([y, 10 + int(rng.integers(5))], np.int32))
        grades.append(y)
    m = fit(features, np.array(grades))
    assert m.thresholds[0] < m.thresholds[1]
    tails = m.tails(np.array([m.weights[f].sum() for f in features]))
    assert (tails[:, 0] >= tails[:, 1]).all()
    assert np.mean((tails >= 0.5).sum(axis=1) == grades) > 0.98


# ---- urls


def test_url_cases(spark):
    from graphloom.llm.url_rules import RULES, judge, judge_by_join, url_parts

    urls = [None, "", "no scheme", "http://", "http://COM", "http://Com/", "https://www.example.com/en/x?y", "https://a.www.example.com/en/", "http://example.com/en", "http://x.net/fr/#a", "http://xnet/fr/", "http://a..net/es/", "http://net/es/", "x://y://example.com/en/", "http://Ünï.com/a", "http://example.com/en/?" + "q" * 100_000]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] + [(6, urls[6], "z")], "page_id long, url string, rule string")
    got = sorted((r.page_id, r.host, r.path[:9], r.rule, r.verdict) for r in judge(df, RULES).collect())
    want = [(0, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "com", "", None, "allow"), (5, "com", "/", "com/", "allow"), (6, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (6, "www.example.com", "/en/x", "www.example.com/en/", "allow"),
            (7, "a.www.example.com", "/en/", "www.example.com/en/", "allow"), (8, "example.com", "/en", "com/", "allow"), (9, "x.net", "/fr/", "net/fr/", "block"), (10, "xnet", "/fr/", None, "allow"), (11, "a..net", "/es/", "net/es/", "block"), (12, "net", "/es/", "net/es/", "block"),
            (13, "y:", "//example", None, "allow"), (14, "Ünï.com".replace("Ü", "Ü"), "/a", "com/", "allow"), (15, "example.com", "/en/", "example.com/en/", "block")]
    assert got == want
    again = sorted((r.page_id, r.host, r.path[:9], r.rule, r.verdict) for r in judge(df, RULES, max_index_bytes=0).collect())
    assert again == want
    assert judge(df.limit(0), RULES).count() == 0 and judge(df, []).where("verdict = 'block'").count() == 0
    assert judge_by_join and url_parts


def test_url_rules_of_one_length(spark):
    """Of fitting rules of one length that with the longer host decides, in the file and in the join."""
    from graphloom.llm.url_rules import judge

    rules = [("block", "b.com", "/"), ("allow", "com", "/ab"), ("allow", "x.b.com", "/a"), ("block", "b.com", "/abc"), ("allow", "b.com", "/abc")]
    df = spark.createDataFrame([(1, "http://b.com/abx"), (2, "http://b.com/abc"), (3, "http://x.b.com/abc"), (4, "http://q.com/abc")], "page_id long, url string")
    for limit in (1 << 20, 0):
        got = sorted((r.page_id, r.rule, r.verdict) for r in judge(df, rules, max_index_bytes=limit).collect())
        assert got == [(1, "b.com/", "block"), (2, "b.com/abc", "block"), (3, "x.b.com/a", "allow"), (4, "com/ab", "allow")], limit


def test_digest_collisions_are_confirmed_by_the_string(monkeypatch):
    import numpy as np

    from graphloom.llm import url_rules

    monkeypatch.setattr(url_rules, "_digests", lambda keys: np.full(len(keys), 7, np.uint64))
    index = url_rules.RuleIndex(np.frombuffer(url_rules.compile_rules(url_rules.RULES), np.uint8))
    assert index.judge(["example.com", "a.net", "org"], ["/en/", "/fr/x", "/"]) == (["example.com/en/", "net/fr/", None], ["block", "block", None])


# ---- top-k


def test_topk_cases(spark):
    from graphloom.llm.topk import search

    nan = float("nan")
    rows = [(0, [1.0, 1.0]), (1, None), (2, [nan, 1.0]), (3, [None, 1.0]), (4, [1.0, 0.0]), (5, [0.0, 1.0]), (5, [0.0, 1.0]), (6, [-0.001, 0.0]), (7, [1.0]), (20, [1.0]), (40, []), (60, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in search(df, F.col("vec_id") % 20 == 0, k=3).collect())
    assert got == [(0, 1, 4, 4096), (0, 2, 5, 4096), (0, 3, 5, 4096), (20, 1, 7, 4096)]
    assert search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    huge = spark.createDataFrame([(0, [1e17, 1.0]), (1, [1e17, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in search(huge, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, (1 << 63) - 1), (2, int(64 * 1e17) * 64 + 64 * 64 if int(64 * 1e17) * 64 + 4096 < 1 << 63 else (1 << 63) - 1)]


# ---- bpe


def test_bpe_cases(spark, odd):
    import public_tokenizers as P

    from graphloom.llm.bpe import decode, encode, round_trip

    path = P.path("byte_bpe_multi_50k.tiktoken")
    got = round_trip(odd, path, P.PATTERN).collect()
    assert len(got) == len(TEXTS)
    empty = hashlib.sha256(b"").hexdigest()
    by = {r.doc_id: r for r in got}
    assert (by[1].n_tokens, by[1].ids_sha256, by[1].decoded_sha256) == (0, empty, empty) == (by[2].n_tokens, by[2].ids_sha256, by[2].decoded_sha256)
    assert by[4].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    back = decode(encode(odd.withColumn("ids", F.lit(1)), path, P.PATTERN), path, P.PATTERN)
    want = sorted((i or -1, t or "") for i, t, _ in TEXTS)
    assert sorted((r.doc_id or -1, r.text) for r in back.collect()) == want
    assert round_trip(odd.limit(0), path, P.PATTERN).count() == 0


def test_transducer_against_the_library():
    import random

    import public_tokenizers as P
    import tiktoken

    from graphloom.llm.bpe import Codec, load_ranks, merge

    ranks = load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    own, small = Codec(ranks, P.PATTERN), Codec(ranks, P.PATTERN, max_states=50, memo=10)
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    bits = [" ", "\n", "\t", "\x1c", "\x85", "\u180e", "a", "b", "é", "ß", "😀", "中", "0", "½", "!", "'s", "'LL", "\u0301", "ह", "\r\n", "\xa0", "the", "ing", "aaaa", "====", "\x00", "\u3000"]
    for _ in range(1500):
        x = "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))
        ids = ref.encode_ordinary(x)
        assert own.encode(x) == ids == small.encode(x)
        assert own.decode(ids) == x and "".join(own.decode_stream(ids, 3)) == x
    tokens = list(ranks.values())
    for _ in range(3000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        assert own.fst.may_follow(a, b) == (merge(own.bytes[a] + own.bytes[b], ranks) == [a, b])
    tight = Codec(ranks, P.PATTERN, max_states=50, memo=100_000, memo_bytes=5_000)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    assert tight.encode(word) == own.encode(word) == ref.encode_ordinary(word) and len(tight.fst.states) <= 52
    for _ in range(300):
        x = "".join(rng.choice(bits) for _ in range(40))
        assert tight.encode(x) == ref.encode_ordinary(x)
    assert word not in tight.memo and tight.memo.held <= 5_000 + 20_000
    long = "ab" * 40_000 + "=" * 30_000
    assert own.encode(long) == ref.encode_ordinary(long)


def test_utf8_stream():
    from graphloom.llm.bpe import Utf8Stream

    data = "aé中😀\u07ff\uffff".encode()
    for n in (1, 2, 3, 5):
        s = Utf8Stream()
        assert "".join(s.feed(data[i : i + n]) for i in range(0, len(data), n)).encode() == data
        s.end()
    for bad in (b"\xff", b"\xc0\x80", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xe0\x80", b"a\x80"):
        with pytest.raises(ValueError):
            s = Utf8Stream()
            s.feed(bad)
            s.end()
    s = Utf8Stream()
    s.feed(b"\xe4\xb8")
    with pytest.raises(ValueError):
        s.end()


def test_schema_of_empty_results(spark):
    from graphloom.llm.bpe import encode
    import public_tokenizers as P

    df = spark.createDataFrame([], DOCS)
    assert encode(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).schema["token_ids"].dataType == T.ArrayType(T.IntegerType())
