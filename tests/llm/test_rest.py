"""Toxicity, WARC, URL rules, top-k, language-model scores and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from siftmill.llm import lm_score, topk, toxicity, url_rules, warc
from siftmill.llm.queries import ORACLES, QUERIES
from siftmill.session import shared_folder
from tests import oracle
from tests.llm.data import DOC_DDL, awkward, documents


def test_segments_equal_brute_force():
    def slow(scores, base=0):
        best = max(((sum(scores[a:b]), -(b - a), -a, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0, 0, 0))
        if best[0] <= 0:
            return []
        a, b = best[3], best[4]
        return [*slow(scores[:a], base), (base + a, base + b, best[0]), *slow(scores[b:], base + b)]

    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice([-5, -3, -2, 1, 2, 4, 7]) + rng.randrange(1000) / 7919 for _ in range(rng.randrange(14))]
        got = toxicity.segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in slow(scores)]


def toxic_fixture(spark):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(500):
        own = [f"word{rng.randrange(60)}x" for _ in range(rng.randrange(20, 80))]
        bad = i % 4 == 0
        for _ in range(4 * bad):
            own.insert(rng.randrange(len(own)), rng.choice(["vilething", "nastyone", "badly"]))
        texts.append((i, " ".join(own)))
        labels.append((i, 1, int(bad), "x"))
    texts += [(900, None), (901, ""), (None, "vilething nastyone badly"), (3, texts[3][1])]
    labels += [(902, 1, None, "x"), (None, 1, 1, "x"), (3, 1, labels[3][2], "x")]
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, text string"), dict((i, b) for i, _, b, _ in labels)


def test_toxicity_on_held_out_rows(spark):
    docs, labels, bad = toxic_fixture(spark)
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 100 and sum(r.predicted == bad[r.doc_id] for r in held) / len(held) > 0.97
    assert {r.predicted for r in rows if r.doc_id in (900, 901)} == {0} and [r.predicted for r in rows if r.doc_id is None] == [1]
    assert all(r.passages for r in rows if r.predicted)
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in rows)
    marked = {r.doc_id: r.h for r in docs.select("doc_id", toxicity.held_out().alias("h")).collect()}
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, h in marked.items())


def test_the_curve_fits_any_number_of_rows():
    for n in (1, 30, 30_000, 10**9):
        x = np.array([0.1, 0.5, 1.0, 2.0, 3.0, 8.0, 20.0, 60.0, 100.0])
        y = np.array([0, 0, 0, 0, 0, 1, 1, 1, 1.0])
        w = n * np.array([500, 200, 100, 10, 1, 1, 5, 20, 60.0])
        slope, offset = toxicity._logistic(x, y, w)
        p = 1 / (1 + np.exp(-(slope * x + offset)))
        assert slope > 0 and (p[:4] < 0.2).all() and (p[6:] > 0.7).all()
        mixed, base = toxicity._logistic(np.concatenate([x, x]), np.concatenate([y, 1 - y]), np.concatenate([w, w]))
        assert mixed < 1e-3 and abs(base) < 1e-3


def test_held_out_labels_do_not_train(spark):
    docs, labels, _ = toxic_fixture(spark)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, labels) == toxicity.train(docs, turned)


def test_toxicity_without_labels(spark):
    docs, labels, _ = toxic_fixture(spark)
    model = toxicity.train(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(docs, model).collect()} == {0} and toxicity.reject(docs, model).count() == docs.count()
    assert toxicity.score(spark.createDataFrame([], DOC_DDL), model).count() == 0


PAGES = [(5, "https://a.example/x", "same " * 40), (3, None, "same " * 40), (9, "http://b\r\nX: y", "same " * 40), (1, "u", None), (2, "u", ""), (4, "u", "small"), (6, "u", "small"), (7, "u", "a\r\n\r\nWARC/1.1\r\n\r\n\r\nb" * 9 + "é漢\n"), (8, "u", "y" * 300000), (-2, "u", "neg")]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(i, u, h, 1, "d") for i, u, h in PAGES], "page_id bigint, url string, html string, n_bytes int, digest string")
    path = f"{shared_folder(spark)}/warc-test-{random.random()}"
    warc.write_archives(pages, path, records_per_file=7)
    records = warc.read_records(spark, path)
    assert records.count() == 3 * len(PAGES)
    got = {int(r.capture_id.rsplit(":", 1)[1]): r for r in warc.resolve(warc.assemble(records)).collect()}
    assert set(got) == {i for i, *_ in PAGES}
    for i, _, h in PAGES:
        r, data = got[i], (h or "").encode()
        assert r.payload_bytes == len(data) and r.request.record_type == "request" and r.metadata.extra == f"page: {i}\r\n"
        first = min(j for j, _, g in PAGES if g == h) if len(data) >= 100 else i
        assert (r.response.record_type, r.response.refers_to) == (("response", None) if first == i else ("revisit", f"urn:capture:response:{first}"))
        if first == i:
            assert bytes(r.response.payload) == data
    none = f"{path}-none"
    warc.write_archives(pages.limit(0), none)
    assert warc.assemble(warc.read_records(spark, none)).count() == 0


def test_warc_keeps_rows_of_null_and_repeated_keys(spark):
    same = "same " * 40
    rows = [(1, "u", same), (1, "v", "other"), (1, "w", same), (2, "u", same), (None, "u", same), (None, None, None), (None, "x", "alone " * 30), (None, "y", "alone " * 30), (5, "u", "once")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    captures = warc.archive_and_read(pages).collect()
    key = lambda r: r.metadata.extra.removeprefix("page: ").strip()
    got = sorted((key(r), r.payload_bytes, r.response.record_type, r.response.refers_to or "") for r in captures)
    first = "urn:capture:response:1"
    want = [("1", 200, "response", ""), ("1", 200, "response", ""), ("1", 5, "response", ""), ("2", 200, "revisit", first), ("", 200, "revisit", first), ("", 0, "response", ""), ("5", 4, "response", "")]
    assert got == sorted([*want, ("", 180, "response", ""), ("", 180, "response", "")])
    assert len({r.capture_id for r in captures}) == len(rows) and all(r.request and r.metadata for r in captures)


def test_url_rules_of_deep_templates(spark):
    rng = random.Random(9)
    fixed = [f"seg{chr(97 + i)}" for i in range(25)]
    rows = []
    for i in range(600):
        parts = [f for f in fixed if i % 2 or rng.random() < 0.9]
        rows.append(([f"p:{p}" for p in parts] + (["h:bad"] if i % 3 == 0 else ["h:good"]), i % 3 == 0))
    template = spark.createDataFrame([([f"p:{p}" for p in fixed] + ["h:bad" if i % 3 == 0 else "h:good"], i % 3 == 0) for i in range(600)], "tokens array<string>, bad boolean")
    assert {(tuple(r["items"]), r.verdict) for r in url_rules.mine(template).collect()} == {(("h:bad",), "block"), (("h:bad", "p:sega"), "block"), (("h:good",), "allow"), (("h:good", "p:sega"), "allow")}
    loose = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), max_length=2).collect()
    assert {tuple(r["items"]) for r in loose} >= {("h:bad",), ("h:good",), ("h:bad", "p:segc")} and max(r["size"] for r in loose) == 2


def test_both_miners_give_the_rules_of_all_token_sets(spark):
    from itertools import combinations

    rng = random.Random(10)
    rows = [([t for t in "abcdef" if rng.random() < 0.55], rng.random() < 0.4) for _ in range(120)] + [(["a", "b"], None), ([], True)]
    rows = [(t, bool(b)) for t, b in rows] + [(["a", "f"], True)] * 30
    want, n = set(), len(rows)
    for size in (1, 2, 3):
        for items in combinations("abcdef", size):
            held = [b for t, b in rows if set(items) <= set(t)]
            for verdict, count, share in (("block", sum(held), sum(b for _, b in rows) / n), ("allow", len(held) - sum(held), 1 - sum(b for _, b in rows) / n)):
                if held and count / n >= 0.05 and count / len(held) >= 0.5 and count / len(held) / share >= 1.05:
                    want.add((items, verdict, round(count / len(held), 9), round(count / n, 9)))
    df = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    for wide in (0, 12):
        got = url_rules.mine(df, 0.05, 0.5, 1.05, 3, wide).collect()
        assert {(tuple(r["items"]), r.verdict, round(r.confidence, 9), round(r.support, 9)) for r in got} == want and len(got) == len(want) > 5


def test_url_parts_and_fixed_rules(spark):
    cases = [
        ("HTTPS://WWW.Example.COM/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/"), ("http://m.example.com/en/2", "m.example.com", "/en/2", "example.com/en/"),
        ("http://notexample.com/en/2", "notexample.com", "/en/2", "com/"), ("http://example.net/fr/", "example.net", "/fr/", "net/fr/"), ("http://example.net/fr", "example.net", "/fr", None),
        ("http://com?q=/a", "com", "", None), ("x://y://z/", "y:", "//z/", None), (None, "", "", None), ("no scheme", "", "", None), ("http://", "", "", None), ("http://ÀB.org#f", "Àb.org", "", None),
    ]
    df = spark.createDataFrame([(i, u) for i, (u, *_) in enumerate(cases)], "page_id bigint, url string")
    rows = url_rules.split_url(df).withColumn("rule", url_rules.fixed_rule()).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule) for r in rows] == [c[1:] for c in cases]


def test_url_rules_are_mined(spark):
    rng = random.Random(2)
    pages, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        host = rng.choice(["ads.track.org", "spam.track.org"]) if bad else rng.choice(["news.good.org", "blog.track.org"])
        pages.append((i, f"http://{host}/{'buy' if bad else 'read'}/{i}", "h", i))
        if i % 2:
            labels.append((i, int(not bad), 0))
    pages += [(None, "http://ads.track.org/buy/1", "h", 0), (5, "http://ads.track.org/buy/77", "h", 0), (7777, None, "h", 0), (8888, "http://new.org/", "h", 0)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, tokens string, verdict bigint")
    rows = url_rules.judge(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert len(rows) == len(pages)
    assert all(r.verdict == ("block" if "/buy/" in r.path else "allow") for r in rows) and all(r.rule is None for r in rows)
    bare = url_rules.judge(df, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert {r.verdict for r in bare.collect()} == {"allow"} and url_rules.judge(df.limit(0), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).count() == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)], 0) for i in range(400)]
    rows += [(1000 + i, rows[i][1], 0) for i in range(60)]  # ties
    rows += [(2000, None, 0), (2020, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (2040, [float("nan")] * 6, 0), (2060, [float("inf")] * 6, 0), (2080, [], 0), (None, rows[0][1], 0), (3000, [1.0, 2.0], 0), (3020, [2.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")
    v = topk.quantized(df)
    good = {i: np.floor(np.array(x, np.float32).astype(float) * 64).astype(int) for i, x, _ in rows if i is not None and x and all(c is not None and math.isfinite(c) for c in x)}
    for k, shard_rows, block in ((20, 60, 7), (3, 4096, 1024)):
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(v, v.filter("vec_id % 20 = 0"), k, shard_rows=shard_rows, block_queries=block).collect()}
        want = {}
        for q in (i for i in good if i % 20 == 0):
            all_scores = sorted((-int(good[q] @ x), i) for i, x in good.items() if i != q and len(x) == len(good[q]))
            want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(all_scores[:k])}
        assert got == want
    assert topk.top_k(v.limit(0), v).count() == 0 and topk.top_k(v, v.limit(0)).count() == 0


def test_top_k_of_huge_components_and_repeated_rows(spark):
    rows = [(0, [1e15, 1.0]), (1, [1e16, 2.0]), (2, [-1e15, 5.0]), (3, [3.0, 1.0]), (3, [3.0, 1.0]), (4, [1e30, 1.0]), (20, [1.0, 0.5]), (20, [1.0, 0.5]), (40, [0.5, 9.0]), (40, [0.25, 9.0]), (5, [2e14, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    v = topk.quantized(df)
    assert v.count() == 10
    whole = [(i, [math.floor(64 * c) for c in x]) for i, x in rows if i != 4]
    for shard_rows in (3, 4096):
        got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(v, v.filter("vec_id % 20 = 0"), 4, shard_rows=shard_rows).collect()]
        want = []
        for q in (0, 20, 40):
            asks = min(x for i, x in whole if i == q)
            scores = sorted((-max(-topk.MOST, min(topk.MOST, sum(a * b for a, b in zip(asks, x)))), i) for i, x in whole if i != q)
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:4])]
        assert sorted(got) == sorted(want)


def test_lm_scores_equal_brute_force(spark):
    texts = [(i, t) for i, t in awkward() if len(t or "") < 5000] + [(20, "again one"), (None, "one two")]
    lists = [(t or "").lower().split() for _, t in texts]
    uni, bi, n = Counter(w for x in lists for w in x), Counter(p for x in lists for p in zip(x, x[1:])), sum(map(len, lists))
    want = []
    for (i, _), x in zip(texts, lists):
        u, b, rest, total, backed = Counter(x), Counter(zip(x, x[1:])), max(n - len(x), 1), 0.0, 0
        for k, w in enumerate(x):
            single = math.log((uni[w] - u[w] or lm_score.BACKOFF) / rest)
            c = bi[x[k - 1], w] - b[x[k - 1], w] if k else 0
            total += math.log(c / (uni[x[k - 1]] - u[x[k - 1]])) if c else single + (math.log(lm_score.BACKOFF) if k else 0)
            backed += bool(k and not c)
        want.append((i or -1, len(x), backed, round(total, 6)))
    docs = documents(spark, texts)
    for size in ({}, {"block_words": 50, "bucket_grams": 100}):
        got = [(r.doc_id or -1, r.n_words, r.n_backed_off, round(r.log_prob, 6)) for r in lm_score.score(docs, **size).collect()]
        assert sorted(got) == sorted(want)
    assert lm_score.score(docs.limit(0)).count() == 0


def test_queries_equal_their_sql(spark):
    sf = oracle.sf("0.001")
    con = oracle.connect(sf)
    for name, sql in ORACLES.items():
        assert oracle.compare(QUERIES[name](spark, sf).toPandas(), con.execute(sql).df()) is None, name


def test_pipeline_stages_follow_each_other(spark):
    import hashlib

    from siftmill.llm import decontaminate
    from siftmill.sources.tables import table
    from tests.llm.test_pairs import classes

    sf = oracle.sf("0.001")
    docs = table(spark, sf, "documents")
    model = toxicity.train(docs, table(spark, sf, "labels"))
    toxic = {r.doc_id for r in toxicity.score(docs, model).collect() if r.predicted}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in toxic}
    of = classes(list(texts.items()), percent=80, width=5)
    texts = {i: t for i, t in texts.items() if of[i] == i}
    leaks = {r.doc_id for r in decontaminate.find_overlaps(docs, table(spark, sf, "benchmark")).collect()}
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items() if i not in leaks}
    assert {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, sf).collect()} == want
    assert toxic and len(want) < docs.count()


def test_pipeline_drops_near_copies_on_five_words(spark):
    from tests.llm.test_pairs import shingle_set

    base = [f"n{i}" for i in range(50)]
    texts = [(1000, " ".join(base)), (1001, " ".join([*base[:25], "changed", *base[26:]])), *awkward()]
    sets = {i: shingle_set(t, 5) for i, t in texts}
    root = {i: i for i in sets}
    for _ in sets:  # the smallest id spreads along the links
        for a, x in sets.items():
            for b, y in sets.items():
                if root[b] < root[a] and x and y and 100 * len(x & y) >= 80 * len(x | y):
                    root[a] = root[b]
    kept = {r.doc_id for r in corpus_pipeline.one_of_each(spark, documents(spark, texts), "").collect()}
    assert kept == {i for i in root if root[i] == i} and 1000 in kept and 1001 not in kept
