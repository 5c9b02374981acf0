"""Worked examples and brute-force checks of the analytics."""

import itertools
import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftmill.operators import editjoin, graph, incremental, lettergroups, metrics, mining, ordered, pairs, similarity
from siftmill.plans import mining_plans
from siftmill.streaming import state
from siftmill.streaming.runner import event_stream, run_to_table
from tests import oracle


def test_decay_examples(spark):
    now = date(2024, 6, 1)
    rows = [("a", 0.90, now - timedelta(35)), ("b", 0.80, now - timedelta(65)), ("c", 0.70, now - timedelta(125)), ("d", 0.9, now - timedelta(29))]
    out = {r.rule_id: r for r in ordered.decayed(spark.createDataFrame(rows, "rule_id string, confidence double, last_hit date"), F.lit(now)).collect()}
    assert [round(out[k].new_confidence, 3) for k in "abcd"] == [0.81, 0.648, 0.459, 0.9]
    assert out["c"].needs_review and not out["b"].needs_review


def test_overlap_examples(spark):
    rows = [("x", i) for i in range(10)] + [("y", i) for i in range(2, 12)] + [("z", i) for i in range(8, 18)]
    occ = spark.createDataFrame(rows, "rule_id string, loc long")
    wanted = spark.createDataFrame([("x", "y"), ("x", "z"), ("x", "q")], "rule_a string, rule_b string")
    out = {r.rule_b: (r.co_occurrences, r.correlation) for r in pairs.cooccurrence_of(occ, wanted).collect()}
    assert out == {"y": (8, 0.8), "z": (2, 0.2), "q": (0, 0.0)}


def test_correlated_rules_exact_with_hot_location(spark, monkeypatch):
    random.seed(4)
    sets = {r: {0} | {random.randint(1, 40) for _ in range(random.randint(2, 14))} for r in range(60)}
    occ = spark.createDataFrame([(r, x) for r, s in sets.items() for x in s], "rule_id long, loc long")
    want = {
        (a, b) for a, b in itertools.combinations(sets, 2)
        if len(sets[a] & sets[b]) >= 3 and len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])) >= 0.6
    }
    for chunk in (50_000, 4):
        monkeypatch.setattr(pairs, "CHUNK", chunk)
        got = {(r.rule_a, r.rule_b) for r in pairs.correlated_rules(occ, 0.6, 3).collect()}
        assert got == want and want


def test_edit_conflicts_against_pairs(spark):
    rows = [(1, "f", 1, 5, 9), (2, "f", 2, 8, 12), (3, "f", 2, 20, 22), (4, "f", 3, 1, 30), (5, "g", 1, 1, 1)]
    edits = spark.createDataFrame(rows, "edit_id long, file string, user_id long, line_start int, line_end int")
    out = {r.file: (r.same_line, r.same_file) for r in pairs.edit_conflicts(edits).collect()}
    # Different users: (1,2) (1,4) (2,4) (3,4) overlap, (1,3) does not; (2,3) is one user.
    assert out == {"f": (4, 1), "g": (0, 0)}
    found = {(r.edit_a, r.edit_b) for r in pairs.overlapping_edits(edits, block=4).collect()}
    assert found == {(1, 2), (1, 4), (2, 4), (3, 4)}


def test_chain_links_across_buckets(spark):
    rows = [("f", i, f"t{i:03d}") for i in range(100)]
    df = spark.createDataFrame(rows, "file string, line int, task_id string")
    out = {r.task_id: r.previous for r in ordered.chain(df, ["file"], F.floor(F.col("line") / 7), ["line", "task_id"], "task_id").collect()}
    assert out["t000"] is None and all(out[f"t{i:03d}"] == f"t{i-1:03d}" for i in range(1, 100))


def test_clamped_value_matches_fold(spark):
    random.seed(2)
    base = datetime(2024, 1, 1)
    events = [("k", i, base + timedelta(minutes=random.randint(0, 5000)), random.choice([5, 0, -8, -15, 30])) for i in range(300)]
    df = spark.createDataFrame(events, "key string, id long, ts timestamp, delta int")
    value = 50
    for _, _, _, d in sorted(events, key=lambda e: (e[2], e[1])):
        value = min(95, max(10, value + d))
    got = ordered.clamped_value(df, ["key"], ["ts", "id"], "delta", 50, 10, 95, [F.date_trunc("hour", "ts"), F.date_trunc("day", "ts")]).collect()
    assert [(r.value, r.events) for r in got] == [(value, 300)]


def test_last_run(spark):
    rows = [("a", v, i) for i, v in enumerate(["x", "x", "y", "x", "x", "x"])] + [("b", "z", 0)]
    df = spark.createDataFrame(rows, "key string, v string, ts int")
    assert {(r.key, r.value, r.times_seen) for r in ordered.last_run(df, ["key"], "v", ["ts"]).collect()} == {("a", "x", 3), ("b", "z", 1)}


def test_components_equal_a_union_find(spark):
    random.seed(7)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 30)] + [(random.randint(2000, 2060), random.randint(2000, 2060)) for _ in range(40)]
    df = spark.createDataFrame(edges, "src long, dst long")
    root = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in root:
        for u, v in edges:
            if u != v:
                root[u] = root[v] = min(root[u], root[v])
    found = {tuple(r) for r in graph.components(df).collect()}
    assert found == set(root.items()) and (60, 0) in found and (1029, 1000) in found


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
        row = nxt
    return row[-1]


def _clusters(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    sizes = pd.Series([find(i) for i in ids]).value_counts()
    return {(i, find(i)) for i in ids if sizes[find(i)] > 1}


def test_near_duplicates_against_all_pairs(spark):
    random.seed(5)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]
    rows = []
    for i in range(70):
        pattern = list("select name from users where id = " + random.choice(["1", "22", "abc"]))
        for _ in range(random.randint(0, 6)):
            pattern[random.randrange(len(pattern))] = random.choice("xyz ")
        rows.append((i, "".join(pattern), " ".join(random.sample(words[:4], random.choice([3, 4]))), random.choice(["c", "d"])))
    rows += [(70 + i, "same", "one title", "c") for i in range(5)]
    df = spark.createDataFrame(rows, "id long, pattern string, title string, category string")

    def score(a, b):
        ta, tb = set(a[2].split()), set(b[2].split())
        p = 1 - _levenshtein(a[1], b[1]) / max(len(a[1]), len(b[1]))
        return 0.5 * p + 0.3 * len(ta & tb) / len(ta | tb) + 0.2 * (a[3] == b[3])

    linked = [(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if score(a, b) >= 0.9 - 1e-12]
    want = _clusters([r[0] for r in rows], linked)
    edges = similarity.near_duplicate_edges(df, 0.9, block=5)
    got = {tuple(r) for r in graph.components(edges).collect()}
    assert got == want and len(want) > 10


def test_unrelated_texts_are_told_apart_by_their_blocks():
    random.seed(16)
    draw = lambda n: "".join(random.choice("abcdefghi éß漢") for _ in range(n))
    xs = [draw(random.choice([0, 40, 63, 64, 300, 700])) for _ in range(40)]
    ys = []
    for x in xs:
        y = list(x)
        for _ in range(random.randrange(len(x) // 3 + 2)):
            at = random.randrange(len(y) + 1)
            y[at : at + random.randrange(3)] = draw(random.randrange(3))
        ys.append("".join(y))
    i, j = (k.ravel() for k in np.indices((len(xs), len(ys))))
    dist = np.array([similarity.edit_distance(xs[a], ys[b], 10**6) for a, b in zip(i, j)])
    for limit in (dist - 1, dist, dist // 2, np.array([max(len(xs[a]), len(ys[b])) // 5 for a, b in zip(i, j)])):
        assert not (similarity.beyond(xs, ys, i, j, limit) & (dist <= limit)).any()
    long = np.array([min(len(xs[a]), len(ys[b])) >= 300 and a != b for a, b in zip(i, j)])
    assert similarity.beyond(xs, ys, i, j, limit)[long].all()


def _prose(words, letters):
    text = ""
    while len(text) < letters:
        text += random.choice(words) + " "
    return text[:letters]


def _edited(text, edits):
    out = list(text)
    for _ in range(edits):
        at = random.randrange(len(out) + 1)
        out[at : at + random.randrange(3)] = random.choice(["", "a", "xé", "漢"])
    return "".join(out)


def test_distances_in_bands():
    random.seed(31)
    words = ["".join(random.choice("abcdé") for _ in range(random.randint(1, 6))) for _ in range(20)]
    for n in (3, 60, 400, 900):
        for edits in (0, 1, 9, 60, 200):
            a = _prose(words, n)
            b = _edited(a, edits)
            dist = _levenshtein(a, b)
            for limit in (0, dist - 1, dist, dist + 1, len(a) + len(b)):
                if limit >= 0:
                    assert min(similarity.edit_distance(a, b, limit), limit + 1) == min(dist, limit + 1)
                if abs(len(a) - len(b)) <= limit < max(len(a), len(b)) and limit and a and b:
                    longer, other = (a, b) if len(a) >= len(b) else (b, a)
                    assert similarity._banded(len(longer), other, similarity._places(longer), limit) == min(dist, limit + 1)


@pytest.mark.parametrize("bucket, step, table", [(256, 128, 1 << 27), (16, 8, 1 << 27), (32, 32, 3000)])
def test_letter_groups_keep_every_pair_within_its_limit(monkeypatch, bucket, step, table):
    random.seed(32)
    for name, value in (("BUCKET", bucket), ("STEP", step), ("HELD_BYTES", table)):
        monkeypatch.setattr(lettergroups, name, value)
    words = ["".join(random.choice("abcdefgh éß漢") for _ in range(random.randint(1, 7))) for _ in range(50)]
    bases = [_prose(words, n) for n in (20, 90, 300, 700)]
    xs, ys = ([_edited(random.choice(bases), random.choice([0, 2, 15, 60])) or "a" for _ in range(24)] for _ in range(2))
    dist = np.array([[similarity.edit_distance(x, y, 10**6) for y in ys] for x in xs])
    gap = np.array([[abs(len(x) - len(y)) for y in ys] for x in xs])
    for limit in (dist, dist - 1, dist // 2, dist + 4):
        near = (gap <= limit) & (np.random.default_rng(1).random(dist.shape) < 0.8)
        gone = lettergroups.apart(xs, ys, near, limit)
        assert not (gone & (dist <= limit)).any() and not (gone & ~near).any()


def test_long_windows_keep_every_pair_within_its_limit():
    random.seed(33)
    words = ["".join(random.choice("etaoinshr") for _ in range(random.randint(2, 9))) for _ in range(300)]
    bases = [_prose(words, 4000) for _ in range(3)]
    xs = [_edited(x, k) for x in bases for k in (0, 40, 500)]
    ys = [x[-700:] + x[:-700] for x in bases] + [_edited(x, 300) for x in bases]
    i, j = (k.ravel() for k in np.indices((len(xs), len(ys))))
    dist = np.array([similarity.edit_distance(xs[a], ys[b], 10**6) for a, b in zip(i, j)])
    for limit in (dist, dist + 50, np.maximum(dist - 1, 0)):
        assert not (similarity.beyond(xs, ys, i, j, limit) & (dist <= limit)).any()


def test_unrelated_texts_of_a_title_are_told_apart_before_their_blocks():
    """What is left for the blocks, whose cost grows with the square of the letters, is a few pairs in a hundred."""
    random.seed(34)
    words = ["".join(random.choices("etaoinshrdlucmfwypvbgk", [12, 9, 8, 8, 7, 7, 6, 6, 6, 4, 4, 3, 3, 2, 2, 2, 2, 2, 1, 1, 2, 1], k=random.randint(2, 9))) for _ in range(2000)]
    texts = [_prose(words, random.randint(1500, 1900)) for _ in range(120)]
    texts += [_edited(texts[0], 20), _edited(texts[1], 30)]
    n = len(texts)
    tile = similarity._Tile(pd.DataFrame({"id": range(n), "pattern": texts, "title": 1.0, "n": [len(t) for t in texts], "class": range(n), "side": 0}), similarity._Judge(0.9))
    assert {(0, 120), (1, 121)} <= {tuple(sorted(p)) for p in zip(tile.i.tolist(), tile.j.tolist())}
    assert len(tile.i) < 0.05 * n * (n - 1) / 2
    links = similarity._linked([tile, tile])
    assert {tuple(sorted(p)) for p in links[["src", "dst"]].to_numpy().tolist()} == {(0, 120), (1, 121)}


def test_tiles_are_whole_whatever_the_batches():
    rows = pd.DataFrame({"ta": [1, 1, 1, 2, 2, 3, 3, 3, 3], "tb": [1, 1, 2, 2, 2, 3, 3, 3, 3], "id": range(9)})
    for size in (1, 2, 3, 9):
        got = [t["id"].tolist() for t in similarity._tiles((rows.iloc[k : k + size] for k in range(0, 9, size)), ["ta", "tb"])]
        assert got == [[0, 1], [2], [3, 4], [5, 6, 7, 8]]
    assert not [*similarity._tiles(iter([rows.iloc[:0]]), ["ta", "tb"])]


def test_report_of_far_members_needs_no_wide_levenshtein(spark, capsys):
    """A chain's far member is compared with the kept rule once, bit-parallel."""
    random.seed(36)
    words = ["".join(random.choice("etaoinshr") for _ in range(random.randint(2, 9))) for _ in range(300)]
    first = _prose(words, 3000)
    texts = [first, _edited(first, 30), _edited(first, 900), "", None]
    rules = spark.createDataFrame([(i, t, "the title", "c") for i, t in enumerate(texts)], "id long, pattern string, title string, category string")
    report = similarity.dedup_report(spark.createDataFrame([(i, 0) for i in range(5)], "id long, cluster long"), rules)
    report.explain()
    assert "levenshtein" not in capsys.readouterr().out
    ratios = [1 - _levenshtein(first, t) / max(len(first), len(t)) if t else 0 for t in texts[1:]]
    assert [tuple(r) for r in report.collect()] == [(0, 5, 4, pytest.approx(sum(0.5 * r + 0.5 for r in ratios) / 4))]


def test_title_pairs_against_all_pairs(spark):
    random.seed(35)
    words = [f"w{int(random.paretovariate(0.6)) % 400}" for _ in range(4000)]
    rows, bases = [], [random.sample(words, n) for n in (1, 2, 3, 5, 9, 30, 300)]
    for tid in range(300):
        tokens = set(random.choice(bases)) if random.random() < 0.7 else set(random.sample(words, random.randint(1, 12)))
        tokens = {t for t in tokens if random.random() < 0.93} | set(random.sample(words, random.randrange(2)))
        rows.append((tid, random.choice(["a", "b", None]), sorted(tokens)))
    df = spark.createDataFrame([r for r in rows if r[2]], "tid long, category string, tokens array<string>")
    share = 2 / 3
    same = lambda a, b: len(a & b) / len(a | b)
    want = {(a[0], b[0]): same(set(a[2]), set(b[2])) for a, b in itertools.combinations([r for r in rows if r[2] and r[1]], 2) if a[1] == b[1] and same(set(a[2]), set(b[2])) >= share - 1e-9}
    got = similarity.title_pairs(df, share).collect()
    assert {(r.ta, r.tb): r.title for r in got} == pytest.approx(want) and len(got) == len(want) > 300


def test_rule_clusters_where_titles_repeat(spark):
    random.seed(11)
    words = [f"w{i}" for i in range(12)]
    bodies = [" ".join(random.choice(words) for _ in range(random.choice([4, 40, 45]))) for _ in range(8)]
    rows = []
    for i in range(160):
        body = list(random.choice(bodies))
        for _ in range(random.choice([0, 1, 3, 12])):
            body[random.randrange(len(body))] = random.choice("xyzé")
        title = random.choice(["the hot title", "the hot title", "the hot title here", "hot title the", "a b c d e f", "a b c d e g", ""])
        rows.append((i, "".join(body), title, random.choice(["c", "c", "d"])))
    df = spark.createDataFrame(rows, "id long, pattern string, title string, category string")

    def linked(a, b):
        ta, tb = set(a[2].split()), set(b[2].split())
        if a[3] != b[3] or not ta or not tb:
            return a[1:] == b[1:]
        ratio = 1 - _levenshtein(a[1], b[1]) / max(len(a[1]), len(b[1]))
        return 0.5 * ratio + 0.3 * len(ta & tb) / len(ta | tb) + 0.2 >= 0.9 - 1e-12

    want = _clusters([r[0] for r in rows], [(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if linked(a, b)])
    for block in (3, 64):
        assert {tuple(r) for r in graph.components(similarity.near_duplicate_edges(df, 0.9, block)).collect()} == want
    assert len(want) > 40
    assert similarity.near_duplicate_edges(df.limit(0), 0.9).count() == 0


@pytest.mark.parametrize("threshold, segmented", [(0.8, 128), (0.8, 9), (0.9, 128), (0.6, 20)])
def test_edit_links_against_all_pairs(spark, threshold, segmented):
    random.seed(12)
    bases = ["".join(random.choice("abé") for _ in range(random.choice([1, 2, 5, 11, 12, 20, 33]))) for _ in range(14)]
    texts = {""}
    for _ in range(120):
        body = list(random.choice(bases))
        for _ in range(random.randrange(4)):
            at = random.randrange(len(body) + 1)
            body[at : at + random.randrange(2)] = random.choice(["", "a", "b", "x"])
        texts.add("".join(body))
    rows = [(i, random.choice(["k", "l"]), t) for i, t in enumerate(sorted(texts))] + [(900, "k", None)]
    df = spark.createDataFrame(rows, "id long, ext string, text string")
    near = lambda a, b: a[1] == b[1] and a[2] and b[2] and 1 - _levenshtein(a[2], b[2]) / max(len(a[2]), len(b[2])) >= threshold - 1e-9
    want = _clusters([r[0] for r in rows], [(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if near(a, b)])
    links = editjoin.edit_links(df, ["ext"], threshold, segmented)
    assert {tuple(r) for r in graph.components(links).collect()} == want and len(want) > 20
    by = {r[0]: r for r in rows}
    assert all(near(by[r.src], by[r.dst]) for r in links.collect())


def test_every_close_pair_shares_a_segment(spark):
    random.seed(13)
    rows = []
    for i in range(300):
        a = "".join(random.choice("ab") for _ in range(random.randrange(1, 40)))
        b = list(a)
        for _ in range(random.randrange(9)):
            at = random.randrange(len(b) + 1)
            b[at : at + random.randrange(2)] = random.choice(["", "a", "b", "ab"])
        rows.append((i, a, "".join(b) or "a"))
    index, probe = editjoin.segment_keys(0.8)
    keys = lambda c: spark.createDataFrame(rows, "i long, a string, b string").selectExpr("i", f"{c} AS text", f"length({c}) AS n").selectExpr("i", f"{index} AS x", f"{probe} AS y").collect()
    for (i, a, b), ka, kb in zip(rows, keys("a"), keys("b")):
        if 1 - _levenshtein(a, b) / max(len(a), len(b)) >= 0.8 - 1e-9:
            short, long = (ka, kb) if len(a) <= len(b) else (kb, ka)
            assert set(short.x) & set(long.y), (a, b)


def test_vector_clusters_against_all_pairs(spark):
    random.seed(3)
    centres = [[random.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [x + random.gauss(0, 0.35) for x in random.choice(centres)]) for i in range(120)] + [(500, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    vec = {r.id: r.embedding for r in df.collect()}

    def cos(a, b):
        na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / (na * nb) if na and nb else 0.0

    linked = [(a, b) for a, b in itertools.combinations(vec, 2) if cos(vec[a], vec[b]) >= 0.9]
    edges = similarity.vector_edges(df, 0.9, block=7)
    assert {tuple(r) for r in graph.components(edges).collect()} == _clusters(list(vec), linked)


def test_vectors_that_pivots_cannot_part_are_sent_in_plain_tiles(spark, monkeypatch):
    random.seed(5)
    vec = {i: [random.gauss(0, 1) for _ in range(32)] for i in range(400)}
    df = spark.createDataFrame(list(vec.items()), "id long, embedding array<float>")
    sent, by_tile = [], similarity.by_tile
    monkeypatch.setattr(similarity, "by_tile", lambda tiles, keys: by_tile((sent.append(tiles.count()), tiles)[1], keys))
    x = [[v / math.sqrt(sum(y * y for y in row)) for v in row] for row in vec.values()]
    linked = [(a, b) for a, b in itertools.combinations(vec, 2) if sum(p * q for p, q in zip(x[a], x[b])) >= 0.4]
    assert {tuple(r) for r in graph.components(similarity.vector_edges(df, 0.4, block=200)).collect()} == _clusters(list(vec), linked)
    assert sent[0] <= 400 * 4


def test_pairs_that_meet_by_chance_are_no_candidates(spark, monkeypatch):
    random.seed(9)
    held = {r: random.sample(range(3000), 30) for r in range(300)} | {r: [*range(20), 5000 + r, 6000 + r] for r in (900, 901)}
    rows = [(r, loc) for r, locs in held.items() for loc in locs]
    occ = spark.createDataFrame(rows, "rule_id long, loc long")
    counted, exact = [], pairs.cooccurrence_of
    monkeypatch.setattr(pairs, "cooccurrence_of", lambda o, wanted: exact(o, (counted.append(wanted.count()), wanted)[1]))
    got = {(r.rule_a, r.rule_b, r.co_occurrences) for r in pairs.correlated_rules(occ, 0.1, 3).collect()}
    expected = {(a, b, n) for a, b in itertools.combinations(held, 2) if (n := len({*held[a]} & {*held[b]})) >= max(3, 0.1 * min(len(held[a]), len(held[b])))}
    assert got == expected and (900, 901, 20) in got
    assert counted == [len(expected)]


def test_mining_example(spark):
    rows = [(".php", f"$x = $_GET['{n}'];", f"f{i}.php") for i, n in enumerate(["name", "nome", "names", "game", "fame"])]
    df = spark.createDataFrame(rows, "ext string, text string, path string")
    out = mining.mined_patterns(df, threshold=0.7, min_occurrences=3).collect()
    assert [(r.category, r.severity, r.occurrences, r.confidence) for r in out] == [("php-security", "CRITICAL", 5, 0.5)]
    assert r"\$x = \$_GET\['" in out[0].pattern


def test_common_substring_in_slices(spark):
    rows = [("c", f"{i:03d} shared part {i % 7}") for i in range(40)]
    df = spark.createDataFrame(rows, "k string, text string")
    assert [r.text for r in mining.common_substring(df.repartition(3), ["k"]).collect()] == [" shared part "]


def test_common_substring_of_long_texts(spark):
    random.seed(14)
    long = lambda: "".join(random.choice("abcdefgh ") for _ in range(5000))
    rows = [(1, long() + "<the part that all of them hold>" + long()) for _ in range(20)] + [(2, "ab"), (2, "cd"), (3, ""), (4, "only one")]
    got = {r.k: r.text for r in mining.common_substring(spark.createDataFrame(rows, "k int, text string"), ["k"]).collect()}
    assert got == {1: "<the part that all of them hold>", 2: "", 3: "", 4: "only one"}


def test_automaton_against_every_substring():
    random.seed(15)
    for _ in range(300):
        base, *others = ("".join(random.choice("abc") for _ in range(random.randrange(13))) for _ in range(3))
        states = mining.Automaton(base)
        for text in others:
            for state, run in enumerate(states.held(text)):
                ends = [base[: states.first[state] + 1][-k:] for k in range(states.length[states.link[state]] + 1 if state else 1, states.length[state] + 1)]
                assert run == max((len(x) for x in ends if x in text), default=0)


def test_common_substring_does_not_depend_on_the_split(spark):
    rows = [("fold", t) for t in ("1aaaaa_bbbb", "2aaaaa|bbbb", "3bbbb")] + [("none", "abc"), ("none", "xyz"), ("empty", ""), ("empty", "a"), ("one", "only é漢 this")]
    rows += [("big", f"{i:05d} alpha{'+' if i % 3 else '-'} beta {'gamma' * (i % 700 != 0)}") for i in range(1300)]
    df = spark.createDataFrame(rows, "k string, text string").repartition(5)
    for size in (1, 2, 500, 5000):
        got = {r.k: r.text for r in mining.common_substring(df.repartition(size), ["k"]).collect()}
        assert got == {"fold": "bbbb", "none": "", "empty": "", "one": "only é漢 this", "big": " alpha"}


def test_merged_rules_are_one_row_at_every_size(spark):
    rows = [(i, f"p{i % 1500:04d}", i / 1000) for i in range(1600)] + [(5000, "alone", 1.0), (5001, "alone", 1.0)]
    rules = spark.createDataFrame(rows, "id bigint, pattern string, confidence double")
    clusters = rules.select("id", F.when(F.col("id") < 5000, 0).otherwise(5000).cast("bigint").alias("cluster"))
    got = {r.cluster: (r.primary, r.members, r.merged_pattern) for r in similarity.merged_rules(clusters, rules).collect()}
    assert similarity.merged_rules(clusters, rules).count() == 2
    assert got == {0: (1599, 1600, "|".join(f"(p{i:04d})" for i in range(1500))), 5000: (5000, 2, "alone")}


def test_refined_pattern(spark):
    rows = [("r", "echo $a esc_html", True)] * 4 + [("r", "echo $b raw", False)] * 4 + [("s", "echo $b raw", False)] * 4
    fb = spark.createDataFrame(rows, "rule_id string, match_text string, is_fp boolean")
    rules = spark.createDataFrame([("r", r"^(?=echo)"), ("s", r"echo")], "rule_id string, pattern string")
    out = mining.refined_patterns(fb, rules).collect()
    assert [(r.rule_id, r.accuracy_before, r.kept) for r in out] == [("r", 0.5, False)] or out[0].rule_id == "r"


def test_consensus_and_ab(spark):
    v = spark.createDataFrame([("r", "yes", 0.9), ("r", "yes", 0.7), ("r", "no", 0.9), ("s", "no", 0.5)], "rule_id string, verdict string, confidence double")
    out = {r.rule_id: (r.consensus, round(r.confidence, 3), r.needs_human) for r in metrics.consensus(v, "rule_id").collect()}
    assert out == {"r": ("yes", 0.533, True), "s": ("no", 0.5, True)}
    rows = [(1, ver, i, tp, 10 - tp, 0, 1, 0) for ver, tp in (("baseline", 5), ("variant", 8)) for i in range(3)]
    res = spark.createDataFrame(rows, "test_id long, version string, scan_id long, true_positives int, false_positives int, false_negatives int, fix_success int, fix_failure int")
    assert metrics.ab_winner(metrics.ab_metrics(res), 3).first().winner == "variant"
    assert metrics.ab_winner(metrics.ab_metrics(res), 4).first().winner is None


def test_feedback_null_is_no_feedback(spark):
    rows = [("card", True, True), ("card", True, None), ("card", False, False), ("card", True, False)]
    df = spark.createDataFrame(rows, "component_type string, auto_applied boolean, accepted boolean")
    r = metrics.confusion(df, "component_type").first()
    assert (r.sample_size, r.tp, r.fp, r.fn, r.tn) == (3, 1, 1, 0, 1)


def test_incremental_keeps_clean_files(spark):
    files = spark.createDataFrame([("p", "a", "bad"), ("p", "b", "fine"), ("p", "c", "bad")], "project string, path string, content string")
    cache = incremental.content_hashes(files.filter("path != 'c'")).withColumn("rule_version", F.lit("v"))
    seen = []

    def fresh(todo):
        seen.extend(r.path for r in todo.collect())
        return todo.filter("content = 'bad'").select("project", "path")

    old = spark.createDataFrame([("p", "a")], "project string, path string")
    out = incremental.incremental_scan(files, cache, old, F.lit("v"), fresh)
    assert sorted(r.path for r in out.collect()) == ["a", "c"] and seen == ["c"]


def test_files_of_one_path_in_two_projects_are_two_files(spark):
    files = spark.createDataFrame([("p", "a", "same"), ("q", "a", "same"), ("q", "b", "new")], "project string, path string, content string")
    old = incremental.content_hashes(files.filter("project = 'p'"))
    assert sorted((r.project, r.path) for r in incremental.changed_files(incremental.content_hashes(files), old).collect()) == [("q", "a"), ("q", "b")]
    hits = spark.createDataFrame([("p", "a"), ("q", "a")], "project string, path string")  # q's hit is of a file no longer cached
    out = incremental.incremental_scan(files, old.withColumn("rule_version", F.lit("v")), hits, F.lit("v"), lambda todo: todo.filter("path = 'b'").select("project", "path"))
    assert sorted(tuple(r) for r in out.collect()) == [("p", "a"), ("q", "b")]


def test_debounce_over_several_batches(spark, tmp_path):
    base = datetime(2024, 1, 1)
    times = [0, 200, 600, 700, 1200, 1699, 1700, 5000]
    rows = [(i, base + timedelta(milliseconds=t), 1, "view", 1.0, '{"k": 1}') for i, t in enumerate(times)]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    for n, part in enumerate((rows[:3], rows[3:6], rows[6:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        import time

        time.sleep(1.1)  # file sources order by modification time
    stream = event_stream(spark, str(tmp_path), files_per_trigger=1, name="in")
    out = run_to_table(state.debounced(stream, "user_id", 500), "debounce-test")
    assert sorted(times[r.event_id] for r in out.collect()) == [0, 600, 1200, 1700, 5000]


def test_relations_of_duplicates_stay_where_they_are(spark):
    hits = spark.createDataFrame([(1, 1, 1, 10), (1, 2, 1, 11), (1, 3, 1, 30), (2, 1, 1, 11)], "scan_id bigint, line int, file bigint, rule_id bigint")
    relations = spark.createDataFrame([(10, 11)], "rule_a bigint, rule_b bigint")
    out = pairs.mark_related_duplicates(hits, relations, ["scan_id"], ["line", "file"])
    assert {(r.scan_id, r.rule_id): r.removed for r in out.collect()} == {(1, 10): False, (1, 11): True, (1, 30): False, (2, 11): False}
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "first_rule" in line]


def test_distance_of_turns_is_computed_once(spark):
    df = spark.createDataFrame([(1, 0, "u", "kitten"), (1, 1, "u", "sitting"), (1, 2, "v", ""), (1, 3, "v", None), (2, 0, None, "née"), (2, 1, "u", "nee")], "conv_id bigint, turn bigint, role string, text string")
    pair = df.alias("x").join(df.alias("y"), (F.col("x.conv_id") == F.col("y.conv_id")) & (F.col("x.turn") + 1 == F.col("y.turn")))
    out = pair.select(F.col("x.conv_id").alias("c"), F.col("x.turn").alias("t"), similarity.text_ratio(F.col("x.text"), F.col("y.text")).alias("r"))
    ratios = {(r.c, r.t): r.r for r in out.collect()}
    assert ratios[1, 0] == 1 - 3 / 7 and ratios[1, 1] == ratios[1, 2] == 0 and ratios[2, 0] == 1 - 1 / 3
    plan = mining_plans.turn_similarity(spark, oracle.sf("0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan and plan.count("ArrowEvalPython") == 1
