"""The Jaccard join and decontamination against brute force."""

import itertools
import random

import numpy as np
import pytest

from siftmill.llm import decontaminate, ngram_join
from tests.llm.data import DOC_DDL, awkward, documents, words


def shingle_set(text, width=3):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def classes(texts, percent=90, width=3):
    sets = [(i, shingle_set(t, width)) for i, t in texts if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                u, v = find(i), find(j)
                root[max(u, v)] = min(u, v)
    return {i: find(i) for i in root}


@pytest.mark.parametrize("seed", [3, 4])
def test_classes_equal_brute_force(spark, seed):
    texts = awkward(seed)
    got = {r.doc_id: r for r in ngram_join.jaccard_classes(documents(spark, texts)).collect()}
    assert {i: r.component_id for i, r in got.items()} == classes(texts)
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(shingle_set(t)) for i, t in texts}


def test_repeated_and_null_keys_and_empty_tables(spark):
    text = " ".join(f"a{i}" for i in range(40))
    rows = [(1, text), (1, text), (5, text + " more"), (None, text), (9, None)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in ngram_join.jaccard_classes(documents(spark, rows)).collect())
    assert got == [(False, 1, 1), (False, 1, 1), (False, 5, 1), (False, 9, 9), (True, 0, None)]
    assert ngram_join.jaccard_classes(documents(spark, rows).limit(0)).count() == 0
    docs = documents(spark, rows)
    kept = ngram_join.keep_one(docs, ngram_join.jaccard_classes(docs))
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "9", "None"]


def test_every_linked_pair_shares_a_cell():
    rng = np.random.default_rng(5)
    bands = ngram_join.Bands(90)
    for n in [*range(1, 60), 99, 100, 101, 500, 1500]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            most = max(k for k in range(n + 1) if 100 * (n - k) >= 90 * (n + k))  # words swapped by a pair at the threshold
            b = np.unique(np.concatenate([a[most:], rng.integers(0, 1 << 63, most).astype(np.uint64)]))
            more = np.unique(np.concatenate([a, rng.integers(0, 1 << 63, n // 9).astype(np.uint64)]))
            cells = set(bands.cells(a).tolist())
            assert cells & set(bands.cells(b).tolist()) and (100 * n < 90 * len(more) or cells & set(bands.cells(more).tolist()))


def test_rtree_join_gives_all_pairs_within_the_bound():
    rng = np.random.default_rng(2)
    points = rng.poisson(2.0, (300, ngram_join.GROUPS)).astype(np.int64)
    points[150:] = points[:150] + (rng.random((150, ngram_join.GROUPS)) < 0.03)
    sizes = points.sum(1)
    tree = ngram_join.RTree(points, sizes)
    got = {(int(i), int(j)) for a, b in tree.join(tree, 90) for i, j in zip(a, b)}
    low = np.minimum(points[:, None], points[None]).sum(2) * 190 >= 90 * (sizes[:, None] + sizes[None])
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(low))} and len(got) < 300 * 300 / 4


def test_texts_that_share_a_line_only_do_not_meet(spark, monkeypatch):
    rng = random.Random(7)
    line = "one line that a great many of the texts begin with"
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    texts = [f"{line} {words(120)}" for _ in range(60)]
    near = [t.rsplit(" ", 2)[0] for t in texts[:5]]
    docs = spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string")
    sent, search = [], ngram_join._candidates
    monkeypatch.setattr(ngram_join, "_candidates", lambda members, percent: search((sent.append(members.count()), members)[1], percent))
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_classes(docs, percent=80).collect()}
    assert got == {i: i for i in range(60)} | {60 + i: i for i in range(5)}
    assert sent == [0]


def test_pairs_of_a_cell_are_bounded_before_they_leave_it(spark):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for _ in range(40):  # kin of one text, far from each other
        text = list(base)
        for at in rng.sample(range(150), 8):
            text[at] = f"z{rng.randrange(10**9)}"
        texts.append(" ".join(text))
    texts += [f"{t} end" for t in texts[:5]]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    points = ngram_join._points(docs, 5, ngram_join.Bands(80))
    cells = points.selectExpr("explode(array(1L, 2L, 3L)) AS cell", "0 AS page_a", "0 AS page_b", "0 AS page", "id", "id AS class", "need", "fine")
    found = [(r.a, r.b) for r in ngram_join._candidates(cells.coalesce(1).sortWithinPartitions("cell", "id"), 80).collect()]
    sets = [shingle_set(t, 5) for t in texts]
    links = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert set(found) >= links >= {(i, 40 + i) for i in range(5)} and len(found) <= len(links) + 20
    assert len(found) == len(set(found))  # though they share three cells


def test_counts_above_the_greatest_lose_no_link(spark, monkeypatch):
    texts = awkward(6)
    monkeypatch.setattr(ngram_join, "MOST", 1)
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_classes(documents(spark, texts)).collect()} == classes(texts)


def test_large_cells_are_cut_into_pages(spark, monkeypatch):
    texts = awkward(6)
    monkeypatch.setattr(ngram_join, "PAGE", 3)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_classes(documents(spark, texts)).collect()}
    assert got == classes(texts)


def leak_fixture():
    rng = random.Random(11)
    items = [(i, " ".join(words(rng, n, 5000))) for i, n in enumerate([40, 25, 15, 9, 6, 4, 60])] + [(90, None), (91, ""), (None, "a b c d e f g h i j k l m n")]
    by = dict(items)
    noise = lambda n: " ".join(f"z{rng.randrange(10**6)}" for _ in range(n))
    docs = [(1, noise(300)), (2, f"{noise(50)} {by[0]} {noise(50)}"), (3, by[1].upper().replace(" ", ",  ")), (7, None), (8, ""), (9, by[5]), (10, f"{noise(20)} {by[3]} {noise(5)}"), (11, f"{by[4]} {noise(9)}"), (12, noise(40000) + " " + by[6])]
    swapped = by[0].split()
    for at in range(4, 40, 7):
        swapped[at] = "changed"
    docs += [(4, f"{noise(30)} {' '.join(swapped)}"), (5, " ".join(by[0].split()[:10]) + " " + noise(40)), (6, f"{by[1]} {noise(10)} {by[2]}")]
    return items, docs


def test_overlaps(spark):
    items, docs = leak_fixture()
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")
    frame = documents(spark, docs + docs[:2])
    found = decontaminate.find_overlaps(frame, bench)
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got == {(2, 0), (3, 1), (4, 0), (6, 1), (6, 2), (10, 3), (11, 4), (12, 6)}
    spans = {(r.doc_id, r.item_id): (r.doc_start, r.matched) for r in found.collect()}
    assert spans[2, 0] == (50, 40) and spans[12, 6] == (40000, 60) and spans[4, 0][1] == 34
    flags = decontaminate.flag(frame, found)
    assert flags.count() == len(docs) + 2 and {r.doc_id for r in flags.filter("contaminated").collect()} == {d for d, _ in got}
    kept = decontaminate.decontaminate(frame, bench)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {1, 5, 7, 8, 9}


def test_overlaps_of_empty_tables(spark):
    items, docs = leak_fixture()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    frame = documents(spark, docs)
    assert decontaminate.find_overlaps(frame, bench.limit(0)).count() == 0
    assert decontaminate.find_overlaps(spark.createDataFrame([], DOC_DDL), bench).count() == 0
    assert decontaminate.decontaminate(frame, bench.limit(0)).count() == len(docs)


def test_best_stretch_equals_brute_force():
    rng = np.random.default_rng(9)
    for n in [*range(1, 30), *range(1, 30)]:
        same = rng.random(n) < rng.choice([0.4, 0.7, 0.9])
        around = []
        for p in np.flatnonzero(same):
            spans = [(a, b) for a in range(p + 1) for b in range(p + 1, n + 1)]
            a, b = max(spans, key=lambda s: (3 * same[s[0] : s[1]].sum() - 2 * (s[1] - s[0]), s[1] - s[0]))
            around.append((-same[a:b].sum(), b - a, a, b))
        want = min(around, default=(0, 0, 0, 0))
        assert decontaminate.best_stretch(same) == (want[2], want[3], -want[0])


def test_every_stretch_of_a_diagonal_is_looked_at(spark):
    item = [f"i{k}" for k in range(50)]
    runs = {1: (8, 10, 12), 2: (8, 10, 20), 3: (9, 12, 24), 4: (8, 4, 8), 5: (8, 30, 11)}
    docs = [(i, " ".join([*item[:a], *[f"x{k}" for k in range(gap)], *item[a + gap : a + gap + b], "end"])) for i, (a, gap, b) in runs.items()]
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id bigint, text string")
    got = {r.doc_id: (r.matched, r.span, r.item_start) for r in decontaminate.find_overlaps(documents(spark, docs), bench).collect()}
    assert got == {1: (12, 12, 18), 2: (28, 38, 0), 3: (33, 45, 0), 4: (16, 20, 0)}  # 2 to 4: as good together as the first run alone


def test_every_allowed_placement_leaves_a_seed():
    for n in range(5, 21):
        masks = decontaminate.masks_for({n})
        need = min(12, -(-4 * n // 5))
        placements = [x for k in range(n - need + 1) for x in itertools.combinations(range(n), k)]
        for off in placements if n < 17 else [*random.Random(n).sample(placements, 3000), *((2, 4, 6, 9, 13, 14) for _ in range(n > 18))]:
            same = np.ones(n, bool)
            same[list(off)] = False
            if decontaminate.best_stretch(same)[2] >= need:
                whole = [same[np.arange(n - m[-1])[:, None] + np.array(m)].all(1).any() for m in masks if m[-1] < n]
                assert any(whole), (n, off)


def test_a_changed_word_at_each_place_of_short_items(spark):
    bench = spark.createDataFrame([(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in range(5, 21)], "item_id bigint, text string")
    docs = [(100 * n + at, " ".join(["lead", *(f"i{n}x{k}" if k != at else "changed" for k in range(n)), "end"])) for n in range(5, 21) for at in range(n)]
    found = decontaminate.find_overlaps(documents(spark, docs), bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(i, i // 100) for i, _ in docs}


def test_repeated_keys_keep_their_own_texts(spark):
    items, _ = leak_fixture()
    docs = [(1, items[0][1]), (1, items[1][1]), (1, " ".join([*items[0][1].split()[:4], "x"])), (1, items[6][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r.item_id, r.matched) for r in decontaminate.find_overlaps(documents(spark, docs), bench).collect()} == {(0, 40), (1, 25), (6, 60)}
