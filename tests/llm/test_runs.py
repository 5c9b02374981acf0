"""Periodic runs against a search of every period."""

import random

import numpy as np

from siftmill.llm.runs import Grammar, find_runs, runs_of, with_longest
from tests.llm.data import DOC_DDL, awkward, documents


def all_runs(words, least=6, times=4):
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, times * q):
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted((s, length, q) for (s, length), q in found.items())


def periodic(rng, n, letters):
    words = [rng.randrange(letters) for _ in range(n)]
    if n and rng.random() < 0.7:
        a = rng.randrange(n)
        p = rng.randrange(1, 1 + max(1, (n - a) // 3))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if rng.random() < 0.3:
            words[rng.randrange(n)] = 99
    return words


def test_runs_equal_a_search_of_every_period():
    rng = random.Random(1)
    for _ in range(400):
        texts = [periodic(rng, rng.randrange(70), rng.choice([1, 2, 2, 3, 20])) for _ in range(rng.randrange(1, 6))]
        for least, times in ((6, 4), (2, 2), (4, 3)):
            got = runs_of([np.array(t, np.int64) for t in texts], least, times)
            assert [list(map(tuple, g.tolist())) for g in got] == [all_runs(t, least, times) for t in texts]


def test_common_lengths_equal_a_walk():
    rng = random.Random(2)
    for letters in (1, 2, 5):
        w = np.array([-1, *periodic(rng, 900, letters), -2])
        grammar = Grammar(w, enough=4)
        i = np.array([rng.randrange(1, 900) for _ in range(400)])
        j = i + np.array([rng.randrange(1, 901 - x) if x < 900 else 1 for x in i])
        ahead, back = grammar.common(i, j), grammar.common(i, j, backwards=True)
        for a, b, x, y in zip(i.tolist(), j.tolist(), ahead.tolist(), back.tolist()):
            assert (w[a : a + x] == w[b : b + x]).all() and w[a + x] != w[b + x]
            assert (w[a - y + 1 : a + 1] == w[b - y + 1 : b + 1]).all() and w[a - y] != w[b - y]


def kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_every_row_gets_its_runs(spark):
    rng = random.Random(3)
    texts = awkward() + [(300 + i, "\t".join(f"v{x}" for x in periodic(rng, 50, 3))) for i in range(40)]
    texts += [(400, "ha " * 3000), (401, "a b c 　 " * 9), (401, "a b c 　 " * 9), (None, "x y x y x y x y")]
    rows = with_longest(find_runs(documents(spark, texts))).collect()
    assert len(rows) == len(texts)
    want = []
    for i, t in texts:
        words = [w.decode() for w in (t or "").encode().split()]
        runs = all_runs(words) if len(words) < 20000 else []
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        want.append((str(i), len(words), runs, kept(words, runs), best and (best[1], -best[0], best[2])))
    got = [(str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed, r.longest and tuple(r.longest)) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_no_rows(spark):
    assert find_runs(spark.createDataFrame([], DOC_DDL)).count() == 0
