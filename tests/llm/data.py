"""Fixtures with every awkward case: nulls, empty and long texts, ties, repeats, clashing extra columns."""

import random

DOC_DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, n string, k string, class string, count int"


def documents(spark, texts):
    """texts: (doc_id, text) pairs; the other columns clash with names that the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "n", "k", "c", 1) for i, t in texts], DOC_DDL)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def awkward(seed=3):
    rng = random.Random(seed)
    base = words(rng, 120)
    texts = [(1, None), (2, ""), (3, "  \n\t "), (4, "One"), (5, "one"), (6, "one two"), (7, " ".join(words(rng, 30000))), (8, "x" * 60000), (9, "naïve 漢字 😀 don't  \n\n tail "), (10, "a <|endoftext|> b<|endoftext|>")]
    texts += [(20 + i, " ".join(base)) for i in range(4)]  # copies
    for i in range(30):  # near copies at all distances
        near = list(base)
        for _ in range(i // 3):
            near[rng.randrange(len(near))] = f"x{rng.randrange(9999)}"
        texts.append((40 + i, " ".join(near)))
    for i in range(25):  # small sets, where one shingle decides
        near = [f"s{j}" for j in range(12 + i % 5)]
        if i % 2:
            near[-1] = f"t{i}"
        texts.append((100 + i, " ".join(near)))
    texts += [(200 + i, " ".join(words(rng, rng.randrange(1, 60), 12))) for i in range(60)]  # few words, many shared shingles
    return texts
