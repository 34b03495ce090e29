import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import lm, storage
from tessera.llm.grams import GramModel, train_grams


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower(text)), "\n"]


def brute(train, texts):
    one, two = Counter(), Counter()
    for t in train:
        own = tokens(t)
        one.update(own)
        two.update(zip(["\r", *own[:-1]], own, strict=True))
    n, v = sum(one.values()), len(one)
    follows, total, kinds = Counter(), Counter(), defaultdict(Counter)
    for (a, b), c in two.items():
        follows[b] += 1
        total[a] += c
        kinds[a][min(c, 3)] += 1

    def discounts(values):
        k = Counter(min(x, 5) for x in values)
        return lm._discounts([k[i] for i in (1, 2, 3, 4)])

    d, e = discounts(two.values()), discounts(follows.values())
    left = sum(e[min(c, 3) - 1] for c in follows.values()) / len(two)

    def q(b):
        c = follows[b]
        return (max(c - e[min(c, 3) - 1], 0) if c else 0) / len(two) + left / (v + 1)

    def p(a, b):
        if not total[a]:
            return q(b)
        c = two[a, b]
        own = max(c - d[min(c, 3) - 1], 0) / total[a] if c else 0
        return own + sum(d[k - 1] * m for k, m in kinds[a].items()) / total[a] * q(b)

    out = []
    for t in texts:
        own = tokens(t)
        out.append(
            (
                len(own),
                sum(one[x] > 0 for x in own),
                n,
                sum(math.log10((one[x] + 1) / (n + v + 1)) for x in own),
                sum(math.log10(p(a, b)) for a, b in zip(["\r", *own[:-1]], own, strict=True)),
            )
        )
    chance = sum(p("the", b) for b in one) + p("the", "never seen")
    return out, chance


TEXTS = [
    "the cat sat on the mat the cat ran",
    "The dog sat on the mat\tand the\x0bcat slept",
    None,
    "",
    " \n ",
    "é x y the the the the",
    "unseen words only here",
    "the cat sat on the mat the cat ran",
    "a " * 3000,
]


@pytest.mark.parametrize("small", [False, True])
def test_matches_brute_force(spark, small):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keys string")
    options = {"buffer": 5, "word_shard_bytes": 40, "pair_shard_bytes": 30} if small else {}
    model = lm.train(docs.where("doc_id != 6"), **options)
    got = {r["doc_id"]: tuple(r)[1:] for r in lm.score(docs, model).collect()}
    want, chance = brute([t for i, t in enumerate(TEXTS) if i != 6], TEXTS)
    assert chance == pytest.approx(1)
    for i, w in enumerate(want):
        assert got[i] == pytest.approx(w), i


def test_frequent_words_are_dealt_by_their_followers(spark):
    texts = [" ".join(f"hot w{i * 50 + k}" for k in range(50)) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = lm.train(docs, pair_shard_bytes=3000)
    assert len(model.hot)
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, model).collect()}
    want, _ = brute(texts, texts)
    for i, w in enumerate(want):
        assert got[i] == pytest.approx(w[4])


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(docs, lm.train(docs)).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = lm.score(one, lm.train(docs)).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (3, 0, 0, 0.0, 0.0)


def brute_grams(train, texts, order):
    """Scores by the recursive definition, over tuples of words."""
    def padded(t):
        return ["\r"] * (order - 1) + tokens(t)

    levels = {order: Counter(tuple(s[i - order + 1 : i + 1]) for s in map(padded, train) for i in range(order - 1, len(s)))}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    types = len({g[-1] for g in levels[order]})
    d, contexts = {}, {}
    for k, grams in levels.items():
        n = Counter(min(c, 5) for c in grams.values())
        d[k] = (0, *lm._discounts([n[i] for i in (1, 2, 3, 4)]))
        contexts[k] = defaultdict(Counter)
        for g, c in grams.items():
            contexts[k][g[:-1]]["all"] += c
            contexts[k][g[:-1]][min(c, 3)] += 1

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / (types + 1)
        own = contexts[k].get(g[:-1])
        if own is None:
            return p(g[1:])
        c = levels[k][g]
        left = sum(d[k][i] * own[i] for i in (1, 2, 3)) / own["all"]
        return max(c - d[k][min(c, 3)], 0) / own["all"] + left * p(g[1:])

    out = []
    for t in texts:
        s = padded(t)
        out.append(sum(math.log10(p(tuple(s[i - order + 1 : i + 1]))) for i in range(order - 1, len(s))))
    return out


@pytest.mark.parametrize("order,shard_rows", [(2, 2_000_000), (3, 4), (4, 50)])
def test_any_order_matches_brute_force(spark, order, shard_rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, k1 string").repartition(3)
    training = docs.where("doc_id != 6")
    model = train_grams(training, order, buffer=7, shard_rows=shard_rows)
    got = {r["doc_id"]: r for r in lm.score(docs, model).collect()}
    known = [t for i, t in enumerate(TEXTS) if i != 6]
    pairs, _ = brute(known, TEXTS)
    for i, w in enumerate(brute_grams(known, TEXTS, order)):
        assert got[i]["score"] == pytest.approx(w), i
        assert tuple(got[i])[1:5] == pytest.approx(pairs[i][:4])
        if order == 2:
            assert w == pytest.approx(pairs[i][4])
    if order == 3:
        assert isinstance(lm.train(training, order=3), GramModel)
        beyond = lm.train(training, most_types=3)  # more words than pairs can number
        assert isinstance(beyond, GramModel) and beyond.order == 2
        assert {r["doc_id"]: r["score"] for r in lm.score(docs, beyond).collect()} == pytest.approx({i: w[4] for i, w in enumerate(pairs)})
        assert lm.score(docs.where("false"), train_grams(docs.where("false"), 3)).count() == 0


def test_arrays_read_are_bounded(tmp_path):
    for i in range(5):
        storage.save_array(f"{tmp_path}/{i}.npy", np.arange(1000))
    held = storage.Arrays(limit=20_000)
    held._cost = lambda array: array.nbytes  # as if they were read, not mapped
    for i in (0, 1, 2, 0, 3, 4):
        assert held.load(f"{tmp_path}/{i}.npy")[7] == 7
    assert list(held.open) == [f"{tmp_path}/{i}.npy" for i in (3, 4)] and held.held == 16_000
