"""MinHash near-dedup against all pairs of whole sets: edited copies, stars, templates, odd rows."""

import random
from collections import Counter
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillgrid.llm import minhash, simhash
from rillgrid.llm.minhash import SCHEMES


def word_sets(text, size):
    words = text.encode().lower().split() if text else []
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


def brute(rows, scheme):
    """The component of each row by all pairs; rows with an empty set are on their own."""
    sets = [word_sets(r[1], scheme.shingle) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= scheme.percent * max(len(a), len(b)) and 100 * len(a & b) >= scheme.percent * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return sets, [root(i) for i in range(len(rows))]


def edited(text, words, seed):
    rng, out = random.Random(seed), text.split(" ")
    for i in rng.sample(range(len(out)), words):
        out[i] = f"changed{rng.randrange(10**6)}"
    return " ".join(out)


def tables():
    rng = random.Random(8)
    text = lambda n, of=5000: " ".join(f"w{rng.randrange(of)}" for _ in range(n))
    bases = [text(300) for _ in range(20)]
    copies = list(enumerate(bases)) + [(1000 + 10 * i + k, edited(t, c, 10 * i + k)) for i, t in enumerate(bases) for k, c in enumerate((1, 4, 7, 10, 30))]
    group = text(200)
    copies += [(5000 + i, edited(group, 1 + i % 12, i)) for i in range(150)]  # a crowded list, many of whose pairs are no links
    stars = []
    for g in range(12):  # members are links of the centre only, which has neither the least nor the greatest id
        center = text(400)
        stars += [(1000 * g + 500, center)] + [(1000 * g + 100 * i + 7, edited(center, 9, 1000 * g + i)) for i in range(9)]
    notice, words = text(60), [text(3, 9) for _ in range(40)]
    templates = [(i, notice + " " + text(40)) for i in range(150)] + [(1000 + i, notice + " " + " ".join(rng.sample(words, 8))) for i in range(150)]
    steps = text(300).split(" ")
    chain = [(900 - i, " ".join(steps[5 * i : 5 * i + 120])) for i in range(30)]
    odd = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two"), (8, "one two"), (None, bases[0]), (None, "alone here now"), (9, "long " * 100 + text(20_000)), (10, bases[0].upper())]
    return {"copies": copies, "stars": stars, "templates": templates, "chain": chain, "odd": odd + copies[:3] * 2 + [(0, "another text of id 0")]}


COLUMNS = "doc_id long, text string, k string, r string, node string, n string, sig string, key string, root string, row string, own string"


@pytest.mark.parametrize(("name", "kind"), [("copies", "op11"), ("stars", "stage"), ("templates", "op11"), ("chain", "op11"), ("odd", "op11")])
def test_components_equal_brute_force(spark, name, kind):
    rows, scheme = tables()[name], SCHEMES[kind]
    sets, roots = brute(rows, scheme)
    ids = {}
    for r, c in zip(rows, roots, strict=True):
        ids.setdefault(c, []).append(r[0])
    least = {c: min((i for i in m if i is not None), default=None) for c, m in ids.items()}
    docs = spark.createDataFrame([(*r, *"abcdefghi") for r in rows], COLUMNS).repartition(6)
    got = minhash.near_duplicates(docs, scheme)
    assert Counter(map(tuple, got.collect())) == Counter((r[0], len(s), least[c], r[0] == least[c]) for r, s, c in zip(rows, sets, roots, strict=True))


def test_one_of_each_keeps_one_of_a_star(spark):
    rows = tables()["stars"] + tables()["odd"]
    sets, roots = brute(rows, SCHEMES["stage"])
    roots = [c if s else -1 for c, s in zip(roots, sets, strict=True)]  # texts without words are one group here
    docs = spark.createDataFrame([(*r, *"abcdefghi") for r in rows], COLUMNS).repartition(6)
    kept = simhash.one_of_each(docs)
    ids = {}
    for r, c in zip(rows, roots, strict=True):
        ids.setdefault(c, []).append(r[0])
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(min((i for i in m if i is not None), default=None) for m in ids.values())
    assert {tuple(r[2:]) for r in kept.collect()} == {tuple("abcdefghi")}


def test_no_pair_within_the_limit_is_lost(spark):
    rng = np.random.default_rng(3)
    scheme = SCHEMES["op11"]
    base = rng.integers(-(1 << 15), 1 << 15, size=(40, 64), dtype=np.int16)
    near = base.copy()
    for i, row in enumerate(near):
        at = rng.permutation(64)[: scheme.limit - i % 3]
        row[at] += 1
    rows = [(f"{kind}{i}", x.tolist()) for kind, m in (("a", base), ("b", near)) for i, x in enumerate(m)]
    sets = spark.createDataFrame(rows, "node string, sig array<smallint>")
    met = minhash.lists(sets, scheme).groupBy("key").agg(F.sort_array(F.collect_set("node")).alias("nodes")).select("nodes").collect()
    assert {(f"a{i}", f"b{i}") for i in range(40)} <= {tuple(r["nodes"]) for r in met}


def test_limits_and_sets():
    for scheme, most in ((SCHEMES["op11"], 2e-5), (SCHEMES["stage"], 2e-5)):
        s = scheme.percent / 100
        assert sum(comb(64, d) * (1 - s) ** d * s ** (64 - d) for d in range(scheme.limit + 1, 65)) < most
    text = " ".join(f"w{i * i % 7919}" for i in range(9000))
    assert len(minhash.shingles(text, 5)) == len(word_sets(text, 5)) and (minhash.shingles("A  b", 3) == minhash.shingles("a B", 3)).all()
    assert len(minhash.shingles(None, 3)) == len(minhash.shingles(" \n", 3)) == 0


def test_empty_table(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert minhash.near_duplicates(none).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert minhash.near_duplicates(none).count() == 0 and simhash.one_of_each(none).count() == 0


def test_the_stage_verifies_what_simhash_proposes(spark, monkeypatch):
    rows = [r for r in tables()["copies"] if r[0] < 5000]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    pairs = lambda d: {frozenset((bytes(r["u"]), bytes(r["v"]))) for r in d.select("u", "v").collect()}
    made, compared, of, inner = [], [], simhash.proposed, minhash._compared

    def propose(marked):
        found = of(marked)
        made.append(pairs(found))
        return found

    def compare(asked, whole):
        compared.append(pairs(asked))
        return inner(asked, whole)

    monkeypatch.setattr(simhash, "proposed", propose)
    monkeypatch.setattr(minhash, "_compared", compare)
    _, roots = brute(rows, SCHEMES["stage"])
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == sorted({rows[c][0] for c in roots})
    assert made[0] and made[0] <= compared[0]


def test_a_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """Texts that resemble the head of their group, but not each other; where words are left out, own shingles do not tell them apart."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 500):
        words = list(base)
        for at in rng.sample(range(150), 1 + i % 6):
            words[at] = None if rng.random() < 0.05 else f"new{rng.randrange(10**9)}"
        rows.append((i, " ".join(w for w in words if w)))
    sets, roots = brute(rows, SCHEMES["op11"])
    assert len(set(roots)) > 5
    made, inner = [], minhash.settle

    def count(df, name="table"):
        out = inner(df, name)
        made.extend([out.count()] if name == "pairs" else [])
        return out

    monkeypatch.setattr(minhash, "settle", count)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert Counter(map(tuple, got.collect())) == Counter((r[0], len(s), rows[c][0], r[0] == rows[c][0]) for r, s, c in zip(rows, sets, roots, strict=True))
    assert sum(made) < len(rows)
