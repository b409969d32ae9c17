"""Vector codes and the Merkle manifest against brute force on small tables with odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillgrid.llm import merkle, veccodes
from rillgrid.llm.common import ascii_lower

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_codes(rows):
    """All distances in every round."""
    rows = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    x = np.array([[math.floor(1024 * y) for y in r[1]] for r in rows], dtype=np.int64).reshape(len(rows), 4, -1)
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, x[i].ravel().tolist()))[:256]
    books = x[first].swapaxes(0, 1).copy()
    for done in range(5):
        distance = np.stack([((x[:, p, None, :] - books[p][None]) ** 2).sum(axis=2) for p in range(4)], axis=1)
        code, error = distance.argmin(axis=2), distance.min(axis=2).sum(axis=1)
        if done < 4:
            for p in range(4):
                for e in set(code[:, p].tolist()):
                    own = x[code[:, p] == e, p]
                    books[p, e] = own.sum(axis=0) // len(own)
    by_label = Counter()
    for r, e in zip(rows, error.tolist(), strict=True):
        by_label[r[2]] += e
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return [(r[0], "".join("%02x" % y for y in c), e, by_label[r[2]], sha) for r, c, e in zip(rows, code.tolist(), error.tolist(), strict=True)]


def vector_tables():
    g = np.random.default_rng(1)
    centers = g.normal(size=(40, 16))
    clusters = [(i, (centers[i % 40] + g.normal(size=16) * 0.2).tolist(), [None, 1, 2][i % 3]) for i in range(1500)]
    clusters += [(5, clusters[5][1], 1), (5, clusters[6][1], 1), (None, clusters[7][1], None), (9000, None, 1), (9001, [math.nan] + [0.0] * 15, 1)]
    clusters += [(9002, [None] + [0.0] * 15, 1), (9003, [math.inf] + [0.0] * 15, 1), (9004, [], 1)]
    return {
        "one": [(1, [0.5] * 8, None)], "two": [(i, g.normal(size=8).tolist(), i) for i in range(2)], "clusters": clusters,
        "ties": [(i, [float(round(y)) for y in g.normal(size=16)], i % 5) for i in range(900)],
        "alike": [(i, [0.25] * 16, i % 2) for i in range(300)], "large": [(i, (g.normal(size=16) * 9000).tolist(), 0) for i in range(600)],
    }


VECTORS = "vec_id long, embedding array<double>, label int, id string, code string, vec string, part string"


@pytest.mark.parametrize("name", sorted(vector_tables()))
def test_codes_equal_brute_force(spark, name):
    rows = vector_tables()[name]
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], VECTORS).repartition(5)
    assert Counter(tuple(r) for r in veccodes.codes(df).collect()) == Counter(brute_codes(rows))


def test_codes_of_odd_tables(spark):
    none = veccodes.codes(spark.createDataFrame([], VECTORS))
    assert none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and none.count() == 0
    rows = [(1, [0.1, 0.2, 0.3, 0.4, 0.5], 1, *"abcd"), (2, [0.1] * 5, 1, *"abcd"), (3, [1.0] * 4, 1, *"abcd"), (4, [1e30] * 5, 1, *"abcd")]
    assert sorted(r["vec_id"] for r in veccodes.codes(spark.createDataFrame(rows, VECTORS)).collect()) == [1, 2]  # 5 filled up to 8; another length; too large


def test_bounded_search_equals_full_search():
    g = np.random.default_rng(4)
    points, centers = g.integers(-500, 500, size=(2000, 4)), g.integers(-500, 500, size=(64, 4))
    entry, best, near, low = veccodes.search_all(points, centers, 5)
    for b in (5, 3, 8, 8, 2):
        moved = centers + g.integers(-30, 30, size=centers.shape)
        moves = np.sqrt(((moved - centers) ** 2).sum(axis=1)) * (1 + veccodes.MARGIN)
        centers = moved
        entry, best, near, low, depth = veccodes.search_bounded(points, centers, entry, near, low, moves, b)
        want = veccodes.squared(points, centers)
        assert (entry == want.argmin(axis=1)).all() and (best == want.min(axis=1)).all() and near.shape[1] == b
        assert ((low[:, :b] <= np.sqrt(np.take_along_axis(want, near, axis=1))) | (low[:, :b] > veccodes.NOTHING)).all()
        others = want.astype(float)
        np.put_along_axis(others, np.concatenate((near, entry[:, None]), axis=1), np.inf, axis=1)
        assert (low[:, b] <= np.sqrt(others.min(axis=1))).all()


def joined_digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    """Per row (doc_id, source, lang, n_chars, text) what the manifest says, from whole lists."""

    def leaf(r, text):
        return joined_digest(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (*r[:4], text)])

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([joined_digest(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, i):
        out = []
        for nodes in levels[:-1]:
            out.append(("".join(nodes[i // 8 * 8 : i]), "".join(nodes[i + 1 : i // 8 * 8 + 8])))
            i //= 8
        return out

    groups, trees = {}, {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    for lang in order:
        groups[lang].sort(key=lambda r: (-(1 << 63) if r[0] is None else r[0], leaf(r, r[4])))
        trees[lang] = tree([leaf(r, r[4]) for r in groups[lang]])
    crown, out = tree([trees[lang][-1][0] for lang in order]), []
    for number, lang in enumerate(order):
        for i, r in enumerate(groups[lang]):
            way = path(trees[lang], i) + path(crown, number)
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            folded = leaf(r, r[4].translate(LOW) if hit else r[4])
            for before, after in way:
                folded = joined_digest(before, folded, after)
            out.append((r[0], trees[lang][0][i], trees[lang][-1][0], crown[-1][0], joined_digest(*[b + a for b, a in way]), folded, folded == crown[-1][0]))
    return out


DOCS = "doc_id long, source string, lang string, n_chars long, text string, g string, k string, pos string, leaf string, other string, n string"


def manifest_of(docs):
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    return merkle.manifest(docs, {"text": text}).drop("lang")


def document_tables():
    rng = random.Random(1)
    wide = [(rng.randint(-(1 << 63), (1 << 63) - 1) if i % 3 else i, rng.choice("ab"), rng.choice(["en", "fr", None, "", "é"]), i, rng.choice(["Abc", "x", ""]) + str(i) * (i % 2) if i % 7 else None) for i in range(1500)]
    one_id = [(i, "s", "en", 1, f"T{i}") for i in range(700)] + [(7, "s", "en", 1, "same")] * 600 + [(9, "s", "en", 1, f"D{i}") for i in range(600)]
    return {"one": [(1, "s", "en", 3, "ABC")], "wide": wide, "repeated": one_id + [(None, "s", "en", None, None)] * 20 + [(None, "s", None, None, "Z"), (3, None, "many " * 40, 1, "long " * 50_000)]}


@pytest.mark.parametrize("name", sorted(document_tables()))
def test_manifest_equals_brute_force(spark, name):
    rows = document_tables()[name]
    docs = spark.createDataFrame([(*r, *"abcdef") for r in rows], DOCS).repartition(5)
    assert Counter(tuple(r) for r in manifest_of(docs).collect()) == Counter(brute_manifest(rows))


def test_manifest_of_nothing_and_of_many_groups(spark):
    assert manifest_of(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(i, "s", f"l{i % 600}", i, f"Text {i}") for i in range(1300)]
    assert Counter(tuple(r) for r in manifest_of(spark.createDataFrame([(*r, *"abcdef") for r in rows], DOCS)).collect()) == Counter(brute_manifest(rows))


def test_offsets_of_sparse_keys(spark):
    rng = random.Random(2)
    keys = sorted({rng.randint(-(1 << 57), 1 << 57) for _ in range(500)} | set(range(9000)))
    counts = spark.createDataFrame([("a", k, 1 + k % 3) for k in keys], "g string, at long, n long")
    got = {r["at"]: r["base"] for r in merkle.offsets(counts, ["g"], keys[0], keys[-1]).collect()}
    total, want = 0, {}
    for k in keys:
        want[k], total = total, total + 1 + k % 3
    assert got == want
