"""WARC, URL rules, SimHash, token files and nearest neighbours on small tables with odd rows."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rillgrid.llm import ann, simhash, tokenfile, tokens, urlfilter, warc


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


FAKE = warc.MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def page_rows():
    rng = random.Random(3)
    rows = [(i, f"http://h{i}.example.org/é x\n{i}", "é" * rng.randint(0, 400) + str(i)) for i in range(60)]
    rows += [(100, None, None), (101, "u", ""), (102, "u", "same"), (103, "u", "same"), (103, "u", "same"), (None, "u", "same"), (104, "u", FAKE), (105, "u", "x" + FAKE * 3 + "tail"), (106, "u", warc.MAGIC), (107, "u", "\r\n\r\n" + warc.MAGIC + "\r\n\r\n"), (108, "u", "long " * 60_000)]
    return rows


@pytest.mark.parametrize("split", ["64m", "3000"])
def test_warc_round_trip(spark, tmp_path, split):
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"file": F.lit("x"), "at": F.lit(1), "id": F.lit("c"), "sha": F.lit("s")})
    path = str(tmp_path / "a")
    warc.write(pages.repartition(3), path, per_file=20)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        out = warc.read(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    first: dict = {}
    for i, _, html in rows:
        if i is not None:
            first[digest(html)] = min(first.get(digest(html), i), i)
    want = Counter()
    for i, _, html in rows:
        again = i is not None and first[digest(html)] < i
        want[(i, len((html or "").encode()), digest(html), "revisit" if again else "response", first[digest(html)] if again else None)] += 1
    number = lambda s: int(s[len("<urn:page:") : -1]) if s else None
    assert Counter((number(r["name"]), r["payload_bytes"], r["payload_digest"], r["type"], number(r["refers"])) for r in out) == want
    assert all(r["intact"] for r in out if r["type"] == "response")


def test_warc_least_size_and_empty(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "b"), least=5)
    assert {r["name"]: r["type"] for r in warc.read(spark, str(tmp_path / "b")).collect()} == {"<urn:page:1>": "response", "<urn:page:2>": "response", "<urn:page:3>": "response", "<urn:page:4>": "revisit"}
    warc.write(pages.limit(0), str(tmp_path / "c"))
    assert warc.read(spark, str(tmp_path / "c")).count() == 0


def test_reachable_by_jumps(spark):
    chain = [("f", i, i + 10) for i in range(0, 1000, 10)] + [("f", 15, 25), ("f", 25, 30), ("g", 5, 9), ("h", 0, 7), ("h", 7, 7000)]
    got = {tuple(r) for r in warc.reachable(spark.createDataFrame(chain, "file string, at long, next long")).collect()}
    assert {x for x in got if x[0] == "f" and x[1] < 1000} == {("f", i) for i in range(0, 1000, 10)}
    assert {x for x in got if x[0] == "h" and x[1] < 7000} == {("h", 0), ("h", 7)} and not [x for x in got if x[0] == "g"]


def test_url_rules_equal_brute_force(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("a.com", "/fr", "block"), ("com", "/fr/", "block"), ("x", "", "block")]
    urls = [None, "", "no scheme/", "http://EXAMPLE.org/es/a?q#f", "http://m.example.org/en/12", "http://example.org", "http://notexample.org/es/", "http://com/fr/", "http://a.com/fr/", "http://é.x", "http://..x/?", "http://a\n.org/\n?b", "x://y://z.com/fr/", "http://b.a.com/fr"] + ["http://hot.org/"] * 50
    frame = spark.createDataFrame([(i, u, "own", "own") for i, u in enumerate(urls)] + [(3, urls[3], "own", "own")], "page_id long, url string, short string, r_host string")
    out = urlfilter.apply_rules(frame, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(out) == len(urls) + 1
    for r in out:
        host = path = ""
        if r["url"] and "://" in r["url"]:
            rest = r["url"].split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, path = rest[:cut], rest[cut:]
            path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [x for x in rules if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fits, key=lambda x: (len(x[0] + x[1]), len(x[0]), x[2] == "block"), default=None)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best and best[0] + best[1], best[2] if best else "allow")
        assert r["short"] == "own"
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in urlfilter.apply_rules(frame, none, default="block").collect()} == {"block"}
    assert urlfilter.apply_rules(frame.limit(0), none).count() == 0


def brute_components(prints: list[int]) -> list[int]:
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_links_connect_what_brute_force_connects(spark):
    """Chains, a dense ball whose variants are crowded, pairs at each distance, the sign bit."""
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for centre in [rng.getrandbits(64) for _ in range(6)] + [0]:
        prints |= {centre, centre ^ (1 << 63), centre ^ (1 << 63) ^ 1, centre ^ 0b111, centre ^ (0b111 << 30)}
    centre = rng.getrandbits(64)
    prints |= {centre ^ rng.getrandbits(9) for _ in range(200)} | {centre ^ (rng.getrandbits(5) << 40) ^ rng.getrandbits(5) for _ in range(200)}
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    for u, v in edges.collect():
        assert u < v and bin((u ^ v) & (2**64 - 1)).count("1") <= 2
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    want = brute_components(prints)
    groups: dict = {}
    for x, c in zip(signed, want, strict=True):
        groups.setdefault(c, set()).add(x)
    got: dict = {}
    for x in signed:
        got.setdefault(found.get(x, x), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))
    assert all(root == min(members) for root, members in got.items())


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "u long, v long")
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert found == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}
    assert simhash.components(edges.limit(0)).count() == 0


def test_near_duplicates_and_one_of_each(docs, rows, no_docs):
    prints = [simhash.fingerprint(r[1]) for r in rows]
    want = brute_components(prints)
    ids: dict = {}
    for r, c in zip(rows, want, strict=True):
        ids.setdefault(c, []).append(r[0])
    least = {c: min((i for i in m if i is not None), default=None) for c, m in ids.items()}
    out = simhash.near_duplicates(docs)
    assert Counter(map(tuple, out.collect())) == Counter((r[0], f"{p:016x}", least[c]) for r, p, c in zip(rows, prints, want, strict=True))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(least.values())
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.one_of_each(no_docs).count() == 0


def edited(text: str, words: int, seed: int) -> str:
    rng, out = random.Random(seed), text.split(" ")
    for i in rng.sample(range(len(out)), words):
        out[i] = f"changed{rng.randrange(10**6)}"
    return " ".join(out)


def word_sets(text: str) -> set:
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def test_one_of_each_finds_edited_copies(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    bases = [text(387) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(bases)]
    rows += [(1000 + 10 * i + k, edited(t, changed, 10 * i + k)) for i, t in enumerate(bases) for k, changed in enumerate((1, 2, 4, 6, 40))]
    group = text(300)
    rows += [(5000 + i, edited(group, 3, i)) for i in range(120)]  # a crowded band
    notice = text(150)
    rows += [(6000 + i, notice + " " + text(80)) for i in range(60)]  # much in common, but no copies
    sets = [word_sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    want = sorted({rows[root(i)][0] for i in range(len(rows))})
    got = sorted(r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).select("doc_id").collect())
    assert got == want and len(want) < len(rows) - 40 * 3


def test_fingerprint_of_few_words():
    import xxhash

    assert simhash.fingerprint(None) == simhash.fingerprint(" \t\n") == 0
    assert simhash.fingerprint("A É") == xxhash.xxh64_intdigest("a É", 42)


def test_perfect_hash_is_minimal_and_found():
    for n in (0, 1, 2, 10, 5000):
        keys = [str(i).encode() for i in range(n)]
        d = tokenfile.perfect_hash(keys)
        assert sorted(tokenfile.slot_of(k, d, n) for k in keys) == list(range(n))


def test_token_files_round_trip(spark, docs, rows, no_docs, tmp_path):
    spec = tokens.read_spec(public_tokenizers.path("word_bpe_49k.json"))
    path = str(tmp_path / "shards")
    tokenfile.write(docs, spec, path, shard_ids=700)
    out = tokenfile.read(spark, path).collect()
    ids = dict(zip(map(id, rows), tokens.Encoder(spec, 2).encode([r[1] for r in rows]), strict=True))
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in out) == Counter((r[0], ids[id(r)]) for r in rows)
    at = 0
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == at
        at += len(r["ids"]) // 4
    order = [r["doc_id"] for r in sorted(out, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    found = tokenfile.lookup(spark, path, [5, 104, None, 9999]).collect()
    assert Counter(r["doc_id"] for r in found) == Counter([5, 104, 104, None])
    assert tokenfile.directory(spark, path).agg(F.sum("n_ids")).first()[0] == at
    tokenfile.write(no_docs, spec, str(tmp_path / "none"))
    assert tokenfile.read(spark, str(tmp_path / "none")).count() == 0


def test_shard_takes_wide_ids():
    ids = [np.array([1, 70_000], dtype="<u4").tobytes(), b""]
    shard = tokenfile.Shard.of(tokenfile.build(0, 0, 0, [None, -5], ids) + b"\n")
    assert [shard.ids(i) for k in (None, -5) for i in shard.find(k)] == ids and not shard.find(3)


def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(10, 16))[rng.integers(0, 10, n)] + 0.4 * rng.normal(size=(n, 16))).astype(np.float32)


def test_nearest_recall_and_odd_vectors(spark):
    x = vectors(3000)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(5000 + i, x[7].tolist(), 0) for i in range(300)]  # one vector in many rows
    rows += [(9000, None, 0), (9100, [0.0] * 16, 0), (9200, [float("nan")] + [1.0] * 15, 0), (9300, [None] + [1.0] * 15, 0), (9400, [1.0] * 5, 0), (9500, [], 0), (9600, [float("inf")] * 16, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, part int")
    usable = ann.usable(table)
    assert usable.count() == 3300
    router = ann.fit(usable, fit_rows=2000, parts=16)
    out = ann.search(usable, router, usable.where("id % 100 = 0"), block=500).toPandas()
    all_x = np.concatenate((x, np.repeat(x[7:8], 300, axis=0))).astype(float)
    ids = np.concatenate((np.arange(3000), np.arange(5000, 5300)))
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((all_x - all_x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        got = out[out.query_id == ids[q]].sort_values("rank")
        assert got["rank"].tolist() == list(range(1, 11))
        where = {int(i): j for j, i in enumerate(ids)}
        assert np.allclose(got.score, [d[where[i]] for i in got.vec_id], rtol=1e-12)
        hits += len(set(best) & set(got.vec_id))
        total += 10
        if ids[q] >= 5000:
            assert got.vec_id.tolist() == best.tolist()  # ties go to the smaller ids
    assert hits / total >= 0.9


def test_null_and_large_ids_are_no_neighbours(spark):
    rng = np.random.default_rng(5)
    for base in (0, 10**18, 2**60):
        table = [(base + i, rng.normal(size=8).tolist()) for i in range(60)]
        df = spark.createDataFrame([*table, (None, [1.0] * 8)], "vec_id long, embedding array<double>")
        rows = ann.usable(df)
        out = ann.search(rows, ann.fit(rows), rows.where(F.col("id") < base + 3)).collect()
        assert len(out) == 30
        for q in range(3):
            want = sorted((float(np.sqrt(((np.array(v) - np.array(table[q][1])) ** 2).sum())), i) for i, v in table if i != base + q)[:10]
            assert [(r["vec_id"], r["rank"]) for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == base + q] == [(i, n + 1) for n, (_, i) in enumerate(want)]


def test_thin_parts_are_left_for_others(spark):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(40, 8)) * 20
    table = [(i, (centers[i % 40] + rng.normal(size=8) * 0.01).tolist()) for i in range(2000)]
    rows = ann.usable(spark.createDataFrame(table, "vec_id long, embedding array<double>"))
    router = ann.fit(rows)
    router.probes = 1
    few = rows.where("id < 160")  # parts with less than ten rows
    out = ann.search(few, router, few.where("id % 16 = 0")).groupBy("query_id").count().collect()
    assert {r["count"] for r in out} == {10} and len(out) == 10


def test_nearest_of_few(spark):
    few = ann.usable(spark.createDataFrame([(0, [1.0, 0.0]), (100, [1.0, 0.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>"))
    out = ann.search(few, ann.fit(few), few.where("id % 100 = 0")).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in out} == {(0, 1, 100), (0, 2, 3), (100, 1, 0), (100, 2, 3)}
    none = ann.usable(spark.createDataFrame([], "vec_id long, embedding array<double>"))
    assert ann.fit(none) is None


def test_parts_are_balanced_and_cut_few_edges():
    x = vectors(1600, 4).astype(float)
    graph = ann.neighbour_graph(x, 8)
    label = ann.balanced_parts(graph, 8)
    sizes = np.bincount(label, minlength=8)
    assert sizes.max() - sizes.min() <= 8
    assert (label[graph] == label[:, None]).mean() > 0.5  # 1/8 if parts were drawn at random
