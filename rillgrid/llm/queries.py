"""One query per operator over whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgrid.llm import ann, langid, merkle, minhash, mixing, packing, quality, secret_scan, simhash, tokenfile, tokens, urlfilter, veccodes, warc
from rillgrid.llm.common import SPACE, ascii_lower
from rillgrid.staging import fresh_path

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))  # a row without an id is learned from
    model = langid.fit(docs.where(~held_out))
    return langid.identify(docs.withColumn("held_out", held_out), model).select("doc_id", "held_out", "lang_pred", "score")


def warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write(_table(spark, folder, "pages"), path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return warc.read(spark, path).select(
        number("name").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("refers").alias("refers_to")
    )


def url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.apply_rules(_table(spark, folder, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    spec = tokens.read_spec(public_tokenizers.path("byte_bpe_50k.json"))
    packed = packing.pack(_table(spark, folder, "documents"), spec)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, folder, "documents").select("doc_id", "text"))
    base = [r.kind for r in secret_scan.BASE]
    own = F.filter("spans", lambda s: s["kind"].isin(*base))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [number(k).alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(secret_scan.joined(own), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


def nearest(spark: SparkSession, folder: str) -> DataFrame:
    rows = ann.usable(_table(spark, folder, "embeddings"))
    router = ann.fit(rows)
    if router is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return ann.search(rows, router, rows.where("id % 100 = 0"))


def mix(spark: SparkSession, folder: str) -> DataFrame:
    taken = mixing.copies(_table(spark, folder, "documents"))
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = quality.judged(_table(spark, folder, "documents").select("doc_id", "text"))
    counts = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return docs.select("doc_id", *counts, base.alias("base_failed"), (~base & (F.size("failed") == 0)).alias("kept"))


def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents").select("doc_id", "text"))


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    spec, path = tokens.read_spec(public_tokenizers.path("word_bpe_49k.json")), fresh_path(spark, "shards")
    tokenfile.write(_table(spark, folder, "documents"), spec, path)
    return tokenfile.read(spark, path).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, folder, "documents").select("doc_id", "text"))


def vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return veccodes.codes(_table(spark, folder, "embeddings"))


def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    docs = _table(spark, folder, "documents")
    return merkle.manifest(docs, {"text": F.when(tampered, ascii_lower(F.col("text"))).otherwise(F.col("text"))}).drop("lang")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id,
    "op2_warc": warc_round_trip,
    "op3_url_rules": url_rules,
    "op4_best_fit_packing": best_fit_packing,
    "op5_secret_scan": secrets,
    "op6_nearest_neighbours": nearest,
    "op7_source_mix": mix,
    "op8_quality_rules": quality_rules,
    "op9_simhash": near_duplicates,
    "op10_token_files": token_files,
    "op11_minhash": near_copies,
    "op12_vector_codes": vector_codes,
    "op13_merkle_manifest": merkle_manifest,
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _warc_sql() -> str:
    return """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x FROM p),
    d AS (SELECT page_id, n, array_to_string([
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || x[1 + 5 * (i // 4) : 5 + 5 * (i // 4)])::BIGINT >> (15 - 5 * (i % 4))) & 31)] FOR i IN range(32)], '') AS digest FROM h),
    f AS (SELECT digest, min(page_id) AS first FROM d GROUP BY 1)
    SELECT page_id, n::BIGINT AS payload_bytes, d.digest AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id > first THEN first END AS refers_to
    FROM d JOIN f ON d.digest = f.digest"""


def _url_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH rules(h, p, v) AS (VALUES {rules}),
    rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{upper}', '{lower}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    hits AS (SELECT page_id, arg_max(struct_pack(r := h || p, v := v), length(h || p) * 1000 + length(h)) AS best
             FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1)
    SELECT page_id, host, path, best.r AS rule, coalesce(best.v, 'allow') AS verdict FROM parts LEFT JOIN hits USING (page_id)"""


def _secret_sql() -> str:
    kinds = []
    for place, rule in enumerate(secret_scan.RULES):
        pattern = _quoted(rule.pattern)
        enough = f"length(regexp_extract(m[i], {pattern}, {rule.group})) >= {rule.least}" if rule.least else "true"
        kinds.append(f"""
        SELECT doc_id, '{rule.kind}' AS kind, {place} AS place, pos, pos + length(m[i]) AS until FROM (
          SELECT doc_id, m, i, coalesce(list_sum([length(x) FOR x IN g[1:i]]), 0) + coalesce(list_sum([length(x) FOR x IN m[1:i-1]]), 0) AS pos
          FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i
                FROM (SELECT doc_id, regexp_extract_all(t, {pattern}) AS m, string_split_regex(t, {pattern}) AS g FROM d))) WHERE {enough}""")
    base = ", ".join(f"'{r.kind}'" for r in secret_scan.BASE)
    text = lambda where: f"coalesce(string_agg(kind || ':' || pos::BIGINT || ':' || until::BIGINT, ',' ORDER BY pos, place){where}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.BASE)
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(kinds)})
    SELECT doc_id, {counts}, sha256({text(f" FILTER (kind IN ({base}))")}) AS base_sha256, {text("")} AS spans
    FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id"""


def _quality_sql() -> str:
    stops = ", ".join(_quoted(w) for w in quality.STOP_WORDS)
    tests = []
    for name, least, greatest in quality.RULES:
        tests += [f"{name} >= {least}"] if least is not None else []
        tests += [f"{name} <= {greatest}"] if greatest is not None else []
    part = lambda a, b: f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / {b} ELSE 0 END"
    lines, words = "len(l)", "len(w)"
    some = lambda values, test: f"len([x FOR x IN {values} IF {test}])"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    s AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[{SPACE}]+'), lambda x: x <> '') AS w,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS l FROM d),
    g AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM s)),
    twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
    r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY 1),
    m AS (SELECT s.doc_id, len(w) AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars,
            length(t) - length(translate(t, '{quality.SYMBOLS}', '')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, w, l
          FROM s LEFT JOIN r ON s.doc_id = r.doc_id),
    x AS (SELECT *, {part("n_repeat_words", words)} AS repeat_word_ratio, {part("word_chars", words)} AS mean_word_length, {part("n_symbols", words)} AS symbol_word_ratio,
            {part("n_dup_lines", lines)} AS dup_line_ratio, {part(some("l", f"regexp_matches(x, {_quoted(quality.BULLET)})"), lines)} AS bullet_line_ratio,
            {part(some("l", f"regexp_matches(x, {_quoted(quality.ELLIPSIS)})"), lines)} AS ellipsis_line_ratio,
            {part(some("w", f"regexp_matches(x, {_quoted(quality.LETTER)})"), words)} AS alpha_word_ratio,
            {part(some("w", f"lower(translate(x, ',.;:!?', '')) IN ({stops})"), words)} AS stop_word_ratio FROM m),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM x)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
           NOT base_failed AND {" AND ".join(tests)} AS kept FROM b"""


def _copies_sql() -> str:
    """All pairs with a common shingle, and the closure of their links."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[{SPACE}]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS x FROM w),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
    e AS MATERIALIZED (SELECT a, b FROM p JOIN n m ON m.doc_id = a JOIN n k ON k.doc_id = b WHERE 100 * both >= 85 * (m.n + k.n - both)),
    l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN c ON a = doc_id LEFT JOIN n USING (doc_id)"""


def _codes_sql() -> str:
    """Each round by all distances."""
    parts = []
    for r in range(veccodes.ROUNDS + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, label, p, v, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
            SELECT vec_id, label, x.p, x.v, b.e, list_sum([(x.v[i] - b.c[i]) * (x.v[i] - b.c[i]) FOR i IN range(1, len(x.v) + 1)])::BIGINT AS d FROM x JOIN b{r} b ON x.p = b.p) GROUP BY 1, 2, 3, 4)""")
        if r < veccodes.ROUNDS:
            parts.append(f"""m{r} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (
                SELECT p, e, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS m FROM (SELECT p, e, v, unnest(range(1, len(v) + 1)) AS i FROM a{r}) GROUP BY 1, 2, 3) GROUP BY 1, 2)""")
            parts.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m ON b.p = m.p AND b.e = m.e)")
    last, n = veccodes.ROUNDS, veccodes.PARTS
    return f"""
    WITH k AS (SELECT vec_id, label, [floor(1024 * y::DOUBLE)::BIGINT FOR y IN embedding] AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len([1 FOR y IN embedding IF y IS NULL OR NOT isfinite(y)]) = 0),
    x AS (SELECT vec_id, label, p, v[p * len(v) // {n} + 1 : (p + 1) * len(v) // {n}] AS v FROM k, range({n}) AS r(p)),
    b0 AS (SELECT p, (row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1)::INT AS e, v AS c FROM x QUALIFY e < {veccodes.ENTRIES}),
    {", ".join(parts)},
    s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM b{last}),
    o AS (SELECT vec_id, label, string_agg(printf('%02x', e::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY 1, 2)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM o, s"""


def _merkle_sql(levels: int = 6) -> str:
    """Trees of up to 8 ** ``levels`` leaves, level by level."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    steps = "flatten([[ord(c), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(doc_id::VARCHAR, '')])"
    crc = f"xor(list_reduce(list_prepend(4294967295, {steps})::BIGINT[], lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END), 4294967295)"

    def tree(name: str, nodes: str) -> list[str]:
        """Tables name0, name1, ... (g, i, h, m): the nodes of each level and their number."""
        out = [f"{name}0 AS MATERIALIZED (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS m FROM {nodes})"]
        for k in range(levels):
            out.append(f"""{name}{k + 1} AS MATERIALIZED (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS m FROM (
                SELECT g, i // CASE WHEN m > 1 THEN 8 ELSE 1 END AS i, CASE WHEN any_value(m) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {name}{k} GROUP BY g, 2))""")
        return out

    def climb(name: str, start: str) -> list[str]:
        """Tables name_0, name_1, ...: start (id, g, i, x, s) led up level by level, with siblings gathered in s and tampered hashes in x."""
        out = [f"{name}_0 AS (SELECT * FROM {start})"]
        for k in range(levels):
            out.append(f"""{name}_{k + 1} AS MATERIALIZED (SELECT c.id, c.g, c.i // CASE WHEN any_value(n.m) > 1 THEN 8 ELSE 1 END AS i,
                CASE WHEN any_value(n.m) > 1 THEN sha256(string_agg(CASE WHEN n.i = c.i THEN c.x ELSE n.h END, '' ORDER BY n.i)) ELSE c.x END AS x,
                c.s || coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i <> c.i), '') AS s
                FROM {name}_{k} c JOIN {name}{k} n ON n.g IS NOT DISTINCT FROM c.g AND n.i // 8 = c.i // 8 GROUP BY c.id, c.g, c.i, c.x, c.s)""")
        return out

    return f"""
    WITH d AS (SELECT doc_id, lang, {leaf("text")} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(f"translate(text, '{upper}', '{lower}')")} ELSE {leaf("text")} END AS x FROM documents),
    l AS (SELECT lang AS g, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, leaf AS h, x FROM d),
    {", ".join(tree("t", "l"))},
    o AS (SELECT NULL::INT AS g, t.g AS lang, row_number() OVER (ORDER BY t.g NULLS FIRST) - 1 AS i, t.h FROM t{levels} t),
    {", ".join(tree("r", "o"))},
    dd AS (SELECT doc_id AS id, g, i, x, '' AS s FROM l),
    {", ".join(climb("t", "dd"))},
    up AS (SELECT c.id, NULL::INT AS g, o.i, c.x, c.s FROM t_{levels} c JOIN o ON o.lang IS NOT DISTINCT FROM c.g),
    {", ".join(climb("r", "up"))}
    SELECT l.doc_id, l.h AS leaf, o.h AS subroot, r.h AS root, sha256(c.s) AS proof_sha256, c.x AS folded_root, c.x = r.h AS verified
    FROM l JOIN r_{levels} c ON c.id = l.doc_id JOIN o ON o.lang IS NOT DISTINCT FROM l.g, r{levels} r"""


SQL: dict[str, str] = {
    "op2_warc": _warc_sql(), "op3_url_rules": _url_sql(), "op5_secret_scan": _secret_sql(), "op8_quality_rules": _quality_sql(),
    "op11_minhash": _copies_sql(), "op12_vector_codes": _codes_sql(), "op13_merkle_manifest": _merkle_sql(),
}
