"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html, jaccard, langid, media, merkle, mixing, ngram_lm, periodic, pii, toxicity, urls, warc
from ._common import crc_mod, read


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op3_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    fold = crc_mod(F.col("doc_id"), 7)
    scored = ngram_lm.score(docs, fold != 2)
    return scored.select("doc_id", (fold == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(_labelled(docs, read(spark, sf_dir, "labels")), same="_h")
    return toxicity.score(docs, model).withColumn("held_out", crc_mod(F.col("doc_id"), 5) == 0)


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows: documents with a label whose fold is not 0."""
    y = labels.select(F.col("doc_id").alias("_id"), "toxic").filter(F.col("toxic").isNotNull() & (crc_mod(F.col("_id"), 5) != 0)).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text", F.xxhash64("text").alias("_h")).join(y, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_h", "toxic")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read(spark, sf_dir, "documents"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"), n=4, percent=85)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(read(spark, sf_dir, "pages"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(crc_mod(F.col("doc_id"), 3) != 1))
    return langid.predict(docs, model).withColumn("held_out", crc_mod(F.col("doc_id"), 3) == 1)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: The fixed rules of the URL filter.
URL_RULES = "block net/, allow example.net/en/, block example.com/de/, allow org/fr/"


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from pages whose path names a document with a label: of low quality or toxic (block), or neither."""
    pages, labels = read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels")
    bad = labels.groupBy("doc_id").agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad"))
    named = F.regexp_extract(urls.path(F.col("url")), "/([0-9]+)", 1).try_cast("bigint")
    known = pages.select("url", named.alias("doc_id")).join(bad, "doc_id").select("url", F.when(F.col("bad"), urls.BLOCK).otherwise(urls.ALLOW).alias("label"))
    return urls.judge(pages, urls.parse(URL_RULES), urls.mine(known))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return merkle.manifest(docs, changed={"text": merkle.tampered(F.col("text"), F.col("doc_id"))})


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(read(spark, sf_dir, "documents"), plant=True)


# Columns of these operators that SQL can state by itself.


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_ngram_lm(spark, sf_dir).drop("score").withColumn("base_score", F.round("base_score", 4))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_pii(spark, sf_dir).select("doc_id", "n_base")


def media_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0]))) | {f.__name__: f for f in (mixing_targets, lm_base, pii_base, media_payload)}


#: What the archives must give back.
_WARC_SQL = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, url, octet_length(body) AS n, sha256(body) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
SELECT page_id, url, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d LEFT JOIN f USING (digest)"""

#: Every pair of sets that share a shingle, then the transitive closure of the links.
_JACCARD_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM w),
sets AS (SELECT DISTINCT ON (k) doc_id AS rep, k, s FROM (SELECT doc_id, s, md5(array_to_string(list_sort(s), '|')) AS k FROM g WHERE len(s) > 0) ORDER BY k, doc_id),
t AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM t a JOIN t b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.rep, b.rep),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (na + nb - shared)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT rep AS a, rep AS b FROM sets UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
named AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
SELECT g.doc_id, len(g.s) AS n_shingles, coalesce(named.component_id, g.doc_id) AS component_id
FROM g LEFT JOIN sets ON sets.k = md5(array_to_string(list_sort(g.s), '|')) AND len(g.s) > 0 LEFT JOIN named ON named.rep = sets.rep"""


#: Every shift at which eight tokens agree (or all of a short item), then every window.
_LEAKS_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-/:-@\[-`{-\x7f]+'), lambda x: x <> '') AS t FROM documents),
i AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-/:-@\[-`{-\x7f]+'), lambda x: x <> '') AS t FROM benchmark),
dt AS (SELECT doc_id, len(t) AS nd, unnest(t) AS w, unnest(range(len(t))) AS p FROM d),
it AS (SELECT item_id, len(t) AS ni, unnest(t) AS w, unnest(range(len(t))) AS q FROM i),
m AS (SELECT doc_id, item_id, nd, ni, p - q AS shift, list(q) AS same FROM dt JOIN it USING (w) GROUP BY ALL HAVING count(*) >= least(8, ni)),
o AS (SELECT *, greatest(0, -shift) AS a, least(ni, nd - shift) AS z FROM m),
s AS (SELECT *, least(13, ni, z - a) AS n FROM o WHERE z - a >= least(10, ni)),
w AS (SELECT doc_id, item_id, shift, n, ni, same, unnest(range(a, z - n + 1)) AS f FROM s),
k AS (SELECT doc_id, item_id, n, ni, f + shift AS doc_start, len(list_filter(same, lambda q: q >= f AND q < f + n)) AS agree FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY agree DESC, n DESC, doc_start) AS best FROM k WHERE agree >= CASE WHEN ni < 10 THEN n ELSE ceil(n * 0.8) END)
SELECT doc_id, item_id, agree, n AS window, doc_start FROM r WHERE best = 1"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: crc32 of a column ``id`` as text, by the table of its bytes.
_CRC_TABLE = "tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab)"
_CRC = "xor(list_reduce(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"

_LM_SQL = f"""WITH {_CRC_TABLE},
d AS (SELECT doc_id, row_number() OVER () AS rid, {_CRC} % 7 AS fold, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents, tab),
t AS (SELECT rid, fold, unnest(list_append(w, chr(10))) AS t FROM d),
c AS (SELECT t, count(*) AS c FROM t WHERE fold <> 2 GROUP BY t),
s AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c),
r AS (SELECT rid, count(*) AS n_tokens, count(c.c) AS n_known, sum(log10((coalesce(c.c, 0) + 1.0) / (n + v + 1))) AS base FROM t LEFT JOIN c USING (t), s GROUP BY rid)
SELECT doc_id, fold = 2 AS held_out, n_tokens, n_known, (SELECT n FROM s) AS train_tokens, round(base, 4) AS base_score FROM d JOIN r USING (rid)"""


def _targets_sql(rounds: int = 12) -> str:
    """Water-filling, a round at a time: open sources above twice their size are filled and closed."""
    out = """WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
g AS (SELECT source, sum(size) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
r0 AS (SELECT source, n, [5.0, 2.0, 1.0][i % 3 + 1] AS w, false AS shut FROM g)"""
    for k in range(rounds):
        out += f""",
a{k} AS (SELECT 1.5 * sum(n) - sum(CASE WHEN shut THEN 2 * n ELSE 0 END) AS have, sum(CASE WHEN shut THEN 0 ELSE w END) AS w FROM r{k}),
r{k + 1} AS (SELECT source, n, r.w, shut OR a.have * r.w / a.w > 2 * n AS shut FROM r{k} r, a{k} a)"""
    return out + f""",
z AS (SELECT source, n, CASE WHEN shut THEN 2.0 * n ELSE a.have * r.w / a.w END AS target FROM r{rounds} r, (SELECT 1.5 * sum(n) - sum(CASE WHEN shut THEN 2 * n ELSE 0 END) AS have, sum(CASE WHEN shut THEN 0 ELSE w END) AS w FROM r{rounds}) a)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, round(CAST(target AS DOUBLE), 4) AS target FROM d JOIN z ON d.source IS NOT DISTINCT FROM z.source"""


_PII_SQL = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS e, regexp_extract_all(t, '[0-9]+(?:\.[0-9]+){3}') AS i,
  list_transform(regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS c, list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS p FROM t)
SELECT doc_id, len(e) + len(list_filter(i, lambda x: list_bool_and(list_transform(string_split(x, '.'), lambda k: coalesce(TRY_CAST(k AS BIGINT) <= 255, false)))))
  + len(list_filter(c, lambda x: len(x) BETWEEN 13 AND 19 AND list_sum(list_transform(range(len(x)), lambda k: CASE WHEN k % 2 = 0 THEN CAST(x[len(x) - k] AS INT) ELSE CAST(x[len(x) - k] AS INT) * 2 - 9 * CAST(CAST(x[len(x) - k] AS INT) > 4 AS INT) END)) % 10 = 0))
  + len(list_filter(p, lambda x: len(x) BETWEEN 9 AND 15)) AS n_base FROM m"""

_MEDIA_SQL = """WITH t AS (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents), p AS (SELECT *, CAST(greatest(1, ceil(n / 192.0)) * 192 AS BIGINT) AS m FROM t)
SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(t || repeat(' ', m - n)) AS payload_sha256 FROM p"""


#: Every token combination of every labelled URL, then the surest that fits.
_URLS_SQL = r"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, P, 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, P, 2), '') AS path, coalesce(regexp_extract(url, P, 3), '') AS rest
  FROM (SELECT *, row_number() OVER () AS rid FROM pages)),
f AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/' WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
  WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/' WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule, row_number() OVER () AS rid,
  string_split(regexp_replace(host, '[0-9]+', '#', 'g'), '.') AS h, string_split(PLAIN(path), '/') AS p, string_split(PLAIN(rest), '&') AS q FROM u),
k AS (SELECT *, list_distinct(list_concat(list_transform(list_filter(h[-1:], lambda x: x <> ''), lambda x: 't:' || x), list_transform(list_filter(flatten(list_transform(h, lambda x: string_split(x, '-'))), lambda x: x <> ''), lambda x: 'h:' || x),
  list_transform(list_filter(p, lambda x: x <> ''), lambda x: 'p:' || x), list_transform(list_filter(list_transform(q, lambda x: string_split(x, '=')[1]), lambda x: x <> ''), lambda x: 'q:' || x))) AS t FROM f),
lab AS (SELECT doc_id, bool_or(coalesce(quality = 0 OR toxic = 1, false)) AS bad FROM labels GROUP BY doc_id),
tr AS (SELECT list_sort(t) AS t, CASE WHEN bad THEN 'block' ELSE 'allow' END AS label FROM k JOIN lab ON doc_id = TRY_CAST(regexp_extract(path, '/([0-9]+)', 1) AS BIGINT)),
pick AS (SELECT label, t, unnest(range(1, CAST(pow(2, len(t)) AS BIGINT))) AS m FROM tr),
sub AS (SELECT label, list_filter(t, lambda x, i: (m >> (i - 1)) & 1 = 1) AS s FROM pick),
sets AS (SELECT s, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY s) AS among FROM sub GROUP BY s, label),
rules AS (SELECT row_number() OVER (ORDER BY n / among DESC, n DESC, len(s), s, label = 'allow') AS rank, s, label, n / among AS confidence FROM sets WHERE n >= (SELECT greatest(5, ceil(0.005 * count(*))) FROM tr) AND n / among >= 0.5),
hit AS (SELECT rid, min(rank) AS rank FROM k JOIN rules ON list_has_all(t, s) WHERE rule IS NULL GROUP BY rid)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END ELSE coalesce(label, 'allow') END AS verdict, array_to_string(s, ' ') AS mined, CAST(confidence AS DOUBLE) AS confidence
FROM k LEFT JOIN hit USING (rid) LEFT JOIN rules USING (rank)"""
_URLS_SQL = re.sub(r"PLAIN\((\w+)\)", r"regexp_replace(translate(\1, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '#', 'g')", _URLS_SQL).replace("url, P,", r"url, '(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?',")


def _merkle_sql(depth: int = 5) -> str:
    """Trees as lists of lists, level by level; ``depth`` levels reach 16^5 rows a source."""

    def tree(name: str, k: int) -> str:  # the next level, unless there is one node
        return f"CASE WHEN len({name}{k}) <= 1 THEN {name}{k} ELSE list_transform(range(0, len({name}{k}), 16), lambda i: sha256(array_to_string({name}{k}[i + 1 : i + 16], ''))) END AS {name}{k + 1}"

    def path(name: str, at: str, k: int, side: str) -> str:  # siblings of place ``at`` at level k
        a = f"({at} >> {4 * k})"
        cut = f"{name}{k}[({a} // 16) * 16 + 1 : {a}]" if side == "l" else f"{name}{k}[{a} + 2 : ({a} // 16) * 16 + 16]"
        return f"CASE WHEN len({name}{k}) <= 1 THEN '' ELSE array_to_string({cut}, '') END"

    fields = lambda t: "sha256(concat(" + ", ".join(f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", t)) + "))"
    out = f"""WITH {_CRC_TABLE},
d AS (SELECT *, CASE WHEN {_CRC} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM documents, tab),
l AS (SELECT doc_id, source, {fields("text")} AS leaf, {fields("other")} AS now FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM l),
s0 AS (SELECT source, list(leaf ORDER BY place) AS a0 FROM p GROUP BY source)"""
    for k in range(depth):
        out += f",\ns{k + 1} AS (SELECT *, {tree('a', k)} FROM s{k})"
    out += f",\nr AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS no FROM s{depth}),\nt0 AS (SELECT list(a{depth}[1] ORDER BY no) AS b0 FROM r)"
    for k in range(depth):
        out += f",\nt{k + 1} AS (SELECT *, {tree('b', k)} FROM t{k})"
    steps = [("a", "place", k) for k in range(depth)] + [("b", "no", k) for k in range(depth)]
    out += f",\nz0 AS (SELECT p.*, r.* EXCLUDE (source), t{depth}.* FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source, t{depth})"
    for i, (name, at, k) in enumerate(steps):
        out += f",\nz{i + 1} AS (SELECT * EXCLUDE (now{', proof' if i else ''}), {'proof ||' if i else ''} {path(name, at, k, 'l')} || {path(name, at, k, 'r')} AS proof, CASE WHEN len({name}{k}) <= 1 THEN now ELSE sha256({path(name, at, k, 'l')} || now || {path(name, at, k, 'r')}) END AS now FROM z{i})"
    return out + f"\nSELECT doc_id, leaf, a{depth}[1] AS subroot, b{depth}[1] AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = b{depth}[1] AS verified FROM z{len(steps)}"


#: Lags with probes that match in a row at every third place or more, then islands of matches at those lags.
_PERIODIC_SQL = f"""WITH {_CRC_TABLE},
d0 AS (SELECT doc_id, row_number() OVER () AS rid, {_CRC} AS h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS o FROM documents, tab),
d1 AS (SELECT *, len(o) AS n, CASE WHEN h % 10 = 0 AND len(o) > 0 THEN (h // 10) % len(o) END AS a, 3 + (h // 10) % 8 AS m FROM d0),
d AS MATERIALIZED (SELECT doc_id, rid, n, CASE WHEN a IS NULL THEN o ELSE list_transform(range(n), lambda i: o[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // m) END + 1]) END AS w FROM d1),
lag AS (SELECT rid, n, w, unnest(range(1, n // 4 + 1)) AS q FROM d WHERE n >= 6),
probe AS (SELECT rid, q, len(list_filter(range(0, n - 3 * q, q), lambda i: w[i + 1] = w[i + q + 1] AND w[i + q + 1] = w[i + 2 * q + 1] AND w[i + 2 * q + 1] = w[i + 3 * q + 1])) AS hits FROM lag),
same AS (SELECT d.rid, q, unnest(list_filter(range(n - q), lambda i: w[i + 1] = w[i + q + 1])) AS i FROM probe JOIN d USING (rid) WHERE hits > 0),
island AS (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS g FROM same) GROUP BY rid, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT rid, start, length, min(q) AS period FROM island GROUP BY rid, start, length),
best AS (SELECT rid, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS said FROM run GROUP BY rid),
top AS (SELECT rid, start, length, period FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS k FROM run) WHERE k = 1),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM run),
cut AS (SELECT rid, list(i) AS gone FROM gone GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, CAST(1000 * length // period AS BIGINT) AS exponent_milli, coalesce(said, sha256('')) AS runs_sha256,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i - 1)), ' ') END) AS collapsed_sha256
FROM d LEFT JOIN best USING (rid) LEFT JOIN top USING (rid) LEFT JOIN cut USING (rid)"""


def oracle_sql() -> dict[str, str]:
    return {"op11_urls": _URLS_SQL, "op12_merkle": _merkle_sql(), "op13_periodic": _PERIODIC_SQL, "mixing_targets": _targets_sql(), "lm_base": _LM_SQL, "pii_base": _PII_SQL, "media_payload": _MEDIA_SQL, "op10_decontaminate": _LEAKS_SQL, "op2_warc": _WARC_SQL, "op7_jaccard": _JACCARD_SQL}
