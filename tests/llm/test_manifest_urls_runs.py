"""URL filters, Merkle manifests and periodic runs against brute force, edge cases and planted ones."""

import hashlib
import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.llm import merkle, periodic, urls

# ------------------------------------------------------------------ 11 URL filters

SITES = [
    ("http://www.spam-farm.example.org/en/12?page=2&ref=x", "block"),
    ("http://spam-farm.example.com/en/13", "block"),
    ("https://m.spam-farm.example.com/fr/14.html", "block"),
    ("https://blog.good.example.com/en/15?page=3", "allow"),
    ("https://good.example.org/en/16#top", "allow"),
    ("https://good.example.com/es/17/", "allow"),
]


def py_tokens(url):
    import re

    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?", url or "")
    if not m:
        return []
    low = lambda x: re.sub("[0-9]+", "#", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or ""))
    h = low(m[1]).split(".")
    out = ["t:" + h[-1]] * bool(h[-1]) + ["h:" + w for x in reversed(h) for w in x.split("-") if w]
    out += ["p:" + x for x in low(m[2]).split("/") if x] + ["q:" + x.split("=")[0] for x in low(m[3]).split("&") if x.split("=")[0]]
    return list(dict.fromkeys(out))


def brute_rules(rows, least, confidence):
    """Every combination of every URL's tokens, counted."""
    count, both = {}, {}
    for url, label in rows:
        t = sorted(py_tokens(url)[: urls.MAX_ITEMS])
        for n in range(1, len(t) + 1):
            for s in itertools.combinations(t, n):
                count[s] = count.get(s, 0) + 1
                both[s, label] = both.get((s, label), 0) + 1
    return [urls.Rule(s, v, n, n / count[s]) for (s, v), n in both.items() if n >= least and n / count[s] >= confidence]


def test_tokens(spark):
    rows = [(u,) for u, _ in SITES] + [(None,), ("",), ("no scheme/x",), ("http://",), ("http:///p//q/?a&&b=1=2&=3#?z",), ("x://A.B:80/C\nd?Q=%20",), ("http://é.example/ü?ß=1",), ("a://b?x://c",)]
    got = spark.createDataFrame(rows, "u string").select("u", urls.tokens(F.col("u")).alias("t"), urls.host(F.col("u")).alias("h"), urls.path(F.col("u")).alias("p")).collect()
    assert [(r.u, r.t) for r in got] == [(u, py_tokens(u)) for (u,) in rows]
    by = {r.u: (r.h, r.p) for r in got}
    assert by[None] == by[""] == by["no scheme/x"] == ("", "") and by["x://A.B:80/C\nd?Q=%20"] == ("a.b:80", "/C\nd") and by["a://b?x://c"] == ("b", "")


def test_mined_rules_are_brute_force(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(240):
        site = str(r.choice(["spam-farm", "good", "news", "ads-track"]))
        label = "block" if site in ("spam-farm", "ads-track") and r.random() < 0.9 or r.random() < 0.1 else "allow"
        rows.append((f"http://{r.choice(['www.', 'm.', ''])}{site}.example.{r.choice(['com', 'org'])}/{r.choice(['en', 'fr'])}/{i}{r.choice(['', '?page=2&ref=x', '.html'])}", label))
    rows += [rows[0]] * 40  # a group of copies
    d = spark.createDataFrame([*rows, (None, "block"), ("http://x.y/", None), ("http://x.y/", "maybe")], "url string, label string")
    rules = urls.mine(d, min_support=0.02, min_rows=5, min_confidence=0.6)
    want = brute_rules(rows, max(5, -(-len(rows) * 2 // 100)), 0.6)
    assert set(rules) <= set(want) and len({x.tokens for x in rules if x.verdict == "block"}) < len(want)
    index, whole = urls.Index(rules), sorted(want, key=lambda x: x.order)
    for u in [u for u, _ in rows] + ["http://spam-farm.example.net/de/1", "http://other.test/", ""]:
        have = frozenset(py_tokens(u))
        assert index.best(have) == next((x for x in whole if set(x.tokens) <= have), None)
    assert index.best(frozenset(py_tokens("http://www.ads-track.example.com/fr/7"))).verdict == "block"


def test_judged(spark):
    d = spark.createDataFrame([(i, u, 0) for i, (u, _) in enumerate(SITES * 3)], "page_id long, url string, host int").withColumn("label", F.when(F.col("url").contains("spam"), "block").otherwise("allow"))
    mined = urls.mine(d)
    fixed = urls.parse("block net/, allow example.net/en/, block example.com/de/, allow org/fr/")
    assert fixed == [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    rows = [
        (1, "http://a.example.net/en/1", "example.net/en/", "allow"),
        (2, "http://a.example.net/de/1", "net/", "block"),
        (3, "http://net/", "net/", "block"),
        (4, "http://net", None, "allow"),
        (5, "http://xexample.net/en/1", "net/", "block"),
        (6, "http://EXAMPLE.com/de/1", "example.com/de/", "block"),
        (7, "http://example.com/DE/1", None, "allow"),
        (8, "http://w.org/fr/2?x", "org/fr/", "allow"),
        (9, "http://spam-farm.test/q", None, "block"),
        (10, None, None, "allow"),
        (10, None, None, "allow"),
        (None, "", None, "allow"),
        (11, "http://long.test/" + "ab/" * 50_000, None, "allow"),
    ]
    e = spark.createDataFrame([(i, u, "x", 1.0) for i, u, _, _ in rows], "page_id long, url string, verdict string, confidence double")
    got = [(r.page_id, r.rule, r.verdict) for r in urls.judge(e, fixed, mined).collect()]
    assert got == [(i, rule, v) for i, _, rule, v in rows]
    assert urls.mine(d.limit(0)) == [] and urls.judge(e.limit(0), fixed, []).count() == 0
    assert {r.verdict for r in urls.judge(e, [], []).collect()} == {"allow"}


# ------------------------------------------------------------------ 12 Merkle manifest


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def py_leaf(r):
    return sha("".join("-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in merkle.FIELDS))


def py_tree(nodes, fanout):
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(place):
            a = p // fanout * fanout
            paths[i].append(("".join(nodes[a:p]), "".join(nodes[p + 1 : a + fanout])))
            place[i] = p // fanout
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def py_manifest(rows, fanout):
    by = {}
    for i, r in enumerate(rows):
        by.setdefault(r["source"], []).append(((r["doc_id"] is not None, r["doc_id"] or 0, py_leaf(r), i), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in names:
        by[s].sort(key=lambda x: x[0])
        made[s] = py_tree([x[0][2] for x in by[s]], fanout)
    root, above = py_tree([made[s][0] for s in names], fanout) if names else (None, [])
    out = []
    for s, up in zip(names, above, strict=True):
        for (key, r), path in zip(by[s], made[s][1], strict=True):
            hit = zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None
            node = py_leaf(r | {"text": "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"])}) if hit else key[2]
            for a, b in path + up:
                node = sha(a + node + b)
            out.append((r["doc_id"], key[2], made[s][0], root, sha("".join(a + b for a, b in path + up)), node, node == root))
    return sorted(out, key=str)


def manifest(df, **options):
    got = merkle.manifest(df, changed={"text": merkle.tampered(F.col("text"), F.col("doc_id"))}, **options)
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got.collect()), key=str)


@pytest.fixture(scope="module")
def many(spark):
    """A source with most rows, groups of repeated rows, null and empty fields, sources of one row."""
    rows = [(i, f"Text {i % 7}", "en", "hot", i) for i in range(300)] + [(5, "same", "en", "rep", 1)] * 90
    rows += [(1, "A b", "en", "s", 3), (1, "A b", "en", "s", 3), (2, None, None, None, None), (None, "Xx", None, None, 2), (None, "", None, "", 0), (9, "é漢\U0001f600Q", "de", "ü", 4)]
    rows += [(1000 + i, "Only One", "fr", f"one{i}", 1) for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in ("g", "k", "b", "at", "n", "digest", "leaf", "root", "now")})


@pytest.mark.parametrize(("fanout", "levels"), [(16, 3), (16, 1), (4, 2), (2, 3)])
def test_manifest_is_brute_force(many, fanout, levels):
    assert manifest(many, fanout=fanout, levels=levels) == py_manifest([r.asDict() for r in many.collect()], fanout)


def test_manifest_of_few_rows(many):
    one = many.filter("source = 'ü'")
    ((_, leaf, sub, root, proof, folded, ok),) = manifest(one)
    assert leaf == sub == root == py_leaf(one.first().asDict()) and proof == sha("") and ok is (folded == root)
    assert manifest(many.limit(0)) == []


def test_proofs_fold_to_the_root(many):
    got = merkle.manifest(many, fanout=4, levels=2, proofs=True).collect()
    assert len({r.root for r in got}) == 1 and all(r.verified for r in got)
    for r in got[::7]:
        assert merkle.fold(r.leaf, [(p.l, p.r) for p in r.proof]) == r.root
        assert merkle.fold(sha("other"), [(p.l, p.r) for p in r.proof]) != r.root


# ------------------------------------------------------------------ 13 periodic runs


def brute_runs(x):
    out = []
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i < len(x) - q:
            j = i
            while j < len(x) - q and x[j] == x[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(6, 4 * q) and not any(all(x[k] == x[k + d] for k in range(i, i + size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


pieces = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 9), st.integers(0, 3)), max_size=6)


@settings(max_examples=400, deadline=None)
@given(pieces)
def test_runs_are_brute_force(parts):
    x = [w for p, times, cut in parts for w in (p * times)[cut:]]
    assert periodic.runs_of(periodic.numbered(x)) == brute_runs(x)


@pytest.mark.parametrize(("n", "k"), [(3000, 1), (3000, 2), (5000, 40), (4000, 4000)])
def test_lag_counts_are_exact(n, k):
    """Heavy words by transforms, light ones by differences."""
    x = np.concatenate([np.random.default_rng(k).integers(0, k, n), np.zeros(n // 3, np.int64)])
    got = periodic.lag_counts(x, len(x) // 4)
    assert got[1:].tolist() == [int((x[:-q] == x[q:]).sum()) for q in range(1, len(x) // 4 + 1)]


def test_long_periods_and_whole_texts():
    r = np.random.default_rng(0)
    x = np.concatenate([r.integers(0, 50_000, 3000), np.tile(r.integers(0, 50_000, 700), 5), r.integers(0, 50_000, 1000)])
    ((start, size, q),) = [y for y in periodic.runs_of(periodic.numbered(x.tolist())) if y[2] > 9]
    assert q == 700 and start <= 3000 and 3500 <= size <= 3504
    assert periodic.runs_of(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]


def test_periodic_rows(spark):
    rows = [(1, "a b a b a b a b c"), (2, None), (3, ""), (None, "x x x x x x y"), (4, "one two three"), (4, "one two three"), (5, "w " * 100_000), (7, "a a a a a")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("runs", "start", "length", "n_runs")})
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.find(d).collect()]
    assert got == [(1, [(0, 8, 2)], "a b c"), (2, [], ""), (3, [], ""), (None, [(0, 6, 1)], "x y"), (4, [], "one two three"), (4, [], "one two three"), (5, [(0, 100_000, 1)], "w"), (7, [], "a a a a a")]
    for r, (_, runs, text) in zip(periodic.digests(d, plant=False).collect(), got, strict=True):
        top = max(runs, key=lambda x: x[1] / x[2], default=None)
        assert r.n_runs == len(runs) and r.collapsed_sha256 == sha(text) and r.runs_sha256 == sha("".join("%d,%d,%d\n" % x for x in runs))
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*top, 1000 * top[1] // top[2]) if top else (None,) * 4)
    assert periodic.digests(d.limit(0)).count() == 0


def test_planted_runs(spark, sf):
    """Every text that the query makes periodic four times or more over is found; its unplanted words are untouched."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in periodic.digests(docs).collect()}
    for r in docs.collect():
        words = (r.text or "").encode().split()
        h = zlib.crc32(str(r.doc_id).encode())
        changed = [words[i if h % 10 or i < (a := h // 10 % len(words)) else a + (i - a) % (1 + (len(words) - a) // (3 + h // 10 % 8))] for i in range(len(words))]
        assert periodic.planted(words, r.doc_id) == changed
        if len(words) < 400:
            runs = brute_runs(changed)
            assert got[r.doc_id].n_runs == len(runs) and got[r.doc_id].runs_sha256 == sha("".join("%d,%d,%d\n" % x for x in runs))
