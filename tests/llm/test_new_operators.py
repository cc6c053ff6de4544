"""Spelling variants, host reputation, hard negatives: against SQL on the test tables and brute force on small odd ones."""

import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from conftest import SF, TABLES
from helpers import docs_of
from pyspark.sql import functions as F
from test_queries import rows

from folioflow.llm import queries, reputation, spelling, vantage


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"CREATE VIEW {name} AS FROM '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_host_reputation", "op13_hard_negatives"])
def test_queries_same_as_sql(spark, duck, name):
    assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(duck.sql(queries.oracle_sql()[name]).df())


# spelling variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_brute_force(texts, least, least_n, ratio, slip):
    import re

    n = Counter()
    for doc, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda x: x[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= least_n}
    found = {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        found[w] = (best if best and n[best] >= ratio * n[w] else None, len(others))
    out = set()
    for w, (form, others) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        out.add((w, form, root, n[w], others, n[form] if form else None))
    return out


def test_spelling_variants_by_brute_force(spark):
    rng = np.random.default_rng(5)
    words = ["Children", "childrenn", "chidlren", "cildren", "éducation", "Éducation", "educations", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aaaabaaa", "ßßßßßßß", "÷÷÷÷÷÷÷÷", "short"]
    words += ["".join(rng.permutation(list("abcdefg"))) for _ in range(60)] + ["".join(rng.choice(list("aé"), 8)) for _ in range(60)]
    weights = 1 / np.arange(1, len(words) + 1)
    texts = [(int(i) - 3, " ".join(rng.choice(words, 60, p=weights / weights.sum()))) for i in range(40)]
    texts += [(None, "children Children"), (7, None), (8, ""), (9, "x" * 100_000 + " " + "x" * 100_000), (9, "y" * 100_000), (10, "x" * 99_999 + " " + "x" * 99_999), (1, "children"), (1, "children"), (2, "1children2\nchildren_children")]
    for slip, ratio in ((31, 10), (2, 2), (0, 3)):
        got = spelling.spelling_variants(docs_of(spark, texts), slip=slip, ratio=ratio).collect()
        want = variants_by_brute_force(texts, 7, 2, ratio, slip)
        assert len(got) == len(want)
        assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want


def test_roots_follow_long_chains(spark):
    words = spark.createDataFrame([("a" * 7 + "b" * i, 3**i) for i in range(12)], "word string, n long")
    got = {r.word: (r.form, r.root) for r in spelling.grouped(words, ratio=3).collect()}
    assert got["a" * 7] == ("a" * 7 + "b", "a" * 7 + "b" * 11)
    assert got["a" * 7 + "b" * 11] == (None, "a" * 7 + "b" * 11)


def test_spelling_of_nothing(spark):
    assert spelling.spelling_variants(docs_of(spark, [])).count() == 0
    assert spelling.spelling_variants(docs_of(spark, [(1, None), (2, "a b c")])).count() == 0


# host reputation


def test_hosts_and_paths(spark):
    urls = ["HTTP://A.Example.ORG/En/1?x#y", "http://a.org", "a.org/x", None, "x://", "x://h?q/a", "x://h#f", "a://b://c/d", "http://ÄB.org/ä", "http://u@h.co.uk:80/p/"]
    found = spark.createDataFrame([(u,) for u in urls], "url string").select(*reputation.parts(F.col("url"))).collect()
    assert [tuple(r) for r in found] == [("a.example.org", "/En/1"), ("a.org", ""), ("", ""), ("", ""), ("", ""), ("h", ""), ("h", ""), ("b:", "//c/d"), ("Äb.org", "/ä"), ("u@h.co.uk:80", "/p/")]


def test_rules(spark):
    cases = {
        ("example.org", "/es/x"): ("example.org/es/", "block"), ("a.example.org", "/en/12"): ("example.org/en/1", "block"), ("example.org", "/en/2"): ("org/", "allow"), ("org", "/"): ("org/", "allow"),
        ("org", ""): (None, None), ("notexample.org", "/es/"): ("org/", "allow"), ("com", "/de/"): ("com/de/", "block"), ("x.com", "/fr/a"): ("com/fr/", "allow"), ("x.com", "/fr"): (None, None), ("", ""): (None, None), ("xcom", "/de/"): (None, None),
    }
    rule, verdict = reputation.ruled(F.col("host"), F.col("path"), reputation.ALLOWED, reputation.BLOCKED)
    found = spark.createDataFrame(list(cases), "host string, path string").select("host", "path", rule.alias("r"), verdict.alias("v")).collect()
    assert {(r.host, r.path): (r.r, r.v) for r in found} == cases


def test_domains(spark):
    hosts = ["a.b.example.co.uk", "example.com", "com", "", "u@x.y.net:8080", "10.0.0.1", "10.0.0.1:80", "co.uk"]
    found = spark.createDataFrame([(h,) for h in hosts], "host string").select(*reputation.domains(F.col("host"))).collect()
    assert [tuple(r) for r in found] == [("example.co.uk", "co.uk"), ("example.com", "com"), ("com", "com"), ("", ""), ("y.net:8080"[:5], "net"), ("10.0.0.1", ""), ("10.0.0.1", ""), ("co.uk", "co.uk")]


def shrunk(groups):
    """(bad, pages, expected) -> posterior means and the weight of the prior, from the formula of the beta-binomial's variance."""
    extra = sum((y - n * m) ** 2 - n * m * (1 - m) for y, n, m in groups)
    most = sum(n * (n - 1) * m * (1 - m) for y, n, m in groups)
    rho = extra / most if most else 0
    s = min(10_000, max(1, 1 / rho - 1)) if rho > 0 else 10_000
    return [(m * s + y) / (s + n) for y, n, m in groups], s


def test_reputation_by_hand_and_odd_rows(spark):
    hosts = {"bad.evil.com": (40, 50), "new.evil.com": (0, 0), "ok.evil.com": (30, 40), "a.fine.com": (1, 60), "b.fine.com": (0, 3), "x.net": (0, 20), "y.net": (1, 1)}
    pages, outcomes, i = [], [], 0
    for host, (bad, n) in hosts.items():
        for k in range(max(n, 1)):
            pages.append((i, f"http://{host}/{i}", "x", 1.0))
            outcomes += [(i, int(k < bad))] if n else []
            i += 1
    pages += [(None, "http://x.net/", "x", 1.0), (i, None, "x", 1.0), (i + 1, "nothing", "x", 1.0), (0, "http://bad.evil.com/0", "x", 1.0)]
    outcomes += [(None, 1), (i + 5, 1), (3, None), (4, 7)]
    found = reputation.judged(spark.createDataFrame(pages, "page_id long, url string, rule string, bound double"), spark.createDataFrame(outcomes, "page_id long, bad int"), allowed=(), blocked=()).collect()
    assert len(found) == len(pages)
    hosts["bad.evil.com"] = (41, 51)  # page 0 is there twice
    hosts[""] = (0, 0)
    domain = lambda h: ".".join(h.split(".")[-2:])
    sums = lambda key: {k: tuple(map(sum, zip(*(hosts[h] for h in hosts if key(h) == k), strict=True))) for k in {key(h) for h in hosts}}
    by_suffix, by_domain = sums(lambda h: h.split(".")[-1]), sums(domain)
    rate = sum(b for b, _ in hosts.values()) / sum(n for _, n in hosts.values())
    suffix_mean = dict(zip(by_suffix, shrunk([(*v, rate) for v in by_suffix.values()])[0], strict=True))
    domain_mean = dict(zip(by_domain, shrunk([(*v, suffix_mean[k.split(".")[-1]]) for k, v in by_domain.items()])[0], strict=True))
    means, s = shrunk([(*v, domain_mean[domain(h)]) for h, v in hosts.items()])
    bounds = {h: m - 1.645 * math.sqrt(m * (1 - m) / (s + hosts[h][1] + 1)) for h, m in zip(hosts, means, strict=True)}
    for r in found:
        assert r.bound == pytest.approx(bounds[r.host], abs=1e-9)
        assert r.verdict == ("block" if bounds[r.host] > 0.2 else "allow") and r.rule is None
    verdicts = {r.host: r.verdict for r in found}
    assert verdicts["bad.evil.com"] == verdicts["ok.evil.com"] == "block" and verdicts["a.fine.com"] == "allow"
    assert {r.host: r.bound for r in found}["new.evil.com"] > bounds["x.net"]


def test_reputation_of_nothing(spark):
    pages, outcomes = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, bad int")
    assert reputation.judged(pages, outcomes).count() == 0
    found = reputation.judged(spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string"), outcomes).collect()
    assert [(r.page_id, r.verdict) for r in found] == [(1, "allow")]


# hard negatives


def negatives_by_brute_force(vectors, anchors, k_positive=5, k_negative=10, low=30, high=90):
    sound = [(i, v, [math.floor(256 * float(x)) for x in e], y) for i, (v, e, y) in enumerate(vectors) if v is not None and y is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, v, e, y in sound:
        if not anchors(v):
            continue
        scored = sorted((-sum(a * b for a, b in zip(e, f, strict=True)), u, j, z) for j, u, f, z in sound if j != i and len(f) == len(e))
        for p, pid, _, _ in [x for x in scored if x[3] == y][:k_positive]:
            kept = [x for x in scored if x[3] != y and low * -p <= 100 * -x[0] <= high * -p][:k_negative]
            out += [(v, pid, r + 1, x[1], -p, -x[0]) for r, x in enumerate(kept)]
    return Counter(out)


COLUMNS = "vec_id long, embedding array<float>, label int, rank int, score double"


def compared(spark, vectors, shard_rows):
    frame = spark.createDataFrame([(*v, 0, 0.5) for v in vectors], COLUMNS)
    got = vantage.hard_negatives(frame, anchor=F.col("vec_id") % 5 == 0, shard_rows=shard_rows)
    return Counter(tuple(r) for r in got.collect()), negatives_by_brute_force(vectors, lambda v: v % 5 == 0)


def test_hard_negatives_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(vantage, "LEAF_ROWS", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6))
    vectors = [(i, (centres[i % 12] + rng.normal(size=6) * 0.4).tolist(), int(rng.integers(4))) for i in range(700)]
    vectors += [(700 + i, vectors[7][1], i % 3) for i in range(300)]  # equal vectors: ties, and a leaf that can't be cut
    got, want = compared(spark, vectors, 64)
    assert got == want and len(want) > 1000


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 0.0], 1), (5, [0.5, 0.5], 1), (1, [1.0, 0.1], 1), (2, [0.5, 0.0], 2), (3, [0.5, 0.0], 2), (3, [0.5, 0.0], 2), (4, [0.9, 0.0], 3), (0, [1.0, 0.0], 1), (6, None, 1), (7, [1.0, None], 1)]
    vectors += [(8, [nan, 1.0], 1), (9, [inf, 1.0], 2), (11, [1.0, 1.0], None), (None, [1.0, 1.0], 2), (10, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.0, 0.0], 1), (13, [0.6, 0.0, 0.0], 2), (15, [], 1), (16, [], 1), (17, [], 2), (20, [-1.0, -1.0], 4), (21, [1.0, 1.0], 4), (22, [-0.5, -0.5], 5), (25, [0.0, 0.0], 4)]
    got, want = compared(spark, vectors, 1000)
    assert got == want and len(want) > 20
    got, want = compared(spark, vectors, 2)
    assert got == want


def test_hard_negatives_of_large_components(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, (np.float32(rng.normal(size=3) * 3e5)).tolist(), i % 3) for i in range(60)] + [(60, [1e30, 0.0, 0.0], 1)]
    got, want = compared(spark, vectors, 1000)
    assert got == negatives_by_brute_force(vectors[:60], lambda v: v % 5 == 0) and len(want) > 0


def test_hard_negatives_of_nothing(spark):
    assert vantage.hard_negatives(spark.createDataFrame([], COLUMNS), anchor=F.col("vec_id") % 5 == 0).count() == 0
    assert vantage.hard_negatives(spark.createDataFrame([(0, [1.0], 1, 0, 0.5)], COLUMNS), anchor=F.col("vec_id") % 5 == 0).count() == 0


def test_windows_of_scores(spark):
    """Rounded inwards, also for large and negative scores."""
    scores = [0, 1, -1, 7, -7, 101, 12345, -12345, 2**57 + 3, -(2**57) - 3]
    got = spark.createDataFrame([(s,) for s in scores], "s long").select("s", vantage._percent(F.col("s"), 30, 99).cast("long").alias("a"), vantage._percent(F.col("s"), 90, 0).cast("long").alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(-(-30 * s // 100), 90 * s // 100) for s in scores]


def test_trees_bound_all_distances():
    rng = np.random.default_rng(6)
    points = rng.integers(-300, 300, (500, 8))
    space = vantage.Space(float((points**2).sum(axis=1).max()))
    tree = vantage.Tree(space, points[:100], leaves=16)
    leaf, seen = tree.leaf(points)
    assert len(tree.paths) == 16 and len(np.unique(leaf)) == 16
    least, most = np.full(tree.above.shape, np.nan), np.full(tree.above.shape, np.nan)
    by_leaf = defaultdict(list)
    for i, x in enumerate(leaf):
        by_leaf[x].append(i)
    for x, at in by_leaf.items():
        least[x], most[x] = seen[at].min(axis=0), seen[at].max(axis=0)
    queries = rng.integers(-300, 300, (40, 8))
    low, high = tree.reach(queries, least, most)
    far = space.radius((queries**2).sum(axis=1)[:, None].astype(float), (queries @ points.T).astype(float))
    assert (low[:, leaf] <= far).all() and (far <= high[:, leaf]).all()
