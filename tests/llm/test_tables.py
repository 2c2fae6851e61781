"""Top-k, URLs, archives, the pipeline and the registered queries."""

import hashlib
import os
import random
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import common, topk, urlfilter, warc
from tidewater.llm.catalog import ORACLES, QUERIES

DATA = os.environ.get("TIDEWATER_TESTDATA", "/root/testdata/sf0.001")

# top-k


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, rank string")


def brute(rows, asked, k=10):
    good = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i in asked:
            n = [(-int(sum(a * b for a, b in zip(q, x, strict=False))), j) for j, x in good if j != i]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(n)[:k])]
    return sorted(out)


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "ROWS", 32)
    monkeypatch.setattr(topk, "BLOCKS_AT_ONCE", 2)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 7) for _ in range(24)]) for i in range(400)]
    rows += [(1_000 + i, rows[3][1]) for i in range(15)]  # ties
    rows += [(2_000, None), (2_001, [1.0] * 23 + [None]), (2_002, [float("nan")] * 24), (2_003, [float("inf")] * 24), (None, [1.0] * 24), (2_004, [0.0] * 24), (2_005, [5.0] * 10)]
    asked = {*range(0, 400, 40), 2_000, 2_002, 2_004}
    table = vectors(spark, rows)
    got = topk.top_k(table, table.where(table.vec_id.isin(*asked)))
    assert sorted(map(tuple, got.collect())) == brute(rows, asked)


@pytest.mark.parametrize("block", [1, 2, 100])
def test_top_k_of_repeated_ids(spark, monkeypatch, block):
    """Each row of an id is a query with ranks of its own, in one block of queries or in several; and a candidate."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    monkeypatch.setattr(topk, "BLOCKS_AT_ONCE", 2)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)]
    rows += [rows[0], rows[0], (0, [rng.gauss(0, 1) for _ in range(6)]), rows[7], (7, [rng.gauss(0, 1) for _ in range(6)]), (9, None)]
    table = vectors(spark, rows)
    got = sorted(map(tuple, topk.top_k(table, table.where("vec_id in (0, 7, 20)")).collect()))
    assert got == brute(rows, {0, 7, 20}) and len(got) == 10 * (4 + 3 + 1)
    db = duckdb.connect()
    db.execute("CREATE TABLE embeddings(vec_id BIGINT, embedding FLOAT[])")
    db.executemany("INSERT INTO embeddings VALUES (?, ?)", [((0, 7, 20).index(i) * 100 if i in (0, 7, 20) else 1000 + i, v) for i, v in rows])
    same = sorted((q // 100 if q < 1000 else q, r, i, s) for q, r, i, s in db.execute(topk.SQL).fetchall() if q < 300)
    # ids are renamed for the SQL's query set, which doesn't change scores and ranks
    assert sorted((q, r, s) for q, r, _, s in same) == sorted(((0, 7, 20).index(q), r, s) for q, r, _, s in got)


def test_top_k_odd_tables(spark):
    assert topk.top_k(vectors(spark, []), vectors(spark, [])).count() == 0
    few = vectors(spark, [(0, [1.0, 2.0]), (1, [0.5, 0.5])])
    assert [tuple(r) for r in topk.top_k(few, few.where("vec_id = 0")).collect()] == [(0, 1, 1, 512 * 1024 + 512 * 2048)]
    assert topk.top_k(few, few.limit(0)).count() == 0


# urls


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "r") for i, u, h in rows], "page_id long, url string, html string, rule string")


def test_rules(spark):
    urls = [
        ("http://a.org/x", "org/", "allow"), ("http://A.Example.ORG/es/q?x#y", "example.org/es/", "block"), ("https://example.org/en/12", "example.org/en/1", "block"), ("https://example.org/en/2", "org/", "allow"),
        ("http://notexample.org/es/", "org/", "allow"), ("x://m.shop.com/fr/1", "com/fr/", "allow"), ("http://shop.com/de/", "com/de/", "block"), ("http://shop.com/DE/", None, None), ("http://org/", "org/", "allow"), ("http://a.org", None, None),
        ("http://a.org?x=/", None, None), (None, None, None), ("nourl", None, None), ("http://", None, None), ("http://a.net/#/fr/", None, None),
    ]
    got = {r.page_id: r for r in urlfilter.judge(pages(spark, [(i, u, None) for i, (u, _, _) in enumerate(urls)])).collect()}
    assert len(got) == len(urls)
    for i, (u, rule, verdict) in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host = m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) if m else ""
        assert (got[i].host, got[i].path, got[i].rule) == (host, m[2] if m else "", rule)
        assert verdict is None or got[i].verdict == verdict


def test_links_carry_trust_and_distrust(spark):
    link = lambda u: f'<a href="{u}">x</a>'
    rows = [(1, "http://good.org/a", link("http://friend.net/") + link("/own")), (2, "http://bad.com/de/x", ""), (3, "http://spam.net/", link("http://bad.com/de/x") * 3), (4, "http://friend.net/y", ""), (5, "http://lone.net/", None)]
    got = {r.page_id: r for r in urlfilter.judge(pages(spark, rows)).collect()}
    assert [got[i].verdict for i in (1, 2, 3, 4, 5)] == ["allow", "block", "block", "allow", "allow"]
    assert got[4].trust > 0 and got[3].distrust > 0


@pytest.mark.parametrize("hub", [100_000, 2])
def test_walk_is_page_rank(spark, monkeypatch, hub):
    monkeypatch.setattr(common, "HUB", hub)
    rng = random.Random(3)
    hosts = [f"h{i}" for i in range(12)]
    edges = {(a, b): float(rng.randint(1, 3)) for a in hosts for b in rng.sample(hosts, 3)}
    seeds = {h: float(i) for i, h in enumerate(hosts[:4])}
    got = urlfilter.walk(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src string, dst string, w double"), spark.createDataFrame(list(seeds.items()), "host string, mass double"), rounds=5)
    m = np.zeros((12, 12))
    for (a, b), w in edges.items():
        m[hosts.index(b), hosts.index(a)] = w
    m /= m.sum(0)
    s = np.array([seeds.get(h, 0.0) for h in hosts])
    r = s.copy()
    for _ in range(5):
        r = 0.85 * m @ r + 0.15 * s
    found = {x.host: x.rank for x in got.collect()}
    assert all(abs(found.get(h, 0.0) - v) < 1e-9 for h, v in zip(hosts, r, strict=True))


def test_distrust_reaches_deep_subdomains(spark):
    rows = [(1, "http://bad.com/de/x", ""), (2, "http://a.b.c.d.bad.com/x", ""), (3, "http://k.l.m.fine.net/", "")]
    got = {r.page_id: r for r in urlfilter.judge(pages(spark, rows)).collect()}
    assert [got[i].verdict for i in (1, 2, 3)] == ["block", "block", "allow"] and got[2].distrust > 0


def test_walk_goes_on_until_ranks_stand_still(spark):
    hosts = [f"h{i}" for i in range(16)]
    chain = [(a, b, 1.0) for a, b in zip(hosts, hosts[1:], strict=False)] + [(b, a, 1.0) for a, b in zip(hosts, hosts[1:], strict=False)]
    got = urlfilter.walk(spark.createDataFrame(chain, "src string, dst string, w double"), spark.createDataFrame([("h0", 2.0)], "host string, mass double"), tolerance=1e-6)
    m = np.zeros((16, 16))
    for a, b, w in chain:
        m[hosts.index(b), hosts.index(a)] = w
    m /= m.sum(0)
    s = np.array([2.0] + [0.0] * 15)
    want = 0.15 * np.linalg.solve(np.eye(16) - 0.85 * m, s)
    found = {r.host: r.rank for r in got.collect()}
    assert set(found) == set(hosts) and all(abs(found[h] - v) < 2e-5 for h, v in zip(hosts, want, strict=True)) and found["h15"] > 0


def brute_judge(rows):
    """page -> (host, path, rule, verdict, trust, distrust), with dense matrices."""
    rules = {("org", "/"): "allow", ("example.org", "/es/"): "block", ("example.org", "/en/1"): "block", ("com", "/fr/"): "allow", ("com", "/de/"): "block"}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen, good, bad, weight = [], {}, {}, {}
    for _, url, html in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(lower), m[2]) if m else ("", "")
        fit = max((("".join(r), v) for r, v in rules.items() if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])), key=lambda x: len(x[0]), default=(None, None))
        seen.append((host, path, *fit))
        if not host:
            continue
        good[host], bad[host] = good.get(host, 0) + (fit[1] == "allow"), bad.get(host, 0) + (fit[1] == "block")
        weight.setdefault((host, host), 0)
        for u in re.findall(r"<a href=\"([^\"]+)\"", html or ""):
            far = re.match(r"(?:https?:)?//([^/?#]*)", u)
            to = far[1].translate(lower) if far else host
            if to:
                weight[host, to] = weight.get((host, to), 0) + 1
    # a host without links of its own counts as one with one
    own = {h: 0 for h, _ in weight if (h, h) in weight}
    for (_, url, html), (host, *_) in zip(rows, seen, strict=True):
        if host:
            own[host] += sum(not re.match(r"(?:https?:)?//", u) for u in re.findall(r"<a href=\"([^\"]+)\"", html or ""))
    for h, n in own.items():
        weight[h, h] += max(1, n) - n
    names = {h for e in weight for h in e}
    for h in list(names):
        while h.count(".") >= 2:
            up = h.split(".", 1)[1]
            names.add(up)
            weight.setdefault((h, up), 0), weight.setdefault((up, h), 0)
            h = up
    for h in names:
        if h.count(".") >= 2:
            up = h.split(".", 1)[1]
            weight[h, up] += 1
            weight[up, h] += 1
    hosts = sorted(names)
    at = {h: i for i, h in enumerate(hosts)}

    def ranks(edges, seeds):
        a = np.zeros((len(hosts), len(hosts)))
        for (x, y), w in edges.items():
            a[at[y], at[x]] += w
        total = a.sum(0)
        a /= np.where(total > 0, total, 1)
        return np.linalg.solve(np.eye(len(hosts)) - 0.85 * a, 0.15 * np.array([seeds.get(h, 0.0) for h in hosts]))

    trust, distrust = ranks(weight, good), ranks({(y, x): w for (x, y), w in weight.items()}, bad)
    out = []
    for host, path, rule, verdict in seen:
        t, d = (trust[at[host]], distrust[at[host]]) if host else (0.0, 0.0)
        out.append((host, path, rule, verdict or ("block" if d > t else "allow"), t, d))
    return out


def test_judge_is_what_brute_force_gives(spark):
    """The whole query's work, on deep hosts, hubs, repeated rows, very long urls and pages."""
    rng = random.Random(5)
    hosts = ["a.org", "example.org", "m.Example.org", "x.com", "deep.er.still.y.com", "z.net", "p.q.r.s.z.net", "hub.net", "lone.info", "v.w.info"]
    bad = ["spam.info", "a.b.c.d.spam.info", "spam2.info"]
    paths = ["/", "/es/1", "/en/12", "/fr/x", "/de/x", "/other?q=/de/", ""]
    rows = []
    for i in range(160):
        links = [f"http://{rng.choice(hosts)}/{k}" if rng.random() < 0.4 else "//hub.net/" if rng.random() < 0.2 else "/own" for k in range(rng.randint(0, 5))]
        rows.append((i, f"http://{rng.choice(hosts)}{rng.choice(paths)}", "".join(f'<a href="{u}">x</a>' for u in links) if i % 9 else None))
    # hosts that link to blocked pages, and none that trusted hosts link to
    rows += [(200 + i, f"http://{rng.choice(bad)}{rng.choice(paths)}", "".join('<a href="http://fixed.y.com/">' for _ in range(1 + i % 3))) for i in range(12)]
    rows += [(300 + i, f"http://fixed.y.com/de/{i}", "") for i in range(40)]
    rows += [rows[3], rows[3], (500, None, '<a href="http://a.org/">'), (501, "no url", None), (502, "http://z.net/" + "u" * 100_000, '<a href="/x">' + "y" * 500_000 + '<a href="http://x.com/">')]
    got = urlfilter.judge(pages(spark, [(k, u, h) for k, (_, u, h) in enumerate(rows)])).orderBy("page_id").collect()
    want = brute_judge(rows)
    assert len(got) == len(rows) and {w[3] for w in want if w[2] is None} == {"allow", "block"}
    mass = sum(w[2] is not None for w in want)
    for r, (host, path, rule, verdict, t, d) in zip(got, want, strict=True):
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert abs(r.trust - t) < 1e-3 * mass and abs(r.distrust - d) < 1e-3 * mass
        assert r.verdict == verdict or abs(t - d) < 1e-3 * mass and rule is None


def test_hostile_pages_take_linear_time(spark):
    long_host = ".".join(f"l{i}" for i in range(100_000)) + ".deep.bad.com"
    rows = [
        (1, "http://good.org/a", "<a " * 350_000), (2, "http://bad.com/de/x", "<a href" * 150_000), (3, f"http://{long_host}/x", "<a href=" + " " * 500_000), (4, "http://good.org/b", '<a class="x" href="http://friend.net/">' * 20_000 + "<a\n" * 100_000),
        (5, "http://" + "." * 100_000, None), (6, "http://friend.net/", "<a " * 1000 + 'href="//good.org/"' + "<a " * 100_000), (7, "http://x.net/", "href=x " * 100_000),
    ]
    began = time.time()
    got = {r.page_id: r for r in urlfilter.judge(pages(spark, rows)).collect()}
    assert time.time() - began < 60 and len(got) == 7
    assert got[3].distrust > 0 and got[3].verdict == "block" and got[6].trust > 0 and got[7].trust == 0


def test_links(spark):
    htmls = {'<a href="x">': ["x"], "<A\nclass=q HREF = 'y z'>": ["y"], "<a href=x <a href=y>": ["x", "y"], '<a title="<b" href="z">': ["z"], "<abbr href=x><a>href=y</a><b href=q>": [], "<a href=>": [], "<a x><a href='p'": ["p"], "": [], "<a href=a><a href=b><p><a  href = c >": ["a", "b", "c"]}
    got = spark.createDataFrame([(h,) for h in htmls] + [(None,)], "html string").select("html", urlfilter.links_of(F.col("html")).alias("l")).collect()
    assert {r.html: r.l for r in got} == {**htmls, None: []}


def test_domains_end_at_owners(spark):
    hosts = {"m.shop.co.uk": ["m.shop.co.uk", "shop.co.uk"], "shop.co.uk": ["shop.co.uk"], "co.uk": [], "a.b.org": ["a.b.org", "b.org"], "org": [], "1.2.3.4": [], "[::1]": [], "": [], "x.y.uk.com": ["x.y.uk.com", "y.uk.com"], "x" * 300: [], "x" * 300 + ".a.b.net": ["a.b.net", "b.net"]}
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", urlfilter.domains(F.col("h")).alias("d")).collect()
    assert {r.h: r.d for r in got} == hosts
    urls = ["http://u:p@A.org:80/x", "http://a.org:8080", "http://a.org/", "http://[::1]:80/"]
    nodes = spark.createDataFrame([(u,) for u in urls], "u string").select(urlfilter.node_of(urlfilter.host_of(F.col("u"))).alias("n")).collect()
    assert [r.n for r in nodes] == ["a.org", "a.org", "a.org", "[::1]"]


def test_strangers_share_no_distrust(spark):
    rows = [(1, "http://a.shop.uk.com/de/x", ""), (2, "http://other.uk.com/x", ""), (3, "http://b.shop.uk.com/y", ""), (4, "http://1.2.3.4/", ""), (5, "http://9.2.3.4/", '<a href="http://a.shop.uk.com/de/">'), (6, "http://c.shop.uk.com:81/", "")]
    got = {r.page_id: r for r in urlfilter.judge(pages(spark, rows)).collect()}
    assert [got[i].verdict for i in (1, 2, 3, 4, 5, 6)] == ["block", "allow", "block", "allow", "block", "block"] and got[2].distrust == 0 == got[4].distrust
    assert got[6].host == "c.shop.uk.com:81"


def test_urls_of_nothing(spark):
    assert urlfilter.judge(pages(spark, [])).count() == 0


# archives


def find(spark, archive, *keys):
    """(record_type, payload) of all records of the keys."""
    return [(r.record_type, bytes(r.payload)) for r in warc.read(archive, warc.locate(archive, spark.createDataFrame([(k,) for k in keys], "key string")), payload=True).collect()]


def test_archives(spark):
    body = "<html>" + "x" * 200 + "é</html>"
    rows = [(5, "http://b.example.org/p?q=1", body), (3, "http://a.example.org/", body), (9, None, body), (4, "http://b.example.org/p?q=1", "other"), (7, "bad\r\nurl", ""), (8, "http://a.example.org/", None), (10, "http://z.net/", "short"), (11, "http://z.net/", "short"), (None, "http://n.net/", body), (3, "http://a.example.org/", body), (12, "http://long.net/" + "u" * 20_000, "y" * 3_000_000)]
    table = pages(spark, rows)
    archive = warc.index(*warc.write(table), lines=3)
    got = sorted(map(tuple, warc.read(archive, warc.locate(archive, table.select(warc.url_key(table.url).alias("key"), "page_id"))).collect()), key=repr)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    size = lambda t: len((t or "").encode())
    want = [(i, size(t), sha(t), "revisit" if t == body and i != 3 else "response", 3 if t == body and i != 3 else None) for i, _, t in rows]
    assert got == sorted(want, key=repr)
    assert sorted(find(spark, archive, "org,example,b)/p?q=1")) == [("response", b"other"), ("revisit", b"")]
    assert len(find(spark, archive, "net,z)/")) == 2 and find(spark, archive, "org,none)/", "", "zzz") == [("revisit", b"")]
    assert archive.directory.count() >= 4


def test_many_captures_are_found(spark):
    """Keys with many captures, over several blocks and files of the index."""
    rows = [(i if i % 50 else None, f"http://h{i % 37}.example.com/{i % 5}" if i % 4 else "http://hot.com/", f"page {i} " * 20) for i in range(2_000)]
    table = pages(spark, rows)
    archive = warc.index(*warc.write(table), lines=20)
    assert len(archive.files) > 1
    for i in (0, 777, 1_999):
        key = f"com,example,h{i % 37})/{i % 5}" if i % 4 else "com,hot)/"
        want = sorted(t.encode() for _, u, t in rows if u == rows[i][1])
        assert sorted(p for _, p in find(spark, archive, key, key)) == want
    all_ = warc.read(archive, warc.locate(archive, table.select(warc.url_key(table.url).alias("key"), "page_id")), payload=True)
    assert sorted(bytes(r.payload) for r in all_.collect()) == sorted(t.encode() for _, _, t in rows)
    some = table.where("page_id % 7 = 0").select(warc.url_key(table.url).alias("key"), "page_id")
    assert sorted(r.page_id for r in warc.locate(archive, some).collect()) == [i for i, _, _ in rows if i is not None and i % 7 == 0]


def test_archive_of_nothing(spark):
    archive = warc.index(*warc.write(pages(spark, [])))
    assert archive.files == [] and find(spark, archive, "x") == []


# the registered queries


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cur = c.execute(ORACLES[name])
    names = [x[0] for x in cur.description]
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(cur.fetchall(), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline_keeps_what_it_should(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = docs
    for name, stage in pipeline.STAGES:
        out = stage(spark, seen, DATA)
        if name != "encode":
            assert out.columns == docs.columns
        out = out.cache()
        before, after = {r.doc_id for r in seen.select("doc_id").collect()}, {r.doc_id for r in out.select("doc_id").collect()}
        assert after and after <= before
        if name in ("pii", "encode"):
            assert after == before
        seen = out
    assert out.where("n_pieces <> size(ids)").count() == 0
