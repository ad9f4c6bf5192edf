"""URL filters, filter audit and whitening: plain versions, edges, and the parts of the methods one by one."""

import math
import re
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wicker.llm import filter_audit, quality, queries, url_filter, whitening


def cut(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def ruled(host, path):
    fits = [(len(r), r, v) for v, r in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return max(fits)[1:] if fits else (None, None)


def test_url_filter(spark, sf_dir):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.queries()["op11_url_filter"](spark, sf_dir).collect()
    assert len(got) == len(urls)
    model = url_filter.train(url_filter.labelled_urls(spark))
    for r in got:
        assert (r["host"], r["path"]) == cut(urls[r["page_id"]])
        rule, verdict = ruled(r["host"], r["path"])
        assert r["rule"] == rule and r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow"))
        # The score, n-gram by n-gram.
        total, n = 0.0, 0
        for kind, text in enumerate((f"^{r['host']}$", r["path"])):
            raw = text.encode()
            for size in url_filter.LENGTHS:
                for at in range(len(raw) - size + 1):
                    h = 2 * size + kind
                    for byte in raw[at : at + size]:
                        h = (h * 0x9E3779B97F4A7C15 + byte + 1) % 2**64
                    h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) % 2**64
                    h = ((h ^ h >> 27) * 0x94D049BB133111EB) % 2**64
                    total, n = total + model[(h ^ h >> 31) >> 48], n + 1
        assert math.isclose(r["score"], 1 / (1 + math.exp(-(total / math.sqrt(max(n, 1)) + model[-1]))), rel_tol=1e-9)


def test_url_model_on_names_held_out():
    rows = url_filter.labelled_rows()
    hosts, paths, labels = [cut(u)[0] for u, _ in rows], [cut(u)[1] for u, _ in rows], np.array([v for _, v in rows], dtype=float)
    of, right, kept = np.arange(len(rows)) // 4 % 5, 0, 0
    pick = lambda xs, m: [x for x, b in zip(xs, m, strict=True) if b]
    for k in range(5):
        out = of == k
        w = url_filter.fit(pick(hosts, ~out), pick(paths, ~out), labels[~out])
        blocked = url_filter.linear(*url_filter.grams(pick(hosts, out), pick(paths, out)), w[:-1]) + w[-1] >= 0
        right, kept = right + int((blocked == labels[out]).sum()), kept + int((~blocked & (labels[out] == 0)).sum())
    assert right >= 0.8 * len(rows) and kept >= 0.98 * (labels == 0).sum()


def test_url_edges(spark):
    urls = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://A.Example.NET/en/x?y#z"), (5, "http://example.net"), (6, "http://x.net#a"), (7, "://h/p"), (8, "a://b?c/d"), (None, "http://net/"), (9, "http://notnet/"), (9, "http://notnet/"), (10, "x://example.com/de/://"), (11, "x://h/" + "p" * 200_000), (12, "x://É.org/fr/\nq")]
    pages = spark.createDataFrame([(*u, "h", 3) for u in urls], "page_id bigint, url string, host string, score int")
    got = {r["page_id"]: r for r in url_filter.judge(pages, url_filter.train(url_filter.labelled_urls(spark))).collect()}
    assert {k: (r["host"], r["path"], r["rule"]) for k, r in got.items() if k != 11} == {
        1: ("", "", None), 2: ("", "", None), 3: ("", "", None), 4: ("a.example.net", "/en/x", "example.net/en/"), 5: ("example.net", "", None), 6: ("x.net", "", None), 7: ("h", "/p", None),
        8: ("b", "", None), None: ("net", "/", "net/"), 9: ("notnet", "/", None), 10: ("example.com", "/de/://", "example.com/de/"), 12: ("É.org", "/fr/\nq", "org/fr/"),
    }
    assert len(got[11]["path"]) == 200_001 and got[None]["verdict"] == "block" and got[4]["verdict"] == "allow"
    none = url_filter.train(spark.createDataFrame([(None, 1), ("a://b", None)], "url string, label int"))
    assert {r["score"] for r in url_filter.judge(pages, none).collect()} == {0.5}
    assert url_filter.judge(pages.limit(0), none).count() == 0


def audited(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    facts = []
    for i, text, source in rows:
        text, words = text or "", re.findall(r"[^\x20\x09-\x0D]+", text or "")
        copy = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)
        failed = {f for f, c in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), bool(set(text) & set("#$%&*|")), copy), strict=True) if c}
        facts.append((source or "", failed, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in facts}:
        for order in map("".join, permutations("ABCDE")):
            left = [f for f in facts if f[0] == part]
            for step, letter in enumerate(order, 1):
                here, gone = [f for f in left if letter in f[1]], [f for f in facts if f[0] == part and letter in f[1] and set(order[: step - 1]) & f[1]]
                left = [f for f in left if letter not in f[1]]
                unique = sum(f[0] == part and f[1] == {letter} for f in facts)
                out[part, order, step] = (letter, len(left), len(here), len(gone), unique, sum(f[2] for f in here), sum(f[3] for f in here))
    return out


def test_filter_audit(spark):
    long = " ".join(f"w{k}" for k in range(250))
    rows = [(1, long, "a"), (2, long, "a"), (3, long, "b"), (3, long, "b"), (None, long, "a"), (None, long, None), (4, None, "a"), (5, "", None), (6, "", ""), (7, "A $ B", "a"), (8, "x " * 400, "b"), (9, "x " * 400, "b"), (10, long.upper(), "a"), (11, "w\t\x0bw\x1cé\n" * 300, "c"), (0, long + " ", "c")]
    rows += [(k, f"copy of {k % 3}", "h") for k in range(100, 900)]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, 1, None), (7, None, 1), (None, 1, 1), (99, 1, 1), (150, 1, 0)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, source string, bits int, part string")
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit(docs, known).collect()
    want = audited(rows, labels)
    assert {(r["part"], r["filter_order"], r["step"]): (r["filter"], r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"]) for r in got} == want and len(got) == len(want)
    for r in got:
        assert r["shapley"] == sum(v[2] for (part, _, _), v in want.items() if part == r["part"] and v[0] == r["filter"])
    assert filter_audit.audit(docs.limit(0), known).count() == 0 and filter_audit.audit(docs, known.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_filter_audit_sql(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    got = queries.queries()["op12_filter_audit"](spark, sf_dir)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()['op12_filter_audit']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def whitened(rows, components=4):
    """Plain: exact covariance, a dense eigensolver."""
    kept = [(i, [math.floor(256.0 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(x) for _, x in kept), default=0)
    kept = [(i, x + [0] * (width - len(x))) for i, x in kept]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    v = np.array([[float(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit)) / n**3 for j in range(width)] for i in range(width)]).reshape(width, width)
    e, u = np.linalg.eigh(v) if width else (np.zeros(0), v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    keep = e > 1e-9 * (e[0] if len(e) else 1)
    z = [(i, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), ((np.array(x) - np.array(sums) / n) @ u / np.sqrt(e))[keep]) for i, x in kept] if keep.any() else []
    return n, e[keep] / np.trace(v) if keep.any() else [], z


def compare(got, rows):
    n, share, z = whitened(rows)
    assert len(got) == len(z) * len(share)
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append((r["vec_id"], r["deviation"], r["whitened"]))
        assert r["n"] == n and math.isclose(r["explained"], share[r["component"] - 1], rel_tol=1e-9) and r["identity_error"] < 1e-6
    for k, found in by.items():
        want = [(i, dev, w[k - 1]) for i, dev, w in z]
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        found, want = sorted(found, key=key), sorted(want, key=key)
        assert [r[:2] for r in found] == [r[:2] for r in want]
        a, b = np.array([r[2] for r in found]), np.array([r[2] for r in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6


def test_whitening(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    compare(queries.queries()["op13_whitening"](spark, sf_dir).collect(), rows)


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.9, -0.3]), (2, [0.5, -0.2, 0.7]), (3, [0.1, 0.9, -0.3]), (3, [0.1, 0.9, -0.3]), (4, None), (5, [nan, 0.0, 0.0]), (6, [0.0, inf, 0.0]), (7, [None, 1.0, 1.0]), (None, [3.5, 2.0, -0.001]), (8, [0.25]), (9, []), (10, [1.0, 1.0, 1.0])]
    frame = lambda data: spark.createDataFrame([(*r, 5, 1.5) for r in data], "vec_id bigint, embedding array<double>, n int, whitened double")
    compare(whitening.whiten(frame(rows)).collect(), rows)
    line = [(k, [k / 256, 2 * k / 256]) for k in range(20)]
    compare(whitening.whiten(frame(line)).collect(), line)
    assert whitening.whiten(frame(line)).agg(F.max("component")).first()[0] == 1
    for none in ([], [(1, None)], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]):
        assert whitening.whiten(frame(none)).count() == 0
    assert whitening.deviations(np.array([[2**40, 0], [1, 1]]), 2**20, [0, 2]) == [None, (2**20) ** 2 + (2**20 - 2) ** 2]


@pytest.mark.parametrize("kind", ["plain", "tied", "clustered", "low rank"])
def test_leading_components(kind):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    e = {"plain": np.arange(24.0, 0, -1), "tied": np.r_[9.0, 5.0, 5.0, 5.0, 5.0, 5.0, np.ones(18)], "clustered": np.r_[4.0, 3.0, 3.0 - 1e-6, 2.0, 2.0 - 1e-5, np.ones(19)], "low rank": np.r_[3.0, 1.0, np.zeros(22)]}[kind]
    v = q * e @ q.T
    v = (v + v.T) / 2
    assert [whitening.above(v, s) for s in (-1.0, 0.5, 2.5, 8.0, 30.0)] == [int((e > s).sum()) for s in (-1.0, 0.5, 2.5, 8.0, 30.0)]
    values, vectors = whitening.leading(v, 4)
    assert len(values) == min(4, int((e > 0).sum())) and np.allclose(values, e[: len(values)], rtol=1e-11)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12 and np.abs(v @ vectors - vectors * values).max() < 1e-11


def test_inertia_of_indefinite_matrices():
    rng = np.random.default_rng(5)
    for d in (1, 2, 3, 8, 15):
        for _ in range(10):
            a = rng.integers(-3, 4, size=(d, d)).astype(float)
            a = a + a.T
            np.fill_diagonal(a, 0 if d % 2 else np.diagonal(a))
            values = np.linalg.eigvalsh(a)
            if np.abs(values).min() > 1e-9:
                assert whitening.inertia(a) == int((values > 0).sum())


def test_quality_does_not_depend_on_the_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    truth = {r["doc_id"]: r["quality"] for r in labels.where(quality.held_out()).collect()}
    first = None
    for parts in (1, 2, 8, 64):
        dealt = docs.where(~quality.held_out()).repartition(parts, "doc_id")
        got = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality.score(docs, quality.train(dealt, labels.where(~quality.held_out()))).collect()}
        first = first or got
        assert all(abs(got[i][0] - first[i][0]) < 1e-6 for i in first)
        assert sum(got[i][1] == q for i, q in truth.items()) >= 0.95 * len(truth) > 0
    # Several chunks: each is a fair draw, so the mean model still tells the classes apart.
    model = quality.train(docs.where(~quality.held_out()), labels.where(~quality.held_out()), chunk=250)
    got = {r["doc_id"]: r["predicted"] for r in quality.score(docs, model).collect()}
    assert sum(got[i] == q for i, q in truth.items()) >= 0.9 * len(truth)
