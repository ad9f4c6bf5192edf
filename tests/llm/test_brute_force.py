"""Every operator against a plain Python version on whole small tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wicker.llm import bpe, langid, line_dedup, ngram_join, quality, queries, sharding, winnowing


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def groups(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def jump(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_sharding(spark, sf_dir, docs):
    got = queries.queries()["op2_sharding"](spark, sf_dir).collect()
    assert all(r["shard"] == jump(r["doc_id"], 40) and r["grown_shard"] == jump(r["doc_id"], 41) for r in got) and len(got) == len(docs)
    for r in got:
        text = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text) + 16, zlib.crc32(text), "key")
    for k in range(40):
        slots = [r["slot"] for r in got if r["shard"] == k]
        assert sorted(slots) == list(range(len(slots)))
    keys = spark.createDataFrame([(k, "t") for k in (-1, -(2**63), 2**63 - 1, 2**40)], "doc_id bigint, text string")
    assert all(r["shard"] == jump(r["doc_id"], 7) for r in sharding.shard(keys, 7).collect())


def test_language_accuracy(spark, sf_dir, docs):
    got = queries.queries()["op10_language_id"](spark, sf_dir).collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.97 * len(held) > 0


def test_forward_sums_all_segmentations():
    p = langid.pieces(langid.vocabulary_path())
    logp = np.log(np.random.default_rng(1).dirichlet(np.ones(p.size), size=2).T)

    def total(word, k):
        table, scale = [1.0] + [0.0] * len(word), []
        m = p.matches([word])
        for end in range(1, len(word) + 1):
            table[end] = sum(table[s] * math.exp(logp[piece, k]) / 256.0**extra for _, s, e, piece, extra in m.tolist() if e == end)
            scale.append(0.0 if table[end] > 1e-100 else math.log(table[end]))
            if scale[-1]:
                table = [t / math.exp(scale[-1]) for t in table]
        return math.log(table[-1]) + sum(scale)

    words = ["▁the", "▁straße", "▁\U0001f600x", "▁" + "ab" * 20, "▁" + "the" * 60, "▁ein" * 400]
    got = langid.word_scores(p, words, logp)
    assert np.allclose(got, [[total(w, k) for k in range(2)] for w in words])


def test_identify_against_plain_sums(spark, docs):
    path = langid.vocabulary_path()
    p, rng = langid.pieces(path), np.random.default_rng(2)
    logp = np.log(rng.dirichlet(np.full(p.size, 0.3), size=3).T + 1e-9)
    some = {i: r["text"][:300] for i, r in list(docs.items())[:12]} | {-1: "", -2: "1 2", -3: "a"}
    df = spark.createDataFrame(list(some.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in langid.identify(df, (["a", "b", "c"], logp), path).collect()}
    low = logp.astype(np.float32).astype(float)
    for i, t in some.items():
        if not any(c.isalpha() for c in t):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        sums = np.zeros(3)
        for word in t.lower().split():
            table = np.zeros((len(word) + 2, 3))
            table[0] = 1
            m = p.matches(["▁" + word])
            for _, s, e, piece, extra in sorted(m.tolist(), key=lambda x: x[2]):
                table[e] += table[s] * np.exp(low[piece]) / 256.0**extra
            sums += np.log(table[-1])
        post = np.exp(sums - sums.max()) / np.exp(sums - sums.max()).sum()
        assert got[i]["lang_pred"] == "abc"[int(sums.argmax())] and math.isclose(got[i]["score"], post.max(), rel_tol=1e-6)


def test_quality_scores_are_the_models(spark, docs):
    some = list(docs.items())[:20]
    df = spark.createDataFrame([(i, r["text"]) for i, r in some], "doc_id bigint, text string")
    rng = np.random.default_rng(3)
    model = {"weight": rng.normal(size=quality.WIDTH), "bias": np.array(0.1), "prior": np.array(0.5)}
    for r in quality.score(df, model).collect():
        x = quality.features([docs[r["doc_id"]]["text"]])[0].astype(float)
        expected = 1 / (1 + math.exp(-min(max(float(x @ model["weight"]) + 0.1, -30), 30)))
        assert math.isclose(r["score"], expected, rel_tol=1e-6) and r["predicted"] == int(r["score"] >= 0.7)


def test_quality_accuracy(spark, docs):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in queries.queries()["op4_quality"](spark, "/root/testdata/sf0.01").collect() if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.95 * len(held) > 0


def test_nonnegative_risk_with_overlap():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(8000, quality.WIDTH))
    y = rng.random(8000) < 0.6
    x[:, 0] += 3 * y
    w, prior = quality.fit(x[:3000][y[:3000]], x[3000:6000])
    p = quality.sigmoid(x[6000:] @ w[:-1] + w[-1])
    assert ((p > 0.5) == y[6000:]).mean() > 0.85 and abs(prior - 0.6) < 0.12


def test_prior_of_separated_scores():
    rng = np.random.default_rng(1)
    positive, unlabelled = rng.normal(4, 1, 1000), np.r_[rng.normal(4, 1, 1200), rng.normal(-4, 1, 2800)]
    assert abs(quality.estimate_prior(positive, unlabelled) - 0.3) < 0.05


def test_bpe_round_trip_and_library(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    c = bpe.Codec(bpe.vocabulary_path())
    odd = ["", " ", "a<|endoftext|> b", "aaaa" * 300, "  x\x1c\x85", "don't WE'LL 'll", "\U0001f600́ 中文字", "x" * 5000, "\t\n  \n y"]
    for text, ids in zip(odd, c.encode_batch(odd), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
        assert c.decode(ids) == text
    for r in queries.queries()["op6_bpe"](spark, sf_dir).collect():
        text = docs[r["doc_id"]]["text"]
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_winnowing(spark, sf_dir, docs):
    def plain(text, k=winnowing.K, w=winnowing.W):
        if not text:
            return []
        codes = np.frombuffer((text + "\0" * (k + w)).encode("utf-32-le"), "<u4")
        h = winnowing.gram_hashes(codes, k)[: max(1, len(text) - k + 1)].tolist()
        out = []
        for s in range(max(1, len(h) - w + 1)):
            least = min(h[s : s + w])
            at = s + max(i for i, x in enumerate(h[s : s + w]) if x == least)
            if not out or out[-1][1] != at:
                out.append((least, at))
        return out

    for text, (h, p) in zip(texts := ["", "a", "ab" * 60, "x" * 300, *[r["text"][:900] for r in list(docs.values())[:30]]], winnowing.winnow(texts), strict=True):
        assert list(zip(h.tolist(), p.tolist(), strict=True)) == plain(text)
    ids = sorted(docs)
    got = {r["doc_id"]: r for r in queries.queries()["op9_winnowing"](spark, sf_dir).collect()}
    for i, nxt in zip(ids, [*ids[1:], ids[0]], strict=True):
        text, n = docs[i]["text"], len(docs[i]["text"])
        edited = text[: n - n // 4] + docs[nxt]["text"][: n // 4]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == n
        own, changed, after = ({h for h, _ in plain(t)} for t in (text, edited, docs[nxt]["text"])) if i in ids[:40] else ({int(x) for x in winnowing.winnow([t])[0][0]} for t in (text, edited, docs[nxt]["text"]))
        assert math.isclose(got[i]["near_edited"], len(own & changed) / len(own | changed)) and math.isclose(got[i]["near_next"], len(own & after) / len(own | after))
        assert {int(got[i]["fingerprint"][k : k + 16], 16) for k in range(0, len(got[i]["fingerprint"]), 24)} == own


def test_lm_scores(spark, sf_dir, docs):
    words = {i: r["text"].encode().lower().split() for i, r in docs.items()}
    one, two, three = Counter(), Counter(), Counter()
    for w in words.values():
        x = [None, None, *w]
        for a, b, c in zip(x, x[1:], x[2:], strict=False):
            one[c] += 1
            two[b, c] += 1
            three[a, b, c] += 1
    total, texts = sum(one.values()), sum(map(bool, words.values()))
    repeated = 0
    for r in queries.queries()["op3_lm_scoring"](spark, sf_dir).collect():
        w = words[r["doc_id"]]
        x, s = [None, None, *w], 0.0
        own1, own2, own3 = Counter(w), Counter(zip(x[1:], x[2:], strict=False)), Counter(zip(x, x[1:], x[2:], strict=False))
        f1 = lambda c: one[c] - own1[c] if c is not None else texts - 1  # noqa: B023, E731
        f2 = lambda b, c: two[b, c] - own2[b, c] if (b, c) != (None, None) else texts - 1  # noqa: B023, E731
        for a, b, c in zip(x, x[1:], x[2:], strict=False):
            f3 = three[a, b, c] - own3[a, b, c]
            repeated += f3 > 0
            s += math.log(f3 / f2(a, b) if f3 else 0.4 * f2(b, c) / f1(b) if f2(b, c) else 0.16 * f1(c) / (total - len(w)) if f1(c) else 0.064 / (total - len(w)))
        assert math.isclose(r["log_sum"], s, abs_tol=1e-6) and (r["n_words"], r["score"] is None) == (len(w), not w)
    assert repeated > 100


def shingles(text, k):
    w = text.encode().lower().split()
    k = min(k, len(w))
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(spark, docs, k, percent):
    rng = np.random.default_rng(3)
    base = [w for r in docs.values() for w in r["text"].split()][:4000]
    made = {}
    for g in range(12):
        text = base[g * 200 : g * 200 + 40 + 10 * g]
        for _ in range(6):
            cut = rng.integers(0, len(text), size=int(rng.integers(1, 4)))
            made[len(made)] = " ".join(w if i not in cut else f"new{rng.integers(9)}" for i, w in enumerate(text))
    made |= {1000 + i: r["text"] for i, r in docs.items()}
    sets = {i: shingles(t, k) for i, t in made.items()}
    links = [(a, b) for a, b in combinations([i for i in sets if sets[i]], 2) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    assert len(links) > 15
    expected = groups(sets, links)
    got = ngram_join.join_groups(spark.createDataFrame(list(made.items()), "doc_id bigint, text string"), k, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(s), expected[i]) for i, s in sets.items()}


@pytest.mark.parametrize("block", [5, 20, 500])
def test_linking_finds_all_groups(spark, block):
    """Long lists of near copies beside lone nodes, by a distance on the maps alone."""
    from wicker.llm import linking

    rng = np.random.default_rng(block)
    centre = rng.integers(0, 2, size=(6, 128))
    bits = [np.where(rng.random(128) < 0.02, 1 - centre[k % 6], centre[k % 6]) if k < 240 else rng.integers(0, 2, size=128) for k in range(300)]
    size = rng.integers(90, 110, size=300)
    sig = [np.packbits(x).tobytes() for x in bits]
    far = np.array([[int((x != y).sum()) for y in bits] for x in bits])
    links = [(a, b) for a, b in combinations(range(300), 2) if far[a, b] <= 6 and min(size[a], size[b]) >= 0.9 * max(size[a], size[b])]
    tokens = [(t, k) for k in range(300) for t in {0, 1 + k % 6, 10 + k % 2}]
    entries = spark.createDataFrame([(t, k, int(linking.place_of(size[k : k + 1], np.array([50]))[0])) for t, k in tokens], "token bigint, node bigint, place bigint")
    payload = spark.createDataFrame([(k, int(size[k]), bytearray(sig[k])) for k in range(300)], "node bigint, size bigint, sig binary")
    limit = lambda n, m: np.where(np.minimum(n, m) >= 0.9 * np.maximum(n, m), 6, -1)
    verify = lambda pairs: linking.stash(pairs)
    lists = linking.index_lists(entries, lambda n, m: np.ones_like(n), 0.9, block)
    firsts = linking.first_pairs(lists, payload, limit)
    now = linking.components(firsts.where("NOT opened").select("a", "b"))
    rows = linking.open_rows(lists, firsts.where("opened"), now, payload)
    cells = linking.cells_of(rows.where("part > 0"), 0.9, block)
    assert block == 500 or (cells.count() > 0 and cells.groupBy("list").agg(F.countDistinct("node").alias("n")).where(F.col("n") > 4 * block).count() == 0)
    got = {r["node"]: r["component"] for r in linking.find_groups(entries, payload, limit, lambda n, m: np.ones_like(n), verify, 0.9, block).collect()}
    expected = groups(range(300), links)
    assert len(links) > 1000 and {k: got.get(k, k) for k in range(300)} == expected


def test_chained_near_copies_cost_few_pairs(spark):
    """Copies that drift from one to the next are one group, though leaders reach few of them; pairs grow with the copies, not with their square."""
    from wicker.llm import linking

    rng = np.random.default_rng(1)
    bits = [rng.integers(0, 2, size=512)]
    for _ in range(399):
        now = bits[-1].copy()
        now[rng.choice(512, size=3, replace=False)] ^= 1
        bits.append(now)
    entries = spark.createDataFrame([(1, k, int(linking.place_of(np.array([100]), np.array([50]))[0])) for k in range(400)], "token bigint, node bigint, place bigint")
    payload = spark.createDataFrame([(k, 100, bytearray(np.packbits(x).tobytes())) for k, x in enumerate(bits)], "node bigint, size bigint, sig binary")
    asked = []

    def verify(pairs):
        asked.append(pairs.count())
        return linking.stash(pairs)

    got = linking.find_groups(entries, payload, lambda n, m: np.full(len(n), 40), lambda n, m: np.ones_like(n), verify, 0.9)
    assert {r["component"] for r in got.collect()} == {0} and got.count() == 400 and sum(asked) < 4000 and len(asked) == 3


def test_lists_with_few_pairs_are_settled_at_once(spark):
    """Forty nodes that share a token by chance, two of which are near: the one pair, and no list left open (lists of over 16 nodes were, whatever they held)."""
    from wicker.llm import linking

    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, size=(40, 128))
    bits[31] = bits[7]
    bits[31, :3] ^= 1
    entries = spark.createDataFrame([(t, k, int(linking.place_of(np.array([20]), np.array([9]))[0])) for t in (1, 2) for k in range(40) if t == 1 or k % 2], "token bigint, node bigint, place bigint")
    payload = spark.createDataFrame([(k, 20, bytearray(np.packbits(x).tobytes())) for k, x in enumerate(bits)], "node bigint, size bigint, sig binary")
    lists = linking.index_lists(entries, lambda n, m: np.ones_like(n), 0.9)
    assert sorted(len(r["nodes"]) for r in lists.collect()) == [20, 40]
    found = linking.first_pairs(lists, payload, lambda n, m: np.full(len(n), 6)).collect()
    assert [(r["a"], r["b"], r["opened"]) for r in found] == [(7, 31, False)]


def test_all_pairs_and_pairs_met_before():
    from wicker.llm.linking import FEW, all_pairs, met_before

    rng = np.random.default_rng(4)
    counts = np.array([1, 30, 2, 12, 25])
    starts = np.cumsum(counts) - counts
    bits = rng.integers(0, 2, size=(counts.sum(), 64))
    bits[31:45] = bits[31]
    bits[35] = 1 - bits[31]
    sig, size = np.packbits(bits, axis=1).view(np.uint64), np.full(len(bits), 9)
    x, y, settled = all_pairs(starts, counts, size, sig, lambda n, m: np.full(len(n), 25))
    near = [{(a, b) for a, b in combinations(range(s, s + n), 2) if (bits[a] != bits[b]).sum() <= 25} for s, n in zip(starts.tolist(), counts.tolist(), strict=True)]
    assert settled.tolist() == [len(p) <= FEW * n for p, n in zip(near, counts.tolist(), strict=True)] and not settled.all() and near[1]
    assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == sorted(p for k in np.flatnonzero(settled) for p in near[k])
    own, homes = rng.integers(0, 30, size=50), np.sort(rng.integers(0, 30, size=(50, 4)), axis=1)
    a, b = rng.integers(0, 50, size=(2, 400))
    met = met_before(a, b, own, homes).tolist()
    assert met == [any(h < own[i] for h in set(homes[i].tolist()) & set(homes[j].tolist())) for i, j in zip(a.tolist(), b.tolist(), strict=True)] and 0 < sum(met) < 400


def test_cross_pairs_skip_no_pair():
    from wicker.llm.linking import cross_pairs

    rng = np.random.default_rng(8)
    base = rng.integers(0, 2, size=(4, 64))
    bits = np.array([np.where(rng.random(64) < 0.08, 1 - base[k % 4], base[k % 4]) for k in range(80)])
    sig = np.packbits(bits, axis=1).view(np.uint64)
    size, group = rng.integers(10, 14, size=80), np.array([k % 4 if k < 60 else 100 + k for k in range(80)])
    limit = lambda n, m: np.where(np.abs(n - m) <= 2, 12, -1)
    got = {(min(a, b), max(a, b)) for x, y in cross_pairs(size, sig, group, limit) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    assert got == {(a, b) for a, b in combinations(range(80), 2) if group[a] != group[b] and abs(size[a] - size[b]) <= 2 and (bits[a] != bits[b]).sum() <= 12}


def plain_line_dedup(made):
    occurrences = [(i, k, line) for i in sorted(made) for k, line in enumerate(line_dedup.normal_lines(made[i])) if line]
    first = {}
    for i, k, line in occurrences:
        first.setdefault(tuple(line), (i, k))
    nodes = list(first)
    links = [(a, b) for a, b in combinations(range(len(nodes)), 2) if 0.8 * max(len(nodes[a]), len(nodes[b])) <= min(len(nodes[a]), len(nodes[b])) + 1e-9 and line_dedup.edit_similarity(list(nodes[a]), list(nodes[b]), 0.8) >= 0.8 - 1e-9]
    group = groups(range(len(nodes)), links)
    number, stay = {n: k for k, n in enumerate(nodes)}, {}
    for n in nodes:
        stay[group[number[n]]] = min(stay.get(group[number[n]], first[n]), first[n])
    drop = defaultdict(set)
    for i, k, line in occurrences:
        if stay[group[number[tuple(line)]]] != (i, k):
            drop[i].add(k)
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop[i]) for i, t in made.items()}, drop, links


def test_line_dedup(spark, docs):
    rng = np.random.default_rng(5)
    made = {i: r["text"] for i, r in list(docs.items())[:90]}
    for i in sorted(made)[:60]:
        lines = made[i].split("\n")
        made[1000 + i] = "\n".join(" ".join(w for k, w in enumerate(line.split()) if k != rng.integers(0, 40)) for line in lines)
    expected, _, links = plain_line_dedup(made)
    assert links
    got = line_dedup.dedup_lines(spark.createDataFrame(list(made.items()), "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == expected


def test_pipeline_against_plain_stages(spark, docs, tmp_path):
    """run() against plain versions of line dedup, n-gram join, mixing and encoding; which documents language ID keeps comes from the operator, which its own tests hold."""
    import duckdb
    from tokenizers import Tokenizer

    import corpus_pipeline

    rows = [tuple(r) for r in list(docs.values())[:50]]
    names = next(iter(docs.values())).__fields__
    text, id_, length = names.index("text"), names.index("doc_id"), names.index("n_chars")
    for k in range(8):
        row = list(rows[k])
        words = row[text].split(" ")
        row[text], row[id_] = " ".join(words[:3] + ["changed"] + words[4:]), 10_000 + k
        rows.append(tuple(row))
    odd = list(rows[0])
    odd[text], odd[id_] = "12 34 ...", 20_000
    rows.append(tuple(odd))
    schema = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema
    frame = spark.createDataFrame([tuple(r) for r in rows], schema)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    now = {r["doc_id"]: list(r) for r in corpus_pipeline.language_id(spark, frame, "").collect()}
    assert 20_000 not in now and len(now) >= 50
    texts, drop, _ = plain_line_dedup({i: r[text] for i, r in now.items()})
    texts = {i: t for i, t in texts.items() if not (drop[i] and not t.strip())}
    assert any(drop.values())
    sets = {i: shingles(t, 5) for i, t in texts.items()}
    links = [(a, b) for a, b in combinations([i for i in sets if sets[i]], 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    group = groups(sets, links)
    kept = [now[i][:text] + [texts[i]] + now[i][text + 1 :] for i in texts if group[i] == i]
    mixed = spark.createDataFrame([tuple(r) for r in kept], schema).toPandas()
    con = duckdb.connect()
    con.register("documents", mixed)
    taken = {i: (size, n) for i, size, n in con.sql(f"SELECT doc_id, size, taken FROM ({queries.oracle_sql()['op7_mixing']})").fetchall()}
    library = Tokenizer.from_file(bpe.vocabulary_path())
    expected = Counter()
    for i, (size, n) in taken.items():
        if n:
            expected[i, tuple(library.encode(texts[i], add_special_tokens=False).ids), True] += n // size
    got = Counter((r["doc_id"], tuple(r["ids"]), r["round_trip"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == expected and sum(got.values()) > 50


@pytest.mark.parametrize("similarity", [0.6, 0.8])
def test_line_dedup_finds_all_alike_lines(spark, docs, similarity):
    rng = np.random.default_rng(6)
    base = [line for r in docs.values() for line in line_dedup.normal_lines(r["text"]) if len(line) >= 5]
    lines = []
    for n in [5, 6, 9, 10, 11, 14, 15, 20, 40, 80] * 4:
        line = [w.decode() for w in base[len(lines)]] * 20
        lines.append(line[:n])
        for _ in range(3):
            copy = lines[-1][:]
            for _ in range(rng.integers(1, max(2, n // 5 + 1))):
                at, kind = rng.integers(len(copy)), rng.integers(3)
                copy[at : at + (kind != 0)] = [] if kind == 1 else [f"new{rng.integers(99)}"]
            lines.append(copy)
    nodes = list(dict.fromkeys(map(tuple, lines)))
    links = [(a, b) for a, b in combinations(range(len(nodes)), 2) if line_dedup.edit_similarity(list(nodes[a]), list(nodes[b]), similarity) >= similarity - 1e-9]
    assert len(links) > 100
    group = groups(range(len(nodes)), links)
    kept = {i for i, n in enumerate(nodes) if group[i] == i}
    got = line_dedup.dedup_lines(spark.createDataFrame([(i, " ".join(n)) for i, n in enumerate(nodes)], "doc_id bigint, text string"), similarity).collect()
    assert {r["doc_id"] for r in got if not r["n_dropped"]} == kept


def test_edit_similarity():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = (rng.choice(list("abc"), size=rng.integers(1, 14)).tolist() for _ in range(2))
        exact = 1 - plain(a, b) / max(len(a), len(b))
        got = line_dedup.edit_similarity(a, b, 0.5)
        assert abs(got - exact) < 1e-9 if exact >= 0.5 - 1e-9 else got < 0.5


def test_embeddings(spark):
    sf = "/root/testdata/sf0.01"
    rng = np.random.default_rng(0)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    rows += [(10_000 + 50 * k + j, (np.array(rows[k][1]) + rng.normal(size=64) * 0.02).tolist(), rows[k][2]) for k in range(8) for j in range(30)]
    from wicker.llm.embedding_dedup import near_duplicates

    v = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    ids, label = [r[0] for r in rows], np.array([r[2] for r in rows])
    cos = v @ v.T / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1))
    link = (cos >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(len(v), dtype=bool)
    expected = dict(zip(ids, link.sum(axis=1).tolist(), strict=True))
    got = {r["vec_id"]: r for r in near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()}
    assert all(got[i]["n_links"] <= n for i, n in expected.items()) and sum(r["n_links"] for r in got.values()) >= 0.9 * sum(expected.values()) > 0
    assert {i: r["component_id"] for i, r in got.items()} == groups(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(link), strict=True)])


@pytest.mark.parametrize("vectors, least", [(1_000, 0.99), (50_000, 0.97), (40_000_000, 0.93)])
def test_pivot_lists_grow_with_the_vectors(vectors, least):
    """Pairs at a cosine of exactly 0.98 share a list, with the pivots of a table of this size; lists get no longer."""
    from wicker.llm import embedding_dedup as e

    rng = np.random.default_rng(1)
    one, away = rng.normal(size=(2, 2000, 64))
    one = e.unit(one)
    away = e.unit(away - (away * one).sum(axis=1, keepdims=True) * one)
    pivots = e.draw_pivots(rng.normal(size=(max(e.LEAST_SAMPLE, e.SAMPLE_RATE * e.pivot_count(vectors)), 64)).tolist(), e.pivot_count(vectors))[64]
    assert len(pivots) == e.pivot_count(vectors) == round(3 * vectors ** (1 / 3))
    near, other = e.describe(one, pivots), e.describe(0.98 * one + np.sqrt(1 - 0.98**2) * away, pivots)
    by_sort = np.argsort(-(one @ pivots.T), axis=1, kind="stable")[:, : e.NEAREST]
    assert (near == by_sort).all()
    a, b = e.lists_of(near), e.lists_of(other)
    assert np.mean((a[:, :, None] == b[:, None, :]).any(axis=(1, 2))) >= least
    assert a.shape[1] == len(e.TRIOS) == 10 and all(len(set(row)) == 10 for row in a[:50].tolist())


def test_pairs_count_in_their_first_list():
    from wicker.llm import embedding_dedup as e

    rng = np.random.default_rng(3)
    nearest = np.array([rng.permutation(9)[: e.NEAREST] for _ in range(80)])
    lists, link = e.lists_of(nearest), np.ones((80, 80), dtype=bool)
    np.fill_diagonal(link, False)
    found = np.zeros((80, 80), dtype=int)
    for trio in np.unique(lists).tolist():
        own = np.flatnonzero((lists == trio).any(axis=1))
        found[np.ix_(own, own)] += e.elsewhere(link[np.ix_(own, own)], lists[own], trio)
    share = (lists[:, None, :, None] == lists[None, :, None, :]).any(axis=(2, 3))
    assert (found == (share & link)).all()


def test_mixing_against_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    expected = {r[0]: r[1:] for r in con.sql(queries.oracle_sql()["op7_mixing"]).fetchall()}
    got = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in queries.queries()["op7_mixing"](spark, sf).collect()}
    assert got == expected


def test_pairs_across_come_from_one_list_each(spark):
    """Lone nodes within the limit that share twelve lists, some of them long: each pair is written once, not once a list and pair of blocks, and no pair is lost."""
    from wicker.llm import linking

    count, block = 90, 20
    bits = np.zeros((count, 64), dtype=np.uint8)
    bits[np.arange(count), np.arange(count) % 60] = 1
    members = {t: [k for k in range(count) if t < 4 or k % 3 == t % 3] for t in range(12)}
    rows = spark.createDataFrame([(t, int(t < 4), k, 20, k) for t, ks in members.items() for k in ks], "list bigint, part int, node bigint, size bigint, group bigint")
    payload = spark.createDataFrame([(k, 20, bytearray(np.packbits(x).tobytes())) for k, x in enumerate(bits)], "node bigint, size bigint, sig binary")
    given = spark.sparkContext.accumulator(0)

    def choose(*of):
        for x, y in linking.cross_pairs(*of):
            given.add(len(x))
            yield x, y

    found = linking.pairs_across(rows, payload, lambda n, m: np.full(len(n), 64), 0.9, block, choose)
    assert {(r["a"], r["b"]) for r in found.collect()} == set(combinations(range(count), 2)) and given.value == count * (count - 1) // 2


def test_lesser_lists_meet_where_rows_share_one():
    from wicker.llm.linking import lesser_lists

    rng = np.random.default_rng(4)
    homes = np.sort(rng.integers(0, 400, size=(70, 9)), axis=1)
    bits = lesser_lists(250, homes)
    for i, j in combinations(range(70), 2):
        assert bool((bits[i] & bits[j]).any()) == any(h < 250 for h in set(homes[i].tolist()) & set(homes[j].tolist()))


def test_block_of_trigrams_stays_small():
    """A block's n-grams are numbered rightly in at most 96 bytes a word at once (114 before)."""
    import tracemalloc

    from wicker.llm.lm_scoring import Block

    h, counts = np.random.default_rng(0).zipf(1.3, size=200_000).astype(np.uint64), np.full(200, 1000)
    tracemalloc.start()
    block = Block.of_hashes(h, counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 96 * len(h)
    of = np.array([-1, *block.words.tolist()], dtype=np.int64)
    pair = block.pairs[block.pair_at]
    triple = block.triples[block.triple_at]
    for k in (0, 1, 2, 999, 1000, 1001, 5002, 199_999):
        at = k % 1000
        a, b, c = (int(h[k - d]) if at >= d else -1 for d in (2, 1, 0))
        assert (of[triple[k] % block.n], of[pair[k] // block.n], of[pair[k] % block.n]) == (a, b, c) and block.pairs[triple[k] // block.n] == pair[k]
    assert int(block.uses.sum()) == len(h)


def test_requests_under_any_code_book():
    """Counts are the same under any code book, which makes requests a third smaller (0.71 MB here, 1.21 before); answering holds at most 64 bytes a trigram at once (35 here, 82 before)."""
    import tracemalloc

    from wicker.llm.common import mix
    from wicker.llm.lm_scoring import NO_WORDS, Block, answer, read_counts, split

    number = np.random.default_rng(1).zipf(1.3, size=400_000).astype(np.uint64) % np.uint64(50_000)
    h, counts = mix(number), np.full(400, 1000)
    book = np.r_[NO_WORDS, mix(np.arange(3, 20_000, dtype=np.uint64))]
    found, sizes = [], []
    for own in (NO_WORDS, book):
        block = Block.of_hashes(h, counts, own)
        back = Block.of_stored(block.stored(own), own)
        assert (back.words == block.words).all() and (back.number == block.number).all() and (back.triples == block.triples).all()
        part, every = block.parts(4)[0], np.arange(len(block.words))
        uses = np.bincount(block.number, minlength=len(block.hash_of))[1:]
        mine = [np.flatnonzero(part == k) for k in range(4)]
        requests = [block.request(m, every[:0] if k else every, uses, own) for k, m in enumerate(mine)]
        sizes.append(sum(map(len, requests)))
        tracemalloc.start()
        answers = answer(requests, own)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 64 * len(block.triples) + (1 << 20)
        by_pair = np.bincount(block.triples // block.n, weights=block.uses)
        for k, m in enumerate(mine):
            third, second, words = (read_counts(x, n) for x, n in zip(split(answers[k]), (len(m), len(m), 0 if k else len(every)), strict=True))
            assert (third == block.uses[m]).all() and (second == by_pair[block.triples[m] // block.n]).all() and (k or (words == uses).all())
        found.append(dict(zip(block.words.tolist(), uses.tolist(), strict=True)))
    assert found[0] == found[1] and sizes[1] < 0.8 * sizes[0]


def test_later_links_join_groups(spark):
    """Groups after more links are those of all links together, and what changed is named for every node and component that a link touches."""
    from wicker.llm import linking

    draw = np.random.default_rng(3)
    edges = [[(int(a), int(b)) for a, b in draw.integers(0, 400, (n, 2)) if a != b] for n in (150, 40)]
    tables = [spark.createDataFrame(e + e[:5], "a bigint, b bigint") for e in edges]
    plain = {}
    for a, b in edges[0] + edges[1]:
        low, high = sorted((plain.get(a, a), plain.get(b, b)))
        plain.update({x: low for x in (a, b, *[x for x, c in plain.items() if c in (low, high)])})
    after, changes = linking.joined_groups(linking.stash(linking.components(tables[0])), tables[1])
    assert {r["node"]: r["component"] for r in after.collect()} == plain and after.count() == len(plain)
    named = {r["node"]: r["component"] for r in changes.collect()}
    assert all(plain[x] == c for x, c in named.items()) and {x for e in edges[1] for x in e} <= set(named)


def test_few_jobs_for_marks(spark):
    """A small bit map of ids takes a few jobs, not one for each partition; a path of 65 nodes is one group."""
    from wicker.llm import common, linking

    def jobs(name, run):
        spark.sparkContext.setJobGroup(name, name)
        try:
            return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        (held, _), n = jobs("marks", lambda: common.id_marks(spark.range(0, 5000, 1, 4)))
        assert n < 12 and int(np.bitwise_count(held.value).sum()) > 4500
        found = linking.components(spark.createDataFrame([(k, k + 1) for k in range(64)], "a bigint, b bigint"))
        assert {(r["node"], r["component"]) for r in found.collect()} == {(k, 0) for k in range(65)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
