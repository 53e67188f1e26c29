"""Importance resampling, mixing and the manifest against brute force, on the small tables and on hard rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tarnflow.llm import importance, manifest, mixing, queries
from tarnflow.llm.common import table
from tarnflow.llm.numbering import numbered

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, number int, grp string, digest string, size double, path int"
LONG = "".join(f"Word{i % 977} " for i in range(60_000))


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like the operators' own."""
    texts = [None, "", " \n\t", "a", "A b C d " * 6, "a b c d " * 6, LONG, LONG, "héé ﬁ 日本語 ½² 🙂 " * 9, "x\x00y z" * 20, "=" * 700, "ab" * 3000]
    rows = [(i, t, "en", [None, "s", "S", "", "ü"][i % 5], 0, 1, "x", "d", 2.0, 3) for i, t in enumerate(texts)]
    rows += [rows[4], (None, "B b " * 30, None, None, None, None, None, None, None, None), (-(2**40), "B b " * 30, None, "s", 1, 1, "x", "d", 0.5, 3)]
    rows += [(100 + i, f"one two {i} " * (i % 4), None, "hot", i, 1, "x", "d", 0.5, 3) for i in range(300)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module", params=["hard", "sf"])
def docs(request, spark, sf, hard):
    return hard if request.param == "hard" else table(spark, sf, "documents")


@pytest.mark.parametrize("name", ["op11_importance", "op12_mixture", "op13_manifest"])
def test_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want, got = db.sql(queries.ORACLE_SQL[name]), queries.QUERIES[name](spark, sf)
    order = sorted(want.columns)
    assert order == sorted(got.columns)
    assert sorted(tuple(r[c] for c in order) for r in got.collect()) == sorted(tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall())


def test_numbered(spark):
    rows = [(f"g{i % 3 if i % 4 else 0}", i * 7 % 50) for i in range(1000)]
    got = numbered(spark.createDataFrame(rows, "g string, x int").repartition(5), "g", [F.desc("x")]).collect()
    by = defaultdict(list)
    for g, x in rows:
        by[g].append(x)
    for g, xs in by.items():
        mine = sorted((r.number, r.x, r.of) for r in got if r.g == g)
        assert mine == [(i, x, len(xs)) for i, x in enumerate(sorted(xs, reverse=True))]


# ---- importance resampling


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_runs(text, longest):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("longest", [1, 3])
def test_features_in_parts(monkeypatch, longest):
    text = "Über 日本 a-b-c " * 40 + "d"
    want = Counter(zlib.crc32(f.encode()) % 97 for f in brute_runs(text, longest))
    for chunk in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(importance, "CHUNK", chunk)
        assert Counter(x for some in importance.features(text.encode(), longest, 97) for x in some.tolist()) == want
    assert not list(importance.features(b"", longest, 97))


@pytest.mark.parametrize("longest", [1, 2])
def test_resampled(spark, sf, docs, longest):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    target = table(spark, sf, "benchmark")
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(zlib.crc32(f.encode()) % 10000 for f in brute_runs(text, longest))
    for r in target.collect():
        t.update(zlib.crc32(f.encode()) % 10000 for f in brute_runs(r.text, longest))
    n_s, n_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = [math.floor(1000 * math.log((t[b] + 1) * n_s / ((s[b] + 1) * n_t))) for b in range(10000)]
    want = []
    for d, text in rows:
        f = [zlib.crc32(x.encode()) % 10000 for x in brute_runs(text, longest)]
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        want.append((d, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((-x[4], x[0] is not None, x[0] or 0) for x in want if x[1] >= 20)
    drawn = able[: len(able) * 10 // 100]
    got = importance.resampled(docs, target, longest=longest).collect()
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=str) == sorted(((d, n, w, s_) for d, _, n, w, s_ in want), key=str)
    assert sorted((r["rank"], -r.score, r.doc_id is not None, r.doc_id or 0) for r in got if r["rank"]) == [(i + 1, *x) for i, x in enumerate(drawn)]


def test_resampled_empty(spark, sf, hard):
    assert importance.resampled(hard.where("false"), table(spark, sf, "benchmark")).count() == 0
    assert importance.resampled(hard, hard.where("false")).count() == hard.count()


# ---- mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, sum(sizes.values()), set(order)
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: float(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over


def test_mixture(docs):
    mixed = mixing.mixture(docs)
    got = mixed.collect()
    size = Counter()
    for r in docs.select("doc_id", "text", "source").collect():
        size[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    target = brute_targets(size)
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source], rel=1e-12)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert len(got) == docs.count()
    for s in size:
        assert abs(taken[s] - target[s]) <= 5 * mixing.BLOCK
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mixture(docs.repartition(5)).collect()))


def test_mixture_over_many_shards(docs):
    """Quotas by shard keep the targets, and other seeds take other documents."""
    got = mixing.mixture(docs, block=4, shard_words=500).collect()
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target, r.source_size
    for s, (t, n) in target.items():
        assert abs(taken[s] - t) <= 4 * 4 * (n / 500 + 1)
    assert {(r.doc_id, r.taken) for r in got} != {(r.doc_id, r.taken) for r in mixing.mixture(docs, block=4, shard_words=500, seed=8).collect()}


def test_highest_quotients(spark):
    rows = [("a", i, float(v), 53) for i, v in enumerate([1, 1, 7, 300, 12, 0, 12, 900, 3])] + [("b", i, 2.0, 7) for i in range(20)] + [("c", 0, 5.0, 4), ("d", 0, 0.0, 0)] + [("e", i, 1000.0 if i else 1e6, 3000) for i in range(400)]
    got = {(r.grp, r.key): r.quota for r in mixing.apportioned(spark.createDataFrame(rows, "grp string, key int, votes double, seats long"), "key").collect()}
    for g in "abcde":
        claims = [(k, v) for grp, k, v, _ in rows if grp == g]
        seats = next(s for grp, _, _, s in rows if grp == g)
        ranked = sorted((-v / (2 * k + 1), key) for key, v in claims for k in range(seats) if v)[:seats]
        want = Counter(key for _, key in ranked)
        assert {k: got[g, k] for k, _ in claims} == {k: want[k] for k, _ in claims}


def test_mixture_empty(hard):
    assert mixing.mixture(hard.where("false")).count() == 0
    wordless = mixing.mixture(hard.where("text IS NULL OR trim(text) = ''"))
    assert wordless.count() and not wordless.where("taken <> 0 OR target <> 0").count()


# ---- manifest


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_leaf(r, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def brute_tree(digests, fan):
    """(top, for each leaf its runs as (ahead, behind) up to the top)."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // fan * fan : k // fan * fan + fan]
            paths[i].append(("".join(run[: k % fan]), "".join(run[k % fan + 1 :])))
            at[i] = k // fan
        level = [sha("".join(level[k : k + fan])) for k in range(0, len(level), fan)]
    return level[0], paths


@pytest.mark.parametrize("fan", [2, 16])
def test_manifest(docs, fan):
    by = defaultdict(list)
    for r in docs.collect():
        struck = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.text is not None
        changed = re.sub("[A-Z]", lambda m: m.group().lower(), r.text) if struck else r.text
        by[r.source].append((r.doc_id is not None, r.doc_id or 0, brute_leaf(r, r.text), brute_leaf(r, changed), r.doc_id))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([x[2] for x in sorted(by[s])], fan) for s in order}
    root, upper = brute_tree([trees[s][0] for s in order], fan)
    want = []
    for i, s in enumerate(order):
        for (_, _, leaf, given, d), path in zip(sorted(by[s]), trees[s][1]):
            acc, path = given, path + upper[i]
            for ahead, behind in path:
                acc = sha(ahead + acc + behind)
            want.append((d, leaf, trees[s][0], root, sha("".join(a + b for a, b in path)), acc, acc == root))
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = [tuple(r[c] for c in cols) for r in manifest.manifest_digests(docs, fan).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {x[-1] for x in want} == {True, False}


def test_manifest_small(hard):
    assert manifest.manifest_digests(hard.where("false")).count() == 0
    one = manifest.manifest_digests(hard.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root == one[0].folded_root and one[0].proof_sha256 == sha("")
