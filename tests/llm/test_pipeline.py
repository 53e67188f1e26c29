"""The pipeline's stages: each works on what its predecessor kept, and its decisions take effect."""

import hashlib
import random
import re

import corpus_pipeline
import pytest
from tarnflow.llm import decontaminate, exact, toxicity
from tarnflow.llm.common import stored, table


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns, kept = docs.columns, docs
    labels, bench = table(spark, sf, "labels"), table(spark, sf, "benchmark")
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = stored(stage(spark, before, sf), name)
        if name == "encoding":
            assert ids(kept) == ids(before)
            assert all(len(r.ids) == r.n_tokens and sha(" ".join(map(str, r.ids))) == r.ids_sha256 for r in kept.collect())
            continue
        assert kept.columns == columns
        rows = {r.doc_id: r.text for r in before.collect()}
        if name == "toxicity":
            want = [r.doc_id for r in toxicity.toxicity(before, labels).collect() if not r.predicted]
        elif name == "exact_dedup":
            best = {}
            for d, t in rows.items():
                k = re.sub(r"[\x20\x09-\x0D]", "", t or "")
                best[k] = min(best.get(k, (0, 1 << 62)), (-len(t or ""), d)) if k in best else (-len(t or ""), d)
            want = [d for _, d in best.values()]
        elif name == "near_dedup":
            want = brute_near(list(rows.items()))
        else:
            bad = {r.doc_id for r in decontaminate.contaminated(before, bench).collect()}
            want = [d for d in rows if d not in bad]
        assert ids(kept) == sorted(want)
    assert ids(corpus_pipeline.run(spark, sf)) == ids(kept)


def test_hard_rows(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "one text", "en", "s", 8), (3, "one text", "en", "s", 8), (None, "no id", "en", "s", 5), (4, "word " * 50_000, "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, sf), name)
        assert set(docs.columns) >= {"doc_id", "n_tokens"}
        assert {r.doc_id for r in docs.collect()} == ({1, 3, 4, None} if data else set())


def test_exact_stage_with_repeated_ids(spark):
    rows = [(3, "one text"), (3, "one text"), (3, "onetext"), (3, "another"), (1, "an other"), (None, "x"), (None, "x"), (None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in exact.drop_copies(docs).collect()), key=str)
    assert got == sorted([(3, "one text"), (1, "an other"), (None, "x"), (None, "y")], key=str)


def test_exact_stage_keeps_one(spark):
    docs = spark.createDataFrame([(5, "a b"), (2, "ab"), (9, "a  b")], "doc_id long, text string")
    assert ids(exact.drop_copies(docs)) == [9]


def brute_near(rows):
    """The rows that stay when texts with five-word Jaccard similarity 0.8 or more are linked."""

    def words_of(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return frozenset(zip(*(w[i:] for i in range(5)))) or frozenset([tuple(w)] if w else [])

    sets = [words_of(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both)) and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return sorted(d for k, (d, _) in enumerate(rows) if d == min(rows[m][0] for m in range(len(rows)) if root[m] == root[k]))


def test_near_stage_against_brute_force(spark, sf):
    """Pairs at every similarity around the bound, a chain, a common passage, short texts and the test documents."""
    rng = random.Random(5)
    word = [f"w{i}" for i in range(4000)]
    rows = []
    common = rng.choices(word, k=40)
    for n in (3, 5, 8, 9, 12, 30, 120, 600):
        for _ in range(4):
            base = rng.choices(word, k=n)
            rows.append(base)
            for changes in range(1, 7):
                other = list(base)
                for _ in range(changes):
                    other[rng.randrange(n)] = rng.choice(word)
                rows += [other, base + rng.choices(word, k=changes * max(1, n // 20))]
    rows += [common + rng.choices(word, k=k % 25) for k in range(60)]
    chain = rng.choices(word, k=100)
    for k in range(12):
        rows.append(list(chain))
        chain[k * 8] = "x"
    rng.shuffle(rows)
    texts = [(k, " ".join(r)) for k, r in enumerate(rows)] + [(5000, "  "), (5001, None)]
    texts += [(10_000 + r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = ids(corpus_pipeline.near_dedup_stage(spark, docs.repartition(3), sf))
    assert got == brute_near(texts)
    assert len(got) < len(texts) - 100


def pairs_compared(monkeypatch, docs):
    """(how many rows stay, how many pairs were compared by their texts)"""
    from tarnflow.llm import near

    counts, keep = [], near.stored

    def stored_(df, name):
        out = keep(df, name)
        if name in ("stars", "pairs"):
            counts.append(out.count())
        return out

    monkeypatch.setattr(near, "stored", stored_)
    return near.drop_near_copies(docs).count(), sum(counts)


@pytest.mark.parametrize("n", [500, 2000])
def test_pairs_of_unlike_texts(spark, monkeypatch, n):
    """Texts of 12 out of 20 fixed sentences share many shingles, rare ones too, but hardly a pair is near."""
    rng = random.Random(9)
    sentences = [" ".join(rng.choices([f"w{i}" for i in range(900)], k=10)) for _ in range(20)]
    docs = spark.createDataFrame([(i, " ".join(rng.sample(sentences, 12))) for i in range(n)], "doc_id long, text string")
    kept, pairs = pairs_compared(monkeypatch, docs)
    assert kept == n and pairs <= 8 * n


def test_pairs_of_a_large_group_of_near_copies(spark, monkeypatch):
    """Copies with changes of their own link to most others; comparisons stay in proportion to their number."""
    rng = random.Random(10)
    base = rng.choices([f"w{i}" for i in range(900)], k=200)
    rows = []
    for i in range(800):
        other = list(base)
        for _ in range(rng.randrange(1, 5)):
            other[rng.randrange(200)] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(other)))
    kept, pairs = pairs_compared(monkeypatch, spark.createDataFrame(rows, "doc_id long, text string"))
    assert kept == 1 and pairs <= 30 * 800


def test_near_stage_links_by_simhash_pivots(spark, sf, monkeypatch):
    """The stage's first pairs come from SimHash and pivot tables; what these miss is found all the same."""
    from tarnflow.llm import near

    rng = random.Random(11)
    texts = []
    for _ in range(30):
        base = rng.choices([f"w{i}" for i in range(4000)], k=300)
        near_by, far = list(base), list(base)
        near_by[7] = "x"
        for at in range(5, 300, 60):
            far[at] = "y"
        texts += [base, near_by, far]
    texts = [(k, " ".join(t)) for k, t in enumerate(texts)]
    seen, links = [], near.pivot_links

    def pivot_links_(nodes, *args):
        out = near.stored(links(nodes, *args), "seen")
        seen.append(({r.rep: r.fp for r in nodes.collect()}, {frozenset(r) for r in out.collect()}))
        return out

    monkeypatch.setattr(near, "pivot_links", pivot_links_)
    got = ids(corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(texts, "doc_id long, text string"), sf))
    assert got == brute_near(texts) == list(range(0, 90, 3))
    (prints, pairs), sets = seen[0], [near.shingles(t) for _, t in texts]
    fp = {near.key_of(s): near.majority(s) for s in sets}
    assert all(p % (1 << 64) == fp[k] for k, p in prints.items())
    assert all((fp[a] ^ fp[b]).bit_count() <= near.RADIUS for a, b in pairs)
    assert sum(frozenset(map(near.key_of, sets[k : k + 2])) in pairs for k in range(0, 90, 3)) >= 15


def test_sketches_lose_no_pair():
    """A pair that the bound leaves out differs in more shingles than a similar one may."""
    import numpy as np

    from tarnflow.llm import near

    rng = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**64, int(rng.integers(1, 3000)), np.uint64))
        b = np.unique(np.append(a[rng.random(len(a)) > rng.random() * 0.3], rng.integers(0, 2**64, int(rng.integers(0, 300)), np.uint64)))
        apart = np.bitwise_count(np.frombuffer(near.sketch(a), np.uint64) ^ np.frombuffer(near.sketch(b), np.uint64)).sum()
        assert apart <= len(np.setxor1d(a, b))
        assert not near.similar(a, b) or 9 * apart <= len(a) + len(b)


def test_what_a_forest_settles_meets_once(spark, monkeypatch):
    """Texts that share rare shingles, none near: nothing is left to meet a second time."""
    from tarnflow.llm import near

    rng = random.Random(12)
    sentences = [" ".join(rng.choices([f"w{i}" for i in range(900)], k=10)) for _ in range(20)]
    rows = [(i, " ".join(rng.sample(sentences, 6))) for i in range(200)]
    counts, keep = [], near.stored

    def stored_(df, name):
        out = keep(df, name)
        if name == "unsettled":
            counts.append(out.count())
        return out

    monkeypatch.setattr(near, "stored", stored_)
    assert sorted(r.doc_id for r in near.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute_near(rows)
    assert len(counts) == 2 and counts[0] > 200 and counts[1] < counts[0] / 2


def test_shingles_of_many_texts():
    """Texts worked on together have the shingles, fingerprints and sketches that each has alone."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    from tarnflow.llm import near
    from tarnflow.llm.simhash import majority

    rng = random.Random(13)
    texts = ["", " \t\n", "a", " A  b\x0b", "a b c d", "a b c d e", "É\x1c\xa0é b c d e f", "x " * 9000, *(" ".join(rng.choices(["w", "V", "É", "x9"], k=k)) for k in range(40)), ""]
    sets = near.Shingles(pa.array(texts))
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
        w = min(5, len(words))
        want = set()
        for run in zip(*(words[k:] for k in range(w))):
            h = w
            for word in run:
                h = (h ^ xxhash.xxh64_intdigest(word)) * 0x9E3779B97F4A7C15 % 2**64
                h = (h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % 2**64
                h ^= h >> 32
            want.add(h)
        assert sets[i].tolist() == sorted(want) == near.shingles(t).tolist()
    assert sets.fingerprints().tolist() == [majority(sets[i]) for i in range(len(texts))]
    assert sets.sketches() == [near.sketch(sets[i]) for i in range(len(texts))]
    long = near.Shingles(pa.array([" ".join(f"w{k}" for k in range(n)) for n in (258, 259, 260, 514, 515, 3000)]))
    assert long.fingerprints().tolist() == [majority(long[i]) for i in range(len(long))]
    assert (long.counts() == sum(np.bincount(long[i] % near.BINS, minlength=near.BINS) for i in range(len(long)))).all()


@pytest.mark.parametrize("forest", [False, True])
def test_groups_that_meet_together(monkeypatch, forest):
    """Groups at once give the pairs that each gives alone, and tell where the forest leaves something out."""
    import numpy as np

    from tarnflow.llm import near

    rng = np.random.default_rng(14)
    for small in (512, 15):
        monkeypatch.setattr(near, "SMALL", small)
        monkeypatch.setattr(near, "AT_ONCE", 50)
        n = rng.integers(2, 30, 25)
        m, base = int(n.sum()), np.repeat(rng.integers(0, 2**64, (25, 16), np.uint64), n, axis=0)
        own, key, label, size, at = (rng.integers(lo, hi, m) for lo, hi in ((0, 2), (0, 10**6), (0, 6), (100, 140), (0, 15)))
        bits = base ^ (rng.integers(0, 2**64, (m, 16), np.uint64) & np.where(rng.random((m, 16)) < 0.06, np.uint64(2**64 - 1), np.uint64(0)))
        split, cut = rng.random(25) < 0.5, np.cumsum(n)[:-1]
        left, right, more = near.pairs_of_groups(n, split, own, key, label, size, at, bits, forest)
        each = list(zip(*(np.split(x, cut) for x in (own, key, label, size, at, bits))))
        alone = [near.pairs_between((0, int(two)), *x, forest) for two, x in zip(split, each)]
        every = [near.pairs_between((0, int(two)), *x, False) for two, x in zip(split, each)]
        assert sorted(zip(left.tolist(), right.tolist())) == sorted((a, b) for x in alone for a, b in zip(x[0].tolist(), x[1].tolist()))
        assert len(left) > 20 and all(more[g] or len(alone[g][0]) == len(every[g][0]) for g in range(25))


def test_workers_drop_the_coder_before_near_dedup():
    import public_tokenizers
    from tarnflow.llm import bpe, near

    bpe.coder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert list(near.leaving_none(near.in_slices)(iter([]))) == [] and bpe.coder.cache_info().currsize == 0
