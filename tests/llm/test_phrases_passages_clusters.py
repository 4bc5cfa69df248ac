"""Phrase mining, passage removal and centroid clustering against brute force; odd, skewed and empty input."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF
from tillcast.llm import mean_ordered_kmeans as km
from tillcast.llm import phrase_mining as pm
from tillcast.llm import suffix_dedup as sd
from tillcast.llm.deep_shallow import BlindTrie, equal_classes

def with_clashes(df):
    return df.withColumns({"n": F.lit(1), "bin": F.lit(2), "route": F.lit("x"), "cover": F.lit(None).cast("int"), "kb": F.lit(3), "a.b": F.lit("dot")})


# ------------------------------------------------------------------ phrases
def brute_phrases(rows, min_count=10, top=2000):
    f = defaultdict(Counter)
    n = Counter()
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(table)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        best = []
        for p, a in cand.items():
            score, k = min(((1000000 * a * a) // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            longer = [b for q, b in cand.items() if len(q) == 3 and len(p) == 2 and p in (q[:2], q[1:])]
            if not any(100 * b >= 50 * a for b in longer):
                best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for i, (score, a, p, l, r) in enumerate(sorted(best)[:top], 1):
            out.append((lang, i, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def test_last_pass_sends_bins_and_counts_every_phrase(monkeypatch):
    """The phrases of a bin leave a task as one compressed row, in the same sums however often a task sends."""
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefgh", k=9)) for _ in range(300)]
    rows = [(rnd.choice(["en", "und"]), " ".join(rnd.choices(words, k=400))) for _ in range(60)]
    want = Counter()
    for lang, text in rows:
        w = text.split(" ")
        want[lang, 0, ""] += len(w)
        for k in (1, 2, 3):
            want.update((lang, k, " ".join(w[i:i + k])) for i in range(len(w) - k + 1))
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["lang", "text"])
    every = [np.full(pm.BITS // 8, 255, np.uint8) for _ in range(3)]
    for held in (1 << 20, 1000):
        monkeypatch.setattr(pm, "HELD_ROWS", held)
        sent = list(pm.phrase_counter(every, 8, 1 << 15)(iter([batch])))
        assert held == 1000 or (sum(b.num_rows for b in sent) == 8 and sum(b.nbytes for b in sent) < 25 * len(want))
        table = pa.Table.from_batches(sent).sort_by("bin")
        got = pa.Table.from_batches(pm.phrase_sums(1)(iter(table.to_batches()))).to_pylist()
        assert {(r["lang"], r["size"], r["phrase"]): r["n"] for r in got} == want and len(got) == len(want)
        few = pa.Table.from_batches(pm.phrase_sums(3)(iter(table.to_batches()))).to_pylist()
        assert {(r["lang"], r["size"], r["phrase"]) for r in few} == {k for k, n in want.items() if n >= 3 or not k[1]}


def mined(df, **options):
    got = pm.collocations(*pm.frequent_phrases(df, **options))
    return sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def _texts(seed, n=120):
    rnd = random.Random(seed)
    vocab = ["Red", "fox", "jumps", "über", "the", "the", "THE", "lazy", "dog", "x", "ää", "new", "york", "city"]
    rows = []
    for i in range(n):
        t = "".join(rnd.choice(vocab) + rnd.choice([" ", " ", "  ", "\t", ". ", ",", "\n", ":"]) for _ in range(rnd.randint(0, 60)))
        rows.append((rnd.choice(["en", "de", None, "und"]), t + (" New York city" if i % 3 else "")))
    return rows + [("en", None), ("fr", ""), ("fr", "  \t . "), ("en", "solo")]


@pytest.mark.parametrize("options", [{}, {"block": 300}, {"sample": 0.02}, {"sample": 1.0}])
def test_phrases_equal_brute_force(ready, options):
    rows = _texts(1)
    df = with_clashes(ready.createDataFrame(rows, "lang string, text string").withColumn("doc_id", F.lit(None).cast("long")))
    assert mined(df, **options) == brute_phrases(rows)


def test_phrases_of_a_third_hot_rows_and_a_piece_longer_than_a_block(ready):
    rows = _texts(2) + [("en", "one very common passage of words " * 3)] * 60 + [("de", "la li lo " * 4000)]
    df = ready.createDataFrame(rows, "lang string, text string").withColumn("doc_id", F.lit(1))
    assert mined(df, block=5000) == brute_phrases(rows)


def test_phrases_with_a_failing_sample_take_more_passes(ready, monkeypatch):
    """Nothing is proposed at first: words, then pairs, then triples come from border failures."""
    passes = []
    real = pm.hashed_bitmaps

    def counted(texts, now, before, least, bins, block):
        if now is None:
            return [np.zeros(pm.BITS // 8, np.uint8) for _ in range(3)]
        passes.append(1)
        return real(texts, now, before, least, bins, block)

    monkeypatch.setattr(pm, "hashed_bitmaps", counted)
    rows = _texts(3)
    assert mined(ready.createDataFrame(rows, "lang string, text string")) == brute_phrases(rows)
    assert len(passes) >= 3


def test_phrases_of_odd_and_empty_tables(ready, odd, nothing):
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert mined(odd) == brute_phrases(rows)
    assert mined(nothing) == []


def test_scores_pass_64_bits(ready):
    big = 40_000_000_000
    found = ready.createDataFrame([("en", 1, "a", big + 7), ("en", 1, "b", big + 3), ("en", 2, "a b", big)], "lang string, size int, phrase string, n long")
    total = ready.createDataFrame([("en", 3 * big)], "lang string, n_words long")
    r = pm.collocations(found, total).collect()
    assert [x["score"] for x in r] == [1000000 * big * big // ((big + 7) * (big + 3))]


# ------------------------------------------------------------------ passages
def brute_passages(rows, width=100):
    """Per row (doc_id, n_bytes, removed, spans, digest); rows in order of id, null last; no id has two texts."""
    out, seen = [], set()
    for doc_id, raw in sorted(((d, (t or "").encode()) for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0)):
        cov, last = bytearray(len(raw)), 0
        for p in range(len(raw) - width + 1):
            w = raw[p:p + width]
            if w in seen:
                a = max(p, last)
                cov[a:p + width] = b"\1" * (p + width - a)
                last = p + width
            else:
                seen.add(w)
        kept = bytes(x for x, c in zip(raw, cov) if not c)
        spans = sum(1 for i, c in enumerate(cov) if c and (i == 0 or not cov[i - 1]))
        out.append((doc_id, len(raw), sum(cov), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def cut(df, **options):
    got = sd.without_repeats(df, **options).collect()
    for r in got:
        assert all(s["start"] < s["stop"] for s in r["spans"])
        assert all(a["stop"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))
    return sorted(((r["doc_id"], r["n_bytes"], sum(s["stop"] - s["start"] for s in r["spans"]), len(r["spans"]),
                    hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got), key=repr)


def _passages(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 8)))
    passages = [" ".join(word() for _ in range(rnd.randint(10, 80))) for _ in range(6)]
    rows, texts = [], []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 40))) for _ in range(3)]
        for _ in range(rnd.randint(0, 3)):
            parts.insert(rnd.randint(0, 3), rnd.choice(passages))
        t = rnd.choice(texts) if texts and i % 7 == 0 else " ".join(parts)
        texts.append(t)
        rows.append((i * 7 % n, t))
    rows += [(1000, "a" * 700), (1001, "ab" * 300 + "a" * 99), (1002, passages[0][:99]), (1003, passages[0][:100]), (1004, None), (1005, "")]
    rows += [(None, " ".join(passages[:2])), (1006, passages[1] * 5)]
    return rows


@pytest.mark.parametrize("options", [{}, {"block": 500}, {"hot": 2}, {"hot": 3, "block": 700, "chunk": 8}, {"chunk": 4}])
def test_passages_equal_brute_force(ready, options):
    rows = _passages(4)
    df = with_clashes(ready.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert cut(df, **options) == brute_passages(rows)


def test_passages_of_hot_copies_and_one_passage_in_all_rows(ready):
    rnd = random.Random(8)
    shared = " ".join(str(rnd.random()) for _ in range(20))
    rows = [(i, f"{rnd.random()} {rnd.random()} {shared} {rnd.random()} {rnd.random()}") for i in range(150)]
    rows += [(200 + i, shared * 2) for i in range(80)]
    df = ready.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute_passages(rows)
    assert cut(df) == want and cut(df, hot=10, chunk=16) == want


def test_passages_of_repeated_rows_and_empty_tables(ready, odd, nothing):
    long = "x y z " * 50
    df = ready.createDataFrame([(1, long), (1, long), (1, long), (None, "q" * 120), (None, "q" * 120), (2, "short"), (2, "short")], "doc_id long, text string")
    got = Counter((d, removed) for d, _, removed, _, _ in cut(df))
    assert got[1, 300] == 2 and got[None, 120] == 1 and got[2, 0] == 2
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert cut(odd) == brute_passages(rows)
    assert cut(nothing) == []


def test_passage_query_equals_brute_force(ready):
    rows = [(r["doc_id"], r["text"]) for r in ready.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r) for r in sd.op12_repeated_passages(ready, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=repr) == brute_passages(rows)


def test_blind_trie_sorts_and_groups():
    rnd = random.Random(0)
    strings = ["".join(rnd.choice("ab") for _ in range(12)).encode() for _ in range(500)]
    trie = BlindTrie(strings[0], 0)
    for i, s in enumerate(strings[1:], 1):
        trie.add(s, i)
    leaves = list(trie.leaves())
    assert [x.string for x in leaves] == sorted(set(strings))
    assert sorted(i for x in leaves for i in x.members) == list(range(500))
    assert all(strings[i] == x.string for x in leaves for i in x.members)


@pytest.mark.parametrize("shallow", [0, 8, 16])
def test_equal_classes(shallow):
    rng = np.random.default_rng(3)
    text = np.r_[rng.integers(0, 2, 3000), np.tile(rng.integers(0, 2, 40), 50), np.zeros(8)].astype(np.uint8)
    at = rng.integers(0, 4900, 2500)
    group = rng.integers(0, 3, 2500)
    length = np.array([20, 40, 60])[group]
    cls = equal_classes(text, at, length, group, shallow)
    raw = text.tobytes()
    key = [(int(g), raw[a:a + n]) for a, n, g in zip(at, length, group)]
    stand = {}
    for k, c in zip(key, cls.tolist()):
        assert stand.setdefault(k, c) == c and key[c] == k


# ------------------------------------------------------------------ clusters
def brute_clusters(vectors, centroids=16, rounds=3):
    """``vectors``: list of (vec_id, integer list), ids distinct."""
    order = sorted(vectors, key=lambda v: hashlib.sha256(f"1:{v[0]}".encode()).hexdigest())
    c = [list(v) for _, v in order[:centroids]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min(range(len(c)), key=lambda i: (dist(v, c[i]), i))
    for _ in range(rounds):
        got = defaultdict(list)
        for _, v in vectors:
            got[near(v)].append(v)
        c = [[sum(x) // len(got[i]) for x in zip(*got[i])] if got[i] else c[i] for i in range(len(c))]
    rows = [(i, near(v), dist(v, c[near(v)])) for i, v in vectors]
    inertia = Counter()
    for _, k, d in rows:
        inertia[k] += d
    return sorted((i, k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for i, k, d in rows)


def clustered(df, **options):
    got = km.with_inertia(*km.mean_ordered_kmeans(df, **options))
    return sorted(tuple(r) for r in got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def test_clusters_with_ties_and_unkept_vectors(ready):
    rnd = random.Random(6)
    good = [(i, [float(rnd.choice([-1.0, 0.0, 0.25, 0.5, 3.0])) for _ in range(64)]) for i in range(90)]
    good += [(100 + i, good[0][1]) for i in range(45)]  # a third are one vector
    bad = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [1.0] * 63 + [None]),
           (905, [float("nan")] + [0.0] * 63), (906, [float("inf")] + [0.0] * 63), (907, [0.0] * 63 + [float("-inf")])]
    df = with_clashes(ready.createDataFrame(good + bad, "vec_id long, embedding array<float>").repartition(4)).withColumns({"v": F.lit(1), "x": F.lit(2)})
    want = brute_clusters([(i, [int(np.floor(64 * x)) for x in v]) for i, v in good])
    assert clustered(df) == want


def test_clusters_of_wide_values_are_exact(ready):
    rnd = random.Random(7)
    rows = [(i, [rnd.choice([1e4, -3e5, 0.1, 5e3]) * rnd.random() for _ in range(64)]) for i in range(40)]
    df = ready.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert clustered(df) == brute_clusters([(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows])
    # beyond 64 bits: no distance, no crash
    far = ready.createDataFrame([(1, [1e16] * 64), (2, [-1e16] * 64), (3, [0.0] * 64)], "vec_id long, embedding array<double>")
    got, c = km.mean_ordered_kmeans(far, clusters=1)
    rows = km.with_inertia(got, c).collect()
    assert len(rows) == 3 and {r["inertia"] for r in rows} == {None}


def test_clusters_of_few_repeated_and_no_rows(ready):
    v = [0.5] * 64
    df = ready.createDataFrame([(1, v), (1, v), (None, v), (2, [1.0] * 64)], "vec_id long, embedding array<float>")
    got = km.with_inertia(*km.mean_ordered_kmeans(df)).collect()
    assert len(got) == 4 and {r["distance"] for r in got} == {0} and {r["inertia"] for r in got} == {0}
    assert clustered(df.limit(0)) == []


def test_search_equals_full_search():
    rng = np.random.default_rng(2)
    for wide in (50, 1 << 22, 1 << 40):
        c = rng.integers(-wide, wide, (16, 64)).tolist()
        c[5] = list(c[3])                       # a tie of centroids
        c[9] = c[2][::-1]                       # the same mean and deviation
        x = np.concatenate([rng.integers(-wide, wide, (300, 64)), np.array(c)])
        found, best = km.MeanOrdered(c).search(x.astype(object) if wide > km.NARROW else x)
        full = [[sum((a - b) ** 2 for a, b in zip(v, k)) for k in c] for v in x.tolist()]
        assert found.tolist() == [min(range(16), key=lambda i: (d[i], i)) for d in full]
        assert [int(b) for b in best] == [min(d) for d in full]
