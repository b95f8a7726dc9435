"""Embedding near-dedup, phrase collocations and centroid clustering against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa

from pulsegrid.llm import clustering, collocations, embedding_dedup

VECTORS = "vec_id long, embedding array<float>, label int"


# -- 11 ------------------------------------------------------------------------------------------------------------


def brute_links(rows, threshold=0.98):
    """n_links and component of each vec_id, of rows whose ids are unique."""
    def usable(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    own = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in rows if usable(v) and lab is not None]
    near = collections.defaultdict(set)
    for i, a, x in own:
        for j, b, y in own:
            if i != j and x == y and len(a) == len(b) and a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= threshold:
                near[i].add(j)
    root = {i: i for i, *_ in rows}
    changed = True
    while changed:
        changed = False
        for i in near:
            least = min([root[i], *(root[j] for j in near[i])])
            changed |= least < root[i]
            root[i] = least
    return {i: (len(near[i]), root[i]) for i, *_ in rows}


def around(r, centre, cosine):
    """A vector at the given cosine from a centre of length one."""
    other = r.standard_normal(len(centre))
    other -= other @ centre * centre
    return (cosine * centre + math.sqrt(1 - cosine**2) * other / np.linalg.norm(other)) * r.uniform(0.5, 3)


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    r = np.random.default_rng(2)
    rows = []
    for group in range(12):  # links just above and just below the threshold
        centre = r.standard_normal(64)
        centre /= np.linalg.norm(centre)
        rows.append((centre, group % 3))
        rows += [(around(r, centre, c), group % 3) for c in (0.9801, 0.9805, 0.979, 0.9799, 0.985, 0.9995)]
    dense = r.standard_normal(64)
    dense /= np.linalg.norm(dense)
    rows += [(around(r, dense, r.uniform(0.985, 0.999)), 1) for _ in range(120)]  # one large group, four blocks
    rows += [(r.standard_normal(64), int(r.integers(3))) for _ in range(200)]
    rows += [(rows[0][0], 0), (rows[0][0], 1), (2 * rows[1][0], 0), (r.standard_normal(7), 0), (np.array([1.0]), 0), (np.array([3.0]), 0), (np.array([-1.0]), 0)]
    rows = [(i, [float(x) for x in v.astype(np.float32)], label) for i, (v, label) in enumerate(rows)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 64, 0), (n + 2, [0.0] * 64, 0), (n + 3, [float("nan")] + [1.0] * 63, 0), (n + 4, [None] + [1.0] * 63, 0), (n + 5, [], 0), (n + 6, rows[0][1], None), (n + 7, rows[0][1], None), (n + 8, [float("inf")] * 64, 0), (n + 9, [3e38] * 64, 0), (n + 10, [2e38] * 64, 0)]
    random.Random(4).shuffle(rows)
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(out) == len(rows)
    assert {x.vec_id: (x.n_links, x.component_id) for x in out} == brute_links(rows)
    assert all(x.kept == (x.vec_id == x.component_id) for x in out)


def test_near_duplicates_of_repeated_rows(spark):
    v, w = [1.0, 2.0, 3.0], [1.0, 2.0, 3.01]
    rows = [(5, v, 1), (5, v, 1), (3, w, 1), (5, w, 1), (None, v, 1), (9, [-1.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame([(*x, "own") for x in rows], VECTORS + ", n_links string")
    out = sorted(((x.vec_id or 0, x.n_links, x.component_id, x.kept) for x in embedding_dedup.near_duplicates(df).collect()), key=str)
    # rows of one vec_id are one node; the two vectors of 5 are linked with 3, and by it with each other
    assert [x[0] for x in out] == [0, 3, 5, 5, 5, 9]
    assert out[0] == (0, 0, None, None) and out[1][2:] == (3, True) and all(x[2:] == (3, False) for x in out[2:5]) and out[5] == (9, 0, 9, True)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_no_link_is_lost_between_the_stages():
    """Pairs at the threshold share a key, differ in few bits, and their bound reaches the threshold."""
    r = np.random.default_rng(8)
    a = embedding_dedup.unit(r.standard_normal((4000, 64)))
    b = embedding_dedup.unit(np.stack([around(r, x, 0.9801) for x in a]))
    (ca, _), (cb, fb) = embedding_dedup.codes(a), embedding_dedup.codes(b)
    for largest in (10, 5000, 10**7, 10**11):
        tables, most = embedding_dedup.plan(largest)
        keys = embedding_dedup._keys(ca, tables) == embedding_dedup._keys(cb, tables)
        assert keys.any(axis=1).all()
    assert (np.unpackbits(ca ^ cb, axis=1).sum(axis=1) <= most).all()
    at = slice(0, 300)
    guess, room = embedding_dedup.estimates(a[at], b[at], fb[at], cb[at])
    assert (np.diag(guess) + room >= 0.98).all()
    other = ~np.eye(300, dtype=bool)
    assert (guess + room[None] >= 0.98)[other].mean() < 0.001
    assert abs((guess - a[at] @ b[at].T)[other].mean()) < 0.005  # unbiased


# -- 12 ------------------------------------------------------------------------------------------------------------

LOWER = {i: i + 32 for i in range(65, 91)}


def brute_collocations(rows, least=100, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        many = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        inside = collections.Counter()
        for p, a in many.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        found = []
        for p, a in many.items():
            if inside[p] < a:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def test_collocations_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MOST", 20)
    monkeypatch.setattr(collocations, "BUFFER", 4096)
    r = random.Random(6)
    words = ["the", "New", "york", "é", " x", "\x00", "\x1c", "É", "a'b", "-", "日本", "of", "B"]
    text = lambda n: "".join(r.choice(words) + r.choice([" "] * 12 + ["\t", "  ", ". ", ",", "\n", "\x0b", "!?"]) for _ in range(n))
    rows = [(text(r.randint(0, 60)), r.choice(["en", "en", "fr", None, "und", "x\ny"])) for _ in range(150)]
    rows += [("same words again and again " * 40, "en"), ("x " * 3000, "de"), ("x y " * 300 + text(3000), "es"), (None, "en"), ("", None), (" .,.\n", "en")] + [("a passage that many texts share", "en")] * 30
    df = spark.createDataFrame([(t, lang, 1, "p") for t, lang in rows], "text string, lang string, n long, phrase string")
    for least, top in ((5, 2000), (30, 7)):
        out = collocations.collocations(df.repartition(5), least, top)
        assert sorted(map(tuple, out.collect())) == brute_collocations(rows, least, top)
    assert collocations.collocations(df).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert collocations.collocations(df.limit(0)).count() == 0


def test_chunks_cover_each_phrase_once():
    r = random.Random(9)
    texts = [" ".join(r.choice(["u", "v", "w", "."]) if r.random() < 0.9 else str(r.random()) for _ in range(n)).encode() for n in (0, 1, 3, 500, 5000)] + [b"z " * 5000]
    found, last, at = collocations.chunks_of(texts)
    counts, want = collections.Counter(), collections.Counter()
    for chunk, end, doc in zip(found, last, at):
        w = chunk.split()
        counts.update((doc, *w[i : i + 5]) for i in range(len(w) - 4))
        assert len(w) <= collocations.MOST + collocations.OVERLAP and (end or len(w) > collocations.OVERLAP)
    for doc, text in enumerate(texts):
        for piece in text.replace(b"0.", b"0 . ").split(b"."):
            w = piece.split()
            want.update((doc, *w[i : i + 5]) for i in range(len(w) - 4))
    assert counts == want


def test_exact_scores_beyond_64_bits(spark):
    table = pa.table({"lang": ["en"] * 2, "chunk": ["a b", "b"], "last": [True, True], "times": [10**13, 10**14]})
    rows = {x["key"].removeprefix("en\n"): x["times"] for batch in collocations._phrases(table, (1, 2), None) for x in batch.to_pylist()}
    assert rows == {"a": 10**13, "b": 10**13 + 10**14, "a b": 10**13}
    a, n, left, right = 10**13, 3 * 10**14, 10**13 + 7, 10**14 + 3
    got = spark.sql(f"SELECT cast(1000 as decimal(4,0)) * cast({a}L as decimal(15,0)) * cast({n}L as decimal(19,0)) div (cast({left}L as decimal(19,0)) * cast({right}L as decimal(19,0))) AS s").first().s
    assert got == 1000 * a * n // (left * right)


# -- 13 ------------------------------------------------------------------------------------------------------------


def brute_clusters(rows, k=16, rounds=3, dims=64):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, _, v in sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), i, v) for i, v in kept)[:k]]

    def place(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, m)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        at = [place(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), a in zip(kept, at) if a == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *place(v)[::-1]) for i, v in kept]
    each = collections.Counter()
    for _, j, d in found:
        each[j] += d
    return sorted((i, j, d, each[j], sum(each.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in found)


def test_clusters_against_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in (r.standard_normal(64) * r.choice([0.02, 0.2, 5])).astype(np.float32)]) for i in range(300)]
    rows += [(i, [float(r.integers(2))] * 64) for i in range(300, 360)]  # ties and equal centroids
    rows += [(7, rows[7][1]), (8, rows[9][1]), (400, None), (401, [1.0] * 63), (402, [1.0] * 65), (403, [None] + [1.0] * 63), (404, [float("nan")] * 64), (405, [float("-inf")] * 64), (None, [1.0] * 64), (406, [])]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, distance int").repartition(6)
    assert sorted(map(tuple, clustering.cluster(df).collect())) == brute_clusters(rows)
    few = [x for x in rows if x[0] in (1, 2, 301)]
    assert sorted(map(tuple, clustering.cluster(spark.createDataFrame(few, "vec_id long, embedding array<float>")).collect())) == brute_clusters(few)
    assert clustering.cluster(df.limit(0)).collect() == []


def test_tree_finds_the_nearest_of_ties():
    r = np.random.default_rng(5)
    for k in (1, 2, 5, 16, 60):
        centroids = r.integers(-3, 4, (k, 4))
        centroids[k // 2] = centroids[0]
        vectors = r.integers(-4, 5, (500, 4))
        number, distance = clustering.Tree(centroids).nearest(vectors)
        every = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
        assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    far = np.array([[(1 << 27) - 1] * 64, [-(1 << 27) + 1] * 64])
    assert clustering.Tree(far).nearest(far[:1])[1][0] == 0 and int(((far[0] - far[1]) ** 2).sum()) == clustering.Tree(far[1:]).nearest(far[:1])[1][0]
