from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from kvloom.llm import components as comp
from kvloom.llm import simhash as sh
from kvloom.llm.common import materialize
from kvloom.llm.components import components
from kvloom.llm.near_dedup import NearJoin, near_dedup


def brute(rows, distance=3, size=3):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fps = {}
    for i, t in rows:
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", (t or "").translate(low)) if x]
        s = [" ".join(w[k : k + size]) for k in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
        votes = [sum(xxhash.xxh64_intdigest(x.encode(), 42) >> b & 1 for x in s) for b in range(64)]
        fps[i] = sum(1 << b for b in range(64) if 2 * votes[b] > len(s))
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (format(f, "016x"), find(i)) for i, f in fps.items()}


def near_copies(rng, n_bases, copies, words=120, edits=2):
    vocabulary = [f"w{i}" for i in range(900)]
    rows, i = [], 0
    for _ in range(n_bases):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(copies):
            text = base[:]
            for _ in range(rng.randrange(edits + 1)):
                text[rng.randrange(words)] = rng.choice(vocabulary)
            rows.append((i, " ".join(text)))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [8192, 3])
def test_components_match_brute_force(make_docs, chunk):
    rows = near_copies(random.Random(3), 12, 6) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "One two"), (1004, "one TWO"), (1005, "İ ı É é"), (1006, "x " * 20_000)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in sh.simhash_groups(make_docs(rows).repartition(4), chunk=chunk).collect()}
    assert got == brute(rows)


def test_blocks_cover_every_close_pair():
    rng = random.Random(4)
    masks = [m & (1 << 64) - 1 for m in sh.block_masks(64, 6, 3)]
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for _ in range(rng.randrange(4)):
            b ^= 1 << rng.randrange(64)
        assert any(a & m == b & m for m in masks)


def test_walk_links_what_is_reachable():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 5, (200, 1)).astype(np.uint64)
    links = [(a, int(b)) for a, found in sh.walk(words, 1) for b in found]
    assert len(links) < len(words)
    assert all(bin(int(words[a, 0] ^ words[b, 0])).count("1") <= 1 for a, b in links)
    assert len(links) == 199  # all values of five bits are one component


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(200, 200), (301, 300), (300, 301)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(51)) and all(got[i] == 100 for i in range(100, 160)) and got[301] == 300 and 200 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_settled_links_take_no_round(spark, monkeypatch):
    """Stars around their smallest nodes are written once; a chain takes rounds, but none that only finds that nothing changes."""
    written = []
    monkeypatch.setattr(comp, "materialize", lambda df, tag: written.append(tag) or materialize(df, tag))
    stars = [(1, 5), (1, 9), (7, 1), (2, 3), (4, 4)]
    assert dict(components(spark.createDataFrame(stars, "a long, b long")).collect()) == {1: 1, 5: 1, 9: 1, 7: 1, 2: 2, 3: 2}
    assert len(written) == 1
    assert dict(components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")).collect()) == {1: 1, 2: 1, 3: 1}
    assert len(written) == 3


def test_empty_and_string_ids(make_docs, spark):
    assert sh.simhash_groups(make_docs([])).count() == 0
    assert near_dedup(make_docs([])).count() == 0
    docs = spark.createDataFrame([("b", "same text here now", 1), ("a", "same text here now", 2), (None, "same text here now", 3)], "doc_id string, text string, fp long")
    assert {r.component_id for r in sh.simhash_groups(docs).collect()} == {"a"}
    assert [r.fp for r in near_dedup(docs).collect()] == [2]


@pytest.mark.parametrize("chunk", [8192, 4])
def test_near_dedup_keeps_one_of_each_group(make_docs, chunk):
    rows = near_copies(random.Random(6), 20, 5, words=300, edits=3) + [(1000 + i, t) for i, t in enumerate(["", "a", "a b c", "a b d", "a b c d e f", "a b c d e g"])]
    kept = {r.doc_id for r in near_dedup(make_docs(rows).repartition(3), hot=chunk, piece_bytes=4000).collect()}
    assert kept == {i for i in range(100) if i % 5 == 0} | set(range(1000, 1006))


def similarity(a, b, size=5):
    sets = [{tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.mark.parametrize("chunk", [8192, 3])
def test_near_dedup_is_exact_at_every_length(make_docs, chunk):
    """One word appended to 8 to 20 words, and words changed in longer texts, on either side of 0.8."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    pairs = []
    for n in [*range(8, 21), 24, 29, 60, 150, 400]:
        for _ in range(6):
            base = [word() for _ in range(n)]
            pairs.append((" ".join(base), " ".join([*base, word()])))
            cut = base[:]
            for _ in range(max(1, n // 45)):
                cut[rng.randrange(n)] = word()
            pairs.append((" ".join(base + base[:3]), " ".join(cut)))
    pairs.append((" ".join(f"a{i}" for i in range(16)), " ".join(f"a{i}" for i in range(19))))  # 12 of 15: 0.8 itself
    rows = [(2 * i + j, t) for i, pair in enumerate(pairs) for j, t in enumerate(pair)]
    kept = {r.doc_id for r in near_dedup(make_docs(rows).repartition(3), hot=chunk, piece_bytes=4000).collect()}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    texts = dict(rows)
    for a in texts:
        for b in range(a + 1, min(len(rows), a + 13)):
            if 5 * round(similarity(texts[a], texts[b]) * 1e9) >= 4e9:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert kept == {i for i in parent if find(i) == i}
    assert 0 < sum(find(i) != i for i in parent) < len(pairs)


@pytest.mark.parametrize("hot", [1 << 20, 5])
def test_near_dedup_of_large_groups_and_common_passages(make_docs, hot):
    """Against all pairs: a large group of near copies, chains, a common passage, repeats, empty texts and null ids."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(800)}"
    passage = [word() for _ in range(30)]
    base = [word() for _ in range(60)]
    rows: list = [(None, " ".join(base)), (900, None), (901, ""), (902, " "), (903, "one two"), (904, "One  Two")]
    for _ in range(60):
        t = base[:]
        for _ in range(rng.randrange(3)):
            t[rng.randrange(60)] = word()
        rows.append((len(rows), " ".join(t)))
    chain = [word() for _ in range(50)]
    for _ in range(15):
        chain[rng.randrange(50)] = word()
        rows.append((len(rows), " ".join(chain)))
    for _ in range(30):
        rows.append((len(rows), " ".join([word() for _ in range(rng.randrange(4, 12))] + passage[: rng.randrange(20, 31)])))
    rows += [(len(rows) + i, rows[10 + i][1]) for i in range(5)]
    kept = sorted((-1 if r.doc_id is None else r.doc_id) for r in near_dedup(make_docs(rows).repartition(4), hot=hot, piece_bytes=2000).collect())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if similarity(rows[a][1] or "", rows[b][1] or "") >= 0.8 - 1e-9:
                parent[find(a)] = find(b)
    groups: dict = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append((i is None, -1 if i is None else i))
    assert kept == sorted(min(g)[1] for g in groups.values())
    assert len(kept) < len(rows) - 60


def test_near_dedup_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(2, "a b c d e f", "x", 5), (1, "a b c d e f", "y", 6)], "doc_id long, text string, uid string, home long")
    out = near_dedup(docs)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(1, "a b c d e f", "y", 6)]


@pytest.mark.parametrize("chunk", [8192, 3])
def test_pairs_span_the_components(make_docs, chunk):
    rows = near_copies(random.Random(5), 8, 5) + [(1000, None), (1001, ""), (1002, "One two"), (1003, "one TWO")]
    pairs = [(r.x, r.y) for r in sh.simhash_pairs(make_docs(rows).repartition(3), chunk=chunk).collect()]
    group = {i: i for i, _ in rows}
    for a, b in pairs:
        group = {i: group[a] if g == group[b] else g for i, g in group.items()}
    low = {g: min(i for i in group if group[i] == g) for g in group.values()}
    assert {i: low[g] for i, g in group.items()} == {i: c for i, (_, c) in brute(rows).items()}
    assert all(a < b for a, b in pairs) and len(pairs) < 2 * len(rows)


def test_near_dedup_finds_by_fingerprints_and_decides_on_sets(make_docs, monkeypatch):
    """Equal fingerprints with few shingles in common stay apart; near copies are linked by fingerprints alone where these are close."""
    words = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    often = "a b c " * 500
    far = [(1, often + words("x", 40)), (2, often + words("y", 40))]
    near = [(10 + i, words("z", 300) + f" end{i}") for i in range(4)]
    join = NearJoin(make_docs(far + near).repartition(1), "doc_id", "text", 5, 80, 2 << 20, 1 << 20)
    ids = {r.uid: r.id for r in join.state.select("uid", "id").collect()}
    pairs = {frozenset((ids[r.x], ids[r.y])) for r in join.close().collect()}
    assert frozenset((1, 2)) in pairs and len(pairs) >= 4
    assert {r.doc_id for r in near_dedup(make_docs(far + near)).collect()} == {1, 2, 10}
    monkeypatch.setattr(NearJoin, "met", lambda self, files, *a, **k: files.select(files.uid.alias("x"), files.uid.alias("y")).limit(0))
    assert {r.doc_id for r in near_dedup(make_docs(far + near)).collect()} == {1, 2, 10}
