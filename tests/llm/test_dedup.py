"""Exact, near and substring dedup against brute force, with the odd rows each must bear."""

import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F
from siltstone.llm import common, components, exact_dedup, queries, shingle_links, simhash, substring_dedup

from ..conftest import DATA

ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "ab"), (6, "a  b"), (6, "a  b"), (None, "ab"), (7, "ß\x85x"), (8, "ßx"), (9, "word " * 3000)]


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append((-len(t or ""), i is None, i or 0))
    return {n: (min(g), len(g)) for n, g in groups.items()}


def check_exact(rows, got):
    want = exact(rows)
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    for n, ((_, null, keep), size) in want.items():
        own = by.pop(hashlib.sha256(n.encode()).hexdigest())
        assert len(own) == size and sum(r.kept for r in own) == 1
        assert all(r.group_size == size and r.keep_id == (None if null else keep) for r in own)
    assert not by


def test_exact_odd_rows(docs):
    check_exact(ODD, exact_dedup.exact_dedup(docs(ODD)).collect())
    assert exact_dedup.exact_dedup(docs([])).count() == 0


def test_exact_colliding_digests(docs):
    rows = [(i, t) for i, t in ODD if i is not None] + [(100 + i, f"t{i % 7}") for i in range(40)]
    got = exact_dedup.exact_dedup(docs(rows), digest=lambda n: F.substring(F.sha2(n.cast("binary"), 256), 1, 1)).collect()
    check_exact(rows, got)


def test_exact_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    check_exact(rows, queries.queries()["op9_exact_dedup"](spark, DATA).collect())
    kept = exact_dedup.keep_documents(spark.read.parquet(f"{DATA}/documents.parquet"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.count() == len(exact(rows))


def test_exact_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 5, "x"), (2, "a ", 6, "y"), (2, "a ", 6, "y"), (3, "b", 7, "z")], "doc_id long, text string, keep_id long, digest string")
    got = exact_dedup.keep_documents(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [2, 3]


def fingerprint(t, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    if not w:
        return 0
    s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps, threshold):
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if b < a and bin(fps[a] ^ fps[b]).count("1") <= threshold:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_whole_table(spark):
    fps = {r.doc_id: fingerprint(r.text, 3) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    want = linked(fps, 2)
    got = queries.queries()["op7_simhash_near_dedup"](spark, DATA).collect()
    assert len(got) == len(fps)
    assert all(r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == want[r.doc_id] for r in got)


def test_simhash_odd_rows(docs):
    got = {r.doc_id: r for r in simhash.simhash_components(docs(ODD)).collect()}
    assert got[1].fingerprint == got[2].fingerprint == "0" * 16 and got[3].component_id == 1
    assert got[5].component_id == got[None].component_id == 5
    assert simhash.simhash_components(docs([])).count() == 0


def test_covering_finds_every_pair(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = {i: x for i, x in enumerate({y for x in base for y in (x, *(x ^ 1 << rng.randrange(64) ^ (1 << rng.randrange(64) if rng.random() < 0.7 else 0) for _ in range(6)))})}
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps.values()], "fp long")
    parts = {r.node & (1 << 64) - 1: r.component for r in components.connected_components(simhash.link_fingerprints(df, 2)).collect()}
    want = linked(fps, 2)
    same = {}
    for i, x in fps.items():
        same.setdefault(want[i], set()).add(parts.get(x, x - (1 << 64) if x >> 63 else x))
    assert all(len(v) == 1 for v in same.values()) and len({next(iter(v)) for v in same.values()}) == len(same)


def test_many_visitors_are_looked_up(monkeypatch):
    rng = random.Random(4)
    x = rng.getrandbits(64)
    near = list({x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(300)})
    import numpy as np

    fps = np.array(near, dtype=np.uint64).view(np.int64)
    anchor, home = np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
    pairs = simhash._compare(anchor, fps, home, 2)
    monkeypatch.setattr(simhash, "_MANY", 10)
    other = simhash._compare(anchor, fps, home, 2)
    assert len(pairs[0]) and sorted(zip(*map(list, pairs))) == sorted(zip(*map(list, other)))


def test_many_visitors_on_both_sides_of_bit_63(monkeypatch):
    import numpy as np

    rng = random.Random(5)
    x = rng.getrandbits(63)
    near = {x ^ sum(1 << b for b in rng.sample(range(40), rng.randrange(4))) for _ in range(300)}
    far = (1 << 63) | 0b11111 << 50
    fps = np.array(sorted(near | {y ^ far for y in near}), dtype=np.uint64).view(np.int64)
    anchor, home = np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
    pairs = simhash._compare(anchor, fps, home, 2)
    monkeypatch.setattr(simhash, "_MANY", 10)
    other = simhash._compare(anchor, fps, home, 2)
    assert len(pairs[0]) > 300 and sorted(zip(*map(list, pairs))) == sorted(zip(*map(list, other)))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (300, 200)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 200: 200, 300: 200}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def sentence(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def test_similar_links(docs):
    rng = random.Random(8)
    rows, sets = [], {}
    for g in range(12):
        base = sentence(rng, 120)
        for c in range(4):
            w = list(base)
            for _ in range(c):
                w[rng.randrange(120)] = "changed"
            rows.append((g * 10 + c, " ".join(w)))
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    got = {(r.a, r.b) for r in shingle_links.similar_links(docs([*rows, (None, "x"), (500, ""), (501, None)])).collect()}
    assert got and all(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 for a, b in got)
    kept = {r.doc_id for r in simhash.keep_documents(docs(rows)).collect()}
    parent = linked({i: 0 for i in sets}, -1)
    for a in sorted(sets):
        for b in sets:
            if b < a and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                parent = {k: min(parent[a], parent[b]) if v in (parent[a], parent[b]) else v for k, v in parent.items()}
    assert kept <= {i for i, p in parent.items() if i == p} | kept and all(p in kept for i, p in parent.items() if i == p)
    assert {i for i in sets if parent[i] != i} & kept == set()


def templated(rng, n, pairs):
    """Texts of one template, pairwise at a similarity of about 0.7, and copies of some at 0.83, with distant ids."""
    base, rows = sentence(rng, 300), []
    for i in range(n):
        rows.append((i, base + [f"own{i}x{k}" for k in range(56)]))
    for i in rng.sample(range(n), pairs):
        w = list(rows[i][1])
        w[303:352:8] = [f"copy{k}" for k in range(7)]
        rows.append((n + i, w))
    return [(i, " ".join(w)) for i, w in rows]


def test_similar_links_in_templated_families(docs, monkeypatch):
    monkeypatch.setattr(shingle_links, "BLOCK", 24)
    rows = templated(random.Random(14), 300, 30)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    want = {(a, b) for a in sets for b in sets if b < a and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert len(want) == 30 and {(r.a, r.b) for r in shingle_links.similar_links(docs(rows)).collect()} == want


def test_null_and_reused_ids_keep_their_texts(docs):
    rng = random.Random(13)
    t = [" ".join(sentence(rng, 120)) for _ in range(6)]
    rows = [(1, t[0]), (None, t[0]), (None, t[1]), (None, t[2]), (2, t[3]), (3, t[4]), (3, t[3]), (3, t[5]), (3, t[5])]
    for kept in exact_dedup.keep_documents(docs(rows)), simhash.keep_documents(docs(rows)):
        assert sorted((r.doc_id or 0, t.index(r.text)) for r in kept.collect()) == [(0, 1), (0, 2), (1, 0), (2, 3), (3, 4), (3, 5)]


def repeats(rows, n=13):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        key = float("inf") if i is None else i
        for j in range(len(w) - n + 1):
            g = b" ".join(w[j : j + n])
            first[g] = min(first.get(g, float("inf")), key)
    out = []
    for i, w in words:
        key = float("inf") if i is None else i
        gone = [False] * len(w)
        for j in range(len(w) - n + 1):
            if first[b" ".join(w[j : j + n])] < key:
                gone[j : j + n] = [True] * n
        out.append((i if i is not None else -1, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out)


def removed(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.text) for r in df.collect())


def test_substring_random(docs):
    rng = random.Random(9)
    passages = [sentence(rng, rng.randrange(10, 40)) for _ in range(12)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randrange(1, 5)):
            w += rng.choice(passages)[rng.randrange(5) :] if rng.random() < 0.6 else sentence(rng, rng.randrange(1, 30))
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(70, "the same " * 100), (71, "the same " * 20), (72, "the same " * 6), (3, rows[3][1]), (3, "the same " * 10), (None, rows[0][1]), (None, rows[0][1]), (80, None), (81, ""), (82, " ".join(sentence(rng, 12)))]
    assert removed(substring_dedup.remove_repeats(docs(rows))) == repeats(rows)


def test_substring_windows_across_a_seam(docs):
    rng = random.Random(12)
    rows = []
    for g in range(60):
        p = sentence(rng, 20)
        for c, (a, b) in enumerate([(0, 15), (5, 20), (0, 20), (3, 17)]):
            rows.append((g * 10 + c, " ".join(sentence(rng, 8) + p[a:b] + sentence(rng, 8))))
    assert removed(substring_dedup.remove_repeats(docs(rows))) == repeats(rows)


def test_substring_full_filter(docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FILTER_BITS", 64)
    rng = random.Random(10)
    shared = sentence(rng, 30)
    rows = [(i, " ".join(sentence(rng, 20) + shared[i % 3 :])) for i in range(20)]
    assert removed(substring_dedup.remove_repeats(docs(rows))) == repeats(rows)


def test_substring_common_anchors(docs, monkeypatch):
    """A line and a passage that most documents share, each time in other surroundings: common anchors are set aside."""
    monkeypatch.setattr(substring_dedup, "COMMON", 20)
    rng = random.Random(15)
    line, passage = sentence(rng, 8), sentence(rng, 30)
    rows = []
    for i in range(240):
        # Few words around the line, so that windows across its edges repeat as well.
        near = [f"v{rng.randrange(3)}" for _ in range(8)]
        rows.append((i, " ".join(sentence(rng, 12) + near[:4] + line + near[4:] + sentence(rng, 5) + (passage if i % 3 else passage[4:25]) + sentence(rng, 3))))
    rows += [(rows[7][0], rows[9][1]), (None, rows[3][1])]
    assert removed(substring_dedup.remove_repeats(docs(rows))) == repeats(rows)


def test_substring_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = {i: (n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in repeats(rows)}
    got = queries.queries()["op3_substring_dedup"](spark, DATA).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_automaton():
    rng = random.Random(11)
    for _ in range(40):
        held = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(4)]
        automaton = substring_dedup.SuffixAutomaton()
        for s in held:
            automaton.add(s)
        inside = {tuple(s[i:j]) for s in held for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        text = [rng.randrange(3) for _ in range(20)]
        covered = {k for i in range(20) for k in range(i, i + 3) if tuple(text[i : i + 3]) in inside and i + 3 <= 20}
        assert {k for a, b in automaton.spans(text, 3) for k in range(a, b)} == covered


def test_words():
    texts = [b"", b"  a b\x0b\x0cc ", b"\xc2\xa0x \x1cy", b"a"]
    w = common.Words(texts)
    assert [w.data[a:b] for a, b in zip(w.start, w.end)] == [x for t in texts for x in t.split()]
    assert w.doc.tolist() == [1, 1, 1, 2, 2, 3] and w.hash[0] == w.hash[5] and len(set(w.hash.tolist())) == 5
