"""Near duplicates, components and exact repeats against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from vulnlake.llm import graph, minhash, suffixes


def brute_components(texts, width):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = {tuple(w[k: k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copy(text, edits, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"e{r.randrange(10**9)}"
    return " ".join(w)


def test_near_duplicates_equal_brute_force(spark, make_docs, words):
    base = words(60, 1)
    rows = [(1, base), (2, base.upper()), (3, None), (4, ""), (5, " \t\n"), (6, "one"), (7, "ONE"), (8, "one two"), (9, words(30_000, 2)), (10, "é É")]
    rows += [(20 + k, near_copy(base, k % 7, k)) for k in range(40)]           # a group that only partly links
    rows += [(100 + k, words(50, 1000 + k)) for k in range(20)]
    rows += [(200, near_copy(words(30_000, 2), 900, 5))]
    got = {r.doc_id: r for r in minhash.near_duplicates(spark, make_docs(rows), width=2).collect()}
    want = brute_components(rows, 2)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_members_apart_from_their_hub_are_still_linked(spark, make_docs, words):
    """Copies of copies: linked with each other, not with the group's centre."""
    base = words(100, 3)
    rows = [(k, near_copy(base, k % 4, k)) for k in range(60)]
    for g in range(6):
        far = near_copy(base, 11 + g, 500 + g)
        rows += [(1000 + 10 * g + k, near_copy(far, k % 3, 900 + 10 * g + k)) for k in range(8)]
    for k in range(30):  # deletions only
        w = base.split()
        del w[k: k + 9 + k % 5]
        rows.append((2000 + k, " ".join(w)))
    want = brute_components(rows, 2)
    assert len({c for _, c in want.values()}) > 5
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark, make_docs(rows), width=2).collect()}
    assert got == {i: c for i, (_, c) in want.items()}


def test_keep_first_with_repeats_and_null_ids(spark, make_docs, words):
    a, b = words(80, 1), words(80, 2)
    rows = [(1, a), (1, a), (2, a), (None, a), (None, b), (None, b), (5, None), (6, ""), (6, "")]
    docs = make_docs(rows)
    out = minhash.keep_first(spark, docs)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(1, a), (None, b), (5, None), (6, ""), (6, "")])


def test_empty_tables(spark, make_docs):
    docs = make_docs([])
    assert minhash.near_duplicates(spark, docs).count() == 0
    assert minhash.keep_first(spark, docs).count() == 0
    assert suffixes.remove_repeats(spark, docs).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100 + k: 100 for k in range(40)}


def brute_repeats(rows, length):
    seen = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        seen.update(b[p: p + length] for p in range(len(b) - length + 1))
    out = Counter()
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p: p + length]] > 1:
                gone[p: p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_repeats_equal_brute_force(spark, make_docs):
    r = random.Random(4)

    def noise(n):
        return "".join(r.choice("abcdefgé ") for _ in range(n))

    shared = [noise(n) for n in (399, 400, 401, 700, 2500)]
    rows = [(k, noise(r.randrange(500)) + r.choice(shared) + noise(r.randrange(500))) for k in range(40)]
    rows += [(50, None), (51, ""), (52, "x" * 399), (53, "x" * 400), (54, "x" * 1500), (55, "ab" * 600), (56, shared[4]), (57, shared[4]), (57, shared[4])]
    rows += [(None, shared[3][:300] + "!" + shared[3][301:]), (60, shared[3][10:420] + noise(30) + shared[3][300:])]
    got = suffixes.remove_repeats(spark, make_docs(rows)).collect()
    assert Counter((x.doc_id, x.n_bytes, x.n_bytes - len(x.kept), len(x.spans), hashlib.sha256(bytes(x.kept)).hexdigest()) for x in got) == brute_repeats(rows, 400)


@pytest.mark.parametrize("group", [1, 4])
def test_large_grams_are_counted_to_the_same_result(spark, make_docs, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP", group)
    r = random.Random(11)

    def noise(n):
        return "".join(r.choice("abcdefghij ") for _ in range(n))

    passage = noise(900)
    rows = [(k, noise(r.randrange(300)) + passage[r.randrange(200): 900 - r.randrange(200)] + noise(r.randrange(300))) for k in range(25)]
    rows += [(100, None), (101, passage), (101, passage), (102, passage[:450] + "#" + passage[451:])]
    got = suffixes.remove_repeats(spark, make_docs(rows)).collect()
    assert Counter((x.doc_id, x.n_bytes, x.n_bytes - len(x.kept), len(x.spans), hashlib.sha256(bytes(x.kept)).hexdigest()) for x in got) == brute_repeats(rows, 400)


def test_hashes_of_all_grams():
    """One call gives the hash of every gram, as of each one alone."""
    hashes, data = suffixes.Rolling(1), np.frombuffer(b"abracadabra" * 20, np.uint8)
    starts = np.arange(len(data) - 9)
    prefix = hashes.prefix(data)
    assert (hashes.every(prefix, 10) == hashes.between(prefix, starts, starts + 10)).all()
