import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import golomb
from logloom.llm.components import components
from logloom.llm.exact_dedup import exact_dedup
from logloom.llm.ngram_join import _PREFIXES, boundary, jaccard_components

DOCS = "doc_id long, text string, lang string, _w long, key1 string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@given(st.lists(st.integers(0, 2**64 - 1), max_size=300))
@settings(max_examples=200, deadline=None)
def test_golomb_round_trip(values):
    v = np.sort(np.array(values, np.uint64))
    assert (golomb.decode(golomb.encode(v)) == v).all()


def test_golomb_is_small_and_bloom_has_no_misses():
    v = np.sort(np.random.default_rng(1).integers(0, 2**40, 50_000, dtype=np.uint64))
    assert len(golomb.encode(v)) < 4.2 * len(v)
    b, keys = golomb.Bloom(16), np.arange(-2000, 2000)
    b.add(keys)
    assert b.has(keys).all() and b.has(np.arange(10**6, 10**6 + 10_000)).mean() < 0.05


def same_but_spaces(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0]))[0]
        out += [(i, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i, _ in members]
    return sorted(out)


def test_exact_dedup(spark):
    long = "wörd " * 30_000
    rows = [(1, "a b"), (2, "ab "), (3, "a  b"), (4, None), (5, ""), (6, " \t\n\x0b\x0c\r"), (7, "x\xa0y"), (8, "xy"), (9, long), (10, long.strip()), (-3, "neg"), (0, "n e g"), (2**63 - 1, "big"), (-(2**63), "big"), (11, "solo"), (12, "solo2"), (13, "solo2"), (13, "solo2")]
    rows += [(100 + i, "hot") for i in range(400)]
    got = exact_dedup(spark.createDataFrame([(i, t, "en", 1, "k") for i, t in rows], DOCS))
    assert sorted(map(tuple, got.collect())) == same_but_spaces(rows)


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(spark.createDataFrame([], DOCS)).collect() == []


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i), links[i]) for i in ids)


def near_copies(seed):
    rng, vocab = random.Random(seed), [f"w{i}" for i in range(400)] + ["THE", "of", "É"]
    texts = [None, "", "  ", "one", "One", "one two", "one two three four five", "one two three four", "ONE two\tthree four"]
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([5, 6, 9, 14, 40, 120, 300]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, max(1, len(base) // 30)])):
                k = rng.randrange(len(t))
                rng.choice([lambda: t.insert(k, rng.choice(vocab)), lambda: t.pop(k) if len(t) > 1 else None, lambda: t.__setitem__(k, rng.choice(vocab))])()
            texts.append(" ".join(t))
    base = [rng.choice(vocab) for _ in range(60)]
    for _ in range(40):  # one large group
        t = list(base)
        t[rng.randrange(60)] = rng.choice(vocab)
        texts.append(" ".join(t))
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i * 3 - 50, texts[k]) for i, k in enumerate(order)]


def test_jaccard_components_against_brute_force(spark):
    for seed, block in ((1, 1024), (2, 8)):
        rows = near_copies(seed)
        df = spark.createDataFrame([(i, t, "en", 1, "k") for i, t in rows], DOCS).repartition(3)
        assert sorted(map(tuple, jaccard_components(df, block=block).collect())) == brute_components(rows)


def test_jaccard_of_nothing_and_of_repeated_rows(spark):
    assert jaccard_components(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(5, "a b c d e f", "en", 1, "k")] * 3 + [(2, "A b c d e f", "en", 1, "k")]
    assert sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, DOCS)).collect())) == [(2, 2, 2, 3), (5, 2, 2, 3), (5, 2, 2, 3), (5, 2, 2, 3)]


def test_rows_with_one_id_are_judged_by_their_texts(spark):
    near = " ".join(f"w{i}" for i in range(40))
    rows = [(1, near), (5, near + " x"), (5, "something else of five words and more"), (None, "a text with no id of its own"), (None, near + " y"), (7, "something else of five words and more"), (3, "one two")]
    got = sorted(tuple(r) for r in jaccard_components(spark.createDataFrame([(i, t, "en", 1, "k") for i, t in rows], DOCS).repartition(2)).collect())
    low = -(2**63)
    assert got == sorted([(1, 36, low, 2), (5, 37, low, 2), (low, 37, low, 2), (5, 3, 5, 1), (7, 3, 5, 1), (low, 4, low, 0), (3, 1, 3, 0)])


def test_boundary_weighs_pairs_against_lists(spark):
    rows = [(1, 4, 1, b"", 3, 100), (2, 30, 1, b"", 900, 50)]
    assert boundary(spark.createDataFrame(rows, _PREFIXES)) in range(4, 30)
    rows = [(1, 4, 1, b"", 3, 100), (2, 300, 1, b"", 10, 5000), (3, 5000, 1, b"", 10**6, 50)]
    assert boundary(spark.createDataFrame(rows, _PREFIXES)) in range(300, 5000) and boundary(spark.createDataFrame([], _PREFIXES)) == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (500, 600), (600, 500)]
    found = {r["v"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[100 + i] == 100 for i in range(30)) and found[600] == 500
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
