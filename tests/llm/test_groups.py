"""Mixing, near-duplicates of texts and vectors, the pipeline, the registered SQL."""

import os
import random
import re

import numpy as np
import pytest

from bitweave.llm import embedding_dedup, mixing, near_dedup
from bitweave.llm.shingles import shingle_sets

SF = "/root/testdata/sf0.001"


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


# ---- mixing ----


def level_targets(sizes: dict, order: list, weights=(5, 2, 1)) -> dict:
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest, left, out = float(sum(sizes.values())), set(order), {}
    while left:
        over = [s for s in left if rest * w[s] / sum(w[x] for x in left) > 3 * sizes[s]]
        if not over:
            return out | {s: rest * w[s] / sum(w[x] for x in left) for s in left}
        out |= {s: 3.0 * sizes[s] for s in over}
        rest -= sum(3.0 * sizes[s] for s in over)
        left -= set(over)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_meets_targets(spark, seed):
    rng = random.Random(seed)
    srcs = ["a", "b", "c", "é", None, "zz"]
    share = [1, 50, 5, 300, 20, 2]
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 700])), rng.choices(srcs, share)[0], 1) for i in range(700)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(d, shard_docs=100).collect()
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    want = level_targets(sizes, order)
    taken = {}
    for r in got:
        assert r.size == len(dict((i, t) for i, t, _, _ in rows)[r.doc_id].split()) and 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-3
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= max(0.02 * want[s], 10) for s in sizes)
    again = {r.doc_id: r.taken for r in mixing.mix(d.repartition(5), shard_docs=100).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    words = {}
    for r in mixing.mixed_documents(d, shard_docs=100).collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {k: v for k, v in again.items() if v}


def seats_by_force(w: dict, seats: int) -> dict:
    best = sorted((-x / (2 * k + 1), i) for i, x in w.items() if x > 0 for k in range(seats))[:seats]
    out = dict.fromkeys(w, 0)
    for _, i in best:
        out[i] += 1
    return out


def test_seats_are_those_of_highest_quotients(spark):
    rng = random.Random(4)
    groups = {g: ({i: float(rng.choice([0, 1, 3, 10.5, 200])) for i in range(9)}, rng.randint(0, 40)) for g in range(6)}
    groups |= {10: ({i: 1000.0 if i == 7 else 0.49 for i in range(101)}, 1049), 11: ({i: 3.0 if i else 900.0 for i in range(101)}, 700), 12: ({i: 0.0 for i in range(3)}, 5), 13: ({i: rng.random() ** 4 for i in range(60)}, 25), 14: ({i: float(i % 4) for i in range(50)}, 333)}
    cells = spark.createDataFrame([(g, i, x, n) for g, (w, n) in groups.items() for i, x in w.items()], "g long, i long, w double, seats long")
    got = {(r.g, r.i): r.quota for r in mixing.apportion(cells, "w", "seats", ["g"], ["i"]).collect()}
    for g, (w, n) in groups.items():
        assert {i: got[g, i] for i in w} == seats_by_force(w, n), g
    one = cells.where("g = 10")
    assert {r.i: r.quota for r in mixing.apportion(one, "w", "seats", [], ["i"]).collect()} == seats_by_force(*groups[10])


def test_mix_of_odd_documents(spark, odd_documents):
    got = mixing.mix(odd_documents).collect()
    assert len(got) == 10 and {r.size for r in got if r.doc_id in (1, 2, 5)} == {0} and all(r.taken <= 3 * r.size for r in got)
    assert mixing.mixed_documents(odd_documents).columns == odd_documents.columns
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0


# ---- near-duplicates of texts ----


def test_shingles_by_hand():
    s, n = shingle_sets(["a b c d", "A, b. C!", "x", "", "  ", "a b c d a b c", "é b c"], 3)
    assert n.tolist() == [2, 1, 1, 0, 0, 4, 1]
    at = np.cumsum(n)
    parts = [set(s[a - m : a].tolist()) for a, m in zip(at, n)]
    assert parts[1] < parts[0] and parts[0] < parts[5] and not parts[6] & parts[1]


def test_near_copies_group_and_others_stay(spark, odd_documents):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8)))
    passage = " ".join(word() for _ in range(55))
    rows, group = [], {}
    for g in range(25):
        base = [word() for _ in range(rng.randint(120, 300))]
        for c in range(1 + g % 4):
            t = [word() if c and rng.random() < 0.04 else x for x in base]
            group[len(rows)] = g
            rows.append((len(rows), " ".join(t)))
        if g % 5 == 0:
            group[len(rows)] = g
            rows.append((len(rows), " ".join(base)))
    for g in range(30, 45):  # others that share a passage only
        group[len(rows)] = g
        rows.append((len(rows), " ".join(word() for _ in range(150)) + " " + passage))
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, h int, size int").repartition(4)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(d).collect()}
    first = {}
    for i, g in group.items():
        first.setdefault(g, i)
    assert {i: got[i].component_id for i in group} == {i: first[g] for i, g in group.items()}
    assert all(got[i].kept == (first[g] == i) for i, g in group.items())
    odd = near_dedup.near_duplicates(odd_documents).collect()
    assert len(odd) == 10 and all(r.kept for r in odd) and {r.n_copies for r in odd if r.doc_id == 3} == {2} and all(r.n_links == 0 for r in odd)
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_class_id_is_the_group_of_near_copies(spark):
    rng = random.Random(3)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    base, other = words(150), words(150)
    near = [*base[:70], "changed", *base[71:]]
    texts = [other, base, base, near, words(150), near]
    d = spark.createDataFrame(list(enumerate(map(" ".join, texts))), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.copy_id, r.n_copies, r.kept) for r in near_dedup.near_duplicates(d).collect()}
    assert got == {0: (0, 0, 1, True), 1: (1, 1, 2, True), 2: (1, 1, 2, False), 3: (1, 3, 2, False), 4: (4, 4, 1, True), 5: (1, 3, 2, False)}


def test_verify_matches_sets_and_bands(spark):
    rng = np.random.default_rng(3)
    sets = {i: np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype("<u4") for i in range(30)}
    pairs = [(a, b) for a in range(30) for b in range(a + 1, 30)]
    df = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "id long, set binary")
    asked = spark.createDataFrame(pairs, "a long, b long")
    got = {(r.a, r.b) for r in near_dedup.verify(asked, df, 0.6, group=7).collect()}
    want = {(a, b) for a, b in pairs if len(np.intersect1d(sets[a], sets[b])) >= 0.6 * min(len(sets[a]), len(sets[b]))}
    assert got == want
    links = {}
    for r in near_dedup.verify(asked, df, 0.6, group=7, counted=True).collect():
        links[r.rep] = links.get(r.rep, 0) + r.links
        assert r.root <= r.rep
    assert links == {i: n for i in sets if (n := sum(i in p for p in want))}
    n = near_dedup.bands_for(0.35, 1e-3, 3)
    assert near_dedup.missed(0.35**2, n, 3) <= 1e-3 < near_dedup.missed(0.35**2, n - 1, 3)
    p = 0.35**2
    assert abs(near_dedup.missed(p, 50, 2) - ((1 - p) ** 50 + 50 * p * (1 - p) ** 49)) < 1e-12


def test_all_of_a_bucket_meet(spark):
    """Whatever the size of the tiles, all pairs of a bucket are counted in it."""
    key = lambda band, x: x << 7 | band
    rows = [(i, 100 + i % 20, [key(0, 7), key(1, 8), key(2, 9), key(3, 1000 + i)]) for i in range(70)] + [(100, 300, [key(0, 7), key(1, 8), key(2, 9)]), (101, 110, [key(0, 7), key(1, 2), key(2, 3)])]
    d = spark.createDataFrame(rows, "rep long, size long, keys array<long>")
    for kw in ({}, {"tile": 8}, {"tile": 3}):
        got = {(r.a, r.b): r.votes for r in near_dedup.candidates(d, 4, 1.3, 1.14, 3, **kw).collect()}
        assert got == {(a, b): 3 for a in range(70) for b in range(a + 1, 70)}


def test_pairs_travel_as_lists(spark):
    """A member of a bucket gives one row, not one for each pair; votes of many homes add up, whatever the batches."""
    key = lambda band, x: x << 7 | band
    met = spark.createDataFrame([(5, key(b, 7), 0, 10 * i, 100) for b in range(3) for i in range(40)], "home long, key long, side int, r long, s int").coalesce(1).sortWithinPartitions("home", "key", "r")
    rows = met.mapInArrow(near_dedup._meet(4, 1.3, 1.14), "a long, home long, others array<long>, votes array<short>").collect()
    assert sorted(r.a for r in rows) == [10 * i for i in range(39)] and all(r.others == [10] * (39 - r.a // 10) and r.votes == [3] * len(r.others) for r in rows)
    rng = random.Random(2)
    lists, want = [], {}
    for home in range(30):
        for a in rng.sample(range(60), 20):
            others = sorted(rng.sample(range(a + 1, 90), 9))
            votes = [rng.randint(1, 2) for _ in others]
            lists.append((a, home, [y - x for x, y in zip([a, *others], others)], votes))
            for b, v in zip(others, votes):
                want.setdefault((a, b), []).append((v, home))
    want = {p: (sum(v for v, _ in x), max(x)[1]) for p, x in want.items() if sum(v for v, _ in x) >= 3}
    for batch in (1, 7, 1000):
        table = near_dedup.pa.table(list(zip(*sorted(lists))), ["a", "home", "others", "votes"]).cast(near_dedup._MET)
        got = [r for x in near_dedup._counted(3, flush=50)(iter(table.to_batches(batch))) for r in x.to_pylist()]
        assert {(r["a"], r["b"]): (r["votes"], r["tile"]) for r in got} == want and len(got) == len(want)


def test_groups_are_those_of_all_links(spark):
    """Groups equal those of all pairs, with buckets cut into chunks or not: clusters, chains and texts that share a passage only."""
    rng = random.Random(21)
    words = lambda n: ["".join(rng.choice("abcdefghijkl") for _ in range(5)) for _ in range(n)]
    edit = lambda t, share: [w if rng.random() > share else words(1)[0] for w in t]
    passage, texts = words(40), []
    for g in range(6):
        base = words(rng.randint(60, 200))
        texts += [edit(base, 0.05) for _ in range(12 if g else 50)]
    for _ in range(5):
        t = words(120)
        for _ in range(8):  # each differs from the one before, so that the ends have little in common
            texts.append(t)
            t = edit(t, 0.1)
    texts += [words(60) + passage for _ in range(30)] + [passage + words(10) for _ in range(10)] + [texts[3], None, [], texts[60]]
    rng.shuffle(texts)
    rows = [(i, None if x is None else " ".join(x)) for i, x in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {r.doc_id: (r.class_id, r.kept) for r in near_dedup.near_duplicates(d).collect()}
    assert 20 < sum(k for _, k in want.values()) < len(texts) - 100
    for tile in (256, 8, 3):
        assert {r.doc_id: (r.class_id, r.kept) for r in near_dedup.groups(d, tile=tile).collect()} == want
    assert near_dedup.groups(d.limit(0)).count() == 0


def test_pipeline_writes_no_table_of_pairs(spark, monkeypatch):
    """What stage 2 writes grows with the documents, not with the pairs of a cluster, and is gone before the texts are shuffled."""
    import corpus_pipeline as c

    rng = random.Random(8)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    base = words(150)
    texts = [" ".join(w if rng.random() > 0.03 else words(1)[0] for w in base) for _ in range(300)]
    d = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    seen, real = [], near_dedup.stage

    def stage(df, name):
        out = real(df, name)
        seen.append((name, out.count(), out.inputFiles()))
        return out

    monkeypatch.setattr(near_dedup, "stage", stage)
    assert [r.doc_id for r in c.near_duplicates(spark, d, "").collect()] == [0]
    assert seen and all(n <= 300 for name, n, _ in seen if name != "buckets") and all(n <= 300 * 65 for _, n, _ in seen)
    assert not [f for _, _, files in seen for f in files if os.path.exists(re.sub("^file:/+", "/", f))]


def test_larger_texts_go_only_where_they_have_enough(spark, monkeypatch):
    """Of a larger text that shares a few shingles with a smaller one nothing is sent to a tile, of one that holds it only those; what is no use any more is deleted."""
    rng = random.Random(6)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    small = [words(30) for _ in range(3)]
    texts = [*small, small[0] + words(200), *(x[:6] + small[1][8 * i : 8 * i + 6] + words(200) for i, x in enumerate(small))]
    seen, real = {}, near_dedup.stage

    def stage(df, name):
        out = real(df, name)
        seen[name] = out.inputFiles(), out.collect()
        return out

    monkeypatch.setattr(near_dedup, "stage", stage)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(map(" ".join, texts))), "doc_id long, text string")).collect()}
    assert [got[i].n_containers for i in range(7)] == [1, 0, 0, 0, 0, 0, 0] and got[0].container_id == 3 and got[3].n_links == 1
    assert {r.r for r in seen["larger"][1]} == {3} and all(len(r["keys"]) == 28 for r in seen["larger"][1])
    there = lambda name: [f for f in seen[name][0] if os.path.exists(re.sub("^file:/+", "/", f))]
    assert not any(map(there, ["hits", "inner", "keys", "outer", "larger"])) and there("inside") and there("classes")


def test_bottom_sketch():
    rng = np.random.default_rng(8)
    n = np.array([5, 0, 64, 65, 1000, 30_000])
    prints = np.concatenate([np.sort(rng.choice(1 << 48, m, replace=False)).astype(np.uint64) for m in n])
    flat, m = near_dedup.bottom_sketch(prints, n, 64, 16)
    assert m.tolist() == [5, 0, 64, 16, 16, 16]
    at, h = np.cumsum(n), near_dedup.mix(prints + np.uint64(0x5851F42D4C957F2D))
    for i in (3, 4, 5):
        own = slice(at[i] - n[i], at[i])
        low = prints[own][np.argsort(h[own])[:16]]
        assert set(flat[np.cumsum(m)[i] - 16 : np.cumsum(m)[i]]) == set(low)


def links_by_force(texts: dict, k: int = 3, c: float = 0.6) -> tuple[dict, list]:
    """Sets and linked pairs (a, b, sizes' ratio) of different texts, by word shingles."""
    words = {i: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower()) for i, t in texts.items()}
    sets = {i: set(zip(*[w[j:] for j in range(k)])) if len(w) >= k else ({tuple(w)} if w else set()) for i, w in words.items()}
    found, ids = [], sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            small, large = sorted((sets[a], sets[b]), key=len)
            if texts[a] != texts[b] and small and len(small & large) >= c * len(small):
                found.append((a, b, len(large) / len(small)))
    return sets, found


def test_all_links_at_all_sizes(spark):
    """Production parameters against brute force: near-copies, texts inside larger ones of every ratio, shared passages, and a line that a third of all texts hold."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    words = lambda n: [word() for _ in range(n)]
    passage, line, texts = words(60), words(14), {}
    add = lambda w: " ".join(w) in texts.values() or texts.__setitem__(len(texts), " ".join(w))
    noisy = lambda w, p: [word() if rng.random() < p else x for x in w]
    for g in range(40):
        base = words(rng.choice([8, 20, 70, 200, 400]))
        for _ in range(rng.randint(1, 6)):
            add(noisy(base, rng.choice([0.02, 0.06, 0.1])))
        inner = base[: rng.randint(5, len(base))]
        for factor in (1.5, 2, 4, 10, 40):
            if rng.random() < 0.5:
                extra = words(int(len(inner) * factor))
                cut = rng.randint(0, len(extra))
                add(extra[:cut] + noisy(inner, rng.choice([0, 0.03, 0.08])) + extra[cut:])
    for _ in range(40):
        add(words(200) + passage)
    for _ in range(60):
        add(words(rng.choice([2, 5, 100, 300])) + line)
    add(["one"]); add(["one", "two"]); add(["one", "two", "three"]); add(["one", "two", "three", "four"])  # noqa: E702
    sets, found = links_by_force(texts)
    copies = {len(texts) + i: texts[i] for i in (0, 3, 50)}
    rows = [*texts.items(), *copies.items(), (None, texts[0])]
    got = {r.doc_id: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    want, inside = {i: 0 for i in texts}, {i: [] for i in texts}
    for a, b, ratio in found:
        want[a] += 1
        want[b] += 1
        if ratio > 1.3:
            small, large = sorted((a, b), key=lambda i: len(sets[i]))
            inside[small].append(large)
    bins = {}
    for i in texts:  # by the ratio that most of a text's links have
        ratios = [min(6, int(np.log2(r))) for a, b, r in found if i in (a, b)]
        if ratios:
            n = bins.setdefault(max(set(ratios), key=ratios.count), [0, 0])
            n[0] += want[i]
            n[1] += got[i].n_links
    assert all(g >= 0.9 * w for w, g in bins.values()) and len(bins) >= 5, bins
    assert sum(r.n_links for i, r in got.items() if i in texts) >= 0.99 * sum(want.values()) and all(got[i].n_links <= want[i] for i in texts)
    exact = [i for i in texts if len(sets[i]) <= near_dedup.WHOLE]
    assert len(exact) > 50 and all(got[i].n_containers == len(inside[i]) and got[i].container_id == min(inside[i], default=None) for i in exact)
    comp = {i: i for i in texts}
    for _ in range(9):
        for a, b, ratio in found:
            if ratio <= 1.3:
                comp[a] = comp[b] = min(comp[a], comp[b])
    assert sum(got[i].component_id != comp[i] for i in texts) <= 1
    assert all(got[i].class_id == got[i - len(texts) if i >= len(texts) else i].class_id and got[i].n_copies == 2 for i in copies) and got[None].kept and got[None].n_links == 0


# ---- near-duplicates of vectors ----


@pytest.mark.parametrize("params", [{}, {"tile": 16}, {"bits": 5, "tables": 60, "tile": 64}, {"bits": 20, "tables": 150}])
def test_vectors_equal_brute_force(spark, params):
    rng = np.random.default_rng(5)
    rows, centres = [], rng.standard_normal((12, 16))
    for i in range(400):
        c = rng.integers(0, 30)
        v = centres[c % 12] + rng.standard_normal(16) * (0.08 if c < 12 else 3)
        rows.append((i, [float(np.float32(x)) for x in v], int(c % 3)))
    for i in range(400, 430):
        rows.append((i, rows[7][1], rows[7][2]))
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, rows[7][1], None), (904, [None] + [1.0] * 15, 1), (905, [1.0, 2.0], 0), (906, [2.0, 4.0], 0), (907, [], 1), (908, [float("inf")] * 16, 1)]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, rep int, tile int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(d, **params).collect()}
    good = [(i, np.asarray(v, float), l) for i, v, l in rows if i < 900 or i in (905, 906)]
    links = {i: [j for j, w, m in good if j != i and m == l and len(w) == len(v) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93] for i, v, l in good}
    comp = {i: i for i in links}
    for _ in range(50):
        comp = {i: min([comp[i], *(comp[j] for j in links[i])]) for i in comp}
    assert len(got) == len(rows)
    for i, *_ in rows:
        assert (got[i].n_links, got[i].component_id) == (len(links.get(i, [])), comp.get(i, i)), i
        assert got[i].kept == (comp.get(i, i) == i)
    assert embedding_dedup.near_duplicates(d.limit(0)).count() == 0


def test_bits_follow_the_rows():
    for n in (0, 1, 500, 5_000, 10**6, 10**9, 10**12):
        bits, tables = embedding_dedup.tuned(n, 0.93)
        assert 6 <= bits <= 32 and (bits == 32 or 2**bits >= n)
        assert (1 - (1 - np.arccos(0.93) / np.pi) ** bits) ** tables <= 7e-4


# ---- pipeline and SQL ----


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline_against_its_stages(spark, tmp_path):
    import zlib

    import corpus_pipeline as c

    from bitweave.llm import decontaminate, language_id, token_counts
    from bitweave.session import stage, table

    assert 4 <= len(c.STAGES) <= 5 and c.ORACLE_SQL is None
    docs = table(spark, SF, "documents")
    cols, seen = docs.columns, [docs]
    for name, f in c.STAGES:
        seen.append(stage(f(spark, seen[-1], SF), name))
    assert all(d.columns == cols for d in seen[1:-1])
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    raw = {r.doc_id: r.text for r in docs.collect()}
    und = {i for i, t in raw.items() if not re.search(r"[^\W\d_]", t or "")}
    assert ids[0] - ids[1] >= und and len(ids[0] - ids[1] - und) <= 2
    near = {r.doc_id for r in near_dedup.near_duplicates(seen[1]).where("kept").collect()}
    assert ids[2] == near
    bench = [re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", r.text.lower()).strip() for r in table(spark, SF, "benchmark").collect()]
    dirty = {i for i in ids[2] if any(b in re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", raw[i].lower()) for b in bench)}
    assert dirty and not dirty & ids[3] and len(ids[2] - ids[3] - dirty) <= 1
    mixed = seen[4].collect()
    assert {r.doc_id for r in mixed} <= ids[3] and all(r.n_chars == len(r.text) for r in mixed)
    tok, at = token_counts.tokenizer(token_counts.tokenizer_path("word_bpe_49k.json")), 0
    want = sorted((r.doc_id, zlib.crc32(np.array(tok.encode(r.text, add_special_tokens=False).ids + [2], "<u4").tobytes())) for r in mixed)
    assert sorted((r.doc_id, r.ids_crc32) for r in seen[5].collect()) == want
    assert len({r.start for r in seen[5].collect()}) == len(mixed)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline_of_odd_documents(spark, odd_documents):
    import corpus_pipeline as c

    from bitweave.session import stage

    docs = odd_documents
    for name, f in c.STAGES:
        docs = stage(f(spark, docs, SF), name)
        if name == "near_dedup":  # a repeated row stays once, texts without a letter are gone
            assert sorted(r.doc_id for r in docs.where("doc_id is not null").collect()) == [0, 3, 4, 7]
            assert docs.columns == odd_documents.columns and docs.where("doc_id is null").count() == 1
    assert docs.count() >= 4


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["op4_chat_format", "op5_mix_sources"])
def test_sql(spark, name):
    import duckdb

    from bitweave.llm import queries

    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.execute(queries.ORACLE[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    key = lambda d: sorted(tuple(round(x, 5) if isinstance(x, float) else str(x) for x in r) for r in d[sorted(want.columns)].itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and key(got) == key(want)
