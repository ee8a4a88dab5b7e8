import random

import numpy as np

from tarn.llm import near_dedup as N
from tarn.llm.stages import simhash_near_dedup


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def slow_kept(rows):
    """rows: (id, text) with distinct ids; the smallest id of each component, by comparing all pairs."""
    sets, group = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    return sorted(set(group.values()))


def edited(rng, base, share):
    return [f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in base]


def some_texts(rng):
    texts = [None, "", " \n", "short", "Short", "short one", "x" * 100_000]
    for n in (9, 12, 60, 300, 300, 900, 5000):
        base = [f"w{rng.randrange(3000)}" for _ in range(n)]
        texts.append(" ".join(base))
        for share in (0.002, 0.005, 0.01, 0.015, 0.02, 0.03, 0.05):
            texts += [" ".join(edited(rng, base, share)) for _ in range(3)]
        texts += [" ".join(base[:-1]), " ".join(base[1:]), " ".join(base).upper()]
    line = "one very common line that is held by many of these texts here"
    texts += [" ".join([line] + [f"v{rng.randrange(9000)}" for _ in range(20)]) for _ in range(40)]
    texts.append(" ".join(["again and again the same"] * 50))
    texts.append(" ".join(["again and again the same"] * 2))
    return texts


def copies(rng):
    """A large group of near copies, a chain in which only neighbours are linked, and texts that share a template."""
    base = [f"c{rng.randrange(3000)}" for _ in range(90)]
    texts = [" ".join(edited(rng, base, 0.01)) for _ in range(120)]
    line = [f"d{i}" for i in range(160)]
    texts += [" ".join(line[i : i + 100]) for i in range(0, 60, 5)]
    template = [f"e{i}" for i in range(40)]
    return texts + [" ".join(template + [f"v{rng.randrange(9000)}" for _ in range(rng.choice((5, 20)))]) for _ in range(60)]


def test_stage_equals_brute_force(spark, monkeypatch):
    """With loose groups that are split into many parts."""
    rows = list(enumerate(some_texts(random.Random(5)) + copies(random.Random(15))))
    want = slow_kept(rows)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp int, row string")
    assert len(want) < len(rows) - 60
    monkeypatch.setattr(N, "PART_SHINGLES", 1500)
    found = simhash_near_dedup(spark, docs, "")
    assert found.columns == docs.columns
    assert sorted(r.doc_id for r in found.collect()) == want


def test_pairs_at_the_least_similarity_are_looked_at():
    """Sets with a similarity of exactly 0.8 share a key and lie within the radius."""
    rng = np.random.default_rng(6)
    for size in (4, 8, 40, 400):
        for _ in range(150):
            drawn = np.unique(rng.integers(0, 2**64, size * 10 // 8, dtype=np.uint64))
            cut = len(drawn) // 10
            if not cut:
                assert (N.distances(*N.fingerprints([drawn, drawn[1:]]))) <= N.RADIUS
                continue
            mixed = rng.permutation(drawn)
            a, b = np.sort(mixed[cut:]), np.sort(np.concatenate((mixed[:cut], mixed[2 * cut :])))
            assert N.alike(a, b)
            assert (N.band_keys(a) == N.band_keys(b)).any()
            assert N.distances(*N.fingerprints([a, b])) <= N.RADIUS


def test_template_texts_are_not_compared(spark):
    """All share two thirds of their words, and so keys, but no loose group holds them."""
    rng, n = random.Random(2), 3000
    template = " ".join(f"t{i}" for i in range(40))
    rows = [(i, f"{template} " + " ".join(f"o{rng.randrange(10**8)}" for _ in range(20))) for i in range(n)]
    texts = spark.createDataFrame(rows, "row long, text string")
    units = N.map_texts(texts, N._FIELDS, lambda: N._describe)
    live = N._live(units)
    assert live.count() > n / 2
    assert N._loose_groups(N._prefixes(texts, live)).count() == 0


def test_a_group_is_compared_exactly_and_pivots_discard():
    """Clusters that share rare shingles: all that is linked is connected, and pivots leave out most of the rest."""
    rng = np.random.default_rng(3)
    sets, passage = [], rng.integers(0, 2**64, 12, dtype=np.uint64)
    for _ in range(4):
        base = rng.integers(0, 2**64, 300, dtype=np.uint64)
        for _ in range(30):
            own = rng.integers(0, 2**64, rng.integers(0, 60), dtype=np.uint64)
            sets.append(np.unique(np.concatenate((rng.choice(base, rng.integers(240, 300), replace=False), own, passage))))
    group = N.Group(sets, np.arange(len(sets)))
    joined = group.verified()
    want = np.arange(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if N.alike(sets[i], sets[j]):
                want[want == want[i]] = want[j] if want[j] < want[i] else want[i]
                want[want == max(want[i], want[j])] = min(want[i], want[j])
    parent = dict(joined)
    found = [parent.get(i, i) for i in range(len(sets))]
    assert len({(a, b) for a, b in zip(found, want.tolist())}) == len(set(found)) == len(set(want.tolist()))
    i, j = np.triu_indices(len(sets), 1)
    group.seen = group.discarded = 0
    left = group.near(i, j)
    print("pivots discard", group.discarded, "of", group.seen, "pairs; fingerprints leave", left.sum())
    assert group.discarded > 0.3 * group.seen
    assert all(left[k] for k, (a, b) in enumerate(zip(i, j)) if N.alike(sets[a], sets[b]))


def test_recall_on_a_given_table(spark):
    """All pairs of distinct texts at 0.8, by counting every common shingle."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").groupBy("text").agg({"doc_id": "min"}).toDF("text", "doc_id")
    texts = {r.doc_id: shingles(r.text) for r in docs.collect()}
    held, common = {}, {}
    for i, found in texts.items():
        for s in found:
            held.setdefault(s, []).append(i)
    for found in held.values():
        found.sort()
        for k, i in enumerate(found):
            for j in found[k + 1 :]:
                common[i, j] = common.get((i, j), 0) + 1
    pairs = [(i, j) for (i, j), n in common.items() if 5 * n >= 4 * (len(texts[i]) + len(texts[j]) - n)]
    group = {i: i for i in texts}
    for i, j in pairs:
        a, b = group[i], group[j]
        if a != b:
            group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    assert len(pairs) >= 40
    assert sorted(r.doc_id for r in simhash_near_dedup(spark, docs, "").select("doc_id").collect()) == sorted(set(group.values()))


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(None, text), (3, text + " more"), (3, text), (2, "other text"), (None, "alone")], "doc_id long, text string")
    got = sorted((r.doc_id for r in simhash_near_dedup(spark, docs, "").collect()), key=str)
    assert got == [2, 3, None]
    assert simhash_near_dedup(spark, docs.limit(0), "").collect() == []


def test_texts_are_read_as_often_whatever_the_size_of_a_group(spark, monkeypatch):
    """Near copies of which many are linked to none: not a pass over all texts for each turn that joins parts."""
    rng, read, whole = random.Random(7), [], N._texts_of
    monkeypatch.setattr(N, "PART_SHINGLES", 800)
    monkeypatch.setattr(N, "_texts_of", lambda *a: read.append(1) or whole(*a))
    bases = [[f"{k}b{rng.randrange(3000)}" for _ in range(60)] for k in range(2)]
    rows = [(i, " ".join(edited(rng, bases[i % 2], rng.choice((0.01, 0.03, 0.06))))) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_kept(rows)
    assert 20 < len(want) < 200
    assert sorted(r.doc_id for r in simhash_near_dedup(spark, docs, "").collect()) == want
    assert len(read) == 3


def test_sides_and_middle_of_a_group():
    """With sides, only pairs across are compared; a component's middle is the unit most like the others."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    sets = [np.unique(base[rng.permutation(300)[: 300 - n]]) for n in (40, 35, 0, 30, 45)]
    assert N.Group(sets, np.arange(5)).verified() == [(i, 2) for i in (0, 1, 3, 4)]
    assert N.Group(sets, np.arange(5), np.zeros(5, dtype=int)).verified() == []
    linked = N.Group(sets, np.arange(5), np.array([0, 0, 1, 0, 0])).verified()
    assert len(linked) == 4 and {i for pair in linked for i in pair} == set(range(5))


def test_bits_and_the_rest_of_a_set_decide_exactly(monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**64, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate((rng.choice(base, n, replace=False), base[:60]))) for n in rng.integers(280, 400, 60)]
    for common in (64, 512):
        monkeypatch.setattr(N, "COMMON", common)
        group, others = N.Group(sets, np.arange(60)), np.arange(1, 60)
        want = [j for j in others.tolist() if N.alike(sets[0], sets[j])]
        assert 0 < len(want) < 59
        assert group.compare(0, others).tolist() == want


def test_shingles_of_words_in_order():
    assert len(N.shingle_set("")) == len(N.shingle_set(" \n")) == 0
    assert len(N.shingle_set("a b c d")) == len(N.shingle_set("a b c d e")) == len(N.shingle_set("a " * 20)) == 1
    assert N.shingle_set("A  b\nc") == N.shingle_set("a b c") != N.shingle_set("b a c")
    rng = random.Random(10)
    text = " ".join(rng.choice("abc") for _ in range(400))
    assert len(N.shingle_set(text)) == len(shingles(text))
