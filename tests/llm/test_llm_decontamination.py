import random
import re

from tarn.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = slow_words(text)
        for s in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[s : s + window]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w = slow_words(text)
        hit, held = set(), set()
        for size in {len(x) for x in windows}:
            for s in range(len(w) - size + 1):
                found = windows.get(tuple(w[s : s + size]))
                if found:
                    hit |= set(range(s, s + size))
                    held |= found
        out.append((doc_id, len(w), len(hit), sorted(str(h) for h in held if h is not None)))
    return sorted(map(repr, out))


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 5, [1]) for i, t in docs], "doc_id long, text string, n_hit int, __spans array<int>"),
        spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, n string"),
    )


def result(spark, docs, items, **options):
    found = D.contamination(*frames(spark, docs, items), **options).select("id", "n_words", "n_hit", "items")
    return sorted(repr(tuple(r)) for r in found.collect())


def cases():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(6)] + ["é", "ñandú", "7"]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, some(rng.choice((1, 3, 5, 9, 10, 11, 14, 40)))) for i in range(100, 140)]
    items += [(1, None), (2, ""), (3, "..."), (None, "rare words of a null item here are eleven in all yes"), (100, some(12)), (101, items[1][1])]
    docs = [(i, some(rng.randrange(0, 120))) for i in range(150)]
    docs += [(500 + i, some(9) + " Xx, " + t.upper() + "! " + some(5)) for i, (_, t) in enumerate(items) if t]
    docs += [(7, None), (None, ""), (None, items[0][1]), (7, items[0][1]), (7, items[0][1]), (8, "q " * 200_000 + items[7][1])]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = cases()
    items = [x for x in items if x[1] is None or len(slow_words(x[1])) != 1]
    assert result(spark, docs, items) == brute_force(docs, items)


def test_items_in_parts_give_the_same(spark):
    docs, items = cases()
    assert result(spark, docs, items, part_words=150) == brute_force(docs, items)


def test_empty_tables(spark):
    docs, items = cases()
    assert result(spark, [], items) == []
    assert result(spark, docs, []) == brute_force(docs, [])


def test_spans_are_cut_and_covered_documents_go(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = [
        (1, "Before it: clean words here, more than the passage has in all, so that it stays and is kept. " + passage.title() + "! After."),
        (2, passage), (3, "nothing"), (4, None), (5, ""),
    ]
    frame, items = frames(spark, docs, [(9, passage)])
    found = D.decontaminated(frame, items, coverage=0.5)
    assert found.columns == frame.columns
    kept = {r.doc_id: r.text for r in found.collect()}
    assert kept == {1: docs[0][1].replace(passage.title(), ""), 3: "nothing", 4: None, 5: ""}
    assert {r.doc_id for r in D.decontaminated(frame, items, coverage=0.0).collect()} == {3, 4, 5}
