import hashlib
import random
import re
from pathlib import Path

import public_tokenizers as P
import pytest
import tiktoken
from test_llm_decontamination import slow_words
from test_llm_near_dedup import slow_kept

import corpus_pipeline
from tarn.llm import byte_bpe, common, decontamination, quality, sharding, simhash

LIBRARY = tiktoken.Encoding(
    "own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={}
)
SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def write(root, spark, docs, items):
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def after_each_stage(spark, docs, sf_dir):
    """What the stages of the pipeline return, each on what its predecessor kept."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        out.append((name, docs))
    return out


def brute_force(rows, items, model):
    """rows: (doc_id, text) with distinct ids; the ids left after each filtering stage."""
    reader, left = quality.Reader(), []
    traits = {i: reader.traits(t or "") for i, t in rows}
    rows = [r for r in rows if traits[r[0]] and model.score(*quality.features(traits[r[0]])) >= 0.5]
    left.append({i for i, _ in rows})
    groups = {}
    for i, t in rows:
        body = t.translate({ord(c): None for c in " \t\n\x0b\x0c\r"})
        groups.setdefault(body, []).append((-len(t), i, t))
    rows = [(i, t) for _, i, t in map(min, groups.values())]
    left.append({i for i, _ in rows})
    text = dict(rows)
    rows = [(i, text[i]) for i in slow_kept(rows)]
    left.append({i for i, _ in rows})
    windows = set()
    for t in items:
        w = slow_words(t)
        windows |= {tuple(w[s : s + 10]) for s in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}

    def clean(t):
        w = slow_words(t)
        return not any(tuple(w[s : s + n]) in windows for n in sizes for s in range(len(w) - n + 1))

    rows = [(i, t) for i, t in rows if clean(t)]
    left.append({i for i, _ in rows})
    return left, rows


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = quality.fit(quality.described(docs))
    left, rows = brute_force([(r.doc_id, r.text) for r in docs.collect()], items, model)
    found = after_each_stage(spark, docs, SF)
    for (name, frame), ids in zip(found[:-1], left):
        assert frame.columns == docs.columns, name
        assert sorted(r.doc_id for r in frame.collect()) == sorted(ids), name
    assert len(left[0]) < 200 and len(left[1]) < len(left[0]) and len(left[3]) < len(left[2])
    want = {}
    for i, t in rows:
        ids = LIBRARY.encode_ordinary(t)
        packed = b"".join(n.to_bytes(4, "little") for n in ids)
        want[i] = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), packed)
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids)) for r in got} == want
    assert len(got) == len(want)


def prose(rng, n):
    return " ".join(rng.choice("the of and river house stone light evening walked slowly over under".split()) + rng.choice(["", "", ",", "."]) for _ in range(n)).capitalize() + "."


@pytest.mark.parametrize("empty", [False, True])
def test_odd_documents(spark, tmp_path, empty):
    rng = random.Random(9)
    clean, other = prose(rng, 200), prose(rng, 150)
    docs = [] if empty else [
        (1, clean, "en", "a", 5), (2, clean, "en", "a", 5), (3, clean + " ", None, None, None), (4, None, "en", "a", 0), (5, "", "en", "a", 0),
        (6, other, "en", "a", 5), (6, other, "en", "a", 5), (None, prose(rng, 120), "en", "a", 5), (None, prose(rng, 130), "en", "a", 5),
        (7, prose(rng, 40_000), "en", "a", 5), (8, "LOUD!! " * 300, "en", "a", 5), (9, prose(rng, 100) + " a benchmark item of exactly ten words is hidden in here " + prose(rng, 9), "en", "a", 1),
    ]
    items = [] if empty else [(1, "A benchmark item of exactly ten words is hidden in"), (2, None), (None, "")]
    sf = write(tmp_path, spark, docs, items)
    found = corpus_pipeline.run(spark, sf).collect()
    got = sorted((r.doc_id for r in found), key=lambda x: (x is None, x))
    assert got == ([] if empty else [3, 6, 7, None, None])


#: Names that the operators use for themselves, now or before.
TAKEN = (
    "row_number ROW row id text_ place votes index value __score __row __index __partition __n_words __longest __spans __items n_words longest spans"
    " items n_words_before spans_before n part at run runs slot_ number doc h size h1 h2 n_bytes body again round key which same keys first fp u v root"
    " component g bin score kept c0 c1 `a.b`"
).split()


def with_taken_names(spark, texts):
    names = [n for n in TAKEN if n.lower() not in ("row",)] + ["ROW"]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) + tuple(-777 - k for k in range(len(names))) for i, t in enumerate(texts)], COLUMNS + "".join(f", {n} int" for n in names))
    return docs, sorted((i, *(-777 - k for k in range(len(names)))) for i in range(len(texts))), len(names)


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Their values too, not only their names."""
    rng = random.Random(10)
    docs, want, n = with_taken_names(spark, [prose(rng, 90) for _ in range(6)])
    sf = write(tmp_path, spark, [(1, "x", "en", "a", 1)], [(1, "some item")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns, name
        assert sorted((r[0], *r[-n:]) for r in kept.collect()) == want, name
    assert stage is not None and simhash.kept(docs).columns == docs.columns
    assert sorted((r[0], *r[-n:]) for r in simhash.kept(docs).collect()) == want
    dealt = sharding.shard_rows(docs, 3)
    assert dealt.columns == [*docs.columns, "shard", "slot"]
    assert sorted((r[0], *r[-n - 2 : -2]) for r in dealt.collect()) == want


def test_parts_of_items_keep_columns_of_any_name(spark):
    docs, want, n = with_taken_names(spark, ["alpha beta gamma delta " * 9, "one two three four five six seven eight nine ten eleven"])
    items = spark.createDataFrame([(k, f"item number {k} of many that are here in parts and more") for k in range(30)], "item_id long, text string")
    kept = decontamination.decontaminated(docs, items, coverage=0.0, part_words=60)
    assert kept.columns == docs.columns and sorted((r[0], *r[-n:]) for r in kept.collect()) == want


def test_one_table_is_left_behind(spark):
    folder = Path(common.shared_folder(spark).removeprefix("file:"))
    tables = lambda: {p for p in folder.iterdir() if re.fullmatch(r"[a-z-]+-[0-9a-f]{32}", p.name)}
    before = tables()
    found = corpus_pipeline.run(spark, SF)
    assert [p.name.rpartition("-")[0] for p in tables() - before] == ["pipeline"]
    assert found.count() > 100


def test_no_stage_is_missing():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == [
        "quality", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "byte_bpe_encoding"
    ]
    assert Path(corpus_pipeline.__file__).parent == Path(__file__).parents[2]
