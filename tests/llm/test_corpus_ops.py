"""Operators 2, 5, 6 and 8 against brute force, on small tables with every awkward row."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from lexiloom.llm import decontam, jaccard, quality, sharding
from lexiloom.llm.components import components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, n_words string"


def table(spark, texts):
    """Documents with clashing extra columns; ids in order."""
    return spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or ""), "x", "y") for i, t in enumerate(texts)], SCHEMA)


def awkward(seed=1, n=60):
    rng = random.Random(seed)
    words = ["the", "Of", "é", "and,", "x#", "日本", "b&c", "!!", "a|b", "\x00z"]
    gaps = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b"]
    out = [None, "", " \n ", "one", "a b c d e f g h " * 30, "same line\nsame line\n\nsame line", "w " * 30_000]
    for _ in range(n):
        out.append("".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 80))))
    return out + out[5:9]


def test_quality_measures(spark):
    texts = awkward()
    rows = {r.doc_id: r for r in quality.query(table(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        wins = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        count = collections.Counter(wins)
        cover = {p for k, x in enumerate(wins) if count[x] > 1 for p in range(k, k + 8)}
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)), i
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w))
        assert not (r.base_failed and r.kept)


def test_policies_and_ablation(spark):
    good, shout, few = "plain words go on and on " * 1 + " ".join(f"word{i}" for i in range(30)), " ".join(f"LOUD{i}" for i in range(40)), "too few"
    led = quality.ledger(table(spark, [good, shout, few, good]))
    kept = {r.doc_id: r.kept for r in quality.apply_policy(led, quality.POLICIES["corpus", 1]).collect()}
    assert kept == {0: True, 1: False, 2: False, 3: True}
    assert {r.doc_id: r.kept for r in quality.apply_policy(led, quality.BASE).collect()}[1]
    found = {(r.policy, r.version, r.rule): r for r in quality.ablation(led).collect()}
    r = found["corpus", 1, "SHOUTING"]
    assert (r.n_docs, r.n_failed, r.n_only, r.n_kept_without) == (4, 1, 1, 3)


def test_quality_rows_keep_columns(spark):
    docs = table(spark, ["too few", " ".join(f"word{i}" for i in range(30)), None])
    rows = quality.kept_rows(docs, quality.BASE)
    assert rows.columns == docs.columns
    assert [tuple(r) for r in rows.collect()] == [tuple(r) for r in docs.where("doc_id = 1").collect()]


def groups(docs):
    """Set sizes and components by comparing all pairs."""
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                o = len(sets[a] & sets[b])
                if 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(seed=5, n_groups=30):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(n_groups):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 6, 8, 10, 14, 25, 60, 150]))]
        for _ in range(rng.choice([1, 2, 3, 8, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w[: max(1, len(w) - rng.choice([0, 0, 0, 3]))]))
    passage = " ".join(rng.choice(words) for _ in range(40))
    return [*out, *(passage + " " + " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(60)), None, "", " \n", "A b", "a  B"]


@pytest.mark.parametrize("limits", [{}, {"hot_count": 4, "hot_keys": 1 << 12, "bitmap_bits": 16}])
def test_jaccard_components(spark, limits):
    texts = near_copies()
    rows = jaccard.join_components(table(spark, texts), **limits).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == groups(list(enumerate(texts)))


def test_jaccard_null_ids_and_empty_tables(spark):
    one = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(None, one), (4, one), (2, one), (2, one)], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.join_components(docs).collect())
    assert got == [(0, 26, None), (2, 26, 2), (2, 26, 2), (4, 26, 2)]
    assert jaccard.join_components(docs.limit(0)).count() == 0


def test_boundary_follows_cost():
    assert jaccard.choose_boundary({5: 1000, 40: 1000}, again=0.0, list_length=5) == 0
    low = jaccard.choose_boundary({n: 100 for n in range(1, 60)}, again=0.9, list_length=2)
    high = jaccard.choose_boundary({n: 100 for n in range(1, 60)}, again=0.1, list_length=500)
    assert low < high


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 103), (103, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 103: 100}


def contaminated(docs, items):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = low(t)
        m = min(13, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[k : k + m])].add(str(i))
    out = {}
    for i, t in docs:
        w, hit, found = low(t), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if o := windows.get(tuple(w[k : k + m])):
                    hit.update(range(k, k + m))
                    found |= o
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("block_words", [decontam.BLOCK_WORDS, 60])
def test_decontamination(spark, block_words):
    rng = random.Random(3)
    words = ["Alpha", "beta", "x1", "é", "of", "the"]
    make = lambda n: " ".join(rng.choices(words, k=n))
    items = [(10, make(30)), (9, make(20)), (2, make(13)), (3, "the of é"), (4, "Zeta"), (5, None), (6, ""), (10, make(5)), (11, "!!")]
    texts = [None, "", "!!", "zeta", "ZETA-zeta"] + [f"{make(rng.randint(0, 400))}. {rng.choice(items)[1] or ''}, {make(rng.randint(0, 30))}" for _ in range(80)] + [" ".join(["of"] * 20_000)]
    items_df = spark.createDataFrame(items, "item_id bigint, text string")
    rows = decontam.contamination(table(spark, texts).select("doc_id", "text"), items_df, block_words=block_words).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows}
    assert got == contaminated(list(enumerate(texts)), items)


def test_decontamination_without_items(spark):
    rows = decontam.query(table(spark, ["a b", None]), spark.createDataFrame([], "item_id bigint, text string")).collect()
    assert [(r.n_hit, r.contaminated) for r in rows] == [(0, False)] * 2


def test_hilbert_curve_is_a_walk():
    import itertools

    import numpy as np

    for dims, bits in ((2, 4), (3, 3)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=dims))).T
        index = sharding.hilbert_index(points, bits)
        assert sorted(index) == list(range(len(index)))
        assert set(np.abs(np.diff(points[:, np.argsort(index)], axis=1)).sum(0)) == {1}


@pytest.mark.parametrize("n", [0, 3, 8, 75])
def test_shards(spark, n):
    texts = (awkward() + ["same", "same", None])[:n]
    docs = table(spark, texts)
    if n > 5:
        docs = docs.unionByName(docs.limit(2))
    rows = sharding.query(docs).collect()
    assert len(rows) == docs.count()
    by = collections.defaultdict(list)
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "rows", None)
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_written_shards_can_be_pruned(spark, tmp_path):
    docs = table(spark, [f"text {i} " * (i % 40) for i in range(200)]).select("doc_id", "text", "lang", "source", "n_chars")
    files = sharding.write_shards(docs, str(tmp_path / "out")).cache()
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.doc_id for r in back.collect()) == list(range(200))
    assert 0 < sharding.prune(files, source=("src1", "src1")).count() < files.count()
