"""Near duplicates, components and the pipeline against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from lathe.llm import neardup, packing, pii, quality, toxicity
from lathe.llm.components import components
from lathe.llm.neardup import Settings, find_near_duplicates
from tests.llm.conftest import HARD, SF

WORDS = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORDS.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for k, own in enumerate(sets):
        for s in own:
            holders[s].append(k)
    common = Counter((a, b) for v in holders.values() for k, b in enumerate(v) for a in v[:k])
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    return sorted((i, len(sets[k]), min(least[find(k)])) for k, (i, _) in enumerate(rows) if i is not None)



def test_few_links_come_in_few_files(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for key, value in zip(kept, ("40", "false")):
            spark.conf.set(key, value)
        rows = components(spark.range(300).selectExpr("id * 2 a", "id * 2 + id % 3 * 2 b"))
        assert len(rows.inputFiles()) == 1 and rows.rdd.getNumPartitions() == 2
        links = [(2 * k, 2 * k + k % 3 * 2) for k in range(300)]
        root = {x: x for link in links for x in link}
        for _ in range(len(links)):
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        linked = {x for a, b in links if a != b for x in (a, b)}
        assert sorted(map(tuple, rows.collect())) == sorted((x, root[x]) for x in linked)
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)


def found(df, settings=Settings()):
    rows = find_near_duplicates(df, settings).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows if r["doc_id"] is not None)
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None)


def variants(n, seed):
    """Texts around some bases, with few or many changes, joined pieces, and very short ones."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    bases = [[rng.choice(words) for _ in range(rng.randint(8, 60))] for _ in range(8)]
    rows = []
    for k in range(n):
        own = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            own[rng.randrange(len(own))] = rng.choice(words)
        if rng.random() < 0.3:
            own += rng.choice(bases)[: rng.randint(0, 20)]
        rows.append((k * 3 - 100, " ".join(own)))
    return rows + [(5000 + k, " ".join(rng.choices(words[:3], k=rng.randint(0, 9)))) for k in range(n // 3)]


def test_query_equals_brute_force(spark, docs, rows):
    assert found(docs) == brute(rows)


@pytest.mark.parametrize("settings", [Settings(), Settings(block=4, stars=3)])
def test_hard_groups(spark, settings):
    rows = variants(240, 5)
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), settings) == brute(rows)


def test_hard_rows(hard, empty):
    assert found(hard) == brute(HARD)
    assert found(empty) == []


def test_block_links_join_components():
    sets = [np.array(s, np.uint64) for s in ([1, 2, 3, 4], [1, 2, 3, 4, 5], [1, 2, 3, 9, 10], [20, 21])]
    assert neardup.block_links(sets, [0, 1, 2, 3], 75) == [(0, 1)]
    assert neardup.block_links(sets, [0, 0, 2, 3], 75) == []


def test_signatures_estimate_likeness():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
    for n in (4, 40, 400):
        a, b = np.unique(pool[:n]), np.unique(pool[n // 4 : n])
        same = (neardup.signature(a, 4096) == neardup.signature(b, 4096)).mean()
        assert abs(same - len(b) / len(a)) < 0.06


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(k, k + 1) for k in range(200, 260)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {n: find(n) for a, b in edges if a != b for n in (a, b)}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)


def test_keep_one(spark, hard):
    rows = variants(60, 8)
    df = spark.createDataFrame([(*r, "x") for r in rows + rows[:5]], "doc_id long, text string, kept string")
    kept = neardup.keep_one(df)
    want = {c for _, n, c in brute(rows) if n} | {i for i, n, _ in brute(rows) if not n}
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    left = Counter(r["doc_id"] for r in neardup.keep_one(hard).collect())
    assert left[7] == 1 and left[5] == 2 and left[None] == 0


def test_keep_one_keeps_each_class(spark):
    """Rows with null ids or one id and unlike texts are classes of their own."""
    text = lambda k: " ".join(f"{k}w{j}" for j in range(12))
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (None, text(3)), (None, ""), (None, None)]
    rows += [(3, text(4)), (3, text(5)), (3, ""), (3, " "), (4, text(5)), (6, text(6)), (6, text(6)), (6, "")]
    rows += [(None, text(6)), (-(2**63), text(7)), (None, text(7))]
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, text(k)) for k in (1, 2, 3)] + [(None, ""), (None, None), (3, text(4)), (3, text(5)), (3, ""), (3, " ")]
    want += [(6, text(6)), (6, ""), (-(2**63), text(7))]
    assert Counter(map(tuple, kept)) == Counter(want)


def test_pipeline_stages(spark, docs):
    """Each stage against its operator's own verdicts on its predecessor's rows."""
    columns = docs.columns
    kept = corpus_pipeline.drop_toxic(spark, docs, SF).cache()
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.op10_toxicity(spark, SF).collect()}
    assert kept.columns == columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, p in scores.items() if not p}
    good = corpus_pipeline.drop_bad(spark, kept, SF).cache()
    verdicts = {r["doc_id"] for r in quality.assess(kept).collect() if r["kept"]}
    assert {r["doc_id"] for r in good.collect()} == verdicts and good.columns == columns
    single = corpus_pipeline.drop_near_duplicates(spark, good, SF).cache()
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert {r["doc_id"] for r in single.collect()} == {i for i, _, c in brute(rows) if i == c} and single.columns == columns
    clean = corpus_pipeline.take_out_personal(spark, single, SF).cache()
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in clean.collect():
        assert not pii.base_spans(r["text"]) or r["text"] == before[r["doc_id"]] or r["n_chars"] == len(r["text"])
        assert ("[" in r["text"]) >= bool(pii.base_spans(before[r["doc_id"]])) and r["n_chars"] >= 0
    pieces = corpus_pipeline.pack(spark, clean, SF).collect()
    assert {p["doc_id"] for p in pieces} == set(before)
    assert sum(p["length"] for p in pieces) == sum({p["doc_id"]: p["doc_tokens"] for p in pieces}.values())
    assert len(corpus_pipeline.STAGES) == 5 and packing.CAPACITY == 2048
    assert corpus_pipeline.run(spark, SF).count() == len(pieces)


def test_pipeline_stages_take_hard_rows(spark, hard, empty):
    """Every stage by itself over nulls, empty and long texts, repeated rows and clashing columns, and over no rows."""
    given = [tuple(r) for r in hard.collect()]
    at = hard.columns.index("text")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, hard, SF)
        assert kept.columns == hard.columns and stage(spark, empty, SF).collect() == [], name
        rows = [tuple(r) for r in kept.collect()]
        if name == "personal data":
            assert len(rows) == len(given) and sum(r[at] is None for r in rows) == 1
            continue
        assert not Counter(rows) - Counter(given), name
        texts = Counter(r[at] for r in rows)
        if name == "toxicity":
            # The verdict follows the text alone, and a null is as an empty text.
            assert all(texts[t] in (0, n) for t, n in Counter(r[at] for r in given).items())
            assert (texts[None] > 0) == (texts[""] > 0)
        if name == "quality rules":
            assert not texts[None] and not texts[""] and not texts[" \t\n\x0b\r "]
        if name == "near duplicates":
            assert texts[None] == texts[""] == 1 and texts["one two three four five six"] == 1
    pieces = corpus_pipeline.pack(spark, hard, SF).collect()
    assert Counter(p["doc_id"] for p in pieces if not p["start"]) == Counter(r[0] for r in given)
    assert corpus_pipeline.pack(spark, empty, SF).collect() == []
