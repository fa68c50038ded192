import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import decontam, graph, jaccard, scratch, textkernel

SCHEMA = "doc_id long, text string, lang string, root string, id long"


def shingles(t):
    w = (t or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def corpus(n=60, seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    base = [" ".join(word() for _ in range(r.randint(30, 120))) for _ in range(n)]
    texts = ["", None, "one", "one", "two words", " ", *base]
    for b in base[:15]:
        for edits in (0, 1, 2, 4):
            w = b.split()
            for _ in range(edits):
                w[r.randrange(len(w))] = word()
            texts.append(" ".join(w))
    hub = base[20].split()
    for _ in range(150):  # a group over many blocks
        w = list(hub)
        for _ in range(r.randint(1, 2)):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    return texts


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(k, t, "en", "x", 7) for k, t in enumerate(texts)], SCHEMA)


def brute(texts):
    n = len(texts)
    s, links, parent = [shingles(t) for t in texts], Counter(), list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "")
            if same or (s[i] and s[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]) - 1e-9):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return links, [find(i) for i in range(n)]


def test_join_equals_brute_force(docs, texts):
    links, roots = brute(texts)
    out = jaccard.join(docs, block=16).toPandas().set_index("doc_id")
    assert len(out) == len(texts)
    assert [out.class_id[i] for i in range(len(texts))] == roots
    assert [out.n_links[i] for i in range(len(texts))] == [links[i] for i in range(len(texts))]


def test_deduplicate_keeps_one_of_each_class(docs, texts):
    out = jaccard.deduplicate(docs)
    assert out.schema == docs.schema
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(brute(texts)[1]))


def test_deduplicate_moves_texts_once(spark, docs):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = jaccard.deduplicate(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "Join" in plan and plan.count("Exchange hashpartitioning") == 2  # the documents and the kept ids


def test_many_repeated_rows_without_id(spark):
    rows = [(None, "a b c d e f g", k) for k in range(300)] + [(3, "a b c d e f g", 0)] * 2 + [(None, "q r", 1)] * 2 + [(0, "q r s", 1)]
    got = jaccard.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, n long")).collect()
    assert sorted(got, key=lambda r: r["text"]) == [(3, "a b c d e f g", 0), (None, "q r", 1), (0, "q r s", 1)]


def test_repeated_rows_nulls_and_empty_tables(spark, docs):
    twice = spark.createDataFrame([(1, "a b c d e f", "", "", 1), (1, "a b c d e f", "", "", 1), (None, "x", "", "", 1)], SCHEMA)
    assert sorted(r["doc_id"] or -1 for r in jaccard.deduplicate(twice).collect()) == [-1, 1]
    assert jaccard.join(docs.where("false")).count() == 0
    assert jaccard.deduplicate(docs.where("false")).count() == 0


def test_one_id_may_have_several_texts(spark):
    base, other = (" ".join(f"{p}{i}" for i in range(60)) for p in "bo")
    rows = [(1, base), (1, other), (2, base + " x"), (3, other + " y"), (None, base + " z"), (None, base + " z"), (4, None), (5, "")]
    df = spark.createDataFrame([(i, t, "en", "x", 7) for i, t in rows], SCHEMA)
    got = [(r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in jaccard.join(df, with_class=True).collect()]
    assert Counter(got) == Counter([(1, 1, 3, 1), (1, 1, 1, 1), (2, 1, 3, 1), (3, 1, 1, 1), (None, 1, 3, 2), (None, 1, 3, 2), (4, 4, 1, 2), (5, 4, 1, 2)])
    assert len({r["class_key"] for r in jaccard.join(df, with_class=True).collect()}) == 3
    kept = [(r["doc_id"], r["text"]) for r in jaccard.deduplicate(df).collect()]
    assert len(kept) == 3 and set(kept[:3]) >= {(1, base), (1, other)}
    only = jaccard.join(spark.createDataFrame([(None, "a b c d e f g"), (None, "a b c d e f g")], "doc_id long, text string")).collect()
    assert [(r["class_id"], r["n_links"]) for r in only] == [(None, 1)] * 2


def test_crowded_prefixes_lose_no_link(spark):
    """Texts that share most shingles: prefixes grow, further trees are used, and dense groups are compared by blocks."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    hub, texts = [word() for _ in range(120)], []
    for _ in range(160):
        w = list(hub)
        for _ in range(r.randint(1, 4)):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    links, roots = brute(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for crowd, block, size in ((4, 16, 4_000_000), (16, 128, 9_000)):
        out = jaccard.join(df, crowd=crowd, block=block, block_bytes=size).toPandas().set_index("doc_id")
        found, all_ = sum(out.n_links), sum(links.values())
        assert found <= all_ and found >= 0.998 * all_, (crowd, found, all_)
        assert [out.class_id[i] for i in range(len(texts))] == roots


def test_large_groups_of_copies_and_recall_of_queries(spark):
    """10,000 copies of a text are one node; of ids divisible by 50 against all rows, links are found."""
    texts = corpus(120, 5)
    rows = [*enumerate(texts), *((1000 + k, texts[30]) for k in range(10_000))]
    out = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    links, _ = brute(texts)
    s = [shingles(t) for t in texts]
    near = [k for k in range(len(texts)) if s[k] and len(s[k] & s[30]) >= 0.8 * len(s[k] | s[30]) - 1e-9]
    wanted = {k: links[k] + (10_000 if k in near else 0) for k in range(len(texts))}
    queries = range(0, len(texts), 50)
    assert sum(out.n_links[k] for k in queries) >= 0.9 * sum(wanted[k] for k in queries)
    assert all(out.n_links[k] == wanted[k] for k in wanted) and out.n_copies[1005] == out.n_copies[30] == 10_001


def test_forests_reach_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        f = jaccard.forest(threshold)
        for trees, depth in ((f.first, f.least), (f.trees, f.depth)):
            assert 1 - (1 - threshold**depth) ** trees >= jaccard.RECALL - 1e-12
        assert f.first <= f.trees <= jaccard._MOST_TREES


def test_paths_share_prefixes_as_sets_are_alike():
    words = [f"w{i}" for i in range(400)]
    h, n = textkernel.shingles(*textkernel.raw(pa.array([" ".join(words[:360]), " ".join(words[:324]), " ".join(words), ""])))
    p = jaccard._paths(h, n, 40, 7)
    same = (p[0] >> 54 == p[1] >> 54).mean()
    assert p.shape == (3, 40) and 0.75 < same <= 1 and (p >= 0).all()


def test_unrelated_texts_do_not_meet_by_chance(spark):
    """Pairs that meet by chance grow with the square of the table: with prefixes of 27 bits some 19 of these texts' would."""
    h = np.random.default_rng(3).integers(0, 1 << 63, 20_000 * 20, dtype=np.uint64) * np.uint64(2)
    f = jaccard.forest()
    p = jaccard._paths(h, np.full(20_000, 20), f.trees, f.depth)
    texts = spark.createDataFrame(pa.table({"node": np.arange(len(p)), "paths": pa.array(list(p))}))
    assert jaccard.meetings(texts, f, jaccard.CROWD).count() <= 2


def test_tries_are_found_without_a_join(spark, docs, monkeypatch):
    plans, keep = {}, scratch.keep
    monkeypatch.setattr(scratch, "keep", lambda df, name, *a: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and keep(df, name, *a))
    jaccard.join(docs, crowd=4)
    assert "Join" not in plans["met"] and "Join" in plans["placed"]


def test_meetings_over_many_ranges(spark):
    """A path that half of the texts share goes over several ranges; nodes are those of plain tries."""
    f, crowd, r = jaccard.forest(), 5, random.Random(2)
    shift = lambda d: sum(jaccard.BITS[d:])
    paths = [[0 if k % 2 else (r.randrange(40) << shift(3)) + r.choice([0, 1 << shift(4), 3]) for _ in range(f.trees)] for k in range(400)]

    def tries(nodes, trees):
        out, deep = [], set()
        for t in trees:
            n = Counter((d, paths[k][t] >> shift(d)) for k in nodes for d in range(f.least, f.depth + 1))
            at = {}
            for k in nodes:
                d = next((d for d in range(f.least, f.depth) if n[d, paths[k][t] >> shift(d)] <= crowd), f.depth)
                if n[d, paths[k][t] >> shift(d)] > 1:
                    at.setdefault((d, paths[k][t] >> shift(d)), set()).add(k)
            out += map(frozenset, at.values())
            deep |= {k for (d, _), some in at.items() if d > f.least for k in some}
        return out, deep

    first, deep = tries(range(400), range(f.first))
    expected = Counter(first + tries(sorted(deep), range(f.first, f.trees))[0])
    texts = scratch.keep(spark.createDataFrame(list(enumerate(paths)), "node long, paths array<long>"), "texts")
    held = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for c, v in zip(held, ("37", "false")):
            spark.conf.set(c, v)
        got = jaccard.meetings(texts, f, crowd).collect()
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)
    groups, least = {}, {}
    for x in got:
        groups.setdefault(x["bucket"], []).append(x["node"])
        least.setdefault(x["bucket"], set()).add(x["least"])
    assert Counter(frozenset(g) for g in groups.values()) == expected
    assert all(len(g) == len(set(g)) for g in groups.values())
    assert all(x["n"] == len(groups[x["bucket"]]) for x in got)
    assert all(least[b] == {min(g)} for b, g in groups.items() if len(g) > crowd) and any(len(g) > 150 for g in groups.values())


def test_texts_that_meet_none_do_not_move(spark):
    rows = [(k, f"text number {k}") for k in range(4000)] + [(5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for some in (docs.where("doc_id % 100 = 7"), docs.where("false")):
        wanted = some.select(jaccard._key(F.col("text")).alias("key"))
        got = jaccard._picked(docs, wanted)
        assert got.count() <= some.count() + 100
        assert {r["text"] for r in got.join(wanted, "key").collect()} == {r["text"] for r in some.collect()}


def test_overlaps():
    sets = textkernel.sets(pa.array(["a b c d e f g", "b c d e f g h", "q", ""]))
    got = jaccard.overlaps(sets)
    assert got[0, 1] == 2 and got[0, 2] == 0 and got[3].sum() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 105), (105, 102), (7, 7)]
    out = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{k: 0 for k in range(1, 41)}, 105: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination_equals_brute_force(spark, texts):
    r = random.Random(9)
    items, rows = [], list(texts)
    for k in range(30):
        w = (texts[r.randrange(6, 40)] or "").split()
        a = r.randrange(max(1, len(w) - 20))
        items.append(" ".join(w[a : a + r.randint(3, 20)]))
        edited = items[-1].split()
        if len(edited) > 8:
            edited[r.choice([0, -1])] = "other"
        rows.append(" ".join((texts[k + 6] or "").split()[:10] + edited + (texts[k + 7] or "").split()[:10]))
    items += ["", None, "two words"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    bench = spark.createDataFrame([(k, t, k) for k, t in enumerate(items)], "item_id long, text string, doc_id long")
    expected = {(i, k) for i, t in enumerate(rows) for k, b in enumerate(items) if shingles(b) and len(shingles(t) & shingles(b)) >= 0.8 * len(shingles(b)) - 1e-9}
    for block in (decontam.BLOCK_CHARS, 200):
        assert {(x["doc_id"], x["item_id"]) for x in decontam.matches(docs, bench, block_chars=block).collect()} == expected
    kept = {x["doc_id"] for x in decontam.clean(docs, bench).collect()}
    assert kept == set(range(len(rows))) - {i for i, _ in expected} and expected
    assert decontam.matches(docs, bench.where("false")).count() == 0 and decontam.clean(docs.where("false"), bench).count() == 0


def test_decontamination_of_odd_rows(spark, texts):
    """Null and repeated ids on both sides, repeated and long items, clashing names, empty tables."""
    item, other = " ".join(texts[10].split()[:25]), " ".join(texts[12].split()[:9])
    rows = [(None, f"x {item} y", 1), (1, f"x {item} y", 2), (1, "clean text of some words here", 3), (1, "clean text of some words here", 3), (None, None, 4), (2, other * 1, 5), (None, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id long")
    items = [(7, item), (7, item), (8, item), (None, other), (9, None), (9, ""), (10, " ".join(f"long{k}" for k in range(4000)))]
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, n_common long")
    for chars in (decontam.BLOCK_CHARS, 100):
        found = Counter((r["doc_id"], r["item_id"]) for r in decontam.matches(docs, bench, block_chars=chars).collect())
        assert found == Counter([(i, k) for i in (None, 1) for k in (7, 7, 8)] + [(2, None)])
        kept = decontam.clean(docs, bench, block_chars=chars)
        assert kept.schema == docs.schema and sorted(r["item_id"] for r in kept.collect()) == [3, 3, 4, 6]
    assert decontam.matches(docs, bench.where("false")).count() == 0 and decontam.clean(docs, bench.where("false")).count() == len(rows)
    assert decontam.matches(docs.where("false"), bench).count() == 0


def test_folded_decontamination(spark):
    item = "The quick brown fox jumps over the lazy dog near the old stone bridge in Weißdorf"
    rows = [f"before {item.upper()} after", "x " + " ".join(f"«{w}»," for w in item.split()) + " y", f"so — {item}", "it says: Forty Two! again", "forty and two", "a \u3000“FORTY\u00a0two…”", None, "!!"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    bench = spark.createDataFrame([(0, item), (1, "forty two"), (2, ""), (3, None), (4, "...")], "item_id long, text string")
    found = lambda **o: {(x["doc_id"], x["item_id"]) for x in decontam.matches(docs, bench, **o).collect()}
    assert found() == {(2, 0)}
    assert found(folded=True) == {(0, 0), (1, 0), (2, 0), (3, 1), (5, 1)}
    assert {x["doc_id"] for x in decontam.clean(docs, bench, folded=True).collect()} == {4, 6, 7}
