import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from corvane.llm import packing, scratch, textkernel, tokenfile, tokens

WORDS = "the quick brown fox, jumps over  the lazy dog.\nAnd then\t some more; naïve façade 12345 don't  stop".split(" ")
TEXTS = ["", None, "a", " ", "  two  spaces ", "tab\tand\nline \n x", "naïve café — ünï code　wide", "x" * 5000, "it's don't we'll", "<|endoftext|> literal", "end\x1cof\x85file", "the, the. THE"]
TEXTS += [" ".join(np.random.default_rng(k).choice(WORDS, 40 * k)) for k in range(1, 60)]


def model(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def rows():
    return [(k, t, "en", f"src{k % 3}", k) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string, ids string, start string, length long")


@pytest.mark.parametrize("name,keeps", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_pieces_equal_whole_texts(name, keeps):
    ids, counts = tokens.Pieces(name, keeps, kept=100).encode(pa.array(TEXTS, pa.string()))
    expected = [x.ids for x in model(name).encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]
    assert [len(x) for x in expected] == counts.tolist()
    assert [i for x in expected for i in x] == ids.tolist()


def test_packing_is_exact_and_tight(docs):
    out = packing.pack(docs, with_ids=True).toPandas()
    t = model("word_bpe_49k.json")
    expected = {k: t.encode(x or "", add_special_tokens=False).ids + [1] for k, x in enumerate(TEXTS)}
    for r in out.itertuples():
        own = expected[r.doc_id][r.start : r.start + r.length]
        assert list(r.ids) == own and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and r.doc_tokens == len(expected[r.doc_id])
    assert out.length.sum() == sum(len(expected[r[0]]) for r in rows())
    ordered = out.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    assert ordered.groupby("sequence_id").length.sum().max() <= 2048
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 2048) + 1


def test_empty_tables(spark, docs):
    none = docs.where("false")
    assert packing.pack(none).count() == 0
    at = scratch.path(spark, "t")
    tokenfile.write(none, at)
    assert tokenfile.read(spark, at).count() == 0


def test_plan_holds_the_demand():
    demand = np.array([3, 0, 50, 7, 0, 1, 0, 90])
    patterns, uses = packing.plan(demand, 8)
    assert (patterns.T @ uses == demand).all() and (patterns @ np.arange(1, 9) <= 8).all()
    assert packing.plan(np.zeros(8, int), 8)[1].sum() == 0


def test_knapsack_against_search():
    values = np.array([0.1, 0.35, 0.3, 0.62])
    best = max(a * 0.1 + b * 0.35 + c * 0.3 + d * 0.62 for a in range(10) for b in range(5) for c in range(4) for d in range(3) if a + 2 * b + 3 * c + 4 * d <= 9)
    worth, pattern = packing.knapsack(values, 9)
    assert worth == pytest.approx(best) and pattern @ values == pytest.approx(best) and pattern @ np.arange(1, 5) <= 9


def test_codes_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (r.integers(0, 1 << 32, n, dtype=np.uint64) >> r.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        control, data = tokenfile.encode(v)
        assert len(control) == -(-n // 4) and (tokenfile.decode(control, data, n) == v).all()


def test_token_file(spark, docs):
    at = scratch.path(spark, "t")
    tokenfile.write(docs, at)
    out = tokenfile.read(spark, at, with_ids=True).toPandas().sort_values(["doc_id", "start"])
    t, start = model("byte_bpe_50k.json"), 0
    for r, (k, text, *_) in zip(out.itertuples(), sorted(rows(), key=lambda x: x[0])):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, list(r.ids)) == (k, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def fuzzed(n, seed):
    r = np.random.default_rng(seed)
    some = [*"abcXYZ019 .,;:!?'\"()-_/<>|@#", *"İıŞŞßéÉñžŁœÆ", *"дЯжΣς", *"漢字かな", *"\t\n\r\x00\x1c\x85\u00a0\u2028\u3000\u0307\u0301\ufeff\u200d", *"😀🏽²½Ⅷ", "  ", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "don't", "'S", "İ--", "İ,", "e\u0301..", "the ", "word, ", "ŞİRKETİ. ", "TÜRKİYE'Sİ, "]
    weight = r.random((n, 1)) ** 3
    return ["".join(some[i] for i in r.integers(0, len(some), int(r.integers(1, 24)) + int(20 * w[0]))) for w in weight]


@pytest.mark.parametrize("name,keeps", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
@pytest.mark.parametrize("literal", [False, True])
def test_ids_are_the_library_s_for_any_text(name, keeps, literal):
    """All of them, and so many that some lengths, marks and spaces meet: with special tokens spelled out as well."""
    texts = fuzzed(16_000, 1 + literal)
    t = model(name)
    t.encode_special_tokens = literal
    expected = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    pieces = tokens.Pieces(name, keeps, kept=20_000, literal=literal)
    got = []
    for at in range(0, len(texts), 2000):
        ids, counts = pieces.encode(pa.array(texts[at : at + 2000]))
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    wrong = [(x, a, b) for x, a, b in zip(texts, got, expected) if a != b]
    assert not wrong, (len(wrong), wrong[:3])


def test_blocks_stand_in_ascending_order_and_hot_ids_are_split(spark):
    rows = [(k * 7919 % 600, "w " * (k % 300)) for k in range(600)] + [(300, f"hot {k} " * 40) for k in range(900)] + [(None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    at = scratch.path(spark, "t")
    tokenfile.write(df, at, part_bytes=20_000)
    files = sorted(f for f in os.listdir(f"{at}/blocks") if f.startswith("part-"))
    ids, hot = [], 0
    for f in files:
        one = [-1 if i is None else i for b in pq.read_table(f"{at}/blocks/{f}").to_pylist() for i in b["doc_ids"]]
        hot += 300 in one
        ids += one
    assert ids == sorted(-1 if i is None else i for i, _ in rows) and len(files) > 8 and hot > 4
    out = tokenfile.read(spark, at).toPandas().sort_values("start")
    assert (out.start == out.n_tokens.cumsum() - out.n_tokens).all() and len(out) == len(rows)


def test_words_and_shingles():
    texts = [*TEXTS, "a b c d", "a b c d e", "a b c d e f a b c d e"]
    buf, off = textkernel.raw(pa.array(texts, pa.string()))
    _, _, n = textkernel.words(buf, off)
    assert n.tolist() == [len((t or "").split()) for t in texts]

    def plain(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    assert [len(s) for s in textkernel.sets(pa.array(texts, pa.string()))] == [len(plain(t)) for t in texts]
