import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from corvane.llm import decontam, queries, quality

R = random.Random(8)
WORD = lambda: "".join(R.choice("aeiourtnsl") for _ in range(R.randint(2, 8)))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    texts = [" ".join(WORD() for _ in range(R.randint(30, 90))) for _ in range(120)]
    junk = [" ".join(WORD() + "!!" for _ in range(40)) for _ in range(40)]
    item = " ".join(WORD() for _ in range(20))
    texts[7] = texts[7] + " " + item
    texts[8] += ' token = "0123456789abcdef0123456789abcdef"'
    copies = [texts[3], texts[3] + " x", texts[4]]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate([*texts, *junk, *copies])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, int(k < 120), 0) for k in range(0, 160, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows


def test_stages_take_effect(spark, tables):
    at, rows = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at)
        seen.append((name, {r["doc_id"] for r in docs.select("doc_id").collect()}))
        if name == "secrets":
            text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()}
            assert "[SECRET]" in text[8][0] and "0123456789abcdef" not in text[8][0] and text[8][1] == len(text[8][0])
        if name != "packing":
            assert docs.schema == spark.read.parquet(f"{at}/documents.parquet").schema
    kept = dict(seen)
    good = set(range(120)) | {160, 161, 162}
    assert kept["quality"] == good
    assert kept["near_duplicates"] == set(range(120))
    assert kept["decontamination"] == kept["secrets"] == kept["packing"] == set(range(120)) - {7}


def test_odd_rows(spark, tmp_path):
    """Null and repeated ids, null and empty texts, repeated rows, clashing columns: by text alone, nothing lost."""
    texts = [" ".join(WORD() for _ in range(60)) for _ in range(30)]
    junk = [" ".join(WORD() + "!!" for _ in range(40)) for _ in range(20)]
    item = " ".join(WORD() for _ in range(20))
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, t) for k, t in enumerate(junk)]
    rows += [(None, texts[1] + " x"), (None, texts[2] + " " + item), (5, texts[5]), (5, " ".join(WORD() for _ in range(50))), (None, " ".join(WORD() for _ in range(50))), (7, "y " + texts[7])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), k, 0.5, True) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, key long, p_tail double, keep boolean")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 100), 0) for k in [*range(30), *range(100, 120)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item), (0, item), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.schema == docs.schema
        kept[name] = sorted(r["key"] for r in now.collect())
    good = [k for k, (_, t) in enumerate(rows) if t not in junk]
    assert kept["quality"] == good
    one_of = set(good) - {50, 55} - {5, 52} | {k for k in kept["near_duplicates"] if k in (5, 52)}
    assert set(kept["near_duplicates"]) == one_of and len({5, 52} & one_of) == 1 and {53, 54} <= one_of
    assert kept["decontamination"] == kept["secrets"] == sorted(set(kept["near_duplicates"]) - {51})
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = Counter((r["doc_id"], tuple(model.encode(r["text"], add_special_tokens=False).ids + [1])) for r in now.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in packed) == wanted


def test_empty_tables(spark, tables, tmp_path):
    at, _ = tables
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{at}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "a", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in docs.collect()) == [1, 3]


def test_run_gives_the_last_stage(spark, tables):
    at, _ = tables
    out = corpus_pipeline.run(spark, at)
    assert {"doc_id", "start", "length", "sequence_id", "offset", "ids"} <= set(out.columns)
    assert {r["doc_id"] for r in out.collect()} == set(range(120)) - {7}


def test_every_operator_is_registered_over_whole_tables():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))
    assert quality.LEAST_GRADE == 1 and decontam.THRESHOLD == 0.8 and [n for n, _ in corpus_pipeline.STAGES][0] == "quality"
