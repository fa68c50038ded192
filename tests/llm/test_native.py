import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from corvane.llm import chat, schemas, syncmers

TEXTS = ["", None, "one", "a b c d", "a b c d e", "wörter über " * 50, "x" * 300, "😀 emoji 😀 text with surrogate 😀 pairs and more words here", " ".join(f"w{i % 37}" for i in range(400)), "one"]


def plain(df):
    import re

    text = df._jdf.queryExecution().executedPlan().toString()
    return not re.search("Python|Pandas|Arrow|MapInPandas", text)


def test_fingerprints(spark):
    rows = [(k * 3 - 5, t, "h", k) for k, t in enumerate(TEXTS)]
    df = syncmers.edited(spark.createDataFrame(rows, "doc_id long, text string, hashes string, id int"))
    assert plain(df)
    out = {r["doc_id"]: r for r in df.collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    for (k, t, *_), (_, u, *_) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        assert out[k]["n_chars"] == len(t) and out[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= out[k]["near_edited"] <= 1 and 0 <= out[k]["near_next"] <= 1
    by_text = {}
    for k, t, *_ in rows:
        assert by_text.setdefault(t or "", out[k]["fingerprint"]) == out[k]["fingerprint"]
    assert out[1]["fingerprint"] != out[4]["fingerprint"]


def test_chosen_anchors_against_a_plain_version(spark):
    text = " ".join(f"w{(i * i) % 53}" for i in range(300))
    units = text.split()
    hashed = spark.createDataFrame([(units,)], "u array<string>").select(F.transform("u", lambda u: F.xxhash64(u)).alias("h")).first()["h"]
    pairs = list(zip(hashed, hashed[1:]))
    inner = [r["s"] for r in spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a long, b long").select("i", F.xxhash64("a", "b").alias("s")).orderBy("i").collect()]
    chosen = [i for i in range(len(units) - syncmers.K + 1) if min(inner[i : i + 4]) in (inner[i], inner[i + 3])]
    got = spark.createDataFrame([(text,)], "t string").select(syncmers.anchors(F.col("t")).alias("a")).first()["a"]
    assert len(got) == len(chosen)
    expected = [r["x"] for r in spark.createDataFrame([(i, inner[i], inner[i + 3], hashed[i + 2]) for i in chosen], "i int, a long, b long, c long").select("i", F.xxhash64("a", "b", "c").alias("x")).orderBy("i").collect()]
    assert got == expected


def test_places_of_anchors_against_a_plain_version(spark):
    texts = [" ".join(f"w{(i * i) % 53}" for i in range(300)), "a b", "", None, "w1 w2 w3 w4 w5 w6 " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashes = {r["doc_id"]: r["p"] for r in df.select("doc_id", syncmers.placed(F.coalesce("text", F.lit(""))).alias("p")).collect()}
    out = {r["doc_id"]: r for r in syncmers.edited(df).collect()}
    for k, found in hashes.items():
        first: dict[int, int] = {}
        for x in found:
            first.setdefault(x["hash"], x["at"])
        best = sorted(first)[: syncmers.SIZE]
        assert out[k]["fingerprint"] == ",".join(f"{h & (1 << 64) - 1:016x}" for h in best)
        assert out[k]["places"] == ",".join(str(first[h]) for h in best)
        mine, other = (set(zip(out[k][a].split(","), out[k][b].split(","))) for a, b in (("fingerprint", "places"), ("edited_fingerprint", "edited_places")))
        assert out[k]["in_place"] == len({x for x in mine & other if x[0]})
    assert 0 < out[0]["in_place"] < len(hashes[0])


def test_anchors_survive_edits_elsewhere(spark):
    a = " ".join(f"w{(i * i) % 151}" for i in range(400))
    b = "some new start of the text " + a
    sets = [set(r["a"]) for r in spark.createDataFrame([(a,), (b,)], "t string").select(syncmers.anchors(F.col("t")).alias("a")).collect()]
    assert len(sets[0] - sets[1]) == 0 and len(sets[1] - sets[0]) <= 8


def test_ranges_and_neighbours(spark):
    ids = [k * k * 7 - 900 for k in range(300)] + [5, 5]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, text string").repartition(5)
    out = sorted(((r["id"], r["next_text"]) for r in syncmers.with_next(df, ["text"]).collect()), reverse=True)
    order = sorted(ids, reverse=True)
    assert [x for x, _ in out] == order and [n for _, n in out] == [f"t{i}" for i in order[1:] + order[:1]]
    spans = {r[0] for r in spark.range(2000).select(syncmers._bisect(F.array(*[F.lit(100 * k) for k in range(1, 20)]), F.col("id"), 19)).collect()}
    assert spans == set(range(20))


def test_empty_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert syncmers.edited(none).count() == 0
    got = syncmers.edited(spark.createDataFrame([(None, "abcd"), (1, "wxyz")], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["edited_sha256"]) for r in got} == {(None, hashlib.sha256(b"abwx").hexdigest()), (1, hashlib.sha256(b"wxab").hexdigest())}


CALL = json.dumps({"content": None, "tool_calls": [{"id": "c1", "name": "add", "arguments": {"b": 2, "a": 1}}, {"id": "c2", "name": "add", "arguments": {"a": "x"}}, {"id": "c3", "name": "nope", "arguments": {}}]})
TOOLS = [("add", json.dumps({"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"type": "number"}}})), ("say", None)]


@pytest.fixture(scope="module")
def formatted(spark):
    rows = [
        (1, 0, "user", 'hi "there"\n'),
        (1, 1, "tool", json.dumps({"tool_call_id": "c2", "content": "early"})),
        (1, 2, "assistant", CALL),
        (1, 3, "tool", json.dumps({"tool_call_id": "c1", "content": "3"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "zz", "content": "orphan"})),
        (1, 5, "assistant", json.dumps({"tool_calls": [{"id": "c1", "name": "add", "arguments": {"a": 2}}]})),
        (1, 6, "assistant", "{not json"),
        (2, None, None, None),
        (2, 7, "user", "x"),
        (2, 7, "user", "x"),
        (None, 1, "user", "n"),
        (3, 300, "user", "late run"),
        (3, 1, "user", "first"),
    ]
    messages = spark.createDataFrame([(*r, "clash", 9) for r in rows], "conv_id long, turn long, role string, text string, conv string, position int")
    df = chat.format_chat(messages, spark.createDataFrame(TOOLS, "name string, parameters string"))
    assert plain(df)
    return {(r["conv_id"], r["position"]): r for r in df.collect()}


def test_links_order_and_validity(formatted):
    turns = [formatted[1, p]["turn"] for p in range(7)]
    assert turns == [0, 2, 1, 3, 4, 5, 6]  # the early result goes behind its call
    call = formatted[1, 1]
    assert (call["n_calls"], call["n_answered"], call["args_valid"]) == (3, 2, False)
    assert formatted[1, 2]["call_turn"] == 2 and formatted[1, 3]["call_turn"] == 2 and formatted[1, 4]["call_turn"] is None
    again = formatted[1, 5]
    assert (again["n_calls"], again["n_answered"], again["args_valid"]) == (1, 0, True)
    assert [formatted[3, p]["turn"] for p in (0, 1)] == [1, 300] and {(2, 0), (2, 1), (2, 2), (None, 0)} <= set(formatted) and len(formatted) == 13


def test_canonical_json(formatted):
    assert formatted[1, 0]["json"] == '{"content":"hi \\"there\\"\\n","role":"user"}'
    assert formatted[2, 0]["json"] == '{"content":null,"role":null}' and formatted[1, 6]["json"] == '{"content":"{not json","role":"assistant"}'
    got = json.loads(formatted[1, 1]["json"])
    assert got["tool_calls"][0] == {"arguments": {"a": 1, "b": 2}, "id": "c1", "name": "add"}
    assert formatted[1, 1]["json"] == json.dumps(got, sort_keys=True, separators=(",", ":"))
    assert formatted[1, 3]["json"] == '{"content":"3","role":"tool","tool_call_id":"c1"}'


def test_no_tools_no_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chat(none).count() == 0
    one = chat.format_chat(spark.createDataFrame([(1, 1, "assistant", CALL)], none.schema)).first()
    assert one["args_valid"] is None and one["n_calls"] == 3


def test_one_character_in_a_text_without_spaces(spark):
    r = random.Random(5)
    a = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(3000))
    texts = [a, a[:10] + "新" + a[10:], "see " + "/".join(a[k : k + 9] for k in range(0, 90, 9)) + " end"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", syncmers.anchors(F.col("t")).alias("a"), syncmers.fingerprint(F.col("t")).alias("f"))
    sets = {x["k"]: set(x["a"]) for x in rows.collect()}
    assert len(sets[0]) > 500 and len(sets[0] ^ sets[1]) <= 12 and sets[2]
    pair = rows.where("k = 0").select(F.col("f").alias("x")).crossJoin(rows.where("k = 1").select(F.col("f").alias("y")))
    assert pair.select(syncmers.likeness(F.col("x"), F.col("y")).alias("s")).first()["s"] > 0.9


SCHEMA_CASES = [
    ({"type": ["integer", "null"]}, [1, None, 1.0], ["no", 1.5, True]),
    ({"enum": [5, "a", None, True]}, [5, 5.0, "a", None, True], [1, "5", False, "A"]),
    ({"const": {"b": [1], "a": 2}}, [{"a": 2, "b": [1]}], [{"a": 2}, 2]),
    ({"type": "object", "properties": {"p": {"type": "object", "required": ["q"], "properties": {"q": {"type": "string"}}}}, "additionalProperties": False}, [{}, {"p": {"q": "x"}}], [{"p": {}}, {"p": {"q": 1}}, {"z": 1}, [], None]),
    ({"additionalProperties": {"type": "number"}, "properties": {"s": True}}, [{"s": "x", "n": 1}, 7], [{"n": "x"}]),
    ({"type": "array", "items": {"type": "integer", "minimum": 1, "exclusiveMaximum": 9}, "minItems": 1, "maxItems": 3, "uniqueItems": True}, [[1], [1, 2, 8]], [[], [0], [9], [1, 1], [1, 2, 3, 4], {}]),
    ({"type": "string", "minLength": 2, "maxLength": 3, "pattern": "^a"}, ["ab", "aé😀"], ["a", "abcd", "ba", 3]),
    ({"anyOf": [{"type": "string"}, {"minimum": 3}], "not": {"const": 4}}, ["x", 3, 5], [2, 4]),
    ({"oneOf": [{"multipleOf": 2}, {"multipleOf": 3}], "allOf": [{"type": "integer"}]}, [2, 9], [6, 5, "x"]),
    ({"minProperties": 1, "maxProperties": 1, "required": ["a"]}, [{"a": None}], [{}, {"a": 1, "b": 2}, {"b": 1}]),
    (True, [1, None], []),
    (False, [], [1, None]),
]


def test_schemas(spark):
    for schema, right, wrong in SCHEMA_CASES:
        df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(right + wrong)], "k int, t string")
        out = [r["ok"] for r in df.select("k", schemas.fits(schema, F.parse_json("t")).alias("ok")).orderBy("k").collect()]
        assert out == [True] * len(right) + [False] * len(wrong), schema
    for schema in ({"$ref": "#/x"}, {"properties": {"a": {"if": {}}}}, {"type": "int"}, 5):
        with pytest.raises(ValueError):
            schemas.fits(schema, F.parse_json(F.lit("{}")))


def test_no_member_is_lost_and_arguments_may_be_text(spark):
    call = {"reasoning": "why", "role": "other", "tool_calls": [{"type": "function", "id": "c", "name": "add", "arguments": json.dumps({"a": 1})}]}
    result = {"tool_call_id": "c", "status": {"z": 1, "a": [None, "é "]}, "content": None}
    twice = '{"content": 1, "content": 2, "tool_calls": []}'
    rows = [(1, 0, "assistant", json.dumps(call)), (1, 1, "tool", json.dumps(result)), (1, 2, "assistant", twice)]
    tools = spark.createDataFrame(TOOLS, "name string, parameters string")
    out = {r["turn"]: r for r in chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tools).collect()}
    dump = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert out[0]["json"] == dump(call | {"role": "assistant", "content": None}) and out[0]["args_valid"] and out[0]["n_answered"] == 1
    assert out[1]["json"] == dump(result | {"role": "tool"}) and out[2]["json"] == dump({"content": twice, "role": "assistant"})


def test_one_conversation_with_most_rows(spark):
    """Its rows, equal ones too, are spread over ranges; positions are whole."""
    rows = [(1, k % 50, "user", "same") for k in range(3000)] + [(None, None, "user", "x")] * 500 + [(k, 0, "user", "y") for k in range(2, 300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    out = chat.format_chat(df).toPandas()
    big = out[out.conv_id == 1].sort_values("position")
    assert big.position.tolist() == list(range(3000)) and big.turn.is_monotonic_increasing
    assert sorted(out[out.conv_id.isna()].position) == list(range(500)) and (out[out.conv_id > 1].position == 0).all()


def test_tool_traffic_links_and_validates(spark):
    rows = [(k, t, "assistant" if t % 2 else "user", "w" * (5 * k + t)) for k in range(12) for t in range(6)]
    df = chat.with_tool_traffic(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = chat.format_chat(df, spark.createDataFrame(chat.TOOLS, "name string, parameters string")).collect()
    linked = [r for r in out if r["role"] == "tool"]
    assert linked and all(r["call_turn"] is not None for r in linked) and any(r["turn"] < r["call_turn"] for r in linked)
    assert {r["args_valid"] for r in out} == {True, False, None} and {r["n_answered"] for r in out if r["n_calls"]} == {0, 1}
    at = {(r["conv_id"], r["turn"], r["role"]): r["position"] for r in out}
    assert all(at[r["conv_id"], r["call_turn"], "assistant"] < r["position"] for r in linked)
