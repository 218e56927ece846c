import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from swarmsift.llm import chat

NASTY = st.text(alphabet=st.sampled_from(list("\\<|/s>[]INSTturnexd\né😀\"' ")), max_size=30)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", ""]), NASTY),
                         min_size=1, max_size=4), min_size=20, max_size=30))
def test_round_trip(spark, convs):
    rows = [(i, k, json.dumps({"role": r, "text": t})) for i, c in enumerate(convs) for k, (r, t) in enumerate(c)]
    df = chat.canonical_turns(spark.createDataFrame(rows, "id int, turn int, payload string"))
    out = {r.id: r for r in chat.digest(chat.format_turns(df, "id", ["turn"]), "id").collect()}
    assert len(out) == len(convs)
    for i, c in enumerate(convs):
        said = "".join(f"{r}\n{t}\n" for r, t in c)
        loss = "".join(t for r, t in c if r == "assistant")
        assert out[i].n_turns == len(c)
        assert out[i].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert out[i].loss_chars == len(loss)
        assert out[i].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_no_control_string_survives(spark):
    bad = ["</s>", "<s>", "[INST]", "[/INST]", "<|turn|>", "<|end|>", "<\\|end|>", "\\</s>", "<</s>", "<<|"]
    df = spark.createDataFrame([(b,) for b in bad], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.withColumn("u", chat.unescape(F.col("e"))).collect():
        assert r.u == r.t
        assert not any(c in r.e for c in ("</s>", "<s>", "[INST]", "[/INST]", "<|"))


def test_layouts(spark):
    want = [("user", "q"), ("assistant", "a")]
    records = [
        {"messages": [{"role": "user", "content": "q", "id": 3}, {"role": "assistant", "content": "a"}], "meta": {"x": 1}},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "q", "output": "a"}, {"instruction": "q", "input": "", "output": "a"},
        {"prompt": "q", "completion": "a", "score": 0.5}, {"prompt": "q", "response": "a"},
        {"question": "q", "answer": "a"}]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)]
    rows += [(100, None), (101, "not json"), (102, "[1]"), (103, '{"other": 1}'), (104, '{"prompt": "x"}')]
    got = {r.i: r for r in chat.canonical_turns(spark.createDataFrame(rows, "i int, payload string")).collect()}
    for i in range(len(records)):
        assert [(t.role, t.text) for t in got[i].turns] == want, records[i]
    assert all(got[i].turns is None for i in range(100, 105))
    unknown = {r.paths for r in chat.unknown_layouts(spark.createDataFrame(rows, "i int, payload string")).collect()}
    assert "prompt" in unknown and "other" in unknown


def test_nulls_ties_and_empty(spark):
    rows = [(None, 0, None, None), (1, 5, "user", "b"), (1, 5, "user", "a"), (1, None, "assistant", "z"), (1, 5, "user", "a")]
    df = spark.createDataFrame(rows, "id int, turn int, role string, text string").select(
        "id", "turn", F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("payload"))
    out = {r.id: r for r in chat.format_turns(chat.canonical_turns(df), "id", ["turn"])
           .select("id", chat.read_back(F.col("formatted")).alias("t")).collect()}
    assert [(t.role, t.text) for t in out[1].t] == [("user", "a"), ("user", "a"), ("user", "b"), ("assistant", "z")]
    assert [(t.role, t.text) for t in out[None].t] == [("", "")]
    assert chat.digest(chat.format_turns(chat.canonical_turns(df.limit(0)), "id", ["turn"]), "id").count() == 0


def test_conversations_without_turns_stay(spark):
    df = spark.createDataFrame([(1, [("user", "a")]), (2, []), (3, None)], "id int, turns array<struct<role:string,text:string>>")
    out = {r.id: r for r in chat.digest(chat.format_turns(df, "id", []), "id").collect()}
    assert {i: (r.n_turns, r.formatted_chars, r.loss_chars) for i, r in out.items()} == {1: (1, out[1].formatted_chars, 0), 2: (0, 0, 0), 3: (0, 0, 0)}


def test_fields_of_later_messages_count(spark):
    record = {"messages": [{"role": "system"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}
    got = chat.canonical_turns(spark.createDataFrame([(json.dumps(record),)], "payload string")).first()
    assert [(t.role, t.text) for t in got.turns] == [("system", ""), ("user", "q"), ("assistant", "a")]


def test_many_turns_in_one_conversation(spark):
    """More turns than a block holds: spans and the text under the mask, each text once and in order."""
    rows = [(1, i, ("user", "assistant")[i % 2], f"t{i} \\ <|x [INST] \U0001f600" * (i % 4)) for i in range(700)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string") \
        .withColumn("turns", F.array(F.struct("role", "text")))
    out = chat.format_turns(df, "conv_id", ["turn"])
    r = out.select("formatted", "loss_spans", chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("l")).first()
    assert r.l == "".join(x[3] for x in rows if x[2] == "assistant")
    assert len(r.loss_spans) == 350
    for s, x in zip(r.loss_spans, [x for x in rows if x[2] == "assistant"], strict=True):
        assert r.formatted[s.start:s.start + s.n].replace("\\", "") == x[3].replace("\\", "")
