import hashlib
import json

import pytest
from pyspark.sql import functions as F

from peerwatch.llm import chat

SAYS = "</s>[INST] ok [/INST]"
TEXTS = [SAYS, "", None, "a\\b<|end|>\\e\\l[x]<", "é🎉\n\ttab", "<|role|>user<|text|>", "\\", "x" * 200_000]


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(c, t, "assistant" if (c + t) % 2 else "user", TEXTS[(c * 3 + t) % len(TEXTS)]) for c in range(6) for t in range(c + 1)]
    rows += [(50, 0, "system", "s"), (50, 1, None, "none"), (50, 1, "assistant", "b"), (50, 1, "assistant", "b"), (None, 0, "user", "no id")]
    extra = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id bigint, turn bigint, role string, text string, id int, record string")
    extra.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat.op8_chat_format(spark, str(tmp_path)).collect()}
    by = {-7: [(0, "user", SAYS), (1, "assistant", SAYS)]}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{x}\n" for _, a, x in turns).encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        marks = len(chat.ROLE_MARK + chat.TEXT_MARK + chat.END_MARK)
        assert r["formatted_chars"] == sum(marks + len(a) + len(x) + sum(x.count(m) for m in "\\<[") for _, a, x in turns)


def test_escapes_leave_no_control_string(spark):
    frame = spark.createDataFrame([(t,) for t in TEXTS if t is not None], "t string")
    for r in frame.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("back")).collect():
        assert r["back"] == r["t"] and "<" not in r["e"] and "[" not in r["e"]


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]}, "messages", [("user", "q"), ("assistant", "")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations", [("user", "q"), ("assistant", "a")]),
    ({"prompt": "q", "response": "a"}, "prompt", [("user", "q"), ("assistant", "a")]),
    ({"prompt": "q", "completion": "a", "system": "s"}, "completion", [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"question": "q", "answer": "a"}, "question", [("user", "q"), ("assistant", "a")]),
    ({"messages": []}, "messages", []),
    ({"meta": {"lang": "en"}, "prompt": "q"}, None, []),
    ({"answer": "a"}, None, []),
]


def test_fingerprints_select_mappings(spark, tmp_path):
    path = tmp_path / "records.json"
    path.write_text("\n".join(json.dumps({"id": i, "record": r}) for i, (r, _, _) in enumerate(LAYOUTS)))
    records = spark.read.schema(spark.read.json(str(path)).schema).json(str(path))
    got = {r["id"]: r for r in chat.canonical_turns(records).collect()}
    for i, (_, layout, turns) in enumerate(LAYOUTS):
        assert got[i]["layout"] == layout and [tuple(t) for t in got[i]["turns"]] == turns, LAYOUTS[i]


def test_unused_layouts_need_no_columns(spark):
    records = spark.createDataFrame([(1, ("q", "a"))], "id int, record struct<prompt:string,response:string>")
    assert [tuple(t) for t in chat.canonical_turns(records).first()["turns"]] == [("user", "q"), ("assistant", "a")]


def test_fingerprint_ignores_field_order_and_values(spark):
    one = spark.createDataFrame([(1, ("q", ["x"]))], "id int, record struct<b:string,a:array<string>>")
    two = spark.createDataFrame([(1, (["y", "z"], 5))], "id int, record struct<a:array<string>,b:int>")
    three = spark.createDataFrame([(1, (None, 5))], "id int, record struct<a:array<string>,b:int>")
    prints = [f.select(chat.schema_fingerprint(f)).first()[0] for f in (one, two, three)]
    assert prints[0] == prints[1] != prints[2]


def test_empty_table_leaves_the_added_conversation(spark, tmp_path):
    spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r["conv_id"] for r in chat.op8_chat_format(spark, str(tmp_path)).collect()] == [-7]


@pytest.mark.parametrize("turns", [[], [("assistant", "<|end|>")]])
def test_segments_make_the_text(spark, turns):
    frame = spark.createDataFrame([(1, "x", turns)], "id int, layout string, turns array<struct<role:string,text:string>>")
    r = chat.format_turns(frame).first()
    assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
    back = chat.read_back(chat.format_turns(frame)).first()
    assert [tuple(t) for t in back["turns"]] == turns and back["loss_text"] == "".join(t for _, t in turns)


def test_main_path_runs_no_python(spark, sf_dir):
    plan = chat.op8_chat_format(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_records_of_an_empty_table_and_other_columns(spark):
    rows = [(1, 0, "user", "x" * 300_000, "note"), (1, 1, "assistant", None, "note")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, held string")
    got = chat.turn_records(df).collect()
    assert [[(t["role"], len(t["text"] or "")) for t in r["turns"]] for r in got] == [[("user", 300_000), ("assistant", 0)]]
    assert chat.turn_records(df.limit(0)).collect() == []
