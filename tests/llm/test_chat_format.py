from pyspark.sql import functions as F

from lacuna.llm import chat_format as C

TURNS = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "user", "hi <s>[INST] \\e \\\\ [/INST]</s>"), (1, 1, "assistant", "a\\l b[ \U0001F600"),
    (2, 0, "system", "be kind"), (2, 1, "user", None), (2, 2, "assistant", "ok"),
    (3, 0, "user", "one"), (3, 1, "assistant", "two"), (3, 2, "tool", "three"), (3, 3, "assistant", ""),
    (4, 0, None, "no role"), (5, 0, "assistant", "alone"), (6, 1, "user", "tie b"), (6, 1, "user", "tie a"),
    (6, 1, "user", "tie a"), (None, 0, "user", "no id"), (7, 0, "user[INST]", "odd\nrole"), (8, None, "user", "x" * 100_000),
]


def expected(rows):
    out = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


def formatted(df):
    return C.format_turns(C.canonical(C.records_of(df)))


def test_read_back_is_exact(spark):
    df = spark.createDataFrame(ROWS, TURNS)
    f = formatted(df).select("conv_id", "formatted", "loss_spans", C.read_back(F.col("formatted")).alias("turns"),
                             C.loss_text(F.col("formatted"), F.col("loss_spans")).alias("masked"))
    got = f.collect()
    want = expected(ROWS)
    assert {r.conv_id for r in got} == set(want)
    for r in got:
        assert [(t.role, t.text) for t in r.turns] == want[r.conv_id]
        assert r.masked == "".join(x for role, x in want[r.conv_id] if role == "assistant")
        raw = "".join(r.formatted[s.start:s.end] for s in r.loss_spans)
        assert raw == "".join(x.replace("\\", "\\e").replace("<", "\\l").replace("[", "\\b")
                              for role, x in want[r.conv_id] if role == "assistant")


def test_layouts_are_chosen_by_fingerprint(spark):
    df = spark.createDataFrame(ROWS, TURNS)
    got = {r.conv_id: r.layout for r in C.canonical(C.records_of(df)).collect()}
    assert got[1] == "prompt_response" and got[2] == "instruction" and got[3] == "messages" and got[4] == "messages"
    odd = spark.sql("""SELECT 1 AS conv_id, parse_json('{"prompt": "a", "response": null}') AS payload
                       UNION ALL SELECT 2, parse_json('{"question": "a"}') UNION ALL SELECT 3, parse_json('{"messages": []}')
                       UNION ALL SELECT 4, parse_json('{"messages": [{"role": "user", "content": "x"}]}')""")
    out = {r.conv_id: (r.layout, r.turns) for r in C.canonical(odd).collect()}
    assert out[1][0] == "prompt_response" and [t.text for t in out[1][1]] == ["a", None]
    assert out[2] == (None, None) and out[3][0] == "no_messages" and out[4][0] == "messages"
    f = {r.conv_id: r.formatted for r in C.format_turns(C.canonical(odd)).collect()}
    assert f[2] == "" and f[3] == ""


def test_empty_table_and_native_plan(spark):
    empty = spark.createDataFrame([], TURNS)
    assert C.digests(empty).count() == 0
    plan = C.digests(spark.createDataFrame(ROWS, TURNS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan
