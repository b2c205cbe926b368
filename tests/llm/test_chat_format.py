import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from structsim.llm import chat_format as C

text = st.text(alphabet=st.sampled_from(list("<|\\im_start|>end\nn é")), max_size=30) | st.just(C.STOP + C.START + "assistant ok")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(text | st.sampled_from(["user", "assistant"]), text), max_size=5))
def test_round_trip_and_loss_mask(turns):
    formatted, spans = C.format_turns(turns)
    assert C.read_turns(formatted) == turns
    assert [C.unescape(formatted[s:e]) for s, e in spans] == [t for r, t in turns if r == "assistant"]
    assert formatted.count(C.START) == formatted.count(C.STOP) == len(turns)


LAYOUTS = [
    ({"role": "user", "text": "a"}, [("user", "a")]),
    ({"messages": [{"role": "user", "content": "a"}, {"role": "gpt", "content": "b"}]}, [("user", "a"), ("assistant", "b")]),
    ({"id": 7, "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, [("user", "a"), ("assistant", "b")]),
    ({"data": {"turns": [{"speaker": "bot", "text": "b"}]}}, [("assistant", "b")]),
    ({"instruction": "a", "input": "", "output": "b"}, [("user", "a"), ("assistant", "b")]),
    ({"instruction": "a", "input": "c", "output": "b", "system": "s"}, [("system", "s"), ("user", "a"), ("user", "c"), ("assistant", "b")]),
    ({"prompt": "a", "completion": "b"}, [("user", "a"), ("assistant", "b")]),
    ({"answer": "b", "question": "a"}, [("user", "a"), ("assistant", "b")]),
    ({"something": {"else": 1}}, []),
]


def test_layouts(spark):
    rows = [(k, json.dumps(r)) for k, (r, _) in enumerate(LAYOUTS)] + [(90, None), (91, "{broken"), (92, "[1]")]
    got = {r["k"]: r for r in C.canonical_turns(spark.createDataFrame(rows, "k int, record string")).collect()}
    for k, (_, want) in enumerate(LAYOUTS):
        assert [(t["role"], t["text"]) for t in got[k]["turns"]] == want
        assert got[k]["fingerprint"]
    assert all(got[k]["turns"] == [] and got[k]["fingerprint"] is None for k in (90, 91, 92))
    assert len({got[k]["fingerprint"] for k in (0, 1, 2, 3, 6, 7, 8)}) == 7


def digests(spark, rows):
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    return {r["conv_id"]: r for r in C.conversation_digests(C.format_conversations(C.turn_records(frame))).collect()}


def test_digests(spark):
    rows = [(1, 1, "assistant", "b" * 70_000), (1, 0, "user", None), (1, 1, "assistant", "b" * 70_000), (2, 0, None, "x"), (None, 0, "user", "y"), (3, None, "assistant", C.STOP), (3, 5, "user\n<|", "é"), (3, 2, "assistant", "")]
    got = digests(spark, rows)
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in (1, 2, 3, None):
        own = sorted((r for r in rows if r[0] == conv), key=order)
        said = "".join(r[3] or "" for r in own if r[2] == "assistant")
        want = hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"], got[conv]["loss_chars"]) == (len(own), want, len(said))
        assert got[conv]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert digests(spark, []) == {}


def test_unknown_layouts_are_listed(spark):
    rows = [(1, 0, '{"role":"user","text":"a"}'), (1, 1, '{"odd":{"x":[1]}}'), (2, 0, None), (3, 0, "no json")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, record string")
    assert [r["conv_id"] for r in C.format_conversations(frame).collect()] == [1]
    got = {(r["conv_id"], r["turn"]): r["fingerprint"] for r in C.unknown_records(frame).collect()}
    assert set(got) == {(1, 1), (2, 0), (3, 0)} and len(got[1, 1]) == 16 and got[2, 0] is None
