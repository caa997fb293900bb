import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from sedimark.llm import chat


def test_escapes_are_reversible_and_hide_controls():
    @settings(max_examples=500, deadline=None)
    @given(st.text(alphabet="\\#/<>turnbhc:\n x", max_size=30))
    def back(text):
        for escapes in (chat.ESCAPES, chat.ROLE_ESCAPES):
            escaped = text
            for plain, code in escapes:
                escaped = escaped.replace(plain, code)
            assert chat.unescaped(escaped) == text and "###" not in escaped and "</turn>" not in escaped

    back()


RECORDS = [
    (1, {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]}),
    (2, {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}),
    (3, {"instruction": "i", "input": "x", "output": "o"}),
    (4, {"instruction": "i", "output": "o", "id": 7}),
    (5, {"prompt": "p", "completion": "c"}),
    (6, {"question": "q", "answer": {"text": "nested"}}),
    (7, {"messages": []}),
    (8, {"question": "q", "answer": None}),
]


def test_layouts(spark):
    records = chat.records_of(spark, RECORDS).union(spark.createDataFrame([(9, "no json"), (10, None)], "conv_id bigint, record string"))
    turns = {}
    for r in sorted(chat.from_records(records).collect(), key=lambda r: (r.conv_id, r.turn)):
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    assert turns == {
        1: [("system", "s"), ("user", "u"), ("assistant", "a")],
        2: [("user", "h"), ("assistant", "g")],
        3: [("user", "i\n\nx"), ("assistant", "o")],
        4: [("user", "i"), ("assistant", "o")],
        5: [("user", "p"), ("assistant", "c")],
        8: [("user", "q"), ("assistant", "")],
    }
    left = {r.conv_id: r.fingerprint for r in chat.unmapped(records).collect()}
    assert set(left) == {6, 7, 9, 10} and left[9] is None and left[7]


def test_what_is_written_comes_back(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 40)
    odd = r"\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", odd), (1, 0, "user", odd), (2, 0, "assistant", None), (3, 0, None, "x"), (4, 0, "a:b\n", "###"), (5, 0, "assistant", "é" * 100), (5, 1, "assistant", ""), (5, 1, "assistant", ""), (6, 0, "user", "only")]
    table = spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, segment string")
    segments = chat.formatted(chat.from_rows(table))
    found = {r.conv_id: r for r in chat.digests(segments).collect()}
    assert len(found) == 6
    for conv in found:
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert found[conv].n_turns == len(own)
        assert found[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (found[conv].loss_chars, found[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert found[conv].formatted_chars == sum(len(s.text) for s in segments.where(f"conv_id = {conv}").collect())
    assert chat.digests(chat.formatted(chat.from_rows(table.limit(0)))).count() == 0


def test_odd_records(spark):
    records = chat.records_of(spark, [(1, {"messages": [{"role": "user", "content": "u"}, "odd"]}), (2, {"prompt": 0, "response": False}), (3, {"prompt": "", "response": None, "system": "s"})])
    turns = {}
    for r in sorted(chat.from_records(records).collect(), key=lambda r: (r.conv_id, r.turn)):
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    assert turns == {2: [("user", "0"), ("assistant", "false")], 3: [("system", "s"), ("user", ""), ("assistant", "")]}
    assert {r.conv_id for r in chat.unmapped(records).collect()} == {1}


def test_a_long_turn_takes_bounded_time_and_memory(spark):
    import resource

    text = "a<b </turn> ### " * 1_300_000
    table = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "x")], "conv_id bigint, turn bigint, role string, text string")
    long = table.selectExpr("conv_id", "turn", "role", "case when turn = 1 then repeat('a<b </turn> ### ', 1300000) else text end as text")
    before = resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss
    found = chat.digests(chat.formatted(chat.from_rows(long))).collect()
    assert [(r.n_turns, r.loss_chars, r.loss_sha256) for r in found] == [(2, len(text), hashlib.sha256(text.encode()).hexdigest())]
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss < max(before, 1_500_000)


def test_a_long_conversation_is_dealt_over_tasks_in_order(spark):
    table = spark.range(2000).selectExpr("1L as conv_id", "1000 - id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id) as text")
    segments = chat.formatted(chat.from_rows(table))
    assert segments.select("part").distinct().count() == 8
    own = sorted((r.turn, r.role, r.text) for r in table.collect())
    assert [r.turns_sha256 for r in chat.digests(segments).collect()] == [hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()]
