"""Tool-call linking over random traffic: shared ids, missing results, chains, circles, ties and bad JSON."""

import hashlib
import json
import random
from collections import Counter

from vidimus.llm import chat_format as C

SCHEMAS = {"search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"], "additionalProperties": False}}
TEXT = "conv_id long, turn long, role string, text string, position int, row_ string"


def traffic(rng):
    rows = []
    for conv in [None, *range(25)]:
        for k in range(rng.randint(1, 14)):
            value, ids = {}, [f"c{rng.randint(0, 6)}" for _ in range(rng.randint(1, 3))]
            if rng.random() < 0.5:
                value["tool_calls"] = [{"id": i, "name": rng.choice(["search", "other"]), "arguments": rng.choice([{"query": "x"}, '{"query":"y","limit":2}', {"limit": 1}, "{bad", {"query": "x", "more": 1}])} for i in ids]
            if rng.random() < 0.5:
                value["tool_call_id"] = f"c{rng.randint(0, 8)}"
            rows.append((conv, rng.choice([k, k, k, rng.randint(0, 5), None]), rng.choice(["user", "assistant", "tool", None]), json.dumps(value) if value else rng.choice(["hello", "", None, "{}"])))
    return rows


def brute(rows):
    valid = lambda a: isinstance(a, dict) and isinstance(a.get("query"), str) and set(a) <= {"query", "limit"} and isinstance(a.get("limit", 1), int)

    def unpacked(a):
        try:
            return json.loads(a) if isinstance(a, str) else a
        except ValueError:
            return a

    out = Counter()
    for conv in {r[0] for r in rows}:
        messages = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            value = json.loads(text) if text and text.startswith("{") else {}
            calls = [{**c, "arguments": unpacked(c["arguments"])} for c in value.get("tool_calls", ())]
            if "tool_calls" in value:
                value["tool_calls"] = calls
            value = {**value, "role": role} if "tool_calls" in value or "tool_call_id" in value else {"role": role, "content": text or ""}
            message = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            messages.append({"turn": turn, "at": -(2**63) if turn is None else turn, "message": message, "digest": hashlib.md5(message.encode()).hexdigest(), "ids": [c["id"] for c in calls], "good": sum(c["name"] == "search" and valid(c["arguments"]) for c in calls), "answers": value.get("tool_call_id")})
        order = sorted(range(len(messages)), key=lambda k: (messages[k]["at"], messages[k]["digest"], k))
        caller = {}
        for k in order:
            for i in messages[k]["ids"]:
                caller.setdefault(i, k)
        up = {k: caller[m["answers"]] for k, m in enumerate(messages) if m["answers"] in caller}

        def place(k, up=up, messages=messages):
            chain = [k]
            while chain[-1] in up and up[chain[-1]] != chain[-1]:
                if up[chain[-1]] in chain:
                    return messages[k]["at"], 0
                chain.append(up[chain[-1]])
            after, steps = messages[chain[-1]]["at"], 0
            for n in chain[-2::-1]:
                after, steps = (messages[n]["at"], 0) if messages[n]["at"] > after else (after, steps + 1)
            return after, steps

        order = sorted(range(len(messages)), key=lambda k: (*place(k), messages[k]["at"], messages[k]["digest"], k))
        answered = Counter(caller[i] for i in {messages[k]["answers"] for k in up})
        for position, k in enumerate(order):
            m = messages[k]
            out[conv, m["turn"], position, len(m["ids"]), m["good"], answered[k], None if m["answers"] is None else k in up, m["message"]] += 1
    return out


def test_random_traffic_equals_brute_force(spark):
    # Of messages that are equal in all parts any may be the caller, so each is made distinct by its content.
    rows = traffic(random.Random(31))
    rows = [(c, t, r, json.dumps({**json.loads(x), "n": k}) if x and x.startswith("{") else x) for k, (c, t, r, x) in enumerate(rows)]
    frame = spark.createDataFrame([(*r, 1, "q") for r in rows], TEXT)
    want = brute(rows)
    assert sum(n for k, n in want.items() if k[6]) > 30 and sum(n for k, n in want.items() if k[5]) > 20
    for n in (1, 5):
        got = Counter(tuple(r) for r in C.chat_format(frame.repartition(n), SCHEMAS).collect())
        assert got == want


def test_results_follow_their_calls_along_long_chains(spark):
    rows = [(1, 50 - k, "tool", json.dumps({"tool_calls": [{"id": f"c{k + 1}"}], **({"tool_call_id": f"c{k}"} if k else {})})) for k in range(40)]
    frame = spark.createDataFrame([(*r, 1, "q") for r in rows[::-1]], TEXT)
    got = sorted((r.position, r.turn) for r in C.chat_format(frame).collect())
    assert [t for _, t in got] == [50 - k for k in range(40)]


def test_no_text_stops_the_job(spark):
    deep = '{"tool_calls":' + "[" * 100_000 + "]" * 100_000 + "}"
    texts = ['{"tool_calls":[],"x":"\\ud800"}', '{"tool_calls":[{"id":"\\udfff"}]}', '{"tool_call_id":"\\udfff"}', '{"tool_calls":[],"x":NaN}', '{"tool_calls":[],"x":-Infinity}', '{"tool_calls":[],"x":1e999}', '{"tool_calls":[],"x":' + "9" * 5000 + "}", deep, '{"tool_calls":{}}', '{"a":1}', "[1]", "x" * 200_000]
    frame = spark.createDataFrame([(1, k, "user", t, 1, "q") for k, t in enumerate(texts)], TEXT)
    got = {r.turn: r for r in C.chat_format(frame).collect()}
    assert len(got) == len(texts) and all(json.loads(r.message)["role"] == "user" for r in got.values())
    assert json.loads(got[0].message)["x"] == "\ud800" and got[2].linked and got[1].n_answered == 1
    assert all(json.loads(got[k].message)["content"] == texts[k] for k in (3, 4, 5, 6, 7, 8, 9, 10, 11))


def test_a_hot_conversation_reaches_over_ranges(spark):
    rows = [(None if k % 3 == 0 else k, k // 9, "user", f"m{k}") for k in range(900)]
    frame = spark.createDataFrame([(*r, 1, "q") for r in rows], TEXT)
    got = [r for r in C.chat_format(frame).collect() if r.conv_id is None]
    assert sorted(r.position for r in got) == list(range(300)) and all(a.turn <= b.turn for a, b in zip(*(lambda s: (s, s[1:]))(sorted(got, key=lambda r: r.position))))
