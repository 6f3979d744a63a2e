"""Levels of calls: long chains, merges, circles and what lies behind them; tool messages among plain turns."""

import json
import random

from postlark.llm import toolcalls

CALL = "conv_id long, call_id string, after array<string>"


def brute(edges, nodes):
    """Longest path to each node, None on or behind a circle."""
    level, left = {}, set(nodes)
    while ready := [x for x in left if all(y in level for y in edges[x])]:
        for x in ready:
            level[x] = max((level[y] + 1 for y in edges[x]), default=0)
        left.difference_update(ready)
    return level | dict.fromkeys(left)


def test_levels(spark):
    draw = random.Random(1)
    chain = {f"c{i}": {f"c{i - 1}"} if i else set() for i in range(70)}
    circle = {"r0": {"r3"}, "r1": {"r0"}, "r2": {"r1"}, "r3": {"r2"}, "behind": {"r2"}, "far": {"behind"}, "self": {"self"}, "both": {"c3", "behind"}}
    dag = {f"d{i}": set(draw.sample([f"d{j}" for j in range(i)], min(i, draw.randrange(4)))) for i in range(40)}
    edges = chain | circle | dag | {"m": {"c69", "c5", "d39"}, "after m": {"m"}}
    calls = spark.createDataFrame([(1, k, [*sorted(v), "not there"]) for k, v in edges.items()] + [(2, "c1", ["c0"])], CALL)
    got = {r.call_id: r.level for r in toolcalls._levels(calls).where("conv_id = 1").collect()}
    want = brute(edges, edges)
    assert {k: got.get(k, 0) for k in edges} == want
    assert want["m"] == 70 and want["both"] is None


def test_tool_messages_among_turns(spark):
    say = json.dumps
    rows = [
        (1, 0, "user", "a"), (1, 1, "assistant", say({"tool_calls": [{"id": "x", "name": "user", "arguments": {"text": "t", "turn": 1}}, {"id": "y", "name": "user", "arguments": {"text": 5, "turn": 1}, "after": ["x"]}]})),
        (1, 2, "tool", say({"tool_call_id": "x", "content": "done"})), (1, 3, "assistant", "plain"), (1, 4, "tool", "no json"), (1, 5, "user", "b"), (1, 6, "assistant", "c"),
    ]
    got = toolcalls.link(*toolcalls.from_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), toolcalls.TURN_SCHEMAS)
    assert {r.call_id: (r.status, r.level) for r in got.collect()} == {"1:0": ("unanswered", 0), "x": ("linked", 0), "y": ("invalid", 1), "1:2": ("orphan", 0), "1:4": ("invalid", 0), "1:5": ("linked", 1)}
