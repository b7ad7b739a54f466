"""Tool calls that depend on each other: long chains, hubs and cycles against a model; linking against SQL."""

from __future__ import annotations

import json
import random
import time

from reviewlake.llm import chat, queries

from ..oracle import connect, duck_rows, spark_rows


def levels(needs):
    """Longest way to a call without dependencies; None on a cycle or behind one."""
    out, state = {}, {}

    def visit(call):
        stack = [(call, iter(needs.get(call, ())))]
        state[call] = "open"
        while stack:
            top, rest = stack[-1]
            for n in rest:
                if n not in needs:
                    continue
                if state.get(n) == "open":
                    out[top] = "cycle"
                elif n not in state:
                    state[n] = "open"
                    stack.append((n, iter(needs[n])))
                    break
            else:
                state[top] = "done"
                stack.pop()

    for c in needs:
        if c not in state:
            visit(c)
    # plain fixpoint over what is reachable from calls without dependencies
    known, changed = {}, True
    while changed:
        changed = False
        for c, ns in needs.items():
            ns = [n for n in ns if n in needs]
            if c not in known and all(n in known for n in ns):
                known[c], changed = max((known[n] + 1 for n in ns), default=0), True
    return {c: known.get(c) for c in needs}


def conversation(conv, needs, shuffle):
    calls = [{"id": c, "name": "calculate", "arguments": {"expression": " ".join(f"${{{n}}}" for n in ns) or "1"}} for c, ns in needs.items()]
    shuffle.shuffle(calls)
    return [(conv, k, "assistant", json.dumps({"tool_calls": [c]})) for k, c in enumerate(calls)]


def test_steps_of_random_graphs(spark):
    r = random.Random(6)
    graphs, rows = {}, []
    for conv in range(40):
        n = r.randint(1, 25)
        needs = {}
        for k in range(n):
            pool = [f"c{j}" for j in range(n if r.random() < 0.08 else k)] + ["elsewhere"]
            needs[f"c{k}"] = r.sample(pool, min(len(pool), r.choice([0, 1, 1, 1, 2, 3])))
        graphs[conv] = levels(needs)
        rows += conversation(conv, needs, r)
    got = {(x.conv_id, x.call_id): x.step for x in chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).filter("kind = 'call'").collect()}
    assert got == {(conv, c): None if level is None else 2 * level for conv, of in graphs.items() for c, level in of.items()}
    assert any(s is None for s in got.values()) and max(s or 0 for s in got.values()) > 6


def test_a_chain_of_thousands_and_a_cycle(spark):
    n = 3000
    chain = {f"c{k}": [f"c{k - 1}"] if k else [] for k in range(n)}
    cycle = {f"d{k}": [f"d{(k + 1) % 50}"] for k in range(50)} | {"behind": ["d0"], "hub": ["behind", "free"], "free": []}
    rows = conversation(1, chain, random.Random(1)) + conversation(2, cycle, random.Random(2))
    began = time.perf_counter()
    got = {(x.conv_id, x.call_id): x.step for x in chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).filter("kind = 'call'").collect()}
    assert time.perf_counter() - began < 120
    assert got == {(1, f"c{k}"): 2 * k for k in range(n)} | {(2, c): 0 if c == "free" else None for c in cycle}


def test_query_with_calls_equals_sql(spark, sf):
    df = queries.queries()["tool_calls"](spark, sf)
    names, rows = duck_rows(connect(sf), queries.oracle_sql()["tool_calls"])
    got = spark_rows(df)
    assert sorted(df.columns) == names and got == rows
    linked = df.filter("kind = 'call' and linked").count()
    assert linked > 20 and df.filter("step > 2").count() > 10


def test_long_texts_in_linear_time(spark):
    texts = ["{" * 300_000, '{"tool_calls": ' + "[" * 200_000, '{"content": "' + "${a}" * 200_000 + '"}', "x" * 1_000_000]
    began = time.perf_counter()
    got = chat.link(spark.createDataFrame([(1, k, "assistant", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 4 and time.perf_counter() - began < 60
