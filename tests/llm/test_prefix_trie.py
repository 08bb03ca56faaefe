import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest

from netsentry.llm import prefix_trie as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(conversations):
    nodes, kids, leaves, saved, out = {}, defaultdict(list), {}, {}, []
    for conv, turns in conversations.items():
        for depth in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:depth]), []).append(conv)
    for node in nodes:
        if node:
            kids[node[:-1]].append(node)
    for node in sorted(nodes, key=len, reverse=True):
        words = len(WORD.findall(node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in kids[node]) if kids[node] else 1
        saved[node] = (len(nodes[node]) - 1) * words + sum(saved[k] for k in kids[node])
        ends = ",".join(map(str, sorted(c for c in nodes[node] if len(conversations[c]) == len(node))))
        parent = min(nodes[node[:-1]]) if node else None
        row = (min(nodes[node]), len(node), parent, len(nodes[node]), len(kids[node]), leaves[node], saved[node])
        out.append((*row, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own[conv].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[3] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 4
        out[conv] = own.get(conv - int(math.fmod(conv, 20)), [])[:h] + own[conv][h:]
    return out


def found(df):
    return sorted(map(tuple, P.prefix_trie(*P.rebuilt(P.turn_rows(df))).collect()), key=str)


@pytest.mark.parametrize("ties", [False, True])
def test_equals_brute_force(spark, monkeypatch, ties):
    monkeypatch.setattr(P, "SEGMENT", 16)
    monkeypatch.setattr(P, "CHUNK", 2)
    rng, rows = random.Random(3), []
    for conv in [*range(20), *range(21, 70), -3, -20]:  # 20 is absent
        for turn in range(rng.choice([1, 2, 3, 5, 8, 9, 16, 17, 33, 40])):
            place = rng.choice([turn, turn, None]) if ties else turn
            rows.append((conv, place, rng.choice(["user", None]), rng.choice(["a", "b b", None]) if turn > 2 else "x"))
    rows += [(500 + k, t, "user", "the same in all of them") for k in range(30) for t in range(20)]
    rows += [(None, 1, "user", "nobody's")] + ([(7, 3, "user", "twice")] * 2 if ties else [])
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert found(df) == brute(rebuilt(rows))


def test_turnless_conversations_are_members_of_the_root(spark):
    shorter = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 1][:2]
    rows = [(c, 0, "user", "only turn") for c in shorter]
    assert rebuilt(rows) == {c: [] for c in shorter}
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute({c: [] for c in shorter})


def test_long_conversation(spark):
    rows = [(20 * c, t, "user", f"turn {t % 7}") for c in (1, 2) for t in range(2_500 + c)]
    df = spark.createDataFrame(rows, SCHEMA)
    rows = {(r.depth): r for r in P.prefix_trie(*P.rebuilt(P.turn_rows(df))).collect()}
    assert len(rows) == 2_503 and rows[2_501].n_convs == 2 and rows[2_502].n_convs == 1
    assert rows[0].saved_tokens == 2 * 2_501 and rows[1_500].saved_tokens == 2 * (2_501 - 1_499)
    assert [rows[d].parent_conv_id for d in (0, 1, 2_501, 2_502)] == [None, 20, 20, 20]


def test_empty_table_and_other_columns(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    df = spark.createDataFrame([(1, 0, "u", "a b", "x", 1)], SCHEMA + ", node string, place int")
    assert found(df) == brute(rebuilt([(1, 0, "u", "a b")]))


def test_one_rollup_has_all_prefixes(spark):
    df = spark.createDataFrame([(20, t, "u", "a") for t in range(5)], SCHEMA)
    blocks = P.turn_blocks(*P.rebuilt(P.turn_rows(df)))
    assert P._rolled(blocks)._jdf.queryExecution().executedPlan().toString().count("Expand ") == 1


def test_query_equals_sql(spark):
    from compare import database, difference

    from netsentry.llm.catalog import SQL, op12_prefix_trie

    folder = "/root/testdata/sf0.001"
    assert difference(spark, database(folder), op12_prefix_trie, SQL["op12_prefix_trie"], folder) is None
