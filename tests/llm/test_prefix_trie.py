import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from plantpulse.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def by_hand(rows):
    turns = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            turns[c].append((n is not None, n or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(ts)] for c, ts in turns.items()}
    paths = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - c % 20, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        parts = [below[k] for k in children[node]]
        below[node] = (sum(p[0] for p in parts) if parts else 1, (len(members[node]) - 1) * words + sum(p[1] for p in parts))
    out = []
    for node, ms in members.items():
        ends = ",".join(str(c) for c in sorted(ms) if len(paths[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(ms), len(node), parent, len(ms), len(children[node]), *below[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    made = prefix_trie.prefix_trie(df)
    assert made.columns == COLUMNS
    return sorted((tuple(r) for r in made.collect()), key=repr)


def make(seed, convs=90, longest=40):
    rng = random.Random(seed)
    texts = ["", "a", "a b", "c  d\te", "é", None, " ", "long " * 50]
    stories = [[(rng.choice(["user", "assistant", None]), rng.choice(texts)) for _ in range(longest)] for _ in range(3)]
    rows = []
    for c in rng.sample(range(2 * convs), convs):
        story = list(rng.choice(stories))[: rng.choice([1, 2, 3, 4, 7, 8, 9, 16, 17, rng.randint(1, longest)])]
        if rng.random() < 0.6:
            story[rng.randrange(len(story))] = ("user", str(rng.randrange(3)))
        rows += [(c, i if rng.random() < 0.95 else None, *t) for i, t in enumerate(story)]
    rows += rows[5:9] + [(None, 0, "user", "lost"), (7, 3, "user", "tie b"), (7, 3, "user", "tie a"), (7, 3, "assistant", "tie a")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_are_those_of_a_plain_trie(spark, seed):
    rows = make(seed)
    want = by_hand(rows)
    assert {r[1] for r in want} >= {0, 8, 9, 16, 17}
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == want


def test_a_conversation_with_a_third_of_all_turns_and_a_common_one(spark):
    rows = [(40, i, "user", f"t{i % 7} x") for i in range(400)]
    rows += [(c, i, "user", f"same {i} again") for c in range(100, 200) for i in range(4)]
    rows += [(c, i, "user", f"same {i if i < 3 else c} again") for c in range(200, 260) for i in range(5)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as depth", "1 as piece", "2 as block", "3 as a", "4 as words")
        assert found(df) == by_hand(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_turnless_conversations_and_empty_tables(spark):
    # 1 to 3 take turns from 0, which is not there; one of few turns loses all of its own.
    few = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(few, 0, "user", "one"), (few, 1, "user", "two"), (41, 0, None, None)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == by_hand(rows)
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)) == []
    only = [(few, None, None, None)]
    assert found(spark.createDataFrame(only, SCHEMA)) == by_hand(only)
