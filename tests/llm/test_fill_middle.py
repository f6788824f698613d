import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plantpulse.llm import fill_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_hand(doc_id, text):
    text = text or ""
    u = UNIT.findall(text)
    assert "".join(u) == text
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(u), "plain", None, None, text
    if h4 % 100 < 80:
        return doc_id, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(rng):
    pieces = ["word", "é", "日本語", " ", "  ", "\t", "\n", "\r\n", "\x0b", "<", "<S", "S>", "P>", ">", " ", "x" * 300, " " * 400]
    made = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    return made + [None, "", " ", "\n\n", "one", "one ", " one", "a<P>b", "a <S> b", "<M>", "é" * 128, "a" * 256, "a " * 128, "a" * 512 + " ", "w " * 60_000, "日" * 50_000]


def check(df, rows):
    found = fill_middle.fill_in_middle(df).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:-1] for r in found), key=repr) == sorted((by_hand(*r) for r in rows), key=repr)
    assert sorted((r.doc_id, r.back) for r in found if r.doc_id is not None) == sorted((d, t or "") for d, t in rows if d is not None)
    return {r.form for r in found}


@pytest.mark.parametrize("size", [fill_middle.GROUP_BYTES, 700])
def test_parts_are_those_of_a_plain_reading(spark, monkeypatch, size):
    monkeypatch.setattr(fill_middle, "GROUP_BYTES", size)
    rows = list(enumerate(texts(random.Random(size)))) + [(None, "a b c"), (None, None), (3, "again a"), (3, "again a")]
    assert check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows) == {"plain", "spm", "psm"}


def test_given_rows(docs, doc_rows, clashing, nothing):
    rows = [(r[0], r[1]) for r in doc_rows]
    check(docs, rows)
    check(clashing, rows)
    assert fill_middle.fill_in_middle(nothing).collect() == []


def test_descent_finds_the_block_of_every_item():
    rng = random.Random(1)
    for n in (1, 2, 3, 7, 8, 9, 100):
        counts = np.array([rng.choice([0, 0, 1, 5]) for _ in range(n)] + [1])
        tree = fill_middle.Fenwick(counts)
        assert tree.before(np.arange(len(counts) + 1)).tolist() == [0, *np.cumsum(counts)]
        want = [(b, i + 1) for b, c in enumerate(counts) for i in range(c)]
        block, left = tree.find(np.arange(1, counts.sum() + 1))
        assert list(zip(block.tolist(), left.tolist(), strict=True)) == want


def test_a_batch_of_empty_texts():
    made = fill_middle.units(pa.array(["", None, ""]))
    assert made.units_before(made.offsets).tolist() == [0] * 4
