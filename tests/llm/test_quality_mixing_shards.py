import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from plantpulse.llm import mixing, quality, shards

from .conftest import CLASHES, result

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def figures(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_figures_are_those_of_brute_force(docs, doc_rows):
    got = result(quality.base_figures(docs), "doc_id", *quality.FIGURES)
    assert got == sorted(((r[0], *figures(r[1])) for r in doc_rows), key=repr)


def test_repeated_words_and_lines(spark):
    texts = ["a a a a", "a b c a b c", "a b\na b\n\n \na  b", "x#y|z <b>", "a a b a a b a"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    assert result(quality.base_figures(df), "doc_id", *quality.FIGURES) == [(i, *figures(t)) for i, t in enumerate(texts)]


def test_lines_of_many_documents_go_and_depleted_documents_are_rejected(spark):
    words = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    notice = "Read the terms of use before you go on , please , and do come back for more of it"
    rows = [(i, f"{words(i, 60)}\n{notice}\n{words(-i, 5)}", "s") for i in range(1, 21)]
    rows += [(50, "\n".join([notice] * 10) + "\n" + words(50, 30), "s"), (51, f"{words(51, 80)}\n{notice}", "t")]
    # Copies of one text are one family, so their lines stay.
    rows += [(100 + i, f"{words(900, 30)}\n{words(901, 30)}\n{words(902, 30)}", "s") for i in range(15)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: (r.kept, r.n_removed_words) for r in quality.quality_rules(df).collect()}
    n = len(notice.split())
    assert all(kept[i] == (True, n) for i in range(1, 21)) and kept[51] == (True, 0)
    assert kept[50][1] == 10 * n and not kept[50][0]
    assert all(kept[100 + i] == (True, 0) for i in range(15))
    cleaned = {r.doc_id: r.text for r in quality.clean(df).collect()}
    assert 50 not in cleaned and notice not in cleaned[3] and notice in cleaned[51] and len(cleaned) == len(rows) - 1


def test_shared_lines_that_occur_together_go(spark):
    """Header and footer lines name no family: each is counted by the different documents that hold it."""
    words = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    shared = ["About us", "Contact", "Terms of use"]
    rows = [(i, "\n".join([*shared[:2], words(i, 60), shared[2]]), "s") for i in range(11)]
    # Ten different documents are not above the limit, and exact copies don't add to them.
    rows += [(100 + i, "\n".join(["Home", words(200 + min(i, 9), 60), "Imprint"]), "t") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {(r.doc_id < 100, r.kept, r.n_removed_words) for r in quality.quality_rules(df).collect()} == {(True, True, 6), (False, True, 0)}
    cleaned = {r.doc_id: r.text for r in quality.clean(df).collect()}
    assert cleaned == {d: words(d, 60) if d < 100 else t for d, t, _ in rows}


@pytest.mark.parametrize("run", [quality.quality_rules, quality.clean, quality.base_figures])
def test_quality_takes_empty_tables_and_clashing_columns(docs, clashing, nothing, run):
    assert run(nothing).count() == 0
    out = run(clashing)
    assert set(CLASHES) <= set(out.columns)
    same = [c for c in run(docs).columns if c not in CLASHES or c in (*quality.FIGURES, "kept") and c in run(docs).columns]
    if run is quality.clean:
        same = docs.columns
    assert result(out, *same) == result(run(docs), *same)


def targets_by_rounds(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, full, target = sum(sizes.values()) * 1.5, set(), {}
    while True:
        rest = left - sum(2 * sizes[s] for s in full)
        total = sum(weight[s] for s in order if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / total for s in order}
        above = {s for s in order if s not in full and target[s] > 2 * sizes[s]}
        if not above:
            return target
        full |= above


def test_mix_meets_its_targets(docs, doc_rows):
    rows = mixing.mixture(docs, block=16).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.copies <= 2
    want = targets_by_rounds(sizes)
    assert sorted((r.doc_id, r.size) for r in rows if r.doc_id is not None) == sorted((d, len(WORD.findall(t or ""))) for d, t, *_ in doc_rows if d is not None)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in want:
        assert abs(taken[s] - want[s]) <= 4 * 16
    assert result(mixing.mixture(docs, block=16)) == sorted(map(tuple, rows), key=repr)


def test_schedule_is_even_everywhere(spark):
    df = spark.createDataFrame([(1, "a", 30, 600.0), (2, "b", 20, 300.0), (3, "c", 10, 100.0)], "_source long, source string, source_size long, target double")
    rows = sorted(mixing.schedule(df, 1).collect(), key=lambda r: r["_slot"])
    assert [r["_slot"] for r in rows] == list(range(1000))
    for begin in range(0, 1000, 100):
        own = Counter(r["_source"] for r in rows[begin : begin + 100])
        assert abs(own[1] - 60) <= 3 and abs(own[2] - 30) <= 3 and abs(own[3] - 10) <= 3
    for s in (1, 2, 3):
        assert sorted(r["_block"] for r in rows if r["_source"] == s) == list(range(sum(r["_source"] == s for r in rows)))


def test_mixed_documents_are_whole(docs, doc_rows, nothing, clashing):
    copies = Counter((r.doc_id, r.source) for r in mixing.mixture(docs).collect() for _ in range(r.copies))
    out = mixing.mixed(docs).collect()
    assert Counter((r.doc_id, r.source) for r in out) == copies
    assert {tuple(r) for r in out} <= set(doc_rows)
    assert mixing.mixed(nothing).count() == 0 and mixing.mixture(nothing).count() == 0
    assert mixing.mixed(clashing).columns == clashing.columns


def test_differencing_is_tight():
    rng = np.random.default_rng(3)
    for n, ways in ((0, 3), (1, 4), (5, 1), (40, 7), (3000, 40)):
        sizes = rng.integers(1, 5000, n)
        part = shards.difference(sizes, ways)
        assert len(part) == n and (n == 0 or (part.min() >= 0 and part.max() < ways))
        if n == 3000:
            sums = np.bincount(part, weights=sizes, minlength=ways)
            assert sums.max() - sums.min() < 100
    assert sorted(np.bincount(shards.difference(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])) in ([14, 16], [15, 15])


def test_shards_hold_every_row_and_whole_groups(docs, doc_rows, nothing, clashing, monkeypatch):
    monkeypatch.setattr(shards, "BUCKET_GROUPS", 10)
    out = shards.assign_shards(docs, 5)
    rows = out.collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in doc_rows)
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((d, 16 + len((t or "").encode())) for d, t, *_ in doc_rows)
    for s in range(5):
        own = sorted((r for r in rows if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
    where = defaultdict(set)
    for r in rows:
        where[r.size, r.text_crc32].add(r.shard)
    assert all(len(x) == 1 for x in where.values())
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert shards.assign_shards(nothing, 5).count() == 0
    assert result(shards.assign_shards(clashing, 5)) == result(out)
