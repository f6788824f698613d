import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from plantpulse.llm import brown

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD)), ""]


def is_held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 5 == 1


def steps_of(rows):
    """(word before, word) of all tokens that are learnt from."""
    return [(b, w) for d, t in rows if not is_held(d) for b, w in zip(["", *tokens_of(t)], tokens_of(t))]  # noqa: B905


def base_by_hand(rows):
    count = Counter(w for _, w in steps_of(rows))
    n, v = sum(count.values()), len(count)
    out = []
    for d, t in rows:
        ws = tokens_of(t)
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        out.append((d, is_held(d), len(ws), sum(count[w] > 0 for w in ws), n, round(base, 6)))
    return sorted(out, key=repr)


def base_found(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect()), key=repr)


def scores_by_hand(rows, classes):
    steps = steps_of(rows)
    count = Counter(w for _, w in steps)
    pairs = Counter((classes[b], classes[w]) for b, w in steps)
    after, sizes = Counter(classes[b] for b, _ in steps), Counter(classes[w] for _, w in steps)
    words = Counter(classes[w] for w in count)
    once, twice = (sum(c == k for c in count.values()) for k in (1, 2))
    off = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.1
    total = len(steps)

    def step(c, k):
        share = sizes[k] / total
        return share if c is None else (pairs[c, k] + brown.PRIOR * share) / (after[c] + brown.PRIOR)

    def chance(before, w):
        c = classes.get(before)
        if w in count:
            return step(c, classes[w]) * (count[w] - off) / sizes[classes[w]]
        return sum(step(c, k) * off * words[k] / sizes[k] for k in sizes)

    for before in ["", "unknown-word", *list(count)[:5]]:
        assert abs(sum(chance(before, w) for w in count) + chance(before, "unknown-word") - 1) < 1e-9
    return [sum(math.log10(chance(b, w)) for b, w in zip(["", *tokens_of(t)], tokens_of(t))) for _, t in rows]  # noqa: B905


@pytest.fixture
def small(monkeypatch):
    for name, value in (("CLASSES", 8), ("CODES", 24), ("PACK_BYTES", 1000), ("BUCKET_BYTES", 3000), ("GROUP_PACKS", 3), ("WORDS_AT_ONCE", 7)):
        monkeypatch.setattr(brown, name, value)


def test_base_figures_and_edge_cases(spark, docs, doc_rows, clashing, nothing):
    rows = [(r[0], r[1]) for r in doc_rows]
    want = base_by_hand(rows)
    assert any(r[1] for r in want) and any(r[2] > 6000 for r in want)
    assert base_found(brown.class_scores(docs)) == want
    assert base_found(brown.class_scores(clashing)) == want
    assert brown.class_scores(nothing).collect() == []
    held = next(d for d in range(50) if is_held(d))
    only = [(held, "a b"), (held, None)]
    found = brown.class_scores(spark.createDataFrame(only, "doc_id int, text string"))
    assert base_found(found) == base_by_hand(only) and {r.score for r in found.collect()} == {0.0}
    empty = [(None, None), (1 if not is_held(1) else 2, "")]
    assert base_found(brown.class_scores(spark.createDataFrame(empty, "doc_id long, text string"))) == base_by_hand(empty)


def story(rng, n):
    """Subjects, verbs and ends in turn, of one of two languages."""
    language = rng.choice("xy")
    kinds = [[f"{language}{k}{i}" for i in range(12)] for k in "svo"]
    return " ".join(rng.choice(kinds[i % 3]) for i in range(n))


def test_scores_are_those_of_the_model(spark, small, monkeypatch):
    """Over many packs, buckets and groups: the classes are followed by a plain reading, and so are the sweeps."""
    rng = random.Random(4)
    rows = [(i, story(rng, rng.randint(1, 60)) + (" new%d" % i if i % 9 == 0 else "")) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen = []
    plain = brown.exchanged
    monkeypatch.setattr(brown, "SWEEPS", (40, 1))
    monkeypatch.setattr(brown, "exchanged", lambda *a: seen.append((a, plain(*a))) or seen[-1][1])
    found = {r.doc_id: r for r in brown.class_scores(df).collect()}
    (packs, places, first, parts), last = seen[0]
    assert packs.count() > 15 and parts > 3 and last.count() > 5
    names = {}  # bucket and number of each word, by its hash
    for r in brown.make_packs(df, last.count()).filter("bucket is not null").collect():
        hashes = np.frombuffer(r["hashes"], dtype=np.uint64).tolist()
        names.setdefault(r["bucket"], {}).update((h, 0) for h, n in zip(hashes, brown.unsqueeze(r["counts"]), strict=True) if n)
    known = {h: (b, i) for b, hs in names.items() for i, h in enumerate(sorted(hs))}
    low = {w: xxhash.xxh3_128_intdigest(w.encode()) & (1 << 64) - 1 for _, w in steps_of(rows)}
    classes = {}
    for name, state in (("first", first), ("last", last)):
        at = {r["bucket"]: brown.unsqueeze(r["classes"]) for r in state.collect()}
        classes[name] = {w: int(at[known[h][0]][known[h][1]]) for w, h in low.items()}
    assert Counter(classes["first"].values())[brown.END] == 1
    assert classes["last"] == swept(rows, classes["first"], (40, 1))
    for (d, _), want in zip(rows, scores_by_hand(rows, classes["last"]), strict=True):
        assert abs(found[d].score - want) < 1e-6
        assert abs(found[d].perplexity - 10 ** (-want / found[d].n_tokens)) < 1e-6 * found[d].perplexity
    held = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.15 * sum(r.n_tokens for r in held)


def swept(rows, classes, sweeps):
    steps = steps_of(rows)
    count = Counter(w for _, w in steps)
    classes = dict(classes)
    for least in sweeps:
        pairs = np.zeros((brown.CLASSES, brown.CLASSES))
        left, right = {w: np.zeros(brown.CLASSES) for w in count}, {w: np.zeros(brown.CLASSES) for w in count}
        for b, w in steps:
            pairs[classes[b], classes[w]] += 1
            left[w][classes[b]] += 1
            if b:
                right[b][classes[w]] += 1
        after = {}
        for w, n in count.items():
            if w == "" or n < least:
                continue
            own = classes[w]
            gains = []
            for k in range(brown.CLASSES):
                m, total = pairs.copy(), pairs.sum(axis=1)
                if k == own:
                    m[:, k] = np.maximum(m[:, k] - left[w], 0)
                    into = m[:, k]
                    out = np.maximum(pairs[k] - right[w], 0)
                    size = max(total[k] - n, 0)
                else:
                    into, out, size = pairs[:, k], pairs[k], total[k]
                gains.append((left[w] * np.log(into + 0.5)).sum() + (right[w] * np.log(out + 0.5)).sum() - 2 * n * math.log(size + 0.5))
            gains[brown.END] = -math.inf
            best = int(np.argmax(gains))
            after[w] = best if gains[best] > gains[own] else own
        classes |= after
    return classes


def test_sweeps_find_the_kinds_of_words(spark, monkeypatch):
    """Held-out text becomes likelier with the sweeps."""
    for name, value in (("CLASSES", 10), ("CODES", 30)):
        monkeypatch.setattr(brown, name, value)
    rng = random.Random(5)
    df = spark.createDataFrame([(i, story(rng, 60)) for i in range(300)], "doc_id long, text string")
    scores = []
    for sweeps in ((), (1,) * 4):
        monkeypatch.setattr(brown, "SWEEPS", sweeps)
        scores.append(sum(r.score for r in brown.class_scores(df).filter("held_out").collect()))
    assert scores[1] > scores[0] + 50


def test_pieces_add_up():
    rng = np.random.default_rng(2)
    pieces, want = [], Counter()
    for _ in range(5):
        own = Counter(zip(rng.integers(0, 9, 40).tolist(), rng.integers(0, 9, 40).tolist(), strict=True))
        want += own
        rows = sorted(own.items())
        pieces.append(brown.to_piece(*(np.array(x) for x in ([k[0] for k, _ in rows], [k[1] for k, _ in rows], [n for _, n in rows]))))
    h, code, n = brown.merged(pieces)
    assert dict(zip(zip(h.tolist(), code.tolist(), strict=True), n.tolist(), strict=True)) == want
    none = brown.to_piece(*[np.zeros(0, dtype=np.int64)] * 3)
    assert [len(x) for x in brown.merged([none])] == [0, 0, 0]


def test_words_of_texts():
    texts = ["A bÉ  c", None, "", " x", "y ", "\t\n", "zz", "Z\x0b1\r2"]
    words, n = brown.word_strings(pa.array(texts))
    assert words.to_pylist() == [w for t in texts for w in tokens_of(t)[:-1]]
    assert n.tolist() == [len(tokens_of(t)) - 1 for t in texts]
