import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from plantpulse.llm import decontaminate, jaccard, repeats, token_shards, tokens

from .conftest import result


# Token shards


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation_is_one_to_one_and_keyed(n):
    a, b = token_shards.permuted(np.arange(n), n, 1), token_shards.permuted(np.arange(n), n, 2)
    assert sorted(a) == list(range(n)) and sorted(b) == list(range(n))
    assert n < 100 or (a != b).any() and abs(np.corrcoef(np.arange(n), a)[0, 1]) < 0.2


def test_encoder_equals_the_plain_encoder():
    e = token_shards.encoder()
    for text in ("a b c", "two  spaces", "end ", " start", "line\n next \n x", "tab\t y", "don't stop 12 !!", "é ñ z", "x  y"):
        assert e.encode(text) == np.array([*e.encoding.encode_ordinary(text), e.end], dtype="<u2").tobytes()
    assert e.encode(None) == e.encode("") == np.array([e.end], dtype="<u2").tobytes()


def test_shards_give_back_every_token(spark, docs, doc_rows, nothing, clashing, tmp_path):
    done = token_shards.write_shards(docs, str(tmp_path / "a"), tokens=64, slots=40)
    rows = sorted(token_shards.read_records(spark, done).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(done["sequences"])) and all(r.whole for r in rows)
    assert sorted(r.sequence for r in rows) == list(range(done["sequences"]))
    assert {len(r.record) for r in rows} == {token_shards.stride(64)}
    order = sorted(rows, key=lambda r: r.sequence)
    body = lambda r: r.record[token_shards.HEADER_BYTES : token_shards.HEADER_BYTES + 2 * r.n_tokens]
    stream = np.frombuffer(b"".join(map(body, order)), dtype="<u2")
    e = token_shards.encoder()
    parts = np.split(stream, np.flatnonzero(stream == e.end) + 1)[:-1]
    assert Counter(e.encoding.decode(list(p[:-1])) for p in parts) == Counter(r[1] or "" for r in doc_rows)
    # The file is the array of records, and a reader can begin at any slot.
    shard = sorted((tmp_path / "a" / "shard=1").glob("part-*"))
    data = shard[0].read_bytes()
    assert len(shard) == 1 and data[5 * done["stride"] : 6 * done["stride"]] == rows[45].record
    assert sorted(r.slot for r in token_shards.read_records(spark, done, 30, 25).collect()) == list(range(30, 55))
    again = token_shards.write_shards(docs, str(tmp_path / "b"), tokens=64, slots=40)
    assert result(token_shards.shard_table(spark, again)) == result(token_shards.shard_table(spark, done))
    assert token_shards.write_shards(clashing, str(tmp_path / "c"), tokens=64)["tokens"] == done["tokens"]
    assert token_shards.shard_table(spark, token_shards.write_shards(nothing, str(tmp_path / "d"))).count() == 0


# Words and decontamination


def test_words_are_those_of_the_pattern():
    texts = ["A b\tc", None, "", " \n", "x", "é É a b", "a" * 5000 + " b"]
    found = tokens.words(pa.array(texts, pa.string()))
    own = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert list(np.diff(found.first)) == [len(w) for w in own]
    fold = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w)
    names = {}
    for w, h in zip([fold(w) for ws in own for w in ws], found.hashes.tolist(), strict=True):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def leak_rows():
    rng = random.Random(5)
    prose = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    items = [prose(n) for n in (30, 25, 16, 12, 8, 5, 3)] + [[]]
    docs = []
    for i, item in enumerate(items[:6]):
        docs.append((10 * i, prose(40) + item + prose(20)))
        changed = list(item)
        if len(item) >= 16:
            changed[len(item) // 2] = "changed"
            docs.append((10 * i + 1, prose(5) + changed + prose(5)))
        docs.append((10 * i + 2, prose(10) + item[: len(item) // 3] + prose(60)))
    docs += [(900, items[6] * 5), (901, []), (902, items[0] + items[1])]
    return items, docs


def test_leaks_are_found_through_changed_words(spark, nothing, clashing):
    items, docs = leak_rows()
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(99, None)], "item_id long, text string")
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs] + [(None, None)], "doc_id long, text string")
    want = {(10 * i, i) for i in range(6)} | {(10 * i + 1, i) for i in range(3)} | {(902, 0), (902, 1)}
    found = decontaminate.leaks(df, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)
    at = {(r.doc_id, r.item_id): r for r in found}
    assert (at[0, 0].first_word, at[0, 0].n_words, at[0, 0].n_equal) == (40, 30, 30)
    assert (at[1, 0].first_word, at[1, 0].n_words, at[1, 0].n_equal) == (5, 30, 29)
    # The same in blocks of a few items.
    blocks = list(decontaminate.blocks(benchmark, 20))
    assert len(blocks) > 3 and sum(len(b.ids) for b in blocks) == len(items) + 1
    kept = decontaminate.without_leaks(df, benchmark)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want} | {None}
    assert decontaminate.leaks(nothing, benchmark).count() == 0 and decontaminate.leaks(df, benchmark.limit(0)).count() == 0
    assert decontaminate.without_leaks(clashing, benchmark).columns == clashing.columns


# Repeated passages


def removed(rows):
    seen = {}
    for d, t in rows:
        if d is not None:
            for i in range(len(t) - 49):
                w = t[i : i + 50]
                seen[w] = min(seen.get(w, d), d)
    out = []
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if d is not None and seen[t[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        spans = [m.span() for m in re.finditer(b"\1+", gone)]
        out.append((d, len(t), sum(gone), len(spans), hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest(), spans))
    return sorted(out, key=repr)


def found_repeats(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, [tuple(x) for x in r.spans]) for r in repeats.repeated_passages(df).collect()), key=repr)


def test_repeats_are_those_of_brute_force(docs, doc_rows, nothing, clashing, monkeypatch):
    want = removed([(r[0], (r[1] or "").encode()) for r in doc_rows])
    assert found_repeats(docs) == want
    for name, value in (("BUCKET_PHRASES", 60), ("PACK_PHRASES", 50), ("BUCKET_RUNS", 200), ("PACK_RUNS", 300)):
        monkeypatch.setattr(repeats, name, value)
    assert found_repeats(clashing) == want
    assert repeats.repeated_passages(nothing).count() == 0


def test_repeats_of_dull_and_shifted_bytes(spark):
    rng = random.Random(3)
    pool = ["".join(rng.choice("ab") for _ in range(rng.randint(30, 120))) for _ in range(12)] + ["a" * 130, "ab" * 60, "é" * 40]
    rows = [(i, "".join(rng.choice(pool)[rng.randint(0, 9) :] for _ in range(rng.randint(0, 6)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    assert found_repeats(df) == removed([(d, t.encode()) for d, t in rows])


def test_repeats_beside_a_side_of_any_hash(spark):
    """Passages that documents share only up to a trigger, on sides whose hash begins or ends with 16 zero bits."""
    data = np.random.Generator(np.random.PCG64(8)).integers(97, 123, 3_000_000, dtype=np.uint8)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(repeats._BYTES[data] * tokens.powers(len(data), repeats._BASE), dtype=np.uint64)])
    back = tokens.powers(len(data) + 1, repeats._INVERSE)
    found = repeats.phrases(data, np.array([0, len(data)]))
    reach = repeats.PLACES - 1
    p = found.trigger[found.low == found.trigger - reach]
    begin, end = p - repeats.SIDE, p + repeats.TRIGGER_BYTES
    side = tokens.mix((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64))
    high, rest = p[side >> np.uint64(48) == 0], p[side % np.uint64(0xFFFF) == 0]
    assert len(high) and len(rest)
    rng = random.Random(4)
    own = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(90))
    passages = [data[q - reach : q + repeats.TRIGGER_BYTES].tobytes().decode() for q in [*high[:3], *rest[:3]]]
    rows = [(10 * k + i, own() + x + own()) for k, x in enumerate(passages) for i in range(8)]
    want = removed([(d, t.encode()) for d, t in rows])
    assert sum(n >= 50 for _, _, n, *_ in want) == 7 * len(passages)
    assert found_repeats(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_a_hot_suffix_travels_once_a_pack(spark, monkeypatch, tmp_path):
    """Whatever the number of documents that hold a suffix, a pack hands on only its smallest one's; results stay those of brute force."""
    rng = random.Random(6)
    own = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    hot, mild = own(140), own(140)
    rows = [(i // 2 * 2, own(80) + (hot if i % 3 else mild if i % 5 == 0 else "") + own(80)) for i in range(120)] + [(None, hot)]
    plain = repeats._repeated_runs

    def counted(table):
        told, most = 0, 0
        for cell in table.to_pylist():
            if cell["kind"] == 1:
                told += len(repeats._from_steps(cell["texts"]))
                continue
            docs = repeats._from_planes(cell["docs"], np.int64)[repeats._from_steps(cell["texts"])]
            by_name = {}
            for name, doc in zip(repeats._from_planes(cell["names"], np.uint64).tolist(), docs.tolist(), strict=True):
                by_name.setdefault(name, set()).add(doc)
            most = max([most, *map(len, by_name.values())])
        (tmp_path / str(random.SystemRandom().random())).write_text(f"{told} {most}")
        return plain(table)

    monkeypatch.setattr(repeats, "_repeated_runs", counted)
    want = removed([(d, t.encode()) for d, t in rows])
    for n_runs in (1_000_000, 500):
        monkeypatch.setattr(repeats, "PACK_RUNS", n_runs)
        monkeypatch.setattr(repeats, "BUCKET_RUNS", n_runs)
        assert found_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)) == want
    told, most = zip(*(map(int, f.read_text().split()) for f in tmp_path.iterdir()), strict=True)
    assert sum(told) > 0 and max(most) == 1


def test_phrases_cover_every_match_once():
    data = np.frombuffer(random.Random(1).randbytes(3000), dtype=np.uint8)
    offsets = np.array([0, 0, 700, 730, 779, 829, 3000])
    found = repeats.phrases(data, offsets)
    starts = [(r, s) for r, a, b in zip(found.row, found.low, found.high, strict=True) for s in range(a, b + 1)]
    assert sorted(starts) == [(r, s) for r in range(6) for s in range(offsets[r], offsets[r + 1] - 49)]
    assert all(a <= t and b + 50 >= t + repeats.TRIGGER_BYTES for a, b, t in zip(found.low, found.high, found.trigger, strict=True))


# Jaccard join


def classes(rows):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets.append((d, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()))
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min((x for x in (d, least.get(root(i))) if x is not None), default=None)
    return sorted(((d, len(s), least[root(i)]) for i, (d, s) in enumerate(sets)), key=repr)


def found_classes(df, common=jaccard.COMMON):
    return result(jaccard.near_duplicates(df, common), "doc_id", "n_shingles", "component_id")


def test_components_are_those_of_brute_force(docs, doc_rows, nothing, clashing):
    want = classes([(r[0], r[1]) for r in doc_rows])
    assert found_classes(docs) == want and found_classes(clashing) == want
    assert jaccard.near_duplicates(nothing).count() == 0


def test_components_with_common_passages_and_chains(spark, monkeypatch):
    """Most sets hold more common shingles than others, so prefixes are lengthened, in the first and in the second choice."""
    monkeypatch.setattr(jaccard, "BUCKET_SHINGLES", 300)
    monkeypatch.setattr(jaccard, "PACK_SHINGLES", 200)
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    rng = random.Random(11)
    prose = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passages = [prose(n) for n in (20, 40, 60)]
    texts = [prose(rng.randint(0, 30)) + rng.choice(passages) + prose(rng.randint(0, 60)) for _ in range(60)]
    chain = prose(80)
    for _ in range(25):
        chain = chain[3:] + prose(3)
        texts.append(chain)
    near = prose(70)
    for _ in range(40):
        w = list(near)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(70)] = f"x{rng.randrange(9)}"
        texts.append(w)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    assert found_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3) == classes(rows)


def test_sets_of_many_texts_are_made_together(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", "a b"]
    made, plain = [], jaccard.shingle_sets
    monkeypatch.setattr(jaccard, "shingle_sets", lambda text: made.append(1) or plain(text))
    found = list(jaccard._own_sets(pa.array(texts, pa.string())))
    assert len(made) == 1 and len(found) == len(texts)
    for text, own in zip(texts, found, strict=True):
        w = (text or "").split()
        assert len(own) == len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} - {()}) and (np.diff(own) > 0).all()
        assert own.tolist() == plain(tokens.words(pa.array([text], pa.string())))[0].tolist()


def test_one_document_of_each_component_stays(docs, doc_rows, clashing, nothing):
    want = {c for _, n, c in classes([(r[0], r[1]) for r in doc_rows]) if n}
    out = jaccard.one_of_each(docs).collect()
    worded = [r for r in out if (r.text or "").strip()]
    assert Counter(r.doc_id for r in worded) == Counter(want)
    assert Counter(r.doc_id for r in out if not (r.text or "").strip()) == Counter(r[0] for r in doc_rows if not (r[1] or "").strip())
    assert {tuple(r) for r in out} <= set(doc_rows)
    assert jaccard.one_of_each(clashing).columns == clashing.columns and jaccard.one_of_each(nothing).count() == 0
