import random
import tracemalloc

import numpy as np
import pyarrow as pa

from plantpulse.llm import token_shards


def test_many_texts_are_encoded_as_one_by_one():
    rng = random.Random(3)
    pieces = ["word", "Wort", "é", "日本", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "\u3000", "\x1c", "\x85", "a's", "12", ",", "x" * 70, "\u200b"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    texts += [None, "", " ", "a", " a", "a ", "a  b", "a b", "\n", "a \n", "one two three"]
    encoder = token_shards.encoder()
    want = [encoder.encode(t) for t in texts]
    for begin, end in ((0, len(texts)), (5, 60), (len(texts) - 11, len(texts)), (3, 3)):
        made = encoder.encode_all(pa.array(texts, pa.string()).slice(begin, end - begin))
        assert made.tokens().tobytes() == b"".join(want[begin:end]) and made.total * 2 == sum(map(len, want[begin:end]))
        assert np.diff(made.begin).sum() == len(made.order)


def test_nothing_is_kept_between_groups():
    encoder = token_shards.encoder()
    texts = [" ".join(f"g{g}w{i}" for i in range(30_000)) for g in range(6)]
    encoder.encode_all(pa.array(texts[:1], pa.string()))
    tracemalloc.start()
    for text in texts[1:]:
        encoder.encode_all(pa.array([text], pa.string()))
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 2_000_000
