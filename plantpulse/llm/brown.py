"""Language model of word classes: exchange clustering, class transitions and word emissions.

The probability of a word is that of its class after the class of the word before, times that of the word in its class.
Classes come from exchange clustering: a word moves to the class in which its own contexts are likeliest, its own counts
taken out of the class it is in. The words of a sweep move at the same time, given the counts of the sweep before; the
first sweep moves words that occur more than a few times, the last one all.

Texts become packs once: numbers of tokens into the pack's list of different words. The words of all packs lie in buckets
by hash, with their counts and classes. A sweep tells each pack the classes of its words, a byte per word; the pack counts
the class contexts of its words, and these are added up in the buckets, where the words move. The driver gets class
counts only (`CLASSES` squared numbers and a few per class).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plantpulse.llm import tokens
from plantpulse.session import pin, scratch

#: At most 127, so that a class and a mark fit into a byte.
CLASSES = 64
#: The end of a text is the word "" and has a class of its own; words that lead no class begin in `REST`.
END, REST = 0, 1
#: Words move in a sweep when they occur at least so often.
SWEEPS = (16, 1)
#: Documents with another remainder of crc32(id) are learnt from.
FOLDS, HELD_OUT = 5, 1
#: Weight of the class frequencies in the transitions, in tokens.
PRIOR = 64.0
#: Added to a class count before its logarithm is taken for a move.
SOFT = 0.5

#: Bytes of text in a pack, and per bucket of words.
PACK_BYTES, BUCKET_BYTES = 6_000_000, 8_000_000
#: Contexts of about so many packs are added up before all of a bucket are.
GROUP_PACKS = 256
#: Bucket of the counts of class pairs.
MATRIX = -1
#: Words whose contexts are spread out over all classes at once.
WORDS_AT_ONCE = 16_384

#: Contexts travel as pieces: the numbers of some words, how many entries each has, and per entry a code and a count. A code
#: is a class before the word, after it (plus CLASSES), or that of the word itself (plus twice CLASSES).
CODES = 3 * CLASSES
#: Code of a word in a pack: its class, `MOVES` more if it may move in the sweep; `UNKNOWN` without a class.
MOVES, UNKNOWN = 128, 127


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; documents without an id are learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def squeeze(values: np.ndarray) -> bytes:
    """Numbers from 0 on, byte by byte in as many planes as the largest needs, compressed."""
    values = np.ascontiguousarray(values, dtype="<i8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(values).to_bytes(8, "little") + bytes([width]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unsqueeze(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), data[8]
    planes = np.frombuffer(pa.decompress(data[9:], n * width, codec="zstd"), dtype=np.uint8).reshape(width, n)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view("<i8").ravel()


def word_strings(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, A-Z as a-z, and how many each text has."""
    data, offsets = tokens.text_bytes(column)
    n = len(data)
    solid = ~tokens._IS_SPACE[data]
    begins = np.zeros(n, dtype=bool)
    begins[offsets[:-1][offsets[:-1] < n]] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | begins[1:]
    place = np.cumsum(solid)
    starts = np.flatnonzero(first)
    bounds = np.append(place[starts] - 1, place[-1] if n else 0).astype(np.int32)
    letters = tokens._LOWER[data[solid]]
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(letters)))
    return words, np.diff(np.searchsorted(starts, offsets))


def make_packs(docs: DataFrame, buckets: int) -> DataFrame:
    """Two kinds of rows. Without a bucket, a pack: its documents, how many tokens each has (one end included), the tokens as
    ranks of words by frequency in the pack, and the ranks of its words in the order of bucket and hash. With a bucket, the
    words of a pack in it: their hashes, ascending, and their counts in documents that are learnt from."""
    spark_schema = T.StructType([
        T.StructField("pack", T.LongType()), T.StructField("bucket", T.LongType()),
        T.StructField("docs", T.ArrayType(docs.schema["doc_id"].dataType)), T.StructField("held", T.ArrayType(T.BooleanType())),
        T.StructField("lengths", T.BinaryType()), T.StructField("tokens", T.BinaryType()), T.StructField("ranks", T.BinaryType()),
        T.StructField("hashes", T.BinaryType()), T.StructField("counts", T.BinaryType()),
    ])
    schema = to_arrow_schema(spark_schema)

    def rows(own: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in own], f.type) for f in schema], schema=schema)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = TaskContext.get().partitionId() << 32
        for batch in batches:
            for begin, end in tokens.groups(batch["text"].fill_null(""), PACK_BYTES):
                part = batch.slice(begin, end - begin)
                words, n = word_strings(part["text"])
                coded = words.dictionary_encode()
                first = np.zeros(len(words) + len(n), dtype=np.int64)
                inner = np.ones(len(first), dtype=bool)
                inner[np.cumsum(n + 1) - 1] = False
                first[inner] = coded.indices.to_numpy() + 1
                names = [b"", *(w.encode() for w in coded.dictionary.to_pylist())]
                digests = np.array([divmod(xxhash.xxh3_128_intdigest(w), 1 << 64) for w in names], dtype=np.uint64)
                held = part["held"].to_numpy(zero_copy_only=False)
                size = len(names)
                counts = np.bincount(first[np.repeat(~held, n + 1)], minlength=size)
                rank = np.empty(size, dtype=np.int64)
                rank[np.argsort(-np.bincount(first, minlength=size), kind="stable")] = np.arange(size)
                bucket = (digests[:, 0] % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((digests[:, 1], bucket))
                yield rows([{"pack": pack, "docs": part["doc_id"].to_pylist(), "held": part["held"].to_pylist(), "lengths": squeeze(n + 1), "tokens": squeeze(rank[first]), "ranks": squeeze(rank[order])}])
                yield rows([{"pack": pack, "bucket": int(bucket[own[0]]), "hashes": digests[own, 1].tobytes(), "counts": squeeze(counts[own])}
                            for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)])
                pack += 1

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held"), "text").mapInArrow(packed, spark_schema)


WORDS = "bucket bigint, pack bigint, words binary, n binary, classes binary, n_words bigint, n_tokens bigint, once bigint, twice bigint"


def _binary(values: list) -> pa.Array:
    return pa.array(values, pa.binary())


def number_words(rows: DataFrame) -> DataFrame:
    """Per bucket a row with count and class of each known word, and per pack in it a row with the numbers of its words there
    plus one; 0 is a word that occurs in no document that is learnt from. All classes are `REST`, or `END` for the end."""
    end = xxhash.xxh3_128_intdigest(b"") & (1 << 64) - 1

    def numbered(key: tuple, table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, dtype=np.uint64) for x in table["hashes"].to_pylist()]
        names, place = np.unique(np.concatenate(hashes), return_inverse=True)
        n = np.bincount(place, weights=np.concatenate([unsqueeze(x) for x in table["counts"].to_pylist()]), minlength=len(names)).astype(np.int64)
        known = n > 0
        number = np.where(known, np.cumsum(known), 0)[place]
        n, classes = n[known], np.where(names[known] == end, END, REST)
        pieces = np.split(number, np.cumsum([len(h) for h in hashes])[:-1])
        packs, none = table["pack"].to_pylist(), [None] * len(hashes)
        size = 1 + len(packs)
        return pa.table({
            "bucket": pa.array([key[0].as_py()] * size, pa.int64()), "pack": pa.array([None, *packs], pa.int64()), "words": _binary([None, *map(squeeze, pieces)]),
            "n": _binary([squeeze(n), *none]), "classes": _binary([squeeze(classes), *none]),
            **{name: pa.array([value, *none], pa.int64()) for name, value in (("n_words", len(n)), ("n_tokens", int(n.sum())), ("once", int((n == 1).sum())), ("twice", int((n == 2).sum())))},
        })

    return rows.filter("bucket is not null").select("bucket", "pack", "hashes", "counts").groupBy("bucket").applyInArrow(numbered, WORDS)


STATE = "bucket bigint, n binary, classes binary"


def first_classes(state: DataFrame) -> DataFrame:
    """The most frequent words lead a class each."""
    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, n, classes in zip(*(batch[c].to_pylist() for c in ("bucket", "n", "classes")), strict=True):
                n = np.where(unsqueeze(classes) == END, 0, unsqueeze(n))
                best = np.argsort(-n, kind="stable")[: CLASSES - 2]
                best = best[n[best] > 0]
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(best), pa.int64()), pa.array(best, pa.int64()), pa.array(n[best], pa.int64())], ["bucket", "word", "n"])

    top = state.mapInArrow(frequent, "bucket bigint, word bigint, n bigint").orderBy(F.desc("n"), "bucket", "word").limit(CLASSES - 2).collect()
    lead: dict[int, list[tuple[int, int]]] = {}
    for i, r in enumerate(top):
        lead.setdefault(r["bucket"], []).append((r["word"], REST + 1 + i))

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for bucket, classes in zip(batch["bucket"].to_pylist(), batch["classes"].to_pylist(), strict=True):
                classes = unsqueeze(classes)
                for word, c in lead.get(bucket, ()):
                    classes[word] = c
                out.append(squeeze(classes))
            yield pa.RecordBatch.from_arrays([batch["bucket"], batch["n"], _binary(out)], ["bucket", "n", "classes"])

    return state.mapInArrow(led, STATE)


def tell(places: DataFrame, state: DataFrame, least: int | None) -> DataFrame:
    """`pack, bucket, codes, words, n`: for the words of a pack in a bucket their codes, and their numbers (for a sweep) or
    counts (with no `least`)."""
    def told(places: pa.Table, state: pa.Table) -> pa.Table:
        classes, n = (np.concatenate([[first], unsqueeze(state[c][0].as_py())]) for c, first in (("classes", UNKNOWN), ("n", 0)))
        codes = np.where((n >= least) & (classes != END) & (n > 0), classes + MOVES, classes) if least is not None else classes
        words = [unsqueeze(x) for x in places["words"].to_pylist()]
        return pa.table({
            "pack": places["pack"], "bucket": places["bucket"], "codes": _binary([codes[w].astype(np.uint8).tobytes() for w in words]),
            "words": _binary([None if least is None else squeeze(w) for w in words]), "n": _binary([squeeze(n[w]) if least is None else None for w in words]),
        })

    schema = "pack bigint, bucket bigint, codes binary, words binary, n binary"
    return places.select("bucket", "pack", "words").groupBy("bucket").cogroup(state.groupBy("bucket")).applyInArrow(told, schema)


def _by_rank(pack: pa.Table, told: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code, number or count, and bucket of the words of a pack by their rank."""
    told = told.sort_by("bucket")
    ranks = unsqueeze(pack["ranks"][0].as_py())
    codes = np.frombuffer(b"".join(told["codes"].to_pylist()), dtype=np.uint8)
    values = [unsqueeze(x) for x in told[column].to_pylist()]
    out = []
    for x in (codes.astype(np.int64), np.concatenate(values), np.repeat(told["bucket"].to_numpy(), [len(v) for v in values])):
        out.append(np.empty(len(ranks), dtype=np.int64))
        out[-1][ranks] = x
    return out[0], out[1], out[2]


def to_piece(word: np.ndarray, code: np.ndarray, n: np.ndarray) -> bytes:
    """Entries with one row per (word, code), ordered by word."""
    begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, dtype=np.int64)
    parts = [squeeze(x) for x in (np.diff(word[begin], prepend=0), np.diff(np.append(begin, len(word))), code, n)]
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def from_piece(piece: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, out = 0, []
    for _ in range(4):
        size = int.from_bytes(piece[at : at + 8], "little")
        out.append(unsqueeze(piece[at + 8 : at + 8 + size]))
        at += 8 + size
    word, each, code, n = out
    return np.repeat(np.cumsum(word), each), code, n


def merged(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of several pieces, equal ones added up, ordered by word and code."""
    word, code, n = (np.concatenate(x) for x in zip(*map(from_piece, pieces), strict=True))
    key, place = np.unique(word * CODES + code, return_inverse=True)
    return key // CODES, key % CODES, np.bincount(place, weights=n, minlength=len(key)).astype(np.int64)


def _pair_piece(cls: np.ndarray) -> bytes:
    """Class pairs of documents behind one another; the first one begins as if after an end."""
    pairs = np.bincount(np.concatenate([[END], cls[:-1]]) * CLASSES + cls, minlength=CLASSES * CLASSES)
    some = np.flatnonzero(pairs)
    return to_piece(some // CLASSES, some % CLASSES, pairs[some])


PIECES = "bucket bigint, part bigint, piece binary"


def _pieces(out: list[tuple[int, int, bytes]]) -> pa.Table:
    columns = list(zip(*out, strict=True)) or [[]] * 3
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "part", "piece"])


def _learnt(pack: pa.Table) -> np.ndarray:
    """The tokens of a pack's documents that are learnt from."""
    held = np.array(pack["held"][0].as_py(), dtype=bool)
    return unsqueeze(pack["tokens"][0].as_py())[np.repeat(~held, unsqueeze(pack["lengths"][0].as_py()))]


def contexts(packs: DataFrame, told: DataFrame, parts: int) -> DataFrame:
    """Pieces per bucket with the contexts of all words that may move, and the class pairs as bucket `MATRIX`."""
    def counted(pack: pa.Table, told: pa.Table) -> pa.Table:
        token = _learnt(pack)
        if not len(token):
            return _pieces([])
        code, number, bucket = _by_rank(pack, told, "words")
        part = pack["pack"][0].as_py() % parts
        cls = (code & 127)[token]
        # The end of a text never moves, so that there is always a token before and after; a pack begins as after an end.
        some = np.flatnonzero(code[token] >= MOVES)
        before = np.concatenate([[END], cls[:-1]])[some]
        entry, n = np.unique(np.concatenate([token[some] * CODES + before, token[some] * CODES + CLASSES + cls[some + 1]]), return_counts=True)
        words = np.flatnonzero(np.bincount(token[some], minlength=len(code)))
        entry, n = np.concatenate([entry, words * CODES + 2 * CLASSES + (code & 127)[words]]), np.concatenate([n, np.ones(len(words), dtype=n.dtype)])
        word = entry // CODES
        order = np.lexsort((number[word], bucket[word]))
        word, entry, n = word[order], entry[order], n[order]
        cuts = np.append(np.flatnonzero(np.diff(bucket[word], prepend=-2)), len(word))
        return _pieces([(MATRIX, part, _pair_piece(cls)), *((int(bucket[word[a]]), part, to_piece(number[word[a:b]], entry[a:b] % CODES, n[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True))])

    def added(key: tuple, table: pa.Table) -> pa.Table:
        return _pieces([(key[0].as_py(), key[1].as_py(), to_piece(*merged(table["piece"].to_pylist())))])

    told = told.select("pack", "bucket", "codes", "words")
    return _with_packs(packs, told, counted, PIECES).groupBy("bucket", "part").applyInArrow(added, PIECES)


def _with_packs(packs: DataFrame, told: DataFrame, function, schema: str) -> DataFrame:
    return packs.select("pack", "held", "lengths", "tokens", "ranks").groupBy("pack").cogroup(told.groupBy("pack")).applyInArrow(function, schema)


def _pair_counts(pieces: DataFrame) -> np.ndarray:
    """How often each class follows each class; added up on the executors."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch["piece"].to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in from_piece(piece)], ["a", "b", "n"])

    rows = pieces.filter(F.col("bucket") == MATRIX).select("piece").mapInArrow(listed, "a bigint, b bigint, n bigint")
    pairs = np.zeros((CLASSES, CLASSES))
    for r in rows.groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        pairs[r["a"], r["b"]] = r["n"]
    return pairs


def best_classes(left: np.ndarray, right: np.ndarray, own: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """For words with counts of the classes before and after them, and their present class: the class they are likeliest in."""
    n, total = left.sum(axis=1), pairs.sum(axis=1)
    logs, size = np.log(pairs + SOFT), np.log(total + SOFT)
    # Transitions into the class and out of it, over the size of the class for these and for the emission.
    gain = left @ logs + right @ logs.T - 2 * n[:, None] * size
    into, out = np.maximum(pairs.T[own] - left, 0), np.maximum(pairs[own] - right, 0)
    stay = (left * np.log(into + SOFT)).sum(axis=1) + (right * np.log(out + SOFT)).sum(axis=1) - 2 * n * np.log(np.maximum(total[own] - n, 0) + SOFT)
    gain[np.arange(len(n)), own] = stay
    gain[:, END] = -np.inf
    best = gain.argmax(axis=1)
    return np.where(gain.max(axis=1) > stay, best, own)


def moves(state: DataFrame, pieces: DataFrame, pairs: np.ndarray) -> DataFrame:
    """The buckets after the moves of a sweep."""
    def moved(state: pa.Table, pieces: pa.Table) -> pa.Table:
        if not len(pieces):
            return state
        number, code, n = merged(pieces["piece"].to_pylist())
        begin = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        word = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(number))))
        classes = unsqueeze(state["classes"][0].as_py())
        for a in range(0, len(begin), WORDS_AT_ONCE):
            count = min(WORDS_AT_ONCE, len(begin) - a)
            some = slice(*np.searchsorted(word, [a, a + count]))
            seen = np.bincount((word[some] - a) * CODES + code[some], weights=n[some], minlength=count * CODES).reshape(count, CODES)
            to = best_classes(seen[:, :CLASSES], seen[:, CLASSES : 2 * CLASSES], seen[:, 2 * CLASSES :].argmax(axis=1), pairs)
            classes[number[begin[a : a + count]] - 1] = to
        return pa.table({"bucket": state["bucket"], "n": state["n"], "classes": _binary([squeeze(classes)])})

    return state.groupBy("bucket").cogroup(pieces.filter(F.col("bucket") != MATRIX).groupBy("bucket")).applyInArrow(moved, STATE)


def exchanged(packs: DataFrame, places: DataFrame, state: DataFrame, parts: int) -> DataFrame:
    """The buckets after the sweeps of exchange clustering."""
    for least in SWEEPS:
        with scratch(packs.sparkSession) as keep:
            pieces = pin(contexts(packs, tell(places, state, least), parts))
            state = keep(pin(moves(state, pieces, _pair_counts(pieces))))
    return state


@dataclass
class Model:
    """What scoring needs beside the words: base-10 logarithms of class transitions (the last row is after an unknown word)
    and of an unknown word after each class, the discount and size of each class, and the totals."""

    steps: np.ndarray
    unknown: np.ndarray
    sizes: np.ndarray
    discount: float
    n_tokens: int
    n_words: int


def estimate(pairs: np.ndarray, words_in_class: np.ndarray, n_tokens: int, n_words: int, once: int, twice: int) -> Model:
    """Transitions drawn towards class frequencies; each word of a class gives the discount of its count to unknown words."""
    discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.1
    sizes = pairs.sum(axis=0)
    share = sizes / max(sizes.sum(), 1)
    steps = np.vstack([(pairs + PRIOR * share) / (pairs.sum(axis=1, keepdims=True) + PRIOR), share])
    free = np.divide(discount * words_in_class, sizes, out=np.zeros(CLASSES), where=sizes > 0)
    unknown = steps @ free if n_words else np.ones(CLASSES + 1)
    with np.errstate(divide="ignore"):
        return Model(np.log10(steps), np.log10(unknown), sizes, discount, n_tokens, n_words)


def _scored(packs: DataFrame, model: Model, kind: str) -> DataFrame:
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                token, lengths, cls, count = (unsqueeze(batch[c][r].as_py()) for c in ("tokens", "lengths", "classes", "n"))
                base = np.log10((count + 0.5) / (model.n_tokens + 0.5 * (model.n_words + 1)))
                emit = np.zeros(len(cls))
                some = cls < CLASSES
                emit[some] = np.log10((count[some] - model.discount) / model.sizes[cls[some]])
                first = np.cumsum(lengths) - lengths
                here = cls[token]
                before = np.concatenate([[END], np.minimum(here[:-1], CLASSES)])
                before[first] = END
                known = here < CLASSES
                step = np.where(known, model.steps[before, np.minimum(here, CLASSES - 1)] + emit[token], model.unknown[before])
                score = np.add.reduceat(step, first)
                own = [batch["docs"][r].values, batch["held"][r].values, pa.array(lengths), pa.array(np.add.reduceat(known.astype(np.int64), first)), pa.array(np.full(len(lengths), model.n_tokens)),
                       pa.array(np.add.reduceat(base[token], first)), pa.array(score), pa.array(10 ** np.minimum(-score / lengths, 300))]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(own, arrow, strict=True)], schema=arrow)

    return packs.mapInArrow(run, schema)


def told_packs(packs: DataFrame, told: DataFrame) -> DataFrame:
    """`pack, classes, n, pairs`: the final classes and counts of a pack's words by rank, and its class pairs."""
    def joined(pack: pa.Table, told: pa.Table) -> pa.Table:
        code, n, _ = _by_rank(pack, told, "n")
        learnt = _learnt(pack)
        pairs = _pair_piece(code[learnt]) if len(learnt) else None
        return pa.table({"pack": pack["pack"], "tokens": pack["tokens"], "lengths": pack["lengths"], "held": pack["held"], "docs": pack["docs"], "classes": _binary([squeeze(code)]), "n": _binary([squeeze(n)]), "pairs": _binary([pairs])})

    kept = packs.select("pack", "tokens", "lengths", "held", "docs", "ranks")
    docs = packs.schema["docs"].dataType.simpleString()
    schema = f"pack bigint, tokens binary, lengths binary, held array<boolean>, docs {docs}, classes binary, n binary, pairs binary"
    return kept.groupBy("pack").cogroup(told.select("pack", "bucket", "codes", "n").groupBy("pack")).applyInArrow(joined, schema)


def class_scores(docs: DataFrame) -> DataFrame:
    """`doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity` for every row of `docs`.

    Columns `doc_id, text` are read, others are not. A null or empty text is one token, its end. `n_known` counts tokens
    whose word occurs in a document that is learnt from, `train_tokens` all tokens of these; `base_score` is the base-10
    logarithm of the text's probability by single words, `score` that by word classes. All words that are not known count
    as one. Repeated rows are learnt from and scored as often as they occur. With nothing to learn from every token has
    probability 1 in both. An empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rows = pin(make_packs(docs, 1 + size // BUCKET_BYTES))
    packs = rows.filter("bucket is null")
    words = pin(number_words(rows))
    places = words.filter("pack is not null")
    totals = words.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_tokens", "n_words", "once", "twice")]).first()
    n_tokens, n_words, once, twice = (int(x) for x in totals)
    state = pin(first_classes(words.filter("pack is null").select("bucket", "n", "classes")))
    state = exchanged(packs, places, state, 1 + packs.count() // GROUP_PACKS)
    told = pin(told_packs(packs, tell(places, state, None)))
    pairs = _pair_counts(told.filter("pairs is not null").select(F.lit(MATRIX).alias("bucket"), F.col("pairs").alias("piece")))
    return _scored(told, estimate(pairs, _words_per_class(state), n_tokens, n_words, once, twice), kind)


def _words_per_class(state: DataFrame) -> np.ndarray:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for classes in batch["classes"].to_pylist():
                n = np.bincount(unsqueeze(classes), minlength=CLASSES)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(n)], ["class", "n"])

    out = np.zeros(CLASSES)
    for r in state.mapInArrow(counted, "class bigint, n bigint").groupBy("class").agg(F.sum("n").alias("n")).collect():
        out[r["class"]] = r["n"]
    return out
