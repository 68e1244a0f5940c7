"""Language-model scores by a weighted backoff automaton over all words and all n-grams that occur twice or more.

Words, bigrams and trigrams of the training rows are all counted; those bigrams and trigrams that occur at least ``LEAST``
times, a threshold that is the same at every size, are arcs, so the model grows with the corpus. States are contexts; an arc
carries the discounted log-probability of a word after its context and leads to the longest known context that follows; a
failure arc carries the context's backoff weight and leads to the context without its oldest word. Backoff weights come from
the arcs that are kept, so probabilities after any context add up to one.

The automaton is never whole in one place. Texts are cut into chunks of about ``CHUNK`` tokens, one row each. A chunk asks for
the counts of its distinct words and bigrams, then of those trigrams whose two bigrams are kept (no other can occur twice).
Keys are 64 bits of hash, sorted and packed in ranges, and an ask carries the chunk's own training counts: the task that gets
a range adds them up over all chunks and answers each of them, so counting and looking up are one exchange. Sums of the
probabilities after each context, of a bigram by the one chunk that owns it, of a trigram by the task that counts it, give
backoff weights, which go to the chunks that were told of the context. In the end each chunk builds the states and arcs that
its texts can reach and walks each text once from left to right. At 5 thousand million distinct n-grams, about one pair of
hashes is expected to collide.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.text import give_back, spaced_words, utf8
from sparkwright.sources.scratch import discard, materialize, sweep

#: Tokens of a chunk, and distinct keys of a range.
CHUNK, RANGE = 1_000_000, 500_000
#: Parts of the keys that are shuffled one after another, which bounds the disk that a shuffle takes.
SLICES = 4
#: Positions of a chunk that are walked at once.
ABREAST = 1 << 16
DISCOUNT = 0.75
#: From how many occurrences in training rows an n-gram is an arc.
LEAST = 2
#: Ends a text and, as a context, begins one. No word has a line end in it.
END = b"\n"
HELD_OUT = "pmod(crc32(cast(coalesce(cast({0} as string), '') as binary)), 5) = 1"
WORDS, PAIRS, TRIPLES = 1, 2, 3
_squeeze, _expand = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


class Hashes(dict):
    """word -> 64 bits of hash; forgets all when it is full."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def hashed(*columns: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of long columns."""
    turn = lambda x, k: x << np.uint64(k) | x >> np.uint64(64 - k)
    seed = np.full(len(columns[0]), 42, dtype=np.uint64)
    for c in columns:
        h = seed + _P5 + np.uint64(8) ^ turn(c.view(np.uint64) * _P2, 31) * _P1
        h = turn(h, 27) * _P1 + _P4
        h = (h ^ h >> np.uint64(33)) * _P2
        h = (h ^ h >> np.uint64(29)) * _P3
        seed = h ^ h >> np.uint64(32)
    return seed.view(np.int64)


def pack(values: np.ndarray) -> bytes:
    """Byte by byte of all values, so that sorted and small ones compress well."""
    return _squeeze.compress(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(_expand.decompress(data), np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


CHUNKS = "origin long, doc_ids array<long>, held array<boolean>, sizes binary, vocabulary binary, stream binary, trained long, tokens long"
_CHUNK_KINDS = pa.schema([("origin", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), *((n, pa.binary()) for n in ("sizes", "vocabulary", "stream")), ("trained", pa.int64()), ("tokens", pa.int64())])


def _chunks(limit: int):
    """Rows of texts as one row a chunk: each text's size, the chunk's distinct words and their numbers in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, origin = Hashes(), TaskContext.get().partitionId() << 33
        ids: list[int | None] = []
        held: list[bool] = []
        sizes: list[int] = []
        stream: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal origin
            vocabulary, numbers, often = np.unique(np.array(stream, dtype=np.uint64), return_inverse=True, return_counts=True)
            ranked = np.argsort(-often, kind="stable")  # frequent words get small numbers, which pack well
            vocabulary, numbers = vocabulary[ranked], np.argsort(ranked)[numbers]
            trained = sum(n for n, h in zip(sizes, held, strict=True) if not h)
            row = (origin, list(ids), list(held), pack(np.array(sizes, np.uint32)), pack(vocabulary), pack(numbers.astype(np.uint32)), trained, len(stream))
            origin += 1
            for x in (ids, held, sizes, stream):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _CHUNK_KINDS.types, strict=True)], schema=_CHUNK_KINDS)

        for batch in (whole.slice(a, 1000) for whole in batches for a in range(0, whole.num_rows, 1000)):
            for doc, out_of, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                words = spaced_words(text)
                ids.append(doc)
                held.append(out_of)
                sizes.append(len(words) + 1)
                stream.extend(map(codes.__getitem__, words))
                stream.append(codes[END])
                if len(stream) >= limit:
                    yield flush()
        if ids:
            yield flush()

    return run


class Chunk:
    """A chunk's texts as arrays. Position t of the stream is a token; before the first one stands an end."""

    def __init__(self, row: dict) -> None:
        self.ids, self.held = row["doc_ids"], np.array(row["held"], bool)
        self.sizes, self.vocabulary = unpack(row["sizes"], "<u4").astype(np.int64), unpack(row["vocabulary"], "<u8")
        self.stream = unpack(row["stream"], "<u4").astype(np.int64)
        self.end = int(np.flatnonzero(self.vocabulary == np.uint64(xxhash.xxh3_64_intdigest(END)))[0])
        self.trains = np.repeat(~self.held, self.sizes)
        self.before = np.r_[self.end, self.stream[:-1]]
        h = self.vocabulary.view(np.int64)
        self.pairs = hashed(h[self.before], h[self.stream]).view(np.uint64)
        #: Distinct pairs, and which one stands at each position.
        self.distinct, self.pair_at = np.unique(self.pairs, return_inverse=True)
        #: Words in order of their keys.
        self.order = np.argsort(self.vocabulary)

    def place(self, answers: Answers) -> Placed:
        """The kept pairs: their keys, counts and words, and which one stands at each position, -1 for none."""
        n = answers.of(PAIRS, "counts", "<i8")
        kept = np.flatnonzero(n) if len(n) else np.zeros(0, np.int64)
        number = np.full(len(self.distinct), -1)
        number[kept] = np.arange(len(kept))
        at = number[self.pair_at]
        here = np.flatnonzero(at >= 0)
        first, second = np.zeros(len(kept), np.int64), np.zeros(len(kept), np.int64)
        first[at[here]], second[at[here]] = self.before[here], self.stream[here]
        words = np.zeros(len(self.vocabulary), np.int64)
        words[self.order] = answers.of(WORDS, "counts", "<i8")
        return Placed(self.distinct[kept], n[kept], first, second, at, words)

    def triples(self, placed: Placed) -> tuple[np.ndarray, np.ndarray]:
        """(positions, keys): triples within texts, both of whose pairs are kept."""
        at = np.flatnonzero((self.before[1:] != self.end) & (placed.at[1:] >= 0) & (placed.at[:-1] >= 0)) + 1
        keys = hashed(self.pairs.view(np.int64)[at - 1], self.vocabulary.view(np.int64)[self.stream[at]], np.full(len(at), TRIPLES)).view(np.uint64)
        return at, keys


@dataclass
class Placed:
    keys: np.ndarray
    counts: np.ndarray
    first: np.ndarray
    second: np.ndarray
    at: np.ndarray
    words: np.ndarray


#: What chunks and ranges tell each other: asks, answers, and sums over the n-grams that follow a context.
_PACKED = ("keys", "counts", "owned", "context", "of_context", "lower_n", "lower_of", "taken", "lower", "back")
_ROW_KINDS = pa.schema([("what", pa.string()), ("kind", pa.int32()), ("range", pa.int64()), ("origin", pa.int64()), *((n, pa.binary()) for n in _PACKED), ("words", pa.int64())])
ROWS = "what string, kind int, range long, origin long, " + ", ".join(f"{n} binary" for n in _PACKED) + ", words long"


def _batch(n: int, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ROW_KINDS], schema=_ROW_KINDS)


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range of the key space that a key lies in; ascends with the keys."""
    return (keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)


def _by_range(what: str, kind: int, origin: int | None, keys: np.ndarray, ranges: int, **values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted keys by ranges of the key space, with what goes along."""
    of = _range_of(keys, ranges)
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    stops = np.r_[starts[1:], len(of)]
    for a in range(0, len(starts), 256):
        parts = [*zip(starts[a : a + 256], stops[a : a + 256], strict=True)]
        packed = {n: [pack(v[i:j]) for i, j in parts] for n, v in ({"keys": keys} | values).items()}
        yield _batch(len(parts), {"what": [what] * len(parts), "kind": [kind] * len(parts), "range": of[starts[a : a + 256]].astype(np.int64), "origin": [origin] * len(parts)} | packed)


def _counted(table: pa.Table) -> pa.Table:
    """Counts of a range's words or pairs over all chunks, told to each chunk in the order of the keys it asked.

    Of pairs that are not kept the count told is 0; of the kept ones, which of them the chunk owns.
    """
    rows = table.to_pylist()
    kind = rows[0]["kind"]
    keys = [unpack(r["keys"], "<u8") for r in rows]
    _, first, where = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    n = np.bincount(where, np.concatenate([unpack(r["counts"], "<u4") for r in rows])).astype(np.int64)
    words = [int((n > 0).sum()) if kind == WORDS else 0, *[0] * (len(rows) - 1)]
    if kind != WORDS:
        n[n < LEAST] = 0
    owner = np.zeros(len(where), np.uint8)
    owner[first] = n > 0
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    counts, owned = ([pack(v) for v in np.split(of, cuts)] for of in (n[where].astype("<i8"), owner))
    columns = {"what": ["answer"] * len(rows), "kind": [kind] * len(rows), "range": [r["range"] for r in rows], "origin": [r["origin"] for r in rows], "counts": counts, "owned": owned, "words": words}
    return pa.Table.from_batches([_batch(len(rows), columns)])


def _counted_triples(ranges: int):
    """Counts of a range's triples, the kept ones told to each chunk; their sums by context, as ranges of contexts."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [unpack(r["keys"], "<u8") for r in rows]
        _, first, where = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        column = lambda name, kind: np.concatenate([unpack(r[name], kind) for r in rows])
        n = np.bincount(where, column("counts", "<u4")).astype(np.int64)
        kept = np.flatnonzero(n >= LEAST)
        one = first[kept]
        taken = (n[kept] - DISCOUNT) / column("of_context", "<u4")[one]
        lower = (column("lower_n", "<u4")[one] - DISCOUNT) / column("lower_of", "<u4")[one]
        contexts, group = np.unique(column("context", "<u8")[one], return_inverse=True)
        masses = _by_range("mass", PAIRS, None, contexts, ranges, taken=np.bincount(group, taken, len(contexts)), lower=np.bincount(group, lower, len(contexts)))
        counts = [pack(v) for v in np.split(np.where(n >= LEAST, n, 0)[where].astype("<i8"), np.cumsum([len(k) for k in keys])[:-1])]
        columns = {"what": ["answer"] * len(rows), "kind": [TRIPLES] * len(rows), "range": [r["range"] for r in rows], "origin": [r["origin"] for r in rows], "counts": counts}
        return pa.Table.from_batches([_batch(len(rows), columns), *masses])

    return run


def _weighed(table: pa.Table) -> pa.Table:
    """Backoff weights of a range's contexts for the chunks that want them; nan where no kept n-gram follows.

    Rows of sums name no chunk; those that name one say which contexts it wants.
    """
    rows = [r for r in table.to_pylist() if r["what"] == "mass"]
    sums, asked = [r for r in rows if r["origin"] is None], [r for r in rows if r["origin"] is not None]
    keys, weights = np.zeros(0, np.uint64), np.zeros(0)
    if sums:
        keys, where = np.unique(np.concatenate([unpack(r["keys"], "<u8") for r in sums]), return_inverse=True)
        taken, lower = (np.bincount(where, np.concatenate([unpack(r[c], "<f8") for r in sums])) for c in ("taken", "lower"))
        weights = np.log10(np.maximum(1e-9, 1 - taken) / np.maximum(1e-9, 1 - lower))
    backs = []
    for r in asked:
        wanted = unpack(r["keys"], "<u8")
        at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
        backs.append(pack(np.where(keys[at] == wanted, weights[at], np.nan) if len(keys) else np.full(len(wanted), np.nan)))
    columns = {"what": ["weight"] * len(asked), "back": backs} | {c: [r[c] for r in asked] for c in ("kind", "range", "origin")}
    return pa.Table.from_batches([_batch(len(asked), columns)], _ROW_KINDS)


class Answers:
    """What a chunk was told, in the order of its keys."""

    def __init__(self, rows: list[dict]) -> None:
        self.rows = sorted(rows, key=lambda r: (r["kind"], r["range"]))

    def of(self, kind: int, column: str, dtype: str) -> np.ndarray:
        found = [unpack(r[column], dtype) for r in self.rows if r["kind"] == kind and r[column] is not None]
        return np.concatenate(found) if found else np.zeros(0, dtype)


def _with_chunks(step):
    """A step on (chunk, origin, answers) as a function of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in (whole.slice(i, 1) for whole in batches for i in range(whole.num_rows)):
            row = batch.to_pylist()[0]
            yield from step(Chunk(row), row["origin"], Answers([*(row.get("answers") or []), *(row.get("more") or [])]))

    return run


def _ask_counts(ranges: int):
    def step(chunk: Chunk, origin: int, _: Answers) -> Iterator[pa.RecordBatch]:
        words = np.bincount(chunk.stream[chunk.trains], minlength=len(chunk.vocabulary)).astype(np.uint32)
        yield from _by_range("ask", WORDS, origin, chunk.vocabulary[chunk.order], ranges, counts=words[chunk.order])
        counts = np.bincount(chunk.pair_at[chunk.trains], minlength=len(chunk.distinct)).astype(np.uint32)
        yield from _by_range("ask", PAIRS, origin, chunk.distinct, ranges, counts=counts)

    return _with_chunks(step)


def _ask_triples(ranges: int, total: int, types: int, asks: tuple[int, ...] = tuple(range(SLICES)), masses: bool = True):
    """Asks for the triples of some slices of the ranges, with what a range needs to add them up by context.

    If wanted, the sums of the pairs that the chunk owns, and the contexts whose weights it wants.
    """

    def step(chunk: Chunk, origin: int, answers: Answers) -> Iterator[pa.RecordBatch]:
        placed = chunk.place(answers)
        if masses:
            mine = answers.of(PAIRS, "owned", "u1")[answers.of(PAIRS, "counts", "<i8") > 0] > 0
            first = placed.first[mine]
            taken = (placed.counts[mine] - DISCOUNT) / placed.words[first]
            lower = (placed.words[placed.second[mine]] + 0.5) / (total + 0.5 * (types + 1))
            sums = [np.bincount(first, v, len(chunk.vocabulary)) for v in (taken, lower)]
            some = chunk.order[np.bincount(first, minlength=len(chunk.vocabulary))[chunk.order] > 0]
            yield from _by_range("mass", WORDS, None, chunk.vocabulary[some], ranges, taken=sums[0][some], lower=sums[1][some])
            yield from _by_range("mass", WORDS, origin, chunk.vocabulary[chunk.order[placed.words[chunk.order] >= LEAST]], ranges)
            yield from _by_range("mass", PAIRS, origin, placed.keys, ranges)
        if not asks:
            return
        at, keys = chunk.triples(placed)
        if len(asks) < SLICES:
            some = np.isin(_range_of(keys, ranges) % np.uint64(SLICES), np.array(asks, np.uint64))
            at, keys = at[some], keys[some]
        distinct, one, where = np.unique(keys, return_index=True, return_inverse=True)
        counts = np.bincount(where, chunk.trains[at], len(distinct)).astype(np.uint32)
        context, below = placed.at[at[one] - 1], placed.at[at[one]]
        values = {"context": placed.keys[context], "of_context": placed.counts[context].astype(np.uint32), "lower_n": placed.counts[below].astype(np.uint32), "lower_of": placed.words[placed.first[below]].astype(np.uint32)}
        yield from _by_range("ask", TRIPLES, origin, distinct, ranges, counts=counts, **values)

    return _with_chunks(step)


@dataclass
class Automaton:
    """Arcs in order of state << 32 | word (``keys``), each with its next state and weight; the root, state 0, has one a word."""

    base: np.ndarray
    after: np.ndarray
    keys: np.ndarray
    leads: np.ndarray
    given: np.ndarray
    fail: np.ndarray
    weight: np.ndarray
    start: int

    @property
    def root(self) -> list[tuple[int, float]]:
        return [*zip(self.after.tolist(), self.base.tolist(), strict=True)]

    @property
    def arcs(self) -> dict[int, tuple[int, float]]:
        return dict(zip(self.keys.tolist(), zip(self.leads.tolist(), self.given.tolist(), strict=True), strict=True))

    def walk(self, state: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The log-probability of each word read in a state: failure arcs are followed until an arc has the word."""
        score, left, state = np.zeros(len(words)), np.arange(len(words)), state.copy()
        while len(left):
            ended = state[left] == 0
            score[left[ended]] += self.base[words[left[ended]]]
            left = left[~ended]
            key = state[left] << 32 | words[left]
            at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            found = self.keys[at] == key if len(self.keys) else np.zeros(len(left), bool)
            score[left[found]] += self.given[at[found]]
            left = left[~found]
            score[left] += self.weight[state[left]]
            state[left] = self.fail[state[left]]
        return score


def automaton(chunk: Chunk, answers: Answers, total: int, types: int, placed: Placed | None = None) -> Automaton:
    """The states and arcs that a chunk's texts can reach.

    State w + 1 is the context of one word w, those after them are contexts of two words. A context that no kept n-gram
    follows is no state: what leads there leads to the context without its oldest word.
    """
    placed = placed or chunk.place(answers)
    words, first, second = placed.words, placed.first, placed.second
    base = np.log10((words + 0.5) / (total + 0.5 * (types + 1)))
    back_word, back_pair = np.full(len(words), np.nan), answers.of(PAIRS, "back", "<f8")
    back_word[chunk.order[words[chunk.order] >= LEAST]] = answers.of(WORDS, "back", "<f8")
    word_state = np.where(np.isnan(back_word), 0, np.arange(len(words)) + 1)
    pair_state = word_state[second]
    contexts = np.flatnonzero(~np.isnan(back_pair))
    pair_state[contexts] = len(words) + 1 + np.arange(len(contexts))
    fail = np.r_[np.zeros(len(words) + 1, np.int64), word_state[second[contexts]]]
    weight = np.r_[0.0, np.nan_to_num(back_word), back_pair[contexts]]
    at, keys = chunk.triples(placed)
    _, one = np.unique(keys, return_index=True)
    n = answers.of(TRIPLES, "counts", "<i8")
    kept = np.flatnonzero(n) if len(n) else np.zeros(0, np.int64)
    at, n = at[one[kept]], n[kept]
    context, lower = placed.at[at - 1], placed.at[at]
    keys = np.r_[(first + 1) << 32 | second, pair_state[context] << 32 | second[lower]]
    leads = np.r_[pair_state, pair_state[lower]]
    given = np.r_[np.log10((placed.counts - DISCOUNT) / words[first]), np.log10((n - DISCOUNT) / placed.counts[context])]
    by = np.argsort(keys)
    return Automaton(base, word_state, keys[by], leads[by], given[by], fail, weight, int(word_state[chunk.end]))


def scored(chunk: Chunk, answers: Answers, placed: Placed, total: int, types: int) -> np.ndarray:
    """The log-probability of each token of a chunk, ``ABREAST`` positions at once.

    The arcs of a word lead to the longest known context that it ends, whichever of them was taken, so the states of a walk from left to
    right are known beforehand: a text begins in the start state and reads each word in the state that its words before led to.
    """
    model = automaton(chunk, answers, total, types, placed)
    state = model.after[chunk.before]
    kept = np.flatnonzero(placed.at[:-1] >= 0)
    by = (placed.first + 1) << 32 | placed.second
    state[kept + 1] = model.leads[np.searchsorted(model.keys, by)][placed.at[kept]]
    state[np.cumsum(chunk.sizes) - chunk.sizes] = model.start
    return np.concatenate([model.walk(state[a : a + ABREAST], chunk.stream[a : a + ABREAST]) for a in range(0, len(state), ABREAST)])


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _walked(total: int, types: int):
    def step(chunk: Chunk, _: int, answers: Answers) -> Iterator[pa.RecordBatch]:
        placed = chunk.place(answers)
        words = placed.words
        starts = np.cumsum(chunk.sizes) - chunk.sizes
        base = np.add.reduceat(np.log10((words + 0.5) / (total + 0.5 * (types + 1)))[chunk.stream], starts)
        known = np.add.reduceat((words > 0)[chunk.stream].astype(np.int64), starts)
        scores = np.add.reduceat(scored(chunk, answers, placed, total, types), starts)
        columns = (pa.array(chunk.ids, pa.int64()), pa.array(chunk.held), pa.array(chunk.sizes), pa.array(known), pa.array(np.full(len(starts), total)), pa.array(base), pa.array(scores, pa.float64()))
        yield pa.RecordBatch.from_arrays(list(columns), names=[part.split()[0] for part in SCORES.split(", ")])

    return _with_chunks(step)


def _in_slices(make) -> DataFrame:
    """The union of ``make(condition)`` over the parts of a column's values, each written before the next is shuffled."""
    parts = []
    for i in range(SLICES):
        parts.append(materialize(make(lambda column, i=i: F.pmod(F.hash(column), F.lit(SLICES)) == i)))
        sweep(parts[-1].sparkSession)
    return functools.reduce(DataFrame.union, parts)


def _told(chunks: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """All chunks, each with all that it was told."""
    rows = answers.where("what <> 'mass'").select("origin", F.struct("kind", "range", "counts", "owned", "back").alias("answer"))
    return chunks.join(rows.groupBy("origin").agg(F.collect_list("answer").alias(name)), "origin", "left")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, ranges: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    A null or empty text is one token, its end. Repeated rows are scored each for itself, and ties can't matter; null ids
    train. With no training row every token is unknown; an empty table gives no row. A very long text is a chunk of its own.
    Other columns, whatever their names, are left alone. Words that never train are scored by a smoothed frequency of none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.expr(HELD_OUT.format(f"`{id_col}`")).alias("held_out"), F.col(text_col).alias("text"))
    chunks = materialize(rows.mapInArrow(_chunks(chunk), CHUNKS))
    total, tokens = chunks.agg(F.sum("trained"), F.sum("tokens")).first()
    total, ranges = total or 0, ranges or 1 + (tokens or 0) // RANGE
    counts = materialize(chunks.mapInArrow(_ask_counts(ranges), ROWS).groupBy("kind", "range").applyInArrow(_counted, ROWS))
    sweep(docs.sparkSession)
    types = counts.agg(F.sum("words")).first()[0] or 0
    placed = materialize(_told(chunks, counts, "answers"))
    discard(chunks)
    discard(counts)
    sweep(docs.sparkSession)
    counted = []
    for i in range(SLICES):  # what chunks ask of a slice goes straight into its shuffle and is never written
        asks = placed.mapInArrow(_ask_triples(ranges, total, types, (i,), False), ROWS)
        counted.append(materialize(asks.groupBy("kind", "range").applyInArrow(_counted_triples(ranges), ROWS)))
        sweep(docs.sparkSession)
    counted = functools.reduce(DataFrame.union, counted)
    wants = materialize(placed.mapInArrow(_ask_triples(ranges, total, types, (), True), ROWS))
    masses = wants.union(counted.where("what = 'mass'"))
    weights = _in_slices(lambda part: masses.where(part("range")).groupBy("kind", "range").applyInArrow(_weighed, ROWS))
    discard(wants)
    answers = counted.union(weights)
    result = _in_slices(lambda part: _told(placed.where(part("origin")), answers.where(part("origin")), "more").mapInArrow(_walked(total, types), SCORES))
    for table in (placed, counted, weights):
        discard(table)
    return result
