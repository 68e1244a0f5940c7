"""Sequence packing by non-negative least squares over a histogram of lengths.

Every task streams its documents, tokenises them, and cuts full windows off long ones. What remains, in chunks of bounded
size, is packed: lengths are counted in classes, all combinations of one to three classes that fill the window are listed,
non-negative least squares finds how often to repeat each combination so that the classes' counts are met, the repeat counts
are rounded down, and the rest is packed best fit decreasing. Sequences that would keep too much padding are joined and cut
at window ends; the last of them is cut into powers of two, which need no padding.

No row is shuffled: packing well needs some thousand documents, which a task has, and not the corpus. Sequence ids hold the
task's number, so they are unique without any exchange and the same when a lost task runs again.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.text import give_back, kept, utf8

WINDOW = 2048
CLASS = 8
END = (1).to_bytes(4, "little")
#: Bounds of a chunk that is packed at once, and of a worker's cache of tokenised words.
CHUNK_DOCS, CHUNK_BYTES, CACHE_WORDS = 16_384, 32 << 20, 250_000
#: How many words a worker keeps for its next task.
KEPT_WORDS = 100_000
#: A sequence that would keep more padding than this is taken apart and cut anew.
SLACK = 16
#: ASCII marks, which the tokenizer sets apart from letters before them.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_tokenizers: dict[str, WordIds] = kept("packing")


def _letters(word: bytes) -> str:
    """The word as the tokenizer's normalizer leaves it if it is one run of letters, else nothing."""
    if word.isalpha():  # of ASCII
        return word.lower().decode()
    text = unicodedata.normalize("NFC", word.decode())
    if not text.isalpha() or "\u03a3" in text:  # a capital sigma is lowered by its place in Python only
        return ""
    text = text.lower()
    return text if text.isalpha() else ""


#: In tokens the printable bytes stand for themselves, and the rest for the characters from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {chr(b): b for b in _SHOWN} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)).difference(_SHOWN)))}


def _as_bytes(token: str) -> bytes:
    """A token of the vocabulary as bytes; a byte 0 stands for the end of a word."""
    whole = token.removesuffix("</w>")
    return bytes(map(_BYTES.__getitem__, whole)) + b"\0" * (whole != token)


class WordIds:
    """Token ids of texts, by a cache of space-separated words.

    The tokenizer drops white space and none of its tokens crosses it, so a text's ids are those of its words in order. New
    words of letters go many at once through the same vocabulary as ranked byte pairs, which is several times as fast and
    gives the same ids (see tests): the end of a word is a byte 0 there, and each word ends with its only token that has it.
    Marks at a word's end are set apart, as the tokenizer does; any other word is encoded by the tokenizer itself. When the
    cache is full it becomes the older generation, from which words that come again are taken over.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {_as_bytes(token): i for token, i in vocabulary.items() if token not in special}
        self.pairs = tiktoken.Encoding("words", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.ends[[i for token, i in ranks.items() if token.endswith(b"\0") and len(token) > 1]] = True
        self.cache: dict[bytes, bytes] = {b"": b""}
        self.older: dict[bytes, bytes] = {}

    def trim(self, words: int = KEPT_WORDS) -> None:
        """Keep the words that were met first, which are mostly the frequent ones; a worker outlives its task."""
        self.cache = dict(islice(self.cache.items(), words))
        self.older = {}

    def _encode_letters(self, words: list[tuple[bytes, str]]) -> None:
        for a in range(0, len(words), 20_000):
            part = words[a : a + 20_000]
            ids = np.array(self.pairs.encode_ordinary("\0 ".join([*(plain for _, plain in part), ""])), dtype="<u4")
            raw, at = ids.tobytes(), 0
            for (w, _), end in zip(part, (4 * np.flatnonzero(self.ends[ids]) + 4).tolist(), strict=True):
                self.cache[w] = raw[at:end]
                at = end

    def _encode_each(self, words: list[bytes]) -> None:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        self.cache.update((w, np.array(e.ids, dtype="<u4").tobytes()) for w, e in zip(words, found, strict=True))

    def _learn(self, words: set[bytes]) -> None:
        if len(self.cache) + len(words) > CACHE_WORDS:
            self.older, self.cache = self.cache, {b"": b""}
        cache, older = self.cache, self.older.get
        letters, other, composed = [], [], []
        parts: set[bytes] = set()

        def sort(w: bytes) -> bool:
            if (ids := older(w)) is not None:
                cache[w] = ids
            elif plain := _letters(w):
                letters.append((w, plain))
            else:
                return False
            return True

        for w in words:
            if not sort(w):
                core = w.rstrip(MARKS)
                if core and len(core) < len(w) and _letters(core):
                    composed.append((w, core, w[len(core) :]))
                    parts.update(composed[-1][1:])
                else:
                    other.append(w)
        other += [w for w in parts.difference(cache, words) if not sort(w)]
        self._encode_letters(letters)
        self._encode_each(other)
        cache.update((w, cache[core] + cache[tail]) for w, core, tail in composed)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [t.replace(b"\n", b" ").split(b" ") for t in texts]
        found = [list(map(self.cache.get, words)) for words in split]
        holes = [[k for k, ids in enumerate(parts) if ids is None] if None in parts else [] for parts in found]
        self._learn({words[k] for words, at in zip(split, holes, strict=True) for k in at})
        for words, parts, at in zip(split, found, holes, strict=True):
            for k in at:
                parts[k] = self.cache[words[k]]
        return [b"".join(parts) for parts in found]


def tokenizer(path: str) -> WordIds:
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 40, at_once: int = 24) -> np.ndarray:
    """x >= 0 with a @ x near b in least squares; active set, several columns a round. Nearly, not fully, optimal."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], dtype=bool)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = 0
        best = np.argsort(-gain)[:at_once]
        best = best[gain[best] > 1e-6 * max(1.0, b.max(initial=0))]
        if not len(best):
            break
        active[best] = True
        while True:
            cols = np.flatnonzero(active)
            m = a[:, cols]
            solved = np.linalg.solve(m.T @ m + 1e-8 * np.eye(len(cols)), m.T @ b)
            if (solved > 0).all():
                x[:] = 0
                x[cols] = solved
                break
            old = x[cols]
            low = solved <= 0
            if (fresh := low & (old <= 0)).any():  # columns just added that don't help
                active[cols[fresh]] = False
                continue
            step = np.min(old[low] / (old[low] - solved[low]))
            new = old + step * (solved - old)
            new[np.flatnonzero(low)[np.argmin(old[low] / (old[low] - solved[low]))]] = 0
            x[:] = 0
            x[cols] = new
            active[cols[new <= 0]] = False
    return x


def combinations(present: np.ndarray, full: int) -> np.ndarray:
    """Rows of one to three of the classes ``present`` (ascending) that add up to ``full``; 0 stands for none."""
    has = np.zeros(full + 1, dtype=bool)
    has[present] = True
    rows = [(full, 0, 0)] if has[full] else []
    rows += [(full - c, c, 0) for c in present if c <= full - c and has[full - c]]
    rows += [(full - c - d, d, c) for c in present if 3 * c <= full for d in present[present >= c] if d <= full - c - d and has[full - c - d]]
    return np.array(rows, dtype=np.int64).reshape(-1, 3)


def recipes(lengths: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """(classes, how often) by non-negative least squares against the histogram of the lengths' classes."""
    full = window // CLASS
    classes = -(-lengths // CLASS)
    count = np.bincount(classes, minlength=full + 1)
    count[0] = 0
    rows = combinations(np.flatnonzero(count), full)
    if not len(rows):
        return []
    a = np.zeros((full + 1, len(rows)))
    for j in range(3):
        np.add.at(a, (rows[:, j], np.arange(len(rows))), rows[:, j] > 0)
    x = np.floor(nnls(a, count.astype(float)) + 1e-6).astype(int)
    left, out = count.copy(), []
    for i in np.flatnonzero(x):
        parts = tuple(int(c) for c in rows[i] if c)
        need = np.bincount(parts, minlength=full + 1)
        n = int(min(x[i], (left[need > 0] // need[need > 0]).min()))
        if n > 0:
            left -= n * need
            out.append((parts, n))
    return out


def pack(lengths: list[int], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length) that hold every token of items of at most ``window`` tokens once."""
    pools: dict[int, list[int]] = {}
    for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        pools.setdefault(-(-lengths[i] // CLASS), []).append(i)
    bins: list[list[int]] = []
    if window % CLASS == 0 and lengths:
        for parts, n in recipes(np.array(lengths), window):
            bins += [[pools[c].pop() for c in parts] for _ in range(n)]
    rest = sorted((i for pool in pools.values() for i in pool), key=lambda i: (-lengths[i], i))
    room: dict[int, list[list[int]]] = {}
    levels = 0  # bit r: some sequence has room for r tokens
    for b in bins:
        r = window - sum(lengths[i] for i in b)
        if r:
            room.setdefault(r, []).append(b)
            levels |= 1 << r
    for i in rest:
        n = lengths[i]
        fits = levels >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                levels ^= 1 << r
            b.append(i)
        else:
            r, b = window, [i]
            bins.append(b)
        if r > n:
            room.setdefault(r - n, []).append(b)
            levels |= 1 << (r - n)
    whole = [b for b in bins if window - sum(lengths[i] for i in b) <= SLACK]
    loose = [i for b in bins if window - sum(lengths[i] for i in b) > SLACK for i in b]
    out = [[(i, 0, lengths[i]) for i in b] for b in whole]
    left = sum(lengths[i] for i in loose)
    size = lambda n: window if n >= window else 1 << (n.bit_length() - 1)
    now: list[tuple[int, int, int]] = []
    free = size(left) if left else 0
    for i in loose:
        start = 0
        while start < lengths[i]:
            n = min(free, lengths[i] - start)
            now.append((i, start, n))
            start, free, left = start + n, free - n, left - n
            if not free:
                out.append(now)
                now, free = [], size(left) if left else 0
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document in its sequence; see PIECES. ``with_ids`` adds the piece's token ids.

    A null or empty text is one token, the end. Repeated rows are packed each for itself; a null id stays null. Texts of any
    length are tokenised whole and cut at window ends. An empty table gives an empty result. Other columns are not read.
    """
    extra = ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back("packing")
        words = tokenizer(tokenizer_path)
        task = TaskContext.get().partitionId() << 36
        held: list[tuple[int | None, bytes, int]] = []  # id, ids of the last window, its start
        held_bytes = 0
        rows: list[tuple] = []

        def put(doc: int | None, ids: bytes, start: int, total: int, at: int) -> None:
            nonlocal rows
            n = len(ids) // 4
            rows.append((doc, start, n, zlib.crc32(ids), total, task, at, *([np.frombuffer(ids, "<u4").tolist()] if with_ids else [])))

        def flush() -> None:
            nonlocal task, held, held_bytes
            for pieces in pack([len(ids) // 4 for _, ids, _ in held], window):
                at = 0
                for i, start, n in pieces:
                    doc, ids, base = held[i]
                    put(doc, ids[4 * start : 4 * (start + n)], base + start, base + len(ids) // 4, at)
                    at += n
                task += 1
            held, held_bytes = [], 0

        def out() -> pa.RecordBatch:
            nonlocal rows
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(7)]
            if with_ids:
                columns.append(pa.array([r[7] for r in rows], pa.list_(pa.int32())))
                names.append("ids")
            rows = []
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            docs_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a in range(0, len(texts), 256):
                for doc, ids in zip(docs_ids[a : a + 256], words.encode(utf8(texts.slice(a, 256))), strict=True):
                    ids += END
                    total, cut = len(ids) // 4, (len(ids) - 1) // (4 * window) * window
                    for start in range(0, cut, window):
                        put(doc, ids[4 * start : 4 * (start + window)], start, total, 0)
                        task += 1
                    held.append((doc, ids[4 * cut :], cut))
                    held_bytes += len(ids) - 4 * cut
                    if len(held) >= CHUNK_DOCS or held_bytes >= CHUNK_BYTES:
                        flush()
                if len(rows) >= 20_000:
                    yield out()
        flush()
        yield out()
        words.trim()
        give_back("packing")

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES + extra)
