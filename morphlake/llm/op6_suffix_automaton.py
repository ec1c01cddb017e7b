"""Benchmark decontamination by a generalised suffix automaton of the benchmark's words.

The automaton accepts every run of words of every item. Streaming a document's words through it gives, at each word, the
length of the longest run ending there that some item has; where it reaches the window (or a whole item that is
shorter), the run's words are hit. Spans longer than the length limit are cut from the text, documents hit beyond the
coverage limit are dropped.

A large benchmark is cut into parts. Tasks build an automaton of each part and leave it in the shared folder; the driver
keeps only the paths. A scanning task holds one part, and shows it a bounded buffer of texts before it takes the next.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.llm.shared import shared_folder, table
from morphlake.llm.textblocks import alphanumeric_words, encode

WINDOW = 10
#: Words of an automaton, and bytes of text that are shown to one part before the next is loaded.
MOST_WORDS, BUFFER = 250_000, 64 << 20
_TABLE = bytes(b if b else 0x20 for b in alphanumeric_words().tolist())


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of digits, ASCII letters and non-ASCII bytes."""
    return text.translate(_TABLE).split()


class Automaton:
    """All runs of words of all items; state 0 is the start. Bounded by twice the items' words."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for item, words in items:
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            coded.append((item, codes))
            last = 0
            for c in codes:
                last = self._extend(last, c)
        of: list[set] = [set() for _ in self.next]
        whole: list[list[tuple[int, object]]] = [[] for _ in self.next]
        for item, codes in coded:
            state = 0
            for c in codes:
                state = self.next[state][c]
                up = state
                while up > 0 and self.length[up] >= window and item not in of[up]:
                    of[up].add(item)
                    up = self.link[up]
            if 0 < len(codes) < window:
                while self.length[self.link[state]] >= len(codes):
                    state = self.link[state]
                whole[state].append((len(codes), item))
        self.items, self.short = [()] * len(self.next), [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            parent = self.link[state]
            self.short[state] = (*whole[state], *self.short[parent])
            if self.length[state] >= window:  # the items of the state that holds the last ``window`` words
                self.items[state] = tuple(of[state]) if self.length[parent] < window else self.items[parent]

        self.least = min([window, *(n for s in self.short for n, _ in s)])

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _state(self, length: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        twin = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[twin], self.link[q] = self.link[q], twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words are inside an occurrence, and the items that occur."""
        hit, found = np.zeros(len(words) + 1, dtype=np.int32), set()
        look = self.vocabulary.get
        codes = np.fromiter(map(look, words, repeat(-1)), dtype=np.int64, count=len(words))
        known = np.concatenate([[False], codes >= 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= self.least:
                self._run(codes[a:b].tolist(), a, hit, found)
        return np.cumsum(hit[:-1]) > 0, found

    def _run(self, codes: list[int], start: int, hit: np.ndarray, found: set) -> None:
        state = matched = 0
        edges, link, length, window = self.next, self.link, self.length, self.window
        for at, c in enumerate(codes, start + 1):
            step = edges[state].get(c)
            while step is None and state:
                state = link[state]
                matched = length[state]
                step = edges[state].get(c)
            if step is None:
                continue
            state, matched = step, matched + 1
            if matched >= window:
                hit[at - window] += 1
                hit[at] -= 1
                below = state
                while length[link[below]] >= matched:
                    below = link[below]
                found.update(self.items[below])
            for n, item in self.short[state]:
                if n <= matched:
                    hit[at - n] += 1
                    hit[at] -= 1
                    found.add(item)


def automata(benchmark: DataFrame, window: int = WINDOW, most_words: int = MOST_WORDS) -> list[str]:
    """Build an automaton of each ``most_words`` words (an item is never cut) in a task; the paths of the written ones."""
    texts = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null")
    total = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-int(total) // (most_words * 2)))
    folder = f"{shared_folder(benchmark.sparkSession)}/automata-{uuid.uuid4().hex}"

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        name = uuid.uuid4().hex
        rows = sorted({(i is None, i or "", t) for i, t in zip(pdf["item"], pdf["text"], strict=True)})
        with system.open_output_stream(f"{base}/{name}") as out:
            out.write(pickle.dumps(Automaton([(None if missing else i, words_of(t.encode("utf-8", "surrogatepass"))) for missing, i, t in rows], window)))
        return pd.DataFrame({"path": [f"{folder}/{name}"]})

    part = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
    return sorted(r["path"] for r in texts.withColumn("part", part).groupBy("part").applyInPandas(build, "path string").collect())  # a row a part


_loaded: tuple[str, Automaton] | None = None


def _load(path: str) -> Automaton:
    """The automaton at ``path``; a worker keeps the last one it has read."""
    global _loaded
    if _loaded is None or _loaded[0] != path:
        from pyarrow import fs

        _loaded = None
        system, name = fs.FileSystem.from_uri(path)
        with system.open_input_stream(name) as source:
            _loaded = (path, pickle.loads(source.read()))
    return _loaded[1]


def _buffers(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], list[list[bytes]]]]:
    """Consecutive batches with their texts' bytes, until the texts fill the buffer."""
    held, texts, size = [], [], 0
    for batch in batches:
        held.append(batch)
        texts.append(encode(batch.column(column).to_pylist()))
        size += sum(map(len, texts[-1]))
        if size > BUFFER:
            yield held, texts
            held, texts, size = [], [], 0
    if held:
        yield held, texts


def _scan(texts: list[list[bytes]], paths: list[str]) -> list[list[tuple[np.ndarray, set]]]:
    """Hit words and items of every text, over all parts."""
    out = [[(np.zeros(0, dtype=bool), set())] * len(batch) for batch in texts]
    for number, path in enumerate(paths):
        automaton = _load(path)
        for b, batch in enumerate(texts):
            for i, text in enumerate(batch):
                hit, found = automaton.scan(words_of(text))
                out[b][i] = (hit | out[b][i][0], found | out[b][i][1]) if number else (hit, found)
    return out if paths else [[(np.zeros(len(words_of(t)), dtype=bool), set()) for t in batch] for batch in texts]


def match(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_words: int = MOST_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items) of every row of ``docs``: items is the sorted list of item ids as strings.

    A window is ``window`` consecutive words of an item, or a whole item that has fewer words, but not none; a word is hit
    if it is inside an occurrence of a window. Null and empty texts have no words. An empty benchmark hits nothing; items
    of equal id count once; a null item id is left out of the list but its words are hit. Null and shared doc_ids are kept as
    they are, each row is matched by itself. Other columns, whatever their names, are ignored.
    """
    paths = automata(benchmark, window, most_words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, texts in _buffers(batches, 1):
            for batch, found in zip(held, _scan(texts, paths), strict=True):
                arrays = [batch.column(0), pa.array([len(h) for h, _ in found], pa.int64()), pa.array([int(h.sum()) for h, _ in found], pa.int64()), pa.array([sorted(x for x in f if x is not None) for _, f in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_hit", "items"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, "doc_id long, n_words long, n_hit long, items array<string>")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = 0.5, most_words: int = MOST_WORDS) -> DataFrame:
    """``docs`` without benchmark passages: hit spans are cut, rows with more than ``coverage`` of their words hit go.

    A cut takes the span's words and the signs between them; n_chars, where present, is counted anew for cut texts.
    Rows without hits come back unchanged, null texts too; ids and all other columns pass through as they are.
    """
    paths, schema = automata(benchmark, window, most_words), docs.schema
    at = docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, texts in _buffers(batches, at):
            for batch, raw, found in zip(held, texts, _scan(texts, paths), strict=True):
                keep = [not len(hit) or hit.mean() <= coverage for hit, _ in found]
                cut = {i: _without(raw[i], hit).decode("utf-8", "replace") for i, (hit, _) in enumerate(found) if keep[i] and hit.any()}
                for column, value in ((at, lambda t: t), (counted, len)) if cut else ():
                    if column is not None:
                        values = batch.column(column).to_pylist()
                        for i, t in cut.items():
                            values[i] = value(t)
                        batch = batch.set_column(column, batch.schema.field(column), pa.array(values, batch.schema.field(column).type))
                yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, schema)


def _without(text: bytes, hit: np.ndarray) -> bytes:
    word = np.frombuffer(text.translate(_TABLE), dtype=np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    runs = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    out, at = [], 0
    for a, b in zip(runs[0::2], runs[1::2], strict=True):
        out.append(text[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, text[at:]])


def op6_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
