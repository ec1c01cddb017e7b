"""BPE encoding and decoding with tree concatenation.

A long text is halved at its middle, and the halves again, until each piece has at most ``piece`` characters; where the cuts
lie doesn't depend on words. Pieces are encoded in parallel. Going up the tree, two neighbouring encodings become one: a
window of one token each side of the join is encoded anew, then of two, four and so on, until its first token is the left
side's and its last token the right side's. Then every two neighbouring tokens stand as they stand in an exact encoding,
which makes the whole one exact: each merge of this vocabulary is made of earlier merges only, so what two neighbours do
depends on nothing beside them (``check_merges`` tests that a vocabulary is so). A window that meets no agreement ends as
the whole unsplit stretch, whose encoding needs none.

Inside a piece, text is encoded in runs between white space, each distinct run once while it is remembered. A text's new
runs are encoded together, a mark between them; runs that come again outlive others when the memory is full.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.llm.shared import table

#: Characters of a piece that is encoded by itself.
PIECE = 1 << 14
#: Characters on each side of a cut that decide whether it is allowed, and bytes of runs after which a worker forgets those that it hasn't met since the last time.
_NEAR, _REMEMBERED = 32, 100 << 20
#: A sign that hardly occurs in texts.
_MARK = "\x01"
_END = "</w>"


def vocabulary() -> str:
    """Path of the public vocabulary file of this operator's query."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def check_merges(model: dict) -> None:
    """Raise unless every merge joins single signs or results of earlier merges, and no two merges give the same token."""
    made: set[str] = set()
    for pair in model["merges"]:
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        if any(len(t.removesuffix(_END)) > 1 and t not in made for t in (a, b)) or a + b in made:
            raise ValueError(f"merge of {a} and {b} doesn't follow from those before it")
        made.add(a + b)


@dataclass
class Node:
    """Encoding of a stretch of text. head, tail: tokens of its first and last word where these go on beyond the stretch (else 0)."""

    ids: np.ndarray
    head: int
    tail: int


class Encoder:
    """The tokenizer at ``path``, and the same merges for part of one word, with its end and without."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        check_merges(own["model"])
        if own.get("decoder") is not None:
            raise ValueError("decoding must be the tokens with spaces between them")
        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        part = own | {"added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None}
        closed, opened = (Tokenizer.from_str(json.dumps(part | {"model": own["model"] | {"end_of_word_suffix": s}})) for s in (own["model"]["end_of_word_suffix"], None))
        self._parts = {True: closed, False: opened}
        self.special = [t["content"] for t in own["added_tokens"]]
        self.names = np.array([self.full.id_to_token(i) or "" for i in range(self.full.get_vocab_size())], dtype=object)
        self._ends_word = np.array([t.endswith(_END) or t in self.special for t in self.names])
        self._name = [t.encode("utf-8") for t in self.names]
        self._known: dict[bytes, tuple[bytes, bytes]] = {}
        self._older: dict[bytes, tuple[bytes, bytes]] = {}
        self._size = 0
        mark = self._encode([_MARK])[0]
        self._mark = mark[0] if len(mark) == 1 and self.names[mark[0]] != own["model"].get("unk_token") else None

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, runs: list[bytes]) -> list[list[int]]:
        """Ids of each run. They are encoded as one text where the marks in it, and those in its tokens, are only the ones between runs."""
        together = f" {_MARK} ".encode().join(runs)
        if self._mark is not None and together.count(_MARK.encode()) == len(runs) - 1:
            ids = self._encode([together.decode("utf-8")])[0]
            ends = [i for i, t in enumerate(ids) if t == self._mark]
            if len(ends) == len(runs) - 1:
                return [ids[x:y] for x, y in zip([0, *(e + 1 for e in ends)], [*ends, len(ids)], strict=True)]
        return self._encode([r.decode("utf-8") for r in runs])

    def _learn(self, runs: list[bytes]) -> None:
        name = self._name
        for run, ids in zip(runs, self._apart(runs), strict=True):
            self._known[run] = array("I", ids).tobytes(), b" ".join([name[i] for i in ids])

    def runs(self, text: str) -> list[tuple[bytes, bytes]]:
        """(ids, decoded) of each run between ASCII white space, at which every word ends. Ids are little-endian."""
        parts = text.encode("utf-8").split()
        if self._size > _REMEMBERED:
            self._known, self._older, self._size = {}, self._known, 0
        known, older = self._known, self._older
        new = [r for r in set(parts) if r not in known]
        if new:
            unknown = []
            for r in new:
                if r in older:
                    known[r] = older[r]
                else:
                    unknown.append(r)
            if unknown:
                self._learn(unknown)
            self._size += 400 * len(new) + 8 * sum(map(len, new))
        return [known[r] for r in parts]

    def word_text(self, ids: np.ndarray) -> str:
        """The tokens' text in the vocabulary's own signs."""
        return "".join(self.names[ids])

    def part(self, text: str, closed: bool) -> np.ndarray:
        """Tokens of a stretch of one word, in the vocabulary's own signs; closed: the word ends with it."""
        return np.array(self._parts[closed].encode(text, add_special_tokens=False).ids, dtype="<u4")

    def words(self, text: str) -> list[str]:
        return [w for w, _ in self.full.pre_tokenizer.pre_tokenize_str(self.full.normalizer.normalize_str(text))]

    def cut(self, text: str, at: int) -> tuple[int, bool] | None:
        """The first allowed cut from ``at`` on, and whether it is inside a word; None where there is none.

        A cut is allowed if the text near it gives the same words cut there as whole, the cut word apart; a word's limits
        depend on at most three signs beside them. What follows must not join the sign before it when normalised, and no
        special token may be near.
        """
        longest = max(map(len, self.special), default=0)
        for p in range(max(1, at), len(text)):
            if _joins(text[p]) or any(s in text[max(0, p - _NEAR - longest) : p + _NEAR + longest] for s in self.special):
                continue
            left, right = text[max(0, p - _NEAR) : p], text[p : p + _NEAR]
            a, b, both = self.words(left), self.words(right), self.words(left + right)
            if both == a + b:
                return p, False
            if a and b and both == [*a[:-1], a[-1] + b[0], *b[1:]]:
                return p, True
        return None

    def pieces(self, text: str, piece: int = PIECE) -> list[tuple[str, bool, bool]]:
        """(text, starts inside a word, ends inside a word) of the leaves of the halved text, in order."""
        if len(text) > piece and (found := self.cut(text, len(text) // 2)):
            at, inside = found
            left, right = self.pieces(text[:at], piece), self.pieces(text[at:], piece)
            return [*left[:-1], (*left[-1][:2], inside), (right[0][0], inside, right[0][2]), *right[1:]]
        return [(text, False, False)]

    def leaf(self, text: str, starts_inside: bool, ends_inside: bool) -> Node:
        ids = np.frombuffer(b"".join(i for i, _ in self.runs(text)), dtype="<u4")
        ends = np.flatnonzero(self._ends_word[ids]) + 1
        head = int(ends[0]) if starts_inside else 0
        tail = 0
        if ends_inside:  # its last word doesn't end here, so it's encoded again without an end
            start = int(ends[-2]) if len(ends) > 1 else 0
            word = self.part(self.word_text(ids[start:]).removesuffix(_END), closed=False)
            if starts_inside and start == 0:
                head = len(word)
            ids, tail = np.concatenate([ids[:start], word]), len(word)
        return Node(ids, head, tail)

    def join(self, left: Node, right: Node, inside: bool) -> Node:
        """One node of two neighbours; inside: their border is inside a word."""
        if not inside:
            return Node(np.concatenate([left.ids, right.ids]), left.head, right.tail)
        a, b = left.ids[len(left.ids) - left.tail :], right.ids[: right.head]
        goes_on = right.head == len(right.ids) and right.tail > 0
        k = 1
        while True:
            x, y = a[-k:], b[:k]
            text = self.word_text(np.concatenate([x, y]))
            ends = len(y) == len(b) and not goes_on
            window = self.part(text.removesuffix(_END) if ends else text, closed=ends)
            if (len(x) == len(a) or window[0] == x[0]) and (len(y) == len(b) or window[-1] == y[-1]):
                break
            k *= 2
        word = len(a) - len(x) + len(window) + len(b) - len(y)
        ids = np.concatenate([left.ids[: len(left.ids) - len(x)], window, right.ids[len(y) :]])
        head = word if left.head and left.head == len(left.ids) else left.head
        return Node(ids, head, word if goes_on else right.tail)

    def tree(self, leaves: list[Node], inside: list[bool]) -> Node:
        """All leaves joined by halves; inside[i] is said of the border after leaf i."""
        if len(leaves) == 1:
            return leaves[0]
        half = len(leaves) // 2
        return self.join(self.tree(leaves[:half], inside[:half]), self.tree(leaves[half:], inside[half:]), inside[half - 1])

    def decode(self, ids: np.ndarray) -> str:
        return self.full.decode(ids.tolist(), skip_special_tokens=False)


def _joins(sign: str) -> bool:
    """Whether a sign may join the one before it when normalised (marks, letters of Hangul), or can't be told to be safe."""
    return unicodedata.category(sign)[0] in "MC" and sign not in "\t\n\r\x0b\x0c" or "ᄀ" <= sign <= "ᇿ" or sign > "\U0000ffff"


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """A worker's encoder of a vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _encode_short(path: str, digest: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [own.runs(t) for t in part.column(1).to_pylist()]
                ids = [b"".join(i for i, _ in runs) for runs in found]
                decoded = [b" ".join(d for _, d in runs if d) for runs in found]
                yield pa.RecordBatch.from_arrays([part.column(0), *_columns(ids, decoded, digest)], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encode


def _columns(ids: list[bytes], decoded: list[bytes], digest: bool) -> list[pa.Array]:
    n = pa.array([len(i) // 4 for i in ids], pa.int64())
    if digest:
        return [n, *[pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string()) for values in (ids, decoded)]]
    lists = pa.array([np.frombuffer(i, dtype="<u4").astype(np.int64) for i in ids], pa.list_(pa.int64()))
    return [n, lists, pa.array([d.decode("utf-8") for d in decoded], pa.string())]


def _cut_long(path: str, piece: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                leaves = own.pieces(text, piece)
                columns = [[row] * len(leaves), [doc_id] * len(leaves), list(range(len(leaves))), *map(list, zip(*leaves, strict=True))]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["row", "doc_id", "at", "text", "starts_inside", "ends_inside"])

    return cut


def _encode_leaves(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            nodes = [own.leaf(*leaf) for leaf in zip(*(batch.column(c).to_pylist() for c in (3, 4, 5)), strict=True)]
            arrays = [batch.column(0), batch.column(1), batch.column(2), pa.array([n.ids.tobytes() for n in nodes], pa.binary()), pa.array([n.head for n in nodes], pa.int64()), pa.array([n.tail for n in nodes], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "at", "ids", "head", "tail"])

    return encode


def _join_leaves(path: str, digest: bool):
    def join(table: pa.Table) -> pa.Table:
        own = encoder(path)
        rows = table.sort_by("at").to_pylist()
        nodes = [Node(np.frombuffer(r["ids"], dtype="<u4"), r["head"], r["tail"]) for r in rows]
        whole = own.tree(nodes, [n.tail > 0 for n in nodes])
        columns = _columns([whole.ids.tobytes()], [own.decode(whole.ids).encode("utf-8")], digest)
        return pa.Table.from_arrays([pa.array([rows[0]["doc_id"]], pa.string()), *columns], names=["doc_id", "n_tokens", "ids", "decoded"])

    return join


def tree_encode(docs: DataFrame, path: str, piece: int = PIECE, digest: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row: token ids of the whole text, and the text that decoding them gives.

    With ``digest``, ids and decoded are SHA-256 instead, ids as little-endian unsigned 32-bit integers. Special tokens in a
    text are recognised, none are added. Null is read as empty; an empty text has no tokens. A text of more than ``piece``
    characters is cut, its pieces are encoded wherever there is room and joined in the task that holds its ids; a text
    without an allowed cut (``Encoder.cut``) is a single piece. Each row is encoded by itself, rows of equal or null id
    too. Other columns, whatever their names, are ignored.
    """
    kinds = "ids string, decoded string" if digest else "ids array<long>, decoded string"
    texts = _texts(docs)
    short = texts.where(F.length("text") <= piece).mapInArrow(_encode_short(path, digest), f"doc_id long, n_tokens long, {kinds}")
    rows = texts.where(F.length("text") > piece).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    leaves = rows.mapInArrow(_cut_long(path, piece), "row long, doc_id string, at long, text string, starts_inside boolean, ends_inside boolean").repartition("row", "at")
    nodes = leaves.mapInArrow(_encode_leaves(path), "row long, doc_id string, at long, ids binary, head long, tail long")
    joined = nodes.groupBy("row").applyInArrow(_join_leaves(path, digest), f"doc_id string, n_tokens long, {kinds}")
    return short.unionByName(joined.withColumn("doc_id", F.col("doc_id").cast("long")))


def op12_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tree_encode(table(spark, sf_dir, "documents"), vocabulary(), digest=True)
    return found.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))
