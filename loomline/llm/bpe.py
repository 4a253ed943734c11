"""BPE encoding and decoding by tree concatenation: texts are cut in leaves at any place, encoded apart and joined."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Characters of a leaf; a cut falls anywhere, also within words.
LEAF = 1024
#: Characters of a block of leaves that one task encodes and joins. Longer texts are dealt out in blocks.
BLOCK = 64 * LEAF
#: Nodes that one task joins at each level over the blocks.
FAN = 32
#: Characters on each side of a join that the first window holds, and those at its ends from which nothing is taken over:
#: what a token's pretokenizer looks at past its end is shorter.
WINDOW, MARGIN = 64, 16
#: Python's str.split() also parts at these, the pre-tokenizer doesn't.
_ODD = re.compile("[\x1c-\x1f]")
_SAFE = re.compile("[ \t\n\r]+")
_NONE = np.empty(0, np.int32)
_coders: dict[str, Coder] = {}


def _opens(c: str) -> bool:
    """Whether no normalisation joins a character to the one before."""
    return unicodedata.category(c)[0] != "M" and not "ᅠ" <= c <= "ᇿ"


@dataclass
class Run:
    """Text without white space at one end of a node: the text, and its tokens as an encoding of its own with their
    starts and ends in it. A run that one window holds has no tokens yet: it is encoded when it is whole."""

    text: str = ""
    ids: np.ndarray | None = None
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None


@dataclass
class Node:
    """A stretch of text: the run up to its first white space, the ids of what stands between, and the run after the
    last. Without white space it is one run, and the rest is empty (ids None)."""

    head: Run
    ids: np.ndarray | None = None
    tail: Run | None = None


class Coder:
    """One tokenizer file in one process: words through a bounded two-generation cache, texts as trees.

    White space never survives the pre-tokenizer, so the tokens of a text are those of its words in turn.
    """

    FULL = 150_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path = path
        self.tk = Tokenizer.from_file(path)
        self.tk.no_truncation()
        self.tk.no_padding()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def word(self, w: str) -> bytes:
        """The ids of a word as little-endian int32."""
        if (ids := self.old.get(w)) is None:
            ids = np.asarray(self.tk.encode(w, add_special_tokens=False).ids, "<i4").tobytes()
        if len(w) <= WINDOW:
            if len(self.young) >= self.FULL:
                self.old, self.young = self.young, {}
            self.young[w] = ids
        return ids

    def split(self, text: str) -> list[str]:
        return _SAFE.split(text) if _ODD.search(text) else text.split()

    def words(self, text: str) -> bytes:
        get, word = self.young.get, self.word
        return b"".join([get(w) or word(w) for w in self.split(text)])

    # The tree

    def run(self, text: str) -> Run:
        return self._coded(text) if len(text) > WINDOW else Run(text)

    def _coded(self, text: str) -> Run:
        e = self.tk.encode(text, add_special_tokens=False)
        at = np.array(e.offsets, np.int64).reshape(-1, 2)
        return Run(text, np.array(e.ids, np.int32), at[:, 0], at[:, 1])

    def leaf(self, text: str) -> Node:
        first = _SAFE.search(text)
        if first is None:
            return Node(self.run(text))
        last = max(map(text.rfind, " \t\n\r")) + 1
        return Node(self.run(text[: first.start()]), np.frombuffer(self.words(text[first.end() : last]), "<i4"), self.run(text[last:]))

    def final(self, r: Run) -> np.ndarray:
        return np.frombuffer(self.word(r.text), "<i4") if r.ids is None else r.ids

    def glue(self, a: Run, b: Run) -> Run:
        """The run of both texts, from the tokens of each.

        A window over the join is encoded. It agrees with the left side if it begins with the left's own token there,
        and with the right if somewhere past the join it has a token that is the right's too: BPE's tokens follow each
        other as their neighbours allow, and the pre-tokenizer goes on alike from a place where it stood alike. Until
        then the window grows; one that holds both sides whole agrees with them.
        """
        if not a.text or not b.text:
            return a if a.text else b
        n, m, x = len(a.text), len(b.text), WINDOW
        if a.ids is None and b.ids is None and n + m <= WINDOW:
            return Run(a.text + b.text)
        a, b = (self._coded(r.text) if r.ids is None else r for r in (a, b))
        while x < max(n, m):
            # The window starts with a token of the left, at least x characters before the join.
            i = int(np.searchsorted(a.starts, n - x, "right")) - 1
            while i > 0 and not (a.starts[i] >= a.ends[i - 1] and _opens(a.text[a.starts[i]])):
                i -= 1
            i = max(i, 0)
            p = int(a.starts[i]) if i else 0
            w = self._coded(a.text[p:] + b.text[:x])
            cut = n - p
            left = not i or len(w.ids) and w.ids[0] == a.ids[i] and w.starts[0] == 0 and w.ends[0] == a.ends[i] - p <= cut - MARGIN
            if left and x >= m:
                return Run(a.text + b.text, np.concatenate([a.ids[:i], w.ids]), np.concatenate([a.starts[:i], w.starts + p]), np.concatenate([a.ends[:i], w.ends + p]))
            if left:
                # The last token past the join that both have at one place, which is the start of a character.
                own = {int(b.starts[j]): j for j in range(int(np.searchsorted(b.starts, x))) if self._whole(b, j)}
                for k in range(len(w.ids) - 1, -1, -1):
                    at = int(w.starts[k]) - cut
                    if at < MARGIN:
                        break
                    j = own.get(at)
                    if j is None or w.ids[k] != b.ids[j] or w.ends[k] > len(w.text) - MARGIN or not self._whole(w, k) or not _opens(b.text[at]):
                        continue
                    put = lambda l, c, r, up, on, k=k, j=j: np.concatenate([l[:i], c[: k + 1] + up, r[j + 1 :] + on])
                    return Run(a.text + b.text, put(a.ids, w.ids, b.ids, 0, 0), put(a.starts, w.starts, b.starts, p, n), put(a.ends, w.ends, b.ends, p, n))
            x *= 2
        return self._coded(a.text + b.text)

    @staticmethod
    def _whole(r: Run, k: int) -> bool:
        """Whether token k starts where a character does."""
        return not k or r.starts[k] >= r.ends[k - 1]

    def join(self, a: Node, b: Node) -> Node:
        if a.ids is None:
            head = self.glue(a.head, b.head)
            return Node(head, b.ids, b.tail)
        if b.ids is None:
            return Node(a.head, a.ids, self.glue(a.tail, b.head))
        return Node(a.head, np.concatenate([a.ids, self.final(self.glue(a.tail, b.head)), b.ids]), b.tail)

    def tree(self, nodes: list[Node]) -> Node:
        """Joins neighbours pair by pair, level by level."""
        while len(nodes) > 1:
            nodes = [self.join(*nodes[i : i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        return nodes[0]

    def block(self, text: str) -> Node:
        return self.tree([self.leaf(text[i : i + LEAF]) for i in range(0, len(text), LEAF)] or [Node(Run())])

    def root(self, n: Node) -> np.ndarray:
        """The ids of a node that is a whole text."""
        return np.concatenate([self.final(r) if isinstance(r, Run) else r for r in (n.head, n.ids, n.tail) if r is not None])

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.words(text), "<i4") if len(text) <= LEAF else self.root(self.block(text))

    def decode(self, ids: list[int]) -> str:
        return self.tk.decode(ids, skip_special_tokens=False)


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def _lists(arrays: list[np.ndarray | None]) -> pa.Array:
    flat = [_NONE if x is None else x for x in arrays]
    ends = np.cumsum([0, *map(len, flat)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat or [_NONE]).astype(np.int32), pa.int32()))


def _encode_texts(path: str, with_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in slices(batches):
            ids = [c.encode(t or "") for t in b.column(1).to_pylist()]
            decoded = [c.decode(x.tolist()) if with_text else None for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(ids), pa.array(decoded, pa.string())], names=["id", "ids", "decoded"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of texts: id, uid (one for each row), node, text."""
    task, row = TaskContext.get().partitionId(), 0
    for b in slices(batches):
        for i, t in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            row += 1
            for k, at in enumerate(range(0, len(t), BLOCK)):
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], b.schema.field(0).type), pa.array([f"{task}-{row}"]), pa.array([k], pa.int32()), pa.array([t[at : at + BLOCK]])], names=["id", "uid", "node", "text"])


_RUN = "struct<text:string,ids:array<int>,starts:array<long>,ends:array<long>>"
_NODE = f"uid string, node int, head {_RUN}, ids array<int>, tail {_RUN}"


def _row(r: Run | None) -> dict | None:
    return None if r is None else {"text": r.text, "ids": r.ids, "starts": r.starts, "ends": r.ends}


def _run(d: dict | None) -> Run | None:
    return None if d is None else Run(d["text"], *(None if d[k] is None else np.asarray(d[k]) for k in ("ids", "starts", "ends")))


def _blocks(path: str, kind: str) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(path)
        for f in frames:
            for i, uid, node, text in zip(f.id, f.uid, f.node, f.text, strict=True):
                n = c.block(text)
                yield pd.DataFrame({"id": [i], "uid": [uid], "node": [node], "head": [_row(n.head)], "ids": [n.ids], "tail": [_row(n.tail)]})

    return run


def _level(path: str, whole: bool, with_text: bool) -> Callable:
    def run(f: pd.DataFrame) -> pd.DataFrame:
        c, f = coder(path), f.sort_values("node")
        nodes = [Node(_run(h), None if x is None else np.asarray(x, np.int32), _run(t)) for h, x, t in zip(f["head"], f.ids, f["tail"], strict=True)]
        n, first = c.tree(nodes), f.iloc[0]
        if not whole:
            return pd.DataFrame({"id": [first.id], "uid": [first.uid], "node": [first.node // FAN], "head": [_row(n.head)], "ids": [n.ids], "tail": [_row(n.tail)]})
        ids = c.root(n)
        return pd.DataFrame({"id": [first.id], "ids": [ids], "decoded": [c.decode(ids.tolist()) if with_text else None]})

    return run


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """Returns id_col, ids array<int>, decoded string (null unless asked for) for every row of docs.

    ids are the tokenizers library's encode(text, add_special_tokens=False).ids; decoded is its
    decode(ids, skip_special_tokens=False). tokenizer: path of a tokenizer file whose pre-tokenizer drops white
    space, on every executor.

    A text of over LEAF characters is cut in leaves at any place; these are encoded apart and joined in pairs, level
    by level, see Coder.glue. Texts of up to BLOCK characters do so where they are read. Longer ones are cut in
    blocks, which are dealt over the cluster, and joined over tasks, FAN neighbours at each level; only the last joins
    the row. What is handed up are ids, and the words (or unsplit runs) at both ends of a node.

    Null and empty texts give no ids and an empty decoded text. Repeated rows and ids, also null ids, each give a
    row of their own. Other columns are left out, whatever their names. The order of rows is not kept. Blocks of one
    row are told by its place in its task, so docs must give the same rows when a task is repeated, as files do.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    is_long = F.coalesce(F.length("text") > BLOCK, F.lit(False))
    done = src.where(~is_long).mapInArrow(_encode_texts(tokenizer, decoded), f"id {kind}, ids array<int>, decoded string")
    cut = src.where(is_long).mapInArrow(_cut, f"id {kind}, uid string, node int, text string")
    nodes = cut.repartition("uid", "node").mapInPandas(_blocks(tokenizer, kind), f"id {kind}, {_NODE}")
    # Two levels leave a text of the greatest length that a row can have a few dozen nodes.
    for _ in range(2):
        nodes = nodes.groupBy("uid", F.floor(F.col("node") / FAN)).applyInPandas(_level(tokenizer, False, decoded), f"id {kind}, {_NODE}")
    whole = nodes.groupBy("uid").applyInPandas(_level(tokenizer, True, decoded), f"id {kind}, ids array<int>, decoded string")
    return done.unionByName(whole).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Returns id_col, decoded: decode(ids, skip_special_tokens=False) of every row; null ids give an empty text."""
    src = rows.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["id", "decoded"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, decoded string").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_tokens and the SHA-256 of ids and decoded text of encode()'s rows."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
