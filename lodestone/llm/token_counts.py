"""Token counts that follow edits: a balanced segment tree over each document's pre-tokens."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import map_arrow, table
from lodestone.llm.encoding import encoder

#: Pre-tokens that a leaf holds.
LEAF = 32


#: A subtree: height, leaves, characters, tokens, left and right subtree; a leaf has its text and the ends of its pre-tokens there.
Tree = tuple


def _leaf(text: str, ends: list[int], tokens: int) -> Tree:
    return (0, 1, len(text), tokens, text, ends)


def _node(a: Tree, b: Tree) -> Tree:
    return (1 + max(a[0], b[0]), a[1] + b[1], a[2] + b[2], a[3] + b[3], a, b)


def _built(leaves: list[Tree]) -> Tree | None:
    if len(leaves) < 2:
        return leaves[0] if leaves else None
    half = len(leaves) // 2
    return _node(_built(leaves[:half]), _built(leaves[half:]))


def _join(a: Tree | None, b: Tree | None) -> Tree | None:
    """A balanced tree of a's leaves, then b's. Only sums along one path are computed anew."""
    if a is None or b is None:
        return a or b
    if a[0] > b[0] + 1:
        left, right = a[4], _join(a[5], b)
        if right[0] <= left[0] + 1:
            return _node(left, right)
        inner, outer = right[4], right[5]
        return _node(_node(left, inner[4]), _node(inner[5], outer)) if inner[0] > outer[0] else _node(_node(left, inner), outer)
    if b[0] > a[0] + 1:
        left, right = _join(a, b[4]), b[5]
        if left[0] <= right[0] + 1:
            return _node(left, right)
        outer, inner = left[4], left[5]
        return _node(_node(outer, inner[4]), _node(inner[5], right)) if inner[0] > outer[0] else _node(outer, _node(inner, right))
    return _node(a, b)


def _split(t: Tree | None, n: int) -> tuple[Tree | None, Tree | None]:
    """Balanced trees of the first n leaves and of the others."""
    if t is None or n <= 0:
        return None, t
    if n >= t[1]:
        return t, None
    left, right = t[4], t[5]
    if n <= left[1]:
        a, b = _split(left, n)
        return a, _join(b, right)
    a, b = _split(right, n - left[1])
    return _join(left, a), b


def _leaves(t: Tree | None, start: int = 0) -> Iterator[Tree]:
    """Leaves from the start-th on."""
    if t is not None and start < t[1]:
        if not t[0]:
            yield t
        else:
            yield from _leaves(t[4], start)
            yield from _leaves(t[5], max(0, start - t[4][1]))


class TokenTree:
    """Characters and tokens of a text, summed over a balanced tree whose leaves are runs of whole pre-tokens.

    A pre-token depends on the text from its start to encoder.reach characters past its end. So after an edit the
    pre-tokens that end that far before the edit's start stand, scanning begins anew at the next one, and as soon as a
    new boundary behind the edit falls on the old end of a leaf, all that follows stands too. Only leaves between are
    encoded again. They are cut out of the tree and others joined in, which takes steps and new sums in proportion to
    its height, however many leaves come or go. reencoded counts characters encoded since the tree was built.
    """

    def __init__(self, text: str, path: str | None = None, leaf: int = LEAF) -> None:
        self.encoder, self.size, self.reencoded = encoder(path), leaf, 0
        self.root = _built(self._cut(text, self.encoder.parts(text)))

    def _cut(self, text: str, parts: list[str]) -> list[Tree]:
        """Leaves of parts, which make up text.

        A leaf doesn't end with white space inside a text: white space at an end is cut otherwise.
        """
        ends = list(accumulate(map(len, parts)))
        out, start, k = [], 0, 0
        while k < len(ends):
            end = k + self.size
            while end < len(ends) and parts[end - 1].isspace():
                end += 1
            some = ends[k:end]
            piece = text[start : some[-1]]
            out.append(_leaf(piece, [e - start for e in some], len(self.encoder.encode(piece))))
            start, k = some[-1], end
        return out

    def _find(self, position: int) -> tuple[int, int, Tree]:
        """The number, start and leaf that hold a position; the last one for the text's end."""
        at, start, t = 0, 0, self.root
        while t[0]:
            if position - start >= t[4][2]:
                at, start, t = at + t[4][1], start + t[4][2], t[5]
            else:
                t = t[4]
        return at, start, t

    @property
    def n_tokens(self) -> int:
        return self.root[3] if self.root else 0

    @property
    def n_chars(self) -> int:
        return self.root[2] if self.root else 0

    @property
    def text(self) -> str:
        return "".join(t[4] for t in _leaves(self.root))

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces characters start to end (exclusive, both clipped to the text) by new."""
        start = min(max(start, 0), self.n_chars)
        end = min(max(end, start), self.n_chars)
        if self.root is None:
            self.root = _built(self._cut(new, self.encoder.parts(new)))
            self.reencoded += len(new)
            return
        first, at, leaf = self._find(max(start - 1, 0))
        while first and start - at <= max(leaf[5][0], self.encoder.reach):  # the pre-token before may reach the edit
            first, at, leaf = self._find(at - 1)
        want = self._find(end)[0] + 1 - first
        shift = len(new) - (end - start)
        while True:  # twice as many leaves, until the boundaries meet at the end of one
            rest = _leaves(self.root, first)
            old = list(islice(rest, want))
            last = first + len(old) == self.root[1]
            text = "".join(t[4] for t in old)
            text = text[: start - at] + new + text[end - at :]
            parts = self._scanned(text, rest)
            bounds = list(accumulate(map(len, parts), initial=0))
            met = set(bounds)
            stops = accumulate(t[2] for t in old)
            found = next(((n, e + shift) for n, e in enumerate(stops, 1) if (e > end - at and e + shift in met) or (last and n == len(old))), None)
            if found:
                break
            want *= 2
        used, stop = found
        fresh = self._cut(text[:stop], parts[: bounds.index(stop)])
        self.reencoded += stop
        before, behind = _split(self.root, first)
        self.root = _join(_join(before, _built(fresh)), _split(behind, used)[1])

    def _scanned(self, text: str, rest: Iterator[Tree]) -> list[str]:
        """Pre-tokens of text as they are when the leaves of rest follow; the last may pass text's end."""
        after = ""
        while len(after) < self.encoder.reach and (leaf := next(rest, None)):
            after += leaf[4]
        parts, n = [], 0
        for part in self.encoder.parts(text + after):
            if n >= len(text):
                break
            parts.append(part)
            n += len(part)
        return parts


COUNTS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), ("edited_chars", pa.int64()), ("edited_tokens", pa.int64()), ("reencoded_chars", pa.int64())])


def edited_counts(docs: DataFrame, edits: str = "edits", path: str | None = None) -> DataFrame:
    """Tokens of each row's text, and after its edits: doc_id, n_chars, n_tokens, edited_chars, edited_tokens, reencoded_chars.

    edits names a column array<struct<start int, end int, new string>>, applied in order, each to the text that the
    ones before have left; positions are code points. Each document is handled by itself where it is read: nothing
    is shuffled, and a tree lives as long as its document is at hand. Null texts are empty, null arrays or edits
    are none, null replacements are empty; rows that repeat a document are counted as often; no rows give no rows;
    other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, todo in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                tree = TokenTree(text.as_py() or "", path)
                n_chars, n_tokens = tree.n_chars, tree.n_tokens
                for e in filter(None, todo or ()):
                    tree.edit(e["start"] or 0, e["end"] or 0, e["new"] or "")
                rows.append((doc_id, n_chars, n_tokens, tree.n_chars, tree.n_tokens, tree.reencoded))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), COUNTS.types, strict=True)], schema=COUNTS)

    kinds = "doc_id long, n_chars long, n_tokens long, edited_chars long, edited_tokens long, reencoded_chars long"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text"), F.col(edits)), run, kinds)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document counted, then edited three times: a cut at a quarter, words put in at the middle, a new end."""
    docs = table(spark, sf_dir, "documents")
    n = F.length(F.coalesce("text", F.lit("")))

    def change(start, end, new: str):
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(new).alias("new"))

    edits = F.array(change(F.floor(n / 4), F.floor(n / 4) + 20, ""), change(F.floor(n / 2), F.floor(n / 2), " 2 words, put in "), change(F.greatest(n - 10, F.lit(0)), n + 100, "\nThe end."))
    return edited_counts(docs.select("doc_id", "text", edits.alias("edits")))
