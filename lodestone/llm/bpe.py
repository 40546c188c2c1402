"""Byte-level BPE as a monoid: a text's halves are encoded by themselves and joined by re-encoding only what their border can change.

Let E(t) be the ids of a text. E(uv) follows from u, v, E(u) and E(v) by two facts:

- Where a character that is not white space meets white space, or two of letters, digits and other signs meet (but for
  a sign before a letter, which may be a contraction such as 's), no match of the pattern crosses: such a place is a cut
  in every text. So ids before the last cut of u and behind the first cut of v stand; only the text between the two is
  matched anew. A part carries its outermost cuts along, so finding them takes no time.
- Within one match, merging takes the lowest rank first, of equal ranks the leftmost. Until a merge crosses a border the two
  sides merge as they would alone, so a row of tokens is the encoding of its bytes exactly if every two neighbours
  are the encoding of theirs. So in a very long match only tokens next to the border are merged anew, in a window that doubles
  until its first and its last token each agree with their neighbour outside.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, StructType

from lodestone.llm.common import map_arrow, table

#: The ranks in the folder of public tokenizers; any other path may be given.
RANKS = "byte_bpe_50k.tiktoken"
#: Characters that are encoded without being halved, and ids that are decoded so.
LEAF, DECODED = 1024, 4096
#: Bytes between two cuts from which a join goes by tokens; fewer are encoded anew.
LONG = 512

_CUT = r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}])(?=\p{N})"
FIRST_CUT, LAST_CUT = regex.compile(_CUT), regex.compile(rf"(?r){_CUT}")


#: What joining needs of a part of a text: its ids, and where its first and its last cut inside are, if any.
Part = tuple[list[int], int | None, int | None]


class Codec:
    """E() and its inverse for the ranks at path. The cuts hold for the pattern that goes with these ranks."""

    def __init__(self, path: str, leaf: int = LEAF, long: int = LONG) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.bytes_of[rank] = piece
        self.sizes = [len(piece) for piece in self.bytes_of]
        self.longest = max(self.sizes)
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.matches = regex.compile(public_tokenizers.PATTERN).findall
        self.leaf, self.long = max(1, leaf), long
        self.agree = lru_cache(1 << 16)(lambda a, b: self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b])
        self.reencoded = 0

    def encode(self, text: str) -> list[int]:
        return self._part(text, 0, len(text))[0]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids, of halves put together."""
        if len(ids) <= DECODED:
            return b"".join([self.bytes_of[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def merged(self, piece: bytes) -> list[int]:
        """The ids that merging alone makes of bytes; tiktoken, which looks a whole piece up first, does it where none can be so long."""
        if len(piece) > self.longest:
            return self.bpe._encode_single_piece(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            pairs = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            lowest = min(pairs)
            if lowest == 1 << 60:
                break
            at = pairs.index(lowest)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _part(self, text: str, low: int, high: int) -> Part:
        """What joining needs of text[low:high]."""
        if high - low > self.leaf:
            middle = (low + high) // 2
            return self._joined(text, low, middle, high, self._part(text, low, middle), self._part(text, middle, high))
        first = FIRST_CUT.search(text, low + 1, high)
        last = first and LAST_CUT.search(text, low + 1, high)
        return self.bpe.encode_ordinary(text[low:high]), first.start() if first else None, last.start() if last else None

    def _joined(self, text: str, low: int, middle: int, high: int, a: Part, b: Part) -> Part:
        """The part text[low:high] from those of its halves."""
        (left, first, a_last), (right, b_first, last) = a, b
        if low == middle or middle == high:
            return b if low == middle else a
        if FIRST_CUT.match(text, middle, middle + 1):
            return left + right, first or middle, last or middle
        start, end = low if a_last is None else a_last, high if b_first is None else b_first
        before, behind = len(text[start:middle].encode()), len(text[middle:end].encode())
        i = 0 if start == low else self._kept(left, before)
        j = len(right) if end == high else self._taken(right, 0, behind)
        if before + behind < self.long:
            self.reencoded += end - start
            ids = self.bpe.encode_ordinary(text[start:end])
        else:
            ids = self._between(text, start, middle, end, left[i:], right[:j])
        return left[:i] + ids + right[j:], first or b_first, last or a_last

    def _kept(self, ids: list[int], size: int) -> int:
        """How many ids stand before the last size bytes."""
        i = len(ids)
        while size > 0:
            i -= 1
            size -= self.sizes[ids[i]]
        return i

    def _taken(self, ids: list[int], i: int, size: int) -> int:
        """Where the ids end that make up size bytes from the i-th on."""
        while size > 0:
            size -= self.sizes[ids[i]]
            i += 1
        return i

    def _between(self, text: str, start: int, middle: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of text[start:end] from those of its two sides, neither of which has a cut inside.

        Matches are found anew. One that was a match on the left side keeps its ids; a long one across middle whose
        parts were the last and the first match there is joined by its tokens; any other is encoded.
        """
        ours, theirs = self.matches(text[start:middle]), self.matches(text[middle:end])
        ids: list[int] = []
        at = 0
        for n, piece in enumerate(self.matches(text[start:end])):
            stop = start + len(piece)
            if n < len(ours) and ours[n] != piece[: middle - start]:
                ours = ours[:n]
            if stop <= middle and n < len(ours):
                done = self._taken(left, at, len(piece.encode()))
                ids += left[at:done]
                at = done
            elif start < middle < stop and len(piece) >= self.long and piece.encode() not in self.ranks and n < len(ours) and theirs and len(theirs[0]) == stop - middle:
                ids += self._across(left[at:], right[: len(right) if len(theirs) == 1 else self._taken(right, 0, len(theirs[0].encode()))])
            else:
                self.reencoded += len(piece)
                ids += self.bpe._encode_single_piece(piece)
            start = stop
        return ids

    def _across(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of one match from those of its two parts."""
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = self.merged(b"".join([self.bytes_of[i] for i in left[len(left) - a :] + right[:b]]))
            self.reencoded += a + b
            left_stands = a == len(left) or self.agree(left[-a - 1], window[0])
            right_stands = b == len(right) or self.agree(window[-1], right[b])
            if left_stands and right_stands:
                return left[: len(left) - a] + window + right[b:]
            a, b = a if left_stands else 2 * a, b if right_stands else 2 * b


@lru_cache(maxsize=4)
def codec(path: str | None = None) -> Codec:
    """The codec of the ranks at path, made once for each Python worker."""
    import public_tokenizers

    return Codec(path or public_tokenizers.path(RANKS))


#: Characters, or ids, after which a task sends on what it has.
SENT = 1 << 21




@lru_cache(maxsize=4)
def codec(path: str | None = None) -> Codec:
    """The codec of the ranks at path, made once for each Python worker."""
    import public_tokenizers

    return Codec(path or public_tokenizers.path(RANKS))


#: Ids, or bytes, after which a task sends on the rows it has.
SENT = 1 << 21


def _mapped(name: str, kind: pa.DataType, turn: Callable[[pa.Scalar], object]):
    """Arrow batches whose last column turns into another; sent on by size, so that long rows don't add up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, found, size = 0, [], 0
            for row in range(batch.num_rows):
                found.append(turn(batch.columns[-1][row]))
                size += len(found[-1])
                if size >= SENT or row == batch.num_rows - 1:
                    kept = batch.slice(first, len(found)).columns[:-1]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(found, kind)], [*batch.schema.names[:-1], name])
                    first, found, size = row + 1, [], 0

    return run


def _with(df: DataFrame, name: str, kind: DataType) -> StructType:
    """df's schema with another last column."""
    kept = StructType(df.schema.fields[:-1])
    return kept.add(name, kind)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, ids) for each row of docs: the ids of its whole text by the ranks at path, as tiktoken's encode_ordinary gives them.

    Halves of a text are encoded by themselves down to LEAF characters, and joined. Null texts count as empty and have
    no ids; a text's length is bounded by memory alone, also where no white space breaks it. Special tokens are
    ordinary text. Rows that repeat give equal rows; no rows give no rows; other columns are ignored. There is no
    shuffle: a row stays in its task.
    """
    given = docs.select(id_col, text_col)
    return map_arrow(given, _mapped("ids", pa.list_(pa.int32()), lambda text: codec(path).encode(text.as_py() or "")), _with(given, "ids", ArrayType(IntegerType())))


def decode_ids(rows: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """rows with bytes in place of ids_col: what its ids stand for, put together from halves. Null ids give no bytes.

    An id that isn't in the ranks is an error. Bytes of a part of a text need not be whole characters.
    """
    given = rows.select(*(c for c in rows.columns if c != ids_col), ids_col)
    return map_arrow(given, _mapped("bytes", pa.binary(), lambda ids: codec(path).decode(ids.as_py() or [])), _with(given, "bytes", BinaryType()))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_texts(table(spark, sf_dir, "documents"))
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    decoded = decode_ids(encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), "ids"))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))
