"""The byte-level BPE that packing and token counts use.

The vocabulary file's ranks are run by tiktoken; ids equal those of the tokenizers library with the same vocabulary
as byte_bpe_50k.json (tests hold one against the other), at several times the speed. That library finds a vocabulary's
added tokens in a text before anything else, so they are cut out first here too.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache
from pathlib import Path

#: The ranks in the folder of public tokenizers; any other path may be given.
RANKS = "byte_bpe_50k.tiktoken"

#: White space of such length is encoded pre-token by pre-token: tiktoken's own search takes stack for every character of it.
LONG_SPACE = re.compile(r"\s{5000}")


class Encoder:
    """Pre-tokens and ids of texts, by the ranks at path, their added tokens (content to id) and a pattern."""

    def __init__(self, path: str, added: dict[str, int], pattern: str) -> None:
        import regex
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.added = added
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.find = regex.compile(pattern).findall
        #: A pre-token depends on the text from its start to so many characters past its end.
        self.reach = max(1, *map(len, added)) if added else 1

    def _pieces(self, text: str) -> list[str]:
        """text cut at its added tokens; every second piece is one."""
        return self.apart.split(text) if self.apart and any(a in text for a in self.added) else [text]

    def parts(self, text: str) -> list[str]:
        """The pre-tokens that make up text; an added token is one."""
        found: list[str] = []
        for k, piece in enumerate(self._pieces(text)):
            found += [piece] if k % 2 else self.find(piece)
        return found

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for k, piece in enumerate(self._pieces(text)):
            if k % 2:
                ids.append(self.added[piece])
            elif LONG_SPACE.search(piece):
                for part in self.find(piece):
                    ids += self.bpe._encode_single_piece(part)
            else:
                ids += self.bpe.encode_ordinary(piece)
        return ids


def added_tokens(path: str) -> dict[str, int]:
    """Added tokens of the vocabulary whose tokenizers file stands beside path, by content; none without that file."""
    beside = Path(path).with_suffix(".json")
    listed = json.loads(beside.read_text())["added_tokens"] if beside.exists() else []
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in listed):
        raise ValueError(f"{beside} has added tokens that match by what stands around them")
    return {t["content"]: t["id"] for t in listed}


@lru_cache(maxsize=4)
def encoder(path: str | None = None, pattern: str | None = None) -> Encoder:
    """The encoder of the ranks at path, made once for each Python worker."""
    import public_tokenizers

    path = path or public_tokenizers.path(RANKS)
    return Encoder(path, added_tokens(path), pattern or public_tokenizers.PATTERN)
