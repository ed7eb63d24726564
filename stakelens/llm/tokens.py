"""Token ids of whole texts under a byte-level BPE tokenizer file.

The ids are those that the file's own tokenizer gives. Tokens never span the place before a
single space that separates two words, so texts are cut there and the ids of short words
are kept in a bounded cache; a text in which white space runs meet such a place is encoded
whole.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from functools import lru_cache

CACHED_WORDS = 200_000  # some 200 bytes each, in every worker
CACHED_LENGTH = 48
# The pattern of byte-level pre-tokenizers.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
_RUN = re.compile(r"\s (?:\s|$)")


class Encoder(dict):
    """Maps a word that follows a space to the bytes of its 32-bit little-endian ids.

    The first `CACHED_WORDS` short words that it meets stay, which are the frequent ones.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are laid out for little-endian machines")
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(special) or r"(?!)")
        self.fast = _ranked(spec)

    def __missing__(self, word: str) -> bytes:
        found = self._ids(" " + word)
        if len(word) <= CACHED_LENGTH and len(self) < CACHED_WORDS:
            self[word] = found
        return found

    def _ids(self, text: str) -> bytes:
        if self.fast is None or self.special.search(text):
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return array("I", ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, four bytes each; none for null."""
        if not text:
            return b""
        if _RUN.search(text):
            return self._ids(text)
        first, *rest = text.split(" ")
        return b"".join([self._ids(first), *map(self.__getitem__, rest)])


def _ranked(spec: dict):
    """The same vocabulary for tiktoken, if its ids are in merge order; else None."""
    import tiktoken

    model, cutter = spec["model"], spec["pre_tokenizer"] or {}
    plain = spec["normalizer"] is None and cutter.get("type") == "ByteLevel"
    if not plain or model["type"] != "BPE" or cutter.get("add_prefix_space"):
        return None
    special = {t["content"] for t in spec["added_tokens"]}
    byte_of = letters_to_bytes()
    ranks = {
        bytes(byte_of[c] for c in token): i
        for token, i in model["vocab"].items()
        if token not in special
    }
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if any(model["vocab"].get(token) != 256 + k for k, token in enumerate(merged)):
        return None
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def letters_to_bytes() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
