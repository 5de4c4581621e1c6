"""Exact token ids of a byte-level BPE vocabulary file of the ``tokenizers`` library.

The merges are read from the file and run by ``tiktoken``, which gives the same ids about four times
as fast. Left to ``tokenizers`` itself are texts that hold a special token's string or a very long run of white space, on
which the other's regex runs out of stack, and all texts where the file asks for more than this split pattern.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

# The split pattern of the byte-level BPE vocabulary.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Settings of a file whose texts are split by that pattern and by nothing else.
SPLIT_SETTINGS = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: White space in a row from which on ``tokenizers`` takes over; the other encoder fails at about a million.
LONG_BLANKS = 50_000
_BLANKS = re.compile(r"\s{%d}" % LONG_BLANKS)


def _is_plain(content: dict) -> bool:
    """Whether ids follow from the split pattern and the merges alone."""
    split, model = content.get("pre_tokenizer") or {}, content["model"]
    odd = [content.get("normalizer"), *[model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]]
    return all(split.get(k) == v for k, v in SPLIT_SETTINGS.items()) and model.get("type") == "BPE" and not any(odd)


def _byte_alphabet() -> dict[str, int]:
    """Characters of the vocabulary file to bytes: printable ones are themselves, the rest follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Texts to ids, equal to ``tokenizers`` without added special tokens."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self._special = [t["content"] for t in content.get("added_tokens", [])]
        self._tokenizer = Tokenizer.from_file(path)
        self._merges = None
        if _is_plain(content):
            alphabet = _byte_alphabet()
            ranks = {
                bytes(alphabet[c] for c in token): rank
                for token, rank in content["model"]["vocab"].items()
                if token not in self._special
            }
            self._merges = tiktoken.Encoding("file", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> array:
        """The ids of a text, as unsigned 32-bit numbers."""
        if self._merges is None or any(s in text for s in self._special) or (len(text) >= LONG_BLANKS and _BLANKS.search(text)):
            return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids)
        return array("I", self._merges.encode_ordinary(text))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    return Encoder(path)
