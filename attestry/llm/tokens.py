"""Byte-level BPE ids of whole texts, from a vocabulary in the ``tokenizers`` file format.

Where ids follow the order of the merges, byte-pair encoding by rank gives the same ids several times
faster than the general tokenizer; the file's vocabulary is then run that way. Other files, texts that hold
an added token's string and texts with a very long run of white space run on ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import re

import tiktoken
from tokenizers import Tokenizer

#: Fixed value: the split into word pieces that the byte-level vocabulary is defined on.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Runs of white space from this length on are left to the general tokenizer: the faster one matches them with a stack.
LONG_RUN = 1 << 16


def _long_run(text: str) -> bool:
    """Whether a run of white space is too long for the faster tokenizer."""
    return len(text) >= LONG_RUN and any(m.end() - m.start() >= LONG_RUN for m in re.finditer(r"\s+", text))


def _visible() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Visible Latin-1 characters stand for themselves, the other bytes for characters from 256 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Encodes texts. Strings of added tokens in a text are ordinary text, or with ``added`` those tokens."""

    def __init__(self, spec: str, added: bool = False) -> None:
        self.spec, self.added, self.general = spec, added, None
        told = json.loads(spec)
        vocabulary, merges = told["model"]["vocab"], told["model"]["merges"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in merges)
        plain = told["model"]["type"] == "BPE" and told["normalizer"] is None and told["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if plain and all(vocabulary.get(a + b) == 256 + k for k, (a, b) in enumerate(pairs)):
            byte = _visible()
            special = {t["content"] for t in told["added_tokens"]}
            ranks = {bytes(byte[c] for c in token): k for token, k in vocabulary.items() if token not in special}
            fast = tiktoken.Encoding("bytes", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.ids = lambda text: self.general_ids(text) if added and any(t in text for t in special) or _long_run(text) else fast(text)
        else:
            self.ids = self.general_ids

    def entries(self) -> list[bytes]:
        """The bytes of each id; those of an added token are its string's, those of an id without a token are none."""
        told, byte = json.loads(self.spec), _visible()
        out = {k: bytes(byte[c] for c in token) if set(token) <= byte.keys() else token.encode() for token, k in told["model"]["vocab"].items()}
        out |= {t["id"]: t["content"].encode() for t in told["added_tokens"]}
        return [out.get(k, b"") for k in range(max(out) + 1)]

    def general_ids(self, text: str) -> list[int]:
        """The ids by ``tokenizers`` itself."""
        if self.general is None:
            self.general = Tokenizer.from_str(self.spec)
            self.general.encode_special_tokens = not self.added
        return self.general.encode(text, add_special_tokens=False).ids
