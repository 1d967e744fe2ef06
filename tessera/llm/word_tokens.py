"""Ids of whole texts under a tokenizer of the tokenizers library, through a cache of words and of runs of words.

A vocabulary whose normalizer lowers case and whose pre-tokenizer drops white space gives a text the ids of its words, in order,
and a word that comes again costs a look-up. Texts of plain Latin letters take a short way (lower case, split, the model's own
merges for a new word). In any other text each piece between ASCII white space, which no token crosses, is looked at by
itself, and odd ones, or those with a special token, go through the library whole. A vocabulary with other rules than these (RULES) goes through the library
for every text.
"""

from __future__ import annotations

import json
import re
from array import array

from .common import HELD

#: The letters for which the short way holds, and the pre-tokenizer's pattern over these.
PLAIN = re.compile(r"[\t-\r\x20-\x7e¡«»¿À-ɏ]*")
PRE = re.compile(r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: The normalizer and pre-tokenizer for which words and ids go together, as the library writes them.
RULES = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
#: Entries of a worker's cache; a full one is emptied, which costs time and no results.
CACHED = 1_000_000
_made: dict[str, WordTokens] = {}
HELD["words"] = _made.clear


def byte_letters() -> dict[int, str]:
    """Byte-level alphabets write printable bytes as themselves, others as the letters from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokens(dict):
    """From a word, or a run of words without white space, in lower case to its ids (little-endian bytes); one per worker and file: of(path)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model
        told = json.loads(self.whole.to_str())
        marked = all("<|" in a["content"] and not (a["single_word"] or a["normalized"]) for a in told["added_tokens"])
        self.known = (told["normalizer"], told["pre_tokenizer"]) == RULES and marked and not told["post_processor"] and not told["model"].get("dropout")
        self.letters = byte_letters()

    @staticmethod
    def of(path: str) -> WordTokens:
        if path not in _made:
            _made[path] = WordTokens(path)
        return _made[path]

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        if not piece.isalpha() and len(words := PRE.findall(piece)) > 1:
            ids = b"".join(map(self.__getitem__, words))
        else:
            spelled = "".join(map(self.letters.__getitem__, piece.encode()))
            ids = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        self[piece] = ids
        return ids

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.lower().split()))

    def ids(self, raw: bytes) -> bytes:
        """Ids of a whole text, given as UTF-8, four little-endian bytes each."""
        text = raw.decode()
        if not self.known:
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if "<|" not in text and PLAIN.fullmatch(text):
            return self.plain(text)
        out = []
        for piece in raw.split():
            part = piece.decode()
            if "<|" not in part and PLAIN.fullmatch(part):
                out.append(self.plain(part))
            else:
                out.append(array("I", self.whole.encode(part, add_special_tokens=False).ids).tobytes())
        return b"".join(out)
