"""Token ids of whole texts by the tokenizers library, with a cache of the pieces that its pre-tokenizer splits at white space.

Two kinds of files have splits that no merge and no normalisation crosses, so
that a text's ids are those of its pieces, one after the other: byte-level BPE
without a normalizer, and BPE whose splitting pattern drops white space. Texts
with other white space or with a special string, and any other file, are
encoded whole. A piece that the cache lacks is split again where the file's own
pattern splits it, if all its characters are such that the split is plain.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

#: Entries of the piece cache of one Python worker; memory, not results, depends on it.
CACHE_ENTRIES = 600_000
_LONGEST = 48
_MARKS = (1 << 23) - 15
_OTHER_SPACE = re.compile(r"[^\S \n]")
_BYTE_PIECES = re.compile(r" ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]+").findall
#: Letters of the plain alphabet besides A-Z: Latin-1 and Latin Extended-A, but for the one whose lower case is two characters.
_MORE = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_NOT_PLAIN = re.compile(f"[^ -~{_MORE}]").search
_WORD_PARTS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[a-z{_MORE}]+|[0-9]|[^ a-z0-9{_MORE}]+").findall
_BYTE_PARTS = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z{_MORE}]+| ?[0-9]+| ?[^ A-Za-z0-9{_MORE}]+| +").findall
#: The alphabet of byte-level BPE: printable bytes are themselves, the others follow 255 in their order.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
_BYTE_LEVEL = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_ENCODERS: dict[str, "Encoder"] = {}


class _Seen(dict):
    """A cache of what is asked for more than once: a first request leaves a mark only."""

    def __init__(self, encode):
        self.encode, self.marks = encode, bytearray(_MARKS)

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        mark = hash(piece) % _MARKS
        if self.marks[mark]:
            if len(self) < CACHE_ENTRIES and len(piece) <= _LONGEST:
                self[piece] = ids
        else:
            self.marks[mark] = 1
        return ids


def id_type(path: str) -> np.dtype:
    """How a file's ids are stored. The driver asks this and loads no tokenizer."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    last = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])], default=0)
    return np.dtype("<u2" if last < 1 << 16 else "<u4")


class Encoder:
    """``encode(text)``: the ids as little-endian bytes of ``dtype``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocabulary = self.library.get_vocab_size()
        self.dtype = id_type(path)
        self.code = "HI"[self.dtype.itemsize == 4]
        self.special = [t["content"] for t in spec["added_tokens"]]
        pre, normal = spec["pre_tokenizer"] or {}, spec["normalizer"]
        steps = pre.get("pretokenizers", [])
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not normal:
            self.split, self.parts, self.lower = _BYTE_PIECES, _BYTE_PARTS, False
        elif steps and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and r"[^\s\p{L}\p{N}]+" in steps[0]["pattern"].get("Regex", "") and [n["type"] for n in (normal or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            self.split, self.parts, self.lower = lambda text: text.replace("\n", " ").split(" "), _WORD_PARTS, True
        else:
            self.split = None
        self.model = self.library.model
        self.bytes = {c: "".join(_BYTE_LEVEL[b] for b in chr(c).encode()) for c in range(32, 384) if not 127 <= c < 192}
        self.units = _Seen(self.unit)
        self.pieces = _Seen(self.piece)

    def unit(self, part: str) -> bytes:
        """The ids of what the file's pattern keeps together, in the plain alphabet."""
        if not part.isascii() or " " in part:
            part = part.translate(self.bytes)
        return array(self.code, [t.id for t in self.model.tokenize(part)]).tobytes()

    def piece(self, piece: str) -> bytes:
        """The ids of what lies between white space."""
        if not piece.isascii() and _NOT_PLAIN(piece):
            return self.whole(piece)
        text = piece.lower() if self.lower else piece
        body = text[1:] if text[:1] == " " else text
        if body.isalpha():
            return self.units[text]
        if body[-1:] in (".", ",") and body[:-1].isalpha():
            return self.units[text[:-1]] + self.units[body[-1]]
        if _NOT_PLAIN(text):
            return self.whole(piece)
        return b"".join(map(self.units.__getitem__, self.parts(text)))

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        if self.split is None or _OTHER_SPACE.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.pieces.__getitem__, self.split(text)))


def encoder(path: str) -> Encoder:
    """One for each worker process and path."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary_path(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
