"""Bytes of unknown encoding as text, and the entities of markup.

Without a mark or a declaration the bytes themselves tell: zeros on one side are wide characters, and of the encodings that
read a text without an error that is taken whose characters are the likeliest, by how common the ranges are that they fall in.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Byte order marks, the longest first.
MARKS = ((b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\xef\xbb\xbf", "utf-8"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le"))
# Encodings that are tried by statistics, the first of equals.
GUESSES = ("gb18030", "big5", "shift_jis", "euc-jp", "euc-kr", "windows-1251", "koi8-r", "windows-1252")
#: Those in which the bytes 128 to 159 may stand for typographic quotes, whatever they declare.
QUOTED = frozenset(["windows-1252", "cp1252", "iso-8859-1", "latin-1", "latin1", "iso-8859-2"])
DECLARED = re.compile(rb"""\A\s*<\?xml[^>]*encoding=["']([\w.-]+)|<meta[^>]+charset=["']?([\w.-]+)""", re.I)
#: Bytes by which a guess is made; the whole is decoded.
SAMPLE = 1 << 16


def _likely(text: str, encoding: str) -> float:
    """How likely the characters beyond ASCII are, 0 to 1 on average, in texts that this encoding is made for."""
    total, n = 0.0, 0
    for k, c in enumerate(text):
        code = ord(c)
        if code < 128:
            continue
        n += 1
        if encoding in ("gb18030", "big5"):
            # Both list common characters first: lead bytes to D7 and to C6.
            lead = c.encode(encoding)[0]
            total += 1.0 if 0x4E00 <= code <= 0x9FFF and lead <= (0xD7 if encoding == "gb18030" else 0xC6) and lead >= (0xB0 if encoding == "gb18030" else 0xA4) else 0.8 if 0x3000 <= code <= 0x303F or 0xFF00 <= code <= 0xFF5E else 0.1
        elif encoding in ("shift_jis", "euc-jp"):
            total += 1.2 if 0x3040 <= code <= 0x30FF else 0.7 if 0x4E00 <= code <= 0x9FFF or 0x3000 <= code <= 0x303F else 0.1
        elif encoding == "euc-kr":
            total += 1.1 if 0xAC00 <= code <= 0xD7A3 else 0.3 if 0x3000 <= code <= 0x303F else 0.05
        elif encoding in ("windows-1251", "koi8-r"):
            # A capital after a small letter is what the other of the two makes of plain text.
            total += 0.9 if 0x430 <= code <= 0x44F else 0.6 if 0x410 <= code <= 0x42F and not (k and 0x430 <= ord(text[k - 1]) <= 0x44F) else 0.05
        else:
            before, after = text[k - 1 : k], text[k + 1 : k + 2]
            letter = c.isalpha() and code < 0x250
            near = before.isascii() and after.isascii() and (before.isalpha() or after.isalpha())
            total += 0.85 if letter and near else 0.8 if c in "‘’“”–—…€ £©°«»" else 0.1
    return total / n if n else 0.0


def guess(data: bytes) -> str | None:
    """The encoding of bytes without a mark."""
    sample = data[:SAMPLE]
    zeros = [sample[k::2].count(0) for k in (0, 1)]
    if len(sample) >= 2 and len(data) % 2 == 0 and sum(zeros) * 4 >= len(sample):
        return "utf-16-be" if zeros[0] > zeros[1] else "utf-16-le"
    for name in ("ascii", "utf-8"):
        try:
            data.decode(name)
            return name
        except UnicodeDecodeError:
            pass
    best = (0.0, None)
    for name in GUESSES:
        try:
            data.decode(name)
        except UnicodeDecodeError:
            continue
        # A sample may end within a character.
        likely = _likely(sample.decode(name, "ignore"), name)
        if likely > best[0] + 1e-9:
            best = (likely, name)
    return best[1]


def quotes(text: str) -> str:
    """What Windows puts in the places 128 to 159, where a page says that it is Latin."""
    return re.sub("[\x80-\x9f]", lambda m: m.group().encode("latin-1").decode("windows-1252", "replace"), text)


def decode(data: bytes | None, declared: str | None = None) -> str | None:
    """By a mark, what is declared, what the markup declares, the likeliest encoding, then UTF-8 without what is wrong."""
    if data is None:
        return None
    for mark, name in MARKS:
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    found = DECLARED.search(data)
    named = next((g.decode() for g in found.groups() if g), None) if found else None
    for name in (declared, named):
        try:
            if name:
                text = data.decode(name)
                return quotes(text) if name.lower() in QUOTED else text
        except (LookupError, UnicodeDecodeError):
            continue
    name = guess(data)
    return data.decode(name) if name else data.decode("utf-8", "ignore")


@F.arrow_udf(T.StringType())
def decode_markup(data: pa.Array) -> pa.Array:
    """Bytes of unknown encoding as text."""
    return pa.array([decode(x) for x in data.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def detected_charset(data: pa.Array) -> pa.Array:
    """The encoding that bytes without a mark or a declaration are taken for; null where none fits."""
    return pa.array([None if x is None else guess(x) for x in data.to_pylist()], pa.string())


#: Modes of entities: all names of HTML, or the five of XML, and numbers in both; a character that XML names may stay as it is.
_XML = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_ENTITY = re.compile(r"&(?:#(\d{1,7})|#[xX]([0-9a-fA-F]{1,6})|([a-zA-Z][a-zA-Z0-9]*));")


def entities(text: str | None, mode: str) -> str | None:
    """``html``: all are resolved. ``xml``: numbers and the five names of XML. ``xhtml``: as ``html``, but what names a character of markup stays. ``none``: the text as it is."""
    if text is None or mode == "none":
        return text

    def said(m):
        number = int(m[1]) if m[1] else int(m[2], 16) if m[2] else None
        if number is not None:
            return html.unescape(m[0]) if number else m[0]
        if m[3] in _XML:
            return m[0] if mode == "xhtml" else _XML[m[3]]
        return m[0] if mode == "xml" else html.unescape(m[0])

    return _ENTITY.sub(said, text)


def resolve_entities(column, mode: str = "html"):
    """A text column with its entities resolved, by mode."""
    if mode not in ("html", "xml", "xhtml", "none"):
        raise ValueError(f"no mode {mode}")

    @F.arrow_udf(T.StringType())
    def resolved(texts: pa.Array) -> pa.Array:
        return pa.array([entities(x, mode) for x in texts.to_pylist()], pa.string())

    return resolved(column)
