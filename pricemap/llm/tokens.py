"""Token ids of whole texts, shared by the packing and token-file operators.

Ids are the tokenizers library's own.  A vocabulary's units (words, numbers, marks, white space) don't
depend on each other, and words repeat, so a worker keeps the ids of units that it has met and hands
only new ones to the library's model.  A text with letters beyond Latin-1 is cut into pieces at white
space, where no token can cross; its pieces of Latin-1 go the same way, the others to the library whole.
"""

from __future__ import annotations

import os
import re
import zlib
from struct import Struct

import numpy as np

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"

#: Units whose ids one worker keeps in its young half; the older half goes when it is full.
MEMO_UNITS = 500_000

# The units that the two vocabularies' files define, for texts of Latin-1 alone.
_L, _N, _S = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\\t-\\r \u0085\u00a0"
_UNITS = {
    BYTE_BPE: re.compile(f" ?[{_L}]++| ?[{_N}]++|'s|'t|'re|'ve|'m|'ll|'d| ?[^{_S}{_L}{_N}]++|[{_S}]+(?![^{_S}])|[{_S}]+"),
    WORD_BPE: re.compile(f"[{_L}]++|[{_N}]|'s|'t|'re|'ve|'m|'ll|'d|[^{_S}{_L}{_N}]++"),
}
_BEYOND = re.compile("[^\x00-\xff]")
#: A cut before a white-space character is safe after any other.
_CUT = re.compile(r"(?<=\S)(?=[ \t\n\r\f\v])")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte that doesn't print as one of the letters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


_LETTER_OF = _byte_letters()
_PACK = [Struct(f"<{n}I").pack for n in range(64)]
_ENCODERS: dict[tuple, "Encoder"] = {}


def vocabulary_path(name: str) -> str:
    """Path of a public vocabulary; an absolute path is taken as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class _Memo(dict):
    """Ids by unit; a unit that is not known is taken from the older half or encoded."""

    def __init__(self, encode, older: dict):
        super().__init__()
        self.encode, self.older = encode, older

    def __missing__(self, unit: str) -> bytes:
        found = self.older.get(unit)
        self[unit] = found = self.encode(unit) if found is None else found
        return found


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, equal to the tokenizers library's own.

    ``plain``: the strings of special tokens within a text are ordinary text, where the library's
    default takes each for that token.  Other vocabularies than the two named go to the library whole.
    """

    def __init__(self, name: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(name))
        self.tokenizer.encode_special_tokens = plain
        self.special = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        base = os.path.basename(name)
        self.units = _UNITS[base].findall if base in _UNITS else None
        self.lower = base == WORD_BPE
        self.memo = _Memo(self._unit, {})

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _unit(self, unit: str) -> bytes:
        """A unit of Latin-1: the model's own word, of letters that stand for its UTF-8 bytes."""
        if unit.isascii() and unit.isprintable():
            letters = unit.replace(" ", _LETTER_OF[32])
        else:
            letters = unit.encode().decode("latin-1").translate(_LETTER_OF)
        ids = [t.id for t in self.model.tokenize(letters)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, dtype="<u4").tobytes()

    def _latin(self, text: str) -> bytes:
        if len(self.memo) > MEMO_UNITS:
            self.memo = _Memo(self._unit, dict(self.memo))
        return b"".join(map(self.memo.__getitem__, self.units(text.lower() if self.lower else text)))

    def _piece(self, piece: str) -> bytes:
        return self._whole(piece) if _BEYOND.search(piece) else self._latin(piece)

    def encode(self, text: str | None) -> bytes:
        """The ids of a text; None counts as empty."""
        if not text:
            return b""
        if self.units is None or any(s in text for s in self.special):
            return self._whole(text)
        return b"".join(map(self._piece, _CUT.split(text))) if _BEYOND.search(text) else self._latin(text)


def encoder(name: str, plain: bool = False) -> Encoder:
    """The worker's encoder of a vocabulary."""
    if (name, plain) not in _ENCODERS:
        _ENCODERS[name, plain] = Encoder(name, plain)
    return _ENCODERS[name, plain]


def encode_column(name: str, texts, end_id: int, plain: bool = False):
    """Yield each text's id bytes with ``end_id`` appended."""
    end = np.array([end_id], dtype="<u4").tobytes()
    coder = encoder(name, plain)
    for text in texts:
        yield coder.encode(text) + end


def crc32(ids: bytes) -> int:
    """Unsigned crc32 of id bytes."""
    return zlib.crc32(ids) & 0xFFFFFFFF
