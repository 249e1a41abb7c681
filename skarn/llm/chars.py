"""Characters that look like others: one table, used as a Python translate map and inside embedded SQL."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

#: Letters of other scripts drawn like a Latin letter (Cyrillic, Greek, Armenian, Cherokee, Lisu, phonetic).
LOOK_ALIKE = {
    "a": "аɑα", "c": "сϲᴄ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "іιᎥ", "j": "јϳ",
    "l": "ӏ", "n": "ո", "o": "оοօᴏ", "p": "рρ", "q": "ԛզ", "s": "ѕꜱ", "u": "սᴜ", "v": "νѵᴠ", "w": "ԝᴡ", "x": "хχ", "y": "уү", "z": "ᴢ",
    "A": "АΑᎪꓮ", "B": "ВΒᏴꓐ", "C": "СϹᏟꓚ", "D": "Ꭰꓓ", "E": "ЕΕᎬꓰ", "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "НΗᎻꓧ", "I": "ІΙӀꓲ", "J": "ЈͿᎫꓙ",
    "K": "КΚᏦꓗ", "L": "Ꮮꓡ", "M": "МΜϺᎷꓟ", "N": "Νꓠ", "O": "ОΟՕꓳ", "P": "РΡᏢꓑ", "Q": "Ԛ", "R": "ᎡᏒꓣ", "S": "ЅՏᏚꓢ", "T": "ТΤᎢꓔ", "U": "Սꓴ",
    "V": "ѴᏙꓦ", "W": "ԜᎳꓪ", "X": "ХΧꓫ", "Y": "ҮΥꓬ", "Z": "ΖᏃꓜ", "μ": "µ",
}
#: Accented letters of other scripts whose base is in the table above.
LOOK_ALIKE_ACCENTED = {"è": "ѐ", "ë": "ё", "ï": "ї", "ó": "ό", "ö": "ӧ", "ä": "ӓ", "É": "Έ", "Ó": "Ό", "Á": "Ά"}
#: Spaces of other widths, hyphens drawn like the plain one.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011"
#: Characters drawn as nothing that are not format characters: joiners and fillers; first and last of the
#: variation selectors; format characters that are drawn (number and verse signs that enclose what follows).
FILLERS = "\u034f\u115f\u1160\u17b4\u17b5\u2065\u3164\uffa0"
VARIATION = (("\u180b", "\u180f"), ("\ufe00", "\ufe0f"), ("\U000e0100", "\U000e01ef"))
DRAWN = "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2\U000110bd\U000110cd"
#: Ligatures of Latin letters, drawn like the letters side by side.
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb06": "st"}


def _single_forms(first: int, last: int, ascii_only: bool = True) -> dict[str, str]:
    """Characters of a block whose compatibility form is one other character: full- and half-width forms, Roman numerals."""
    forms = ((chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(first, last + 1))
    return {c: plain for c, plain in forms if len(plain) == 1 and plain != c and (plain.isascii() or not ascii_only)}


def _invisible() -> str:
    """Format characters but those that are drawn, variation selectors, tags and fillers."""
    selectors = (chr(c) for first, last in VARIATION for c in range(ord(first), ord(last) + 1))
    formats = (chr(c) for c in range(0xAD, 0xE0080) if unicodedata.category(chr(c)) == "Cf" and chr(c) not in DRAWN)
    return "".join(sorted({*formats, *selectors, *FILLERS} | {chr(c) for c in range(0x206A, 0x2070)}))


def replacements() -> dict[str, str]:
    """Every mapped character and what it becomes; "" for those drawn as nothing. Ligatures become several letters.

    Full-width, half-width, upright sans-serif and monospaced forms count as plain; bold, slanted, raised, enclosed and
    built-up ones look different and stay.
    """
    out = {c: plain for table in (LOOK_ALIKE, LOOK_ALIKE_ACCENTED) for plain, many in table.items() for c in many}
    out |= _single_forms(0xFF01, 0xFF5E) | _single_forms(0x2160, 0x217F) | {"\u212a": "K"}
    out |= _single_forms(0xFF61, 0xFF9F, ascii_only=False) | _single_forms(0xFFE0, 0xFFE6, ascii_only=False)
    for first, last in ((0x1D5A0, 0x1D5D3), (0x1D670, 0x1D6A3), (0x1D7E2, 0x1D7EB), (0x1D7F6, 0x1D7FF)):
        out |= _single_forms(first, last)
    out |= dict.fromkeys(SPACES, " ") | dict.fromkeys(HYPHENS, "-") | dict.fromkeys(_invisible(), "") | LIGATURES
    return out


REPLACEMENTS = replacements()
_TABLE = str.maketrans(REPLACEMENTS)
#: The plane of two-byte characters, as a table: what each becomes, and whether it is replaced by one other (1) or by none or several (2).
_PLANE = 1 << 16
_SINGLE = np.arange(_PLANE, dtype=np.uint32)
_REPLACED = np.zeros(_PLANE, dtype=np.uint8)
for _c, _becomes in REPLACEMENTS.items():
    if ord(_c) < _PLANE:
        _REPLACED[ord(_c)] = 1 if len(_becomes) == 1 else 2
        if len(_becomes) == 1:
            _SINGLE[ord(_c)] = ord(_becomes)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _text(of: np.ndarray) -> str:
    return of.tobytes().decode("utf-32-le", "surrogatepass")


class Apart(dict):
    """Puts a space for every character that ``keep`` refuses. A translate map, filled as characters come, and a table of
    the plane of two-byte characters, by which longer texts that are not ASCII are mapped at once."""

    def __init__(self, keep: Callable[[str], bool]):
        super().__init__()
        self.keep, self.plane = keep, None

    def __missing__(self, code: int) -> int:
        self[code] = out = code if self.keep(chr(code)) else 0x20
        return out

    def __call__(self, text: str) -> str:
        if text.isascii() or (of := points(text)).max() >= _PLANE:
            return text.translate(self)
        if self.plane is None:
            self.plane = np.array([self[c] for c in range(_PLANE)], dtype=np.uint32)
        return _text(self.plane[of])


_APART = Apart(str.isalnum)


def plain(text: str) -> str:
    """The visible form of ``text``: look-alikes, widths and invisible characters unified, accents composed."""
    if text.isascii():
        return text
    of = points(text)
    how = 2 if of.max() >= _PLANE else _REPLACED[of].max()
    return unicodedata.normalize("NFC", text if how == 0 else _text(_SINGLE[of]) if how == 1 else text.translate(_TABLE))


def words(text: str) -> list[str]:
    """Lower-case words of the visible form, whatever the punctuation and layout."""
    return _APART(plain(text).lower()).split()
