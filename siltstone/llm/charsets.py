"""Texts that were decoded by a wrong charset, decoded again by the right one."""

from __future__ import annotations

import codecs
import re

#: Charsets that texts were decoded by falsely, and those that they were written in.
FALSE = ("cp1252", "latin-1", "iso-8859-2", "cp1251", "shift_jis", "cp932")
TRUE = ("utf-8", "cp1251", "koi8-r", "shift_jis", "euc_jp", "gb18030", "cp1256", "iso-8859-6")
#: Characters that the choice is made by.
HEAD = 2000
#: Least share of characters that a wrong charset leaves, in texts that are tried; most share of characters that the false charset lacks.
SUSPECT, LACKED = 0.25, 0.1
#: Advantage of UTF-8, whose form other texts' bytes hardly ever have.
FORM = 0.1

#: What a wrong charset leaves: accented letters, signs, controls, half-width kana, Cyrillic letters beyond Russian, lines of boxes, private characters.
ODD = re.compile("[\x80-\u024f\u02c6-\u02dd\u0402-\u040f\u0452-\u045f\u0490\u0491\u2013-\u203a\u20ac\u2122\u2500-\u259f\u3016\ue000-\uf8ff\uff61-\uff9f\ufffd]")
GONE = "\ufffd"
PARTS = re.compile("[\u3040-\u30ff\u3400-\u9fff]|[^\\W\\d_\u3040-\u30ff\u3400-\u9fff]+")
PLAIN = re.compile("[A-Za-z]")


def suspect(text: str) -> float:
    """The share of characters that a wrong charset leaves, in the head of a text."""
    head = text[:HEAD]
    return 0.0 if head.isascii() else len(ODD.findall(head)) / max(1, _solid(head))


def _solid(text: str) -> int:
    """The number of characters that aren't blank."""
    return sum(map(len, text.split()))


class _Lacking:
    """Error handler of encodings: puts ``lost`` for what a charset lacks and counts it, but for U+FFFD, which was a byte that is lost."""

    lost, count = b"", 0

    def __call__(self, error: UnicodeEncodeError) -> tuple[bytes, int]:
        out = b""
        for c in error.object[error.start : error.end]:
            kept = "\x80" <= c <= "\x9f"  # a byte without a character often stays as a control
            self.count += not kept and c != GONE
            out += c.encode("latin-1") if kept else self.lost
        return out, error.end


_lacking = _Lacking()
codecs.register_error("siltstone.lacking", _lacking)


def _bytes(text: str, charset: str, lost: bytes) -> tuple[bytes, int]:
    """The bytes that ``charset`` made the text of, and how many characters it lacks."""
    _lacking.lost, _lacking.count = lost, 0
    return text.encode(charset, "siltstone.lacking"), _lacking.count


def _lost(false: str, true: str) -> bytes:
    """The byte put for a lost one, so that words stay whole: the second of a frequent letter in UTF-8, a letter elsewhere."""
    return b"\xe0" if true != "utf-8" else b"\x84" if false in ("shift_jis", "cp932") else b"\x81"


def _known(text: str, glue: frozenset[str]) -> float:
    """The share of words that are function words."""
    parts = PARTS.findall(text.lower())
    return sum(t in glue for t in parts) / max(1, len(parts))


def undone(text: str, glue: frozenset[str]) -> str:
    """The text as it was written if a wrong charset decoded it and its bytes can be had back; else the text itself.

    Of all pairs of charsets the one is taken that leaves the most function words (``glue``) and the
    fewest odd characters; it must halve the odd ones. A text most of whose odd characters are U+FFFD
    is lost; one with accents among plain letters isn't tried.
    """
    odd = suspect(text)
    head = text[:HEAD]
    if odd < SUSPECT or head.count(GONE) > len(ODD.findall(head)) / 2 or len(PLAIN.findall(head)) > 0.4 * _solid(head):
        return text
    most, pair = _known(head, glue) - odd, None
    for true in TRUE:
        for false in FALSE:
            raw, lacked = _bytes(head, false, _lost(false, true)) if true != false else (b"", len(head))
            if lacked > LACKED * len(head):
                continue
            made = raw.decode(true, "replace")
            left = suspect(made)
            score = _known(made, glue) - left + FORM * (true == "utf-8")
            if left <= odd / 2 and score > most:
                most, pair = score, (false, true)
    if pair is None:
        return text
    return _bytes(text, pair[0], _lost(*pair))[0].decode(pair[1], "replace")
