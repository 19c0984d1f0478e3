"""Text folding shared by the operators: what makes no difference between two spellings."""

from __future__ import annotations

import re
import unicodedata

#: Letters that carry no separable accent, and Cyrillic and Greek letters that look like Latin ones.
PLAIN_LETTERS = {
    "đ": "d", "ð": "d", "ø": "o", "ł": "l", "ħ": "h", "ŧ": "t", "ı": "i", "æ": "ae", "œ": "oe", "þ": "th",
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
_TABLE = str.maketrans(PLAIN_LETTERS)
_FOREIGN = re.compile("[" + "".join(PLAIN_LETTERS) + "]")
#: Marks left over from decomposition, and characters without width.
_UNSEEN = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯­͏؜᠎​-‏‪-‮⁠-⁤︀-️﻿]+")
_BROKEN = re.compile("(?<=[^\\W_])[-‐‑](?:\r\n|[\n\r\x0b\x0c\x85  ])[ \t>|　 ]*(?=[^\\W_])")
_TAG = re.compile(r"</?[a-z][^<>]*>")
_WORD = re.compile(r"[^\W_]+")
_LETTERS = re.compile(r"[\W\d_]+")
_MOJIBAKE = re.compile("[Â-ô][\u0080-¿]")


def repaired(text: str) -> str:
    """UTF-8 that was read as Latin-1 is read again; anything else stays as it is."""
    if _MOJIBAKE.search(text):
        try:
            return text.encode("latin-1").decode("utf-8")
        except UnicodeError:
            return text
    return text


def folded(text: str) -> str:
    """Lower case without accents, width forms, invisible characters and look-alike letters."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", repaired(text).casefold())
    text = _UNSEEN.sub("", text).casefold()
    return text.translate(_TABLE) if _FOREIGN.search(text) else text


def words(text: str | None) -> list[str]:
    """The words of a text; markup, punctuation, layout and hyphens at the end of a line make no difference."""
    if not text:
        return []
    text = folded(text)
    if "-" in text or "‐" in text or "‑" in text:
        text = _BROKEN.sub("", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(text)


def letters(text: str) -> str:
    """Only the letters of a folded text, of whatever script."""
    return _LETTERS.sub("", folded(text))
