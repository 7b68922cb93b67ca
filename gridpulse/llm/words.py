"""Words of a text, without case, accents, punctuation, mark-up, spacing and line breaks."""

from __future__ import annotations

import html
import re
import unicodedata

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->", re.S)


class _Folding(dict):
    """Each character's folded form, worked out when first met."""

    def __missing__(self, code: int) -> str:
        plain = unicodedata.normalize("NFKD", chr(code))
        self[code] = form = "".join(ch for ch in plain if unicodedata.category(ch) not in ("Mn", "Cf"))
        return form


_FOLDING = _Folding()


def fold(text: str) -> str:
    """Lower case, compatibility forms folded, accents and invisible characters dropped."""
    return text.lower() if text.isascii() else text.lower().translate(_FOLDING)


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of the folded text; a null or blank text has none."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    return _WORD.findall(fold(text))
