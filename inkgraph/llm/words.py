"""Letters of a text: what language and toxicity are told by."""

from __future__ import annotations

import regex

#: Runs of anything but letters and the marks that combine with them.
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def letters(text: str | None) -> str:
    """The words of the text in lower case with single spaces between, before and after; a space for no words."""
    return _OTHER.sub(" ", f" {text.lower()} ") if text else " "
