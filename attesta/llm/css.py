"""Which elements style sheets and style attributes hide: display and visibility of simple selectors."""

from __future__ import annotations

import re
from collections import defaultdict

_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)
_IMPORTANT = re.compile(r"\s*!\s*important\s*\Z", re.IGNORECASE)
_PART = re.compile(r"([.#]?)(\*|[\w\-\u0080-\U0010FFFF]+)")
_COMPOUND = re.compile(r"(?:\*|[a-zA-Z][\w\-]*)?(?:[.#][\w\-\u0080-\U0010FFFF]+)*\Z")
#: What the two properties may say; anything else counts for nothing.
VALUES = {
    "visibility": frozenset("visible hidden collapse inherit initial unset revert".split()),
    "display": frozenset("none block inline inline-block flow-root flex inline-flex grid inline-grid table inline-table table-row table-cell table-row-group table-header-group table-footer-group table-column table-column-group table-caption list-item contents ruby inherit initial unset revert".split()),
}

#: property: (important, specificity, order, value)
Said = dict[str, tuple[bool, tuple[int, int, int], int, str]]


def declarations(style: str) -> list[tuple[str, str, bool]]:
    """(property, value, important) of a style attribute or a rule's block, in order, of display and visibility only."""
    out = []
    for part in _COMMENT.sub(" ", style).split(";"):
        name, colon, value = part.partition(":")
        name = name.strip().lower()
        if colon and name in VALUES:
            plain = _IMPORTANT.sub("", value)
            word = " ".join(plain.lower().split())
            if word in VALUES[name]:
                out.append((name, word, len(plain) != len(value)))
    return out


def _take(said: Said, found: list[tuple[str, str, bool]], weight: tuple[int, int, int], order: int) -> None:
    for name, value, important in found:
        new = (important, weight, order, value)
        if name not in said or new[:3] >= said[name][:3]:
            said[name] = new


class Sheet:
    """Rules of a page's style sheets. Selectors of a tag, classes and an id without combinators are read; others, and rules in
    at-rules other than ``@media`` for all or for screens, count for nothing."""

    def __init__(self, text: str = ""):
        self.rules: dict[str, list[tuple[frozenset[str], tuple[int, int, int], int, list[tuple[str, str, bool]]]]] = defaultdict(list)
        self.count = 0
        if text:
            self._read(_COMMENT.sub(" ", text))

    def _read(self, text: str) -> None:
        at = 0
        while (brace := text.find("{", at)) >= 0:
            head = text[at:brace].rpartition(";")[2].strip()
            depth, end = 1, brace + 1
            for m in re.compile(r"[{}]").finditer(text, end):
                depth += 1 if m[0] == "{" else -1
                end = m.end()
                if not depth:
                    break
            else:
                end = len(text) + 1
            body, at = text[brace + 1 : end - 1], end
            if head.startswith("@"):
                if re.fullmatch(r"@media\s+(?:only\s+)?(?:all|screen)", head, re.IGNORECASE):
                    self._read(body)
            else:
                self._rule(head, body)

    def _rule(self, head: str, body: str) -> None:
        found = declarations(body)
        for selector in head.split(",") if found else ():
            selector = selector.strip()
            if not selector or not _COMPOUND.match(selector):
                continue
            parts = [sign + (name if sign else name.lower()) for sign, name in _PART.findall(selector)]
            ids, classes = (sum(p[0] == sign for p in parts) for sign in "#.")
            tags = [p for p in parts if p[0] not in "#."]
            weight = (ids, classes, sum(t != "*" for t in tags))
            key = next((p for sign in "#." for p in parts if p[0] == sign), tags[0] if tags else "*")
            self.count += 1
            self.rules[key].append((frozenset(p for p in parts if p != "*"), weight, self.count, found))

    def said(self, tag: str, attrs: dict[str, str]) -> tuple[str | None, str | None]:
        """(display, visibility) of an element by its rules and its own style, which stands above rules that aren't important."""
        if not self.rules and "style" not in attrs:
            return None, None
        out: Said = {}
        if self.rules:
            own = {tag, *(f".{c}" for c in attrs.get("class", "").split())} | ({f"#{attrs['id']}"} if attrs.get("id") else set())
            for key in (*own, "*"):
                for need, weight, order, found in self.rules.get(key, ()):
                    if need <= own:
                        _take(out, found, weight, order)
        if "style" in attrs:
            _take(out, declarations(attrs["style"]), (1 << 30, 0, 0), self.count + 1)
        return tuple(out[name][3] if name in out else None for name in ("display", "visibility"))
