"""Elements of a page that meet simple selectors: one pass over its tags, in time linear in the page.

A selector names a tag, tests of attributes, tests that one ancestor at any depth meets, and a test of the text.
Elements that are not shown (`hidden`, display:none, visibility:hidden, also of an ancestor, and input of type hidden) do not count.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?=>|\Z)|[^>]*)(?:>|\Z))", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_RAW = {n: re.compile(rf"</{n}\b[^>]*>|\Z", re.I) for n in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)


@dataclass(frozen=True)
class Attr:
    """An attribute's value: equal to (how "="), holding ("*") or ending with ("$") `value`."""

    name: str
    how: str
    value: str
    any_case: bool = False

    def holds(self, attrs: dict[str, str]) -> bool:
        got, want = attrs.get(self.name), self.value
        if got is None:
            return False
        if self.any_case:
            got, want = got.lower(), want.lower()
        return got == want if self.how == "=" else want in got if self.how == "*" else got.endswith(want)


@dataclass(frozen=True)
class Selector:
    """tag: None for any. says: one unbroken run of the element's own text, white space aside. matches: a pattern found in its whole text and in that of none of its children."""

    tag: str | None = None
    attrs: tuple[Attr, ...] = ()
    within: tuple[Attr, ...] = ()
    says: str | None = None
    matches: str | None = None

    @property
    def of_text(self) -> bool:
        return self.says is not None or self.matches is not None


class _Open:
    """An element whose end has not come, with what its text tests need: own runs, pieces of its whole text, texts of its children."""

    __slots__ = ("attrs", "hidden", "met", "name", "pieces", "runs", "texts", "waiting")

    def __init__(self, name: str, attrs: dict[str, str], above: _Open | None, within: list[tuple[Attr, ...]], waiting: list[int]) -> None:
        self.name, self.attrs, self.waiting = name, attrs, waiting
        self.hidden = above is not None and above.hidden or "hidden" in attrs or _HIDING.search(attrs.get("style", "")) is not None or name == "input" and attrs.get("type", "").lower() == "hidden"
        #: Which of the ancestor tests this element or one above it meets.
        self.met = {i for i, tests in enumerate(within) if all(t.holds(attrs) for t in tests)} | (above.met if above else set())
        self.runs, self.pieces, self.texts = [""], [], []


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(source):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def _squeezed(text: str) -> str:
    return " ".join(text.split())


def select(page: str | None, selectors: tuple[Selector, ...]) -> list[list[dict[str, str]]]:
    """For each selector the attributes of the elements that meet it, in page order. A null page has none.

    End tags without a start tag go; an element whose end tag is missing ends with the one around it; a link or paragraph ends the one before.
    Text is kept for elements with a text test and what is in them only.
    """
    found: list[list[tuple[int, dict[str, str]]]] = [[] for _ in selectors]
    within = sorted({s.within for s in selectors if s.within}, key=repr)
    place = {w: i for i, w in enumerate(within)}
    stack: list[_Open] = [_Open("", {}, None, [], [])]
    opened: Counter[str] = Counter()
    recording = 0  # open elements that wait for a text test
    starts: list[int] = []

    def text(part: str) -> None:
        if recording and part:
            part = html.unescape(part)
            stack[-1].runs[-1] += part
            stack[-1].pieces.append(part)

    def close() -> None:
        nonlocal recording
        node, at = stack.pop(), starts.pop()
        opened[node.name] -= 1
        if not recording:
            return
        whole = "".join(node.pieces)
        for i in node.waiting:
            s = selectors[i]
            if s.says is not None:
                ok = any(_squeezed(r) == s.says for r in node.runs)
            else:
                ok = re.search(s.matches, _squeezed(whole)) is not None and not any(re.search(s.matches, _squeezed(t)) for t in node.texts)
            if ok:
                found[i].append((at, node.attrs))
        recording -= bool(node.waiting)
        if recording:
            above = stack[-1]
            above.pieces.append(whole)
            above.texts.append(whole)
            above.runs.append("")

    def end(name: str) -> None:
        if opened[name] > 0:
            while stack[-1].name != name:
                close()
            close()

    at = pos = 0
    page = page or ""
    while (m := _TAG.search(page, pos)) is not None:
        text(page[at : m.start()])
        at = pos = max(m.end(), m.start() + 1)
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            end(name)
            continue
        if name in ("a", "p"):
            end(name)
        attrs = _attributes(m[3])
        node = _Open(name, attrs, stack[-1], within, [])
        if not node.hidden:
            above = stack[-1].met
            for i, s in enumerate(selectors):
                if (s.tag is None or s.tag == name) and (not s.within or place[s.within] in above) and all(t.holds(attrs) for t in s.attrs):
                    if s.of_text:
                        node.waiting.append(i)
                    else:
                        found[i].append((m.start(), attrs))
        if name in _RAW:
            at = pos = _RAW[name].search(page, at).end()
        elif name not in _VOID:
            stack.append(node)
            starts.append(m.start())
            opened[name] += 1
            recording += bool(node.waiting)
        elif recording:
            stack[-1].runs.append("")
    text(page[at:])
    while len(stack) > 1:
        close()
    return [[attrs for _, attrs in sorted(f, key=lambda x: x[0])] for f in found]
