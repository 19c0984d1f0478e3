"""Problem 8: texts above a limit into overlapping pieces that end where the text itself pauses."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.tokens import TOKENIZER, tokenizer

_GAP = "[ \\t\\u00a0\\u3000]"
#: Line ends, and what a line may be. A Setext underline makes the line before it a heading.
_LINE = re.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_HASHES = re.compile(r" {0,3}(#{1,6})(?=[ \t]|$)")
_TAGGED = re.compile(r"\s*<h([1-6])[\s>]", re.I)
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|(?:-[ \t]*){3,})$")
_ITEM = re.compile("([ \t\u3000]*)(?:[-*+\u2022]|\\d{1,9}[.)])[ \t]")
_NESTS = re.compile("\\s*(?:[{\\[]|</?[a-zA-Z])")
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{\[]|[}\]]|,|<!--.*?-->|<[^<>]*>', re.S)
#: Below the structure a text pauses, from the strongest pause to the weakest: sentences, clauses, words.
PAUSES = tuple(
    re.compile(p)
    for p in (
        f"(?<=[.!?\u2026])[\"'\u201d\u2019\u00bb)\\]]*{_GAP}+|[\u3002\uff01\uff1f]+[\u201d\u300d\u300f\uff09]*",
        f"(?<=[,;:]){_GAP}+|[\uff0c\u3001\uff1b\uff1a]",
        f"{_GAP}+(?=\\S)",
    )
)
#: A pre-token never reaches over a place like this, whatever stands around it.
_SEAM = re.compile(r"(?<=\S)(?=\s)")


@dataclass(frozen=True)
class Node:
    """A part of a text; the children of a node stand side by side and cover it."""

    kind: str
    start: int
    stop: int


class Tree:
    """The structure of a text: sections by headings of six levels (hashes, underlines, tags), in them fenced blocks, tables,
    lists with nested items, nested brackets and elements, and paragraphs; in these lines, sentences, clauses and words.

    Nodes are expanded when they are asked for their children, so a node that fits costs nothing.
    """

    def __init__(self, text: str):
        self.text = text
        ends = [m.end() for m in _LINE.finditer(text)]
        self.starts = [0, *ends] if not ends or ends[-1] < len(text) else [0, *ends[:-1]]
        self.kinds: list[str] = []
        #: start and level of each heading
        self.headings: list[tuple[int, int]] = []
        fence = None
        for i, start in enumerate(self.starts):
            line = text[start : self.starts[i + 1] if i + 1 < len(self.starts) else len(text)].rstrip("\r\n\x0b\x0c\x85\u2028\u2029")
            mark = _FENCE.match(line)
            if fence is not None:
                self.kinds.append("fence")
                if mark and mark[1].startswith(fence) and not line[mark.end() :].strip():
                    fence = None
            elif mark:
                # a fence that is never closed is no fence
                closed = re.compile(f"^ {{0,3}}{mark[1]}[`~]*[ \t]*$", re.M).search(text, start + len(line))
                fence = mark[1] if closed else None
                self.kinds.append("fence" if closed else "text")
            elif not line.strip():
                self.kinds.append("blank")
            elif level := self._level(line):
                self.headings.append((start, level))
                self.kinds.append("heading")
            elif (under := _UNDERLINE.match(line)) and i and self.kinds[-1] == "text" and (i < 2 or self.kinds[-2] != "text"):
                self.headings.append((self.starts[i - 1], 1 if under[1][0] == "=" else 2))
                self.kinds[-1] = "heading"
                self.kinds.append("underline")
            elif _RULE.match(line):
                self.kinds.append("rule")
            elif item := _ITEM.match(line):
                self.kinds.append(f"item{len(item[1].expandtabs(4))}")
            else:
                self.kinds.append("table" if line.lstrip().startswith("|") else "text")

    @staticmethod
    def _level(line: str) -> int:
        if m := _HASHES.match(line):
            return len(m[1])
        return int(m[1]) if (m := _TAGGED.match(line)) else 0

    def root(self) -> Node:
        return Node("section", 0, len(self.text))

    def _parts(self, node: Node, cuts: list[int], kinds) -> list[Node]:
        at = [node.start, *cuts, node.stop]
        return [Node(kinds if isinstance(kinds, str) else kinds[i], at[i], at[i + 1]) for i in range(len(at) - 1) if at[i] < at[i + 1]]

    def children(self, node: Node) -> list[Node]:
        """Two nodes or more, or none if nothing divides it but its characters."""
        kind = node.kind
        while kind is not None:
            parts, below = self._EXPAND[kind](self, node)
            if len(parts) > 1:
                return parts
            kind = below
        return []

    def _section(self, node):
        low = bisect.bisect_left(self.headings, (node.start, 0))
        high = bisect.bisect_left(self.headings, (node.stop, 0))
        inner = self.headings[low:high]
        cuts = self._outermost(inner)
        if cuts == [node.start]:
            # the heading of the section itself
            cuts = self._outermost(inner[1:])
        first = "section" if cuts and cuts[0] == node.start else "body"
        return self._parts(node, [c for c in cuts if c > node.start], [first, *["section"] * len(cuts)]), "body"

    @staticmethod
    def _outermost(headings: list[tuple[int, int]]) -> list[int]:
        out, level = [], 7
        for start, own in headings:
            if own <= level:
                out.append(start)
                level = own
        return out

    def _lines(self, node) -> range:
        first = bisect.bisect_right(self.starts, node.start) - 1
        return range(first, bisect.bisect_left(self.starts, node.stop))

    def _body(self, node):
        """Blocks; blank lines belong to the block before."""
        cuts, kinds, now, blank = [], [], None, False
        for i in self._lines(node):
            k = self.kinds[i]
            if k == "blank":
                blank = True
                continue
            word = "list" if k.startswith("item") else {"underline": "heading", "text": "paragraph", "rule": "paragraph"}.get(k, k)
            held = now == "list" and word == "paragraph" and (not blank or self.text[self.starts[i] : self.starts[i] + 1] in " \t")
            same = word == now and (not blank or now in ("list", "fence")) and k != "rule" and (k != "heading" or self.kinds[i - 1] != "heading")
            if not (held or same):
                cuts.append(max(self.starts[i], node.start))
                kinds.append("nested" if word in ("paragraph", "fence") and _NESTS.match(self.text, self.starts[i]) and word == "paragraph" else word)
                now = word
            blank = False
        return self._parts(node, cuts[1:], kinds or "lines"), kinds[0] if len(kinds) == 1 else "lines"

    def _list(self, node):
        """Items of the least indent; deeper ones stay with the item they stand in."""
        items = [(i, int(self.kinds[i][4:])) for i in self._lines(node) if self.kinds[i].startswith("item") and self.starts[i] >= node.start]
        least = min((d for _, d in items), default=0)
        return self._parts(node, [self.starts[i] for i, d in items if d == least and self.starts[i] > node.start], "item"), "item"

    def _item(self, node):
        """An item's own lines, and the list nested in it."""
        inner = [i for i in self._lines(node) if self.kinds[i].startswith("item") and self.starts[i] > node.start]
        return self._parts(node, [self.starts[inner[0]]] if inner else [], ["heading", "list"]), "paragraph"

    def _nested(self, node):
        """Members of the outermost brackets, or elements side by side; the brackets themselves stay with the first and last."""
        cuts, depth, least = [], 0, []
        for m in _TOKEN.finditer(self.text, node.start, node.stop):
            c, one = m[0], m.start()
            if c in "{[" or (c[0] == "<" and len(c) > 2 and c[1].isalpha() and not c.endswith("/>")):
                least.append((depth, one, "open"))
                depth += 1
            elif c in "}]" or c.startswith("</"):
                depth -= 1
            elif c == ",":
                least.append((depth, m.end(), "comma"))
            elif c.endswith("/>"):
                least.append((depth, one, "open"))
        for level in sorted({d for d, *_ in least})[:8]:
            cuts = sorted({at for d, at, _ in least if d == level and node.start < at < node.stop and self.text[node.start : at].strip("{[ \t\r\n")})
            if cuts:
                break
        return self._parts(node, cuts, "nested"), "paragraph"

    def _by_line(self, node):
        return self._parts(node, [self.starts[i] for i in self._lines(node) if self.starts[i] > node.start], "line"), "line"

    def _line(self, node):
        return self._pause(node, 0), "clause"

    def _clause(self, node):
        return self._pause(node, 1), "words"

    def _words(self, node):
        return self._pause(node, 2), None

    def _pause(self, node, level: int) -> list[Node]:
        out, text = [], self.text
        for m in PAUSES[level].finditer(text, node.start, node.stop):
            at = m.end()
            # a single space before a word belongs to the word's side in all vocabularies
            if at < node.stop and text[at - 1] == " " and text[at : at + 1].strip():
                at -= 1
            if node.start < at < node.stop:
                out.append(at)
        return self._parts(node, out, ("clause", "words", "word")[level])

    def _word(self, node):
        return [], None

    _EXPAND = {  # noqa: RUF012
        "section": _section, "body": _body, "list": _list, "item": _item, "nested": _nested, "line": _line, "clause": _clause, "words": _words, "word": _word,
        **dict.fromkeys(("paragraph", "fence", "table", "heading", "lines"), _by_line),
    }


class Measured:
    """A text with the number of its tokens up to each character."""

    def __init__(self, text: str, tokens):
        self.text, self._tokens = text, tokens
        ends = tokens.ends(text)
        if text.isascii():
            self._byte = None
        else:
            raw = np.frombuffer(text.encode("utf-8", "replace"), "uint8")
            self._byte = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        self._ends = ends
        self.total = len(ends)

    def upto(self, at: int) -> int:
        """Tokens that begin before the character (one that is cut counts)."""
        b = at if self._byte is None else self._byte[at]
        k = int(np.searchsorted(self._ends, b, "left"))
        return min(k + 1, self.total) if b > 0 else 0

    def size(self, start: int, stop: int) -> int:
        """Tokens between two characters, a cut one counts in full."""
        b = start if self._byte is None else self._byte[start]
        return self.upto(stop) - int(np.searchsorted(self._ends, b, "right"))

    def count(self, start: int, stop: int) -> int:
        """Tokens of the part as a text of its own: those within it, and its two edges tokenized again."""
        first = _SEAM.search(self.text, start + 1, stop)
        if first is None:
            return self._tokens.count(self.text[start:stop])
        last = stop - 1
        while not (self.text[last].isspace() and not self.text[last - 1].isspace()):
            last -= 1
        a, b = first.start(), last
        return self._tokens.count(self.text[start:a]) + self.upto(b) - self.upto(a) + self._tokens.count(self.text[b:stop])

    def back(self, at: int, tokens: int) -> int:
        """The character at which the last ``tokens`` tokens before ``at`` begin, or one before."""
        k = self.upto(at) - tokens
        if k <= 0:
            return 0
        b = int(self._ends[k - 1])
        return b if self._byte is None else int(np.searchsorted(self._byte, b, "right")) - 1


def _pack(m: Measured, tree: Tree, node: Node, limit: int) -> list[int]:
    """Ends of the pieces of a node: it is one if it fits; else whole siblings are merged while they fit together, and only
    oversized ones are descended into. What is left of one isn't merged with its siblings; only a heading keeps to what
    it stands over."""
    if m.size(node.start, node.stop) <= limit:
        return [node.stop]
    parts = tree.children(node)
    if not parts:
        # no pause at all: as many tokens as fit, at least one character
        out, start = [], node.start
        while m.size(start, node.stop) > limit:
            low, high = start + 1, node.stop
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if m.size(start, mid) <= limit else (low, mid - 1)
            out.append(low)
            start = low
        return [*out, node.stop] if start < node.stop else out
    out, open_at, only_heads = [], node.start, True
    for part in parts:
        if m.size(open_at, part.stop) <= limit:
            only_heads &= part.kind == "heading"
            continue
        if m.size(part.start, part.stop) <= limit:
            out.append(part.start)
            open_at, only_heads = part.start, part.kind == "heading"
            continue
        inner = _pack(m, tree, part, limit)
        if part.start > open_at and not (only_heads and m.size(open_at, inner[0]) <= limit):
            out.append(part.start)
        out.extend(inner)
        open_at, only_heads = part.stop, True
    return out if open_at == node.stop else [*out, node.stop]


def split_text(text: str, tokens, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(begin, fresh, end, tokens) of each piece: the characters begin..fresh repeat the piece before, fresh..end are new.

    Every piece has at most ``limit`` tokens as counted on the piece itself. The overlap has at least ``overlap`` tokens
    of the text, less only where the piece before is shorter, and begins at a word where one begins within it.
    """
    if len(text) <= limit and len(text.encode("utf-8", "replace")) <= limit:
        return [(0, 0, len(text), tokens.count(text))]
    m = Measured(text, tokens)
    if m.total <= limit:
        return [(0, 0, len(text), m.total)]
    # tokens are counted again at a piece's two edges, where they may fall otherwise than within the text
    room = limit - overlap - min(8, (limit - overlap) // 4)
    tree = Tree(text)
    ends, out, start, i = _pack(m, tree, tree.root(), room), [], 0, 0
    while i < len(ends):
        end, begin = ends[i], start
        if start:
            begin = m.back(start, overlap)
            if (space := text.rfind(" ", max(0, begin - 24), begin + 1)) > max(0, begin - 24):
                begin = space
            while begin > out[-1][0] and (short := overlap - m.count(begin, start)) > 0:
                begin = max(out[-1][0], m.back(begin, short))
            begin = max(begin, out[-1][0])
        n = m.count(begin, end)
        if n > limit and end - start > 1:
            # rare: the edges cost more than was kept free; the piece is halved at the best break
            ends[i : i + 1] = _pack(m, tree, Node("lines", start, end), max(1, m.size(start, end) * 3 // 4))
            if ends[i] == end:
                ends.insert(i, (start + end) // 2)
            continue
        while n > limit and begin < start:
            begin = start - (start - begin) // 2 if start - begin > 1 else start
            n = m.count(begin, end)
        out.append((begin, start, end, n))
        start = end
        i += 1
    return out


def split_documents(docs: DataFrame, *, doc_id: str, text: str, limit: int = 1024, overlap: int = 64, path: str = TOKENIZER) -> DataFrame:
    """Cuts every text above ``limit`` tokens into pieces under it.

    The text is parsed into a tree (see :class:`Tree`): sections, blocks, list items and elements, lines, sentences, clauses,
    words. Whole siblings are merged up to the limit and only a node that doesn't fit is descended into. Result: ``doc_id``,
    ``piece``, ``start_char``, ``new_from_char``, ``end_char``, ``n_tokens``, ``text``. The characters from ``start_char``
    to ``new_from_char`` repeat the end of the piece before; the rest, put together, gives the text back.

    Defined cases: texts up to the limit, null and empty ones and null ids don't come out; repeated rows are cut each;
    other columns are not read. A character of more tokens than the limit would stand alone in its piece.

    Plan: no shuffle; one pass over the texts, which are tokenized once as a whole and once as pieces.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be below the limit")
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches):
        own = tokenizer(path)
        for rows in batches:
            out = []
            for d, t in zip(rows["d"], rows["t"], strict=True):
                pieces = split_text(t, own, limit, overlap)
                if len(pieces) > 1:
                    out.extend((d, k, b, f, e, n, t[b:e]) for k, (b, f, e, n) in enumerate(pieces))
            yield pd.DataFrame(out, columns=["d", "piece", "start_char", "new_from_char", "end_char", "n_tokens", "text"])

    # a token has at least one byte
    long = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).dropna().where(F.octet_length("t") > limit)
    return long.mapInPandas(cut, f"d {kind}, piece int, start_char int, new_from_char int, end_char int, n_tokens int, text string").withColumnRenamed("d", doc_id)
