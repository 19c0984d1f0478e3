"""Problem 7: passages of test items inside documents."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.text import words

#: Characters of item text in one block of test items; more items are searched block by block.
BLOCK_CHARS = 8_000_000
#: Words in the block that the shift table is asked about.
SUFFIX = 3


class PassageSearch:
    """Wu-Manber search over words for all passages of ``least`` consecutive words of the items.

    The shift table tells from the last words of the window (three, fewer where a pattern is shorter) how far it may move
    without passing a match; a shift of nothing opens the bucket of that suffix, whose passages are compared word by word.
    An item of fewer words is a pattern as a whole: such items are searched with windows of their own length.
    """

    def __init__(self, items: Iterable[tuple[int, str]], least: int):
        self.number: dict[str, int] = {}
        passages: dict[int, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))
        for item, text in items:
            own = [self.number.setdefault(w, len(self.number)) for w in words(text)]
            size = min(least, len(own))
            for i in range(len(own) - size + 1 if own else 0):
                owners = passages[size][tuple(own[i : i + size])]
                if not owners or owners[-1] != item:
                    owners.append(item)
        self.base = len(self.number) + 1
        self.windows = [_Window(size, found, self.base) for size, found in sorted(passages.items())]

    def find(self, text: str | None) -> set[int]:
        """The items of which the text holds a passage."""
        found: set[int] = set()
        if self.windows and text:
            get = self.number.get
            ids = [get(w, -1) for w in words(text)]
            for window in self.windows:
                window.find(ids, found)
        return found


class _Window:
    """Shift table and buckets of the patterns of one length."""

    def __init__(self, least: int, passages: dict[tuple, list], base: int):
        self.least, self.block, self.base = least, min(SUFFIX, least), base
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, list] = defaultdict(list)
        for passage, owners in passages.items():
            for end in range(self.block - 1, least):
                h = self._hash(passage, end)
                move = least - 1 - end
                if move < self.shift.get(h, least):
                    self.shift[h] = move
            self.buckets[self._hash(passage, least - 1)].append((passage, owners))

    def _hash(self, ids, end: int) -> int:
        h = 0
        for i in range(end - self.block + 1, end + 1):
            h = h * self.base + ids[i]
        return h

    def find(self, ids: list[int], found: set[int]) -> None:
        least, block, base = self.least, self.block, self.base
        at, n, free = least - 1, len(ids), least - block + 1
        while at < n:
            h, i = 0, at
            while i > at - block:
                if ids[i] < 0:
                    break
                i -= 1
            if i > at - block:
                # no passage has this word: the window starts behind it
                at = i + least
                continue
            for i in range(at - block + 1, at + 1):
                h = h * base + ids[i]
            move = self.shift.get(h, free)
            if move:
                at += move
                continue
            window = tuple(ids[at - least + 1 : at + 1])
            for passage, owners in self.buckets[h]:
                if passage == window:
                    found.update(owners)
            at += 1


def find_leaks(docs: DataFrame, items: DataFrame, *, doc_id: str, doc_text: str, item_id: str, item_text: str, least: int = 12, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """All (item, document) where the document holds at least ``least`` consecutive words of the item, or all of a shorter one.

    Letter case, accents, width, punctuation, markup, invisible characters, line layout and words broken at a line's end
    make no difference (see ``text.words``). Result: ``item_id``, ``doc_id`` under their own names, each pair once for
    each row of the document.

    Defined cases: null and empty texts hold nothing, and an item without a word is in no document; null ids take no part; extra
    columns are not read; empty tables give an empty result.

    Plan: no shuffle. The items are a test set; they reach the tasks in blocks of about ``block_chars`` characters, each with
    a pass over the documents, so that the tables in memory stay bounded (about 0.3 kB a character and worker). Documents
    are read whole.
    """
    own = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).dropna().where(F.length("t") > 0)
    kinds = (items.schema[item_id].dataType.simpleString(), docs.schema[doc_id].dataType.simpleString())
    texts = docs.select(F.col(doc_id).alias("d"), F.col(doc_text).alias("t")).dropna().where(F.length("t") > 0)
    chars = own.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-chars // block_chars) or 1
    spark, result = docs.sparkSession, None
    for b in range(blocks):
        part = own if blocks == 1 else own.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        given = spark.sparkContext.broadcast([(r["i"], r["t"]) for r in part.collect()])

        def search(batches, given=given):
            table = PassageSearch(given.value, least)
            for rows in batches:
                found = [(i, d) for d, t in zip(rows["d"], rows["t"], strict=True) for i in table.find(t)]
                yield pd.DataFrame(found, columns=["i", "d"])

        out = texts.mapInPandas(search, f"i {kinds[0]}, d {kinds[1]}")
        result = out if result is None else result.unionByName(out)
    return result.select(F.col("i").alias(item_id), F.col("d").alias(doc_id))
