"""Evaluation texts leaking into training text.

Method: a generalised suffix automaton over the words of the normalised test items. Each training
document is streamed through it once; at every word the automaton gives the length of the longest
run of words that ends there and occurs in some item, and the items it occurs in. Runs of at least
`min_words` words are leaks; the spans they cover are removed, and a document whose leaked share of
words reaches `max_share` is dropped as a whole.

The automaton is broadcast. It consists of arrays, below 100 bytes for each word of the items, and holds at
most `max_item_words` words; larger item sets are cut into parts of whole items, which are streamed
over the corpus one after another, each broadcast given up before the next one is built.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorefold.functions.text import WORD, words_py
from lorefold.session import materialise

MIN_WORDS, MAX_SHARE, MAX_ITEM_WORDS = 13, 0.5, 1_000_000


class SuffixAutomaton:
    """Generalised suffix automaton over integer symbols. A state's first transition stands in two arrays,
    and only states with several have a dictionary of the others."""

    def __init__(self) -> None:
        self.symbol, self.target, self.link, self.length = (array("i", [x]) for x in (-1, -1, -1, 0))
        self.more: dict[int, dict[int, int]] = {}
        # items of the states from min_words on: those of state v are items[first[v] : first[v + 1]]
        self.first, self.items = array("i"), array("i")
        # for each state the nearest one up its links, itself included, where a short item ends; its items and lengths
        self.short: dict[int, list[tuple[int, int]]] = {}
        self.short_up = array("i")

    def step(self, v: int, c: int) -> int:
        """The state behind symbol c, -1 if there is none."""
        if self.symbol[v] == c:
            return self.target[v]
        others = self.more.get(v)
        return others.get(c, -1) if others else -1

    def _set(self, v: int, c: int, w: int) -> None:
        if self.symbol[v] in (-1, c):
            self.symbol[v], self.target[v] = c, w
        else:
            self.more.setdefault(v, {})[c] = w

    def _state(self, length: int, link: int, like: int = -1) -> int:
        v = len(self.length)
        self.length.append(length)
        self.link.append(link)
        self.symbol.append(self.symbol[like] if like >= 0 else -1)
        self.target.append(self.target[like] if like >= 0 else -1)
        if like in self.more:
            self.more[v] = dict(self.more[like])
        return v

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], q)
        self.link[q] = clone
        while p >= 0 and self.step(p, c) == q:
            self._set(p, c, clone)
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.step(last, c)
        if q >= 0:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        cur = self._state(self.length[last] + 1, 0)
        p = last
        while p >= 0 and self.step(p, c) < 0:
            self._set(p, c, cur)
            p = self.link[p]
        if p >= 0:
            q = self.step(p, c)
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return cur

    def add(self, symbols: Iterable[int]) -> None:
        last = 0
        for c in symbols:
            last = self._extend(last, c)

    def mark(self, sequences: list[array], min_words: int, whole_short: bool) -> None:
        """Give every state of min_words words or more the items (their places in `sequences`) that contain its
        strings: walk each item's prefixes and climb the suffix links until a state that already has the
        item. With whole_short, items of fewer words are noted where they end."""
        last = array("i", [-1]) * len(self.length)
        states = array("i")
        for item, symbols in enumerate(sequences):
            v = 0
            for c in symbols:
                v = self.step(v, c)
                u = v
                while u > 0 and self.length[u] >= min_words and last[u] != item:
                    last[u] = item
                    states.append(u)
                    self.items.append(item)
                    u = self.link[u]
            if whole_short and 0 < len(symbols) < min_words:
                self.short.setdefault(v, []).append((item, len(symbols)))
        by = np.argsort(np.frombuffer(states, np.int32), kind="stable") if states else np.empty(0, np.int64)
        counts = np.bincount(np.frombuffer(states, np.int32), minlength=len(self.length)) if states else np.zeros(len(self.length), np.int64)
        self.items = array("i", np.frombuffer(self.items, np.int32)[by].tobytes()) if states else array("i")
        self.first = array("i", np.concatenate([[0], np.cumsum(counts)]).astype(np.int32).tobytes())
        if self.short:
            self.short_up = array("i", [-1]) * len(self.length)
            for v in np.argsort(np.frombuffer(self.length, np.int32), kind="stable").tolist():
                self.short_up[v] = v if v in self.short else self.short_up[self.link[v]] if v else -1


@dataclass
class Matcher:
    """Test items as they are broadcast: their ids, their vocabulary and its automaton."""

    ids: list
    vocabulary: dict[str, int]
    automaton: SuffixAutomaton

    def runs(self, words: list[str], min_words: int) -> tuple[list[tuple[int, int]], dict[int, int]]:
        """(merged spans [from, to) of words that lie in a run of at least min_words words of an
        item, or in a whole short one; the longest such run by item id)."""
        a = self.automaton
        symbol, target, more, link, length, first, items = a.symbol, a.target, a.more, a.link, a.length, a.first, a.items
        spans: list[tuple[int, int]] = []
        longest: dict[int, int] = {}

        def leaked(item: int, words_of: int, end: int) -> None:
            if longest.get(item, 0) < words_of:
                longest[item] = words_of
            start = end - words_of
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append((start, end))

        v = n = 0
        for i, c in enumerate(map(self.vocabulary.get, words)):
            if c is None:
                v = n = 0
                continue
            while True:
                if symbol[v] == c:
                    v, n = target[v], n + 1
                    break
                others = more.get(v)
                if others is not None and c in others:
                    v, n = others[c], n + 1
                    break
                if not v:
                    n = 0
                    break
                v = link[v]
                n = length[v]
            if n >= min_words:
                u, reached = v, n
                while u > 0 and reached >= min_words:
                    for k in range(first[u], first[u + 1]):
                        leaked(items[k], reached, i + 1)
                    u = link[u]
                    reached = length[u]
            if a.short:
                u = a.short_up[v]
                while u > 0:
                    for item, size in a.short[u]:
                        if size <= (n if u == v else length[u]):
                            leaked(item, size, i + 1)
                    u = a.short_up[link[u]]
        return spans, {self.ids[k]: x for k, x in longest.items()}


def build_matcher(passages: list[tuple[int, str]], min_words: int = MIN_WORDS, max_item_words: int = MAX_ITEM_WORDS, whole_short: bool = False) -> Matcher:
    """Automaton of the items with at least min_words words, and of the others if whole_short."""
    vocabulary: dict[str, int] = {}
    ids, sequences = [], []
    total = 0
    for item, passage in passages:
        words = words_py(passage or "")
        if len(words) >= min_words or (whole_short and words):
            total += len(words)
            if total > max_item_words:
                raise ValueError("too many item words for one automaton; use automata()")
            ids.append(item)
            sequences.append(array("i", (vocabulary.setdefault(w, len(vocabulary)) for w in words)))
    a = SuffixAutomaton()
    for symbols in sequences:
        a.add(symbols)
    a.mark(sequences, min_words, whole_short)
    return Matcher(ids, vocabulary, a)


def automata(items: DataFrame, item_id: str = "eval_id", passage: str = "passage", min_words: int = MIN_WORDS, max_item_words: int = MAX_ITEM_WORDS, whole_short: bool = False) -> Iterator[Matcher]:
    """Matchers over all items, as many as the bound on the words of one automaton asks for; one is in
    the driver's memory at a time. A single item beyond the bound is refused."""
    part: list[tuple[int, str]] = []
    total = 0
    for r in items.select(F.col(item_id).alias("i"), F.col(passage).alias("p")).where("i is not null and p is not null").toLocalIterator():
        n = len(words_py(r.p))
        if part and total + n > max_item_words:
            yield build_matcher(part, min_words, max_item_words, whole_short)
            part, total = [], 0
        part.append((r.i, r.p))
        total += n
    yield build_matcher(part, min_words, max_item_words, whole_short)


def leaks(
    docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", item_id: str = "eval_id", passage: str = "passage", whole_short: bool = False, max_item_words: int = MAX_ITEM_WORDS
) -> DataFrame:
    """(doc_id, eval_id, words): the documents with a run of at least min_words consecutive words
    of the item's passage, and the longest such run.

    Null and empty texts have no leaks; whole texts are read, of any length. Repeated rows of a
    document give one row. A passage shorter than min_words is found, as a whole, only with
    whole_short. Empty tables give an empty result. Only the two named columns of each table are read."""
    kind, item_kind = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("d is not null and t is not null")
    parts: list[DataFrame] = []
    for matcher, last in _with_last(automata(items, item_id, passage, min_words, max_item_words, whole_short)):
        shared = docs.sparkSession.sparkContext.broadcast(matcher)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            m = shared.value
            for b in batches:
                out = [(d, e, n) for d, t in zip(b["d"], b["t"]) for e, n in m.runs([w.lower() for w in WORD.findall(t)], min_words)[1].items()]
                yield pd.DataFrame(out, columns=["doc_id", "eval_id", "words"])

        part = rows.mapInPandas(run, f"doc_id {kind}, eval_id {item_kind}, words int")
        if not last:  # one automaton is broadcast at a time
            part = materialise(part, "leaks")
            shared.destroy()
        parts.append(part)
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id", "eval_id").agg(F.max("words").alias("words"))


def _with_last(matchers: Iterator[Matcher]) -> Iterator[tuple[Matcher, bool]]:
    """Each matcher and whether it is the last one."""
    current = next(matchers)
    for following in matchers:
        yield current, False
        current = following
    yield current, True


def cut(text: str | None, spans: list[int], max_share: float) -> tuple[int, int, bool, str | None]:
    """(words, leaked words, dropped, text without them) for spans of words as from, to, from, to ..."""
    if text is None:
        return 0, 0, False, None
    at = list(WORD.finditer(text))
    hit = np.zeros(len(at) + 1, np.int8)
    for lo, hi in zip(spans[::2], spans[1::2]):
        hit[lo:hi] = 1
    n = int(hit.sum())
    if n and n >= max_share * len(at):
        return len(at), n, True, None
    edges = np.flatnonzero(np.diff(np.r_[0, hit])).tolist()  # where leaked runs begin and end
    out, end = [], 0
    for lo, hi in zip(edges[::2], edges[1::2]):
        out.append(text[end : at[lo].start()])
        end = at[hi - 1].end()
    return len(at), n, False, "".join(out) + text[end:]


def without_leaks(
    docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, max_share: float = MAX_SHARE, doc_id: str = "doc_id", text: str = "text", item_id: str = "eval_id", passage: str = "passage", whole_short: bool = False, max_item_words: int = MAX_ITEM_WORDS
) -> DataFrame:
    """(doc_id, n_words, leaked_words, dropped, text): every row of docs; leaked spans are cut out of
    the text, and a document is dropped (text null) if they cover max_share of its words or more.
    Null texts come back as null with no words. Rows are kept as they are, repeats included. Where the items
    need several automata, the spans found so far are written beside the texts between them."""
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"), F.array().cast("array<int>").alias("spans"))
    for matcher, last in _with_last(automata(items, item_id, passage, min_words, max_item_words, whole_short)):
        shared = docs.sparkSession.sparkContext.broadcast(matcher)

        def run(batches: Iterator[pd.DataFrame], shared=shared, last=last) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for d, t, spans in zip(b["d"], b["t"], b["spans"]):
                    found = shared.value.runs([w.lower() for w in WORD.findall(t)], min_words)[0] if t else []
                    spans = [*spans, *(x for span in found for x in span)]
                    out.append((d, *cut(t, spans, max_share)) if last else (d, t, spans))
                yield pd.DataFrame(out, columns=["doc_id", "n_words", "leaked_words", "dropped", "text"] if last else ["d", "t", "spans"])

        rows = rows.mapInPandas(run, f"doc_id {kind}, n_words int, leaked_words int, dropped boolean, text string" if last else f"d {kind}, t string, spans array<int>")
        if not last:
            rows = materialise(rows, "leaks")
            shared.destroy()
    return rows
