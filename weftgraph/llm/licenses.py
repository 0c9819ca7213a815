"""License scans (operator 4): patience alignment of passages with licence texts and notices.

A passage names a licence if enough of the form is aligned and the words that tell licences apart are: all of the form's
own have to be aligned, and between the aligned ones of a notice no others may stand. So a licence that isn't known, or
another version of one that is, stays unnamed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import byte_slices, table, text_of
from .license_texts import FREQUENT, FULL, TELLING, notices

WORD = re.compile(r"\w+")
NEXT_PART = re.compile(r"\.\d")
LEAST_COVERAGE = 0.8


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def patience(a: list, b: list, a0: int = 0, b0: int = 0) -> list[tuple[int, int]]:
    """Matched places of a and b, ascending in both.

    Words that are unique in both are anchors; the longest increasing run of them stands, and each gap between two
    anchors is aligned in the same way. A gap without such words is matched from its ends inwards.
    """
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            found.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            found.append((j, m))
        if i >= j or k >= m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        place = {w: p for p, w in enumerate(b[k:m], k) if in_b[w] == 1 and in_a.get(w) == 1}
        pairs = [(p, place[w]) for p, w in enumerate(a[i:j], i) if w in place]
        tails: list[int] = []
        last: list[int] = []
        back: list[int] = []
        for n, (_, q) in enumerate(pairs):
            at = bisect_left(tails, q)
            back.append(last[at - 1] if at else -1)
            if at == len(tails):
                tails.append(q)
                last.append(n)
            else:
                tails[at], last[at] = q, n
        run, n = [], last[-1] if last else -1
        while n >= 0:
            run.append(pairs[n])
            n = back[n]
        run.reverse()
        found += run
        if run:
            edges = [(i - 1, k - 1), *run, (j, m)]
            todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:], strict=False)]
    return sorted((x + a0, y + b0) for x, y in found)


class Form:
    """A licence text, or a notice: where its telling words are, and how many of its infrequent words a passage has at least."""

    def __init__(self, name: str, text: str, least: float, telling: frozenset[str] | set[str] | None):
        self.name, self.words = name, words(text)
        self.notice = telling is None
        self.telling = frozenset(i for i, w in enumerate(self.words) if w in (TELLING if telling is None else telling))
        self.marks = {w for w in self.words if w not in FREQUENT} or set(self.words)
        missing = len(self.words) - int(np.ceil(least * len(self.words)))
        self.need = max(1, sum(w in self.marks for w in self.words) - missing)
        self.early = set(self.words[: missing + 1])  # an aligned passage begins with one of them
        self.number = self.words[-1].isdigit()


class Scanner:
    """templates: texts by licence, instead of the known ones; they are taken as notices."""

    def __init__(self, templates: dict[str, list[str]] | None = None, least: float = LEAST_COVERAGE):
        self.least = least
        if templates is None:
            self.forms = [Form(name, text, least, None) for name, text in notices()]
            self.forms += [Form(name, text, least, set(telling.split())) for name, text, telling in FULL]
        else:
            self.forms = [Form(name, text, least, None) for name, texts in templates.items() for text in texts]
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for form in self.forms for w in form.words if w in form.marks))}
        self.member = np.zeros((len(self.forms), len(self.vocabulary)), bool)
        for row, form in zip(self.member, self.forms, strict=True):
            row[[self.vocabulary[w] for w in form.marks]] = True

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(licence, coverage, first word, end) of passages, where forms contend the one with most aligned words."""
        low_text, spans = text.lower(), []

        def goes_on(end: int) -> bool:
            """Whether a number's next part follows the word before ``end``, as in 2.1 after 2."""
            if not spans:
                spans.extend(m.end() for m in WORD.finditer(low_text))
            return bool(NEXT_PART.match(low_text, spans[end - 1]))

        text_words = words(text)
        get = self.vocabulary.get
        found = [(i, k) for i, w in enumerate(text_words) if (k := get(w)) is not None]
        if not found:
            return []
        at, ids = np.array(found, np.int64).T
        # per form, its words up to each place: a form with too few in all has no passage
        counts = self.member[:, ids]
        hits = []
        for k in np.flatnonzero(counts.sum(axis=1) >= [form.need for form in self.forms]).tolist():
            form = self.forms[k]
            own, n = at[counts[k]], len(form.words)
            close = np.flatnonzero(own[form.need - 1 :] - own[: len(own) - form.need + 1] < 2 * n)
            j = 0
            while j < len(close):
                last = j
                while last + 1 < len(close) and own[close[last + 1]] - own[close[last]] <= n:
                    last += 1
                low, high = max(0, int(own[close[j]]) - n), min(len(text_words), int(own[close[last] + form.need - 1]) + 1 + n)
                hits += self._passages(form, text_words, low, high, goes_on)
                j = last + 1
        hits.sort(key=lambda x: (-x[4], -x[1], x[2], x[0]))
        starts: list[int] = []
        ends: list[int] = []
        out = []
        for name, coverage, low, high, _ in hits:
            place = bisect_right(ends, low)  # taken passages don't overlap, so they end in the order they begin in
            if place == len(starts) or starts[place] >= high:
                starts.insert(place, low)
                ends.insert(place, high)
                out.append((name, coverage, low, high))
        return sorted(out, key=lambda x: x[2])

    def _passages(self, form: Form, text_words: list[str], low: int, high: int, goes_on) -> list[tuple]:
        """Alignments within [low, high): windows of twice the form, each beginning at one of its early words."""
        found, at, n = [], low, len(form.words)
        while at < high:
            while at < high and text_words[at] not in form.early:
                at += 1
            window = text_words[at : min(high, at + 2 * n)]
            if sum(w in form.marks for w in window) >= form.need:
                pairs = patience(form.words, window)
                if len(pairs) / n >= self.least and self._told(form, window, pairs) and not (form.number and goes_on(at + pairs[-1][1] + 1)):
                    found.append((form.name, len(pairs) / n, at + pairs[0][1], at + pairs[-1][1] + 1, len(pairs)))
                    at += pairs[-1][1]
            at += 1
        return found

    @staticmethod
    def _told(form: Form, window: list[str], pairs: list[tuple[int, int]]) -> bool:
        """Whether all telling words are aligned and, in a notice, no others stand between its words."""
        if not form.telling <= {i for i, _ in pairs}:
            return False
        aligned = {k for _, k in pairs}
        return not form.notice or not any(k not in aligned and window[k] in TELLING for k in range(pairs[0][1], pairs[-1][1]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """One row per passage: id, license, coverage (least to 1), start_word, end_word.

    Passages of a row don't overlap: of those that contend the one with most aligned words stands, then the one with the
    higher coverage, the earlier one and the name first in order. Null and empty texts have none, long ones are read
    whole; null ids and repeated rows are reported like others, other columns aren't read, and an empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                at, rest = [], []
                for i, text in enumerate(text_of(part)):
                    for row in scanner.scan(text):
                        at.append(i)
                        rest.append(row)
                if at:
                    cols = [pa.array(c, t) for c, t in zip(zip(*rest, strict=True), (pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True)]
                    yield pa.record_batch([part.column(0).take(pa.array(at)), *cols], names=[id_col, "license", "coverage", "start_word", "end_word"])

    return docs.select(docs[id_col], docs[text_col].alias("text")).mapInArrow(run, f"`{id_col}` {kind}, license string, coverage double, start_word long, end_word long")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
