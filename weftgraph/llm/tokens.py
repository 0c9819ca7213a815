"""Token counts (operator 2): batch encoding that returns lengths only."""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import byte_slices, table, text_of

#: Before a single blank between two other characters a byte-level pre-tokenizer always begins a new piece, and no
#: special string holds a blank there, so a text can be cut at these places.
SAFE = re.compile(r"(?<=\S)(?= \S)")
UNSAFE = re.compile(r"\s[ ]|[ ]\s|^[ ]|[ ]$")
BATCH_BYTES = 1 << 16
CACHED, LONGEST_CACHED = 1 << 19, 64
"""Pieces whose ids a worker keeps, and the most characters of one of them."""
PATH = "byte_bpe_50k.json"


LONG = 1 << 16
"""Characters of a part that the core of Encoder(core=True) gets at most; what can't be cut so goes to the library."""
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_path(name: str = PATH) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def batches_of(pieces: list[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Runs of pieces of about ``limit`` bytes; a longer piece is a run of its own."""
    run, held = [], 0
    for piece in pieces:
        n = len(piece.encode())
        if run and held + n > limit:
            yield run
            run, held = [], 0
        run.append(piece)
        held += n
    if run:
        yield run


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def cut(text: str, limit: int = LONG) -> Iterator[str]:
    """Parts of at most ``limit`` characters, cut at safe boundaries; one without such a boundary is longer."""
    start = 0
    while len(text) - start > limit:
        end = start + limit
        while (end := text.rfind(" ", start + 1, end)) > 0 and not SAFE.match(text, end):
            pass
        if end < 0:
            found = SAFE.search(text, start + limit)
            if not found:
                break
            end = found.start()
        yield text[start:end]
        start = end
    yield text[start:]


class Encoder:
    """Ids as the tokenizers library gives them, without added special tokens.

    Texts are cut at safe boundaries where the file's pre-tokenizer has such (byte-level, and nothing changes the text
    before it). The distinct pieces of a batch that aren't known yet go to the library, laid end to end in runs balanced
    by bytes, as each is cut where the library itself begins anew; ids of short pieces are kept for the batches to come.
    With any other file whole texts go to the library.

    A piece is known by its text without the blank in front; one that begins its text has a blank put there instead.

    core: parts of texts, cut at safe boundaries, are merged by tiktoken's core over the file's own vocabulary, whose ids
    are the same (a test compares them over every code point) at three times the speed. Only files for which that is so
    have it, and a part of more than LONG characters goes to the library.
    """

    def __init__(self, path: str, core: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        pre, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"]
        self.cuts = self.cuts and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or " " in x["content"] for x in added)
        self.kept: dict[str, bytes] = {}
        self.core = None
        if core and self.cuts and spec["model"]["type"] == "BPE" and not spec["model"]["ignore_merges"]:
            import tiktoken

            special = {x["content"]: x["id"] for x in added}
            alphabet = byte_alphabet()
            ranks = {bytes(alphabet[c] for c in x): i for x, i in self.tokenizer.get_vocab().items() if x not in special}
            self.core = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        if self.cuts:  # how many bytes an id stands for
            self.bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
            for token, i in self.tokenizer.get_vocab().items():
                self.bytes[i] = len(token)
            for x in added:
                self.bytes[x["id"]] = len(x["content"].encode())

    def pieces(self, text: str) -> list[str]:
        """Names of the pieces of a text."""
        if not self.cuts:
            return [text]
        if not UNSAFE.search(text):
            found = text.split(" ")
            found[0] = " " + found[0]
            return found
        first, *rest = SAFE.split(text)
        return [" " + first, *(x[1:] for x in rest)]

    def _encode(self, names: set[str]) -> dict[str, bytes]:
        """Little-endian unsigned 32-bit ids of each piece."""
        alone = [x for x in names if not self.cuts or x[0] == " " or x[-1].isspace()]
        found = {}
        for run in batches_of(alone):
            for name, one in zip(run, self.tokenizer.encode_batch_fast([self._text(x) for x in run], add_special_tokens=False), strict=True):
                found[name] = np.array(one.ids, "<u4").tobytes()
        runs = list(batches_of(list(names.difference(alone))))
        for run, one in zip(runs, self.tokenizer.encode_batch_fast([" " + " ".join(x) for x in runs], add_special_tokens=False), strict=True):
            ids = np.array(one.ids, "<u4")
            ends = np.cumsum([len(x.encode()) + 1 for x in run])
            have = np.cumsum(self.bytes[ids])
            at = np.searchsorted(have, ends)
            if not np.array_equal(have[at], ends):
                raise ValueError("a piece's ids don't end with the piece")
            raw, start = ids.tobytes(), 0
            for name, end in zip(run, (4 * at + 4).tolist(), strict=True):
                found[name] = raw[start:end]
                start = end
        return found

    def _text(self, name: str) -> str:
        if not self.cuts:
            return name
        return name[1:] if name[0] == " " else " " + name

    def _each(self, texts: list[str], join) -> list:
        """join() of an iterator over the ids of each text's pieces."""
        parts = [self.pieces(x) for x in texts]
        distinct = set().union(*parts)
        if len(self.kept) + len(distinct) > CACHED:
            self.kept.clear()
        new = distinct - self.kept.keys()
        self.kept |= self._encode(new)
        out = [join(map(self.kept.__getitem__, x)) for x in parts]
        for x in new:
            if len(x) > LONGEST_CACHED:
                del self.kept[x]
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """Of each text, as little-endian unsigned 32-bit integers."""
        return self._each(texts, b"".join) if self.core is None else [b"".join(map(self._by_core, cut(x))) for x in texts]

    def _by_core(self, part: str) -> bytes:
        if len(part) > LONG:
            return np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()
        return self.core.encode_to_numpy(part, allowed_special="all").astype("<u4", copy=False).tobytes()

    def lengths(self, texts: list[str]) -> list[int]:
        """A number of ids per text."""
        return self._each(texts, lambda found: sum(map(len, found)) // 4)


@functools.lru_cache(maxsize=4)
def encoder(path: str, core: bool = False) -> Encoder:
    """One for each Python worker; it stays between tasks."""
    return Encoder(path, core)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = 512) -> DataFrame:
    """One row per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Whole texts, no added special tokens; a special string inside a text becomes the special token, as the library has it.
    Null and empty texts: 0 bytes, 0 tokens. Null ids and repeated rows stay as they are; other columns are not read.
    """
    path = tokenizer or tokenizer_path()
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(path)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                texts = text_of(part)
                n = tok.lengths(texts)
                yield pa.record_batch(
                    [part.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select(docs[id_col], docs[text_col].alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
