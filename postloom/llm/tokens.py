"""Ids of whole texts by a public tokenizer, a word at a time.

The tokenizer drops white space and never merges across it, so a text's ids are those of its
words. Each distinct word of a batch is looked up once; words are cut into the tokenizer's own
pre-tokens, and its byte-pair model runs once for each new one. Words with anything but
printable ASCII and Latin-1 letters go to the tokenizer as they are.
"""

from __future__ import annotations

import re
import struct
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from postloom.llm.words import give_back, ragged, slices

# Fixed values of the tokenizer's file: its pre-token pattern for the letters handled here,
# and the printable stand-ins of bytes.
LETTERS = "a-zß-öø-ÿ"
PRE_TOKENS = f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9\\n]+|\\n"
PLAIN = "[!-~À-ÖØ-öø-ÿ]*"
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
ID_BYTES = 4
# Pre-tokens one Python worker remembers, about 200 bytes each; those of one slice always fit.
REMEMBERED = 300_000


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _shared(path: str) -> dict:
    """State of this Python process, which runs many tasks one after the other."""
    holder = sys.modules.setdefault("_postloom_worker", types.ModuleType("_postloom_worker"))
    return holder.__dict__.setdefault(path, {})


class WordIds:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        state = _shared(path)
        if not state:
            state["tokenizer"] = Tokenizer.from_file(path)
            state["known"] = {}
        self.tokenizer = state["tokenizer"]
        self.model = self.tokenizer.model
        self.known = state["known"]
        self.cut = re.compile(PRE_TOKENS).findall
        hidden = iter(range(256, 512))
        self.shown = {b: chr(b) if b in SHOWN else chr(next(hidden)) for b in range(256)}

    def _learn(self, parts: list[str]) -> None:
        new = set(parts).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set(parts)
        for part in new:
            text = part if part.isascii() else part.encode().decode("latin-1").translate(self.shown)
            self.known[part] = packed([t.id for t in self.model.tokenize(text)])
        self.known["\n"] = b""

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word, one after the other, and how many each has.

        The plain words are cut in one go, a line each; the empty ids of a line's end mark
        where a word ends.
        """
        plain = pc.match_substring_regex(words, f"^{PLAIN}$")
        plain = pc.and_not(plain, pc.match_substring(words, "<|"))
        lines = "".join(w + "\n" for w in words.filter(plain).to_pylist())
        parts = self.cut(lines.lower())
        self._learn(parts)
        found = list(map(self.known.__getitem__, parts))
        flat = np.frombuffer(b"".join(found), "<u4")
        upto = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // ID_BYTES)
        ends = upto[np.fromiter((part == "\n" for part in parts), bool, len(parts))]
        plain = plain.to_numpy(zero_copy_only=False)
        sizes = np.zeros(len(words), np.int64)
        sizes[plain] = np.diff(ends, prepend=0)
        if plain.all():
            return flat, sizes
        others = words.filter(pa.array(~plain)).to_pylist()
        others = [packed(self.tokenizer.encode(w, add_special_tokens=False).ids) for w in others]
        sizes[~plain] = np.fromiter(map(len, others), np.int64, len(others)) // ID_BYTES
        out = np.empty(int(sizes.sum()), np.uint32)
        mine = np.repeat(plain, sizes)
        out[mine] = flat
        out[~mine] = np.frombuffer(b"".join(others), "<u4")
        return out, sizes

    def batch(self, texts: pa.Array, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with the id ``last`` after each, and where each text's begin."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        split = split.cast(pa.large_list(pa.large_string()))
        words = split.flatten().dictionary_encode()
        flat, sizes = self.words(words.dictionary)
        begins = np.cumsum(sizes) - sizes
        index = words.indices.to_numpy(zero_copy_only=False)
        ids = flat[ragged(begins[index], sizes[index])]
        # words before each text, then ids before each text, then one more id per text
        counts = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
        before = np.concatenate([[0], np.cumsum(sizes[index])])[np.concatenate([[0], np.cumsum(counts)])]
        out = np.full(len(ids) + len(texts), last, np.uint32)
        body = np.ones(len(out), dtype=bool)
        ends = before[1:] + np.arange(len(texts))
        body[ends] = False
        out[body] = ids
        return out, np.concatenate([[0], ends + 1])


def id_batches(path: str, last: int):
    """Runs over Arrow batches with a ``text`` column: (part of the batch, ids, begins)."""

    def run(batches):
        encoder = WordIds(path)
        for batch in batches:
            for part in slices(batch):
                yield part, *encoder.batch(part.column("text"), last)
        give_back()

    return run
