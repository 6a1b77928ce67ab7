"""Whole-text encoding with a tokenizers vocabulary file, one word at a time.

Byte-level BPE never merges across a single space between visible characters,
so a text is the concatenation of its space-led words.  A batch of texts is
split and dictionary-encoded by Arrow, each distinct word is encoded once by
the tokenizers library, and the ids are gathered by NumPy.  Where words are not
independent (another kind of tokenizer, runs of white space with a space in
them, other white space than spaces and line feeds) the library gets the whole
text.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space but for spaces and line feeds.
_ODD = re.compile(r"[^\S \n]")
_ODD_ASCII = re.compile("[\t\x0b\x0c\r\x1c-\x1f]")
_TORN = False


class Encoder:
    """ids of whole texts, as little-endian unsigned 32-bit integers.

    Strings of special tokens in a text are ordinary text.  ``cached_words``
    bounds the memory of the word tables, not what is encoded: a full table
    becomes the old one, from which words in use move on to the new.
    """

    def __init__(self, path: str, cached_words: int = 250_000):
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = spec.get("normalizer") is None and spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        self._most = cached_words
        self._tables: dict[str, dict[str, bytes | bool]] = {" ": {}, "": {}}
        self._old: dict[str, dict[str, bytes | bool]] = {" ": {}, "": {}}
        self._space_led = np.zeros(self._tokenizer.get_vocab_size(), bool)
        self._space_led[[k for token, k in self._tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True
        self._parts = {mark: self.encode_whole(mark) for mark in "\n,.;:!?"}

    def encode_whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        return self.encode_texts(pa.array([text], pa.large_string()))[0]

    def encode_texts(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; a null text is an empty one."""
        collecting = gc.isenabled()
        gc.disable()  # many small objects, no cycles
        try:
            return self._encode_texts(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode_texts(self, texts: pa.Array) -> list[bytes]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_word:
            return [self.encode_whole(t) for t in texts.to_pylist()]
        if not len(texts):
            return []
        split = pc.split_pattern(texts, " ")
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        words = split.flatten()
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        values = self._values(distinct, " ") + self._values(words.take(pa.array(bounds[:-1])).to_pylist(), "")
        codes = coded.indices.to_numpy().astype(np.int64)
        codes[bounds[:-1]] = len(distinct) + np.arange(len(texts))
        torn = np.fromiter((v is _TORN for v in values), bool, len(values))
        whole = np.logical_or.reduceat(torn[codes], bounds[:-1]) if torn.any() else np.zeros(len(texts), bool)
        values = [v or b"" for v in values]
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        ids = np.frombuffer(b"".join(values), "<u4")
        counts = sizes[codes]
        ends = np.cumsum(counts)
        gathered = ids[np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - counts), counts) + np.arange(ends[-1])]
        doc_ends = ends[bounds[1:] - 1]
        out = [gathered[a:b].tobytes() for a, b in zip([0, *doc_ends[:-1].tolist()], doc_ends.tolist())]
        for k in np.flatnonzero(whole).tolist():
            out[k] = self.encode_whole(texts[k].as_py())
        return out

    def _encoded(self, words: list[str], prefix: str) -> list[bytes]:
        """Each of some new words, encoded by the library.

        Space-led words of letters go in many to a text: each begins with the
        only one of its ids whose token begins with a space.
        """
        out: list[bytes | None] = [None] * len(words)
        letters = [k for k, w in enumerate(words) if prefix and w.isalpha()]
        texts = [" " + " ".join([words[k] for k in letters[a : a + 256]]) for a in range(0, len(letters), 256)]
        for a, done in zip(range(0, len(letters), 256), self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids, group = np.array(done.ids, "<u4"), letters[a : a + 256]
            cuts = np.flatnonzero(self._space_led[ids]).tolist()
            if len(cuts) == len(group):
                data = ids.tobytes()
                for k, start, stop in zip(group, cuts, [*cuts[1:], len(ids)]):
                    out[k] = data[4 * start : 4 * stop]
        rest = [k for k, v in enumerate(out) if v is None]
        for k, done in zip(rest, self._tokenizer.encode_batch_fast([prefix + words[k] for k in rest], add_special_tokens=False)):
            out[k] = array("I", done.ids).tobytes()
        return out

    def _values(self, words: list[str], prefix: str) -> list[bytes | bool]:
        """Encoded ``prefix + word`` for each word; False if it depends on what stands beside it."""
        table = self._tables[prefix]
        if len(table) > self._most:
            self._old[prefix], table = table, {}
            self._tables[prefix] = table
        values, old, encoded = list(map(table.get, words)), self._old[prefix], self._parts
        missing = [k for k, v in enumerate(values) if v is None]
        names = [words[k] for k in missing]
        kept = list(map(old.get, names))
        table.update([(w, v) for w, v in zip(names, kept) if v is not None])
        for k, v in zip(missing, kept):
            values[k] = v
        plain, halves = [], []
        for k in [k for k, v in zip(missing, kept) if v is None]:
            word = words[k]
            if word.isalpha():
                plain.append(k)
                continue
            if word[-1:] in encoded and word[:-1].isalpha():  # a mark after letters is a token of its own
                halves.append((k, word[:-1], word[-1], None))
                continue
            at = word.find("\n")
            if prefix and (not word or at == 0) or not word.isascii() and _ODD.search(word) or _ODD_ASCII.search(word):
                values[k] = table[word] = _TORN
            elif 0 < at < len(word) - 1 and word.find("\n", at + 1) < 0:
                halves.append((k, word[:at], "\n", word[at + 1 :]))  # two words at a line's end
            else:
                plain.append(k)
        for k, done in zip(plain, self._encoded([words[k] for k in plain], prefix)):
            values[k] = done
            if len(words[k]) <= 64:
                table[words[k]] = values[k]
        if halves:
            heads = self._values([x[1] for x in halves], prefix)
            tails = iter(self._values([x[3] for x in halves if x[3] is not None], ""))
            for (k, _, mark, tail), head in zip(halves, heads):
                values[k] = head + encoded[mark] + (b"" if tail is None else next(tails))
        return values


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    return Encoder(path)
