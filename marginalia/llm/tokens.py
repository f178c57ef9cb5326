"""Token ids of whole texts by the tokenizers library, with a bounded cache of chunk encodings.

Both vocabularies cut a text at white space before any merge, so the ids of a text are the ids of its
space-separated chunks in order. Each distinct chunk is encoded once per worker, by the library. The few texts in which a
run of white space crosses a chunk border, or which hold a reserved string, are encoded in one piece.
"""

from __future__ import annotations

import os
import re
import sys
import types
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTE_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"

#: How the byte-level vocabulary cuts a text (fixed by its tokenizer).
_SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Beyond the letters whose lower case does not depend on the library's normalizer.
_OTHER = re.compile("[^\0-\u024f]")
_ACROSS = re.compile(r"\s \s|\s \Z")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """``encode(text)``: packed little-endian 32-bit ids. Its caches hold at most twice ``limit`` chunks and parts of chunks."""

    def __init__(self, path: str, limit: int = 200_000):
        import json

        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        cut = json.loads(self.tokenizer.to_str())["pre_tokenizer"]
        self.spaced = cut["type"] == "ByteLevel"  # a chunk keeps the space before it
        self.cut = regex.compile(_SPACED if self.spaced else cut["pretokenizers"][0]["pattern"]["Regex"])
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        some = [*range(0x800), *range(0x800, 0x11000, 0x800), *range(0x10000, 0x110000, 0x10000)]
        spelt = {}  # how the library spells bytes, read off characters that hold all bytes of UTF-8
        for c in (chr(i) for i in some if not 0xD800 <= i < 0xE000):
            spelt.update(zip(c.encode(), letters.pre_tokenize_str(c)[0][0]))
        self.letters = spelt
        class Kept(dict):
            """Two generations: what is asked for again lives on, the rest goes when the younger one is full."""

            def __init__(self, make):
                self.make, self.old = make, {}

            def __missing__(self, key: str) -> bytes:
                got = self.old.get(key)
                if got is None:
                    got = self.make(key)
                if len(self) >= limit:
                    self.old = dict(self)
                    self.clear()
                self[key] = got
                return got

        self.parts, self.lowered = Kept(self.part), Kept(self.low)
        self.cache = Kept(self.chunk)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def part(self, part: str) -> bytes:
        """Ids of a part of a chunk, by the library's merges."""
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(self.letters)
        elif not part.isalpha():  # ASCII letters are spelt as themselves
            part = part.translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()

    def low(self, chunk: str) -> bytes:
        """Ids of a chunk that the normalizer has been over."""
        if chunk.isalpha():
            return self.part(chunk)
        if chunk[:-1].isalpha() and chunk[-1] in ".,":
            return self.lowered[chunk[:-1]] + self.parts[chunk[-1]]
        return b"".join(map(self.parts.__getitem__, self.cut.findall(chunk)))

    def chunk(self, chunk: str) -> bytes:
        """Ids of a chunk from those of its parts."""
        if not self.spaced:
            # Latin letters are composed and have simple lower case; anything else goes through the library
            return self.lowered[chunk.lower() if chunk.isascii() or max(chunk) < "\u0250" else self.tokenizer.normalizer.normalize_str(chunk)]
        elif chunk[1:].isalpha() and chunk[0] == " ":
            return self.parts[chunk]
        elif chunk[1:-1].isalpha() and chunk[0] == " " and chunk[-1] in ".,":
            return self.parts[chunk[:-1]] + self.parts[chunk[-1]]
        return b"".join(map(self.parts.__getitem__, self.cut.findall(chunk)))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if "<|" in text or "\0" in text:
            return self.whole(text)
        find = self.cache.__getitem__
        if not self.spaced:
            return b"".join(map(find, text.replace("\n", " ").split(" ")))  # no id of this vocabulary holds white space
        if _ACROSS.search(text):
            return self.whole(text)
        chunks = text.replace(" ", "\0 ").split("\0")
        return b"".join(map(find, chunks if chunks[0] else chunks[1:]))

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """``encode`` of every text (null: empty). Arrow cuts the texts and finds their distinct chunks, so that each is looked up once."""
        if self.spaced:
            return [self.encode(t or "") for t in texts.to_pylist()]
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring(texts, "\0"))
        cut = pc.split_pattern(pc.replace_substring(pc.if_else(odd, "", texts), "\n", " "), " ")
        ends, chunks = cut.offsets.to_numpy(), cut.values.dictionary_encode()
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(chunks.dictionary)], chunks.dictionary), " ")[0].as_py()
        if _OTHER.search(joined):
            found = map(self.cache.__getitem__, joined.split(" "))
        else:
            found = map(self.lowered.__getitem__, joined.lower().split(" "))
        known = pa.array(list(found)[: len(chunks.dictionary)], pa.large_binary())
        ids = known.take(chunks.indices)
        _, bounds, data = ids.buffers()
        at = np.frombuffer(bounds, np.int64)[ids.offset :][ends].tolist() if len(ids) else [0] * len(ends)
        whole = memoryview(data) if data else b""
        made = [bytes(whole[a:b]) for a, b in zip(at, at[1:])]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            made[i] = self.encode(texts[i].as_py())
        return made


def encoder(name: str) -> Encoder:
    """This worker's encoder for a vocabulary file name or path.

    Task functions travel by value, so their module is new in every task; the cache is kept where a worker process keeps it.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    kept = sys.modules.setdefault("marginalia_worker_cache", types.ModuleType("marginalia_worker_cache")).__dict__
    key = f"{name} {os.getpid()}"
    if key not in kept:
        kept[key] = Encoder(name if os.path.sep in name else vocabulary(name))
    return kept[key]


def forget() -> None:
    """Empty this worker's caches of chunks, and give back what Arrow holds unused: Spark uses a worker again, and tasks that do not tokenize
    need that memory for themselves."""
    kept = sys.modules.get("marginalia_worker_cache")
    for one in (x for k, x in vars(kept).items() if not k.startswith("__")) if kept else ():
        for cache in (one.cache, one.lowered, one.parts):
            cache.clear()
            cache.old = {}
    pa.default_memory_pool().release_unused()
