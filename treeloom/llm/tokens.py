"""Encoding of whole texts by the tokenizers library, with a bounded cache of white-space separated units.

Pre-tokenisers of two known kinds never join characters across certain white space, so a text's ids are the joined ids
of its units.  Each distinct unit is encoded by the library once and kept in a cache of bounded size; a tokenizer of
another kind, and a text with unusual control characters, is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._shared import kept_by_workers

#: Entries of each of the two generations of a worker's cache.
CACHE_UNITS = 800_000
#: Longer units are encoded, but not kept.
LONGEST_UNIT = 200

#: Characters of texts whose units are looked up together.
JOINED_CHARS = 1 << 24

_UNITS = re.compile(r"\s+(?=\s\S)|\s+\Z|[^\S ](?=\S)| ?\S+")
#: White space that isn't a single space or line feed between other characters.
_ODD_ASCII = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c")
_ODD_OTHERS = tuple("\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


class Encoder:
    """ids of texts as bytes of little-endian unsigned integers (``dtype``).

    ``special``: strings of special tokens give their ids, as the library does unless it is told otherwise; else they
    are ordinary text.
    """

    def __init__(self, path: str, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # no unit has such a string, and looking for them takes time
        self.special = special
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind = self._kind(spec)
        added = spec.get("added_tokens") or []
        if any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
            self.kind = "whole"
        #: A text with one of these isn't cut into units.
        self.literals = [t["content"] for t in added]
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _kind(spec: dict) -> str:
        """``spaced``: a single space goes with the word after it; ``dropped``: white space only separates; ``whole``."""
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        if (spec.get("post_processor") or {}).get("type", "ByteLevel") != "ByteLevel" or spec["model"].get("type") != "BPE":
            return "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not norm:
            return "spaced"
        steps = pre.get("pretokenizers") or [{}]
        names = [n.get("type") for n in norm.get("normalizers", [])]
        split = steps[0]
        if pre.get("type") == "Sequence" and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and r"[^\s\p{L}\p{N}]+" in split["pattern"].get("Regex", "") and names == ["NFC", "Replace", "Lowercase"]:
            return "dropped"
        return "whole"

    def _bytes(self, ids) -> bytes:
        return array(self.dtype.char, ids).tobytes()

    def _whole(self, text: str) -> bytes:
        self.tokenizer.encode_special_tokens = not self.special
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        self.tokenizer.encode_special_tokens = True
        return self._bytes(ids)

    def _text(self, unit: str) -> str:
        """What a unit's name stands for: as a rule the characters with the space that was cut off before them."""
        if self.kind == "dropped" or unit[:1] == "\n":
            return unit
        return unit[1:] if unit[:1] == "\0" else " " + unit

    def _found(self, units: list[str]) -> list[bytes]:
        """Ids of distinct units.  The cache has two generations: what is used again moves to the young one."""
        if len(self.cache) > CACHE_UNITS:
            self.old, self.cache = self.cache, {}
        young, old = self.cache, self.old
        parts = list(map(young.get, units))
        missing = []
        for i in [i for i, p in enumerate(parts) if p is None]:
            unit = units[i]
            if (known := old.get(unit)) is not None:
                young[unit] = parts[i] = known
            elif unit:
                missing.append(i)
            else:
                parts[i] = b""
        for at in range(0, len(missing), 20_000):
            some = missing[at : at + 20_000]
            names = [units[i] for i in some]
            for i, unit, enc in zip(some, names, self.tokenizer.encode_batch_fast(list(map(self._text, names)), add_special_tokens=False)):
                parts[i] = found = array(self.dtype.char, enc.ids).tobytes()
                if len(unit) <= LONGEST_UNIT:
                    young[unit] = found
        return parts

    def _split(self, text: str) -> tuple[str, str]:
        """A separator and the text whose parts between separators are its units."""
        if self.kind == "dropped":
            return " ", text.replace("\n", " ")
        odd = any(c in text for c in _ODD_ASCII) or text[0] in " \n" or text[-1] in " \n" or not text.isascii() and any(c in text for c in _ODD_OTHERS)
        if odd:
            return "\x1f", "\x1f".join(["\0" + u for u in _UNITS.findall(text)])
        return " ", "\0" + text.replace("\n", " \n")

    def encode(self, text: str | None) -> bytes:
        """ids of the whole text; none for a null or empty text."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """ids of whole texts.  Units are told apart by Arrow, so a unit is looked up once for many texts."""
        out, waiting, held = [b""] * len(texts), {}, 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.kind == "whole" or any(c in text for c in "\0\x1c\x1d\x1e\x1f") or any(t in text for t in self.literals):
                out[i] = self._whole(text)
                continue
            mark, units = self._split(text)
            waiting.setdefault(mark, []).append((i, units))
            held += len(text)
            if held >= JOINED_CHARS:
                self._encode_units(waiting, out)
                waiting, held = {}, 0
        self._encode_units(waiting, out)
        return out

    def _encode_units(self, waiting: dict[str, list[tuple[int, str]]], out: list[bytes]) -> None:
        for mark, rows in waiting.items():
            lists = pc.split_pattern(pa.array([r[1] for r in rows], pa.large_string()), mark)
            codes = lists.values.dictionary_encode()
            ids = pa.array(self._found(codes.dictionary.to_pylist()), pa.large_binary()).take(codes.indices)
            bounds = np.frombuffer(ids.buffers()[1], "<i8", len(ids) + 1)[lists.offsets.to_numpy()].tolist()
            data = memoryview(ids.buffers()[2])
            for (i, _), start, stop in zip(rows, bounds, bounds[1:]):
                out[i] = bytes(data[start:stop])


_encoders: dict[tuple[str, bool], Encoder] = {}


kept_by_workers["tokens"] = _encoders.clear


def encoder(path: str, special: bool = True) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if (path, special) not in _encoders:
        _encoders[path, special] = Encoder(path, special)
    return _encoders[path, special]
