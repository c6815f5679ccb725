"""Exact tokenization through the distinct units of a text.

A unit is a part of a text that the tokenizer encodes by itself, whatever
stands around it, so the ids of a text are the ids of its units put together.
Each unit is encoded once and looked up afterwards.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
import unicodedata

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Units kept in a worker's memory; beyond it the store starts anew.
STORE_UNITS = 700_000

# The white space of Unicode, and the contractions the two tokenizer files name.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def _class(kind: str) -> str:
    """The one-byte characters of a Unicode category, as the inside of a class."""
    return "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == kind)


def _visible() -> dict[int, str]:
    """The byte-level alphabet: visible bytes stand for themselves, the others for 256 and on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Store(dict):
    """Encoded units; one that is not there yet is encoded on first use."""

    def __init__(self, encoder: Encoder, words: list[bytes]):
        super().__init__()
        self.encoder, self.words = encoder, words

    def __missing__(self, unit: str) -> bytes:
        words = self.words
        found = self[unit] = b"".join([words[i] for i in self.encoder.encoded(unit)])
        return found


class Encoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    Texts of one-byte characters without ``<|`` are cut by the file's own
    pre-token pattern; all others at the start of each run of white space,
    where no pre-token, added token or normalization reaches across. ``kept``
    units stay in memory between calls.
    """

    def __init__(self, path: str, kept: int = STORE_UNITS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        letter, digit = _class("L"), _class("N")
        space = "\t-\r \x85\xa0"
        self.lower = spec.get("normalizer") is not None
        if self.lower:
            known = [n["type"] for n in spec["normalizer"].get("normalizers", [])]
            if known != ["NFC", "Replace", "Lowercase"]:
                raise ValueError(f"no unit rule for the normalizer of {path}")
            fast = f"{CONTRACTIONS}|[{letter}]+|[{digit}]|[^{space}{letter}{digit}]+"
        else:
            if spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
                raise ValueError(f"no unit rule for the pre-tokenizer of {path}")
            fast = (
                f"{CONTRACTIONS}| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+"
                f"|[{space}]+(?![^{space}])|[{space}]+"
            )
        self.fast = re.compile(fast).findall
        self.safe = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+").findall
        self.visible = _visible()
        small = "".join(c for c in map(chr, range(256)) if c.isalpha() and c == c.lower())
        self.single = re.compile(f"[{small}]+" if self.lower else f" ?[{letter}]+").fullmatch
        self.merges, self.blank = self.tokenizer.model.tokenize, self.visible[32]
        self.kept = kept
        self.store = _Store(self, [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())])

    @classmethod
    def of_process(cls, path: str, kept: int = STORE_UNITS) -> Encoder:
        """The encoder of this worker process, so that its store serves all tasks that run here."""
        module = sys.modules.setdefault("shelfwise_worker", types.ModuleType("shelfwise_worker"))
        held = module.__dict__.setdefault("encoders", {})
        if (path, kept) not in held:
            held[path, kept] = cls(path, kept)
        return held[path, kept]

    def units(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.safe(text)
        if "<|" in text:
            return self.safe(text)
        return self.fast(text.lower() if self.lower else text)

    def encoded(self, unit: str) -> list[int]:
        """Ids of a unit. One that is a single pre-token goes straight to the merges."""
        if unit.isascii():
            if unit.isalpha():
                if not self.lower or unit.islower():
                    return [t.id for t in self.merges(unit)]
            elif unit[0] == " " and not self.lower and unit[1:].isalpha():
                return [t.id for t in self.merges(self.blank + unit[1:])]
        elif self.single(unit):
            return [t.id for t in self.merges(unit.encode().decode("latin-1").translate(self.visible))]
        return self.tokenizer.encode(unit, add_special_tokens=False).ids

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.store) > self.kept:
            self.store.clear()
        get, units = self.store.__getitem__, self.units
        return [b"".join(map(get, units(t))) for t in texts]
