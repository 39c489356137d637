"""Token ids of whole texts with a public tokenizer, as little-endian unsigned 32-bit binaries.

The tokenizer is a file of the `tokenizers` library. Where it is a plain byte-level BPE whose ids follow its merges, the
same vocabulary runs in tiktoken, which gives the same ids (a test holds both against each other) at four times the speed; texts that
its regular expressions cannot manage (such as a million blanks in a row) are encoded by `tokenizers`.
Any other file runs in `tokenizers` itself. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

from .common import pieces

_encoders: dict[str, "Encoder"] = {}
#: Fixed value: the split pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space from this length on are not left to backtracking.
BLANKS = re.compile(r"\s{4000}")
PLAIN = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def ranks_of(file: dict) -> dict[bytes, int] | None:
    """Byte strings with their ids, if the file is a plain byte-level BPE whose ids are in order of its merges."""
    model, pre = file["model"], file.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or file.get("normalizer") or any(pre.get(k) != v for k, v in PLAIN.items()) or model.get("ignore_merges"):
        return None
    special = {x["id"] for x in file.get("added_tokens", []) if x.get("special")}
    if len(special) < len(file.get("added_tokens", [])):
        return None
    letters = byte_alphabet()
    ranks = {bytes(letters[c] for c in token): k for token, k in model["vocab"].items() if k not in special}
    merged = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [model["vocab"][a + b] for a, b in merged]
    return ranks if order == sorted(order) and len(ranks) == len(order) + 256 else None


class Encoder:
    """Encodes texts to id bytes; one per worker process and tokenizer file."""

    def __init__(self, path: str):
        self.path, self.plain, self._tokenizer = path, None, None
        with open(path, encoding="utf-8") as f:
            ranks = ranks_of(json.load(f))
        if ranks:
            import tiktoken

            self.plain = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    def tokenizer(self):
        if self._tokenizer is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
            self._tokenizer.encode_special_tokens = True
        return self._tokenizer

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.plain:
            return [self.encode_plain(t) for t in texts]
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_plain(self, text: str) -> bytes:
        if len(text) < 4000 or not BLANKS.search(text):
            return array("I", self.plain.encode_ordinary(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, list[bytes], np.ndarray]]:
    """(rows, their id bytes with the end id, their row ids: partition << 40 | place)."""
    enc = encoder(path)
    end = array("I", [end_id]).tobytes()
    at = TaskContext.get().partitionId() << 40
    for batch in batches:
        for part in pieces(batch, 2 << 20):
            texts = part.column(part.schema.get_field_index("text")).fill_null("").to_pylist()
            yield part, [x + end for x in enc.encode(texts)], np.arange(at, at + len(texts))
            at += len(texts)
