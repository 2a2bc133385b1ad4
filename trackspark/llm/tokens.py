"""Token ids of whole texts, with the tokenizers library and a memory of pieces.

Both byte-level vocabularies treat a text as a row of pre-tokens. A text is cut where
they always cut, so the ids of the text are the ids of its pieces in order. A batch
of texts is cut and its distinct pieces are found in Arrow; a worker remembers the ids
of pieces, and only those it has not met go to the tokenizer.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Where pieces cannot be told by replacing characters: white space in a row, a mark not after a letter or digit, NUL.
ODD = r"[\s\v\x1c-\x1f\x85\p{Z}][\s\v\x1c-\x1f\x85\p{Z}]|[^\p{L}\p{N}][.,]|İ[.,]|^[.,]|\x00"
#: Between a letter or digit and a single space before anything else a pre-token always ends.
BEFORE_WORD = re.compile(r"(?<=[^\W_])(?= \S)")
#: Pieces in each of the two generations that a worker remembers (about 160 bytes each).
REMEMBERED = 200_000
#: Bytes of text that are cut together.
TOGETHER = 3_000_000


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others as letters from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces of all texts in order, and the number of pieces of each; joined, the pieces give the text."""
    odd = pc.match_substring_regex(texts, ODD)
    if not pc.any(odd).as_py():
        marked = texts
        for mark, put in ((" ", "\0 "), ("\n", "\0\n\0"), (".", "\0."), (",", "\0,")):
            marked = pc.replace_substring(marked, mark, put)
        lists = pc.split_pattern(marked, "\0")
        return lists.flatten(), np.diff(lists.offsets.to_numpy())
    apart: list[list[str]] = []
    for text, strange in zip(texts.to_pylist(), odd.to_pylist(), strict=True):
        if strange:
            apart.append(BEFORE_WORD.split(text))
        else:
            apart.append(text.replace(" ", "\0 ").replace("\n", "\0\n\0").replace(".", "\0.").replace(",", "\0,").split("\0"))
    return pa.array([p for one in apart for p in one], pa.string()), np.fromiter(map(len, apart), np.int64, len(apart))


class Encoder:
    """Ids of texts by one vocabulary file of the byte-level kind; ids must fit 16 bits."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids beyond 16 bits")
        self.letters = byte_letters()
        # Lower-casing vocabularies also drop white space.
        self.lower = "Lowercase" in json.dumps(json.loads(self.tokenizer.to_str())["normalizer"])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _one_word(self, piece: str) -> str | None:
        """A plain Latin word as the model sees it: one pre-token that no normaliser changes but for case."""
        body = piece[1:] if piece[0] == " " else piece
        if not body.isalpha() or max(body) > "ɏ":
            return None
        if self.lower:
            body = body.lower()
            return body.encode().decode("latin-1").translate(self.letters) if body.isalpha() else None
        return piece.encode().decode("latin-1").translate(self.letters)

    def _learn(self, new: list[str]) -> None:
        rest = []
        model = self.tokenizer.model
        for p in new:
            word = self._one_word(p)
            if word is None:
                rest.append(p)
            else:
                self.known[p] = array("H", [t.id for t in model.tokenize(word)]).tobytes()
        for p, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False), strict=True):
            self.known[p] = array("H", e.ids).tobytes()

    def _ids(self, distinct: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        got = [self.known.get(p) for p in distinct]
        lost = [i for i, b in enumerate(got) if b is None]
        new = []
        for i in lost:
            p = distinct[i]
            if not p:
                self.known[p] = b""
            elif (b := self.older.get(p)) is not None:
                self.known[p] = b
            else:
                new.append(p)
        if new:
            self._learn(new)
        for i in lost:
            got[i] = self.known[distinct[i]]
        return got

    def _encode(self, texts: pa.Array) -> list[np.ndarray]:
        flat, counts = cut(texts)
        coded = flat.dictionary_encode()
        ids = self._ids(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        pool = np.frombuffer(b"".join(ids), np.uint16)
        starts = np.cumsum(sizes) - sizes
        piece = coded.indices.to_numpy(zero_copy_only=False)
        size = sizes[piece]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        tokens = pool[np.repeat(starts[piece] - (ends - size), size) + np.arange(total)]
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        return [tokens[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """16-bit ids of each text of a string array; none for a null or empty one."""
        texts = pc.fill_null(texts, "")
        out: list[np.ndarray] = []
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            before = int(size[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(size, before + TOGETHER, "right")))
            out += self._encode(texts.slice(at, stop - at))
            at = stop
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary in a worker process."""
    return Encoder(path)
