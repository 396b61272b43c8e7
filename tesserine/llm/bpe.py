"""BPE encoding of whole texts at corpus speed, and its exact inverse.

A text falls apart at white space into chunks that the tokenizer's own splitter never
joins; chunks repeat, so each task remembers their ids. A chunk that is new goes through
the merges once. A run of letters or of symbols that no splitter cuts and that is long is
encoded by tree concatenation: both halves (their leaves in parallel), then growing windows
around the join until the window's ids agree with both sides. That is exact: a sequence of
tokens is the encoding of its text if and only if every two neighbours are the encoding of
theirs, and each neighbouring pair of the result lies within a half or within the window.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

#: A run of bytes beyond this length without a split is encoded by tree concatenation, unless an encoder is given another limit.
LONG = 2048
LEAF = 512
#: Chunks remembered by a process, about 200 bytes each; beyond, it forgets them all.
MEMORY = 600_000

#: White space next to a space, or anything that the fast split does not know: the slow way, still exact.
_ODD = re.compile(r"[^\S ] | [^\S ]|  |\n\n|[^\S \n]|[\x00-\x08\x0e-\x1f\x7f-\xa0]|^[ \n]|[ \n]$")
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ȳ]*\Z")


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the rest follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """One vocabulary file of the tokenizers library: ``encode(text)`` gives the ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, long: int = LONG, memory: int = MEMORY):
        self.long, self.memory = long, memory
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _byte_letters()
        self.suffix = model.get("end_of_word_suffix") or ""
        self.lowers = "Lowercase" in json.dumps(spec.get("normalizer"))
        self.special = [t["content"] for t in spec["added_tokens"]]
        # The merges in the order of their ranks; ids of this vocabulary kind rise with rank, which is checked here.
        ranks: dict[bytes, int] = {}
        for token, i in model["vocab"].items():
            if token in self.special:
                continue
            ends = bool(self.suffix) and token.endswith(self.suffix)
            ranks[bytes(letters[c] for c in (token[: -len(self.suffix)] if ends else token)) + b"\xff" * ends] = i
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        self.ranked = merged == sorted(merged) and (not merged or merged[0] >= 256 * (1 + bool(self.suffix)))
        if self.suffix:
            ranks.pop(b"\xff", None)  # never part of UTF-8; it marks a word's end here
            ranks[b"\xff"] = 1 << 30  # only so that every byte has a rank
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" if self.suffix else r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.merges = tiktoken.Encoding("merges", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.pieces = __import__("regex").compile(pattern).findall
        self.inner = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}, "post_processor": None, "added_tokens": [], "model": model | {"end_of_word_suffix": None}}))
        self.outer = self.inner if not self.suffix else Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}, "post_processor": None, "added_tokens": []}))
        size = max(model["vocab"].values()) + 1
        self.names: list[str] = [""] * max(size, 1 + max((t["id"] for t in spec["added_tokens"]), default=0))
        for token, i in [*model["vocab"].items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]:
            self.names[i] = token
        self.letters = {b: c for c, b in letters.items()}
        self.piece_ids: dict[str, bytes] = {}
        self.known = _Known(self)

    # -- whole texts ------------------------------------------------------------------
    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text; null is empty."""
        if not text:
            return b""
        odd = _ODD.search(text) is not None
        if self.suffix:
            if odd and any(c in text for c in "\x1c\x1d\x1e\x1f\x85"):  # white space to one library and not to the other
                return self._slow(text)
            keys = text.split() if odd else text.replace("\n", " ").split(" ")
        elif odd:
            # Cut where a single space stands between two characters that are no white space.
            keys = [c[1:] if i else "\0" + c for i, c in enumerate(re.split(r"(?<=[!-~À-ȳ])(?= [!-~À-ȳ])", text))]
        else:
            keys = ("\0" + text.replace("\n", " \n")).split(" ")
        return b"".join(map(self.known.__getitem__, keys))

    def _slow(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def chunk(self, key: str) -> bytes:
        """A chunk without known ids. Without word ends, a key stands for itself after a space; behind a zero or from a line end on, for itself alone."""
        if not key:
            return b""
        text = key if self.suffix or key[0] == "\n" else key[1:] if key[0] == "\0" else " " + key
        if not text:
            return b""
        plain = self.ranked and "<|" not in text and _PLAIN.match(text, text[0] in " \n")
        if plain and not self.suffix and len(text.encode()) <= self.long:
            return array("I", self.merges.encode_ordinary(text)).tobytes()
        if not plain:
            long = self.ranked and max((len(p) for p in self.pieces(text)), default=0) > self.long and not any(s in text for s in self.special)
            if not long or self.lowers and not text.isascii():
                return self._slow(text)
        if self.lowers:
            text = text.lower()
        return b"".join([self.piece_ids.get(p) or self._piece(p) for p in self.pieces(text)])

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        if len(raw) > self.long:
            return np.array(self.tree(piece, min(LEAF, max(1, self.long // 2))), "<u4").tobytes()
        out = array("I", self.merges.encode_single_piece(raw + b"\xff" if self.suffix else raw)).tobytes()
        if len(self.piece_ids) > self.memory:
            self.piece_ids.clear()
        self.piece_ids[piece] = out
        return out

    # -- tree concatenation -----------------------------------------------------------
    def tree(self, piece: str, leaf: int = LEAF) -> list[int]:
        """The ids of one unsplit piece of any length."""
        parts = [piece[i : i + leaf] for i in range(0, len(piece), leaf)]
        done = [e.ids for e in self.inner.encode_batch(parts[:-1], add_special_tokens=False)]
        done.append(self.outer.encode(parts[-1], add_special_tokens=False).ids)
        while len(done) > 1:
            done = [self._join(done[i], done[i + 1], i + 2 >= len(done)) if i + 1 < len(done) else done[i] for i in range(0, len(done), 2)]
        return done[0]

    def _text_of(self, ids: list[int]) -> bytes:
        return "".join(self.names[i] for i in ids).encode()

    def _join(self, a: list[int], b: list[int], last: bool) -> list[int]:
        """Ids of the text of ``a`` and ``b``; only the last part of a piece carries the end of the word."""
        width = 8
        while True:
            left, right = a[-width:], b[:width]
            whole_a, whole_b = len(left) == len(a), len(right) == len(b)
            ends = last and whole_b
            new = self._window(left, right, ends)
            if (whole_a or new[:1] == left[:1]) and (whole_b or new[-1:] == right[-1:]):
                return a[: len(a) - len(left)] + new + b[len(right) :]
            width *= 2

    def _window(self, left: list[int], right: list[int], ends: bool) -> list[int]:
        names = "".join(self.names[i] for i in [*left, *right])
        if ends and self.suffix:
            names = names[: -len(self.suffix)]
        spec = self._raw_outer if ends else self._raw_inner
        return spec.encode(names, add_special_tokens=False).ids

    @property
    def _raw_inner(self):
        return self._raw("inner", None)

    @property
    def _raw_outer(self):
        return self._raw("outer", self.suffix or None)

    def _raw(self, kind: str, suffix: str | None):
        """A tokenizer over the byte letters themselves, so that a window may begin and end within a character."""
        if (found := self.__dict__.get(f"raw_{kind}")) is None:
            from tokenizers import Tokenizer

            spec = json.loads(self.inner.to_str())
            found = Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": None, "model": spec["model"] | {"end_of_word_suffix": suffix}}))
            self.__dict__[f"raw_{kind}"] = found
        return found

    # -- decoding ---------------------------------------------------------------------
    def decode(self, ids: bytes) -> str:
        """The library's ``decode(ids, skip_special_tokens=False)``."""
        at = np.frombuffer(ids, "<u4").tolist()
        if self.suffix:  # such a file has no decoder: tokens joined by spaces
            return " ".join(map(self.names.__getitem__, at))
        return self.library.decode(at, skip_special_tokens=False)


class _Known(dict):
    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encoder.chunk(chunk)
        if len(chunk) <= 48:
            if len(self) >= self.encoder.memory:
                self.clear()
            self[chunk] = ids
        return ids


@lru_cache(maxsize=4)
def encoder(path: str, long: int = LONG, memory: int = MEMORY) -> Encoder:
    """One encoder for these arguments and a Python process."""
    return Encoder(path, long, memory)


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
