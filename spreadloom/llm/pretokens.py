"""Reads a byte-level BPE file and cuts text where no pre-token can reach across.

The vocabulary path is a parameter everywhere; files are only read, in each Python worker once.
"""

from __future__ import annotations

import json
from functools import lru_cache
from typing import NamedTuple

import regex

#: The pre-token pattern of byte-level BPE files whose pre-tokenizer is ByteLevel with use_regex.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points with the Unicode property White_Space, which \s means to the library.
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0                　")


class ByteBpe(NamedTuple):
    """token_bytes[id]; byte_ids[byte]; ranks[left][right] -> merge rank; merged[rank] -> id; special strings -> id."""

    token_bytes: list
    byte_ids: list
    ranks: list
    merged: list
    special: dict


def printable_bytes() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself if visible in Latin-1, else 256, 257, ... in order."""
    visible = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    own = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or (own.get("type"), own.get("use_regex"), own.get("add_prefix_space")) != ("ByteLevel", True, False):
        raise ValueError(f"{path}: not a byte-level BPE file without normalizer whose pre-tokenizer has the usual pattern")
    if any("<" not in t["content"] for t in spec["added_tokens"]):
        raise ValueError(f"{path}: special strings need a '<'")
    alias = printable_bytes()
    vocab, special = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
    token_bytes = [b""] * (1 + max([*vocab.values(), *special.values()]))
    for token, i in vocab.items():
        token_bytes[i] = token.encode() if token in special else bytes(alias[c] for c in token)
    for token, i in special.items():
        token_bytes[i] = token.encode()
    byte_ids = [0] * 256
    for c, b in alias.items():
        byte_ids[b] = vocab[c]
    ranks, merged = [{} for _ in token_bytes], []
    for rank, pair in enumerate(spec["model"]["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        ranks[vocab[left]].setdefault(vocab[right], rank)
        merged.append(vocab[left + right])
    return ByteBpe(token_bytes, byte_ids, ranks, merged, special)


@lru_cache(maxsize=1)
def pattern() -> regex.Pattern:
    return regex.compile(PATTERN.replace(r"[^\s", r"[^" + "".join(WHITE)).replace(r"\s", "[" + "".join(WHITE) + "]").replace(r"\S", "[^" + "".join(WHITE) + "]"))


@lru_cache(maxsize=4)
def special_pattern(special: tuple[str, ...]) -> regex.Pattern | None:
    return regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None


def units(pieces: list[str]) -> list[str]:
    """The units of a text that was split at single spaces. A cut falls before every space that has no white space
    beside it: there the pattern always ends one pre-token and begins the next, so the tokens of the text are those
    of its units, one after the other.
    """
    out, held = [], pieces[0]
    for piece in pieces[1:]:
        if held and piece and held[-1] not in WHITE and piece[0] not in WHITE:
            out.append(held)
            held = " " + piece
        else:
            held = f"{held} {piece}"
    out.append(held)
    return out


@lru_cache(maxsize=1)
def unclean() -> regex.Pattern:
    """Finds a space at an end of a text, or beside other white space: where ``units`` makes no cut."""
    return regex.compile("\\A | \\Z| [{0}]|[{0}] ".format("".join(WHITE)))


class Memo(dict):
    """key -> make(key), kept for later. ``renewed`` keeps the memory bounded: a full memo becomes the old generation
    of a new one, and what is asked for again moves over.
    """

    def __init__(self, make, limit: int, old: dict | None = None):
        super().__init__()
        self.make, self.limit, self.old = make, limit, old or {}

    def __missing__(self, key):
        found = self.old.get(key)
        self[key] = found = self.make(key) if found is None else found
        return found

    def renewed(self) -> Memo:
        if len(self) < self.limit // 2:
            return self
        self.old = {}
        return Memo(self.make, self.limit, self)
