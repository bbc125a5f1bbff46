"""Byte-level BPE read from a tokenizers .json file: facts that token counts and packing share."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: Fixed value: how byte-level BPE of this family cuts a text into pre-tokens.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts longer than this go to the library itself; the faster engine's pattern matcher is
#: not made for single runs of many millions of characters.
LONG = 1_000_000


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in the file: itself where it prints, else the
    next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0x100
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


@lru_cache(maxsize=1)
def unsettled() -> re.Pattern:
    """Finds characters whose class is not the same in Unicode 3.2 and now. Libraries follow
    different versions of Unicode and may cut differently at these; only at these."""
    old, new = unicodedata.ucd_3_2_0.category, unicodedata.category
    odd = [c for c in range(0x80, 0x110000) if old(ch := chr(c)) == "Cn" or old(ch) != new(ch)]
    ranges, start = [], None
    for c, after in zip(odd, [*odd[1:], -1]):
        start = c if start is None else start
        if after != c + 1:
            ranges.append(f"\\U{start:08x}-\\U{c:08x}")
            start = None
    return re.compile(f"[{''.join(ranges)}]")


class ByteBpe:
    """What a byte-level BPE file says, checked: other kinds of file raise ValueError."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if (pre.get("type"), pre.get("use_regex", True), pre.get("add_prefix_space")) != ("ByteLevel", True, False) or model["type"] != "BPE" or spec.get("normalizer"):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(self.alphabet)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.plain_added = not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", []))
        self.vocab = {bytes(back[c] for c in s): i for s, i in model["vocab"].items() if s not in self.added}
        #: The file's merges in order must make the ids in order; then ids serve as ranks.
        made = [bytes(back[c] for c in "".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        ids = [self.vocab.get(m, -1) for m in made]
        self.ranked = self.plain_added and all(a < b for a, b in zip(ids, ids[1:])) and len(set(made)) == len(made) == len(self.vocab) - 256
        self.cut = regex.compile(PRE_TOKEN).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    @property
    def fast(self) -> tiktoken.Encoding | None:
        if not hasattr(self, "_fast"):
            self._fast = tiktoken.Encoding("file", pat_str=PRE_TOKEN, mergeable_ranks=self.vocab, special_tokens=self.added) if self.ranked else None
        return self._fast

    def settled(self, text: str) -> bool:
        return text.isascii() or not unsettled().search(text)

    def ids(self, text: str) -> np.ndarray:
        """The ids that the library gives without added special tokens, as unsigned 32-bit."""
        if self.fast is None or len(text) > LONG or not self.settled(text):
            return np.array(self.lib.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode(text, allowed_special="all"), np.uint32)

    def merged(self, piece: str) -> int:
        """Tokens of one pre-token, by the file's merges."""
        return len(self.lib.model.tokenize("".join([self.alphabet[b] for b in piece.encode("utf-8")])))

    def whole_tokens(self) -> list[str]:
        """Vocabulary strings proved to be one token alone: they are valid UTF-8, one pre-token,
        and the library encodes them as that one id."""
        known = []
        for raw, i in self.vocab.items():
            try:
                known.append((raw.decode("utf-8"), i))
            except UnicodeDecodeError:
                continue
        got = self.lib.encode_batch([s for s, _ in known], add_special_tokens=False)
        return [s for (s, i), e in zip(known, got) if e.ids == [i] and self.cut(s) == [s] and self.settled(s)]


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    """One per process and file."""
    return ByteBpe(path)


class TokenCounter(dict):
    """pre-token -> number of tokens. Proved whole tokens are known from the start; the rest is
    merged once and remembered until `most` are, when they are forgotten again."""

    def __init__(self, bpe: ByteBpe, whole: list[str], most: int = 300_000):
        super().__init__(dict.fromkeys(whole, 1))
        self.bpe, self.whole, self.most = bpe, whole, most + len(whole)

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.most:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        n = self.bpe.merged(piece)
        if len(piece) <= 256:
            self[piece] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        b = self.bpe
        if not b.settled(text):
            return len(b.lib.encode(text, add_special_tokens=False).ids)
        if b.special is None or not any(s in text for s in b.added):
            return sum(map(self.__getitem__, b.cut(text)))
        if not b.plain_added:
            return len(b.lib.encode(text, add_special_tokens=False).ids)
        pieces = b.special.split(text)
        return len(pieces) - 1 + sum(sum(map(self.__getitem__, b.cut(p))) for p in pieces)
