"""Token encoders that give the ids of the ``tokenizers`` library for a byte-level BPE file.

The vocabulary file's path is a parameter; nothing of it is stored here.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import regex
import tiktoken

#: The split pattern of the byte-level pre-tokenizer with ``use_regex``.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space of the split pattern, and runs of it that are too long for the splitter's stack.
SPACE = r"\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_SPACES = re.compile(f"[{SPACE}]{{4096,}}")
STRETCHES = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")

#: Outside these ranges the regex module and the library may know different Unicode
#: versions; stretches with such characters are left to the encoder, whose splitter is the library's equal there.
SAFE_TEXT = re.compile(r"[\u0000-\u0557\u1e00-\u2064\u20a0-\u20bf\u3000-\u30ff\u4e00-\u9fff\uac00-\ud7a3]*")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself if visible Latin-1, else 256 and up in order."""
    alphabet, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            alphabet[chr(b)] = b
        else:
            alphabet[chr(spare)] = b
            spare += 1
    return alphabet


def is_byte_level(path: str) -> bool:
    """True if the file is a plain byte-level BPE for which `Encoder` is exact."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    added = spec.get("added_tokens") or []
    return (
        model.get("type") == "BPE"
        and not spec.get("normalizer")
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and not any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "end_of_word_suffix", "continuing_subword_prefix"))
        and not any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word", "normalized"))
    )


class Encoder:
    """Ids of a byte-level BPE vocabulary; added tokens inside texts count as themselves."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.ranks = {bytes(alphabet[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.size = max([*self.ranks.values(), *self.special.values()]) + 1
        self._bpe = tiktoken.Encoding(os.path.basename(path), pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        # where one added token begins another, the longer one is meant
        longest = sorted(map(re.escape, self.special), key=len, reverse=True)
        self._specials = re.compile(f"({'|'.join(longest)})" if longest else r"((?!))")

    def parts(self, text: str) -> list[str]:
        """Stretches of ordinary text, the added tokens between them at the odd places."""
        return self._specials.split(text)

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of a text of any length; memory and time grow in proportion to it."""
        if not text:
            return np.empty(0, np.uint32)
        out = []
        for k, part in enumerate(self.parts(text)):
            if k % 2:
                out.append(np.array([self.special[part]], np.uint32))
            elif part:
                out += self._ordinary(part)
        return out[0] if len(out) == 1 else np.concatenate(out)

    def _ordinary(self, text: str) -> list[np.ndarray]:
        """Ids by stretch, with long runs of white space cut off by hand: the splitter's stack doesn't hold them.

        Of a run that goes on with something else all but the last character are one piece, at
        the end of the text the whole run is. No piece crosses from other characters into a run.
        """
        out, done = [], 0
        for run in LONG_SPACES.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            if run.start() > done:
                out.append(self._bpe.encode_to_numpy(text[done : run.start()], disallowed_special=()))
            out.append(np.array(self.merged(text[run.start() : end]), np.uint32))
            done = end
        if done < len(text):
            out.append(self._bpe.encode_to_numpy(text[done:] if done else text, disallowed_special=()))
        return out

    def merged(self, piece: str) -> list[int]:
        """Ids of one piece of the split pattern."""
        return self._bpe._encode_single_piece(piece)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=4)
def prove_whole(path: str) -> frozenset[str]:
    """The vocabulary strings that encode alone as one token, shown with the file's own library.

    A string is *whole* if the library's splitter leaves it in one piece and its merges give that piece the string's one
    id. As merges never cross pieces, such a piece of any text is one token. It runs once, on
    the driver, before any text is read; workers are sent the set, of at most the vocabulary's size.
    """
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    split, found = library.pre_tokenizer.pre_tokenize_str, []
    for token, rank in encoder(path).ranks.items():
        try:
            found.append((token.decode("utf-8"), rank))
        except UnicodeDecodeError:
            continue  # part of a character: can't be a whole piece of valid text
    ids = library.encode_batch([t for t, _ in found], add_special_tokens=False)
    return frozenset(t for (t, rank), e in zip(found, ids, strict=True) if e.ids == [rank] and len(split(t)) == 1)


class TokenCounter:
    """Number of tokens of a text, by the whole-token shortcut.

    Pieces of the split pattern that are in ``whole`` count as one; the rest are merged, with a
    bounded memo. Stretches of white space and what follows it up to the next are split
    alike alone and in a text, so only stretches with characters outside SAFE_TEXT are left to the encoder.
    """

    MEMO = 200_000

    def __init__(self, path: str, whole: frozenset[str]):
        self._enc = encoder(path)
        self._pieces = regex.compile(BYTE_LEVEL_PATTERN).findall
        self.whole = whole
        self._memo = _Memo(lambda piece: len(self._enc.merged(piece)), self.MEMO)
        self._memo.update(dict.fromkeys(self.whole, 1))
        self._memo.fixed = len(self.whole)
        self._stretch = _Memo(self._of_stretch, self.MEMO)

    def _safe(self, text: str) -> int:
        return sum(map(self._memo.__getitem__, self._pieces(text)))

    def _of_stretch(self, text: str) -> int:
        return self._safe(text) if SAFE_TEXT.fullmatch(text) else len(self._enc.ids(text))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        n = 0
        for k, part in enumerate(self._enc.parts(text)):
            if k % 2:
                n += 1
            elif SAFE_TEXT.fullmatch(part):
                n += self._safe(part)
            else:
                n += sum(map(self._stretch.__getitem__, STRETCHES.findall(part)))
        return n


class _Memo(dict):
    def __init__(self, compute, room: int):
        super().__init__()
        self.compute, self.room, self.fixed = compute, room, 0
        self.recent: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self.compute(piece)
        if len(piece) <= 64:
            if len(self.recent) >= self.room:
                for old in self.recent:
                    del self[old]
                self.recent.clear()
            self.recent.append(piece)
            self[piece] = n
        return n


_COUNTERS: dict[str, TokenCounter | LibraryCounter] = {}


def counter(path: str, whole: frozenset[str] | None = None) -> TokenCounter | LibraryCounter:
    """The counter for a vocabulary file of any of the public formats, kept by the process.

    ``whole`` is what `prove_whole` found; without it the file's library counts.
    """
    if path not in _COUNTERS:
        _COUNTERS[path] = LibraryCounter(path) if whole is None else TokenCounter(path, whole)
    return _COUNTERS[path]


class LibraryCounter:
    """Counts by the file's own library: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            self._ids = sentencepiece.SentencePieceProcessor(model_file=path).encode
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            self._ids = lambda text: tok.encode(text, add_special_tokens=False).ids

    def count(self, text: str | None) -> int:
        return len(self._ids(text)) if text else 0
