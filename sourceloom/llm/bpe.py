"""Byte-level BPE over pre-tokens, with the library's own encoder wherever no shortcut applies.

A text is split at special strings, then by the vocabulary's pre-token pattern.  Pre-tokens never merge
across their borders, so a text's tokens are those of its pre-tokens in order, and each distinct
pre-token needs the encoder once.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

# Code points whose class (letter, number, white space, other) no Unicode version has changed.
_LETTERS = (
    "A-Za-zªµºÀ-ÖØ-öø-ɏ"
    "Α-ΡΣ-ώЀ-ҁぁ-ゖァ-ヺ一-龥가-힣"
)
_NUMBERS = "0-9²³¹¼-¾"
_SPACES = "\t-\r \u0085 "
_OTHERS = "‐-‧‰-‾€、-〃，"
#: A character outside these goes to the library's own pre-tokenizer, with its whole text.
UNPROVEN = re.compile(f"[^\\x00-ÿ{_LETTERS}{_OTHERS}]")
# The vocabulary's pattern; its first characters are disjoint, so the most frequent branch stands first.
PRE_TOKEN = re.compile(
    f" ?[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+"
    f"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)
PATTERN_OF = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
MEMO_ENTRIES = 400_000
MEMO_CHARS = 64
TRIED_AT_ONCE = 2000  # vocabulary strings


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pack_ids(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else b"".join(i.to_bytes(4, "little") for i in ids)


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def proven_vocabulary(text: str) -> "Vocabulary":
    """Of the text of a ``tokenizers`` file, its whole tokens proven."""
    return Vocabulary(text=text).prove_whole_tokens()


class Memo(dict):
    """Value of a pre-token, computed when first asked for; ``trim`` bounds what is kept."""

    def __init__(self, known: dict, compute):
        super().__init__(known)
        self.known, self.compute = known, compute

    def __missing__(self, pre_token):
        value = self.compute(pre_token)
        if len(pre_token) <= MEMO_CHARS:
            self[pre_token] = value
        return value

    def trim(self) -> None:
        if len(self) > len(self.known) + MEMO_ENTRIES:
            self.clear()
            self.update(self.known)


class Vocabulary:
    """A ``tokenizers`` file, sent to workers as its JSON text and loaded once in each."""

    def __init__(self, path: str | None = None, text: str | None = None):
        """From the file, or from its text where the file is not at hand."""
        self.text = read_vocabulary(path) if text is None else text
        spec = json.loads(self.text)
        split = spec.get("pre_tokenizer") or {}
        self.shortcut = spec.get("normalizer") is None and all(split.get(k) == v for k, v in PATTERN_OF.items())
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.plain_special = not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"].get("merges", [])]
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        #: merge k makes token k + 256: the ids are ranks, and a rank-based merger gives the same tokens
        self.ranked = self.shortcut and all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(merges))
        self.ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items()} if self.ranked else {}
        self.whole: dict[str, int] = {}
        self._live = None

    def __getstate__(self):
        return {**self.__dict__, "_live": None}

    def _tools(self):
        if self._live is None:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(self.text)
            merge = self.merger(tokenizer)
            self._live = (
                tokenizer,
                Memo(dict.fromkeys(self.whole, 1), lambda p: len(merge(p))),
                Memo({p: i.to_bytes(4, "little") for p, i in self.whole.items()}, lambda p: pack_ids(merge(p))),
                re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None,
            )
        return self._live

    def merger(self, tokenizer):
        """Token ids of one pre-token: by ranks where the ids are ranks (an eighth of the time), else by the encoder."""
        if not self.ranked:
            return lambda p: tokenizer.encode(p, add_special_tokens=False).ids
        import tiktoken

        single = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})._core_bpe.encode_single_piece
        return lambda p: single(p.encode())

    def prove_whole_tokens(self) -> "Vocabulary":
        """Find, once and before any text is read, the vocabulary strings that alone encode to their own id.

        Merges may lead past a string that is in the vocabulary, so each is tried with the encoder.
        A string must also be one pre-token, else it can never stand alone.
        """
        tokenizer, alphabet = self._tools()[0], byte_alphabet()
        strings = {}
        for token, number in tokenizer.get_vocab(with_added_tokens=False).items():
            try:
                text = bytes(alphabet[c] for c in token).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            if text not in self.special and not UNPROVEN.search(text) and PRE_TOKEN.fullmatch(text):
                strings[text] = number
        merge, listed = self.merger(tokenizer), list(strings)
        for at in range(0, len(listed), TRIED_AT_ONCE):
            block = listed[at:at + TRIED_AT_ONCE]
            ids = [e.ids for e in tokenizer.encode_batch(block, add_special_tokens=False)]
            self.ranked = self.ranked and all(merge(t) == i for t, i in zip(block, ids))
            self.whole |= {t: strings[t] for t, i in zip(block, ids) if i == [strings[t]]}
        self._live = None
        return self

    def _segments(self, text: str, special_pattern):
        """(pre-tokens or None, text or special string) of the text between special strings."""
        if special_pattern is None or not any(s in text for s in self.special):
            return [text]
        return special_pattern.split(text)

    def count(self, text: str) -> int:
        tokenizer, counts, _, special = self._tools()
        if not self.shortcut or not self.plain_special or UNPROVEN.search(text):
            return len(tokenizer.encode(text, add_special_tokens=False).ids)
        total = 0
        for part in self._segments(text, special):
            total += 1 if part in self.special else sum(map(counts.__getitem__, PRE_TOKEN.findall(part)))
        counts.trim()
        return total

    def ids(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit numbers."""
        tokenizer, _, packed, special = self._tools()
        if not self.shortcut or not self.plain_special or UNPROVEN.search(text):
            return pack_ids(tokenizer.encode(text, add_special_tokens=False).ids)
        out = []
        for part in self._segments(text, special):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out.extend(map(packed.__getitem__, PRE_TOKEN.findall(part)))
        packed.trim()
        return b"".join(out)
