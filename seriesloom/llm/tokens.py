"""Token ids of texts under a public byte-level BPE vocabulary, inside tasks."""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: The id that ends every document.
END_OF_TEXT = 2

#: Fixed value: how the byte-level pre-tokenizer cuts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same but for its lookahead, which costs a third of the time.  It matters only where white space of
#: two or more characters ends before other text: the last of them belongs to that text's piece.
PLAIN_PATTERN = PATTERN.replace(r"|\s+(?!\S)", "")
#: Latin-1 bytes with every white space as a blank.
_BLANKED = bytes(32 if chr(b) in "\t\n\v\f\r \x85\xa0" else b for b in range(256))
_TEXT = re.compile(rb"[^ ]")


def _spans(blanked: bytes) -> Iterator[tuple[int, int]]:
    """Parts of a text, cut before the last white space of every run of two or more that other text follows."""
    start = at = 0
    while (at := blanked.find(b"  ", at)) >= 0:
        follows = _TEXT.search(blanked, at)
        if follows is None:
            break
        yield start, follows.start() - 1
        start = at = follows.start() - 1
    yield start, len(blanked)


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids as the tokenizer file gives them.

    Where the file is plain byte-level BPE whose ids follow the order of its merges, Latin-1
    texts without special tokens are merged by a faster library with the same vocabulary;
    everything else goes through the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path = path
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.special = [t["content"] for t in said["added_tokens"]]
        self.fast = self._fast(said)

    @functools.cached_property
    def exact(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def _fast(self, said: dict) -> tiktoken.Encoding | None:
        model, cut = said["model"], said["pre_tokenizer"] or {}
        odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
        if model["type"] != "BPE" or said["normalizer"] or not plain or any(odd):
            return None
        letters = _byte_of_letter()
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [vocab[a + b] for a, b in pairs]
        if made != sorted(made) or len(vocab) != 256 + len(made):
            return None
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
        # No Latin-1 text holds the special token; without any, every place would be tried for an empty one.
        return tiktoken.Encoding("byte_bpe", pat_str=PLAIN_PATTERN, mergeable_ranks=ranks, special_tokens={"\uffff": max(ranks.values()) + 1})

    def ids(self, text: str) -> np.ndarray:
        """Little-endian 32-bit ids of a text."""
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                blanked = text.encode("latin-1").translate(_BLANKED)
            except UnicodeEncodeError:
                pass
            else:
                parts = [self.fast.encode_to_numpy(text[i:j], disallowed_special=()) for i, j in _spans(blanked)]
                return parts[0] if len(parts) == 1 else np.concatenate(parts)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def __call__(self, text: str) -> list[int]:
        return self.ids(text).tolist()

    def ended(self, text: str, end: int = END_OF_TEXT) -> np.ndarray:
        """Little-endian 32-bit ids of a document with its end."""
        return np.append(self.ids(text), np.uint32(end))


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)
