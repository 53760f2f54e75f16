"""Encoding of whole texts with public vocabularies, inside tasks."""

from __future__ import annotations

import functools
import json
import os

import numpy as np

DEFAULT_VOCABULARY = "word_bpe_49k.json"
#: Cached words of one Python worker; words beyond it are encoded each time they occur.
CACHE_WORDS = 300_000


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    """The place of a public vocabulary file, or ``name`` itself if that is a path."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class _WordIds(dict):
    """Word -> its ids as little-endian 32-bit numbers."""

    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self._encode(word)
        if len(self) < CACHE_WORDS and len(word) <= 64:
            self[word] = ids
        return ids


class WordEncoder:
    """Ids of a word-end BPE vocabulary, equal to ``tokenizers.Tokenizer.encode(text, add_special_tokens=False)``.

    Such a vocabulary drops white space, so a text's ids are those of its words in turn, and words are
    cached.  Words of plain Latin letters and ASCII signs go through tiktoken's merge loop over the same
    vocabulary and merges, with a word end written as byte 1; any other word, and any text with one of the
    four control characters that only Python takes for white space, goes to ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        steps = spec["pre_tokenizer"]["pretokenizers"]
        if spec["model"].get("end_of_word_suffix") != "</w>" or steps[0]["type"] != "Split":
            raise ValueError(f"{path}: not a vocabulary with word ends")
        self._pieces = regex.compile(steps[0]["pattern"]["Regex"]).findall
        vocab, end = spec["model"]["vocab"], b"\x01"
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        sign = {b: chr(b) for b in printable}
        sign |= {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in sign)}
        byte = {c: b for b, c in sign.items()}

        def raw(token: str) -> bytes:
            body = token.removesuffix("</w>")
            return bytes(byte[c] for c in body) + end * (body != token)

        ranks, ids = {bytes([b]): b for b in range(256)}, [vocab[sign[b]] for b in range(256)]
        merged = [f"{sign[b]}</w>" for b in range(256)] + ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        for token in merged:
            if ranks.setdefault(raw(token), len(ids)) == len(ids):
                ids.append(vocab[token])
        self._id = np.array(ids, "<u4")
        self._merge = tiktoken.Encoding("words", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.words = _WordIds(self._word)

    def _word(self, word: str) -> bytes:
        if max(word) < "İ" and "<|" not in word and min(word) > " " and not ("\x7f" <= max(word) < "\xc0"):
            joined = "\x01 ".join(self._pieces(word.lower()))
            return self._id[self._merge(joined + "\x01")].tobytes()
        return self._plain(word)

    def _plain(self, text: str) -> bytes:
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, four bytes each."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self._plain(text)
        return b"".join(map(self.words.__getitem__, text.split()))

    def count(self, text: str) -> int:
        return len(self.encode(text)) // 4


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder a worker."""
    return WordEncoder(path)
