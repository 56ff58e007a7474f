"""Encode whole texts with a public tokenizer, word by word through a bounded cache."""

from __future__ import annotations

import json
from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer
from tokenizers.models import BPE

from millrace.llm.common import kept_in_worker

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Token ids of a text as the tokenizer file gives them, for files whose model ignores white space.

    Such a file (NFC, white space, lower case, then pieces by a pattern, bytes as letters, BPE) encodes
    each white-space-separated word alone, so ids of a text are those of its words in turn. Each word is
    encoded by the tokenizers library once and kept, up to ``most`` words; the pieces of new words go to
    the library's BPE model in one batch. Words with a special token, a control character or other white
    space are given to the whole tokenizer.
    """

    def __init__(self, path: str = VOCABULARY, most: int = 500_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path} does not drop white space and lower its words")
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pieces = Tokenizer(BPE(vocab=model["vocab"], merges=merges,
                                    end_of_word_suffix=model["end_of_word_suffix"]))
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(f"{pattern}| ")
        marks = "|".join(regex.escape(token["content"]) for token in spec["added_tokens"])
        # Control characters, further white space and the letter with two lower forms.
        self.odd = regex.compile(rf"[\x00-\x1f\x7f-\xa0\u03a3\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u3000\ufeff\ufffd]|{marks}")
        self.letters = _byte_letters()
        # The last token of each piece, and no other, carries the end-of-word suffix.
        self.ends = np.zeros(max(model["vocab"].values()) + 1, dtype=bool)
        self.ends[[i for token, i in model["vocab"].items() if token.endswith(model["end_of_word_suffix"])]] = True
        self.most = most
        self.words: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of UTF-8 texts as little-endian unsigned 32-bit numbers."""
        known = self.words
        split = [text.split() for text in texts]
        found = [list(map(known.get, words)) for words in split]
        fresh = self._fresh({w for words, ids in zip(split, found) if None in ids
                             for w, i in zip(words, ids) if i is None})
        if fresh:
            found = [[fresh[w] if i is None else i for w, i in zip(words, ids)] if None in ids else ids
                     for words, ids in zip(split, found)]
            if len(known) < self.most:
                known.update(fresh)
        return [b"".join(ids) for ids in found]

    def _fresh(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of new words: one pattern search and one call of the model for all of them."""
        if not words:
            return {}
        text, out = b" ".join(words).decode("utf-8", "replace"), {}
        if self.odd.search(text):
            strange = [w for w in words if self.odd.search(w.decode("utf-8", "replace"))]
            for word in strange:
                whole = self.whole.encode(word.decode("utf-8", "replace"), add_special_tokens=False)
                out[word] = np.array(whole.ids, dtype="<u4").tobytes()
            words = words.difference(strange)
            text = b" ".join(words).decode("utf-8", "replace")
        if not words:
            return out
        if not text.isascii():
            text = normalize("NFC", text)
        found = self.pattern.findall(text.lower())
        spelled = [part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
                   for part in found if part != " "]
        ids = np.array(self.pieces.encode_batch_fast([spelled], is_pretokenized=True,
                                                     add_special_tokens=False)[0].ids, dtype="<u4")
        stops = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1]) * 4
        gaps = np.flatnonzero(np.array([part == " " for part in found] + [True]))
        last = stops[gaps - np.arange(len(gaps))].tolist()
        if len(stops) != len(spelled) + 1 or len(gaps) != len(words):
            raise ValueError("the vocabulary lacks a byte")
        packed, begin = ids.tobytes(), 0
        for word, stop in zip(words, last):
            out[word] = packed[begin:stop]
            begin = stop
        return out


def in_chunks(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) of consecutive texts of about ``most`` bytes, one text at least."""
    begin, size = 0, 0
    for at, text in enumerate(texts):
        if size and size + len(text) > most:
            yield begin, texts[begin:at]
            begin, size = at, 0
        size += len(text)
    if begin < len(texts):
        yield begin, texts[begin:]


def encoder(path: str = VOCABULARY) -> WordEncoder:
    """The encoder of this worker process."""
    return kept_in_worker(f"encoder:{path}", lambda: WordEncoder(path))


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level models write for each byte: printable bytes as they are, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}
