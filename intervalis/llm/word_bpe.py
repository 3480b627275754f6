"""Token ids of a BPE vocabulary with word ends, word by word.

The tokenizer's file folds case, drops blanks and splits a text into words that
it encodes one by one. A word's ids are therefore looked up in a bounded table
and otherwise come from a faster library, which gets the vocabulary as ranks of
byte strings in which a byte that UTF-8 never holds stands for a word's end.
Texts with characters on which the two libraries' character classes might
differ, or with the string of a special token, take the file's own rules.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np

#: The file's split into contractions, letters, single digits and marks, for folded text of ASCII and of _PLAIN.
_ASCII_WORDS = re.compile(r"[a-z]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\sa-z0-9]+", re.ASCII)
_WORDS = re.compile(r"[^\W\d_²³¹¼½¾]+|'(?:[stmd]|re|ve|ll)|[\d²³¹¼½¾]|(?:[^\w\s]|_)+")
_END = "</w>"
#: Characters of Latin, Greek, Cyrillic and the common signs, without separators of ASCII.
_PLAIN = re.compile("[\t-\r -~ -ɏΑ-ΡΤ-ϿЀ-џ‐-‧‰-⁞]*")
#: A long text is encoded in segments that begin behind a blank.
SEGMENT = 1 << 20
_CUT = re.compile(r"[ \t\n\r](?=[A-Za-z0-9])")
#: Words whose ids are remembered.
REMEMBERED = 1 << 18


class WordEncoder:
    """Ids of whole texts, as the tokenizer file gives them."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        from intervalis.llm.harmonic_packing import shown_bytes

        self.whole = Tokenizer.from_file(path)
        added = self.whole.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        byte_of = shown_bytes()
        ranks = {}
        for word, i in self.whole.get_vocab(with_added_tokens=False).items():
            if i not in added:
                body = word.removesuffix(_END)
                ranks[bytes(byte_of[c] for c in body) + b"\xff" * (body != word)] = i
        self.ranks, fast = ranks, tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})

        class Table(dict):
            def __missing__(self, word: str) -> bytes:
                ids = fast._encode_single_piece(word.encode() + b"\xff")
                ids = struct.pack(f"<{len(ids)}I", *ids)
                if len(self) >= REMEMBERED:
                    self.clear()
                self[word] = ids
                return ids

        self.table = Table()

    def _segments(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > SEGMENT and (at := _CUT.search(text, start + SEGMENT)):
            yield text[start : at.end()]
            start = at.end()
        yield text[start:]

    def parts(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a text, segment by segment."""
        if any(s in text for s in self.special):
            yield np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
            return
        for part in self._segments(text):
            if part.isascii() and _PLAIN.fullmatch(part):
                words = _ASCII_WORDS.findall(part.lower())
            elif _PLAIN.fullmatch(part := unicodedata.normalize("NFC", part)):
                words = _WORDS.findall(part.lower())
            else:
                yield np.array(self.whole.encode(part, add_special_tokens=False).ids, dtype=np.uint32)
                continue
            yield np.frombuffer(b"".join(map(self.table.__getitem__, words)), dtype="<u4")
