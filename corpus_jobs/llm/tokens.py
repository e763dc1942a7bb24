"""Token ids of whole texts, for tasks on executors: a worker tokenises words it has seen lately only once."""

from __future__ import annotations

import os
import unicodedata
from struct import pack

_WORKER: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's own WordIds for a tokenizer file; it lives as long as the worker."""
    if path not in _WORKER:
        _WORKER[path] = WordIds(path)
    return _WORKER[path]


def _composed(text: str) -> bool:
    return unicodedata.is_normalized("NFC", text)


def _letters_only(text: str) -> bool:
    """Whether lower-casing and normalising a text leave it as it is, letters only."""
    return _composed(text) and (low := text.lower()).isalpha() and _composed(low)


class _Spelling(dict):
    """How the tokenizer's splitter spells a letter for its model, asked for once."""

    def __init__(self, tokenizer):
        self.splitter = tokenizer.pre_tokenizer

    def __missing__(self, code: int) -> str:
        self[code] = "".join(part for part, _ in self.splitter.pre_tokenize_str(chr(code))) if self.splitter else chr(code)
        return self[code]


class WordIds:
    """Ids of texts by a tokenizer file, as little-endian unsigned 32-bit bytes.

    Where the tokenizer drops white space and never joins across it, a text's ids are those of its words one after
    another; twice ``keep`` words at most are then kept, the latest ones. For other tokenizers whole texts are encoded.
    """

    def __init__(self, path: str, keep: int = 350_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.known: dict[bytes, bytes] = {}  # by a word's UTF-8
        self.older: dict[bytes, bytes] = {}
        plain = self._encode(["Ab, c", "Ab,", "c", " Ab,\n\tc "])
        self.by_word = plain[0] == plain[1] + plain[2] == plain[3]
        self.folds = self._encode(["ABÉ"]) == self._encode(["abé"])
        apart = [c for c in '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~' if self._encode([f"ab{c}{c}é{c}"]) == self._encode([f"ab {c}{c} é {c}"])]
        self.marks = "".join(apart).encode()  # what the splitter parts from letters
        self.spelt = _Spelling(self.tokenizer)
        tried = ["a", "ab", "heather", "thnttionwh", "zzzqqxj", "éauouon", "straße", "ñ", "данные", "日本語"]
        self.direct = self.folds and [self._letters(x) for x in tried] == self._encode(tried)

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [pack(f"<{len(x.ids)}I", *x.ids) for x in found]

    def _letters(self, word: str) -> bytes:
        """The ids of a word of lower-case letters, as the model gives them without normaliser and splitter."""
        ids = [t.id for t in self.tokenizer.model.tokenize(word if word.isascii() else word.translate(self.spelt))]
        return pack(f"<{len(ids)}I", *ids)

    def _words(self, text: str) -> list[bytes]:
        # capital sigma folds by context in Python only; a text that isn't NFC, or no longer, would be composed after the fold
        if self.folds and "Σ" not in text and _composed(text) and _composed(low := text.lower()):
            text = low
        return text.encode().split()  # of bytes: at ASCII white space only

    def _learn(self, new: set[bytes]) -> None:
        """Add words to the known ones; letters with marks behind them are the letters and the marks.

        Letters that normalising or lower-casing takes apart give marks that would go with those behind them.
        """
        ends = {w: root for w in new if (root := w.rstrip(self.marks)) != w and _letters_only(root.decode())}
        parts = {part for w, root in ends.items() for part in (root, w[len(root) :])}
        unknown = []
        for w in new.difference(ends).union(parts):
            if w in self.known:
                continue
            if w in self.older:
                self.known[w] = self.older[w]
            elif self.direct and (text := w.decode()).isalpha() and text == text.lower() and _composed(text):
                self.known[w] = self._letters(text)
            else:
                unknown.append(w)
        for at in range(0, len(unknown), 20_000):
            part = unknown[at : at + 20_000]
            self.known.update(zip(part, self._encode([w.decode() for w in part]), strict=True))
        for w, root in ends.items():
            self.known[w] = self.known[root] + self.known[w[len(root) :]]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._encode(texts)
        words = [self._words(t) for t in texts]
        if len(self.known) > self.keep:
            self.known, self.older = {}, self.known
        self._learn(set().union(*words).difference(self.known))
        return [b"".join(map(self.known.__getitem__, ws)) for ws in words]

