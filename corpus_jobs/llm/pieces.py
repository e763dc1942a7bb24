"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch are put one after another, and a suffix array over them is searched for every piece:
each piece's occurrences are one range. The ranges' positions, sorted, are the edges of all words' lattices. They are
relaxed in the model's own order: of the edges that join two neighbouring tokens the best-scored one, leftmost among
equals, is taken, until none is left; characters without a piece fall back to bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import groupby
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_jobs.llm.common import small, stretches, unused

_SPACE = "▁"
_UNITS = re.compile(f"{_SPACE}*[^{_SPACE}\n]+|{_SPACE}+|\n")
_NONE = np.int64(1) << 40
_WORKER: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """The worker's own codec for a model file."""
    if path not in _WORKER:
        _WORKER[path] = PieceCodec(path)
    return _WORKER[path]


class PieceCodec:
    """Encodes and decodes by a SentencePiece BPE model; keeps twice ``keep`` words at most, the latest ones.

    Words of more than ``long`` characters are parted first (see _encode_long), and never kept.
    """

    def __init__(self, path: str, keep: int = 300_000, long: int = 256):
        from sentencepiece import SentencePieceProcessor

        self.model = m = SentencePieceProcessor(model_file=path)
        self.keep, self.long, self.known, self.older = keep, long, {}, {}
        size = m.vocab_size()
        names = [m.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.ids = np.array(plain)
        self.longest = max(len(names[i]) for i in plain)
        self.chars = np.zeros((len(plain), self.longest), np.uint32)
        for row, i in enumerate(plain):
            self.chars[row, : len(names[i])] = np.frombuffer(names[i].encode("utf-32-le"), np.uint32)
        self.lengths = np.array([len(names[i]) for i in plain])
        scores = np.array([m.get_score(i) for i in plain])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        self.of_byte = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = m.unk_id()
        self.bytes_back = all(m.is_byte(i) for i in self.of_byte)
        self.raw = [bytes([int(names[i][3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) else names[i].replace(_SPACE, " ").encode() for i in range(size)]
        self.bounded = not any(_SPACE in names[i].lstrip(_SPACE) or ("\n" in names[i] and len(names[i]) > 1) for i in plain)

    def units(self, text: str) -> list[str]:
        """A text, normalised, in units that no piece crosses."""
        norm = self.model.normalize(text)
        if not self.bounded:
            return [norm] if norm else []
        if _SPACE * 2 in norm or " " in norm:
            return _UNITS.findall(norm)
        return list(filter(None, norm.replace(_SPACE, " " + _SPACE).replace("\n", " \n ").split(" ")))

    def _edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
        """All occurrences of all pieces: piece rows by (position, length - 1), -1 for none; word starts and lengths."""
        joined = "".join(words)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        alphabet, dense = np.unique(codes, return_inverse=True)
        wide = ">u2" if len(alphabet) > 254 else ">u1"
        text = np.zeros(len(codes) + len(words) + self.longest, wide)
        places = np.arange(len(codes)) + np.repeat(np.arange(len(words)), lengths)
        text[places] = dense + 1

        width = -(-self.longest * text.itemsize // 8) * 8  # of a suffix's first characters, in bytes
        rows = np.zeros((len(places), width // text.itemsize), wide)
        for k in range(self.longest):
            rows[:, k] = text[places + k]
        ended = np.logical_or.accumulate(rows == 0, axis=1)
        rows[ended] = 0
        words8 = rows.view(">u8").astype(np.uint64)
        order = np.lexsort(tuple(words8[:, k] for k in range(words8.shape[1] - 1, -1, -1)))
        suffixes = rows[order].view(f"S{width}").ravel()

        at = np.searchsorted(alphabet, self.chars)
        here = alphabet[np.minimum(at, len(alphabet) - 1)] == self.chars
        inside = np.arange(self.longest) < self.lengths[:, None]
        usable = np.flatnonzero((here | ~inside).all(axis=1))
        low = np.zeros((len(usable), width // text.itemsize), wide)
        low[:, : self.longest] = np.where(inside[usable], at[usable] + 1, 0)
        high = low.copy()
        high[:, : self.longest][~inside[usable]] = np.iinfo(wide).max
        high[:, self.longest :] = np.iinfo(wide).max
        begin = np.searchsorted(suffixes, low.view(f"S{width}").ravel(), "left")
        end = np.searchsorted(suffixes, high.view(f"S{width}").ravel(), "right")
        count = end - begin
        piece = np.repeat(usable, count)
        entry = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
        table = np.full((len(text), self.longest), -1, np.int32)
        table[places[order[entry]], self.lengths[piece] - 1] = piece  # the edges, in order of position
        return table, starts, lengths, joined

    def _occurrences(self, text: str, window: int = 65_536) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, length, piece row) of all occurrences in a long text, in order, from overlapping windows."""
        found: tuple[list, list, list] = ([], [], [])
        for at in range(0, len(text), window):
            table = self._edges([text[at : at + window + self.longest - 1]])[0][: min(window, len(text) - at)]
            place, length = np.nonzero(table >= 0)
            for parts, part in zip(found, ((place + at).astype(np.int32), (length + 1).astype(np.int8), table[place, length]), strict=True):
                parts.append(part)
        whole = []
        for parts in found:
            whole.append(np.concatenate(parts))
            parts.clear()
        return tuple(whole)

    def _relax_long(self, place: np.ndarray, size: np.ndarray, piece: np.ndarray, n: int) -> tuple[array, array]:
        """The tokens (position, piece row or -1) of a text of n characters: its edges in order of rank, then position.

        Edges between characters are sorted once; those that appear later wait in a heap. Some 50 bytes a character.
        """
        first = array("i", np.searchsorted(place, np.arange(n + 1)).astype(np.int32).tobytes())
        sizes, pieces, rank = array("b", size.tobytes()), array("i", piece.astype(np.int32).tobytes()), self.rank.tolist()
        pairs = size == 2
        start = np.sort((self.rank[piece[pairs]] << 32) | place[pairs])
        after, before = array("i", range(1, n + 2)), array("i", range(-1, n))  # a token's next and previous one; -1 for none
        heap: list[int] = []

        def known(a: int, length: int) -> int:
            for k in range(first[a], first[a + 1]):
                if sizes[k] == length:
                    return pieces[k]
            return -1

        def offer(a: int) -> None:
            b = after[a]
            if b < n and after[b] - a <= self.longest and (row := known(a, after[b] - a)) >= 0:
                heapq.heappush(heap, rank[row] << 32 | a)

        at = 0
        while at < len(start) or heap:
            if heap and (at == len(start) or heap[0] < start[at]):
                key = heapq.heappop(heap)
            else:
                key, at = int(start[at]), at + 1
            a = key & 0xFFFFFFFF
            b = after[a]
            if b < 0 or b >= n:
                continue
            c = after[b]
            row = known(a, c - a) if c - a <= self.longest else -1
            if row < 0 or rank[row] != key >> 32:
                continue
            after[a], after[b] = c, -1
            if c < n:
                before[c] = a
            if before[a] >= 0:
                offer(before[a])
            offer(a)
        begins, rows = array("i"), array("i")
        a = 0
        while a < n:
            begins.append(a)
            rows.append(known(a, after[a] - a))
            a = after[a]
        return begins, rows

    def _encode_long(self, text: str, group: int = 500_000) -> Iterator[bytes]:
        """The ids of a long unbroken text, in parts.

        It is parted wherever no occurrence of a piece goes across, which changes no id. Parts are words like any other;
        one that is long in spite of that is relaxed by itself.
        """
        place, size, piece = self._occurrences(text)
        wide = size > 1
        cover = np.zeros(len(text) + 1, np.int32)
        np.add.at(cover, place[wide] + 1, 1)
        np.add.at(cover, np.minimum(place[wide] + size[wide], len(text)), -1)
        ends = np.append(np.flatnonzero(np.cumsum(cover, out=cover)[1:-1] <= 0) + 1, len(text)).astype(np.int32)
        del cover, wide
        words, chars, a = [], 0, 0
        for b in (int(x) for x in ends):
            if b - a <= self.long:
                words.append(text[a:b])
                chars += b - a
            if words and (b - a > self.long or chars >= group or b == len(text)):
                yield self._encode_units([words])[0]
                words, chars = [], 0
            if b - a > self.long:
                own = slice(*np.searchsorted(place, (a, b)))
                begins, rows = self._relax_long(place[own] - np.int32(a), size[own], piece[own], b - a)
                out = array("I")
                for k, row in zip(begins, rows, strict=True):
                    out.extend([int(self.ids[row])] if row >= 0 else self._fallback(text[a + k]))
                yield out.tobytes()
            a = b

    def _relax(self, table: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens (position, length) of all words, in order: in each round every word takes its best edge."""
        word = np.repeat(np.arange(len(starts)), lengths)
        begin = np.arange(len(word)) + word if len(word) else word
        size = np.ones(len(word), np.int64)
        done_begin, done_size = [], []
        while len(word):
            joint = size[:-1] + size[1:]
            fits = (word[:-1] == word[1:]) & (joint <= self.longest)
            piece = np.where(fits, table[begin[:-1], np.minimum(joint, self.longest) - 1], -1)
            key = np.append(np.where(piece >= 0, (self.rank[piece] << 32) | np.arange(len(piece)), _NONE << 22), _NONE << 22)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(key, first)
            live = best < _NONE << 22
            left = best[live] & 0xFFFFFFFF
            size[left] += size[left + 1]
            keep = np.ones(len(word), bool)
            keep[left + 1] = False
            active = np.repeat(live, np.diff(np.append(first, len(word))))
            done_begin.append(begin[~active])
            done_size.append(size[~active])
            keep &= active
            word, begin, size = word[keep], begin[keep], size[keep]
        begin, size = np.concatenate(done_begin or [word]), np.concatenate(done_size or [word])
        order = np.argsort(begin, kind="stable")
        return begin[order], size[order]

    def _learn(self, new: list[str]) -> None:
        table, starts, lengths, joined = self._edges(new)
        begin, size = self._relax(table, starts, lengths)
        piece = table[begin, size - 1]
        ids = np.where(piece >= 0, self.ids[piece], -1)
        cuts = np.searchsorted(begin, np.append(starts, len(table)))
        lost = np.flatnonzero(ids < 0)
        raw, flat = ids.astype("<u4").tobytes(), cuts.tolist()
        values = [raw[4 * a : 4 * b] for a, b in zip(flat[:-1], flat[1:], strict=True)]
        for k in np.unique(np.searchsorted(cuts, lost, "right") - 1).tolist():  # words with a character that has no piece
            out: list[int] = []
            for at, i in zip(begin[flat[k] : flat[k + 1]].tolist(), ids[flat[k] : flat[k + 1]].tolist(), strict=True):
                out += [i] if i >= 0 else self._fallback(joined[at - k])
            values[k] = pack(f"<{len(out)}I", *out)
        self.known.update(zip(new, values, strict=True))

    def _fallback(self, char: str) -> list[int]:
        return [self.of_byte[b] for b in char.encode("utf-8", "surrogatepass")] if self.bytes_back else [self.unknown]

    def _encode_units(self, units: list[list[str]], chars: int = 250_000) -> list[bytes]:
        """The ids of lists of words, none of them long; new words are learned in batches of about so many characters."""
        if len(self.known) > self.keep:
            self.known, self.older = {}, self.known
        new = set().union(*units).difference(self.known)
        old = new.intersection(self.older)
        self.known.update((w, self.older[w]) for w in old)
        rest = sorted(new - old)
        for part in stretches(rest, chars):
            self._learn(rest[part])
        return [b"".join(map(self.known.__getitem__, u)) for u in units]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit bytes."""
        units = [self.units(t) for t in texts]
        if all(len(t) <= self.long for t in texts) or all(len(w) <= self.long for u in units for w in u):
            return self._encode_units(units)
        out = []
        for u in units:
            parts = []
            for long, words in groupby(u, lambda w: len(w) > self.long):
                parts += (x for w in words for x in self._encode_long(w)) if long else self._encode_units([list(words)])
            out.append(b"".join(parts))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces in a row, bytes put together, without the space that encoding puts in front."""
        out = b"".join(map(self.raw.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


def _mapped(docs: DataFrame, source: str, fields: list[T.StructField], made) -> DataFrame:
    others = [c for c in docs.columns if c != source and c not in {f.name for f in fields}]
    rows = docs.withColumn(unused(docs, "_in"), F.col(source)).drop(source, *(f.name for f in fields))
    schema = T.StructType([*(rows.schema[c] for c in others), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            k = batch.num_columns - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *made(batch.column(k).to_pylist())], names=schema.names)

    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, model: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the text replaced by its ids, an array of int (null text: as empty, no ids).

    A column named ``out`` is replaced, all others stay; repeated rows stay repeated, an empty table empty. Whole texts
    are encoded: a word without a break of ten million letters takes a worker some 500 MB, one of equal letters 1.2 GB.
    """
    def made(texts: list[str | None]) -> list[pa.Array]:
        c = codec(model)
        found = [x for s in stretches(texts) for x in c.encode([t or "" for t in texts[s]])]
        return [pa.array([np.frombuffer(x, "<i4") for x in found], pa.list_(pa.int32()))]

    return _mapped(docs, text, [T.StructField(out, T.ArrayType(T.IntegerType()))], made)


def decode(rows: DataFrame, model: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with the ids replaced by their text (null ids: empty); a column named ``out`` is replaced, all others stay.

    Lists of any length are decoded whole; repeated rows stay repeated, an empty table empty.
    """
    def made(lists: list[list[int] | None]) -> list[pa.Array]:
        c = codec(model)
        return [pa.array([c.decode(pack(f"<{len(x or [])}I", *(x or []))) for x in lists], pa.string())]

    return _mapped(rows, ids, [T.StructField(out, T.StringType())], made)


def digests(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with the text replaced by n_tokens, ids_crc32, and the decoded text's chars and sha256, in one pass.

    Nulls, repeated rows, very long texts and an empty table are as in encode. Columns of these four names are replaced.
    """
    def made(texts: list[str | None]) -> list[pa.Array]:
        c, n, crc, chars, sha = codec(model), [], [], [], []
        for s in stretches(texts):
            for ids in c.encode([t or "" for t in texts[s]]):
                back = c.decode(ids)
                n.append(len(ids) // 4)
                crc.append(zlib.crc32(ids))
                chars.append(len(back))
                sha.append(hashlib.sha256(back.encode()).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(chars, pa.int64()), pa.array(sha, pa.string())]

    fields = [T.StructField(x, T.LongType()) for x in ("n_tokens", "ids_crc32", "decoded_chars")] + [T.StructField("decoded_sha256", T.StringType())]
    return _mapped(docs, text, fields, made)
