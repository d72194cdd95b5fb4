"""Token ids of whole texts by the tokenizers library.

A byte-level BPE vocabulary encodes the stretches between word boundaries one by one, so texts are cut where there always is
one, each distinct stretch is looked up once in a column of those seen before, and what is new is encoded in one go. The
memo is bounded, lives as long as its worker, and forgets what was seen longest ago, which changes no result.
"""

from __future__ import annotations

import os
from string import ascii_letters, punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct stretches that a worker remembers, and how many of their bytes: about 60 MB at most.
MEMO, LETTERS = 600_000, 8_000_000
#: Bytes of texts that are cut and looked up at once.
AT_ONCE = 24_000_000
#: New stretches that the library gets as one text.
TOGETHER = 200
#: What is no white space to any splitter; such stretches, with a blank before them or none, may stand in one text with others.
PLAIN = "^ ?[!-~\u00a1-\u167f\u2010-\u2027\u2030-\u205e\u3001-\ud7ff]+$"


def table(*kinds: bytes) -> bytes:
    """For each byte one bit for every kind that it is of."""
    return bytes(sum((x in members) << k for k, members in enumerate(kinds)) for x in range(256))


SOLID = bytes(range(0x21, 0x7F))
#: A cut lies between two bytes with a common bit: no piece goes on with a blank or a line end behind another character, nor with a mark behind a letter.
BEFORE, AFTER = table(SOLID, ascii_letters.encode()), table(b" \n", punctuation.encode())
#: First bytes of characters that can't be white space.
FIRST = np.frombuffer(table(SOLID + bytes([*range(0xC3, 0xE1), *range(0xE4, 0xEE), *range(0xF0, 0xF5)])), np.uint8)
#: Ranges of longer characters that are white space or invisible, from the first to before the last.
UNSEEN = np.array([0x80, 0xA1, 0x1680, 0x1681, 0x180B, 0x180F, 0x2000, 0x2010, 0x2028, 0x2030, 0x205F, 0x2070, 0x3000, 0x3001, 0xFEFF, 0xFF00])


def cuts(text: bytes, starts: np.ndarray) -> np.ndarray:
    """Where stretches start in the UTF-8 bytes of texts that lie one behind the other."""
    data, after = np.frombuffer(text, np.uint8), np.frombuffer(text.translate(AFTER), np.uint8)
    here = np.zeros(len(data), bool)
    np.not_equal(np.frombuffer(text.translate(BEFORE), np.uint8)[:-1] & after[1:], 0, out=here[1:])
    # behind a longer character: its code point tells
    blank = np.flatnonzero((after[1:] == 1) & (data[:-1] >= 0x80)) + 1
    last = [data[np.maximum(blank - n, 0)].astype(np.int64) for n in (1, 2, 3)]
    tail = last[0] & 63 | (last[1] & 63) << 6
    point = np.where(last[1] >= 0xC0, last[0] & 63 | (last[1] & 31) << 6, np.where(last[2] >= 0xE0, tail | (last[2] & 15) << 12, 1 << 16))
    here[blank] = np.searchsorted(UNSEEN, point, "right") % 2 == 0
    here[starts[starts < len(data)]] = True
    # a line end between two characters is a piece of its own
    line = np.flatnonzero(data[:-1] == 10)
    line = line[here[line] & (FIRST[data[line + 1]] > 0)]
    here[line + 1] = True
    return np.flatnonzero(here)


class Memo:
    """Distinct stretches and their ids in two columns, those seen last at the front."""

    def __init__(self, encode, limit: int, letters: int = LETTERS):
        self.encode, self.limit, self.letters = encode, limit, letters
        self.seen, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_list(pa.uint32()))

    def of(self, stretches: pa.Array) -> pa.Array:
        """The ids of each; stretches should be distinct."""
        at = pc.index_in(stretches, value_set=self.seen)
        new = at.is_null()
        at = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        old = np.ones(len(self.seen), bool)
        if len(old):
            old[at[~new.to_numpy(zero_copy_only=False)]] = False
        missing = stretches.filter(new)
        at[new.to_numpy(zero_copy_only=False)] = len(old) + np.arange(len(missing))
        found = pa.concat_arrays([self.ids, self.encode(missing)]).take(pa.array(at))
        short, old = pc.less_equal(pc.binary_length(stretches), 200), pa.array(old)
        seen = pa.concat_arrays([stretches.filter(short), self.seen.filter(old)])
        size = np.cumsum(pc.binary_length(seen).to_numpy(zero_copy_only=False))
        keep = min(self.limit, int(np.searchsorted(size, self.letters, "right")))
        ids = pa.concat_arrays([found.filter(short), self.ids.filter(old)])
        if keep < len(seen):  # a slice would hold the whole column
            seen, ids = (pa.concat_arrays([x.slice(0, keep), x.slice(0, 0)]) for x in (seen, ids))
        self.seen, self.ids = seen, ids
        return found


class Encoder:
    """Texts to their ids, as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: str, memo: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        # ids that begin with a blank, and the line end
        blank = self.tokenizer.pre_tokenizer.pre_tokenize_str(" a")[0][0][:-1]
        names = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(names.values()) + 1, bool)
        self.begins[[i for name, i in names.items() if name.startswith(blank)]] = True
        (self.line_end,) = self.raw("\n")
        self.begins[self.line_end] = True
        self.memo = Memo(self.encode, memo)

    def raw(self, text: str) -> list[int]:
        """The library's ids of a whole text."""
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, stretches: pa.Array) -> pa.Array:
        """Plain ones stand in common texts, where a blank or a line end begins each; the others are encoded one by one."""
        plain = pc.match_substring_regex(stretches, PLAIN)
        alone = [self.raw(x) for x in stretches.filter(pc.invert(plain)).to_pylist()]
        words = [w if w[0] == " " else "\n" + w for w in stretches.filter(plain).to_pylist()]
        texts = ["".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.uint32), *ids])
        first = np.flatnonzero(self.begins[ids])
        if len(first) != len(words):
            raise ValueError("stretches can't be told apart in a common text")
        kept = ids != self.line_end
        sizes, n = np.empty(len(stretches), np.int64), plain.to_numpy(zero_copy_only=False)
        sizes[n] = np.add.reduceat(kept, first, dtype=np.int64) if len(first) else 0
        sizes[~n] = list(map(len, alone))
        # both kinds one behind the other, then in the stretches' order
        at = np.concatenate(([0], np.cumsum(np.concatenate((sizes[n], sizes[~n])))))
        flat = np.concatenate([ids[kept], *(np.array(x, np.uint32) for x in alone)])
        order = np.empty(len(stretches), np.int64)
        order[np.concatenate((np.flatnonzero(n), np.flatnonzero(~n)))] = np.arange(len(stretches))
        return pa.LargeListArray.from_arrays(at, flat).take(pa.array(order))

    def many(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Ids of texts: each distinct stretch among them is looked up once, and a column of stretches becomes a column of ids."""
        texts = pc.fill_null(texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), "")
        ends = np.cumsum(np.concatenate(([0], pc.binary_length(texts).to_numpy(zero_copy_only=False))), dtype=np.int64)
        if not ends[-1]:
            return [b""] * len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)
        data = texts.buffers()[2].slice(int(offsets[texts.offset]), int(ends[-1]))
        starts = cuts(data.to_pybytes(), ends[:-1])
        stretches = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, ends[-1])), data)
        coded = stretches.dictionary_encode()
        known = self.memo.of(coded.dictionary)
        sizes = known.value_lengths().to_numpy(zero_copy_only=False)
        flat = memoryview(known.take(coded.indices).flatten().to_numpy().tobytes())
        at = np.concatenate(([0], np.cumsum(sizes[coded.indices.to_numpy(zero_copy_only=False)])))[np.searchsorted(starts, ends)] * 4
        return [bytes(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


_kept: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One in each worker process, until a task of another kind starts there."""
    if vocabulary not in _kept:
        _kept.clear()
        _kept[vocabulary] = Encoder(vocabulary)
    return _kept[vocabulary]


def release() -> None:
    """Forgets the encoder: Spark gives a worker the tasks of other operators too, and those need the memory."""
    _kept.clear()


def sliced(texts: pa.Array, size: int = 8_000_000):
    """First row and texts of runs of rows with about so many bytes: what a task holds as Python strings at once stays small."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if len(texts) else np.zeros(0, np.int64)
    start = 0
    while start < len(texts):
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield start, texts.slice(start, end - start).to_pylist()
        start = end


def pieces(batch: pa.RecordBatch, column: int, size: int = 8_000_000):
    """Slices of a batch with about so many bytes of a text or binary column, or of a column of lists of them; one row at least."""
    values = batch.column(column)
    if pa.types.is_list(values.type):
        lengths = pc.fill_null(pc.binary_length(values.flatten()), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if len(values) else np.zeros(0, np.int64)
        ends = np.concatenate(([0], np.cumsum(lengths)))[ends]
    else:
        ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if len(values) else np.zeros(0, np.int64)
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(start, end - start)
        start = end


def together(batches, column: int, size: int = AT_ONCE):
    """Batches with about so many bytes of a text column, cut or joined from those that come; a row counts for 32 bytes at least."""
    held, full = [], 0
    for piece in (x for batch in batches for x in pieces(batch, column, size)):
        here = 32 * piece.num_rows + (pc.sum(pc.binary_length(piece.column(column))).as_py() or 0)
        if held and full + here > size:
            yield pa.concat_batches(held)
            held, full = [], 0
        held.append(piece)
        full += here
    if held:
        yield pa.concat_batches(held)
