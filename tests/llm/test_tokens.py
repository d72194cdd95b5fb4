import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm.queries import vocabulary
from quarry.llm.tokens import Encoder, Memo, together

PARTS = ["ab", "Cd", " ", "  ", "\n", "\n\n", "\t", "1", ".", ",", "'s", "'ll", "'", " x", "\r\n", "<|endoftext|>", "_a-b "]
#: Control characters, letters, marks, digits, quotes, and white space and invisible ones of two, three and four bytes.
PARTS += map(chr, [0x00, 0x1C, 0x7F, 0x85, 0xA0, 0xA1, 0xAD, 0xB2, 0xDF, 0xE9, 0x301, 0x661, 0x1680, 0x180E, 0x2003, 0x200B, 0x2010, 0x201C, 0x201D, 0x2026, 0x2028, 0x202F, 0x205F, 0x2060, 0x3000, 0x3001, 0x5B57, 0xD7A3, 0xE000, 0xFB01, 0xFEFF, 0x1F600, 0x10FFFF])


@pytest.mark.parametrize("memo", [0, 8, 600_000])
def test_ids_of_whole_texts_whatever_the_marks(memo):
    encoder, rng = Encoder(vocabulary(), memo=memo), random.Random(memo)
    for size in (1, 3, 30):
        texts = [None, "", *("".join(rng.choices(PARTS, k=rng.randint(0, size))) for _ in range(1500))]
        want = [encoder.raw(t or "") for t in texts]
        for given in (texts, pa.array([None, *texts], pa.string()).slice(1)):
            assert [np.frombuffer(x, "<u4").tolist() for x in encoder.many(given)] == want


def test_a_word_is_encoded_once_whatever_stands_around_it():
    encoder = Encoder(vocabulary())
    asked, plain = [], encoder.memo.encode
    encoder.memo.encode = lambda new: asked.extend(new.to_pylist()) or plain(new)
    for text in ("so zubble, zubble. zubble", "so zubble; zubble!\nzubble"):
        assert np.frombuffer(encoder.many([text])[0], "<u4").tolist() == encoder.raw(text)
    assert asked == ["so", " zubble", ",", ".", ";", "!", "\n", "zubble"]


def test_memo_keeps_what_was_seen_last():
    memo = Memo(lambda new: pa.array([[len(x), 7] for x in new.to_pylist()], pa.large_list(pa.uint32())), limit=3, letters=10)
    strings = lambda *x: pa.array(x, pa.large_string())
    assert memo.of(strings("a", "bb", "c" * 201)).to_pylist() == [[1, 7], [2, 7], [201, 7]]
    assert memo.seen.to_pylist() == ["a", "bb"]
    assert memo.of(strings("dd", "bb")).to_pylist() == [[2, 7], [2, 7]]
    assert memo.seen.to_pylist() == ["dd", "bb", "a"] and memo.ids.to_pylist() == [[2, 7], [2, 7], [1, 7]]
    memo.of(strings("eeee"))
    assert memo.seen.to_pylist() == ["eeee", "dd", "bb"]
    memo.of(strings("fffff"))
    assert memo.seen.to_pylist() == ["fffff", "eeee"]


def test_batches_are_cut_and_joined():
    texts = ["x" * 100, None, "", "y" * 5000, "z"] * 20
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 4)), pa.array(texts[k : k + 4])], names=["i", "text"]) for k in range(0, 100, 4)]
    got = list(together(iter(batches), 1, 2000))
    assert [r for b in got for r in b.column(1).to_pylist()] == texts and [r for b in got for r in b.column(0).to_pylist()] == list(range(100))
    assert 20 < len(got) < 50 and list(together(iter([]), 1)) == []
