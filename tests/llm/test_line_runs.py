import random
import zlib

import pytest

from quarry.llm.lines import lines_left, told


def brute(texts):
    """Texts in order of doc_id to their lines left: every stretch of two lines and more that occurred before goes."""
    seen, out = set(), []
    for text in texts:
        lines = text.split("\n")
        gone = set()
        for a in range(len(lines) - 1):
            b = a + 2
            while b <= len(lines) and tuple(lines[a:b]) in seen:
                gone |= set(range(a, b))
                b += 1
            seen.add(tuple(lines[a : a + 2]))
        for a in range(len(lines)):
            seen |= {tuple(lines[a:b]) for b in range(a + 2, len(lines) + 1)}
        out.append([x for i, x in enumerate(lines) if i not in gone])
    return out


@pytest.mark.parametrize("size", [2, 3, 5, 6, 10])
def test_whole_runs_go_in_any_context(spark, size):
    rng = random.Random(size)
    passages = [[f"passage {p} line {i}" for i in range(size)] for p in range(10)]
    texts = []
    for n in range(60):
        text = [f"own {n} {i}" for i in range(rng.randint(0, 9))]
        at = rng.randint(0, len(text))
        text[at:at] = passages[n % 10]
        texts.append("\n".join(text))
    want = brute(texts)
    got = {r.doc_id: r for r in told(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for n, kept in enumerate(want):
        assert got[n].kept_crc32 == zlib.crc32("\n".join(kept).encode())
        assert got[n].n_removed == (n >= 10) and got[n].n_kept_lines == len(kept)
        assert n < 10 or not any("passage" in x for x in kept)


def test_runs_of_common_lines(spark):
    rng = random.Random(4)
    texts = ["\n".join(f"line {rng.randrange(12)}" for _ in range(rng.randint(1, 9))) for _ in range(80)]
    texts = [t for t in texts if all(a != b for a, b in zip(t.split("\n"), t.split("\n")[1:])) and len(set(t.split("\n"))) == t.count("\n") + 1]
    got = {r.doc_id: r.kept_crc32 for r in told(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[n] for n in range(len(texts))] == [zlib.crc32("\n".join(x).encode()) for x in brute(texts)]


def test_overlaps_and_blank_lines():
    assert lines_left("a\na\na\na\nb", {2, 4}) == (["a", "a", "b"], 3, 1)
    assert lines_left("a\na\na", {0, 2}) == ([], 1, 1)
    assert lines_left("x\na\n\n\nb\ny", {2, 6}) == (["x", "y"], 3, 1)
    assert lines_left("one", set()) == (["one"], 1, 0)
