import random
import zlib
from collections import defaultdict

import pytest

from quarry.llm.lines import rolled, told, without_repeats


def brute(rows, long=50, spare=None):
    """doc_id and text to the text that is left: lines in pairs that stood before go, and so do long lines that did."""
    seen, out = set(), {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, hashes[r[1]])):
        if text is None:
            out[doc, text] = None
            continue
        lines, pairs = text.split("\n"), set()
        gone = [False] * len(lines)
        for k, line in enumerate(lines):
            if k + 1 < len(lines) and (line.strip() or lines[k + 1].strip()):
                if (line, lines[k + 1]) in seen:
                    pairs.add(k)
                seen.add((line, lines[k + 1]))
            if len(line.split()) >= long:
                gone[k] = line in seen
                seen.add(line)
        for k in pairs:
            gone[k + 1] = True
            gone[k] |= k - 1 in pairs or k == 0 or not lines[k - 1] == lines[k] == lines[k + 1]
        left = []
        for k, line in enumerate(lines):
            if not line.strip():  # blank lines go with their neighbours
                a, b = k, k
                while a >= 0 and not lines[a].strip():
                    a -= 1
                while b < len(lines) and not lines[b].strip():
                    b += 1
                if gone[k] or a >= 0 and b < len(lines) and gone[a] and gone[b]:
                    continue
            elif gone[k]:
                continue
            left.append(line)
        words = len(text.split())
        whole = spare is not None and 100 * (words - len(" ".join(left).split())) >= spare * words
        out[doc, text] = "\n".join(left) if any(gone) and not whole else text
    return out


hashes: dict = {}


def hashed(docs):
    hashes.update({r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) as h").collect()})


@pytest.mark.parametrize("seed, spare", [(0, None), (1, 85), (2, 50)])
def test_equals_brute_force(spark, seed, spare):
    rng = random.Random(seed)
    lines = [f"line {i} of all" for i in range(400)] + [""]
    passage = [f"shared {i}" for i in range(20)]
    long = " ".join(f"w{i}" for i in range(60))
    rows = []
    for i in range(120):
        text = [rng.choice(lines) for _ in range(rng.choice([0, 1, 3, 12, 40]))]
        if i % 3 == 0:
            at = rng.randint(0, len(text))
            text[at:at] = passage
        if i % 7 == 0:
            text.insert(rng.randint(0, len(text)), long)
        rows.append((i if i % 17 else None, "\n".join(text)))
        if i % 10 == 0:
            rows.append((1000 + i, rows[-1][1]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hashed(docs)
    want = brute(rows, spare=spare)
    got = without_repeats(docs, spare=spare).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(d), want[d, t]) for d, t in rows)
    if spare is None:
        assert sum("shared 10" in r.text for r in got) == 1 and sum(long in r.text for r in got) == 1


def test_chunks_survive_shifts():
    rng = random.Random(9)
    body = [str(rng.random()) for _ in range(300)]
    one, two = ({d for _, d in rolled("\n".join(x))} for x in (body, ["x", "y", "z", *body]))
    assert one <= two and rolled(None) == rolled("one") == rolled("\n\n") == []
    assert [k for k, _ in rolled("a\nb\n" + "w " * 50)] == [0, 2, 5]


def test_defined_cases(spark, docs, no_docs):
    got = without_repeats(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))
    rows = {r.doc_id: r for r in told(docs).collect()}
    assert rows[4].n_lines == 0 and rows[6].n_lines == 3 and rows[6].n_removed == 0
    assert rows[6].kept_crc32 == zlib.crc32("ünï çödé \U0001f600 text\nwith lines\nand more".encode())
    assert without_repeats(no_docs).collect() == [] and told(no_docs).collect() == []


def test_repeated_rows_are_one_document(spark):
    text = "\n".join(f"l{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    by = defaultdict(list)
    for r in without_repeats(docs).collect():
        by[r.doc_id].append(r.text)
    assert by[1] == [text, text] and by[2] == [""]
