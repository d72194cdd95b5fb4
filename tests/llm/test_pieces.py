import pyarrow as pa

from quarry.llm.tokens import pieces


def test_pieces_hold_some_bytes_each():
    texts = ["a" * 10, None, "b" * 95, "", "c" * 200, "d"]
    lists = [[b"x" * 50, None], None, [], [b"y" * 60], [b"z" * 300], [b""]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts), pa.array(lists, pa.list_(pa.binary()))], names=["n", "text", "parts"])
    of = lambda b, column: [p.column(0).to_pylist() for p in pieces(b, column, 100)]
    assert of(batch, 1) == [[0, 1], [2, 3], [4], [5]]
    assert of(batch, 2) == [[0, 1, 2], [3], [4], [5]]
    # of a slice, and of nothing
    assert of(batch.slice(2), 1) == [[2, 3], [4], [5]] and of(batch.slice(3), 2) == [[3], [4], [5]]
    assert of(batch.slice(6), 1) == [] and of(batch.slice(6), 2) == []
