import numpy as np
import pyarrow as pa

from lectern.llm import ctw


def test_counts_of_a_block(monkeypatch):
    """Runs merged range by range give what counting at once gives."""
    monkeypatch.setattr(ctw, "SORTED", 500)
    r = np.random.default_rng(5)
    codes, train = r.integers(0, 9000, 20_000).astype(np.uint64) << np.uint64(50), r.random(20_000) < 0.8
    counts = ctw.Counts()
    for a in range(0, len(codes), 170):
        counts.add(codes[a : a + 170], train[a : a + 170])
    parts = list(counts.whole())
    every, where = np.unique(codes, return_inverse=True)
    assert (np.concatenate([c for c, _ in parts]) == every).all()
    assert (np.concatenate([n for _, n in parts]) == np.bincount(where, train)).all()
    assert max(len(c) for c, _ in parts) < 5 * 500
    assert list(ctw.Counts().whole()) == []


def test_rows_of_counts_are_short(monkeypatch):
    """Spark reads 4,096 rows of a Parquet table at once: these are a few million numbers, however large the files are."""
    import pyspark

    class Here:
        get = classmethod(lambda cls: cls)
        partitionId = classmethod(lambda cls: 3)

    monkeypatch.setattr(pyspark, "TaskContext", Here)
    texts = [np.random.default_rng(i).integers(97, 123, 3000, dtype=np.uint8).tobytes() for i in range(50)]
    batch = pa.RecordBatch.from_pydict({"key": pa.array(range(50)), "held_out": pa.array([False] * 50), "body": pa.array(texts)})
    out = list(ctw._blocks(iter([batch]), 60_000))
    sizes = [len(x) for b in out for x in b["code"].to_pylist() if x is not None]
    assert sum(sizes) > 100_000 and max(sizes) * 4096 <= 1 << 22
    assert {len(b["block"].unique()) for b in out} == {1} and len({b["block"][0].as_py() for b in out}) == 3


def test_index_keys_are_not_written(spark, monkeypatch):
    from lectern.llm import common, spotsigs

    seen = []
    kept = common.Scratch.write
    monkeypatch.setattr(common.Scratch, "write", lambda self, df, label: seen.append((label, df.columns)) or kept(self, df, label))
    rows = [(i, "the " + " the ".join(f"w{j} v{j}" for j in range(i % 4, 40 + i % 4))) for i in range(12)]
    got = {r.doc_id: r.component_id for r in spotsigs.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict.fromkeys(range(12), 0)
    # Keys for partitions take twice the room of the prefixes they are made of.
    columns = dict(seen)
    assert "prefix" in columns["sets"] and "prefix" in columns["classes"] and not any("keys" in c for c in columns.values())
