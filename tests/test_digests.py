"""BLAKE3 of many payloads at a time."""

from quern.functions import evidence

SIZES = [0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3072, 5000, 8193, 0, 40_000]


def test_payloads_are_digested_side_by_side(monkeypatch):
    calls, compress = [], evidence._compress
    monkeypatch.setattr(evidence, "_compress", lambda *a: (calls.append(len(a[0])), compress(*a))[1])
    payloads = [bytes(i % 251 for i in range(n)) for n in SIZES] * 20
    alone = [evidence.blake3(p) for p in payloads[: len(SIZES)]]
    assert alone[7] == "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"
    calls.clear()
    assert evidence.blake3_groups(payloads) == alone * 20
    assert len(calls) <= 16 + 6  # blocks of a chunk and levels of the largest tree, not those of each payload
    monkeypatch.setattr(evidence, "SIDE_BY_SIDE", 3000)
    assert evidence.blake3_groups(payloads) == alone * 20
    assert max(calls[22:]) < 64 and evidence.blake3_groups([]) == []


def test_null_payloads_have_no_digest(spark):
    rows = [(0, bytearray(b"abc")), (1, None), (2, bytearray()), (3, bytearray(b"a" * 3000))]
    df = spark.createDataFrame(rows, "n int, p binary").coalesce(1)
    got = {r["n"]: r["d"] for r in df.select("n", evidence.blake3_hex(df["p"]).alias("d")).collect()}
    assert got == {n: None if p is None else evidence.blake3(bytes(p)) for n, p in rows}
