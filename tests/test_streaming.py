from sectorloom.functions.scalar import SIGNATURES
from sectorloom.streaming.arrivals import arriving_segments


def test_arrivals(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for i, h in enumerate(SIGNATURES):
        (inbox / f"{i}.bin").write_bytes(bytes.fromhex(h) + b"rest")
    (inbox / "other.bin").write_bytes(b"x")
    run = arriving_segments(spark, str(inbox)).writeStream.format("memory").queryName("arrivals").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        run.processAllAvailable()
        (inbox / "late.bin").write_bytes(bytes.fromhex(next(iter(SIGNATURES))))
        run.processAllAvailable()
        got = {r["path"].rsplit("/", 1)[1]: r["family"] for r in spark.table("arrivals").collect()}
    finally:
        run.stop()
    assert got == {"0.bin": "EWF1", "1.bin": "L01", "2.bin": "EWF2", "3.bin": "LEF2", "other.bin": None, "late.bin": "EWF1"}
