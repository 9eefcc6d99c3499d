"""Copies in parts, broken off and gone on with."""

import hashlib
import random

import pytest

from moodtide.sources import transfer


@pytest.fixture
def source(tmp_path):
    r = random.Random(1)
    for name, n in (("a.bin", 1_000_003), ("b/c.bin", 10), ("b/d.bin", 200_000), ("e.bin", 0)):
        (tmp_path / "from" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "from" / name).write_bytes(r.randbytes(n))
    return tmp_path / "from"


def tree(folder):
    return {str(f.relative_to(folder)): hashlib.sha256(f.read_bytes()).hexdigest() for f in folder.rglob("*") if f.is_file() and not f.name.endswith(".crc")}


def test_files_in_parts(spark, source, tmp_path):
    rows = {r["file"]: r for r in transfer.transfer(spark, str(source), str(tmp_path / "to"), 100_000).collect()}
    (source / "e.bin").unlink()  # an empty file isn't copied
    assert tree(source) == tree(tmp_path / "to") == {k: r["checksum"] for k, r in rows.items()}
    assert {k: (r["parts"], r["copied"]) for k, r in rows.items()} == {"a.bin": (11, 11), "b/c.bin": (1, 1), "b/d.bin": (2, 2)}


def test_a_copy_goes_on(spark, source, tmp_path, monkeypatch):
    target = tmp_path / "to"
    real = transfer._committed
    monkeypatch.setattr(transfer, "_committed", lambda t: lambda b: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(Exception, match="lost"):
        transfer.transfer(spark, str(source), str(target), 100_000)
    assert tree(target) and not (target / "a.bin").exists()  # parts, and no file
    gone = sorted((target / "_parts").glob("*-000003"))[0]
    gone.unlink()
    monkeypatch.setattr(transfer, "_committed", real)
    rows = {r["file"]: r["copied"] for r in transfer.transfer(spark, str(source), str(target), 100_000).collect()}
    (source / "e.bin").unlink()
    assert rows == {"a.bin": 1, "b/c.bin": 0, "b/d.bin": 0} and tree(source) == tree(target)


def test_a_part_that_differs_is_no_file(spark, source, tmp_path, monkeypatch):
    target = tmp_path / "to"
    real = transfer._copied

    def spoiled(t):
        inner = real(t)

        def run(batches):
            for b in inner(batches):
                for f in (target / "_parts").glob("*-000001"):
                    f.write_bytes(b"x" * f.stat().st_size)
                yield b

        return run

    monkeypatch.setattr(transfer, "_copied", spoiled)
    with pytest.raises(Exception, match="differs from what was read"):
        transfer.transfer(spark, str(source), str(target), 100_000)
    assert not (target / "a.bin").exists()
