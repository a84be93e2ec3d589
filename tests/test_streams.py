"""Merges by bucket, streams that are cut off and repeated, fetches with failures, stage drivers."""

import os
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import stages
from shelfmark.operators.catalog import upsert, with_hints
from shelfmark.sources import audio, files, folders
from shelfmark.sources.buckets import Buckets
from shelfmark.sources.store import Store
from shelfmark.streaming import discovery

FILES = "path string, mtime double, size long"


def listing(spark, *rows):
    return spark.createDataFrame(rows, FILES)


def hinted(df):
    return with_hints(df).select("path", "mtime", "size", "path_instrument")


def parts(root) -> dict[str, str]:
    """The data files by bucket; a rewritten bucket has files of other names."""
    return {p.parent.name: p.name for p in sorted(Path(root).glob("samples/bucket=*/*.parquet"))}


def state(df, *columns):
    return {r.path: tuple(r[c] for c in columns) for r in df.collect()}


def test_a_changed_path_rewrites_one_bucket(spark, tmp_path):
    table = Buckets(spark, str(tmp_path), count=8)
    many = [(f"lib/{k}.wav", 1.0, k) for k in range(40)]
    assert len(table.merge(hinted(listing(spark, *many)), upsert, "s", 0)) == 8
    before = parts(tmp_path)
    assert before.keys() == {f"bucket={k}" for k in range(8)} and table.read().count() == 40
    changed = table.merge(hinted(listing(spark, ("lib/3.wav", 2.0, 99))), upsert, "s", 1)
    after = parts(tmp_path)
    assert len(changed) == 1 and {b for b in before if before[b] != after[b]} == {f"bucket={changed[0]}"}
    got = state(table.read(), "mtime", "size", "status")
    assert got["lib/3.wav"] == (2.0, 99, "new") and got["lib/4.wav"] == (1.0, 4, "new") and len(got) == 40
    assert table.read(changed).count() < 40


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    table = Buckets(spark, str(tmp_path), count=4)
    rows = hinted(listing(spark, ("a.wav", 1.0, 1), ("b.wav", 1.0, 2)))
    table.merge(rows, upsert, "s", 0)
    table.merge(hinted(listing(spark, ("a.wav", 5.0, 5))), upsert, "s", 1)
    before = parts(tmp_path), state(table.read(), "mtime", "ts")
    assert table.merge(hinted(listing(spark, ("a.wav", 9.0, 9))), upsert, "s", 1) == []
    assert table.merge(rows, upsert, "s", 0) == []
    assert (parts(tmp_path), state(table.read(), "mtime", "ts")) == before
    assert table.merge(rows, upsert, "another", 0) != []  # another stream's batch 0 is another batch


def test_a_merge_cut_off_between_its_steps_is_taken_up(spark, tmp_path, monkeypatch):
    table = Buckets(spark, str(tmp_path), count=4)
    table.merge(hinted(listing(spark, ("a.wav", 1.0, 1), ("b.wav", 1.0, 2), ("c.wav", 1.0, 3))), upsert, "s", 0)
    monkeypatch.setattr(folders, "names", lambda *a, names=folders.names: (_ for _ in ()).throw(OSError("cut off")) if "pending-1" in a[1] else names(*a))
    with pytest.raises(OSError):
        table.merge(hinted(listing(spark, ("a.wav", 7.0, 7))), upsert, "s", 1)
    monkeypatch.undo()
    assert state(table.read(), "mtime")["a.wav"] == (1.0,)  # nothing is replaced yet
    bucket = [b for b in range(4) if table.read([b]).where("path = 'a.wav'").count()]
    for p in (tmp_path / "samples" / f"bucket={bucket[0]}").iterdir():  # as after a crash between delete and rename
        p.unlink()
    never = lambda *_: pytest.fail("what is written is taken up, not made again")
    assert table.merge(hinted(listing(spark, ("a.wav", 7.0, 7))), never, "s", 1) == bucket
    assert state(table.read(), "mtime") == {"a.wav": (7.0,), "b.wav": (1.0,), "c.wav": (1.0,)}


def test_empty_merges_and_tables(spark, tmp_path):
    table = Buckets(spark, str(tmp_path), count=4)
    assert table.read().count() == 0 and table.read([1]).count() == 0
    assert table.merge(hinted(spark.createDataFrame([], FILES)), upsert, "s", 0) == []
    assert table.read().count() == 0


def test_discover_stream_into_buckets(spark, tmp_path):
    table = Buckets(spark, str(tmp_path / "t"), count=8)
    run = lambda: discovery.discover_stream(spark.readStream.schema(FILES).parquet(str(tmp_path / "in")), table, str(tmp_path / "ck")).awaitTermination(120)
    listing(spark, *((f"{k}.wav", 1.0, k) for k in range(20)), ("3.wav", 2.0, 3)).write.parquet(str(tmp_path / "in"))
    run()
    before = parts(tmp_path / "t")
    assert table.read().count() == 20 and state(table.read(), "mtime")["3.wav"] == (2.0,)
    listing(spark, *((f"{k}.wav", 1.0, k) for k in range(20) if k != 3), ("5.wav", 4.0, 50)).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    after = parts(tmp_path / "t")
    assert sum(before[b] != after[b] for b in before) == 1  # the rest of the second listing is as it was
    assert state(table.read(), "mtime", "size")["5.wav"] == (4.0, 50)


def embedder(spark, fail=(), broken=None):
    """Vectors from paths; ``broken`` ends the job if a path is among the rows, as a lost driver would."""

    def embed(rows):
        if broken and rows.where(F.col("path") == broken).count():
            raise RuntimeError("the driver died")
        bad = F.col("path").isin(*fail) if fail else F.lit(False)
        vec = F.when(~bad, F.array(F.length("path").cast("float"), F.lit(1.0).cast("float")))
        return rows.select("path", F.lit("m").alias("model"), vec.alias("vec"), (~bad).alias("ok"), F.when(bad, "decode").alias("error"))

    return embed


def test_embed_stream_killed_between_two_batches_has_each_path_once(spark, tmp_path):
    source, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    for k in range(4):  # four files, a batch each
        listing(spark, *((f"{k}-{j}.wav", 1.0, j) for j in range(5))).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)  # the source takes the oldest file first
    stream = lambda: spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).parquet(source)
    with pytest.raises(Exception, match="the driver died"):
        discovery.embed_stream(stream(), embedder(spark, broken="2-0.wav"), out, ck).awaitTermination(120)
    assert discovery.outcomes(spark, out).count() == 10
    (tmp_path / "out" / f"{discovery._stream(ck)}-000000002").mkdir()  # what a batch that was cut off had begun
    discovery.embed_stream(stream(), embedder(spark, fail=("2-1.wav",)), out, ck).awaitTermination(120)
    rows = discovery.outcomes(spark, out)
    assert rows.count() == 20 and rows.select("path").distinct().count() == 20
    assert [(r.path, r.vec, r.error) for r in rows.where("NOT ok").collect()] == [("2-1.wav", None, "decode")]
    assert discovery.embedded(spark, out).count() == 19
    again = str(tmp_path / "ck2")  # a lost checkpoint: nothing is embedded twice, failures only if asked for
    discovery.embed_stream(stream(), embedder(spark), out, again).awaitTermination(120)
    assert discovery.outcomes(spark, out).count() == 20
    discovery.embed_stream(stream(), embedder(spark), out, str(tmp_path / "ck3"), retry=True).awaitTermination(120)
    assert discovery.embedded(spark, out).select("path").distinct().count() == 20 == discovery.embedded(spark, out).count()


def test_outcomes_of_nothing(spark, tmp_path):
    assert discovery.outcomes(spark, str(tmp_path / "none")).count() == 0
    assert discovery.embedded(spark, str(tmp_path / "none")).columns == ["path", "model", "vec"]


def test_fetch_gives_a_row_for_every_path(spark, tmp_path):
    for k in range(30):
        (tmp_path / f"{k}.bin").write_bytes(bytes([k]) * k)
    (tmp_path / "folder.bin").mkdir()
    names = [str(tmp_path / f"{k}.bin") for k in range(30)] + [str(tmp_path / "folder.bin"), str(tmp_path / "none.bin"), None]
    got = {r.path: r for r in files.fetch(spark.createDataFrame([(n,) for n in names], "path string").repartition(3), pause=0, batch_bytes=100).collect()}
    assert len(got) == 33 and sum(r.ok for r in got.values()) == 30
    assert all(bytes(got[n].content) == bytes([k]) * k for k, n in enumerate(names[:30]))
    for n in names[30:]:
        assert not got[n].ok and got[n].content is None and got[n].error


def test_fetch_tries_again_and_falls_back(spark, tmp_path):
    counts = str(tmp_path / "counts")
    os.mkdir(counts)

    def flaky(path):
        with open(f"{counts}/{path}", "a+") as f:
            f.write("x")
        if len(open(f"{counts}/{path}").read()) < 2 or path == "c":
            raise OSError("busy")
        return path.encode()

    def other(path):
        if path == "d":
            raise OSError("gone")
        return b"copy"

    paths = spark.createDataFrame([("a",), ("c",)], "path string").coalesce(1)
    got = {r.path: (r.ok, bytes(r.content)) for r in files.fetch(paths, flaky, other, attempts=2, pause=0).collect()}
    assert got == {"a": (True, b"a"), "c": (True, b"copy")}
    never = lambda path: 1 / 0
    lost = files.fetch(spark.createDataFrame([("d",)], "path string"), never, other, pause=0).first()
    assert not lost.ok and lost.error == "OSError: gone"


def test_stat_tells_errors_apart(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(b"12345")
    got = {Path(r.path).name: r for r in files.stat(spark.createDataFrame([(str(tmp_path / n),) for n in ("a.wav", "none.wav")], "path string")).collect()}
    assert got["a.wav"].ok and got["a.wav"].size == 5 and abs(got["a.wav"].mtime - os.path.getmtime(tmp_path / "a.wav")) < 1
    assert not got["none.wav"].ok and got["none.wav"].size is None and "FileNotFoundError" in got["none.wav"].error


def test_embed_outcomes_keep_failures(spark):
    def decode(content):
        if content == b"bad":
            raise ValueError("not a sound")
        return np.frombuffer(content, np.uint8).astype(np.float32)

    def model(signals):
        if (signals == 66).any():
            raise RuntimeError("no batch with a B")
        return np.column_stack([signals.sum(axis=1), np.ones(len(signals))])

    rows = [("a", b"\x03\x00"), ("b", b"bad"), ("c", None), ("d", b""), ("e", b"AB"), ("f", b"\x00\x00")]
    got = {r.path: r for r in audio.embed_outcomes(spark.createDataFrame(rows, "path string, content binary").coalesce(1), decode, model).collect()}
    assert np.allclose(got["a"].vec, [3 / 10**0.5, 1 / 10**0.5]) and got["f"].vec == [0.0, 1.0] and got["a"].ok and got["f"].error is None
    assert {p: r.error for p, r in got.items() if not r.ok} == {"b": "ValueError: not a sound", "c": "ValueError: no content", "d": "ValueError: no content", "e": "RuntimeError: no batch with a B"}
    assert all(got[p].vec is None for p in "bcde")


def test_stage_drivers_count_and_write(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    found = spark.createDataFrame([("kick 1.wav", 1.0, 5, True, None), ("pad.wav", 1.0, 6, True, None), ("x.wav", None, None, False, "OSError")], f"{FILES}, ok boolean, error string")
    assert stages.run_discover(store, found, dry_run=True) == {"missing": 0, "selected": 2, "errors": 1}
    assert store.read("samples").count() == 0
    assert stages.run_discover(store, found) == {"missing": 0, "selected": 2, "errors": 1}
    flaky = found.withColumn("ok", F.col("path") != "pad.wav").where("path <> 'x.wav'")
    assert stages.run_discover(store, flaky) == {"missing": 0, "selected": 0, "errors": 1}  # what can't be looked up isn't missing

    def classify(rows):
        fine = F.col("path") != "pad.wav"
        return rows.select("path", fine.alias("ok"), F.when(~fine, "decode").alias("error"), F.when(fine, "bass").alias("panns_instrument"), F.when(fine, 0.7).alias("panns_conf"))

    assert stages.run_label(store, classify, ["panns"], dry_run=True) == {"selected": 2, "processed": 2, "errors": 1}
    assert store.read("samples").where("panns_instrument IS NOT NULL").count() == 0
    assert stages.run_label(store, classify, ["panns"]) == {"selected": 2, "processed": 2, "errors": 1}
    assert state(store.read("samples"), "status", "error", "panns_instrument") == {"kick 1.wav": ("ok", None, "bass"), "pad.wav": ("error", "decode", None)}
    assert stages.run_label(store, classify, ["panns"], limit=5)["selected"] == 1
    assert stages.run_label(store, classify, ["panns"], redo=["all"])["selected"] == 2
    assert stages.run_label(store, classify, [])["selected"] == 0
    with pytest.raises(ValueError, match="no such"):
        stages.run_label(store, classify, ["other"])

    def embed(rows):
        fine = F.col("path") != "pad.wav"
        return rows.select("path", F.when(fine, F.array(F.lit(1.0))).alias("vec"), fine.alias("ok"), F.when(~fine, "decode").alias("error"))

    assert stages.run_embed(store, embed, "m", full=True) == {"known": 0, "selected": 2, "embedded": 1, "errors": 1}
    assert stages.run_embed(store, embed, "m", full=True) == {"known": 1, "selected": 1, "embedded": 0, "errors": 1}
    assert stages.run_embed(store, embed, "m", full=True, force=True)["selected"] == 2
    assert [(r.path, r.model, r.vec) for r in store.read("features").collect()] == [("kick 1.wav", "m", [1.0])]
    assert stages.run_embed(store, embed, "m")["selected"] == 0  # nothing is frozen or labelled
