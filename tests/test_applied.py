import datetime

from pyspark.sql import functions as F

from tessera.operators.memo import Memo, lengths
from tessera.sources.files import files, ingested
from tessera.sources.versions import VersionedTable
from tessera.streaming.applied import SETTINGS, applied, settled
from pyspark.sql import types as T

SCHEMA = "user_id long, ts timestamp, event_id long, event_type string"
at = lambda s: datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(seconds=s)


def test_batches_apply_once_under_their_configuration(spark, tmp_path):
    settings, config = (VersionedTable(spark, f"file://{tmp_path}/{n}", k, parts=4) for n, k in (("settings", "user_id"), ("config", "event_type")))
    settings.create(spark.createDataFrame([], SETTINGS))
    config.create(spark.createDataFrame([("view", True), ("error", False)], "event_type string, enabled boolean"))
    state = lambda: {r.user_id: (r.event_id, r.config) for r in settings.read().collect()}

    def run(rows):
        spark.createDataFrame([(u, at(s), e, k) for u, s, e, k in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/changes")
        settled(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/changes"), "s", settings, config, f"{tmp_path}/state")

    run([(1, 10, 100, "view"), (1, 5, 101, "view"), (2, 10, 102, "error"), (3, 7, 104, "view"), (3, 7, 103, "view")])
    assert state() == {1: (100, 1), 3: (103, 1)}
    config.update(F.col("event_type") == "error", {"enabled": F.lit(True)})
    run([(1, 10, 99, "view"), (2, 1, 105, "error"), (3, 8, 106, "view")])  # not strictly newer; enabled by now; newer
    assert state() == {1: (100, 1), 2: (105, 2), 3: (106, 2)} and settings.marks() == {"s": 1}
    version = settings.version()
    again = spark.createDataFrame([(1, at(99), 200, "view")], SCHEMA)
    assert not applied(again, 1, "s", settings, config) and settings.version() == version
    assert applied(again, 2, "s", settings, config) and state()[1] == (200, 2)


def test_memo_computes_each_text_once(spark, tmp_path):
    asked = []

    def compute(texts):
        asked.append(sorted(r.text for r in texts.collect()))
        return lengths(texts)

    memo = Memo(spark, f"file://{tmp_path}/memo", "m", T.ArrayType(T.LongType()), compute)
    frame = lambda texts: spark.createDataFrame(list(enumerate(texts)), "at int, text string")
    first = {r["at"]: (r.value and r.value[0], r.run) for r in memo.looked_up(frame(["a b", "ccc", "a b", None]), 1).collect()}
    assert first == {0: (3, 1), 1: (3, 1), 2: (3, 1), 3: (None, None)}
    second = {r["at"]: r.run for r in memo.looked_up(frame(["ccc", "new", "a b"]), 2).collect()}
    assert second == {0: 1, 1: 2, 2: 1}
    version = memo.table.version()
    assert {r.run for r in memo.looked_up(frame(["new", "ccc"]), 3).collect()} == {1, 2} and memo.table.version() == version
    assert asked == [["a b", "ccc"], ["new"], []]


def test_a_broken_file_is_a_row(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    for name, content in {"a.txt": b"some words " * 300, "b.TXT": b"\xff\xfe\x00bad", "deep/c.md": b" \n ", "d.exe": b"MZ", "e.txt": "é me@x.org".encode()}.items():
        (tmp_path / "in" / name).write_bytes(content)
    got = {r.path.rpartition("/")[2]: (r.status, r.reason, r.chunks) for r in ingested(files(spark, str(tmp_path / "in")), F.contains("text", F.lit("@"))).collect()}
    assert got == {"a.txt": ("active", None, 4), "b.TXT": ("failed", "not_utf8", 0), "c.md": ("failed", "empty", 0), "d.exe": ("failed", "unsupported", 0), "e.txt": ("quarantined", None, 1)}
