"""Framed messages across splits, cuts and writes; partition rules over keys, folders and plans."""

from __future__ import annotations

import math
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluice.plans import transport
from sluice.sources import frames, partitions
from sluice.sources.partitions import Dimension


def _message(rng: random.Random, k: int) -> dict:
    numbers = [rng.choice([0, 1, -1, 127, 128, 2**31, -(2**63), 2**63 - 1, rng.randrange(10**6)]) for _ in range(rng.randrange(4))]
    fields = [
        {"name": "n", "representation": None, "integers": numbers}, {"name": "t", "representation": "unit", "strings": ["", "é" * rng.randrange(9), "\x1e\x02\x08\x01\x1f"]},
        {"name": "b", "representation": None, "binaries": [bytes([30, 2, 8, 0, 31])]}, {"name": "d", "representation": None, "doubles": [0.5, -math.inf]}, {"name": "f", "representation": None, "booleans": [True, False]},
    ]
    return {"uuid": struct.pack(">QQ", 7, k), "nanos": k * 10**9 + 1, "type": rng.choice([None, "a", "ß"]), "logger": None, "severity": -3, "payload": "x" * rng.choice([0, 5, 3000]), "env_version": None, "pid": k, "hostname": "h", "fields": fields[: rng.randrange(6)]}


def _whole(message: dict) -> dict:
    """As a message comes back: every field has all lists, those without values are null."""
    fields = [{k: (f.get(k) or None) if k in frames.KINDS else f.get(k) for k in ("name", "representation", *frames.KINDS)} for f in message["fields"]]
    return message | {"fields": fields}


def test_messages_come_back():
    rng = random.Random(1)
    for k in range(300):
        message = _message(rng, k)
        assert frames.decode(frames.encode(message)) == _whole(message)


def test_every_cut_of_a_message_is_noticed_or_shorter():
    """No cut raises anything but Cut, and what still reads lacks members at the end only."""
    data = frames.encode(_message(random.Random(3), 5))
    for n in range(len(data)):
        try:
            found = frames.decode(data[:n])
        except frames.Cut:
            continue
        assert found["uuid"] and found["nanos"]
    with pytest.raises(frames.Cut):
        frames.decode(b"\xff" * 30)


def test_unknown_members_are_skipped():
    data = frames.encode({"uuid": b"u", "nanos": 1}) + frames._put(99, "text", "later") + frames._put(98, "int", 5)
    assert frames.decode(data)["uuid"] == b"u"


def _file(path, messages, damage=()):
    """A file of frames with bytes put before the frames of given numbers; (start of each frame, damaged stretches)."""
    data, starts, stretches = b"", [], []
    for k, message in enumerate(messages):
        for place, junk in damage:
            if place == k:
                stretches.append((len(data), len(junk)))
                data += junk
        starts.append(len(data))
        data += frames.frame(frames.encode(message))
    path.write_bytes(data)
    return starts, stretches


@pytest.mark.parametrize("split", [1, 13, 97, 1000, 5000, 1 << 30])
def test_splits_share_out_frames_and_damage(tmp_path, split):
    """However a file is cut, each frame and each damaged stretch is read once."""
    rng = random.Random(7)
    messages = [_message(rng, k) for k in range(40)]
    for m in messages:  # bytes that look like a frame belong to the manifest's test
        m["fields"] = [f for f in m["fields"] if f["name"] in "ndf"]
    junk = [(0, b"\x1e\x1e junk"), (9, b"\x1e\x03\x08"), (10, b"\x00" * 3000), (25, frames.frame(frames.encode(messages[0]))[:-2])]
    starts, stretches = _file(tmp_path / "x.frames", messages, junk)
    with open(tmp_path / "x.frames", "ab") as out:
        out.write(frames.frame(b"never ended" * 99)[:-1])
    reader = frames.FrameReader({"path": str(tmp_path / "x.frames"), "split": str(split)})
    rows = [r for part in reader.partitions() for r in reader.read(part)]
    found = sorted((r[11], r[13]) for r in rows)
    assert [a for a, error in found if error is None] == starts
    assert [a for a, error in found if error] == [a for a, _ in stretches] + [starts[-1] + len(frames.frame(frames.encode(messages[-1])))]
    assert [dict(zip(frames.MEMBERS, r, strict=False))["pid"] for r in sorted(rows, key=lambda r: r[11]) if r[13] is None] == list(range(40))


def test_written_frames_are_split_by_their_offsets(spark, tmp_path):
    """Payloads that hold whole frames mislead a search, but not a reader with offsets; two appends add up, an overwrite replaces them."""
    inner = "".join(chr(b) for b in frames.frame(frames.encode({"uuid": b"fake", "nanos": 1})) * 3)
    rows = spark.range(500).select(F.unhex(F.md5(F.col("id").cast("string").cast("binary"))).alias("uuid"), F.col("id").alias("nanos"), F.lit(inner).alias("payload"), F.array(frames.field("v", F.col("id"), "integers")).alias("fields"))
    path = str(tmp_path / "w")
    frames.write_frames(rows.filter("id < 200").repartition(3), path, split=700)
    frames.write_frames(rows.filter("id >= 200").repartition(2), path, split=10**9)
    (tmp_path / "w" / "part-of-a-lost-attempt.frames").write_bytes(b"left behind")
    back = frames.read_frames(spark, path)
    assert back.rdd.getNumPartitions() > 20
    assert sorted(r["v"] for r in back.select(frames.value_of("fields", "v", "integers").alias("v")).collect()) == list(range(500))
    assert back.filter("error is not null or payload <> '" + inner.replace("\\", "\\\\").replace("'", "\\'") + "'").count() == 0
    frames.write_frames(rows.limit(5), path, mode="overwrite")
    assert frames.read_frames(spark, path).count() == 5
    frames.write_frames(rows.limit(0), str(tmp_path / "none"))
    assert frames.read_frames(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("part", [slice(0, 0), slice(0, 1), slice(0, 200), slice(3, 150)])
def test_columns_hold_what_rows_do(part):
    """Messages encoded and decoded by columns are those of encode and decode, null, empty, broken and sliced ones too."""
    rng = random.Random(4)
    messages = [_message(rng, k) for k in range(200)]
    for m in messages:
        m["fields"] = rng.choice([m["fields"], m["fields"], None])
        for f in m["fields"] or []:
            f |= {k: v for k, v in {"name": None, "representation": "", "strings": [], "integers": []}.items() if rng.random() < 0.1}
    batch = pa.RecordBatch.from_pylist(messages, frames._arrow_schema())[part]
    data = [frames.encode(m) for m in messages[part]]
    assert frames.encode_columns(batch).to_pylist() == data
    assert frames.encode_columns(batch, framed=True).to_pylist() == [frames.frame(x) for x in data]
    sent = [None, b"\xff", *data, *(x[: rng.randrange(len(x))] for x in data), b""]
    columns, errors = frames.decode_columns(sent)
    found = pa.RecordBatch.from_arrays(columns, list(frames.MEMBERS)).to_pylist()
    for x, row, error in zip(sent, found, errors, strict=True):
        try:
            assert (row, error) == (frames.decode(x or b""), None)
        except frames.Cut as cut:
            assert (set(row.values()), error) == ({None}, str(cut))


def test_framed_records_reads_each_byte_once(spark, sf):
    """One scan for messages and errors, whose rows come as record batches; the write leaves the session's settings alone."""
    names = [f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = [spark.conf.get(x, None) for x in names]
    plan = transport.framed_records(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RelationV2") == 1
    assert [spark.conf.get(x, None) for x in names] == before


def test_bytes_with_nulls_go_to_the_side(spark):
    rows = spark.createDataFrame([(1, None), (2, b""), (3, bytes(frames.encode({"uuid": b"u", "nanos": 5})))], "id long, bytes binary")
    assert [(r["nanos"], r["decode_error"]) for r in frames.decoded(rows).orderBy("id").collect()] == [(None, "header"), (None, "header"), (5, None)]


RULES = """{"dimensions": [{"field_name": "kind", "allowed_values": ["a b", "c"]}, {"field_name": "day", "allowed_values": {"min": "2024", "max": "2025"}}, {"field_name": "part", "allowed_values": "*"}]}"""


def test_rules_are_read_and_refused():
    kind, day, part = partitions.dimensions(RULES)
    assert (kind.allows("a_b"), kind.allows("a b"), day.allows("2024_06"), day.allows("2026"), part.allows("")) == (True, False, True, False, True)
    for bad in ([1], {}, {"least": "1"}, {"min": 1}, 5, None):
        with pytest.raises(ValueError, match="d"):
            Dimension.of("d", bad)
    with pytest.raises(ValueError, match="name"):
        Dimension.of("", "*")


def test_rules_become_partition_filters_and_folders_stay_closed(spark, tmp_path):
    rules = partitions.dimensions(RULES)
    rows = spark.createDataFrame([("a b", "2024_1", "x", 1), ("a b", "2026", "x", 2), ("zzz", "2024_1", "y", 3), ("c", "2024_2", None, 4), (None, "2024_2", "q", 5)], "kind string, day string, part string, v long")
    path = str(tmp_path / "t")
    partitions.write_by_rules(rows, path, rules, {})
    assert {(r["kind"], r["day"], r["part"]) for r in spark.read.parquet(path).collect()} == {("a_b", "2024_1", "x"), ("a_b", "OTHER", "x"), ("OTHER", "2024_1", "y"), ("c", "2024_2", "UNKNOWN"), ("UNKNOWN", "2024_2", "q")}
    scan = partitions.matching(spark.read.parquet(path), rules)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters:") :].split("]")[0]
    assert "kind" in filters and "day" in filters and "2025" in filters
    assert sorted(r["v"] for r in scan.collect()) == [1, 4]
    asked = []
    folders = partitions.hadoop_folders(spark)
    found = partitions.matching_folders(path, rules, lambda p: (asked.append(p), folders(p))[1])
    assert sorted(f.removeprefix(path) for f in found) == ["/kind=a_b/day=2024_1/part=x", "/kind=c/day=2024_2/part=UNKNOWN"]
    assert not [p for p in asked if "OTHER" in p or "kind=UNKNOWN" in p]
    for gone in (tmp_path / "t" / "kind=OTHER").rglob("*.parquet"):
        gone.write_bytes(b"not to be opened")
    assert sorted(r["v"] for r in partitions.read_matching(spark, path, rules).collect()) == [1, 4]
    assert partitions.read_matching(spark, path, [Dimension.of("kind", "none")], "v long").collect() == []


def test_keys_without_names(spark):
    keys = spark.createDataFrame([("root/a_b/2024_5/x/1.gz", 3), ("root/a_b/2023/x/2.gz", 4), ("root/c/2025/3.gz", 5), ("root/c", 1)], "key string, size long")
    rules = partitions.dimensions(RULES)
    assert [(r["kind"], r["day"], r["part"], r["size"]) for r in partitions.matching_keys(keys, "key", rules, "root").collect()] == [("a_b", "2024_5", "x", 3)]
    dealt = {r["key"]: r["worker"] for r in partitions.dealt(keys, "key", 3).collect()}
    assert set(dealt.values()) <= {0, 1, 2} and dealt == {r["key"]: r["worker"] for r in partitions.dealt(keys.repartition(2), "key", 3).collect()}
