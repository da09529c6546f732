import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewright.operators import evidence as I
from tracewright.operators import integrity as H


@pytest.fixture(scope="module")
def chain(spark):
    rows = [(("hot" if i % 2 else f"s{i % 5}"), datetime(2024, 1, 1) + timedelta(seconds=37 * (i % 50)), i, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(300)]
    return rows, spark.createDataFrame(rows, "stream string, ts timestamp, seq long, data_hash string")


def reference_chain(rows):
    out = {}
    for stream in {r[0] for r in rows}:
        previous = "0" * 64
        for i, r in enumerate(sorted((r for r in rows if r[0] == stream), key=lambda r: (r[1], r[2]))):
            epoch = int((r[1] - datetime(1970, 1, 1)).total_seconds())
            raw = i.to_bytes(8, "big") + epoch.to_bytes(8, "big") + r[3].encode() + previous.encode() + bytes(8)
            previous = hashlib.sha256(raw).hexdigest()
            out[(stream, i)] = previous
    return out


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_chain_equals_reference_whatever_the_partitions(chain, parts):
    rows, df = chain
    got = {(r["stream"], r["index"]): r["block_hash"] for r in H.build_chain(df.repartition(parts), parts).collect()}
    assert got == reference_chain(rows)


def test_built_chain_verifies_and_a_flip_shows(chain):
    ledger = H.build_chain(chain[1])
    assert H.verify_chain(ledger).count() == 0
    at = (F.col("stream") == "hot") & (F.col("index") == 40)
    forged = ledger.withColumn("data_hash", F.when(at, F.sha2(F.lit("x"), 256)).otherwise(F.col("data_hash")))
    assert [tuple(r) for r in H.verify_chain(forged).collect()] == [("hot", 40, False, True)]
    relinked = ledger.withColumn("block_hash", F.when(at, F.sha2(F.lit("x"), 256)).otherwise(F.col("block_hash")))
    assert sorted(tuple(r) for r in H.verify_chain(relinked).collect()) == [("hot", 40, False, True), ("hot", 41, True, False)]
    assert [r["index"] for r in H.verify_chain(ledger.where("not (stream = 'hot' and index = 10)")).collect()] == [11]


def test_segmented_chain_verifies(chain):
    ledger = H.build_chain(H.segment_streams(chain[1], 300))
    assert H.verify_chain(ledger).count() == 0 and ledger.select("stream").distinct().count() > 5


def test_repository_hash_ignores_order_and_sees_copies(spark):
    h = [hashlib.sha256(str(i % 40).encode()).hexdigest() for i in range(200)]
    df = spark.createDataFrame([("j", x) for x in h], "job_id string, hash_sha256 string")
    a = H.repository_hash(df).first()["digest"]
    assert a == H.repository_hash(df.orderBy(F.rand(1)).repartition(13)).first()["digest"]
    assert a != H.repository_hash(df.limit(199)).first()["digest"]


def test_tamper_diff(spark):
    old = spark.createDataFrame([("a", "1", "644"), ("b", "1", "644"), ("c", "1", "644"), ("d", "1", "644")], "path string, hash string, permissions string")
    new = spark.createDataFrame([("a", "1", "644"), ("b", "2", "644"), ("c", "1", "755"), ("e", "1", "644")], "path string, hash string, permissions string")
    assert {r["path"]: r["change"] for r in H.tamper_diff(old, new).collect()} == {
        "b": "modified", "c": "permissions_changed", "d": "deleted", "e": "added"}


def test_custody(spark):
    t = datetime(2024, 1, 1)
    rows = [("x", 1, t, "ann", "", "0", "1"), ("x", 2, t + timedelta(days=2), "bob", "ann", "1", "2"), ("x", 3, t + timedelta(days=9), "cy", "ann", "9", "3"), ("y", 4, t, "dan", "", "0", "1")]
    df = spark.createDataFrame(rows, "evidence_id string, event_id long, ts timestamp, actor string, from_actor string, hash_before string, hash_after string")
    assert [r["event_id"] for r in H.invalid_transfers(df).collect()] == [3]
    assert [r["event_id"] for r in H.custody_breaks(df).collect()] == [3]
    assert {r["evidence_id"]: r["holder"] for r in H.current_holder(df).collect()} == {"x": "cy", "y": "dan"}
    assert sorted((r["event_id"], r["position"]) for r in H.custody_chain(df).collect()) == [(1, 1), (2, 2), (3, 3), (4, 1)]


PACKAGE = "spec_version string, timestamp_utc timestamp, event_type string, actor struct<type:string,id:string,auth_provider:string>, artifacts array<struct<name:string,uri:string,hash_sha256:string>>, metadata map<string,string>"


def package(spark, *rows):
    return spark.createDataFrame(list(rows), PACKAGE)


def test_evidence_validation(spark):
    t = datetime(2024, 1, 1)
    bad = ("2.0.0", t, "", ("s", "", None), [("", None, "zz"), ("n", None, "")], {})
    good = ("1.0.0", t, "e", ("s", "i", None), [("n", None, "00ff")], {"b": "1", "a": "2"})
    out = I.validate_evidence(package(spark, bad, good)).collect()
    assert out[0]["errors"] == ["Event type cannot be empty", "Actor ID cannot be empty", "Artifact 0 has empty name", "Artifact 1 has empty hash"]
    assert out[0]["warnings"] == ["Using spec version 2.0.0, recommended version is 1.0.0", "Artifact 0 hash may not be valid hex: zz"]
    assert not out[0]["is_valid"] and out[1]["is_valid"] and out[1]["warnings"] == []


def test_package_hash_ignores_map_order(spark):
    t = datetime(2024, 1, 1)
    a = ("1.0.0", t, "e", ("s", "i", None), [], {"b": "1", "a": "2"})
    b = ("1.0.0", t, "e", ("s", "i", None), [], {"a": "2", "b": "1"})
    c = ("1.0.0", t, "e", ("s", "i", None), [], {"a": "2", "b": "3"})
    h = [r["package_hash"] for r in I.package_hash(package(spark, a, b, c)).collect()]
    assert h[0] == h[1] != h[2] and len(h[0]) == 44


def test_approval_states(spark):
    t = datetime(2024, 1, 1)
    req = spark.createDataFrame([(i, ["a", "b"], t + timedelta(hours=2)) for i in range(5)], "id int, required array<string>, expires_at timestamp")
    ok, late = t + timedelta(hours=1), t + timedelta(hours=3)
    ans = [(0, "a", "approved", ok), (0, "b", "approved", ok), (1, "a", "approved", ok), (1, "b", "rejected", ok), (2, "a", "approved", ok), (2, "b", "approved", late), (3, "a", "pending", None)]
    answers = spark.createDataFrame(ans, "id int, role string, status string, responded_at timestamp")
    def states(as_of):
        return {r["id"]: r["state"] for r in I.approval_state(req, answers, F.lit(as_of)).collect()}
    assert states(t + timedelta(hours=1)) == {0: "approved", 1: "rejected", 2: "pending", 3: "pending", 4: "pending"}
    assert states(late) == {0: "approved", 1: "rejected", 2: "expired", 3: "expired", 4: "expired"}


def test_errors_and_retries(spark):
    df = spark.createDataFrame([("RekorError",), ("AuthenticationError",), ("Strange",)], "error_name string")
    assert [(r["error_type"], r["retryable"]) for r in I.classify_errors(df).collect()] == [
        ("transparency", True), ("authentication", False), ("internal", True)]
    assert [r["delay_seconds"] for r in I.retry_schedule(df.limit(1), 6).orderBy("attempt").collect()] == [30, 60, 120, 240, 300, 300]


def test_event_error_order(spark):
    schema = "event_id string, source string, actor struct<id:string>, workflow_type string, approvers array<string>, artifacts array<struct<name:string,hash_sha256:string>>"
    rows = [("e", "s", ("a",), "simple_sign", [], [("n", ""), ("", "h")]), ("e", "s", ("a",), "approval_sign", [], []), ("", "", ("",), "x", [], []), ("e", "s", ("a",), "simple_sign", [], [])]
    got = [r["error"] for r in I.validate_event(spark.createDataFrame(rows, schema)).collect()]
    assert got == ["Artifact hash is required", "Approval workflow requires at least one approver", "Event ID is required", None]


def test_dataset_validation(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    r = I.validate_dataset(df, ["k"], {"k": "int"}).first()
    assert (r["rows"], r["duplicate_records_count"], r["schema_validation"], r["is_valid"]) == (3, 1, True, False)
    assert r["missing_values_percentage"] == pytest.approx(100 / 6)
    assert I.validate_dataset(df.where("k = 2").fillna("x"), ["k"], {"k": "int"}).first()["is_valid"]
