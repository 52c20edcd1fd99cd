"""Bundles: written whole or not at all, read back and verified."""

import hashlib
import hmac
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import audit
from palimpsest.sources import bundles as B

KEY = b"k"


@pytest.fixture(scope="module")
def made(spark):
    names = "session_id string, seq long, event_id string, actor_id string, actor_type string, event_type string, payload string, created_at string"
    events = [(f"s{k % 5}", k, f"e{k}", None, "user", "t", '{"k":"é"}', "now") for k in range(40)]
    chain = audit.build_chain(spark.createDataFrame(events, names))
    snapshots = spark.createDataFrame([(f"s{k}", json.dumps({"id": k})) for k in range(6)], "session_id string, snapshot string")
    rendered = spark.createDataFrame([(f"s{k}", f"out{k}.txt", f"Ann\n[BOX]é{k}") for k in range(1, 6)], "session_id string, filename string, content string")
    return B.bundles(chain, snapshots, rendered, "session_id", KEY), chain


def test_bundles_are_written_read_and_verified(spark, made, tmp_path):
    rows, chain = made
    path = str(tmp_path / "out")
    (tmp_path / "out").mkdir()
    B.write_bundles(rows.repartition(3), path)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"bundle-s{k}.zip" for k in range(1, 5)]  # s0 has no text, s5 no event
    last = {r.session_id: r.last_hash for r in audit.last_hash(chain).collect()}
    with zipfile.ZipFile(tmp_path / "out" / "bundle-s2.zip") as bundle:
        assert bundle.read("out2.txt").decode() == "Ann\n[BOX]é2"
        assert [e["seq"] for e in json.loads(bundle.read("audit.json"))] == list(range(2, 40, 5))
        raw = bundle.read("export_manifest.json").decode()
        manifest = json.loads(raw)
        assert manifest["audit_boundary"] == {"last_event_hash": last["s2"], "last_event_id": "e37"}
        assert {f["filename"]: f["sha256"] for f in manifest["files"]} == {n: hashlib.sha256(bundle.read(n)).hexdigest() for n in bundle.namelist() if n != "export_manifest.json"}
        signed = raw[: raw.rindex(',"signature"')] + "}"
        assert hmac.new(KEY, signed.encode(), hashlib.sha256).hexdigest() == manifest["signature"]
    again = B.read_bundles(spark, path, KEY)
    assert again.where("verified").count() == 4 and B.read_bundles(spark, path, b"other").where("verified").count() == 0
    with zipfile.ZipFile(tmp_path / "out" / "bundle-s3.zip", "a") as bundle:
        bundle.writestr("more.txt", "x")
    assert {r.name for r in again.where("NOT verified").collect()} == {"bundle-s3.zip"}


def test_a_failed_task_or_a_clash_leaves_nothing(spark, made, tmp_path):
    rows, _ = made
    path = tmp_path / "out"
    path.mkdir()
    broken = rows.repartition(3).withColumn("name", F.when(F.col("name").contains("s3"), F.raise_error(F.lit("no"))).otherwise(F.col("name")).cast("string"))
    with pytest.raises(Exception, match="no"):
        B.write_bundles(broken, str(path))
    assert not list(path.iterdir())
    with pytest.raises(Exception, match="one name"):
        B.write_bundles(rows.repartition(3).withColumn("name", F.lit("same.zip")), str(path))
    assert not list(path.iterdir())
