"""Gates of outside inputs, manifests, and the calibrator's artifact."""

import hashlib
import json

import pytest

from weftline.operators import external
from weftline.sources import calibration, records


def test_id_list(spark):
    ids = spark.createDataFrame([(2, "c"), (0, " a "), (1, "b")], "position int, outfit_id string")
    report = external.id_list_report(ids)
    sha = hashlib.sha256(b"a\nb\nc").hexdigest()
    assert report.first().asDict() == {"n": 3, "n_unique": 3, "n_blank": 0, "first_outfit_id": "a", "last_outfit_id": "c", "sha256": sha}
    frozen = {"test_outfit_count": 3, "unique_test_outfit_count": 3, "ordered_test_ids_sha256": sha, "first_outfit_id": "a", "last_outfit_id": "c"}
    codes = lambda r, f, n=3: {x.code for x in external.id_list_issues(r, f, count=n).collect()}
    assert codes(report, frozen) == set() and codes(report, {"test_outfit_count": 3, "unique_test_outfit_count": 3}) == set()
    assert codes(report, frozen | {"first_outfit_id": "b", "ordered_test_ids_sha256": "0"}) == {"first_outfit_mismatch", "ordered_ids_sha256_mismatch"}
    odd = external.id_list_report(spark.createDataFrame([(0, "a"), (1, None), (2, "a")], "position int, outfit_id string"))
    assert codes(odd, frozen, 4) == {"unexpected_count", "duplicate_outfit_id", "blank_outfit_id", "manifest_count_mismatch", "ordered_ids_sha256_mismatch", "last_outfit_mismatch"}


def test_manifests(spark):
    r = spark.createDataFrame([("train", "k", 1), ("train", "k", 0), ("test", "m", 1)], "split string, source_kit_id string, label int")
    files = spark.createDataFrame([(s, k, f"{s}-{k}", "h") for s in ("train", "valid", "test") for k in ("scorer", "negative", "item_metadata")], "split string, kind string, file string, sha256 string")
    splits, whole = external.manifests(r, files, dataset_version="v", status="READY")
    assert splits["splits"]["train"] == {"scorer_file": "train-scorer", "scorer_sha256": "h", "negative_file": "train-negative", "negative_sha256": "h", "item_metadata_file": "train-item_metadata", "item_metadata_sha256": "h", "sample_count": 2, "positive_count": 1, "negative_count": 1, "source_kit_count": 1}
    assert splits["splits"]["valid"]["sample_count"] == 0 and whole["status"] == "READY" and whole["manifest_version"] == "dataset-manifest-v2"
    with pytest.raises(ValueError, match="valid lacks scorer"):
        external.manifests(r, files.where("file <> 'valid-scorer'"), dataset_version="v")


def test_protocol_and_calibrator(spark, tmp_path):
    at = str(tmp_path / "p")
    records.write_object(spark, {"protocol_status": "FROZEN", "x": 1}, at)
    assert external.frozen_protocol(spark, at)["x"] == 1
    records.write_object(spark, {"protocol_status": "DRAFT"}, at)
    with pytest.raises(ValueError, match="frozen"):
        external.frozen_protocol(spark, at)
    made = calibration.Calibrator(2.0, -0.5, "s", {"seed": 42})
    calibration.save(spark, made, str(tmp_path / "c"))
    assert calibration.load(spark, str(tmp_path / "c")) == made
    good = json.loads(json.dumps(made.artifact()))
    for change in ({"scale": 0.0}, {"scale": float("nan")}, {"bias": True}, {"scorer_version": " "}, {"method": "other"}, {"metadata": []}):
        with pytest.raises(ValueError):
            calibration.Calibrator.of(good | change)
    with pytest.raises(ValueError, match="lacks bias"):
        calibration.Calibrator.of({k: v for k, v in good.items() if k != "bias"})
