import hashlib
import json

import pytest

from attesta.functions import pixels as P
from attesta.sources import files as S
from attesta.sources.json_arrays import array_objects


@pytest.fixture
def root(tmp_path):
    base = tmp_path / "set"
    for p, content in {
        "a.png": b"1", "cats/b.jpg": b"2", "cats/c.txt": b"no image", "x/images/one.png": b"3", "x/labels/one.txt": b"0 .1 .2 .3 .4\nbad line\n1 a b c d\n2 .5 .5 .5 .5 extra\n",
        "y/two.png": b"4", "y/two.txt": b"1 0 0 1 1", "y/three.png": b"5", "z/img.png": b"6", "p1/p1_B01.tif": b"7", "p1/p1_B8A.tif": b"8", "p1/p1_labels_metadata.json": b"{}", "other.tif": b"9",
    }.items():
        f = base / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(content)
    coco = {"images": [{"id": 1, "file_name": "img.png", "width": 4, "height": 4}, {"id": 2, "file_name": "gone.png"}], "annotations": [{"image_id": 1, "category_id": 5, "bbox": [0, 0, 1, 1]}, {"image_id": 1, "category_id": 9, "bbox": [0, 0, 1, 1]}], "categories": [{"id": 5, "name": None}]}
    (base / "z" / "ann.json").write_text(json.dumps(coco))
    return str(base)


def test_image_folder(spark, root):
    rows = {r.sample_id: r for r in S.image_folder(spark, root).collect()}
    assert rows["a.png"].label is None and rows["cats/b.jpg"].label == "cats" and "cats/c.txt" not in rows
    assert rows["a.png"].sha256 == "6b86b273ff34fce19d6b804eff5a3f5747ada4eaa22f1d49c01e52ddb7875b4b"


def test_yolo_and_format(spark, root):
    rows = {r.sample_id: r.labels for r in S.yolo(spark, root).collect()}
    assert rows["x/images/one.png"] == [[0.0, 0.1, 0.2, 0.3, 0.4], [2.0, 0.5, 0.5, 0.5, 0.5]]
    assert rows["y/two.png"] == [[1.0, 0.0, 0.0, 1.0, 1.0]] and rows["y/three.png"] == []
    kinds = {r.source: r.format for r in S.detect_format(S.listing(spark, root), S.is_coco(spark, root)).collect()}
    assert kinds["z"] == "COCO" and kinds["x"] == "YOLO" and kinds["y"] == "YOLO" and kinds["cats"] == "IMAGE_FOLDER"


def test_coco(spark, root):
    rows = S.coco(spark, f"{root}/z/ann.json", S.listing(spark, root)).collect()
    assert [r.sample_id for r in rows] == ["img.png"] and sorted(x.category for x in rows[0].labels) == ["5", "unknown"]


def test_bands(spark, root):
    row = S.patches(spark, root).where("patch = 'p1'").first()
    assert row.B01 != S.MISSING_BAND and row.B8A != S.MISSING_BAND and row.B02 == S.MISSING_BAND and len(row.compound) == 64
    bands = {r.sample_id: r.band for r in S.single_bands(spark, root).collect()}
    assert bands == {"p1/p1_B01.tif": "B01", "p1/p1_B8A.tif": "B8A", "other.tif": "UNKNOWN"}


def test_entities_and_log(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "1.json").write_text('{"id": 1,\n "name": "x"}')
    (tmp_path / "e" / "2.json").write_text("{broken")
    assert [r.id for r in S.entities(spark, str(tmp_path / "e"), "id long, name string").collect()] == [1]


def test_undecodable_content_is_a_row(spark):
    rows = spark.createDataFrame([("a", b"P5 2 1 255\n\x00\xff"), ("b", b"junk"), ("c", None)], "path string, content binary")
    got = {r.path: (r.status, r.px) for r in P.decode(rows, P.pgm).collect()}
    assert got == {"a": ("OK", [0.0, 255.0]), "b": ("UNDECODABLE", None), "c": ("UNDECODABLE", None)}


def test_a_document_is_read_in_many_parts(spark, tmp_path):
    """Small splits cut texts, nested objects and the seams of arrays."""
    images = [{"id": k, "file_name": f"{k}.png", "width": k % 9, "height": 4, "note": 'brace } quote \\" back \\\\ { é'[: k % 30]} for k in range(300)]
    notes = [{"id": k, "segmentation": {"counts": [1, {"x": {}}], "size": [2, 2]}, "image_id": k % 300, "category_id": k % 4, "bbox": [k / 4, 0, 1, 1], "text": "}{" * (k % 3)} for k in range(900)]
    doc = {"info": {"a": {"b": 1}}, "images": images, "empty": [], "licenses": [{"id": 7}], "version": 2, "annotations": notes, "categories": [{"id": k, "name": f"k{k}"} for k in range(3)]}
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for k, indent in enumerate((None, 2)):
        path = str(tmp_path / f"{k}.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(doc, f, indent=indent, ensure_ascii=indent is None)
        files = spark.createDataFrame([(f"x/{n}.png",) for n in range(0, 300, 2)], "path string")
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
            assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 10
            objects = array_objects(spark, path, ["images", "annotations", "categories"]).orderBy("number").collect()
            found = S.coco(spark, path, files).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
        for name in ("images", "annotations", "categories"):
            assert [json.loads(r.json) for r in objects if r.section == name] == doc[name]
        assert sorted(found) == sorted(S.coco(spark, path, files, whole=True).collect()) and len(found) == 150


def test_files_are_listed_and_read_by_tasks(spark, root):
    """No reader of Spark lists the folder, which takes all names through the driver."""
    from pathlib import Path

    for name in ("_hidden/a.png", "x/.part.png", "deep/er/still/ü %20.tif"):
        f = Path(root) / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x" * 3_000_000)
    (Path(root) / "nothing").mkdir()
    found = S.listing(spark, root)
    want = {str(f.relative_to(root)): f.stat().st_size for f in Path(root).rglob("*") if f.is_file() and not f.name.startswith(".") and "_hidden" not in str(f)}
    assert {r.path: r.length for r in found.collect()} == want
    for made in (found, S.single_bands(spark, root), S.patches(spark, root), S.image_folder(spark, root)):
        assert not any(Path(f.split(":", 1)[1]).is_relative_to(root) for f in made.inputFiles())
    bands = {r.sample_id: r.sha256 for r in S.single_bands(spark, root).collect()}
    assert bands["deep/er/still/ü %20.tif"] == hashlib.sha256(b"x" * 3_000_000).hexdigest()
