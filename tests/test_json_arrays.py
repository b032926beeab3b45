"""Annotation files read in ranges equal Spark's reader of whole files."""

from __future__ import annotations

import json
import random

import pytest

from wardwatch.sources import images as IM
from wardwatch.sources import json_arrays as J

ODD = ['plain', 'a "quoted" [ { name', "back\\slash \\", '"annotations": [ {"x": 1} ]', "tab\tnew\nline", "ünï → 😀", "}]}", "\\\\\" {", ""]


def coco(rng, n):
    return {
        "info": {"about": rng.choice(ODD), "nested": {"images": [{"id": -1, "file_name": "no"}]}, "list": [[{"id": -2}]]},
        "categories": [{"id": i, "name": f"{i} {rng.choice(ODD)}", "more": [{"id": 5}]} for i in range(4)],
        "images": [{"file_name": f"{rng.choice(ODD)}-{i}", "id": i, "size": {"w": [1, 2]}} for i in range(n)],
        "empty": [],
        "annotations": [{"image_id": rng.randrange(n), "category_id": rng.randrange(4), "bbox": [float(j), j * 0.5, 2.0, 3.0], "segmentation": [[1, 2], [3]], "note": rng.choice(ODD)} for j in range(3 * n)],
        "last": 3,
    }


def by_ranges(path, size, step, name):
    made = []
    for a in range(0, size, step):
        b = min(size, a + step)
        lead = min(a, J.LEAD)
        made.append((path, a, b, json.dumps(J.summary(J._bytes(open(path, "rb"), a - lead, b), lead))))
    return [json.loads(o) for part in J.planned(made) for _, _, o in J.objects_of(part, name)]


@pytest.mark.parametrize("seed", range(6))
def test_every_cut_gives_every_object_once(tmp_path, seed):
    rng = random.Random(seed)
    whole = coco(rng, 25)
    path = tmp_path / "one.json"
    path.write_text(json.dumps(whole, ensure_ascii=bool(seed % 2), indent=[None, 1][seed % 3 == 0]), encoding="utf-8")
    size = path.stat().st_size
    for step in (7, 64, 301, 4096, size):
        for name in ("images", "annotations", "categories", "empty", "absent"):
            assert by_ranges(str(path), size, step, name) == whole.get(name, [])


def test_one_file_by_many_tasks(spark, tmp_path):
    rng = random.Random(9)
    for k in range(2):
        (tmp_path / f"f{k}.json").write_text(json.dumps(coco(rng, 60 + k)), encoding="utf-8")
    got = IM.coco_tables(spark, str(tmp_path), range_bytes=2000)
    assert got[1].rdd.getNumPartitions() > 8
    schema = f"images array<struct<{IM.IMAGE.replace(' bigint', ': bigint').replace(' string', ': string')}>>, annotations array<struct<image_id: bigint, category_id: bigint, bbox: array<double>>>, categories array<struct<id: bigint, name: string>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(str(tmp_path))
    for df, name in zip(got, ("images", "annotations", "categories"), strict=True):
        want = sorted(map(str, raw.selectExpr(f"inline({name})").collect()))
        back = df.drop("source").withColumnsRenamed({"class": "name", **({"image_id": "id"} if name == "images" else {"category_id": "id"} if name == "categories" else {})})
        assert sorted(map(str, back.collect())) == want


def test_written_files_come_back(spark, tmp_path):
    images = spark.createDataFrame([(i, f'img "{i}" \\') for i in range(50)], "image_id long, file_name string")
    notes = spark.createDataFrame([(i % 40, i % 3, [1.0, 2.0, float(i), 4.0]) for i in range(200)], "image_id long, category_id long, bbox array<double>")
    names = spark.createDataFrame([(i, f"c{i}") for i in range(3)], "category_id long, class string")
    paths = IM.write_coco(images, notes, names, str(tmp_path / "out"), files=3)
    assert len(paths) == 3 and all(json.load(open(p)).keys() == {"images", "categories", "annotations"} for p in paths)
    back = IM.annotated_frames(*IM.coco_tables(spark, str(tmp_path / "out"), 500))
    assert sorted((r["image_id"], r["file_name"], len(r["boxes"])) for r in back.collect()) == [(i, f'img "{i}" \\', 5 if i < 40 else 0) for i in range(50)]


def test_number_of_annotation_files_follows_the_rows(spark, tmp_path, monkeypatch):
    from wardwatch.sources import images as IM

    monkeypatch.setattr(IM, "ROWS_PER_FILE", 10)
    images = spark.range(60).selectExpr("id AS image_id", "concat('f', id) AS file_name")
    notes = spark.range(40).selectExpr("id AS image_id", "1L AS category_id", "array(1.0D, 2.0D, 3.0D, 4.0D) AS bbox")
    names = spark.range(1).selectExpr("1L AS category_id", "'c' AS class")
    written = IM.write_coco(images, notes, names, str(tmp_path / "coco"), files=None)
    got = IM.annotated_frames(*IM.coco_tables(spark, str(tmp_path / "coco"))).collect()
    assert len(written) == 10 and sorted(r.image_id for r in got) == list(range(60))
    assert sum(len(r.boxes) for r in got) == 40
